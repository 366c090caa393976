"""Operations of a training-data pipeline; nothing else in waymark imports this."""
