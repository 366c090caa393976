"""SQL with named parameters over DataFrames: look-ups and synchronisation statements."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is not a parameter (quoted texts and names, comments, casts), and parameters.
_TOKENS = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|:(\w+)""", re.S)


def parameter(value: Any) -> Any:
    """A value as an argument: Python's types stand for themselves, a list is an array, a set a sorted one."""
    if isinstance(value, set | frozenset):
        value = sorted(value)
    return F.array(*[F.lit(x) for x in value]) if isinstance(value, list | tuple) else value


def run(spark: SparkSession, statement: str, values: dict[str, Any] | None = None, kinds: dict[str, str] | None = None, **tables: DataFrame) -> DataFrame:
    """The statement's rows: ``:name`` stands for a value, ``{name}`` for a table.

    Values are literals of the plan, never parts of the text, so a quote in one changes nothing and filters on them reach the scan.
    ``kinds`` gives parameters a type other than Python's, which nulls and empty lists may need. A name without a value is
    an error; a list is for functions of arrays, as in ``array_contains(:codes, code)``.
    """
    values, kinds = values or {}, kinds or {}
    if unknown := set(kinds) - set(values):
        raise ValueError(f"types without values: {sorted(unknown)}")
    typed = _TOKENS.sub(lambda m: f"cast({m[0]} as {kinds[m[1]]})" if m[1] in kinds else m[0], statement)
    return spark.sql(typed, args={k: parameter(v) for k, v in values.items()}, **tables)


def value(spark: SparkSession, statement: str, values: dict[str, Any] | None = None, kinds: dict[str, str] | None = None, **tables: DataFrame) -> Any:
    """The one value of a statement, None without a row; more rows or columns are an error."""
    rows = run(spark, statement, values, kinds, **tables).limit(2).collect()
    if len(rows) > 1 or rows and len(rows[0]) != 1:
        raise ValueError("the statement has more than one value")
    return rows[0][0] if rows else None
