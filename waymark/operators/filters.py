"""Filters of a search, dispatch of a query, and checks of a request's parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.plans import gazetteer


def of_types(objects: DataFrame, types: list[int] | None) -> DataFrame:
    return objects if not types else objects.where(F.col("typ").isin(*types))


def postal_objects(objects: DataFrame) -> DataFrame:
    return objects.where(gazetteer.is_post_address(F.col("is_leaf"), F.col("typ")))


def uses_big_index(types: list[int] | None) -> bool:
    """Whether the index of cities, municipalities, parishes and villages has all that is asked for."""
    return bool(types) and set(types) <= set(gazetteer.BIG)


def route(query: Column, lat: Column, long: Column) -> Column:
    """code, text, nearest or none."""
    by_text = lat.isNull() | long.isNull()
    return F.when(text.is_code(F.coalesce(query, F.lit(""))), "code").when(by_text, "text").when(text.bounding_box(lat, long), "nearest").otherwise("none")


def parameters(limit: str | None = None, types: list[str] | None = None, post_addr: bool = False, lat: str | None = None, long: str | None = None) -> dict:
    """Checked parameters of a request; ValueError for what a service answers with 400."""
    near = lat is not None and long is not None
    n = int(limit) if limit not in (None, "") else (1 if near else 20)
    if n < 0:
        raise ValueError("limit is negative")
    if post_addr and types:
        raise ValueError("post_addr and type exclude each other")
    own = None if not types or any(not t.strip() for t in types) else [int(t) for t in types]
    return {"limit": min(n, 20 if near else 100), "types": own, "post_addr": post_addr, "lat": float(lat) if near else None, "long": float(long) if near else None}
