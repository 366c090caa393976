"""CSV and JSON output, and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_lines(records: DataFrame, types: list[int] | None = None) -> DataFrame:
    """value: code;address;typ;zipCode;lat;long, with 'null' for nulls and ', ' for line ends and '|' in the address."""
    rows = records if not types else records.where(F.col("typ").isin(*types))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    address = F.regexp_replace("address", r"[\n|;]", ", ")
    return rows.select(F.concat_ws(";", shown("code"), F.coalesce(address, F.lit("null")), shown("typ"), shown("zipCode"), shown("lksLat"), shown("lksLong")).alias("value"))


def json_result(columns: list[str]) -> Column:
    """One JSON object of the columns that are not null; an edit distance of 0 is left out."""
    own = [F.when(F.col(c) > 0, F.col(c)).alias(c) if c == "editDistance" else F.replace(F.col(c), F.lit("\n"), F.lit(", ")).alias(c) if c == "address" else F.col(c) for c in columns]
    return F.to_json(F.struct(*own))


def save_snapshot(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes the tables under the version and then the pointer that makes it current."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{root}/current")


def current_version(spark: SparkSession, root: str) -> str | None:
    try:
        return spark.read.parquet(f"{root}/current").agg(F.max("version")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load_snapshot(spark: SparkSession, root: str, names: list[str], version: str | None = None) -> dict[str, DataFrame]:
    version = version or current_version(spark, root)
    if version is None:
        raise ValueError(f"no snapshot in {root}")
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}


def old_versions(versions: list[str], keep: int = 1) -> list[str]:
    """Versions to delete: all but the newest, by name."""
    return sorted(versions)[: max(len(versions) - keep, 0)]
