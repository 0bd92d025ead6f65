"""Tables, scratch tables and bounded samples shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, scratch, ship

_stored: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored() -> list[str]:
    """The paths of all tables that materialize() has written and sweep() hasn't removed, oldest first."""
    return list(_stored)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of materialize() that no DataFrame in use reads any more."""
    for path in paths:
        remove(spark, path)
        _stored.remove(path)


_SPREAD = 1 << 31


def spread(*keys: str) -> Column:
    """A hash of the columns, even over 0 to 2**31: rows with the smallest values are a random sample."""
    return F.pmod(F.xxhash64(*keys), F.lit(_SPREAD))


def within(n: int, total: int | Column) -> Column:
    """The spread() below which about n of ``total`` rows lie, all of them if there are no more."""
    return F.ceil(F.least(F.lit(1.0), F.lit(float(n)) / total) * _SPREAD)


#: A key with over a HOT_SHARE-th of all rows is salted; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1_000


def join_salted(rows: DataFrame, found: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with ``found``, which has one row a key and in ``size`` the number of rows with it.

    Rows of frequent keys are spread over several tasks by a salt, and their row of ``found`` goes to each of them.
    """
    total = rows.count()
    limit = total // HOT_SHARE + 1
    salts = F.when(F.col(size) > limit, F.ceil(F.col(size) / limit)).otherwise(1).cast("int")
    several = found.select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt")).drop(size)
    hot = found.where(F.col(size) > limit).select(F.col(key).alias("__hot"), salts.alias("__salts"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")  # fewer than HOT_SHARE rows: sizes add up to all rows
    spread_ = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__salts"))).cast("int")
    return marked.withColumn("__salt", spread_).drop("__hot", "__salts").join(several, [key, "__salt"]).drop("__salt")
