"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v), root being the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a minimum by key
    and a join by key, so that no node's neighbours are ever gathered in one place. Rounds end
    when every edge leads to a root; each round's edges are written to the shared folder.
    A node with very many neighbours is a hot key of the joins, which adaptive execution splits; nodes are numbers,
    so texts of any length don't matter here. Empty edges give no rows; self edges and repeats don't matter; null ends are ignored.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    own = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    current, path = stored(own.where("u <> v").distinct())
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after, new_path = stored(small.select("e.u", "e.v").where("u <> v").distinct())
        remove(spark, path)
        current, path = after, new_path
        roots = current.select(F.col("v").alias("u")).distinct()
        if current.join(roots, "u", "left_semi").isEmpty() and current.groupBy("u").count().where("count > 1").isEmpty():
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
