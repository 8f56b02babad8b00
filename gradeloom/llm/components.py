"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, new_dir


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node connected to each node, by alternating large and small stars.

    Every round is written to the shared folder, so that neither the plan nor a lost executor's work grows; the round before it goes
    once nothing reads it.
    """
    spark, folder = edges.sparkSession, new_dir(edges.sparkSession, "edges")

    def kept(rows: DataFrame, k: int) -> DataFrame:
        rows.write.parquet(f"{folder}/{k}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{k}")

    now = kept(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), 0)
    for k in range(1, max_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours hang on the least of the neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours hang on the least of those
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        after = kept(small, k)
        settled = after.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(after, ["u", "v"], "left_anti").isEmpty()
        discard(spark, f"{folder}/{k - 1}")
        now = after
        if settled:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
