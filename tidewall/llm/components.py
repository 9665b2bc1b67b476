"""Connected components of links between numbers, by alternating large and small stars.

Each round points every node to the smallest node it knows; all nodes of a component meet at its smallest one after a
number of rounds that grows with the logarithm of the component.  Links and stars stay in tables of the shared folder;
what comes to the driver is one row of counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import remove, shared_folder


def components(links: DataFrame) -> DataFrame:
    """Rows (`node`, `component`) for every node of `links` (`a`, `b` bigint): the smallest node reachable.

    Links in either direction, repeated links and links of a node to itself are all right; nodes without any other
    node may be missing from the result.
    """
    spark = links.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_folder(spark, "stars")
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    # a is the larger node
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    stars, path = write(ordered)
    state = None
    while True:
        both = stars.union(stars.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        large, large_path = write(large)
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_m").alias("b")
        ).distinct()
        small, small_path = write(small)
        remove(spark, path)
        remove(spark, large_path)
        stars, path = small, small_path
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
