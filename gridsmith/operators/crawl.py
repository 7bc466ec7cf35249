"""Best-first crawl over an edge table (X3) and sitemap recursion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.session import shared_folder


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that rounds don't pile up lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/crawl/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crawl(start: DataFrame, edges: DataFrame, scores: DataFrame, max_depth: int = 3, budget: int = 50, width: int = 10) -> DataFrame:
    """(url, depth, score, visit): pages reached from `start` (url), at most `budget` of them.

    A round visits the `width` best pages of the frontier, by score, then depth, then
    address; their links (edges: url, to) join it at one level more, up to max_depth.
    This is the level-synchronous form of a priority queue: with width 1 it is the queue."""
    frontier = _kept(start.select("url").distinct().withColumn("depth", F.lit(0)).join(scores, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "frontier")
    seen = None
    done, visit = 0, 0
    while done < budget:
        best = frontier.orderBy(F.col("score").desc(), "depth", "url").limit(min(width, budget - done)).withColumn("visit", F.lit(visit))
        best = _kept(best, "visited")
        n = best.count()
        if not n:
            break
        done, visit = done + n, visit + 1
        seen = best if seen is None else _kept(seen.unionByName(best), "seen")
        found = best.filter(F.col("depth") < max_depth).select("url", "depth").join(edges, "url").groupBy(F.col("to").alias("url")).agg((F.min("depth") + 1).alias("depth")).join(scores, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        frontier = _kept(frontier.unionByName(found).groupBy("url").agg(F.min("depth").alias("depth"), F.max("score").alias("score")).join(seen.select("url"), "url", "left_anti"), "frontier")
    return seen if seen is not None else start.limit(0).select("url", F.lit(0).alias("depth"), F.lit(0.0).alias("score"), F.lit(0).alias("visit"))


def sitemaps(start: DataFrame, index: DataFrame, depth: int = 2) -> DataFrame:
    """(url, depth): what an index (url, to) reaches in so many steps, first depth of each."""
    out = start.select("url", F.lit(0).alias("depth"))
    level = out
    for d in range(1, depth + 1):
        level = level.join(index, "url").select(F.col("to").alias("url"), F.lit(d).alias("depth")).distinct()
        out = out.unionByName(level)
    return out.groupBy("url").agg(F.min("depth").alias("depth"))
