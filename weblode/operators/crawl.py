"""Best-first crawl over a table of pages, for many seeds at once.

Each round takes the best address of every seed's frontier, so the rounds are as many as the page budget whatever the number of seeds. Edges are
scored once, before the rounds. Frontier and visited pages are stored each round in the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblode.operators import links


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/weblode-shared"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/crawl-{uuid.uuid4().hex[:12]}"


def best_first(pages: DataFrame, seeds: DataFrame, keywords: list[str], max_depth: int = 3, max_pages: int = 20, least: float = 0.4) -> DataFrame:
    """(seed, step, url, depth, score, found) of every page visited from each of seeds (seed); found is false for an address without a page."""
    spark, root = pages.sparkSession, _folder(pages.sparkSession)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    # both are read again and again: kept, pages are parsed once, and what pages come from isn't made anew each round
    every = stored(links.anchors(pages), "anchors")
    edges = stored(links.relevant(every, keywords).groupBy("url", "dst").agg(F.max("score").alias("score")), "edges")
    first = stored(links.seeds(every, keywords).select("url", "dst", "score"), "first")
    there = stored(pages.select("url").distinct().withColumn("found", F.lit(True)), "there")
    start = seeds.select("seed", F.lit(0).alias("step"), F.col("seed").alias("url"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"))
    visited = stored(start.join(there, "url", "left").select("seed", "step", "url", "depth", "score", F.coalesce("found", F.lit(False)).alias("found")), "visited0")
    found = visited.where("found")
    frontier = found.join(edges.select("url", "dst", F.col("score").alias("s")), "url").select("seed", F.col("dst").alias("url"), F.col("s").alias("score"), F.lit(1).alias("depth"))
    frontier = frontier.where(F.lit(max_depth > 0)).unionByName(found.join(first.select("url", "dst", F.col("score").alias("s")), "url").select("seed", F.col("dst").alias("url"), F.col("s").alias("score"), F.lit(1).alias("depth")))
    frontier = stored(frontier, "frontier0")
    best = Window.partitionBy("seed").orderBy(F.desc("score"), "url", "depth")
    for step in range(1, max_pages):
        open_ = frontier.where((F.col("depth") <= max_depth) & (F.col("score") > least)).join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        taken = open_.withColumn("rank", F.row_number().over(best)).where("rank = 1").join(there, "url", "left")
        taken = stored(taken.select("seed", F.lit(step).alias("step"), "url", "depth", "score", F.coalesce("found", F.lit(False)).alias("found")), f"taken{step}")
        if taken.isEmpty():
            break
        visited = stored(visited.unionByName(taken), f"visited{step}")
        more = taken.where(F.col("found") & (F.col("depth") < max_depth)).join(edges.withColumnRenamed("score", "s"), "url").select("seed", F.col("dst").alias("url"), F.col("s").alias("score"), (F.col("depth") + 1).alias("depth"))
        frontier = stored(open_.unionByName(more), f"frontier{step}")
    return visited
