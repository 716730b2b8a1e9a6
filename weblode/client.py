"""The whole way: crawl from a seed, parse what was found, rank, save."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.operators import crawl, documents, prompt
from weblode.sources import sinks


def logger(name: str) -> logging.Logger:
    """A logger that writes to the console from INFO on."""
    out = logging.getLogger(name)
    if not out.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        out.addHandler(handler)
    out.setLevel(logging.INFO)
    return out


class WebClient:
    """Keeps a key (any text but the empty one) and a session."""

    def __init__(self, spark: SparkSession, api_key: str) -> None:
        if not api_key:
            raise ValueError("Invalid API key.")
        self.spark, self.api_key, self.log = spark, api_key, logger("weblode")

    def documents(self, pages: DataFrame, urls: list[str], instructions: str, depth: int = 3) -> DataFrame:
        """Ranked documents of what a crawl from urls reaches in pages (url, html); a page that can't be parsed is left out."""
        q = prompt.query(instructions)
        keywords = prompt.expanded_keywords(q)
        if "page_id" not in pages.columns:
            pages = pages.withColumn("page_id", F.xxhash64("url"))
        seeds = self.spark.createDataFrame([(u,) for u in urls], "seed string")
        visited = crawl.best_first(pages, seeds, keywords, depth).where("found")
        reached = pages.join(visited.groupBy("url").agg(F.min("depth").alias("depth")), "url")
        return documents.final_documents(reached, q, keywords)

    def scrape(self, pages: DataFrame, url: str, instructions: str, output_file: str | None = None, depth: int = 3) -> DataFrame:
        """The documents of one seed, also saved as one JSON list if there are any."""
        found = self.documents(pages, [url], instructions, depth)
        if sinks.save_list(found, output_file) is None:
            self.log.warning("No relevant content found")
        return found
