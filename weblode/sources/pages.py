"""Tables of pages, and the live reader."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from weblode.functions.text import content_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def described(pages: DataFrame) -> DataFrame:
    """(page_id, url, md5_id, n_chars): what a page is known by."""
    return pages.select("page_id", "url", content_id(F.col("url")).alias("md5_id"), F.length("html").alias("n_chars"))


def one_per_url(pages: DataFrame) -> DataFrame:
    """The first page (by page_id) of each url."""
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return pages.join(first, ["url", "page_id"], "left_semi")


def fetched(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """urls (url) with the html of the stored page; null where there is none, which counts as a failed fetch."""
    return urls.join(one_per_url(pages).select("url", "html"), "url", "left")


def fetch(url: str, retries: int = 3, timeout: float = 10.0, wait: float = 1.0, get: Callable[[str, float], str] | None = None) -> str | None:
    """A page's markup, tried up to retries times with a pause between; None if every try fails."""
    get = get or _get
    for attempt in range(retries):
        try:
            return get(url, timeout)
        except (OSError, ValueError, urllib.error.URLError):
            if attempt + 1 < retries:
                time.sleep(wait)
    return None


def _get(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


class LivePages(DataSource):
    """spark.read.format("live_pages").option("urls", "one two ...").load(): (url, html, fetched), each url a partition."""

    @classmethod
    def name(cls) -> str:
        return "live_pages"

    def schema(self) -> str:
        return "url string, html string, fetched double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LiveReader(self.options)


class _LiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = options.get("urls", "").split()
        self.retries, self.timeout = int(options.get("retries", 3)), float(options.get("timeout", 10))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.value, fetch(partition.value, self.retries, self.timeout), time.time()
