"""Links of pages: resolved, filtered and scored."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from weblode.functions import score
from weblode.sources.html import absolute, parsed

MEDIA = r"(?i)\.(gif|png|jpe?g|pdf|docx?)$"


@F.pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([absolute(b, h) for b, h in zip(base, href, strict=True)])


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, ord, href, text, context, navigation, joined): every link of every page; joined is its address where expressions can't resolve it."""
    found = parsed(pages, ("anchors",))
    return found.select("page_id", "url", F.posexplode("anchors").alias("ord", "a")).select("page_id", "url", "ord", "a.*")


def resolved(links: DataFrame) -> DataFrame:
    """links with dst, the absolute address. Plain paths are resolved by expressions, others by the standard library.

    It has done so while the page was parsed if links have joined; a second Python worker beside the parser's would double the memory.
    """
    origin = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    simple = F.when(F.col("href").rlike(r"^/(?!/)") & ~F.col("href").rlike(r"(^|/)\.{1,2}(/|$)|[\s]"), F.concat(origin, F.col("href")))
    plain = links.withColumn("dst", F.when(origin != "", simple))
    if "joined" in links.columns:
        return plain.withColumn("dst", F.coalesce("dst", "joined")).drop("joined")
    return plain.withColumn("dst", F.coalesce("dst", _joined(F.when(F.col("dst").isNull(), F.col("url")), F.when(F.col("dst").isNull(), F.col("href")))))


def authority(address: Column) -> Column:
    return F.coalesce(F.try_parse_url(address, F.lit("AUTHORITY")), F.lit(""))


def same_site(links: DataFrame) -> DataFrame:
    return links.where(authority(F.col("dst")) == authority(F.col("url")))


def no_media(links: DataFrame) -> DataFrame:
    return links.where(~F.col("dst").rlike(MEDIA))


def unvisited(links: DataFrame, visited: DataFrame) -> DataFrame:
    return links.join(visited.select(F.col("url").alias("dst")).distinct(), "dst", "left_anti")


def scored(links: DataFrame, keywords: list[str]) -> DataFrame:
    return links.withColumn("score", score.url(F.col("dst"), F.col("text"), F.col("context"), keywords))


def relevant(links: DataFrame, keywords: list[str], least: float = 0.2) -> DataFrame:
    """Same-site links to no media, scored over least; the best score of each address of a page."""
    return scored(no_media(same_site(resolved(links))), keywords).where(F.col("score") > least)


def seeds(links: DataFrame, keywords: list[str], many: int = 10, least: float = 0.4) -> DataFrame:
    """The best links of each page that aren't in navigation; ties by address, descending."""
    found = resolved(links.where("not navigation")).withColumn("score", score.seed_link(F.col("href"), F.col("text"), F.col("context"), keywords))
    best = same_site(found.where(F.col("score") > least)).groupBy("page_id", "url", "dst").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("page_id", "url").orderBy(F.desc("score"), F.desc("dst")))
    return best.withColumn("rank", rank).where(F.col("rank") <= many)
