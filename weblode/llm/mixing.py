"""Mixing sources to target weights by systematic sampling.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share `share` of all words; a source's target stops at `most` times its
size, and what is over is shared out again by weight among the others until none is above. Each document of a source is expected target / size
copies. Documents of a source stand in order of size (ties by hash), so that each stretch of it holds like ones; running sums of expected copies
plus one random offset a source say how often a document is taken: once for each whole number that the sum passes. Copies of a document differ
by at most one from the expected number, and a source's words from its target by about its largest document.

The running sum is the number of documents before times one constant, so a distributed rank gives it: a range partition by source and order, and
one row of counts a part. A source with a third of all rows spreads over its share of the parts. The order is that of size, text and doc_id, so
rerunning gives the same rows, in whatever order the input comes; rows that agree in all three are interchangeable.

Defined results. Null, empty or blank text: size 0; it takes part and adds no words. Null source: a source of its own, the last. A source without
words: target 0, nothing taken. Null doc_id: kept, ordered by the text's hash. Repeated rows: each is a document of its own. Very long texts: their
words are counted in the row, nothing else of them is held. Empty table: no rows. Other columns, whatever their names, stay as they are in the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblode.llm.common import Scratch, numbered, ranked, table, text_keys

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0


def word_count(text):
    """Number of [^\\x20\\x09-\\x0D]+ in the text."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).cast("long")


def quick_word_count(text):
    """The same without building the words: every word begins at a non-blank after a blank or the start."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.length(F.trim(plain)) == 0, F.lit(0)).otherwise(F.size(F.filter(F.split(plain, " "), lambda w: w != ""))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size).

    With the sources in order of cap / weight, those up to some place reach their cap and the others get the same level times their weight; the
    level of the first place that its own cap holds is the right one. Both windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    whole = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighed.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("all", F.lit(share) * F.sum("source_size").over(everything))
    level = level.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = level.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    level = level.withColumn("level", F.first("level", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sized(docs: DataFrame, *others: Column) -> DataFrame:
    """What mixing reads of docs (doc_id, text, source): source, size and the order of rows of one size, which their text and doc_id decide; and others."""
    h1, h2 = text_keys(F.col("text"))
    return docs.select("doc_id", "source", quick_word_count(F.col("text")).alias("size"), h1, h2, *others)


def mixed(spark: SparkSession, rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> DataFrame:
    """sized rows with source_size, target and copies."""
    scratch = Scratch(spark, "mixing")
    rows = scratch.store(rows.withColumn("tie", F.xxhash64(F.lit(seed), "h1", "h2", "doc_id")), "sized")
    placed = ranked(scratch, rows, ["source"], [F.col("size"), F.col("tie"), F.col("h1"), F.col("h2"), F.col("doc_id")], "ranked")
    found = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumnRenamed("source", "named")
    out = placed.join(found, placed["source"].eqNullSafe(found["named"]))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit(""))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    passed = F.floor(F.col("place") * rate + offset) - F.floor((F.col("place") - 1) * rate + offset)
    return out.withColumn("copies", F.least(passed, F.lit(int(most)).cast("long"))).drop("tie", "h1", "h2", "named", "place")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> DataFrame:
    """The mix itself: rows of docs (doc_id, text, source and any others), each as often as it is taken."""
    rows = numbered(Scratch(spark, "mix"), docs)
    slim = sized(rows.select("rid", "doc.doc_id", "doc.text", "doc.source"), F.col("rid"))
    taken = mixed(spark, slim, weights, share, most, seed).where("copies > 0").select("rid", F.col("copies").cast("int").alias("copies"))
    return rows.join(taken, "rid").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(spark, sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL: dict[str, str] = {}
