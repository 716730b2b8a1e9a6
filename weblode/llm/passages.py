"""Repeated passages of words: seeds from winnowed anchors, extended both ways, kept where a window of `window` words repeats.

1. Each different text gives its anchors (a gram of words, least in the windows that it owns).
2. Documents meet on anchors that occur in more than one text; only those keep their segment: the words that the anchor's windows cover.
3. Seeds are extended to both sides in step. Occurrences whose whole segments are equal are one class, merged map-side, so a passage that a
   third of the documents share stays one row a task. Classes of one anchor that differ (at the ends of a passage) compare their windows, each
   by the hash of its words; the least doc_id of a window decides. This takes work in proportion to the occurrences, never to their pairs.
4. Windows side by side form maximal repeats; their words are removed.

Windows are compared by 64 bits of hash within an anchor of 64 other bits.

Defined results. Null text: as empty. Fewer words than the window: nothing is removed. Null doc_id: it is neither smaller nor larger than
another, so the row keeps all words and makes no other row lose any. Rows that share a doc_id: none is smaller, so they take nothing from each
other. Copies of a text: all but those with the least doc_id lose every word, if there are as many as the window. Empty table: no rows. Very long
texts are hashed in pieces of bounded size. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm.anchors import owned, word_hashes
from weblode.llm.common import Rolling, Scratch, batches, distinct_texts, table, text_keys, utf8, words_of

WINDOW, GRAM = 50, 10
LIMIT = 2 << 20


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def ranges(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (number[i] of them), one after the other."""
    if not len(first):
        return np.zeros(0, np.int64)
    ends = np.cumsum(number)
    return np.arange(ends[-1]) + np.repeat(first - (ends - number), number)


def anchor_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(ah, tid, least, first, n) of every text (tid, body, least)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, LIMIT):
            body, at = utf8(b.column(1))
            starts, ends, word_at = words_of(body, at)
            row, first, n, ah, _ = owned(word_hashes(body, starts, ends), word_at, window, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ah.view(np.int64)), b.column(0).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array((first - word_at[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["ah", "tid", "least", "first", "n"],
            )

    return texts.select("tid", "body", "least").mapInArrow(run, "ah long, tid long, least long, first int, n int")


def occurrences(found: DataFrame, window: int) -> DataFrame:
    """(ah, seg, tid, least, first, n, windows): the segment's hash and those of its windows, for texts with lists of anchors (at: ah, first, n)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, LIMIT):
            body, at = utf8(b.column(1))
            starts, ends, word_at = words_of(body, at)
            rolling = Rolling(word_hashes(body, starts, ends))
            lists = b.column(3)
            count = np.diff(lists.offsets.to_numpy())
            inner = lists.flatten()
            ah, first, n = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            row = np.repeat(np.arange(b.num_rows), count)
            begin = word_at[row] + first
            seg = rolling.of(begin, begin + n + window - 1)
            each = ranges(begin, n)
            windows = rolling.of(each, each + window).view(np.int64)
            for k in range(0, len(row), 20000):
                s = slice(k, k + 20000)
                low, high = int(n[:k].sum()), int(n[: k + 20000].sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ah[s]), pa.array(seg[s].view(np.int64)), b.column(0).take(pa.array(row[s])), b.column(2).take(pa.array(row[s])), pa.array(first[s]), pa.array(n[s]), _lists(windows[low:high], n[s])],
                    ["ah", "seg", "tid", "least", "first", "n", "windows"],
                )

    return found.select("tid", "body", "least", "at").mapInArrow(run, "ah long, seg long, tid long, least long, first int, n int, windows array<long>")


def removal(texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, least, n_words, n_removed, kept, whole) of texts with lists of windows that repeat (at: first, n; null for none)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, LIMIT):
            out = []
            for text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                whole = kept = hashlib.sha256(b" ".join(words)).hexdigest()
                removed = 0
                if at:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, [a["first"] for a in at], 1)
                    np.add.at(depth, [a["first"] + a["n"] + window - 1 for a in at], -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    removed = int(len(words) - stay.sum())
                    kept = hashlib.sha256(b" ".join([words[k] for k in np.flatnonzero(stay).tolist()])).hexdigest()
                out.append((len(words), removed, kept, whole))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(4), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])], ["h1", "h2", "least", "n_words", "n_removed", "kept", "whole"])

    return texts.select("body", "at", "h1", "h2", "least").mapInArrow(run, "h1 long, h2 long, least long, n_words long, n_removed long, kept string, whole string")


def repeated_words(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): words covered by a window that also starts in a document with a smaller doc_id go."""
    scratch = Scratch(spark, "passages")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = distinct_texts(scratch, docs)
    rows = scratch.store(anchor_rows(texts.where("least is not null"), window, gram), "anchors")
    again = rows.groupBy("ah").agg(F.min("tid").alias("t0"), F.max("tid").alias("t1")).where("t0 < t1").select("ah")
    seeds = rows.join(again, "ah", "left_semi").groupBy("tid").agg(F.collect_list(F.struct("ah", "first", "n")).alias("at"))
    occ = scratch.store(occurrences(texts.join(seeds, "tid"), window), "occurrences")
    scratch.drop("anchors")
    classes = scratch.store(occ.groupBy("ah", "seg").agg(F.min("least").alias("m"), F.any_value("windows").alias("windows")), "classes")
    several = classes.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("ah")
    each = classes.join(several, "ah", "left_semi").select("ah", "seg", "m", F.posexplode("windows").alias("o", "window"))
    lowest = each.groupBy("ah", "window").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo < hi").select("ah", "window", "lo")
    ends = each.join(lowest, ["ah", "window"]).where("lo < m").groupBy("ah", "seg").agg(F.collect_list("o").alias("places"))
    solved = classes.select("ah", "seg", "m").join(ends, ["ah", "seg"], "left")
    met = occ.select("ah", "seg", "tid", "least", "first", "n").join(solved, ["ah", "seg"])
    full = met.where("least > m").select("tid", "first", "n")
    part = met.where("least = m and places is not null").select("tid", F.explode(F.transform("places", lambda o: F.col("first") + o)).alias("first"), F.lit(1).alias("n"))
    covered = full.unionByName(part).groupBy("tid").agg(F.collect_list(F.struct("first", "n")).alias("at"))
    by_text = removal(texts.join(covered, "tid", "left"), window)
    h1, h2 = text_keys(F.col("text"))
    mine = docs.select("doc_id", h1, h2).join(by_text, ["h1", "h2"])
    copy, own = F.col("doc_id") > F.col("least"), F.col("doc_id") == F.col("least")
    gone = copy & (F.col("n_words") >= window)
    return mine.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).when(own, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.col("kept")).otherwise(F.col("whole")).alias("kept_sha256"),
    )


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op10_passages": op10_passages}
ORACLE_SQL: dict[str, str] = {}
