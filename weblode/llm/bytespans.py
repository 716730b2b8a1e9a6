"""Repeated byte strings of a fixed length, by external induced sorting of suffixes.

Sorting every suffix of a corpus takes several times its size on disk, so what can't repeat is left out first, exactly:

1. Each different text gives winnowed anchors; a window of `length` bytes belongs to one anchor, and equal windows to equal anchors.
2. Anchors that occur once are dropped. Of the others the segment is taken: the bytes that the anchor's windows cover. Equal segments are one
   class, counted map-side; in a class that occurs twice every window repeats, whatever its size.
3. Anchors with more than one class are the ends of repeated stretches. Their windows are cut to pieces of PIECE_WINDOWS at fixed places from the
   anchor. All windows of a piece share its core; a piece whose core occurs once has no repeat, and one that occurs twice as a whole repeats whole. In
   what is left a name of NAME bytes stands for the core, so a window of `length` bytes is one of few bytes.
   Those go to shards by anchor. A shard streams them to disk and sorts all suffixes externally (see suffixes.py: disk-backed queues of suffixes
   and common prefixes, recursive induction); a window repeats if its suffix has a common prefix of a window's length with a neighbour. A hot
   anchor makes its shard long, not its memory large.
4. Windows that repeat cover the bytes to remove.

The scratch of a shard lies in the shared folder if that is a mounted path, else in the executor's own working folder, one subfolder an attempt;
it is removed when the shard ends.

Defined results. Null text: as empty (no bytes, digest of nothing). Texts shorter than `length`: kept whole. Repeated rows and copies: every copy
of a text of at least `length` bytes is removed whole, the first one too. Null doc_id: treated like any row. Empty table: no rows. Very long texts
are hashed in pieces. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm.anchors import BYTES, PIECE, byte_pieces, owned
from weblode.llm.common import Rolling, Scratch, batches, distinct_texts, mixed, table, text_keys, utf8
from weblode.llm.suffixes import scan_suffixes

LENGTH, GRAM = 200, 40
#: Windows of a piece, bytes of the name of a core.
PIECE_WINDOWS, NAME = 32, 10
#: Bytes of segments that a shard should hold.
SHARD = 4 << 20


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(ah, tid, first, n, off) of every text (tid, body); off: place of the anchor from the first window."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, PIECE):
            body, at = utf8(b.column(1))
            if len(body) <= 2 * PIECE:
                row, first, n, ah, off = owned(BYTES[body], at, length, gram)
                found = [(row, first - at[row], n, ah, off)]
            else:
                found = []
                for r, low, symbols in byte_pieces(body, at, length):
                    row, first, n, ah, off = owned(symbols, np.array([0, len(symbols)]), length, gram)
                    found.append((row + r, first + low, n, ah, off))
            for row, first, n, ah, off in found:
                yield pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), b.column(0).take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))], ["ah", "tid", "first", "n", "off"])

    return texts.select("tid", "body").mapInArrow(run, "ah long, tid long, first int, n int, off int")


def segments(found: DataFrame, length: int) -> DataFrame:
    """(ah, seg, tid, first, n, off, bytes) for texts (tid, body) with lists of anchors (at: ah, first, n, off)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, PIECE):
            tids = b.column(0)
            lists = b.column(2)
            count = np.diff(lists.offsets.to_numpy())
            inner = lists.flatten()
            ah, first, n, off = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            body, at = utf8(b.column(1))
            row = np.repeat(np.arange(b.num_rows), count)
            begin = at[row] + first
            seg = np.zeros(len(row), np.uint64)
            order, k = np.argsort(begin, kind="stable"), 0
            while k < len(order):
                low = int(begin[order[k]])
                j = max(k + 1, int(np.searchsorted(begin[order], low + PIECE)))
                some = order[k:j]
                high = int((begin[some] + n[some]).max()) + length - 1
                seg[some] = Rolling(BYTES[body[low:high]]).of(begin[some] - low, begin[some] - low + n[some] + length - 1)
                k = j
            for k in range(0, len(row), 4096):
                s = slice(k, k + 4096)
                parts = [body[x:y].tobytes() for x, y in zip(begin[s].tolist(), (begin[s] + n[s] + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ah[s]), pa.array(seg[s].view(np.int64)), tids.take(pa.array(row[s])), pa.array(first[s]), pa.array(n[s]), pa.array(off[s]), pa.array(parts, pa.binary())],
                    ["ah", "seg", "tid", "first", "n", "off", "bytes"],
                )

    return found.select("tid", "body", "at").mapInArrow(run, "ah long, seg long, tid long, first int, n int, off int, bytes binary")


def _folder(shared: str) -> str:
    path = shared.removeprefix("file:")
    base = "/" + path.lstrip("/") if shared.startswith(("file:", "/")) and os.path.isdir("/" + path.lstrip("/")) else os.getcwd()
    return f"{base}/shard-{uuid.uuid4().hex}"


def pieces(classes: DataFrame, length: int) -> DataFrame:
    """(ah, seg, core, begin, n, body) of classes (ah, seg, n, off, bytes): windows begin .. begin + n - 1 are those of body, in which a name stands for the core."""
    width = PIECE_WINDOWS

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, PIECE):
            part, at = _binary(b.column(4))
            ah, seg = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            n, off = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            low = width * (1 + length // width) - off  # place of the first window in a numbering by the anchor
            many = (low + n - 1) // width - low // width + 1
            row = np.repeat(np.arange(len(n)), many)
            piece = low[row] // width + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = np.maximum(piece * width - low[row], 0)
            end = np.minimum((piece + 1) * width - low[row], n[row])
            start = piece * width - low[row]
            left, right = at[row] + start + width - 1, at[row] + start + length
            core = Rolling(BYTES[part]).of(left, right)
            core = mixed(core ^ mixed(ah[row].view(np.uint64) + piece.astype(np.uint64)))
            names = ((core[:, None] >> (np.uint64(7) * np.arange(NAME, dtype=np.uint64))) & np.uint64(127)).astype(np.uint8).tobytes()
            raw = part.tobytes()
            bodies = [raw[x:y] + names[NAME * k : NAME * (k + 1)] + raw[z:w] for k, (x, y, z, w) in enumerate(zip((at[row] + begin).tolist(), left.tolist(), right.tolist(), (at[row] + end - 1 + length).tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(ah[row]), pa.array(seg[row]), pa.array(core.view(np.int64)), pa.array(begin.astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(bodies, pa.binary())], ["ah", "seg", "core", "begin", "n", "body"])

    return classes.select("ah", "seg", "n", "off", "bytes").mapInArrow(run, "ah long, seg long, core long, begin int, n int, body binary")


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(column.cast(pa.large_binary()).view(pa.large_string()))


def repeated_places(bodies: DataFrame, length: int, shared: str) -> DataFrame:
    """(core, eh, first, n): runs of windows that repeat, of pieces (core, eh, times, n, body) that occur once. One task is one shard."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _folder(shared)
        os.makedirs(folder)
        try:
            heads, starts, total = [], [], 0
            with open(f"{folder}/text", "wb") as f:
                for b in frames:
                    for core, eh, times, n, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        f.write((np.frombuffer(part, np.uint8) + np.uint8(2)).tobytes() + b"\1")
                        if times == 1:
                            heads.append((core, eh, n))
                            starts.append(total)
                        total += len(part) + 1
                f.write(b"\0")
            if not heads:
                return
            text = np.memmap(f"{folder}/text", np.uint8, "r")
            hit = np.memmap(f"{folder}/hit", np.bool_, "w+", shape=(len(text),))
            last = [np.zeros(0, np.int64)]

            def scanned(place: np.ndarray, value: np.ndarray, _: bool) -> None:
                far = np.flatnonzero(value >= length)
                before = np.concatenate([last[0], place])
                hit[place[far]] = True
                hit[before[far + len(last[0]) - 1]] = True
                last[0] = place[-1:]

            scan_suffixes(np.asarray(text) if len(text) <= 64 << 20 else text, 256, length, f"{folder}/sort", scanned)
            out: list[tuple[int, int, int, int]] = []
            for (core, eh, n), s in zip(heads, starts, strict=True):
                mine = np.concatenate([[False], hit[s : s + n], [False]])
                edges = np.flatnonzero(mine[1:] != mine[:-1])
                out += [(core, eh, int(x), int(y - x)) for x, y in zip(edges[::2], edges[1::2], strict=True)]
            for k in range(0, len(out), 8192):
                columns = list(zip(*out[k : k + 8192], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["core", "eh", "first", "n"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return bodies.select("core", "eh", "times", "n", "body").mapInArrow(run, "core long, eh long, first int, n int")


def removal(texts: DataFrame, length: int) -> DataFrame:
    """(h1, h2, n_bytes, n_removed, n_spans, kept_sha256) of texts (body, copies) with runs of repeated windows (at: first, n; null for none)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, 4 << 20):
            out = []
            for text, at, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                if copies > 1 and len(raw) >= length:
                    spans = [[0, len(raw)]]
                elif at:
                    for low, high in sorted((a["first"], a["first"] + a["n"] + length - 1) for a in at):
                        if spans and low <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], high)
                        else:
                            spans.append([low, high])
                digest, done = hashlib.sha256(), 0
                for low, high in spans:
                    digest.update(raw[done:low])
                    done = high
                digest.update(raw[done:])
                out.append((len(raw), sum(high - low for low, high in spans), len(spans), digest.hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), *(pa.array(columns[k], pa.int64()) for k in range(3)), pa.array(columns[3])], ["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("body", "at", "copies", "h1", "h2").mapInArrow(run, "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_bytes(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): bytes covered by a string of `length` bytes that also starts elsewhere go."""
    scratch = Scratch(spark, "bytespans")
    docs = docs.select(F.col("doc_id"), "text")
    texts = distinct_texts(scratch, docs)
    rows = scratch.store(anchor_rows(texts, length, gram), "anchors")
    again = rows.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("ah")
    seeds = rows.join(again, "ah", "left_semi").groupBy("tid").agg(F.collect_list(F.struct("ah", "first", "n", "off")).alias("at"))
    occ = scratch.store(segments(texts.join(seeds, "tid"), length), "segments")
    scratch.drop("anchors")
    classes = scratch.store(occ.groupBy("ah", "seg").agg(F.count(F.lit(1)).alias("times"), F.any_value("n").alias("n"), F.any_value("off").alias("off"), F.any_value("bytes").alias("bytes")), "classes")
    several = classes.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("ah")
    cut = scratch.store(pieces(classes.join(several, "ah", "left_semi"), length).withColumn("eh", F.xxhash64("n", "body")), "pieces")
    bodies = cut.groupBy("core", "eh").agg(F.count(F.lit(1)).alias("times"), F.any_value("n").alias("n"), F.any_value("body").alias("body"))
    met = cut.groupBy("core").agg(F.min("eh").alias("e0"), F.max("eh").alias("e1")).where("e0 < e1").select("core")
    ends = scratch.store(bodies.join(met, "core", "left_semi"), "ends")
    size = ends.agg(F.sum(F.length("body"))).first()[0] or 0
    solved = scratch.store(repeated_places(ends.repartition(max(1, -(-size // SHARD)), "core"), PIECE_WINDOWS - 1 + NAME, scratch.root), "solved")
    alike = cut.groupBy("core", "eh").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("core", "eh", F.lit(0).alias("first"), F.lit(None).cast("int").alias("many"))
    found = cut.select("ah", "seg", "core", "eh", "begin", "n").join(solved.select("core", "eh", "first", F.col("n").alias("many")).unionByName(alike), ["core", "eh"])
    runs = found.select("ah", "seg", (F.col("begin") + F.col("first")).alias("begin"), F.coalesce("many", "n").alias("many"))
    runs = runs.unionByName(classes.where("times > 1").select("ah", "seg", F.lit(0).alias("begin"), F.col("n").alias("many")))
    covered = occ.select("ah", "seg", "tid", "first").join(runs, ["ah", "seg"]).groupBy("tid").agg(F.collect_list(F.struct((F.col("first") + F.col("begin")).alias("first"), F.col("many").alias("n"))).alias("at"))
    by_text = removal(texts.join(covered, "tid", "left"), length)
    h1, h2 = text_keys(F.col("text"))
    return docs.select("doc_id", h1, h2).join(by_text, ["h1", "h2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_bytespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op2_bytespans": op2_bytespans}
ORACLE_SQL: dict[str, str] = {}
