"""Benchmark decontamination by latent semantic retrieval.

1. Words (lower case; letters and digits) of all documents become numbers of the benchmark's words, 0 for others, and are stored; document frequencies over
   the whole corpus give inverse-frequency weights. Words in over STOP of all documents weigh nothing.
2. Distributed randomised SVD: for passages of PASSAGE words of the whole corpus, and the benchmark's own pieces, each task adds its share of
   A^T (A omega), A the weighted passages; the sum, one row a word, gives the leading right singular vectors by a Nystroem step.
3. Search: windows of WINDOW words (of the item's length, for shorter items), every STEP words (a third of shorter windows), are compared with pieces
   (start, middle, end) of each item by cosine in the latent space. Only windows without any weighted word of the benchmark are passed over: their
   cosine is 0. Words outside the benchmark have no part in it, so neither they nor the size of the corpus hide a window.
   The least cosine is calibrated on the items themselves, with shifted windows, with a replaced word and with as many foreign words as LCS allows.
4. The longest common subsequence of the item and the stretch around the window must reach LCS of the item, and that of its answer (its last sentence)
   ANSWER. It can't be longer than the number of the stretch's words that are in the item, so stretches with fewer aren't computed: none of them could
   be accepted. Every other candidate is checked; there is no cap.

The benchmark is the stated query set: it is read in blocks of `block` items, each with its own pass, so what a task holds is bounded whatever its
size. Per-word tables and the latent space go to the tasks; they are bounded by the block's words.

Defined results. Null or empty text of a document: clean. Null or wordless item: never matches. Repeated items: each is named. Null doc_id, repeated rows:
each row has its result. Empty tables: no rows, or all clean. Other columns are not read by the search and stay in clean().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm.anchors import word_hashes
from weblode.llm.common import Scratch, arrow_batches, batches, numbered, table, utf8

PASSAGE, WINDOW, STEP, RANK = 48, 12, 4, 64
STOP, LCS, ANSWER = 0.5, 0.6, 0.5
BLOCK_ITEMS = 4096
EVERY_STEP = math.lcm(*range(1, STEP + 1))
#: Bytes of an Arrow batch: a worker holds several arrays of a batch's words at once.
BATCH = 4 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the offset of each row's first word (one more than rows)."""
    body, at = utf8(pc.utf8_lower(texts))
    full = _WORD[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(full & (edge[:-1] | np.concatenate([[True], ~full[:-1]])))
    ends = np.flatnonzero(full & (edge[1:] | np.concatenate([~full[1:], [True]]))) + 1
    return word_hashes(body, starts, ends), np.searchsorted(starts, at)


class Words:
    """Numbers 1, 2, ... of the benchmark's words, by an open table of their hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.bits = max(10, int(len(self.hashes) * 8).bit_length())
        self.table = np.zeros((1 << self.bits) + 64, np.int32)
        for k, h in enumerate((self.hashes >> np.uint64(64 - self.bits)).astype(np.int64).tolist()):
            while self.table[h]:
                h += 1
            self.table[h] = k + 1
        self.known = np.concatenate([np.zeros(1, np.uint64), self.hashes])

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out, live = np.zeros(len(h), np.int32), np.arange(len(h))
        while len(live):
            found = self.table[slot[live]]
            same = (found > 0) & (self.known[found] == h[live])
            out[live[same]] = found[same]
            live = live[(found > 0) & ~same]
            slot[live] += 1
        return out


class Items:
    """Items of a block as word numbers, their pieces and answers."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        h, at = words(pa.array(texts, pa.large_string()))
        self.words = Words(h)
        numbers = self.words(h)
        answers = [t.rstrip(" .!?\n\t") for t in texts]
        cuts = [max(t.rfind(mark) for mark in ".!?\n") for t in answers]
        count = np.diff(words(pa.array([t[c + 1 :] for t, c in zip(answers, cuts, strict=True)], pa.large_string()))[1])
        self.ids, self.rows, self.answers, self.pieces, self.of = [], [], [], [], []
        for k, i in enumerate(ids):
            row = numbers[at[k] : at[k + 1]]
            if not len(row):
                continue
            self.ids.append(i)
            self.rows.append(row)
            self.answers.append(row[len(row) - int(count[k]) :] if count[k] else row)
            for start in sorted({0, max(0, (len(row) - WINDOW) // 2), max(0, len(row) - WINDOW)}):
                self.pieces.append((start, row[start : start + WINDOW]))
                self.of.append(len(self.ids) - 1)
        self.many = len(self.words.hashes) + 1


def _step(size: int) -> int:
    """Distance of windows of so many words."""
    return max(1, min(STEP, size // 3))


def subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def tokens(docs: DataFrame, items: Items) -> DataFrame:
    """(rid, ids): the words of the texts (rid, text) as numbers."""
    use = items.words

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, 2 << 20):
            h, at = words(b.column(1).fill_null(""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(use(h)))], ["rid", "ids"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, ids array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), offsets - offsets[0]


def frequencies(stored: DataFrame, many: int) -> np.ndarray:
    """Number of documents with each word; the last is that of all documents."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(many + 1, np.int64)
        for b in frames:
            ids, at = _flat(b.column(0))
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            pair = np.sort((row * many + ids)[ids > 0])
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
            count[:many] += np.bincount(pair % many, minlength=many)
            count[many] += len(at) - 1
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["w", "n"])

    found = stored.select("ids").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(many + 1, np.int64)
    for w, n in found:
        out[w] = n
    return out


def _passages(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Starts of the passages of a row, row by row."""
    count = -(-np.diff(at) // length)
    first = np.repeat(at[:-1], count)
    return first + length * (np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count))


def _share(ids: np.ndarray, starts: np.ndarray, weight: np.ndarray, omega: np.ndarray, out: np.ndarray) -> None:
    """Add A^T (A omega) of the passages that begin at starts to out."""
    passage = np.searchsorted(starts, np.arange(len(ids)), "right") - 1
    keep = weight[ids] > 0
    w, p = ids[keep], passage[keep]
    if not len(w):
        return
    begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    y = np.add.reduceat(omega[w] * weight[w][:, None], begin)
    at = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(p))))
    order = np.argsort(w, kind="stable")
    w = w[order]
    edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    out[w[edge]] += np.add.reduceat(y[at[order]], edge) * weight[w[edge]][:, None]


def latent(stored: DataFrame, items: Items, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Rows of the leading right singular vectors for each word."""
    omega = np.random.default_rng(31).standard_normal((items.many, rank + 8)).astype(np.float32)
    light = weight.astype(np.float32)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(omega.shape, np.float32)
        for b in frames:
            every, at = _flat(b.column(0))
            starts = _passages(every, at, PASSAGE)
            for k in range(0, len(starts), 2048):
                low, high = starts[k], starts[k + 2048] if k + 2048 < len(starts) else len(every)
                _share(every[low:high], starts[k : k + 2048] - low, light, omega, out)
        some = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(out[some].astype(np.float64)), pa.list_(pa.float64()))], ["w", "y"])

    each = [F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(rank + 8)]
    y = np.zeros(omega.shape)
    for r in stored.select("ids").mapInArrow(run, "w long, y array<double>").groupBy("w").agg(*each).collect():
        y[r[0]] = r[1:]
    own = np.zeros(omega.shape, np.float32)
    rows = [piece for _, piece in items.pieces]
    _share(np.concatenate(rows), np.cumsum([0, *map(len, rows[:-1])]), light, omega, own)
    y += own * max(1.0, np.abs(y).max() / max(np.abs(own).max(), 1e-9))
    shift = 1e-6 * np.linalg.norm(y)
    y += shift * omega
    gram = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-9 * max(values.max(), 1e-9)))) @ vectors.T
    u = np.linalg.svd(y @ root, full_matrices=False)[0]
    return u[:, :rank]


class Search:
    def __init__(self, items: Items, weight: np.ndarray, space: np.ndarray) -> None:
        self.items, self.heavy = items, weight > 0
        self.rows = (space * weight[:, None]).astype(np.float32)
        self.queries = self._unit(np.stack([self.rows[p].sum(axis=0) for _, p in items.pieces]))
        self.of = np.array(items.of)
        # how often an item has a word; 255 stands for any number from there on
        self.counts = np.zeros((len(items.ids), items.many), np.uint8)
        for k, row in enumerate(items.rows):
            own, times = np.unique(row, return_counts=True)
            self.counts[k, own] = np.minimum(times, 255)
        self.counts[:, 0] = 0
        self.has = np.ascontiguousarray(self.counts.T > 0).view(np.uint8)
        self.lengths = np.array([len(row) for row in items.rows])
        self.slack = np.maximum(STEP, self.lengths // 4)
        sizes = np.array([len(piece) for _, piece in items.pieces])
        self.offsets = np.array([start for start, _ in items.pieces])
        self.classes = [(int(size), np.flatnonzero(sizes == size)) for size in np.unique(sizes)]
        self.least = self._calibrated()

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _calibrated(self) -> float:
        """The cosine that all but a hundredth of the items' windows reach with their nearest piece, when shifted by half a step and with one word replaced, or with foreign words for the share that LCS allows."""
        rng, swap, found = np.random.default_rng(37), np.random.default_rng(41), []
        for k, row in enumerate(self.items.rows):
            mine = self.queries[self.of == k]
            for start, piece in (p for p, o in zip(self.items.pieces, self.of, strict=True) if o == k):
                half = _step(len(piece)) // 2
                for move in (-half, 0, half):
                    window = row[max(0, start + move) : max(0, start + move) + WINDOW].copy()
                    if len(window) < len(piece) - half:
                        continue
                    foreign = window.copy()
                    foreign[swap.permutation(len(window))[: int((1 - LCS) * len(window))]] = 0
                    window[rng.integers(len(window))] = rng.integers(self.items.many)
                    found.append([float((mine @ self._unit(self.rows[x].sum(axis=0)[None, :])[0]).max()) for x in (window, foreign)])
        return float(max(0.3, np.quantile(found, 0.01, axis=0).min())) if found else 1.0

    def _sums(self, ids: np.ndarray, starts: np.ndarray, size: int, step: int) -> np.ndarray:
        """Latent rows of the windows that begin at starts, multiples of step. Runs of step words are summed once for all windows that share them."""
        runs, rest = divmod(size, step)
        first, last = int(starts[0]), int(starts[-1]) + (runs + 1) * step
        part = np.zeros(last - first, ids.dtype)
        part[: max(0, len(ids) - first)] = ids[first:last]
        each = self.rows[part[::step]]
        for j in range(1, step):
            each += self.rows[part[j::step]]
        k = (starts - first) // step
        out = each[k]
        for j in range(1, runs):
            out += each[k + j]
        for j in range(rest):
            out += self.rows[part[(k + runs) * step + j]]
        return out

    def _hits(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray) -> np.ndarray:
        """At least as many words of ids[low:high] as are words of the item `of`: those of the runs of STEP words that the stretch touches."""
        first, last = int(low.min()) // STEP, -(-int(high.max()) // STEP)
        if (last - first) * STEP * len(self.items.ids) > 1 << 24:
            return high - low
        part = np.zeros((last - first) * STEP, ids.dtype)
        there = ids[first * STEP : last * STEP]
        part[: len(there)] = there
        each = self.has[part[::STEP]]
        for j in range(1, STEP):
            each += self.has[part[j::STEP]]
        upto = np.zeros((last - first + 1, len(self.items.ids)), np.int32)
        np.cumsum(each, axis=0, out=upto[1:])
        return upto[-(-high // STEP) - first, of] - upto[low // STEP - first, of]

    def _may_reach(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which of the items `of` have enough of their words in ids[low:high] to reach LCS there, each word as often as the item has it."""
        out = np.zeros(len(of), bool)
        sizes = high - low
        ends = np.cumsum(sizes)
        at = 0
        while at < len(of):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + (1 << 20), "right")))
            size, item = sizes[at:to], of[at:to]
            which = np.repeat(np.arange(to - at), size)
            word = ids[np.arange(len(which)) + np.repeat(low[at:to] - np.cumsum(size) + size, size)]
            inside = self.counts[item[which], word] > 0
            which, word = which[inside], word[inside]
            enough = np.bincount(which, minlength=to - at) / self.lengths[item] >= LCS
            some = enough[which]
            key = np.sort(which[some] * self.items.many + word[some])
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            which, word = np.divmod(key[edge], self.items.many)
            there, own = np.diff(np.append(edge, len(key))), self.counts[item[which], word]
            shared = np.bincount(which, np.where(own == 255, there, np.minimum(there, own)), to - at)
            out[at:to] = enough & (shared / self.lengths[item] >= LCS)
            at = to
        return out

    def _places(self, laid: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(row, item, begin) of the stretches to be checked in documents of those lengths that are laid out from those places on, with zeros between."""
        heavy = np.concatenate([[0], np.cumsum(self.heavy[laid])])
        longest = int(self.lengths.max())
        wide, every, found = longest + int(lengths.max(initial=0)) + 1, len(self.items.ids), []
        for size, pieces in self.classes:
            step, queries = _step(size), self.queries[pieces].T
            count = -(-np.maximum(1, lengths - size + step) // step)
            starts = np.repeat(places, count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            starts = starts[heavy[starts + size] > heavy[starts]]
            many = max(1, (1 << 18) // len(pieces))
            for k in range(0, len(starts), many):
                some = starts[k : k + many]
                near = np.flatnonzero(self._unit(self._sums(laid, some, size, step)) @ queries >= self.least)
                if len(near):
                    w, q = np.divmod(near, len(pieces))
                    of, row = self.of[pieces][q], np.searchsorted(places, some, "right")[w] - 1
                    begin, from_ = some[w] - self.offsets[pieces][q], places[row]
                    low = np.maximum(begin - self.slack[of], from_)
                    high = np.clip(begin + self.lengths[of] + self.slack[of], from_, from_ + lengths[row])
                    able = np.flatnonzero(self._hits(laid, low, high, of) >= LCS * self.lengths[of] - 0.5)
                    _, first = np.unique((row[able] * every + of[able]) * wide + begin[able] - from_[able] + longest, return_index=True)
                    able = able[first]
                    able = able[self._may_reach(laid, low[able], high[able], of[able])]
                    found.append((row[able] * every + of[able]) * wide + begin[able] - from_[able] + longest)
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.stack([key // wide // every, key // wide % every, key % wide - longest], axis=1)

    def __call__(self, ids: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """Items in documents, as (row, item_id, share of the longest common subsequence); ids[at[r] : at[r + 1]] are the word numbers of row r."""
        if len(at) < 2 or not self.items.ids:
            return []
        # all documents are searched at once: each begins at a multiple of every step, and the zeros after it are as many as a window can reach past its end
        lengths = np.diff(at)
        room = -(-(lengths + WINDOW + 2 * STEP) // EVERY_STEP) * EVERY_STEP
        places = np.cumsum(room) - room
        laid = np.zeros(int(room.sum()), ids.dtype)
        laid[np.arange(len(ids)) + np.repeat(places - at[:-1], lengths)] = ids
        best: dict[tuple[int, int], float] = {}
        for row, item, begin in self._places(laid, places, lengths).tolist():
            own, answer, most, slack = self.items.rows[item], self.items.answers[item], best.get((row, item), 0.0), int(self.slack[item])
            part = ids[at[row] + max(0, begin - slack) : at[row] + min(max(0, begin + len(own) + slack), int(lengths[row]))]
            share = subsequence(own, part) / len(own)
            if share > most and share >= LCS and subsequence(answer, part) >= ANSWER * len(answer):
                best[row, item] = share
        return [(row, self.items.ids[item], share) for (row, item), share in best.items()]


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Stored rows (rid, doc) of docs, and (rid, item_id, share) of the items found in them."""
    scratch = Scratch(spark, "leaks")
    rows = numbered(scratch, docs)
    cast = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    places = cast.orderBy("item_id", "text")
    count, found = cast.count(), []
    with arrow_batches(spark, BATCH):
        for k in range(0, count, block):
            some = places.offset(k).limit(block).collect()  # a block of the stated query set
            items = Items([r["item_id"] for r in some], [r["text"] for r in some])
            if not items.ids:
                continue
            stored = scratch.store(tokens(rows.select("rid", F.col("doc.text").alias("text")), items), f"tokens{k}")
            n = frequencies(stored, items.many)
            share = n[:-1] / max(1, n[-1])
            weight = np.where(share > STOP, 0.0, np.log((n[-1] + 1) / (n[:-1] + 0.5)))
            weight[0] = 0.0
            search = Search(items, weight, latent(stored, items, weight))

            def run(frames: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
                for b in frames:
                    every, at = _flat(b.column(1))
                    rids = b.column(0).to_numpy()
                    out = [(int(rids[r]), item, share) for r, item, share in search(every, at)]
                    columns = list(zip(*out, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["rid", "item_id", "share"])

            found.append(scratch.store(stored.select("rid", "ids").mapInArrow(run, "rid long, item_id long, share double"), f"found{k}"))
            scratch.drop(f"tokens{k}")
    if not found:
        return rows, rows.sparkSession.createDataFrame([], "rid long, item_id long, share double")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return rows, every


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item."""
    rows, found = leaks(spark, docs, benchmark)
    return rows.join(found.select("rid").distinct(), "rid", "left_anti").select("doc.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = leaks(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    each = found.groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
    out = rows.select("rid", F.col("doc.doc_id").alias("doc_id")).join(each, "rid", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE_SQL: dict[str, str] = {}
