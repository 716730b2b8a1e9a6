"""External induced sorting of suffixes, with common-prefix values.

The suffixes of a text are sorted by induction from its leftmost-S positions: an ascending scan induces the L suffixes, a descending one the S
suffixes. Both scans are driven by a priority queue on disk that holds tuples (suffix, common prefix with its neighbour) by first symbol, in
the order of arrival within a symbol, which is the order of their ranks. Tuples move in blocks, never one at a time. The leftmost-S positions
are sorted by the same two scans over their names, recursively, until all names differ. A pushed tuple's common prefix is one more than the
least value scanned since the last push of the same symbol; only neighbours where the scan changes between L and S, and neighbouring
leftmost-S suffixes, are compared directly.

Memory: blocks of BLOCK tuples, in-memory queue ends of at most HELD tuples in all, and the pages of the memory-mapped text that are in use.
Everything else is in files of the given folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

BLOCK, HELD, RANGE = 1 << 17, 1 << 22, 1 << 12
FAR = np.iinfo(np.int64).max


class Store:
    """Spools share a budget of tuples held in memory."""

    def __init__(self, folder: str, held: int = HELD) -> None:
        self.folder, self.limit, self.held, self.spools, self.made = folder, held, 0, [], 0
        os.makedirs(folder, exist_ok=True)

    def spool(self) -> Spool:
        self.spools.append(Spool(self, f"{self.folder}/{self.made}"))
        self.made += 1
        return self.spools[-1]

    def full(self) -> None:
        if self.held > self.limit:
            for s in self.spools:
                s.flush()

    def array(self, n: int, dtype: type) -> np.ndarray:
        """A zeroed array; in a file unless small."""
        if n < self.limit // 4:
            return np.zeros(n, dtype)
        self.made += 1
        return np.memmap(f"{self.folder}/{self.made}.array", dtype, "w+", shape=(n,))


class Spool:
    """A queue of 64-bit tuples (suffix << 8 | common prefix): read from its head or, last first, from its end."""

    def __init__(self, store: Store, path: str) -> None:
        self.store, self.path, self.tail, self.head, self.on_disk, self.length = store, path, [], 0, 0, 0

    def push(self, x: np.ndarray) -> None:
        if len(x):
            self.tail.append(x)
            self.length += len(x)
            self.store.held += len(x)
            self.store.full()

    def flush(self) -> None:
        if self.tail:
            with open(self.path, "ab") as f:
                for x in self.tail:
                    x.tofile(f)
                    self.on_disk += len(x)
                    self.store.held -= len(x)
            self.tail = []

    def part(self, low: int, high: int) -> np.ndarray:
        """Tuples low to high, counted from the first ever pushed."""
        found, at = [], self.on_disk
        if low < at:
            found.append(np.fromfile(self.path, np.int64, min(high, at) - low, offset=8 * low))
        for x in self.tail:
            if at + len(x) > low and at < high:
                found.append(x[max(0, low - at) : high - at])
            at += len(x)
        return np.concatenate(found) if len(found) != 1 else found[0]

    def pop(self, n: int) -> np.ndarray:
        n = min(n, self.length - self.head)
        self.head += n
        return self.part(self.head - n, self.head) if n else np.zeros(0, np.int64)

    def close(self) -> None:
        self.store.held -= sum(map(len, self.tail))
        self.tail = []
        if self.on_disk:
            os.unlink(self.path)
        if self in self.store.spools:
            self.store.spools.remove(self)


class Minima:
    """Common prefixes of pushed tuples, from those of the scanned ones."""

    def __init__(self, sigma: int, cap: int) -> None:
        self.cap, self.since = cap, np.full(sigma, -1, np.int64)

    def pushed(self, scanned: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """scanned: values of a block; at: places in it that push; symbol: what each pushes. Returns the values of the pushed tuples."""
        out = np.zeros(len(at), np.int64)
        levels = [scanned]
        while 2 << (len(levels) - 1) <= len(scanned):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        order = np.argsort(symbol, kind="stable")
        s, p = symbol[order], at[order]
        again = np.zeros(len(s), bool)
        again[1:] = s[1:] == s[:-1]
        low = np.where(again, np.concatenate([[0], p[:-1] + 1]), 0)
        size = p + 1 - low
        level = np.frexp(size.astype(np.float64))[1] - 1
        least = np.zeros(len(s), np.int64)
        for k in np.unique(level):
            mine = level == k
            least[mine] = np.minimum(levels[k][low[mine]], levels[k][p[mine] + 1 - (1 << int(k))])
        first = ~again
        carried = self.since[s[first]]
        least[first] = np.where(carried < 0, -1, np.minimum(least[first], carried))
        out[order] = np.minimum(least + 1, self.cap)
        self.since = np.where(self.since < 0, -1, np.minimum(self.since, scanned.min()))
        last = np.concatenate([s[1:] != s[:-1], [True]])
        after = np.append(np.minimum.accumulate(scanned[::-1])[::-1], self.cap)
        self.since[s[last]] = after[p[last] + 1]
        return out

    def passed(self, scanned: np.ndarray) -> None:
        self.since = np.where(self.since < 0, -1, np.minimum(self.since, scanned.min()))


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, at most cap, of the suffixes at a and at b."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(cap):
        i, j = a[live] + k, b[live] + k
        inside = (i < len(text)) & (j < len(text))
        live, i, j = live[inside], i[inside], j[inside]
        live = live[text[i] == text[j]]
        if not len(live):
            break
        out[live] += 1
    return out


def leftmost(text: np.ndarray) -> np.ndarray:
    """Places whose suffix is smaller than the next one's while the one before is larger, with the end mark; found from right to left in blocks."""
    n, found, right_s, right_first_s = len(text), [np.array([len(text) - 1], np.int64)], True, True
    high = n - 1
    while high > 0:
        low = max(0, high - BLOCK)
        x = text[low : high + 1].astype(np.int64)
        step = np.sign(x[1:] - x[:-1])
        where = np.where(step != 0, np.arange(len(step)), len(step))
        where = np.minimum.accumulate(where[::-1])[::-1]
        s = np.where(where < len(step), step[np.minimum(where, len(step) - 1)] > 0, right_s)
        nxt = np.append(s[1:], right_first_s)
        # place i + 1 is leftmost S if it is S and place i is L
        hits = np.flatnonzero(~s & nxt) + low + 1
        found.append(hits[hits < n - 1][::-1])
        right_s = right_first_s = bool(s[0])
        high = low
    return np.concatenate(found)[::-1]


class Induction:
    """The two scans over text (its last symbol is 0 and occurs once) from sorted or unsorted seeds."""

    def __init__(self, text: np.ndarray, sigma: int, store: Store, cap: int = 0) -> None:
        self.text, self.sigma, self.store, self.cap = text, sigma, store, cap
        sizes = np.zeros(sigma, np.int64)
        for k in range(0, len(text), BLOCK):
            sizes += np.bincount(text[k : k + BLOCK], minlength=sigma)
        if cap:
            self.starts = np.arange(sigma)
        else:
            starts, held = [0], 0
            for c, n in enumerate(sizes.tolist()):
                if c > starts[-1] and held + n > RANGE:
                    starts.append(c)
                    held = 0
                held += n
            self.starts = np.array(starts)
        self.bucket = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, sigma)))
        self.ends = np.append(self.starts[1:], sigma)

    def _spread(self, queues: list[Spool], place: np.ndarray, symbol: np.ndarray, value: np.ndarray | int) -> None:
        b = self.bucket[symbol]
        order = np.argsort(b, kind="stable")
        cuts = np.flatnonzero(np.diff(b[order])) + 1
        tuples = (place << 8 | value)[order]
        for x, k in zip(np.split(tuples, cuts), b[order][np.concatenate([[0], cuts])] if len(b) else [], strict=False):
            queues[k].push(x)

    def _before(self, place: np.ndarray) -> np.ndarray:
        """The symbol before each place; -1 at the start."""
        return np.where(place > 0, self.text[np.maximum(place - 1, 0)].astype(np.int64), -1)

    def run(self, seeds: np.ndarray, values: np.ndarray | None, scanned: Callable[[np.ndarray, np.ndarray, bool], None]) -> None:
        """seeds: leftmost-S places, sorted at least by symbol; scanned gets blocks in descending order of the suffixes (places, values, whether S)."""
        many = len(self.starts)
        queues, kept = [self.store.spool() for _ in range(many)], [self.store.spool() for _ in range(many)]
        of_seed = np.searchsorted(self.starts, self.text[seeds].astype(np.int64), "right") - 1 if len(seeds) < BLOCK else np.concatenate([np.searchsorted(self.starts, self.text[seeds[k : k + BLOCK]].astype(np.int64), "right") - 1 for k in range(0, len(seeds), BLOCK)])
        cuts = np.searchsorted(of_seed, np.arange(many + 1))
        least = Minima(self.sigma, self.cap) if self.cap else None
        for b in range(many):
            low, high = cuts[b], cuts[b + 1]
            if self.ends[b] - self.starts[b] == 1:
                self._ascend_one(b, queues, kept[b], seeds, values, low, high, least)
            else:
                self._ascend_many(b, queues, kept[b], seeds[low:high])
            queues[b].close()
        queues = [self.store.spool() for _ in range(many)]
        least = Minima(self.sigma, self.cap) if self.cap else None
        for b in range(many - 1, -1, -1):
            if self.ends[b] - self.starts[b] == 1:
                self._descend_one(b, queues, kept[b], scanned, least)
            else:
                self._descend_many(b, queues, kept[b], scanned)
            queues[b].close()
            kept[b].close()

    def _ascend_one(self, b, queues, out, seeds, values, low, high, least) -> None:
        c, last = int(self.starts[b]), None
        while True:
            x = queues[b].pop(BLOCK)
            if not len(x):
                break
            out.push(x)
            place, value = x >> 8, x & 255
            last = place[-1:]
            before = self._before(place)
            at = np.flatnonzero(before >= c)
            new = least.pushed(value, at, before[at]) if least and len(at) else (least.passed(value) if least else None, 0)[1]
            self._spread(queues, place[at] - 1, before[at], new)
        for k in range(low, high, BLOCK):
            place = seeds[k : min(high, k + BLOCK)].astype(np.int64)
            before = self._before(place)
            at = np.flatnonzero(before > c)
            new: np.ndarray | int = 0
            if least:
                value = values[k : k + len(place)].astype(np.int64)
                if k == low:
                    value[0] = common(self.text, last, place[:1], self.cap)[0] if last is not None else 0
                new = least.pushed(value, at, before[at]) if len(at) else (least.passed(value), 0)[1]
            self._spread(queues, place[at] - 1, before[at], new)

    def _descend_one(self, b, queues, kept, scanned, least) -> None:
        c, last = int(self.starts[b]), None
        while True:
            x = queues[b].pop(BLOCK)
            if not len(x):
                break
            place, value = x >> 8, x & 255
            last = place[-1:]
            scanned(place, value, True)
            before = self._before(place)
            at = np.flatnonzero((before >= 0) & (before <= c))
            new = least.pushed(value, at, before[at]) if least and len(at) else (least.passed(value) if least else None, 0)[1]
            self._spread(queues, place[at] - 1, before[at], new)
        high = kept.length
        while high > 0:
            low = max(0, high - BLOCK)
            x = kept.part(low, min(kept.length, high + 1))
            place = (x >> 8)[: high - low][::-1]
            value = np.zeros(high - low, np.int64)
            if least:
                value = np.append((x & 255)[1:], 0)[: high - low][::-1].copy()
                if high == kept.length and last is not None:
                    value[0] = common(self.text, place[:1], last, self.cap)[0]
                elif high == kept.length:
                    value[0] = 0
            scanned(place, value, False)
            before = self._before(place)
            at = np.flatnonzero((before >= 0) & (before < c))
            new = least.pushed(value, at, before[at]) if least and len(at) else (least.passed(value) if least else None, 0)[1]
            self._spread(queues, place[at] - 1, before[at], new)
            high = low

    def _ascend_many(self, b, queues, out, seeds) -> None:
        place = np.concatenate([queues[b].pop(1 << 62) >> 8, seeds.astype(np.int64)])
        seed = np.zeros(len(place), np.int64)
        seed[len(place) - len(seeds) :] = 1
        end = self.ends[b]
        while len(place):
            key = self.text[place].astype(np.int64) * 2 + seed
            order = np.argsort(key, kind="stable")
            place, seed, key = place[order], seed[order], key[order]
            before = self._before(place)
            induced = before >= (key >> 1)
            least = np.minimum.accumulate(np.where(induced, before, FAR // 4))
            least = np.concatenate([[FAR // 4], least[:-1]])
            stop = np.flatnonzero(key > least * 2)
            n = int(stop[0]) if len(stop) else len(place)
            out.push(place[:n][seed[:n] == 0] << 8)
            at = np.flatnonzero(induced[:n])
            inside = before[at] < end
            new = place[at[inside]] - 1
            self._spread(queues, place[at[~inside]] - 1, before[at[~inside]], 0)
            place, seed = np.concatenate([place[n:], new]), np.concatenate([seed[n:], np.zeros(len(new), np.int64)])

    def _descend_many(self, b, queues, kept, scanned) -> None:
        large = (kept.part(0, kept.length) >> 8)[::-1] if kept.length else np.zeros(0, np.int64)
        place = np.concatenate([queues[b].pop(1 << 62) >> 8, large])
        big = np.zeros(len(place), np.int64)
        big[: len(place) - len(large)] = 1
        start = self.starts[b]
        while len(place):
            key = self.text[place].astype(np.int64) * 2 + big
            order = np.argsort(-key, kind="stable")
            place, big, key = place[order], big[order], key[order]
            before = self._before(place)
            induced = (before >= 0) & np.where(big == 1, before <= (key >> 1), before < (key >> 1))
            most = np.maximum.accumulate(np.where(induced, before, -1))
            most = np.concatenate([[-1], most[:-1]])
            stop = np.flatnonzero(key < most * 2 + 1)
            n = int(stop[0]) if len(stop) else len(place)
            for side in np.split(np.arange(n), np.flatnonzero(np.diff(big[:n])) + 1) if n else []:
                scanned(place[side], np.zeros(len(side), np.int64), bool(big[side[0]]))
            at = np.flatnonzero(induced[:n])
            inside = before[at] >= start
            new = place[at[inside]] - 1
            self._spread(queues, place[at[~inside]] - 1, before[at[~inside]], 0)
            place, big = np.concatenate([place[n:], new]), np.concatenate([big[n:], np.ones(len(new), np.int64)])


def sorted_leftmost(text: np.ndarray, sigma: int, store: Store, by_symbol: bool = False) -> np.ndarray:
    """The leftmost-S places of text in the order of their suffixes."""
    places = leftmost(text)
    m = len(places)
    if m == 1:
        return places
    induction = Induction(text, sigma, store, 1 if by_symbol else 0)
    order, filled = store.array(m, np.int64), [m]

    def take(place: np.ndarray, _: np.ndarray, small: bool) -> None:
        if small:
            found = place[(place > 0) & (text[np.maximum(place - 1, 0)] > text[place])]
            filled[0] -= len(found)
            order[filled[0] : filled[0] + len(found)] = found[::-1]

    symbols = text[places]
    induction.run(places[np.argsort(symbols, kind="stable")], np.zeros(m, np.int64) if by_symbol else None, take)
    order[0] = len(text) - 1
    assert filled[0] == 1, filled
    index = store.array(len(text), np.int32 if m < 2**31 else np.int64)
    index[places] = np.arange(m)
    rank = index[order]
    length = np.append(places[1:], len(text) - 1) - places + 1
    same = np.zeros(m, bool)
    for k in range(1, m, BLOCK):
        a, b = order[k - 1 : k + BLOCK - 1], order[k : k + BLOCK]
        b = b[: min(len(b), m - k)]
        a = a[: len(b)]
        la, lb = length[rank[k - 1 : k - 1 + len(b)]], length[rank[k : k + len(b)]]
        live, j = np.flatnonzero(la == lb), 0
        while len(live):
            live = live[text[a[live] + j] == text[b[live] + j]]
            j += 1
            over = la[live] <= j
            same[k + live[over]] = True
            live = live[~over]
    names = np.cumsum(~same) - 1
    if names[-1] == m - 1:
        return order
    inner = store.array(m, np.int32 if m < 2**31 else np.int64)
    inner[rank] = names
    found = suffix_order(inner, int(names[-1]) + 1, store)
    return places[found]


def suffix_order(text: np.ndarray, sigma: int, store: Store) -> np.ndarray:
    """All suffixes of text (last symbol 0, only there) in order."""
    seeds = sorted_leftmost(text, sigma, store)
    order, filled = store.array(len(text), np.int64), [len(text)]

    def take(place: np.ndarray, _: np.ndarray, __: bool) -> None:
        filled[0] -= len(place)
        order[filled[0] : filled[0] + len(place)] = place[::-1]

    Induction(text, sigma, store).run(seeds, None, take)
    order[0] = len(text) - 1
    assert filled[0] == 1, filled
    return order


def scan_suffixes(text: np.ndarray, sigma: int, cap: int, folder: str, scanned: Callable[[np.ndarray, np.ndarray, bool], None], held: int = HELD) -> None:
    """Call scanned(places, values, small) with all suffixes of text but the end mark, in descending order; a value is the common prefix, at most cap (below 256), with the suffix scanned before."""
    store = Store(folder, held)
    seeds = sorted_leftmost(text, sigma, store, by_symbol=True)
    values = store.array(len(seeds), np.uint8)
    for k in range(1, len(seeds), BLOCK):
        b = seeds[k : k + BLOCK]
        values[k : k + len(b)] = common(text, seeds[k - 1 : k - 1 + len(b)], b, cap)
    Induction(text, sigma, store, cap).run(seeds, values, scanned)
