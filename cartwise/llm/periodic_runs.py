"""Runs of periodic words in texts, and texts without their repetitions.

A run is a stretch of consecutive words whose smallest period q occurs four times
or more (and that has six words at least), as long as it can be.  Runs are found
by longest common extensions: Ukkonen's suffix trees of the words and of their
reversal, with the Euler tour's range minima for the depth of two leaves' lowest
common ancestor.  The root of every run occurs in it as a longest Lyndon word
under one of two opposite orders of the words; each such word that the tree's
leaf order gives is extended in both directions.

Trees are built where a run can lie only.  In a run of period q every word, and
every eight words in a row where q is eight or more, stood at most q places
before; stretches of such places that are long enough for their q, widened by q,
hold every run whole.  This cut loses nothing and decides no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bound, ship_package, slices_by_bytes
from .text_bytes import column_bytes, mix

LEAST_WORDS = 6
LEAST_TIMES = 4
GRAM = 8                        # words in a row that tell long periods apart
SCALE = 1.15                    # periods looked for together differ by this factor
SLICE_BYTES = 1 << 21
FAR = np.iinfo(np.int64).max


class SuffixTree:
    """Suffix tree of a list of numbers from 1 up (Ukkonen), with depths of
    lowest common ancestors in constant time."""

    def __init__(self, numbers: list[int]):
        s = [*numbers, 0]                       # the end is smaller than every word
        self.n, self.base = len(s), max(s) + 1
        self._grow(s)
        self._tour()

    def _grow(self, s: list[int]) -> None:
        n, base = self.n, self.base
        start, end, link, leaves = [0], [0], [0], []
        child: dict[int, int] = {}
        node = edge = length = pending = 0
        for i in range(n):
            c, new = s[i], 0
            pending += 1
            while pending:
                if not length:
                    edge = i
                key = node * base + s[edge]
                below = child.get(key)
                if below is None:
                    leaves.append(len(start))
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if new:
                        link[new] = node
                        new = 0
                else:
                    size = (end[below] if end[below] <= i else i + 1) - start[below]
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if s[start[below] + length] == c:
                        length += 1
                        if new:
                            link[new] = node
                        break
                    split = len(start)
                    leaves.append(split + 1)
                    start += (start[below], i)
                    end += (start[below] + length, n)
                    link += (0, 0)
                    child[key] = split
                    child[split * base + c] = split + 1
                    start[below] += length
                    child[split * base + s[start[below]]] = below
                    if new:
                        link[new] = split
                    new = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.sizes = np.array(end, np.int64) - np.array(start, np.int64)
        self.leaves = np.array(leaves, np.int64)    # of the suffixes, by their start
        # children by parent, then symbol
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.kids = np.fromiter(child.values(), np.int64, len(child))[order]
        self.firsts = np.searchsorted(keys[order], np.arange(len(start) + 1) * base)

    def _tour(self) -> None:
        """The Euler tour, of which only the visits of a node between two of its
        children are kept: the least of those between two leaves is their lowest
        common ancestor's depth."""
        kids, firsts, sizes = self.kids.tolist(), self.firsts.tolist(), self.sizes.tolist()
        depth, tour, order, stack = [0] * len(sizes), [], [], [0]
        while stack:
            v = stack.pop()
            if v < 0:                           # between two children
                tour.append(depth[~v])
                continue
            first, last = firsts[v], firsts[v + 1]
            if first == last:
                order.append(v)
                continue
            d = depth[v]
            if last - first == 2:
                a, b = kids[first], kids[first + 1]
                depth[a], depth[b] = d + sizes[a], d + sizes[b]
                stack += (b, ~v, a)
                continue
            for k in range(last - 1, first - 1, -1):
                a = kids[k]
                depth[a] = d + sizes[a]
                stack.append(a)
                if k > first:
                    stack.append(~v)
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(self.n)
        self.rank = rank[self.leaves]           # of the suffixes, the end's is 0
        self.minima = [np.array(tour, np.int32)]
        while 2 << (len(self.minima) - 1) <= len(tour):
            half = 1 << (len(self.minima) - 1)
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-half], low[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at i and j (i != j)."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            x = level == k
            row = self.minima[k]
            out[x] = np.minimum(row[low[x]], row[high[x] - (1 << int(k))])
        return out


def lyndon_ends(ranks: list[int]) -> np.ndarray:
    """For each suffix where its longest Lyndon word ends: the next suffix of a
    smaller rank (or one beyond the last)."""
    out, open_ = [len(ranks)] * len(ranks), []
    for i, r in enumerate(ranks):
        while open_ and ranks[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of(numbers: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of numbers from 1 up."""
    n = len(numbers)
    if n < LEAST_WORDS:
        return []
    tree = SuffixTree(numbers)
    at, to, right = [], [], []
    for ranks in (tree.rank, n - tree.rank):        # both orders of the words
        j = lyndon_ends(ranks.tolist())
        i = np.arange(n + 1)
        some = (j < n) & (LEAST_TIMES * (j - i) <= n)
        i, j = i[some], j[some]
        more = tree.common(i, j)
        # a run has such a word among its first q places, and so 2 q words behind it
        deep = more >= (LEAST_TIMES - 2) * (j - i)
        at.append(i[deep])
        to.append(j[deep])
        right.append(more[deep])
    i, j, more = map(np.concatenate, (at, to, right))
    if not len(i):
        return []
    del tree
    less = SuffixTree(numbers[::-1]).common(n - i, n - j)
    period, start = j - i, i - less
    length = j + more - start
    ok = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    return sorted(set(zip(start[ok].tolist(), length[ok].tolist(), period[ok].tolist())))


def _distance(keys: np.ndarray) -> np.ndarray:
    """How far before each place its key stood last (FAR if nowhere).  Keys that
    agree in the bits left beside a place's number count as equal."""
    n = len(keys)
    bits = max(1, int(n - 1).bit_length())
    both = np.sort((keys.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    place = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    both >>= np.uint64(bits)
    same = both[1:] == both[:-1]
    out = np.full(n, FAR)
    out[place[1:][same]] = (place[1:] - place[:-1])[same]
    return out


def _stretches(z: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the gaps of ``least`` places or more between the places z."""
    edge = np.concatenate([[-1], z, [n]])
    k = np.flatnonzero(np.diff(edge) > least)
    return edge[k] + 1, edge[k + 1]


def windows(keys: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of disjoint stretches that hold every run whole.  ``keys`` are
    words of texts one after the other, of which no two texts share one, and
    ``longest`` is the number of words of the longest text."""
    n, begins, ends = len(keys), [], []
    if n < LEAST_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = _distance(keys)
    z = np.arange(n)
    for q in range(1, min(GRAM, longest // LEAST_TIMES + 1)):
        z = z[d[z] > q]
        b, e = _stretches(z, n, max(LEAST_WORDS - q, (LEAST_TIMES - 1) * q))
        begins.append(b - q)
        ends.append(e)
    if longest >= LEAST_TIMES * GRAM:
        with np.errstate(over="ignore"):
            h, k = mix(keys.astype(np.uint64) + np.uint64(1)), 1
            while k < GRAM:
                h = mix(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
                k *= 2
        d = _distance(h)
        need = (LEAST_TIMES - 1) * GRAM - (GRAM - 1)
        b, e = _stretches(np.flatnonzero(d == FAR), len(d), need)
        # the places of those stretches, each followed by one that ends it
        sizes = e - b + 1
        where = np.repeat(b - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        d = np.where(where < len(d), d[np.minimum(where, len(d) - 1)], FAR)
        z, low = np.arange(len(d)), GRAM
        while low <= longest // LEAST_TIMES and len(d):
            high = int(low * SCALE)
            z = z[d[z] > high]
            b, e = _stretches(z, len(d), (LEAST_TIMES - 1) * low - (GRAM - 1))
            begins.append(where[b] - high)
            ends.append(where[e - 1] + GRAM)
            low = high + 1
    b, e = np.concatenate(begins), np.concatenate(ends)
    if not len(b):
        return b.astype(np.int64), e.astype(np.int64)
    order = np.argsort(b, kind="stable")
    b, e = np.maximum(b[order], 0), np.minimum(e[order], n)
    reach = np.maximum.accumulate(e)
    first = np.concatenate([[True], b[1:] >= reach[:-1]])
    return b[first], reach[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(b) - 1]])]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words, by start and period."""
    code: dict[bytes, int] = {}
    for t in texts:
        for w in set(t).difference(code):
            code[w] = len(code)
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    numbers = np.empty(int(firsts[-1]), np.int64)
    for t, a, b in zip(texts, firsts[:-1], firsts[1:]):
        numbers[a:b] = np.fromiter(map(code.__getitem__, t), np.int64, len(t))
    owner = np.repeat(np.arange(len(texts)), sizes)
    out: list[list] = [[] for _ in texts]
    found = windows(owner * (len(code) + 1) + numbers, int(sizes.max(initial=0)))
    for b, e in zip(*found):
        # a window may reach into the texts beside its own
        for k in range(owner[b], owner[e - 1] + 1):
            a, z = max(b, firsts[k]), min(e, firsts[k + 1])
            if z - a >= LEAST_WORDS:
                _, small = np.unique(numbers[a:z], return_inverse=True)
                out[k] += [(int(a - firsts[k]) + s, n, q)
                           for s, n, q in runs_of((small + 1).tolist())]
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equal ones the first by
    start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        depth[s + q] += 1
        depth[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


RUN = "struct<start:long,length:long,period:long>"


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length,
    period, by start and period), best (the run of the greatest length / period,
    null if none) and collapsed (the words that no run holds after its first
    period, joined by one space).

    Words are what stands between blanks and the characters 9 to 13.  A null text
    has no words: no runs, an empty collapsed text.  Rows keep their null or
    repeated ids; other columns are not read; no shuffle.  A task holds about
    2 MB of texts (one whole text at least) and the trees of one window: about
    1 KB a word of the longest stretch that may be periodic, and some 150 bytes
    a word of the texts.
    """
    ship_package(df.sparkSession)
    arrow_bound(df.sparkSession)
    narrow = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = T.StructType([
        narrow.schema["doc_id"], T.StructField("n_words", T.LongType()),
        T.StructField("runs", T._parse_datatype_string(f"array<{RUN}>")),
        T.StructField("best", T._parse_datatype_string(RUN)),
        T.StructField("collapsed", T.StringType())])

    def search(batches):
        import pyarrow as pa

        run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        named = lambda r: dict(zip(("start", "length", "period"), r)) if r else None
        for b in slices_by_bytes(batches, 1, SLICE_BYTES):
            data, ends = column_bytes(b.column(1))
            texts = [data[s:e].tobytes().split() for s, e in zip(ends[:-1], ends[1:])]
            runs = runs_of_texts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([[named(r) for r in x] for x in runs], pa.list_(run)),
                 pa.array([named(strongest(x)) for x in runs], run),
                 pa.array([b" ".join(without_repeats(t, x)).decode("utf-8", "replace")
                           for t, x in zip(texts, runs)], pa.string())],
                names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return narrow.mapInArrow(search, schema)


def with_planted_runs(df: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The texts in which the check's periods are planted: doc_id, text.

    With h the CRC of the id's decimal text and g = floor(h / 10), a text of n > 0
    words changes if h % 10 = 0: each word i >= a becomes word a + (i - a) % p,
    with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).  A row without an id
    stays as it is.
    """
    # the split is made once a row: a generator keeps the parts from being merged
    parts = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"),
                      F.crc32(df[id_col].cast("string").cast("binary")).alias("__h"))
    parts = parts.withColumn("__g", F.floor(F.col("__h") / 10))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    some = F.when(F.col("__h") % 10 == 0, words)
    w = parts.select("doc_id", "text", "__g", F.explode(F.array(some)).alias("__w"))
    n = F.size("__w")
    w = w.withColumn("__a", F.when(n > 0, F.col("__g") % n).cast("int"))
    left = n - F.col("__a")
    w = w.withColumn("__p", (1 + F.floor(left / (3 + F.col("__g") % 8))).cast("int"))
    times = F.ceil(left / F.col("__p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")),
                                             times)), F.lit(1), left)
    made = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), again), " ")
    return w.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_runs``: doc_id, n_runs, the best run's start,
    length, period and exponent_milli (nulls if none), runs_sha256 and
    collapsed_sha256."""
    line = lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"),
        best.length.alias("length"), best.period.alias("period"),
        F.floor(1000 * best.length / best.period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256)
        .alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
