"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is a batch of documents in a task. Its suffix array has, in word order, the suffixes that can hold a window of
the benchmark: those that start with a run of benchmark words as long as the shortest window. Every suffix of the
benchmark is binary-searched in every shard; its range gives all places that agree for a whole window. From these the
matches are lengthened as far as document and item agree, by a suffix array of the items over whole windows, which
gives the longest verbatim matches and where they lie in both. Documents stay where they are: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scenegrain.llm.chunks import release
from scenegrain.llm.heap_bpe import batches
from scenegrain.llm.rows import free_names
from scenegrain.sources.tables import save

N = 13
#: Bytes to blanks: all ASCII but digits and letters; A-Z to a-z; bytes of other characters stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


class Bench:
    """A block of the benchmark: its words, windows and suffixes, for a broadcast of bounded size.

    Besides the windows in word order it holds a suffix array of its items, read as sequences of full windows, and for each
    power of two the rank of every run of so many windows, by which suffixes are compared far beyond one window.
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int = N):
        self.n, self.vocab, rows, owners, starts = n, {}, [], [], []
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            w = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in words(text)], np.int64)
            if size := min(n, len(w)):
                own = np.lib.stride_tricks.sliding_window_view(w, size)
                rows.append(np.pad(own, ((0, 0), (0, n - size))))
                owners.append(np.full(len(own), k))
                starts.append(np.arange(len(own)))
        table = np.concatenate(rows) if rows else np.zeros((0, n), np.int64)
        owner, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, starts))
        windows, inverse = np.unique(table, axis=0, return_inverse=True)
        self.windows, inverse = windows.astype(np.int32), inverse.reshape(-1)
        order = np.argsort(inverse, kind="stable")
        self.owners, self.owner_starts = owner[order], start[order]
        self.starts = np.searchsorted(inverse[order], np.arange(len(self.windows) + 1))
        self.sizes = (self.windows > 0).sum(1)
        self.bits = max(1, len(self.vocab).bit_length())
        top = np.where(windows > 0, windows, (1 << self.bits) - 1)
        self.low, self.high = self.keys(windows), self.keys(top)
        self.shortest = int(self.sizes.min()) if len(self.sizes) else n
        self.arrange(inverse, owner, start)

    def arrange(self, window: np.ndarray, owner: np.ndarray, start: np.ndarray) -> None:
        """The suffix array over the full windows of all items, by doubling; a 0 ends each item."""
        full = self.sizes[window] == self.n if len(window) else np.zeros(0, bool)
        window, owner, start = window[full], owner[full], start[full]
        at = np.arange(len(window)) + np.cumsum(np.concatenate(([0], owner[1:] != owner[:-1]))) if len(window) else np.zeros(0, np.int64)
        rank = np.zeros(int(at[-1]) + 2 if len(at) else 1, np.int64)
        self.place = np.zeros((len(rank), 2), np.int64)  # item and word of each suffix
        rank[at] = window + 1
        self.place[at] = np.stack([owner, start], 1)
        self.ranks, self.pairs = [rank], []
        longest = int(np.bincount(owner).max()) if len(owner) else 0
        for k in range(longest.bit_length()):
            # Pairs of ranks of 2**k windows are the runs of 2**(k+1); what reaches over the end goes on with 0.
            pair = (rank << 32) | np.concatenate((rank[1 << k :], np.zeros(min(1 << k, len(rank)), np.int64)))
            known, rank = np.unique(pair, return_inverse=True)
            self.pairs.append(known)
            rank = rank.reshape(-1)
            self.ranks.append(rank)
        self.array = np.argsort(rank, kind="stable")

    def keys(self, rows: np.ndarray) -> list[np.ndarray]:
        """The n words of each row, packed into as few integers as hold them, in order."""
        per = 62 // self.bits
        out = []
        for s in range(0, self.n, per):
            k = np.zeros(len(rows), np.int64)
            for c in range(s, min(self.n, s + per)):
                k = (k << self.bits) | rows[:, c]
            out.append(k)
        return out


def bound(keys: list[np.ndarray], query: list[np.ndarray], right: bool) -> np.ndarray:
    """Where each query would go in the sorted keys: binary search of all queries at once."""
    lo = np.zeros(len(query[0]), np.int64)
    hi = np.full(len(query[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) >> 1, 0)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, q in zip(keys, query):
            x = k[mid]
            less |= same & (x < q)
            same &= x == q
        go = open_ & (less | same if right else less)
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


def occurrences(bench: Bench, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, position, offsets of the documents) for every place in the shard that holds a window."""
    sizes = np.array([len(d) for d in docs], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))  # a blank after each document
    ids = np.zeros(int(offsets[-1]) + bench.n, np.int64)
    get = bench.vocab.get
    for d, o in zip(docs, offsets):
        if d:
            ids[o : o + len(d)] = [get(w, 0) for w in d]
    none = (np.zeros(0, np.int64),) * 2
    if not len(bench.windows):
        return *none, offsets
    blank = np.flatnonzero(ids == 0)
    at = np.flatnonzero(ids)
    run = blank[np.searchsorted(blank, at)] - at
    at = at[run >= bench.shortest]
    if not len(at):
        return *none, offsets
    run = blank[np.searchsorted(blank, at)] - at
    cells = ids[at[:, None] + np.arange(bench.n)]
    cells *= np.arange(bench.n) < run[:, None]
    keys = bench.keys(cells)
    array = np.lexsort(keys[::-1])  # the suffix array
    keys = [k[array] for k in keys]
    lo, hi = bound(keys, bench.low, False), bound(keys, bench.high, True)
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return window, at[array[place]], offsets


def lengthened(bench: Bench, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, item, word of the item) of the longest match with this block that starts at each place of a full
    window, by place; of equal ones, the first in the benchmark. All places are searched in the suffix array at once: for
    each power of two, from the largest, the range of suffixes that agree so far is cut to those that go on alike."""
    order = np.argsort(place, kind="stable")
    window, place = window[order], place[order]
    follows = np.concatenate((place[1:] == place[:-1] + 1, [False])) if len(place) else np.zeros(0, bool)
    ends = np.flatnonzero(~follows)
    left = ends[np.searchsorted(ends, np.arange(len(place)))] - np.arange(len(place)) + 1  # places to the end of the run
    ranks = [window + 1]
    for k, known in enumerate(bench.pairs):  # ranks of the runs of 2**(k+1) places, -1 where the benchmark has none
        here, then = ranks[k], np.concatenate((ranks[k][1 << k :], np.full(min(1 << k, len(place)), -1)))
        pair = (here << 32) | np.maximum(then, 0)
        at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        ranks.append(np.where((here >= 0) & (then >= 0) & (left >= 2 << k) & (known[at] == pair), at, -1))
    lo, hi, length = np.zeros(len(place), np.int64), np.full(len(place), len(bench.array)), np.zeros(len(place), np.int64)
    for k in reversed(range(len(ranks))):
        at = np.arange(len(place)) + length
        some = np.flatnonzero((at < len(place)) & (left - length >= 1 << k))
        want = ranks[k][at[some]]
        some, want = some[want >= 0], want[want >= 0]
        first = narrowed(bench, k, lo[some], hi[some], length[some], want, False)
        last = narrowed(bench, k, first, hi[some], length[some], want, True)
        more = first < last
        some, first, last = some[more], first[more], last[more]
        lo[some], hi[some] = first, last
        length[some] += 1 << k
    where = bench.place[first_of(bench.array, lo, hi)] if len(place) else np.zeros((0, 2), np.int64)
    return place, place + length + bench.n - 1, where[:, 0], where[:, 1]


def narrowed(bench: Bench, k: int, lo: np.ndarray, hi: np.ndarray, length: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Where in [lo, hi) of the suffix array the next 2**k windows of the suffixes reach (right: exceed) a rank."""
    rank = bench.ranks[k]
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) >> 1, 0)
        x = rank[np.minimum(bench.array[mid] + length, len(rank) - 1)]
        go = open_ & (x <= want if right else x < want)
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def first_of(array: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least entry of each non-empty range of an array, from minima of ranges of powers of two."""
    minima, out = array, np.zeros(len(lo), np.int64)
    level = np.frexp(hi - lo)[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(minima[lo[own]], minima[hi[own] - (1 << k)])
        step = 1 << k
        minima = np.minimum(minima, np.concatenate((minima[step:], np.full(min(step, len(minima)), len(array)))))
    return out


def longest_matches(bench: Bench, window: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows (start, end, item, word of the item): places in the shard that agree with the block word by word and can't be
    lengthened, by start. Items of less than a window match as a whole."""
    full = bench.sizes[window] == bench.n
    short, at = window[~full], place[~full]
    parts = [np.stack(lengthened(bench, window[full], place[full]), 1), np.stack([at, at + bench.sizes[short], bench.owners[bench.starts[short]], np.zeros(len(at), np.int64)], 1)]
    return np.concatenate(parts)


def outermost(rows: np.ndarray) -> np.ndarray:
    """The rows (start, end, ...) that no other row contains; of those with an equal start and end the first."""
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0]))]
    before = np.concatenate(([-1], np.maximum.accumulate(rows[:, 1])[:-1])) if len(rows) else rows[:, 1]
    return rows[rows[:, 1] > before]


def judge(benches: list[Bench], texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[int, int]], np.ndarray]]:
    """(n_words, n_hit, items, matches) of each text over all blocks; items are (block, number), a match is (start, end,
    block, item, word of the item)."""
    docs = [words(t) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs]))).astype(np.int64)
    mark, items, matches = np.zeros(int(offsets[-1]) + N + 1, np.int64), [set() for _ in docs], []
    for b, bench in enumerate(benches):
        window, place, _ = occurrences(bench, docs)
        np.add.at(mark, place, 1)
        np.add.at(mark, place + bench.sizes[window], -1)
        owner = np.searchsorted(offsets, place, "right") - 1
        for i, w in np.unique(np.stack([owner, window], 1), axis=0).tolist():
            items[i].update((b, k) for k in bench.owners[bench.starts[w] : bench.starts[w + 1]].tolist())
        m = longest_matches(bench, window, place)
        matches.append(np.insert(m, 2, b, axis=1))
    hit = np.cumsum(mark) > 0
    found = outermost(np.concatenate(matches))
    cut = np.searchsorted(found[:, 0], offsets)
    for i, d in enumerate(docs):
        own = found[cut[i] : cut[i + 1]].copy()
        own[:, :2] -= offsets[i]
        yield len(d), int(hit[offsets[i] : offsets[i] + len(d)].sum()), sorted(items[i]), own


FOUND = "n_words long, n_hit long, items array<string>, matches array<struct<start:int,end:int,item:string,item_start:int>>"


def found(blocks: list[Broadcast], text: Column) -> Column:
    """Struct of FOUND for each text; matches are the longest verbatim ones, in words, with a place in the benchmark."""

    @pandas_udf(FOUND)
    def look(s: pd.Series) -> pd.DataFrame:
        rows, benches = [], [b.value for b in blocks]
        for part in batches([t if t is not None else "" for t in s], 4_000_000):
            for n, h, items, m in judge(benches, part):
                at = [{"start": a, "end": e, "item": benches[b].items[k], "item_start": w} for a, e, b, k, w in m.tolist()]
                rows.append((n, h, [benches[b].items[k] for b, k in items], at))
        release()
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "matches"])

    return look(text)


def bench_blocks(benchmark: DataFrame, max_bytes: int = 1_000_000, id_col: str = "item_id", text_col: str = "text") -> list[Broadcast]:
    """The benchmark in blocks of bounded size, each sent to the executors by a broadcast of its own.

    Items come to the driver one by one in order of their ids and a block is closed when it holds `max_bytes` of text (an
    item that is longer is a block of its own). The driver keeps a block only while it is built: broadcasts lie in files.
    Python workers hold about 50 bytes for each byte of the blocks that they search (see with_matches).
    """
    block, size, out = [], 0, []
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").orderBy("i", "t")
    send = benchmark.sparkSession.sparkContext.broadcast
    for r in rows.toLocalIterator():
        more = len(r.t.encode("utf-8", "replace"))
        if block and size + more > max_bytes:
            out.append(send(Bench(block)))
            block, size = [], 0
        block.append((r.i, r.t))
        size += more
    return [*out, send(Bench(block))]


HITS = "items array<string>, matches array<struct<start:int,end:int,item:string,item_start:int>>"
#: What doesn't belong to a word, of texts in whatever case.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def hits(blocks: list[Broadcast], d: DataFrame) -> DataFrame:
    """row and HITS of the rows of `d` (row, text) that hold a window of these blocks."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        benches = [b.value for b in blocks]
        for pdf in parts:
            rows, at = [], 0
            for some in batches([t if t is not None else "" for t in pdf.text], 4_000_000):
                for k, (_, n, items, m) in zip(pdf.row.iloc[at:], judge(benches, some)):
                    if n:
                        own = [{"start": a, "end": e, "item": benches[b].items[i], "item_start": w} for a, e, b, i, w in m.tolist()]
                        rows.append((k, [benches[b].items[i] for b, i in items], own))
                at += len(some)
            yield pd.DataFrame(rows, columns=["row", "items", "matches"])
        release()

    return d.mapInPandas(look, f"row long, {HITS}")


def widest(matches: Column) -> Column:
    """The matches of several groups of blocks without those within another."""

    @pandas_udf("array<struct<start:int,end:int,item:string,item_start:int>>")
    def keep(s: pd.Series) -> pd.Series:
        out = []
        for found in s:
            rows = np.array([(m["start"], m["end"], k) for k, m in enumerate(found)], np.int64).reshape(-1, 3)
            out.append([found[k] for k in outermost(rows)[:, 2]])
        return pd.Series(out)

    return keep(matches)


def with_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_bytes: int = 1_000_000, out: str = "_found", held: int = 8_000_000
) -> DataFrame:
    """`docs` with a struct column of FOUND over all blocks of the benchmark.

    A task searches blocks of `held` bytes of the benchmark at most (one item at least), whatever its size. If that is all,
    documents stay where they are. A larger benchmark is cut into groups of blocks, each a pass over the written texts with
    tasks of its own; only documents with hits meet again, by a number of their row.
    """
    blocks = bench_blocks(benchmark, max_bytes)
    per = max(1, held // max_bytes)
    groups = [blocks[k : k + per] for k in range(0, len(blocks), per)]
    if len(groups) == 1:
        return docs.withColumn(out, found(blocks, F.col(text_col)))
    (key,) = free_names(docs, "row")
    docs = save(docs.withColumn(key, F.monotonically_increasing_id()), "texts")
    texts = docs.select(F.col(key).alias("row"), F.col(text_col).alias("text"))
    some = hits(groups[0], texts)
    for g in groups[1:]:
        some = some.union(hits(g, texts))
    some = some.groupBy(F.col("row").alias("_of")).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "matches")))
    # Matches cover all words that are hit: the length of their union, from left to right.
    step = lambda at, m: F.struct(
        F.greatest(at["end"], m["end"]).alias("end"), (at["n"] + F.greatest(F.lit(0), m["end"] - F.greatest(at["end"], m["start"]))).alias("n")
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    n_hit = F.aggregate(F.array_sort("matches"), zero, step, lambda at: at["n"].cast("long"))
    some = save(some.select("_of", n_hit.alias("n_hit"), "items", widest(F.col("matches")).alias("matches")), "hits")
    # Row numbers and hits under one name, so that no column of the documents is hidden.
    some = some.select(F.struct("_of", "n_hit", "items", "matches").alias(out))
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
    none = {c: F.array().cast(t) for c, t in (f.split(" ", 1) for f in HITS.split(", "))}
    both = docs.join(some, docs[key] == some[f"{out}._of"], "left")
    whole = F.struct(
        n_words,
        F.coalesce(F.col(f"`{out}`.n_hit"), F.lit(0).cast("long")).alias("n_hit"),
        *(F.coalesce(F.col(f"`{out}`.{c}"), none[c]).alias(c) for c in none),
    )
    return both.withColumn(out, whole).drop(key)


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 1_000_000, held: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, matches: a row for each row of `docs`.

    Null and empty texts have no words and no hits. Null item texts count as absent; rows of an equal
    item_id are one item, and so are those with a null one, which is counted in n_items and not part of items_sha256. An empty
    benchmark hits nothing. Other columns are not read. matches are the longest verbatim ones (start and end in words of the
    document, item, start in the item), those within another left out; of several places in the benchmark one is named.
    Very long texts are searched whole, repeated rows each on its own; an empty table gives an empty one.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    f = with_matches(d, benchmark, "text", max_bytes, held=held).select("doc_id", "_found.*")
    items = F.array_sort(F.array_distinct("items"))
    return f.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"), items.alias("items"), "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_bytes: int = 1_000_000, held: int = 8_000_000) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated."""
    (name,) = free_names(docs, "found")
    f = with_matches(docs, benchmark, text_col, max_bytes, name, held)
    return f.where(~contaminated(F.col(f"`{name}`.n_words"), F.col(f"`{name}`.n_hit"))).select(*docs.columns)
