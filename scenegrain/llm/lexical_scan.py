"""Ranked lexical search by scanning texts with one automaton of all query terms.

Terms are runs of ASCII digits and letters (A-Z lower-cased) and of all characters beyond ASCII. A text becomes bytes in
which everything else is a blank, with a blank at both ends; every query term is a pattern between two blanks, so the
Aho-Corasick automaton finds whole terms only. One scan counts the statistics of the collection (documents, terms, and
documents a query term), a second one scores: the matches of a batch of documents are counted, weighted, and added up
through the lists of items that each term leads to, and only each item's best documents leave a task. There is no index of
the documents. Items go to the executors in blocks whose size is bounded, so a larger query set takes more passes.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.llm.chunks import releasing
from scenegrain.llm.rows import small_batches
from scenegrain.sources.tables import save

#: Bytes to bytes: A-Z to a-z, other ASCII but digits and letters to a blank, all else as it is.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of text that are scanned at once, and sums that are held at once.
PIECE, SUMS = 4_000_000, 2_000_000


def folded(text: str | None) -> bytes:
    return b" " + (text or "").encode("utf-8", "replace").translate(FOLDED) + b" "


class Block:
    """The terms of some items: an automaton over them and, for each term, the items that hold it.

    Items are numbered by their place; `starts` and `items` are the lists of items, by term.
    """

    def __init__(self, texts: list[str | None]):
        self.n_items = len(texts)
        own = [sorted(set(folded(t).split())) for t in texts]
        self.terms = sorted({w for ws in own for w in ws})
        number = {w: k for k, w in enumerate(self.terms)}
        lists: list[list[int]] = [[] for _ in self.terms]
        for i, ws in enumerate(own):
            for w in ws:
                lists[number[w]].append(i)
        self.starts = np.cumsum([0, *map(len, lists)])
        self.items = np.array([i for at in lists for i in at], np.int64)
        self.key = uuid.uuid4().hex


@lru_cache(1)
def automaton(key: str, terms: tuple[bytes, ...]) -> ahocorasick.Automaton:
    """Built once for a block in each worker. Bytes stand as the characters of the same number."""
    a = ahocorasick.Automaton()
    for k, w in enumerate(terms):
        a.add_word(f" {w.decode('latin-1')} ", k)
    a.make_automaton()
    return a


def pieces(data: bytes, size: int = PIECE):
    """`data` cut at blanks into pieces of about `size`; neighbours share the blank."""
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b" ", at + 1, at + size)
        cut = cut if cut > at else data.find(b" ", at + size)
        if cut <= at or cut >= len(data) - 1:
            break
        yield data[at : cut + 1]
        at = cut
    yield data[at:]


def lengths(data: np.ndarray) -> np.ndarray:
    """Whether a term starts at each byte."""
    word = data != 32
    word[1:] &= data[:-1] == 32
    return word


def matched(auto, texts: list[str | None], n_terms: int):
    """(terms a text, text, term, count): how many terms each text has, and for every text and query term in it, by text
    and term, how often it occurs. Short texts are scanned together, long ones in pieces."""
    n = np.zeros(len(texts), np.int64)
    keys, counts = [], []

    def scan(data: bytes, ends: np.ndarray, first: int):
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(lengths(raw))
        n[first : first + len(ends)] += np.diff(np.searchsorted(at, np.concatenate(([0], ends))))
        if not n_terms:
            return
        found = np.array(list(auto.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
        owner = np.searchsorted(ends, found[:, 0], "right") + first
        k, c = np.unique(owner * n_terms + found[:, 1], return_counts=True)
        keys.append(k)
        counts.append(c)

    part, ends, size, first = [], [], 0, 0

    def flush():
        nonlocal part, ends, size
        if part:
            scan(b"".join(part), np.array(ends), first)
        part, ends, size = [], [], 0

    for i, t in enumerate(texts):
        if not t:
            data = b"  "
        else:
            data = folded(t)
        if len(data) > PIECE:
            flush()
            for p in pieces(data):
                scan(p, np.array([len(p)]), i)
            first = i + 1
            continue
        if not part:
            first = i
        part.append(data)
        size += len(data)
        ends.append(size)
        if size > PIECE:
            flush()
            first = i + 1
    flush()
    if not keys:
        empty = np.zeros(0, np.int64)
        return n, empty, empty, empty
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.zeros(len(k), np.int64)
    np.add.at(c, inverse, np.concatenate(counts))
    return n, k // n_terms, k % n_terms, c


def statistics(docs: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    """term, n: documents with each query term; term -1: documents with any term, -2: terms of all documents. Each task
    returns one row for each."""

    @releasing
    def count(batches):
        block = shared.value
        auto = automaton(block.key, tuple(block.terms))
        df, total = np.zeros(len(block.terms), np.int64), np.zeros(2, np.int64)
        for b in batches:
            n, _, term, _ = matched(auto, b.column(0).to_pylist(), len(df))
            df += np.bincount(term, minlength=len(df))
            total += (n > 0).sum(), n.sum()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([*total.tolist(), *df[at].tolist()], pa.int64())], ["term", "n"])

    return docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def best(held: pa.Table, k: int) -> pa.Table:
    """Of each item the k rows with the largest score, by ascending id, nulls last."""
    t = held.take(pc.sort_indices(held, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
    item = t.column("item").to_numpy()
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return t.filter(pa.array(rank < k)).combine_chunks()


def scores(block: Block, weight: np.ndarray, n_docs: int, n_terms: int, n: np.ndarray, doc, term, count):
    """(text, item, score) of all scores above 0: exact, as sums of whole numbers below 2^53."""
    m = np.array([10 + (90 * int(x) * n_docs) // max(1, n_terms) for x in n], np.int64)
    value = weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))
    some = value > 0
    doc, term, value = doc[some], term[some], value[some]
    size = block.starts[term + 1] - block.starts[term]
    ends = np.cumsum(size)
    at = 0
    while at < len(doc):
        # Whole texts whose lists of items together have about SUMS entries, or one text.
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SUMS, "right"))
        to = max(to, at + 1)
        cut = int(np.searchsorted(doc, doc[to] if to < len(doc) else doc[-1] + 1, "left"))
        to = cut if cut > at else int(np.searchsorted(doc, doc[at], "right"))
        d, s = doc[at:to], size[at:to]
        first = int(d[0])
        place = np.repeat(block.starts[term[at:to]] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
        key = np.repeat(d - first, s) * block.n_items + block.items[place]
        total = np.bincount(key, np.repeat(value[at:to], s).astype(float))
        hit = np.flatnonzero(total)
        yield hit // block.n_items + first, hit % block.n_items, total[hit].astype(np.int64)
        at = to


def ranked_in_tasks(docs: DataFrame, shared: Broadcast, df: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: each item's best documents of every task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    weight = weights(n_docs, df)

    @releasing
    def rank(batches):
        block = shared.value
        auto = automaton(block.key, tuple(block.terms))
        held = None
        for b in batches:
            n, doc, term, count = matched(auto, b.column(1).to_pylist(), len(weight))
            ids = b.column(0)
            for d, item, score in scores(block, weight, n_docs, n_terms, n, doc, term, count):
                new = pa.table({"item": pa.array(item), "doc_id": ids.take(pa.array(d)), "score": pa.array(score)})
                held = best(pa.concat_tables([held, new]) if held is not None else new, k)
        if held is not None:
            yield from held.to_batches()

    return docs.select("doc_id", "text").mapInArrow(rank, f"item long, doc_id {kind}, score long")


def blocks(items: DataFrame, most_bytes: int, most_items: int):
    """Runs of benchmark rows of bounded size, as they stream to the driver: (first number, ids, texts)."""
    ids, texts, size, first = [], [], 0, 0
    for r in items.toLocalIterator():
        if ids and (size + len(r.text or "") > most_bytes or len(ids) >= most_items):
            yield first, ids, texts
            first, ids, texts, size = first + len(ids), [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text or "")
    if ids:
        yield first, ids, texts


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    most_bytes: int = 1_000_000,
    most_items: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents with the highest scores above 0.

    Every row of `items` is an item of its own, every row of `docs` a document, repeated ones too. Equal scores go by
    ascending id, null ids last. Items without terms, null ones among them, have no rows; null, empty and termless documents
    count for nothing. Very long texts are scanned whole, in pieces. Items come in blocks of at most `most_bytes` characters
    (or one item) and `most_items`; documents are scanned twice for each block. Without documents or items the result is
    empty. Other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    q = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    found, schema = [], f"item_id {q.schema['item_id'].dataType.simpleString()}, number long, doc_id {d.schema['doc_id'].dataType.simpleString()}, score long"
    with small_batches(spark):
        for first, ids, texts in blocks(q, most_bytes, most_items):
            block = Block(texts)
            shared = spark.sparkContext.broadcast(block)
            # One row a term of the block.
            got = {r.term: r.n for r in statistics(d, shared, "text").collect()}
            n_docs, n_terms = got.get(-1) or 0, got.get(-2) or 0
            df = np.array([got.get(t, 0) for t in range(len(block.terms))], np.int64)
            if not n_terms or not df.any():
                continue
            per_task = ranked_in_tasks(d, shared, df, n_docs, n_terms, k)
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
            salted = per_task.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
            for keys in (["item", "salt"], ["item"]):
                salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
            names = spark.createDataFrame(list(zip(range(len(ids)), ids)), f"item long, item_id {q.schema['item_id'].dataType.simpleString()}")
            numbered = salted.join(F.broadcast(names), "item").select("item_id", (F.col("item") + first).alias("number"), "doc_id", "score")
            found.append(save(numbered, "ranked"))
    out = found[0] if found else spark.createDataFrame([], schema)
    for f in found[1:]:
        out = out.union(f)
    w = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.select("item_id", F.row_number().over(w).alias("rank"), "doc_id", "score")
