"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word shingles, as 64-bit hashes. Equal sets are one node. The global order of shingles is by
document frequency, rare ones first, then by hash; it is cut into fragments of about equal weight, and each node's set
into one segment for each fragment. Overlaps are counted for each fragment on its own and summed for each pair.

Shingles of a single node can't be shared: they only count in the sizes, and a node with too few shared shingles for
the threshold is done. Candidates share a shingle within the prefix that the threshold leaves (any two sets above it
do). In a first round each shingle's nodes are held against the one with the most common shingles; in a second one, against all those
with which they aren't yet connected. So a group of near copies takes about one pair a member, and no link between two
components is missed.

No task gathers a hot group: shingles that a sample finds common are known to be shared and take their place in the order
from the sample, so they go past the buckets by shingle; of a text with very many copies one row is packed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrain.llm.chunks import releasing
from scenegrain.llm.heap_bpe import batches
from scenegrain.llm.rows import free_names, numbered, small_batches, text_hash
from scenegrain.operators.graph import connected_components
from scenegrain.sources.tables import save

K = 5
U = np.uint64
PRIME = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of `x`."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text): words are runs without ASCII white space, A-Z lower-cased."""
    parts = [some_hashes(part) for part in batches(texts, 500_000)]
    return (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U), np.zeros(0, np.int64))


def some_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of a part of the texts: several numbers are held for each byte.

    The hash of a word is a polynomial of its bytes modulo 2^64, mixed; it is taken from sums over all bytes at once.
    """
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], blank.view(np.int8), [1]))))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(r) + 1 for r in raw])
    n = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    if not len(start):
        return np.zeros(0, U), n
    size = end - start
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    powers = np.cumprod(np.concatenate(([U(1)], np.full(max(0, int(size.max()) - 1), PRIME, U))), dtype=U)
    terms = (data[~blank].astype(U) + U(1)) * powers[place]
    return mixed(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(U)), n


def shingle_sets(texts: list[str | None], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, size of each set): the distinct k-word shingles of each text in ascending order; a text of fewer
    words has its whole sequence as one, a text without words an empty set."""
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    words = np.minimum(n[owner], k)
    s = mixed(words.astype(U))
    for j in range(k):
        ok = words > j
        if ok.all():
            s = mixed(s * PRIME + h[at + j])
        elif ok.any():
            s[ok] = mixed(s[ok] * PRIME + h[at[ok] + j])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.bincount(owner[new], minlength=len(n)).astype(np.int64)


def signatures(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set: equal sets have equal ones."""
    total = np.concatenate(([U(0)], np.cumsum(mixed(s ^ PRIME), dtype=U)))
    end = np.cumsum(n)
    return mixed(total[end] - total[end - n] + n.astype(U) * PRIME).view(np.int64)


def needed(n_a, n_b, t: int = 75):
    """Shared shingles from which 100 * intersection >= t * union."""
    return F.ceil((t * (n_a + n_b)) / F.lit(100.0 + t))


def shingle_nodes(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, h, n_shingles, node) of each row (doc_id, text, h); node is null for empty sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])

    def sign(rows):
        for batch in rows:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            for part in batches(texts, 1_500_000):
                s, n = shingle_sets(part, k)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(n), pa.array(signatures(s, n), mask=n == 0)], schema=schema)
                at += len(part)

    return docs.mapInArrow(releasing(sign), "doc_id long, h long, n_shingles long, node long")


def common_shingles(docs: DataFrame, rows: int, k: int = K, least: int = 16, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks): the shingles that at least `least` nodes of a sample have, ascending, with their estimated
    frequency on a logarithmic scale; at most the `most` most common ones.

    The sample has one document in 1000, or about 4096 if that is more. It only decides how shingles are routed and ordered:
    any order gives the same links. So what is left to a bucket by shingle has a bound, about 1 / `most` of all shingles.
    """
    share = max(1, min(1000, rows // 4096))

    def shingles(rows):
        for batch in rows:
            for texts in batches(batch.column(0).to_pylist(), 1_500_000):
                s, n = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(signatures(s, n), n)), pa.array(s.view(np.int64))], ["node", "shingle"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(share)) == 0).select("text").mapInArrow(releasing(shingles), "node long, shingle long")
    counts = save(drawn.distinct().groupBy("shingle").count().where(F.col("count") >= least), "common")
    steps = counts.groupBy(F.floor(F.log2("count") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("count").alias("count")).orderBy(F.desc("step")).collect()
    left, from_ = most, None
    for r in steps:
        left -= r.n
        if left < 0:
            break
        from_ = r["count"]
    if from_ is None:
        return np.zeros(0, U), np.zeros(0, U)
    top = counts.where(F.col("count") >= from_).toPandas()
    s = top["shingle"].to_numpy(np.int64).view(U)
    order = np.argsort(s)
    return s[order], np.minimum(63, np.log2(top["count"].to_numpy(float) * share) * 3).astype(U)[order]


def copied_nodes(members: DataFrame, rows: int, many: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, doc_ids): nodes with more than `many` rows and a 100,000th of all, so at most 100,000, ascending, and the row
    that stands for each."""
    top = members.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where((F.col("n") > max(many, rows // 100_000)) & F.col("low").isNotNull()).select("node", "low").toPandas().sort_values("node")
    return top["node"].to_numpy(np.int64), top["low"].to_numpy(np.int64)


def looked_up(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `sorted_`, whether it is there) of each of `x`."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def packed_runs(bucket: np.ndarray, node: np.ndarray, n: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """(bucket, runs, values) of arrays in the order of bucket and node: a run is a node's id, size and number of values."""
    if not len(node):
        return []
    head = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))))
    runs = np.zeros(len(head), "i8,i4,i4")
    runs["f0"], runs["f1"], runs["f2"] = node[head], n[head], np.diff(np.append(head, len(node)))
    of = bucket[head]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    last = np.append(first[1:], len(head))
    at = np.append(head, len(node))
    return [(int(of[a]), runs[a:z].tobytes(), values[at[a] : at[z]].tobytes()) for a, z in zip(first, last)]


def shared_shingles(docs: DataFrame, members: DataFrame, k: int = K, t: int = 75, per_bucket: int = 500_000, least_common: int = 16, many_copies: int = 1000) -> DataFrame:
    """(node, n, common, keys): the shingles that at least two nodes have, of the nodes that have enough of them to reach the
    threshold, as ascending keys of the global order; `common` is their mean frequency on a logarithmic scale.

    Shingles are dealt by hash into buckets of about `per_bucket`, in packed runs: a node's id, size and number of
    shingles, then the shingles. A bucket drops what a single node has and packs the rest by node. Those of
    common_shingles() are keys from the start, in buckets by node with negative numbers.
    """
    rows, total = members.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    bits = max(2, int(total // per_bucket).bit_length())
    hot, ranks = common_shingles(docs, rows, k, least_common)
    copied, stands = copied_nodes(members, rows, many_copies)

    def by_node(node):
        return (node.view(U) >> U(64 - bits)).astype(np.int64)

    def pack(rows):
        schema = pa.schema([("bucket", pa.int64()), ("nodes", pa.binary()), ("shingles", pa.binary())])
        for batch in rows:
            ids = batch.column(0)
            known, ids, at = ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy(), 0
            for texts in batches(batch.column(1).to_pylist(), 1_500_000):
                s, n = shingle_sets(texts, k)
                node, part = signatures(s, n), slice(at, at + len(texts))
                at += len(texts)
                place, many = looked_up(copied, node)
                spare = many & known[part] & (ids[part] != stands[place]) if len(copied) else many
                use = np.flatnonzero((n > 0) & ~spare)
                _, one = np.unique(node[use], return_index=True)  # equal sets of a batch count once
                keep = np.zeros(len(n), bool)
                keep[use[one]] = True
                ok = np.repeat(keep, n)
                s, node, n = s[ok], node[keep], n[keep]
                owner = np.repeat(np.arange(len(n)), n)
                bucket = (s >> U(64 - bits)).astype(np.int64)
                place, often = looked_up(hot, s)
                bucket[often] = -1 - by_node(node)[owner[often]]
                s[often] = (ranks[place[often]] << U(57)) | (s[often] >> U(7)) if len(hot) else s[often]
                order = np.argsort((bucket << 32) | owner, kind="stable")
                owner = owner[order]
                out = packed_runs(bucket[order], node[owner], n[owner], s[order])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    def unpack(pdf):
        runs = np.concatenate([np.frombuffer(x, "i8,i4,i4") for x in pdf.nodes])
        return runs["f0"], runs["f1"], runs["f2"], np.concatenate([np.frombuffer(x, U) for x in pdf.shingles])

    def count(pdf):
        node, n, size, s = unpack(pdf)
        is_key = pdf.bucket.iloc[0] < 0
        order = np.argsort(s, kind="stable")
        if not is_key:
            same = s[order][1:] == s[order][:-1]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        owner = np.repeat(np.arange(len(node)), size)[order]
        s, ids, sizes = s[order], node[owner], n[owner]
        order = np.lexsort((ids, s))  # equal sets of several batches: once
        s, ids, sizes = s[order], ids[order], sizes[order]
        if not len(s):
            return pd.DataFrame({"bucket": [], "nodes": [], "shingles": []})
        one = np.concatenate(([True], (s[1:] != s[:-1]) | (ids[1:] != ids[:-1])))
        s, ids, sizes = s[one], ids[one], sizes[one]
        key = s
        if not is_key:
            head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            df = np.repeat(d := np.diff(np.concatenate((head, [len(s)]))), d)
            s, ids, sizes, df = s[df > 1], ids[df > 1], sizes[df > 1], df[df > 1]
            # The global order: frequency on a logarithmic scale in the upper 6 bits, then the hash.
            key = (np.minimum(63, np.log2(df) * 3).astype(U) << U(57)) | (s >> U(7))
        bucket = by_node(ids)
        order = np.lexsort((key, ids, bucket))
        return pd.DataFrame(packed_runs(bucket[order], ids[order], sizes[order], key[order]), columns=["bucket", "nodes", "shingles"])

    def gather(pdf):
        node, n, size, key = unpack(pdf)
        owner = np.repeat(np.arange(len(node)), size)
        order = np.lexsort((key, node[owner]))
        key, owner = key[order], owner[order]
        ids, sizes = node[owner], n[owner]
        head = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, int)
        ends = np.concatenate((head[1:], [len(ids)])).astype(int)
        ok = (100 * (ends - head)) >= t * sizes[head]
        total = np.concatenate(([0], np.cumsum(key >> U(57)))).astype(np.int64)
        common = ((total[ends] - total[head]) / np.maximum(1, sizes[head])) if len(ids) else np.zeros(0)
        key = key.view(np.int64)
        return pd.DataFrame({"node": ids[head[ok]], "n": sizes[head[ok]].astype(np.int64), "common": common[ok], "keys": [key[a:b] for a, b in zip(head[ok], ends[ok])]})

    packed = "bucket long, nodes binary, shingles binary"
    runs = docs.select("doc_id", "text").mapInArrow(releasing(pack), packed).groupBy("bucket").applyInPandas(count, packed)
    return runs.groupBy("bucket").applyInPandas(gather, "node long, n long, common double, keys array<long>")


def verified(pairs: DataFrame, sets: DataFrame, pivots: list[int], t: int = 75) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that reach the threshold: overlaps of the segments of each fragment, summed."""
    cuts = [None, *pivots, None]
    inside = lambda lo, hi: lambda x: (F.lit(True) if lo is None else x >= lo) & (F.lit(True) if hi is None else x < hi)
    segment = [F.struct(F.lit(i).alias("fragment"), F.filter("keys", inside(a, b)).alias("part")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    segments = sets.select("node", F.inline(F.filter(F.array(*segment), lambda x: F.size(x["part"]) > 0)))
    left = segments.withColumnsRenamed({"node": "a", "part": "part_a"})
    right = segments.withColumnsRenamed({"node": "b", "part": "part_b"})
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("overlap"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return summed.where(100 * F.col("overlap") >= t * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def across_components(named: DataFrame, t: int = 75) -> DataFrame:
    """a, b, n_a, n_b: pairs of different components that share a shingle of both prefixes and may reach the threshold.

    The smaller set of a pair needs more shared shingles than its own threshold says, so the shared one is in a shorter
    prefix of it (its index); what very many sets have in common, but too little to link them, is in the index of none.
    A shingle's pairs are those of all sets outside its most frequent component with others: a large group of copies is
    not joined with itself.
    """
    by = named.groupBy("key", "c").agg(F.count("*").alias("sets"))
    major = by.groupBy("key").agg(F.max(F.struct("sets", "c")).alias("top"), F.count("*").alias("n_c")).where("n_c > 1").select("key", F.col("top.c").alias("major"))
    indexed = F.col("at") < F.col("m") - F.ceil(F.col("n") * (2.0 * t) / (100 + t)) + 1
    rest = save(named.join(major, "key").select("key", "node", "n", "m", "at", "c", indexed.alias("indexed"), (F.col("c") == F.col("major")).alias("in_major")), "rest")
    side = lambda df, x: df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "m", "at", "c")))
    small = rest.where("indexed")
    pairs = side(small.where("NOT in_major"), "a").join(side(rest, "b"), "key").union(side(small.where("in_major"), "a").join(side(rest.where("NOT in_major"), "b"), "key"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    found = pairs.where(smaller & (F.col("c_a") != F.col("c_b")) & reachable(t))
    return ordered(found).distinct()


def reachable(t: int):
    """Whether the sets' sizes and what is left behind the shared shingle leave the threshold within reach."""
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * t) & (F.least(F.col("m_a") - F.col("at_a"), F.col("m_b") - F.col("at_b")) >= needed(F.col("n_a"), F.col("n_b"), t))


def ordered(pairs: DataFrame) -> DataFrame:
    """a < b, n_a, n_b from node_a, node_b and their sizes."""
    first = F.col("node_a") < F.col("node_b")
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))


def similar_sets(docs: DataFrame, k: int = K, t: int = 75, fragments: int = 6, id_col: str = "doc_id", text_col: str = "text", **hot: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has doc_id, h (of the text), n_shingles and node of each row, links the pairs of nodes that connect
    all that the threshold connects (pairs within a component that the others imply are left out)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        members = save(shingle_nodes(d.withColumn("h", text_hash(F.col("text"))), k), "members")
        sets = save(shared_shingles(d, members, k, t, **hot), "sets")
    pivots = sets.select(F.explode("keys").alias("key")).agg(F.percentile_approx("key", [i / fragments for i in range(1, fragments)], 1000)).first()[0]
    pivots = sorted(set(pivots or []))
    # Prefixes: the singles stand first in the order, so `size(keys) - needed + 1` shared ones are left of it.
    least = F.ceil(F.col("n") * t / 100.0).cast("int")
    left = F.size("keys") - least + 1
    prefix = save(sets.select("node", "n", "common", F.size("keys").alias("m"), F.posexplode(F.slice("keys", 1, left)).alias("at", "key")), "prefix")
    b = prefix.select(*(F.col(c).alias(f"{c}_b") for c in ("node", "n", "m", "at")), "key")
    # Round 1: against the node of each shingle whose shingles are the most common, which of near copies is the one that
    # has changed least.
    centre = prefix.groupBy("key").agg(F.max(F.struct("common", "node", "n", "m", "at")).alias("low"))
    stars = centre.select("key", *(F.col(f"low.{c}").alias(f"{c}_a") for c in ("node", "n", "m", "at"))).join(b, "key").where((F.col("node_a") != F.col("node_b")) & reachable(t))
    stars = ordered(stars).distinct()
    stars = save(stars, "stars")
    first = save(verified(stars, sets, pivots, t), "links")
    comps = connected_components(first, "a", "b")
    # Round 2: nodes of a shingle that are in different components.
    named = prefix.join(comps, prefix.node == comps.id, "left").select("key", "node", "n", "m", "at", F.coalesce("component", "node").alias("c"))
    more = across_components(named, t)
    more = save(more.join(stars, ["a", "b"], "left_anti"), "more")
    links = first if more.isEmpty() else first.union(save(verified(more, sets, pivots, t), "links"))
    return members, links


def near_documents(docs: DataFrame, k: int = K, t: int = 75, **names) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of `docs`.

    Empty and null texts have an empty set and link with nothing: component_id is their own doc_id. Rows with a null
    doc_id take part but never name a component that has another id. An empty table gives an empty one.
    """
    members, links = similar_sets(docs, k, t, **names)
    comps = connected_components(links, "a", "b").withColumnRenamed("id", "node")
    nodes = members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"))
    named = nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("low").alias("lowest"))
    of = named.join(lowest, "component").select("node", "lowest")
    return members.join(of, "node", "left").select("doc_id", "n_shingles", F.coalesce("lowest", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of `docs`, all columns, but for near duplicates: one row of each component stays.

    It is the one with the smallest doc_id (null last), then with the smallest hash of its text. Rows are told apart by id
    and text, so texts that share an id are judged each on its own, and of equal rows one stays. Rows with an empty set
    (null and empty texts) all stay. An empty table gives an empty one.
    """
    members, links = similar_sets(docs, id_col=id_col, text_col=text_col, **names)
    comps = connected_components(links, "a", "b").withColumnRenamed("id", "node")
    rows = members.where("node IS NOT NULL").groupBy("doc_id", "h", "node").agg(F.count("*").alias("n")).join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    first = rows.groupBy("component").agg(F.min(order).alias("first"))
    judged = rows.join(first, "component").select("doc_id", "h", "n", (order == F.col("first")).alias("stays")).where("n > 1 OR NOT stays")
    h, key, stays, n, at = free_names(docs, "h", "key", "stays", "n", "at")
    judged = save(judged.select(F.struct("doc_id", "h").alias(key), F.col("stays").alias(stays), F.col("n").alias(n)), "judged")
    own = docs.withColumn(h, text_hash(F.col(text_col)))
    own_key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(h).alias("h"))
    dropped = judged.where(~F.col(stays))
    out = own.join(dropped.select(key), own_key.eqNullSafe(F.col(key)), "left_anti")
    several = judged.where(F.col(stays))
    if several.isEmpty():
        return out.select(*docs.columns)
    one = out.join(several.select(key), own_key.eqNullSafe(F.col(key)), "left_anti").select(*docs.columns)
    more = numbered(out.join(several.select(key), own_key.eqNullSafe(F.col(key)), "left_semi"), [id_col, h], at)
    return one.union(more.where(F.col(at) == 1).select(*docs.columns))
