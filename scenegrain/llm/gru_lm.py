"""Log-likelihood of whole documents under a gated recurrent language model, in numpy.

Words are counted over all training documents with Spark. The most frequent ones form a table of bounded size, which
is broadcast: its first words are in small classes whose softmax depends on the state, the others in classes by
frequency, within which a word has its share of the counts. All other words form one open class, within which a word
has (c+1)/(N+V+1) of that class's counts; unseen words are its last share. So the output is P(class | state) times
P(word | class, state), and sums to one over all words. Counts of the open class come from a join.

The network is trained by truncated backpropagation on all training documents, in bounded shards whose number grows
with the data; after each round the shards' parameters are averaged on Spark. Documents are scored whole: lanes
of documents run side by side in windows, and the state is carried from window to window, from a document's first word
to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.llm.chunks import releasing
from scenegrain.llm.rows import small_batches
from scenegrain.sources.tables import save

END = b""
PER_CLASS = 32


def slices(texts: pa.Array, size: int = 32_000_000) -> Iterator[pa.Array]:
    """The texts in runs of about `size` bytes, null as empty: bounds what a task holds at once."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(which, number in each text, words): the different words, A-Z lower-cased, and which of them the texts have."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = cut.flatten(), cut.offsets.to_numpy()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at the ends of a text cuts off nothing
    n = np.diff(np.append(0, np.cumsum(full))[ends - ends[0]])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), n, coded.dictionary.cast(pa.large_binary())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c) over all rows of `docs` (text), the end once a row; counted in each batch, then summed."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def count(rows):
        for batch in rows:
            for texts in slices(batch.column(0)):
                which, _, words = coded_words(texts)
                c = np.append(np.bincount(which, minlength=len(words)), len(texts))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())]), pa.array(c)], schema=schema)

    return docs.select("text").mapInArrow(releasing(count), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Table:
    """The frequent words: `ids` by word; for each its class, its place in the class (-1: by share), log10 of its
    share, log10(c + 1) and the row of its input. The last class and input are those of all other words."""

    ids: dict
    cls: np.ndarray
    slot: np.ndarray
    share: np.ndarray
    plus: np.ndarray
    row: np.ndarray
    n_soft: int
    n_classes: int
    prior: np.ndarray
    soft_prior: np.ndarray


def frequent_table(words: list[bytes], counts: np.ndarray, total: int, soft: int = 1024, bins: int = 7) -> Table:
    """`words` by falling count. Fewer words than `soft` give fewer classes."""
    n = len(words)
    k = min(soft, n)
    n_soft = -(-k // PER_CLASS)
    cls, slot = np.zeros(n + 1, np.int64), np.full(n + 1, -1)
    cls[:k] = np.arange(k) // PER_CLASS
    slot[:k] = np.arange(k) % PER_CLASS
    mass = np.cumsum(counts[k:]) / max(1, counts[k:].sum())
    cls[k:n] = n_soft + np.minimum((mass * bins).astype(int), bins - 1)
    n_classes = n_soft + bins + 1
    cls[n] = n_classes - 1
    by = np.bincount(cls[:n], counts, n_classes)
    by[-1] = max(0, total - counts.sum())
    share = np.concatenate((np.log10(counts / by[cls[:n]]), [0.0])) if n else np.zeros(1)
    row = np.concatenate((np.arange(k), k + cls[k:] - n_soft))
    prior = np.log((by + 1) / (by + 1).sum())
    soft_prior = np.full((n_soft, PER_CLASS), -1e9)  # places without a word
    soft_prior[cls[:k], slot[:k]] = np.log(counts[:k] / by[cls[:k]])
    return Table({w: i for i, w in enumerate(words)}, cls, slot, share, np.concatenate((np.log10(counts + 1.0), [0.0])), row, n_soft, n_classes, prior, soft_prior)


class Gru:
    def __init__(self, t: Table, hidden: int = 16, seed: int = 3):
        r = np.random.default_rng(seed)
        n_in, h = int(t.row.max()) + 1, hidden
        p = {"e": r.normal(0, 0.1, (n_in, 3 * h)), "u": r.normal(0, 1 / np.sqrt(h), (h, 3 * h)), "c": np.zeros((h, t.n_classes)), "cb": t.prior, "w": np.zeros((t.n_soft, h, PER_CLASS)), "wb": t.soft_prior}
        p["e"][:, :h] -= 1.0  # opens the update gate: sigmoid is the share of the old state that stays
        self.p, self.h, self.n_soft = {k: v.astype(np.float32) for k, v in p.items()}, h, t.n_soft

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def load(self, x: np.ndarray) -> Gru:
        at = 0
        for k, v in self.p.items():
            self.p[k] = x[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def step(self, x: np.ndarray, prev: np.ndarray):
        """(new state, update gate, reset gate, candidate, prev @ u for the candidate) for input rows `x`."""
        h = self.h
        a = prev @ self.p["u"]
        e = self.p["e"][x]
        g = np.tanh(0.5 * (e[:, : 2 * h] + a[:, : 2 * h])) * 0.5 + 0.5
        z, r, q = g[:, :h], g[:, h:], a[:, 2 * h :]
        n = np.tanh(e[:, 2 * h :] + r * q)
        return n + z * (prev - n), z, r, n, q

    def log_probs(self, pre: np.ndarray, cls: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Natural log of P(class | state), and of the word in it where the class depends on the state."""
        # States lie in (-1, 1), so logits are within a known range of their bias and need no shift.
        z = pre @ self.p["c"]
        z += self.p["cb"]
        out = z[np.arange(len(z)), cls]
        out -= np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))
        soft = np.flatnonzero(slot >= 0)
        order = soft[np.argsort(cls[soft], kind="stable")]
        cut = np.searchsorted(cls[order], np.arange(self.n_soft + 1))
        for k in range(self.n_soft):
            i = order[cut[k] : cut[k + 1]]
            if len(i):
                y = pre[i] @ self.p["w"][k]
                y += self.p["wb"][k]
                own = y[np.arange(len(i)), slot[i]]
                out[i] += own - np.log(np.exp(y, out=y) @ np.ones(PER_CLASS, np.float32))
        return out

    def output_grads(self, pre, cls, slot, g) -> np.ndarray:
        """Adds the softmaxes' gradients to `g`; returns that of the states."""
        z = pre @ self.p["c"]
        z += self.p["cb"]
        np.exp(z, out=z)
        z *= (1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
        z[np.arange(len(z)), cls] -= 1
        g["c"] += pre.T @ z
        g["cb"] += np.ones(len(z), z.dtype) @ z
        d = z @ self.p["c"].T
        soft = np.flatnonzero(slot >= 0)
        order = soft[np.argsort(cls[soft], kind="stable")]
        cut = np.searchsorted(cls[order], np.arange(self.n_soft + 1))
        for k in range(self.n_soft):
            i = order[cut[k] : cut[k + 1]]
            if not len(i):
                continue
            x = pre[i]
            y = x @ self.p["w"][k]
            y += self.p["wb"][k]
            np.exp(y, out=y)
            y *= (1 / (y @ np.ones(PER_CLASS, y.dtype)))[:, None]
            y[np.arange(len(i)), slot[i]] -= 1
            g["w"][k] += x.T @ y
            g["wb"][k] += np.ones(len(i), y.dtype) @ y
            d[i] += y @ self.p["w"][k].T
        return d


def lanes(sizes: list[int], width: int) -> list[list[int]]:
    """Deals documents to lanes, long ones first, each to the lane with the fewest words; longest lane first."""
    import heapq

    heap = [(0, i) for i in range(min(width, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(sizes)), key=lambda d: -sizes[d]):
        n, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (n + sizes[d], i))
    return sorted(out, key=lambda x: -sum(sizes[d] for d in x))


def laid_out(docs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc of each, number of each step): lanes side by side, step after step, without any padding.

    Lanes are by falling length, so the lanes of a step are the first ones of the step before. What is held grows with
    the words, however long one text is beside the others.
    """
    plan = lanes([len(d) for d in docs], width)
    size = np.array([sum(len(docs[d]) for d in x) for x in plan])
    n = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
    first = np.concatenate(([0], np.cumsum(n)))
    ids, owner = np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
    for i, x in enumerate(plan):
        at = first[: size[i]] + i
        ids[at] = np.concatenate([docs[d] for d in x])
        owner[at] = np.repeat(x, [len(docs[d]) for d in x])
    return ids, owner, n


def score(net: Gru, t: Table, docs: list[np.ndarray], width: int = 512, window: int = 32) -> np.ndarray:
    """log10 of the probability of each document but for the shares within the open class."""
    if not docs:
        return np.zeros(0)
    ids, owner, n = laid_out(docs, width)
    first = np.concatenate(([0], np.cumsum(n)))
    total = np.zeros(len(docs))
    state, last, k = np.zeros((n[0], net.h), np.float32), np.full(n[0], -1), 0
    while k < len(n):
        # A window has so many steps, or more where few lanes are left, so as to hold about as many words.
        stop = min(len(n), k + max(window, window * width // (8 * int(n[k]))))
        part = slice(first[k], first[stop])
        i, who = ids[part], owner[part]
        rows, pre, at = t.row[i], np.empty((len(i), net.h), np.float32), 0
        for m in n[k:stop].tolist():
            now = who[at : at + m]
            state = state[:m] * (now == last[:m])[:, None]
            pre[at : at + m] = state
            state, last, at = net.step(rows[at : at + m], state)[0], now, at + m
        lp = net.log_probs(pre, t.cls[i], t.slot[i]) / np.log(10) + np.where(t.slot[i] < 0, t.share[i], 0.0)
        total += np.bincount(who, lp, len(docs))
        k = stop
    return total


def train(net: Gru, t: Table, docs: list[np.ndarray], width: int = 512, window: int = 32, rate: float = 2e-2) -> Gru:
    """One pass of truncated backpropagation with Adam over `docs`, which are one stream cut into `width` equal lanes; the
    state goes on from window to window and starts anew with each document (and at the head of a lane)."""
    flat = np.concatenate(docs)
    width = max(1, min(width, len(flat) // window))
    steps = -(-len(flat) // width)
    ids, new = np.full(width * steps, -1), np.ones(width * steps, np.float32)
    ids[: len(flat)] = flat
    new[np.cumsum([len(d) for d in docs])[:-1]] = 0
    new[::steps] = 0
    ids, new = np.ascontiguousarray(ids.reshape(width, steps).T), np.ascontiguousarray(new.reshape(width, steps).T)[:, :, None]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    q = {k: np.zeros_like(v) for k, v in net.p.items()}
    state, step, h = np.zeros((width, net.h), np.float32), 0, net.h
    for s in range(0, steps, window):
        x, on = ids[s : s + window], new[s : s + window]
        rows, held = t.row[x], []
        for k in range(len(x)):
            prev = state * on[k]
            state, *gates = net.step(rows[k], prev)
            held.append((prev, gates))
        g = {k: np.zeros_like(v) for k, v in net.p.items()}
        ok = x.reshape(-1) >= 0
        pre = np.concatenate([p for p, _ in held])
        d_pre = np.zeros_like(pre)
        i = x.reshape(-1)[ok]
        d_pre[ok] = net.output_grads(pre[ok], t.cls[i], t.slot[i], g)
        d_pre = d_pre.reshape(len(x), width, h)
        dh, grads = np.zeros((width, h), np.float32), np.empty((len(x), width, 3 * h), np.float32)
        for k in range(len(x) - 1, -1, -1):
            p, (z, r, c, a) = held[k]
            dn = dh * (1 - z) * (1 - c * c)
            d = grads[k]
            d[:, :h] = dh * (p - c) * z * (1 - z)
            d[:, h : 2 * h] = dn * a * r * (1 - r)
            d[:, 2 * h :] = dn * r
            g["u"] += p.T @ d
            dh = (dh * z + d @ net.p["u"].T + d_pre[k]) * on[k]
            d[:, 2 * h :] = dn
        flat = rows.reshape(-1)
        order = np.argsort(flat, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        g["e"][flat[order][head]] = np.add.reduceat(grads.reshape(-1, 3 * h)[order], head, axis=0)
        count, step = max(1, int(ok.sum())), step + 1
        for k, v in g.items():
            v /= count
            m[k] += 0.1 * (v - m[k])
            q[k] += 0.01 * (v * v - q[k])
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def averaged(spark, shards: DataFrame, size: int) -> np.ndarray | None:
    """The mean of the shards' parameters by their words: summed in blocks, first by groups of shards."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, "<f4").astype(float) for v in pdf["values"])
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "part": [0], "n": [float(pdf.n.sum())], "values": [total.astype("<f4").tobytes()]})

    schema = "block int, part int, n double, values binary"
    rows = shards.groupBy("block", "part").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["values"], "<f4") / r.n for r in sorted(rows, key=lambda r: r.block)])[:size]


def fit(coded: DataFrame, t: Table, net: Gru, n_words: int, rounds: int = 1, shard_words: int = 2_000_000) -> Gru:
    """Trains on all rows of `coded` (ids: 32-bit word numbers of a text and its end) in each round.

    A task streams its documents and closes a shard at `shard_words` words; so shards are bounded, grow in number with
    the corpus and are cut by rows, wherever copies lie. Each shard starts from the mean of the round before.
    """
    spark = coded.sparkSession
    read = coded.select("ids").coalesce(max(1, int(n_words // shard_words)))  # small files make no small shards
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("n", pa.float64()), ("values", pa.binary())])
    size, block = len(net.flat()), 1 << 14
    for _ in range(rounds):
        now = net.flat()
        sent = spark.sparkContext.broadcast((t, net, now))

        def learn(rows, sent=sent):
            from pyspark import TaskContext

            t, net, now = sent.value
            k = TaskContext.get().partitionId()

            def learnt(shard, total):
                net.load(now.copy())
                train(net, t, shard)
                out = net.flat() * np.float32(total)
                return pa.RecordBatch.from_pylist([{"block": i, "part": k % 64, "n": float(total), "values": out[s : s + block].tobytes()} for i, s in enumerate(range(0, size, block))], schema)

            shard, total = [], 0
            for batch in rows:
                for x in batch.column(0):
                    shard.append(np.frombuffer(x.as_buffer(), "<i4").copy())
                    total += len(shard[-1])
                    if total >= shard_words:
                        yield learnt(shard, total)
                        shard, total, k = [], 0, k + 1
            if total:
                yield learnt(shard, total)

        mean = averaged(spark, read.mapInArrow(releasing(learn), "block int, part int, n double, values binary"), size)
        if mean is None:
            return net
        net.load(mean)
    return net


def in_numbers(docs: DataFrame, t: Table) -> DataFrame:
    """row, doc_id, training, n_tokens, n_open, plus, ids, open of each row of `docs` (doc_id, text, training): the
    numbers of a text's words and its end, and those words that are in the open class."""
    sent = docs.sparkSession.sparkContext.broadcast(t)
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_open", pa.int64()), ("plus", pa.float64()), ("ids", pa.binary()), ("open", pa.list_(pa.binary()))]
    schema = pa.schema(fields)

    def run(rows):
        from pyspark import TaskContext

        t = sent.value
        get, unknown = t.ids.get, len(t.ids)
        row = TaskContext.get().partitionId() << 33
        for batch in rows:
            at = 0
            for texts in slices(batch.column(1)):
                which, n, words = coded_words(texts)
                of = np.array([get(w, unknown) for w in words.to_pylist()], "<i4")
                ends, is_word = np.cumsum(n + 1), np.ones(len(which) + len(n), bool)
                is_word[ends - 1] = False
                flat = np.full(len(is_word), t.ids[END], "<i4")
                flat[is_word] = of[which]
                plus = np.add.reduceat(t.plus[flat], ends - n - 1)
                out = flat == unknown
                n_open = np.diff(np.append(0, np.cumsum(out)[ends - 1]))
                rest = words.cast(pa.binary()).take(pa.array(which[out[is_word]]))
                raw, cut = flat.tobytes(), (np.append(0, ends) * 4).tolist()
                ids = pa.array([raw[a:z] for a, z in zip(cut, cut[1:])], pa.binary())
                m = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + m)), batch.column(0).slice(at, m), batch.column(2).slice(at, m), pa.array(n + 1), pa.array(n_open), pa.array(plus), ids, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_open)), pa.int32()), rest)], schema=schema)
                row, at = row + m, at + m

    return docs.select(F.col("doc_id").cast("long"), "text", "training").mapInArrow(releasing(run), "row long, doc_id long, training boolean, n_tokens long, n_open long, plus double, ids binary, open array<binary>")


def scored(coded: DataFrame, t: Table, net: Gru, words: int = 2_000_000) -> DataFrame:
    """`coded` without open and ids, with lm: the score but for the shares within the open class."""
    sent = coded.sparkSession.sparkContext.broadcast((t, net))
    kept = ["row", "doc_id", "training", "n_tokens", "n_open", "plus"]

    def run(rows):
        t, net = sent.value
        for batch in rows:
            ids = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("ids")]
            part = np.cumsum([len(x) for x in ids]) // words
            for a, z in zip(cut := [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()], [*cut[1:], len(ids)]):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, z - a) for k in kept), pa.array(score(net, t, ids[a:z]), pa.float64())], [*kept, "lm"])

    return coded.select(*kept, "ids").mapInArrow(releasing(run), "row long, doc_id long, training boolean, n_tokens long, n_open long, plus double, lm double")


def score_documents(docs: DataFrame, training: Column, table: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score: a row for each row of `docs`.

    Null and empty texts are the end alone. Without training rows all words are unknown and the network is untrained.
    Rows may repeat; null ids stay; other columns are not read. A very long text is one lane: it takes memory for its own
    words and is scored from its first word to its end. An empty table gives an empty one.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), training.alias("training"))
    with small_batches(docs.sparkSession):
        counts = save(word_counts(d.where("training")), "counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    # Words seen once stay in the open class, so its probability is learnt from words that are as rare as unseen ones.
    # The least count of the table comes from a histogram on a logarithmic scale (a row for each step): no more than
    # `table` words are at or above it, so no more come to the driver.
    step = F.floor(F.log2("c") * 16).cast("int")
    # Words of more than 64 bytes stay in the open class too, so the table has a bound in bytes.
    short = F.length("word") <= 64
    steps = counts.where(short & (F.col("c") > 1)).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    room, least = table, 1 << 30
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    top = counts.where((short & (F.col("c") > 1) & (step >= least)) | (F.length("word") == 0)).collect()
    top.sort(key=lambda r: (-r.c, r.word))
    words, c = [bytes(r.word) for r in top], np.array([r.c for r in top], float)
    if END not in words:  # no training rows, or the end is rare: it stays in the table
        words.append(END)
        c = np.append(c, float(next((r.c for r in counts.where(F.length("word") == 0).collect()), 0)) or 1e-9)
    t = frequent_table(words, c, n)
    if not n:
        t.plus[:] = 0
    with small_batches(docs.sparkSession):
        coded = save(in_numbers(d, t), "coded")
    net = fit(coded.where("training"), t, Gru(t), n, **fitting)
    open_n, open_v = max(0, n - int(c.sum())), max(0, v - len(words))
    tail = coded.where("n_open > 0").select("row", F.explode("open").alias("word")).join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail"), F.count("c").alias("known"))
    all_ = scored(coded, t, net).join(tail, "row", "left").na.fill(0, ["tail", "known"])
    has = F.lit(1 if n else 0)
    return all_.select("doc_id", "training", "n_tokens", ((F.col("n_tokens") - F.col("n_open")) * has + F.col("known")).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("plus") + F.col("tail") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (F.col("lm") + F.col("tail") - F.col("n_open") * F.log10(F.lit(float(open_n + open_v + 1)))).alias("score"))
