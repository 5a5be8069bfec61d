"""Language identification by a convolutional network over bytes, in numpy.

A window of fixed length is a run of bytes of the text. Bytes have small embeddings; filters of several widths run
over them; each filter's largest value goes through a rectifier into a softmax over the languages. A text is cut into
windows, all of which count: its score is the mean of the windows' log probabilities, by their number of bytes.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scenegrain.llm.chunks import release
from scenegrain.llm.heap_bpe import batches

WINDOW = 256


def cut_windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, owner, bytes in each): every byte of every text is in exactly one window; 0 pads the last."""
    n = np.array([len(t) for t in texts])
    k = -(-n // size)
    padded = b"".join(t.ljust(int(m) * size, b"\0") for t, m in zip(texts, k))
    w = np.frombuffer(padded, np.uint8).reshape(-1, size)
    owner = np.repeat(np.arange(len(texts)), k)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)
    return w, owner, np.minimum(size, n[owner] - place * size)


class Net:
    """Parameters: emb (256, e); for each width w conv (w * e, f); dense (f * widths, classes) and bias."""

    def __init__(self, labels: list[str], widths=(2, 3, 4), filters: int = 16, emb: int = 4, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.widths, self.f, self.e = labels, widths, filters, emb
        p = {"emb": r.normal(0, 0.5, (256, emb))}
        for w in widths:
            p[f"c{w}"] = r.normal(0, 1 / np.sqrt(w * emb), (w * emb, filters))
        p["out"] = r.normal(0, 0.1, (filters * len(widths), len(labels)))
        p["bias"] = np.zeros(len(labels))
        p["shift"] = np.zeros(filters * len(widths))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def features(self, win: np.ndarray, where: bool = False):
        x = self.p["emb"][win].reshape(len(win), -1)
        tops, at = [], []
        for w in self.widths:
            n = win.shape[1] - w + 1
            s0, s1 = x.strides
            cols = np.lib.stride_tricks.as_strided(x, (len(win), n, w * self.e), (s0, s1 * self.e, s1))
            y = (cols.reshape(-1, w * self.e) @ self.p[f"c{w}"]).reshape(len(win), n, self.f)
            tops.append(y.max(1))
            if where:
                at.append(y.argmax(1))
        return np.concatenate(tops, 1) + self.p["shift"], at

    def log_probs(self, win: np.ndarray) -> np.ndarray:
        h, _ = self.features(win)
        z = np.maximum(h, 0) @ self.p["out"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, win: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 3e-3, seed: int = 7) -> None:
        """Softmax regression loss by Adam; the gradient of a maximum goes to the place that had it."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(win))
            for s in range(0, len(order), batch):
                b = order[s : s + batch]
                h, at = self.features(win[b], True)
                act = np.maximum(h, 0)
                z = act @ self.p["out"] + self.p["bias"]
                pr = np.exp(z - z.max(1, keepdims=True))
                pr /= pr.sum(1, keepdims=True)
                pr[np.arange(len(b)), y[b]] -= 1
                pr /= len(b)
                dh = (pr @ self.p["out"].T) * (h > 0)
                g = {"out": act.T @ pr, "bias": pr.sum(0), "shift": dh.sum(0), "emb": np.zeros_like(self.p["emb"])}
                for i, w in enumerate(self.widths):
                    d = dh[:, i * self.f : (i + 1) * self.f]
                    at_byte = win[b][np.arange(len(b))[:, None, None], at[i][:, :, None] + np.arange(w)]  # (n, f, w)
                    e = self.p["emb"][at_byte].reshape(len(b), self.f, w * self.e)
                    g[f"c{w}"] = np.einsum("nf,nfk->kf", d, e)
                    back = (d[:, :, None] * self.p[f"c{w}"].T[None]).reshape(-1, self.e)
                    np.add.at(g["emb"], at_byte.reshape(-1), back)
                step += 1
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    q[k] += 0.001 * (g[k] * g[k] - q[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def clean(text: str | None) -> bytes:
    """Bytes of the text, lower-cased: what the network sees."""
    return (text or "").lower().encode("utf-8", "replace")


def learn(docs: DataFrame, train: Column, per_label: int = 300, most_bytes: int = 64_000_000, epochs: int = 6, text_col: str = "text", lang_col: str = "lang") -> Net:
    """Trains on a bounded sample of labelled rows, each with its whole text.

    The bound: of each language the texts with the smallest hashes, different ones with a letter, at most `per_label` of
    them and no more once they fill the language's share of `most_bytes`, but one at least. All windows of these texts are
    fitted on. From the counts of different texts follows a share of hashes that holds about twice per_label of each; only
    those are ranked, and only the sample comes to the driver. Languages of which fewer were drawn than there are are drawn
    again with a larger share. What is sampled grows with the number of languages alone.
    """
    d = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), train.alias("t")).where("t AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("h"))
    sizes = {r.lang: r.n for r in d.groupBy("lang").agg(F.countDistinct(lettered).alias("n")).collect()}
    langs, texts, y, full = sorted(sizes), [], [], 1 << 31
    room = most_bytes // max(1, len(sizes))
    number = {k: i for i, k in enumerate(langs)}
    shares = {k: min(full, -(-(2 * per_label + 20) * full // n)) for k, n in sizes.items() if n}
    while shares:
        share = docs.sparkSession.createDataFrame(list(shares.items()), "of string, share long")
        share = F.broadcast(share) if len(shares) <= 10_000 else share  # else as Spark sees fit
        drawn = d.join(share, F.col("lang") == F.col("of")).where((F.pmod("h", F.lit(full)) < F.col("share")) & lettered.isNotNull()).dropDuplicates(["lang", "h"])
        before = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(full)), "h").rowsBetween(Window.unboundedPreceding, -1)
        ranked = drawn.select("lang", "text", "h", F.count("*").over(before).alias("rank"), F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).alias("bytes"))
        got: dict[str, list[str]] = {k: [] for k in shares}
        closed = set()
        for r in sorted(ranked.where((F.col("rank") < per_label) & (F.col("bytes") < room)).collect(), key=lambda r: (r.lang, r["rank"])):
            got[r.lang].append(r.text)
            if r.bytes + len(r.text.encode()) >= room:
                closed.add(r.lang)
        again = {k: min(full, 2 * s) for k, s in shares.items() if len(got[k]) < min(per_label, sizes[k]) and s < full and k not in closed}
        for k in sorted(got.keys() - again.keys()):
            texts += map(clean, got[k])
            y += [number[k]] * len(got[k])
        shares = again
    net = Net(langs)
    if texts:
        w, owner, _ = cut_windows(texts)
        net.train(w, np.array(y)[owner], epochs)
    return net


def identify(net: Net, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not net.labels or not at:
        return langs, scores
    k = 0
    for part in batches([texts[i] for i in at], 1_000_000):
        w, owner, n = cut_windows([clean(t) for t in part])
        lp = np.concatenate([net.log_probs(w[s : s + 64]) for s in range(0, len(w), 64)])
        total = np.zeros((len(part), len(net.labels)))
        np.add.at(total, owner, lp * n[:, None])
        mean = total / np.bincount(owner, n, len(part))[:, None]
        pr = np.exp(mean - mean.max(1, keepdims=True))
        pr /= pr.sum(1, keepdims=True)
        for i, row in zip(at[k : k + len(part)], pr):
            langs[i], scores[i] = net.labels[int(row.argmax())], float(min(1.0, row.max()))
        k += len(part)
    return langs, scores


def language(net: Net, text: Column) -> Column:
    """Struct (lang, score) of the whole text: `und` and 0 for null texts and those without a letter."""

    @pandas_udf("lang string, score double")
    def predict(s: pd.Series) -> pd.DataFrame:
        lang, score = identify(net, [None if t is None else t for t in s])
        release()
        return pd.DataFrame({"lang": lang, "score": score})

    return predict(text)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def predict_languages(docs: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the folds that aren't held out and labels every row.

    Only texts are inputs of a prediction. Without labelled rows all are `und`. Repeated rows stay, an empty table
    gives an empty one, other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", crc_fold(F.col("doc_id"), folds) == held_out)
    net = learn(d, ~F.col("held_out"))
    return d.select("doc_id", "held_out", language(net, F.col("text")).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
