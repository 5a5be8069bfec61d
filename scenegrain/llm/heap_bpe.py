"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scenegrain.llm.chunks import SPACES, Pieces, TwoGenerations, cuttable

#: Fixed value: how byte-level vocabularies write bytes as characters: printable ones as themselves, the rest from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_chars() -> dict[int, str]:
    rest = (b for b in range(256) if b not in set(PRINTABLE))
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merged_count(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Initial symbols minus merges.

    `ranks` has (rank, merged symbol) of each pair. The heap holds adjacent pairs by rank, then position; `after` and
    `before` link the living symbols. An entry is stale if either symbol has changed since it was pushed.
    """
    n = len(symbols)
    if n < 2:
        return n
    sym = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r[0], i, r[1], a, b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (r := ranks.get((a, b)))]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, made, a, b = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        merges += 1
        sym[i], sym[j] = made, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if r := ranks.get((made, sym[k])):
                heapq.heappush(heap, (r[0], i, r[1], made, sym[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((sym[h], made))):
            heapq.heappush(heap, (r[0], h, r[1], sym[h], made))
    return n - merges


class Counter:
    """Counts tokens as the library does for a byte-level BPE file; built once in each Python worker."""

    def __init__(self, path: str, cache: int = 70_000_000):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, chars, vocab = spec["model"], byte_chars(), spec["model"]["vocab"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normalizer are handled")
        self.ids = [vocab[chars[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        self.cut = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        self.parts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache = TwoGenerations(cache)

    def plain(self, text: str) -> int:
        ids, ranks = self.ids, self.ranks
        return sum(merged_count([ids[b] for b in w.encode()], ranks) for w in self.cut.findall(text))

    def whole(self, text: str) -> int:
        """Special strings are one token each and split the text."""
        if not self.parts or not any(s in text for s in self.special):
            return self.plain(text)
        return len(self.parts.findall(text)) + sum(self.plain(x) for x in self.parts.split(text))

    def counts(self, texts: list[str]) -> list[int]:
        cut = [cuttable(t, self.special) for t in texts]
        p = Pieces.of([c for c in cut if c is not None])
        n = self.cache.values_of(p.all(), lambda new: list(map(self.plain, new)))
        sums = iter(np.add.reduceat(np.array(n, np.int64)[p.which], p.heads).tolist() if n else ())
        return [self.whole(t) if c is None else next(sums) for t, c in zip(texts, cut)]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def batches(texts: list[str], chars: int = 2_000_000):
    """Runs of texts of about so many characters: bounds what a task holds at once."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def token_count(text: Column, path: str) -> Column:
    """Column of the number of tokens of `text` (null: empty) under the tokenizer file at `path`."""

    @pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series([n for part in batches([t or "" for t in s], 4_000_000) for n in c.counts(part)], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of `docs`, in place, without a shuffle.

    Null and empty texts have 0 bytes and tokens; repeated rows stay; null ids stay; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
