"""Token ids in a file format of byte or bit planes.

A file is a Parquet table whose rows are chunks. A chunk holds whole documents in ascending doc_id order: their ids
are cut into blocks of a fixed size (the last one padded with 0), each block is transposed into planes, and each plane
is compressed with zstandard on its own. `planes` has the planes of all blocks, `plane_ends` where each ends. A second
table, the chunk index, has for each chunk its shard, place, first and last document, number of documents and ids, and
the number of ids before it in its shard.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenegrain.llm.chunks import SPACES, Pieces, cuttable, releasing, spaced
from scenegrain.llm.heap_bpe import batches, byte_chars
from scenegrain.llm.rows import small_batches

CHUNK = "shard int, chunk int, n_ids long, before long, block int, width int, bit_planes boolean, doc_ids array<long>, doc_sizes array<int>, plane_ends array<int>, planes binary"


#: Letters of the Latin blocks that all versions of Unicode have, and common punctuation.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,;:!?"
#: A word that the split pattern parts from the mark behind it and the line feed before it, whatever is around.
PLAIN = rf"^\n?[{LETTERS}]+[{MARKS}]?$"
#: A piece without white space inside: it can stand beside others.
SOLID = f"^\n?[^{SPACES}\x1c-\x1f]+$"


def ranges(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of all the pairs, one after another."""
    start, size = start[size > 0], size[size > 0]
    if not len(size):
        return pool[:0]
    ends = np.cumsum(size, dtype=np.int32)  # a batch has far fewer than 2^31 ids
    step = np.ones(int(ends[-1]), np.int32)
    step[ends - size] = start - np.append(0, start + size - 1)[:-1]
    return pool[np.cumsum(step, dtype=np.int32, out=step)]


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each different piece of a batch once.

    Pieces are handed to the library in runs and their ids cut where a token starts with the space mark or is the line
    feed, which stand in front of a piece and nowhere else. Plain words of a byte-level vocabulary go to it without the
    mark behind them and split already, others joined; pieces with white space inside go one by one. Nothing is kept from
    batch to batch.
    """

    def __init__(self, path: str, run: int = 2000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.bare = Tokenizer(self.lib.model)  # the same model, without anything before it
        pre = self.lib.pre_tokenizer
        byte_level = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.lib.normalizer is None
        self.special = tuple(t.content for t in self.lib.get_added_tokens_decoder().values())
        self.run = run if byte_level and not any(" " in s or "\n" in s for s in self.special) else 0
        self.chars = byte_chars()
        names = map(self.lib.id_to_token, range(self.lib.get_vocab_size(with_added_tokens=True)))
        self.heads = np.array([t is not None and (t[:1] == self.chars[32] or t == self.chars[10]) for t in names])
        behind = self.encode(list(MARKS)) if self.run else []
        self.behind = np.array([x[0] for x in behind], "<u4")
        self.run = self.run if all(len(x) == 1 for x in behind) else 0

    def encode(self, texts: list, lib=None, **names) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in (lib or self.lib).encode_batch_fast(texts, add_special_tokens=False, **names)]

    def split(self, words: list[str]) -> np.ndarray:
        """Ids of words that start with a space or a line feed, one after another."""
        mapped = "\0".join(words).replace("\n", "\n\0").encode().decode("latin-1").translate(self.chars)
        return self.encode([mapped.split(self.chars[0])], self.bare, is_pretokenized=True)[0]

    def in_runs(self, words: list[str], ids_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, number) of words that start with a space or a line feed; a run that can't be cut goes one by one."""
        start, size, pool, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32), [], 0
        for s in range(0, len(words), self.run or 1):
            part = words[s : s + (self.run or 1)]
            ids = ids_of(part)
            cut = np.append(np.flatnonzero(self.heads[ids]), len(ids))
            if len(cut) != len(part) + 1:
                each = self.encode(part)
                ids, cut = np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))
            start[s : s + len(part)], size[s : s + len(part)] = cut[:-1] + total, np.diff(cut)
            pool.append(ids)
            total += len(ids)
        return np.concatenate(pool) if pool else np.zeros(0, "<u4"), start, size

    def pooled(self, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, number) of all different pieces: the values, then the firsts."""
        n = len(p.values)
        plain = pc.match_substring_regex(p.values, PLAIN).to_numpy(zero_copy_only=False) & bool(self.run)
        solid = pc.match_substring_regex(p.values, SOLID).to_numpy(zero_copy_only=False) & ~plain & bool(self.run)
        start, size, pool, total = np.zeros(n + len(p.firsts), np.int32), np.zeros(n + len(p.firsts), np.int32), [], 0

        def put(at, ids, first, count):
            nonlocal total
            start[at], size[at] = first + total, count
            pool.append(ids)
            total += len(ids)

        words = p.values.filter(pa.array(plain))
        stems = pc.utf8_rtrim(words, characters=MARKS)
        coded = stems.dictionary_encode()
        ids, first, count = self.in_runs(spaced(coded.dictionary), self.split)
        which = coded.indices.to_numpy(zero_copy_only=False)
        # A word is its stem and, if there is one, the mark behind it.
        mark = pc.index_in(pc.utf8_slice_codeunits(words, -1), pa.array(list(MARKS), pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(count[which] + (mark >= 0))
        made = np.empty(ends[-1] if len(ends) else 0, "<u4")
        last = np.zeros(len(made), bool)
        last[ends[mark >= 0] - 1] = True
        made[last], made[~last] = self.behind[mark[mark >= 0]], ranges(ids, first[which], count[which])
        put(np.flatnonzero(plain), made, ends - count[which] - (mark >= 0), count[which] + (mark >= 0))
        put(np.flatnonzero(solid), *self.in_runs(spaced(p.values.filter(pa.array(solid))), lambda part: self.encode(["".join(part)])[0]))
        rest = ~(plain | solid)
        each = self.encode(spaced(p.values.filter(pa.array(rest))) + p.firsts)
        count = np.array([len(x) for x in each], np.int64)
        put(np.append(np.flatnonzero(rest), np.arange(n, len(size))), np.concatenate(each) if each else np.zeros(0, "<u4"), np.cumsum(count) - count, count)
        return np.concatenate(pool), start, size

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cut = [cuttable(t, self.special) for t in texts]
        whole = iter(self.encode([t for t, c in zip(texts, cut) if c is None]))
        is_whole = [c is None for c in cut]
        p = Pieces.of([c for c in cut if c is not None])
        del cut
        pool, start, size = self.pooled(p)
        n, start = size[p.which], start[p.which]
        ends = np.append(0, np.cumsum(n))[np.append(p.heads[1:], len(n))] if len(p.heads) else p.heads
        del p
        parts = iter(np.split(ranges(pool, start, n), ends[:-1]))
        return [next(whole) if w else next(parts) for w in is_whole]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def split_planes(ids: np.ndarray, block: int, width: int, bits: bool) -> list[bytes]:
    """Planes of the blocks of `ids` (unsigned, `width` bytes each): byte planes, or 8 times as many bit planes."""
    n = -(-len(ids) // block)
    cells = np.zeros(n * block, "<u4")
    cells[: len(ids)] = ids
    by = cells.view(np.uint8).reshape(n, block, 4)[:, :, :width]
    if not bits:
        return [np.ascontiguousarray(by[i, :, k]).tobytes() for i in range(n) for k in range(width)]
    return [np.packbits((by[i, :, k] >> b) & 1, bitorder="little").tobytes() for i in range(n) for k in range(width) for b in range(8)]


def join_planes(planes: list[bytes], n_ids: int, block: int, width: int, bits: bool) -> np.ndarray:
    n = -(-n_ids // block)
    by = np.zeros((n, block, 4), np.uint8)
    for i in range(n):
        for k in range(width):
            if not bits:
                by[i, :, k] = np.frombuffer(planes[i * width + k], np.uint8)
            else:
                for b in range(8):
                    by[i, :, k] |= np.unpackbits(np.frombuffer(planes[(i * width + k) * 8 + b], np.uint8), count=block, bitorder="little") << b
    return by.reshape(-1).view("<u4")[:n_ids]


def packed(shard: int, chunk: int, before: int, docs: list, parts: list[np.ndarray], block: int, bits: bool, level: int) -> dict:
    import zstandard

    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    width = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    z = zstandard.ZstdCompressor(level=level)
    planes = [z.compress(p) for p in split_planes(ids, block, width, bits)]
    return {"shard": shard, "chunk": chunk, "n_ids": len(ids), "before": before, "block": block, "width": width, "bit_planes": bits, "doc_ids": docs, "doc_sizes": [len(p) for p in parts], "plane_ends": np.cumsum([len(p) for p in planes]).tolist(), "planes": b"".join(planes)}


def write_planes(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, block: int = 16_384, chunk_ids: int = 262_144, bits: bool = False, level: int = 1, batch_chars: int = 12_000_000, shard_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes `path`/chunks and `path`/index with Spark's writers.

    Documents are dealt by ranges of doc_id and their text's hash, one shard a task; so rows of one id, or without an id,
    may be in several shards. There are as many shards as the session has shuffle partitions, and more if they would hold
    over `shard_bytes` bytes of text on average. A chunk is closed after the document with which it reaches `chunk_ids` ids, however long
    that is. A task encodes about `batch_chars` characters at once: more find more repeated pieces, fewer take less memory;
    the files are the same. Null texts are empty (only the end id), null ids come first, equal ids are ordered by their text's hash. An
    empty table gives empty files. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = d.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("before", pa.int64()), ("block", pa.int32()), ("width", pa.int32()), ("bit_planes", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int32())), ("plane_ends", pa.list_(pa.int32())), ("planes", pa.binary())])

    def encode(rows):
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], "<u4")
        chunk = before = held = 0
        ids, parts = [], []
        for batch in rows:
            keys = batch.column(0).to_pylist()
            at = 0
            for texts in batches(batch.column(1).to_pylist(), batch_chars):
                out = []
                for key, x in zip(keys[at : at + len(texts)], enc.ids(texts)):
                    ids.append(key)
                    parts.append(np.concatenate((x, end)))
                    held += len(parts[-1])
                    if held >= chunk_ids:
                        out.append(packed(shard, chunk, before, ids, parts, block, bits, level))
                        chunk, before, held, ids, parts = chunk + 1, before + held, 0, [], []
                at += len(texts)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
        if ids:
            yield pa.RecordBatch.from_pylist([packed(shard, chunk, before, ids, parts, block, bits, level)], schema)

    with small_batches(docs.sparkSession, max(1, batch_chars // 3000)):
        dealt.mapInArrow(releasing(encode), CHUNK).write.option("compression", "none").parquet(f"{path}/chunks")
    read = docs.sparkSession.read.schema(CHUNK).parquet(f"{path}/chunks")
    index = read.select("shard", "chunk", F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"), F.size("doc_ids").alias("n_docs"), "n_ids", "before")
    index.write.parquet(f"{path}/index")


def unpacked(row: dict) -> np.ndarray:
    import zstandard

    z, ends = zstandard.ZstdDecompressor(), [0, *row["plane_ends"]]
    raw = [z.decompress(row["planes"][a:b]) for a, b in zip(ends, ends[1:])]
    return join_planes(raw, row["n_ids"], row["block"], row["width"], row["bit_planes"])


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base): the ids before each shard, from the chunk index: a row for each shard, however many documents."""
    sums = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return sums.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_planes(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def decode(rows):
        for batch in rows:
            for row in batch.to_pylist():
                ids, at = unpacked(row), 0
                out = {k: [] for k in schema.names}
                for doc, n in zip(row["doc_ids"], row["doc_sizes"]):
                    x = ids[at : at + n]
                    for k, v in zip(schema.names, (doc, row["shard"], row["before"] + at, n, zlib.crc32(x.tobytes()), x.tolist() if with_ids else None)):
                        out[k].append(v)
                    at += n
                yield pa.RecordBatch.from_pydict(out, schema)

    docs = spark.read.schema(CHUNK).parquet(f"{path}/chunks").mapInArrow(releasing(decode), "doc_id long, shard int, at long, n_tokens long, ids_crc32 long, ids array<long>")
    at = docs.join(shard_starts(spark, path), "shard").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return at if with_ids else at.drop("ids")
