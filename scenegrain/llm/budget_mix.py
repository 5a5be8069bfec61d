"""Mixing sources to target weights by fitting subset sums to word budgets.

Documents are counted by source, exact length and a slice of a seeded hash. Each source takes whole rounds of all its
documents while they fit its target, then documents whose lengths sum to the rest as nearly as can be, by a bounded
knapsack in dynamic programming: an even share of every length if that meets the target, else whatever meets it best.
The documents of a length are taken in the order of the hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.llm.rows import free_names, numbered, text_hash
from scenegrain.sources.tables import save

WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds `weight` to one row per source: weights repeat along the sources by code point, null last.

    Sources are dealt by ranges and numbered from the offsets of the partitions.
    """
    n = sizes.sparkSession.sparkContext.defaultParallelism
    order = F.col("source").asc_nulls_last()
    dealt = save(sizes.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33)), "sources")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("start"))
    rank = (F.col("at") + F.col("start")) % len(weights)
    return dealt.join(F.broadcast(starts), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("double")).drop("part", "at", "start")


def targets(sizes: DataFrame, limit: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds `target` to (source, source_size): shares of the total by weight; a target stops at `limit` times its
    source's size, and the excess is shared again by weight until none is above."""
    d = source_weights(sizes, weights).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    total = float(d.agg(F.sum("source_size")).first()[0] or 0)
    d = save(d.withColumn("capped", F.lit(False)), "targets")
    while True:
        left, weight = d.agg(F.lit(total) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0.0))).first()
        level = left / weight if weight else 0.0
        over = ~F.col("capped") & (F.lit(level) * F.col("weight") > F.col("cap"))
        if d.where(over).isEmpty():
            return d.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))).drop("cap", "capped", "weight")
        d = save(d.withColumn("capped", F.col("capped") | over), "targets")


def nearest(lengths: list[int], copies: list[int], goal: int) -> list[int]:
    """How many of each length to take so that the sum is the nearest to `goal` that can be reached, the smaller in a tie.

    A bounded knapsack: bit b of a row is set if b words can be reached with the lengths so far; rows are kept, to find
    the numbers again. Sums beyond twice the goal are farther from it than 0.
    """
    total = sum(a * n for a, n in zip(lengths, copies))
    if goal <= 0 or goal >= total:
        return [n if goal > 0 else 0 for n in copies]
    most = min(total, 2 * goal)
    items = []  # (index, copies): binary splitting of the copies that fit
    for i, a in enumerate(lengths):
        left, k = (min(copies[i], most // a), 1) if 0 < a <= most else (0, 1)
        while left:
            items.append((i, min(k, left)))
            left -= items[-1][1]
            k *= 2
    mask, rows = (1 << (most + 1)) - 1, [1]
    for i, k in items:
        rows.append((rows[-1] | (rows[-1] << (k * lengths[i]))) & mask)
        if rows[-1] >> goal & 1:
            break
    below = (rows[-1] & ((1 << (goal + 1)) - 1)).bit_length() - 1
    over = rows[-1] >> goal
    above = goal + (over & -over).bit_length() - 1 if over else most + 1
    at = above if above - goal < goal - below else below
    take = [0] * len(lengths)
    for row, (i, k) in reversed(list(zip(rows, items[: len(rows) - 1]))):
        if not row >> at & 1:
            at -= k * lengths[i]
            take[i] += k
    return take


def even(lengths: list[int], counts: list[int], budget: int, bound: int) -> list[int]:
    """The same share of each length, then the longest that fit while the rest is above `bound`, then a knapsack."""
    total = sum(a * n for a, n in zip(lengths, counts))
    take = [n * budget // total for n in counts]
    rest = budget - sum(a * k for a, k in zip(lengths, take))
    for i in sorted((i for i, a in enumerate(lengths) if a), key=lambda i: -lengths[i]):
        if rest <= bound:
            break
        k = min(counts[i] - take[i], (rest - bound + lengths[i] - 1) // lengths[i], rest // lengths[i])
        take[i] += k
        rest -= k * lengths[i]
    return [k + x for k, x in zip(take, nearest(lengths, [n - k for n, k in zip(counts, take)], rest))] if rest <= bound else take


def coarse(lengths: list[int], counts: list[int], goal: int, work: int, spare: int = 2) -> list[int]:
    """About `goal` words: the same share of each length, of which up to `spare` copies are taken back and as many more may
    be added, by a knapsack over words scaled so that its rows have `work` bits at most."""
    total = sum(a * n for a, n in zip(lengths, counts))
    if goal <= 0 or goal >= total:
        return [n if goal > 0 else 0 for n in counts]
    base = [max(0, n * goal // total - spare) for n in counts]
    free = [min(n - k, 2 * spare) for n, k in zip(counts, base)]
    words = sum(a * n for a, n in zip(lengths, free))
    items = sum(n.bit_length() for n in free)
    unit = max(1, words * items // work)
    rest = goal - sum(a * k for a, k in zip(lengths, base))
    return [k + x for k, x in zip(base, nearest([max(1, round(a / unit)) for a in lengths], free, round(rest / unit)))]


def fitted(lengths: list[int], counts: list[int], budget: int, bound: int = 20_000, work: int = 1 << 29) -> list[int]:
    """How many of each length to take so that the sum comes as near to `budget` as it can.

    An even choice that meets the budget is taken as it is. Otherwise nothing of it stands: a knapsack over all copies finds
    the best sum there is, as long as its rows have `work` bits at most (for 1000 documents, about 500,000 words). Beyond, the
    longer ones are chosen by a scaled knapsack and the short ones exactly for what these leave; the better choice counts.
    """
    total = sum(a * n for a, n in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    take = even(lengths, counts, budget, bound)
    error = lambda t: abs(sum(a * k for a, k in zip(lengths, t)) - budget)
    if not error(take):
        return take
    pool, size, items = [0] * len(lengths), 0, 0
    for i in sorted((i for i, a in enumerate(lengths) if a and counts[i]), key=lambda i: lengths[i]):
        n = counts[i]
        while n and (size + lengths[i] * n) * (items + n.bit_length()) > work:
            n //= 2
        pool[i], size, items = n, size + lengths[i] * n, items + n.bit_length()
        if n < counts[i]:
            break
    rest = [n - k if a else 0 for a, n, k in zip(lengths, counts, pool)]
    far = [i for i, n in enumerate(rest) if n]
    other = [0] * len(lengths)
    if far:
        goal = budget * sum(lengths[i] * rest[i] for i in far) // total
        for i, k in zip(far, coarse([lengths[i] for i in far], [rest[i] for i in far], goal, work)):
            other[i] = k
    fine = nearest(lengths, pool, budget - sum(a * k for a, k in zip(lengths, other)))
    both = [k + x for k, x in zip(other, fine)]
    return min(take, both, key=error)


def slices(n: int) -> int:
    """Slices of the hash: no group of a source and length, even with a third of `n` rows, has a large slice."""
    return max(64, 1 << (int(n) // 100_000).bit_length())


def row_takes(docs: DataFrame, limit: int = 3, weights: tuple[int, ...] = WEIGHTS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, text_h (the text's hash), size, source_size, target, copies: one row for each row of `docs`."""
    text_h = text_hash(F.col(text_col))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), text_h.alias("text_h"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), text_h).alias("h"))
    d = save(d, "sizes")
    parts = slices(d.count())
    d = d.withColumn("slice", F.pmod("h", F.lit(parts)))
    hist = save(d.groupBy("source", "size", "slice").agg(F.count("*").alias("n")), "hist")
    by = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = save(targets(by, limit, weights), "targets")
    lengths = hist.groupBy("source", "size").agg(F.sum("n").alias("n"))
    both = lengths.join(goal, lengths.source.eqNullSafe(goal.source)).select(lengths.source, "size", "n", "source_size", "target")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        total, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        rounds = min(limit, int(target // total)) if total else 1
        rest = max(0, round(target) - rounds * total) if rounds < limit else 0
        extra = fitted([int(x) for x in pdf["size"]], [int(x) for x in pdf.n], rest)
        extra = [0 if not a else k for a, k in zip(pdf["size"], extra)]
        return pd.DataFrame({"source": pdf.source, "size": pdf["size"], "rounds": rounds, "extra": extra})

    # One row for each length of a source: bounded by the longest text, not by the number of documents.
    plan = both.groupBy("source").applyInPandas(fit, "source string, size long, rounds long, extra long")
    p = plan.withColumnsRenamed({"source": "s", "size": "z"})
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = hist.withColumn("before", before).join(p, hist.source.eqNullSafe(F.col("s")) & (hist["size"] == F.col("z"))).join(goal.withColumnRenamed("source", "gs"), hist.source.eqNullSafe(F.col("gs")))
    shares = shares.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("slice").alias("c"), "rounds", (F.col("extra") - F.col("before")).alias("quota"), "source_size", "target")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("h", "doc_id")))
    out = ranked.join(shares, ranked.source.eqNullSafe(F.col("s")) & (ranked["size"] == F.col("z")) & (ranked.slice == F.col("c")))
    copies = (F.col("rounds") + (F.col("rank") <= F.col("quota")).cast("long")).cast("long")
    return out.select("doc_id", "source", "text_h", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **names) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of `docs`.

    `copies` is how often the mix takes the row, `taken` its words. Null sources are one source, the last. Null and empty
    texts have size 0: rows without words take nothing of a budget; they come once for each whole round. A very long text
    is taken if it fits what is left. Rows of equal id, source and text are rows of their own, which the hash can't tell
    apart; ranks do. An empty table gives an empty one.
    """
    return row_takes(docs, **names).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, **names) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them.

    Rows are told apart by id, source and text. What is taken of equal rows is dealt out among them as evenly as can be.
    """
    id_col, text_col, source_col = names.get("id_col", "doc_id"), names.get("text_col", "text"), names.get("source_col", "source")
    h, key, n, total, at, round_ = free_names(docs, "h", "key", "n", "total", "at", "round")
    takes = row_takes(docs, **names).groupBy("doc_id", "source", "text_h").agg(F.count("*").alias(n), F.sum("copies").alias(total)).where(F.col(total) > 0)
    takes = save(takes.select(F.struct("doc_id", "source", "text_h").alias(key), n, total), "takes")
    own = docs.withColumn(h, text_hash(F.col(text_col)))
    own_key = F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(h).alias("text_h"))

    def repeated(rows, copies):
        return rows.withColumn(round_, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*docs.columns)

    single, several = takes.where(F.col(n) == 1), takes.where(F.col(n) > 1)
    out = repeated(own.join(single, own_key.eqNullSafe(F.col(key))), F.col(total))
    if several.isEmpty():
        return out
    rows = numbered(own.join(several, own_key.eqNullSafe(F.col(key))).drop(key), [id_col, source_col, h], at)
    share = F.floor(F.col(total) / F.col(n)) + (F.col(at) <= F.col(total) % F.col(n)).cast("long")
    return out.union(repeated(rows.where(share > 0), share))
