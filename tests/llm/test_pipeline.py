import collections

from pyspark.sql import functions as F

import corpus_pipeline as p
from scenegrain.llm.queries import ORACLES, QUERIES

from . import fixtures as fx


def test_stages_on_awkward_documents(spark, tmp_path):
    docs = fx.documents(spark)
    bench = spark.createDataFrame([(1, " ".join(fx.texts()[4].split()[:20]))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = ([r.doc_id for r in x.select("doc_id").collect()] for x in (docs, out))
        if name == "language_id":
            rows = {r.doc_id: r.text for r in docs.collect()}
            dropped = collections.Counter(before) - collections.Counter(after)
            assert all(not any(map(str.isalpha, rows[i] or "")) for i in dropped)
        if name == "jaccard_dedup":
            check_dedup(docs.collect(), out.collect())
        if name == "decontamination":
            item = [(1, " ".join(fx.texts()[4].split()[:20]))]
            assert set(after) == {r.doc_id for r in docs.collect() if not fx.contamination(r.text, item)[-1]}
        docs = out
    assert docs.count() == len(after) and docs.where(F.col("n_tokens") < 1).isEmpty()


def check_dedup(before, after):
    """One row of each group stays, the first by id (null last); rows without words all stay."""
    rows = [(r.doc_id, fx.shingles(r.text)) for r in before]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][1] and rows[b][1] and 100 * len(rows[a][1] & rows[b][1]) >= 75 * len(rows[a][1] | rows[b][1])]
    groups = collections.defaultdict(list)
    for k, c in enumerate(fx.components(len(rows), near)):
        groups[c].append(k)
    want = collections.Counter(min((rows[k][0] is None, rows[k][0] or 0) for k in g) for g in groups.values())
    assert collections.Counter((r.doc_id is None, r.doc_id or 0) for r in after) == want


NAMES = "doc_id long, text string, source string, h string, key string, found string, language string, n string, at string, round string, total string, stays string, salt string, first string, _found string"


def awkward_rows(spark):
    a, b, c = ("one two three four five six seven eight nine ten " * 3 + x for x in ("end", "stop", "last"))
    rows = [(1, a), (1, a), (1, a), (1, "quite another text with the same id as the one before it"), (2, b), (None, c), (None, c), (None, "no id and no copy of this text anywhere else at all"), (None, None), (None, None), (3, ""), (4, "x y"), (4, "x y")]
    return spark.createDataFrame([(i, t, "s", *["clash"] * 12) for i, t in rows], NAMES)


def test_dedup_keeps_one_row_of_each_group(spark):
    docs = awkward_rows(spark)
    out = p.jaccard_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    check_dedup(docs.collect(), got)
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "3", "4", "None", "None", "None"]


def test_mix_and_decontamination_of_awkward_rows(spark, tmp_path):
    docs = awkward_rows(spark)
    out = p.source_mix(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()  # one source: its target is its size
    two = docs.union(docs.where("doc_id = 1").withColumn("source", F.lit("t")))
    words = F.coalesce(F.size(F.expr("filter(split(text, ' '), x -> x <> '')")), F.lit(0))
    got = {r.source: r.n for r in p.source_mix(spark, two, "").groupBy("source").agg(F.sum(words).alias("n")).collect()}
    size = {r.source: r.n for r in two.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    total = sum(size.values())
    target = {"t": min(3 * size["t"], total * 2 / 3)}
    target["s"] = total - target["t"]
    assert all(abs(got[k] - target[k]) <= 40 for k in got)
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = p.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == 7


def test_empty_documents(spark, tmp_path):
    fx.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
