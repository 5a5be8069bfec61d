"""Toxicity, whitening and lexical search against brute force."""

import collections
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrain.llm import lexical_scan, toxic_grammar, whitening
from scenegrain.llm.queries import op11_toxic_grammar

from . import fixtures as fx

SF = "/root/testdata/sf0.1"


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fx.LOWER))


def ranked(docs, items, k):
    """(item_id, rank, doc_id, score) for (id, text) rows, by the rule as it stands."""
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        got = []
        for i, c in own:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(1, total)
            s = 0
            for w in set(terms(text)):
                if c[w]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
            if s:
                got.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).repartition(3).cache()


def test_op13_brute_force(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "The river, ÉTÉ and w3 w4"), (2, None), (3, "..."), (None, "w1 w2 naïve"), (1, "stone 漢字 w59"), (5, "nowhereatall"), (6, "the the THE")]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, score string, rank int")
    for most_items, piece, sums in ((2000, 4_000_000, 2_000_000), (1, 500, 7)):
        monkeypatch.setattr(lexical_scan, "PIECE", piece)
        monkeypatch.setattr(lexical_scan, "SUMS", sums)
        got = lexical_scan.ranked_search(docs, bench, k=4, most_items=most_items).collect()
        assert sorted(map(tuple, got), key=str) == ranked(rows, items, 4)
    none = lexical_scan.ranked_search(fx.empty(spark), bench)
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_scan.ranked_search(docs, bench.limit(0)).count() == 0


def test_op13_matches_of_long_and_odd_texts(monkeypatch):
    block = lexical_scan.Block(["a b é1", None, "b ab"])
    auto = lexical_scan.automaton(block.key, tuple(block.terms))
    ts = [None, "", "a", "A b-a  é1É1 é1", "ab" * 4000, "a b " * 3000, "b", "x" * 5000 + " a"]
    for piece in (4_000_000, 64):
        monkeypatch.setattr(lexical_scan, "PIECE", piece)
        n, text, term, count = lexical_scan.matched(auto, ts, len(block.terms))
        own = [collections.Counter(w.encode() for w in terms(t)) for t in ts]
        assert n.tolist() == [sum(c.values()) for c in own]
        want = {(i, w): c[w] for i, c in enumerate(own) for w in block.terms if c[w]}
        assert {(i, block.terms[t]): c for i, t, c in zip(text.tolist(), term.tolist(), count.tolist())} == want


def test_op12_brute_force(spark):
    r = np.random.default_rng(2)
    vec = (r.normal(size=(90, 20)) * np.linspace(1, 0.2, 20)).astype(np.float32)
    data = [(i, v.tolist(), "c", 1.0) for i, v in enumerate(vec)] + [(i, vec[0].tolist(), "c", 1.0) for i in range(100, 140)]
    data += [(None, vec[1].tolist(), "c", 1.0), (150, None, "", 0.0), (151, [None] * 20, "", 0.0), (152, [math.nan] * 20, "", 0.0), (153, [math.inf] * 20, "", 0.0), (154, [], "", 0.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, x string, white double").repartition(5)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 131 * 16
    x = np.floor(64 * vec.astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = (u * n - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1][:, :16]
    assert set(got.n) == {n} and got.identity_error.max() < 1e-9
    want = ((x * n - s) / n) @ q / np.sqrt(e[:16])
    table = got[got.vec_id < 90].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(table) - np.abs(want)).max() < 1e-8
    assert np.abs((table * want).sum(0)).min() > 1  # one sign for all rows
    assert got[got.vec_id == 7].sort_values("component").explained.to_numpy() == pytest.approx(e[:16] / e.sum(), rel=1e-9)
    assert got[(got.component == 1) & (got.vec_id < 90)].set_index("vec_id").deviation.sort_index().tolist() == ((x * n - s) ** 2).sum(1).tolist()
    assert len(got[(got.vec_id == 120)].merge(got[got.vec_id == 0], on=["component", "whitened", "deviation"])) == 16
    assert got.vec_id.isna().sum() == 16


def test_op12_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1e300, 2.0]), (4, [1.0, 2.0, 3.0])], kind)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(odd).collect()}
    assert len(got) == 9 and got[1, 1].n == 2 and got[4, 1].n == 1
    assert got[1, 2].whitened is None and got[1, 2].explained == 0 and got[3, 1].deviation is None
    assert got[4, 1].deviation == 0 and got[4, 1].whitened is None
    assert whitening.whiten(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(odd, most_dims=2)


def clause_categories(symbols, reach=3):
    """What the composed machine writes for one clause, by plain rules."""
    harm = negated = 0
    reported, out, aimed = False, [], toxic_grammar.TARGET in symbols
    for s in symbols:
        threat = s == toxic_grammar.TARGET and harm > 0
        harm = reach if s == toxic_grammar.HARMS else 0 if threat else max(0, harm - 1)
        within = negated > 0
        negated = reach if s == toxic_grammar.NEGATION else max(0, negated - 1)
        if threat and not within:
            out.append("threat")
        if s == toxic_grammar.INSULT:
            out.append(("quoted_negated" if within else "quoted") if reported else "negated" if within else "plain")
        reported |= s == toxic_grammar.REPORT
    return [c + "_aimed" if aimed and c != "threat" else c for c in out]


def test_op11_composed_machine_against_rules():
    r = np.random.default_rng(4)
    machine = toxic_grammar.Machine()
    clauses = [r.integers(0, 6, r.integers(1, 14)) for _ in range(3000)]
    sizes = np.array(list(map(len, clauses)))
    out, aimed = machine.run(np.concatenate(clauses).astype(np.int8), np.cumsum(sizes) - sizes, sizes)
    name = {toxic_grammar.INSULT: "plain", toxic_grammar.NEGATED: "negated", toxic_grammar.QUOTED: "quoted", toxic_grammar.QUOTED_NEGATED: "quoted_negated", toxic_grammar.THREAT: "threat"}
    for c, o, t in zip(clauses, np.split(out, np.cumsum(sizes)[:-1]), aimed):
        said = [name[k] for k in o.tolist() if k in name]
        assert [x + "_aimed" if t and x != "threat" else x for x in said] == clause_categories(c.tolist())


def test_op11_clauses_are_scored_not_words():
    m = toxic_grammar.Model({}, toxic_grammar.PRIOR)
    plain, aimed, negated, quoted, threat, harm, none, empty, null = m.scores(
        ["He spoke. What an idiot!", "you are an idiot", "That is not an idiot", "the paper said idiot", "I will kill you", "to kill time", "a fine day", "", None]
    )
    assert aimed > plain > quoted > negated > none and threat > plain and harm == none == empty == null
    assert m.scores(["not here. idiot"])[0] == m.scores(["idiot. not here"])[0]  # negation ends with its clause
    long_ = m.scores(["word " * 200_000 + "idiot", ("a. " * 1000 + "idiot. ") * 3])
    assert (long_ > none).all()


def test_op11_learns_stems_and_holds_out(spark):
    r = np.random.default_rng(6)
    vocab = [f"{a}{b}{c}" for a in ("ta", "ro", "mi", "ve") for b in ("lan", "gor", "pis") for c in ("o", "en", "um", "a")]
    rows = []
    for i in range(400):
        w = list(r.choice(vocab, 30))
        if i % 5 == 0:
            for _ in range(3):
                w[r.integers(30)] = "zaqu" + str(r.choice(["o", "en", "umber"]))
        rows.append((i, " ".join(w), int(i % 5 == 0), "clash", "clash"))
    rows += [(None, None, 1, "", ""), (401, "", 0, "", ""), (401, "", None, "", ""), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string, held_out string")
    got = toxic_grammar.score_toxicity(df, df.select("doc_id", "toxic"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.held_out == (fx.crc(x.doc_id) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3)
    held = [(x.predicted, x.doc_id % 5 == 0) for x in got if x.held_out and x.doc_id < 400]
    assert len(held) > 50 and all(p == t for p, t in held)
    assert toxic_grammar.score_toxicity(df.limit(0), df.select("doc_id", "toxic")).count() == 0
    assert toxic_grammar.score_toxicity(df, df.select("doc_id", "toxic").limit(0)).count() == len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_op11_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op11_toxic_grammar(spark, SF).where("held_out").join(labels, "doc_id").toPandas()
    rank, y = got.score.rank().to_numpy(), got.toxic.to_numpy()
    n = y.sum()
    auc = (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
    assert auc > 0.9 and y[got.predicted == 1].mean() > 0.9 and (got.predicted[y == 1] == 1).mean() > 0.8
