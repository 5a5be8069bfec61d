import collections
import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenegrain.llm import bitplanes, budget_mix, byte_cnn, chunks, fragment_jaccard, gru_lm, heap_bpe, pivots, secret_dfa, suffix_decontam, url_temporal
from scenegrain.sources.tables import save, shared_dir

from . import fixtures as fx

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def ids_of(lib, t):
    return lib.encode(t or "", add_special_tokens=False).ids


def test_chunk_counts_and_ids_match_library_on_random_text(lib):
    r = random.Random(5)
    bits = [" ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "a", "The", "'s", "'ll", "12", "é", "漢", "!!", ".", "<|endoftext|>", "🙂", "²", "é"]
    ts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    want = [ids_of(lib, t) for t in ts]
    # A long text without spaces, one with a space a character, bytes of base64, and repeats that the cache has dropped.
    ts += ["漢字仮名" * 5000, "aGVsbG8gd29ybGQh" * 4000, " ".join(map(chr, range(0x4E00, 0x6E00))), "one word " * 10_000] + ts[:500]
    want = [ids_of(lib, t) for t in ts]
    for room in (0, 40_000, 80_000_000):
        for part in (1, 700):
            c, e = heap_bpe.Counter(PATH, room), bitplanes.Encoder(PATH, run=7 if room else 2000)
            parts = [ts[k : k + part] for k in range(0, len(ts), part)][:: 1 if part > 1 else 9]
            assert [n for x in parts for n in c.counts(x)] == [len(ids_of(lib, t)) for x in parts for t in x]
            assert [i.tolist() for x in parts for i in e.ids(x)] == [ids_of(lib, t) for x in parts for t in x]
    assert [x.tolist() for x in bitplanes.Encoder(PATH).ids(ts)] == want
    assert chunks.cuttable("a b\nc", ()) == "a b \nc" and chunks.cuttable("a   b", ()) is None


def test_op1_round_trip(spark, docs, rows, lib):
    for bits in (False, True):
        path = f"{shared_dir(spark)}/t1-{bits}"
        bitplanes.write_planes(docs, path, PATH, block=64, chunk_ids=500, bits=bits)
        got = bitplanes.read_planes(spark, path, with_ids=True).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
        want = collections.Counter((i, *ids_of(lib, t), 2) for i, t in rows)
        assert collections.Counter((r.doc_id, *r.ids) for r in got) == want
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.n_tokens
        index = spark.read.parquet(f"{path}/index")
        assert index.agg(F.sum("n_ids"), F.sum("n_docs")).first() == (at, len(rows))
    bitplanes.write_planes(fx.empty(spark), f"{shared_dir(spark)}/t1-none", PATH)
    assert bitplanes.read_planes(spark, f"{shared_dir(spark)}/t1-none").count() == 0


def test_op2_brute_force(spark):
    r = np.random.default_rng(0)
    centre = r.normal(size=(12, 16))
    vec = [(c + r.normal(scale=0.06, size=16)).tolist() for c in centre for _ in range(12)] + [r.normal(size=16).tolist() for _ in range(60)]
    data = [(i, [float(np.float32(x)) for x in v], i % 2, "clash", 1) for i, v in enumerate(vec)]
    n = len(data)
    data += [(n, data[0][1], 0, "", 1), (n + 1, data[0][1], 1, "", 1), (n + 2, None, 0, "", 1), (n + 3, [0.0] * 16, 0, "", 1), (n + 4, [float("nan")] * 16, 0, "", 1), (n + 5, [None, 1.0], 0, "", 1), (n + 6, data[0][1], None, "", 1), (n + 7, [1.0, 2.0], 0, "", 1), (n + 8, [2.0, 4.0], 0, "", 1), (n + 9, [], 0, "", 1), (n + 10, [float("inf")] * 16, 0, "", 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, node string, n long")
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(v) if ok(v) else None for _, v, *_ in data]
    links = [(a, b) for a, b in itertools.combinations(range(len(data)), 2) if unit[a] is not None and unit[b] is not None and data[a][2] == data[b][2] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    deg = collections.Counter(x for p in links for x in p)
    comp = fx.components(len(data), links)
    low = {c: min(i for i in range(len(data)) if comp[i] == c) for c in set(comp)}
    assert len(links) > 100
    for block in (2048, 7):
        got = {x.vec_id: x for x in pivots.near_vectors(df, block=block).collect()}
        assert {i: (x.n_links, x.component_id, x.kept) for i, x in got.items()} == {i: (deg[i], low[comp[i]], low[comp[i]] == i) for i in range(len(data))}
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_op2_null_repeated_and_large_ids(spark):
    r = np.random.default_rng(11)
    centre = r.normal(size=(4, 24))
    near = lambda k: (centre[k] + r.normal(scale=0.01, size=24)).tolist()
    big = 1 << 60
    rows = [(1, near(0)), (None, near(0)), (3, near(0)), (big + 1, near(1)), (big + 3, near(1)), (None, near(1)), (7, near(2)), (7, near(3)), (8, near(3)), (None, r.normal(size=24).tolist()), (None, near(2))]
    rows += [(None, (v := near(0))), (None, v), (9, [1.0] * 5000), (10, [1.0] * 4999 + [1.01])]
    got = pivots.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 4, 1), (None, 4, 1), (3, 4, 1), (None, 4, 1), (None, 4, 1), (big + 1, 2, big + 1), (big + 3, 2, big + 1), (None, 2, big + 1)]
    want += [(7, 1, 7), (None, 1, 7), (7, 1, 7), (8, 1, 7), (None, 0, None), (9, 1, 9), (10, 1, 9)]
    assert collections.Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in got) == collections.Counter((i, n, c, i == c) for i, n, c in want)


def test_op2_finds_all_links_of_a_dense_group(spark, monkeypatch):
    r = np.random.default_rng(3)
    centre = r.normal(size=64)
    centre /= np.linalg.norm(centre)
    vec = np.concatenate((centre + r.normal(scale=0.018, size=(700, 64)), r.normal(size=(1300, 64))))
    vec[1300:] = vec[600:1300] + r.normal(scale=0.1, size=(700, 64))  # lone pairs, most of them at the cosine or above
    vec = vec.astype(np.float32).astype(float)
    label = np.arange(len(vec)) % 2 * (np.arange(len(vec)) >= 700)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(vec), dtype=bool)
    comp = fx.components(len(vec), list(zip(*map(np.ndarray.tolist, np.nonzero(near)))))
    low = {c: min(i for i in range(len(vec)) if comp[i] == c) for c in set(comp)}
    assert 0.1 < near[:700, :700].mean() < 0.9 and near[700:].sum() > 100
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vec, label))], "vec_id long, embedding array<float>, label int").cache()
    for n, block in ((256, 2048), (1024, 300), (4096, 2048)):
        monkeypatch.setattr(pivots, "n_pivots", lambda _, n=n: n)
        got = {x.vec_id: (x.n_links, x.component_id) for x in pivots.near_vectors(df, block=block).collect()}
        assert got == {i: (int(near[i].sum()), low[comp[i]]) for i in range(len(vec))}


def test_op3_base_scores_and_normalised_model(spark, docs, rows):
    training = byte_cnn.crc_fold(F.col("doc_id"), 7) != 2
    want = fx.base_scores(rows)
    for table in (1 << 17, 20):
        got = gru_lm.score_documents(docs, training, table=table).collect()
        texts = collections.defaultdict(list)
        for i, t in rows:
            texts[i].append(t)
        assert len(got) == len(rows)
        for x in got:
            n, known, total, base = want[(x.doc_id, texts[x.doc_id][0])]
            assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total)
            assert x.base_score == pytest.approx(base, abs=1e-6) and x.score < 0
            assert x.training == (fx.crc(x.doc_id) % 7 != 2)
    assert gru_lm.score_documents(fx.empty(spark), training).count() == 0


def test_op3_probabilities_sum_to_one_and_state_is_carried():
    words = [b"", *(f"w{i}".encode() for i in range(40))]
    c = np.arange(60, 60 - len(words), -1).astype(float)
    t = gru_lm.frequent_table(words, c, int(c.sum()) + 30, soft=20, bins=3)
    net = gru_lm.Gru(t, hidden=8)
    r = np.random.default_rng(1)
    docs = [np.append(r.integers(1, len(words) + 1, r.integers(1, 90)), 0) for _ in range(50)]
    before = gru_lm.score(net, t, docs).sum()
    for _ in range(5):
        gru_lm.train(net, t, docs, width=4, window=8)
    assert gru_lm.score(net, t, docs).sum() > before
    state = r.normal(0, 0.3, (1, 8)).astype(np.float32)
    every = np.arange(len(words) + 1)
    p = np.exp(net.log_probs(np.repeat(state, len(every), 0), t.cls[every], t.slot[every])) * np.where(t.slot[every] < 0, 10 ** t.share[every], 1)
    assert p.sum() == pytest.approx(1, abs=1e-4)
    whole = gru_lm.score(net, t, docs)
    for kw in ({"width": 1}, {"window": 3}, {"width": 7, "window": 5}):
        assert np.allclose(gru_lm.score(net, t, docs, **kw), whole, atol=1e-3)


def plain_forward(net, t, ids):
    """log10 of a document's probability word by word in plain Python floats: the equations of the network, no batches."""
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    h, sigmoid = net.h, lambda v: 1 / (1 + math.exp(-v))
    times = lambda state, m: [sum(s * row[j] for s, row in zip(state, m)) for j in range(len(m[0]))]

    def log_softmax(logits, k):
        top = max(logits)
        return logits[k] - top - math.log(sum(math.exp(v - top) for v in logits))

    state, total = [0.0] * h, 0.0
    for i in map(int, ids):
        c, slot = int(t.cls[i]), int(t.slot[i])
        total += log_softmax([a + b for a, b in zip(times(state, p["c"]), p["cb"])], c) / math.log(10)
        total += float(t.share[i]) if slot < 0 else log_softmax([a + b for a, b in zip(times(state, p["w"][c]), p["wb"][c])], slot) / math.log(10)
        e, u = p["e"][int(t.row[i])], times(state, p["u"])
        keep = [sigmoid(e[j] + u[j]) for j in range(h)]
        reset = [sigmoid(e[h + j] + u[h + j]) for j in range(h)]
        fresh = [math.tanh(e[2 * h + j] + reset[j] * u[2 * h + j]) for j in range(h)]
        state = [z * s + (1 - z) * n for z, s, n in zip(keep, state, fresh)]
    return total


def test_op3_score_equals_a_plain_forward_pass():
    words = [b"", *(f"w{i}".encode() for i in range(90))]
    c = np.arange(150, 150 - len(words), -1).astype(float)
    t = gru_lm.frequent_table(words, c, int(c.sum()) + 30, soft=70, bins=3)
    net, r = gru_lm.Gru(t, hidden=5), np.random.default_rng(6)
    docs = [np.append(r.integers(1, len(words) + 1, n), 0) for n in (0, 1, 2, 7, 40, 90, 250)]
    for _ in range(8):
        gru_lm.train(net, t, docs, width=3, window=8)
    assert np.abs(net.p["w"]).max() > 0 and np.abs(net.p["c"]).max() > 0
    want = [plain_forward(net, t, d) for d in docs]
    for kw in ({}, {"width": 2, "window": 4}):
        assert np.allclose(gru_lm.score(net, t, docs, **kw), want, rtol=1e-5, atol=1e-3)


def test_op3_gradient():
    words = [b"", *(f"w{i}".encode() for i in range(10))]
    c = np.full(len(words), 5.0)
    t = gru_lm.frequent_table(words, c, 60, soft=8, bins=2)
    docs = [np.array([1, 2, 3, 11, 4, 0]), np.array([9, 10, 1, 0])]
    net = gru_lm.Gru(t, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    # One step along the negative gradient lowers the loss for every kind of parameter.
    start = gru_lm.score(net, t, docs, width=2, window=8).sum()
    gru_lm.train(net, t, docs, width=2, window=8, rate=1e-3)
    assert gru_lm.score(net, t, docs, width=2, window=8).sum() > start


def test_op3_learns_from_every_training_document(spark):
    words = [b"", *(f"w{i}".encode() for i in range(30))]
    t = gru_lm.frequent_table(words, np.full(len(words), 5.0), 200, soft=8, bins=2)
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(0, 30))) for _ in range(15)] + ["w1 w2 w3 w99"] * 30
    df = save(spark.createDataFrame([(1, x, True) for x in texts], "doc_id long, text string, training boolean").coalesce(1))
    coded = save(gru_lm.in_numbers(df, t))
    ids = [np.frombuffer(x.ids, "<i4") for x in coded.collect()]  # in the order of the one file
    assert [x.tolist() for x in ids] == [[*(t.ids.get(w.encode(), len(t.ids)) for w in fx.tokens(x.text)), t.ids[b""]] for x in df.collect()]
    shards = [[]]
    for x in ids:  # the 30 copies are in several shards
        shards[-1].append(x)
        if sum(map(len, shards[-1])) >= 60:
            shards.append([])
    want, total = gru_lm.Gru(t, hidden=4), 0
    for s in filter(None, shards):
        total = total + gru_lm.train(gru_lm.Gru(t, hidden=4), t, s).flat().astype(float) * sum(map(len, s))
    want.load(total / sum(map(len, ids)))
    got = gru_lm.fit(coded, t, gru_lm.Gru(t, hidden=4), sum(map(len, ids)), shard_words=60)
    assert len(shards) > 5 and np.allclose(got.flat(), want.flat(), atol=1e-4)


def test_op3_beats_the_base_on_held_out_texts(spark):
    r = random.Random(7)
    # Words of two kinds that don't mix within a text: what came before tells which to expect.
    data = [(i, " ".join(f"{'ab'[i % 2]}{int(r.paretovariate(0.8))}" for _ in range(200))) for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = gru_lm.score_documents(df, byte_cnn.crc_fold(F.col("doc_id"), 7) != 2).where("NOT training").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.05


def test_op3_long_text_among_short_ones():
    words = [b"", *(f"w{i}".encode() for i in range(40))]
    t = gru_lm.frequent_table(words, np.arange(60, 60 - len(words), -1).astype(float), 2000, soft=20, bins=3)
    net, r = gru_lm.Gru(t, hidden=4), np.random.default_rng(2)
    docs = [np.append(r.integers(1, 42, n), 0) for n in [*r.integers(1, 30, 600), 100_000]]
    ids, owner, n = gru_lm.laid_out(docs, 512)
    assert len(ids) == sum(map(len, docs)) and len(n) == max(map(len, docs))  # no padding
    gru_lm.train(net, t, docs, width=64)
    both = gru_lm.score(net, t, docs)
    assert np.allclose(both[:20], gru_lm.score(net, t, docs[:20]), atol=1e-3) and np.isfinite(both).all()


def test_op4_matches_library(spark, docs, rows, lib):
    got = collections.Counter(map(tuple, heap_bpe.count_tokens(docs, PATH).collect()))
    assert got == collections.Counter((i, len((t or "").encode()), n := len(ids_of(lib, t)), n > 512) for i, t in rows)
    assert heap_bpe.count_tokens(fx.empty(spark), PATH).count() == 0


def test_op5_held_out_accuracy(spark):
    r = random.Random(2)
    sound = {"en": "the and thing wher of ion er".split(), "de": "der und sch ung ei ch ß ü".split(), "fr": "le eau é è oi ment re".split()}
    text = lambda k, n: " ".join("".join(r.choice(sound[k]) for _ in range(3)) for _ in range(n))
    data = [(i, text(k, r.choice([8, 40, 400])), k, "s", "clash") for i, k in enumerate(sorted(sound) * 60)]
    n = len(data)
    data += [(n, None, "en", "s", ""), (n + 1, "", "en", "s", ""), (n + 2, "12 !!", "de", "s", ""), (None, text("de", 20), None, None, None), data[0]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score string")
    got = byte_cnn.predict_languages(df).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(data) and [by[n + k].lang_pred for k in range(3)] == ["und"] * 3
    assert by[None].lang_pred == "de" and all(0 <= x.score <= 1 for x in got)
    held = [i for i in range(n) if fx.crc(i) % 5 == 0]
    assert all(by[i].held_out for i in held)
    assert np.mean([by[i].lang_pred == data[i][2] for i in held]) >= 0.95
    assert byte_cnn.predict_languages(df.limit(0)).count() == 0


def test_op5_fits_on_different_texts_and_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(byte_cnn.Net, "train", lambda self, win, y, epochs: seen.append((win, y)))
    data = [("a", "only one text that is repeated")] * 2000 + [("a", f"a text of its own, number {i}") for i in range(100)] + [("a", f"{i} 12") for i in range(50)]
    data += [("b", "".join(f"part {i:03d} of a long text " .ljust(256, ".") for i in range(40)))]
    df = spark.createDataFrame(data, "lang string, text string")
    byte_cnn.learn(df, F.lit(True))
    win, y = seen[0]
    assert (y == 0).sum() == 101 and (y == 1).sum() == 40
    assert {bytes(w[5:8]) for w in win[y == 1]} == {b"%03d" % i for i in range(40)}
    byte_cnn.learn(df, F.lit(True), most_bytes=1000)  # a byte bound: the texts that fill 500 bytes, but one of each
    _, y = seen[1]
    assert 1 <= (y == 0).sum() < 40 and (y == 1).sum() == 40


def test_op5_learns_every_language(spark):
    data = [(f"l{i:04d}", chr(0x4E00 + i) * 40) for i in range(1100) for _ in range(2)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "doc_id long, lang string, text string")
    net = byte_cnn.learn(df, F.lit(True), per_label=1, epochs=0)
    assert net.labels == sorted({k for k, _ in data})


def test_op5_forward_pass_against_brute_force():
    net, r = byte_cnn.Net(["a", "b", "c"]), np.random.default_rng(4)
    net.train(r.integers(1, 255, (64, 256)).astype(np.uint8), r.integers(0, 3, 64), 1)
    texts = ["Ein Satz. " * 60, "é", "x" * 257, "12 a"]
    langs, scores = byte_cnn.identify(net, [*texts, None, "12", ""])
    for t, lang, score in zip(texts, langs, scores):
        data, total = byte_cnn.clean(t), np.zeros(3)
        for s in range(0, len(data), 256):
            win = data[s : s + 256].ljust(256, b"\0")
            x = [net.p["emb"][c] for c in win]
            h = []
            for w in net.widths:
                runs = [np.concatenate(x[i : i + w]) @ net.p[f"c{w}"] for i in range(256 - w + 1)]
                h += [max(run[f] for run in runs) for f in range(net.f)]
            z = np.maximum(np.array(h) + net.p["shift"], 0) @ net.p["out"] + net.p["bias"]
            total += (z - np.log(np.exp(z).sum())) * len(data[s : s + 256])
        p = np.exp(total / len(data))
        assert lang == net.labels[int(p.argmax())] and score == pytest.approx(p.max() / p.sum(), abs=1e-4)
    assert langs[4:] == ["und"] * 3 and scores[4:] == [0.0] * 3


def test_op6_brute_force(spark, docs, rows):
    some = [t for _, t in rows if t and len(t.split()) > 40]
    bench = [(1, " ".join(some[0].split()[5:30])), (2, "one two"), (10, " ".join(some[3].split()[:13])), (11, None), (12, ""), (13, "..."), (14, some[4].upper()), (15, "seven WORDS"), (2, "one two")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = collections.Counter((i, *fx.contamination(t, bench)) for i, t in rows)
    for size in (32_000_000, 60):
        got = suffix_decontam.contamination(docs, b, max_bytes=size)
        assert collections.Counter(tuple(x)[:6] for x in got.collect()) == want
    kept = suffix_decontam.decontaminate(docs, b)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert suffix_decontam.contamination(docs, b.limit(0)).where("n_hit > 0").count() == 0
    assert suffix_decontam.contamination(fx.empty(spark), b).count() == 0


def test_op6_items_without_id_hit(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "other words")], "doc_id long, text string")
    b = spark.createDataFrame([(None, " ".join(words[3:20])), (None, " ".join(words[5:22])), (7, " ".join(words[5:20])), (None, None)], "item_id long, text string")
    for size in (32_000_000, 60):
        got = {x.doc_id: (x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in suffix_decontam.contamination(docs, b, max_bytes=size).collect()}
        assert got == {1: (19, 2, hashlib.sha256(b"7").hexdigest(), True), 2: (0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert [x.doc_id for x in suffix_decontam.decontaminate(docs, b).collect()] == [2]


def longest(doc, items, n=13):
    """All (start, end) of verbatim matches of at least a window (or a whole shorter item) that no other contains."""
    d, found = suffix_decontam.words(doc), set()
    for _, text in items:
        w = suffix_decontam.words(text)
        for i in range(len(d) if w else 0):
            for j in range(len(w)):
                k = 0
                while i + k < len(d) and j + k < len(w) and d[i + k] == w[j + k]:
                    k += 1
                if k >= min(n, len(w)):
                    found.add((i, i + k))
    return sorted(x for x in found if not any(a <= x[0] and x[1] <= b and (a, b) != x for a, b in found))


def test_op6_longest_matches_and_their_places():
    r, n = random.Random(3), 0
    for _ in range(300):
        voc = "abc"[: r.choice([1, 2, 3])]
        items = [(str(k), " ".join(r.choice(voc) for _ in range(r.choice([0, 1, 3, 8, 13, 14, 20, 45])))) for k in range(r.randint(0, 5))]
        docs = []
        for _ in range(3):
            t = []
            for _ in range(r.randint(0, 4)):
                w = r.choice(items)[1].split() if items and r.random() < 0.6 else [r.choice(voc) for _ in range(15)]
                a = r.randint(0, len(w))
                t += w[a : a + r.randint(1, 45)]
            docs.append(" ".join(t))
        cut = r.randint(0, len(items))
        for blocks in ([items], [items[:cut], items[cut:]]):
            for t, (_, _, _, m) in zip(docs, suffix_decontam.judge([suffix_decontam.Bench(x) for x in blocks], docs)):
                assert [(a, e) for a, e, *_ in m.tolist()] == longest(t, items), (t, items)
                for a, e, b, k, w in m.tolist():
                    assert suffix_decontam.words(blocks[b][k][1])[w : w + e - a] == suffix_decontam.words(t)[a:e]
                n += len(m)
    assert n > 1000


def test_op6_adjacent_items_are_two_matches_and_long_repeats_end(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(13)) for c in "uv")
    docs = spark.createDataFrame([(1, f"{one} {two}"), (2, "a " * 300_000)], "doc_id long, text string")
    b = spark.createDataFrame([(5, one), (6, f"x {two} y"), (7, "a " * 500)], "item_id long, text string")
    got = {x.doc_id: x for x in suffix_decontam.contamination(docs, b).collect()}
    assert [tuple(m) for m in got[1].matches] == [(0, 13, "5", 0), (13, 26, "6", 1)] and got[1].n_hit == 26
    assert len(got[2].matches) == 299_501 and got[2].n_hit == 300_000


def test_op6_benchmark_in_passes(spark, docs, rows):
    some = [t for _, t in rows if t and len(t.split()) > 40]
    bench = [(str(k), " ".join(t.split()[k : k + 30])) for k, t in enumerate(some[:6])]
    bench += [("long", some[7]), ("part", " ".join(some[7].split()[3:25])), ("short", "one two"), ("none", None), ("same", bench[0][1])]
    b = spark.createDataFrame(bench, "item_id string, text string")
    clash = docs.withColumn("row", F.lit(1)).withColumn("_of", F.lit(2)).withColumn("n_hit", F.lit(3))
    flat = lambda x: (x.doc_id, x.n_words, x.n_hit, x.items_sha256, x.contaminated, tuple((m.start, m.end) for m in x.matches))
    one = collections.Counter(flat(x) for x in suffix_decontam.contamination(clash, b).collect())
    many = collections.Counter(flat(x) for x in suffix_decontam.contamination(clash, b, max_bytes=300, held=600).collect())
    assert one == many and sum(x[2] > 0 for x in one) > 3
    kept = [suffix_decontam.decontaminate(clash, b, "text", 300, h) for h in (600, 10**9)]
    assert kept[0].columns == clash.columns and collections.Counter(kept[0].collect()) == collections.Counter(kept[1].collect())
    assert 0 < kept[0].count() < clash.count()
    assert suffix_decontam.contamination(docs.limit(0), b, max_bytes=300, held=600).count() == 0


def test_op7_brute_force(spark, docs, rows):
    got = collections.Counter((x.doc_id, x.n_assign, x.n_access, x.n_hex) for x in secret_dfa.scan_secrets(docs).collect())
    want = collections.Counter()
    for i, t in rows:
        k = collections.Counter(r for _, r, _ in fx.secrets(t))
        want[(i, k[0], k[1], k[2])] += 1
    assert got == want
    s, r = secret_dfa.scanner(secret_dfa.BASE + secret_dfa.ADDED), random.Random(1)
    bits = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "0123456789abcdef", "deadbeef", "AKIA", "AKI", "ABCDEFGH1234", "é", "ſecret", "\n", "x.y=z", "-", "_", "A", "a"]
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        assert [x for x in s.spans(t) if x[1] < 3] == fx.secrets(t), t
    assert [secret_dfa.ADDED[k - 3].kind for _, k, _ in s.spans("x ghp_" + "aB3" * 13) if k > 2] == ["github"]
    assert secret_dfa.scan_secrets(fx.empty(spark)).count() == 0


def test_op7_time_grows_with_the_length():
    s = secret_dfa.scanner(secret_dfa.BASE + secret_dfa.ADDED)
    for t in ("secret=token:" + "a" * 300_000, "password:secret=" * 20_000, "eyJa.b.c" * 40_000, "AKIA" * 70_000, "-----BEGIN " * 30_000):
        began = time.process_time()
        got = [x for x in s.spans(t) if x[1] < 3]
        assert time.process_time() - began < 20
        assert got == fx.secrets(t)


def test_op7_hash_and_spans_of_the_query(spark, docs, rows):
    named = ["assign", "access", "hex"]
    want = collections.Counter()
    for i, t in rows:
        base = fx.secrets(t)
        said = ",".join(f"{named[k]}:{a}:{e}" for a, k, e in base)
        want[(i, hashlib.sha256(said.encode()).hexdigest())] += 1
    got = secret_dfa.scan_secrets(docs).collect()
    assert collections.Counter((x.doc_id, x.base_sha256) for x in got) == want
    for x in got:  # all spans in order, and the base ones are among them
        spans = [y.split(":") for y in x.spans.split(",") if y]
        assert [int(y[1]) for y in spans] == sorted(int(y[1]) for y in spans)
        base = ",".join(":".join(y) for y in spans if y[0] in named)
        assert hashlib.sha256(base.encode()).hexdigest() == x.base_sha256


def test_op8_brute_force(spark):
    r = random.Random(4)
    base = [[f"v{r.randrange(5000)}" for _ in range(60)] for _ in range(5)]
    texts = []
    for b in base:
        for _ in range(14):
            w = list(b)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(60)] = f"z{r.randrange(9999)}"
            texts.append(" ".join(w))
    shared = " ".join(base[0][:50])
    texts += [shared + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randint(5, 40))) for _ in range(25)]
    texts += ["", None, " ", "a", "A", "a b", "b a", "a b c d e", "A b c d e f", texts[0], texts[0].upper(), "one two three four five six"] * 2
    df = spark.createDataFrame([(i * 2, t, "clash", 1) for i, t in enumerate(texts)] + [(None, texts[3], "", 1)], "doc_id long, text string, node string, n long").repartition(4)
    sets = [fx.shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = fx.components(len(texts), links)
    low = {}
    for i, c in enumerate(comp):
        low.setdefault(c, i)
    got = fragment_jaccard.near_documents(df).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == {2 * i: (len(s), 2 * low[c]) for i, (s, c) in enumerate(zip(sets, comp))}
    assert [x.component_id for x in got if x.doc_id is None] == [2 * low[comp[3]]]
    # All shared shingles common, all copies but one left out: the same result.
    again = fragment_jaccard.near_documents(df, least_common=2, many_copies=1).collect()
    assert collections.Counter(again) == collections.Counter(got)
    assert fragment_jaccard.near_documents(df.limit(0)).count() == 0


def test_op8_boilerplate_makes_no_pairs(spark):
    r = random.Random(8)
    boiler = " ".join(f"b{k}" for k in range(84))
    own = lambda: " ".join(f"x{r.randrange(10**9)}" for _ in range(20))
    texts = []
    for _ in range(150):  # pairs of one text; across pairs 80 of 120 shingles are shared
        x = own()
        texts += [f"{boiler} {x}", f"{boiler} {x} y"]
    texts += [f"{boiler} z{k} " + " ".join(texts[0].split()[84:]) for k in range(40)]  # a group that hangs together
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [fx.shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp, low = fx.components(len(texts), links), {}
    for i, c in enumerate(comp):
        low.setdefault(c, i)
    got = {x.doc_id: x.component_id for x in fragment_jaccard.near_documents(df).collect()}
    assert got == {i: low[c] for i, c in enumerate(comp)}
    # Rows of one shingle that all nodes have: only those within the index of the smaller set may be joined.
    named = spark.createDataFrame([(1, i, 100, 100, 20, i) for i in range(500)] + [(2, i, 100, 100, 3, 0 if i < 499 else i) for i in range(500)], "key long, node long, n long, m int, at int, c long")
    assert fragment_jaccard.across_components(named).count() == 499


def test_op9_targets_and_takes(spark, docs, rows):
    got = budget_mix.mix(docs).collect()
    again = budget_mix.mix(docs.repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again)) and len(got) == len(rows)
    src = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for x in got:
        s = src[x.doc_id]
        size[s] += x["size"]
        taken[s] += x.taken
        target[s] = x.target
        assert 0 <= x.taken <= 3 * x["size"] and x.taken == x.copies * x["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * w[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in order:
        assert target[s] == pytest.approx(3 * size[s] if s in capped else level * w[s])
        assert abs(taken[s] - target[s]) <= (4000 if any(src[x.doc_id] == s and x['size'] > 5000 for x in got) else 60)
    assert sum(target.values()) == pytest.approx(total)
    assert budget_mix.mix(fx.empty(spark)).count() == 0
    out = budget_mix.mixed_rows(docs)
    assert out.columns == docs.columns


def test_op9_knapsack_is_best():
    r = random.Random(3)
    for _ in range(200):
        lengths = sorted(r.sample(range(1, 40), r.randint(1, 5)))
        counts = [r.randint(0, 4) for _ in lengths]
        budget = r.randint(0, 120)
        reach = {sum(a * k for a, k in zip(lengths, ks)) for ks in itertools.product(*(range(n + 1) for n in counts))}
        take = budget_mix.fitted(lengths, counts, budget, 10_000)
        assert all(0 <= k <= n for k, n in zip(take, counts))
        got = sum(a * k for a, k in zip(lengths, take))
        assert abs(got - budget) == min(abs(x - budget) for x in reach)


@pytest.mark.parametrize(
    "lengths, counts, budget, best",
    [([22_925, 43_511], [1, 1], 43_052, 43_511), ([24_523, 99_680], [2, 1], 99_350, 99_680), ([5_495, 16_020], [2, 1], 16_458, 16_020)],
)
def test_op9_long_documents_are_chosen_for_their_sum(lengths, counts, budget, best):
    take = budget_mix.fitted(lengths, counts, budget)
    assert sum(a * k for a, k in zip(lengths, take)) == best


def test_op9_large_sources_come_near_with_bounded_work():
    r = random.Random(8)
    for many in (30, 400):
        lengths = sorted(r.sample(range(1_000_000, 90_000_000), many))
        counts = [r.randint(1, 3) for _ in lengths]
        budget = sum(a * n for a, n in zip(lengths, counts)) // 3
        at = time.time()
        take = budget_mix.fitted(lengths, counts, budget, work=1 << 24)
        assert all(0 <= k <= n for k, n in zip(take, counts)) and time.time() - at < 30
        assert abs(sum(a * k for a, k in zip(lengths, take)) - budget) < 0.01 * budget
    lengths, counts = [2 * a for a in range(1, 3000)], [r.randint(0, 5) for _ in range(1, 3000)]
    take = budget_mix.fitted(lengths, counts, 4_000_001)
    assert sum(a * k for a, k in zip(lengths, take)) in (4_000_000, 4_000_002)


def test_op10_brute_force(spark):
    r = random.Random(6)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.example.org", "localhost", "EXAMPLE.org"]
    caps = [(i, f"http://{r.choice(['', 'u@'])}{r.choice(hosts)}{r.choice(['', ':80'])}/p?q#{i}", r.choice([None, *range(60)])) for i in range(200)]
    caps += [(500, None, 3), (501, "nonsense", 3), (None, "http://example.com/", 9), caps[0], caps[0], (502, "http://example.com/" + "x" * 300_000, 30)]
    ents = [(r.choice(["example.com", "a.example.com", "example.org", "y.example.org", "localhost", None]), r.choice([None, *range(50)]), r.choice(["add", "add", "remove", None]), i) for i in range(40)]
    c = spark.createDataFrame(caps, "page_id long, url string, fetch_day long").withColumn("domain", F.lit("clash"))
    e = spark.createDataFrame(ents, "domain string, day long, action string, entry_id long")

    def listed(domain, day):
        past = [(d, k, a) for x, d, a, k in ents if x == domain and d is not None and a is not None and d <= day]
        return max(past) if past and max(past)[2] == "add" else None

    want = []
    for i, url, day in caps:
        host = url.split("://")[1].split("/")[0].split("@")[-1].split(":")[0].lower() if url and "://" in url else None
        labels = host.split(".") if host else []
        up = [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))] if host else []
        hit = [(len(x), x, m[0]) for x in up if day is not None and (m := listed(x, day))]
        best = max(hit) if hit else (0, None, -1)
        want.append((i, host, day, len(hit), best[1], best[2], bool(hit)))
    got = url_temporal.temporal_filter(c, e, period=7).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert url_temporal.temporal_filter(c.limit(0), e).count() == 0 and not url_temporal.temporal_filter(c, e.limit(0)).where("blocked").count()
