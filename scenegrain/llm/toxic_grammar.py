"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, harm, target, negation, report or other). Small transducers read them: one for threats
(harm near a target), one for negation (a few words are within its reach), one for reported speech (to the clause's end)
and one for targets (anywhere in the clause). They are composed into one machine, held as transition arrays, which runs
over all clauses that hold an insult or harm at once. A matched clause adds the weights of its words to the category that
the machine ends in; a text's score comes from these sums, not from words alone.

What is an insult is learned: word stems by how much more often different toxic texts hold them than others, besides a
small fixed lexicon. How much each category counts is learned as well, by logistic regression.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scenegrain.llm.byte_cnn import crc_fold
from scenegrain.llm.chunks import release
from scenegrain.llm.heap_bpe import batches
from scenegrain.llm.rows import small_batches, text_hash
from scenegrain.sources.tables import save

#: Words of the lexicon in English, German, French and Spanish; a * stands for any ending.
INSULTS = "idiot* moron* stupid* loser* scum* pathetic* worthless* disgusting* trash clown* dumb* imbecile* arschloch* dummkopf* connard* abruti* crétin* imbécil* gilipollas* estúpid*"
HARM = "kill* murder* hurt* shoot* stab* strangle* destroy* töte* umbringen* erschieß* tuer* frapper* matar* mataré golpear*"
TARGETS = "you your yours you're u he him she her they them those people du dich dir ihr euch sie ihn tu te toi vous ils elles usted ustedes ellos ellas"
NEGATIONS = "not never no none nobody cannot n't nicht kein* nie niemals ne pas jamais nunca jamás"
REPORTS = "said says say told called calls quoted wrote claims claimed sagt* sagte* nannte* dit disait appelé dijo dice llamó"

OTHER, INSULT, HARMS, TARGET, NEGATION, REPORT, THREAT, NEGATED, QUOTED, QUOTED_NEGATED = range(10)
#: What ends in a text's features: insults by how they are said, with and without a target in the clause, and threats.
CATEGORIES = ("plain", "negated", "quoted", "quoted_negated", "plain_aimed", "negated_aimed", "quoted_aimed", "quoted_negated_aimed", "threat")
LEXICON_WEIGHT = 3.0
#: Before any label is seen: how much the logarithm of each category's sum counts, then words a hit, and the constant.
PRIOR = np.array([1.5, 0.3, 0.6, 0.2, 1.8, 0.4, 0.8, 0.3, 1.8, 0.0, -3.0])

#: Bytes of folded texts: blanks between words, a line feed between clauses; apostrophes and hyphens stay in words.
_ENDS, _INNER = b".!?;:\n\r", b"'-_"
FOLD = bytes(10 if b in _ENDS else b if b > 127 or chr(b).isalnum() or b in _INNER else 32 for b in range(256))


@dataclass
class Transducer:
    """Deterministic: `arcs` has (next state, output) for (state, symbol); without an arc a state stays and repeats the
    symbol. State 0 is the first."""

    n: int
    arcs: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, symbol))


SYMBOLS = range(10)


def threats(reach: int = 3) -> Transducer:
    """A target at most `reach` symbols behind harm makes a threat (the target's output); harm alone is another word."""
    t = Transducer(reach + 1)
    for s in range(reach + 1):
        for x in SYMBOLS:
            t.arcs[s, x] = (max(0, s - 1), x)
        t.arcs[s, HARMS] = (reach, OTHER)
        if s:
            t.arcs[s, TARGET] = (0, THREAT)
    return t


def negation(reach: int = 3) -> Transducer:
    """Insults at most `reach` symbols behind a negation are negated; a threat there is another word."""
    t = Transducer(reach + 1)
    for s in range(reach + 1):
        for x in SYMBOLS:
            t.arcs[s, x] = (max(0, s - 1), x)
        t.arcs[s, NEGATION] = (reach, NEGATION)
        if s:
            t.arcs[s, INSULT] = (s - 1, NEGATED)
            t.arcs[s, THREAT] = (s - 1, TARGET)
    return t


def reported() -> Transducer:
    """Behind a word of reporting insults are quoted, up to the end of the clause."""
    return Transducer(2, {(0, REPORT): (1, REPORT), (1, INSULT): (1, QUOTED), (1, NEGATED): (1, QUOTED_NEGATED)})


def targets() -> Transducer:
    """State 1 once the clause holds a target."""
    return Transducer(2, {(0, TARGET): (1, TARGET), (0, THREAT): (1, THREAT)})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what `first` reads; `second` reads what `first` writes. State (a, b) has the number a * second.n + b."""
    out = Transducer(first.n * second.n)
    for a in range(first.n):
        for b in range(second.n):
            for x in SYMBOLS:
                to_a, y = first.step(a, x)
                to_b, z = second.step(b, y)
                out.arcs[a * second.n + b, x] = (to_a * second.n + to_b, z)
    return out


class Machine:
    """The composed transducer as arrays; its last component tells whether the clause holds a target."""

    def __init__(self, reach: int = 3):
        t = compose(compose(compose(threats(reach), negation(reach)), reported()), targets())
        self.next = np.array([[t.step(s, x)[0] for x in SYMBOLS] for s in range(t.n)], np.int32)
        self.out = np.array([[t.step(s, x)[1] for x in SYMBOLS] for s in range(t.n)], np.int8)

    def run(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(output of every word of the clauses, whether each clause has a target); clauses run side by side."""
        out = np.zeros(len(symbols), np.int8)
        state = np.zeros(len(starts), np.int32)
        order = np.argsort(-sizes, kind="stable")
        left = sizes[order]
        for k in range(int(sizes.max()) if len(sizes) else 0):
            live = order[: np.searchsorted(-left, -k)]
            at = starts[live] + k
            x = symbols[at]
            s = state[live]
            out[at] = self.out[s, x]
            state[live] = self.next[s, x]
        return out, state % 2 == 1


class Lexicon:
    """Symbols and weights of words: a word has the largest weight among the stems that it starts with."""

    def __init__(self, stems: dict[str, float]):
        self.whole: dict[str, tuple[int, float]] = {}
        self.starts: dict[str, tuple[int, float]] = {}
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (HARM, HARMS), (INSULTS, INSULT)):
            for w in words.split():
                (self.starts if w.endswith("*") else self.whole)[w.rstrip("*")] = symbol, LEXICON_WEIGHT
        for w, weight in stems.items():
            self.starts[w] = INSULT, max(weight, self.starts.get(w, (0, 0.0))[1])
        self.sizes = sorted({len(w) for w in self.starts})

    def of(self, word: str) -> tuple[int, float]:
        best = self.whole.get(word)
        if best is None and word.endswith("n't"):
            best = NEGATION, LEXICON_WEIGHT
        for n in self.sizes:
            if n > len(word):
                break
            hit = self.starts.get(word[:n])
            if hit and (best is None or (hit[0] == INSULT, hit[1]) > (best[0] == INSULT, best[1])):
                best = hit
        return best or (OTHER, 0.0)


def word_table(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(which word each one is, the different words, text of each); a clause's end is the word of a line feed."""
    folded = [(t or "").lower().encode("utf-8", "replace").translate(FOLD).replace(b"\n", b" \n ") for t in texts]
    lists = pc.split_pattern(pa.array([b.decode("utf-8") for b in folded], pa.large_string()), " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    coded = flat.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = np.array([w != "" for w in words], bool)[which] if len(words) else np.zeros(0, bool)
    return which[keep], words, owner[keep]


def features(texts: list[str | None], lexicon: Lexicon, machine: Machine) -> np.ndarray:
    """A row for each text: the sum of weights in each of CATEGORIES, the number of hits and of words."""
    out = np.zeros((len(texts), len(CATEGORIES) + 2))
    at = 0
    for part in batches(texts, 1_000_000):
        which, words, owner = word_table(part)
        if len(which):
            said = [lexicon.of(w) for w in words]
            symbol = np.array([s for s, _ in said], np.int8)[which]
            weight = np.array([w for _, w in said])[which]
            end = np.array([w == "\n" for w in words])[which]
            new = np.concatenate(([True], end[:-1] | (owner[1:] != owner[:-1])))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(which)))
            hot = np.add.reduceat((symbol == INSULT) | (symbol == HARMS), starts) > 0
            out[at : at + len(part), -1] = np.bincount(owner[~end], minlength=len(part))
            starts, sizes = starts[hot], sizes[hot]
            said_as, aimed = machine.run(symbol, starts, sizes)
            clause = np.repeat(np.arange(len(starts)), sizes)
            word = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(clause))
            kind, goal = said_as[word], aimed[clause]
            for k, code in enumerate((INSULT, NEGATED, QUOTED, QUOTED_NEGATED)):
                for target in (False, True):
                    on = word[(kind == code) & (goal == target)]
                    out[at : at + len(part), k + 4 * target] = np.bincount(owner[on], weight[on], len(part))
                    out[at : at + len(part), -2] += np.bincount(owner[on], minlength=len(part))
            on = word[kind == THREAT]
            out[at : at + len(part), 8] = LEXICON_WEIGHT * np.bincount(owner[on], minlength=len(part))
            out[at : at + len(part), -2] += np.bincount(owner[on], minlength=len(part))
        at += len(part)
    return out


def inputs(f: np.ndarray) -> np.ndarray:
    """Columns of the regression: logarithms of the sums, of the hits a hundred words, and 1."""
    density = np.log1p(100 * f[:, -2] / np.maximum(1, f[:, -1]))
    return np.column_stack((np.log1p(f[:, : len(CATEGORIES)]), density, np.ones(len(f))))


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 3.0, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; coefficients are pulled towards `prior`, the constant hardly."""
    b, p = prior.astype(float).copy(), np.full(len(prior), pull)
    p[-1] = 0.01

    def loss(b):
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (p * (b - prior) ** 2).sum() / 2)

    now = loss(b)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        gradient = x.T @ (weight * (q - y)) + p * (b - prior)
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(p), gradient)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > now:
            size /= 2
        b -= size * step
        was, now = now, loss(b)
        if was - now < 1e-9 * max(1.0, was):
            break
    return b


@dataclass
class Model:
    stems: dict[str, float]
    coefficients: np.ndarray

    def __post_init__(self):
        self.lexicon, self.machine = Lexicon(self.stems), Machine()

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(features(list(texts), self.lexicon, self.machine)) @ self.coefficients, -500, 500)))


def stems_of(texts: list[str | None], least: int, most: int) -> Counter:
    """In how many of the texts each word start of `least` to `most` characters, or whole word of these lengths, is."""
    which, words, owner = word_table(texts)
    pairs = np.unique(owner.astype(np.int64) * max(1, len(words)) + which)
    out: Counter = Counter()
    text, word = pairs // max(1, len(words)), pairs % max(1, len(words))
    for t in np.split(word, np.flatnonzero(np.diff(text)) + 1) if len(word) else ():
        out.update({words[k][:n] for k in t.tolist() for n in range(least, min(most, len(words[k])) + 1)})
    return out


def pruned(counts: dict[str, tuple[int, int]], toxic: int, clean: int, least_odds: float = 1.5, errors: float = 2.5) -> dict[str, float]:
    """Stems and their weights, from (toxic, clean) texts with each: log odds less some standard errors.

    A stem goes if one character more keeps most of its toxic texts, for the longer one says the same with less, if a
    shorter one that stays weighs as much, or if longer ones that stay and weigh more have most of its toxic texts.
    """

    def odds(t: int, c: int) -> float:
        error = math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        return math.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1))) - errors * error

    weight = {s: odds(*tc) for s, tc in counts.items()}
    longest: dict[str, int] = {}
    for s, (t, _) in counts.items():
        longest[s[:-1]] = max(longest.get(s[:-1], 0), t)
    out: dict[str, float] = {}
    for s in sorted(counts, key=lambda s: (len(s), s)):
        if weight[s] < least_odds or longest.get(s, 0) > 0.75 * counts[s][0]:
            continue
        if max((out.get(s[:n], 0.0) for n in range(1, len(s))), default=0.0) < weight[s] - 0.3:
            out[s] = weight[s]
    order = sorted(out)
    for s in sorted(out, key=len):
        covered, top = 0, None
        for r in order[bisect_right(order, s) :]:
            if not r.startswith(s):
                break
            if out.get(r, 0.0) > out[s] + 0.5 and not (top and r.startswith(top)):
                covered, top = covered + counts[r][0], r
        if covered > 0.75 * counts[s][0]:
            del out[s]
    return out


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 10_000, least: int = 3, most: int = 8, most_stems: int = 20_000) -> Model:
    """From (doc_id, text) and (labelled, toxic): fits on a bounded sample, about `per_label` different texts of each label
    by hash, whole.

    Ids and hashes alone meet the labels; the hashes that are drawn, about 2 * per_label of them, are broadcast to fetch the
    texts. Stems are counted by Spark over the sample; those in few toxic texts or hardly more often in toxic ones don't
    come to the driver, nor more than `most_stems`, the commonest in toxic texts. Without texts of both labels there is the
    fixed lexicon and the prior alone.
    """
    h = text_hash(F.col("text"))
    d = docs.select("doc_id", h.alias("h")).join(labels.where("toxic IN (0, 1)"), F.col("doc_id") == F.col("labelled"))
    # Of each label and different text the smallest id.
    d = save(d.groupBy(F.col("toxic").cast("int").alias("toxic"), "h").agg(F.min("doc_id").alias("doc_id")), "labelled")
    sizes = {r.toxic: r.n for r in d.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, PRIOR)
    full = 1 << 31
    share = {k: min(full, -(-per_label * full // n)) for k, n in sizes.items()}
    drawn = d.where(F.pmod("h", F.lit(full)) < F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    texts = docs.withColumn("h", h).join(F.broadcast(drawn), ["doc_id", "h"])
    sample = save(texts.dropDuplicates(["toxic", "h"]).select("toxic", "text"), "toxic")
    got = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = got.get(1, 0), got.get(0, 0)
    if not toxic or not clean:
        return Model({}, PRIOR)

    def count(parts):
        both = Counter(), Counter()
        for pdf in parts:
            for k in (0, 1):
                for texts in batches(pdf.text[pdf.toxic == k].tolist(), 1_000_000):
                    both[k].update(stems_of(texts, least, most))
        stems = list(both[0].keys() | both[1].keys())
        for s in range(0, len(stems), 50_000):
            p = stems[s : s + 50_000]
            yield pd.DataFrame({"stem": p, "t": [both[1][x] for x in p], "c": [both[0][x] for x in p]})
        release()

    support = max(2, toxic // 200)
    found = sample.mapInPandas(count, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = found.where((F.col("t") >= support) & (F.col("t") * clean > 3 * F.col("c") * toxic)).orderBy(F.col("t").desc(), "stem").limit(most_stems)
    stems = pruned({r.stem: (r.t, r.c) for r in found.collect()}, toxic, clean)
    lexicon, machine = Lexicon(stems), Machine()

    def describe(parts):
        for pdf in parts:
            f = features(pdf.text.tolist(), lexicon, machine)
            yield pd.DataFrame({"toxic": pdf.toxic.to_numpy(), "f": f.tolist()})
        release()

    rows = sample.mapInPandas(describe, "toxic int, f array<double>").collect()
    y = np.array([r.toxic for r in rows], float)
    weight = np.where(y == 1, sizes[1] / toxic, sizes[0] / clean)
    order = np.lexsort(np.array([[r.toxic, *r.f] for r in rows]).T)  # sums don't depend on the order of tasks
    x = inputs(np.array([r.f for r in rows]))
    return Model(stems, regression(x[order], y[order], (weight * len(rows) / weight.sum())[order]))


def toxicity(model: Model, text: Column) -> Column:
    """Score of the whole text, 0 to 1; null and empty texts have that of a text without matches."""

    @pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        out = pd.Series(model.scores(s))
        release()
        return out

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, least_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: learns from labelled rows outside the held-out fold and scores every row.

    Labels (doc_id, toxic) other than 0 and 1 and those of ids that no document has teach nothing; an id with several labels
    or several texts teaches all of them. Only texts are inputs of a score. Null and empty texts have the score of a text
    without matches, very long ones are read whole. Repeated rows and null ids stay (fold 0), an empty table gives an
    empty one; without labels the fixed lexicon decides. Other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col("doc_id").alias("labelled"), "toxic").where("labelled IS NOT NULL AND toxic IS NOT NULL").distinct()
    with small_batches(docs.sparkSession):
        model = learn(d.where(crc_fold(F.col("doc_id"), folds) != held_out), known)
    out = d.select("doc_id", (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), toxicity(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= least_score).cast("int"))
