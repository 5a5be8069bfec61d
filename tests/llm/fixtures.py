"""Small inputs with every awkward case, and brute-force versions of the operators."""

import collections
import hashlib
import math
import random
import re
import zlib

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size string, node string, score string"


def texts(seed=1):
    r = random.Random(seed)
    vocab = ["the", "River", "ÉTÉ", "stone", "über", "niño", "walks", "12", "x's", "don't", "naïve", "ſ", "tree,", "end.", "(a)", "漢字"] + [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [some(80) for _ in range(6)]
    near = []
    for b in base[:3]:
        for _ in range(4):
            w = b.split()
            w[r.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    odd = [None, "", " ", "\n\t", "...", "one", "One two", "a  b", "a   b \n c", "x<|endoftext|>y", "   lead", "trail  ", "tab\tsep\x0bv\x0cf", " z w", "a b   c", " ", "123 456"]
    secrets = ["password = 'hunter22'", "API_KEY:abcdef99", "é token=abc", "AKIA" + "A1" * 10, "deadbeef" * 4, "secret=token: abcdefgh", "é" * 3 + " passwd: zzzzzz " + "0a" * 13, "ghp_" + "a1B2" * 10]
    long_ = some(6000)
    return base + base[:2] + near + odd + secrets + [long_, long_ + " more"] + [some(r.randint(1, 60)) for _ in range(30)]


def documents(spark, seed=1):
    rows = [(i * 3, t, ["en", "de", None][i % 3], [None, "s1", "s0", "s2"][i % 4], 0, "clash", "clash", "clash", "clash") for i, t in enumerate(texts(seed))]
    rows += [rows[0], rows[7], (None, "no id here at all but seven words", "en", "s1", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def crc(i):
    return 0 if i is None else zlib.crc32(str(i).encode())


def shingles(t):
    w = tokens(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        p[find(a)] = find(b)
    return [find(x) for x in range(n)]


def contamination(text, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        n = min(13, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                items.add(str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def secrets(text):
    d = (text or "").encode()
    out = []
    for m in re.finditer(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", d, re.I):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", d) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(rb"[0-9a-f]+", d) if len(m[0]) >= 24]
    at = lambda x: len(d[:x].decode())
    return [(at(a), k, at(e)) for a, k, e in sorted(out)]


def base_scores(rows, fold=7, out=2):
    c = collections.Counter()
    for i, t in rows:
        if crc(i) % fold != out:
            c.update([*tokens(t), "\0"])
    n, v = sum(c.values()), len(c)
    return {(i, t): (len(tokens(t)) + 1, sum(c[w] > 0 for w in [*tokens(t), "\0"]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*tokens(t), "\0"])) for i, t in rows}
