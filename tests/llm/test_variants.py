"""SimHash classes, collocations and spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.brute import LOW, low_words
from tidegraph.llm import collocations, simhash, spelling

SCHEMA = "doc_id long, text string, lang string, fp string, n int, key string, word string, component_id int, phrase string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "f", 1, "k", "w", 2, "p", 3) for d, t, lang in rows], SCHEMA).repartition(3)


def print_of(text, size=4):
    w = low_words(text)
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(prints, budget=4):
    """{row: least id reachable} of (id, fingerprint) rows."""
    out = []
    for d, _ in prints:
        seen, open_ = set(), [f for i, f in prints if i == d] if d is not None else []
        out.append((seen, open_))
    found = {}
    values = {f for d, f in prints if d is not None}
    for f in values:
        seen, open_ = {f}, [f]
        while open_:
            x = open_.pop()
            more = {y for y in values - seen if (x ^ y).bit_count() <= budget}
            seen |= more
            open_ += more
        found[f] = min(d for d, y in prints if d is not None and y in seen)
    return found


def words_of(seed, n, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


BASE = words_of(1, 400)
NEAR = [" ".join(w if random.Random(s).randrange(60) or random.Random(s * k).randrange(2) else "x" for k, w in enumerate(BASE.split())) for s in range(2, 60)]
TEXTS = [BASE, BASE.upper(), None, "", " \n ", "one", "one two three", "ONE two  three", "a b c d", "a b c d e", *NEAR, *[words_of(s, 30, 12) for s in range(100, 160)], words_of(3, 40_000), "same " * 3000]


def test_simhash(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(0, BASE, "en"), (3, words_of(9, 50), "en"), (None, BASE, "en"), (None, None, "en")]
    want = classes_of([(d, print_of(t)) for d, t, _ in rows])
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == sorted((d, f"{print_of(t):016x}", want[print_of(t)]) for d, t, _ in rows if d is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert len({r.component_id for r in got}) < len(TEXTS) / 1.5
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_linked_fingerprints(spark, seed):
    """Chains of near fingerprints, tight groups and random ones: components equal those of all pairs."""
    r = random.Random(seed)
    values = {0, 2**64 - 1, 1, 0b1111, 0b11111}
    for _ in range(8):
        x = r.getrandbits(64)
        for _ in range(40):
            y = x
            for b in r.sample(range(64), r.randint(0, 7)):
                y ^= 1 << b
            values.add(y)
            if r.random() < 0.3:
                x = y
    low = r.getrandbits(26)
    values |= {low | r.getrandbits(38) << 26 for _ in range(150)}  # one list of many that are far from each other
    values |= {low | (7 | r.getrandbits(6) << 10) << 26 for _ in range(60)}
    want = classes_of([(v - 2**64 if v >= 2**63 else v, v) for v in values])
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v, r.randint(1, 3)) for v in values], "fp long, n long").repartition(3)
    got = {x.node % 2**64: x.component for x in simhash.linked(nodes).collect()}
    assert {v: got.get(v, v - 2**64 if v >= 2**63 else v) for v in values} == want


def test_ring_chains():
    """Whatever the differing bits, some start keeps all chains within their shares."""
    r, parts = random.Random(5), simhash.segments()
    for _ in range(3000):
        bits = r.sample(range(64), r.randint(0, 4))
        d = [sum(a <= b < a + w for b in bits) for a, w in parts]
        assert any(all(sum((d + d)[k : k + n]) * 5 <= n * 4 for n in range(1, 6)) for k in range(5))


PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")


def mined(rows, rarest, best):
    counts = defaultdict(Counter)
    total = Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        rated = []
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= rarest}
        for g, a in candidates.items():
            if any(len(x) > len(g) and 100 * n >= 80 * a and any(x[i : i + len(g)] == g for i in range(len(x))) for x, n in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            rated.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rated)[:best])]
    return sorted(out)


def zipfs(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "new", "york", "é", "\x00", "a.b", "Ünder", "\U0001f600", "x y"] + [f"t{i}" for i in range(30)]
    out = []
    for _ in range(n):
        out.append(r.choice(["New york city hall", "of the", "the\tnew, york", "kind of"]) if r.random() < 0.2 else words[min(int(r.expovariate(0.2)), 39)])
        if r.random() < 0.1:
            out.append(r.choice([". ", "\n", " ; ", "\x0b", "!?"]))
    return " ".join(out)


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    rows = [(i, zipfs(i, 120), ("en", "de", None)[i % 3]) for i in range(90)] + [(None, None, "en"), (1, "", None), (1, zipfs(1, 120), "de"), (7, zipfs(400, 9000), "en"), (8, "one two " * 40, "fr")]
    if small:
        monkeypatch.setattr(collocations, "BEST", 25)
        monkeypatch.setattr(collocations, "CHUNK", 64)
        monkeypatch.setattr(collocations, "HELD", 300)
        monkeypatch.setattr(collocations, "BURST", 8)
    best = 25 if small else 2000
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), best).collect())
    assert got == mined(rows, 30, best)
    assert collocations.collocations(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("burst", [1, 4096])
def test_trie(burst):
    r, want = random.Random(1), Counter()
    trie = collocations.HatTrie(4, burst)
    out = Counter()
    for k in range(40):
        rows = [(r.randint(1, 5), r.randint(1, 9) << 42 | r.randint(0, 3) << 21 | r.randint(0, 2), r.randint(1, 4)) for _ in range(60)]
        for a, key, n in rows:
            want[a, key] += n
        trie.add(*map(list, zip(*rows)))
        for a, key, n in zip(*trie.spill(100)) if k % 7 == 6 else ():
            out[a, key] += n
        assert k % 7 < 6 or trie.size <= 100
    for a, key, n in zip(*trie.spill(0)):
        out[a, key] += n
    assert out == want and trie.size == 0 and not trie.root


def test_scores_beyond_64_bits(spark):
    big = 5 * 10**17
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 1)], "lang string, phrase string, f long")
    assert [tuple(r) for r in collocations.scored(counts).collect()] == [("en", "a b", big - 1, big, big + 1, 2_000_000 * (big - 1) // (2 * big + 1))]


def spelled(rows):
    n = Counter()
    for d, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            f = min(others, key=lambda v: (-n[v], v))
            if n[f] >= 2 * n[w]:
                form[w] = f
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return sorted(out)


def misspelt(seed, n):
    r = random.Random(seed)
    base = ["colour", "centre", "Übergröße", "aaaaa", "aaaaaa", "banana", "bananas", "straße", "abcde", "qwertyuiopasdfgh", "l" * 80, "été" * 3, "a×b÷cde"]
    out = []
    for _ in range(n):
        w = base[min(int(r.expovariate(0.3)), len(base) - 1)]
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            at = r.randrange(len(w))
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abeß") + w[at:], w[:at] + r.choice("abeß") + w[at + 1 :]])
        out.append(r.choice([w, w.upper(), w]) + r.choice([" ", "-", "1", "ő", ". "]))
    return "".join(out)


@pytest.mark.parametrize("group,cells", [(20_000, 1 << 20), (5, 1 << 20), (30, 200)])
def test_spelling(spark, monkeypatch, group, cells):
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "CELLS", cells)
    rows = [(i, misspelt(i, 60), "en") for i in range(60)] + [(None, misspelt(99, 30), "en"), (3, None, "en"), (4, "", "en"), (5, misspelt(5, 60), "de"), (6, misspelt(1000, 3000), "en")]
    want = grouped(spelled(rows))
    assert any(w[3] for w in want) and any(w[3] != w[5] for w in want if w[3])
    got = sorted(tuple(r) for r in spelling.variants(frame(spark, rows)).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == want
    assert spelling.variants(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_scan(seed):
    r = random.Random(seed)
    groups = [sorted({"".join(r.choice("abÿ") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 60))}) for _ in range(9)]
    parts = [p for g in groups for p in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    i, j = spelling.scan(group, parts)
    want = {(x, y) for x in range(len(parts)) for y in range(x + 1, len(parts)) if group[x] == group[y] and one_edit(parts[x], parts[y])}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)
