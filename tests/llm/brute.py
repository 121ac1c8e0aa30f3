"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from math import ceil, log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low_words(text):
    return WORD.findall((text or "").translate(LOW))


def repeats(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} of distinct (doc_id, text)."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k=5):
    w = low_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows):
    """{doc_id: (n_shingles, component_id)}."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def contamination(docs, items, window=10):
    """[(doc_id, n_words, n_hit, items)] in the order of ``docs``."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    wins = {}
    for name, t in items:
        w = split(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[i : i + m]), set()).add(name if name is None else str(name))
    out = []
    for doc_id, t in docs:
        w, hit, names = split(t), set(), set()
        for m in {len(k) for k in wins}:
            for i in range(len(w) - m + 1):
                own = wins.get(tuple(w[i : i + m]))
                if own:
                    hit |= set(range(i, i + m))
                    names |= own
        out.append((doc_id, len(w), len(hit), sorted(names, key=lambda x: (x is None, x or ""))))
    return out


def near(docs, items, window=10, slack=20, share=0.8):
    """[(doc_id, item, n_terms, place)]: per document row and item the most terms around a term's place, and its first place."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    out = []
    for doc_id, t in docs:
        words = split(t)
        for name, u in items:
            w, best = split(u), None
            m = min(window, len(w))
            for s in range(len(w) - m + 1 if m else 0):
                terms = set(w[s : s + m])
                for p, x in enumerate(words):
                    if x in terms:
                        got = len(terms & set(words[max(0, p - slack) : p + slack + 1]))
                        if got >= ceil(share * len(terms)):
                            best = max(best or (0, 0), (got, -p))
            if best:
                out.append((doc_id, name, best[0], -best[1]))
    return out


def unigram(rows):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = {d: [*low_words(t), "\n"] for d, t in rows}
    c = Counter(w for d, ws in tokens.items() if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}
