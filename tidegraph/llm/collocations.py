"""Phrase collocation mining: phrases of two to four words whose parts rarely come without each other.

Phrases are counted in a HAT-trie in each task: under a shallow trie over word ids lie hash containers of what is left of a
phrase; a container that grows past ``BURST`` bursts into one container for each next word. When the trie holds ``HELD``
phrases, whole subtrees, those whose phrases repeat least first, are spilled as runs sorted by word ids and handed to the
shuffle, which deals them by hash of the whole phrase and merges equal phrases. (Dealt by a prefix, a phrase that begins
like many others would put them all into one task.)

A phrase can't occur more often than its parts, so phrases are counted level by level: words, then pairs of frequent words,
then phrases of three and four whose pairs are all frequent. Which parts are frequent is sent as a bit map of fixed size,
whatever the input: a wrongly set bit costs a count and changes no result.

Null text is empty; a null lang is ``und``. Rows without doc_id or with repeated ids count like others. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import discard, documents, mix, written

LONGEST = 4
RAREST = 30
COVERED = 80
BEST = 2000
SCALE = 2_000_000
#: Bits of the maps of frequent words and pairs.
WORD_BITS, PAIR_BITS = 1 << 24, 1 << 26
#: Phrases in one container before it bursts; phrases in a trie before it spills half of them.
BURST, HELD = 4096, 250_000
#: Bytes of text that are counted at once, and word ids (21 bits each) that a task knows at once.
CHUNK, IDS = 2 << 20, (1 << 21) - 1
_GAP = b"\xff"  # no byte of UTF-8: stands for what parts pieces
_FIXED = bytes(b + 32 if 0x41 <= b <= 0x5A else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _chunks(texts: list[str]) -> Iterator[list[bytes]]:
    """Words of texts in lower case, with ``_GAP`` between pieces, some ``CHUNK`` bytes at once; a long text is cut at a gap."""
    held: list[bytes] = []
    size = 0

    def words() -> list[bytes]:
        return _GAP.join(held).replace(_GAP, b" " + _GAP + b" ").split()

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").translate(_FIXED)
        while raw:
            end = len(raw) if len(raw) <= CHUNK else raw.find(_GAP, CHUNK)
            end = len(raw) if end < 0 else end
            held.append(raw[:end])
            size += end
            raw = raw[end + 1 :]
            if size >= CHUNK:
                yield words()
                held, size = [], 0
    if held:
        yield words()


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for rows in batches:
        for i in range(0, rows.num_rows, 1024):  # few texts at once are turned into Python's
            batch = rows.slice(i, 1024).to_pandas()
            for lang, texts in batch["text"].groupby(batch["lang"].fillna("und")):
                for words in _chunks(texts[texts.notna()].tolist()):
                    yield lang, words


_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _batch(lang: pa.Array, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(f, pa.int64())], schema=_SCHEMA)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word, and of phrase null the count of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}

        def spilled() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(_GAP, None)
                words = [None, *sorted(counts)]
                n = np.array([sum(counts.values()), *map(counts.__getitem__, words[1:])], np.int64)
                yield _batch(pa.repeat(pa.scalar(lang, pa.string()), len(words)), pa.array(words, pa.binary()), n)
            held.clear()

        for lang, words in _by_lang(batches):
            held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > 2 * HELD:
                yield from spilled()
        yield from spilled()

    return _text(docs).mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), "text")


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _seed(lang))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _TURN + right)


def bit_map(phrases: DataFrame, bits: int) -> np.ndarray:
    """The map of words or pairs (lang, phrase): ``bits`` bits, made of at most one row for each 64 of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = [[_hash(lang, w) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")] for lang, phrase in zip(batch["lang"], batch["phrase"], strict=True)]
            h = np.array(h, np.uint64).reshape(len(batch), -1)
            h = _pair(h[:, 0], h[:, 1]) if h.shape[1] == 2 else h[:, 0]
            at = h & np.uint64(bits - 1)
            yield pd.DataFrame({"slot": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    rows = phrases.select("lang", "phrase").mapInPandas(run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _held_by(found: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(64 * len(found) - 1)
    return (found[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Words(dict):
    """Ids of one language's frequent words; 0 stands for any other and for gaps."""

    def __init__(self, lang: str, frequent: np.ndarray, known: list[tuple[str, bytes]], hashes: list[int]):
        super().__init__({_GAP: 0})
        self.lang, self.seed, self.known, self.hashes = lang, _seed(lang), known, hashes
        self.frequent, self.last = memoryview(frequent.view(np.uint8)), 64 * len(frequent) - 1

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        at, found = h & self.last, 0
        if self.frequent[at >> 3] >> (at & 7) & 1:  # little-endian words: byte by byte
            self.known.append((self.lang, word))
            self.hashes.append(h)
            found = len(self.known) - 1
        self[word] = found
        return found


class HatTrie:
    """Counts of phrases of ``deepest`` words at most, as (first id, the others' ids packed by 21 bits)."""

    def __init__(self, deepest: int, burst: int = BURST):
        self.deepest, self.burst = deepest, burst
        self.root: dict[int, dict] = {}
        self.split: set[int] = set()  # first ids whose container has burst
        self.size = 0

    def add(self, first: list[int], rest: list[int], counts: list[int]) -> None:
        root, split, burst = self.root, self.split, self.burst if self.deepest > 2 else None
        before = None
        box: dict = {}
        for a, key, n in zip(first, rest, counts, strict=True):
            if a != before:
                box, before = root.get(a), a
                if box is None:
                    box = root[a] = {}
            if a in split:
                box = root[a].setdefault(key >> 42, {})
                key &= (1 << 42) - 1
            if key in box:
                box[key] += n
            else:
                box[key] = n
                self.size += 1
                # A container whose phrases end with the next word has nothing to part.
                if burst and len(box) > burst and a not in split:
                    self._part(a)

    def _part(self, a: int) -> None:
        parted: dict[int, dict[int, int]] = {}
        for key, n in self.root[a].items():
            parted.setdefault(key >> 42, {})[key & ((1 << 42) - 1)] = n
        self.root[a] = parted
        self.split.add(a)

    def spill(self, down_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out whole subtrees until ``down_to`` phrases are left, those first whose phrases repeat least: first ids, the
        others' ids and counts."""
        order: list[int] = list(self.root)
        if down_to:
            split, worth = self.split, {}
            for a, box in self.root.items():
                if a in split:
                    worth[a] = sum(sum(x.values()) for x in box.values()) / sum(map(len, box.values()))
                else:
                    worth[a] = sum(box.values()) / len(box)
            order.sort(key=worth.__getitem__)
        first: list[int] = []
        many: list[int] = []
        rest: list[int] = []
        counts: list[int] = []
        for a in order:
            if self.size <= down_to:
                break
            before = len(rest)
            box = self.root.pop(a)
            if a in self.split:
                self.split.discard(a)
                for b, own in box.items():
                    rest += [b << 42 | key for key in own]
                    counts += own.values()
            else:
                rest += box
                counts += box.values()
            first.append(a)
            many.append(len(rest) - before)
            self.size -= len(rest) - before
        return np.repeat(np.array(first, np.int64), many), np.array(rest, np.int64), np.array(counts, np.int64)


def phrase_counts(docs: DataFrame, words: np.ndarray, pairs: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f): of pairs of frequent words; given the map of frequent ``pairs``, of longer phrases made of them."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, chained = sent.value
        trie = HatTrie(2 if chained is None else LONGEST)
        known, hashes, langs = [("", b"")], [0], {}

        def spilled(down_to: int) -> Iterator[pa.RecordBatch]:
            first, rest, f = trie.spill(down_to)
            if not len(first):
                return
            order = np.lexsort((rest, first))  # a run is in the order of word ids
            ids = [first, rest >> 42, rest >> 21 & IDS, rest & IDS]
            lang, word = pa.array([x for x, _ in known], pa.string()), pa.array([w for _, w in known], pa.binary())
            size = sum((i > 0).astype(np.int8) for i in ids)
            for n in np.unique(size):
                own = order[size[order] == n]
                for i in range(0, len(own), 100_000):
                    some = own[i : i + 100_000]
                    yield _batch(lang.take(pa.array(first[some])), pc.binary_join_element_wise(*[word.take(pa.array(x[some])) for x in ids[:n]], b" "), f[some])

        def counted(first: np.ndarray, rest: np.ndarray) -> None:
            if len(first):
                if chained is None:  # pairs fit one number
                    key = np.sort(first << 21 | rest >> 42)
                    first, rest = key >> 21, (key & IDS) << 42
                else:
                    order = np.lexsort((rest, first))
                    first, rest = first[order], rest[order]
                new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])
                trie.add(first[new].tolist(), rest[new].tolist(), np.diff(np.r_[new, len(first)]).tolist())

        for lang, tokens in _by_lang(batches):
            step = min(CHUNK // 2, 1 << 20)
            for start in range(0, len(tokens), step):  # a phrase belongs to the slice in which it begins
                if len(known) > IDS - step - LONGEST or sum(map(len, langs.values())) > 2 * HELD:
                    yield from spilled(0)
                    known, hashes, langs = [("", b"")], [0], {}
                if lang not in langs:
                    langs[lang] = Words(lang, frequent, known, hashes)
                some = tokens[start : start + step + LONGEST - 1]
                ids = np.fromiter(map(langs[lang].__getitem__, some), np.int64, len(some))
                if chained is None:
                    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                    at = at[at < step]
                    counted(ids[at], ids[at + 1] << 42)
                else:
                    h = np.array(hashes, np.uint64)[ids]
                    good = (ids[:-1] > 0) & (ids[1:] > 0)
                    at = np.flatnonzero(good)
                    good[at] = _held_by(chained, _pair(h[at], h[at + 1]))
                    three = good[:-1] & good[1:]
                    at = np.flatnonzero(three[:step])
                    counted(ids[at], ids[at + 1] << 42 | ids[at + 2] << 21)
                    at = np.flatnonzero((three[:-1] & three[1:])[:step])
                    counted(ids[at], ids[at + 1] << 42 | ids[at + 2] << 21 | ids[at + 3])
            if trie.size > HELD:
                yield from spilled(HELD // 2)
        yield from spilled(0)

    counts = _text(docs).mapInArrow(run, "lang string, phrase string, f bigint")
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def scored(counts: DataFrame) -> DataFrame:
    """Candidates of ``counts`` (lang, phrase, f; whole, with all parts) with a, l, r and score of their lowest-scoring cut."""
    candidates = counts.where("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("front"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("back"))
    left = counts.select("lang", F.col("phrase").alias("front"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("back"), F.col("f").alias("r"))
    # Decimals of 38 digits: the product passes 64 bits long before the counts do.
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    cuts = cuts.join(left, ["lang", "front"]).join(right, ["lang", "back"]).withColumn("score", score.cast("bigint"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")


def covered(counts: DataFrame, percent: int = COVERED) -> DataFrame:
    """(lang, phrase, most) of phrases inside longer candidates, with the largest count of those."""
    longer = counts.select("lang", "f", F.split("phrase", " ").alias("w")).where("size(w) > 2")
    inner = "flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))"
    return longer.select("lang", "f", F.explode(F.expr(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``best`` phrases of ``docs`` (lang, text)."""
    words = written(word_counts(docs).where(F.col("phrase").isNull() | (F.col("f") >= RAREST)), "words")
    totals = words.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    words = words.where("phrase IS NOT NULL")
    frequent = bit_map(words, WORD_BITS)
    pairs = written(phrase_counts(docs, frequent).where(F.col("f") >= RAREST), "pairs")
    longer = written(phrase_counts(docs, frequent, bit_map(pairs, PAIR_BITS)).where(F.col("f") >= RAREST), "longer")
    counts = words.union(pairs).union(longer)
    kept = scored(counts).join(covered(counts), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < COVERED * F.col("a"), F.lit(True)))
    ranked = kept.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")).where(F.col("rank") <= best)
    ranked = written(ranked, "ranked")  # at most ``best`` rows a language
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = r"""
WITH low AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM low)),
gram AS (SELECT lang, k, w[s:s + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM piece, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
freq AS MATERIALIZED (SELECT lang, g, len(g) AS k, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT * FROM freq WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, g, k, f, unnest(range(1, k)) AS c FROM cand),
rated AS (SELECT cut.lang, cut.g, cut.f AS a, cut.c, x.f AS l, y.f AS r, (2000000::HUGEINT * cut.f) // (x.f::HUGEINT + y.f) AS score
  FROM cut JOIN freq x ON x.lang = cut.lang AND x.g = cut.g[1:cut.c] JOIN freq y ON y.lang = cut.lang AND y.g = cut.g[cut.c + 1:]),
lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_ AS (SELECT lang, g[s:s + m - 1] AS g, max(f) AS most FROM (SELECT lang, g, k, f, m, unnest(range(1, k - m + 2)) AS s FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM lowest LEFT JOIN inner_ USING (lang, g) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang)
"""
