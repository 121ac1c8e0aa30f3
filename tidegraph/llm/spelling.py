"""Spelling variants: words of a vocabulary that are one edit apart, and the form that each belongs to.

Two words one edit apart are equal outside any part that holds the edit. Words are grouped by what is left of them without
one part, first the front or the back half; a group of more than ``GROUP`` words is regrouped by halves of its part, until
the part is one code point and the alphabet bounds the group. So every pair meets in exactly one group: the one whose part
holds the place where the two words first differ.

In a task, groups are sorted lists of the parts. A list is scanned once for all its words: rows of the edit matrix, three
cells wide, are computed once for each distinct prefix (adjacent longest common prefixes say where prefixes begin and end)
and are reused by all words with that prefix; of a prefix that is more than one edit away from a word, the whole range is
skipped.

Null text has no words; a null doc_id is written as empty text in the hashed string. Rows that repeat an id are texts like
others and count each. Ties are broken as stated: largest count, then code-point order. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import discard, documents, written

MODULUS = 97
SHORTEST = 5
RAREST = 3
#: Groups of more words are regrouped by a smaller part.
GROUP = 20_000
#: Words whose counts a task holds before it hands them on, and cells of parts that it scans at once.
HELD = 400_000
CELLS = 1 << 20
#: Pairs of a word and a prefix that are extended at once.
FRONT = 1 << 20
_FAR = 9
#: Latin-1 text with A-Z in lower case and everything but letters blank.
_LETTERS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def noisy_words(doc_id: int | None, text: str | None) -> Counter[str]:
    """Words of one text of at least ``SHORTEST`` code points, some with a code point deleted, and how often each occurs."""
    out: Counter[str] = Counter()
    if not text:
        return out
    runs = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
    before = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    for run, n in runs.items():
        if len(run) < SHORTEST:
            continue
        word = run.decode("latin-1")
        h = zlib.crc32(run if run.isascii() else word.encode(), before)
        if h % MODULUS == 0:
            at = h % len(run)
            word = word[:at] + word[at + 1 :]
            if len(word) < SHORTEST:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of every word that occurs at least ``RAREST`` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for word, n in noisy_words(None if pd.isna(doc_id) else int(doc_id), text).items():
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = {}
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    counted = docs.select("doc_id", "text").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= RAREST)


def _parted(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """``rows`` (word, n, m) with their part [start, end) of words of m code points; of words of m + 1 it is one longer."""
    longer = (F.length("word") > F.col("m")).cast("int")
    rows = rows.withColumns({"a": start, "b": end}).withColumn("stop", F.col("b") + longer)
    head, tail = F.expr("substring(word, 1, a)"), F.expr("substring(word, stop + 1)")
    key = F.concat_ws(" ", F.concat_ws(",", "m", "a", "b"), head, tail)
    return rows.select("word", "n", "m", "a", "b", key.alias("key"), F.expr("substring(word, a + 1, stop - a)").alias("part"))


def _groups(words: DataFrame) -> DataFrame:
    """Words by what is left without one part, in groups of ``GROUP`` or of one-letter parts."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.when(size > SHORTEST, F.array(size - 1, size)).otherwise(F.array(size))).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    rows = _parted(rows, F.lit(0), half).union(_parted(rows, half, F.col("m")))
    now, done = written(rows, "groups"), None
    while True:
        large = written(now.where("b - a > 1").groupBy("key").count().where(F.col("count") > GROUP).select("key"), "large")
        if not large.limit(1).count():
            return now if done is None else done.union(now)
        small = now.join(large, "key", "left_anti").select(now.columns)
        done = small if done is None else done.union(small)
        again = now.join(large, "key", "left_semi").select("word", "n", "m", F.col("a").alias("a0"), F.col("b").alias("b0"))
        middle = F.floor((F.col("a0") + F.col("b0")) / 2).cast("int")
        now = written(_parted(again, F.col("a0"), middle).union(_parted(again, middle, F.col("b0"))), "groups")


def scan(group: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of the parts of one group that are exactly one edit apart.

    ``group`` rises; within a group, parts are distinct and in code-point order.
    """
    raw = [p.encode("latin-1") for p in parts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    width, n = int(size.max(initial=0)), len(raw)
    cells = np.zeros((n, width + 2), np.uint8)  # no letter is zero
    cells[:, :width] = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n, width)
    same = cells[1:, :width] == cells[:-1, :width]
    shared = np.full(n + 1, -1)
    shared[1:n] = np.where(group[1:] == group[:-1], np.where(same.all(1), width, same.argmin(1)), -1)
    bounds = np.flatnonzero(shared < 0)  # where groups begin, and the end
    found: list[np.ndarray] = []
    # Words whose rows are extended together: so many that their first letters stay within the front.
    step = max(64, FRONT // 32)
    for lo in range(0, n, step):
        word = np.arange(lo, min(n, lo + step))
        at = np.searchsorted(bounds, word, "right")
        begin, end = bounds[at - 1], bounds[at]
        keep = end - begin > 1
        word, begin, end = word[keep], begin[keep], end[keep]
        left, mid, right = np.full(len(word), _FAR), np.zeros(len(word), np.int64), np.ones(len(word), np.int64)
        for d in range(width + 1):
            # A part that ends here is the first of its range.
            ends = (size[begin] == d) & (begin > word)
            gap = size[word] - d
            cell = np.where(gap == 0, mid, np.where(gap == 1, right, np.where(gap == -1, left, _FAR)))
            hit = ends & (cell == 1)
            found.append(np.stack([word[hit], begin[hit]]))
            if d == width or not len(word):
                break
            starts = np.flatnonzero((shared[:n] <= d) & (size > d))  # prefixes of d + 1 letters
            stops = np.flatnonzero(shared <= d)
            first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
            many = last - first
            pick = np.repeat(np.arange(len(word)), many)
            child = starts[np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many) + first[pick]]
            stop = stops[np.searchsorted(stops, child, "right")]
            later = stop > word[pick] + 1  # pairs once: the other word comes later
            pick, child, stop = pick[later], child[later], stop[later]
            word, left, mid, right = word[pick], left[pick], mid[pick], right[pick]
            letter = cells[child, d]
            new_left = np.minimum(left + (cells[word, d - 1] != letter) if d else left, mid + 1)
            new_mid = np.minimum(np.minimum(mid + (cells[word, d] != letter), right + 1), new_left + 1)
            new_right = np.minimum(right + (cells[word, d + 1] != letter), new_mid + 1)
            near = np.minimum(np.minimum(new_left, new_mid), new_right) <= 1
            word, begin, end = word[near], child[near], stop[near]
            left, mid, right = new_left[near], new_mid[near], new_right[near]
    i, j = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    return i, j


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words (a, n_a, b, n_b) that differ by exactly one inserted, deleted or replaced code point, each once."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        parts = rows["part"].tolist()
        i, j = scan(rows["key"].factorize()[0], parts)
        words, n, m = rows["word"].to_numpy(object), rows["n"].to_numpy(), rows["m"].to_numpy()
        a, b, last = rows["a"].to_numpy(), rows["b"].to_numpy(), rows["b"].to_numpy() == m
        long = np.array([len(w) for w in words]) > m
        keep = ~(long[i] & long[j])  # two words of m + 1 meet in their own groups
        # An insertion at the end of a part belongs to the next part.
        kept = [k and (bool(last[x]) or not parts[y].startswith(parts[x])) for k, x, y in zip(keep.tolist(), i.tolist(), j.tolist(), strict=True)]
        i, j = i[kept], j[kept]
        assert (a[i] == a[j]).all() and (b[i] == b[j]).all()
        return pd.DataFrame({"a": words[i], "n_a": n[i], "b": words[j], "n_b": n[j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        cells = 0
        for batch in batches:
            held.append(batch)
            cells += int(batch["part"].str.len().max()) * len(batch)
            if cells >= CELLS:
                rows = pd.concat(held, ignore_index=True)
                open_ = rows["key"] == rows["key"].iloc[-1]
                if not open_.all():
                    yield pairs(rows[~open_].reset_index(drop=True))
                held, cells = [rows[open_]], int(open_.sum()) * int(rows["part"].str.len().max())
                if open_.all():
                    cells = 0
        if held:
            yield pairs(pd.concat(held, ignore_index=True))

    dealt = _groups(words).repartition("key").sortWithinPartitions("key", "part")
    return dealt.mapInPandas(run, "a string, n_a bigint, b string, n_b bigint")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs`` (doc_id, text)."""
    words = written(vocabulary(docs), "words")
    pairs = written(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.minus")).alias("other_n"))
    taken = F.col("other_n") >= 2 * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("other")).alias("form"), F.when(taken, F.col("other_n")).alias("form_n"))
    rows = written(rows, "forms")
    # Each round doubles how far forms are followed; counts double along them, so rounds are few.
    ways = written(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "ways")
    while ways.where("moved").limit(1).count():
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        discard(ways)
        ways = after
    return rows.join(ways.drop("moved"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


#: Near words meet on patterns with one code point blanked, or where the longer one lacks one; the checksum is made by its rule.
SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS x(i))),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents WHERE text IS NOT NULL),
counted AS MATERIALIZED (SELECT d, w, count(*) AS c, hex(d || ':' || w) AS x FROM run WHERE length(w) >= 5 GROUP BY ALL),
sums AS MATERIALIZED (SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x[2 * i + 1:2 * i + 2])::BIGINT for i in range(length(x) // 2)]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM counted, tab),
voc AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM sums) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
cut AS MATERIALIZED (SELECT word, w[1:i] || '_' || w[i + 2:] AS blanked, w[1:i] || w[i + 2:] AS shorter FROM (SELECT word, word AS w, unnest(range(length(word))) AS i FROM voc)),
less AS (SELECT DISTINCT cut.word AS a, voc.word AS b FROM cut JOIN voc ON voc.word = cut.shorter),
pair AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.blanked = y.blanked AND x.word <> y.word UNION ALL SELECT a, b FROM less UNION ALL SELECT b, a FROM less),
ranked AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pair JOIN voc ON voc.word = b),
form AS MATERIALIZED (SELECT word, voc.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 2 * voc.n THEN b END AS form, CASE WHEN ranked.n >= 2 * voc.n THEN ranked.n END AS form_n FROM voc LEFT JOIN ranked ON a = word AND r = 1),
up AS (SELECT word, form AS root FROM form WHERE form IS NOT NULL UNION ALL SELECT up.word, form.form FROM up JOIN form ON form.word = up.root WHERE form.form IS NOT NULL)
SELECT form.word, form.n, form.n_near, form.form, form.form_n, coalesce(last.root, form.word) AS root
FROM form LEFT JOIN (SELECT up.word, up.root FROM up JOIN form ON form.word = up.root WHERE form.form IS NULL) last ON last.word = form.word
"""
