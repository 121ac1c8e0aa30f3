"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns documents into shards, one row each: the posting lists (places in the shard's token sequence) of
every term, or of the terms of a test set only. Shards are as large as ``SHARD_TOKENS`` and are written to the shared
folder, so that several test sets can be searched without reading texts again. ``search`` sends a block of test items
to all shards. A window starts from the posting list of its rarest term in the shard; the lists of its other terms,
shifted by their offsets, are intersected with it from rare to common, so most windows end after one lookup. No step
shuffles postings, and a frequent term or passage only lengthens lists inside its own shards.

The test set is searched in blocks of at most ``BLOCK_BYTES`` of text, each collected and sent alone; a single block
needs no shuffle at all, several are combined by document.

Null text has no words. Items without item_id are one item: its windows hit and count, but it adds nothing to the joined
names. An item of fewer than ``window`` words is one window; an item without words none. Repeated
document rows stay separate rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import documents, written

WINDOW = 10
SHARD_TOKENS = 400_000
BLOCK_BYTES = 4 << 20

#: A-Z become a-z; other ASCII but letters and digits separates words; bytes from 0x80 on are part of words.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

INDEX_SCHEMA = "shard string, doc_ids array<bigint>, n_words array<int>, terms binary, counts binary, places binary"
_HITS = "shard string, ordinal int, doc_id bigint, n_words bigint, spans array<struct<lo:int,hi:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _shard(name: str, ids: list, docs: list[np.ndarray], lengths: list[int], lexicon: list[bytes]) -> dict:
    """Posting lists of one shard: terms by code, with counts and places."""
    codes = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    places = np.flatnonzero(codes >= 0).astype(np.int32)
    codes = codes[places]
    order = np.argsort(codes, kind="stable")
    found, counts = np.unique(codes, return_counts=True)
    return {
        "shard": name,
        "doc_ids": ids,
        "n_words": lengths,
        "terms": b"\n".join(lexicon[c] for c in found),
        "counts": counts.astype(np.int32).tobytes(),
        "places": places[order].tobytes(),
    }


def build_index(docs: DataFrame, terms: set[bytes] | None = None) -> DataFrame:
    """Shards of the positional index over ``doc_id`` and ``text``; ``terms`` limits which posting lists are stored."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms) if terms is not None else None

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId(), 0
        fixed = None if sent is None else {t: i for i, t in enumerate(sorted(sent.value))}
        code = {} if fixed is None else fixed
        ids, parts, lengths, total = [], [], [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame([_shard(f"{part}-{k}", ids, parts, lengths, list(code))])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                if fixed is None:
                    coded = [code.setdefault(w, len(code)) for w in words]
                else:
                    get = fixed.get
                    coded = [get(w, -1) for w in words]
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                parts.append(np.array(coded, np.int32))
                lengths.append(len(words))
                total += len(words)
                if total >= SHARD_TOKENS or len(ids) >= 4096:
                    yield flush()
                    ids, parts, lengths, total, k = [], [], [], 0, k + 1
                    if fixed is None:
                        code = {}
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInPandas(build, INDEX_SCHEMA)
#: Places of rarest terms that a shard looks at together.
AT_ONCE = 1_000_000


class TestBlock:
    """Windows of some test items by length: term codes, and the item of each."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.code: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            coded = np.array([self.code.setdefault(w, len(self.code)) for w in words], np.int32)
            if m := min(window, len(coded)):
                by_length.setdefault(m, []).append((np.lib.stride_tricks.sliding_window_view(coded, m), k))
        self.windows = {m: (np.concatenate([w for w, _ in x]), np.repeat(np.array([k for _, k in x], np.int32), [len(w) for w, _ in x])) for m, x in by_length.items()}

    def postings(self, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each test term's list in the shard's places."""
        names = row.terms.split(b"\n") if row.terms else []
        counts, places = np.frombuffer(row.counts, np.int32), np.frombuffer(row.places, np.int32)
        ends = np.cumsum(counts)
        lo, df = np.zeros(len(self.code), np.int64), np.zeros(len(self.code), np.int64)
        get = self.code.get
        for i, name in enumerate(names):
            c = get(name)
            if c is not None:
                lo[c], df[c] = ends[i] - counts[i], counts[i]
        return lo, df, places

    def find(self, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact occurrences in a shard: first place, length and item of each."""
        lo, df, places = self.postings(row)
        n_words = np.asarray(row.n_words, np.int64)
        starts = np.concatenate([[0], np.cumsum(n_words)])
        total = int(starts[-1])
        token = np.full(total, -1, np.int32)
        for c in np.flatnonzero(df):
            token[places[lo[c] : lo[c] + df[c]]] = c
        out = [(np.zeros(0, np.int64),) * 3]
        for m, (terms, item) in self.windows.items():
            freq = df[terms]
            alive = np.flatnonzero(freq.min(axis=1) > 0) if len(terms) else []
            if not len(alive):
                continue
            terms, item, freq = terms[alive], item[alive], freq[alive]
            by_rarity = np.argsort(freq, axis=1, kind="stable")
            rare = terms[np.arange(len(terms)), by_rarity[:, 0]]
            # Windows in parts whose rarest terms have AT_ONCE places together, and each window's places in parts of that size.
            ends = np.cumsum(df[rare])
            cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]), AT_ONCE), "right")
            for a, b in zip(cuts, np.r_[cuts[1:], len(rare)], strict=True):
                for part in self._places(np.arange(a, b), terms, by_rarity, rare, lo, df, places, token, m, total):
                    w, at = part
                    ok = np.searchsorted(starts, at, "right") == np.searchsorted(starts, at + m - 1, "right")
                    out.append((at[ok], np.full(ok.sum(), m), item[w[ok]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    @staticmethod
    def _places(own, terms, by_rarity, rare, lo, df, places, token, m, total) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows ``own`` and first places where all their terms follow each other; at most ``AT_ONCE`` places at once."""
        n = df[rare[own]]
        most = int(n.max(initial=0))
        for k in range(0, most, AT_ONCE):  # one pass, but for terms of more places than that
            some = np.clip(n - k, 0, AT_ONCE)
            w = np.repeat(own, some)
            at = places[np.repeat(lo[rare[own]] + k, some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)].astype(np.int64) - by_rarity[w, 0]
            ok = (at >= 0) & (at + m <= total)
            w, at = w[ok], at[ok]
            for j in range(1, m):
                if not len(w):
                    break
                off = by_rarity[w, j]
                ok = token[at + off] == terms[w, off]
                w, at = w[ok], at[ok]
            yield w, at

    def near(self, row, slack: int, share: float) -> Iterator[tuple[int, int, int, int]]:
        """(ordinal, item, terms found, place): the best place of a window's term with ``share`` of its terms within ``slack``.

        A match lacks at most ``n - need`` of the n terms, so it holds one of any ``n - need + 1``: the rarest ones are
        looked up. Where ``2 * slack`` around them has enough terms, every place of a term within ``slack`` is counted.
        """
        lo, df, places = self.postings(row)
        starts = np.concatenate([[0], np.cumsum(np.asarray(row.n_words, np.int64))])
        span = int(starts[-1]) + 1
        present = np.flatnonzero(df)
        rank = np.zeros(len(df) + 1, np.int64)
        rank[present] = np.arange(len(present))
        base = np.zeros(len(df) + 1, np.int64)
        base[present] = np.cumsum(df[present]) - df[present]
        # All lists one after another, so that a lookup in any of them is one search.
        keys = np.concatenate([np.zeros(0, np.int64), *(places[lo[c] : lo[c] + df[c]].astype(np.int64) + k * span for k, c in enumerate(present))])

        def has(t: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            at = rank[t] * span
            return (df[t] > 0) & (np.searchsorted(keys, at + left, "left") < np.searchsorted(keys, at + right, "left"))

        def listed(t: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which of ``t`` each place belongs to, and the places: ``n`` of each list from ``first`` on."""
            own = np.repeat(np.arange(len(t)), n)
            at = keys[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            return own, at - rank[t[own]] * span

        def around(at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
            doc = np.searchsorted(starts, at, "right")
            return np.maximum(at - reach, starts[doc - 1]), np.minimum(at + reach + 1, starts[doc])

        best: dict[tuple[int, int], tuple[int, int]] = {}
        for terms, item in self.windows.values():
            m = terms.shape[1]
            terms = np.sort(terms, axis=1)
            new = np.concatenate([np.ones((len(terms), 1), bool), terms[:, 1:] != terms[:, :-1]], axis=1)
            freq = np.where(new, df[terms], np.iinfo(np.int64).max)
            order = np.argsort(freq, axis=1, kind="stable")
            terms, freq = np.take_along_axis(terms, order, axis=1), np.take_along_axis(freq, order, axis=1)
            n = new.sum(axis=1)
            need = np.maximum(1, np.ceil(share * n).astype(np.int64))
            alive = np.flatnonzero((new & (np.take_along_axis(freq, np.argsort(order, axis=1), axis=1) > 0)).sum(axis=1) >= need)
            terms, freq, n, need, item = terms[alive], freq[alive], n[alive], need[alive], item[alive]
            start = (np.arange(m) <= (n - need)[:, None]) & (freq > 0) & (np.arange(m) < n[:, None])
            work = np.cumsum(np.where(start, freq, 0).sum(axis=1)) if len(terms) else np.zeros(0, np.int64)
            for block in np.split(np.arange(len(terms)), np.flatnonzero(np.diff(work // 1_000_000)) + 1):
                w, j = np.nonzero(start[block])
                w = block[w]
                t = terms[w, j]
                own, at = listed(t, base[t], df[t])
                pairs = np.unique(w[own] * span + at)
                w, at = pairs // span, pairs % span
                left, right = around(at, 2 * slack)
                got = np.zeros(len(at), np.int64)
                for j in range(m):
                    own = j < n[w]
                    got[own] += has(terms[w[own], j], left[own], right[own])
                    keep = got + np.maximum(n[w] - j - 1, 0) >= need[w]
                    w, at, left, right, got = w[keep], at[keep], left[keep], right[keep], got[keep]
                if not len(w):
                    continue
                left, right = around(at, slack)
                found = [np.zeros(0, np.int64)]
                for j in range(m):
                    own = np.flatnonzero(j < n[w])
                    own = own[df[terms[w[own], j]] > 0]
                    t = terms[w[own], j]
                    first = np.searchsorted(keys, rank[t] * span + left[own], "left")
                    k, centre = listed(t, first, np.searchsorted(keys, rank[t] * span + right[own], "left") - first)
                    found.append(np.unique(w[own[k]] * span + centre))
                pairs = np.unique(np.concatenate(found))
                w, at = pairs // span, pairs % span
                left, right = around(at, slack)
                got = np.zeros(len(at), np.int64)
                for j in range(m):
                    own = j < n[w]
                    got[own] += has(terms[w[own], j], left[own], right[own])
                keep = got >= need[w]
                w, at, got = w[keep], at[keep], got[keep]
                doc = np.searchsorted(starts, at, "right") - 1
                for d, i, g, a in zip(doc.tolist(), item[w].tolist(), got.tolist(), (at - starts[doc]).tolist(), strict=True):
                    best[d, i] = max(best.get((d, i), (0, 0)), (g, -a))
        for (d, i), (g, a) in sorted(best.items()):
            yield d, i, g, -a


def _null_last(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def blocks_of(benchmark: DataFrame) -> list[list[tuple[str, list[bytes]]]]:
    """The test items in blocks of about ``BLOCK_BYTES``; a block is collected only when its turn comes."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted(((r["item_id"], words_of(r["text"])) for r in rows), key=lambda x: (_null_last(x[0]), x[1]))


def search_block(index: DataFrame, block: TestBlock) -> DataFrame:
    """Per document: merged hit spans and the items that occur."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = sent.value
        for batch in batches:
            for row in batch.itertuples():
                at, length, item = test.find(row)
                starts = np.concatenate([[0], np.cumsum(np.asarray(row.n_words, np.int64))])
                doc = np.searchsorted(starts, at, "right") - 1
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for i in np.lexsort((at, doc)):
                    d = int(doc[i])
                    a, b = int(at[i] - starts[d]), int(at[i] - starts[d] + length[i])
                    own = spans.setdefault(d, [])
                    if own and a <= own[-1]["hi"]:
                        own[-1]["hi"] = max(own[-1]["hi"], b)
                    else:
                        own.append({"lo": a, "hi": b})
                    items.setdefault(d, set()).add(test.names[item[i]])
                n = len(row.n_words)
                yield pd.DataFrame(
                    {
                        "shard": row.shard,
                        "ordinal": np.arange(n, dtype=np.int32),
                        "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64"),
                        "n_words": np.asarray(row.n_words, np.int64),
                        "spans": [spans.get(d, []) for d in range(n)],
                        "items": [sorted(items.get(d, ()), key=_null_last) for d in range(n)],
                    }
                )

    return index.mapInPandas(run, _HITS)


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (word places hit, merged) and items, for every document of the index."""
    found = None
    for n, items in enumerate(blocks_of(benchmark), 1):
        one = search_block(index, TestBlock(items, window))
        found = one if found is None else found.union(one)
    if n > 1:
        found = found.groupBy("shard", "ordinal", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        start = F.array().cast("array<struct<lo:int,hi:int>>")
        last = lambda a: F.element_at(a, -1)
        apart = lambda a, x: (F.size(a) == 0) | (F.get(a, F.size(a) - 1)["hi"] < x["lo"])
        merged = F.aggregate("spans", start, lambda a, x: F.when(apart(a, x), F.concat(a, F.array(x))).otherwise(F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["lo"].alias("lo"), F.greatest(last(a)["hi"], x["hi"]).alias("hi"))))))
        found = found.withColumn("spans", merged)
    return found.select("doc_id", "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def near_phrases(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 20, share: float = 0.8) -> DataFrame:
    """Proximity matches: (doc_id, item_id, n_terms, place), the best place of an item's windows in each document."""
    out = None
    for items in blocks_of(benchmark):
        sent = index.sparkSession.sparkContext.broadcast(TestBlock(items, window))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            test = sent.value
            for batch in batches:
                for row in batch.itertuples():
                    rows = [(row.doc_ids[d], test.names[i], g, a) for d, i, g, a in test.near(row, slack, share)]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_terms", "place"])

        one = index.mapInPandas(run, "doc_id bigint, item_id string, n_terms int, place int")
        out = one if out is None else out.union(one)
    return out


def lexicon(benchmark: DataFrame) -> set[bytes] | None:
    """The test terms if they fit one block, else None: then the index stores every term."""
    blocks = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if blocks > BLOCK_BYTES:
        return None
    return {w for r in benchmark.select("text").collect() for w in words_of(r["text"])}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The index of ``docs`` searched for ``benchmark``: doc_id, n_words, spans, items."""
    return search(written(build_index(docs, lexicon(benchmark)), "postings"), benchmark, window)


def digests(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["hi"] - x["lo"]).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return near_phrases(written(build_index(documents(spark, sf_dir), lexicon(benchmark)), "postings"), benchmark)


SQL = r"""
WITH low AS (SELECT 0 AS kind, row_number() OVER () AS rid, doc_id::VARCHAR AS id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id::VARCHAR, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
ws AS (SELECT kind, rid, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
tok AS (SELECT kind, rid, id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM ws),
lens AS (SELECT DISTINCT least(len(w), 10) AS m FROM ws WHERE kind = 1 AND len(w) > 0),
items AS (SELECT DISTINCT id AS item, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS m
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM ws WHERE kind = 1 AND len(w) > 0)),
grams AS (SELECT rid, s, m, array_to_string(w[s:s + m - 1], ' ') AS g
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM ws, lens WHERE kind = 0 AND len(w) >= m)),
hits AS (SELECT rid, s, grams.m, item FROM grams JOIN items ON grams.g = items.g AND grams.m = items.m),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM ws LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid) WHERE kind = 0
"""
