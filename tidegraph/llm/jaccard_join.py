"""Size-aware heavy-light Jaccard join on word shingles, and the classes it links.

Documents of equal shingle sets are one node. For the others, in one global order of shingles:

* small sets give signatures of the ``SUBSET`` smallest fixed-size subsets: every pair of shingles out of the prefix in
  which two sets linked at the threshold must share two;
* large sets are kept in inverted lists of their prefix, in which linked sets must share one, and the lists are scanned;
* sets just below the boundary do both, so that pairs across it meet.

The boundary is the set size at which both together cost least: signatures for small sets, list entries and the lists
scanned for large ones, from the sizes and list lengths that the sample of documents shows (``costs``).
The order puts shingles that a bounded sample of documents shows to be frequent last. It only steers cost: the prefix
rule holds for any order, so results do not depend on it.

Lists are not expanded into all pairs. In ``ROUNDS`` rounds each list compares members with one centre: the member with
most links so far, then the one most of whose signatures are shared; verified links give classes, and only lists that
still hold several go on. What is left of them is compared in blocks, members of different classes with each other, on
maps of parities that bound what two sets can share. So copies, however many, cost a comparison a round, and no link
that could join two classes is left out. Links are verified on the whole sets, as sets of 64-bit hashes of shingles.

Null text, or text without words: an empty set, linked with nothing. Rows without doc_id are left out of links and keep
a null component. Repeated rows of one id are judged by the text whose set comes first and all return. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import SENT_IDS, components, discard, documents, low_words, mix, with_ids, written

SHINGLE = 5
#: Similarity of at least this many hundredths.
PERCENT = 80
SUBSET = 2
#: One document in so many shows which shingles are frequent.
SAMPLE = 8
#: Sets of this many shingles are always large.
LARGEST = 64
RESIDUES = 1 << 20
#: Rounds of centres before what is left of lists is compared member by member.
ROUNDS = 3
BLOCK = 2048
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes, made for many texts at once."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, WordHashes()

    def sets(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        texts = list(texts)
        for i in range(0, len(texts), 256):
            out += self._some(texts[i : i + 256])
        return out

    def _some(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > 400_000:
            self.known.clear()
        words = [low_words(t) for t in texts]
        n = np.array([len(w) for w in words])
        h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
        k, starts = self.size, np.cumsum(n) - n
        last = max(0, len(h) - k + 1)
        total = np.full(last, k, np.uint64)
        for j in range(k):
            total += h[j : j + last] * _POWERS[j]
        total = mix(total)
        out = []
        for at, size in zip(starts, n, strict=True):
            if size >= k:
                out.append(np.unique(total[at : at + size - k + 1]))
            elif size:
                whole = np.uint64(size) + (h[at : at + size] * _POWERS[:size]).sum(dtype=np.uint64)
                out.append(mix(np.array([whole])))
            else:
                out.append(h[:0])
        return out


def parities(s: np.ndarray) -> bytes:
    """One bit for each residue of the hashes, set if an odd number of shingles has it; about two bits a shingle."""
    bits = 1 << min(20, max(6, int(2 * len(s)).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def at_most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """Upper bound of the shingles that sets of ``n`` and ``m`` share: each odd bit of both together is one that they don't.

    The larger map folds to the residues of the smaller.
    """
    w = min(len(x), len(y))
    return (n + m - int(np.bitwise_count(_folded(x, w) ^ _folded(y, w)).sum())) // 2


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A map of parities by ``width`` bytes of residues."""
    a = np.frombuffer(bits, np.uint8)
    while len(a) > width:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def need(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of ``n`` shares with any set linked to it, at least."""
    return -(-percent * n // 100)


def boundary(costs: list[tuple[int, int, int]], percent: int = PERCENT) -> int:
    """The set size up to which sets are small, so that the whole cost is least; of equal costs the smallest size.

    ``costs`` has (size, sets, scanned): of sets of a size, how many there are and how long the lists of their prefixes
    are together. A small set costs its signatures, a large one its list entries and what they scan; sets just below
    the boundary cost both. Sizes of ``LARGEST`` and more are never small.
    """

    def total(small: int) -> int:
        out = 0
        for n, sets, scanned in costs:
            p = n - need(n, percent) + 1
            out += (sets * (p + 1) * p // 2 if n <= small else 0) + (sets * p + scanned if 100 * n > percent * small else 0)
        return out

    return min(range(1, LARGEST), key=lambda small: (total(small), small))


def signatures(ordered: np.ndarray, small: int, percent: int = PERCENT) -> np.ndarray:
    """Signatures of one set whose shingles are in the global order."""
    n = len(ordered)
    if n < 2:
        return ordered[:0]  # a single shingle is linked to equal sets only
    p = n - need(n, percent) + 1
    found = []
    if n <= small:
        head = ordered[: p + SUBSET - 1]
        i, j = np.triu_indices(len(head), 1)
        found.append(mix(np.minimum(head[i], head[j]) * _POWERS[1] + mix(np.maximum(head[i], head[j]))))
    if 100 * n > percent * small:
        found.append(ordered[:p])
    return np.concatenate(found)


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _sample(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")


def frequencies(docs: DataFrame) -> np.ndarray:
    """How frequent shingles are in every ``SAMPLE``-th document, by residue.

    The map has ``RESIDUES`` entries whatever the input; a residue shows its most frequent shingle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            sets = shingler.sets(batch["text"])
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.int64)})

    counts = _sample(docs).mapInPandas(run, "h long").groupBy("h").count().where("count >= 3")
    residue = F.col("h").bitwiseAND(F.lit(RESIDUES - 1))
    rows = counts.groupBy(residue.cast("int").alias("r")).agg(F.max("count").alias("c")).toPandas()
    found = np.zeros(RESIDUES, np.int32)
    found[rows["r"].to_numpy()] = np.minimum(rows["c"].to_numpy(), 1 << 30)
    return found


def in_order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the global order: rarest first, as far as the sample shows."""
    return s[np.argsort(frequent[(s & np.uint64(len(frequent) - 1)).astype(np.int64)], kind="stable")]


def costs(docs: DataFrame, frequent: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(size, sets, scanned) of the sample's sets of fewer than ``LARGEST`` shingles; fewer than ``LARGEST`` rows."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, frequent = Shingler(), sent.value
        for batch in batches:
            rows = []
            for s in shingler.sets([t for t in batch["text"] if len(low_words(t)) < LARGEST + SHINGLE]):
                if 1 < len(s) < LARGEST:
                    head = in_order(s, frequent)[: len(s) - need(len(s), percent) + 1]
                    seen = frequent[(head & np.uint64(len(frequent) - 1)).astype(np.int64)].astype(np.int64)
                    rows.append((len(s), int(np.maximum(1, seen * SAMPLE).sum())))
            yield pd.DataFrame(rows, columns=["n", "scanned"])

    found = _sample(docs).mapInPandas(run, "n int, scanned long").groupBy("n").agg(F.count("*").alias("sets"), F.sum("scanned").alias("scanned"))
    return [tuple(r) for r in found.collect()]


_SETS = "doc_id bigint, n_shingles bigint, key binary, bits binary, sig array<bigint>"


def set_table(docs: DataFrame, small: int, frequent: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """Size, identity and signatures of every document's set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, frequent = Shingler(), sent.value
        for batch in batches:
            rows = []
            for doc_id, s in zip(batch["doc_id"], shingler.sets(batch["text"]), strict=True):
                ordered = in_order(s, frequent)
                key = _key(s.tobytes())
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(s), key, parities(s), signatures(ordered, small, percent).astype(np.int64)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "key", "bits", "sig"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, _SETS)


def verified(pairs: DataFrame, maps: DataFrame, docs: DataFrame, repeated: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked.

    ``maps`` (doc_id, n, bits) rules most others out: parities bound what two sets can share. Only of pairs that stay
    are sets made again and sent. ``repeated`` (doc_id, key) names the set that counts where ids repeat.
    """

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            raw = [s.tobytes() for s in shingler.sets(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": [_key(s) for s in raw], "s": raw})

    def enough(both: int, n: int, m: int) -> bool:
        return 100 * both >= percent * (n + m - both)

    def may(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [enough(at_most_shared(x, y, n, m), n, m) for x, y, n, m in zip(batch["xa"], batch["xb"], batch["na"], batch["nb"], strict=True)]
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    left = maps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = maps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    near = written(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb").mapInPandas(may, "a bigint, b bigint"), "near")
    ids = written(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "ids")
    own = with_ids(docs, ids).mapInPandas(sets, "doc_id bigint, key binary, s binary")
    if repeated is not None:
        own = own.join(repeated, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id"])
    own = written(own.drop("key"), "sets")
    left = own.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = own.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    links = written(near.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInPandas(judge, "a bigint, b bigint"), "links")
    discard(own)
    return links


def _close(n: str, m: str, percent: int):
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of lists that hold more than one class."""
    members = written(members, "members")
    sigs = written(members.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig"), "mixed")
    return written(members.join(sigs, "sig", "left_semi"), "members")


def across(members: DataFrame, maps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of different classes in one list that the parities of their sets leave possible.

    A list is dealt in blocks of about ``BLOCK`` members, and a task holds two blocks at most; pairs that are ruled out
    never leave it.
    """
    sizes = written(members.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    rows = members.select("sig", "doc_id", "component").join(sizes, "sig").join(maps, "doc_id")
    rows = rows.withColumn("x", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = rows.select("sig", "doc_id", "component", "n", "bits", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    dealt = dealt.select("sig", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "doc_id", "component", "n", "bits")

    def few(group: list) -> Iterator[tuple[int, int]]:
        """As ``many`` for short lists, of which there are very many: maps as whole numbers."""
        rows = [(r.n, len(r.bits), r.doc_id, r.component, r.x, int.from_bytes(r.bits, "big")) for r in group]
        two = group[0].i != group[0].j
        for k, (n, w, a, kind, side, p) in enumerate(rows):
            for m, v, b, other, at, q in rows[k + 1 :]:
                if kind == other or (two and side == at) or 100 * min(n, m) < percent * max(n, m):
                    continue
                one = p
                while w > v:  # the larger map folds to the smaller
                    w //= 2
                    one = (one >> 8 * w) ^ (one & ((1 << 8 * w) - 1))
                while v > w:
                    v //= 2
                    q = (q >> 8 * v) ^ (q & ((1 << 8 * v) - 1))
                both = (n + m - (one ^ q).bit_count()) // 2
                w = len(group[k].bits)
                if 100 * both >= percent * (n + m - both):
                    yield (a, b) if a < b else (b, a)

    def many(group: list) -> Iterator[tuple[int, int]]:
        group.sort(key=lambda r: r.n)
        n = np.array([r.n for r in group])
        ids, kind = np.array([r.doc_id for r in group]), np.array([r.component for r in group])
        side, two = np.array([r.x for r in group]), group[0].i != group[0].j
        ends = np.searchsorted(n, 100 * n // percent, "right")
        width = np.array([len(r.bits) for r in group])  # rises with n
        for w in np.unique(width):
            first = int(np.searchsorted(width, w))
            maps_ = np.stack([_folded(r.bits, w) for r in group[first : int(ends[width == w].max())]])
            for k in np.flatnonzero(width == w):
                own = np.arange(k + 1, ends[k])
                own = own[(kind[own] != kind[k]) & ((side[own] != side[k]) | (not two))]
                if len(own):
                    apart = np.bitwise_count(maps_[own - first] ^ maps_[k - first]).sum(1, dtype=np.int64)
                    both = (n[own] + n[k] - apart) // 2
                    for b in own[100 * both >= percent * (n[own] + n[k] - both)]:
                        yield (int(min(ids[k], ids[b])), int(max(ids[k], ids[b])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        seen: set[tuple[int, int]] = set()

        def decided() -> pd.DataFrame:
            new = set((few if len(held) <= 64 else many)(held)) - seen
            if len(seen) > 200_000:
                seen.clear()
            seen.update(new)
            return list(new)

        def table(pairs: list) -> pd.DataFrame:
            return pd.DataFrame(sorted(pairs), columns=["a", "b"])

        for batch in batches:
            out: list = []
            for r in batch.itertuples(index=False):
                if held and (r.sig != held[0].sig or r.i != held[0].i or r.j != held[0].j):
                    if len(held) > 1:
                        out += decided()
                    held = []
                held.append(r)
            yield table(out)
        if held:
            yield table(decided())

    own = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return own.mapInPandas(run, "a bigint, b bigint").distinct()


def linked_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    frequent = frequencies(docs)
    every = written(set_table(docs, boundary(costs(docs, frequent, percent), percent), frequent, percent), "shingle-sets")
    sizes = written(every.select("doc_id", "n_shingles", "key"), "sizes")
    filled = sizes.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # One text for each id, and one id for each set.
    own = written(filled.groupBy("doc_id").agg(F.min("key").alias("key")), "own")
    nodes = written(own.groupBy("key").agg(F.min("doc_id").alias("node")), "nodes")
    repeated = own if filled.count() > own.count() else None
    node_keys = nodes.select(F.col("node").alias("doc_id"), "key")
    reps = every.join(F.broadcast(node_keys) if nodes.count() <= SENT_IDS else node_keys, ["doc_id", "key"], "left_semi")
    if repeated is not None:
        reps = reps.dropDuplicates(["doc_id"])
    maps = written(reps.select("doc_id", F.col("n_shingles").alias("n"), "bits"), "maps")
    sigs = reps.select("doc_id", F.col("n_shingles").alias("n"), F.size("sig").alias("n_sig"), F.explode("sig").alias("sig"))
    # Written, so that the join below reads plain shuffles on both sides and a frequent signature can be split.
    shared = written(sigs.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig"), "shared")
    lists = written(sigs.join(shared, "sig").select("sig", "doc_id", "n", "n_sig"), "lists")
    discard(every)
    # The centre of a list is the member with most links so far, then the one most of whose signatures are shared.
    common = lists.groupBy("doc_id").agg((F.count("*") / F.first("n_sig")).alias("share"))
    members = written(lists.join(common, "doc_id").select("sig", "doc_id", "n", "share", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("links")), "members")
    tried, links, found = None, None, None
    for k in range(ROUNDS):
        centres = members.groupBy("sig").agg(F.max(F.struct("links", "share", (-F.col("doc_id")).alias("minus"), "n", "component")).alias("c"))
        centres = written(centres.select("sig", (-F.col("c.minus")).alias("centre"), F.col("c.n").alias("m"), F.col("c.component").alias("other")), "centres")
        pairs = members.join(centres, "sig").where((F.col("component") != F.col("other")) & _close("n", "m", percent))
        pairs = pairs.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        more = verified(pairs, maps, docs, repeated, percent)
        links = more if links is None else links.union(more)
        found = written(components(links), "classes")
        degree = links.select(F.col("a").alias("doc_id")).union(links.select("b")).groupBy("doc_id").agg(F.count("*").alias("links"))
        members = _mixed(members.drop("component", "links").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").join(degree, "doc_id", "left").select("sig", "doc_id", "n", "share", F.coalesce("component", "doc_id").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    left = written(across(members, maps, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    if left.limit(1).count():
        found = written(components(links.union(verified(left, maps, docs, repeated, percent))), "classes")
    of_node = nodes.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    of_doc = own.join(of_node, "key").select("doc_id", "component_id")
    kept = sizes.select("doc_id", "n_shingles", (F.col("n_shingles") == 0).alias("empty"))
    return kept.join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s:s + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM low WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
edge AS MATERIALIZED (SELECT a, b FROM inter JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, least(d.doc_id, m.lo) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a, min(b) AS lo FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
