"""Exact long repeats with run-length indexes over content-routed text.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or earlier in the same
document). Strings that are equal have the same least k-gram, their anchor, at the same place, so neighbouring strings
with one anchor form a segment, and only segments of one anchor can hold equal strings. Anchors seen once are done;
the rest is decided in these steps:

* documents that are whole copies, and segments that are whole copies, are collapsed onto their first occurrence before
  anything is shuffled further; the other occurrences go;
* an anchor with more than ``MOST_SEGMENTS`` different segments (a frequent phrase) is split by content: its strings are
  dealt into cells by the place of the anchor in them, and the strings of a cell share the bytes around the anchor that
  all of them hold, which are its new key. Equal strings meet again, and the parts are segments like any others, so whole
  copies are collapsed, and a part that is still large is split into narrower cells. In a cell of one place all strings
  are equal, so the last split leaves nothing large;
* the different segments of an anchor meet in one task, in batches of ``BATCH_BYTES`` cut between anchors. They are cut
  into cells once more, and what shares its cell with nothing else is done. Of the rest, a run-compressed
  Burrows-Wheeler transform with positions sampled at run ends is built of earlier segments, and later ones are streamed
  over it: backward steps keep a row and a place, a mismatch jumps to the nearer run end of the wanted byte, and the
  places give matching statistics. Matches of ``LENGTH`` bytes are marked. Order is settled by halving: on level l,
  segments whose rank in their cell has bit l clear are indexed, those with the bit set are streamed, and the anchor byte
  carries the higher bits, so that only earlier ones match.

Null text is empty. A null doc_id takes no part: nothing goes. Of rows that repeat an id with other text, the one whose
text hash is least is judged and nothing goes from the others; equal rows give equal results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import discard, documents, mix, without_ids, written

LENGTH = 100
GRAM = 24
MOST_SEGMENTS = 1024
#: Places of an anchor that one cell takes in, from split to split.
SPLITS = (20, 5, 1)
#: Parts of the anchors that are shuffled one after the other.
PARTS = 3
CELL = 10
BATCH_BYTES = 1 << 20
_CHUNK = 1 << 20  # strings of one text that are looked at together
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first string start, number of strings and anchor place of each segment."""
    parts = []
    for base in range(0, max(0, len(data) - LENGTH + 1), _CHUNK - LENGTH):
        x = np.frombuffer(data, np.uint8, min(len(data) - base, _CHUNK), base).astype(np.uint64)
        if len(x) < LENGTH:
            break
        x = x[:-1] | (x[1:] << np.uint64(8))
        x = x[:-2] | (x[2:] << np.uint64(16))
        x = x[:-4] | (x[4:] << np.uint64(32))
        m = len(x) - 16
        h = mix(x[:m] * _P[0] + x[8 : 8 + m] * _P[1] + x[16:] * _P[2])
        low = np.uint64(_CHUNK - 1)
        y, w, span = (h & ~low) | np.arange(m, dtype=np.uint64), 1, LENGTH - GRAM + 1
        while 2 * w <= span:
            y, w = np.minimum(y[:-w], y[w:]), 2 * w
        if span > w:
            y = np.minimum(y[: w - span], y[span - w :])
        at = (y & low).astype(np.int64)
        last = base + _CHUNK < len(data)
        at = at[: _CHUNK - LENGTH] if last else at
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.concatenate([first, [len(at)]]))
        parts.append((h[at[first]], first + base, n, at[first] + base))
        if not last:
            break
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class RunLengthIndex:
    """Run-compressed BWT of a text of small integers, with text positions sampled at both ends of every run."""

    def __init__(self, text: np.ndarray):
        """``text`` must end with a symbol smaller than all others in it."""
        self.text, n = text, len(text)
        sa = self._suffixes(text)
        bwt = text[sa - 1]
        start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        end = np.concatenate([start[1:], [n]])
        self.start, self.head = start, bwt[start]
        self.at_start, self.at_end = sa[start], sa[end - 1]
        by_head = np.lexsort((np.arange(len(start)), self.head))
        size = (end - start)[by_head]
        self.first = np.empty(len(start), np.int64)  # row that the first row of a run steps to
        self.first[by_head] = np.cumsum(size) - size
        self.by_head, self.heads = by_head, self.head[by_head]
        self.keys = self.heads.astype(np.int64) * (len(start) + 1) + by_head

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling on ranks.

        Suffixes are compared up to the next separator (symbols 0 and 1) and then by its place, so that no round looks
        further than a segment is long; steps over a separator are never taken. A rank that is unique is not sorted again.
        """
        n, at = len(text), np.arange(len(text))
        known = np.bincount(text) > 0
        code = np.cumsum(known)[text]
        bits = int(known.sum()).bit_length()
        stops = np.flatnonzero(text <= 1)
        stop = np.searchsorted(stops, at)
        left = stops[stop] - at
        h = 63 // bits
        key, padded = code, np.concatenate([code, np.zeros(h, code.dtype)])
        for j in range(1, h):
            key = (key << bits) | np.where(j <= left, padded[j : j + n], 0)
        order = np.argsort(key)
        key, rank = key[order], np.empty(n, np.int64)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        live = order[~(new & np.append(new[1:], True))]
        while len(live):
            ahead = np.where(left[live] < h, stop[live], rank[np.minimum(live + h, n - 1)])
            key = rank[live] * (n + 1) + ahead
            order = np.argsort(key)
            live, key = live[order], key[order]
            old, i = key // (n + 1), at[: len(live)]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            same = np.concatenate([[True], old[1:] != old[:-1]])
            rank[live] = old + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(same, i, 0))
            live = live[~(new & np.append(new[1:], True))]
            h *= 2
        out = np.empty(n, np.int64)
        out[rank] = at
        return out

    def _common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Longest common extension of text places, up to ``most``."""
        out, live, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(live) and k < most:
            step = 8 if k < 16 else 32
            i = k + np.arange(step)
            x = self.text[np.minimum(a[live, None] + i, len(self.text) - 1)]
            y = self.text[np.minimum(b[live, None] + i, len(self.text) - 1)]
            same = np.cumprod(x == y, axis=1).sum(1)
            out[live] += same
            live = live[same == step]
            k += step
        return np.minimum(out, most)

    def stream(self, queries: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
        """Places of longest matches of every suffix of each query; -1 where its first symbol does not occur.

        ``queries`` is a matrix of rows padded on the left, ``size`` their lengths.
        """
        n, width = queries.shape
        row = np.full(n, len(self.text) - 1, np.int64)
        place = np.full(n, self.at_end[-1], np.int64)
        out = np.full((n, width), -1, np.int64)
        total, runs = len(self.keys), len(self.start) + 1
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero(width - j <= size)
            c, q, p = queries[live, j].astype(np.int64), row[live], place[live]
            run = np.searchsorted(self.start, q, "right") - 1
            stay = self.head[run] == c
            off = np.flatnonzero(~stay)
            if len(off):
                k = np.searchsorted(self.keys, c[off] * runs + run[off])
                up, down = np.maximum(k - 1, 0), np.minimum(k, total - 1)
                has_up, has_down = (k > 0) & (self.heads[up] == c[off]), (k < total) & (self.heads[down] == c[off])
                above, below = self.by_head[up], self.by_head[down]
                pick = has_up.copy()
                both = np.flatnonzero(has_up & has_down)
                if len(both):
                    now = p[off[both]]
                    pick[both] = self._common(self.at_end[above[both]], now, most) >= self._common(self.at_start[below[both]], now, most)
                run[off] = np.where(pick, above, below)
                q[off] = np.where(pick, np.append(self.start[1:], len(self.text))[above] - 1, self.start[below])
                p[off] = np.where(pick, self.at_end[above], self.at_start[below])
            q = self.first[run] + q - self.start[run]
            p = np.where(p > 0, p - 1, len(self.text) - 1)
            if len(off):
                gone = off[~(has_up | has_down)]
                q[gone], p[gone] = len(self.text) - 1, self.at_end[-1]
                out[live, j] = p
                out[live[gone], j] = -1
            else:
                out[live, j] = p
            row[live], place[live] = q, p
        return out


def matched(index: RunLengthIndex, contents: list[np.ndarray], n: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each content, which of its first ``n`` strings of ``length`` occur in the index."""
    size = np.array([len(c) for c in contents])
    width = int(size.max())
    matrix = np.zeros((len(contents), width), contents[0].dtype)
    for i, c in enumerate(contents):
        matrix[i, width - len(c) :] = c
    places = index.stream(matrix, size, length)
    who = np.repeat(np.arange(len(contents)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (width - size)[who]
    place = places[who, at]
    # Neighbouring strings on one diagonal are compared together: a string matches if none of its symbols differs.
    diagonal = np.where(place < 0, -1 - len(index.text), place - at)
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (diagonal[1:] != diagonal[:-1])]))
    count = np.diff(np.concatenate([first, [len(who)]]))
    span = count + length - 1
    begin = np.cumsum(span) - span
    off = np.arange(span.sum()) - np.repeat(begin, span)
    x = matrix[np.repeat(who[first], span), np.repeat(at[first], span) + off]
    y = np.repeat(place[first], span) + off
    inside = (y >= 0) & (y < len(index.text)) & np.repeat(place[first] >= 0, span)
    wrong = np.concatenate([[0], np.cumsum(~(inside & (x == index.text[np.clip(y, 0, len(index.text) - 1)])))])
    here = np.repeat(begin, count) + np.arange(len(who)) - np.repeat(first, count)
    ok = wrong[here + length] == wrong[here]
    return np.split(ok, np.cumsum(n)[:-1])


def repeated_strings(batch: list[tuple[object, bytes, int, int]]) -> list[np.ndarray]:
    """For different segments (group, content, strings, anchor place in content), in order of group and occurrence:
    which strings occur in an earlier segment of the group.

    The highest level goes first. What it marks is dropped from later levels, from streams and indexes alike: whatever
    would still meet it there has met the same earlier segments.
    """
    rank: list[int] = []
    most: dict[object, int] = {}
    for i, (a, *_) in enumerate(batch):
        rank.append(rank[-1] + 1 if i and a == batch[i - 1][0] else 0)
        most[a] = rank[-1]
    marks = [np.zeros(n, bool) for _, _, n, _ in batch]
    live = [(0, n) for _, _, n, _ in batch]
    for level in range(max(most.values(), default=0).bit_length() - 1, -1, -1):
        indexed, streamed = [], []
        for i, (a, *_) in enumerate(batch):
            if live[i][1] and most[a] >> level:
                (streamed if rank[i] >> level & 1 else indexed).append(i)
        if not streamed or not indexed:
            continue

        def coded(i: int, level: int = level) -> np.ndarray:
            lo, hi = live[i]
            x = np.frombuffer(batch[i][1], np.uint8)[lo : hi + LENGTH - 1].astype(np.int32) + 2
            x[batch[i][3] - lo] += 256 * (rank[i] >> (level + 1))
            return x

        gap = np.ones(1, np.int32)  # between segments; 0 is the end alone
        text = np.concatenate([x for i in indexed for x in (coded(i), gap)])
        text[-1] = 0
        index = RunLengthIndex(text)
        for k in range(0, len(streamed), 20_000):
            own = streamed[k : k + 20_000]
            found = matched(index, [coded(i) for i in own], np.array([live[i][1] - live[i][0] for i in own]))
            for i, ok in zip(own, found, strict=True):
                if ok.any():
                    marks[i][live[i][0] : live[i][1]] |= ok
                    left = np.flatnonzero(~marks[i])
                    live[i] = (int(left[0]), int(left[-1]) + 1) if len(left) else (0, 0)
    return marks


def cells(content: bytes, n: int, place: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """A segment's strings by ``width`` places of the anchor in them: cell, first string, end, and the bytes that all
    strings of the cell hold around the anchor. Equal strings are in cells of equal number and bytes."""
    last = LENGTH - GRAM
    for j in range((place - n + 1) // width, place // width + 1):
        near, far = j * width, min(last, j * width + width - 1)
        yield j, place - min(place, far), place - max(place - n + 1, near) + 1, content[place - near : place + LENGTH - far]


def decide(rows: list) -> list[np.ndarray]:
    """For different segments (a, content, n, place), in order of anchor and occurrence: which strings an earlier segment
    of the anchor holds."""
    marks = [np.zeros(r.n, bool) for r in rows]
    groups: dict[tuple, list[tuple[int, int, int]]] = {}
    for k, r in enumerate(rows):
        for j, lo, hi, shared in cells(r.content, r.n, r.place, CELL):
            groups.setdefault((r.a, j, shared), []).append((k, lo, hi))
    batch, at = [], []
    for key, members in groups.items():
        if len(members) < 2:
            continue
        own: dict[bytes, tuple[int, int, int]] = {}
        for k, lo, hi in members:
            content = rows[k].content[lo : hi + LENGTH - 1]
            if content in own:
                marks[k][lo:hi] = True
            else:
                own[content] = (k, lo, hi)
        if len(own) > 1:
            batch += [(key, content, hi - lo, rows[k].place - lo) for content, (k, lo, hi) in own.items()]
            at += own.values()
    for (k, lo, hi), found in zip(at, repeated_strings(batch), strict=True):
        marks[k][lo:hi] |= found
    return marks


def spans_of(marks: np.ndarray, start: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte spans that the marked strings from ``start`` on cover."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    lo, hi = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [(start + int(x), start + int(y) + length) for x, y in zip(lo, hi, strict=True)]


def _data(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def segment_table(docs: DataFrame) -> DataFrame:
    """(a, g, doc_id, pack): anchor, content hash, document, first string and number of strings of each segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            anchors, hashes, ids, packs = [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = _data(text)
                a, s, n, p = segments(data)
                anchors.append(a.astype(np.int64))
                hashes.append(np.array([digest(data[x:y]) for x, y in zip(s.tolist(), (s + n + LENGTH - 1).tolist(), strict=True)], np.uint64).astype(np.int64))
                ids.append(np.full(len(a), doc_id, np.int64))
                packs.append((s << 14) | (n << 7) | (p - s))
            none = np.zeros(0, np.int64)
            yield pd.DataFrame({k: np.concatenate([none, *v]) for k, v in (("a", anchors), ("g", hashes), ("doc_id", ids), ("pack", packs))})

    return docs.select("doc_id", "text").mapInPandas(run, "a long, g long, doc_id bigint, pack long")


def _cut(wanted: DataFrame, docs: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows that ``rows_of`` makes of each wanted segment (a, s, n, place) and its bytes."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list("a").alias("a"), F.collect_list("pack").alias("pack"))
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, anchors, packs in zip(batch["doc_id"], batch["text"], batch["a"], batch["pack"], strict=True):
                data = _data(text)
                for a, pack in zip(anchors.tolist(), packs.tolist(), strict=True):
                    s, n = pack >> 14, pack >> 7 & 127
                    rows += rows_of(a, doc_id, s, n, pack & 127, data[s : s + n + LENGTH - 1])
            yield pd.DataFrame(rows, columns=names)

    return docs.join(lists, "doc_id").select("doc_id", "text", "a", "pack").mapInPandas(run, schema)


def contents(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The wanted segments with their bytes."""
    return _cut(wanted, docs, "a long, doc_id bigint, s long, n int, place int, content binary", lambda *row: [row])


def split_segments(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The wanted segments cut into cells of ``width``, as a segment table of its own."""

    def rows_of(a: int, doc_id: int, s: int, n: int, place: int, content: bytes) -> list[tuple]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        out = []
        for j, lo, hi, shared in cells(content, n, place, width):
            key, own = xxhash.xxh64_intdigest(shared, j), xxhash.xxh64_intdigest(content[lo : hi + LENGTH - 1])
            out.append((signed(key), signed(own), doc_id, (s + lo) << 14 | (hi - lo) << 7 | (place - lo)))
        return out

    return _cut(wanted, docs, "a long, g long, doc_id bigint, pack long", rows_of)


def index_spans(parts: DataFrame) -> DataFrame:
    """What run-length indexes find, over partitions dealt by anchor and sorted by occurrence: the spans that go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def decided(rows: list) -> pd.DataFrame:
            found = [(r.doc_id, lo, hi) for r, m in zip(rows, decide(rows), strict=True) for lo, hi in spans_of(m, r.s)]
            return pd.DataFrame(found, columns=["doc_id", "lo", "hi"])

        for batch in batches:
            for r in batch.itertuples(index=False):
                if size >= BATCH_BYTES and r.a != held[-1].a:
                    yield decided(held)
                    held, size = [], 0
                held.append(r)
                size += len(r.content)
        if held:
            yield decided(held)

    return parts.repartition("a").sortWithinPartitions("a", "doc_id", "s").mapInPandas(run, "doc_id bigint, lo long, hi long")


def recurring(every: DataFrame, parts: int) -> list[DataFrame]:
    """The segments whose anchor occurs more than once, as a written table for each part of the anchors. Parts are shuffled
    one after the other, so that the disk holds the shuffle of one of them beside the segments."""
    out = []
    for k in range(parts):
        own = every.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == k) if parts > 1 else every
        # Written, so that the join below reads plain shuffles on both sides and a frequent anchor can be split.
        twice = written(own.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "twice")
        out.append(written(own.join(twice, "a", "left_semi"), "segments"))
        discard(twice)
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): byte spans that go, of documents (doc_id, text) whose ids and texts are distinct."""
    every, spans, parts = written(segment_table(docs), "segments"), None, PARTS
    s, n = F.shiftright("pack", 14), F.shiftright("pack", 7).bitwiseAND(F.lit(127))
    for width in (*SPLITS, None):
        tables = recurring(every, parts)
        rows, parts = reduce(DataFrame.union, tables), 1  # what is split is the smaller part
        discard(every)
        first = rows.groupBy("a", "g").agg(F.min(F.struct("doc_id", "pack")).alias("f"))
        first = written(first.select("a", "g", "f.*"), "contents")
        copies = rows.join(first.select("a", "g", F.struct("doc_id", "pack").alias("f")), ["a", "g"]).where(F.col("f") != F.struct("doc_id", "pack"))
        copied = written(copies.select("doc_id", s.alias("lo"), (s + n + (LENGTH - 1)).alias("hi")), "copied")
        for table in tables:
            discard(table)
        sizes = written(first.groupBy("a").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
        wanted = first.join(sizes.where(F.col("c") <= MOST_SEGMENTS), "a").select("a", "doc_id", "pack")
        found = copied.union(written(index_spans(contents(wanted, docs)), "found"))
        spans = found if spans is None else spans.union(found)
        large = sizes.where(F.col("c") > MOST_SEGMENTS)
        if width is None or not large.limit(1).count():
            discard(first)
            return spans
        every = written(split_segments(first.join(large, "a").select("a", "doc_id", "pack"), docs, width), "segments")
        discard(first)


_RESULT = "doc_id bigint, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>"


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with what goes and the hash of what is left."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("h"), "text")
    named = keyed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("h").alias("h"), F.count("*").alias("rows"))
    named = written(named.select("doc_id", "h", "rows", F.lit(True).alias("named")), "named")
    firsts = written(named.groupBy("h").agg(F.min("doc_id").alias("doc_id")), "firsts")
    if named.where("rows > 1").limit(1).count():
        key = ["doc_id", "h"]
        own = keyed.join(firsts, key, "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
    else:  # an id is a row, and its text need not be hashed again
        key, keyed = ["doc_id"], docs
        copies = written(named.select("doc_id").join(firsts.select("doc_id"), "doc_id", "left_anti"), "copies")
        own = without_ids(docs.where(F.col("doc_id").isNotNull()), copies)
    spans = written(repeats(own), "spans").groupBy("doc_id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    judged = named.join(firsts.select("doc_id", "h", F.lit(True).alias("first")), ["doc_id", "h"], "left").join(spans, "doc_id", "left")
    rows = keyed.join(judged.select(*key, "named", "first", "lo", "hi"), key, "left")

    names = ["doc_id", "text", "named", "first", "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, named, first, los, his in zip(*(batch[x] for x in names), strict=True):
                data, gone = _data(text), []
                if first is True:
                    for lo, hi in sorted(zip(los.tolist(), his.tolist(), strict=True)) if los is not None else ():
                        if gone and lo <= gone[-1]["hi"]:
                            gone[-1]["hi"] = max(gone[-1]["hi"], hi)
                        else:
                            gone.append({"lo": lo, "hi": hi})
                elif named is True and len(data) >= LENGTH:
                    gone = [{"lo": 0, "hi": len(data)}]
                kept, at = hashlib.sha256(), 0
                for r in gone:
                    kept.update(data[at : r["lo"]])
                    at = r["hi"]
                kept.update(data[at:])
                out.append((None if pd.isna(doc_id) else int(doc_id), len(data), sum(r["hi"] - r["lo"] for r in gone), len(gone), kept.hexdigest(), gone))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows.select(*names).mapInPandas(run, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("spans")
