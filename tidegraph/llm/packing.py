"""Best-fit packing planned on a histogram of lengths.

Documents become token pieces of at most ``capacity``. The plan is made from counts alone: best-fit decreasing over
(length, count), where bins of equal free room are one group, so that its cost depends on the capacity and not on the
number of documents. It says for every length which ranks take which sequences at which offset. Documents then take
the planned slots by a join on length and rank within length: ranks are local to a reading task plus the count of that
length in earlier tasks, so no length, however common, meets in one task.

Null text is an empty text: one piece, the end id alone. Repeated rows are packed each. Extra columns are ignored. An
empty table gives no rows. The pieces are written to the shared folder once, so ranks stay what they are if an
executor is lost.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegraph.llm.common import documents, written

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 300_000
CACHE_PARTS = 800_000
#: Letters between ASCII marks; apostrophes (contractions) and < (special tokens) are left out.
_MARKED = re.compile(r"([!-&(-/:;=-@\[-`{-~]*)([^\x00-\x40\[-`{-\x7f]+)([!-&(-/:;=-@\[-`{-~]*)")
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local_rank bigint"


class WordCodes(dict):
    """Token ids, as little-endian unsigned 32-bit numbers, of blank-separated words; kept while a worker lives.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in turn. Nor does it
    join letters with the ASCII marks around them, so a word of letters between such marks is looked up in three parts,
    and letters go, in lower case and as the tokenizer's byte letters, straight to its merges. Other words and marks go
    through the whole tokenizer. Both tables are emptied when full.
    """

    _kept: dict[str, WordCodes] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        # A byte that prints in Latin-1 is its own letter; the others follow from 256 on.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in prints)}

    @classmethod
    def of(cls, path: str) -> WordCodes:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > CACHE_WORDS:
            self.clear()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))

    def __missing__(self, word: str) -> bytes:
        m = _MARKED.fullmatch(word)
        if m and (core := m[2]).isalpha():
            low = core.lower()
            # Letters that keep their number in lower case; \u03a3 has two lower cases, of which only one is meant here.
            if len(low) == len(core) and (low.isascii() or is_normalized("NFC", core) and is_normalized("NFC", low) and "\u03a3" not in core):
                self[word] = found = self._part(m[1]) + self._core(low) + self._part(m[3])
                return found
        self[word] = found = self._whole(word)
        return found

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, marks: str) -> bytes:
        if not marks:
            return b""
        found = self.parts.get(marks)
        if found is None:
            self.parts[marks] = found = self._whole(marks)
        return found

    def _core(self, low: str) -> bytes:
        found = self.parts.get(low)
        if found is None:
            if len(self.parts) > CACHE_PARTS:
                self.parts.clear()
            shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(shown)]
            self.parts[low] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with length and checksum, the task that made each and its rank within its length there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, part, seen = WordCodes.of(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = codes.encode(text) + end
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rank = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, rank))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, _PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, first sequence, offset), by length and rank.

    A row holds until the next first rank of its length; ranks and sequences in it run in step.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # free room: [(first sequence, how many)]
    rooms: list[int] = []
    slots, sequences = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_bins:
                insort(rooms, room)
            open_bins.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                fits = capacity // length  # new sequences, filled as far as this length goes
                n = max(1, left // fits)
                first, room = sequences, capacity
                sequences += n
                for _ in range(min(fits, left)):
                    take = min(n, left)
                    slots.append((length, rank, first, capacity - room))
                    rank, left, room = rank + take, left - take, room - length
                add(room, first, n)
                continue
            room = rooms[k]
            first, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[k]
            take = min(n, left)
            slots.append((length, rank, first, capacity - room))
            rank, left = rank + take, left - take
            add(room - length, first, take)
            add(room, first + take, n - take)
    return sorted(slots)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, end_id), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    sent = spark.sparkContext.broadcast(np.array(plan(histogram, capacity), np.int64).reshape(-1, 4))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = sent.value
        widest = int(slots[:, 1].max(initial=0)) + 1
        for batch in batches:
            rank = (batch["base"] + batch["local_rank"]).to_numpy()
            length = batch["length"].to_numpy()
            # Last slot whose (length, first rank) is not above the piece's: the two as one number if they fit.
            if (int(slots[-1, 0]) + 1) * widest < 1 << 62:
                at = np.searchsorted(slots[:, 0] * widest + slots[:, 1], length * widest + np.minimum(rank, widest - 1), "right") - 1
            else:
                first = np.searchsorted(slots[:, 0], length)
                at = np.array([f + np.searchsorted(slots[f : np.searchsorted(slots[:, 0], n, "right"), 1], r, "right") - 1 for f, n, r in zip(first, length, rank, strict=True)])
            batch = batch.drop(columns=["base", "local_rank", "part"])
            batch["sequence_id"] = slots[at, 2] + rank - slots[at, 1]
            batch["offset"] = slots[at, 3]
            yield batch

    schema = T.StructType([*(f for f in pieces.schema if f.name not in ("part", "local_rank")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.join(bases, ["length", "part"]).select(*pieces.columns, "base").mapInPandas(take, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
