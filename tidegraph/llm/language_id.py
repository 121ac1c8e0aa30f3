"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of its training texts. A text is
encoded once per language, and the language that makes it smallest wins; ``score`` is the relative margin to the
second best (0 to 1), and ``rejected`` marks margins under ``MIN_MARGIN``. Texts are encoded whole, in blocks, so that
the dictionary and not the text's own past decides.

Sample bound: for each language the ``SAMPLE_DOCS`` training documents that come first by a hash of doc_id, each cut to
``PIECES`` pieces spread evenly over its whole text where it is longer than its share of the dictionary. A dictionary has
at most ``DICT_BYTES`` bytes, and all together at most ``ALL_BYTES``: with very many languages each gets less. Only beyond
``MAX_LANGS`` lang values do the rarest have no dictionary. Prediction sees the text only.

Null text, or text without a letter: ``und`` with score 0. Without any training rows every text is ``und``. Rows with
a null lang train nothing; null doc_ids are never held out. Ties go to the language with more training rows, then to
the first by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import documents, held_out

SAMPLE_DOCS = 96
DICT_BYTES = 32 << 10
ALL_BYTES = 8 << 20
MAX_LANGS = 4096
PIECES = 4
BLOCK = 2048
MIN_MARGIN = 0.02
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased letters, with one space for anything between."""
    return _OTHER.sub(" ", text.lower()).strip()


def spread(text: str, size: int) -> str:
    """The letters of a text, or ``PIECES`` pieces evenly spread over them if they are more than ``size``."""
    data = letters(text)
    if len(data) <= size:
        return data
    each = size // PIECES
    return " ".join(data[i : i + each] for i in np.linspace(0, len(data) - each, PIECES).astype(int))


def dict_bytes(langs: int) -> int:
    return max(SAMPLE_DOCS, min(DICT_BYTES, ALL_BYTES // max(1, langs)))


def sample_texts(train: DataFrame, n: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Letters of at most ``n`` training texts per language, commonest language first, picked by a hash of doc_id.

    Ranks are taken over narrow columns; Spark keeps only the first ``n`` of a language in every task before it shuffles.
    """
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = train.groupBy("lang").count()
    langs = [r[0] for r in counts.orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()]
    if not langs:
        return {}
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.col("h"))
    hashed = train.select("doc_id", "lang", F.xxhash64("text").alias("h"))
    picks = hashed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    share = 2 * dict_bytes(len(langs)) // n

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["lang", "rank"]].assign(part=[spread(t, share) for t in batch["text"]])

    # Rows without doc_id train like others: NULL meets NULL.
    picked = picks.select(F.col("doc_id").alias("p_id"), F.col("lang").alias("p_lang"), F.col("h").alias("p_h"), "rank")
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("lang") == F.col("p_lang")) & (F.col("h") == F.col("p_h"))
    own = train.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), same)
    rows = own.select("lang", "rank", "text").mapInPandas(cut, "lang string, rank int, part string").dropDuplicates(["lang", "rank"]).collect()
    found: dict[str, list[str]] = {lang: [] for lang in langs}
    for r in sorted(rows, key=lambda r: r["rank"]):
        if r["lang"] in found:
            found[r["lang"]].append(r["part"])
    return found


def dictionary(parts: list[str], size: int = DICT_BYTES) -> bytes:
    """Sampled letters end to end; zstandard finds matches nearest the end first, and all within ``size`` bytes."""
    return b" ".join(dict.fromkeys(p.encode() for p in parts if p))[:size]


class Codes:
    """One compressor per language; kept for a worker's life under its dictionaries."""

    _kept: dict[int, Codes] = {}

    def __init__(self, dicts: dict[str, bytes]):
        self.langs = list(dicts)
        self.codes = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
            data.precompute_compress(compression_params=params)
            self.codes.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        data = letters(text).encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.codes]

    def best(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.codes or not any(map(str.isalpha, text)):
            return "und", 0.0
        sizes = self.sizes(text)
        k = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != k), default=0)
        return self.langs[k], (second - sizes[k]) / second if second else 1.0

    @classmethod
    def of(cls, dicts: dict[str, bytes]) -> Codes:
        key = hash(tuple(dicts.items()))
        if key not in cls._kept:
            cls._kept = {key: cls(dicts)}
        return cls._kept[key]


def train_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    found = sample_texts(docs)
    return {lang: d for lang, parts in found.items() if (d := dictionary(parts, dict_bytes(len(found))))}


def predict(docs: DataFrame, dicts: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score and rejected in the place of columns of those names."""

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes = Codes.of(dicts)
        for texts in batches:
            rows = [codes.best(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "rejected": [r[1] < min_margin for r in rows]})

    judge = F.pandas_udf(judged, "lang_pred string, score double, rejected boolean")
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*keep, judge(F.col("text")).alias("_judged")).select(*keep, "_judged.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 4))
    dicts = train_dictionaries(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), dicts).drop("text")
