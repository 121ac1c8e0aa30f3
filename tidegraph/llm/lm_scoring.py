"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

Counts of every training word come from one grouped aggregate over the whole training part. The neural vocabulary is
the ``VOCAB`` commonest words with an end id and one id for all other words; an other word's probability is that id's
times its smoothed share of the other words' counts, with one share for words never seen, so token probabilities sum to
one. The context is two tokens: predicted vector = c1 * R[w-1] + c2 * R[w-2], score = predicted . Q[w] + b[w]. Training
documents are dealt by a hash of their ids and texts into shards of about ``SHARD_TOKENS`` tokens. In each of ``PASSES``
passes every shard is trained on whole, in a fixed order, from the same start; parameters are averaged by tokens, in
Spark. So neither files nor partitions change the model. Scores of
all context pairs then come from matrix products: with E1 = exp(c1*R Q' + b) and E2 = exp(c2*R Q'), the normaliser of a
pair is (E1 E2')[w-1, w-2], so each token log-probability is exact and takes a few look-ups.

What is sent to tasks is bounded: the ``HEAVY`` commonest words with counts, and the model. Other words are counted by a
join on the word.

Null text is an empty text: its end token alone. Repeated rows are scored each. A null doc_id is never held out. Without
training rows every count is 0 and the model is uniform over nothing but unseen words and the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import documents, held_out, low_words, written

VOCAB = 1022
HEAVY = 200_000
DIM = 24
NOISE = 48
BATCH = 8192
RATE = 0.05
PASSES = 2
SHARD_TOKENS = 5_000_000
OTHER, END = 0, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all training texts."""
    words = F.explode(F.split(F.translate("text", UPPER, LOWER), r"[\x20\x09-\x0D]+"))
    return train.select(words.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("c"))


@dataclass
class Lexicon:
    """Counts of the commonest words by rank, and totals of the training tokens."""

    words: list[str]
    counts: np.ndarray
    n_docs: int
    tokens: int
    types: int

    @property
    def vocab_size(self) -> int:
        return 2 + min(VOCAB, len(self.words))

    @property
    def other(self) -> tuple[int, int]:
        """Tokens and types outside the neural vocabulary."""
        near = self.counts[:VOCAB]
        return self.tokens - self.n_docs - int(near.sum()), self.types - bool(self.n_docs) - len(near)

    def unigram(self) -> np.ndarray:
        """Smoothed probabilities of the ids."""
        c = np.concatenate([[self.other[0], self.n_docs], self.counts[:VOCAB]]).astype(float) + 1
        return c / c.sum()


def lexicon(counts: DataFrame, n_docs: int) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The least count that at most HEAVY words reach, from how many words have each count.
    steps = sorted((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect())
    cut, many = 1 << 62, 0
    while steps and many + steps[-1][1] <= HEAVY:
        cut, n = steps.pop()
        many += n
    top = sorted(counts.where(F.col("c") >= cut).collect(), key=lambda r: (-r["c"], r["word"]))
    return Lexicon([r["word"] for r in top], np.array([r["c"] for r in top], np.int64), n_docs, total["n"] + n_docs, total["v"] + bool(n_docs))


_CODED = "row long, doc_id bigint, held_out boolean, n_tokens long, n_known long, log_all double, log_other double, n_other long, ids binary, rare array<string>, rare_n array<int>"


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """One row per document: ids, sums of log10(c + 1) over words sent here, and the words that were not."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, row = sent.value, TaskContext.get().partitionId() << 34
        rank = {w.encode(): i for i, w in enumerate(lex.words)}
        logs = np.log10(lex.counts + 1.0)
        end = float(np.log10(lex.n_docs + 1))
        get = rank.get
        for batch in batches:
            out = []
            for doc_id, held, text in zip(batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                words = low_words(text)
                r = np.array([get(w, -1) for w in words], np.int32)
                known = r[r >= 0]
                rare = Counter([w for w in words if w not in rank]) if len(known) < len(r) else {}
                far = known[known >= VOCAB]
                ids = np.where((r >= 0) & (r < VOCAB), r + 2, OTHER)
                ids = np.append(ids, END).astype("<u2")
                out.append((row, None if pd.isna(doc_id) else int(doc_id), bool(held), len(ids), len(known) + bool(lex.n_docs), float(logs[known].sum()) + end, float(logs[far].sum()), int((ids == OTHER).sum()), ids.tobytes(), [w.decode("utf-8", "surrogatepass") for w in rare], list(rare.values())))
                row += 1
            frame = pd.DataFrame(out, columns=["row", "doc_id", "held_out", "n_tokens", "n_known", "log_all", "log_other", "n_other", "ids", "rare", "rare_n"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select("doc_id", "held_out", "text").mapInPandas(run, _CODED)


@dataclass
class LogBilinear:
    """R, Q (ids x dim), b (ids), c1 and c2 (dim)."""

    R: np.ndarray
    Q: np.ndarray
    b: np.ndarray
    c1: np.ndarray
    c2: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, dim: int = DIM, seed: int = 7) -> LogBilinear:
        rng, v = np.random.default_rng(seed), len(unigram)
        make = lambda: rng.normal(0, 0.1, (v, dim)).astype(np.float32)
        return cls(make(), make(), np.log(unigram).astype(np.float32), np.full(dim, 0.7, np.float32), np.full(dim, 0.4, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.R, self.Q, self.b, self.c1, self.c2)])

    @classmethod
    def of(cls, flat: np.ndarray, v: int, dim: int = DIM) -> LogBilinear:
        a, b, c, d, e = np.split(np.asarray(flat, np.float32), np.cumsum([v * dim, v * dim, v, dim]))
        return cls(a.reshape(v, dim), b.reshape(v, dim), c, d, e)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (previous, token) with the bias, by (one before, token), and log normalisers of context pairs."""
        a1 = ((self.R * self.c1) @ self.Q.T + self.b).astype(np.float64)
        a2 = ((self.R * self.c2) @ self.Q.T).astype(np.float64)
        top1, top2 = a1.max(1, keepdims=True), a2.max(1, keepdims=True)
        z = np.log(np.exp(a1 - top1) @ np.exp(a2 - top2).T) + top1 + top2.T
        return a1.astype(np.float32), a2.astype(np.float32), z.astype(np.float32)


def contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each; documents end with END, which also stands before their start."""
    one = np.concatenate([[END], ids[:-1]])
    two = np.concatenate([[END], one[:-1]])
    two[starts] = END
    return one, two


def _add_rows(to: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
    """to[at] += what, with repeats in ``at``."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[first]] += np.add.reduceat(what[order], first, axis=0)


class Trainer:
    """Adagrad over mini-batches; the noise words of a batch are shared by its tokens."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.cum = np.cumsum(unigram)
        self.shift = (np.log(unigram) + np.log(NOISE)).astype(np.float32)
        self.past = LogBilinear(*(np.full_like(x, 1e-2) for x in (model.R, model.Q, model.b, model.c1, model.c2)))

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.m, len(w)
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(self.cum) - 1)
        r1, r2 = m.R[one], m.R[two]
        h = r1 * m.c1 + r2 * m.c2
        qw, qn = m.Q[w], m.Q[noise]
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        g = sigmoid(np.einsum("ij,ij->i", h, qw) + m.b[w] - self.shift[w]) - 1
        gn = sigmoid(h @ qn.T + (m.b[noise] - self.shift[noise]))
        dh = g[:, None] * qw + gn @ qn
        d = LogBilinear(*(np.zeros_like(x) for x in (m.R, m.Q, m.b, m.c1, m.c2)))
        _add_rows(d.R, one, dh * m.c1)
        _add_rows(d.R, two, dh * m.c2)
        _add_rows(d.Q, w, g[:, None] * h)
        np.add.at(d.Q, noise, gn.T @ h)
        d.b += np.bincount(w, g, len(d.b)).astype(np.float32) + np.bincount(noise, gn.sum(0), len(d.b)).astype(np.float32)
        d.c1[:], d.c2[:] = (dh * r1).sum(0), (dh * r2).sum(0)
        for name in ("R", "Q", "b", "c1", "c2"):
            grad, seen, now = getattr(d, name) / np.float32(n / 64), getattr(self.past, name), getattr(m, name)
            seen += grad * grad
            now -= np.float32(RATE) * grad / np.sqrt(seen)


def joined(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of documents end to end, and where each document starts."""
    size = ids.map(len).to_numpy() // 2
    return np.frombuffer(b"".join(ids), "<u2").astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)


def train(coded: DataFrame, lex: Lexicon, passes: int = PASSES) -> LogBilinear:
    """Each pass, every shard trains on all its tokens, from the average of the pass before."""
    unigram = lex.unigram()
    model = LogBilinear.start(unigram)
    if not lex.n_docs:
        return model
    shards = -(-lex.tokens // SHARD_TOKENS)
    dealt = coded.where(~F.col("held_out")).select("ids", F.xxhash64("doc_id", "ids").alias("h"))
    dealt = dealt.select("ids", "h", F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard")).repartition("shard").sortWithinPartitions("shard", "h", "ids")
    for k in range(passes):
        sent = coded.sparkSession.sparkContext.broadcast((model.flat(), unigram))

        def run(batches: Iterator[pd.DataFrame], k=k, sent=sent) -> Iterator[pd.DataFrame]:
            flat, unigram = sent.value

            def result() -> pd.DataFrame:
                return pd.DataFrame({"n": [seen], "p": [t.m.flat().astype(float)]})

            t, seen, shard, held = None, 0, None, []

            def learn() -> int:
                """Trains on what is held: batches are cut by documents, the same on any partitioning."""
                ids, starts = joined(pd.Series(held))
                one, two = contexts(ids, starts)
                order = t.rng.permutation(len(ids))
                for i in range(0, len(ids), BATCH):
                    own = order[i : i + BATCH]
                    t.step(ids[own], one[own], two[own])
                return len(ids)

            for batch in batches:
                for ids, own in zip(batch["ids"], batch["shard"], strict=True):
                    if own != shard:
                        if shard is not None:
                            seen += learn() if held else 0
                            yield result()
                        t, seen, shard, held, size = Trainer(LogBilinear.of(flat.copy(), len(unigram)), unigram, 1_000_003 * k + int(own)), 0, own, [], 0
                    held.append(ids)
                    size += len(ids)
                    if size >= 1 << 21:  # about a million tokens
                        seen += learn()
                        held, size = [], 0
            if shard is not None:
                seen += learn() if held else 0
                yield result()

        each = dealt.select("ids", "shard").mapInPandas(run, "n long, p array<double>")
        means = each.select("n", F.posexplode("p").alias("i", "x")).groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        rows = means.collect()  # one row for each parameter
        flat = np.zeros(len(rows))
        flat[[r["i"] for r in rows]] = [r["x"] for r in rows]
        model = LogBilinear.of(flat, len(unigram))
    return model


def token_scores(coded: DataFrame, model: LogBilinear) -> DataFrame:
    """``coded`` without ids, and with ``log_ids``: the sum of log10 P(id | context) of each document."""
    sent = coded.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_all", "log_other", "n_other"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a1, a2, z = sent.value.tables()
        for batch in batches:
            if not len(batch):
                continue
            ids, starts = joined(batch["ids"])
            one, two = contexts(ids, starts)
            p = a1[one, ids] + a2[two, ids] - z[one, two]
            out = batch[names].copy()
            out["log_ids"] = np.add.reduceat(p.astype(np.float64), starts) / np.log(10)
            yield out

    schema = ", ".join(x for x in _CODED.split(", ") if x.split(" ")[0] in names) + ", log_ids double"
    return coded.select(*names, "ids").mapInPandas(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """Base and model scores of ``docs`` (doc_id, held_out, text), learned from those not held out."""
    train_docs = docs.where(~F.col("held_out"))
    counts = written(word_counts(train_docs), "counts")
    lex = lexicon(counts, train_docs.count())
    coded = written(encode(docs, lex), "coded")
    model = train(coded, lex)
    rare = coded.select("row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("rare_n").alias("n"))).alias("r")).select("row", "r.word", "r.n")
    rare = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("log_rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rare"))
    far_n, far_v = lex.other
    df = token_scores(coded, model).join(rare, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return df.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("log_all") + log_rare - F.col("n_tokens") * float(np.log10(lex.tokens + lex.types + 1))).alias("base_score"),
        (F.col("log_ids") + F.col("log_other") + log_rare - F.col("n_other") * float(np.log10(far_n + far_v + 1))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", held_out("doc_id", 7).alias("held_out"), "text"))


