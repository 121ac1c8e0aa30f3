"""Feature encoding: fitted on train rows, applied as plain column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.operators import quality, rank

CLIP_QUANTILE = 0.99999
MIN_SHARE = 0.001
MAX_CODES = 63
OTHER = 0
# Names of the slots of port buckets and presence columns.
LABELS = {"_bucket": {"0": "well_known", "1": "registered", "2": "ephemeral"}, "_present": {"0": "absent", "1": "present"}}


def bucket_port(c: str) -> Column:
    return F.when(F.col(c) < 1024, 0).when(F.col(c) < 49152, 1).otherwise(2)


def present(c: str) -> Column:
    """Whether a conditional column is set; NULL and NaN count as set, as they are not zero."""
    return F.coalesce((F.col(c) != 0) | F.isnan(c), F.lit(True)).cast("int")


@dataclass(frozen=True)
class Continuous:
    clip_hi: float
    log_shift: float | None
    mean: float
    std: float


@dataclass
class Pipeline:
    """Fitted parameters; ``transform`` refuses to run before ``fit``."""

    continuous: list[str]
    log: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    params: dict[str, Continuous] = field(default_factory=dict)
    vocab: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def clean(c: Column, hi: float) -> Column:
        """NaN and -inf to 0, +inf and what is above to the clip bound; NULL to 0."""
        c = c.cast("double")
        return F.when(c.isNull() | F.isnan(c) | (c == float("-inf")), 0.0).otherwise(F.least(c, F.lit(hi)))

    def _staged(self, c: str, hi: float, shift: float | None) -> Column:
        x = self.clean(F.col(c), hi)
        return x if shift is None else F.log1p(F.greatest(x + shift, F.lit(0.0)))

    def fit(self, train: DataFrame) -> Pipeline:
        """Exact quantiles, then moments, of continuous columns and one count for categories; only train rows may be given."""
        if "split" in train.columns and train.where("split IS NULL OR split <> 'train'").limit(1).count():
            raise ValueError("rows that are not train rows")
        if self.continuous:
            long = quality.unpivot(train, self.continuous, []).where(quality.finite("value"))
            ends = rank.percentiles(long, "value", {"lo": 0.0, "hi": CLIP_QUANTILE}, "feature").collect()  # one row a column
            first = {r["feature"]: (r["lo"], r["hi"]) for r in ends}
            bounds = {}
            for c in self.continuous:
                lo, hi = first.get(c, (0.0, 0.0))
                bounds[c] = (hi, -min(0.0, lo) if c in self.log else None)
            second = train.agg(*[x for c, (hi, shift) in bounds.items() for x in (F.avg(self._staged(c, hi, shift)).alias(f"m_{c}"), F.stddev_pop(self._staged(c, hi, shift)).alias(f"s_{c}"))]).first()
            for c, (hi, shift) in bounds.items():
                s = second[f"s_{c}"] or 0.0
                self.params[c] = Continuous(hi, shift, second[f"m_{c}"] or 0.0, s if s > 1e-12 else 1.0)
        if self.categorical:
            self.vocab |= {c: [] for c in self.categorical}  # in the order of the columns
            for r in vocabulary(train, self.categorical).orderBy("column", "code").collect():  # at most MAX_CODES rows a column
                self.vocab[r["column"]].append(r["value"])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.continuous and not self.params or self.categorical and not self.vocab:
            raise ValueError("fit the pipeline first")
        out = {}
        for c, p in self.params.items():
            z = (self._staged(c, p.clip_hi, p.log_shift) - p.mean) / p.std
            out[f"{c}_z"] = F.when(F.isnan(z), 0.0).otherwise(z).cast("float")
        for c, values in self.vocab.items():
            out[f"{c}_code"] = F.coalesce(F.try_element_at(F.create_map(*[x for i, v in enumerate(values, 1) for x in (F.lit(v), F.lit(i))]), F.col(c).cast("string")), F.lit(OTHER)) if values else F.lit(OTHER)
        return df.withColumns(out)

    def restore(self, df: DataFrame) -> DataFrame:
        """Encoded columns back in measured units, with ``exact`` unless the value sat on the clip bound."""
        out = {}
        for c, p in self.params.items():
            x = F.col(f"{c}_z").cast("double") * p.std + p.mean
            x = x if p.log_shift is None else F.expm1(x) - p.log_shift
            out[f"{c}_restored"] = F.when(F.abs(x - F.round(x)) < 1e-3 * F.greatest(F.abs(x), F.lit(1.0)), F.round(x)).otherwise(x)
            out[f"{c}_exact"] = self.clean(F.col(c), p.clip_hi) < p.clip_hi
        return df.withColumns(out)

    def cardinalities(self) -> dict[str, int]:
        return {c: len(v) + 1 for c, v in self.vocab.items()}

    def one_hot(self, c: str) -> Column:
        """Array of 0 and 1; codes outside the vocabulary are clipped into it."""
        n = self.cardinalities()[c]
        code = F.least(F.greatest(F.col(f"{c}_code"), F.lit(0)), F.lit(n - 1))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == code, 1.0).otherwise(0.0).cast("float"))

    def feature_names(self) -> list[str]:
        """Names by position: continuous columns, then ``COLUMN=value``; port buckets and presence columns have fixed labels."""
        label = lambda c, v: next((named.get(v, v) for end, named in LABELS.items() if c.endswith(end)), v)
        return [*self.params, *[f"{c}={label(c, v)}" for c, values in self.vocab.items() for v in ["OTHER", *values]]]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, p.clip_hi, p.log_shift, p.mean, p.std, i) for i, (c, p) in enumerate(self.params.items())]
        spark.createDataFrame(rows, "column string, clip_hi double, log_shift double, mean double, std double, place int").write.parquet(f"{path}/params")
        rows = [(c, v, i, place) for place, (c, values) in enumerate(self.vocab.items()) for i, v in enumerate(["OTHER", *values])]
        spark.createDataFrame(rows, "column string, value string, code int, place int").write.parquet(f"{path}/vocab")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Pipeline:
        params = {r["column"]: Continuous(r["clip_hi"], r["log_shift"], r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/params").orderBy("place").collect()}
        vocab: dict[str, list[str]] = {}
        for r in spark.read.parquet(f"{path}/vocab").orderBy("place", "code").collect():
            own = vocab.setdefault(r["column"], [])
            if r["code"] != OTHER:
                own.append(r["value"])
        return cls(list(params), [c for c, p in params.items() if p.log_shift is not None], list(vocab), params, vocab)


def vocabulary(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): values of enough rows, at most ``MAX_CODES``, commonest first, then by value; 0 is OTHER."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    total = Window.partitionBy("column")
    w = total.orderBy(F.desc("n"), "value")
    kept = counts.withColumn("share", F.col("n") / F.sum("n").over(total)).where((F.col("share") >= MIN_SHARE) & F.col("value").isNotNull())
    return kept.withColumn("code", F.row_number().over(w)).where(F.col("code") <= MAX_CODES).select("column", "value", "code")


def apply_vocabulary(df: DataFrame, vocab: DataFrame, column: str) -> DataFrame:
    """Lookup with default as a join: codes of unseen values are OTHER."""
    own = vocab.where(F.col("column") == column).select(F.col("value").alias("_v"), F.col("code").alias(f"{column}_code"))
    out = df.join(F.broadcast(own), df[column].cast("string") == F.col("_v"), "left").drop("_v")  # at most MAX_CODES rows
    return out.withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(OTHER)))


def oov_report(target: DataFrame, vocab: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share of rows whose value the source does not know, distinct values, vocabulary size and overlap."""
    long = target.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n")).join(F.broadcast(vocab), ["column", "value"], "left")
    sizes = vocab.groupBy("column").agg(F.count("*").alias("vocab_size"))
    g = counts.groupBy("column").agg((F.sum(F.when(F.col("code").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("oov_rate"), F.count("*").alias("n_distinct"), F.count("code").alias("n_shared"))
    return g.join(F.broadcast(sizes), "column", "left").withColumn("vocab_size", F.coalesce("vocab_size", F.lit(0)))


def standardised(df: DataFrame, columns: list[str], fit: Column, log: bool = True) -> DataFrame:
    """log1p and z-scores with statistics of the rows where ``fit`` holds; population deviation, 1 if it vanishes."""
    stage = (lambda c: F.log1p(F.col(c).cast("double"))) if log else (lambda c: F.col(c).cast("double"))
    r = df.where(fit).agg(*[x for c in columns for x in (F.avg(stage(c)).alias(f"m_{c}"), F.stddev_pop(stage(c)).alias(f"s_{c}"))]).first()
    return df.withColumns({f"{c}_z": (stage(c) - r[f"m_{c}"]) / (r[f"s_{c}"] if (r[f"s_{c}"] or 0) >= 1e-12 else 1.0) for c in columns})
