"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule. A policy
is a versioned set of rules (a mask), so applying another version, or asking what each rule alone removes, is bitwise
work over the ledger and never reads texts again. DataFrame functions only: no shuffle for the ledger, one small
aggregate for ablations.

Null text counts as empty: no words, ``base_failed`` by the word minimum. Extra columns do not clash: the ledger reads
``doc_id`` and ``text`` only. Repeated rows give repeated rows. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import BLANKS, documents

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

#: Bit of each rule; a bit is never given to another rule.
RULES = {"few_words": 0, "repeated_words": 1, "symbols": 2, "dup_lines": 3, "word_length": 4, "shouting": 5}
#: Versioned policies: the rules that reject. A version is never changed once used.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "dup_lines", "word_length", "shouting"),
}


def mask_of(version: str) -> int:
    return sum(1 << RULES[name] for name in POLICIES[version])


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more.

    Windows are sorted by a 64-bit hash and place, so equal ones are neighbours; places of repeated ones, back in
    order, then cover min(3, distance to the next) words each. n log n for any text length.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - 3)
    windows = F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(n >= 3, windows).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, measurements and ``fail_bits``; ``carry`` adds the whole input row as ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = ["row"] if carry else []
    df = docs.select("doc_id", text.alias("t"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    df = df.withColumn("words", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("s", F.sort_array(_repeat_words(F.col("words"))))
    again = lambda x, j: (F.get("s", j - 1)["h"] == x["h"]) | (F.get("s", j + 1)["h"] == x["h"])
    df = df.withColumn("r", F.sort_array(F.transform(F.filter("s", lambda x, j: F.coalesce(again(x, j), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate("r", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    bare = F.translate("t", BLANKS, "")
    upper = F.length(F.regexp_replace("t", r"[^A-Z]", ""))
    letters = F.length(F.regexp_replace("t", r"[^A-Za-z]", ""))
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        upper.cast("long").alias("n_upper"),
        letters.cast("long").alias("n_letters"),
        *carried,
    )
    n = F.col("n_words")
    fails = {
        "few_words": n < MIN_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 100 * F.col("n_symbols") > 30 * n,
        "dup_lines": (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n),
        "shouting": (F.col("n_letters") >= 100) & (100 * F.col("n_upper") > 60 * F.col("n_letters")),
    }
    bits = None
    for name, bit in RULES.items():
        one = F.when(fails[name], F.lit(1 << bit)).otherwise(F.lit(0))
        bits = one if bits is None else bits.bitwiseOR(one)
    return df.withColumn("fail_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under one policy version."""
    base = mask_of("v1")
    failed = F.col("fail_bits").bitwiseAND(F.lit(base)) != 0
    kept = ~failed & (F.col("fail_bits").bitwiseAND(F.lit(mask_of(version))) == 0)
    return rows.withColumn("base_failed", failed).withColumn("kept", kept)


def ablation(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that would be kept without it.

    One pass and one small aggregate over the distinct bit patterns.
    """
    mask = mask_of(version)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << RULES[name]).cast("long").alias("bit")) for name in POLICIES[version]]
    each = patterns.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask) - F.col("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(documents(spark, sf_dir)))


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(documents(spark, sf_dir)))


_LEDGER_SQL = r"""
base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
tok AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM worded),
tri AS (SELECT rid, i, w || chr(10) || lead(w) OVER p || chr(10) || lead(w, 2) OVER p AS g FROM tok
        WINDOW p AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY rid),
meas AS (SELECT doc_id, len(words)::BIGINT AS n_words,
  length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
  length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters
  FROM worded LEFT JOIN cov USING (rid)),
ledger AS (SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
  | (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  | (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END)
  | (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
  | (CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END)
  | (CASE WHEN n_letters >= 100 AND 100 * n_upper > 60 * n_letters THEN 32 ELSE 0 END))::BIGINT AS fail_bits FROM meas)
"""
SQL = f"""WITH {_LEDGER_SQL}
SELECT *, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 3) = 0 AND (fail_bits & 63) = 0 AS kept FROM ledger"""
ABLATION_SQL = f"""WITH {_LEDGER_SQL},
rules AS (SELECT * FROM (VALUES ('few_words', 1::BIGINT), ('repeated_words', 2), ('symbols', 4), ('dup_lines', 8), ('word_length', 16), ('shouting', 32)) r(rule, bit))
SELECT rule, bit, (count(*) FILTER ((fail_bits & bit) <> 0))::BIGINT AS n_failing,
  (count(*) FILTER (fail_bits & 63 = bit))::BIGINT AS n_only_this,
  (count(*) FILTER ((fail_bits & (63 - bit)) = 0))::BIGINT AS n_kept_without
FROM ledger, rules GROUP BY rule, bit"""
