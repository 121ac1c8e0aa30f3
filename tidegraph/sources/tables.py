"""Table contracts: where flows, splits and scores come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A flow table: one directed edge per row, in row_id order.
FLOW = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("in_bytes", T.DoubleType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("family", T.StringType()),
    ]
)
BENIGN = "view"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flows: user to key, the whole value as port, views as the benign family."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("src"),
        k.alias("dst"),
        F.floor("value").cast("int").alias("dst_port"),
        F.floor(k / 20).cast("int").alias("proto"),
        F.col("value").alias("in_bytes"),
        F.when(F.col("event_type") != BENIGN, 1).otherwise(0).alias("label"),
        F.col("event_type").alias("family"),
    )


FLOWS_SQL = """flows AS (SELECT event_id AS row_id, user_id AS src, (props::JSON->>'$.k')::BIGINT AS dst, floor(value)::INT AS dst_port,
  ((props::JSON->>'$.k')::BIGINT // 20)::INT AS proto, value AS in_bytes, (event_type <> 'view')::INT AS label, event_type AS family FROM events)"""


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` into as many partitions as there are shuffle partitions and cores at least.

    For rows that cost much time each: partitions of files and of merged shuffles follow bytes, so a few of them would hold
    all such rows and few cores would work. A number that is stated isn't merged.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def read_flows_csv(spark: SparkSession, path: str, schema: T.StructType = FLOW) -> DataFrame:
    """CSV with a stated schema; malformed rows fail instead of turning into nulls."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def csv_to_parquet(spark: SparkSession, csv: str, parquet: str, schema: T.StructType = FLOW) -> DataFrame:
    read_flows_csv(spark, csv, schema).write.option("compression", "snappy").parquet(parquet)
    return spark.read.parquet(parquet)


def read_results(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Result documents of many runs, one JSON object a file, as one row per entry of ``runs``."""
    docs = spark.read.option("multiLine", True).json(paths)
    return docs.select(*[c for c in docs.columns if c != "runs"], F.explode("runs").alias("run")).select("*", "run.*").drop("run")


def read_shapes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Result documents of unlike shapes, one JSON object a file, as ``file`` and ``doc`` (VARIANT): fields may be missing,
    extra, NULL or of another type from file to file, and none of it is settled before it is asked for."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("doc"))


def entries(docs: DataFrame, name: str, fields: dict[str, str], head: dict[str, str] | None = None) -> DataFrame:
    """One row for each entry of the array ``name`` of each document, with typed ``fields`` of the entry and of the ``head``.

    What is missing, NULL or doesn't fit its type is NULL; a document without the array gives no row.
    """
    own = docs.select("file", *[F.try_variant_get("doc", f"$.{c}", t).alias(c) for c, t in (head or {}).items()], F.explode(F.try_variant_get("doc", f"$.{name}", "array<variant>")).alias("_e"))
    return own.select("file", *(head or {}), *[F.try_variant_get("_e", f"$.{c}", t).alias(c) for c, t in fields.items()])


def shape(docs: DataFrame) -> str:
    """The schema that all documents fit, merged over files."""
    return docs.agg(F.schema_of_variant_agg("doc").alias("s")).first()["s"]


# Texts of CSV cells that stand for no value.
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")
#: Types of CSV cells from narrow to wide; the bit of a type is its place.
CSV_TYPES = ("boolean", "bigint", "double", "timestamp", "string")


def _cell_bit(value: Column) -> Column:
    """Bit of the narrowest type of a cell, NULL for no value."""
    number = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | F.lower(value).isin("inf", "-inf", "+inf")
    whole = value.rlike(r"^[+-]?\d{1,19}$") & value.try_cast("bigint").isNotNull()
    stamp = value.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$") & value.try_cast("timestamp").isNotNull()
    bit = F.when(F.lower(value).isin("true", "false"), 1).when(whole, 2).when(number, 4).when(stamp, 8).otherwise(16)
    return F.when(value.isNotNull() & ~value.isin(*NULL_TEXTS), bit)


def _joined(bits: Column) -> Column:
    """The type that holds all kinds of cells seen: whole numbers and fractions are doubles, any other mixture is text."""
    exact = {1: "boolean", 2: "bigint", 4: "double", 6: "double", 8: "timestamp"}
    out = F.when(bits.isNull() | (bits == 0), "void")
    for b, kind in exact.items():
        out = out.when(bits == b, kind)
    return out.otherwise("string")


def csv_types(spark: SparkSession, path: str) -> DataFrame:
    """(column, position, type, n_null, widened_by) of a CSV file with a header, from all its rows in one aggregate.

    Each cell has one bit for its kind, and bits are merged, so any order of rows and any split of files gives the same
    types. ``widened_by`` is the first cell, in file order, of a kind that isn't that of the column's first cell.
    """
    cells = spark.read.option("header", True).csv(path)
    names = cells.columns
    rows = cells.select(F.monotonically_increasing_id().alias("_at"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    aggs = []
    for i in range(len(names)):
        c, bit = F.col(f"c{i}"), _cell_bit(F.col(f"c{i}"))
        firsts = [F.min(F.when(bit == 1 << k, F.struct("_at", c.alias("value")))).alias(f"k{k}") for k in range(len(CSV_TYPES))]
        aggs += [F.struct(F.lit(names[i]).alias("column"), F.lit(i).alias("position"), _joined(F.bit_or(bit)).alias("type"), F.count_if(bit.isNull()).alias("n_null"), F.array_sort(F.array_compact(F.array(*firsts))).alias("firsts"))]
    found = rows.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return found.select("column", "position", "type", "n_null", F.get("firsts", F.lit(1))["value"].alias("widened_by"))


def inferred_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema of ``csv_types``; a column without values is text. A row a column comes to the driver."""
    rows = csv_types(spark, path).orderBy("position").collect()
    kinds = {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(r["column"], kinds.get(r["type"], T.StringType())) for r in rows])


def inferred_csv_to_parquet(spark: SparkSession, csv: str, parquet: str) -> DataFrame:
    """CSV as Parquet with types inferred from all rows; cells that stand for no value are NULL."""
    schema = inferred_schema(spark, csv)
    text = spark.read.option("header", True).csv(csv)
    value = lambda c: F.when(~F.col(f"`{c}`").isin(*NULL_TEXTS), F.col(f"`{c}`"))
    text.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.option("compression", "snappy").parquet(parquet)
    return spark.read.parquet(parquet)


def with_row_id(df: DataFrame) -> DataFrame:
    """Dense row_id of Parquet rows in file and row order: the row's place in its file plus the rows of earlier files.

    Only the per-file counts, one row a file, are ordered; no row is sorted.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if counts.count() <= 1 << 20:
        starts = F.broadcast(starts)  # a row a file: no row is shuffled
    return placed.join(starts, "_file").withColumn("row_id", F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")


def resolve_roles(columns: list[str], **roles: list[str]) -> dict[str, list[str]]:
    """Column roles: every configured column must exist; continuous is what no role names."""
    missing = sorted({c for names in roles.values() for c in names} - set(columns))
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")
    taken = {c for names in roles.values() for c in names}
    return {**roles, "continuous": [c for c in columns if c not in taken]}
