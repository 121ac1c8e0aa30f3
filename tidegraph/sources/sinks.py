"""Result files that other tools read: rows as JSON lines or CSV, figures as one JSON object."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, in as many files as there are partitions; NULLs are written."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each file; quotes inside values are doubled, NULL is an empty field and an empty text is quoted."""
    df.write.mode("errorifexists").option("header", "true").option("escape", '"').option("emptyValue", '""').csv(path)


def write_metrics(figures: DataFrame, path: str) -> None:
    """Figures, a single row, as one JSON object in one file."""
    if figures.limit(2).count() != 1:
        raise ValueError("figures are a single row")
    write_json_lines(figures.coalesce(1), path)
