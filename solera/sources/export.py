"""Result exports: JSON documents (A11) and allow-listed, row-capped CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solera.functions.scalar import clamp

# --- fixed values -----------------------------------------------------------------------------
CSV_MIN_ROWS, CSV_MAX_ROWS = 100, 100_000
# ----------------------------------------------------------------------------------------------


def as_json_lines(df: DataFrame, col: str = "json") -> DataFrame:
    """One JSON object per row (``to_json(struct(*))``), computed on the executors."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(col))


def export_json(df: DataFrame, path: str) -> None:
    """Write the result as JSON lines (one file per task; no driver collection)."""
    df.write.mode("overwrite").json(path)


class NotAllowed(ValueError):
    pass


def export_csv(tables: dict[str, DataFrame], name: str, path: str, max_rows: int,
               allowed: set[str], order_by: list[str] | None = None) -> int:
    """Export an allow-listed table as CSV with header, at most ``max_rows`` rows (the cap
    is clamped to [100, 100000]); NULL is written as an empty field.  ``order_by`` is required: it makes
    the capped prefix repeatable (a top-k, ``TakeOrderedAndProject``).  Returns the cap used."""
    if name not in allowed or name not in tables:
        raise NotAllowed(f"table {name!r} is not exportable")
    if not order_by:
        raise ValueError("order_by decides which rows a capped export holds")
    n = clamp(max_rows, CSV_MIN_ROWS, CSV_MAX_ROWS)
    df = tables[name]
    out = df.orderBy(*order_by).limit(n).select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    out.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    return n
