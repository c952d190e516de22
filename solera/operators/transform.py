"""Projection, filters, dedup/upsert, dimension and fact building, governance transforms.

All functions are DataFrame -> DataFrame (no actions).  Scale notes per function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solera.functions.scalar import clamp, yyyymmdd

# --- fixed values ---------------------------------------------------------------------------
MAX_HOURS = 720                     # relative-time filter clamp (30 days)
MONTH_NAMES_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
                  "septiembre", "octubre", "noviembre", "diciembre"]
# service-name normalisation, applied in this order (substring replacement)
SERVICE_NAME_REPLACEMENTS = [
    ("Amazon Relational Database Service", "RDS"),
    ("Amazon Elastic Compute Cloud - Compute", "EC2"),
    ("Amazon Simple Storage Service", "S3"),
    ("AWS Glue", "Glue"),
    ("Amazon Athena", "Athena"),
    ("Amazon Redshift Serverless", "Redshift"),
    ("Amazon Virtual Private Cloud", "VPC"),
    ("AWS Secrets Manager", "Secrets Manager"),
    ("AWS Cost Explorer", "Cost Explorer"),
    ("AWS CloudTrail", "CloudTrail"),
    ("AmazonCloudWatch", "CloudWatch"),
    ("AWS Lambda", "Lambda"),
    ("AWS Lake Formation", "Lake Formation"),
]
# PII patterns (Java regex; also valid RE2 so the SQL twins use the same text)
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "numero": r"[0-9][0-9 -]{8,}[0-9]",
}
# --------------------------------------------------------------------------------------------


# ---------------------------------------------------------------- B1-B7
def project(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B1: select + rename (``{new_name: source_expression}``)."""
    return df.selectExpr(*[f"{src} AS {dst}" for dst, src in mapping.items()])


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """B2: typed cast of text columns to the contract.  ``try_cast`` (NULL on bad input) so a
    dirty value does not abort the job under ANSI mode; ``rejects`` lists those rows.
    Empty strings count as NULL (``NULLIF(x, '')``)."""
    return df.select(*[F.nullif(F.col(c), F.lit("")).try_cast(t).alias(c) if t != "string"
                       else F.col(c) for c, t in schema.items()])


def rejects(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Rows with a non-empty value that does not cast to its contract type, with the column
    names that failed (quarantine)."""
    bad = [F.when(F.nullif(F.col(c), F.lit("")).isNotNull()
                  & F.nullif(F.col(c), F.lit("")).try_cast(t).isNull(), F.lit(c))
           for c, t in schema.items() if t != "string"]
    return (df.withColumn("_bad_columns", F.array_compact(F.array(*bad)))
            .where(F.size("_bad_columns") > 0))


def opt_filter(df: DataFrame, col: str, value) -> DataFrame:
    """``col = COALESCE(:p, col)`` -- with no value every non-NULL row passes."""
    if value is None:
        return df.where(F.col(col).isNotNull())
    return df.where(F.col(col) == F.lit(value))


def last_hours(df: DataFrame, ts: str, hours: int, as_of=None) -> DataFrame:
    """``ts >= as_of - hours`` with hours clamped to [1, 720]; ``as_of`` defaults to the
    newest ``ts`` (a scalar subquery), never the wall clock, so reruns agree."""
    h = clamp(hours, 1, MAX_HOURS)
    ref = df.agg(F.max(ts)).scalar() if as_of is None else F.lit(as_of).cast(df.schema[ts].dataType)
    return df.where(F.col(ts) >= ref - F.make_interval(hours=F.lit(h)))


def last_days(df: DataFrame, date_col: str, days: int = 30, as_of=None) -> DataFrame:
    """``date >= as_of - days``."""
    ref = df.agg(F.max(date_col)).scalar() if as_of is None else F.lit(as_of).cast("date")
    return df.where(F.col(date_col) >= F.date_sub(ref, days))


# ---------------------------------------------------------------- B8, B9, B12
def scd1_latest(df: DataFrame, key: str | list[str], order_col: str = "loaded_at") -> DataFrame:
    """Newest row per key; keys missing from the newest load are kept.
    ``row_number() = 1`` -- Catalyst adds a partial ``WindowGroupLimit`` before the shuffle,
    so even a key with a third of all rows ships one row per map task."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def latest_load(df: DataFrame, col: str = "loaded_at") -> DataFrame:
    """Only the rows of the newest load (keys absent from it are dropped).  The newest
    stamp is a scalar subquery, so on a partitioned folder the filter prunes to one folder."""
    newest = df.agg(F.max(col)).scalar()
    return df.where(F.col(col) == newest)


def dedupe_by_key(df: DataFrame, key: str | list[str]) -> DataFrame:
    """One row per key, deterministic: the greatest row (struct order) wins.  Plain hash
    aggregate, so partial aggregation collapses hot keys before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    return (df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in rest])).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def upsert(target: DataFrame, updates: DataFrame, key: str | list[str],
           stamp_col: str | None = "cargado_en", stamp=None) -> DataFrame:
    """Insert-or-overwrite by key; never deletes.  ``target LEFT ANTI updates`` union the
    (key-deduplicated) updates; the updates get ``stamp_col`` = ``stamp`` when given.
    On a table format with MERGE this is ``MERGE INTO ... WHEN MATCHED UPDATE SET *
    WHEN NOT MATCHED INSERT *``."""
    keys = [key] if isinstance(key, str) else list(key)
    upd = dedupe_by_key(updates, keys)
    if stamp_col:
        upd = upd.withColumn(stamp_col, F.lit(stamp).cast("timestamp") if stamp is not None
                             else F.col(stamp_col) if stamp_col in upd.columns else F.lit(None).cast("timestamp"))
    kept = target.join(upd.select(*keys), keys, "left_anti")
    return kept.unionByName(upd.select(*target.columns), allowMissingColumns=False)


# ---------------------------------------------------------------- B13-B17, B19
def date_dim(start, end, holidays: DataFrame | None = None) -> DataFrame:
    """Calendar rows from ``start`` to ``end`` (columns or literals), one per day.
    ``start``/``end`` may be scalar subqueries over a fact, so the span follows the data.
    ``holidays`` (a DataFrame with a ``fecha`` column) marks ``es_feriado`` by semi join."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    s = start if isinstance(start, Column) else F.lit(start).cast("date")
    e = end if isinstance(end, Column) else F.lit(end).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(s, e)).alias("fecha"))
    month_names = F.array(*[F.lit(m) for m in MONTH_NAMES_ES])
    cal = days.select(
        yyyymmdd("fecha").alias("fecha_id"),
        F.col("fecha"),
        F.year("fecha").cast("short").alias("anio"),
        F.month("fecha").cast("short").alias("mes"),
        F.quarter("fecha").cast("short").alias("trimestre"),
        F.dayofweek("fecha").isin(1, 7).alias("es_finde"),
        F.element_at(month_names, F.month("fecha")).alias("nombre_mes"),
    )
    if holidays is None:
        return cal.withColumn("es_feriado", F.lit(False))
    flagged = cal.join(holidays.select("fecha").distinct().withColumn("es_feriado", F.lit(True)), "fecha", "left")
    return flagged.withColumn("es_feriado", F.coalesce("es_feriado", F.lit(False))).select(*cal.columns, "es_feriado")


def with_spread(ticks: DataFrame) -> DataFrame:
    """spread = precio_venta - precio_compra."""
    return ticks.withColumn("spread", F.col("precio_venta") - F.col("precio_compra"))


def with_mid(ticks: DataFrame) -> DataFrame:
    """Mid price (compra + venta) / 2."""
    return ticks.withColumn("mid", (F.col("precio_compra") + F.col("precio_venta")) / 2)


def normalize_names(df: DataFrame, col: str, mapping=SERVICE_NAME_REPLACEMENTS, null_as: str = "?") -> DataFrame:
    """Ordered substring replacements (``replace`` chain, JVM-side)."""
    c = F.col(col)
    for old, new in mapping:
        c = F.replace(c, F.lit(old), F.lit(new))
    return df.withColumn(col, F.coalesce(c, F.lit(null_as)))


def parse_json_map(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """JSON object text -> ``map<string,string>`` (scalars as text, nested values as JSON)."""
    return df.withColumn(out or col, F.from_json(F.col(col), "map<string,string>"))


# ---------------------------------------------------------------- B20-B23 governance
def erase_subjects(tables: dict[str, tuple[DataFrame, str]], subjects: DataFrame, subject_col: str):
    """Right to erasure.  ``tables`` maps name -> (frame, its subject column).  Returns
    (the rewritten frames, an erasure report DataFrame).  Anti joins; the subject list is
    joined, not collected, so it may be as large as the client table."""
    ids = subjects.select(F.col(subject_col).alias("_sid")).distinct()
    kept, report = {}, None
    for name, (df, col) in tables.items():
        k = df.join(ids, df[col] == ids["_sid"], "left_anti")
        kept[name] = k
        row = df.agg(F.count(F.lit(1)).alias("filas_antes")).select(
            F.lit(name).alias("tabla"), "filas_antes",
            k.agg(F.count(F.lit(1))).scalar().alias("filas_despues"))
        report = row if report is None else report.unionByName(row)
    report = report.withColumn("filas_borradas", F.col("filas_antes") - F.col("filas_despues"))
    return kept, report


def pii_scan(df: DataFrame, col: str, key: str) -> DataFrame:
    """Count PII matches per row (emails, long digit runs such as ids/phones/cards)."""
    return df.select(key, *[F.size(F.regexp_extract_all(F.col(col), F.lit(p), 0)).alias(f"n_{name}")
                            for name, p in PII_PATTERNS.items()])


def pii_tokenize(df: DataFrame, col: str, salt: str, out: str | None = None) -> DataFrame:
    """Replace every PII match by ``tok_`` + first 16 hex of sha256(salt || match).
    The text is cut at the matches of one combined pattern and put together again with their
    tokens in between, so a match is replaced where it stands and nowhere else.  A NULL text
    stays NULL.  Built-in functions only (no Python per row)."""
    pattern = "|".join(f"(?:{p})" for p in PII_PATTERNS.values())
    tokens = F.transform(F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(0)), lambda m: F.concat(
        F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(salt), m), 256), 1, 16)))
    between = F.split(F.col(col), pattern, -1)
    parts = F.zip_with(between, tokens, lambda b, t: F.concat(b, F.coalesce(t, F.lit(""))))
    return df.withColumn(out or col, F.array_join(parts, ""))


def governed_view(df: DataFrame, columns: list[str] | None = None, row_pred: Column | str | None = None) -> DataFrame:
    """Column- and row-level security as a projection + filter (register as a temp view
    and grant the view, not the table)."""
    out = df
    if row_pred is not None:
        out = out.where(row_pred)
    if columns is not None:
        out = out.select(*columns)
    return out


def governed_tables(tags: DataFrame, allowed=("Public", "Internal"), tag_col: str = "sensitivity",
                    exclude_pii: bool = True) -> DataFrame:
    """Tables a principal may read -- sensitivity in ``allowed`` and not tagged PII."""
    out = tags.where(F.col(tag_col).isin(list(allowed)))
    if exclude_pii and "pii" in tags.columns:
        out = out.where(~F.coalesce(F.col("pii"), F.lit(False)))
    return out


