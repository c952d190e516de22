"""Retention (A18), content checksums (A20) and their tree for zone reconciliation.

A zone's rows fall into 2^``bits`` ranges of the hash of their key.  ``digests`` gives count and hash
sum per range in one pass (a table of at most 2^``bits`` rows, to be stored beside the zone);
the digest of any node above is the sum over its ranges (``level``), the root's is the checksum.
``locate`` walks down two stored digest tables from the root and names the ranges that differ;
``differences`` opens only these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: retention policies (days; label applied once a row is older) -------------
RETENTION_POLICIES = {
    "resultados": [(7, "borrar")],
    "ticks": [(90, "archivo"), (5 * 365, "borrar")],
    "notificaciones": [(2 * 365, "borrar")],
}
# ----------------------------------------------------------------------------------------------


def retention_label(ts: str, tiers: list[tuple[int, str]], as_of: Column, default: str = "activo") -> Column:
    """Age-based label: the label of the largest tier whose age (days) the row exceeds."""
    age = F.datediff(as_of, F.to_date(F.col(ts)))
    out = F.lit(default)
    for days, label in sorted(tiers):
        out = F.when(age > days, F.lit(label)).otherwise(out)
    return out


def apply_retention(df: DataFrame, ts: str, policy: str | list[tuple[int, str]], as_of=None,
                    drop_label: str = "borrar") -> tuple[DataFrame, DataFrame]:
    """Label each row by age against ``as_of`` (default: the newest ``ts``; never the wall
    clock) and return (kept rows with their label, per-label counts).  Rows labelled
    ``drop_label`` are removed from the kept set; on partitioned folders the same predicate
    prunes whole partitions."""
    tiers = RETENTION_POLICIES[policy] if isinstance(policy, str) else policy
    ref = df.agg(F.max(ts)).scalar() if as_of is None else F.lit(as_of)
    labelled = df.withColumn("retencion", retention_label(ts, tiers, F.to_date(ref)))
    counts = labelled.groupBy("retencion").agg(F.count(F.lit(1)).alias("filas"))
    return labelled.where(F.col("retencion") != drop_label), counts


def row_hash(cols: list[str]) -> Column:
    """First 60 bits of SHA-256 over the row's text form (``|``-separated, NULL as ``\\N``)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def checksum(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Order-free content checksum: row count and the sum of per-row hashes (exact
    decimal, no overflow).  Equal on two zones iff they hold the same multiset of rows
    (up to hash collisions); computed with partial aggregation, no sort."""
    cols = cols or df.columns
    return df.agg(F.count(F.lit(1)).alias("filas"),
                  F.sum(row_hash(cols).cast("decimal(38,0)")).alias("suma_hash"))


def compare_checksums(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """One row comparing the checksums of two zones."""
    ca, cb = checksum(a, cols), checksum(b, cols)
    return ca.select(F.col("filas").alias("filas_a"), F.col("suma_hash").alias("suma_a"),
                     cb.agg(F.max("filas")).scalar().alias("filas_b"),
                     cb.agg(F.max("suma_hash")).scalar().alias("suma_b")).withColumn(
        "iguales", (F.col("filas_a") == F.col("filas_b")) & (F.col("suma_a") == F.col("suma_b")))


# ---------------------------------------------------------------- digest tree
TREE_BITS = 16


def _range(key: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in key]), 64 - bits).alias("rango")


def digests(df: DataFrame, key: list[str], cols: list[str] | None = None, bits: int = TREE_BITS) -> DataFrame:
    """Rows and sum of row hashes per key range."""
    return (df.select(_range(key, bits), row_hash(cols or df.columns).cast("decimal(38,0)").alias("_h"))
            .groupBy("rango").agg(F.count(F.lit(1)).alias("filas"), F.sum("_h").alias("suma_hash")))


def level(tree: DataFrame, bits: int, depth: int) -> DataFrame:
    """The tree's nodes ``depth`` bits below the root (0: the root), from its ranges."""
    node = F.shiftright("rango", bits - depth).alias("nodo")
    return tree.groupBy(node).agg(F.sum("filas").alias("filas"), F.sum("suma_hash").alias("suma_hash"))


def locate(a: DataFrame, b: DataFrame, bits: int = TREE_BITS, step: int = 8) -> DataFrame | None:
    """Ranges in which two digest tables differ, found from the root in steps of ``step`` bits: below
    the root only children of differing nodes are compared.  None when the roots agree (one job
    over each digest table).  Nothing larger than a digest table is joined."""
    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = (d.select("nodo", F.col("filas").alias(f"filas_{s}"), F.col("suma_hash").alias(f"suma_{s}")) for d, s in ((x, "a"), (y, "b")))
        same = F.col("filas_a").eqNullSafe(F.col("filas_b")) & F.col("suma_a").eqNullSafe(F.col("suma_b"))
        return x.join(y, "nodo", "full").where(~same).select("nodo")
    if differing(level(a, bits, 0), level(b, bits, 0)).isEmpty():
        return None
    found = None
    for depth in range(step, bits + step, step):
        depth = min(depth, bits)
        if found is not None:  # open only the children of the nodes found
            parents = found.withColumnRenamed("nodo", "_p")
            a, b = (d.join(parents, F.shiftright("rango", bits - last) == F.col("_p"), "left_semi") for d in (a, b))
        found, last = differing(level(a, bits, depth), level(b, bits, depth)), depth
    return found.withColumnRenamed("nodo", "rango")


def differences(a: DataFrame, b: DataFrame, key: list[str], cols: list[str], ranges: DataFrame | None = None,
                bits: int = TREE_BITS) -> DataFrame:
    """Keys whose rows differ between two zones: ``solo_a``, ``solo_b`` or ``distinta``, with the rows
    each zone has.  ``ranges`` (from ``locate``) limits the comparison to differing ranges; left out, it
    follows from the digests of both zones in the plan.  Rows of a key are compared as a multiset;
    NULL keys are a key."""
    if ranges is None:
        da = digests(a, key, cols, bits)
        db = digests(b, key, cols, bits).select(F.col("rango").alias("_r"), F.col("filas").alias("_n"), F.col("suma_hash").alias("_s"))
        same = F.col("filas").eqNullSafe(F.col("_n")) & F.col("suma_hash").eqNullSafe(F.col("_s"))
        ranges = da.join(db, F.col("rango") == F.col("_r"), "full").where(~same).select(F.coalesce("rango", "_r").alias("rango"))

    def opened(df: DataFrame) -> DataFrame:
        rows = df.select(_range(key, bits), *key, row_hash(cols).cast("decimal(38,0)").alias("_h"))
        return rows.join(ranges, "rango", "left_semi").select(*key, "_h")
    zero = F.lit(0).cast("decimal(38,0)")
    both = (opened(a).select(*key, F.lit(1).alias("_a"), F.lit(0).alias("_b"), F.col("_h").alias("_ha"), zero.alias("_hb"))
            .unionByName(opened(b).select(*key, F.lit(0).alias("_a"), F.lit(1).alias("_b"), zero.alias("_ha"), F.col("_h").alias("_hb"))))
    per_key = both.groupBy(*key).agg(F.sum("_a").alias("filas_a"), F.sum("_b").alias("filas_b"),
                                     F.sum("_ha").alias("_ha"), F.sum("_hb").alias("_hb"))
    kind = F.when(F.col("filas_b") == 0, "solo_a").when(F.col("filas_a") == 0, "solo_b").otherwise("distinta")
    return (per_key.where((F.col("filas_a") != F.col("filas_b")) | (F.col("_ha") != F.col("_hb")))
            .select(*key, kind.alias("diferencia"), "filas_a", "filas_b"))
