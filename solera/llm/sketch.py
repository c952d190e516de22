"""Threshold-scaled sketches as document fingerprints (operator 8, DataFrame functions only).

A document's sketch holds every 64-bit hash of its five-word shingles that lies below a fixed
fraction (1 / 2**``BITS``) of the range.  The threshold is the same for all documents, so sketches
grow with their documents, the sketch of a union is the union of the sketches, and the share of
the smaller sketch that the larger one holds estimates containment, however unequal the two
documents are.  A text whose hashes all lie above the threshold keeps its least hash, so that no
text with words has an empty sketch; merging takes the union and drops what lies above the
threshold unless nothing else is left.

Defined cases: a null text is an empty one; a text without words has the empty sketch, like to
another empty one (1) and to no other (0); a text of one to four words is one shingle; ids are
ordered with null first, rows with the same id by text hash; rows equal in id and text are one
document, each with its own row of the result; the only document of a table is its own next; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solera.llm.common import text_of, words_of, written

SHINGLE = 5
#: A sketch keeps one hash of 2**BITS.
BITS = 3


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``df`` with the sketch of a text column: a sorted array of hashes."""
    df = df.withColumn("__wh", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    runs = ", ".join(f"__wh[i + {k}]" for k in range(shingle))
    df = df.withColumn("__sh", F.expr(f"if(size(__wh) >= {shingle}, transform(sequence(0, size(__wh) - {shingle}), i -> xxhash64({runs})),"
                                      " if(size(__wh) > 0, array(xxhash64(__wh)), array()))"))
    df = df.withColumn("__low", F.expr(f"array_sort(array_distinct(filter(__sh, h -> shiftrightunsigned(h, {64 - bits}) = 0L)))"))
    least = "array(array_min(transform(__sh, h -> h ^ -9223372036854775808L)) ^ -9223372036854775808L)"
    return df.withColumn(name, F.expr(f"if(size(__low) > 0 or size(__sh) = 0, __low, {least})")).drop("__wh", "__sh", "__low")


def merge(a: Column, b: Column, bits: int = BITS) -> Column:
    """The sketch of two documents together (shingles across the seam aside)."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: F.shiftrightunsigned(h, 64 - bits) == 0)
    return F.array_sort(F.when((F.size(low) > 0) | (F.size(both) < 2), F.when(F.size(low) > 0, low).otherwise(both)).otherwise(
        F.array(F.array_min(F.transform(both, lambda h: h.bitwiseXOR(F.lit(-(1 << 63))))).bitwiseXOR(F.lit(-(1 << 63))))))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the larger one holds."""
    few = F.least(F.size(a), F.size(b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(few == 0, 0.0)
            .otherwise(F.size(F.array_intersect(a, b)) / few))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: A document's key, without nulls, so that every join and window on it shares one partitioning.
KEY = ["has_id", "id", "text_hash"]


def _neighbours(docs: DataFrame) -> DataFrame:
    """KEY, prev (the key of the document before it in ascending order, around the end) and
    prev_chars of every distinct document."""
    ids = docs.select(*KEY, F.length("text").alias("chars")).distinct()
    # range partitions, written with their numbers: each is ordered by itself, the ends meet
    dealt = written(ids.repartitionByRange(*KEY).withColumn("chunk", F.spark_partition_id()), "sketch-ids")
    place = F.struct(*KEY, "chars")
    ends = dealt.groupBy("chunk").agg(F.max(place).alias("last"))
    by_chunk = Window.orderBy("chunk")
    ends = ends.select("chunk", F.coalesce(F.lag("last").over(by_chunk), F.last("last").over(by_chunk.rowsBetween(0, Window.unboundedFollowing))).alias("wrap"))
    inside = F.lag(place).over(Window.partitionBy("chunk").orderBy(*KEY))
    prev = dealt.withColumn("prev", inside).join(ends, "chunk").withColumn("prev", F.coalesce("prev", "wrap"))
    return prev.select(*KEY, "prev")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  The edited text has its last n_chars / 2 code
    points replaced by the first as many (or all) of the next document's.

    The texts are shuffled once, by document; from there each document sends the code points
    that the one before it needs, and its sketch."""
    docs = (docs.select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
                        text_of(F.col("text")).alias("text")).withColumn("text_hash", F.xxhash64("text")))
    own = docs.join(_neighbours(docs), KEY)
    sent = own.dropDuplicates(KEY)
    sent = with_sketch(sent.withColumn("start", F.expr("left(text, int(prev.chars div 2))")), "text", "next_sketch", shingle, bits)
    sent = sent.select(*[F.col(f"prev.{k}").alias(k) for k in KEY], "start", "next_sketch")
    d = own.select(*KEY, "text").join(sent, KEY).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 2)), start)")).drop("start")
    d = with_sketch(with_sketch(d, "text", "sketch", shingle, bits), "edited", "edited_sketch", shingle, bits)
    return d.select(F.when(F.col("has_id"), F.col("id")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                    containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                    containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
