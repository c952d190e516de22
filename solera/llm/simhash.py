"""SimHash near-dedup over a byte-position inverted index with count filtering (operator 10).

A 64-bit fingerprint has eight positional bytes.  Two fingerprints that differ in at most
``MAX_BITS`` = 4 bits differ in at most four bytes, so at least four positional bytes are
shared: that is the guaranteed minimum of the count filter.  Tallying single bytes pair by
pair would list every pair of a posting list that holds 1/256 of all rows, so the index is
keyed by what the tally must reach: every choice of four byte positions together with the
bytes there (70 postings a fingerprint, 32 bits each).  A pair meets in some posting list if
and only if its tally is four or more; each candidate is then verified bit by bit.

* Fingerprints are made distinct first, so copies, however many, are one entry.
* Posting lists of two are pairs outright; longer ones are reduced inside a task to a spanning
  forest of the verified links (never all pairs; the components are the same).
* Lists longer than ``LIST_ROWS`` go another exact way: within a list 32 bits are fixed, and
  two entries differ in at most four of the other 32 bits exactly if some value lies within
  two bits of both.  Each entry posts the 529 values within two bits and links to the least
  entry of every value: linear in the list, spread by value, no task holds the list.
* Components: minimum labels along links with pointer jumping until nothing changes, each
  round written to the shared checkpoint folder.

Defined cases: a null text is an empty one (fingerprint zero, linked like any other); rows
with equal texts share a fingerprint whatever their ids; repeated rows each get a row; a
component without any id has a null ``component_id``; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solera.llm.common import text_batches, text_of, written

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Longest posting list that a single task reduces; longer lists are spread over many tasks.
LIST_ROWS = 16384
_BLOCK = 1 << 15


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]).tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + _BLOCK], ends[at:at + _BLOCK])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint_column(text, shingle: int = SHINGLE):
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")
    return fp(text_of(text))


def _masks(shared: int) -> list[int]:
    """One mask for each choice of ``shared`` byte positions, as signed longs."""
    out = []
    for at in combinations(range(8), shared):
        m = sum(0xFF << (56 - 8 * p) for p in at)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _postings(nodes: DataFrame, max_bits: int) -> DataFrame:
    lists = [F.struct(F.lit(c).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
             for c, m in enumerate(_masks(8 - max_bits))]
    return nodes.select("fp", F.explode(F.array(*lists)).alias("p")).select("p.c", "p.key", "fp")


def spanning_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the entries of one posting list."""
    links, rest = [], np.sort(fps.astype(np.int64)).view(np.uint64)
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found = rest[near]
                links += [(int(x.astype(np.int64)), int(y)) for y in found.astype(np.int64)]
                stack += list(found)
                rest = rest[~near]
    return links


def links(nodes: DataFrame, max_bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs
    within ``max_bits`` bits (2 or 4: an even number has a middle)."""
    if max_bits not in (2, 4):
        raise ValueError("max_bits must be 2 or 4")
    # 70 postings a row: nodes must not be merged into a few tasks before, nor stay as dealt by "fp"
    posted = _postings(nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp")), max_bits)
    lists = written(posted.groupBy("c", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                    .filter("n > 1"), "simhash-lists")
    # the one other time that all postings are dealt out; only entries of longer lists are left
    entries = written(posted.join(lists.filter("n > 2").select("c", "key", "n").hint("merge"), ["c", "key"]), "simhash-entries")
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    two = lists.filter("n = 2").filter(apart("a", "b") <= max_bits).select("a", "b")

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forest(col: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in spanning_links(np.asarray(x), max_bits)] for x in col])

    more = (entries.filter(F.col("n") <= list_rows).groupBy("c", "key").agg(F.collect_list("fp").alias("fps"))
            .select(F.explode(forest("fps")).alias("l")).select("l.a", "l.b"))

    # entries of an over-long list, each with the values within two bits in its free bytes
    long_lists = entries.filter(F.col("n") > list_rows)
    free = F.expr("filter(transform(sequence(0, 63), i -> shiftleft(1L, i)), x -> (x & mask) = 0)")
    mask_of = F.element_at(F.array(*[F.lit(m) for m in _masks(8 - max_bits)]), F.col("c").cast("int") + 1)
    around = F.expr("concat(array(0L), free" + (", flatten(transform(free, x -> transform(filter(free, y -> y > x), y -> x | y))))" if max_bits == 4 else ")"))
    spread = (long_lists.withColumn("mask", mask_of).withColumn("free", free)
              .select("c", "key", "fp", F.explode(around).alias("flip"))
              .select("c", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z")))
    least = spread.groupBy("c", "key", "z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    far = (spread.join(least, ["c", "key", "z"]).filter("a <> fp").filter(apart("a", "fp") <= max_bits)
           .select("a", F.col("fp").alias("b")))
    return two.unionByName(more).unionByName(far).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex reachable from every vertex of ``edges`` (a, b)."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("root")), "cc-labels")
    while True:
        near = (both.join(label.select(F.col("v").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near")))
        step = (label.join(near, "v").select("v", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        jump = label.select(F.col("v").alias("root"), F.col("root").alias("further"))
        moved = step.join(jump, "root").select("v", "was", F.least("root", "further").alias("root"))
        label = written(moved, "cc-labels")
        if label.filter("was <> root").limit(1).count() == 0:
            return label.select("v", "root")


def _classes(docs: DataFrame, shingle: int, max_bits: int, list_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (fp, root, first) of every fingerprint: its
    component's least fingerprint and its own first row by id (rows without one last)."""
    text_batches(docs.sparkSession)
    rows = written(docs.select("doc_id", F.xxhash64(text_of(F.col("text"))).alias("text_hash"),
                               fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    nodes = rows.groupBy("fp").agg(first)
    root = components(links(nodes.select("fp"), max_bits, list_rows))
    nodes = nodes.join(root.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rows, written(nodes, "simhash-nodes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id."""
    rows, nodes = _classes(docs, shingle, max_bits, list_rows)
    least = nodes.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    member = nodes.join(least, "root").select("fp", "component_id")
    return rows.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (a row without an
    id only where the component has none); columns unchanged."""
    _, nodes = _classes(docs, shingle, max_bits, list_rows)
    keep = (nodes.groupBy("root").agg(F.min("first").alias("first"))
            .select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash")))
    hashed = docs.withColumn("__text", F.xxhash64(text_of(F.col("text"))))
    kept = hashed.join(keep, hashed["doc_id"].eqNullSafe(keep["__id"]) & (hashed["__text"] == keep["__hash"]), "left_semi")
    same = Window.partitionBy("doc_id", "__text").orderBy("__text")
    return kept.withColumn("__nth", F.row_number().over(same)).filter("__nth = 1").select(*docs.columns)
