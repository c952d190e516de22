"""Sharding by balanced label propagation (operator 5, DataFrame functions only).

Nodes are the distinct texts (equal texts are one node, however many); a line that several of
them share links them.  The links are kept as edges (text, line), never as pairs.  Labels
start from the text hash.  In each round every line tallies the shards of its texts, every text
sums the shares of its lines, weighted by their words, and wants the shard where most of its
links lie.  Moves from a to b are allowed up to a quota: the bytes that want to go from b to a,
and a share of the room that b has below ``SLACK`` times the mean; the greatest gains move first.
Each round is written to the shared checkpoint folder.

At the end all rows are laid out in the order of their label, texts without links at both ends
of a label, equal texts side by side, and cut into shards of equal bytes: sizes differ by about
one row, and only what lies at a cut can lose its links.

A line or text may be held by any share of the rows: tallies are combined before the shuffle, a
frequent line is spread over several copies of its tally (``PART`` texts each), a large group of
copies over chunks of ``CHUNK`` rows.

Defined cases: a null text is an empty one (size 1); rows with the same id each get a slot; a
null id comes first among equal texts; fewer rows than shards leave shards empty; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solera.llm.common import line_words, text_of, written

SHARDS = 8
ROUNDS = 4
SLACK = 1.02
#: Lines of fewer words are no link; a line counts its words up to MOST_WORDS.
LEAST_WORDS, MOST_WORDS = 4, 64
PART = 4096
CHUNK = 5000


def _rows(docs: DataFrame) -> DataFrame:
    text = text_of(F.col("text"))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64(text).alias("node"))


def _edges(docs: DataFrame) -> DataFrame:
    """(node, line, w, part): the lines that at least two distinct texts share; a line's edges
    are dealt into parts of about PART."""
    lines = F.transform(F.array_distinct(F.split(text_of(F.col("text")), "\n", -1)),
                        lambda x: F.struct(F.xxhash64(x).alias("line"), F.least(line_words(x), F.lit(MOST_WORDS)).alias("w")))
    held = (docs.select(F.xxhash64(text_of(F.col("text"))).alias("node"), F.explode(F.filter(lines, lambda x: x["w"] >= LEAST_WORDS)).alias("l"))
            .select("node", "l.line", "l.w").distinct())
    held = written(held, "shard-lines")
    degree = held.groupBy("line").agg(F.count("*").alias("degree")).filter("degree > 1")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("degree") / PART))
    return written(held.join(degree, "line").select("node", "line", "w", "degree", part.alias("part")), "shard-edges")


def _round(nodes: DataFrame, edges: DataFrame, shards: int, slack: float) -> DataFrame:
    """Labels after one round of moves within quotas: (node, size, label)."""
    labelled = edges.join(nodes.select("node", "label"), "node")
    here = [F.sum((F.col("label") == k).cast("long")) for k in range(shards)]
    tally = labelled.groupBy("line", "degree").agg(*[h.alias(f"n{k}") for k, h in enumerate(here)])
    tally = tally.select("line", F.array(*[f"n{k}" for k in range(shards)]).alias("n"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("degree") / PART) - 1)).alias("part"))
    seen = labelled.join(tally, ["line", "part"])
    votes = [F.sum((F.col("w") * 1000 * (F.col("n")[k] - (F.col("label") == k).cast("long")) / (F.col("degree") - 1)).cast("long")) for k in range(shards)]
    asked = seen.groupBy("node").agg(*[v.alias(f"v{k}") for k, v in enumerate(votes)])
    # the most votes; of equals the least shard
    best = F.array_max(F.array(*[F.struct(F.col(f"v{k}").alias("v"), F.lit(-k).alias("k")) for k in range(shards)]))
    asked = asked.select("node", F.array(*[f"v{k}" for k in range(shards)]).alias("v"), best.alias("best"))
    moves = nodes.join(asked, "node").select("node", "size", "label", (-F.col("best.k")).alias("to"),
                                             (F.col("best.v") - F.element_at("v", F.col("label") + 1)).alias("gain")).filter("gain > 0")
    moves = moves.withColumn("band", F.floor(F.log2(F.col("gain")) * 2).cast("int"))
    # shards * shards * bands rows from here: quota, and where in the order of gain it ends
    asks = moves.groupBy("label", "to", "band").agg(F.sum("size").alias("bytes"))
    pair = asks.groupBy("label", "to").agg(F.sum("bytes").alias("all"))
    back = pair.select(F.col("to").alias("label"), F.col("label").alias("to"), F.col("all").alias("back"))
    full = nodes.groupBy("label").agg(F.sum("size").alias("full")).withColumn("mean", F.sum("full").over(Window.partitionBy()) / shards)
    room = full.select(F.col("label").alias("to"), (F.greatest(F.lit(0.0), slack * F.col("mean") - F.col("full")) / max(1, shards - 1)).alias("room"))
    quota = (pair.join(back, ["label", "to"], "left").join(room, "to", "left")
             .select("label", "to", (F.least("all", F.coalesce("back", F.lit(0))) + F.coalesce("room", F.lit(0.0))).alias("quota")))
    above = Window.partitionBy("label", "to").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    goes = (asks.withColumn("above", F.coalesce(F.sum("bytes").over(above), F.lit(0))).join(quota, ["label", "to"])
            .select("label", "to", "band", ((F.col("quota") - F.col("above")) / F.col("bytes")).alias("share")))
    lot = F.pmod(F.xxhash64(F.lit("lot"), F.col("node")), F.lit(1 << 20)) / float(1 << 20)
    moved = moves.join(goes, ["label", "to", "band"]).filter(lot < F.col("share")).select("node", F.col("to").alias("new"))
    return nodes.join(moved, "node", "left").select("node", "size", "n", F.coalesce("new", "label").alias("label"))


def propagate(docs: DataFrame, rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """(node, size, n, label) after the rounds, and the edges."""
    edges = _edges(docs)
    nodes = rows.groupBy("node").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    nodes = written(nodes.withColumn("label", F.pmod("node", F.lit(shards)).cast("int")), "shard-nodes")
    for _ in range(rounds):
        nodes = written(_round(nodes, edges, shards, slack), "shard-nodes")
    return nodes, edges


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law (``bytes``),
    shard, slot, grown_shard (null)."""
    rows = written(_rows(docs), "shard-rows")
    nodes, edges = propagate(docs, rows, shards, rounds, slack)
    linked = edges.select("node").distinct().withColumn("linked", F.lit(True))
    count = rows.count()
    buckets = max(1, -(-count // (CHUNK * shards * 3)))
    half = F.when(F.pmod(F.xxhash64("node"), F.lit(2)) == 0, 0).otherwise(2)
    place = (nodes.join(linked, "node", "left")
             .select("node", "label", F.when(F.coalesce("linked", F.lit(False)) | (F.col("n") > 1), 1).otherwise(half).alias("side"),
                     F.pmod(F.xxhash64(F.lit("bucket"), F.col("node")), F.lit(buckets)).alias("bucket"),
                     F.when(F.col("n") > CHUNK, F.col("node")).alias("large"), F.ceil(F.col("n") / CHUNK).alias("parts")))
    laid = rows.join(place, "node").withColumn("part", F.when(F.col("large").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(0))
    chunk = ["label", "side", "bucket", "large", "part"]
    laid = written(laid.withColumn("large", F.coalesce("large", F.lit(-(1 << 63)))).drop("parts"), "shard-laid")
    sums = laid.groupBy(*chunk).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # running sums over the chunks of a label, and over the labels
    within = Window.partitionBy("label").orderBy(*chunk[1:]).rowsBetween(Window.unboundedPreceding, -1)
    labels = sums.groupBy("label").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    earlier = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    labels = labels.select("label", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("b0"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("r0"),
                           F.sum("bytes").over(Window.partitionBy()).alias("total"))
    sums = (sums.select(*chunk, F.coalesce(F.sum("bytes").over(within), F.lit(0)).alias("b1"), F.coalesce(F.sum("rows").over(within), F.lit(0)).alias("r1"))
            .join(labels, "label").select(*chunk, (F.col("b0") + F.col("b1")).alias("b"), (F.col("r0") + F.col("r1")).alias("r"), "total"))
    row = Window.partitionBy(*chunk).orderBy("node", "doc_id")
    laid = laid.join(sums, chunk)
    before = F.col("b") + F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    laid = laid.withColumn("before", before).withColumn("at", F.col("r") + F.row_number().over(row) - 1)
    cut = F.expr(f"int(least({shards - 1}, ((2 * before + size) * {shards}) div (2 * total)))")
    laid = written(laid.select("doc_id", "size", "text_crc32", cut.alias("shard"), "at"), "shard-cut")
    first = laid.groupBy("shard").agg(F.min("at").alias("first"))  # one row a shard
    return (laid.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
