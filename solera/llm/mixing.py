"""Mixing sources to target weights by Pareto order sampling (operator 1).

*Targets.*  The sources in code point order (null last) take the weights in turn; together they
share ``share`` times all words, none above ``most`` times its own.  Resharing the excess by
weight until none is above ends at target = min(most * size, level * weight) with one level
for all; sorted by size / weight, the level is the largest of (budget left) / (weights left)
over the prefixes of capped sources, so no loop is needed.

*Inclusion.*  Within a source a document's expected copies are its own weight times a level,
``most`` at the most (found the same way): weight 64 less the bit length of its size (16 at the
most), so that short documents, which place the total finely, are a little more likely than the
few very long ones.  The whole part is taken for certain, the rest is the inclusion probability
p of the Pareto sample.

*Order.*  A document's rank is odds(u) / odds(p), u uniform from a hash of the id: the sample
is the front of the ranking, and its size is fixed in words: as many as the certain copies
leave of the target.  The front ends at the last document that fits; two more passes over the
rest of the ranking fill what gap is left with the next documents that fit into it, and one
document more is drawn where that ends nearer to the target.

A source may hold any share of the rows: ranks are cut into chunks of about ``CHUNK`` rows by
value, running sums go over the chunk totals of a source, and then within each chunk.

Defined cases: a null text has no words; documents without words are taken 0 times; a null
source is a source of its own, the last; ids only feed the hash (null counts as ``null``), ties
are ordered by (id, size), and rows equal in both are interchangeable; a table without words
gives targets of 0; other columns are kept by ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solera.llm.common import n_words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
PASSES = 3
SEED = "mix"
#: Expected rows of a chunk of a source's ranking.
CHUNK = 2000


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from a hash of the seed and the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size); one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), nth.cast("int") + 1))
    s = s.withColumn("reach", F.col("source_size").cast("double") / F.col("weight"))
    order = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.max("level").over(every) * F.col("weight"))
    return s.select("source", "source_size", "n", target.alias("target"))


def _band(size: Column) -> Column:
    """The document's own weight: 64 less the bit length of its size, 16 at the most."""
    return F.lit(64).cast("long") - F.least(F.length(F.bin(size)), F.lit(16))


def _levels(sized: DataFrame, most: int) -> DataFrame:
    """(sid, level, mean_p): the expected copies of a document are least(most, level * its own
    weight); the mean of what they leave over whole copies, where they leave any."""
    bands = (sized.filter("size > 0").groupBy("sid", "target", "own").agg(F.sum("size").alias("b"), F.count("*").alias("k")))
    order = Window.partitionBy("sid").orderBy(F.desc("own"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("b").over(before), F.lit(0))
    bands = bands.withColumn("left", left / F.sum(F.col("own") * F.col("b")).over(after))
    bands = bands.withColumn("level", F.max("left").over(Window.partitionBy("sid")))
    p = _copies(most) - F.floor(_copies(most))
    bands = bands.withColumn("p", p)
    return (bands.groupBy("sid").agg(F.max("level").alias("level"), (F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("k"))) /
                                     F.sum(F.when(F.col("p") > 0, F.col("k")))).alias("mean_p")))


def _copies(most: int) -> Column:
    return F.least(F.lit(float(most)), F.col("level") * F.col("own"))


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _by_chunk(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """A table of one row per source spread over the chunks of each, so that rows join it by chunk
    and are never dealt out by source alone."""
    return rows.select("sid", "chunk").distinct().join(per_source, "sid")


def _pass(rows: DataFrame) -> DataFrame:
    """Draw the front of each source's ranking that fits into what its target still lacks, among
    the documents not drawn yet that fit at all."""
    used = F.sum(F.col("size") * (F.col("certain") + F.col("drawn").cast("long")))
    gap = rows.groupBy("sid").agg((F.first("target") - used).alias("gap"))
    rows = rows.join(_by_chunk(rows, gap), ["sid", "chunk"]).withColumn("fits", F.col("rank").isNotNull() & ~F.col("drawn") & (F.col("size") <= F.col("gap")))
    rows = rows.withColumn("adds", F.when(F.col("fits"), F.col("size")).otherwise(F.lit(0).cast("long")))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (rows.groupBy("sid", "chunk").agg(F.sum("adds").alias("words"))
              .select("sid", "chunk", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")))
    within = Window.partitionBy("sid", "chunk").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(chunks, ["sid", "chunk"]).withColumn("total", F.col("before") + F.sum("adds").over(within))
    return (rows.withColumn("drawn", F.col("drawn") | (F.col("fits") & (F.col("total") <= F.col("gap"))))
            .drop("gap", "fits", "adds", "before", "total"))


def _nearest(rows: DataFrame) -> DataFrame:
    """Draw one document more in each source whose total ends nearer to the target with it."""
    used = F.sum(F.col("size") * (F.col("certain") + F.col("drawn").cast("long")))
    gap = rows.groupBy("sid").agg((F.first("target") - used).alias("gap"))
    rows = rows.join(_by_chunk(rows, gap), ["sid", "chunk"]).withColumn("off", F.abs(F.col("size") - F.col("gap")))
    open_ = F.col("rank").isNotNull() & ~F.col("drawn") & (F.col("off") < F.col("gap"))
    best = rows.filter(open_).groupBy("sid").agg(F.min(F.struct("off", "rank", "doc_id", "size")).alias("best"))
    same = Window.partitionBy("sid", "chunk", "doc_id", "size").orderBy("rank")  # one of equal rows
    is_best = open_ & (F.struct("off", "rank", "doc_id", "size") == F.col("best"))
    rows = rows.join(_by_chunk(rows, best), ["sid", "chunk"], "left").withColumn("nth", F.row_number().over(same))
    return rows.withColumn("drawn", F.col("drawn") | F.coalesce(is_best & (F.col("nth") == 1), F.lit(False))).drop("gap", "off", "best", "nth")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, passes: int = PASSES, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size,
    target, certain (whole copies), p (inclusion probability), copies, taken (words)."""
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    goal = targets(sizes, weights, share, most)
    goal = written(goal.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), "mix-targets")
    goal = goal.withColumnRenamed("source", "of")
    sized = sizes.join(goal, sizes["source"].eqNullSafe(goal["of"])).drop("of").withColumn("own", _band(F.col("size")))
    rows = sized.join(_levels(sized, most), "sid", "left")
    rows = (rows.withColumn("expected", F.when(F.col("size") > 0, _copies(most)).otherwise(0.0))
            .withColumn("certain", F.floor("expected")).withColumn("p", F.col("expected") - F.col("certain"))
            .withColumn("u", uniform(F.col("doc_id"), seed))
            .withColumn("rank", F.when(F.col("p") > 0, _odds(F.col("u")) / _odds(F.col("p")))))
    # about equal chunks in the order of rank: as if each had the source's mean odds
    v = F.col("rank") * _odds(F.col("mean_p"))
    part = F.coalesce(F.when(F.col("rank").isNotNull(), v / (1 + v)), F.col("u"))
    rows = rows.withColumn("chunk", F.floor(part * F.ceil(F.col("n") / F.lit(CHUNK))))
    rows = written(rows.select("doc_id", "source", "sid", "size", "source_size", "target", "certain", "p", "rank", "chunk",
                               F.lit(False).alias("drawn")), "mix-ranked")
    for _ in range(passes):
        rows = written(_pass(rows), "mix-drawn")
    rows = _nearest(rows)
    copies = F.col("certain") + F.col("drawn").cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "certain", "p", copies.alias("copies"),
                       (F.col("size") * copies).alias("taken"))


def take(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    drawn = mix(docs, **kw)
    # rows equal in id and size are interchangeable: the most of them get a row's copies
    drawn = (drawn.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies")
             .groupBy("__id", "__source", "__size").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")))
    d = docs.withColumn("__words", n_words(F.col("text")))
    d = d.join(drawn, d["doc_id"].eqNullSafe(drawn["__id"]) & d["source"].eqNullSafe(drawn["__source"]) & (d["__words"] == drawn["__size"]))
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "__words").orderBy(F.xxhash64("text")))
    d = d.withColumn("__n", F.floor(F.col("__copies") / F.col("__rows")) + (nth <= F.col("__copies") % F.col("__rows")).cast("long"))
    return d.filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*docs.columns)


def _sql() -> str:
    out = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
src AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::BIGINT AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
lev AS (
  SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE
    - {MOST}::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM src),
goal AS (SELECT source, source_size, least({MOST}::DOUBLE * source_size::DOUBLE, (max(level) OVER ()) * weight::DOUBLE) AS target FROM lev),
own AS (
  SELECT s.*, g.source_size, g.target, 64 - least(length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END), 16) AS own
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
band AS (SELECT source, target, own, sum(size)::BIGINT AS b FROM own WHERE size > 0 GROUP BY source, target, own),
blev AS (
  SELECT source, max((target - {MOST}::DOUBLE * coalesce(before, 0)::DOUBLE) / after::DOUBLE) AS level FROM (
    SELECT *, sum(b) OVER (PARTITION BY source ORDER BY own DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      sum(own * b) OVER (PARTITION BY source ORDER BY own DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM band) GROUP BY source),
ex AS (
  SELECT o.*, CASE WHEN size > 0 THEN least({MOST}::DOUBLE, level * own::DOUBLE) ELSE 0::DOUBLE END AS e,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
  FROM own o LEFT JOIN blev l ON o.source IS NOT DISTINCT FROM l.source),
r0 AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1::DOUBLE - u)) / (p / (1::DOUBLE - p)) END AS rank, false AS drawn
  FROM (SELECT *, floor(e)::BIGINT AS certain, e - floor(e) AS p FROM ex))"""
    for k in range(PASSES):
        out += f""",
g{k} AS (SELECT source, any_value(target) - sum(size * (certain + drawn::BIGINT))::DOUBLE AS gap FROM r{k} GROUP BY source),
f{k} AS (
  SELECT r.*, gap, (rank IS NOT NULL AND NOT drawn AND size::DOUBLE <= gap) AS fits
  FROM r{k} r JOIN g{k} g ON r.source IS NOT DISTINCT FROM g.source),
r{k + 1} AS (
  SELECT * EXCLUDE (gap, fits, drawn, total), drawn OR (fits AND total::DOUBLE <= gap) AS drawn FROM (
    SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM f{k}))"""
    return out + f""",
near AS (SELECT source, any_value(target) - sum(size * (certain + drawn::BIGINT))::DOUBLE AS gap FROM r{PASSES} GROUP BY source),
one AS (
  SELECT doc_id FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY r.source ORDER BY abs(size::DOUBLE - gap), rank, doc_id, size) AS nth
    FROM r{PASSES} r JOIN near n ON r.source IS NOT DISTINCT FROM n.source
    WHERE rank IS NOT NULL AND NOT drawn AND abs(size::DOUBLE - gap) < gap) WHERE nth = 1),
final AS (SELECT * EXCLUDE (drawn), drawn OR doc_id IN (SELECT doc_id FROM one) AS drawn FROM r{PASSES})
SELECT doc_id, source, size, source_size, target, certain + drawn::BIGINT AS copies, size * (certain + drawn::BIGINT) AS taken FROM final"""


SQL = _sql()
