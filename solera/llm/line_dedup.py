"""Line dedup by winnowing over line hashes (operator 4, DataFrame functions only).

Lines are the pieces between ``\\n``; lines without a word take no part and always stay.  The
window that starts at a line runs to the first line at which ``min_words`` words are
complete; of each window the line with the least hash is the document's fingerprint there
(the first of equals).  Any run of lines that two places share and that holds ``min_words``
words contains a whole window in both places, so both select the same fingerprint: no such run
is missed.  Then:

1. *Join positions*: fingerprints selected at two or more positions of the corpus.
2. *Extend both ways* from each such anchor: to the right by the windows that start at every
   line of the match, to the left and to the end of the match by the windows that end at every
   line (the shortest that hold ``min_words`` words).  Together these windows cover a shared
   run line by line from its first to its last line, and nothing beyond it, so a maximal match
   is the union of its windows that occurred earlier.  Comparing a window with the first
   occurrence of the same window (a minimum, combined before the shuffle) lists no pairs,
   however many documents share a passage, and finds the earlier copy in whichever document
   it stands.
3. *Delete later repeats*: a line goes if it lies in a window that occurred earlier, in the
   order of (doc_id, line).  What is deleted always stands earlier in full; in a run that
   repeats within itself, the first period stays.

Windows are compared by 128 bits of hash.  Everything is linear in the number of lines.

Defined cases: a null text stays null; a document without words stays as it is; a document
whose words all go keeps its blank lines and has ``n_removed`` = ``n_lines``; rows with the
same id and text are one document and share one fate; rows with the same id but other text are
documents of their own, ordered by text hash; a null id comes first; an empty table gives an
empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solera.llm.common import line_words, text_of, written

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text_of(text), "\n", -1)


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_hash and the windows of every document: i, j (positions from 1 among its
    lines with words), s, t (two hashes of those lines) and f, p (the fingerprint selected in
    the window that starts at i, and its position).  A window has ``min_words`` lines at most."""
    worded = F.filter(F.transform(_lines(F.col("text")), lambda x: F.struct(x.alias("l"), line_words(x).alias("n"))), lambda x: x["n"] > 0)
    d = (docs.select("doc_id", F.xxhash64(text_of(F.col("text"))).alias("text_hash"), worded.alias("lines"))
         .filter(F.expr(f"aggregate(lines, 0L, (a, x) -> a + x.n) >= {min_words}"))
         .select("doc_id", "text_hash", F.transform("lines", lambda x: F.xxhash64(x["l"])).alias("h"),
                 F.transform("lines", lambda x: F.xxhash64(F.lit(7), x["l"])).alias("g"),
                 F.transform("lines", lambda x: x["n"]).alias("n")))
    # lines needed, from the first on, to complete the words; null if there are too few
    needed = (f"(aggregate({{}}, named_struct('w', 0, 'k', 0), (a, x) -> if(a.w >= {min_words}, a, named_struct('w', a.w + x, 'k', a.k + 1)),"
              f" a -> if(a.w >= {min_words}, a.k, null)))")
    starts = f"transform(sequence(1, size(n)), i -> {needed.format(f'slice(n, i, {min_words})')})"
    ends = (f"transform(sequence(1, size(n)), j -> {needed.format(f'reverse(slice(n, greatest(1, j - {min_words - 1}), least(j, {min_words})))')})")
    d = d.withColumn("fwd", F.expr(starts)).withColumn("bwd", F.expr(ends))
    pairs = F.expr("array_distinct(filter(concat(transform(fwd, (k, x) -> struct(x + 1 as i, x + k as j)),"
                   " transform(bwd, (k, x) -> struct(x + 2 - k as i, x + 1 as j))), w -> w.i is not null and w.j is not null))")
    d = d.withColumn("w", F.explode(pairs)).withColumn("own", F.expr("slice(h, w.i, element_at(fwd, w.i))"))
    return d.select("doc_id", "text_hash", "w.i", "w.j",
                    F.expr("xxhash64(slice(h, w.i, w.j - w.i + 1))").alias("s"), F.expr("xxhash64(slice(g, w.i, w.j - w.i + 1))").alias("t"),
                    F.array_min("own").alias("f"), F.expr("int(w.i + array_position(own, array_min(own)) - 1)").alias("p"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, i, j): the windows of lines whose like occurred earlier in the corpus."""
    windows = written(_windows(docs, min_words), "line-windows")
    place = lambda at: F.struct(F.col("doc_id"), F.col("text_hash"), F.col(at).alias("at"))
    joined = (windows.groupBy("f").agg(F.min(place("p")).alias("a"), F.max(place("p")).alias("z"))
              .filter("a <> z").select("f"))
    anchored = written(windows.join(joined, "f", "left_semi").select("doc_id", "text_hash", "i", "j", "s", "t"), "line-anchored")
    first = (anchored.groupBy("s", "t").agg(F.min(place("i")).alias("first"), F.max(place("i")).alias("last"))
             .filter("first <> last").select("s", "t", "first"))
    return anchored.join(first, ["s", "t"]).filter(place("i") > F.col("first")).select("doc_id", "text_hash", "i", "j")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the text left of every document, and two columns more:
    ``n_lines`` (its lines with a word) and ``n_removed`` (those deleted), in the place of any columns
    of these names."""
    docs = docs.drop("n_lines", "n_removed")
    runs = (repeated_runs(docs, min_words).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("i", "j")).alias("__runs"))
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__runs"))
    d = docs.withColumn("__text", F.xxhash64(text_of(F.col("text"))))
    d = d.join(runs, d["doc_id"].eqNullSafe(runs["__id"]) & (d["__text"] == runs["__hash"]), "left").withColumn("__lines", _lines(F.col("text")))
    worded = F.filter(F.transform("__lines", lambda x, k: F.when(line_words(x) > 0, k + 1)), lambda k: k.isNotNull())
    gone = F.expr("array_distinct(flatten(transform(__runs, r -> slice(__at, r.i, r.j - r.i + 1))))")
    left = F.expr("array_join(transform(array_except(sequence(1, size(__lines)), __gone), k -> element_at(__lines, k)), '\n')")
    return (d.withColumn("__at", worded).withColumn("__gone", gone)
            .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
            .withColumn("n_lines", F.size("__at").cast("long"))
            .withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
            .select(*docs.columns, "n_lines", "n_removed"))


SQL = rf"""
WITH raw_lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS raw, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
worded AS (
  SELECT doc_id, raw, line, w, row_number() OVER d AS p, sum(w) OVER d AS c
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw_lines) WHERE w > 0
  WINDOW d AS (PARTITION BY doc_id ORDER BY raw)),
span AS (
  SELECT a.doc_id, a.p AS i, b.p AS j FROM worded a JOIN worded b
  ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {MIN_WORDS - 1} AND b.c - (a.c - a.w) >= {MIN_WORDS}),
win AS (
  SELECT doc_id, i, min(j) AS j FROM span GROUP BY doc_id, i
  UNION SELECT doc_id, max(i) AS i, j FROM span GROUP BY doc_id, j),
seg AS (
  SELECT win.doc_id, i, j, string_agg(line, chr(10) ORDER BY p) AS s
  FROM win JOIN worded ON worded.doc_id = win.doc_id AND p BETWEEN i AND j GROUP BY win.doc_id, i, j),
ranked AS (SELECT *, rank() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM seg),
gone AS (
  SELECT DISTINCT worded.doc_id, raw FROM ranked JOIN worded
  ON ranked.doc_id = worded.doc_id AND p BETWEEN i AND j WHERE r > 1),
counts AS (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.raw) FILTER (WHERE g.raw IS NULL), '') END AS text,
  coalesce(any_value(c.n_lines), 0) AS n_lines, count(g.raw) AS n_removed
FROM documents d JOIN raw_lines l ON l.doc_id = d.doc_id
LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.raw = l.raw LEFT JOIN counts c ON c.doc_id = d.doc_id
GROUP BY d.doc_id, d.text
"""
