"""Quality rules: base rules and a hashed n-gram log-likelihood ratio (operator 3, DataFrame
functions only).

Words and word pairs are hashed into ``BUCKETS`` buckets, as many at every size of the corpus, so
that no size of it changes how a document is judged.  Two multinomials over the buckets are
counted: the raw corpus (every document) and the trusted target (all documents that ``labels``
marks with quality 1).  A bucket's ratio is log(target / raw), its target count smoothed by
``PRIOR`` occurrences that are trusted as often as the corpus is: a bucket that is hardly seen
says little, and what an empty bucket would weigh does not matter.  A document's score is the mean
over its n-grams, so that length does not matter; it is kept if no base rule fails and the score
reaches ``THRESHOLD``.  The ratios are rounded to 1/10000, so sums are exact and every run decides
alike.

The corpus is scanned for counting and for scoring, and the text is shuffled at most once, to join
the trusted ids (64 to a row, a bit each) when Spark finds them too many to broadcast: counts are combined per task, at
most one row a bucket.  For scoring the ratios are one array of ``BUCKETS`` numbers, sent to the
tasks once; each word brings its own bucket and that of the pair it begins in one entry, which
looks both up; entries are summed by hash before anything is shuffled, to one row a document and
task, with the rule's counts two to a long.

Defined cases: a null text has no words; a document without n-grams has score 0 (and fails the
base rules); labels that conflict are not trusted; without trusted documents every score is 0; a
null id is never trusted; repeated rows each count and each get a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solera.llm.common import text_of, words_of, written

#: Buckets of the hash space, which bounds the broadcast.
BUCKETS = 1 << 20
#: Occurrences of every bucket that are taken as trusted as often as the corpus is.
PRIOR = 20.0
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.2
SCALE = 10000

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = r"[#*$%&|<>]"
_WORD_IN = r"[^\x20\x09-\x0D]"


def _hashed(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """``wh``: the hashes of the words of the text."""
    return docs.select(*keep, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"))


def _grams(buckets: int) -> str:
    """Buckets of the words and word pairs of ``wh``."""
    return (f"concat(transform(wh, h -> pmod(h, {buckets})), if(size(wh) < 2, array(),"
            f" transform(sequence(0, size(wh) - 2), i -> pmod(xxhash64(wh[i], wh[i + 1]), {buckets}))))")


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(bucket, ratio): log(target / raw) of every bucket that the corpus has, in units of
    1 / SCALE; zeros without trusted documents."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    # 64 neighbouring ids a row, one bit each; written, so that Spark knows its size and broadcasts it as long as it is small
    block, bit = F.expr("shiftright(doc_id, 6)"), F.expr("shiftleft(1L, int(doc_id & 63))")
    good = written(good.select(block.alias("block"), bit.alias("bit")).groupBy("block").agg(F.bit_or("bit").alias("trusted")), "quality-trusted")
    d = docs.select("doc_id", "text", block.alias("block")).join(good, "block", "left")
    d = d.withColumn("is_trusted", F.coalesce((F.col("trusted").bitwiseAND(bit) != 0).cast("long"), F.lit(0).cast("long")))
    grams = _hashed(d, "is_trusted").select("is_trusted", F.explode(F.expr(_grams(buckets))).alias("bucket"))
    counts = written(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("is_trusted").alias("target")), "quality-counts")
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    share = (target or 0) / (raw or 1)
    smoothed = (F.col("target") + F.lit(prior * share)) / ((F.col("raw") + F.lit(prior)) * F.lit(share))
    ratio = F.round(F.log(smoothed) * SCALE) if target else F.lit(0)
    return counts.select("bucket", ratio.cast("int").alias("ratio"))


def _base(d: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words from text and wh."""
    text = text_of(F.col("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD_IN))
    d = d.withColumn("lines", lines)
    runs = ", ".join(f"wh[i + {k}]" if k else "wh[i]" for k in range(WINDOW))
    d = d.withColumn("win", F.expr(f"if(size(wh) < {WINDOW}, array(), transform(sequence(0, size(wh) - {WINDOW}), i -> xxhash64({runs})))"))
    # windows found twice: next to an equal one in order of hash; only texts that have some are sorted
    d = d.withColumn("srt", F.expr("if(size(array_distinct(win)) = size(win), null, sort_array(transform(win, (h, i) -> struct(h, i))))"))
    d = d.withColumn("twice", F.expr(
        "sort_array(filter(transform(srt, (x, k) -> if((k > 0 and srt[greatest(k - 1, 0)].h = x.h) or"
        " (k < size(srt) - 1 and srt[least(k + 1, size(srt) - 1)].h = x.h), x.i, null)), p -> p is not null))"))
    covered = F.expr(f"aggregate(twice, named_struct('p', -{WINDOW}, 'n', 0L),"
                     f" (a, p) -> named_struct('p', p, 'n', a.n + least({WINDOW}, p - a.p)), a -> a.n)")
    return (d.withColumn("n_words", F.size("wh").cast("long"))
            .withColumn("word_chars", F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"))
            .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
            .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")))


def _packed(high: str | Column, low: str | Column) -> Column:
    """Two counts of 31 bits in a long."""
    return F.shiftleft(high, 32).bitwiseOR(F.col(low) if isinstance(low, str) else low)


def _high(c: str | Column) -> Column:
    return F.shiftright(c, 32)


def _low(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit((1 << 32) - 1))


def _table(ratios: DataFrame, buckets: int) -> Column:
    """The ratios as one array, that of a bucket at its number + 1, and 0 at 0 for no n-gram; as
    large at every size of the corpus."""
    every = ratios.sparkSession.range(-1, buckets).join(ratios, F.col("id") == F.col("bucket"), "left")
    every = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("ratio", F.lit(0)).alias("ratio")))).alias("all"))
    return every.select(F.transform("all", lambda x: x["ratio"])).scalar()


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, **kw) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, score."""
    table = _table(log_ratios(docs, labels, buckets, **kw), buckets)
    # a word and the pair that it begins make one entry; rows of one key are alike
    grams = (f"transform(wh, (h, i) -> pmod(h, {buckets}) + 1"
             f" + if(i + 1 < size(wh), shiftleft(pmod(xxhash64(h, wh[i + 1]), {buckets}) + 1, 32), 0L))")
    d = _base(_hashed(docs, "doc_id", "text")).select(
        F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()).alias("key"), "doc_id", _packed("n_words", "word_chars").alias("a"),
        _packed("n_symbols", "n_dup_lines").alias("b"), F.col("n_repeat_words").alias("c"), F.expr(grams).alias("grams"))
    d = d.select("key", "doc_id", "a", "b", "c", F.posexplode_outer("grams").alias("nth", "gram"))
    ratio = F.get(table, _low("gram").cast("int")) + F.get(table, _high("gram").cast("int"))
    d = d.groupBy("key").agg(*[F.max(c).alias(c) for c in ("doc_id", "a", "b", "c")], F.count_if(F.coalesce("nth", F.lit(0)) == 0).cast("int").alias("rows"),
                             F.sum(ratio).alias("total"))
    d = d.select("doc_id", _high("a").alias("n_words"), _low("a").alias("word_chars"), _high("b").alias("n_symbols"), _low("b").alias("n_dup_lines"),
                 F.col("c").alias("n_repeat_words"), "rows", "total")
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    n_grams = F.col("rows") * (2 * F.col("n_words") - 1)
    d = d.withColumn("score", F.when(F.col("n_words") > 0, F.col("total") / n_grams / SCALE).otherwise(0.0))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return d.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
