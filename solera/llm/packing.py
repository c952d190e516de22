"""Variable-capacity best-fit packing of documents into training sequences (operator 7).

Sequences may have any of several permitted lengths, each with a cost.  A document longer than
the greatest length is cut into pieces of that length and a rest; nothing is dropped.  Pieces
are taken longest first and go into the open sequence that they fill best (the least room that
still holds them), whatever its length.  If none has room a new sequence is opened, of the
length that costs least for each word it can be expected to hold: itself and the pieces still
to come, as many as fit.  At the end every sequence shrinks to the shortest permitted length
that holds its contents.

The cost of a length is an overhead per sequence, its words, and a share quadratic in them
(attention), so the lengths compete: short ones waste overhead, long ones attention.

Pieces are dealt by a hash into groups of about ``GROUP`` pieces, packed independently: a group
is a bounded task at any size, and wastes at most its last open sequences.  Documents are not
kept together by source or key, so no key can be hot; equal rows are counted first and then
dealt one by one.

Defined cases: a null text or one without words has one row with 0 words and no sequence;
repeated rows are told apart by ``copy``; a null id is an id like any other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solera.llm.common import n_words, written

#: Permitted lengths, in words.
LENGTHS = (512, 2048, 8192)
OVERHEAD = 64
QUADRATIC = 65536
#: Pieces of a group, on average.
GROUP = 20000


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / QUADRATIC


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces sorted from long to short, none longer than the greatest length: the sequence
    (from 0) and the offset of each piece, and the final length of each sequence."""
    lengths = sorted(lengths)
    costs = [cost(x) for x in lengths]
    rest = int(np.sum(sizes, dtype=np.int64))
    by_room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    rooms = 0  # bit r is set if a sequence with room r is open
    at, offset, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for k, size in enumerate(map(int, sizes)):
        rest -= size
        if above := rooms >> size:
            room = size + (above & -above).bit_length() - 1
            seq = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((c / min(x, size + rest), x) for c, x in zip(costs, lengths) if x >= size)[1]
            seq = len(used)
            used.append(0)
        at[k], offset[k] = seq, used[seq]
        used[seq] += size
        by_room[room - size].append(seq)
        rooms |= 1 << (room - size)
    final = np.asarray(lengths)[np.searchsorted(lengths, used)] if used else np.empty(0, np.int64)
    return at, offset, final


def pieces(docs: DataFrame, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """(doc_id, copy, piece, start, words): every document cut at the greatest length."""
    most = max(lengths)
    rows = docs.select("doc_id", n_words(F.col("text")).alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("rows"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.select("doc_id", "copy", "piece", (F.col("piece") * most).alias("start"),
                       F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("words"))


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, copy, piece, start, words, sequence, length, offset."""
    lengths = tuple(lengths)
    cut = written(pieces(docs, lengths), "pack-pieces")
    groups = max(1, -(-cut.filter("words > 0").count() // group))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        at, offset, final = best_fit(pdf["words"].to_numpy(), lengths)
        return pdf.assign(sequence=key[0] * (1 << 32) + at, length=final[at], offset=offset).drop(columns="grp")

    dealt = cut.filter("words > 0").withColumn("grp", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("grp").applyInPandas(
        run, "doc_id long, copy long, piece long, start long, words long, sequence long, length long, offset long")
    none = F.lit(None).cast("long")
    return packed.unionByName(cut.filter("words = 0").select("*", none.alias("sequence"), none.alias("length"), none.alias("offset")))
