"""Cross-tokenizer alignment against whole texts encoded and counted in plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from solera.llm import alignment as al
from solera.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(20000))
#: Nulls, empty texts, white space of all kinds, U+2581, special tokens' strings, repeated rows.
ODD = [(None, None), (None, "x"), (-1, ""), (-2, " "), (-3, "  a  b\n c \t d▁e f"), (-4, "a▁"), (-5, "<s> </s> <|endoftext|> hi <|endoftext|>"), (1, "x"), (1, "x"),
       (-6, " \n x  y 　z\x1c q\x00 w 😀é 中文 字"), (-7, "x" * 5000), (-8, "a  b   c    d   "), (-9, "\n\n a\r\n b"), (-10, "'s 's don't 'LL we'll"), (-11, LONG)]


@pytest.fixture(scope="module")
def aligner():
    return al.Aligner(*(open(f"{al.TOKENIZERS}/{f}", "rb").read() for f in (al.A_FILE, al.B_FILE)))


def brute(rows, aligner):
    docs, count, best = [], Counter(), {}
    for i, text in rows:
        docs.append((i, None))
        a, b = (x.ids if hasattr(x, "ids") else x for x in (aligner.a.encode(" " + (text or ""), add_special_tokens=False), aligner.b.encode(text or "")))
        a_raw, b_raw = [aligner.a_bytes[x] for x in a], [aligner.b_bytes[x] for x in b]
        if not text or not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_raw]).tolist(), {e: n for n, e in enumerate(np.cumsum([len(x) for x in b_raw]).tolist())}
        groups, links, at, bt = [], [], 0, 0
        for n, e in enumerate(a_end):
            if e in b_end:
                m = b_end[e]
                links.append((a[n], b[m]))
                groups.append(",".join(map(str, a[at:n + 1])) + "|" + ",".join(map(str, b[bt:m + 1])))
                at, bt = n + 1, m + 1
        count.update(links)
        docs[-1] = (i, (len(a), len(b), links, ";".join(groups)))
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = d
        out.append((i, n_a, n_b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str), count


def test_against_whole_texts(spark, aligner):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()] + ODD
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_a long, key string, chunk int")
    # many chunks, buckets and levels of the tree
    got, counts = al.corpus_alignment(docs, chunk_bytes=20000, bucket_keys=500, fan=3)
    want, count = brute(rows, aligner)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {(r["a_id"], r["b_id"]): r["count"] for r in counts.collect()} == count


def test_query_does_not_depend_on_chunks(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    a = QUERIES["op11_cross_tokenizer"](spark, SF001).orderBy("doc_id").collect()
    assert a == al.aligned(docs.repartition(3), chunk_bytes=9999, bucket_keys=100).orderBy("doc_id").collect() and len(a) == docs.count()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert al.aligned(docs.filter("false")).count() == 0
    assert [tuple(r) for r in al.aligned(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(5))).collect()] == [(5, 0, 0, 0, 0, 0, 0, "")]


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 30000):
        keys = np.unique(rng.integers(0, 1 << 47, n))
        h = al.PerfectHash.from_bytes(al.PerfectHash.build(keys).to_bytes())
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        if len(keys) > 1:
            placed = np.empty(len(keys), np.int64)
            placed[h.slots(keys)] = keys
            table = {"levels": h.to_bytes(), "keys": placed.tobytes()}
            assert (placed[al._verified(table, keys)] == keys).all()
            with pytest.raises(ValueError):
                al._verified(table, np.array([1 << 50]))


def test_pieces_put_together_are_the_text(aligner):
    for _, t in ODD:
        numbers, pieces = aligner.pieces_of([t or ""])
        assert " ".join(pieces[n] for n in numbers[0].tolist()) == (t or "")
