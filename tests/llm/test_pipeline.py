"""The pipeline's stages against brute-force versions of what each must keep."""

from collections import Counter

import corpus_pipeline as P
from solera.llm import simhash, toxicity
from tests_llm_helpers import components_of

SF01 = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    columns = docs.columns
    clean = P.reject_toxic(spark, docs, SF01).cache()
    model = toxicity.train(docs, labels)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect() if model.score(r["text"] or "") < toxicity.THRESHOLD}
    lines = P.dedup_lines(spark, clean, SF01).cache()
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines.collect())
    one = P.dedup_near_copies(spark, lines, SF01).cache()
    rows = sorted(lines.collect(), key=lambda r: r["doc_id"])
    fps = [simhash.simhash(r["text"] or "") for r in rows]
    assert {r["doc_id"] for r in one.collect()} == {rows[k]["doc_id"] for k in set(components_of(fps))}
    mixed = P.mix_sources(spark, one, SF01).cache()
    assert clean.columns == lines.columns == one.columns == mixed.columns == columns
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    packed = P.pack_sequences(spark, mixed, SF01)
    assert sum(r["words"] for r in packed.collect()) == sum(len((r["text"] or "").encode().split()) for r in mixed.collect())


def test_run_agrees_with_itself(spark):
    a, b = (P.run(spark, "/root/testdata/sf0.001").orderBy("doc_id", "copy", "piece").collect() for _ in range(2))
    assert a and a == b
