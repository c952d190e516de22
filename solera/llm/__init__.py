"""Training-data operators: mixing, language ID, quality, line dedup, sharding, toxicity, packing,
fingerprints, PII, SimHash near-dedup, cross-tokenizer alignment, license scans and hard negatives.

Each module holds one operator with a general interface; ``queries`` registers one
``opN_<name>`` query per operator over its whole table, with the SQL where SQL can state it.
Nothing outside this subpackage (but ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py``) imports it.
"""
