"""The pipeline's stages on whole small tables."""

from __future__ import annotations

import re

import corpus_pipeline
from umbra.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in docs.collect()]
            assert len(texts) == len(set(texts))
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == before


def test_run_gives_the_packed_rows(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0


def test_stages_take_nulls_empty_tables_and_other_columns(spark):
    """Columns named as the stages' own pass through; null and empty texts, ids and sources stay rows; an empty table stays empty."""
    plain = "A quiet garden lies behind the old house and nobody has been there since spring came back to the valley"
    rows = [(i, f"{plain} {i} " + " ".join(f"w{i}x{j}" for j in range(20)), "en", "a", 100, "k", 1, 2.0, "t", True) for i in range(40)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (100, "", "", "", 0, "", 0, 0.0, "", False), (None, None, None, None, None, None, None, None, None, None), (101, "word " * 40_000, "fr", None, -1, "k", 1, 2.0, "t", True)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, topic string, row long, probability double, digest string, kept boolean"
    docs = spark.createDataFrame(rows, kinds)
    for table_ in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table_ = staged(stage(spark, table_, SF))
            assert table_.columns == docs.columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, table_, SF)
        assert pieces.count() >= table_.count()
