"""The pipeline's stages on odd tables, and run itself."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row int, _n int, lang_pred string, score double, kept boolean"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 1, 2, "x", 0.5, False) for i, t, g in rows], COLUMNS)


def test_empty_tables_and_extra_columns(spark):
    docs = table(spark, [(1, "the cat sat on the mat and it was the best of all cats", "en"), (None, None, None), (2, "", "en"), (2, "12 34", None)])
    for seen in (docs, docs.limit(0)):
        for _, stage in C.STAGES[:-1]:
            seen = stage(spark, seen, SF)
            assert seen.columns == docs.columns and [f.dataType for f in seen.schema] == [f.dataType for f in docs.schema]
            seen.collect()
    assert C.pack(spark, docs, SF).where("piece = 0").count() == 4 and C.pack(spark, docs.limit(0), SF).count() == 0


def test_no_language_is_labelled(spark):
    docs = table(spark, [(i, f"some words of text number {i}", None) for i in range(40)])
    assert sorted(C.keep_identified(spark, docs, SF).collect()) == sorted(docs.collect())


def test_one_row_of_each_group(spark):
    """An id with several texts, ids that are null, repeated rows, rows without words."""
    same, near = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}" for i in range(58))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(7, same, "en"), (7, other, "en"), (3, near, "en"), (None, same, "en"), (9, other, "en"), (3, near, "en"), (None, "alone in all of this here", "en"), (4, "", "en"), (4, "", "en"), (5, None, "en")]
    got = C.keep_first_copies(spark, table(spark, rows).repartition(3), SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(3, near), (7, other), (0, "alone in all of this here"), (4, ""), (4, ""), (5, "")])


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_run(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end or n > 2048").count() == 0 and out.count() > 0
