"""Pipeline stages: columns with clashing names, nulls, repeated ids and rows, empty texts and tables, very long texts."""

import pytest
from pyspark.sql import functions as F

CLASHES = ["predicted", "score", "n_words", "kept", "lower", "row", "turn", "id", "words", "gone", "digest_a", "component_id", "first", "rows"]


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def clashing(docs):
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES), F.create_map(F.lit("a"), F.col("lang")).alias("tags"))


def test_clashing_names_pass_every_stage(spark, sf, pipeline):
    docs = clashing(spark.read.parquet(f"{sf}/documents.parquet"))
    for name, stage in pipeline.STAGES[:4]:
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES), name
        assert all(r.tags == {"a": r.lang} for r in rows), name
    packed = pipeline.STAGES[4][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicates_with_nulls_repeats_and_ties(spark, pipeline):
    prose = " ".join(f"w{i}" for i in range(60))
    near = prose.replace("w30", "other")
    rows = [
        (5, prose, "en"),
        (5, prose, "en"),  # a repeated row
        (7, prose, "en"),
        (9, near, "en"),
        (11, "something else " * 3, "en"),
        (11, "yet another text with the same id", "en"),  # one id, two texts
        (12, None, "en"),
        (12, "", "en"),
        (None, prose, "en"),
        (None, None, None),
        (13, " \t\n", "en"),
        (14, "long " + " ".join(f"x{i}" for i in range(60_000)), "en"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in pipeline.without_near_duplicates(spark, docs, "").collect())
    ids = [i for none, i, _ in found if not none]
    assert ids == [5, 11, 12, 12, 13, 14] and sum(none for none, _, _ in found) == 2


def test_rules_judge_equal_rows_alike_and_drop_empty_texts(spark, pipeline):
    prose = [" ".join(f"{a}{b}" for a in ("ba", "co", "de", "fi", "lo") for b in "nrstmgxlpk") + f" end{i}" for i in range(8)]
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(1, prose[1], "en"), (None, prose[2], None), (20, None, "en"), (21, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = pipeline.ruled(spark, docs, "").collect()
    assert sum(r.doc_id == 1 for r in kept) in (0, 2)
    assert not {20, 21} & {r.doc_id for r in kept}


def test_empty_tables(spark, sf, pipeline):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
