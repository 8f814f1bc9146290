"""The pipeline's first stage: whole rows of the documents with a language, without moving texts."""

from evidara.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE = "the quick brown fox jumps over the lazy dog and runs away ", "der schnelle braune fuchs springt über den faulen hund und läuft weg "


def rows():
    return [(i, (EN, DE)[i % 2] * (1 + i % 3), ("en", "de")[i % 2], f"s{i}", i) for i in range(40)]


def test_stage_keeps_whole_rows(spark):
    import corpus_pipeline

    odd = [(100, "12 34 !!", "en", "x", 8), (101, None, "de", None, None), (102, "", None, "y", 0), (103, "q", None, None, 1), (None, EN, "en", "z", 5)]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows() + odd, SCHEMA), "")
    assert sorted(map(tuple, got.collect())) == sorted([*rows(), odd[3]])
    assert corpus_pipeline.language(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_stage_keeps_one_row_of_repeated_ids(spark):
    import corpus_pipeline

    got = corpus_pipeline.language(spark, spark.createDataFrame([*rows(), rows()[3], (5, "zzz " + DE, "de", "other", 9)], SCHEMA), "")
    assert sorted(map(tuple, got.collect())) == sorted(rows())


def test_stage_shuffles_no_texts(spark):
    import corpus_pipeline

    got = corpus_pipeline.language(spark, spark.createDataFrame(rows(), SCHEMA), "")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_kept_columns(spark):
    docs = spark.createDataFrame([(1, EN, "b"), (2, DE, None)], "id long, body string, lang string")
    model = language_id.train(docs.fillna("de", ["lang"]), key="id", text="body")
    got = language_id.identify(docs, model, key="id", text="body", keep=["lang", "id", "body"])
    assert got.columns == ["doc_id", "lang_pred", "score", "languages", "lang", "body"]
    assert sorted((r.doc_id, r.lang_pred, r.lang, r.body) for r in got.collect()) == [(1, "b", "b", EN), (2, "de", None, DE)]
