"""The pipeline's stages on a small table and on hard rows, against the operators' own rules."""

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    """What each stage returned, written and read again."""
    out, docs = {}, spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, tables).write.mode("overwrite").parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages(spark, tables, stages):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    assert all(stages[n].columns == docs.columns for n in list(stages)[:-1])
    assert stages["language ID"].count() == docs.count()
    from llm_brute import brute_components

    rows = [tuple(r) for r in stages["language ID"].select("doc_id", "text").collect()]
    kept = {i for i, n, c in brute_components(rows) if i == c or not n}
    assert {r["doc_id"] for r in stages["n-gram Jaccard join"].collect()} == kept


def test_packing_covers_what_is_left(stages):
    left = {r["doc_id"] for r in stages["PII"].select("doc_id").collect()}
    assert left == {r["doc_id"] for r in stages["best-fit packing"].select("doc_id").collect()}


def test_hard_rows(spark, tables):
    rows = [(1, None, "en", "s", 0, 5), (2, "", "en", None, 0, 5), (3, "the words of a text that has some more of them", "en", "s", 3, 5), (3, "the words of a text that has some more of them", "en", "s", 3, 5), (None, "an other text with words of its own in it", None, "s", 3, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash_ int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert "hash_" in docs.columns
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 3]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, tables)
    assert none.count() == 0
