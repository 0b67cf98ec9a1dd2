import corpus_pipeline
from tessera.llm import secrets
from tests.llm.test_simhash import kept_rows


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns
        kept[name] = docs.toPandas()
    assert 0.6 * 200 < len(kept["toxicity"]) <= 200
    want = kept_rows([(r["doc_id"], r["text"]) for _, r in kept["toxicity"].iterrows()])
    assert sorted(zip(kept["near_duplicates"]["doc_id"], kept["near_duplicates"]["text"], strict=True)) == sorted(want)
    found = secrets.digest(spark.createDataFrame(kept["secrets"], docs.schema)).toPandas()
    assert (found["spans"] == "").all() and len(kept["secrets"]) == len(kept["near_duplicates"])
    assert (kept["secrets"]["n_chars"] == kept["secrets"]["text"].str.len()).all()
    assert kept["mixing"].groupby("doc_id").size().max() <= 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(kept["mixing"])


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


NULLS = [(None, None, None, None, None), (None, "a text that no key names", "en", "s", 24), (5, None, None, None, None), (5, "", "en", "s", 0), (6, "token = abcdefgh1234 " * 3, "en", None, 63), (6, "another text of the same key", "en", "s", 28), (7, "long words " * 30000, "de", "t", None)]


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf):
    """Each stage alone: nulls in every column, repeated rows, a very long text, then no rows at all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(NULLS + NULLS[:2], "doc_id bigint, text string, lang string, source string, n_chars bigint").select(docs.columns)
    for rows in (odd, odd.where("false"), docs.where("doc_id < 20").unionByName(odd)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, sf)
            n = got.count()
            assert n <= (3 if name == "mixing" else 1) * rows.count() and (n > 0) == (rows.count() > 0), name
            assert name == "tokens" or got.columns == docs.columns
