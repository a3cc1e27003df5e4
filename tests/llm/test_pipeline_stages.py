"""The corpus pipeline: each stage's decisions on a small corpus."""

import random

import corpus_pipeline
from helpers import sentence


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    texts = [sentence(rng, 60) for _ in range(30)]
    item = sentence(rng, 14)
    texts += [texts[0], " ".join(["different", *texts[1].split()[1:]]), f"{sentence(rng, 20)} {item} {sentence(rng, 5)}", None, "", "123 !!"]
    data = [(i, t, "en", f"s{i % 4}", 1, i % 2) for i, t in enumerate(texts)] + [(None, sentence(rng, 40), None, None, 1, 1), (5, texts[5], "en", "s1", 1, 1)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, _c0 long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = [r.doc_id for r in docs.collect()]
    assert not {33, 34, 35} & set(seen["language_id"]) and {0, 5, 32, None} <= set(seen["language_id"])
    assert sorted(x for x in seen["near_copies"] if x is not None) == [i for i in range(30)] + [32] and None in seen["near_copies"]
    assert 32 not in seen["decontamination"] and len(seen["decontamination"]) == len(seen["near_copies"]) - 1
    assert max(map(seen["source_mixing"].count, seen["source_mixing"])) <= 2
    assert sorted(seen["token_output"], key=str) == sorted(seen["source_mixing"], key=str)


def test_language_stage_without_a_language_column(spark):
    """Nothing can be learned, so nothing passes, and the columns stay."""
    docs = spark.createDataFrame([(1, "some words", "a")], "doc_id long, text string, source string")
    out = corpus_pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 0


def test_empty_tables_and_a_very_long_text(spark, tmp_path):
    """No rows give no rows in every stage; a text of a megabyte goes through whole."""
    rng = random.Random(9)
    long = sentence(rng, 120_000)
    kinds = ("doc_id long, text string, lang string, source string, n_chars long", "item_id long, text string", "doc_id long, quality int, toxic int")
    for name, data in (("none", []), ("some", [(i, sentence(rng, 40), "en", "s", 1) for i in range(20)] + [(99, long, "en", "s", 1)])):
        for table, kind, rows in (("documents", kinds[0], data), ("benchmark", kinds[1], []), ("labels", kinds[2], [])):
            spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r.doc_id for r in out} <= {*range(20), 99} and max(r.n_tokens for r in out if r.doc_id == 99) > 100_000
