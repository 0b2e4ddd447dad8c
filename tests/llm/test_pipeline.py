"""The pipeline's stages against brute force on a small corpus."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quotaloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    words = [f"w{k}" for k in range(2000)]
    item = " ".join(words[1500:1520])
    texts = [" ".join(words[k * 30:k * 30 + 30]) for k in range(20)]
    texts += [texts[0].replace("w7 ", "other "), texts[1], texts[2] + " " + item, None, "", "shared line of text here now again ok\n" + " ".join(words[900:930]),
              "shared line of text here now again ok\n" + " ".join(words[940:970])]
    texts += [" ".join(f"c{k}x{j}" for j in range(20)) for k in range(150)]
    toxic = [f"{' '.join(f't{k}x{j}' for j in range(12))} awful scum" for k in range(60)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate([*texts, *toxic])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k >= len(texts))) for k in range(len(rows))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), len(texts)


def test_stages_take_effect(spark, corpus):
    folder, n = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        columns, docs = docs.columns, spark.read.parquet(f"{folder}/out{k}")
        assert k == 4 or docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = set(range(n))
    assert kept["toxicity"] == clean
    # copies lose their only line, and the near copy's line is one word off
    assert kept["line dedup"] == clean - {20, 21}
    assert kept["benchmark decontamination"] == kept["n-gram jaccard join"] - {22}
    assert kept["byte-level bpe"] == kept["benchmark decontamination"]
    texts = {r.doc_id: r for r in spark.read.parquet(f"{folder}/out1").collect()}
    assert texts[25].text.startswith("shared line") and not texts[26].text.startswith("shared") and texts[26].n_chars == len(texts[26].text)
    hashed = {r.doc_id: r.h for r in spark.read.parquet(f"{folder}/out3").select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("h")).collect()}
    assert {r.doc_id: r.decoded_sha256 for r in docs.collect()} == hashed


def test_one_of_each_near_group_stays(spark, corpus):
    words = [f"v{k}" for k in range(300)]
    texts = [" ".join(words[:100]), " ".join([*words[:99], "x"]), " ".join(words[:100]), " ".join(words[100:200]), None, None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])], "doc_id long, text string")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, corpus[0]).collect()
    found = [r.text for r in got]
    assert sum(t in texts[:3] for t in found if t) == 1 and found.count(texts[3]) == 1 and found.count(None) == 2 and found.count("") == 1


def test_stages_leave_further_columns_alone_and_take_empty_tables(spark, corpus):
    """Columns named as those that stages add come back as they were; empty tables stay empty with their columns."""
    names = ["pipeline_row", "toxic_score", "ld_removed", "ld_words_left", "_hashed", "_terms", "_probability", "component_id", "further_1", "a.b", "row"]
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, wide, corpus[0])
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names), name
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, docs, corpus[0]).select("doc_id").collect()}, name
        empty = stage(spark, wide.limit(0), corpus[0])
        assert empty.columns == wide.columns and not empty.count(), name


def test_whole_run_on_the_smallest_tables(spark):
    assert 0 < corpus_pipeline.run(spark, SF).count() <= 200


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
