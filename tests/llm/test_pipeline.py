"""The stages and the whole pipeline on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "er", "in", "th", "on", "st", "re", "ou"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, text(150)) for i in range(60)]
    item, passage = text(30), text(60)
    rows = clean + [(100, clean[0][1]), (101, clean[1][1].replace(clean[1][1].split()[50], "zz", 1)), (102, "few words"), (103, None), (104, text(90) + " " + item), (105, text(90) + " " + passage), (106, text(90) + " " + passage)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, "en", "s", len(t) if t else None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), {d for d, _ in clean}


def test_stages(spark, corpus):
    at, clean = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    names = docs.columns
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, at)
        kept[name] = {r["doc_id"] for r in out.collect()}
        if name != "tokenize":
            assert out.columns == names
            before = out.cache()
    assert clean <= kept["quality"] and {102, 103} & kept["quality"] == set()
    assert clean <= kept["near_dedup"] and {100, 101} & kept["near_dedup"] == set()
    assert kept["substring_dedup"] == kept["near_dedup"] and 104 not in kept["decontamination"]
    assert kept["tokenize"] == kept["decontamination"] == clean | {105, 106}


def test_run(spark, corpus):
    at, clean = corpus
    out = corpus_pipeline.run(spark, at)
    assert {r["doc_id"] for r in out.collect()} == clean | {105, 106} and out.filter("n_tokens <= 0").count() == 0


def test_odd_rows_and_clashing_names(spark, corpus):
    """Rows without an id all stay until a rule of their own drops them; rows of one id with two texts both stay; no column is lost."""
    at, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet").filter("doc_id < 20")
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    more = spark.createDataFrame([(None, first[3]), (None, " ".join(first[4].split()[::-1])), (7, first[7]), (7, " ".join(first[8].split()[::-1]))], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True).withColumn("lang", F.lit("en"))
    names = ("kept", "n_words", "bits", "Doc", "key", "h", "n_removed", "contaminated", "column 1", "hits", "__hits", "__doc")
    docs = docs.withColumns({c: F.lit(f"old {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, at).cache()
        assert docs.filter(" or ".join(f"`{c}` is null or `{c}` <> 'old {c}'" for c in names)).count() == 0, name
        if name == "near_dedup":
            ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())
            assert ids == sorted([(False, d) for d in [*first, 7]] + [(True, 0)] * 2)
    assert docs.count() >= len(first)


def test_empty_corpus(spark, corpus):
    at, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert out.count() == 0
        docs = docs if name == "tokenize" else out
