"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm import bpe, decontaminate, neardup, quality, substrings
from metrolith.llm._spark import folder, read
from metrolith.llm.queries import tokenizer


class _Plain:
    """The columns of a table under names that no operator adds, and the way back."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        used = {"doc_id", "text", "lang"}
        self.plain = [c.lower() if c.lower() in used else f"column {k}" for k, c in enumerate(self.names)]
        self.docs = docs.toDF(*self.plain)

    def back(self, out: DataFrame, **changed: Column) -> DataFrame:
        """The columns as they were; `changed` ones, by their old name, take the value given."""
        mine = {k.lower(): v for k, v in changed.items()}
        return out.select(*[mine.get(name.lower(), F.col(f"`{plain}`")).alias(name) for name, plain in zip(self.names, self.plain, strict=True)])

    def old(self, name: str) -> str | None:
        """The plain name of a column, if the table has it."""
        return next((p for n, p in zip(self.names, self.plain, strict=True) if n.lower() == name), None)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the perplexity band of their language keep."""
    p = _Plain(docs)
    return p.back(quality.quality(p.docs).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the one of the least doc_id.

    Rows of one doc_id are one document: they stay or go together, but of rows that repeat doc_id and
    text one stays. Rows without a doc_id all stay: no group can name one of them.
    """
    p = _Plain(docs)
    found = neardup.near_duplicates(p.docs, k=5, percent=80)
    gone = found.filter("not kept and doc_id is not null").select("doc_id").distinct()
    stay = p.docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return p.back(stay.unionByName(p.docs.filter("doc_id is null")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier elsewhere; those left without words go."""
    p = _Plain(docs)
    out = substrings.dedup_substrings(p.docs, window=20).filter("n_removed < n_words or n_words = 0")
    fewer = F.col("n_removed") > 0
    changed = {"text": F.when(fewer, F.col("kept")).otherwise(F.col("text"))}
    if (chars := p.old("n_chars")) is not None:
        changed["n_chars"] = F.when(fewer, F.length("kept").cast("bigint")).otherwise(F.col(f"`{chars}`"))
    return p.back(out, **changed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of a benchmark item."""
    p = _Plain(docs)
    return p.back(decontaminate.decontaminate(p.docs, read(spark, sf_dir, "benchmark"), window=10).filter("not contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document left, decoded again as a check: counts and digests."""
    base = docs.select("doc_id", "text")
    return bpe.encode(base, *tokenizer(), digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokenize", tokenize),
]

#: The model, the groups, the passages and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again.

    A stage's output goes once the next one is written; the last one's stays, as the result reads it.
    """
    docs, at, before = read(spark, sf_dir, "documents"), f"{folder(spark)}/pipeline-{uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{at}/{name}"
    return docs
