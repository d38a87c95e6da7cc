"""Five stages over the documents table; each writes its result and reads it back for the next.

Every stage but the last returns the columns of its input, whatever their names; ``n_chars``, where there is one, follows
the text that is left.  Null text and text of few words is rejected by the quality rules, so later stages see none; a
document that loses all its lines or bytes stays, with what is left of it, and packing gives it a piece.  Whole texts go
through, however long.  Rows with a null id are judged by the quality rules and line dedup, are like no other document,
lose no repeats and are packed.  Documents that repeat an id must repeat their text: the quality rules judge and line
dedup counts each, the join keeps or drops them together, suffix dedup treats them alike and packing packs them apart.
Of documents of equal content, and of a group of similar ones, the least id stays.  An empty table passes through every
stage as an empty table; without usable labels the base rules alone decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import common, line_dedup, ngram_join, packing, quality, suffix_dedup

#: Near duplicates between documents: words in a shingle, and least percentage of shingles shared.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in df.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model, keep_row=True)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.drop_lines(docs, F.col("source")))


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.similar_sets(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)
    key = f"{common.prefix(docs)}key"
    least = groups.where("doc_id = component_id or component_id is null").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(least, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(suffix_dedup.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", one_of_similar),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]
#: A trained classifier and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
