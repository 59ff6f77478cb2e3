"""A corpus pipeline of five stages over documents.

Junk goes, one document of each group of near-duplicates stays, secrets are replaced by their kind, documents are drawn
by rates that bring clean and toxic text to target shares, and what is left becomes tokens. Each stage takes what the
one before it kept; all but the last return the columns of documents. run() writes each stage's result as a table, so
that no stage is worked out twice, and deletes the one before it. The last result carries the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import minhash, mixing, quality, secrets, sentencepiece_scan
from reelforge.llm.shared import drop_durable, durable, read_table, ship
from reelforge.llm.vocab import vocabulary

#: Shares of tokens after mixing: clean documents keep a rate of about 1, so this draws toxic ones down and drops junk.
TARGETS = {"clean": 0.97, "toxic": 0.03, "junk": 0.0, "junk_toxic": 0.0}
#: Stretches that a worker remembers in the last stage: fewer than alone, as executors come here with full heaps.
CACHED = 100_000
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.selected(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, read_table(spark, sf_dir, "labels"), TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentencepiece_scan.tokenized(docs, vocabulary("piece_bpe_32k.model"), cached=CACHED, with_ids=True)


STAGES = [("quality", quality_classifier), ("near-duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_durable(before)
        before = docs
    return docs
