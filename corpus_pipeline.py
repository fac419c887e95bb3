"""The corpus pipeline: language ID, near duplicates, benchmark passages, secrets, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and works on all
rows it is given. ``run`` applies them to ``documents``, writing each result as Parquet in
the shared folder and reading it back for the next stage.

Decisions: texts without a known language go; of each group of similar texts the one with
the smallest id stays; texts that hold a benchmark passage go; secrets are replaced by a
mark (and ``n_chars`` follows); the last stage returns one row per text that is left, with
its ids' count and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eddyline.llm import byte_bpe, byte_cnn, ngram_join, pigeonhole, secret_battery
from eddyline.llm.common import table
from eddyline.session import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_cnn.keep_known(docs, byte_cnn.fit(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pigeonhole.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_battery.redact(docs, count_col="n_chars")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

# A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
