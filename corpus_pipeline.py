"""The corpus pipeline: five stages over ``documents``, each one an operator of ``febrile.llm``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last give the
columns of their input.

Defined results: an empty table stays empty through all stages; null texts have
no shingle, no window and no hit, so they pass the filters and are written as
their end id; rows without an id cannot be named in a group of near copies and
all stay; repeated rows become one in the second stage, and where an id comes with
several texts, each text is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.llm.common import DOCUMENT_COLUMNS, read_table, text_or_empty, written
from febrile.llm.decontaminate import contamination
from febrile.llm.mix_temperature import MixTarget, mix
from febrile.llm.ngram_join import ngram_groups
from febrile.llm.token_frames import token_output
from febrile.llm.toxicity import learned_from, score

#: Score from which a document is rejected.
TOXIC = 0.7
#: No source is read more often than this; all are read at least once.
REPETITION = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model scores below ``TOXIC``."""
    return score(docs, learned_from(spark, sf_dir)).filter(F.col("score") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id (of several texts of that id, one)."""
    groups = written(ngram_groups(docs), "near-groups").filter("doc_id is not null")
    first = groups.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("r.*")
    keep = first.unionByName(groups.filter("group is null").select("doc_id", "text_hash").distinct())
    of_text = docs.withColumn("text_hash", F.xxhash64(text_or_empty()))
    out = of_text.join(keep, ["doc_id", "text_hash"], "left_semi").drop("text_hash")
    if groups.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "text"])  # repeated rows
    return out.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth of their words in benchmark windows."""
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of the mixture: small sources repeat, up to ``REPETITION`` times."""
    return mix(docs, MixTarget(max_repetition=REPETITION)).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the readings, and what the files hold of each."""
    return token_output(docs).select("doc_id", "start", "n_tokens", "ids_crc32", "place")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_sources", mix_sources),
    ("token_id_output", write_tokens),
]

#: Hash-banded near copies, a learned lexicon and a tokenizer: SQL has none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
