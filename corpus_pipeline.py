"""From raw documents to sampled token sequences, in five stages.

quality     rows that the quality network rejects go
near_dups   of each class of near duplicates the row with the smallest id stays
secrets     secrets in texts are replaced by their kind, and n_chars follows
mixing      sources are mixed to their target weights; a row occurs as often as it is taken
segments    each text is encoded as two sampled SentencePiece segmentations

Every stage works on all that the one before it kept, and all but the last return the
columns of documents. Rows that the mix repeats are encoded each time they occur.

Null ids: such rows are scored, redacted, mixed and encoded like others, and are near
duplicates of nothing. Null texts count as empty: the network judges them as it judges empty texts, they
link with nothing, hold no secrets and stay null, have no words for the mix to take (which leaves them in once), and have one
segmentation without pieces. Rows that repeat an id and text: one of them stays. Ties fall by
id, then by hash of the text. Long texts are read whole in every stage. An empty table gives no rows.
Further columns are carried through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import mixing, near_dups, quality, secrets, segmentation
from leadloom.llm.common import durable, table

#: Word shingles that two documents share to be near copies here; op3 has its own threshold.
NEAR_SHARE = (80, 100)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs, NEAR_SHARE)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentation.sample_segmentations(docs, packed=True)


STAGES = [
    ("quality", keep_good),
    ("near_dups", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("segments", encode),
]

#: SQL can express neither the network nor the sampled segmentations; tests/llm compares
#: each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
