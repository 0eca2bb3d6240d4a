"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
Null texts and ids, repeated rows and empty tables are treated as the operators' docstrings say; a stage never fails
on them. Columns beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import line_dedup, minhash, mixing, packing, quality
from photonlake.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs.select(*COLUMNS), labels).filter("_kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; texts and lengths follow. Emptied documents stay as rows."""
    rows = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("_n_dropped") > 0
    text = F.when(changed, F.col("_kept")).otherwise(F.col("text"))
    length = F.when(changed, F.char_length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.dedup(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents in the order of the schedule's slots, each as often as its source's blocks take it, in whole
    texts. Only the one document that a source's target cuts is rounded, to taken or not by half of its words."""
    docs = mixing.with_row_key(docs.select(*COLUMNS))
    _, pieces = mixing.mix(docs.select(*COLUMNS))
    single = docs.dropDuplicates(mixing.ROW)  # equal rows have a copy each in the mix
    return single.join(mixing.copies(pieces), mixing.ROW).orderBy("_slot", "_row").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences; repeated documents are packed as often as they come."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor MinHash; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
