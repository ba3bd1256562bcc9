"""A corpus from raw documents to packed sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it
is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of documents:

quality            documents whose calibrated quality score is below 0.5 go
exact_dedup        of texts equal without white space, one stays
near_dedup         of each class of 5-gram Jaccard 0.8 or more, one stays
mixing             all stay, in the order of a Pfair schedule of their sources
packing            pieces of at most 2048 tokens with their sequence and place

Mixing drops nothing: its decision is the order. Files keep no order when they
are read, so packing takes the schedule's positions of the same rows again and
packs stretch by stretch: numbers of sequences rise with the stretches of the
mixture, and a sequence holds documents of one stretch. Only the few sequences
that stretches leave open are filled from neighbouring ones; they stand at the
end of the last of these. Column ``stretch`` tells a piece's own. Weights hold
until the first source ends, so the mixture as a whole has natural proportions.

Cases: null and empty texts are scored like others and where they stay count as
equal; texts of any length are read whole; a null doc_id stays null and a null
source is one of its own; repeated rows are copies, of which one stays; ties go
to the longer original and then the smaller id in exact, to the smaller id in
near duplicates; without labels all documents pass the classifier; an empty
table gives no rows; more columns than documents has, whatever their names, are
carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermolith.llm import common, exact_dedup, mixing, near_dedup, packing, quality


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs)


#: Target weights by source; none: a power of the source's size.
WEIGHTS = None


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs, WEIGHTS)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, stretches=mixing.stretches(docs, packing.STRETCH_DOCS, WEIGHTS))


STAGES = [
    ("quality classifier", _quality),
    ("exact dedup", _exact_dedup),
    ("near-duplicate join", _near_dedup),
    ("mixing to target weights", _mixing),
    ("best-fit packing", _packing),
]

#: SQL expresses neither the classifier nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.forget(before)
    return docs
