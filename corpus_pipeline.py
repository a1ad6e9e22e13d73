"""A training corpus from raw documents, in five stages; part of subpackage ``llm``.

Each stage takes the documents its predecessor kept and the folder with the
other tables, and returns documents; between stages they are Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm import mixing, ngram_join, pieces, quality_model, substring_dedup
from twinweave.llm.words import n_words, unused
from twinweave.plans.scratch import Scratch
from twinweave.plans.session import ship_package

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled rows of ``docs``.

    Null and empty texts are scored as texts without words, and whole texts at any
    length. Repeated rows are judged alike; an empty table stays empty.
    """
    ship_package(spark)
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 of five-word shingles: the one with the least id.

    Rows without an id stay, as do null, empty and blank texts, which link with
    nothing. Of rows that repeat the kept id, all stay. Whole texts count.
    """
    ship_package(spark)
    groups = ngram_join.jaccard_components(docs, width=5, percent=80)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out of all but the first document that holds them.

    A text that was cut goes if no word is left of it; one with any word stays.
    Null and empty texts and rows without an id stay as they are.
    """
    ship_package(spark)
    (mark,) = unused(docs, "was_cut")
    cut = substring_dedup.remove_spans(docs, substring_dedup.duplicate_spans(docs), mark=mark)
    kept = cut.filter(~F.col(mark) | (n_words("text") > 0))
    return kept.withColumn("n_chars", F.when(F.col(mark), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the mix asks; a last repetition may be the document's first words only.

    Nothing can be taken of null texts and texts without words, so they go.
    """
    ship_package(spark)
    taken = Scratch(spark, "pipeline").stash(mixing.mix(docs), "taken")
    mixed = mixing.materialise(docs, taken)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the check that they decode to its text; null and empty texts have none."""
    ship_package(spark)
    return pieces.pieces_digest(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", pieces_stage),
]

#: The classifier and the chunk hash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    ship_package(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = scratch.stash(out, name.replace(" ", "-"))
    return docs
