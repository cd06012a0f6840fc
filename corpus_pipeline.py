"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

quality classifier -> quality rules -> near-duplicate removal -> source mixing -> packing. Every stage
takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents.

Defined results, of every stage: an empty table gives an empty result; a null text counts as empty and a null id or
source as a value of its own; columns beyond those of documents stay, whatever their names; repeated rows are
judged alike, but for near duplicates, of which one stays, and the mix, which takes each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, ngram_join, packing, quality_crf, quality_rules
from tessera.runtime import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts to be good; it learns from labels of documents not held out. Empty texts are scored as one empty line; without labels of both classes all share one score."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rule_votes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps; those of fewer than 50 words, so empty ones too, fail the base rules."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the least id. Empty texts and rows without an id stay."""
    return ngram_join.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in the order of its schedule; repeated where a source is upsampled, the last one of a source cut to its target. Texts without a word give nothing."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens; an empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_votes),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs


#: the classifier, the fitted rules and the tokenizer have no SQL form; tests compare with brute force
ORACLE_SQL = None
