"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination,
personal data, tokens. Each stage takes (spark, docs, sf_dir) and returns a DataFrame;
what one stage keeps is written and read again as the next one's docs.

In every stage: null texts are empty, whole texts are read, an empty table gives an empty
one, and columns beyond doc_id and text are passed on as they are, whatever their names.
The last stage gives columns of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridsmith.llm import bpe, decontam, jaccard, pii, quality
from gridsmith.llm.common import materialize, table
from gridsmith.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a decision list, learned from the labelled ones of docs, keeps. Rows are
    judged one by one, repeated and null ids too; null and empty texts have under ten words and go."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id; one of the rows
    of an id. Rows without an id stay, and texts without words are in no group."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows without an id stay; of an id whose
    rows differ, all go if one holds an item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; every row stays, null texts null."""
    return pii.redact(docs, pii.train(spark))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of every row; null and empty texts have none."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, offsets=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", redact),
    ("byte-level BPE", tokenize),
]

#: A learned list, sketches, trees and a tokenizer can't be told in SQL; the stages
#: are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
