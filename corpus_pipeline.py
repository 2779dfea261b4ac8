"""A corpus from raw documents to token ids: quality, near duplicates, benchmark passages, source mix, binary output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.decontaminate import drop_contaminated
from palimpsest.llm.mixing import repeat_mixed
from palimpsest.llm.ngram_join import keep_representatives
from palimpsest.llm.quality import drop_rejected
from palimpsest.llm.queries import table, tokenizer_path
from palimpsest.llm.token_output import token_round_trip
from palimpsest.storage import materialize, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is scored as one without words, a very long one whole; equal texts fare alike, so ties and repeated rows all
    stay or all go. Without labels all documents score alike and stay. An empty table stays empty. Columns beside COLUMNS aren't kept.
    """
    return drop_rejected(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the document with the smallest id stays.

    Texts without words, null or empty, are in no group and all stay. A null id is above every id. Of repeated rows, and of other ties
    within a group, one stays. Very long texts are compared whole. An empty table stays empty. Columns beside COLUMNS aren't kept.
    """
    return keep_representatives(docs.select(COLUMNS), n_words=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go.

    Texts without words, null or empty, stay; very long ones are searched whole; repeated rows all stay or all go. With an empty
    benchmark all stay. An empty table stays empty. Columns beside COLUMNS aren't kept.
    """
    return drop_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it doesn't take go.

    A null source is a source; null ids share one hash and are taken alike, as are repeated rows and other ties. Texts without words
    have size 0: they are taken with their neighbours in hash order and count for nothing. Very long texts are counted whole. An empty
    table stays empty. Columns beside COLUMNS aren't kept.
    """
    return repeat_mixed(docs.select(COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document in binary files, read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; a very long one is encoded whole. Null ids come first; rows that repeat an id are in the
    order of their texts' hashes. An empty table gives no rows. Columns beside doc_id and text aren't read.
    """
    return token_round_trip(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("token_output", token_ids),
]

#: Trained trees and a byte-pair encoder are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are a table in the shared folder that the next one reads, and that goes after that."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
