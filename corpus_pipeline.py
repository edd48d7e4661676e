"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waveledger.llm import line_dedup, packing, quality_rules, simhash, suffix_dedup
from waveledger.llm.queries import vocabulary
from waveledger.llm.shared import table
from waveledger.sources.tables import drop, scope, staged


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, with n_chars, if there, of the new text."""
    return docs.select(*[F.char_length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
                         for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of passages of three lines."""
    return _counted(line_dedup.dedup_lines(docs), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes of repeated strings of 100 bytes."""
    return _counted(suffix_dedup.deduped_texts(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near),
          ("suffix-array dedup", substrings), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has read or staged goes once its documents are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scope() as made:
            docs = staged(stage(spark, docs, sf_dir), "corpus")
        drop(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashes and tokens are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
