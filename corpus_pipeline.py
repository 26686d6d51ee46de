"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, is written as Parquet and read again, so a lost executor
costs a stage's tasks at most. All stages but the last return the columns of ``documents``:

1. quality rules: documents that fail the rules, or that their host's record tips over, go;
2. near-duplicates: of each group of near copies the document with the smallest id stays;
3. personal data: every span is replaced by its kind in brackets, and ``n_chars`` follows the text;
4. mixing: documents are taken as often as their source's target asks, a row per copy;
5. packing: every copy is cut into tokens and given its place in a sequence.

Cases: null, empty and blank texts fail the quality rules; a null source is a host and a source of its own; rows
with a null doc_id are judged, held against others and mixed like all, and go if they are a near copy of a row with
an id; repeated rows are one after the second stage; ties are broken by doc_id, then by a hash of the text; very long
texts are read whole and cut only into pieces at the end; further columns, clashing ones too, are handed on up to the
last stage; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickspan.llm.mixing import mixed
from clickspan.llm.neardup import one_of_each
from clickspan.llm.packing import pack
from clickspan.llm.pii import redacted
from clickspan.llm.quality import kept_documents
from clickspan.llm.tables import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Token ids are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
