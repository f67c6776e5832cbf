"""A corpus from raw documents: toxic ones out, near copies out, repeated passages cut, sources mixed, packed.

STAGES: (name, function) in order; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import durable, made, sweep, table
from cairn.llm.minhash import deduplicated
from cairn.llm.mixing import mixed
from cairn.llm.packing import pack
from cairn.llm.queries import vocabulary
from cairn.llm.suffix import cut_out
from cairn.llm.toxicity import clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the network does not call toxic. Null and empty texts are scored like others; repeated rows each by itself; very long texts in all windows; an empty table stays empty."""
    return clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id (null last). Null and empty texts are one group; repeated rows are copies; ties go by a hash of the row; very long texts are compared whole; an empty table stays empty."""
    return deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that strings of 100 bytes cover which start earlier too. Null texts stay null; of repeated rows the later ones lose their texts; ties go by hashes of text and row; very long texts are cut whole; an empty table stays empty."""
    return cut_out(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. A null source is a source; null and empty texts have no size; repeated rows are documents of their own, ties go by a hash of the row; an empty table stays empty."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; each row of docs is a document of its own. A null or empty text is its end symbol alone; very long texts are cut into pieces; an empty table gives none."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves on the way is deleted when its result is written."""
    docs, since = table(spark, sf_dir, "documents"), made()
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        sweep(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL expresses these stages; they are tested against brute force.
ORACLE_SQL = None
