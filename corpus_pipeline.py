"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows that its predecessor kept, is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framescope.llm.common import crc_bucket
from framescope.llm.content_sort import distinct_contents
from framescope.llm.minhash_dedup import without_near_duplicates
from framescope.llm.mixing import mix_sources
from framescope.llm.packing import pack_documents
from framescope.llm.quality_pu import fit_quality, good_documents
from framescope.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns as op4_quality does.

    Null and empty texts are judged like any; rows without an identifier have no label; repeated rows are judged
    alike; an empty table, or one without labels, stays as it is. All columns are returned.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good_documents(docs, fit_quality(docs, labels, crc_bucket("doc_id", 5) != 0))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text, the one with the largest identifier as in op6_exact_dedup.

    A null text equals an empty one. A missing identifier is below all others; of rows that repeat identifier and
    text one stays. All columns are returned, whatever their names.
    """
    return distinct_contents(docs, keep_largest=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest identifier.

    Null, empty and wordless texts are near their equals only. A missing identifier is above all others; of
    rows that repeat identifier and text one stays. All columns are returned, whatever their names.
    """
    return without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have their target weights, globally shuffled.

    Null sources are one source; rows without an identifier draw each on their own. All columns are returned,
    ``copy`` and ``position`` of the mix are left out.
    """
    kept = [c for c in docs.columns if c not in ("copy", "position")]
    return mix_sources(docs).select(*kept)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens.

    A null text has only its closing id; repeated rows are packed each on their own; an empty table gives no piece.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: A trained classifier decides the first stage, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *earlier, (_, last) = STAGES
    for name, stage in earlier:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
