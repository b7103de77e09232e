"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.llm.common import crc_bucket, whole_text
from framescope.llm.content_sort import content_groups
from framescope.llm.embedding_dedup import near_vectors
from framescope.llm.fingerprints import edited_fingerprints
from framescope.llm.language_id import fit_language_model, identify_languages
from framescope.llm.lexical_search import build_index, search_index
from framescope.llm.minhash_dedup import near_groups
from framescope.llm.mixing import mix_sources
from framescope.llm.packing import pack_documents
from framescope.llm.quality_pu import fit_quality, score_quality
from framescope.llm.secret_scan import KINDS, find_secrets, fit_secret_model
from framescope.llm.spelling_groups import document_words, spelling_groups
from framescope.llm.token_counts import count_tokens
from framescope.llm.url_filter import ALLOW, BLOCK, Rule, filter_urls
from framescope.session import materialize

# The rules of the definition.
URL_RULES = [
    Rule("org", "/", ALLOW),
    Rule("example.org", "/es/", BLOCK),
    Rule("example.org", "/en/1", BLOCK),
    Rule("com", "/fr/", ALLOW),
    Rule("com", "/de/", BLOCK),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 4) == 2
    return identify_languages(docs, fit_language_model(docs.filter(~held_out)), held_out)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit_secret_model(docs))
    *base, _ = KINDS
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 5) == 0
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return score_quality(rows, model, ["doc_id", "held_out"])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("p_block")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"), keep_largest=True)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.drop("row")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "copy", "source", "position", F.octet_length(whole_text()).cast("bigint").alias("n_bytes"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = document_words(table(spark, sf_dir, "documents"), typo_every=97)
    return spelling_groups(materialize(words.filter("n >= 3"), "vocabulary"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_index(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_language_id,
        op3_secret_scan,
        op4_quality,
        op5_url_filter,
        op6_exact_dedup,
        op7_embedding_dedup,
        op8_minhash_dedup,
        op9_packing,
        op10_mixing,
        op11_fingerprints,
        op12_spelling_groups,
        op13_lexical_search,
    )
}

_SIZES = """
sizes AS (
  SELECT coalesce(source, '(none)') AS source,
         CAST(greatest(sum(strlen(coalesce(text, ''))), 1) AS DOUBLE) AS bytes
  FROM documents GROUP BY 1
)"""

ORACLE: dict[str, str] = {
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op10_mixing": f"""
WITH RECURSIVE {_SIZES.strip()}, rates AS (
  SELECT source, 2.0 * sqrt(bytes) / sum(sqrt(bytes)) OVER () * sum(bytes) OVER () / bytes AS rate FROM sizes
), draws AS (
  SELECT doc_id || '|' || md5(coalesce(text, '')) AS name, doc_id, documents.source,
         strlen(coalesce(text, '')) AS n_bytes, rate, greatest(ceil(rate / 20.0), 1)::INTEGER AS parts,
         CAST('0x' || sha256('mix-1|' || doc_id || '|' || md5(coalesce(text, '')) || '|' || rates.source)[1:13] AS BIGINT) AS bits
  FROM documents JOIN rates ON coalesce(documents.source, '(none)') = rates.source
), shares AS (
  SELECT name, i, rate / parts AS mean, 1 + ceil(rate / parts + 10 * sqrt(rate / parts) + 12) AS stop,
         CASE WHEN i = 1 THEN bits ELSE CAST('0x' || sha256(bits || '|' || i)[1:13] AS BIGINT) END / 4503599627370496.0 AS u
  FROM (SELECT *, unnest(range(1, parts + 1)) AS i FROM draws)
), steps AS (
  SELECT name, i, u, mean, stop, 0 AS k, exp(-mean) AS p, exp(-mean) AS below FROM shares
  UNION ALL
  SELECT name, i, u, mean, stop, k + 1, p * mean / (k + 1), below + p * mean / (k + 1)
  FROM steps WHERE below <= u AND k + 1 < stop
), counts AS (
  SELECT name, sum(most)::BIGINT AS copies FROM (SELECT name, i, max(k) AS most FROM steps GROUP BY name, i) GROUP BY name
), copied AS (
  SELECT name, unnest(range(copies)) AS copy FROM counts
)
SELECT doc_id, CAST(copy AS INTEGER) AS copy, source, n_bytes,
       CAST('0x' || sha256('mix-1|order|' || name || '|' || copy)[1:13] AS BIGINT) / 4503599627370496.0 AS position
FROM copied JOIN draws USING (name)""",
    "op13_lexical_search": r"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (
  SELECT row_id, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs
), postings AS (
  SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM docs)
  GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scores AS (
  SELECT item_id, row_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // totals.terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
