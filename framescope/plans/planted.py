"""Input views of the registered queries.

The given texts are invented syllables in which the word lists hardly occur, so sentences from the
word lists are appended to every document, by a rule over its id. The same rule exists as SQL in
``oracle_base``. All documents and whole texts are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.operators.lexicon import loaded_words
from framescope.operators.linear_model import LinearTextModel
from framescope.operators.shaping import shape_text_articles
from framescope.operators.tfidf import TfidfModel, coefficients_by_index
from framescope.sources.articles import read_documents
from framescope.sources.paths import data_version

PHRASES = C.EPISTEMIC_PHRASES + C.CERTAINTY_PHRASES
GAZETTEER: list[tuple[str, str]] = [
    ("Ames", "PERSON"), ("Maria Lopez", "PERSON"), ("Senate", "ORG"), ("United Nations", "ORG"),
    ("New Delhi", "GPE"), ("Kenya", "GPE"), ("Democrats", "NORP"), ("Conservatives", "NORP"),
    ("Clean Air Act", "LAW"), ("Budget Bill", "LAW"), ("World Cup", "EVENT"),
    ("Climate Summit", "EVENT"), ("Monday", "DATE"),
]
NAMES = [name for name, _ in GAZETTEER]
PLACES = [name for name, kind in GAZETTEER if kind == "GPE"]

# Linear weights derived from the valence table: negative words speak for bias.
WEIGHTS = {word: -10.0 * valence for word, (valence, _) in C.SENTIMENT_WORDS.items()}
BIAS = -0.5

_FITTED: dict[tuple, TfidfModel] = {}


def pick(values: list[str], index: Column) -> Column:
    literal = F.array(*[F.lit(v) for v in values])
    return F.get(literal, F.pmod(index, F.lit(len(values))).cast("int"))


def plant(documents: DataFrame) -> DataFrame:
    key = F.col("doc_id")

    def every(n: int, addition: Column) -> Column:
        return F.when(key % n == 0, addition).otherwise(F.lit(""))

    text = F.concat(
        F.col("text"),
        F.lit(" Dr. Ames said it is "), pick(PHRASES, key), F.lit(" true."),
        every(3, F.concat(F.lit(" And "), pick(PHRASES, key * 7), F.lit(", no! Is it?"))),
        every(4, F.concat(F.lit(" The "), pick(loaded_words(), key), F.lit(" vote."))),
        every(
            5,
            F.concat(
                F.lit(" Corrupt "), pick(NAMES, key), F.lit(" failed in "), pick(PLACES, key),
                F.lit("."),
            ),
        ),
        every(6, F.lit(" Funds were lost")),
        every(12, F.lit(" by clerks")),
        every(6, F.lit(".")),
        every(7, F.lit(' "We won," she told reporters.')),
        every(11, F.lit(" The plan was VERY bold but not slightly shameful!!")),
        every(9, F.lit(" It isn't heroic. It failed, true heroic. The sky is red and funds were red or were lost.")),
    )
    return documents.withColumn("text", text)


def planted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant(read_documents(spark, sf_dir))


def planted_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_text_articles(planted_documents(spark, sf_dir).select("doc_id", "text"))


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER, "surface string, entity_type string")


def fitted_tfidf(spark: SparkSession, sf_dir: str) -> TfidfModel:
    """Vocabulary of the planted documents, fitted once per application and data set."""
    key = data_version(spark, sf_dir)
    if key not in _FITTED:
        documents = planted_documents(spark, sf_dir).select("doc_id", "text")
        _FITTED[key] = TfidfModel.fit(documents)
    return _FITTED[key]


def planted_model(spark: SparkSession, sf_dir: str) -> LinearTextModel:
    tfidf = fitted_tfidf(spark, sf_dir)
    return LinearTextModel(tfidf, coefficients_by_index(tfidf, WEIGHTS), BIAS)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label): planted documents that carry a label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.col("toxic").cast("int").alias("label")
    )
    return planted_documents(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id")


def predictions(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, kept columns, label, probability, prediction) of the labelled documents."""
    scored = planted_model(spark, sf_dir).score(
        labelled_documents(spark, sf_dir), "text", "probability"
    )
    return scored.select(
        "doc_id",
        *keep,
        F.col("label").cast("bigint").alias("label"),
        "probability",
        F.when(F.col("probability") >= 0.5, 1).otherwise(0).cast("bigint").alias("prediction"),
    )
