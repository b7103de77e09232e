"""Ten linguistic features per text, as an operator and as an ML transformer."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions.numeric import ratio, round_to
from framescope.functions.text import (
    count_char,
    is_blank,
    raw_words,
    split_fragments,
    word_count,
)
from framescope.operators.lexicon import loaded_words
from framescope.operators.sentiment import WordTable, auxiliary_scores


def _share_of(words: list[str]) -> Column:
    return ratio(F.size(F.filter("_raw", lambda w: w.isin(words))), F.size("_raw"))


def _passive_fragments() -> Column:
    def indicated(fragment: Column) -> Column:
        lowered, test = F.lower(fragment), None
        for indicator in C.PASSIVE_INDICATORS:
            hit = lowered.contains(indicator)
            test = hit if test is None else test | hit
        return test

    return F.size(F.filter("_fragments", indicated))


def _length_variance() -> tuple[Column, Column]:
    """Population variance of fragment lengths from integer sums, scaled and capped."""
    lengths = F.transform("_fragments", lambda f: word_count(f).cast("bigint"))
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("q"))
    sums = F.aggregate(
        lengths,
        zero,
        lambda acc, n: F.struct((acc["s"] + n).alias("s"), (acc["q"] + n * n).alias("q")),
    )
    count = F.size("_fragments").cast("bigint")
    variance = (count * F.col("_sums.q") - F.col("_sums.s") * F.col("_sums.s")).cast("double") / (
        F.greatest(count * count, F.lit(1)).cast("double")
    )
    return sums, F.when(count > 1, F.least(variance / 100.0, F.lit(1.0))).otherwise(F.lit(0.0))


def linguistic_features(
    df: DataFrame, text: str = "text", words: WordTable = C.SENTIMENT_WORDS
) -> DataFrame:
    """Add the ten feature columns; a blank text gives ten zeros."""
    body = F.coalesce(F.col(text), F.lit(""))
    sums, variance = _length_variance()
    scored = (
        auxiliary_scores(df, text, words)
        .withColumn("_raw", raw_words(text))
        .withColumn("_fragments", split_fragments(text))
        .withColumn("_sums", sums)
    )
    quotes = F.floor(count_char(body, '"') / 2)
    n_fragments = F.size("_fragments")
    formulas = {
        "passive_rate": ratio(_passive_fragments(), n_fragments),
        "lexicon_score": _share_of(loaded_words()),
        "subjectivity": F.col("subjectivity"),
        "emotion_intensity": F.abs("compound"),
        "sent_length_variance": variance,
        "punctuation_density": ratio(
            count_char(body, "!") + count_char(body, "?"), F.size("_raw")
        ),
        "first_person_rate": _share_of(C.FIRST_PERSON),
        "quote_density_inverted": 1.0 - F.least(ratio(quotes, n_fragments), F.lit(1.0)),
        "unique_word_ratio": ratio(F.size(F.array_distinct("_raw")), F.size("_raw")),
        "stop_word_ratio": _share_of(C.STOP_WORDS),
    }
    blank = is_blank(text)
    return scored.select(
        *[F.col(c) for c in df.columns],
        *[
            F.when(blank, F.lit(0.0)).otherwise(expr).alias(name)
            for name, expr in formulas.items()
        ],
    )


def feature_map(featured: DataFrame) -> DataFrame:
    """Add ``linguistic``: feature name -> value rounded to four digits."""
    names = F.array(*[F.lit(n) for n in C.FEATURE_NAMES])
    values = F.array(*[round_to(F.col(n)) for n in C.FEATURE_NAMES])
    return featured.withColumn("linguistic", F.map_from_arrays(names, values))


class LinguisticFeatures(
    Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Pipeline stage that appends the ten feature columns."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text") -> None:
        super().__init__()
        self._setDefault(inputCol="text")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return linguistic_features(dataset, self.getInputCol())
