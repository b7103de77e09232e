"""Linear bias classifier applied as a column expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.functions.binding import settle
from framescope.functions.numeric import round_to
from framescope.functions.text import is_blank
from framescope.operators.tfidf import TfidfModel


@dataclass(frozen=True)
class LinearTextModel:
    """Vocabulary, one coefficient per term and an intercept."""

    tfidf: TfidfModel
    coefficients: Sequence[float]
    bias: float = 0.0

    def score(
        self, df: DataFrame, text: str = "text", output: str = "ml_probability"
    ) -> DataFrame:
        """Add P(biased), rounded to four digits; a blank text scores 0. No shuffle.

        The column is settled, so a filter on it does not run the classifier again.
        """
        beta = F.from_json(F.lit(str([float(c) for c in self.coefficients])), "array<double>")
        margin = F.aggregate(
            "_weights",
            F.lit(0.0),
            lambda a, w: a + w["weight"] * F.get(beta, w["index"]),
        )
        probability = round_to(1.0 / (1.0 + F.exp(-(margin + F.lit(float(self.bias))))))
        scored = (
            self.tfidf.weigh(df, text)
            .withColumn(output, F.when(is_blank(text), F.lit(0.0)).otherwise(probability))
            .drop("_weights")
        )
        return settle(scored, output)

    def weight_table(self, df: DataFrame) -> DataFrame:
        """(term, coefficient, idf) as a table."""
        rows = [
            (t, float(c), float(i))
            for t, c, i in zip(
                self.tfidf.terms, self.coefficients, self.tfidf.idf, strict=True
            )
        ]
        return df.sparkSession.createDataFrame(rows, "term string, coefficient double, idf double")
