"""Evaluation of ``(label, prediction, probability)`` tables with plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.operators.ranking import running_sums
from framescope.session import materialize


def _count_if(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).cast("bigint")


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, macro, weighted, and accuracy."""
    matrix = confusion_matrix(scored)
    cells = matrix.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n"))
                    .otherwise(F.lit(0))
                    .alias("tp"),
                    F.col("n").alias("actual"),
                    F.lit(0).cast("bigint").alias("predicted"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("actual"),
                    F.col("n").alias("predicted"),
                ),
            )
        )
    )
    per_class = (
        cells.groupBy("class")
        .agg(
            F.sum("tp").alias("tp"),
            F.sum("actual").alias("support"),
            F.sum("predicted").alias("predicted"),
        )
        .select(
            "class",
            "tp",
            "support",
            (F.col("tp") / F.greatest("predicted", F.lit(1))).alias("precision"),
            (F.col("tp") / F.greatest("support", F.lit(1))).alias("recall"),
            (2.0 * F.col("tp") / F.greatest(F.col("predicted") + F.col("support"), F.lit(1))).alias(
                "f1"
            ),
        )
    )
    names = ["precision", "recall", "f1"]
    weight = F.greatest(F.sum("support"), F.lit(1))
    summary = per_class.agg(
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[(F.sum(F.col(n) * F.col("support")) / weight).alias(f"weighted_{n}") for n in names],
        (F.sum("tp") / weight).alias("accuracy"),
        F.sum("support").alias("support"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("row"),
                *[F.col(f"{kind}_{n}").alias(n) for n in names],
                "support",
            )
            for kind in ("macro", "weighted")
        ],
        F.struct(
            F.lit("accuracy").alias("row"), *[F.col("accuracy").alias(n) for n in names], "support"
        ),
    )
    return per_class.select(
        F.col("class").cast("string").alias("row"), *names, "support"
    ).unionByName(summary.select(F.inline(rows)))


def score_counts(scored: DataFrame, score: str = "probability") -> DataFrame:
    """Positives and negatives per distinct score: ties collapse before any ranking.

    Rows without a score (null or NaN) are in no ranking and are left out, after the counts are stored:
    before that, the filter would reach the scoring. Written once, because ranking reads it three times
    (edges, totals, rows).
    """
    counts = scored.groupBy(F.col(score).alias("score")).agg(
        _count_if(F.col("label") == 1).alias("positives"),
        _count_if(F.col("label") != 1).alias("negatives"),
    )
    return materialize(counts, "score-counts").filter(F.col("score").isNotNull() & ~F.isnan("score"))


def score_counts_by(scored: DataFrame, group: str, score: str = "probability") -> DataFrame:
    """As ``score_counts``, for each value of a column, and not stored."""
    return scored.groupBy(group, F.col(score).alias("score")).agg(
        _count_if(F.col("label") == 1).alias("positives"),
        _count_if(F.col("label") != 1).alias("negatives"),
    )


def roc_auc(scored: DataFrame, score: str = "probability") -> DataFrame:
    """Exact area under the ROC curve (Mann-Whitney, ties count half)."""
    return auc_of_counts(score_counts(scored, score))


def auc_of_counts(counts: DataFrame) -> DataFrame:
    ranked = running_sums(counts, "score", ["negatives"])
    positives, negatives = F.col("positives"), F.col("negatives")
    won = F.sum(2 * positives * F.col("negatives_before") + positives * negatives)
    pairs = F.sum("positives") * F.sum("negatives")
    return ranked.agg(
        won.alias("doubled_wins"),
        F.sum("positives").alias("positives"),
        F.sum("negatives").alias("negatives"),
        (won / (2.0 * F.greatest(pairs, F.lit(1)))).alias("roc_auc"),
    )


def roc_pr_points(scored: DataFrame, score: str = "probability") -> DataFrame:
    """True and false positive rate, precision and recall at every distinct threshold."""
    counts = score_counts(scored, score)
    ranked = running_sums(counts, "score", ["positives", "negatives"], descending=True)
    totals = counts.agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n")).first()
    p, n = int(totals["p"] or 0), int(totals["n"] or 0)
    tp = F.col("positives_before") + F.col("positives")
    fp = F.col("negatives_before") + F.col("negatives")
    return ranked.select(
        F.col("score").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        (tp / F.lit(float(max(p, 1)))).alias("tpr"),
        (fp / F.lit(float(max(n, 1)))).alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
    )


def _tenth(score: Column) -> Column:
    return F.least(F.floor(score * 10), F.lit(9)).cast("bigint")


def calibration_bins(scored: DataFrame, score: str = "probability") -> DataFrame:
    """Mean predicted against observed share per tenth. Sums are exact decimals."""
    exact = F.col(score).cast("decimal(18,6)")
    return (
        scored.groupBy(_tenth(F.col(score)).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(exact).alias("predicted_sum"),
            _count_if(F.col("label") == 1).alias("positives"),
        )
        .select(
            "bin",
            "n",
            (F.col("predicted_sum").cast("double") / F.col("n")).alias("mean_predicted"),
            (F.col("positives") / F.col("n")).alias("observed"),
        )
    )


def probability_histogram(scored: DataFrame, score: str = "probability") -> DataFrame:
    return scored.groupBy("label", _tenth(F.col(score)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def error_analysis(scored: DataFrame) -> DataFrame:
    """Misclassified rows, with the kind of error."""
    kind = F.when(F.col("prediction") == 1, "false positive").otherwise("false negative")
    return scored.filter(F.col("label") != F.col("prediction")).withColumn("error_type", kind)


def top_coefficients(weights: DataFrame, k: int = 20) -> DataFrame:
    """Largest and smallest coefficients, with coefficient x idf."""
    scaled = weights.withColumn("coefficient_idf", F.col("coefficient") * F.col("idf"))
    highest = scaled.orderBy(F.desc("coefficient"), "term").limit(k)
    lowest = scaled.orderBy("coefficient", "term").limit(k)
    return highest.withColumn("side", F.lit("biased")).unionByName(
        lowest.withColumn("side", F.lit("neutral"))
    )


def summary_metrics(
    scored: DataFrame, score: str = "probability", threshold: float = 0.5
) -> dict[str, float]:
    """Accuracy, weighted precision, recall, F1, macro F1 and AUC in one pass over the scores.

    Only the counts per distinct score are kept; the confusion matrix and the ranking both come from
    that table.
    """
    return metrics_of_counts(score_counts(scored, score), threshold)


def metrics_of_counts(counts: DataFrame, threshold: float = 0.5) -> dict[str, float]:
    """The same from stored counts per distinct score."""
    above = F.col("score") >= threshold
    cells = counts.agg(
        *[
            F.coalesce(F.sum(F.when(test, F.col(side))), F.lit(0)).alias(name)
            for name, test, side in (
                ("tp", above, "positives"), ("fp", above, "negatives"),
                ("fn", ~above, "positives"), ("tn", ~above, "negatives"),
            )
        ]
    ).first()
    total = max(sum(cells), 1)
    per_class = []
    for hit, wrong, missed in (
        (cells["tn"], cells["fn"], cells["fp"]), (cells["tp"], cells["fp"], cells["fn"]),
    ):
        precision, recall = hit / max(hit + wrong, 1), hit / max(hit + missed, 1)
        f1 = 2 * hit / max(2 * hit + wrong + missed, 1)
        per_class.append((precision, recall, f1, hit + missed))
    present = [c for c in per_class if c[3] > 0]
    weighted = [sum(c[i] * c[3] for c in per_class) / total for i in range(3)]
    return {
        "accuracy": (cells["tp"] + cells["tn"]) / total,
        "precision": weighted[0],
        "recall": weighted[1],
        "f1": weighted[2],
        "f1_macro": sum(c[2] for c in present) / max(len(present), 1),
        "roc_auc": auc_of_counts(counts).first()["roc_auc"],
    }
