"""TF-IDF over word n-grams: relational fitting and a row-local transform.

Weights follow the published smooth, sublinear form: ``(1 + ln tf) * (ln((1+n)/(1+df)) + 1)``, each
row scaled to unit length. Spark's own ``IDF`` and ``CountVectorizer`` use other formulas.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.functions.binding import let
from framescope.functions.lookup import literal_lookup
from framescope.functions.text import ngrams_of, vector_tokens
from framescope.operators.term_sketch import (
    count_known_terms,
    count_terms_in,
    known_counts,
    runs_of_rows,
    term_sketch,
    term_tree,
    threshold_at,
)
from framescope.session import materialize, scratch_path

#: Vocabularies of up to this many terms are looked up by expressions of the row, without Python.
ROW_LOCAL_TERMS = 2_000
#: Tokens of the rows that are weighed at once for several vocabularies.
WEIGHED_TOKENS = 500_000
#: Weight tables of up to this many rows are broadcast.
MAX_BROADCAST_WEIGHTS = 500_000


def word_ngrams(
    df: DataFrame, text: str = "text", low: int = 1, high: int = 3, output: str = "ngrams"
) -> DataFrame:
    """Add the n-gram array of the analyser."""
    return df.withColumn(output, let(vector_tokens(text), lambda t: ngrams_of(t, low, high)))


def run_lengths(ordered: Column) -> Column:
    """(value, n) for every distinct value of a sorted array, in one linear pass."""

    def starts_of(found: Column) -> Column:
        places = F.transform(
            found, lambda v, k: F.struct(v.alias("value"), k.cast("int").alias("k"))
        )
        return F.filter(
            places,
            lambda e: (e["k"] == 0)
            | (F.get(found, F.greatest(e["k"] - 1, F.lit(0))) != e["value"]),
        )

    def lengths(found: Column) -> Column:
        def counted(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda e, j: F.struct(
                    e["value"].alias("value"),
                    (F.coalesce(F.get(starts, j + 1)["k"], F.size(found)) - e["k"]).alias("n"),
                ),
            )

        return let(starts_of(found), counted)

    return let(ordered, lengths)


def term_counts(
    df: DataFrame, text: str = "text", key: str = "doc_id", low: int = 1, high: int = 3
) -> DataFrame:
    """(key, term, tf).

    The terms of a document are sorted and counted inside its row, so counting needs no shuffle and
    the rows that leave it are already distinct per document.
    """
    ordered = F.sort_array(let(vector_tokens(text), lambda t: ngrams_of(t, low, high)))
    return (
        df.select(key, F.inline_outer(run_lengths(ordered)))
        .filter("value IS NOT NULL")
        .select(key, F.col("value").alias("term"), F.col("n").cast("bigint").alias("tf"))
    )


def vocabulary(
    counts: DataFrame, n_docs: int, min_df: int = 2, max_features: int = 25_000
) -> DataFrame:
    """(term, df, total, idf) of the most frequent terms; ties in frequency go to the lower term.

    The result is bounded by ``max_features``.
    """
    sums = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    return _most_frequent(sums, n_docs, min_df, max_features)


def _most_frequent(sums: DataFrame, n_docs: int, min_df: int, max_features: int) -> DataFrame:
    idf = F.log((1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    kept = sums.filter(F.col("df") >= min_df)
    return kept.orderBy(F.desc("total"), "term").limit(max_features).withColumn("idf", idf)


def frequent_terms(
    df: DataFrame, text: str, low: int, high: int, min_df: int = 2, max_features: int = 25_000
) -> list[Row]:
    """The rows of ``vocabulary``, exactly, without shuffling every n-gram.

    Bucket sums of hashed terms bound the count of every term from above, so a bucket below the count of
    the last term kept holds none that is kept. Terms are counted in the buckets of a guessed bound only; when
    enough of them reach the bound, no other term can. Else the count of the last one found is a bound that
    holds, so a second pass is the last; the guess is only lowered if too few terms were found.
    """
    tokens = df.select(F.coalesce(vector_tokens(text), F.array().cast("array<string>")).alias("tokens"))
    n_docs, sums = term_sketch(tokens, low, high)
    rank = 2 * max_features
    bound = max(threshold_at(sums, rank), min_df)
    while True:
        counted = count_terms_in(tokens, sums >= bound, low, high)
        rows = _most_frequent(counted, n_docs, min_df, max_features).collect()
        full = len(rows) == max_features
        if bound == min_df or (full and rows[-1]["total"] >= bound):
            return rows
        rank *= 4
        # Enough terms have this count already, so a term that is kept cannot have less.
        bound = max(rows[-1]["total"] if full and rows else threshold_at(sums, rank), min_df)


def counted_terms(text: str, low: int = 1, high: int = 3) -> Column:
    """The distinct terms of a text with their counts, as an array of (value, n)."""
    return run_lengths(F.sort_array(let(vector_tokens(text), lambda t: ngrams_of(t, low, high))))


def fold_vocabularies(
    counted: DataFrame, folds: int, low: int, high: int, min_df: int = 2, max_features: int = 25_000
) -> list[TfidfModel]:
    """For each fold the vocabulary of all rows outside of it, from one aggregate.

    ``counted`` is a stored table of (fold, terms), ``terms`` as by ``counted_terms``. Rows and
    occurrences of a term are summed per fold at once; what a fold's vocabulary may see is the total
    less the fold's own share.
    """
    rows = counted.groupBy("fold").count().collect()
    size = {r["fold"]: r["count"] for r in rows}
    per_fold = [
        part
        for k in range(folds)
        for part in (
            F.count(F.when(F.col("fold") == k, 1)).alias(f"df_{k}"),
            F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("t.n"))), F.lit(0)).alias(f"n_{k}"),
        )
    ]
    exploded = counted.select("fold", F.explode("terms").alias("t"))
    sums = exploded.groupBy(F.col("t.value").alias("term")).agg(
        F.count(F.lit(1)).alias("df"), F.sum("t.n").cast("bigint").alias("total"), *per_fold
    )
    stored = materialize(sums.filter(F.col("df") >= min_df), "fold-terms")
    models = []
    for k in range(folds):
        n_docs = sum(size.values()) - size.get(k, 0)
        inside = stored.select(
            "term", (F.col("df") - F.col(f"df_{k}")).alias("df"), (F.col("total") - F.col(f"n_{k}")).alias("total")
        )
        kept = _most_frequent(inside, n_docs, min_df, max_features).collect()
        ordered = sorted((r["term"], r["idf"]) for r in kept)
        models.append(TfidfModel(tuple(t for t, _ in ordered), tuple(i for _, i in ordered), low, high))
    return models


def outside_vocabularies(
    tokens: DataFrame, folds: int, low: int, high: int, min_df: int = 2, max_features: int = 25_000
) -> list[TfidfModel]:
    """As ``fold_vocabularies``, from a stored table of (fold, tokens), as ``frequent_terms`` finds them.

    Bucket sums and counts of a fold are subtracted from the totals; terms are counted once for all folds.
    """
    inside = [tokens.filter(F.col("fold") == k).select("tokens") for k in range(folds)]
    sketches = [term_sketch(part, low, high) for part in inside]
    n_docs = [sum(n for j, (n, _) in enumerate(sketches) if j != k) for k in range(folds)]
    total = np.zeros(len(sketches[0][1]), np.int64)
    for _, sums in sketches:
        total += sums
    rank, found, pending = 2 * max_features, {}, set(range(folds))
    while pending:
        bounds, wanted = {}, np.zeros(len(total), bool)
        for k in pending:  # one fold's difference at a time
            others = total - sketches[k][1]
            bounds[k] = max(threshold_at(others, rank), min_df)
            wanted |= others >= bounds[k]
            del others
        counted = [count_terms_in(part, wanted, low, high).withColumn("fold", F.lit(k)) for k, part in enumerate(inside)]
        stored = materialize(reduce(DataFrame.unionByName, counted), "fold-terms")
        for k, bound in bounds.items():
            sums = stored.filter(F.col("fold") != k).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
            rows = _most_frequent(sums, n_docs[k], min_df, max_features).collect()
            if bound == min_df or (len(rows) == max_features and rows[-1]["total"] >= bound):
                ordered = sorted((r["term"], r["idf"]) for r in rows)
                found[k] = TfidfModel(tuple(t for t, _ in ordered), tuple(i for _, i in ordered), low, high)
                pending.discard(k)
        rank *= 4
    return [found[k] for k in range(folds)]


def tfidf(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    low: int = 1,
    high: int = 3,
    min_df: int = 2,
    max_features: int = 25_000,
) -> DataFrame:
    """Long form (key, term, tf, weight).

    The vocabulary, bounded by ``max_features``, is fitted first; each text is then weighed inside its
    row, so neither texts nor weights are shuffled.
    """
    model = TfidfModel.fit(df, text, key, low, high, min_df, max_features)
    terms = F.from_json(F.lit(json.dumps(model.terms)), "array<string>")
    rows = model.weigh(df.select(key, text), text).select(key, F.inline_outer("_weights"))
    return rows.filter("index IS NOT NULL").select(
        key, F.get(terms, "index").alias("term"), F.col("n").cast("bigint").alias("tf"), "weight"
    )


def linear_score(
    weighted: DataFrame, weights: DataFrame, bias: float = 0.0, key: str = "doc_id"
) -> DataFrame:
    """Joined form of linear scoring for weight tables of any size.

    Only documents with at least one vocabulary term have a row in ``weighted``. A table of counted, bounded
    size is broadcast, so a document's rows stay together and are summed before the shuffle.
    """
    small = weights.limit(MAX_BROADCAST_WEIGHTS + 1).count() <= MAX_BROADCAST_WEIGHTS
    joined = weighted.join(F.broadcast(weights) if small else weights, "term", "left")
    margin = F.sum(F.col("weight") * F.coalesce("coefficient", F.lit(0.0))) + F.lit(bias)
    return joined.groupBy(key).agg((1.0 / (1.0 + F.exp(-margin))).alias("ml_probability"))


def sparse_struct(weights: str, size: int) -> Column:
    """The fields of a sparse ML vector from an array of (index, weight)."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform(weights, lambda w: w["index"]).alias("indices"),
        F.transform(weights, lambda w: w["weight"]).alias("values"),
    )


def weigh_side_by_side(
    df: DataFrame, tokens: str, models: Sequence[TfidfModel]
) -> tuple[DataFrame, int, list[tuple[np.ndarray, np.ndarray]]]:
    """The rows' vectors by all models' vocabularies, stored once; the number of columns; and each model's columns.

    A column of word arrays is replaced by ``terms``, a vector of ``1 + ln tf`` by the terms of any model, and by
    ``shares``, per model what makes the row's own vector unit length (0 without a term). A model's columns are their
    places in the vector and their idf: its weight of a term is value times idf times share. One Python worker a task
    counts the terms, a bounded number of rows at a time; the models have the same orders of n-grams. A null array
    counts as empty.
    """
    low, high = models[0].low, models[0].high
    terms = sorted({term for model in models for term in model.terms})
    place = {term: i for i, term in enumerate(terms)}
    size = max(len(terms), 1)
    views = [(np.array([place[t] for t in m.terms], np.int64), np.array(m.idf, float)) for m in models]
    idfs = np.zeros((len(models), size))
    for of_model, (places, idf) in zip(idfs, views, strict=True):
        of_model[places] = idf
    known, levels = term_tree(terms, high)
    shared = df.sparkSession.sparkContext.broadcast((pa.array(known, pa.string()), levels, idfs))
    kept = [c for c in df.columns if c != tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, levels, idfs = shared.value
        for batch in batches:
            words = batch.column(tokens)
            for start, n_rows in runs_of_rows(words, WEIGHED_TOKENS):
                row, found, n = known_counts(words.slice(start, n_rows), vocabulary, levels, size, low)
                scaled = np.log(n) + 1.0
                norms = np.stack([np.sqrt(np.bincount(row, (scaled * idf[found]) ** 2, n_rows)) for idf in idfs], axis=1)
                shares = np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0)
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n_rows))), pa.int32())
                vector = pa.StructArray.from_arrays(
                    [
                        pa.array(np.zeros(n_rows, np.int8)), pa.array(np.full(n_rows, size, np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(scaled)),
                    ],
                    names=["type", "size", "indices", "values"],
                )
                every = pa.array(np.arange(n_rows + 1) * len(idfs), pa.int32())
                part = batch.slice(start, n_rows)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], vector, pa.ListArray.from_arrays(every, pa.array(shares.ravel()))],
                    [*kept, "terms", "shares"],
                )

    fields = [T.StructField("terms", VectorUDT.sqlType()), T.StructField("shares", T.ArrayType(T.DoubleType()))]
    given = df.withColumn(tokens, F.coalesce(tokens, F.array().cast("array<string>")))
    return given.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], *fields])), size, views


def store_vectors(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Write a frame whose named columns hold a vector's fields, and read them back as ML vectors.

    A vector is stored as just this struct, so only the schema of the reader differs and no row goes through Python.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT()) if f.name in columns else f for f in df.schema.fields]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary. Size is bounded by ``max_features``, so it may live on the driver."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    low: int = 1
    high: int = 3

    @staticmethod
    def fit(
        df: DataFrame,
        text: str = "text",
        key: str = "doc_id",
        low: int = 1,
        high: int = 3,
        min_df: int = 2,
        max_features: int = 25_000,
    ) -> TfidfModel:
        rows = frequent_terms(df.select(text), text, low, high, min_df, max_features)
        ordered = sorted((r["term"], r["idf"]) for r in rows)
        return TfidfModel(
            tuple(t for t, _ in ordered), tuple(i for _, i in ordered), low, high
        )

    @property
    def size(self) -> int:
        return len(self.terms)

    def weigh(self, df: DataFrame, text: str, output: str = "_weights") -> DataFrame:
        """Add an array of (index, weight, n) of unit length, sorted by index, without a shuffle.

        Term indexes are sorted and counted by run length, so the cost is linear-logarithmic in the
        length of a text, however often a term repeats.
        """
        if self.size > ROW_LOCAL_TERMS:
            # Many terms: tokens are matched as numbers, batch by batch; only counts of found terms return.
            return self.weigh_tokens(df.withColumn("_words", vector_tokens(text)), "_words", output).drop("_words")
        grams = let(vector_tokens(text), lambda t: ngrams_of(t, self.low, self.high))
        found = F.transform(grams, literal_lookup({t: i for i, t in enumerate(self.terms)}, "int"))
        ordered = F.sort_array(F.filter(found, lambda i: i.isNotNull()))
        return df.withColumn(output, self._unit_weights(run_lengths(ordered)))

    def weigh_tokens(self, df: DataFrame, tokens: str, output: str) -> DataFrame:
        """As ``weigh``, from a column of word arrays; texts split once serve several vocabularies."""
        counted = count_known_terms(df, F.col(tokens), self.terms, self.low, self.high, "_counts")
        return counted.withColumn(output, self._unit_weights(F.col("_counts"))).drop("_counts")

    def weigh_counted(self, counted: Column | str) -> Column:
        """As ``weigh``, from a text's (value, n) terms; texts counted once serve several vocabularies."""
        index = literal_lookup({t: i for i, t in enumerate(self.terms)}, "int")
        found = F.transform(counted, lambda r: F.struct(index(r["value"]).alias("value"), r["n"].cast("int").alias("n")))
        return self._unit_weights(F.sort_array(F.filter(found, lambda r: r["value"].isNotNull())))

    def _unit_weights(self, counts: Column) -> Column:
        """(index, weight, n) of unit length from (index, n)."""
        idf = F.from_json(F.lit(str(list(self.idf))), "array<double>")

        def weights(counted: Column) -> Column:
            return F.transform(
                counted,
                lambda r: F.struct(
                    r["value"].alias("index"),
                    r["n"].alias("n"),
                    ((F.log(r["n"].cast("double")) + 1.0) * F.get(idf, r["value"])).alias("raw"),
                ),
            )

        def unit(rows: Column) -> Column:
            norm = F.sqrt(F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["raw"] * r["raw"]))
            return let(
                norm,
                lambda length: F.transform(
                    rows,
                    lambda r: F.struct(
                        r["index"].alias("index"),
                        (r["raw"] / length).alias("weight"),
                        r["n"].alias("n"),
                    ),
                ),
            )

        return let(weights(counts), unit)

    def vectors(self, df: DataFrame, text: str = "text", output: str = "tfidf") -> DataFrame:
        """Add the fields of a sparse vector as a plain struct, computed in the row."""
        return self.weigh(df, text).withColumn(output, sparse_struct("_weights", self.size)).drop("_weights")

    def transform(self, df: DataFrame, text: str = "text", output: str = "tfidf") -> DataFrame:
        """Add a sparse ML vector; the result is a stored table (see ``store_vectors``)."""
        return store_vectors(self.vectors(df, text, output), [output], "vectors")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf, strict=True))]
        return spark.createDataFrame(rows, "index int, term string, idf double")

    def save(self, spark: SparkSession, path: str) -> None:
        grams = F.lit(self.low).alias("low"), F.lit(self.high).alias("high")
        self.table(spark).select("*", *grams).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TfidfModel:
        rows = spark.read.parquet(path).orderBy("index").collect()
        return TfidfModel(
            tuple(r["term"] for r in rows),
            tuple(r["idf"] for r in rows),
            rows[0]["low"],
            rows[0]["high"],
        )


def coefficients_by_index(model: TfidfModel, weights: dict[str, float]) -> Sequence[float]:
    return [float(weights.get(term, 0.0)) for term in model.terms]
