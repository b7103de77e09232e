"""Mixing sources to target weights by Poisson replication.

The target share of a source over its actual share is its repetition rate. A uniform number that
depends on the seed and the document alone is put through the inverse of the Poisson distribution
with that mean; the document is repeated that often, and all copies are shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import small_join, uniform, whole_text

SEED = "mix-1"
#: Shares follow the sizes of sources to this power: 1 leaves them as they are, 0 makes them equal.
TEMPERATURE = 0.5
#: Copies made for each document on average.
EPOCHS = 2.0
UNKNOWN = "(none)"


def source_name(name: str = "source") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN))


def source_rates(docs: DataFrame, temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """(source, rate): how often a document of each source is repeated on average.

    Target weights are source sizes, in UTF-8 bytes of text, to the power of the temperature; the
    whole mix has ``epochs`` times the bytes of the input. An own table of (source, rate) may be
    given to ``mix_sources`` in its place. A source without any byte counts as one byte.
    """
    size = F.greatest(F.sum(F.octet_length(whole_text())), F.lit(1)).cast("double")
    sizes = docs.groupBy(source_name().alias("source")).agg(size.alias("bytes"))
    return weighted_rates(sizes.withColumn("weight", F.pow("bytes", F.lit(temperature))), epochs)


def weighted_rates(sizes: DataFrame, epochs: float) -> DataFrame:
    """Rates of (source, bytes, weight); a weight need not be normalised."""
    totals = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.lit(epochs) * F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.col("bytes")
    return sizes.crossJoin(F.broadcast(totals)).select("source", rate.alias("rate"))  # one row of totals


def poisson_copies(draw: Column, rate: Column) -> Column:
    """Least k at which the Poisson distribution with mean ``rate`` exceeds the draw.

    A rate above 20 is the sum of equal shares; each takes its own draw from the 52 bits of the
    first, so no probability underflows.
    """
    parts = F.greatest(F.ceil(rate / 20.0), F.lit(1)).cast("int")
    mean = rate / parts
    last = F.ceil(mean + 10 * F.sqrt(mean) + 12).cast("int")

    def one(u: Column) -> Column:
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))

        def step(state: Column, k: Column) -> Column:
            p = state["p"] * mean / k
            more = state["below"] <= u
            return F.struct(
                p.alias("p"), (state["below"] + p).alias("below"), F.when(more, k).otherwise(state["k"]).alias("k")
            )

        return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["k"])

    bits = (draw * float(1 << 52)).cast("bigint").cast("string")
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: F.when(i == 1, draw).otherwise(uniform(bits, i.cast("string"))))
    return F.aggregate(F.transform(draws, one), F.lit(0), lambda total, k: total + k)


def copies_of(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """(row, name, copies) of every document: the row as one struct, what it draws by, 0 copies or more.

    The draw depends on the seed, the identifier, the source and a digest of the text; without an identifier
    on the row's place in the table too. Rows that repeat identifier, source and text get equal
    counts. A source without a rate is left out of the mix: 0 copies.
    """
    place = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), place), F.md5(whole_text()))
    # The row travels as one struct, so no column of the input can clash with those added here.
    keyed = docs.select(F.struct("*").alias("row"), name.alias("name"), source_name().alias("source"))
    joined = small_join(keyed, rates.select("source", "rate"), "source")
    drawn = joined.withColumn("draw", uniform(F.lit(seed), F.col("name"), F.col("source")))
    count = poisson_copies(F.col("draw"), F.col("rate"))
    return drawn.select("row", "name", F.coalesce(count, F.lit(0)).alias("copies"))


def mix_sources(docs: DataFrame, rates: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """Every document as often as its draw says, in a globally shuffled order.

    Adds ``copy`` (0, 1, ...) and ``position``, a number in [0, 1) by which the result is
    range-partitioned and sorted; both names replace columns of the input, all others are returned as they
    are. Null texts, sources and identifiers are ordinary values. Rows that repeat identifier and text have equal
    positions and may lie in several partitions. An empty table gives an empty mix.
    """
    if rates is None:
        rates = source_rates(docs)
    counted = copies_of(docs.drop("copy", "position"), rates, seed).filter("copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    order = uniform(F.lit(seed), F.lit("order"), F.col("name"), F.col("copy").cast("string"))
    placed = copies.select("row", "copy", order.alias("position"), F.monotonically_increasing_id().alias("tie"))
    mixed = placed.repartitionByRange("position", "tie").sortWithinPartitions("position", "copy")
    return mixed.select("row.*", "copy", "position")
