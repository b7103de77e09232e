"""Entity mentions, counts and framing.

Mentions come from a gazetteer table ``(surface, entity_type)``, from any user-supplied mentions table of
the same shape, or from a model run in Arrow batches. A gazetteer is walked like a trie inside the row: a word
that starts no surface is left at once, others are followed as far as the longest surface that starts with them.
Only mentions leave the scan. The gazetteer is counted first: above ``MAX_LITERAL_ENTRIES`` surfaces it is
joined on first words instead, one row per capital word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope import constants as C
from framescope.functions.binding import let
from framescope.functions.labels import frame_label
from framescope.functions.lookup import MAX_LITERAL_ENTRIES, literal_lookup
from framescope.functions.text import WORD, is_blank, raw_words, split_sentences_abbrev

MENTION_FIELDS = [
    T.StructField("sent_idx", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("entity", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("positive_hits", T.LongType()),
    T.StructField("negative_hits", T.LongType()),
]


def _frame_hits(sentence: Column, words: list[str]) -> Column:
    vocabulary = F.array(*[F.lit(w) for w in words])
    return F.size(F.array_intersect(raw_words(sentence), vocabulary)).cast("bigint")


def _first_word(surface: str) -> str:
    return surface.split(" ")[0]


def _trie(entries: Sequence[tuple[str, str]]) -> Callable[[Column], Column]:
    """Return ``word array -> array of (pos, surface, entity_type)`` for surfaces that start with a capital."""
    types: dict[str, list[str]] = {}
    longest: dict[str, int] = {}
    for surface, kind in entries:
        first = _first_word(surface)
        if first and unicodedata.category(first[0]) == "Lu":
            types.setdefault(surface, []).append(kind)
            longest[first] = max(longest.get(first, 0), surface.count(" ") + 1)
    followed, named = literal_lookup(longest, "int"), literal_lookup(types, "array<string>")

    def walk(words: Column) -> Column:
        starts = F.filter(
            F.transform(words, lambda w, i: F.struct(i.cast("bigint").alias("pos"), followed(w).alias("longest"))),
            lambda s: s["longest"].isNotNull(),
        )

        def surfaces(s: Column) -> Column:
            rest = (F.size(words) - s["pos"]).cast("int")
            runs = F.transform(
                F.sequence(F.lit(1), F.least(s["longest"], rest)),
                lambda n: F.array_join(F.slice(words, (s["pos"] + 1).cast("int"), n), " "),
            )
            found = F.transform(runs, lambda r: F.struct(r.alias("surface"), named(r).alias("types")))
            return F.flatten(
                F.transform(
                    F.filter(found, lambda f: f["types"].isNotNull()),
                    lambda f: F.transform(
                        f["types"],
                        lambda t: F.struct(s["pos"].alias("pos"), f["surface"].alias("surface"), t.alias("entity_type")),
                    ),
                )
            )

        return F.flatten(F.transform(starts, surfaces))

    return walk


def _words(sentence: str) -> Column:
    return F.regexp_extract_all(F.col(sentence), F.lit(f"([{WORD}]+)"), F.lit(1))


def _hits(sentence: str) -> list[Column]:
    return [
        _frame_hits(F.col(sentence), words).alias(name)
        for name, words in (("positive_hits", C.POSITIVE_FRAME_WORDS), ("negative_hits", C.NEGATIVE_FRAME_WORDS))
    ]


def _small(gazetteer: DataFrame, max_words: int | None) -> list[tuple[str, str]] | None:
    """The entries of a gazetteer that may live in a literal; None if there are more."""
    rows = gazetteer.select("surface", "entity_type").limit(MAX_LITERAL_ENTRIES + 1).collect()
    if len(rows) > MAX_LITERAL_ENTRIES:
        return None
    return [(r[0], r[1]) for r in rows if max_words is None or r[0].count(" ") < max_words]


def _kept(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.filter(F.col("entity_type").isin(list(C.ENTITY_TYPES)) & F.col("surface").isNotNull())


def _walked(df: DataFrame, entries: list[tuple[str, str]], text: str, key: str, marked: bool) -> DataFrame:
    """Mentions of all documents, found in the row.

    With ``marked`` a document's first sentence that holds none gives a row without an entity, so that every
    document has a row.
    """
    walk = _trie(entries)
    # Once per document: beside a generator it would be computed for every sentence.
    texts = df.select(key, F.col(text).alias("_text"), *([is_blank(text).alias("blank")] if marked else []))
    # The outer generators keep Spark from testing the generated array in a filter of its own, which
    # would evaluate it twice.
    sentences = texts.select(
        key, *(["blank"] if marked else []),
        F.posexplode_outer(split_sentences_abbrev("_text")).alias("sent_idx", "sentence"),
    )

    def framed(found: Column) -> Column:
        """Frame words are counted only in sentences with a mention."""
        return let(
            F.struct(*_hits("sentence")),
            lambda h: F.transform(
                found,
                lambda m: F.struct(
                    m["pos"].alias("pos"), F.trim(m["surface"]).alias("entity"), m["entity_type"].alias("entity_type"),
                    h["positive_hits"].alias("positive_hits"), h["negative_hits"].alias("negative_hits"),
                ),
            ),
        )

    mentions = let(let(_words("sentence"), walk), lambda found: F.when(F.size(found) > 0, framed(found)))
    rows = sentences.select(
        key, F.col("sent_idx").cast("bigint").alias("sent_idx"), *(["blank"] if marked else []), F.inline_outer(mentions)
    )
    named = F.col("entity").isNotNull()
    wanted = named | (F.coalesce(F.col("sent_idx"), F.lit(0)) == 0) if marked else named
    return rows.filter(wanted).select(
        key, "sent_idx", "pos", "entity", "entity_type", "positive_hits", "negative_hits", *(["blank"] if marked else [])
    )


def _joined(df: DataFrame, gazetteer: DataFrame, text: str, key: str, max_words: int | None) -> DataFrame:
    """Mentions for a gazetteer of any size: capital words are joined with the first words of surfaces."""
    parts = gazetteer.select(
        "surface", "entity_type", F.split("surface", " ")[0].alias("first"), F.size(F.split("surface", " ")).alias("n")
    )
    if max_words is None:
        max_words = parts.agg(F.max("n")).first()[0] or 1
    sentences = df.select(key, F.posexplode(split_sentences_abbrev(text)).alias("sent_idx", "sentence"))

    def starts(words: Column) -> Column:
        every = F.transform(
            words,
            lambda w, i: F.struct(
                i.cast("bigint").alias("pos"), w.alias("first"), F.slice(words, i + 1, max_words).alias("run")
            ),
        )
        return F.filter(every, lambda s: s["first"].rlike(r"^\p{Lu}"))

    capitals = sentences.select(
        key, F.col("sent_idx").cast("bigint").alias("sent_idx"), *_hits("sentence"), F.inline(let(_words("sentence"), starts))
    )
    same = F.array_join(F.slice("run", 1, F.col("n")), " ") == F.col("surface")
    return capitals.join(parts.filter(F.col("n") <= max_words), "first").filter(same).select(
        key, "sent_idx", "pos", F.trim("surface").alias("entity"), "entity_type", "positive_hits", "negative_hits"
    )


def entity_mentions(
    df: DataFrame,
    gazetteer: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    max_words: int | None = None,
) -> DataFrame:
    """One row per mention, with the frame words of its sentence counted along.

    Runs of words are matched up to the length of the longest surface, or up to ``max_words``. Surfaces are
    words with one blank between them; those that contain one another are all found.
    """
    kept = _kept(gazetteer)
    entries = _small(kept, max_words)
    if entries is None:
        return _joined(df, kept, text, key, max_words)
    return _walked(df, entries, text, key, marked=False)


def mentions_with_model(
    df: DataFrame,
    recognise: Callable[[str], list[dict]],
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Mentions from a model; ``recognise`` returns dicts with the mention fields of a text."""
    import pandas as pd

    schema = T.StructType([df.schema[key], *MENTION_FIELDS])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = [
                {key: k, **mention}
                for k, value in zip(batch[key], batch[text], strict=True)
                for mention in recognise(value or "")
            ]
            yield pd.DataFrame(rows, columns=names)

    return df.select(key, text).mapInPandas(run, schema)


def _place() -> Column:
    return F.struct("sent_idx", "pos")


def entity_profile(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, types, first place and framing of every entity of a document, in one grouping.

    The types of an entity are bounded by the number of types there are.
    """
    return (
        mentions.groupBy(key, "entity")
        .agg(
            F.count(F.lit(1)).alias("mention_count"),
            F.max_by("entity_type", _place()).alias("entity_type"),
            F.collect_set("entity_type").alias("types"),
            F.min(_place()).alias("first_place"),
            F.sum("positive_hits").alias("positive"),
            F.sum("negative_hits").alias("negative"),
        )
        .withColumn("net", F.col("positive") - F.col("negative"))
        .withColumn("frame_label", frame_label(F.col("net")))
    )


def entity_counts(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mentions per entity; the type is the last one seen. Names of one character are dropped."""
    named = entity_profile(mentions, key).filter(F.length("entity") >= 2)
    return named.select(key, "entity", "mention_count", "entity_type", "first_place")


def entities_by_type(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct names per document and type, in first-seen order."""
    first = (
        mentions.filter(F.length("entity") >= 2)
        .groupBy(key, "entity_type", "entity")
        .agg(F.min(_place()).alias("first_place"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("first_place", "entity")))
    return (
        first.groupBy(key, "entity_type")
        .agg(F.transform(ordered, lambda e: e["entity"]).alias("entities"))
        .select(key, "entity_type", "entities")
    )


def entity_framing(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Positive, negative and net frame words in the sentences that mention an entity."""
    return entity_profile(mentions, key).select(
        key, "entity", "positive", "negative", "first_place", "net", "frame_label"
    )


def top_entities(mentions: DataFrame, key: str = "doc_id", k: int = 5) -> DataFrame:
    """Most mentioned entities of each document, ties by first mention."""
    names = F.create_map(*[F.lit(x) for pair in C.ENTITY_TYPES.items() for x in pair])
    rank = F.row_number().over(
        Window.partitionBy(key).orderBy(F.desc("mention_count"), "first_place", "entity")
    )
    named = entity_profile(mentions, key).filter(F.length("entity") >= 2)
    return named.withColumn("position", rank).filter(F.col("position") <= k).select(
        key,
        F.col("position").cast("bigint").alias("position"),
        "entity",
        "mention_count",
        F.coalesce(names[F.col("entity_type")], F.lit("Unknown")).alias("type_name"),
        F.col("entity_type").alias("type_code"),
        "frame_label",
    )


def _framed(label: str) -> Column:
    """Names with a frame label in first-seen order, as an aggregate over a profile."""
    chosen = F.collect_list(
        F.when(F.col("frame_label") == label, F.struct("first_place", "entity"))
    )
    return F.transform(F.sort_array(chosen), lambda e: e["entity"])


def _cut_list(k: int) -> Column:
    return F.array_join(F.slice("negatively_framed", 1, k), " | ")


def framed_entity_lists(mentions: DataFrame, key: str = "doc_id", k: int = 5) -> DataFrame:
    """Negative and positive names in first-seen order, plus the cut list for the history."""
    return (
        entity_profile(mentions, key)
        .groupBy(key)
        .agg(
            _framed("Negative Framing").alias("negatively_framed"),
            _framed("Positive Framing").alias("positively_framed"),
        )
        .withColumn("negatively_framed_entities", _cut_list(k))
    )


def ner_summary(
    df: DataFrame, mentions: DataFrame, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One summary row per document, also for documents without any entity.

    Takes mentions from anywhere; ``gazetteer_summary`` reads the texts only once.
    """
    marks = df.select(key, is_blank(text).alias("blank"))
    return _summaries(mentions.unionByName(marks, allowMissingColumns=True), key)


def gazetteer_summary(
    df: DataFrame,
    gazetteer: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    max_words: int | None = None,
) -> DataFrame:
    """``ner_summary`` of the gazetteer's mentions, in one scan of the texts and without a self-join.

    A gazetteer too large for a literal is joined, which reads the texts a second time.
    """
    kept = _kept(gazetteer)
    entries = _small(kept, max_words)
    if entries is None:
        return ner_summary(df, _joined(df, kept, text, key, max_words), text, key)
    return _summaries(_walked(df, entries, text, key, marked=True), key)


def _summaries(marked: DataFrame, key: str) -> DataFrame:
    """Summary rows from mentions and one row without an entity, but with ``blank``, per document."""
    blank = marked.groupBy(key, "entity").agg(
        F.max("blank").alias("blank"),
        F.collect_set("entity_type").alias("types"),
        F.min(_place()).alias("first_place"),
        (F.sum("positive_hits") - F.sum("negative_hits")).alias("net"),
    )
    named = F.coalesce(F.length("entity"), F.lit(0)) >= 2
    is_entity = F.col("entity").isNotNull()
    profile = blank.withColumn("frame_label", F.when(is_entity, frame_label(F.col("net"))))
    rows = profile.groupBy(key).agg(
        F.max("blank").alias("blank"),
        F.count(F.when(named, 1)).alias("total"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(named, F.col("types")))))).alias(
            "type_count"
        ),
        _framed("Negative Framing").alias("negatively_framed"),
        _framed("Positive Framing").alias("positively_framed"),
    )

    def around(column: str, word: str) -> Column:
        names = F.array_join(F.slice(column, 1, 3), ", ")
        sentence = F.concat(F.lit(word + C.FRAMING_AROUND), names, F.lit("."))
        return F.when(F.size(column) > 0, sentence)

    found = F.concat_ws(
        " ",
        F.concat(
            F.col("total").cast("string"),
            F.lit(C.ENTITIES_DETECTED),
            F.col("type_count").cast("string"),
            F.lit(C.ENTITY_CATEGORIES),
        ),
        around("negatively_framed", "Negative"),
        around("positively_framed", "Positive"),
    )
    summary = (
        F.when(F.col("blank"), F.lit(C.NO_TEXT))
        .when(F.col("total") == 0, F.lit(C.NO_ENTITIES))
        .otherwise(found)
    )
    return rows.select(
        key,
        F.col("total").cast("bigint").alias("total_unique"),
        _cut_list(5).alias("negatively_framed_entities"),
        summary.alias("summary"),
    )
