"""Golden rows, edge rows and invariants of the scoring engines."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions import labels as L
from framescope.operators import attribution, composite, entities, hedging, lexicon, passive
from framescope.operators import sentiment
from framescope.operators.features import linguistic_features

GOLDEN = [
    "The government announced new infrastructure spending on Tuesday.",
    "Radical extremists have shamefully undermined our democratic institutions.",
    "Officials confirmed the bill passed with bipartisan support in the Senate.",
    "The heroic whistleblower exposed the corrupt and tyrannical administration.",
    "Republic TV's propaganda machine continues its vile attacks on minorities.",
    "NDTV reports that the Prime Minister will visit flood-affected areas tomorrow.",
    "The regime is catastrophic and draconian.",
    "The radical regime imposed draconian laws that devastated citizens.",
    "The candidate reportedly has absolutely no chance of winning.",
    "Mistakes were made and funds were lost.",
    'The bill passed, officials said. Sources say it may have failed! "We won," she told reporters.',
]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_lexicon_golden(texts):
    rows = by_id(lexicon.lexicon_scan(texts(*GOLDEN)))
    assert [rows[i]["total_tokens"] for i in range(11)] == [8, 8, 11, 9, 10, 11, 6, 9, 9, 7, 16]
    found = [[m["word"] for m in rows[i]["loaded_words"]] for i in range(11)]
    assert found == [
        [], ["radical"], [], ["heroic", "corrupt"], ["vile"], [],
        ["regime", "catastrophic", "draconian"], ["radical", "regime", "draconian"], [], [], [],
    ]
    assert rows[6]["loaded_rate"] == 0.5
    assert rows[6]["lexicon_label"] == "Highly Loaded Language"
    assert rows[0]["lexicon_label"] == C.LEXICON_CLEAN


def test_lexicon_blank(texts):
    rows = by_id(lexicon.lexicon_scan(texts("", None, " \n ")))
    for row in rows.values():
        assert (row["total_tokens"], row["loaded_rate"]) == (0, 0.0)
        assert row["lexicon_label"] == C.LEXICON_EMPTY


def test_hedging_golden(texts):
    rows = by_id(hedging.hedge_summary(hedging.hedge_scan(texts(*GOLDEN, ""))))
    assert (rows[8]["epistemic_count"], rows[8]["inflation_count"]) == (1, 1)
    assert rows[8]["hedge_score"] == 1.0
    assert (rows[10]["epistemic_count"], rows[10]["inflation_count"]) == (2, 0)
    assert round(rows[10]["hedge_score"], 4) == 0.1333
    assert all(rows[i]["hedge_score"] == 0 for i in range(8))
    assert rows[11]["hedge_label"] == C.HEDGE_EMPTY
    assert rows[0]["hedge_summary"] == "No significant hedging language detected."
    assert rows[8]["hedge_summary"].startswith("Pervasive hedging detected (score 1.00). 1 epistemic")
    flagged = hedging.flagged_sentences(hedging.hedge_scan(texts(*GOLDEN))).collect()
    kinds = {(r["doc_id"], r["flag_type"]) for r in flagged}
    assert kinds == {(8, "both"), (10, "epistemic")}


@pytest.mark.parametrize(
    "text, count",
    [("He may have left.", 1), ("He may-have left.", 0), ("Dismay have it.", 0),
     ("MAY HAVE? may have", 2), ("may have and may have", 1), ("may  have", 0)],
)
def test_hedging_word_bounds(texts, text, count):
    assert hedging.hedge_scan(texts(text)).first()["epistemic_count"] == count


def test_passive_rule(texts):
    scanned = passive.passive_score(
        passive.passive_scan(
            texts(GOLDEN[9], "Funds were quickly lost by clerks.", "They lost funds.", "", GOLDEN[0])
        )
    )
    rows = by_id(scanned)
    assert rows[0]["passive_count"] == 1 and rows[0]["gap_count"] == 1
    first = rows[0]["passive_sentences"][0]
    assert (first["aux_verb"], first["main_verb"], first["pattern"]) == ("were", "made", "auxpass")
    assert rows[0]["passive_score"] == 1.0
    assert rows[1]["gap_count"] == 0 and rows[1]["passive_rate"] == 1.0
    assert rows[2]["passive_signal"].startswith("No passive voice")
    assert (rows[3]["passive_label"], rows[3]["passive_signal"]) == ("N/A", "No text provided.")


def test_passive_parser_hook(texts):
    def parse(text):
        hit = {"sentence_idx": 0, "sentence": text, "pattern": "nsubjpass", "aux_verb": "",
               "main_verb": "x", "is_gap": False}
        return 2, [hit] if text else []

    scored = passive.passive_score(passive.passive_with_parser(texts("abc", ""), parse))
    rows = by_id(scored)
    assert rows[0]["passive_rate"] == 0.5
    assert rows[1]["passive_count"] == 0


def test_sentence_classes(texts):
    classified = attribution.classify_sentences(texts(*GOLDEN, "She said so.", "According to him"))
    rows = by_id(attribution.opinion_ratios(classified))
    classes = [[s["sentence_class"] for s in rows[i]["classified"]] for i in (0, 5, 10, 11, 12)]
    assert classes == [
        ["attributed"], ["opinion"], ["opinion", "opinion", "quoted"], ["attributed"], ["attributed"],
    ]
    for row in rows.values():
        parts = row["opinion_ratio"] + row["quote_ratio"] + row["attribution_ratio"]
        assert math.isclose(parts, 1.0)


FEATURES = {
    0: (0, 0, 0, 0, 0, 1, 1, 0.25),
    1: (0, 0.125, 0, 0, 0.125, 1, 1, 0.125),
    6: (0, 0.3333, 0, 0, 0, 1, 1, 0.3333),
    9: (1, 0, 0, 0, 0, 1, 0.8571, 0.2857),
    10: (0, 0, 0.0022, 0.0625, 0, 0.6667, 1, 0.1875),
}
NAMES = [n for n in C.FEATURE_NAMES if n not in ("subjectivity", "emotion_intensity")]


def test_features_golden(texts):
    rows = by_id(linguistic_features(texts(*GOLDEN)))
    for key, expected in FEATURES.items():
        assert tuple(round(rows[key][n], 4) for n in NAMES) == expected


def test_features_blank_is_zero(texts):
    rows = by_id(linguistic_features(texts("", "  ", None)))
    assert all(row[n] == 0.0 for row in rows.values() for n in C.FEATURE_NAMES)


def compound(texts, text):
    return sentiment.emotion_intensity(texts(text)).first()["compound"]


def normalised(value):
    return value / math.sqrt(value * value + 15)


@pytest.mark.parametrize(
    "text, total",
    [
        ("it is vile", -3.0),
        ("it is not vile", -3.0 * -0.74),
        ("it is very vile", -3.0 - 0.293),
        ("very plain vile", -3.0 - 0.293 * 0.95),
        ("very not vile", -3.0 * -0.74 + 0.293 * 0.95),
        ("not very vile", (-3.0 - 0.293) * -0.74),
        ("slightly bold", 1.5 - 0.293),
        ("it is VILE", -3.0 - 0.733),
        ("ALL VILE", -3.0),
        ("bold but vile", 1.5 * 0.5 - 3.0 * 1.5),
        ("vile!!", -3.0 - 2 * 0.292),
        ("bold?? yes?", 1.5 + 3 * 0.18),
        ("bold, (vile)", 1.5 - 3.0),
        ("nothing here", 0.0),
    ],
)
def test_valence_rules(texts, text, total):
    assert math.isclose(compound(texts, text), normalised(total), abs_tol=1e-9)


def test_subjectivity_scales_next_word(texts):
    rows = by_id(sentiment.subjectivity(texts("threat", "very threat", "slightly threat", "none")))
    got = [round(rows[i]["subjectivity"], 6) for i in range(4)]
    assert got == [0.4, 0.52, 0.28, 0.0]


def test_entities(spark, texts):
    gazetteer = spark.createDataFrame(
        [("Maria Lopez", "PERSON"), ("Kenya", "GPE"), ("X", "ORG"), ("Monday", "DATE")],
        "surface string, entity_type string",
    )
    docs = texts(
        "Corrupt Maria Lopez failed in Kenya. Heroic bold Kenya won on Monday. X was weak today.",
        "nobody here", "",
    )
    mentions = entities.entity_mentions(docs, gazetteer)
    counts = {r["entity"]: r["mention_count"] for r in entities.entity_counts(mentions).collect()}
    assert counts == {"Maria Lopez": 1, "Kenya": 2}
    framing = {r["entity"]: r["net"] for r in entities.entity_framing(mentions).collect()}
    assert framing == {"Maria Lopez": -2, "Kenya": 0, "X": -1}
    summary = by_id(entities.ner_summary(docs, mentions))
    assert summary[0]["summary"].startswith("2 named entities detected across 2 categories.")
    assert "Maria Lopez, X" in summary[0]["summary"]
    assert summary[1]["summary"] == "No named entities detected."
    assert summary[2]["summary"] == "No text provided."


def test_entity_model_hook(texts):
    def recognise(text):
        return [
            {"sent_idx": 0, "pos": i, "entity": w, "entity_type": "ORG", "positive_hits": 0,
             "negative_hits": 1}
            for i, w in enumerate(text.split()) if w.istitle()
        ]

    mentions = entities.mentions_with_model(texts("Acme sued Zeta", ""), recognise)
    assert sorted(r["entity"] for r in mentions.collect()) == ["Acme", "Zeta"]


@pytest.mark.parametrize(
    "score, label",
    [(0.10, "Appears Neutral"), (0.35, "Slightly Opinionated"), (0.55, "Moderate Bias"),
     (0.70, "Highly Opinionated"), (0.85, "Extreme Bias Detected"), (0.30, "Slightly Opinionated"),
     (0.78, "Extreme Bias Detected")],
)
def test_verdict(spark, score, label):
    row = spark.range(1).select(L.verdict(F.lit(score)).alias("v"), L.gauge_bin(F.lit(score)).alias("g"))
    assert row.first()["v"] == label
    if score == 0.30:
        assert row.first()["g"] == "Appears Neutral"


def test_composite_bounds_and_blank(texts):
    docs = texts(*GOLDEN, "", None).withColumn("ml_probability", F.lit(0.4))
    rows = by_id(composite.score_text(docs))
    for row in rows.values():
        assert 0.0 <= row["composite_score"] <= 1.0
    for key in (11, 12):
        assert rows[key]["composite_score"] == 0.0
        assert rows[key]["verdict"] == "No text provided"
        assert rows[key]["hedge_label"] == "N/A"
        assert rows[key]["text_preview"] == "(no text)"
    seven = rows[6]
    expected = 0.6 * 0.4 + 0.05 * 1.0
    assert math.isclose(seven["composite_score"], round(expected, 4))


def test_long_gazetteer_surfaces_are_matched(spark, texts):
    gazetteer = spark.createDataFrame([("World Health Assembly Board", "ORG")], "surface string, entity_type string")
    docs = texts("The World Health Assembly Board met today.", "World Health Assembly only.")
    found = entities.entity_mentions(docs, gazetteer).collect()
    assert [(r["doc_id"], r["entity"]) for r in found] == [(0, "World Health Assembly Board")]


def test_words_in_ed_are_not_passive(spark):
    from framescope.operators.passive import passive_scan

    rows = [
        (1, "The sky is red."), (2, "They were indeed happy."), (3, "Votes were counted."),
        (4, "It was red or was lost."),
    ]
    found = passive_scan(spark.createDataFrame(rows, "id int, text string")).orderBy("id").collect()
    assert [[p["main_verb"] for p in r["passive_sentences"]] for r in found] == [[], [], ["counted"], ["lost"]]


def test_listed_words_do_not_modify_and_contractions_negate(spark):
    from framescope.operators.sentiment import Modifiers, emotion_intensity

    words = {"no": (-1.2, 0.5), "good": (1.9, 0.5)}
    rows = [(1, "no good"), (2, "isn't good"), (3, "hyper good"), (4, "so good")]
    frame = spark.createDataFrame(rows, "id int, text string")
    scored = emotion_intensity(frame, words=words, modifiers=Modifiers(boosters=["hyper"]))
    plain = {r["id"]: r["compound"] for r in scored.collect()}
    assert plain[1] > 0 and plain[2] < 0 and plain[3] > plain[4] > 0


def test_summary_of_given_mentions_is_that_of_the_gazetteer(spark):
    from framescope.operators import entities as N

    texts = spark.createDataFrame(
        [(1, "Corrupt Paris failed. Paris won."), (2, ""), (3, None), (4, "Nothing here.")],
        "doc_id int, text string",
    )
    names = spark.createDataFrame([("Paris", "GPE")], "surface string, entity_type string")
    one = N.gazetteer_summary(texts, names).orderBy("doc_id").collect()
    two = N.ner_summary(texts, N.entity_mentions(texts, names)).orderBy("doc_id").collect()
    assert one == two and len(one) == 4
    assert [r["total_unique"] for r in one] == [1, 0, 0, 0]


def test_dedup_keeps_one_row_where_keys_repeat(spark):
    from framescope.operators.corpus import dedup_text

    rows = [(0, 1, "Same"), (0, 1, "same"), (1, 2, "SAME"), (0, 3, "other")]
    kept = dedup_text(spark.createDataFrame(rows, "priority int, row_id int, text string")).collect()
    assert sorted(r["row_id"] for r in kept) == [1, 3]
