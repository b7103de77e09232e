r"""SQL fragments shared by the comparison queries.

Every fragment is written for DuckDB and formulates its operator independently of the Spark side
where that is possible: windows instead of array positions, joins instead of lookups, unnested rows
instead of higher-order functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from framescope import constants as C
from framescope.functions.text import WORD, WS
from framescope.operators.lexicon import loaded_words
from framescope.operators.passive import passive_pattern
from framescope.plans.planted import BIAS, GAZETTEER, NAMES, PHRASES, PLACES, WEIGHTS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: Sequence[object]) -> str:
    return "[" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values) + "]"


def sql_in(values: Sequence[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def with_ctes(*parts: str) -> str:
    """A WITH clause from ``name AS (...)`` parts, repeated parts only once."""
    return "WITH " + ",\n".join(dict.fromkeys(parts))


def pick(values: Sequence[str], index: str) -> str:
    return f"{sql_list(list(values))}[({index}) % {len(values)} + 1]"


def every(n: int, addition: str) -> str:
    return f"CASE WHEN doc_id % {n} = 0 THEN {addition} ELSE '' END"


PLANTED = f"""planted AS (
  SELECT * REPLACE (text
    || ' Dr. Ames said it is ' || {pick(PHRASES, 'doc_id')} || ' true.'
    || {every(3, f"' And ' || {pick(PHRASES, 'doc_id * 7')} || ', no! Is it?'")}
    || {every(4, f"' The ' || {pick(loaded_words(), 'doc_id')} || ' vote.'")}
    || {every(5, f"' Corrupt ' || {pick(NAMES, 'doc_id')} || ' failed in ' || {pick(PLACES, 'doc_id')} || '.'")}
    || {every(6, "' Funds were lost'")} || {every(12, "' by clerks'")} || {every(6, "'.'")}
    || {every(7, "' " + '"We won," she told reporters.' + "'")}
    || {every(11, "' The plan was VERY bold but not slightly shameful!!'")}
    || {every(9, quoted(" It isn't heroic. It failed, true heroic. The sky is red and funds were red or were lost."))} AS text)
  FROM documents)"""


def round_to(value: str, digits: int = 4) -> str:
    return f"(floor(({value}) * 1e{digits} + 0.5e0)::DOUBLE / 1e{digits})"


def ratio(part: str, whole: str) -> str:
    return f"(({part})::DOUBLE / greatest(({whole})::DOUBLE, 1e0))"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def non_empty(e: str) -> str:
    return f"list_filter({e}, lambda z: z <> '')"


def tokens(e: str) -> str:
    kept = f"regexp_replace(lower({e}), '[^{WORD}{WS}-]', '', 'g')"
    return non_empty(f"string_split_regex({kept}, '[{WS}]+')")


def raw_words(e: str) -> str:
    return non_empty(f"string_split_regex(lower({e}), '[{WS}]+')")


def word_count(e: str) -> str:
    return f"len({non_empty(f'''string_split_regex({e}, '[{WS}]+')''')})"


def _broken(e: str) -> str:
    return f"string_split(regexp_replace({e}, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))"


def sentences(e: str) -> str:
    return non_empty(f"list_transform({_broken(e)}, lambda q: {strip('q')})")


def sentences_abbrev(e: str) -> str:
    plain = "|".join(a for a in C.ABBREVIATIONS if "." not in a)
    out = f"regexp_replace({e}, '(^|[^{WORD}])({plain})\\.', '\\1\\2' || chr(2), 'g')"
    for dotted in (a for a in C.ABBREVIATIONS if "." in a):
        head, tail = dotted.split(".")
        out = (
            f"regexp_replace({out}, '(^|[^{WORD}]){head}\\.{tail}\\.', "
            f"'\\1{head}' || chr(2) || '{tail}' || chr(2), 'g')"
        )
    restored = strip("replace(q, chr(2), '.')")
    return non_empty(f"list_transform({_broken(out)}, lambda q: {restored})")


def fragments(e: str) -> str:
    parts = f"string_split_regex({e}, '[.!?]+')"
    return non_empty(f"list_transform({parts}, lambda q: {strip('q')})")


def vector_tokens(e: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({e})), '[{WORD}]{{2,}}')"


def bucket(value: str, bounds: Sequence[float], labels: Sequence[str], op: str = "<") -> str:
    cases = " ".join(
        f"WHEN {value} {op} {bound}e0 THEN {quoted(label)}"
        for bound, label in zip(bounds, labels, strict=False)
    )
    return f"CASE {cases} ELSE {quoted(labels[len(bounds)])} END"


def is_blank(e: str) -> str:
    return f"({strip(e)} = '')"


# ``s`` is the text table every engine fragment reads: (doc_id, section, text).
DOCS_AS_S = "s AS (SELECT doc_id, '' AS section, text FROM planted)"


def lexicon_label(rate: str, total: str) -> str:
    inner = bucket(rate, C.LEXICON_CUTS, C.LEXICON_LABELS)
    return (
        f"CASE WHEN {total} = 0 THEN {quoted(C.LEXICON_EMPTY)} "
        f"WHEN {rate} = 0 THEN {quoted(C.LEXICON_CLEAN)} ELSE {inner} END"
    )


LEXICON_TABLE = "lexicon AS (SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(w)}, {quoted(c)})" for c, ws in C.LOADED_WORDS.items() for w in ws
) + ") t(word, category))"

TOKENS = (
    f"tok AS (SELECT doc_id, section, {tokens('text')} AS t FROM s),\n"
    "tokrows AS (SELECT doc_id, section, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM tok),\n"
    "lexhits AS (SELECT doc_id, section, i, word, category FROM tokrows JOIN lexicon USING (word))"
)

LEX = """lexagg AS (
  SELECT doc_id, section, count(*) AS hits, count(DISTINCT word) AS uniq,
         string_agg(word, ',' ORDER BY i) AS words FROM lexhits GROUP BY ALL),
lex AS (
  SELECT doc_id, section, len(t)::BIGINT AS total_tokens, coalesce(hits, 0)::BIGINT AS loaded_word_count,
         coalesce(uniq, 0)::BIGINT AS unique_loaded_words, coalesce(words, '') AS words,
         coalesce(hits, 0)::DOUBLE / greatest(len(t), 1)::DOUBLE AS loaded_rate
  FROM tok LEFT JOIN lexagg USING (doc_id, section))"""

WORD_TABLE = "words AS (SELECT w, v::DOUBLE AS v, sv::DOUBLE AS sv FROM (VALUES " + ", ".join(
    f"({quoted(w)}, {v}, {s})" for w, (v, s) in C.SENTIMENT_WORDS.items()
) + ") t(w, v, sv))"

EMOTION_WORDS = (
    "ew0 AS (SELECT doc_id, section, list_filter(list_transform("
    f"string_split_regex(text, '[{WS}]+'), "
    "lambda q: regexp_replace(q, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), "
    "lambda q: length(q) > 1) AS l FROM s),\n"
    "ew1 AS (SELECT doc_id, section, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM ew0),\n"
    "ew2 AS (SELECT *, lower(raw) AS w, (upper(raw) = raw AND lower(raw) <> raw) AS caps FROM ew1),\n"
    "ewflags AS (SELECT doc_id, section, count(*) FILTER (caps) > 0 AND "
    "count(*) FILTER (caps) < count(*) AS mixed, min(i) FILTER (w = 'but') AS but_at "
    "FROM ew2 GROUP BY ALL),\n"
    "ew AS (SELECT e.*, mixed, but_at, "
    + ", ".join(
        f"lag(w, {d}) OVER win AS w{d}, lag(caps, {d}) OVER win AS c{d}" for d in (1, 2, 3)
    )
    + " FROM ew2 e JOIN ewflags USING (doc_id, section) "
    "WINDOW win AS (PARTITION BY doc_id, section ORDER BY i))"
)


def _step(distance: int) -> str:
    """Boost and negation of the word ``distance`` places back, on the value so far."""
    d = distance
    caps = f"CASE WHEN mixed AND coalesce(c{d}, false) THEN {C.CAPS_STEP}e0 ELSE 0e0 END"
    step = (
        f"CASE WHEN w{d} IN {sql_in(C.BOOSTERS)} THEN {caps} + {C.BOOST_STEP}e0 "
        f"WHEN w{d} IN {sql_in(C.DAMPENERS)} THEN {caps} - {C.BOOST_STEP}e0 ELSE 0e0 END"
    )
    return (
        f"val{d} AS (SELECT *, CASE WHEN w{d} IN (SELECT w FROM words) THEN v{d - 1} ELSE "
        f"(v{d - 1} + sign(v{d - 1}) * {step} * {C.BOOST_DECAY[d - 1]}e0) * "
        f"CASE WHEN w{d} IN {sql_in(C.NEGATORS)} OR coalesce(regexp_matches(w{d}, {quoted(C.NEGATED_ENDING)}), false) "
        f"THEN {C.NEGATION_FACTOR}e0 ELSE 1e0 END END AS v{d} "
        f"FROM val{d - 1}),\n"
    )


EMOTION = (
    f"val0 AS (SELECT *, v + CASE WHEN mixed AND caps THEN sign(v) * {C.CAPS_STEP}e0 ELSE 0e0 END AS v0 "
    "FROM ew JOIN words USING (w)),\n"
    + "".join(_step(d) for d in (1, 2, 3))
    + "valued AS (SELECT doc_id, section, v3 * "
    f"CASE WHEN but_at IS NULL THEN 1e0 WHEN i < but_at THEN {C.BUT_BEFORE}e0 "
    f"ELSE {C.BUT_AFTER}e0 END AS val FROM val3),\n"
    "emosum AS (SELECT doc_id, section, sum(val) AS total FROM valued GROUP BY ALL),\n"
    "emo0 AS (SELECT doc_id, section, CASE WHEN abs(coalesce(total, 0)) < 1e-9 THEN 0e0 ELSE total END AS total, "
    "length(text) - length(replace(text, '!', '')) AS ex, "
    "length(text) - length(replace(text, '?', '')) AS qu FROM s LEFT JOIN emosum USING (doc_id, section)),\n"
    f"emo1 AS (SELECT *, total + sign(total) * (least(ex, {C.EXCLAMATION_MAX}) * {C.EXCLAMATION_STEP}e0 + "
    f"CASE WHEN qu <= 1 THEN 0e0 WHEN qu <= 3 THEN qu * {C.QUESTION_STEP}e0 ELSE {C.QUESTION_MAX}e0 END) AS x FROM emo0),\n"
    f"emo2 AS (SELECT *, CASE WHEN total = 0 THEN 0e0 ELSE x / sqrt(x * x + {C.COMPOUND_ALPHA}e0) END AS compound FROM emo1),\n"
    f"emo AS (SELECT doc_id, section, compound, {round_to('abs(compound)')} AS emotion_intensity FROM emo2)"
)

SUBJECTIVITY = (
    "subjrows AS (SELECT doc_id, section, v, "
    f"least(sv * CASE WHEN w1 IN {sql_in(C.BOOSTERS)} THEN 1.3e0 WHEN w1 IN {sql_in(C.DAMPENERS)} "
    "THEN 0.7e0 ELSE 1e0 END, 1e0) AS sv2 FROM ew JOIN words USING (w)),\n"
    "subjagg AS (SELECT doc_id, section, sum(sv2) / count(*) AS sj, sum(v) / count(*) AS pv FROM subjrows GROUP BY ALL),\n"
    "subj AS (SELECT doc_id, section, coalesce(sj, 0e0) AS subjectivity, "
    "greatest(-1e0, least(1e0, coalesce(pv, 0e0) / 4e0)) AS polarity, "
    f"{round_to('coalesce(sj, 0e0)')} AS subjectivity_score FROM s LEFT JOIN subjagg USING (doc_id, section))"
)

SENTENCES = (
    f"sents AS (SELECT doc_id, section, {sentences_abbrev('text')} AS l FROM s),\n"
    "sentrows AS (SELECT doc_id, section, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS idx FROM sents)"
)

_GAP = (
    "(" + " OR ".join(f"contains(lower(sentence), {quoted(p)})" for p in C.PASSIVE_INDICATORS)
    + ") AND NOT contains(lower(sentence), ' by ')"
)
_PASSIVE = quoted(passive_pattern())

PASSIVE = (
    f"pasfound AS (SELECT *, regexp_extract_all(sentence, {_PASSIVE}, 1) AS auxs, "
    f"regexp_extract_all(sentence, {_PASSIVE}, 2) AS verbs FROM sentrows WHERE regexp_matches(sentence, {_PASSIVE})),\n"
    f"pasfirst AS (SELECT *, list_position(list_transform(verbs, lambda q: lower(q) NOT IN {sql_in(C.NOT_PARTICIPLES)}), true) AS first_ok FROM pasfound),\n"
    f"pasrows AS (SELECT * EXCLUDE (auxs, verbs, first_ok), auxs[first_ok] AS aux_verb, verbs[first_ok] AS main_verb, ({_GAP}) AS is_gap "
    "FROM pasfirst WHERE first_ok > 0),\n"
    "pasagg AS (SELECT doc_id, section, count(*) AS p, count(*) FILTER (is_gap) AS g FROM pasrows GROUP BY ALL),\n"
    "pas0 AS (SELECT doc_id, section, len(l)::BIGINT AS passive_total, coalesce(p, 0)::BIGINT AS passive_count, "
    f"coalesce(g, 0)::BIGINT AS gap_count, {round_to(ratio('coalesce(p, 0)', 'len(l)'))} AS passive_rate "
    "FROM sents LEFT JOIN pasagg USING (doc_id, section)),\n"
    f"pas AS (SELECT *, {round_to('least(passive_rate + least(gap_count * 0.1e0, 0.3e0), 1e0)')} AS passive_score FROM pas0)"
)


def _phrase_pattern(phrase: str) -> str:
    return f"(^|[^{WORD}]){phrase}($|[^{WORD}])"


def _present(kind: str, phrases: Sequence[str]) -> str:
    cases = ", ".join(
        f"CASE WHEN regexp_matches(ls, {quoted(_phrase_pattern(p))}) THEN {quoted(p)} END"
        for p in phrases
    )
    return f"list_filter([{cases}], lambda z: z IS NOT NULL) AS {kind}"


HEDGE = (
    "hedgegate AS (SELECT *, lower(sentence) AS ls FROM sentrows WHERE regexp_matches(lower(sentence), "
    + quoted(_phrase_pattern("(" + "|".join(PHRASES) + ")"))
    + ")),\n"
    f"hedgerows AS (SELECT doc_id, section, idx, sentence, {_present('e', C.EPISTEMIC_PHRASES)}, "
    f"{_present('f', C.CERTAINTY_PHRASES)} FROM hedgegate),\n"
    "hedgeagg AS (SELECT doc_id, section, sum(len(e)) AS ec, sum(len(f)) AS ic, "
    "count(*) FILTER (len(e) > 0) AS es, count(*) FILTER (len(f) > 0) AS fs FROM hedgerows GROUP BY ALL),\n"
    "hed0 AS (SELECT doc_id, section, len(l)::BIGINT AS hedge_sentences, coalesce(ec, 0)::BIGINT AS epistemic_count, "
    "coalesce(ic, 0)::BIGINT AS inflation_count, "
    f"{ratio('coalesce(es, 0)', 'len(l)')} AS epistemic_rate, {ratio('coalesce(fs, 0)', 'len(l)')} AS inflation_rate "
    "FROM sents LEFT JOIN hedgeagg USING (doc_id, section)),\n"
    "hed AS (SELECT *, least(0.4e0 * epistemic_rate + 0.6e0 * inflation_rate, 1e0) AS hedge_score FROM hed0)"
)


def grams(source: str, name: str, keys: str, high: int = 3) -> str:
    """n-gram rows of ``source`` (columns: keys, text)."""
    parts = [f"SELECT {keys}, unnest(t) AS term FROM {name}_t"]
    for n in range(2, high + 1):
        joined = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
        parts.append(
            f"SELECT {keys}, unnest(list_transform(range(1, greatest(len(t) - {n - 2}, 1)), "
            f"lambda i: {joined})) AS term FROM {name}_t"
        )
    body = " UNION ALL ".join(parts)
    return (
        f"{name}_t AS (SELECT {keys}, {vector_tokens('text')} AS t FROM {source}),\n"
        f"{name} AS ({body})"
    )


VOCABULARY = (
    grams("planted", "dgrams", "doc_id")
    + ",\ndcounts AS (SELECT doc_id, term, count(*) AS tf FROM dgrams GROUP BY ALL),\n"
    "vocab AS (SELECT term, count(*) AS df, sum(tf) AS total, "
    "ln((1e0 + (SELECT count(*) FROM planted)) / (1e0 + count(*))) + 1e0 AS idf "
    "FROM dcounts GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 25000)"
)

WEIGHT_TABLE = "coefs AS (SELECT term, c::DOUBLE AS c FROM (VALUES " + ", ".join(
    f"({quoted(w)}, {c})" for w, c in WEIGHTS.items()
) + ") t(term, c))"

ML = (
    grams("s", "sgrams", "doc_id, section")
    + ",\nscounts AS (SELECT doc_id, section, term, count(*) AS tf FROM sgrams GROUP BY ALL),\n"
    "sraw AS (SELECT doc_id, section, term, (1e0 + ln(tf::DOUBLE)) * idf AS raw FROM scounts JOIN vocab USING (term)),\n"
    "sdot AS (SELECT doc_id, section, sum(raw * coalesce(c, 0e0)) / sqrt(sum(raw * raw)) AS dot "
    "FROM sraw LEFT JOIN coefs USING (term) GROUP BY ALL),\n"
    "ml AS (SELECT doc_id, section, CASE WHEN "
    + is_blank("text")
    + f" THEN 0e0 ELSE {round_to(f'1e0 / (1e0 + exp(-(coalesce(dot, 0e0) + ({BIAS}e0))))')} END AS ml_probability "
    "FROM s LEFT JOIN sdot USING (doc_id, section))"
)

PLAIN = (
    f"plain AS (SELECT doc_id, section, {sentences('text')} AS l FROM s),\n"
    "plainrows AS (SELECT doc_id, section, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS idx FROM plain),\n"
    "classified AS (SELECT *, CASE WHEN regexp_matches(sentence, '[\"“”]') THEN 'quoted' "
    f"WHEN list_has_any({raw_words('sentence')}, {sql_list(C.ATTRIBUTION_VERBS)}) OR "
    + " OR ".join(f"contains(lower(sentence), {quoted(p)})" for p in C.ATTRIBUTION_PHRASES)
    + " THEN 'attributed' ELSE 'opinion' END AS sentence_class FROM plainrows)"
)
OPINION = (
    "opagg AS (SELECT doc_id, section, "
    + ", ".join(
        f"count(*) FILTER (sentence_class = '{c}') AS {c}"
        for c in ("quoted", "attributed", "opinion")
    )
    + " FROM classified GROUP BY ALL),\n"
    "op AS (SELECT doc_id, section, len(l)::BIGINT AS total_sentences, coalesce(quoted, 0)::BIGINT AS quoted_sentences, "
    "coalesce(attributed, 0)::BIGINT AS attributed_sentences, coalesce(opinion, 0)::BIGINT AS opinion_sentences, "
    f"{ratio('coalesce(opinion, 0)', 'len(l)')} AS opinion_ratio, {ratio('coalesce(quoted, 0)', 'len(l)')} AS quote_ratio, "
    f"{ratio('coalesce(attributed, 0)', 'len(l)')} AS attribution_ratio FROM plain LEFT JOIN opagg USING (doc_id, section))"
)

PARAS = f"list_filter(list_transform(string_split(text, chr(10)), lambda q: {strip('q')}), lambda q: q <> '')"
SHAPED = (
    f"shaped0 AS (SELECT doc_id, text, {strip('''split_part(text, '.', 1)''')} AS headline, {PARAS} AS ps, "
    f"{word_count('text')}::BIGINT AS word_count FROM planted),\n"
    "shaped AS (SELECT * REPLACE (CASE WHEN len(ps) > 0 THEN ps ELSE [text] END AS ps), "
    "greatest(len(ps), 1) AS n FROM shaped0),\n"
    "thirds AS (SELECT *, CASE WHEN n < 3 THEN array_to_string(ps, ' ') ELSE array_to_string(ps[1:n // 3], ' ') END AS beginning, "
    "CASE WHEN n < 3 THEN array_to_string(ps, ' ') ELSE array_to_string(ps[n // 3 + 1:2 * (n // 3)], ' ') END AS middle, "
    "CASE WHEN n < 3 THEN array_to_string(ps, ' ') ELSE array_to_string(ps[2 * (n // 3) + 1:], ' ') END AS \"end\" FROM shaped)"
)
SECTIONS_AS_S = "s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {quoted(label)} AS section, {column} AS text FROM thirds"
    for label, column in zip(
        C.SECTIONS, ["text", "headline", "beginning", "middle", '"end"'], strict=True
    )
) + ")"

W = C.COMPOSITE_WEIGHTS
SCORED = (
    "scored0 AS (SELECT s.doc_id, s.section, s.text, "
    + is_blank("s.text")
    + " AS blank, ml_probability, emotion_intensity, compound, "
    "subjectivity_score, passive_score, "
    f"{round_to('loaded_rate')} AS lexicon_score, {round_to('hedge_score')} AS hedge_score, "
    "hedge_score AS raw_hedge, loaded_word_count, unique_loaded_words, words "
    "FROM s JOIN ml USING (doc_id, section) JOIN emo USING (doc_id, section) JOIN subj USING (doc_id, section) "
    "JOIN pas USING (doc_id, section) JOIN lex USING (doc_id, section) JOIN hed USING (doc_id, section)),\n"
    "scored AS (SELECT *, CASE WHEN blank THEN 0e0 ELSE "
    + round_to(
        f"{W['ml_probability']}e0 * ml_probability + {W['emotion_intensity']}e0 * emotion_intensity + "
        f"{W['subjectivity_score']}e0 * subjectivity_score + {W['passive_score']}e0 * passive_score + "
        f"{W['lexicon_score']}e0 * least(lexicon_score * 10e0, 1e0) + {W['hedge_score']}e0 * hedge_score"
    )
    + " END AS composite_score FROM scored0)"
)

ENGINES = (LEXICON_TABLE, TOKENS, LEX, WORD_TABLE, EMOTION_WORDS, EMOTION, SUBJECTIVITY, SENTENCES,
           PASSIVE, HEDGE, VOCABULARY, WEIGHT_TABLE, ML, SCORED)

# Documents scored section by section; texts for which everything is computed.
ALL_SCORED = (PLANTED, SHAPED, SECTIONS_AS_S, *ENGINES)


def verdict(score: str, blank: str | None = None) -> str:
    inner = bucket(score, C.VERDICT_CUTS, C.VERDICT_LABELS)
    return inner if blank is None else f"CASE WHEN {blank} THEN 'No text provided' ELSE {inner} END"


HEDGE_LABEL = (
    f"CASE WHEN {{blank}} THEN {{empty}} ELSE {bucket('{score}', C.HEDGE_CUTS, C.HEDGE_LABELS)} END"
)


def hedge_label(score: str, blank: str, empty: str = C.HEDGE_EMPTY) -> str:
    return HEDGE_LABEL.format(score=score, blank=blank, empty=quoted(empty))


REPORT = (
    "report AS (SELECT doc_id, "
    "max(text) FILTER (section = 'Headline') AS headline, "
    + ", ".join(
        f"max({c}) FILTER (section = 'Full Body') AS {c}"
        for c in (
            "composite_score", "ml_probability", "emotion_intensity", "subjectivity_score",
            "passive_score", "hedge_score", "raw_hedge", "loaded_word_count",
            "unique_loaded_words", "words", "blank",
        )
    )
    + ", max(lexicon_score) FILTER (section = 'Full Body') AS lexicon_rate"
    + ", max(substr(text, 1, 500)) FILTER (section = 'Full Body') AS body_preview"
    + f", max({word_count('text')}::BIGINT) FILTER (section = 'Full Body') AS word_count"
    + "".join(
        f", max(composite_score) FILTER (section = '{label}') AS {alias}"
        for label, alias in (
            ("Headline", "headline_score"), ("Beginning", "beginning_score"),
            ("Middle", "middle_score"), ("End", "end_score"),
        )
    )
    + " FROM scored GROUP BY doc_id)"
)
ALL_REPORT = (*ALL_SCORED, REPORT)

GAZETTEER_TABLE = "gazetteer AS (SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(n)}, {quoted(t)})" for n, t in GAZETTEER
) + ") t(surface, entity_type))"


def _hits(words: Sequence[str]) -> str:
    return f"len(list_intersect(list_distinct({raw_words('sentence')}), {sql_list(list(words))}))"


MENTIONS = (
    f"mw AS (SELECT doc_id, idx, regexp_extract_all(sentence, '[{WORD}]+') AS w, "
    f"{_hits(C.POSITIVE_FRAME_WORDS)} AS ph, {_hits(C.NEGATIVE_FRAME_WORDS)} AS nh FROM sentrows),\n"
    "mp AS (SELECT doc_id, idx, ph, nh, w, unnest(range(1, len(w) + 1)) AS i FROM mw),\n"
    "mg AS (SELECT doc_id, idx, ph, nh, i - 1 AS pos, w[i] AS surface FROM mp "
    "UNION ALL SELECT doc_id, idx, ph, nh, i - 1, w[i] || ' ' || w[i + 1] FROM mp WHERE i + 1 <= len(w) "
    "UNION ALL SELECT doc_id, idx, ph, nh, i - 1, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM mp WHERE i + 2 <= len(w)),\n"
    "mentions AS (SELECT doc_id, idx::BIGINT AS sent_idx, pos::BIGINT AS pos, surface AS entity, entity_type, "
    "ph::BIGINT AS positive_hits, nh::BIGINT AS negative_hits FROM mg JOIN gazetteer USING (surface) "
    f"WHERE entity_type IN {sql_in(list(C.ENTITY_TYPES))})"
)
ALL_MENTIONS = (PLANTED, DOCS_AS_S, SENTENCES, GAZETTEER_TABLE, MENTIONS)
FRAMING = (
    "framing AS (SELECT doc_id, entity, sum(positive_hits)::BIGINT AS positive, sum(negative_hits)::BIGINT AS negative, "
    "(sum(positive_hits) - sum(negative_hits))::BIGINT AS net, min(sent_idx * 100000 + pos) AS first_at, "
    "CASE WHEN sum(positive_hits) > sum(negative_hits) THEN 'Positive Framing' "
    "WHEN sum(positive_hits) < sum(negative_hits) THEN 'Negative Framing' ELSE 'Neutral Framing' END AS frame_label "
    "FROM mentions GROUP BY ALL)"
)

LABELLED = (
    "labelled AS (SELECT p.doc_id, p.text, l.toxic::BIGINT AS label FROM planted p JOIN labels l USING (doc_id))"
)
PREDICTIONS = (
    "predictions AS (SELECT doc_id, toxic::BIGINT AS label, ml_probability AS probability, "
    "(ml_probability >= 0.5)::BIGINT AS prediction FROM ml JOIN labels USING (doc_id))"
)
ALL_PREDICTIONS = (PLANTED, DOCS_AS_S, VOCABULARY, WEIGHT_TABLE, ML, PREDICTIONS)
