r"""Tokenisers and sentence splitters.

All functions are row-local expressions, so they run inside the scan stage and never shuffle.
Character classes are spelled out (``[\p{L}\p{N}_]``, ``WS`` and ``SPACE``) because ``\w``, ``\s`` and ``\b``
differ between regex engines.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescope.constants import ABBREVIATIONS
from framescope.functions.binding import let

WORD = r"\p{L}\p{N}_"
WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: The same class for Java, which tests single Latin characters with one table look-up.
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\p{Z}"
BREAK = "\x01"


def _text(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column, F.lit(""))


def non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != F.lit(""))


def strip(value: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace (SQL ``trim`` only removes spaces).

    One match from the first to the last other character, instead of a search at every position.
    """
    return F.regexp_extract(_text(value), f"(?s)^[{SPACE}]*+(.*[^{SPACE}])", 1)


def is_blank(value: Column | str) -> Column:
    """Whether a text has no character but whitespace; the first other one decides."""
    return ~_text(value).rlike(f"[^{SPACE}]")


def tokenize(value: Column | str) -> Column:
    """Lower-case tokens; punctuation is dropped, hyphens stay inside the token."""
    kept = F.regexp_replace(F.lower(_text(value)), f"[^{WORD}{SPACE}-]", "")
    return non_empty(F.split(kept, f"[{SPACE}]+"))


def raw_words(value: Column | str) -> Column:
    """Lower-case whitespace words with punctuation still attached."""
    return non_empty(F.split(F.lower(_text(value)), f"[{SPACE}]+"))


def word_count(value: Column | str) -> Column:
    return F.size(non_empty(F.split(_text(value), f"[{SPACE}]+")))


def _stripped(parts: Column) -> Column:
    return non_empty(F.transform(parts, strip))


def split_sentences(value: Column | str) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` followed by whitespace.

    The separator takes all whitespace, so only the text as a whole has to be stripped.
    """
    return non_empty(F.split(strip(value), rf"[{SPACE}](?<=[.!?][{SPACE}])[{SPACE}]*"))


def split_sentences_abbrev(value: Column | str) -> Column:
    """As :func:`split_sentences`, but the dots of common abbreviations do not end a sentence."""
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    # Whitespace is tested first, since most characters fail there, and then what is before it.
    after = rf"[{SPACE}](?<=[.!?][{SPACE}])(?<!(?<![{WORD}])(?:{known})\.[{SPACE}])"
    return non_empty(F.split(strip(value), rf"{after}[{SPACE}]*"))


def split_fragments(value: Column | str) -> Column:
    """Break at every run of terminators, also inside numbers.

    Whitespace around terminators belongs to the separator; the look-behind keeps long runs of
    whitespace linear.
    """
    separator = rf"(?:(?<![{SPACE}])[{SPACE}]+)?[.!?][.!?{SPACE}]*"
    return non_empty(F.split(strip(value), separator))


def split_paragraphs(value: Column | str) -> Column:
    """Stripped non-empty lines; the whole text when there is none."""
    lines = _stripped(F.split(_text(value), "\n"))
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(_text(value)))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Single-letter accent folding, derived from the Unicode decompositions."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0530), *range(0x1E00, 0x2000)]:
        char = chr(code)
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if folded != char and len(folded) == 1:
            source.append(char)
            target.append(folded)
    return "".join(source), "".join(target)


def strip_accents(value: Column) -> Column:
    source, target = _accent_table()
    folded = F.regexp_replace(F.translate(value, source, target), r"[\x{0300}-\x{036f}]", "")
    # Only ASCII texts have as many bytes as characters.
    return F.when(F.octet_length(value) != F.length(value), folded).otherwise(value)


def vector_tokens(value: Column | str) -> Column:
    """Analyser tokens: lower case, accents stripped, at least two word characters."""
    return F.regexp_extract_all(
        strip_accents(F.lower(_text(value))), F.lit(f"([{WORD}]{{2,}})"), F.lit(1)
    )


def ngrams_of(tokens: Column, low: int, high: int) -> Column:
    """All n-grams with ``low <= n <= high`` of a token array, joined by one blank.

    Each order is built once from the previous one with ``zip_with``, linear in the tokens.
    """

    def longer(n: int, current: Column, orders: list[Column]) -> Column:
        """All orders, where ``current`` is order n and ``orders`` are the wanted ones below it."""
        if n >= low:
            orders = [*orders, current]
        if n == high:
            return orders[0] if len(orders) == 1 else F.concat(*orders)
        size = F.greatest(F.size(tokens) - n, F.lit(0))
        grams = F.zip_with(
            F.slice(current, 1, size), F.slice(tokens, n + 1, size), lambda a, b: F.concat(a, F.lit(" "), b)
        )
        return let(grams, lambda g: longer(n + 1, g, orders))

    return longer(1, tokens, [])


def mark_words(value: Column) -> Column:
    """Wrap every word of the lower-cased text in a break character.

    A marked phrase is then found by plain substring search exactly where a word-bounded,
    case-insensitive regex would match.
    """
    return F.regexp_replace(F.lower(value), f"([{WORD}]+)", f"{BREAK}$1{BREAK}")


def mark_phrase(phrase: str) -> str:
    return " ".join(f"{BREAK}{word}{BREAK}" for word in phrase.lower().split(" "))


def count_char(value: Column, char: str) -> Column:
    """Occurrences of an ASCII character; sizes in bytes are at hand, those in characters are counted."""
    return F.octet_length(value) - F.octet_length(F.replace(value, F.lit(char), F.lit("")))


def preview(value: Column | str, limit: int = 120) -> Column:
    """First ``limit`` characters, with an ellipsis only when something was cut."""
    text = _text(value)
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def default_headline(headline: Column, text: Column) -> Column:
    """Given headline, else the stripped text before the first full stop."""
    first = strip(F.split_part(_text(text), F.lit("."), F.lit(1)))
    return F.when(_text(headline) != "", headline).otherwise(first)


def highlight_terms(value: Column, terms: list[str]) -> Column:
    """Wrap every occurrence of the given terms in ``<mark>``, ignoring case."""
    escaped = []
    for term in terms:
        escaped.append("".join("\\" + c if c in r".*+?^${}()|[]\-" else c for c in term))
    return F.regexp_replace(_text(value), "(?i)(" + "|".join(escaped) + ")", "<mark>$1</mark>")
