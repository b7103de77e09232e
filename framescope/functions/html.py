"""Article extraction from HTML with column expressions only."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescope.constants import BOILERPLATE_TAGS, SKIP_PHRASES
from framescope.functions.binding import let
from framescope.functions.lookup import literal_lookup
from framescope.functions.text import SPACE, strip, word_count

# A closing block tag ends an unclosed paragraph.
_BLOCK_END = r"(?i)</(?:p|article|div|body|html|section)\s*>"
#: Tags whose content is no markup, so that nothing in it opens or closes a tag.
_RAW_TAGS = ("script", "style")
#: Longest name that counts without its semicolon.
_LEGACY = max(len(name) for name in html5 if not name.endswith(";"))


def strip_boilerplate(html: Column) -> Column:
    """Remove whole subtrees that never hold article text; scripts and styles go first.

    Subtrees may be nested to any depth, in themselves and in one another. A tag that is never closed stays
    with what follows it, and tags inside comments do not count.
    """
    cleaned = F.coalesce(html, F.lit(""))
    for tag in BOILERPLATE_TAGS:
        if tag in _RAW_TAGS:
            cleaned = F.regexp_replace(cleaned, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
        else:
            cleaned = let(cleaned, lambda c, tag=tag: F.when(c.rlike(rf"(?i)</{tag}"), _outside(c, tag)).otherwise(c))
    return cleaned


def _outside(html: Column, tag: str) -> Column:
    """What is outside of all balanced pairs of a tag, in one pass over the pieces between such tags.

    The state holds the pieces kept so far and, for every tag that is open, how many there were before it.
    A closing tag drops all pieces since the last open one.
    """
    pieces = F.split(html, rf"(?i)(?=<!--|<{tag}\b[^>]*>|</{tag}\s*>)")
    state = F.struct(
        F.array().cast("array<string>").alias("kept"),
        F.array().cast("array<int>").alias("open"),
        F.lit(False).alias("comment"),
    )

    def step(s: Column, piece: Column) -> Column:
        kept, depth = s["kept"], F.size(s["open"])
        opens = ~s["comment"] & piece.rlike(rf"(?i)^<{tag}\b[^>]*(?<!/)>")
        closes = ~s["comment"] & piece.rlike(rf"(?i)^</{tag}\s*>") & (depth > 0)
        rest = F.regexp_replace(piece, rf"(?i)^</{tag}\s*>", "")
        return F.struct(
            F.when(closes, F.concat(F.slice(kept, F.lit(1), F.get(s["open"], depth - 1)), F.array(rest)))
            .otherwise(F.concat(kept, F.array(piece)))
            .alias("kept"),
            F.when(closes, F.slice(s["open"], F.lit(1), depth - 1))
            .when(opens, F.concat(s["open"], F.array(F.size(kept))))
            .otherwise(s["open"])
            .alias("open"),
            ((s["comment"] | piece.startswith("<!--")) & ~piece.contains("-->")).alias("comment"),
        )

    return F.array_join(F.aggregate(pieces, state, step, lambda s: s["kept"]), "")


def _character(code: Column) -> Column:
    """The text of a numeric reference: as browsers read it, with Windows characters for 128 to 159."""
    windows = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]
    shown = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    beyond = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    control = code.between(1, 8) | code.between(0x0E, 0x1F) | (code == 0x0B) | (code == 0x7F)
    no_character = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when(beyond, F.lit("\ufffd"))
        .when(code.between(0x80, 0x9F), F.get(F.array(*[F.lit(c) for c in windows]), (code - 0x80).cast("int")))
        .when(control | no_character, F.lit(""))
        .otherwise(shown)
    )


def decode_entities(text: Column) -> Column:
    """Replace character references once: all named ones of HTML 5, decimal and hexadecimal ones.

    Old names count without a semicolon too, the longest that fits; what is no reference stays.
    """
    named = literal_lookup(html5, "string")

    def reference(piece: Column) -> Column:
        """(what the reference at the start of a piece stands for, its length); null if there is none."""
        number = F.struct(
            F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0).alias("whole"),
            F.regexp_extract(piece, r"^#0*([0-9]+)", 1).alias("decimal"),
            F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]+)", 1).alias("hexadecimal"),
        )
        name = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0)

        def by_number(n: Column) -> Column:
            long = (F.length(n["decimal"]) > 7) | (F.length(n["hexadecimal"]) > 6)
            code = (
                F.when(long, F.lit(0x110000))
                .when(n["decimal"] != "", n["decimal"].cast("bigint"))
                .otherwise(F.conv(n["hexadecimal"], 16, 10).cast("bigint"))
            )
            value = F.struct(let(code, _character).alias("value"), F.length(n["whole"]).alias("length"))
            return F.when(n["whole"] != "", value)

        def by_name(n: Column) -> Column:
            # The whole name, then its beginnings: of those only old names are known.
            shorter = F.transform(F.array(*[F.lit(k) for k in range(_LEGACY, 1, -1)]), lambda k: F.substring(n, 1, k))
            tried = F.transform(
                F.concat(F.array(n), shorter), lambda c: F.struct(named(c).alias("value"), F.length(c).alias("length"))
            )
            return F.get(F.filter(tried, lambda t: t["value"].isNotNull()), F.lit(0))

        return F.when(piece.startswith("#"), let(number, by_number)).otherwise(let(name, by_name))

    def decoded(piece: Column) -> Column:
        return let(
            reference(piece),
            lambda r: F.when(r.isNull(), F.concat(F.lit("&"), piece)).otherwise(
                F.concat(r["value"], F.substring(piece, r["length"] + 1, F.length(piece)))
            ),
        )

    def whole(pieces: Column) -> Column:
        rest = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.concat(pieces[0], F.array_join(F.transform(rest, decoded), ""))

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), whole)).otherwise(text)


def inner_text(fragment: Column) -> Column:
    """Tags become blanks, entities are decoded, whitespace is collapsed."""
    plain = F.regexp_replace(fragment, r"(?s)<!--.*?-->|<[^>]*>", " ")
    return strip(F.regexp_replace(decode_entities(plain), f"[{SPACE}]+", " "))


def extract_headline(cleaned: Column) -> Column:
    """Text of the first ``h1``; empty when there is none."""
    return inner_text(F.regexp_extract(cleaned, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))


def extract_paragraphs(cleaned: Column) -> Column:
    """Paragraph texts of at least five words that hold none of the skip phrases."""
    segments = F.split(cleaned, r"(?i)<p(?:\s[^>]*)?>")
    bodies = F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0)))
    texts = F.transform(bodies, lambda s: inner_text(F.split(s, _BLOCK_END, 2)[0]))
    return F.filter(texts, _keep_paragraph)


def _keep_paragraph(text: Column) -> Column:
    skip = F.lower(text).rlike("|".join(SKIP_PHRASES))
    return (word_count(text) >= 5) & ~skip


def extract_lines(text: Column) -> Column:
    """Line-based extraction for pages that carry plain text: lines of at least five words."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    return F.filter(lines, lambda line: word_count(line) >= 5)
