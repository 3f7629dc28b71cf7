"""Scalar functions and predicates as Column builders; all run inside the JVM."""

from __future__ import annotations

import html
import html.entities
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spam and noise patterns, in Java's dialect with Unicode classes.
PHONE = r"\+\d[\d\s\-\(\)]{7,}"
SPAM = {
    "facebook": r"(?iU)(t\.me/|telegram\.me/|@\w{5,})(?:\+\d|0\d)[\d\s\-\(\)]{7,}|\b(mdma|lsd|dmt|shrooms)\b",
    "facebook_intended": r"(?iU)(t\.me/|telegram\.me/|@\w{5,})|(?:\+\d|0\d)[\d\s\-\(\)]{7,}|\b(mdma|lsd|dmt|shrooms)\b",
    "instagram": (
        r"(?iU)\b(telegram|whatsapp|snapchat|wickr)\b[.:@\s]*[\w./]+|" + PHONE + r"|\b(mdma|lsd|dmt|shrooms|coke)\b"
        r"|https?://(?!(?:www\.)?instagram\.com)"
    ),
    "reddit": (
        r"(?iU)https?://(?!(?:www\.)?reddit\.com|v\.redd\.it|i\.redd\.it)|\b(t\.me|telegram\.me)/\S+|" + PHONE
        + r"|\b(mdma|lsd|dmt|shrooms|onlyfans\.com)\b"
    ),
}
# What Unicode takes for white space.
# Single characters below 256 are looked up in a table; one range tells nearly all others from the rare spaces.
WHITE_SPACE = r"\t\n\x0B\f\r \x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
# Images, links, emphasis and strike-through, and what is left of each.
MARKDOWN = ((r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*{1,2}(.+?)\*{1,2}", "$1"), (r"~~(.+?)~~", "$1"))
# Fixed value: names of bots.
BOTS = r"(?iU)\b(automoderator|remindmebot|sneakpeekbot|imgurlinkcheckerbot|repostsleuthbot|anti[_\-]?meme[_\-]?bot)\b"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&amp;": "&"}


def coalesce_int(*values: Column) -> Column:
    """FN-01: the first value that is an integer (floats are truncated; text must be digits); else 0."""

    def whole(v: Column) -> Column:
        text = v.cast("string")
        number = text.rlike(r"^\s*[+-]?\d+(\.\d*)?([eE][+-]?\d+)?\s*$")
        return F.when(number, F.coalesce(F.trim(text).try_cast("long"), F.trim(text).try_cast("double").try_cast("long")))

    return F.coalesce(*map(whole, values), F.lit(0).cast("long"))


def truthy(v: Column) -> Column:
    """Null for what counts as absent: null, empty text."""
    return F.nullif(v, F.lit(""))


def epoch_ms(value: Column, seconds_only: bool = False, zulu: bool = True) -> Column:
    """FN-02: numbers (milliseconds from 1e12 on, else seconds) or ISO text, naive as UTC, to epoch ms."""
    number = value.try_cast("double")
    iso = value.cast("string")
    if not zulu:
        iso = F.when(~iso.endswith("Z"), iso)
    scaled = number * 1000 if seconds_only else F.when(number >= 1e12, number).otherwise(number * 1000)
    parsed = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_millis(iso.try_cast("timestamp")))
    return F.when(number.isNotNull(), scaled.try_cast("long")).otherwise(parsed)


# Fixed value: what counts as a character reference.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@cache
def _entity_text(names: tuple[str, ...]) -> str:
    """Names and what they stand for, as one text; the standard library has the table."""
    return "\x02".join(f"{n}\x01{html.entities.html5[n]}" for n in names)


def _entity(name: Column, legacy: bool) -> Column:
    """What a named reference stands for; ``legacy`` ones need no semicolon. The table is one constant."""
    names = tuple(sorted(n for n in html.entities.html5 if n.endswith(";") != legacy))
    return F.try_element_at(F.str_to_map(F.lit(_entity_text(names)), F.lit("\x02"), F.lit("\x01")), name)


def _numeric(reference: Column) -> Column:
    """The character of ``#...`` or ``#x...``: its code point's, with the standard's replacements."""
    wide = reference.rlike("^#[xX]")
    digits = F.regexp_replace(reference, "^#[xX]?0*|;$", "")
    some = F.when(digits != "", digits)
    number = F.when(wide, F.conv(some, 16, 10)).otherwise(some).cast("long")
    code = F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(F.coalesce(number, F.lit(0)))
    # References to these give other characters: the null, the carriage return and the control characters of old code pages.
    moved = "\x02".join(f"{c}\x01{html.unescape(f'&#{c};')}" for c in (0, 13, *range(0x80, 0xA0)))
    other = F.try_element_at(F.str_to_map(F.lit(moved), F.lit("\x02"), F.lit("\x01")), code.cast("string"))
    none = ((code >= 1) & (code <= 8)) | code.isin(11, 127) | ((code >= 14) & (code <= 31)) | ((code >= 0xFDD0) & (code <= 0xFDEF)) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    bad = ((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF)
    return F.coalesce(other, F.when(bad, "\ufffd").when(none, "").otherwise(own))


def _referred(reference: Column) -> Column:
    """What stands for a reference (without its ampersand): an entity, one that its name begins with, or the text as it is."""
    legacy = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
    start = F.regexp_extract(reference, f"^({'|'.join(legacy)})", 1)
    begun = F.when(start != "", F.concat(_entity(start, True), F.substring(reference, F.length(start) + 1, F.length(reference))))
    return F.when(reference.startswith("#"), _numeric(reference)).otherwise(F.coalesce(_entity(reference, False), begun, F.concat(F.lit("&"), reference)))


def html_unescape(text: Column) -> Column:
    """FN-03/04: all named and numeric references, with and without semicolon, as HTML 5 reads them; inside the JVM."""
    between = F.split(text, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), _referred)
    parts = F.zip_with(between, found, lambda before, made: F.concat(before, F.coalesce(made, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def _where(marker: str, change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``change`` of texts that contain ``marker``, which is far cheaper to look for than a pattern."""
    return lambda t: F.when(t.contains(marker), change(t)).otherwise(t)


def _replaced(pattern: str, into: str) -> Callable[[Column], Column]:
    return lambda t: F.regexp_replace(t, pattern, into)




def runs(space: str) -> str:
    """Pattern of the runs of ``space`` that are more than one blank: the blanks between words, most of a text's, cost no match."""
    return f"{space}(?:{space}+|(?<! ))"


_TEXT_STEPS = [html_unescape, _where("http", _replaced(r"(?U)https?://\S+", ""))]
_MARKDOWN_STEPS = [html_unescape, *[_where(m, _replaced(*p)) for m, p in zip(("![", "](", "*", "~~"), MARKDOWN, strict=True)]]
_LAST_STEPS = [_replaced(runs(f"[{WHITE_SPACE}]"), " "), lambda t: F.trim(t)]


def with_clean(df: DataFrame, text: Column, into: str, markdown: bool = False) -> DataFrame:
    """FN-03, FN-04 as a column: a projection for each step, so that each is made once and compiled."""
    df = df.withColumn(into, F.coalesce(text, F.lit("")))
    for step in (_MARKDOWN_STEPS if markdown else _TEXT_STEPS) + _LAST_STEPS:
        df = df.withColumn(into, step(F.col(into)))
    return df


def _chained(text: Column, steps: list[Callable[[Column], Column]]) -> Column:
    """All steps in one expression; each binds the one before by a function of an array's element."""
    text = F.coalesce(text, F.lit(""))
    for step in steps:
        text = F.element_at(F.transform(F.array(text), step), 1)
    return text


def clean_text(text: Column) -> Column:
    """FN-03: unescape, drop URLs, collapse white space. On a table, :func:`with_clean` is faster."""
    return _chained(text, _TEXT_STEPS + _LAST_STEPS)


def clean_markdown(text: Column) -> Column:
    """FN-04: unescape; drop images, keep link labels, drop emphasis; URLs stay."""
    return _chained(text, _MARKDOWN_STEPS + _LAST_STEPS)


def truncate_words(text: Column, limit: int) -> Column:
    """FN-05: at most ``limit`` characters, cut at the last space if there is one."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r"(?s)^(.*) .*$", "$1")
    return F.when(F.length(text) > limit, cut).otherwise(text)


def is_truncated(text: Column, limit: int) -> Column:
    return F.length(text) > limit


def is_low_value(text: Column) -> Column:
    """FN-06: fewer than four word characters."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\W+", "")) < 4


def is_spam(text: Column, platform: str, author: Column | None = None, mode: str = "as_written") -> Column:
    """FN-07 to FN-09; ``mode="intended"`` treats contact and phone as alternatives on Facebook."""
    name = "facebook_intended" if platform == "facebook" and mode == "intended" else platform
    found = F.coalesce(text, F.lit("")).rlike(SPAM[name])
    return found | F.coalesce(author, F.lit("")).rlike(BOTS) if author is not None else found


def is_mention_only(text: Column) -> Column:
    """FN-10, written so that matching needs no back-tracking."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^@\w+(\s*@\w+)*\s*$")


def extract_hashtags(text: Column) -> Column:
    """FN-11."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)#([\wÀ-ỹ]+)"), F.lit(1))


def parent_or_null(raw: Column) -> Column:
    """FN-12, Instagram."""
    text = F.trim(raw.cast("string"))
    return F.when(~text.isin("", "0"), text)


def parent_or_fallback(raw: Column, fallback: Column) -> Column:
    """FN-12, Reddit: only prefixed ids count."""
    text = F.trim(raw)
    return F.when(text.rlike(r"(?U)^t[1-6]_\w+$"), text).otherwise(fallback)


def ms_to_iso(ms: Column) -> Column:
    """FN-13: as UTC, to the second."""
    utc = F.convert_timezone(None, F.lit("UTC"), F.timestamp_millis(ms).cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd HH:mm:ss 'UTC'")


def json_text(value: Column, kind: str, empty: str | None = "{}") -> Column:
    """FN-14: text stays as it is, other values become JSON; null becomes ``empty``."""
    made = value if kind == "string" else F.to_json(value)
    return F.coalesce(made, F.lit(empty)) if empty is not None else made
