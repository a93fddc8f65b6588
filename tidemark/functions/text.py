"""Column functions on text: folding, identity hashes, padded term counts, excerpts, slugs."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that identity texts spell out.  "s&c" can never meet a word, as & becomes "and" first.
ABBREVIATIONS = {
    "sr": "senior", "jr": "junior", "asst": "assistant", "assoc": "associate", "coord": "coordinator", "spec": "specialist", "mgr": "manager", "dir": "director",
}
#: What remote work is recognised by.
REMOTE_HINTS = ["remote", "work from home", "telework", "virtual", "anywhere"]
#: Typographic characters and what they fold to, one for one: six quotation marks, eight dashes, four spaces.
FOLD_FROM, FOLD_TO = "‘’ʼ´“”‐‑‒–—―−­   ﻿", "''''\"\"--------    "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_only(c: Column | str) -> Column:
    """Lower case, & spelled out, every run of other characters than a-z and 0-9 one space."""
    return F.regexp_replace(F.replace(F.lower(_col(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")


def haystack(*parts: Column | str) -> Column:
    """The parts' words between spaces, for whole-word tests; null parts are empty."""
    joined = F.concat_ws(" ", *(F.coalesce(_col(p), F.lit("")) for p in parts))
    return F.regexp_replace(F.concat(F.lit(" "), words_only(joined), F.lit(" ")), " +", " ")


def canonical(c: Column | str) -> Column:
    """Words with abbreviations spelled out, single spaces, trimmed; null is empty."""
    table = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    words = F.filter(F.split(words_only(F.coalesce(_col(c), F.lit(""))), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def _digest(*parts: Column) -> Column:
    text = parts[0]
    for p in parts[1:]:
        text = F.concat(text, F.lit("\0"), p)
    return F.substring(F.sha2(text, 256), 1, 20)


def identity(source: Column | str, source_id: Column | str) -> Column:
    """20 hex digits for a record of a source."""
    return _digest(F.coalesce(_col(source), F.lit("")), F.coalesce(_col(source_id).cast("string"), F.lit("")))


def fingerprint(employer: Column | str, title: Column | str, location: Column | str) -> Column:
    """20 hex digits that records of one job share whatever the source."""
    return _digest(canonical(employer), canonical(title), canonical(location))


def feed_id(url: Column | str, title: Column | str) -> Column:
    return _digest(F.coalesce(_col(url), F.lit("")), F.coalesce(_col(title), F.lit("")))


def content_hash(*columns: str) -> Column:
    """A hash of columns by name, null and empty apart."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def term_count(hay: Column, needle: Column) -> Column:
    """Occurrences of a needle, none overlapping."""
    return ((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)).cast("int")


def excerpt(c: Column | str, limit: int = 400) -> Column:
    """White space collapsed; cut at a word's end within the limit, with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def slugify(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def looks_remote(*parts: Column | str) -> Column:
    text = F.lower(F.concat_ws(" ", *(F.coalesce(_col(p), F.lit("")) for p in parts)))
    return text.rlike("|".join(REMOTE_HINTS))


def fold_typography(c: Column | str) -> Column:
    return F.translate(_col(c), FOLD_FROM, FOLD_TO)


def unescape(c: Column) -> Column:
    """Character references decoded: numeric ones, also those of Windows' own range, and the named ones of HTML 4; unknown ones stay."""
    reference = "&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,8});?"
    names = F.create_map(*(F.lit(x) for name, point in name2codepoint.items() for x in (name, chr(point))), F.lit("apos"), F.lit("'"))
    windows = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
    remapped = F.create_map(*(F.lit(x) for n, char in windows.items() if char != "\ufffd" for x in (n, char)))

    def decoded(word: Column) -> Column:
        name = F.regexp_replace(word, "^&|;$", "")
        digits = F.regexp_extract(name, "^#[xX]?([0-9a-fA-F]+)$", 1)
        point = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(name.rlike("^#"), digits).try_cast("int")
        good = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        char = F.when(good, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        named = F.when(F.endswith(word, F.lit(";")), F.element_at(names, name))
        return F.coalesce(F.element_at(remapped, point), char, named, word)

    gaps, words = F.split(c, reference, -1), F.regexp_extract_all(c, F.lit(reference), F.lit(0))
    pieces = F.zip_with(gaps, words, lambda gap, word: F.concat(gap, F.coalesce(decoded(word), F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def html_to_text(c: Column | str) -> Column:
    """Text of markup: character references decoded, scripts, styles and comments out, block tags as line ends; null is empty.

    A text without any tag is no markup: all its white space is single spaces.
    """
    text = unescape(F.coalesce(_col(c), F.lit("")))
    plain, raw = ~F.contains(text, F.lit("<")), text
    text = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|blockquote|pre)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    text = F.regexp_replace(text, r"[ \t\r\f\x0B\u00a0]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")
    return F.when(plain, F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))).otherwise(text)


def deslugify(url: Column | str) -> Column:
    """A title from the last descriptive segment of a URL's path."""
    path = F.regexp_replace(F.regexp_replace(_col(url), "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda s: s.rlike("[a-zA-Z]{3}"))
    last = F.regexp_replace(F.element_at(F.when(F.size(parts) > 0, parts), -1), r"\.[a-z]{2,5}$", "")
    words = F.filter(F.split(last, "[-_+]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")
