"""Text expressions: all native columns, so they stay in generated JVM code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values that results depend on.
TOKEN_PATTERN = r"[A-Za-z]+|\d+|[一-鿿]"
CJK_PATTERN = r"[一-鿿]"
INVISIBLE = "​‌‍‎‏﻿­⁠"
BOILERPLATE_PATTERNS = (
    r"^\s*第\s*\d+\s*页(\s*/\s*共\s*\d+\s*页)?\s*$",
    r"(?i)^\s*Page\s+\d+\s*(of\s+\d+)?\s*$",
    r"^\s*-\s*\d+\s*-\s*$",
    r"^\s*(公司内部资料|内部文件|机密文件|仅供内部使用)[，。!！]?\s*$",
    r"(?i)^\s*(Confidential|Internal Use Only|All Rights Reserved).*$",
    r"^\s*版权所有\s*©?.*$",
    r"^\s*©\s*\d{4}.*$",
    r"^\s*(上一页|下一页|返回目录|回到顶部)\s*$",
)
HEADING_PATTERN = r"^\s*#{1,6}\s+\S"
STATEMENT_ENDS = r"[。.!?！？\n]"
NUMBER_PATTERN = r"\d{4}|\d{1,3}(?:[,.]\d{3})+|\d+(?:\.\d+)?"
DATE_PATTERN = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
REWRITE_FLUFF = ("怎么办", "怎么", "吗", "我想知道", "请问", "请告诉我")
WHITE = r"[\s　   -     \u0085]"
WHITE_CHARS = "".join(c for c in map(chr, range(1 << 16)) if re.match(WHITE, c, re.ASCII))
KEYWORD_STOPS = ("the", "and", "for", "are")  # of the stop words, those that have three letters or more


def tokens(text: Column) -> Column:
    """Latin runs, digit runs and single CJK characters, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends (by a list of characters: a pattern would try every white space inside)."""
    return F.btrim(text, F.lit(WHITE_CHARS))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often and in whatever branch it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_chars(text: Column, others: str) -> Column:
    """How many characters are not of a class (a pattern of runs of the others is given)."""
    return F.char_length(F.regexp_replace(text, others, ""))


def detect_language(text: Column) -> Column:
    """zh, en, mixed, or unknown for fewer than five letters."""

    def judged(n: Column) -> Column:
        share = n["cjk"] / (n["cjk"] + n["latin"])
        return F.when(F.coalesce(n["cjk"] + n["latin"], F.lit(0)) < 5, "unknown").when(share >= 0.7, "zh").when(share <= 0.1, "en").otherwise("mixed")

    return once(F.struct(count_chars(text, "[^一-鿿]+").alias("cjk"), count_chars(text, "[^A-Za-z]+").alias("latin")), judged)


def quality_verdict(text: Column, min_chars: int = 30, max_symbol_share: float = 0.5) -> Column:
    """The first reason why a text is of no use for retrieval, or ok."""

    def judged(s: Column) -> Column:
        letters = count_chars(s, r"[^\p{L}\p{N}]+")
        return (
            F.when(F.char_length(s) < min_chars, f"too_short(<{min_chars})")
            .when(s.rlike(r"^[\s\d.\-_、。，,]+$"), "digits_punct_only")
            .when(F.contains(s, F.lit("....")) & (F.regexp_count(s, F.lit(r"\.{4,}\s*\d+")) >= 3), "looks_like_toc")
            .when(letters / F.greatest(F.char_length(s), F.lit(1)) < 1 - max_symbol_share, "mostly_symbols")
            .otherwise("ok")
        )

    return once(stripped(F.coalesce(text, F.lit(""))), judged)


def approx_tokens(text: Column) -> Column:
    """CJK characters, or 1.3 times the Latin words if that is more."""
    words = F.regexp_count(text, F.lit("[A-Za-z]+"))
    return F.greatest(count_chars(text, "[^一-鿿]+"), F.floor(words * F.lit(13) / F.lit(10))).cast("int")


def html_strip(html: Column) -> Column:
    """Markup to text, with table rows as pipes and headings as hashes."""
    out = F.regexp_replace(html, r"(?is)<(script|style).*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)</t[hd]>\s*<t[hd][^>]*>", " | ")
    out = F.regexp_replace(out, r"(?i)<tr[^>]*>", "\n| ")
    out = F.regexp_replace(out, r"(?i)</tr>", " |")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{level}[^>]*>", "\n" + "#" * level + " ")
    out = F.regexp_replace(out, r"(?i)</(h[1-6]|p|div|li|br)>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def statements(text: Column) -> Column:
    """Sentences of two characters or more."""
    return F.filter(F.transform(F.split(text, STATEMENT_ENDS, -1), stripped), lambda s: F.char_length(s) >= 2)


def unsupported_numbers(answer: Column, contexts: Column) -> Column:
    """Distinct numbers and dates of an answer that no context has."""
    found = F.array_distinct(F.concat(F.regexp_extract_all(answer, F.lit(NUMBER_PATTERN), F.lit(0)), F.regexp_extract_all(answer, F.lit(DATE_PATTERN), F.lit(0))))
    return F.filter(found, lambda x: ~F.exists(contexts, lambda c: F.contains(c, x)))


def strip_boilerplate(text: Column, repeated: Column | None = None, max_len: int = 60) -> Column:
    """Without page furniture, repeated short lines (an array), and headings that are left with nothing below."""

    def furniture(line: Column) -> Column:
        s = stripped(line)
        hit = F.lit(False)
        for pattern in BOILERPLATE_PATTERNS:
            hit = hit | s.rlike(pattern)
        if repeated is not None:
            hit = hit | (F.array_contains(repeated, s) & (F.char_length(s) <= max_len))
        return (F.char_length(s) > 0) & hit

    kept = F.filter(lines(text), lambda line: ~furniture(line))
    # From the last line to the first, a heading stays if a line with text was seen since the heading after it.
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("body"))

    def step(acc: Column, line: Column) -> Column:
        heading = line.rlike(HEADING_PATTERN)
        out = F.when(heading & ~acc["body"], acc["out"]).otherwise(F.array_prepend(acc["out"], line))
        return F.struct(out.alias("out"), F.when(heading, False).otherwise(acc["body"] | (F.char_length(stripped(line)) > 0)).alias("body"))

    joined = F.array_join(F.aggregate(F.reverse(kept), start, step, lambda acc: acc["out"]), "\n")
    return stripped(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def tidy(text: Column) -> Column:
    """Everything of normalisation but the compatibility mapping of characters (see normalize in functions.python)."""
    out = F.translate(F.coalesce(text, F.lit("")), INVISIBLE, "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.replace(out, F.lit("\t"), F.lit(" "))
    out = F.regexp_replace(out, r"[ 　]{2,}", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, rf"(?m)[{WHITE[1:-1].replace(chr(92) + 's', ' ' + chr(92) + 't' + chr(92) + 'f' + chr(92) + 'x0B')}]+$", "")
    return stripped(out)


def drop_controls(text: Column) -> Column:
    """Without ASCII controls (but tab and line ends) and zero-width characters."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f​-‏⁠﻿]", "")


def heuristic_rewrite(question: Column) -> Column:
    out = question
    for fluff in REWRITE_FLUFF:
        out = F.replace(out, F.lit(fluff), F.lit(""))
    out = stripped(F.translate(out, "?？", ""))
    return F.substring(F.when(F.char_length(out) > 0, out).otherwise(question), 1, 12)


def title_only(text: Column) -> Column:
    """Shorter than 25 characters, a single heading line, or a bare question."""
    return once(stripped(text), lambda s: (F.char_length(s) < 25) | (s.startswith("#") & ~F.contains(s, F.lit("\n"))) | s.endswith("?") | s.endswith("？"))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def truncated(text: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, max(0, n - len(suffix))), F.lit(suffix)))


def count_words(text: Column) -> Column:
    """Words of any script plus CJK characters."""
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b")) + F.regexp_count(text, F.lit(CJK_PATTERN))


def frontmatter(text: Column) -> Column:
    """struct(meta map, body) of a text that begins with a closed --- header; else an empty map and the text."""
    pattern = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"
    closed = text.rlike(pattern)
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract(text, pattern, 1), "\n"), lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("key"), F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value")),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(F.when(closed, F.map_from_entries(pairs)).otherwise(empty).alias("meta"), F.when(closed, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def fixed_windows(text: Column, size: int = 200, overlap: int = 30) -> Column:
    """Character windows of a fixed size that overlap."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda s: F.substr(text, s, F.lit(size))), lambda w: F.char_length(w) > 0)
