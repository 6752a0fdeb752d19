"""Text column expressions.

Two white space classes are in use, because the data rules come from two languages whose
definitions differ in a few characters. Spark's default `trim` and Java's bare `\\s` match neither.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space by Python and by ECMAScript.
_COMMON_SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PY_SPACES = _COMMON_SPACE + "\x1c\x1d\x1e\x1f\x85"
JS_SPACES = _COMMON_SPACE + "\ufeff"

# The same sets as pattern classes. The intersection rejects most letters with its first test.
_PY_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_JS_SET = r"\t-\r\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
PY_SPACE = rf"[[\x00-\x20\x85-\uffff]&&[{_PY_SET}]]"
JS_SPACE = rf"[[\x00-\x20\x85-\uffff]&&[{_JS_SET}]]"

# ECMAScript line rules: `.` and the multi-line anchors stop at these four characters. Java's own
# line start also follows U+0085; anchoring on it first and excluding that case is much cheaper
# than a test at every character. No pattern here begins with a line feed, so the place inside a
# carriage return and line feed pair, where the two rules differ, never matters.
JS_CHAR = r"[^\n\r\u2028\u2029]"
JS_LINE_START = r"(?m:^)(?<!\x85)"
JS_LINE_END = rf"(?!{JS_CHAR})"


def strip(c: Column, spaces: str = PY_SPACES) -> Column:
    """Drop white space at both ends."""
    return F.trim(c, F.lit(spaces))


def clean(c: Column) -> Column:
    """Null-safe strip; a missing value becomes the empty string."""
    return strip(F.coalesce(c, F.lit("")))


def or_default(c: Column, default: str | Column) -> Column:
    """The value, or a default when it is null or empty."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == ""), default).otherwise(c)


def source_name(source: Column) -> Column:
    """Publisher name of the nested source; a null struct, null or empty name is `Unknown`."""
    return or_default(source["name"], "Unknown")


def normalize_title(c: Column) -> Column:
    """Lower case, single spaces, and one trailing separator character removed."""
    lowered = strip(F.lower(F.coalesce(c, F.lit(""))))
    single_spaced = F.regexp_replace(lowered, rf"{PY_SPACE}+", " ")
    # Fixed pattern: the separators dropped at the end of a title.
    return F.regexp_replace(single_spaced, rf"{PY_SPACE}*[-–—|:]{PY_SPACE}*\z", "")


def url_key(c: Column) -> Column:
    return F.lower(clean(c))


def slug(c: Column) -> Column:
    """Address form of a title: ASCII letters, digits and hyphens, at most 80 characters.

    A title may be a page long: its start is rewritten first, and the whole only where that gives too little.
    """
    def hyphened(part: Column) -> Column:
        kept = F.regexp_replace(F.lower(part), rf"[^a-z0-9\-{_JS_SET}]", "")
        return F.regexp_replace(strip(kept, JS_SPACES), rf"{JS_SPACE}+", "-")

    parts = F.when(F.length(c) > 160, F.array(F.substring(c, 1, 160), c)).otherwise(F.array(c))
    whole = F.aggregate(parts, F.lit(""), lambda done, part: F.when(F.length(done) > 80, done).otherwise(hyphened(part)))
    return F.when(c.isNull() | (c == ""), F.lit("article")).otherwise(F.substring(whole, 1, 80))


def slug_of(value: str) -> str:
    """`slug` of a plain text."""
    kept = re.sub(rf"[^a-z0-9\-{_JS_SET}]", "", value.lower())
    return re.sub(f"[{_JS_SET}]+", "-", kept.strip(JS_SPACES))[:80] if value else "article"


def cut_repeated_block(c: Column, chunk: int) -> Column:
    """Text before the second occurrence of its own first `chunk` characters.

    Only an occurrence that starts after the first chunk counts, and only for texts longer
    than two chunks.
    """
    again = F.call_function("locate", F.substring(c, 1, chunk), c, F.lit(chunk + 1))
    return F.when(
        (F.length(c) > 2 * chunk) & (again > 0),
        strip(F.substr(c, F.lit(1), again - 1)),
    ).otherwise(c)


def word_count(c: Column) -> Column:
    """Number of runs of non-space characters."""
    text = strip(F.coalesce(c, F.lit("")), JS_SPACES)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, rf"{JS_SPACE}+"))).cast("bigint")


def keyword_list(*columns: Column) -> Column:
    """The non-empty values, as an array."""
    return F.array_compact(F.array(*[F.when(c != "", c) for c in columns]))


def keywords(*columns: Column) -> Column:
    return F.concat_ws(", ", *[F.when(c != "", c) for c in columns])


# Stands between the fields of a search text. No query holds it, so no hit spans two fields.
FIELD_BREAK = "\0"


def search_text(*fields: Column) -> Column:
    """Lower-case text of all fields, to be searched for lower-case substrings."""
    return F.lower(F.concat_ws(FIELD_BREAK, *fields))


def counted(n: Column, noun: str = "article") -> Column:
    """`1 article`, `2 articles`."""
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s")))


def report_cell(label: Column, n: Column) -> Column:
    """One line of the category report. The widths are a fixed format."""
    return F.format_string("  %-32s  %4d", label, n)


def topic_file_name(topic: Column, fetched: Column) -> Column:
    """Landing file name. The pattern is a fixed format."""
    stamp = F.date_format(fetched, "yyyy-MM-dd_HH-mm-ss")
    return F.concat(F.lit("news_"), F.replace(topic, F.lit(" "), F.lit("_")), F.lit("_"), stamp, F.lit(".json"))


def summary_file_name(n: Column) -> Column:
    """Report file name. The pattern is a fixed format."""
    return F.format_string("summary_%02d.txt", n)
