"""The line by line Markdown rewriting against the same patterns over whole texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from newsloom.functions import markup

ENDS = "\n\r\u2028\u2029"
DOT, SPACE = f"[^{ENDS}]", "[\\t-\\r\\x20\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
SPACES = "".join(chr(c) for c in range(0x10000) if re.fullmatch(SPACE, chr(c)))
START, END = f"(?:(?<=[{ENDS}])|\\A)", f"(?=[{ENDS}]|\\Z)"


def plainly(text):
    for pattern, value in ((f"#{{1,6}}{SPACE}+", ""), (rf"\*\*({DOT}+?)\*\*", r"\1"), (rf"\*({DOT}+?)\*", r"\1"), (f"`({DOT}+?)`", r"\1"),
                           (rf"\[({DOT}+?)\]\({DOT}+?\)", r"\1"), (r"\n+", " ")):
        text = re.sub(pattern, value, text)
    return text.strip(SPACES)


def as_html(text):
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    for pattern, value in (
        (rf"{START}\*\*({DOT}+?)\*\*{SPACE}*{END}", "**\\1**\n\n"), (f"{START}### ({DOT}+){END}", r"<h3>\1</h3>"),
        (f"{START}## ({DOT}+){END}", r"<h2>\1</h2>"), (f"{START}# ({DOT}+){END}", r"<h2>\1</h2>"),
        (rf"\*\*({DOT}+?)\*\*", r"<strong>\1</strong>"), (rf"\*({DOT}+?)\*", r"<em>\1</em>"), (f"`({DOT}+?)`", r"<code>\1</code>"),
        (f"{START}[ \\t]*[-*]{SPACE}+({DOT}+){END}", r"<li>\1</li>"), (r"((?:<li>[^\n]*</li>\n?)+)", r"<ul>\1</ul>"),
    ):
        text = re.sub(pattern, value, text)
    out = []
    for block in re.split(r"\n{2,}", text):
        block = block.strip(SPACES)
        if block:
            out.append(block if re.match("<(h[1-6]|ul|ol|li|blockquote|pre|div)", block) else "<p>" + block.replace("\n", " ") + "</p>")
    return "\n".join(out)


def texts(seed, bits, n=1500):
    rng = random.Random(seed)
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(n)]


LINES = ["**Bold line**", "**a** b **c**", "### Head", "## Two", "# One", "#### Four", "- item", "* item *x*", "  - deep", "plain", "`code` x", "[t](u) y",
         "", "", "   ", "-", "*", "# ", "#", "- ", "** **", "****", "*****", "a - b", "x #", "**open", "é <b> & \"q\"", "-no", "*em* start", " - nb", "- nb"]


@pytest.mark.parametrize("seed,bits", [
    (1, [line + "\n" for line in LINES] + LINES), (2, ["*", "**", "#", "`", "[", "](", ")", "-", " ", "\n", "a", "b", "\t"]),
    (3, ["*", "- ", "# ", "\n", "\r", "\u2028", "x", " ", "**"]), (4, ["**T**", "\n", " ", "\n\n", "- a", "\t", "y"]),
])
def test_lines_equal_whole_texts(spark, seed, bits):
    values = [*texts(seed, bits), None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for row in frame.select("v", markup.strip_markdown(frame.v).alias("plain"), markup.markdown_to_html(frame.v).alias("html")).collect():
        assert row["plain"] == plainly(row["v"] or ""), repr(row["v"])
        assert row["html"] == as_html(row["v"] or ""), repr(row["v"])


@pytest.mark.parametrize("derived", [markup.strip_markdown, markup.excerpt])
def test_a_text_is_rewritten_once(spark, derived):
    """A column named often below a lambda is worked out as often, so the plan may split a text into lines once."""
    plan = spark.createDataFrame([("a",)], "v string").select(derived(F.col("v")).alias("out"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


@pytest.mark.parametrize("seed,bits", [
    (5, [line + "\n" for line in LINES] + LINES), (6, ["*", "**", "#", "`", "[", "](", ")", "-", " ", "\n", "a", "b", "\t"]),
    (7, ["*", "# ", "#", "\n", "\r", "\u2028", "x", " ", "**"]),
])
@pytest.mark.parametrize("limit", [2, 5, 9])
def test_excerpts_are_the_start_of_the_plain_text(spark, seed, bits, limit):
    rng = random.Random(seed)
    values = [*("".join(rng.choice(bits) for _ in range(rng.randrange(70))) for _ in range(1500)), None]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    for row in frame.select("v", markup.excerpt(frame.v, limit).alias("out")).collect():
        plain = plainly(row["v"] or "")
        assert row["out"] == (plain if len(plain) <= limit else plain[: limit - 1] + "…"), repr(row["v"])


def test_an_excerpt_reads_the_lines_it_needs(spark):
    """The rules run on the first lines alone: a text of many marked lines takes no longer than its start."""
    line = F.concat(F.lit("**a** *b* `c` [d](e) words of line "), F.col("id"), F.lit("\n"))
    long_ = spark.range(60).select(F.repeat(line, 5000).alias("v"))
    took = {}
    for _ in range(3):
        for name, derived in (("excerpt", markup.excerpt), ("all", markup.strip_markdown)):
            begun = time.monotonic()
            long_.select(F.length(derived(F.col("v")))).collect()
            took[name] = time.monotonic() - begun  # the last run is warm
    assert took["excerpt"] < took["all"] / 2
