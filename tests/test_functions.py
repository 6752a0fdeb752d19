"""Column expressions: hand-derived inputs and outputs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from newsloom.functions import markup, prompts, structured, text, times

AS_OF = "2024-01-03 12:00:00"


def apply(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def check(spark, expression, cases):
    got = apply(spark, expression, [c[0] for c in cases])
    assert list(zip([c[0] for c in cases], got)) == cases


def test_white_space_sets_agree_with_patterns():
    import regex

    for chars, group in ((text.PY_SPACES, text.PY_SPACE), (text.JS_SPACES, text.JS_SPACE)):
        pattern = regex.compile(group, regex.V1)
        members = {chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and pattern.fullmatch(chr(i))}
        assert members == set(chars)
    assert set(text.PY_SPACES) == {chr(i) for i in range(0x10000) if chr(i).isspace()}


def test_strip_is_unicode_aware(spark):
    check(spark, text.clean, [("\t  a b　\x1f\n", "a b"), (None, ""), (" ", ""), ("﻿a", "﻿a")])
    check(spark, lambda c: text.strip(c, text.JS_SPACES), [("﻿a ", "a"), ("\x1fa", "\x1fa")])


def test_normalize_title(spark):
    check(spark, text.normalize_title, [
        ("  Big  News\n Today | ", "big news today"), ("a --", "a -"), ("x:", "x"), ("x — ", "x"),
        (None, ""), ("", ""), ("-", ""), ("A - B", "a - b"),
    ])


def test_slug(spark):
    check(spark, text.slug, [
        ("Hello, World!", "hello-world"), ("A - B", "a---b"), ("", "article"), (None, "article"), ("Éé", ""),
        ("  x y ", "x-y"), ("-edge-", "-edge-"), ("w" * 90, "w" * 80),
    ])


def test_cut_repeated_block(spark):
    block = "abcdefghij"
    check(spark, lambda c: text.cut_repeated_block(c, 5), [
        (block, block), (block + " \n" + block, block), ("aaaaaaaaaaaaaaaa", "aaaaa"), ("abcde12345x", "abcde12345x"),
        (None, None),
    ])


def test_counts_and_lists(spark):
    check(spark, text.word_count, [("a  b\nc", 3), ("", 0), (None, 0), ("   ", 0), ("one", 1)])
    rows = spark.createDataFrame([("c", "s"), ("", "s"), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(text.keywords(F.col("a"), F.col("b"))).collect()] == ["c, s", "s", ""]
    assert [r[0] for r in rows.select(text.keyword_list(F.col("a"), F.col("b"))).collect()] == [["c", "s"], ["s"], []]
    assert [r[0] for r in spark.range(3).orderBy("id").select(text.counted(F.col("id"))).collect()] == [
        "0 articles", "1 article", "2 articles"
    ]


def test_file_names_and_cells(spark):
    row = spark.range(1).select(
        text.topic_file_name(F.lit("Data breach"), F.lit("2026-08-22 13:36:21").cast("timestamp")).alias("f"),
        text.summary_file_name(F.lit(3)).alias("s"),
        text.report_cell(F.lit("Cybersecurity"), F.lit(7)).alias("c"),
    ).first()
    assert row["f"] == "news_Data_breach_2026-08-22_13-36-21.json"
    assert row["s"] == "summary_03.txt"
    assert row["c"] == f"  {'Cybersecurity':<32}  {7:>4}"


def test_source_name(spark):
    rows = spark.createDataFrame(
        [((None, "X"),), ((None, ""),), ((None, None),), (None,)], "source struct<id:string,name:string>"
    )
    assert [r[0] for r in rows.select(text.source_name(F.col("source"))).collect()] == ["X"] + ["Unknown"] * 3


def test_escapes(spark):
    raw = "<a href=\"x\">Tom & 'J'</a>"
    check(spark, markup.escape_html, [(raw, "&lt;a href=&quot;x&quot;&gt;Tom &amp; &#39;J&#39;&lt;/a&gt;"), (None, "")])
    check(spark, markup.escape_xml, [(raw, "&lt;a href=&quot;x&quot;&gt;Tom &amp; &apos;J&apos;&lt;/a&gt;")])
    check(spark, markup.cdata, [("a]]>b", "<![CDATA[a]]]]><![CDATA[>b]]>")])


def test_strip_markdown_and_excerpt(spark):
    check(spark, markup.strip_markdown, [
        ("### Head\n**bold** *it* `c` [t](u)\n\n- x", "Head bold it c t - x"), (None, ""), ("#no", "#no"),
        ("**a\nb**", "**a b**"),
    ])
    check(spark, markup.excerpt, [("x" * 155, "x" * 155), ("x" * 156, "x" * 154 + "…")])


def test_markdown_to_html(spark):
    check(spark, markup.markdown_to_html, [
        (None, ""), ("", ""),
        ("plain\ntext", "<p>plain text</p>"),
        ("# One\n\n## Two\n\n### Three", "<h2>One</h2>\n<h2>Two</h2>\n<h3>Three</h3>"),
        ("**Lead**\nnext", "<p><strong>Lead</strong></p>\n<p>next</p>"),
        ("a **b** *c* `d` & <e>", "<p>a <strong>b</strong> <em>c</em> <code>d</code> &amp; &lt;e&gt;</p>"),
        ("- one\n- two", "<ul><li>one</li>\n<li>two</li></ul>"),
        # The list takes in the newline behind it, so the heading stays in its block.
        ("- one\n\n### Head", "<ul><li>one</li>\n</ul>\n<h3>Head</h3>"),
        ("[t](u)", "<p>[t](u)</p>"),
    ])


def test_long_list_does_not_overflow(spark):
    n = 50_000
    html = apply(spark, markup.markdown_to_html, ["\n".join(["- item"] * n)])[0]
    assert html.count("<li>") == n and html.startswith("<ul>")


def test_page_text_and_assets(spark):
    page = (
        "<html><head><style> p{} </style><style>q{}</style><script>var a='</p>';</script>"
        "<script>let SITE_URL=1;</script></head><body><nav>menu</nav><!-- <p>no</p> -->"
        "<article><h1>T &amp; U</h1><p>One<br>two &lt;3</p><table><tr><td>a</td><td>b</td></tr></table>"
        "<footer>f</footer></article><p>outside</p></body></html>"
    )
    check(spark, markup.page_text, [
        (page, "T & U\nOne\ntwo <3\na b"), ("<body><p>x</p></body>", "x"), ("bare <b>text</b>", "bare text"),
    ])
    check(spark, markup.page_style, [(page, "p{}"), ("<p>", None), ("<style></style>", "")])
    check(spark, markup.page_script, [(page, "let SITE_URL=1;"), ("<script>x</script>", None)])


def test_times(spark):
    check(spark, lambda c: times.iso_instant(c, AS_OF), [
        ("2024-01-02T03:04:05.678", "2024-01-02T03:04:05.678Z"), ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.000Z"),
        ("2024-01-02T03:04:05+02:00", "2024-01-02T01:04:05.000Z"), ("2024-01-02", "2024-01-02T00:00:00.000Z"),
        ("", "2024-01-03T12:00:00.000Z"), (None, "2024-01-03T12:00:00.000Z"), ("junk", "2024-01-03T12:00:00.000Z"),
        ("12:30", "2024-01-03T12:00:00.000Z"),
    ])
    check(spark, lambda c: times.rfc_instant(c, AS_OF), [("2024-01-02T03:04:05", "Tue, 02 Jan 2024 03:04:05 GMT")])
    check(spark, times.short_date, [("2026-08-02T00:00:00", "Aug 2, 2026"), ("junk", ""), (None, "")])
    check(spark, times.day_key, [("2026-08-02T23:59:59", "2026-08-02"), ("junk", "unknown")])
    check(spark, lambda c: times.day_label(c, AS_OF), [
        ("2024-01-03", "Today"), ("2024-01-02", "Yesterday"), ("2024-01-01", "Monday, January 1, 2024"),
        ("unknown", "Unknown date"),
    ])
    check(spark, lambda c: times.is_recent(c, AS_OF), [
        ("2024-01-01T12:00:00", True), ("2024-01-01T11:59:59", False), ("2030-01-01", True), ("junk", False),
    ])
    check(spark, lambda c: times.in_fetch_window(c, AS_OF), [
        ("2024-01-01T23:00:00", True), ("2024-01-01T22:59:59", False), ("2024-01-02T11:00:00", True),
        ("2024-01-02T11:00:01", False),
    ])


def test_prompts(spark):
    row = spark.range(1).select(
        prompts.summary_prompt(F.lit("BODY {text}")).alias("s"),
        prompts.label_prompt(F.lit("T"), F.lit("S"), ["A", "B"]).alias("l"),
    ).first()
    assert row["s"].endswith("Article:\nBODY {text}\n")
    assert "\n  A\n  B\n  Other\nTitle: T\n" in row["l"] and row["l"].endswith("Summary:\nS")


def test_breadcrumb_leaves_out_missing_link(spark):
    got = spark.range(1).select(structured.breadcrumb_ld(
        [F.lit("Home"), F.lit("About")], [F.lit("/"), F.lit(None).cast("string")], "https://s"
    )).first()[0]
    assert got == (
        '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":['
        '{"@type":"ListItem","position":1,"name":"Home","item":"https://s/"},'
        '{"@type":"ListItem","position":2,"name":"About"}]}'
    )


@pytest.mark.parametrize("name", ["SUMMARY_PROMPT", "LABEL_PROMPT"])
def test_prompt_templates_have_their_places(name):
    template = getattr(prompts, name)
    assert ("{text}" in template) if name == "SUMMARY_PROMPT" else ("{labels}" in template)


def test_slugs_of_long_titles(spark):
    rng = random.Random(3)
    bits = ["a", "B", "é", "-", " ", "  ", "　", "\n", "Σ", "İ", "!", "?" * 40, " " * 90, "word ", "🙂", "x" * 50]
    values = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 120))) for _ in range(1500)]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for row in rows.select("v", text.slug(F.col("v")).alias("out")).collect():
        assert row["out"] == text.slug_of(row["v"]), repr(row["v"])


def test_the_start_of_a_long_title_is_enough(spark):
    long_ = spark.range(200).select(F.concat(F.lit("Some words of a title "), F.repeat(F.concat(F.lit("a page of text "), F.col("id")), 20000)).alias("v"))
    begun = time.monotonic()
    assert {r[0] for r in long_.select(F.length(text.slug(F.col("v")))).collect()} == {80}
    first = time.monotonic() - begun
    begun = time.monotonic()
    long_.select(F.length(F.regexp_replace(F.col("v"), rf"{text.JS_SPACE}+", "-"))).collect()
    assert first < time.monotonic() - begun
