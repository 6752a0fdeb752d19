"""Scalar column expressions over the articles and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import markup, prompts, text, times
from newsloom.operators.gates import NO_TEXT, content_outcome
from newsloom.sources.articles import AS_OF, article_rows, document_rows, read_table, site_rows
from registry.base import (
    ARTICLES, SITE, query, sql_day, sql_day_label, sql_excerpt, sql_html, sql_iso, sql_keywords, sql_plain,
    sql_short_date, sql_slug, sql_time, sql_title_key, NOW,
)

CATEGORIES = ("cat0", "cat1", "cat2", "cat3")


def pages(spark, folder):
    return read_table(spark, folder, "pages")


@query(ARTICLES + f" SELECT doc_id, {sql_title_key('title')} AS title_key FROM articles")
def normalize_title(spark, folder):
    return document_rows(spark, folder).select("doc_id", text.normalize_title(F.col("title")).alias("title_key"))


@query(ARTICLES + f" SELECT doc_id, lower(trim(url)) AS url_key, {sql_title_key('title')} AS title_key FROM articles")
def dedup_keys(spark, folder):
    return document_rows(spark, folder).select(
        "doc_id", text.url_key(F.col("url")).alias("url_key"), text.normalize_title(F.col("title")).alias("title_key")
    )


@query(ARTICLES + f" SELECT doc_id, {sql_slug('title')} AS slug, '/article/' || {sql_slug('title')} AS path FROM articles")
def slugs(spark, folder):
    title = F.col("title")
    return document_rows(spark, folder).select(
        "doc_id", text.slug(title).alias("slug"), F.concat(F.lit("/article/"), text.slug(title)).alias("path")
    )


@query(SITE + f" SELECT pos, {sql_excerpt('summary')} AS excerpt FROM site")
def excerpts(spark, folder):
    return document_rows(spark, folder).select(F.col("doc_id").alias("pos"), markup.excerpt(F.col("summary")).alias("excerpt"))


@query(ARTICLES + f""" SELECT doc_id, {sql_plain('summary')} AS plain_summary, {sql_plain('content')} AS plain_content
FROM articles""")
def strip_markdown(spark, folder):
    return document_rows(spark, folder).select(
        "doc_id", markup.strip_markdown(F.col("summary")).alias("plain_summary"),
        markup.strip_markdown(F.col("content")).alias("plain_content"),
    )


@query(ARTICLES + r""" SELECT doc_id,
  CAST(len(list_filter(string_split_regex(summary, '\s+'), lambda w: w <> '')) AS BIGINT) AS summary_words,
  CAST(len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) AS BIGINT) AS content_words
FROM articles""")
def word_counts(spark, folder):
    return document_rows(spark, folder).select(
        "doc_id", text.word_count(F.col("summary")).alias("summary_words"),
        text.word_count(F.col("content")).alias("content_words"),
    )


@query(SITE + f" SELECT pos, {sql_keywords('category', 'source')} AS keywords FROM site")
def keywords(spark, folder):
    return site_rows(spark, folder).select("pos", text.keywords(F.col("category"), F.col("source")).alias("keywords"))


@query(ARTICLES + f""" SELECT doc_id, {sql_html('summary')} AS summary_html, {sql_html('content')} AS content_html
FROM articles""")
def markdown_html(spark, folder):
    return document_rows(spark, folder).select(
        "doc_id", markup.markdown_to_html(F.col("summary")).alias("summary_html"),
        markup.markdown_to_html(F.col("content")).alias("content_html"),
    )


def _escaped_sql(c: str, quote: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
        f"chr(39), '{quote}')"
    )


@query(f"SELECT page_id, {_escaped_sql('html', '&#39;')} AS escaped FROM pages")
def escape_html(spark, folder):
    return pages(spark, folder).select("page_id", markup.escape_html(F.col("html")).alias("escaped"))


@query(f"SELECT page_id, {_escaped_sql('html', '&apos;')} AS escaped FROM pages")
def escape_xml(spark, folder):
    return pages(spark, folder).select("page_id", markup.escape_xml(F.col("html")).alias("escaped"))


@query(ARTICLES + f""" SELECT doc_id, {sql_iso('processed_at')} AS iso,
  strftime(coalesce({sql_time('processed_at')}, {NOW}), '%a, %d %b %Y %H:%M:%S') || ' GMT' AS rfc,
  {sql_short_date('processed_at')} AS short_date, {sql_day('processed_at')} AS day_key,
  strftime(coalesce({sql_time('processed_at')}, {NOW}), '%Y-%m-%d') AS lastmod,
  coalesce({sql_time('processed_at')} >= {NOW} - INTERVAL 2 DAY, false) AS recent,
  coalesce({sql_time('published_at')} BETWEEN {NOW} - INTERVAL 37 HOUR AND {NOW} - INTERVAL 25 HOUR, false) AS in_window
FROM articles""")
def date_columns(spark, folder):
    processed = F.col("processed_at")
    return article_rows(spark, folder).select(
        "doc_id", times.iso_instant(processed, AS_OF).alias("iso"), times.rfc_instant(processed, AS_OF).alias("rfc"),
        times.short_date(processed).alias("short_date"), times.day_key(processed).alias("day_key"),
        times.last_modified(processed, AS_OF).alias("lastmod"), times.is_recent(processed, AS_OF).alias("recent"),
        times.in_fetch_window(F.col("published_at"), AS_OF).alias("in_window"),
    )


@query(ARTICLES + f""", days AS (SELECT doc_id, {sql_day('processed_at')} AS day FROM articles)
SELECT doc_id, day, {sql_day_label('day')} AS label FROM days""")
def date_labels(spark, folder):
    days = article_rows(spark, folder).select("doc_id", times.day_key(F.col("processed_at")).alias("day"))
    return days.withColumn("label", times.day_label(F.col("day"), AS_OF))


GATE = """CASE WHEN length(content) < 1000
    THEN 'ValueError: Content too short (' || length(content) || ' chars, minimum is 1000)' END"""
CUT = """CASE WHEN length(content) > 300 AND instr(substr(content, 151), substr(content, 1, 150)) > 0
    THEN trim(substr(content, 1, 149 + instr(substr(content, 151), substr(content, 1, 150))), ' ' || chr(10))
    ELSE content END"""


@query(ARTICLES + f""" SELECT doc_id, {GATE} IS NULL AS ok, CASE WHEN {GATE} IS NULL THEN {CUT} END AS kept, {GATE} AS error
FROM articles""")
def content_gate_repeat_cut(spark, folder):
    stage = content_outcome(F.col("url"), F.col("content"))
    rows = document_rows(spark, folder).select("doc_id", stage.alias("s"))
    return rows.select("doc_id", F.col("s.ok").alias("ok"), F.col("s.value").alias("kept"), F.col("s.error").alias("error"))


@query(ARTICLES + """ SELECT doc_id,
  'Summarise the article below for a general reader in neutral words.' || chr(10)
    || 'Give one bold sentence, then a section "### Key Points" of 3 to 6 bullets, then a section "### Why it Matters" of one bullet.' || chr(10)
    || 'Use only facts of the article.' || chr(10) || chr(10) || 'Article:' || chr(10) || content || chr(10) AS summary_prompt,
  'Choose the label that fits the article best and answer with the label alone.' || chr(10) || 'Labels:' || chr(10)
    || '  cat0' || chr(10) || '  cat1' || chr(10) || '  cat2' || chr(10) || '  cat3' || chr(10) || '  Other' || chr(10)
    || 'Title: ' || title || chr(10) || 'Summary:' || chr(10) || summary AS label_prompt
FROM articles""")
def prompt_columns(spark, folder):
    return document_rows(spark, folder).select(
        "doc_id", prompts.summary_prompt(F.col("content")).alias("summary_prompt"),
        prompts.label_prompt(F.col("title"), F.col("summary"), CATEGORIES).alias("label_prompt"),
    )


def _page_text_sql() -> str:
    bare = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "nav", "footer", "aside", "form"):
        bare = rf"regexp_replace({bare}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    steps = [
        (r"[ \t\r\n]+", "' '"), (r"(?i)</t[dh]\s*>", "' '"),
        (r"(?i)</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|section|header|main|article|blockquote"
         r"|pre|figure|figcaption)\b[^>]*>", "chr(10)"),
        ("<[^>]*>", "''"),
    ]
    plain = "chosen"
    for pattern, value in steps:
        plain = f"regexp_replace({plain}, '{pattern}', {value}, 'g')"
    for entity, value in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"),
                          ("&apos;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        plain = f"replace({plain}, '{entity}', {value})"
    for pattern, value in ((" +", "' '"), (r" ?\n[ \n]*", "chr(10)"), (r"^[ \n]+|[ \n]+$", "''")):
        plain = f"regexp_replace({plain}, '{pattern}', {value}, 'g')"
    return rf"""WITH bare AS (SELECT page_id, {bare} AS b FROM pages), parts AS (
  SELECT page_id, b, regexp_extract(b, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS a,
    regexp_extract(b, '(?is)<body\b[^>]*>(.*)</body\s*>', 1) AS body FROM bare
), picked AS (
  SELECT page_id, CASE WHEN a <> '' THEN a WHEN body <> '' THEN body ELSE b END AS chosen FROM parts
) SELECT page_id, {plain} AS text FROM picked"""


@query(_page_text_sql())
def page_text(spark, folder):
    return pages(spark, folder).select("page_id", markup.page_text(F.col("html")).alias("text"))


@query(f"""WITH texts AS ({_page_text_sql()}),
gated AS (SELECT page_id, text AS content FROM texts)
SELECT page_id, CASE WHEN content = '' THEN '{NO_TEXT}' ELSE {GATE} END AS error,
  CASE WHEN content <> '' AND {GATE} IS NULL THEN {CUT} END AS kept FROM gated""")
def page_content_gate(spark, folder):
    rows = pages(spark, folder).select("page_id", "url", markup.page_text(F.col("html")).alias("text"))
    gated = rows.withColumn("stage", content_outcome(F.col("url"), F.col("text")))
    return gated.select("page_id", F.col("stage.error").alias("error"), F.col("stage.value").alias("kept"))


MARKERS = ("track(", "SITE_URL")


@query(r"""SELECT page_id,
  CASE WHEN regexp_matches(html, '(?is)<style[^>]*>.*?</style>')
    THEN trim(regexp_extract(html, '(?is)<style[^>]*>(.*?)</style>', 1)) END AS style,
  trim(list_filter(regexp_extract_all(html, '(?is)<script>(.*?)</script>', 1),
    lambda s: contains(s, 'track(') OR contains(s, 'SITE_URL'))[1]) AS script
FROM pages""")
def page_assets(spark, folder):
    return pages(spark, folder).select(
        "page_id", markup.page_style(F.col("html")).alias("style"),
        markup.page_script(F.col("html"), MARKERS).alias("script"),
    )
