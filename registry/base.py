"""Registration, and the SQL form of the shared article and site views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.sources.articles import AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL where there is one."""
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, folder)

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


NOW = f"TIMESTAMP '{AS_OF}'"

ARTICLES = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l, text, lang, source FROM documents
), articles AS (
  SELECT d.doc_id, e.event_type AS topic,
    'https://www.example.org/' || CAST(CASE WHEN d.doc_id % 10 = 9 THEN d.doc_id - 1 ELSE d.doc_id END AS VARCHAR) AS url,
    l[1] AS title,
    CASE WHEN d.doc_id % 11 <> 0 THEN 'user' || CAST(e.user_id AS VARCHAR) END AS author,
    d.source AS source_name, d.lang, 'cat' || CAST(e.user_id % 5 AS VARCHAR) AS category,
    d.text AS content,
    '**' || l[1] || '**' || chr(10) || chr(10) || '### Key Points' || chr(10)
      || array_to_string(list_transform(l[2:], lambda x: '- ' || x), chr(10))
      || chr(10) || chr(10) || '### Why it Matters' || chr(10) || '- ' || l[1] AS summary,
    strftime(e.ts, '%Y-%m-%dT%H:%M:%S') AS published_at,
    CASE WHEN d.doc_id % 97 = 0 THEN '' WHEN d.doc_id % 89 = 0 THEN 'not a date'
         ELSE strftime(e.ts, '%Y-%m-%dT%H:%M:%S') END AS processed_at
  FROM lines d LEFT JOIN events e ON e.event_id = d.doc_id
)"""

QUEUED = ARTICLES + """, queued AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id) - 1 AS pos FROM articles
)"""

SITE = ARTICLES + """, site AS (
  SELECT doc_id AS pos, title, summary, coalesce(author, '') AS author, source_name AS source, url,
    category, processed_at FROM articles
)"""


def sql_slug(c: str) -> str:
    return (
        f"(CASE WHEN {c} IS NULL OR {c} = '' THEN 'article' ELSE substr(regexp_replace(trim("
        rf"regexp_replace(lower({c}), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g'), 1, 80) END)"
    )


def sql_title_key(c: str) -> str:
    return (
        r"regexp_replace(regexp_replace(trim(lower(coalesce(" + c + r", '')), ' ' || chr(10)), '\s+', ' ', 'g'), "
        r"'\s*[-–—|:]\s*$', '')"
    )


def sql_time(c: str) -> str:
    return f"try_cast({c} AS TIMESTAMP)"


def sql_iso(c: str) -> str:
    return f"strftime(coalesce({sql_time(c)}, {NOW}), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(coalesce({sql_time(c)}, {NOW})) % 1000 AS VARCHAR), 3, '0') || 'Z'"


def sql_day(c: str) -> str:
    return f"coalesce(strftime({sql_time(c)}, '%Y-%m-%d'), 'unknown')"


def sql_short_date(c: str) -> str:
    t = sql_time(c)
    return f"coalesce(strftime({t}, '%b ') || CAST(day({t}) AS VARCHAR) || strftime({t}, ', %Y'), '')"


def sql_day_label(key: str) -> str:
    t = f"try_cast({key} AS TIMESTAMP)"
    return (
        f"CASE WHEN {key} = 'unknown' THEN 'Unknown date' WHEN {key} = strftime({NOW}, '%Y-%m-%d') THEN 'Today' "
        f"WHEN {key} = strftime({NOW} - INTERVAL 1 DAY, '%Y-%m-%d') THEN 'Yesterday' "
        f"ELSE strftime({t}, '%A, %B ') || CAST(day({t}) AS VARCHAR) || strftime({t}, ', %Y') END"
    )


def sql_or(c: str, default: str) -> str:
    return f"coalesce(nullif({c}, ''), '{default}')"


def sql_keywords(*columns: str) -> str:
    return "concat_ws(', ', " + ", ".join(f"nullif({c}, '')" for c in columns) + ")"


def sql_plain(c: str) -> str:
    """Markdown stripped."""
    text = f"coalesce({c}, '')"
    for pattern, value in (
        (r"#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"`(.+?)`", r"\1"),
        (r"\[(.+?)\]\(.+?\)", r"\1"), (r"\n+", " "),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{value}', 'g')"
    return f"trim({text})"


def sql_excerpt(c: str) -> str:
    plain = sql_plain(c)
    return f"CASE WHEN length({plain}) > 155 THEN substr({plain}, 1, 154) || '…' ELSE {plain} END"


def sql_html(c: str) -> str:
    """Markdown as HTML."""
    text = f"replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    for pattern, value in (
        (r"(?m)^\*\*(.+?)\*\*\s*$", r"'**\1**' || chr(10) || chr(10)"),
        (r"(?m)^### (.+)$", r"'<h3>\1</h3>'"),
        (r"(?m)^## (.+)$", r"'<h2>\1</h2>'"),
        (r"(?m)^# (.+)$", r"'<h2>\1</h2>'"),
        (r"\*\*(.+?)\*\*", r"'<strong>\1</strong>'"),
        (r"\*(.+?)\*", r"'<em>\1</em>'"),
        (r"`(.+?)`", r"'<code>\1</code>'"),
        (r"(?m)^[ \t]*[-*]\s+(.+)$", r"'<li>\1</li>'"),
        (r"((?:<li>[^\n]*</li>\n?)+)", r"'<ul>\1</ul>'"),
    ):
        text = f"regexp_replace({text}, '{pattern}', {value}, 'g')"
    blocks = rf"list_transform(string_split_regex({text}, '\n{{2,}}'), lambda b: trim(b, ' ' || chr(10)))"
    block = "(h[1-6]|ul|ol|li|blockquote|pre|div)"
    wrapped = (
        f"list_transform(list_filter({blocks}, lambda b: b <> ''), lambda b: CASE WHEN regexp_matches(b, '^<{block}') "
        "THEN b ELSE '<p>' || replace(b, chr(10), ' ') || '</p>' END)"
    )
    return f"array_to_string({wrapped}, chr(10))"
