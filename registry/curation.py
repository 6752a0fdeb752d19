"""Landing documents, round-robin order, greedy selection and topic search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import clean, or_default
from newsloom.operators import corpus
from newsloom.operators.interleave import dense_index, file_order, round_robin
from newsloom.operators.joins import hinted
from newsloom.operators.selection import greedy_select, in_blocks, source_distribution
from newsloom.session import settle
from newsloom.sources.articles import AS_OF, article_rows, event_facts, queued_articles, queued_facts, read_table
from newsloom.sources.landing import envelope, flatten
from registry.base import ARTICLES, NOW, QUEUED, query

PAGE = 100
TOPICS = ("The", "that thin", "tion ing er", "Zyx")


def ranked_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Selection input: a topic is a file, fetched at the time of its newest article; articles without a topic are a file without a time."""
    facts = queued_facts(spark, folder)
    path = F.coalesce("topic", F.lit("")).alias("path")
    files = facts.groupBy(path).agg(F.max("published_at").cast("timestamp").alias("fetch_ts"))
    rows = article_rows(spark, folder, facts).select(
        "doc_id", path, "pos", clean(F.col("url")).alias("url"),
        clean(F.col("title")).alias("title"), clean(F.col("author")).alias("author"),
        or_default(F.col("source_name"), "Unknown").alias("source"),
    )
    return round_robin(rows, files)


RANKED = QUEUED + """, files AS (
  SELECT topic, row_number() OVER (ORDER BY max(published_at) DESC NULLS LAST, topic) - 1 AS file_rank
  FROM articles GROUP BY topic
), ranked AS (
  SELECT q.doc_id, q.topic, q.pos, trim(q.url) AS url, trim(coalesce(q.title, '')) AS title,
    coalesce(q.author, '') AS author, coalesce(nullif(q.source_name, ''), 'Unknown') AS source,
    row_number() OVER (ORDER BY q.pos, f.file_rank) - 1 AS idx
  FROM queued q JOIN files f ON q.topic IS NOT DISTINCT FROM f.topic
)"""


def greedy_sql(limit: int | None, goal: int | None, output: str) -> str:
    """The sequential scan as a recursive query that carries the used keys."""
    free = (
        "NOT list_contains(g.urls, r.url) AND NOT (r.title <> '' AND list_contains(g.titles, r.title)) "
        "AND NOT (r.author <> '' AND list_contains(g.authors, r.author)) AND r.url <> ''"
    )
    if limit is not None:
        free += f" AND len(list_filter(g.sources, lambda s: s = r.source)) < {limit}"
    if goal is not None:
        free += f" AND len(g.taken) < {goal}"
    grow = ", ".join(
        f"CASE WHEN {free} THEN list_append(g.{name}, r.{value}) ELSE g.{name} END"
        for name, value in (
            ("urls", "url"), ("titles", "title"), ("authors", "author"), ("sources", "source"), ("taken", "idx"),
        )
    )
    return RANKED.replace("WITH lines", "WITH RECURSIVE lines", 1) + f""", greedy(i, urls, titles, authors, sources, taken) AS (
  SELECT -1::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
  UNION ALL
  SELECT r.idx, {grow} FROM greedy g JOIN ranked r ON r.idx = g.i + 1
), chosen AS (
  SELECT unnest(taken) AS idx FROM (SELECT taken FROM greedy ORDER BY i DESC LIMIT 1)
), selected AS (
  SELECT r.*, row_number() OVER (ORDER BY r.idx) - 1 AS master_index FROM ranked r JOIN chosen USING (idx)
)
{output}"""


SELECTED = "SELECT master_index AS \"index\", doc_id, url, title, author, source FROM selected"


def selected(spark: SparkSession, folder: str, limit: int | None, goal: int | None) -> DataFrame:
    ranked = in_blocks(ranked_articles(spark, folder), goal)
    chosen = dense_index(greedy_select(ranked, limit, goal), rows=goal)
    places = ranked.select("rank", "doc_id").join(hinted(chosen), "rank")
    return places.select("index", "doc_id", "url", "title", "author", "source")


@query(greedy_sql(5, 50, SELECTED))
def curated_candidates(spark, folder):
    return selected(spark, folder, 5, 50)


@query(greedy_sql(1, 50, SELECTED))
def curated_default(spark, folder):
    return selected(spark, folder, 1, 50)


@query(greedy_sql(None, None, SELECTED))
def curated_uncapped(spark, folder):
    return selected(spark, folder, None, None)


@query(greedy_sql(5, 50, """SELECT source, count(*) AS n_articles, min(idx) AS first_rank FROM selected GROUP BY source"""))
def source_distribution_report(spark, folder):
    ranked = dense_index(ranked_articles(spark, folder).drop("file_rank"), "rank", "place")
    rows = settle(ranked.withColumn("rank", F.col("place")).drop("place"))
    return source_distribution(greedy_select(rows, 5, 50))


@query(RANKED + " SELECT idx AS \"index\", doc_id, topic, pos FROM ranked")
def round_robin_order(spark, folder):
    topic = F.nullif(F.col("path"), F.lit("")).alias("topic")
    rows = ranked_articles(spark, folder).select("rank", "doc_id", topic, "pos")
    return dense_index(settle(rows)).select("index", "doc_id", "topic", "pos")


@query(ARTICLES + """
SELECT coalesce(topic || '/' || substr(published_at, 1, 10), '') AS path, max(published_at) AS fetched,
  row_number() OVER (ORDER BY max(published_at) DESC NULLS LAST, coalesce(topic || '/' || substr(published_at, 1, 10), '')) - 1 AS file_rank
FROM articles GROUP BY 1""")
def landing_file_order(spark, folder):
    path = F.coalesce(F.concat("topic", F.lit("/"), F.substring("published_at", 1, 10)), F.lit(""))
    documents = read_table(spark, folder, "documents").select("doc_id")
    facts = documents.join(event_facts(spark, folder), "doc_id", "left")
    files = facts.groupBy(path.alias("path")).agg(
        F.max("published_at").cast("timestamp").alias("fetch_ts")
    )
    fetched = F.date_format("fetch_ts", "yyyy-MM-dd'T'HH:mm:ss")
    return file_order(files).select("path", fetched.alias("fetched"), "file_rank")


@query(QUEUED + f"""
SELECT topic, pos // {PAGE} AS page, pos % {PAGE} AS pos, url, trim(coalesce(title, '')) AS title,
  coalesce(author, '') AS author, coalesce(nullif(source_name, ''), 'Unknown') AS source, published_at
FROM queued""")
def landing_flatten(spark, folder):
    pages = envelope(queued_articles(spark, folder), ("topic",), PAGE)
    flat = flatten(pages, ("topic", "page"))
    return flat.select("topic", "page", "pos", "url", "title", "author", "source", "published_at")


def _matches_sql(topic: str) -> str:
    return " AND ".join(
        f"(contains(lower(title), '{w}') OR contains(lower(content), '{w}'))" for w in topic.lower().split()
    )


HITS = ARTICLES + ", hits AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, '{t}' AS topic, url, published_at FROM articles
  WHERE lang = 'en' AND CAST(published_at AS TIMESTAMP) BETWEEN {NOW} - INTERVAL 37 HOUR AND {NOW} - INTERVAL 25 HOUR
    AND {_matches_sql(t)}"""
    for t in TOPICS
) + """), paged AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY published_at DESC, url, doc_id) - 1 AS pos FROM hits
)"""


def topic_pages(spark: SparkSession, folder: str) -> DataFrame:
    articles = article_rows(spark, folder).withColumn("description", F.lit(None).cast("string")).drop("topic")
    return corpus.topic_pages(corpus.topic_hits(articles, TOPICS, AS_OF), 20)


@query(HITS + " SELECT topic, pos, doc_id, url, published_at FROM paged WHERE pos < 20")
def topic_search_topk(spark, folder):
    return topic_pages(spark, folder).select("topic", "pos", "doc_id", "url", "published_at")


@query(HITS + f""" SELECT t.topic, count(p.doc_id) AS n_articles
FROM (SELECT unnest({list(TOPICS)}) AS topic) t LEFT JOIN (SELECT * FROM paged WHERE pos < 20) p ON p.topic = t.topic
GROUP BY t.topic""")
def topic_fetch_counts(spark, folder):
    return corpus.topic_counts(topic_pages(spark, folder), TOPICS)


DOMAINS = "alt.example.org, other.example.org"


@query(HITS.replace("url, published_at FROM articles", "'https://' || CASE WHEN doc_id % 3 = 0 THEN 'alt' ELSE 'www' END || substr(url, 12) AS url, published_at FROM articles")
       + " SELECT topic, doc_id, url FROM hits WHERE doc_id % 3 = 0")
def topic_search_domains(spark, folder):
    """Topic search within a list of hosts."""
    host = F.when(F.col("doc_id") % 3 == 0, F.lit("https://alt")).otherwise(F.lit("https://www"))
    articles = article_rows(spark, folder).withColumn("description", F.lit(None).cast("string")).drop("topic")
    moved = articles.withColumn("url", F.concat(host, F.substring("url", 12, 1 << 20)))
    return corpus.topic_hits(moved, TOPICS, AS_OF, DOMAINS).select("topic", "doc_id", "url")
