"""Publication tables over the site."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.times import day_key
from newsloom.operators import publication as pub
from newsloom.plans.batch import FEED_FOOT, NEWS_HEAD, SITEMAP_HEAD, URLSET_FOOT, feed_head
from newsloom.session import scratch_path, settle
from newsloom.sources.articles import AS_OF, site_rows
from newsloom.sources.store import Store, document_lines
from registry.base import (
    NOW, SITE, query, sql_day, sql_day_label, sql_excerpt, sql_html, sql_iso, sql_keywords, sql_or, sql_plain,
    sql_short_date, sql_slug, sql_time,
)

SEARCHES = ("the", "and", "tion", "src1", "cat3", "user1", "is", "no-such-phrase", "der", "ing the")
SETTINGS = pub.SiteSettings(as_of=AS_OF, queries=SEARCHES)
URL, NAME = SETTINGS.url, SETTINGS.name
TODAY = AS_OF[:10]

QUERY_ROWS = f"""(SELECT unnest(range({len(SEARCHES)})) AS ord, unnest({list(SEARCHES)}) AS query)"""
PATH = f"'/article/' || {sql_slug('title')}"
CATEGORY_PATH = f"'/category/' || {sql_slug('category')}"
COUNTED = "{n} || CASE WHEN {n} = 1 THEN ' article' ELSE ' articles' END"

SEARCHED = SITE + f""", found AS (
  SELECT q.ord, q.query, s.* FROM {QUERY_ROWS} q JOIN site s
    ON contains(lower(s.title), q.query) OR contains(lower(s.summary), q.query) OR contains(lower(s.category), q.query)
    OR contains(lower(s.source), q.query) OR contains(lower(s.author), q.query)
), searches AS (
  SELECT q.ord, q.query, '/search/' || {sql_slug('q.query')} AS path, count(f.pos) AS n
  FROM {QUERY_ROWS} q LEFT JOIN found f ON f.ord = q.ord GROUP BY q.ord, q.query
), search_rows AS (
  SELECT *, query || ' — Search Results | {NAME}' AS title,
    CASE WHEN n = 0 THEN 'Nothing found for ' || query || '.'
      ELSE {COUNTED.format(n='n')} || ' found for ' || query || '.' END AS description,
    CASE WHEN n = 0 THEN 'noindex, follow' ELSE 'index, follow' END AS robots,
    CASE WHEN n = 0 THEN 'No articles match "' || query || '".' END AS message
  FROM searches
), cats AS (
  SELECT category, {sql_slug('category')} AS slug, {CATEGORY_PATH} AS path, count(*) AS n, min(pos) AS first_pos, 1::BIGINT AS n_categories,
    category || ' — {NAME}' AS title,
    category || ': ' || {COUNTED.format(n='count(*)')} || ' in short.' AS description
  FROM site WHERE category <> '' GROUP BY category
)"""


def site(spark, folder):
    return site_rows(spark, folder)


@query(SITE + f""" SELECT {sql_slug('title')} AS slug, count(*) AS n_articles, max(pos) AS pos FROM site GROUP BY 1""")
def slug_collisions(spark, folder):
    return pub.slug_winners(site(spark, folder).select("pos", "title"))


@query(SITE + f""", days AS (SELECT pos, {sql_day('processed_at')} AS day FROM site)
SELECT day, {sql_day_label('day')} AS day_label, count(*) AS n, {COUNTED.format(n='count(*)')} AS count_text, min(pos) AS first_pos
FROM days GROUP BY day""")
def date_groups(spark, folder):
    days = site(spark, folder).select("pos", day_key(F.col("processed_at")).alias("day"))
    return pub.date_groups(days, SETTINGS)


LISTING = SEARCHED + f""", placed AS (
  SELECT '/' AS page, 'Latest News' AS list_label, * FROM site
  UNION ALL SELECT {CATEGORY_PATH}, category, * FROM site WHERE category <> ''
  UNION ALL SELECT '/search/' || {sql_slug('query')}, 'Search: "' || query || '"', * EXCLUDE (ord, query) FROM found
), listing AS (
  SELECT page, list_label AS label, {sql_day('processed_at')} AS day, pos, {sql_or('title', 'Untitled')} AS title,
    {sql_or('category', 'News')} AS category, {sql_or('author', 'Unknown')} AS author, {sql_or('source', 'Unknown')} AS source,
    {PATH} AS path FROM placed
)"""


@query(LISTING + " SELECT * FROM listing")
def list_page_cards(spark, folder):
    return pub.listing_rows(site(spark, folder), SETTINGS)


@query(LISTING + f"""
SELECT page, day, {sql_day_label('day')} AS day_label, count(*) AS n, {COUNTED.format(n='count(*)')} AS count_text, min(pos) AS first_pos
FROM listing GROUP BY page, day""")
def page_counts(spark, folder):
    return pub.date_groups(pub.listing_rows(site(spark, folder), SETTINGS), SETTINGS, ["page"])


def _html(c: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
        f"chr(39), '&#39;')"
    )


PAGE_LINES = LISTING + f""", totals AS (SELECT page, label, count(*) AS n FROM listing GROUP BY ALL),
days AS (SELECT page, day, count(*) AS n FROM listing GROUP BY ALL),
page_lines AS (
  SELECT page AS path, 0 AS part, '' AS day, 0 AS pos, '<nav><a href="/">{NAME}</a> › <span>' || {_html('label')} || '</span></nav>' AS line
  FROM totals WHERE starts_with(page, '/category/')
  UNION ALL SELECT page, 1, '', 0, '<h1>' || {_html('label')} || '</h1><p>' || {COUNTED.format(n='n')} || '</p>' FROM totals
  UNION ALL SELECT path, 1, '', 0, '<h1>' || {_html("'Search: ' || chr(34) || query || chr(34)")} || '</h1><p>No results found</p>'
  FROM search_rows WHERE n = 0
  UNION ALL SELECT path, 2, '', 0, '<p>' || {_html('message')} || '</p>' FROM search_rows WHERE n = 0
  UNION ALL SELECT page, 3, day, -1, '<h2>' || {sql_day_label('day')} || '</h2><p>' || {COUNTED.format(n='n')} || '</p>' FROM days
  UNION ALL SELECT page, 3, day, pos, '<article><a href="' || path || '">' || {_html('title')} || '</a> <span>' || {_html('category')}
    || '</span> <span>' || {_html('author')} || '</span> <span>' || {_html('source')} || '</span></article>' FROM listing
)"""


@query(PAGE_LINES + " SELECT path, line FROM page_lines")
def list_page_documents(spark, folder):
    return pub.list_page_lines(site(spark, folder), SETTINGS).select("path", "line")


@query(PAGE_LINES + """ SELECT path, string_agg(line, chr(10) ORDER BY part, day DESC, pos) || chr(10) AS body, count(*) AS n_lines
FROM page_lines GROUP BY path""")
def pages_packed_and_read(spark, folder):
    """List pages written into packs and read back, with their lines in order. The second write, of one path, replaces that page."""
    store = Store(spark, scratch_path(spark, "pages"))
    lines = settle(pub.list_page_lines(site(spark, folder), SETTINGS))
    home = F.col("path") == "/"
    store.write_pages(lines.withColumn("line", F.when(home, F.lit("old")).otherwise(F.col("line"))), "pages", 1, files=8)
    store.write_pages(lines.where(home), "pages", 2, files=8)
    return store.read_pages("pages", counted=True).select("path", "body", "n_lines")


RELATED = SITE + f""", pairs AS (
  SELECT a.pos, a.category, b.pos AS related_pos, b.url AS related_url, {sql_or('b.title', 'Untitled')} AS related_title, b.source AS related_source,
    b.processed_at AS related_processed, row_number() OVER (PARTITION BY a.pos ORDER BY b.pos) AS place
  FROM site a JOIN site b ON a.category = b.category AND a.url <> b.url
)"""


@query(RELATED + " SELECT pos, category, place, related_pos, related_url, related_title FROM pairs WHERE place <= 4")
def related_top4(spark, folder):
    return pub.related_articles(site(spark, folder), SETTINGS)


@query(RELATED + f""", lists AS (
  SELECT pos, string_agg({sql_or('related_title', 'Untitled')} || '|' || {sql_or('related_source', 'Unknown')} || '|/article/'
    || {sql_slug('related_title')} || '|' || {sql_iso('related_processed')} || '|' || {sql_short_date('related_processed')},
    chr(10) ORDER BY place) AS related
  FROM pairs WHERE place <= 4 GROUP BY pos
) SELECT s.pos, {PATH} AS path, {CATEGORY_PATH} AS category_path, {sql_or('category', 'News')} AS badge,
  substr({sql_or('title', 'Article')}, 1, 50) || '…' AS trail_title, {sql_or('title', 'Untitled')} AS headline,
  {sql_or('author', 'Unknown')} AS byline, {sql_or('source', 'Unknown')} AS source, {sql_iso('processed_at')} AS published,
  {sql_short_date('processed_at')} AS shown_date, {sql_html('summary')} AS body_html, {sql_or('url', '#')} AS original_url,
  coalesce(l.related, '') AS related
FROM site s LEFT JOIN lists l USING (pos)""")
def article_pages(spark, folder):
    rows = site(spark, folder)
    entry = F.transform("related", lambda r: F.concat_ws(
        "|", r["title"], r["source"], r["path"], r["published"], r["shown_date"]
    ))
    return pub.article_pages(rows, rows, SETTINGS).withColumn("related", F.array_join(entry, "\n"))


@query(SEARCHED + " SELECT query, pos, title, url FROM found")
def search_hits(spark, folder):
    return pub.search_hits(site(spark, folder), SEARCHES).select("query", "pos", "title", "url")


@query(SEARCHED + " SELECT ord, query, path, n, title, description, robots, message FROM search_rows")
def search_pages(spark, folder):
    return pub.search_pages(site(spark, folder), SETTINGS)


@query(SEARCHED + " SELECT category, slug, path, n, first_pos, n_categories, title, description FROM cats")
def category_pages(spark, folder):
    return pub.category_pages(site(spark, folder), SETTINGS)


@query(SITE + " SELECT pos, title, url FROM site WHERE category = 'cat1'")
def one_category(spark, folder):
    return site(spark, folder).where(F.col("category") == "cat1").select("pos", "title", "url")


PARTS = SITE + f""", cards AS (
  SELECT '/' AS page, 'Latest News' AS label, pos, {sql_or('title', 'Untitled')} AS headline, {PATH} AS path FROM site
  UNION ALL SELECT {CATEGORY_PATH}, category, pos, {sql_or('title', 'Untitled')}, {PATH} FROM site WHERE category <> ''
), parts AS (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS r FROM cards) WHERE r <= 10
)"""


@query(PARTS + " SELECT * FROM parts")
def collection_parts(spark, folder):
    return pub.collection_parts(site(spark, folder))


@query(PARTS + f""" SELECT page, label, CAST(json_object('@context', 'https://schema.org', '@type', 'CollectionPage', '@id', '{URL}' || page,
  'name', label, 'url', '{URL}' || page, 'description', label || ', newest first.',
  'publisher', json_object('@id', '{URL}/#organization'),
  'hasPart', to_json(list(json_object('@type', 'NewsArticle', '@id', '{URL}' || path, 'headline', headline, 'url', '{URL}' || path) ORDER BY pos))
) AS VARCHAR) AS json_ld FROM parts GROUP BY page, label""")
def collection_jsonld(spark, folder):
    return pub.collection_documents(site(spark, folder), SETTINGS)


@query(SITE + rf""" SELECT pos, CAST(json_object('@context', 'https://schema.org', '@type', 'NewsArticle', '@id', '{URL}' || {PATH},
  'headline', {sql_or('title', 'Untitled')}, 'description', {sql_excerpt('summary')}, 'datePublished', {sql_iso('processed_at')},
  'dateModified', {sql_iso('processed_at')}, 'wordCount', len(list_filter(string_split_regex(summary, '\s+'), lambda w: w <> '')),
  'articleSection', {sql_or('category', 'Technology')}, 'keywords', {sql_keywords('category', 'source')}, 'isAccessibleForFree', true,
  'author', json_object('@type', 'Person', 'name', {sql_or('author', 'Unknown')}),
  'publisher', json_object('@type', 'Organization', '@id', '{URL}/#organization', 'name', '{NAME}',
    'logo', json_object('@type', 'ImageObject', 'url', '{URL}/logo.png')),
  'mainEntityOfPage', json_object('@type', 'WebPage', '@id', '{URL}' || {PATH}),
  'image', json_object('@type', 'ImageObject', 'url', '{URL}/og-image.png', 'width', 1200, 'height', 630),
  'speakable', json_object('@type', 'SpeakableSpecification', 'cssSelector', json_array('.article-title', '.article-body p:first-of-type')),
  'url', url) AS VARCHAR) AS article_ld FROM site""")
def article_jsonld(spark, folder):
    return pub.article_documents(site(spark, folder), SETTINGS).select("pos", "article_ld")


@query(SITE + f""" SELECT pos, CAST(json_object('@context', 'https://schema.org', '@type', 'BreadcrumbList', 'itemListElement', json_array(
  json_object('@type', 'ListItem', 'position', 1, 'name', '{NAME}', 'item', '{URL}/'),
  json_object('@type', 'ListItem', 'position', 2, 'name', {sql_or('category', 'News')}, 'item', '{URL}' || {CATEGORY_PATH}),
  json_object('@type', 'ListItem', 'position', 3, 'name', {sql_or('title', 'Article')}, 'item', '{URL}' || {PATH})
)) AS VARCHAR) AS breadcrumb_ld FROM site""")
def breadcrumb_jsonld(spark, folder):
    return pub.article_documents(site(spark, folder), SETTINGS).select("pos", "breadcrumb_ld")


def _trail(name: str, path: str) -> str:
    return (
        f"CAST(json_object('@context', 'https://schema.org', '@type', 'BreadcrumbList', 'itemListElement', json_array("
        f"json_object('@type', 'ListItem', 'position', 1, 'name', '{NAME}', 'item', '{URL}/'), "
        f"json_object('@type', 'ListItem', 'position', 2, 'name', {name}, 'item', '{URL}' || {path}))) AS VARCHAR)"
    )


@query(SEARCHED + f""" SELECT '/' AS path, CAST(json_object('@context', 'https://schema.org', '@type', 'BreadcrumbList',
  'itemListElement', json_array(json_object('@type', 'ListItem', 'position', 1, 'name', '{NAME}', 'item', '{URL}/'))) AS VARCHAR) AS breadcrumb_ld
UNION ALL SELECT path, {_trail('category', 'path')} FROM cats
UNION ALL SELECT path, {_trail("'Search: " + '"' + "' || query || '" + '"' + "'", 'path')} FROM search_rows""")
def list_breadcrumb_jsonld(spark, folder):
    return pub.list_breadcrumbs(site(spark, folder), SETTINGS)


MANIFEST = SEARCHED + f""", winners AS (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {sql_slug('title')} ORDER BY pos DESC) AS r FROM site) WHERE r = 1
), manifest AS (
  SELECT '/' AS path, 'home' AS kind, '{NAME} — Curated news in short' AS title, '{SETTINGS.description}' AS description,
    'index, follow' AS robots, NULL::VARCHAR AS author, NULL::VARCHAR AS section, NULL::VARCHAR AS published_time,
    NULL::VARCHAR AS modified_time, NULL::VARCHAR AS news_keywords, NULL::VARCHAR AS tags, 'website' AS og_type
  UNION ALL SELECT path, 'category', title, description, 'index, follow', NULL, NULL, NULL, NULL, NULL, NULL, 'website' FROM cats
  UNION ALL SELECT path, 'search', title, description, robots, NULL, NULL, NULL, NULL, NULL, NULL, 'website' FROM search_rows
  UNION ALL SELECT {PATH}, 'article', {sql_or('title', 'Untitled')} || ' — {NAME}', {sql_excerpt('summary')}, 'index, follow',
    {sql_or('author', 'Unknown')}, {sql_or('category', 'Technology')}, {sql_iso('processed_at')}, {sql_iso('processed_at')},
    {sql_keywords('category', 'source')}, CAST(json_array(category, source) AS VARCHAR), 'article' FROM winners
)"""


@query(MANIFEST + f" SELECT *, '{URL}' || path AS canonical FROM manifest")
def page_manifest(spark, folder):
    return pub.page_manifest(site(spark, folder), SETTINGS)


SITEMAP = SITE + f""", urls AS (
  SELECT 0::BIGINT AS class, ord::BIGINT AS ord, loc, priority, changefreq, '{TODAY}' AS lastmod
  FROM (VALUES (0, '/', '1.0', 'hourly'), (1, '/about', '0.3', 'monthly')) v(ord, loc, priority, changefreq)
  UNION ALL SELECT 1, ord, '/search/' || {sql_slug('query')}, '0.6', 'daily', '{TODAY}' FROM {QUERY_ROWS}
  UNION ALL SELECT 2, min(pos), {CATEGORY_PATH}, '0.7', 'hourly', '{TODAY}' FROM site WHERE category <> '' GROUP BY category
  UNION ALL SELECT 3, pos, {PATH}, '0.8', 'monthly', strftime(coalesce({sql_time('processed_at')}, {NOW}), '%Y-%m-%d') FROM site
)"""


@query(SITEMAP + " SELECT * FROM urls")
def sitemap_urls(spark, folder):
    return pub.sitemap_urls(site(spark, folder), SETTINGS)


def _xml(c: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
        f"chr(39), '&apos;')"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(SITEMAP + f""" SELECT {_quoted(SITEMAP_HEAD)} AS value UNION ALL SELECT {_quoted(URLSET_FOOT)} UNION ALL
SELECT '  <url>' || chr(10) || '    <loc>' || {_xml(f"'{URL}' || loc")} || '</loc>' || chr(10) || '    <lastmod>' || lastmod || '</lastmod>'
  || chr(10) || '    <changefreq>' || changefreq || '</changefreq>' || chr(10) || '    <priority>' || priority || '</priority>'
  || chr(10) || '  </url>' FROM urls""")
def sitemap_document(spark, folder):
    rows = pub.sitemap_urls(site(spark, folder), SETTINGS)
    return document_lines(rows, pub.sitemap_entry(SETTINGS), ["class", "ord"], SITEMAP_HEAD, URLSET_FOOT)


NEWS = SITE + f""", news AS (
  SELECT pos, '{URL}' || {PATH} AS loc, {sql_iso('processed_at')} AS publication_date, {sql_or('title', 'Untitled')} AS title,
    {sql_keywords('category', 'source')} AS keywords
  FROM site WHERE {sql_time('processed_at')} >= {NOW} - INTERVAL 2 DAY
)"""


@query(NEWS + " SELECT * FROM news")
def news_sitemap(spark, folder):
    return pub.news_sitemap(site(spark, folder), SETTINGS)


@query(NEWS + f""" SELECT {_quoted(NEWS_HEAD)} AS value UNION ALL SELECT {_quoted(URLSET_FOOT)} UNION ALL
SELECT concat_ws(chr(10), '  <url>', '    <loc>' || {_xml('loc')} || '</loc>', '    <news:news>', '      <news:publication>',
  '        <news:name>{NAME}</news:name>', '        <news:language>en</news:language>', '      </news:publication>',
  '      <news:publication_date>' || publication_date || '</news:publication_date>', '      <news:title>' || {_xml('title')} || '</news:title>',
  '      <news:keywords>' || {_xml('keywords')} || '</news:keywords>', '    </news:news>', '  </url>') FROM news""")
def news_sitemap_document(spark, folder):
    rows = pub.news_sitemap(site(spark, folder), SETTINGS)
    return document_lines(rows, pub.news_entry(SETTINGS), ["pos"], NEWS_HEAD, URLSET_FOOT)


FEED = SITE + f""", feed AS (
  SELECT pos, {sql_or('title', 'Untitled')} AS title, '{URL}' || {PATH} AS link,
    strftime(coalesce({sql_time('processed_at')}, {NOW}), '%a, %d %b %Y %H:%M:%S') || ' GMT' AS pub_date,
    {sql_or('author', NAME)} AS creator, {sql_or('category', 'Technology')} AS category,
    substr({sql_plain('summary')}, 1, 500) AS description, {sql_html('summary')} AS content_html, {sql_or('url', '#')} AS original_url,
    {sql_or('source', 'Unknown')} AS source
  FROM (SELECT * FROM site ORDER BY pos LIMIT 50)
)"""


@query(FEED + " SELECT * FROM feed")
def feed_items(spark, folder):
    return pub.feed_items(site(spark, folder), SETTINGS)


@query(FEED + f""" SELECT {_quoted(feed_head(SETTINGS))} AS value UNION ALL SELECT {_quoted(FEED_FOOT)} UNION ALL
SELECT concat_ws(chr(10), '  <item>', '    <title>' || {_xml('title')} || '</title>', '    <link>' || {_xml('link')} || '</link>',
  '    <guid isPermaLink="true">' || {_xml('link')} || '</guid>', '    <pubDate>' || pub_date || '</pubDate>',
  '    <dc:creator>' || {_xml('creator')} || '</dc:creator>', '    <category>' || {_xml('category')} || '</category>',
  '    <description><![CDATA[' || replace(description, ']]>', ']]]]><![CDATA[>') || ']]></description>',
  '    <content:encoded><![CDATA[' || replace(content_html || chr(10) || '<p><a href="' || {_xml('link')} || '">Read on {NAME}</a> · <a href="'
    || {_xml('original_url')} || '">Original source: ' || {_xml('source')} || '</a></p>', ']]>', ']]]]><![CDATA[>') || ']]></content:encoded>',
  '  </item>') FROM feed""")
def feed_document(spark, folder):
    rows = pub.feed_items(site(spark, folder), SETTINGS)
    return document_lines(rows, pub.feed_entry(SETTINGS), ["pos"], feed_head(SETTINGS), FEED_FOOT)


@query(SITE + """ SELECT count(*) AS articles, count(DISTINCT nullif(author, '')) AS authors,
  count(DISTINCT nullif(source, '')) AS sources FROM site""")
def corpus_stats(spark, folder):
    return pub.corpus_statistics(site(spark, folder))


@query(SITE + f""", n AS (SELECT count(*) AS articles, count(DISTINCT nullif(category, '')) AS categories,
  count_if({sql_time('processed_at')} > {NOW} - INTERVAL 2 DAY)::BIGINT AS recent FROM site)
SELECT articles, categories, {len(SEARCHES)}::BIGINT AS searches, articles + categories + {len(SEARCHES)} + 2 AS sitemap_urls, recent,
  least(articles, 50) AS feed_items FROM n""")
def build_summary(spark, folder):
    return pub.build_summary(site(spark, folder), SETTINGS)


@query(SITE + " SELECT category, min(pos) AS first_pos FROM site WHERE category <> '' GROUP BY category")
def distinct_categories(spark, folder):
    return pub.distinct_categories(site(spark, folder))
