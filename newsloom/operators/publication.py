"""Publication tables: pages, listings, related articles, search, sitemaps, feed and JSON-LD.

Input is the site table with its seven fields and `pos`, the unique place in the newest-first
list. All outputs are flat tables with explicit order columns. Groups are counted by aggregates
and nested only up to a fixed number of rows, so a category or day may hold any share of the site.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import structured
from newsloom.functions.markup import cdata, escape_html, escape_xml, excerpt, markdown_to_html, strip_markdown
from newsloom.functions.matching import met_searches
from newsloom.functions.text import (
    counted, keyword_list, keywords, or_default, search_text, slug, slug_of, word_count,
)
from newsloom.functions.times import (
    day_key, day_label, instant, clock, is_recent, iso_instant, last_modified, rfc_instant, short_date,
)
from newsloom.operators.joins import keep_last, measured_join, sized_join
from newsloom.operators.numbering import leading_per_group
from newsloom.session import settle

# Fixed values; PROBE is only a work size.
SEARCH_QUERIES = (
    "ai", "artificial-intelligence", "machine-learning", "openai", "llm", "generative-ai",
    "cybersecurity", "cloud-computing", "python", "web-development",
)
HOME_LABEL = "Latest News"
SEARCH_FIELDS = ("title", "summary", "category", "source", "author")
RELATED = 4
PROBE = 64
COLLECTION_PARTS = 10
FEED_ITEMS = 50
RECENT_DAYS = 2
FEED_TEXT = 500
BREADCRUMB_TEXT = 50


@dataclass(frozen=True)
class SiteSettings:
    """Names and addresses of the published site, and its clock."""

    as_of: str
    url: str = "https://news.example.org"
    name: str = "Newsloom"
    description: str = "Short summaries of curated news, updated every 12 hours."
    # Page sentences; {n} stands for a count, {query} and {label} for what the page is about.
    home_title: str = "Curated news in short"
    category_text: str = "{label}: {n} in short."
    hits_text: str = "{n} found for {query}."
    no_hits_text: str = "Nothing found for {query}."
    collection_text: str = "{label}, newest first."
    queries: tuple[str, ...] = SEARCH_QUERIES

    @property
    def image(self) -> str:
        return f"{self.url}/og-image.png"


def sentence(template: str, **values: Column) -> Column:
    """A template with values in its places."""
    pieces = [template]
    for name, value in values.items():
        place = "{" + name + "}"
        cut = []
        for piece in pieces:
            parts = piece.split(place) if isinstance(piece, str) else [piece]
            cut += [x for part in parts for x in (part, value)][:-1]
        pieces = cut
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def article_path(title: Column) -> Column:
    return F.concat(F.lit("/article/"), slug(title))


def category_path(category: Column) -> Column:
    return F.concat(F.lit("/category/"), slug(category))


def search_path(query: Column) -> Column:
    return F.concat(F.lit("/search/"), slug(query))


# --- related articles -----------------------------------------------------------------------


def _heads(rows: DataFrame) -> DataFrame:
    """The first 2 * RELATED rows of each category that are among the first RELATED of their URL."""
    by_url = leading_per_group(rows, RELATED, ["category", "url"], ["pos"]).drop("place")
    return leading_per_group(by_url, 2 * RELATED, ["category"], ["pos"]).drop("place")


def category_heads(site: DataFrame, as_of: str) -> DataFrame:
    """`(category, heads)`: the first rows of each category that related lists are taken from.

    What a related list shows of a row is worked out here, once for each head.

    Of one URL at most RELATED rows can be needed before a list is full, and an article skips at
    most RELATED rows of its own URL, so the rows kept by `_heads` hold every list.

    They are looked for in the first PROBE rows of a category, which map tasks cut out before the
    shuffle. A category whose probe is full and yet holds too few rows, because a few URLs fill
    it, is searched as a whole.
    """
    rows = site.select("category", "url", "pos", "title", "source", "processed_at")
    probe = settle(leading_per_group(rows, PROBE, ["category"], ["pos"]).drop("place"))
    heads = settle(_heads(probe))
    short = heads.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") < 2 * RELATED)
    full = probe.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= PROBE)
    unsettled = settle(short.select("category").join(full.select("category"), "category", "left_semi"))
    if not unsettled.isEmpty():
        kept = heads.join(unsettled, "category", "left_anti")
        whole = sized_join(rows, unsettled, "category", "left_semi", ["pos"])
        heads = kept.unionByName(_heads(whole))
    shown = F.struct(
        "pos", "url",
        or_default(F.col("title"), "Untitled").alias("title"),
        or_default(F.col("source"), "Unknown").alias("source"),
        article_path(F.col("title")).alias("path"),
        iso_instant(F.col("processed_at"), as_of).alias("published"),
        short_date(F.col("processed_at")).alias("shown_date"),
    )
    return heads.groupBy("category").agg(F.array_sort(F.collect_list(shown)).alias("heads"))


def with_related(rows: DataFrame, site: DataFrame, as_of: str) -> DataFrame:
    """Add `related`: the first RELATED site articles of the same category that have another URL."""
    joined = measured_join(rows, category_heads(site, as_of), "category", "left", ["pos"])
    others = F.filter(F.col("heads"), lambda head: ~head["url"].eqNullSafe(F.col("url")))
    return joined.withColumn("related", F.slice(others, 1, RELATED)).drop("heads")


def related_articles(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """Flat form: one row for each article and related article, with its 1-based place."""
    rows = with_related(site.select("pos", "category", "url"), site, settings.as_of).select("pos", "category", F.posexplode("related").alias("at", "other"))
    return rows.select(
        "pos", "category", (F.col("at") + 1).cast("bigint").alias("place"),
        F.col("other.pos").alias("related_pos"), F.col("other.url").alias("related_url"),
        F.col("other.title").alias("related_title"),
    )


# --- listings -------------------------------------------------------------------------------


def with_category_page(site: DataFrame) -> DataFrame:
    """Add `category_page`, the path of the row's category page.

    It is null for an empty category, and for one whose page is replaced by a later category with
    the same slug.
    """
    path = F.when(F.col("category") != "", category_path(F.col("category")))
    names = site.select("category").where(F.col("category") != "").distinct()
    # One row for each category, so the categories of a slug are few.
    last = F.max("category").over(Window.partitionBy(slug(F.col("category"))))
    replaced = settle(
        names.withColumn("last", last).where(F.col("category") < F.col("last"))
        .select("category", F.lit(True).alias("_replaced"))
    )
    if replaced.isEmpty():
        return site.withColumn("category_page", path)
    marked = sized_join(site, replaced, "category", "left", ["pos"])
    return marked.withColumn("category_page", F.when(F.col("_replaced").isNull(), path)).drop("_replaced")


def search_label(query: Column) -> Column:
    return F.concat(F.lit('Search: "'), query, F.lit('"'))


def _listed(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """What a card shows of each article, and `on`, the array of the list pages it is on."""
    def listed(path: Column, label: Column) -> Column:
        return F.struct(path.alias("page"), label.alias("label"))

    lists = F.array_compact(F.array(
        listed(F.lit("/"), F.lit(HOME_LABEL)),
        F.when(F.col("category_page").isNotNull(), listed(F.col("category_page"), F.col("category"))),
    ))
    text = search_text(*[F.col(c) for c in SEARCH_FIELDS])
    searches = met_searches(F.col("_text"), [(q, [q.lower()]) for q in kept_queries(settings.queries)])
    found = with_category_page(site).withColumn("_text", text).withColumn("_met", searches)
    return found.select(
        F.concat(lists, F.transform("_met", lambda query: listed(search_path(query), search_label(query)))).alias("on"), day_key(F.col("processed_at")).alias("day"), "pos",
        or_default(F.col("title"), "Untitled").alias("title"),
        or_default(F.col("category"), "News").alias("category"),
        or_default(F.col("author"), "Unknown").alias("author"),
        or_default(F.col("source"), "Unknown").alias("source"),
        article_path(F.col("title")).alias("path"),
    )


def _exploded(articles: DataFrame) -> DataFrame:
    """A row for each page an article is on; what was derived from the article before is not derived for each again."""
    columns = [c for c in articles.columns if c != "on"]
    return articles.select(F.explode("on").alias("_on"), *columns).select("_on.page", "_on.label", *columns)


def listing_rows(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """One card for each article and list page it is on: home, its category, its searches.

    One scan: the pages of an article are an array that is exploded.
    """
    return _exploded(_listed(site, settings))


def date_groups(rows: DataFrame, settings: SiteSettings, page: Sequence[str] = ()) -> DataFrame:
    """Articles of each `day`, per page column if given, with heading and count text.

    Days order descending as text, so `unknown` comes first.
    """
    return rows.groupBy(*page, "day").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).select(
        *page, "day", day_label(F.col("day"), settings.as_of).alias("day_label"), "n",
        counted(F.col("n")).alias("count_text"), "first_pos",
    ).orderBy(*page, F.desc("day"))


def category_pages(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """One row for each non-empty category. Of categories with one slug the last by name stays."""
    counts = site.where(F.col("category") != "").groupBy("category").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos")
    )
    winners = counts.groupBy(slug(F.col("category")).alias("slug")).agg(
        F.max(F.struct("category", "n", "first_pos")).alias("page"), F.count("*").alias("n_categories")
    )
    category, n = F.col("page.category"), F.col("page.n")
    return winners.select(
        category.alias("category"), "slug", F.concat(F.lit("/category/"), F.col("slug")).alias("path"),
        n.alias("n"), F.col("page.first_pos").alias("first_pos"), "n_categories",
        F.concat(category, F.lit(f" — {settings.name}")).alias("title"),
        sentence(settings.category_text, label=category, n=counted(n)).alias("description"),
    ).orderBy("category")


def collection_parts(site: DataFrame) -> DataFrame:
    """First COLLECTION_PARTS articles of the home page (path `/`) and of each category page."""
    card = with_category_page(site).select(
        "pos", "category", "category_page", or_default(F.col("title"), "Untitled").alias("headline"),
        article_path(F.col("title")).alias("path"),
    )
    home = card.orderBy("pos").limit(COLLECTION_PARTS).select(
        F.lit("/").alias("page"), F.lit(HOME_LABEL).alias("label"), "pos", "headline", "path"
    )
    first = leading_per_group(card.where(F.col("category_page").isNotNull()), COLLECTION_PARTS, ["category"], ["pos"])
    return home.unionByName(first.select(
        F.col("category_page").alias("page"), F.col("category").alias("label"), "pos", "headline", "path"
    ))


def collection_documents(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """JSON-LD of each collection page; a collection nests at most COLLECTION_PARTS rows."""
    parts = collection_parts(site).groupBy("page", "label").agg(
        F.array_sort(F.collect_list(F.struct("pos", "path", "headline"))).alias("parts")
    )
    return parts.select(
        "page", "label",
        structured.collection_ld(
            F.col("label"), F.col("page"), F.col("parts"), settings.url, sentence(settings.collection_text, label=F.col("label"))).alias("json_ld"),
    )


# --- search ---------------------------------------------------------------------------------


def kept_queries(queries: Sequence[str]) -> list[str]:
    """The queries that keep their page: of those with one slug the last."""
    return list({slug_of(q): q for q in queries}.values())


def search_hits(site: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Site rows with `query`, one for each query found in one of five fields.

    The queries are a parameter, so one scan lowers each row once and tests it against all of them, a few or
    thousands; there is no join.
    """
    fields = [F.col(c) for c in SEARCH_FIELDS]
    found = met_searches(F.col("_text"), [(q, [q.lower()]) for q in queries])
    return site.withColumn("_text", search_text(*fields)).withColumn("query", F.explode(found)).drop("_text")


def search_pages(site: DataFrame, settings: SiteSettings, pages: DataFrame | None = None) -> DataFrame:
    """One row for each query, also for one without hits, which is not to be indexed.

    `pages` gives the hits as `(page, n)` where list pages have been counted already.
    """
    # A literal: rows of the driver would start Python workers that stay in the executors.
    kept = json.dumps([{"ord": settings.queries.index(q), "query": q} for q in kept_queries(settings.queries)])
    rows = F.inline(F.from_json(F.lit(kept), "array<struct<ord:bigint,query:string>>"))
    asked = site.sparkSession.range(1).select(rows).withColumn("path", search_path(F.col("query")))
    if pages is None:
        key, counts = "query", search_hits(site, kept_queries(settings.queries)).groupBy("query").agg(F.count("*").alias("n"))
    else:
        key, counts = "path", pages.select(F.col("page").alias("path"), "n")
    n = F.coalesce(F.col("n"), F.lit(0))
    none = sentence(settings.no_hits_text, query=F.col("query"))
    some = sentence(settings.hits_text, query=F.col("query"), n=counted(n))
    return asked.join(counts, key, "left").select(
        "ord", "query", "path", n.alias("n"),
        F.concat(F.col("query"), F.lit(f" — Search Results | {settings.name}")).alias("title"),
        F.when(n == 0, none).otherwise(some).alias("description"),
        F.when(n == 0, F.lit("noindex, follow")).otherwise(F.lit("index, follow")).alias("robots"),
        F.when(n == 0, F.concat(F.lit('No articles match "'), F.col("query"), F.lit('".'))).alias("message"),
    )


def list_breadcrumbs(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """Breadcrumb JSON-LD of each list page: the home page, and home followed by the page itself."""
    def trail(names: list[Column], paths: list[Column]) -> Column:
        start = F.lit(settings.name), F.lit("/")
        return structured.breadcrumb_ld([start[0], *names], [start[1], *paths], settings.url).alias("breadcrumb_ld")

    home = site.sparkSession.createDataFrame([("/",)], "path string").select("path", trail([], []))
    categories = category_pages(site, settings).select("path", trail([F.col("category")], [F.col("path")]))
    label = search_label(F.col("query"))
    queries = site.sparkSession.createDataFrame([(q,) for q in kept_queries(settings.queries)], "query string")
    searches = queries.withColumn("path", search_path(F.col("query"))).select("path", trail([label], [F.col("path")]))
    return home.unionByName(categories).unionByName(searches)


# --- article pages --------------------------------------------------------------------------


def slug_winners(site: DataFrame) -> DataFrame:
    """`(slug, pos, n_articles)`: of articles with one slug the last in list order is published."""
    return site.groupBy(slug(F.col("title")).alias("slug")).agg(
        F.max("pos").alias("pos"), F.count("*").alias("n_articles")
    )


def published_articles(site: DataFrame) -> DataFrame:
    """Site rows that keep their page: of articles with one slug the last in list order."""
    return keep_last(site.withColumn("slug", slug(F.col("title"))), "slug", "pos").drop("slug")


def article_pages(rows: DataFrame, site: DataFrame, settings: SiteSettings) -> DataFrame:
    """Content of the pages of `rows`: trail, badge, headline, byline, dates, body, related block."""
    trail_title = F.concat(F.substring(or_default(F.col("title"), "Article"), 1, BREADCRUMB_TEXT), F.lit("…"))
    return with_related(rows, site, settings.as_of).select(
        "pos",
        article_path(F.col("title")).alias("path"),
        category_path(or_default(F.col("category"), "news")).alias("category_path"),
        or_default(F.col("category"), "News").alias("badge"),
        trail_title.alias("trail_title"),
        or_default(F.col("title"), "Untitled").alias("headline"),
        or_default(F.col("author"), "Unknown").alias("byline"),
        or_default(F.col("source"), "Unknown").alias("source"),
        iso_instant(F.col("processed_at"), settings.as_of).alias("published"),
        short_date(F.col("processed_at")).alias("shown_date"),
        markdown_to_html(F.col("summary")).alias("body_html"),
        or_default(F.col("url"), "#").alias("original_url"),
        "related",
    )


def article_documents(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """NewsArticle and breadcrumb JSON-LD of each article."""
    path = article_path(F.col("title"))
    category = or_default(F.col("category"), "News")
    return site.select(
        "pos",
        structured.article_ld(
            page=F.concat(F.lit(settings.url), path),
            title=or_default(F.col("title"), "Untitled"),
            description=excerpt(F.col("summary")),
            published=iso_instant(F.col("processed_at"), settings.as_of),
            words=word_count(F.col("summary")),
            section=or_default(F.col("category"), "Technology"),
            keywords=keywords(F.col("category"), F.col("source")),
            author=or_default(F.col("author"), "Unknown"),
            image=or_default(F.col("image"), settings.image) if "image" in site.columns else F.lit(settings.image),
            url=F.coalesce("url", F.lit("")),
            site_url=settings.url,
            site_name=settings.name,
        ).alias("article_ld"),
        structured.breadcrumb_ld(
            [F.lit(settings.name), category, or_default(F.col("title"), "Article")],
            [F.lit("/"), category_path(or_default(F.col("category"), "news")), path],
            settings.url,
        ).alias("breadcrumb_ld"),
    )


def page_manifest(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """One row for each published page with its metadata."""
    name, nothing = settings.name, F.lit(None).cast("string")
    indexed = F.lit("index, follow").alias("robots")
    home = site.sparkSession.createDataFrame(
        [("/", f"{name} — {settings.home_title}", settings.description)],
        "path string, title string, description string",
    ).select("path", F.lit("home").alias("kind"), "title", "description", indexed)
    categories = category_pages(site, settings).select(
        "path", F.lit("category").alias("kind"), "title", "description", indexed
    )
    # Of queries with one slug the last page stays.
    last = search_pages(site, settings).groupBy("path").agg(
        F.max(F.struct("ord", "title", "description", "robots")).alias("page")
    )
    searches = last.select("path", F.lit("search").alias("kind"), "page.title", "page.description", "page.robots")
    published = iso_instant(F.col("processed_at"), settings.as_of)
    articles = published_articles(site).select(
        article_path(F.col("title")).alias("path"),
        F.lit("article").alias("kind"),
        F.concat(or_default(F.col("title"), "Untitled"), F.lit(f" — {name}")).alias("title"),
        excerpt(F.col("summary")).alias("description"),
        indexed,
        or_default(F.col("author"), "Unknown").alias("author"),
        or_default(F.col("category"), "Technology").alias("section"),
        published.alias("published_time"),
        published.alias("modified_time"),
        keywords(F.col("category"), F.col("source")).alias("news_keywords"),
        F.to_json(keyword_list(F.col("category"), F.col("source"))).alias("tags"),
    )
    lists = home.unionByName(categories).unionByName(searches)
    for extra in ("author", "section", "published_time", "modified_time", "news_keywords", "tags"):
        lists = lists.withColumn(extra, nothing)
    return lists.unionByName(articles).withColumn(
        "og_type", F.when(F.col("kind") == "article", "article").otherwise("website")
    ).withColumn("canonical", F.concat(F.lit(settings.url), F.col("path")))


# --- page bodies ----------------------------------------------------------------------------


def article_bodies(pages: DataFrame, settings: SiteSettings) -> DataFrame:
    """`(path, body)` of article pages: the columns of `article_pages` as HTML."""
    def tag(name: str, value: Column, attributes: str = "") -> Column:
        return F.concat(F.lit(f"<{name}{attributes}>"), escape_html(value), F.lit(f"</{name}>"))

    def anchor(path: Column, label: Column) -> Column:
        return F.concat(F.lit('<a href="'), escape_html(path), F.lit('">'), escape_html(label), F.lit("</a>"))

    related = F.array_join(F.transform("related", lambda r: F.concat(
        F.lit("<li>"), anchor(r["path"], r["title"]), F.lit(" "), tag("span", r["source"]), F.lit(" "),
        F.lit('<time datetime="'), r["published"], F.lit('">'), r["shown_date"], F.lit("</time></li>"),
    )), "\n")
    return pages.select("path", F.concat_ws(
        "\n",
        F.concat(
            F.lit(f'<nav><a href="/">{settings.name}</a> › '), anchor(F.col("category_path"), F.col("badge")),
            F.lit(" › "), tag("span", F.col("trail_title")), F.lit("</nav>"),
        ),
        tag("p", F.col("badge"), ' class="badge"'),
        tag("h1", F.col("headline"), ' class="article-title"'),
        F.concat(
            tag("address", F.col("byline")), tag("span", F.col("source")), F.lit('<time datetime="'),
            F.col("published"), F.lit('">'), F.col("shown_date"), F.lit("</time>"),
        ),
        F.concat(F.lit('<div class="article-body">'), F.col("body_html"), F.lit("</div>")),
        F.concat(F.lit('<p class="source">'), anchor(F.col("original_url"), F.lit("Read original")), F.lit("</p>")),
        F.when(F.size("related") > 0, F.concat(F.lit('<ul class="related">'), related, F.lit("</ul>"))),
    ).alias("body"))


def list_page_lines(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """`(path, ord, line)`: list pages as ordered lines, so that a page may list any number of cards.

    A page has its heading and total, then for each day, newest first, a day heading and its cards. A
    category page starts with its trail. The home page of an empty site has its heading too; a search
    without hits has a heading and a message.
    """
    # A card is built once for each article, not for each page it is on, and stored: what follows reads no text of the site.
    cards = settle(_listed(site, settings).select(
        "on", "day", "pos",
        F.concat(
            F.lit('<article><a href="'), F.col("path"), F.lit('">'), escape_html(F.col("title")), F.lit("</a> <span>"),
            escape_html(F.col("category")), F.lit("</span> <span>"), escape_html(F.col("author")),
            F.lit("</span> <span>"), escape_html(F.col("source")), F.lit("</span></article>"),
        ).alias("line"),
    ))
    groups = settle(date_groups(_exploded(cards.select("on", "day", "pos")), settings, ["page", "label"]))

    def at(day: Column, part: int, pos: Column) -> Column:
        # Days descend: the digits of a day are complemented, and `unknown` precedes them.
        turned = F.when(day == "unknown", F.lit("")).otherwise(F.translate(day, "0123456789", "9876543210"))
        return F.struct(turned.alias("day"), F.lit(part).alias("part"), pos.cast("bigint").alias("pos")).alias("ord")

    top = F.lit(None).cast("string")
    sizes = groups.groupBy("page", "label").agg(F.sum("n").alias("n"))
    missed = search_pages(site, settings, sizes).where("n = 0")
    empty = missed.select(F.col("path").alias("page"), search_label(F.col("query")).alias("label"), F.lit("No results found").alias("total"))
    home = site.sparkSession.range(1).select(F.lit("/").alias("page"), F.lit(HOME_LABEL).alias("label"), F.lit(0).cast("bigint").alias("n"))
    totals = sizes.unionByName(home).groupBy("page", "label").agg(F.sum("n").alias("n"))
    heading = totals.select("page", "label", counted(F.col("n")).alias("total")).unionByName(empty).select(
        F.col("page").alias("path"), at(top, 0, F.lit(1)),
        F.concat(
            F.lit("<h1>"), escape_html(F.col("label")), F.lit("</h1><p>"), F.col("total"), F.lit("</p>")
        ).alias("line"),
    )
    trail = sizes.where(F.startswith("page", F.lit("/category/"))).select(
        F.col("page").alias("path"), at(top, 0, F.lit(0)),
        F.concat(F.lit(f'<nav><a href="/">{settings.name}</a> › <span>'), escape_html(F.col("label")), F.lit("</span></nav>")).alias("line"),
    )
    days = groups.select(
        F.col("page").alias("path"), at(F.col("day"), 1, F.lit(0)),
        F.concat(
            F.lit("<h2>"), day_label(F.col("day"), settings.as_of), F.lit("</h2><p>"), F.col("count_text"), F.lit("</p>")
        ).alias("line"),
    )
    items = _exploded(cards.select("on", at(F.col("day"), 2, F.col("pos")), "line")).select(F.col("page").alias("path"), "ord", "line")
    none = missed.select(
        "path", at(top, 0, F.lit(2)), F.concat(F.lit("<p>"), escape_html(F.col("message")), F.lit("</p>")).alias("line")
    )
    return trail.unionByName(heading).unionByName(days).unionByName(items).unionByName(none)


# --- sitemaps and feed ----------------------------------------------------------------------


def distinct_categories(site: DataFrame) -> DataFrame:
    """Non-empty categories with the place of their first article."""
    return site.where(F.col("category") != "").groupBy("category").agg(F.min("pos").alias("first_pos"))


def sitemap_urls(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """All URLs in the order `(class, ord)`; articles are listed even when their slugs are equal."""
    today = F.date_format(clock(settings.as_of), "yyyy-MM-dd")
    fixed = [(0, 0, "/", "1.0", "hourly"), (0, 1, "/about", "0.3", "monthly")]
    static = site.sparkSession.createDataFrame(
        fixed, "class bigint, ord bigint, loc string, priority string, changefreq string"
    ).withColumn("lastmod", today)
    queries = site.sparkSession.createDataFrame(list(enumerate(settings.queries)), "ord bigint, query string")

    def entries(rows, rank, ord_column, loc, lastmod, priority, changefreq):
        return rows.select(
            F.lit(rank).cast("bigint").alias("class"), F.col(ord_column).alias("ord"), loc.alias("loc"),
            F.lit(priority).alias("priority"), F.lit(changefreq).alias("changefreq"), lastmod.alias("lastmod"),
        )

    searches = entries(queries, 1, "ord", search_path(F.col("query")), today, "0.6", "daily")
    categories = entries(
        distinct_categories(site), 2, "first_pos", category_path(F.col("category")), today, "0.7", "hourly"
    )
    articles = entries(
        site, 3, "pos", article_path(F.col("title")),
        last_modified(F.col("processed_at"), settings.as_of), "0.8", "monthly",
    )
    return static.unionByName(searches).unionByName(categories).unionByName(articles)


def sitemap_entry(settings: SiteSettings) -> Column:
    """Markup of one sitemap row. A fixed format."""
    return F.concat(
        F.lit("  <url>\n    <loc>"), escape_xml(F.concat(F.lit(settings.url), F.col("loc"))),
        F.lit("</loc>\n    <lastmod>"), F.col("lastmod"),
        F.lit("</lastmod>\n    <changefreq>"), F.col("changefreq"),
        F.lit("</changefreq>\n    <priority>"), F.col("priority"), F.lit("</priority>\n  </url>"),
    )


def recent_articles(site: DataFrame, settings: SiteSettings) -> DataFrame:
    return site.where(is_recent(F.col("processed_at"), settings.as_of, RECENT_DAYS))


def news_sitemap(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """Rows of the news sitemap: recent articles in list order."""
    return recent_articles(site, settings).select(
        "pos",
        F.concat(F.lit(settings.url), article_path(F.col("title"))).alias("loc"),
        iso_instant(F.col("processed_at"), settings.as_of).alias("publication_date"),
        or_default(F.col("title"), "Untitled").alias("title"),
        keywords(F.col("category"), F.col("source")).alias("keywords"),
    )


def news_entry(settings: SiteSettings) -> Column:
    """Markup of one news sitemap row. A fixed format."""
    return F.concat(
        F.lit("  <url>\n    <loc>"), escape_xml(F.col("loc")), F.lit("</loc>\n    <news:news>\n"),
        F.lit("      <news:publication>\n        <news:name>"), escape_xml(F.lit(settings.name)),
        F.lit("</news:name>\n        <news:language>en</news:language>\n      </news:publication>\n"),
        F.lit("      <news:publication_date>"), F.col("publication_date"),
        F.lit("</news:publication_date>\n      <news:title>"), escape_xml(F.col("title")),
        F.lit("</news:title>\n      <news:keywords>"), escape_xml(F.col("keywords")),
        F.lit("</news:keywords>\n    </news:news>\n  </url>"),
    )


def feed_items(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """The first FEED_ITEMS articles as feed columns."""
    link = F.concat(F.lit(settings.url), article_path(F.col("title")))
    return site.orderBy("pos").limit(FEED_ITEMS).select(
        "pos",
        or_default(F.col("title"), "Untitled").alias("title"),
        link.alias("link"),
        rfc_instant(F.col("processed_at"), settings.as_of).alias("pub_date"),
        or_default(F.col("author"), settings.name).alias("creator"),
        or_default(F.col("category"), "Technology").alias("category"),
        F.substring(strip_markdown(F.col("summary")), 1, FEED_TEXT).alias("description"),
        markdown_to_html(F.col("summary")).alias("content_html"),
        or_default(F.col("url"), "#").alias("original_url"),
        or_default(F.col("source"), "Unknown").alias("source"),
    )


def feed_entry(settings: SiteSettings) -> Column:
    """Markup of one feed item. A fixed format."""
    link = escape_xml(F.col("link"))
    credit = F.concat(
        F.lit('\n<p><a href="'), link, F.lit(f'">Read on {settings.name}</a> · <a href="'),
        escape_xml(F.col("original_url")), F.lit('">Original source: '), escape_xml(F.col("source")),
        F.lit("</a></p>"),
    )
    return F.concat(
        F.lit("  <item>\n    <title>"), escape_xml(F.col("title")),
        F.lit("</title>\n    <link>"), link,
        F.lit('</link>\n    <guid isPermaLink="true">'), link,
        F.lit("</guid>\n    <pubDate>"), F.col("pub_date"),
        F.lit("</pubDate>\n    <dc:creator>"), escape_xml(F.col("creator")),
        F.lit("</dc:creator>\n    <category>"), escape_xml(F.col("category")),
        F.lit("</category>\n    <description>"), cdata(F.col("description")),
        F.lit("</description>\n    <content:encoded>"), cdata(F.concat(F.col("content_html"), credit)),
        F.lit("</content:encoded>\n  </item>"),
    )


# --- statistics -----------------------------------------------------------------------------


def corpus_statistics(site: DataFrame) -> DataFrame:
    """Articles, distinct authors and distinct sources."""
    return site.agg(
        F.count("*").alias("articles"),
        F.count_distinct(F.when(F.col("author") != "", F.col("author"))).alias("authors"),
        F.count_distinct(F.when(F.col("source") != "", F.col("source"))).alias("sources"),
    )


def build_summary(site: DataFrame, settings: SiteSettings) -> DataFrame:
    """Counts of the published pages. An article exactly RECENT_DAYS old does not count as recent."""
    edge = clock(settings.as_of) - F.make_interval(days=F.lit(RECENT_DAYS))
    n_queries = len(settings.queries)
    counts = site.agg(
        F.count("*").alias("articles"),
        F.count_distinct(F.when(F.col("category") != "", F.col("category"))).alias("categories"),
        F.count_if(F.coalesce(instant(F.col("processed_at")) > edge, F.lit(False))).alias("recent"),
    )
    return counts.select(
        "articles", "categories", F.lit(n_queries).cast("bigint").alias("searches"),
        (F.col("articles") + F.col("categories") + F.lit(n_queries + 2)).alias("sitemap_urls"),
        "recent", F.least("articles", F.lit(FEED_ITEMS).cast("bigint")).alias("feed_items"),
    )
