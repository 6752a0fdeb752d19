"""One scheduled run: curate, enrich, record, merge and publish."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from email.utils import format_datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import history, merging, progress, publication
from newsloom.operators.joins import hinted
from newsloom.operators.stages import StageMaker
from newsloom.plans.curation import CANDIDATES, SOURCE_LIMIT, curate
from newsloom.plans.enrichment import enrich_until
from newsloom.session import settle
from newsloom.sources.landing import candidate_columns, require_articles
from newsloom.sources.store import Store

# The default categories and success goal.
CATEGORIES = ("Artificial Intelligence", "Phones, Laptops, and Gadgets", "Tech Business & Markets", "Cybersecurity")
SUCCESS_GOAL = 20


def run(
    store: Store,
    landing: DataFrame,
    texts: DataFrame,
    summarize: StageMaker | None,
    classify: StageMaker | None,
    run_seq: int,
    run_at: str,
    categories: Sequence[str] = CATEGORIES,
    candidate_goal: int = CANDIDATES,
    source_limit: int | None = SOURCE_LIMIT,
    success_goal: int = SUCCESS_GOAL,
    resume: bool = False,
    **limits: int,
) -> bool:
    """Process one batch of flat landing articles; returns whether the success goal was reached.

    `texts` gives the body text of a URL, one row for each `url`. With `resume` the master list
    and the results of a run that broke off are taken up; otherwise the run starts afresh.
    """
    if not resume:
        store.clear_run()
        # The documents are parsed once; all that follows reads the stored rows.
        landing = require_articles(store.stage("landing_articles", landing))
        chosen = settle(curate(landing, source_limit, candidate_goal))
        originals = landing.select("path", "pos", "article").join(hinted(chosen), ["path", "pos"])
        store.write_master(originals, run_at, source_limit, candidate_goal)
    master = settle(store.read_master().select("index", *candidate_columns("article")))
    if master.isEmpty():
        return False

    # The texts are reduced to the wanted URLs by a scan before they meet the candidates.
    wanted = texts.select("url", "text").join(hinted(master.select("url")), "url", "left_semi")
    candidates = settle(master.join(wanted, "url", "left").withColumn("processed_at", F.lit(run_at)))
    results = settle(enrich_until(
        candidates, summarize, classify, categories, success_goal, store=store, **limits
    ))
    store.write_results(results)
    store.write_processed(results, success_goal, run_at)
    store.write_summaries(progress.numbered_successes(results))

    successes = results.where("success")
    entry = history.run_entry(successes, categories, run_at)
    store.append_history(entry.withColumn("run_seq", F.lit(run_seq).cast("bigint")))
    store.write_document(
        "category_log.txt", history.report_lines(store.read_history()), F.col("line"), ["section", "ord"]
    )
    store.append_site(new_site_rows(store, successes.withColumnRenamed("index", "pos"), run_seq), run_seq)
    return successes.count() >= success_goal


def new_site_rows(store: Store, batch: DataFrame, run_seq: int) -> DataFrame:
    """Rows that a batch with the order column `pos` adds to the rows of the other runs."""
    existing = store.read_site().where(F.col("run_seq") != run_seq)
    return merging.rows_to_add(existing, batch, "pos")


def publish(store: Store, site: DataFrame, settings: publication.SiteSettings) -> None:
    """Write all publication tables, pages and documents of a site table.

    The list places are numbered from the order key `(run_seq desc, pos)`.
    """
    store.export_site_json(site)
    placed = merging.list_position(site).drop("run_seq", "pos")
    # A stored table, so that each publication table below reads its own columns only.
    site = store.stage("publish/site", placed.withColumnRenamed("position", "pos"))
    for name, table in publication_tables(site, settings).items():
        table.write.mode("overwrite").parquet(store.path(f"publish/{name}"))
    published = publication.published_articles(site)
    bodies = publication.article_bodies(publication.article_pages(published, site, settings), settings)
    store.write_pages(bodies.select("path", F.lit(0).alias("ord"), F.col("body").alias("line")), "article_pages")
    store.write_pages(publication.list_page_lines(site, settings), "list_pages")
    store.write_document(
        "sitemap.xml", publication.sitemap_urls(site, settings), publication.sitemap_entry(settings),
        ["class", "ord"], head=SITEMAP_HEAD, foot=URLSET_FOOT,
    )
    store.write_document(
        "news-sitemap.xml", publication.news_sitemap(site, settings), publication.news_entry(settings),
        ["pos"], head=NEWS_HEAD, foot=URLSET_FOOT,
    )
    store.write_document(
        "feed.xml", publication.feed_items(site, settings), publication.feed_entry(settings),
        ["pos"], head=feed_head(settings), foot=FEED_FOOT,
    )


def publication_tables(site: DataFrame, settings: publication.SiteSettings) -> dict[str, DataFrame]:
    published = publication.published_articles(site)
    listing = publication.listing_rows(site, settings)
    return {
        "manifest": publication.page_manifest(site, settings),
        "listing": listing,
        "date_groups": publication.date_groups(listing, settings, ["page"]),
        "articles_content": publication.article_pages(published, site, settings),
        "articles_ld": publication.article_documents(published, settings),
        "collections_ld": publication.collection_documents(site, settings),
        "summary": publication.build_summary(site, settings),
        "statistics": publication.corpus_statistics(site),
    }


# Fixed formats: opening and closing lines of the published documents.
SITEMAP_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n'
    '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
)
NEWS_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n'
    '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"\n'
    '        xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">'
)
URLSET_FOOT = "</urlset>"
FEED_FOOT = "  </channel>\n</rss>"


def feed_head(settings: publication.SiteSettings) -> str:
    """Channel part of the feed."""
    built = format_datetime(datetime.fromisoformat(settings.as_of).replace(tzinfo=timezone.utc), usegmt=True)
    return "\n".join([
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<rss version="2.0"',
        '  xmlns:atom="http://www.w3.org/2005/Atom"',
        '  xmlns:content="http://purl.org/rss/1.0/modules/content/"',
        '  xmlns:dc="http://purl.org/dc/elements/1.1/">',
        "  <channel>",
        f"    <title>{settings.name}</title>",
        f"    <link>{settings.url}</link>",
        f"    <description>{settings.description}</description>",
        "    <language>en-us</language>",
        f"    <lastBuildDate>{built}</lastBuildDate>",
        f'    <atom:link href="{settings.url}/feed.xml" rel="self" type="application/rss+xml" />',
        "    <image>",
        f"      <url>{settings.url}/logo.png</url>",
        f"      <title>{settings.name}</title>",
        f"      <link>{settings.url}</link>",
        "    </image>",
    ])
