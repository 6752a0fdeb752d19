"""Landing documents, the store, a whole batch run and the published documents."""

import glob
import json
import xml.dom.minidom

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from newsloom.operators import publication as pub
from newsloom.operators.progress import numbered_successes
from newsloom.plans import batch
from newsloom.plans.curation import curate
from newsloom.sources import landing
from newsloom.sources.store import Store
from tests.standins import keyword_label, lead_summary


def article(n, **changes):
    base = {
        "source": {"id": None, "name": f"s{n}"}, "author": f"a{n}", "title": f"Title {n}", "description": "d",
        "url": f"https://x.org/{n}", "urlToImage": None, "publishedAt": "2026-08-21T01:03:38Z", "content": "c",
        "extra": 1,
    }
    return base | changes


@pytest.fixture
def folder(tmp_path):
    def put(name, value):
        text = value if isinstance(value, str) else json.dumps(value, indent=2)
        (tmp_path / name).write_text(text, encoding="utf-8")

    def envelope(articles):
        return {"status": "ok", "totalResults": 35, "articles": articles}

    put("news_Data_breach_2026-08-22_13-36-21.json", envelope([article(1), article(2, source=None), article(3, url=" ")]))
    put("news_Malware_2026-08-22_13-36-24.json", envelope([article(4), article(1, title="again"), article(5, author=None)]))
    put("news_Empty_2026-08-22_13-36-22.json", envelope([]))
    put("news_Null_2026-08-22_13-36-22.json", envelope(None))
    put("news_Missing_2026-08-22_13-36-22.json", {"status": "error"})
    put("news_Broken_2026-08-22_13-36-25.json", '{"status": "ok", "articles": [{"url": "https://x')
    put("other.json", envelope([article(9)]))
    return str(tmp_path)


def test_landing_rules(spark, folder):
    read = landing.read_landing(spark, folder)
    rows = read.articles.orderBy("topic", "pos").collect()
    assert [(r["topic"], r["pos"], r["title"], r["source"]) for r in rows] == [
        ("Data breach", 0, "Title 1", "s1"), ("Data breach", 1, "Title 2", "Unknown"), ("Data breach", 2, "Title 3", "s3"),
        ("Malware", 0, "Title 4", "s4"), ("Malware", 1, "again", "s1"), ("Malware", 2, "Title 5", "s5"),
    ]
    assert str(rows[0]["fetch_ts"]) == "2026-08-22 13:36:21"
    assert [r["topic"] for r in read.rejects.collect()] == ["Broken"]


def test_landing_without_files_or_articles(spark, folder, tmp_path):
    with pytest.raises(AnalysisException):
        landing.read_landing(spark, str(tmp_path / "nowhere")).articles.count()
    empty = landing.read_landing(spark, folder).articles.where("topic = 'Empty'")
    with pytest.raises(ValueError):
        landing.require_articles(empty)


def test_curate_interleaves_newest_first(spark, folder):
    articles = landing.read_landing(spark, folder).articles
    got = curate(articles, source_limit=1, goal=50).orderBy("index").collect()
    assert [r["title"] for r in got] == ["Title 4", "Title 1", "Title 2", "Title 5"]
    assert [r["index"] for r in got] == [0, 1, 2, 3]
    assert curate(articles, source_limit=1, goal=2).count() == 2


def test_batch_run_end_to_end(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    articles = landing.read_landing(spark, folder).articles
    texts = spark.createDataFrame(
        [(f"https://x.org/{n}", "data breach " * 30) for n in (1, 4, 5)], "url string, text string"
    )
    limits = {"min_content": 150, "chunk": 1000}
    for run in (1, 2):
        reached = batch.run(
            store, articles, texts, lead_summary, keyword_label, run, f"2026-08-22T1{run}:00:00",
            candidate_goal=4, success_goal=2, **limits,
        )
        assert reached
    results = store.read_results().orderBy("index").collect()
    assert [(r["index"], r["success"]) for r in results] == [(0, True), (1, True)]
    assert [r["title"] for r in store.read_processed().collect()] == ["Title 4", "Title 1"]
    master = store.read_master().orderBy("index").collect()
    assert [r["article"]["title"] for r in master] == ["Title 4", "Title 1", "Title 2", "Title 5"]
    # The second run finds its articles in the site table and adds none.
    assert [(r["run_seq"], r["title"]) for r in store.read_site().orderBy("pos").collect()] == [
        (1, "Title 4"), (1, "Title 1")
    ]
    history = store.read_history().orderBy("run_seq").collect()
    assert [(r["run_seq"], r["total_successes"], r["category_counts"]["Cybersecurity"]) for r in history] == [
        (1, 2, 2), (2, 2, 2)
    ]
    texts = sorted(r["body"] for r in store.read_summaries().collect())
    assert len(texts) == 2 and texts[0].startswith("Title 1\n" + "=" * 60 + "\n\n**Lead** data breach")
    assert texts[0].rstrip("\n").endswith("Author:   a1\nSource:   s1\nURL:      https://x.org/1\nCategory: Cybersecurity")

    settings = pub.SiteSettings(as_of="2026-08-22 12:00:00", queries=("breach", "none"))
    batch.publish(store, store.read_site(), settings)
    document = "".join(
        open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{store.path('publish/sitemap.xml')}/part-*"))
    )
    urls = [n.firstChild.data for n in xml.dom.minidom.parseString(document).getElementsByTagName("loc")]
    base = settings.url
    assert urls == [base + p for p in (
        "/", "/about", "/search/breach", "/search/none", "/category/cybersecurity", "/article/title-4", "/article/title-1"
    )]
    for name in ("feed.xml", "news-sitemap.xml"):
        text = "".join(
            open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{store.path('publish/' + name)}/part-*"))
        )
        assert xml.dom.minidom.parseString(text)
    page = "\n".join(page_lines(store, "article_pages", "/article/title-4"))
    assert "<h1 class=\"article-title\">Title 4</h1>" in page and "/article/title-1" in page and "<strong>Lead</strong>" in page
    manifest = spark.read.parquet(store.path("publish/manifest"))
    assert {r["path"]: r["robots"] for r in manifest.collect()} == {
        "/": "index, follow", "/category/cybersecurity": "index, follow", "/search/breach": "index, follow",
        "/search/none": "noindex, follow", "/article/title-4": "index, follow", "/article/title-1": "index, follow",
    }


def test_store_starts_empty_and_keeps_permanent_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read_results().count() == store.read_site().count() == store.read_history().count() == 0
    assert store.read_progress(str(tmp_path / "none.json")).count() == 0
    with pytest.raises(AnalysisException):
        store.read_processed().count()
    with pytest.raises(AnalysisException):
        store.read_master().count()
    rows = spark.createDataFrame([("t", "s", "a", "src", "u", "c", "p", 0)], "title string, summary string, "
                                 "author string, source string, url string, category string, processed_at string, pos bigint")
    store.append_site(rows, 1)
    store.append_site(rows, 1)
    store.clear_run()
    assert store.read_site().count() == 1 and store.read_processed().count() == 0
    store.export_site_json(store.read_site())
    exported = [json.loads(x) for f in glob.glob(store.path("publish/articles") + "/part-*") for x in open(f)]
    assert exported == [{"title": "t", "summary": "s", "author": "a", "source": "src", "url": "u", "category": "c", "processed_at": "p"}]


def test_progress_document_ignores_unknown_keys_and_broken_text(spark, tmp_path):
    record = {"index": 3, "url": "u", "title": "t", "source": "s", "author": "a", "success": True, "new_key": 1}
    (tmp_path / "good.json").write_text(json.dumps({"success_count": 1, "results": [record]}, indent=1))
    (tmp_path / "bad.json").write_text('{"results": [{"index":')
    store = Store(spark, str(tmp_path))
    got = store.read_progress(str(tmp_path / "good.json")).collect()
    assert got[0]["index"] == 3 and got[0]["category"] is None
    assert store.read_progress(str(tmp_path / "bad.json")).count() == 0


def test_site_json_keeps_array_places(spark, tmp_path):
    rows = [{"title": f"t{i}", "url": "ü", "extra": 1} for i in range(5)]
    (tmp_path / "articles.json").write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")
    got = Store(spark, str(tmp_path)).read_site_json(str(tmp_path / "articles.json")).orderBy("pos").collect()
    assert [(r["pos"], r["title"], r["url"], r["summary"]) for r in got] == [(i, f"t{i}", "ü", None) for i in range(5)]
    assert Store(spark, str(tmp_path)).read_site_json(str(tmp_path / "none.json")).count() == 0


def test_landing_pages_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame(
        [("Data breach", "2026-08-22 13:36:21", i, "S", f"a{i}", f"t{i}", f"u{i}", "2026-08-21T01:03:38Z") for i in range(5)],
        "topic string, fetch_ts string, pos bigint, source_name string, author string, title string, url string, published_at string",
    )
    store.write_landing(landing.envelope(rows, ("topic", "fetch_ts"), 3).drop("page"))
    flat = landing.flatten(store.read_landing_pages())
    assert sorted((r["topic"], r["pos"], r["title"]) for r in flat.collect()) == [
        ("Data breach", p, f"t{i}") for p, i in ((0, 0), (0, 3), (1, 1), (1, 4), (2, 2))
    ]


def page_lines(store, name, path):
    return store.read_pages(name, [path]).first()["body"].splitlines()


def test_resume_takes_up_recorded_results(spark, folder, tmp_path):
    """Results recorded before a break are kept and not asked for again."""
    store = Store(spark, str(tmp_path / "store"))
    articles = landing.read_landing(spark, folder).articles
    texts = spark.createDataFrame(
        [(f"https://x.org/{n}", "data breach " * 30) for n in (1, 2, 4, 5)], "url string, text string"
    )
    chosen = curate(articles, 1, 4)
    store.clear_run()
    store.write_master(chosen.join(articles.select("path", "pos", "article"), ["path", "pos"]), "now", 1, 4)
    done = spark.createDataFrame([(0, "u", "T", "s", "a", True, "Cybersecurity", "c", "kept", None, None, None, "before")],
                                 store.read_results().schema)
    store.write_block(done, 0)
    batch.run(store, articles, texts, lead_summary, keyword_label, 1, "after", success_goal=9, resume=True,
              min_content=150, chunk=1000)
    got = store.read_results().orderBy("index").collect()
    assert [(r["index"], r["processed_at"]) for r in got] == [(0, "before"), (1, "after"), (2, "after"), (3, "after")]
    log = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(store.path("publish/category_log.txt") + "/part-*")))
    assert "Run  after   (3 successes)" in log


def test_list_pages_keep_day_and_list_order(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    fields = ("pos", "title", "category", "processed_at")
    days = ["2024-01-01", "bad", "2024-01-03", "2024-01-01", "2024-01-02"]
    rows = spark.createDataFrame([(i, f"T{i}", "A & B", d) for i, d in enumerate(days)], ", ".join(
        f"{f} {'bigint' if f == 'pos' else 'string'}" for f in fields))
    for missing in ("summary", "author", "source", "url"):
        rows = rows.withColumn(missing, F.lit(""))
    settings = pub.SiteSettings(as_of="2024-01-03 12:00:00", queries=("t1", "zzz"))
    store.write_pages(pub.list_page_lines(rows, settings), "list_pages")
    home = page_lines(store, "list_pages", "/")
    assert home[0] == "<h1>Latest News</h1><p>5 articles</p>"
    assert [x.split("</h2>")[0] if x.startswith("<h2>") else x.split('"')[1] for x in home[1:]] == [
        "<h2>Unknown date", "/article/t1", "<h2>Today", "/article/t2", "<h2>Yesterday", "/article/t4",
        "<h2>Monday, January 1, 2024", "/article/t0", "/article/t3",
    ]
    assert page_lines(store, "list_pages", "/category/a-b")[:2] == [
        '<nav><a href="/">Newsloom</a> › <span>A &amp; B</span></nav>', "<h1>A &amp; B</h1><p>5 articles</p>"]
    assert len(page_lines(store, "list_pages", "/search/t1")) == 3
    assert page_lines(store, "list_pages", "/search/zzz") == [
        "<h1>Search: &quot;zzz&quot;</h1><p>No results found</p>", "<p>No articles match &quot;zzz&quot;.</p>"]
    store.write_pages(pub.list_page_lines(rows.limit(0), settings), "list_pages")
    assert page_lines(store, "list_pages", "/") == ["<h1>Latest News</h1><p>0 articles</p>"]
    assert {r["path"] for r in store.read_pages("list_pages").collect()} == {"/", "/search/t1", "/search/zzz"}


def test_numbered_summaries(spark):
    rows = spark.range(4).select(F.col("id").alias("index"), (F.col("id") != 1).alias("success"))
    assert [(r["index"], r["number"]) for r in numbered_successes(rows).orderBy("index").collect()] == [(0, 1), (2, 2), (3, 3)]


def test_topic_search_rules(spark):
    from newsloom.operators import corpus

    def row(n, **changes):
        base = {"doc_id": n, "lang": "en", "url": f"https://a.org/{n}", "title": "Data BREACH", "description": None,
                "content": "", "published_at": "2024-01-02T00:00:00"}
        return tuple((base | changes).values())

    rows = spark.createDataFrame([
        row(1), row(2, title="data", content="a breach"), row(3, lang="de"), row(4, url="https://b.org/4"),
        row(5, published_at="2024-01-02T12:00:00"), row(6, published_at="2024-01-02T01:00:00"), row(7, title="data only"),
        row(8, title=None, description="databreach"),
    ], "doc_id bigint, lang string, url string, title string, description string, content string, published_at string")
    hits = corpus.topic_hits(rows, ["Data breach", "Malware"], "2024-01-03 12:00:00")
    pages = corpus.topic_pages(hits, 3).orderBy("pos").collect()
    assert [(r["topic"], r["pos"], r["doc_id"]) for r in pages] == [("Data breach", 0, 6), ("Data breach", 1, 1), ("Data breach", 2, 2)]
    counts = corpus.topic_counts(corpus.topic_pages(hits, 3), ["Data breach", "Malware"]).collect()
    assert {r["topic"]: r["n_articles"] for r in counts} == {"Data breach": 3, "Malware": 0}
    only_b = corpus.topic_hits(rows, ["Data breach"], "2024-01-03 12:00:00", domains="b.org, c.org")
    assert [r["doc_id"] for r in only_b.collect()] == [4]
