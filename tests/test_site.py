"""Merge, history and publication operators against brute force."""

import dataclasses
import itertools
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import corpus, history, joins, merging
from newsloom.operators import publication as pub
from newsloom.schemas import SITE_FIELDS
from registry import QUERIES

SETTINGS = pub.SiteSettings(as_of="2024-01-03 12:00:00", queries=("alpha", "no hit"))
SITE = "pos bigint, " + ", ".join(f"{f} string" for f in SITE_FIELDS)


def site(spark, rows):
    """Rows are dictionaries; missing fields are empty."""
    return spark.createDataFrame(
        [(i, *[row.get(f, "") for f in SITE_FIELDS]) for i, row in enumerate(rows)], SITE
    )


@pytest.mark.parametrize("broadcast_rows,key_rows", [(200_000, 1_000_000), (0, 1_000_000), (0, 4)])
def test_merge_rules(spark, monkeypatch, broadcast_rows, key_rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    existing = site(spark, [{"url": "U1", "title": "One"}, {"url": "", "title": ""}, {"url": "u3", "title": "Three -"}])
    batch = site(spark, [
        {"url": " u1 ", "title": "new"},           # known URL
        {"url": "u9", "title": " THREE"},          # known title
        {"url": "u1", "title": "One"},             # both: counted as URL
        {"url": "", "title": "x"},                 # empty URL matches an empty URL
        {"url": "u5", "title": ""},                # empty title matches nothing
        *[{"url": "dup", "title": "dup"}] * 20,    # repeats inside the batch all stay
    ])
    flagged = merging.flag_known(existing, batch, "pos", key_rows)
    stats = merging.merge_statistics(flagged).first()
    assert tuple(stats) == (21, 3, 1, 25)
    added = merging.rows_to_add(existing, batch, "pos", key_rows)
    assert sorted(r["pos"] for r in added.collect()) == list(range(4, 25))
    merged = merging.merged_site(existing.withColumn("run_seq", F.lit(0)), added.withColumn("run_seq", F.lit(1)))
    again = merging.rows_to_add(merged, batch, "pos", key_rows)
    assert again.count() == 0
    order = merging.list_position(merged.withColumn("run_seq", F.col("run_seq").cast("bigint")))
    first = order.orderBy("position").select("run_seq", "pos").collect()
    assert [tuple(r) for r in first][:2] == [(1, 4), (1, 5)] and tuple(first[-1]) == (0, 2)


def test_merged_texts_are_shuffled_once(spark, monkeypatch, small_dir):
    """Keys are compared and numbered apart; rows with their texts meet the events by `pos`, and the answers there."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = QUERIES["site_merge"](spark, small_dir)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        rows = merged.orderBy("position").select("position", "run_seq", "pos").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Two parts of the site with their events, the rows that are known, and the numbers.
    assert plan.count("Exchange ") == 6
    assert [r["position"] for r in rows] == list(range(len(rows)))
    assert [tuple(r)[1:] for r in rows] == sorted(((r["run_seq"], r["pos"]) for r in rows), key=lambda k: (-k[0], k[1]))


def test_long_titles_are_compared_whole(spark):
    long_ = "word " * 60
    existing = site(spark, [{"url": "a", "title": long_ + "x"}])
    batch = site(spark, [{"url": "b", "title": long_ + "y"}, {"url": "c", "title": long_.upper() + " X -"}])
    assert [r["url"] for r in merging.rows_to_add(existing, batch, "pos").collect()] == ["b"]


def test_spread_join_splits_hot_keys_and_keeps_all_rows(spark):
    keys = [None if i % 5 == 4 else "hot" if i % 3 else f"k{i}" for i in range(300)]
    left = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("absent", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(r["id"] for r in left.join(right, "k", how).collect())
        assert sorted(r["id"] for r in joins.spread_join(left, right, "k", how, ["id"], key_rows=10).collect()) == want


def naive_related(rows):
    out = []
    for i, a in enumerate(rows):
        other = [j for j, b in enumerate(rows) if b["category"] == a["category"] and b["url"] != a["url"]]
        out += [(i, place + 1, j) for place, j in enumerate(other[:4])]
    return out


@pytest.mark.parametrize("seed,urls,probe", [(1, 200, 64), (2, 3, 64), (3, 6, 10), (4, 1, 5)])
def test_related_equals_brute_force(spark, monkeypatch, seed, urls, probe):
    monkeypatch.setattr(pub, "PROBE", probe)
    rng = random.Random(seed)
    # One URL fills the head of the list, so the probe of its category is not enough.
    rows = [{"category": "c0", "url": "hot"} for _ in range(80)]
    rows += [{"category": f"c{rng.randrange(3)}", "url": f"u{rng.randrange(urls)}"} for _ in range(60)]
    got = pub.related_articles(site(spark, rows), SETTINGS).select("pos", "place", "related_pos").collect()
    assert sorted(tuple(r) for r in got) == naive_related(rows)


def test_slug_collisions_last_wins(spark):
    rows = site(spark, [{"title": "A b"}, {"title": "a  B!"}, {"title": ""}, {"title": "c"}, {"title": "article"}])
    assert sorted(r["pos"] for r in pub.published_articles(rows).collect()) == [1, 3, 4]
    assert {r["slug"]: (r["pos"], r["n_articles"]) for r in pub.slug_winners(rows).collect()} == {
        "a-b": (1, 2), "article": (4, 2), "c": (3, 1)
    }


def test_category_slug_collision_and_defaults(spark):
    rows = site(spark, [{"category": "A!"}, {"category": "A"}, {"category": ""}, {"category": "A"}])
    page = pub.category_pages(rows, SETTINGS).collect()
    assert [(r["category"], r["n"], r["n_categories"]) for r in page] == [("A!", 1, 2)]
    assert {r["category"] for r in pub.distinct_categories(rows).collect()} == {"A!", "A"}
    cards = pub.listing_rows(rows, SETTINGS).where("page like '/category/%'").collect()
    assert [(r["page"], r["label"], r["pos"]) for r in cards] == [("/category/a", "A!", 0)]
    parts = pub.collection_parts(rows).where("page != '/'").collect()
    assert [(r["label"], r["pos"]) for r in parts] == [("A!", 0)]


def test_search_has_no_hit_across_fields(spark):
    rows = site(spark, [{"title": "x al", "summary": "pha"}, {"title": "ALPHAbet"}, {"author": "alpha"}])
    assert sorted(r["pos"] for r in pub.search_hits(rows, SETTINGS.queries).collect()) == [1, 2]
    pages = {r["query"]: r for r in pub.search_pages(rows, SETTINGS).collect()}
    assert pages["alpha"]["n"] == 2 and pages["alpha"]["robots"] == "index, follow" and pages["alpha"]["message"] is None
    assert pages["no hit"]["n"] == 0 and pages["no hit"]["robots"] == "noindex, follow"
    assert pages["no hit"]["path"] == "/search/no-hit" and "Nothing found" in pages["no hit"]["description"]


def test_date_groups_put_unknown_first(spark):
    rows = site(spark, [{"processed_at": d} for d in ("2024-01-03T01:00:00", "x", "2024-01-01", "2024-01-03")])
    days = rows.withColumn("day", F.when(F.col("processed_at") == "x", "unknown").otherwise(F.substring("processed_at", 1, 10)))
    got = [(r["day"], r["day_label"], r["count_text"]) for r in pub.date_groups(days, SETTINGS).collect()]
    assert got == [
        ("unknown", "Unknown date", "1 article"), ("2024-01-03", "Today", "2 articles"),
        ("2024-01-01", "Monday, January 1, 2024", "1 article"),
    ]


def test_defaults_of_empty_fields(spark):
    rows = site(spark, [{}])
    page = pub.article_pages(rows, rows, SETTINGS).first()
    assert (page["badge"], page["byline"], page["headline"], page["trail_title"], page["original_url"]) == (
        "News", "Unknown", "Untitled", "Article…", "#"
    )
    assert page["category_path"] == "/category/news" and page["path"] == "/article/article" and page["related"] == []
    item = pub.feed_items(rows, SETTINGS).first()
    assert (item["creator"], item["category"]) == (SETTINGS.name, "Technology")
    assert '"articleSection":"Technology"' in pub.article_documents(rows, SETTINGS).first()["article_ld"]


def test_history_and_report(spark):
    entries = spark.createDataFrame([
        (1, "r1", 3, ["A", "B"], {"A": 2, "B": 1}),
        (2, "r2", 1, None, {"C": 1}),
        (3, "r3", 0, ["B"], {"B": 0, "X": 9}),
    ], "run_seq bigint, run_at string, total_successes bigint, categories array<string>, category_counts map<string,bigint>")
    seen = history.all_categories(entries).orderBy("run_seq", "ord").collect()
    assert [r["category"] for r in seen] == ["A", "B", "C"]
    totals = {r["category"]: r["n"] for r in history.category_totals(entries).collect()}
    assert totals == {"A": 2, "B": 1, "C": 1, None: 4}
    lines = [r["line"] for r in history.report_lines(entries).orderBy("section", "ord").collect()]
    cell = lambda c, n: f"  {c:<32}  {n:>4}"
    assert lines == [
        history.THICK, history.TOTALS_HEADING, history.THICK, cell("A", 2), cell("B", 1), cell("C", 1), history.THIN,
        cell(history.TOTAL_LABEL, 4), history.THICK, "",
        "Run  r3   (0 successes)", history.THIN, cell("B", 0), "",
        "Run  r2   (1 successes)", history.THIN, cell("C", 1), "",
        "Run  r1   (3 successes)", history.THIN, cell("A", 2), cell("B", 1), "",
    ]


def test_run_entries_count_only_configured_labels(spark):
    rows = spark.createDataFrame(
        [(1, "r", c) for c in ("A", "A", "Z", None)], "run_seq bigint, run_at string, category string"
    )
    entry = history.run_entries(rows, ["A", "B"]).first()
    assert entry["total_successes"] == 4 and entry["category_counts"] == {"A": 2, "B": 0}


def test_run_without_success_has_an_entry(spark):
    rows = spark.createDataFrame([], "category string")
    entry = history.run_entry(rows, ["A", "B"], "r").first()
    assert entry["total_successes"] == 0 and entry["category_counts"] == {"A": 0, "B": 0}


def test_leading_rows_match_sorting(spark):
    rows = [{"category": c, "title": str(i)} for i, c in enumerate(itertools.islice(itertools.cycle("ab"), 50))]
    parts = pub.collection_parts(site(spark, rows)).collect()
    by_page = {}
    for r in sorted(parts, key=lambda r: r["pos"]):
        by_page.setdefault(r["page"], []).append(r["pos"])
    assert by_page == {
        "/": list(range(10)), "/category/a": list(range(0, 20, 2)), "/category/b": list(range(1, 20, 2))
    }


def test_thousands_of_searches_equal_brute_force(spark):
    rng = random.Random(1)
    letters = "abcde é"
    rows = [{"title": "".join(rng.choices(letters, k=40)), "summary": "".join(rng.choices(letters, k=80)), "category": rng.choice(["A", "b e"])} for _ in range(60)]
    queries = list({"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(3000)} | {"zzz", "A", "B E"})
    frame = site(spark, rows)
    got = {(r["pos"], r["query"]) for r in pub.search_hits(frame, queries).select("pos", "query").collect()}
    whole = {r["pos"]: [str(r[c] or "").lower() for c in pub.SEARCH_FIELDS] for r in frame.collect()}
    assert got == {(pos, q) for pos, fields in whole.items() for q in queries if any(q.lower() in f for f in fields)}
    plan = pub.search_hits(frame, queries)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(plan) < 20_000


def test_thousands_of_topics_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 4))) for _ in range(300)]
    topics = list({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(2000)})
    rows = [(i, "en", f"u{i}", " ".join(rng.choices(words, k=12)), None, " ".join(rng.choices(words, k=20)), "2024-01-02T00:00:00") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id int, lang string, url string, title string, description string, content string, published_at string")
    got = {(r["doc_id"], r["topic"]) for r in corpus.topic_hits(frame, topics, "2024-01-03 12:00:00").collect()}
    assert got == {(r[0], t) for r in rows for t in topics if all(w in r[3] or w in r[5] for w in t.split())}


def test_a_card_is_built_once_for_each_article(spark):
    """Slugs and escapes are worked out below the step that repeats an article for its pages."""
    rows = pub.listing_rows(site(spark, [{"title": "t", "category": "c"}]), SETTINGS)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "/article/" not in plan[: plan.index("Generate explode")]


def test_list_pages_are_made_of_stored_cards(spark):
    """The texts of the site are searched once: headings, counts and lines come from the cards."""
    settings = dataclasses.replace(SETTINGS, queries=("alpha", "nothing like it"))
    rows = site(spark, [{"title": "alpha", "category": "c"}, {"title": "beta", "summary": "alpha too"}])
    lines = pub.list_page_lines(rows, settings)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "summary" not in plan and "/article/" not in plan
    found = {}
    for r in lines.orderBy("path", "ord").collect():
        found.setdefault(r["path"], []).append(r["line"])
    assert sum("<article>" in x for x in found["/search/alpha"]) == 2 and sum("<article>" in x for x in found["/category/c"]) == 1
    assert [x for x in found["/search/nothing-like-it"] if "No results found" in x]
    assert not any("<article>" in x for x in found["/search/nothing-like-it"])


def test_of_searches_with_one_slug_the_last_keeps_the_page(spark):
    settings = dataclasses.replace(SETTINGS, queries=("new wave", "alpha", "new-wave"))
    rows = site(spark, [{"title": "new wave"}, {"title": "the new-wave"}, {"title": "alpha"}])
    pages = pub.search_pages(rows, settings).collect()
    assert sorted((r["query"], r["path"], r["n"]) for r in pages) == [("alpha", "/search/alpha", 1), ("new-wave", "/search/new-wave", 1)]
    cards = pub.listing_rows(rows, settings).where("page = '/search/new-wave'").collect()
    assert [r["pos"] for r in cards] == [1]
    trails = [r["path"] for r in pub.list_breadcrumbs(rows, settings).collect()]
    assert len(trails) == len(set(trails))


@pytest.mark.parametrize("derived", [lambda rows: pub.article_documents(rows, SETTINGS).select("article_ld"), lambda rows: pub.page_manifest(rows, SETTINGS)])
def test_descriptions_rewrite_a_summary_once(spark, derived):
    """The heading rule stands three times in the plan of a plain text: for lines and twice for whole texts."""
    plan = derived(site(spark, [{"title": "a", "summary": "b"}]))._jdf.queryExecution().analyzed().toString()
    assert plan.count("#{1,6}") == 3
