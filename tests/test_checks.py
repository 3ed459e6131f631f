import pytest
from pyspark.sql import functions as F

from pagewarden.operators.access import MAJOR_BOTS, bot_access, bot_crawlability, excluded_pages, noindex_for_all, sitemap_score
from pagewarden.operators.readiness import ALL_PAGE_CHECKS as PAGE_CHECKS
from pagewarden.plans.scorecard import category_summary, check_summary, page_results, site_summary

CHECKS = {c.id: c for c in PAGE_CHECKS}


def page(head="", body="", lang="en"):
    return f'<html lang="{lang}"><head>{head}</head><body>{body}</body></html>'


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


CASES = [
    ("meta.title", page(), 0),
    ("meta.title", page("<title>A guide to pinning in place of all versions - Brand</title>"), 5),
    ("meta.title", page("<title>Home</title>"), 0),
    ("meta.title", page("<title>step-by-step ways of doing all of the things we do here</title>"), 5),
    ("meta.description", page(f'<meta name="DESCRIPTION" content="{"ab cd " * 22}">'), 5),
    ("meta.description", page('<meta name="description" content="Welcome to us">'), 1),
    ("meta.viewport", page('<meta name="viewport" content="width=device-width; initial-scale=1">'), 3),
    ("meta.language", page(lang="xx-YY"), 2),
    ("meta.language", page(lang="es-419"), 3),
    ("content.headings", page(body="<h2>About us</h2><h4>More of it</h4>"), 4),
    ("content.headings", page(body="<p>x</p>"), 0),
    ("content.image-alt", page(body='<img alt="x"><img>'), 3),
    ("content.image-alt", page(body="x"), 5),
    ("content.freshness", page('<script type="application/ld+json">{"a": [{"datePublished": "2024-01-01"}]}</script>'), 3),
    ("content.freshness", page('<script type="application/ld+json">{"datePublished": ""}</script>'), 0),
    ("content.freshness", page(body='<time datetime="2024-01-01" class="published"></time><time datetime="2024"></time>'), 5),
    ("content.accessibility", page(body="<main></main><nav></nav><input>"), 3),
    ("content.internal-links", page(body='<a href="/a">Read more</a><a href="mailto:x">y</a>'), 2),
    ("content.internal-links", page(body='<nav>' + '<a href="/a">About the site</a>' * 5 + "</nav>"), 4),
    ("content.quality", page(body="<article>few words</article>"), 1),
    ("meta.open-graph", page('<meta property="og:title" content="t"><meta name="og:description" content="d"><meta property="og:image" content=" ">'), 1),
    ("meta.twitter-cards", page('<meta property="og:title" content="t">'), 2),
    ("structured-data.present", page(body="x"), 0),
    ("structured-data.present", page(body='<div itemscope itemtype="https://schema.org/Thing"></div>'), 4),
    ("structured-data.present", page(ld('{"@type": "Organization", "name": "O"}', '{"@type": "WebSite", "url": "u"}')), 12),
    ("structured-data.present", page(ld('{"@graph": [{"@type": "Article"}]}')), 6),
    ("structured-data.present", page(ld('{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q", "acceptedAnswer": {"@type": "Answer", "text": "a"}}]}')), 12),
    ("structured-data.present", page(ld('{"@type": {{ kind }}, {% if a %}')), 8),
    ("structured-data.valid", page(ld('{"@type": "Person", "name": "P"}', "{,")), 4),
    ("structured-data.valid", page(ld('{"@type": "Article", "headline": "h", "author": {"@id": "#a"}, "datePublished": "{{ d }}"}', '{"@id": "#a", "@type": "Person", "name": "P"}')), 5),
    ("structured-data.valid", page(ld('{"@type": "VideoObject"}')), 3),
    ("crawlability.indexability", page('<meta name="robots" content="NONE"><title>t</title>', "word " * 300), 0),
    ("crawlability.indexability", page("<title>t</title>", "word " * 300), 7),
    ("crawlability.indexability", page('<title>Not found</title>', "few words"), 0),
    ("crawlability.indexability", page('<link rel="canonical" href="https://other.example/">', "word " * 300), 0),
    ("crawlability.indexability", page('<link rel="canonical" href="/x/y/"><meta name="googlebot" content="nofollow">', "word " * 300), 6),
    ("agent-readiness.server-rendered", page(body='<div id="root"></div><script src="a.js"></script>'), 0),
    ("agent-readiness.server-rendered", page("<title>t</title>", '<h1>Few</h1><script>run()</script>'), 3),
    ("agent-readiness.server-rendered", page(body='<div id="app"></div>' + "word " * 90), 1),
    ("agent-readiness.server-rendered", page(body="few words"), 6),
    ("agent-readiness.controls", page(body="<button></button><a>x</a><div onclick=x>y</div><input name=firstName>"), 0),
    ("agent-readiness.controls", page(body='<span id=l>Send</span><button aria-labelledby="k l"></button><a href="/a">x</a><div onclick=x tabindex=0>y</div><input name=first-name autocomplete=given-name>'), 4),
    ("agent-readiness.controls", page(body='<div hidden><button></button></div><input name="statement"><a id="top"></a>'), 4),
]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(i, f"https://s{i}.example/x/y", html) for i, (_, html, _) in enumerate(CASES)] + [(len(CASES), None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {(r["page_id"], r["check_id"]): r for r in page_results(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scores(scores, i):
    check, _, want = CASES[i]
    assert scores[i, check]["score"] == want


def test_scores_stay_in_range(scores):
    assert all(0 <= r["score"] <= r["weight"] for r in scores.values())
    assert len(scores) == (len(CASES) + 1) * len(PAGE_CHECKS)


def test_roll_up_rounds_at_each_level(spark):
    rows = [("s", p, "meta.title", "meta", 5, x) for p, x in enumerate([5, 4, 4])] + [("s", 0, "content.headings", "content", 8, 8)]
    checks = check_summary(spark.createDataFrame(rows, "site_id string, page_id long, check_id string, category string, weight int, score int"))
    got = {r["check_id"]: r for r in checks.collect()}
    assert (got["meta.title"]["score"], got["meta.title"]["lost"], got["meta.title"]["failing_pages"], got["meta.title"]["status"]) == (4.3, 0.7, 2, "pass")
    assert {r["category"]: (r["score"], r["max"]) for r in category_summary(checks).collect()} == {"meta": (4.3, 5), "content": (8.0, 8)}
    site = site_summary(checks).first()
    assert (site["total"], site["available"], site["percentage"], site["grade"]) == (12, 13, 92, "Ready for AI")


def test_robots(spark):
    text = "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /a*b$\nAllow: /a\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 7\n"
    bots = spark.createDataFrame([("GPTBot", True), ("Other", False)], "name string, is_major boolean")
    robots = spark.createDataFrame([("s", text)], "site_id string, text string")
    seen = lambda path: {r["name"]: (r["allowed"], r["delay"]) for r in bot_access(robots, bots, path).collect()}
    assert seen("/axb") == {"GPTBot": (False, None), "Other": (False, 7.0)}
    assert seen("/axbc") == {"GPTBot": (True, None), "Other": (False, 7.0)}
    many = spark.createDataFrame([("open", "User-agent: *\nDisallow:"), ("shut", "User-agent: *\nDisallow: /"), ("none", None), ("blank", " ")], "site_id string, text string")
    got = {r["site_id"]: r["score"] for r in bot_crawlability(many, spark.createDataFrame([(b, True) for b in MAJOR_BOTS] + [("X", False)], "name string, is_major boolean")).collect()}
    assert got == {"open": 12, "shut": 0, "none": 8, "blank": 12}


def test_sitemaps_and_exclusion(spark):
    sites = spark.createDataFrame([("a", "Sitemap: /s", "<urlset><loc>x</loc></urlset>"), ("b", None, "<urlset/>"), ("c", "x", None)], "site_id string, robots string, sitemap string")
    assert {r["site_id"]: r["score"] for r in sitemap_score(sites).collect()} == {"a": 5, "b": 0, "c": 0}
    pages = spark.createDataFrame([("s", 1, "/", "noindex"), ("s", 2, "/p.html", "noindex"), ("s", 3, "/q/", "noindex"), ("s", 4, "/r", "googlebot: noindex"), ("t", 5, "/x", "none"), ("u", 6, "/x", "none"), ("u", 7, "/y", "none")], "site_id string, page_id int, url_path string, robots_meta string").withColumn("noindex_for_all", noindex_for_all(F.col("robots_meta")))
    maps = spark.createDataFrame([("s", "<urlset><loc>https://h/q</loc></urlset>")], "site_id string, text string")
    assert {r["page_id"] for r in excluded_pages(pages, maps).collect()} == {2}
