import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagewarden.operators.access import page_intents
from pagewarden.operators.checks import resolved
from pagewarden.operators.readiness import ALL_PAGE_CHECKS
from pagewarden.operators.results import decided, page_runs
from pagewarden.operators.site_results import bot_list, crawler_blocks, crawler_rules, evidence, live_http_runs, llms_runs, robots_runs, scheme_votes, signal_runs, sitemap_runs
from pagewarden.plans.scorecard import page_results, with_nodes
from pagewarden.sources.author import author_facts
from pagewarden.sources.html import parse

BASE = "https://a.example:8080/b/c/d?q=1#f"
REFERENCES = ["", "g", "./g", "g/", "/g", "//h/g", "?y", "g?y", "#s", "g#s", "g?y#s", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http://x/y/../z", "mailto:a@b", "a/b/../../c"]


def test_references_resolve_as_rfc_3986_says(spark):
    rows = spark.createDataFrame([(r,) for r in REFERENCES], "r string").select("r", resolved(F.col("r"), F.lit(BASE)).alias("u")).collect()
    want = {r: urljoin(BASE, r) for r in REFERENCES} | {"": BASE.split("#")[0], "#s": BASE.split("#")[0] + "#s", "?y": "https://a.example:8080/b/c/d?y", "http://x/y/../z": "http://x/z"}
    assert {r["r"]: r["u"] for r in rows} == want


NOINDEX = '<html><head><title>T</title><meta name="robots" content="noindex"></head><body><p>x</p></body></html>'
PLAIN = NOINDEX.replace("noindex", "index")


@pytest.fixture(scope="module")
def noindexed(spark):
    rows = [(1, "https://a.example/", NOINDEX), (2, "https://a.example/terms", NOINDEX), (3, "https://a.example/in-map", NOINDEX), (4, "https://a.example/b", PLAIN), (5, "https://one.example/x", NOINDEX), (6, "https://all.example/x", NOINDEX), (7, "https://all.example/y", NOINDEX)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_intentional_noindex_keeps_its_points(spark, noindexed):
    """A homepage, a page in the sitemap and a site's only page do not; pages of a site that hides all do."""
    listed = spark.createDataFrame([("a.example", "/in-map")], "site_id string, key string")
    check = [c for c in ALL_PAGE_CHECKS if c.id == "crawlability.indexability"]
    assert {r["page_id"]: r["score"] for r in page_results(noindexed, check, listed).collect()} == {1: 0, 2: 8, 3: 0, 4: 7, 5: 0, 6: 8, 7: 8}
    paths = noindexed.select(F.regexp_extract("url", "://([^/]*)", 1).alias("site_id"), "page_id", F.regexp_extract("url", "://[^/]*(.*)", 1).alias("url_path"))
    runs = {r["page_id"]: r for r in decided(page_runs(with_nodes(noindexed, author=True), check), page_intents(paths, listed)).collect()}
    assert {i: r["score"] for i, r in runs.items()} == {1: 0, 2: 8, 3: 0, 4: 7, 5: 0, 6: 8, 7: 8}
    assert runs[2]["message"] == "Kept out of search on purpose (noindex, not in the sitemap)" and runs[6]["message"].endswith("(noindex, and the site has no sitemap that lists pages)")
    assert "Homepage has a noindex directive" in runs[1]["message"] and "listed in the sitemap" in runs[3]["message"] and runs[2]["findings"] == []
    assert [(f["message"], f["line"], f["file"]) for f in runs[1]["findings"]][0] == ('<meta name="robots"> blocks indexing (noindex)', 1, "https://a.example/")


def test_findings_have_the_lines_of_the_source(spark):
    html = '<html lang="en">\n<head>\n<title>Short</title>\n</head>\n<body>\n<h1>A</h1>\n<h3>Skips one</h3>\n<img src="a.png">\n</body></html>'
    page = spark.createDataFrame([(1, "https://a.example/p", html)], "page_id long, url string, html string")
    checks = [c for c in ALL_PAGE_CHECKS if c.id in ("meta.title", "content.headings", "content.image-alt", "meta.viewport")]
    got = {r["check_id"]: r for r in page_runs(with_nodes(page, author=True), checks).collect()}
    lines = {i: [(f["line"], f["message"]) for f in r["findings"]] for i, r in got.items()}
    assert lines["meta.title"] == [(3, 'Title too short (5 chars, aim for 50-60): "Short"'), (3, 'Title has no page context (consider "Page Topic | Brand"): "Short"')]
    assert lines["content.headings"] == [(7, "Skipped heading level: H3 after H1")] and lines["content.image-alt"] == [(8, '<img src="a.png"> has no alt attribute')] and lines["meta.viewport"] == [(2, 'Missing <meta name="viewport">')]
    assert got["content.headings"]["details"]["h1"] == "1" and got["content.headings"]["details"]["h3"] == "1"


def test_evidence_states(spark):
    sites = spark.createDataFrame([("read", True), ("shut", True), ("none", True), ("made", False), ("bare", False)], "site_id string, live boolean").withColumn("origin", F.concat(F.lit("https://"), "site_id"))
    found = spark.createDataFrame([("read", "robots", "robots.txt", " "), ("read", "llms", "llms.txt", "# T\n[a](/b)" + " " * 50)], "site_id string, name string, path string, text string")
    answers = spark.createDataFrame([(s, n, 403 if s == "shut" else 404, False) for s in ("shut", "none", "read") for n in ("robots", "llms", "sitemap")], "site_id string, name string, status int, timed_out boolean")
    made = spark.createDataFrame([("made", n, "a generator") for n in ("robots", "llms", "sitemap")], "site_id string, made string, source string")
    known = evidence(sites, found, answers, made)
    scores = lambda runs: {r["site_id"]: (r["score"], r["inconclusive"], r["predicted"]) for r in runs.collect()}
    assert scores(robots_runs(known)) == {"read": (12, False, False), "shut": (6, True, False), "none": (8, False, False), "made": (8, True, False), "bare": (8, False, False)}
    assert scores(llms_runs(known)) == {"read": (6, False, False), "shut": (3, True, False), "none": (0, False, False), "made": (3, True, False), "bare": (0, False, False)}
    headers = sites.select("site_id", F.lit(None).cast("string").alias("header"))
    assert scores(signal_runs(known, headers)) == {"read": (0, False, False), "shut": (2, True, False), "none": (0, False, False), "made": (2, True, False), "bare": (0, False, False)}
    assert scores(sitemap_runs(known)) == {"read": (0, False, False), "shut": (2.5, True, False), "none": (0, False, False), "made": (5, True, True), "bare": (0, False, False)}


def test_crawlers_by_deciding_rule(spark):
    text = "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nAllow: /\nCrawl-delay: 9\n"
    robots = spark.createDataFrame([("s", text)], "site_id string, text string")
    got = {(r["kind"], r["line"]): r for r in crawler_blocks(crawler_rules(robots, bot_list(spark))).collect()}
    assert set(got) == {("rule", 3), ("delay", 5)} and sorted(got["rule", 3]["crawlers"]) == ["CCBot", "GPTBot"] and got["delay", 5]["n"] == bot_list(spark).count() - 2


def test_scheme_is_told_by_weight_of_evidence(spark):
    page = '<html><head><link rel="canonical" href="http://{0}/"></head><body></body></html>'
    names = ["forced", "based", "voted", "hosted", "unknown"]
    pages = spark.createDataFrame([(n, f"x://{n}/", page.format(n) if n != "unknown" else "<p>") for n in names], "page_id string, url string, html string")
    nodes = with_nodes(pages).withColumn("site_id", F.regexp_extract("url", "://([^/]*)", 1))
    sites = spark.createDataFrame([(n, "https://based.example" if n == "based" else None) for n in names], "site_id string, base_url string")
    rules = spark.createDataFrame([("forced", 1, "http://forced/*", "https://forced/:splat", "_redirects", 3)], "site_id string, rule_no long, from string, to string, file string, line int")
    headers = spark.createDataFrame([], "site_id string, name string, source string")
    homes = spark.createDataFrame([("hosted", "netlify", "netlify.toml")], "site_id string, host string, evidence string")
    got = {r["site_id"]: (r["scheme"], r["http_votes"]) for r in scheme_votes(nodes, sites, rules, headers, homes).collect()}
    assert got == {"forced": ("https", 1), "based": ("https", 1), "voted": ("http", 1), "hosted": ("https", 1), "unknown": (None, 0)}


def test_live_answers(spark):
    probes = spark.createDataFrame([("ok", 404), ("soft", 200), ("shut", 503), ("broken", 500)], "site_id string, status int").selectExpr("site_id", "'u' AS url", "status", "false AS timed_out", "cast(null as string) AS final_url")
    pages = spark.createDataFrame([(s, f"{s}/{k}", k) for s in ("ok", "soft", "shut", "broken") for k in (200, 200, 404, 403)], "site_id string, url string, status int").selectExpr("*", "false AS timed_out", "false AS guessed", "case when site_id = 'soft' and status = 200 then 'noindex' end AS x_robots")
    got = {r["site_id"]: (round(r["score"], 3), r["inconclusive"]) for r in live_http_runs(probes, pages).collect()}
    assert got == {"ok": (2.667, False), "soft": (0.667, False), "shut": (2.167, True), "broken": (2.167, True)}


def test_author_scan_is_linear_in_nesting():
    began = time.perf_counter()
    facts = author_facts(parse("<html><body>" + "<div itemprop='author'>" * 30_000 + "By no one, xby Jane Doe, contributor" + "</div>" * 30_000), "https://a.example/")
    assert time.perf_counter() - began < 10 and facts["microdata"]


def test_an_audit_parses_pages_once(spark, monkeypatch):
    from pagewarden.operators.results import RUN
    from pagewarden.plans import queries as Q

    made, none = [], spark.createDataFrame([], "site_id string, page_id long, seq long, check_id string, " + RUN)
    monkeypatch.setattr(Q, "with_nodes", lambda *a, **k: made.append(1) or with_nodes(*a, **k))
    monkeypatch.setattr(Q, "staged", lambda df, name: df)
    monkeypatch.setattr(Q, "_TABLES", {})
    monkeypatch.setattr(Q, "ALL_PAGE_CHECKS", tuple(c for c in ALL_PAGE_CHECKS if c.id == "crawlability.indexability"))
    for own in ("_markdown_runs", "_https_runs", "_protocol_runs", "_http_runs", "evidence_runs"):
        monkeypatch.setattr(Q, own, lambda *a: none)
    Q.audited(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
