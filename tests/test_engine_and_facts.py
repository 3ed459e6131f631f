import json

import pytest

from pagewarden.plans import engine, facts
from pagewarden.plans.scorecard import CHECK_ORDER, with_nodes

RUN = f"site_id string, page_id long, seq long, check_id string, score double, na boolean, inconclusive boolean, predicted boolean, message string, recommendation string, findings array<{engine.FINDING}>, advice array<{engine.FINDING}>"


def run(page, check, score, message="m", rec="", findings=(), na=False, unsure=False, guessed=False, site="s"):
    return (site, page, page or 0, check, score, na, unsure, guessed, message, rec, [(f, f"p{page}.html", 7) for f in findings], None)


@pytest.fixture(scope="module")
def rubric(spark):
    return engine.rubric_table(spark)


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([("s", None), ("r", "report-only")], "site_id string, mode string")


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        run(1, "meta.title", 2.9, "short", "longer", ["A short title"]), run(2, "meta.title", 5.0, "fine"), run(3, "meta.title", 1.0, "long", "", ["A long title"]), run(4, "meta.title", 1.0, "long", "cut it", ["A long title"]), run(5, "meta.title", 0.0, "gone", "", ["None"]),
        run(1, "content.freshness", 5.0, "fresh"), run(5, "content.freshness", 0.0, "old", "", ["No date"]),
        run(1, "meta.viewport", 99.0, "wide"), run(1, "structured-data.present", None, "none", unsure=True), run(2, "structured-data.present", 12.0, "some", unsure=True, guessed=True),
        run(None, "agent-readiness.protocols", 0.0, "does not apply", na=True), run(None, "ai-access.content-signals", 1.0, "weak", "say more", ["No signal"]), run(1, "meta.title", 3.0, site="r"),
    ]
    return spark.createDataFrame(rows, RUN)


@pytest.fixture(scope="module")
def excluded(spark):
    return spark.createDataFrame([("s", 5)], "site_id string, page_id long")


def test_states_and_totals(runs, rubric, excluded, sites):
    states = engine.check_states(runs, rubric, excluded, sites)
    assert states.count() == 2 * len(CHECK_ORDER)
    got = {r["check_id"]: r for r in states.filter("site_id = 's'").collect()}
    t = got["meta.title"]
    assert (t["score"], t["status"], t["lost"], t["message"], t["recommendation"], t["pages"], t["failing_pages"], t["excluded_pages"]) == (2.3, "fail", 2.7, "long", "longer", 4, 3, 1)
    assert got["content.freshness"]["status"] == "pass" and got["meta.viewport"]["score"] == 3.0 and got["meta.language"]["status"] == "skipped"
    s = got["structured-data.present"]
    assert (s["score"], s["status"], s["inconclusive"], s["predicted"]) == (6.0, "warning", True, True)
    assert got["agent-readiness.protocols"]["status"] == "na" and got["ai-access.content-signals"]["status"] == "advice" and got["ai-access.content-signals"]["lost"] == 0
    assert {r["status"] for r in states.filter("site_id = 'r'").collect()} == {"skipped"}
    total = {r["site_id"]: r for r in engine.site_totals(states).collect()}
    assert (total["s"]["total"], total["s"]["available"], total["s"]["na_weight"], total["s"]["skipped_weight"]) == (16, 28, 6, 99) and total["r"]["available"] == 0 and total["r"]["skipped_weight"] == 133
    cats = {r["category"]: (r["score"], r["max"], r["skipped"]) for r in engine.category_totals(states).filter("site_id = 's'").collect()}
    assert cats["meta"] == (5.3, 8, 14) and cats["agent-readiness"] == (0.0, 0, 19)


def test_findings_and_reports(spark, runs, rubric, excluded, sites):
    found = engine.finding_groups(runs, rubric, excluded)
    got = {(r["check_id"], r["message"]): (r["advice"], r["place"], r["n_locations"], r["locations"]) for r in found.collect()}
    assert got["meta.title", "A short title"] == (False, 1, 1, ["p1.html:7"]) and got["meta.title", "A long title"] == (False, 2, 2, ["p3.html:7", "p4.html:7"])
    assert got["content.freshness", "Page kept out of search: No date"][0] and got["ai-access.content-signals", "No signal"][0] and ("meta.title", "None") not in got
    states = engine.check_states(runs, rubric, excluded, sites)
    summary = {r["site_id"]: r["summary"] for r in engine.console_summaries(states).collect()}["s"].split("\n")
    assert summary[0] == "Score 16/28 (57%, Not AEO Ready)" and summary[1] == "- Structured Data: -9 (auto-fix)" and summary[-1] == "Advice, no points: Content Signals"
    notes = spark.createDataFrame([("s", "A note")], "site_id string, note string")
    report = {r["site_id"]: r["report"] for r in engine.reports(states, found, notes).collect()}
    assert "> A note" in report["s"] and "### FAIL Meta Title - 2.3 / 5 (-2.7)" in report["s"] and "- A long title - `p3.html:7`, `p4.html:7`" in report["s"] and "- Pages losing points: 3 of 4" in report["s"] and "| Agent readiness | not evaluated |" in report["s"]
    assert "No score" in report["r"] and report["s"].index("Structured Data -") < report["s"].index("Meta Title -")
    data = {r["site_id"]: json.loads(r["payload"]) for r in engine.payloads(states, found).collect()}["s"]
    assert data["total"] == 16 and len(data["checks"]) == 26 and data["checks"][9]["findings"][0]["message"] == "A short title"
    fixes = engine.fix_lists(sites, rubric).collect()
    assert [r["site_id"] for r in fixes] == ["r"] and "### Structured data (20 pts)" in fixes[0]["report"]


def test_rubric(spark, rubric):
    assert {r["category"]: r["max"] for r in engine.rubric_totals(rubric).collect()} == {None: 133, "ai-access": 18, "crawlability": 18, "structured-data": 20, "meta": 22, "content": 36, "agent-readiness": 19}
    order = spark.createDataFrame([(c,) for c in CHECK_ORDER], "check_id string")
    categories = spark.createDataFrame([(c,) for c, _ in engine.CATEGORIES], "category string")
    assert engine.rubric_faults(rubric, order, categories).count() == 0
    bad = rubric.union(spark.createDataFrame([("x.y", "n", 0, "never", False, False, "x", 99)], rubric.schema)).union(rubric.filter("ord = 0")).filter("ord <> 3")
    assert {(r["check_id"], r["fault"]) for r in engine.rubric_faults(bad, order, categories).collect()} == {("ai-access.bot-crawlability", "repeated"), ("crawlability.indexability", "no such check"), ("x.y", "not in the order"), ("x.y", "no such category"), ("x.y", "weight or fix out of range")}


@pytest.fixture(scope="module")
def pages(spark):
    html = '<html lang="en">\n<head><title>{t} | Acme</title>\n<meta name="description" content="{d}"></head><body><h1>{t}</h1><main><p>short one</p><p>one two three four five six seven eight nine</p></main><a href="https://github.com/acme">g</a><a href="/x">x</a><img src="a.png"></body></html>'
    rows = [(0, "https://acme.example/", html.format(t="Home [x]", d="")), (1, "https://acme.example/blog/a", html.format(t="Post", d="word " * 60)), (2, "https://acme.example/privacy", html.format(t="Private", d="p")), (3, "https://acme.example/about", html.format(t="About", d="q"))]
    return with_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_facts_and_drafts(spark, pages):
    own = facts.page_facts(pages)
    got = {r["page_id"]: r for r in own.collect()}
    assert got[1]["first_paragraph"] == "one two three four five six seven eight nine" and got[1]["h1"] == ["Post"] and got[1]["words"] == 11 and got[1]["title_line"] == 2 and got[1]["head_line"] == 2 and got[1]["head_last_line"] == 3
    assert got[0]["social_links"] == ["https://github.com/acme"] and [i["src"] for i in got[0]["images_without_alt"]] == ["a.png"] and got[0]["lang"] == "en"
    base = spark.createDataFrame([("acme.example", "https://acme.example")], "site_id string, base_url string")
    brand = facts.brands(own, base)
    assert [r["brand"] for r in brand.collect()] == ["Acme"]
    llms = facts.llms_drafts(own, brand, base).first()["llms"]
    lines = llms.split("\n")
    assert lines[0] == "# Acme" and lines[2] == "> one two three four five six seven eight nine"
    assert "- [Post](https://acme.example/blog/a): word" in llms and llms.index("## Pages") < llms.index("## Blog") < llms.index("## Optional") and all(len(x) < 230 for x in lines)
    files = spark.createDataFrame([("acme.example", "images/logo.png"), ("acme.example", "logo.webp")], "site_id string, path string")
    folders = spark.createDataFrame([("acme.example", "", 0)], "site_id string, folder string, priority int")
    logo = facts.logos(files, folders)
    assert logo.first()["url_path"] == "/logo.webp"
    assert json.loads(facts.facts_payloads(own, brand, logo).filter("page_id = 1").first()["payload"])["brand"] == "Acme"
    assert facts.social_profiles(own).count() == 1


def test_texts(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(facts.shortened(F.lit("one two, three"), 9), facts.title_case(F.lit("my-first_pOst")), facts.without_brand(F.lit("A page - Acme"), F.lit("Acme")), facts.without_brand(F.lit("Acme"), F.lit("Acme")), engine.escaped(F.lit("a|b\nc"))).first()
    assert list(r) == ["one two...", "My First POst", "A page", "Acme", "a\\|b c"]
