from pagewarden.operators.site_checks import artifacts_found, content_signals, http_behavior, https_score, llms_txt_score, markdown_score, protocols_score
from pagewarden.plans.scorecard import with_nodes


def by_site(df, *names):
    return {r["site_id"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_llms_txt(spark):
    full = "# Site\n\n> What it is about\n\n## Pages\n- [A page](https://x.example/a): of the site"
    rows = [("absent", None, None), ("full", None, full), ("blank", None, " \n"), ("short", "User-agent: *\nDisallow:", "no head"), ("blocked", "User-agent: *\nDisallow: /llms.txt", full)]
    out = llms_txt_score(spark.createDataFrame(rows, "site_id string, robots string, llms string"))
    assert by_site(out, "score") == {"absent": 0, "full": 6, "blank": 2, "short": 4, "blocked": 4}


def test_content_signals(spark):
    rows = [
        ("robots", "User-agent: *\nContent-Signal: search=yes, ai-train=no\nContent-Signal: ai-train=yes, other=no", "search=no, ai-input=no"),
        ("header", None, "AI-Train=NO"),
        ("named", "User-agent: gptbot\nDisallow: /", None),
        ("none", "User-agent: *\nDisallow:", "search=maybe"),
    ]
    bots = spark.createDataFrame([("GPTBot",)], "name string")
    out = by_site(content_signals(spark.createDataFrame(rows, "site_id string, robots string, header string"), bots), "signals", "score")
    assert out == {"robots": ("search=yes, ai-input=no, ai-train=yes", 3), "header": ("ai-train=no", 3), "named": ("", 1), "none": ("", 0)}


def test_protocols(spark):
    files = [
        ("three", "/.well-known/mcp.json", "{}", None),
        ("three", "/.well-known/agent.json", '{"name": "x"}', None),
        ("three", "/openapi.json", '{"swagger": "2.0"}', None),
        ("three", "/.well-known/openapi.json", '{"openapi": "3.0"}', None),
        ("html", "/.well-known/ai", "<!DOCTYPE html>", None),
        ("html", "/.well-known/agent.json", '{"name": ""}', None),
        ("one", "/.well-known/api-catalog", "x", "application/linkset+json"),
        ("other", "/.well-known/none.json", "{}", None),
        ("html", "/.well-known/oauth-protected-resource", None, None),
    ]
    files = spark.createDataFrame(files, "site_id string, path string, text string, content_type string")
    assert {(r["site_id"], r["kind"]) for r in artifacts_found(files).collect()} == {("three", "mcp"), ("three", "a2a"), ("three", "api"), ("one", "api")}
    pages = [("three", 1, ""), ("one", 2, "<form toolname=x></form>"), ("html", 3, '<a href="/docs/x">d</a>'), ("other", 4, '<a href="https://docs.else.example/">d</a>')]
    pages = with_nodes(spark.createDataFrame([(i, f"https://{s}/", h) for s, i, h in pages], "page_id long, url string, html string"))
    assert by_site(protocols_score(files, pages), "kinds", "score") == {"three": (3, 6), "one": (2, 5), "html": (0, 0), "other": (0, None)}


def test_http_behavior(spark):
    rows = [("good", "unknown", 404, None), ("good", "page", 200, None), ("soft", "unknown", 200, None), ("soft", "page", 200, "googlebot: noindex"), ("down", "unknown", None, None), ("down", "page", 503, None)]
    out = http_behavior(spark.createDataFrame(rows, "site_id string, probe string, status int, x_robots string"))
    assert by_site(out, "score") == {"good": 3, "soft": 1, "down": 1}


def test_https(spark):
    rows = [(1, "https://a.example/", ""), (2, "http://b.example/", ""), (3, "https://c.example/", '<img src="http://x.example/i.png">'), (4, "https://d.example/", '<a href="http://x.example/">x</a>')]
    pages = with_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    plain = spark.createDataFrame([("c.example", 301), ("d.example", 200)], "site_id string, http_status int")
    assert by_site(https_score(pages, plain), "mixed_pages", "score") == {"a.example": (0, 2), "b.example": (0, 0), "c.example": (1, 1), "d.example": (0, 1)}


def test_markdown(spark):
    link = '<link rel="alternate" type="text/markdown" href="/a.md">'
    pages = with_nodes(spark.createDataFrame([(1, "https://a/", ""), (2, "https://b/", link), (3, "https://c/", link), (4, "https://d/", ""), (5, "https://e/", "")], "page_id long, url string, html string"))
    answers = [("a", 1, "negotiated", 200, "text/markdown", "# x"), ("c", 3, "alternate", 404, "text/plain", ""), ("d", 4, "guessed", 200, "text/plain", "# x"), ("e", 5, "negotiated", 200, "text/html", "<html>")]
    answers = spark.createDataFrame(answers, "site_id string, page_id long, probe string, status int, content_type string, text string")
    assert by_site(markdown_score(pages, answers), "score") == {"a": 3, "b": 3, "c": 0, "d": 1, "e": 0}
