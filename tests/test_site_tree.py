import pytest

from pagewarden.sources import site_tree as t

SITES = {
    "a": {"index.html": "<link rel=canonical href='https://a.example/x'>", "about.html": "", "blog/index.html": "", "blog/post.html": "", "404.html": "", "node_modules/x.html": "", "_redirects": "/old /about\n/gone /nowhere 302\n/api/* https://api.example/:splat 200\n# none\n/about /moved 301!\n/* /index.html 404\n", "netlify.toml": '[[redirects]]\nfrom = "/t"\nto = "/about"\nstatus = 302\nforce = true\n[[headers]]\nfor = "/x/*"\n[headers.values]\nX-Robots-Tag = "noindex"\n', "sitemap.xml": "<sitemapindex><loc>https://a.example/child.xml</loc></sitemapindex>", "child.xml": "<urlset><loc>https://a.example/About.html</loc></urlset>", "about.md": "# About", ".htaccess": 'Options\nHeader set X-Robots-Tag "noindex, nofollow"\n', "logo.svg": None, ".well-known/a/b.json": "{}"},
    "b": {"package.json": '{"dependencies": {"astro": "1", "next-sitemap": "2"}, "scripts": {"build": "x"}}', "astro.config.mjs": "export default { site: 'https://b.example', integrations: ['@astrojs/sitemap'] }", "vercel.json": '{"redirects": [{"source": "/p", "destination": "/q"}, {"source": "/r", "destination": "/s", "permanent": false}], "rewrites": [{"source": "/(.*)", "destination": "/index.html"}], "headers": [{"source": "/(.*)", "headers": [{"key": "X-A", "value": "1"}]}]}', "src/pages/robots.txt.ts": ""},
    "c": {"wp-config.php": "", "style.css": "/* Theme Name: T */"},
    "d": {"public/index.html": "", "firebase.json": '{"hosting": {"rewrites": [{"source": "**", "destination": "/index.html"}], "redirects": [{"source": "/o", "destination": "/n", "type": 302}]}}', "config.toml": "baseURL = 'https://d.example'", "content/x.md": "", "layouts/x.html": "", "sitemap1.xml": "<urlset></urlset>"},
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(s, p, x, len(x or "")) for s, own in SITES.items() for p, x in own.items()], "site_id string, path string, text string, bytes long").cache()


@pytest.fixture(scope="module")
def roots(files):
    return t.served_roots(files)


@pytest.fixture(scope="module")
def folders(spark):
    return spark.createDataFrame([(s, "", 0) for s in SITES], "site_id string, folder string, priority int")


def got(df, *columns, key="site_id"):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_what_is_served_and_what_made_it(files, roots):
    assert got(roots, "root") == {"a": "", "d": "public"}
    pages = [(r["site_id"], r["file"], r["url_path"]) for r in t.page_list(files, roots).orderBy("site_id", "place").collect()]
    assert pages == [("a", "index.html", "/"), ("a", "about.html", "/about.html"), ("a", "blog/index.html", "/blog/"), ("a", "blog/post.html", "/blog/post.html"), ("d", "public/index.html", "/")]
    stacks = t.stacks(files)
    assert got(stacks, "stack") == {"a": "static-html", "b": "astro", "c": "wordpress", "d": "hugo"}
    assert got(t.modes(stacks, roots, t.page_list(files, roots)), "mode") == {"a": "full", "b": "needs-build", "c": "report-only", "d": "full"}
    assert got(t.hosts(files), "host") == {"a": "netlify", "b": "vercel", "d": "firebase"}
    made = {(r["site_id"], r["made"]): r["source"] for r in t.generators(files, stacks).collect()}
    assert made["b", "robots"] == "src/pages/robots.txt.ts" and made["b", "sitemap"].startswith("@astrojs/sitemap") and made["d", "sitemap"] == "Hugo built-in sitemap" and made["c", "llms"] and ("a", "robots") not in made


def test_redirects(files, roots):
    rules = t.redirect_rules(files)
    own = [(r["from"], r["to"], r["status"], r["force"]) for r in rules.filter("site_id = 'a'").orderBy("rule_no").collect()]
    assert own == [("/old", "/about", 301, False), ("/gone", "/nowhere", 302, False), ("/api/*", "https://api.example/:splat", 200, False), ("/about", "/moved", 301, True), ("/*", "/index.html", 404, False), ("/t", "/about", 302, True)]
    assert {(r["from"], r["status"]) for r in rules.filter("site_id = 'b'").collect()} == {("/p", 308), ("/r", 307), ("/(.*)", 200)}
    assert {(r["from"], r["status"]) for r in rules.filter("site_id = 'd'").collect()} == {("**", 200), ("/o", 302)}
    caught = {r["from"] for r in rules.filter(t.is_catch_all(rules["from"])).collect()}
    assert caught == {"/*", "/(.*)", "**"}
    pages = files.sparkSession.createDataFrame([("a", "/about"), ("a", "/t"), ("a", "/old"), ("a", "/")], "site_id string, url_path string")
    assert {r["url_path"]: (r["status"], r["ok"]) for r in t.predicted_answers(pages, rules, files, roots).collect()} == {"/about": (404, False), "/t": (200, True), "/old": (200, True), "/": (200, True)}
    points = t.unknown_url_points(files, rules, t.stacks(files), t.hosts(files), roots)
    assert got(points, "point", "inconclusive") == {"a": (1.0, False), "b": (0.0, False), "c": (0.5, True), "d": (0.0, False)}
    answers = t.predicted_answers(pages, rules, files, roots)
    noindexed = files.sparkSession.createDataFrame([("a", "/")], "site_id string, url_path string")
    assert got(t.http_behaviour(answers, noindexed, points), "score")["a"] == 1 + 0.75 + 0.75


def test_headers_and_lines(files):
    assert [(r["pattern"], r["name"], r["value"]) for r in t.json_header_rules(files).collect()] == [("/(.*)", "x-a", "1")]
    assert [(r["pattern"], r["name"], r["value"]) for r in t.toml_header_rules(files).collect()] == [("/x/*", "x-robots-tag", "noindex")]
    assert got(t.htaccess_noindex(files), "line", "value") == {"a": (2, "noindex, nofollow")}
    spark = files.sparkSession
    from pyspark.sql import functions as F

    assert spark.range(1).select(t.line_of(F.lit("a\nX-Robots-Tag: b"), F.lit("x-robots-tag"))).first()[0] == 2


def test_sitemaps(files, folders):
    spark = files.sparkSession
    robots = spark.createDataFrame([("a", "Sitemap: https://a.example/child.xml"), ("d", "User-agent: *")], "site_id string, text string")
    found = t.sitemaps(files, folders, robots)
    assert {(r["site_id"], r["path"]) for r in found.collect()} == {("a", "sitemap.xml"), ("a", "child.xml")}
    assert {(r["site_id"], r["key"]) for r in t.sitemap_pages(found.filter("path = 'sitemap.xml'"), files, folders).collect()} == {("a", "/about")}
    assert got(t.scored_sitemap(files, folders, robots), "path", "via") == {"a": ("sitemap.xml", "probe"), "d": ("sitemap1.xml", "probe")}
    origins = spark.createDataFrame([("a", "https://a.example")], "site_id string, origin string")
    responses = spark.createDataFrame([("a", "https://a.example/child.xml", 503, False), ("a", "https://a.example/sitemap.xml", 200, False), ("a", "https://a.example/sitemap_index.xml", None, True)], "site_id string, url string, status int, timed_out boolean")
    assert got(t.unreadable_sitemaps(robots, responses, origins), "label", key="url") == {"https://a.example/child.xml": "answered 503", "https://a.example/sitemap_index.xml": "timed out"}


def test_urls_and_markdown(files, roots):
    from pyspark.sql import functions as F

    spark = files.sparkSession
    urls = ["https://x.example/a#b", "https://x.example/a.PDF?x", "ftp://x.example/", "https://x.example/a.html?x=b.css"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(t.page_url(F.col("u"))).collect()] == ["https://x.example/a", None, None, urls[3]]
    starts = spark.createDataFrame([("s", "https://x/1")], "site_id string, url string")
    links = spark.createDataFrame([("s", f"https://x/{i}", f"https://x/{j}") for i, j in [(1, 2), (2, 3), (3, 1), (2, 4), (9, 5)]], "site_id string, from_url string, to_url string")
    assert {(r["url"][-1], r["depth"]) for r in t.crawled(starts, links).collect()} == {("1", 0), ("2", 1), ("3", 2), ("4", 2)}
    modes = spark.createDataFrame([("https://x/", False), ("https://x/a", False), ("https://x", True), ("https://x", False)], "u string, all boolean")
    assert [r[0] for r in modes.select(t.sample_mode(F.col("u"), F.col("all"))).collect()] == ["sample", "single", "all", "sample"]
    paths = spark.createDataFrame([("/",), ("/a.html",), ("/a.css",), ("/a/",)], "p string").select(t.markdown_paths(F.col("p")))
    assert [r[0] for r in paths.collect()] == [["/index.md"], ["/a.md"], [], ["/a.md", "/a/index.md"]]
    assert {(r["url_path"], r["file"]) for r in t.markdown_files(t.page_list(files, roots), files, roots).collect()} == {("/about.html", "about.md")}
    assert spark.range(1).select(t.link_alternate(F.lit('</a>; rel="next", </a.md>; rel="alternate"; type="text/markdown"'))).first()[0] == "/a.md"
    assert got(t.base_urls(t.page_list(files, roots), files, t.sitemaps(files, spark.createDataFrame([("a", "", 0)], "site_id string, folder string, priority int"), spark.createDataFrame([], "site_id string, text string"))), "base_url") == {"a": "https://a.example", "b": "https://b.example", "d": "https://d.example"}
    assert t.well_known(files).count() == 1 and t.scanned(files).filter("path like 'node%'").count() == 0
    handlers = spark.createDataFrame([("s", "src/app/.well-known/mcp.json/route.ts"), ("s", "public/openapi.json")], "site_id string, path string")
    assert got(t.predicted_artifacts(handlers, ["/.well-known/mcp.json", "/openapi.json", "/x.json"]), "file", key="artifact") == {"/.well-known/mcp.json": "src/app/.well-known/mcp.json/route.ts", "/openapi.json": "public/openapi.json"}
    code = spark.createDataFrame([("s", "m.ts", "if (req.headers.accept.includes('text/markdown'))"), ("s", "n.txt", "accept text/markdown")], "site_id string, path string, text string")
    assert got(t.markdown_negotiation(code), "file") == {"s": "m.ts"}
