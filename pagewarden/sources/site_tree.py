"""Sites as tables of files: what is served, what builds it, and what its host is told to do.

files: site_id, path (from the site's root, '/' between folders), text (null for what is no text), bytes.
Rules over file names are small constants, matched with `isin` or a pattern per row; what a site has is
then an aggregate per site (the first by priority), so nothing but one row per site is shuffled late.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.operators.access import path_key
from pagewarden.sources.site_files import robots_lines, sitemap_locs

#: Folders that are not read, the size and depth of what is, and pages to a site.
SKIPPED = ("node_modules", ".git", ".hg", ".svn", "vendor", "bower_components", ".cache", ".next", ".astro", ".vercel", ".netlify", ".wrangler", "coverage", ".idea", ".vscode")
MAX_BYTES, MAX_DEPTH, MAX_PAGES = 2 << 20, 12, 500
#: Folders that are served, by priority.
SERVED = ("", "public", "site", "www", "docs", "dist", "build", "src", "html", "_site")
#: Sitemap names that are tried, for reading and for scoring.
SITEMAPS = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap-0.xml", "wp-sitemap.xml")
PROBED = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap1.xml")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def scanned(files: DataFrame) -> DataFrame:
    """Files that are read: not below skipped or hidden folders (.well-known aside), at most 12 folders deep, at most 2 MiB."""
    folders = F.split(_parent(F.col("path")), "/")
    barred = F.exists(folders, lambda d: d.isin(*SKIPPED) | (d.startswith(".") & (d != ".well-known")))
    return files.filter(~barred & (F.size(folders) <= MAX_DEPTH) & (F.coalesce(F.col("bytes"), F.lit(0)) <= MAX_BYTES))


def served_roots(files: DataFrame) -> DataFrame:
    """(site_id, root): the folder served at '/': of those with an index page the first conventional one, else the shallowest."""
    index = scanned(files).filter(F.col("path").rlike(r"(?i)(^|/)index\.html?$")).select("site_id", _parent(F.col("path")).alias("root"), F.col("path").rlike(r"(^|/)index\.html$").alias("plain"))
    at = F.array_position(F.array(*(F.lit(d) for d in SERVED)), F.col("root"))
    rank = F.when(F.col("plain") & (at > 0), at).otherwise(F.lit(100) + F.when(F.col("root") == "", 0).otherwise(_depth(F.col("root"))))
    kept = index.filter((_depth(F.col("root")) <= 5) | (at > 0))
    return kept.groupBy("site_id").agg(F.min(F.struct(rank.alias("rank"), "root"))["root"].alias("root"))


def url_path_of(file: Column) -> Column:
    """The path that a file is served at: an index page is its folder."""
    return F.regexp_replace(F.concat(F.lit("/"), file), r"(?i)/index\.html?$", "/")


def page_list(files: DataFrame, roots: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """(site_id, file, url_path, place, pages): pages below the root by depth, index pages first, then by name; error pages aside."""
    rows = scanned(files).join(roots, "site_id").filter(F.col("path").rlike(r"(?i)\.html?$"))
    inside = F.when(F.col("root") == "", F.col("path")).when(F.col("path").startswith(F.concat("root", F.lit("/"))), F.expr("substring(path, length(root) + 2)"))
    rows = rows.withColumn("own", inside).filter(F.col("own").isNotNull() & ~F.col("own").rlike(r"(?i)^(404|500|50x)\.html?$"))
    order = [_depth(F.col("own")), ~F.col("own").rlike(r"(?i)(^|/)index\.html?$"), F.col("own")]
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(*order))
    sizes = rows.groupBy("site_id").agg(F.count("*").alias("pages"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).join(sizes, "site_id").select("site_id", F.col("path").alias("file"), url_path_of(F.col("own")).alias("url_path"), "place", "pages")


def root_files(files: DataFrame, folders: DataFrame, names: Iterable[str]) -> DataFrame:
    """(site_id, name, path, text): each named file from the first of a site's folders (site_id, folder, priority) that has it."""
    wanted = folders.select("site_id", "folder", "priority", F.explode(F.array(*(F.lit(n) for n in names))).alias("name"))
    wanted = wanted.withColumn("path", F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name")))
    met = wanted.join(files.select("site_id", "path", "text"), ["site_id", "path"])
    return met.groupBy("site_id", "name").agg(F.min(F.struct("priority", "path", "text")).alias("f")).select("site_id", "name", "f.path", "f.text")


def well_known(files: DataFrame, depth: int = 3) -> DataFrame:
    """Files below .well-known, at most `depth` folders down."""
    return files.filter(F.col("path").startswith(".well-known/") & (_depth(F.col("path")) <= depth + 1))


def _first_of(files: DataFrame, rules: list[tuple[str, str]], name: str) -> DataFrame:
    """(site_id, <name>, evidence): the first rule (value, path) whose file a site has."""
    paths = F.array(*(F.lit(p) for _, p in rules))
    at = F.array_position(paths, F.col("path"))
    best = files.filter(at > 0).groupBy("site_id").agg(F.min(at).cast("int").alias("at"))
    return best.select("site_id", F.get(F.array(*(F.lit(v) for v, _ in rules)), F.col("at") - 1).alias(name), F.get(paths, F.col("at") - 1).alias("evidence"))


def packages(files: DataFrame) -> DataFrame:
    """(site_id, deps, builds): names of all packages, and whether there is a build script, by package.json."""
    form = "dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>, engines map<string,string>"
    j = F.from_json("text", form)
    keys = lambda c: F.coalesce(F.map_keys(j[c]), F.array().cast("array<string>"))
    ghost = F.when(F.array_contains(keys("engines"), "ghost"), F.array(F.lit("ghost"))).otherwise(F.array().cast("array<string>"))
    return files.filter("path = 'package.json'").select("site_id", F.array_distinct(F.concat(keys("dependencies"), keys("devDependencies"), ghost)).alias("deps"), F.coalesce(j["scripts"]["build"], F.lit("")).alias("build"))


#: Stacks by priority: files, packages, and where they build to.
STACKS = (
    ("wordpress", ("wp-config.php", "wp-config-sample.php", "wp-content", "wp-includes"), (), ()),
    ("other-cms", (), ("ghost",), ()),
    ("nextjs", ("next.config.js", "next.config.mjs", "next.config.ts", "next.config.cjs"), ("next",), ("out", ".next/server/app", ".next/server/pages")),
    ("astro", ("astro.config.mjs", "astro.config.js", "astro.config.ts", "astro.config.mts"), ("astro",), ("dist",)),
    ("hugo", ("hugo.toml", "hugo.yaml", "hugo.yml", "hugo.json"), (), ("public",)),
    ("eleventy", (".eleventy.js", "eleventy.config.js", "eleventy.config.mjs", "eleventy.config.cjs"), ("@11ty/eleventy",), ("_site",)),
    ("vite-spa", ("vite.config.js", "vite.config.mjs", "vite.config.ts", "vite.config.mts"), ("vite",), ("dist",)),
)


def stacks(files: DataFrame) -> DataFrame:
    """(site_id, stack, evidence, outputs): what a site is made with, by its files and packages; else static HTML."""
    facts, path, text = [], F.col("path"), F.coalesce(F.col("text"), F.lit(""))
    top = F.split(path, "/")[0]
    for k, (_, names, _, _) in enumerate(STACKS):
        for j, n in enumerate(names):
            facts.append(F.when((top == n) if "." not in n else (path == n), F.struct(F.lit(k).alias("k"), F.lit(j).alias("j"), F.lit(n).alias("evidence"))))
    extra = [
        (0, (path == "style.css") & text.rlike("(?i)Theme Name:"), "WordPress theme files"),
        (1, (path == "composer.json") & text.rlike(r"(?i)drupal/core|craftcms/cms|statamic/cms|joomla"), "database-backed CMS"),
    ]
    facts += [F.when(test, F.struct(F.lit(k).alias("k"), F.lit(90).alias("j"), F.lit(said).alias("evidence"))) for k, test, said in extra]
    own = files.select("site_id", F.explode(F.array_compact(F.array(*facts))).alias("f")).select("site_id", "f.*")
    made = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(80).alias("j"), F.lit(d).alias("dep")) for k, (_, _, deps, _) in enumerate(STACKS) for d in deps))
    by_package = packages(files).select("site_id", F.explode(F.filter(made, lambda m: F.array_contains(F.col("deps"), m["dep"]))).alias("m")).select("site_id", "m.k", "m.j", F.concat(F.col("m.dep"), F.lit(" in package.json")).alias("evidence"))
    folders = files.groupBy("site_id").agg(
        F.bool_or(path.isin("config.toml", "config.yaml", "config.yml")).alias("config"), F.bool_or(top.isin("layouts", "themes") & (path != top)).alias("themed"), F.bool_or((top == "content") & (path != top)).alias("content"),
        F.bool_or(path == "functions.php").alias("functions"), F.bool_or(path == "index.php").alias("php"),
    )
    hugo = folders.filter("config and themed and content").select("site_id", F.lit(4).alias("k"), F.lit(91).alias("j"), F.lit("config + content/").alias("evidence"))
    theme = folders.filter("functions and php").select("site_id", F.lit(0).alias("k"), F.lit(92).alias("j"), F.lit("WordPress theme files").alias("evidence"))
    best = own.union(by_package).union(hugo).union(theme).groupBy("site_id").agg(F.min(F.struct("k", "j", "evidence")).alias("f"))
    names, outs = F.array(*(F.lit(s[0]) for s in STACKS)), F.array(*(F.array(*(F.lit(o) for o in s[3])).cast("array<string>") for s in STACKS))
    rows = files.select("site_id").distinct().join(best, "site_id", "left")
    return rows.select("site_id", F.coalesce(F.get(names, F.col("f.k")), F.lit("static-html")).alias("stack"), F.coalesce("f.evidence", F.lit("plain HTML files")).alias("evidence"), F.coalesce(F.get(outs, F.col("f.k")), F.array().cast("array<string>")).alias("outputs"))


def modes(site_stacks: DataFrame, roots: DataFrame, pages: DataFrame) -> DataFrame:
    """(site_id, mode): report-only for databases, needs-build where a build's output is missing, no-pages, or full."""
    has = pages.select("site_id").distinct().withColumn("paged", F.lit(True))
    rows = site_stacks.join(roots, "site_id", "left").join(has, "site_id", "left")
    mode = F.when(F.col("stack").isin("wordpress", "other-cms"), "report-only").when(F.col("paged"), "full").when((F.size("outputs") > 0) & F.col("root").isNull(), "needs-build").otherwise("no-pages")
    return rows.select("site_id", mode.alias("mode"))


#: Hosts by the files that configure them.
HOSTS = [("netlify", "netlify.toml"), ("vercel", "vercel.json"), ("cloudflare", "wrangler.toml"), ("cloudflare", "wrangler.json"), ("cloudflare", "wrangler.jsonc"), ("firebase", "firebase.json"), ("github-pages", "CNAME"), ("github-pages", ".github/workflows/pages.yml"), ("netlify-or-cloudflare", "_headers"), ("netlify-or-cloudflare", "_redirects")]


def hosts(files: DataFrame) -> DataFrame:
    """(site_id, host, evidence), of sites whose files name one."""
    return _first_of(files, HOSTS, "host")


_JS = ("ts", "js", "mjs")
#: Files that make robots.txt, llms.txt or a sitemap at build time, and packages that do.
GENERATORS = {
    "robots": ([*(f"src/pages/robots.txt.{e}" for e in _JS), "app/robots.ts", "app/robots.js", "src/app/robots.ts", "src/app/robots.js", "app/robots.txt", "src/app/robots.txt", "robots.njk", "src/robots.njk", "robots.11ty.js", "src/robots.11ty.js"], ("astro-robots-txt", "next-sitemap")),
    "llms": ([*(f"src/pages/llms.txt.{e}" for e in _JS), *(f"{d}app/llms.txt/route.{e}" for d in ("", "src/") for e in ("ts", "js")), "layouts/index.llms.txt", "llms.txt.njk", "src/llms.txt.njk", "llms.txt.11ty.js", "src/llms.txt.11ty.js"], ()),
    "sitemap": ([*(f"{d}app/sitemap.{e}" for d in ("", "src/") for e in ("ts", "js", "xml")), *(f"{d}pages/sitemap.xml.{e}" for d in ("", "src/") for e in ("ts", "js")), "sitemap.njk", "sitemap.xml.njk", "src/sitemap.njk", "src/sitemap.xml.njk", "sitemap.liquid", "src/sitemap.liquid", "sitemap.11ty.js", "src/sitemap.11ty.js"], ("next-sitemap", "@quasibit/eleventy-plugin-sitemap", "vite-plugin-sitemap")),
}


def generators(files: DataFrame, site_stacks: DataFrame) -> DataFrame:
    """(site_id, made, source): which of robots, llms and sitemap a build would make, and by what."""
    out = None
    own = packages(files)
    for made, (paths, deps) in GENERATORS.items():
        by_file = _first_of(files, [(p, p) for p in paths], "source").select("site_id", F.lit(1).alias("rank"), "source")
        known = F.filter("deps", lambda d: d.rlike("(?i)llms")) if made == "llms" else F.array_intersect(F.array(*(F.lit(d) for d in deps)), "deps")
        by_package = own.select("site_id", F.lit(3).alias("rank"), F.concat(F.get(known, F.lit(0)), F.lit(" in package.json")).alias("source")).filter("source is not null")
        rows = by_file.union(by_package)
        config = files.filter(F.col("path").isin("hugo.toml", "hugo.yaml", "hugo.yml", "hugo.json", "config.toml", "config.yaml", "config.yml"))
        if made == "robots":
            rows = rows.union(config.filter(F.col("text").rlike(r"(?i)enableRobotsTXT\s*[=:]\s*true")).join(site_stacks.filter("stack = 'hugo'"), "site_id").select("site_id", F.lit(2), F.concat(F.lit("enableRobotsTXT in "), "path")))
        if made == "sitemap":
            barred = config.filter(F.col("text").rlike(r"(?i)disableKinds[^\n\]]*sitemap")).select("site_id").distinct()
            rows = rows.union(site_stacks.filter("stack = 'wordpress'").select("site_id", F.lit(0), F.lit("WordPress core sitemap")))
            rows = rows.union(site_stacks.filter("stack = 'hugo'").join(barred, "site_id", "left_anti").select("site_id", F.lit(0), F.lit("Hugo built-in sitemap")))
            astro = files.filter(F.col("path").rlike(r"^astro\.config\.m?[jt]s$") & F.col("text").rlike("@astrojs/sitemap") & F.col("text").rlike(r"(?<![A-Za-z0-9_])site\s*:"))
            rows = rows.union(astro.join(site_stacks.filter("stack = 'astro'").select("site_id"), "site_id").select("site_id", F.lit(0), F.concat(F.lit("@astrojs/sitemap in "), "path")))
        else:
            rows = rows.union(site_stacks.filter("stack in ('wordpress', 'other-cms')").select("site_id", F.lit(0), F.concat("stack", F.lit(" makes it"))))
        best = rows.groupBy("site_id").agg(F.min(F.struct("rank", "source"))["source"].alias("source")).select("site_id", F.lit(made).alias("made"), "source")
        out = best if out is None else out.union(best)
    return out


def json_header_rules(files: DataFrame) -> DataFrame:
    """(site_id, rule_no, pattern, name, value, source): header rules of vercel.json."""
    form = "headers array<struct<source:string,headers:array<struct<key:string,value:string>>>>"
    rows = files.filter("path = 'vercel.json'").select("site_id", F.posexplode(F.from_json("text", form)["headers"]).alias("rule_no", "r"))
    return rows.select("site_id", "rule_no", F.col("r.source").alias("pattern"), F.explode("r.headers").alias("h")).select("site_id", "rule_no", "pattern", F.lower("h.key").alias("name"), F.col("h.value").alias("value"), F.lit("vercel.json").alias("source"))


def toml_header_rules(files: DataFrame) -> DataFrame:
    """The same of netlify.toml: [[headers]] blocks with a path and a table of values."""
    rows = files.filter("path = 'netlify.toml'").select("site_id", F.posexplode(F.split("text", r"\[\[headers\]\]")).alias("rule_no", "block")).filter("rule_no > 0")
    rows = rows.select("site_id", "rule_no", F.regexp_extract("block", r'for\s*=\s*"([^"]+)"', 1).alias("pattern"), F.regexp_extract("block", r"(?s)\[headers\.values\](.*?)(?:\n\[|$)", 1).alias("values")).filter("pattern <> ''")
    lines = rows.select("site_id", "rule_no", "pattern", F.explode(F.split("values", "\n")).alias("line"))
    form = r'^\s*"?([A-Za-z0-9_-]+)"?\s*=\s*"(.*)"\s*$'
    return lines.filter(F.col("line").rlike(form)).select("site_id", "rule_no", "pattern", F.lower(F.regexp_extract("line", form, 1)).alias("name"), F.regexp_extract("line", form, 2).alias("value"), F.lit("netlify.toml").alias("source"))


def redirect_rules(files: DataFrame) -> DataFrame:
    """(site_id, rule_no, from, to, status, force, file, line): from _redirects, netlify.toml, vercel.json and firebase.json, in that order."""
    lines = files.filter(F.col("path").rlike(r"(^|/)_redirects$")).select("site_id", "path", F.posexplode(F.split("text", r"\r?\n")).alias("no", "raw"))
    parts = F.split(F.trim(F.regexp_replace("raw", r"#.*$", "")), r"\s+")
    lines = lines.withColumn("p", parts).filter(F.size("p") >= 2)
    code = F.try_element_at(F.filter(F.slice("p", 3, F.greatest(F.size("p"), F.lit(1))), lambda x: x.rlike(r"^\d{3}!?$")), F.lit(1))
    plain = lines.select("site_id", F.lit(0).alias("kind"), F.col("no").cast("long").alias("no"), F.col("p")[0].alias("from"), F.col("p")[1].alias("to"), F.coalesce(F.substring(code, 1, 3).try_cast("int"), F.lit(301)).alias("status"), F.coalesce(code.endswith("!"), F.lit(False)).alias("force"), F.col("path").alias("file"), (F.col("no") + 1).alias("line"))

    blocks = files.filter("path = 'netlify.toml'").select("site_id", "path", F.posexplode(F.split("text", r"(?m)^\s*\[\[redirects\]\]")).alias("no", "raw")).filter("no > 0")
    body = F.regexp_replace(F.split("raw", r"(?m)^\s*\[")[0], r"(?m)#.*$", "")
    value = lambda k: F.nullif(F.trim(F.regexp_extract(body, rf'(?m)^\s*{k}\s*=\s*"?([^"\n]*)"?', 1)), F.lit(""))
    toml = blocks.select("site_id", F.lit(1), F.col("no").cast("long"), value("from"), value("to"), F.coalesce(value("status").try_cast("int"), F.lit(301)), F.coalesce(value("force") == "true", F.lit(False)), "path", F.lit(None).cast("int"))

    form = "rewrites array<struct<source:string,destination:string>>, redirects array<struct<source:string,destination:string,permanent:boolean,statusCode:int>>, routes array<struct<src:string,dest:string,status:int>>"
    v = files.filter("path = 'vercel.json'").select("site_id", "path", F.from_json("text", form).alias("j"))
    none = F.lit(None).cast("int")

    def of(rows: DataFrame, kind: int, list_: Column, source: str, target: str, status: Column, force: bool) -> DataFrame:
        rows = rows.select("site_id", "path", F.posexplode(list_).alias("no", "r"))
        return rows.select("site_id", F.lit(kind), F.col("no").cast("long"), F.col(f"r.{source}"), F.col(f"r.{target}"), status, F.lit(force), "path", none)

    moved = F.coalesce(F.col("r.statusCode"), F.when(~F.col("r.permanent"), F.lit(307)).otherwise(F.lit(308)))
    out = plain.union(toml).union(of(v, 2, F.col("j.rewrites"), "source", "destination", F.lit(200), False)).union(of(v, 3, F.col("j.redirects"), "source", "destination", moved, True)).union(of(v, 4, F.col("j.routes"), "src", "dest", F.coalesce("r.status", F.lit(200)), False))
    one = "rewrites:array<struct<source:string,destination:string>>,redirects:array<struct<source:string,destination:string,type:int>>"
    fire = files.filter("path = 'firebase.json'").select("site_id", "path", F.coalesce(F.from_json("text", f"hosting array<struct<{one}>>")["hosting"], F.array(F.from_json("text", f"hosting struct<{one}>")["hosting"])).alias("hosting"))
    fire = fire.select("site_id", "path", F.explode("hosting").alias("h"))
    out = out.union(of(fire, 5, F.col("h.rewrites"), "source", "destination", F.lit(200), False)).union(of(fire, 6, F.col("h.redirects"), "source", "destination", F.coalesce("r.type", F.lit(301)), True))
    out = out.filter("`from` is not null and `to` is not null and `from` <> '' and `to` <> ''")
    number = F.row_number().over(Window.partitionBy("site_id").orderBy("kind", "file", "no"))
    return out.select("site_id", number.cast("long").alias("rule_no"), "from", "to", "status", "force", "file", "line")


def is_catch_all(source: Column) -> Column:
    """Whether a rule's source is every path."""
    return F.trim(source).rlike(r"^(/?\*\*?|/\*\*/\*|/:[A-Za-z0-9_]+\*{1,2}|/\(\.\*\)|/\.\*)$")


def rule_regex(source: Column) -> Column:
    """The pattern of a redirect rule: stars, (.*) and :name* stand for anything, :name for one segment; a last slash may be added."""
    bare = F.regexp_replace(source, r"^https?://[^/]+", "")
    bare = F.regexp_replace(bare, r"\(\.\*\)|:[A-Za-z0-9_]+\*|\*+", "\u0001")
    bare = F.regexp_replace(bare, r":[A-Za-z0-9_]+", "\u0002")
    bare = F.regexp_replace(bare, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(bare, F.lit("\u0001"), F.lit(".*")), F.lit("\u0002"), F.lit("[^/]+")), F.lit("/?$"))


def local_files(targets: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """targets (site_id, target) with the file that each is served from, or null: as it is, with .html, or its index page."""
    bare = F.coalesce(F.try_url_decode(F.regexp_replace("target", "[?#].*$", "")), F.col("target"))
    p = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    tries = F.when(p.endswith("/"), F.array(F.concat(p, F.lit("index.html")), F.concat(p, F.lit("index.htm")))).otherwise(F.array(p, F.concat(p, F.lit(".html")), F.concat(p, F.lit("/index.html"))))
    rows = targets.select("site_id", "target").distinct()
    at = rows.select("site_id", "target", F.posexplode(tries).alias("nth", "own")).join(roots, "site_id")
    at = at.withColumn("path", F.when(F.col("root") == "", F.expr("substring(own, 2)")).otherwise(F.concat("root", "own")))
    best = at.join(files.select("site_id", "path"), ["site_id", "path"]).groupBy("site_id", "target").agg(F.min(F.struct("nth", "path"))["path"].alias("file"))
    return rows.join(best, ["site_id", "target"], "left")


def predicted_answers(pages: DataFrame, rules: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(site_id, url_path, status, ok): what a host would answer for each page, by the first rule that holds.

    Rewrites change no status of a page that is there, and unforced rules of _redirects and netlify.toml
    yield to its file. A redirect within the site is fine if its target has a file.
    """
    firm = rules.filter(~F.col("from").rlike("(?i)^https?://") & (F.col("status") != 200) & (F.col("force") | ~F.col("file").rlike(r"_redirects$|^netlify\.toml$")))
    met = pages.select("site_id", "url_path").join(firm.withColumn("re", rule_regex(F.col("from"))), "site_id").filter(F.expr("url_path rlike re"))
    first = met.groupBy("site_id", "url_path").agg(F.min(F.struct("rule_no", "status", "to")).alias("r")).select("site_id", "url_path", "r.status", "r.to")
    first = first.withColumn("target", F.regexp_replace("to", r":splat|:[A-Za-z0-9_]+|\*", ""))
    away = F.col("to").rlike("(?i)^https?://")
    inside = first.filter((F.col("status") < 400) & (F.col("status") >= 300) & ~away)
    there = local_files(inside, files, roots).withColumnRenamed("file", "target_file")
    rows = pages.select("site_id", "url_path").join(first, ["site_id", "url_path"], "left").join(there, ["site_id", "target"], "left")
    away = F.coalesce(away, F.lit(False))
    status = F.when(F.col("status").isNull(), F.lit(200)).when((F.col("status") >= 400) | away, F.col("status")).when(F.col("target_file").isNotNull(), F.lit(200)).otherwise(F.lit(404))
    return rows.select("site_id", "url_path", status.alias("status"), (status < 400).alias("ok"))


#: Sources of a page for unknown URLs, and hosts that answer them with 404 by themselves.
NOT_FOUND = (
    "src/pages/404.astro", "src/pages/404.md", "src/pages/404.mdx", "src/pages/404.html", "layouts/404.html", "app/not-found.tsx", "app/not-found.jsx", "app/not-found.js", "src/app/not-found.tsx", "src/app/not-found.jsx", "src/app/not-found.js",
    "pages/404.tsx", "pages/404.jsx", "pages/404.js", "src/pages/404.tsx", "src/pages/404.jsx", "src/pages/404.js", "public/404.html", "static/404.html", "404.md", "404.njk", "404.liquid", "src/404.md", "src/404.njk", "src/404.liquid", "404.html",
)
HOSTS_WITH_404 = ("netlify", "vercel", "github-pages", "firebase")


def unknown_url_points(files: DataFrame, rules: DataFrame, site_stacks: DataFrame, site_hosts: DataFrame, roots: DataFrame) -> DataFrame:
    """(site_id, point, inconclusive): what unknown URLs would get: 1 a 404, 0 a page, 0.5 not to be told.

    The first catch-all rule that keeps no part of the path decides; else a page for it, the framework, the host.
    """
    caught = rules.filter(is_catch_all(F.col("from")) & ~F.col("to").rlike(r":splat|\$1|:path|:slug")).groupBy("site_id").agg(F.min(F.struct("rule_no", "status"))["status"].alias("caught"))
    own = files.join(roots, "site_id", "left").filter(F.col("path").isin(*NOT_FOUND) | (F.col("path") == F.concat_ws("/", F.nullif("root", F.lit("")), F.lit("404.html")))).select("site_id").distinct().withColumn("paged", F.lit(True))
    rows = site_stacks.select("site_id", "stack").join(caught, "site_id", "left").join(own, "site_id", "left").join(site_hosts.select("site_id", "host"), "site_id", "left")
    point = F.when(F.col("caught").isin(404, 410), 1.0).when(F.col("caught").isNotNull(), 0.0).when(F.col("paged"), 1.0).when(F.col("stack") == "nextjs", 1.0).when(F.col("host").isin(*HOSTS_WITH_404), 1.0).otherwise(0.5)
    return rows.select("site_id", point.alias("point"), (point == 0.5).alias("inconclusive"))


def htaccess_noindex(files: DataFrame) -> DataFrame:
    """(site_id, file, line, value): the first line of an .htaccess that keeps pages out of search."""
    rows = files.filter(F.col("path").rlike(r"(^|/)\.htaccess$")).select("site_id", "path", F.posexplode(F.split("text", r"\r?\n")).alias("no", "raw"))
    value = F.trim(F.regexp_extract("raw", r'(?i)^\s*Header\s+(?:always\s+)?(?:set|add|append)\s+X-Robots-Tag\s+"?([^"\n]+)"?', 1))
    rows = rows.withColumn("value", value).filter(F.col("value").rlike(r"(?i)(?<![A-Za-z0-9_])(noindex|none)(?![A-Za-z0-9_])"))
    return rows.groupBy("site_id").agg(F.min(F.struct(_depth(F.col("path")).alias("d"), "path", "no", "value")).alias("f")).select("site_id", F.col("f.path").alias("file"), (F.col("f.no") + 1).alias("line"), "f.value")


def http_behaviour(answers: DataFrame, noindexed: DataFrame, unknown: DataFrame) -> DataFrame:
    """(site_id, score, inconclusive), at most 3: unknown URLs, the share of pages that answer, the share not kept out by a header.

    answers: predicted_answers; noindexed: (site_id, url_path) of pages whose headers say noindex.
    """
    marked = noindexed.select("site_id", "url_path").distinct().withColumn("out", F.lit(True))
    shares = answers.join(marked, ["site_id", "url_path"], "left").groupBy("site_id").agg((F.count_if("ok") / F.count("*")).alias("fine"), (F.count_if(F.col("out").isNull()) / F.count("*")).alias("open"))
    return unknown.join(shares, "site_id", "left").select("site_id", (F.col("point") + F.coalesce("fine", F.lit(1.0)) + F.coalesce("open", F.lit(1.0))).alias("score"), "inconclusive")


def declared_sitemaps(robots: DataFrame) -> DataFrame:
    """(site_id, url): Sitemap lines of robots files (site_id, text)."""
    return robots_lines(robots).filter("key = 'sitemap'").select("site_id", F.col("value").alias("url"))


def _path_in_url(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.regexp_replace(url, "[?#].*$", "")), "^/", "")


def sitemaps(files: DataFrame, folders: DataFrame, robots: DataFrame) -> DataFrame:
    """(site_id, path, text, rank): sitemaps of conventional names, then those that robots files declare; each file once."""
    usual = root_files(files, folders, SITEMAPS).select("site_id", "path", "text", F.array_position(F.array(*(F.lit(n) for n in SITEMAPS)), F.col("name")).alias("rank"))
    named = declared_sitemaps(robots).select("site_id", _path_in_url(F.col("url")).alias("name"))
    tries = named.join(folders, "site_id").withColumn("path", F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name")))
    said = tries.join(files.select("site_id", "path", "text"), ["site_id", "path"]).select("site_id", "path", "text", F.lit(100).cast("long").alias("rank"))
    return usual.union(said).groupBy("site_id", "path").agg(F.min("text").alias("text"), F.min("rank").alias("rank"))


def sitemap_pages(found: DataFrame, files: DataFrame, folders: DataFrame, rounds: int = 10) -> DataFrame:
    """(site_id, key): keys of all page paths in the sitemaps; indexes are followed to their children, each file once."""
    seen, new, out = found.select("site_id", "path", "text"), found.select("site_id", "path", "text"), None
    for _ in range(rounds):
        locs = sitemap_locs(new)
        pages = locs.filter("not is_index").select("site_id", path_key(F.concat(F.lit("/"), _path_in_url(F.col("url")))).alias("key"))
        out = pages if out is None else out.union(pages)
        children = locs.filter("is_index").select("site_id", _path_in_url(F.col("url")).alias("name")).distinct().join(folders, "site_id")
        children = children.withColumn("path", F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name")))
        new = children.join(files.select("site_id", "path", "text"), ["site_id", "path"]).select("site_id", "path", "text").distinct().join(seen.select("site_id", "path"), ["site_id", "path"], "left_anti")
        if new.isEmpty():
            break
        seen = seen.union(new)
    return out.distinct()


def scored_sitemap(files: DataFrame, folders: DataFrame, robots: DataFrame) -> DataFrame:
    """(site_id, path, text, via): the sitemap that a site is scored by: the first probed name, else the first declared one."""
    probed = root_files(files, folders, PROBED).select("site_id", "path", "text", F.array_position(F.array(*(F.lit(n) for n in PROBED)), F.col("name")).alias("rank"), F.lit("probe").alias("via"))
    others = sitemaps(files, folders, robots).select("site_id", "path", "text", (F.col("rank") + 1000).alias("rank"), F.lit("robots").alias("via"))
    return probed.union(others.filter("rank >= 1100")).groupBy("site_id").agg(F.min(F.struct("rank", "path", "text", "via")).alias("f")).select("site_id", "f.path", "f.text", "f.via")


def unreadable_sitemaps(robots: DataFrame, responses: DataFrame, origins: DataFrame) -> DataFrame:
    """(site_id, url, label): declared and conventional sitemaps of a site's own origin that could not be read.

    responses: site_id, url, status, timed_out. origins: site_id, origin.
    """
    usual = origins.select("site_id", F.explode(F.array(*(F.concat("origin", F.lit(n)) for n in ("/sitemap.xml", "/sitemap_index.xml")))).alias("url"))
    urls = declared_sitemaps(robots).union(usual).distinct().join(origins, "site_id").filter(F.col("url").startswith(F.concat("origin", F.lit("/"))))
    return urls.join(responses, ["site_id", "url"]).filter(unreachable(F.col("status"), F.col("timed_out"))).select("site_id", "url", unreachable_label(F.col("status"), F.col("timed_out")).alias("label"))


#: Statuses that say nothing about a resource.
UNREACHABLE = (0, 401, 403, 429, 503)


def unreachable(status: Column, timed_out: Column) -> Column:
    """Whether a response says nothing about the resource: none, a timeout, or one of a few statuses."""
    return status.isNull() | F.coalesce(timed_out, F.lit(False)) | status.isin(*UNREACHABLE)


def unreachable_label(status: Column, timed_out: Column) -> Column:
    return F.when(F.coalesce(timed_out, F.lit(False)), "timed out").when(status.isNull() | (status == 0), "could not be reached").otherwise(F.concat(F.lit("answered "), status))


#: Names of files that are no pages.
ASSETS = "pdf|jpe?g|png|gif|webp|svg|ico|zip|gz|mp4|mp3|webm|css|js|json|xml|txt|woff2?"


def page_url(url: Column) -> Column:
    """An absolute URL without its fragment, or null if it is no page: another scheme, or the name of an asset."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(bare.rlike("(?i)^https?://") & ~bare.rlike(rf"(?i)^[^?]*\.({ASSETS})(\?|$)"), bare)


def crawled(starts: DataFrame, links: DataFrame, most: int = MAX_PAGES, rounds: int = 20) -> DataFrame:
    """(site_id, url, depth): pages reached from starts (site_id, url) over links (site_id, from_url, to_url), the nearest first, at most `most` a site."""
    seen = starts.select("site_id", page_url(F.col("url")).alias("url")).filter("url is not null").distinct().withColumn("depth", F.lit(0))
    edge, hops = seen, links.select("site_id", F.col("from_url").alias("url"), page_url(F.col("to_url")).alias("to")).filter("to is not null").distinct()
    for depth in range(1, rounds + 1):
        new = edge.join(hops, ["site_id", "url"]).select("site_id", F.col("to").alias("url")).distinct().join(seen, ["site_id", "url"], "left_anti").withColumn("depth", F.lit(depth))
        if new.isEmpty():
            break
        edge, seen = new, seen.union(new)
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("depth", "url"))
    return seen.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def sample_mode(start: Column, all_: Column) -> Column:
    """Which pages of a live site are read: all, a sample from its homepage, or the one that was named."""
    return F.when(all_, "all").when(start.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([?#]|$)"), "sample").otherwise("single")


def base_urls(pages: DataFrame, files: DataFrame, maps: DataFrame) -> DataFrame:
    """(site_id, base_url): from the first page's canonical link or og:url, a sitemap's first URL, CNAME, or the site's configuration."""
    origin = lambda u: F.nullif(F.regexp_extract(u, r"(?i)^(https?://[^/?#\s]+)", 1), F.lit(""))
    html = F.coalesce(F.col("text"), F.lit(""))
    home = pages.filter("place = 1").join(files.withColumnRenamed("path", "file"), ["site_id", "file"])
    tag = F.coalesce(F.nullif(F.regexp_extract(html, r"""(?i)<link[^>]+rel=["']?canonical["']?[^>]*href=["']([^"']+)""", 1), F.lit("")), F.regexp_extract(html, r"""(?i)<meta[^>]+property=["']og:url["'][^>]*content=["']([^"']+)""", 1))
    first = home.select("site_id", F.lit(0).alias("rank"), origin(tag).alias("u"))
    second = maps.select("site_id", F.lit(1) + F.col("rank"), origin(F.regexp_extract("text", r"(?i)<loc>\s*([^<\s]+)", 1)))
    named = files.filter(F.col("path").rlike("(^|/)CNAME$")).select("site_id", F.lit(10_000).cast("long"), F.concat(F.lit("https://"), F.nullif(F.regexp_extract("text", r"^\s*(\S+)", 1), F.lit(""))))
    setting = F.when(F.col("path").isin("hugo.toml", "config.toml"), F.regexp_extract(html, r"""(?i)baseURL\s*=\s*["']([^"']+)""", 1)).when(F.col("path").rlike(r"^astro\.config\.m?[jt]s$"), F.regexp_extract(html, r"""site:\s*["']([^"']+)""", 1))
    configured = files.select("site_id", F.lit(20_000).cast("long"), origin(setting))
    rows = first.union(second).union(named).union(configured).filter("u is not null")
    return rows.groupBy("site_id").agg(F.min(F.struct("rank", "u"))["u"].alias("base_url"))


def markdown_paths(path: Column) -> Column:
    """Where a page's Markdown may be: its folder's index, its name with .md, or both; none for other files."""
    last = F.regexp_extract(path, "[^/]*$", 0)
    bare = F.regexp_replace(path, "/+$", "")
    return (
        F.when(path == "/", F.array(F.lit("/index.md")))
        .when(path.rlike(r"(?i)\.html?$"), F.array(F.regexp_replace(path, r"(?i)\.html?$", ".md")))
        .when(last.contains("."), F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(bare, F.lit(".md")), F.concat(bare, F.lit("/index.md"))))
    )


def markdown_files(pages: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(site_id, url_path, file): pages whose Markdown stands beside them; HTML under such a name is none."""
    rows = pages.select("site_id", "url_path", F.posexplode(markdown_paths(F.col("url_path"))).alias("nth", "own")).join(roots, "site_id")
    rows = rows.withColumn("path", F.when(F.col("root") == "", F.expr("substring(own, 2)")).otherwise(F.concat("root", "own")))
    kept = files.filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"(?i)^\s*<(!doctype|html)"))
    return rows.join(kept.select("site_id", "path"), ["site_id", "path"]).groupBy("site_id", "url_path").agg(F.min(F.struct("nth", "path"))["path"].alias("file"))


def markdown_negotiation(files: DataFrame) -> DataFrame:
    """(site_id, file): the first code or configuration file that speaks of both text/markdown and the Accept header."""
    code = files.filter(F.col("path").rlike(r"\.(?:[cm]?[jt]sx?|toml|json|conf|py|rb|php|go)$|(^|/)(_headers|_redirects|\.htaccess)$"))
    both = code.filter(F.col("text").rlike("(?i)text/markdown") & F.col("text").rlike("(?i)(?<![A-Za-z])accept(?![A-Za-z])"))
    return both.groupBy("site_id").agg(F.min("path").alias("file"))


def link_alternate(header: Column) -> Column:
    """The Markdown alternate that a Link header names, or null; each of its links is judged by itself."""
    links = F.split(header, r",\s*(?=<)")
    fit = F.filter(links, lambda x: x.rlike(r"(?i)rel\s*=\s*\"?[^\";]*alternate") & x.rlike("(?i)type\\s*=\\s*\"?text/markdown"))
    return F.nullif(F.regexp_extract(F.get(fit, F.lit(0)), "<([^>]*)>", 1), F.lit(""))


def route_handlers(artifact: Column) -> Column:
    """Source files that would serve an artifact, in the frameworks that route by files."""
    ends = ("ts", "js")
    bare = F.regexp_replace(artifact, "^/", "")
    app = [F.concat(F.lit(f"{d}app/"), bare, F.lit(f"/route.{e}")) for d in ("", "src/") for e in ends]
    return F.array(*app, *(F.concat(F.lit(f"{d}pages/"), bare, F.lit(f".{e}")) for d in ("", "src/") for e in ends), F.concat(F.lit("public/"), bare), F.concat(F.lit("static/"), bare))


def predicted_artifacts(files: DataFrame, artifacts: Iterable[str]) -> DataFrame:
    """(site_id, artifact, file): artifacts that a source file would serve."""
    wanted = files.select("site_id").distinct().select("site_id", F.explode(F.array(*(F.lit(a) for a in artifacts))).alias("artifact"))
    wanted = wanted.select("site_id", "artifact", F.posexplode(route_handlers(F.col("artifact"))).alias("nth", "path"))
    return wanted.join(files.select("site_id", "path"), ["site_id", "path"]).groupBy("site_id", "artifact").agg(F.min(F.struct("nth", "path"))["path"].alias("file"))


def line_of(text: Column, needle: Column) -> Column:
    """The first line, from 1, that has the needle in any case, or null."""
    lines = F.transform(F.split(F.lower(text), "\n"), lambda x: F.contains(x, F.lower(needle)))
    return F.nullif(F.array_position(lines, True), F.lit(0))
