"""Checks of whole sites, from tables of their files and of what they answered: one row per site.

Fetching is no part of this: texts and responses are columns, null where there was none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions.nodes import having, nodes
from pagewarden.functions.text import trimmed, units
from pagewarden.operators.access import bot_access
from pagewarden.sources.site_files import robots_agents, robots_lines


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _first(value: Column) -> Column:
    return F.first(value, ignorenulls=True)


def llms_format(text: Column) -> Column:
    """struct(h1, summary, links, sections) of an llms.txt."""
    line = trimmed(F.regexp_extract(text, r"(?m)^[ \t]*(\S[^\n]*)$", 1))
    return F.struct(
        line.rlike(r"^#\s+\S").alias("h1"),
        text.rlike(r"(?m)^>\s+\S").alias("summary"),
        F.regexp_count(text, F.lit(r"\[[^\]]+\]\([^)]+\)")).alias("links"),
        F.regexp_count(text, F.lit(r"(?m)^##\s+")).alias("sections"),
    )


def llms_txt_score(sites: DataFrame) -> DataFrame:
    """(site_id, h1, links, blocked, score) from (site_id, robots, llms): at most 6.

    An absent file has 0. Robots rules for all crawlers that keep it from being read cost 2.
    """
    any_bot = sites.sparkSession.createDataFrame([("*", False)], "name string, is_major boolean")
    robots = sites.select("site_id", F.col("robots").alias("text")).filter("text is not null")
    blocked = bot_access(robots, any_bot, "/llms.txt").select("site_id", (~F.col("allowed")).alias("blocked"))
    rows = sites.join(blocked, "site_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False))).withColumn("form", llms_format(_text("llms")))
    empty = trimmed(_text("llms")) == ""
    cost = F.when(empty, 3).when(units(trimmed(_text("llms"))) < 50, 1).otherwise(0) + F.when(F.col("blocked"), 2).otherwise(0)
    bonus = F.when(F.col("form.h1") & (F.col("form.links") > 0), 1).otherwise(0)
    score = F.least(F.lit(6), F.greatest(F.lit(0), 5 - cost + bonus))
    return rows.select("site_id", "form.h1", "form.links", "blocked", F.when(F.col("llms").isNull(), 0).otherwise(score).cast("int").alias("score"))


#: What a content signal can speak of.
SIGNALS = ("search", "ai-input", "ai-train")


def content_signal(value: Column, key: str) -> Column:
    """The last 'yes' or 'no' that a list of signals gives for a key, or null."""
    pairs = F.transform(F.split(F.lower(value), ","), lambda p: F.split(p, "="))
    own = F.filter(pairs, lambda p: (F.trim(p[0]) == key) & F.trim(F.get(p, F.lit(1))).isin("yes", "no"))
    return F.when(F.size(own) > 0, F.trim(F.element_at(own, -1)[1]))


def content_signals(sites: DataFrame, bots: DataFrame) -> DataFrame:
    """(site_id, signals, score) from (site_id, robots, header): advice of at most 3; robots rules win over the header.

    1 where there is no signal but robots rules name a crawler of `bots`.
    """
    lines = robots_lines(sites.select("site_id", F.col("robots").alias("text")).filter("text is not null"))
    stated = lines.filter("key = 'content-signal'")
    last = stated.groupBy("site_id").agg(*(F.max_by(content_signal(F.col("value"), k), F.when(content_signal(F.col("value"), k).isNotNull(), F.col("line"))).alias(f"robots_{k}") for k in SIGNALS))
    named = robots_agents(lines).join(F.broadcast(bots.select(F.lower("name").alias("agent"))), "agent", "left_semi").select("site_id").distinct().withColumn("named", F.lit(True))  # crawlers are a short list
    rows = sites.join(last, "site_id", "left").join(named, "site_id", "left")
    values = {k: F.coalesce(F.col(f"`robots_{k}`"), content_signal(F.col("header"), k)) for k in SIGNALS}
    said = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v) for k, v in values.items()))
    return rows.select("site_id", said.alias("signals"), F.when(said != "", 3).when(F.col("named"), 1).otherwise(0).cast("int").alias("score"))


#: Where agents look for what a site offers, by kind; and the property that the file must have.
ARTIFACTS = (
    ("/.well-known/mcp/server-card.json", "mcp", None),
    ("/.well-known/mcp.json", "mcp", None),
    ("/.well-known/agent-card.json", "a2a", "name"),
    ("/.well-known/agent.json", "a2a", "name"),
    ("/.well-known/agent-skills/index.json", "skills", None),
    ("/.well-known/api-catalog", "api", "linkset"),
    ("/.well-known/openapi.json", "api", "openapi"),
    ("/openapi.json", "api", "openapi"),
    ("/.well-known/oauth-authorization-server", "oauth", "issuer"),
    ("/.well-known/oauth-protected-resource", "oauth", "resource"),
    ("/.well-known/ai", "ai", None),
)


def is_html(text: Column, content_type: Column) -> Column:
    return F.coalesce(content_type, F.lit("")).rlike("(?i)text/html|application/xhtml") | F.coalesce(text, F.lit("")).rlike(r"(?i)^\s*<(!doctype|html)")


def artifacts_found(files: DataFrame) -> DataFrame:
    """(site_id, path, kind) of valid agent files among (site_id, path, text, content_type); HTML is none."""
    known = files.sparkSession.createDataFrame([*ARTIFACTS], "path string, kind string, key string")
    rows = files.join(F.broadcast(known), "path").filter(~is_html(F.col("text"), F.col("content_type")))
    data = F.try_parse_json(_text("text"))
    shape = F.coalesce(F.schema_of_variant(data), F.lit(""))
    obj = shape.startswith("OBJECT")
    value = lambda k: F.coalesce(F.try_variant_get(data, f"$.{k}", "string"), F.lit(""))
    true = lambda k: ~value(k).isin("", "false", "0")
    tests = {"name": true("name"), "linkset": true("linkset"), "openapi": true("openapi") | true("swagger"), "issuer": true("issuer"), "resource": true("resource")}
    keyed = F.lit(False)
    for k, test in tests.items():
        keyed = keyed | (obj & (F.col("key") == k) & test)
    listed = (F.col("key") == "linkset") & F.coalesce("content_type", F.lit("")).rlike("(?i)linkset")
    plain = F.when(F.col("kind") == "ai", trimmed(_text("text")) != "").when(F.col("kind") == "skills", obj | shape.startswith("ARRAY")).otherwise(obj)
    return rows.filter(F.coalesce(F.when(F.col("key").isNull(), plain).otherwise(keyed | listed), F.lit(False))).select("site_id", "path", "kind")


#: First path segments of pages on programming interfaces.
API_SEGMENTS = ("api", "apis", "developer", "developers", "docs", "documentation", "graphql", "swagger", "openapi", "api-docs", "api-reference")


def api_evidence() -> Column:
    """Whether a page's links point to a programming interface of its site."""
    host = lambda u: F.regexp_replace(F.lower(F.try_parse_url(u, F.lit("HOST"))), r"^www\.", "")
    own = host(F.col("url"))

    def leads(n: Column) -> Column:
        href = trimmed(F.coalesce(n["attrs"]["href"], F.lit("")))
        there = F.when(href.rlike("(?i)^https?://"), host(href)).when(~href.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|//)"), own)
        same = (there == own) | there.endswith(F.concat(F.lit("."), own)) | own.endswith(F.concat(F.lit("."), there))
        path = F.regexp_replace(href, r"(?i)^https?://[^/?#]*", "")
        segment = F.lower(F.regexp_extract(path, r"^/?([^/?#]+)", 1))
        return F.coalesce(same & (segment.isin(*API_SEGMENTS) | there.rlike(r"^(apis?|developers?|docs)\.")), F.lit(False))

    described = F.size(having("link", also=lambda n: F.coalesce(n["attrs"]["rel"], F.lit("")).rlike(r"(^|\s)(service-desc|describedby)(\s|$)"))) > 0
    return (F.size(having("a", also=leads)) > 0) | described


def protocols_score(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(site_id, kinds, score): 3, 5 or 6 by how many kinds of agent files and tool forms a site has.

    pages have site_id, url, nodes. A site without any has 0 where its pages show a programming
    interface, else null: the check does not apply.
    """
    tools = F.exists(nodes(), lambda n: F.coalesce(n["attrs"]["toolname"], n["attrs"]["tooldescription"]).isNotNull())
    shown = pages.select("site_id", tools.alias("tools"), api_evidence().alias("api")).groupBy("site_id").agg(F.max("tools").alias("tools"), F.max("api").alias("api"))
    kinds = artifacts_found(files).groupBy("site_id").agg(F.count_distinct("kind").alias("kinds"))
    rows = shown.join(kinds, "site_id", "left")
    n = F.coalesce("kinds", F.lit(0)) + F.coalesce(F.col("tools"), F.lit(False)).cast("int")
    score = F.when(n >= 3, 6).when(n == 2, 5).when(n == 1, 3).when(F.col("api"), 0)
    return rows.select("site_id", n.cast("int").alias("kinds"), score.cast("int").alias("score"))


#: Statuses that say nothing about what is there.
UNREACHABLE = (0, 401, 403, 429, 503)


def http_behavior(responses: DataFrame) -> DataFrame:
    """(site_id, unknown, pages_ok, pages_open, score) from (site_id, probe, status, x_robots): at most 3.

    A point for a missing page that answers as one ('unknown' probe: 4xx 1, 2xx 0, else half a point),
    the share of 'page' probes that answer 200, and the share that no header keeps from indexing.
    """
    s = F.coalesce("status", F.lit(0))
    point = F.when(s.isin(*UNREACHABLE) | (s >= 500), 0.5).when((s >= 400) & (s < 500), 1.0).when((s >= 200) & (s < 300), 0.0).otherwise(0.5)
    page = F.col("probe") == "page"
    sums = responses.groupBy("site_id").agg(
        F.max(F.when(F.col("probe") == "unknown", point)).alias("unknown"),
        F.count_if(page).alias("n"),
        F.count_if(page & (s == 200)).alias("ok"),
        F.count_if(page & ~F.coalesce(F.lower("x_robots").rlike(r"(?<![a-z0-9_])(noindex|none)(?![a-z0-9_])"), F.lit(False))).alias("open"),
    )
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    unknown = F.coalesce("unknown", F.lit(0.5))
    return sums.select("site_id", unknown.alias("unknown"), share("ok").alias("pages_ok"), share("open").alias("pages_open"), F.floor(unknown + share("ok") + share("open") + F.lit(1e-9)).cast("int").alias("score"))


def mixed_content() -> Column:
    """How many resources a page loads over plain http."""
    plain = lambda x: F.coalesce(trimmed(x).rlike("(?i)^http://"), F.lit(False))
    loads = having("img", "script", "iframe", "video", "audio", "source", "embed", also=lambda n: plain(n["attrs"]["src"]))
    styles = having("link", also=lambda n: plain(n["attrs"]["href"]) & F.coalesce(n["attrs"]["rel"], F.lit("")).rlike(r"(?i)(^|\s)(stylesheet|icon|preload)(\s|$)"))
    return F.size(loads) + F.size(styles)


def https_score(pages: DataFrame, plain: DataFrame) -> DataFrame:
    """(site_id, secure, mixed_pages, score): at most 2, from (site_id, url, nodes) and (site_id, http_status).

    0 where a page is served over http; half a point off for plain resources, and where http answers
    with a page instead of leading to https. 1 where no page has a scheme.
    """
    url = F.lower(F.col("url"))
    rows = pages.select("site_id", F.when(url.startswith("https:"), True).when(url.startswith("http:"), False).alias("secure"), mixed_content().alias("mixed"))
    sums = rows.groupBy("site_id").agg(F.min("secure").alias("secure"), F.count_if(F.col("mixed") > 0).alias("mixed_pages"))
    joined = sums.join(plain.groupBy("site_id").agg(F.max("http_status").alias("http_status")), "site_id", "left")
    serves = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    score = F.floor(2 - F.when(F.col("mixed_pages") > 0, 0.5).otherwise(0.0) - F.when(serves, 0.5).otherwise(0.0))
    return joined.select("site_id", "secure", "mixed_pages", F.when(F.col("secure").isNull(), 1).when(~F.col("secure"), 0).otherwise(score).cast("int").alias("score"))


def markdown_alternate() -> Column:
    """The href of a page's first alternate in Markdown."""
    links = having("link", also=lambda n: F.coalesce(n["attrs"]["rel"], F.lit("")).rlike(r"(?i)(^|\s)alternate(\s|$)") & F.coalesce(n["attrs"]["type"], F.lit("")).rlike(r"(?i)^text/(x-)?markdown"))
    return F.try_element_at(links, F.lit(1))["attrs"]["href"]


def markdown_score(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """(site_id, page_id, score): 3 for Markdown on request or an advertised one that answers, 1 for an unlinked one.

    pages have site_id, page_id, nodes; responses (site_id, page_id, probe, status, content_type, text)
    of the probes 'negotiated', 'alternate' and 'guessed'. An advertised one that was not asked for counts.
    """
    good = F.col("status").between(200, 299) & ~is_html(F.col("text"), F.col("content_type"))
    marked = good & F.coalesce("content_type", F.lit("")).rlike("(?i)text/(x-)?markdown")
    probe = lambda p, test: _first(F.when(F.col("probe") == p, test)).alias(p)
    asked = responses.groupBy("site_id", "page_id").agg(probe("negotiated", marked), probe("alternate", good), probe("guessed", good))
    rows = pages.select("site_id", "page_id", markdown_alternate().alias("href")).join(asked, ["site_id", "page_id"], "left")
    linked = F.col("href").isNotNull()
    score = F.when(F.col("negotiated"), 3).when(linked & F.coalesce("alternate", F.lit(True)), 3).when(~linked & F.col("guessed"), 1).otherwise(0)
    return rows.select("site_id", "page_id", score.cast("int").alias("score"))

