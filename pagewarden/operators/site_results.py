"""Results of checks of whole sites: scores with what they rest on, in words.

What a site's robots.txt, llms.txt or sitemap says may be known from a file or a response (read), may be
out of reach (unreadable), may be made only when the site is built (generated), or may not be there
(absent). `evidence` joins files, responses and generators into one state per site and name; scores that
rest on a state other than read and absent are inconclusive. Runs have the columns that plans.engine
takes. Everything is one row per site, from joins on the site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions.nodes import first, having
from pagewarden.functions.text import rounded, trimmed, units
from pagewarden.operators.access import BOTS, CAP, MAJOR_BOTS, MAJOR_POINTS, MAX_DELAY, WEIGHT, path_key
from pagewarden.operators.results import either, joined, plural, say
from pagewarden.operators.site_checks import SIGNALS, content_signal, llms_format
from pagewarden.sources.site_files import crawl_delays, pattern_regex, robots_agents, robots_lines, robots_rules
from pagewarden.sources.site_tree import unreachable

FINDINGS = "array<struct<message:string,file:string,line:int>>"
READ, UNREADABLE, GENERATED, ABSENT = "read", "unreadable", "generated", "absent"


def response_label(status: Column, timed_out: Column) -> Column:
    return F.when(F.coalesce(timed_out, F.lit(False)), "timeout").when(status.isNull(), "not fetched").otherwise(say("HTTP ", status))


def evidence(sites: DataFrame, found: DataFrame, responses: DataFrame, generated: DataFrame, names: tuple[str, ...] = ("robots", "llms", "sitemap")) -> DataFrame:
    """(site_id, name, state, live, origin, path, text, label, source) per site and name.

    sites: site_id, live, origin; found: site_id, name, path, text; responses: site_id, name, status,
    timed_out, of live sites; generated: site_id, made, source, of sites known by their files. A text that
    was read decides; else a live site's response, or what a build would make.
    """
    rows = sites.select("site_id", "live", "origin", F.explode(F.array(*(F.lit(n) for n in names))).alias("name"))
    rows = rows.join(found.select("site_id", "name", "path", "text"), ["site_id", "name"], "left").join(responses.select("site_id", "name", "status", "timed_out"), ["site_id", "name"], "left")
    rows = rows.join(generated.select("site_id", F.col("made").alias("name"), "source"), ["site_id", "name"], "left")
    lost = F.coalesce(unreachable(F.col("status"), F.col("timed_out")), F.lit(True))
    state = F.when(F.col("text").isNotNull(), READ).when(F.col("live"), F.when(lost, UNREADABLE).otherwise(ABSENT)).when(F.col("source").isNotNull(), GENERATED).otherwise(ABSENT)
    return rows.select("site_id", "name", state.alias("state"), "live", "origin", "path", "text", response_label(F.col("status"), F.col("timed_out")).alias("label"), "source")


def of(rows: DataFrame, name: str, *keep: str) -> DataFrame:
    """The evidence of one name, its columns after it (`robots_state`, ...)."""
    own = rows.filter(F.col("name") == name)
    return own.select("site_id", *keep, *(F.col(c).alias(f"{name}_{c}") for c in ("state", "path", "text", "label", "source")))


def _one(message: Column | str, file: Column, line: Column | int | None = None) -> Column:
    at = line if isinstance(line, Column) else F.lit(line)
    return F.struct((F.lit(message) if isinstance(message, str) else message).alias("message"), file.cast("string").alias("file"), at.cast("int").alias("line"))


def _list(*items: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(t, x) for t, x in items))).cast(FINDINGS)


def _none() -> Column:
    return F.array().cast(FINDINGS)


def run(rows: DataFrame, check_id: str, score: Column, message: Column, findings: Column | None = None, recommendation: Column | None = None, inconclusive: Column | None = None, predicted: Column | None = None, na: Column | None = None, advice: Column | None = None, details: dict[str, Column] | None = None, page: bool = False) -> DataFrame:
    """Rows as runs of one check."""
    no, details = F.lit(False), details or {}
    told = F.map_from_arrays(F.array(*(F.lit(k) for k in details)), F.array(*(v.cast("string") for v in details.values()))) if details else F.create_map().cast("map<string,string>")
    flag = lambda c, name: F.coalesce(c if c is not None else no, no).alias(name)
    page_id = F.col("page_id") if page else F.lit(None)
    return rows.select(
        "site_id", page_id.cast("long").alias("page_id"), F.coalesce(page_id.cast("long"), F.lit(0)).cast("long").alias("seq"), F.lit(check_id).alias("check_id"), score.cast("double").alias("score"), flag(na, "na"), flag(inconclusive, "inconclusive"), flag(predicted, "predicted"),
        F.coalesce(message, F.lit("")).alias("message"), F.coalesce(recommendation if recommendation is not None else F.lit(""), F.lit("")).alias("recommendation"), F.coalesce(findings if findings is not None else _none(), _none()).alias("findings"), F.coalesce(advice if advice is not None else _none(), _none()).alias("advice"), told.alias("details"),
    )


#: Crawlers that a finding names, before it counts the rest.
NAMED = 5


def crawler_rules(robots: DataFrame, bots: DataFrame, path: str = "/") -> DataFrame:
    """(site_id, name, at, is_major, allowed, rule, rule_line, delay, delay_line): what decides for each crawler, with its line.

    The longest matching rule of a crawler's groups decides; of equal length the last allowing one, else
    the first. A delay's line is where its group begins. at: the crawler's place in the list.
    """
    lines = robots_lines(robots)
    begins = lines.filter("key = 'user-agent'").groupBy("site_id", "group").agg(F.min("line").alias("group_line"))
    matched = robots_rules(lines).filter(F.regexp_like(F.lit(path), pattern_regex(F.col("path"))))
    rank = F.struct(F.length(F.regexp_replace("path", r"\$$", "")).alias("n"), F.col("allow").cast("int").alias("allow"), F.when(F.col("allow"), F.col("line")).otherwise(-F.col("line")).alias("turn"), "line", F.col("path").alias("rule"))
    best = matched.groupBy("site_id", "group").agg(F.max(rank).alias("best"))
    slow = crawl_delays(lines).join(begins, ["site_id", "group"]).select("site_id", "group", F.struct("delay", (-F.col("group_line")).alias("less"), F.col("group_line").alias("line")).alias("slow"))
    groups = robots_agents(lines).join(best, ["site_id", "group"], "left").join(slow, ["site_id", "group"], "left")
    by_agent = groups.groupBy("site_id", "agent").agg(F.max("best").alias("best"), F.max("slow").alias("slow"))
    own = by_agent.filter("agent <> '*'").withColumn("has", F.lit(True))
    any_ = by_agent.filter("agent = '*'").select("site_id", F.col("best").alias("any_best"), F.col("slow").alias("any_slow"))
    pairs = robots.select("site_id").distinct().join(F.broadcast(bots.withColumn("agent", F.lower("name"))))  # crawlers are a short list
    rows = pairs.join(own, ["site_id", "agent"], "left").join(any_, "site_id", "left")
    rule, delay = F.when(F.col("has"), F.col("best")).otherwise(F.col("any_best")), F.when(F.col("has"), F.col("slow")).otherwise(F.col("any_slow"))
    return rows.select("site_id", "name", "at", "is_major", F.coalesce(rule["allow"] == 1, F.lit(True)).alias("allowed"), rule["rule"].alias("rule"), rule["line"].alias("rule_line"), delay["delay"].alias("delay"), delay["line"].alias("delay_line"))


def crawler_blocks(rules: DataFrame) -> DataFrame:
    """(site_id, kind, line, rule, delay, crawlers, n): crawlers kept out by each rule, and slowed by each group's delay, in the order of the list."""
    slow = F.col("allowed") & (F.col("delay") > MAX_DELAY)
    rows = rules.filter(~F.col("allowed") | slow).withColumn("kind", F.when(~F.col("allowed"), "rule").otherwise("delay"))
    rows = rows.select("site_id", "kind", F.when(F.col("kind") == "rule", F.col("rule_line")).otherwise(F.col("delay_line")).alias("line"), F.when(F.col("kind") == "rule", F.col("rule")).alias("rule"), F.when(F.col("kind") == "delay", F.col("delay")).alias("delay"), "at", "name")
    named = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])  # the list of crawlers bounds it
    return rows.groupBy("site_id", "kind", "line", "rule", "delay").agg(named.alias("crawlers"), F.count("*").alias("n"), F.min("at").alias("first"))


def bot_list(spark) -> DataFrame:
    return spark.createDataFrame([(b, k, b in MAJOR_BOTS) for k, b in enumerate(BOTS)], "name string, at int, is_major boolean")


def _origin_file(name: str) -> Column:
    return F.concat(F.col("origin"), F.lit(name))


def robots_runs(rows: DataFrame) -> DataFrame:
    """Runs of ai-access.bot-crawlability, at most 12: 6 if robots.txt is out of reach, 8 if it is made by a build or not there."""
    own = of(rows, "robots", "live", "origin")
    read = own.filter(F.col("robots_state") == READ)
    rules = crawler_rules(read.filter(trimmed(F.col("robots_text")) != "").select("site_id", F.col("robots_text").alias("text")), bot_list(rows.sparkSession))
    blocks = crawler_blocks(rules)
    cut = lambda names, n: say(F.array_join(F.slice(names, 1, NAMED), ", "), either(n > NAMED, say(" and ", n - NAMED, " more")))
    said = F.when(F.col("kind") == "rule", say('"Disallow: ', F.col("rule"), '" blocks AI crawlers from /: ', cut(F.col("crawlers"), F.col("n")))).otherwise(say("Crawl-delay ", F.regexp_replace(F.col("delay").cast("string"), r"\.0$", ""), f"s (over {MAX_DELAY}s) slows AI crawlers: ", cut(F.col("crawlers"), F.col("n"))))
    found = blocks.select("site_id", F.struct((F.col("kind") == "delay").alias("late"), "first", "line", said.alias("message")).alias("f"))
    found = found.groupBy("site_id").agg(F.array_sort(F.collect_list("f")).alias("blocks"))  # at most one for each crawler
    counts = rules.groupBy("site_id").agg(
        F.count("*").alias("n"), F.count_if("allowed").alias("allowed"), F.count_if("is_major").alias("major"), F.count_if(F.col("is_major") & F.col("allowed")).alias("major_allowed"), F.count_if(F.col("allowed") & (F.col("delay") > MAX_DELAY)).alias("slowed"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("is_major") & ~F.col("allowed"), F.struct("at", "name")))), lambda x: x["name"]).alias("major_blocked"),
    )
    own = own.join(counts, "site_id", "left").join(found, "site_id", "left")
    other = (F.col("allowed") - F.col("major_allowed")) / F.nullif(F.col("n") - F.col("major"), F.lit(0))
    raw = rounded(MAJOR_POINTS * F.col("major_allowed") / F.col("major") + (WEIGHT - MAJOR_POINTS) * F.coalesce(other, F.lit(1.0)))
    capped = F.when(F.col("major_allowed") < F.col("major"), F.least(raw, F.lit(CAP))).otherwise(raw)
    judged = F.when(F.col("slowed") > 0, F.greatest(F.lit(0), capped - 2)).otherwise(capped)
    state, label, live = F.col("robots_state"), F.col("robots_label"), F.col("live")
    blank = (state == READ) & F.col("n").isNull()
    score = F.when(state == UNREADABLE, WEIGHT / 2).when(state != READ, 8).when(blank, WEIGHT).otherwise(judged)
    named = F.coalesce("major_blocked", F.array().cast("array<string>"))
    message = (
        F.when(state == UNREADABLE, say("robots.txt could not be read (", label, ")"))
        .when(state == GENERATED, "robots.txt is generated, rules could not be read from the repo")
        .when(state == ABSENT, "robots.txt not found - all bots allowed by default")
        .when(blank, "Empty robots.txt - all AI bots allowed")
        .otherwise(say(F.col("allowed"), "/", F.col("n"), " AI bots can access /", either(F.size(named) > 0, say(", including blocked major bots: ", F.array_join(named, ", "))), either(F.col("slowed") > 0, say(" (", F.col("slowed"), f" with crawl-delay > {MAX_DELAY}s)"))))
    )
    file = _origin_file("/robots.txt")
    gone = F.when(live, _one(say("No robots.txt (", either(label == "HTTP 200", "the URL returns an HTML page", label), ")"), file)).otherwise(_one("No robots.txt in the served root", F.lit(None)))
    findings = F.coalesce(
        F.when(state == UNREADABLE, F.array(_one(say("Fetching /robots.txt answered ", label, ", so the rules for AI crawlers are unknown"), file))),
        F.when(state == ABSENT, F.array(gone)),
        F.transform("blocks", lambda b: _one(b["message"], F.col("robots_path"), b["line"])),
        _none(),
    )
    fixes = joined([(F.col("allowed") < F.col("n"), say("Remove the Disallow rules that block AI crawlers in ", F.col("robots_path"), ' (or give them their own "Allow: /" group)')), (F.col("slowed") > 0, F.lit(f"lower Crawl-delay to {MAX_DELAY}s or less"))], "; ")
    fix = (
        F.when(state == UNREADABLE, "Make sure /robots.txt is reachable for crawlers (not blocked by bot protection or rate limiting) and that it allows AI crawlers.")
        .when(state == GENERATED, "Build the site (or check the live /robots.txt) to confirm AI crawlers are allowed.")
        .when(state == ABSENT, 'Add a robots.txt at the site root that explicitly allows AI crawlers (e.g. "User-agent: *" then "Allow: /").')
        .otherwise(either(fixes != "", F.concat(fixes, F.lit("."))))
    )
    return run(own, "ai-access.bot-crawlability", score, message, findings, fix, state.isin(UNREADABLE, GENERATED), details={"state": state, "allowed": F.col("allowed"), "bots": F.col("n"), "source": F.col("robots_source")})


LLMS_FIX = 'Create an llms.txt at the site root with "# Site Name", a "> summary" line and "## Section" lists of [Title](url) links. See https://llmstxt.org/'
NO_H1, NO_LINKS = 'Missing H1 title on the first line (e.g. "# Project Name")', "No markdown links to key pages - agents cannot navigate from it"


def llms_runs(rows: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """Runs of ai-access.llms-txt, at most 6: 3 if it is out of reach or made by a build. full: sites (site_id) that have llms-full.txt."""
    own = of(rows, "llms", "live", "origin").join(of(rows, "robots").drop("robots_label"), "site_id")
    text = F.coalesce("llms_text", F.lit(""))
    star = rows.sparkSession.createDataFrame([("*", 0, False)], "name string, at int, is_major boolean")
    barred = crawler_rules(own.filter(F.col("robots_state") == READ).select("site_id", F.col("robots_text").alias("text")), star, "/llms.txt").filter("not allowed").select("site_id", F.col("rule").alias("bar"), "rule_line")
    own = own.join(barred, "site_id", "left").withColumn("form", llms_format(text))
    own = own.join(full.select("site_id").distinct().withColumn("full", F.lit(True)), "site_id", "left") if full is not None else own.withColumn("full", F.lit(None).cast("boolean"))
    state, label, live, n = F.col("llms_state"), F.col("llms_label"), F.col("live"), units(text)
    h1, links = F.col("form.h1"), F.col("form.links") > 0
    valid, some = h1 & links, n > 0
    cost = F.when(n == 0, 3).when(n < 50, 1).otherwise(0) + F.when(F.col("bar").isNotNull(), 2).otherwise(0)
    score = F.when(state.isin(UNREADABLE, GENERATED), 3.0).when(state == ABSENT, 0.0).otherwise(F.least(F.lit(6), F.greatest(F.lit(0), 5 - cost + F.when(valid, 1).otherwise(0))))
    message = (
        F.when(state == UNREADABLE, say("llms.txt could not be read (", label, ")"))
        .when(state == GENERATED, "llms.txt is generated, content could not be read from the repo")
        .when(state == ABSENT, "llms.txt not found")
        .when(valid, "llms.txt found (valid format)")
        .otherwise(either(some, "llms.txt found (format issues)", "llms.txt found"))
    )
    at = lambda m: _one(m, F.col("llms_path"), 1)
    read = state == READ
    findings = _list(
        (state == UNREADABLE, _one(say("Fetching /llms.txt answered ", label, ", so whether it exists is unknown"), _origin_file("/llms.txt"))),
        ((state == ABSENT) & live, _one(say("No llms.txt (", either(label == "HTTP 200", "the URL returns an HTML page or is empty", label), ")"), _origin_file("/llms.txt"))),
        ((state == ABSENT) & ~live, _one("No llms.txt in the served root", F.lit(None))),
        (read & ~some, at("llms.txt file is empty")),
        (read & some & (n < 50), at("llms.txt file appears too short (< 50 characters)")),
        (read & F.col("bar").isNotNull(), _one(say('"Disallow: ', F.col("bar"), '" blocks /llms.txt for User-agent: *'), F.col("robots_path"), F.col("rule_line"))),
        (read & (n > 10000), at("llms.txt is larger than 10KB (no penalty)")),
        (read & some & ~h1, at(NO_H1)),
        (read & some & ~links, at(NO_LINKS)),
    )
    fixes = joined([(n < 50, "Expand llms.txt into an index of key pages"), (F.col("bar").isNotNull(), "remove the robots.txt rule that blocks /llms.txt"), (some & ~valid, 'start llms.txt with "# Site Name" and list key pages as [Title](url) links')], "; ")
    fix = (
        F.when(state == UNREADABLE, "Make sure /llms.txt is reachable for AI assistants (not blocked by bot protection or rate limiting).")
        .when(state == GENERATED, "Build the site (or fetch the live /llms.txt) to confirm it has an H1 title and markdown links.")
        .when(state == ABSENT, LLMS_FIX)
        .when(fixes != "", F.concat(fixes, F.lit(".")))
        .otherwise(either(F.coalesce("full", F.lit(False)), "", "Consider also publishing /llms-full.txt with the full expanded content."))
    )
    return run(own, "ai-access.llms-txt", score, message, findings, fix, state.isin(UNREADABLE, GENERATED), details={"state": state, "links": F.col("form.links"), "blocked": F.col("bar").isNotNull()})


SIGNAL_FIX = 'Add a line such as "Content-Signal: search=yes, ai-input=yes, ai-train=no" to robots.txt to state how AI may use your content (the yes/no values are your policy choice). See https://contentsignals.org/'


def signal_runs(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Runs of ai-access.content-signals, advice of at most 3: 2 if robots.txt cannot be read. headers: site_id, header."""
    own = of(rows, "robots", "live", "origin").join(headers.select("site_id", "header"), "site_id", "left")
    lines = robots_lines(own.filter(F.col("robots_text").isNotNull()).select("site_id", F.col("robots_text").alias("text")))
    stated = lines.filter("key = 'content-signal'")
    keys = {k: content_signal(F.col("value"), k) for k in SIGNALS}
    bare = F.coalesce(*keys.values()).isNull()
    last = stated.groupBy("site_id").agg(*(F.max_by(v, F.when(v.isNotNull(), F.col("line"))).alias(f"robots_{k}") for k, v in keys.items()), F.array_sort(F.collect_list(F.when(bare, F.col("line")))).alias("invalid"))
    known = bot_list(rows.sparkSession).select(F.lower("name").alias("agent")).distinct()
    first_line = lines.filter("key = 'user-agent'").groupBy("site_id", "group").agg(F.min("line").alias("group_line"))
    named = robots_agents(lines).join(F.broadcast(known), "agent", "left_semi").join(first_line, ["site_id", "group"]).groupBy("site_id").agg(F.count_distinct("agent").alias("named"), F.min("group_line").alias("named_line"))
    own = own.join(last, "site_id", "left").join(named, "site_id", "left")
    values = {k: F.coalesce(F.col(f"`robots_{k}`"), content_signal(F.col("header"), k)) for k in SIGNALS}
    said = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v) for k, v in values.items()))
    in_robots = F.coalesce(*(F.col(f"`robots_{k}`") for k in SIGNALS)).isNotNull()
    state, label = F.col("robots_state"), F.col("robots_label")
    waits, lost, some = state == GENERATED, state == UNREADABLE, F.coalesce("named", F.lit(0)) > 0
    score = F.when(said != "", 3).when(waits | lost, 2).when(some, 1).otherwise(0)
    message = (
        F.when(said != "", say("Content Signals declared: ", said))
        .when(waits, "robots.txt is generated, Content Signals could not be read from the repo")
        .when(lost, say("robots.txt could not be read (", label, ") and no page sends a Content-Signal header"))
        .when(some, say("robots.txt addresses ", F.col("named"), " AI bot", either(F.col("named") == 1, "", "s"), " but declares no Content Signals"))
        .otherwise("No Content Signals declared")
    )
    file = F.col("robots_path")
    invalid = F.coalesce(F.transform("invalid", lambda n: _one("Content-Signal line has no valid key=yes|no pair (keys: search, ai-input, ai-train)", file, n)), _none())
    findings = (
        F.when((said != "") | waits, _none())
        .when(lost, F.array(_one(say("Fetching /robots.txt answered ", label, ", so a Content-Signal line there is unknown"), _origin_file("/robots.txt"))))
        .when(some, F.concat(F.array(_one("robots.txt controls AI crawler access but declares no Content-Signal", file, F.col("named_line"))), invalid))
        .when(state == READ, F.concat(F.array(_one("robots.txt has no Content-Signal line", file, 1)), invalid))
        .otherwise(F.array(_one("No robots.txt, so no Content-Signal is declared", F.when(F.col("live"), _origin_file("/robots.txt")))))
    )
    fix = (
        F.when(said != "", "")
        .when(waits, f"Check the live /robots.txt for a Content-Signal line. If there is none: {SIGNAL_FIX}")
        .when(lost, f"Make sure /robots.txt is reachable for crawlers, then check it for a Content-Signal line. If there is none: {SIGNAL_FIX}")
        .when(state == READ, SIGNAL_FIX)
        .otherwise(f"Create robots.txt at the site root. {SIGNAL_FIX}")
    )
    return run(own, "ai-access.content-signals", score, message, findings, fix, (said == "") & (waits | lost), (said != "") & ~in_robots & ~F.col("live"), details={"signals": said})


def sitemap_runs(rows: DataFrame) -> DataFrame:
    """Runs of crawlability.sitemap, at most 5: 2.5 if the sitemap, or robots.txt that may name one, is out of reach.

    A sitemap that a build makes counts, as predicted; a robots.txt that cannot be read costs nothing and
    leaves the score inconclusive.
    """
    own = of(rows, "sitemap", "live", "origin").join(of(rows, "robots"), "site_id")
    state, robots, live, text = F.col("sitemap_state"), F.col("robots_state"), F.col("live"), F.col("sitemap_text")
    lost = (state == UNREADABLE) | ((state == ABSENT) & live & (robots == UNREADABLE))
    none = ~lost & (state == ABSENT)
    named = (robots == READ) & F.coalesce("robots_text", F.lit("")).rlike(r"(?im)^[ \t]*sitemap[ \t]*:")
    unknown = robots.isin(UNREADABLE, GENERATED)
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"<loc[\s>]"))
    empty = (state == READ) & (n == 0)
    bare = robots == ABSENT
    score = F.when(lost, 2.5).when(none, 0.0).otherwise(F.greatest(F.lit(0), 5 - F.when(bare, 1).otherwise(0) - F.when(~named & ~unknown, 2).otherwise(0) - F.when(empty, 2).otherwise(0)))
    what = F.when(state == UNREADABLE, say("/sitemap.xml answered ", F.col("sitemap_label"))).otherwise(say("robots.txt answered ", F.col("robots_label"), ", so a Sitemap: line there is unknown"))
    message = F.when(lost, say("Sitemap could not be read (", what, ")")).when(none, "No sitemap.xml found").when(state == READ, say("Sitemap found with ", n, " URL", either(n != 1, "s"))).otherwise(say("Sitemap generated at build time (", F.col("sitemap_source"), ")"))
    there = ~lost & ~none
    findings = _list(
        (lost & (state == UNREADABLE), _one(say("Fetching the sitemap answered ", F.col("sitemap_label")), _origin_file("/sitemap.xml"))),
        (lost & live & (robots == UNREADABLE), _one(say("Fetching /robots.txt answered ", F.col("robots_label")), _origin_file("/robots.txt"))),
        (none & live, _one("No sitemap at /sitemap.xml, /sitemap_index.xml or any robots.txt Sitemap: URL", F.lit(None))),
        (none & ~live, _one("No sitemap at /sitemap.xml, /sitemap_index.xml, /sitemap-index.xml or /sitemap1.xml", F.lit(None))),
        (there & bare, _one("No robots.txt, so the sitemap is not declared to crawlers", F.lit(None))),
        (there & (robots == READ) & ~named, _one("robots.txt has no Sitemap: directive", F.col("robots_path"), 1)),
        (there & empty, _one("Sitemap has no <loc> entries", F.col("sitemap_path"), 1)),
    )
    fixes = joined([
        (bare, 'Create robots.txt with a "Sitemap: https://<domain>/sitemap.xml" line'),
        ((robots == READ) & ~named, say('Add "Sitemap: https://<domain>/', F.coalesce(F.regexp_replace("sitemap_path", "^.*/", ""), F.lit("sitemap.xml")), '" to ', F.col("robots_path"))),
        (empty, "list every page as <url><loc>...</loc></url> in the sitemap"),
    ], "; ")
    fix = (
        F.when(lost, "Make sure /sitemap.xml and /robots.txt are reachable for crawlers (not blocked by bot protection or rate limiting).")
        .when(none, 'Add a sitemap at /sitemap.xml listing every page and reference it in robots.txt with "Sitemap: https://<domain>/sitemap.xml".')
        .otherwise(either(fixes != "", F.concat(fixes, F.lit("."))))
    )
    return run(own, "crawlability.sitemap", score, message, findings, fix, lost | (there & unknown), state == GENERATED, details={"state": state, "urls": n, "declared": named})


#: Hosts that serve HTTPS by default, as messages name them.
HTTPS_HOSTS = {"netlify": "Netlify", "vercel": "Vercel", "cloudflare": "Cloudflare", "github-pages": "GitHub Pages", "firebase": "Firebase Hosting", "netlify-or-cloudflare": "Netlify / Cloudflare Pages"}
LOCAL = r"(?i)^https?://(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])(:|/|$)"


def scheme_of(url: Column) -> Column:
    """https, or http where it is no local address; else null."""
    return F.when(url.rlike("(?i)^https://"), "https").when(url.rlike("(?i)^http://") & ~url.rlike(LOCAL), "http")


def declared_schemes() -> Column:
    """What a page's canonical link and og:url declare, as structs (scheme, line, what)."""
    canonical = first(having("link", also=lambda n: F.lower(n["attrs"]["rel"]) == "canonical"))
    og = first(having("meta", also=lambda n: n["attrs"]["property"] == "og:url"))
    told = lambda n, attr, what: F.struct(scheme_of(trimmed(F.coalesce(n["attrs"][attr], F.lit("")))).alias("scheme"), n["line"].alias("line"), F.lit(what).alias("what"))
    return F.filter(F.array(told(canonical, "href", "Canonical"), told(og, "content", "og:url")), lambda x: x["scheme"].isNotNull())


#: What loads over plain http, as findings name it.
MIXED = (("img", "src", "img"), ("script", "src", "script"), ("link", "href", 'link rel="stylesheet"'), ("iframe", "src", "iframe"))


def mixed_parts() -> Column:
    """Resources over plain http, as structs (what, line)."""
    parts = []
    for tag, attr, what in MIXED:
        own = having(tag, also=lambda n, tag=tag, attr=attr: F.coalesce(n["attrs"][attr].startswith("http:"), F.lit(False)) & ((n["attrs"]["rel"] == "stylesheet") if tag == "link" else F.lit(True)))
        parts.append(F.transform(own, _mixed_as(what)))
    return F.concat(*parts)


def _mixed_as(what: str):
    return lambda n: F.struct(F.lit(what).alias("what"), n["line"].alias("line"))


def scheme_votes(pages: DataFrame, sites: DataFrame, rules: DataFrame, headers: DataFrame, site_hosts: DataFrame) -> DataFrame:
    """(site_id, scheme, https_votes, http_votes, forced, declared, host, evidence): how sites known by their files are served.

    In the order of weight: a header or redirect that forces HTTPS, the base URL, the votes of canonical
    links and og:url, what the host does by default. pages: site_id, url, nodes; sites: site_id, base_url;
    rules: redirect rules; headers: site_id, name, source of those sent for '/'; site_hosts: site_id, host, evidence.
    """
    cast = pages.select("site_id", F.explode(declared_schemes()).alias("d")).groupBy("site_id").agg(F.count_if(F.col("d.scheme") == "https").alias("https_votes"), F.count_if(F.col("d.scheme") == "http").alias("http_votes"))
    up = rules.filter(F.col("from").rlike("(?i)^http://") & F.col("to").rlike("(?i)^https://")).groupBy("site_id").agg(F.min(F.struct("rule_no", "file", "line")).alias("up"))
    hsts = headers.filter("name = 'strict-transport-security'").groupBy("site_id").agg(F.min("source").alias("hsts"))
    rows = sites.select("site_id", "base_url").join(cast, "site_id", "left").join(up, "site_id", "left").join(hsts, "site_id", "left").join(site_hosts.select("site_id", "host", F.col("evidence").alias("host_evidence")), "site_id", "left")
    https, http = F.coalesce("https_votes", F.lit(0)), F.coalesce("http_votes", F.lit(0))
    base = scheme_of(F.coalesce("base_url", F.lit("")))
    declared = F.coalesce(base, F.when(http > https, "http").when(https > 0, "https"))
    named = F.element_at(F.create_map(*(F.lit(x) for kv in HTTPS_HOSTS.items() for x in kv)), F.col("host"))
    hosted = F.coalesce(named.isNotNull(), F.lit(False))
    forced = F.col("hsts").isNotNull() | F.col("up").isNotNull()
    scheme = F.when(forced, "https").when(declared == "http", either(hosted, "https", "http")).when((declared == "https") | hosted, "https")
    said = F.concat_ws(
        "; ", F.when(F.col("hsts").isNotNull(), say("Strict-Transport-Security header in ", F.col("hsts"))), F.when(F.col("up").isNotNull(), say("http -> https redirect in ", F.col("up.file"), either(F.col("up.line").isNotNull(), say(":", F.col("up.line"))))),
        F.when(declared.isNotNull(), say("site URL declared as ", declared, "://", either(base.isNotNull(), say(" (", F.col("base_url"), ")")))), F.when(hosted, say(named, " serves HTTPS by default (", F.col("host_evidence"), ")")),
    )
    return rows.select("site_id", scheme.alias("scheme"), https.alias("https_votes"), http.alias("http_votes"), forced.alias("forced"), declared.alias("declared"), "host", said.alias("evidence"))


def page_schemes(pages: DataFrame) -> DataFrame:
    """(site_id, page_id, mixed, plain, findings) of pages that load or declare something over plain http, from (site_id, page_id, url, mixed, declared): mixed_parts, declared_schemes."""
    own = pages.select("site_id", "page_id", "url", "mixed", F.filter("declared", lambda d: d["scheme"] == "http").alias("plain"))
    told = F.concat(F.transform("mixed", lambda m: _one(say("Mixed content: <", m["what"], "> loads over http://"), F.col("url"), m["line"])), F.transform("plain", lambda d: _one(say(d["what"], " declares an http:// URL"), F.col("url"), d["line"])))
    return own.filter((F.size("mixed") > 0) | (F.size("plain") > 0)).select("site_id", "page_id", F.size("mixed").alias("mixed"), F.size("plain").alias("plain"), told.alias("findings"))


def https_runs(votes: DataFrame, live: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs of crawlability.https, at most 2; 1 where nothing tells the scheme.

    votes: scheme_votes, of sites known by their files; live: site_id, origin, http_status, location, hsts of
    the others; pages: page_schemes. Findings are collected by page: a site's are as many as its faults.
    """
    faults = pages.groupBy("site_id").agg(F.sum("mixed").alias("mixed"), F.sum("plain").alias("plain"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "findings"))), lambda x: x["findings"])).alias("found"))
    n, plain, found = F.coalesce("mixed", F.lit(0)), F.coalesce("plain", F.lit(0)), F.coalesce("found", _none())
    assets = "Change http:// asset URLs (img, script, stylesheet, iframe) to https://"
    own = votes.join(faults, "site_id", "left")
    scheme = F.col("scheme")
    warned = either(n > 0, say(" (", n, " mixed content warning", either(n == 1, "", "s"), ")"))
    fixes = joined([(n > 0, assets), (plain > 0, "switch canonical and og:url to https://")], "; ")
    message = (
        F.when(scheme == "http", "Site URL is declared as http:// and nothing in the repo enforces HTTPS")
        .when(scheme.isNull(), say("HTTPS could not be determined from the repo", either(n > 0, say(" (", n, " mixed content reference", either(n == 1, "", "s"), ")"))))
        .otherwise(say("Site uses HTTPS (inferred)", warned))
    )
    declared = F.filter(found, lambda x: ~x["message"].startswith("Mixed"))
    findings = F.when(scheme == "http", F.when(F.size(declared) > 0, declared).otherwise(F.array(_one("Site URL is declared as http://", F.lit(None))))).otherwise(found)
    fix = (
        F.when(scheme == "http", "Serve the site over HTTPS (host setting or certificate), redirect http to https, and switch the site URL, canonical and og:url to https://.")
        .when(scheme.isNull(), say("Set the production site URL (base URL, canonical) to https:// and confirm the live site redirects http to https", either(fixes != "", F.concat(F.lit("; "), fixes)), "."))
        .otherwise(either(fixes != "", F.concat(fixes, F.lit("."))))
    )
    score = F.when(scheme == "http", 0.0).when(scheme.isNull(), 1.0).otherwise(F.floor(2 - F.when(n > 0, 0.5).otherwise(0.0)).cast("double"))
    from_files = run(own, "crawlability.https", score, message, findings, fix, scheme.isNull(), scheme.isNotNull(), details={"scheme": scheme, "evidence": F.col("evidence")})

    own = live.join(faults, "site_id", "left")
    secure = F.col("origin").startswith("https:")
    status, hsts = F.col("http_status"), F.col("hsts").isNotNull()
    serves = F.coalesce(status.between(200, 299), F.lit(False))
    moved = F.coalesce(status.between(300, 399) & F.col("location").rlike("(?i)^https://"), F.lit(False))
    notes = joined([(n > 0, say(n, " mixed content warning", either(n == 1, "", "s"))), (serves, "http:// does not redirect")], ", ")
    message = F.when(~secure, say("Site is served over plain http:// (", F.col("origin"), ")")).otherwise(say("Site uses HTTPS", either(moved, ", http redirects to https"), either(hsts, ", HSTS set"), either(notes != "", say(" (", notes, ")"))))
    plain_url = F.concat(F.regexp_replace("origin", "^https:", "http:"), F.lit("/"))
    findings = F.when(~secure, F.array(_one("The site answers over http:// and did not redirect to https://", F.concat(F.col("origin"), F.lit("/"))))).otherwise(F.concat(found, _list((serves, _one(say("http:// answers ", status, " with content instead of redirecting to https://"), plain_url)))))
    fixes = joined([(serves, "Redirect http:// to https:// with a 301"), (n > 0, assets), (~hsts, "Consider a Strict-Transport-Security header")], ". ")
    fix = F.when(~secure, "Serve the site over HTTPS (host setting or certificate), redirect http to https, and switch the canonical and og:url to https://.").otherwise(either(fixes != "", F.concat(fixes, F.lit("."))))
    score = F.when(~secure, 0.0).otherwise(F.floor(2 - F.when(n > 0, 0.5).otherwise(0.0) - F.when(serves, 0.5).otherwise(0.0)).cast("double"))
    return from_files.unionByName(run(own, "crawlability.https", score, message, findings, fix, details={"scheme": either(secure, "https", "http"), "hsts": F.col("hsts")}))


def unknown_url_probe(probes: DataFrame) -> DataFrame:
    """(site_id, point, inconclusive, status, reason) from what a made-up URL answered: site_id, url, status, timed_out, final_url."""
    s, lost = F.col("status"), F.coalesce(unreachable(F.col("status"), F.col("timed_out")), F.lit(True))
    label = response_label(s, F.col("timed_out"))
    point = F.when(lost, 0.5).when(s.between(400, 499), 1.0).when(s.between(200, 299), 0.0).otherwise(0.5)
    where = either(F.col("final_url").isNotNull(), say(" after redirecting to ", F.col("final_url")))
    reason = (
        F.when(lost, say("The request for a made-up URL answered ", label, ", so how unknown URLs are answered is unknown"))
        .when(s.between(400, 499), say("unknown URL returns ", s))
        .when(s.between(200, 299), say("Unknown URLs return HTTP ", s, where, " (soft 404)"))
        .otherwise(say("The request for a made-up URL answered ", label, " (a server error, not a 404)"))
    )
    return probes.select("site_id", "url", point.alias("point"), (point == 0.5).alias("inconclusive"), "status", "final_url", reason.alias("reason"))


def live_http_runs(probes: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs of crawlability.http-behavior of live sites, at most 3: a made-up URL, the share of pages that answer, the share that no header hides.

    pages: site_id, url, status, timed_out, guessed, x_robots: pages that were asked for. Ones out of reach,
    and guessed ones that failed, say nothing.
    """
    probe = unknown_url_probe(probes)
    s = F.col("status")
    lost = F.coalesce(unreachable(s, F.col("timed_out")), F.lit(True))
    good = ~lost & s.between(200, 299)
    bad = ~lost & (s >= 400) & ~F.coalesce("guessed", F.lit(False))
    hidden = good & F.coalesce(F.col("x_robots").rlike(r"(?i)(?<![A-Za-z0-9_])(noindex|none)(?![A-Za-z0-9_])"), F.lit(False))
    sums = pages.groupBy("site_id").agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"), F.count_if(hidden).alias("hidden"), F.min(F.when(bad, F.struct("url", "status"))).alias("first_bad"), F.min(F.when(hidden, F.struct("url", "x_robots"))).alias("first_hidden"))
    faults = pages.filter(bad | hidden).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct(hidden.alias("late"), "url", F.when(hidden, say("X-Robots-Tag: ", F.col("x_robots"), " response header hides this page from AI search")).otherwise(say("Page is served with HTTP ", s, " instead of 200")).alias("message")))).alias("faults"))
    own = probe.join(sums, "site_id", "left").join(faults, "site_id", "left")
    n_good, n_bad, n_hidden = (F.coalesce(c, F.lit(0)) for c in ("good", "bad", "hidden"))
    none = n_good + n_bad == 0
    score = F.col("point") + F.when(none, 0.5).otherwise(n_good / (n_good + n_bad)) + F.when(n_good == 0, 0.5).otherwise((n_good - n_hidden) / n_good)
    soft = F.col("point") == 0
    issues = F.array_compact(F.array(
        F.when(soft | F.col("inconclusive"), F.col("reason")),
        F.when(n_bad > 0, say(n_bad, " page", either(n_bad == 1, "", "s"), " did not return HTTP 200 (", F.col("first_bad.url"), " answers ", F.col("first_bad.status"), ")")),
        F.when(none, "No page could be fetched, so page status is unknown"),
        F.when(n_hidden > 0, say('X-Robots-Tag "', F.col("first_hidden.x_robots"), '" hides ', n_hidden, " page", either(n_hidden == 1, "", "s"), " from AI search")),
    ))
    message = F.coalesce(F.get(issues, F.lit(0)), F.lit("Correct HTTP behavior: real 404s, 200 pages, no noindex header"))
    probed = _list((soft, _one(say("A made-up URL answered HTTP ", s, either(F.col("final_url").isNotNull(), say(" (redirected to ", F.col("final_url"), ")")), " instead of 404 (soft 404)"), F.col("url"))), (F.col("inconclusive"), _one(F.col("reason"), F.col("url"))))
    findings = F.concat(probed, F.coalesce(F.transform("faults", lambda x: _one(x["message"], x["url"])), _none()))
    fixes = joined([(soft, "Answer unknown URLs with HTTP 404 (remove the catch-all 200 fallback or redirect-to-home rule)"), (n_bad > 0, "fix or remove links and sitemap entries that point at pages returning errors"), (n_hidden > 0, "remove X-Robots-Tag noindex/none from production responses")], "; ")
    return run(own, "crawlability.http-behavior", score, message, findings, either(fixes != "", F.concat(fixes, F.lit("."))), F.col("inconclusive") | none, details={"unknown": F.col("point"), "pages": n_good + n_bad, "hidden": n_hidden})


def predicted_http_runs(unknown: DataFrame, answers: DataFrame, hidden: DataFrame) -> DataFrame:
    """Runs of the same of sites known by their files: all predicted. unknown: unknown_url_points; answers: predicted_answers; hidden: site_id, url_path of pages that headers hide."""
    out = hidden.select("site_id", "url_path").distinct().withColumn("out", F.lit(True))
    sums = answers.join(out, ["site_id", "url_path"], "left").groupBy("site_id").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.count_if("out").alias("hidden"), F.min(F.when(~F.col("ok"), F.struct("url_path", "status"))).alias("first_bad"))
    own = unknown.join(sums, "site_id", "left")
    n, bad, hid = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0)), F.coalesce("hidden", F.lit(0))
    score = F.col("point") + F.when(n == 0, 1.0).otherwise((n - bad) / n) + F.when(n == 0, 1.0).otherwise((n - hid) / n)
    soft = F.col("point") == 0
    issues = F.array_compact(F.array(
        F.when(soft, "Unknown URLs return HTTP 200 (soft 404): a catch-all rule answers them"), F.when(F.col("inconclusive"), "No 404 page found and the host is unknown, so the status for unknown URLs cannot be predicted"),
        F.when(bad > 0, say(bad, " page", either(bad == 1, "", "s"), " would not return HTTP 200 (", F.col("first_bad.url_path"), " answers ", F.col("first_bad.status"), ")")), F.when(hid > 0, say("X-Robots-Tag hides ", hid, " page", either(hid == 1, "", "s"), " from AI search")),
    ))
    message = F.coalesce(F.get(issues, F.lit(0)), F.lit("Correct HTTP behavior predicted: real 404s, 200 pages, no noindex header"))
    findings = _list(
        (soft, _one("Catch-all rule turns unknown URLs into HTTP 200 (soft 404)", F.lit(None))), (F.col("inconclusive"), _one("No 404 page (404.html) in the served root", F.lit(None))),
        (bad > 0, _one(say("Page is served with HTTP ", F.col("first_bad.status"), " instead of 200"), F.col("first_bad.url_path"))), (hid > 0, _one("X-Robots-Tag header rule contains noindex/none and hides pages from AI search", F.lit(None))),
    )
    fixes = joined([
        (soft, "Remove the catch-all 200 rewrite or redirect-to-home rule for unknown paths and add a 404.html"), (~soft & (F.col("point") < 1), "Add a 404.html (or framework 404 page) so unknown URLs return HTTP 404"),
        (bad > 0, "remove the redirect or error rules that apply to published pages"), (hid > 0, "remove X-Robots-Tag noindex/none from header rules for production pages"),
    ], "; ")
    return run(own, "crawlability.http-behavior", score, message, findings, either(fixes != "", F.concat(fixes, F.lit(". Verify live with curl -I."))), F.col("inconclusive"), F.lit(True), details={"unknown": F.col("point"), "pages": n, "hidden": hid})


NEGOTIATION = 'Optional: also answer "Accept: text/markdown" requests with the Markdown copy (Cloudflare "Markdown for Agents", or edge middleware serving the .md file)'
MARKDOWN_FIX = 'Answer "Accept: text/markdown" with a Markdown version and Content-Type: text/markdown (Cloudflare offers this as "Markdown for Agents", or use edge middleware), and advertise it with <link rel="alternate" type="text/markdown" href="..."> or a Link header.'
#: Pages of a site that are asked for Markdown, and alternates that are fetched.
PROBED_PAGES, FETCHED_ALTERNATES = 20, 40


def probe_plan(pages: DataFrame, most: int = PROBED_PAGES) -> DataFrame:
    """The first pages of each site (site_id, page_id, seq), which are asked for Markdown."""
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("seq", "page_id"))
    return pages.select("site_id", "page_id", "seq").withColumn("place", place).filter(F.col("place") <= most).select("site_id", "page_id")


def live_markdown_runs(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """Runs of agent-readiness.markdown of live pages, at most 3.

    pages: site_id, page_id, url, alternate (the first that a link or Link header advertises), head_line.
    probes: site_id, page_id, probe ('negotiated', 'alternate'), status, timed_out, content_type, html. A page
    that was not asked for Markdown is judged by its site's other pages: 3 if one gave it, else 1.5.
    """
    s, lost = F.col("status"), F.coalesce(unreachable(F.col("status"), F.col("timed_out")), F.lit(True))
    ok = ~lost & s.between(200, 299)
    kind = F.coalesce("content_type", F.lit(""))
    told = probes.withColumns({"ok": ok, "lost": lost, "label": response_label(s, F.col("timed_out")), "kind": kind, "marked": ok & kind.rlike("(?i)text/(x-)?markdown"), "works": ok & ~F.coalesce("html", F.lit(False)) & ~kind.rlike("(?i)text/html|application/xhtml")})
    of_probe = lambda p, name: told.filter(F.col("probe") == p).select("site_id", "page_id", F.struct("marked", "works", "lost", "label", "kind", "status").alias(name))
    others = told.filter("probe = 'negotiated' and marked").select("site_id").distinct().withColumn("others", F.lit(True))
    own = pages.join(of_probe("negotiated", "asked"), ["site_id", "page_id"], "left").join(of_probe("alternate", "copy"), ["site_id", "page_id"], "left").join(others, "site_id", "left")
    asked, copy, there = F.col("asked"), F.col("copy"), F.col("alternate").isNotNull()
    probed = asked.isNotNull()
    cases = {
        "negotiated": F.coalesce(asked["marked"], F.lit(False)), "works": there & F.coalesce(copy["works"], F.lit(False)), "untested": probed & F.coalesce(asked["lost"], F.lit(False)),
        "unverified": there & (copy.isNull() | F.coalesce(copy["lost"], F.lit(True))), "others": ~probed & F.coalesce("others", F.lit(False)), "unasked": ~probed, "none": F.lit(True),
    }
    case = F.coalesce(*(F.when(t, F.lit(k)) for k, t in cases.items()))
    own = own.withColumn("case", case)
    is_ = lambda k: F.col("case") == k
    pick = lambda values: F.coalesce(*(F.when(is_(k), v if isinstance(v, Column) else F.lit(v)) for k, v in values.items()))
    verify = say('curl -sI -H "Accept: text/markdown" ', F.col("url"))
    got = say(either(asked["kind"] != "", asked["kind"], "no content type"), " (HTTP ", asked["status"], ")")
    file, head = F.col("url"), F.col("head_line")
    broken = there & copy.isNotNull() & ~F.coalesce(copy["works"] | copy["lost"], F.lit(True))
    fault = _list((broken, _one(say("Advertised markdown alternate ", F.col("alternate"), " answers ", copy["label"], either(copy["status"].between(200, 299), " with HTML")), file, head)))
    score = pick({"negotiated": 3.0, "works": 3.0, "untested": 1.5, "unverified": 3.0, "others": 3.0, "unasked": 1.5, "none": 0.0})
    message = pick({
        "negotiated": "Serves Markdown via content negotiation (Accept: text/markdown)", "works": "Markdown copy is linked from the page and works", "untested": say("Markdown negotiation could not be tested (", asked["label"], ")"),
        "unverified": "Markdown alternate is advertised; its target could not be checked", "others": "Other pages on this host serve Markdown via content negotiation (not tested on this page)",
        "unasked": "No Markdown alternate advertised; negotiation was not tested on this page", "none": 'No Markdown representation for agents: "Accept: text/markdown" returns HTML',
    })
    findings = pick({
        "untested": F.array(_one(say('The request with "Accept: text/markdown" answered ', asked["label"]), file)),
        "unverified": F.array(_one(say("Markdown alternate ", F.col("alternate"), F.when(copy.isNull(), " was not fetched (another origin or over the fetch limit)").otherwise(say(" answered ", copy["label"]))), file, head)),
        "others": fault, "unasked": F.concat(fault, F.array(_one(say("No markdown alternate advertised. Check live with ", verify), file, head))),
        "none": F.concat(fault, F.array(_one(say('A request with "Accept: text/markdown" got ', got, " and no working markdown alternate is advertised"), file, head))),
    })
    fix = pick({"untested": say("Check live with ", verify, "."), "unverified": say("Check the alternate URL and ", verify, "."), "unasked": MARKDOWN_FIX, "none": MARKDOWN_FIX})
    advice = F.when(is_("works") & probed & ~asked["lost"], F.array(_one(say(NEGOTIATION, ". Markdown copy ", F.col("alternate"), ' works; a request with "Accept: text/markdown" got ', got), file, head)))
    return run(own, "agent-readiness.markdown", score, message, findings, fix, F.col("case").isin("untested", "unverified", "unasked"), is_("others"), advice=advice, details={"case": F.col("case")}, page=True)


def file_markdown_runs(pages: DataFrame, code: DataFrame, copies: DataFrame, served: DataFrame) -> DataFrame:
    """Runs of the same of pages known by their files.

    pages: site_id, page_id, url_path, file, alternate (of a link), header_alternate, head_line; code: site_id,
    file that answers by the Accept header (site_tree.markdown_negotiation); copies: site_id, url_path, file
    (site_tree.markdown_files); served: site_id, target, file (site_tree.local_files) of the alternates.
    """
    own = pages.join(code.select("site_id", F.col("file").alias("code")), "site_id", "left").join(copies.select("site_id", "url_path", F.col("file").alias("copy")), ["site_id", "url_path"], "left")
    own = own.join(served.select("site_id", F.col("target").alias("alternate"), F.col("file").alias("target_file"), F.lit(True).alias("asked")), ["site_id", "alternate"], "left")
    link, header = F.col("alternate").isNotNull(), F.col("header_alternate").isNotNull()
    cases = {"code": F.col("code").isNotNull(), "broken": link & ~header & F.coalesce("asked", F.lit(False)) & F.col("target_file").isNull(), "linked": link | header, "copy": F.col("copy").isNotNull(), "none": F.lit(True)}
    own = own.withColumn("case", F.coalesce(*(F.when(t, F.lit(k)) for k, t in cases.items())))
    is_ = lambda k: F.col("case") == k
    pick = lambda values: F.coalesce(*(F.when(is_(k), v if isinstance(v, Column) else F.lit(v)) for k, v in values.items()))
    note = 'Content negotiation cannot be seen in the repo; verify live with curl -sI -H "Accept: text/markdown" <page url>.'
    file, head = F.col("file"), F.col("head_line")
    md = F.concat(F.lit("/"), F.col("copy"))
    message = pick({"code": "Serves Markdown via content negotiation (from server/edge code, unverified)", "broken": "Markdown alternate is advertised, but its target is not in the site", "linked": "Markdown copy is advertised for agents", "copy": "A .md version exists but is not discoverable", "none": "No Markdown representation found for agents"})
    findings = pick({
        "broken": F.array(_one(say("Advertised markdown alternate ", F.col("alternate"), " was not found in the site"), file, head)),
        "copy": F.array(_one(say("Markdown version ", md, ' exists but is not advertised with <link rel="alternate" type="text/markdown">'), file, head)),
        "none": F.array(_one(f"No markdown alternate, Link header or .md file for this page. {note}", file, head)),
    })
    fix = pick({
        "broken": say("Publish the Markdown copy at ", F.col("alternate"), ", or fix the href."), "copy": say("Advertise ", md, ' with <link rel="alternate" type="text/markdown" href="', md, '"> in the <head> or a Link header, and honour "Accept: text/markdown".'),
        "none": 'Serve a Markdown version for agents: publish a .md file per page, advertise it with <link rel="alternate" type="text/markdown" href="..."> or a Link header, and answer "Accept: text/markdown" with Content-Type: text/markdown (Cloudflare offers this as "Markdown for Agents").',
    })
    advice = F.when(is_("linked"), F.array(_one(f"{NEGOTIATION}. {note}", file, head)))
    return run(own, "agent-readiness.markdown", pick({"code": 3.0, "broken": 0.0, "linked": 3.0, "copy": 1.0, "none": 0.0}), message, findings, fix, F.col("case").isin("broken", "copy", "none"), F.col("case").isin("code", "copy"), advice=advice, details={"case": F.col("case")}, page=True)


#: How reports name what agents can discover.
LABELS = {
    "/.well-known/mcp/server-card.json": "MCP server card", "/.well-known/mcp.json": "MCP server card", "/.well-known/agent-card.json": "A2A agent card", "/.well-known/agent.json": "Agent card", "/.well-known/agent-skills/index.json": "Agent skills index", "/.well-known/api-catalog": "API catalog (RFC 9727)",
    "/.well-known/openapi.json": "OpenAPI document", "/openapi.json": "OpenAPI document", "/.well-known/oauth-authorization-server": "OAuth authorization server metadata", "/.well-known/oauth-protected-resource": "OAuth protected resource metadata (RFC 9728)", "/.well-known/ai": "AI metadata",
}


def protocol_runs(sites: DataFrame, found: DataFrame, guessed: DataFrame, invalid: DataFrame, unreadable: DataFrame, shown: DataFrame) -> DataFrame:
    """Runs of agent-readiness.protocols, at most 6; 3 if a programming interface shows and discovery paths are out of reach; not applicable if nothing shows.

    found: site_id, path, kind (site_checks.artifacts_found); guessed: the same of paths that a route handler
    would serve; invalid: site_id, path of files that do not validate; unreadable: site_id, path, label;
    shown: site_id, tools (how many tool annotations), api (array of struct(sample, file, line)).
    """
    named = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("path"))
    both = found.select("site_id", "path", "kind", F.lit(False).alias("guess")).unionByName(guessed.join(found.select("site_id", "path"), ["site_id", "path"], "left_anti").select("site_id", "path", "kind", F.lit(True).alias("guess")))
    order = F.array_position(F.array(*(F.lit(p) for p in LABELS)), F.col("path"))
    sums = both.groupBy("site_id").agg(F.count_distinct("kind").alias("kinds"), F.bool_or("guess").alias("guess"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("guess", order.alias("at"), named.alias("label")))), lambda x: x["label"])).alias("labels"))
    listed = lambda rows, column, name: rows.groupBy("site_id").agg(F.array_sort(F.collect_list(column)).alias(name))
    own = sites.select("site_id", "origin").join(shown, "site_id", "left").join(sums, "site_id", "left").join(listed(invalid, F.col("path"), "invalid"), "site_id", "left").join(listed(unreadable, F.struct(order.alias("at"), "path", "label"), "closed"), "site_id", "left")
    tools = F.coalesce("tools", F.lit(0)) > 0
    n = F.coalesce("kinds", F.lit(0)) + tools.cast("int")
    api, closed = F.coalesce(F.size("api") > 0, F.lit(False)), F.coalesce(F.size("closed") > 0, F.lit(False))
    own = own.withColumn("case", F.when(n > 0, "found").when(api & closed, "closed").when(api, "api").otherwise("na"))
    is_ = lambda k: F.col("case") == k
    labels = F.array_distinct(F.concat(F.coalesce("labels", F.array().cast("array<string>")), F.when(tools, F.array(F.lit("WebMCP tool annotations"))).otherwise(F.array().cast("array<string>"))))
    score = F.when(n >= 3, 6).when(n == 2, 5).when(n == 1, 3).when(is_("closed"), 3).otherwise(0)
    message = (
        F.when(is_("found"), say("Agent discovery artifacts found: ", F.array_join(labels, ", ")))
        .when(is_("closed"), say("API surface detected; ", F.size("closed"), " discovery path", either(F.size("closed") == 1, "", "s"), " could not be read (", F.get("closed", F.lit(0))["label"], ")"))
        .when(is_("api"), "API surface detected but no agent discovery artifacts published")
        .otherwise("Not applicable: no API or agent surface detected")
    )
    faults = F.coalesce(F.transform("invalid", lambda p: _one(say(p, " exists but does not validate (not JSON of the expected shape, or served as HTML)"), p, 1)), _none())
    samples = F.coalesce(F.transform(F.slice("api", 1, NAMED), lambda a: _one(say("API surface evidence: ", a["sample"]), a["file"], a["line"])), _none())
    shut = F.coalesce(F.transform(F.slice("closed", 1, NAMED), lambda c: _one(say("Fetching ", c["path"], " answered ", c["label"]), F.concat(F.col("origin"), c["path"]))), _none())
    findings = F.when(is_("closed"), F.concat(shut, samples, faults)).when(is_("api"), F.concat(F.array(_one("No agent discovery files under /.well-known/ (MCP server card, API catalog, OpenAPI, OAuth metadata)", F.lit(None))), samples, faults)).otherwise(faults)
    fix = (
        F.when(is_("found"), either(n >= 2, "", "Add more of the artifacts agents look for: an MCP server card at /.well-known/mcp/server-card.json, an API catalog at /.well-known/api-catalog, an OpenAPI document, and OAuth metadata if authentication is required."))
        .when(is_("closed"), "Make sure the /.well-known/ discovery paths are reachable for agents (not blocked by bot protection or rate limiting).")
        .when(is_("api"), "Publish an MCP server card at /.well-known/mcp/server-card.json, an API catalog at /.well-known/api-catalog (RFC 9727) or an OpenAPI document, plus OAuth metadata at /.well-known/oauth-protected-resource if authentication is required.")
        .otherwise("")
    )
    return run(own, "agent-readiness.protocols", score, message, findings, fix, is_("closed"), F.coalesce("guess", F.lit(False)), is_("na"), details={"kinds": n, "case": F.col("case")})
