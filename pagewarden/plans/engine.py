"""Runs of checks to results by check, totals, findings and reports.

A run is one check on one page, or on a site (page_id null): site_id, page_id, seq (the place of the page),
check_id, score, na, inconclusive, predicted, message, recommendation, findings and advice (arrays of
struct(message, file, line)). Everything is grouped by site, check and message first, so that a site of
many pages meets in no task before it has shrunk to its distinct messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.functions.text import rounded
from pagewarden.plans.scorecard import CHECK_ORDER, grade, status

#: The checks of the rubric (id, name, weight, how to fix, conditional, advisory) in their order.
RUBRIC = (
    ("ai-access.bot-crawlability", "AI Bot Crawlability", 12, "auto", False, False),
    ("ai-access.llms-txt", "llms.txt Detection", 6, "auto", False, False),
    ("ai-access.content-signals", "Content Signals", 3, "auto", False, True),
    ("crawlability.indexability", "Indexability", 8, "auto", False, False),
    ("crawlability.sitemap", "Sitemap Detection", 5, "auto", False, False),
    ("crawlability.https", "SSL / HTTPS", 2, "assisted", False, False),
    ("crawlability.http-behavior", "HTTP Behavior", 3, "assisted", False, False),
    ("structured-data.present", "Structured Data", 15, "auto", False, False),
    ("structured-data.valid", "Schema Validation", 5, "auto", False, False),
    ("meta.title", "Meta Title", 5, "auto", False, False),
    ("meta.description", "Meta Description", 5, "auto", False, False),
    ("meta.open-graph", "Open Graph", 3, "auto", False, False),
    ("meta.twitter-cards", "Twitter Cards", 3, "auto", False, False),
    ("meta.language", "Language Tags", 3, "auto", False, False),
    ("meta.viewport", "Mobile Friendly", 3, "auto", False, False),
    ("content.headings", "Semantic Headings", 8, "auto", False, False),
    ("content.quality", "Content Quality", 5, "assisted", False, False),
    ("content.freshness", "Content Freshness", 5, "assisted", False, False),
    ("content.author", "Author Signals", 5, "assisted", False, False),
    ("content.image-alt", "Image Alt Text", 5, "auto", False, False),
    ("content.internal-links", "Internal Linking", 4, "assisted", False, False),
    ("content.accessibility", "Accessibility", 4, "auto", False, False),
    ("agent-readiness.server-rendered", "Server-Rendered Content", 6, "assisted", False, False),
    ("agent-readiness.markdown", "Markdown for Agents", 3, "assisted", False, False),
    ("agent-readiness.controls", "Agent-Usable Controls", 4, "assisted", False, False),
    ("agent-readiness.protocols", "Agent Protocol Discovery", 6, "assisted", True, False),
)
#: Categories in their order, what marks stand for in reports, and report limits.
CATEGORIES = (("ai-access", "AI crawler access"), ("crawlability", "Crawlability and indexing"), ("structured-data", "Structured data"), ("meta", "Meta and social tags"), ("content", "Content structure and quality"), ("agent-readiness", "Agent readiness"))
MARKS = {"pass": "PASS", "warning": "WARN", "fail": "FAIL", "na": "N/A", "skipped": "SKIP", "advice": "ADVICE"}
FIXES = {"auto": "auto-fix", "assisted": "assisted", "report-only": "report only"}
FINDINGS, LOCATIONS, NAMES, WORST = 8, 5, 10, 5
FINDING = "struct<message:string,file:string,line:int>"


def rubric_table(spark: SparkSession) -> DataFrame:
    """check_id, name, weight, fixable, conditional, advisory, category, ord."""
    rows = [(i, n, w, f, c, a, i.split(".")[0], k) for k, (i, n, w, f, c, a) in enumerate(RUBRIC)]
    return spark.createDataFrame(rows, "check_id string, name string, weight int, fixable string, conditional boolean, advisory boolean, category string, ord int")


def rubric_totals(rubric: DataFrame) -> DataFrame:
    """(category, max): points that can be had, advice aside; and a row of all (category null)."""
    return rubric.filter("not advisory").rollup("category").agg(F.sum("weight").alias("max"))


def rubric_faults(rubric: DataFrame, order: DataFrame, categories: DataFrame, fixes: tuple[str, ...] = ("auto", "assisted", "report-only")) -> DataFrame:
    """(check_id, fault): ids that repeat, are missing from the order or only there, unknown categories or fixes, weights under 1."""
    twice = rubric.groupBy("check_id").agg(F.count("*").alias("n")).filter("n > 1").select("check_id", F.lit("repeated").alias("fault"))
    missing = order.join(rubric, "check_id", "left_anti").select("check_id", F.lit("no such check").alias("fault"))
    extra = rubric.join(order, "check_id", "left_anti").select("check_id", F.lit("not in the order").alias("fault"))
    stray = rubric.join(categories, "category", "left_anti").select("check_id", F.lit("no such category").alias("fault"))
    odd = rubric.filter((F.col("weight") < 1) | ~F.col("fixable").isin(*fixes)).select("check_id", F.lit("weight or fix out of range").alias("fault"))
    return twice.union(missing).union(extra).union(stray).union(odd)


def normalised(runs: DataFrame, rubric: DataFrame) -> DataFrame:
    """Scores floored and held between 0 and the weight; nulls as nothing."""
    no = F.lit(False)
    score = F.least(F.greatest(F.coalesce(F.floor(F.nanvl(F.col("score").cast("double"), F.lit(0.0))), F.lit(0)), F.lit(0)), F.col("weight")).cast("int")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(f"array<{FINDING}>")).alias(c)
    kept = runs.join(F.broadcast(rubric.select("check_id", "weight", "advisory")), "check_id")
    return kept.select("site_id", "page_id", "seq", "check_id", "weight", "advisory", score.alias("score"), *(F.coalesce(F.col(c), no).alias(c) for c in ("na", "inconclusive", "predicted")), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("message", "recommendation")), listed("findings"), listed("advice"))


def _marked(runs: DataFrame, excluded: DataFrame) -> DataFrame:
    out = excluded.select("site_id", "page_id").distinct().withColumn("out", F.lit(True))
    return runs.join(out, ["site_id", "page_id"], "left").withColumn("out", F.coalesce("out", F.lit(False)))


def check_states(runs: DataFrame, rubric: DataFrame, excluded: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per site of (site_id, mode) and check: status, score, lost, flags, message, recommendation, pages.

    Pages in `excluded` (site_id, page_id) count for nothing. A check without runs is skipped, and so are
    all checks of a site whose mode is report-only; where every run does not apply, neither does the check.
    The message is the one of most pages that lost points, the first seen of several; without any, the
    first page's.
    """
    rows = _marked(normalised(runs, rubric), excluded)
    losing = ~F.col("out") & (F.col("score") < F.col("weight"))
    kept = ~F.col("out")
    first = F.min(F.when(losing & (F.col("recommendation") != ""), F.struct("seq", "recommendation")))
    by = rows.groupBy("site_id", "check_id", "message").agg(
        F.count_if(kept).alias("n"), F.count_if(losing).alias("losing"), F.count_if(kept & F.col("na")).alias("nas"), F.sum(F.when(kept, F.col("score"))).alias("total"),
        F.count_if(kept & F.col("inconclusive")).alias("unsure"), F.count_if(kept & F.col("predicted")).alias("guessed"), F.count_if("out").alias("outs"),
        F.min(F.when(losing, F.col("seq"))).alias("lost_first"), F.min(F.when(kept, F.col("seq"))).alias("first"), first.alias("advised"),
    )
    most = F.max(F.when(F.col("losing") > 0, F.struct("losing", -F.col("lost_first"), "message")))["message"]
    sums = by.groupBy("site_id", "check_id").agg(
        *(F.sum(c).alias(c) for c in ("n", "losing", "nas", "total", "unsure", "guessed", "outs")), most.alias("common"), F.min(F.when(F.col("n") > 0, F.struct("first", "message")))["message"].alias("opening"), F.min("advised")["recommendation"].alias("advised")
    )
    all_ = sites.select("site_id", F.coalesce("mode", F.lit("full")).alias("mode"), F.explode(F.array(*(F.lit(c) for c in CHECK_ORDER))).alias("check_id")).join(F.broadcast(rubric), "check_id")
    at = all_.join(sums, ["site_id", "check_id"], "left")
    ran = (F.coalesce(F.col("n"), F.lit(0)) > 0) & (F.col("mode") != "report-only")
    na = ran & (F.col("nas") == F.col("n"))
    score = F.when(ran & ~na, rounded(F.col("total") / F.col("n"), 1)).otherwise(F.lit(0.0))
    at = at.withColumn("mean", score)
    full = F.col("mean") >= F.col("weight")
    state = (
        F.when(~ran, "skipped")
        .when(na, "na")
        .when(F.col("advisory"), F.when(full, "pass").otherwise("advice"))
        .when((F.col("unsure") > 0) & ~full, "warning")
        .otherwise(status(F.col("mean"), F.col("weight")))
    )
    counted = ran & ~na
    return at.select(
        "site_id", "check_id", "name", "category", "weight", "fixable", "advisory", "ord", state.alias("status"), F.col("mean").alias("score"),
        F.when(counted & ~F.col("advisory"), rounded(F.col("weight") - F.col("mean"), 1)).otherwise(F.lit(0.0)).alias("lost"),
        (counted & (F.col("unsure") > 0)).alias("inconclusive"), (counted & (F.col("guessed") > 0)).alias("predicted"),
        F.when(ran, F.when(na, F.col("opening")).otherwise(F.coalesce("common", "opening"))).otherwise(F.lit("")).alias("message"),
        F.when(counted, F.coalesce("advised", F.lit(""))).otherwise(F.lit("")).alias("recommendation"),
        F.when(ran, F.col("n")).otherwise(F.lit(0)).cast("long").alias("pages"), F.when(ran, F.col("losing")).otherwise(F.lit(0)).cast("long").alias("failing_pages"), F.when(ran, F.col("outs")).otherwise(F.lit(0)).cast("long").alias("excluded_pages"),
    )


#: Checks whose findings on excluded pages are advice: all of one, and those on who wrote it of the other.
ADVICE_ON_EXCLUDED = {"content.freshness": "", "content.author": "author attribution"}


def finding_groups(runs: DataFrame, rubric: DataFrame, excluded: DataFrame, locations: int = LOCATIONS) -> DataFrame:
    """(site_id, check_id, advice, place, message, n_locations, locations): equal findings of all pages, in the order first seen.

    locations: the first ones, as 'file:line'. What an advisory check finds is advice, before its own.
    """
    rows = _marked(normalised(runs, rubric), excluded)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("findings").alias("own")), F.struct(F.lit(1).alias("kind"), F.col("advice").alias("own")))
    rows = rows.select("site_id", "check_id", "advisory", "out", "seq", F.explode(kinds).alias("k")).select("site_id", "check_id", "advisory", "out", "seq", "k.kind", F.posexplode("k.own").alias("pos", "f"))
    told = F.lit(False)
    for check, words in ADVICE_ON_EXCLUDED.items():
        told = told | ((F.col("check_id") == check) & F.lower("f.message").contains(words))
    rows = rows.filter(~F.col("out") | ((F.col("kind") == 0) & told))
    rows = rows.select(
        "site_id", "check_id", ((F.col("kind") == 1) | F.col("out") | F.col("advisory")).alias("advice"),
        F.when(F.col("out"), 2).when(F.col("advisory") & (F.col("kind") == 0), 0).otherwise(1).alias("turn"), "seq", "pos",
        F.when(F.col("out"), F.concat(F.lit("Page kept out of search: "), F.col("f.message"))).otherwise(F.col("f.message")).alias("message"), F.col("f.file").alias("file"), F.col("f.line").alias("line"),
    )
    key = ["site_id", "check_id", "advice", "message"]
    heads = rows.groupBy(*key).agg(F.min(F.struct("turn", "seq", "pos")).alias("first"), F.count("file").alias("n_locations"))
    at = F.concat_ws(":", "file", "line")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("turn", "seq", "pos"))
    some = rows.filter("file is not null").withColumn("nth", nth).filter(F.col("nth") <= locations).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", at.alias("at")))), lambda x: x["at"]).alias("locations"))
    place = F.row_number().over(Window.partitionBy("site_id", "check_id", "advice").orderBy("first", "message"))
    out = heads.withColumn("place", place).join(some, key, "left")
    return out.select("site_id", "check_id", "advice", "place", "message", "n_locations", F.coalesce("locations", F.array().cast("array<string>")).alias("locations"))


def site_totals(states: DataFrame) -> DataFrame:
    """(site_id, total, available, percentage, grade, na_weight, skipped_weight); advisory checks aside."""
    own = ~F.col("advisory")
    weigh = lambda test: F.coalesce(F.sum(F.when(own & test, F.col("weight"))), F.lit(0)).cast("long")
    points = F.sum(F.when(own & ~F.col("status").isin("skipped", "na"), F.col("score").cast("decimal(10,1)")))
    sums = states.groupBy("site_id").agg(
        rounded(F.coalesce(points, F.lit(0)).cast("double")).cast("long").alias("total"), weigh(~F.col("status").isin("skipped", "na")).alias("available"),
        weigh(F.col("status") == "na").alias("na_weight"), weigh(F.col("status") == "skipped").alias("skipped_weight"),
    )
    share = F.when(F.col("available") > 0, rounded(F.col("total") / F.col("available") * 100)).otherwise(F.lit(0.0)).cast("long")
    return sums.withColumn("percentage", share).withColumn("grade", F.when(F.col("available") > 0, grade(F.col("percentage"))).otherwise(F.lit("")))


def category_totals(states: DataFrame) -> DataFrame:
    """(site_id, category, score, max, skipped); advisory checks aside."""
    gone = F.col("status").isin("skipped", "na")
    rows = states.filter("not advisory").groupBy("site_id", "category")
    sums = rows.agg(F.sum(F.when(~gone, F.col("score").cast("decimal(10,1)"))).alias("points"), F.sum(F.when(gone, 0).otherwise(F.col("weight"))).alias("max"), F.sum(F.when(gone, F.col("weight")).otherwise(0)).alias("skipped"))
    return sums.select("site_id", "category", rounded(F.coalesce("points", F.lit(0)).cast("double"), 1).alias("score"), "max", "skipped")


def escaped(text: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\|", r"\\|"), r"\r?\n", " ")


def _named(column: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), column)


def number(x: Column) -> Column:
    """Without a needless '.0'."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _in_line(rows: DataFrame, by: list[str], line: Column, name: str, most: int | None = None) -> DataFrame:
    """Lines of a site in one text, ordered; rows of a site are few (checks, or findings of a report)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*by, line.alias("line")))), lambda x: x["line"])
    lines = F.slice(lines, 1, most) if most else lines
    return rows.groupBy("site_id").agg(F.array_join(lines, "\n").alias(name))


def console_summaries(states: DataFrame) -> DataFrame:
    """(site_id, summary): score and grade, the worst checks, and what gave advice."""
    worst = states.filter("status in ('fail', 'warning')").select("site_id", (-F.col("lost")).alias("less"), "ord", F.concat(F.lit("- "), "name", F.lit(": -"), number(F.col("lost")), F.lit(" ("), _named(F.col("fixable"), FIXES), F.lit(")")).alias("said"))
    worst = _in_line(worst, ["less", "ord"], F.col("said"), "worst", WORST)
    advice = states.filter("status = 'advice'").groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("advised"))
    excluded = states.groupBy("site_id").agg(F.max("excluded_pages").alias("outs"))
    rows = site_totals(states).join(worst, "site_id", "left").join(advice, "site_id", "left").join(excluded, "site_id")
    head = F.concat(F.lit("Score "), F.col("total"), F.lit("/"), F.col("available"), F.lit(" ("), F.col("percentage"), F.lit("%, "), F.col("grade"), F.lit(")"))
    outs = F.when(F.col("outs") > 0, F.concat(F.lit("Not scored: "), F.col("outs"), F.lit(" page(s) kept out of search on purpose (noindex)")))
    advised = F.when(F.col("advised").isNotNull(), F.concat(F.lit("Advice, no points: "), F.col("advised")))
    return rows.select("site_id", F.concat_ws("\n", head, F.col("worst"), outs, advised).alias("summary"))


def reports(states: DataFrame, findings: DataFrame, notes: DataFrame) -> DataFrame:
    """(site_id, report): a Markdown report of each site; notes: (site_id, note) texts set before the summary."""
    cats = category_totals(states)
    order = F.array_position(F.array(*(F.lit(c) for c, _ in CATEGORIES)), F.col("category"))
    cell = F.when((F.col("max") == 0) & (F.col("skipped") > 0), F.lit("not evaluated")).otherwise(F.concat(number(F.col("score")), F.lit(" / "), F.col("max"), F.when(F.col("skipped") > 0, F.concat(F.lit(" ("), F.col("skipped"), F.lit(" pts n/a)"))).otherwise(F.lit(""))))
    table = _in_line(cats.withColumn("at", order), ["at"], F.concat(F.lit("| "), _named(F.col("category"), dict(CATEGORIES)), F.lit(" | "), cell, F.lit(" |")), "categories")

    shown = findings.filter(F.col("place") <= FINDINGS + 1)
    where = F.array_join(F.transform("locations", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    more = F.when(F.col("n_locations") > LOCATIONS, F.concat(F.lit(" and "), F.col("n_locations") - LOCATIONS, F.lit(" more"))).otherwise(F.lit(""))
    said = F.concat(F.lit("- "), escaped(F.col("message")), F.when(F.size("locations") > 0, F.concat(F.lit(" - "), where, more)).otherwise(F.lit("")))
    line = F.when(F.col("place") <= FINDINGS, said).otherwise(F.lit("- ...and more findings"))
    lists = shown.groupBy("site_id", "check_id", "advice").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    found = lists.filter("not advice").select("site_id", "check_id", F.col("lines").alias("found"))
    told = lists.filter("advice").select("site_id", "check_id", F.col("lines").alias("told"))
    rows = states.join(found, ["site_id", "check_id"], "left").join(told, ["site_id", "check_id"], "left")

    points = F.concat(number(F.col("score")), F.lit(" / "), F.col("weight"))
    flags = F.concat_ws(", ", _named(F.col("fixable"), FIXES), F.when(F.col("inconclusive"), F.lit("inconclusive")), F.when(F.col("predicted"), F.lit("predicted from config")))
    head = F.concat(F.lit("### "), _named(F.col("status"), MARKS), F.lit(" "), F.col("name"), F.lit(" - "), points, F.lit(" (-"), number(F.col("lost")), F.lit(")"))
    lost = F.when((F.col("pages") > 1) & (F.col("failing_pages") > 0), F.concat(F.lit("- Pages losing points: "), F.col("failing_pages"), F.lit(" of "), F.col("pages")))
    fix = F.when(F.col("recommendation") != "", F.concat(F.lit("\nFix: "), escaped(F.col("recommendation"))))
    issue = F.concat_ws("\n", head, F.lit(""), F.concat(F.lit("`"), F.col("check_id"), F.lit("` | "), flags), F.lit(""), escaped(F.col("message")), F.col("found"), lost, fix, F.lit(""))
    issues = _in_line(rows.filter("status in ('fail', 'warning')").select("site_id", (-F.col("lost")).alias("a"), (-F.col("weight")).alias("b"), "ord", issue.alias("said")), ["a", "b", "ord"], F.col("said"), "issues")
    hint = F.when((F.col("status") == "advice") & (F.col("recommendation") != ""), F.concat(F.lit("\nSuggestion: "), escaped(F.col("recommendation"))))
    tip = F.concat_ws("\n", F.concat(F.lit("### "), F.col("name")), F.lit(""), F.concat(F.lit("`"), F.col("check_id"), F.lit("`")), F.lit(""), F.col("told"), hint, F.lit(""))
    advice = _in_line(rows.filter("told is not null or status = 'advice'").select("site_id", "ord", tip.alias("said")), ["ord"], F.col("said"), "advice")
    own = F.when(F.col("status").isin("na", "skipped"), F.lit("-")).when(F.col("advisory"), F.lit("not scored")).otherwise(points)
    every = _in_line(rows.select("site_id", "ord", F.concat(F.lit("| "), "name", F.lit(" | "), _named(F.col("status"), MARKS), F.lit(" | "), own, F.lit(" | "), _named(F.col("fixable"), FIXES), F.lit(" |")).alias("said")), ["ord"], F.col("said"), "checks")
    noted = notes.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("note")), lambda n: F.concat(F.lit("> "), n, F.lit("\n"))), "\n").alias("notes"))

    whole = site_totals(states)
    for part in (table, issues, advice, every, noted):
        whole = whole.join(part, "site_id", "left")
    score = F.when(F.col("available") == 0, F.lit("**No score: only advice checks ran.** Advice costs no points.")).otherwise(F.concat(F.lit("**Score: "), F.col("total"), F.lit(" / "), F.col("available"), F.lit(" ("), F.col("percentage"), F.lit("%) - "), F.col("grade"), F.lit("**")))
    na = F.when(F.col("na_weight") > 0, F.concat(F.lit("\n"), F.col("na_weight"), F.lit(" points do not apply to this site and are left out of the total.")))
    report = F.concat_ws(
        "\n", F.lit("# Site report\n"), F.col("notes"), F.lit("## Summary\n"), score, na, F.lit("\n| Category | Score |\n|---|---:|"), F.col("categories"),
        F.lit("\n## Issues by points lost\n"), F.coalesce("issues", F.lit("Nothing to fix. Every evaluated check passed.\n")), F.when(F.col("advice").isNotNull(), F.concat(F.lit("## Advice (no points)\n\n"), F.col("advice"))),
        F.lit("## All checks\n\n| Check | Status | Score | Fix |\n|---|---|---:|---|"), F.col("checks"), F.lit(""),
    )
    return whole.select("site_id", report.alias("report"))


def fix_lists(sites: DataFrame, rubric: DataFrame) -> DataFrame:
    """(site_id, report): for sites whose pages cannot be read, what to look at, by category and weight."""
    points = dict((r["category"], r["max"]) for r in rubric_totals(rubric).collect())
    lines = ["## Fix list", ""]
    rows = sorted(rubric.collect(), key=lambda r: (-r["weight"], r["ord"]))
    for key, name in CATEGORIES:
        lines += [f"### {name} ({points.get(key, 0)} pts)", ""]
        lines += [f"- [ ] **{r['name']}** ({r['weight']} pts{', only if you expose an API or agent' if r['conditional'] else ''})" for r in rows if r["category"] == key] + [""]
    return sites.filter("mode = 'report-only'").select("site_id", F.lit("\n".join(lines)).alias("report"))


def payloads(states: DataFrame, findings: DataFrame) -> DataFrame:
    """(site_id, payload): totals, categories and checks with their findings, as JSON."""
    found = findings.groupBy("site_id", "check_id").agg(F.array_sort(F.collect_list(F.struct("advice", "place", "message", "n_locations", "locations"))).alias("findings"))
    checks = states.join(found, ["site_id", "check_id"], "left").groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("ord", "check_id", "status", "score", "weight", "lost", "inconclusive", "predicted", "message", "recommendation", "pages", "failing_pages", "findings"))).alias("checks"))
    cats = category_totals(states).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("category", "score", "max", "skipped"))).alias("categories"))
    rows = site_totals(states).join(cats, "site_id").join(checks, "site_id")
    return rows.select("site_id", F.to_json(F.struct("total", "available", "percentage", "grade", "na_weight", "skipped_weight", "categories", "checks")).alias("payload"))
