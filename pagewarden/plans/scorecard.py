"""Page results to check, category and site scores.

Pages are parsed and checked in narrow projections; the one shuffle is the grouping by site and check,
after partial aggregation, so one huge site is no hot task. Each level rounds before the next adds up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions.nodes import dealt
from pagewarden.functions.text import rounded
from pagewarden.operators.access import page_intents
from pagewarden.operators.checks import Check, fact, url_path, with_check_facts, with_facts
from pagewarden.operators.readiness import ALL_PAGE_CHECKS, state_of
from pagewarden.sources.batches import small_batches
from pagewarden.sources.html import parsed, parsed_page

#: Least percentage and name of each grade.
GRADES = ((90, "Ready for AI"), (80, "Nearly Optimized"), (70, "Needs Work"), (60, "Major Gaps"), (0, "Not AEO Ready"))


#: Fixed value: the order in which checks are reported.
CHECK_ORDER = (
    "ai-access.bot-crawlability", "ai-access.llms-txt", "ai-access.content-signals", "crawlability.indexability", "crawlability.sitemap", "crawlability.https", "crawlability.http-behavior",
    "structured-data.present", "structured-data.valid", "meta.title", "meta.description", "meta.open-graph", "meta.twitter-cards", "meta.language", "meta.viewport",
    "content.headings", "content.quality", "content.freshness", "content.author", "content.image-alt", "content.internal-links", "content.accessibility",
    "agent-readiness.server-rendered", "agent-readiness.markdown", "agent-readiness.controls", "agent-readiness.protocols",
)


def in_order(check_id: Column) -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in CHECK_ORDER)), check_id)


def site_of(url: Column) -> Column:
    """A page's site: its host, in lower case."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


#: Bytes of input up to which pages are dealt to all cores before they are parsed.
SMALL_INPUT = 256 << 20


def spread(pages: DataFrame) -> DataFrame:
    """A small table dealt out evenly, as its file may be one split; a large one has more splits than cores and is left as it is."""
    if int(pages._jdf.queryExecution().analyzed().stats().sizeInBytes()) > SMALL_INPUT:
        return pages
    return pages.repartition(pages.sparkSession.sparkContext.defaultParallelism)


def with_nodes(pages: DataFrame, author: bool = False) -> DataFrame:
    """site_id, page_id, url, robots_header, nodes (and author); the parse in a projection of its own.

    robots_header: the values of X-Robots-Tag that a page is sent with, where the pages have such a column.
    """
    small_batches(pages.sparkSession)
    pages = spread(pages)
    sent = F.col("robots_header") if "robots_header" in pages.columns else F.lit(None)
    own = pages.select(site_of(F.col("url")).alias("site_id"), "page_id", "url", sent.cast("array<string>").alias("robots_header"), (parsed_page(F.col("html"), F.col("url")) if author else parsed(F.col("html"))).alias("nodes"))
    return own.select("site_id", "page_id", "url", "robots_header", "nodes.nodes", "nodes.author") if author else own


def status(score: Column, weight: Column) -> Column:
    share = F.when(weight > 0, score / weight * 100).otherwise(F.lit(0.0))
    return F.when(share >= 80, "pass").when(share >= 50, "warning").otherwise("fail")


def grade(percentage: Column) -> Column:
    out = F.lit("")
    for least, name in reversed(GRADES):
        out = F.when(percentage >= least, name).otherwise(out)
    return out


INDEXABILITY = "crawlability.indexability"


def page_results(pages: DataFrame, checks: Sequence[Check] = ALL_PAGE_CHECKS, listed: DataFrame | None = None) -> DataFrame:
    """site_id, page_id, check_id, category, weight, score: one row per page and check.

    listed: keys of the pages in sitemaps (site_id, key); given them, a page that is kept out of search on
    purpose has all points for indexability. A stream of pages goes without.
    """
    nodes = with_check_facts(with_facts(with_nodes(pages, author=any(c.id == "content.author" for c in checks))), checks)
    index = [c for c in checks if c.id == INDEXABILITY]
    meant = listed is not None and bool(index)
    score = lambda c: F.coalesce(F.least(F.greatest(F.floor(c.score()), F.lit(0)), F.lit(c.weight)), F.lit(0)).cast("int").alias("score")
    flag = lambda c: [(state_of(fact(INDEXABILITY)("said"))["for_all"] if c.id == INDEXABILITY else F.lit(False)).alias("for_all")] if meant else []
    with dealt():
        entries = F.array(*(F.struct(F.lit(c.id).alias("check_id"), F.lit(c.category).alias("category"), F.lit(c.weight).alias("weight"), score(c), *flag(c)) for c in checks))
    out = nodes.select("site_id", "page_id", F.inline(entries))  # in one step: of a column, its size would be asked in a filter, and all scores computed again
    if not meant:
        return out
    intents = page_intents(pages.select(site_of(F.col("url")).alias("site_id"), "page_id", url_path().alias("url_path")), listed)
    return with_intent(out, intents)


def with_intent(results: DataFrame, intents: DataFrame) -> DataFrame:
    """Results (with for_all) in which pages that are kept out of search on purpose have all points for indexability.

    intents: operators.access.page_intents. One join, so that pages are parsed once; its rows are numbers and names.
    """
    told = (F.col("check_id") == INDEXABILITY) & F.coalesce("for_all", F.lit(False))
    kept_out = ~F.coalesce("listed", F.lit(False)) & ~F.col("homepage") & ~F.col("single")
    rows = results.join(intents.filter(kept_out).select("site_id", "page_id", F.lit(True).alias("meant")), ["site_id", "page_id"], "left")
    return rows.select("site_id", "page_id", "check_id", "category", "weight", F.when(told & F.col("meant"), F.col("weight")).otherwise(F.col("score")).alias("score"))


def excluding(results: DataFrame, excluded: DataFrame) -> DataFrame:
    """Results without the pages in `excluded` (site_id, page_id): kept out of search on purpose, they are no defect."""
    return results.join(excluded.select("site_id", "page_id"), ["site_id", "page_id"], "left_anti")


def check_summary(results: DataFrame) -> DataFrame:
    """Per site and check: the mean over pages to one decimal, its status, and what was lost."""
    means = results.groupBy("site_id", "check_id", "category", "weight").agg(F.sum("score").alias("total"), F.count("*").alias("pages"), F.count_if(F.col("score") < F.col("weight")).alias("failing_pages"))
    score = rounded(F.col("total") / F.col("pages"), 1)
    return means.select("site_id", "check_id", "category", "weight", score.alias("score"), "pages", "failing_pages").withColumn("status", status(F.col("score"), F.col("weight"))).withColumn("lost", rounded(F.col("weight") - F.col("score"), 1))


def category_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("site_id", "category").agg(rounded(F.sum(F.col("score").cast("decimal(10,1)")).cast("double"), 1).alias("score"), F.sum("weight").alias("max"))


def site_summary(checks: DataFrame) -> DataFrame:
    """Per site: total of available points, percentage and grade."""
    sums = checks.groupBy("site_id").agg(rounded(F.sum(F.col("score").cast("decimal(10,1)")).cast("double")).cast("long").alias("total"), F.sum("weight").alias("available"), F.max("pages").alias("pages"))
    out = sums.withColumn("percentage", F.when(F.col("available") > 0, rounded(F.col("total") / F.col("available") * 100)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("grade", grade(F.col("percentage")))


def problems(checks: DataFrame, most: int = 5) -> DataFrame:
    """Per site, the checks that lost most: lost and weight descending, then in the order of reports."""
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("lost"), F.desc("weight"), in_order(F.col("check_id"))))
    return checks.filter("lost > 0").withColumn("place", rank).filter(F.col("place") <= most).select("site_id", "place", "check_id", "lost", "weight", "status")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two check summaries side by side: what each check gained; a full outer join on site and check."""
    key = ["site_id", "check_id"]
    return before.select(*key, F.col("score").alias("score_before")).join(after.select(*key, F.col("score").alias("score_after")), key, "full").withColumn("gained", rounded(F.coalesce("score_after", F.lit(0.0)) - F.coalesce("score_before", F.lit(0.0)), 1))
