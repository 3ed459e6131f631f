"""Site files as tables: robots rules, sitemap entries, header rules.

Each is a text per site, split into lines and read by windows over the lines of one site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(files: DataFrame) -> DataFrame:
    """(site_id, line, raw) from (site_id, text)."""
    return files.select("site_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("at", "raw")).select("site_id", (F.col("at") + 1).alias("line"), "raw")


def robots_lines(files: DataFrame) -> DataFrame:
    """(site_id, line, key, value, group): group counts the runs of user-agent lines so far; 0 before any."""
    form = r"^([A-Za-z-]+)\s*:\s*(.*)$"
    rows = numbered_lines(files).select("site_id", "line", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("s")).filter(F.col("s").rlike(form))
    rows = rows.select("site_id", "line", F.lower(F.regexp_extract("s", form, 1)).alias("key"), F.trim(F.regexp_extract("s", form, 2)).alias("value"))
    by_line = Window.partitionBy("site_id").orderBy("line")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(by_line), F.lit("")) != "user-agent")
    return rows.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(by_line)).drop("begins")


def robots_agents(lines: DataFrame) -> DataFrame:
    return lines.filter("key = 'user-agent'").select("site_id", "group", F.lower("value").alias("agent")).distinct()


def robots_rules(lines: DataFrame) -> DataFrame:
    """(site_id, group, allow, path, line) of rules that stand in a group; an empty disallow is no rule."""
    rules = lines.filter("key in ('allow', 'disallow') and group > 0")
    return rules.select("site_id", "group", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"), "line").filter("path <> ''")


def crawl_delays(lines: DataFrame) -> DataFrame:
    """(site_id, group, delay): a group's last number."""
    number = F.regexp_extract("value", r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")
    return lines.filter("key = 'crawl-delay' and group > 0").withColumn("delay", number).filter("delay is not null").groupBy("site_id", "group").agg(F.max_by("delay", "line").alias("delay"))


def pattern_regex(pattern: Column) -> Column:
    """A robots path pattern as a regular expression: '*' is anything, a last '$' ends the path."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(body, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def sitemap_locs(files: DataFrame) -> DataFrame:
    """(site_id, is_index, url) from (site_id, text): one row per <loc>."""
    loc = r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\s\]]+)"
    found = F.regexp_extract_all("text", F.lit(loc), F.lit(1))
    return files.select("site_id", F.col("text").rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"), F.explode(found).alias("url")).withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&")))


def header_rules(files: DataFrame) -> DataFrame:
    """(site_id, rule_no, pattern, name, value) from a text of path lines and indented 'Name: value' lines."""
    rows = numbered_lines(files).filter("trim(raw) <> '' and not trim(raw) like '#%'")
    own = F.when(~F.col("raw").rlike(r"^\s"), F.trim("raw"))
    by_line = Window.partitionBy("site_id").orderBy("line")
    rows = rows.withColumn("pattern", F.last(own, ignorenulls=True).over(by_line))
    form = r"^\s+([^:\s][^:]*?)\s*:\s*(.*?)\s*$"
    return rows.filter(F.col("raw").rlike(form) & F.col("pattern").isNotNull()).select("site_id", F.col("line").alias("rule_no"), "pattern", F.lower(F.regexp_extract("raw", form, 1)).alias("name"), F.regexp_extract("raw", form, 2).alias("value"))


def header_pattern_regex(pattern: Column) -> Column:
    """A header rule's path: '*' and ':name*' are anything, ':name' one segment."""
    escaped = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    named = F.regexp_replace(F.regexp_replace(escaped, r":[A-Za-z_]\w*\*", "*"), r":[A-Za-z_]\w*", "[^/]+")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(named, r"\\\(\.\*\\\)|\\\(\\\.\*\\\)", "*"), r"\*", ".*"), F.lit("$"))
