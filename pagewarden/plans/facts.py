"""Facts of pages and sites, and llms.txt drafts made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions.nodes import first, having, meta, text_content, visible_text
from pagewarden.functions.text import SPACE, collapsed, words
from pagewarden.operators.checks import json_ld_blocks, resolved, main_candidates, title_text, url_path
from pagewarden.sources.structured_data import structured_data

#: Hosts of social profiles, logo files by priority, first path segments of pages that are optional reading.
SOCIAL_HOSTS = r"(?i)(^|\.)(twitter\.com|x\.com|linkedin\.com|github\.com|facebook\.com|instagram\.com|youtube\.com|mastodon\.social|bsky\.app|threads\.net|tiktok\.com|pinterest\.com|medium\.com|dev\.to|producthunt\.com)$"
LOGOS = tuple(f"{d}logo.{e}" for d in ("", "img/", "images/", "assets/") for e in ("svg", "png", "jpg", "webp")) + ("apple-touch-icon.png",)
OPTIONAL = r"(?i)^(privacy|terms|legal|cookies?|imprint|impressum|disclaimer|sitemap|search|login|signin|signup|register|account|cart|checkout|thank-?you|tags?|categor(y|ies)|page)$"
SUMMARY, OPENING, LINK, LINKS = 300, 400, 160, 40


def _tags(prefix: str) -> Column:
    """A map of a prefix's meta tags; the last of a name counts."""
    key = lambda n: F.coalesce(F.when(n["attrs"]["property"].startswith(prefix), n["attrs"]["property"]), F.when(n["attrs"]["name"].startswith(prefix), n["attrs"]["name"]))
    found = having("meta", also=lambda n: key(n).isNotNull())
    pairs = F.transform(found, lambda n: F.struct(F.substring(key(n), len(prefix) + 1, 1000).alias("k"), n["attrs"]["content"].alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def page_facts(pages: DataFrame) -> DataFrame:
    """One row of facts per page of (site_id, page_id, url, nodes); a page without nodes has nulls and empty lists."""
    clean = lambda n: collapsed(F.coalesce(text_content(n), F.lit("")))
    rows = pages.select("*", main_candidates().alias("candidates"), structured_data(*json_ld_blocks()).alias("ld"))
    wanted = F.try_element_at(F.array_sort(F.filter("candidates", lambda c: c["rank"].isin(0, 1, 7))), F.lit(1))
    rows = rows.withColumn("main", F.get("nodes", wanted["id"]))
    inside = lambda n: (n["id"] > F.col("main.id")) & (n["id"] <= F.col("main.end"))
    paragraph = F.try_element_at(F.filter(F.transform(having("p", also=inside), clean), lambda t: F.size(F.split(t, " ")) >= 8), F.lit(1))
    alt = lambda n: collapsed(F.coalesce(n["attrs"]["alt"], F.lit("")))
    hrefs = F.transform(having("a", also=lambda n: n["attrs"]["href"].isNotNull()), lambda n: resolved(n["attrs"]["href"], F.col("url")))
    social = F.filter(hrefs, lambda u: F.coalesce(F.try_parse_url(u, F.lit("HOST")).rlike(SOCIAL_HOSTS) & (F.length(F.try_parse_url(u, F.lit("PATH"))) > 1), F.lit(False)))
    head = first(having("head"))
    last = F.array_max(F.transform(F.filter("nodes", lambda n: (n["id"] >= head["id"]) & (n["id"] <= head["end"])), lambda n: n["line"]))
    named = lambda key, by: first(having("meta", also=lambda n: n["attrs"][by] == key))["attrs"]["content"]
    empty = lambda c: F.nullif(c, F.lit(""))
    return rows.select(
        "site_id", "page_id", "url", url_path().alias("url_path"), first(having("html"))["attrs"]["lang"].alias("lang"), empty(title_text()).alias("title"), first(having("title"))["line"].alias("title_line"),
        meta("description")["attrs"]["content"].alias("description"), first(having("link", also=lambda n: F.lower(n["attrs"]["rel"]) == "canonical"))["attrs"]["href"].alias("canonical"),
        F.transform(having("h1"), clean).alias("h1"),
        F.transform(having("h1", "h2", "h3", "h4", "h5", "h6"), lambda n: F.struct(F.substring(n["tag"], 2, 1).cast("int").alias("level"), F.substring(clean(n), 1, 120).alias("text"), n["line"].alias("line"))).alias("headings"),
        F.substring(paragraph, 1, 400).alias("first_paragraph"), F.coalesce(F.size(words(visible_text(F.col("main")))), F.lit(0)).alias("words"), _tags("og:").alias("og"), _tags("twitter:").alias("twitter"),
        F.coalesce("ld.top", F.array().cast("array<string>")).alias("types"),
        F.transform(having("img", also=lambda n: alt(n) == ""), lambda n: F.struct(n["attrs"]["src"].alias("src"), n["line"].alias("line"), n["attrs"]["alt"].isNotNull().alias("blank"))).alias("images_without_alt"),
        F.coalesce(empty(named("article:published_time", "property")), first(having("time", also=lambda n: n["attrs"]["datetime"].isNotNull()))["attrs"]["datetime"]).alias("published"), empty(named("article:modified_time", "property")).alias("modified"),
        empty(named("author", "name")).alias("author"), F.array_distinct(social).alias("social_links"), head["line"].alias("head_line"), last.alias("head_last_line"),
    )


def brands(facts: DataFrame, base_urls: DataFrame) -> DataFrame:
    """(site_id, brand): og:site_name of the first page that has it, else the ending that most titles share, else the homepage's title.

    Of endings equally often the one that is the domain's name counts, then the shorter one.
    """
    said = facts.select("site_id", "page_id", "url_path", "title", F.try_element_at("og", F.lit("site_name")).alias("named"), F.trim(F.regexp_extract("title", r"\s[|\-–—·:]\s([^|:]{2,40})$", 1)).alias("ending"))
    own = said.filter("named <> ''").groupBy("site_id").agg(F.min_by("named", "page_id").alias("named"))
    counts = said.filter("ending <> ''").groupBy("site_id", "ending").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).join(base_urls, "site_id", "left")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    host = plain(F.split(F.regexp_replace(F.coalesce("base_url", F.lit("")), r"^https?://(www\.)?", ""), r"\.")[0])
    fits = ((host != "") & (plain(F.col("ending")) == host)).cast("int")
    best = counts.groupBy("site_id").agg(F.max(F.struct("n", fits.alias("fits"), (-F.length("ending")).alias("short"), (-F.col("first")).alias("early"), "ending"))["ending"].alias("ending"))
    home = said.filter("url_path = '/'").groupBy("site_id").agg(F.min_by("title", "page_id").alias("title"))
    rows = facts.select("site_id").distinct().join(own, "site_id", "left").join(best, "site_id", "left").join(home, "site_id", "left")
    return rows.select("site_id", F.coalesce("named", "ending", "title").alias("brand"))


def logos(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(site_id, path, url_path): the first logo file, by folder (site_id, folder, priority) and then by name."""
    tries = folders.select("site_id", "folder", "priority", F.posexplode(F.array(*(F.lit(n) for n in LOGOS))).alias("nth", "name"))
    tries = tries.withColumn("path", F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name")))
    best = tries.join(files.select("site_id", "path"), ["site_id", "path"]).groupBy("site_id").agg(F.min(F.struct("priority", "nth", "path", "name")).alias("f"))
    return best.select("site_id", "f.path", F.concat(F.lit("/"), "f.name").alias("url_path"))


def shortened(text: Column, most: int) -> Column:
    """Text of at most `most` characters, cut at a word, with dots where it was cut."""
    t = collapsed(F.coalesce(text, F.lit("")))
    cut = F.regexp_replace(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", ""), "[,;:]$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("...")))


def title_case(segment: Column) -> Column:
    """Words with a capital first letter, the rest as it is."""
    parts = F.split(F.regexp_replace(segment, "[-_]+", " "), " ")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


def without_brand(title: Column, brand: Column) -> Column:
    """A title without a separator and the brand at its end, unless that is all."""
    t = collapsed(F.coalesce(title, F.lit("")))
    bare = F.when(t.endswith(brand), F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(brand)), rf"{SPACE}*[|\-–—·:]{SPACE}*$", "")).otherwise(t)
    changed = F.when(F.length(bare) < F.length(t) - F.length(brand), F.trim(bare)).otherwise(t)
    return F.when(brand.isNull() | (brand == ""), t).otherwise(F.coalesce(F.nullif(changed, F.lit("")), t))


def llms_drafts(facts: DataFrame, site_brands: DataFrame, base_urls: DataFrame, links: int = LINKS) -> DataFrame:
    """(site_id, llms): a draft of llms.txt: brand, summary, and links to pages by first path segment, optional reading last."""
    rows = facts.join(site_brands, "site_id", "left").join(base_urls, "site_id", "left")
    text = F.coalesce(F.nullif("description", F.lit("")), F.nullif(F.try_element_at("og", F.lit("description")), F.lit("")), F.col("first_paragraph"))
    home = rows.filter("url_path = '/'").groupBy("site_id").agg(F.min(F.struct("page_id", text.alias("summary"), "first_paragraph")).alias("home")).select("site_id", "home.summary", F.col("home.first_paragraph").alias("opening"))
    segments = F.filter(F.split("url_path", "/"), lambda s: s != "")
    first_ = F.regexp_replace(F.coalesce(F.get(segments, F.lit(0)), F.lit("")), r"(?i)\.html?$", "")
    name = F.coalesce(F.nullif(F.try_element_at("h1", F.lit(1)), F.lit("")), F.nullif(without_brand(F.col("title"), F.col("brand")), F.lit("")), title_case(first_))
    link = F.concat(F.coalesce("base_url", F.lit("")), "url_path")
    line = F.concat(F.lit("- ["), F.regexp_replace(collapsed(name), r"[\[\]]", ""), F.lit("]("), link, F.lit(")"), F.when(text.isNotNull(), F.concat(F.lit(": "), shortened(text, LINK))).otherwise(F.lit("")))
    section = F.when(first_.rlike(OPTIONAL), "Optional").when(F.size(segments) > 1, title_case(first_)).otherwise("Pages")
    listed = rows.filter("url_path <> '/'").select("site_id", "page_id", section.alias("section"), line.alias("line"))
    place = F.row_number().over(Window.partitionBy("site_id", "section").orderBy("page_id"))
    sizes = listed.groupBy("site_id", "section").agg(F.count("*").alias("n"))
    kept = listed.withColumn("place", place).filter((F.col("place") <= links) | (F.col("section") == "Optional"))
    blocks = kept.groupBy("site_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines")).join(sizes, ["site_id", "section"])
    more = F.when((F.col("n") > links) & (F.col("section") != "Optional"), F.concat(F.lit("\n- ...and "), F.col("n") - links, F.lit(" more (trim this list to the most useful pages)"))).otherwise(F.lit(""))
    rank = F.when(F.col("section") == "Pages", 0).when(F.col("section") == "Optional", 2).otherwise(1)
    blocks = blocks.select("site_id", F.struct(rank.alias("rank"), "section", F.concat(F.lit("## "), "section", F.lit("\n\n"), "lines", more, F.lit("\n")).alias("block")).alias("b"))
    body = blocks.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n").alias("body"))
    whole = facts.select("site_id").distinct().join(site_brands, "site_id", "left").join(home, "site_id", "left").join(body, "site_id", "left")
    summary = F.coalesce(shortened(F.nullif("summary", F.lit("")), SUMMARY), F.lit("TODO: one sentence on what this site is and who it is for."))
    summary = F.when(F.col("summary").isNull(), F.lit("TODO: one sentence on what this site is and who it is for.")).otherwise(summary)
    opening = F.when(F.col("opening").isNotNull() & (F.col("opening") != F.coalesce("summary", F.lit(""))), F.concat(shortened(F.col("opening"), OPENING), F.lit("\n")))
    return whole.select("site_id", F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("brand", F.lit("Site name")), F.lit("\n")), F.concat(F.lit("> "), summary, F.lit("\n")), opening, F.col("body")).alias("llms"))


def facts_payloads(facts: DataFrame, site_brands: DataFrame, site_logos: DataFrame) -> DataFrame:
    """(site_id, page_id, payload): a page's facts as JSON, with its site's brand and logo. One row a page: sites have no bound."""
    rows = facts.join(site_brands, "site_id", "left").join(site_logos.select("site_id", F.col("path").alias("logo")), "site_id", "left")
    return rows.select("site_id", "page_id", F.to_json(F.struct(*(c for c in rows.columns if c not in ("site_id", "page_id")))).alias("payload"))


def social_profiles(facts: DataFrame) -> DataFrame:
    """(site_id, link): social profiles that a site's pages link to, each once."""
    return facts.select("site_id", F.explode("social_links").alias("link")).distinct()
