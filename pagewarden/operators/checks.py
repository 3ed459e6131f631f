"""Page checks: each is one expression over a page's nodes that gives its score.

A check's score is floored and held between 0 and its weight when results are made (plans.scorecard).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions.nodes import bound, dealt, elements, first, having, meta, nodes, text_content, visible_text, with_elements
from pagewarden.functions.text import SPACE, collapsed, rounded, trimmed, units, words
from pagewarden.sources.structured_data import structured_data


@dataclass(frozen=True)
class Check:
    """An id, its category and weight, the score before it is floored, and facts that it reads.

    facts: columns that are computed once, in a projection of their own, under names that `fact` gives.
    """

    id: str
    category: str
    weight: int
    score: Callable[[], Column]
    facts: Callable[[], dict[str, Column]] = dict


def fact(check_id: str) -> Callable[[str], Column]:
    """The columns of a check's facts by name."""
    return lambda name: F.col(f"`{check_id}/{name}`")


def with_check_facts(pages: DataFrame, checks: Sequence[Check]) -> DataFrame:
    with dealt():
        own = [c.alias(f"{check.id}/{k}") for check in checks for k, c in check.facts().items()]
    return pages.select("*", *own) if own else pages


def _less(start: float, *costs: Column) -> Column:
    total = F.lit(float(start))
    for c in costs:
        total = total - c
    return F.greatest(F.lit(0.0), total)


def _bands(x: Column, *bands: tuple[Column, float]) -> Column:
    """The value of the first band whose test holds, else 0."""
    out = None
    for test, value in bands:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(0.0))


def _if(test: Column, cost: float) -> Column:
    return F.when(test, F.lit(float(cost))).otherwise(F.lit(0.0))


def title() -> Column:
    return F.col("title")


def title_text() -> Column:
    return F.coalesce(collapsed(text_content(first(having("title")))), F.lit(""))

#: Titles that say nothing.
GENERIC_TITLES = "home|welcome|untitled|new page|page|document|index|test|website|my website|my blog|blog|site|my site|homepage"


def title_score() -> Column:
    """Up to 5: length bands, generic words, separators."""
    text = title()
    n = units(text)
    separators = F.regexp_count(text, F.lit(rf"(?:^|{SPACE})[-|–—·:](?={SPACE}|$)|:(?={SPACE})"))
    length = _bands(n, (n < 40, 2.0), (n < 50, 0.5), (n > 70, 1.5), (n > 60, 0.5))
    return F.when(n == 0, F.lit(0.0)).otherwise(_less(5, length, _if(text.rlike(f"(?i)^({GENERIC_TITLES})$"), 2), _if((n < 20) & (separators == 0), 0.5), _if(separators > 3, 0.5)))


#: How descriptions that say nothing begin.
GENERIC_DESCRIPTIONS = "^welcome to|^this is a|^this page|^description$|^lorem ipsum|^todo|^placeholder|^my website|^my blog|^my site|^about us$|^contact us$|^contact$|^services$|^products$|^home page|^homepage$|^default description|^add description here|^enter description|^website description|^page description"


def description_score() -> Column:
    """Up to 5: length bands, generic openings, a copy of the title, a word repeated too often."""
    raw = F.coalesce(meta("description")["attrs"]["content"], F.lit(""))
    text = trimmed(raw)
    n = units(text)
    length = _bands(n, (n < 70, 2.0), (n < 120, 1.0), (n > 170, 1.0), (n > 160, 0.5))
    tokens = F.split(F.lower(raw), f"{SPACE}+")
    long = F.filter(tokens, lambda w: units(w) > 3)
    most = F.array_max(F.transform(F.array_distinct(long), lambda w: F.size(F.filter(long, lambda x: x == w))))
    return F.when(n == 0, F.lit(0.0)).otherwise(_less(5, length, _if(text.rlike(f"(?i){GENERIC_DESCRIPTIONS}"), 2), _if(F.lower(text) == F.lower(title()), 1), _if((F.coalesce(most, F.lit(0)) > 3) & (F.size(tokens) > 10), 0.5)))


def viewport_score() -> Column:
    """Up to 3: width=device-width, and an initial scale of 1."""
    tag = meta("viewport")
    pairs = F.transform(F.split(F.coalesce(tag["attrs"]["content"], F.lit("")), "[,;]"), lambda p: F.split(p, "="))

    def setting(key: str) -> Column:
        own = F.filter(pairs, lambda p: F.lower(trimmed(p[0])) == key)
        return F.when(F.size(own) > 0, F.coalesce(trimmed(F.get(F.element_at(own, -1), F.lit(1))), F.lit("")))

    width, scale = setting("width"), setting("initial-scale")
    number = F.regexp_extract(F.coalesce(scale, F.lit("")), r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    wide = F.when(F.lower(width) == "device-width", F.lit(0.0)).when(width.isNotNull(), F.lit(1.5)).otherwise(F.lit(1.0))
    scaled = F.when(scale.isNull(), F.lit(0.5)).when(F.coalesce(number.try_cast("double") == 1.0, F.lit(False)), F.lit(0.0)).otherwise(F.lit(0.25))
    return F.when(tag.isNull(), F.lit(0.0)).otherwise(_less(3, wide, scaled))


def headings() -> Column:
    return having("h1", "h2", "h3", "h4", "h5", "h6")


#: Headings that say nothing.
GENERIC_HEADINGS = ("introduction", "overview", "welcome", "about", "more", "info", "content", "section", "chapter", "home")


def heading_skips() -> Column:
    """How often a heading is more than one level below the one before it."""
    levels = F.transform(headings(), lambda h: F.substring(h["tag"], 2, 1).cast("int"))
    return F.when(F.size(levels) < 2, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.size(levels) - 1), lambda i: F.get(levels, i) > F.get(levels, i - 1) + 1)))


def headings_score() -> Column:
    """Up to 8: one h1, no skipped level, few generic headings."""
    ones = F.size(having("h1"))
    named = F.transform(headings(), lambda h: trimmed(F.lower(text_content(h))))
    generic = F.size(F.filter(named, lambda t: (units(t) < 3) | t.isin(*GENERIC_HEADINGS)))
    cost = F.when(ones == 0, F.lit(3.0)).when(ones > 1, F.lit(2.0)).otherwise(F.lit(0.0))
    return F.when(F.size(headings()) == 0, F.lit(0.0)).otherwise(_less(8, cost, F.least(F.lit(2), heading_skips()), _if(generic > 3, 1)))


def image_alt_score() -> Column:
    """Up to 5: the share of images, decorative ones aside, that have a text."""
    blank = lambda n, k: trimmed(F.coalesce(n["attrs"][k], F.lit(""))) == ""
    quiet = lambda n: F.lower(trimmed(F.coalesce(n["attrs"]["role"], F.lit("")))).isin("presentation", "none") | (F.lower(trimmed(F.coalesce(n["attrs"]["aria-hidden"], F.lit("")))) == "true")
    images = having("img", also=lambda n: ~(n["attrs"]["alt"].isNotNull() & blank(n, "alt") & quiet(n)))
    share = rounded(F.size(F.filter(images, lambda n: ~blank(n, "alt"))) / F.nullif(F.size(images), F.lit(0)) * 100)
    return F.coalesce(rounded(share / 100 * 5), F.lit(5.0))


#: Link texts that say nothing.
GENERIC_ANCHORS = ("click here", "here", "read more", "more", "link", "learn more", "this", "this link", "click", "go", "see more", "view", "details", "info")


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def internal_links() -> Column:
    """Internal links as structs (nav, generic, href, text, line)."""

    def inside(n: Column) -> Column:
        href = trimmed(F.coalesce(n["attrs"]["href"], F.lit("")))
        absolute = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.lit("http:"), href))
        own = F.when(absolute.isNotNull(), _host(absolute) == _host(F.col("url"))).otherwise(~href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
        return (href != "") & ~href.rlike(r"^(mailto:|tel:|javascript:|#)") & own

    def named(n: Column) -> Column:
        blank = lambda c: F.nullif(trimmed(F.coalesce(c, F.lit(""))), F.lit(""))
        image = F.try_element_at(F.filter(F.slice(nodes(), n["id"] + 2, n["end"] - n["id"]), lambda x: (x["tag"] == "img") & blank(x["attrs"]["alt"]).isNotNull()), F.lit(1))
        text = F.coalesce(F.nullif(collapsed(visible_text(n)), F.lit("")), blank(n["attrs"]["aria-label"]), blank(image["attrs"]["alt"]), blank(n["attrs"]["title"]), F.lit(""))
        low = F.lower(text)
        return F.struct(n["nav"].alias("nav"), ((units(low) < 2) | low.isin(*GENERIC_ANCHORS)).alias("generic"), trimmed(n["attrs"]["href"]).alias("href"), text.alias("text"), n["line"].alias("line"))

    return F.transform(having("a", also=inside), named)


def internal_links_score() -> Column:
    """Up to 4: enough links in the content, with texts that say where they lead."""
    links = F.col("links")
    content = F.filter(links, lambda x: ~x["nav"])
    few = F.when(F.size(links) == 0, F.lit(3.0)).when((F.size(content) < 3) & (F.size(links) < 5), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), rounded(_less(4, few, F.least(F.size(F.filter(content, lambda x: x["generic"])) * 0.25, F.lit(1.0))), 1))


#: Word counts (minimum, recommended, excellent) by page type.
WORD_COUNTS = {
    "article": (500, 800, 1500),
    "blog": (400, 600, 1200),
    "product": (150, 300, 600),
    "homepage": (150, 300, 500),
    "about": (200, 400, 800),
    "contact": (50, 100, 200),
    "legal": (300, 500, 1000),
    "faq": (300, 500, 1000),
    "general": (200, 300, 600),
}


def url_path() -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


#: Types that make a page an article.
POST_TYPES = ("Article", "BlogPosting", "NewsArticle")


def page_type() -> Column:
    """What a page is, by its path, else its title, else the types at the top of its structured data."""
    path, segments = F.col("path"), F.col("segments")

    def named(*keys: str) -> Column:
        return F.exists(segments, lambda s: s.rlike("^(" + "|".join(keys) + ")([-_]|$)"))

    posts = F.array_position(F.transform(segments, lambda s: s.isin("blog", "article", "post", "news")), True)
    name = F.lower(title())
    return (
        F.when(named("contact", "kontakt", "contacto"), "contact")
        .when(named("about", "uber-uns"), "about")
        .when((posts > 0) & (posts < F.size(segments)), "article")
        .when(F.array_contains(segments, "blog"), "blog")
        .when(F.exists(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: s.isin("product", "shop", "item")), "product")
        .when(named("faq", "help", "support"), "faq")
        .when(named("privacy", "terms", "legal", "policy"), "legal")
        .when(path.isin("/", "/index", "/index.html", "/home"), "homepage")
        .when(name.rlike("contact|kontakt"), "contact")
        .when(name.rlike("about|über uns"), "about")
        .when(name.rlike("faq|frequently asked"), "faq")
        .when(F.arrays_overlap(F.col("ld")["top"], F.array(*(F.lit(t) for t in POST_TYPES))), "article")
        .when(F.array_contains(F.col("ld")["top"], "Product"), "product")
        .otherwise("general")
    )


def _classed(n: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(n["attrs"]["class"], F.lit("")), r"\s+"), name)


def main_candidates() -> Column:
    """Elements that may hold the main content, as structs (rank, id, end); the lowest rank is meant."""

    def rank(n: Column) -> Column:
        role, own = n["attrs"]["role"], n["attrs"]["id"]
        ranks = (n["tag"] == "main", n["tag"] == "article", role == "main", _classed(n, "content"), _classed(n, "main-content"), own == "content", own == "main", n["tag"] == "body")
        out = F.when(n["tag"].startswith("#"), F.lit(None).cast("int"))
        for i, test in enumerate(ranks):
            out = out.when(test, F.lit(i))
        return out

    return F.filter(F.transform(elements(), lambda n: F.struct(rank(n).alias("rank"), n["id"].alias("id"), n["end"].alias("end"))), lambda x: x["rank"].isNotNull())


def main_roots() -> Column:
    """The element of the lowest rank; of articles, all that stand in no other."""
    best = F.filter(F.col("candidates"), lambda x: x["rank"] == F.col("main_rank"))
    top = F.filter(best, lambda a: ~F.exists(F.col("candidates"), lambda b: (b["rank"] == 1) & (b["id"] < a["id"]) & (a["id"] <= b["end"])))
    return F.when(F.col("main_rank") == 1, top).otherwise(F.slice(best, 1, 1))


def main_words() -> Column:
    text = F.array_join(F.transform(F.col("roots"), lambda n: visible_text(n, skip_boilerplate=True)), "\n")
    return F.coalesce(F.size(words(text)), F.lit(0))


def with_facts(pages: DataFrame) -> DataFrame:
    """Add what several checks use, each computed once: columns over nodes, in steps that build on each other."""
    pages = with_elements(pages)
    with dealt():
        tags = lambda kind, keys, *by: F.struct(*(_tag(f"{kind}:{k}", *by).alias(k) for k in keys))
        pages = pages.select(
            "*",
            title_text().alias("title"),
            internal_links().alias("links"),
            main_candidates().alias("candidates"),
            tags("og", ("title", "description", "image", "url", "type"), "property", "name").alias("og"),
            tags("twitter", ("card", "title", "description", "image"), "name", "property").alias("twitter"),
            canonical_href().alias("canonical"),
            structured_data(*json_ld_blocks()).alias("ld"),
            F.lower(url_path()).alias("path"),
        )
        pages = pages.select("*", F.array_min(F.transform("candidates", lambda x: x["rank"])).alias("main_rank"), F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"\.(html?|php)$", "")).alias("segments"))
        pages = pages.select("*", main_roots().alias("roots"), page_type().alias("kind"))
        return pages.select("*", main_words().alias("main_words"))


def quality_score() -> Column:
    """Up to 5: enough words for the kind of page, in real paragraphs."""
    least = F.try_element_at(F.create_map(*(F.lit(x) for k, v in WORD_COUNTS.items() for x in (k, v[0]))), F.col("kind"))
    n = F.col("main_words")
    paragraphs = F.size(having("p", also=lambda p: units(trimmed(visible_text(p))) > 50))
    thin = _bands(n, (n < F.floor(least * 0.33), 3.0), (n < F.floor(least * 0.66), 2.0), (n < least, 1.0))
    score = _less(5, thin, _if((paragraphs < 3) & (n > 200), 0.5))
    return rounded(F.when(n < 50, F.least(score, F.lit(1.0))).otherwise(score), 1)


def _tag(key: str, *by: str) -> Column:
    """The content of the first <meta> with the key, by the first attribute that has it; '' where it has none."""
    found = [first(having("meta", also=lambda n, a=a: n["attrs"][a] == key)) for a in by]
    return F.coalesce(*(F.when(f.isNotNull(), F.coalesce(f["attrs"]["content"], F.lit(""))) for f in found))


def _url_key(url: Column) -> Column:
    """An absolute URL for comparison: no port, no fragment, no last slash, lower case; other text as it is."""
    part = lambda k: F.try_parse_url(url, F.lit(k))
    query = F.coalesce(F.concat(F.lit("?"), part("QUERY")), F.lit(""))
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    return F.coalesce(F.lower(F.regexp_replace(F.concat(part("PROTOCOL"), F.lit("://"), part("HOST"), path, query), "/$", "")), url)


#: The parts of a reference: scheme, authority, path, query, fragment (RFC 3986, appendix B).
_REFERENCE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def without_dots(path: Column) -> Column:
    """A path without its '.' and '..' segments: a fold over the segments, none above the root."""
    parts = F.split(path, "/")
    rooted = path.startswith("/")
    own = F.when(rooted, F.slice(parts, 2, 1_000_000)).otherwise(parts)
    last = F.element_at(own, -1)
    kept = F.aggregate(own, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))).otherwise(path)


def resolved(href: Column, base: Column) -> Column:
    """A reference against an absolute base, by RFC 3986: dot segments, empty, query-only and scheme-relative references."""
    part = lambda s, k: F.regexp_extract(s, _REFERENCE, k)
    scheme, authority, path = part(href, 1), part(href, 2), part(href, 3)
    has = lambda s, form: s.rlike(form)
    query = F.when(has(href, r"^[^?#]*\?"), F.concat(F.lit("?"), part(href, 4))).otherwise("")
    fragment = F.when(has(href, "#"), F.concat(F.lit("#"), part(href, 5))).otherwise("")
    base_query = F.when(has(base, r"^[^?#]*\?"), F.concat(F.lit("?"), part(base, 4))).otherwise("")
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.coalesce(F.nullif(F.regexp_extract(part(base, 3), "^(.*/)[^/]*$", 1), F.lit("")), F.lit("/"))
    merged = F.when(path == "", part(base, 3)).when(path.startswith("/"), without_dots(path)).otherwise(without_dots(F.concat(folder, path)))
    return (
        F.when(scheme != "", F.when(has(href, r"^[^:]*://"), F.concat(scheme, F.lit("://"), authority, without_dots(path), query, fragment)).otherwise(href))
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit("://"), authority, without_dots(path), query, fragment))
        .when((path == "") & (query == ""), F.concat(origin, merged, base_query, fragment))
        .otherwise(F.concat(origin, merged, query, fragment))
    )


def canonical_href() -> Column:
    return F.nullif(trimmed(F.coalesce(first(having("link", also=lambda n: n["attrs"]["rel"] == "canonical"))["attrs"]["href"], F.lit(""))), F.lit(""))


def open_graph_score() -> Column:
    """Up to 3: title, description and image; url and type; the url that is the canonical one."""
    og = F.col("og")
    costs = [_if(og[k].isNull() | (trimmed(og[k]) == ""), 0.75) for k in ("title", "description", "image")]
    other = (og["url"] != "") & (_url_key(og["url"]) != _url_key(resolved(F.col("canonical"), F.col("url"))))
    return _less(3, *costs, _if(og["url"].isNull(), 0.25), _if(og["type"].isNull(), 0.25), _if(F.coalesce(other, F.lit(False)), 0.25))


def twitter_score() -> Column:
    """Up to 3; 2 where only Open Graph tags can stand in."""
    tw, og = F.col("twitter"), F.col("og")
    stand_in = F.coalesce(*(tw[k] for k in ("card", "title", "description", "image"))).isNull() & (F.concat_ws("", *(og[k] for k in ("title", "description", "image"))) != "")
    costs = [_if(tw[k].isNull() | (trimmed(tw[k]) == ""), 0.75) for k in ("card", "title", "description")]
    odd = F.coalesce((tw["card"] != "") & ~tw["card"].isin("summary", "summary_large_image", "app", "player"), F.lit(False))
    return F.when(stand_in, F.lit(2.0)).otherwise(_less(3, *costs, _if(tw["image"].isNull(), 0.5), _if(odd, 0.25)))


#: Language and region codes that are known.
LANGUAGES = "en es fr de it pt ru ja ko zh ar hi bn pa te mr ta ur gu kn nl pl uk ro el hu cs sv da fi no nb nn tr th vi id ms he fa sw tl fil ca eu gl sr hr bs sk sl bg mk sq et lv lt mt is ga cy af zu xh am ne si km lo my".split()
REGIONS = "US GB CA AU NZ IE ZA IN PK NG ES MX AR CO PE VE CL EC GT CU FR BE CH LU MC DE AT IT PT BR RU UA BY KZ JP KR CN TW HK SG NL PL RO GR HU CZ SE DK FI NO TR TH VN ID MY PH IL AE SA EG KE GH MA DZ TN LY ET TZ UG ZW".split()


def language_score() -> Column:
    """Up to 3: a lang attribute on <html>, well formed, of a known language and region.

    Codes beyond the two lists count as unknown.
    """
    lang = trimmed(F.coalesce(first(having("html"))["attrs"]["lang"], F.lit("")))
    form = r"(?i)^([a-z]{2,3})(?:-([a-z]{4}))?(?:-([a-z]{2}|[0-9]{3}))?$"
    code, region = F.lower(F.regexp_extract(lang, form, 1)), F.upper(F.regexp_extract(lang, form, 3))
    cost = (
        F.when(lang == "", F.lit(2.0))
        .when(~lang.rlike(form), F.lit(0.5))
        .when(~code.isin(*LANGUAGES), F.lit(0.5))
        .when((region != "") & ~region.rlike("^[0-9]") & ~region.isin(*REGIONS), F.lit(0.25))
        .otherwise(F.lit(0.0))
    )
    return _less(3, cost)


def json_ld_blocks() -> tuple[Column, Column]:
    """(texts, lines) of JSON-LD blocks."""
    own = having("script", also=lambda n: F.lower(n["attrs"]["type"]) == "application/ld+json")
    return F.transform(own, text_content), F.transform(own, lambda n: n["line"])


def freshness_score() -> Column:
    """Up to 5: a publish date and a modified date, in meta tags, JSON-LD or <time>.

    A date property of structured data counts at any depth, with any value but null, false, 0 and ''; in a
    block that only template tags keep from parsing, its name is enough.
    """
    times = having("time", also=lambda n: n["attrs"]["datetime"].isNotNull())

    def published(n: Column) -> Column:
        classes = F.concat_ws(" ", n["attrs"]["class"], F.get(nodes(), n["parent"])["attrs"]["class"])
        return F.coalesce(n["attrs"]["itemprop"] == "datePublished", F.lit(False)) | classes.rlike("(?i)(?<![A-Za-z0-9_])(published|pubdate|post-date|entry-date)(?![A-Za-z0-9_])")

    there = lambda k: F.coalesce(_tag(f"article:{k}_time", "property") != "", F.lit(False))
    publish = there("published") | F.col("ld")["published"] | F.exists(times, published)
    modify = there("modified") | F.col("ld")["modified"] | F.exists(times, lambda n: ~published(n))
    return F.when(~publish & ~modify, F.lit(0.0)).otherwise(_less(5, _if(~publish, 2), _if(~modify, 2)))


def form_inputs() -> Column:
    """Fields that need a label, as structs (tag, line, named)."""
    labels = having("label")
    targets = F.transform(labels, lambda n: n["attrs"]["for"])
    kind = lambda n: F.lower(F.coalesce(n["attrs"]["type"], F.lit("")))
    inputs = having("input", "textarea", "select", also=lambda n: (n["tag"] != "input") | ~kind(n).isin("hidden", "submit", "button", "reset", "image"))
    some = lambda n, k: F.coalesce(n["attrs"][k] != "", F.lit(False))
    inside = lambda n, around: F.exists(around, lambda b: (b["id"] < n["id"]) & (n["id"] <= b["end"]))
    good = lambda n, around, ids: (some(n, "id") & F.coalesce(F.array_contains(ids, n["attrs"]["id"]), F.lit(False))) | some(n, "aria-label") | some(n, "aria-labelledby") | inside(n, around)
    return bound(labels, lambda around: bound(targets, lambda ids: F.transform(inputs, lambda n: F.struct(n["tag"].alias("tag"), n["line"].alias("line"), good(n, around, ids).alias("named")))))


def accessibility_facts() -> dict[str, Column]:
    role = lambda r: F.exists(elements(), lambda n: F.coalesce(n["attrs"]["role"] == r, F.lit(False)))
    semantic = F.size(having("main", "nav", "article", "section", "aside", "header", "footer", "figure", "figcaption"))
    return {"main": (F.size(having("main")) > 0) | role("main"), "nav": (F.size(having("nav")) > 0) | role("navigation"), "semantic": semantic, "inputs": form_inputs()}


def accessibility_score() -> Column:
    """Up to 4: main and nav landmarks, labelled inputs, semantic elements."""
    f = fact("content.accessibility")
    main, inputs = f("main"), f("inputs")
    share = rounded(F.size(F.filter(inputs, lambda x: x["named"])) / F.nullif(F.size(inputs), F.lit(0)) * 100)
    return rounded(_less(4, _if(~main, 1.75), _if(~f("nav"), 0.75), _if(F.coalesce(share < 50, F.lit(False)), 0.75), _if((f("semantic") < 5) & ~main, 0.75)), 1)


def author_score() -> Column:
    """Up to 5: a name (2; 1 for markup without one), expertise, a bio or a link to the author, three signs of trust."""
    a = F.col("author")
    name = F.when(a["name"].isNotNull(), F.lit(2.0)).otherwise(_if(a["meta"] | a["schema"] | a["microdata"], 1))
    return name + _if(a["expertise"].isNotNull(), 1) + _if(a["bio"] | a["link"], 1) + _if(F.size(a["trust"]) >= 3, 1)


PAGE_CHECKS = (
    Check("meta.title", "meta", 5, title_score),
    Check("meta.description", "meta", 5, description_score),
    Check("meta.viewport", "meta", 3, viewport_score),
    Check("content.headings", "content", 8, headings_score),
    Check("content.image-alt", "content", 5, image_alt_score),
    Check("content.internal-links", "content", 4, internal_links_score),
    Check("content.quality", "content", 5, quality_score),
    Check("content.freshness", "content", 5, freshness_score),
    Check("content.accessibility", "content", 4, accessibility_score, accessibility_facts),
    Check("meta.language", "meta", 3, language_score),
    Check("meta.open-graph", "meta", 3, open_graph_score),
    Check("meta.twitter-cards", "meta", 3, twitter_score),
    Check("content.author", "content", 5, author_score),
)
