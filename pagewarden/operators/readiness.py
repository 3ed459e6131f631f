"""Page checks on structured data, indexing, server rendering and controls: expressions as in operators.checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.functions.nodes import below, bound, elements, first, having, nodes, text_content, visible_text
from pagewarden.functions.text import SPACE, collapsed, rounded, trimmed, words
from pagewarden.operators.access import directives, noindex_for_all
from pagewarden.operators.checks import PAGE_CHECKS, Check, _bands, _classed, _if, _less, _url_key, fact, resolved, title
from pagewarden.sources.structured_data import ARTICLES, ORGANIZATIONS

#: Types that earn points, by bucket; main ones, then supporting ones.
MAIN_BUCKETS = (("HowTo",), ("Product",), ORGANIZATIONS, ARTICLES, ("VideoObject",), ("Dataset",))
SUPPORT_BUCKETS = ("BreadcrumbList", "ItemList", "Person")
#: Points of a page's structured data.
BASE, FIRST_MAIN, EXTRA_MAIN, INVALID_MAIN, FAQ, INVALID_FAQ, MOST, UNRESOLVED = 4, 7, 2, 2, 8, 4, 15, 8


def _ints(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def _of(types: tuple[str, ...], valid: bool = False) -> Column:
    """Whether a node of the types is there (a valid one)."""

    def test(n: Column) -> Column:
        there = F.arrays_overlap(n["types"], F.split(F.lit(" ".join(types)), " "))
        return there & F.coalesce(n["valid"], F.lit(False)) if valid else there

    return F.exists(F.col("ld")["nodes"], test)


def structured_data_base() -> Column:
    """Points of the types that parsed blocks have, whatever template tags hide."""
    ld = F.col("ld")
    none, some = F.lit(0), F.lit(0)
    for types in MAIN_BUCKETS:
        some = some + _ints(_of(types, valid=True))
        none = none + _ints(_of(types) & ~_of(types, valid=True))
    main = F.when(some > 0, FIRST_MAIN + EXTRA_MAIN * (some - 1)).when(none > 0, INVALID_MAIN).otherwise(0)
    faq = F.when(_of(("FAQPage",), valid=True), FAQ).when(_of(("FAQPage",)), INVALID_FAQ).otherwise(0)
    support = _ints(F.exists(ld["nodes"], lambda n: F.array_contains(n["types"], "WebSite") & ~n["reference"] & n["named"]))
    for t in SUPPORT_BUCKETS:
        support = support + _ints(_of((t,), valid=True))
    return F.least(F.lit(MOST), BASE + main + faq + support)


def structured_data_score() -> Column:
    """Up to 15: the first valid main type earns most; a valid FAQ, further and supporting types add to it.

    Without a block that parses: 4 for microdata or RDFa, 8 where only template tags stand in the way.
    """
    ld, total = F.col("ld"), structured_data_base()
    marked = F.exists(elements(), lambda n: F.coalesce(n["attrs"]["itemscope"], n["attrs"]["typeof"], n["attrs"]["vocab"]).isNotNull())
    lifted = F.when((ld["unresolved"] > 0) & (total < UNRESOLVED), UNRESOLVED).otherwise(total)
    bare = F.when(marked, 4).when(ld["unresolved"] > 0, UNRESOLVED).otherwise(0)
    return F.coalesce(F.when(ld["parsed"] > 0, lifted).otherwise(bare), F.lit(0)).cast("double")


def validity_base() -> Column:
    """The score of what parses and what is broken."""
    ld = F.col("ld")
    judged = F.filter(ld["nodes"], lambda n: n["valid"].isNotNull())
    share = rounded(F.size(F.filter(judged, lambda n: n["valid"])) / F.nullif(F.size(judged), F.lit(0)) * 100)
    rate = F.when(ld["parsed"] == 0, F.lit(0.0)).otherwise(F.coalesce(share, F.lit(100.0)))
    return rounded(_less(5, ld["broken"] * 0.5, _bands(rate, (rate < 50, 2.0), (rate < 80, 1.0), (rate < 100, 0.5))), 1)


def structured_data_valid_score() -> Column:
    """Up to 5: half a point off per broken block, and by the share of nodes that their validator passes."""
    ld, score = F.col("ld"), validity_base()
    lifted = F.when((ld["unresolved"] > 0) & (score < 3), F.lit(3.0)).otherwise(score)
    only_templates = (ld["parsed"] == 0) & (ld["broken"] == 0)
    return F.when(F.coalesce(ld["blocks"], F.lit(0)) == 0, F.lit(0.0)).when(only_templates, F.lit(3.0)).otherwise(lifted)


#: What titles and bodies of error pages say.
ERROR_TITLES = r"(?<![A-Za-z0-9_-])404(?![A-Za-z0-9_-])|not found|(?<![A-Za-z0-9_])error(?![A-Za-z0-9_])|no encontrado|nicht gefunden"
ERROR_BODIES = r"page not found|(?<![A-Za-z0-9_-])404(?![A-Za-z0-9_-])"


def _inside(n: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (r["id"] <= n["id"]) & (n["id"] <= r["end"]))


def _veiled(n: Column) -> Column:
    return n["attrs"]["hidden"].isNotNull() | F.coalesce(n["attrs"]["aria-hidden"] == "true", F.lit(False))


def soft_404() -> Column:
    """struct(title, thin, body, is): an error's title, under 200 words of main content, an error's opening text; two of them make one.

    Where no element marks the main content, the body's text counts without navigation and what is hidden;
    inline tags do not cut its words.
    """
    mains = F.filter(elements(), lambda n: n["tag"].isin("main", "article") | F.coalesce(n["attrs"]["role"] == "main", F.lit(False)) | _classed(n, "content") | F.coalesce(n["attrs"]["id"] == "content", F.lit(False)))
    body = first(having("body"))
    skipped = F.filter(elements(), lambda n: n["tag"].isin("nav", "footer", "header", "aside", "script", "style", "template", "noscript", "head", "title") | _veiled(n))
    #: A space stands after every element, so only its own tags part words.
    texts = bound(skipped, lambda s: bound(body, lambda b: F.filter(below(b), lambda n: (n["tag"] == "#text") & ~_inside(n, s))))
    apart = lambda n: F.when(F.get(nodes(), n["id"] + 1)["parent"] == n["parent"], n["text"]).otherwise(F.concat(n["text"], F.lit(" ")))
    rest = F.size(words(F.array_join(F.transform(texts, apart), "")))
    n_words = bound(first(mains), lambda m: F.when(m.isNotNull(), F.size(words(visible_text(m)))).otherwise(rest))
    opening = F.substring(F.lower(collapsed(F.coalesce(visible_text(body), F.lit("")))), 1, 1000)
    tests = {"title": F.lower(title()).rlike(ERROR_TITLES), "thin": F.coalesce(n_words, F.lit(0)) < 200, "body": opening.rlike(ERROR_BODIES)}
    return F.struct(*(F.coalesce(t, F.lit(False)).alias(k) for k, t in tests.items()))


SAID = "array<struct<d:struct<noindex:boolean,nofollow:boolean>,all:boolean,name:string,line:int>>"


def robots_said() -> Column:
    """Directives of meta tags of crawlers (names with 'bot') and of X-Robots-Tag headers (name and line null); all: a noindex for every crawler."""
    name = lambda n: F.lower(trimmed(F.coalesce(n["attrs"]["name"], F.lit(""))))
    told = lambda value, all_, name, line: F.struct(directives(value).alias("d"), all_.alias("all"), name.alias("name"), line.alias("line"))
    tags = F.transform(having("meta", also=lambda n: name(n).contains("bot")), lambda n: told(n["attrs"]["content"], name(n) == "robots", n["attrs"]["name"], n["line"]))
    sent = F.transform(F.coalesce(F.col("robots_header"), F.array().cast("array<string>")), lambda v: told(v, noindex_for_all(v), F.lit(None).cast("string"), F.lit(None).cast("int")))
    return F.concat(F.coalesce(tags, F.array().cast(SAID)), sent.cast(SAID))


def state_of(said: Column) -> Column:
    return F.struct(F.exists(said, lambda x: x["d"]["noindex"]).alias("noindex"), F.exists(said, lambda x: x["d"]["nofollow"]).alias("nofollow"), F.exists(said, lambda x: x["d"]["noindex"] & x["all"]).alias("for_all"))


def robots_state() -> Column:
    """struct(noindex, nofollow, for_all) of a page; for_all: every crawler is told noindex, by the tag named robots or by a header without an agent."""
    return bound(robots_said(), state_of)


def indexability_facts() -> dict[str, Column]:
    links = having("link", also=lambda n: n["attrs"]["rel"] == "canonical")
    href = trimmed(F.coalesce(first(links)["attrs"]["href"], F.lit("")))
    there = resolved(href, F.col("url"))
    host = lambda u: F.lower(F.try_parse_url(u, F.lit("HOST")))
    single = F.size(links) == 1
    valid = (href != "") & host(there).isNotNull()
    cost = (
        F.when(F.size(links) == 0, F.lit(1.0))
        .when(~single, F.lit(3.0))
        .when(~valid, F.lit(1.0))
        .when(_url_key(there) == _url_key(F.col("url")), F.lit(0.0))
        .otherwise(F.lit(2.0))
    )
    return {
        "canonicals": F.transform(links, lambda n: F.struct(n["attrs"]["href"].alias("href"), n["line"].alias("line"))), "valid": valid,
        "elsewhere": F.coalesce(single & valid & (host(there) != host(F.col("url"))), F.lit(False)), "cost": cost, "soft": soft_404(), "said": robots_said(),
    }


def is_soft_404(soft: Column) -> Column:
    return _ints(soft["title"]) + _ints(soft["thin"]) + _ints(soft["body"]) >= 2


def indexability_score() -> Column:
    """Up to 8: 0 for noindex, a soft 404 or a canonical page on another host; less for other canonical faults and nofollow.

    A page that is kept out of search on purpose has all points: that depends on its site, so results
    are put right by plans.scorecard.with_intent.
    """
    f = fact("crawlability.indexability")
    said = state_of(f("said"))
    critical = said["noindex"] | is_soft_404(f("soft")) | f("elsewhere")
    return F.when(critical, F.lit(0.0)).otherwise(_less(8, f("cost"), _if(said["nofollow"], 2)))


#: Ids of elements that client code fills.
APP_ROOTS = ("root", "app", "__next", "__nuxt", "___gatsby", "svelte", "q-app")


def server_rendered_facts() -> dict[str, Column]:
    skipped = having("script", "style", "noscript", "template", "svg")
    texts = bound(skipped, lambda s: bound(first(having("body")), lambda b: F.filter(below(b), lambda n: (n["tag"] == "#text") & ~_inside(n, s))))
    sent = F.coalesce(F.size(words(F.array_join(F.transform(texts, lambda n: n["text"]), " "))), F.lit(0))
    empty = lambda n: trimmed(text_content(n)) == ""
    at = lambda n: F.array_position(F.array(*(F.lit(r) for r in APP_ROOTS)), n["attrs"]["id"])
    place = lambda n: F.when(F.coalesce(at(n), F.lit(0)) > 0, at(n)).when(n["attrs"]["data-reactroot"].isNotNull(), F.lit(len(APP_ROOTS) + 1).cast("long"))
    some = F.filter(elements(), lambda n: F.coalesce(place(n).isNotNull(), F.lit(False)) & empty(n))
    roots = F.transform(some, lambda n: F.struct(place(n).alias("place"), n["line"].alias("line"), F.when(place(n) > len(APP_ROOTS), F.lit("[data-reactroot]")).otherwise(F.concat(F.lit("#"), n["attrs"]["id"])).alias("selector")))
    kind = lambda n: F.lower(F.coalesce(n["attrs"]["type"], F.lit("")))
    client = F.size(having("script", also=lambda n: kind(n).isin("", "module", "text/javascript", "application/javascript") & (n["attrs"]["src"].isNotNull() | ~empty(n)))) > 0
    return {"sent": sent, "root": F.array_min(roots), "client": client, "h1": F.size(having("h1")) > 0}


def server_rendered_score() -> Column:
    """Up to 6: 0 for an empty app container in an empty page, 3 where content may come from scripts.

    Hidden text counts as sent.
    """
    f = fact("agent-readiness.server-rendered")
    rooted, sent = f("root").isNotNull(), f("sent")
    partial = (rooted & (sent < 150)) | (~rooted & (sent < 30) & f("client"))
    late = _if(~f("h1"), 1), _if(title() == "", 1)
    return F.when(rooted & (sent < 50), F.lit(0.0)).when(partial, _less(3, *late)).otherwise(F.lit(6.0))


#: Words in the names of fields for personal data, and input types that take none.
PERSONAL = ("fname", "firstname", "lname", "lastname", "fullname", "surname", "name", "address", "street", "city", "zip", "zipcode", "postal", "postalcode", "postcode", "phone", "tel", "email", "country", "state", "company", "organization")
IMPERSONAL_TYPES = ("hidden", "password", "search", "checkbox", "radio", "submit", "button", "reset", "file", "image", "range", "color")


def personal_field(name: Column) -> Column:
    """Whether a word of a field's name, or two next to each other, is one of personal data."""
    parts = F.filter(F.transform(F.split(name, rf"(?:[-_0-9]|{SPACE})+|(?<=[a-z])(?=[A-Z])"), lambda t: F.lower(t)), lambda t: t != "")
    known = F.array(*(F.lit(w) for w in PERSONAL))
    pairs = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.arrays_overlap(parts, known) | F.coalesce(F.arrays_overlap(F.filter(pairs, lambda p: p.isNotNull()), known), F.lit(False))


def _some(x: Column) -> Column:
    return F.coalesce(trimmed(x) != "", F.lit(False))


def accessible(n: Column) -> Column:
    """Whether a control has a name that assistive tools can read."""
    a = n["attrs"]
    by = F.exists(F.split(F.coalesce(a["aria-labelledby"], F.lit("")), f"{SPACE}+"), lambda i: (i != "") & _some(text_content(first(F.filter(elements(), lambda x: x["attrs"]["id"] == i)))))
    image = first(F.filter(below(n), lambda x: (x["tag"] == "img") & x["attrs"]["alt"].isNotNull()))
    drawn = first(F.filter(below(n), lambda x: (x["tag"] == "title") & (F.get(nodes(), x["parent"])["tag"] == "svg")))
    named = F.coalesce((n["tag"] == "input") & F.lower(a["type"]).isin("submit", "reset"), F.lit(False))
    return _some(a["aria-label"]) | by | _some(text_content(n)) | _some(a["title"]) | _some(a["value"]) | _some(a["alt"]) | _some(image["attrs"]["alt"]) | _some(text_content(drawn)) | named


def controls_facts() -> dict[str, Column]:
    """Buttons, links, click handlers and personal fields, each as structs (line, reason): '' where nothing is wrong."""
    hidden = F.filter(elements(), _veiled)

    def judged(test: Callable[[Column], Column], reason: Callable[[Column], Column]) -> Column:
        own = bound(hidden, lambda h: F.filter(elements(), lambda n: ~n["tag"].startswith("#") & F.coalesce(test(n), F.lit(False)) & ~_inside(n, h)))
        return F.transform(own, lambda n: F.struct(n["line"].alias("line"), reason(n).alias("reason")))

    role = lambda n: F.coalesce(n["attrs"]["role"], F.lit(""))
    kind = lambda n: F.lower(F.coalesce(n["attrs"]["type"], F.lit("")))
    has = lambda n, k: n["attrs"][k].isNotNull()
    native = lambda n: n["tag"].isin("button", "input", "select", "textarea", "summary") | ((n["tag"] == "a") & has(n, "href"))
    label = lambda n: F.concat_ws(" ", n["attrs"]["name"], n["attrs"]["id"])
    reached = lambda n: (role(n) != "button") | native(n) | has(n, "tabindex")
    filled = lambda n: _some(n["attrs"]["autocomplete"]) & (F.lower(trimmed(n["attrs"]["autocomplete"])) != "off")

    def astray(n: Column) -> Column:
        href = trimmed(F.coalesce(n["attrs"]["href"], F.lit("")))
        anchor = (has(n, "name") | has(n, "id")) & ~_some(text_content(n)) & ~has(n, "onclick")
        leads = ~(href.isin("", "#") | href.rlike("(?i)^javascript:")) | has(n, "aria-haspopup") | has(n, "aria-expanded") | anchor
        return F.when(leads, "").when(~has(n, "href"), "no href").otherwise(F.concat(F.lit('placeholder href "'), href, F.lit('"')))

    return {
        "buttons": judged(lambda n: (n["tag"] == "button") | (role(n) == "button") | ((n["tag"] == "input") & kind(n).isin("submit", "button", "reset", "image")), lambda n: F.concat_ws(", ", F.when(~accessible(n), "no accessible name"), F.when(~reached(n), "not focusable"))),
        "links": judged(lambda n: (n["tag"] == "a") & (role(n) != "button"), astray),
        "clicked": judged(lambda n: n["tag"].isin("div", "span", "li", "p", "img", "td") & has(n, "onclick") & (role(n) != "button"), lambda n: F.when(has(n, "tabindex"), "").otherwise("click handler on a non-interactive element")),
        "fields": judged(lambda n: (n["tag"] == "input") & ~kind(n).isin(*IMPERSONAL_TYPES) & (kind(n).isin("email", "tel") | personal_field(label(n))), lambda n: F.when(filled(n), "").otherwise("missing autocomplete")),
    }


def controls_score() -> Column:
    """Up to 4: a point each for buttons, links, click handlers and autocomplete that 90 % of elements get right."""
    f = fact("agent-readiness.controls")

    def point(found: Column) -> Column:
        share = rounded(F.size(F.filter(found, lambda x: x["reason"] == "")) / F.nullif(F.size(found), F.lit(0)) * 100)
        return _if(F.coalesce(share >= 90, F.lit(True)), 1)

    return point(f("buttons")) + point(f("links")) + point(f("clicked")) + point(f("fields"))


READINESS_CHECKS = (
    Check("structured-data.present", "structured-data", 15, structured_data_score),
    Check("structured-data.valid", "structured-data", 5, structured_data_valid_score),
    Check("crawlability.indexability", "crawlability", 8, indexability_score, indexability_facts),
    Check("agent-readiness.server-rendered", "agent-readiness", 6, server_rendered_score, server_rendered_facts),
    Check("agent-readiness.controls", "agent-readiness", 4, controls_score, controls_facts),
)
ALL_PAGE_CHECKS = PAGE_CHECKS + READINESS_CHECKS
