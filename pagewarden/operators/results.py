"""Results of page checks: besides the score, what was found where, in words.

Each check has facts (columns, each computed once, in a projection of its own) and a telling: a message,
findings with source lines, advice, a recommendation, whether the score is inconclusive or predicted, and
details. Scores are those of operators.checks and operators.readiness. All texts are fixed values: reports
of different runs are compared by them. Lines are those of the page's source; a finding's file is the
page's URL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions.nodes import dealt, elements, first, having, meta, nodes, text_content, visible_text
from pagewarden.functions.text import SPACE, collapsed, rounded, trimmed, units
from pagewarden.operators import checks as C
from pagewarden.operators import readiness as R
from pagewarden.operators.access import path_key
from pagewarden.operators.checks import Check, fact, with_facts
from pagewarden.sources.structured_data import ORGANIZATIONS

FOUND = "array<struct<message:string,line:int>>"
RUN = "score double, na boolean, inconclusive boolean, predicted boolean, message string, recommendation string, findings array<struct<message:string,file:string,line:int>>, advice array<struct<message:string,file:string,line:int>>, details map<string,string>"


@dataclass(frozen=True)
class Told:
    message: Column
    findings: Column
    recommendation: Column = field(default_factory=lambda: F.lit(""))
    advice: Column = field(default_factory=lambda: F.array().cast(FOUND))
    inconclusive: Column = field(default_factory=lambda: F.lit(False))
    predicted: Column = field(default_factory=lambda: F.lit(False))
    details: dict[str, Column] = field(default_factory=dict)


def say(*parts: Column | str) -> Column:
    """Texts and values in a row."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def found(*items: tuple[Column, Column | str, Column]) -> Column:
    """Findings (message, line) of the tests that hold, in order."""
    one = lambda m, line: F.struct((F.lit(m) if isinstance(m, str) else m).alias("message"), line.cast("int").alias("line"))
    return F.array_compact(F.array(*(F.when(t, one(m, line)) for t, m, line in items))).cast(FOUND)


def each(rows: Column, message: Callable[[Column], Column | str]) -> Column:
    """A finding for each of some rows that have a line."""
    told = lambda x: message(x) if isinstance(message(x), Column) else F.lit(message(x))
    return F.coalesce(F.transform(rows, lambda x: F.struct(told(x).alias("message"), x["line"].cast("int").alias("line"))), F.array()).cast(FOUND)


def either(test: Column, yes: Column | str, no: Column | str = "") -> Column:
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(test, c(yes)).otherwise(c(no))


def plural(n: Column, one: str, many: str) -> Column:
    return either(n == 1, one, many)


def joined(parts: Sequence[tuple[Column, Column | str]], by: str, most: int | None = None) -> Column:
    """Texts whose tests hold, in order."""
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    out = F.array_compact(F.array(*(F.when(t, c(x)) for t, x in parts)))
    return F.array_join(F.slice(out, 1, most) if most else out, by)


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _line(tag: str) -> Column:
    return F.coalesce(first(having(tag))["line"], F.lit(1))


DESCRIPTION_FIX = "Write a unique, specific meta description of 120-160 characters that summarizes the page (not a copy of the title)."
VIEWPORT_TAG = '<meta name="viewport" content="width=device-width, initial-scale=1">'
OPEN_GRAPH_FIX = 'Add og:title, og:description, og:image (absolute URL), og:type and og:url (equal to the canonical URL) as <meta property="og:..."> in the shared head.'
TWITTER_FIX = "Add twitter:card (summary_large_image), twitter:title, twitter:description and twitter:image to the shared head, filled from the same values as the title, description and og:image."


def shared() -> dict[str, Column]:
    """What several tellings use."""
    return {"head_line": _line("head"), "body_line": _line("body"), "title_line": first(having("title"))["line"]}


def title_facts() -> dict[str, Column]:
    text = C.title()
    n = units(text)
    line = F.coalesce("title_line", "head_line")
    cited = lambda m: say(m, ': "', text, '"')
    separators = F.regexp_count(text, F.lit(rf"(?:^|{SPACE})[-|–—·:](?={SPACE}|$)|:(?={SPACE})"))
    length = (
        F.when(n < 40, say("Title too short (", n, " chars, aim for 50-60)"))
        .when(n < 50, say("Title could be longer (", n, " chars, optimal 50-60)"))
        .when(n > 70, say("Title too long (", n, " chars, may be truncated)"))
        .when(n > 60, say("Title slightly long (", n, " chars, optimal 50-60)"))
    )
    issues = found(
        (length.isNotNull(), cited(length), line),
        (text.rlike(f"(?i)^({C.GENERIC_TITLES})$"), cited(say('Generic title "', text, '"')), line),
        ((n < 20) & (separators == 0), cited(F.lit('Title has no page context (consider "Page Topic | Brand")')), line),
        (separators > 3, cited(say("Title has ", separators, " separators and may look spammy")), line),
    )
    none = found((F.col("title_line").isNotNull(), "Empty <title>", line), (F.col("title_line").isNull(), "Missing <title>", line))
    return {"n": n, "issues": F.when(n == 0, none).otherwise(issues), "separators": separators}


def title_told(f) -> Told:
    n, own = f("n"), F.size(f("issues"))
    message = F.when(n == 0, "No title tag found").when(own > 0, say("Title: ", n, " chars - ", own, " issue(s)")).otherwise(say("Title OK (", n, " chars)"))
    fix = F.when(n == 0, 'Add a unique, descriptive title (50-60 characters) in the form "Page Topic | Brand".').when(own > 0, 'Rewrite the title to 50-60 characters, specific to the page, as "Page Topic | Brand".').otherwise("")
    return Told(message, f("issues"), fix, details={"length": n, "separators": f("separators")})


def description_facts() -> dict[str, Column]:
    tag = meta("description")
    raw = F.coalesce(tag["attrs"]["content"], F.lit(""))
    text = trimmed(raw)
    n = units(text)
    line = F.coalesce(tag["line"], F.col("head_line"))
    tokens = F.split(F.lower(raw), f"{SPACE}+")
    long = F.filter(tokens, lambda w: units(w) > 3)
    most = F.array_max(F.transform(F.array_distinct(long), lambda w: F.size(F.filter(long, lambda x: x == w))))
    length = (
        F.when(n < 70, "Description too short (under 70 chars, optimal 120-160)")
        .when(n < 120, "Description could be longer (70-119 chars, optimal 120-160)")
        .when(n > 170, "Description too long (over 170 chars, may be truncated)")
        .when(n > 160, "Description slightly long (161-170 chars, optimal 120-160)")
    )
    issues = found(
        (length.isNotNull(), length, line),
        (text.rlike(f"(?i){C.GENERIC_DESCRIPTIONS}"), "Description looks generic or placeholder", line),
        (F.lower(text) == F.lower(C.title()), "Description is identical to the title", line),
        ((F.coalesce(most, F.lit(0)) > 3) & (F.size(tokens) > 10), "Description may be keyword-stuffed", line),
    )
    none = found((tag.isNull(), 'Missing <meta name="description">', line), (tag.isNotNull(), 'Empty <meta name="description">', line))
    return {"n": n, "tag": tag.isNotNull(), "issues": F.when(n == 0, none).otherwise(issues)}


def description_told(f) -> Told:
    n, own = f("n"), F.size(f("issues"))
    message = F.when(~f("tag"), "No meta description found").when(n == 0, "Meta description is empty").when(own > 0, say("Description: ", n, " chars - ", own, " issue(s)")).otherwise(say("Description OK (", n, " chars)"))
    return Told(message, f("issues"), either(own > 0, DESCRIPTION_FIX), details={"present": f("tag"), "length": n})


def viewport_facts() -> dict[str, Column]:
    tag = meta("viewport")
    content = F.coalesce(tag["attrs"]["content"], F.lit(""))
    pairs = F.transform(F.split(content, "[,;]"), lambda p: F.split(p, "="))

    def setting(key: str) -> Column:
        own = F.filter(pairs, lambda p: F.lower(trimmed(p[0])) == key)
        return F.when(F.size(own) > 0, F.coalesce(trimmed(F.get(F.element_at(own, -1), F.lit(1))), F.lit("")))

    return {"line": tag["line"], "width": F.lower(setting("width")), "scale": setting("initial-scale"), "user": F.lower(setting("user-scalable")), "most": setting("maximum-scale"), "semicolons": content.contains(";")}


def viewport_told(f) -> Told:
    line, width, scale = f("line"), f("width"), f("scale")
    value = lambda s: F.regexp_extract(F.coalesce(s, F.lit("")), r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")
    wide = F.coalesce(width == "device-width", F.lit(False))
    issues = found(
        (~wide & width.isNotNull(), "Viewport sets a fixed width instead of device-width", line),
        (~wide & width.isNull(), "Viewport is missing width=device-width", line),
        (scale.isNull(), "Viewport is missing initial-scale=1", line),
        (scale.isNotNull() & ~F.coalesce(value(scale) == 1.0, F.lit(False)), "Viewport initial-scale is not 1", line),
        (f("user").isin("no", "0"), "user-scalable=no disables zoom (accessibility concern)", line),
        (value(f("most")) < 2, "maximum-scale below 2 limits zoom (accessibility concern)", line),
        (f("semicolons"), 'Viewport uses ";" as separator (use ",")', line),
    )
    none = found((F.lit(True), 'Missing <meta name="viewport">', F.col("head_line")))
    message = F.when(line.isNull(), "No viewport meta tag found").when(wide & scale.isNotNull(), "Mobile-friendly viewport configured").otherwise("Viewport present but may need optimization")
    fix = F.when(line.isNull(), f"Add {VIEWPORT_TAG} to the shared <head>.").when(F.size(issues) > 0, f"Use {VIEWPORT_TAG}.").otherwise("")
    return Told(message, F.when(line.isNull(), none).otherwise(issues), fix, details={"width": width, "initial-scale": scale})


def language_facts() -> dict[str, Column]:
    tag = first(having("html"))
    links = having("link", also=lambda n: n["attrs"]["hreflang"].isNotNull())
    return {"lang": tag["attrs"]["lang"], "line": F.coalesce(tag["line"], F.lit(1)), "links": F.transform(links, lambda n: F.struct(n["attrs"]["hreflang"].alias("lang"), n["line"].alias("line")))}


def language_told(f) -> Told:
    form = r"(?i)^([a-z]{2,3})(?:-([a-z]{4}))?(?:-([a-z]{2}|[0-9]{3}))?$"
    raw, links, line = f("lang"), f("links"), f("line")
    lang = trimmed(F.coalesce(raw, F.lit("")))
    code, region = F.lower(F.regexp_extract(lang, form, 1)), F.upper(F.regexp_extract(lang, form, 3))
    formed, known = lang.rlike(form), code.isin(*C.LANGUAGES)
    placed = (region == "") | region.rlike("^[0-9]") | region.isin(*C.REGIONS)
    loose = (F.size(links) > 1) & ~F.exists(links, lambda x: x["lang"] == "x-default")
    issues = found(
        (lang == "", "Missing lang attribute on <html>", line),
        ((lang != "") & ~formed, say('Invalid lang format "', raw, '" (expected "en" or "en-US")'), line),
        (formed & ~known, say('Unrecognized language code "', code, '"'), line),
        (formed & known & ~placed, say('Unrecognized region code "', region, '"'), line),
        (loose, "Multiple hreflang links but no x-default", F.get(links, F.lit(0))["line"]),
    )
    good = formed & known & placed
    message = F.when(good, say("Language: ", raw, either(F.size(links) > 0, say(" (", F.size(links), " hreflang link(s))")))).when(lang != "", say("Language attribute present but may be invalid: ", raw)).otherwise("No language attribute found")
    fix = F.when(~good, 'Set <html lang="..."> to a valid language tag such as "en" or "en-US" in the root layout.').when(loose, 'Add <link rel="alternate" hreflang="x-default" href="..."> for the fallback version.').otherwise("")
    return Told(message, issues, fix, details={"lang": raw})


def _tags(kind: str, keys: Sequence[str], *by: str) -> dict[str, Column]:
    """The first tag of each key: its line and content, null where there is none."""
    out = {}
    for k in keys:
        tag = F.coalesce(*(first(having("meta", also=lambda n, a=a, k=k: n["attrs"][a] == f"{kind}:{k}")) for a in by))
        out[k] = F.when(tag.isNotNull(), F.struct(tag["line"].alias("line"), F.coalesce(tag["attrs"]["content"], F.lit("")).alias("content")))
    return out


def open_graph_facts() -> dict[str, Column]:
    og = _tags("og", ("title", "description", "image", "url", "type", "site_name", "locale"), "property", "name")
    other = (F.col("og.url") != "") & (C._url_key(F.col("og.url")) != C._url_key(C.resolved(F.col("canonical"), F.col("url"))))
    return og | {"other": F.coalesce(other, F.lit(False))}


def _required(f, keys: Sequence[str], kind: str) -> tuple[Column, Column, Column]:
    """(findings, number missing, number empty)."""
    missing = [f(k).isNull() for k in keys]
    empty = [F.coalesce(trimmed(f(k)["content"]) == "", F.lit(False)) for k in keys]
    items = [(t, f"Missing {kind}:{k}", F.col("head_line")) for k, t in zip(keys, missing)] + [(t, f"Empty {kind}:{k}", f(k)["line"]) for k, t in zip(keys, empty)]
    return found(*items), sum((t.cast("int") for t in missing), F.lit(0)), sum((t.cast("int") for t in empty), F.lit(0))


def _missing(f, keys: Sequence[str], kind: str) -> Column:
    return joined([(f(k).isNull(), f"{kind}:{k}") for k in keys], ", ")


def open_graph_told(f) -> Told:
    keys, every = ("title", "description", "image"), ("title", "description", "image", "url", "type", "site_name", "locale")
    own, missing, empty = _required(f, keys, "og")
    loose = F.coalesce((f("image")["content"] != "") & ~f("image")["content"].rlike("^[A-Za-z][A-Za-z0-9+.-]*:."), F.lit(False))
    more = found(
        (f("url").isNull(), "Missing og:url", F.col("head_line")),
        (f("type").isNull(), 'Missing og:type (use "website" or "article")', F.col("head_line")),
        (loose, "og:image is not an absolute URL", f("image")["line"]),
        (f("other"), "og:url does not match the canonical URL", f("url")["line"]),
    )
    present = sum((f(k).isNotNull().cast("int") for k in every), F.lit(0))
    message = F.when(missing > 0, say("Missing ", missing, " required OG tag(s)")).when(empty > 0, say("Open Graph: ", empty, " empty required tag(s)")).otherwise(say("Open Graph: ", present, f"/{len(every)} tags present"))
    lost = (missing > 0) | (empty > 0) | f("url").isNull() | f("type").isNull() | f("other") | loose
    return Told(message, F.concat(own, more), either(lost, OPEN_GRAPH_FIX), details={"missing": _missing(f, keys, "og"), "present": present})


def twitter_facts() -> dict[str, Column]:
    return _tags("twitter", ("card", "title", "description", "image", "site", "creator"), "name", "property")


def twitter_told(f) -> Told:
    keys, every = ("card", "title", "description"), ("card", "title", "description", "image", "site", "creator")
    own, missing, empty = _required(f, keys, "twitter")
    card = f("card")["content"]
    odd = F.coalesce((card != "") & ~card.isin("summary", "summary_large_image", "app", "player"), F.lit(False))
    more = found(
        (f("image").isNull(), "Missing twitter:image", F.col("head_line")),
        (odd, say('Invalid twitter:card type "', card, '" (use summary, summary_large_image, app, player)'), f("card")["line"]),
    )
    present = sum((f(k).isNotNull().cast("int") for k in every), F.lit(0))
    stand_in = F.coalesce(*(f(k)["content"] for k in ("card", "title", "description", "image"))).isNull() & (F.concat_ws("", *(F.col(f"og.{k}") for k in ("title", "description", "image"))) != "")
    findings = F.when(stand_in, found((F.lit(True), "No twitter:* tags (X falls back to Open Graph)", F.col("head_line")))).otherwise(F.concat(own, more))
    message = (
        F.when(stand_in, "Using Open Graph fallback (no Twitter-specific tags)")
        .when(missing > 0, say("Missing ", missing, " required Twitter tag(s)"))
        .when(empty > 0, say("Twitter Cards: ", empty, " empty required tag(s)"))
        .otherwise(say("Twitter Cards: ", present, f"/{len(every)} tags present", F.coalesce(F.when(card != "", say(" (", card, ")")), F.lit(""))))
    )
    return Told(message, findings, either(F.size(findings) > 0, TWITTER_FIX), details={"missing": _missing(f, keys, "twitter"), "present": present})


def headings_facts() -> dict[str, Column]:
    level = lambda h: F.substring(h["tag"], 2, 1).cast("int")
    return {"all": F.transform(C.headings(), lambda h: F.struct(level(h).alias("level"), text_content(h).alias("text"), h["line"].alias("line")))}


def _at_level(level: int) -> Callable[[Column], Column]:
    return lambda h: h["level"] == level


def headings_told(f) -> Told:
    all_ = f("all")
    ones = F.filter(all_, lambda h: h["level"] == 1)
    steps = F.zip_with(all_, F.concat(F.array(F.lit(None).cast("int")), F.transform(F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0))), lambda h: h["level"])), lambda h, last: F.struct(h["level"].alias("level"), h["line"].alias("line"), last.alias("last")))
    skips = F.filter(steps, lambda s: s["level"] > s["last"] + 1)
    lower = lambda h: trimmed(F.lower(h["text"]))
    generic = F.filter(all_, lambda h: (units(lower(h)) < 3) | lower(h).isin(*C.GENERIC_HEADINGS))
    generic = F.when(F.size(generic) > 3, generic).otherwise(F.slice(generic, 1, 0))
    findings = F.concat(
        found((F.size(ones) == 0, "No <h1> on the page", F.get(all_, F.lit(0))["line"])),
        each(F.slice(ones, 2, 1_000_000), lambda h: "Additional <h1> (only one per page)"),
        each(skips, lambda s: say("Skipped heading level: H", s["level"], " after H", s["last"])),
        each(generic, lambda h: say('Generic or very short heading "', collapsed(h["text"]), '"')),
    )
    fixes = [(F.size(ones) == 0, "add one <h1> naming the page topic"), (F.size(ones) > 1, "keep a single <h1> and demote the others to <h2>"), (F.size(skips) > 0, "do not skip heading levels (H2 then H3, not H2 then H4)"), (F.size(generic) > 0, "rename generic headings to say what the section is about")]
    said = joined(fixes, "; ")
    n = sum((t.cast("int") for t, _ in fixes), F.lit(0))
    message = F.when(F.size(all_) == 0, "No headings found on page").otherwise(say(F.size(all_), " heading(s), ", either(n > 0, say(n, " issue(s)"), "well structured")))
    none = found((F.lit(True), "Page has no headings (h1-h6)", F.col("body_line")))
    fix = F.when(F.size(all_) == 0, "Structure the page with one <h1> for the topic and <h2>/<h3> for its sections.").when(said != "", F.concat(capital(said), F.lit("."))).otherwise("")
    return Told(message, F.when(F.size(all_) == 0, none).otherwise(findings), fix, details={f"h{i}": F.size(F.filter(all_, _at_level(i))) for i in range(1, 7)})


def image_alt_facts() -> dict[str, Column]:
    blank = lambda n, k: trimmed(F.coalesce(n["attrs"][k], F.lit(""))) == ""
    quiet = lambda n: F.lower(trimmed(F.coalesce(n["attrs"]["role"], F.lit("")))).isin("presentation", "none") | (F.lower(trimmed(F.coalesce(n["attrs"]["aria-hidden"], F.lit("")))) == "true")
    src = lambda n: F.coalesce(F.nullif(n["attrs"]["src"], F.lit("")), n["attrs"]["data-src"], F.lit(""))
    return {"all": F.transform(having("img"), lambda n: F.struct((n["attrs"]["alt"].isNotNull() & blank(n, "alt") & quiet(n)).alias("decorative"), (~blank(n, "alt")).alias("named"), n["attrs"]["alt"].isNull().alias("bare"), src(n).alias("src"), n["line"].alias("line")))}


def image_alt_told(f) -> Told:
    images = F.filter(f("all"), lambda x: ~x["decorative"])
    bad = F.filter(images, lambda x: ~x["named"])
    total, missing, all_ = F.size(images), F.size(bad), F.size(f("all"))
    tag = lambda x: either(x["src"] != "", say('<img src="', x["src"], '">'), "<img>")
    message = F.when(all_ == 0, "No images found on page").when(total == 0, say("No content images (", all_, " decorative)")).otherwise(say(total - missing, "/", total, " images have alt text"))
    fix = either(missing > 0, say("Add descriptive alt text to ", missing, ' image(s). For purely decorative images use alt="" together with role="presentation" (or aria-hidden="true").'))
    return Told(message, each(bad, lambda x: say(tag(x), either(x["bare"], " has no alt attribute", " has empty alt text"))), fix, details={"images": total, "missing": missing})


def links_facts() -> dict[str, Column]:
    links = F.col("links")
    content = F.filter(links, lambda x: ~x["nav"])
    paths = F.transform(links, lambda x: F.regexp_replace(F.regexp_replace(C.resolved(x["href"], F.col("url")), "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""))
    return {"content": F.size(content), "generic": F.filter(content, lambda x: x["generic"]), "descriptive": F.size(F.filter(links, lambda x: ~x["generic"])), "unique": F.size(F.array_distinct(paths))}


def links_told(f) -> Told:
    total, content, generic = F.size("links"), f("content"), F.size(f("generic"))
    few = (total > 0) & (content < 3) & (total < 5)
    findings = F.concat(
        found((total == 0, "No internal links on the page", F.col("body_line")), (few, "Fewer than 3 in-content internal links (and under 5 in total)", F.col("body_line"))),
        each(f("generic"), lambda x: say('Generic anchor text "', either(x["text"] == "", "(empty)", x["text"]), '" on an in-content link')),
    )
    share = rounded(f("descriptive") / F.nullif(total, F.lit(0)) * 100)
    message = F.when(total == 0, "No internal links found").otherwise(say(total, " internal link", either(total > 1, "s"), either(content > 0, say(" (", content, " in content)")), ", ", number(share), "% descriptive"))
    fix = either((total == 0) | few | (generic > 0), 'Add 3+ in-content links to related pages with descriptive anchor text, and replace generic anchors such as "read more" or "click here" with the target page topic.')
    return Told(message, findings, fix, details={"links": total, "content": content, "generic": generic, "unique_destinations": f("unique")})


def quality_facts() -> dict[str, Column]:
    pick = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for k, v in C.WORD_COUNTS.items() for x in (k, v[i]))), F.col("kind"))
    paragraphs = F.size(having("p", also=lambda p: units(trimmed(visible_text(p))) > 50))
    at = F.get(nodes(), F.get(F.col("roots"), F.lit(0))["id"])["line"]
    return {"least": pick(0), "paragraphs": paragraphs, "line": F.coalesce(F.when(F.col("main_rank") < 7, at), F.col("body_line")), "fallback": F.coalesce(F.col("main_rank") >= 7, F.lit(True))}


def quality_told(f) -> Told:
    n, kind, least, line = F.col("main_words"), F.col("kind"), f("least"), f("line")
    bare, thin = F.floor(least * 0.33), F.floor(least * 0.66)
    length = (
        F.when(n < bare, say("Very thin content (", kind, " page: under ", bare, " words, aim for ", least, "+)"))
        .when(n < thin, say("Thin content (", kind, " page: under ", thin, " words, aim for ", least, "+)"))
        .when(n < least, say("Content could be more substantial (", kind, " page: under ", least, " words)"))
    )
    issues = found(
        (length.isNotNull(), length, line),
        ((f("paragraphs") < 3) & (n > 200), "Poor paragraph structure (fewer than 3 paragraphs over 50 characters)", line),
        (n < 50, "Page has minimal content (under 50 words) - may be an empty shell or loading state", line),
    )
    loose = found((f("fallback") & (F.size(issues) > 0), "No <main> or <article> wrapper: boilerplate may be counted as content", F.col("body_line")))
    message = F.when((n >= least) & (F.size(issues) == 0), say("Good content quality: ", n, " words (", kind, " page)")).when(n >= bare, say(n, " words (", kind, " page) - needs improvement")).otherwise(say("Thin content: only ", n, " words (", kind, " page)"))
    fix = either(F.size(issues) > 0, say("Expand the main content to at least ", least, " words (", kind, " page), split it into 3+ real <p> paragraphs, and wrap it in <main> or <article>."))
    return Told(message, F.concat(issues, loose), fix, details={"words": n, "page_type": kind, "paragraphs": f("paragraphs")})


def freshness_facts() -> dict[str, Column]:
    times = having("time", also=lambda n: n["attrs"]["datetime"].isNotNull())

    def published(n: Column) -> Column:
        classes = F.concat_ws(" ", n["attrs"]["class"], F.get(nodes(), n["parent"])["attrs"]["class"])
        return F.coalesce(n["attrs"]["itemprop"] == "datePublished", F.lit(False)) | classes.rlike("(?i)(?<![A-Za-z0-9_])(published|pubdate|post-date|entry-date)(?![A-Za-z0-9_])")

    tag = lambda k: first(having("meta", also=lambda n: n["attrs"]["property"] == f"article:{k}_time"))
    stated = lambda k: F.coalesce(tag(k)["attrs"]["content"] != "", F.lit(False))
    own = lambda test: F.filter(times, test)
    return {
        "publish_meta": tag("published")["line"], "modify_meta": tag("modified")["line"], "publish_said": stated("published"), "modify_said": stated("modified"),
        "publish_time": first(own(published))["line"], "modify_time": first(own(lambda n: ~published(n)))["line"],
    }


def freshness_told(f) -> Told:
    publish = f("publish_said") | F.col("ld.published") | f("publish_time").isNotNull()
    modify = f("modify_said") | F.col("ld.modified") | f("modify_time").isNotNull()
    head = F.col("head_line")
    findings = found(
        (~publish & ~modify, "No publish or modified date (article:published_time, JSON-LD datePublished or <time datetime>)", head),
        (~publish & modify, "Missing publish date (article:published_time or JSON-LD datePublished)", F.coalesce(f("modify_meta"), F.col("ld.modified_line"), f("modify_time"), head)),
        (publish & ~modify, "Missing modified date (article:modified_time, JSON-LD dateModified or <time datetime>)", F.coalesce(f("publish_meta"), F.col("ld.published_line"), f("publish_time"), head)),
    )
    message = F.when(publish & modify, "Publish and modified dates found").when(publish, "Found publish date only").when(modify, "Found modified date only").otherwise("No publish or modified dates found")
    fix = (
        F.when(publish & modify, "")
        .when(publish, "Add the missing modified date as a meta tag (article:modified_time) or in JSON-LD (dateModified).")
        .when(modify, "Add the missing publish date as a meta tag (article:published_time) or in JSON-LD (datePublished).")
        .otherwise("Add article:published_time and article:modified_time meta tags, or JSON-LD datePublished/dateModified.")
    )
    return Told(message, findings, fix, predicted=F.col("ld.dates_templated"), details={"published": publish, "modified": modify})


def accessibility_facts() -> dict[str, Column]:
    aria = F.array(*(F.lit(r) for r in ("main", "navigation", "banner", "contentinfo", "search", "complementary")))
    marked = F.aggregate(elements(), F.lit(0), lambda a, n: a + F.coalesce(F.array_contains(aria, n["attrs"]["role"]), F.lit(False)).cast("int") + sum((n["attrs"][k].isNotNull().cast("int") for k in ("aria-label", "aria-labelledby", "aria-describedby")), F.lit(0)))
    return {"aria": marked}


def accessibility_told(f) -> Told:
    body = F.col("body_line")
    bare = F.filter(f("inputs"), lambda x: ~x["named"])
    n = F.size(f("inputs"))
    poor = F.coalesce(rounded((n - F.size(bare)) / F.nullif(n, F.lit(0)) * 100) < 50, F.lit(False))
    findings = F.concat(
        found((~f("main"), 'Missing <main> element or role="main"', body), (~f("nav"), 'Missing <nav> element or role="navigation"', body)),
        F.when(poor, each(bare, lambda x: say("Form <", x["tag"], "> has no label (label[for], aria-label, aria-labelledby or wrapping <label>)"))).otherwise(F.array().cast(FOUND)),
        found(((f("semantic") < 5) & ~f("main"), "Fewer than 5 semantic elements (main, nav, article, section, aside, header, footer, figure, figcaption)", body)),
    )
    message = (
        F.when(f("main") & (f("semantic") >= 5), say("Good accessibility: ", f("semantic"), " semantic elements", either(f("aria") > 0, say(", ", f("aria"), " ARIA attributes"))))
        .when(f("main"), say("Basic accessibility: has <main>, ", f("semantic"), " semantic elements"))
        .otherwise(say("Needs improvement: ", f("semantic"), " semantic elements, missing <main>"))
    )
    said = joined([(~f("main"), "wrap the primary content in <main>"), (~f("nav"), "wrap site navigation in <nav>"), (poor, "add <label for> or aria-label to form inputs")], ", ")
    return Told(message, findings, either(said != "", say("In the base layout, ", said, ".")), details={"semantic": f("semantic"), "inputs": n})


#: Signs of trust by how findings name them, and those that recommendations name.
TRUST = ("/about", "/contact", "/privacy", "/terms")


def author_told(f) -> Told:
    a, head, body = F.col("author"), F.col("head_line"), F.col("body_line")
    named, marked = a["name"].isNotNull(), a["meta"] | a["schema"] | a["microdata"]
    expert, trust = a["expertise"].isNotNull(), a["trust"]
    signs = F.size(trust)
    lacks = joined([(~F.array_contains(trust, t), t) for t in (*TRUST, "<address>")], ", ")
    findings = found(
        (~named & marked, "Author markup found but the author name is empty or unclear", F.coalesce(a["meta_line"], a["schema_line"], head)),
        (~named & ~marked, 'No author attribution (JSON-LD author, meta name="author" or byline)', head),
        (~expert, "No expertise signals (credentials, job title, years of experience) near the author or in the page text", F.coalesce(a["bio_line"], body)),
        (~(a["bio"] | a["link"]), "No author bio section or link to an author/about page", body),
        (signs < 3, say("Fewer than 3 trust signals; missing: ", lacks), body),
    )
    pages = joined([(~F.array_contains(trust, t), t) for t in TRUST[:3]], " and ", 2)
    several = sum(((~F.array_contains(trust, t)).cast("int") for t in TRUST[:3]), F.lit(0)) > 1
    fixes = [
        (~named & ~a["meta"] & ~a["schema"], 'Add author attribution: a JSON-LD Person as the Article author, or <meta name="author">'),
        (~named & (a["meta"] | a["schema"]), "Fill in the author name in your author markup"),
        (named & ~a["schema"], "Add a JSON-LD Person (name, jobTitle, sameAs) as the author"),
        (~expert, "Add credentials (certifications, degrees, years of experience) to establish expertise"),
        (~(a["bio"] | a["link"]), "Add an author bio section with background and qualifications"),
        ((signs < 3) & (pages != ""), say("Link to ", pages, " page", either(several, "s"), " for trustworthiness")),
        (named & ~a["article"], "Add an author property to your Article/BlogPosting schema"),
    ]
    there = [
        (named, say('Author: "', a["name"], '"', either(a["method"] == "schema", " (schema)"))),
        (expert, say("expertise (", a["expertise"], ")")),
        (a["bio"], F.lit("author bio")),
        (~a["bio"] & a["link"], F.lit("author link")),
        (signs >= 3, say(signs, "/5 trust signals")),
    ]
    gone = [
        (~named, either(marked, "author name (detected but empty)", "author attribution")),
        (~expert, F.lit("expertise credentials")),
        (~(a["bio"] | a["link"]), F.lit("author bio/profile")),
        (signs < 3, either(signs > 0, say("trust signals (only ", signs, "/5)"), "trust signals (about/contact pages)")),
    ]
    n, m = (sum((t.cast("int") for t, _ in x), F.lit(0)) for x in (there, gone))
    message = (
        F.when(n == 0, say("Missing: ", joined(gone, ", ", 3)))
        .when(m == 0, joined(there, " + "))
        .when(n >= m, say(joined(there, " + "), ". Missing: ", joined(gone, ", ", 1)))
        .otherwise(say("Missing: ", joined(gone, ", ", 2), ". Found: ", joined(there, " + ", 1)))
    )
    return Told(message, findings, either(m > 0, joined(fixes, ". ", 2)), details={"method": a["method"], "trust": F.array_join(trust, ", ")})


#: Buckets of structured data as reports name them, with their types and kind of points.
BUCKETS = (
    ("FAQ", ("FAQPage",), "faq"), ("HowTo", ("HowTo",), "main"), ("Product", ("Product",), "main"), ("Organization", ORGANIZATIONS, "main"), ("Article", R.ARTICLES, "main"), ("VideoObject", ("VideoObject",), "main"), ("Dataset", ("Dataset",), "main"),
    ("BreadcrumbList", ("BreadcrumbList",), "support"), ("ItemList", ("ItemList",), "support"), ("Person", ("Person",), "support"), ("WebSite", ("WebSite",), "support"),
)
TEMPLATED = "JSON-LD block contains template tags and could not be parsed from source"
BROKEN = "JSON-LD block is not valid JSON"


def structured_facts() -> dict[str, Column]:
    """buckets: per bucket that a page has, its name and kind, nodes, valid ones, what is wrong with the first invalid one, and lines."""
    rows = F.col("ld.nodes")
    table = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(kind).alias("kind"), F.split(F.lit(" ".join(types)), " ").alias("types")) for k, types, kind in BUCKETS))

    def bucket(t: Column) -> Column:
        own = F.filter(rows, lambda n: F.arrays_overlap(n["types"], t["types"]))
        real = F.filter(own, lambda n: ~n["reference"])
        good = F.size(F.filter(real, lambda n: F.when(t["name"] == "WebSite", n["named"]).otherwise(F.coalesce(n["valid"], F.lit(False)))))
        bad = first(F.filter(real, lambda n: ~F.coalesce(n["valid"], F.lit(True))))
        n = F.when(F.size(real) > 0, F.size(real)).otherwise(F.size(own))
        return F.struct(t["name"].alias("name"), t["kind"].alias("kind"), n.alias("n"), good.alias("good"), F.array_join(F.slice(bad["issues"], 1, 2), "; ").alias("issues"), F.coalesce(bad["line"], F.when(t["name"] == "WebSite", F.get(real, F.lit(0))["line"])).alias("line"))

    micro = F.filter(elements(), lambda n: n["attrs"]["itemscope"].isNotNull())
    rdfa = F.filter(elements(), lambda n: F.coalesce(n["attrs"]["typeof"], n["attrs"]["vocab"]).isNotNull())
    types = F.filter(F.transform(micro, lambda n: F.coalesce(n["attrs"]["itemtype"], F.lit(""))), lambda t: t != "")
    short = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"schema\.org/([A-Za-z0-9_]+)", 1), F.lit("")), t)
    typed = F.filter(F.flatten(F.transform(rdfa, lambda n: F.split(F.coalesce(n["attrs"]["typeof"], F.lit("")), r"\s+"))), lambda t: t != "")
    return {
        "buckets": F.filter(F.transform(table, bucket), lambda b: b["n"] > 0), "base": R.structured_data_base(), "score": R.structured_data_score(),
        "microdata": F.array_distinct(F.transform(types, short)), "micro": F.size(micro) > 0, "rdfa_types": F.array_distinct(typed), "rdfa": F.size(rdfa) > 0, "questions": visible_question_count(),
    }


def visible_question_count() -> Column:
    """Headings and summaries that end in a question mark."""
    asked = having("h2", "h3", "h4", "h5", "dt", "summary", also=lambda n: collapsed(text_content(n)).endswith("?"))
    return F.size(asked)


def at_lines(lines: Column, message: str) -> Column:
    """A finding of one message at each of some lines."""
    return F.coalesce(F.transform(lines, lambda n: F.struct(F.lit(message).alias("message"), n.alias("line"))), F.array()).cast(FOUND)


def structured_told(f) -> Told:
    ld, head, buckets, score = F.col("ld"), F.col("head_line"), f("buckets"), f("score")
    broken, waiting = at_lines(ld["broken_lines"], BROKEN), at_lines(ld["unresolved_lines"], TEMPLATED)
    marked = f("micro") | f("rdfa")
    named = lambda name: F.exists(buckets, lambda b: b["name"] == name)
    state = lambda b: F.when(b["good"] == b["n"], "valid").when(b["good"] == 0, "invalid").otherwise(say(b["good"], " valid, ", b["n"] - b["good"], " invalid"))
    said = F.array_join(F.transform(buckets, lambda b: say(b["n"], " ", b["name"], either(b["n"] == 1, " schema (", " schemas ("), state(b), ")")), ", ")
    bad = F.filter(buckets, lambda b: (b["good"] == 0) & b["line"].isNotNull())
    faults = each(bad, lambda b: either(b["issues"].isNotNull(), say(b["name"], " schema is invalid: ", b["issues"]), "WebSite schema has no name or url"))
    main = F.filter(buckets, lambda b: b["kind"] == "main")
    some, worse = F.exists(main, lambda b: b["good"] > 0), F.exists(main, lambda b: b["good"] == 0)
    n, held = F.coalesce(ld["blocks"], F.lit(0)), F.size(ld["unresolved_lines"]) > 0
    lifted = held & (f("base") < R.UNRESOLVED)
    more = found((~some & ~worse, "No main schema type (Organization, Article, Product, HowTo, VideoObject or Dataset)", ld["first_line"]))
    full = F.concat(broken, faults, F.when(lifted, waiting).otherwise(F.array().cast(FOUND)), more)
    home = path_key(C.url_path()) == "/"
    fixes = F.concat(
        F.array_compact(
            F.array(
                F.when(F.size(ld["broken_lines"]) > 0, "Fix the JSON syntax errors in the JSON-LD blocks"),
                F.when(~some, either(worse, "Fix the main schema type so it validates (+5 pts)", "Add Organization schema, plus Article on posts or Product on product pages (+7 pts)")),
                F.when(~named("FAQ") & (f("questions") >= 2), say("The page shows ", f("questions"), " questions: add FAQPage schema with the same questions and answers (+8 pts)")),
                F.when(some & (score < 15) & home & ~named("WebSite"), "Add WebSite schema with the site name and url (+1 pt)"),
                F.when(some & (score < 15) & ~home & ~named("BreadcrumbList"), "Add BreadcrumbList schema (+1 pt)"),
            )
        ),
        F.transform(F.filter(bad, lambda b: b["issues"].isNotNull()), lambda b: say("Fix ", b["name"], " schema: ", b["issues"])),
    )
    formats = joined([(f("micro"), say("Microdata (", F.array_join(f("microdata"), ", "), ")")), (f("rdfa"), say("RDFa (", F.array_join(f("rdfa_types"), ", "), ")"))], ", ")
    counted = say(n, " JSON-LD ", plural(n, "block", "blocks"))
    nothing, bare = (n == 0) & ~marked, ld["parsed"] == 0
    template = bare & ~marked & held
    one = lambda text: found((F.lit(True), text, head))
    cases = (
        (nothing, F.lit("No structured data found"), one("No structured data (JSON-LD, Microdata or RDFa)"), F.lit("Add JSON-LD structured data (Organization on every page, plus Article, FAQPage or Product where they fit).")),
        (bare & marked, say("Found: ", formats, " - consider adding JSON-LD for better AEO"), F.concat(broken, one("Structured data uses Microdata/RDFa only, no parseable JSON-LD")), F.lit("Convert Microdata/RDFa to JSON-LD, the format AI engines and search engines parse most reliably.")),
        (template, F.lit("JSON-LD is built from template tags and cannot be evaluated from source"), waiting, F.lit("Build the site and re-run the audit, or check the rendered page, to evaluate this JSON-LD.")),
        (bare, say(counted, ", none valid JSON"), broken, F.lit("Fix the JSON syntax in the JSON-LD blocks (trailing commas, unescaped quotes, missing brackets).")),
        (F.lit(True), either(said != "", say("Found: ", said), say(counted, ", no recognized schemas")), full, either(score < 15, F.array_join(F.slice(fixes, 1, 3), "; "))),
    )
    message, findings, fix = (F.coalesce(*(F.when(c[0], c[k]) for c in cases)) for k in (1, 2, 3))
    parts = F.array_join(F.transform(buckets, lambda b: say(b["name"], " ", b["good"], "/", b["n"])), ", ")
    return Told(message, findings, fix, inconclusive=template | (~bare & lifted), predicted=ld["templated"] & ~bare, details={"breakdown": parts, "questions": f("questions")})


def validity_facts() -> dict[str, Column]:
    judged = F.filter(F.col("ld.nodes"), lambda n: n["valid"].isNotNull())
    top = F.array_distinct(F.flatten(F.transform(F.filter(F.col("ld.nodes"), lambda n: n["primary"] & ~n["reference"]), lambda n: n["types"])))
    return {"judged": F.size(judged), "bad": F.filter(judged, lambda n: ~n["valid"]), "top": top, "base": R.validity_base()}


def validity_told(f) -> Told:
    ld, bad = F.col("ld"), f("bad")
    n, broken, waiting = F.coalesce(ld["blocks"], F.lit(0)), F.size(ld["broken_lines"]), at_lines(ld["unresolved_lines"], TEMPLATED)
    good = f("judged") - F.size(bad)
    rate = F.when(ld["parsed"] == 0, F.lit(0.0)).otherwise(F.coalesce(rounded(good / F.nullif(f("judged"), F.lit(0)) * 100), F.lit(100.0)))
    issues = lambda b: F.array_join(F.slice(b["issues"], 1, 2), "; ")
    kinds = F.flatten(F.transform(bad, lambda b: b["types"]))
    summary = F.array_join(F.transform(f("top"), lambda t: either(F.array_contains(kinds, t), F.concat(t, F.lit(" (invalid)")), t)), ", ")
    only = (ld["parsed"] == 0) & (broken == 0) & (n > 0)
    whole = (rate == 100) & (broken == 0)
    message = (
        F.when(n == 0, "No JSON-LD structured data to validate")
        .when(only, "JSON-LD is built from template tags and cannot be validated from source")
        .when(whole & (F.size(f("top")) > 0), say(F.size(f("top")), " schema", either(F.size(f("top")) > 1, "s"), " valid: ", summary))
        .when(whole, "No schemas found to validate")
        .otherwise(say(good, "/", f("judged"), " validatable schemas valid", either(summary != "", F.concat(F.lit(": "), summary)), either(broken > 0, say(" (", broken, " JSON error", either(broken > 1, "s"), ")"))))
    )
    findings = F.concat(at_lines(ld["broken_lines"], BROKEN), each(bad, lambda b: say(F.get(b["types"], F.lit(0)), " schema: ", issues(b))), waiting)
    more = F.size(bad) - 1
    kind, issue = F.get(F.get(bad, F.lit(0))["types"], F.lit(0)), F.get(F.get(bad, F.lit(0))["issues"], F.lit(0))
    low = F.lower(issue)
    lacks = lambda *words: low.contains("missing") & low.rlike("|".join(words))
    advised = (
        F.when(lacks("price"), say("Add 'price' and 'priceCurrency' to your ", kind, " offers"))
        .when(lacks("name"), say("Add a 'name' property to your ", kind, " schema"))
        .when(lacks("image"), say("Add an 'image' property to your ", kind, " schema"))
        .when(lacks("description"), say("Add a 'description' property to your ", kind, " schema"))
        .when(low.rlike("mainentity|question"), "Add 'mainEntity' with Question/Answer items to your FAQPage")
        .when(low.rlike("answer"), "Add 'acceptedAnswer' with 'text' to each Question in your FAQPage")
        .when(low.rlike("step|howto"), "Add 'step' array with HowToStep items to your HowTo schema")
        .otherwise(say(issue, ". See schema.org/", kind, " for required fields"))
    )
    fix = (
        F.when(n == 0, "Add JSON-LD structured data first, then validation can be checked.")
        .when(only, "Build the site and re-run the audit, or validate the rendered page.")
        .when(broken > 0, say("Fix JSON syntax errors in ", broken, " JSON-LD block", either(broken > 1, "s"), ". Use a JSON validator to check your structured data."))
        .when(F.size(bad) > 0, say("Fix ", kind, " schema: ", advised, either(more > 0, say(". ", more, " more schema", either(more > 1, "s"), " need", either(more == 1, "s"), " attention."))))
        .otherwise("")
    )
    lifted = (F.size(ld["unresolved_lines"]) > 0) & (f("base") < 3)
    return Told(message, F.when(n == 0, found((F.lit(True), "No JSON-LD structured data to validate", F.col("head_line")))).otherwise(findings), fix, inconclusive=only | ((n > 0) & lifted), predicted=ld["templated"] & (n > 0) & ~only, details={"rate": number(rate)})


#: What a site says of a page that says noindex: nothing that excuses it, its sitemap lists it, or it is kept out of search on purpose.
PLAIN, LISTED, UNLISTED, NO_MAP = "plain", "listed", "unlisted", "no map"


def kept_out_told(f, case: str) -> Told:
    """A page that is kept out of search on purpose."""
    why = "noindex, and the site has no sitemap that lists pages" if case == NO_MAP else "noindex, not in the sitemap"
    return Told(F.lit(f"Kept out of search on purpose ({why})"), F.array().cast(FOUND), details={"intentional": F.lit(True)})


def indexability_words() -> dict[str, Column]:
    """What is said of a page whatever its site says of it: findings before and after those of the case, and lists of faults and fixes."""
    f, head = fact("crawlability.indexability"), F.col("head_line")
    said, cost, canonical = f("said"), f("cost"), f("canonicals")
    status = F.when(F.size(canonical) == 0, "No canonical tag found").when(F.size(canonical) > 1, "Multiple canonical tags found").when(~f("valid"), "Canonical tag has no valid href").when(f("elsewhere"), "Canonical points to a different domain").when(cost == 2, "Canonical points to a different URL (this page may not be indexed)")
    what = lambda d: F.when(d["noindex"] & d["nofollow"], "noindex, nofollow").when(d["noindex"], "noindex").otherwise("nofollow")
    told = F.filter(said, lambda x: x["d"]["noindex"] | x["d"]["nofollow"])
    soft = f("soft")
    signs = joined([(soft["title"], "error words in the title"), (soft["thin"], "under 200 words of main content"), (soft["body"], '"404" or "page not found" near the top of the page')], ", ")
    findings = F.concat(
        each(told, lambda x: either(x["name"].isNotNull(), say('<meta name="', F.coalesce(x["name"], F.lit("")), '"> blocks indexing (', what(x["d"]), ")"), say("X-Robots-Tag header blocks indexing (", what(x["d"]), ")"))),
        each(F.slice(canonical, 2, 1_000_000), lambda x: "Duplicate canonical link"),
        found((status.isNotNull() & (F.size(canonical) < 2), status, F.coalesce(F.get(canonical, F.lit(0))["line"], head)), (R.is_soft_404(soft), say("Looks like a soft 404 (", signs, ")"), F.coalesce(F.col("title_line"), F.lit(1)))),
    )
    faults = F.array_compact(F.array(F.when(R.is_soft_404(soft), "Soft 404 detected"), F.when(f("elsewhere"), "Canonical points to a different domain")))
    fixes = F.array_compact(F.array(F.when(R.is_soft_404(soft), "Make sure this page has real content, or serve it with a 404 status"), F.when(f("elsewhere"), "Point the canonical at this page on the production host")))
    state = R.state_of(said)
    small = joined([(status.isNotNull(), 'Emit exactly one absolute, self-referencing <link rel="canonical"> on the production host'), (state["nofollow"], "Remove nofollow so links on this page are followed")], "; ")
    fine = say("Indexability: ", either(status.isNull(), "canonical OK", "canonical issue"), ", indexable, not a soft 404", either(state["nofollow"], ", nofollow"))
    header = (F.size(told) > 0) & ~F.exists(told, lambda x: x["name"].isNotNull())
    return {"findings": findings, "faults": faults, "fixes": fixes, "small": small, "fine": fine, "header": header, "noindex": state["noindex"], "nofollow": state["nofollow"], "for_all": state["for_all"]}


def indexability_told(f, case: str = PLAIN) -> Told:
    """homepage is read from the page's path; what else of its site matters is the case."""
    if case in (UNLISTED, NO_MAP):
        return kept_out_told(f, case)
    if case == LISTED:
        fault, fix = F.lit("Page has a noindex directive but is listed in the sitemap"), F.lit("Remove this page from the sitemap if it should stay out of search, or remove noindex if it should be found")
        more = found((F.lit(True), "noindex page is listed in the sitemap: the sitemap asks engines to index it, the page tells them not to", F.lit(None)))
    else:
        fault = F.when(f("noindex"), either(path_key(C.url_path()) == "/", "Homepage has a noindex directive", "Page has a noindex directive"))
        fix = F.when(f("noindex"), either(f("header"), "Remove noindex from the X-Robots-Tag response header for this path", "Remove noindex / none from the robots meta tag in production"))
        more = F.array().cast(FOUND)
    faults = F.concat(F.array_compact(F.array(fault)), f("faults"))
    fixes = F.concat(F.array_compact(F.array(fix)), f("fixes"))
    bad = F.size(faults) > 0
    message = F.when(bad, say("Critical indexability issues: ", F.array_join(faults, "; "))).otherwise(f("fine"))
    recommendation = F.when(bad, F.concat(F.array_join(fixes, "; "), F.lit("."))).when(f("small") != "", F.concat(f("small"), F.lit("."))).otherwise("")
    return Told(message, F.concat(f("findings"), more), recommendation, details={"noindex": f("noindex"), "nofollow": f("nofollow"), "soft_404": R.is_soft_404(f("soft")), "canonical_cost": f("cost")})


def server_rendered_told(f) -> Told:
    sent, root, body = f("sent"), f("root"), F.col("body_line")
    rooted = root.isNotNull()
    empty, partial = rooted & (sent < 50), rooted & (sent >= 50) & (sent < 150)
    near = ~rooted & (sent < 30) & f("client")
    late = partial | near
    findings = found(
        (empty, say("Empty app container (", root["selector"], ") with almost no text in the HTML: the page is rendered by JavaScript"), root["line"]),
        (partial, say("Empty app container (", root["selector"], ") next to little server text: main content may only appear after JavaScript runs"), root["line"]),
        (near, "HTML has almost no text and loads scripts: content may be rendered by JavaScript", body),
        (late & ~f("h1"), "No <h1> in the server HTML (if JavaScript adds one, agents never see it)", body),
        (late & (C.title() == ""), "No <title> in the server HTML (if JavaScript sets it, agents never see it)", F.col("head_line")),
    )
    message = F.when(empty, say("Rendered by JavaScript: empty ", root["selector"], " and ", sent, " words in the HTML")).when(~late, say("Server-rendered: ", sent, " words in the HTML")).otherwise(say(sent, " words in the server HTML - some content may depend on JavaScript"))
    fix = either(empty | late, "Serve the main content, <h1> and <title> in the HTML using SSR, static generation or prerendering; most AI crawlers and agents do not run JavaScript. Verify live with curl -s <url>.")
    return Told(message, findings, fix, inconclusive=near, predicted=partial | (late & (~f("h1") | (C.title() == ""))), details={"words": sent})


def controls_told(f) -> Told:
    #: By kind: what is wrong in a finding, and how it is mended.
    kinds = (
        ("buttons", lambda x: say("Button agents cannot use (", x["reason"], ")"), 'give every button a text label, aria-label or image alt, and make custom buttons focusable with tabindex="0"'),
        ("links", lambda x: say("Link that does not navigate (", x["reason"], "); use a real href or a <button>"), "give links a real href and use <button> for in-page actions"),
        ("clicked", lambda x: "Inline onclick on a non-interactive element without tabindex; use a <button>", "replace div/span click handlers with <button> elements"),
        ("fields", lambda x: "Personal-data input without an autocomplete attribute", "add autocomplete attributes (email, tel, name, street-address) to personal-data inputs"),
    )
    bad = {k: F.filter(f(k), lambda x: x["reason"] != "") for k, _, _ in kinds}
    low = {k: F.coalesce(rounded((F.size(f(k)) - F.size(bad[k])) / F.nullif(F.size(f(k)), F.lit(0)) * 100) < 90, F.lit(False)) for k, _, _ in kinds}
    findings = F.concat(*(F.when(low[k], each(bad[k], m)).otherwise(F.array().cast(FOUND)) for k, m, _ in kinds))
    total = sum((F.size(bad[k]) for k, _, _ in kinds), F.lit(0))
    some = sum((F.size(f(k)) for k, _, _ in kinds), F.lit(0)) > 0
    message = F.when(~some, "No interactive controls found on this page").when(total == 0, "All interactive controls are usable by agents").otherwise(say(total, " control", either(total != 1, "s"), " an agent cannot reliably operate"))
    said = joined([(low[k], fix) for k, _, fix in kinds], "; ")
    return Told(message, findings, either(said != "", F.concat(capital(said), F.lit("."))), details={k: F.concat_ws("/", F.size(bad[k]), F.size(f(k))) for k, _, _ in kinds})


NO_FACTS: Callable[[], dict[str, Column]] = dict
TELLINGS: dict[str, tuple[Callable[[], dict[str, Column]], Callable]] = {
    "meta.title": (title_facts, title_told),
    "meta.description": (description_facts, description_told),
    "meta.viewport": (viewport_facts, viewport_told),
    "meta.language": (language_facts, language_told),
    "meta.open-graph": (open_graph_facts, open_graph_told),
    "meta.twitter-cards": (twitter_facts, twitter_told),
    "content.headings": (headings_facts, headings_told),
    "content.image-alt": (image_alt_facts, image_alt_told),
    "content.internal-links": (links_facts, links_told),
    "content.quality": (quality_facts, quality_told),
    "content.freshness": (freshness_facts, freshness_told),
    "content.accessibility": (accessibility_facts, accessibility_told),
    "content.author": (NO_FACTS, author_told),
    "structured-data.present": (structured_facts, structured_told),
    "structured-data.valid": (validity_facts, validity_told),
    "crawlability.indexability": (NO_FACTS, indexability_told),
    "agent-readiness.server-rendered": (NO_FACTS, server_rendered_told),
    "agent-readiness.controls": (NO_FACTS, controls_told),
}


def page_tellings(pages: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, Column]:
    """Parsed pages with the facts of checks, and the expression of their runs: an array, a struct for each run, null for cases that a page has not."""
    pages = with_facts(pages)
    with dealt():
        return _tellings(pages, checks)


def _tellings(pages: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, Column]:
    pages = pages.select("*", *(c.alias(k) for k, c in shared().items()))
    own = [c.alias(f"{x.id}/{k}") for x in checks for k, c in (x.facts() | TELLINGS[x.id][0]()).items()]
    pages = pages.select("*", *own)
    index = "crawlability.indexability"
    indexed = any(x.id == index for x in checks)
    pages = pages.select("*", *(c.alias(f"{index}/{k}") for k, c in indexability_words().items())) if indexed else pages
    no, blank = F.lit(False), F.lit(None).cast("string")

    def entry(check: Check, told: Told, score: Column, case: Column = blank) -> Column:
        placed = lambda x: F.transform(x, lambda f: F.struct(f["message"].alias("message"), F.col("url").alias("file"), f["line"].alias("line")))
        details = F.map_from_arrays(F.array(*(F.lit(k) for k in told.details)), F.array(*(v.cast("string") for v in told.details.values()))) if told.details else F.create_map().cast("map<string,string>")
        return F.struct(
            F.lit(check.id).alias("check_id"), score.cast("double").alias("score"), no.alias("na"), F.coalesce(told.inconclusive, no).alias("inconclusive"), F.coalesce(told.predicted, no).alias("predicted"),
            F.coalesce(told.message, F.lit("")).alias("message"), F.coalesce(told.recommendation, F.lit("")).alias("recommendation"), placed(told.findings).alias("findings"), placed(told.advice).alias("advice"), details.alias("details"), case.alias("case"),
            (fact(index)("for_all") if indexed else no).alias("for_all"),
        )

    entries = []
    for check in checks:
        f, tell = fact(check.id), TELLINGS[check.id][1]
        if check.id == index:
            full = F.lit(float(check.weight))
            cases = [entry(check, tell(f, c), full if c in (UNLISTED, NO_MAP) else check.score(), F.lit(c)) for c in (PLAIN, LISTED, UNLISTED, NO_MAP)]
            entries += [F.when(f("noindex"), cases[0]).otherwise(entry(check, tell(f), check.score())), *(F.when(f("noindex"), c) for c in cases[1:])]
        else:
            entries.append(entry(check, tell(f), check.score()))
    return pages, F.array(*entries)


def inlined(pages: DataFrame, runs: Column) -> DataFrame:
    """A row for each run in an array of them, but for cases that a page has not."""
    return pages.select("site_id", "page_id", F.col("page_id").alias("seq"), F.inline(runs)).filter("check_id is not null")


def page_runs(pages: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Runs of page checks for plans.engine, from parsed pages (url, nodes, author, robots_header).

    What a noindex is worth depends on the page's site: such a page's indexability is told for each case,
    and `decided` keeps the one that holds.
    """
    pages, runs = page_tellings(pages, checks)
    return inlined(pages, runs)


def decided(runs: DataFrame, intents: DataFrame) -> DataFrame:
    """Of runs told for several cases, the one that holds; intents: operators.access.page_intents.

    Few pages say noindex, so few rows meet the intents.
    """
    told = runs.filter("case is not null").join(intents.select("site_id", "page_id", "listed", "homepage", "single"), ["site_id", "page_id"])
    meant = F.col("for_all") & ~F.col("homepage") & ~F.col("single") & ~F.coalesce("listed", F.lit(False))
    case = F.when(meant & F.col("listed").isNull(), NO_MAP).when(meant, UNLISTED).when(F.coalesce("listed", F.lit(False)) & ~F.col("homepage") & ~F.col("single"), LISTED).otherwise(PLAIN)
    return runs.filter("case is null").unionByName(told.filter(F.col("case") == case).select(runs.columns)).drop("case", "for_all")
