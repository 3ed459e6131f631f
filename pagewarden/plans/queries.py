"""Registered queries of the site audit, and SQL that gives the same rows.

The pages table has few of the tags that checks read, so queries add tags to each page's head and
article, in combinations that page_id decides (AUGMENTED, one expression that both dialects read). The
SQL knows nothing of the combinations: it reads the resulting HTML with regular expressions and JSON
functions and derives every score from what stands there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.functions.nodes import dealt, first, having
from pagewarden.operators.access import BOTS, MAJOR_BOTS, bot_access, bot_crawlability, directives, excluded_pages, headers_for, noindex_for_all, page_intents, path_key, sitemap_score, template_sample
from pagewarden.operators.checks import GENERIC_ANCHORS, GENERIC_DESCRIPTIONS, GENERIC_HEADINGS, GENERIC_TITLES, LANGUAGES, POST_TYPES, REGIONS, WORD_COUNTS, fact, resolved, url_path, with_facts
from pagewarden.operators.readiness import ALL_PAGE_CHECKS, APP_ROOTS, IMPERSONAL_TYPES, MAIN_BUCKETS, PERSONAL, SUPPORT_BUCKETS, robots_state
from pagewarden.operators.results import DESCRIPTION_FIX, OPEN_GRAPH_FIX, TWITTER_FIX, VIEWPORT_TAG, decided
from pagewarden.operators.results import inlined, page_tellings
from pagewarden.operators.results import page_runs as told_pages
from pagewarden.operators.site_checks import API_SEGMENTS, ARTIFACTS, api_evidence, artifacts_found, content_signals, https_score, is_html, llms_txt_score, markdown_alternate, markdown_score, protocols_score
from pagewarden.operators.site_results import HTTPS_HOSTS, LABELS, bot_list, crawler_blocks, crawler_rules, declared_schemes, evidence, https_runs, live_markdown_runs, llms_runs, mixed_parts, page_schemes, predicted_http_runs, probe_plan, protocol_runs, robots_runs, scheme_votes, signal_runs, sitemap_runs
from pagewarden.plans.engine import RUBRIC, category_totals, check_states, console_summaries, finding_groups, payloads, reports, rubric_table, rubric_totals, site_totals
from pagewarden.plans.facts import brands, llms_drafts, page_facts
from pagewarden.plans.scorecard import CHECK_ORDER, category_summary, check_summary, compared, excluding, page_results, problems, site_of, site_summary, with_nodes
from pagewarden.sources.author import AUTHOR_PATHS, EXPERTISE, TRUST_PATHS, WORKS
from pagewarden.sources.site_files import header_pattern_regex, header_rules, sitemap_locs
from pagewarden.sources.site_tree import HOSTS, generators, hosts, http_behaviour, page_list, predicted_answers, predicted_artifacts, redirect_rules, served_roots, stacks, unknown_url_points
from pagewarden.sources.staging import staged
from pagewarden.sources.structured_data import KINDS

_LONG = "A description of one hundred and thirty characters or so that says what stands on this page, in words that do differ from its name."
_OWN = "regexp_extract(html, '<title>([^<]*)', 1)"
_LD = '<script type="application/ld+json">{}</script>'


def _choice(n: int, *parts: str) -> str:
    """SQL for one of the parts by page_id % n, else nothing; a part that begins with concat( is SQL, others are text."""
    said = [p if p.startswith("concat(") else f"'{p}'" for p in parts]
    return f"CASE page_id % {n} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(said)) + " ELSE '' END"


_HEAD = (
    _choice(7, '<meta name="viewport" content="width=device-width, initial-scale=1">', '<meta name="viewport" content="width=600; initial-scale=2">', '<meta name="viewport" content="initial-scale=1.0">', '<meta name="viewport" content="width=device-width">', '<meta name="viewport" content="WIDTH=Device-Width,Initial-Scale=1.00">', '<meta name="viewport" content="width=980">'),
    _choice(11, "", '<meta name="description" content=" ">', '<meta name="description" content="This page has few words.">', f'<meta name="Description" content="{_LONG}">', f'<meta name="description" content="Welcome to all of this. {_LONG}">', f'<meta name="description" content="{_LONG} And more is said besides it here.">', f'<meta name="description" content="{_LONG} {_LONG}">', f"concat('<meta name=\"description\" content=\"', {_OWN}, '\">')", '<meta name="description" content="Eighty characters or so, which is less than one would want to read in a list of found pages.">', '<meta name="description" content="Words about words and other words: of words that stand for words, in one hundred and twenty characters or somewhat more than that.">'),
    _choice(5, "", """concat('<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="https://x.example/i.png"><meta property="og:type" content="article"><meta property="og:url" content="', url, '">')""", '<meta property="og:title" content=" ">', '<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="i.png">', '<meta name="og:title" content="t"><meta name="og:description" content="d"><meta name="og:type" content="website"><meta property="og:url" content="https://x.example/a">'),
    _choice(4, "", '<meta name="twitter:card" content="summary"><meta name="twitter:title" content="t"><meta name="twitter:description" content="d"><meta name="twitter:image" content="i.png">', '<meta name="twitter:card" content="poster"><meta property="twitter:title" content="t"><meta name="twitter:description" content="d">', '<meta name="twitter:card" content="summary_large_image"><meta name="twitter:title" content=" ">'),
    _choice(6, "", '<meta property="article:published_time" content="2024-01-02">', '<meta property="article:published_time" content="2024-01-02"><meta property="article:modified_time" content="2024-02-03">', '<meta property="article:modified_time" content="2024-02-03">'),
    _choice(13, "", _LD.format('{"@type": "Organization", "name": "O"}') + _LD.format('{"@type": "WebSite", "url": "u"}'), _LD.format('{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q", "acceptedAnswer": {"@type": "Answer", "text": "a"}}]}'), _LD.format("{,"), _LD.format('{"@type": "Person", "name": "P"}'), _LD.format('{"@type": "Article", "headline": "h", "author": "A. Writer", "datePublished": "2024-01-02", "dateModified": "2024-01-03"}'), _LD.format('{"@type": "Article", "datePublished": "soon"}'), _LD.format('{"@type": "VideoObject", "name": "n", "description": "d", "thumbnailUrl": "t", "uploadDate": "2024-01-02"}') + _LD.format('{"@type": "Dataset", "name": "n", "description": "d"}'), _LD.format('{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q"}]}'), _LD.format('{"@type": "Organization"}') + _LD.format('{"@type": "Person", "name": "P"}') + _LD.format("no"), _LD.format('{"@type": "BreadcrumbList", "itemListElement": [{"position": 1, "name": "n"}]}'), _LD.format('{"@type": "Product", "name": "n"}')),
    _choice(9, "", "concat('<link rel=\"canonical\" href=\"', url, '\">')", '<link rel="canonical" href="/elsewhere/than/here">', '<link rel="canonical" href="https://other.example/a">', '<link rel="canonical" href="/a"><link rel="canonical" href="/b">', '<link rel="canonical" href="">', "concat('<link rel=\"canonical\" href=\"', upper(url), '\">')"),
    _choice(12, "", '<meta name="robots" content="noindex, nofollow">', "", '<meta name="robots" content="nofollow">', '<meta name="robots" content="max-image-preview:none, follow">', "", '<meta name="ROBOTS" content="NONE">', '<meta name="googlebot" content="noindex">'),
    _choice(10, "", '<link rel="alternate" type="text/markdown" href="/a.md">', "", '<link rel="service-desc" href="/described.json">'),
    _choice(8, "", '<meta name="author" content="Jane Doe">', '<meta name="author" content=" ">', '<meta property="article:author" content="Jane Doe">', '<meta name="twitter:creator" content="@jane">'),
)
_BODY = (
    _choice(5, "", "<h2>Parts of it</h2><h3>Smaller parts</h3>", "<h4>Skipped to</h4>", "<h1>Once more</h1>", "<h2>More</h2><h2>Info</h2><h2>Content</h2><h2> section </h2>"),
    _choice(6, "", '<img src="a.png" alt="A part"><img src="b.png">', '<img src="c.png" alt="" role="presentation">', '<img src="a.png" alt="A part"><img src="b.png" alt="B"><img src="c.png" alt=" "><img src="d.png" alt="D">', '<img src="e.png" alt="" aria-hidden="true"><img src="f.png">', '<img src="http://x.example/g.png" alt="G">'),
    _choice(7, "", '<form><label for="q">Find</label><input id="q"><input type="hidden" name="h"></form>', '<form><input name="userEmail"><input type="text" name="q"><textarea></textarea></form>', '<form><label>Mail <input type="email" autocomplete="email"></label></form>', '<form><input type="tel" aria-label="Call" autocomplete="off"><select></select><select></select></form>'),
    _choice(4, "", '<section role="main"></section>', "<section></section><aside></aside><figure></figure>"),
    _choice(6, "", '<p><a href="/k1">click here</a> <a href="/k2">Named part</a></p>', '<p><a href="/k1">here</a> <a href="/k2">More</a> <a href="/k3">x</a> <a href="/k4">link</a> <a href="/k5">go</a></p>', '<p><a href="/a1">One part</a> <a href="/a2">Another</a> <a href="/a3">Third one</a></p>', '<p><a href="#">top</a> <a href="javascript:x()">do</a> <a href="mailto:a@b.example">write</a></p>'),
    _choice(5, "", "<button></button>", "<button>Go</button>", '<div onclick="x()">y</div>', "<div hidden><button></button></div>"),
    _choice(9, "", '<p class="byline">Written by Jane Doe, senior editor</p>', '<div class="author-bio">Jane.</div>', '<p>Over the years: 12 years of experience.</p>'),
    _choice(4, "", '<p><a href="/about">About us</a> <a href="/contact">Contact us</a> <a href="/privacy">Privacy</a></p>', '<p><a href="/terms">Terms</a></p><address>Here</address>'),
    _choice(7, "", "", '<time datetime="2024-03-01">1 March</time>', '<time class="entry-date" datetime="2024-03-01">1 March</time>', '<time itemprop="datePublished" datetime="2024-03-01">then</time><time datetime="2024-03-02">now</time>'),
    _choice(10, "", '<div id="root"></div>', '<div itemscope></div>', '<div id="app">full</div>'),
)
#: A page's HTML with the tags in; Spark SQL and DuckDB read it alike.
AUGMENTED = (
    f"replace(replace(replace(html, '<title>', CASE WHEN page_id % 17 = 5 THEN '<title>Page not found ' ELSE '<title>' END), '</head>', concat({', '.join(_HEAD)}, '</head>')), '</article>', concat({', '.join(_BODY)}, '</article>'))"
)


#: What pages are sent with as X-Robots-Tag.
ROBOTS_HEADER = "CASE page_id % 19 WHEN 4 THEN 'noindex' WHEN 7 THEN 'otherbot: noindex' WHEN 9 THEN 'nofollow' END"


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table with tags added."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").withColumns({"html": F.expr(AUGMENTED), "robots_header": F.array_compact(F.array(F.expr(ROBOTS_HEADER)))})


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _plain(html: str, breaks: str = "' '") -> str:
    """SQL for the text of HTML: entities that occur decoded, blocks and line breaks as white space."""
    blocks = "</(?:p|h[1-6]|form|div|section|aside|figure|article|address|ul|li|nav)>|<br[^>]*>"
    text = f"regexp_replace(regexp_replace({html}, '{blocks}', {breaks}, 'g'), '<[^>]*>', '', 'g')"
    return f"replace(replace(replace(replace(replace({text}, '&quot;', '\"'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


def _share(found: str, test: str) -> str:
    return f"coalesce(floor(len(list_filter({found}, lambda x: {test})) / nullif(len({found}), 0) * 100 + 0.5), 100)"


def _content(attr: str, key: str) -> str:
    return f"CASE WHEN regexp_matches(h, '<meta {attr}=\"{key}\" content=\"') THEN regexp_extract(h, '<meta {attr}=\"{key}\" content=\"([^\"]*)\"', 1) END"


def _either(key: str, first: str, second: str) -> str:
    return f"coalesce({_content(first, key)}, {_content(second, key)})"


def _url_sql(u: str) -> str:
    return f"lower(regexp_replace({u}, '/$', ''))"


_EXPERT = " OR ".join(f"regexp_matches(shown, '{'(?i)' if p.flags & 2 else ''}{p.pattern.replace('(?=' + chr(92) + 's|$)', '(?:' + chr(92) + 's|$)').replace('(?=' + chr(92) + 's|,|$)', '(?:' + chr(92) + 's|,|$)')}')" for p in EXPERTISE)
_KIND = "CASE " + " ".join(f"WHEN t IN {_in(t for t, k in KINDS.items() if k == kind)} THEN '{kind}'" for kind in dict.fromkeys(KINDS.values())) + " END"
_ANY = lambda types, ok=False: f"len(list_filter(ld, lambda x: x.t IN {_in(types)}{' AND x.ok' if ok else ''})) > 0"
_LEAST = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in WORD_COUNTS.items()) + " END"
_ATTR = lambda x, k: f"regexp_extract({x}, '(?i)\\s{k}=\"([^\"]*)\"', 1)"
_HAS = lambda x, k: f"regexp_matches({x}, '(?i)\\s{k}(=|\\s|>)')"
#: Whether the words of a field's name hold one of personal data.
_FIELD = lambda x: f"len(list_filter(regexp_split_to_array(lower(regexp_replace(concat({_ATTR(x, 'name')}, ' ', {_ATTR(x, 'id')}), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[-_0-9 ]+'), lambda w: w IN {_in(PERSONAL)})) > 0"

#: One key for the forms of a path.
_KEY = lambda p: f"coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({p}, '[?#].*$', ''), '(?i)/index\\\\.html?$', '/'), '(?i)\\\\.html?$', ''), '/+$', '')), ''), '/')"
#: Scores per page, read from the HTML.
_PAGES = rf"""
page§ AS (SELECT page_id, url, §html AS h, §header AS sent_header FROM pages),
raw§ AS (
  SELECT page_id, url, h, sent_header, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site_id,
    lower(coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')) AS path,
    trim(regexp_replace({_plain("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) AS title,
    regexp_extract(h, '<html lang="([^"]*)"', 1) AS lang,
    regexp_replace(regexp_replace(regexp_extract(h, '(?s)<body[^>]*>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS body,
    regexp_extract(h, '(?s)<article>(.*)</article>', 1) AS article,
    regexp_extract_all(h, '(?s)<script type="application/ld\+json">(.*?)</script>', 1) AS blocks,
    regexp_extract_all(h, '<link rel="canonical" href="([^"]*)"', 1) AS canonicals,
    {_either('og:title', 'property', 'name')} AS og_title, {_either('og:description', 'property', 'name')} AS og_description, {_either('og:image', 'property', 'name')} AS og_image, {_either('og:url', 'property', 'name')} AS og_url, {_either('og:type', 'property', 'name')} AS og_type,
    {_either('twitter:card', 'name', 'property')} AS tw_card, {_either('twitter:title', 'name', 'property')} AS tw_title, {_either('twitter:description', 'name', 'property')} AS tw_description, {_either('twitter:image', 'name', 'property')} AS tw_image,
    regexp_extract(h, '(?i)<meta name="description" content="([^"]*)"', 1) AS description,
    regexp_matches(h, '<meta name="viewport"') AS sized, string_split_regex(regexp_extract(h, '<meta name="viewport" content="([^"]*)"', 1), '[,;]') AS settings,
    list_transform(regexp_extract_all(h, '(?i)<meta name="(?:robots|googlebot|bingbot)" content="[^"]*"'), lambda m: lower(regexp_extract(m, 'content="([^"]*)"', 1))) || [coalesce(sent_header, '')] AS said
  FROM page§),
keyed§ AS (SELECT site_id, page_id, §key AS key, regexp_extract(h, '(?i)<meta name="robots" content="([^"]*)"', 1) AS told, coalesce(sent_header, '') AS sent_with FROM raw§),
wanted§ AS (SELECT k.site_id, k.page_id, (len(list_filter(string_split(lower(told), ','), lambda x: trim(x) IN ('noindex', 'none'))) > 0 OR len(list_filter(string_split(lower(sent_with), ','), lambda x: trim(x) IN ('noindex', 'none'))) > 0) AND key <> '/'
    AND NOT EXISTS (SELECT 1 FROM keyed§ l WHERE l.site_id = k.site_id AND l.key = k.key AND l.page_id % 8 = 3) AND count(*) OVER (PARTITION BY k.site_id) > 1 AS out FROM keyed§ k),
facts§ AS (
  SELECT *, (SELECT w.out FROM wanted§ w WHERE w.page_id = raw§.page_id) AS meant, length(title) AS n, string_split(title, ' ') AS tokens, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments,
    {_words(_plain('article'))} AS words, {_words("regexp_replace(body, '<[^>]*>', ' ', 'g')")} AS sent, concat(regexp_extract(article, '<p class="byline">([^<]*)', 1), ' ', substr({_plain('body')}, 1, 5000)) AS shown,
    len(list_filter(string_split(article, '<p>')[2:], lambda x: length(trim(replace(regexp_replace(regexp_extract(x, '(?s)^(.*?)(?:</p>|$)', 1), '<[^>]*>', '', 'g'), '&amp;', '&'))) > 50 OR (NOT contains(x, '</p>') AND length(regexp_replace(article, '<[^>]*>', '', 'g')) > 80))) AS paragraphs,
    list_transform(regexp_extract_all(h, '(?s)<h[1-6][^>]*>.*?</h[1-6]>'), lambda x: {{'level': substr(x, 3, 1)::INT, 'text': lower(trim({_plain('x')}))}}) AS heads,
    regexp_extract_all(h, '<img [^>]*>') AS images,
    list_transform(regexp_extract_all(h, '(?s)<a [^>]*>.*?</a>'), lambda x: {{'href': {_ATTR('x', 'href')}, 'text': lower(trim({_plain('x')})), 'said': trim({_plain('x')}), 'inside': contains(article, x)}}) AS anchors,
    regexp_extract_all(article, '(?s)<(?:input|textarea|select)(?: [^>]*)?>') AS fields,
    list_transform(regexp_extract_all(article, '<label for="([^"]*)"', 1), lambda x: x) AS labelled,
    list_transform(list_filter(blocks, lambda b: json_valid(b)), lambda b: {{'t': json_extract_string(b, '$."@type"'), 'b': b}}) AS nodes,
    len(list_filter(blocks, lambda b: NOT json_valid(b))) AS broken, list_filter(list_transform(settings, lambda x: string_split(x, '=')), lambda x: len(x) > 1) AS pairs,
    list_transform(list_filter(flatten(list_transform(said, lambda x: string_split(x, ','))), lambda x: NOT regexp_matches(trim(x), '^(max-snippet|max-image-preview|max-video-preview|unavailable_after)\s*:')), lambda x: trim(x)) AS rules
  FROM raw§),
judged§ AS (
  SELECT *, list_transform(nodes, lambda x: {{'t': x.t, 'ok': CASE {_KIND.replace(' t ', ' x.t ')}
      WHEN 'Organization' THEN coalesce(json_extract_string(x.b, '$.name'), '') <> '' WHEN 'Person' THEN coalesce(json_extract_string(x.b, '$.name'), '') <> ''
      WHEN 'Article' THEN json_exists(x.b, '$.headline') AND json_exists(x.b, '$.author') AND regexp_matches(coalesce(json_extract_string(x.b, '$.datePublished'), ''), '^\d{{4}}-\d{{2}}-\d{{2}}$')
      WHEN 'VideoObject' THEN json_exists(x.b, '$.name') AND json_exists(x.b, '$.description') AND json_exists(x.b, '$.thumbnailUrl') AND json_exists(x.b, '$.uploadDate')
      WHEN 'Dataset' THEN json_exists(x.b, '$.name') AND json_exists(x.b, '$.description')
      WHEN 'Product' THEN json_exists(x.b, '$.name') AND json_exists(x.b, '$.image') AND json_exists(x.b, '$.description') AND json_exists(x.b, '$.offers')
      WHEN 'BreadcrumbList' THEN json_exists(x.b, '$.itemListElement[0].position') AND json_exists(x.b, '$.itemListElement[0].name')
      WHEN 'FAQPage' THEN json_exists(x.b, '$.mainEntity[0].name') AND json_exists(x.b, '$.mainEntity[0].acceptedAnswer.text') END,
      'site': x.t = 'WebSite' AND (json_exists(x.b, '$.name') OR json_exists(x.b, '$.url')),
      'writer': (x.t = 'Person' AND json_exists(x.b, '$.name')) OR (x.t IN {_in(sorted(WORKS))} AND json_exists(x.b, '$.author')), 'marks': x.t = 'Person' OR (x.t IN {_in(sorted(WORKS))} AND json_exists(x.b, '$.author')),
      'published': json_exists(x.b, '$.datePublished'), 'modified': json_exists(x.b, '$.dateModified')}}) AS ld,
    CASE WHEN len(list_filter(segments, lambda x: regexp_matches(x, '^(contact|kontakt|contacto)([-_]|$)'))) > 0 THEN 'contact' WHEN len(list_filter(segments, lambda x: regexp_matches(x, '^(about|uber-uns)([-_]|$)'))) > 0 THEN 'about'
      WHEN len(list_filter(segments[:-2], lambda x: x IN ('blog', 'article', 'post', 'news'))) > 0 THEN 'article' WHEN list_contains(segments, 'blog') THEN 'blog' WHEN len(list_filter(segments[:-2], lambda x: x IN ('product', 'shop', 'item'))) > 0 THEN 'product'
      WHEN len(list_filter(segments, lambda x: regexp_matches(x, '^(faq|help|support)([-_]|$)'))) > 0 THEN 'faq' WHEN len(list_filter(segments, lambda x: regexp_matches(x, '^(privacy|terms|legal|policy)([-_]|$)'))) > 0 THEN 'legal'
      WHEN path IN ('/', '/index', '/index.html', '/home') THEN 'homepage' WHEN regexp_matches(lower(title), 'contact|kontakt') THEN 'contact' WHEN regexp_matches(lower(title), 'about|über uns') THEN 'about' WHEN regexp_matches(lower(title), 'faq|frequently asked') THEN 'faq'
      WHEN len(list_filter(nodes, lambda x: x.t IN {_in(POST_TYPES)})) > 0 THEN 'article' WHEN len(list_filter(nodes, lambda x: x.t = 'Product')) > 0 THEN 'product' ELSE 'general' END AS kind,
    list_filter(anchors, lambda x: x.href <> '' AND x.href NOT LIKE '#%' AND NOT regexp_matches(x.href, '^[A-Za-z][A-Za-z0-9+.-]*:')) AS links,
    list_filter(images, lambda x: NOT (regexp_matches(x, 'alt="\s*"') AND (regexp_matches(x, 'role="(presentation|none)"') OR regexp_matches(x, 'aria-hidden="true"')))) AS shown_images,
    list_filter(fields, lambda x: x NOT LIKE '<input%' OR lower({_ATTR('x', 'type')}) NOT IN ('hidden', 'submit', 'button', 'reset', 'image')) AS inputs,
    list_filter(fields, lambda x: x LIKE '<input%' AND lower({_ATTR('x', 'type')}) NOT IN {_in(IMPERSONAL_TYPES)} AND (lower({_ATTR('x', 'type')}) IN ('email', 'tel') OR {_FIELD('x')})) AS personal,
    list_transform(regexp_extract_all(regexp_replace(article, '(?s)<div hidden>.*?</div>', '', 'g'), '(?s)<button[^>]*>.*?</button>'), lambda x: trim({_plain('x')})) AS buttons,
    trim(list_filter(pairs, lambda x: lower(trim(x[1])) = 'width')[1][2]) AS width, trim(list_filter(pairs, lambda x: lower(trim(x[1])) = 'initial-scale')[1][2]) AS scale,
    CASE WHEN canonicals[1] LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || canonicals[1] ELSE nullif(canonicals[1], '') END AS canonical,
    len(list_filter(list_transform(rules, lambda x: regexp_replace(x, '^[a-z0-9_.-]+\s*:\s*', '')), lambda x: x IN ('noindex', 'none'))) > 0 AS noindex,
    len(list_filter(list_transform(rules, lambda x: regexp_replace(x, '^[a-z0-9_.-]+\s*:\s*', '')), lambda x: x IN ('nofollow', 'none'))) > 0 AS nofollow,
    regexp_matches(article, '<p class="byline">Written by [A-Z][a-z]+ [A-Z]') AS byline, regexp_extract_all(h, '<time [^>]*>') AS times
  FROM facts§),
counted§ AS (
  SELECT *, len(list_filter(tokens, lambda t: t IN ('-', '|', '–', '—', '·', ':'))) + len(list_filter(tokens[:-2], lambda t: length(t) > 1 AND t LIKE '%:')) AS separators,
    length(trim({_plain('description')})) AS dn, list_filter(regexp_split_to_array(lower(description), '\s+'), lambda w: length(w) > 3) AS dwords,
    len(list_filter(range(2, len(heads) + 1), lambda i: heads[i].level > heads[i - 1].level + 1)) AS skips, len(list_filter(heads, lambda x: x.level = 1)) AS ones, len(list_filter(heads, lambda x: length(x.text) < 3 OR x.text IN {_in(GENERIC_HEADINGS)})) AS generic_heads,
    floor(len(list_filter(shown_images, lambda x: trim({_ATTR('x', 'alt')}) <> '')) / nullif(len(shown_images), 0) * 100 + 0.5) AS alt_share,
    len(list_filter(links, lambda x: x.inside)) AS content_links, len(list_filter(links, lambda x: x.inside AND (length(x.text) < 2 OR x.text IN {_in(GENERIC_ANCHORS)}))) AS generic_links,
    {_LEAST} AS least, regexp_matches(h, '<section role="main"|<main') AS main,
    {_share('inputs', "(" + _ATTR('x', 'id') + " <> '' AND list_contains(labelled, " + _ATTR('x', 'id') + ")) OR " + _ATTR('x', 'aria-label') + " <> '' OR contains(article, '<label>Mail ' || x)")} AS input_share,
    len(regexp_extract_all(h, '<(?:main|nav|article|section|aside|header|footer|figure|figcaption)[ >]')) AS semantic,
    {' + '.join(f"CASE WHEN {_ANY(b, True)} THEN 1 ELSE 0 END" for b in MAIN_BUCKETS)} AS mains, {' + '.join(f"CASE WHEN {_ANY(b)} AND NOT {_ANY(b, True)} THEN 1 ELSE 0 END" for b in MAIN_BUCKETS)} AS bad_mains,
    CASE WHEN {_ANY(('FAQPage',), True)} THEN 8 WHEN {_ANY(('FAQPage',))} THEN 4 ELSE 0 END AS faq,
    {' + '.join(f"CASE WHEN {_ANY((t,), True)} THEN 1 ELSE 0 END" for t in SUPPORT_BUCKETS)} + CASE WHEN len(list_filter(ld, lambda x: x.site)) > 0 THEN 1 ELSE 0 END AS support,
    list_filter(ld, lambda x: x.ok IS NOT NULL) AS tested,
    {_content('property', 'article:published_time')} <> '' OR len(list_filter(ld, lambda x: x.published)) > 0 OR len(list_filter(times, lambda x: regexp_matches(x, 'itemprop="datePublished"|class="entry-date"'))) > 0 AS published,
    {_content('property', 'article:modified_time')} <> '' OR len(list_filter(ld, lambda x: x.modified)) > 0 OR len(list_filter(times, lambda x: NOT regexp_matches(x, 'itemprop="datePublished"|class="entry-date"'))) > 0 AS modified,
    len(list_filter(ld, lambda x: x.writer)) > 0 OR trim(coalesce({_content('name', 'author')}, '')) <> '' OR {_content('property', 'article:author')} <> '' OR {_content('name', 'twitter:creator')} <> '' OR byline AS named,
    len(list_filter(ld, lambda x: x.marks)) > 0 OR {_content('name', 'author')} IS NOT NULL AS marked, {_EXPERT} AS expert,
    byline OR regexp_matches(article, '<div class="author-bio">') OR {' OR '.join(f"len(list_filter(anchors, lambda x: contains(x.href, '{p}'))) > 0" for p in AUTHOR_PATHS)} AS bio,
    {' + '.join(f"CASE WHEN len(list_filter(anchors, lambda x: contains(x.href, '{p}'))) > 0 THEN 1 ELSE 0 END" for p in TRUST_PATHS)} + CASE WHEN contains(h, '<address') THEN 1 ELSE 0 END AS trust,
    regexp_matches(h, '<div id="({'|'.join(APP_ROOTS)})"></div>') AS rooted,
    CASE WHEN len(canonicals) = 0 THEN 1 WHEN len(canonicals) > 1 THEN 3 WHEN canonical IS NULL THEN 1 WHEN {_url_sql('canonical')} = {_url_sql('url')} THEN 0 ELSE 2 END AS canonical_cost,
    len(canonicals) = 1 AND coalesce(lower(regexp_extract(canonical, '^[A-Za-z]+://([^/?#:]*)', 1)) <> site_id, FALSE) AS elsewhere,
    CASE WHEN regexp_matches(lower(title), '(^|[^a-z0-9_-])404($|[^a-z0-9_-])|not found|(^|[^a-z0-9_])error($|[^a-z0-9_])|no encontrado|nicht gefunden') THEN 1 ELSE 0 END + CASE WHEN words < 200 THEN 1 ELSE 0 END AS errors
  FROM judged§),
scored§ AS (
  SELECT *, CASE WHEN len(tested) = 0 THEN 100 ELSE floor(len(list_filter(tested, lambda x: x.ok)) / len(tested) * 100 + 0.5) END AS rate,
    CASE WHEN heads = [] THEN 0 ELSE 8 - CASE WHEN ones = 0 THEN 3 WHEN ones > 1 THEN 2 ELSE 0 END - least(2, skips) - CASE WHEN generic_heads > 3 THEN 1 ELSE 0 END END AS heading_score,
    5 - CASE WHEN words < floor(least * 0.33) THEN 3 WHEN words < floor(least * 0.66) THEN 2 WHEN words < least THEN 1 ELSE 0 END - CASE WHEN paragraphs < 3 AND words > 200 THEN 0.5 ELSE 0 END AS text_score
  FROM counted§),
scores§ AS (
  SELECT site_id, page_id, unnest([
    {{'check_id': 'meta.title', 'category': 'meta', 'weight': 5, 'x': CASE WHEN n = 0 THEN 0 ELSE 5
        - CASE WHEN n < 40 THEN 2 WHEN n < 50 THEN 0.5 WHEN n > 70 THEN 1.5 WHEN n > 60 THEN 0.5 ELSE 0 END
        - CASE WHEN regexp_full_match(lower(title), '{GENERIC_TITLES}') THEN 2 ELSE 0 END
        - CASE WHEN n < 20 AND separators = 0 THEN 0.5 ELSE 0 END - CASE WHEN separators > 3 THEN 0.5 ELSE 0 END END}},
    {{'check_id': 'meta.description', 'category': 'meta', 'weight': 5, 'x': CASE WHEN dn = 0 THEN 0 ELSE 5
        - CASE WHEN dn < 70 THEN 2 WHEN dn < 120 THEN 1 WHEN dn > 170 THEN 1 WHEN dn > 160 THEN 0.5 ELSE 0 END
        - CASE WHEN regexp_matches(lower(trim(description)), '{GENERIC_DESCRIPTIONS}') THEN 2 ELSE 0 END - CASE WHEN lower(trim({_plain('description')})) = lower(title) THEN 1 ELSE 0 END
        - CASE WHEN coalesce(list_max(list_transform(dwords, lambda w: len(list_filter(dwords, lambda v: v = w)))), 0) > 3 AND len(regexp_split_to_array(description, '\s+')) > 10 THEN 0.5 ELSE 0 END END}},
    {{'check_id': 'meta.viewport', 'category': 'meta', 'weight': 3, 'x': CASE WHEN NOT sized THEN 0 ELSE 3 - CASE WHEN lower(width) = 'device-width' THEN 0 WHEN width IS NOT NULL THEN 1.5 ELSE 1 END - CASE WHEN scale IS NULL THEN 0.5 WHEN TRY_CAST(scale AS DOUBLE) = 1 THEN 0 ELSE 0.25 END END}},
    {{'check_id': 'meta.language', 'category': 'meta', 'weight': 3, 'x': CASE WHEN lang = '' THEN 1 WHEN NOT regexp_matches(lang, '(?i)^([a-z]{{2,3}})(?:-([a-z]{{4}}))?(?:-([a-z]{{2}}|[0-9]{{3}}))?$') THEN 2.5 WHEN lower(string_split(lang, '-')[1]) NOT IN {_in(LANGUAGES)} THEN 2.5 WHEN regexp_matches(lang, '-[A-Za-z]{{2}}$') AND upper(right(lang, 2)) NOT IN {_in(REGIONS)} THEN 2.75 ELSE 3 END}},
    {{'check_id': 'meta.open-graph', 'category': 'meta', 'weight': 3, 'x': 3 - CASE WHEN trim(coalesce(og_title, '')) = '' THEN 0.75 ELSE 0 END - CASE WHEN trim(coalesce(og_description, '')) = '' THEN 0.75 ELSE 0 END - CASE WHEN trim(coalesce(og_image, '')) = '' THEN 0.75 ELSE 0 END
        - CASE WHEN og_url IS NULL THEN 0.25 ELSE 0 END - CASE WHEN og_type IS NULL THEN 0.25 ELSE 0 END - CASE WHEN og_url <> '' AND {_url_sql('og_url')} <> {_url_sql('canonical')} THEN 0.25 ELSE 0 END}},
    {{'check_id': 'meta.twitter-cards', 'category': 'meta', 'weight': 3, 'x': CASE WHEN coalesce(tw_card, tw_title, tw_description, tw_image) IS NULL AND concat(og_title, og_description, og_image) <> '' THEN 2 ELSE 3
        - CASE WHEN trim(coalesce(tw_card, '')) = '' THEN 0.75 ELSE 0 END - CASE WHEN trim(coalesce(tw_title, '')) = '' THEN 0.75 ELSE 0 END - CASE WHEN trim(coalesce(tw_description, '')) = '' THEN 0.75 ELSE 0 END - CASE WHEN tw_image IS NULL THEN 0.5 ELSE 0 END
        - CASE WHEN tw_card <> '' AND tw_card NOT IN ('summary', 'summary_large_image', 'app', 'player') THEN 0.25 ELSE 0 END END}},
    {{'check_id': 'content.headings', 'category': 'content', 'weight': 8, 'x': heading_score}},
    {{'check_id': 'content.image-alt', 'category': 'content', 'weight': 5, 'x': coalesce(floor(alt_share / 100 * 5 + 0.5), 5)}},
    {{'check_id': 'content.internal-links', 'category': 'content', 'weight': 4, 'x': floor((4 - CASE WHEN links = [] THEN 3 WHEN content_links < 3 AND len(links) < 5 THEN 1 ELSE 0 END - least(1, generic_links * 0.25)) * 10 + 0.5) / 10}},
    {{'check_id': 'content.quality', 'category': 'content', 'weight': 5, 'x': CASE WHEN words < 50 THEN least(1, greatest(0, text_score)) ELSE text_score END}},
    {{'check_id': 'content.freshness', 'category': 'content', 'weight': 5, 'x': CASE WHEN coalesce(published, FALSE) OR coalesce(modified, FALSE) THEN 5 - CASE WHEN coalesce(published, FALSE) THEN 0 ELSE 2 END - CASE WHEN coalesce(modified, FALSE) THEN 0 ELSE 2 END ELSE 0 END}},
    {{'check_id': 'content.accessibility', 'category': 'content', 'weight': 4, 'x': 4 - CASE WHEN main THEN 0 ELSE 1.75 END - CASE WHEN regexp_matches(h, '<nav[ >]') THEN 0 ELSE 0.75 END - CASE WHEN input_share < 50 THEN 0.75 ELSE 0 END - CASE WHEN semantic < 5 AND NOT main THEN 0.75 ELSE 0 END}},
    {{'check_id': 'content.author', 'category': 'content', 'weight': 5, 'x': CASE WHEN coalesce(named, FALSE) THEN 2 WHEN marked THEN 1 ELSE 0 END + CASE WHEN expert THEN 1 ELSE 0 END + CASE WHEN bio THEN 1 ELSE 0 END + CASE WHEN trust >= 3 THEN 1 ELSE 0 END}},
    {{'check_id': 'structured-data.present', 'category': 'structured-data', 'weight': 15, 'x': CASE WHEN ld <> [] THEN least(15, 4 + CASE WHEN mains > 0 THEN 7 + 2 * (mains - 1) WHEN bad_mains > 0 THEN 2 ELSE 0 END + faq + support) WHEN contains(h, '<div itemscope>') THEN 4 ELSE 0 END}},
    {{'check_id': 'structured-data.valid', 'category': 'structured-data', 'weight': 5, 'x': CASE WHEN blocks = [] THEN 0 ELSE 5 - broken * 0.5 - CASE WHEN ld = [] OR rate < 50 THEN 2 WHEN rate < 80 THEN 1 WHEN rate < 100 THEN 0.5 ELSE 0 END END}},
    {{'check_id': 'crawlability.indexability', 'category': 'crawlability', 'weight': 8, 'x': CASE WHEN meant THEN 8 WHEN noindex OR errors >= 2 OR elsewhere THEN 0 ELSE 8 - canonical_cost - CASE WHEN nofollow THEN 2 ELSE 0 END END}},
    {{'check_id': 'agent-readiness.server-rendered', 'category': 'agent-readiness', 'weight': 6, 'x': CASE WHEN rooted AND sent < 50 THEN 0 WHEN (rooted AND sent < 150) OR (NOT rooted AND sent < 30 AND contains(h, '<script>')) THEN 3 - CASE WHEN ones = 0 THEN 1 ELSE 0 END - CASE WHEN title = '' THEN 1 ELSE 0 END ELSE 6 END}},
    {{'check_id': 'agent-readiness.controls', 'category': 'agent-readiness', 'weight': 4, 'x': CASE WHEN {_share('buttons', "x <> ''")} >= 90 THEN 1 ELSE 0 END + CASE WHEN {_share('anchors', "NOT regexp_matches(trim(x.href), '(?i)^(#?$|javascript:)')")} >= 90 THEN 1 ELSE 0 END
        + CASE WHEN contains(article, '<div onclick=') THEN 0 ELSE 1 END + CASE WHEN {_share('personal', _ATTR('x', 'autocomplete') + " NOT IN ('', 'off')")} >= 90 THEN 1 ELSE 0 END}}
  ], recursive := true) FROM scored§),
results§ AS (SELECT site_id, page_id, check_id, category, weight, greatest(0, least(weight, floor(x)))::INT AS score FROM scores§),
checks§ AS (
  SELECT site_id, check_id, category, weight, floor(sum(score) / count(*) * 10 + 0.5) / 10 AS score, count(*) AS pages,
    count(*) FILTER (score < weight) AS failing_pages FROM results§ GROUP BY ALL)
"""


def _pages_sql(html: str, header: str = "NULL::VARCHAR", name: str = "") -> str:
    """Scores of pages with this HTML; name: what the tables' names end in."""
    return _PAGES.replace("§html", html).replace("§header", header).replace("§key", _KEY("path")).replace("§", name)


SQL_PAGES = _pages_sql(AUGMENTED, ROBOTS_HEADER)
_FULL = "SELECT *, CASE WHEN score / weight * 100 >= 80 THEN 'pass' WHEN score / weight * 100 >= 50 THEN 'warning' ELSE 'fail' END AS status, floor((weight - score) * 10 + 0.5) / 10 AS lost FROM checks"


def _listed(pages: DataFrame) -> DataFrame:
    """Keys of the pages in each site's sitemap: every eighth page is in it."""
    return pages.filter("page_id % 8 = 3").select(site_of(F.col("url")).alias("site_id"), path_key(url_path()).alias("key")).distinct()


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = augmented(spark, sf_dir)
    return page_results(pages, listed=_listed(pages))


def check_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_summary(page_scores(spark, sf_dir))


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_summary(check_scores(spark, sf_dir))


def site_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_summary(check_scores(spark, sf_dir))


def site_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems(check_scores(spark, sf_dir))


def score_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check scores of the raw pages against those of the augmented ones."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = page_results(pages, listed=_listed(pages))
    return compared(check_summary(raw), check_scores(spark, sf_dir))


def _one(check_id: str) -> Callable[[SparkSession, str], DataFrame]:
    check = next(c for c in ALL_PAGE_CHECKS if c.id == check_id)
    return lambda spark, sf_dir: page_results(augmented(spark, sf_dir), (check,), _listed(augmented(spark, sf_dir)))


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the main content and the kind of each page."""
    return with_facts(with_nodes(augmented(spark, sf_dir))).select("page_id", F.col("kind").alias("page_type"), F.col("main_words").cast("long").alias("words"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_facts(with_nodes(augmented(spark, sf_dir))).select("page_id", "title", F.size("links").cast("long").alias("links"))


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag stands on pages: the parse, exploded."""
    nodes = with_nodes(augmented(spark, sf_dir)).select("page_id", F.explode("nodes.tag").alias("tag")).filter("not startswith(tag, '#')")
    return nodes.groupBy("tag").agg(F.count("*").alias("elements"), F.countDistinct("page_id").alias("pages"))


#: Texts of a site's files by the length of its name; both dialects read them.
ROBOTS = """CASE length(site_id) % 7
  WHEN 0 THEN 'User-agent: *
Disallow: /private
Sitemap: https://x.example/sitemap.xml'
  WHEN 1 THEN 'User-agent: GPTBot
user-agent: claudebot
Disallow: /

User-agent: *
Allow: /
Crawl-delay: 2'
  WHEN 2 THEN '# all out
User-agent: *
Disallow: /
Allow: /$
Crawl-delay: 10'
  WHEN 3 THEN ''
  WHEN 4 THEN 'Disallow: /
User-agent: Bytespider
User-agent: CCBot
Disallow: /*
User-agent: CCBot
Crawl-delay: 30
User-agent: *
Disallow: /
Allow: /
sitemap: /s.xml'
  WHEN 5 THEN 'User-agent: *
Disallow:
User-agent: PerplexityBot
Disallow: /
Allow: /public'
  END"""
SITEMAP = """CASE length(site_id) % 5
  WHEN 0 THEN '<urlset><url><loc>https://x.example/a</loc></url><url><loc> https://x.example/b?x=1&amp;y=2 </loc></url></urlset>'
  WHEN 1 THEN '<urlset></urlset>'
  WHEN 2 THEN '<sitemapindex><sitemap><loc>https://x.example/c.xml</loc></sitemap></sitemapindex>'
  WHEN 3 THEN '<urlset><url><loc><![CDATA[https://x.example/a]]></loc></url></urlset>' END"""
HEADERS = """CASE length(site_id) % 3
  WHEN 0 THEN '/*
  X-Frame: one
/en/*
  X-Frame: two
  Cache-Control: no-store'
  WHEN 1 THEN '# none but these
/:lang/
  X-Lang:  own
/fr/*
  X-Lang: french'
  ELSE '' END"""
LLMS = """CASE length(site_id) % 6
  WHEN 0 THEN '# Name
> What it is and who it is for, in one sentence.
## Pages
- [One](https://x.example/one)
- [Two](/two): the second'
  WHEN 1 THEN 'short'
  WHEN 2 THEN '  '
  WHEN 3 THEN 'No heading stands here, but there is a [link](/x) and some more text to read.'
  WHEN 4 THEN '# Name
Nothing else of the form, though long enough to be of use to someone.' END"""
DIRECTIVES = "CASE page_id % 8 WHEN 0 THEN 'noindex' WHEN 1 THEN 'googlebot: noindex, nofollow' WHEN 2 THEN 'max-image-preview:none, follow' WHEN 3 THEN 'NONE' WHEN 4 THEN ' index , nofollow' WHEN 5 THEN 'unavailable_after: 25 Jun 2030, noindex' WHEN 6 THEN 'bingbot: none' ELSE '' END"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(site_of(F.col("url")).alias("site_id")).distinct()


def _bots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, b in MAJOR_BOTS) for b in BOTS], "name string, is_major boolean")


def robots_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bot_crawlability(_sites(spark, sf_dir).withColumn("text", F.expr(ROBOTS)), _bots(spark))


def robots_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each crawler may read a site's homepage."""
    return bot_access(_sites(spark, sf_dir).withColumn("text", F.expr(ROBOTS)).filter("text is not null and trim(text) <> ''"), _bots(spark))


def sitemap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap_score(_sites(spark, sf_dir).withColumn("robots", F.expr(ROBOTS)).withColumn("sitemap", F.expr(SITEMAP)))


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sites(spark, sf_dir).withColumn("text", F.expr(SITEMAP)).filter("text is not null")
    return sitemap_locs(files).groupBy("url", "is_index").agg(F.count("*").alias("sites"))


def llms_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return llms_txt_score(_sites(spark, sf_dir).withColumn("robots", F.expr(ROBOTS)).withColumn("llms", F.expr(LLMS)))


def noindex_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages kept out of search on purpose, by their robots meta and headers."""
    return _kept_out(with_nodes(augmented(spark, sf_dir)).select("site_id", "page_id", url_path().alias("url_path"), robots_state()["for_all"].alias("noindex_for_all")))


def _kept_out(pages: DataFrame) -> DataFrame:
    listed = pages.filter("page_id % 8 = 3").groupBy("site_id").agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<loc>https://h"), "url_path", F.lit("</loc>")))).alias("text"))
    return excluded_pages(pages, listed)


def full_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site scores over all page checks, without pages that are kept out of search on purpose."""
    return site_summary(check_summary(excluding(page_scores(spark, sf_dir), noindex_pages(spark, sf_dir))))


#: What live sites answer where no text was read, by what is asked for; sites of even name lengths are live.
LIVE = "length(site_id) % 2 = 0"
ANSWERS = {"robots": "CASE length(site_id) % 5 WHEN 1 THEN 403 WHEN 2 THEN 200 ELSE 404 END", "llms": "CASE length(site_id) % 3 WHEN 1 THEN 503 ELSE 404 END", "sitemap": "CASE length(site_id) % 7 WHEN 3 THEN 429 ELSE 404 END"}
TEXTS = {"robots": ("robots.txt", lambda: ROBOTS), "llms": ("llms.txt", lambda: LLMS), "sitemap": ("sitemap.xml", lambda: SITEMAP)}


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each site's robots.txt, llms.txt and sitemap."""
    own = _sites(spark, sf_dir)
    sites = own.select("site_id", F.expr(LIVE).alias("live"), F.concat(F.lit("https://"), "site_id").alias("origin"))
    texts = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(path).alias("path"), F.expr(text()).alias("text")) for k, (path, text) in TEXTS.items()))
    answers = F.array(*(F.struct(F.lit(k).alias("name"), F.expr(said).alias("status"), F.lit(False).alias("timed_out")) for k, said in ANSWERS.items()))
    files = staged(site_files(spark, sf_dir), "site_files")
    return evidence(sites, own.select("site_id", F.inline(texts)).filter("text is not null"), own.select("site_id", F.inline(answers)), generators(files, stacks(files)))


def evidence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the checks that rest on robots.txt, llms.txt and sitemaps."""
    known = staged(_evidence(spark, sf_dir), "evidence")  # read by four checks
    headers = _sites(spark, sf_dir).withColumn("header", F.expr(SIGNAL_HEADER))
    return robots_runs(known).unionByName(llms_runs(known)).unionByName(signal_runs(known, headers)).unionByName(sitemap_runs(known))


def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their scores, and whether they are inconclusive or predicted."""
    return evidence_runs(spark, sf_dir).select("site_id", "check_id", "score", "inconclusive", "predicted")


def site_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("site_id", "name", "state", "source")


def blocked_crawlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule keeps which crawlers out, and which delay slows them."""
    robots = _sites(spark, sf_dir).withColumn("text", F.expr(ROBOTS)).filter("trim(text) <> ''")
    return crawler_blocks(crawler_rules(robots, bot_list(spark))).select("site_id", "kind", "line", "rule", "delay", F.array_join("crawlers", ", ").alias("crawlers"), "n")


#: Headers that sites known by their files send for '/', and their base URLs.
HSTS = "length(site_id) % 11 = 5"
BASE_URL = "CASE length(site_id) % 4 WHEN 1 THEN concat('http://', site_id) WHEN 2 THEN concat('https://', site_id, '/') END"


def site_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each site is served, by what its files force or declare and where it is hosted."""
    own, files = _sites(spark, sf_dir), site_files(spark, sf_dir)
    headers = own.filter(HSTS).select("site_id", F.lit("strict-transport-security").alias("name"), F.lit("_headers").alias("source"))
    pages = with_nodes(augmented(spark, sf_dir))
    return scheme_votes(pages, own.withColumn("base_url", F.expr(BASE_URL)), redirect_rules(files), headers, hosts(files))


def _site_facts() -> list[Column]:
    """What checks of sites and of Markdown read of each page, a few values a page."""
    head = F.coalesce(first(having("head"))["line"], F.lit(1))
    tools = F.size(F.filter("nodes", lambda n: F.coalesce(n["attrs"]["toolname"], n["attrs"]["tooldescription"]).isNotNull()))
    return [resolved(markdown_alternate(), F.col("url")).alias("alternate"), head.alias("head_line"), mixed_parts().alias("mixed"), declared_schemes().alias("declared"), tools.alias("tools"), api_evidence().alias("api")]


def _markdown_runs(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    asked = probe_plan(pages.select("site_id", "page_id", F.col("page_id").alias("seq")))
    probes = _probes(spark, sf_dir).filter("probe <> 'guessed'").withColumns({"timed_out": F.lit(False), "html": is_html(F.col("text"), F.col("content_type"))})
    kept = probes.join(asked, ["site_id", "page_id"], "left_semi")
    return live_markdown_runs(pages.select("site_id", "page_id", "url", "alternate", "head_line"), kept)


def _https_runs(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    secure = F.min(F.when(F.lower("url").startswith("https:"), True).when(F.lower("url").startswith("http:"), False))
    live = pages.groupBy("site_id").agg(secure.alias("secure")).select("site_id", F.concat(F.when(F.col("secure"), "https://").otherwise("http://"), "site_id").alias("origin"), F.expr("CASE length(site_id) % 4 WHEN 0 THEN 200 WHEN 1 THEN 301 END").alias("http_status"), F.concat(F.lit("https://"), "site_id").alias("location"), F.lit(None).cast("string").alias("hsts"))
    none = live.filter("false").selectExpr("site_id", "cast(null as string) as scheme", "cast(null as string) as evidence")
    return https_runs(none, live, page_schemes(pages))


def _protocol_runs(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    entries = F.array(*(F.when(F.length("site_id") % k == m, F.struct(F.lit(p).alias("path"), F.lit(c).alias("content_type"), F.lit(t).alias("text"))) for p, c, t, k, m in ARTIFACT_FILES))
    sites = _sites(spark, sf_dir).withColumn("origin", F.concat(F.lit("https://"), "site_id"))
    files = sites.select("site_id", F.inline(F.array_compact(entries)))
    found = artifacts_found(files)
    kinds = spark.createDataFrame([(p, k) for p, k, _ in ARTIFACTS], "path string, kind string")
    guessed = predicted_artifacts(staged(site_files(spark, sf_dir), "site_files"), LABELS).withColumnRenamed("artifact", "path").join(F.broadcast(kinds), "path").select("site_id", "path", "kind")
    shown = pages.groupBy("site_id").agg(F.sum("tools").alias("tools"), F.slice(F.array_sort(F.collect_set(F.when(F.col("api"), F.struct(F.col("url").alias("sample"), F.col("url").alias("file"), F.lit(1).alias("line"))))), 1, 5).alias("api"))
    invalid = files.select("site_id", "path").join(found.select("site_id", "path"), ["site_id", "path"], "left_anti")
    closed = sites.filter("false").select("site_id", F.lit("").alias("path"), F.lit("").alias("label"))
    return protocol_runs(sites, found, guessed, invalid, closed, shown)


def _http_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = staged(site_files(spark, sf_dir), "site_files")
    roots, rules = staged(served_roots(files), "roots"), staged(redirect_rules(files), "redirects")
    return predicted_http_runs(unknown_url_points(files, rules, stacks(files), hosts(files), roots), predicted_answers(page_list(files, roots), rules, files, roots), _hidden(spark, sf_dir, page_list(files, roots)))


def _hidden(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """Pages that the header rules of their site keep out of search."""
    sent = headers_for(pages.withColumn("page_id", F.col("url_path")), header_rules(_sites(spark, sf_dir).withColumn("text", F.expr(HEADERS))), header_pattern_regex(F.col("pattern")))
    return sent.filter((F.col("name") == "x-robots-tag") & F.exists("values", lambda v: directives(v)["noindex"])).select("site_id", F.col("page_id").alias("url_path"))


#: Tables of runs, and of pages kept out of search, by application and state of the pages table.
_TABLES: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(runs, kept out): the audit of a pages table, made once in an application and read by all reports on it.

    A pages table that was written anew since is audited anew.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/pages.parquet")
    at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, at.getModificationTime(), at.getLen())
    if key not in _TABLES:
        read = pages_read(spark, sf_dir)
        _TABLES[key] = (audit_runs(spark, sf_dir, read), staged(_kept_out(read.select("site_id", "page_id", url_path().alias("url_path"), "noindex_for_all")), "kept_out"))
    return _TABLES[key]


def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that an audit reads of each page, from one parse: runs of page checks, facts that sites' checks read, and whether all crawlers are told noindex."""
    pages, runs = page_tellings(with_nodes(augmented(spark, sf_dir), author=True), ALL_PAGE_CHECKS)
    with dealt():
        facts = pages.select("site_id", "page_id", "url", *_site_facts(), fact("crawlability.indexability")("for_all").alias("noindex_for_all"), runs.alias("runs"))
    return staged(facts, "pages_read")


def audit_runs(spark: SparkSession, sf_dir: str, read: DataFrame) -> DataFrame:
    """Runs of all 26 checks, with messages, findings and advice."""
    pages = augmented(spark, sf_dir)
    intents = page_intents(pages.select(site_of(F.col("url")).alias("site_id"), "page_id", url_path().alias("url_path")), _listed(pages))
    runs = decided(inlined(read, F.col("runs")), intents)
    few = read.drop("runs", "noindex_for_all")  # a few values a page, read by three checks
    for more in (_markdown_runs(spark, sf_dir, few), _https_runs(spark, sf_dir, few), _protocol_runs(spark, sf_dir, few), _http_runs(spark, sf_dir), evidence_runs(spark, sf_dir)):
        runs = runs.unionByName(more)
    return staged(runs, "audit_runs")


def page_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ten page checks say of each page, and their findings with lines."""
    own = told_pages(with_nodes(augmented(spark, sf_dir)), [c for c in ALL_PAGE_CHECKS if c.id in TOLD_IN_SQL])
    said = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["line"], f["message"])), " | ")
    return own.select("page_id", "check_id", "message", said.alias("findings"), "recommendation")


#: The checks of page_messages.
TOLD_IN_SQL = ("meta.title", "meta.description", "meta.viewport", "meta.language", "meta.open-graph", "meta.twitter-cards", "content.headings", "content.image-alt", "content.internal-links", "content.quality")


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).withColumn("mode", F.when(F.length("site_id") % 19 == 0, "report-only").otherwise("full"))


def audit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every site: status, score, what was lost, flags, pages."""
    return _states(spark, sf_dir).drop("message", "recommendation")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, out = audited(spark, sf_dir)
    return check_states(runs, rubric_table(spark), out, _modes(spark, sf_dir))


def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_totals(_states(spark, sf_dir))


def audit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_totals(_states(spark, sf_dir))


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all pages, equal ones together, with their first places."""
    runs, kept_out = audited(spark, sf_dir)
    out = finding_groups(runs, rubric_table(spark), kept_out)
    return out.withColumn("locations", F.array_join("locations", ", "))


def audit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console_summaries(_states(spark, sf_dir))


def audit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown reports."""
    states, found = _reported(spark, sf_dir)
    notes = _sites(spark, sf_dir).select("site_id", F.concat(F.lit("Pages of "), "site_id").alias("note"))
    return reports(states, found, notes)


def audit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON."""
    return payloads(*_reported(spark, sf_dir))


def _reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """States and grouped findings of one run of all checks."""
    runs, out = audited(spark, sf_dir)
    rubric = rubric_table(spark)
    return staged(check_states(runs, rubric, out, _modes(spark, sf_dir)), "states"), staged(finding_groups(runs, rubric, out), "findings")


#: Files of a site besides its pages: name, text, and for which lengths of its name (length % k = m).
CONFIG = (
    ("package.json", '{"dependencies": {"astro": "1"}, "devDependencies": {"next-sitemap": "2"}}', 4, 0),
    ("next.config.js", "", 4, 1),
    ("wp-config.php", "", 9, 4),
    ("vercel.json", '{"redirects": [{"source": "/en/:slug", "destination": "/fr/:slug"}, {"source": "/blog/(.*)", "destination": "/", "permanent": false}], "rewrites": [{"source": "/(.*)", "destination": "/index.html"}]}', 3, 0),
    ("_redirects", "/old /\n# none\n/en/* /nowhere 301!\n/gone  /x 410!\n/* /index.html 404", 3, 1),
    ("netlify.toml", '[[redirects]]\nfrom = "/de/*"\nto = "https://x.example/"\nstatus = 302\nforce = true\n', 6, 1),
    ("CNAME", "x.example", 5, 2),
    ("404.html", "", 2, 0),
    (".well-known/mcp.json", "{}", 7, 3),
    ("node_modules/a/index.html", "", 2, 1),
)


def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files for each site: its pages as files, and what CONFIG adds."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(site_of(F.col("url")).alias("site_id"), F.substring(url_path(), 2, 10000).alias("p"))
    pages = pages.select("site_id", F.when((F.col("p") == "") | F.col("p").endswith("/"), F.concat("p", F.lit("index.html"))).otherwise(F.concat("p", F.lit(".html"))).alias("path"), F.lit("").alias("text")).distinct()
    entries = F.array(*(F.when(F.length("site_id") % k == m, F.struct(F.lit(name).alias("path"), F.lit(text).alias("text"))) for name, text, k, m in CONFIG))
    own = _sites(spark, sf_dir).select("site_id", F.inline(F.array_compact(entries)))
    return pages.unionByName(own).withColumn("bytes", F.octet_length("text").cast("long"))


def site_page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = site_files(spark, sf_dir)
    return page_list(files, served_roots(files), 5)


def site_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks(site_files(spark, sf_dir)).select("site_id", "stack", "evidence")


def site_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts(site_files(spark, sf_dir))


def site_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirect_rules(site_files(spark, sf_dir)).select("site_id", "rule_no", F.col("from").alias("source"), F.col("to").alias("target"), "status", "force", "file")


def site_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page would answer, by the redirects of its host."""
    files = site_files(spark, sf_dir)
    roots = served_roots(files)
    return predicted_answers(page_list(files, roots), redirect_rules(files), files, roots)


def unknown_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What unknown URLs of each site would get."""
    files = site_files(spark, sf_dir)
    return unknown_url_points(files, redirect_rules(files), stacks(files), hosts(files), served_roots(files))


def site_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each page: those that are single values, and how many of the others."""
    own = page_facts(with_nodes(augmented(spark, sf_dir)))
    return own.select("page_id", "lang", "title", "description", "canonical", F.size("h1").cast("long").alias("h1s"), F.size("headings").cast("long").alias("headings"), F.size("images_without_alt").cast("long").alias("images_without_alt"), "modified", "author", F.array_join("types", ",").alias("types"))


def llms_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of llms.txt."""
    own = page_facts(with_nodes(augmented(spark, sf_dir)))
    base = _sites(spark, sf_dir).withColumn("base_url", F.concat(F.lit("https://"), "site_id"))
    return llms_drafts(own, brands(own, base), base)


#: What agents find at a site, by the length of its name: path, content type, text.
ARTIFACT_FILES = (
    ("/.well-known/mcp.json", "application/json", "{}", 4, 1),
    ("/.well-known/agent.json", "application/json", '{"name": "A"}', 3, 1),
    ("/openapi.json", "application/json", '{"openapi": ""}', 4, 2),
    ("/.well-known/ai", "text/plain", "yes", 5, 1),
    ("/.well-known/openapi.json", "text/html", '{"openapi": "3"}', 2, 1),
)
SIGNAL_LINES = """CASE length(site_id) % 4 WHEN 0 THEN 'Content-Signal: search=yes, ai-train=no
User-agent: *
Content-Signal: ai-train=yes, ai-input=maybe' WHEN 1 THEN 'User-agent: GPTBot
Disallow:' WHEN 2 THEN '' END"""
SIGNAL_HEADER = "CASE length(site_id) % 6 WHEN 0 THEN 'ai-input=no, search=no' WHEN 3 THEN 'search=YES' END"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages answered when asked again, by their ids."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(site_of(F.col("url")).alias("site_id"), "page_id")
    answers = (("negotiated", "page_id % 10 = 3", "text/markdown", "page_id % 7 = 0"), ("alternate", "page_id % 3 > 0", "text/plain", "page_id % 10 = 1"), ("guessed", "page_id % 5 = 0", "text/html", "page_id % 15 = 5"))
    rows = None
    for probe, ok, kind, other in answers:
        own = pages.select("site_id", "page_id", F.lit(probe).alias("probe"), F.expr(f"CASE WHEN {ok} THEN 200 ELSE 404 END").alias("status"), F.expr(f"CASE WHEN {other} THEN 'text/x-markdown' ELSE '{kind}' END").alias("content_type"), F.lit("# A").alias("text"))
        rows = own if rows is None else rows.union(own)
    return rows


def content_signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals on the use of content, by robots files and headers."""
    return content_signals(_sites(spark, sf_dir).withColumn("robots", F.expr(SIGNAL_LINES)).withColumn("header", F.expr(SIGNAL_HEADER)), _bots(spark))


def https_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = _sites(spark, sf_dir).withColumn("http_status", F.expr("CASE length(site_id) % 4 WHEN 0 THEN 200 WHEN 1 THEN 301 END"))
    return https_score(with_nodes(augmented(spark, sf_dir)), plain)


def markdown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether agents can have pages as Markdown."""
    return markdown_score(with_nodes(augmented(spark, sf_dir)), _probes(spark, sf_dir))


def protocol_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What agents can discover of each site."""
    entries = F.array(*(F.when(F.length("site_id") % k == m, F.struct(F.lit(p).alias("path"), F.lit(c).alias("content_type"), F.lit(t).alias("text"))) for p, c, t, k, m in ARTIFACT_FILES))
    files = _sites(spark, sf_dir).select("site_id", F.inline(F.array_compact(entries)))
    return protocols_score(files, with_nodes(augmented(spark, sf_dir)))


def http_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each site would answer: unknown URLs, its pages, and pages that headers keep out of search."""
    files = site_files(spark, sf_dir)
    roots, rules = served_roots(files), redirect_rules(files)
    pages = page_list(files, roots)
    return http_behaviour(predicted_answers(pages, rules, files, roots), _hidden(spark, sf_dir, pages), unknown_url_points(files, rules, stacks(files), hosts(files), roots))


def whole_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all checks of pages and sites, every site read whole."""
    sites = _sites(spark, sf_dir).withColumn("mode", F.lit("full"))
    runs, out = audited(spark, sf_dir)
    return site_totals(check_states(runs, rubric_table(spark), out, sites))


def rubric_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubric_totals(rubric_table(spark))


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header values by page, stacked in rule order."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(site_of(F.col("url")).alias("site_id"), "page_id", url_path().alias("url_path"))
    rules = header_rules(_sites(spark, sf_dir).withColumn("text", F.expr(HEADERS)))
    return headers_for(pages, rules, header_pattern_regex(F.col("pattern"))).select("page_id", "name", F.array_join("values", ", ").alias("value"))


def directive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(DIRECTIVES).alias("v"))
    return rows.select("page_id", directives(F.col("v"))["noindex"].alias("noindex"), directives(F.col("v"))["nofollow"].alias("nofollow"), noindex_for_all(F.col("v")).alias("for_all"))


def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path_key(url_path()).alias("key"))


def page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to read of each site, of those it has."""
    links = spark.read.parquet(f"{sf_dir}/pages.parquet").select(site_of(F.col("url")).alias("site_id"), url_path().alias("url_path"), (F.col("page_id") % 3 == 0).alias("is_nav"), F.col("page_id").alias("seq"))
    return template_sample(links)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (site_scorecard, page_scores, check_scores, category_scores, site_problems, score_changes, page_quality, page_titles, page_elements, robots_access, robots_bots, llms_scores, sitemap_scores, sitemap_urls, noindex_pages, page_headers, directive_flags, path_keys, page_sample, full_scorecard, audit_states, audit_totals, audit_categories, audit_findings, audit_summaries, audit_reports, audit_payloads, rubric_maxima, site_page_lists, site_stacks, site_hosts, site_redirects, site_answers, unknown_urls, site_page_facts, llms_texts, http_scores, whole_audit, content_signal_scores, https_scores, markdown_scores, protocol_scores, evidence_scores, site_evidence, blocked_crawlers, site_schemes, page_messages)}
_KEYS = {c.id: "check_" + c.id.replace(".", "_").replace("-", "_") for c in ALL_PAGE_CHECKS}
QUERIES |= {name: _one(i) for i, name in _KEYS.items()}

_WITH = f"WITH {SQL_PAGES}"
#: Pages kept out of search on purpose: noindex for all in their robots meta, no homepage, not in the sitemap.
_OUT = "left_out AS (SELECT site_id, page_id FROM wanted w WHERE out AND EXISTS (SELECT 1 FROM wanted o WHERE o.site_id = w.site_id AND NOT o.out))"
_TOTALS = """sums AS (SELECT site_id, floor(sum(score::DECIMAL(10, 1))::DOUBLE + 0.5)::BIGINT AS total, sum(weight)::BIGINT AS available, max(pages) AS pages FROM {} GROUP BY ALL),
      shares AS (SELECT *, floor(total / available * 100 + 0.5)::BIGINT AS percentage FROM sums)
      SELECT *, CASE WHEN percentage >= 90 THEN 'Ready for AI' WHEN percentage >= 80 THEN 'Nearly Optimized' WHEN percentage >= 70 THEN 'Needs Work' WHEN percentage >= 60 THEN 'Major Gaps' ELSE 'Not AEO Ready' END AS grade FROM shares"""
_RUBRIC = "rubric AS (SELECT *, split_part(check_id, '.', 1) AS category FROM (VALUES " + ", ".join(f"({k}, '{i}', '{n}', {w}, '{f}', {a})" for k, (i, n, w, f, _, a) in enumerate(RUBRIC)) + ") t(ord, check_id, name, weight, fixable, advisory))"
#: §site stands for the runs of site checks and of Markdown, defined below.
_RUNS = f"""{_OUT}, {_RUBRIC},
places AS (SELECT DISTINCT site_id FROM page JOIN raw USING (page_id)),
late AS (SELECT page_id, NOT rooted AND sent < 30 AND contains(h, '<script>') AS near, (rooted AND sent >= 50 AND sent < 150) OR (((rooted AND sent >= 50 AND sent < 150) OR (NOT rooted AND sent < 30 AND contains(h, '<script>'))) AND (ones = 0 OR title = '')) AS guess FROM counted),
runs AS (
  SELECT r.site_id, r.page_id, r.check_id, r.score, r.weight, FALSE AS na, r.check_id = 'agent-readiness.server-rendered' AND l.near AS unsure, r.check_id = 'agent-readiness.server-rendered' AND l.guess AS guessed, o.page_id IS NOT NULL AS out
  FROM results r JOIN late l USING (page_id) LEFT JOIN left_out o ON o.site_id = r.site_id AND o.page_id = r.page_id
  UNION ALL SELECT m.site_id, m.page_id, 'agent-readiness.markdown', floor(m.score)::INT, 3, FALSE, m.unsure, m.guessed, o.page_id IS NOT NULL FROM (§markdown) m LEFT JOIN left_out o ON o.site_id = m.site_id AND o.page_id = m.page_id
  UNION ALL SELECT site_id, NULL, check_id, greatest(0, least(weight, floor(score)))::INT, weight, na, unsure, guessed, FALSE FROM (§site))"""
_STATES = f"""{_RUNS},
sums_of AS (SELECT site_id, check_id, count(*) FILTER (NOT out) AS n, count(*) FILTER (out) AS outs, sum(score) FILTER (NOT out) AS total, count(*) FILTER (NOT out AND na) AS nas, count(*) FILTER (NOT out AND unsure) AS unsure, count(*) FILTER (NOT out AND guessed) AS guessed, count(*) FILTER (NOT out AND score < weight) AS losing FROM runs GROUP BY ALL),
every_ AS (SELECT p.site_id, r.*, coalesce(n, 0) > 0 AND §open AS ran, coalesce(n, 0) > 0 AND §open AND nas = n AS na, total / n AS share, n, outs, losing, unsure, guessed
  FROM places p CROSS JOIN rubric r LEFT JOIN sums_of s ON s.site_id = p.site_id AND s.check_id = r.check_id),
rated AS (SELECT *, CASE WHEN ran AND NOT na THEN floor(share * 10 + 0.5) / 10 ELSE 0 END::DOUBLE AS score FROM every_),
states AS (SELECT site_id, check_id, name, category, weight, fixable, advisory, ord, score,
  CASE WHEN NOT ran THEN 'skipped' WHEN na THEN 'na' WHEN advisory THEN CASE WHEN score >= weight THEN 'pass' ELSE 'advice' END WHEN unsure > 0 AND score < weight THEN 'warning' WHEN score / weight * 100 >= 80 THEN 'pass' WHEN score / weight * 100 >= 50 THEN 'warning' ELSE 'fail' END AS status,
  CASE WHEN ran AND NOT na AND NOT advisory THEN floor((weight - score) * 10 + 0.5) / 10 ELSE 0 END::DOUBLE AS lost, ran AND NOT na AND unsure > 0 AS inconclusive, ran AND NOT na AND guessed > 0 AS predicted,
  CASE WHEN ran THEN n ELSE 0 END::BIGINT AS pages, CASE WHEN ran THEN losing ELSE 0 END::BIGINT AS failing_pages, CASE WHEN ran THEN outs ELSE 0 END::BIGINT AS excluded_pages FROM rated)"""
_TOTALS_OF = """sums AS (SELECT site_id, floor(coalesce(sum(CASE WHEN status NOT IN ('skipped', 'na') THEN score::DECIMAL(10, 1) END), 0)::DOUBLE + 0.5)::BIGINT AS total, coalesce(sum(weight) FILTER (status NOT IN ('skipped', 'na')), 0)::BIGINT AS available FROM states WHERE NOT advisory GROUP BY site_id),
shares AS (SELECT *, CASE WHEN available > 0 THEN floor(total / available * 100 + 0.5) ELSE 0 END::BIGINT AS percentage FROM sums),
graded AS (SELECT *, CASE WHEN available = 0 THEN '' WHEN percentage >= 90 THEN 'Ready for AI' WHEN percentage >= 80 THEN 'Nearly Optimized' WHEN percentage >= 70 THEN 'Needs Work' WHEN percentage >= 60 THEN 'Major Gaps' ELSE 'Not AEO Ready' END AS grade FROM shares)"""
_SITES = "s AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site_id FROM pages)"
_LINES = lambda text: f"(SELECT site_id, unnest(string_split({text}, chr(10))) AS raw, generate_subscripts(string_split({text}, chr(10)), 1) AS line FROM s WHERE {text} IS NOT NULL)"
_FORM = r"'^([A-Za-z-]+)\s*:\s*(.*)$'"
#: Robots files read line by line: groups, rules and delays, and what each crawler may do at a path.
_ROBOTS = lambda path, bots: rf"""{_SITES},
lines AS (SELECT site_id, line, trim(regexp_replace(raw, '#.*$', '')) AS x FROM {_LINES(ROBOTS)}),
pairs AS (SELECT site_id, line, lower(regexp_extract(x, {_FORM}, 1)) AS k, trim(regexp_extract(x, {_FORM}, 2)) AS v FROM lines WHERE regexp_matches(x, {_FORM})),
runs_of AS (SELECT *, sum(CASE WHEN k = 'user-agent' AND coalesce(prev, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY line) AS g FROM (SELECT *, lag(k) OVER (PARTITION BY site_id ORDER BY line) AS prev FROM pairs)),
rules AS (SELECT a.site_id, lower(a.v) AS agent, r.k = 'allow' AS allow, length(regexp_replace(r.v, '\$$', '')) AS n FROM runs_of a JOIN runs_of r USING (site_id, g) WHERE a.k = 'user-agent' AND r.k IN ('allow', 'disallow') AND r.v <> '' AND regexp_matches('{path}', '^' || replace(replace(r.v, '.', '\.'), '*', '.*'))),
delays AS (SELECT a.site_id, lower(a.v) AS agent, max(TRY_CAST(d.v AS DOUBLE)) AS delay FROM runs_of a JOIN runs_of d USING (site_id, g) WHERE a.k = 'user-agent' AND d.k = 'crawl-delay' GROUP BY ALL),
agents AS (SELECT DISTINCT site_id, lower(v) AS agent FROM runs_of WHERE k = 'user-agent'),
filled AS (SELECT site_id, {ROBOTS} AS text FROM s WHERE trim({ROBOTS}) <> ''),
asked AS (SELECT f.site_id, b.name, b.is_major, CASE WHEN a.agent IS NULL THEN '*' ELSE a.agent END AS agent FROM filled f CROSS JOIN (VALUES {bots}) b(name, is_major) LEFT JOIN agents a ON a.site_id = f.site_id AND a.agent = lower(b.name) AND a.agent <> '*'),
access AS (SELECT q.site_id, q.name, q.is_major, coalesce((SELECT max_by(r.allow, r.n * 2 + r.allow::INT) FROM rules r WHERE r.site_id = q.site_id AND r.agent = q.agent), TRUE) AS allowed, (SELECT max(d.delay) FROM delays d WHERE d.site_id = q.site_id AND d.agent = q.agent) AS delay FROM asked q)"""  # noqa: E731
_ALL_BOTS = ", ".join(f"('{b}', {b in MAJOR_BOTS})" for b in BOTS)
_TOKENS = f"list_filter(list_transform(string_split(lower({DIRECTIVES}), ','), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^(max-snippet|max-image-preview|max-video-preview|unavailable_after)\\s*:'))"
_BARE = f"flatten(list_transform({_TOKENS}, lambda x: regexp_split_to_array(regexp_replace(x, '^[a-z0-9_.-]+\\s*:\\s*', ''), '\\s+')))"
_TEXT = lambda t: t.replace("'", "''")
_FILES = rf"""{_SITES},
config AS (SELECT s.site_id, c.path, c.text FROM s JOIN (VALUES {', '.join(f"('{n}', '{_TEXT(t)}', {k}, {m})" for n, t, k, m in CONFIG)}) c(path, text, k, m) ON length(s.site_id) % c.k = c.m),
own AS (SELECT DISTINCT site_id, p, CASE WHEN p = '' OR p LIKE '%/' THEN p || 'index.html' ELSE p || '.html' END AS path FROM (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site_id, substr(coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/'), 2) AS p FROM pages)),
tree AS (SELECT site_id, path FROM own UNION SELECT site_id, path FROM config)"""
#: The folder that is served: the root where it has an index page, else the shallowest that has one.
_SERVED = r"""indexes AS (SELECT site_id, regexp_replace(path, '/?[^/]*$', '') AS root FROM tree WHERE regexp_matches(path, '(^|/)index\.html$') AND path NOT LIKE 'node_modules/%'),
roots AS (SELECT site_id, root FROM indexes WHERE len(string_split(root, '/')) <= 5 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN root = '' THEN 1 WHEN root IN ('public', 'site', 'www', 'docs', 'dist', 'build', 'src', 'html', '_site') THEN 2 ELSE 100 + len(string_split(root, '/')) END, root) = 1),
listed AS (SELECT t.site_id, t.path AS file, CASE WHEN root = '' THEN path ELSE substr(path, length(root) + 2) END AS rel FROM tree t JOIN roots r ON r.site_id = t.site_id AND (root = '' OR t.path LIKE root || '/%') WHERE path LIKE '%.html' AND path NOT LIKE 'node_modules/%'),
content AS (SELECT *, regexp_replace('/' || rel, '/index\.html$', '/') AS url_path, row_number() OVER (PARTITION BY site_id ORDER BY len(string_split(rel, '/')), CASE WHEN regexp_matches(rel, '(^|/)index\.html$') THEN 0 ELSE 1 END, rel)::INT AS place, count(*) OVER (PARTITION BY site_id) AS pages FROM listed WHERE rel <> '404.html')"""
_REDIRECTS = r"""plain AS (SELECT site_id, 0 AS kind, line AS no, list_filter(regexp_split_to_array(trim(regexp_replace(raw, '#.*$', '')), '\s+'), lambda x: x <> '') AS p FROM (SELECT site_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM config WHERE path = '_redirects')),
vercel AS (SELECT site_id, text FROM config WHERE path = 'vercel.json'),
moved AS (
  SELECT site_id, kind, no, p[1] AS source, p[2] AS target, coalesce(TRY_CAST(replace(p[3], '!', '') AS INT), 301) AS status, coalesce(p[3] LIKE '%!', FALSE) AS force, '_redirects' AS file FROM plain WHERE len(p) >= 2
  UNION ALL SELECT site_id, 1, 1, regexp_extract(text, 'from = "([^"]*)"', 1), regexp_extract(text, 'to = "([^"]*)"', 1), regexp_extract(text, 'status = (\d+)', 1)::INT, contains(text, 'force = true'), 'netlify.toml' FROM config WHERE path = 'netlify.toml'
  UNION ALL SELECT site_id, 2, i, json_extract_string(text, '$.rewrites[' || i || '].source'), json_extract_string(text, '$.rewrites[' || i || '].destination'), 200, FALSE, 'vercel.json' FROM vercel, range(json_array_length(text, '$.rewrites')::INT) r(i)
  UNION ALL SELECT site_id, 3, i, json_extract_string(text, '$.redirects[' || i || '].source'), json_extract_string(text, '$.redirects[' || i || '].destination'), CASE WHEN json_extract_string(text, '$.redirects[' || i || '].permanent') = 'false' THEN 307 ELSE 308 END, TRUE, 'vercel.json' FROM vercel, range(json_array_length(text, '$.redirects')::INT) r(i)),
numbered AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY kind, no) AS rule_no, source, target, status, force, file FROM moved)"""
_STACK = "CASE WHEN 'wp-config.php' = ANY(names) THEN ['wordpress', 'wp-config.php'] WHEN 'next.config.js' = ANY(names) THEN ['nextjs', 'next.config.js'] WHEN 'package.json' = ANY(names) THEN ['astro', 'astro in package.json'] ELSE ['static-html', 'plain HTML files'] END"
_HOST = "CASE " + " ".join(f"WHEN '{f}' = ANY(names) THEN ['{h}', '{f}']" for h, f in HOSTS) + " END"
_NAMES = "named_files AS (SELECT site_id, list(path) AS names FROM tree GROUP BY site_id)"
SQL: dict[str, str] = {
    "page_scores": f"{_WITH} SELECT * FROM results",
    "check_scores": f"{_WITH} {_FULL}",
    "category_scores": f"{_WITH} SELECT site_id, category, floor(sum(score::DECIMAL(10, 1))::DOUBLE * 10 + 0.5) / 10 AS score, sum(weight)::BIGINT AS max FROM checks GROUP BY ALL",
    "site_scorecard": f"{_WITH}, {_TOTALS.format('checks')}",
    "robots_bots": f"WITH {_ROBOTS('/', _ALL_BOTS)} SELECT * FROM access",
    "robots_access": f"""WITH {_ROBOTS('/', _ALL_BOTS)},
      sums AS (SELECT site_id, count(*) AS bots, count(*) FILTER (allowed) AS allowed, count(*) FILTER (is_major) AS major, count(*) FILTER (allowed AND is_major) AS major_allowed, count(*) FILTER (allowed AND delay > 5) AS slowed FROM access GROUP BY ALL),
      raw AS (SELECT *, floor(9 * major_allowed / major + 3 * (allowed - major_allowed) / (bots - major) + 0.5) AS x FROM sums)
      SELECT site_id, bots, allowed, major_allowed, slowed, CASE WHEN {ROBOTS} IS NULL THEN 8 WHEN bots IS NULL THEN 12 ELSE greatest(0, CASE WHEN major_allowed < major THEN least(x, 9) ELSE x END - CASE WHEN slowed > 0 THEN 2 ELSE 0 END) END::INT AS score FROM s LEFT JOIN raw USING (site_id)""",
    "sitemap_scores": rf"""WITH {_SITES}, t AS (SELECT site_id, {ROBOTS} AS robots, {SITEMAP} AS sitemap FROM s), n AS (SELECT *, coalesce(len(regexp_extract_all(sitemap, '<loc[\s>]')), 0) AS urls, coalesce(regexp_matches(robots, '(?im)^[ \t]*sitemap[ \t]*:'), FALSE) AS declared FROM t)
      SELECT site_id, urls::INT AS urls, declared, CASE WHEN sitemap IS NULL THEN 0 ELSE greatest(0, 5 - CASE WHEN robots IS NULL THEN 1 ELSE 0 END - CASE WHEN declared THEN 0 ELSE 2 END - CASE WHEN urls = 0 THEN 2 ELSE 0 END) END::INT AS score FROM n""",
    "sitemap_urls": f"""WITH {_SITES}, t AS (SELECT {SITEMAP} AS text FROM s), u AS (SELECT regexp_matches(text, '<sitemapindex') AS is_index, unnest(regexp_extract_all(text, '<loc>(.*?)</loc>', 1)) AS raw FROM t WHERE text IS NOT NULL)
      SELECT replace(trim(replace(replace(raw, '<![CDATA[', ''), ']]>', '')), '&amp;', '&') AS url, is_index, count(*) AS sites FROM u GROUP BY ALL""",
    "llms_scores": rf"""WITH {_ROBOTS('/llms.txt', "('*', FALSE)")}, t AS (SELECT site_id, coalesce({LLMS}, '') AS text, {LLMS} IS NULL AS absent, coalesce((SELECT NOT allowed FROM access a WHERE a.site_id = s.site_id), FALSE) AS blocked FROM s),
      f AS (SELECT *, regexp_matches(text, '^\s*#\s+\S') AS h1, regexp_matches(text, '(?m)^>\s+\S') AS summary, len(regexp_extract_all(text, '\[[^\]]+\]\([^)]+\)'))::INT AS links, len(regexp_extract_all(text, '(?m)^##\s+')) AS sections FROM t)
      SELECT site_id, h1, links, blocked, CASE WHEN absent THEN 0 ELSE greatest(0, least(6, 5 - CASE WHEN trim(text) = '' THEN 3 WHEN length(trim(text)) < 50 THEN 1 ELSE 0 END - CASE WHEN blocked THEN 2 ELSE 0 END + CASE WHEN h1 AND (summary OR links > 0 OR sections > 0) THEN 1 ELSE 0 END)) END::INT AS score FROM f""",
    "page_headers": rf"""WITH {_SITES}, lines AS (SELECT site_id, line, raw FROM {_LINES(HEADERS)} WHERE trim(raw) <> '' AND trim(raw) NOT LIKE '#%'),
      rules AS (SELECT site_id, line, raw, max(CASE WHEN raw NOT LIKE ' %' THEN line END) OVER (PARTITION BY site_id ORDER BY line) AS at FROM lines),
      named AS (SELECT r.site_id, r.line, '^' || replace(regexp_replace(trim(p.raw), ':[a-z]+', '[^/]+', 'g'), '*', '.*') || '$' AS re, lower(trim(split_part(r.raw, ':', 1))) AS name, trim(substr(r.raw, strpos(r.raw, ':') + 1)) AS value FROM rules r JOIN lines p ON p.site_id = r.site_id AND p.line = r.at WHERE r.raw LIKE ' %'),
      p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site_id, coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages)
      SELECT page_id, name, string_agg(value, ', ' ORDER BY line) AS value FROM p JOIN named USING (site_id) WHERE regexp_matches(path, re) GROUP BY ALL""",
    "directive_flags": rf"""SELECT page_id, list_has_any({_BARE}, ['noindex', 'none']) AS noindex, list_has_any({_BARE}, ['nofollow', 'none']) AS nofollow,
      len(list_filter(string_split(lower({DIRECTIVES}), ','), lambda x: NOT regexp_matches(trim(x), '^[a-z0-9_.-]+\s*:') AND trim(x) IN ('noindex', 'none'))) > 0 AS for_all FROM pages""",
    "site_page_lists": f"WITH {_FILES}, {_SERVED} SELECT site_id, file, url_path, place, pages FROM content WHERE place <= 5",
    "site_stacks": f"WITH {_FILES}, {_NAMES} SELECT site_id, {_STACK}[1] AS stack, {_STACK}[2] AS evidence FROM named_files",
    "site_hosts": f"WITH {_FILES}, {_NAMES} SELECT site_id, {_HOST}[1] AS host, {_HOST}[2] AS evidence FROM named_files WHERE {_HOST} IS NOT NULL",
    "site_redirects": f"WITH {_FILES}, {_REDIRECTS} SELECT * FROM numbered",
    "site_answers": rf"""WITH {_FILES}, {_SERVED}, {_REDIRECTS},
      firm AS (SELECT *, '^' || replace(regexp_replace(replace(source, '(.*)', '*'), ':[a-z]+', '[^/]+', 'g'), '*', '.*') || '/?$' AS re FROM numbered WHERE status <> 200 AND (force OR file = 'vercel.json')),
      met AS (SELECT c.site_id, c.url_path, f.status, f.target FROM content c JOIN firm f ON f.site_id = c.site_id AND regexp_matches(c.url_path, f.re) WHERE place <= 500 QUALIFY row_number() OVER (PARTITION BY c.site_id, c.url_path ORDER BY rule_no) = 1),
      aimed AS (SELECT m.*, root || CASE WHEN t LIKE '%/' THEN t || 'index.html' ELSE t END AS want, t FROM (SELECT *, regexp_replace(target, ':splat|:[a-z]+', '', 'g') AS t FROM met) m JOIN roots USING (site_id)),
      told AS (SELECT a.*, EXISTS (SELECT 1 FROM tree f WHERE f.site_id = a.site_id AND ('/' || f.path = a.want OR '/' || f.path = a.want || '.html' OR '/' || f.path = a.want || '/index.html' OR f.path = a.want)) AS there FROM aimed a),
      said AS (SELECT c.site_id, c.url_path, CASE WHEN t.status IS NULL THEN 200 WHEN t.status >= 400 OR t.target LIKE 'http%' THEN t.status WHEN t.there THEN 200 ELSE 404 END AS status FROM content c LEFT JOIN told t USING (site_id, url_path) WHERE place <= 500)
      SELECT site_id, url_path, status, status < 400 AS ok FROM said""",
    "unknown_urls": f"""WITH {_FILES}, {_NAMES}, {_REDIRECTS}, caught AS (SELECT site_id, min_by(status, rule_no) AS status FROM numbered WHERE source IN ('/*', '/(.*)') GROUP BY site_id),
      p AS (SELECT n.site_id, CASE WHEN c.status IN (404, 410) THEN 1.0 WHEN c.status IS NOT NULL THEN 0.0 WHEN '404.html' = ANY(names) THEN 1.0 WHEN {_STACK}[1] = 'nextjs' THEN 1.0 WHEN {_HOST}[1] IN ('netlify', 'vercel', 'github-pages', 'firebase') THEN 1.0 ELSE 0.5 END::DOUBLE AS point FROM named_files n LEFT JOIN caught c USING (site_id))
      SELECT site_id, point, point = 0.5 AS inconclusive FROM p""",
    "site_page_facts": f"""{_WITH} SELECT page_id, nullif(lang, '') AS lang, nullif(title, '') AS title, CASE WHEN regexp_matches(h, '(?i)<meta name="description"') THEN {_plain('description')} END AS description, canonicals[1] AS canonical, ones::BIGINT AS h1s, len(heads)::BIGINT AS headings,
      len(list_filter(images, lambda x: trim({_ATTR('x', 'alt')}) = ''))::BIGINT AS images_without_alt, nullif({_content('property', 'article:modified_time')}, '') AS modified, nullif({_content('name', 'author')}, '') AS author, array_to_string(flatten(list_transform(nodes, lambda x: CASE WHEN x.t = 'FAQPage' THEN [x.t, 'Question'] ELSE [x.t] END)), ',') AS types FROM counted""",
    "rubric_maxima": f"WITH {_RUBRIC} SELECT category, sum(weight)::BIGINT AS max FROM rubric WHERE NOT advisory GROUP BY ROLLUP (category)",
    "noindex_pages": f"{_WITH}, {_OUT} SELECT site_id, page_id FROM left_out",
    "full_scorecard": f"""{_WITH}, {_OUT},
      kept AS (SELECT r.site_id, r.check_id, r.weight, r.score FROM results r ANTI JOIN left_out o USING (site_id, page_id)),
      means AS (SELECT site_id, check_id, weight, floor(sum(score) / count(*) * 10 + 0.5) / 10 AS score, count(*) AS pages FROM kept GROUP BY ALL), {_TOTALS.format('means')}""",
    "score_changes": f"""{_WITH},
      {_pages_sql('html', name='_bare')}
      SELECT site_id, check_id, b.score AS score_before, a.score AS score_after, floor((coalesce(a.score, 0) - coalesce(b.score, 0)) * 10 + 0.5) / 10 AS gained FROM checks_bare b FULL JOIN checks a USING (site_id, check_id)""",
    "site_problems": f"{_WITH}, rated AS ({_FULL}), placed AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY lost DESC, weight DESC, list_position({list(CHECK_ORDER)}, check_id))::INT AS place, check_id, lost, weight, status FROM rated WHERE lost > 0) SELECT * FROM placed WHERE place <= 5",
    "page_quality": f"{_WITH} SELECT page_id, kind AS page_type, words FROM judged",
    "page_titles": f"{_WITH} SELECT page_id, title, len(links) AS links FROM judged",
    "path_keys": "SELECT page_id, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '(?i)/index\\.html?$', '/'), '(?i)\\.html?$', ''), '/+$', '')), ''), '/') AS key FROM pages",
}
SQL |= {name: f"{_WITH} SELECT * FROM results WHERE check_id = '{i}'" for i, name in _KEYS.items()}
SQL["http_scores"] = f"""WITH fine AS (SELECT site_id, count(*) FILTER (ok) / count(*) AS share FROM ({SQL["site_answers"]}) GROUP BY site_id)
SELECT site_id, point + coalesce(share, 1) + 1 AS score, inconclusive FROM ({SQL["unknown_urls"]}) LEFT JOIN fine USING (site_id)"""
_KINDS = {p: k for p, k, _ in ARTIFACTS}
_SIGNAL = lambda text, k: f"list_filter(list_transform(string_split(lower({text}), ','), lambda x: string_split(x, '=')), lambda x: trim(x[1]) = '{k}' AND trim(x[2]) IN ('yes', 'no'))"
SQL["content_signal_scores"] = rf"""WITH {_SITES}, lines AS (SELECT site_id, line, trim(raw) AS x FROM {_LINES(SIGNAL_LINES)}),
said AS (SELECT site_id, line, trim(substr(x, strpos(x, ':') + 1)) AS v FROM lines WHERE lower(x) LIKE 'content-signal%:%'),
last AS (SELECT site_id, {', '.join(f"max_by(trim(({_SIGNAL('v', k)})[-1][2]), line) FILTER (len({_SIGNAL('v', k)}) > 0) AS s{i}" for i, k in enumerate(('search', 'ai-input', 'ai-train')))} FROM said GROUP BY site_id),
named AS (SELECT DISTINCT site_id FROM lines WHERE lower(x) LIKE 'user-agent:%' AND lower(trim(substr(x, strpos(x, ':') + 1))) IN {_in(b.lower() for b in BOTS)}),
told AS (SELECT s.site_id, concat_ws(', ', {', '.join(f"'{k}=' || coalesce(s{i}, trim(({_SIGNAL(SIGNAL_HEADER.replace('site_id', 's.site_id'), k)})[-1][2]))" for i, k in enumerate(('search', 'ai-input', 'ai-train')))}) AS signals, n.site_id IS NOT NULL AS named FROM s LEFT JOIN last l ON l.site_id = s.site_id LEFT JOIN named n ON n.site_id = s.site_id)
SELECT site_id, signals, CASE WHEN signals <> '' THEN 3 WHEN named THEN 1 ELSE 0 END::INT AS score FROM told"""
SQL["https_scores"] = f"""WITH page AS (SELECT page_id, url, {AUGMENTED} AS h, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site_id FROM pages),
sums AS (SELECT site_id, bool_and(url LIKE 'https:%') AS secure, count(*) FILTER (regexp_matches(h, '<(img|script|iframe|video|audio|source|embed) [^>]*src="http://')) AS mixed_pages FROM page GROUP BY site_id)
SELECT site_id, secure, mixed_pages, CASE WHEN NOT secure THEN 0 ELSE floor(2 - CASE WHEN mixed_pages > 0 THEN 0.5 ELSE 0 END - CASE WHEN length(site_id) % 4 = 0 THEN 0.5 ELSE 0 END) END::INT AS score FROM sums"""
SQL["markdown_scores"] = f"""WITH page AS (SELECT page_id, {AUGMENTED} AS h, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site_id FROM pages),
asked AS (SELECT *, contains(h, 'type="text/markdown" href=') AS linked, page_id % 10 = 3 AS negotiated, page_id % 3 > 0 AS alternate, page_id % 5 = 0 AND page_id % 15 = 5 AS guessed FROM page)
SELECT site_id, page_id, CASE WHEN negotiated THEN 3 WHEN linked AND alternate THEN 3 WHEN NOT linked AND guessed THEN 1 ELSE 0 END::INT AS score FROM asked"""
SQL["protocol_scores"] = f"""WITH page AS (SELECT {AUGMENTED} AS h, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site_id FROM pages),
shown AS (SELECT site_id, bool_or(regexp_matches(h, '<link rel="service-desc"') OR regexp_matches(lower(h), '<a href="/?({'|'.join(API_SEGMENTS)})[/?#"]')) AS api FROM page GROUP BY site_id),
files AS (SELECT site_id, f.* EXCLUDE (k, m) FROM shown JOIN (VALUES {', '.join(f"('{p}', '{_KINDS[p]}', '{c}', '{t}', {k}, {m})" for p, c, t, k, m in ARTIFACT_FILES)}) f(path, kind, type, text, k, m) ON length(site_id) % k = m),
good AS (SELECT site_id, count(DISTINCT kind) AS n FROM files WHERE type NOT LIKE '%html%' AND (kind = 'ai' AND trim(text) <> '' OR json_valid(text) AND json_type(CASE WHEN json_valid(text) THEN text ELSE 'null' END) = 'OBJECT' AND CASE kind WHEN 'a2a' THEN coalesce(json_extract_string(text, '$.name'), '') <> '' WHEN 'api' THEN coalesce(json_extract_string(text, '$.openapi'), '') <> '' ELSE TRUE END) GROUP BY site_id)
SELECT site_id, coalesce(n, 0)::INT AS kinds, CASE WHEN n >= 3 THEN 6 WHEN n = 2 THEN 5 WHEN n = 1 THEN 3 WHEN api THEN 0 END::INT AS score FROM shown LEFT JOIN good USING (site_id)"""
SQL["site_evidence"] = rf"""WITH {_FILES}, {_NAMES},
made AS (SELECT site_id, 'robots' AS name, CASE WHEN {_STACK}[1] = 'wordpress' THEN 'wordpress makes it' WHEN 'package.json' = ANY(names) THEN 'next-sitemap in package.json' END AS source FROM named_files
  UNION ALL SELECT site_id, 'llms', CASE WHEN {_STACK}[1] = 'wordpress' THEN 'wordpress makes it' END FROM named_files
  UNION ALL SELECT site_id, 'sitemap', CASE WHEN {_STACK}[1] = 'wordpress' THEN 'WordPress core sitemap' WHEN 'package.json' = ANY(names) THEN 'next-sitemap in package.json' END FROM named_files),
asked AS ({' UNION ALL '.join(f"SELECT site_id, '{k}' AS name, {text()} AS text, {ANSWERS[k]} AS status, {LIVE} AS live FROM s" for k, (_, text) in TEXTS.items())})
SELECT a.site_id, a.name, CASE WHEN text IS NOT NULL THEN 'read' WHEN live THEN CASE WHEN status IN (401, 403, 429, 503) THEN 'unreadable' ELSE 'absent' END WHEN source IS NOT NULL THEN 'generated' ELSE 'absent' END AS state, source FROM asked a LEFT JOIN made USING (site_id, name)"""
_SAID_BY_HEADER = ", ".join(f"'{k}=' || trim(({_SIGNAL(SIGNAL_HEADER, k)})[-1][2])" for k in ("search", "ai-input", "ai-train"))
SQL["evidence_scores"] = rf"""WITH known AS (SELECT * FROM ({SQL["site_evidence"]})), {_SITES},
t AS (SELECT site_id, {ROBOTS} AS robots, {LLMS} AS llms, {SITEMAP} AS sitemap, {LIVE} AS live, concat_ws(', ', {_SAID_BY_HEADER}) AS said FROM s),
state AS (SELECT t.*, r.state AS rs, l.state AS ls, m.state AS ms FROM t JOIN known r ON r.site_id = t.site_id AND r.name = 'robots' JOIN known l ON l.site_id = t.site_id AND l.name = 'llms' JOIN known m ON m.site_id = t.site_id AND m.name = 'sitemap'),
f AS (SELECT *, coalesce(regexp_matches(robots, '(?im)^[ \t]*sitemap[ \t]*:'), FALSE) AS named, coalesce(len(regexp_extract_all(sitemap, '<loc[\s>]')), 0) AS urls, regexp_matches(llms, '^\s*#\s+\S') AND regexp_matches(llms, '\[[^\]]+\]\([^)]+\)') AS valid,
    ms = 'unreadable' OR (ms = 'absent' AND live AND rs = 'unreadable') AS lost, len(list_filter(regexp_extract_all(lower(coalesce(robots, '')), '(?m)^user-agent:[ \t]*([^#\n]*)', 1), lambda a: trim(a) IN {_in(b.lower() for b in BOTS)})) > 0 AS addressed FROM state)
SELECT site_id, 'ai-access.bot-crawlability' AS check_id, CASE rs WHEN 'read' THEN (SELECT score FROM ({SQL["robots_access"]}) a WHERE a.site_id = f.site_id) WHEN 'unreadable' THEN 6 ELSE 8 END::DOUBLE AS score, rs IN ('unreadable', 'generated') AS inconclusive, FALSE AS predicted FROM f
UNION ALL SELECT site_id, 'ai-access.llms-txt', CASE WHEN ls IN ('unreadable', 'generated') THEN 3 WHEN ls = 'absent' THEN 0 ELSE greatest(0, least(6, 5 - CASE WHEN length(llms) = 0 THEN 3 WHEN length(llms) < 50 THEN 1 ELSE 0 END - CASE WHEN (SELECT blocked FROM ({SQL["llms_scores"]}) b WHERE b.site_id = f.site_id) THEN 2 ELSE 0 END + CASE WHEN valid THEN 1 ELSE 0 END)) END, ls IN ('unreadable', 'generated'), FALSE FROM f
UNION ALL SELECT site_id, 'ai-access.content-signals', CASE WHEN said <> '' THEN 3 WHEN rs IN ('unreadable', 'generated') THEN 2 WHEN addressed THEN 1 ELSE 0 END, said = '' AND rs IN ('unreadable', 'generated'), said <> '' AND NOT live FROM f
UNION ALL SELECT site_id, 'crawlability.sitemap', CASE WHEN lost THEN 2.5 WHEN ms = 'absent' THEN 0 ELSE greatest(0, 5 - CASE WHEN rs = 'absent' THEN 1 ELSE 0 END - CASE WHEN NOT named AND rs NOT IN ('unreadable', 'generated') THEN 2 ELSE 0 END - CASE WHEN ms = 'read' AND urls = 0 THEN 2 ELSE 0 END) END, lost OR (ms <> 'absent' AND rs IN ('unreadable', 'generated')), ms = 'generated' FROM f"""
SQL["blocked_crawlers"] = rf"""WITH {_ROBOTS('/', _ALL_BOTS)},
listed AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {k})" for k, b in enumerate(BOTS))}) l(name, nth)),
ruled AS (SELECT a.site_id, lower(a.v) AS agent, r.k = 'allow' AS allow, length(regexp_replace(r.v, '\$$', '')) AS n, r.line, r.v AS rule FROM runs_of a JOIN runs_of r USING (site_id, g) WHERE a.k = 'user-agent' AND r.k IN ('allow', 'disallow') AND r.v <> '' AND regexp_matches('/', '^' || replace(replace(r.v, '.', '\.'), '*', '.*'))),
slowed AS (SELECT a.site_id, lower(a.v) AS agent, TRY_CAST(d.v AS DOUBLE) AS delay, (SELECT min(u.line) FROM runs_of u WHERE u.site_id = a.site_id AND u.g = a.g AND u.k = 'user-agent') AS line FROM runs_of a JOIN runs_of d USING (site_id, g) WHERE a.k = 'user-agent' AND d.k = 'crawl-delay'),
best AS (SELECT q.site_id, q.name, r.allow, r.line, r.rule FROM asked q JOIN ruled r USING (site_id, agent) QUALIFY row_number() OVER (PARTITION BY q.site_id, q.name ORDER BY r.n DESC, r.allow DESC, CASE WHEN r.allow THEN -r.line ELSE r.line END) = 1),
waits AS (SELECT q.site_id, q.name, d.delay, d.line FROM asked q JOIN slowed d USING (site_id, agent) QUALIFY row_number() OVER (PARTITION BY q.site_id, q.name ORDER BY d.delay DESC, d.line) = 1),
told AS (SELECT site_id, name, 'rule' AS kind, line, rule, NULL::DOUBLE AS delay FROM best WHERE NOT allow UNION ALL SELECT w.site_id, w.name, 'delay', w.line, NULL, w.delay FROM waits w LEFT JOIN best b USING (site_id, name) WHERE w.delay > 5 AND coalesce(b.allow, TRUE))
SELECT site_id, kind, line::INT AS line, rule, delay, string_agg(name, ', ' ORDER BY nth) AS crawlers, count(*) AS n FROM told JOIN listed USING (name) GROUP BY site_id, kind, line, rule, delay"""
_SCHEME = lambda x: f"CASE WHEN regexp_matches({x}, '(?i)^https://') THEN 'https' WHEN regexp_matches({x}, '(?i)^http://') THEN 'http' END"
SQL["site_schemes"] = rf"""{_WITH}, {_FILES.replace("own AS", "own_files AS").replace("FROM own UNION", "FROM own_files UNION")}, {_NAMES}, {_REDIRECTS.replace("rules AS", "rules_of AS")},
votes AS (SELECT site_id, count(*) FILTER (scheme = 'https') AS https_votes, count(*) FILTER (scheme = 'http') AS http_votes FROM (SELECT site_id, {_SCHEME("canonicals[1]")} AS scheme FROM judged UNION ALL SELECT site_id, CASE WHEN regexp_matches(h, '<meta property="og:url"') THEN {_SCHEME("og_url")} END FROM judged) GROUP BY site_id),
hosted AS (SELECT site_id, {_HOST}[1] AS host, {_HOST}[2] AS file FROM named_files),
based AS (SELECT s.site_id, {BASE_URL.replace("site_id", "s.site_id")} AS base, {HSTS.replace("site_id", "s.site_id")} AS hsts, host, file, https_votes, http_votes, CASE host {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in HTTPS_HOSTS.items())} END AS named FROM s JOIN votes USING (site_id) JOIN hosted USING (site_id)),
told AS (SELECT *, coalesce({_SCHEME("base")}, CASE WHEN http_votes > https_votes THEN 'http' WHEN https_votes > 0 THEN 'https' END) AS declared FROM based)
SELECT site_id, CASE WHEN hsts THEN 'https' WHEN declared = 'http' THEN CASE WHEN named IS NOT NULL THEN 'https' ELSE 'http' END WHEN declared = 'https' OR named IS NOT NULL THEN 'https' END AS scheme, https_votes, http_votes, hsts AS forced, declared, host,
  concat_ws('; ', CASE WHEN hsts THEN 'Strict-Transport-Security header in _headers' END, 'site URL declared as ' || declared || '://' || CASE WHEN base IS NOT NULL THEN ' (' || base || ')' ELSE '' END, named || ' serves HTTPS by default (' || file || ')') AS evidence FROM told"""
#: Markdown of live pages; the first twenty of a site are asked for it.
_MARKDOWN = rf"""SELECT site_id, page_id, CASE WHEN asked AND page_id % 10 = 3 THEN 3 WHEN linked AND asked AND page_id % 3 > 0 THEN 3 WHEN linked AND NOT asked THEN 3 WHEN NOT asked THEN CASE WHEN others THEN 3 ELSE 1.5 END ELSE 0 END AS score,
  NOT asked AND (linked OR NOT others) AS unsure, NOT asked AND NOT linked AND others AS guessed
FROM (SELECT *, bool_or(asked AND page_id % 10 = 3) OVER (PARTITION BY site_id) AS others FROM (SELECT site_id, page_id, contains(h, 'type="text/markdown" href=') AS linked, row_number() OVER (PARTITION BY site_id ORDER BY page_id) <= 20 AS asked FROM raw))"""
_WEIGHT = "CASE check_id " + " ".join(f"WHEN '{i}' THEN {w}" for i, _, w, _, _, _ in RUBRIC) + " END"
_SITE = f"""SELECT site_id, check_id, {_WEIGHT} AS weight, score, FALSE AS na, inconclusive AS unsure, predicted AS guessed FROM ({SQL["evidence_scores"]})
  UNION ALL SELECT site_id, 'crawlability.http-behavior', 3, score, FALSE, inconclusive, TRUE FROM ({SQL["http_scores"]})
  UNION ALL SELECT site_id, 'crawlability.https', 2, score, FALSE, FALSE, FALSE FROM ({SQL["https_scores"]})
  UNION ALL SELECT site_id, 'agent-readiness.protocols', 6, coalesce(score, 0), score IS NULL, FALSE, FALSE FROM ({SQL["protocol_scores"]})"""


def _states_sql(open_: str = "length(p.site_id) % 19 <> 0") -> str:
    return f"{_WITH}, {_STATES}".replace("§markdown", _MARKDOWN).replace("§site", _SITE).replace("§open", open_)


_SUMMED = """sums AS (SELECT site_id, floor(coalesce(sum(CASE WHEN status NOT IN ('skipped', 'na') THEN score::DECIMAL(10, 1) END), 0)::DOUBLE + 0.5)::BIGINT AS total, coalesce(sum(weight) FILTER (status NOT IN ('skipped', 'na')), 0)::BIGINT AS available,
      coalesce(sum(weight) FILTER (status = 'na'), 0)::BIGINT AS na_weight, coalesce(sum(weight) FILTER (status = 'skipped'), 0)::BIGINT AS skipped_weight FROM states WHERE NOT advisory GROUP BY site_id),
      shares AS (SELECT *, CASE WHEN available > 0 THEN floor(total / available * 100 + 0.5) ELSE 0 END::BIGINT AS percentage FROM sums)
      SELECT *, CASE WHEN available = 0 THEN '' WHEN percentage >= 90 THEN 'Ready for AI' WHEN percentage >= 80 THEN 'Nearly Optimized' WHEN percentage >= 70 THEN 'Needs Work' WHEN percentage >= 60 THEN 'Major Gaps' ELSE 'Not AEO Ready' END AS grade FROM shares"""
SQL["audit_states"] = f"{_states_sql()} SELECT * FROM states"
SQL["audit_totals"] = f"{_states_sql()}, {_SUMMED}"
SQL["whole_audit"] = f"{_states_sql('TRUE')}, {_SUMMED}"
SQL["audit_categories"] = f"{_states_sql()} SELECT site_id, category, floor(coalesce(sum(CASE WHEN status NOT IN ('skipped', 'na') THEN score::DECIMAL(10, 1) END), 0)::DOUBLE * 10 + 0.5) / 10 AS score, coalesce(sum(weight) FILTER (status NOT IN ('skipped', 'na')), 0)::BIGINT AS max, coalesce(sum(weight) FILTER (status IN ('skipped', 'na')), 0)::BIGINT AS skipped FROM states WHERE NOT advisory GROUP BY ALL"
SQL["audit_summaries"] = rf"""{_states_sql()}, {_TOTALS_OF},
      worst AS (SELECT site_id, string_agg(concat('- ', name, ': -', regexp_replace(lost::VARCHAR, '\.0$', ''), ' (', CASE fixable WHEN 'auto' THEN 'auto-fix' ELSE 'assisted' END, ')'), chr(10) ORDER BY lost DESC, ord) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY lost DESC, ord) AS nth FROM states WHERE status IN ('fail', 'warning')) WHERE nth <= 5 GROUP BY site_id),
      told AS (SELECT site_id, string_agg(name, ', ' ORDER BY ord) FILTER (status = 'advice') AS advised, max(excluded_pages) AS outs FROM states GROUP BY site_id)
      SELECT t.site_id, concat_ws(chr(10), concat('Score ', total, '/', available, ' (', percentage, '%, ', grade, ')'), lines, CASE WHEN outs > 0 THEN concat('Not scored: ', outs, ' page(s) kept out of search on purpose (noindex)') END, 'Advice, no points: ' || advised) AS summary FROM graded t LEFT JOIN worst USING (site_id) JOIN told USING (site_id)"""
_NEWLINES = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
#: Lines of tags: line ends before the first one, or before each.
_AT = lambda tag: "(1 + " + _NEWLINES(f"string_split_regex(h, '{tag}')[1]") + ")"
_ATS = lambda tag: f"list_transform(range(1, len(string_split_regex(h, '{tag}'))), lambda i: 1 + " + _NEWLINES(f"array_to_string(string_split_regex(h, '{tag}')[1:i], '')") + ")"


def _told(*items: tuple[str, str, str]) -> str:
    """SQL for findings (test, message, line) in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN concat({line}, ':', {m}) END" for t, m, line in items) + "], lambda x: x IS NOT NULL)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEAD_LINE, _TITLE_LINE, _DESCRIPTION_LINE, _VIEW = _AT("<head"), _AT("<title"), _AT('(?i)<meta name="description"'), _AT('<meta name="viewport"')
_CITED = lambda m: f"concat({m}, ': \"', title, '\"')"
_GENERIC_TITLE = f"regexp_full_match(lower(title), '{GENERIC_TITLES}')"
_TITLE_FINDINGS = _told(
    ("n < 40", _CITED("concat('Title too short (', n, ' chars, aim for 50-60)')"), _TITLE_LINE), ("n BETWEEN 40 AND 49", _CITED("concat('Title could be longer (', n, ' chars, optimal 50-60)')"), _TITLE_LINE),
    ("n > 70", _CITED("concat('Title too long (', n, ' chars, may be truncated)')"), _TITLE_LINE), ("n BETWEEN 61 AND 70", _CITED("concat('Title slightly long (', n, ' chars, optimal 50-60)')"), _TITLE_LINE),
    (_GENERIC_TITLE, _CITED("concat('Generic title \"', title, '\"')"), _TITLE_LINE), ("n < 20 AND separators = 0", _CITED("'Title has no page context (consider \"Page Topic | Brand\")'"), _TITLE_LINE), ("separators > 3", _CITED("concat('Title has ', separators, ' separators and may look spammy')"), _TITLE_LINE),
)
_DESCRIBED = """regexp_matches(h, '(?i)<meta name="description"')"""
_STUFFED = "coalesce(list_max(list_transform(dwords, lambda w: len(list_filter(dwords, lambda v: v = w)))), 0) > 3 AND len(regexp_split_to_array(description, '\\s+')) > 10"
_DESCRIPTION_FINDINGS = _told(
    ("dn < 70", _q("Description too short (under 70 chars, optimal 120-160)"), _DESCRIPTION_LINE), ("dn BETWEEN 70 AND 119", _q("Description could be longer (70-119 chars, optimal 120-160)"), _DESCRIPTION_LINE), ("dn > 170", _q("Description too long (over 170 chars, may be truncated)"), _DESCRIPTION_LINE), ("dn BETWEEN 161 AND 170", _q("Description slightly long (161-170 chars, optimal 120-160)"), _DESCRIPTION_LINE),
    (f"regexp_matches(lower(trim(description)), '{GENERIC_DESCRIPTIONS}')", _q("Description looks generic or placeholder"), _DESCRIPTION_LINE), (f"lower(trim({_plain('description')})) = lower(title)", _q("Description is identical to the title"), _DESCRIPTION_LINE), (_STUFFED, _q("Description may be keyword-stuffed"), _DESCRIPTION_LINE),
)
_WIDE = "coalesce(lower(width) = 'device-width', FALSE)"
_VIEW_FINDINGS = _told(
    (f"NOT {_WIDE} AND width IS NOT NULL", _q("Viewport sets a fixed width instead of device-width"), _VIEW), (f"NOT {_WIDE} AND width IS NULL", _q("Viewport is missing width=device-width"), _VIEW), ("scale IS NULL", _q("Viewport is missing initial-scale=1"), _VIEW),
    ("scale IS NOT NULL AND coalesce(TRY_CAST(scale AS DOUBLE) <> 1, TRUE)", _q("Viewport initial-scale is not 1"), _VIEW), ("""contains(regexp_extract(h, '<meta name="viewport" content="([^"]*)"', 1), ';')""", _q('Viewport uses ";" as separator (use ",")'), _VIEW),
)
_META = lambda key: _AT(f'<meta (?:property|name)="{key}"')
_NEEDS = lambda kind, keys, var: [(f"{var}_{k} IS NULL", _q(f"Missing {kind}:{k}"), _HEAD_LINE) for k in keys] + [(f"trim({var}_{k}) = ''", _q(f"Empty {kind}:{k}"), _META(f"{kind}:{k}")) for k in keys]
_COUNT = lambda tests: " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests)
_OG_KEYS, _TW_KEYS = ("title", "description", "image"), ("card", "title", "description")
_LOOSE_IMAGE = "og_image <> '' AND NOT regexp_matches(og_image, '^[A-Za-z][A-Za-z0-9+.-]*:.')"
_OG_OTHER = f"og_url <> '' AND {_url_sql('og_url')} <> {_url_sql('canonical')}"
_OG_FINDINGS = _told(*_NEEDS("og", _OG_KEYS, "og"), ("og_url IS NULL", _q("Missing og:url"), _HEAD_LINE), ("og_type IS NULL", _q('Missing og:type (use "website" or "article")'), _HEAD_LINE), (_LOOSE_IMAGE, _q("og:image is not an absolute URL"), _META("og:image")), (_OG_OTHER, _q("og:url does not match the canonical URL"), _META("og:url")))
_OG_MISSING, _OG_EMPTY = _COUNT(f"og_{k} IS NULL" for k in _OG_KEYS), _COUNT(f"trim(og_{k}) = ''" for k in _OG_KEYS)
_TW_ODD = "tw_card <> '' AND tw_card NOT IN ('summary', 'summary_large_image', 'app', 'player')"
_STAND_IN = "coalesce(tw_card, tw_title, tw_description, tw_image) IS NULL AND concat(og_title, og_description, og_image) <> ''"
_TW_FINDINGS = f"CASE WHEN {_STAND_IN} THEN [concat({_HEAD_LINE}, ':No twitter:* tags (X falls back to Open Graph)')] ELSE " + _told(*_NEEDS("twitter", _TW_KEYS, "tw"), ("tw_image IS NULL", _q("Missing twitter:image"), _HEAD_LINE), (_TW_ODD, "concat('Invalid twitter:card type \"', tw_card, '\" (use summary, summary_large_image, app, player)')", _META("twitter:card"))) + " END"
_TW_MISSING, _TW_EMPTY = _COUNT(f"tw_{k} IS NULL" for k in _TW_KEYS), _COUNT(f"trim(tw_{k}) = ''" for k in _TW_KEYS)
_LANG_OK = f"regexp_matches(lang, '(?i)^([a-z]{{2,3}})(?:-([a-z]{{4}}))?(?:-([a-z]{{2}}|[0-9]{{3}}))?$') AND lower(string_split(lang, '-')[1]) IN {_in(LANGUAGES)}"
_WHOLE = lambda x: f"{x}::INT"
SQL["page_messages"] = rf"""{_WITH},
lined AS (SELECT *, {_ATS('<h[1-6][^>]*>')} AS head_lines, {_ATS('<img ')} AS image_lines, {_ATS('<a ')} AS link_lines, floor(least * 0.33)::INT AS bare, floor(least * 0.66)::INT AS thin,
  list_filter(list_transform(range(1, len(heads) + 1), lambda i: {{'i': i, 'level': heads[i].level, 'text': heads[i].text}}), lambda x: x.level = 1) AS h1s FROM counted),
told AS (SELECT page_id, unnest([
  {{'check_id': 'meta.title', 'message': CASE WHEN n = 0 THEN 'No title tag found' WHEN len({_TITLE_FINDINGS}) > 0 THEN concat('Title: ', n, ' chars - ', len({_TITLE_FINDINGS}), ' issue(s)') ELSE concat('Title OK (', n, ' chars)') END, 'found': CASE WHEN n = 0 THEN [concat({_TITLE_LINE}, ':Empty <title>')] ELSE {_TITLE_FINDINGS} END,
    'fix': CASE WHEN n = 0 THEN 'Add a unique, descriptive title (50-60 characters) in the form "Page Topic | Brand".' WHEN len({_TITLE_FINDINGS}) > 0 THEN 'Rewrite the title to 50-60 characters, specific to the page, as "Page Topic | Brand".' ELSE '' END}},
  {{'check_id': 'meta.description', 'message': CASE WHEN NOT {_DESCRIBED} THEN 'No meta description found' WHEN dn = 0 THEN 'Meta description is empty' WHEN len({_DESCRIPTION_FINDINGS}) > 0 THEN concat('Description: ', dn, ' chars - ', len({_DESCRIPTION_FINDINGS}), ' issue(s)') ELSE concat('Description OK (', dn, ' chars)') END,
    'found': CASE WHEN NOT {_DESCRIBED} THEN [concat({_HEAD_LINE}, ':Missing <meta name="description">')] WHEN dn = 0 THEN [concat({_DESCRIPTION_LINE}, ':Empty <meta name="description">')] ELSE {_DESCRIPTION_FINDINGS} END, 'fix': CASE WHEN dn = 0 OR len({_DESCRIPTION_FINDINGS}) > 0 THEN {_q(DESCRIPTION_FIX)} ELSE '' END}},
  {{'check_id': 'meta.viewport', 'message': CASE WHEN NOT sized THEN 'No viewport meta tag found' WHEN {_WIDE} AND scale IS NOT NULL THEN 'Mobile-friendly viewport configured' ELSE 'Viewport present but may need optimization' END, 'found': CASE WHEN NOT sized THEN [concat({_HEAD_LINE}, ':Missing <meta name="viewport">')] ELSE {_VIEW_FINDINGS} END,
    'fix': CASE WHEN NOT sized THEN {_q(f'Add {VIEWPORT_TAG} to the shared <head>.')} WHEN len({_VIEW_FINDINGS}) > 0 THEN {_q(f'Use {VIEWPORT_TAG}.')} ELSE '' END}},
  {{'check_id': 'meta.language', 'message': CASE WHEN {_LANG_OK} THEN concat('Language: ', lang) WHEN lang <> '' THEN concat('Language attribute present but may be invalid: ', lang) ELSE 'No language attribute found' END,
    'found': CASE WHEN lang = '' THEN [concat({_AT('<html')}, ':Missing lang attribute on <html>')] WHEN NOT {_LANG_OK} THEN [concat({_AT('<html')}, ':Unrecognized language code "', lower(string_split(lang, '-')[1]), '"')] ELSE [] END, 'fix': CASE WHEN {_LANG_OK} THEN '' ELSE 'Set <html lang="..."> to a valid language tag such as "en" or "en-US" in the root layout.' END}},
  {{'check_id': 'meta.open-graph', 'message': CASE WHEN {_OG_MISSING} > 0 THEN concat('Missing ', {_OG_MISSING}, ' required OG tag(s)') WHEN {_OG_EMPTY} > 0 THEN concat('Open Graph: ', {_OG_EMPTY}, ' empty required tag(s)') ELSE concat('Open Graph: ', {_COUNT(f"og_{k} IS NOT NULL" for k in ("title", "description", "image", "url", "type"))}, '/7 tags present') END, 'found': {_OG_FINDINGS}, 'fix': CASE WHEN len({_OG_FINDINGS}) > 0 THEN {_q(OPEN_GRAPH_FIX)} ELSE '' END}},
  {{'check_id': 'meta.twitter-cards', 'message': CASE WHEN {_STAND_IN} THEN 'Using Open Graph fallback (no Twitter-specific tags)' WHEN {_TW_MISSING} > 0 THEN concat('Missing ', {_TW_MISSING}, ' required Twitter tag(s)') WHEN {_TW_EMPTY} > 0 THEN concat('Twitter Cards: ', {_TW_EMPTY}, ' empty required tag(s)')
      ELSE concat('Twitter Cards: ', {_COUNT([*(f"tw_{k} IS NOT NULL" for k in ("card", "title", "description", "image")), "contains(h, '<meta name=" + chr(34) + "twitter:creator" + chr(34) + "')"])}, '/6 tags present', CASE WHEN tw_card <> '' THEN concat(' (', tw_card, ')') ELSE '' END) END, 'found': {_TW_FINDINGS}, 'fix': CASE WHEN len({_TW_FINDINGS}) > 0 THEN {_q(TWITTER_FIX)} ELSE '' END}},
  {{'check_id': 'content.headings', 'message': CASE WHEN heads = [] THEN 'No headings found on page' ELSE concat(len(heads), ' heading(s), ', CASE WHEN ones <> 1 OR skips > 0 OR generic_heads > 3 THEN concat({_COUNT(("ones <> 1", "skips > 0", "generic_heads > 3"))}, ' issue(s)') ELSE 'well structured' END) END,
    'found': CASE WHEN heads = [] THEN [concat({_AT('<body')}, ':Page has no headings (h1-h6)')] ELSE CASE WHEN ones = 0 THEN [concat(head_lines[1], ':No <h1> on the page')] ELSE [] END || list_transform(h1s[2:], lambda x: concat(head_lines[x.i], ':Additional <h1> (only one per page)'))
      || list_transform(list_filter(range(2, len(heads) + 1), lambda i: heads[i].level > heads[i - 1].level + 1), lambda i: concat(head_lines[i], ':Skipped heading level: H', heads[i].level, ' after H', heads[i - 1].level))
      || CASE WHEN generic_heads > 3 THEN list_transform(list_filter(range(1, len(heads) + 1), lambda i: length(heads[i].text) < 3 OR heads[i].text IN {_in(GENERIC_HEADINGS)}), lambda i: concat(head_lines[i], ':Generic or very short heading "', heads_said[i], '"')) ELSE [] END END,
    'fix': CASE WHEN heads = [] THEN 'Structure the page with one <h1> for the topic and <h2>/<h3> for its sections.' WHEN ones <> 1 OR skips > 0 OR generic_heads > 3 THEN (SELECT upper(x[1]) || x[2:] || '.' FROM (SELECT concat_ws('; ', CASE WHEN ones = 0 THEN 'add one <h1> naming the page topic' END, CASE WHEN ones > 1 THEN 'keep a single <h1> and demote the others to <h2>' END, CASE WHEN skips > 0 THEN 'do not skip heading levels (H2 then H3, not H2 then H4)' END, CASE WHEN generic_heads > 3 THEN 'rename generic headings to say what the section is about' END) AS x)) ELSE '' END}},
  {{'check_id': 'content.image-alt', 'message': CASE WHEN images = [] THEN 'No images found on page' WHEN shown_images = [] THEN concat('No content images (', len(images), ' decorative)') ELSE concat(len(list_filter(shown_images, lambda x: trim({_ATTR('x', 'alt')}) <> '')), '/', len(shown_images), ' images have alt text') END,
    'found': list_transform(list_filter(range(1, len(images) + 1), lambda i: list_contains(shown_images, images[i]) AND trim({_ATTR('images[i]', 'alt')}) = ''), lambda i: concat(image_lines[i], ':<img src="', {_ATTR('images[i]', 'src')}, '">', CASE WHEN regexp_matches(images[i], '\salt=') THEN ' has empty alt text' ELSE ' has no alt attribute' END)),
    'fix': CASE WHEN len(list_filter(shown_images, lambda x: trim({_ATTR('x', 'alt')}) = '')) > 0 THEN concat('Add descriptive alt text to ', len(list_filter(shown_images, lambda x: trim({_ATTR('x', 'alt')}) = '')), ' image(s). For purely decorative images use alt="" together with role="presentation" (or aria-hidden="true").') ELSE '' END}},
  {{'check_id': 'content.internal-links', 'message': CASE WHEN links = [] THEN 'No internal links found' ELSE concat(len(links), ' internal link', CASE WHEN len(links) > 1 THEN 's' ELSE '' END, CASE WHEN content_links > 0 THEN concat(' (', content_links, ' in content)') ELSE '' END, ', ', {_WHOLE(f"floor(len(list_filter(links, lambda x: NOT (length(x.text) < 2 OR x.text IN {_in(GENERIC_ANCHORS)}))) / len(links) * 100 + 0.5)")}, '% descriptive') END,
    'found': CASE WHEN links = [] THEN [concat({_AT('<body')}, ':No internal links on the page')] WHEN content_links < 3 AND len(links) < 5 THEN [concat({_AT('<body')}, ':Fewer than 3 in-content internal links (and under 5 in total)')] ELSE [] END
      || list_transform(list_filter(range(1, len(anchors) + 1), lambda i: list_contains(links, anchors[i]) AND anchors[i].inside AND (length(anchors[i].text) < 2 OR anchors[i].text IN {_in(GENERIC_ANCHORS)})), lambda i: concat(link_lines[i], ':Generic anchor text "', CASE WHEN anchors[i].said = '' THEN '(empty)' ELSE anchors[i].said END, '" on an in-content link')),
    'fix': CASE WHEN links = [] OR (content_links < 3 AND len(links) < 5) OR generic_links > 0 THEN 'Add 3+ in-content links to related pages with descriptive anchor text, and replace generic anchors such as "read more" or "click here" with the target page topic.' ELSE '' END}},
  {{'check_id': 'content.quality', 'message': CASE WHEN words >= least AND NOT (paragraphs < 3 AND words > 200) AND words >= 50 THEN concat('Good content quality: ', words, ' words (', kind, ' page)') WHEN words >= bare THEN concat(words, ' words (', kind, ' page) - needs improvement') ELSE concat('Thin content: only ', words, ' words (', kind, ' page)') END,
    'found': {_told(("words < bare", "concat('Very thin content (', kind, ' page: under ', bare, ' words, aim for ', least, '+)')", _AT('<article')), ("words >= bare AND words < thin", "concat('Thin content (', kind, ' page: under ', thin, ' words, aim for ', least, '+)')", _AT('<article')), ("words >= thin AND words < least", "concat('Content could be more substantial (', kind, ' page: under ', least, ' words)')", _AT('<article')),
      ("paragraphs < 3 AND words > 200", _q("Poor paragraph structure (fewer than 3 paragraphs over 50 characters)"), _AT('<article')), ("words < 50", _q("Page has minimal content (under 50 words) - may be an empty shell or loading state"), _AT('<article')))},
    'fix': CASE WHEN words < least OR (paragraphs < 3 AND words > 200) OR words < 50 THEN concat('Expand the main content to at least ', least, ' words (', kind, ' page), split it into 3+ real <p> paragraphs, and wrap it in <main> or <article>.') ELSE '' END}}
], recursive := true) FROM (SELECT *, list_transform(regexp_extract_all(h, '(?s)<h[1-6][^>]*>.*?</h[1-6]>'), lambda x: trim(regexp_replace({_plain('x')}, '\s+', ' ', 'g'))) AS heads_said FROM lined))
SELECT page_id, check_id, message, array_to_string(found, ' | ') AS findings, fix AS recommendation FROM told"""
SQL["page_elements"] = rf"""WITH page AS (SELECT page_id, {AUGMENTED} AS h FROM pages),
bare AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(?:script|style|textarea|title)[^>]*>).*?</(?:script|style|textarea|title)>', '\1', 'g') AS h FROM page),
tags AS (SELECT page_id, lower(unnest(regexp_extract_all(h, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM bare)
SELECT tag, count(*) AS elements, count(DISTINCT page_id) AS pages FROM tags GROUP BY tag"""
SQL["page_sample"] = rf"""WITH links AS (SELECT DISTINCT ON (site_id, path) lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site_id, coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, page_id FROM pages ORDER BY page_id),
seen AS (SELECT l.site_id, l.path, min(p.page_id) AS seq, max(p.page_id % 3 = 0) AS nav FROM links l JOIN (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site_id, coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, page_id FROM pages) p USING (site_id, path) WHERE path <> '/' GROUP BY ALL),
parts AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM seen),
sections AS (SELECT site_id, p[1] AS section, bool_or(len(p) > 1) AS has_children, bool_or(nav) AS linked, min(seq) AS first FROM parts GROUP BY ALL),
picked AS (SELECT x.site_id, x.path, x.seq, x.nav, len(x.p) > 1 AS deep, s.* EXCLUDE (site_id) FROM parts x JOIN sections s ON s.site_id = x.site_id AND s.section = x.p[1]
  WHERE NOT s.has_children OR NOT EXISTS (SELECT 1 FROM parts y WHERE y.site_id = x.site_id AND y.p[1] = x.p[1] AND (len(y.p) > 1) = (len(x.p) > 1) AND (y.nav > x.nav OR (y.nav = x.nav AND y.seq < x.seq)))),
ranked AS (SELECT *, CASE WHEN has_children AND linked THEN 0 WHEN NOT has_children AND nav THEN 1 WHEN has_children THEN 2 ELSE 3 END AS bucket FROM picked),
kept AS (SELECT * FROM ranked QUALIFY has_children OR row_number() OVER (PARTITION BY site_id, has_children ORDER BY bucket, seq) <= 15)
SELECT site_id, path AS url_path, row_number() OVER (PARTITION BY site_id ORDER BY bucket, CASE WHEN has_children THEN (SELECT min(k.seq) FROM kept k WHERE k.site_id = kept.site_id AND k.section = kept.section) ELSE seq END, deep, seq, path)::INT AS place FROM kept QUALIFY place < 25"""
