"""Pages as flat element arrays.

`parsed` turns a column of HTML into an array of nodes in document order, as a nested set: node i's
subtree is the slice (i, end]. Text is kept as '#text' nodes and line ends as '#break' nodes, so every
notion of text is a filter over a slice, in expressions. Each node knows its innermost ancestor that
hides text, and that is boilerplate, so "visible from here" is one comparison.

The parse is tolerant and is not that of browsers: no elements are made up; raw-text elements end at
their own end tag or at the end of input; an implied end closes the current element only; an end tag
closes up to the nearest open element of its name, or nothing. A null page has no nodes, and of a page
only the first MAX_BYTES are read, as a crawler would.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.sources.author import AUTHOR, author_facts
from pagewarden.sources.batches import parts

#: Fixed value: bytes of a page that are read.
MAX_BYTES = 2 << 20
NODE = "struct<id:int,parent:int,end:int,tag:string,attrs:map<string,string>,line:int,text:string,hidden_by:int,boiler:int,nav:boolean>"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title".split())
DECODED = frozenset(("textarea", "title"))
BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "p": {"p"}}
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())
UNSEEN = frozenset("script style template noscript head title".split())
BOILER_TAGS = frozenset("nav header footer aside script style noscript iframe".split())
BOILER_CLASSES = frozenset("nav navigation menu sidebar header footer advertisement ad".split())
BOILER_ROLES = frozenset("navigation banner contentinfo".split())
#: The named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "times": "×", "deg": "°", "euro": "€", "pound": "£", "sect": "§", "para": "¶", "larr": "←", "rarr": "→"}

_TOKEN = re.compile(r"<!--|<(?=[!?])|</([A-Za-z][^\s/>]*)[^>]*>|<([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""\s*(?:(/?>)|([^\s=>/][^\s=>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|/)""")
_ENTITY = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|([A-Za-z]+));?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: The attributes of all nodes that have none; never written to.
_NO_ATTRS: dict[str, str] = {}


def decoded(text: str) -> str:
    """Numeric and known named entities, once; anything else stays."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


class _Page:
    def __init__(self, html: str) -> None:
        self.html, self.nodes, self.open = html, [], []
        self.marks: list[tuple[bool, bool]] = []  # of open elements: whether they hide text, and are boilerplate
        self.opened: Counter[str] = Counter()  # open elements by tag
        self.had: set[str] = set()
        self.breaks = [m.start() for m in re.finditer("\n", html)]
        self.line, self.seen = 1, 0

    def line_at(self, at: int) -> int:
        while self.seen < len(self.breaks) and self.breaks[self.seen] < at:
            self.seen += 1
        return 1 + self.seen

    def add(self, tag: str, attrs: dict | None = None, line: int | None = None, text: str | None = None) -> dict:
        up, at = self.open[-1] if self.open else None, len(self.nodes)
        node = {"id": at, "parent": -1, "end": at, "tag": tag, "attrs": attrs or _NO_ATTRS, "line": line, "text": text, "hidden_by": -1, "boiler": -1, "nav": False}
        if up:
            hides, skips = self.marks[-1]
            node["parent"], node["nav"] = up["id"], up["nav"]
            node["hidden_by"] = up["id"] if hides else up["hidden_by"]
            node["boiler"] = up["id"] if skips else up["boiler"]
        if attrs is not None:
            node["nav"] |= tag in ("nav", "header", "footer") or attrs.get("role", "") == "navigation"
        self.nodes.append(node)
        return node

    def enter(self, node: dict) -> None:
        tag, attrs = node["tag"], node["attrs"]
        hides = tag in UNSEEN or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_NO_DISPLAY.search(attrs.get("style", "")))
        skips = tag in BOILER_TAGS or attrs.get("role", "") in BOILER_ROLES or not BOILER_CLASSES.isdisjoint(attrs.get("class", "").split())
        self.open.append(node)
        self.marks.append((hides, skips))
        self.opened[tag] += 1

    def close(self) -> None:
        node = self.open.pop()
        self.marks.pop()
        self.opened[node["tag"]] -= 1
        node["end"] = len(self.nodes) - 1
        if node["tag"] in BLOCK:
            node["end"] += 1
            self.add("#break", text="\n")

    def text(self, text: str) -> None:
        if text:
            self.add("#text", text=text)

    def start(self, m: re.Match) -> int:
        """A start tag; where parsing goes on."""
        html, tag, at = self.html, m[2].lower(), m.end()
        attrs: dict[str, str] = {}
        ended = ""
        while not ended and (a := _ATTR.match(html, at)) and a.end() > at:
            at, ended = a.end(), a[1] or ""
            if a[2]:
                attrs.setdefault(a[2].lower(), decoded(next((v for v in (a[3], a[4], a[5]) if v is not None), "")))
        if not ended:
            at = len(html)
        if (tag == "html" and self.open) or (tag in ("head", "body") and tag in self.had):
            return at
        self.had.add(tag)
        if self.opened["head"] and tag not in IN_HEAD:
            while self.open[-1]["tag"] != "head":
                self.close()
            self.close()
        if self.open and (self.open[-1]["tag"] in CLOSES.get(tag, ()) or (tag in BLOCK and self.open[-1]["tag"] == "p")):
            self.close()
        node = self.add(tag, attrs, self.line_at(m.start()))
        if tag == "br":
            self.add("#break", text="\n")
        if tag in VOID or ended == "/>":
            return at
        self.enter(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            body = html[at : end.start() if end else len(html)]
            self.text(decoded(body) if tag in DECODED else body)
            self.close()
            return end.end() if end else len(html)
        return at

    def parse(self) -> list[dict]:
        html, at = self.html, 0
        while at < len(html):
            m = _TOKEN.search(html, at)
            self.text(decoded(html[at : m.start() if m else len(html)]))
            if not m:
                break
            if m[0] == "<!--":
                end = html.find("-->", m.end())
                at = end + 3 if end >= 0 else len(html)
            elif m[1]:
                at, tag = m.end(), m[1].lower()
                if self.opened[tag]:
                    while self.open[-1]["tag"] != tag:
                        self.close()
                    self.close()
            elif m[2]:
                at = self.start(m)
            else:
                end = html.find(">", m.end())
                at = end + 1 if end >= 0 else len(html)
        while self.open:
            self.close()
        return self.nodes


def parse(html: str | None) -> list[dict] | None:
    if html is None:
        return None
    if len(html) * 4 > MAX_BYTES:
        html = html.encode("utf-8", "replace")[:MAX_BYTES].decode("utf-8", "ignore")
    return _Page(html).parse()


def node_arrays(pages: list[list[dict] | None]) -> pa.Array:
    """Pages of nodes as one Arrow array of lists, built field by field."""
    ends = np.cumsum([0, *(0 if p is None else len(p) for p in pages)])
    flat = [n for p in pages if p is not None for n in p]
    whole = lambda key, kind: pa.array([n[key] for n in flat], kind)
    keys = [k for n in flat for k in n["attrs"]]
    values = [v for n in flat for v in n["attrs"].values()]
    sizes = np.cumsum([0, *(len(n["attrs"]) for n in flat)])
    attrs = pa.MapArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
    names = [x.split(":")[0] for x in NODE.removeprefix("struct<").replace("map<string,string>", "map").rstrip(">").split(",")]
    kinds = {"tag": pa.string(), "text": pa.string(), "nav": pa.bool_()}
    fields = [attrs if k == "attrs" else whole(k, kinds.get(k, pa.int32())) for k in names]
    nodes = pa.StructArray.from_arrays(fields, names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes, mask=pa.array([p is None for p in pages], pa.bool_()))


def _in_parts(pages: pa.Array) -> Iterator[tuple[int, int]]:
    return parts(np.asarray(pc.fill_null(pc.binary_length(pages), 0)))


def node_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The nodes of batches of pages, part by part."""
    for pages in batches:
        for a, b in _in_parts(pages):
            yield node_arrays([parse(x) for x in pages[a:b].to_pylist()])


def sent(html: Column) -> Column:
    """What a worker is sent of a page: its first MAX_BYTES characters, among which its first MAX_BYTES bytes are."""
    return F.substring(html, 1, MAX_BYTES)


def parsed(html: Column) -> Column:
    """HTML to its nodes; select it once, in a projection of its own."""
    return F.arrow_udf(node_parts, f"array<{NODE}>")(sent(html))


def _with_authors(pages: list[str | None], urls: list[str | None]) -> pa.Array:
    text, flag = pa.string(), pa.bool_()
    kinds = {"name": text, "method": text, "expertise": text, "trust": pa.list_(text), "meta_line": pa.int32(), "schema_line": pa.int32(), "bio_line": pa.int32()}
    names = [x.split(":")[0] for x in AUTHOR.removeprefix("struct<").rstrip(">").split(",")]
    found = [parse(x) for x in pages]
    facts = [author_facts(n, u) for n, u in zip(found, urls)]
    author = pa.StructArray.from_arrays([pa.array([f[k] for f in facts], kinds.get(k, flag)) for k in names], names)
    return pa.StructArray.from_arrays([node_arrays(found), author], ["nodes", "author"])


def page_parts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The nodes and authors of batches of pages and their URLs, part by part; a part's objects go before the next."""
    for pages, urls in batches:
        for a, b in _in_parts(pages):
            yield _with_authors(pages[a:b].to_pylist(), urls[a:b].to_pylist())


def parsed_page(html: Column, url: Column) -> Column:
    """struct(nodes, author): as `parsed`, and who wrote the page."""
    return F.arrow_udf(page_parts, f"struct<nodes:array<{NODE}>,author:{AUTHOR}>")(sent(html), url)
