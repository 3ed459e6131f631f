"""JSON-LD blocks as a page's structured data: typed nodes, and what each lacks.

`structured_data` reads all blocks of a page at once, as references reach across blocks. Every object with
a @type is a node, at any depth up to MAX_DEPTH. A lone {"@id": x} stands for the last node with that
id. A typed node whose id another node defines with more keys is a reference and is not validated.
A block with template tags that does not parse is read again with its output tags as placeholders;
where that fails too it counts as unresolved, not as broken.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.sources.batches import parts

NODE = "struct<types:array<string>,kind:string,reference:boolean,valid:boolean,named:boolean,issues:array<string>,line:int,primary:boolean>"
RESULT = (
    "struct<blocks:int,parsed:int,broken:int,unresolved:int,published:boolean,modified:boolean,published_line:int,modified_line:int,dates_templated:boolean,"
    f"templated:boolean,first_line:int,broken_lines:array<int>,unresolved_lines:array<int>,top:array<string>,nodes:array<{NODE}>>"
)
MAX_DEPTH = 12
PLACEHOLDER = "__template__"

#: Schema.org types by the validator that they share.
LOCAL_BUSINESS = ("LocalBusiness", "Restaurant", "Store", "MedicalBusiness", "LegalService", "FinancialService", "FoodEstablishment", "HealthAndBeautyBusiness", "HomeAndConstructionBusiness", "EntertainmentBusiness", "AutomotiveBusiness")
ORGANIZATIONS = ("Organization", *LOCAL_BUSINESS, "Corporation", "GovernmentOrganization", "EducationalOrganization", "MedicalOrganization", "NGO", "Airline")
ARTICLES = ("Article", "BlogPosting", "NewsArticle", "TechArticle")
KINDS = {t: t for t in ("FAQPage", "HowTo", "Product", "Person", "BreadcrumbList", "ItemList", "VideoObject", "Dataset")} | dict.fromkeys(ORGANIZATIONS, "Organization") | dict.fromkeys(ARTICLES, "Article")

_TAG = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|<\?.*?\?>", re.S)
_DATE = re.compile(r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?")


def _is_output(tag: str) -> bool:
    return tag.startswith(("{{", "<%=", "<%-", "<?=")) or bool(re.match(r"<\?(php)?\s*echo\b", tag))


def _filled(text: str) -> str:
    """Template tags out of the text: a placeholder for output, quoted where no string is open."""
    out, at, quoted = [], 0, False
    for m in _TAG.finditer(text):
        piece = text[at : m.start()]
        quoted ^= len(re.findall(r'(?<!\\)(?:\\\\)*"', piece)) % 2 == 1
        out.append(piece)
        if _is_output(m[0]):
            out.append(PLACEHOLDER if quoted else f'"{PLACEHOLDER}"')
        at = m.end()
    return "".join(out) + text[at:]


def read_block(text: str) -> tuple[Any, str]:
    """The data of a block, and 'parsed', 'broken' or 'unresolved'."""
    text = (text or "").strip()
    tagged = bool(_TAG.search(text))
    for attempt in ([_filled(text)] if tagged else []) + [text]:
        try:
            data = json.loads(attempt)
        except (ValueError, RecursionError):
            continue
        return (data, "parsed") if isinstance(data, (dict, list)) or data else (None, "broken")
    return None, "unresolved" if tagged else "broken"


def types_of(node: dict) -> list[str]:
    named = node.get("@type")
    return [re.sub(r"^https?://schema\.org/", "", t) for t in (named if isinstance(named, list) else [named]) if isinstance(t, str)]


#: Where a block's own nodes stand: at its top, in a list there, or in its graph.
PRIMARY = ((), ("[]",), ("@graph", "[]"))


def typed_nodes(data: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[dict, tuple[str, ...]]]:
    """Objects with a type, each with its path from the block."""
    if len(path) > MAX_DEPTH:
        return
    if isinstance(data, list):
        for x in data:
            yield from typed_nodes(x, (*path, "[]"))
    elif isinstance(data, dict):
        if data.get("@type"):
            yield data, path
        for k, v in data.items():
            if k != "@context" and isinstance(v, (dict, list)):
                yield from typed_nodes(v, (*path, k))


def resolver(nodes: list[dict]) -> Callable[[Any], Any]:
    """A function that gives the node for a lone reference, and all else as it is."""
    by_id = {n["@id"]: n for n in nodes if isinstance(n.get("@id"), str)}
    return lambda x: by_id.get(x["@id"], x) if isinstance(x, dict) and len(x) == 1 and isinstance(x.get("@id"), str) else x


def top_types(data: Any, depth: int = 0) -> list[str]:
    """Types of nodes at most two steps below the block."""
    if depth > 2 or not isinstance(data, (dict, list)):
        return []
    own = types_of(data) if isinstance(data, dict) and data.get("@type") else []
    below = data if isinstance(data, list) else [v for k, v in data.items() if k != "@context"]
    return own + [t for x in below for t in top_types(x, depth + 1)]


def states(data: Any, key: str, depth: int = 0) -> bool:
    """Whether an object at any depth up to 20 has the property, with a value that says something."""
    if depth > 20 or not isinstance(data, (dict, list)):
        return False
    if isinstance(data, dict) and _filled_in(data.get(key)):
        return True
    return any(states(x, key, depth + 1) for x in (data.values() if isinstance(data, dict) else data))


def _filled_in(x: Any) -> bool:
    """Whether a value says something: objects and lists do, even empty ones."""
    return isinstance(x, (dict, list)) or bool(x)


def is_date(value: Any) -> bool:
    if not isinstance(value, str):
        return False
    if PLACEHOLDER in value:
        return True
    m = _DATE.fullmatch(value.strip())
    try:
        return bool(m) and bool(date.fromisoformat(m[1])) and int(m[2] or 0) < 25 and int(m[3] or 0) < 60 and int(m[4] or 0) < 60
    except ValueError:
        return False


class Validator:
    """What a node of a kind lacks; `at` follows lone references."""

    def __init__(self, nodes: list[dict]) -> None:
        self.at = resolver(nodes)

    def _each(self, x: Any) -> list:
        return [self.at(i) for i in x] if isinstance(x, list) else [self.at(x)]

    def issues(self, kind: str, node: dict) -> list[str]:
        check: Callable[[dict], list[str]] | None = getattr(self, f"_{kind.lower()}", None)
        lacks = [f"Missing required field: {k}" for k in REQUIRED.get(kind, ()) if not _filled_in(node.get(k))]
        return lacks + (check(node) if check else [])

    def _faqpage(self, node: dict) -> list[str]:
        asked = node.get("mainEntity")
        if not isinstance(asked, list):
            return ["Missing or invalid mainEntity array"]
        out = []
        for i, q in enumerate(self._each(asked)):
            q = q if isinstance(q, dict) else {}
            answers = [a for a in self._each(q.get("acceptedAnswer")) if isinstance(a, dict)]
            lacks = {
                f"Item {i}: Not a Question type": "Question" not in types_of(q),
                f'Question {i}: Missing "name" (question text)': not q.get("name"),
                f"Question {i}: Missing acceptedAnswer": not answers,
                f"Question {i}: acceptedAnswer is not Answer type": bool(answers) and "Answer" not in types_of(answers[0]),
                f"Question {i}: acceptedAnswer missing text": bool(answers) and not answers[0].get("text"),
            }
            out += [said for said, fails in lacks.items() if fails]
        return out

    def _howto(self, node: dict) -> list[str]:
        lacks = [] if _filled_in(node.get("name")) else ['Missing "name" field']
        if not isinstance(node.get("step"), list):
            return [*lacks, 'Missing or invalid "step" array']
        rows: list[tuple[str, dict]] = []
        for i, s in enumerate(self._each(node["step"])):
            s = s if isinstance(s, dict) else {}
            inner = s.get("itemListElement")
            if "HowToSection" not in types_of(s):
                rows.append((str(i), s))
            elif isinstance(inner, list) and inner:
                rows += [(f"{i}.{j}", x if isinstance(x, dict) else {}) for j, x in enumerate(self._each(inner))]
            else:
                lacks.append(f"Step {i}: HowToSection has no itemListElement steps")
        lacks += [] if len(rows) > 1 else ["HowTo should have at least 2 steps"]
        for at, s in rows:
            lacks += [] if "HowToStep" in types_of(s) else [f"Step {at}: Not a HowToStep type"]
            lacks += [] if s.get("text") or s.get("name") else [f"Step {at}: Missing text or name"]
        return lacks

    def _product(self, node: dict) -> list[str]:
        out = []
        offers = self._each(node["offers"]) if _filled_in(node.get("offers")) else []
        if not offers:
            out.append("Missing offers (price information)")
        for i, o in enumerate(offers):
            o, which = o if isinstance(o, dict) else {}, f"Offer[{i}]: " if len(offers) > 1 else ""
            priced = any(o.get(k) or (k == "price" and o.get(k) == 0 and o.get(k) is not False) for k in ("price", "lowPrice", "priceRange"))
            out += [] if priced else [f"{which}Missing price or priceRange"]
            out += [] if o.get("priceCurrency") else [f"{which}Missing priceCurrency"]
        rating = self.at(node.get("aggregateRating"))
        if isinstance(rating, dict) and not rating.get("ratingValue") and (rating.get("ratingValue") != 0 or rating.get("ratingValue") is False):
            out.append("AggregateRating missing ratingValue")
        return out

    def _article(self, node: dict) -> list[str]:
        author = self._each(node["author"])[:1] if _filled_in(node.get("author")) else None
        date = node.get("datePublished")
        lacks = {
            "Missing required field: author": author is None,
            "Author missing name property": bool(author) and isinstance(author[0], dict) and not author[0].get("name"),
            "Missing required field: datePublished": not _filled_in(date),
            "datePublished is not valid ISO 8601 format": _filled_in(date) and not is_date(date),
        }
        return [said for said, fails in lacks.items() if fails]

    def _breadcrumblist(self, node: dict) -> list[str]:
        if not isinstance(node.get("itemListElement"), list):
            return ["Missing or invalid itemListElement array"]
        out = []
        for i, x in enumerate(self._each(node["itemListElement"])):
            x = x if isinstance(x, dict) else {}
            item = self.at(x.get("item"))
            out += [] if x.get("position") else [f"Item[{i}]: Missing position"]
            out += [] if x.get("name") or (isinstance(item, dict) and item.get("name")) else [f"Item[{i}]: Missing name"]
        return out

    def _itemlist(self, node: dict) -> list[str]:
        return [] if isinstance(node.get("itemListElement"), list) else ["Missing or invalid itemListElement array"]

    def _videoobject(self, node: dict) -> list[str]:
        date = node.get("uploadDate")
        return [] if is_date(date) else ["uploadDate is not valid ISO 8601 format" if _filled_in(date) else "Missing required field: uploadDate"]


#: The properties that a kind must have, beyond what has a check of its own.
REQUIRED = {
    "Product": ("name", "image", "description"),
    "Organization": ("name",),
    "Article": ("headline",),
    "Person": ("name",),
    "VideoObject": ("name", "description", "thumbnailUrl"),
    "Dataset": ("name", "description"),
}


def page_data(texts: list[str] | None, lines: list[int] | None = None) -> dict[str, Any]:
    """RESULT of a page's blocks; lines: where each begins."""
    texts = list(texts) if texts is not None else []
    lines = [int(x) for x in lines] if lines is not None else [1] * len(texts)
    blocks = [(text, line, *read_block(text), bool(_TAG.search(text or ""))) for text, line in zip(texts, lines)]
    how = [s for _, _, _, s, _ in blocks]

    def stated(key: str) -> tuple[int | None, bool]:
        """(line, templated) of the first block that states a date; in one that template tags keep from parsing, the name is enough."""
        for test in (lambda t, d, s: s == "parsed" and states(d, key), lambda t, d, s: s == "unresolved" and f'"{key}"' in t):
            for text, line, data, s, tagged in blocks:
                if test(text, data, s):
                    return line, tagged
        return None, False

    published, modified = stated("datePublished"), stated("dateModified")
    nodes = [(n, path, line) for _, line, data, s, _ in blocks if s == "parsed" for n, path in typed_nodes(data)]
    most: dict[str, int] = {}
    for n, _, _ in nodes:
        if isinstance(n.get("@id"), str):
            most[n["@id"]] = max(most.get(n["@id"], 0), len(n))
    validator, out = Validator([n for n, _, _ in nodes]), []
    for n, path, line in nodes:
        types = types_of(n)
        by_kind: dict[str | None, list[str]] = {}
        for t in types:
            by_kind.setdefault(KINDS.get(t), []).append(t)
        reference = len(n) < most.get(n.get("@id") if isinstance(n.get("@id"), str) else "", 0)
        for kind, own in by_kind.items():
            issues = validator.issues(kind, n) if kind and not reference else []
            out.append({"types": own, "kind": kind, "reference": reference, "valid": None if reference or not kind else not issues, "named": bool(n.get("name") or n.get("url")), "issues": issues, "line": line, "primary": path in PRIMARY})
    return {
        "blocks": len(blocks), "parsed": how.count("parsed"), "broken": how.count("broken"), "unresolved": how.count("unresolved"), "published": published[0] is not None, "modified": modified[0] is not None,
        "published_line": published[0], "modified_line": modified[0], "dates_templated": published[1] or modified[1], "templated": any(tagged and s == "parsed" for _, _, _, s, tagged in blocks),
        "first_line": next((line for _, line, _, s, _ in blocks if s == "parsed"), None), "broken_lines": [line for _, line, _, s, _ in blocks if s == "broken"], "unresolved_lines": [line for _, line, _, s, _ in blocks if s == "unresolved"],
        "top": [t for _, _, data, s, _ in blocks if s == "parsed" for t in top_types(data)], "nodes": out,
    }


def data_parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """What `page_data` says of batches of block texts and their lines, part by part."""
    names = [x.split(":")[0] for x in RESULT.removeprefix("struct<").split("nodes:")[0].rstrip(",").split(",")] + ["nodes"]
    for texts, at in batches:
        sizes = np.array([0 if x is None else sum(len(t) for t in x) for x in texts], dtype=np.int64)
        for a, b in parts(sizes):
            out = pd.DataFrame([page_data(x, y) for x, y in zip(texts[a:b], at[a:b])], columns=names)
            for c in ("published_line", "modified_line", "first_line"):
                out[c] = out[c].astype("Int32")
            yield out
            del out


def structured_data(blocks: Column, lines: Column) -> Column:
    """Arrays of block texts and their lines to RESULT; a null array has no blocks."""
    return F.pandas_udf(data_parts, RESULT)(blocks, lines)
