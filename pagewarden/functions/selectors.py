"""CSS selectors as expressions over a page's nodes: read once, when a plan is built.

Lists, descendants, children, siblings (+ and ~), tags, #id, .class, [attribute] with =, ~=, |=, ^=, $= and
*= and the flag i, :not(), :first-child and :last-child. All else is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.functions.nodes import first, nodes

Test = Callable[[Column], Column]
_NAME = re.compile(r"[A-Za-z0-9_-]+")
_ATTRIBUTE = re.compile(r"""\s*([A-Za-z0-9_:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]]+)))?\s*([isIS])?\s*""")


@dataclass
class Simple:
    """What one element must have."""

    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attributes: list[tuple[str, str | None, str, bool]] = field(default_factory=list)
    nots: list[list] = field(default_factory=list)
    places: list[str] = field(default_factory=list)


def _closing(s: str, at: int) -> int:
    """Where the bracket that opens at `at` closes; quoted text aside."""
    pairs, depth, quote = {"[": "]", "(": ")"}, 0, ""
    for i in range(at, len(s)):
        c = s[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == s[at]:
            depth += 1
        elif c == pairs[s[at]]:
            depth -= 1
            if not depth:
                return i
    raise ValueError(f"unbalanced selector: {s}")


def _simple(s: str, at: int) -> tuple[Simple, int]:
    out = Simple()

    def name(i: int) -> tuple[str, int]:
        m = _NAME.match(s, i)
        if not m:
            raise ValueError(f"unsupported selector: {s}")
        return m[0], m.end()

    while at < len(s) and s[at] not in " \t\n>+~,":
        c = s[at]
        if c == "*":
            at += 1
        elif c in "#.":
            found, at = name(at + 1)
            (out.ids if c == "#" else out.classes).append(found)
        elif c == "[":
            end = _closing(s, at)
            m = _ATTRIBUTE.fullmatch(s[at + 1 : end])
            if not m:
                raise ValueError(f"unsupported attribute: {s[at : end + 1]}")
            out.attributes.append((m[1].lower(), m[2], next((x for x in m.group(3, 4, 5) if x is not None), ""), (m[6] or "").lower() == "i"))
            at = end + 1
        elif c == ":":
            found, at = name(at + 1)
            if found.lower() == "not" and s[at : at + 1] == "(":
                end = _closing(s, at)
                out.nots.append(read(s[at + 1 : end]))
                at = end + 1
            elif found.lower() in ("first-child", "last-child"):
                out.places.append(found.lower())
            else:
                raise ValueError(f"unsupported: :{found}")
        else:
            found, at = name(at)
            out.tag = found.lower()
    return out, at


def read(selector: str) -> list[list[tuple[str, Simple]]]:
    """Alternatives of steps (combinator, element), left to right; the first step's combinator is ''."""
    out, at, steps, combinator = [], 0, [], ""
    s = selector.strip()
    while at < len(s):
        if s[at] in " \t\n":
            combinator = combinator or (" " if steps else "")
            at += 1
        elif s[at] in ">+~":
            combinator, at = s[at], at + 1
        elif s[at] == ",":
            out.append(steps)
            steps, combinator, at = [], "", at + 1
        else:
            one, at = _simple(s, at)
            steps.append((combinator or (" " if steps else ""), one))
            combinator = ""
    out.append(steps)
    if any(not x for x in out):
        raise ValueError(f"empty selector: {selector}")
    return out


def attribute_test(n: Column, name: str, op: str | None, want: str, either_case: bool) -> Column:
    """Whether an element's attribute is there, and is, has or begins, ends or goes on with what is wanted."""
    own = n["attrs"][name]
    if op is None:
        return own.isNotNull()
    if op in ("^=", "$=", "*=") and not want:
        return F.lit(False)
    v, w = (F.lower(own), want.lower()) if either_case else (own, want)
    tests = {
        "=": lambda: v == w,
        "~=": lambda: F.array_contains(F.split(v, r"\s+"), w),
        "|=": lambda: (v == w) | v.startswith(w + "-"),
        "^=": lambda: v.startswith(w),
        "$=": lambda: v.endswith(w),
        "*=": lambda: v.contains(w),
    }
    return F.coalesce(tests[op](), F.lit(False))


def _element(n: Column) -> Column:
    return ~n["tag"].startswith("#")


def _beside(n: Column, after: bool) -> Column:
    """Elements of the same parent after or before a node, in order."""
    side = lambda x: (x["id"] > n["id"]) if after else (x["id"] < n["id"])
    return F.filter(nodes(), lambda x: _element(x) & (x["parent"] == n["parent"]) & side(x))


def _fits(n: Column, one: Simple) -> Column:
    test = _element(n)
    if one.tag:
        test = test & (n["tag"] == one.tag)
    for i in one.ids:
        test = test & F.coalesce(n["attrs"]["id"] == i, F.lit(False))
    for c in one.classes:
        test = test & F.coalesce(F.array_contains(F.split(n["attrs"]["class"], r"\s+"), c), F.lit(False))
    for a in one.attributes:
        test = test & attribute_test(n, *a)
    for alternatives in one.nots:
        test = test & ~_matches(n, alternatives)
    for place in one.places:
        test = test & (F.size(_beside(n, place == "last-child")) == 0)
    return test


def _steps(n: Column, steps: list[tuple[str, Simple]]) -> Column:
    combinator, one = steps[-1]
    test = _fits(n, one)
    if len(steps) == 1:
        return test
    before = lambda x: _steps(x, steps[:-1])
    if combinator == ">":
        return test & F.exists(nodes(), lambda x: (x["id"] == n["parent"]) & before(x))
    if combinator == "+":
        return test & F.coalesce(F.exists(F.slice(_beside(n, False), -1, 1), before), F.lit(False))
    if combinator == "~":
        return test & F.exists(_beside(n, False), before)
    return test & F.exists(nodes(), lambda x: (x["id"] < n["id"]) & (n["id"] <= x["end"]) & before(x))


def _matches(n: Column, alternatives: list) -> Column:
    out = F.lit(False)
    for steps in alternatives:
        out = out | _steps(n, steps)
    return out


def matches(selector: str) -> Test:
    """A test of nodes."""
    alternatives = read(selector)
    return lambda n: _matches(n, alternatives)


def select_all(selector: str) -> Column:
    """The nodes that match, in document order."""
    return F.filter(nodes(), matches(selector))


def select_first(selector: str) -> Column:
    return first(select_all(selector))


def closest(n: Column, selector: str) -> Column:
    """A node itself or its nearest ancestor that matches, or null."""
    fits = matches(selector)
    return F.try_element_at(F.filter(nodes(), lambda x: (x["id"] <= n["id"]) & (n["id"] <= x["end"]) & fits(x)), F.lit(-1))


def visible_questions() -> Column:
    """Texts of headings, summaries and terms that end with a question mark."""
    from pagewarden.functions.nodes import text_content
    from pagewarden.functions.text import collapsed

    said = F.transform(select_all("h2, h3, h4, h5, summary, dt"), lambda n: collapsed(text_content(n)))
    return F.filter(said, lambda t: t.endswith("?"))


def serialised(n: Column, most: int = 120) -> Column:
    """The start tag of a node as HTML, cut at `most` characters."""
    said = F.array_join(F.transform(F.map_entries(n["attrs"]), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), F.replace(a["value"], F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    return F.substring(F.concat(F.lit("<"), n["tag"], said, F.lit(">")), 1, most)
