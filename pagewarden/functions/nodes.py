"""Expressions over a page's nodes (sources.html): filters over one array, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def nodes() -> Column:
    return F.col("nodes")


#: The elements that most passes look for.
HEADS = ("html", "head", "title", "base", "meta", "link")
_DEALT: ContextVar[bool] = ContextVar("dealt", default=False)


@contextmanager
def dealt() -> Iterator[None]:
    """Expressions that are made inside read `elements` and `heads` (with_elements) in place of all nodes."""
    token = _DEALT.set(True)
    try:
        yield
    finally:
        _DEALT.reset(token)


def with_elements(pages: DataFrame) -> DataFrame:
    """Add elements (nodes that are no text) and heads (those of HEADS): checks pass over them hundreds of times."""
    pages = pages.select("*", F.filter(nodes(), lambda n: ~n["tag"].startswith("#")).alias("elements"))
    return pages.select("*", F.filter("elements", lambda n: n["tag"].isin(*HEADS)).alias("heads"))


def elements() -> Column:
    """An array that has all elements in document order; where nobody has dealt them out, text stands among them."""
    return F.col("elements") if _DEALT.get() else nodes()


def having(*tags: str, also: Callable[[Column], Column] | None = None) -> Column:
    """Nodes with one of the tags, in document order."""

    def test(n: Column) -> Column:
        found = n["tag"].isin(*tags)
        return found & also(n) if also else found

    return F.filter(F.col("heads") if _DEALT.get() and set(tags) <= set(HEADS) else elements(), test)


def first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def below(n: Column) -> Column:
    return F.slice(nodes(), n["id"] + 2, n["end"] - n["id"])


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: x["text"]), "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda would compute it again for each element it meets."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_content(n: Column) -> Column:
    """All text below a node, scripts included."""
    return bound(n, lambda m: _joined(F.filter(below(m), lambda x: x["tag"] == "#text")))


def visible_text(n: Column, skip_boilerplate: bool = False) -> Column:
    """Text below a node that is not hidden there, with line ends after blocks."""

    def said(m: Column) -> Column:
        def seen(x: Column) -> Column:
            keep = x["tag"].isin("#text", "#break") & (x["hidden_by"] <= m["id"])
            return keep & (x["boiler"] <= m["id"]) if skip_boilerplate else keep

        return _joined(F.filter(below(m), seen))

    return bound(n, said)


def meta(name: str) -> Column:
    """The first <meta> of a name, whatever its case."""
    return first(having("meta", also=lambda n: F.lower(n["attrs"]["name"]) == name))
