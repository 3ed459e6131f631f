"""Personal data in whole texts, also where it is disguised; spans always lie in the source text.

Base spans are found by four patterns in the text as it stands. Then transducers rewrite the text: code
points that look like ASCII ones become those, invisible ones go, bracketed and spelled at signs and dots
become signs, entities and percent codes their characters, spelled digits numerals. A rewriting keeps its
edits by their source offsets, so any span of the rewritten text maps back to one of the source, whatever
number of transducers stands between. The same patterns are searched in the rewritten text; a span found
there is added if the rewriting changed something inside it, if it stands at word boundaries of the
source, and if it is not a part of what the base has (it may contain a base span that the disguise cut).

Rules keep ordinary prose out: words for signs count only where a whole address is spelled, digits only in
runs of RUN spelled ones or more. Rewriting is tried only on texts that hold a mark of a disguise.

The scan is one map over the rows: nothing is shuffled. Every pattern takes time linear in a text. A null
text counts as empty: no spans. A null doc_id stays null. Repeated rows are scanned each. A very long text
is a unit of its own; its worker holds about thirty times its bytes. An empty table gives no rows. Columns
besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm._text import bounded_batches, texts, units

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]
Edit = tuple[int, int, str]

# Base patterns. Where the contract's expression would begin again inside a run that it has just failed
# on, these begin at the run, which gives the same matches in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+(?<=[0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern: from each at sign, the run of name characters before it, and its domain."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        first = at
        while first > done:  # in steps, so that a long text before the sign is not searched
            step = max(done, first - 64)
            own = _LOCAL.search(text, step, first)
            first = own.start()
            if first > step:
                break
        if first < at:
            yield first, m.end()
        done = m.end() if first < at else max(done, at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def luhn(digits: str) -> bool:
    own = [ord(c) - 48 for c in reversed(digits)]
    return (sum(own[::2]) + sum(d * 2 - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def spans_of(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, in code points; kinds as in KINDS."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if len(m[0]) >= 3 and 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(
    zip(
        "асԁеһіјкӏмոорԛѕтυνѵѡхуАВЕКМНОРСТХЅІЈУΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικορτıɑɡ",
        "acdehijklmnopqstuvvwxyABEKMHOPCTXSIJYABEZHIKMNOPTYXaikoptiag",
    )
)
DASHES, STOPS = "‐‑‒–—―−", "。"
#: Invisible: soft hyphen, zero-width space, joiners, marks of direction, word joiner, byte-order mark.
INVISIBLE = "­​‌‍‎‏⁠﻿"
#: Words for signs, in four languages.
AT_WORDS, SURE_AT_WORDS = ("at", "arroba", "arobase"), ("arroba", "arobase")
DOT_WORDS = ("dot", "punkt", "point", "punto")
#: Domain endings that end a spelled address; none is an ordinary word.
ENDINGS = ("com", "net", "org", "edu", "gov", "mil", "info", "biz", "io", "dev", "app", "eu", "uk", "de", "fr", "es", "ch", "nl", "se", "pl", "ca", "au", "jp", "br", "ru", "example", "test", "invalid", "local", "internal")
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
#: Spelled digits in a row that count as a number.
RUN = 3


def _plain_of() -> dict[int, str]:
    """Code points that stand for one printable ASCII character: lookalikes, dashes, and what compatibility forms and digits of all scripts say."""
    out = {ord(c): p for c, p in LOOKALIKES.items()} | {ord(c): "-" for c in DASHES} | {ord(c): "." for c in STOPS}
    for code in range(128, 0x20000):
        c = chr(code)
        if code in out or c in INVISIBLE or 0xD800 <= code < 0xE000:
            continue
        digit = unicodedata.decimal(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        plain = "." if plain in STOPS else plain
        if len(plain) == 1 and 32 <= ord(plain) < 127 and unicodedata.category(c) != "No":
            out[code] = plain
    return out


PLAIN = _plain_of()
_ODD = frozenset(map(chr, PLAIN)) | frozenset(INVISIBLE)
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")

_GAP = r"[\x20\t]{0,3}"
_SPACE = r"[\x20\t]{1,3}"
BRACKETED = re.compile(rf"(?i){_GAP}[\[({{<]{_GAP}(?:(?P<at>{'|'.join(AT_WORDS)}|@)|(?P<dot>{'|'.join(DOT_WORDS)}|\.)|(?P<dash>dash|hyphen|-)|(?P<line>underscore|_))(?:{_GAP})[\])}}>]{_GAP}")
CODED = re.compile(r"(?i)&(?:#(?P<code>0{0,4}\d{2,3})|#x(?P<hex>0{0,4}[2-7][0-9a-f])|(?P<at>commat)|(?P<dot>period));|%(?P<percent>40|2e)")
_LABEL = r"[A-Za-z0-9-]{1,63}"
_DOT = rf"(?:{_SPACE}(?:{'|'.join(DOT_WORDS)}){_SPACE}|\.)"
#: After a word for the at sign: a host with a spelled dot, or with any dot where the word is one of no other meaning.
SPELLED_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_SPACE}({'|'.join(AT_WORDS)}){_SPACE}(?={_LABEL}{_DOT})")
HOST = re.compile(rf"(?i){_LABEL}(?:{_DOT}{_LABEL}){{1,8}}")
_SPELLED_DOT = re.compile(rf"(?i){_SPACE}(?:{'|'.join(DOT_WORDS)}){_SPACE}")
#: Names before a spelled at sign: words with spelled dots between.
_NAME = re.compile(rf"(?i)[A-Za-z0-9._%+-]{{1,64}}(?:{_SPACE}(?:{'|'.join(DOT_WORDS)}){_SPACE}[A-Za-z0-9._%+-]{{1,64}}){{0,4}}\Z")
DOT_OF_NUMBERS = re.compile(rf"(?i)(?<=[0-9]){_SPACE}(?:{'|'.join(DOT_WORDS)}){_SPACE}(?=[0-9])")

_DIGITS = {w: str(d) for words in DIGIT_WORDS.values() for d, w in enumerate(words.split())}
_FIRST = "".join(sorted({c for w in _DIGITS for c in (w[0], w[0].upper())}))
_DIGIT = f"(?=[{_FIRST}])(?:" + "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w))) + ")"
#: Between spelled digits: a space or hyphen or two, a comma, or a spelled dot.
_BETWEEN = rf"(?:[\x20-]{{1,3}}|,\x20?|{_SPACE}(?:{'|'.join(DOT_WORDS)}){_SPACE})"
SPELLED_DIGITS = re.compile(rf"(?i)(?=[{_FIRST}pP])(?<!\w)(?P<plus>plus{_SPACE})?(?:{_DIGIT})(?:{_BETWEEN}(?:{_DIGIT}))+(?!\w)")
_ONE_DIGIT = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT})(?!\w)")
_MARKS = re.compile(rf"(?i)[\[({{<]{_GAP}(?:{'|'.join(AT_WORDS + DOT_WORDS)}|dash|hyphen|underscore|[@._-]){_GAP}[\])}}>]|&(?:#|commat;|period;)|%(?:40|2e)|(?<=[A-Za-z0-9]){_SPACE}(?:{'|'.join(DOT_WORDS)}){_SPACE}[A-Za-z0-9]")


class Rewritten:
    """A text and its edits: what stands at (start, end) of `plain` reads as one character or none. `plain` has the source's offsets."""

    def __init__(self, plain: str, edits: list[Edit]) -> None:
        self.plain, self.edits = plain, edits
        pieces, at = [], 0
        for s, e, put in edits:
            pieces += [plain[at:s], put]
            at = e
        self.text = "".join([*pieces, plain[at:]])
        self._start, self._end = (np.array([x[k] for x in edits], dtype=np.int64) for k in (0, 1))
        size = np.array([len(x[2]) for x in edits], dtype=np.int64)
        self._from = self._start + np.cumsum(np.concatenate([[0], size - (self._end - self._start)]))[:-1]
        self._to = self._from + size

    def start(self, at: int) -> int:
        """Where the source has what the text has at an offset."""
        k = int(np.searchsorted(self._from, at, "right")) - 1
        if k < 0:
            return at
        return int(self._start[k] if at < self._to[k] else at - self._to[k] + self._end[k])

    def end(self, at: int) -> int:
        """Where the source has the end of what the text has before an offset."""
        k = int(np.searchsorted(self._from, at - 1, "right")) - 1
        if k < 0:
            return at
        return int(self._end[k] if at - 1 < self._to[k] else at - self._to[k] + self._end[k])

    def then(self, edits: list[Edit]) -> Rewritten:
        """With further edits, in order, at offsets of the text; those inside them are replaced."""
        if not edits:
            return self
        new = [(self.start(s), self.end(e), put) for s, e, put in edits]
        starts, ends = np.array([s for s, _, _ in new]), np.array([e for _, e, _ in new])
        k = np.searchsorted(starts, self._start, "right") - 1
        inside = (k >= 0) & (self._end <= ends[k])
        return Rewritten(self.plain, sorted(new + [x for x, drop in zip(self.edits, inside.tolist()) if not drop], key=lambda x: x[:2]))


def _visible(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "") for m in _INVISIBLE.finditer(text)]


def _code_edits(text: str) -> list[Edit]:
    out = []
    for m in CODED.finditer(text):
        code = int(m["code"]) if m["code"] else int(m["hex"] or m["percent"] or ("40" if m["at"] else "2e"), 16)
        if 32 <= code < 127:
            out.append((m.start(), m.end(), chr(code)))
    return out


def _bracket_edits(text: str) -> list[Edit]:
    signs = {"at": "@", "dot": ".", "dash": "-", "line": "_"}
    return [(m.start(), m.end(), signs[m.lastgroup]) for m in BRACKETED.finditer(text)]


def _digit_edits(text: str) -> list[Edit]:
    """Runs of spelled digits, joined; their spelled dots as dots, and a plus before them as its sign."""
    out = []
    for m in SPELLED_DIGITS.finditer(text):
        found = list(_ONE_DIGIT.finditer(text, m.start(), m.end()))
        if len(found) < RUN:
            continue
        if m["plus"]:
            out.append((m.start(), m.start() + len(m["plus"]), "+"))
        for k, d in enumerate(found):
            if k:
                out.append((found[k - 1].end(), d.start(), "." if _SPELLED_DOT.fullmatch(text, found[k - 1].end(), d.start()) else ""))
            out.append((d.start(), d.end(), _DIGITS[d[0].lower()]))
    return out


def _sign_edits(text: str) -> list[Edit]:
    """Spelled signs of whole addresses, and spelled dots between numerals."""
    out: list[Edit] = []
    for m in SPELLED_AT.finditer(text):
        host = HOST.match(text, m.end())
        if host is None:  # a sentence ends at the dot
            continue
        dots = list(_SPELLED_DOT.finditer(text, host.start(), host.end()))
        sure = m[1].lower() in SURE_AT_WORDS
        labels = re.split(r"(?i)" + _DOT, host[0])
        known = [k for k, x in enumerate(labels) if k and (x.lower() in ENDINGS or sure and len(x) > 1 and x.isalpha())]
        if not known or not (sure or dots):
            continue
        last = host.end() if known[-1] == len(labels) - 1 else [x.start() for x in re.finditer(r"(?i)" + _DOT, host[0])][known[-1]] + host.start()
        dots = [d for d in dots if d.end() <= last]
        if not (sure or dots):
            continue
        name = _NAME.search(text, max(0, m.start() - 340), m.start())
        out += [(d.start(), d.end(), ".") for d in _SPELLED_DOT.finditer(text, name.start(), m.start())] if name else []
        out += [(m.start(), m.end(), "@"), *((d.start(), d.end(), ".") for d in dots)]
    out += [(m.start(), m.end(), ".") for m in DOT_OF_NUMBERS.finditer(text)]
    # After a real or bracketed at sign, a spelled dot before a known ending.
    for m in re.finditer(rf"(?i)@{_LABEL}(?:{_DOT}{_LABEL}){{1,8}}", text) if "@" in text else ():
        dots = list(_SPELLED_DOT.finditer(text, m.start(), m.end()))
        ended = [k for k, d in enumerate(dots) if re.compile(_LABEL).match(text, d.end())[0].lower() in ENDINGS]
        out += [(d.start(), d.end(), ".") for d in dots[: ended[-1] + 1]] if ended else []
    clean: list[Edit] = []
    for x in sorted(set(out)):
        if not clean or x[0] >= clean[-1][1]:
            clean.append(x)
    return clean


TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (_code_edits, _bracket_edits, _digit_edits, _sign_edits)


def rewritten(text: str) -> Rewritten | None:
    """The text through all transducers; None where it shows no disguise."""
    odd = not text.isascii() and not _ODD.isdisjoint(set(text))
    plain = text.translate(PLAIN) if odd else text
    spelled = [m for m in SPELLED_DIGITS.finditer(plain) if len(_ONE_DIGIT.findall(m[0])) >= RUN]
    if not odd and not spelled and not _MARKS.search(plain) and not any(w in plain.lower() for w in SURE_AT_WORDS):
        return None
    out = Rewritten(plain, _visible(plain) if odd else [])
    for step in TRANSDUCERS:
        out = out.then(step(out.text))
    return out


def _worded(text: str, at: int) -> bool:
    """Whether a word goes across an offset."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def added_spans(text: str, base: list[Span]) -> list[tuple[Span, str]]:
    """Spans that only the rewritten text has, at their place in the source, and how they read there."""
    re_ = rewritten(text)
    if re_ is None or (re_.text == text):
        return []
    by_kind: dict[int, list[tuple[int, int]]] = {}
    for k, s, e in base:
        by_kind.setdefault(k, []).append((s, e))
    out = []
    for kind, s, e in spans_of(re_.text):
        start, end, reads = re_.start(s), re_.end(e), re_.text[s:e]
        if text[start:end] == reads or _worded(text, start) or _worded(text, end):
            continue
        if kind == 0 and not reads.rpartition(".")[2].strip("-").isalpha():
            continue
        own = by_kind.get(kind, ())
        k = np.searchsorted([x[1] for x in own], start, "right") if own else 0
        met = [x for x in own[k:] if x[0] < end] if own else []
        # What the base has stays as it is, unless an edit within the span continues it.
        if any(x[0] < start or x[1] > end for x in met) or any(text[x[1] : x[1] + 1] in STOPS for x in met if x[1] < end):
            continue
        out.append(((kind, start, end), reads))
    return out


def said(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def scan(text: str) -> tuple[list[Span], list[tuple[Span, str]]]:
    """Base spans, and added ones with how they read without their disguise."""
    base = spans_of(text)
    base.sort(key=lambda x: (x[1], x[0]))
    return base, added_spans(text, base)


PERSONAL_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, added string"


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, digest of base spans, all spans, and added ones as kind:start:end=reading, by line."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            found = [scan(t.as_py()) for t in texts(unit)]
            n = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in range(len(KINDS))]
            digest = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found]
            spans = [said({*base, *(x for x, _ in more)}) for base, more in found]
            reads = ["\n".join(f"{said([x])}={r}" for x, r in sorted(more, key=lambda m: m[0][1])) for _, more in found]
            yield pa.RecordBatch.from_arrays([unit.column("doc_id"), *(pa.array(c, pa.int64()) for c in n), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array([len(more) for _, more in found], pa.int64()), pa.array(reads, pa.string())], [x.split()[0] for x in PERSONAL_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PERSONAL_SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind, as [email]; overlapping spans become one, of the first's kind."""
    bounded_batches(docs.sparkSession)

    def clean(text: str) -> str:
        base, more = scan(text)
        out, at = [], 0
        for k, s, e in sorted([*base, *(x for x, _ in more)], key=lambda x: (x[1], -x[2], x[0])):
            if s >= at:
                out += [text[at:s], f"[{KINDS[k]}]"]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            where = unit.schema.get_field_index("text")
            own = [None if t is None else clean(t) for t in unit.column(where).to_pylist()]
            yield unit.set_column(where, "text", pa.array(own, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
