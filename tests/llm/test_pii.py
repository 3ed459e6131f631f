import hashlib
import re
import time

import numpy as np
import pytest

from pagewarden.llm import pii


def brute_base(text):
    """The contract's patterns as they are."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def checked(s):
        total = 0
        for k, c in enumerate(reversed(digits(s))):
            d = int(c) * (1 + k % 2)
            total += d - 9 if d > 9 else d
        return 14 <= len(digits(s)) <= 19 and total % 10 == 0

    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if checked(m[0])]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


BITS = ["a", "b.c", "@", "@@", ".", "..", "-", "+", "1", "23", "256", "001", "4111 1111 1111 1111", "4111-1111", "x@y.z", "+1 (555) 010-9999", " ", "  ", "%", "10.0.0.1", "é", "Ü@ü.com", "\n", "(", "+4", "9.9.9.9.9", "49927398716"]


def test_base_spans_match_the_patterns():
    r = np.random.default_rng(3)
    for _ in range(4000):
        text = "".join(BITS[i] for i in r.integers(0, len(BITS), r.integers(1, 14)))
        assert sorted(pii.spans_of(text)) == brute_base(text), text


SHOWN = [
    ("mail john (at) example (dot) com today", "email", "john (at) example (dot) com", "john@example.com"),
    ("JOHN.DOE [AT] mail [DOT] example [DOT] org", "email", "JOHN.DOE [AT] mail [DOT] example [DOT] org", "JOHN.DOE@mail.example.org"),
    ("write to jane dot doe at example dot com now", "email", "jane dot doe at example dot com", "jane.doe@example.com"),
    ("an bob Arroba correo punto es escribir", "email", "bob Arroba correo punto es", "bob@correo.es"),
    ("bob@example dot com", "email", "bob@example dot com", "bob@example.com"),
    ("see a@mail.example[.]com!", "email", "a@mail.example[.]com", "a@mail.example.com"),
    ("(jоhn@exаmple.com)", "email", "jоhn@exаmple.com", "john@example.com"),
    ("ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ", "bob@example.com"),
    ("bob&#64;example&#x2e;com or bob", "email", "bob&#64;example&#x2e;com", "bob@example.com"),
    ("mailto:bob%40example.com", "email", "bob%40example.com", "bob@example.com"),
    ("b​ob@exam­ple.com", "email", "b​ob@exam­ple.com", "bob@example.com"),
    ("plus one five five five zero one two three four five six.", "phone", "plus one five five five zero one two three four five six", "+15550123456"),
    ("Tel. +49 eins fünf eins zwei 3456 7890", "phone", "+49 eins fünf eins zwei 3456 7890", "+49 1512 3456 7890"),
    ("+49–1512–345678", "phone", "+49–1512–345678", "+49-1512-345678"),
    ("at one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one", "192.168.1.1"),
    ("host 10 dot 0 dot 0 dot 7", "ip", "10 dot 0 dot 0 dot 7", "10.0.0.7"),
    ("host 10[.]0[.]0[.]8", "ip", "10[.]0[.]0[.]8", "10.0.0.8"),
    ("٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١", "4111 1111 1111 1111"),
    ("four one one one, one one one one, one one one one, one one one one", "card", "four one one one, one one one one, one one one one, one one one one", "4111111111111111"),
    ("4111 1111 1111 1111", "card", "4111 1111 1111 1111", "4111 1111 1111 1111"),
]


@pytest.mark.parametrize("text, kind, source, reads", SHOWN)
def test_disguises_map_back_to_the_source(text, kind, source, reads):
    _, added = pii.scan(text)
    assert [(pii.KINDS[k], text[s:e], r) for (k, s, e), r in added] == [(kind, source, reads)]
    for before in ("x", "é 日", "​ "):  # whatever edits come before
        moved = f"{before} (dot) one two three, then {text}"
        assert (kind, source, reads) in [(pii.KINDS[k], moved[s:e], r) for (k, s, e), r in pii.scan(moved)[1]]


@pytest.mark.parametrize("text", ["Look at the dot on page two.", "He stared at Bob dot matrix printers", "see example.com. dot com", "one two three four five six seven eight nine", "meet me at example.com", "mail a@b.com。Call me", "Привет, как дела? Ответ в 2020–2021.", "a@b (at) c", "point 3 point 4", "we met at noon, dot came", "l’été à 10 h 30", "Zwei, drei, vier; null Punkt fünf", "[at] [dot]", "&#64;", "", "plus one more"])
def test_plain_texts_gain_nothing(text):
    assert pii.scan(text)[1] == []


@pytest.mark.parametrize("before", ["look at home. Then ", "wait at noon.\n", "stay at x dot  , "])
def test_a_sentence_that_ends_after_an_at_is_no_host(before):
    assert pii.scan(before + SHOWN[0][0])[1] == [((0, len(before) + 5, len(before) + 32), "john@example.com")]
    assert pii.scan(f"{SHOWN[0][0]}, {before.strip()}")[1] == [((0, 5, 32), "john@example.com")]


def test_offsets_match_a_map_of_single_characters():
    r = np.random.default_rng(4)
    for _ in range(300):
        source = "".join("abcdef"[i] for i in r.integers(0, 6, 40))
        own, chars = pii.Rewritten(source, []), [(c, k, k + 1) for k, c in enumerate(source)]
        for _ in range(3):
            cuts = np.sort(r.choice(len(own.text) + 1, 6, replace=False)).tolist()
            edits = [(s, e, "X"[: r.integers(0, 2)]) for s, e in zip(cuts[::2], cuts[1::2])]
            for s, e, put in reversed(edits):
                chars[s:e] = [(c, chars[s][1], chars[e - 1][2]) for c in put]
            own = own.then(edits)
            assert own.text == "".join(c for c, _, _ in chars)
            assert [own.start(k) for k in range(len(chars))] == [s for _, s, _ in chars]
            assert [own.end(k + 1) for k in range(len(chars))] == [e for _, _, e in chars]
            if len(own.text) < 6:
                break


@pytest.mark.parametrize("run", ["a", "1", "1.", "a@", "+1", "+(", "1 ", "one ", "a at ", "a dot ", "[.]", "​", "а", "%40", "(", " \t", "one dot ", "a@b."])
def test_long_runs_take_linear_time(run):
    began = time.perf_counter()
    pii.scan(run * ((1 << 19) // len(run)))
    assert time.perf_counter() - began < 8


def test_rows(spark):
    rows = [(0, None), (1, ""), (2, SHOWN[0][0]), (2, SHOWN[0][0]), (None, "x@y.zz 10.0.0.1 +1 (555) 010-9999, 4111 1111 1111 1111"), (4, "plain " * 40_000 + "x@y.zz"), (5, "é x@y.zz")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n_ip int, spans string").repartition(3)
    got = pii.find_personal(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        base = sorted(brute_base(text), key=lambda x: (x[1], x[0]))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in base) for x in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.said(base).encode()).hexdigest()
        assert set(pii.said(base).split(",")) - {""} <= set(r["spans"].split(","))
    assert [(r["n_added"], r["spans"], r["added"]) for r in got if r["doc_id"] == 2] == [(1, "email:5:32", "email:5:32=john@example.com")] * 2
    assert pii.find_personal(df.filter("false")).count() == 0
    clean = pii.redacted(df)
    assert clean.schema == df.schema and {r["doc_id"]: r["text"] for r in clean.collect()} == {0: None, 1: "", 2: "mail [email] today", None: "[email] [ip] [phone], [card]", 4: "plain " * 40_000 + "[email]", 5: "é [email]"}
