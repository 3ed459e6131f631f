import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagewarden.llm import divergence

AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = TERM.findall((text or "").translate(AZ))
        groups[lang].add(source)
        counts[lang, source].update(own)
        docs[lang].update(set(own))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (n[s] + 5 * len(kept)) for t in kept} for s in sources}
        every = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (every[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


def corpus(n=160):
    r = np.random.default_rng(5)
    stems = ["alpha", "alpine", "alp", "beta", "bet", "Größe", "été", "日本", "日本語", "z", "zz"] + [f"common{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        lang = ["en", "de", "en", None, "fr"][i % 5]
        source = ["s1", "s2", "s3", "s1", None, "s5"][int(r.integers(0, 6))]
        rows.append((" ".join(stems[int(x)] for x in r.zipf(1.3, 25) % len(stems)) + f"-{i}", lang, source))
    rows += [(None, "en", "only nulls"), ("", "xx", "a"), ("", "xx", "b"), ("rare words", "yy", "alone")] + [("Same Text same TEXT", "en", "s1")] * 6
    return rows + [("long " * 20_000 + "x" * 5000, "en", "s2"), ("x" * 5000 + "y", "en", "s3"), ("x" * 5000 + "y", "en", "s3")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i // 2, *r, 1, "h", b"x") for i, r in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lid int, item string, head binary").repartition(7)


def result(df):
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least, top", [(2, 50), (12, 3), (10_000, 5)])
def test_audit_matches_brute_force(docs, least, top):
    assert result(divergence.audit(docs, least, top)) == brute(corpus(), least, top)


def test_small_tries_deep_cuts_and_blocks(docs, monkeypatch):
    for name, value in (("HELD", 50), ("ROW", 3), ("CELLS", 6)):
        monkeypatch.setattr(divergence, name, value)
    assert result(divergence.audit(docs, 2, 4, depth=1, most=4)) == brute(corpus(), 2, 4)


def test_empty_tables(docs):
    assert divergence.audit(docs.filter("false")).count() == 0
    assert result(divergence.audit(docs.filter("lang = 'xx'"))) == brute([("", "xx", "a"), ("", "xx", "b")], 30, 50)


def counters(*rows):
    return np.array(list(rows), dtype=divergence.COUNTER)


def test_tries_merge_cut_and_read_back():
    one = divergence.Trie(pa.array([b"a", b"ab", b"abc", b"b"], pa.binary()), np.array([1, 2, 1, 1]), counters((1, 7, 2, 1), (1, 7, 1, 1), (1, 8, 4, 3), (2, 9, 1, 1), (1, 7, 5, 5)))
    other = divergence.Trie(pa.array([b"abd", b"ab"], pa.binary()), np.array([1, 1]), counters((1, 8, 1, 1), (1, 8, 6, 2)))
    both = divergence.Trie.merged([one, other])
    assert both.terms.to_pylist() == [b"a", b"ab", b"abc", b"abd", b"b"] and both.shared().tolist() == [0, 1, 2, 2, 0]
    assert both.counters[1:3].tolist() == [(1, 7, 1, 1), (1, 8, 10, 5)]
    rows = both.rows(2)
    assert rows.column("head").to_pylist() == [b"a", b"ab", b"b"] and rows.column("leaves").to_pylist() == [1, 3, 1]
    for depth, most in ((1, None), (2, None), (9, None), (0, 2)):
        again = divergence.trie_of(both.rows(depth, most))
        assert again.terms.equals(both.terms) and (again.fan == both.fan).all() and (again.counters == both.counters).all()
    assert both.kept(5).terms.to_pylist() == [b"ab", b"b"]


def test_scaled_is_exact():
    for count, n, v in ((0, 0, 1), (3, 10, 2), (4 * 10**12, 5 * 10**12, 10**7), (10**10, 10**10, 1)):
        assert divergence.scaled(np.array([count]), np.array([n]), np.array([v]))[0] == 1 + 10**9 * (count + 5) // (n + 5 * v)
