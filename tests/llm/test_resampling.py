import hashlib
import re
import zlib
from collections import Counter
from math import floor, log

import pytest

from pagewarden.llm import resampling

AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"word{i % 13} Ünder{i % 7}" for i in range(40))


def buckets_of(text, buckets):
    w = WORD.findall((text or "").translate(AZ))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20, buckets=10_000):
    own = [buckets_of(t, buckets) for _, t in docs]
    s, t = Counter(b for _, x in own for b in x), Counter(b for x in target for b in buckets_of(x, buckets)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: floor(1000 * log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for (i, text), (n, x) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([i, len(x), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), n, hashlib.sha256((text or "").encode()).hexdigest()])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


DOCS = [(i, f"{LONG} and word{i % 5} then {i}") for i in range(60)] + [(i, "few words here") for i in range(60, 66)]
DOCS += [(66, None), (67, ""), (68, " .. "), (None, LONG), (None, LONG), (None, None), (5, LONG + " of another"), (5, DOCS[5][1]), (70, "x" * 200_000), (71, "tiny wörds " * 9000)] + [(72, LONG.upper())] * 9
TARGET = [LONG, "word1 ünder1 word2", None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, "b", 2) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket int, first string, copies int").repartition(5)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(t, 3) for t in TARGET], "text string, gain int")


@pytest.mark.parametrize("percent, copies", [(5, 4096), (50, 2), (100, 4)])
def test_weights_and_ranks_match_brute_force(docs, target, percent, copies, monkeypatch):
    monkeypatch.setattr(resampling, "_COPIES", copies)
    got = resampling.resampled(docs, target, percent)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, TARGET, percent)


def test_few_buckets_and_empty_tables(docs, target):
    got = resampling.resampled(docs, target, 30, 3, buckets=7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, TARGET, 30, 3, 7)
    assert resampling.resampled(docs.filter("false"), target).count() == 0
    alone = resampling.resampled(docs, target.filter("false"), 30)
    assert sorted(map(tuple, alone.collect()), key=str) == brute(DOCS, [], 30)


def test_the_gain_table_alone_is_broadcast(docs, target):
    plan = resampling.weighed(docs, target)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
