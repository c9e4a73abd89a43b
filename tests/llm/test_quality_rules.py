import numpy as np
import pytest
from helpers import AWKWARD, LONG, SF, documents, labels, words

from tallymart.llm import queries, quality_rules as qr


def plain(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else _many(windows)
    covered = {i + k for i, x in enumerate(windows) if x in many for k in range(3)}
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def _many(windows):
    from collections import Counter

    return {x for x, n in Counter(windows).items() if n > 1}


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.QUERIES["op5_quality_rules"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:7] == plain(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    good = [r for r in got if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in good) <= 0.03 * len(good)


def test_awkward_rows(spark):
    docs = documents(spark)
    got = qr.judge(docs, qr.fit(docs, labels(spark, [(1, 0), (5, 1), (5, 0), (None, 1), (99, None)]))).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(((i, *plain(t)) for i, t in AWKWARD), key=repr)
    assert qr.fit(docs.limit(0), labels(spark, [])) == []
    assert qr.judge(docs.limit(0), []).count() == 0
    kept = qr.keep_good(docs, [])
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((i, t) for i, t in AWKWARD if not plain(t)[5])


def test_covering_finds_a_conjunction():
    random = np.random.default_rng(5)
    x = random.random((3000, len(qr.SHARES)))
    poor = ((x[:, 0] > 0.8) & (x[:, 3] < 0.4)) | (x[:, 5] > 0.95)
    rules = qr.learn(x, poor)
    fresh = random.random((3000, len(qr.SHARES)))
    truth = ((fresh[:, 0] > 0.8) & (fresh[:, 3] < 0.4)) | (fresh[:, 5] > 0.95)
    said = np.zeros(len(fresh), bool)
    for rule in rules:
        said |= qr._covers(rule, fresh)
    assert (said == truth).mean() > 0.98


@pytest.mark.parametrize("text", ["", "a b c", "a b c a b c", "a b c d a b c", LONG[:3000], "x x x x"])
def test_repeated_words(text):
    assert qr.repeated_words(text.encode().split()) == plain(text)[4]
