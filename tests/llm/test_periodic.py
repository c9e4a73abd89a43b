import hashlib
import zlib

import numpy as np
from helpers import SF, documents, words
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallymart.llm import periodic, queries


def plain_runs(seq, least=12):
    """All maximal stretches, by trying every period at every place."""
    n, found = len(seq), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and seq[j] == seq[j + p]:
                j += 1
            if j > i and j - i >= p and j + p - i >= least:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(((-m, s, p) for s, m, p in runs), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    digest = "".join(f"{s},{m},{p}\n" for s, m, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(digest.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def found(sequences, shared, least=12):
    text, start, length, period = periodic.runs_of([np.array(s, np.int64) for s in sequences], shared, least)
    got = [[] for _ in sequences]
    for t, *run in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[t].append(tuple(run))
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=5), st.integers(2, 14))
def test_runs_of_small_alphabets(sequences, least):
    assert found(sequences, 3, least) == [sorted(plain_runs(s, least), key=lambda r: (r[0], r[2])) for s in sequences]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=200))
def test_extensions_are_exact(seq):
    whole = np.array([4, *seq, 5], np.int64)
    grammar = periodic.recompress(whole, 4)
    back = grammar.mirrored()
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(whole)), np.arange(len(whole))))
    x, y = x[x < y], y[x < y]

    def plain(a, i, j):
        n = 0
        while i + n < len(a) and j + n < len(a) and a[i + n] == a[j + n]:
            n += 1
        return n

    assert grammar.extension(x, y).tolist() == [plain(whole, i, j) for i, j in zip(x, y)]
    assert back.extension(x, y).tolist() == [plain(whole[::-1], i, j) for i, j in zip(x, y)]


def test_long_periods_powers_and_nested_runs():
    random = np.random.default_rng(1)
    block = random.integers(0, 500, 700).tolist()
    nested = ([1, 2, 1, 2, 1, 2, 3] * 9)[:-2]
    fibonacci, b = [0], [0, 1]
    for _ in range(13):
        fibonacci, b = b, b + fibonacci
    cases = [block * 3 + block[:100], [7] * 3000, nested, b[:400], random.integers(0, 500, 2000).tolist()]
    assert found(cases, 500) == [sorted(plain_runs(s), key=lambda r: (r[0], r[2])) for s in cases]


def test_grids_in_small_chunks(monkeypatch):
    cases = [[1, 2, 3] * 20, [5] * 40, list(range(50))]
    want = found(cases, 60)
    monkeypatch.setattr(periodic, "GRID_POINTS", 7)
    assert found(cases, 60) == want and want[2] == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in docs if len((r["text"] or "").split()) <= 1500}
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in docs}
    assert [got[i] for i in sorted(short)] == [plain_row(i, short[i]) for i in sorted(short)]
    assert sum(got[i][1] for i in short) > 10


def test_awkward_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (5, "a b " * 30), (5, "a b " * 30), (None, "x y z " * 8), (None, None), (7, "w" * 50_000),
            (9, "same " * 5000), (13, "Grüße 東京 " * 9 + "end"), (40, "a b c\x1cd " * 20)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    docs = documents(spark, rows)
    out = periodic.find_runs(docs, "row_id", "score", "doc_id")
    assert out.columns == ["row_id", "score", "doc_id", "n_words", "runs", "collapsed"] and out.count() == len(rows)
    assert periodic.find_runs(docs.limit(0), "doc_id").count() == 0
    assert {r["collapsed"] for r in out.where(F.col("doc_id") == 5).collect()} == {"a b"}
