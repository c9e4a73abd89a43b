import random
import re
from collections import Counter

import pytest
from helpers import lower

from tallymart.llm import collocations, queries


def plain(rows, least=10, top=2000):
    """Phrases by counting every phrase of every piece."""
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(g == lang and len(t) > len(w) and w in (t[:2], t[1:]) and 100 * b >= 50 * a for (g, t), b in cand.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, w[:k]], f[lang, w[k:]]  # noqa: E741
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, rank, w.decode(), -a, l, r, sum(c for (g, t), c in f.items() if g == lang and len(t) == 1), -s)
        for lang, found in out.items()
        for rank, (s, a, w, l, r) in enumerate(sorted(found)[:top], 1)
    )


def mined(spark, rows, least=10, top=2000):
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n long, node string").repartition(3)
    got = collocations.phrases(docs, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed, n=60):
    pick = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for k in range(n):
        parts = [" ".join(pick.choice("the of and a b c d".split()) for _ in range(pick.randrange(30))) for _ in range(4)]
        parts.append(passage if k % 3 == 0 else "x y z " * pick.randrange(5))
        pick.shuffle(parts)
        rows.append((pick.choice([". ", "\n", " , ", "\t", "\r\n"]).join(parts), pick.choice(["en", "de", None, "", "a\tb c"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert mined(spark, rows, 5) == plain(rows, 5)
    assert mined(spark, rows, 3, 7) == plain(rows, 3, 7)


def test_many_batches_and_spread_nodes(spark, monkeypatch):
    rows = corpus(3)
    for name, small in (("BATCH_WORDS", 50), ("PART_BYTES", 200), ("PIECE", 3), ("FREQUENT", 0.01), ("CUBE", 4)):
        monkeypatch.setattr(collocations, name, small)
    assert mined(spark, rows, 4) == plain(rows, 4)


def test_awkward_texts(spark):
    rows = [(None, "en"), ("", None), (" \t \n.,", "en"), ("A a a A " * 400, "en"), ("naïve café — 東京 " * 30, "fr"), ("one two\x1cthree " * 12, "en")]
    rows += [("Same line again here\n" * 20, "en")] * 3 + [("w" * 5000 + " end. ", None)] * 12
    assert mined(spark, rows) == plain(rows)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert collocations.phrases(docs.limit(0)).count() == 0


def test_ranks_of_chains_and_rings(spark):
    chains = [(i, i - 1 if i % 50 else None) for i in range(150)]
    ring = [(1000 + i, 1000 + (i + 1) % 37) for i in range(37)] + [(2000, 2001), (2001, 2000)]
    got = collocations.ranked(spark.createDataFrame(chains + ring, "id long, before long")).collect()
    want = {i: (i // 50 * 50, i % 50) for i in range(150)}
    want |= {1000: (1000, 0)} | {1000 + i: (1000, 37 - i) for i in range(1, 37)} | {2000: (2000, 0), 2001: (2000, 1)}
    assert {r["id"]: (r["head"], r["nth"]) for r in got} == want


def test_paths_hold_every_frequent_edge_once(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "text string, lang string")
    graph = collocations.Graph(docs, 4)
    triples = collocations.stored(graph.triples(), "t")
    nodes = collocations.stored(collocations.nodes_of(graph, triples), "n")
    found = collocations.paths(triples, nodes).collect()
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = piece.split()
            f.update(("und" if lang is None else lang, tuple(w[i : i + k])) for k in (2, 3) for i in range(len(w) - k + 1))
    edges = [((p["lang"], tuple(p["words"][i : i + 3])), a) for p in found for i, a in enumerate(p["weights"])]
    assert len(edges) == len(set(edges)) and dict(edges) == {k: n for k, n in f.items() if len(k[1]) == 3 and n >= 4}
    for p in found:
        assert p["flows"] == [f[p["lang"], tuple(p["words"][i : i + 2])] for i in range(len(p["words"]) - 1)]
    assert max(len(p["weights"]) for p in found) >= 30  # the passage
    assert queries.QUERIES["op13_collocations"]
