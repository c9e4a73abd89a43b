import check
import pytest
from helpers import AWKWARD, LONG, PROSE, SF, documents

from tallymart.llm import decontaminate as dc, queries

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
NEAR = ITEM.replace("tau", "other")
ITEMS = [(1, ITEM), (1, ITEM), (2, "one"), (3, None), (4, ""), (None, "a b c d e f g h"), (5, PROSE), (6, "short and sweet")]


def plain(docs, items, n=5, least=0.8):
    import re

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}

    out = {}
    for doc, text in docs:
        mine = grams(text)
        for item, asked in items:
            g = grams(asked)
            if g and len(mine & g) >= least * len(g):
                out[(doc, item)] = max(out.get((doc, item), (0,)), (len(mine & g) / len(g), len(mine & g), len(g)))
    return {(d, i, s, n, c) for (d, i), (c, s, n) in out.items()}


DOCS = [*AWKWARD, (20, f"{LONG} {ITEM.upper()}! {LONG}"), (20, ITEM), (21, f"{LONG}{NEAR} end"), (22, ITEM[:60]), (None, f"a b c d e f g h. {ITEM}"), (23, "Short and sweet.")]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", limit)  # with and without broadcast
    items = spark.createDataFrame([(*i, "h") for i in ITEMS], "item_id long, text string, hash string")
    docs = documents(spark, DOCS)
    got = {tuple(r) for r in dc.leaks(docs, items).collect()}
    assert got == plain(DOCS, ITEMS)
    assert {(20, 1), (21, 1), (None, 1), (None, None), (23, 6)} <= {(d, i) for d, i, *_ in got}
    clean = dc.keep_clean(docs, items)
    assert clean.columns == docs.columns
    # Each row by its own text, whatever its id.
    want = [(d, t) for d, t in DOCS if not plain([(0, t)], ITEMS)]
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted(want, key=repr)


def test_clean_rows_beside_leaked_ones_of_their_id_stay(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(None, f"x {ITEM}"), (None, "a clean text without an id"), (5, f"{ITEM} y"), (5, "a clean text under the same id"), (6, "clean")]
    clean = dc.keep_clean(documents(spark, rows), items).collect()
    assert sorted((r["text"] for r in clean)) == ["a clean text under the same id", "a clean text without an id", "clean"]


def test_probes_are_few_and_by_size_class(spark):
    """A shingle is probed only in classes whose ceiling it does not exceed, and hardly ever without being in a sketch."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    sketch = dc.sketches(items).cache()
    tops = {r["size_class"]: r["m"] for r in sketch.groupBy("size_class").agg({"hash": "max"}).withColumnRenamed("max(hash)", "m").collect()}
    found = dc.probes(docs, sketch)
    assert all(r["hash"] <= tops[r["size_class"]] for r in found.collect())
    every = dc._hashed(docs, dc.WORDS).selectExpr("explode(filter(h, x -> x is not null)) as hash")
    below = every.where(f"hash <= {max(tops.values())}").count()
    hits = every.join(sketch.select("hash").distinct(), "hash").count()
    # Before: all below the greatest ceiling. Now: the hits, and what the filter lets through, once for each class.
    assert hits <= found.count() <= len(tops) * (hits + 0.02 * below) and found.count() < 0.1 * below


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark)
    assert dc.leaks(docs, items.limit(0)).count() == 0
    assert dc.leaks(docs.limit(0), items).count() == 0
    assert dc.keep_clean(docs, items.limit(0)).count() == len(AWKWARD)


def test_query_matches_oracle(spark):
    name = "op2_decontaminate"
    assert check.compare(spark, check.connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_plan_has_no_python(spark, capsys):
    queries.QUERIES["op2_decontaminate"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
