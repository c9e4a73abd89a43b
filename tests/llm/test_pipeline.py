import pytest
from helpers import AWKWARD, SF, documents
from test_decontaminate import plain as leaks
from test_packing import check as check_packing
from test_pii import plain as private
from test_simhash import plain_groups

import corpus_pipeline as cp
from tallymart.llm import quality_rules as qr
from tallymart.llm.common import stored


def through(spark, docs, sf):
    """The tables after each stage."""
    out = [docs]
    for k, (name, stage) in enumerate(cp.STAGES):
        out.append(stored(stage(spark, out[-1], sf), name))
        if k < len(cp.STAGES) - 1:
            assert out[-1].columns == docs.columns
    return out


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_stages_against_brute_force(spark, tmp_path, which):
    if which == "table":
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    else:
        some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()
        rows = [*AWKWARD, *((1000 + r["doc_id"], r["text"]) for r in some), *((1000 + r["doc_id"], r["text"]) for r in some[:9])]
        documents(spark, rows).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    start, good, single, clean, masked, packed = through(spark, docs, SF)

    rules = qr.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [bool(r["kept"]) for r in qr.judge(docs, rules).orderBy("doc_id").collect()]
    assert good.count() == sum(kept)

    rows = pairs(good)
    groups = {g for _, _, g in plain_groups(rows)}
    assert single.count() == len(groups) and {r["doc_id"] for r in single.collect()} == groups

    rows = pairs(single)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert pairs(clean) == [r for r in rows if not leaks([r], items)]  # each row by its own text

    before, after = dict(pairs(clean)), dict(pairs(masked))
    assert before.keys() == after.keys()
    for k, text in after.items():
        assert not private(text)
        assert text == before[k] or any(f"<{kind}>" in text for kind in ("EMAIL", "IP", "CARD", "PHONE"))
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect() if r["text"] is not None)

    check_packing(packed.collect(), list(after.items()))


def test_empty_table(spark, tmp_path):
    documents(spark, AWKWARD[:0] or [(1, "x")]).limit(0).write.parquet(str(tmp_path / "docs"))
    assert through(spark, spark.read.parquet(str(tmp_path / "docs")), SF)[-1].count() == 0


def test_run_is_the_stages(spark):
    got = cp.run(spark, SF)
    want = through(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)[-1]
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert got.select(key).exceptAll(want.select(key)).count() == 0 and got.count() == want.count()


def test_columns_called_like_those_of_the_stages(spark, tmp_path):
    names = ["n_words", "upper_share", "row_", "h_", "leaked_", "own_0_", "fp", "w", "component_id", "a column"]
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80")
    some.selectExpr("*", *(f"concat('{n} ', doc_id) as `{n}`" for n in names)).write.parquet(str(tmp_path / "docs"))
    some.write.parquet(str(tmp_path / "plain"))
    got = through(spark, spark.read.parquet(str(tmp_path / "docs")), SF)
    want = through(spark, spark.read.parquet(str(tmp_path / "plain")), SF)
    for a, b in zip(got[:5], want[:5]):
        assert pairs(a) == pairs(b)
        assert all(r[n] == f"{n} {r['doc_id']}" for r in a.collect() for n in names)
