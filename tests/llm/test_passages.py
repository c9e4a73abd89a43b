import math
import re

import numpy as np
from helpers import AWKWARD, documents, labels, remainder

from tallymart.llm import passages, queries
from tallymart.llm.common import training_rows

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.QUERIES["op10_quality_classifier"](spark, SF).collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], quality[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in quality]
    assert np.mean([p == q for p, q in held]) > 0.9


def plain_score(model, text):
    """One text, one passage and one number after the other."""
    if model.base_rate is not None:
        return model.base_rate
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    kinds, total, encoded, energies = len(set(words)), len(words), [], []
    p = {k: v.tolist() for k, v in model.p.items()}
    squash = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    for at in range(0, max(total, 1), 64):
        part = words[at : at + 64]
        n, chars = max(len(part), 1), "".join(part)
        among = lambda those: sum(c in those for c in chars)
        upper, lower = sum("A" <= c <= "Z" for c in chars), sum("a" <= c <= "z" for c in chars)
        shares = [
            among("#*$%&|<>") / n, among("!?") / n, among(".,;:") / n, among("0123456789") / n, among("|") / n,
            upper / max(upper + lower, 1), (len(chars) + (len(part) == 0) * 1) / n / 8, len(set(part)) / n,
            len(set(zip(part, part[1:]))) / max(len(part) - 1, 1), len(part) / 64, math.log1p(total) / 8, kinds / max(total, 1),
        ]
        x = [(v - m) / s for v, m, s in zip(shares, model.mean, model.scale)]
        h = [math.tanh(sum(v * p["w"][i][j] for i, v in enumerate(x)) + p["b"][j]) for j in range(len(p["b"]))]
        gate = [
            math.tanh(sum(h[i] * p["v"][i][j] for i in range(len(h)))) * squash(sum(h[i] * p["u"][i][j] for i in range(len(h))))
            for j in range(len(p["a"]))
        ]
        encoded.append(h)
        energies.append(sum(g * a for g, a in zip(gate, p["a"])))
    weights = [math.exp(e - max(energies)) for e in energies]
    z = [sum(w * h[j] for w, h in zip(weights, encoded)) / sum(weights) for j in range(len(p["c"]))]
    return squash(sum(v * c for v, c in zip(z, p["c"])) + p["d"][0])


def test_query_against_a_plain_forward_pass(spark):
    docs, quality = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = passages.fit(docs, quality.where(training_rows("doc_id", 4, 2)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op10_quality_classifier"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    assert max(abs(got[i] - plain_score(model, t)) for i, t in texts.items()) < 1e-4
    odd = documents(spark)
    scores = sorted((str(r["doc_id"]), r["score"]) for r in passages.score(odd, model).collect())
    want = sorted((str(i), plain_score(model, t)) for i, t in AWKWARD)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 for a, b in zip(scores, want))


def test_gradients():
    random = np.random.default_rng(0)
    bags = [random.random((k, passages.FEATURES)) for k in (1, 3, 2, 5)]
    x, begin, y = np.concatenate(bags), np.array([0, 1, 4, 6]), np.array([1.0, 0, 0, 1])
    weight = np.array([1.0, 2, 1, 3])
    model = passages.Attention(1)

    def loss():
        p = np.clip(model.score(x, begin), 1e-12, 1 - 1e-12)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    for name, grad in model.step(x, begin, y, weight).items():
        flat = model.p[name].reshape(-1)
        for k in range(0, flat.size, 7):
            was = flat[k]
            flat[k] = was + 1e-5
            up = loss()
            flat[k] = was - 1e-5
            down = loss()
            flat[k] = was
            assert abs((up - down) / 2e-5 - grad.reshape(-1)[k]) < 1e-5


def test_awkward_rows(spark):
    docs = documents(spark)
    for rows in ([], [(1, 1)], [(1, 0), (5, 1), (5, 0), (None, 1), (99, None), (6, 1)]):
        got = passages.score(docs, passages.fit(docs, labels(spark, rows)), "source").collect()
        assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in AWKWARD)
        assert all(0 <= r["score"] <= 1 for r in got)
    assert passages.score(docs.limit(0), passages.fit(docs.limit(0), labels(spark, []))).count() == 0
