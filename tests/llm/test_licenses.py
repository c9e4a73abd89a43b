import re

import numpy as np
from helpers import AWKWARD, SF, documents, lower

from tallymart.llm import licenses, queries


def plain(text):
    """n_words, n_base, first_word, last_word, base_labels, read word by word."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at = [(i, name) for name, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in at}))


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.QUERIES["op4_licenses"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) and any(r["n_base"] for r in got)
    for r in got:
        assert tuple(r)[1:6] == plain(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


MIT = licenses.OWN[[n for n, _ in licenses.OWN].index("mit-text")][1]
CASES = [
    ("MIT License, MIT license; mit\nlicense mit licens", "mit", 3),
    (MIT.upper(), "mit-text", 0),
    (MIT.replace("of charge", "of any charge"), "mit-text", 0),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0", 1),
    ("GNU General Public License, version 3 or GNU General Public License, version 2", "gpl,gpl-2,gpl-3", 2),
    ("x " * 20_000 + "general public license " * 300, "gpl", 300),
    ("generally public license", "", 0),
]


def test_places(spark):
    docs = documents(spark, [(k, t) for k, (t, _, _) in enumerate(CASES)])
    for r in licenses.scan(docs).collect():
        text, wanted, n = CASES[r["doc_id"]]
        assert (r["labels"], r["n_base"]) == (wanted, n), (text[:60], r)
        assert tuple(r)[1:6] == plain(text)


def test_awkward_rows(spark):
    docs = documents(spark)
    got = licenses.scan(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(((i, *plain(t)) for i, t in AWKWARD), key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0


SINGLE = [
    ("GNU General Public License, version 3", "gpl,gpl-3"),
    ("GNU General Public License, version 2", "gpl,gpl-2"),
    ("GNU General Public License, the version 3", "gpl,gpl-3"),
    ("GNU General Public License", "gpl"),
    ("GNU Lesser General Public License, version 3", "gpl,lgpl"),
    ("GNU Affero General Public License version 3", "agpl,gpl"),
    ("Licensed under the Apache License, version 1.1", "apache"),
    ("Licensed under the Apache License, a version 2.0", "apache,apache-2.0"),
    ("Licensed under Apache License version 2.0", "apache,apache-2.0"),
    ("Licensed under the CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under a CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY 3.0", ""),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", ""),
    ("Creative Commons Attribution 4.0 international public license", "cc-by"),
    ("All other rights reserved", "reserved"),
    ("All rights waived", ""),
    ("All rights reserved, all your rights reserved", "reserved"),
]


def test_single_notices_have_their_own_label_only(spark):
    docs = documents(spark, [(k, t) for k, (t, _) in enumerate(SINGLE)])
    got = {SINGLE[r["doc_id"]][0]: r["labels"] for r in licenses.scan(docs).collect()}
    assert got == dict(SINGLE)


def plain_fits(template, text, telling, most):
    """The alignment cell by cell."""
    n, far = len(template), most + 1
    fixed = [n < licenses.LEAST_WORDS or w in telling for w in template]
    column = [(0, 0)]
    for i in range(n):
        column.append((column[i][0] + (far if fixed[i] else 1), 0))
    ends = []
    for j, word in enumerate(text):
        told, now = word in telling, [(0, j + 1)]
        for i in range(n):
            same = column[i][0] + (0 if template[i] == word else far if fixed[i] or told else 1)
            lost = fixed[i] or (told and now[i][1] == j + 1)
            choices = [
                (same, column[i][1]),
                (column[i + 1][0] + (far if told else 1), column[i + 1][1]),
                (now[i][0] + (far if lost else 1), now[i][1]),
            ]
            now.append(min(choices, key=lambda x: (x[0], -x[1])))
        column = now
        if column[n][0] <= most:
            ends.append((column[n][0], column[n][1], j + 1))
    out = []
    for edits, start, end in sorted(ends):
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, edits))
    return out


def test_alignment_against_plain_table():
    rng = np.random.default_rng(5)
    found = 0
    for _ in range(3000):
        template = rng.integers(0, 6, rng.integers(1, 9)).tolist()
        text = rng.integers(-1, 6, rng.integers(0, 25)).tolist()
        telling = set(rng.integers(-1, 6, rng.integers(0, 3)).tolist())
        most = int(rng.integers(0, 4))
        want = plain_fits(template, text, telling, most)
        assert licenses.fits(template, text, telling, most) == want, (template, text, telling, most)
        found += len(want)
    assert found > 1000


BSD_3 = dict(licenses.WHOLE)["bsd-3"]
#: A license of 300 words that no list has.
LONG = [f"clause{k} grants{k % 7} the{k % 11} holder{k % 13} rights{k}" for k in range(60)]


def changed(lines):
    """Lines reflowed, two missing, one inserted, some words changed."""
    kept = [x for k, x in enumerate(lines) if k not in (10, 31)]
    kept.insert(20, "an added line of the project itself")
    text = " ".join(kept).replace("rights40", "privileges")
    return text.replace(" ", "\n * ", 50)


def test_whole_licenses_are_one_span(spark):
    lines = [x for x in BSD_3.split("\n") if x]
    numbered = BSD_3.replace("Redistributions", "1. Redistributions").replace("Neither", "3. Neither")
    texts = {
        1: "some code\n" + BSD_3 + "\nmore code",
        2: "# " + numbered.replace("\n", "\n# ").replace("COPYRIGHT HOLDER", "REGENTS") + " end",
        3: BSD_3.replace(lines[-3], ""),
        4: dict(licenses.WHOLE)["bsd-2"],
        5: dict(licenses.WHOLE)["mit-text"].replace("sublicense, and/or sell", "sell"),
        6: " ".join(BSD_3.split()[:60]),
        7: dict(licenses.WHOLE)["isc"].replace("and/or", "and"),
    }
    want = {1: ["bsd-3"], 2: ["bsd-3"], 3: ["bsd-3"], 4: ["bsd-2"], 5: ["mit-text"], 6: [], 7: ["isc"]}
    for r in licenses.scan(documents(spark, list(texts.items()))).collect():
        whole = [p for p in r["places"] or [] if p["end"] - p["start"] > 60]
        assert [p["label"] for p in whole] == want[r["doc_id"]], r
        if whole:
            words = len(licenses.words_of(texts[r["doc_id"]].encode()))
            assert whole[0]["end"] - whole[0]["start"] >= 0.9 * words - 5


def test_templates_from_a_table(spark):
    rows = [("long", "\n".join(LONG)), ("long", "\n".join(LONG)), (None, "x y"), ("none", None), ("empty", " ; ")]
    table = spark.createDataFrame(rows, "label string, text string")
    docs = documents(spark, [(1, "before " + changed(LONG) + " after"), (2, " ".join(LONG[:30])), (3, "\n".join(LONG) * 2)])
    got = {r["doc_id"]: r for r in licenses.scan(docs, own=table).collect()}
    (place,) = got[1]["places"]
    assert got[1]["labels"] == "long" and place["cover"] > 0.9
    assert (place["start"], place["end"]) == (1, got[1]["n_words"] - 1)
    assert got[2]["labels"] == "" and len(got[3]["places"]) == 2
    assert licenses.scan(docs, own=table.limit(0)).where("labels != ''").count() == 0
