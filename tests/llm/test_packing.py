import zlib
from collections import defaultdict

import numpy as np
from helpers import AWKWARD, SF, documents
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallymart.llm import packing, queries, tokens

PATH = tokens.public_path()
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 's'll \n\t\r.,!1é東\u00a0\u2003\x1c\x85<|>"), max_size=30))
def test_ids_equal_the_tokenizer(text):
    assert np.frombuffer(tokens.byte_bpe(PATH).encode(text), "<u4").tolist() == ids_of(text)[:-1]


def check(rows, texts, window=1024):
    want = defaultdict(int)
    for doc, text in texts:
        n = len(ids_of(text))
        for at in range(n):
            want[(doc, at, n)] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    texts_of = defaultdict(list)
    for doc, text in texts:
        texts_of[doc].append(ids_of(text))
    tokens_in = 0
    for r in rows:
        tokens_in += r["length"]
        part = (r["start"], r["start"] + r["length"])
        sums = {zlib.crc32(np.array(ids[slice(*part)], "<u4").tobytes()) for ids in texts_of[r["doc_id"]] if len(ids) == r["doc_tokens"]}
        assert r["ids_crc32"] in sums
        for at in range(*part):
            got[(r["doc_id"], at, r["doc_tokens"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert len(sequences) == -(-tokens_in // window)  # only the last one is padded
    return tokens_in


def test_query_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = queries.QUERIES["op9_packing"](spark, SF).collect()
    assert check(got, [tuple(r) for r in docs.collect()]) > 100_000


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    check(packing.pack(docs, PATH, ids_crc32=F.crc32("ids")).collect(), AWKWARD)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert "ids" in packing.pack(docs, PATH).columns


def test_plan_uses_every_piece_once():
    random = np.random.default_rng(1)
    for histogram in (
        {1024: 3}, {1: 1}, {1: 5000}, {700: 40}, {512: 9, 300: 4},
        {int(k): int(n) for k, n in zip(random.integers(1, 1025, 400), random.integers(1, 900, 400))},
    ):
        used = defaultdict(int)
        patterns, rest = packing.plan(histogram)
        for lengths, n in patterns:
            assert n > 0 and sum(lengths) == 1024
            for v in lengths:
                used[v] += n
        for v, n in rest.items():
            used[v] += n
        assert used == histogram


def test_least_squares_fits_what_can_be_filled():
    histogram = np.zeros(1025, int)
    histogram[[700, 324, 100, 900, 24]] = [50, 50, 80, 80, 80]
    combos = packing.combinations(np.flatnonzero(histogram))
    x = packing.repeat_counts(combos, histogram)
    made = np.bincount(combos.ravel(), np.repeat(x, 3), 1025)[1:]
    assert np.allclose(made, histogram[1:], atol=0.01) and (x >= 0).all()
