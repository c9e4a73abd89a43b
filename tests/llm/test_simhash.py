import numpy as np
import xxhash
from helpers import AWKWARD, SF, documents, lower, words

from tallymart.llm import queries, simhash


def plain_fingerprint(text):
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=4):
    """Smallest id reachable for each row, by breadth-first search over all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    group = [None] * len(rows)
    for k in range(len(rows)):
        if group[k] is None:
            seen, todo = {k}, [k]
            while todo:
                x = todo.pop()
                for y in range(len(rows)):
                    if y not in seen and (fps[x] ^ fps[y]).bit_count() <= radius:
                        seen.add(y)
                        todo.append(y)
            least = min((rows[i][0] for i in seen if rows[i][0] is not None), default=None)
            for i in seen:
                group[i] = (least,)
    return sorted(((i, f"{f:016x}", g[0]) for (i, _), f, g in zip(rows, fps, group)), key=repr)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op6_simhash"](spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups(rows)


def test_awkward_rows(spark):
    docs = documents(spark)
    from pyspark.sql import functions as F

    got = simhash.groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups(AWKWARD)
    assert simhash.groups(docs.limit(0)).count() == 0


def test_keep_first_takes_one_row_of_each_group(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    groups = {g for _, _, g in plain_groups(AWKWARD)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(groups) and set(ids) == groups


def test_keep_first_keeps_unlinked_texts_of_null_and_repeated_ids(spark, tmp_path):
    texts = ["a b c d e f g h i", "quite another text without an id at all", "first words under one id here", "other things stand under it too"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3])]
    fps = [plain_fingerprint(t) for t in texts]
    assert all((a ^ b).bit_count() > 4 for k, a in enumerate(fps) for b in fps[:k])
    documents(spark, rows).write.parquet(str(tmp_path / "docs"))
    kept = simhash.keep_first(spark.read.parquet(str(tmp_path / "docs"))).collect()
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(want, key=repr)


def test_forest_keeps_every_component():
    random = np.random.default_rng(3)
    seeds = random.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [s ^ np.uint64(1 << int(b)) for s in seeds for b in random.integers(0, 64, 40)]
    fps = np.unique(np.concatenate([seeds, np.array(near, np.uint64), random.integers(0, 1 << 63, 500, dtype=np.uint64)]))

    def parts(links):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(x) for x in range(len(fps))]

    want = parts(zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)))
    at = {int(f): k for k, f in enumerate(fps)}
    a, b = simhash.forest(fps, None, 4)
    assert len(a) < len(fps)
    assert parts((at[int(x)], at[int(y)]) for x, y in zip(a, b)) == want
    left, right = fps[::2], fps[1::2]
    links = [simhash.forest(left, None, 4), simhash.forest(right, None, 4), simhash.forest(left, right, 4)]
    assert parts((at[int(x)], at[int(y)]) for a, b in links for x, y in zip(a, b)) == want


def test_strips_of_one_popcount_meet(spark):
    base = [0xF0F0F0F0F0F0F0F0 ^ (1 << k) ^ (1 << j) for k in range(0, 64, 3) for j in range(k + 1, 64, 5)]
    fps = np.unique(np.array(base, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    from tallymart.llm.graph import components

    roots = components(simhash.links(df, 4, strip=16)).collect()
    assert len(roots) == len(fps) and len({r["root"] for r in roots}) == 1


def test_boxes_part_fingerprints_by_their_counts(spark):
    """Every pair within the radius meets in some pair of strips, and what is sent grows slower than the square."""
    rng = np.random.default_rng(3)

    def sent(n):
        fps = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        near = np.unique(np.concatenate([fps, fps[: n // 10] ^ np.uint64(0b1011 << 14)]))
        df = spark.createDataFrame([(x,) for x in near.view(np.int64).tolist()], "fp long")
        met = simhash.strips_met(df, 4, strip=64).toPandas()
        at = {}
        for one, two, x in met.itertuples(index=False):
            for f in np.frombuffer(x, np.uint64).tolist():
                at.setdefault(f, set()).add((one, two))
        there = set(near.tolist())
        pairs = [(f, f ^ 0b1011 << 14) for f in near.tolist() if f ^ 0b1011 << 14 in there]
        assert len(pairs) >= n // 10 and all(at[a] & at[b] for a, b in pairs)
        return sum(map(len, met["fps"]))

    few, many = sent(3000), sent(12_000)
    assert many < 16 * few * 0.75


def test_boxes_hold_their_cells():
    cells = np.array([0, 8, 8 + 17 * 8, 8 + 17 * 9, 16 + 17 * 16 + 289 * 16 + 4913 * 16])
    box, low, high, cuts = simhash._boxes(cells, np.array([1, 2, 100, 3, 1]), 10)
    counts = np.column_stack([(q := cells[:, None] // 17 ** np.arange(4) % 17).sum(1), q])
    assert (low[box] <= counts).all() and (counts <= high[box]).all()
    assert cuts[box[2]] == 10 and (box == box[2]).sum() == 1
    assert box[0] not in simhash._near(low, high, box[4], 4) and box[3] in simhash._near(low, high, box[2], 4)
    assert [len(x) for x in simhash._boxes(cells[:0], cells[:0], 10)] == [0] * 4
