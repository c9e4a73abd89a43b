"""SimHash near duplicates: 64-bit fingerprints, compared exactly in tiles.

A fingerprint bit is one if it is set in over half the hashes of the text's word shingles. Two fingerprints within the radius
differ by no more than the radius in population count, and so do the counts of their four 16-bit quarters, added up. Distinct
fingerprints are therefore cut into boxes by these counts, halved where they spread most until a strip is small; only boxes no
further apart than the radius meet (one set of four counts that holds more than a strip is cut by hash). Inside a pair of strips,
tiles sorted by the quarter counts are skipped by the same argument. What is left is compared by
numpy exclusive-or and bit counts. A task returns a spanning forest of its links, not all pairs.

Edge cases: null and empty texts have fingerprint zero and are linked like any other. Texts of fewer words than a
shingle are one shingle. Repeated rows share a component; rows without a doc_id take part, but never name a component
unless it holds no other id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import free_name, slices, stored, utf8
from tallymart.llm.graph import components

WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a strip, on average at most, and in a tile.
STRIP = 16_384
TILE = 512

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes, words_each: int = WORDS) -> int:
    """SimHash of a text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < words_each:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(words) - words_each + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start, end[words_each - 1 :].tolist())], np.uint64)
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _COLUMN
    counts = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, *keep: str, words_each: int = WORDS) -> DataFrame:
    """The columns named, then ``fp`` (the 64 bits as a signed long)."""
    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + ["fp long"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(x, words_each) for x in utf8(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    return kept.mapInArrow(hashed, schema)


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted fingerprints, and least and greatest quarter counts of each tile."""
    fps = np.ascontiguousarray(fps)
    q = _quarters(fps)
    order = np.lexsort(q.T[::-1])
    q = q[order]
    at = np.arange(0, len(fps), TILE)
    return fps[order], np.minimum.reduceat(q, at).astype(int), np.maximum.reduceat(q, at).astype(int)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the fingerprints (unsigned, distinct) within the radius; ``right`` None: in one set."""
    a, a_low, a_high = _tiles(left)
    b, b_low, b_high = (a, a_low, a_high) if right is None else _tiles(right)
    shift = 0 if right is None else len(a)
    nodes = a if right is None else np.concatenate([a, b])
    root = np.arange(len(nodes))
    apart = np.maximum(np.maximum(a_low[:, None] - b_high[None], b_low[None] - a_high[:, None]), 0).sum(2)
    for i, j in zip(*np.nonzero(apart <= radius)):
        if right is None and j < i:
            continue
        x, y = a[i * TILE : (i + 1) * TILE], b[j * TILE : (j + 1) * TILE]
        near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
        if not near.any():
            continue
        u, v = np.nonzero(near)
        u, v = u + i * TILE, v + j * TILE + shift
        while True:
            ru, rv = root[u], root[v]
            open_ = ru != rv
            if not open_.any():
                break
            u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
            np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _boxes(cells: np.ndarray, many: np.ndarray, strip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Box of each cell; of each box the least and greatest counts (whole fingerprint, quarters) and how many strips it has.

    A box of more than ``strip`` fingerprints is halved where its counts spread most, until it holds one cell."""
    quarters = cells[:, None] // 17 ** np.arange(4) % 17
    counts = np.column_stack([quarters.sum(1), quarters])
    box, low, high, cuts = np.zeros(len(cells), np.int64), [], [], []
    open_ = [np.arange(len(cells))] if len(cells) else []
    while open_:
        at = open_.pop()
        held, mine = many[at], counts[at]
        if held.sum() <= strip or len(at) == 1:
            box[at] = len(low)
            low.append(mine.min(0))
            high.append(mine.max(0))
            cuts.append(-(-int(held.sum()) // strip))
            continue
        mean = np.average(mine, axis=0, weights=held)
        value = mine[:, np.average((mine - mean) ** 2, axis=0, weights=held).argmax()]
        below = np.cumsum(np.bincount(value, held))
        found = np.unique(value)
        edge = found[np.abs(below[found[:-1]] - held.sum() / 2).argmin()]
        open_ += [at[value <= edge], at[value > edge]]
    return box, np.array(low, np.int8).reshape(-1, 5), np.array(high, np.int8).reshape(-1, 5), np.array(cuts, np.int64)


def _near(low: np.ndarray, high: np.ndarray, one: int, radius: int) -> np.ndarray:
    """Boxes that may hold fingerprints within the radius of those of a box."""
    gap = np.maximum(np.maximum(low - high[one], low[one] - high), 0)
    return np.flatnonzero((gap[:, 0] <= radius) & (gap[:, 1:].sum(1) <= radius))


def strips_met(fps: DataFrame, radius: int = RADIUS, strip: int = STRIP) -> DataFrame:
    """one, two (numbers of strips that may hold links between them) and ``fps`` of one of them; a strip meets itself in one row."""
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)) * 17**k for k in range(4)), F.lit(0))
    counted = fps.select("fp", cell.alias("cell"))
    # 17^4 cells at most, whatever the corpus.
    found = counted.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").toPandas()
    box, low, high, cuts = _boxes(found["cell"].to_numpy(np.int64), found["n"].to_numpy(np.int64), strip)
    first = np.cumsum(cuts) - cuts
    dealt = pd.DataFrame({"cell": found["cell"], "box": box, "first": first[box], "cuts": cuts[box]})
    kinds = "cell int, box long, first long, cuts long"

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        near = _near(low, high, int(rows["box"].iloc[0]), radius)
        others = np.concatenate([np.arange(first[b], first[b] + cuts[b]) for b in near])
        return pd.DataFrame({"me": [key[0]], "fps": [np.sort(rows["fp"].to_numpy(np.int64)).tobytes()], "others": [others]})

    strips = (
        counted.join(F.broadcast(fps.sparkSession.createDataFrame(dealt, kinds)), "cell")
        .select("fp", "box", (F.col("first") + F.pmod(F.xxhash64("fp"), "cuts")).alias("me"))
        .groupBy("me")
        .applyInPandas(gather, "me long, fps binary, others array<long>")
    )
    return strips.select("me", "fps", F.explode("others").alias("other")).select(
        F.least("me", "other").alias("one"), F.greatest("me", "other").alias("two"), "fps"
    )


def links(fps: DataFrame, radius: int = RADIUS, strip: int = STRIP) -> DataFrame:
    """Distinct ``fp`` to links ``a``, ``b`` whose components are those of all pairs within the radius."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in rows["fps"]]
        if len(sets) == 1 and key[0] != key[1]:  # a cut by hash left the other strip empty
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = forest(sets[0], sets[1] if len(sets) > 1 else None, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return strips_met(fps, radius, strip).groupBy("one", "two").applyInPandas(compare, "a long, b long")


def groups(docs: DataFrame, *keep: str, words_each: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The columns named, ``fp``, ``root`` (smallest fingerprint that links reach, one for each component) and ``component_id``
    (smallest doc_id there, which components may share if ids are null or repeat) of every row."""
    hashed = stored(with_fingerprint(docs, *dict.fromkeys(["doc_id", *keep]), words_each=words_each), "fingerprints")
    first = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(first.select("fp"), radius))
    linked = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return hashed.join(linked.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_first(docs: DataFrame, words_each: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each group, with all its columns: the smallest doc_id, of repeated ids the smallest text hash.

    The rows are written with a number first, as a scan may be split otherwise after executors were lost. Rows are chosen by number
    alone; only numbers are shuffled against the texts.
    """
    row = free_name(docs, "row_")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hashed = numbered.select("doc_id", "text", F.col(row).alias("row_"), F.xxhash64("text").alias("h_"))
    found = groups(hashed, "row_", "h_", words_each=words_each, radius=radius)
    # Ordered minimum of a struct: combined before the shuffle, whatever the size of a group.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h_", "row_")
    chosen = found.groupBy("root").agg(F.min(rank).alias("best")).select(F.col("best.row_").alias(row))
    return numbered.join(chosen, row, "left_semi").select(*docs.columns)
