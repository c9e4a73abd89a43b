"""Packing token sequences by non-negative least squares over shallow length combinations.

Documents are tokenised once and cut at multiples of the window, which leaves whole windows and one rest each. The
histogram of lengths (as many rows as the window is long) is all the driver sees: it enumerates the combinations of up to
three lengths that fill a window, solves for non-negative repeat counts and rounds them to what is there. Residual pieces are packed
greedily, the longest first, each into what is left of the open sequence; the piece that does not fit is cut there, so that only the
last sequence is padded. The plan has patterns, not rows. Each piece gets its rank among pieces of its length from stored
per-partition counts and finds its slot in the plan by binary search.

Edge cases: null and empty texts hold the end id alone. Repeated rows are packed one by one. No documents give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymart.llm.common import slices, stored, strings
from tallymart.llm.tokens import byte_bpe
from tallymart.session import fresh_dir

WINDOW = 1024
END = 0

Pattern = tuple[tuple[int, ...], int]


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens; block and nth number the pieces of a length in a partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, block, seen = byte_bpe(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in slices(batches):
            rows = []
            for k, text in enumerate(strings(batch)):
                ids = bpe.encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    length = min(window, n - at)
                    rows.append((k, at, length, ids[4 * at : 4 * (at + length)], n, seen[length]))
                    seen[length] += 1
            row, start, length, ids, total, nth = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    *(pa.array(x, pa.int64()) for x in (start, length)),
                    pa.array(ids, pa.binary()),
                    *(pa.array(x, pa.int64()) for x in (total, [block] * len(row), nth)),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "block", "nth"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, block long, nth long"
    )


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ascending triples of the lengths that sum to the window; a missing length is zero."""
    there = np.zeros(window + 1, bool)
    there[lengths[lengths <= window]] = True
    there[0] = True
    values = np.flatnonzero(there)
    a, b = np.meshgrid(values, values, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    fine = (a <= b) & (b <= c)
    a, b, c = a[fine], b[fine], c[fine]
    fine = there[c]
    return np.stack([a[fine], b[fine], c[fine]], 1)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 30, entering: int = 200) -> np.ndarray:
    """Non-negative least squares by an active set that many combinations enter at once. ``histogram[0]`` is ignored."""
    m = len(combos)
    x = np.zeros(m)
    if not m:
        return x
    goal = histogram.astype(float)
    goal[0] = 0
    active = np.zeros(0, int)
    for _ in range(rounds):
        rest = goal - np.bincount(combos.ravel(), np.repeat(x, 3), len(goal))
        rest[0] = 0
        slope = rest[combos].sum(1)
        slope[active] = 0
        new = np.argsort(-slope, kind="stable")[:entering]
        new = new[slope[new] > 0.5]
        if not len(new):
            break
        active = np.concatenate([active, new])
        while len(active):
            a = np.zeros((len(goal), len(active)))
            np.add.at(a, (combos[active].ravel(), np.repeat(np.arange(len(active)), 3)), 1)
            a = a[1:]
            z = np.linalg.solve(a.T @ a + 1e-6 * np.eye(len(active)), a.T @ goal[1:])
            if (z > 1e-9).all():
                break
            active = active[z > 1e-9]
        x[:] = 0
        x[active] = z if len(active) else 0
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[Pattern], dict[int, int]]:
    """(lengths of a full sequence, number of such sequences), and how many pieces of each length are left, longest first."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    patterns: list[Pattern] = []
    if left[window]:
        patterns.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(np.flatnonzero(left), window)
    combos = combos[combos[:, 2] < window] if len(combos) else combos
    x = repeat_counts(combos, left)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        lengths = [int(v) for v in combos[k] if v]
        n = min(int(round(x[k])), *(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            patterns.append((tuple(lengths), n))
            for v in lengths:
                left[v] -= n
    return patterns, {int(v): int(left[v]) for v in np.flatnonzero(left)[::-1]}


def slots(patterns: list[Pattern], rest: dict[int, int]) -> tuple[dict[int, tuple[np.ndarray, ...]], dict[int, tuple[int, int]], int]:
    """Where the pieces of each length go, by rank: for patterns the first rank, copies in a sequence, first sequence and offset of
    the first copy; for the rest the first rank and its place in the run of residual pieces, which begins at the last value."""
    out, used, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, n in patterns:
        at = 0
        for v in dict.fromkeys(lengths):
            k = lengths.count(v)
            out[v].append((used[v], k, sequence, at))
            used[v] += n * k
            at += v * k
        sequence += n
    run, residual = 0, {}
    for v, n in rest.items():
        residual[v] = (used[v], run)
        run += v * n
    return {v: tuple(np.array(c, np.int64) for c in zip(*rows)) for v, rows in out.items()}, residual, sequence


def place(numbered: DataFrame, patterns: list[Pattern], rest: dict[int, int], window: int = WINDOW) -> DataFrame:
    """Rows with ``length`` and ``rank`` get sequence_id, offset and cut: how much of a residual piece still fits (0: all)."""
    book, residual, after = slots(patterns, rest)  # bounded by the number of patterns, which lengths bound, not rows
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "rank")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset, cut = (np.zeros(len(rank), np.int64) for _ in range(3))
            for v in np.unique(length).tolist():
                limit, run = residual.get(v, (1 << 62, 0))
                here = np.flatnonzero((length == v) & (rank < limit))
                if len(here):
                    first, copies, start, at = book[v]
                    k = np.searchsorted(first, rank[here], "right") - 1
                    nth = rank[here] - first[k]
                    sequence[here] = start[k] + nth // copies[k]
                    offset[here] = at[k] + (nth % copies[k]) * v
                here = np.flatnonzero((length == v) & (rank >= limit))
                if len(here):
                    where = run + (rank[here] - limit) * v
                    sequence[here], offset[here] = after + where // window, where % window
                    cut[here] = np.where(offset[here] + v > window, window - offset[here], 0)
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *map(pa.array, (sequence, offset, cut))], [*kept, "sequence_id", "offset", "cut"]
            )

    return numbered.mapInArrow(find, schema + ", sequence_id long, offset long, cut long")


def pack(docs: DataFrame, path: str, window: int = WINDOW, **derived: Column) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, and the ids.

    ``derived`` columns are computed from ``ids`` where the pieces lie and returned in their place.
    """
    folder = fresh_dir(docs.sparkSession, "pieces")
    cut = pieces(docs, path, window)
    cut.write.option("compression", "zstd").parquet(folder)
    cut = docs.sparkSession.read.schema(cut.schema).parquet(folder)
    counts = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    extra = {name: c.alias(name) for name, c in derived.items()} or {"ids": F.col("ids")}
    numbered = (
        cut.select("doc_id", "start", "length", "doc_tokens", *extra.values(), "block", "nth")
        .join(offsets, ["block", "length"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .drop("before")
    )
    placed = stored(place(numbered, *plan(histogram, window), window), "placed")
    names = ["doc_id", "start", "length", "doc_tokens", *extra, "sequence_id", "offset"]
    # Residual pieces that a sequence's end cuts: about one for each residual sequence.
    split = placed.where("cut > 0").drop("doc_id", "start", "doc_tokens", *extra)
    both = cut.where(F.col("length") < window).join(split, ["block", "length", "nth"])
    left, right = F.col("cut"), F.col("length") - F.col("cut")
    parts = F.array(
        F.struct(
            F.col("start"), left.alias("length"), F.substring("ids", F.lit(1), (4 * left).cast("int")).alias("ids"),
            F.col("sequence_id"), F.col("offset"),
        ),
        F.struct(
            (F.col("start") + left).alias("start"), right.alias("length"),
            F.substring("ids", (4 * left + 1).cast("int"), (4 * right).cast("int")).alias("ids"),
            (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        ),
    )
    halves = both.select("doc_id", "doc_tokens", F.explode(parts).alias("p")).select("doc_id", "doc_tokens", "p.*")
    return placed.where("cut = 0").select(names).unionByName(halves.withColumns(extra).select(names))
