"""Exact top-k search by inner product: a paged M-tree, searched best first.

Vectors of integers are put on a sphere: one more component, sqrt(M - |x|²) with M the greatest squared length, makes Euclidean
distance to a query (with zero there) fall as the inner product grows, so the search for the greatest product is a search for the
nearest point, in a metric space.

* **Tree.** Its root entries are vectors of a bounded sample (``MAX_ROOTS``). Every vector goes below the nearest one. Below a
  root entry, subtrees of bounded size (a larger share is split by hash) are grown by a task each: pages of at
  most ``PAGE`` entries, which hold an object, the covering radius of what lies below it, and its distance to the object that the
  page hangs on. All pages are rows of a table in the shared folder.
* **Search.** A query first searches the subtree where it would be placed itself; the k-th score there bounds it. With that bound
  it goes to all subtrees whose covering radius does not exclude them. In a subtree pages are taken from a heap by the
  least distance possible, until that exceeds the k-th. Stored distances to the parent exclude entries before their own
  distance is computed: |d(query, parent) - d(entry, parent)| - radius is never more than what lies below can reach.
* **Copies.** Of one vector's rows, those behind the first k + 1 by id can be in no result, so a vector is stored once with these
  ids, however many rows hold it; and it is searched for once, however many queries ask for it. Both are bounded
  ranks, combined before the shuffle.

Products are exact: matrix products run in doubles while all sums stay below 2^53, else in 64-bit integers. Bounds compare with a
slack above the rounding error, so no result is lost.

Edge cases: vectors that are null, hold a null, or have a squared length of 2^60 or more (products could pass 64 bits) take no part, neither as
query nor as candidate. Shorter vectors count as filled up with zeros; an empty one scores 0. Ties go to the smaller id,
null ids last. Rows that share id and vector are distinct rows: a query leaves out one of them, itself. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymart.llm.common import slices, stored

K = 10
#: Entries of a page; page entries made of a split.
PAGE = 64
#: Root entries at most (a square root of the vectors, divided by ROOTS_PER), and vectors of a subtree at most, on average.
MAX_ROOTS = 4096
ROOTS_PER = 4
SUBTREE = 16_384
#: Bytes of root entries at most, as they are broadcast, and of vectors in a subtree, as one task holds them.
ROOT_BYTES = 16 << 20
SUBTREE_BYTES = 32 << 20
#: Distinct queries that meet a copy of a subtree in one task, on average.
QUERIES = 1 << 20
#: Copies of a query's result that its rows are joined to, so that no vector's rows meet in one task.
SALTS = 16
_EXACT = 2**51
_LONGEST = 2.0**60


class Space(NamedTuple):
    """Components of a vector, and the greatest squared length."""

    width: int
    top: int

    def matrix(self, keys: list[bytes]) -> np.ndarray:
        size = 8 * self.width
        ints = np.frombuffer(b"".join(k[:size].ljust(size, b"\0") for k in keys), np.int64).reshape(len(keys), self.width)
        return ints.astype(np.float64) if self.top < _EXACT else ints

    def lengths(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors * vectors).sum(1)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances between stored vectors."""
        nx, ny = self.lengths(x), self.lengths(y)
        sx, sy = (np.sqrt(np.maximum(self.top - n, 0).astype(np.float64)) for n in (nx, ny))
        square = (nx[:, None] + ny[None] - 2 * (x @ y.T)).astype(np.float64) + (sx[:, None] - sy[None]) ** 2
        return np.sqrt(np.maximum(square, 0))

    def distance(self, square: float | int, products: np.ndarray) -> np.ndarray:
        """Distances of a query of that squared length to stored vectors, by their products."""
        return np.sqrt(np.maximum((square + self.top - 2 * products).astype(np.float64), 0))

    def slack(self, square: float) -> float:
        return 1e-9 * (math.sqrt(self.top) + math.sqrt(square) + 1)


class Page(NamedTuple):
    vectors: np.ndarray
    parent: np.ndarray  # distance of each entry to the object that the page hangs on
    radius: np.ndarray  # covering radius of each entry; none on a leaf
    child: np.ndarray  # page below each entry; none on a leaf
    ids: list  # on a leaf: the ids of each vector


def grow(space: Space, vectors: np.ndarray, ids: list, to_root: np.ndarray) -> list[Page]:
    """Pages of a subtree; page 0 hangs on the root entry, whose distances are given."""
    pages: dict[int, Page] = {}
    todo, number = [(np.arange(len(vectors)), to_root, 0)], 1
    none = np.empty(0)
    while todo:
        at, parent, page = todo.pop()
        if len(at) <= PAGE:
            pages[page] = Page(vectors[at], parent, none, none.astype(np.int32), [ids[i] for i in at])
            continue
        fan = min(PAGE, -(-2 * len(at) // PAGE))
        chosen = np.arange(fan) * len(at) // fan
        apart = space.apart(vectors[at], vectors[at[chosen]])
        group = apart.argmin(1)
        if np.bincount(group).max() > 0.9 * len(at):  # no centres to be had: rings around the parent
            group[np.argsort(parent, kind="stable")] = np.arange(len(at)) * fan // len(at)
        used = np.unique(group)
        radius = []
        for g in used:
            below = np.flatnonzero(group == g)
            radius.append(apart[below, g].max())
            todo.append((at[below], apart[below, g], number + len(radius) - 1))
        objects = chosen[used]
        pages[page] = Page(
            vectors[at[objects]], parent[objects], np.array(radius), np.arange(number, number + len(used), dtype=np.int32), []
        )
        number += len(used)
    return [pages[k] for k in range(number)]


class Searched(NamedTuple):
    best: list  # (minus score, id is null, id, whether the vector is the query's own), best first
    computed: int  # products computed


def best_first(space: Space, pages: list[Page], query: np.ndarray, k: int, to_root: float, bound: int | None) -> Searched:
    """The k best rows of a subtree, without those below ``bound``, a score that is not to be missed."""
    square = (query * query).sum()
    slack = space.slack(float(square))
    least = bound
    reach = math.inf if least is None else float(space.distance(square, np.array([least]))[0]) + slack
    heap, best, computed = [(0.0, 0, to_root)], [], 0
    while heap:
        nearest, number, to_parent = heapq.heappop(heap)
        if nearest > reach:
            break
        page = pages[number]
        near = np.abs(to_parent - page.parent)
        if len(page.child):
            near = near - page.radius
        open_ = np.flatnonzero(near <= reach)
        if not len(open_):
            continue
        products = page.vectors[open_] @ query
        computed += len(open_)
        if len(page.child):
            to_entry = space.distance(square, products)
            low = to_entry - page.radius[open_]
            for e in np.flatnonzero(low <= reach):
                heapq.heappush(heap, (max(float(low[e]), 0.0), int(page.child[open_[e]]), float(to_entry[e])))
            continue
        good = np.arange(len(open_)) if least is None else np.flatnonzero(products >= least)
        if not len(good):
            continue
        for e in good:
            entry = open_[e]
            own = bool((page.vectors[entry] == query).all())
            best += [(-int(products[e]), i is None, i or 0, own) for i in page.ids[entry]]
        best = heapq.nsmallest(k, best)
        if len(best) == k:
            least = -best[-1][0]
            reach = float(space.distance(square, np.array([least]))[0]) + slack
    return Searched(best, computed)


def _packed(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``asks``, ``vec`` to ``vec_id``, ``asks``, ``key`` (the components, without zeros at the end), ``norm``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vec = batch.column("vec")
            flat = vec.flatten()
            missing = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([n or 0 for n in vec.value_lengths().to_pylist()], np.int64)
            end = np.cumsum(size)
            row = np.repeat(np.arange(len(size)), size)
            long = np.bincount(row, values.astype(np.float64) ** 2, len(size))
            good = vec.is_valid().to_numpy(zero_copy_only=False) & (long < _LONGEST) & (np.bincount(row, missing, len(size)) == 0)
            with np.errstate(over="ignore"):
                sums = np.append(0, np.cumsum(values * values))  # may wrap; differences of good rows are exact
                norm = sums[end] - sums[end - size]
            at = np.flatnonzero(good)
            parts = [values[end[i] - size[i] : end[i]] for i in at]
            keys = [v[: np.flatnonzero(v)[-1] + 1].tobytes() if v.any() else b"" for v in parts]
            kept = batch.select(["vec_id", "asks"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(keys, pa.binary()), pa.array(norm[at])], ["vec_id", "asks", "key", "norm"]
            )

    return rows.mapInArrow(pack, "vec_id long, asks boolean, key binary, norm long")


def _located(space: Space, roots: list[bytes]):
    """Adds the nearest root entry and its distance to rows with a ``key`` and its ``norm``; queries are at the centre, not on the sphere."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = space.matrix(roots)
        for batch in slices(batches):
            if batch.num_rows:
                apart = space.apart(space.matrix(batch.column("key").to_pylist()), centres)
                nearest = apart.argmin(1)
                d = pa.array(apart[np.arange(len(nearest)), nearest])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), d], [*batch.schema.names, "root", "d"])

    return locate


_PAGES = "root int, part int, page int, vectors binary, parent binary, radius binary, child binary, ids array<array<long>>"


def _planted(space: Space):
    names = [c.split()[0] for c in _PAGES.split(", ")]

    def plant(key: tuple, rows: pa.Table) -> pa.Table:
        root, part = (k.as_py() for k in key)
        vectors = space.matrix(rows["key"].to_pylist())
        pages = grow(space, vectors, rows["ids"].to_pylist(), rows["d"].to_numpy())
        n = len(pages)
        return pa.table(
            [
                pa.array([root] * n, pa.int32()),
                pa.array([part] * n, pa.int32()),
                pa.array(range(n), pa.int32()),
                *[pa.array([getattr(p, c).tobytes() for p in pages], pa.binary()) for c in ("vectors", "parent", "radius", "child")],
                pa.array([p.ids for p in pages], pa.list_(pa.list_(pa.int64()))),
            ],
            names=names,
        )

    return plant


def _searching(space: Space, roots: list[bytes], k: int):
    """Rows in order: the pages of a subtree, then its queries, a query at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = space.matrix(roots)
        here, pages = None, []
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                if row["page"] is not None:
                    if (row["root"], row["part"], row["block"]) != here:
                        here, pages = (row["root"], row["part"], row["block"]), []
                    vectors = np.frombuffer(row["vectors"], centres.dtype).reshape(-1, space.width)
                    pages.append(
                        Page(
                            vectors,
                            np.frombuffer(row["parent"]),
                            np.frombuffer(row["radius"]),
                            np.frombuffer(row["child"], np.int32),
                            row["ids"],
                        )
                    )
                    continue
                query = space.matrix([row["vectors"]])[0]
                to_root = float(space.distance((query * query).sum(), centres[row["root"]] @ query))
                found = best_first(space, pages, query, k, to_root, row["bound"])
                out += [(row["qid"], -s, None if null else i, own) for s, null, i, own in found.best]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                ["qid", "score", "vec_id", "own"],
            )

    return search


class Tree:
    """An index over ``vec_id`` (long), ``vec`` (array of long), for results of up to k rows besides the query's own."""

    def __init__(self, rows: DataFrame, k: int = K):
        packed = _packed(rows.select("vec_id", F.lit(False).alias("asks"), "vec"))
        self.k = k + 1
        nulls_last = F.col("vec_id").asc_nulls_last()
        first = packed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(nulls_last))).where(F.col("nth") <= self.k)
        listed = F.array_sort(F.collect_list(F.struct("nth", "vec_id")))
        distinct = stored(first.groupBy("key", "norm").agg(F.transform(listed, lambda x: x["vec_id"]).alias("ids")), "vectors")
        n, top, size = distinct.agg(F.count("*"), F.max("norm"), F.max(F.length("key"))).first()
        self.space = Space(max((size or 0) // 8, 1), top or 0)
        row = 8 * self.space.width
        roots = max(1, min(MAX_ROOTS, ROOT_BYTES // row, math.ceil(math.sqrt(n) / ROOTS_PER)))
        self.roots = [r["key"] for r in distinct.orderBy(F.xxhash64("key"), "key").limit(roots).select("key").collect()]
        if not self.roots:
            return
        located = distinct.mapInArrow(_located(self.space, self.roots), "key binary, norm long, ids array<long>, root int, d double")
        placed = stored(located, "placed")
        most = max(PAGE, min(SUBTREE, SUBTREE_BYTES // row))
        self.parts, self.radius = [0] * len(self.roots), [0.0] * len(self.roots)
        for r in placed.groupBy("root").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect():  # MAX_ROOTS rows at most
            self.parts[r["root"]], self.radius[r["root"]] = -(-r["n"] // most), r["radius"]
        self.subtrees = sum(self.parts)
        split = placed.withColumn("part", self._part()).repartition(max(1, min(self.subtrees, 20_000)), "root", "part")
        self.pages = stored(split.groupBy("root", "part").applyInArrow(_planted(self.space), _PAGES), "pages")

    def _part(self) -> Column:
        parts = F.array(*[F.lit(p) for p in self.parts])
        return F.pmod(F.xxhash64("key"), F.element_at(parts, F.col("root") + 1)).cast("int")

    def _routes(self):
        """Other subtrees that a query with a bound may find more in."""
        space, roots, radius, parts = self.space, self.roots, np.array(self.radius), self.parts

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = space.matrix(roots)
            for batch in slices(batches):
                for row in batch.to_pylist():
                    query = space.matrix([row["key"]])[0]
                    square = (query * query).sum()
                    reach = math.inf
                    if row["bound"] is not None:
                        reach = float(space.distance(square, np.array([row["bound"]]))[0]) + space.slack(float(square))
                    near = np.flatnonzero(space.distance(square, centres @ query) - radius <= reach)
                    to = [(int(r), p) for r in near for p in range(parts[r]) if (r, p) != (row["root"], row["part"])]
                    n = len(to)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["qid"]] * n, pa.int64()),
                            pa.array([row["key"]] * n, pa.binary()),
                            pa.array([row["bound"]] * n, pa.int64()),
                            pa.array([r for r, _ in to], pa.int32()),
                            pa.array([p for _, p in to], pa.int32()),
                        ],
                        ["qid", "key", "bound", "root", "part"],
                    )

        return route

    def _found(self, asked: DataFrame, blocks: int) -> DataFrame:
        """``qid``, ``key``, ``bound``, ``root``, ``part`` to the best rows of that subtree."""
        pages = self.pages.withColumns(
            {
                "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
                "qid": F.lit(None).cast("long"),
                "bound": F.lit(None).cast("long"),
            }
        )
        queries = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumnRenamed("key", "vectors")
        dealt = (
            pages.unionByName(queries, allowMissingColumns=True)
            .repartition(max(1, min(self.subtrees * blocks, 20_000)), "root", "part", "block")
            .sortWithinPartitions("root", "part", "block", F.col("page").asc_nulls_last())
        )
        return dealt.mapInArrow(_searching(self.space, self.roots, self.k), "qid long, score long, vec_id long, own boolean")

    def search(self, rows: DataFrame) -> DataFrame:
        """The best k rows for each of some rows of the index, without the row itself: ``query_id``, ``rank``, ``vec_id``, ``score``."""
        spark = rows.sparkSession
        if not self.roots:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        asking = _packed(rows.select("vec_id", F.lit(True).alias("asks"), "vec")).select(F.col("vec_id").alias("query_id"), "key", "norm")
        home = asking.select("key", "norm").distinct().mapInArrow(_located(self.space, self.roots), "key binary, norm long, root int, d double")
        asked = stored(
            home.withColumn("part", self._part()).select(
                F.monotonically_increasing_id().alias("qid"), "key", F.lit(None).cast("long").alias("bound"), "root", "part"
            ),
            "queries",
        )
        blocks = max(1, -(-asked.count() // QUERIES))
        near = stored(self._found(asked, blocks), "near")
        bounds = near.groupBy("qid").agg(F.when(F.count("*") >= self.k, F.min("score")).alias("bound"))
        routed = asked.drop("bound").join(bounds, "qid", "left").select("qid", "key", "bound", "root", "part")
        far = self._found(routed.mapInArrow(self._routes(), "qid long, key binary, bound long, root int, part int"), blocks)
        order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        best = near.unionByName(far).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= self.k)
        lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "vec_id", "own"))).alias("best"))
        answers = asked.select("qid", "key").join(lists, "qid").select("key", "best")
        salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = F.array_position(F.transform("best", lambda x: x["own"] & x["vec_id"].eqNullSafe(F.col("query_id"))), True)
        others = F.filter("best", lambda x, i: i + 1 != F.col("mine"))
        return (
            asking.select("query_id", "key", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int").alias("salt"))
            .join(salted, ["key", "salt"])
            .withColumn("mine", mine)
            .select("query_id", F.posexplode(F.slice(others, 1, self.k - 1)).alias("at", "row"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "row.vec_id", "row.score")
        )
