"""Periodic runs of words, found by recompression.

A run is a stretch of words that repeats with a period, at least twice and over ``min_length`` words, and cannot be
extended. The words of many texts, parted by symbols that occur once, are turned into a run-length grammar: blocks of equal symbols
become one symbol with their length, then neighbouring symbols of two random halves of the alphabet become pairs, in
turn, until every text is a few symbols. Equal stretches are cut alike at every level but for a symbol or two at their
ends, so the longest common extension of two places climbs the levels while symbols agree and comes down where they
differ, with one comparison a level. Names are given by equality, not by hash, so extensions are exact.

A run of period p of two periods or more covers two neighbouring points of the grid 0, p, 2p, … of its text. Grid points with
equal words are extended to both sides; what reaches two periods is a run. All grids of a batch are handled at once.

Texts are independent, so nothing is shuffled: a hot source is no more work than any other. A text is one row and is searched
whole by one task, in time of n log n and memory of n.

Edge cases: null and empty texts have no words and no runs. Repeated rows give repeated results. Columns that are kept may
have any name but those of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymart.llm.common import slices, utf8

MIN_LENGTH = 12
#: Words searched together, and grid points looked at together.
BATCH_WORDS = 300_000
GRID_POINTS = 4_000_000
#: The grammar stops growing when every text has this many symbols or fewer.
TOP_SYMBOLS = 4

RESULT = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass
class Level:
    """A sequence of symbols, and how it is cut into the symbols of the next level."""

    symbols: np.ndarray
    blocks: bool  # cut into blocks of equal symbols, else into pairs and single symbols
    first: np.ndarray  # whether a symbol begins a symbol of the next level
    parent: np.ndarray  # the place of that symbol
    start: np.ndarray  # the places where next symbols begin, and the end

    @classmethod
    def cut(cls, symbols: np.ndarray, blocks: bool, first: np.ndarray) -> Level:
        return cls(symbols, blocks, first, np.cumsum(first) - 1, np.append(np.flatnonzero(first), len(symbols)))

    def mirrored(self) -> Level:
        last = np.append(self.first[1:], True)
        return Level.cut(self.symbols[::-1], self.blocks, last[::-1])


@dataclass
class Grammar:
    levels: list[Level]
    top: np.ndarray

    def mirrored(self) -> Grammar:
        return Grammar([level.mirrored() for level in self.levels], self.top[::-1])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols agree from the places x and y of the lowest level on; x and y are never the same place."""
        parted = []  # for each level: the queries that differ there, and their places
        who, px, py = np.arange(len(x)), x, y
        for level in self.levels:
            same = level.symbols[px] == level.symbols[py]
            parted.append((who[~same], px[~same], py[~same]))
            who, px, py = who[same], px[same], py[same]
            inside = ~(level.first[px] & level.first[py])
            if level.blocks:
                rx, ry = level.start[level.parent[px] + 1] - px, level.start[level.parent[py] + 1] - py
                uneven = rx != ry
                if uneven.any():
                    step = np.minimum(rx, ry)[uneven]
                    more = (who[uneven], px[uneven] + step, py[uneven] + step)
                    parted[-1] = tuple(np.concatenate(both) for both in zip(parted[-1], more))
                    who, px, py, rx, inside = (a[~uneven] for a in (who, px, py, rx, inside))
                step = np.where(inside, rx, 0)
            else:
                step = inside.astype(np.int64)
            px, py = level.parent[px + step], level.parent[py + step]
        top, done = self.top, []
        while len(who):
            same = top[px] == top[py]
            done.append((who[~same], px[~same], py[~same]))
            who, px, py = who[same], px[same] + 1, py[same] + 1
        parted.append(tuple(np.concatenate(both) for both in zip(*done)) if done else (who, px, py))

        who, px, py = parted[-1]
        for level, more in zip(reversed(self.levels), reversed(parted[:-1])):
            ex, ey = level.start[px + 1], level.start[py + 1]
            px, py = level.start[px], level.start[py]
            same = level.symbols[px] == level.symbols[py]
            step = np.where(same, np.minimum(ex - px, ey - py) if level.blocks else 1, 0)
            who, px, py = (np.concatenate(both) for both in zip((who, px + step, py + step), more))
        agree = np.empty(len(x), np.int64)
        agree[who] = px - x[who]
        return agree


def recompress(symbols: np.ndarray, n_shared: int, seed: int = 0x9E3779B97F4A7C15) -> Grammar:
    """Grammar of a sequence whose symbols from ``n_shared`` on occur once and part its texts; it begins and ends with one."""
    levels, names = [], int(symbols.max()) + 1
    borders = names
    mix = seed | 1

    def named(keys: np.ndarray) -> np.ndarray:
        nonlocal names
        codes, distinct = pd.factorize(keys)
        codes = codes + names
        names += len(distinct)
        return codes

    while True:
        fresh = np.empty(len(symbols), bool)
        fresh[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
        if not fresh.all():
            level = Level.cut(symbols, True, fresh)
            levels.append(level)
            times = np.diff(level.start)
            symbols = symbols[fresh]
            many = times > 1
            symbols[many] = named(symbols[many] << 31 | times[many])
        border = (symbols >= n_shared) & (symbols < borders)
        if np.diff(np.flatnonzero(border)).max(initial=0) - 1 <= TOP_SYMBOLS:
            return Grammar(levels, symbols)
        mix = (mix * 0xD1342543DE82EF95 + 2) % 2**64  # odd at every level
        right = (symbols.astype(np.uint64) * np.uint64(mix) >> np.uint64(47) & np.uint64(1)).astype(bool)
        pair = ~right[:-1] & right[1:] & ~border[:-1] & ~border[1:]
        if not pair.any():
            continue
        first = np.append(True, ~pair)
        level = Level.cut(symbols, False, first)
        levels.append(level)
        left = np.append(pair, False)
        at = np.flatnonzero(left)
        whole = symbols.copy()
        whole[at] = named(symbols[at] << 31 | symbols[at + 1])
        symbols = whole[first]


def _grids(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and period of all neighbouring grid points, a bounded number at a time."""
    half = sizes // 2
    texts = np.repeat(np.arange(len(sizes)), half)
    periods = np.arange(len(texts)) - np.repeat(np.cumsum(half) - half, half) + 1
    points = (sizes[texts] - 1) // periods
    ends = np.cumsum(points)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GRID_POINTS, "right")))
        n = points[a:b]
        row = np.repeat(np.arange(a, b), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield texts[row], nth * periods[row], periods[row]
        a = b


def runs_of(ids: list[np.ndarray], n_shared: int, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of all runs of sequences of numbers below ``n_shared``, by text, start and period."""
    sizes = np.array([len(x) for x in ids], np.int64)
    searched = np.flatnonzero(sizes >= max(min_length, 2))
    none = np.empty(0, np.int64)
    if not len(searched):
        return none, none, none, none
    sizes = sizes[searched]
    whole = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    whole[0] = n_shared
    for k, t in enumerate(searched):
        whole[begins[k] : begins[k] + sizes[k]] = ids[t]
        whole[begins[k] + sizes[k]] = n_shared + 1 + k
    grammar, back, found = None, None, []
    for text, place, period in _grids(sizes):
        i = begins[text] + place
        equal = np.flatnonzero(whole[i] == whole[i + period])
        text, i, period = text[equal], i[equal], period[equal]
        if not len(i):
            continue
        if grammar is None:
            grammar = recompress(whole, n_shared)
            back = grammar.mirrored()
        after = grammar.extension(i, i + period)
        before = back.extension(len(whole) - i, len(whole) - i - period)
        long = after + before >= np.maximum(period, min_length - period)
        found.append(np.stack([text, i - before, i + period + after, period])[:, long])
    if not found:
        return none, none, none, none
    text, start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    text, start, end, period = (a[order] for a in (text, start, end, period))
    # The smallest period of a stretch: a run is also found by each of its multiples.
    least = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    text, start, end, period = (a[least] for a in (text, start, end, period))
    order = np.lexsort((period, start))
    text, start, end, period = (a[order] for a in (text, start, end, period))
    return searched[text], start - begins[text], end - start, period


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    if len(start):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
    return b" ".join(words)


def _searched(texts: list[list[bytes]], min_length: int) -> list[pa.Array]:
    sizes = np.array([len(w) for w in texts], np.int64)
    flat = pa.array([w for words in texts for w in words], pa.large_binary()).dictionary_encode()
    ids = np.split(flat.indices.to_numpy().astype(np.int64), np.cumsum(sizes)[:-1])
    text, start, length, period = runs_of(ids, len(flat.dictionary), min_length)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    runs = pa.ListArray.from_arrays(
        pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()) for a in (start, length, period)], names=["start", "length", "period"])
    )
    kept = [_collapsed(w, start[a:b], length[a:b], period[a:b]) for w, a, b in zip(texts, cuts[:-1], cuts[1:])]
    return [pa.array(sizes), runs.cast(_RUNS), pa.array(kept, pa.binary()).cast(pa.string())]


def find_runs(
    docs: DataFrame,
    *keep: str,
    min_length: int = MIN_LENGTH,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """The columns named, then ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the words, without those that
    stand in a run behind its first period, joined by single spaces.

    ``rewrite``, given the first column kept and the words of a text, returns the words to search instead.
    """
    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    columns = list(dict.fromkeys(keep))
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns] + [f"{c} {t}" for c, t in RESULT.items()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = batch.column(0).to_pylist() if rewrite else None
            texts, begin, many = [], 0, 0
            for k, text in enumerate(utf8(batch)):
                words = text.split()  # of bytes: at ASCII white space only
                texts.append(rewrite(keys[k], words) if rewrite else words)
                many += len(words)
                if many >= BATCH_WORDS or k == batch.num_rows - 1:
                    part = batch.slice(begin, len(texts))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *_searched(texts, min_length)], [*columns, *RESULT])
                    texts, begin, many = [], k + 1, 0

    return kept.mapInArrow(search, schema)
