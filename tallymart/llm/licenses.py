"""License scans by diagonal voting.

Every word k-gram of a text is hashed by a rolling polynomial and joined in Spark to the positions of the templates' k-grams. A copy
of a template puts its hits on one diagonal (position in the text less position in the template). Hits are aggregated by
diagonal; a full diagonal is a copy as it stands, others are merged with their neighbours, which an inserted or
missing word puts next to each other, and verified by aligning the words around them with the template: a word may be inserted,
missing or changed for every :data:`EDIT_EACH` words of the template, but never a word that tells licenses apart (numbers in notices,
and what one template has and a near one has not). Templates are notices and whole licenses, and may be given as a table. Short templates are sought by pairs of words. The join compares the words
themselves besides the hash. k-grams whose hash no template has cannot match and are left out before the join.

Edge cases: null and empty texts have no words and no labels. Rows are numbered by the scan and judged one by one, so
repeated rows and ids repeat in the result. Overlapping and repeated places all count. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tallymart.llm.common import slices, stored, utf8

BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Further labels, by the words of their usual notices.
OWN = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
]
# Texts of whole licenses, as published.
_BSD_2 = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
WHOLE = [("bsd-2", _BSD_2 + _BSD_END), ("bsd-3", _BSD_2 + _BSD_3 + _BSD_END), ("mit-text", _MIT), ("isc", _ISC)]
#: k-gram of templates of SHORT words and more, and of shorter ones (their own length where that is less).
GRAM = 4
SHORT_GRAM = 2
SHORT = 12
#: Share of a template's words that merged diagonals must hold, and the words of a template for each edit (one edit at least).
LEAST_COVER = 0.6
EDIT_EACH = 4
#: Templates of fewer words must hold all of them.
LEAST_WORDS = 4
#: Words that name another license beside a template's words, besides numbers and what the templates themselves differ in.
VARIANTS = {"lesser", "library", "affero", "sharealike", "noncommercial", "noderivatives", "noderivs", "sa", "nc", "nd"}
#: Diagonals this far apart belong together, or as far as the template's edits may shift them.
NEIGHBOUR = 3
#: Templates of so many words are whole licenses, whose numbering may differ.
LONG = 60
#: Bytes of templates, which every task holds.
MAX_TEMPLATES = 16 << 20

_BREAKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_PRIME = 1_000_003


def words_of(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.lower().translate(_BREAKS).split()


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(codes) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(_PRIME) + codes[j : len(codes) - k + 1 + j]
    return out


class _Codes(dict):
    """Hash of each word that a template has, zero for others."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _codes(templates: list[tuple[str, str]]) -> _Codes:
    return _Codes({w: xxhash.xxh64_intdigest(w) | 1 for _, t in templates for w in t.encode().split()})


def gram_size(words: list) -> int:
    return min(GRAM if len(words) >= SHORT else SHORT_GRAM, len(words))


def fits(template: list, text: list, telling: set, most: int) -> list[tuple[int, int, int]]:
    """start, end, edits of the places of a text that a template fits with ``most`` edits at most, best first, not overlapping.

    Words in ``telling`` are neither inserted, missing nor changed; templates of few words miss and change none."""
    n, far, unit = len(template), most + 1, len(text) + 2
    fixed = np.array([n < LEAST_WORDS or w in telling for w in template], bool)
    code = {w: k for k, w in enumerate(dict.fromkeys(template))}
    mine = np.array([code[w] for w in template], np.int64)
    # Fewest edits first, then the latest start: edits and start in one number, by place in the template.
    lost = np.concatenate([[0], np.cumsum(np.where(fixed, far, 1))]) * unit
    swap = np.where(fixed, far, 1) * unit
    never = unit * far * (n + 2)
    column, ends = lost.copy(), []
    for j, word in enumerate(text):
        told = word in telling
        # A word of the text more, the same word or another one, then words of the template that are missing.
        now = column + (far if told else 1) * unit
        other = np.full(n, far * unit) if told else swap
        now[1:] = np.minimum(now[1:], column[:-1] + np.where(mine == code.get(word, -1), 0, other))
        # Before the first word found, the text's own word stands in for the missing one.
        now[0] = never if told else -(j + 1)
        now = np.minimum.accumulate(now - lost) + lost
        now[0] = -(j + 1)
        column = now
        edits = -(-int(now[n]) // unit)
        if edits <= most:
            ends.append((edits, edits * unit - int(now[n]), j + 1))
    out: list[tuple[int, int, int]] = []
    for edits, start, end in sorted(ends):
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, edits))
    return out


def most_edits(words: list, least_cover: float) -> int:
    return min(max(1, len(words) // EDIT_EACH), int(len(words) * (1 - least_cover) + 1e-9))


def _may_fit(template: list, text: list, most: int) -> bool:
    """Whether a text has enough of the template's words, wherever they stand."""
    return (Counter(template) & Counter(text)).total() >= len(template) - most


def telling_words(templates: list[tuple[str, str]], least_cover: float = LEAST_COVER) -> list[set[str]]:
    """For each template: variants, numbers (templates of LONG words and more may be numbered otherwise), and the words without which
    it would fit a template of another label, or that one it."""
    words = [t.split() for _, t in templates]
    numbers = {w for t in words for w in t if any(c.isdigit() for c in w)}
    told = [VARIANTS | (numbers if len(t) < LONG else set()) for t in words]
    found = [set(t) for t in told]
    for i, (name, _) in enumerate(templates):
        most = most_edits(words[i], least_cover)
        for j, (other, _) in enumerate(templates):
            if name != other and len(words[i]) >= LEAST_WORDS and _may_fit(words[i], words[j], most):
                if fits(words[i], words[j], told[i], most):
                    found[i] |= set(words[i]) - set(words[j])
                    found[j] |= set(words[i]) - set(words[j])
    return found


class _Ids(dict):
    """Number of each word that a template has; of other words -1 for numbers, -2 for variants, zero for the rest."""

    def __missing__(self, word: bytes) -> int:
        return -2 if word.decode(errors="replace") in VARIANTS else -1 if any(48 <= b <= 57 for b in word) else 0


def _ids(templates: list[tuple[str, str]]) -> _Ids:
    return _Ids({w.encode(): k + 1 for k, w in enumerate(sorted({w for _, t in templates for w in t.split()}))})


def template_grams(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """A row for each template position: bounded by the templates' words."""
    code, rows = _codes(templates), []
    for number, (_, text) in enumerate(templates):
        words = text.encode().split()
        k = gram_size(words)
        hashes = _gram_hashes(np.array([code[w] for w in words], np.uint64), k).view(np.int64)
        for at, h in enumerate(hashes.tolist()):
            rows.append((number, at, k, h, b" ".join(words[at : at + k]).decode(), len(hashes), len(words)))
    return spark.createDataFrame(
        rows, "template int, t_at long, k int, hash long, gram string, t_grams long, t_words long"
    )


def grams(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """A row for each document (``at`` null, n_words, and if it has k-grams its words by template number) and for each k-gram
    that a template has."""
    code, ids = _codes(templates), _ids(templates)
    wanted: dict[int, list] = defaultdict(list)
    for _, t in templates:
        w = t.encode().split()
        wanted[gram_size(w)] += _gram_hashes(np.array([code[x] for x in w], np.uint64), gram_size(w)).tolist()
    sizes = {k: np.unique(np.array(v, np.uint64)) for k, v in sorted(wanted.items())}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = defaultdict(list)
            for row, text in enumerate(utf8(batch)):
                words = words_of(text)
                n = len(words)
                found = [(None, None, None, None)]
                codes = np.fromiter(map(code.__getitem__, words), np.uint64, n)
                known = codes != 0
                for k, asked in sizes.items():
                    if n < k:
                        continue
                    all_known = known[: n - k + 1].copy()
                    for j in range(1, k):
                        all_known &= known[j : n - k + 1 + j]
                    at = np.flatnonzero(all_known)
                    hashes = _gram_hashes(codes, k)[at]
                    there = np.isin(hashes, asked)
                    at, hashes = at[there], hashes[there].view(np.int64)
                    if len(at):
                        found += [
                            (p, k, h, b" ".join(words[p : p + k]).decode()) for p, h in zip(at.tolist(), hashes.tolist())
                        ]
                out["row"] += [row] * len(found)
                out["n_words"] += [n] * len(found)
                numbers = np.fromiter(map(ids.__getitem__, words), np.int32, n).tobytes() if len(found) > 1 else None
                out["words"] += [numbers] + [None] * (len(found) - 1)
                for name, values in zip(("at", "k", "hash", "gram"), zip(*found)):
                    out[name] += values
            taken = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id").take(taken),
                    batch.column("doc_id").take(taken),
                    pa.array(out["n_words"], pa.int64()),
                    pa.array(out["at"], pa.int64()),
                    pa.array(out["k"], pa.int32()),
                    pa.array(out["hash"], pa.int64()),
                    pa.array(out["gram"], pa.string()),
                    pa.array(out["words"], pa.binary()),
                ],
                ["row_id", "doc_id", "n_words", "at", "k", "hash", "gram", "words"],
            )

    return docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").mapInArrow(
        run, f"row_id long, doc_id {kind}, n_words long, at long, k int, hash long, gram string, words binary"
    )


def spans(found: DataFrame, templates: list[tuple[str, str]], least_cover: float = LEAST_COVER, exact: int = 0) -> DataFrame:
    """row_id, template, start, end (words, exclusive) and cover of every verified place; the first ``exact`` templates are only
    found as they stand."""
    # The templates are a parameter of a few hundred words.
    positions = F.broadcast(template_grams(found.sparkSession, templates))
    hits = found.where(F.col("at").isNotNull()).join(positions, ["k", "hash", "gram"])
    diagonals = hits.groupBy("row_id", "template", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.count("*").alias("n"), F.min("at").alias("start"), F.max(F.col("at") + F.col("k")).alias("end"),
        F.first("t_grams").alias("t_grams"), F.first("t_words").alias("t_words"),
    )
    full = diagonals.where("n = t_grams").select("row_id", "template", "start", "end", F.lit(1.0).alias("cover"))
    # What partly fills a diagonal; a place cannot be longer than its template by much, so groups stay short.
    order = Window.partitionBy("row_id", "template").orderBy("diagonal")
    near = F.greatest(F.lit(NEIGHBOUR), F.floor(F.col("t_words") / EDIT_EACH))
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > near) | (
        F.col("start") - F.lag("start").over(order) > F.col("t_words")
    )
    merged = (
        diagonals.where((F.col("n") < F.col("t_grams")) & (F.col("template") >= exact))
        .withColumn("group", F.sum(F.when(apart, 1).otherwise(0)).over(order))
        .groupBy("row_id", "template", "group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select("row_id", "template", "start", "end")
    )
    return full.unionByName(_verified(found, full, merged, templates, least_cover))


def _verified(found: DataFrame, full: DataFrame, merged: DataFrame, templates: list[tuple[str, str]], least_cover: float) -> DataFrame:
    """Places that alignment finds around merged diagonals, other than copies as they stand."""
    ids = _ids(templates)
    numbers = [[ids[w] for w in t.encode().split()] for _, t in templates]
    told = [
        {ids[w.encode()] for w in found} | ({-1, -2} if len(mine) < LONG else {-2})
        for found, mine in zip(telling_words(templates, least_cover), numbers)
    ]
    edits_of = [most_edits(mine, least_cover) for mine in numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                text = np.frombuffer(row["words"], np.int32)
                whole, seen = {(w["template"], w["start"]) for w in row["whole"] or []}, set()
                for c in row["asked"]:
                    k = c["template"]
                    n, first = len(numbers[k]), max(0, c["start"] - len(numbers[k]))
                    window = text[first : c["end"] + n].tolist()
                    if not {w for w in numbers[k] if w in told[k]} <= set(window) or not _may_fit(numbers[k], window, edits_of[k]):
                        continue
                    for start, end, edits in fits(numbers[k], window, told[k], edits_of[k]):
                        start, end = start + first, end + first
                        if any((k, at) in whole for at in range(start - n + 1, end)) or (k, start, end) in seen:
                            continue
                        seen.add((k, start, end))
                        out.append((row["row_id"], k, start, end, 1 - edits / n))
            made = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(m, t) for m, t in zip(made, kinds)], ["row_id", "template", "start", "end", "cover"])

    asked = merged.groupBy("row_id").agg(F.collect_list(F.struct("template", "start", "end")).alias("asked"))
    whole = full.groupBy("row_id").agg(F.collect_list(F.struct("template", "start")).alias("whole"))
    texts = found.where(F.col("at").isNull() & F.col("words").isNotNull()).select("row_id", "words")
    return texts.join(asked, "row_id").join(whole, "row_id", "left").mapInArrow(
        run, "row_id long, template int, start long, end long, cover double"
    )


def templates_of(table: DataFrame) -> list[tuple[str, str]]:
    """Templates from a table of label and text (such as license files); rows without label or words are none, repeated rows one.

    Templates are a parameter that every task holds, so a table of more than MAX_TEMPLATES bytes is an error."""
    rows = table.where("label IS NOT NULL AND text IS NOT NULL").select("label", "text").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > MAX_TEMPLATES:
        raise ValueError(f"templates have {size} bytes, more than {MAX_TEMPLATES}")
    return [(r["label"], r["text"]) for r in rows.orderBy("label", "text").collect()]


def _plain(templates) -> list[tuple[str, str]]:
    """Templates as words, those without words left out."""
    made = [(name, b" ".join(words_of(text.encode())).decode()) for name, text in templates]
    return [(name, text) for name, text in made if text]


def scan(docs: DataFrame, base=BASE, own=(*OWN, *WHOLE), least_cover: float = LEAST_COVER) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and places.

    ``own`` lists (label, text) or is a table of them."""
    base = _plain(base)
    templates = [*base, *_plain(templates_of(own) if isinstance(own, DataFrame) else own)]
    found = stored(grams(docs, templates), "grams")
    label = F.element_at(F.array(*[F.lit(name) for name, _ in templates]), F.col("template") + 1)
    is_base = (F.col("template") < len(base)) & (F.col("cover") == 1)
    places = (
        spans(found, templates, least_cover, len(base))
        .withColumn("label", label)
        .groupBy("row_id")
        .agg(
            F.sum(is_base.cast("long")).alias("n_base"),
            F.min(F.when(is_base, F.col("start"))).alias("first_word"),
            F.max(F.when(is_base, F.col("start"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(is_base | (F.col("template") >= len(base)), F.col("label")))), ",").alias("labels"),
            F.max("cover").alias("score"),
            F.sort_array(F.collect_list(F.struct("start", "end", "label", "cover"))).alias("places"),
        )
    )
    texts = found.where(F.col("at").isNull()).select("row_id", "doc_id", "n_words")
    return texts.join(places, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "places",
    )

