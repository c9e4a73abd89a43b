"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Every document gets counts and shares (:data:`SHARES`). Rules are conjunctions of thresholds on the shares; each is
grown on two thirds of the labelled rows by information gain, pruned on the rest, and kept while it is precise.
Documents covered by a rule leave, and the next rule is sought among the others. The result is an ordered list
that becomes one Spark conditional expression.

Edge cases: null and empty texts have no words and all counts zero. Documents without a label, or with a null one,
are judged but not learned from; of several labels of a document the smallest counts, of several texts of an id the one with the least shares. Without rejected examples the
list is empty and the default verdict (keep) holds. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallymart.llm.common import slices, utf8

#: Labelled rows that a list is learned from, at most; chosen by the hash of the id.
MAX_LABELLED = 20_000
#: Least share of truly poor documents among those that a rule rejects.
LEAST_PRECISION = 0.97
MIN_WORDS = 50
REPEAT_PERCENT = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [
    "symbols_per_word",
    "upper_share",
    "marks_per_word",
    "repeat_share",
    "distinct_share",
    "dup_line_share",
    "chars_per_word",
    "words_per_line",
    "digits_per_word",
]
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?"
_DIGITS = b"0123456789"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUATION = bytes(range(0x80, 0xC0))


def _many(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = dict(zip(dict.fromkeys(words), range(n)))
    code = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    v = len(ids)
    if v < 1 << 20:
        key = (code[:-2] * v + code[1:-1]) * v + code[2:]
    else:
        pair = np.unique(code[:-2] * v + code[1:-1], return_inverse=True)[1]
        key = pair * v + code[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    covered = np.zeros(n, bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def document_stats(text: bytes) -> tuple:
    """Counts and shares of one text, in the order of COUNTS and SHARES."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else [text][: bool(n)]
    dup = len(lines) - len(set(lines))
    chars = len(text) - _many(text, _SPACES) - _many(text, _CONTINUATION)
    symbols, upper = _many(text, _SYMBOLS), _many(text, _UPPER)
    repeat = repeated_words(words)
    per = max(n, 1)
    return (
        n, chars, symbols, dup, repeat,
        symbols / per, upper / max(upper + _many(text, _LOWER), 1), _many(text, _MARKS) / per, repeat / per,
        len(set(words)) / per, dup / max(len(lines), 1), chars / per, n / max(len(lines), 1), _many(text, _DIGITS) / per,
    )


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named, then COUNTS and SHARES of the text."""
    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(
        [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep]
        + [f"{c} long" for c in COUNTS]
        + [f"{c} double" for c in SHARES]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(zip(*map(document_stats, utf8(batch))))
            made = [pa.array(c, pa.int64()) for c in columns[: len(COUNTS)]]
            made += [pa.array(c, pa.float64()) for c in columns[len(COUNTS) :]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *made], [*keep, *COUNTS, *SHARES]
            )

    return kept.mapInArrow(measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    share: str
    above: bool
    limit: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, SHARES.index(self.share)]
        return v >= self.limit if self.above else v <= self.limit

    def column(self) -> Column:
        return F.col(self.share) >= self.limit if self.above else F.col(self.share) <= self.limit


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: np.ndarray, poor: np.ndarray) -> Condition | None:
    """The threshold with the greatest information gain for the poor rows."""
    p, n = poor.sum(), (~poor).sum()
    if not p or not n:
        return None
    before, best, found = np.log2(p / (p + n)), 0.0, None
    for k, share in enumerate(SHARES):
        order = np.argsort(x[:, k], kind="stable")
        v, y = x[order, k], poor[order]
        cut = np.flatnonzero(v[1:] != v[:-1])
        if not len(cut):
            continue
        left = np.cumsum(y)[cut].astype(float)
        size = cut + 1.0
        for above, pos, all_ in ((False, left, size), (True, p - left, len(v) - size)):
            gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / all_) - before), 0)
            at = int(np.argmax(gain))
            if gain[at] > best:
                # Half way between two rows, so that equal rows are judged alike.
                best, found = gain[at], Condition(share, above, float((v[cut[at]] + v[cut[at] + 1]) / 2))
    return found


def _grow(x: np.ndarray, poor: np.ndarray, most: int = 4) -> Rule:
    rule: list[Condition] = []
    while len(rule) < most and (c := _best_condition(x, poor)):
        rule.append(c)
        inside = c.holds(x)
        x, poor = x[inside], poor[inside]
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, poor: np.ndarray) -> Rule:
    """Drop last conditions while that does not worsen (p - n) / (p + n) on rows the rule was not grown on."""

    def worth(r: Rule) -> float:
        inside = _covers(r, x)
        p, n = (inside & poor).sum(), (inside & ~poor).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, poor: np.ndarray, least_precision: float = LEAST_PRECISION, most_rules: int = 12) -> list[Rule]:
    """Ordered rules that cover poor rows of ``x`` (columns SHARES)."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and poor.sum() >= 10:
        grown = _grow(x[~third], poor[~third])
        if not grown:
            break
        rule = _prune(grown, x[third], poor[third])
        inside = _covers(rule, x)
        if inside.sum() < 5 or poor[inside].mean() < least_precision:
            rule, inside = grown, _covers(grown, x)
            if inside.sum() < 5 or poor[inside].mean() < least_precision:
                break
        rules.append(rule)
        x, poor, third = x[~inside], poor[~inside], third[~inside]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: true keeps the document."""
    failed = base_failed()
    out = F.when(failed, False)
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = out.when(test, False)
    return out.otherwise(True)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Labelled documents, at most ``max_labelled`` labels by hash order, with counts and shares."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    # At most max_labelled pairs of numbers.
    return with_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "quality")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from labelled documents that the base rules do not already reject."""
    rows = (
        labelled_sample(docs, labels, max_labelled)
        .where(~base_failed())
        .groupBy("doc_id", "quality")
        .agg(F.min(F.struct(*SHARES)).alias("least"))  # of repeated ids always the same text
        .select("doc_id", "quality", "least.*")
        .toPandas()
        .sort_values("doc_id")
    )
    rows = rows.iloc[np.argsort((rows["doc_id"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")]
    return learn(rows[SHARES].to_numpy(float), rows["quality"].to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    return with_stats(docs, "doc_id").select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("kept")
    )


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    # Columns of the input may be called like the statistics, so they travel under names of their own.
    own = {c: "text" if c == "text" else f"own_{k}_" for k, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()])
    kept = with_stats(held, *own.values()).where(verdict(rules))
    return kept.select(*[F.col(name).alias(c) for c, name in own.items()])
