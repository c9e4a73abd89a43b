"""Benchmark decontamination: size-partitioned MinHash containment search, native.

A test item is short, a document may be long, so the Jaccard similarity of the two is tiny however much of the item the
document holds; what counts is containment, the share of the item's word shingles found in the document. Items are
partitioned by size (powers of two). An item's sketch is the bottom of its shingles in hash order, one more than may be missing
at the threshold: a document that contains enough of the item holds at least one of them. Document shingles pass a bit filter of
all sketch hashes, of bounded size, where they are made. What passes is probed only in partitions whose ceiling, the greatest hash in their
sketches, it does not exceed: partition and hash are the key of the join. Documents that share a
sketch hash are candidates, and candidates are verified by exact containment of the shingles themselves.

Edge cases: null and empty texts have no shingles and match nothing. Texts of fewer words than a shingle are one shingle
of another kind, which only an equal short text shares. Repeated items or documents of one id count once, with their greatest
containment. Null ids are carried like any other value. ``keep_clean`` judges rows by a number of their own: rows of one id, or without an id,
stay or go by their own text, and equal rows alike. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymart.llm.common import free_name, stored

WORDS = 5
CONTAINMENT = 0.8
#: Rows that may be broadcast (ids and hashes, some tens of bytes each), and bytes of item text; more are joined by shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20
#: Bits of the filter of sketch hashes, a power of two; with more hashes it lets more through and nothing is lost.
FILTER_BITS = 1 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")


def _starts(words: str, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def hashes(words: str, codes: str, n: int = WORDS) -> Column:
    """Shingle hashes, from the words and from the hashes of the words."""
    long = F.transform(_starts(words, n), lambda i: F.xxhash64(*[F.get(F.col(codes), i + k) for k in range(n)]))
    short = F.array(F.xxhash64(F.concat_ws(" ", words)))
    return F.when((F.size(words) > 0) & (F.size(words) < n), short).otherwise(long)


def shingles(words: str, n: int = WORDS) -> Column:
    """The shingles as text, distinct."""
    long = F.transform(_starts(words, n), lambda i: F.concat_ws(" ", F.slice(F.col(words), i + 1, n)))
    short = F.array(F.concat_ws(" ", words))
    return F.array_distinct(F.when((F.size(words) > 0) & (F.size(words) < n), short).otherwise(long))


def _hashed(rows: DataFrame, n: int) -> DataFrame:
    coded = rows.withColumn("w", words_of(F.col("text"))).withColumn("c", F.transform("w", lambda w: F.xxhash64(w)))
    return coded.withColumn("h", hashes("w", "c", n)).drop("c", "text")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sketches(items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """size_class, hash and item_id of the bottom of every item."""
    sized = _hashed(items, n).select("item_id", F.array_distinct("h").alias("h")).where(F.size("h") > 0)
    q = F.size("h")
    keep = q - F.ceil(q * F.lit(containment) - F.lit(1e-9)).cast("int") + 1
    return (
        sized.select(
            "item_id",
            F.floor(F.log2(q)).cast("int").alias("size_class"),
            F.explode(F.slice(F.sort_array("h"), F.lit(1), keep)).alias("hash"),
        )
    ).distinct()


def _bit(hash_: Column) -> tuple[Column, Column]:
    """Word and bit of the filter for a hash: its middle bits, as the sketches hold the smallest hashes."""
    place = F.shiftrightunsigned(hash_, 20).bitwiseAND(F.lit(FILTER_BITS - 1))
    return F.shiftright(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")


def probes(docs: DataFrame, sketch: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, size_class, hash of the document shingles that may be in a sketch of that class."""
    ceilings = {r["size_class"]: r["top"] for r in sketch.groupBy("size_class").agg(F.max("hash").alias("top")).collect()}
    word, bit = _bit(F.col("hash"))
    # FILTER_BITS / 64 rows at most.
    filled = sketch.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).collect()
    words = [0] * (FILTER_BITS // 64)
    for r in filled:
        words[r["word"]] = r["bits"]
    bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal

    def passes(h: Column) -> Column:
        word, bit = _bit(h)
        return F.getbit(F.get(bits, word), bit) == 1

    top = F.lit(max(ceilings.values(), default=-(1 << 63)))
    classes = F.array(*[F.struct(F.lit(c).alias("size_class"), F.lit(t).alias("top")) for c, t in sorted(ceilings.items())])
    through = _hashed(docs, n).select("doc_id", F.explode(F.filter("h", lambda h: (h <= top) & passes(h))).alias("hash"))
    if not ceilings:
        return through.select("doc_id", F.lit(0).alias("size_class"), "hash")
    below = F.filter(classes, lambda c: F.col("hash") <= c["top"])
    return through.select("doc_id", "hash", F.explode(below).alias("c")).select("doc_id", "c.size_class", "hash")


def leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every document that holds at least that share of an item."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").distinct()
    sketch = stored(sketches(items, n, containment), "sketch")
    found = probes(docs, sketch, n).join(_small(sketch, sketch.count()), ["size_class", "hash"]).select("doc_id", "item_id").distinct()
    candidates = stored(found, "candidates")
    ids = candidates.select(F.col("doc_id").alias("id")).distinct()
    suspects = docs.join(_small(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    texts = suspects.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", shingles("w", n).alias("d"))
    parts = items.select("item_id", words_of(F.col("text")).alias("w")).select("item_id", shingles("w", n).alias("i"))
    # Shingles hold every word WORDS times, so their size follows from that of the texts.
    bulk = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = F.broadcast(parts) if bulk <= BROADCAST_BYTES else parts
    parts, pairs = parts.alias("parts"), candidates.alias("pairs")
    asked = pairs.join(parts, F.col("pairs.item_id").eqNullSafe(F.col("parts.item_id"))).select(
        F.col("pairs.doc_id").alias("asked_id"), "pairs.item_id", "i"
    )
    shared = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id"))).select(
        "doc_id", "item_id", F.size(F.array_intersect("d", "i")).alias("n_shared"), F.size("i").alias("n_item")
    )
    return (
        shared.where(F.col("n_shared") >= F.col("n_item") * F.lit(containment) - F.lit(1e-9))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("best"))
        .select(
            "doc_id", "item_id", F.col("best.n_shared").cast("long").alias("n_shared"),
            F.col("best.n_item").cast("long").alias("n_item"),
            (F.col("best.n_shared") / F.col("best.n_item")).alias("containment"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """Documents that hold no test item, with all their columns."""
    row = free_name(docs, "row_")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = leaks(numbered.select(F.col(row).alias("doc_id"), "text"), items, n, containment)
    bad = stored(found.select(F.col("doc_id").alias(row)).distinct(), "leaked")
    return numbered.join(_small(bad, bad.count()), row, "left_anti").select(*docs.columns)


ORACLE = r"""
with cut as (
    select id, kind, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from (select doc_id as id, 'd' as kind, text from documents union all select item_id, 'i', text from benchmark)
), grams as (
    select distinct id, kind, text, unnest(case when len(w) = 0 then [] when len(w) < 5 then ['short ' || array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g
    from cut
), sized as (select id, text, count(*) as n_item from grams where kind = 'i' group by all),
hits as (
    select d.id as doc_id, i.id as item_id, d.text as dt, i.text as it, count(*) as n_shared
    from grams d join grams i on d.g = i.g where d.kind = 'd' and i.kind = 'i' group by all
)
select doc_id, item_id, arg_max(n_shared, n_shared / n_item) as n_shared, arg_max(n_item, n_shared / n_item) as n_item,
    max(n_shared / n_item) as containment
from hits join sized on item_id = id and it = sized.text where n_shared >= 0.8 * n_item group by all
"""
