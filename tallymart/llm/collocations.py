"""Phrases of two and three words whose words attract each other, mined from a weighted de Bruijn graph.

Nodes are pairs of neighbouring words, edges the triples that lead from one pair to the next, weighted by how often they occur. Every
piece of text is closed by two end marks, so each word occurrence begins exactly one edge.

* **Edges** are the only thing that is counted. Tasks count their own triples first; the rows are dealt by the node
  that an edge leaves, so that its flow is summed where its edges are. Nodes of two very frequent words are dealt by the third word too
  and their flows added up later. (Which words are frequent is seen from a random sample of the texts; it decides placement only.)
* **Shorter counts** follow from the flow: a pair occurs as often as edges leave its node, those to an end mark being the correction
  for pieces that end there; a word as often as edges leave all pairs that it begins.
* **Unary paths** of the graph of frequent edges (nodes with one edge in and one out) are compacted by pointer jumping, in rounds of a
  logarithm of their length. A path's row holds its words, its edges' weights and its nodes' flows, so a triple
  finds the flows of both its pairs beside it. Only the last node of a path is looked up. Rarer edges are no candidates; they count in the flow.

``phrases`` scores each phrase by its weakest cut and drops what a longer frequent phrase explains.

Edge cases: null texts are empty, a null ``lang`` is ``und``. Repeated rows count each time. Counts are whole numbers and scores are floored
from exact decimals. Ties end in the phrase's byte order. Empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tallymart.llm.common import slices, stored, strings, utf8

LEAST = 10
#: A phrase goes if a longer one has so many per cent of its count.
EXPLAINED = 50
TOP = 2000
#: Words a task counts before it hands on, and distinct words of a language.
BATCH_WORDS = 1_000_000
BATCH_DISTINCT = 500_000
#: Three word numbers below this fit into 63 bits.
CUBE = 1 << 21
#: Bytes of text to a partition of edges, as one task sums them.
PART_BYTES = 8 << 20
#: Sampled bytes to tell frequent words, the least share that counts as frequent, and into how many parts their edges go.
SAMPLE_BYTES = 8 << 20
FREQUENT = 1e-4
SPREAD = 64
#: Edges in a row of a path.
PIECE = 256

_END = b"\xff"  # never part of UTF-8
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _END * 10)
_EDGES = pa.schema([("node", pa.string()), ("next", pa.string()), ("n", pa.int64()), ("spread", pa.bool_())])


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, with an end mark behind each piece."""
    return (text.translate(_FOLD) + _END).replace(_END, b" \xff ").split()


def _edges(lang: str, names: list[bytes], stream: np.ndarray, frequent: frozenset[bytes], parts: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Distinct edges of a stream of word numbers (the end mark is 0) with their counts: for each part, in order of their words."""
    words = pa.array(names, pa.binary())
    order = pc.array_sort_indices(words).to_numpy()  # the end mark is taken as empty, so it stays first
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    words = words.take(pa.array(order))
    v = len(names)
    t = np.concatenate([rank[stream], [0, 0]])
    one, two, three = t[:-2], t[1:-1], np.where(t[1:-1] == 0, 0, t[2:])
    begins = one != 0
    pairs = one[begins] * v + two[begins]
    named = None
    if v >= CUBE:
        named, pairs = np.unique(pairs, return_inverse=True)
    key, n = np.unique(pairs * v + three[begins], return_counts=True)
    pair, three = np.divmod(key, v)
    if named is not None:
        pair = named[pair]
    fresh = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
    one, two = np.divmod(pair[fresh], v)
    sep = pa.scalar(b"\t", pa.binary())
    head = pc.binary_join_element_wise(pa.scalar(lang.encode(), pa.binary()), words.take(pa.array(one)), sep)
    nodes = pc.binary_join_element_wise(head, words.take(pa.array(two)), pa.scalar(b" ", pa.binary()))
    at = np.cumsum(fresh) - 1
    digest = np.array([xxhash.xxh32_intdigest(w) for w in words.to_pylist()], np.uint64)
    often = np.array([w in frequent for w in words.to_pylist()], bool)
    part = digest[one] * np.uint64(0x9E3779B1) + digest[two] * np.uint64(0x85EBCA77) + np.uint64(xxhash.xxh32_intdigest(lang))
    spread = (often[one] & often[two])[at]
    part = part[at] + np.where(spread, (digest[three] % np.uint64(SPREAD) + np.uint64(1)) * np.uint64(0xC2B2AE3D), np.uint64(0))
    part = (part % np.uint64(parts)).astype(np.int64)
    dealt = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[dealt], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        mine = dealt[cuts[p] : cuts[p + 1]]
        columns = [nodes.take(pa.array(at[mine])), words.take(pa.array(three[mine])), pa.array(n[mine].astype(np.int64)), pa.array(spread[mine])]
        yield int(p), pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _EDGES.types)], schema=_EDGES)


def _packed(edges: pa.RecordBatch) -> bytes:
    """Neighbours in the order of their words share most of their text, so a block of edges takes a third of its rows' space."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _EDGES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(edges)
    return out.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.Table:
    with pa.ipc.open_stream(block) as reader:
        return reader.read_all()


def _counting(frequent: frozenset[bytes], parts: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> defaultdict:
            names: defaultdict = defaultdict(count().__next__)
            names[_END]
            return names

        numbers: dict[str, defaultdict] = defaultdict(fresh)
        streams: dict[str, list[np.ndarray]] = defaultdict(list)
        words = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang in list(streams):
                names, stream = [b"", *list(numbers.pop(lang))[1:]], np.concatenate(streams.pop(lang))
                for part, edges in _edges(lang, names, stream, frequent, parts):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(edges)])], ["part", "edges"])

        for batch in slices(batches):
            for lang, text in zip(strings(batch, "lang"), utf8(batch)):
                found = tokens(text)
                streams[lang].append(np.fromiter(map(numbers[lang].__getitem__, found), np.int32, len(found)))
                words += len(found)
                if words >= BATCH_WORDS or len(numbers[lang]) >= BATCH_DISTINCT:
                    yield from hand_on()
                    words = 0
        yield from hand_on()

    return counted


def _summing(least: int):
    """All edges of a partition to frequent edges, flows of nodes, and what they add to their first words."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables([_unpacked(x) for b in batches for x in b.column("edges").to_pylist()] or [_EDGES.empty_table()])
        edges = table.group_by(["node", "next", "spread"]).aggregate([("n", "sum")]).rename_columns(["node", "next", "spread", "n"])
        del table
        nodes = edges.group_by(["node", "spread"]).aggregate([("n", "sum")]).rename_columns(["node", "spread", "n"])
        often = edges.filter(pc.and_(pc.greater_equal(edges["n"], least), pc.not_equal(edges["next"], "")))
        del edges
        halves = pc.split_pattern(nodes["node"].combine_chunks(), " ", max_splits=1, reverse=True)
        first, second = pc.list_element(halves, 0), pc.list_element(halves, 1)
        words = pa.table([first, nodes["n"]], ["node", "n"]).group_by("node").aggregate([("n", "sum")]).rename_columns(["node", "n"])
        flow = nodes.filter(pc.and_(pc.or_(pc.greater_equal(nodes["n"], least), nodes["spread"]), pc.not_equal(second, "")))
        for kind, found in (("edge", often), ("node", flow), ("word", words)):
            rows = found.num_rows
            following = found["next"] if kind == "edge" else pa.nulls(rows, pa.string())
            whole = pa.table([pa.array([kind] * rows, pa.string()), found["node"], following, found["n"]], ["kind", "node", "next", "n"])
            yield from whole.to_batches(50_000)

    return summed


def frequent_words(docs: DataFrame, share: float, total: int) -> frozenset[bytes]:
    """Words with that share of a random sample of whole texts: never more than 1 / share. They steer placement, not results."""
    some = docs.where(F.rand(7) < min(1.0, SAMPLE_BYTES / max(total, 1)))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = some.select(F.explode(F.split(lower, r"[.,;:!?\n\x0B\f\r \t]+")).alias("w")).where("w != ''")
    counted = stored(words.groupBy("w").agg(F.count("*").alias("n")), "sample")
    every = counted.agg(F.sum("n")).first()[0] or 0
    return frozenset(r["w"].encode() for r in counted.where(F.col("n") >= share * every).select("w").collect())


class Graph:
    """Counts of a corpus of ``lang``, ``text``: frequent edges, flows of nodes, words; stored in the shared folder."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-total // PART_BYTES))
        frequent = frequent_words(texts, max(FREQUENT, 1 / (4 * parts)), total)
        counted = texts.mapInArrow(_counting(frequent, parts), "part int, edges binary").repartitionById(parts, "part")
        self.least = least
        self.counts = stored(counted.mapInArrow(_summing(least), "kind string, node string, next string, n long"), "graph")

    def _kind(self, kind: str) -> DataFrame:
        return self.counts.where(F.col("kind") == kind).drop("kind")

    def words(self) -> DataFrame:
        """``lang``, ``word``, ``n``: all occurrences of every word."""
        summed = self._kind("word").groupBy("node").agg(F.sum("n").alias("n"))
        return summed.select(_lang("node").alias("lang"), F.substring_index("node", "\t", -1).alias("word"), "n")

    def pairs(self) -> DataFrame:
        """``node`` (lang, tab, two words), ``flow``: all occurrences of every frequent pair."""
        return self._kind("node").groupBy("node").agg(F.sum("n").alias("flow")).where(F.col("flow") >= self.least)

    def triples(self) -> DataFrame:
        """``id``, ``node``, ``to`` (the nodes that the edge joins), ``next`` (its last word), ``a``."""
        to = F.concat(_lang("node"), F.lit("\t"), F.substring_index(F.substring_index("node", "\t", -1), " ", -1), F.lit(" "), "next")
        return self._kind("edge").select("node", to.alias("to"), "next", F.col("n").alias("a"), F.monotonically_increasing_id().alias("id"))


def _lang(node: str):
    """What stands before the last tab: languages may hold tabs, words may not."""
    return F.expr(f"substring({node}, 1, length({node}) - length(substring_index({node}, '\\t', -1)) - 1)")


def ranked(links: DataFrame) -> DataFrame:
    """``id``, ``before`` (or null) to ``id``, ``head``, ``nth``: the first of its chain, and the steps from there.

    Pointer jumping: each round doubles the steps that a pointer spans. Rings have no first; they are cut
    before their smallest id, which the pointers have met by the time that neither they nor their smallest ids change.
    """
    start = links.select("id", F.coalesce("before", "id").alias("to"), F.col("before").isNotNull().cast("long").alias("steps"))
    now, was = stored(start.withColumn("low", F.least("id", "to")), "ranks"), None
    while True:
        far = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"), F.col("low").alias("low2"))
        step = now.join(far, "to").select(
            "id", F.col("to2").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "low2").alias("low"),
            (F.col("more") > 0).alias("open"),
        )
        now = stored(step, "ranks")
        state = now.agg(F.count_if("open"), F.sum(F.when(F.col("open"), F.col("low")))).first()
        if not state[0]:
            return now.select("id", F.col("to").alias("head"), F.col("steps").alias("nth"))
        if state == was:
            break
        was = state
    chains = now.where(~F.col("open")).select("id", F.col("to").alias("head"), F.col("steps").alias("nth"))
    rings = now.where("open").select("id", "low").join(links, "id")
    cut = rings.select("id", F.when(F.col("id") != F.col("low"), F.col("before")).alias("before"))
    return chains.unionByName(ranked(stored(cut, "rings")))


def nodes_of(graph: Graph, triples: DataFrame) -> DataFrame:
    """``node``, ``flow``, ``most`` (the heaviest frequent edge there), ``before``, ``after`` (edges in and out where there is one each)."""
    ends = triples.select("node", "a", F.col("id").alias("out"), F.lit(None).cast("long").alias("in")).unionByName(
        triples.select(F.col("to").alias("node"), "a", F.lit(None).cast("long").alias("out"), F.col("id").alias("in"))
    )
    unary = (F.count("out") == 1) & (F.count("in") == 1) & (F.max("out") != F.max("in"))
    degree = ends.groupBy("node").agg(
        F.max("a").alias("most"), F.when(unary, F.max("in")).alias("before"), F.when(unary, F.max("out")).alias("after")
    )
    return graph.pairs().join(degree, "node", "left")


def paths(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unary paths, at most ``PIECE`` edges to a row: ``lang``, ``words``, ``weights`` of edges, ``flows`` of the nodes that they leave and
    reach, so one more."""
    links = nodes.where(F.col("after").isNotNull()).select(F.col("after").alias("id"), "before")
    places = ranked(triples.select("id").join(links, "id", "left"))
    edges = triples.join(places, "id").join(nodes.select("node", "flow"), "node")
    step = F.struct("nth", "node", "next", "a", "flow", "to")
    rows = edges.groupBy("head", F.expr(f"nth div {PIECE}").alias("piece")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    last = nodes.select(F.col("node").alias("to"), F.col("flow").alias("last"))
    return (
        rows.withColumn("to", F.element_at("steps", -1)["to"])
        .join(last, "to")
        .select(
            _lang("steps[0].node").alias("lang"),
            F.concat(F.split(F.substring_index(F.col("steps")[0]["node"], "\t", -1), " "), F.col("steps.next")).alias("words"),
            F.col("steps.a").alias("weights"),
            F.concat(F.col("steps.flow"), F.array("last")).alias("flows"),
        )
    )


def _score(l: str, r: str):  # noqa: E741
    """floor(10^6 * a^2 / (l * r)), exactly."""
    return F.expr(
        f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))"
    )


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r`` (counts of the phrase and both sides of its
    weakest cut), ``n`` (words of the language), ``score``."""
    graph = Graph(docs, least)
    triples = stored(graph.triples(), "triples")
    nodes = stored(nodes_of(graph, triples), "nodes")
    long = (
        paths(triples, nodes)
        .select("lang", "words", "flows", F.posexplode("weights").alias("i", "a"))
        .select("lang", F.slice("words", F.col("i") + 1, 3).alias("words"), "a", F.col("flows")[F.col("i")].alias("left"), F.col("flows")[F.col("i") + 1].alias("right"))
    )
    kept = nodes.where(F.col("most").isNull() | (100 * F.col("most") < EXPLAINED * F.col("flow")))
    short = kept.select(
        _lang("node").alias("lang"),
        F.split(F.substring_index("node", "\t", -1), " ").alias("words"),
        F.col("flow").alias("a"),
        F.lit(None).cast("long").alias("left"),
        F.lit(None).cast("long").alias("right"),
    )
    words = stored(graph.words(), "words")
    often = words.where(F.col("n") >= least)
    both = (
        long.unionByName(short)
        .withColumns({"first": F.element_at("words", 1), "last": F.element_at("words", -1)})
        .join(often.select("lang", F.col("word").alias("first"), F.col("n").alias("f")), ["lang", "first"])
        .join(often.select("lang", F.col("word").alias("last"), F.col("n").alias("g")), ["lang", "last"])
    )
    # The first cut parts the first word from the rest (of a pair: the second word), the second cut the last word of a triple.
    cuts = both.withColumns(
        {"r1": F.coalesce("right", "g"), "s1": _score("f", "coalesce(right, g)"), "s2": F.when(F.col("left").isNotNull(), _score("left", "g"))}
    )
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    scored = cuts.select(
        "lang",
        F.array_join("words", " ").alias("phrase"),
        "a",
        F.when(second, F.col("left")).otherwise(F.col("f")).alias("l"),
        F.when(second, F.col("g")).otherwise(F.col("r1")).alias("r"),
        F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) as piece
  from documents),
split as (
  select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') as w from pieces),
grams as (
  select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
  from split, range(1, 4) as t(size) where len(w) >= size),
f as (select lang, size, phrase, count(*) as a from grams group by all),
n as (select lang, sum(a)::bigint as n from f where size = 1 group by lang),
c as (select *, string_split(phrase, ' ') as w from f where size > 1 and a >= 10),
gone as (
  select distinct c.lang, c.phrase from c join c t on t.lang = c.lang and c.size = 2 and t.size = 3
    and (c.phrase = array_to_string(t.w[1:2], ' ') or c.phrase = array_to_string(t.w[2:3], ' ')) and 100 * t.a >= 50 * c.a),
cut as (
  select c.lang, c.phrase, c.a, k, x.a as l, y.a as r, ((1000000 * c.a::hugeint * c.a) // (x.a::hugeint * y.a))::bigint as score
  from c join range(1, 3) as t(k) on k < c.size
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')
  anti join gone on gone.lang = c.lang and gone.phrase = c.phrase),
worst as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
best as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from worst)
select lang, rank, phrase, a, l, r, n.n, score from best join n using (lang) where rank <= 2000
"""
