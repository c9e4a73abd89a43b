"""Plain versions of what the corpus operators return, and small tables with awkward rows."""

from __future__ import annotations

import re
import zlib

SF = "/root/testdata/sf0.001"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def remainder(doc_id, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


LONG = "lorem ipsum dolor sit amet consectetur " * 4000
PROSE = "the quick brown fox jumps over the lazy dog while seven grey geese watch from the river bank in silence " * 4

#: (doc_id, text): null, empty, white space, repeated rows and ids, a null id, a long text.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, PROSE), (5, PROSE), (6, PROSE), (6, "other words under a repeated id"),
    (None, PROSE), (None, None), (7, LONG), (8, "\n".join(["All rights reserved."] * 30)), (9, "x" * 50_000),
    (10, "Grüße, naïve café — 東京 \U0001f600 \u00a0 end"),
]


def documents(spark, rows=AWKWARD):
    """A documents table, with columns whose names operators might use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 1, "x", 2.0, "y") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, row_id int, fp string, score double, label string",
    ).repartition(1)


def labels(spark, rows):
    return spark.createDataFrame([(i, q, 0) for i, q in rows], "doc_id long, quality int, toxic int")
