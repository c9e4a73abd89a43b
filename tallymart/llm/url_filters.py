"""URL filters: all glob rules run at once as a bit-parallel automaton.

A rule such as ``example.org/es/`` holds for its host and all subdomains and for paths that start with its path; as a
glob over the canonical form ``.host?path`` it reads ``*.example.org?/es/*``. The states of all rules are packed into
64-bit words. For each byte of the URL the states shift by one with carries between words (Shift-And) and are masked by
the byte's bits; a ``*`` is a state that also keeps itself. A batch of URLs is simulated together, the longest first, so that
short ones drop out. Of the base rules that accept a URL the longest decides (the first of equal ones); where none does,
the longest accepting glob of the own list does; where none does, the default.

Edge cases: null and empty URLs and URLs without ``://`` have an empty host and path; no rule fits them, so they
get the default. URLs of any length are read to the end of the path. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymart.llm.common import slices

BASE_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Globs over ``.host?path`` for URLs that no base rule fits.
OWN_GLOBS = [
    ("block", "*.ads.*"),
    ("block", "*.adserver.*"),
    ("block", "*.tracker.*"),
    ("block", "*.doubleclick.*"),
    ("block", "*?/login*"),
    ("block", "*?/signin*"),
    ("block", "*?/cart*"),
    ("block", "*?/checkout*"),
    ("block", "*?*/wp-admin/*"),
    ("block", "*?*.zip"),
    ("block", "*?*.exe"),
    ("block", "*?*.jpg"),
    ("block", "*?*.png"),
    ("block", "*?*.mp4"),
    ("allow", "*.gov?*"),
    ("allow", "*.edu?*"),
]
DEFAULT = "allow"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    url = url or ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "#?":
        rest_host = rest.split(mark, 1)[0]
        rest = rest_host
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def glob_of(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"*.{host}?{slash}{path}*"


@dataclass(frozen=True)
class Automaton:
    """Masks by byte, states that keep themselves, first states, and each rule's last state (word, bit)."""

    by_byte: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    last: list[tuple[int, int]]

    @staticmethod
    def of(globs: list[str]) -> Automaton:
        states: list[int] = []  # the byte that enters each state; -1 for first states
        stay, first, last = [], [], []
        for glob in globs:
            first.append(len(states))
            states.append(-1)
            for byte in glob.encode():
                if byte == ord("*"):
                    stay.append(len(states) - 1)
                else:
                    states.append(byte)
            last.append(len(states) - 1)
        words = -(-len(states) // 64)

        def pack(at) -> np.ndarray:
            out = np.zeros(words, np.uint64)
            for k in at:
                out[k // 64] |= np.uint64(1 << k % 64)
            return out

        by_byte = np.stack([pack(k for k, b in enumerate(states) if b == byte) for byte in range(256)])
        return Automaton(by_byte, pack(set(stay)), pack(first), [(k // 64, k % 64) for k in last])

    def accepts(self, texts: list[bytes]) -> np.ndarray:
        """For each text and rule, whether the rule's glob matches the whole text."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        begin = np.concatenate([[0], np.cumsum(size)])[:-1][order]
        size = size[order]
        flat = np.frombuffer(b"".join(texts), np.uint8)
        d = np.tile(self.first, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t, "left"))  # texts longer than t
            now = d[:k]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            d[:k] = (moved & self.by_byte[flat[begin[:k] + t]]) | (now & self.stay)
        out = np.empty((len(texts), len(self.last)), bool)
        out[order] = np.stack([(d[:, w] >> np.uint64(b)) & one for w, b in self.last], 1).astype(bool)
        return out


def judge(
    pages: DataFrame,
    base: list[tuple[str, str]] = BASE_RULES,
    own: list[tuple[str, str]] = OWN_GLOBS,
    default: str = DEFAULT,
) -> DataFrame:
    """page_id, host, path, rule (the base rule that decides, else null), glob (the own one that does), verdict."""
    base = sorted(base, key=lambda r: -len(r[1]))
    own = sorted(own, key=lambda r: -len(r[1]))
    automaton = Automaton.of([glob_of(r) for _, r in base] + [g for _, g in own])
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            hit = automaton.accepts([f".{h}?{p}".encode() for h, p in parts])
            rules, globs, verdicts = [], [], []
            for row in hit:
                k = int(np.argmax(row)) if row.any() else -1
                rules.append(base[k][1] if 0 <= k < len(base) else None)
                globs.append(own[k - len(base)][1] if k >= len(base) else None)
                verdicts.append(default if k < 0 else (base + own)[k][0])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    *(pa.array(c, pa.string()) for c in ([h for h, _ in parts], [p for _, p in parts], rules, globs, verdicts)),
                ],
                ["page_id", "host", "path", "rule", "glob", "verdict"],
            )

    return pages.select("page_id", "url").mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, glob string, verdict string"
    )


def _like(glob: str) -> str:
    return glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def oracle(base=BASE_RULES, own=OWN_GLOBS, default=DEFAULT) -> str:
    base = sorted(base, key=lambda r: -len(r[1]))
    own = sorted(own, key=lambda r: -len(r[1]))

    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash}{path}')"

    rule = " ".join(f"when {fits(r)} then '{r}'" for _, r in base)
    verdict = " ".join(f"when rule = '{r}' then '{v}'" for v, r in base)
    verdict += " " + " ".join(f"when '.' || host || '?' || path like '{_like(g)}' escape '\\' then '{v}'" for v, g in own)
    return f"""
with parts as (
    select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
    from pages
), ruled as (select *, case {rule} end as rule from parts)
select page_id, host, path, rule, case {verdict} else '{default}' end as verdict from ruled
"""
