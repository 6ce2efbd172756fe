"""Secret scan with a trigram inverted index.

Each rule's pattern is parsed once into a Boolean query over trigrams that any match must hold (letters
folded to lower case). Every block of texts gets postings for the trigrams that some query names; a rule's
postings are united and intersected, and only the candidate texts are verified with the rule's pattern.
A rule without mandatory trigrams scans every text.

Defined results: a null or empty text has no spans; repeated rows give repeated rows; positions are code
points of the whole text, end exclusive; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, each_batch, raw_text, table

#: Most strings that a part of a pattern is spelled out to.
SPELLED = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False


#: Fixed by the contract: kinds, patterns and least lengths of the base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Rules of public token formats beyond the base.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + MORE

#: A query is True (no constraint), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def both(kind: str, parts: list[Query]) -> Query:
    if kind == "and":
        parts = [p for p in parts if p is not True]
    elif True in parts:
        return True
    parts = list(dict.fromkeys(parts))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def of_strings(strings: set[str]) -> Query:
    """Trigrams that a text holds if it holds one of these strings."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def spell(op, arg) -> set[str] | None:
    """All strings that this node matches, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < SPELLED:
                out |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return spell_all(arg[3])
    if op is C.BRANCH:
        parts = [spell_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] != C.MAXREPEAT and arg[1] <= 4:
        one = spell_all(arg[2])
        if one is None:
            return None
        out, power = set(), {""}
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                out |= power
            power = {a + b for a in power for b in one}
            if len(power) > SPELLED:
                return None
        return out
    return None


def spell_all(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        part = spell(op, arg)
        if part is None or len(out) * len(part) > SPELLED:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> Query:
    """Boolean query over lower-case trigrams that every match of the pattern satisfies."""

    def sequence(nodes) -> Query:
        known: set[str] = {""}
        parts: list[Query] = []
        for op, arg in nodes:
            part = spell(op, arg)
            if part is not None and len(known) * len(part) <= SPELLED:
                known = {a + b for a in known for b in part}
                continue
            parts.append(of_strings(known))
            known = part if part is not None else {""}
            if part is None:
                parts.append(single(op, arg))
        return both("and", [*parts, of_strings(known)])

    def single(op, arg) -> Query:
        if op is C.SUBPATTERN:
            return sequence(arg[3])
        if op is C.BRANCH:
            return both("or", [sequence(x) for x in arg[1]])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            return sequence(arg[2])
        return True

    return sequence(_parser.parse(pattern))


def named(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(named, query[1]))


class Scanner:
    """Rules of one worker: compiled patterns, trigram queries, and the table of trigrams they name."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.order = {r.kind: i for i, r in enumerate(rules)}
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
        for i, r in enumerate(rules):
            if m := re.fullmatch(r"(\[[^\]]+\])\+", r.pattern):  # runs of a class: the same spans, without a match for each short run
                self.compiled[i] = re.compile(f"(?<!{m[1]}){m[1]}{{{max(1, r.least)},}}", re.ASCII)
        grams = sorted({g for q in self.queries for g in named(q) if g.isascii()})
        self.row = {g: i + 1 for i, g in enumerate(grams)}
        self.lookup = np.zeros(1 << 24, np.uint8 if len(grams) < 255 else np.uint16)
        for g, i in self.row.items():
            a, b, c = g.encode()
            self.lookup[a << 16 | b << 8 | c] = i

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Booleans: does this text (column) hold this trigram (row)?"""
        out = np.zeros((len(self.row) + 1, len(offsets) - 1), bool)
        if len(data) < 3:
            return out
        low = (data + ((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint32)
        got = self.lookup[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(got)
        doc = np.searchsorted(offsets, at, "right") - 1
        own = at + 3 <= offsets[doc + 1]
        out[got[at[own]], doc[own]] = True
        return out

    def candidates(self, query: Query, posted: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(posted.shape[1], bool)
        if isinstance(query, str):
            return posted[self.row[query]] if query in self.row else np.ones(posted.shape[1], bool)
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce([self.candidates(q, posted) for q in query[1]])

    def spans(self, text: str, which: list[int]) -> list[tuple[int, int, int]]:
        """(start, rule, end) of what these rules find, sorted."""
        out = []
        for i in which:
            r = self.rules[i]
            for m in self.compiled[i].finditer(text):
                a, b = m.span(r.group)
                if b - a >= r.least:
                    out.append((m.start(), i, m.end()))
        return sorted(out)

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        data, offsets = raw_text(column)
        posted = self.postings(data, offsets)
        found = np.array([self.candidates(q, posted) for q in self.queries])
        raw = data.tobytes()
        at = offsets.tolist()
        return [self.spans(raw[at[k] : at[k + 1]].decode(), np.flatnonzero(found[:, k]).tolist()) for k in range(len(at) - 1)]


def find_secrets(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans array<struct<kind, start, end>>) of every row, by start, then the order of the rules."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("k", pa.int64()), ("spans", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in each_batch(batches):
            rows = [[{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in found] for found in scanner.scan(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(kind))], schema=schema)

    return (
        bounded(df)
        .select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
        .mapInArrow(run, "k long, spans array<struct<kind:string,start:int,end:int>>")
        .withColumnRenamed("k", key)
    )


def digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select(
        "doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))
