"""License scan: ordered signature rules behind a keyword prefilter.

Each rule of ``license_rules`` has a priority, keywords that all its matches
contain, and a regex. One Aho-Corasick pass over the lower-cased text finds the
keywords that occur; only rules whose keywords all occur are tried, in order.
Their matches are then resolved: taken by priority, length, position and rule
order, a match is suppressed if its interval lies in that of a kept match, or
if it overlaps a kept match of a higher priority. Work is one pass a text with
no shuffle.

Case is folded for ASCII letters only, in keywords and regexes alike, so the
prefilter loses nothing.

Result: one row a kept detection, ``start`` and ``stop`` being code points of
the text. Rows, defined results: null and empty texts have no detections;
repeated rows are scanned each; a tie (same interval and priority) goes to the
earlier rule; an empty table gives an empty result; only ``keep`` columns are
carried, and none may be named like a result column.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orrery.llm import textkit as K
from orrery.llm.bpe import _arrow_schema
from orrery.llm.license_rules import RULES
from orrery.runtime import attach

_GAP = r"[\s*#/;>|-]+"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_OUT = ("rule", "license", "priority", "start", "stop")


class Rule(NamedTuple):
    number: int
    priority: int
    license: str
    keywords: tuple[str, ...]
    regex: re.Pattern


def spaced(regex: str) -> str:
    """Spaces outside character sets become runs of white space and comment signs."""
    out, inside = [], False
    i = 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        if c == " ":
            # in a set the space is one sign; "[- ]" must span line breaks too
            out.append(r"\s" if inside else f"(?:{_GAP})")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def parse(text: str) -> list[Rule]:
    rows = [x for x in text.strip().split("\n") if x.strip()]
    out = []
    for i, row in enumerate(rows):
        priority, name, keywords, regex = row.split(" | ", 3)
        out.append(Rule(i, int(priority), name, tuple(keywords.split(",")), re.compile(spaced(regex), re.I | re.A | re.S)))
    return out


@lru_cache(maxsize=2)
def rules() -> list[Rule]:
    return parse(RULES)


class Scanner:
    def __init__(self, table: list[Rule]):
        import ahocorasick

        self.rules = table
        words = sorted({k for r in table for k in r.keywords})
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()
        at = {w: i for i, w in enumerate(words)}
        # a rule is filed under its longest keyword, which is likely the rarest
        self.filed: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for r in table:
            self.filed.setdefault(at[max(r.keywords, key=len)], []).append((r.number, frozenset(at[k] for k in r.keywords)))

    def candidates(self, text: str) -> list[int]:
        """Numbers of the rules whose keywords all occur, ascending."""
        seen = {i for _, i in self.automaton.iter(text.translate(_FOLD) if not text.isascii() else text.lower())}
        return sorted(n for i in seen for n, need in self.filed.get(i, ()) if need <= seen)

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        return resolve(self.rules, ((n, m.start(), m.end()) for n in self.candidates(text) for m in self.rules[n].regex.finditer(text)))


def resolve(table: list[Rule], found: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Kept (rule, start, stop), by position; see above.

    Kept intervals are looked up in order of their starts. No kept interval
    contains another, so starts and stops rise together and only neighbours of
    a candidate can contain or overlap it.
    """
    order = sorted(found, key=lambda f: (-table[f[0]].priority, f[1] - f[2], f[1], f[0]))
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for n, s, e in order:
        if e <= s:
            continue
        i = bisect.bisect_right(starts, s)
        # swallowed: the last interval that starts at or before s reaches furthest
        if i and kept[i - 1][2] >= e:
            continue
        own = table[n].priority
        lo = i
        while lo and kept[lo - 1][2] > s:
            lo -= 1
        hi = i
        while hi < len(kept) and starts[hi] < e:
            hi += 1
        if any(table[k[0]].priority > own for k in kept[lo:hi]):
            continue
        starts.insert(i, s)
        kept.insert(i, (n, s, e))
    return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


def _scan(text_at: int, keep_at: list[int], schema: pa.Schema):
    def run(batches):
        sc = scanner()
        for b in batches:
            row, cols = [], ([], [], [], [], [])
            for i, t in enumerate(b.column(text_at)):
                t = t.as_py()
                if not t:
                    continue
                for n, s, e in sc.scan(t):
                    row.append(i)
                    for c, v in zip(cols, (n, sc.rules[n].license, sc.rules[n].priority, s, e)):
                        c.append(v)
            at = pa.array(row, pa.int64())
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in keep_at], *[pa.array(c, k) for c, k in zip(cols, kinds)]], schema=schema)

    return run


def license_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``rule, license, priority, start, stop`` of every kept detection."""
    attach(docs.sparkSession)
    if set(_OUT) & set(keep):
        raise ValueError(f"keep columns may not be named {', '.join(_OUT)}")
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text].alias("text"))
    kinds = (T.IntegerType(), T.StringType(), T.IntegerType(), T.LongType(), T.LongType())
    out = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], *[T.StructField(n, k) for n, k in zip(_OUT, kinds)]])
    return src.mapInArrow(K.tidy(_scan(len(keep), list(range(len(keep))), _arrow_schema(out))), out)
