"""Operator 13: fill-in-the-middle transformation.

One Aho-Corasick automaton scans a text once for sparse events: the ASCII characters at which the class of a unit changes,
and sentinels. What lies between two events is a gap, whose number of units is arithmetic: none or one, or its length. The
running sum over events and gaps gives the number of units, and where a unit of given rank ends, by a binary search.

Units are lines (with their ends), words (runs of white space or of other characters) or characters. Two hashed cuts between
units part the text into prefix, middle and suffix; the middle moves to the end behind sentinels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Percent of texts to transform, and of these percent in the form that begins with the suffix.
RATE, SPM = 100, 50
#: Characters at which a unit of the kind changes.
EVENTS = {"line": "\n", "word": "\t\n\v\f\r ", "char": ""}
#: Output is handed on when it has about so many characters.
PIECE = 1 << 20


@cache
def automaton(unit: str, sentinels: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """Finds the unit's characters (value True) and sentinels (value False); None if there is nothing to find."""
    if not EVENTS[unit] and not sentinels:
        return None
    found = ahocorasick.Automaton()
    for character in EVENTS[unit]:
        found.add_word(character, True)
    for sentinel in sentinels:
        found.add_word(sentinel, False)
    found.make_automaton()
    return found


@dataclass
class Units:
    """Ends of the pieces of a text (events and the gaps between them), and the number of units up to each."""

    ends: np.ndarray
    upto: np.ndarray
    single: bool  # a unit is a character, so that gaps hold many

    @property
    def n(self) -> int:
        return int(self.upto[-1])

    def end(self, rank: int) -> int:
        """Where the first ``rank`` units end, in code points."""
        k = int(np.searchsorted(self.upto, rank))
        return rank if self.single else int(self.ends[k])


def scan(text: str, unit: str = "line", sentinels: tuple[str, ...] = SENTINELS) -> Units | None:
    """Units of a text, or None if a sentinel stands in it."""
    at, known = [], automaton(unit, sentinels)
    for end, changes in known.iter(text) if known else ():
        if not changes:
            return None
        at.append(end)
    at = np.array(at, np.int64)
    if unit == "char":
        return Units(np.array([0, len(text)]), np.array([0, len(text)]), True)
    if unit == "line":  # an event ends a unit, and so does the end of what follows the last one
        ends = np.append(at + 1, len(text)) if len(text) > (at[-1] + 1 if len(at) else 0) else at + 1
    else:  # a unit ends where a gap meets events and where events meet a gap
        last = np.flatnonzero(np.diff(at, append=len(text) + 1) > 1)  # of a run of events
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        ends = np.unique(np.concatenate((at[first], at[last] + 1, [len(text)])))
        ends = ends[ends > 0]
    ends = np.concatenate(([0], ends))
    return Units(ends, np.arange(len(ends)), False)


def _check(sentinels: tuple[str, ...]) -> None:
    """A text without sentinels is read back exactly if none begins with what ends another."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(b.startswith(a[k:]) for k in range(1, len(a))) or (a is not b and (a in b or b in a)):
                raise ValueError(f"sentinels {a!r} and {b!r} may overlap")


def transform(docs: DataFrame, unit: str = "line", sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of docs (doc_id, text).

    n is the number of units of the whole text. Cuts and form are drawn by the first four groups of 8 hex digits of the
    SHA-256 of ``seed:doc_id``: the cuts modulo n + 1, the text stays plain if the third modulo 100 is not below rate, and
    the suffix comes first if the fourth modulo 100 is below spm. Null and empty texts, and those with a sentinel, stay
    plain, without prefix_chars and middle_chars. Rows that repeat a doc_id are cut by the same hash; a null doc_id is the
    empty string. Other columns are ignored. Empty input: no rows. Sentinels that may overlap raise ValueError.
    """
    _check(sentinels)
    before, after, inside = sentinels
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digest.alias("digest")).select("doc_id", "text", *drawn)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
        units = scan(text, unit, sentinels)
        n = units.n if units else scan(text, unit, ()).n
        if not text or not units or h3 % 100 >= rate:
            return n, "plain", None, None, text
        cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = units.end(cuts[0]), units.end(cuts[1])
        if h4 % 100 < spm:
            return n, "spm", a, b - a, "".join((after, text[b:], before, text[:a], inside, text[a:b]))
        return n, "psm", a, b - a, "".join((before, text[:a], after, text[b:], inside, text[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for doc_id, text, *h in zip(*(batch.column(c) for c in ("doc_id", "text", "h1", "h2", "h3", "h4")), strict=True):
                made.append((doc_id.as_py(), *one(text.as_py(), *(x.as_py() for x in h))))
                size += len(made[-1][-1])
                if size > PIECE:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
                    made, size = [], 0
            if made:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output and its form come from, exactly; a plain output is the text itself."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" if "\\E" not in s else re.escape(s) for s in sentinels), 4)
    psm, spm = (F.concat(*(F.try_element_at(parts, F.lit(k)) for k in order)) for order in ((2, 4, 3), (3, 4, 2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
