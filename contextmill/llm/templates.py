"""Operator 9: benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other values has the same template. Windows of
template tokens are hash-joined between documents and benchmark items, in three forms: as they are in any case (so exact
copies meet whatever they hold), with placeholders where half of the tokens at least stay literal, and with some capitalised
words that begin a sentence as names too. A run of capitalised words is one name. Windows have eight tokens, fewer for short items, so that one changed word
leaves half of them. What meets at nearby shifts between document and item forms one alignment in ascending order; its
slot values map one to one, and it has to cover half of the item's windows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextmill.llm.scratch import Scratch
from contextmill.llm.words import _BASE, FOLD, U, Words, _powers_of, chunks, mix, seeded, signed, spans, words_of

WINDOW = 8
#: Items with fewer tokens have no templates: they match by their words alone.
SHORTEST = 5
#: Items with so few tokens match only texts that consist of them.
BARE = 2
COVERAGE = 0.5
#: Window hashes of the benchmark up to this number (8 bytes each) are broadcast as a filter; beyond it all windows are joined.
BROADCAST_WINDOWS = 2_000_000
#: Units of measure and currency in lower case.
UNITS = (
    "mm cm m km mi ft in inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh kph hz khz mhz ghz w kw mw volt volts watt watts "
    "usd eur gbp dollar dollars euro euros cent cents percent pct degree degrees celsius fahrenheit kelvin"
).split()

#: Number words in lower case.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_TOKEN = _DIGIT.copy()
_TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
NUMBER, NAME, UNIT = seeded(3, 909)
_hashes_of = lambda words: np.sort(words_of(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]), _TOKEN, FOLD).hashes)
_unit_hashes, _number_hashes = _hashes_of(UNITS), _hashes_of(NUMBERS)
#: Whether each character below 2,048 (one or two bytes) is a capital letter.
_CAPITAL = np.array([chr(c).isupper() for c in range(2048)])


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, with ss for sharp s. Letters stay letters, so the tokens are the same."""
    if not (data >= 128).any():
        return data, offsets  # words_of folds A-Z
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
    texts = pc.replace_substring(pc.utf8_lower(texts), "\u00df", "ss")
    _, _, low, low_offsets = next(chunks(texts, 1 << 62))
    return low, low_offsets


def _joined_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with digits for points and commas that lie between digits, and where these are."""
    digit = _DIGIT[data]
    marks = np.zeros(len(data), bool)
    if len(data) > 2:
        marks[1:-1] = ((data[1:-1] == 44) | (data[1:-1] == 46)) & digit[:-2] & digit[2:]
    return (data if not marks.any() else np.where(marks, np.uint8(48), data)), marks


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their template hashes, whether each is a slot, and whether it may be one.

    A token is a run of letters and digits (bytes from 128 count as letters); a point or comma between digits belongs to
    the number. Tokens with a digit and number words are numbers; capitalised tokens that do not begin a sentence or line
    are names, and those that do may be.
    """
    seen, marks = _joined_numbers(data)
    w = words_of(seen, offsets, _TOKEN, FOLD)
    low, low_offsets = lowered(data, offsets)
    if low is not data:
        w.hashes = words_of(_joined_numbers(low)[0], low_offsets, _TOKEN, FOLD).hashes
    count = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    digits, stops = count(_DIGIT[data]), count(_STOP[data] & ~marks)
    number = (digits[w.end] > digits[w.start]) | _among(w.hashes, _number_hashes)
    head = data[w.start].astype(np.int64)
    second = data[np.minimum(w.start + 1, len(data) - 1)].astype(np.int64) if len(data) else head
    point = np.where(head < 128, head, np.where((head >= 0xC2) & (head < 0xE0), (head & 31) << 6 | second & 63, 0))
    upper = _CAPITAL[point]
    before = np.concatenate(([0], w.end[:-1])) if len(w.end) else w.end
    opens = stops[w.start] > stops[before]
    opens[w.offsets[:-1][w.counts > 0]] = True
    unit = _among(w.hashes, _unit_hashes) & ~number
    name = upper & ~opens & ~number & ~unit
    kind = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, w.hashes)))
    return w, kind, number | name | unit, upper & opens & ~number & ~unit


@dataclass
class View:
    """Tokens of several texts as windows see them: hashes of words, of the template, slots, what may be one; each text's
    first token, and the place of each token among all words of its text."""

    words: np.ndarray
    kind: np.ndarray
    slot: np.ndarray
    maybe: np.ndarray
    offsets: np.ndarray
    place: np.ndarray
    forms: tuple[int, ...]


def views_of(w: Words, kind: np.ndarray, slot: np.ndarray, maybe: np.ndarray) -> list[View]:
    """All words for the literal form; for the others each run of names as one token, with a capital before it that begins a sentence."""
    place = np.arange(len(kind)) - np.repeat(w.offsets[:-1], w.counts)
    name = kind == NAME
    begins = maybe.copy()
    begins[:-1] &= name[1:]
    begins[-1:] = False
    begins[w.offsets[1:][w.counts > 0] - 1] = False  # of another text
    named = name | begins
    goes_on = np.zeros(len(named), bool)
    goes_on[1:] = name[1:] & named[:-1]
    goes_on[w.offsets[:-1][w.counts > 0]] = False
    every = View(w.hashes, kind, slot, maybe, w.offsets, place, (LITERAL,))
    if not goes_on.any():
        return [every, View(w.hashes, kind, slot, maybe, w.offsets, place, (TEMPLATE, NAMED))]
    first = np.flatnonzero(~goes_on)
    ends = np.concatenate((first[1:], [len(named)]))
    words = np.where(ends - first > 1, spans(w.hashes, first, ends, _AS_NAME), w.hashes[first])
    run = named[first]
    return [every, View(words, np.where(run, NAME, kind[first]), slot[first] | run, maybe[first] & ~run, np.searchsorted(first, w.offsets), place[first], (TEMPLATE, NAMED))]


def window_size(total: np.ndarray | int, window: int = WINDOW):
    """Tokens in the windows of an item: all of a short item, else so many that one changed token leaves half of the windows."""
    return np.where(np.asarray(total) <= window, total, np.minimum(window, (np.asarray(total) + 1) // 3))


#: Forms of a window: its words in lower case; placeholders; placeholders, with words that begin a sentence as names.
LITERAL, TEMPLATE, NAMED = 0, 1, 2
_AS_WORDS, _AS_TEMPLATE, _AS_NAME = 0x2127599BF4325C37, 0x4CF5AD432745937F, 0x9FB21C651E98DF25


def _forms(where: np.ndarray, size: int, words: np.ndarray, kind: np.ndarray, slot: np.ndarray, maybe: np.ndarray, forms: tuple[int, ...]):
    """(form, windows, hashes, names): the asked forms of the windows; names are arrays of the places of chosen sentence beginnings."""
    if LITERAL in forms:
        yield LITERAL, where, spans(words, where, where + size, _AS_WORDS), []
        return
    slots = np.concatenate(([0], np.cumsum(slot)))
    own = where[slots[where + size] > slots[where]]  # without a slot it is the literal form
    yield TEMPLATE, own, spans(kind, own, own + size, _AS_TEMPLATE), []
    begins = np.flatnonzero(maybe)
    if not len(begins):
        return
    up, down = _powers_of(_AS_TEMPLATE, len(kind) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate(([U(0)], np.cumsum(kind * up[: len(kind)])))
        change = (NAME - kind[begins]) * up[begins]  # of the sum when the word counts as a name
        so_far = np.concatenate(([0], np.cumsum(maybe)))
        own = where[so_far[where + size] > so_far[where]]
        first, held = so_far[own], so_far[own + size] - so_far[own]
        todo = [(0, own, first, held, total[own + size] - total[own], [])]
        while todo:  # one more chosen beginning at a time, in ascending order
            least, own, first, held, sums, names = todo.pop()
            for b in range(least, size):
                more = held > b
                if not more.any():
                    break
                at = first[more] + b
                part = (own[more], first[more], held[more], sums[more] + change[at], [*(x[more] for x in names), begins[at]])
                yield NAMED, part[0], mix(part[3] * down[part[0]] + U(size) * U(_BASE)), part[4]
                todo.append((b + 1, *part))


def _windows(sizes: list[int], filtered: object, whole_items: bool, window: int = WINDOW):
    """Rows of windows: id, at, size, hash, form, slots (hashes of the slots' own words in order), literals, total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, pairs = filtered.value if filtered is not None else (None, None)
        if wanted is not None:
            gate = np.zeros(1 << 22, bool)
            gate[(wanted >> U(42)).astype(np.int64)] = True
        for batch in batches:
            for lo, to, data, offsets in chunks(batch.column("text")):
                if wanted is not None and not len(wanted):
                    continue
                w, kind, slot, maybe = tokens_of(data, offsets)
                if not len(kind):
                    continue
                whole = w.counts
                strange = np.zeros(len(kind) + 1, np.int64)
                if wanted is not None:  # words that are literal in every form have to stand in this order in some item
                    left = np.repeat(w.offsets[1:], w.counts) - np.arange(len(kind))
                    plain = ~(slot | maybe)
                    two = np.flatnonzero((left >= 2)[:-1] & plain[:-1] & plain[1:])
                    hashes = spans(w.hashes, two, two + 2, _AS_WORDS)
                    strange[two + 1] = pairs[np.minimum(np.searchsorted(pairs, hashes), len(pairs) - 1)] != hashes if len(pairs) else 1
                    strange = np.cumsum(strange)
                for view in views_of(w, kind, slot, maybe):
                    counts = np.diff(view.offsets)
                    total = np.repeat(counts, counts)
                    left = np.repeat(view.offsets[1:], counts) - np.arange(len(total))
                    seen = strange[np.repeat(w.offsets[:-1], counts) + view.place] if wanted is not None else None
                    for size in sizes:
                        fits = left >= size
                        if wanted is not None and len(fits) >= size:
                            fits[: len(fits) - size + 1] &= seen[size - 1 :] == seen[: len(fits) - size + 1]
                        if whole_items:
                            fits &= window_size(total, window) == size
                            if LITERAL not in view.forms:
                                fits &= total >= SHORTEST
                        starts = np.flatnonzero(fits)
                        for s in range(0, len(starts), 1 << 15):
                            part = starts[s : s + (1 << 15)]
                            a, b = part[0], part[-1] + size
                            for form, where, hashes, names in _forms(part - a, size, view.words[a:b], view.kind[a:b], view.slot[a:b], view.maybe[a:b], view.forms):
                                where, names = where + a, [at + a for at in names]
                                if wanted is not None:
                                    near = np.flatnonzero(gate[(hashes >> U(42)).astype(np.int64)])
                                    same = near[wanted[np.minimum(np.searchsorted(wanted, hashes[near]), len(wanted) - 1)] == hashes[near]]
                                    where, hashes, names = where[same], hashes[same], [at[same] for at in names]
                                if not len(where):
                                    continue
                                inside = where[:, None] + np.arange(size)
                                held = view.slot[inside] if form != LITERAL else np.zeros(inside.shape, bool)
                                for at in names:
                                    held[np.arange(len(where)), at - where] = True
                                ends = np.concatenate(([0], np.cumsum(held.sum(1)))).astype(np.int32)
                                owner = np.searchsorted(view.offsets, where, "right") - 1
                                yield pa.record_batch(
                                    [batch.column("id").take(pa.array(lo + owner)), pa.array(view.place[where].astype(np.int64)), pa.array(np.full(len(where), size, np.int32)), pa.array(signed(hashes)),
                                     pa.array(np.full(len(where), form, np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(mix(view.words[inside][held])))), pa.array((~held).sum(1).astype(np.int32)), pa.array(whole[owner].astype(np.int64))],
                                    ["id", "at", "size", "hash", "form", "slots", "literals", "total"],
                                )

    return run


_ROWS = "id long, at long, size int, hash long, form int, slots array<long>, literals int, total long"


def one_to_one(left: Column, right: Column) -> Column:
    """Whether the pairs at equal places of two arrays map values one to one."""
    pairs = F.size(F.array_distinct(F.arrays_zip(left.alias("l"), right.alias("r"))))
    return (F.size(left) == F.size(right)) & (F.size(F.array_distinct(left)) == pairs) & (F.size(F.array_distinct(right)) == pairs)


def _joined(pairs: list[tuple[int, int]], to: dict[int, int], back: dict[int, int]) -> tuple[dict[int, int], dict[int, int]] | None:
    """The one-to-one map with more pairs, or None if they contradict it."""
    to, back = dict(to), dict(back)
    for a, b in pairs:
        if to.setdefault(a, b) != b or back.setdefault(b, a) != a:
            return None
    return to, back


def aligned(windows: list[tuple[int, int, int, list[int], list[int]]]) -> int:
    """Number of item windows on one alignment. windows: (shift, item_at, form, slots, item_slots).

    Shifts join it by their number of windows: all of a shift's windows if their slot values together map one to one
    with those before, else those of the same words. Windows with sentence beginnings as names join one by one. Places in
    the document ascend with those in the item.
    """
    shifts: dict[int, tuple[set, dict, list]] = {}
    for shift, at, form, slots, own in sorted(windows, key=lambda x: x[:3]):
        literal, template, named = shifts.setdefault(shift, (set(), {}, []))
        if form == LITERAL:
            literal.add(at)
        elif form == TEMPLATE:
            template.setdefault(at, []).extend(zip(own, slots, strict=True))
        else:
            named.append((at, list(zip(own, slots, strict=True))))
    together = lambda template: [p for pairs in template.values() for p in pairs]
    whole = {s: len(x[0] | set(x[1])) if _joined(together(x[1]), {}, {}) else len(x[0]) for s, x in shifts.items()}
    most = {s: (-n, -len({at for at, _ in shifts[s][2]}), s) for s, n in whole.items()}
    places: list[int] = []
    shift_at: dict[int, int] = {}

    def ascends(at: int, shift: int) -> bool:
        k = bisect_left(places, at)
        if k < len(places) and places[k] == at:
            return False
        return (k == 0 or shift_at[places[k - 1]] + places[k - 1] < shift + at) and (k == len(places) or shift + at < shift_at[places[k]] + places[k])

    def add(at: int, shift: int) -> None:
        if ascends(at, shift):
            places.insert(bisect_left(places, at), at)
            shift_at[at] = shift

    known: tuple[dict, dict] = ({}, {})
    for s in sorted(shifts, key=most.get):
        literal, template, _ = shifts[s]
        template = {at: pairs for at, pairs in template.items() if ascends(at, s)}
        more = _joined(together(template), *known)
        known = more or known
        for at in sorted(literal | set(template) if more else literal):
            add(at, s)
    for s in sorted(shifts, key=most.get):
        for at, pairs in shifts[s][2]:
            more = _joined(pairs, *known) if ascends(at, s) else None
            if more:
                known = more
                add(at, s)
    return len(places)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = 0.0) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage): the best consistent alignment of every document and item that meet.

    A window counts if its slot values map one to one, and an alignment (windows at shifts that differ by less than the
    item's length) as in ``aligned``. Items of fewer than SHORTEST tokens match by their words as a whole, those of up to
    BARE only texts that hold nothing else. Pairs that cannot reach the least coverage may be left out. Items and documents
    with null text match nothing.
    """
    scratch = Scratch(docs.sparkSession, "templates")
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").distinct()
    of_items = items.mapInArrow(_windows(list(range(1, window + 1)), None, True, window), _ROWS).where(f"form = {LITERAL} or 2 * literals >= size")
    of_items = scratch.save(of_items.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "size", "hash", "form", F.col("slots").alias("item_slots"), "total"), "items")
    filtered = None
    if of_items.count() <= BROADCAST_WINDOWS:  # the size is checked: at most 16 MB; otherwise every window takes part in the join
        held = of_items.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(U)
        pairs = items.mapInArrow(_windows([2], None, False), _ROWS).where(f"form = {LITERAL}").select("hash").distinct()
        pairs = pairs.toPandas()["hash"].to_numpy(np.int64).view(U)
        filtered = docs.sparkSession.sparkContext.broadcast((np.sort(held), np.sort(pairs)))
    used = [r["size"] for r in of_items.select("size").distinct().collect()] or [window]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_windows(sorted(used), filtered, False), _ROWS).select(F.col("id").alias("doc_id"), "at", "size", "hash", "form", "slots", F.col("total").alias("doc_total"))
    met = found.join(of_items.drop("form"), ["hash", "size"]).where(one_to_one(F.col("slots"), F.col("item_slots"))).where(f"total > {BARE} or doc_total = total")
    met = met.withColumn("shift", F.col("at") - F.col("item_at"))
    # every two shifts of a document and item that differ by less than its length share a part, and a part has at most twice as many
    part = F.floor(F.col("shift") / F.col("total"))
    met = met.withColumn("part", F.explode(F.array(part, part + 1)))
    lines = met.groupBy("doc_id", "item_id", "part").agg(F.collect_set(F.struct("shift", "item_at", "form", "slots", "item_slots")).alias("met"))
    per_item = of_items.groupBy("item_id").agg(F.count_distinct("item_at").alias("windows"))
    lines = lines.join(per_item, "item_id").where(F.size(F.array_distinct("met.item_at")) >= F.lit(least) * F.col("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [aligned([tuple(x.values()) for x in found.as_py()]) for found in b.column("met")]
            yield pa.record_batch([b.column("doc_id"), b.column("item_id"), pa.array(counts, pa.int64()), b.column("windows")], ["doc_id", "item_id", "matched", "windows"])

    best = lines.select("doc_id", "item_id", "windows", "met").mapInArrow(run, "doc_id long, item_id long, matched long, windows long")
    best = best.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"))
    return best.select("doc_id", "item_id", "matched", "windows", (F.col("matched") / F.col("windows")).alias("coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, contaminated, items (sorted item ids), coverage (of the best of these, 0 without any) for every row of docs.

    Rows that repeat a doc_id, null included, are judged as one document. Empty and null texts are clean. Other columns
    are ignored; repeated items count once for each item_id. Empty benchmark: all clean. Empty docs: no rows.
    """
    hits = matches(docs, benchmark, least=coverage).where(F.col("coverage") >= coverage)
    leaks = hits.groupBy(F.col("doc_id").alias("leak")).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(leaks, F.col("doc_id").eqNullSafe(F.col("leak")) & F.col("items").isNotNull(), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
