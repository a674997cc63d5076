"""Operator 5: byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece of text there is exactly one token that ends its encoding. That token is the only one
that ends at the prefix and may follow the last token of the prefix before it, where two tokens may follow each other if
merging their joint bytes gives back just these two. The table of last tokens grows by one entry a byte, so appending
needs only the new bytes, an edit keeps the table before it, and reading the tokens walks the table from its end.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers; beyond it the memory starts anew, which changes the speed only.
REMEMBERED = 700_000


class Ranks:
    """A vocabulary whose token ids are also the merge priorities, lower first."""

    def __init__(self, raw: bytes):
        self.id_of = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}
        self.bytes_of = {i: token for token, i in self.id_of.items()}
        self.sizes = {i: len(token) for token, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of), default=1)
        self.follows: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.endings = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.endings.add_word(token.decode("latin-1"), (i, len(token)))
        self.endings.make_automaton()

    def merged(self, data: bytes, below: int = 1 << 62) -> list[bytes]:
        """Plain merging by tokens below a rank: the adjacent pair of lowest rank becomes one, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.id_of.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that merge into this one; (-1, -1) for one that no merge makes."""
        known = self.parts.get(token)
        if known is None:
            pair = self.merged(self.bytes_of[token], token)
            known = self.parts[token] = (self.id_of[pair[0]], self.id_of[pair[1]]) if len(pair) == 2 else (-1, -1)
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of two tokens gives back just these two.

        Merges are undone from the last one on. The tokens at the border must never have had a merge with each other of
        lower rank than the merge that took one of them away; of equal ranks the merge further left came first.
        """
        known = self.follows.get(left << 20 | right)
        if known is not None:
            return known
        if len(self.follows) > 4 * REMEMBERED:
            self.follows.clear()
        x, y, until = left, right, 1 << 62
        while True:
            if self.id_of.get(self.bytes_of[x] + self.bytes_of[y], 1 << 62) < until:
                known = False
                break
            end, start = self.halves(x)[1], self.halves(y)[0]
            if end >= 0 and (start < 0 or x > y):
                x, until = end, x
            elif start >= 0:
                y, until = start, y + 1
            else:
                known = True
                break
        self.follows[left << 20 | right] = known
        return known

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of many pieces: their prefix tables, one behind the other, in one walk over all tokens that end anywhere."""
        joined = "\u0100".join(x.decode("latin-1") for x in pieces)
        last = [-1] * (len(joined) + 1)
        ends, at = [], 0
        for piece in pieces:
            last[at] = -2  # a piece begins here: any token may
            at += len(piece) + 1
            ends.append(at - 1)
        known, follows = self.follows.get, self.may_follow
        for stop, (token, size) in self.endings.iter(joined):
            stop += 1
            if last[stop] == -1:
                left = last[stop - size]
                if left >= 0:
                    fits = known(left << 20 | token)
                    if fits or fits is None and follows(left, token):
                        last[stop] = token
                elif left == -2:
                    last[stop] = token
        out, begin, sizes = [], 0, self.sizes
        for end in ends:
            own, at = [], end
            while at > begin:
                token = last[at]
                if token < 0:
                    raise ValueError(f"the vocabulary has no token for byte {ord(joined[at - 1])}")
                own.append(token)
                at -= sizes[token]
            own.reverse()
            out.append(own)
            begin = end + 1
        return out


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        data, last, ranks = self.data, self.last, self.ranks
        get, follows = ranks.id_of.get, ranks.may_follow
        for end in range(begin + 1, len(data) + 1):
            for start in range(max(0, end - ranks.longest), end):
                token = get(data[start:end])
                if token is not None and (start == 0 or follows(last[start], token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")

    def cut(self, length: int) -> None:
        """Keeps the first ``length`` bytes."""
        self.data = self.data[:length]
        del self.last[length + 1 :]

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.ranks.bytes_of[out[-1]])
        return out[::-1]


class TextEncoding:
    """Encoding of one text that stays exact under appends and edits.

    A piece depends on the text from its start on and sees at most three characters beyond its end, so pieces that end
    three characters before a change stay, and splitting stops where it meets an old piece's start beyond the change.
    """

    def __init__(self, ranks: Ranks, pattern: str, text: str = ""):
        self.ranks, self.pattern, self.text = ranks, regex.compile(pattern), ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in place of text[start:end] and encodes anew near it."""
        old_len, shift = len(self.text), len(new) - (end - start)
        ends = [*self.starts[1:], old_len] if self.starts else []
        keep = next((k for k, e in enumerate(ends) if e > start - 3), len(ends))
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        self.text = self.text[:start] + new + self.text[end:]
        at = self.starts[keep] if keep < len(self.starts) else (ends[-1] if ends else 0)
        starts, tables = self.starts[:keep], self.tables[:keep]
        reuse = self.tables[keep] if keep < len(self.tables) else None
        while at < len(self.text):
            if at in old and at >= start + len(new):
                k = old[at]
                starts += [s + shift for s in self.starts[k:]]
                tables += self.tables[k:]
                break
            piece = self.pattern.match(self.text, at)[0]
            raw = piece.encode()
            if reuse is not None and raw.startswith(reuse.data):  # a longer piece than before: only its new bytes
                reuse.append(raw[len(reuse.data) :])
                tables.append(reuse)
            else:
                tables.append(PrefixTable(self.ranks, raw))
            reuse = None
            starts.append(at)
            at += len(piece)
        self.starts, self.tables = starts, tables

    def tokens(self) -> list[int]:
        return [t for table in self.tables for t in table.tokens()]


class _Memory:
    """Tokens of the pieces seen so far, side by side in one array."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks, self.split = Ranks(raw), regex.compile(pattern).findall
        top = max(self.ranks.bytes_of, default=-1) + 1
        parts = [self.ranks.bytes_of.get(i, b"") for i in range(top)]
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.lengths)))
        self.letters = np.frombuffer(b"".join(parts), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.stops = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _add(self, pieces: list[str]) -> None:
        """Encodes new pieces and puts their tokens behind the others; the arrays double when they are full."""
        id_of, at = self.ranks.id_of, len(self.number)
        raw = [piece.encode() for piece in pieces]
        rest = iter(self.ranks.encode_pieces([x for x in raw if x not in id_of]))
        tokens, ends = [], []
        for x in raw:
            if (whole := id_of.get(x)) is not None:  # a token's bytes are encoded as that token
                tokens.append(whole)
            else:
                tokens += next(rest)
            ends.append(len(tokens))
        self.number.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        have = int(self.stops[at])
        while len(self.flat) < have + len(tokens):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.stops) < at + len(pieces) + 1:
            self.stops = np.concatenate((self.stops, np.zeros_like(self.stops)))
        self.flat[have : have + len(tokens)] = tokens
        self.stops[at + 1 : at + len(pieces) + 1] = have + np.array(ends, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        new = list(set().union(*split).difference(self.number))
        if new:
            if len(self.number) + len(new) > REMEMBERED:
                self.forget()
                new = list(set().union(*split))
            self._add(new)
        out = []
        for pieces in split:
            numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
            start = self.stops[numbers]
            out.append(_gather(self.flat, start, self.stops[numbers + 1] - start))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return _gather(self.letters, self.places[ids], self.lengths[ids]).tobytes()


def _gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(start - ends + length, length)]


_memories: dict[tuple[int, str], _Memory] = {}


def _memory(raw: bytes, pattern: str) -> _Memory:
    key = (hash(raw), pattern)
    if key not in _memories:
        _memories.clear()
        _memories[key] = _Memory(raw, pattern)
    return _memories[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded (binary) for every row of docs.

    Each match of ``pattern`` is encoded separately by the ranks of the file at ``ranks_path`` (a token in base64 and its
    rank on each line), without special tokens; then the ids are decoded. Null and empty texts have no ids and decode to
    no bytes. Repeated rows and null doc_ids are rows like others; other columns are ignored. Empty input: no rows.
    The file has a fixed size and is broadcast; a text is one row of one task, of any length.
    """
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(shared.value, pattern)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < len(texts):
                to, size, own = at, 0, []
                while to < len(texts) and size < 1 << 20:
                    own.append(texts[to].as_py() or "")
                    size += len(own[-1])
                    to += 1
                parts = memory.encode(own)
                counts = np.array([len(x) for x in parts], np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.concatenate(parts)))
                out = [ids.slice(at, to - at), pa.array(counts), tokens]
                if decoded:
                    out.append(pa.array([memory.decode(x) for x in parts], pa.binary()))
                yield pa.record_batch(out, ["doc_id", "n_tokens", "ids", "decoded"][: len(out)])
                at = to

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>" + ", decoded binary" * decoded)
