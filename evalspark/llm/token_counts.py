"""Exact token counts of every prefix of a text.

The tokenizer cuts a text into units (blanks and the word after them) that it encodes one by one, so the
count at a place is the count of the units before it plus that of the unit's own prefix. Within a
piece the counts follow by dynamic programming: the encoding of a prefix ends in the one
token that fits both the bytes before the place and the last token of the encoding before it, and
has one token more than that encoding. What is found for a prefix serves every word that
begins with it; the new words of a slice of texts are sorted and encoded together, all prefixes of a length at
a time. The counts of all prefixes are stored with the text, so truncation and budget questions
are answered by looking them up.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import output_schema, replaced, slices, strings

# units, pieces and prefixes that a task remembers, each; those of the half before stay at hand
MEMORY = 250_000
SHORT = (3, 2, 1)
BYTES = [bytes([i]) for i in range(256)]
# pieces of up to so many bytes are encoded together, so many at a time
BATCH_BYTES = 32
BATCH = 1 << 15
FILTER_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
# characters that some tokenizer may take for blanks
BLANK_CANDIDATES = (
    [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680)]
    + [chr(c) for c in range(0x2000, 0x200B)]
    + [chr(c) for c in (0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x180E, 0x200B)]
)


# The tokenizer's cutting rule for texts of Latin letters without other marks of their own kind; other
# texts are cut by the library. Fixed values.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
SIMPLE = re.compile(f"[\\x00-\\x1b!-~ {LATIN}]*")
CUT = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN}]+| ?[0-9]+| ?[^\\t-\\r {LATIN}0-9]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+"
)


def _byte_letters() -> dict[str, int]:
    """Bytes by the letters that a byte-level vocabulary writes them with.

    Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _hashes(columns: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of byte strings that are given by place; the first are of the empty one."""
    out = np.zeros((len(columns) + 1, columns.shape[1]), dtype=np.uint64)
    for place, values in enumerate(columns):
        out[place + 1] = out[place] * _ODD + (values.astype(np.uint64) + np.uint64(1))
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _ODD >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _by_code_points(raw: bytes, counts: list[int]) -> list[int]:
    """Counts of the prefixes by bytes at the ends of code points."""
    # a code point ends before a byte that doesn't continue one
    ends = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
    return [counts[i - 1] for i in ends] + counts[-1:]


class PrefixCounter:
    """Counts the tokens of all prefixes of texts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = _byte_letters()
        self.ids = {
            bytes(letters[c] for c in word): number
            for word, number in content["model"]["vocab"].items()
            if all(c in letters for c in word)
        }
        # lengths, from the longest, of the tokens that end in four bytes
        lengths: dict[bytes, set[int]] = {}
        for word in self.ids:
            if len(word) > 3:
                lengths.setdefault(word[-4:], set()).add(len(word))
        self.lengths = {end: (*sorted(found, reverse=True), *SHORT) for end, found in lengths.items()}
        self._lay_out(sorted(t for t in self.ids if 0 < len(t) <= BATCH_BYTES))
        self.written = {n: w for w, n in content["model"]["vocab"].items()}
        special = [t["content"] for t in content.get("added_tokens", []) if t.get("special")]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        cut = self.library.pre_tokenizer.pre_tokenize_str
        blanks = [c for c in BLANK_CANDIDATES if len(cut("!" + c)) == 2 and len(cut("a" + c)) == 2]
        self.blank = frozenset(blanks)
        kind = "".join(map(re.escape, blanks))
        self.unit = re.compile(f"[{kind}]*[^{kind}]+|[{kind}]+")
        self.fits: dict[int, bool] = {}
        # of each prefix of a piece: its last token, and the counts of its own prefixes as bytes
        self.last: dict[bytes, tuple[int, bytes]] = {b"": (-1, b"")}
        self.pieces: dict[str, list[int]] = {}
        self.units: dict[str, np.ndarray] = {}
        self.former: dict[str, np.ndarray] = {}

    def _lay_out(self, tokens: list[bytes]) -> None:
        """The tokens by their hash: number, length and bytes."""
        sizes = np.array([len(t) for t in tokens])
        table = np.array(tokens, dtype=f"S{BATCH_BYTES}").view(np.uint8).reshape(len(tokens), BATCH_BYTES)
        hashes = _hashes(table.T)[sizes, np.arange(len(tokens))]
        order = np.argsort(hashes)
        self.hashes, self.sizes, self.bytes = hashes[order], sizes[order], table[order].T.copy()
        self.numbers = np.array([self.ids[t] for t in tokens], dtype=np.int64)[order]
        self.longest = int(sizes.max())
        self.powers = np.cumprod(np.array([1] + [_ODD] * BATCH_BYTES, dtype=np.uint64))
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[_slots(self.hashes)] = True

    def _forget(self) -> None:
        """Drops what the memory holds beyond its bound, the older half of the units first."""
        if len(self.units) > MEMORY:
            self.former, self.units = self.units, {}
        if len(self.pieces) > MEMORY:
            self.pieces = {}
        if len(self.last) > 4 * MEMORY:
            self.last = {b"": (-1, b"")}

    def _fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are where they meet."""
        key = left << 20 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= 4 * MEMORY:
                self.fits.clear()
            merged = self.model.tokenize(self.written.get(left, "") + self.written[right])
            found = self.fits[key] = len(merged) == 1 + (left >= 0) and merged[-1].id == right
        return found

    def _piece(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of a piece, by bytes."""
        last, ids, lengths, fits = self.last, self.ids, self.lengths, self.fits
        # whatever begins a known prefix is known
        low, high = 0, len(piece) + 1
        while low < high - 1:
            middle = (low + high) // 2
            if piece[:middle] in last:
                low = middle
            else:
                high = middle
        counts = last[piece[:low]][1]
        for end in range(low + 1, len(piece) + 1):
            prefix = piece[:end]
            for size in lengths.get(prefix[-4:], SHORT):
                token = ids.get(prefix[-size:]) if size <= end else None
                if token is not None:
                    before = last[prefix[:-size]][0]
                    fit = fits.get(before << 20 | token)
                    if self._fit(before, token) if fit is None else fit:
                        counts += BYTES[counts[end - size - 1] + 1 if size < end else 1]
                        last[prefix] = (token, counts)
                        break
        return list(counts)

    def _all_fit(self, pairs: np.ndarray) -> np.ndarray:
        """``_fit`` of pairs, each as one number."""
        distinct, place = np.unique(pairs, return_inverse=True)
        keys = distinct.tolist()
        found = list(map(self.fits.get, keys))
        for at in [i for i, fit in enumerate(found) if fit is None]:
            found[at] = self._fit(keys[at] >> 20, keys[at] & (1 << 20) - 1)
        return np.array(found, dtype=bool)[place]

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the counts of sorted pieces, found for all prefixes of a length together."""
        raw = [piece.encode() for piece in pieces]
        lengths = np.array(list(map(len, raw)))
        rows, width = len(raw), int(lengths.max())
        columns = np.array(raw, dtype=f"S{width}").view(np.uint8).reshape(rows, width).T.copy()
        hashes = _hashes(columns)
        # a prefix that the piece before has as well isn't new
        differs = columns[:, 1:] != columns[:, :-1]
        same = np.where(differs.any(axis=0), differs.argmax(axis=0), width)
        shared = np.concatenate([[0], np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))])
        # of each new prefix: its last token and its count; 0 is the empty one
        states = np.zeros((width + 1, rows), dtype=np.int64)
        token = np.full(1 + int((lengths - shared).sum()), -1, dtype=np.int64)
        count = np.zeros(len(token), dtype=np.int64)
        base = 1
        for end in range(1, width + 1):
            open_ = np.flatnonzero((shared < end) & (lengths >= end))
            state = np.arange(base, base + len(open_))
            base += len(open_)
            new = np.zeros(rows, dtype=np.int64)
            new[open_] = state
            for size in range(min(end, self.longest), 0, -1):
                wanted = hashes[end][open_] - hashes[end - size][open_] * self.powers[size]
                at = np.flatnonzero(self.filter[_slots(wanted)])
                number = np.minimum(np.searchsorted(self.hashes, wanted[at]), len(self.hashes) - 1)
                some = (self.hashes[number] == wanted[at]) & (self.sizes[number] == size)
                at, number = at[some], number[some]
                if not len(at):
                    continue
                before = states[end - size][open_[at]]
                ids = self.numbers[number]
                fit = self._all_fit(token[before] << 20 | ids)
                for k in range(size):
                    fit &= self.bytes[k][number] == columns[end - size + k][open_[at]]
                at, before = at[fit], before[fit]
                token[state[at]] = ids[fit]
                count[state[at]] = count[before] + 1
                rest = np.ones(len(open_), dtype=bool)
                rest[at] = False
                open_, state = open_[rest], state[rest]
                if not len(open_):
                    break
            if len(open_):
                raise ValueError("no token ends a prefix")
            np.maximum.accumulate(new, out=states[end])
        found = count[states[1:]].T.tolist()
        for piece, own, counts in zip(pieces, raw, found):
            if len(own) == len(piece):
                self.pieces[piece] = counts[: len(own)]
            else:
                self.pieces[piece] = _by_code_points(own, counts[: len(own)])

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Remembers the units of texts that are new, their pieces encoded together; returns the units of each."""
        self._forget()
        units, former, known = self.units, self.former, self.pieces
        found = list(map(self.unit.findall, texts))
        names = set(chain.from_iterable(found))
        cut = {name: self._pieces(name) for name in names if name not in units and name not in former}
        new = sorted(
            p for p in set(chain.from_iterable(cut.values())).difference(known) if len(p.encode()) <= BATCH_BYTES
        )
        for start in range(0, len(new), BATCH):
            self._learn(new[start : start + BATCH])
        for name, pieces in cut.items():
            units[name] = self._unit(name, pieces)
        return found

    def _long_piece(self, raw: bytes) -> list[int]:
        """As ``_piece``, for a piece too long for its prefixes to be remembered."""
        states: list[tuple[int, int]] = [(-1, 0)]
        for end in range(1, len(raw) + 1):
            for size in self.lengths.get(raw[max(0, end - 4) : end], SHORT):
                token = self.ids.get(raw[end - size : end]) if size <= end else None
                if token is not None:
                    before, count = states[end - size]
                    if self._fit(before, token):
                        states.append((token, count + 1))
                        break
        return [count for _, count in states[1:]]

    def _of_piece(self, piece: str) -> list[int]:
        """Token counts of all prefixes of a piece, by code points."""
        counts = self.pieces.get(piece)
        if counts is None:
            raw = piece.encode()
            counts = self._piece(raw) if len(raw) <= 64 else self._long_piece(raw)
            if len(raw) != len(piece):
                counts = _by_code_points(raw, counts)
            self.pieces[piece] = counts
        return counts

    def _pieces(self, text: str) -> list[str]:
        if SIMPLE.fullmatch(text):
            return CUT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _unit(self, unit: str, pieces: list[str] | None = None) -> np.ndarray:
        """Token counts of all prefixes of a unit, by code points."""
        pieces = self._pieces(unit) if pieces is None else pieces
        if len(pieces) == 1 and unit[0] != "'" and not (unit[0] in self.blank and unit[1:2] in self.blank):
            return np.array(self._of_piece(unit), dtype=np.int32)
        blanks = 0
        while blanks < len(unit) and unit[blanks] in self.blank:
            blanks += 1
        # blanks at the end of a text are one piece; before a word the last stands by itself or with it
        out = list(self._of_piece(unit[:blanks])) if blanks else []
        at = done = 0
        for piece in pieces if blanks < len(unit) else ():
            inside = self._of_piece(piece)
            if len(piece) > 2 and piece[0] == "'":
                # a cut contraction isn't one piece
                inside = list(inside)
                for n in range(2, len(piece)):
                    inside[n - 1] = sum(self._of_piece(p)[-1] for p in self._pieces(piece[:n]))
            if at + len(piece) > blanks:
                out += [done + n for n in inside[max(0, blanks - at) :]]
            done += inside[-1]
            at += len(piece)
        return np.array(out, dtype=np.int32)

    def _segment(self, text: str, names: list[str] | None = None) -> tuple[np.ndarray, str]:
        """Counts of all prefixes of a text without special strings, of these units if they are known; its last unit."""
        names = self.unit.findall(text) if names is None else names
        if not names:
            return np.zeros(0, dtype=np.int32), ""
        units, former = self.units, self.former
        parts = list(map(units.get, names))
        for at in [i for i, counts in enumerate(parts) if counts is None]:
            name = names[at]
            counts = units.get(name)
            if counts is None:
                counts = former.get(name)
                units[name] = counts = self._unit(name) if counts is None else counts
            parts[at] = counts
        joined = np.concatenate(parts)
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        totals = joined[np.cumsum(lengths) - 1]
        before = np.cumsum(totals) - totals
        return joined + np.repeat(before, lengths).astype(np.int32), names[-1]

    def prefix_counts(self, text: str, names: list[str] | None = None) -> np.ndarray:
        """Number of tokens of ``text[:i]`` for every i from 0 to the length; ``names`` are its units, from ``prepare``."""
        self._forget()
        out = [np.zeros(1, dtype=np.int32)]
        base, at = 0, 0
        for match in self.special.finditer(text) if self.special else ():
            counts, unit = self._segment(text[at : match.start()])
            out.append(base + counts)
            before = base + (int(counts[-1]) if len(counts) else 0)
            own = int(self._unit(unit)[-1]) if unit else 0
            # a special string that is cut off is ordinary text
            marks = [
                before - own + int(self._segment(unit + match[0][:n])[0][-1])
                for n in range(1, len(match[0]))
            ]
            out.append(np.array([*marks, before + 1], dtype=np.int32))
            base, at = before + 1, match.end()
        out.append(base + self._segment(text[at:], None if at else names)[0])
        return np.concatenate(out)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of all prefixes, stored as compressed differences."""
    return zstandard.compress(np.diff(counts).astype("<i2").tobytes(), 1)


def unpack_counts(stored: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(stored), dtype="<i2")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def tokens_at(stored: bytes, chars: int) -> int:
    """Number of tokens of the first ``chars`` code points."""
    return int(unpack_counts(stored)[chars])


def longest_within(stored: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(unpack_counts(stored) <= budget)[-1])


def _counted(path: str, keep_prefixes: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(path)
        gc.disable()  # the memory holds many small values and no cycles
        for batch in batches:
            for part in slices(batch, "text"):
                totals, stored = [], []
                texts = strings(part, "text")
                for text, names in zip(texts, counter.prepare(texts)):
                    counts = counter.prefix_counts(text, names)
                    totals.append(int(counts[-1]))
                    stored.append(pack_counts(counts) if keep_prefixes else None)
                yield replaced(
                    part,
                    {
                        "n_tokens": pa.array(totals, pa.int64()),
                        "prefix_counts": pa.array(stored, pa.binary()),
                    },
                )

    return count


def count_tokens(docs: DataFrame, path: str, keep_prefixes: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``prefix_counts``, the stored counts of all prefixes.

    ``path`` is a byte-level BPE file of the tokenizers library, present on every executor. Counts are the library's, without
    begin, end or other added tokens; special strings in a text count as the library takes them by default. ``tokens_at`` and
    ``longest_within`` answer questions from the stored counts. A null text is the empty text, with 0 tokens. The columns take the place
    of columns of these names. Rows may repeat; an empty table gives an empty table.
    """
    added = {"n_tokens": "bigint", "prefix_counts": "binary"}
    return docs.mapInArrow(_counted(path, keep_prefixes), output_schema(docs, added))


def truncated(counted: DataFrame, budget: int) -> DataFrame:
    """``counted`` with each text cut to its longest prefix of at most ``budget`` tokens."""

    @F.pandas_udf("int")
    def longest(stored: pd.Series) -> pd.Series:
        return stored.map(lambda s: longest_within(s, budget))

    return counted.withColumn("text", F.left(F.col("text"), longest("prefix_counts")))
