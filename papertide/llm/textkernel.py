"""Vectorised tokenising and rolling hashes over the UTF-8 buffers of Arrow string columns.

Texts are never decoded: every separator and every folded letter is ASCII, so
words can be cut from the bytes.  A word's hash is a polynomial over random
byte codes modulo 2**64, mixed by a non-linear finaliser; n-gram hashes are
polynomials over those.  Two different words or n-grams share a 64-bit hash
with a probability of about 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of a text that are worked on at once.
LONG = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
STEP, STEP_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2**64)

SPACE_SPLIT = np.ones(256, bool)
SPACE_SPLIT[list(SPACES)] = False
#: Letters, digits and everything beyond ASCII, after A-Z is folded.
ALNUM_SPLIT = np.zeros(256, bool)
ALNUM_SPLIT[0x30:0x3A] = ALNUM_SPLIT[0x61:0x7B] = ALNUM_SPLIT[0x80:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


#: Tables of powers and of running sums over bytes are as long as this, however long a text is.
PIECE_BITS = 20
PIECE = 1 << PIECE_BITS


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, as products of two entries of tables of bounded size.

    Tables are made where they are used and do not travel with functions.
    """

    def __init__(self, base: int, inverse: int):
        self.base, self.inverse = base, inverse
        self.low: tuple[np.ndarray, np.ndarray] | None = None

    def __reduce__(self) -> tuple:
        return Powers, (self.base, self.inverse)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self.low is None:
            self.low = _powers(self.base, PIECE), _powers(self.inverse, PIECE)
        return self.low

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums, from 0 on, of the values times the powers of their places."""
        up = self.tables()[0]
        out = np.zeros(len(values) + 1, U64)
        factor, total = U64(1), U64(0)
        with np.errstate(over="ignore"):
            for lo in range(0, len(values), PIECE):
                part = values[lo : lo + PIECE]
                run = out[lo + 1 : lo + 1 + len(part)]
                np.multiply(part, up[: len(part)], out=run)
                np.cumsum(run, out=run)
                if lo:
                    run *= factor
                    run += total
                total = run[-1]
                factor *= U64(pow(self.base, PIECE, 2**64))
        return out

    def down(self, at: np.ndarray) -> np.ndarray:
        """The inverse's powers."""
        low = self.tables()[1]
        out = low[at & (PIECE - 1)]
        if len(at) and at.max() >= PIECE:
            out *= _powers(pow(self.inverse, PIECE, 2**64), (int(at.max()) >> PIECE_BITS) + 1)[at >> PIECE_BITS]
        return out


BYTE_POWERS, WORD_POWERS = Powers(BASE, BASE_INV), Powers(STEP, STEP_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        column = column.fill_null("")
        return column_bytes(column)
    return raw[cuts[0] : cuts[-1]], cuts - cuts[0]


def chunks(cuts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one longer row."""
    lo, n = 0, len(cuts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def counted(which: np.ndarray, data: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """How many bytes before each of some sorted places are marked in the table ``which``, for each array of places."""
    out, done, total = [np.zeros(len(at), np.int64) for at in places], [0] * len(places), 0
    for first in range(0, len(data) + 1, LONG):
        part = data[first : first + LONG]
        run = np.zeros(len(part) + 1, np.int32)
        np.cumsum(which[part], out=run[1:], dtype=np.int32)
        for k, at in enumerate(places):
            hi = len(at) if first + LONG > len(data) else int(np.searchsorted(at, first + LONG))
            out[k][done[k] : hi] = run[at[done[k] : hi] - first] + np.int64(total)
            done[k] = hi
        total += int(run[-1])
    return out


class Words:
    """Words of some rows: byte ranges, the words' range of each row, and their hashes.

    Besides the words, one row of any length takes some bytes of memory for each of its bytes.
    """

    def __init__(self, data: np.ndarray, cuts: np.ndarray, split: np.ndarray = SPACE_SPLIT, fold: bool = False):
        self.data, self.cuts = (FOLD[data] if fold else data), cuts
        inside = split[self.data]
        edges = cuts[:-1][cuts[:-1] < len(data)]
        # where a byte differs from the one before, a word begins or ends; a row's edge cuts a word in two
        turn = inside.copy()
        turn[1:] ^= inside[:-1]
        turn[edges] = False
        places = np.flatnonzero(turn)
        opens = inside[places]
        begins, stops = places[opens], places[~opens]
        own = edges[inside[edges]]
        ended = edges[edges > 0]
        ended = ended[inside[ended - 1]]
        if len(data) and inside[-1]:
            ended = np.append(ended, len(data))
        self.starts = _merged(begins, np.unique(own))
        self.ends = _merged(stops, np.unique(ended))
        #: Row r has the words bounds[r] to bounds[r + 1].
        self.bounds = np.searchsorted(self.starts, cuts)
        self.counts = np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, given in order."""
        raw = np.zeros(len(starts), U64)
        total, factor, i, j = U64(0), U64(1), 0, 0
        with np.errstate(over="ignore"):
            for first in range(0, len(self.data) + 1, LONG):
                p = BYTE_POWERS.sums(BYTE_CODE[self.data[first : first + LONG]])
                last = first + LONG > len(self.data)
                k = len(starts) if last else int(np.searchsorted(starts, first + LONG))
                m = len(ends) if last else int(np.searchsorted(ends, first + LONG))
                raw[j:m] += p[ends[j:m] - first] * factor + total
                raw[i:k] -= p[starts[i:k] - first] * factor + total
                total, factor, i, j = total + p[-1] * factor, factor * U64(pow(BASE, LONG, 2**64)), k, m
        raw *= BYTE_POWERS.down(starts)
        raw += (ends - starts).astype(U64) * U64(STEP)
        return mix(raw)

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def _merged(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Two sorted arrays as one."""
    return np.insert(some, np.searchsorted(some, others), others) if len(others) else some


class Grams:
    """Rolling hashes of the n-grams of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray):
        self.prefix = WORD_POWERS.sums(hashes)

    def at(self, starts: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        return mix((self.prefix[starts + n] - self.prefix[starts]) * WORD_POWERS.down(starts))


def gram_starts(words: Words, n: int) -> np.ndarray:
    """Where an n-gram begins that stays within its row."""
    at = np.arange(len(words.starts))
    return at[at + n <= np.repeat(words.bounds[1:], words.counts)]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the entries whose value occurs more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        twin = ranked[1:] == ranked[:-1]
        same[1:] |= twin
        same[:-1] |= twin
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks the words inside any of the windows of n words."""
    change = np.bincount(starts, minlength=total + 1) - np.bincount(starts + n, minlength=total + 1)
    return np.cumsum(change[:-1]) > 0


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
