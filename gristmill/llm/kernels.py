"""Vectorised text kernels: words, rolling hashes and windows over a batch of texts held as one byte buffer.

Nothing here loops over words or bytes in Python. A batch is cut into slices of bounded size, so the
working arrays stay within a few hundred megabytes whatever the batch holds; one text longer than a slice
makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Hashes are polynomials modulo the prime 2^31 - 1, in two lanes with bases of their own. (Modulo a power of two,
#: long words of two letters collide whatever the base.)
_PRIME, _SHIFT = np.uint64((1 << 31) - 1), np.uint64(31)
_DRAW = np.random.default_rng(20240229)
_BASES = [int(b) for b in _DRAW.integers(1 << 20, (1 << 31) - 2, 2)]
_BYTES = _DRAW.integers(1, (1 << 31) - 1, (2, 256), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x in place of a smaller number with the same residue modulo 2^31 - 1; twice brings any 63 bits to 2^31 + 1 at most."""
    high = x >> _SHIFT
    x &= _PRIME
    x += high
    return x


def powers(n: int, lane: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a lane's base (or of its inverse) modulo 2^31 - 1, up to the prime itself."""
    have = _POWERS.get((lane, inverse))
    if have is None or len(have) < n:
        prime = int(_PRIME)
        base = pow(_BASES[lane], -1, prime) if inverse else _BASES[lane]
        have = np.ones(1, dtype=np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, _fold(_fold(have * np.uint64(pow(base, len(have), prime))))])
        _POWERS[lane, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column (null: empty) and the n+1 offsets of its values."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``most`` bytes each, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def _sums(terms: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    """Two rows of n+1 prefix sums of value times power, unreduced: below 2^32 a term."""
    sums = np.zeros((2, n + 1), dtype=np.uint64)
    for lane in (0, 1):
        np.cumsum(_fold(terms(lane) * powers(n, lane)), out=sums[lane, 1:])
    return sums


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of the bytes, for ``span_hashes``."""
    return _sums(lambda lane: _BYTES[lane][raw], len(raw))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of 64-bit values, such as the hashes of words; each lane takes 31 bits."""
    return _sums(lambda lane: values >> np.uint64(33) if lane else values & _PRIME, len(values))


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end) for each span; equal spans have equal hashes wherever they stand."""
    lanes = [_lane(sums[k].take(end) - sums[k].take(start), powers(sums.shape[1], k, inverse=True).take(start)) for k in (0, 1)]
    return mix((lanes[0] << np.uint64(32) | lanes[1]) + mix((end - start).astype(np.uint64)))


def rolling_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """``span_hashes`` of all spans of ``width``."""
    n = max(sums.shape[1] - width, 0)
    lanes = [_lane(sums[k, width:] - sums[k, :n], powers(sums.shape[1], k, inverse=True)[:n]) for k in (0, 1)]
    return mix((lanes[0] << np.uint64(32) | lanes[1]) + mix(np.full(1, width, dtype=np.uint64)))


def _lane(difference: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    x = _fold(_fold(difference))
    x *= inverse
    x = _fold(_fold(x))
    x -= (x >= _PRIME) * _PRIME
    return x


@dataclass
class Words:
    """Words of a slice of texts: byte spans, hashes and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n_texts + 1


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, with the hash of their bytes (of A-Z lower-cased if asked)."""
    solid = ~_IS_SPACE[raw]
    n = len(raw)
    opens = np.zeros(n + 1, dtype=bool)
    opens[offsets[:-1]] = True  # a text boundary breaks a word; position n is of no matter
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | opens[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | opens[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_hashes(_LOWER[raw] if lower else raw)
    return Words(start, end, span_hashes(sums, start, end), np.searchsorted(start, offsets))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values; the last n-1 positions have none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    weights = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    total = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        total += hashes[i : i + m] * weights[i]
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed integer, as Spark's long."""
    return x.view(np.int64)
