"""Words, hashes and packed fingerprints of whole columns of text, in numpy.

Texts are handled in slices of about 400 kilobytes (a longer text is a slice of its own), so
memory follows the longest text, not the batch. Hashes are differences of running sums of
random values times powers of an odd number modulo 2^64, scrambled afterwards.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = (20240229, 77003311)
_TABLES = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in _SEEDS]
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: list = [None, None]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n."""
    held = _POWERS[k]
    if held is None or len(held[0]) < n:
        size = max(n, SLICE + 1)
        up, down = np.full(size, _BASES[k], np.uint64), np.full(size, pow(_BASES[k], -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        held = np.cumprod(up), np.cumprod(down)
        if size <= 8 * SLICE:
            _POWERS[k] = held
    return held


def spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = powers(len(buf) + 1, k)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLES[k][buf] * up[:len(buf)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sequences(values: np.ndarray, width: int, k: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive values; one for each start that fits."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(_BASES[k]) + values[j:j + n]
    return mix(out)


class Texts:
    """A slice of a column: its bytes, document edges, words."""

    def __init__(self, buf: np.ndarray, edges: np.ndarray, lower: bool = False):
        self.buf, self.edges = buf, edges
        if lower:
            up = (buf >= 65) & (buf <= 90)
            self.buf = buf + up.astype(np.uint8) * np.uint8(32)

    def words(self) -> None:
        """starts, ends: byte span of each word; first: number of the first word of each document, and the end."""
        solid = ~_SPACE[self.buf]
        before, after = np.empty_like(solid), np.empty_like(solid)
        if len(solid):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            inner = self.edges[1:-1]
            before[inner[inner < len(solid)]] = False
            after[inner[inner > 0] - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, self.edges)

    def word_hashes(self, k: int = 0) -> np.ndarray:
        return spans(self.buf, self.starts, self.ends, k)

    def windows(self, hashes: np.ndarray, width: int, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start in the document, hash) of every window of words inside a document."""
        counts = np.diff(self.first)
        fits = np.maximum(counts - width + 1, 0)
        doc = np.repeat(np.arange(len(counts)), fits)
        at = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
        every = sequences(hashes, width, k)
        return doc, at, every[self.first[doc] + at] if len(doc) else np.zeros(0, np.uint64)


def slices(column: pa.Array, lower: bool = False):
    """(first row, Texts) over a column; null counts as empty."""
    for start in range(0, len(column), 512):
        some = pc.fill_null(column.slice(start, 512).cast(pa.large_string()), "")
        offsets = np.frombuffer(some.buffers()[1], np.int64)[some.offset:some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2], np.uint8) if some.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            yield start + at, Texts(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], lower)
            at = to


_CODEC = pa.Codec("zstd", compression_level=1)


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences, with their count in front."""
    raw = np.diff(values, prepend=values.dtype.type(0)) if len(values) else values
    return len(values).to_bytes(8, "little") + (_CODEC.compress(raw.tobytes(), asbytes=True) if len(values) else b"")


def expand(data: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    return np.cumsum(np.frombuffer(_CODEC.decompress(data[8:], n * np.dtype(dtype).itemsize), dtype), dtype=dtype)


def narrow(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of 64-bit values."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def widen(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()
