"""Vectorised word and window hashing over the byte buffers of Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 is the pattern
``[^\\x20\\x09-\\x0D]+``.  A word's hash is a chain of mixed 8-byte lanes (XXH3 beyond LANES of
them), which has no algebraic structure that texts could exploit.  Windows of word hashes are
Rabin-Karp polynomials modulo 2**64 from running sums, then mixed; such polynomials are sound for
windows of far fewer than 1,024 words, as all here are.  A batch costs a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: An odd multiplier, so that it has an inverse modulo 2**64.
WORD_BASE = 0xC2B2AE3D27D4EB4F
#: Byte ranges of up to this many 8-byte lanes are hashed together, longer ones each by itself.
LANES = 32
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; the table grows by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = [np.full(size, b, U) for b in (base, pow(base, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
            np.cumprod(s, out=s)
        have = _powers[base] = (steps[0], steps[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def hashed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges [start, end), the same wherever in the buffer it stands."""
    size = end - start
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    for k in range(LANES):
        if not len(left):
            break
        lane = lanes[start[left] + 8 * k] & _LOW_BYTES[np.minimum(size[left] - 8 * k, 8)]
        h[left] = mix((h[left] ^ lane) * U(0x9E3779B97F4A7C15) + U(k + 1))
        left = left[size[left] > 8 * (k + 1)]
    long = np.flatnonzero(size > 8 * LANES)
    if len(long):
        import xxhash

        h[long] = [xxhash.xxh3_64_intdigest(buf[a:b].tobytes()) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of values[i] * base**i, with a leading zero."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def ranged(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of values[start:end], the same wherever in the buffer it stands."""
    return (sums[end] - sums[start]) * powers(base, len(sums))[1][start]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


#: Bytes of text that are hashed at once: below 2**21, so that the tables of powers stay at 16 MB each.
PIECE = 2_000_000


def pieces(table: pa.Table | pa.RecordBatch, text: str, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes of text; one longer text is a range of its own."""
    if not table.num_rows:
        return
    _, offsets = texts(table.column(text))
    start = 0
    while start < table.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end
        start = end


class Words:
    """The words of a run of texts: byte ranges, hashes and the text that each belongs to."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = SEPARATOR):
        self.raw, self.offsets = buf, offsets
        self.buf = LOWER[buf] if lower else buf
        inside = ~separator[self.buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(buf), bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(buf), bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each text, n + 1 values
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hashed(self.buf, self.start, self.end)
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and Rabin-Karp hash of each k consecutive words of one text."""
        at = np.arange(max(0, len(self.start) - k + 1))
        at = at[self.text[at] == self.text[at + k - 1]] if len(at) else at
        return at, mix(ranged(running(self.hash, WORD_BASE), at, at + k, WORD_BASE))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the first ascending, as planes of bytes under zstandard."""
    import zstandard

    n = len(columns[0])
    planes = []
    for k, c in enumerate(columns):
        c = np.ascontiguousarray(c).view(U)
        if k == 0:
            c = np.diff(c, prepend=U(0))
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(n, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(b"".join(planes))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out = [np.ascontiguousarray(p.reshape(8, -1).T).reshape(-1).view(U) for p in np.split(flat, columns)]
    out[0] = np.cumsum(out[0], dtype=U)
    return out


def runs(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
