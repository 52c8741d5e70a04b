"""Elias-Fano coded monotone sequences, and files of token ids with document boundaries so coded."""

from __future__ import annotations

import json

#: Every so many ones of the upper bits have their position sampled for select.
SAMPLE = 64
MAGIC = b"EFTOKEN1"
#: Ids that are read at once.
READ = 1 << 20


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(largest / number) bits each.

    The lower ``low_bits`` bits of each value lie packed one after another; the upper parts are unary: value i sets bit
    (value >> low_bits) + i. ``select(i)`` finds the i-th set bit from a sample of their positions.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        import numpy as np

        values = np.asarray(values, "i8")
        n = len(values)
        low_bits = max(0, int((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits) & 1).astype("u1") if low_bits else np.zeros((n, 0), "u1")
        at = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, "u1")
        high[at] = 1
        pack = lambda x: np.packbits(x.ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, pack(bits), pack(high), at[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        last = first + self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3], "little") >> (first & 7) & ((1 << self.low_bits) - 1)
        return (at - i) << self.low_bits | low

    def all(self):
        """All values, as an array."""
        import numpy as np

        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, "u1"), bitorder="little"))
        values = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, "u1"), bitorder="little")[: self.n * self.low_bits]
            values = values | bits.reshape(self.n, self.low_bits).astype("i8") @ (1 << np.arange(self.low_bits, dtype="i8"))
        return values

    def size(self) -> int:
        """Bytes of all parts."""
        return len(self.low) + len(self.high) + self.samples.nbytes


class TokenFileWriter:
    """Writes ids as they come, then the documents' keys and boundaries: magic, ids, keys, low and high bits, samples, footer."""

    def __init__(self, sink, wide: bool):
        self.sink, self.dtype, self.keys, self.ends = sink, "<u4" if wide else "<u2", [], [0]
        sink.write(MAGIC)

    def add(self, key: int | None, ids) -> None:
        """A document: its key and ids, an array of unsigned integers."""
        self.sink.write(ids.astype(self.dtype).tobytes())
        self.keys.append(key)
        self.ends.append(self.ends[-1] + len(ids))

    def close(self) -> None:
        import numpy as np

        bounds = EliasFano.of(self.ends)
        none = [i for i, k in enumerate(self.keys) if k is None]
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes()
        parts = {"keys": keys, "low": bounds.low, "high": bounds.high, "samples": bounds.samples.tobytes()}
        at = len(MAGIC) + self.ends[-1] * np.dtype(self.dtype).itemsize
        footer = {"dtype": self.dtype, "n": bounds.n, "low_bits": bounds.low_bits, "none": none, "parts": {}}
        for name, part in parts.items():
            self.sink.write(part)
            footer["parts"][name] = [at, len(part)]
            at += len(part)
        text = json.dumps(footer).encode()
        self.sink.write(text + len(text).to_bytes(8, "little") + MAGIC)
        self.sink.close()


class TokenFile:
    """Reads a file of TokenFileWriter: keys and boundaries at once, ids by document."""

    def __init__(self, source, size: int):
        import numpy as np

        self.source = source
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(tail[:8], "little")
        footer = json.loads(source.read_at(length, size - 16 - length))
        part = {k: source.read_at(n, at) for k, (at, n) in footer["parts"].items()}
        self.dtype, none = np.dtype(footer["dtype"]), set(footer["none"])
        self.keys = [None if i in none else k for i, k in enumerate(np.frombuffer(part["keys"], "<i8").tolist())]
        self.bounds = EliasFano(footer["n"], footer["low_bits"], part["low"], part["high"], np.frombuffer(part["samples"], "<u8"))

    def ids(self, i: int):
        """Document i's ids."""
        import numpy as np

        first, end = self.bounds.select(i), self.bounds.select(i + 1)
        w = self.dtype.itemsize
        return np.frombuffer(self.source.read_at((end - first) * w, len(MAGIC) + first * w), self.dtype)

    def documents(self, most: int = READ):
        """(key, ids before it, ids) of each document in order, read about ``most`` ids at a time, one document at least."""
        import numpy as np

        w, i, n = self.dtype.itemsize, 0, len(self.keys)
        while i < n:
            ends = [self.bounds.select(i)]
            while i + len(ends) <= n and (len(ends) == 1 or self.bounds.select(i + len(ends)) - ends[0] <= most):
                ends.append(self.bounds.select(i + len(ends)))
            block = np.frombuffer(self.source.read_at((ends[-1] - ends[0]) * w, len(MAGIC) + ends[0] * w), self.dtype)
            for a, b in zip(ends, ends[1:]):
                yield self.keys[i], a, block[a - ends[0] : b - ends[0]]
                i += 1
