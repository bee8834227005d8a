"""Elias-Fano sequences: ascending 64-bit numbers in about 2 + log2(universe / n) bits each.

The low bits of a number are kept as they are, the high bits as gaps in unary.
CHUNK numbers at a time are decoded; a directory has the first number of each
chunk and where its high bits begin. Arrays may lie in mapped memory.
"""
from __future__ import annotations

import numpy as np

CHUNK = 1 << 14


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the sequence of ascending `values`."""
    values = values.astype(np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    lows = []
    for at in range(0, n, CHUNK):
        bits = np.unpackbits(values[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
        lows.append(np.packbits(bits.ravel(), bitorder="little"))
    return {"head": np.array([n, low], np.int64), "low": np.concatenate(lows) if lows else np.zeros(0, np.uint8), "high": np.packbits(high, bitorder="little"),
            "firsts": values[::CHUNK], "begins": places[::CHUNK] if n else np.zeros(0, np.int64)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        (self.n, self.width), self.low, self.high, self.firsts, self.begins = arrays["head"].tolist(), arrays["low"], arrays["high"], arrays["firsts"], arrays["begins"]

    def __len__(self) -> int:
        return self.n

    def chunk(self, number: int) -> np.ndarray:
        first = number * CHUNK
        m = min(CHUNK, self.n - first)
        begin = int(self.begins[number])
        end = int(self.begins[number + 1]) if number + 1 < len(self.begins) else 8 * len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[begin >> 3:(end + 7) >> 3], bitorder="little")[begin & 7:end - (begin >> 3 << 3)])
        out = (places[:m] + (begin - first) - np.arange(m)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            at = first * self.width // 8  # CHUNK is a multiple of 8
            bits = np.zeros((m, 64), np.uint8)
            bits[:, :self.width] = np.unpackbits(self.low[at:at + (m * self.width + 7) // 8], count=m * self.width, bitorder="little").reshape(m, self.width)
            out |= np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        return out

    def all(self) -> np.ndarray:
        return np.concatenate([self.chunk(i) for i in range(len(self.firsts))]) if self.n else np.zeros(0, np.uint64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of ascending `values` in a sequence without repeats, -1 for those it has not; chunk after chunk."""
        values, out = values.astype(np.uint64), np.full(len(values), -1, np.int64)
        of = np.searchsorted(self.firsts, values, "right") - 1
        for number in of[np.flatnonzero(np.diff(of, prepend=-1))].tolist():  # ascending as well
            a, b = np.searchsorted(of, [number, number + 1])
            held = self.chunk(number)
            at = np.minimum(np.searchsorted(held, values[a:b]), len(held) - 1)
            out[a:b] = np.where(held[at] == values[a:b], at + number * CHUNK, -1)
        return out
