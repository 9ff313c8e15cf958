"""Words and their hashes for whole batches of text, as numpy arrays.

Texts of a slice are laid end to end with a separator between them.  A word of
up to eight bytes is hashed by mixing these and their number, which no two such
words share; that of a longer one is BLAKE2 of its bytes, which a task
remembers.  Runs of words take their hashes one after another into a state that
is mixed each time.  So neither words nor runs can be made to collide by
arithmetic on their letters.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Long words that a task remembers before it forgets them all.
REMEMBERED = 1 << 18
SHORT = 8

#: Bytes that separate words: space, tab to carriage return.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Everything but digits, lower-case letters and bytes of characters beyond ASCII.
NOT_LETTERS = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) for b in range(256)])


class _Hashes(dict):
    """Hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every bit over the whole value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i+k] for every i; beyond the end there are zeros."""
    state = np.full(len(values), k, np.uint64)
    for i in range(k):
        end = max(0, len(values) - i)
        state[:end] += values[i:]
        state *= np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(32)
    return mix(state)


@dataclass
class Words:
    """Words of all texts of a slice: word i of text d is at ``first[d] + i``."""

    first: np.ndarray  # per text: its first word; one more entry at the end
    start: np.ndarray  # per word, in bytes of ``buffer``
    end: np.ndarray
    hashes: np.ndarray
    buffer: bytes

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of words i..i+k-1, whether they lie in one text), for every word i."""
        text_end = np.repeat(self.first[1:], np.diff(self.first))
        return runs(self.hashes, k), np.arange(len(self.hashes)) + k <= text_end

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]

    def sequences(self, at: np.ndarray, k: int) -> list[memoryview]:
        """The bytes of words i..i+k-1 with one space between them, for every i of ``at``."""
        joined = memoryview(b" ".join(self.buffer.split()))
        ends = np.cumsum(self.end - self.start + 1)
        starts = ends - (self.end - self.start + 1)
        return [joined[a:b] for a, b in zip(starts[at].tolist(), (ends[at + k - 1] - 1).tolist(), strict=True)]


def words_of(texts: list[bytes], separators: np.ndarray = SPACES) -> Words:
    buffer = b" ".join(texts) + bytes([0x20] * SHORT)
    raw = np.frombuffer(buffer, np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
    offset = np.concatenate([[0], np.cumsum(sizes)])
    gap = np.concatenate([[True], separators[raw]])
    change = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = change[0::2], change[1::2]  # the buffer ends with separators
    length = end - start
    eight = np.ndarray(len(buffer) - SHORT + 1, "<u8", buffer, strides=(1,))  # the eight bytes from each place on
    # Shorter words have their number of bytes where those of eight have their first byte: with 0xF8 flipped it is none of 1 to 7.
    mark = np.where(length < SHORT, length, 0xF8).astype(np.uint64)
    hashes = mix((eight[start] << (np.uint64(8) * np.maximum(SHORT - length, 0).astype(np.uint64))) ^ mark)
    long = np.flatnonzero(length > SHORT)
    hashes[long] = np.fromiter(map(_HASHES.__getitem__, [buffer[a:b] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]), np.uint64, len(long))
    return Words(np.searchsorted(start, offset), start, end, hashes, buffer)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
