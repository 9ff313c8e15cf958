"""Byte-level BPE over numpy matrices.

Texts are split by the vocabulary's pattern.  Every distinct piece that a task
has not met lately goes into a padded matrix of its length class; in each round
every row of the matrix merges its leftmost pair of minimum rank.  Pairs are
found in an open-addressing hash table, and rows are compacted after a merge.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

#: Token ids are below this; a pair is one 40-bit integer.
_SHIFT = np.int64(20)
_NONE = np.int64(1 << 60)
#: Pieces longer than this are merged with a heap: a round per merge would be quadratic.
LONGEST_ROW = 512
#: Distinct pieces that a worker remembers; then it starts anew.
REMEMBERED = 200_000


class Ranks:
    """A rank file: token bytes, and for each pair of tokens the token they merge into."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.int64) << _SHIFT) | np.array(right, np.int64)
        self._bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._values = np.full(1 << self._bits, _NONE, np.int64)
        self._fill(keys, np.array(merged, np.int64))
        self.pairs = dict(zip(keys.tolist(), merged, strict=True))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self._bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask, at = len(self._keys) - 1, self._slots(keys)
        while len(keys):
            free = self._keys[at] == -1
            self._keys[at[free]] = keys[free]
            placed = self._keys[at] == keys  # of those that wanted one slot, one has it
            self._values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & mask

    def merged(self, keys: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, or a value above every token."""
        flat = keys.ravel()
        out = np.full(flat.shape, _NONE, np.int64)
        at, left = self._slots(flat), np.arange(len(flat))
        while len(left):
            there = self._keys[at]
            hit = there == flat[left]
            out[left[hit]] = self._values[at[hit]]
            more = ~hit & (there != -1)
            left, at = left[more], (at[more] + 1) & (len(self._keys) - 1)
        return out.reshape(keys.shape)


def _merge_rows(ids: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> None:
    """Merge every row of ``ids`` (padded with -1) in place until no row has a pair left."""
    width = ids.shape[1]
    columns = np.arange(width)
    rows = np.flatnonzero(lengths > 1)
    best = ranks_of_pairs(ids[rows], ranks)
    while len(rows):
        at = best.argmin(axis=1)  # the first of equal ranks: the leftmost
        token = best[np.arange(len(rows)), at]
        going = token < _NONE
        if not going.all():
            rows, best, at, token = rows[going], best[going], at[going], token[going]
            if not len(rows):
                break
        part = ids[rows]
        # Compaction: what stands right of the merged pair moves left by one.
        shifted = np.concatenate([part[:, 1:], np.full((len(rows), 1), -1, np.int64)], axis=1)
        part = np.where(columns > at[:, None], shifted, part)
        r = np.arange(len(rows))
        part[r, at] = token
        ids[rows] = part
        lengths[rows] -= 1
        moved = np.concatenate([best[:, 1:], np.full((len(rows), 1), _NONE, np.int64)], axis=1)
        best = np.where(columns[: width - 1] > at[:, None], moved, best)
        for offset in (-1, 0):  # only the two pairs that hold the new token change
            left = at + offset
            ok = (left >= 0) & (left + 1 < width)
            pair = (part[r[ok], left[ok]] << _SHIFT) | part[r[ok], left[ok] + 1]
            found = ranks.merged(pair)
            best[r[ok], left[ok]] = np.where(part[r[ok], left[ok] + 1] < 0, _NONE, found)


def ranks_of_pairs(ids: np.ndarray, ranks: Ranks) -> np.ndarray:
    if ids.shape[1] < 2:
        return np.full((len(ids), 1), _NONE, np.int64)
    found = ranks.merged((np.maximum(ids[:, :-1], 0) << _SHIFT) | np.maximum(ids[:, 1:], 0))
    found[ids[:, 1:] < 0] = _NONE
    return found


def _merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """One long piece by a heap of pairs over a linked list: the same order of merges."""
    import heapq

    ids = [int(ranks.byte_id[b]) for b in piece]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    end, pairs, shift = len(ids), ranks.pairs, int(_SHIFT)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := pairs.get((a << shift) | b)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else end
        if j >= end or ids[j] != b:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[i] < end:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < end and (r := pairs.get((ids[x] << shift) | ids[y])) is not None:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return [x for x in ids if x >= 0]


def stand_ins() -> dict[int, str]:
    """Code points that this machine's ``regex`` and ``tiktoken`` class differently.

    The two carry different Unicode versions.  Each such code point is given one
    that both put where tiktoken puts it: a letter, a digit, a space, or none.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ranks = {bytes([b]): b for b in range(256)}
    found: dict[int, str] = {}
    for kind, one in ((r"\p{L}", "\u00e9"), (r"\p{N}", "5"), (r"\s", "\t")):
        theirs = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=ranks, special_tokens={})
        has = set(bytes(theirs.encode_ordinary(every)).decode())
        ours = set(regex.findall(kind, every))
        found |= {ord(c): one for c in has - ours}
        found |= {ord(c): found.get(ord(c), "\U000f0000") for c in ours - has}
    return found


def as_ranges(points: Iterable[int]) -> str:
    """Code points as the inside of a character class."""
    runs: list[list[int]] = []
    for c in sorted(points):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self._pattern = regex.compile(pattern)
        self._stand_ins = stand_ins()
        self._odd = re.compile(f"[{as_ranges(self._stand_ins)}]") if self._stand_ins else None
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, with characters classed as tiktoken does."""
        if self._odd is None or text.isascii() or not self._odd.search(text):
            return self._pattern.findall(text)
        return [text[m.start() : m.end()] for m in self._pattern.finditer(text.translate(self._stand_ins))]

    def _learn(self, pieces: list[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.rank.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONGEST_ROW:
                self.known[piece] = np.array(_merge_long(raw, self.ranks), "<u4").tobytes()
            else:
                by_width.setdefault(max(4, (len(raw) + 3) // 4 * 4 if len(raw) <= 32 else 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, same in by_width.items():
            step = max(1, 400_000 // width)
            for start in range(0, len(same), step):
                self._encode_matrix(width, same[start : start + step])

    def _encode_matrix(self, width: int, same: list[tuple[str, bytes]]) -> None:
        lengths = np.array([len(raw) for _, raw in same], np.int64)
        raw = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in same), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.ranks.byte_id[raw], -1)
        _merge_rows(ids, lengths, self.ranks)
        packed = ids.astype("<i4")
        for (piece, _), row, n in zip(same, packed, lengths.tolist(), strict=True):
            self.known[piece] = row[:n].tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Texts are taken in groups of about a million characters, so that the
        pieces held at once don't grow with the batch.
        """
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= 1_000_000 or i == len(texts) - 1:
                split = [self.split(x) for x in group]
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                new = {piece for pieces in split for piece in pieces if piece not in self.known}
                if new:
                    self._learn(list(new))
                for pieces in split:
                    yield b"".join(map(self.known.__getitem__, pieces))
                group, size = [], 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder of a rank file; workers are used for many tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", characters: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that a slice holds about so much text; null counts as empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(len(batch), np.int64)
        if len(batch):
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            total += n
            if total >= characters or i == len(sizes) - 1:
                part = batch.slice(start, i + 1 - start)
                yield part, [x or "" for x in part.column(part.schema.get_field_index(column)).to_pylist()]
                start, total = i + 1, 0


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): each whole text's token ids, binary little-endian unsigned 32-bit.

    ``path`` names a rank file that every executor can read (it is installed
    with the tokenizers, never shipped).  There are no special tokens: their
    strings are ordinary text.  Null and empty texts have no ids.  Rows are
    independent: repeats, ties and null ids come out as they went in, an empty
    table gives no rows, and further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.encode(texts), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes of each row's ids; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((own.decode(x or b"") for x in batch.column(1).to_pylist()), pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Both directions run in one pass, so ids and bytes never leave the task.
    Nulls and empty texts: as in ``encode_documents`` (0 tokens, digests of no bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for part, texts in slices(batches):
            counts, first, second = [], [], []
            for ids in own.encode(texts):
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
