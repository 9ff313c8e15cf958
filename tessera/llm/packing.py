"""Vector bin packing of tokenized documents into training sequences.

Every task packs what it reads, block by block, so no id ever moves between
tasks.  A segment is a vector (tokens, 1, loss-bearing tokens); a sequence has a
limit on each.  Sequences are filled one at a time with the segment whose vector
has the largest dot product with the room that is left.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.int64)


#: Segments that are packed together: the tail of a block is all that fills badly.
BLOCK = 4096
#: Sequences of one task: ids are the task's number times this, plus a count.
PER_TASK = 1 << 40


def pack(vectors: np.ndarray, limits: Limits) -> list[list[int]]:
    """Rows of ``vectors`` (tokens, 1, loss tokens) in bins, each within all limits.

    Rows of one vector are alike, so the heuristic looks at distinct vectors
    only.  Each bin takes, while anything fits, the vector with the largest dot
    product of its shares and those of the room left.
    """
    room_of = limits.array()
    kinds, kind = np.unique(vectors, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    members: list[list[int]] = [[] for _ in kinds]
    for row, k in enumerate(kind.tolist()):
        members[k].append(row)
    for m in members:
        m.reverse()
    left = np.array([len(m) for m in members])
    shares = kinds / room_of
    bins = []
    while left.any():
        room, taken = room_of.copy(), []
        while True:
            fits = np.flatnonzero((left > 0) & (kinds <= room).all(axis=1))
            if not len(fits):
                break
            best = fits[(shares[fits] @ (room / room_of)).argmax()]
            times = int(min(left[best], (room // np.maximum(kinds[best], 1)).min())) if kinds[best][0] * 2 > room[0] else 1
            for _ in range(max(1, times)):
                taken.append(members[best].pop())
                left[best] -= 1
                room -= kinds[best]
        if not taken:
            raise ValueError("a segment exceeds the limits of a sequence")
        bins.append(taken)
    return bins


def powers_of_two(n: int, most: int) -> list[int]:
    """n as a sum of powers of two up to ``most``, largest first."""
    out = [most] * (n // most)
    return out + [1 << b for b in reversed(range(most.bit_length())) if (n % most) >> b & 1]


class Packer:
    """Packs one task's documents: feed documents, take pieces.

    A piece is (document, start, length, sequence, offset).  A document longer
    than a sequence gives whole sequences first; its rest and every shorter
    document is a segment.  Sequences of a block that stay underfull pass their
    segments on to the next block; at the task's end what is left is laid end to
    end and cut at powers of two, which need no padding.
    """

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence = limits, first_sequence
        self.waiting: list[tuple[int, int, int, int]] = []  # document, start, length, loss tokens

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def add(self, document: int, tokens: int, loss_tokens: int) -> Iterator[tuple[int, int, int, int, int]]:
        most, start = self.limits.tokens, 0
        # A whole sequence must keep the limit on loss-bearing tokens as well.
        step = most if self.limits.loss_tokens >= most else min(most, self.limits.loss_tokens)
        while tokens - start >= step:
            yield document, start, step, self._next(), 0
            start += step
        if tokens > start:
            self.waiting.append((document, start, tokens - start, min(loss_tokens, tokens - start)))
        if len(self.waiting) >= BLOCK:
            yield from self._pack(last=False)

    def _lay(self, segments: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        sequence, offset = self._next(), 0
        for document, start, length, _ in segments:
            yield document, start, length, sequence, offset
            offset += length

    def _pack(self, last: bool) -> Iterator[tuple[int, int, int, int, int]]:
        segments, self.waiting = self.waiting, []
        vectors = np.array([[s[2], 1, s[3]] for s in segments], np.int64).reshape(-1, 3)
        poor = []
        for chosen in pack(vectors, self.limits):
            total = int(vectors[chosen, 0].sum())
            if total >= self.limits.tokens - self.limits.tokens // 256:
                yield from self._lay([segments[i] for i in chosen])
            else:
                poor.append((total, chosen))
        if last:
            yield from self._cut([segments[i] for _, chosen in poor for i in chosen])
        elif sum(len(c) for _, c in poor) > BLOCK // 2:
            # They don't fit each other: cut the emptiest to fill the rest, rather than keep them for ever.
            yield from self._cut([segments[i] for _, chosen in poor for i in chosen])
        else:
            self.waiting = [segments[i] for _, chosen in poor for i in chosen]

    def _cut(self, segments: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """Segments laid end to end: full sequences, then ones whose length is a power of two."""
        limits, queue = self.limits, list(reversed(segments))
        total = sum(s[2] for s in segments)
        sizes = list(reversed(powers_of_two(total, 1 << (limits.tokens.bit_length() - 1))))
        while queue:
            size = sizes.pop() if sizes else queue[-1][2]
            sequence, offset, count, loss = self._next(), 0, 0, 0
            while offset < size and queue and count < limits.segments and loss < limits.loss_tokens:
                document, start, length, bearing = queue.pop()
                part = min(length, size - offset, limits.loss_tokens - loss if bearing else length)
                yield document, start, part, sequence, offset
                if part < length:
                    queue.append((document, start + part, length - part, max(0, bearing - part)))
                offset, count, loss = offset + part, count + 1, loss + min(bearing, part)
            if offset < size:  # another limit came first: the sizes that are left are worked out anew
                sizes = list(reversed(powers_of_two(sum(s[2] for s in queue), 1 << (limits.tokens.bit_length() - 1))))

    def end(self) -> Iterator[tuple[int, int, int, int, int]]:
        if self.waiting:
            yield from self._pack(last=True)


_TOKENIZERS: dict[tuple[str, str, str | None], tiktoken.Encoding] = {}


def added_tokens(path: str | None) -> dict[str, int]:
    """Ids of the strings that the tokenizer file ``path`` finds in texts before anything else."""
    if path is None:
        return {}
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens that depend on what surrounds them are not supported")
    return {t["content"]: t["id"] for t in found}


def tokenizer(path: str, pattern: str, added: str | None = None) -> tiktoken.Encoding:
    if (path, pattern, added) not in _TOKENIZERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _TOKENIZERS[path, pattern, added] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added_tokens(added))
    return _TOKENIZERS[path, pattern, added]


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 1, limits: Limits = Limits(), added: str | None = None, bears: Column | None = None) -> DataFrame:
    """Tokenize and pack all documents; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids (the piece itself, little-endian unsigned 32-bit).  A document's ids
    are those of its whole text and then ``end_id``; each id is in one piece.
    All ids of a document bear loss but its first; with ``bears``, a condition on
    its row, only those of documents that satisfy it (null: not), as in
    instruction data, where answers do and questions don't.  sequence_id is unique over
    the table; a lost task repeats the same ids, as it reads the same rows.

    A null or empty text is one id.  The added tokens of the tokenizer file
    ``added`` are found in texts and have their own ids; without it their strings
    are ordinary text.  Repeated rows are packed as often as they occur; a null doc_id stays
    null; an empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern, added)
        context = TaskContext.get()
        packer = Packer(limits, (context.partitionId() if context else 0) * PER_TASK)
        held: dict[int, tuple] = {}  # documents with ids that wait: doc_id, ids, ids not yet placed
        number = 0
        rows: list[tuple] = []

        def place(pieces) -> None:
            for document, start, length, sequence, offset in pieces:
                doc_id, ids, open_ids = held[document]
                part = ids[start : start + length].tobytes()
                rows.append((doc_id, start, length, zlib.crc32(part), len(ids), sequence, offset, part))
                if open_ids == length:
                    del held[document]
                else:
                    held[document] = (doc_id, ids, open_ids - length)

        for part, texts in slices(batches):
            for doc_id, bearing, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), texts, strict=True):
                ids = np.array([*own.encode(text, allowed_special="all"), end_id], "<u4")
                held[number] = (doc_id, ids, len(ids))
                place(packer.add(number, len(ids), len(ids) - 1 if bearing else 0))
                number += 1
            if rows:
                yield _piece_rows(rows)
                rows = []
        place(packer.end())
        if rows:
            yield _piece_rows(rows)

    return docs.select("doc_id", "text", (F.lit(True) if bears is None else bears).alias("bears")).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    )


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(names, zip(*rows, strict=True), strict=True)], names)
