"""Chroma fingerprints of audio columns, and their alignment.

PCM is cut into overlapping frames whose spectra are folded into twelve pitch
classes.  Rectangle filters over the integral image of these frames give 2 bits
each, 32 a position, packed into one integer.  Each query meets every other
recording: the signs of four filters vote for the offsets at which they agree
(the histogram over all offsets at once is a correlation of four channels), and
bit errors over the whole overlap decide on the offsets with enough votes.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, thin

RATE, FRAME, HOP = 4000, 512, 128
SPAN = 32
#: Integers that must overlap (all of a shorter recording), and the largest share of wrong bits of a match.
OVERLAP, BIT_ERRORS = 64, 0.15
#: Bits that vote, the signs of every fourth filter, and the share of them that must agree.
VOTERS, VOTES = (1, 9, 17, 25), 0.78
#: Recordings and queries that are correlated together, fewer of long ones: so many integers at most.
NODES, QUERIES, BLOCK = 64, 128, 1 << 16
#: Up to this length of a transform single precision counts bits without error.
SINGLE = 1 << 14
#: Overlapping integers whose bits are compared at once.
PLACES = 1 << 18

#: Sixteen filters (kind, first pitch class, classes, frames), made by a rule: kinds in turn, half an octave where a part of it would mostly be silent.
FILTERS = [(i % 4, (i * 5) % 12, (6, 4, 3, 5)[i // 4] if i % 2 == 0 else 6, 8 * (1 + (i // 4 + i) % 4)) for i in range(16)]
#: Levels of a filter's value a frame.
LEVELS = (-0.15, 0.0, 0.15)


def to_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def from_wav(data: bytes | None) -> np.ndarray:
    """Samples of a 16-bit WAV at RATE, channels averaged; nothing for null or what isn't one."""
    if not data:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
            rate = w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0)
    return x if rate == RATE or not len(x) else np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames of twelve pitch-class energies, each frame of unit length."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = np.flatnonzero((hertz > 60) & (hertz < 1900))
    fold = np.zeros((len(hertz), 12))
    fold[use, np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12] = 1
    out = power @ fold
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(x: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer for each position of the filters."""
    c = chroma(x)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    wide = np.concatenate([c, c], axis=1)  # pitch classes go round
    area = np.zeros((len(c) + 1, 25))
    area[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)
    box = lambda t0, t1, p0, p1: area[at + t1, p1] - area[at + t0, p1] - area[at + t1, p0] + area[at + t0, p0]
    out = np.zeros(n, np.uint32)
    for kind, p, classes, frames in FILTERS:
        q, m, h = p + 2 * classes, p + classes, frames // 2
        if kind == 0:  # low against high classes
            value = box(0, frames, p, m) - box(0, frames, m, q)
        elif kind == 1:  # before against after
            value = box(0, h, p, m) - box(h, frames, p, m)
        elif kind == 2:  # checkerboard
            value = box(0, h, p, m) + box(h, frames, m, q) - box(0, h, m, q) - box(h, frames, p, m)
        else:  # middle against both sides
            third = frames // 3
            value = box(third, frames - third, p, m) - 0.5 * (box(0, third, p, m) + box(frames - third, frames, p, m))
        level = np.digitize(value / frames, LEVELS)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # neighbouring levels differ in one bit
    return out


def fingerprints(media: DataFrame, key: str, audio: str) -> DataFrame:
    """(id, codes): the packed integers of each recording.

    Null, empty, short or unreadable audio has none.  Rows are independent:
    repeats come out as often as they occur, null ids stay null, an empty table
    gives no rows.  Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(from_wav(x.as_py())).astype(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], ["id", "codes"])

    return media.select(F.col(key).cast("bigint").alias("id"), F.col(audio).alias("audio")).mapInArrow(run, "id bigint, codes array<bigint>")


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """(ids, sizes, codes): (node, codes) of up to ``most`` recordings of a task in one row, sorted by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1)
            sizes = np.diff(codes.offsets.to_numpy())
            order, begin = np.argsort(sizes, kind="stable"), 0
            while begin < len(order):
                end = begin + 1
                while end < len(order) and end - begin < most and (end - begin + 1) * sizes[order[end]] <= BLOCK:
                    end += 1
                part = order[begin:end]
                raw = codes.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
                ids = batch.column(0).take(pa.array(part)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([sizes[part].tolist()], pa.list_(pa.int32())), pa.array([raw], pa.binary())], ["ids", "sizes", "codes"])
                begin = end

    return rows.mapInArrow(run, "ids array<bigint>, sizes array<int>, codes binary")


def _signs(sizes: np.ndarray, codes: np.ndarray, channels: tuple[int, ...]) -> np.ndarray:
    """Bits as +1 and -1: (recording, channel, position), zeros beyond a recording's end."""
    out = np.zeros((len(sizes), len(channels), sizes.max()), np.float32)
    bits = 2.0 * ((codes[:, None] >> np.array(channels, np.uint32)) & 1) - 1
    for i, (end, size) in enumerate(zip(np.cumsum(sizes), sizes, strict=True)):
        out[i, :, :size] = bits[end - size : end].T
    return out


def _length(positions: int) -> int:
    """The next even length of a transform that is a product of small primes."""
    return min(p << max(1, (-(-positions // p) - 1).bit_length()) for p in (1, 3, 5, 9, 15, 25, 27, 45, 75, 225))


def _spectra(signs: np.ndarray, length: int) -> np.ndarray:
    """(channel, recording, frequency)."""
    return np.ascontiguousarray(np.fft.rfft(signs if length <= SINGLE else signs.astype(np.float64), length, axis=2).transpose(1, 0, 2))


class _Least:
    """What the votes of each (node, offset modulo length) must reach, for queries of one size after another.

    Offsets at which too little overlaps never do.  Modulo a length of at least
    m + size - OVERLAP they alone share a place with another offset, and none
    with one at which enough overlaps.
    """

    def __init__(self, sizes: np.ndarray, length: int, voters: int, votes: float, kind: np.dtype):
        offsets = np.arange(length)
        offsets = np.where(offsets < sizes.max(), offsets, offsets - length)
        self.rest, self.before = (sizes[:, None] - offsets).astype(kind), np.maximum(0, -offsets).astype(kind)
        self.enough, self.each = np.minimum(OVERLAP, sizes)[:, None], (2 * votes - 1) * voters
        self.margin = 0.01 * voters

    def of(self, m: int) -> np.ndarray:
        overlap = np.minimum(self.rest, m) - self.before
        few = overlap < np.minimum(self.enough, m).astype(overlap.dtype)
        overlap *= self.each
        overlap -= self.margin
        overlap[few] = np.inf
        return overlap


def _errors(a: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Shares of wrong bits where ``a``, begun at each ``offset`` of the ``size`` integers from ``begin`` of ``flat``, overlaps them."""
    low = np.maximum(0, -offset)
    n = np.minimum(len(a), size - offset) - low
    ends, out = np.cumsum(n), []
    while len(out) < len(n):
        # So many integers at a time, one place at least.
        first, done = len(out), int(ends[len(out)] - n[len(out)])
        some = slice(first, max(first + 1, int(np.searchsorted(ends, done + PLACES, "right"))))
        m, starts = n[some], ends[some] - n[some] - done
        at = np.arange(int(m.sum())) + np.repeat(low[some] - starts, m)
        wrong = np.bitwise_count(a[at] ^ flat[at + np.repeat((begin + offset)[some], m)])
        out += (np.add.reduceat(wrong, starts, dtype=np.int64) / (32 * m)).tolist()
    return np.array(out)


def _best(query: int, mine: np.ndarray, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, likely: np.ndarray) -> tuple[int, int, int, float] | None:
    """(query, node, offset, bit_errors) of the best among the places (node, offset modulo their number) that have the votes."""
    rows = np.flatnonzero(likely.any(axis=1) & (ids != query))
    j, k = np.nonzero(likely[rows])
    if not len(j):
        return None
    j, offset = rows[j], np.where(k < sizes.max(), k, k - likely.shape[1])
    errors = _errors(mine, flat, (np.cumsum(sizes) - sizes)[j], sizes[j], offset)
    best = np.lexsort((offset, ids[j], errors))[0]
    return (query, int(ids[j[best]]), int(offset[best]), float(errors[best])) if errors[best] <= BIT_ERRORS else None


def _matches(pairs: DataFrame) -> DataFrame:
    """(query, node, offset, bit_errors): of each query the best in each block it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # the last spectra of either side, which come again and again

        def spectra(side: int, sizes: np.ndarray, raw: bytes, length: int, voters: tuple[int, ...]) -> np.ndarray:
            if side not in held or held[side][:3] != (raw, length, voters):
                held[side] = raw, length, voters, _spectra(_signs(sizes, np.frombuffer(raw, "<u4"), voters), length)
            return held[side][3]

        for batch in batches:
            found = []
            for r in range(len(batch)):
                row = [batch.column(i)[r].as_py() for i in range(6)]
                ids = np.array(row[0]), np.array(row[3])
                sizes = np.array(row[1]), np.array(row[4])
                mine, flat = np.split(np.frombuffer(row[2], "<u4"), np.cumsum(sizes[0])[:-1]), np.frombuffer(row[5], "<u4")
                fewest = min(OVERLAP, int(sizes[0].min()), int(sizes[1].min()))
                length = _length(int(sizes[0].max() + sizes[1].max()) - fewest)
                # Few positions are few votes: there all bits vote, and those of a match are enough.
                voters, votes = (tuple(range(32)), 1 - BIT_ERRORS) if fewest < OVERLAP else (VOTERS, VOTES)
                left, right = (spectra(k, sizes[k], row[3 * k + 2], length, voters) for k in (0, 1))
                # All queries use the same few arrays, which fit in a core's cache.
                product, term = np.empty_like(right[0]), np.empty_like(right[0])
                agree = np.empty((len(ids[1]), length), product.real.dtype)
                needed, last = _Least(sizes[1], length, len(voters), votes, agree.dtype), None
                for q, (query, m) in enumerate(zip(ids[0].tolist(), sizes[0].tolist(), strict=True)):
                    if m != last:
                        last, least = m, needed.of(m)
                    conjugate = left[:, q].conj()
                    np.multiply(right[0], conjugate[0], out=product)
                    for c in range(1, len(voters)):
                        product += np.multiply(right[c], conjugate[c], out=term)
                    np.fft.irfft(product, length, axis=1, out=agree)
                    if best := _best(query, mine[q], ids[1], sizes[1], flat, agree >= least):
                        found.append(best)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["query", "node", "offset", "bit_errors"])

    return pairs.mapInArrow(run, "query bigint, node bigint, offset bigint, bit_errors double")


def align(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """Best match of each query among all other recordings: (id, match_id, offset, bit_errors).

    ``prints``: (id, codes) of all; ``queries``: ids.  A match is an offset at
    which OVERLAP integers or more overlap, all of a recording that has fewer,
    with at most BIT_ERRORS of their bits wrong.  Every other recording is
    looked at, by the votes of VOTERS at every offset; with fewer integers than
    OVERLAP all bits vote.  Recordings of equal codes are compared once, under
    their smallest id; a query of a group of them that isn't that id matches it
    with no errors.  Ties go to the smaller id.
    """
    known = prints.where("id IS NOT NULL AND size(codes) > 1").withColumn("digest", F.sha2(F.array_join("codes", ",").cast("binary"), 256))
    named = cut(known.select("id", "digest"))
    groups = cut(named.groupBy("digest").agg(F.min("id").alias("node"), F.max("id").alias("last")))
    member = cut(named.join(groups, "digest").select("id", "node", "last"))
    nodes = known.join(groups.select(F.col("node").alias("id"), "digest"), ["id", "digest"], "left_semi").select(F.col("id").alias("node"), "codes").dropDuplicates(["node"])
    asked = cut(member.join(queries.toDF("id"), "id", "left_semi").distinct())
    mine = cut(_blocks(thin(nodes.join(asked.select("node").distinct(), "node", "left_semi"), asked.count()), QUERIES))
    pairs = mine.toDF("query", "query_sizes", "query_codes").crossJoin(_blocks(nodes, NODES))
    best = _matches(pairs).groupBy("query").agg(F.min(F.struct("bit_errors", "node", "offset")).alias("x"))
    found = asked.join(best, asked["node"] == best["query"], "left")
    twin = F.when(F.col("id") != F.col("node"), F.col("node")).when(F.col("last") != F.col("node"), F.col("last"))
    return found.select(
        "id",
        F.coalesce(twin, F.col("x.node")).alias("match_id"),
        F.when(twin.isNotNull(), F.lit(0)).otherwise(F.col("x.offset")).cast("bigint").alias("offset"),
        F.when(twin.isNotNull(), F.lit(0.0)).otherwise(F.col("x.bit_errors")).alias("bit_errors"),
    ).where("match_id IS NOT NULL")


def render(vectors: DataFrame) -> DataFrame:
    """(vec_id, audio): embeddings played as tones, a quarter of a second for each value; there is no audio table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(RATE // 4) / RATE
        for batch in batches:
            for start in range(0, len(batch), 200):
                part, out = batch.slice(start, 200), []
                for v in part.column(1).to_pylist():
                    v = np.nan_to_num(np.array([x or 0.0 for x in v or []], np.float64))
                    notes = 110 * 2 ** (np.round(np.clip(v, -2, 2) * 18 + 18) % 36 / 12)
                    out.append(to_wav(0.5 * np.sin(2 * np.pi * notes[:, None] * t).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["vec_id", "audio"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, audio binary")
