"""Jaccard self-join on word n-grams with adaptive multi-match prefixes.

All shingles have one global order, frequent ones last: the most frequent by
their counts, all others by how crowded their cell of a sketch is.  Two documents of n and
m shingles that link share at least ``overlap(n, m)``, so the first
``n - overlap(n, m) + l`` of the one and ``m - overlap(n, m) + l`` of the other
have l in common.  Each document gets the l that makes the estimated cost of its
candidates, for which l shingles must agree, plus that of a longer prefix least;
a pair goes by the smaller l of the two.  Shown are the shingles that the
smallest possible partner asks for, each with its position, and a meeting at a
shingle counts only if its positions are in the prefixes for these two sizes.

What is wanted are the components, so a posting list is not expanded into
pairs: its members are compared with a leader (as many pairs as members), and
only members of lists that still span two components after that meet each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import LOWER_TABLE, cut, delete_path, fresh_path, release, thin
from .components import components
from .substring_dedup import keyed
from .words import SPACES, mix, signed, words_of

WORDS, PERCENT = 5, 75
#: Frequent shingles that the order knows; all others count as rare.
FREQUENT = 200_000
#: Cost of showing one more shingle is 1; of verifying a candidate, so much a shingle.
VERIFY_COST = 0.05
#: Occurrences beside its own that a rare shingle is taken to have.
RARE_PARTNERS = 0.2
#: A shingle known to have more documents is dealt to as many tasks as hold so many each.
SALT_ROWS = 100_000
#: Shingles that a task counts together, and how often one of them must be among these to be reported: what
#: is known of a shingle is too low by less than that for each so many shingles of the table, never too high.
COUNTED, REPORTED = 1 << 21, 2
#: Every shingle is counted in one of 2 ** CELL_BITS cells, by its leading bits; a task sends its cells in so many parts.
CELL_BITS, CELL_PARTS = 23, 64
#: Crowding of a cell: how far its count is over the median, in deviations of a count by chance.
CROWDING = (1.5, 3.0, 5.0, 8.0, 13.0, 20.0, 40.0)
#: Rounds of further leaders before what is left is joined whole.  They end early when they find little, and
#: are not needed where lists hold at most so many pairs a row.
CROWDED = 4
LEADER_ROUNDS = 8


def cut_thin(df: DataFrame) -> DataFrame:
    return thin(cut(df))


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a document of n shares with any partner at least."""
    return -(-n * percent // 100)


def overlap(n, m, percent: int):
    """Shingles that sets of n and m share at least if they link; for arrays and columns of whole numbers alike."""
    return ((n + m) * percent + 99 + percent) // (100 + percent)


def _same(grams: np.ndarray) -> np.ndarray:
    return grams


def shingle_sets(texts: list[bytes], k: int, order_of=_same) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, first, order): the distinct shingles of each text in the order of ``order_of``; first[d]:first[d+1] are those of d."""
    words = words_of([t.translate(LOWER_TABLE) for t in texts], SPACES)
    grams, whole = words.grams(k)
    per_text = np.diff(words.first)
    of = words.text_of_word()
    short = np.flatnonzero((per_text > 0) & (per_text < k))
    if len(short):
        grams = grams.copy()
        for size in range(1, k):  # fewer words than a shingle has: the whole sequence is one
            of_size = short[per_text[short] == size]
            if len(of_size):
                at = words.first[of_size]
                grams[at] = words.grams(size)[0][at]
                whole[at] = True
    grams, of = grams[whole], of[whole]
    order = order_of(grams)
    # One sort by text and the order's leading bits; only where these tie for different shingles are both sorted whole.
    bits = np.uint64(max(1, (len(texts) - 1).bit_length()))
    joint = (of.astype(np.uint64) << (np.uint64(64) - bits)) | (order >> bits)
    by = np.argsort(joint)
    joint = joint[by]
    if ((joint[1:] == joint[:-1]) & (grams[by[1:]] != grams[by[:-1]])).any():
        by = np.lexsort((order, of))
    grams, of, order = grams[by], of[by], order[by]
    new = np.ones(len(grams), bool)
    new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(texts) + 1)), order[new]


_FREQUENT_BIT = np.uint64(1) << np.uint64(63)


class Order:
    """The global order: rare shingles by the crowding of their cells and by hash, then frequent ones by their number of documents."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, missed: int = 0, crowding: bytes = b"", deviation: float = 1.0):
        self.crowding = crowding  # of each cell 0 to 7, a byte each, compressed; nothing if unknown
        # Documents beside its own that a shingle in such a cell is taken to have; the first steps may be chance.
        self.beside = np.array([RARE_PARTNERS, RARE_PARTNERS, *(x * deviation for x in CROWDING[1:])])
        self.missed = missed  # documents by which counts may be too low
        by = np.argsort(tokens)
        self.tokens, counts = tokens[by], counts[by]
        ranked = np.lexsort((self.tokens, counts))
        self.rank = np.empty(len(tokens), np.uint64)
        self.rank[ranked] = np.arange(len(tokens), dtype=np.uint64)
        self.count_of_rank = counts[ranked]
        self.maybe = np.zeros(1 << 20, bool)  # by leading bits: most shingles are seen to be rare at once
        self.maybe[self.tokens >> np.uint64(44)] = True

    @cached_property
    def cells(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.crowding), np.uint8)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out = grams >> np.uint64(4)
        if self.crowding:
            out |= self.cells[grams >> np.uint64(64 - CELL_BITS)].astype(np.uint64) << np.uint64(60)
        if len(self.tokens):
            some = np.flatnonzero(self.maybe[grams >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.tokens, grams[some]), len(self.tokens) - 1)
            known = self.tokens[at] == grams[some]
            out[some[known]] = _FREQUENT_BIT | self.rank[at[known]]
        return out

    def partners(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated further documents of shingles by their place in the order, and the most that known ones may have (else 0)."""
        docs = np.zeros(len(order), np.int64)
        known = order >= _FREQUENT_BIT
        docs[known] = self.count_of_rank[(order[known] ^ _FREQUENT_BIT).astype(np.int64)]
        beside = self.beside[((order >> np.uint64(60)) & np.uint64(7)).astype(np.int64)]
        return np.where(known, docs - 1.0, beside), np.where(known, docs + self.missed, 0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part, texts in slices(batches):
        yield part, [t.encode() for t in texts]


def _totals(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums over each set: together its signature."""
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(total[first[1:]] - total[first[:-1]])
    return out[0], out[1]


def _first_of_equal(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Whether each set is the first of its equals among these."""
    _, one = np.unique(np.stack([s1, s2], axis=1), axis=0, return_index=True)
    out = np.zeros(len(s1), bool)
    out[one] = True
    return out


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """Per document: key, doc_id, n shingles, signature (s1, s2); and what its task met often (tokens, counts), and all by cells.

    A task counts COUNTED shingles at a time, those of equal sets that it reads
    together once, and reports what it met REPORTED times with the row it has
    come to.  How many fell into each cell (up to 65,535) goes with its last row.
    """
    slots = (1 << CELL_BITS) // CELL_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        sketch = np.zeros(1 << CELL_BITS, np.uint16)

        def made(part: pa.RecordBatch, n, s1, s2, token, count, cells=None) -> pa.RecordBatch:
            at = np.zeros(len(part) + 1, np.int32)
            at[1:] = len(token)  # counts travel with the first row
            tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(signed(token)))
            counts = pa.ListArray.from_arrays(pa.array(at), pa.array(count.astype(np.int64)))
            sent = pa.array([None] * (len(part) - 1) + [cells], pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, s1, s2, tokens, counts, sent], ["key", "doc_id", "n", "s1", "s2", "tokens", "counts", "cells"])

        def often() -> tuple[np.ndarray, np.ndarray]:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            if len(token):
                cell = (token >> np.uint64(64 - CELL_BITS)).astype(np.int64)  # sorted, as tokens are
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                sketch[cell[first]] = np.minimum(sketch[cell[first]] + np.add.reduceat(count, first), 65535)
            return token[count >= REPORTED], count[count >= REPORTED]

        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        met = none
        for part, texts in _slices(batches):
            if last is not None:
                yield made(*last, *met)
                met = none
            grams, first, _ = shingle_sets(texts, k)
            s1, s2 = _totals(grams, first)
            last = part.select(["key", "doc_id"]), pa.array(np.diff(first)), pa.array(signed(s1)), pa.array(signed(s2))
            alone = _first_of_equal(s1, s2)
            held.append(grams[np.repeat(alone, np.diff(first))])
            size += len(held[-1])
            if size >= COUNTED:
                met = often()
                held, size = [], 0
        if last is not None:
            met = often() if held else met
            yield made(*last, *met, [zlib.compress(x.tobytes(), 1) for x in sketch.reshape(CELL_PARTS, slots)])

    return rows.mapInArrow(run, "key bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, tokens array<bigint>, counts array<bigint>, cells array<binary>")


def crowded_cells(signed_rows: DataFrame) -> tuple[bytes, float]:
    """The crowding of all cells, compressed, and the deviation by which it is measured; a task sums up a part of the cells of all tasks."""
    slots = (1 << CELL_BITS) // CELL_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums = total.setdefault(at, np.zeros(slots, np.int64))
                sums += np.frombuffer(zlib.decompress(cells.as_py()), np.uint16)
        for at, sums in total.items():
            usual = float(np.median(sums))
            level = np.searchsorted(np.array(CROWDING), (sums - usual) / max(usual, 1.0) ** 0.5, side="right").astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([usual]), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], ["at", "usual", "level"])

    parts = signed_rows.where("cells IS NOT NULL").select(F.posexplode("cells").alias("at", "cells")).repartition(CELL_PARTS, "at")
    found = sorted((r["at"], r["usual"], bytes(r["level"])) for r in parts.mapInArrow(run, "at int, usual double, level binary").collect())
    if not found:
        return b"", 1.0
    return zlib.compress(b"".join(zlib.decompress(level) for _, _, level in found), 1), max(1.0, float(np.median([usual for _, usual, _ in found]))) ** 0.5


def frequent_shingles(signed_rows: DataFrame) -> Order:
    """The ``FREQUENT`` shingles with most documents, and how crowded others are; the order depends on them, the result doesn't."""
    top = (
        signed_rows.where(F.size("tokens") > 0)
        .select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
        .groupBy(F.col("x.tokens").alias("token"))
        .agg(F.sum("x.counts").alias("count"))
        .where("count >= 16")
        .orderBy(F.desc("count"), "token")
        .limit(FREQUENT)
        .toArrow()
    )
    met = signed_rows.agg(F.sum("n")).first()[0] or 0
    missed = (REPORTED - 1) * (met // COUNTED + signed_rows.rdd.getNumPartitions())
    return Order(top["token"].to_numpy().view(np.uint64), top["count"].to_numpy(), missed, *crowded_cells(signed_rows))


def choose_l(places: np.ndarray, first: np.ndarray, order: Order, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(l, known documents of each shingle): the cheapest l of each document, a power of two up to an eighth of its shingles."""
    partners, docs = order.partners(places)
    total = np.concatenate([[0.0], np.cumsum(partners)])
    n = np.diff(first)
    base = n - need(n, percent)
    close = n - overlap(n, n, percent)  # most partners are of about the same size
    best, best_cost, size = np.ones(len(n), np.int64), np.full(len(n), np.inf), 1
    while size == 1 or len(n) and size <= n.max() // 8:
        end = np.minimum(first[:-1] + close + size, first[1:])
        cost = (base + size) + (total[end] - total[first[:-1]]) / size * n * VERIFY_COST
        better = (cost < best_cost) & ((size == 1) | (size <= n // 8))
        best[better], best_cost[better] = size, cost[better]
        size *= 2
    return best, docs


def prefixes(rows: DataFrame, order: Order, k: int, percent: int) -> DataFrame:
    """(token, salt, key, n, l, p): the shown shingles; of equal sets that a task meets together only the first is shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            grams, first, places = shingle_sets(texts, k, order)
            n = np.diff(first)
            level, docs = choose_l(places, first, order, percent)
            shown = np.where(n > 0, np.minimum(n - need(n, percent) + level, n), 0)
            shown[~_first_of_equal(*_totals(grams, first))] = 0
            at = np.repeat(first[:-1], shown) + np.arange(shown.sum()) - np.repeat(np.cumsum(shown) - shown, shown)
            of = np.repeat(np.arange(len(n)), shown)
            parts = np.maximum(1, -(-docs[at] // SALT_ROWS))
            keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            salt = (mix(keys[of] ^ mix(grams[at])) % parts.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(grams[at])), pa.array(np.where(parts > 1, salt + 1, 0).astype(np.int32)), part.column(0).take(pa.array(of)), pa.array(n[of].astype(np.int32)), pa.array(level[of].astype(np.int32)), pa.array((at - first[of]).astype(np.int32))],
                ["token", "salt", "key", "n", "l", "p"],
            )

    return rows.select("key", "text").mapInArrow(run, "token bigint, salt int, key bigint, n int, l int, p int")


STARS = "kind int, token bigint, a bigint, b bigint, n int, l int, p int, c int"


def stars(shown: DataFrame, percent: int) -> DataFrame:
    """Posting lists as stars, from rows sorted by shingle, size and key; in bounded memory.

    kind 0: pair (a, b) whose sizes and positions allow a link, a being the leader
    of c lists that hold b; l is the smaller of theirs.  kind 1: document a of size
    n, level l and position p in the list of ``token`` led by b, for lists of three
    and more.
    kind 2: the first leader a of a part of a list that is dealt to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the list that the last batch ended in: token, salt, leader's key, n, l and p, rows so far
        for batch in batches:
            if not len(batch):
                continue
            token, salt, key, n, level, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            virtual = held is not None and held[0] == token[0] and held[1] == salt[0]
            before = 0
            if virtual:  # the leader so far stands in front again
                before = held[6] - 1
                token, salt, key, n, level, place = (np.concatenate([np.array([x], y.dtype), y]) for x, y in zip(held[:6], (token, salt, key, n, level, place), strict=True))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(token))
            lead = np.repeat(starts, ends - starts)
            for i in np.flatnonzero(n[ends - 1] > n[starts].astype(np.int64) * 100 // percent).tolist():
                at, end = starts[i], ends[i]  # a leader for each range of sizes
                while at < end:
                    beyond = at + np.searchsorted(n[at:end], int(n[at]) * 100 // percent, side="right")
                    lead[at:beyond] = at
                    at = beyond
            rank = np.arange(len(token)) - np.repeat(starts, ends - starts)
            rank[: ends[0]] += before
            pair = np.flatnonzero(lead != np.arange(len(token)))
            x, y = n[lead[pair]].astype(np.int64), n[pair].astype(np.int64)
            reach = np.minimum(level[lead[pair]], level[pair]) - overlap(x, y, percent)
            pair = pair[(place[lead[pair]] < x + reach) & (place[pair] < y + reach)]
            if len(pair):
                a, b = key[lead[pair]], key[pair]
                order = np.lexsort((b, a))
                a, b, small = a[order], b[order], np.minimum(level[lead[pair]], level[pair])[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                counts = np.diff(np.append(first, len(a)))
                yield _star_rows(0, np.zeros(len(first), np.int64), a[first], b[first], np.zeros(len(first), np.int32), small[first], np.zeros(len(first), np.int32), counts)
            follows = np.append(~new[1:], True)  # of the batch's last row nothing is known: it counts as followed
            several = np.flatnonzero((rank >= 2) | (rank == 1) & follows | (salt > 0))
            if virtual:
                several = several[several > 0]
            yield _star_rows(1, token[several], key[several], key[lead[several]], n[several], level[several], place[several], np.zeros(len(several), np.int32))
            heads = starts[(salt[starts] > 0) & (rank[starts] == 0)]
            yield _star_rows(2, token[heads], key[heads], key[heads], n[heads], level[heads], place[heads], np.zeros(len(heads), np.int32))
            last = lead[-1]
            held = (token[-1], salt[-1], key[last], n[last], level[last], place[last], int(rank[-1]) + 1)

    return shown.select("token", "salt", "key", "n", "l", "p").repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key").mapInArrow(run, STARS)


def _star_rows(kind: int, token, a, b, n, level, place, c) -> pa.RecordBatch:
    size = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int32)), pa.array(token), pa.array(a), pa.array(b), pa.array(n.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(c.astype(np.int32))],
        ["kind", "token", "a", "b", "n", "l", "p", "c"],
    )


def texts_of(rows: DataFrame, keys: DataFrame, at: str) -> DataFrame:
    """(key, text) of some documents, one row a key, written compressed to ``at``."""
    spark = rows.sparkSession
    wanted = cut_thin(keys.distinct())
    rows.select("key", "text").join(wanted, "key", "left_semi").dropDuplicates(["key"]).write.option("compression", "zstd").parquet(at)
    release(spark)
    return spark.read.schema("key bigint, text string").parquet(at)


def spelt_sets(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """A text's shingles as words."""
    words = text.translate(LOWER_TABLE).split()
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()  # noqa: B905


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, shared, total, linked) of pairs of keys, by their whole sets; those that link are compared word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, start = np.array([len(x) + len(y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]), 0
            while start < len(batch):  # as many pairs together as hold a million characters
                stop = start + max(1, int(np.searchsorted(np.cumsum(size[start:]), 1_000_000, side="right")))
                part, start = batch.slice(start, stop - start), stop
                left, right = ([t.encode() for t in part.column(i).to_pylist()] for i in (2, 3))
                x, at_x, _ = shingle_sets(left, k)
                y, at_y, _ = shingle_sets(right, k)
                shared = [len(np.intersect1d(x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]], assume_unique=True)) for i in range(len(left))]
                total = np.diff(at_x) + np.diff(at_y) - np.array(shared)
                for i in np.flatnonzero(100 * np.array(shared) >= percent * total).tolist():
                    one, two = spelt_sets(left[i], k), spelt_sets(right[i], k)
                    shared[i], total[i] = len(one & two), len(one | two)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "shared", "total"])

    one = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    found = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, shared bigint, total bigint")
    return cut_thin(found.withColumn("linked", F.expr(f"100 * shared >= {percent} * total")))


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set are its distinct shingles of ``words`` words, A-Z
    lower-cased; with fewer words the whole sequence is one shingle.  Documents
    link when 100 * shared >= percent * union; component_id is the smallest
    doc_id that links reach, its own included.  Every link between different
    sets counts; documents of equal sets are one node.

    A null or empty text has no shingles and links with nothing.  A null doc_id
    is a document of its own, and its component_id is null unless it links with
    others.  Rows that repeat an id come out once each.  An empty table gives no
    rows.  Further columns are ignored.
    """
    spark = docs.sparkSession
    rows, by_id = keyed(docs)
    all_signed = cut(signatures(rows, words))
    order = frequent_shingles(all_signed)
    signed_rows = all_signed.select("key", "doc_id", "n", "s1", "s2")

    # Equal sets are one node, named after the smallest key.
    nodes = cut_thin(signed_rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("key").alias("node")))
    member = cut_thin(signed_rows.join(nodes, ["n", "s1", "s2"], "left").select("key", "doc_id", "n", F.coalesce("node", "key").alias("node")))
    node_of = member.select("key", "node").distinct()

    at = fresh_path(spark, "stars")
    stars(prefixes(rows, order, words, percent), percent).write.parquet(at)
    found = spark.read.schema(STARS).parquet(at)
    heads = found.where("kind = 2").select("token", F.lit(0).alias("salt"), F.col("a").alias("key"), "n", "l", "p")
    pairs = found.where("kind = 0").unionByName(stars(heads, percent).where("kind = 0"))
    release(spark)
    pairs = cut_thin(pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("l").alias("l")))
    lists = found.where("kind = 1")

    # A pair is led in c lists; in lists where another leads it may meet at most as often as either has rows there.
    met = lists.groupBy("a").agg(F.count(F.lit(1)).alias("more"))
    more_a, more_b = met.toDF("a", "more_a"), met.toDF("b", "more_b")
    enough = pairs.join(more_a, "a", "left").join(more_b, "b", "left").where(F.col("c") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) >= F.col("l"))
    to_node = lambda frame, c: frame.join(node_of.toDF(c, f"node_{c}"), c)
    named = to_node(to_node(enough.select("a", "b"), "a"), "b")
    candidates = cut_thin(named.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).where("a != b").distinct())
    texts_at = fresh_path(spark, "texts")
    verified = verify(candidates, texts_of(rows, candidates.select(F.explode(F.array("a", "b")).alias("key")), texts_at), words, percent)
    delete_path(spark, texts_at)
    links = verified.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = cut_thin(components(links))
    release(spark)

    # What is left: lists that span two components, between members that no leader has decided.
    member_lists = to_node(to_node(lists.select("token", "a", "b", "n", "l", "p"), "a"), "b")
    apart = member_lists.select("token", F.col("node_a").alias("node"), F.col("node_b").alias("leader"), "n", "l", "p").distinct()
    known = verified.select(F.col("a").alias("x"), F.col("b").alias("y"), (1 - F.col("shared") / F.col("total")).alias("far"))
    known = known.unionByName(known.select(F.col("y").alias("x"), F.col("x").alias("y"), "far"))
    apart = apart.join(known.toDF("node", "leader", "far"), ["node", "leader"], "left")
    apart = apart.withColumn("far", F.when(F.col("node") == F.col("leader"), F.lit(0.0)).otherwise(F.col("far")))
    open_lists = _viable(_labelled(apart, label), percent)
    tried = candidates
    if open_lists.limit(1).count():
        open_texts = texts_of(rows, open_lists.select(F.col("node").alias("key")), texts_at)
    for turn in range(LEADER_ROUNDS):
        if not _crowded(open_lists):
            break
        # Other leaders, by their rows and by lot: components that are one soon meet, at a pair for each row.
        lot = F.col("k") * (50 + F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(100)))
        lead = F.max(F.struct(lot.alias("lot"), "node", "n", "l", "p", "component"))
        leaders = cut(open_lists.groupBy("token").agg(lead.alias("x")).select("token", *(F.col(f"x.{c}").alias(f"{c}_1") for c in ("node", "n", "l", "p", "component"))))
        others = open_lists.select("token", *(F.col(c).alias(f"{c}_2") for c in ("node", "n", "l", "p", "component")))
        met = others.join(leaders, "token").where((F.col("component_1") != F.col("component_2")) & _may_link(percent))
        pairs = cut_thin(met.select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        n_pairs = pairs.count()
        if not n_pairs:
            break
        found_links = verify(pairs, open_texts, words, percent).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        n_links = found_links.count()
        tried, links = tried.unionByName(pairs), links.unionByName(found_links)
        if n_links:
            label = cut_thin(components(links))
            open_lists = _labelled(open_lists, label)
        release(spark)
        if n_links * 20 < n_pairs:
            break

    if turn:
        open_lists = _viable(open_lists, percent)
    # The largest component of a list meets the others, never itself.
    sizes = open_lists.groupBy("token", "component").agg(F.countDistinct("node").alias("size"))
    largest = cut(sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("largest")))
    placed = cut_thin(open_lists.join(largest, "token"))
    names = ("node", "leader", "n", "l", "p", "component", "far", "k")
    one = placed.where("component != largest").select("token", *(F.col(c).alias(f"{c}_1") for c in names))
    two = placed.select(F.col("token").alias("token_2"), *(F.col(c).alias(f"{c}_2") for c in names))
    crossing = one.join(
        two,
        (F.col("token") == F.col("token_2"))
        & (F.col("component_1") != F.col("component_2"))
        & _may_link(percent)
        & (F.least("k_1", "k_2") >= F.least("l_1", "l_2"))
        # Distances of sets obey the triangle inequality: too different from one leader means too far from each other.
        & ~F.coalesce((F.col("leader_1") == F.col("leader_2")) & (F.abs(F.col("far_1") - F.col("far_2")) > 1 - percent / 100 + 1e-9), F.lit(False)),
    )
    pairs2 = (
        crossing.groupBy(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b"))
        .agg(F.countDistinct("token").alias("c"), F.min(F.least("l_1", "l_2")).alias("l"))
        .where("c >= l")
        .select("a", "b")
    )
    release(spark)
    pairs2 = cut_thin(pairs2.join(tried, ["a", "b"], "left_anti"))
    if pairs2.limit(1).count():
        late = verify(pairs2, open_texts, words, percent).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        label = cut(components(links.unionByName(late)))

    named = member.join(label, "node", "left").select("key", "doc_id", "n", F.coalesce("component", "node").alias("component"))
    named = named.withColumn("component_id", F.col("component")) if by_id else _smallest_ids(cut(named))
    result = cut(named.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))
    delete_path(spark, at)
    delete_path(spark, texts_at)
    return result


def _viable(open_lists: DataFrame, percent: int) -> DataFrame:
    """Rows at which their document may still link with another of the list, with k.

    A pair that no leader has decided meets l times, l being the smaller of
    theirs, at positions that the smallest partner of a list allows, in these
    lists only.  A document with k such rows can't link with one that asks for
    more.  Without those who can't, others have fewer, so this is done again if
    it removed most rows.
    """
    rows = open_lists
    for _ in range(2):
        before = rows.count()
        lists = cut(rows.groupBy("token").agg(F.min("n").alias("n_min"), F.min("l").alias("l_min")))
        reach = F.expr(f"n - ((n + greatest(n_min, (n * {percent} + 99) div 100)) * {percent} + {99 + percent}) div {100 + percent} + l")
        near = cut_thin(rows.drop("k").join(lists, "token").where(F.col("p") < reach))
        k = cut(near.groupBy("node").agg(F.countDistinct("token").alias("k")))
        alive = near.join(k, "node").where(F.col("k") >= F.least("l", "l_min")).drop("n_min", "l_min")
        rows = _mixed(cut_thin(alive))
        release(rows.sparkSession)
        if rows.count() > 0.5 * before:
            break
    return rows


def _crowded(lists: DataFrame) -> bool:
    """Whether the lists' members in different components make far more pairs than there are rows."""
    sizes = lists.groupBy("token", "component").count().groupBy("token").agg(F.sum("count").alias("rows"), F.sum(F.col("count") * F.col("count")).alias("inner"))
    rows, pairs = sizes.agg(F.sum("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("inner")) / 2)).first()
    return bool(rows) and pairs > CROWDED * rows


def _mixed(lists: DataFrame) -> DataFrame:
    """Rows of lists that span two components."""
    mixed = cut(lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token"))
    return cut_thin(lists.join(mixed, "token", "left_semi"))


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of lists that span two components, by the components of ``label``."""
    return _mixed(cut_thin(lists.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))))


def _may_link(percent: int) -> Column:
    """Whether sizes and positions (n_1, l_1, p_1, n_2, l_2, p_2) of a meeting allow a link."""
    reach = F.expr(f"least(l_1, l_2) - ((n_1 + n_2) * {percent} + {99 + percent}) div {100 + percent}")
    return (
        (F.col("n_1") * 100 >= F.col("n_2") * percent)
        & (F.col("n_2") * 100 >= F.col("n_1") * percent)
        & (F.col("p_1") < F.col("n_1") + reach)
        & (F.col("p_2") < F.col("n_2") + reach)
    )


def _smallest_ids(named: DataFrame) -> DataFrame:
    least = cut(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return named.join(least, "component")
