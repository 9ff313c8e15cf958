"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon has a fixed part and a part learned from the labels: words and word
beginnings that toxic documents hold far more often.  Features are densities of
both, how near the second person they stand, capitals, punctuation and
obfuscation.  All learning is from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import cut, unused

#: Labelled rows that are learned from, the first by a hash of their ids; each is a broadcast id.
SAMPLE_ROWS = 20_000
#: Entries of the learned lexicon, and the toxic documents that an entry must be in.
LEXICON_ENTRIES, LEXICON_SUPPORT = 4000, 5
FOLDS = 5

# Insults, and the second person.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash garbage worthless pathetic disgusting clown clowns dumb imbecile fool "
    "jerk creep pig filth vermin idiota imbécile crétin connard salaud abruti débile tonto estúpido imbécil basura asqueroso "
    "estúpida dummkopf trottel arschloch abschaum idiotisch blöd wertlos erbärmlich widerlich".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself you're youre u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus vosotros usted ustedes su".split()
)
LEET = str.maketrans("013457@$!", "oieastasi", "*_-.")
_LETTERS = re.compile(r"[^\W\d_]+")
_MASK = re.compile(r"[\d@$!*_.]")
_INNER = re.compile(r"[^\W\d_][\d@$!*_.]+[^\W\d_]|(.)\1\1")

FEATURES = (
    "words", "insult_density", "insults", "top_weight", "weight_density", "strong_density", "strong", "top_three", "person_density",
    "person_near", "capital_words", "capitals", "punctuation", "exclamations", "questions", "digits", "obfuscated", "word_length",
)
#: Learned weight from which a word counts as strong, and words that count as near.
STRONG, NEAR = 2.0, 5


def stems(word: str) -> Iterator[str]:
    """Entries of the lexicon that a lower-case word can match: itself, and beginnings marked by a hyphen."""
    yield word
    for n in (3, 4, 5, 6):
        if len(word) > n:
            yield f"{word[:n]}-"


def text_stems(text: str) -> set[str]:
    return {s for word in set(_LETTERS.findall(text.lower())) for s in stems(word)}


class TokenTable:
    """What each distinct token contributes; tokens are remembered up to a limit."""

    COLUMNS = 11
    #: Bits of a character's class: letter, upper case, digit, what a letter may hide behind.
    LETTER, CAPITAL, DIGIT, MASK = 1, 2, 4, 8

    def __init__(self, lexicon: dict[str, float], most: int = 200_000):
        self.lexicon, self.most = lexicon, most
        self.beginnings = {entry[:-1]: weight for entry, weight in lexicon.items() if entry.endswith("-")}
        self.heads = {entry[:3] for entry in lexicon}  # no word with another beginning has a weight
        self.classes = np.full(0x110000, 255, np.uint8)  # 255: not looked at yet
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.rows = np.zeros((1024, self.COLUMNS), np.float32)

    def _weight(self, words: list[str]) -> tuple[float, bool]:
        best, insult = 0.0, False
        for word in words:
            insult = insult or word in INSULTS
            if word[:3] in self.heads:
                best = max(best, self.lexicon.get(word, 0.0))
                for n in range(3, min(len(word), 7)):
                    best = max(best, self.beginnings.get(word[:n], 0.0))
        return best, insult

    def _characters(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(code points, their classes)."""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = self.classes[points]
        if (unseen := classes == 255).any():
            for x in np.unique(points[unseen]).tolist():
                c = chr(x)
                self.classes[x] = self.LETTER * c.isalpha() + self.CAPITAL * c.isupper() + self.DIGIT * c.isdigit() + self.MASK * bool(_MASK.match(c))
            classes = self.classes[points]
        return points, classes

    def _made(self, tokens: list[str]) -> np.ndarray:
        """Rows of tokens that are not known yet, their characters counted together."""
        out = np.zeros((len(tokens), self.COLUMNS), np.float32)
        sizes = np.array([len(t) for t in tokens])
        begin = np.cumsum(sizes) - sizes
        points, classes = self._characters("".join(tokens))
        letters, upper, digits = (np.add.reduceat((classes & bit) > 0, begin, dtype=np.int64) for bit in (self.LETTER, self.CAPITAL, self.DIGIT))
        out[:, 3] = (letters >= 2) & (upper == letters)
        out[:, 4], out[:, 5], out[:, 6], out[:, 9] = letters, upper, sizes - letters - digits, digits
        out[:, 7], out[:, 8] = (np.add.reduceat(points == ord(c), begin, dtype=np.int64) for c in "!?")
        lowered = [t.lower() for t in tokens]
        # Only where a character comes three times or one that hides a letter stands inside can a token be obfuscated.
        sizes = np.array([len(t) for t in lowered])
        begin = np.cumsum(sizes) - sizes
        points, classes = self._characters("".join(lowered))
        doubtful = (classes & self.MASK) > 0
        doubtful[begin] = doubtful[begin + sizes - 1] = False
        doubtful[2:] |= (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])
        doubtful = np.logical_or.reduceat(doubtful, begin)
        heads, nothing, found = self.heads, (0.0, False, False, False), []
        for lower, doubt in zip(lowered, doubtful.tolist(), strict=True):
            if lower.isalpha():
                words, bare = [lower], lower
                if not doubt and lower[:3] not in heads and lower not in INSULTS and lower not in SECOND_PERSON:
                    found.append(nothing)
                    continue
            else:
                words, bare = _LETTERS.findall(lower), lower.strip(".,;:!?\"'()[]")
            weight, insult = self._weight(words)
            odd = bool(doubt and _INNER.search(lower))
            if odd:
                again, hidden = self._weight(_LETTERS.findall(lower.translate(LEET)))
                weight, insult = max(weight, again), insult or hidden
            found.append((weight, insult, bare in SECOND_PERSON, odd))
        out[:, 0], out[:, 1], out[:, 2], out[:, 10] = zip(*found, strict=True)
        return out

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self.index) + len(tokens) > self.most and len(self.index) > self.most // 2:
            self.index.clear()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))  # new ones get the next numbers
        if len(self.index) > known:
            new = list(islice(reversed(self.index), len(self.index) - known))[::-1]
            while len(self.index) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for start in range(0, len(new), 10_000):
                part = new[start : start + 10_000]
                self.rows[known + start : known + start + len(part)] = self._made(part)
        return self.rows[at]


def features(text: str, table: TokenTable) -> list[float]:
    """Dense features of one whole text, in the order of ``FEATURES``."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    rows = table.of(tokens)
    total = rows.sum(axis=0, dtype=np.float64)
    weight = rows[:, 0]
    strong = (weight >= STRONG) | (rows[:, 1] > 0)
    count = int(strong.sum())
    near = 0.0
    if count and total[2]:
        person, at = np.flatnonzero(rows[:, 2]), np.flatnonzero(strong)
        right = np.minimum(np.searchsorted(person, at), len(person) - 1)
        left = np.maximum(right - 1, 0)
        near = float((np.minimum(np.abs(person[right] - at), np.abs(person[left] - at)) <= NEAR).mean())
    top = np.sort(np.partition(weight, -3)[-3:]) if n > 3 else np.sort(weight)
    characters = max(1.0, total[4] + total[6] + total[9])
    letters = max(1.0, total[4])
    return [
        math.log1p(n), total[1] / n, math.log1p(total[1]), float(top[-1]), float(weight[weight > 1].sum()) / n, count / n, math.log1p(count), float(top.mean()), total[2] / n,
        near, total[3] / n, total[5] / letters, total[6] / characters, total[7] / n, total[8] / n, total[9] / characters, total[10] / n, total[4] / n,
    ]


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1: a leaf
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(x)
        return len(self.value) - 1

    def score(self, x: np.ndarray) -> np.ndarray:
        feature, cuts, left, right, value = (np.array(c) for c in (self.feature, self.cut, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= cuts[node], left[node], right[node])


@dataclass
class Booster:
    """Logistic gradient boosting on histograms."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    least: float = 5.0
    decay: float = 1.0
    base: float = 0.0
    grown: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = Tree()
            self._grow(tree, tree.add(), np.arange(len(y)), binned, edges, p - y, p * (1 - p), self.depth)
            self.grown.append(tree)
            margin += tree.score(x)
        return self

    def _grow(self, tree: Tree, node: int, rows: np.ndarray, binned, edges, slope, curve, depth: int) -> None:
        g, h = slope[rows].sum(), curve[rows].sum()
        tree.value[node] = float(-self.rate * g / (h + self.decay))
        if not depth or len(rows) < 2 * self.least:
            return
        best = (1e-6, -1, -1)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, j]
            size = len(e) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (slope[rows], curve[rows], None))
            gain = gs**2 / (hs + self.decay) + (g - gs) ** 2 / (h - hs + self.decay) - g * g / (h + self.decay)
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] < 0:
            return
        _, j, k = best
        tree.feature[node], tree.cut[node] = j, float(edges[j][k])
        goes_left = binned[rows, j] <= k
        for side, part in (("left", rows[goes_left]), ("right", rows[~goes_left])):
            child = tree.add()
            getattr(tree, side)[node] = child
            self._grow(tree, child, part, binned, edges, slope, curve, depth - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.grown:
            out += tree.score(x)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit by pooling adjacent violators: (scores, probabilities)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, n2, _, last = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += n2
            blocks[-1][3] = last
    points = [(s, (t + 0.05) / (n + 0.1)) for t, n, first, last in blocks for s in ((first, last) if last > first else (first,))]
    at = np.array([p[0] for p in points])
    return at, np.maximum.accumulate(np.array([p[1] for p in points]))


@dataclass
class Model:
    lexicon: dict[str, float]
    booster: Booster | None
    at: np.ndarray
    probability: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.booster is None:
            return np.zeros(len(x))
        margin = self.booster.margin(x)
        # Within a calibrated step the margin still orders texts, by less than any difference between steps that matters.
        tie = 1e-4 / (1 + np.exp(-margin))
        return np.clip(np.interp(margin, self.at, self.probability) * (1 - 1e-4) + tie, 0, 1)


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled documents outside fold 0."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != 0)
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # its size is the parameter: it can be broadcast
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))


def learn_lexicon(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """Entries and their numbers of (toxic, other) documents: those of the best log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            one, other = Counter(), Counter()
            for text, toxic in zip(texts, part.column(2).to_pylist(), strict=True):
                (one if toxic else other).update(text_stems(text))
            # What a slice has in other documents only can't become an entry unless another slice has it in toxic ones.
            every = list(one.keys() | other.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([one[s] for s in every], pa.int64()), pa.array([other[s] for s in every], pa.int64())], ["stem", "one", "other"])

    found = rows.mapInArrow(run, "stem string, one bigint, other bigint").groupBy("stem").agg(F.sum("one").alias("one"), F.sum("other").alias("other"))
    found = found.where(f"one >= {LEXICON_SUPPORT} AND one > other")
    gain = (F.log(F.col("one") + 0.5) - F.log(F.col("other") + 0.5)) * F.sqrt("one")
    return {r["stem"]: (r["one"], r["other"]) for r in found.orderBy(gain.desc(), "stem").limit(LEXICON_ENTRIES).collect()}


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon, trees and calibration from labelled rows of ``docs``."""
    nothing = Model({}, None, np.zeros(0), np.zeros(0))
    chosen = cut(sample(docs, labels, rows))
    counts = dict(chosen.groupBy("toxic").count().collect())
    n_one, n_other = sum(n for t, n in counts.items() if t), counts.get(0, 0)
    if not n_one or not n_other:
        return nothing
    entries = learn_lexicon(chosen)

    def weights(less_one: int, less_other: int) -> dict[str, float]:
        """Log odds of the entries, as if a document of that class were not there."""
        return {
            s: math.log((a - less_one + 0.2) / (n_one + 0.4)) - math.log((b - less_other + 0.2) / (n_other + 0.4))
            for s, (a, b) in entries.items()
        }

    tables = {1: weights(1, 0), 0: weights(0, 0)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: TokenTable(v) for k, v in tables.items()}
        for part, texts in slices(batches):
            toxic = [1 if t else 0 for t in part.column(2).to_pylist()]
            # A toxic document must not find its own words more telling than they are for others.
            out = [features(text, own[t]) for text, t in zip(texts, toxic, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(toxic, pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    # A sort by Spark would compute the features a second time, to find its ranges.
    matrix = sorted(chosen.mapInArrow(run, "doc_id bigint, toxic int, x array<double>").collect(), key=lambda r: (r["doc_id"], r["toxic"], r["x"]))
    x = np.array([r["x"] for r in matrix])
    y = np.array([r["toxic"] for r in matrix], np.float64)
    fold = np.array([fold_of(r["doc_id"]) for r in matrix])
    hold = fold == 1
    if hold.all() or not hold.any() or len(set(y[~hold])) < 2:
        hold = np.zeros(len(y), bool)
    booster = Booster().fit(x[~hold], y[~hold])
    check = hold if hold.any() else ~hold
    at, probability = isotonic(booster.margin(x[check]), y[check])
    return Model(tables[0], booster, at, probability)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text.

    Only the text is looked at; null and empty texts have features of zero and a
    score like any other.  Without labels of both classes to learn from every
    score is 0.  Rows are independent; an empty table gives no rows; all columns
    are passed on.
    """
    text = unused(docs, "text")["text"]
    narrow = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the lexicon's entries and the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenTable(sent.value.lexicon)
        for part, texts in slices(batches, text):
            x = np.array([features(t, table) for t in texts]).reshape(-1, len(FEATURES))
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sent.value.score(x))], [*part.schema.names[:-1], column])

    return narrow.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learned outside fold 0 only.  A null id is not held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, rows))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
