"""Personal data by weak supervision, in DataFrame functions only.

Patterns give candidate spans.  Three labelers vote on each: its shape, a
gazetteer, and the words before it.  Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is; the resulting
probabilities train a logistic span classifier on the spans' features.  Base
kinds are always kept; the classifier decides on the others.

Patterns are possessive and anchored so that none scans a run of characters
twice; they match what the plain patterns of the contract match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

# Base patterns in the order of their kinds, with a cheap test that no match fails.
_LOCAL = "[A-Za-z0-9._%+\\-]"
BASE = {
    "email": (f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9\\-]++(?:\\.[A-Za-z0-9\\-]++)++", "@"),
    "ip": ("(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]"),
    "card": ("[0-9](?:[ \\-]?[0-9])++", "[0-9](?:[ \\-]?[0-9]){11}"),
    "phone": ("\\+[0-9][ ().0-9\\-]+[0-9]", "\\+[0-9]"),
}
# Kinds that the method adds, and cheap tests.
EXTRA = {
    "mail": ("(?i)\\b[a-z0-9._%+\\-]{1,64}+ ?[\\[(]at[\\])] ?[a-z0-9\\-]++(?:\\.[a-z0-9\\-]++| ?[\\[(]dot[\\])] ?[a-z0-9\\-]++)++", "(?i)[\\[(]at[\\])]"),
    "tel": ("(?<![0-9+(\\-.])(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .\\-])[0-9]{3}[ .\\-][0-9]{4}(?![0-9\\-.])", "[0-9]{3}[ .\\-][0-9]{4}"),
    "ssn": ("(?<![0-9\\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\\-])", "[0-9]-[0-9]{2}-[0-9]"),
    "iban": ("\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\\b", "[A-Z]{2}[0-9]{2}"),
    "name": ("\\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Se\u00f1or|Se\u00f1ora)\\b\\.? \\p{Lu}\\p{L}{1,30}+(?: \\p{Lu}\\p{L}{1,30}+)?", "\\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Se\u00f1or)"),
}
KINDS = [*BASE, *EXTRA]
# What labelers look for.  Shape: a strict form of the kind.
SHAPES = {
    "email": "(?i)\\.[a-z]{2,24}$",
    "ip": "^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6)[0-9 \\-]+$",
    "phone": "^\\+[1-9]",
    "mail": "(?i)[\\].) ][a-z]{2,24}$",
    "tel": "^\\(?[2-9]",
    "ssn": "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": "^[A-Z]{2}[0-9]{2}",
    "name": "\\. \\p{Lu}|\\p{L} \\p{Lu}\\p{L}+ \\p{Lu}",
}
# Gazetteer: mail providers and domains, address ranges, issuer prefixes, country codes, given names.
GAZETTEER = {
    "email": "(?i)@(?:.*\\.)?(?:gmail|yahoo|hotmail|outlook|mail[0-9]*|proton|example|icloud|gmx|web|orange|free)\\.|\\.(?:com|net|org|edu|gov|io|de|fr|es|uk|eu)$",
    "ip": "^(?!0\\.|127\\.|255\\.|22[4-9]\\.|23[0-9]\\.)",
    "card": "^(?:4[0-9]|5[1-5]|2[2-7]|34|37|6011|65)",
    "phone": "^\\+(?:1|33|34|44|49|[2-9][0-9]{1,2})",
    "mail": "(?i)(?:gmail|yahoo|hotmail|outlook|proton)|(?:com|net|org|edu|de|fr|es|uk)$",
    "tel": "^\\(?(?!555|000|911)[2-9][0-9]{2}",
    "ssn": "^(?!123-45-6789|078-05-1120)",
    "iban": "^(?:DE|FR|ES|GB|IT|NL|BE|CH|AT|PT|PL|SE|NO|DK|FI|IE|LU)",
    "name": "(?i)\\b(?:anna|ana|maria|marie|john|james|mary|peter|pierre|jean|hans|karl|jos\u00e9|juan|carlos|paul|thomas|michael|smith|m\u00fcller|garc\u00eda|martin|schmidt|l\u00f3pez|dupont|bernard)\\b",
}
#: Words before a span that speak for and against it.
CONTEXT_CHARACTERS = 40
FOR = "(?i)(?:mail|contact|call|phone|tel|fax|mobile|card|credit|visa|ip|address|user|login|ssn|social|iban|account|konto|telefon|correo|tel\u00e9fono|adresse|courriel|dear|from|to|by)[^\\p{L}]*$"
AGAINST = "(?i)(?:version|isbn|order|invoice|serial|page|figure|section|total|sum|id|build|release|chapter)[^\\p{L}]*$"
#: Weight of the prior in the estimates, in spans.
PRIOR = 2.0
ROUNDS = 50


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_VALID = {
    "email": "true",
    "ip": f"m RLIKE {_sql('^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:[.]0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$')}",
    "card": (
        "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 12 AND 19 AND "
        "aggregate(sequence(1, length(regexp_replace(m, '[^0-9]', ''))), 0L, (s, i) -> s + "
        "CASE WHEN i % 2 = 1 THEN ascii(substring(reverse(regexp_replace(m, '[^0-9]', '')), i, 1)) - 48 "
        "ELSE (2 * (ascii(substring(reverse(regexp_replace(m, '[^0-9]', '')), i, 1)) - 48)) div 10 "
        "+ (2 * (ascii(substring(reverse(regexp_replace(m, '[^0-9]', '')), i, 1)) - 48)) % 10 END) % 10 = 0"
    ),
    "phone": "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 9 AND 15",
}
_SPAN = "array<struct<start:int,k:int,stop:int,m:string,before:string>>"
#: Elements that a running state goes over at a time; arrays are only appended to within so many.
RUN = 256
#: Characters of the pieces that a text is cut into for taking parts of it; finding a place costs a piece, not the text.
PIECE = 4096


def _running(items: str, first: str, after: str, each: str, kind: str) -> str:
    """SQL: ``each`` of every element x of ``items`` and the state s before it; ``after`` is the state after it.

    ``items`` must be the name of a lambda variable or column.  Work is linear:
    states at the heads of runs come first, then each run is gone over by itself.
    """
    heads, part = f"sequence(0, CAST((size({items}) - 1) div {RUN} AS int))", f"slice({items}, j * {RUN} + 1, {RUN})"
    states = f"aggregate({heads}, named_struct('s', {first}, 'a', CAST(array() AS array<int>)), (c, j) -> named_struct('s', aggregate({part}, c.s, (s, x) -> {after}), 'a', concat(c.a, array(c.s))), c -> c.a)"
    inner = f"transform(array(c.s), s -> named_struct('s', {after}, 'a', concat(c.a, array({each}))))[0]"
    return (
        f"CASE WHEN size({items}) = 0 THEN CAST(array() AS {kind}) ELSE flatten(zip_with({states}, {heads}, "
        f"(h, j) -> aggregate({part}, named_struct('s', h, 'a', CAST(array() AS {kind})), (c, x) -> {inner}, c -> c.a))) END"
    )


def _spans(text: str, k: int) -> str:
    """SQL: the spans of kind k in order, with what was matched and what stood before it.

    What lies between matches and the matches themselves give the places.
    """
    kind = KINDS[k]
    pattern, test = BASE.get(kind) or EXTRA[kind]
    valid = _VALID.get(kind, "true").replace("(m,", "(x.m,").replace("m RLIKE", "x.m RLIKE")
    pairs = f"zip_with(split({text}, {_sql(pattern)}, -1), regexp_extract_all({text}, {_sql(pattern)}, 0), (g, m) -> named_struct('g', length(g), 'm', m, 'before', right(g, {CONTEXT_CHARACTERS})))"
    at = "s + x.g"
    span = f"named_struct('start', {at}, 'k', {k}, 'stop', {at} + length(x.m), 'm', x.m, 'before', x.before)"
    placed = f"transform(array(filter({pairs}, x -> x.m IS NOT NULL)), z -> {_running('z', '0', f'{at} + length(x.m)', span, _SPAN)})[0]"
    return f"CASE WHEN {text} RLIKE {_sql(test)} THEN filter({placed}, x -> {valid}) ELSE CAST(array() AS {_SPAN}) END"


def _touches(spans: str, e: str) -> str:
    """SQL: whether span ``e`` overlaps one of ``spans``, which are in order and don't overlap one another; by halving."""
    middle = "CAST((s.low + s.high) div 2 AS int)"
    halved = f"CASE WHEN s.low >= s.high THEN s WHEN get({spans}, {middle}).start < {e}.stop THEN named_struct('low', {middle} + 1, 'high', s.high) ELSE named_struct('low', s.low, 'high', {middle}) END"
    return f"aggregate(sequence(1, 31), named_struct('low', 0, 'high', size({spans})), (s, i) -> {halved}, s -> coalesce(get({spans}, s.low - 1).stop > {e}.start, false))"


def _vote(good: str, bad: str = "false") -> str:
    """1: speaks for the span, 0: against, -1: abstains."""
    return f"CASE WHEN {good} THEN 1 WHEN {bad} THEN 0 ELSE -1 END"


def _by_kind(patterns: dict[str, str]) -> str:
    return "CASE x.k " + " ".join(f"WHEN {k} THEN x.m RLIKE {_sql(patterns[kind])}" for k, kind in enumerate(KINDS)) + " ELSE false END"


def _judged() -> str:
    """SQL: a span x with its votes and its features for the classifier."""
    shape, listed = _by_kind(SHAPES), _by_kind(GAZETTEER)
    return (
        "named_struct('start', x.start, 'k', x.k, 'stop', x.stop, "
        f"'shape', {_vote(shape, f'NOT ({shape})')}, 'listed', {_vote(listed)}, 'context', {_vote(f'x.before RLIKE {_sql(FOR)}', f'x.before RLIKE {_sql(AGAINST)}')}, "
        "'long', least((x.stop - x.start) div 8, 4), "
        "'digits', least(length(regexp_replace(x.m, '[^0-9]', '')) div 4, 4), "
        "'edge', CASE WHEN x.before RLIKE '[\\\\s(\\\\[<:\"=]$' OR x.before = '' THEN 1 ELSE 0 END)"
    )


def candidates(text: str = "text") -> tuple[Column, Column]:
    """(base spans, an array for each kind; further candidates) of a text column."""
    quoted = f"coalesce(`{text}`, '')"
    base = f"array({', '.join(_spans(quoted, k) for k in range(len(BASE)))})"
    extra = f"concat({', '.join(_spans(quoted, k) for k in range(len(BASE), len(KINDS)))})"
    return F.expr(base), F.expr(extra)


def judged(docs: DataFrame, keep: list[str], base: str = "_base", extra: str = "_extra") -> DataFrame:
    """``keep`` columns, and base and extra spans with votes and features under these names.

    Candidates that touch a base span are left out.
    """
    kinds, further = candidates()
    raw = docs.select(*(F.col(f"`{c}`") for c in keep), kinds.alias(base), further.alias(extra))
    apart = f"filter(`{extra}`, e -> NOT exists(`{base}`, b -> {_touches('b', 'e')}))"
    return raw.select(
        *(F.col(f"`{c}`") for c in keep),
        F.expr(f"transform(array_sort(flatten(`{base}`)), x -> {_judged()})").alias(base),
        F.expr(f"transform(CASE WHEN size(`{extra}`) = 0 THEN `{extra}` ELSE {apart} END, x -> {_judged()})").alias(extra),
    )


LABELERS = ("shape", "listed", "context")
FEATURES = ("k", *LABELERS, "long", "digits", "edge")


def pattern_counts(spans: DataFrame, base: str = "_base", extra: str = "_extra") -> list[tuple[tuple[int, ...], int]]:
    """How many spans of all documents have each combination of kind, votes and features (some thousands at most)."""
    each = spans.select(F.explode(F.concat(base, extra)).alias("x"))
    rows = each.groupBy(*(F.col(f"x.{f}").alias(f) for f in FEATURES)).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((tuple(r[f] for f in FEATURES), r["n"]) for r in rows)


def reliabilities(counts: list[tuple[tuple[int, ...], int]]) -> tuple[float, dict, list[float]]:
    """EM for the model in which labelers vote independently given the truth.

    Returns the share of true spans, P(vote | truth) of each labeler, and the
    probability of each entry of ``counts``.  It starts from the majority.
    """
    votes = [(c[0][1 : 1 + len(LABELERS)], c[1]) for c in counts]
    p = [0.5 + 0.4 * (sum(1 if v == 1 else -1 for v in vs if v >= 0) / max(1, sum(v >= 0 for v in vs))) for vs, _ in votes]
    table: dict = {}
    share = 0.5
    for _ in range(ROUNDS):
        total = sum(n for _, n in votes)
        share = (sum(q * n for q, (_, n) in zip(p, votes, strict=True)) + PRIOR / 2) / (total + PRIOR)
        for j in range(len(LABELERS)):
            for truth in (0, 1):
                # Before any evidence a labeler that votes is right three times in four.
                weight = {v: PRIOR * (0.5 if v < 0 else 0.375 if v == truth else 0.125) for v in (-1, 0, 1)}
                for q, (vs, n) in zip(p, votes, strict=True):
                    weight[vs[j]] += n * (q if truth else 1 - q)
                all_of = sum(weight.values())
                for v, w in weight.items():
                    table[j, truth, v] = w / all_of
        new = []
        for vs, _ in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(table[j, 1, v] / table[j, 0, v]) for j, v in enumerate(vs))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        done = max((abs(a - b) for a, b in zip(p, new, strict=True)), default=0) < 1e-6
        p = new
        if done:
            break
    return share, table, p


def _inputs(features: tuple[int, ...]) -> list[float]:
    k, shape, listed, context, long, digits, edge = features
    one_hot = [1.0 if k == i else 0.0 for i in range(len(KINDS))]
    return [1.0, *one_hot, float(shape == 1), float(shape == 0), float(listed == 1), float(context == 1), float(context == 0), long / 4, digits / 4, float(edge)]


def train(counts: list[tuple[tuple[int, ...], int]], probabilities: list[float], steps: int = 300, decay: float = 1.0) -> list[float]:
    """Weights of a logistic classifier that reproduces the labelers' probabilities from the spans' features."""
    if not counts:
        return []
    rows = [(_inputs(f), n, q) for (f, n), q in zip(counts, probabilities, strict=True)]
    total = sum(n for _, n, _ in rows)
    weights, square = [0.0] * len(rows[0][0]), [1e-8] * len(rows[0][0])
    for _ in range(steps):
        slope = [decay * w / total for w in weights]
        for x, n, q in rows:
            z = sum(a * b for a, b in zip(weights, x, strict=True))
            off = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q) * n / total
            for i, a in enumerate(x):
                if a:
                    slope[i] += off * a
        for i, g in enumerate(slope):
            square[i] += g * g
            weights[i] -= 0.5 * g / math.sqrt(square[i])
    return weights


def _accepted(weights: list[float]) -> str:
    """SQL: whether the classifier takes span x."""
    if not weights:
        return "false"
    n = len(KINDS)
    bias, kinds, (shape1, shape0, listed, context1, context0, long, digits, edge) = weights[0], weights[1 : 1 + n], weights[1 + n :]
    by_kind = "CASE x.k " + " ".join(f"WHEN {k} THEN {w!r}D" for k, w in enumerate(kinds)) + " ELSE 0D END"
    either = lambda c, yes, no: f"CASE x.{c} WHEN 1 THEN {yes!r}D WHEN 0 THEN {no!r}D ELSE 0D END"
    return f"({bias!r}D + {by_kind} + {either('shape', shape1, shape0)} + {either('listed', listed, 0.0)} + {either('context', context1, context0)} + x.long * {long / 4!r}D + x.digits * {digits / 4!r}D + x.edge * {edge!r}D) >= 0"


def fit(spans: DataFrame, base: str = "_base", extra: str = "_extra") -> list[float]:
    """The classifier's weights from the spans of all documents (output of ``judged``)."""
    counts = pattern_counts(spans, base, extra)
    _, _, probabilities = reliabilities(counts)
    return train(counts, probabilities)


def accepted(weights: list[float], base: str = "_base", extra: str = "_extra") -> Column:
    """All spans that stand: base ones, and those the classifier takes; by start, then kind."""
    return F.expr(f"array_sort(concat(`{base}`, filter(`{extra}`, x -> {_accepted(weights)})))")


def _joined(column: str) -> str:
    names = "CASE x.k " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(KINDS)) + " END"
    return f"array_join(transform({column}, x -> concat({names}, ':', x.start, ':', x.stop)), ',')"


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Places are in code points, the end exclusive.  A null text counts as empty
    and has no spans (the digest is that of no bytes).  Rows are independent
    but for the estimates, which all rows share: repeats come out alike, null
    ids stay null, an empty table gives no rows.  Further columns are ignored.
    """
    spans = cut(judged(docs, ["doc_id"]))
    found = spans.withColumn("_all", accepted(fit(spans)))
    count = lambda k: F.expr(f"CAST(size(filter(_base, x -> x.k = {k})) AS bigint)")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.sha2(F.expr(_joined("_base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined("_all")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become the first one's.

    Spans are found once: they are kept with the rows while the estimates are
    made.  A null text stays null, an empty table gives no rows, repeated rows
    come out alike, and columns of any names are kept.
    """
    own = unused(docs, "base", "extra", "all", "cut")
    found = cut(judged(docs, docs.columns, own["base"], own["extra"]))
    spans, pieces = own["all"], own["cut"]
    found = found.withColumn(spans, accepted(fit(found, own["base"], own["extra"]), own["base"], own["extra"]))
    found = found.withColumn(pieces, F.expr(f"CASE WHEN size(`{spans}`) > 0 THEN regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0) END"))
    name = "CASE x.k " + " ".join(f"WHEN {k} THEN '[{kind.upper()}]'" for k, kind in enumerate(KINDS)) + " END"
    begin = f"greatest({{a}} - i * {PIECE}, 0)"
    part = lambda a, b: (
        f"CASE WHEN {a} >= {b} THEN '' ELSE array_join(transform(sequence(CAST({a} div {PIECE} AS int), CAST(({b} - 1) div {PIECE} AS int)), "
        f"i -> substring(get(`{pieces}`, i), {begin.format(a=a)} + 1, least({b} - i * {PIECE}, {PIECE}) - {begin.format(a=a)})), '') END"
    )
    each = f"CASE WHEN x.start < s THEN '' ELSE concat({part('s', 'x.start')}, {name}) END"
    last = f"array_max(transform(`{spans}`, x -> x.stop))"
    rest = f"transform(array({last}), s -> {part('s', 'length(text)')})[0]"
    cleaned = f"CASE WHEN text IS NULL OR size(`{spans}`) = 0 THEN text ELSE concat(array_join({_running(f'`{spans}`', '0', 'greatest(s, x.stop)', each, 'array<string>')}, ''), {rest}) END"
    return found.withColumn("text", F.expr(cleaned)).select(*(F.col(f"`{c}`") for c in docs.columns))
