"""Each operator against a brute-force version, on odd rows and on a small corpus."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def corpus(spark):
    """Random texts with copies, near copies and shared passages."""
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 5)))
    texts = [" ".join(word() for _ in range(random.randint(0, 120))) for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    for i in range(0, 40, 2):
        words = texts[i].split()
        for _ in range(random.randint(0, 4)):
            if words:
                words[random.randrange(len(words))] = word()
        texts.append(" ".join(words))
    for i in range(12):
        texts.append(f"{texts[i]} {passage} {texts[-i - 1]}")
    texts += texts[:15] + [t.upper() for t in texts[15:20]]
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 3
    for i in range(40):  # a crowd of near copies at all distances
        words = base.split()
        for _ in range(i // 6):
            words[random.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


# --- op 10


def check_exact(df, spark):
    from tessera.llm.exact_dedup import exact_dedup, new_index

    rows = rows_of(df)
    got = exact_dedup(df, new_index(spark, 4)).collect()
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    want = Counter((i, hashlib.sha256(t.encode()).digest(), top(ids), len(ids)) for t, ids in groups.items() for i in ids)
    assert Counter((r["doc_id"], bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup(spark, odd, none, corpus):
    for df in (odd, none, corpus):
        check_exact(df, spark)


def test_exact_dedup_goes_on(spark, tmp_path):
    from tessera.llm.exact_dedup import DigestIndex, exact_dedup

    frame = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    path = str(tmp_path / "index")
    exact_dedup(frame((1, "a"), (2, "b")), DigestIndex(spark, path, 4)).collect()
    again = {r["doc_id"]: r for r in exact_dedup(frame((3, "A"), (4, "c")), DigestIndex(spark, path, 4)).collect()}
    assert (again[3]["seen"], again[3]["kept"], again[3]["keep_id"]) == (True, False, 1)
    assert (again[4]["seen"], again[4]["kept"]) == (False, True)
    assert DigestIndex(spark, path, 4).rows().count() == 3


# --- op 7


def brute_substring(rows, window, history=()):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    counts = Counter()
    for words in [w for _, w in split] + [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in history]:
        counts.update(tuple(words[k : k + window]) for k in range(len(words) - window + 1))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if counts[tuple(words[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(spark, odd, none, corpus):
    from tessera.llm.substring_dedup import new_index, substring_dedup

    for df in (odd, none, corpus):
        got = substring_dedup(df, new_index(spark, 4))
        assert Counter(map(tuple, got.collect())) == brute_substring(rows_of(df), 35)


def test_substring_dedup_in_batches(spark, corpus, tmp_path):
    from tessera.llm.substring_dedup import FingerprintIndex, substring_dedup

    rows = sorted(rows_of(corpus))
    index = FingerprintIndex(spark, str(tmp_path / "runs"), 2, max_runs=2)
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    seen = []
    for part in (rows[:70], rows[70:140], rows[140:]):
        history = frame(seen) if seen else None
        got = substring_dedup(frame(part), index, history)
        assert Counter(map(tuple, got.collect())) == brute_substring(part, 35, [t for _, t in seen])
        seen += part
        index = FingerprintIndex(spark, str(tmp_path / "runs"), 2, max_runs=2)
    assert index.generation == 1 and index.runs() == 1


def test_substring_dedup_however_tasks_read(spark, tmp_path):
    """Neighbours share passages; what tasks read together differs from one scan to another."""
    from tessera.llm.substring_dedup import FingerprintIndex, new_index, substring_dedup

    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [words(45) for _ in range(61)]
    rows = [(i, f"{passages[i]} {words(20)} {passages[i + 1]}") for i in range(60)]
    frame = lambda r, n: spark.createDataFrame(r, "doc_id long, text string").coalesce(1).repartition(n)
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        for most in (2000, 2600, 3300, 5100):
            spark.conf.set(conf, most)
            assert Counter(map(tuple, substring_dedup(frame(rows, 1), new_index(spark, 2)).collect())) == brute_substring(rows, 35)
    finally:
        spark.conf.unset(conf)
    pair, late = rows[:2], [(100, f"{words(30)} {passages[1]}")]
    index = FingerprintIndex(spark, str(tmp_path / "runs"), 2)
    substring_dedup(frame(pair, 1), index)
    got = substring_dedup(frame(late, 1), index, frame(pair, 2))
    assert Counter(map(tuple, got.collect())) == brute_substring(late, 35, [t for _, t in pair])


# --- op 9


def brute_components(rows, percent=75):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return Counter((i, len(s), least.get(g)) for (i, _), s, g in zip(rows, sets, group, strict=True))


def test_ngram_components(odd, none, corpus):
    from tessera.llm.ngram_join import ngram_components

    for df in (odd, none, corpus):
        assert Counter(map(tuple, ngram_components(df).collect())) == brute_components(rows_of(df))


def test_ngram_components_when_crowded(corpus, monkeypatch):
    """Further leaders, salted lists and other thresholds give the same components."""
    from tessera.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CROWDED", 0)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 7)
    for percent in (60, 75):
        got = ngram_join.ngram_components(corpus, percent=percent)
        assert Counter(map(tuple, got.collect())) == brute_components(rows_of(corpus), percent)


def test_overlap_is_least():
    from tessera.llm.ngram_join import overlap

    for n in range(1, 80):
        for m in range(1, 80):
            if 100 * min(n, m) >= 75 * max(n, m):
                assert overlap(n, m, 75) == next(o for o in range(n + m) if 100 * o >= 75 * (n + m - o))


def test_components_of_chains(spark):
    from tessera.llm.components import components

    links = spark.range(200).where("id % 50 != 0").select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: i // 50 * 50 for i in range(200)}
    assert components(links.limit(0)).count() == 0


def test_components_of_few_links_take_no_shuffle(spark, monkeypatch):
    """In one task or by steps, with repeated links, loops and either direction, the components are the same."""
    from tessera.llm import components

    rng = random.Random(5)
    rows = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    rows += [(1000 + (i * 37) % 101, 1000 + ((i + 1) * 37) % 101) for i in range(90)] + [(7, 7), (500, 500), rows[0], rows[0][::-1]]
    links = spark.createDataFrame(rows, "u long, v long").repartition(5).localCheckpoint()
    few = components.components(links)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    least = {x: x for row in rows for x in row if row[0] != row[1]}
    for _ in rows:
        for u, v in rows:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    monkeypatch.setattr(components, "LOCAL", 0)
    for found in (few, components.components(links)):
        assert sorted(map(tuple, found.collect())) == sorted(least.items())


# --- op 4


def test_bpe_as_tiktoken(spark, odd, none, corpus):
    import base64

    import public_tokenizers
    import tiktoken

    from tessera.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wild = ["".join(random.choice(every) if random.random() < 0.3 else random.choice("ab \n\t'sé1中") for _ in range(60)) for _ in range(400)]
    wild += ["a" * 3000, "ab" * 1500, " " * 900 + "x", "<|endoftext|>"]
    for df in (odd, none, corpus, spark.createDataFrame(list(enumerate(wild)), "doc_id long, text string")):
        want = Counter()
        for i, t in rows_of(df):
            ids = theirs.encode_ordinary(t or "")
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.round_trip(df, path, public_tokenizers.PATTERN).collect())) == want
    ids = bpe.encode_documents(odd, path, public_tokenizers.PATTERN)
    back = bpe.decode_documents(ids, path, public_tokenizers.PATTERN)
    assert Counter((r[0], bytes(r[1]).decode()) for r in back.collect()) == Counter((i, t or "") for i, t in rows_of(odd))


# --- op 5


def test_packing(spark, odd, none, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.packing import Limits, pack_documents

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df, limits in ((odd, Limits()), (none, Limits()), (corpus, Limits()), (corpus, Limits(256, 3, 200))):
        got = pack_documents(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, limits=limits, added=public_tokenizers.path("byte_bpe_50k.json")).collect()
        if df is not odd:  # unique ids: each document can be put together again
            ids = {i: [*theirs.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows_of(df)}
            parts = {}
            for r in got:
                parts.setdefault(r["doc_id"], []).append(r)
            assert parts.keys() == ids.keys()
            for i, pieces in parts.items():
                at = 0
                for r in sorted(pieces, key=lambda r: r["start"]):
                    raw = b"".join(x.to_bytes(4, "little") for x in ids[i][at : at + r["length"]])
                    assert (r["start"], r["ids_crc32"], r["doc_tokens"], bytes(r["ids"])) == (at, zlib.crc32(raw), len(ids[i]), raw)
                    at += r["length"]
                assert at == len(ids[i])
        else:
            assert sum(r["length"] for r in got) == sum(len(theirs.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows_of(df))
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append(r)
        padding = total = 0
        for pieces in sequences.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at and r["length"] > 0
                at += r["length"]
            assert at <= limits.tokens and len(pieces) <= limits.segments
            total += at
            padding += limits.tokens - at if at & (at - 1) else 0
        assert limits != Limits() or padding <= 0.02 * total + 1


def test_packing_finds_added_tokens(spark, tmp_path):
    """Ids of the query and of the pipeline's stage as the json's tokenizer gives them by default."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.queries import op5_packing

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, end * 3, f"a{end}b  {end}\n\n{end} 's", f"<{end}>", "<|endoftext|", "<|ENDOFTEXT|> <|endof text|>", f"  {end}  it's", None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: [*theirs.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert want[0] == [31373, 220, 50256, 995, 1]
    pieces = {i: b"" for i in want}
    for r in sorted(corpus_pipeline.packed(spark, docs, str(tmp_path)).collect(), key=lambda r: r["start"]):
        pieces[r["doc_id"]] += bytes(r["ids"])
    assert pieces == {i: b"".join(x.to_bytes(4, "little") for x in ids) for i, ids in want.items()}
    for r in op5_packing(spark, str(tmp_path)).collect():
        raw = b"".join(x.to_bytes(4, "little") for x in want[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(want[r["doc_id"]]), zlib.crc32(raw))


def test_pack_keeps_all_limits():
    import numpy as np

    from tessera.llm.packing import Limits, pack

    random.seed(1)
    vectors = np.array([[random.randint(1, 90), 1, random.randint(0, 40)] for _ in range(500)])
    limits = Limits(100, 4, 50)
    bins = pack(vectors, limits)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all((vectors[b].sum(axis=0) <= limits.array()).all() for b in bins)


# --- op 1


def test_warc(spark, tmp_path):
    from tessera.llm import warc

    big = "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u v\r\nX: y", "small"), (5, "http://b", "small"), (6, "http://c", None), (None, "http://d", big), (None, "http://e", "")]
    rows += [(100 + i, f"http://n/{i}", "".join(random.choice("abc <>") for _ in range(random.randint(0, 4000)))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    at = str(tmp_path / "warc")
    made = warc.write_warc(pages, at, roll_bytes=20_000)
    assert made.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.page_records(warc.read_warc(spark, at)).collect()
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == big and i != 3
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert Counter(map(tuple, got)) == want
    for split in (97, 1000):  # the same records whatever the ranges
        small = warc.read_warc(spark, at, split)
        assert Counter(map(tuple, warc.page_records(small).collect())) == want
    record = warc.read_warc(spark, at).where("record_id = 'urn:page:4'").first()
    assert record["target_uri"] == "u%20v%0D%0AX:%20y" and bytes(record["payload"]) == b"small"
    empty = str(tmp_path / "empty")
    warc.write_warc(pages.limit(0), empty).count()
    (tmp_path / "empty").mkdir(exist_ok=True)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_skips_what_is_no_record(spark, tmp_path):
    import gzip
    import os

    from tessera.llm import warc

    record = warc._record("response", "urn:page:1", "2024-01-01T00:00:00Z", {"Content-Type": "application/http;msgtype=response"}, b"HTTP/1.1 200 OK\r\n\r\nhello", 6)
    inner = warc._record("response", "urn:page:2", "2024-01-01T00:00:00Z", {}, b"inner", 6)
    outer = warc._record("resource", "urn:x:3", "2024-01-01T00:00:00Z", {}, os.urandom(50_000) + inner + os.urandom(50_000), 0)
    (tmp_path / "x.warc.gz").write_bytes(b"junk\x1f\x8b\x08\x00zz" + record + gzip.compress(b"no warc") + outer + record + record[:40])
    for split in (1 << 20, 5000):
        found = warc.whole_records(warc.read_warc(spark, str(tmp_path), split))
        assert sorted(r["record_id"] for r in found.collect()) == ["urn:page:1", "urn:page:1", "urn:x:3"]


# --- op 3


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    hits = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark, odd, none, corpus):
    from tessera.llm.license_scan import TEMPLATES, license_scan

    notices = [f"intro {t} middle {t.upper()} end" for t in TEMPLATES.values()] + ["MIT license, mit-license; MIT_LICENSE", "general public license " * 3]
    bent = TEMPLATES["bsd-text"].replace("source and binary", "both source and binary").replace("following", "ensuing")
    extra = spark.createDataFrame(list(enumerate([*notices, bent])), "doc_id long, text string")
    for df in (odd, none, corpus, extra):
        got = license_scan(df).collect()
        names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert Counter(tuple(r[c] for c in names) for r in got) == Counter((i, *brute_licenses(t)) for i, t in rows_of(df))
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    found = {r["doc_id"]: r for r in license_scan(extra).collect()}
    for i, name in enumerate(TEMPLATES):
        assert sum(s["template"] == name and s["share"] == 1 for s in found[i]["spans"]) == 2, name
    assert found[len(notices)]["labels"] == "bsd-text" and 0.6 <= found[len(notices)]["score"] < 1


# --- op 6


def test_toxicity(spark):
    from tessera.llm import toxicity

    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_documents(docs, labels)
    assert got.count() == docs.count() and got.where("score NOT BETWEEN 0 AND 1 OR predicted != int(score >= 0.5)").count() == 0
    held = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    pairs = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in held if a["toxic"] for b in held if not b["toxic"]]
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in held)
    assert sum(pairs) / len(pairs) > 0.95
    assert hit / sum(r["toxic"] for r in held) > 0.85 and hit / sum(r["predicted"] for r in held) > 0.9


def test_toxicity_edges(spark, odd, none):
    from tessera.llm import toxicity

    labels = spark.createDataFrame([(1, 1), (2, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    for df in (odd, none):
        for known in (labels, labels.limit(0)):
            got = toxicity.score_documents(df, known).collect()
            assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows_of(df))
    passed = toxicity.score(odd, toxicity.fit(odd, labels.limit(0)), "_s")
    assert passed.columns == [*odd.columns, "_s"]


def test_isotonic_and_trees():
    import numpy as np

    from tessera.llm.toxicity import Booster, isotonic

    random.seed(4)
    x = np.array([[random.random(), random.random()] for _ in range(600)])
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    margin = Booster(trees=40).fit(x, y).margin(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.97
    at, p = isotonic(margin, y)
    assert (np.diff(at) >= 0).all() and (np.diff(p) >= 0).all()


# --- op 8

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) <= 255, "card": 12 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_pii(spark, odd, none):
    from tessera.llm import pii

    random.seed(3)
    bits = ["a", "@", ".", "1", "2", "4", "0", "+", "-", " ", "(", ")", "é", "😀", "_", "b.c", "@d.e", "1.2.3.4", "4111 1111 1111 1111", "+1 (234) 555-1234", "256.1.1.1", "x@y.z", "Mr. Anna Smith", "123-45-6780", "(212) 555-0100"]
    wild = ["".join(random.choice(bits) for _ in range(random.randint(0, 40))) for _ in range(1500)] + ["1" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "a@b.c" * 500, "+" + "1 " * 20_000]
    for df in (odd, none, spark.createDataFrame(list(enumerate(wild)), "doc_id long, text string")):
        got = pii.find(df).collect()
        want = Counter()
        for i, t in rows_of(df):
            base = brute_spans(t)
            want[i, *(sum(s.startswith(k) for s in base) for k in PATTERNS), hashlib.sha256(",".join(base).encode()).hexdigest()] += 1
        assert Counter(tuple(r)[:6] for r in got) == want
    texts = dict(enumerate(wild))
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(brute_spans(texts[r["doc_id"]])) <= set(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_pii_redaction(spark, odd, none):
    from tessera.llm import pii

    df = spark.createDataFrame([(1, "mail x@y.com now, call +1 (234) 555-1234."), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {1: "mail [EMAIL] now, call [PHONE].", 2: None, 3: "clean"}
    for docs in (odd, none):
        got = pii.redact(docs)
        assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, docs.collect()))


def test_pii_redaction_as_its_spans(spark, odd):
    """Texts put together from the spans that ``find`` gives, of many places and of characters beyond ASCII."""
    from tessera.llm import pii

    random.seed(9)
    bits = ["é😀", "x@y.z ", "+1 (234) 555-1234", "1.2.3.4", "Mr. Anna Smith ", "a [at] b.com", "word ", "4111 1111 1111 1111", "1" * 300, "😀" * 500, "n@m.org,"]
    texts = {i: "".join(random.choice(bits) for _ in range(random.choice([0, 3, 20, 900]))) for i in range(60)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").withColumn("_base", F.lit(1)).withColumn("_extra", F.lit(2)).withColumn("_all", F.lit(3)).withColumn("_cut", F.lit(4)).withColumn("a`b", F.lit(5)).drop("a`b")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    got = pii.redact(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        text, out, at = texts[r["doc_id"]], [], 0
        for kind, start, stop in (x.split(":") for x in spans[r["doc_id"]].split(",") if x):
            if int(start) >= at:
                out += [text[at : int(start)], f"[{kind.upper()}]"]
            at = max(at, int(stop))
        assert r["text"] == "".join(out) + text[at:]


def test_pii_of_many_places(spark):
    """64,000 addresses in one text, and as many candidates beside them, take seconds."""
    import time

    from tessera.llm import pii

    docs = spark.createDataFrame([(1, "a@b.c, " * 64_000), (2, "x [at] y.com 1.2.3.4 é " * 30_000)], "doc_id long, text string").repartition(2)
    start = time.time()
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert (got[1]["n_email"], got[1]["spans"].count("email")) == (64_000, 64_000) and got[2]["n_ip"] == 30_000
    texts = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert texts[1] == "[EMAIL], " * 64_000 and texts[2].count("[IP] é ") == 30_000
    assert time.time() - start < 100


def test_reliabilities_find_the_better_labeler():
    from tessera.llm.pii import reliabilities, train

    random.seed(6)
    counts = Counter()
    for _ in range(4000):
        truth = random.random() < 0.6
        vote = lambda right: int(truth if random.random() < right else not truth)  # noqa: B023,E731
        counts[0, vote(0.95), vote(0.9), vote(0.6), 1, 1, 1] += 1
    share, table, p = reliabilities(sorted(counts.items()))
    assert abs(share - 0.6) < 0.05 and table[0, 1, 1] > 0.9 > 0.75 > table[2, 1, 1]
    assert len(train(sorted(counts.items()), p)) == len(train(sorted(counts.items()), p))


# --- pipeline


def test_pipeline(spark):
    """Every stage's own promise, on what the stage before it left."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.01").checkpoint()
        assert docs.columns == columns
        was, now = dict(rows_of(before)), dict(rows_of(docs))
        if name == "toxicity":
            gone = [t for i, t in was.items() if i not in now]
            assert 0 < len(gone) < 0.2 * len(was)
        if name == "exact_dedup":
            last = {(t or "").translate(LOWER): i for i, t in sorted(was.items())}
            assert now == {i: was[i] for i in last.values()}
        if name == "ngram_join":
            least = {i for i, _, c in brute_components(sorted(was.items())) if i == c}
            assert now.keys() == least
        if name == "pii":
            assert now.keys() == was.keys() and not any(brute_spans(t) for t in now.values())
            assert docs.where("text IS NOT NULL AND n_chars != length(text)").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == docs.count()


def test_pipeline_keeps_one_row_of_a_group(spark):
    """Repeated and null ids: rows are judged, not ids."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, a), (3, d), (3, d), (4, c + " more"), (5, None), (5, ""), (None, "e f"), (None, "g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(0)).repartition(3)
    got = corpus_pipeline.distinct_texts(spark, docs, "")
    assert got.columns == docs.columns
    kept = Counter((i, t or "") for i, t in rows_of(got))
    assert kept == Counter([(1, a), (2, b), (None, c), (3, d), (4, c + " more"), (5, ""), (None, "e f"), (None, "g h")])
    got = corpus_pipeline.near_distinct(spark, docs, "")
    kept = Counter((i, t or "") for i, t in rows_of(got))
    assert kept == Counter([(1, a), (1, b), (4, c + " more"), (3, d), (5, ""), (5, ""), (None, "e f"), (None, "g h")])


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10))
    assert set(entry.oracle_sql()) <= set(names)


# --- op 2


def test_audio(spark):
    import numpy as np

    from tessera.llm import audio

    rng = np.random.default_rng(3)
    tune = lambda n: np.concatenate([0.5 * np.sin(2 * np.pi * 110 * 2 ** (k / 12) * np.arange(1000) / audio.RATE) for k in rng.integers(0, 36, n)])
    songs = [tune(40) for _ in range(6)]
    rows = [(i, audio.to_wav(s)) for i, s in enumerate(songs)]
    rows += [(10, audio.to_wav(songs[2][audio.HOP * 40 :] + rng.normal(0, 0.001, len(songs[2]) - audio.HOP * 40))), (11, rows[4][1]), (12, None), (13, b""), (14, b"no audio"), (None, rows[0][1]), (15, audio.to_wav(tune(1)))]
    media = spark.createDataFrame(rows, "k long, audio binary")
    prints = audio.fingerprints(media, "k", "audio")
    sizes = {r["id"]: len(r["codes"]) for r in prints.collect()}
    assert sizes[0] > 200 and sizes[12] == sizes[13] == sizes[14] == 0 and len(sizes) == len(rows)
    found = {r["id"]: (r["match_id"], r["offset"], r["bit_errors"]) for r in audio.align(prints, media.select("k")).collect()}
    assert found[11][:2] == (4, 0) and found[4][0] == 11
    assert found[10][:2] == (2, 40) and found[10][2] < 0.1 and found[2][:2] == (10, -40)
    assert 1 not in found or found[1][2] > 0.1
    assert audio.align(prints.limit(0), media.select("k")).count() == 0


def brute_alignment(codes, query):
    """(bit errors, id, offset) of the best match, every offset of every other recording tried."""
    import numpy as np

    from tessera.llm.audio import BIT_ERRORS, OVERLAP

    a, best = codes[query], (BIT_ERRORS, None, None)
    for i, b in codes.items():
        for offset in range(1 - len(a), len(b)) if i != query else ():
            low, high = max(0, -offset), min(len(a), len(b) - offset)
            if high - low >= min(OVERLAP, len(a), len(b)):
                wrong = int(np.bitwise_count(np.array(a[low:high]) ^ np.array(b[low + offset : high + offset])).sum())
                best = min(best, (wrong / (32 * (high - low)), i, offset), key=lambda x: (x[0], x[1] is None, x[1:]))
    return best


def test_audio_alignment_with_wrong_bits(spark):
    import numpy as np

    from tessera.llm import audio

    rng = np.random.default_rng(8)
    codes = {i: [int(x) for x in rng.integers(0, 1 << 32, n)] for i, n in enumerate([150, 90, 130, 160, 200, 100, 20, 12, 12, 11, 9, 13])}
    for i, share in zip(range(12), (0.02, 0.06, 0.1, 0.11) * 3, strict=True):  # a part of each with wrong bits, none of it clean for 12 integers
        part = codes[i][len(codes[i]) // 4 :] if i < 6 else codes[i]
        codes[100 + i] = [x ^ sum(1 << b for b in range(32) if rng.random() < share) for x in part]
    codes[200] = codes[3][:2]
    df = spark.createDataFrame([*codes.items(), (300, []), (301, None), (None, codes[1])], "id long, codes array<long>").repartition(3)
    got = {r["id"]: (r["bit_errors"], r["match_id"], r["offset"]) for r in audio.align(df, df.select("id")).collect()}
    want = {i: best for i in codes if (best := brute_alignment(codes, i))[1] is not None}
    assert got == want
    assert all(got[100 + i][1:] == (i, len(codes[i]) // 4 if i < 6 else 0) for i in range(12))


def test_audio_pairs_need_no_longer_transforms_than_their_overlaps(monkeypatch):
    """Offsets at which enough overlaps keep places of their own, and each pair is transformed by little more than these."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import audio

    class Frame:
        def __init__(self, rows):
            self.rows = rows

        def mapInArrow(self, run, schema):
            return [row for batch in run(iter([self.rows])) for row in batch.to_pylist()]

    rng, points = np.random.default_rng(5), []
    codes = [rng.integers(0, 1 << 32, 466).astype(np.int64) for _ in range(6)]
    codes[1][-audio.OVERLAP :] = codes[0][: audio.OVERLAP]  # as little overlap as counts, at either end
    codes[3][: audio.OVERLAP] = codes[2][-audio.OVERLAP :]
    codes[5][-audio.OVERLAP + 1 :] = codes[4][: audio.OVERLAP - 1]  # too little
    (block,) = audio._blocks(Frame(pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(codes, pa.list_(pa.int64()))], ["node", "codes"])), 64)
    kinds = {"ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary()}
    pair = pa.RecordBatch.from_arrays([pa.array([block[k]], t) for _ in range(2) for k, t in kinds.items()], list("abcdef"))
    back = np.fft.irfft

    def counted(spectra, length, **more):
        points.append(spectra.size // spectra.shape[more["axis"]] * length)
        return back(spectra, length, **more)

    monkeypatch.setattr(np.fft, "irfft", counted)
    found = {(r["query"], r["node"], r["offset"], r["bit_errors"]) for r in audio._matches(Frame(pair))}
    assert found == {(0, 1, 402, 0.0), (1, 0, -402, 0.0), (2, 3, -402, 0.0), (3, 2, 402, 0.0)}
    assert sum(points) <= 36 * 1.05 * (466 + 466 - audio.OVERLAP)


def test_audio_recall(spark):
    """Cut, shifted and noisy copies of 210 recordings, and the best match as brute force finds it."""
    import numpy as np

    from tessera.llm import audio

    rng = np.random.default_rng(3)
    t = np.arange(audio.RATE // 4) / audio.RATE
    songs = [0.5 * np.sin(2 * np.pi * (110 * 2 ** (rng.integers(0, 36, 40) / 12))[:, None] * t).ravel() for _ in range(210)]
    rows, planted = [(i, audio.to_wav(x)) for i, x in enumerate(songs)], {}
    for k, sigma in enumerate((0.01, 0.03, 0.1)):
        for i in range(0, 210, 3):
            at = int(rng.integers(2000, 12000))
            rows.append((1000 * (k + 1) + i, audio.to_wav(songs[i][at : at + 20_000] + rng.normal(0, sigma, 20_000))))
            planted[1000 * (k + 1) + i] = (i, at / audio.HOP, sigma)
    media = spark.createDataFrame(rows, "k long, audio binary").repartition(4)
    prints = audio.fingerprints(media, "k", "audio").cache()
    found = {r["id"]: r for r in audio.align(prints, media.select("k")).collect()}
    codes = {r["id"]: r["codes"] for r in prints.collect()}
    for sigma in (0.01, 0.03, 0.1):
        # A copy may align best with another copy of the same recording; both begin where they were cut.
        mine = [q for q, p in planted.items() if p[2] == sigma]
        right = [q for q in mine if q in found and (source := planted.get(found[q]["match_id"], (found[q]["match_id"], 0, 0)))[0] == planted[q][0] and abs(found[q]["offset"] + source[1] - planted[q][1]) <= 2]
        assert len(right) >= 0.9 * len(mine), sigma
    clean = [i for i in range(210) if i % 3]
    assert sum(i in found for i in clean) <= 0.02 * len(clean)
    several = [1, *(q for q in planted if q % 30 == 0)][:12]
    for q in several:
        errors, node, offset = brute_alignment(codes, q)
        assert (q in found) == (node is not None) and (node is None or (found[q]["bit_errors"], found[q]["match_id"], found[q]["offset"]) == (errors, node, offset))


def test_audio_plays_all_values(spark):
    from tessera.llm import audio

    start = [0.1 * (k % 7) for k in range(16)]
    vectors = spark.createDataFrame([(1, start + [0.3] * 48), (2, start + [-0.4] * 48), (3, []), (4, None)], "vec_id long, embedding array<float>")
    heard = {r["vec_id"]: audio.from_wav(bytes(r["audio"])) for r in audio.render(vectors).collect()}
    assert [len(heard[i]) for i in (1, 2, 3, 4)] == [64 * audio.RATE // 4] * 2 + [0, 0]
    prints = {r["id"]: r["codes"] for r in audio.fingerprints(audio.render(vectors), "vec_id", "audio").collect()}
    assert prints[1] != prints[2]


# --- words that differ but were made to collide, and batches that come again


def thue_morse(n, a, b):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out[:n]


def test_words_made_to_collide(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes; operators tell them apart."""
    from tessera.llm.license_scan import license_scan
    from tessera.llm.ngram_join import ngram_components
    from tessera.llm.substring_dedup import new_index, substring_dedup
    from tessera.llm.words import words_of

    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    assert len(set(words_of([f"{one} {two}".encode()]).hashes.tolist())) == 2
    rest = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*rest[:30], one, *rest[30:]])), (2, " ".join([*rest[:30], two, *rest[30:]])), (3, one), (4, two), (5, one + " x"), (6, f"{one} {one}"), (7, f"{one} {two}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup(docs, new_index(spark, 2)).collect())) == brute_substring(rows, 35)
    assert Counter(map(tuple, ngram_components(docs).collect())) == brute_components(rows)
    got = license_scan(docs).collect()
    assert all(r["n_base"] == 0 for r in got)


def test_short_words_have_hashes_of_their_own():
    from tessera.llm.words import words_of

    words = {bytes(random.choice(b"\x00\x01ab\xc3\xa9") for _ in range(random.randint(1, 9))) for _ in range(3000)} | {b"\x00" * n for n in range(1, 12)}
    words = sorted(words)
    found = words_of([b" ".join(words)])
    assert [found.word(i) for i in range(len(words))] == words and len(set(found.hashes.tolist())) == len(words)


def test_exact_dedup_again(spark, tmp_path):
    """A batch that comes again is judged as the first time, also after later ones; leftovers of lost attempts don't count."""
    from tessera.llm.exact_dedup import DigestIndex, exact_dedup

    frame = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    path = str(tmp_path / "index")
    index = DigestIndex(spark, path, 4)
    first, second = frame((1, "a"), (2, "b")), frame((3, "a"), (4, "c"), (5, "C"))
    judged = lambda docs, batch, own=None: sorted((r["doc_id"], r["keep_id"], r["seen"], r["kept"]) for r in exact_dedup(docs, own or index, batch).collect())
    lost = spark.createDataFrame([(bytearray(hashlib.sha256(b"a").digest()), 77, "nobody")], "digest binary, keep_id long, attempt string")
    lost.write.bucketBy(4, "digest").sortBy("digest").format("parquet").mode("append").option("path", index.at).saveAsTable(index.name)
    one = judged(first, "one")
    assert one == [(1, 1, False, True), (2, 2, False, True)] == judged(first, "one")
    two = judged(second, "two")
    assert two == [(3, 1, True, False), (4, 5, False, False), (5, 5, False, True)]
    assert judged(first, "one") == one and judged(second, "two", DigestIndex(spark, path)) == two
    assert index.rows().count() == 3 and DigestIndex(spark, path, 99).buckets == 4
    index.close()


def test_exact_dedup_in_batches(spark, odd, none, corpus):
    from tessera.llm.exact_dedup import exact_dedup_in_batches, new_index

    for df in (odd, none, corpus):
        rows, index = rows_of(df), new_index(spark, 4)
        got = exact_dedup_in_batches(df, index).collect()
        groups = {}
        for doc_id, text in rows:
            groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
        top = lambda ids: max((i for i in ids if i is not None), default=None)
        want = Counter((i, hashlib.sha256(t.encode()).digest(), top(ids), len(ids)) for t, ids in groups.items() for i in ids)
        assert Counter((r["doc_id"], bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        assert len(index.log.entries()) == (3 if rows else 1)


def test_substring_dedup_of_batches_together(spark, odd, none, corpus):
    from tessera.llm.substring_dedup import dedup_in_batches, new_index

    for df in (odd, none, corpus):
        index = new_index(spark, 4, max_runs=1)
        got = dedup_in_batches(df, index)
        assert Counter(map(tuple, got.collect())) == brute_substring(rows_of(df), 35)
        assert len(index.log.entries()) == 2 and index.generation == 1 and index.runs() == 1
        index.close()


def test_substring_dedup_again(spark, corpus, tmp_path):
    """A batch that comes again isn't a repetition of itself."""
    from tessera.llm.substring_dedup import FingerprintIndex, substring_dedup

    rows = sorted(rows_of(corpus))
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index = FingerprintIndex(spark, str(tmp_path / "runs"), 2, max_runs=1)
    substring_dedup(frame(rows[:90]), index, batch="one")
    for _ in range(2):
        got = substring_dedup(frame(rows[90:]), index, frame(rows[:90]), batch="two")
        assert Counter(map(tuple, got.collect())) == brute_substring(rows[90:], 35, [t for _, t in rows[:90]])
    assert index.generation == 1 and len(index.log.entries()) == 2
    files = [n for n in index.log.storage.names(index.at) if n.startswith("part-")]
    assert len(files) == len({n.rsplit("_", 1)[-1] for n in files}) == 2  # a file a bucket, in the bucket that readers expect


def test_ngram_order_knows_passages_that_no_task_meets_twice(spark):
    """Shingles of a passage come after those of one document, though each task meets the passage once."""
    from tessera.llm import ngram_join
    from tessera.llm.substring_dedup import keyed

    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = words(40)
    rows = [(i, f"{words(30)} {passage}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12, "doc_id").localCheckpoint()
    order = ngram_join.frequent_shingles(ngram_join.signatures(keyed(docs)[0], 5))
    assert len(order.tokens) == 0
    common = ngram_join.shingle_sets([passage.encode()], 5)[0]
    grams, _, places = ngram_join.shingle_sets([rows[0][1].encode()], 5, order)
    assert set(grams[-len(common) :].tolist()) == set(common.tolist())
    assert (order.partners(places)[0][-len(common) :] > ngram_join.RARE_PARTNERS).all()
    shown = ngram_join.prefixes(keyed(docs)[0], order, 5, 75)
    assert shown.groupBy("token").count().where("count > 1").count() == 0  # none of the passage: no document is compared


def test_ngram_counts_of_medium_frequency(spark, monkeypatch):
    """A shingle that no batch of a task holds often is counted over the task, and its list is split."""
    from tessera.llm import ngram_join
    from tessera.llm.substring_dedup import keyed

    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = [(i, " ".join([*(word() for _ in range(4)), *(["once", "upon", "a", "time", "there"] if i % 5 == 0 else []), word(), word()])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        order = ngram_join.frequent_shingles(ngram_join.signatures(keyed(docs)[0], 5))
        assert order.count_of_rank.tolist() == [80] and order.missed == ngram_join.REPORTED - 1
        monkeypatch.setattr(ngram_join, "SALT_ROWS", 20)
        shown = ngram_join.prefixes(keyed(docs)[0], order, 5, 1)  # one shingle is enough to link: all are shown
        lists = shown.where(F.col("token") == int(order.tokens.view("int64")[0])).groupBy("salt").count().collect()
        assert len(lists) == 5 and all(r["salt"] > 0 and r["count"] < 40 for r in lists)
        monkeypatch.setattr(ngram_join, "COUNTED", 100)  # what is reported is never too high, and too low by ``missed`` at most
        fewer = ngram_join.frequent_shingles(ngram_join.signatures(keyed(docs)[0], 5))
        known = int(fewer.count_of_rank[0]) if len(fewer.count_of_rank) else 0
        assert known <= 80 <= known + fewer.missed
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pipeline_on_odd_rows(spark, odd, none):
    """Every stage on nulls, empty and long texts, repeated rows, ties, clashing names, and on an empty table."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd, none):
        rows = rows_of(docs)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SF)
            if name == "packing":
                assert sum(r["length"] for r in got.collect()) == sum(len(theirs.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
                continue
            assert got.columns == docs.columns
            kept = Counter(rows_of(got))
            if name == "toxicity":
                assert kept <= Counter(rows) and all(kept[r] in (0, n) for r, n in Counter(rows).items())
            if name == "exact_dedup":
                assert sorted((t or "").translate(LOWER) for _, t in kept.elements()) == sorted({(t or "").translate(LOWER) for _, t in rows})
                assert (6, "alpha beta gamma delta epsilon zeta") in kept or not rows
            if name == "ngram_join":
                groups = brute_components([(i, t) for i, (_, t) in enumerate(rows)])
                assert kept.total() == sum(i == c for i, _, c in groups)
            if name == "pii":
                assert kept.total() == len(rows) and not any(brute_spans(t) for _, t in kept)


def test_packing_of_conversations(spark):
    """Instruction data: answers bear loss, questions don't, and the limit on loss-bearing tokens comes first."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.packing import Limits, pack_documents

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", "role")
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    limits = Limits(2048, 24, 900)
    got = pack_documents(
        turns, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, limits=limits, added=public_tokenizers.path("byte_bpe_50k.json"), bears=F.col("role") == "assistant"
    ).collect()
    rows = {r["doc_id"]: (len(theirs.encode(r["text"] or "", add_special_tokens=False).ids) + 1, r["role"] == "assistant") for r in turns.collect()}
    assert Counter(i for r in got for i in [r["doc_id"]] * r["length"]) == Counter({i: n for i, (n, _) in rows.items()})
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    bearing = []
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        bearing.append(sum(r["length"] - (r["start"] == 0) for r in pieces if rows[r["doc_id"]][1]))
        assert at <= limits.tokens and len(pieces) <= limits.segments and bearing[-1] <= limits.loss_tokens
    assert sum(b > 0.9 * limits.loss_tokens for b in bearing) > 0.5 * len(bearing)  # it does bind


def test_toxicity_rows_of_tokens():
    """What each token contributes, counted character by character, with less work than that."""
    import random
    import sys

    import numpy as np

    from tessera.llm import toxicity as X

    rng = random.Random(4)
    some = "aAbBidotIDOT1!?.@$*_- ıİßſÀé²Ⅷ一٣日本語😀"
    tokens = ["".join(rng.choices(some.replace(" ", ""), k=rng.randint(1, 12))) for _ in range(4000)]
    tokens += ["idiot", "1d10t", "i.d.i.o.t", "id-iot", "You!", "(you)", "ıııı", "İİİ", "!!!", "x" * 3000, "...a", "a...", "a.b", *(chr(c) for c in range(33, 0x3000) if not chr(c).isspace())]
    tokens = list(dict.fromkeys(tokens))
    lexicon = {"idi-": 2.5, "idiot": 3.0, "a": 0.5, "ab": 1.5, "aab-": 0.7, "éa": 1.0, "一": 2.0, "bbbbb-": 4.0}

    def weight(text):
        words = X._LETTERS.findall(text)
        return max([0.0, *(lexicon.get(s, 0.0) for w in words for s in X.stems(w))]), any(w in X.INSULTS for w in words)

    def row(token):
        lower = token.lower()
        odd = bool(X._INNER.search(lower))
        ways = [weight(lower), *([weight(lower.translate(X.LEET))] if odd else [])]
        letters, upper, digits = (sum(map(f, token)) for f in (str.isalpha, str.isupper, str.isdigit))
        bare = lower.strip(".,;:!?\"'()[]") in X.SECOND_PERSON
        return [max(w for w, _ in ways), any(i for _, i in ways), bare, letters >= 2 and upper == letters, letters, upper, len(token) - letters - digits, token.count("!"), token.count("?"), digits, odd]

    table = X.TokenTable(lexicon)
    got = table.of([*tokens, *tokens[:50]])
    want = np.array([row(t) for t in tokens], np.float32)
    assert (got == np.concatenate([want, want[:50]])).all() and (table.of(tokens[::-1]) == want[::-1]).all()
    small = X.TokenTable(lexicon, 100)  # what doesn't fit is forgotten and made again
    assert all((small.of(tokens[i : i + 80]) == want[i : i + 80]).all() for i in range(0, len(tokens), 40))
    table, calls = X.TokenTable({}), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    plain = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(5000)]
    sys.setprofile(count)
    table.of(plain)
    sys.setprofile(None)
    assert calls < 10 * len(plain)


def test_toxicity_as_brute_force(spark):
    """Lexicon, features, trees, calibration and scores, worked out again one text, word and node at a time."""
    import math

    import numpy as np

    from tessera.llm import toxicity as X

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = X.fit(docs, labels)
    texts = dict(rows_of(docs))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts and r["toxic"] is not None}
    n = Counter(known.values())
    met = {1: Counter(), 0: Counter()}
    for i, toxic in known.items():
        words = {w for w in re.findall(r"[^\W\d_]+", (texts[i] or "").lower())}
        met[toxic].update({e for w in words for e in [w, *(f"{w[:k]}-" for k in (3, 4, 5, 6) if len(w) > k)]})
    want = {e: math.log((a + 0.2) / (n[1] + 0.4)) - math.log((met[0][e] + 0.2) / (n[0] + 0.4)) for e, a in met[1].items() if a >= X.LEXICON_SUPPORT and a > met[0][e]}
    assert len(want) <= X.LEXICON_ENTRIES and model.lexicon.keys() == want.keys()
    assert all(abs(model.lexicon[e] - v) < 1e-9 for e, v in want.items())

    def seen(token):
        words = re.findall(r"[^\W\d_]+", token)
        entries = [e for w in words for e in [w, *(f"{w[:k]}-" for k in (3, 4, 5, 6) if len(w) > k)]]
        return max([0.0, *(want.get(e, 0.0) for e in entries)]), any(w in X.INSULTS for w in words)

    def brute_features(text):
        rows = []
        for token in text.split():
            low = token.lower()
            weight, insult = seen(low)
            if odd_one := bool(X._INNER.search(low)):
                again, hidden = seen(low.translate(X.LEET))
                weight, insult = max(weight, again), insult or hidden
            letters, upper, digits = (sum(f(c) for c in token) for f in (str.isalpha, str.isupper, str.isdigit))
            rows.append((float(np.float32(weight)), insult, low.strip(".,;:!?\"'()[]") in X.SECOND_PERSON, letters > 1 and letters == upper, letters, upper, len(token) - letters - digits, token.count("!"), token.count("?"), digits, odd_one))
        if not rows:
            return [0.0] * len(X.FEATURES)
        size, total = len(rows), [sum(c) for c in zip(*rows, strict=True)]
        strong, person = [i for i, r in enumerate(rows) if r[0] >= X.STRONG or r[1]], [i for i, r in enumerate(rows) if r[2]]
        near = sum(any(abs(i - j) <= X.NEAR for j in person) for i in strong) / len(strong) if strong else 0.0
        top = sorted((r[0] for r in rows), reverse=True)[:3]
        letters, every = max(1.0, total[4]), max(1.0, total[4] + total[6] + total[9])
        return [
            math.log1p(size), total[1] / size, math.log1p(total[1]), top[0], sum(r[0] for r in rows if r[0] > 1) / size, len(strong) / size, math.log1p(len(strong)), sum(top) / len(top), total[2] / size,
            near, total[3] / size, total[5] / letters, total[6] / every, total[7] / size, total[8] / size, total[9] / every, total[10] / size, total[4] / size,
        ]

    def walk(tree, x, node=0):
        return tree.value[node] if tree.feature[node] < 0 else walk(tree, x, tree.left[node] if x[tree.feature[node]] <= tree.cut[node] else tree.right[node])

    table = X.TokenTable(model.lexicon)
    got = {r["doc_id"]: r["score"] for r in X.score(docs, model).collect()}
    for i, text in sorted(texts.items()):
        mine = X.features(text or "", table)
        assert np.allclose(mine, brute_features(text or ""), rtol=1e-5, atol=1e-6), i
        margin = model.booster.base + sum(walk(t, mine) for t in model.booster.grown)
        k = next((k for k, a in enumerate(model.at) if a >= margin), None)
        if k in (0, None) or model.at[k] == margin:
            p = model.probability[-1 if k is None else max(j for j, a in enumerate(model.at) if a == model.at[k]) if model.at[k] == margin else 0]
        else:
            a, b = model.at[k - 1], model.at[k]
            p = model.probability[k - 1] + (model.probability[k] - model.probability[k - 1]) * (margin - a) / (b - a)
        assert abs(got[i] - min(1, max(0, p * (1 - 1e-4) + 1e-4 / (1 + math.exp(-margin))))) < 1e-6, i


def test_isotonic_as_brute_force():
    """Pooled blocks are those of the largest lower bound of the means from here on."""
    import numpy as np

    from tessera.llm.toxicity import isotonic

    rng = np.random.default_rng(2)
    for _ in range(20):
        score = rng.permutation(30).astype(float)
        y = (rng.random(30) < score / 40).astype(float)
        by = y[np.argsort(score)]
        fit = [max(min(by[i : j + 1].mean() for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
        at, p = isotonic(score, y)
        want = []
        for k in range(30):
            block = [j for j in range(30) if abs(fit[j] - fit[k]) < 1e-12]
            want.append((by[block].sum() + 0.05) / (len(block) + 0.1))
        assert np.allclose(np.interp(np.arange(30), at, p), np.maximum.accumulate(want))


def test_buckets_follow_the_size(spark, corpus, tmp_path):
    from tessera.llm.common import buckets_for

    corpus.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert buckets_for(corpus) == buckets_for(read) == 32
    assert buckets_for(corpus, 4096, 1) == -(-2048 * corpus.count() // 4096) and 1 < buckets_for(read, 4096, 1) < 200
