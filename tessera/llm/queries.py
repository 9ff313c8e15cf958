"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, exact_dedup, license_scan, ngram_join, packing, pii, substring_dedup, toxicity, warc
from .common import buckets_for, cut, delete_path, fresh_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), at)
    found = cut(warc.page_records(warc.read_warc(spark, at)))
    delete_path(spark, at)
    return found


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all recordings (embeddings played as tones), and the best match of every hundredth among all."""
    at = fresh_path(spark, "prints")  # as Parquet: steady sounds make codes that pack well
    audio.fingerprints(audio.render(table(spark, sf_dir, "embeddings")), "vec_id", "audio").write.parquet(at)
    prints = spark.read.parquet(at)
    matches = audio.align(prints, prints.where("id % 100 = 0").select("id"))
    codes = prints.select(F.col("id").alias("vec_id"), F.size("codes").cast("bigint").alias("n_codes"), F.sha2(F.array_join("codes", ",").cast("binary"), 256).alias("codes_sha256"))
    found = cut(codes.join(matches.withColumnRenamed("id", "vec_id"), "vec_id", "left"))
    delete_path(spark, at)
    return found


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rank file holds the vocabulary of byte_bpe_50k.json, but not its added tokens; a test compares the ids.
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=public_tokenizers.path("byte_bpe_50k.json")
    ).drop("ids")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = substring_dedup.new_index(spark, buckets_for(docs), max_runs=1)  # so that its two batches are compacted
    found = substring_dedup.dedup_in_batches(docs, index)
    index.close()
    delete_path(spark, index.path)
    return found


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.new_index(spark, buckets_for(docs))
    found = exact_dedup.exact_dedup_in_batches(docs, index)
    index.close()
    delete_path(spark, index.path)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op 3 SQL can express: the places and labels of the base phrases."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op 8 SQL can express: how many spans of each base kind there are."""
    return op8_pii(spark, sf_dir).select("doc_id", *(f"n_{kind}" for kind in pii.BASE))


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op 4 SQL can express: the digest of what the ids decode to."""
    return op4_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_audio": op2_audio,
        "op3_license_scan": op3_license_scan,
        "op4_bpe": op4_bpe,
        "op5_packing": op5_packing,
        "op6_toxicity": op6_toxicity,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_pii": op8_pii,
        "op9_ngram_join": op9_ngram_join,
        "op10_exact_dedup": op10_exact_dedup,
        "base_licenses": base_licenses,
        "base_personal_data": base_personal_data,
        "decoded_texts": decoded_texts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "base_licenses": r"""
            WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
                 h AS (SELECT doc_id, i - 1 AS place, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
                                                        WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label
                       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
                 g AS (SELECT doc_id, count(*) AS n, min(place) AS low, max(place) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h WHERE label IS NOT NULL GROUP BY doc_id)
            SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word, coalesce(labels, '') AS base_labels FROM t LEFT JOIN g USING (doc_id)""",
        "base_personal_data": r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
                 m AS (SELECT doc_id, len(regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
                              regexp_extract_all(x, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
                              list_transform(regexp_extract_all(x, '[0-9]([\x20-]?[0-9])+'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')) AS card,
                              list_transform(regexp_extract_all(x, '\+[0-9][\x20().0-9-]+[0-9]'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')) AS phone FROM t)
            SELECT doc_id, n_email,
                   len(list_filter(ip, lambda c: len(list_filter(string_split(c, '.'), lambda p: NOT coalesce(try_cast(p AS HUGEINT) <= 255, false))) = 0)) AS n_ip,
                   len(list_filter(card, lambda c: length(c) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(c) + 1), lambda i:
                       CASE WHEN i % 2 = 1 THEN CAST(reverse(c)[i] AS INT) ELSE 2 * CAST(reverse(c)[i] AS INT) // 10 + 2 * CAST(reverse(c)[i] AS INT) % 10 END)) % 10 = 0)) AS n_card,
                   len(list_filter(phone, lambda c: length(c) BETWEEN 9 AND 15)) AS n_phone
            FROM m""",
        "decoded_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
        "op1_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
                 d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
                 m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
            SELECT page_id, n AS payload_bytes, h AS payload_digest,
                   CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
            FROM m""",
        "op7_substring_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
                 win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t)),
                 twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
                 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN twice USING (h)),
                 each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
                 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
            SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
            FROM t LEFT JOIN kept USING (doc_id)""",
        "op9_ngram_join": r"""
            WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
                 s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
                       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
                 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
                 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
                 links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
                 reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
            SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(doc_id, coalesce(min(reach.b), doc_id)) AS component_id
            FROM t LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = doc_id GROUP BY doc_id""",
        "op10_exact_dedup": f"""
            WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    }
