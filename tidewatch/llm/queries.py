"""One query for each operator, over its whole table, with its contract's columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, chat, decontaminate, divergence, jaccard_join, licenses, pii, quality, rules, sharding, substring, token_output, whitening
from .shared import shared_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard_join.near_duplicates(docs, shingle_words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_read(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.k = {k})) AS bigint)")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.listed("base"), 256).alias("base_sha256"),
        pii.listed("spans").alias("spans"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found, n = token_output.numbered(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, end_id=50256, length=512)
    folder = f"{shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    found = token_output.shards(found, folder, length=512, per_shard=4096, n=n)
    return found.select("doc_id", "part", "n_ids", "number", "slot", "shard", "offset", F.lower(F.hex("digest")).alias("ids_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.conversations(_read(spark, sf_dir, "conversations"))
    return found.select(
        "conv_id", "turn", "role", F.sha2(F.col("own"), 256).alias("own_sha256"), "n_quotes", "linked", "parent_conv", "parent_turn", "position"
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_read(spark, sf_dir, "embeddings"), components=8)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of")
    return found.select("vec_id", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error"
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"), least_docs=10, k=10)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(_read(spark, sf_dir, "documents"), weights=[1.0] * 40, grown=1.0)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_output": op8_token_output,
    "op9_license_scan": op9_license_scan,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_sharding": op13_sharding,
}

_WORDS = r"[^\x20\x09-\x0D]+"
#: Parts of op7's SQL: quartiles of the four rates a to d, and their mean with a wider group's, which counts as 20 rows.
_QUARTILES = ", ".join(f"quantile_disc({k}, {q}) FILTER (NOT base_failed) AS {k}{i}" for k in "abcd" for i, q in ((1, 0.25), (3, 0.75)))


def _leaning(own: str, wider: str) -> str:
    return ", ".join(f"(coalesce({own}.{k}{i}, 0) * {own}.n + {wider}.{k}{i} * 20.0) / ({own}.n + 20.0) AS {k}{i}" for k in "abcd" for i in (1, 3))



#: The same results in DuckDB's SQL. The other operators' models, encodings and layouts aren't
#: expressible there; tests compare these queries with brute-force versions.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
        s AS (
          SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) >= 4)
          UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.first AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS first FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op4_substring_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
        low AS (SELECT gram, min(doc_id) AS lo FROM g GROUP BY gram),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM g JOIN low USING (gram) WHERE doc_id > lo)),
        one AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op7_quality_rules": f"""
        WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
        lines AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_WORDS}') GROUP BY doc_id, line),
        l AS (SELECT doc_id, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup_lines FROM lines GROUP BY doc_id),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
        r AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM g SEMI JOIN r USING (doc_id, gram)) GROUP BY doc_id),
        m AS (
          SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
        s AS (
          SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_symbols - 2, 0) / (word_chars + 1::DOUBLE) AS a,
            greatest(n_dup_lines - 1, 0) / (n_lines + 1::DOUBLE) AS b, greatest(n_repeat_words - 6, 0) / (n_words + 1::DOUBLE) AS c, ln((word_chars + 0.5::DOUBLE) / (n_words + 1)) AS d FROM m),
        q0 AS (SELECT count(*) FILTER (NOT base_failed) AS n, {_QUARTILES} FROM s),
        q1 AS (SELECT lang, count(*) FILTER (NOT base_failed) AS n, {_QUARTILES} FROM s GROUP BY lang),
        q2 AS (SELECT lang, source, count(*) FILTER (NOT base_failed) AS n, {_QUARTILES} FROM s GROUP BY lang, source),
        l1 AS (SELECT lang, {_leaning('q1', 'q0')} FROM q1, q0),
        q AS (SELECT q2.lang, source, {_leaning('q2', 'l1')} FROM q2 JOIN l1 ON l1.lang IS NOT DISTINCT FROM q2.lang)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND a <= a3 + 3.0 * greatest(0.005, a3 - a1) + 1e-9 AND b <= b3 + 3.0 * greatest(0.05, b3 - b1) + 1e-9 AND c <= c3 + 3.0 * greatest(0.05, c3 - c1) + 1e-9
            AND d <= d3 + 3.0 * greatest(0.05, d3 - d1) + 1e-9 AND d >= d1 - 3.0 * greatest(0.05, d3 - d1) - 1e-9 AS kept
        FROM s LEFT JOIN q ON q.lang IS NOT DISTINCT FROM s.lang AND q.source IS NOT DISTINCT FROM s.source""",
    "op12_source_divergence": r"""
        WITH w AS (
          SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        d AS (SELECT row_number() OVER () AS r, * FROM w),
        t AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
        keep AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        g AS (SELECT DISTINCT lang, source FROM w),
        c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN keep USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM keep GROUP BY lang),
        n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
        p AS (
          SELECT g.lang, g.source, keep.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p,
            1 + (1000000000::HUGEINT * (keep.c + 2)) // (v.n + 2 * v.v) AS q
          FROM g JOIN keep ON keep.lang = g.lang JOIN v ON v.lang = g.lang
            LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = keep.term),
        pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    # CRC-32 by its table, over the bytes of the text; shards 0 to 39 and one more bid for each key.
    "op13_sharding": """
        WITH crc AS (
          SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        d AS (SELECT doc_id, 16 + octet_length(encode(coalesce(text, ''))) AS size, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS r FROM documents),
        b AS (SELECT r, list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes FROM d),
        sums AS (SELECT r, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, crc),
        bid AS (
          SELECT r, s, 1 / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS bid
          FROM (SELECT r, doc_id, unnest(range(41)) AS s FROM d)),
        won AS (SELECT r, arg_max(s, bid) FILTER (s < 40) AS shard, arg_max(s, bid) AS grown FROM bid GROUP BY r)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
          row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown::INTEGER AS grown_shard
        FROM d JOIN sums USING (r) JOIN won USING (r)""",
}
