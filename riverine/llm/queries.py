"""Registered queries of the operators, each over its whole table, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.exact_dedup import DigestIndex, exact_dedup

    index = DigestIndex.temporary(spark)  # each run judges the table alone; a pipeline can name an index and keep it
    judged = exact_dedup(_table(spark, sf_dir, "documents"), index)
    index.drop()
    return judged


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.importance import importance_resample

    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.repeat_spans import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.langid import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.bpe import bpe_round_trip

    return bpe_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverine.llm.alignment import cross_tokenizer

    return cross_tokenizer(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_ngram_join, op3_quality_rules, op4_warc, op5_exact_dedup, op6_quality_classifier, op7_substring_dedup, op8_language_id,
        op9_bpe, op10_packing, op11_secrets, op12_whitening, op13_token_alignment,
    )
}

#: Words as the contracts have them, and lower-casing of A-Z only.
_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, {1 + 5 * i}, 5) AS BIGINT) >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
#: A quotation mark or none, within an SQL string.
_QUOTE = "[\"'']?"
#: Kind, expression, group that has to be long enough, and its least characters, of the rules of op 11.
_RULES = [
    ("assign", rf"((?i:password|passwd|secret|token|api_?key)){_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "(AKIA[A-Z0-9]+)", 1, 18), ("hex", "([0-9a-f]+)", 1, 16), ("github", "(gh[pousr]_[A-Za-z0-9]{36,})", 1, 0),
    ("slack", "(xox[abprs]-[A-Za-z0-9]+-[A-Za-z0-9-]{10,})", 1, 0), ("google", "(AIza[A-Za-z0-9_-]{35})", 1, 0), ("stripe", "([rs]k_live_[A-Za-z0-9]{24,})", 1, 0),
    ("signed", r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1, 0), ("pem", "(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)", 1, 0),
]
_MATCHES = " UNION ALL ".join(
    f"SELECT rid, {k} AS rule, '{kind}' AS kind, unnest(list_transform(regexp_split_to_array(t, '{p}')[:-2], lambda x: length(x))) AS gap, "
    f"unnest(list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x))) AS n, unnest(list_transform(regexp_extract_all(t, '{p}', {g}), lambda x: length(x))) AS m, "
    f"{least} AS least, unnest(range(len(regexp_extract_all(t, '{p}', 0)))) AS i FROM d"
    for k, (kind, p, g, least) in enumerate(_RULES)
)

ORACLE_SQL = {
    "op11_secrets": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        x AS ({_MATCHES}),
        p AS (SELECT *, sum(gap + n) OVER (PARTITION BY rid, rule ORDER BY i) AS stop FROM x),
        s AS (SELECT rid, rule, stop - n AS start, kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM p WHERE m >= least),
        g AS (SELECT rid, count(*) FILTER (rule = 0) AS a, count(*) FILTER (rule = 1) AS k, count(*) FILTER (rule = 2) AS h,
                     string_agg(span, ',' ORDER BY start, rule) FILTER (rule < 3) AS base, string_agg(span, ',' ORDER BY start, rule) AS spans FROM s GROUP BY rid)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g ON g.rid = d.rid""",
    "op1_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, text, string_split(text, chr(10)) AS lines FROM documents),
        t AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
        k AS (SELECT DISTINCT rid, host, line FROM (SELECT rid, host, unnest(lines) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        b AS (SELECT k.host, list(line) AS boiler FROM (SELECT host, line, count(*) AS n FROM k GROUP BY host, line) k
              JOIN t ON k.host IS NOT DISTINCT FROM t.host WHERE n > 1 AND 100 * n > 10 * pages GROUP BY k.host),
        r AS (SELECT d.*, CASE WHEN boiler IS NULL THEN lines ELSE list_filter(lines, lambda l: NOT list_contains(boiler, l)) END AS rest
              FROM d LEFT JOIN b ON d.host IS NOT DISTINCT FROM b.host)
        SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(rest), 0) AS BIGINT) AS n_dropped,
               CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(rest, chr(10)), '') END AS text FROM r""",
    "op3_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
        s AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS w,
                     list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
        win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
        rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
        cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
        f AS (SELECT s.doc_id, s.host, CAST(len(w) AS BIGINT) AS n_words,
                     CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
              FROM s LEFT JOIN cov ON s.rid = cov.rid),
        j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
        h AS (SELECT host, count(*) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM j GROUP BY host),
        o AS (SELECT sum(f) / sum(n) AS mean, greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)), 1e-9) AS var FROM h),
        p AS (SELECT mean, least(greatest(mean * (1 - mean) / var - 1, 2.0), 200.0) AS strength FROM o),
        v AS (SELECT host, (f + mean * strength) / (n + strength) AS host_rate FROM h, p)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND host_rate <= 0.5 AS kept, round(host_rate, 6) AS host_rate
        FROM j JOIN v ON j.host IS NOT DISTINCT FROM v.host""",
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        h AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS x FROM p),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id FROM h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM g""",
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
    "op2_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
        p AS (SELECT a.rid AS x, b.rid AS y, any_value(a.doc_id) AS u, any_value(b.doc_id) AS v, count(*) AS met FROM g a JOIN g b ON a.k = b.k AND a.rid < b.rid GROUP BY a.rid, b.rid),
        l AS (SELECT u, v FROM p JOIN n m ON m.rid = x JOIN n o ON o.rid = y WHERE 100 * met >= 75 * (m.n + o.n - met)),
        e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
        c AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT c.node, e.v FROM c JOIN e ON e.u = c.seen),
        r AS (SELECT node, min(seen) AS component_id FROM c GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN r ON r.node = d.doc_id""",
    "op7_substring_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
        win AS (SELECT rid, doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
        f AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
        gone AS (SELECT DISTINCT rid, i + j AS p FROM win JOIN f ON f.k = win.k, (SELECT unnest(range(0, 13)) AS j) WHERE low < doc_id),
        pos AS (SELECT rid, p, w[p] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
        kept AS (SELECT pos.rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos.p) AS t FROM pos LEFT JOIN gone ON gone.rid = pos.rid AND gone.p = pos.p WHERE gone.rid IS NULL GROUP BY pos.rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.rid = d.rid""",
}
