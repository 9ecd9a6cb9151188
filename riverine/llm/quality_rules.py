"""Quality rules of documents, and verdicts on hosts from how many of their documents fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverine.llm.shared import written

SYMBOLS = "#*$%&|<>"


def text_features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep (SQL expressions) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text.

    Only array expressions: no shuffle, so a text of any length stays in its row. Three-word windows of a text are
    compared by 64-bit hashes, at 20,000 words a chance of error of 1e-11.
    """
    quoted = r"[\\x20\\x09-\\x0D]"
    words = docs.selectExpr(*keep, f"coalesce({text_col}, '') AS __t").selectExpr(
        *[k.split(" AS ")[-1] for k in keep],
        f"filter(split(__t, '{quoted}+'), w -> w <> '') AS __w",
        f"filter(split(__t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS __l",
        "length(translate(__t, ' \\t\\n\\u000b\\u000c\\r', '')) AS word_chars",
        f"length(__t) - length(translate(__t, '{SYMBOLS}', '')) AS n_symbols",
    )
    names = [k.split(" AS ")[-1] for k in keep]
    windows = words.selectExpr(
        *names, "word_chars", "n_symbols", "size(__w) AS n_words",
        "size(__l) - size(array_distinct(__l)) AS n_dup_lines",
        """CASE WHEN size(__w) < 3 THEN cast(array() AS array<struct<h:bigint,p:int>>)
           ELSE sort_array(transform(sequence(0, size(__w) - 3),
                i -> named_struct('h', xxhash64(__w[i], __w[i + 1], __w[i + 2]), 'p', i))) END AS __s""",
    )
    repeated = windows.selectExpr(
        *names, "word_chars", "n_symbols", "n_words", "n_dup_lines",
        """sort_array(transform(filter(__s, (x, j) -> (j > 0 AND __s[greatest(j - 1, 0)].h = x.h)
            OR (j < size(__s) - 1 AND __s[least(j + 1, size(__s) - 1)].h = x.h)), x -> x.p)) AS __p""",
    )
    return repeated.selectExpr(
        *names, "cast(n_words AS bigint) AS n_words", "cast(word_chars AS bigint) AS word_chars",
        "cast(n_symbols AS bigint) AS n_symbols", "cast(n_dup_lines AS bigint) AS n_dup_lines",
        """cast(aggregate(__p, named_struct('n', 0, 'e', 0),
            (s, p) -> named_struct('n', s.n + p + 3 - greatest(s.e, p), 'e', p + 3)).n AS bigint) AS n_repeat_words""",
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 50, max_repeat_pct: int = 50, max_host_rate: float = 0.5, least_strength: float = 2.0, most_strength: float = 200.0,
) -> DataFrame:
    """One row per row of docs: doc_id, the five counts, base_failed, host_rate and kept.

    A text fails if it has fewer than min_words words or more than max_repeat_pct per cent of its words stand in
    three-word windows found twice or more. Failures are counted by host; a beta prior fitted to all hosts by
    moments (its strength within least_strength and most_strength) shrinks each host's rate, and all documents of a
    host whose shrunk rate exceeds max_host_rate go. Null texts count as empty, documents without a host form one
    host of their own, repeated rows count each, an empty table gives no rows; other columns aren't read.
    """
    features = text_features(docs, [f"{id_col} AS doc_id", f"{host_col} AS host"], text_col)
    judged = written(features.withColumn("base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_pct} * n_words")), "rules")
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("f"))
    # one row: the prior's mean and strength
    overall = hosts.agg(F.sum("n").alias("nn"), F.sum("f").alias("ff"), F.sum(F.expr("cast(f AS double) * f / n")).alias("sq"))
    prior = overall.selectExpr("ff / nn AS mean", "greatest(sq / nn - (ff / nn) * (ff / nn), 1e-9) AS var").selectExpr(
        "mean", f"least(greatest(mean * (1 - mean) / var - 1, {least_strength}), {most_strength}) AS strength"
    )
    verdicts = hosts.crossJoin(F.broadcast(prior)).selectExpr("host AS __host", "(f + mean * strength) / (n + strength) AS host_rate")
    return judged.join(verdicts, F.col("host").eqNullSafe(F.col("__host"))).selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        f"NOT base_failed AND host_rate <= {max_host_rate} AS kept", "round(host_rate, 6) AS host_rate",
    )
