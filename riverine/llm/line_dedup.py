"""Removes lines that stand on a large share of a site's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverine.llm.shared import BROADCAST_BYTES, written

#: Two 64-bit hashes of different seeds: lines are equal when both are.
LINE_KEY = "named_struct('a', xxhash64({0}), 'b', xxhash64(1, {0}))"
#: A line with something else than white space.
NOT_BLANK = r"l -> l rlike '[^\\x20\\x09-\\x0D]'"
#: Bytes of a boilerplate line's key in a broadcast table, and parts of a site where the table is too large for one.
KEY_BYTES, PARTS = 64, 64


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_pct: int = 10
) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped and the text without boilerplate lines.

    A line (split at newlines, compared as it is) is boilerplate on a host, however small, if over max_pct per cent of
    the host's pages contain it, and two at least; lines of white space only never are. A host can have at most
    100 / max_pct times as many such lines as its average page has, so they travel as one array a host. They are
    counted: if they are few, they are broadcast and texts stay where they are, else each site is dealt out in PARTS.
    A null text has 0 lines and stays null; pages without a host form one host; repeated rows count as pages of their
    own; texts of any length stay in their row; an empty table gives no rows; other columns aren't read.
    """
    pages = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy(F.col("host").alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    keys = pages.selectExpr("host", f"explode(array_distinct(transform(filter(split(text, '\\n'), {NOT_BLANK}), l -> {LINE_KEY.format('l')}))) AS k")
    counts = keys.groupBy("host", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(f"100 * n > {max_pct} * pages")
    boiler = written(common.groupBy("site").agg(F.collect_list("k").alias("boiler")), "boilerplate")
    same = F.col("host").eqNullSafe(F.col("site"))
    if (boiler.agg(F.sum(F.size("boiler"))).first()[0] or 0) * KEY_BYTES <= BROADCAST_BYTES:
        met = pages.join(F.broadcast(boiler), same, "left")
    else:
        parts = boiler.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = pages.withColumn("of", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")).join(parts, same & (F.col("of") == F.col("part")), "left")
    split = met.selectExpr("doc_id", "text IS NULL AS none", "split(coalesce(text, ''), '\\n') AS lines", "boiler")
    kept = split.selectExpr("doc_id", "none", "lines", f"IF(boiler IS NULL, lines, filter(lines, l -> NOT array_contains(boiler, {LINE_KEY.format('l')}))) AS rest")
    return kept.selectExpr(
        "doc_id", "IF(none, 0L, cast(size(lines) AS bigint)) AS n_lines",
        "cast(size(lines) - size(rest) AS bigint) AS n_dropped", "IF(none, NULL, array_join(rest, '\\n')) AS text",
    )
