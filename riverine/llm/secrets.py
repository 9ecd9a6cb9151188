"""Secret scans: a trigram index proposes the texts for each rule, and the rule's expression verifies them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverine.llm.shared import small_or_not, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Strings that an expression's fixed part may stand for, and clauses of a rule's query, at most; beyond it a part is left out.
STRINGS, CLAUSES = 64, 64
#: Matches whose places are added up in one step.
STEP = 512


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group that holds the secret, and the least characters of that group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Fixed expressions of the three base kinds; the others are published forms of keys.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),  # the runs of [0-9a-f]+ that are long enough, without the short ones
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9]+-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

Query = frozenset  # of clauses; a clause is a frozenset of trigrams that all must occur; the empty clause is always true
ANY: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    """Both hold. Clauses that another makes needless go; where there would be too many, only the first condition stays."""
    found = {x | y for x, y in product(a, b)}
    return _least(found) if len(found) <= CLAUSES else a


def _least(clauses: set[frozenset]) -> Query:
    return frozenset(x for x in clauses if not any(y < x for y in clauses))


def _of_strings(strings: set[str]) -> Query:
    """One of the strings occurs."""
    if not strings or min(map(len, strings)) < 3:
        return ANY
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _walk(tokens, exact: set[str]) -> tuple[Query, set[str], bool]:
    """The query of what precedes, the strings that the last fixed part can be, and whether that part is the whole."""
    query, whole = ANY, True
    for op, arg in tokens:
        name = str(op)
        strings: set[str] | None = None
        inner = ANY
        if name == "LITERAL":
            strings = {chr(arg).translate(str.maketrans(UPPER, LOWER))}
        elif name == "IN":
            strings = _of_class(arg)
        elif name == "AT":
            strings = {""}
        elif name == "SUBPATTERN":
            part, ends, fixed = _walk(arg[3], {""})
            strings = ends if fixed else None
            inner = ANY if fixed else _both(part, _of_strings(ends))
        elif name == "BRANCH":
            parts = [_walk(branch, {""}) for branch in arg[1]]
            if all(fixed for *_, fixed in parts):
                strings = set().union(*(ends for _, ends, _ in parts))
            else:
                inner = _least(set().union(*(_both(q, _of_strings(ends)) for q, ends, _ in parts)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = arg
            part, ends, fixed = _walk(body, {""})
            if fixed and most <= 3 and len(ends) ** most <= STRINGS:
                strings = {"".join(p) for k in range(least, most + 1) for p in product(ends, repeat=k)}
            elif fixed and 3 <= least <= 8 and len(ends) == 1:
                inner = _of_strings({next(iter(ends)) * least})
            elif least:
                inner = _both(part, _of_strings(ends))
        if strings is not None and len(joined := {a + b for a in exact for b in strings}) <= STRINGS:
            exact = joined
        else:
            query, whole = _both(_both(query, _of_strings(exact)), inner), False
            exact = strings if strings is not None and len(strings) <= STRINGS else {""}
    return query, exact, whole


def _of_class(items) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            found.add(chr(arg))
        elif str(op) == "RANGE" and arg[1] - arg[0] < STRINGS:
            found |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return {c.translate(str.maketrans(UPPER, LOWER)) for c in found}


def trigram_query(pattern: str) -> Query:
    """Trigrams (A-Z as a-z) that each text must have in which the expression can match, as alternatives of sets.

    Fixed strings, small classes, alternatives and short repeats give strings, whose trigrams are mandatory; other parts
    of an expression ask for nothing. A query with the empty set is no condition: such a rule has no mandatory trigrams.
    """
    query, ends, _ = _walk(re._parser.parse(pattern), {""})
    return _both(query, _of_strings(ends))


def trigram_index(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """Postings (trigram, key) of the given trigrams in every whole text, a written table sorted by trigram.

    A text's key is a 64-bit hash of it, so copies share their postings; two texts of one key would only add candidates.
    Trigrams that no query asks for need no postings.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    # lower() does to A-Z what the queries ask for, and to other letters what can only add candidates
    folded = docs.select(F.xxhash64(text).alias("key"), F.array(F.lower(text)).alias("t"))
    asked = F.array(*[F.lit(g) for g in trigrams]) if trigrams else F.expr("cast(array() AS array<string>)")
    present = F.flatten(F.transform("t", lambda t: F.filter(asked, lambda g: F.contains(t, g))))  # folded once
    postings = folded.select("key", F.explode(present).alias("trigram")).distinct()
    return written(postings.sortWithinPartitions("trigram"), "postings")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the texts that meet a rule's query, with all rules they meet; intersected by counting, a written table."""
    clauses = [(kind, i, g, len(clause)) for kind, q in queries.items() for i, clause in enumerate(sorted(q, key=sorted)) for g in sorted(clause)]
    spark = postings.sparkSession
    asked = spark.createDataFrame(clauses, "kind string, clause int, trigram string, need int")  # as long as the rules are
    met = postings.join(F.broadcast(asked), "trigram").groupBy("key", "kind", "clause", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    return written(met.groupBy("key").agg(F.collect_set("kind").alias("kinds")), "candidates")


def _added_up(pieces: str, matches: str) -> str:
    """SQL: (start, end) of the matches from the lengths of the pieces between them; in steps, so that many matches cost little more."""
    block = f"slice(sequence(0, size({matches}) - 1), b * {STEP} + 1, {STEP})"
    total = f"aggregate({block}, 0L, (s, i) -> s + {pieces}[i] + {matches}[i])"
    blocks = f"sequence(0, cast(ceil(size({matches}) / {STEP}) AS int) - 1)"
    bases = f"aggregate({blocks}, named_struct('at', 0L, 'out', cast(array() AS array<bigint>)), (s, b) -> named_struct('at', s.at + {total}, 'out', array_append(s.out, s.at))).out"
    span = f"named_struct('start', s.at + {pieces}[i], 'end', s.at + {pieces}[i] + {matches}[i])"
    one = (
        f"aggregate({block}, named_struct('at', base, 'out', cast(array() AS array<struct<start:bigint,end:bigint>>)), "
        f"(s, i) -> named_struct('at', s.at + {pieces}[i] + {matches}[i], 'out', array_append(s.out, {span}))).out"
    )
    return f"flatten(transform({bases}, (base, b) -> {one}))"


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """All columns of docs, and `spans`: an array of (start, end, place of the rule, kind) in order, of every whole text.

    Matches are leftmost and don't overlap within a rule; those whose group is shorter than the rule's least are dropped.
    Characters are code points, ends exclusive.
    """
    queries = {r.kind: q for r in rules if frozenset() not in (q := trigram_query(r.pattern))}
    text = F.coalesce(docs[text_col], F.lit(""))
    names = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), text.alias("t"))
    if queries:
        asked = sorted({g for q in queries.values() for clause in q for g in clause})
        proposed = candidates(trigram_index(docs.select(text.alias("text")), asked), queries)
        keyed = keyed.join(small_or_not(proposed), F.xxhash64("t") == F.col("key"), "left").drop("key")
    else:
        keyed = keyed.withColumn("kinds", F.expr("cast(array() AS array<string>)"))
    found = keyed
    for r in rules:
        hits = F.regexp_extract_all("t", F.lit(r.pattern), F.lit(0))
        some = F.regexp_like("t", F.lit(r.pattern))
        if r.kind in queries:  # others scan every text
            some = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) & some
        lengths = F.when(some, F.transform(hits, lambda m: F.length(m).cast("bigint")))
        secret = F.transform(F.regexp_extract_all("t", F.lit(r.pattern), F.lit(r.group)), lambda m: F.length(m).cast("bigint"))
        between = F.transform(F.split("t", r.pattern, -1), lambda m: F.length(m).cast("bigint"))
        found = found.withColumn(f"m_{r.kind}", lengths)
        found = found.withColumns({f"p_{r.kind}": F.when(F.col(f"m_{r.kind}").isNotNull(), between), f"s_{r.kind}": F.when(F.col(f"m_{r.kind}").isNotNull(), secret)})
    none = "cast(array() AS array<struct<start:bigint,end:bigint,rule:int,kind:string>>)"
    parts = [
        f"IF(m_{r.kind} IS NULL, {none}, transform(filter({_added_up(f'p_{r.kind}', f'm_{r.kind}')}, (x, i) -> s_{r.kind}[i] >= {r.least}), "
        f"x -> named_struct('start', x.start, 'end', x.end, 'rule', {i}, 'kind', '{r.kind}')))"
        for i, r in enumerate(rules)
    ]
    # structs are ordered by start, end, rule; by start and rule is what is asked for
    order = "(a, b) -> CASE WHEN a.start < b.start OR (a.start = b.start AND a.rule < b.rule) THEN -1 WHEN a.start = b.start AND a.rule = b.rule THEN 0 ELSE 1 END"
    return found.select("row.*", F.expr(f"array_sort(concat({', '.join(parts)}), {order})").alias("spans"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, a count of each base rule's spans, base_sha256, spans.

    Each rule's expression gives a Boolean query of trigrams; texts whose postings meet it are verified by the
    expression, and rules without mandatory trigrams (hex) scan every text. Letters count as equal in either case only
    where a rule says so, and then A-Z alone. A null or empty text has no spans, and the digest of nothing; texts of any
    length are scanned whole in their row; spans that start together go by the order of the rules; rows that repeat a
    text get the same result; an empty table gives no rows; other columns, whatever their names, aren't read.
    """
    spans = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules).select("doc_id", "spans")
    base = "filter(spans, x -> x.rule IN ({}))".format(", ".join(str(i) for i, r in enumerate(rules) if r.base) or "NULL")
    shown = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [f"cast(size(filter(spans, x -> x.rule = {i})) AS bigint) AS n_{r.kind}" for i, r in enumerate(rules) if r.base]
    return spans.selectExpr("doc_id", *counts, f"sha2({shown.format(base)}, 256) AS base_sha256", f"{shown.format('spans')} AS spans")
