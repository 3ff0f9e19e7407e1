"""Secrets in texts, found through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: an OR over its alternatives of
the trigrams that each must contain. The index holds, for the trigrams of the queries, the documents in
whose lower-cased text they stand; its postings are intersected per document, and only candidates are
verified with the rule's expression. A rule of which some alternative has no mandatory trigram scans all
texts; parts of an expression that would give more than MANY alternatives count as anything, so that such a rule
may scan all texts, too. Built-in functions only.

Spans are code points, end exclusive, leftmost and non-overlapping within a kind. Defined results: a null
text counts as empty; a row whose doc_id is null is scanned by all rules; repeated rows give one result
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int  # its length is held against least
    least: int
    base: bool


#: The first three kinds are those of the contract.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    # whole runs of [0-9a-f] that are long enough: shorter ones, of which prose is full, are not listed first
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, False),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, False),
)

MANY = 64
#: Bits used of a number that holds trigrams.
WORD = 60
#: Matches whose places are summed in one go.
RUN = 256


def _paths(tree) -> list[tuple[str, ...]]:
    """Alternatives of a parsed expression, each a sequence of literal runs; None between runs stands for anything else."""
    paths: list[tuple] = [()]
    for op, arg in tree:
        if op is C.LITERAL:
            step: list[tuple] = [(chr(arg).lower(),)]
        elif op is C.SUBPATTERN:
            step = _paths(arg[3])
        elif op is C.BRANCH:
            step = [p for branch in arg[1] for p in _paths(branch)]
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 8:
            step = [(x,) for x in sorted({chr(v).lower() for _, v in arg})]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            step = [(), *_paths(arg[2])]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
            step = [(*p, None) for p in _paths(arg[2])]
        elif op is C.AT:
            step = [()]
        else:
            step = [(None,)]
        if len(paths) * len(step) > MANY:
            step = [(None,)]
        paths = [a + b for a in paths for b in step]
    return paths


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams of the lower-cased text, or None if some alternative has none."""
    out = set()
    for path in _paths(parser.parse(pattern)):
        runs = "".join("\0" if x is None else x for x in path).split("\0")
        found = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not found:
            return None
        out.add(found)
    return sorted((q for q in out if not any(o < q for o in out)), key=sorted)


def vocabulary(rules=RULES) -> list[str]:
    return sorted({t for r in rules for q in trigram_query(r.pattern) or () for t in q})


def trigram_index(documents: DataFrame, rules=RULES) -> DataFrame:
    """Postings (trigram: its place in vocabulary(rules), doc_id)."""
    low = documents.select("doc_id", F.lower(F.col("text")).alias("low"))
    have = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary(rules))]).cast("array<int>")
    return low.select("doc_id", F.explode(F.array_compact(have)).alias("trigram")).select("trigram", "doc_id")


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """Intersects postings: doc_id and rules, the numbers of the rules whose query holds. Trigrams are kept as bits, WORD to a number."""
    place = {t: i for i, t in enumerate(vocabulary(rules))}
    held = [F.bit_or(F.expr(f"if(trigram div {WORD} = {w}, shiftleft(1L, trigram % {WORD}), 0L)")).alias(f"seen{w}") for w in range(len(place) // WORD + 1)]
    seen = postings.groupBy("doc_id").agg(*held)

    def all_of(trigrams: frozenset[str]) -> Column:
        masks: dict[int, int] = {}
        for t in trigrams:
            w, bit = divmod(place[t], WORD)
            masks[w] = masks.get(w, 0) | 1 << bit
        return reduce(lambda a, b: a & b, [F.col(f"seen{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in sorted(masks.items())])

    def holds(rule: Rule) -> Column:
        return reduce(lambda a, b: a | b, [all_of(q) for q in trigram_query(rule.pattern) or ()], F.lit(False))

    numbers = F.array(*[F.when(holds(r), F.lit(i)) for i, r in enumerate(rules)]).cast("array<int>")
    return seen.select("doc_id", F.array_compact(numbers).alias("rules")).filter(F.size("rules") > 0)


def _runs(rows: Column) -> Column:
    """Matches in runs of RUN, each with the place where its first gap begins. rows stands in an array to be evaluated once, not for each run."""
    runs = F.transform(F.array(rows), lambda r: F.transform(F.sequence(F.lit(0), ((F.size(r) - 1) / RUN).cast("int")), lambda i: F.slice(r, i * RUN + 1, RUN)))[0]
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<at:int,run:array<struct<gap:int,size:int,tested:int>>>>)").alias("all"))

    def step(acc, run):
        behind = F.aggregate(run, acc["at"], lambda at, x: at + x["gap"] + x["size"])
        return F.struct(behind.alias("at"), F.concat(acc["all"], F.array(F.struct(acc["at"].alias("at"), run.alias("run")))).alias("all"))

    return F.aggregate(runs, start, step, lambda acc: acc["all"])


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (at, end, number, kind) of one rule: gaps between matches and the matches themselves give the places.

    Places are running sums. Appending to one array for each match would take time by the square of their number, so
    sums run within short runs of matches, and once over the runs.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(tested, F.length).alias("tested"))
    none = F.expr("cast(array() as array<struct<at:int,end:int,tested:int>>)")

    def step(acc, x):
        at = acc["at"] + x["gap"]
        return F.struct((at + x["size"]).alias("at"), F.concat(acc["all"], F.array(F.struct(at.alias("at"), (at + x["size"]).alias("end"), x["tested"].alias("tested")))).alias("all"))

    every = F.flatten(F.transform(_runs(rows), lambda r: F.aggregate(r["run"], F.struct(r["at"].alias("at"), none.alias("all")), step, lambda acc: acc["all"])))
    return F.transform(F.filter(every, lambda x: x["tested"] >= rule.least), lambda x: F.struct(x["at"].alias("at"), F.lit(number).alias("number"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def scan(documents: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: doc_id and secrets, an array of (at, number of the rule, end, kind) by place, then rule."""
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = candidates(trigram_index(docs, rules), rules).hint("shuffle_hash")
    rows = docs.join(found, "doc_id", "left")
    none = F.expr("cast(array() as array<struct<at:int,number:int,end:int,kind:string>>)")
    parts = []
    for i, r in enumerate(rules):
        test = F.col("text").rlike(r.pattern)
        if trigram_query(r.pattern) is not None:
            test = (F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", i), F.lit(False))) & test
        parts.append(F.when(test, _spans(F.col("text"), r, i)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("secrets"))


def report(documents: DataFrame, rules=RULES) -> DataFrame:
    """The contract's digest of scan(): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_secrets."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["end"].cast("string"))), ",")

    found, base = scan(documents, rules), [r.kind for r in rules if r.base]
    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(k) for k in base]
    only = F.filter("secrets", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *count, F.sha2(listed(only).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), F.size("secrets").cast("long").alias("n_secrets"))
