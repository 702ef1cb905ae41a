"""Secret scans through a trigram inverted index.

1. A Boolean trigram query is derived from each rule's regex (``trigram_query``): a
   disjunction of sets of trigrams, all of which a matching text must hold.
2. ``build_index`` posts (trigram, row) for the trigrams that the rules ask for, over
   lower-cased whole texts. Postings of trigrams that no rule asks for would never be read; ``also`` posts those of rules to come.
3. ``candidates`` intersects the postings: the trigrams of a row are folded
   into a bit set with ``bit_or`` (combined before the shuffle, so a trigram that every
   document holds costs one row per document and task), and each rule's query is a test of it.
4. ``verify`` runs each rule's regex on its candidates only. A rule without mandatory
   trigrams, as a run of hex digits, is verified on every document.

Texts are written once, as a table that candidates join in place; only postings and candidates move. Everything is DataFrame functions. Null texts count as empty; a null doc_id is a document
like any other; repeated rows give repeated rows; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import spans as S
from quillon.llm.common import PARTIAL_KEYS, materialize, settings, stored_rows

Query = tuple[frozenset[str], ...]
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` proposes spans; a span stays if ``value_group`` has ``min_length`` characters."""

    kind: str
    pattern: str
    value_group: int = 0
    min_length: int = 0


#: The base kinds, in the order in which equal starts are listed. ``{16,}`` and ``{14,}`` are
#: the base patterns with their minimum lengths: runs are maximal, so both drop the same ones.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Published shapes of further credentials; their spans come after the base kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE


def _product(a: set[str], b: set[str]) -> set[str]:
    return {x + y for x in a for y in b}


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _and(a: Query, b: Query) -> Query:
    return tuple(dict.fromkeys(x | y for x in a for y in b))


ANY: Query = (frozenset(),)


def _needed(strings: set[str]) -> Query:
    """What a text that holds one of ``strings`` must hold."""
    return tuple(dict.fromkeys(_trigrams(s) for s in sorted(strings))) if strings and min(map(len, strings)) >= 3 else ANY


def _exact(nodes) -> set[str] | None:
    """All strings that a small regex can match, or None."""
    out = {""}
    for node in nodes:
        one = _exact_node(node)
        if one is None or len(out) * len(one) > MAX_STRINGS:
            return None
        out = _product(out, one)
    return out


def _exact_node(node) -> set[str] | None:
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is rc.SUBPATTERN:
        return _exact(arg[3])
    if op is rc.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT) and arg[1] <= 4:
        one, out, power = _exact(arg[2]), set(), {""}
        if one is None or len(one) ** arg[1] > MAX_STRINGS:
            return None
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                out |= power
            power = _product(power, one)
        return out
    if op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
        return {""}
    return None


def _query(nodes) -> Query:
    query, run = ANY, {""}
    for node in nodes:
        one = _exact_node(node)
        if one is not None and len(run) * len(one) <= MAX_STRINGS:
            run = _product(run, one)
            continue
        query, run = _and(query, _needed(run)), {""}
        op, arg = node
        if one is not None:
            run = one
        elif op is rc.SUBPATTERN:
            query = _and(query, _query(arg[3]))
        elif op is rc.BRANCH:
            query = _and(query, tuple(dict.fromkeys(b for x in arg[1] for b in _query(x))))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT) and arg[0] >= 1:
            query = _and(query, _query(arg[2]))
    return _and(query, _needed(run))


def trigram_query(pattern: str) -> Query:
    """Alternatives, each a set of lower-cased trigrams that a match must hold; ANY if there is no such set."""
    branches = _query(rp.parse(pattern))
    if any(not b for b in branches):
        return ANY
    return tuple(b for b in branches if not any(o < b for o in branches))


def _mask(grams: list[str], wanted: frozenset[str]) -> list[int]:
    words = [0] * (len(grams) // 63 + 1)
    for g in wanted:
        words[grams.index(g) // 63] |= 1 << (grams.index(g) % 63)
    return words


def rule_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(b for r in rules for b in trigram_query(r.pattern)), set()))


def build_index(rows: DataFrame, rules: tuple[Rule, ...] = RULES, also: tuple[str, ...] = (), row: str = "_row") -> DataFrame:
    """Postings (trigram, ``row``) of the trigrams that the rules ask for, and of ``also``, lower-case ones."""
    grams = F.array(*[F.lit(g) for g in sorted({*rule_trigrams(rules), *also})])
    low = rows.select(row, F.lower("text").alias("low"))
    held = F.filter(grams, lambda g: F.contains(F.col("low"), g))
    return low.select(F.explode(held).alias("trigram"), row)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES, row: str = "_row") -> DataFrame:
    """(``row``, rules): for each row the kinds whose trigram query its postings satisfy."""
    grams = rule_trigrams(rules)
    at = F.array_position(F.array(*[F.lit(g) for g in grams]), F.col("trigram")) - 1
    words = len(grams) // 63 + 1
    index = index.where(F.col("trigram").isin(grams))
    bits = index.select(row, at.cast("int").alias("at")).groupBy(row).agg(
        *[F.bit_or(F.when(F.floor(F.col("at") / 63) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 63)).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    )

    def holds(branch: frozenset[str]) -> Column:
        out = F.lit(True)
        for w, m in enumerate(_mask(grams, branch)):
            out = out & (F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long"))
        return out

    def meets(rule: Rule) -> Column:
        out = F.lit(False)
        for b in trigram_query(rule.pattern):
            out = out | holds(b)
        return out

    indexed = [r for r in rules if trigram_query(r.pattern) != ANY]
    kinds = F.array_compact(F.array(*[F.when(meets(r), F.lit(r.kind)) for r in indexed])) if indexed else F.array().cast("array<string>")
    return bits.select(row, kinds.alias("rules")).where(F.size("rules") > 0)


def verify(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id`` and one array of spans (start, end, m) per rule kind, of rows with ``text`` and ``rules``, the kinds to try."""
    out = rows.select("id", "rules", F.coalesce("text", F.lit("")).alias("text"))
    none = F.lit(None).cast("array<string>")
    out = out.withColumns({
        f"_{r.kind}": F.when(F.array_contains("rules", r.kind), S.matches(F.col("text"), r.pattern)).otherwise(none)
        if trigram_query(r.pattern) != ANY
        else S.matches(F.col("text"), r.pattern)
        for r in rules
    })
    empty = F.from_json(F.lit("[]"), S.SPAN)

    def found(r: Rule) -> Column:
        spans = F.coalesce(S.locate(F.col("text"), F.col(f"_{r.kind}"), r.pattern), empty)
        return F.filter(spans, lambda s: F.length(F.regexp_extract(s["m"], r.pattern, r.value_group)) >= r.min_length) if r.min_length else spans

    return out.select("id", *[found(r).alias(r.kind) for r in rules])


def find_secrets(docs: DataFrame, where: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and one array of spans (start, end, m) per rule kind: index, intersect and verify, below ``where``."""
    with stored_rows(docs.select("doc_id", "text"), where) as (rows, _, _):
        index = materialize(build_index(rows, rules), f"{where}/postings")
        hits = materialize(candidates(index, rules).withColumn("_part", F.shiftright("_row", 33)), f"{where}/candidates")
        with settings(docs.sparkSession, PARTIAL_KEYS):
            found = verify(rows.join(hits.hint("shuffle_hash"), ["_part", "_row"], "left"), rules)
            return materialize(found, f"{where}/found").withColumnRenamed("id", "doc_id")
