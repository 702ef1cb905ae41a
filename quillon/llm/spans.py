"""Regex spans with code-point offsets, built from DataFrame functions alone.

``split`` and ``regexp_extract_all`` walk the same ``Matcher.find`` loop, so the pieces
between matches and the matches themselves interleave to the whole text, and running sums of
their lengths are the offsets. Patterns must not match the empty string. They are Java
regexes; possessive quantifiers and look-behinds keep every scan linear in the text, also on
runs of a hundred thousand letters or digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
SPAN = "array<struct<start:int,end:int,m:string>>"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _offsets(lengths: Column, blocks: Column, i: Column) -> Column:
    """Sum of the first ``i`` lengths: whole blocks, then the rest of one."""
    b = F.floor(i / BLOCK).cast("int")
    return _sum(F.slice(blocks, F.lit(1), b)) + _sum(F.slice(lengths, b * BLOCK + 1, i - b * BLOCK))


def locate(text: Column, found: Column, pattern: str) -> Column:
    """[start, end) of each of ``found``, the matches of ``pattern``; empty if there is none.

    Sums go over blocks first, so ten thousand matches in one text stay cheap.
    """
    def placed(pair: Column) -> Column:
        gaps, lens = pair["gaps"], pair["lens"]
        n = F.size(lens)
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
            lambda b: _sum(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK))) + _sum(F.slice(gaps, b * BLOCK + 1, F.lit(BLOCK))),
        )
        both = F.zip_with(F.slice(gaps, F.lit(1), n), lens, lambda a, b: a + b)
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: _offsets(both, blocks, i) + F.get(gaps, i),
        )

    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pair = F.array(F.struct(gaps.alias("gaps"), F.transform(found, lambda x: F.length(x)).alias("lens")))
    # one-element transforms bind a value that is used many times, so it is computed once
    starts = F.element_at(F.transform(pair, placed), 1)
    spans = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m")))
    return F.when(F.size(found) > 0, spans).otherwise(F.from_json(F.lit("[]"), SPAN))


def spans(text: Column, pattern: str) -> Column:
    return locate(text, matches(text, pattern), pattern)


def tagged(found: Column, kind: str, rank: int) -> Column:
    """Spans as structs that sort by start and then kind, or by ``rank`` and then start."""
    return F.transform(found, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written(tags: Column, by_start: bool) -> Column:
    """kind:start:end, comma-joined, by start and then kind, or by kind and then start."""
    first, second = ("start", "rank") if by_start else ("rank", "start")
    keyed = F.transform(tags, lambda s: F.struct(s[first].alias("a"), s[second].alias("b"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
