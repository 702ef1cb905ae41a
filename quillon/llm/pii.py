"""Personal data: regexes propose spans, checksums confirm them, context adjusts the score.

Each kind has a proposing Java regex, a validator over the match (Luhn for cards, mod-97 for
IBANs, digit counts and octet ranges otherwise) and context words. A confirmed span scores the
kind's prior, and more if one of its context words occurs within ``CONTEXT`` characters before
the span or half of that after it. One narrow pass of DataFrame functions over whole texts: no shuffle,
and every pattern is linear in the text.

Null texts count as empty and give no spans; a null doc_id is kept; repeated rows give
repeated rows; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import spans as S

CONTEXT = 48
BONUS = 0.3


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    prior: float
    context: str
    #: A character that every match holds; the regex is not tried where it is absent.
    needs: str = ""
    #: Whether a letter or digit right before or after drops the match.
    bounded: bool = False


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _at(s: Column, i: Column) -> Column:
    return F.ascii(F.substring(s, i, F.lit(1))) - 48


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check: every second digit from the right is doubled."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = _at(digits, i)
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters move to the end, letters count as 10 to 35, the rest is 1."""
    s = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(16, 19) & luhn(d)


def _ip(m: Column) -> Column:
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return m.rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


def _iban(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    return F.length(s).between(15, 34) & mod97(s)


#: The base kinds in the order of the contract, then further ones. Equal to the plain patterns:
#: local parts, numbers and labels are maximal runs, which possessive quantifiers only take
#: faster; a match may start inside a run only where the match before it ended (``\G``).
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.6, r"(?i)e-?mail|contact|write|correo|courriel|kontakt", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.5, r"(?i)ip:|ip address|host|server|login", "."),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){15,}+", _card, 0.7, r"(?i)card|visa|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.5, r"(?i)phone|call|tel|mobile|fax|telefon", "+"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+", _iban, 0.7, r"(?i)iban|account|bank|konto|cuenta|compte", bounded=True),
)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, text and one array per kind of (start, end, m, score), in text order."""
    text = F.col("text")
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    out = out.withColumns({f"_{k.name}": F.when(F.contains(text, F.lit(k.needs)), S.matches(text, k.pattern)).otherwise(none) if k.needs else S.matches(text, k.pattern) for k in kinds})

    def found(k: Kind) -> Column:
        def stays(s: Column) -> Column:
            if not k.bounded:
                return k.valid(s["m"])
            around = F.concat(F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise(F.lit("")), F.substring(text, s["end"] + 1, F.lit(1)))
            return k.valid(s["m"]) & ~around.rlike("[A-Za-z0-9]")

        def scored(s: Column) -> Column:
            before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
            after = F.substring(text, s["end"] + 1, F.lit(CONTEXT // 2))
            near = F.concat_ws(" ", before, after).rlike(k.context)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), F.when(near, F.lit(k.prior + BONUS)).otherwise(F.lit(k.prior)).alias("score"))

        return F.transform(F.filter(S.locate(text, F.col(f"_{k.name}"), k.pattern), stays), scored)

    return out.withColumns({k.name: found(k) for k in kinds}).select("doc_id", "text", *[k.name for k in kinds])


def redact(found: DataFrame, kinds: tuple[Kind, ...] = KINDS, min_score: float = 0.0) -> DataFrame:
    """doc_id and the text with each confirmed match of at least ``min_score`` replaced, where it is, by its kind in brackets; matches that overlap by that of the first."""
    def hits(kind: Kind) -> Column:
        sure = F.filter(F.col(kind.name), lambda s: s["score"] >= min_score)
        return F.transform(sure, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.name).alias("kind")))

    piece = "struct<start:int,end:int,kind:string>"
    none = F.array().cast(f"array<{piece}>")

    def merged(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind")).cast(piece)
        apart = (F.size(done) == 0) | (s["start"] >= F.try_element_at(done, F.lit(-1))["end"])
        return F.when(apart, F.array_append(done, s)).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer)))

    spans = F.aggregate(F.array_sort(F.concat(*map(hits, kinds))), none, merged)
    out = found.select("doc_id", "text", spans.alias("spans"))
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    parts = F.transform("spans", lambda s, i: F.concat(F.substring("text", F.get(begins, i) + 1, s["start"] - F.get(begins, i)), F.lit("["), s["kind"], F.lit("]")))
    rest = F.substring("text", F.get(begins, F.size("spans")) + 1, F.length("text"))
    return out.select("doc_id", F.concat(F.array_join(parts, ""), rest).alias("text"))
