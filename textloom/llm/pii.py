"""Personal data: proposed by patterns, confirmed by checksums, weighed by context.

All of it is SQL expressions. A pattern proposes the spans of a kind (leftmost,
non-overlapping); a validator confirms or drops each one (octets at most 255,
Luhn for cards, digit counts for phones, mod-97 for bank accounts); words near the
span raise or lower its score. Patterns use possessive loops and start only where
a run starts, so a long text costs time in proportion to its length.

Spark has no function for all match positions. A text split at a pattern gives
the gaps between its matches, and running sums of the lengths of gaps and matches
give the positions, in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points looked at on either side of a span for context words.
CONTEXT = 48
#: A span counts from this score.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """``must``: a pattern without which a text has no such span (a cheap first test).

    Where ``ends`` is given, the pattern matches only the head of a span and captures what
    may follow; ``ends`` makes of both the confirmed span and whether its length is sure.
    """

    name: str
    pattern: str
    must: str
    valid: Callable[[Column], Column]
    score: float = 1.0
    raised_by: str = ""
    lowered_by: str = ""
    ends: Callable[[Column], Column] | None = None


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _numbers(text: Column) -> Column:
    """Characters as numbers, from the last one to the first."""
    return F.transform(F.split(F.reverse(text), ""), lambda c: F.ascii(c) - 48)


def luhn(span: Column) -> Column:
    """Whether the digits of a span pass the Luhn check."""
    doubled = F.transform(
        _numbers(_digits(span)),
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(span: Column) -> Column:
    """Whether an account number passes the mod-97 check (letters count from 10)."""
    code = F.upper(F.regexp_replace(span, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(code, 5, 1000), F.substring(code, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda r, c: F.when(F.ascii(c) < 58, (r * 10 + F.ascii(c) - 48) % 97).otherwise(
            (r * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1


#: Characters of an account number, and how many the countries have that fixed them.
IBAN_LENGTHS = range(15, 35)
_FIXED = (
    "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 "
    "LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 "
    "ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 "
    "SM27 AL28 AZ28 BY28 CY28 DO28 GT28 HN28 HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 "
    "YE30 MT31 SC31 LC32 RU33"
).split()


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed one time however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _account_pattern(n: int) -> str:
    """An account number of n characters in groups of four, with or without spaces."""
    groups, rest = divmod(n - 4, 4)
    tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"^[A-Z0-9]{{4}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![A-Za-z0-9])"


def account_number(seen: Column) -> Column:
    """``(span, sure)``: the account number that a text starts with; a null span where none is.

    All ends that leave no word or group cut are tested by mod-97. The length that the
    country fixed comes first (``sure``), then the longest.
    """
    ends = [F.regexp_extract(seen, _account_pattern(n), 0) for n in reversed(IBAN_LENGTHS)]

    def fixed(c: Column) -> Column:
        length = F.length(F.replace(c, F.lit(" "), F.lit("")))
        return F.array_contains(F.lit(_FIXED), F.concat(F.substring(c, 1, 2), length.cast("string")))

    def chosen(valid: Column) -> Column:
        return _once(
            F.filter(valid, fixed),
            lambda sure: F.struct(
                F.coalesce(F.get(sure, 0), F.get(valid, 0)).alias("span"),
                (F.size(sure) > 0).alias("sure"),
            ),
        )

    return _once(F.filter(F.array(*ends), lambda c: (c != "") & mod97(c)), chosen)


def _digit_count(span: Column, least: int, most: int) -> Column:
    return F.length(_digits(span)).between(least, most)


def _octets(span: Column) -> Column:
    return F.forall(
        F.split(span, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
        & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255),
    )


#: Base kinds, in the order in which equal starts are listed.
EMAIL = Kind(
    "email",
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "@",
    lambda s: F.lit(True),
)
IP = Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", _octets)
CARD = Kind(
    "card",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "",
    lambda s: _digit_count(s, 12, 19) & luhn(s),
)
PHONE = Kind(
    "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda s: _digit_count(s, 9, 15)
)
BASE = (EMAIL, IP, CARD, PHONE)

#: Kinds that the method adds. An account number stands by its checksum; a social
#: security number needs a context word, as nine digits are often something else.
IBAN = Kind(
    "iban",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]{4}){2}\x20?[A-Z0-9]{3})(?=([\x20A-Za-z0-9]{11,39}+))",
    "",
    lambda s: F.lit(True),
    score=0.9,
    raised_by=r"(?i)\b(iban|account|konto|compte|cuenta)",
    ends=account_number,
)
SSN = Kind(
    "ssn",
    r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "-",
    lambda s: F.lit(True),
    score=0.4,
    raised_by=r"(?i)\b(ssn|social|security|tax)",
    lowered_by=r"(?i)\b(order|invoice|serial|part|model)",
)
ADDED = (IBAN, SSN)

_SPAN = "array<struct<start:int,kind:int,end:int,name:string,score:double>>"


def _proposed(text: Column, kind: Kind) -> Column:
    """Positions and texts of the matches of one kind; an empty array where none can be."""
    none = F.array().cast("array<struct<start:int,end:int,span:string>>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    placed = F.aggregate(
        F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"),
                            x["m"].alias("span"),
                        )
                    ),
                ).alias("out"),
            )
        ),
    )["out"]
    may = F.contains(text, F.lit(kind.must)) if kind.must else text.rlike("[0-9]")
    return F.when(may & text.rlike(kind.pattern), placed).otherwise(none)


def _ended(text: Column, kind: Kind) -> Column:
    """As ``_proposed``, where ``kind.ends`` tells the end of every head, heads inside spans too.

    Spans do not overlap: those of a sure length go first, then the leftmost.
    """
    none = F.array().cast("array<struct<start:int,end:int,span:string,sure:boolean>>")
    head, tail = (F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(k)) for k in (0, 1))
    ended = F.zip_with(
        head,
        tail,
        lambda h, t: F.struct(F.length(h).alias("head"), kind.ends(F.concat(h, t)).alias("m")),
    )
    gaps = F.split(text, kind.pattern, -1)
    placed = F.aggregate(
        F.zip_with(gaps, ended, lambda g, e: F.struct(F.length(g).alias("gap"), e.alias("e"))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.when(x["e"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + x["gap"] + x["e"]["head"]).alias("at"),
                F.when(x["e"]["m"]["span"].isNull(), acc["out"])
                .otherwise(
                    F.concat(
                        acc["out"],
                        F.array(
                            F.struct(
                                (acc["at"] + x["gap"]).alias("start"),
                                (acc["at"] + x["gap"] + F.length(x["e"]["m"]["span"])).alias("end"),
                                x["e"]["m"]["span"].alias("span"),
                                x["e"]["m"]["sure"].alias("sure"),
                            )
                        ),
                    )
                )
                .alias("out"),
            )
        ),
    )["out"]

    def apart(spans: Column) -> Column:
        return F.aggregate(
            spans,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
                F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out"))
            ),
        )["out"]

    def chosen(spans: Column, sure: Column) -> Column:
        free = F.filter(
            spans,
            lambda s: ~s["sure"]
            & ~F.exists(sure, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        return F.array_sort(F.concat(sure, apart(free)))

    spans = _once(
        placed,
        lambda p: F.when(F.size(p) == 0, p).otherwise(
            _once(apart(F.filter(p, lambda s: s["sure"])), lambda sure: chosen(p, sure))
        ),
    )
    return F.when(text.rlike(kind.pattern), spans).otherwise(none)


def _score(text: Column, span: Column, kind: Kind) -> Column:
    """The kind's score, more beside words that name it, less beside words that explain it away."""
    score = F.lit(kind.score)
    if not (kind.raised_by or kind.lowered_by):
        return score
    first = F.greatest(span["start"] - CONTEXT, F.lit(0))
    near = F.concat(
        F.substring(text, first + 1, span["start"] - first),
        F.lit(" "),
        F.substring(text, span["end"] + 1, F.lit(CONTEXT)),
    )
    if kind.raised_by:
        score = score + F.when(near.rlike(kind.raised_by), 0.5).otherwise(0.0)
    if kind.lowered_by:
        score = score - F.when(near.rlike(kind.lowered_by), 0.3).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def _confirmed(text: Column, kind: Kind, rank: int) -> Column:
    found = _ended(text, kind) if kind.ends else _proposed(text, kind)
    kept = F.filter(found, lambda s: kind.valid(s["span"]))
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("kind"),
            s["end"].alias("end"),
            F.lit(kind.name).alias("name"),
            _score(text, s, kind).alias("score"),
        ),
    )


def _free_names(docs: DataFrame, n: int) -> list[str]:
    """Names that no column of the documents has, in upper or lower case."""
    used = {c.lower() for c in docs.columns}
    return [name for name in (f"_pii{k}" for k in range(n + len(used))) if name not in used][:n]


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add the confirmed spans of every text, sorted by start and then by kind.

    A span is ``(start, kind, end, name, score)`` in code points, end exclusive;
    ``kind`` is its rank in ``BASE + ADDED``. Spans of base kinds always stay;
    added ones stay from ``LEAST_SCORE`` on and where they overlap no base span of
    the kinds card and phone. Null and empty texts have no spans. All columns are
    kept; ``out`` replaces a column of that name.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = (*BASE, *ADDED)
    free = _free_names(docs, len(kinds))
    ranked = {free[rank]: _confirmed(body, kind, rank) for rank, kind in enumerate(kinds)}
    found = docs.withColumns(ranked)
    base = F.concat(*(F.col(n) for n in free[: len(BASE)]))
    numbers = F.concat(F.col(free[2]), F.col(free[3]))
    added = F.filter(
        F.concat(*(F.col(n) for n in free[len(BASE) :])),
        lambda s: (s["score"] >= LEAST_SCORE)
        & ~F.exists(numbers, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    spans = F.array_sort(F.concat(base, added)).cast(_SPAN)
    return found.withColumn(out, spans).drop(*ranked)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ","
    )


def mask(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace every span by ``<kind>``; overlapping spans become the first one's mark.

    Null texts stay null.
    """
    cut = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(
            s["start"] < acc["at"],
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")),
        ).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]),
                        F.concat(F.lit("<"), s["name"], F.lit(">")),
                    ),
                ).alias("out"),
            )
        ),
    )
    rest = F.substring(F.col(text), cut["at"] + 1, F.length(F.col(text)))
    masked = F.concat(F.array_join(cut["out"], ""), rest)
    return docs.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text)))
