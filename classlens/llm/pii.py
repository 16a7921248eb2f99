"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Each kind has one pattern. Its matches, from left to right and without overlap, are the proposals; the texts between
them give their places and the words around them. A proposal that the kind's own rule admits (e-mail and IP addresses,
cards of 16 to 19 digits that pass Luhn, international phone numbers) always stays. The others, which are weaker
forms, have a prior score; a checksum (Luhn, or mod-97 for account numbers) confirms or ends them, a word nearby that
names the kind raises the score, one that names something else lowers it, and ``KEEP`` decides. All of it
is a projection of column expressions: one pass over a text per kind, nothing is shuffled.

Patterns are possessive or begin at the start of a run of their characters, so that no text makes them slow: what follows
a run decides for all of its starting points alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores are in tenths. A checksum that holds adds CONFIRMED, a nearby word adds or takes CONTEXT.
KEEP, CONFIRMED, CONTEXT = 6, 4, 3
#: Code points before and after a proposal in which words count, up to the next proposal of the same kind.
BEFORE, AFTER = 48, 24
#: Prefix sums over the matches of a text are made in blocks of this many.
BLOCK = 128

# Length of an international bank account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Words that speak against a proposal.
OTHER = "order|invoice|tracking|serial|isbn|article|version|bestellung|rechnung|commande|facture|pedido|factura"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _n_digits(m: Column, low: int, high: int) -> Column:
    return F.char_length(_digits(m)).between(low, high)


def luhn(number: Column) -> Column:
    """Whether the digits of a number (other characters are skipped) pass the Luhn check."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            digit = F.substring(d, i, F.lit(1)).cast("int")
            twice = (F.char_length(d) - i) % 2 == 1
            return acc + F.when(twice, 2 * digit - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), add) % 10 == 0

    return _let(_digits(number), lambda d: F.when(d == "", F.lit(False)).otherwise(total(d)))


def mod_97(account: Column) -> Column:
    """Whether an account number of letters and digits leaves 1 modulo 97 with its first four characters moved last."""

    def total(m: Column) -> Column:
        moved = F.concat(F.substr(m, F.lit(5)), F.left(m, F.lit(4)))

        def add(acc: Column, i: Column) -> Column:
            code = F.ascii(F.substring(moved, i, F.lit(1)))
            return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

        return F.aggregate(F.sequence(F.lit(1), F.char_length(m)), F.lit(0), add) == 1

    return _let(F.replace(account, F.lit(" "), F.lit("")), lambda m: F.when(F.char_length(m) > 4, total(m)).otherwise(F.lit(False)))


def _octets(m: Column) -> Column:
    """Whether every part between dots is at most 255, leading zeros aside."""

    def small(x: Column) -> Column:
        return _let(F.ltrim(x, F.lit("0")), lambda y: (F.char_length(y) < 3) | ((F.char_length(y) == 3) & (y <= "255")))

    return F.forall(F.split(m, r"\."), small)


def _iban(m: Column) -> Column:
    """The part of a proposal that has its country's length; null if it is shorter or the country is unknown."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    wanted = F.try_element_at(lengths, F.left(m, F.lit(2)))
    upto = lambda i: F.char_length(F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit("")))
    ends = F.filter(F.sequence(F.lit(1), F.char_length(m)), lambda i: upto(i) == wanted)
    return F.substring(m, F.lit(1), F.get(ends, 0))


def _number_rules(m: Column) -> Column:
    return ~m.rlike(r"^(?:000|666|9)|-00-|-0000")


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``base`` admits a proposal for good; ``weak`` says which others are judged by score, from ``prior`` on;
    ``confirmed`` is the checksum that those need, if there is one. ``part`` is what of a match is proposed.
    """

    name: str
    pattern: str
    words: str
    base: Callable[[Column], Column] | None = None
    weak: Callable[[Column], Column] | None = None
    confirmed: Callable[[Column], Column] | None = None
    prior: int = 0
    needs: str = ""
    part: Callable[[Column], Column] | None = None


KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "mail|email|contact|write|courriel|correo|kontakt",
        base=lambda m: F.lit(True),
        prior=6,
        needs="@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "ip|host|server|address|adresse|login|client",
        base=_octets,
        prior=5,
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
        "card|credit|debit|visa|mastercard|amex|carte|karte|tarjeta|kreditkarte",
        base=lambda m: _n_digits(m, 16, 19) & luhn(m),
        weak=lambda m: _n_digits(m, 13, 15),
        confirmed=luhn,
        prior=1,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
        "phone|tel|telephone|call|fax|mobile|cell|telefon|telefono|handy|appel",
        base=lambda m: m.startswith("+") & _n_digits(m, 8, 15),
        weak=lambda m: ~m.startswith("+"),
        prior=4,
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
        "iban|account|bank|konto|compte|cuenta|bic|swift",
        weak=lambda m: F.lit(True),
        confirmed=mod_97,
        prior=3,
        part=_iban,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "ssn|social|security|taxpayer",
        weak=_number_rules,
        prior=4,
    ),
]


def _named(words: str) -> str:
    return rf"(?i)(?:^|[^A-Za-z0-9])(?:{words})(?:[^A-Za-z0-9]|\z)"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _starts(lengths: Column, gaps: Column) -> Column:
    """Where each match begins: the lengths before it, summed in blocks, and the gap before it."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, BLOCK)))

    def start(gap: Column, i: Column, sums: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        return _sum(F.slice(sums, F.lit(1), b)) + _sum(F.slice(lengths, b * BLOCK + 1, i % BLOCK)) + gap

    return _let(blocks, lambda sums: F.transform(gaps, lambda gap, i: start(gap, i, sums)))


def _judged(kind: Kind, m: Column, start: Column, before: Column, after: Column) -> Column:
    near = F.concat_ws("\n", F.right(before, F.lit(BEFORE)), F.left(after, F.lit(AFTER)))
    score = F.lit(kind.prior)
    score += F.when(near.rlike(_named(kind.words)), CONTEXT).otherwise(0) - F.when(near.rlike(_named(OTHER)), CONTEXT).otherwise(0)
    score += CONFIRMED if kind.confirmed else 0
    base = kind.base(m) if kind.base else F.lit(False)
    weak = F.lit(False)
    if kind.weak:
        apart = ~before.rlike(r"[A-Za-z0-9]\z") & ~after.rlike(r"^[A-Za-z0-9]") & ((before != "") | (start == 0))
        weak = kind.weak(m) & apart & (score >= KEEP)
        weak &= kind.confirmed(m) if kind.confirmed else F.lit(True)
    return F.struct(
        F.lit(kind.name).alias("kind"),
        start.alias("start"),
        (start + F.char_length(m)).alias("end"),
        score.alias("score"),
        base.alias("base"),
        (base | weak).alias("kept"),
    )


def _spans(kind: Kind, text: Column) -> Column:
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:int,base:boolean,kept:boolean>>")

    def proposals(found: Column, pieces: Column) -> Column:
        def judged(m: Column, i: Column, starts: Column) -> Column:
            before, after, start = F.get(pieces, i), F.get(pieces, i + 1), F.get(starts, i)
            if not kind.part:
                return _judged(kind, m, start, before, after)
            part = kind.part(m)
            rest = lambda p: F.concat(F.substr(m, F.char_length(p) + 1), after)
            return _let(part, lambda p: F.when(p.isNotNull(), _judged(kind, p, start, before, rest(p))))

        def placed(gaps: Column) -> Column:
            return _let(F.transform(found, lambda m, i: F.char_length(m) + F.get(gaps, i)), lambda x: _starts(x, gaps))

        def kept(starts: Column) -> Column:
            return F.filter(F.transform(found, lambda m, i: judged(m, i, starts)), lambda s: s["kept"])

        gaps = F.transform(F.slice(pieces, F.lit(1), F.size(found)), F.char_length)
        return _let(_let(gaps, placed), kept)

    def some(found: Column) -> Column:
        return F.when(F.size(found) > 0, _let(F.split(text, kind.pattern, -1), lambda p: proposals(found, p))).otherwise(none)

    spans = _let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), some)
    return F.when(text.contains(kind.needs), spans).otherwise(none) if kind.needs else spans


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: list[Kind] | None = None) -> DataFrame:
    """``(key, spans)`` per row: ``(kind, start, end, score, base)`` of each span, by kind, then start.

    Places are code points, ends are exclusive, scores are tenths; ``base`` marks what stays whatever its score. The
    matches of one kind do not overlap; those of different kinds may. A null or empty text has no span. Every row is
    judged by itself: repeated rows and keys give equal rows, a null key stays null. Other columns are ignored.
    Empty in, empty out.
    """
    chosen = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    each = [_spans(kind, F.col("_text")) for kind in (KINDS if kinds is None else kinds)]
    return chosen.select(f"`{key}`", F.transform(F.concat(*each), lambda s: s.dropFields("kept")).alias("spans"))


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, place), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", place), ",").alias("spans"),
    )
