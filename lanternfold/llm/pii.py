"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) have loose patterns, each followed by its check: parts
of an address at most 255, card numbers by Luhn, digit counts. What a loose pattern
swallows and the check then drops is proposed again by stricter patterns: card numbers in
groups, phone numbers in the usual layouts. Further kinds are iban (mod-97), and ssn and
national phone numbers, which count only beside a word that names them. A span's score is
that of its pattern, more if a checksum confirmed it, more beside such a word; spans below
``LEAST_SCORE`` are left out. Base spans always stay.

Positions are code points, ends exclusive. They follow from the lengths of the pieces
between matches, as the text is split by the same pattern that yields the matches. Patterns
with a repeated group or a repeated class before a fixed character do not backtrack, so
long runs of one character take time in proportion to their length.

Null and empty texts have no spans. Rows are judged one by one: repeated rows get equal
results, an empty table an empty one, and nothing is shuffled. Only the id and text columns
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfold.functions.arrays import let

LEAST_SCORE = 0.7
BEFORE, AFTER = 40, 20  # characters of context
PHONE_WORDS = r"\b(?:phone|tel|telephone|telefon|téléphone|teléfono|call|mobile|fax|cell)\b"


@dataclass(frozen=True)
class Kind:
    """A pattern with what it needs: ``hint`` is a cheap test that texts with a match pass."""

    name: str
    pattern: str
    hint: str
    check: object  # Column of a match -> Column
    score: float
    words: str
    base: bool = False
    sure: bool = False  # the check is a checksum


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    backwards = F.split(F.reverse(digits), "")
    doubled = F.transform(backwards, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1, letters read as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(
        c.between("0", "9"), (s * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise(
        (s * 100 + F.ascii(c) - 55) % 97)) == 1


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _ip(match: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

    return F.forall(F.split(match, r"\."), small)


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _iban(match: Column) -> Column:
    plain = F.replace(match, F.lit(" "), F.lit(""))
    return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)


_ALWAYS = lambda match: F.lit(True)

# In the order in which spans of equal start are listed; base kinds first.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         _ALWAYS, 0.9, r"\b(?:mail|email|e-mail|contact|write)\b", base=True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".",
         _ip, 0.7, r"\b(?:ip|host|server|address)\b", base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _card, 0.6, r"\b(?:card|visa|mastercard|credit)\b", base=True, sure=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone, 0.8, PHONE_WORDS, base=True),
    Kind("card", r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])", "",
         _card, 0.5, r"\b(?:card|visa|mastercard|credit)\b", sure=True),
    Kind("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])", "+",
         _phone, 0.7, PHONE_WORDS),
    Kind("phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "",
         _ALWAYS, 0.5, PHONE_WORDS),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "",
         _iban, 0.6, r"\b(?:iban|account|konto|compte|cuenta)\b", sure=True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", _ALWAYS, 0.5,
         r"\b(?:ssn|social security)\b"),
)
ORDER = ("email", "ip", "card", "phone", "iban", "ssn")

_SPAN = "array<struct<start:int,end:int,text:string>>"
_FOUND = "array<struct<start:int,place:int,end:int,kind:string,score:double,base:boolean>>"


def running(values: Column) -> Column:
    """Sums of an array's numbers before each place. A fold that grows an array copies it at each step, so
    sums are taken over runs of about a root of the length, and within each run."""
    def sums(some: Column, base: Column) -> Column:
        zero = F.struct(base.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(some, zero, lambda s, v: F.struct((s["at"] + v).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
                           lambda s: s["out"])

    def cut(v: Column) -> Column:
        step = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v)))).cast("int")
        starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), step)
        runs = F.transform(starts, lambda i: F.slice(v, i + 1, step))

        def whole(parts: Column) -> Column:
            totals = F.transform(parts, lambda r: F.aggregate(r, F.lit(0), lambda s, x: s + x))
            return let(sums(totals, F.lit(0)), lambda bases: F.flatten(F.transform(parts, lambda r, i: sums(r, F.get(bases, i)))))

        return let(runs, whole)

    return let(values, cut)


def matches(text: Column, kind: Kind) -> Column:
    """Start, end and text of a pattern's matches, in order."""
    def placed(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda hit, i: F.length(F.get(gaps, i)) + F.length(hit))
        return let(running(steps), lambda before: F.transform(found, lambda hit, i: let(
            F.get(before, i) + F.length(F.get(gaps, i)),
            lambda start: F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("text")))))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    spans = let(found, lambda hits: F.when(
        F.size(hits) > 0, let(F.split(text, kind.pattern, -1), lambda gaps: placed(hits, gaps))).otherwise(F.array().cast(_SPAN)))
    may = F.contains(text, F.lit(kind.hint)) if kind.hint else F.lit(True)
    return F.when(may, spans).otherwise(F.array().cast(_SPAN))


def _scored(text: Column, spans: Column, kind: Kind) -> Column:
    """Confirmed spans with their scores."""
    def score(span: Column, wide: Column) -> Column:
        first = F.greatest(span["start"] - BEFORE, F.lit(0))
        near = F.decode(F.substring(wide, 4 * first + 1, 4 * (span["end"] - first + AFTER)), "UTF-32")
        points = F.lit(kind.score + (0.3 if kind.sure else 0.0)) + F.when(
            F.lower(near).rlike(kind.words), 0.2).otherwise(0.0)
        return F.struct(
            span["start"].alias("start"), F.lit(ORDER.index(kind.name)).alias("place"), span["end"].alias("end"),
            F.lit(kind.name).alias("kind"), F.least(points, F.lit(1.0)).alias("score"), F.lit(kind.base).alias("base"))

    # four bytes a character, so that a context is cut out at its place without a walk through the text
    sure = F.filter(spans, lambda s: kind.check(s["text"]))
    scored = let(sure, lambda some: F.when(F.size(some) > 0, let(
        F.encode(text, "UTF-32"), lambda wide: F.transform(some, lambda s: score(s, wide)))).otherwise(F.array().cast(_FOUND)))
    return scored if kind.base else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)


STRETCH = 512  # characters


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. Both come by start. The others are dealt to stretches of text;
    a span is compared with those of the stretches it touches."""
    def looked_up(taken: Column) -> Column:
        def stretch(at: Column) -> Column:
            return F.floor(at / STRETCH).cast("int")

        each = F.flatten(F.transform(taken, lambda o: F.transform(
            F.sequence(stretch(o["start"]), stretch(o["end"] - 1)),
            lambda b: F.struct(b.alias("b"), o["start"].alias("start"), o["end"].alias("end")))))

        def by_stretch(places: Column) -> Column:
            # places come by stretch; where a stretch's own begin is where the number before differs
            firsts = F.filter(F.transform(places, lambda p, i: F.when(
                (i == 0) | (F.get(places, i - 1)["b"] != p["b"]), F.struct(p["b"].alias("b"), i.alias("i")))), lambda x: x.isNotNull())

            def table(heads: Column) -> Column:
                ends = F.transform(heads, lambda h, j: F.coalesce(F.get(heads, j + 1)["i"], F.size(places)))
                held = F.transform(heads, lambda h, j: F.slice(places, h["i"] + 1, F.get(ends, j) - h["i"]))
                return F.map_from_arrays(F.transform(heads, lambda h: h["b"]), held)

            def free(known: Column) -> Column:
                return F.filter(spans, lambda s: ~F.exists(
                    F.sequence(stretch(s["start"]), stretch(s["end"] - 1)), lambda b: F.exists(
                        F.coalesce(F.element_at(known, b), F.array().cast("array<struct<b:int,start:int,end:int>>")),
                        lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))))

            return let(firsts, lambda heads: let(table(heads), free))

        return let(F.array_sort(each), by_stretch)

    return let(others, lambda taken: F.when(F.size(taken) > 0, looked_up(taken)).otherwise(spans))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: start, place (of the kind), end, kind, score and base of each span,
    by start and kind. Added spans never overlap one of their kind that came before."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    step = step.withColumns({f"m{i}": matches(F.col("text"), kind) for i, kind in enumerate(KINDS)})
    step = step.withColumns({f"s{i}": _scored(F.col("text"), F.col(f"m{i}"), kind) for i, kind in enumerate(KINDS)})
    found = F.concat(*[F.col(f"s{i}") for i, kind in enumerate(KINDS) if kind.base])
    for i, kind in enumerate(KINDS):
        if kind.base:
            continue
        step = step.withColumn("found", found)
        found = F.concat("found", F.when(F.size(f"s{i}") > 0, _apart(F.col(f"s{i}"), F.filter(
            "found", lambda o: o["kind"] == kind.name))).otherwise(F.array().cast(_FOUND)))  # noqa: B023
    return step.select("doc_id", F.array_sort(found).alias("found"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def summarise(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    base = found.withColumn("base", F.filter("found", lambda s: s["base"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": count(kind) for kind in ORDER[:4]}
    return base.withColumns(counts).select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
