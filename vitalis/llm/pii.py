"""Personal data in texts: regular expressions propose spans, checksums confirm
them, words nearby adjust the score. DataFrame functions only.

Base kinds (always reported when they pass their check): email; ip (four parts
of at most 255); card (16 to 19 digits passing Luhn); phone (8 to 15 digits).
Added kinds, reported from a score of ``THRESHOLD`` on: iban (mod-97), card_short
(13 to 15 digits passing Luhn), ssn (area, group and serial that are issued).

The published patterns are run in an equivalent form in which no run of
characters is tried twice: a match can only start where the run of its first
character class starts (or where the last match ended), and repeated groups are
possessive, which they may be because what follows them is not in them.
Offsets come from the lengths of the pieces between matches and of the matches.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
NEAR = 48  # characters of context looked at on either side

#: kind -> (pattern, cheaper pattern found in any text that holds a valid match)
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
ADDED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "card_short": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])", r"[0-9](?:[ -]?[0-9]){12}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
#: Score without context and words (lower case) that raise it by 0.3.
SCORES = {
    "email": (0.9, ["mail", "contact", "write to"]), "ip": (0.7, ["ip", "server", "host", "address"]),
    "card": (0.8, ["card", "visa", "mastercard", "credit", "payment"]),
    "phone": (0.7, ["phone", "call", "tel", "mobile", "fax"]),
    "iban": (0.9, ["iban", "account", "bank", "konto"]),
    "card_short": (0.4, ["card", "amex", "american express", "credit", "visa"]),
    "ssn": (0.4, ["ssn", "social security", "tax id"]),
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int"))
                    .otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))),
        F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return (total % 10 == 0) & (F.length(digits) > 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN's rearranged number leaves 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(
        ch == "", a).when(ch.between("0", "9"), (a * 10 + ch.cast("int")) % 97)
        .otherwise((a * 100 + F.ascii(ch) - 55) % 97))
    return (rest == 1) & F.length(plain).between(15, 34)


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | (
            (F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return n.between(16, 19) & luhn(digits)
    if kind == "card_short":
        return n.between(13, 15) & luhn(digits)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9[0-9]{2})|-00-|-0000$")
    return F.lit(True)


def _starts(pieces: Column, matches: Column) -> Column:
    """Offset of each match: lengths of all pieces and matches before it. Sums
    run over blocks of 256 first, so a text with many matches stays linear."""
    lengths = F.transform(F.arrays_zip(pieces.alias("p"), matches.alias("m")),
                          lambda z: F.struct(F.length(z["p"]).alias("p"), F.coalesce(F.length(z["m"]), F.lit(0)).alias("m")))
    n = F.size(matches)
    step = 256
    empty = F.array().cast("array<int>")

    def running(values: Column, first: Column, size) -> Column:
        """Sums before each value, ``first`` included."""
        return F.aggregate(values, F.struct(first.alias("at"), empty.alias("out")),
                           lambda acc, v: F.struct((acc["at"] + size(v)).alias("at"),
                                                   F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")),
                         lambda b: F.slice(lengths, b * step + 1, F.lit(step)))
    width = lambda v: v["p"] + v["m"]
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + width(v)))
    firsts = running(sums, F.lit(0), lambda v: v)
    starts = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), firsts.alias("f")),
                                   lambda z: F.transform(F.arrays_zip(z["b"].alias("v"), running(z["b"], z["f"], width).alias("s")),
                                                         lambda y: y["s"] + y["v"]["p"])))
    return F.when(n > 0, starts).otherwise(empty)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_of(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, score) of one kind, checked and scored."""
    pattern, hint = (BASE | ADDED)[kind]
    base, words = SCORES[kind]
    some = text.rlike(hint)
    # One array of matches and the pieces around them (one more).
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def found(z: Column) -> Column:
        starts = _starts(z["p"], z["m"])
        rows = F.arrays_zip(z["m"].alias("m"), starts.alias("s"), z["p"].alias("b"),
                            F.slice(z["p"], 2, F.size(z["m"])).alias("a"))
        rows = F.slice(rows, 1, F.size(z["m"]))

        def span(r: Column) -> Column:
            around = F.lower(F.concat(F.substring(r["b"], -NEAR, NEAR), F.lit(" "), F.substring(r["a"], 1, NEAR)))
            hit = around.rlike(r"(?:^|[^a-z])(?:" + "|".join(words) + ")")
            return F.struct(F.lit(kind).alias("kind"), r["s"].alias("start"), (r["s"] + F.length(r["m"])).alias("end"),
                            F.least(F.lit(1.0), F.lit(base) + F.when(hit, 0.3).otherwise(0.0)).alias("score"))

        return F.transform(F.filter(rows, lambda r: _valid(kind, r["m"])), span)

    # A one-element array binds the regular expressions' results once.
    out = F.flatten(F.transform(F.array(both), found))
    out = out.cast(SPAN)
    if kind in ADDED:
        out = F.filter(out, lambda s: s["score"] >= THRESHOLD)
    return F.when(some, out).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: doc_id) plus one array of spans a kind, named
    pii_<kind>: (kind, start, end, score), offsets in code points, end exclusive.
    A null or empty text has no spans; repeated rows are rows of their own."""
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, *[spans_of(text, k).alias(f"pii_{k}") for k in BASE | ADDED])


def joined(*arrays: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(F.concat(*arrays), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
