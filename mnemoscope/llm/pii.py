"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only built-in expressions.  Spark gives matches but not where they are; the text between the matches gives
the places: a match begins after all earlier gaps and matches.  Patterns are written so that the matcher
never tries the same characters again, however long a run of letters, digits or blanks is.
"""

from pyspark.sql import functions as F

from mnemoscope.llm.frames import packed, unpacked

# Possessive forms of the base patterns; the looks behind only skip starts that must fail like the first.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}+"

# Where an account number can begin; the longest has 34 characters with a blank before each of the last 30.
ACCOUNT_BEGINS = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:[ ]?[A-Z0-9]){11})"
ACCOUNT_WIDTH = 64 + 1

# Fixed order of the kinds in digests.
KINDS = ("email", "ip", "card", "phone", "iban")
# What each pattern and its checks are worth before the neighbourhood is read.
BASE_SCORE = {"email": 0.85, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
CONTEXT = {
    "email": r"mail|contact|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|address|adresse|dirección",
    "card": r"card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|mobile|call|fax|handy|móvil",
    "iban": r"iban|account|bank|konto|compte|cuenta",
}
DOUBT = r"version|release|isbn|build|serial|order|invoice|example|test"
WINDOW = 40  # code points before a span that are read for context words


def matches(text, pattern, possible):
    """All leftmost matches as an array of (start, end, value) in code points, end exclusive."""
    found = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    pieces = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda value, gap: F.struct(
        value.alias("value"), F.char_length(gap).cast("bigint").alias("gap"), F.char_length(value).cast("bigint").alias("len")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("spans"))
    return F.aggregate(pieces, start, lambda s, p: F.struct(
        (s.at + p.gap + p.len).alias("at"),
        F.concat(s.spans, F.array(F.struct((s.at + p.gap).alias("start"), (s.at + p.gap + p.len).alias("end"),
                                           p.value.alias("value")))).alias("spans")), lambda s: s.spans)


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits):
    """Whether a string of digits passes the Luhn check: every second digit from the right counts twice."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)
    return F.aggregate(places, F.lit(0), lambda total, i: total + _luhn_value(
        F.substring(digits, i, F.lit(1)).cast("int"), F.pmod(n - i, F.lit(2)) == 1)) % 10 == 0


def _luhn_value(digit, doubled):
    twice = digit * 2
    return F.when(doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)


def mod97(account):
    """Whether an account number passes the mod-97 check: moved to the end, its first four characters
    make the whole, read as a number with letters from 10 on, leave 1."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(
        c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).when(
        c == "", rest).otherwise((rest * 100 + F.ascii(c) - 55) % 97)) == 1


def _stands_alone(text, span):
    """Whether neither a letter nor a digit of ASCII touches a span."""
    before = F.when(span.start > 0, F.substring(text, span.start.cast("int"), F.lit(1))).otherwise("")
    after = F.substring(text, span.end.cast("int") + 1, F.lit(1))
    return ~F.concat(before, after).rlike("[A-Za-z0-9]")


def account_spans(text):
    """Account numbers of a text column: array of (start, end, value), value without what follows the number.

    Every place where one can begin is tried by itself.  Of what the pattern takes from there, the longest
    part that ends with a group, has 15 to 34 letters and digits and passes mod-97 is the number; capitals
    or digits after a blank do not belong to it.  Numbers do not overlap: the one that begins first stays.
    """
    begins = matches(text, ACCOUNT_BEGINS, F.lit(True))

    def longest(s):
        rest = F.substring(text, s.start.cast("int") + 1, F.lit(ACCOUNT_WIDTH))
        groups = F.split(F.regexp_extract(rest, "^" + IBAN, 0), " ")
        parts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.struct(
            s.start.alias("start"), (s.start + F.char_length(F.array_join(F.slice(groups, 1, i), " "))).alias("end"),
            F.array_join(F.slice(groups, 1, i), " ").alias("value")))
        fits = F.filter(parts, lambda p: F.char_length(F.regexp_replace(p.value, " ", "")).between(15, 34)
                        & _stands_alone(text, p) & mod97(p.value))
        return F.slice(F.reverse(fits), 1, 1)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    found = F.aggregate(F.flatten(F.transform(begins, longest)), none, lambda kept, p: F.when(
        (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)).end > p.start), kept).otherwise(F.concat(kept, F.array(p))))
    return F.when(text.rlike(ACCOUNT_BEGINS), found).otherwise(none)


def _scored(text, spans, kind):
    """Spans of one kind with a score: words before a span raise or lower it."""
    def one(s):
        before = F.lower(F.substring(text, F.greatest(s.start - WINDOW, F.lit(0)).cast("int") + 1,
                                     F.least(s.start, F.lit(WINDOW)).cast("int")))
        score = (F.lit(BASE_SCORE[kind]) + F.when(before.rlike(CONTEXT[kind]), 0.15).otherwise(0.0)
                 - F.when(before.rlike(DOUBT), 0.2).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"),
                        F.round(F.least(score, F.lit(1.0)), 2).alias("score"))
    return F.transform(spans, one)


def base_spans(text):
    """{kind: array of (start, end, value)} of the confirmed base spans of a text column."""
    has_digit = text.rlike("[0-9]")
    emails = matches(text, EMAIL, F.contains(text, F.lit("@")))
    ips = F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: F.forall(
        F.split(s.value, r"\."), _at_most_255))
    cards = F.filter(matches(text, CARD, has_digit), lambda s: F.length(_digits(s.value)).between(16, 19) & luhn(_digits(s.value)))
    phones = F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s.value)).between(8, 15))
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


def _at_most_255(part):
    """Whether a part of an address of any length, leading zeros included, is at most 255."""
    plain = F.ltrim(part, F.lit("0"))
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def find(docs, text="text"):
    """Add ``base_spans`` and ``pii_spans``: arrays of (kind, start, end, score), by kind, then start.

    Base spans are leftmost non-overlapping matches of each kind that pass the kind's check; pii_spans also
    hold account numbers that pass mod-97.  Kinds may overlap each other.  Positions are code points of the
    whole text.  A null or empty text has none.  All rows and other columns stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = base_spans(whole)
    accounts = account_spans(whole)
    first = F.concat(*[_scored(whole, spans, kind) for kind, spans in base.items()])
    rows = packed(docs, _base=first, _more=_scored(whole, accounts, "iban"))
    return unpacked(rows, docs.columns, base_spans=F.col("_base"), pii_spans=F.concat("_base", "_more"))


def redact(docs, text="text", least=0.5):
    """Add ``redacted``: the text with every span of at least this score replaced by its kind in brackets.

    Of overlapping spans the one that begins first is replaced as far as it reaches, then the others' rest.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    chosen = F.array_sort(F.transform(F.filter("pii_spans", lambda s: s.score >= least),
                                      lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(chosen, start, lambda s, p: F.when(p.end <= s.at, s).otherwise(F.struct(
        p.end.alias("at"), F.concat(s.out, F.substring(whole, s.at.cast("int") + 1, F.greatest(p.start - s.at, F.lit(0)).cast("int")),
                                    F.lit("["), p.kind, F.lit("]")).alias("out"))))
    found = find(docs, text)
    rows = packed(found, _text=whole, _cut=cut)
    rest = F.substring(F.col("_text"), F.col("_cut.at").cast("int") + 1, F.char_length("_text"))
    return unpacked(rows, found.columns, redacted=F.concat(F.col("_cut.out"), rest))


def listed(spans):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
