"""Answer text: normalisation, decline phrases, timestamps and hash shapes."""

import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases that count as declining to answer.
DECLINES = (
    "i do not know", "i don't know", "i cannot answer", "i can't answer",
    "i cannot answer this question", "i can't answer this question",
    "i cannot determine the answer", "i am unable to answer",
    "there is not enough information to say", "there is insufficient information",
    "not enough information", "insufficient information",
    "that information was not provided", "the information was not provided",
    "the requested information was not provided", "unknown",
)

_ASCII = r"^[\x00-\x7F]*$"
_ASCII_SPACE = r"[\t-\r\x1c-\x20]+"


@F.pandas_udf(T.StringType())
def _unicode_fold(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda text: " ".join(unicodedata.normalize("NFKC", text).casefold().split()),
        na_action="ignore")


@F.pandas_udf(T.StringType())
def _unicode_fold_all(lists: pd.Series) -> pd.Series:
    # Lists cross as JSON text: Arrow moves plain strings far faster than nested lists.
    return lists.map(lambda text: json.dumps([
        " ".join(unicodedata.normalize("NFKC", item or "").casefold().split())
        for item in json.loads(text)]), na_action="ignore")


def _plain(text):
    return F.trim(F.regexp_replace(F.lower(text), _ASCII_SPACE, " "))


def is_ascii(text):
    return F.coalesce(text, F.lit("")).rlike(_ASCII)


def normalize(text, ascii_only=False):
    """NFKC, case folding and single spaces; NULL reads as the empty string.

    ASCII rows never leave the JVM: the Arrow function receives NULL for them.  A caller that knows
    all rows to be ASCII leaves it out.
    """
    text = F.coalesce(text, F.lit(""))
    if ascii_only:
        return _plain(text)
    plain = text.rlike(_ASCII)
    folded = _unicode_fold(F.when(~plain, text))
    return F.when(plain, _plain(text)).otherwise(folded)


def normalize_all(texts, ascii_only=False):
    """``normalize`` over every element of an array of texts."""
    plain = F.transform(texts, lambda t: _plain(F.coalesce(t, F.lit(""))))
    if ascii_only:
        return plain
    all_ascii = F.forall(texts, is_ascii)
    folded = F.from_json(_unicode_fold_all(F.when(~all_ascii, F.to_json(texts))), "array<string>")
    return F.when(all_ascii, plain).otherwise(folded)


def is_decline(normalized):
    """Whether normalised text is one of the decline phrases, final punctuation aside."""
    return F.regexp_replace(normalized, r"[.!?]+$", "").isin(*DECLINES)


def blank(text):
    """NULL, empty or only white space, no-break and other Unicode spaces and separators included."""
    return F.coalesce(~text.rlike(r"[^\s\p{Z}\x0B\x1C-\x1F\x85]"), F.lit(True))


def is_sha256(text):
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}$"), F.lit(False))


# Dates and times in the extended or the basic ISO form; seconds may have any number of decimals.
_ISO = (r"^([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2})).([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?"
        r"(Z|[+-][0-9]{2}(?::?[0-9]{2})?)$")
# The commonest of these forms, which the JVM's parser takes as it is.
_PLAIN_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})$"


def zoned_timestamp(text):
    """Parse an ISO-8601 timestamp that names its zone; NULL for anything else.

    Minutes and seconds may be left out, and decimals beyond microseconds are cut off.
    """
    # The groups are found once and bound by a lambda, as every use of a column would search again.
    groups = F.split(F.regexp_replace(text, _ISO, "$1|$2$4|$3$5|$6|$7|$8|$9|$10"), "[|]")

    def or_zero(column):
        return F.when(column == "", "00").otherwise(column)

    def instant(g):
        year, month, day, hour, minute, second, decimals, zone = [g[i] for i in range(8)]
        offset = (F.when(zone == "Z", "+00:00").when(F.length(zone) == 3, F.concat(zone, F.lit(":00")))
                  .otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, -2, 2))))
        clock = F.concat(hour, F.lit(":"), or_zero(minute), F.lit(":"), or_zero(second), F.lit("."),
                         F.rpad(F.substring(decimals, 1, 6), 6, "0"))
        return F.try_to_timestamp(F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T"), clock, offset))
    return F.when(text.rlike(_PLAIN_ISO), F.try_to_timestamp(text)).when(text.rlike(_ISO), F.element_at(F.transform(F.array(groups), instant), 1))


def letters_only(name):
    """A field name reduced to its lower-case ASCII letters, the form secret and gold names take."""
    return F.regexp_replace(F.lower(name), "[^a-z]", "")
