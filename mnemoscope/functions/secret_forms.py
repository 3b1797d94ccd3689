"""Secrets in any written form: masked where a text holds them in other case, width or spacing.

A judge may echo a key as the normalised answer shows it.  So a secret is searched twice: as it is in the
text as it is, and folded in the folded text (NFKC, case folding, runs of blanks as one).  Folding keeps
for every character the place of the raw text it came from, so what is masked is a span of the raw text.
All secrets are searched at once, by an Aho-Corasick automaton that a task builds once.
"""

import unicodedata

import ahocorasick
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoscope.functions.redact import MASK, mask_patterns, masked_json, text_rules

# Vowels and final consonants of Korean syllables compose with the letter before them, as marks do.
_JAMO = range(0x1161, 0x1200)


def _joins(char):
    """Whether normalisation may merge the character with the one before it."""
    if char < "\u0300":
        return False
    first = unicodedata.normalize("NFKD", char)[:1]
    return unicodedata.category(first).startswith("M") or ord(first) in _JAMO


def folded(text):
    """The folded text, and for each of its characters the span (from, to) of the raw text it stands for.

    Characters that may merge are folded together, so one span can serve several characters; blanks at
    both ends go and a run of blanks is one character with the span of the run.
    """
    out, spans = [], []
    start, n = 0, len(text)
    while start < n:
        end = start + 1
        while end < n and _joins(text[end]):
            end += 1
        for char in unicodedata.normalize("NFKC", text[start:end]).casefold():
            if not char.isspace():
                out.append(char)
                spans.append((start, end))
            elif out and out[-1] == " ":
                spans[-1] = (spans[-1][0], end)
            elif out:
                out.append(" ")
                spans.append((start, end))
        start = end
    if out and out[-1] == " ":
        out.pop()
        spans.pop()
    return "".join(out), spans


def _automaton(patterns):
    found = ahocorasick.Automaton()
    for pattern in patterns:
        found.add_word(pattern, len(pattern))
    found.make_automaton()
    return found


def merged(spans):
    """Spans in order, those that overlap as one; spans that only touch stay apart."""
    out = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


class Masker:
    """Masks secrets in all their forms.  Overlapping finds become one mask, so that no rest of a secret
    stays beside the mask of another.  Secrets of blanks only are searched as they are."""

    def __init__(self, secrets):
        raw = {secret for secret in secrets if secret}
        plain = {folded(secret)[0] for secret in raw} - {""}
        self._raw = _automaton(raw) if raw else None
        self._folded = _automaton(plain) if plain else None

    def spans(self, text):
        found = []
        if self._raw is not None:
            found += [(end + 1 - size, end + 1) for end, size in self._raw.iter(text)]
        if self._folded is not None:
            simple, places = folded(text)
            found += [(places[end + 1 - size][0], places[end][1]) for end, size in self._folded.iter(simple)]
        return merged(found)

    def __call__(self, text):
        parts, at = [], 0
        for start, end in self.spans(text):
            parts += [text[at:start], MASK]
            at = end
        return "".join(parts) + text[at:]


def _escaped(secret):
    """The pattern of a secret in ASCII text in lower case whose blanks are single."""
    return r"\Q" + secret.replace(r"\E", r"\E\\E\Q") + r"\E"


def may_hold(text, secrets):
    """Whether a text may hold a secret in some form: false only where it surely holds none.

    Text beyond ASCII, or with a backslash (in JSON an escape), is not decided here.
    """
    plain = {folded(secret)[0] for secret in secrets} - {""}
    simple = F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " ")
    held = text.rlike(r"[^\x00-\x7F]|\\")
    if plain:
        held = held | simple.rlike("|".join(_escaped(secret) for secret in sorted(plain)))
    for secret in sorted({s for s in secrets if s and not folded(s)[0]}):
        held = held | F.contains(text, F.lit(secret))
    return held


def _udf(build):
    """An Arrow function of texts; ``build`` makes the function of one text, once for each task.

    It takes series, not an iterator of them: a task gives each iterator function a Python worker of its own, while
    functions of series that mask several columns share one.
    """
    made = []

    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(build())
        return texts.map(made[0], na_action="ignore")
    return apply


def mask_forms(text, secrets):
    """Mask secrets in any form, and credential patterns, in a column of plain text; NULL stays NULL.

    Rows that surely hold no secret stay in the JVM.
    """
    secrets = sorted({secret for secret in secrets if secret})
    if secrets:
        suspicious = may_hold(text, secrets)
        masked = _udf(lambda: Masker(secrets))(F.when(suspicious, text))
        text = F.when(suspicious, masked).otherwise(text)
    return mask_patterns(text)


def mask_judge_output(text, secrets):
    """Mask judge output, a column of JSON text: secrets in any form in values and in property names,
    values of secret names, pairs and credential patterns, at any depth.

    Output that is no JSON is masked as plain text: nothing passes unread.  Property names that become equal
    keep the last value.  NULL stays NULL.  Every row is parsed and written anew, so blanks between tokens go.
    """
    secrets = sorted({secret for secret in secrets if secret})

    def build():
        rules = text_rules(Masker(secrets))

        def one(output):
            document = masked_json(output, rules, mask_names=True)
            return rules(output) if document is None else document
        return one
    return _udf(build)(text)
