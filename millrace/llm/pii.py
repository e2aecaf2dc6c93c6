"""Personal data by anchor expansion: one Aho-Corasick pass finds anchors, local parsers expand and validate them.

Anchors are at-signs, plus signs, digits, address schemes and identifier cues.  Base kinds (email, ip, card, phone) are
the leftmost non-overlapping matches of their patterns; a match that fails its check is dropped without another try.
The added kinds are ``url`` (scheme to the end of the address), ``account`` (an identifier after a cue word, or an
IBAN with valid check digits), ``street`` (a number next to a street word) and ``secret`` (the value set after a word for
tokens, keys and passwords: in quotes as it stands, otherwise if it is long and mixed enough to be random).
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "url", "account", "street", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}

# Schemes, cue words and street words.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "iban", "konto", "cuenta", "compte", "customer no", "user id", "passport")
SECRETS = ("token", "secret", "password", "passwd", "passphrase", "api key", "api_key", "apikey", "access key", "access_key", "private key", "private_key", "bearer")
STREETS = ("street", "avenue", "road", "boulevard", "lane", "straße", "strasse", "platz", "calle", "avenida", "rue")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|]+")
_ACCOUNT = re.compile(r"(?: (?:no|nr|num|number)\b)?[\s:#.=-]{0,4}((?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){2,8})|(?=[A-Z0-9-]*[0-9])[A-Z0-9][A-Z0-9-]{4,33})")
_ASSIGNED = re.compile(r"[\"']?[ \t]{0,3}(?:[:=]|=>|:=)[ \t]{0,3}")
_QUOTED = re.compile(r"([\"'`])([^\"'`\s]{6,})\1")
_BARE = re.compile(r"[A-Za-z0-9+/_.~-]{8,}={0,2}")
_NUMBER = re.compile(r"[ ,]{1,2}([0-9]{1,5}[a-z]?)\b")
_BEFORE = re.compile(r"(?<![A-Za-z0-9])([0-9]{1,5}[a-z]?)[ ,]{1,2}(?:[^\W\d][\w.]* ){0,3}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for c in "0123456789":
        auto.add_word(c, ("digit", 1))
    auto.add_word("@", ("at", 1))
    auto.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES), ("street", STREETS), ("secret", SECRETS)):
        for w in words:
            for form in {w, w.upper(), w.capitalize(), w.title()}:
                auto.add_word(form, (kind, len(form)))
    auto.make_automaton()
    return auto


def _random(value: str) -> bool:
    """Whether a value without quotes looks drawn at random: digits and letters mixed, and few characters again and again."""
    digits = sum(c.isdigit() for c in value)
    return digits >= 2 and digits < len(value) and len(set(value)) >= min(8, len(value) // 2)


def _secret(text: str, at: int):
    """(start, end) of the value that is set at this place."""
    m = _ASSIGNED.match(text, at)
    if not m:
        return None
    if q := _QUOTED.match(text, m.end()):
        return q.span(2)
    b = _BARE.match(text, m.end())
    return b.span() if b and _random(b[0]) else None


def _email(text: str, at: int, floor: int):
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    m = start < at and _DOMAIN.match(text, at + 1)
    return (start, m.end()) if m else None


def spans(text: str | None, auto: ahocorasick.Automaton | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start, then kind as in ``KINDS``.  Null is an empty text."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = street_end = secret_end = 0
    last_digit = -2
    for stop, (what, size) in (auto or _automaton()).iter(text):
        at = stop - size + 1
        if what == "digit":
            first, last_digit = at != last_digit + 1, at
            # a run of digits is tried at its first digit, or where the match before it ended
            if at >= ip_end and (first or at == ip_end):
                m = _IP.match(text, at)
                if m:
                    ip_end = m.end()
                    if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                        found.append(("ip", at, ip_end))
            if at >= card_end and (first or at == card_end):
                m = _CARD.match(text, at)
                if m:
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", at, card_end))
        elif what == "at":
            if at >= email_end and (span := _email(text, at, email_end)):
                found.append(("email", *span))
                email_end = span[1]
        elif what == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", at, phone_end))
        elif what == "scheme":
            if at >= url_end and (m := _URL.match(text, stop + 1)):
                end = m.end()
                while end > stop + 1 and text[end - 1] in ".,;:!?)]}*&%$#":
                    end -= 1
                if end > stop + 1:
                    found.append(("url", at, end))
                    url_end = end
        elif what == "cue":
            if at >= account_end and (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, stop + 1)):
                value = m[1].rstrip("-")
                if iban_ok(value) or (" " not in value and sum(c.isdigit() for c in value) >= 5):
                    found.append(("account", m.start(1), m.start(1) + len(value)))
                    account_end = m.start(1) + len(value)
        elif what == "secret":
            if at >= secret_end and (at == 0 or not text[at - 1].isalnum()) and (span := _secret(text, stop + 1)):
                found.append(("secret", *span))
                secret_end = span[1]
        elif at >= street_end and (stop + 1 == len(text) or not text[stop + 1].isalnum()):
            if m := _NUMBER.match(text, stop + 1):
                found.append(("street", at, m.end(1)))
                street_end = m.end(1)
            elif (at == 0 or not text[at - 1].isalnum()) and (m := _BEFORE.search(text, max(street_end, at - 60), at)):
                found.append(("street", m.start(1), stop + 1))
                street_end = stop + 1
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): per row an array of (kind, start, end), empty where there are none.

    Every row is read on its own and whole, repeated rows and null keys too; null and empty texts have no spans; spans that
    start together are ordered as in ``KINDS``.  An empty table gives none; other columns play no part.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("found", T.ArrayType(span))])

    def run(batches):
        auto = _automaton()
        for pdf in batches:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, auto)] for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "found": pd.Series(rows, dtype=object)})

    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, schema)
    return found.select(F.col("k").alias(key), F.col("found").alias("spans"))


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", out: str = "redacted") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, in ``out``, which replaces a column of that name; overlapping
    spans are merged.  A null text stays null; all rows stay."""
    schema = docs.drop(out).withColumn(out, F.lit(None).cast("string")).schema

    def run(batches):
        auto = _automaton()
        for pdf in batches:
            made = []
            for t in pdf[text]:
                parts, at = [], 0
                for kind, a, b in spans(t, auto):
                    if a >= at:
                        parts += [t[at:a], f"[{kind}]"]
                    at = max(at, b)
                made.append(None if t is None else "".join(parts) + t[at:])
            yield pdf.assign(**{out: made})

    return docs.drop(out).mapInPandas(run, schema)


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``find``, counts, the digest of the base kinds, all spans as text, their number and the added kinds' counts."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform(F.filter("found", lambda s: s["kind"].isin(*KINDS[:4])), name)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = find(docs, key=key, text=text)
    return rows.select(F.col(key).alias("k"), F.col("spans").alias("found")).select(
        F.col("k").alias(key), *[count(k) for k in KINDS[:4]], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", name), ",").alias("spans"), F.size("found").cast("long").alias("n_spans"), *[count(k) for k in KINDS[4:]],
    )
