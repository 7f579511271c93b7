"""PII by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass (at-signs, plus signs, digits, schemes and
identifier cues). From every anchor a small deterministic parser expands to the boundaries of the address, number or
account and validates it. Parsers are linear in the text: each kind keeps the end of its last match and never reads
left of it, or reads a bounded way; between a cue and its account number one word of at most 16 letters may stand.

Defined results: a null text is the empty text and has no spans; a null doc_id stays null; repeated rows each give a
row; very long texts are read whole, in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage_jobs.llm.common import row_mapper

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("userinfo", "iban", "ssn", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS
RANK = {k: i for i, k in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[\s:#-]*+(?:[A-Za-z]{1,16}+[\s:]++)?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Z0-9])")
SSN = re.compile(r"[\s:#-]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
SECRET = re.compile(r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/.~-]{8,}=*)")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
IBAN_CUES = ("IBAN", "iban", "Iban")
SSN_CUES = ("SSN", "ssn", "Social Security", "social security")
SECRET_CUES = ("api_key", "apikey", "api-key", "API_KEY", "password", "PASSWORD", "Password", "passwd", "secret_key", "SECRET_KEY", "access_token", "ACCESS_TOKEN", "auth_token", "token", "Token", "TOKEN")


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("://", SCHEMES), ("iban", IBAN_CUES), ("ssn", SSN_CUES), ("secret", SECRET_CUES)):
        for word in words:
            found.add_word(word, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    """Whether a decimal number is at most 255, whatever zeros lead it."""
    plain = digits.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def iban_end(text: str, start: int, end: int) -> int:
    """Where the account number that starts at ``start`` ends, if its check digits hold; else -1."""
    while end - start >= 15:
        plain = text[start:end].replace(" ", "")
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
        cut = text.rfind(" ", start, end)
        if cut < 0:
            break
        end = cut
    return -1


def dotted_quads(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Leftmost runs of four dotted numbers in a run of digits and dots."""
    run: list[tuple[int, int]] = []
    at = start
    for part in text[start:end].split("."):
        stop = at + len(part)
        if part:
            run.append((at, stop))
            if len(run) == 4:
                yield run[0][0], stop
                run = []
        else:
            run = []
        at = stop + 1


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text in code points, by start and then by the order of KINDS."""
    out: list[tuple[int, int, str]] = []
    if not text:
        return out
    mail = ip = card = phone = 0
    for at, kind in automaton().iter(text):
        if kind == "0":
            if at >= ip:
                ip = DOTTED.match(text, at).end()
                if ip - at >= 7:
                    for s, e in dotted_quads(text, at, ip):
                        if all(at_most_255(p) for p in text[s:e].split(".")):
                            out.append((s, e, "ip"))
            if at >= card:
                found = CARD.match(text, at)
                card = found.end() if found else at + 1
                if found and card - at >= 12:
                    digits = re.sub("[ -]", "", found[0])
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, card, "card"))
        elif kind == "@":
            start = at
            while start > mail and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (found := DOMAIN.match(text, at + 1)):
                mail = found.end()
                out.append((start, mail, "email"))
        elif kind == "+":
            if at >= phone and (found := PHONE.match(text, at)):
                phone = found.end()
                if 9 <= sum("0" <= c <= "9" for c in found[0]) <= 15:
                    out.append((at, phone, "phone"))
        elif kind == "://":
            if found := USERINFO.match(text, at + 1):
                out.append((at + 1, found.end(), "userinfo"))
        elif kind == "iban":
            if (found := IBAN.match(text, at + 1)) and (end := iban_end(text, found.start(1), found.end(1))) > 0:
                out.append((found.start(1), end, "iban"))
        elif kind == "ssn":
            if found := SSN.match(text, at + 1):
                out.append((found.start(1), found.end(1), "ssn"))
        elif found := SECRET.match(text, at + 1):
            out.append((found.start(1), found.end(1), "secret"))
    return sorted(set(out), key=lambda s: (s[0], RANK[s[2]], s[1]))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in find_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", SPAN)])
    work = row_mapper(["doc_id", "text"], schema, lambda i, t: (i, [{"kind": k, "start": s, "end": e} for s, e, k in find_spans(t)]))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, in the same columns, with personal data replaced in ``text`` and n_chars brought up to date."""
    kinds = docs.select("text").schema
    clean = F.pandas_udf(lambda s: s.map(redact, na_action="ignore"), kinds[0].dataType)
    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pii_digest(docs: DataFrame) -> DataFrame:
    """The digest of pii_spans that query op6_pii returns."""
    spans = F.col("spans")
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    base_text = F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return pii_spans(docs).select("doc_id", *counts[:4], F.sha2(base_text.cast("binary"), 256).alias("base_sha256"), F.array_join(text, ",").alias("spans"), *counts[4:])
