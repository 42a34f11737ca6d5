"""Personal data in texts: patterns propose spans, checksums confirm, context adjusts.

Base kinds (email, ip, card, phone) follow fixed patterns and are always kept, with score 1.
Further kinds are proposals with a prior score, which a checksum or form that holds raises
and words nearby raise or lower; those that reach the threshold stay. An IBAN must pass
mod-97; at its country's length that is enough, at another length words nearby must speak
for it. A national phone or social-security number needs such words, and loses score where
words before it speak against it (order or invoice numbers). Secrets are named tokens.

Every scanner runs in time linear in the text: a run that fails is skipped whole (an IBAN's
is tried at each word's end first, a fixed number, and from each further start in it).
Texts are handled whole, very long ones too. Null and empty texts: no spans. Empty tables
give empty results; repeated rows are handled each by itself; other columns are passed
through. Columns that find_pii() adds replace others of their names; stage() adds none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, quoted

#: The kinds in the order in which spans that start together are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_phone", "ssn", "secret")
THRESHOLD = 0.5
#: Prior score and the words within WINDOW characters that raise or lower it.
WINDOW = 48
CONTEXT = {
    "iban": (-0.1, re.compile(r"\b(?:iban|account|konto|compte|cuenta|bank)\b", re.I), None),
    "national_phone": (0.3, re.compile(r"\b(?:phone|tel|telefon|téléphone|teléfono|call|mobile|fax)\b", re.I), re.compile(r"\b(?:order|invoice|isbn|serial|version)\b", re.I)),
    "ssn": (0.3, re.compile(r"\b(?:ssn|social security|sozialversicherung|sécurité sociale)\b", re.I), re.compile(r"\b(?:order|invoice|part|serial)\b", re.I)),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Lengths by country; elsewhere any.
_IBAN_LENGTH = {c: int(n) for n, cs in {"15": "NO", "16": "BE", "18": "DK FI FO GL NL", "19": "MK SI", "20": "AT BA EE KZ LT LU XK", "21": "CH HR LI LV", "22": "BG BH DE GB GE IE ME RS", "23": "AE GI IL", "24": "AD CZ ES MD PK RO SA SE SK TN", "26": "IS TR", "27": "FR GR IT MC SM", "28": "AL CY DO HU LB PL", "29": "BR", "30": "MU", "31": "MT"}.items() for c in cs.split()}
_NATIONAL = re.compile(r"(?<![0-9+)(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_SECRET = re.compile(r"\b(?:token|secret|password|api[_-]?key)\b ?[=:] ?[\"']?([A-Za-z0-9_/+-]{16,})", re.I)
_NOT_DIGITS = {i: None for i in range(128) if not 48 <= i < 58}

Span = tuple[int, int, int]  #: start, kind's number, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Where the pattern matches, the end at a word's end for which mod-97 holds: at the country's length, else the longest. At most 20 ends a start."""
    m = _IBAN.search(text)
    while m:
        ends, n = [], 0
        for i in range(m.start(), m.end()):
            n += text[i] != " "
            if n >= 15 and text[i] != " " and (i + 1 == m.end() or text[i + 1] == " "):
                ends.append((n == _IBAN_LENGTH.get(m[0][:2]), i + 1))
        end = next((e for _, e in sorted(ends, reverse=True) if mod97(text[m.start() : e])), None)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 4)


def emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, 0, free
        at = text.find("@", free)


def _part(p: str) -> bool:
    return len(p := p.lstrip("0")) < 4 and int(p or 0) < 256


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if m[1] and all(_part(p) for p in m[0].split(".")):
            yield m.start(), 1, m.end()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.start(), 2, m.end()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(m[0].translate(_NOT_DIGITS)) <= 15:
            yield m.start(), 3, m.end()


def score(kind: str, text: str, start: int, end: int, confirmed: bool = False, formed: bool = False) -> float:
    """A proposal's score: its prior, 0.5 for a checksum that holds, 0.3 for the form expected, 0.3 for it by words nearby, 0.3 against it by words before."""
    prior, good, bad = CONTEXT[kind]
    before = text[max(0, start - WINDOW) : start]
    return round(prior + 0.5 * confirmed + 0.3 * formed + 0.3 * bool(good.search(f"{before} {text[end : end + WINDOW]}")) - 0.3 * bool(bad and bad.search(before)), 2)


def proposed(text: str, digits: bool) -> Iterator[tuple[int, int, int, float]]:
    """Spans of the further kinds with their scores, whatever these are."""
    if digits:
        for start, end in ibans(text):
            formed = len(text[start:end].replace(" ", "")) == _IBAN_LENGTH.get(text[start : start + 2])
            yield start, 4, end, score("iban", text, start, end, True, formed)
        for m in _NATIONAL.finditer(text):
            yield m.start(), 5, m.end(), score("national_phone", text, *m.span())
        for m in _SSN.finditer(text):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                yield m.start(), 6, m.end(), score("ssn", text, *m.span())
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            yield m.start(1), 7, m.end(1), 1.0


_HAS_DIGIT = re.compile(r"[0-9]")


def scored(text: str | None) -> tuple[list[Span], list[tuple[int, int, int, float]]]:
    """Base spans, and all with scores; each by start, then kind as listed. A further span inside a base span of the text adds nothing and is left out."""
    if not text:
        return [], []
    digits = _HAS_DIGIT.search(text) is not None
    base = list(emails(text))
    if digits:
        base += [*ips(text), *cards(text), *phones(text)]
    base.sort()
    starts, reach = [s[0] for s in base], list(accumulate((s[2] for s in base), max))
    more = [s for s in proposed(text, digits) if s[3] >= THRESHOLD and (not (i := bisect_right(starts, s[0])) or reach[i - 1] < s[2])]
    return base, sorted([*((*s, 1.0) for s in base), *more])


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """The same without scores."""
    base, every = scored(text)
    return base, [s[:3] for s in every]


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span, and spans that overlap as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan(docs: DataFrame, text: str, new: dict[str, T.DataType], redact: bool) -> DataFrame:
    """docs with the columns new, which none of its own is named like. One pass, no shuffle."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in new.items())])
    place = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(place).to_pylist()
            both = [scored(t) for t in texts]
            columns = list(batch.columns)
            if redact:
                columns[place] = pa.array([t if not t or not a else redacted(t, [s[:3] for s in a]) for t, (_, a) in zip(texts, both, strict=True)], pa.string())
            if new:
                columns += [pa.array([joined([s[:3] for s in a]) for _, a in both], pa.string()), pa.array([joined(b) for b, _ in both], pa.string())]
                columns.append(pa.array([",".join(f"{s[3]:.2f}" for s in a) for _, a in both], pa.string()))
                columns += [pa.array([sum(s[1] == k for s in b) for b, _ in both], pa.int64()) for k in range(len(BASE))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    return map_arrow(docs, run, schema)


def find_pii(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """docs with pii_spans (all), pii_base (base spans), pii_scores (of all), n_<base kind>, and with redact also the redacted text in its place.

    Null text: empty strings and counts of 0; it stays null.
    """
    new = {c: T.StringType() for c in ("pii_spans", "pii_base", "pii_scores")} | {f"n_{k}": T.LongType() for k in BASE}
    return _scan(docs.select(*(F.col(quoted(c)) for c in docs.columns if c not in new)), text, new, redact)


def digest(docs: DataFrame) -> DataFrame:
    """op1: doc_id, counts of base spans, the hash of the base spans, all spans and their scores."""
    found = find_pii(docs.select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2("pii_base", 256).alias("base_sha256"), F.col("pii_spans").alias("spans"), F.col("pii_scores").alias("scores"))


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: texts redacted, n_chars kept in step; all columns and no other."""
    out = _scan(docs, "text", {}, True)
    changed = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {}
    return out.select(*(changed.get(c, F.col(quoted(c))) for c in docs.columns))
