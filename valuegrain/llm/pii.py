"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm.tables import only

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds the method adds, each where no base span lies.
ADDED_KINDS = ("iban", "card_spaced", "phone_local", "national_id")
#: A span added needs this score: its pattern and checksum, raised or lowered by words around it.
ACCEPTED = 0.75
#: Characters around a candidate in which its words count.
CONTEXT = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A span starts where its run of digits starts: from within the run it would fail likewise.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Lengths of the account numbers of the countries in ISO 13616, by country code.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22,
    "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_CARD_SPACED = re.compile(r"(?<![0-9])[0-9]{4}([ .\-–])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+(])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: kind, pattern, score without context.
_ADDED = (
    ("iban", _IBAN, 0.9),
    ("card_spaced", _CARD_SPACED, 0.8),
    ("phone_local", _PHONE_LOCAL, 0.4),
    ("national_id", _NATIONAL, 0.5),
)
# Words that speak for a kind, and words that speak against personal data.
CONTEXT_WORDS = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "card_spaced": ("card", "credit", "visa", "mastercard", "karte", "carte", "tarjeta"),
    "phone_local": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "national_id": ("ssn", "social", "security", "insurance", "identity", "passport", "ausweis"),
}
AGAINST = ("isbn", "issn", "version", "order", "invoice", "serial", "doi", "part", "sku", "example")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """The check sum of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check sum of international account numbers, with the country's length."""
    if IBAN_LENGTHS.get(account[:2]) != len(account):
        return False
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A match is the run of local characters up to an @ with a domain behind it, or none.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1  # nothing that starts before an @ reaches beyond it otherwise
        at = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(map(_small, m.groups())):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind as listed, then by start."""
    finders = zip(BASE_KINDS, (_emails, _ips, _cards, _phones))
    return [(kind, a, b) for kind, find in finders for a, b in find(text)]


def _confirmed(kind: str, found: str) -> bool:
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    if kind == "card_spaced":
        return luhn(_NOT_DIGIT.sub("", found))
    if kind == "phone_local":
        return 8 <= len(_NOT_DIGIT.sub("", found)) <= 12
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _account_end(text: str, start: int, end: int) -> int:
    """Where the country's number of characters is reached; words behind it aren't part of it."""
    left = IBAN_LENGTHS.get(text[start : start + 2], 0)
    for i in range(start, end):
        left -= text[i] != " "
        if not left:
            return i + 1
    return end


def _context(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT // 2]
    words = {w.lower() for w in _WORD.findall(around)}
    score = 0.4 if words.intersection(CONTEXT_WORDS[kind]) else 0.0
    return score - (0.4 if words.intersection(AGAINST) else 0.0)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that pattern, checksum and context find besides the base ones."""
    taken = [(a, b) for _, a, b in base]
    spans = []
    for kind, pattern, score in _ADDED:
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "iban":
                b = _account_end(text, a, b)
            if any(a < y and x < b for x, y in taken) or not _confirmed(kind, text[a:b]):
                continue
            if score + _context(kind, text, a, b) >= ACCEPTED:
                spans.append((kind, a, b))
                taken.append((a, b))
    return spans


_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_LABELS = {"card_spaced": "CARD", "phone_local": "PHONE"}


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base_sha256, spans (text form) and found (array of kind, start, end).

    Offsets count code points, the end lies outside. Null text counts as empty and has no spans.
    Repeated rows each give a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, texts, found = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = base + added_spans(text, base)
                sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                texts.append(_joined(spans))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            columns = [batch.column(0), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
            names = ["doc_id", "base_sha256", "spans", "found"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _ARROW_SPANS)], names)

    rows = only(docs, "doc_id", "text")
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
        + [T.StructField("found", _SPANS)]
    )
    return rows.mapInArrow(run, schema)


def redacted(text: str) -> str:
    """The text with each span turned into its kind in brackets; spans that overlap become one."""
    base = base_spans(text)
    spans = sorted((a, b, k) for k, a, b in base + added_spans(text, base))
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{_LABELS.get(kind, kind.upper())}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact_pii(docs: DataFrame) -> DataFrame:
    """All rows with personal data in ``text`` replaced by its kind; null stays null.

    ``n_chars`` follows the new text where the table has it; other columns pass unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text")
            new = pa.array([None if v is None else redacted(v) for v in old.to_pylist()], old.type)
            batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), new)
            if "n_chars" in batch.schema.names:
                at = batch.schema.get_field_index("n_chars")
                kind = batch.schema.field(at)
                size = pc.if_else(pc.is_valid(new), pc.utf8_length(new).cast(kind.type), batch.column(at))
                batch = batch.set_column(at, kind, size)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def count_kind(kind: str):
    """Spans of a base kind among ``found``."""
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
