"""Personal data in texts: spans by recognizers with checks, overlaps resolved, placeholders with an offset map.

A recognizer has a pattern whose group `v` is the value (labels stay in the text), a score, a check of the
value (check digits, number ranges) and, where the form alone says little, words that must stand before it on the
line.  Spans stay on one line, so texts are searched line by line.  Values that are accession numbers,
variant names, ages or plain dates are never taken for numbers or phones, unless labelled as such.
Names without a label or title are not looked for: no name model is at hand.

Offsets are code points of the whole text.  A null text has no spans and stays null.
"""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = {
    "PERSON": "<PERSON>",
    "DATE_OF_BIRTH": "<DATE_OF_BIRTH>",
    "STREET_ADDRESS": "<ADDRESS>",
    "EMAIL_ADDRESS": "<EMAIL>",
    "PHONE_NUMBER": "<PHONE>",
    "PATIENT_ID": "<ID>",
    "US_SSN": "<ID>",
    "IBAN_CODE": "<ID>",
    "CREDIT_CARD": "<ID>",
    "IP_ADDRESS": "<IP_ADDRESS>",
}
SPAN = "struct<kind:string,start:int,end:int,redacted_start:int,redacted_end:int>"


# Checks of values -----------------------------------------------------------------------------------


def digits(value: str) -> str:
    return re.sub(r"\D", "", value)


def luhn(value: str) -> bool:
    d = [int(c) for c in digits(value)][::-1]
    return 12 <= len(d) <= 19 and len(set(d)) > 1 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban(value: str) -> bool:
    v = re.sub(r"\s", "", value).upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def ssn(value: str) -> bool:
    area, group, serial = value[:3], value[4:6], value[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def insurance_number(value: str) -> bool:
    """Ten digits: three of sequence, a check digit (weights 3 7 9, 5 8 4 2 1 6 modulo 11), a date of birth."""
    d = [int(c) for c in digits(value)]
    return len(d) == 10 and d[0] > 0 and sum(x * w for x, w in zip(d, (3, 7, 9, 0, 5, 8, 4, 2, 1, 6), strict=True)) % 11 == d[3]


def address(value: str) -> bool:
    try:
        ipaddress.ip_address(value)
    except ValueError:
        return False
    return True


def phone(value: str) -> bool:
    return 7 <= len(digits(value)) <= 15


def anything(value: str) -> bool:
    return True


# Patterns -------------------------------------------------------------------------------------------

MONTH = r"(?:jan|feb|mar|mär|apr|may|mai|jun|jul|aug|sep|oct|okt|nov|dec|dez)[a-zäöü]*\.?"
DATE = rf"(?:\d{{1,2}}[./-] ?\d{{1,2}}[./-] ?\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.? {MONTH} \d{{4}}|{MONTH} \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})"
PROPER = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
NUMBER = r"\d{1,4}[a-zA-Z]?(?: ?[/-] ?\d{1,4})*"
STREET = r"(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Gg]asse|[Pp]latz|[Aa]llee|[Rr]ing|[Ww]eg|[Kk]ai|[Uu]fer)"
BEFORE, AFTER = r"(?<![\w.+-])", r"(?![\w-])"


class Recognizer:
    def __init__(self, kind: str, score: float, pattern: str, check=anything, labelled: bool = False, context: str | None = None, flags: int = 0):
        self.kind, self.score, self.check, self.labelled = kind, score, check, labelled
        self.pattern = re.compile(pattern, flags)
        self.context = context and re.compile(context, re.I)

    def spans(self, line: str):
        for m in self.pattern.finditer(line):
            value = m["v"].rstrip(" ,.;:")
            if value and self.check(value) and not (self.context and not self.context.search(line[max(0, m.start("v") - 40) : m.start("v")])):
                yield m.start("v"), m.start("v") + len(value), self.score, self.kind, self.labelled


RECOGNIZERS = [
    Recognizer("EMAIL_ADDRESS", 1.0, r"(?<![\w.%+-])(?P<v>[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})"),
    Recognizer("PHONE_NUMBER", 0.6, BEFORE + r"(?P<v>(?:\+|00)[1-9]\d{0,2}[ ()/.-]?(?:\(?\d+\)?[ /.-]?){2,6}\d)" + AFTER, phone),
    Recognizer("PHONE_NUMBER", 0.5, BEFORE + r"(?P<v>\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4})" + AFTER, phone),
    Recognizer("PHONE_NUMBER", 0.9, r"\b(?:tele(?:phone|fon)|tel|phone|mobile|mobil|handy|fax|cell)\b\.? ?[:.]? ?(?P<v>\+?\(?\d[\d ()/.-]{5,}\d)", phone, True, flags=re.I),
    Recognizer("US_SSN", 0.85, BEFORE + r"(?P<v>\d{3}-\d{2}-\d{4})" + AFTER, ssn),
    Recognizer("IBAN_CODE", 1.0, BEFORE + r"(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)" + AFTER, iban),
    Recognizer("CREDIT_CARD", 1.0, BEFORE + r"(?P<v>\d{4}(?:[ -]?\d{2,6}){2,4})" + AFTER, luhn),
    Recognizer("IP_ADDRESS", 0.95, r"(?<![\w.:])(?P<v>(?:\d{1,3}\.){3}\d{1,3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:]|\.\d)", address),
    Recognizer("DATE_OF_BIRTH", 0.95, rf"\b(?:date of birth|birth ?date|d\.?o\.?b\.?|born(?: on)?|geburtsdatum|geboren(?: am)?|geb\.|date de naissance)[ \t]*[:=]?[ \t]*(?P<v>{DATE})", labelled=True, flags=re.I),
    Recognizer("PERSON", 0.9, rf"\b(?i:patient(?:in)?(?: name)?|(?:full |first |last |sur|vor|nach)?name|mother|father|mutter|vater|guardian|physician|arzt|ärztin|contact)[ \t]*:[ \t]*(?P<v>{PROPER}(?:,?[ \t]{PROPER}){{0,2}})", labelled=True),
    Recognizer("PERSON", 0.9, rf"(?<![\w.])(?:(?:Mr|Mrs|Ms|Dr|Prof|Hr|Fr)\.|Mr|Mrs|Ms|Miss|Herrn?|Frau)[ \t]+(?P<v>{PROPER}(?:[ \t]{PROPER}){{0,2}})", labelled=True),
    Recognizer("PATIENT_ID", 0.9, r"\b(?:mrn|medical record|(?:patient|case|record|chart|member|insurance|policy|sample|order|accession|health card)[ -]?(?:id|no\.?|number|#)|(?:patienten|fall|befund|versicherungs|labor|proben)-?(?:id|nummer|nr\.?)|svnr\.?)[ ]*[:#.]?[ ]*(?P<v>(?:[A-Z]{1,5}[-/ ]?)?\d[\dA-Z]*(?:[-/.][\dA-Z]+)*)", labelled=True, flags=re.I),
    Recognizer("PATIENT_ID", 0.6, BEFORE + r"(?P<v>\d{4} ?(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2})" + AFTER, insurance_number),
    Recognizer("PATIENT_ID", 0.5, BEFORE + r"(?P<v>\d{6,12})" + AFTER, context=r"\b(?:id|nr|no|number|nummer|mrn|record|passport|account)\b"),
    Recognizer("STREET_ADDRESS", 0.85, rf"(?<!\w)(?P<v>\d{{1,5}}[A-Za-z]? (?:{PROPER}\.? ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Drive|Court|Place|Terrace|Square)\b\.?(?:,? (?:Apt|Unit|Suite|Flat)\.? [\w-]+)?)"),
    Recognizer("STREET_ADDRESS", 0.85, rf"(?<!\w)(?P<v>[A-ZÄÖÜ][\w-]*(?: ?{STREET})[ \t]+{NUMBER})"),
    Recognizer("STREET_ADDRESS", 0.85, rf"(?<!\w)(?P<v>(?:Via|Viale|Piazza|Corso|Rue|Place|Quai|Calle|Avenida|Plaza|Paseo|Rua|Praça)[ \t]+(?:d\w{{0,4}}[ \t'])*{PROPER}(?:[ \t]{PROPER}){{0,2}},?[ \t]+{NUMBER})"),
    Recognizer("STREET_ADDRESS", 0.85, rf"(?<!\w)(?P<v>\d{{1,4}},?[ \t]+(?:rue|avenue|boulevard|place|quai|calle|avenida|plaza|via)[ \t]+(?:d\w{{0,4}}[ \t'])*(?:l[ae]s?[ \t])?{PROPER})"),
    Recognizer("STREET_ADDRESS", 0.85, r"(?<!\w)(?P<v>[A-Z][a-z]+(?: [A-Z][a-z]+)?, [A-Z]{2} \d{5}(?:-\d{4})?)" + AFTER),
    Recognizer("STREET_ADDRESS", 0.85, r"(?<!\w)(?P<v>p\.? ?o\.? ?box \d+|postfach \d+)", flags=re.I),
]
#: Accessions, variant names, ontology ids, positions, ages and dates: not personal unless labelled.
PROTECTED = re.compile(
    r"\b(?:N[CGMPR]|XM|ENS[GT]|LRG)_?\d+(?:\.\d+)?(?::\S+)?|\b[cgmnpr]\.[\w(*?+>-]*\d[\w)*?+>-]*|\b(?i:HP|MONDO|OMIM|ORPHA|HGNC|GO|CHEBI|PMID|DOID)[:_ ] ?\d+|\b(?:NCT|VCV|RCV|rs)\d+|\bchr(?:\d{1,2}|[XYM])[:\d,-]*"
    rf"|\b\d+(?:[.,]\d+)? ?(?i:years?|months?|weeks?|days?|Jahren?|Monaten?|Wochen?|Tagen?)\b|(?<![\w.])(?i:{DATE})(?!\w)"
)
LABEL_FREE = ("PHONE_NUMBER",)  # kinds that protected values beat even after a label


def resolved(spans: list[tuple]) -> list[tuple]:
    """Disjoint spans in order: of overlapping ones the union, named by the best score (then the earlier)."""
    out: list[tuple] = []
    for start, end, score, kind in sorted(spans, key=lambda s: (s[0], -s[1], -s[2], s[3])):
        if out and start < out[-1][1]:
            a, b, s, k = out[-1]
            out[-1] = (a, max(b, end), max(s, score), kind if score > s and end > b else k)
        else:
            out.append((start, end, score, kind))
    return out


def line_spans(line: str) -> list[tuple]:
    """(start, end, score, kind) of one line."""
    if not any(c.isdigit() or c in "@:." for c in line) and not re.search("Herr|Frau|M(?:r|rs|s|iss) ", line):
        return []
    shut = [m.span() for m in PROTECTED.finditer(line)]
    found = []
    for r in RECOGNIZERS:
        for start, end, score, kind, labelled in r.spans(line):
            if (labelled and kind not in LABEL_FREE) or not any(start < b and a < end for a, b in shut):
                found.append((start, end, score, kind))
    return resolved(found)


def redacted(text: str) -> tuple[str, list[tuple]]:
    """(text with placeholders, [(kind, start, end, start there, end there)])."""
    parts, spans, at, there = [], [], 0, 0
    for line in text.split("\n"):
        last = 0
        for start, end, _, kind in line_spans(line):
            parts += [line[last:start], PLACEHOLDERS[kind]]
            there += start - last
            spans.append((kind, at + start, at + end, there, there + len(PLACEHOLDERS[kind])))
            there += len(PLACEHOLDERS[kind])
            last = end
        parts += [line[last:], "\n"]
        there += len(line) - last + 1
        at += len(line) + 1
    return "".join(parts[:-1]), spans


#: Bytes of texts, and rows, that a worker holds as Python objects at once; a longer text stands alone.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512


def _sliced(batches):
    """Batches cut before the row that would lead over SLICE_BYTES of texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if i > first and (held + size > SLICE_BYTES or i - first >= SLICE_ROWS):
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        yield batch.slice(first)


def _redact(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int32()) for n in ("start", "end", "redacted_start", "redacted_end"))]))
    names = [f.name for f in kind.value_type]
    for batch in _sliced(batches):
        done = [(None, []) if t is None else redacted(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array([d[0] for d in done], pa.string()), pa.array([[dict(zip(names, s, strict=True)) for s in d[1]] for d in done], kind)], ["key", "text", "spans"])


def redact(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, spans): whole texts with placeholders, and where they stand before and after."""
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(_redact, f"key {kind}, text string, spans array<{SPAN}>")
    return found.withColumnRenamed("key", key)


def _spans(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("size", pa.int32())]))
    for batch in _sliced(batches):
        found = [[] if t is None else [{"kind": k, "size": end - start} for k, start, end, _, _ in redacted(t)[1]] for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, kind)], ["spans"])


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(kind, n, code_points) of all that `redact` would replace; no text goes back from a worker."""
    found = docs.select(docs[text].alias("text")).mapInArrow(_spans, "spans array<struct<kind:string,size:int>>")
    return found.select(F.inline("spans")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("code_points"))


def to_original(spans: Column, position: Column, is_end: bool) -> Column:
    """A position of the redacted text in the original; inside a placeholder the edge of what it stands for."""
    before = F.filter(spans, lambda s: s["redacted_start"] < position)
    last = F.try_element_at(before, F.lit(-1))
    inside = position < last["redacted_end"]
    return F.when(last.isNull(), position).when(inside, last["end"] if is_end else last["start"]).otherwise(position + last["end"] - last["redacted_end"])
