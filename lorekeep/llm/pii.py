"""Personal data, with offset-preserving deobfuscation.

The plain patterns run over the text as it is.  Then transducers rewrite a
copy of it: homoglyphs and invisible characters, spelled digits, and "at" and
"dot" disguises.  Each keeps, for every character it writes, the source span
it came from, so that spans found in the rewritten text map back to the
source.  Deobfuscation only adds spans; one that overlaps a plain span of its
kind is added only if it holds the whole of it and more.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
# A match begins at the start of a run of digits, and each run is taken whole
# (possessive), so nothing is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each kind, in code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found["email"].append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(c for c in m[0] if c in _DIGITS)
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in _DIGITS for c in m[0]) <= 15]
    return found


# -- transducers ------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝ" "АВЕКМНОРСТУХІЈЅ" "αινορτυχ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqw" "ABEKMHOPCTYXIJS" "aivoptux" "ABEZHIKMNOPTYX"))
_INVISIBLE = "­​‌‍⁠﻿"
_PUNCTUATION = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", " ": " ", " ": " ", " ": " ", " ": " ", "﹫": "@"}
# The digits from zero to nine in English, German, French and Spanish.
_DIGITS_EN = "zero one two three four five six seven eight nine"
_DIGITS_DE = "null eins zwei drei vier fünf sechs sieben acht neun"
_DIGITS_FR = "zéro un deux trois quatre cinq six sept huit neuf"
_DIGITS_ES = "cero uno dos tres cuatro cinco seis siete ocho nueve"
_DIGIT_NAMES = {name: str(d) for line in (_DIGITS_ES, _DIGITS_FR, _DIGITS_DE, _DIGITS_EN) for d, name in enumerate(line.split())} | {"oh": "0"}
_TIMES = {"double": 2, "triple": 3}
# Domains that end an address written with underscores or spaced dots.
_DOMAINS = "com org net edu gov mil info biz io co uk de fr es eu us ca ch"
_FULL_WIDTH = range(0xFF01, 0xFF5F)


def _glyph_table() -> dict[int, str]:
    table = {ord(k): v for k, v in [*_LOOKALIKES.items(), *_PUNCTUATION.items()]}
    table |= {ord(c): "" for c in _INVISIBLE}
    table |= {c: chr(c - 0xFEE0) for c in _FULL_WIDTH}
    return table


_GLYPHS = _glyph_table()


def _other_digits(text: str) -> dict[int, str]:
    """Decimal digits of any script, as far as the text has them."""
    return {ord(c): str(unicodedata.decimal(c)) for c in set(text) if ord(c) > 127 and unicodedata.decimal(c, None) is not None}


class Mapped:
    """A text whose characters know their source spans; ``None`` where nothing has moved."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace spans of this text (in order, apart); each new character owns its edit's whole span."""
        if not edits:
            return self
        out: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            out.append(self.text[at:a])
            if self.starts is None:
                starts.extend(range(at, a))
                ends.extend(range(at + 1, a + 1))
            else:
                starts.extend(self.starts[at:a])
                ends.extend(self.ends[at:a])
            if new:
                s, e = self.span(a, b)
                out.append(new)
                starts.extend([s] * len(new))
                ends.extend([e] * len(new))
            at = b
        return Mapped("".join(out), starts, ends)


def plain_glyphs(text: Mapped) -> Mapped:
    """Homoglyphs, full-width forms and digits of other scripts to ASCII; invisible characters go.

    Look-alike letters are rewritten only in words that also hold ASCII
    letters, digits or an @, so words that are wholly in another script stay.
    """
    if text.text.isascii():
        return text
    table = _GLYPHS | _other_digits(text.text)
    if table.keys().isdisjoint(map(ord, set(text.text))):
        return text
    edits = []
    for word in re.finditer(r"\S+", text.text):
        if word[0].isascii():
            continue
        mixed = re.search(r"[A-Za-z0-9@＠]", word[0])
        for i, c in enumerate(word[0], word.start()):
            if (new := table.get(ord(c))) is not None and (mixed or c not in _LOOKALIKES):
                edits.append((i, i + 1, new))
    edits += [(i, i + 1, _PUNCTUATION[c]) for i, c in enumerate(text.text) if c in _PUNCTUATION and c.isspace()]
    return text.rewritten(sorted(edits))


_NAME = "|".join(sorted(_DIGIT_NAMES, key=len, reverse=True))
_MANY = rf"(?:(?:{'|'.join(_TIMES)})[\x20-])?"
# Words end where letters do, so a run stops before "onetime" and stands without it.
_PART = rf"(?:{_MANY}(?:{_NAME})(?![^\W_])|[0-9]++(?![^\W\d_]))"
_SPELLED = re.compile(rf"(?<![^\W_]){_PART}(?:[\x20()-]{{1,3}}{_PART})++", re.IGNORECASE)
_SPELLED_TRIGGER = re.compile(rf"(?<![^\W\d_]){_MANY}(?:{_NAME})[\x20()-]{{1,3}}{_MANY}(?:{_NAME}|[0-9])|[0-9][\x20()-]{{1,3}}{_MANY}(?:{_NAME})(?![^\W_])", re.IGNORECASE)
_PLUS = re.compile(r"(?<![^\W\d_])(?:plus|más)[\x20]+(?=\+?[0-9])", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+|[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPELT = frozenset(_DIGIT_NAMES)


def spelled_digits(text: Mapped) -> Mapped:
    """Spelled digits beside other digits, spelled or not, become figures; "plus" before one becomes +.

    "double" and "triple" repeat the digit they stand before.  Whether the run
    is an identifier is left to the patterns.
    """
    # most texts spell no digit at all, which is seen fastest by their words
    if _SPELT.isdisjoint(_LETTERS.findall(text.text.lower())) or not _SPELLED_TRIGGER.search(text.text):
        return text
    edits = []
    for run in _SPELLED.finditer(text.text):
        parts = list(_WORD.finditer(run[0]))
        times, begin = 1, -1
        for p, after in zip(parts, [*parts[1:], None]):
            word = p[0].lower()
            if word in _TIMES:
                times, begin = _TIMES[word], run.start() + p.start()
                continue
            a, b = run.start() + p.start(), run.start() + p.end()
            # the separator between two spelled digits goes; next to figures it stays
            if word in _DIGIT_NAMES:
                if after is not None and not after[0].isdecimal():
                    b = run.start() + after.start()
                edits.append((a if begin < 0 else begin, b, _DIGIT_NAMES[word] * times))
            times, begin = 1, -1
    text = text.rewritten(edits)
    return text.rewritten([(*m.span(), "+") for m in _PLUS.finditer(text.text)])


_AT = r"(?:\x20*[\[({<]\x20*(?:at|AT|At|@)\x20*[\])}>]\x20*|\x20+(?:at|AT|At)\x20+|\x20*@\x20*)"
_DOT = r"(?:\x20*[\[({<]\x20*(?:dot|DOT|Dot|\.)\x20*[\])}>]\x20*|\x20+(?:dot|DOT|Dot)\x20+|\.)"
_LABEL = r"[A-Za-z0-9-]++"
# Chains are taken whole (possessive), whether an address follows or not, so a long one is read once.
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++)*+(?:(?P<at>{_AT}){_LABEL}(?:{_DOT}{_LABEL})++)?+")
_DISGUISE_TRIGGER = re.compile(r"(?i)[\[({<]\x20*(?:at|@|dot|\.)\x20*[\])}>]|\x20dot\x20|@\x20")
_DOMAIN_END = rf"(?:{'|'.join(_DOMAINS.split())})(?![A-Za-z0-9_-])"
# "john_at_example_dot_com", "john-at-example-dot-com" and "john @ example . com"
_JOINED = re.compile(rf"(?i)(?<![A-Za-z0-9._%+@-])[A-Za-z0-9.%+]+(?:([_-])dot\1[A-Za-z0-9.%+]+)*?(?P<at>([_-])at\3)[A-Za-z0-9]+(?:\3dot\3[A-Za-z0-9]+)*?\3dot\3{_DOMAIN_END}")
_JOINED_DOT = re.compile(r"(?i)([_-])dot\1")
_SPACED = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])(?P<at>\x20*@\x20*)[A-Za-z0-9-]+(?:\x20*\.\x20*[A-Za-z0-9-]+){{0,3}}?\x20*\.\x20*{_DOMAIN_END}")
_SPACED_DOT = re.compile(r"\x20*\.\x20*")
# an address of which every character stands by itself
_SPACED_IP = re.compile(r"(?<![0-9])(?<![0-9.]\x20)[0-9](?:\x20[0-9]){0,2}(?:\x20\.\x20[0-9](?:\x20[0-9]){0,2}){3}(?!\x20?[0-9])")
_NUMBER_DOT = re.compile(r"(?i)(?<=[0-9])(?:\x20*[\[({<]\x20*(?:dot|\.)\x20*[\])}>]\x20*|\x20+dot\x20+)(?=[0-9])")


def spaced_and_joined(text: Mapped) -> Mapped:
    """Addresses joined by underscores or hyphens, with spaced dots, or spaced out in every character; those of names end in a known domain."""
    edits = []
    low = text.text.lower()
    if "_at_" in low or "-at-" in low:
        for m in _JOINED.finditer(text.text):
            edits.append((*m.span("at"), "@"))
            edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _JOINED_DOT.finditer(m[0])]
    if "@" in low and " ." in low:
        for m in _SPACED.finditer(text.text):
            dots = [d for d in _SPACED_DOT.finditer(m[0]) if d[0] != "."]
            if any(d[0][0] == " " for d in dots):  # a dot that ends a sentence has no space before it
                edits.append((*m.span("at"), "@"))
                edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in dots]
    edits += [(*m.span(), m[0].replace(" ", "")) for m in _SPACED_IP.finditer(text.text)] if " . " in text.text else []
    last, apart = 0, []
    for a, b, new in sorted(edits):
        if a >= last:
            apart.append((a, b, new))
            last = b
    return text.rewritten(apart)


def at_and_dot(text: Mapped) -> Mapped:
    """"name [at] host (dot) org" and "name at host dot org" to an address; "10 dot 0 dot 0 dot 1" to figures.

    A bare word "at" counts only where a disguised dot follows in the same
    address, so "at example.com" in prose stays.  A spaced "@" counts if the
    last label has a letter, so "2 @ 3.50" stays; so does "hi @some.name".
    """
    text = spaced_and_joined(text)
    if not _DISGUISE_TRIGGER.search(text.text):
        return text
    edits = []
    for m in _DISGUISED.finditer(text.text):
        if not m["at"]:
            continue
        at = m.start("at")
        bare_at = m["at"].strip().lower() == "at"
        tail = text.text[m.end("at") : m.end()]
        if m["at"] == "@" and not re.search(r"(?i)dot|[\[({<]", m[0]):
            continue  # plain already
        if bare_at and not re.search(r"(?i)\x20dot\x20|[\[({<]", tail):
            continue
        if m["at"].strip() == "@" and m["at"] != "@" and not re.search(r"(?i)dot|[\[({<]", m[0]) and (m["at"][-1] == "@" or not re.search(r"[A-Za-z][A-Za-z0-9-]*\Z", tail)):
            continue
        edits.append((at, m.end("at"), "@"))
        for part, shift in ((text.text[m.start() : at], m.start()), (tail, m.end("at"))):
            edits += [(shift + d.start(), shift + d.end(), ".") for d in re.finditer(_DOT, part) if d[0] != "."]
    taken = {a for a, _, _ in edits}
    edits += [(*m.span(), ".") for m in _NUMBER_DOT.finditer(text.text) if m.start() not in taken]
    return text.rewritten(sorted(edits))


def all_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """The base spans and those that deobfuscation adds, each kind in order."""
    mapped = at_and_dot(spelled_digits(plain_glyphs(Mapped(text))))
    if mapped.starts is None:
        return base
    found = {}
    for kind, spans in plain_spans(mapped.text).items():
        own = sorted(base[kind])
        starts = [a for a, _ in own]
        new: list[tuple[int, int]] = []
        for a, b in sorted({mapped.span(*s) for s in spans} - set(own)):
            stop = bisect.bisect_left(starts, b)
            first = stop
            while first and own[first - 1][1] > a:
                first -= 1
            if all(a <= x and y <= b for x, y in own[first:stop]) and (not new or new[-1][1] <= a):
                new.append((a, b))
        found[kind] = sorted([*own, *new])
    return found


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (plain spans), ``base_sha256, spans`` and ``n_all``.

    One row per input row.  ``spans`` lists plain and deobfuscated spans as
    ``kind:start:end``.  Null and empty texts have no spans.  Whole texts are
    read, one at a time.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_all"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            columns: dict[str, list] = {n: [] for n in names[1:]}
            for text in batch.column("text").to_pylist():
                base = plain_spans(text or "")
                every = all_spans(text or "", base)
                for k in KINDS:
                    columns[f"n_{k}"].append(len(base[k]))
                columns["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                columns["spans"].append(_joined(every))
                columns["n_all"].append(sum(map(len, every.values())))
            arrays = [pa.array(columns[n], pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_all long")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlaps go to the span that starts first."""
    base = plain_spans(text)
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k, spans in all_spans(text, base).items() for a, b in spans), key=lambda s: (s[0], -s[1])):
        if a < at:
            continue
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with personal data in ``text_col`` replaced; all other columns, the rows and null texts stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            kind = batch.schema.field(at).type
            texts = pa.array([t if t is None else redact(t) for t in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
