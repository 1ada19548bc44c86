"""Personal data by offset-preserving deobfuscation.

Base spans come from four detectors on the text itself. Then transducers rewrite a text into a plain form and note, for
each character they write, the source characters it stands for:

1. homoglyphs: full-width ASCII, mathematical and other compatibility forms, Cyrillic and Greek look-alikes, odd dots,
   dashes and spaces become ASCII; invisible characters vanish;
2. at/dot disguises: "[at]", "(at)", "{at}", "<at>" and "[dot]", "(punkt)"..., with the spaces around them, become @ and
   "."; bare " at " and " dot " only between name-like pieces of one address;
3. spelled digits: runs of three or more digit words or numbers that hold a word (English, German, French, Spanish)
   become digits, and in such runs "dot" and "point" become "." and "plus" becomes "+". Runs of plain numbers alone are
   nothing spelled: lists of years would be cards.

The same detectors run on the plain form; a match that holds a rewritten character is mapped back to source offsets and
added unless it overlaps a base span of its kind. A text is rewritten only where a transducer's own pattern matches.

Offsets are code points, end exclusive. A null text counts as empty: no spans. Texts are processed whole, in time linear
in their length. Repeated rows each get a row; an empty table gives an empty result; other columns pass only through
`redact`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from credence.llm.common import documents

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
# Matches begin where a run of digits begins: any later start in the run has the same rest and fails alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[^\W\d_]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        n = _LOCAL_BACK.match(text[end:at][::-1]).end() if at - end <= 256 else _back(text, end, at)
        if n and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", at - n, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            # The local part of a later match can't reach over this @, so nothing before it matters again.
            end = at + 1
            at = text.find("@", at + 1)
    return out


def _back(text: str, low: int, at: int) -> int:
    """The length of the local part before `at`, looked at in growing windows."""
    size = 256
    while True:
        n = _LOCAL_BACK.match(text[max(low, at - size) : at][::-1]).end()
        if n < size or at - size <= low:
            return n
        size *= 4


def base_spans(text: str) -> list[Span]:
    """The base spans, by start and then kind as listed."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- transducers ---------------------------------------------------------------------------------------------------

#: Look-alikes beyond Unicode's compatibility forms. Fixed values.
_LOOKALIKES = dict(zip("аеорсухівјѕԁԛԝһкмтАВЕКМНОРСТХУІЈЅοαρνεκτιΑΒΕΗΙΚΜΝΟΡΤΧΥΖ", "aeopcyxibjsdqwhkmtABEKMHOPCTXYIJSoapvektiABEHIKMNOPTXYZ"))
_LOOKALIKES |= dict.fromkeys("\u2024\u3002\uff0e\uff61\u00b7\u2022\u2219\u22c5", ".") | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d", "-")
_LOOKALIKES |= dict.fromkeys("\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " ")
_INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
#: All that the framed patterns accept; the bare one needs a "dot".
_DISGUISE_TRIGGER = re.compile(r"(?i)[\[({<]\s*(?:at|arroba|arobase|@|dot|punkt|point|punto|\.)\s*[\])}>]|\sdot\s")
_AT_FRAMED = re.compile(r"(?i)[\[({<]\s*(?:at|arroba|arobase|@)\s*[\])}>]")
_DOT_FRAMED = re.compile(r"(?i)[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]")
_HOST = re.compile(r"[A-Za-z0-9-]")
#: Endings that a bare "x at the dot z" must have, as in "look at the dot on it"; after other hosts any letters do. Fixed values.
_ENDINGS = "com|net|org|edu|gov|info|io|co|de|fr|es|uk|eu|ch|at|it|nl|us|ca|biz|example|dev|app"
# Lengths are those that addresses may have: 64 letters before the @, 63 in a label; up to ten parts on either side.
_BARE = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9_%+-]{1,64}(?:(?:\.|\s+dot\s+)[a-z0-9_%+-]{1,64}){0,9}(?:\s+at\s+|@)(?!(?:the|an?|this|that|each|every)\s+dot\s+(?!(?:ENDINGS)(?![A-Za-z0-9-])))[a-z0-9-]{1,63}(?:(?:\.|\s+dot\s+)[a-z0-9-]{1,63}){0,9}\s+dot\s+[a-z]{2,63}(?![A-Za-z0-9-])".replace("ENDINGS", _ENDINGS)
)
_BARE_PART = re.compile(r"(?i)\s+(at|dot)\s+")
#: Digit words by value. Fixed values.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_W = "|".join(sorted(_DIGIT_WORDS, key=lambda x: -len(x)))
_SPELLED_RUN = re.compile(r"(?i)(?<!\w)(?:plus\s+)?(?:%s|[0-9]+)(?:(?:\s+(?:dot|point|punkt|punto)\s+|\s*[.-]\s*|[\s,]+)(?:%s|[0-9]+)(?!\w)){2,}" % (_W, _W))
_SPELLED_TOKEN = re.compile(r"(?i)plus\s+|\s+(?:dot|point|punkt|punto)\s+|\b(?:%s)\b|\s*,\s*|\s+" % _W)


class Plain:
    """A rewritten text: its characters, and for each the source range that it stands for."""

    def __init__(self, text: str):
        self.text, self.at, self.to, self.changed = text, range(len(text)), range(1, len(text) + 1), None

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by new, for disjoint edits in order. Each new character stands for the whole source of [a, b)."""
        if not edits:
            return
        text, at, to, changed, done = [], [], [], bytearray(), 0
        old = self.changed or bytearray(len(self.text))
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[done:a])
            at += self.at[done:a]
            to += self.to[done:a]
            changed += old[done:a]
            if b > a:
                text.append(new)
                at += [self.at[a]] * len(new)
                to += [self.to[b - 1]] * len(new)
                changed += b"\x01" * len(new)
            done = b
        self.text, self.at, self.to, self.changed = "".join(text), at, to, changed


@lru_cache(1 << 16)
def _glyph(c: str) -> str | None:
    """What a character beyond ASCII is rewritten to, None if it stays."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    n = unicodedata.normalize("NFKC", c)
    return n if n != c and n.isascii() else None


def _homoglyphs(p: Plain) -> None:
    known = {c: n for c in set(p.text) if c > "\x7f" and (n := _glyph(c)) is not None}
    if known:
        p.edit([(*m.span(), known[m.group()]) for m in re.finditer(f"[{''.join(map(re.escape, known))}]", p.text)])


def _framed(text: str, frame: re.Pattern, new: str, within: re.Pattern | None = None) -> list[tuple[int, int, str]]:
    """Edits of all frames with the white space around them; `within`: what must stand on both sides of that.

    Frames are found first and widened after, so that a run of white space is read twice at most.
    """
    out, done = [], 0
    for m in frame.finditer(text):
        a, b = m.span()
        while a > done and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        if within is None or (a and within.match(text, a - 1) and within.match(text, b)):
            out.append((a, b, new))
            done = b
        else:
            done = m.end()
    return out


def _disguises(p: Plain) -> None:
    p.edit(_framed(p.text, _AT_FRAMED, "@"))
    p.edit(_framed(p.text, _DOT_FRAMED, ".", _HOST))
    edits = []
    for m in _BARE.finditer(p.text):
        edits += [(m.start() + x.start(), m.start() + x.end(), "@" if x.group(1).lower() == "at" else ".") for x in _BARE_PART.finditer(m.group())]
    p.edit(edits)


def _spelled(p: Plain) -> None:
    edits = []
    for m in _SPELLED_RUN.finditer(p.text):
        if not _LETTER.search(m.group()):
            continue
        for x in _SPELLED_TOKEN.finditer(m.group()):
            word = x.group().strip().lower()
            if word in _DIGIT_WORDS:
                new = _DIGIT_WORDS[word]
            elif word == "plus":
                new = "+"
            elif word in ("dot", "point", "punkt", "punto"):
                new = "."
            else:
                # Spaces and commas between digit words vanish; between plain digits a space stays.
                new = ""
            edits.append((m.start() + x.start(), m.start() + x.end(), new))
    p.edit(edits)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What shows only in plain form, in source offsets."""
    p = Plain(text)
    if not text.isascii():
        _homoglyphs(p)
    if _DISGUISE_TRIGGER.search(p.text):
        _disguises(p)
    _spelled(p)
    if p.changed is None:
        return []
    held = {k: ([a for x, a, _ in base if x == k], [b for x, _, b in base if x == k]) for k in KINDS}  # in order, none overlapping
    last, out = dict.fromkeys(KINDS, 0), []
    for kind, a, b in base_spans(p.text):
        s, e = p.at[a], p.to[b - 1]
        if any(p.changed[a:b]) or e - s != b - a:  # a rewritten character, or one that vanished
            starts, ends = held[kind]
            before = bisect_left(starts, e) - 1
            if s >= last[kind] and not (before >= 0 and ends[before] > s):
                out.append((kind, s, e))
                last[kind] = e
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    text = text or ""
    base = base_spans(text)
    more = added_spans(text, base)
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each maximal run of overlapping spans replaced by <KIND> of its first span."""
    out, done = [], 0
    for kind, a, b in spans:
        if a < done:
            done_to = max(done, b)
            done = done_to
            continue
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, all spans, and how many the transducers added."""

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column("text"):
                base, every = find(x.as_py())
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            c = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.string()), pa.array(c[5], pa.string()), pa.array(c[6], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return documents(docs).mapInArrow(run, _SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by its kind, n_chars following; all other columns as they are."""
    schema: T.StructType = docs.schema
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            texts = [x.as_py() for x in b.column(at)]
            new = [None if t is None else redacted(t, find(t)[1]) for t in texts]
            columns = list(b.columns)
            columns[at] = pa.array(new, pa.string())
            if chars is not None:
                old = b.column(chars).to_pylist()
                columns[chars] = pa.array([o if t is None or o is None else o + len(n) - len(t) for o, t, n in zip(old, texts, new)], b.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, schema)
