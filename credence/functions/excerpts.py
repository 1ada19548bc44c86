"""Where an excerpt stands in a text: as it is, folded, or with edits, by seeds, diagonals and a bit-parallel alignment.

Folded means lower case with single spaces. With edits: of all stretches of the folded text the one of the fewest edits
(characters put in, left out or changed) from the folded excerpt; of several the one that ends first, then the shortest. At most
EDITS of the excerpt's characters may be edits.

Stretches are not tried one by one. An excerpt of m characters with m / SEEDED edits or fewer keeps m - 2 - 3 m / SEEDED of its
trigrams, all of them on diagonals (place in the text less place in the excerpt) that are 2 m / SEEDED apart at most. So the text's
trigrams are looked up among the excerpt's, hits are counted in bands of diagonals, and only bands with so many hits are aligned,
neighbours as one: first the band with the most hits, then those that have enough for as few edits as were found there. With more edits than that, up to EDITS, a stretch is found if as many trigrams happen to be left. An excerpt too
short for that is aligned with all of the text. An alignment takes a few operations on an m-bit number for each character.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

PLACE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("match", T.StringType())])
#: Edits allowed, as a share of the excerpt; one in so many characters may be an edit for a stretch to be found for sure.
EDITS, SEEDED = 0.4, 4
_WORD = re.compile(r"\S+")


def folded(text: str) -> tuple[str, np.ndarray]:
    """A text in lower case with single spaces and none at its ends, and the place in the text of each of its characters."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return "", np.empty(0, np.int64)
    starts, ends = np.array(spans, np.int64).T
    sizes = ends - starts + 1  # a space after each word
    places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    plain = " ".join([text[a:z] for a, z in spans])
    low = plain.lower()
    if len(low) == len(plain):
        return low, places[:-1]
    parts = [c.lower() for c in plain]  # one character can become several
    return "".join(parts), np.repeat(places[:-1], [len(x) for x in parts])


def _bits(needle: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(needle):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _distances(bits: dict[str, int], m: int, text: str, anchored: bool):
    """The edits between a needle and the best stretch of the text that ends at each place (anchored: that begins at 0 too).

    Columns of the table of edit distances as two bit vectors, of steps up and steps down.
    """
    full, high = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    for c in text:
        same = bits.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(across | up), up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1 | anchored, minus << 1
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
        yield score


def aligned(needle: str, text: str) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of the fewest edits; ties to the first end, then the shortest."""
    if not text:
        return None
    m = len(needle)
    found = list(_distances(_bits(needle), m, text, False))
    edits = min(found)
    end = found.index(edits) + 1
    if edits >= m:
        return None
    backwards = _distances(_bits(needle[::-1]), m, text[end - m - edits if end > m + edits else 0 : end][::-1], True)
    length = next(k for k, x in enumerate(backwards, 1) if x == edits)
    return edits, end - length, end


def _codes(text: str) -> np.ndarray:
    """Hashes of a text's trigrams."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:] if len(c) > 2 else np.empty(0, np.uint64)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Codes as numbers of 16 bits, to tell most of those that aren't wanted without a search."""
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.intp)


def hits_by_band(needle: str, text: str) -> np.ndarray:
    """How many of the needle's trigrams each band of diagonals and the next one hold, one in a band counted once."""
    m = len(needle)
    wanted = _codes(needle)
    by = np.argsort(wanted, kind="stable")
    codes = _codes(text)
    known = np.zeros(1 << 16, bool)
    known[_mixed(wanted)] = True
    places = np.flatnonzero(known[_mixed(codes)])
    codes = codes[places]
    low, high = np.searchsorted(wanted[by], codes, "left"), np.searchsorted(wanted[by], codes, "right")
    hits = high - low
    at = np.repeat(places, hits)
    within = by[np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(len(at))]
    seen = np.sort((at - within + m) // _width(m) * m + within)
    seen = seen[np.diff(seen, prepend=-1) > 0] // m
    count = np.bincount(seen, minlength=int(seen.max()) + 2 if len(seen) else 2)
    return count[:-1] + count[1:]


def _width(m: int) -> int:
    return 2 * (m // SEEDED) + 1


def _joined(bands: np.ndarray, m: int, n: int) -> list[tuple[int, int]]:
    """The parts of a text of n characters that bands and their next ones cover."""
    most, width = m // SEEDED, _width(m)
    out: list[tuple[int, int]] = []
    for b in bands.tolist():
        a, z = max(b * width - m - most, 0), min((b + 2) * width + most, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def _least(m: int, edits: int) -> int:
    """Trigrams that are left of a needle of m characters after so many edits."""
    return m - 2 - 3 * edits


def regions(needle: str, text: str) -> list[tuple[int, int]]:
    """The parts of the text (start, end) in which a stretch of m / SEEDED edits or fewer can lie."""
    m = len(needle)
    least = _least(m, m // SEEDED)
    return [(0, len(text))] if least < 1 else _joined(np.flatnonzero(hits_by_band(needle, text) >= least), m, len(text))


def nearest(needle: str, text: str) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best stretch of all regions.

    What the band with the most hits gives bounds the edits: only bands that hold the trigrams left by so few are aligned.
    If they are too many for such a bound, all regions are.
    """
    m, n = len(needle), len(text)
    least = _least(m, m // SEEDED)
    first = probe = None
    if least < 1:
        parts = [(0, n)]
    else:
        hits = hits_by_band(needle, text)
        top = int(hits.argmax())
        if hits[top] < least:
            return None
        [first] = _joined(np.array([top]), m, n)
        probe = aligned(needle, text[slice(*first)])
        parts = _joined(np.flatnonzero(hits >= max(least, _least(m, probe[0]) if probe else least)), m, n)
    best = None
    for a, z in parts:
        found = probe if (a, z) == first else aligned(needle, text[a:z])
        if found and (best is None or found[0] < best[0]):
            best = found[0], found[1] + a, found[2] + a
    return best


class Folded:
    """A text as by `folded`, without the place of each character: places are looked up, as few are asked for."""

    def __init__(self, text: str):
        self.text, self.places = text, None
        spaced = " ".join(text.split())
        self.plain = spaced.lower()
        if len(self.plain) != len(spaced):  # one character became several
            self.plain, self.places = folded(text)

    def place(self, i: int) -> int:
        """Of a character that is no space."""
        if self.places is not None:
            return int(self.places[i])
        word = next(islice(_WORD.finditer(self.text), self.plain.count(" ", 0, i), None))
        return word.start() + i - (self.plain.rfind(" ", 0, i) + 1)


def located(excerpt: str | None, content: str | None) -> tuple[int | None, int | None, str]:
    """(start, end, how): exact, normalized, fuzzy or not_found. A null, or an excerpt under two characters, is not found."""
    nowhere = None, None, "not_found"
    want = (excerpt or "").strip()
    if len(want) < 2 or not content:
        return nowhere
    start = content.find(want)
    if start >= 0:
        return start, start + len(want), "exact"
    whole = Folded(content)
    plain = whole.plain
    needle, _ = folded(want)
    at = plain.find(needle)
    if at >= 0:
        return whole.place(at), whole.place(at + len(needle) - 1) + 1, "normalized"
    best = nearest(needle, plain)
    if best is None or best[0] > EDITS * len(needle):
        return nowhere
    first, last = best[1] + (plain[best[1]] == " "), best[2] - 1 - (plain[best[2] - 1] == " ")
    return (whole.place(first), whole.place(last) + 1, "fuzzy") if first <= last else nowhere


@F.pandas_udf(PLACE)
def excerpt_place(excerpt: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = [located(a, b) for a, b in zip(excerpt, content)]
    return pd.DataFrame({"start": pd.array([r[0] for r in rows], "Int32"), "end": pd.array([r[1] for r in rows], "Int32"), "match": [r[2] for r in rows]})
