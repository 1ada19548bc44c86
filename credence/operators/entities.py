"""Named entities by several extractors: fallback where the first ones fail, thresholds, labels, overlaps, repeats.

An extractor is a function of a text column that gives an array of SPAN, or null where it failed or couldn't be loaded. All
spans of a text are in its row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPAN = "struct<start:int,end:int,label:string,confidence:double>"
ENTITY = "struct<start:int,end:int,surface:string,label:string,confidence:double>"
#: Surfaces that name nothing. Fixed values.
EMPTY_SURFACES = ("the", "a", "an", "the user", "the assistant", "the tool", "user", "assistant", "tool")
#: Spans that a worker holds before it hands them on; those of one text stay together.
PIECE = 50_000


def by_patterns(patterns: Sequence[tuple[str, str, float]]) -> Callable[[Column], Column]:
    """An extractor of all matches of (pattern, label, confidence), with offsets in characters; a null text gives null."""
    compiled = [(re.compile(p), label, float(c)) for p, label, c in patterns]

    # Spans stay Arrow columns and leave in pieces: those of one batch of texts would fill an executor, the more as Python objects.
    @F.arrow_udf(f"array<{SPAN}>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            at = 0
            starts, ends, kinds, bounds = array("i"), array("i"), array("i"), array("i", [0])
            for i, t in enumerate(texts, 1):
                text = t.as_py() or ""
                for k, (p, _, _) in enumerate(compiled):
                    for m in p.finditer(text):
                        if m.group():
                            starts.append(m.start())
                            ends.append(m.end())
                            kinds.append(k)
                bounds.append(len(starts))
                if len(starts) >= PIECE or i == len(texts):
                    kind = pa.array(kinds, pa.int32())
                    label = pa.array([x for _, x, _ in compiled], pa.string()).take(kind)
                    sure = pa.array([c for _, _, c in compiled], pa.float64()).take(kind)
                    values = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), label, sure], ["start", "end", "label", "confidence"])
                    yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=texts[at:i].is_null())
                    at = i
                    starts, ends, kinds, bounds = array("i"), array("i"), array("i"), array("i", [0])

    return found


def _settled(spans: list[dict], text: str, merge: bool) -> list[dict]:
    """Spans that name something, in text order: of two that overlap the surer, then the longer; each surface and label once."""
    named = []
    for s in spans:
        surface = text[s["start"] : s["end"]]
        name = surface.strip().casefold()
        if name and not name.isdigit() and name not in EMPTY_SURFACES:
            named.append({**s, "surface": surface})
    out: list[dict] = []
    size = lambda s: s["end"] - s["start"]
    for s in sorted(named, key=lambda s: (s["start"], -size(s), -s["confidence"])):
        if merge and out and s["start"] < out[-1]["end"]:
            if (s["confidence"], size(s)) > (out[-1]["confidence"], size(out[-1])):
                out[-1] = s
        else:
            out.append(s)
    first: dict = {}
    for s in sorted(out, key=lambda s: (s["start"], s["end"])):
        first.setdefault((s["surface"].casefold(), s["label"].upper()), s)
    return list(first.values())


def _in_pieces(lists: Iterable[list[dict]]) -> Iterator[pa.Array]:
    """Lists of entities as Arrow arrays of some PIECE of them."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("label", pa.string()), ("confidence", pa.float64())]))
    held, size = [], 0
    for x in lists:
        held.append(x)
        size += len(x) + 1
        if size >= PIECE:
            yield pa.array(held, kind)
            held, size = [], 0
    if held:
        yield pa.array(held, kind)


def extracted(texts: DataFrame, methods: Sequence[Callable], fallback: Sequence[Callable] = (), least: float = 0.5, labels: Sequence[str] | None = None, merge: bool = True) -> DataFrame:
    """texts with `entities`, an array of ENTITY in text order. texts: text_id, text.

    What all `methods` that succeed find counts together. Only where every one of them fails is the first of `fallback` that
    succeeds asked; having found nothing is no failure. Spans of less confidence than `least` and of other labels than
    `labels` (case ignored) go before overlaps are settled. Blank or null texts have none.
    """
    text = F.when(F.trim("text") != "", F.col("text"))
    none = F.array().cast(f"array<{SPAN}>")
    rows = texts.select("*", *(m(text).alias(f"__m{i}") for i, m in enumerate(methods)))
    first = [F.col(f"__m{i}") for i in range(len(methods))]
    failed = F.lit(True)
    for c in first:
        failed = failed & c.isNull()
    # Extractors cost; a fallback is shown no text but those that need it.
    for i, f in enumerate(fallback):
        rows = rows.withColumn(f"__f{i}", f(F.when(failed & F.trim("text").isNotNull() & (F.trim("text") != ""), F.col("text"))))
        failed = failed & F.col(f"__f{i}").isNull()
    spans = F.concat(*(F.coalesce(c, none) for c in first), *(F.coalesce(f"__f{i}", none) for i in range(len(fallback))), none)
    wanted = F.filter(spans, lambda s: (s["confidence"] >= least) & (F.lit(True) if labels is None else F.upper(s["label"]).isin([x.upper() for x in labels])))

    @F.arrow_udf(f"array<{ENTITY}>")
    def settled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for spans, texts in batches:
            yield from _in_pieces(_settled(s.as_py() or [], t.as_py() or "", merge) for s, t in zip(spans, texts))

    return rows.withColumn("entities", settled(wanted, F.col("text"))).select(*texts.columns, "entities")
