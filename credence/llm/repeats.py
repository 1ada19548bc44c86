"""Substring deduplication by hashing sentences and lines.

A text is cut into units with their offsets: lines, and within them sentences (a white space after . ! ? or their like
ends one), or whole paragraphs. A unit is normalised to its words (runs of letters and digits, lower case). What is hashed, to
128 bits, is a run: from each unit on, as many units as it takes to hold `min_words` words. So a passage is found whether
it is a line, lies inside a longer line, or is wrapped into short ones, and no unit is too short to take part.

* Across documents: digests are grouped over all documents. The document of the smallest id that holds a run keeps it;
  every other document loses its units.
* Within a document: runs of whole lines (or paragraphs) that recur lose what lies beyond their first occurrence.
  Refrains inside a line are not copies.

Runs that overlap are one span. Only digests and offsets are shuffled. A digest seen in one document ends at the first
aggregation; the others' occurrences join the one row that says which document is first, those of a very common line
dealt out over several tasks (`spread_join`).

Not found: passages that share no `min_words` words in whole units, such as part of a sentence that has no end nearby.

Nulls and edges: a null or empty text has no units; rows with a null id take no part and are left out by `per_document`;
`clean` passes them as they are; repeated rows of one id are one document with the same spans; a text all of which
recurs earlier keeps its separators alone; an empty table gives an empty result. Other columns pass only through `clean`.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from credence.llm.common import documents, materialise, parallel, spread_join

MIN_WORDS = 15
_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"\n")
#: How texts are cut. The separator of lines and sentences is one character.
CUTS = {"sentence": re.compile(r"\n|(?<=[.!?…。！？])[\x20\t\x0b\x0c\r]"), "line": _LINE, "paragraph": re.compile(r"\n[ \t]*\n")}

Unit = tuple[int, int, str, int]


def cut(text: str, separator: re.Pattern) -> list[Unit]:
    """(start, end, its words, their number) of each unit that has a word; code points, end exclusive."""
    out, at = [], 0
    for m in separator.finditer(text):
        if m.start() > at:
            words = _WORD.findall(text[at : m.start()].lower())
            if words:
                out.append((at, m.start(), " ".join(words), len(words)))
        at = m.end()
    words = _WORD.findall(text[at:].lower())
    return [*out, (at, len(text), " ".join(words), len(words))] if words else out


def runs(units: list[Unit], least: int) -> list[tuple[int, int, bytes]]:
    """(first unit, last unit, digest) of the shortest run of at least `least` words from each unit on."""
    out, last, held = [], 0, 0
    for first, u in enumerate(units):
        while held < least and last < len(units):
            held += units[last][3]
            last += 1
        if held < least:
            break
        text = u[2] if last == first + 1 else " ".join([x[2] for x in units[first:last]])
        out.append((first, last - 1, xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))))
        held -= u[3]
    return out


def repeated_within(text: str, separator: re.Pattern, least: int) -> list[tuple[int, int]]:
    """Spans of the runs that occur earlier in the text, without what the first occurrence holds of them."""
    units = cut(text, separator)
    if len({u[2] for u in units}) == len(units):
        return []
    seen: dict[bytes, int] = {}
    out = []
    for first, last, digest in runs(units, least):
        beyond = max(first, seen.setdefault(digest, last) + 1) if digest in seen else last + 1
        seen.setdefault(digest, last)
        if beyond <= last:
            out.append((units[beyond][0], units[last][1]))
    return out


def marks(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, digest of each run; the digest is null for what recurs within its document."""
    within = CUTS["paragraph" if unit == "paragraph" else "line"]

    def run(batches):
        for b in batches:
            ids, starts, ends, digests = [], [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = t.as_py()
                units = cut(text, CUTS[unit])
                found = [(units[i][0], units[j][1], h) for i, j, h in runs(units, min_words)]
                found += [(a, e, None) for a, e in repeated_within(text, within, min_words)]
                ids += [d] * len(found)
                for a, e, h in found:
                    starts.append(a)
                    ends.append(e)
                    digests.append(h)
            columns = [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "digest"])

    rows = documents(docs).filter("doc_id is not null and text is not null")
    return parallel(rows).mapInArrow(run, "doc_id long, start long, end long, digest binary")


def removed_spans(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end of the runs that another document holds first, or that recur within theirs. They may overlap."""
    rows = materialise(marks(docs, unit, min_words), "units")
    within = rows.filter("digest is null").select("doc_id", "start", "end")
    across = rows.filter("digest is not null")
    first = across.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = materialise(first.filter("first < last").select("digest", "n", "first"), "repeated")
    found = spread_join(across, first, "digest", "n", across.count()).filter("doc_id > first").select("doc_id", "start", "end")
    return found.unionByName(within)


def merged(spans: DataFrame) -> DataFrame:
    """doc_id, spans: each document's spans in order, overlapping ones as one. What is gathered is one document's."""
    s = F.array_sort(F.collect_set(F.struct("start", "end")))
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(held, x):
        last = F.element_at(held, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        whole = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(joined)).cast(kind)
        return F.when((F.size(held) > 0) & (x["start"] <= F.try_element_at(held, F.lit(-1))["end"]), whole).otherwise(F.concat(held, F.array(x)).cast(kind))

    return spans.groupBy("doc_id").agg(s.alias("s")).select("doc_id", F.aggregate("s", F.array().cast(kind), add).alias("spans"))


def per_document(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_removed, chars_removed, removed (start:end, comma-joined, in order): a row for each id of docs."""
    spans = merged(removed_spans(docs, unit, min_words))
    ids = documents(docs).filter("doc_id is not null").select("doc_id").distinct()
    s = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return ids.join(spans, "doc_id", "left").select(
        "doc_id",
        F.size(s).cast("long").alias("n_removed"),
        F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("chars_removed"),
        F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("removed"),
    )


def clean(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the repeated runs, each with the separator after it; all other columns as they are."""
    spans = merged(removed_spans(docs, unit, min_words)).select(F.col("doc_id").alias("__r_id"), F.col("spans").alias("__r_spans"))
    rows = docs.join(spans, F.col("doc_id").cast("long") == F.col("__r_id"), "left").drop("__r_id")
    at, schema, separator = docs.columns.index("text"), docs.schema, CUTS[unit]

    def run(batches):
        for b in batches:
            new = []
            for t, s in zip(b.column(at), b.column(b.num_columns - 1)):
                text = t.as_py()
                if text is not None and s.as_py():
                    held, done = [], 0
                    for x in s.as_py():
                        held.append(text[done : x["start"]])
                        m = separator.match(text, x["end"])
                        done = m.end() if m else x["end"]
                    text = "".join([*held, text[done:]])
                new.append(text)
            columns = list(b.columns[:-1])
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return rows.mapInArrow(run, schema)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, text, regexp_replace(text, '([.!?…。！？])[\x20\t\x0b\x0c\r]', '\1' || chr(10), 'g') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT 'across' AS kind, doc_id, string_split(t, chr(10)) AS p FROM d
  UNION ALL SELECT 'within', doc_id, string_split(text, chr(10)) FROM d
), l AS (
  SELECT kind, doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM p
), o AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY kind, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
         regexp_extract_all(lower(line), '[\p{L}\p{N}]+') AS w FROM l
), u AS MATERIALIZED (
  SELECT kind, doc_id, s, s + length(line) AS e, array_to_string(w, ' ') AS g, len(w) AS n,
         row_number() OVER (PARTITION BY kind, doc_id ORDER BY i) AS k, sum(len(w)) OVER (PARTITION BY kind, doc_id ORDER BY i) AS c
  FROM o WHERE len(w) > 0
), j AS MATERIALIZED (
  SELECT a.kind, a.doc_id, a.k, b.k AS z, a.s, b.e FROM u a ASOF JOIN u b ON a.kind = b.kind AND a.doc_id = b.doc_id AND a.c - a.n + 15 <= b.c
), r AS MATERIALIZED (
  SELECT j.kind, j.doc_id, j.k, j.z, j.s, j.e, string_agg(u.g, ' ' ORDER BY u.k) AS g
  FROM j JOIN u ON u.kind = j.kind AND u.doc_id = j.doc_id AND u.k BETWEEN j.k AND j.z GROUP BY ALL
), f AS (
  SELECT *, min(doc_id) OVER (PARTITION BY kind, g) AS first,
         first_value(k) OVER (PARTITION BY kind, g, doc_id ORDER BY k) AS k0, first_value(z) OVER (PARTITION BY kind, g, doc_id ORDER BY k) AS z0 FROM r
), x AS (
  SELECT doc_id, s, e FROM f WHERE kind = 'across' AND doc_id > first
  UNION SELECT f.doc_id, u.s, f.e FROM f JOIN u ON u.kind = 'within' AND u.doc_id = f.doc_id AND u.k = greatest(f.k, f.z0 + 1)
        WHERE f.kind = 'within' AND f.k > f.k0 AND greatest(f.k, f.z0 + 1) <= f.z
), y AS (
  SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM x
), v AS (
  SELECT *, sum(CASE WHEN s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM y
), m AS (
  SELECT doc_id, min(s) AS s, max(e) AS e FROM v GROUP BY doc_id, island
), t AS (
  SELECT doc_id, count(*) AS n, sum(e - s) AS c, string_agg(CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s) AS t FROM m GROUP BY doc_id
)
SELECT z.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS chars_removed, coalesce(t, '') AS removed
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) z LEFT JOIN t ON t.doc_id = z.doc_id
"""
