"""Filter interaction audit: what each filter removes, alone, after others and in every order.

Five filters judge a text; a document's failures are a mask of five bits. Everything an order of filters does follows from
how many documents of a part have each of the 32 masks, so a part is three histograms of 32 masks: of all its documents, of
those labelled good, of those labelled toxic. Stacked as rows they are multiplied by four constant integer matrices of 32
masks by 600 outcomes (120 orders of five steps):

* kept: a 1 where the mask fails none of the order's filters up to the step,
* removed: where it fails the step's filter and none before,
* redundant: where it fails the step's filter and an earlier one,
* unique: where the step's filter is all it fails.

The labels' rows times `removed` give the good and toxic documents lost; `removed` summed over the orders of a filter gives
its Shapley value times 120.

Masks are made where the text is read: only id, part, mask, digest and labels go on. Whether a smaller id has the same text
is asked by the text's digest: digests of one document end at the first aggregation, those of very common texts are dealt
out (`spread_join`). Counts are aggregated before they are shuffled; a part's histograms are one row.

Nulls and edges: a null text is empty; a null part is the empty string; a row without an id never fails for being a copy and
makes no copies; rows of one id are documents of their own, none a copy of another of that id; a document labelled more
than once is good (toxic) if any of its labels says so, labels without an id count nowhere; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from credence.llm.common import materialise, parallel, spread_join

FILTERS = "ABCDE"
#: What fails A, B, C: fewer words; fewer distinct words in a hundred; more capitals in a hundred characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(x) for x in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
OUTCOMES = len(ORDERS) * STEPS
#: So many parts are multiplied at a time; their rows are one Arrow batch.
PARTS = 32
_CAPITALS = bytes(range(65, 91))
_CONTINUATIONS = bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(rb"[#$%&*|]")
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def matrices() -> dict[str, np.ndarray]:
    """The 32-by-600 matrices of kept, removed, redundant and unique outcomes; column = order * 5 + step."""
    bits = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    own = bits.reshape(1, OUTCOMES)
    before = (np.cumsum(bits, 1) - bits).reshape(1, OUTCOMES)
    masks = np.arange(MASKS)[:, None]
    fails, early = (masks & own) > 0, (masks & before) > 0
    found = {"kept": ~fails & ~early, "removed": fails & ~early, "redundant": fails & early, "unique": masks == own}
    return {k: v.astype(np.int64) for k, v in found.items()}


def outcomes(histograms: np.ndarray) -> dict[str, np.ndarray]:
    """parts x 3 x 32 histograms (all, good, toxic) times the matrices: parts x 600 for each count."""
    m, n = matrices(), len(histograms)
    stacked = histograms.reshape(3 * n, MASKS)
    removed = (stacked @ m["removed"]).reshape(n, 3, OUTCOMES)
    filters = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    each = removed[:, 0] @ (filters[:, None] == np.arange(STEPS)).astype(np.int64)
    everyone = histograms[:, 0]
    return {
        "kept": everyone @ m["kept"], "removed": removed[:, 0], "redundant": everyone @ m["redundant"], "unique_fails": everyone @ m["unique"],
        "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": each[:, filters],
    }


def own_mask(text: bytes) -> int:
    """The failures of a UTF-8 text that need no other text: A to D."""
    words = text.split()
    a = len(words) < LEAST_WORDS
    b = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    c = 100 * capitals > MOST_CAPITALS * len(text.translate(None, _CONTINUATIONS))
    d = _SYMBOL.search(text) is not None
    return a | b << 1 | c << 2 | d << 3


def judged(docs: DataFrame, part_col: str = "source") -> DataFrame:
    """doc_id, part, mask (without copies), digest of each row of docs."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            masks, digests = [], []
            for t in texts:
                raw = t.as_py()
                masks.append(own_mask(raw))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    return parallel(rows).mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def histograms(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """part, cells: the counts (mask, n, good, toxic) of its masks, 32 at most."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    none = F.lit(0).cast("int")
    rows = judged(docs, part_col).join(known, "doc_id", "left").withColumns({c: F.coalesce(c, none) for c in ("good", "toxic")})
    rows = materialise(rows, "judged")
    first = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = materialise(first.filter("first < last").select("digest", "n", "first"), "same-text")
    copies = _counted(spread_join(rows, first, "digest", "n", rows.count()).filter("doc_id > first"))
    cells = (
        _counted(rows)
        .unionByName(copies.withColumns({c: -F.col(c) for c in ("n", "good", "toxic")}))
        .unionByName(copies.withColumn("mask", F.col("mask").bitwiseOR(F.lit(COPY))))
        .groupBy("part", "mask")
        .agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    )
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def interactions(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """The counts of every part, order and step; zeros included."""
    orders = pa.array([o for o in ORDERS for _ in range(STEPS)])
    steps = pa.array(list(range(1, STEPS + 1)) * len(ORDERS), pa.int32())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, PARTS):
                part = b.slice(at, PARTS)
                held = np.zeros((part.num_rows, 3, MASKS), np.int64)
                for i, cells in enumerate(part.column("cells").to_pylist()):
                    for x in cells:
                        held[i, :, x["mask"]] = x["n"], x["good"], x["toxic"]
                found = outcomes(held)
                names = part.column("part").take(pa.array(np.repeat(np.arange(part.num_rows), OUTCOMES)))
                columns = [names, pa.concat_arrays([orders] * part.num_rows), pa.concat_arrays([steps] * part.num_rows)]
                columns += [pa.array(found[c].reshape(-1)) for c in _COUNTS]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *_COUNTS])

    return histograms(docs, labels, part_col).mapInArrow(run, RESULT)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, d.doc_id, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), h AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), c AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c1.x || d1.x || e.x AS filter_order FROM c a, c b, c c1, c d1, c e
  WHERE a.x <> b.x AND c1.x NOT IN (a.x, b.x) AND d1.x NOT IN (a.x, b.x, c1.x) AND e.x NOT IN (a.x, b.x, c1.x, d1.x)
), s AS (
  SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own, list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), j AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS now,
    step > 1 AND list_bool_or(list_transform(before, lambda i: CASE WHEN i < 1 THEN false ELSE fails[i] END)) AS early,
    fails[own] AND len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM h, s
), r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT now AND NOT early), 0) AS kept, coalesce(sum(n) FILTER (now AND NOT early), 0) AS removed,
    coalesce(sum(n) FILTER (now AND early), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (now AND NOT early), 0) AS good_lost, coalesce(sum(toxic) FILTER (now AND NOT early), 0) AS toxic_lost
  FROM j GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
