"""Near-duplicates by an inverted join on MinHash signature coordinates.

A document's set holds the hashes of its distinct five-word shingles. Equal sets collapse to one representative by a
digest, so copies cost nothing more. A representative's signature of COORDINATES minima is a set of as many
(coordinate, value) tokens; two sets of resemblance s share each token with probability s.

* Posting: sets are listed under each of their tokens, and tokens are counted. A token of one set can't collide and is
  dropped at once.
* Prefix: a pair above the match threshold MATCHES shares one of the COORDINATES - MATCHES + 1 rarest tokens of both
  (by count, then token), so only those are posted. A set with that many tokens of its own has no candidates.
* Skip merging: a list whose sets all belong to one component is skipped from then on. Instead of all pairs of a
  list, its sets first meet the list's hub, the set whose tokens are the most frequent (in a group of copies
  with edits: the one nearest to all others). Confirmed links merge components, and the lists are looked at again.
* The rest: sets of lists that are still open after HUB_ROUNDS rounds meet on prefixes of their shingles,
  rarest first, across components only. A pair that shares its first prefix shingle at places p and q has at
  most 1 + min(n - p, m - q) shingles in common; one that can't reach the threshold is never made. Of a shingle's list,
  the largest component's sets never meet one another.
* Counting: every candidate pair goes on if its signatures collide in MATCHES coordinates or more, and is confirmed on
  the full sets.

Lists of hot tokens and shingles are dealt out over several tasks (`spread_join`).

With 64 coordinates and a match threshold of 32, a pair of resemblance 0.75 is missed with probability 5e-6 (binomial
tail); every reported link is exact.

Nulls and edges: a null or wordless text has an empty set and is linked with nothing; fewer than five words are one
shingle; rows with a null id are left out; repeated rows of one id are one document: it is linked with all that any of
its texts is linked with, and its rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from credence.llm.common import documents, materialise, parallel, shingle_hashes, spread_join

COORDINATES, MATCHES = 64, 32
HUB_ROUNDS = 2
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 32-bit minima of COORDINATES hash functions over a set that isn't empty."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 256):
        x = shingles[None, a : a + 256] * _A[:, None]
        x += _B[:, None]
        x ^= x >> np.uint64(31)
        x *= _MIX
        np.minimum(low, x.min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (16 bytes; null if empty), signature (array of ints; null if empty)."""

    def run(batches):
        for b in batches:
            n, digest, sig = [], [], []
            for t in b.column("text"):
                s = shingle_hashes(t.as_py())
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "digest", "signature"])

    return parallel(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature array<int>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, shingles (sorted distinct 64-bit hashes) of the rows (node, digest, text) whose set has that digest."""

    def run(batches):
        for b in batches:
            nodes, sets = [], []
            for node, digest, t in zip(b.column("node").to_pylist(), b.column("digest").to_pylist(), b.column("text")):
                s = shingle_hashes(t.as_py())
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                    nodes.append(node)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "digest", "text").mapInArrow(run, "node long, shingles array<long>")


def _prefixes(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """token, node, weight (how frequent all of the set's tokens are) of the posted tokens."""
    token = (F.col("c").cast("long") * F.lit(1 << 32) + F.col("v").cast("long")).alias("token")
    tokens = classes.select("node", F.posexplode("signature").alias("c", "v")).select("node", token)
    counts = materialise(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "tokens")
    shared = spread_join(tokens, counts.withColumn("rows", F.col("n")), "token", "rows", coordinates * classes.count())
    rows = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"), F.sum("n").alias("weight"))  # `coordinates` entries at most
    # Tokens of its own, which aren't here, are its rarest: they take the first places of the prefix.
    left = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("t"))
    rows = rows.filter(left > 0).select("node", "weight", F.slice("t", 1, left).alias("t"))
    return rows.select("node", "weight", F.explode("t.token").alias("token"))


def _agree(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike: by signature first, then in full."""
    s = lambda x: sigs.select(F.col("node").alias(x), F.col("signature").alias("s" + x), F.col("n_shingles").alias("n" + x))
    near = pairs.join(s("a"), "a").join(s("b"), "b")
    near = near.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_agree("sa", "sb") >= matches)).select("a", "b", "na", "nb")
    near = materialise(near, "near")
    # Only what still has candidates has its set read; the same side of many pairs is one hash-join key.
    full = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias("f" + x))
    both = near.join(full("a"), "a").join(full("b"), "b")
    common = F.size(F.array_intersect("fa", "fb"))
    return both.filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each one reaches. Minimum labels with pointer jumping, until nothing changes.

    nodes: node, comp (a first labelling: the smallest node of an earlier component); links: a, b between nodes.
    """
    labels = nodes.select("node", "comp")
    while True:
        c = labels.select(F.col("node").alias("k"), "comp")
        at_a = links.join(c, F.col("a") == F.col("k")).select("b", F.col("comp").alias("ca"))
        edges = at_a.join(c, F.col("b") == F.col("k")).select("ca", F.col("comp").alias("cb")).filter("ca <> cb")
        edges = materialise(edges.select(F.greatest("ca", "cb").alias("high"), F.least("ca", "cb").alias("low")).distinct(), "edges")
        if edges.isEmpty():
            return labels
        labels = materialise(_relabelled(labels, edges), "labels")


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each component takes the smallest neighbour below it; chains of such steps are followed to their roots."""
    parent = materialise(edges.groupBy(F.col("high").alias("child")).agg(F.min("low").alias("parent")), "parents")
    while True:
        up = parent.select(F.col("child").alias("c2"), F.col("parent").alias("p2"))
        jumped = materialise(parent.join(up, F.col("parent") == F.col("c2"), "left").select("child", F.coalesce("p2", "parent").alias("parent"), F.col("p2").isNotNull().alias("moved")), "parents")
        parent, moved = jumped.select("child", "parent"), jumped.filter("moved")
        if moved.isEmpty():
            break
    return labels.join(parent, F.col("comp") == F.col("child"), "left").select("node", F.coalesce("parent", "comp").alias("comp"))


def _open_lists(posted: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """The postings of lists whose sets lie in more than one component. total: how many postings there are."""
    rows = posted.join(labels, "node")
    mixed = rows.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).filter("c0 <> c1")
    return spread_join(rows, mixed.select("token", "n"), "token", "n", total)


def _hub_pairs(lists: DataFrame, labels: DataFrame, total: int, again: bool) -> DataFrame:
    """Pairs (a, b) of each list's hub with the list's sets of other components; `again`: with a second hub."""
    choose = [F.max(F.struct("weight", -F.col("node"))).alias("h"), F.count("*").alias("n")]
    hubs = lists.groupBy("token").agg(*choose)
    comps = labels.select(F.col("node").alias("hub"), F.col("comp").alias("hc"))
    if again:  # a hub from outside the component that the first hub gathered
        first = hubs.select("token", "n", (-F.col("h.col2")).alias("hub")).join(comps, "hub")
        hubs = spread_join(lists, first.select("token", "n", "hc"), "token", "n", total).filter("comp <> hc").groupBy("token").agg(*choose).drop("n")
        hubs = hubs.join(first.select("token", "n"), "token")
    hubs = materialise(hubs.select("token", "n", (-F.col("h.col2")).alias("hub")).join(comps, "hub"), "hubs")
    met = spread_join(lists, hubs, "token", "n", total).filter("comp <> hc")
    return met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))


def _rest(open_sets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components that prefixes of full sets can't rule out. open_sets: node, comp.

    Of two sets the smaller one (by size, then node) needs only the first n - ceil(2t / (1 + t) n) + 1 of its shingles,
    the other n - ceil(t n) + 1, t the threshold.
    """
    rows = materialise(sets.join(open_sets, "node").select("node", "comp", F.explode("shingles").alias("g")), "shingles")
    counts = materialise(rows.groupBy("g").agg(F.count("*").alias("f")), "frequencies")
    shared = spread_join(rows, counts.withColumn("rows", F.col("f")), "g", "rows", rows.count())
    ranked = shared.groupBy("node", "comp").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("s"))  # one document's set
    n = F.size("s")
    probe = n - F.ceil(n * percent / 100.0 - 1e-9) + 1
    index = n - F.ceil(n * 2.0 * percent / (100.0 + percent) - 1e-9) + 1
    posted = ranked.select("node", "comp", n.alias("n"), index.alias("index"), F.posexplode(F.slice("s", F.lit(1), probe.cast("int"))).alias("p", "x")).filter("x.f > 1")
    posted = materialise(posted.select("node", "comp", "n", "index", (F.col("p") + 1).alias("p"), F.col("x.g").alias("g")), "rest")
    # Each list's largest component, and in how many places the list is dealt.
    by_comp = posted.groupBy("g", "comp").agg(F.count("*").alias("k"))
    lists = by_comp.groupBy("g").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("comps"), F.sum("k").alias("size")).filter("comps > 1").select("g", "main", "size")
    posted = materialise(spread_join(posted, lists.withColumn("rows", F.col("size")), "g", "rows", posted.count()), "rest")
    many = 4096
    parts = F.ceil(F.col("size") / many).cast("int")
    # Sets outside the list's largest component meet all others; what is dealt out is the whole list.
    asking = posted.filter("comp <> main").select("g", "node", "comp", "n", "p", "index", F.explode(F.sequence(F.lit(0), parts - 1)).alias("place"))
    whole = posted.select(F.col("g").alias("h"), F.col("node").alias("y"), F.col("comp").alias("cy"), "main", F.col("n").alias("m"), F.col("p").alias("q"), F.col("index").alias("index_y"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("at"))
    smaller = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("y")))
    reach = (100 + percent) * (1 + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q"))) >= percent * (F.col("n") + F.col("m"))
    sized = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    short = F.when(smaller, F.col("p") <= F.col("index")).otherwise(F.col("q") <= F.col("index_y"))
    once = (F.col("cy") == F.col("main")) | (F.col("node") < F.col("y"))  # two outsiders ask each other
    pairs = asking.join(whole, (F.col("g") == F.col("h")) & (F.col("place") == F.col("at")) & (F.col("comp") != F.col("cy")) & once & sized & short & reach)
    return pairs.select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b"))


def link(docs: DataFrame, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs that has an id."""
    rows = documents(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    sigs = materialise(signatures(rows), "signatures")
    some = sigs.filter(F.col("digest").isNotNull())
    # A class of equal sets is one node; its number is given once, as the table is written.
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    posted = materialise(_prefixes(classes, coordinates, matches), "posted")
    total = posted.count()
    involved = materialise(posted.select("node").distinct().join(classes, "node"), "involved")
    near = involved.select("node", "signature", "n_shingles")
    wanted = involved.select("node", "digest", "low")
    sets = materialise(shingle_sets(rows.join(wanted, F.col("doc_id") == F.col("low"))).dropDuplicates(["node"]), "sets")
    labels = involved.select("node", F.col("node").alias("comp"))
    done = None
    for k in range(HUB_ROUNDS + 1):
        lists = posted.withColumn("comp", F.col("node"))
        if k:
            lists = materialise(_open_lists(posted, labels, total), "open")
            if lists.isEmpty():
                break
        pairs = _hub_pairs(lists, labels, total, k > 0) if k < HUB_ROUNDS else _rest(lists.select("node", "comp").distinct(), sets, percent)
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        if pairs.isEmpty():
            continue
        done = pairs if done is None else done.unionByName(pairs)
        links = materialise(_confirmed(pairs, near, sets, matches, percent), "links")
        labels = components(labels, links)
    return _by_row(sigs, classes, _joined_by_id(some, classes, labels))


def _joined_by_id(some: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, with the components of all texts of one id made one."""
    twice = some.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("d0 <> d1").select("doc_id")
    twice = materialise(twice, "twice")
    if twice.isEmpty():
        return labels
    mine = some.join(twice, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "node"), "digest")
    # A document's nodes in a chain; what is gathered is one document's texts.
    chain = mine.groupBy("doc_id").agg(F.array_sort(F.collect_set("node")).alias("s")).select(F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s")).alias("b"))).alias("x"))
    links = materialise(chain.select("x.a", "x.b"), "links")
    more = mine.select("node", F.col("node").alias("comp")).distinct().join(labels, "node", "left_anti")
    return components(materialise(labels.unionByName(more), "labels"), links)


def _by_row(sigs: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Back to all rows: by class, then by component; a class without candidates is its own."""
    known = labels.join(classes.select("node", "low"), "node")
    lowest = known.groupBy("comp").agg(F.min("low").alias("lowest"))
    known = materialise(known.select("node", "comp").join(lowest, "comp").select("node", "lowest"), "components")
    by_class = classes.select("digest", "node", "low").join(known, "node", "left").select(F.col("digest").alias("c_digest"), F.coalesce("lowest", "low").alias("comp"))
    out = sigs.select("doc_id", "n_shingles", "digest").join(by_class, F.col("digest") == F.col("c_digest"), "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), (F.col("doc_id") == comp).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, all its columns as they are: the one with the smallest id.

    Rows without an id can't be compared and stay. Repeated rows of one id: the one of the smallest hash stays.
    """
    kept = link(docs, **options).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    out = docs.join(kept, F.col("doc_id").cast("long") == F.col("__kept"), "left_semi")
    if not docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").isEmpty():
        order = F.xxhash64(*(f"`{x.name}`" for x in docs.schema if not x.dataType.simpleString().startswith("map")))
        one = out.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias("__row"))
        out = one.select("__row.*")
    return out.unionByName(docs.filter(F.col("doc_id").cast("long").isNull()))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, m.component_id = s.doc_id AS kept
FROM s JOIN m ON m.doc_id = s.doc_id
"""
