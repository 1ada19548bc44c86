"""Logs and traces: snapshots, model traces, manifests, session files, search answers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value of text files; numbers follow the order in each file, one file at a time."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return raw.filter(F.trim("value") != "")


def last_snapshot(rows: DataFrame) -> DataFrame:
    """path, value: the last readable JSON object of each file."""
    ok = rows.filter(F.try_parse_json("value").isNotNull())
    return ok.groupBy("path").agg(F.max_by("value", "line_no").alias("value"))


def trace_files(spark: SparkSession, root: str) -> DataFrame:
    """Trace lines of all *.jsonl in folders named model-io, below root."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.col("path").rlike("/model-io/[^/]+$")).orderBy(F.lower("path")).select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).filter(F.trim("value") != "")


def assembled_traces(rows: DataFrame) -> DataFrame:
    """path, call_id, request, response, error: the last line of each kind of a call."""
    v = F.try_parse_json("value")
    parsed = rows.select("path", "line_no", "value", F.try_variant_get(v, "$.call_id", "string").alias("call_id"), F.try_variant_get(v, "$.type", "string").alias("type"))
    kinds = ("request", "response", "error")
    pick = lambda k: F.max_by(F.when(F.col("type") == k, F.col("value")), F.when(F.col("type") == k, F.col("line_no"))).alias(k)
    return parsed.filter(F.col("call_id").isNotNull() & F.col("type").isin(*kinds)).groupBy("path", "call_id").agg(*(pick(k) for k in kinds))


def find_timings(rows: DataFrame, problem_id: str) -> DataFrame:
    """The first line that names a problem, of the newest file: a substring test runs before any JSON is read."""
    near = rows.filter(F.col("value").contains(problem_id))
    ok = near.filter(F.try_variant_get(F.try_parse_json("value"), "$.problem_id", "string") == problem_id)
    return ok.orderBy(F.desc("modified"), "path", "line_no").limit(1)


#: Problem ids in one automaton; more are looked for in several passes.
MOST_IDS = 200_000


def find_all_timings(rows: DataFrame, problems: DataFrame, most_ids: int = MOST_IDS) -> DataFrame:
    """problem_id, path, line_no, value: of each problem (problem_id) the first line that names it, of the newest file.

    A raw line is read once, by an Aho-Corasick automaton of all ids at a time; only lines in which one occurs are parsed, and
    count if it is their problem's. The automaton is made once a task. Of more than `most_ids` problems as many at a time are
    looked for as there are passes. rows: path, line_no, modified, value. Null and empty ids and null lines match nothing.
    """
    from credence.operators.graph import cut

    ids = cut(problems.filter("problem_id <> ''").select("problem_id").distinct(), "problems")
    passes = ids.count() // most_ids + 1
    wanted = ids.withColumn("pass", F.pmod(F.xxhash64("problem_id"), F.lit(passes)).cast("int"))
    schema = T.StructType([*rows.schema.fields, T.StructField("problem_id", T.StringType())])
    found = None
    for k in range(passes):
        needles = [r[0] for r in wanted.filter(F.col("pass") == k).select("problem_id").collect()]  # most_ids and some

        def named(batches, needles=needles):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for x in needles:
                automaton.add_word(x, x)
            if needles:
                automaton.make_automaton()
            for b in batches:
                at, names = [], []
                for i, line in enumerate(b.column("value").to_pylist() if needles else ()):
                    hits = {x for _, x in automaton.iter(line)} if line else ()
                    at += [i] * len(hits)
                    names += hits
                part = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string())], schema.names)

        near = rows.mapInArrow(named, schema)
        ok = near.filter(F.try_variant_get(F.try_parse_json("value"), "$.problem_id", "string") == F.col("problem_id"))
        best = F.min_by(F.struct("path", "line_no", "value"), F.struct(-F.col("modified"), "path", "line_no")).alias("x")
        one = ok.groupBy("problem_id").agg(best).select("problem_id", "x.*")
        found = one if found is None else found.unionByName(one)
    return found


def stream_manifest(trajectories: DataFrame, graphs: DataFrame) -> DataFrame:
    """sample, turns, snapshots, claim: samples with graphs first, then by name."""
    claim = F.regexp_extract("value", r'"claim"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    a = trajectories.groupBy("sample").agg(F.count("*").alias("turns"), F.min_by(F.nullif(claim, F.lit("")), "line_no").alias("claim"))
    b = graphs.groupBy("sample").agg(F.count("*").alias("snapshots"))
    out = a.join(b, "sample", "left").withColumn("snapshots", F.coalesce("snapshots", F.lit(0)))
    return out.orderBy((F.col("snapshots") == 0).cast("int"), "sample")


def session_entries(rows: DataFrame) -> DataFrame:
    """path, line_no, id, parent_id, type, timestamp, entry of session files; invalid lines are skipped."""
    v = F.try_parse_json("value")
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    return rows.filter(v.isNotNull()).select("path", "line_no", get("$.id").alias("id"), get("$.parentId").alias("parent_id"), get("$.type").alias("type"), get("$.timestamp").alias("timestamp"), F.col("value").alias("entry"))


ANSWER = "struct<answerBox:struct<title:string,answer:string,snippet:string,link:string>,knowledgeGraph:struct<title:string,description:string,descriptionLink:string,website:string>,organic:array<struct<title:string,link:string,snippet:string>>>"


def search_evidence(answers: DataFrame, most: int = 10) -> DataFrame:
    """query_id, rank, kind, title, url, snippet: answer box, then knowledge panel, then results; (url, snippet) once."""
    a = answers.select("query_id", F.from_json("body", ANSWER).alias("a"))
    row = lambda kind, t, u, s: F.struct(F.lit(kind).alias("kind"), t.alias("title"), F.coalesce(u, F.lit("")).alias("url"), F.coalesce(s, F.lit("")).alias("snippet"))
    box = F.when(F.col("a.answerBox").isNotNull(), F.array(row("answer", F.col("a.answerBox.title"), F.col("a.answerBox.link"), F.coalesce("a.answerBox.answer", "a.answerBox.snippet"))))
    panel = F.when(F.col("a.knowledgeGraph").isNotNull(), F.array(row("knowledge", F.col("a.knowledgeGraph.title"), F.coalesce("a.knowledgeGraph.descriptionLink", "a.knowledgeGraph.website"), F.col("a.knowledgeGraph.description"))))
    organic = F.transform("a.organic", lambda o: row("organic", o["title"], o["link"], o["snippet"]))
    none = lambda c: F.coalesce(c, F.array().cast("array<struct<kind:string,title:string,url:string,snippet:string>>"))
    flat = a.select("query_id", F.posexplode(F.concat(none(box), none(panel), none(organic))).alias("pos", "e")).select("query_id", "pos", "e.*").filter("url <> '' or snippet <> ''")
    first = Window.partitionBy("query_id", "url", "snippet").orderBy("pos")
    kept = flat.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    return ranked.filter(F.col("rank") <= most).select("query_id", "rank", "kind", "title", "url", "snippet")


def replay_items(tasks: DataFrame, steps: DataFrame, snapshots: DataFrame, traces: DataFrame) -> DataFrame:
    """Tasks by steps by snapshots, each with the longest trace whose text its system prompt contains.

    tasks: task_id, session; steps: session, turn, system_text; snapshots: session, turn, snapshot; traces: session, trace.
    The containment test is confined to a session by an equality, never a product of all.
    """
    rows = tasks.join(steps, "session").join(snapshots, ["session", "turn"])
    best = rows.join(traces, "session").filter(F.col("system_text").contains(F.col("trace"))).groupBy("session", "turn").agg(F.max_by("trace", F.struct(F.length("trace"), "trace")).alias("trace"))
    return rows.join(best, ["session", "turn"], "left")


def timing_key(label: Column) -> Column:
    return F.when(label.startswith("embedding"), "embedding").otherwise(F.split(label, ":")[0])
