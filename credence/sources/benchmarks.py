"""Benchmark files to one table of tasks: task_id, benchmark, question, answers, metadata."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tools that need more than text. Fixed values.
MULTIMODAL = ("image", "vision", "video", "audio", "speech", "ocr", "photo", "picture", "youtube", "microphone", "color recognition")
CANDIDATES = {
    "browsecomp": ("browsecomp.jsonl", "browsecomp.json", "browsecomp.csv", "browsecomp.parquet"), "browsecomp_zh": ("browsecomp_zh.jsonl", "browsecomp_zh.json", "browsecomp_zh.parquet"),
    "hotpotqa": ("hotpotqa.jsonl", "hotpotqa.json", "hotpotqa.parquet"), "mmlu_pro": ("mmlu_pro.jsonl", "mmlu_pro.json", "mmlu_pro.parquet"), "gaia": ("gaia.jsonl", "metadata.jsonl", "gaia.parquet"),
}


def find_file(name: str, root: str, split: str | None = None) -> str:
    """The first candidate that exists, in the split's folder first; an error names all that were tried."""
    folders = [os.path.join(root, name, split or ""), os.path.join(root, name), root]
    tried = [os.path.join(f, c) for f in folders for c in CANDIDATES[name]]
    for p in tried:
        if os.path.exists(p):
            return p
    raise FileNotFoundError(", ".join(tried))


def read_rows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows of .json, .jsonl, .csv or .parquet; a JSON object's rows are under its split, data or examples."""
    kind = path.rsplit(".", 1)[-1]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind == "jsonl":
        return spark.read.json(path)
    rows = spark.read.option("multiLine", True).json(path)
    for key in [split, "data", "examples"]:
        if key and key in rows.columns:
            return rows.select(F.explode(key).alias("r")).select("r.*")
    return rows


def first_of(rows: DataFrame, *names: str) -> Column:
    """The first of the named columns that isn't null, empty or NaN."""
    present = [n for n in names if n in rows.columns]
    return F.coalesce(*(F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in present), F.lit(None).cast("string")) if present else F.lit(None).cast("string")


def metadata_of(rows: DataFrame, used: tuple[str, ...]) -> Column:
    rest = [c for c in rows.columns if c not in used]
    if not rest:
        return F.create_map().cast("map<string,string>")
    pairs = F.create_map(*(x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string") if dict(rows.dtypes)[c] in ("string", "bigint", "int", "double", "boolean") else F.to_json(F.struct(F.col(f"`{c}`"))))))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def _tasks(rows: DataFrame, benchmark: str, task: Column, question: Column, answers: Column, used: tuple[str, ...]) -> DataFrame:
    return rows.select(task.alias("task_id"), F.lit(benchmark).alias("benchmark"), question.alias("question"), F.coalesce(answers, F.array().cast("array<string>")).alias("answers"), metadata_of(rows, used).alias("metadata")).filter("question is not null")


def browsecomp(rows: DataFrame, benchmark: str = "browsecomp") -> DataFrame:
    ids, questions, answers = ("task_id", "id", "ID"), ("input", "question", "Question", "problem", "query"), ("ground_truth_answer", "answer", "Answer", "ground_truth", "expected_answer")
    a = first_of(rows, *answers)
    listed = F.coalesce(F.from_json(a, "array<string>"), F.array(a))
    return _tasks(rows, benchmark, first_of(rows, *ids), first_of(rows, *questions), F.when(a.isNull(), F.array().cast("array<string>")).when(a.startswith("["), listed).otherwise(F.array(a)), ids + questions + answers)


def hotpotqa(rows: DataFrame) -> DataFrame:
    a = first_of(rows, "answer", "Answer")
    return _tasks(rows, "hotpotqa", first_of(rows, "_id", "id"), first_of(rows, "question", "Question"), F.when(a.isNotNull(), F.array(a)), ("_id", "id", "question", "Question", "answer", "Answer"))


def choice_letter(answer: Column, options: Column) -> Column:
    """A letter from a letter, a 0-based place, or an option's text."""
    a = F.trim(answer)
    at = F.array_position(options, a)
    letter = lambda i: F.char((F.lit(65) + i).cast("int"))
    return F.when(F.upper(a).rlike("^[A-J]$"), F.upper(a)).when(a.rlike("^[0-9]$"), letter(a.try_cast("int"))).when(at > 0, letter(at - 1))


def mmlu_pro(rows: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("options", lambda v, i: F.concat(F.char((F.lit(65) + i).cast("int")), F.lit(". "), v)), "\n")
    letter = F.coalesce(choice_letter(first_of(rows, "answer"), F.col("options")), choice_letter(first_of(rows, "answer_index"), F.col("options")))
    return _tasks(rows, "mmlu_pro", first_of(rows, "question_id", "id"), F.concat(first_of(rows, "question"), F.lit("\n"), lines), F.when(letter.isNotNull(), F.array(letter)), ("question_id", "id", "question", "options", "answer", "answer_index"))


def needs_more_than_text(tools: Column) -> Column:
    low = F.lower(F.coalesce(tools, F.lit("")))
    return F.exists(F.array(*map(F.lit, MULTIMODAL)), lambda m: low.contains(m))


def gaia(rows: DataFrame, level: int | None = None, text_only: bool = False) -> DataFrame:
    meta = next((c for c in ("Annotator Metadata", "annotator_metadata") if c in rows.columns), None)
    tools = F.col(f"`{meta}`.Tools").cast("string") if meta and "struct" in dict(rows.dtypes)[meta] else F.lit(None).cast("string")
    if level is not None:
        rows = rows.filter(F.col("Level").cast("string") == str(level))
    if text_only:
        rows = rows.filter(~needs_more_than_text(tools) & (F.coalesce(first_of(rows, "file_name"), F.lit("")) == ""))
    a = first_of(rows, "Final answer", "final_answer", "answer")
    return _tasks(rows, "gaia", first_of(rows, "task_id", "id"), first_of(rows, "Question", "question"), F.when(a.isNotNull() & (a != "?"), F.array(a)), ("task_id", "id", "Question", "question", "Final answer", "final_answer", "answer"))


LOADERS = {"browsecomp": browsecomp, "browsecomp_zh": lambda r: browsecomp(r, "browsecomp_zh"), "hotpotqa": hotpotqa, "mmlu_pro": mmlu_pro, "gaia": gaia}


def load(spark: SparkSession, name: str, root: str, split: str | None = None, data_file: str | None = None, **options) -> DataFrame:
    """Tasks of a benchmark; an empty result is an error."""
    if name not in LOADERS:
        raise KeyError(name)
    tasks = LOADERS[name](read_rows(spark, data_file or find_file(name, root, split), split), **options)
    if tasks.isEmpty():
        raise ValueError(f"{name}: no tasks")
    return tasks
