"""Tool calls and tool results in message texts: found, parsed and rendered with built-in functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from credence.functions.text import domain

CALL_BLOCK = r"(?is)<tool_call>\s*(.*?)\s*</tool_call>"
RESULT_BLOCK = r"(?is)<tool_result>\s*(.*?)\s*</tool_result>"
#: The header of the older form of a result. Fixed value.
LEGACY_HEADER = r"(?is)^\s*\[Tool result:\s*([^\]]+)\]\s*(.*)$"
NO_RESULTS = "no web results were returned"


def _objects(content: Column, block: str) -> Column:
    """The JSON objects of all blocks as variants; what isn't an object is dropped."""
    raw = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(block), F.lit(1))
    return F.filter(F.transform(raw, F.try_parse_json), lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))


def _text(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "string")
    return F.nullif(F.trim(x), F.lit(""))


def tool_calls(content: Column) -> Column:
    """Structs (id, name, query, arguments) of the valid calls in order."""
    return F.transform(
        _objects(content, CALL_BLOCK),
        lambda v: F.struct(
            _text(v, "$.id").alias("id"), F.coalesce(_text(v, "$.name"), F.lit("tool")).alias("name"),
            F.coalesce(_text(v, "$.arguments.query"), _text(v, "$.arguments.q")).alias("query"), F.try_variant_get(v, "$.arguments", "string").alias("arguments"),
        ),
    )


def query_calls(content: Column) -> Column:
    return F.filter(tool_calls(content), lambda c: c["query"].isNotNull())


def is_pure_tool_call(content: Column) -> Column:
    """Nothing but valid call blocks, and at least one."""
    blocks = F.regexp_count(F.coalesce(content, F.lit("")), F.lit(CALL_BLOCK))
    return (blocks > 0) & (F.size(tool_calls(content)) == blocks) & ~F.regexp_replace(content, CALL_BLOCK, "").rlike(r"\S")


@F.pandas_udf(T.StringType())
def strip_valid_tool_calls(content: pd.Series) -> pd.Series:
    """The text without the blocks that hold a JSON object; broken blocks stay."""

    def keep(m: re.Match) -> str:
        try:
            return "" if isinstance(json.loads(m[1]), dict) else m[0]
        except ValueError:
            return m[0]

    return content.map(lambda t: re.sub(CALL_BLOCK, keep, t).strip(), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def tool_call_spans(content: pd.Series) -> pd.Series:
    return content.map(lambda t: [{"start": m.start(), "end": m.end()} for m in re.finditer(r"(?is)<tool_call>.*?</tool_call>", t)] if isinstance(t, str) else [])


def call_belief(name: Column, query: Column, arguments: Column) -> Column:
    """The sentence that stands for a call in the graph. Fixed wording."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(query, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    with_query = F.concat(F.lit("The assistant called "), name, F.lit(" with query "), quoted, F.lit("."))
    with_arguments = F.concat(F.lit("The assistant called "), name, F.lit(" with arguments "), F.coalesce(arguments, F.lit("{}")), F.lit("."))
    return F.when(query.isNotNull(), with_query).otherwise(with_arguments)


def _field(block: Column, name: str) -> Column:
    value = F.regexp_extract(block, rf"(?ms)^{name}:\s*(.*?)(?=^[A-Za-z][A-Za-z ]*:\s|\z)", 1)
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def search_items(body: Column) -> Column:
    """Structs (rank, title, url, snippet, source_type) of the "[n] ..." blocks of a result body."""
    marked = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?m)^\[(\d+)\]\s+", "\u0001$1\u0002")
    blocks = F.slice(F.split(marked, "\u0001"), F.lit(2), F.greatest(F.size(F.split(marked, "\u0001")) - 1, F.lit(0)))

    def one(b: Column) -> Column:
        rank, text = F.substring_index(b, "\u0002", 1), F.trim(F.substring_index(b, "\u0002", -1))
        title = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?ms)\A(.*?)(?=^(?:URL|Snippet|Source type):|\z)", 1), r"\s+", " "))
        return F.struct(
            F.try_to_number(rank, F.lit("999999999")).cast("long").alias("rank"), F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Result "), rank)).alias("title"),
            F.nullif(F.trim(F.regexp_extract(text, r"(?m)^URL:\s*(\S.*)$", 1)), F.lit("")).alias("url"), _field(text, "Snippet").alias("snippet"), _field(text, "Source type").alias("source_type"),
        )

    return F.transform(blocks, one)


def tool_results(content: Column) -> Column:
    """Structs (tool_name, tool_call_id, is_error, body) of the result blocks; blocks without a JSON object are skipped."""
    return F.transform(
        _objects(content, RESULT_BLOCK),
        lambda v: F.struct(
            F.coalesce(_text(v, "$.name"), _text(v, "$.tool_name"), F.lit("tool")).alias("tool_name"), F.coalesce(_text(v, "$.tool_call_id"), _text(v, "$.id")).alias("tool_call_id"),
            F.coalesce(F.try_variant_get(v, "$.is_error", "boolean"), F.lit(False)).alias("is_error"), F.coalesce(F.try_variant_get(v, "$.content", "string"), F.lit("")).alias("body"),
        ),
    )


def tool_result(content: Column) -> Column:
    """The one result of a message: of its only block, else of the older header form; null if there are several or none."""
    found = tool_results(content)
    name, body = F.trim(F.regexp_extract(content, LEGACY_HEADER, 1)), F.trim(F.regexp_extract(content, LEGACY_HEADER, 2))
    legacy = F.struct(F.coalesce(F.nullif(name, F.lit("")), F.lit("tool")).alias("tool_name"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(False).alias("is_error"), body.alias("body"))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when((F.size(found) == 0) & F.coalesce(content, F.lit("")).rlike(LEGACY_HEADER), legacy)


def _cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def compact_items(items: Column, max_results: int, max_snippet_chars: int) -> Column:
    n, c = max(1, max_results), max(40, max_snippet_chars)
    return F.transform(F.slice(items, 1, n), lambda r: r.withField("snippet", F.nullif(_cut(F.trim(r["snippet"]), c), F.lit(""))))


def compact_result(tool_name: Column, body: Column, items: Column, max_results: int = 3, max_snippet_chars: int = 280) -> Column:
    """Struct (text, items, entities): a bounded sentence for a result. Fixed wording."""
    kept = compact_items(items, max_results, max_snippet_chars)
    line = lambda r: F.concat(
        r["rank"].cast("string"), F.lit(". "), r["title"], F.when(r["snippet"].isNotNull(), F.concat(F.lit(" — "), r["snippet"])).otherwise(""), F.when(r["url"].isNotNull(), F.concat(F.lit(" ("), r["url"], F.lit(")"))).otherwise("")
    )
    omitted = F.size(items) - F.size(kept)
    rest = F.when(omitted > 0, F.concat(F.lit(" "), omitted.cast("string"), F.lit(" additional result(s) are retained only in evidence."))).otherwise("")
    some = F.concat(F.lit("The "), tool_name, F.lit(" tool returned "), F.size(items).cast("string"), F.lit(" result(s). The bounded graph summary contains:\n"), F.array_join(F.transform(kept, line), "\n"), rest)
    none = F.concat(F.lit("The "), tool_name, F.lit(" tool returned no results."))
    flat = _cut(F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " ")), max(1, max_results) * max(40, max_snippet_chars))
    plain = F.concat(F.lit("The "), tool_name, F.lit(" tool returned: "), F.coalesce(F.nullif(flat, F.lit("")), F.lit("(empty result)")))
    text = F.when(F.size(items) > 0, some).when(F.lower(F.coalesce(body, F.lit(""))).contains(NO_RESULTS), none).otherwise(plain)
    hosts = F.filter(F.transform(kept, lambda r: domain(r["url"])), lambda d: F.coalesce(d != "", F.lit(False)))
    return F.struct(text.alias("text"), kept.alias("items"), F.array_distinct(F.concat(F.array(tool_name), hosts)).alias("entities"))


def observation_body(body: Column, is_error: Column) -> Column:
    """Plain non-error output becomes one ranked observation. Fixed wording."""
    ranked = F.coalesce(body, F.lit("")).rlike(r"(?m)^\[\d+\]\s+")
    return F.when(is_error | ranked | (F.trim(F.coalesce(body, F.lit(""))) == ""), body).otherwise(F.concat(F.lit("[1] Observation\nSnippet: "), F.trim(body)))
