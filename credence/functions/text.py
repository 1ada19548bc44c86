"""Text functions: tokens and similarities, normal forms, URLs, spans, costs and rendering."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Types of Arrow functions are objects: workers import this module without a session to parse type names with.
_I, _S = T.IntegerType(), T.StringType()
_SENTENCES = T.ArrayType(T.StructType([T.StructField("index", _I), T.StructField("text", _S), T.StructField("start", _I), T.StructField("end", _I)]))
#: The same tokens in Spark and in SQL engines whose \\w is ASCII.
TOKEN = r"[\p{L}\p{N}_-]+"
URL = r"https?://[^\s<>\"']+"
_EMPTY = lambda: F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


#: Characters whose capital is several letters by the full mapping of Unicode, and their one-letter capitals (themselves if none).
_FULL = [c for c in map(chr, range(0x80, 0x20000)) if len(c.upper()) > 1]
_SIMPLE = ["\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _FULL]


def simple_upper(text: Column) -> Column:
    """In capitals, one letter for one, as SQL engines without the full mapping have it (\u00df gives \u1e9e, not SS)."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "".join(_FULL), "".join(_SIMPLE)))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")


def set_cosine(a: Column, b: Column) -> Column:
    """|A n B| / sqrt(|A| |B|); 0 if either is empty."""
    n = F.size(a) * F.size(b)
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / F.sqrt(n)).otherwise(F.lit(0.0))


def lexical_similarity(query: Column, text: Column) -> Column:
    return set_cosine(tokens(query), tokens(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def normalized_query(text: Column) -> Column:
    return F.array_join(words(text), " ")


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def normalized_answer(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def answer_phrases(answer: Column, question: Column) -> Column:
    """The phrases that bear an answer: itself, or, for a bare number asked by "how many x", the number with its unit."""
    a = normalized_answer(answer)
    unit = F.regexp_extract(F.lower(F.coalesce(question, F.lit(""))), r"\bhow many\s+([a-z][a-z-]*)", 1)
    full = F.concat_ws(" ", a, unit)
    counted = F.when(unit.endswith("s"), F.array(full, F.concat_ws(" ", a, F.substring(unit, F.lit(1), F.length(unit) - 1)))).otherwise(F.array(full))
    return F.when(a == "", _EMPTY()).when(a.rlike("^[0-9]+$") & (unit != ""), counted).otherwise(F.array(a))


def bears_answer(text: Column, answer: Column, question: Column) -> Column:
    content = normalized_answer(text)
    return F.exists(answer_phrases(answer, question), lambda p: content.contains(p))


def canonical_urls(text: Column, *fields: Column) -> Column:
    """The sorted set of URLs in a text and in fields that are URLs: trailing punctuation off, lower case, no final slash."""
    trim = lambda u: F.rtrim(F.lower(F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")), F.lit("/"))
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + URL), F.lit(0)), trim)
    named = F.transform(F.filter(F.array(*fields) if fields else _EMPTY(), lambda u: F.coalesce(F.lower(u).rlike("^https?://"), F.lit(False))), trim)
    return F.array_sort(F.array_distinct(F.filter(F.concat(found, named), lambda u: u != "")))


def evidence_content(text: Column, *ids: Column) -> Column:
    """Evidence text without identifiers and URLs, lower case, each run of white space one space."""
    out = F.coalesce(text, F.lit(""))
    for i in ids:
        out = F.when(F.coalesce(i, F.lit("")) != "", F.replace(out, i, F.lit(" "))).otherwise(out)
    out = F.regexp_replace(out, r"(?i)\b(?:call|tool|toolu|result)[_-][a-z0-9_-]+\b", " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(out, "(?i)" + URL, " ")), r"\s+", " "))


def sanitize_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def domain(url: Column) -> Column:
    """The authority of a URL, port included."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def trimmed_span(text: Column, start: Column, end: Column) -> Column:
    """A span (0-based, end exclusive) without white space at its ends; still exact offsets."""
    cut = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    left = F.length(cut) - F.length(F.regexp_replace(cut, r"^\s+", ""))
    kept = F.length(F.regexp_replace(F.regexp_replace(cut, r"^\s+", ""), r"\s+$", ""))
    return F.struct((start + left).cast("long").alias("start"), (start + left + kept).cast("long").alias("end"))


#: A tag of markup. Fixed value.
TAG = r"</?[A-Za-z][A-Za-z0-9_]*(?:\s+[^<>]*?)?\s*/?>"


def is_pure_tag(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, TAG, "")) == ""


def clean_entities(entities: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(entities, lambda x: F.trim(x)), lambda e: F.coalesce(e != "", F.lit(False))))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, half-even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(F.coalesce(text, F.lit(""))) / 4.0, 0).cast("long"))


def estimate_agent_tokens(text: Column, images: Column) -> Column:
    return (F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4.0) + F.coalesce(images, F.lit(0)) * F.lit(1200)).cast("long")


def is_search(method: Column, query: Column) -> Column:
    return F.coalesce(method == "rule_tool_call", F.lit(False)) | query.isNotNull()


def node_line(id_: Column, text: Column, confidence: Column, search: Column) -> Column:
    line = F.concat(F.lit("- [B"), id_.cast("string"), F.lit("] "), F.trim(text))
    return F.when(search, line).otherwise(F.concat(line, F.format_string(" (confidence %.2f)", F.coalesce(confidence, F.lit(0.5)))))


def node_cost(id_: Column, text: Column, confidence: Column, search: Column) -> Column:
    return (F.length(node_line(id_, text, confidence, search)) + 1).cast("long")


def is_empty_search(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?i)^The (?:web_search|\S+ tool) (?:tool )?returned no results")


def is_instruction(text: Column) -> Column:
    """Instructions on format and execution, which aren't constraints on evidence. Fixed values."""
    t = F.lower(F.trim(text))
    return t.contains("web_search") | t.contains("final answer") | t.startswith("external evidence ") | t.startswith("the response must ")


def parsed_date(text: Column) -> Column:
    """The first of five formats that fits, after a weekday in brackets is dropped; null otherwise. Fixed formats."""
    t = F.trim(F.regexp_replace(text, r"\s*\([A-Za-z]+\)\s*", " "))
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")))


def optional_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes", "y", "on"), True).when(t.isin("false", "0", "no", "n", "off", ""), False)


def int_list(values: Column) -> Column:
    """The whole numbers among an array of texts, each once, in order; null or missing arrays are empty."""
    numbers = F.transform(F.coalesce(values, _EMPTY()), lambda v: F.trim(v).try_cast("long"))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull()))


def query_terms(text: Column, stop_words: list[str], most: int = 48) -> Column:
    """The last `most` distinct terms of two letters or more, in order of their last occurrence."""
    found = F.regexp_extract_all(nfkc_lower(text), F.lit(r"[\p{L}\p{N}_-]{2,}"), F.lit(0))
    return F.reverse(F.slice(F.array_except(F.array_distinct(F.reverse(found)), F.array(*map(F.lit, stop_words)) if stop_words else _EMPTY()), 1, most))


# -- what built-ins can't express: Arrow batches ---------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def nfkc_lower(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).lower(), na_action="ignore")


@F.pandas_udf(T.StringType())
def gaia_text(text: pd.Series) -> pd.Series:
    """NFKC, lower case, no Unicode punctuation, single spaces."""

    def one(t: str) -> str:
        t = unicodedata.normalize("NFKC", t).strip().lower()
        return " ".join("".join(c for c in t if not unicodedata.category(c).startswith("P")).split())

    return text.map(one, na_action="ignore")


_TERMINATOR = re.compile(r"[.!?;…。！？；]+['\"”’)\]）】」』]*(?=\s|\Z)")
_TAG = re.compile(TAG)
_LEAST = 4


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Exact spans of sentences: cut after terminators before space or end, at line feeds and around tags.

    Tags themselves are dropped; within a stretch between tags, a piece of under four characters joins the next one, and
    at the end of a stretch the one before.
    """
    if not text or not text.strip():
        return []
    edges = {len(text)} | {m.end() for m in _TERMINATOR.finditer(text)} | {i + 1 for i, c in enumerate(text) if c == "\n"}
    for m in _TAG.finditer(text):
        edges |= {m.start(), m.end()}
    stretches: list[list[tuple[int, int]]] = [[]]
    at = 0
    for e in sorted(edges):
        piece = text[at:e]
        if body := piece.strip():
            s = at + len(piece) - len(piece.lstrip())
            if _TAG.sub("", body).strip():
                stretches[-1].append((s, s + len(body)))
            else:
                stretches.append([])
        at = max(at, e)
    out = []
    for stretch in stretches:
        done: list[tuple[int, int]] = []
        open_at = None
        for s, e in stretch:
            open_at = s if open_at is None else open_at
            if e - open_at >= _LEAST:
                done.append((open_at, e))
                open_at = None
        if open_at is not None:
            done.append((done.pop()[0] if done else open_at, stretch[-1][1]))
        out += done
    return out


# Texts and sentences stay Arrow columns, one text's are Python objects at a time: those of a batch would fill an executor.
@F.arrow_udf(_SENTENCES)
def split_sentences(text: pa.Array) -> pa.Array:
    number, starts, ends, bounds, pieces = array("i"), array("i"), array("i"), array("i", [0]), []
    for x in text:
        t = x.as_py()
        spans = sentence_spans(t)
        number.extend(range(len(spans)))
        starts.extend([s for s, _ in spans])
        ends.extend([e for _, e in spans])
        pieces.append(pa.array([t[s:e] for s, e in spans], pa.string()))
        bounds.append(len(starts))
    cut = pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())
    ints = [pa.array(v, pa.int32()) for v in (number, starts, ends)]
    values = pa.StructArray.from_arrays([ints[0], cut, *ints[1:]], ["index", "text", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def first_object(text: str | None) -> str | None:
    """The first JSON object in a model's answer, fences or not."""
    if not text:
        return None
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False)
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def parse_json_response(text: pd.Series) -> pd.Series:
    return text.map(first_object, na_action="ignore")


def fuzzy(query: str, text: str) -> float | None:
    """Score of query as a subsequence of text, lower is better; null if it is none. Its numbers are fixed values."""
    q, t = query.lower(), text.lower()

    def walk(want: str) -> float | None:
        score, last, streak, at = 0.0, -1, 0, 0
        for k, c in enumerate(want):
            at = t.find(c, last + 1 if k else 0)
            if at < 0:
                return None
            if last == at - 1:  # also the very first character of the text
                streak += 1
                score -= 5 * streak
            else:
                streak = 0
                score += 2 * (at - last - 1) if last >= 0 else 0
            if at == 0 or t[at - 1] in " \t\n\r\f\v-_./:":
                score -= 10
            score += 0.1 * at
            last = at
        return score - 100 if want and want == t else score

    found = walk(q)
    if found is None and (m := re.fullmatch(r"([a-z]+)([0-9]+)|([0-9]+)([a-z]+)", q)):
        swapped = walk((m[2] + m[1]) if m[1] else (m[4] + m[3]))
        return None if swapped is None else swapped + 5
    return found


@F.arrow_udf(T.DoubleType())
def fuzzy_score(query: pa.Array, text: pa.Array) -> pa.Array:
    """The sum over the query's tokens (cut at spaces and slashes), null if one doesn't match."""

    def one(q, t):
        if q is None or t is None:
            return None
        scores = [fuzzy(x, t) for x in re.split(r"[\s/]+", q.strip()) if x]
        return None if any(s is None for s in scores) else float(sum(scores))

    return pa.array((one(q.as_py(), t.as_py()) for q, t in zip(query, text)), pa.float64())
