"""Answer extraction and the scorers of five benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from credence.functions.text import gaia_text

#: Patterns of a final answer, in order. Fixed values.
FINAL = (r"(?im)^\s*(?:\*\*)?FINAL\s+ANSWER(?:\*\*)?\s*:\s*(.+?)\s*$", r"(?im)^\s*(?:\*\*)?ANSWER(?:\*\*)?\s*:\s*(.+?)\s*$", r"(?is)<answer>\s*(.*?)\s*</answer>")
CHOICE = (r"(?i)\b(?:FINAL\s+ANSWER|ANSWER)\s*:\s*\(?([A-J])\)?\b", r"(?i)\bTHE\s+ANSWER\s+IS\s*\(?([A-J])\)?\b", r"(?i)\\boxed\{\s*([A-J])\s*\}", r"^\s*\(?([A-J])\)?[.\s]*$")
#: Marks of an exhausted quota. Fixed values.
QUOTA = ("insufficient_quota", "quota exceeded", "exceeded your current quota", "billing_hard_limit_reached", "insufficient balance", "rate limit", "rate_limit", "too many requests", "429", "credit balance", "payment required", "402", "resource_exhausted", "usage limit", "out of credits")
#: What is trimmed off answers and lines: the space separators of Unicode.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _last(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def last_line(text: Column, line_end: str = r"\r?\n") -> Column:
    """The last line that isn't blank, trimmed; else empty."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), line_end), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise("")


def final_answer(response: Column, line_end: str = r"\r?\n") -> Column:
    """The last match of the first pattern that matches; else the last line that isn't blank; else empty. line_end: what lines are split by."""
    t = F.trim(F.coalesce(response, F.lit("")), F.lit(SPACES))
    return F.coalesce(*(F.btrim(F.trim(_last(t, p), F.lit(SPACES)), F.lit("`")) for p in FINAL), last_line(t, line_end))


def multiple_choice(response: Column) -> Column:
    a = final_answer(response)
    return F.coalesce(*(F.upper(_last(F.trim(t), p)) for t in (response, a) for p in CHOICE), F.lit(""))


def cleaned_number(text: Column) -> Column:
    t = F.regexp_replace(F.trim(text), "[$,]", "")
    share = t.endswith("%")
    body = F.trim(F.when(share, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    value = F.when(body.rlike(NUMBER), body.try_cast("double"))
    return F.when(share, value / 100).otherwise(value)


def gaia_match(candidate: Column, reference: Column) -> Column:
    """Numbers by value (1e-9), lists item by item, else normalised text."""
    p, t = F.trim(candidate), F.trim(reference)
    number = cleaned_number(t)
    sep = F.when(t.contains(","), ",").when(t.contains(";"), ";")
    cut = lambda x: F.split(x, F.when(sep == ",", ",").otherwise(";"))
    # Normalise once with a separator that normalisation keeps apart: items are compared joined by a letter of their own.
    items = lambda x: gaia_text(F.array_join(F.transform(cut(x), lambda x: F.trim(x)), " \u2063 "))
    listed = (F.size(cut(p)) == F.size(cut(t))) & (items(p) == items(t))
    return F.when(number.isNotNull(), F.coalesce(F.abs(cleaned_number(p) - number) <= 1e-9, F.lit(False))).when(sep.isNotNull(), listed).otherwise(gaia_text(p) == gaia_text(t))


def gaia_correct(response: Column, reference: Column) -> Column:
    return gaia_match(final_answer(response), reference)


def normalized_hotpot(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def hotpot(prediction: Column, reference: Column) -> Column:
    """Struct (exact_match, f1, precision, recall): multiset overlap of normalised tokens."""
    cut = lambda x: F.filter(F.split(normalized_hotpot(x), " "), lambda w: w != "")
    p, r = cut(prediction), cut(reference)
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(r, lambda x: x == w))))
    exact = (p == r).cast("double")
    precision, recall = common / F.size(p), common / F.size(r)
    empty = (F.size(p) == 0) | (F.size(r) == 0)
    part = lambda x: F.when(empty, exact).when(common == 0, 0.0).otherwise(x)
    return F.struct(exact.alias("exact_match"), part(2 * precision * recall / (precision + recall)).alias("f1"), part(precision).alias("precision"), part(recall).alias("recall"))


def mmlu_correct(response: Column, answers: Column) -> Column:
    return F.array_contains(F.transform(answers, lambda a: F.upper(F.trim(a))), multiple_choice(response))


def is_quota_error(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, QUOTA)), lambda m: low.contains(m))


def labelled_field(text: Column, name: str) -> Column:
    value = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?ims)^\s*{name}\s*:\s*(.*?)(?=^\s*[a-z_ ]+\s*:|\z)", 1)
    return F.regexp_replace(value, r"^\s+|\s+\z", "")


def judge_verdict(text: Column) -> Column:
    """A judge's answer: its last "correct: yes/no"; anything else fails closed."""
    return F.coalesce(F.lower(_last(F.coalesce(text, F.lit("")), r"(?i)\bcorrect\s*:\s*\**\s*(yes|no)\b")) == "yes", F.lit(False))
