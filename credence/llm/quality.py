"""Quality rules: a decision list learned by sequential covering.

Statistics of a text (`STATISTICS`) come from one Arrow pass. `learn` grows conjunctions of thresholds on them, one
at a time, on two thirds of a labelled sample (information gain), prunes each on the last third (dropping final
conditions while (p - n) / (p + n) does not fall), and stops when the best pruned rule is not precise enough; what a
rule covers is taken away before the next. Rules reject; what none covers is kept. `verdict` emits the list as one
ordered Spark CASE expression, so applying it costs no Python beyond the statistics.

The sample is bounded: at most SAMPLE labelled documents, those with the smallest hash of their id. A document with
several labels counts as bad if any says so. Without labels of both kinds the list is empty and only the base rules act.

Nulls and edges: a null or empty text has all counts 0 and so fails the base rules; repeated rows each get their row;
an empty table gives an empty result; other columns are kept only by `filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from credence.llm.common import documents, window_hashes, word_hashes

SAMPLE = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPERS, DIGITS = bytes(range(65, 91)), b"0123456789"
#: Base counts, then what only the learned rules use.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_exclaim", "n_distinct_words"]


def count(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    less = lambda chars: len(raw) - len(raw.translate(None, chars))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, repeated, distinct = len(words), 0, 0
    if n:
        h = word_hashes(words)
        distinct = len(np.unique(h))
        if n > 5:
            w = window_hashes(h)
            values, inverse, times = np.unique(w, return_inverse=True, return_counts=True)
            if len(values) < len(w):
                edge = np.zeros(n + 1, np.int64)
                starts = np.flatnonzero(times[inverse] > 1)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + 5, -1)
                repeated = int((np.cumsum(edge[:n]) > 0).sum())
    return (n, len(text) - less(SPACES), less(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), less(UPPERS), less(DIGITS), less(b"!"), distinct)


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts of its text column; all else passes through."""
    names = [prefix + x for x in COUNTS + MORE]
    schema = T.StructType(docs.schema.fields + [T.StructField(x, T.LongType()) for x in names])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            values = [count(x.as_py()) for x in b.column(at)]
            columns = list(zip(*values)) if values else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in columns)], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def statistics(prefix: str = "") -> dict[str, Column]:
    """What rules test, from the counts; all ratios lie where learned thresholds carry over to other sizes."""
    c = {x: F.col(f"`{prefix}{x}`").cast("double") for x in COUNTS + MORE}
    return {
        "word_length": _ratio(c["word_chars"], c["n_words"]), "symbols_per_word": _ratio(c["n_symbols"], c["n_words"]), "exclaims_per_word": _ratio(c["n_exclaim"], c["n_words"]),
        "upper_share": _ratio(c["n_upper"], c["word_chars"]), "digit_share": _ratio(c["n_digits"], c["word_chars"]), "dup_line_share": _ratio(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": _ratio(c["n_repeat_words"], c["n_words"]), "distinct_share": _ratio(c["n_distinct_words"], c["n_words"]), "words_per_line": _ratio(c["n_words"], c["n_lines"]), "n_words": c["n_words"],
    }


STATISTICS = ["word_length", "symbols_per_word", "exclaims_per_word", "upper_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line", "n_words"]


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions (statistic, is "at least" rather than "at most", threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, least, t in self.conditions:
            v = x[:, STATISTICS.index(name)]
            hit &= (v >= t) if least else (v <= t)
        return hit


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> list[tuple[str, bool, float]]:
    """Conditions added while each gains: p * (log2 precision after - before), p the bad ones left."""
    conditions, live = [], np.ones(len(x), bool)
    while len(conditions) < most:
        p, n = int(bad[live].sum()), int((~bad[live]).sum())
        if p == 0 or n == 0:
            break
        before, best = np.log2(p / (p + n)), (0.0, None)
        for j, name in enumerate(STATISTICS):
            v = x[live, j]
            levels = np.unique(np.quantile(v[bad[live]], np.linspace(0, 1, cuts)))
            for least in (True, False):
                for t in levels:
                    hit = (v >= t) if least else (v <= t)
                    pp, nn = int((hit & bad[live]).sum()), int((hit & ~bad[live]).sum())
                    if pp and (gain := pp * (np.log2(pp / (pp + nn)) - before)) > best[0] + 1e-9:
                        best = gain, (name, least, float(t))
        if best[1] is None:
            break
        name, least, t = best[1]
        conditions.append(best[1])
        v = x[:, STATISTICS.index(name)]
        live &= (v >= t) if least else (v <= t)
    return conditions


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, least_covered: int = 5, cuts: int = 33) -> list[Rule]:
    """The decision list of a sample: rows of STATISTICS and whether each is bad. Same input, same list."""
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and bad[~prune].sum() >= least_covered:
        conditions = _grow(x[~prune], bad[~prune], most_conditions, cuts)
        if not conditions:
            break

        def worth(c: tuple) -> float:
            hit = Rule(c, 0, 0).covers(x[prune])
            p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        c = tuple(conditions)
        while len(c) > 1 and worth(c[:-1]) >= worth(c):
            c = c[:-1]
        hit = Rule(c, 0, 0).covers(x)
        p, n = int((hit & bad).sum()), int(hit.sum())
        if n == 0 or p < least_covered or p / n < precision:
            break
        rules.append(Rule(c, p / n, n))
        x, bad, prune = x[~hit], bad[~hit], prune[~hit]
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The number, from 1, of the first rule that rejects; 0 for what is kept. One ordered CASE expression."""
    s, out = statistics(prefix), None
    for i, r in enumerate(rules, 1):
        test = F.lit(True)
        for name, least, t in r.conditions:
            test &= (s[name] >= F.lit(t)) if least else (s[name] <= F.lit(t))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, **options) -> list[Rule]:
    """Rules from the labelled documents; label 0 is bad. What the base rules reject teaches nothing."""
    voted = labels.filter(F.col("doc_id").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(f"`{label_col}`")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = voted.orderBy(*order).limit(sample)
    # At most `sample` ids of 8 bytes: a proven bound for the broadcast.
    rows = with_counts(documents(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")).filter(~base_failed())
    s = statistics()
    got = rows.select("doc_id", "y", *(s[n].alias("s_" + n) for n in STATISTICS)).orderBy(*order, *("s_" + n for n in STATISTICS)).limit(sample).toArrow()
    x = np.column_stack([got.column("s_" + n).to_numpy() for n in STATISTICS]) if got.num_rows else np.empty((0, len(STATISTICS)))
    return learn(x, got.column("y").to_numpy() == 0, **options)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, rule (0: none) and kept, a row for each row of docs."""
    rules = learn_rules(docs, labels, **options)
    rows = with_counts(documents(docs))
    return rows.select("doc_id", *COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    rules = learn_rules(docs, labels, **options)
    rows = with_counts(docs, prefix="__q_")
    return rows.filter(~base_failed("__q_") & (verdict(rules, "__q_") == 0)).select(*(F.col(f"`{c}`") for c in docs.columns))
