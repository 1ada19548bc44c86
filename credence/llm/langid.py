"""Language identification by unigram models marginalised over segmentations.

The pieces are those of a fixed public vocabulary that are letters alone, in lower case, of any length. A language
gives each piece a probability; a run of letters, however long, has the sum, over all its segmentations into pieces, of
the products of their probabilities, which a forward recursion sums exactly (rescaled as it goes, so long runs don't
underflow). A text's score is the product over its runs of letters. Probabilities come from expectation maximisation
over the word counts of a sample: PER_LANGUAGE documents of each language at most, of the smallest hashes of their ids.
How frequent a language is, is counted on all documents that may be learned from.

The sample is thinned by a hash threshold from each language's count before it is ranked, so no task gets all
documents of a language.

Documents with crc32(doc_id as text) mod 5 = 0 are held out, and only `lang` and `text` of the others are learned from.

Nulls and edges: a null text, or one without a letter, is `und` with score 0; if no document has a language, all are
`und`; ties go to the language that comes first; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from credence.llm.common import documents, inline, parallel

PER_LANGUAGE = 400
MOST_LANGUAGES = 10_000
ROUNDS = 3
FLOOR = 1e-8
RESCALE = 8
CACHE = 300_000
CHUNK = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")  # and numbers that are no decimal digits
_STRICT = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x100000001B3)


def vocabulary(name: str = "piece_bpe_32k.model") -> list[str]:
    """The letter pieces of a public vocabulary, sorted."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = {sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p.isalpha())


def runs(text: str) -> list[str]:
    """The runs of letters (Unicode's categories L), lower case."""
    found = _LETTERS.findall(text.lower())
    return found if text.isascii() else [x for w in found for x in ((w,) if w.isalpha() else _STRICT.findall(w))]


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all substrings of k letters: [words, places]."""
    n = codes.shape[1] - k + 1
    h = np.full((codes.shape[0], n), np.uint64(k), np.uint64)
    for j in range(k):
        h = (h ^ codes[:, j : j + n]) * _BASE
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log
    keys: list[np.ndarray]  # sorted hashes of the pieces of each length
    place: list[np.ndarray]  # their rows in p
    p: np.ndarray  # [pieces + 1, languages]; the last row is what the vocabulary lacks

    def index(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Rows of p for all substrings of k letters."""
        keys, missing = self.keys[k - 1], len(self.p) - 1
        if not len(keys):
            return np.full((codes.shape[0], codes.shape[1] - k + 1), missing)
        h = _hashes(codes, k)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, self.place[k - 1][at], missing)

    def forward(self, codes: np.ndarray) -> np.ndarray:
        """log of the sums over all segmentations [words, languages], of words of one length.

        Only the sums of the last pieces' lengths are held; every RESCALE letters they are divided by the newest one.
        """
        w, n = codes.shape
        lengths = [k for k in range(1, min(len(self.keys), n) + 1) if k == 1 or len(self.keys[k - 1])]
        rows = {k: self.index(codes, k) for k in lengths}
        known = {k: (rows[k] != len(self.p) - 1).any(axis=0) for k in lengths}  # places where any word has a piece of k letters
        scale, recent = np.zeros((w, self.p.shape[1])), [np.ones((w, self.p.shape[1]))]  # newest last
        for i in range(1, n + 1):
            # Any letter can stand alone, so each word has a segmentation.
            a = recent[-1] * np.maximum(self.p[rows[1][:, i - 1]], FLOOR)
            for k in lengths[1:]:
                if k > i:
                    break
                if known[k][i - k]:
                    a += recent[-k] * self.p[rows[k][:, i - k]]
            recent = [*recent[1 - lengths[-1] :], a] if lengths[-1] > 1 else [a]
            if i % RESCALE == 0 or i == n:
                scale += np.log(a)
                recent = [x / a for x in recent]
        return scale

    def log_scores(self, words: list[str]) -> np.ndarray:
        """log probabilities [words, languages]."""
        out = np.empty((len(words), len(self.languages)))
        lengths = np.array([len(x) for x in words])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            size = max(1, 400_000 // int(n))
            for b in range(0, len(at), size):
                part = at[b : b + size]
                out[part] = self.forward(_codes([words[i] for i in part], int(n)))
        return out


def train(counts: dict[str, dict[str, int]], documents_of: dict[str, int], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Expectation maximisation for each language over the counts of its runs of letters."""
    languages = sorted(counts)
    keys, place, row = [], [], {p: i for i, p in enumerate(pieces)}
    for k in range(1, max(map(len, pieces)) + 1):
        mine = [p for p in pieces if len(p) == k]
        h = _hashes(_codes(mine, k), k)[:, 0] if mine else np.empty(0, np.uint64)
        order = np.argsort(h)
        keys.append(h[order])
        place.append(np.array([row[mine[i]] for i in order], np.int64))
    total = sum(documents_of[x] for x in languages)
    model = Model(languages, np.log(np.array([documents_of[x] / total for x in languages])), keys, place, np.zeros((len(pieces) + 1, len(languages))))
    for j, language in enumerate(languages):
        groups: dict[int, list[str]] = {}
        for x in sorted(counts[language]):
            groups.setdefault(len(x), []).append(x)
        one = Model([language], np.zeros(1), keys, place, np.full((len(pieces) + 1, 1), 1.0 / len(pieces)))
        one.p[-1] = 0
        for _ in range(rounds):
            expected = np.zeros(len(pieces) + 1)
            for n, group in groups.items():
                c, size = np.array([counts[language][x] for x in group], float), max(1, 400_000 // n)
                for b in range(0, len(group), size):
                    expected += _expected(one, group[b : b + size], c[b : b + size], n)
            expected[-1] = 0
            expected[:-1] += 0.01  # no piece is impossible
            one.p[:, 0] = expected / expected.sum()
        model.p[:, j] = one.p[:, 0]
    return model


def _expected(m: Model, words: list[str], counts: np.ndarray, n: int) -> np.ndarray:
    """Expected counts of the pieces in words of n letters, by forward and backward sums of logarithms."""
    codes = _codes(words, n)
    lengths = [k for k in range(1, min(len(m.keys), n) + 1) if k == 1 or len(m.keys[k - 1])]
    rows = {k: m.index(codes, k) for k in lengths}
    with np.errstate(divide="ignore"):
        log_p = np.log(m.p[:, 0])
    q = {k: np.maximum(log_p[rows[k]], np.log(FLOOR)) if k == 1 else log_p[rows[k]] for k in lengths}
    a, b = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
    for i in range(1, n + 1):
        a[i] = np.logaddexp.reduce([a[i - k] + q[k][:, i - k] for k in lengths if k <= i])
    for i in range(n - 1, -1, -1):
        b[i] = np.logaddexp.reduce([b[i + k] + q[k][:, i] for k in lengths if k <= n - i])
    out = np.zeros(len(m.p))
    for k in lengths:
        for i in range(n - k + 1):
            out += np.bincount(rows[k][:, i], counts * np.exp(a[i] + q[k][:, i] + b[i + k] - a[n]), minlength=len(out))
    return out


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, pieces: list[str] | None = None) -> Model | None:
    """A model of the labelled documents that aren't held out; None if there are none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and text is not null and lang is not null").filter(~held_out())
    # A row for each language: the driver holds what the model has of each anyway.
    documents_of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = inline(docs.sparkSession, [(x, (2.0 * per_language + 100) / n) for x, n in documents_of.items()], "s_lang string, share double")
    shares = F.broadcast(shares) if len(documents_of) <= MOST_LANGUAGES else shares
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    thin = rows.select("doc_id", "lang").join(shares, F.col("lang") == F.col("s_lang")).filter(place < F.col("share")).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id")
    chosen = thin.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_language).select("doc_id", "lang").distinct()

    def count(batches):
        for b in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text")):
                for x in runs(t.as_py()):
                    seen[lang, x] = seen.get((lang, x), 0) + 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    # A few hundred ids for each language: bounded by the parameter.
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    got = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(got.column(c).to_pylist() for c in ("lang", "word", "n"))):
        counts.setdefault(lang, {})[word] = n
    return train(counts, documents_of, pieces or vocabulary()) if counts else None


class Scorer:
    """log scores of texts, with a bounded cache of words that lives on between tasks."""

    def __init__(self, model: Model):
        self.model, self.row, self.table = model, {}, np.empty((0, len(model.languages)))

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """Sums over each text's words; [texts, languages]."""
        new = list(set().union(*texts).difference(self.row)) if texts else []
        row, table = self.row, self.table
        if new:
            scores = self.model.log_scores(new)
            table = np.concatenate([table, scores])
            at = range(len(self.table), len(table))
            if len(table) <= CACHE:
                row.update(zip(new, at))
                self.table = table
            else:
                row = row | dict(zip(new, at)) if len(row) < len(new) else _Layered(row, dict(zip(new, at)))
        out = np.zeros((len(texts), len(self.model.languages)))
        for i, words in enumerate(texts):
            if words:
                out[i] = table[np.fromiter(map(row.__getitem__, words), np.int64, len(words))].sum(0)
        return out


class _Layered(dict):
    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, key):
        return self.first[key]


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    rows = documents(docs).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    import uuid

    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary times the languages

    def run(batches):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(sent.value)
        scorer = _SCORERS[key]
        names = np.array(scorer.model.languages, object)
        for b in batches:
            best, score, held, size = [], [], [], 0

            def flush():
                s = scorer.texts(held) + scorer.model.prior
                at = s.argmax(1)
                p = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
                some = np.array([bool(x) for x in held])
                best.extend(np.where(some, names[at], "und").tolist())
                score.extend(np.where(some, p, 0.0).tolist())
                held.clear()

            for t in b.column("text"):
                text = t.as_py() or ""
                held.append(runs(text))
                size += len(text)
                if size >= CHUNK:
                    flush()
                    size = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return parallel(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn and predict."""
    return predict(docs, fit(docs, per_language))
