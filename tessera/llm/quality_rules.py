"""Quality rules as weak supervision.

Every rule votes *bad*, *good* or abstains on a document. The distinct vote patterns (at most
``3**len(RULES)``, whatever the input) are counted over all documents, expectation-maximisation fits
the prior of a good document and each rule's accuracies (its vote probabilities within good and
within bad documents) to those counts, and the posterior probability of a pattern being good
replaces all-must-pass filtering.

Texts are read twice, once for the patterns and once for the verdicts; there is no join and no
shuffle of texts, so repeated ids and large groups of copies cost nothing extra.

Defined results: a null or empty text has no words, all counts are 0 and it fails the base rules;
white space only likewise; repeated rows are judged alike, one result each; with no rows the prior
alone is kept and the result is empty; all further columns are passed through, and result columns
replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import bounded_batches
from .words import batches, shingles, split_words

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
BATCH_BYTES = 2 << 20

BAD, ABSTAIN, GOOD = 0, 1, 2
#: feature, votes good up to, votes bad from (in between: abstains)
RULES = (
    ("symbol_share", 0.05, 0.1),
    ("dup_line_share", 0.25, 0.4),
    ("repeat_share", 0.3, 0.4),
    ("upper_share", 0.2, 0.3),
    ("bang_share", 0.1, 0.2),
    ("top_word_share", 0.2, 0.3),
    ("word_length_off", 2.0, 3.0),
)
MIN_WORDS = 50
FEW_LINES = 6
USUAL_WORD_LENGTH = 5.5

FEATURE_TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs elsewhere too."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = ranked[1:] == ranked[:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    return same


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and shares of every text, computed over the whole batch at once."""
    words = split_words(texts, fold=False, classes=(SYMBOLS, UPPER, b"!"))
    n = words.counts
    salt = words.documents.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    keys = np.sort(words.hashes ^ salt)
    starts = _runs(keys)
    top = np.zeros(len(n), np.int64)
    if len(keys):
        order = np.argsort(words.hashes ^ salt, kind="stable")
        np.maximum.at(top, words.documents[order[starts]], np.diff(np.append(starts, len(keys))))

    windows, per_doc = shingles(words, 3)
    doc_of = np.repeat(np.arange(len(n)), per_doc)
    again = _repeated(windows ^ (doc_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    covered = np.zeros(len(words.hashes) + 1, bool)
    first = np.repeat(words.offsets[:-1], per_doc) + np.arange(len(windows)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    for k in range(3):
        covered[first[again] + k] = True
    run = np.concatenate([[0], np.cumsum(covered[:-1])])
    repeat = np.diff(run[words.offsets])

    lines = np.zeros(len(n), np.int64)
    dup = np.zeros(len(n), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        if text:
            held = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            lines[k], dup[k] = len(held), len(held) - len(set(held))
    per_word = np.maximum(n, 1)
    return {
        "n_words": n, "word_chars": words.chars, "n_symbols": words.marks[0], "n_dup_lines": dup, "n_repeat_words": repeat,
        "symbol_share": words.marks[0] / per_word, "dup_line_share": dup / np.maximum(lines, FEW_LINES), "repeat_share": repeat / per_word,
        "upper_share": words.marks[1] / np.maximum(words.chars, 1), "bang_share": words.marks[2] / per_word,
        "top_word_share": np.where(n >= MIN_WORDS, top / per_word, 0.0),
        "word_length_off": np.abs(words.chars / per_word - USUAL_WORD_LENGTH),
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """The vote pattern of every document, one base-3 digit a rule."""
    out = np.zeros(len(found["n_words"]), np.int64)
    for k, (name, good, bad) in enumerate(RULES):
        vote = np.where(found[name] >= bad, BAD, np.where(found[name] <= good, GOOD, ABSTAIN))
        out += vote * 3**k
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Posterior probability of being good for each pattern, after expectation-maximisation over the counts."""
    digits = np.stack([patterns // 3**k % 3 for k in range(len(RULES))], axis=1)
    weight = counts.astype(float)
    good = np.where((digits == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        prior = (np.dot(weight, good) + 1) / (weight.sum() + 2)
        log_good, log_bad = np.full(len(patterns), np.log(prior)), np.full(len(patterns), np.log1p(-prior))
        for k in range(len(RULES)):
            table = np.ones((2, 3)) * 0.1
            np.add.at(table[0], digits[:, k], weight * good)
            np.add.at(table[1], digits[:, k], weight * (1 - good))
            table /= table.sum(axis=1, keepdims=True)
            log_good += np.log(table[0][digits[:, k]])
            log_bad += np.log(table[1][digits[:, k]])
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        moved = np.abs(new - good).max(initial=0)
        good = new
        if moved < tolerance:
            break
    return good


def posteriors(docs: DataFrame, text: str = "text") -> dict[int, float]:
    """Pattern to posterior, from the patterns of all documents."""
    bounded_batches(docs.sparkSession)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(RULES), np.int64)
        for batch in batches(rows, BATCH_BYTES, "text"):
            total += np.bincount(votes(features(batch.column("text"))), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch({"pattern": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "pattern long, n long")
    rows = counted.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    return dict(zip(patterns.tolist(), fit(patterns, counts).tolist(), strict=True))


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the counts, ``base_failed``, ``posterior`` and ``kept``."""
    by_pattern = posteriors(docs, text)
    added = T._parse_datatype_string(FEATURE_TYPES + ", base_failed boolean, posterior double, kept boolean")
    names = {f.name for f in added.fields}
    passed = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in passed] + added.fields)
    columns = [F.col(c) for c in passed] + [F.col(text).cast("string").alias("__text")]

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH_BYTES, "__text"):
            found = features(batch.column("__text"))
            n, repeat = found["n_words"], found["n_repeat_words"]
            failed = (n < MIN_WORDS) | (100 * repeat > 50 * n)
            good = np.array([by_pattern.get(p, 0.0) for p in votes(found).tolist()])
            made = [pa.array(found[f.name], pa.int64()) for f in added.fields[:5]] + [pa.array(failed), pa.array(good, pa.float64()), pa.array(~failed & (good >= 0.5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[f.name for f in schema.fields])

    return docs.select(*columns).mapInArrow(apply, schema)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents kept, with their own columns only."""
    judged = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return judge(judged, "text", ["row"]).filter("kept").select("row.*")
