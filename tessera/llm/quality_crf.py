"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is labelled good or bad from its own features, those of the lines before and after it, and
the transition between neighbours. Forward-backward gives each line's marginal probability of being
good, and their mean weighted by line length is the document's quality.

Labels exist for documents only, so lines are learnt by expectation-maximisation. Lines of a good document are
good. Those of a bad one are latent: their distribution is the field's own, tilted as little as makes the bad
lines hold ``BAD_SHARE`` of the length at least. So that good and bad lines meet as neighbours, each document
also appears with a short run of lines of one of the other class spliced in.

Training takes at most ``PER_CLASS`` labelled documents of each class, those with the smallest hashes
of their ids, and of each at most ``MOST_LINES`` lines in a row, from a place that its id's hash gives; only their
features reach the driver. Class weights restore the proportions of all training labels. Scoring is one pass
over all lines of all texts without a shuffle.

Defined results: a null or empty text, or one of white space, is one empty line; blank lines carry no
weight; repeated rows are scored alike, one result each; null labels, labels of unknown documents and ids
labelled both ways are not used; of several texts of an id that with the smallest hash is learnt from; without
labels of both classes every score is the share of good labels, or 0.5;
an empty table gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import bounded_batches
from .quality_rules import SYMBOLS, UPPER, _repeated
from .words import batches, mix, shingles, split_buffers, split_words, text_buffers

#: labelled documents of each class that training takes at most
PER_CLASS = 2500
#: lines of each of them that training takes at most
MOST_LINES = 64
#: share of a bad document's length that bad lines hold at least, in expectation
BAD_SHARE = 0.9
#: lines of the other class that are spliced into a document at most
SPLICED = 3
#: gradient steps before the first expectation step, and between those
FIRST_ROUNDS, ROUNDS = 80, 30
BATCH_BYTES = 2 << 20
CLASSES = (SYMBOLS, UPPER, b"!", b"0123456789", b".,;:", bytes(range(0x80, 0x100)))
N_FEATURES = 16


# ---- features ------------------------------------------------------------------------------------


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, lines per document) of the lines that have words; a document without any has one empty line."""
    data, offsets = text_buffers(texts)
    n = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    newlines = np.flatnonzero(data[lo:hi] == 0x0A) + lo + 1
    bounds = np.unique(np.concatenate([offsets, newlines]))
    lines = split_buffers(data, bounds, fold=False, classes=CLASSES)
    owner = np.searchsorted(offsets, bounds[:-1], side="right") - 1
    held = lines.counts > 0
    line_of_word = lines.documents
    words = np.maximum(lines.counts, 1)
    size = np.maximum(np.diff(bounds), 1)

    # words of a document that occur in repeated windows of three, by line
    whole = split_words(texts, fold=False)
    windows, per_doc = shingles(whole, 3)
    doc_of = np.repeat(np.arange(n), per_doc)
    again = _repeated(windows ^ mix(doc_of.astype(np.uint64)))
    covered = np.zeros(len(whole.hashes) + 1, bool)
    first = np.repeat(whole.offsets[:-1], per_doc) + np.arange(len(windows)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    for k in range(3):
        covered[first[again] + k] = True
    repeat = np.bincount(line_of_word, weights=covered[:-1], minlength=len(words))

    keys = lines.hashes ^ mix(line_of_word.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[order[1:]] = keys[order[1:]] != keys[order[:-1]]
    distinct = np.bincount(line_of_word, weights=fresh, minlength=len(words))

    # whole lines that were seen before in the document
    place = np.arange(len(lines.hashes)) - np.repeat(lines.offsets[:-1], lines.counts)
    sums = np.zeros(len(words), np.uint64)
    np.add.at(sums, line_of_word, mix(lines.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    line_keys = mix(sums) ^ mix(owner.astype(np.uint64) + np.uint64(7))
    ranked = np.argsort(line_keys, kind="stable")
    seen = np.zeros(len(words), bool)
    seen[ranked[1:]] = line_keys[ranked[1:]] == line_keys[ranked[:-1]]

    symbol, upper, bang, digit, stop, high = lines.marks
    length = lines.chars / words
    columns = [
        np.ones(len(words)), np.log1p(lines.counts) / 4, np.abs(length - 5) / 2, (length > 7.5) * 1.0, np.minimum(symbol / words, 2), (symbol / words > 0.1) * 1.0,
        np.minimum(bang / words, 2), (bang / words > 0.2) * 1.0, upper / size, (upper / size > 0.3) * 1.0, digit / size, stop / size * 4, high / size,
        seen * 1.0, np.where(lines.counts >= 8, 1 - distinct / words, 0.3), repeat / words,
    ]
    found, weights, owner = np.stack(columns, axis=1)[held], lines.chars[held].astype(float), owner[held]
    per_doc = np.bincount(owner, minlength=n)
    if (per_doc == 0).any():
        missing = np.flatnonzero(per_doc == 0)
        blank = np.zeros((len(missing), N_FEATURES))
        blank[:, 0] = 1
        at = np.argsort(np.concatenate([owner, missing]), kind="stable")
        found, weights = np.concatenate([found, blank])[at], np.concatenate([weights, np.ones(len(missing))])[at]
        per_doc[missing] = 1
    return found, weights, per_doc


def with_neighbours(found: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it in its document (zero where there is none)."""
    ends = np.cumsum(per_doc)
    before, after = np.zeros_like(found), np.zeros_like(found)
    before[1:], after[:-1] = found[:-1], found[1:]
    before[ends - per_doc], after[ends - 1] = 0, 0
    return np.concatenate([found, before, after], axis=1)


# ---- the field -----------------------------------------------------------------------------------


def _steps(per_doc: np.ndarray) -> list[np.ndarray]:
    """For each position, the lines at it, of the documents long enough; documents keep one order, longest first."""
    order = np.argsort(-per_doc, kind="stable")
    starts = (np.cumsum(per_doc) - per_doc)[order]
    lengths = per_doc[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []
    return [starts[:a] + t for t, a in enumerate(active)]


def forward_backward(unary: np.ndarray, transition: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every line (n, 2), expected transition counts by document step (summed with weights later), log normalisers by line.

    unary: (n, 2) scores; transition: (2, 2) scores. Scaled recursions, all documents side by side.
    """
    steps = _steps(per_doc)
    top = unary.max(axis=1, keepdims=True)
    local, move = np.exp(unary - top), np.exp(transition)
    alpha, beta, scale = np.zeros_like(local), np.ones_like(local), np.zeros(len(local))
    for t, rows in enumerate(steps):
        value = local[rows] if t == 0 else (alpha[rows - 1] @ move) * local[rows]
        norm = value.sum(axis=1)
        alpha[rows], scale[rows] = value / norm[:, None], norm
    pair = np.zeros((len(local), 2, 2))
    for rows in steps[:0:-1]:
        ahead = local[rows] * beta[rows] / scale[rows][:, None]
        pair[rows] = alpha[rows - 1][:, :, None] * move[None] * ahead[:, None, :]
        beta[rows - 1] = ahead @ move.T
    return alpha * beta, pair, np.log(scale) + top[:, 0]


class Field:
    """Weights of the unary features (for good; bad is the reference) and of the transitions."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, constant: float | None = None):
        self.weights, self.transition, self.constant = weights, transition, constant

    def marginals(self, found: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        score = with_neighbours(found, per_doc) @ self.weights
        return forward_backward(np.stack([np.zeros_like(score), score], axis=1), self.transition, per_doc)[0][:, 1]

    def quality(self, texts: pa.Array) -> np.ndarray:
        """Length-weighted mean of the marginals of every text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        found, weights, per_doc = line_features(texts)
        good = self.marginals(found, per_doc)
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        total = np.bincount(owner, weights=weights, minlength=len(per_doc))
        return np.clip(np.bincount(owner, weights=weights * good, minlength=len(per_doc)) / total, 0, 1)


def spliced(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of training documents (features, weights, label), each as it is and with a run of another class's lines inside.

    (features, weights, lines per document, labels, stretches of one origin, numbers of the documents).
    """
    by_class = [[d for d in docs if d[2] == y] for y in (0, 1)]
    parts, per_doc, number = [], [], []
    for k, (found, weights, y) in enumerate(docs):
        parts.append((found, weights, y))
        per_doc.append(len(found))
        number.append(k)
        others = by_class[1 - y]
        if others:
            other, other_weights, _ = others[k % len(others)]
            run = min(1 + k % SPLICED, len(other))
            at, start = 7 * k % (len(found) + 1), 5 * k % (len(other) - run + 1)
            parts += [(found[:at], weights[:at], y), (other[start : start + run], other_weights[start : start + run], 1 - y), (found[at:], weights[at:], y)]
            per_doc.append(len(found) + run)
            number.append(k)
    sizes = [len(p[0]) for p in parts]
    labels, stretches = np.repeat([p[2] for p in parts], sizes), np.repeat(np.arange(len(parts)), sizes)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array(per_doc), labels, stretches, np.array(number)


def latent(score: np.ndarray, transition: np.ndarray, per_doc: np.ndarray, labels: np.ndarray, stretches: np.ndarray, weights: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and pairs of the lines: known good ones as they are, the others after the field with the least tilt, stretch by stretch, that makes their bad share large enough."""
    n = int(stretches.max()) + 1
    bad = labels == 0
    low, high = np.zeros(n), np.full(n, 64.0)
    total = np.maximum(np.bincount(stretches, weights=weights, minlength=n), 1e-12)
    for step in range(rounds + 1):
        tilt = high if step == rounds else low if step == 0 else (low + high) / 2
        unary = np.stack([np.zeros_like(score), np.where(bad, score - tilt[stretches], score + 64.0)], axis=1)
        marginal, pair, _ = forward_backward(unary, transition, per_doc)
        enough = np.bincount(stretches, weights=weights * marginal[:, 0], minlength=n) / total >= BAD_SHARE
        if step == 0:
            high = np.where(enough, 0.0, high)
        else:
            low, high = np.where(enough, low, tilt), np.where(enough, tilt, high)
    return marginal[:, 1], pair


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], doc_weights: np.ndarray, expectations: int = 5, penalty: float = 1.0, rate: float = 0.1) -> Field:
    """Maximum of the penalised likelihood over latent labels, by adaptive gradient steps between expectation steps.

    docs: line features, line weights and label of each. The first steps take every line's label from its document.
    """
    found, weights, per_doc, labels, stretches, number = spliced(docs)
    x = with_neighbours(found, per_doc)
    w = np.repeat(doc_weights[number], per_doc)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(per_doc) - per_doc] = False
    at = np.flatnonzero(inner)
    good = labels.astype(float)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), w[at])
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, FIRST_ROUNDS + expectations * ROUNDS + 1):
        score, move = x @ theta[:-4], theta[-4:].reshape(2, 2)
        if step > FIRST_ROUNDS and not (step - FIRST_ROUNDS - 1) % ROUNDS:
            good, pair = latent(score, move, per_doc, labels, stretches, weights)
            seen = np.tensordot(w[at], pair[at], axes=1)
        marginal, pair, _ = forward_backward(np.stack([np.zeros_like(score), score], axis=1), move, per_doc)
        grad = np.concatenate([x.T @ (w * (good - marginal[:, 1])), (seen - np.tensordot(w[at], pair[at], axes=1)).ravel()])
        grad = (grad - penalty * theta) / w.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


# ---- Spark ---------------------------------------------------------------------------------------


def is_held_out(key: str = "doc_id"):
    """Rows whose crc32(id as text) mod 3 is 1 are never learnt from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Field:
    """Train on at most ``per_class`` labelled rows of each class that are not held out."""
    one = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).filter(~is_held_out("id"))
    usable = one.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Field(np.zeros(0), np.zeros((2, 2)), float(next(iter(totals), 0.5)))
    order = [F.xxhash64("id"), F.col("id")]
    sample = usable.filter("y = 0").orderBy(*order).limit(per_class).unionByName(usable.filter("y = 1").orderBy(*order).limit(per_class))
    chosen = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")

    def lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH_BYTES, "text"):
            found, weights, per_doc = line_features(batch.column("text"))
            ids, starts = batch.column("id").to_numpy(), np.cumsum(per_doc) - per_doc
            spans = [(s + int(i % max(n - MOST_LINES + 1, 1)), min(n, MOST_LINES)) for i, s, n in zip(ids, starts, per_doc, strict=True)]
            of = lambda v, s, n: v[s : s + n].astype(np.float32).tobytes()
            yield pa.record_batch({"id": batch.column("id"), "hash": batch.column("hash"), "y": batch.column("y"), "found": pa.array([of(found, *s) for s in spans], pa.binary()), "weights": pa.array([of(weights, *s) for s in spans], pa.binary())})

    made = chosen.select(F.xxhash64("id").alias("id"), F.xxhash64("text").alias("hash"), "y", "text").mapInArrow(lines, "id long, hash long, y int, found binary, weights binary")
    rows = made.toPandas().sort_values(["id", "hash"], kind="stable").drop_duplicates("id")
    counts = rows["y"].value_counts()
    if len(counts) < 2:
        return Field(np.zeros(0), np.zeros((2, 2)), float(totals.get(1, 0)) / sum(totals.values()))
    weight = rows["y"].map({y: totals[y] / counts[y] for y in (0, 1)}).to_numpy(float)
    part = [(np.frombuffer(f, np.float32).astype(float).reshape(-1, N_FEATURES), np.frombuffer(w, np.float32).astype(float), int(y)) for f, w, y in zip(rows["found"], rows["weights"], rows["y"], strict=True)]
    return train(part, weight / weight.mean() / np.sqrt([len(f) for f, _, _ in part]))


def score(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` and ``predicted``."""
    bounded_batches(docs.sparkSession)
    passed = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in passed] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH_BYTES, "__text"):
            quality = field.quality(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(quality), pa.array((quality >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*passed, F.col(text).cast("string").alias("__text")).mapInArrow(apply, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with their own columns only."""
    field = fit(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return score(rows, field, "text", ["row"]).filter("predicted = 1").select("row.*")
