"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Best-fit decreasing: pieces go, longest first, into the open sequence with the tightest fitting
remainder, which a segment tree over remainders finds in logarithmic time; a new sequence opens only
if none fits. Pieces of one length are alike and sequences of one remainder are alike, so the fit is
planned over the count of each length - at most ``capacity`` numbers, whatever the input - in runs
of equal moves. The plan holds for all pieces at once: a piece's place follows from its rank among
the pieces of its length.

Distribution: texts are tokenised once; the pieces (a few numbers each) are written to the shared
folder. Ranks are counted within (length, part) groups of bounded size and then over one row per
group, so a length that holds most pieces spreads over many tasks. Only the counts of lengths reach
the driver, and only the plan is broadcast: its runs are bounded by the square of ``capacity``, in
practice a few thousand.

Defined results: a null or empty text is one piece holding id 0 alone; a text that is longer than a
sequence is cut into full pieces, the shorter rest first; repeated rows are packed each on its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import bounded_batches, materialize
from .words import batches

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id {key}, piece int, start long, length long, ids_crc32 long, part long"
GROUP_ROWS = 4096


# ---- planning ------------------------------------------------------------------------------------


class RemainderTree:
    """Segment tree over remainders 0..capacity: which have open sequences, and the smallest of them from a bound up."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.held = [0] * (2 * self.size)

    def add(self, remainder: int, n: int) -> None:
        at = self.size + remainder
        while at:
            self.held[at] += n
            at //= 2

    def tightest(self, least: int) -> int:
        """The smallest remainder of at least ``least`` with an open sequence; -1 if there is none."""
        at = self.size + least
        if self.held[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.held[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.held[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, pieces per sequence, offset in the sequence).

    The pieces of a run, in rank order, fill sequence after sequence with ``pieces per sequence`` each.
    """
    tree = RemainderTree(capacity)
    open_ranges: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(remainder: int, first: int, n: int) -> None:
        if remainder and n:
            open_ranges.setdefault(remainder, []).append((first, n))
            tree.add(remainder, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remainder = tree.tightest(length)
            if remainder < 0:
                remainder, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = open_ranges[remainder].pop()
                tree.add(remainder, -n)
            each = remainder // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - remainder))
                put(remainder - full_length(each, length), first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left and left < each:
                    runs.append((length, rank, left, first + full, each, capacity - remainder))
                    put(remainder - full_length(left, length), first + full, 1)
                    full, left = full + 1, 0
                put(remainder, first + full, n - full)
    return runs


def full_length(n: int, length: int) -> int:
    return n * length


class Placement:
    """Places of pieces by (length, rank), from a plan."""

    def __init__(self, runs: list[tuple[int, int, int, int, int, int]]):
        ordered = sorted(runs)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for length in {r[0] for r in ordered}:
            held = np.array([r[1:] for r in ordered if r[0] == length], np.int64)
            self.by_length[length] = tuple(held.T)

    def of(self, length: int, rank: int) -> tuple[int, int]:
        firsts, _, sequence, each, offset = self.by_length[length]
        k = bisect_right(firsts, rank) - 1
        turn, within = divmod(rank - int(firsts[k]), int(each[k]))
        return int(sequence[k]) + turn, int(offset[k]) + within * length

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = order[a:b]
            length = int(lengths[rows[0]])
            firsts, _, sequence, each, offset = self.by_length[length]
            k = np.searchsorted(firsts, ranks[rows], side="right") - 1
            turn, within = np.divmod(ranks[rows] - firsts[k], each[k])
            sequences[rows], offsets[rows] = sequence[k] + turn, offset[k] + within * length
        return sequences, offsets


# ---- tokens --------------------------------------------------------------------------------------


class TokenIds:
    """Ids of the public byte-level BPE.

    The vocabulary is loaded through the library that encodes it fastest; its ids are those of the JSON
    file through ``tokenizers``. A text with a special token's string in it goes through ``tokenizers``
    itself, which reads such a string as that token.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self._exact = json_path, None
        with open(json_path, encoding="utf-8") as whole:
            self.special = [t["content"] for t in json.load(whole)["added_tokens"]]

    @property
    def exact(self):
        """The tokenizer of the JSON file, loaded when a text first needs it."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.json_path)
        return self._exact

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


_loaded: dict[tuple, TokenIds] = {}


def token_ids(json_path: str | None = None, ranks_path: str | None = None) -> TokenIds:
    """The encoder of this worker, loaded once; the files' places are parameters."""
    import public_tokenizers

    key = (json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if key not in _loaded:
        _loaded[key] = TokenIds(*key, public_tokenizers.PATTERN)
    return _loaded[key]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    first = [(0, head)] if head else []
    return first + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Rows for each piece: key, piece, start, length, ids_crc32, and part, a number of the row that spreads equal lengths, whatever the keys."""
    kind = docs.schema[key].dataType.simpleString()

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(*tokenizer)
        for batch in batches(rows, 8 << 20, "text"):
            source, piece, start, length, crc = [], [], [], [], []
            for k, value in enumerate(batch.column("text")):
                ids = np.append(encoder.encode(value.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for p, (at, n) in enumerate(cut(len(ids), capacity)):
                    source.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("key").take(pa.array(source, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    "part": batch.column("part").take(pa.array(source, pa.int64())),
                }
            )

    made = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("part")).mapInArrow(make, PIECES.format(key=kind))
    return made.withColumnRenamed("doc_id", key) if key != "doc_id" else made


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``."""
    bounded_batches(docs.sparkSession)
    made = materialize(pieces(docs, key, text, capacity, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placement = Placement(plan(counts, capacity))
    parts = max(1, sum(counts.values()) // GROUP_ROWS)
    grouped = made.withColumn("part", F.pmod(F.xxhash64("part", "piece"), F.lit(parts)))
    held = grouped.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy(key, "piece", "start", "ids_crc32")
    ranked = grouped.withColumn("local", F.row_number().over(within) - 1).join(base, ["length", "part"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequences, offsets = placement.place(lengths.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"sequence_id": sequences, "offset": offsets})

    placed = ranked.withColumn("placed", place("length", F.col("base") + F.col("local")))
    return placed.select(key, "piece", "start", "length", "ids_crc32", "placed.sequence_id", "placed.offset")
