"""Language-model scoring with a probabilistic suffix tree over words.

A state of the tree is a context of one to ``MAX_DEPTH`` words that occurs at least ``LEAST`` times in the
training texts, and is kept only if a divergence test says that its next-symbol distribution
differs enough from that of its longest proper suffix: the gain in log-likelihood must pay ``COST``
nats for each symbol it lists. Listed are next symbols seen at least ``LEAST`` times after it, so what is
gathered grows with the texts and the rule is the same at every size. Distributions are smoothed by
absolute discounts whose mass goes to the suffix's distribution, down to the root: the discounted
frequencies of all training words, and one symbol for any unknown word (the same events as the unigram
base). A text is scored with the longest kept suffix at each token. The test takes probabilities after the
suffix to a quarter of a bit and the context's own without the share its suffix adds, so that what a group finds of
a context adds up.

Distribution: texts become slices of token numbers, written once, in buckets by slice. Each slice sends its distinct
words with counts to groups by hash, and gets the corpus counts and numbers of just those words back. Then, depth by
depth, it sends its contexts with their next symbols, local counts and probabilities after the suffix; a group has
all next symbols of its contexts and returns counts and sums for just what each slice sent. A context that occurs
more than ``GROUP_PAIRS`` times (or a ``MOST_HOT``-th of all tokens) is split over several groups by next symbol; only the sums of
such contexts, of which there are no more than ``MOST_HOT``, pass the driver. What was exchanged is deleted once it
has been read, and so are the words' hashes after the first step. No task, broadcast or driver holds the vocabulary
or a level of the tree, and the slices themselves are never shuffled.

Defined results: a null or empty text, or one of white space, is the end symbol alone; repeated rows
are scored each and count each in training; a null id counts as the empty text for the split; with no
training rows all words are unknown and both scores are 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_batches, freed_shuffles, materialize, remove, table_path
from .words import batches, mix, release, split_words

MAX_DEPTH = 3
LEAST = 2
DISCOUNT = 0.5
COST = 3.0
BASE_ADD = 0.1
SLICE_BYTES = 4 << 20
GROUP_PAIRS = 1 << 19
MOST_HOT = 1 << 19
STEPS = 4
#: a plane of fewer bytes is not compressed
FEW_BYTES = 64
#: groups that travel together, as a binary logarithm: a slice sends them in one piece, and a task counts one after the other
TOGETHER = 3

_U = np.uint64
END = _U(0x2545F4914F6CDD1D)


def is_held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def root(counts: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """Root probabilities of words by their training counts; 0 is unknown."""
    if not n:
        return np.ones(len(counts))
    return np.where(counts > 0, (counts - DISCOUNT) / n, DISCOUNT * vocabulary / n)


def own_halves(listed: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """What contexts keep of their counts, in halves (the discount is one): listed is the sum of the counts of their listed symbols. Positive with any."""
    return 2 * listed - symbols


def rest_of(own: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Mass of contexts that goes to their suffix; own is from ``own_halves``."""
    return np.maximum(1 - own * DISCOUNT / np.maximum(totals, 1), 1e-12)


def is_kept(gain: np.ndarray, listed: np.ndarray, symbols: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The divergence test. gain: what the listed symbols win, in nats."""
    lost = np.maximum(totals - listed, 0) * np.log(rest_of(own_halves(listed, symbols), totals))
    return (symbols > 0) & (gain + lost >= COST * symbols)


# ---- packed numbers ------------------------------------------------------------------------------


def _first(counts: np.ndarray) -> np.ndarray:
    flags = np.zeros(int(counts.sum()), bool)
    flags[np.cumsum(counts) - counts] = True
    return flags


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: sorted or small numbers compress well so."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def whole(data, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def by_frequency(times: np.ndarray) -> np.ndarray:
    """Words by falling frequency."""
    return np.argsort(-times.astype(np.int64), kind="stable")


def pack_tokens(tokens: np.ndarray, n_words: int) -> tuple[np.ndarray, bytes]:
    """(frequencies of words, bytes): token numbers as places by falling frequency, byte by byte from the lowest, so that they compress."""
    times = np.bincount(tokens, minlength=n_words).astype(np.uint32)
    place = np.empty(n_words, np.uint32)
    place[by_frequency(times)] = np.arange(n_words, dtype=np.uint32)
    return times, planes(place[tokens])


def unpack_tokens(times: np.ndarray, data) -> np.ndarray:
    return by_frequency(times)[whole(data, np.uint32)]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers in one piece: byte by byte from the lowest, each such plane compressed on its own, as planes
    differ; planes without a set bit take no room."""
    head, body = [], []
    for c in columns:
        bytes_of = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize)
        used = [k for k in range(c.itemsize) if bytes_of[:, k].any()]
        head += [len(c), len(used)]
        for k in used:
            raw = bytes_of[:, k].tobytes()
            small = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) >= FEW_BYTES else raw
            small = small if len(small) < len(raw) else raw
            head += [k, len(small)]
            body.append(small)
    return np.array([len(head), *head], np.uint32).tobytes() + b"".join(body)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n_head = int(np.frombuffer(data, np.uint32, 1)[0])
    head, at, out = iter(np.frombuffer(data, np.uint32, n_head, 4).tolist()), 4 * (n_head + 1), []
    for kind in kinds:
        n, used = next(head), next(head)
        bytes_of = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        for _ in range(used):
            k, size = next(head), next(head)
            raw = data[at : at + size]
            at += size
            bytes_of[:, k] = np.frombuffer(raw if size == n else pa.decompress(raw, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
        out.append(bytes_of.view(kind).ravel())
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    """Differences of rising numbers; ``np.cumsum`` undoes it."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def run_steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences within runs, which begin at ``starts`` with a number itself."""
    out = steps(values)
    out[starts] = values[starts]
    return out


def undo_run_steps(out: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The numbers of ``run_steps``, given the runs' lengths."""
    values, runs = np.cumsum(out, dtype=out.dtype), runs[runs > 0]
    starts = np.cumsum(runs) - runs
    return values - np.repeat(values[starts] - out[starts], runs)


# ---- slices --------------------------------------------------------------------------------------


def slices(docs: DataFrame) -> DataFrame:
    """Token slices of ``docs`` (id, held, text), in two rows each: of kind ``words`` the distinct words by hash, with training
    counts, and of kind ``tokens`` document ids and lengths, token numbers and all counts of the words."""
    kind = docs.schema["id"].dataType.simpleString()

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches(rows, SLICE_BYTES, "text")):
            found = split_words(batch.column("text"), fold=True)
            counts = found.counts + 1
            hashes = np.insert(found.hashes, np.cumsum(found.counts), END)
            words, tokens = np.unique(hashes, return_inverse=True)
            held = batch.column("held").to_numpy(zero_copy_only=False)
            trained = np.bincount(tokens[~np.repeat(held, counts)], minlength=len(words))
            times, packed = pack_tokens(tokens, len(words))
            one = lambda x: _packed([x])
            cut = pa.array([0, batch.num_rows], pa.int32())
            made = {
                "kind": pa.array(["tokens"]), "slice": pa.array([base + k], pa.int64()), "ids": pa.ListArray.from_arrays(cut, batch.column("id")), "held": pa.ListArray.from_arrays(cut, batch.column("held")),
                "lengths": one(counts.astype(np.int64)), "times": one(times), "tokens": pa.array([packed], pa.binary()), "end": pa.array([int(np.searchsorted(words, END))], pa.int64()),
                "n_train": pa.array([int(trained.sum())], pa.int64()), "n_words": pa.array([len(words)], pa.int64()), "n_tokens": pa.array([len(tokens)], pa.int64()), "words": pa.nulls(1, pa.binary()), "trained": pa.nulls(1, pa.binary()),
            }
            yield pa.record_batch(made)
            yield pa.record_batch({c: pa.nulls(1, x.type) for c, x in made.items()} | {"kind": pa.array(["words"]), "slice": made["slice"], "words": one(words), "trained": one(trained.astype(np.uint32))})

    return docs.mapInArrow(make, f"kind string, slice long, ids array<{kind}>, held array<boolean>, lengths binary, times binary, tokens binary, end long, n_train long, n_words long, n_tokens long, words binary, trained binary")


def opened(batch: pa.RecordBatch, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The end symbol's number, token numbers and documents' lengths of a slice."""
    times, lengths = (whole(batch.column(c)[k].as_buffer(), t) for c, t in (("times", np.uint32), ("lengths", np.int64)))
    return batch.column("end")[k].as_py(), unpack_tokens(times, batch.column("tokens")[k].as_buffer()), lengths


def _bits(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(n / GROUP_PAIRS, 1)))))


def _packed(values: list[np.ndarray]) -> pa.Array:
    return pa.array([planes(v) for v in values], pa.binary())


def _blobs(rows: pa.Table, *kinds: type) -> list[list[np.ndarray]]:
    """Columns of all packed pieces of a group: for each column, a list by piece."""
    return [list(c) for c in zip(*(unpack(x.as_py(), *kinds) for x in rows.column("data")), strict=True)]


def pack_counts(counts: np.ndarray, numbers: np.ndarray) -> bytes:
    """Counts of words, and the numbers, by falling count, of those that occur ``LEAST`` times; with their order known, counts are small steps."""
    common = counts[counts >= LEAST]
    return pack(np.minimum(counts, LEAST).astype(np.uint8), numbers, steps(common[np.argsort(numbers)[::-1]]))


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    least, numbers, rising = unpack(data, np.uint8, np.uint32, np.int64)
    common = np.empty(len(numbers), np.int64)
    common[np.argsort(numbers)[::-1]] = np.cumsum(rising)
    counts = least.astype(np.int64)
    counts[least >= LEAST] = common
    return counts, numbers


def word_counts(held: DataFrame, n_words: int) -> DataFrame:
    """Rows (slice, g, data): corpus counts of each slice's words, group by group, and the numbers of those that occur
    ``LEAST`` times: the group, and the place by falling count. The first row of a group also has its vocabulary."""
    bits = _bits(n_words)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                words, trained = (whole(batch.column(c)[k].as_buffer(), t) for c, t in (("words", _U), ("trained", np.uint32)))
                cuts = np.searchsorted(words >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U)) if bits else np.array([0, len(words)])
                g = [x for x in range(1 << bits) if cuts[x + 1] > cuts[x]]
                data = [pack(steps(words[cuts[x] : cuts[x + 1]]), trained[cuts[x] : cuts[x + 1]]) for x in g]
                yield pa.record_batch({"g": pa.array(g, pa.int32()), "slice": pa.array([batch.column("slice")[k].as_py()] * len(g), pa.int64()), "data": pa.array(data, pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        release()
        parts, trained = _blobs(table, _U, np.uint32)
        parts = [np.cumsum(p, dtype=_U) for p in parts]
        words, place = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate(trained)).astype(np.int64)
        number = np.empty(len(words), np.uint32)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(words), dtype=np.uint32)
        ends = np.cumsum([len(p) for p in parts])
        back = []
        for e, p in zip(ends, parts, strict=True):
            at = place[e - len(p) : e]
            back.append(pack_counts(counts[at], number[at[counts[at] >= LEAST]]))
        vocabulary = [int((counts > 0).sum())] + [0] * (len(parts) - 1)
        return pa.table({"slice": table.column("slice"), "g": table.column("g"), "data": pa.array(back, pa.binary()), "vocabulary": pa.array(vocabulary, pa.int64())})

    sent = held.select("slice", "words", "trained").mapInArrow(send, "g int, slice long, data binary")
    return sent.groupBy("g").applyInArrow(total, "slice long, g int, data binary, vocabulary long")


# ---- learning ------------------------------------------------------------------------------------


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct codes, a place of each, number of each place's code); codes from 0 up. One plain sort, where places fit below the codes."""
    bits = len(codes).bit_length()
    if not len(codes) or int(codes.max()).bit_length() + bits > 63:
        return np.unique(codes, return_index=True, return_inverse=True)
    both = codes << bits | np.arange(len(codes))
    both.sort()
    place = both & ((1 << bits) - 1)
    both >>= bits
    new = np.concatenate([[True], both[1:] != both[:-1]])
    number = np.empty(len(codes), np.int64)
    number[place] = np.cumsum(new) - 1
    return both[new], place[new], number


class Hot:
    """Sums of the contexts that are split over groups: those kept, by number."""

    def __init__(self, rows: list | None = None):
        rows = sorted(rows or [])
        self.ids = np.array([r[0] for r in rows], np.int64).astype(_U)
        totals, listed, symbols, gain = (np.array([r[k] for r in rows], float) for k in range(1, 5))
        kept = is_kept(gain, listed, symbols, totals) if rows else np.zeros(0, bool)
        self.own = np.where(kept, own_halves(listed, symbols), 0).astype(np.int64)

    def of(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.own[at], 0)


class Paths:
    """A slice's tokens on their way down the tree: at each depth the context that ends before each token, and probabilities so far.

    Words are numbered within the slice by rising global number, those that may not be listed last, and so are the
    contexts of a depth; so what is sent rises within each group.
    """

    def __init__(self, end: int, tokens: np.ndarray, lengths: np.ndarray, counts: np.ndarray, ids: np.ndarray, n: int, vocabulary: int):
        """end: number of the end symbol; ids: global numbers of the words that occur ``LEAST`` times."""
        common = counts >= LEAST
        rising = np.argsort(ids)
        order = np.concatenate([np.flatnonzero(common)[rising], np.flatnonzero(~common)])
        place = np.empty(len(counts), np.int64)
        place[order] = np.arange(len(counts))
        self.end, self.tokens, self.first = int(place[end]), place[tokens], np.cumsum(lengths) - lengths
        self.counts, self.ids = counts[order], ids[rising]
        self.p = root(self.counts, n, vocabulary)[self.tokens]
        self.may_list = self.tokens < len(ids)  # a symbol can only be listed where it was after the suffix
        self.keys, self.totals = self.ids, self.counts[: len(ids)]
        self.state = np.where(self.may_list & (self.tokens != self.end), self.tokens, -1)
        self.depth = 0

    def _groups(self, n_groups: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups of all contexts, and of the pairs; contexts that are split go on by next symbol."""
        dealt = lambda x: ((mix(x) >> _U(32)) * _U(n_groups) >> _U(32)).astype(np.uint16 if n_groups <= 1 << 16 else np.uint32)
        home = mix(self.keys)
        groups = dealt(home)
        of_pairs = groups[self.pair_context]
        if (self.totals > hot).any():
            pairs = np.flatnonzero((self.totals > hot)[self.pair_context])
            contexts = self.pair_context[pairs]
            ways = -(-self.totals[contexts] // hot)
            of_pairs[pairs] = dealt(home[contexts] + mix(self.ids[self.pair_word[pairs]]) % ways.astype(_U))
        return groups, of_pairs

    def meet(self, n_groups: int, hot: int) -> None:
        """Contexts and their next symbols, by group and then by rising numbers."""
        before = np.empty_like(self.state)
        before[1:] = self.state[:-1]
        before[self.first] = -1
        self.down = np.flatnonzero(before >= 0)
        self.down_context = before[self.down]
        may = self.may_list[self.down]
        self.open = self.down[may]
        width = max(len(self.ids), 1)
        codes, self.example, self.pair = distinct(self.down_context[may] * width + self.tokens[self.open])
        self.pair_context = codes // width
        self.pair_word = codes - self.pair_context * width
        groups, pair_groups = self._groups(n_groups, hot)
        self.sent = np.argsort(pair_groups, kind="stable")
        self.pair_group, context = pair_groups[self.sent], self.pair_context[self.sent]
        self.starts = starts = np.flatnonzero(np.concatenate([[True], (self.pair_group[1:] != self.pair_group[:-1]) | (context[1:] != context[:-1])])) if len(context) else np.zeros(0, np.int64)
        # contexts that are met here before no symbol that may be listed need their sums as well; those of split ones come to all
        bare = np.zeros(len(self.keys), bool)
        bare[self.down_context] = True
        bare[self.pair_context] = False
        bare = np.flatnonzero(bare & (self.totals <= hot))
        contexts = np.concatenate([context[starts], bare])
        run_group = np.concatenate([self.pair_group[starts], groups[bare]])
        order = np.argsort(run_group.astype(np.int64) << 40 | contexts, kind="stable")
        self.run_context, self.run_group = contexts[order], run_group[order]
        self.runs = np.concatenate([np.diff(np.append(starts, len(context))), np.zeros(len(bare), np.int64)])[order].astype(np.uint32)

    def pieces(self, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(groups that travel together, their packed contexts and pairs); train: flags of the tokens that count."""
        times = np.bincount(self.pair, weights=train[self.open], minlength=len(self.pair_word)).astype(np.uint32)[self.sent]
        below = np.minimum(np.round(-STEPS * np.log2(self.p[self.open[self.example]])), 255).astype(np.uint8)[self.sent]
        word = run_steps(self.ids[self.pair_word[self.sent]], self.starts)
        if not self.depth:  # words rise by falling count, and so do their own probabilities
            below = run_steps(below, self.starts)
        keys, totals = self.keys[self.run_context], self.totals[self.run_context]
        for whole_group in np.unique(self.run_group >> TOGETHER):
            edges = (int(whole_group) << TOGETHER) + np.arange((1 << TOGETHER) + 1)
            cuts, pair_cuts = np.searchsorted(self.run_group, edges), np.searchsorted(self.pair_group, edges)
            a, b, c, d = cuts[0], cuts[-1], pair_cuts[0], pair_cuts[-1]
            yield int(whole_group), pack(steps(keys[a:b]), totals[a:b], self.runs[a:b], word[c:d], times[c:d], below[c:d], cuts - a, pair_cuts - c)

    def take(self, back: list[tuple[int, bytes]], hot: Hot, hot_from: int) -> None:
        """What the groups returned, by group; then one depth down."""
        back = sorted(back)
        parts = [unpack(data, np.uint32, np.uint32, np.int64) for _, data in back]
        empty = [np.zeros(0, k) for k in (np.uint32, np.uint32, np.int64)]
        n_sent, _, own_run = (np.concatenate([e, *[x[k] for x in parts]]) for k, e in enumerate(empty))
        own = np.zeros(len(self.keys), np.int64)
        own[self.run_context] = own_run
        split = np.flatnonzero(self.totals > hot_from)
        own[split] = hot.of(self.keys[split])
        there = n_sent > 0
        some, n = self.sent[there], n_sent[there].astype(np.int64)
        rest, kept = rest_of(own, self.totals), own > 0
        on = kept[self.down_context]
        self.p[self.down[on]] *= rest[self.down_context[on]]
        share = np.zeros(len(self.sent))
        of = self.pair_context[some]
        share[some] = np.where(kept[of], (n - DISCOUNT) / np.maximum(self.totals[of], 1), 0.0)
        self.p[self.open] += share[self.pair]
        self.depth += 1
        if self.depth == MAX_DEPTH:
            return
        # listed pairs are the contexts of the next depth; their numbers rise in the order in which they were sent
        self.keys = np.concatenate([np.zeros(0, _U), *[(_U(g) << _U(32)) + np.cumsum(x[1], dtype=_U) for (g, _), x in zip(back, parts, strict=True)]])
        self.totals = n
        number = np.full(len(self.sent), -1, np.int64)
        number[some] = np.arange(len(some))
        number = number[self.pair]
        self.may_list = np.zeros(len(self.tokens), bool)
        self.may_list[self.open] = number >= 0
        number[self.tokens[self.open] == self.end] = -1
        self.state = np.full(len(self.tokens), -1, np.int64)
        self.state[self.open] = number


def paths_of(batch: pa.RecordBatch, k: int, n: int, vocabulary: int, word_bits: int, n_groups: int, hot: int, hots: list[Hot]) -> tuple[Paths, np.ndarray]:
    """A slice's paths down to a depth with what its groups returned, and its lengths."""
    end, tokens, lengths = opened(batch, k)
    back = lambda name: [(x["g"], x["data"]) for x in batch.column(name)[k].as_py() or []]
    parts = [(g, *unpack_counts(data)) for g, data in sorted(back("words_back"))]
    counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c, _ in parts]])
    ids = np.concatenate([np.zeros(0, _U), *[(i.astype(_U) << _U(word_bits)) + _U(g) for g, _, i in parts]])
    paths = Paths(end, tokens, lengths, counts, ids, n, vocabulary)
    for d, sums in enumerate(hots):
        paths.meet(n_groups, hot)
        paths.take(back(f"back{d}"), sums, hot)
    return paths, lengths


def level_counts(sent_back: DataFrame, n: int, vocabulary: int, word_bits: int, n_groups: int, hot: int, hots: list[Hot]) -> DataFrame:
    """Rows (slice, g, data): what the contexts of the next depth and their next symbols have over all training texts, for
    those each slice sent, group by group. The first row of a group also has the sums of its parts of split contexts."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                release()
                paths, lengths = paths_of(batch, k, n, vocabulary, word_bits, n_groups, hot, hots)
                paths.meet(n_groups, hot)
                pieces = list(paths.pieces(~np.repeat(np.array(batch.column("held")[k].as_py(), bool), lengths)))
                yield pa.record_batch({"g": pa.array([g for g, _ in pieces], pa.int32()), "slice": pa.array([batch.column("slice")[k].as_py()] * len(pieces), pa.int64()), "data": pa.array([d for _, d in pieces], pa.binary())})

    def count(pieces: list[tuple[np.ndarray, ...]], first: int) -> tuple[list[tuple[np.ndarray, ...]], list[dict], int]:
        """For each piece of one group what goes back; the sums of split contexts; how many pairs are listed, numbered from ``first``."""
        contexts, sums, runs, words, times, below = zip(*pieces, strict=True)
        keys, at, place = np.unique(np.concatenate(contexts), return_index=True, return_inverse=True)
        totals = np.concatenate(sums)[at]
        word_ids, word = np.unique(np.concatenate(words), return_inverse=True)
        codes, example, which = distinct(np.repeat(place, np.concatenate(runs)) * len(word_ids) + word)
        owner = codes // max(len(word_ids), 1)
        counts = np.bincount(which, weights=np.concatenate(times), minlength=len(codes)).astype(np.int64)
        counts[counts < LEAST] = 0
        there = np.flatnonzero(counts)
        number = (first + np.cumsum(counts > 0) - 1).astype(np.uint32)
        p = np.exp2(-np.concatenate(below)[example[there]].astype(float) / STEPS)
        of = owner[there]
        gains = counts[there] * np.log((counts[there] - DISCOUNT) / totals[of] / p)
        symbols, listed, gain = (np.bincount(of, weights=v, minlength=len(keys)) for v in (None, counts[there], gains))
        listed, parted = listed.astype(np.int64), totals > hot
        kept = is_kept(gain, listed, symbols, totals)
        back, pair_at, run_at = [], 0, 0
        for c, w in zip(contexts, words, strict=True):
            mine, own = which[pair_at : pair_at + len(w)], place[run_at : run_at + len(c)]
            pair_at, run_at = pair_at + len(w), run_at + len(c)
            n_of = counts[mine].astype(np.uint32)
            here = kept[own] & ~parted[own]
            back.append((n_of, number[mine[n_of > 0]], np.where(here, own_halves(listed, symbols)[own], 0).astype(np.int64)))
        split = [{"id": int(keys[k]), "total": int(totals[k]), "listed": int(listed[k]), "symbols": int(symbols[k]), "gain": float(gain[k])} for k in np.flatnonzero(parted)]
        return back, split, len(there)

    def total(table: pa.Table) -> pa.Table:
        release()
        pieces = [unpack(x.as_py(), _U, np.int64, np.uint32, _U, np.uint32, np.uint8, np.int64, np.int64) for x in table.column("data")]
        pieces = [[np.cumsum(x[0], dtype=_U), *x[1:3], undo_run_steps(x[3], x[2]), x[4], x[5] if hots else undo_run_steps(x[5], x[2]), *x[6:]] for x in pieces]
        made, split, first = [[] for _ in pieces], [], 0
        for k in range(len(pieces[0][6]) - 1):
            part = []
            for context, sums, runs, word, times, below, cuts, pair_cuts in pieces:
                r, q = slice(cuts[k], cuts[k + 1]), slice(pair_cuts[k], pair_cuts[k + 1])
                part.append((context[r], sums[r], runs[r], word[q], times[q], below[q]))
            if any(len(x[0]) for x in part):
                back, more, n_listed = count(part, first)
                split, first = split + more, first + n_listed
                for out, x in zip(made, back, strict=True):
                    out.append(x)
        back = []
        for out in made:
            n_of, number, own = (np.concatenate(c) for c in zip(*out, strict=True))
            back.append(pack(n_of, steps(number), own))
        kind = pa.list_(pa.struct([("id", pa.int64()), ("total", pa.int64()), ("listed", pa.int64()), ("symbols", pa.int64()), ("gain", pa.float64())]))
        return pa.table({"slice": table.column("slice"), "g": table.column("g"), "data": pa.array(back, pa.binary()), "split": pa.array([split] + [[]] * (len(back) - 1), kind)})

    sent = sent_back.mapInArrow(send, "g int, slice long, data binary")
    return sent.groupBy("g").applyInArrow(total, "slice long, g int, data binary, split array<struct<id:bigint,total:bigint,listed:bigint,symbols:bigint,gain:double>>")


def returned(df: DataFrame, buckets: int, name: str, other: str) -> DataFrame:
    """What the groups returned, a row a slice, written as the slices are; ``other`` is what first rows of groups have besides."""
    path = table_path(df.sparkSession, f"{name}-groups")
    written = materialize(df, name, path=path)  # what was sent to the groups goes before their answers are dealt out
    rows = written.select("slice", F.struct("g", "data").alias("x"), other).repartition(buckets, "slice")
    total = F.flatten(F.collect_list(other)) if dict(df.dtypes)[other].startswith("array") else F.sum(other)
    out = materialize(rows.groupBy("slice").agg(F.collect_list("x").alias(name), total.alias(f"{name}_{other}")), name, buckets=(buckets, "slice"))
    remove(df.sparkSession, path)
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    bounded_batches(docs.sparkSession)
    with freed_shuffles(docs.sparkSession):
        return _score(docs, key, text)


def _score(docs: DataFrame, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    columns = f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    made = docs.select(F.col(key).alias("id"), is_held_out(key).alias("held"), F.col(text).cast("string").alias("text"))
    buckets = max(1, min(made.rdd.getNumPartitions(), 100_000))
    path = table_path(spark, "slices")
    written = materialize(slices(made), "slices", buckets=(buckets, "slice"), parts="kind", path=path)
    held = written.filter("kind = 'tokens'").drop("kind", "words", "trained")
    n, n_words, n_tokens = held.agg(F.sum("n_train"), F.sum("n_words"), F.sum("n_tokens")).first()
    if n is None:
        return spark.createDataFrame([], columns)
    counted = returned(word_counts(written.filter("kind = 'words'"), n_words), buckets, "words_back", "vocabulary")
    remove(spark, f"{path}/kind=words")
    vocabulary = counted.agg(F.sum("words_back_vocabulary")).first()[0]
    word_bits, n_groups, hot = _bits(n_words), max(1, -(-n_tokens // GROUP_PAIRS)), max(GROUP_PAIRS, int(n // MOST_HOT))
    with_back = lambda base, back, name: base.join(back.select("slice", name).hint("shuffle_hash"), "slice", "left")
    base = with_back(held.select("slice", "ids", "held", "lengths", "times", "tokens", "end"), counted, "words_back")
    hots: list[Hot] = []
    for depth in range(MAX_DEPTH):
        level = returned(level_counts(base.drop("ids"), n, vocabulary, word_bits, n_groups, hot, list(hots)), buckets, f"back{depth}", "split")
        parts = level.select(F.inline(f"back{depth}_split")).groupBy("id").agg(F.max("total"), F.sum("listed"), F.sum("symbols"), F.sum("gain"))
        hots.append(Hot([tuple(r) for r in parts.collect()]))
        base = with_back(base, level, f"back{depth}")

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_of = n + BASE_ADD * (vocabulary + 1)
        for batch in rows:
            for k in range(batch.num_rows):
                release()
                paths, lengths = paths_of(batch, k, n, vocabulary, word_bits, n_groups, hot, hots)
                starts = np.cumsum(lengths) - lengths
                ids, flags = batch.column("ids")[k].values, batch.column("held")[k].values
                sums = [np.add.reduceat(x, starts) for x in ((paths.counts > 0)[paths.tokens].astype(np.int64), np.log10((paths.counts + BASE_ADD) / base_of)[paths.tokens], np.log10(paths.p))]
                yield pa.RecordBatch.from_arrays([ids, flags, pa.array(lengths), pa.array(sums[0]), pa.array(np.full(len(lengths), n)), pa.array(sums[1]), pa.array(sums[2])], names=[c.split()[0] for c in columns.split(", ")])

    return base.drop("slice").mapInArrow(apply, columns)
