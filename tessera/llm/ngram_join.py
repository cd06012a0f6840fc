"""N-gram Jaccard join of documents: exact links of shingle sets, as components.

Two documents link when ``100 * overlap >= 80 * union`` of their sets of five-word shingles. Overlaps
are counted by a blocked sparse matrix product of documents by shingles; size bounds discard pairs.

1. Documents with equal sets are one class, named by its digest and represented by its least id.
2. A set that links shares at least 0.8 of its shingles. Half of all shingles, chosen by a bit of their hash, meet in
   groups of bounded size; a class of which more than ``n - ceil(0.8 n)`` of them are in no other class links
   with nothing and goes no further. So shingles that unrelated texts share by chance don't tie them.
3. Of the classes that are left, shingle frequencies are kept as a sketch of one byte a slot, of bounded size. It
   only orders shingles, rare ones first, and any one order gives the same result.
4. By prefix filtering, sets that link share a shingle among the first ``n - ceil(0.8 n) + 1`` of each.
   Classes that share one are tied to the least of them: linear in the input, however many share it.
   The connected parts of these ties hold every link.
5. Within each part the product's rows are taken block by block. As components are wanted, a row is
   needed only against documents not yet in its own component, and the most typical documents come
   first, so a group of near copies is settled by a few rows. Parts larger than a block are split, with
   their most typical documents in every block; what then is not in the part's largest component is
   compared with all of the part's blocks.

Shingles are 64-bit hashes. All steps pass over texts again rather than move them, and exchange packed
arrays between groups of bounded size; nothing of the order of documents reaches the driver.

Defined results: a null or empty text, or one of white space, has an empty set and is its own component;
a text of one to four words has one shingle, the whole sequence; repeated rows are copies, one result
row each; rows that share an id are judged each by its own text; a null id has a null component unless a copy
has an id, and is not compared; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import bounded_batches, checkpoint, materialize
from .words import _FACTORS, batches, mix, shingles, split_words

SIZE = 5
PERCENT = 80
BATCH_BYTES = 2 << 20
MAX_BATCH_DOCS = 1 << 14
#: shingles that one exchange group handles, about
GROUP_GRAMS = 1 << 19
#: bytes of a class's digest that travel with each shingle
CLASS_BYTES = 6
#: slots of the frequency sketch: at least one for every four shingles, within these bounds
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 26
#: slots that reach the driver at once, about
READ_SLOTS = 1 << 22
#: documents in one block of the product
BLOCK_DOCS = 1024
CENTERS = 16
#: identifiers sent to all executors at most; beyond that texts are joined by shuffle
BROADCAST_ROWS = 2_000_000


# ---- sets ----------------------------------------------------------------------------------------


def gram_sets(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in document order, number per document)."""
    words = split_words(texts, fold=True)
    grams, counts = shingles(words, size)
    doc = np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = words.counts[short] > k
            whole[has] += words.hashes[words.offsets[short[has]] + k] * _FACTORS[k]
        whole = mix(whole ^ mix(words.counts[short].astype(np.uint64)))
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
    order = np.argsort((doc.astype(np.uint64) << np.uint64(49)) | (grams >> np.uint64(15)), kind="stable")
    grams, doc = grams[order], doc[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[fresh], np.bincount(doc[fresh], minlength=len(counts))


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return run[ends] - run[ends - counts]


def digests(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    return mix(_sum_by(mix(grams + np.uint64(1)), counts)), mix(_sum_by(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), counts))


def _slices(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, BATCH_BYTES, "text"):
        for at in range(0, batch.num_rows, MAX_BATCH_DOCS):
            yield batch.slice(at, MAX_BATCH_DOCS)


def document_sets(docs: DataFrame) -> DataFrame:
    """(id, mark, n, half, d1, d2): the size, chosen shingles and digests of every document's set; docs has ``id``, ``mark`` and ``text``."""

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(rows):
            grams, counts = gram_sets(batch.column("text"))
            d1, d2 = digests(grams, counts)
            half = _sum_by(looked_for(grams).astype(np.uint64), counts).view(np.int64)
            yield pa.record_batch({"id": batch.column("id"), "mark": batch.column("mark"), "n": pa.array(counts, pa.int64()), "half": pa.array(half), "d1": pa.array(d1.view(np.int64)), "d2": pa.array(d2.view(np.int64))})

    return docs.mapInArrow(make, "id long, mark long, n long, half long, d1 long, d2 long")


# ---- classes that may link -----------------------------------------------------------------------


def looked_for(grams: np.ndarray) -> np.ndarray:
    """Flags of the half of all shingles that is looked for in other classes."""
    return (grams & np.uint64(1)) == 0


def shared_shingles(docs: DataFrame, total: int) -> DataFrame:
    """(class, shared): how many chosen shingles of a class, named by ``CLASS_BYTES`` of its first digest, other classes have too."""
    groups = _power_of_two(total / 2 / GROUP_GRAMS)
    bits = int(np.log2(groups))

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(rows):
            grams, counts = gram_sets(batch.column("text"))
            classes = np.repeat(digests(grams, counts)[0] >> np.uint64(64 - 8 * CLASS_BYTES), counts)
            mine = looked_for(grams)
            order = np.argsort(grams[mine])
            grams, classes = grams[mine][order], classes[mine][order].view(np.uint8).reshape(-1, 8)[:, :CLASS_BYTES]
            keys = ((grams << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            cuts = np.searchsorted(grams >> np.uint64(64 - bits), np.arange(groups + 1, dtype=np.uint64)) if bits else [0, len(grams)]
            held = [g for g in range(groups) if cuts[g + 1] > cuts[g]]
            if held:
                yield pa.record_batch({"g": pa.array(held, pa.int32()), "keys": _packed([keys[cuts[g] : cuts[g + 1]] for g in held]), "classes": _packed([classes[cuts[g] : cuts[g + 1]] for g in held])})

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")])
        packed = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, CLASS_BYTES) for x in table.column("classes")])
        order = np.argsort(keys)
        again = keys[order][1:] == keys[order][:-1]
        order = order[np.append(again, False) | np.insert(again, 0, False)]
        classes = np.zeros((len(order), 8), np.uint8)
        classes[:, :CLASS_BYTES] = packed[order]
        keys, classes = _distinct_pairs(keys[order], classes.reshape(-1).view(np.int64))
        again = keys[1:] == keys[:-1]
        found, times = np.unique(classes[np.append(again, False) | np.insert(again, 0, False)] if len(keys) else classes, return_counts=True)
        return pa.table({"class": found, "shared": times.astype(np.int64)})

    sent = docs.select("text").mapInArrow(send, "g int, keys binary, classes binary")
    return sent.groupBy("g").applyInArrow(meet, "class long, shared long").groupBy("class").agg(F.sum("shared").alias("shared"))


def may_link(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """The classes that have no more shingles of their own than a set with a link can have."""
    held = classes.join(shared, F.shiftrightunsigned("d1", 64 - 8 * CLASS_BYTES) == F.col("class"), "left")
    return held.filter(F.col("half") - F.coalesce("shared", F.lit(0)) <= F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100"))


# ---- frequency sketch ----------------------------------------------------------------------------


def _power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(x, 1)))))


def _packed(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def frequency_sketch(docs: DataFrame, total: int) -> np.ndarray:
    """Bytes by shingle slot (its hash's top bits): the rounded-down binary logarithm of the highest frequency in the slot."""
    slots = min(MAX_SLOTS, max(MIN_SLOTS, _power_of_two(total / 4)))
    groups = min(slots, _power_of_two(total / GROUP_GRAMS))
    bits = int(np.log2(groups))
    per = slots // groups

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(rows):
            grams = np.sort(gram_sets(batch.column("text"))[0])
            keys = (grams << np.uint64(bits)) >> np.uint64(32)
            cuts = np.searchsorted(grams >> np.uint64(64 - bits), np.arange(groups + 1, dtype=np.uint64)) if bits else [0, len(grams)]
            held = [g for g in range(groups) if cuts[g + 1] > cuts[g]]
            if held:
                yield pa.record_batch({"g": pa.array(held, pa.int32()), "keys": _packed([keys[cuts[g] : cuts[g + 1]].astype(np.uint32) for g in held])})

    def count(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        level = np.minimum(np.log2(np.diff(np.append(starts, len(keys)))).astype(np.int64), 15)
        dense = np.zeros(per, np.uint8)
        common = level > 0
        np.maximum.at(dense, (keys[starts[common]].astype(np.uint64) * np.uint64(per)) >> np.uint64(32), level[common].astype(np.uint8))
        return pa.table({"g": table.column("g").slice(0, 1), "levels": _packed([dense])})

    sent = docs.select("text").mapInArrow(send, "g int, keys binary")
    counted = materialize(sent.groupBy("g").applyInArrow(count, "g int, levels binary"), "sketch")
    out = np.zeros(slots, np.uint8)
    # an iterator runs a job for each partition, so groups are counted before, side by side, and read in few
    for row in counted.coalesce(max(1, slots // READ_SLOTS)).toLocalIterator():
        out[row["g"] * per : (row["g"] + 1) * per] = np.frombuffer(row["levels"], np.uint8)
    return out


def levels_of(sketch: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return sketch[grams >> np.uint64(64 - int(np.log2(len(sketch))))]


# ---- ties by prefixes ----------------------------------------------------------------------------


def prefixes(grams: np.ndarray, counts: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first shingles of every set in the common order, their document)."""
    doc = np.repeat(np.arange(len(counts)), counts).astype(np.uint64)
    order = np.argsort((doc << np.uint64(48)) | (levels_of(sketch, grams).astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20)), kind="stable")
    rank = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)
    least = -(-PERCENT * counts // 100)
    chosen = rank < np.repeat(counts - least + 1, counts)
    return grams[order][chosen], doc[chosen].astype(np.int64)


def _stars(grams: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, least class of each, and ties (least, other)); classes are signed."""
    order = np.lexsort((classes, grams))
    grams, classes = grams[order], classes[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    least = np.repeat(classes[starts], np.diff(np.append(starts, len(grams))))
    other = classes != least
    return grams[starts], classes[starts], least[other], classes[other]


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def ties(docs: DataFrame, total: int, sketch: np.ndarray) -> DataFrame:
    """(src, dst): ties of classes, named by their first digest, that share a prefix shingle."""
    groups = _power_of_two(total / 4 / GROUP_GRAMS)
    bits = int(np.log2(groups))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(_slices(rows)):
            grams, counts = gram_sets(batch.column("text"))
            classes = digests(grams, counts)[0].view(np.int64)
            first, doc = prefixes(grams, counts, shared.value)
            first, least, src, dst = _stars(first, classes[doc])
            cuts = np.searchsorted(first >> np.uint64(64 - bits), np.arange(groups + 1, dtype=np.uint64)) if bits else [0, len(first)]
            held = [g for g in range(groups) if cuts[g + 1] > cuts[g]]
            a, b = [first[cuts[g] : cuts[g + 1]] for g in held], [least[cuts[g] : cuts[g + 1]] for g in held]
            src, dst = _distinct_pairs(src, dst)
            if held or len(src):
                yield pa.record_batch({"g": pa.array([*held, k % groups], pa.int32()), "tie": pa.array([False] * len(held) + [True]), "a": _packed([*a, src]), "b": _packed([*b, dst])})

    def meet(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("tie").to_pylist(), table.column("a"), table.column("b"), strict=True))
        a = {t: np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_buffer(), np.int64) for f, x, _ in rows if f is t]]) for t in (False, True)}
        b = {t: np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_buffer(), np.int64) for f, _, x in rows if f is t]]) for t in (False, True)}
        _, _, src, dst = _stars(a[False].view(np.uint64), b[False])
        src, dst = _distinct_pairs(np.concatenate([src, a[True]]), np.concatenate([dst, b[True]]))
        return pa.table({"src": src, "dst": dst})

    sent = docs.select("text").mapInArrow(send, "g int, tie boolean, a binary, b binary")
    return sent.groupBy("g").applyInArrow(meet, "src long, dst long")


# ---- the product ---------------------------------------------------------------------------------


class _Union:
    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> None:
        named = np.unique(self.label[np.append(others, x)])
        if len(named) > 1:
            self.label[np.isin(self.label, named)] = named[0]


def links_within(sizes: np.ndarray, grams: np.ndarray, typical: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents whose sets are laid end to end.

    left: flags of documents whose rows are wanted; then only links with one of them count.
    """
    n = len(sizes)
    _, column = np.unique(grams, return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    width = np.bincount(column)
    by_column = row[np.argsort(column, kind="stable")]
    column_start = np.concatenate([[0], np.cumsum(width)])
    row_start = np.concatenate([[0], np.cumsum(sizes)])
    union = _Union(n)
    found: list[tuple[int, int]] = []
    rows = np.argsort(-typical, kind="stable")
    for x in rows if left is None else rows[left[rows]]:
        apart = union.label != union.label[x]
        if not apart.any():
            if left is None:
                break
            continue
        apart &= (100 * sizes >= PERCENT * sizes[x]) & (100 * sizes[x] >= PERCENT * sizes)
        if not apart.any():
            continue
        own = column[row_start[x] : row_start[x + 1]]
        lengths = width[own]
        ends = np.cumsum(lengths)
        at = np.repeat(column_start[own] - (ends - lengths), lengths) + np.arange(ends[-1])
        overlap = np.bincount(by_column[at], minlength=n)
        linked = np.flatnonzero(apart & (100 * overlap >= PERCENT * (sizes + sizes[x] - overlap)))
        if len(linked):
            found.extend((int(x), int(y)) for y in linked)
            union.join(int(x), linked)
    return found


def _verify(table: pa.Table) -> pa.Table:
    """Links within each part of an exchange group; rows with ``left`` set are compared with all others, others not among themselves."""
    parts = table.column("part").to_numpy()
    ids = table.column("d1").to_numpy()
    left = table.column("outlier").to_numpy(zero_copy_only=False)
    typical = table.column("typical").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
    src, dst = [], []
    order = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts[order])) + 1
    for members in np.split(order, cuts):
        members = members[np.argsort(~left[members], kind="stable")]
        _, once = np.unique(ids[members], return_index=True)
        members = members[np.sort(once)]
        if len(members) < 2:
            continue
        flags = left[members]
        sizes = np.array([len(sets[m]) for m in members])
        for x, y in links_within(sizes, np.concatenate([sets[m] for m in members]), typical[members], flags if flags.any() else None):
            src.append(ids[members[x]])
            dst.append(ids[members[y]])
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def class_sets(docs: DataFrame, members: DataFrame, n_members: int, sketch: np.ndarray) -> DataFrame:
    """``members`` (rep, d1, d2, ...) with ``grams``, packed, and ``typical``, the mean frequency level of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    wanted = F.broadcast(members) if n_members <= BROADCAST_ROWS else members
    rows = docs.join(wanted, docs["id"] == members["rep"]).select("text", *members.columns)

    def make(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches_):
            grams, counts = gram_sets(batch.column("text"))
            d1, d2 = digests(grams, counts)
            own = np.flatnonzero((d1.view(np.int64) == batch.column("d1").to_numpy()) & (d2.view(np.int64) == batch.column("d2").to_numpy()))
            ends = np.cumsum(counts)
            levels = np.concatenate([[0], np.cumsum(levels_of(shared.value, grams).astype(np.int64))])
            mean = (levels[ends] - levels[ends - counts]) / np.maximum(counts, 1)
            held = batch.select([c for c in batch.schema.names if c != "text"]).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*held.columns, _packed([grams[ends[k] - counts[k] : ends[k]] for k in own]), pa.array(mean[own])], names=[*held.schema.names, "grams", "typical"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
    return rows.mapInArrow(make, f"{kept}, grams binary, typical double")


def link_parts(sets: DataFrame) -> DataFrame:
    """(src, dst): links of classes, by d1, within parts; ``sets`` has part, size, d1, typical and grams."""
    blocks = F.ceil(F.col("size") / BLOCK_DOCS).cast("long")
    cut = sets.withColumn("blocks", blocks).withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("d1"), F.col("blocks"))).otherwise(0))
    # parts of one block share exchange groups; each block of a larger part is one
    n_small = sets.filter(F.col("size") <= BLOCK_DOCS).count()
    shared_groups = max(1, n_small // (BLOCK_DOCS // 2))
    bucket = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("part"), F.lit(shared_groups))).otherwise(F.xxhash64("part", "block"))
    own = cut.select(bucket.alias("bucket"), "part", "d1", F.lit(False).alias("outlier"), "typical", "grams")
    big = cut.filter("blocks > 1")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("typical"), "d1"))
    centers = big.select("part", "d1", "typical", "blocks").withColumn("rank", rank).filter(F.col("rank") <= CENTERS).select("part", "d1")
    everywhere = big.join(centers, ["part", "d1"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = everywhere.select(F.xxhash64("part", "block").alias("bucket"), "part", "d1", F.lit(False).alias("outlier"), "typical", "grams")
    links = checkpoint(own.unionByName(placed).groupBy("bucket").applyInArrow(_verify, "src long, dst long"))
    if big.limit(1).count() == 0:
        return links
    # the rest of large parts: what is not in a part's largest component meets all of its blocks
    found = connected_components(links)
    named = big.select("part", "d1").join(found, F.col("d1") == F.col("node"), "left").select("part", "d1", F.coalesce("component", "d1").alias("component"))
    counts = named.groupBy("part", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("part").agg(F.max(F.struct("n", "component")).alias("top")).select("part", F.col("top.component").alias("component"))
    outliers = checkpoint(named.join(largest, ["part", "component"], "left_anti").select("part", "d1"))
    n_outliers = outliers.count()
    if not n_outliers:
        return links
    small = F.broadcast if n_outliers <= BROADCAST_ROWS else lambda df: df
    sides = outliers.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("sides"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["part", "block", "side", "d1", "outlier", "typical", "grams"]
    met = big.join(small(sides), "part")
    moving = met.join(small(outliers), ["part", "d1"], "left_semi").withColumn("side", F.pmod(F.xxhash64("d1", F.lit("side")), F.col("sides"))).withColumn("block", every("blocks"))
    staying = met.withColumn("side", every("sides"))
    pairs = moving.withColumn("outlier", F.lit(True)).select(*columns).unionByName(staying.withColumn("outlier", F.lit(False)).select(*columns))
    more = pairs.select(F.xxhash64("part", "block", "side").alias("bucket"), "part", "d1", "outlier", "typical", "grams").groupBy("bucket").applyInArrow(_verify, "src long, dst long")
    return links.unionByName(more)


# ---- the operator --------------------------------------------------------------------------------


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    return _components(docs, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _components(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, mark, n, component_id, kept) of every row; mark is a hash of the text, and kept the least id and mark of the component's texts."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    sets = materialize(document_sets(texts), "sets")
    classes = sets.filter("n > 0").groupBy("d1", "d2", "n").agg(F.first("half").alias("half"), F.min("id").alias("rep"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "mark"))).alias("first"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    alone = sets.filter("n = 0").select("id", "mark", "n", F.col("id").alias("component_id"), F.lit(None).cast("struct<id:bigint,mark:bigint>").alias("kept"))
    if not total:
        return alone
    some = materialize(may_link(classes.filter("rep IS NOT NULL"), shared_shingles(texts, total)).select("rep", "d1", "d2", "n"), "classes")
    n_some, total = some.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = n_some <= BROADCAST_ROWS
    reps = some.select("rep").distinct()
    held = texts.join(F.broadcast(reps) if few else reps, texts["id"] == reps["rep"], "left_semi")
    texts = held if few else materialize(held, "texts")
    sketch = frequency_sketch(texts, total)
    tied = connected_components(ties(texts, total, sketch))
    sizes = tied.groupBy("component").agg(F.count("*").alias("size"))
    parts = tied.join(sizes, "component").select(F.col("node").alias("d1"), F.col("component").alias("part"), "size")
    members = checkpoint(some.join(parts, "d1").select("rep", "d1", "d2", "part", "size"))
    linked = connected_components(link_parts(materialize(class_sets(texts, members, members.count(), sketch), "grams")))
    grouped = classes.join(linked, F.col("d1") == F.col("node"), "left").withColumn("component", F.coalesce("component", "d1"))
    least = grouped.filter(F.col("node").isNotNull()).groupBy("component").agg(F.min("rep").alias("least"), F.min("first").alias("kept"))
    named = grouped.join(least, "component", "left").select("d1", "d2", "n", F.coalesce("least", "rep").alias("component_id"), F.coalesce("kept", "first").alias("kept"))
    return sets.filter("n > 0").join(named, ["d1", "d2", "n"]).select("id", "mark", "n", "component_id", "kept").unionByName(alone)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that represent their component: of each one row, that with its least id.

    Where several texts of a component have that id, the one with the smallest hash stays; texts of an id that are not
    linked represent a component each. Of rows that share an id and the text one stays. Rows without an id stay, and
    documents with an empty set represent themselves.
    """
    named = checkpoint(_components(docs, key, text).filter("id IS NOT NULL"))
    other = F.coalesce((F.col("id") != F.col("kept.id")) | (F.col("mark") != F.col("kept.mark")), F.lit(False))
    judged = named.groupBy("id", "mark").agg(F.count("*").alias("rows"), F.max(other).alias("__drop"))
    marks = checkpoint(judged.filter("__drop OR rows > 1").select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__drop"))
    same = (F.col(key).cast("long") == F.col("__id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__mark"))
    marked = docs.join(F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks, same, "left")
    single = marked.filter("__id IS NULL").select(docs.columns)
    order = F.row_number().over(Window.partitionBy(key, "__mark").orderBy(F.xxhash64(*docs.columns)))
    repeated = marked.filter("NOT __drop").withColumn("__order", order).filter("__order = 1").select(docs.columns)
    return single.unionByName(repeated)
