"""Exact top-k search by inner product, with a pivot table.

A vector ``x`` is lifted to ``(x, sqrt(M - |x|^2))``, ``M`` the largest squared norm, and a query ``q`` to
``(q, 0)``: then squared distance is ``|q|^2 + M - 2 q.x``, and the nearest are the best. Distances of
all vectors to the pivots are computed once. By the triangle inequality the largest difference of a
candidate's and the query's pivot distances bounds their distance from below and so the score from
above. Candidates are evaluated in bound order until the bound falls under the tenth score.

Distribution: vectors lie in cells by nearest pivot, cells in blocks of ``BLOCK_ROWS``. Each query first
searches one block of its own cell; the score reached there rules out whole cells by their ranges of
pivot distances, and the query travels, packed with others, only to the blocks of the cells left.
Blocks meet queries in groups of bounded size, and only those groups that have queries for their cell;
nothing is collected but the pivot sample and one row per cell.

The number of pivots grows with the fourth root of the rows. They come from at most ``SAMPLE_ROWS`` vectors,
those with the smallest hashes of their ids; all rows are indexed, and results are exact for any pivots.

Scores are exact integers of any components: sums of floats while no partial sum can reach 2**53 (the largest
squared norm tells), of Python's integers beyond.

Defined results: vectors that are null or hold null or non-finite components take no part (nor those with a
component whose 1024-fold is not finite), nor do rows without an id; an empty vector is a zero vector, and
shorter ones count as padded with zeros; rows that share the query's id are its own; repeated rows are
candidates each; ties go to the smaller id; a score beyond a long is the nearest long; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

PIVOTS = 32
LONG = np.iinfo(np.int64)
SAMPLE_ROWS = 2048
BLOCK_ROWS = 512
QUERY_ROWS = 256
QUERIES_PER_GROUP = 4096
SCALE = 1024
#: rows of a block that are evaluated before bounds are looked at again
STEP = 128


def quantized(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x, norm, peak): usable vectors ``floor(1024 * component)`` as whole floats, their squared norm and largest component."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs, norms, peaks = [], [], [], []
            lists = batch.column("x")
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(SCALE * pc.cast(lists.values, pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            offsets = lists.offsets.to_numpy()
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            usable = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            usable &= bad[offsets[1:]] == bad[offsets[:-1]]
            for k in np.flatnonzero(usable):
                x = flat[offsets[k] : offsets[k + 1]]
                ids.append(batch.column("id")[k].as_py())
                xs.append(x.tobytes())
                with np.errstate(over="ignore"):
                    norms.append(float(np.dot(x, x)))
                peaks.append(float(np.abs(x).max(initial=0.0)))
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "x": pa.array(xs, pa.binary()), "norm": pa.array(norms, pa.float64()), "peak": pa.array(peaks, pa.float64())})

    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(make, "id long, x binary, norm double, peak double")


def unpack(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole floats, padded with zeros to ``width``."""
    out = np.zeros((len(column), width))
    for k, value in enumerate(column):
        x = np.frombuffer(value.as_buffer())
        out[k, : len(x)] = x
    return out


@dataclass
class Products:
    """Exact integer inner products, and what their bounds are measured in (a power of two, squared; 1 where floats are exact)."""

    unit: int = 1

    def of(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A row for each query, a column for each candidate."""
        if self.unit == 1:
            return (q @ x.T).astype(np.int64)
        whole = [[int(v) for v in row] for row in x]
        return np.array([[min(max(sum(a * b for a, b in zip([int(v) for v in one], row, strict=True)), LONG.min), LONG.max) for row in whole] for one in q], np.int64).reshape(len(q), len(x))

    def scaled(self, score: int) -> float:
        """Where the bound of a row that reaches the score must be, at least."""
        return float(score) if self.unit == 1 else (score / self.unit if score > LONG.min else -np.inf)


@dataclass
class Pivots:
    """Lifted pivots, and the distances to them."""

    x: np.ndarray
    lift: np.ndarray
    bound: float
    scale: float = 1.0

    @classmethod
    def choose(cls, x: np.ndarray, bound: float, n: int = PIVOTS, scale: float = 1.0) -> Pivots:
        """Farthest-first among the sample. bound: no squared norm is larger, in units of ``scale`` squared."""
        x = x / scale
        points = np.concatenate([x, np.sqrt(np.maximum(bound - (x**2).sum(axis=1), 0))[:, None]], axis=1)
        chosen = [0]
        nearest = np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(n, len(points)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(points - points[chosen[-1]], axis=1))
        return cls(x[chosen], points[chosen, -1], bound, scale)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        lift = np.sqrt(np.maximum(self.bound - (x**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.bound - 2 * (x @ self.x.T + lift[:, None] * self.lift), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q / self.scale
        return np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + self.bound - 2 * q @ self.x.T, 0))

    def score_bound(self, norm: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """No score can be larger, at this distance or more; with room for rounding."""
        total = norm + self.bound
        return (total - np.maximum(apart, 0) ** 2) / 2 + 2e-6 * total

    def norms(self, q: np.ndarray) -> np.ndarray:
        return ((q / self.scale) ** 2).sum(axis=-1)


@dataclass
class Block:
    """Candidates with their distances to the pivots."""

    ids: np.ndarray
    x: np.ndarray
    far: np.ndarray


@dataclass
class Pack:
    """Queries with their distances to the pivots, and the (score, id) that a row must not be worse than."""

    ids: np.ndarray
    x: np.ndarray
    far: np.ndarray
    least: np.ndarray
    last: np.ndarray


def lower_bounds(pack: Pack, block: Block) -> np.ndarray:
    """For each query and candidate the largest difference of their distances to a pivot; the squared distance is no less."""
    out = np.zeros((len(pack.ids), len(block.ids)), np.float32)
    apart = np.empty_like(out)
    for a, b in zip(pack.far.T.astype(np.float32), block.far.T.astype(np.float32), strict=True):
        np.subtract(a[:, None], b, out=apart)
        np.abs(apart, out=apart)
        np.maximum(out, apart, out=out)
    return out


def best(pack: Pack, block: Block, pivots: Pivots, products: Products, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Pack]:
    """(query, id, score) of the k best candidates of each query in a block, best first, and the pack with what a row must reach then.

    Candidates come in the order of their bounds, some at a time for all queries that they may serve, until no bound
    reaches what its query has.
    """
    bounds = pivots.score_bound(pivots.norms(pack.x)[:, None], lower_bounds(pack, block))
    least, last = pack.least.copy(), pack.last.copy()
    reach = np.array([products.scaled(int(s)) for s in least])
    order = np.argsort(-bounds.max(axis=0, initial=-np.inf), kind="stable")
    query, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(order), STEP):
        rows = order[at : at + STEP]
        wanted = (bounds[:, rows] >= reach[:, None]) & (block.ids[rows] != pack.ids[:, None])
        some = np.flatnonzero(wanted.any(axis=1))
        if not len(some):
            if (bounds[:, rows].max(axis=0).max() < reach).all():  # later rows have no larger bounds
                break
            continue
        made = products.of(pack.x[some], block.x[rows])
        fine = wanted[some] & ((made > least[some, None]) | ((made == least[some, None]) & (block.ids[rows] <= last[some, None])))
        i, j = np.nonzero(fine)
        query, ids, scores = np.concatenate([query, some[i]]), np.concatenate([ids, block.ids[rows][j]]), np.concatenate([scores, made[i, j]])
        kept = np.lexsort((ids, ~scores, query))
        query, ids, scores = query[kept], ids[kept], scores[kept]
        starts = np.searchsorted(query, np.arange(len(pack.ids) + 1))
        rank = np.arange(len(query)) - starts[query]
        full = np.flatnonzero(np.diff(starts) >= k)
        least[full], last[full] = scores[starts[full] + k - 1], ids[starts[full] + k - 1]
        reach[full] = [products.scaled(int(s)) for s in least[full]]
        query, ids, scores = query[rank < k], ids[rank < k], scores[rank < k]
    return query, ids, scores, Pack(pack.ids, pack.x, pack.far, least, last)


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query row; ``is_query`` is a condition on ``id``."""
    spark = rows.sparkSession
    columns = "query_id long, rank int, vec_id long, score long"
    vectors = materialize(quantized(rows, key, vector), "vectors")
    bound, width, peak, n_rows = vectors.agg(F.max("norm"), F.max(F.length("x") / 8).cast("long"), F.max("peak"), F.count("*")).first()
    if bound is None:
        return spark.createDataFrame([], columns)
    scale = 1.0 if bound < 2**53 else 2.0 ** np.ceil(np.log2(peak))
    bound = bound if scale == 1 else float(width)
    products = Products(int(scale) ** 2)
    sample = vectors.orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE_ROWS).select("x").toArrow()
    pivots = Pivots.choose(unpack(sample.column("x"), width), bound, max(PIVOTS, 2 * int(np.ceil(n_rows**0.25))), scale)
    m = len(pivots.x)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = pivots.of_rows(unpack(batch.column("x"), width))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(far.argmin(axis=1), pa.int32()), pa.array([f.tobytes() for f in far], pa.binary())], names=["id", "x", "cell", "far"])

    placed = materialize(vectors.mapInArrow(place, "id long, x binary, cell int, far binary"), "placed")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.zeros(m, np.int64)
        for batch in batches:
            cell, far = batch.column("cell").to_numpy(), np.frombuffer(b"".join(batch.column("far").to_pylist())).reshape(-1, m)
            np.minimum.at(low, cell, far)
            np.maximum.at(high, cell, far)
            n += np.bincount(cell, minlength=m)
        held = np.flatnonzero(n)
        yield pa.record_batch({"cell": pa.array(held, pa.int32()), "n": pa.array(n[held]), "low": pa.array(low[held].tolist(), pa.list_(pa.float64())), "high": pa.array(high[held].tolist(), pa.list_(pa.float64()))})

    partial = placed.select("cell", "far").mapInArrow(ranges, "cell int, n long, low array<double>, high array<double>")
    fold = [F.array(*[f(F.col(c)[j]) for j in range(m)]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    cells = partial.groupBy("cell").agg(F.sum("n").alias("n"), *fold).orderBy("cell").collect()
    low, high = np.array([r["low"] for r in cells]), np.array([r["high"] for r in cells])
    number = np.array([r["cell"] for r in cells])
    blocks = {r["cell"]: -(-r["n"] // BLOCK_ROWS) for r in cells}

    by_cell = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("cell"))
    indexed = placed.withColumn("block", F.pmod(F.xxhash64("id"), by_cell))
    queries = placed.filter(is_query)
    n_queries = queries.count()
    packs = max(1, n_queries // QUERY_ROWS)
    groups = max(1, n_queries // QUERIES_PER_GROUP)
    packed = "cell int, pack long, home long, ids binary, xs binary, fars binary"

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        xs = unpack(table.column("x"), width)[order]
        cell = table.column("cell")[0].as_py()
        home = table.column("pack")[0].as_py() % blocks[cell]
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"cell": table.column("cell").slice(0, 1), "pack": table.column("pack").slice(0, 1), "home": pa.array([home], pa.int64()), "ids": one(ids[order]), "xs": one(xs), "fars": one(pivots.of_queries(xs))})

    asked = materialize(queries.withColumn("pack", F.pmod(F.xxhash64("id", F.lit("pack")), F.lit(packs))).groupBy("cell", "pack").applyInArrow(pack, packed), "queries")

    def opened(row: dict) -> Pack:
        ids = np.frombuffer(row["ids"], np.int64)
        ends = [np.frombuffer(row[c], np.int64) if c in row else np.full(len(ids), worst, np.int64) for c, worst in (("scores", LONG.min), ("lasts", LONG.max))]
        return Pack(ids, np.frombuffer(row["xs"]).reshape(len(ids), width), np.frombuffer(row["fars"]).reshape(len(ids), m), *ends)

    def block_of(table: pa.Table) -> Block:
        return Block(table.column("id").to_numpy(), unpack(table.column("x"), width), np.frombuffer(b"".join(table.column("far").to_pylist())).reshape(-1, m))

    def first_look(block: pa.Table, packs_: pa.Table) -> pa.Table:
        """The least (score, id) each query has to reach: its k-th in one block of its own cell."""
        out = []
        held = block_of(block)
        for row in packs_.to_pylist():
            *_, reached = best(opened(row), held, pivots, products, k)
            out.append(row | {"scores": reached.least.tobytes(), "lasts": reached.last.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("cell", pa.int32()), ("pack", pa.int64()), ("home", pa.int64())] + [(c, pa.binary()) for c in ("ids", "xs", "fars", "scores", "lasts")]))

    homes = asked.select("cell", F.col("home").alias("block")).distinct()
    near = indexed.join(homes, ["cell", "block"], "left_semi")
    seeded = near.select("id", "x", "far", "cell", "block").groupBy("cell", "block").cogroup(asked.withColumn("block", F.col("home")).groupBy("cell", "block"))
    looked = materialize(seeded.applyInArrow(lambda b, q: first_look(b, q.drop_columns(["block"])), packed + ", scores binary, lasts binary"), "thresholds")

    travels = "group long, cell int, block long, ids binary, xs binary, fars binary, scores binary, lasts binary"

    def goes(pack: Pack) -> np.ndarray:
        """Which of a pack's queries go to each cell, as it may hold better rows."""
        apart = np.stack([np.maximum(lo - pack.far, pack.far - hi).max(axis=1) for lo, hi in zip(low, high, strict=True)], axis=1)
        reach = np.array([products.scaled(int(s)) for s in pack.least])
        return pivots.score_bound(pivots.norms(pack.x)[:, None], apart) >= reach[:, None]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which groups have queries for which cells."""
        for batch in batches:
            for row in batch.to_pylist():
                cells_ = number[goes(opened(row)).any(axis=0)]
                yield pa.record_batch({"group": pa.array([row["pack"] % groups] * len(cells_), pa.int64()), "cell": pa.array(cells_, pa.int32())})

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pack's queries to every block of the cells they go to."""
        for batch in batches:
            for row in batch.to_pylist():
                pack = opened(row)
                to = goes(pack)
                for c in np.flatnonzero(to.any(axis=0)):
                    q, cell = to[:, c], int(number[c])
                    n = blocks[cell]
                    yield pa.record_batch(
                        {"group": pa.array([row["pack"] % groups] * n, pa.int64()), "cell": pa.array([cell] * n, pa.int32()), "block": pa.array(range(n), pa.int64())}
                        | {c: pa.array([v[q].tobytes()] * n, pa.binary()) for c, v in (("ids", pack.ids), ("xs", pack.x), ("fars", pack.far), ("scores", pack.least), ("lasts", pack.last))}
                    )

    def meet(block: pa.Table, packs_: pa.Table) -> pa.Table:
        held, out = block_of(block), []
        for row in packs_.to_pylist():
            pack = opened(row)
            query, ids, scores, _ = best(pack, held, pivots, products, k)
            out.append((pack.ids[query], ids, scores))
        columns_ = [np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*out, strict=True) if out else ([], [], []))]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns_, strict=True)})

    sent = looked.mapInArrow(travel, travels)
    spread = indexed.select("id", "x", "far", "cell", "block")
    if groups == 1:
        spread = spread.withColumn("group", F.lit(0).cast("long"))
    else:
        spread = spread.join(looked.mapInArrow(visit, "group long, cell int").distinct(), "cell")
    hits = spread.groupBy("group", "cell", "block").cogroup(sent.groupBy("group", "cell", "block")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
