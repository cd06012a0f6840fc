"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` of the schedule gets the golden-ratio point ``frac(i * phi)``; the cumulative target
shares map it to a source, and the slot's rank among its source's slots is the number of the block
it takes. A source's blocks are equal token runs of its documents in shuffled order (by a hash of
the id), read round and round. So any stretch of the schedule is close to the target mix, and each
source stops after exactly its rounded target. A document's copies begin at slots of their own, which order
the mix.

Distribution: running sums and ranks go over (source, part) groups of a size that does not grow,
then over one row per group, so a source with a third of all rows is spread over many tasks. Only
one row per source reaches the driver; the cumulative shares are broadcast with it.

Defined results: a null text has size 0; documents of size 0 are kept in the table and take
nothing; a null source is a source of its own, last in order; repeated rows are documents of their
own, ordered by id and size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_width

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 256
CAP = 3
CYCLE = (1, 2, 3)
GROUP_ROWS = 4096
#: slots whose documents are written together, of the mix in the order of its schedule
SLOTS_PER_PARTITION = 1 << 16
#: rows sent to all executors at most
BROADCAST_ROWS = 1_000_000

getcontext().prec = 60
_PHI = (Decimal(5).sqrt() - 1) / 2
_LOW = float(_PHI)
_HIGH = float(_PHI * (1 << 20) % 1)


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words of the text."""
    return docs.withColumn("size", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"))


def targets(source_sizes: list[int], weights: list[int], cap: int = CAP) -> list[float]:
    """Targets of sources: shares of the total by weight, none above ``cap`` times its size, the excess shared on by weight."""
    total = sum(source_sizes)
    order = sorted(range(len(source_sizes)), key=lambda k: (cap * source_sizes[k] / weights[k], k))
    left, weight = total, sum(weights)
    level = left / weight if weight else 0.0
    for k in order:
        level = left / weight
        if cap * source_sizes[k] / weights[k] >= level:
            break
        left, weight = left - cap * source_sizes[k], weight - weights[k]
        if not weight:
            break
    return [min(w * level, float(cap * s)) for s, w in zip(source_sizes, weights, strict=True)]


class Mix:
    """The sized documents with their places in their source's stream, and the schedule over them."""

    def __init__(self, docs: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "size", block: int = BLOCK_TOKENS, cap: int = CAP, cycle: tuple[int, ...] = CYCLE, keep: tuple[str, ...] = ()):
        """docs: rows with ``key``, ``source`` and ``size``; of further columns those in ``keep`` stay on ``placed``."""
        docs = docs.select(key, source, size, *keep)
        self.spark: SparkSession = docs.sparkSession
        self.block = block
        rows = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"), F.count("*").alias("n")).collect()
        rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        weights = [cycle[k % len(cycle)] for k in range(len(rows))]
        goal = targets([r["size"] for r in rows], weights, cap)
        table = []
        for k, (r, t) in enumerate(zip(rows, goal, strict=True)):
            quota, total = int(np.floor(t + 0.5)), r["size"]
            blocks = -(-total // block)
            need = quota // total * blocks + -(-(quota % total) // block) if total else 0
            table.append((k, r["source"], total, float(t), quota, blocks, need))
        self.sources = self.spark.createDataFrame(table, "k int, source string, source_size long, target double, quota long, blocks long, need long")
        self._small = F.broadcast if len(table) <= BROADCAST_ROWS else lambda df: df
        self._table = table
        parts = max(1, sum(r["n"] for r in rows) // GROUP_ROWS)
        self.placed = self._place(docs, key, source, size, parts)

    def _place(self, docs: DataFrame, key: str, source: str, size: str, parts: int) -> DataFrame:
        """Each document with ``source_size``, ``target`` and ``at``, the tokens of its source before it in shuffled order."""
        order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
        part = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.lit(parts) / F.lit(1 << 32)).cast("long")
        keyed = docs.alias("d").join(self._small(self.sources.alias("s")), F.col(f"d.{source}").eqNullSafe(F.col("s.source"))).select("d.*", "k", "source_size", "target", "quota", "blocks", order.alias("order"), part.alias("part"))
        within = Window.partitionBy("k", "part").orderBy("order", key, size).rowsBetween(Window.unboundedPreceding, -1)
        local = keyed.withColumn("local", F.coalesce(F.sum(size).over(within), F.lit(0)))
        sums = keyed.groupBy("k", "part").agg(F.sum(size).alias("held"))
        before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("k", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
        placed = local.join(starts, ["k", "part"]).withColumn("at", F.col("base") + F.col("local"))
        return placed.drop("part", "order", "local", "base")

    def schedule(self) -> DataFrame:
        """Rows (slot, k, rank): every slot used, its source, and its rank among the source's slots."""
        needed = sum(t[6] for t in self._table)
        quotas = np.array([t[6] for t in self._table], float)
        edges = np.cumsum(quotas) / max(quotas.sum(), 1.0)
        last = int(np.flatnonzero(quotas)[-1]) if needed else 0

        @F.pandas_udf("int")
        def source_of(slot: pd.Series) -> pd.Series:
            high, low = np.divmod(slot.to_numpy(), 1 << 20)
            point = (high * _HIGH + low * _LOW) % 1.0
            return pd.Series(np.minimum(np.searchsorted(edges, point, side="right"), last).astype(np.int32))

        slots = self.spark.range(needed).select(F.col("id").alias("slot"), source_of("id").alias("k"), F.floor(F.col("id") / GROUP_ROWS).alias("part"))
        counts = slots.groupBy("k", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.select("k", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        local = slots.withColumn("local", F.row_number().over(Window.partitionBy("k", "part").orderBy("slot")) - 1)
        ranked = local.join(base, ["k", "part"]).select("slot", "k", (F.col("base") + F.col("local")).alias("rank"))
        used = ranked.join(self._small(self.sources.select("k", "need")), "k").filter("rank < need").select("slot", "k", "rank")
        # the points miss a source's share by a few slots (their discrepancy grows with the logarithm): those follow at the end
        got = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
        missed = np.array([max(t[6] - got.get(t[0], 0), 0) for t in self._table], np.int64)
        late = [(int(at), t[0], t[6] - int(n), t[6]) for t, n, at in zip(self._table, missed, needed + np.cumsum(missed) - missed, strict=True) if n]
        tail = self.spark.createDataFrame(late, "first long, k int, low long, need long").select("first", "k", "low", F.explode(F.sequence("low", F.col("need") - 1)).alias("rank"))
        return used.unionByName(tail.select((F.col("first") + F.col("rank") - F.col("low")).alias("slot"), "k", "rank"))

    @property
    def slots(self) -> int:
        """Slots needed; the few late ones are numbered from here."""
        return sum(t[6] for t in self._table)

    def pieces(self, key: str = "doc_id", size: str = "size") -> DataFrame:
        """The mix: rows (slot, turn, k, at, key, start, length), one for each run of a document's words in a slot."""
        b = self.block
        spans = self.placed.filter(F.col(size) > 0).select(key, "k", "at", F.col(size).alias("n"), "source_size", "quota", "blocks", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col(size) - 1) / b))).alias("number"))
        slots = self.schedule().join(self._small(self.sources.filter("blocks > 0").select("k", F.col("blocks").alias("per_pass"))), "k").select("slot", "k", F.expr("rank % per_pass").alias("number"), F.expr("rank div per_pass").alias("turn"))
        joined = spans.join(slots, ["k", "number"])
        first = F.greatest(F.col("at"), F.col("number") * b)
        end = F.least(F.col("at") + F.col("n"), (F.col("number") + 1) * b, F.col("quota") - F.col("turn") * F.col("source_size"))
        return joined.select("slot", "turn", "k", "at", key, (first - F.col("at")).alias("start"), (end - first).alias("length")).filter("length > 0")

    def taken(self, key: str = "doc_id", size: str = "size") -> DataFrame:
        """``placed`` with ``taken``, the words the mix takes of each document, repeats counted, and ``slots``, where each copy begins."""
        begins = F.when(F.col("start") == 0, F.struct("turn", "slot"))  # one a copy, so no more than the cap and one
        sums = self.pieces(key, size).groupBy("k", "at").agg(F.sum("length").alias("taken"), F.transform(F.array_sort(F.collect_list(begins)), lambda x: x["slot"]).alias("slots"))
        held, empty = self.placed.filter(F.col(size) > 0), self.placed.filter(F.coalesce(F.col(size), F.lit(0)) == 0)
        none = F.array().cast("array<long>")
        return held.join(sums, ["k", "at"], "left").withColumns({"taken": F.coalesce("taken", F.lit(0)), "slots": F.coalesce("slots", none)}).unionByName(empty.withColumns({"taken": F.lit(0).cast("long"), "slots": none}))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with their own columns: as many whole copies of each as the mix takes, and the words of a last, partial one.

    The rows are in the order of the schedule: partitions follow each other, and any stretch of them is close to the
    target mix. Slots hold equal runs of words, so equal ranges of slots are partitions of about one size without
    any sampling.

    The mix is made of a narrow table; what each document gives joins its row by id and a hash of the text,
    broadcast up to ``BROADCAST_ROWS`` rows and by shuffle beyond. Rows that are alike in both are told apart by
    a number, which only they are dealt out for.
    """
    mark = F.xxhash64("text", "source")
    narrow = sizes(docs.select("doc_id", "source", "text", mark.alias("__mark"))).drop("text")
    mix = Mix(materialize(narrow, "mixing"), keep=("__mark",))
    mixed = mix.taken()
    number = lambda *order: F.row_number().over(Window.partitionBy("doc_id", "__mark").orderBy(*order))
    shares = materialize(mixed.withColumn("__number", number("k", "at")).select("doc_id", "__mark", "__number", F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("slots").alias("__slots"), F.col("at").alias("__at")), "shares")
    again = shares.filter("__number = 2").select(F.col("doc_id").alias("__id"), F.col("__mark").alias("__m"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    marked = docs.withColumn("__mark", mark).join(small(again), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m")), "left")
    single = marked.filter("__m IS NULL").withColumn("__number", F.lit(1))
    several = marked.filter("__m IS NOT NULL").withColumn("__number", number(F.xxhash64(*docs.columns)))
    given = small(shares.filter("__taken > 0").withColumnsRenamed({"doc_id": "__doc", "__mark": "__held", "__number": "__place"}))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__mark") == F.col("__held")) & (F.col("__number") == F.col("__place"))
    rows = single.unionByName(several).join(given, same)
    rows = rows.withColumns({"__whole": F.expr("__taken div __size"), "__rest": F.expr("__taken % __size")})
    rows = rows.select("*", F.posexplode("__slots").alias("__copy", "__slot"))
    parts = max(shuffle_width(docs.sparkSession), mix.slots // SLOTS_PER_PARTITION)
    place = F.least(F.expr(f"__slot * {parts} div {max(mix.slots, 1)}"), F.lit(parts - 1)).cast("int")
    rows = rows.repartitionById(parts, place).sortWithinPartitions("__slot", "__at")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.greatest(F.col("__rest"), F.lit(1)).cast("int")), "")
    out = rows.withColumn("text", F.when(F.col("__copy") < F.col("__whole"), F.col("text")).otherwise(cut)).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * s / CAST(w AS DOUBLE) AS r,
    (SELECT sum(s) FROM sources) - coalesce(sum(3 * s) OVER b, 0) AS rest, (SELECT sum(w) FROM sources) - coalesce(sum(w) OVER b, 0) AS wrest
  FROM sources WINDOW b AS (ORDER BY 3 * s / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT CAST(rest AS DOUBLE) / CAST(wrest AS DOUBLE) AS l FROM ranked WHERE r >= CAST(rest AS DOUBLE) / CAST(wrest AS DOUBLE) ORDER BY r, source NULLS LAST LIMIT 1),
goal AS (
  SELECT source, s, least(w * l, CAST(3 * s AS DOUBLE)) AS target, CAST(floor(least(w * l, CAST(3 * s AS DOUBLE)) + 0.5) AS BIGINT) AS quota FROM sources, level),
placed AS (
  SELECT d.doc_id, d.size, d.source, g.s, g.target, g.quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS pos
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, CASE WHEN s > 0 THEN quota // s * ((s + 255) // 256) + (quota % s + 255) // 256 ELSE 0 END AS need FROM goal),
edged AS (
  SELECT k, need, CAST(sum(need) OVER (ORDER BY k) AS DOUBLE) / greatest((SELECT sum(need) FROM numbered), 1) AS edge FROM numbered),
points AS (
  SELECT i AS slot, ((i >> 20) * CAST(HIGH AS DOUBLE) + (i & 1048575) * CAST(LOW AS DOUBLE)) % 1.0 AS p FROM range(CAST((SELECT sum(need) FROM numbered) AS BIGINT)) r(i)),
sourced AS (
  SELECT slot, least((SELECT count(*) FROM edged WHERE edge <= p) + 1, (SELECT max(k) FROM edged WHERE need > 0)) AS k FROM points),
ranked_slots AS (
  SELECT slot, k, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM sourced),
tails AS (
  SELECT e.k, e.need, coalesce(g.n, 0) AS got, (SELECT sum(need) FROM numbered) + coalesce(sum(greatest(e.need - coalesce(g.n, 0), 0)) OVER (ORDER BY e.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM edged e LEFT JOIN (SELECT k, count(*) AS n FROM sourced GROUP BY k) g ON e.k = g.k),
result AS (
  SELECT doc_id, size, placed.s AS source_size, placed.target, k, pos,
    CAST(CASE WHEN size = 0 THEN 0 ELSE placed.quota // placed.s * size + greatest(0, least(size, placed.quota % placed.s - pos)) END AS BIGINT) AS taken
  FROM placed JOIN numbered ON placed.source IS NOT DISTINCT FROM numbered.source)
SELECT r.doc_id, r.size, r.source_size, r.target, r.taken,
  CAST(CASE WHEN r.taken > 0 THEN coalesce(s.slot, t.base + pos // 256 - t.got) END AS BIGINT) AS first_slot
FROM result r LEFT JOIN ranked_slots s ON s.k = r.k AND s.rank = r.pos // 256 JOIN tails t ON t.k = r.k
""".replace("HIGH", repr(_HIGH)).replace("LOW", repr(_LOW))
