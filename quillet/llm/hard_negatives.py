"""Hard negatives by a pivot table.

Inner products become Euclidean distances when each row gets one more coordinate, sqrt(M - |x|^2) with M the largest
squared length, and each anchor a zero: then distance^2 = |q|^2 + M - 2 score. A bounded set of pivots is chosen; the
table holds each row's distances to them. With the anchor's own distances, the triangle inequality brackets every
score from above and below; rows whose bracket cannot reach what is asked are dropped unseen, the rest is computed
exactly.

Anchors meet rows in blocks: a task takes one block of rows and one block of anchors, walks the rows a portion at a
time and raises each anchor's bar with what it has found. Blocks are dealt in rounds of 16 times as many as before;
each round starts from the bars of those before, so that what tasks send on stays near 16 times k a list and round,
however many blocks there are. A label's rows are dealt over as many blocks as their number asks for.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part. Repeated rows are
rows each for itself, so a copy of an anchor may be its positive. A null id is no anchor, keeps its label and comes
last among ties. A missing component counts as 0 beside longer vectors. Scores are exact below 2^53, beyond that
rounded as doubles are and held to 64 bits. A score of 0 or less is a positive's as any other, but no negative can lie
in its window, except 0 for 0. Extra columns are left out; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, stage

#: Pivots, rows they are chosen from, rows and anchors in a block, blocks in the first round and growth of rounds.
PIVOTS, PIVOT_ROWS, ROWS, ANCHORS, ROUND = 8, 256, 1 << 18, 1 << 19, 16
#: Rows walked at a time, and pairs of an anchor and a row bracketed at a time.
PORTION, PAIRS = 4096, 1 << 19
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 10
FOUND = "a_key long, slot int, key long, vec_id long, score long"
#: The last long, and the last double before it.
LIMIT, MOST = 2**63 - 1, float(2**63 - 1024)
#: Labels whose numbers of blocks are broadcast; more of them meet rows in a join.
LABELS = 100_000


def usable(rows: DataFrame, *, vector: str = "embedding") -> DataFrame:
    """(key, vec_id, label, v) of the rows that take part, staged: key numbers rows, v holds floor(256 * component)."""
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    named = pick(rows, vec_id="vec_id", label="label", v=vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    kept = named.filter(F.col("label").isNotNull() & good).withColumn("v", F.transform("v", lambda x: F.floor(256 * x).cast("double")))
    return stage(kept.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "v"), "vectors")


def matrix(vectors: pa.ChunkedArray, width: int | None = None, rest: float = 0.0) -> np.ndarray:
    """Lists of numbers as a matrix; shorter ones end in `rest`."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, width = vectors.flatten().to_numpy(zero_copy_only=False), width or int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), rest)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Pivots:
    """A bounded set of augmented rows, far from each other, and the largest squared length of the table."""

    def __init__(self, rows: DataFrame, count: int = PIVOTS, choose_from: int = PIVOT_ROWS):
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        self.most, self.width = (x or 0 for x in rows.agg(F.max(square), F.max(F.size("v"))).first())
        some = [r[0] for r in rows.orderBy(F.xxhash64("key"), "key").limit(choose_from).select("v").collect()]
        far = np.zeros((len(some), self.width))
        for i, v in enumerate(some):
            far[i, : len(v)] = v
        far = self.augmented(far)
        self.points, near = far[:1], np.full(len(far), np.inf)
        while 0 < len(self.points) < min(count, len(far)):
            near = np.minimum(near, ((far - self.points[-1]) ** 2).sum(1))
            self.points = np.concatenate([self.points, far[[near.argmax()]]])

    def augmented(self, v: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that makes them equally long."""
        return np.concatenate([v, np.sqrt(np.maximum(0, self.most - (v * v).sum(1)))[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Distances of augmented points to the pivots."""
        square = (points * points).sum(1)[:, None] + (self.points * self.points).sum(1) - 2 * points @ self.points.T
        return np.sqrt(np.maximum(0, square))

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        return self.distances(self.augmented(v))

    def of_anchors(self, v: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1))

    def brackets(self, square: np.ndarray, anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each pair that the stored distances allow, widened by the rounding of doubles."""
        nearest = np.zeros((len(anchors), len(rows)))
        farthest = np.full((len(anchors), len(rows)), np.inf)
        for p in range(anchors.shape[1]):
            a, r = anchors[:, p, None], rows[None, :, p]
            np.maximum(nearest, np.abs(a - r), out=nearest)
            np.minimum(farthest, a + r, out=farthest)
        both = square[:, None] + self.most
        slack = 1 + 1e-6 * both
        return (both - farthest**2) / 2 - slack, (both - nearest**2) / 2 + slack


def pivot_table(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """rows with `far`: the distance of each to every pivot, staged."""

    def measure(batches):
        for b in batches:
            far = pivots.of_rows(matrix(b.column(3), pivots.width))
            at = np.arange(len(far) + 1, dtype=np.int32) * far.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, far.ravel())], names=["key", "vec_id", "label", "v", "far"])

    return stage(rows.select("key", "vec_id", "label", "v").mapInArrow(measure, "key long, vec_id long, label long, v array<double>, far array<double>"), "pivot-table")


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids to order by, and which of them are null; null comes last."""
    column = column.combine_chunks()
    return column.fill_null(LIMIT).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


class _Best:
    """The best k rows of each list (an anchor and a slot), by score, id and key; `bar` is the least score that can still enter."""

    def __init__(self, low: np.ndarray, k: int):
        self.k, self.bar = k, low.copy()
        self.list = self.row = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, lists: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, keys: np.ndarray) -> None:
        lists, row, score = np.concatenate([self.list, lists]), np.concatenate([self.row, row]), np.concatenate([self.score, score])
        order = np.lexsort((keys[row], null[row], ids[row], -score, lists))
        lists, row, score = lists[order], row[order], score[order]
        starts = np.nonzero(np.r_[True, lists[1:] != lists[:-1]])[0] if len(lists) else np.zeros(0, np.int64)
        place = np.arange(len(lists)) - np.repeat(starts, np.diff(np.r_[starts, len(lists)]))
        full = place == self.k - 1
        self.bar[lists[full]] = np.maximum(self.bar[lists[full]], score[full])
        self.list, self.row, self.score = (x[place < self.k] for x in (lists, row, score))


def _walk(pivots: Pivots, same_label: bool, k: int):
    """The work of one task: a block of anchors against a block of rows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names=["a_key", "slot", "key", "vec_id", "score"])
        v, far = matrix(rows["v"], pivots.width), matrix(rows["far"])
        keys, labels = rows["key"].to_numpy(), rows["label"].to_numpy()
        ids, null = _ids(rows["vec_id"])
        a_keys, a_labels, q = anchors["a_key"].to_numpy(), anchors["a_label"].to_numpy(), matrix(anchors["a_v"], pivots.width)
        low, high = matrix(anchors["low"], None, np.inf), matrix(anchors["high"], None, -np.inf)
        a_far, square, slots = pivots.of_anchors(q), (q * q).sum(1), low.shape[1]
        out, step = [], max(1, PAIRS // min(PORTION, len(v)))
        for i in range(0, len(q), step):
            part = slice(i, i + step)
            best, top = _Best(low[part].ravel(), k), high[part]
            for j in range(0, len(v), PORTION):
                least, most = pivots.brackets(square[part], a_far[part], far[j : j + PORTION])
                bar = best.bar.reshape(top.shape)
                # What is not a number, from components beyond doubles, is never dropped by a bracket.
                alive = ~(most < bar.min(1)[:, None]) & ~(least > top.max(1)[:, None])
                alive &= (a_labels[part, None] == labels[None, j : j + PORTION]) == same_label
                alive &= a_keys[part, None] != keys[None, j : j + PORTION]
                some, here = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
                if not len(some):
                    continue
                exact = q[part][some] @ v[j + here].T
                alive = alive[np.ix_(some, here)]
                for s in range(slots):
                    a, r = np.nonzero(alive & (exact >= bar[some, s, None]) & (exact <= top[some, s, None]))
                    if len(a):
                        best.add(some[a] * slots + s, j + here[r], exact[a, r], ids, null, keys)
            out.append((a_keys[part][best.list // slots], (best.list % slots).astype(np.int32), best.row, best.score))
        a, s, r, x = (np.concatenate(c) for c in zip(*out))
        x = np.where(x >= 2.0**63, LIMIT, np.where(x <= -(2.0**63), -LIMIT, np.clip(x, -MOST, MOST).astype(np.int64)))
        return pa.table([pa.array(a), pa.array(s), pa.array(keys[r]), pa.array(ids[r], mask=null[r]), pa.array(x)], names=["a_key", "slot", "key", "vec_id", "score"])

    return run


def search(table: DataFrame, anchors: DataFrame, pivots: Pivots, k: int, *, same_label: bool, rows_in_block: int = ROWS, anchors_in_block: int = ANCHORS, first_round: int = ROUND) -> DataFrame:
    """The best k rows of table for each anchor and slot, (a_key, slot, key, vec_id, score), of the anchor's label or of the others.

    anchors has (a_key, a_label, a_v, low, high): a slot for each place in low and high, which bound its scores.
    """
    spark = table.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.col("label") if same_label else F.lit(0).cast("long")
    sizes = stage(table.groupBy(group.alias("g")).agg(F.count("*").alias("n")), "labels")
    labels, total, most = (x or 0 for x in sizes.agg(F.count("*"), F.sum("n"), F.max("n")).first())
    # Small tables are cut finer, so that every core has a block; a hot label has blocks in proportion to its rows.
    in_block = max(1, min(rows_in_block, -(-total // least)))
    blocks, halls = -(-most // in_block), -(-anchors.count() // anchors_in_block)
    sizes = sizes.select("g", F.ceil(F.col("n") / in_block).cast("int").alias("n_blocks"))

    def sized(df: DataFrame, own: Column) -> DataFrame:
        if not same_label:
            return df.withColumns({"g": own, "n_blocks": F.lit(blocks)})
        return df.join(F.broadcast(sizes) if labels <= LABELS else sizes, own == F.col("g"))

    rows = sized(table, group).withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))
    rows = rows.select(F.col("g").alias("r_g"), "block", F.explode(F.sequence(F.lit(0), F.lit(max(halls - 1, 0)))).alias("hall"), "key", "vec_id", "label", "v", "far")
    asked = sized(anchors, F.col("a_label") if same_label else F.lit(0).cast("long"))
    asked = asked.withColumn("hall", F.pmod(F.xxhash64("a_key"), F.lit(max(halls, 1))).cast("int"))
    order = Window.partitionBy("a_key", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "key")
    found, start, end = spark.createDataFrame([], FOUND), 0, first_round
    while start < blocks:
        # A list's bar is its k-th score so far.
        bars = found.groupBy("a_key", "slot").agg(F.count("*").alias("n"), F.min("score").alias("bar")).filter(F.col("n") == k)
        bars = bars.groupBy("a_key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bar"))).alias("bars"))
        now = asked if not start else asked.join(bars, "a_key", "left").withColumn("low", F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("bars")[i.cast("int")].cast("double"), x)))).drop("bars")
        last = F.least(F.col("n_blocks"), F.lit(end)) - 1
        now = now.filter(F.col("n_blocks") > start).select("g", F.explode(F.sequence(F.lit(start), last)).alias("block"), "hall", "a_key", "a_label", "a_v", "low", "high")
        here = rows.filter((F.col("block") >= start) & (F.col("block") < end))
        met = now.groupBy("g", "block", "hall").cogroup(here.groupBy("r_g", "block", "hall")).applyInArrow(_walk(pivots, same_label, k), FOUND)
        found = met.union(found).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")
        found = stage(found, "negatives")
        start, end = end, end * first_round
    return found


def mined(rows: DataFrame, *, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, **blocks: int) -> DataFrame:
    """Negatives of each anchor and positive whose score is low to high hundredths of the positive's.

    rows is what `usable` gives; anchors are the rows whose id divides by `every`. Columns are those of op11.
    """
    pivots = Pivots(rows)
    table = pivot_table(rows, pivots)
    anchors = table.filter(F.col("vec_id") % every == 0).select(F.col("key").alias("a_key"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"))
    free = lambda x: F.array(F.lit(x).cast("double"))
    near = search(table, anchors.withColumns({"low": free(float("-inf")), "high": free(float("inf"))}), pivots, positives, same_label=True, **blocks)
    slots = Window.partitionBy("a_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "key")
    near = near.select("a_key", (F.row_number().over(slots) - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Scores are whole: limits are rounded inwards.
    inward = {"low": F.expr(f"ceil(cast(positive_score as decimal(20,0)) * {low} / 100)"), "high": F.expr(f"floor(cast(positive_score as decimal(20,0)) * {high} / 100)")}
    windows = near.withColumns({n: c.cast("double") for n, c in inward.items()}).groupBy("a_key").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))
    asked = anchors.join(windows, "a_key").select("a_key", "a_label", "a_v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    far = search(table, asked, pivots, negatives, same_label=False, **blocks)
    order = Window.partitionBy("a_key", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "key")
    far = far.withColumn("rank", F.row_number().over(order)).select("a_key", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return anchors.select("a_key", "anchor_id").join(near, "a_key").join(far, ["a_key", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mined(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""
