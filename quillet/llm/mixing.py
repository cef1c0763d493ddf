"""Mixing sources to target weights.

Each source is one stream of words, its documents in a pseudorandom but fixed order, cut into blocks of
`block` words. The mix is a list of slots over output shards. Each shard draws how many of its slots go to each
source from a multinomial over what the sources still have to give (so the totals come out exact, and the last
shard takes what is left); the k-th slot of a source maps to a block by a pseudorandom permutation of its block
numbers, a new one for each pass over the source. Slots and blocks meet by (source, block).

Targets: sources weigh 3, 1, 2, repeating, by code point, null last, and share `share` times all words; a target
stops at `most` times its source's size, and the excess is shared out again by weight until no target is above.

Streams are laid out without sorting a source in one task: documents fall in buckets by a hash, a window orders
each bucket, and the buckets' totals are summed up. Shards are the leaves of a tree: the driver makes its root, of one
count for each source, and tasks draw the children of a node. One row per source passes the driver. Reruns agree: all draws come from `seed`, hashes and block counts.

Defined cases: a null or blank text has size 0 and is taken 0 times. Null sources are one source, last. Rows that
repeat a doc_id are parts of the stream each for itself; a null doc_id too. Other columns are ignored. An empty
table gives an empty result. Whole texts count, of any length. `mixed_documents` returns the input's columns, whatever
their names; rows that agree in id, source and text are parts of the mix each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, lean, mix, parts_for, stage

# The weights by place.
WEIGHTS = (3, 1, 2)
#: Words of a block, slots of a shard, children of a node of shards, documents of a source in a bucket, buckets in a group; the seed.
BLOCK, SLOTS, FAN, BUCKET, GROUP, SEED = 64, 1000, 64, 500, 4096, 20261
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """How many words WORD finds: starts of words, after white space or at the text's begin."""
    white = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.length(F.trim(white)) == 0, 0).otherwise(F.size(F.split(F.trim(white), " +"))).cast("long")


def targets(sizes: list[int], *, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Each source's target by the weights of its place."""
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in full or free:
            out[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def draws(quotas: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Slots by source of each child of so many shards: multinomials over what remains, cut at it and drawn again; the totals are the quotas."""
    rng, left, out, rest = np.random.default_rng(seed), np.array(quotas, np.int64), [], sum(sizes)
    for size in sizes:
        want = int(left.sum()) * size // rest
        got = np.zeros(len(left), np.int64)
        while (need := want - int(got.sum())) > 0:
            room = left - got
            got += np.minimum(rng.multinomial(need, room / room.sum()), room)
        left -= got
        rest -= size
        out.append(got.tolist())
    return out


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of 0 <= k < n under a permutation of range(n): a four-round Feistel network on the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x):
        left, right = x >> shift, x & mask
        for r in range(4):
            left, right = right, left ^ (mix(right + np.uint64(key % 2**63), r) & mask)
        return left << shift | right

    out = once(k.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _told(source: Column) -> Column:
    """A source with null told apart, and last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def streams(docs: DataFrame) -> DataFrame:
    """(row, doc_id, src, size, at): each row's size and the place of its first word in its source's stream.

    `row` numbers the rows; src is the source with null told apart.
    """
    src = _told(F.col("source"))
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h"))
    rows = stage(rows.select("doc_id", src.alias("src"), "size", "h"), "sizes")
    buckets = 1 + rows.count() // BUCKET
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "h"), F.lit(buckets)))
    # A source's buckets are summed in two levels, so that no task holds all of them.
    totals = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = totals.groupBy("src", "group").agg(F.sum("n").alias("m"))
    groups = groups.select("src", "group", (F.sum("m").over(Window.partitionBy("src").orderBy("group")) - F.col("m")).alias("start"))
    before = F.col("start") + F.sum("n").over(Window.partitionBy("src", "group").orderBy("bucket")) - F.col("n")
    totals = totals.join(groups, ["src", "group"])
    within = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    laid = rows.withColumn("within", within).join(totals.select("src", "bucket", before.alias("before")), ["src", "bucket"])
    return stage(laid.select(F.monotonically_increasing_id().alias("row"), "doc_id", "src", "size", "h", (F.col("before") + F.col("within")).alias("at")), "streams")


def plan(laid: DataFrame, *, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The sources (src, number, source_size, target, blocks) and the slots (shard, slot, number, pass, block) of the mix."""
    spark = laid.sparkSession
    found = sorted((r["src"], r["n"] or 0) for r in laid.groupBy("src").agg(F.sum("size").alias("n")).collect())  # one row per source
    sizes = [n for _, n in found]
    wanted = targets(sizes)
    blocks = [-(-n // block) for n in sizes]
    quotas = [min(2 * b, round(t / n * b)) if n else 0 for t, b, n in zip(wanted, blocks, sizes)]
    sources = spark.createDataFrame([(s, i, n, t, b) for i, ((s, n), t, b) in enumerate(zip(found, wanted, blocks))], "src string, number int, source_size long, target double, blocks long")
    shards = 1 + sum(quotas) // SLOTS
    node = "shard long, shards long, first array<long>, n array<long>"
    nodes, parts = spark.createDataFrame([(0, shards, [0] * len(quotas), quotas)], node), parts_for(spark, shards, 1000)

    def split(batches):
        """The children of nodes, a multinomial each; a node of one shard stays."""
        for b in batches:
            out = []
            for shard, many, first, n in zip(*(c.to_pylist() for c in b.columns)):
                sizes = [many * (i + 1) // FAN - many * i // FAN for i in range(FAN)] if many > FAN else [1] * many
                given = np.array(first, np.int64)
                for size, got in zip(sizes, draws(n, sizes, [seed, shard, many]) if many > 1 else [n]):
                    out.append((shard, size, given.tolist(), got))
                    given += got
                    shard += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["shard", "shards", "first", "n"])

    reach = 1
    while reach < shards:
        nodes, reach = nodes.mapInArrow(lean(split), node).repartition(parts, "shard"), reach * FAN

    def slots(batches):
        for b in batches:
            for shard, _, firsts, counts in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                for number, (first, n) in enumerate(zip(firsts, counts)):
                    k = np.arange(first, first + n)
                    turn, image = k // max(blocks[number], 1), np.empty(n, np.int64)
                    for p in np.unique(turn):
                        image[turn == p] = permuted(k[turn == p] - p * blocks[number], blocks[number], int(mix(np.array([seed * 1_000_003 + number * 1009 + p], np.uint64))[0]))
                    rows.append((np.full(n, shard), np.arange(n), np.full(n, number, np.int32), turn.astype(np.int32), image))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["shard", "slot", "number", "pass", "block"])

    return sources, nodes.mapInArrow(lean(slots), "shard long, slot long, number int, pass int, block long")


def pieces(laid: DataFrame, sources: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(row, number, block, begin, words): the stretch of each row's words that lies in each block."""
    rows = laid.filter("size > 0").join(F.broadcast(sources.select("src", "number")), "src")  # one row per source
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    rows = rows.select("row", "number", "size", "at", F.explode(F.sequence(F.floor(F.col("at") / block), last)).alias("block"))
    begin = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    stop = F.least((F.col("block") + 1) * block - F.col("at"), F.col("size"))
    return rows.select("row", "number", "block", begin.alias("begin"), (stop - begin).alias("words"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = streams(documents(spark, sf_dir))
    sources, slots = plan(laid)
    drawn = slots.groupBy("number", "block").agg(F.count("*").alias("times")).hint("merge")  # its plan says nothing of its size
    taken = pieces(laid, sources).join(drawn, ["number", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = laid.join(F.broadcast(sources.select("src", "source_size", "target")), "src").join(taken, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of docs: one row for each pass that takes words of a document, its text those words in order.

    A document that a pass takes whole keeps its text as it is; n_chars is renewed.
    """
    laid = streams(docs)
    sources, slots = plan(laid)
    drawn = slots.select("number", "block", "pass").hint("merge").join(pieces(laid, sources), ["number", "block"])
    cuts = drawn.groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("begin", "words"))).alias("cuts"), F.sum("words").alias("n"))
    keyed = laid.select("row", F.col("doc_id").alias("cut_id"), F.col("h").alias("cut_h"), F.col("src").alias("cut_src"), "size").join(cuts, "row")
    # Rows that agree in id, source and text hold different places in a stream; each such row of docs meets one of them.
    turn = F.row_number().over(Window.partitionBy("doc_id", "h", "src").orderBy("row"))
    keyed = keyed.join(laid.select("row", turn.alias("copy")), "row")
    mine = Window.partitionBy("own_id", "own_h", "own_src").orderBy("own_id")
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_h"), _told(F.col("source")).alias("own_src"))
    rows = rows.withColumn("own_copy", F.row_number().over(mine))
    on = F.col("own_id").eqNullSafe(F.col("cut_id")) & (F.col("own_h") == F.col("cut_h")) & (F.col("own_src") == F.col("cut_src")) & (F.col("own_copy") == F.col("copy"))
    rows = rows.join(keyed, on)
    text = F.col("whole.text")
    white = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    taken = lambda w: F.flatten(F.transform("cuts", lambda c: F.slice(w, (c["begin"] + 1).cast("int"), c["words"].cast("int"))))
    words = F.element_at(F.transform(F.array(F.split(white, " +")), taken), 1)  # split once for all cuts
    rows = rows.withColumn("mixed", F.when(F.col("n") == F.col("size"), text).otherwise(F.array_join(words, " ")))
    made = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return rows.select(*[made.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])
