"""Best-fit packing with certified bin counts.

Pieces of at most `size` tokens are dealt over partitions by a hash and packed in each by best-fit decreasing:
longest first, each into the fullest sequence that still has room. Dual-feasible functions give a lower bound
on the sequences that a partition's pieces need. A partition that meets its bound is certified and done. One
with a gap gives the pieces of its emptiest sequences (as many as could close the gap) back; they are dealt
anew over fewer partitions, with those of the other partitions, and packed again, until all that is left is
one certified partition, or a round over one partition. Every round's returned pieces are a small share, and no
partition ever holds more than the pieces that a round deals to it.

Defined cases: null text counts as empty: its one piece is the end id. Pieces of a document keep their order by
`piece`. Repeated rows are packed one by one; a null doc_id is kept; other columns are ignored; an empty table
gives an empty result. Only documents longer than `size` are cut.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, lean, pick, small_batches, stage, texts_of
from .tokens import encoder

SIZE, PER_PART = 2048, 20_000


def piece_rows(docs: DataFrame, path: str, *, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of documents (doc_id, text)."""

    def run(batches):
        tool = encoder(path, "word")
        tail = np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for i, found in zip(b.column(0).to_pylist(), tool.ids(texts_of(b.column(1)))):
                ids = np.concatenate([found, tail]).astype("<u4")
                rows += [(i, k, at, min(size, len(ids) - at), zlib.crc32(ids[at : at + size].tobytes())) for k, at in enumerate(range(0, len(ids), size))]
            if rows:
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    small_batches(docs.sparkSession)
    return pick(docs, doc_id="doc_id", text="text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each length's bin and offset, and the bins' fill. Bins are kept by room, found by a bit set."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set when a bin has room r
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> need
        if fits:
            room = need + ((fits & -fits).bit_length() - 1)
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            at, room = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += need
        if left := room - need:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """lower_bound_of() lengths that are not counted yet."""
    return lower_bound_of(*np.unique(lengths, return_counts=True), size)


def lower_bound_of(x: np.ndarray, n: np.ndarray, size: int) -> int:
    """Least number of bins for n pieces of each length x, by dual-feasible functions: the total, the threshold and the rounding families."""
    if not len(x):
        return 0
    best = -(-int((x * n).sum()) // size)
    for t in range(0, size // 2 + 1, max(1, size // 512)):
        # lengths above size - t fill a bin, those below t count nothing
        best = max(best, -(-int((np.where(x > size - t, size, np.where(x < t, 0, x)) * n).sum()) // size))
    for k in range(2, 33):
        # u_k: x * (k + 1) / size as a whole number stays, else it is rounded down, in units of 1 / k
        whole = (x * (k + 1)) % size == 0
        value = np.where(whole, x * k, (x * (k + 1)) // size * size)
        best = max(best, -(-int((value * n).sum()) // (k * size)))
    return best


def pack_round(rows: DataFrame, parts: int, salt: int, size: int) -> DataFrame:
    """One round: every piece with its bin in its partition and offset; bin null for pieces that are given back."""

    def run(_, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "tie", "doc_id", "piece", "start"], ascending=[False, True, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, size)
        gap = len(fill) - lower_bound(lengths, size)
        open_ = np.zeros(len(fill), bool)
        if gap > 0 and parts > 1:
            # Pieces of one bin more than the room of the other bins could take: the emptiest, and partners with room; half of the bins at most, so that rounds end.
            open_[np.argsort(fill, kind="stable")[: min(-(-len(fill) // 2), 16 * gap + len(fill) // 20)]] = True
        return pd.DataFrame({"part": pdf["part"], "bin": pd.Series(bins, index=pdf.index).where(~open_[bins], -1), "offset": offsets, **{c: pdf[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "tie")}})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "tie"), F.lit(parts)).cast("long"))
    def lean_run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        return run(key, pdf)

    return dealt.groupBy("part").applyInPandas(lean_run, "part long, bin long, offset long, doc_id long, piece int, start long, length long, ids_crc32 long, tie long")


def pack(pieces: DataFrame, *, size: int = SIZE, per_part: int = PER_PART) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    if isinstance(size, bool) or size < 1:
        raise ValueError("size must be a positive number of tokens")
    rows = stage(pieces.withColumn("tie", F.monotonically_increasing_id()), "pieces")
    whole = rows.filter(F.col("length") == size).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("tie")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rest, base = [whole], rows.filter(F.col("length") < size), 0
    left = rest.count()
    salt, parts = 0, -(-left // per_part)
    while left:
        tried = stage(pack_round(rest, parts, salt, size), f"round{salt}")
        sequence = F.lit(base) + F.col("bin") * F.lit(parts) + F.col("part")
        done.append(tried.filter("bin >= 0").select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset"))
        rest = tried.filter("bin < 0").select("doc_id", "piece", "start", "length", "ids_crc32", "tie")
        base += parts * (per_part * 4 + 1)
        left, salt = rest.count(), salt + 1
        # Fewer partitions in each round, down to one, which gives nothing back.
        parts = max(1, min(parts - 1, -(-left // per_part)))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def certificate(packed: DataFrame, *, size: int = SIZE) -> DataFrame:
    """(sequences, bound, certified) of pack()'s result, one row: its sequences against the dual-feasible bound of all its pieces.

    What reaches the driver is the count of each length, `size` numbers at most. An empty table needs no sequence.
    """
    counts = {r["length"]: r["n"] for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bound = lower_bound_of(np.array(sorted(counts), np.int64), np.array([counts[x] for x in sorted(counts)], np.int64), size)
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") == bound).alias("certified"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(piece_rows(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
