"""Token-ID files by a static range asymmetric numeral system.

One frequency table over the whole corpus is shared by all blocks. A block holds whole documents in ascending
doc_id order and is coded by itself: its ids are dealt to interleaved lanes, each lane a 64-bit state with 32-bit
renormalisation, and the lanes advance together as arrays. Checkpoints keep the lanes' states and the place in
the word stream at regular steps, so that one block's segments decode apart (`segment`) or side by side
(`decode`); a checksum closes the block.

A store is a folder with two Parquet tables. `model`: one row (freq: the scaled table, 32-bit words; scale).
`blocks`: one row per block (part, seq, n_ids, block); parts ascend in doc_id, as do the blocks of a part. A
block's bytes, little-endian: magic RAN1; uint32 scale, lanes, documents, checkpoints; uint64 ids, words, first
(ids of the part before this block); per document int64 doc_id, uint8 null flag, uint32 count; the lanes' states
(uint64); per checkpoint uint32 step, uint64 word place, states; the words (uint32); uint32 crc32 of all before.

Defined cases: null text counts as empty, so the document is its end id alone. Null doc_ids come first; rows that
repeat a doc_id are kept, in order of their ids. An empty table makes a store without blocks. Other columns are
ignored. Whole texts count; a document never spans blocks, so a very long one makes a larger block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, new_path, parts_for, pick, small_batches, stage, swept, texts_of, unstage
from .tokens import encoder

#: Bits of the frequency scale, ids in a block, lanes at most, steps between checkpoints, ids in a part of the store.
SCALE, BLOCK, LANES, STEPS, PART = 20, 1 << 18, 512, 128, 1 << 24
_U = np.uint64
_LOW, _HEAD = _U(1 << 31), struct.Struct("<4sIIIIQQQ")


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts as whole frequencies that sum to 2^scale, at least 1 for each id that occurs."""
    freq = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if len(seen) > 1 << scale:
        raise ValueError("more distinct ids than the scale has places")
    if len(seen):
        share = counts[seen] / counts[seen].sum()
        freq[seen] = np.maximum(1, np.floor(share * (1 << scale))).astype(np.int64)
        spare = (1 << scale) - int(freq.sum())
        if spare >= 0:
            freq[seen[np.argmax(counts[seen])]] += spare
        else:  # the floor of 1 gave out too much: take it back from the largest
            for i in seen[np.argsort(-freq[seen], kind="stable")]:
                take = min(-spare, int(freq[i]) - 1)
                freq[i] -= take
                spare += take
                if not spare:
                    break
    return freq


class Coder:
    """Encodes and decodes blocks of one model."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.freq = scale, freq.astype(_U)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(_U)
        self.symbol: np.ndarray | None = None

    def encode(self, docs: list[tuple[int | None, np.ndarray]], first: int) -> bytes:
        ids = np.concatenate([d for _, d in docs]).astype(np.int64)
        n = len(ids)
        lanes = min(LANES, 1 << max(0, (n // 64).bit_length() - 1))
        steps = -(-n // lanes)
        x = np.full(lanes, _LOW, _U)
        out, marks, shift = [], [], _U(self.scale)
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            f, k = self.freq[s], x[: len(s)]
            full = k >= f << _U(63 - self.scale)
            out.append((k[full] & _U(0xFFFFFFFF)).astype(np.uint32))
            k = np.where(full, k >> _U(32), k)
            q, r = np.divmod(k, f)
            x[: len(s)] = (q << shift) + r + self.start[s]
            if t and t % STEPS == 0:
                marks.append((t, sum(map(len, out)), x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        table = np.zeros(len(docs), [("id", "<i8"), ("null", "u1"), ("n", "<u4")])
        table["id"], table["null"], table["n"] = [i or 0 for i, _ in docs], [i is None for i, _ in docs], [len(d) for _, d in docs]
        parts = [_HEAD.pack(b"RAN1", self.scale, lanes, len(docs), len(marks), n, len(words), first), table.tobytes(), x.astype("<u8").tobytes()]
        for t, behind, states in reversed(marks):
            parts += [struct.pack("<IQ", t, len(words) - behind), states.astype("<u8").tobytes()]
        body = b"".join([*parts, words.astype("<u4").tobytes()])
        return body + struct.pack("<I", zlib.crc32(body))

    def _one_segment(self, ids: np.ndarray, words: np.ndarray, lanes: int, steps: int, at: int, x: np.ndarray) -> None:
        """Decode one segment of so many steps into ids, whose last step may be short."""
        x, mask, shift = x.copy(), _U((1 << self.scale) - 1), _U(self.scale)
        for t in range(steps):
            m = min(lanes, len(ids) - t * lanes)
            k = x[:m]
            slot = k & mask
            s = self.symbol[slot.astype(np.int64)]
            ids[t * lanes : t * lanes + m] = s
            k = self.freq[s] * (k >> shift) + slot - self.start[s]
            need = np.flatnonzero(k < _LOW)
            k[need] = (k[need] << _U(32)) | words[at : at + len(need)]
            at += len(need)
            x[:m] = k

    def _segments(self, ids: np.ndarray, words: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
        """Decode segments side by side: ids (segments, STEPS, lanes), at the place of each in the words, x the lanes' states of each."""
        mask, shift = _U((1 << self.scale) - 1), _U(self.scale)
        for t in range(ids.shape[1]):
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            ids[:, t] = s
            x = self.freq[s] * (x >> shift) + slot - self.start[s]
            need = x < _LOW
            place = at[:, None] + np.cumsum(need, axis=1) - 1
            x[need] = (x[need] << _U(32)) | words[place[need]]
            at = at + need.sum(axis=1)

    def _read(self, block: bytes):
        """(first, documents' table, lanes, ids in all, checkpoints (step, place, states), words) of a block; ValueError if its checksum fails."""
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("block checksum differs")
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))
        magic, scale, lanes, n_docs, n_marks, n, n_words, first = _HEAD.unpack_from(block)
        if magic != b"RAN1" or scale != self.scale:
            raise ValueError("not a block of this model")
        at = _HEAD.size
        table = np.frombuffer(block, [("id", "<i8"), ("null", "u1"), ("n", "<u4")], n_docs, at)
        at += table.nbytes
        marks = [(0, 0, np.frombuffer(block, "<u8", lanes, at))]
        at += 8 * lanes
        for _ in range(n_marks):
            marks.append((*struct.unpack_from("<IQ", block, at), np.frombuffer(block, "<u8", lanes, at + 12)))
            at += 12 + 8 * lanes
        return first, table, lanes, n, marks, np.frombuffer(block, "<u4", n_words, at).astype(_U)

    def segment(self, block: bytes, k: int) -> np.ndarray:
        """The ids of a block's k-th segment alone, from its checkpoint; IndexError past the last."""
        _, _, lanes, n, marks, words = self._read(block)
        step, place, states = marks[k]
        stop = marks[k + 1][0] if k + 1 < len(marks) else -(-n // lanes)
        ids = np.empty(min(n, stop * lanes) - step * lanes, np.int64)
        self._one_segment(ids, words, lanes, stop - step, place, states.astype(_U))
        return ids

    def decode(self, block: bytes) -> tuple[int, list[tuple[int | None, np.ndarray]]]:
        """(first, documents) of a block, its segments decoded side by side from their checkpoints."""
        first, table, lanes, n, marks, words = self._read(block)
        ids, last = np.empty(n, np.int64), marks[-1]
        if len(marks) > 1:
            steps = marks[1][0]
            whole = ids[: last[0] * lanes].reshape(len(marks) - 1, steps, lanes)
            self._segments(whole, words, np.array([m[1] for m in marks[:-1]], np.int64), np.stack([m[2] for m in marks[:-1]]).astype(_U))
        self._one_segment(ids[last[0] * lanes :], words, lanes, -(-n // lanes) - last[0], last[1], last[2].astype(_U))
        cuts = np.cumsum(table["n"].astype(np.int64))
        return first, [(None if z else int(i), ids[e - c : e].astype("<u4")) for i, z, c, e in zip(table["id"], table["null"], table["n"].astype(np.int64), cuts)]


def write_store(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, style: str = "byte") -> None:
    """Encode documents (doc_id, text) and write their store to a folder that Spark can write."""
    spark = docs.sparkSession

    def encode(batches):
        import zstandard

        tool, press, tail = encoder(tokenizer, style), zstandard.ZstdCompressor(3), np.array([end_id], np.uint32)
        for b in batches:
            held = []
            for d in tool.ids(texts_of(b.column(1))):
                d = np.concatenate([d, tail])
                narrow = d.max() < 65536
                held.append((b"2" if narrow else b"4") + press.compress(d.astype("<u2" if narrow else "<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], names=["doc_id", "ids"])

    small_batches(spark)
    ids = stage(pick(docs, doc_id="doc_id", text="text").mapInArrow(encode, "doc_id long, ids binary"), "ids")
    counts = _counts(ids)
    freq = scaled(counts)
    spark.createDataFrame([(bytearray(freq.astype("<u4").tobytes()), SCALE)], "freq binary, scale int").coalesce(1).write.parquet(f"{path}/model")

    def blocks(batches):
        coder, part, seq, first, held, size = Coder(freq), TaskContext.get().partitionId(), 0, 0, [], 0

        def close():
            block = coder.encode(held, first)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), pa.array([block], pa.binary())], names=["part", "seq", "n_ids", "block"])

        for b in batches:
            for i, z in zip(b.column(0).to_pylist(), b.column(1)):
                held.append((i, _ids(z.as_py())))
                size += len(held[-1][1])
                if size >= BLOCK:
                    yield close()
                    seq, first, held, size = seq + 1, first + size, [], 0
        if held:
            yield close()

    parts = parts_for(spark, int(counts.sum()), PART)
    ordered = ids.repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", "ids")
    with swept(spark):
        ordered.mapInArrow(blocks, "part long, seq long, n_ids long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")
    unstage(ids)


def _ids(packed: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed[1:])
    return np.frombuffer(raw, "<u2" if packed[:1] == b"2" else "<u4")


def _counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs; one number for each id of the vocabulary comes to the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            if b.num_rows:
                c = np.bincount(np.concatenate([_ids(z.as_py()) for z in b.column(1)]))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = ids.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"]
    return counts


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, first, ids) of a store: first counts the ids of its part before the document; ids 32-bit words."""
    model = spark.read.parquet(f"{path}/model").first()
    freq, scale = np.frombuffer(bytes(model["freq"]), "<u4"), model["scale"]

    def run(batches):
        coder = Coder(freq, scale)
        for b in batches:
            for part, block in zip(b.column(0).to_pylist(), b.column(1)):
                at, docs = coder.decode(block.as_py())
                sizes = np.array([len(d) for _, d in docs], np.int64)
                firsts = at + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([part] * len(docs), pa.int64()), pa.array(firsts), pa.array([d.tobytes() for _, d in docs], pa.binary())], names=["doc_id", "part", "first", "ids"])

    return spark.read.parquet(f"{path}/blocks").select("part", "block").mapInArrow(run, "doc_id long, part long, first long, ids binary")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): the ids of all parts before; one row for each part that was written."""
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_store(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = read_store(spark, path)
    rows = rows.select("doc_id", "part", "first", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    starts = F.broadcast(part_starts(spark, path))  # as many rows as parts
    return rows.join(starts, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
