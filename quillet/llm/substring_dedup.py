"""Suffix-array dedup: a logarithmic family of sparse suffix arrays finds repeated byte strings across documents.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller
doc_id, or in the same one further ahead. Strings are judged on the input.

Sparse arrays: every window of LENGTH bytes is named by its minimizer, the suffix in it that starts with the
least hash of SEED bytes (the leftmost of equals). Equal windows have equal minimizers at equal places, so an
array over minimizer suffixes suffices, about one for each 30 bytes. An entry covers the run of windows that
share one suffix: (kh, uh, doc, at), kh the hash of the suffix's first SEED bytes (64 bits), uh that of the whole
covered string and the suffix's place in it (32 bits more), at the run's first window * 64 + the number of further ones. Arrays are in
order of (kh, uh), a hash order, since only equality of suffixes counts here.

The family: documents come in BATCHES, ascending in doc_id. Each Arrow batch sorts its own entries and drops
later equals; the batch's array is then merge-scanned with all levels in one sorted stream. An entry that a
level or an earlier document holds is covered by earlier text whole: a cut. What remains becomes a level, and
levels of equal size merge in the same scan (1, 2, 4, ...), so an entry is rewritten a logarithmic number of times.

Last, a scan over the levels finds suffix starts that several different entries share. Their matches are
shorter or longer than a run, so their single windows are hashed from the texts (a few per cent of all bytes),
sorted with their places, and all but the earliest of each kind are cuts.

Equality is by hash, 96 bits for entries and windows: of N of them, about N^2 / 2^97 pairs are wrongly taken as equal
(under one in ten thousand runs over 100 TB). Defined cases: null text counts as empty; texts shorter than LENGTH
bytes lose nothing by themselves. Where a doc_id repeats or is null, rows are numbered in order of (doc_id, null
last, hash of the text) and are documents each for itself, so a repeated row loses what its first copy keeps, and
rows of one id with other texts do not touch each other. Other columns are ignored; an empty table gives an empty
result; texts count whole.
"""

from __future__ import annotations



import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix, new_path, pick, release, small_batches, stage, swept
from .ngram_join import _power

#: Bytes of a string, bytes of a minimizer, least batches, characters of a batch beyond those.
LENGTH, SEED, BATCHES, BATCH_CHARS = 100, 40, 4, 1 << 38
_U = np.uint64
_BYTE, _BYTE2 = mix(np.arange(256, dtype=_U), 21), mix(np.arange(256, dtype=_U), 22)
_NAMES = ["kind", "kh", "uh", "doc", "at"]
_ENTRY = "kind int, kh long, uh int, doc long, at long"


class Hashes:
    """Hashes of a text's substrings from prefix sums."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        self.n = len(data)
        up, self.down = _power(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(table[data] * up[: self.n], dtype=_U)])

    def of(self, begin, stop) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[begin]) * self.down[begin])


def entries(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kh, uh and at of one text's entries; length - seed must stay under 63."""
    n = len(data)
    if n < length:
        return np.zeros(0, _U), np.zeros(0, np.int32), np.zeros(0, np.int64)
    hashes = Hashes(data)
    starts = np.arange(n - seed + 1)
    h = hashes.of(starts, starts + seed)
    width, m = length - seed + 1, n - length + 1
    rows = -(-len(h) // width)
    keys = np.full(rows * width, ~_U(0))
    keys[: len(h)] = (h >> _U(32) << _U(32)) | starts.astype(_U)
    keys = keys.reshape(rows, width)
    ahead = np.minimum.accumulate(keys, axis=1).ravel()
    behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [m]]) - 1
    whole = hashes.of(first, last + length)
    uh = (mix(whole + (least[first] - first).astype(_U), 1) >> _U(32)).astype(np.uint32).view(np.int32)
    return h[least[first]], uh, first * 64 + (last - first)


def _rows(kind: np.ndarray, kh, uh, doc, at) -> pa.RecordBatch:
    arrays = (kind.astype(np.int32), kh.view(np.int64), uh.astype(np.int32), doc, at)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=_NAMES)


def _cut_rows(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Entries as cuts: at the first byte, uh the number of bytes; runs that touch in a document are one row."""
    o = np.lexsort((at, doc))
    doc, begin, stop = doc[o], at[o] >> 6, (at[o] >> 6) + (at[o] & 63) + LENGTH
    opens = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (begin[1:] > stop[:-1])]))
    closes = np.concatenate([opens[1:], [len(doc)]]) - 1
    doc, begin, stop = doc[opens], begin[opens], stop[closes]
    return _rows(np.ones(len(doc)), mix(doc.view(_U), 3), stop - begin, doc, begin)


def local_arrays(docs: DataFrame) -> DataFrame:
    """Entries (kind 0) of documents (doc, text), sorted and without later equals in each Arrow batch; those are cuts (kind 1)."""

    def run(batches):
        for b in batches:
            ids, found, size = b.column(0).to_numpy(), [], 0
            order = np.argsort(ids, kind="stable").tolist()
            for place, i in enumerate(order):
                t = b.column(1)[i].as_py()
                if t:
                    kh, uh, at = entries(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
                    if len(kh):
                        found.append((kh, uh, np.full(len(kh), ids[i], np.int64), at))
                        size += len(kh)
                if found and (size > 400_000 or place + 1 == len(order)):
                    kh, uh, doc, at = (np.concatenate(x) for x in zip(*found))
                    o = np.lexsort((uh, kh))  # stable: equals stay in order of doc and place
                    kh, uh, doc, at = kh[o], uh[o], doc[o], at[o]
                    same = np.concatenate([[False], (kh[1:] == kh[:-1]) & (uh[1:] == uh[:-1])])
                    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(kh))))
                    later = same & ((doc > doc[head]) | (at >> 6 > at[head] >> 6))
                    yield _rows(np.zeros(int((~later).sum())), kh[~later], uh[~later], doc[~later], at[~later])
                    if later.any():
                        yield _cut_rows(doc[later], at[later])
                    found, size = [], 0

    return docs.mapInArrow(run, _ENTRY)


def _in_order(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "kh").sortWithinPartitions("kh", "uh", "doc", "at")


class Family:
    """Levels of arrays, each with its size in batches, largest first, and the cuts found so far (doc, begin, stop)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.cuts = spark, [], []

    def add(self, docs: DataFrame) -> None:
        """Scan a batch of documents (doc, text), all after the earlier batches' documents, and take it in."""
        merged, size = [], 1
        while self.levels and self.levels[-1][0] == size:
            merged.append(self.levels.pop()[1])
            size *= 2
        # kind 0: new; 1: cut already; 2: in a level that merges now; 3: in a level that only serves the scan
        rows = local_arrays(docs)
        for kind, tables in ((2, merged), (3, [t for _, t in self.levels])):
            for t in tables:
                rows = rows.union(t.select(F.lit(kind).alias("kind"), "kh", "uh", "doc", "at"))

        def scan(batches):
            held = None
            for b in batches:
                kind, kh, uh, doc, at = (b.column(i).to_numpy() for i in range(5))
                if not len(kind):
                    continue
                fresh = np.ones(len(kh), bool)
                fresh[1:] = (kh[1:] != kh[:-1]) | (uh[1:] != uh[:-1])
                if held is not None and (kh[0], uh[0]) == held[:2]:
                    fresh[0] = False
                at_head = np.maximum.accumulate(np.where(fresh, np.arange(len(kh)), -1))
                first_doc, first_at = doc[at_head], at[at_head]
                if held is not None:
                    first_doc, first_at = np.where(at_head < 0, held[2], first_doc), np.where(at_head < 0, held[3], first_at)
                later = (kind == 0) & ~fresh & ((doc > first_doc) | (at >> 6 > first_at >> 6))
                keep, told = fresh & ((kind == 0) | (kind == 2)), kind == 1
                yield _rows(np.zeros(int(keep.sum())), kh[keep], uh[keep], doc[keep], at[keep])
                if told.any():
                    yield _rows(np.ones(int(told.sum())), np.zeros(int(told.sum()), np.int64), uh[told], doc[told], at[told])
                if later.any():
                    cut = _cut_rows(doc[later], at[later])
                    yield cut.set_column(1, "kh", pa.array(np.zeros(cut.num_rows, np.int64)))
                held = (kh[-1], uh[-1], first_doc[-1], first_at[-1])

        path = new_path(self.spark, "scan")
        with swept(self.spark):
            _in_order(rows).mapInArrow(scan, _ENTRY).write.partitionBy("kind").option("compression", "zstd").parquet(path)
        whole = self.spark.read.schema("kh long, uh int, doc long, at long, kind int").parquet(path)
        cut = whole.filter("kind = 1").select("doc", F.col("at").alias("begin"), (F.col("at") + F.col("uh")).alias("stop"))
        self.cuts.append(cut)
        self.levels.append((size, whole.filter("kind = 0").select("kh", "uh", "doc", "at")))
        for t in merged:
            _drop_kind(t, 0)
        release(self.spark)

    def shared(self) -> DataFrame:
        """(doc, at) of the entries whose suffix start other entries of the family have too."""
        rows = self.levels[0][1]
        for _, t in self.levels[1:]:
            rows = rows.union(t)

        def scan(batches):
            held, sent = None, True
            for b in batches:
                kh, doc, at = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
                if not len(kh):
                    continue
                same = np.zeros(len(kh) + 1, bool)
                same[1:-1] = kh[1:] == kh[:-1]
                same[0] = held is not None and held[0] == kh[0]
                hit = same[:-1] | same[1:]
                if same[0] and not sent:
                    yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int64())], names=["doc", "at"])
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(at[hit])], names=["doc", "at"])
                held, sent = (kh[-1], doc[-1], at[-1]), bool(hit[-1])

        return _in_order(rows).select("kh", "uh", "doc", "at").mapInArrow(scan, "doc long, at long")


def _drop_kind(table: DataFrame, kind: int) -> None:
    """Delete the files of one kind below a scan's folder. A table's files are those of all kinds, in any order."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.endswith(f"/kind={kind}"):
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def single_windows(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, begin, stop) of those windows of asked entries (doc, at) whose string starts earlier in another asked one."""
    lists = asked.groupBy("doc").agg(F.collect_set("at").alias("at")).withColumnRenamed("doc", "asked_doc")

    def hashed(batches):
        for b in batches:
            for doc, t, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                at = np.array(at.as_py(), np.int64)
                counts = (at & 63) + 1
                begin = np.repeat(at >> 6, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                h, g = (Hashes(data, table).of(begin, begin + LENGTH) for table in (_BYTE, _BYTE2))
                g = (g >> _U(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g), pa.array(np.full(len(h), doc, np.int64)), pa.array(begin)], names=["h", "g", "doc", "begin"])

    windows = docs.join(lists, F.col("doc") == F.col("asked_doc")).select("doc", "text", "at").mapInArrow(hashed, "h long, g int, doc long, begin long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = windows.repartition(parts, "h").sortWithinPartitions("h", "g", "doc", "begin")

    def later(batches):
        held = None
        for b in batches:
            h, g, doc, begin = (b.column(i).to_numpy() for i in range(4))
            if not len(h):
                continue
            fresh = np.concatenate([[held is None or held[0] != (h[0], g[0])], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), -1))
            d, p = doc[head], begin[head]
            if held is not None:
                d, p = np.where(head < 0, held[1], d), np.where(head < 0, held[2], p)
            cut = (doc > d) | (begin > p)
            yield pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(begin[cut]), pa.array(begin[cut] + LENGTH)], names=["doc", "begin", "stop"])
            held = ((h[-1], g[-1]), d[-1], p[-1])

    return ordered.mapInArrow(later, "doc long, begin long, stop long")


def find_repeats(docs: DataFrame, *, batches: int = BATCHES) -> DataFrame:
    """(doc, begin, stop): byte ranges of documents (doc, text) to remove; they may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    batches = max(batches, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BATCH_CHARS)
    cuts = docs.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000).alias("q")).first()["q"] if batches > 1 else None
    limits = [None, *sorted(set(cuts or [])), None]
    family = Family(spark)
    for low, high in zip(limits[:-1], limits[1:]):
        part = docs
        if low is not None:
            part = part.filter(F.col("doc") >= low)
        if high is not None:
            part = part.filter(F.col("doc") < high)
        family.add(part)
    asked = stage(family.shared(), "asked")
    for _, t in family.levels:
        _drop_kind(t, 0)
    release(spark)
    found = stage(single_windows(docs, asked), "single")
    release(spark)
    for c in family.cuts:
        found = found.union(c)
    return found


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for documents (doc, doc_id, text): kept holds the bytes that stay."""
    lists = found.groupBy("doc").agg(F.collect_list(F.struct("begin", "stop")).alias("cuts")).withColumnRenamed("doc", "cut_doc")

    def run(batches):
        for b in batches:
            out = []
            for doc, t, cuts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                if not cuts.is_valid:
                    out.append((doc, data.tobytes(), len(data), 0, 0))
                    continue
                ranges = cuts.values
                step = np.zeros(len(data) + 1, np.int64)
                begin, stop = (ranges.field(i).to_numpy() for i in range(2))
                np.add.at(step, begin, 1)
                np.add.at(step, stop, -1)
                gone = np.cumsum(step[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((doc, data[~gone].tobytes(), len(data), int(gone.sum()), spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = docs.join(lists, F.col("doc") == F.col("cut_doc"), "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): doc, a number for each row in order of doc_id; the doc_id itself where that is one."""
    rows = pick(docs, doc_id="doc_id", text="text")
    if rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.col("place")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stage(ranged.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "numbered")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(documents(spark, sf_dir))
    kept = remove(docs, find_repeats(docs.select("doc", "text")))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
