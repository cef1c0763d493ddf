"""Importance resampling toward a target: documents are drawn by how much likelier their n-grams are in the target.

Features are runs of one to three words, hashed to a fixed number of buckets. Two passes read the texts: one counts
buckets over all documents and over the target, one sums an array of gains (one integer a bucket) over each
document's features. A Gumbel term drawn from the id is added, so that the highest scores are a weighted draw
without replacement. The draw sorts nothing: an exact histogram of the integer scores, summed from the top in two
levels, says how many documents lie above each score; the cutoff is the lowest score that still has a free rank,
and only documents at or above it are numbered, by doc_id within their score.

Defined cases: null text has no words (0 features, weight 0). A null id is scored as an empty one and comes last
among ties; rows of one id with one score are ordered by their features. Fewer documents than one rank: nothing is
drawn. Whole texts count, of any length: long ones are read in pieces that share two words. Extra columns of either
table are left out; empty tables give empty results.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, pick, small_batches, stage

#: Buckets, longest run of words, words that a document needs to be drawn, share drawn in hundredths, seed of the draw.
BUCKETS, WORDS_IN_RUN, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text that are hashed together.
PIECE = 1 << 21
#: Lower-cases A-Z and blanks every ASCII character that no word has.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BLANK = zlib.crc32(b" ")
_appended: dict[int, np.ndarray] = {}


def _append_tables(n: int) -> np.ndarray:
    """Four tables of 256 words: by the bytes of a checksum, what it becomes when n bytes follow, but for those bytes' own checksum."""
    if n not in _appended:
        zeros = bytes(n)
        bits = [zlib.crc32(zeros, 1 << b) ^ zlib.crc32(zeros) for b in range(32)]
        tables = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for b in range(8):
                tables[k, (np.arange(256) >> b & 1) == 1] ^= np.uint32(bits[8 * k + b])
        if len(_appended) > 4096:
            _appended.clear()
        _appended[n] = tables
    return _appended[n]


def _appended_to(crc: np.ndarray, table: np.ndarray, tables: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Checksums of strings with a word appended: crc of the string, number of the word's length in tables, the word's own checksum."""
    out = own.copy()
    for k in range(4):
        out ^= tables[table, k, crc >> np.uint32(8 * k) & np.uint32(255)]
    return out


def _runs(words: list[bytes], doc: np.ndarray, fresh: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(checksums, documents) of the runs of one length of words within a document that end at a fresh word, for each length."""
    number: dict[bytes, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    crc = np.array([zlib.crc32(w) for w in number], np.uint32)
    with_blank = np.array([zlib.crc32(w, _BLANK) for w in number], np.uint32)
    sizes, size_at = np.unique([len(w) + 1 for w in number], return_inverse=True)
    tables = np.stack([_append_tables(int(n)) for n in sizes])
    run = crc[at]
    yield run[fresh], doc[fresh]
    for n in range(2, longest + 1):
        run = _appended_to(run[:-1], size_at[at[n - 1 :]], tables, with_blank[at[n - 1 :]])
        whole = (doc[: len(run)] == doc[n - 1 :]) & fresh[n - 1 :]
        yield run[whole], doc[n - 1 :][whole]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A folded text cut at blanks in pieces of about PIECE bytes."""
    at = 0
    while len(text) - at > PIECE:
        end = text.find(b" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def features(texts: list[bytes | None], buckets: int = BUCKETS, longest: int = WORDS_IN_RUN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, document) of every feature of some texts, and the number of new words of each document, a portion at a time."""
    words: list[bytes] = []
    owner: list[int] = []
    old: list[bool] = []
    held, count = 0, np.zeros(len(texts), np.int64)

    def portion():
        doc, fresh = np.array(owner, np.int64), ~np.array(old, bool)
        found = list(_runs(words, doc, fresh, longest)) if words else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), count
        return np.concatenate([c for c, _ in found]).astype(np.int64) % buckets, np.concatenate([d for _, d in found]), count

    for i, text in enumerate(texts):
        last: list[bytes] = []
        for piece in _pieces((text or b"").translate(_FOLD)):
            new = piece.split()
            words += last + new
            owner += [i] * (len(last) + len(new))
            old += [True] * len(last) + [False] * len(new)
            count[i] += len(new)
            last = (last + new)[-(longest - 1) :] if longest > 1 else []
            held += len(piece)
            if held >= PIECE:
                yield portion()
                words, owner, old, held, count = [], [], [], 0, np.zeros(len(texts), np.int64)
    yield portion()


def bucket_counts(rows: DataFrame, text: str = "text", *, buckets: int = BUCKETS, longest: int = WORDS_IN_RUN) -> np.ndarray:
    """Features in each bucket over all rows. A task sends one row a bucket; so does the driver get no more than that."""
    small_batches(rows.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for bucket, _, _ in features(b.column(0).to_pylist(), buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = rows.select(rows[text].cast("binary").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths of a nat: how much likelier it is in the target, with one feature added to every bucket."""
    size, s, t = len(corpus), corpus.astype(float), target.astype(float)
    ratio = ((t + 1) * (s.sum() + size)) / ((s + 1) * (t.sum() + size))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, *, longest: int = WORDS_IN_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of rows (doc_id, text): the gains of a document's features, summed."""
    small_batches(docs.sparkSession)
    buckets, gain = len(gain), gain.astype(float)

    def weigh(batches):
        for b in batches:
            n = b.num_rows
            words, found, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for bucket, doc, count in features(b.column(1).to_pylist(), buckets, longest):
                words += count
                found += np.bincount(doc, minlength=n)
                weight += np.bincount(doc, gain[bucket], minlength=n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(found), pa.array(weight.astype(np.int64))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with score: the weight and a Gumbel term in thousandths, drawn from the hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long"))


def drawn(rows: DataFrame, *, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """rows with rank: 1, 2, 3... for the highest scores, share hundredths of the rows with enough words; else null.

    Scores are integers. They are counted exactly; counts are summed from the top over about the root of their
    range of bins, then within each bin, so neither level holds more rows than that root, whatever the table's size.
    rows is read several times: stage it first.
    """
    may = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    able = rows.filter(may)
    n, low, high = able.agg(F.count("*"), F.min("score"), F.max("score")).first()
    free = share * n // 100
    if not free:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    width = math.isqrt(high - low) + 1
    counts = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", F.floor((F.col("score") - low) / width))
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = counts.groupBy("bin").agg(F.sum("n").alias("n"))
    bins = bins.select(F.col("bin").alias("b"), above(Window.orderBy(F.desc("bin"))).alias("over")).filter(F.col("over") < free)
    within = above(Window.partitionBy("bin").orderBy(F.desc("score")))
    ranks = counts.join(bins, F.col("bin") == F.col("b")).select(F.col("score").alias("s"), (F.col("over") + within).alias("over")).filter(F.col("over") < free)
    ranks = stage(ranks, "score-offsets")
    cutoff = ranks.agg(F.min("s")).first()[0]
    top = may & (F.col("score") >= cutoff)
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features")
    place = F.col("over") + F.row_number().over(order)
    chosen = rows.filter(top).join(ranks, F.col("score") == F.col("s")).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= free, F.col("rank")))
    return chosen.select(*rows.columns, "rank").union(rows.filter(~top).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    gain = gains(bucket_counts(docs), bucket_counts(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return drawn(stage(scored(weighted(docs, gain)), "scores")).select("doc_id", "n_features", "weight", "score", "rank")
