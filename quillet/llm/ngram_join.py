"""Parity-sketch join: near-duplicate documents by Jaccard likeness of word 5-grams.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. Two documents link when
100 * |intersection| >= 80 * |union|, so their sets differ in at most (|A| + |B|) / 9 shingles.

1. Documents with equal sets form a class (a 128-bit digest); only classes are compared.
2. Shingles toggle bits of a sketch. The sketch is cut in m parts by a hash of the shingle, and a part is
   told by the XOR of its shingles' words; m depends on the band of set sizes (powers of two; a set also
   enters the band below when a partner there is possible). A pair that differs in d shingles leaves m - d
   parts untouched, so it agrees on one (pigeonhole). Parts of fewer than two shingles are left out where
   that is safe: a pair whose untouched parts are all that small has at least m - d such parts on either
   side, so a set with that many emits them as well (first those of one shingle, then the empty ones).
3. Classes that send an equal key form a group. Groups are found in one stream in key order.
4. Rounds link components: in a group, a member meets members of other components whose sketches' Hamming
   distance (at most the symmetric difference) keeps the bound, and the pairs are verified with their sets.
   The first round takes one group for each class, the second all groups that hold several components, later
   ones those that paired something in the round before. In the first rounds a member meets the nearest such
   member, then the nearest of each other component, and in the end all that are left; pairs that failed are
   kept out. A group that pairs nothing has no pair left that could link its components, and components only
   grow, so it is done; when all are, no link is lost.

Classes are named by 64 bits of their digest; should two digests of a corpus agree in those, all is hashed anew.
Shingles are 64-bit hashes: two of a corpus of N collide with N^2 / 2^65, which shifts one likeness by one shingle.

Defined cases: null or blank text: empty set, no link, its own component. Fewer than five words: the whole
sequence is the one shingle. Rows that repeat a doc_id are judged each by its own text. Rows with a null doc_id
take part; a component's id is its smallest doc_id, null if it has none. Empty tables give empty results; other
columns are ignored, whatever their names; texts count whole.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, mix, parts_for, pick, release, small_batches, stage, unstage
from .links import components

#: Text bytes that are hashed together; first rounds, over one group for each class.
CHUNK, EARLY = 1 << 19, 1
#: Documents that common shingles are fitted on, about, and the number of different ones among them that makes a shingle common.
COMMON_DOCS, COMMON_IN = 4000, 5
#: Shingles whose keys are made together, classes that a task remembers as sent, rows of a key held before they leave, key rows in a partition.
TOGETHER, SENT, HELD, PART = 200_000, 100_000, 1 << 16, 2_000_000
_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BYTE = mix(np.arange(256, dtype=_U), 11)
_ODD = [_U(int(x) | 1) for x in mix(np.arange(5, dtype=_U), 12)]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]), dtype=_U) for b in (_U(_BASE), _U(pow(_BASE, -1, 2**64)))]
    return _powers[0][:n], _powers[1][:n]


def _chunk_sets(data: np.ndarray, ends: np.ndarray, width: int):
    """For each document of one chunk of UTF-8 bytes (ends: where each ends), its sorted distinct shingle hashes."""
    begins = np.concatenate([[0], ends[:-1]])
    low, n = _LOW[data], len(data)
    dark = ~_WHITE[low]
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    first = dark.copy()
    first[1:] &= ~dark[:-1] | edge[1:n]
    last = dark.copy()
    last[:-1] &= ~dark[1:] | edge[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        yield from (np.zeros(0, _U) for _ in ends)
        return
    up, down = _power(n)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[low] * up, dtype=_U)])
    words = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(_U))
    grams = sum((words[i : len(words) - width + 1 + i] * _ODD[i] for i in range(width)), np.zeros(max(0, len(words) - width + 1), _U)) if len(words) >= width else np.zeros(0, _U)
    grams = mix(grams, 1)
    for a, b in zip(np.searchsorted(start, begins), np.searchsorted(start, ends)):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield mix(sum((words[a + i : a + i + 1] * _ODD[i] for i in range(b - a)), np.array([b - a], _U)), 2)
        else:
            yield np.zeros(0, _U)


def sets(texts: list[str | None], width: int = 5):
    """The sorted distinct shingle hashes of each text."""
    held: list[bytes] = []
    size = 0

    def flush():
        ends = np.cumsum([len(x) for x in held])
        return _chunk_sets(np.frombuffer(b"".join(held), np.uint8), ends, width)

    for text in texts:
        b = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > CHUNK:
            yield from flush()
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield from flush()


def digest(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    return int(np.bitwise_xor.reduce(mix(s, 4 + 1000 * salt)).view(np.int64)), int(mix(s, 5).sum(dtype=_U).view(np.int64))


def band(n: int) -> int:
    return max(n, 1).bit_length() - 1


def keys_of(found: list[np.ndarray], common: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """The keys of non-empty sets, and which set each is of: 64-bit words for band, part and the XOR of the part's shingles; common: sorted hashes."""
    n, s = np.array([len(x) for x in found]), np.concatenate(found)
    own, level = np.repeat(np.arange(len(n)), n), np.frexp(n)[1].astype(np.int64) - 1
    rare = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s if len(common) else np.ones(len(s), bool)
    out = []
    for lower in (0, 1):
        sets_ = np.flatnonzero((level > 0) & (n * percent < 100 << level)) if lower else np.arange(len(n))
        if not len(sets_):
            continue
        place = np.full(len(n), -1)
        place[sets_] = np.arange(len(sets_))
        mine = np.flatnonzero(place[own] >= 0)
        x, o, at = s[mine], place[own[mine]], level[sets_] - lower
        # a pair that links differs in at most this many shingles: the smaller set, in band `at`, holds all the rest
        allowed = np.minimum(n[sets_], (2 << at) - 1) * (100 - percent) // percent
        m = -(-124 * (2 << at) * (100 - percent) // (100 * percent)) + 2
        first = np.cumsum(m) - m
        part = (mix(x + (100 + at[o]).astype(_U) * _U(0x9E3779B97F4A7C15)) % m[o].astype(_U)).astype(np.int64) + first[o]
        count, telling = np.bincount(part, minlength=m.sum()), np.bincount(part[rare[mine]], minlength=m.sum())
        xors, full = np.zeros(len(count), _U), np.flatnonzero(count)
        xors[full] = np.bitwise_xor.reduceat(mix(x, 7)[np.argsort(part)], np.cumsum(count[full]) - count[full])
        kind = np.where(count >= 2, np.where(telling > 0, 0, 1), np.where(count == 1, np.where(telling > 0, 2, 3), 4))
        by = np.repeat(np.arange(len(m)), m)
        beyond = m[:, None] - np.cumsum(np.bincount(by * 5 + kind, minlength=5 * len(m)).reshape(-1, 5), axis=1)
        sent = np.flatnonzero(kind <= np.argmax(beyond < (m - allowed)[:, None], axis=1)[by])
        to, of = by[sent], at[by[sent]].astype(_U)
        out.append((mix(xors[sent] ^ mix(of, 13), 8) ^ mix((sent - first[to]).astype(_U) + (of << _U(40)), 9), sets_[to]))
    return np.concatenate([k for k, _ in out]), np.concatenate([i for _, i in out])


def keys(s: np.ndarray, common: np.ndarray, percent: int = 80) -> np.ndarray:
    return keys_of([s], common, percent)[0]


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set, two to four for each shingle; they fold to lower bands."""
    bits = 1 << max(6, band(len(s)) + 2)
    toggled = np.bincount((mix(s, 10) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(toggled.astype(np.uint8), bitorder="little").tobytes()


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=schema.split())


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) of documents: th, a hash of the text, tells rows of one doc_id apart."""
    return pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("th"), "text")


def classes(docs: DataFrame, width: int, salt: int) -> DataFrame:
    """(doc_id, th, n, d1, d2): each row's set size and digest."""

    def run(batches):
        for b in batches:
            rows = [(len(s), *digest(s, salt)) for s in sets(b.column(2).to_pylist(), width)]
            n, d1, d2 = zip(*rows) if rows else ((), (), ())
            yield _batch("doc_id th n d1 d2", b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()))

    return docs.mapInArrow(lean(run), "doc_id long, th long, n long, d1 long, d2 long")


def common_shingles(docs: DataFrame, rows: int, width: int) -> np.ndarray:
    """Sorted hashes of shingles in COMMON_IN different sets or more of a sample; at most the sample's shingles / COMMON_IN."""

    def run(batches):
        for b in batches:
            for s in sets(b.column(1).to_pylist(), width):
                if len(s):
                    yield _batch("h d1", pa.array(s.view(np.int64)), pa.array(np.full(len(s), digest(s)[0], np.int64)))

    sample = docs.filter(F.pmod(F.xxhash64(F.lit("common"), "doc_id", "th"), F.lit(1 + rows // COMMON_DOCS)) == 0)
    counts = sample.select("doc_id", "text").mapInArrow(lean(run), "h long, d1 long").distinct().groupBy("h").count()
    return np.sort(np.array([r[0] for r in counts.filter(F.col("count") >= COMMON_IN).select("h").collect()], np.int64).view(_U))


def key_rows(docs: DataFrame, common: np.ndarray, width: int, percent: int, salt: int) -> DataFrame:
    """(key, d1) of each class, mostly sent once by each task that holds it."""

    def run(batches):
        seen: set[int] = set()

        def rows(held, names):
            key, of = keys_of(held, common, percent)
            return _batch("key d1", pa.array(key.view(np.int64)), pa.array(np.array(names, np.int64)[of]))

        for b in batches:
            held, names, size = [], [], 0
            for s in sets(b.column(0).to_pylist(), width):
                if len(s) and (d1 := digest(s, salt)[0]) not in seen:
                    if len(seen) < SENT:
                        seen.add(d1)
                    held.append(s)
                    names.append(d1)
                    size += len(s)
                    if size > TOGETHER:
                        yield rows(held, names)
                        held, names, size = [], [], 0
            if held:
                yield rows(held, names)

    return docs.select("text").mapInArrow(lean(run), "key long, d1 long")


def grouped(rows: DataFrame, parts: int) -> DataFrame:
    """(key, d1) of the keys that several classes send; a very common key may repeat some of its classes."""
    ordered = rows.repartition(parts, "key").sortWithinPartitions("key")  # by one word, so Spark sorts by radix

    def several(k, d, open_):
        """The distinct rows of runs with several classes, and whether the last run is one; open_: the first run was one before."""
        near = np.zeros(len(k), bool)
        near[1:] = k[1:] == k[:-1]
        near[:-1] |= near[1:]
        if open_:
            near |= k == k[0]
        at = np.flatnonzero(near)
        at = at[np.lexsort((d[at], k[at]))]
        k, d = k[at], d[at]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        k, d = k[fresh], d[fresh]
        hit = np.zeros(len(k), bool)
        hit[1:] = k[1:] == k[:-1]
        hit[:-1] |= hit[1:]
        if open_ and len(k):
            hit |= k == open_[0]
        return k[hit], d[hit]

    def run(batches):
        k, d, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # rows of the last key so far; it, if some have left
        for b in batches:
            k, d = np.concatenate([k, b.column(0).to_numpy()]), np.concatenate([d, b.column(1).to_numpy()])
            if not len(k):
                continue
            tail = int(np.searchsorted(k, k[-1]))
            if tail:
                yield _batch("key d1", *(pa.array(x) for x in several(k[:tail], d[:tail], open_)))
                k, d, open_ = k[tail:], d[tail:], None
            if len(k) > HELD and len(d := np.unique(d)) > HELD // 2:
                yield _batch("key d1", pa.array(np.full(len(d), k[0])), pa.array(d))
                open_, d = (k[0],), d[:1]
            k = k[: len(d)]
        if len(k):
            yield _batch("key d1", *(pa.array(x) for x in several(k, d, open_)))

    return ordered.mapInArrow(lean(run), "key long, d1 long")


def _fold(sk: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(sk, np.uint8).reshape(-1, size), axis=0)


def proposed(members: DataFrame, percent: int, wide: int) -> DataFrame:
    """(key, a, b): in each group, pairs of classes of different components c within the sketches' bound.

    wide 0: each member's nearest; 1: the nearest in each other component; 2: all.
    members: (key, d1, n, c, sk, no), no: classes that d1 was already found not to link with.
    """
    ordered = members.repartition("key").sortWithinPartitions("key", "c", "d1")

    def meet(group):
        root = np.array([g[3] for g in group])
        if (root == root[0]).all():
            return
        key, d, n, no = group[0][0], [g[1] for g in group], np.array([g[2] for g in group]), [set(g[5] or ()) for g in group]
        size = min(len(g[4]) for g in group)
        words = np.stack([_fold(g[4], size) for g in group])
        for i in range(len(group)):
            other = np.flatnonzero((root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            if not len(other):
                continue
            apart = np.bitwise_count(words[other] ^ words[i]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(apart * (100 + percent) <= (n[other] + n[i]) * (100 - percent))
            met = set()
            for j in other[near[np.argsort(apart[near], kind="stable")]].tolist():
                if d[j] in no[i] or d[i] in no[j] or wide == 1 and root[j] in met:
                    continue
                yield key, min(d[i], d[j]), max(d[i], d[j])
                if wide == 0:
                    break
                met.add(root[j])

    def run(batches):
        held, out = [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    out += meet(held)
                    held = []
                held.append(row)
            if len(out) > 20_000:
                yield _batch("key a b", *(pa.array(c, pa.int64()) for c in zip(*out)))
                out = []
        if held:
            out += meet(held)
        if out:
            yield _batch("key a b", *(pa.array(c, pa.int64()) for c in zip(*out)))

    return ordered.select("key", "d1", "n", "c", "sk", "no").mapInArrow(lean(run), "key long, a long, b long")


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes (a, b) that link; held: (d1, s) with each class's sorted shingle hashes."""
    one = held.select(F.col("d1").alias("a"), F.col("s").alias("sa"))
    two = held.select(F.col("d1").alias("b"), F.col("s").alias("sb"))

    def near(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            rows = b.filter(pa.array(good, pa.bool_()))
            yield _batch("a b", rows.column(0), rows.column(1))

    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(lean(near), "a long, b long")


def linked_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of hashed() documents: (doc_id, th, n, d1) of all rows, staged; (d1, doc_id, th, c) of each class of a non-empty set: its least row and its component."""
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99: a partner is then in a set's band or the next")
    spark = docs.sparkSession
    small_batches(spark)
    for salt in itertools.count():
        told = stage(classes(docs, width, salt), "sets")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r")
        reps = stage(told.filter("n > 0").groupBy("d1").agg(least, F.min("n").alias("n"), (F.min("d2") != F.max("d2")).alias("two")), "classes")
        if reps.filter("two").isEmpty():
            break
        unstage(told, reps)
    reps = reps.select("d1", "n", "r.doc_id", "r.th")
    common = common_shingles(docs, told.count(), width)
    groups = stage(grouped(key_rows(docs, common, width, percent, salt), parts_for(spark, reps.agg(F.sum("n")).first()[0] or 0, PART)), "groups")
    named = reps.join(groups.select("d1").distinct(), "d1").select(F.col("doc_id").alias("rep_id"), F.col("th").alias("rep_th"), F.col("d1").alias("rep"))

    def with_sets(batches):
        for b in batches:
            out = [(d1, len(s), s.tobytes(), sketch(s)) for d1, s in zip(b.column(1).to_pylist(), sets(b.column(0).to_pylist(), width))]
            if out:
                yield _batch("d1 n s sk", *(pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))))

    own = docs.join(named, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))).select("text", "rep")
    held = stage(own.mapInArrow(lean(with_sets), "d1 long, n long, s binary, sk binary"), "held")
    if not held.groupBy("d1").count().filter("count > 1").isEmpty():  # rows that agree in id and text
        once = stage(held.dropDuplicates(["d1"]), "held")
        unstage(held)
        held = once
    at, tested, links, linked = held.select("d1", "n", "sk", F.col("d1").alias("c")), None, None, None
    for turn in itertools.count():
        rows = groups.join(at.select("d1", "n", "c"), "d1")
        count = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.min("n").alias("small"), F.max("n").alias("large"))
        apart = count.filter(f"lo <> hi and (m > 2 or 100 * small >= {percent} * large)").select("key")
        rows = rows.join(apart, "key")
        if turn < EARLY:  # one group for each class
            rows = rows.groupBy("d1").agg(F.min_by(F.struct("key", "n", "c"), F.xxhash64(F.lit(turn), "key")).alias("r")).select("d1", "r.*")
        rows = rows.select("key", "d1", "n", "c").join(at.select("d1", "sk"), "d1")
        if tested is None:
            rows = rows.select("*", F.lit(None).cast("array<bigint>").alias("no"))
        else:
            failed = tested.join(links, ["a", "b"], "left_anti").groupBy("a").agg(F.collect_list("b").alias("no"))
            rows = rows.join(failed.select(F.col("a").alias("d1"), "no"), "d1", "left")
        found = stage(proposed(rows, percent, min(2, max(0, turn - EARLY))), "pairs")
        if found.isEmpty():
            if turn >= EARLY:
                break
            continue
        pairs = found.select("a", "b").distinct()
        good = stage(verified(pairs, held, percent), "links")
        tested, links = (pairs, good) if tested is None else (tested.union(pairs), links.union(good))
        if linked is not None:
            unstage(linked)
        linked = stage(components(links), "components")
        at = held.join(linked, held["d1"] == linked["node"], "left").select("d1", "n", "sk", F.coalesce("component", "d1").alias("c"))
        if turn >= EARLY:
            groups = stage(groups.join(found.select("key").distinct(), "key", "left_semi"), "groups")
        release(spark)
    unstage(held)
    if linked is None:
        return told.select("doc_id", "th", "n", "d1"), reps.select("d1", "doc_id", "th", F.col("d1").alias("c"))
    named = reps.join(linked, reps["d1"] == linked["node"], "left").select("d1", "doc_id", "th", F.coalesce("component", "d1").alias("c"))
    return told.select("doc_id", "th", "n", "d1"), named


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for docs (doc_id, text, ...)."""
    told, named = linked_classes(hashed(docs), width, percent)
    least = named.groupBy("c").agg(F.min("doc_id").alias("least"))
    labels = named.join(least, "c").select("d1", "least")
    rows = told.join(labels, "d1", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def survivors(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns kept: that with the smallest doc_id (null last; of equals, by a hash of the text).

    Rows without words link with nothing, so all of them stay. Rows that agree in doc_id and text are one document.
    """
    told, named = linked_classes(hashed(docs), width, percent)
    least = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r"))
    stays = least.select(F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th"), F.lit(True).alias("stays"))
    each = told.filter("n > 0").groupBy("doc_id", "th").agg(F.count("*").alias("copies"))
    judged = each.join(stays, each["doc_id"].eqNullSafe(stays["doc_id"]) & (each["th"] == stays["th"]), "left").select(each["doc_id"], each["th"], "copies", "stays")
    judged = stage(judged.filter("stays is null or copies > 1").select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), "stays"), "judged")
    mine = [F.col(c) for c in docs.columns]
    keyed = docs.select(F.struct(*mine).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_th"))
    same = F.col("own_id").eqNullSafe(F.col("k_id")) & (F.col("own_th") == F.col("k_th"))
    out = keyed.join(judged, same, "left_anti").select("row.*")
    if judged.filter("stays").isEmpty():
        return out
    again = keyed.join(judged.filter("stays"), same, "left_semi").dropDuplicates(["own_id", "own_th"])
    return out.union(again.select("row.*"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
