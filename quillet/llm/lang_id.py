"""Language ID by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (one to three letters, word edges
as blanks) in order of count. A document is compared to each profile by the out-of-place distance: the
summed difference of ranks, with a fixed penalty for n-grams that the profile lacks. The least distance wins.

Defined cases: null text, or text without a letter: `und`, score 0. Equal distances: the first language by
code point. No training rows: `und` everywhere. Empty tables give empty results; extra columns are ignored;
repeated rows are judged one by one. Whole texts count, of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, lean, mix, pick, small_batches

#: Ranks in a profile, and documents per language that a profile is learned from (a bounded sample by hash).
PROFILE, TRAIN_DOCS = 300, 2000
#: Characters that are counted together.
CHUNK = 1 << 18
UND = "und"
_fold: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code unit to its lower-case letter, or 0 for what is no letter."""
    if not _fold:
        table = np.zeros(65536, np.uint32)
        for i in range(65536):
            if (c := chr(i)).isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _fold.append(table)
    return _fold[0]


def _folded(text: str) -> np.ndarray:
    """A text's letters in lower case as code points, words set apart by single zeros."""
    out, zero = [np.zeros(1, np.uint64)], True
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        if (high := points > 65535).any():
            folded = _letters()[np.where(high, 0, points)].astype(np.uint64)
            for p in np.unique(points[high]).tolist():
                folded[points == p] = ord(chr(p).lower()) if chr(p).isalpha() else 0
        else:
            folded = _letters()[points].astype(np.uint64)
        keep = folded != 0
        keep[1:] |= folded[:-1] != 0
        keep[0] |= not zero
        out.append(folded[keep])
        zero = folded[-1] == 0
    return np.concatenate([*out, np.zeros(0 if zero else 1, np.uint64)])


def _counted(c: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of folded letters that end behind the first `old` ones, with their counts."""
    one = c[old:]
    two = ((c[:-1] << np.uint64(21)) | c[1:])[max(old - 1, 0) :]
    three = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    three = three[c[1:-1] != 0]
    mark = np.uint64(1) << np.uint64(63)
    return np.unique(np.concatenate([one[one != 0], two | mark, mix(three, 3) >> np.uint64(1)]), return_counts=True)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The hashes of a text's n-grams in ascending order, and their counts; None without a letter. Long texts are counted in pieces."""
    if not text:
        return None
    c = _folded(text)
    if not c.any():
        return None
    found = [_counted(c[max(0, at - 2) : at + CHUNK], 2 if at else 0) for at in range(0, len(c), CHUNK)]
    if len(found) == 1:
        return found[0]
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, equal counts by hash."""
    if len(grams) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        few = counts >= least
        grams, counts = grams[few], counts[few]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, *, size: int = PROFILE, per_lang: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Profiles by language from rows (doc_id, text, lang), at most about per_lang documents of each.

    What comes to the driver is size n-grams for each language, whatever the input's size.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang").filter("lang is not null and text is not null")
    total = rows.groupBy("lang").count().select(F.col("lang").alias("l"), F.least(F.lit(1.0), per_lang / F.col("count")).alias("share"))
    chosen = rows.join(F.broadcast(total), F.col("lang") == F.col("l")).filter(F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def count(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                found = [g for x, t in zip(langs, texts) if x == lang and (g := ngrams(t))]
                if found:
                    keys, at = np.unique(np.concatenate([g[0] for g in found]), return_inverse=True)
                    sums = np.bincount(at, np.concatenate([g[1] for g in found])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(sums)], names=["lang", "gram", "n"])

    grams = chosen.select("lang", "text").mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    out: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, place in grams.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).select("lang", "gram", "place").collect():
        out.setdefault(lang, []).append((place, gram))
    return {lang: np.array([g for _, g in sorted(v)], np.int64).view(np.uint64) for lang, v in sorted(out.items())}


def distances(grams: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[int]:
    """Out-of-place distance to each profile, given as its sorted n-grams and their ranks."""
    ranks, out = np.arange(len(grams)), []
    for keys, places in profiles:
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out.append(int(np.where(keys[at] == grams, np.abs(places[at] - ranks), size).sum()))
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], *, size: int = PROFILE) -> DataFrame:
    """docs (any columns, among them text) with lang_pred and score appended, from text alone; older columns of these names go."""
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)
    names = sorted(profiles)
    tables = [(profiles[n][o], o) for n in names for o in [np.argsort(profiles[n])]]

    def judge(text):
        if (g := ngrams(text)) is None or not names:
            return UND, 0.0
        top = ranked(*g, size)
        d = distances(top, tables, size)
        best = min(range(len(d)), key=lambda i: (d[i], i))
        return names[best], 1.0 - d[best] / (size * len(top))

    def run(batches):
        for b in batches:
            said = [judge(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double"])
    return docs.mapInArrow(lean(run), fields)


def training_rows(docs: DataFrame) -> DataFrame:
    """Two thirds of the documents, by checksum of the id; the third with remainder 1 is held out."""
    return docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn(training_rows(docs))
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    return identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
