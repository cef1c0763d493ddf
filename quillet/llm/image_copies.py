"""Local image descriptors: cropped or edited copies among images.

All corners (Harris responses, local maxima above a threshold) are taken at several scales; each gets an orientation from the intensity
centroid around it and 240 binary tests of point pairs turned by that orientation. Descriptors meet through
Hamming tables: ten tables, each keyed by 24 of the bits and by every key one bit away, so two descriptors are
compared if they differ in at most one bit of some table's: always up to 19 differing bits, and less often up to
the 48 that a match may have. Matches vote by geometric consensus: pairs of keypoints agree on turn, scale and shift in coarse
cells; an image is a copy if enough matches agree.

Queries run in blocks of a bounded number of images against all images: a block goes to every task, which holds the
tables of some thousand images at a time and asks them query by query, so nothing is shuffled and no pair list
exists. Of the pairs that meet, places come first: only those in cells that many pairs share are compared.
Equal images are one class (named by its smallest id), and only classes are described, asked and matched.

Images are binary grey PGM files (P5, 8 bits). Defined cases: null, empty or malformed images have no
descriptors and match nothing; images without corners likewise; a null id is left out of classes and queries.
Rows that repeat an id belong to the class of each image. Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pick, stage, unstage

#: Images that the query gives to a task.
PER_PART = 2500
#: Scales, least response of a corner, radius of a described patch, query images in a block.
SCALES, RESPONSE, RADIUS, BLOCK = (1.0, 0.75, 0.5), 1.0, 8, 1000
#: Bytes of descriptors in a block of queries.
BLOCK_BYTES = 16 << 20
#: Least images of a task; descriptors and pairs of keypoints that it holds at a time.
LEAST_PART, HELD, PAIRS = 100, 1 << 18, 1 << 20
TABLES, TABLE_BITS, MOST_APART, LEAST_AGREE = 10, 24, 48, 6
#: What is added to a key: nothing, or one bit.
FLIPS = np.concatenate([[0], 1 << np.arange(TABLE_BITS)]).astype(np.uint32)
#: Multipliers of a hash of cells, for their five columns.
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32).astype(np.int32)
_rng = np.random.default_rng(20262)
#: Point pairs of the tests, near the middle more often.
TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (TABLES * TABLE_BITS, 4)), -RADIUS + 1, RADIUS - 1)
_disc = np.argwhere(np.hypot(*np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]) <= RADIUS) - RADIUS


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The grey levels of a PGM file as floats, or None."""
    parts = (data or b"").split(None, 4)
    try:
        if len(parts) < 5 and len((data or b"").split(None, 3)) < 4 or parts[0] != b"P5" or int(parts[3]) != 255:
            return None
        w, h = int(parts[1]), int(parts[2])
    except (ValueError, IndexError):
        return None
    body = data[len(data) - w * h :]
    return np.frombuffer(body, np.uint8).reshape(h, w).astype(np.float32) if w * h and len(body) == w * h else None


def write_pgm(grey: np.ndarray) -> bytes:
    g = np.clip(np.rint(grey), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (g.shape[1], g.shape[0]) + g.tobytes()


def resize(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * g.shape[0] / h - 0.5, 0, g.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * g.shape[1] / w - 0.5, 0, g.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(g.shape[0] - 2, 0)), np.minimum(x.astype(int), max(g.shape[1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, g.shape[0] - 1), np.minimum(x0 + 1, g.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (g[y0][:, x0] * (1 - fx) + g[y0][:, x1] * fx) * (1 - fy) + (g[y1][:, x0] * (1 - fx) + g[y1][:, x1] * fx) * fy


def _blur(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    p = p[:-2] + 2 * p[1:-1] + p[2:]
    return (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 16


def corners(g: np.ndarray) -> np.ndarray:
    """(y, x) of the local maxima of the Harris response above RESPONSE, at least RADIUS + 1 from the edge."""
    edge = RADIUS + 1
    if min(g.shape) <= 2 * edge:
        return np.zeros((0, 2), int)
    gy, gx = np.gradient(g)
    xx, yy, xy = _blur(_blur(gx * gx)), _blur(_blur(gy * gy)), _blur(_blur(gx * gy))
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = r[edge:-edge, edge:-edge]
    top = np.ones(inner.shape, bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                near = r[edge + dy : r.shape[0] - edge + dy, edge + dx : r.shape[1] - edge + dx]
                top &= (inner > near) if (dy, dx) > (0, 0) else (inner >= near)
    return np.argwhere(top & (inner > RESPONSE)) + edge


def features(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints (x, y, scale, angle) in the image's own pixels, and their 240-bit descriptors as 30 bytes."""
    g0, points, bits = read_pgm(data), [], []
    if g0 is None:
        return np.zeros((0, 4), np.float32), np.zeros((0, 30), np.uint8)
    for s in SCALES:
        h, w = max(1, round(g0.shape[0] * s)), max(1, round(g0.shape[1] * s))
        g = _blur(resize(g0, h, w) if s != 1 else g0)
        at = corners(g)
        if not len(at):
            continue
        patch = g[at[:, :1] + _disc[:, 0], at[:, 1:] + _disc[:, 1]]
        patch = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2((patch * _disc[:, 0]).sum(axis=1), (patch * _disc[:, 1]).sum(axis=1))
        c, n = np.cos(angle)[:, None], np.sin(angle)[:, None]
        value = []
        for k in (0, 2):
            dx, dy = c * TESTS[:, k] - n * TESTS[:, k + 1], n * TESTS[:, k] + c * TESTS[:, k + 1]
            y, x = (np.clip(np.rint(a + d).astype(int), 0, m - 1) for a, d, m in ((at[:, :1], dy, h), (at[:, 1:], dx, w)))
            value.append(g[y, x])
        bits.append(np.packbits(value[0] < value[1], axis=1))
        points.append(np.column_stack([at[:, 1] / s, at[:, 0] / s, np.full(len(at), s), angle]))
    if not points:
        return np.zeros((0, 4), np.float32), np.zeros((0, 30), np.uint8)
    return np.concatenate(points).astype(np.float32), np.concatenate(bits)


def _keys(desc: np.ndarray) -> np.ndarray:
    """For each table its 24-bit key, below the table's number."""
    d = desc.reshape(len(desc), TABLES, 3).astype(np.uint32)
    return np.arange(TABLES, dtype=np.uint32) << TABLE_BITS | d[:, :, 0] << 16 | d[:, :, 1] << 8 | d[:, :, 2]


class Tables:
    """The Hamming tables of a block of query images (id, points, descriptors)."""

    def __init__(self, queries: list[tuple[int, np.ndarray, np.ndarray]]):
        self.owner = np.concatenate([np.full(len(p), i, np.int64) for i, p, _ in queries] or [np.zeros(0, np.int64)])
        self.points = np.concatenate([p for _, p, _ in queries] or [np.zeros((0, 4), np.float32)])
        self.desc = np.concatenate([d for _, _, d in queries] or [np.zeros((0, 30), np.uint8)])
        self.words = _words(self.desc)
        near = (_keys(self.desc)[:, :, None] ^ FLIPS).ravel()
        order = np.argsort(near, kind="stable")
        # all tables as one list: the distinct keys, and whose they are from one start to the next
        self.keys, self.starts = np.unique(near[order], return_index=True)
        self.starts = np.append(self.starts, len(near))
        self.whose = (order // (TABLES * len(FLIPS))).astype(np.int32)

    def matches(self, points: np.ndarray, desc: np.ndarray) -> list[tuple[int, int]]:
        """(query, agreeing matches) of one image, for queries with enough of them."""
        if not len(desc) or not len(self.desc):
            return []
        key = _keys(desc).ravel()
        order = np.argsort(key)
        key = key[order]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        asks = np.flatnonzero(self.keys[at] == key)
        lo = self.starts[at[asks]]
        n = self.starts[at[asks] + 1] - lo
        theirs = self.whose.take(np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)).astype(np.intp)
        asks = order[asks] // TABLES
        mine = np.repeat(asks, n)
        apart = np.zeros(len(mine), np.uint8)
        for own, held in zip(_words(desc), self.words):
            apart += np.bitwise_count(np.repeat(own[asks], n) ^ held.take(theirs))
        # a pair that several tables give counts once below, with its keypoint
        near = np.flatnonzero(apart <= MOST_APART)
        mine, theirs = mine[near], theirs[near]
        return consensus(self.owner[theirs], self.points.take(theirs, axis=0), points.take(mine, axis=0), mine)


class Index:
    """The Hamming tables of many images (id, points, descriptors), to be asked by one query at a time."""

    def __init__(self, images: list[tuple[int, np.ndarray, np.ndarray]]):
        self.ids = [i for i, _, _ in images]
        self.points = np.concatenate([p for _, p, _ in images] or [np.zeros((0, 4), np.float32)])
        self.desc = np.concatenate([d for _, _, d in images] or [np.zeros((0, 30), np.uint8)])
        self.image = np.repeat(np.arange(len(images)) << 7, [len(p) for _, p, _ in images])
        self.rows, self.words = _rows(self.points), np.ascontiguousarray(_words(self.desc).T)
        key = _keys(self.desc).ravel()
        order = np.argsort(key)
        self.keys, self.starts = np.unique(key[order], return_index=True)
        self.starts = np.append(self.starts, len(key))
        self.whose = (order // TABLES).astype(np.int32)

    def matches(self, points: np.ndarray, desc: np.ndarray) -> list[tuple[int, int]] | None:
        """(image, agreeing matches) of one query, for images with enough of them; None if fewer images must be asked at a time."""
        if not len(desc) or not len(self.desc):
            return []
        near = np.sort((_keys(desc)[:, :, None] ^ FLIPS).reshape(len(desc), -1)).ravel()
        at = np.minimum(np.searchsorted(self.keys, near), len(self.keys) - 1)
        asks = np.flatnonzero(self.keys[at] == near)
        lo = self.starts[at[asks]]
        n = self.starts[at[asks] + 1] - lo
        if n.sum() > PAIRS and len(self.ids) > 1:
            return None
        theirs = self.whose.take(np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n))
        edges = np.r_[0, np.cumsum(n)][np.searchsorted(asks, np.arange(len(desc) + 1) * (TABLES * len(FLIPS)))]
        # a keypoint's pairs in order, each once, however many tables give it
        fresh = np.ones(len(theirs), bool)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = theirs[a:b]
            own.sort()
            np.not_equal(own[1:], own[:-1], out=fresh[a + 1 : max(b, a + 1)])
        kept = np.flatnonzero(fresh)
        edges = np.searchsorted(kept, edges)
        theirs = theirs.take(kept).astype(np.intp)
        # only pairs in cells that may have enough of them go on: cells are told by the image and a few bits of a hash
        cells = np.empty((4, len(theirs)), np.uint8)
        many = np.diff(edges)
        for q, a, b in zip(points, edges[:-1].tolist(), edges[1:].tolist()):
            if a < b:
                scale, cells[:3, a:b] = _places(q, _columns(self.rows.take(theirs[a:b])))
                cells[3, a:b] = (scale * scale * np.float32(np.sqrt(2))).view(np.int32) >> 23  # the exponent, as in _size
        image = self.image.take(theirs)
        often = np.zeros(len(theirs), bool)
        for half in (0, 1):
            turn, x, y = (cells[:3] + np.uint8(half)) >> 1
            mixed = image + ((turn & 7) * np.uint8(37) + x * np.uint8(11) + y * np.uint8(81) + cells[3] * np.uint8(53) & np.uint8(127))
            often |= (np.bincount(mixed) >= LEAST_AGREE).take(mixed)
        rows = np.flatnonzero(often)
        theirs, mine = theirs[rows], np.repeat(np.arange(len(desc)), many)[rows]
        near = np.bitwise_count(self.words.take(theirs, axis=0) ^ _words(desc).T[mine]).sum(axis=1, dtype=np.uint8) <= MOST_APART
        theirs, mine = theirs[near], mine[near]
        return [(self.ids[i], m) for i, m in consensus(self.image[theirs] >> 7, points[mine], self.points[theirs], theirs)]


def _rows(points: np.ndarray) -> np.ndarray:
    """Keypoints as single values of 16 bytes, which are taken much faster than rows of four."""
    return np.ascontiguousarray(points, np.float32).view(np.complex128).ravel()


def _columns(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.view(np.float32).reshape(-1, 4).T)


def _words(desc: np.ndarray) -> np.ndarray:
    """Descriptors as columns of 64-bit words, the last filled up with zeros."""
    return np.ascontiguousarray(np.pad(desc, ((0, 0), (0, 2))).view(np.uint64).T)


def _places(q, p) -> tuple[np.ndarray, np.ndarray]:
    """Scale, and turn and shift (x, y) as numbers of half cells, of pairs of keypoints, both as columns (x, y, scale, angle)."""
    (qx, qy, qs, qa), (px, py, ps, pa_) = q, p
    place = np.empty((3, len(px)), np.float32)
    turn = np.subtract(pa_, qa, out=place[0])
    turn += (turn < 0) * np.float32(2 * np.pi)
    scale = qs / ps
    c, s = np.cos(turn), np.sin(turn)
    c *= scale
    s *= scale
    np.subtract(px, c * qx - s * qy, out=place[1])
    np.subtract(py, s * qx + c * qy, out=place[2])
    place[1:] /= 4
    turn /= np.pi / 4
    place[0] *= 2
    return scale, np.floor(place, out=place).astype(np.int32)


def _size(scale: np.ndarray) -> np.ndarray:
    """Scales in half octaves, rounded."""
    return np.frexp(scale * scale * np.float32(np.sqrt(2)))[1]


def consensus(owner: np.ndarray, q: np.ndarray, p: np.ndarray, mine: np.ndarray) -> list[tuple[int, int]]:
    """For each owner the most matches that agree on turn (eighths of a circle), scale and shift (8 pixels), counted by distinct keypoints."""
    if len(owner) < LEAST_AGREE:
        return []
    scale, (turn, x, y) = _places(np.ascontiguousarray(q.T), np.ascontiguousarray(p.T))
    size = _size(scale)
    who = owner.astype(np.int32)
    hashes = 1 << min(24, max(14, len(owner).bit_length()))
    best: dict[int, int] = {}
    for half in (0, 1):  # cells twice, moved by half a cell
        cell = [who, (turn + half >> 1) & 7, size, x + half >> 1, y + half >> 1]
        # most cells have few matches: those are left out by counts of a hash, and only the rest are sorted
        mixed = cell[0] * _ODD[0]
        for col, odd in zip(cell[1:], _ODD[1:]):
            mixed += col * odd
        mixed = (mixed >> 8) & (hashes - 1)
        rows = np.flatnonzero(np.bincount(mixed, minlength=hashes).take(mixed) >= LEAST_AGREE)
        if not len(rows):
            continue
        code = _code([owner[rows], *[col[rows] for col in cell[1:]]])
        point = mine[rows]
        span = int(point.max()) + 1
        seen = np.sort(code * span + point)
        seen = seen[np.r_[True, seen[1:] != seen[:-1]]] // span
        edge = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1], True])
        count = np.diff(edge)
        for k in np.flatnonzero(count >= LEAST_AGREE):
            i = int(owner[rows[np.argmax(code == seen[edge[k]])]])
            best[i] = max(best.get(i, 0), int(count[k]))
    return sorted(best.items())


def _code(columns: list[np.ndarray]) -> np.ndarray:
    """One whole number below 2**31 or the rows' number for each row of some columns: equal for equal rows only."""
    code = np.zeros(len(columns[0]), np.int64)
    width = 1
    for c in columns:
        low = int(c.min())
        span = int(c.max()) - low + 1
        if width * span >= 1 << 31:
            c, low = np.unique(c, return_inverse=True)[1], 0
            code = np.unique(code, return_inverse=True)[1]
            width, span = int(code.max()) + 1, int(c.max()) + 1
        code = code * span + (c - low)
        width *= span
    return np.unique(code, return_inverse=True)[1] if width >= 1 << 31 else code


def described(images: DataFrame) -> DataFrame:
    """(id, points, desc) of images (id, image)."""

    def run(batches):
        for b in batches:
            found = [features(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes() for p, _ in found], pa.binary()), pa.array([d.tobytes() for _, d in found], pa.binary())], names=["id", "points", "desc"])

    return pick(images, id="id", image="image").mapInArrow(run, "id long, points binary, desc binary")


def _arrays(points: bytes, desc: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(points, np.float32).reshape(-1, 4), np.frombuffer(desc, np.uint8).reshape(-1, 30)


def _portions(batches):
    """Lists of described images with up to HELD descriptors, or one image; images with too few to match anything are left out."""
    images, held = [], 0
    for b in batches:
        for i, p, d in zip(*(c.to_pylist() for c in b.columns)):
            n = len(d) // 30
            if n < LEAST_AGREE:
                continue
            if images and held + n > HELD:
                yield images
                images, held = [], 0
            images.append((i, *_arrays(p, d)))
            held += n
    if images:
        yield images


def _asked(images: list, queries: list):
    """(query, image, agree) of all queries; those that meet too many keypoints at once ask half of the images at a time."""
    index, heavy = Index(images), []
    for q, p, d in queries:
        found = index.matches(p, d)
        if found is None:
            heavy.append((q, p, d))
        else:
            yield from ((q, i, n) for i, n in found)
    del index
    if heavy:
        for half in (images[: len(images) // 2], images[len(images) // 2 :]):
            yield from _asked(half, heavy)


def search(queries: DataFrame, corpus: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(query, match, agree) of queries and corpus, both described(): all images that share enough geometry with a query."""
    dealt = stage(queries.select("id", "points", "desc"), "queries")
    n, size = dealt.agg(F.count("*"), F.coalesce(F.sum(F.length("desc")), F.lit(0))).first()
    blocks = 1 + max(n // block, size // BLOCK_BYTES)
    # a hash deals queries over blocks of about `block` images: what a task holds doesn't grow with the input
    own = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks))
    out = None
    for k in range(blocks):
        held = [(r["id"], *_arrays(bytes(r["points"]), bytes(r["desc"]))) for r in dealt.filter(own == k).collect()]

        def run(batches, held=held):
            for images in _portions(batches):
                rows = list(_asked(images, held))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query", "match", "agree"])

        found = stage(corpus.select("id", "points", "desc").mapInArrow(run, "query long, match long, agree long"), f"block{k}")
        out = found if out is None else out.union(found)
    unstage(dealt)
    return out


def picture(vector: list[float] | None) -> bytes | None:
    """A picture of a vector: its values as a board of 8 x 8 fields of 8 pixels, of more fields a side for longer vectors."""
    if not vector or any(v is None for v in vector):
        return None
    side = max(8, int(np.ceil(np.sqrt(len(vector)))))
    v = np.resize(np.array(vector, np.float32), side * side)
    spread = float(v.std()) or 1.0
    return write_pgm(np.kron(128 + 55 * ((v - v.mean()) / spread).reshape(side, side), np.ones((8, 8))))


def edited(data: bytes | None, seed: int) -> bytes | None:
    """A cropped copy, with other brightness and contrast and some noise."""
    g = read_pgm(data)
    if g is None:
        return None
    r = int(mix(np.array([seed], np.uint64))[0])
    top, left = r % 9, r // 9 % 9
    g = g[top : top + 54, left : left + 54] * (0.8 + r // 81 % 4 / 10) + (r // 324 % 21 - 10)
    return write_pgm(g + np.random.default_rng(r % 2**32).normal(0, 2, g.shape))


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all embeddings; edited copies of those with an id divisible by 50 ask for their originals.

    One row an image with its class; asked images also have the list of all classes found, whose members are the
    rows with that class_id.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.select(rows["vec_id"].alias("id"), rows["embedding"].alias("embedding")).filter("id is not null")

    def draw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([picture(v) for v in b.column(1).to_pylist()], pa.binary())], names=["id", "image"])

    keyed = rows.withColumn("h", F.sha2(F.to_json(F.struct("embedding")), 256))
    classes = keyed.groupBy("h").agg(F.min("id").alias("class"))
    member = stage(keyed.select("id", "h").join(classes, "h").select("id", "class"), "members")
    ids = member.select(F.col("class").alias("id")).distinct()
    n = rows.count()
    # tasks of equal numbers of images, as many as there are cores or more
    parts = max(-(-n // PER_PART), min(spark.sparkContext.defaultParallelism, 1 + n // LEAST_PART))
    picked = rows.repartition(parts, "id").join(ids, "id", "left_semi").select("id", "embedding")
    images = lambda own: own.mapInArrow(draw, "id long, image binary")
    asked = member.filter("id % 50 = 0")

    def edit(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([edited(x.as_py(), i) for i, x in zip(b.column(0).to_pylist(), b.column(1))], pa.binary())], names=["id", "image"])

    queries = images(picked.join(asked.select(F.col("class").alias("id")).distinct(), "id", "left_semi")).mapInArrow(edit, "id long, image binary")
    corpus = stage(described(images(picked)), "features")
    found = search(described(queries), corpus)
    best = found.groupBy("query").agg(F.count("*").alias("matches"), F.array_sort(F.collect_list(F.struct(F.col("match").alias("class_id"), "agree"))).alias("copies"), F.max_by("match", F.struct("agree", -F.col("match"))).alias("best_class"), F.max("agree").alias("agree"), F.bool_or(F.col("query") == F.col("match")).alias("found"))
    out = asked.join(best, F.col("class") == F.col("query"), "left")
    none = F.from_json(F.lit("[]"), best.schema["copies"].dataType)
    out = out.select(F.col("id").alias("vec_id"), F.col("class").alias("class_id"), F.lit(True).alias("asked"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("copies", none).alias("copies"), "best_class", F.coalesce("agree", F.lit(0)).alias("agree"), F.coalesce("found", F.lit(False)).alias("found"))
    # the rest only say their class; they meet no join, whose key would be the class
    return out.unionByName(member.filter("id % 50 <> 0").select(F.col("id").alias("vec_id"), F.col("class").alias("class_id"), F.lit(False).alias("asked")), allowMissingColumns=True)
