"""Hard negatives, page text and importance resampling against plain versions, on small tables."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillet.llm import hard_negatives, html_text, image_copies, importance, queries
from quillet.sources.staging import new_path

VECTORS = "vec_id long, embedding array<float>, label int, key string, far int"
PAGES = "page_id long, url string, html string, text string, n_chars int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, score string, n int"


def plain_negatives(rows, every=100):
    """Every anchor against every row, in order of score, id (null last) and place."""
    kept = []
    for place, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((math.inf if i is None else i, place, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = Counter()
    for _, place, i, q, label in kept:
        if i is None or i % every:
            continue
        said = sorted((-sum(a * b for a, b in zip(q, v)), o, p, j, other) for o, p, j, v, other in kept if p != place)
        for s, _, _, j, _ in [x for x in said if x[4] == label][:5]:
            fit = [x for x in said if x[4] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out.update((i, j, r, x[3], -s, -x[0]) for r, x in enumerate(fit, 1))
    return out


def some_vectors(n, seed, labels=3, dim=6):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(4, dim))
    v = (centre[r.integers(0, 4, n)] * 0.6 + r.normal(size=(n, dim)) * 0.4).astype(np.float32)
    return [(int(i), v[i].tolist(), int(r.integers(0, labels))) for i in range(n)]


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label, "k", 1) for i, v, label in rows], VECTORS).coalesce(1)
    return Counter(map(tuple, hard_negatives.mined(hard_negatives.usable(df), **how).collect()))


def test_negatives_with_nulls_ties_and_repeats(spark):
    rows = some_vectors(60, 1)
    rows += [(100, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], 1), (100, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], 1), (None, [0.4] * 6, 1), (None, [0.3] * 6, 2), (70, None, 1), (71, [None] + [0.1] * 5, 1), (72, [math.nan] * 6, 1), (73, [math.inf] * 6, 1), (74, [0.1] * 6, None), (200, [0.0] * 6, 0), (75, [], 2), (76, [0.9], 2)]
    rows += [(300 + k, [0.25] * 6, k % 2) for k in range(40)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and {a for a, *_ in got} == {0, 100, 200, 300}


def test_negatives_over_many_blocks_and_rounds(spark):
    rows = some_vectors(400, 2, labels=2)
    got = mined(spark, rows, every=20, rows_in_block=23, anchors_in_block=7, first_round=2)
    assert got == plain_negatives(rows, 20)


def test_negatives_of_one_label_and_of_nothing(spark):
    assert not mined(spark, [(i, v, 1) for i, v, _ in some_vectors(20, 3)])
    assert not mined(spark, [])


def test_huge_components_do_not_hide_others(spark):
    rows = some_vectors(40, 4) + [(41, [3e38] * 6, 0)]
    got, want = mined(spark, rows), plain_negatives(rows[:-1])
    normal = Counter({k: n for k, n in got.items() if k[1] != 41})
    pairs = {k[:2] for k in normal}
    assert len(pairs) >= 4 and normal == Counter({k: n for k, n in want.items() if k[:2] in pairs})


def test_brackets_hold_and_drop_rows(spark):
    rows = hard_negatives.usable(spark.createDataFrame([(*r, "k", 1) for r in some_vectors(300, 5)], VECTORS))
    pivots = hard_negatives.Pivots(rows)
    v = np.array([r[0] for r in rows.select("v").collect()])
    least, most = pivots.brackets((v[:50] ** 2).sum(1), pivots.of_anchors(v[:50]), pivots.of_rows(v))
    exact = v[:50] @ v.T
    assert (least <= exact).all() and (exact <= most).all()
    top = np.sort(exact, axis=1)[:, -10, None]
    assert (most < top).mean() > 0.1


def test_op11_as_its_sql(spark):
    path = new_path(spark, "sf")
    rows = some_vectors(301, 6, labels=10)
    rows[5], rows[6] = (5, None, 1), (6, [None] * 6, 2)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    got = queries.QUERIES["op11_hard_negatives"](spark, path)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path.removeprefix('file://')}/embeddings.parquet/*.parquet')")
    want = con.execute(hard_negatives.SQL).fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


STORY = "".join(f"<p>Part {i} of the story tells how the river ran <b>down</b>, <a href=x>past</a> the mill, day after day." for i in range(6))
TOLD = "\n".join(f"Part {i} of the story tells how the river ran down, past the mill, day after day." for i in range(6))
CASES = {
    None: "", "": "", "plain": "plain", "<p>a<p>b": "a\nb", "<nav>x</nav>": "", "a < b &lt; c &am <3": "a < b < c &am <3",
    f"<html><head><title>t</title><script>var t='</p>'</script></head><body><nav><ul><li><a href=a>Home</a></ul></nav><!-- x --><div class='ad'>buy</div><article><h1>T &amp; t</h1>{STORY}</article><footer>&copy; us</footer>": f"T & t\n{TOLD}",
    f"<body><header><h1>Site</h1></header><div class=cookie-notice>We use cookies, many of them, and say so.</div><div id=content class='with-sidebar'>{STORY}</div><div class=sidebar><p>About the author of it all</div><section id=comments><p>{'Great post. ' * 90}</section>": TOLD,
    f"<body><article><header><h1>Head</h1></header>{STORY}<form><p>Search<input></form><aside>see also</aside></article>": f"Head\n{TOLD}",
    "<body><p>one\n\n two&nbsp;&nbsp;three<br>four<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<ul><li>y</ul><li>z</ul>": "one two three four\na b\nc\nx\ny\nz",
    "<div>" * 700 + "deep" + "</div>" * 700 + "after": "deep",
    "<p>whole<!-- open <p>gone": "whole", "<p>x</p><div hidden>y</div><div style='display: none'>z</div><div role=navigation>w</div>": "x", "<p>x <p": "x",
}


@pytest.mark.parametrize("source", CASES, ids=range(len(CASES)))
def test_main_text(source):
    assert html_text.main_text(source) == CASES[source]


def plain_densities(page):
    """Densities and sums of a page's nodes, each counted from its descendants."""
    n = len(page.tag)
    down = [[j for j in range(n) if j == i or i in up(page, j)] for i in range(n)]
    c = [sum(page.chars[j] for j in d) for d in down]
    lc = [sum(page.chars[j] for j in d if page.tag[j] == "a" or any(page.tag[u] == "a" for u in up(page, j) if u in d)) for d in down]
    body = page.tag.index("body") if "body" in page.tag else 0
    out = []
    for i in range(n):
        t, lt = max(1, len(down[i]) - 1), max(1, sum(page.tag[j] == "a" for j in down[i]))
        base = math.log(c[i] / max(1, c[i] - lc[i]) * lc[i] + lc[body] / max(1, c[body]) * c[i] + math.e)
        out.append(0 if not c[i] else c[i] / t * (math.log(max(1, c[i] / max(1, lc[i]) * t / lt), base) if base > 1 else 1))
    return out, [sum(out[j] for j in range(1, n) if page.parent[j] == i and not page.noise[j]) for i in range(n)]


def up(page, i):
    out = []
    while (i := page.parent[i]) >= 0:
        out.append(i)
    return out


@pytest.mark.parametrize("source", [s for s in CASES if s and len(s) < 3000], ids=lambda s: str(zlib.crc32(s.encode())))
def test_densities(source):
    page = html_text.Page(source)
    got, sums, _ = page.densities()
    want, want_sums = plain_densities(page)
    assert got == pytest.approx(want) and sums == pytest.approx(want_sums)


def test_op12_on_the_pages(spark, sf_dir):
    """The test tables' articles are one element each: a plain reading of it gives the text."""
    got = {r["page_id"]: r for r in queries.QUERIES["op12_html_extraction"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["url"], got[r["page_id"]]["n_chars"]) == (want, r["url"], len(want))


def test_pages_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, "u", "<p>a", "t", 1), (1, "u", "<p>a", "t", 1), (None, None, None, None, None), (2, "v", "x " * 3_000_000, "t", 0)]
    got = html_text.extracted(spark.createDataFrame(rows, PAGES))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r[0], r[1], r[3]) for r in got.collect()) == Counter([(1, "u", 1), (1, "u", 1), (None, None, 0), (2, "v", 5_999_999)])
    assert html_text.extracted(spark.createDataFrame([], PAGES)).count() == 0


def plain_features(text, longest=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resampling(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text)[1])
    for text in target:
        t.update(plain_features(text)[1])
    size_s, size_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, found = plain_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (size_s + 10_000) / ((s[b] + 1) * (size_t + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


def make_docs(n, seed):
    r = random.Random(seed)
    words = "the river Mill RAN down é ñandú past 42 x1 stone of and to in under".split() + ["w" * 70]
    return [(i, " ".join(r.choice(words) + r.choice(["", ",", "-", " !"]) for _ in range(r.choice([0, 3, 19, 20, 21, 60, 300])))) for i in range(n)]


def resampled(spark, docs, target, tmp=None):
    path = new_path(spark, "sf")
    spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", 2) for i, t in docs], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string").write.parquet(f"{path}/benchmark.parquet")
    df = queries.QUERIES["op13_importance_resampling"](spark, path)
    assert dict(df.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    return Counter(map(tuple, df.collect()))


def test_op13_with_nulls_and_repeats(spark):
    docs = make_docs(400, 1)
    docs += [(1000, None), (None, None), (None, docs[6][1]), (None, docs[7][1]), *[(2000, "the river ran past " * 9)] * 60, (2001, "a" * 300), (2002, "Àİ " * 30)]
    target = [t for _, t in make_docs(20, 2)] + [None, ""]
    assert resampled(spark, docs, target) == plain_resampling(docs, target)


def test_op13_of_nothing_and_of_few(spark):
    assert not resampled(spark, [], ["x"])
    few = make_docs(19, 3)
    assert resampled(spark, few, []) == plain_resampling(few, [])
    assert all(k[4] is None for k in resampled(spark, few, []))


def test_long_texts_in_pieces(monkeypatch):
    texts = [t for _, t in make_docs(30, 4)]
    whole = [sorted(plain_features(t)[1]) for t in texts]
    for size in (1, 7, 50, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", size)
        got, words = [[] for _ in texts], np.zeros(len(texts), np.int64)
        for bucket, doc, n in importance.features([t.encode() for t in texts]):
            words += n
            for b, d in zip(bucket.tolist(), doc.tolist()):
                got[d].append(b)
        assert [sorted(g) for g in got] == whole and words.tolist() == [plain_features(t)[0] for t in texts]


def test_draw_among_equal_scores(spark):
    rows = spark.createDataFrame([(i, 30, 1, 0, 5 if i % 3 else -7) for i in range(200)] + [(None, 30, 1, 0, 5)] * 3, "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r["doc_id"]: r["rank"] for r in importance.drawn(rows, share=20).filter(F.col("rank").isNotNull()).collect()}
    assert got == {d: k for k, d in enumerate([i for i in range(200) if i % 3][:40], 1)}
    assert importance.drawn(rows, share=100).filter("rank is null").count() == 0


def test_images_held_are_asked_in_less_time_than_one_by_one(monkeypatch):
    """Queries that ask many images at once find what each image finds by itself, in less time, however few pairs may be held."""
    import time

    r = np.random.default_rng(8)
    pictures = [image_copies.picture(v.tolist()) for v in r.normal(size=(800, 64))]
    images = [(i, *image_copies.features(p)) for i, p in enumerate(pictures)] + [(900, *image_copies.features(None))]
    asked = [(i, *image_copies.features(image_copies.edited(pictures[i], i))) for i in range(0, 800, 10)] + [(901, *images[0][1:]), (902, *image_copies.features(b""))]
    began = time.process_time()
    tables = image_copies.Tables(asked)
    plain = sorted((q, i, n) for i, p, d in images for q, n in tables.matches(p, d))
    took = time.process_time() - began
    began = time.process_time()
    got = sorted(image_copies._asked(images, asked))
    assert time.process_time() - began < 0.8 * took
    assert got == plain and len({q for q, i, _ in got if q == i}) >= 72 and (901, 0) in {m[:2] for m in got}
    monkeypatch.setattr(image_copies, "PAIRS", 20_000)
    assert sorted(image_copies._asked(images[:200], asked[:20])) == [m for m in plain if m[0] < 200 and m[1] < 200]


def test_images_are_read_once_for_many_queries(spark, monkeypatch):
    """Some hundred queries are one block, so one pass over the images; long descriptors make more blocks, with the same result."""
    r = np.random.default_rng(9)
    pictures = [image_copies.picture(v.tolist()) for v in r.normal(size=(30, 64))]
    corpus = image_copies.described(spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(pictures)], "id long, image binary"))
    asked = image_copies.described(spark.createDataFrame([(i, bytearray(pictures[i % 30])) for i in range(250)], "id long, image binary"))
    passes, plain_stage = [], image_copies.stage
    monkeypatch.setattr(image_copies, "stage", lambda df, name: passes.append(name) or plain_stage(df, name))
    once = sorted(map(tuple, image_copies.search(asked, corpus).collect()))
    assert passes == ["queries", "block0"] and {(i, i % 30) for i in range(250)} <= {m[:2] for m in once}
    monkeypatch.setattr(image_copies, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(image_copies, "HELD", 200)
    assert sorted(map(tuple, image_copies.search(asked, corpus).collect())) == once and len(passes) > 4


def test_images_without_enough_keypoints_are_not_held():
    """Flat images are no part of what a task holds, however many there are."""
    few, enough = image_copies.LEAST_AGREE - 1, image_copies.LEAST_AGREE
    rows = [(i, bytes(16 * n), bytes(30 * n)) for i, n in enumerate([0, enough, few, 0, enough, 0])]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["id", "points", "desc"])
    assert [[i for i, _, _ in images] for images in image_copies._portions([batch, batch])] == [[1, 4, 1, 4]]
    assert not list(image_copies._portions([batch.slice(0, 1)]))
