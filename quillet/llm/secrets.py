"""Secret scans: fixed patterns, and a battery of randomness tests on long mixed tokens.

Base spans come from three patterns (assign, access, hex). The method then takes every run of token
characters that can carry enough bits, and every piece of a run between the separators + / _ - (groups of hex
digits joined by hyphens stay one piece). What holds both letters and digits gets an encoding: hex, base32 or
base36 in either case, base62 or base64. A run with separators in one case has none as a whole: only its pieces
count. The battery takes four standard scores of a token: the chi-squared statistic of its symbols, the number of
runs of one class of symbols (capitals, small letters, digits, others), the serial correlation of neighbours,
and the chi-squared statistic of the classes. Uniform, independent symbols score about 0 in each. The claim to be
proved is that a token is random, so its p-value comes from tokens that people make: `secret_null` says how the
weighted scores of such tokens lie, by encoding and length, and p is their share that looks at least as random.
Within each band of lengths the Benjamini-Hochberg rule decides over the whole corpus which claims stand, so that
about LEVEL of them at most are wrong; a short token has little power and is only judged among its like. A piece
inside a run that stands adds nothing. p-values are counted in bins of a hundredth of a decade, so only counts
(some thousand rows at most) and one limit a band leave the rows. Short tokens are told apart with less power:
of uniform ones among as many others, about six in ten of 14 base62 symbols are found, nine in ten from 32 on.

Defined cases: null text counts as empty: no spans. Spans are code points, end exclusive; a random span inside
a base span adds nothing and is left out. Repeated rows are judged alike; a null doc_id is kept; other columns
are ignored; empty tables give empty results. Texts count whole. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import located, without_spans
from .common import documents, stage
from .secret_null import ALPHABETS, CLASSES, LENGTHS, NULL

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs of a least length, the least information in bits of what is tested, and the share of wrong claims in a band.
RUN, LEAST_BITS, LEVEL = r"[A-Za-z0-9+/_-]{%d,}={0,2}", 80, 0.05
#: Hex digits joined by hyphens; possessive, so that a long run needs no stack.
JOINED = r"(?<![A-Za-z0-9])(?=[{0}-]{{{1}}})[{0}]++(?:-[{0}]++(?![A-Za-z0-9]))++"
KINDS = ("assign", "access", "hex", "random")


def _base(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop>> of the three base patterns, by start, then kind."""
    assign = F.filter(located(text, ASSIGN, 1), lambda x: F.length(x["value"]) >= 12)
    return F.array_sort(F.concat(_base("assign", assign), _base("access", located(text, ACCESS)), _base("hex", located(text, HEX))))


def piece(least_bits: int) -> str:
    """The pattern of pieces that can carry so many bits."""
    n = math.ceil(least_bits / 4)
    return f"(?:{JOINED.format('0-9a-f', n)}|{JOINED.format('0-9A-F', n)}|[A-Za-z0-9]{{{math.ceil(least_bits / 6)},}})={{0,2}}"


def encoding(run: Column) -> Column:
    """The name of the run's alphabet, or null where no encoding fits."""
    bare = F.regexp_replace(run, "=+$", "")
    mixed = bare.rlike("[0-9]") & bare.rlike("[A-Za-z]")
    return (
        F.when(~mixed, None)
        .when(bare.rlike("^([0-9a-f][0-9a-f-]*|[0-9A-F][0-9A-F-]*)$"), F.lit("hex"))
        .when(bare.rlike("^([a-z2-7]+|[A-Z2-7]+)$"), F.lit("base32"))
        .when(bare.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), F.lit("base36"))
        .when(bare.rlike("[A-Z]") & bare.rlike("[a-z]"), F.when(bare.rlike("^[A-Za-z0-9]+$"), F.lit("base62")).otherwise(F.lit("base64")))
    )


def symbols(run: Column, name: Column) -> Column:
    """The run's symbols as places in its alphabet."""
    alphabet = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in ALPHABETS.items()])
    plain = F.when(name.isin("hex", "base32", "base36"), F.translate(F.lower(run), "-=", "")).otherwise(F.translate(run, "-_=", "+/"))
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.position(c, alphabet) - 1)


def scores(df: DataFrame) -> DataFrame:
    """df (with v: symbols, kind: their alphabet) with n, band and p: the share of made-up tokens that look as random."""
    of = lambda table: F.coalesce(*[F.when(F.col("kind") == k, F.lit(x)) for k, x in table.items()])
    sizes, starts = {k: len(a) for k, a in ALPHABETS.items()}, {k: [*c, *[99] * (4 - len(c))] for k, c in CLASSES.items()}
    # class by class: where it begins, its share of the alphabet
    shares = {k: [(e - b) / sizes[k] for b, e in zip(c, [*c[1:], sizes[k]])] for k, c in CLASSES.items()}
    df = df.withColumns({"n": F.size("v").cast("double"), "k": of(sizes).cast("double")})
    begin = [of({k: s[i] for k, s in starts.items()}) for i in range(1, 4)]
    group = lambda x: sum(((x >= b).cast("int") for b in begin[1:]), (x >= begin[0]).cast("int"))
    total, squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x), F.aggregate(F.sequence(F.lit(0), F.col("k").cast("int") - 1), F.lit(0.0), lambda a, i: a + F.pow(F.size(F.filter("v", lambda x: x == i)).cast("double"), 2))
    df = df.withColumns({"sq": squares, "mean": total / F.col("n"), "c": F.transform("v", group)})
    ahead = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    df = df.withColumns({
        "changes": F.size(F.filter(ahead("c"), lambda s: s["x"] != s["y"])).cast("double"),
        "cov": F.aggregate(ahead("v"), F.lit(0.0), lambda a, s: a + (s["x"] - F.col("mean")) * (s["y"] - F.col("mean"))),
        "var": F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("mean"), F.lit(2.0))),
        "classes": F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda a, i: a + F.coalesce(F.pow(F.size(F.filter("c", lambda x: x == i)).cast("double"), 2) / F.element_at(of({k: s + [None] * (4 - len(s)) for k, s in shares.items()}), i + 1), F.lit(0.0))),
    })
    n, k, same, m = F.col("n"), F.col("k"), of({k: sum(x * x for x in s) for k, s in shares.items()}), of({k: float(len(s)) for k, s in shares.items()})
    parts = [
        ((k / n * F.col("sq") - n) - (k - 1.0)) / F.sqrt(2.0 * (k - 1.0) * (n - 1.0) / n),
        (F.col("changes") - (n - 1.0) * (1.0 - same)) / F.sqrt((n - 1.0) * same * (1.0 - same)),
        (F.when(F.col("var") > 0, F.col("cov") / F.when(F.col("var") > 0, F.col("var")).otherwise(1.0)).otherwise(1.0) + 1.0 / n) * F.sqrt(n),
        (F.col("classes") / n - n - (m - 1.0)) / F.sqrt(2.0 * (m - 1.0)),
    ]
    band = F.coalesce(*[F.when(n >= b, F.lit(b)) for b in reversed(LENGTHS)], F.lit(LENGTHS[0]))
    known = F.coalesce(*[F.when((F.col("kind") == name) & (F.col("band") >= b), F.array(*[F.lit(x) for x in by[b]])) for name, by in NULL.items() for b in sorted(by, reverse=True)])
    df = df.withColumns({"band": band, "scores": F.array(*parts)}).withColumn("w", known)
    x = df.withColumn("x", sum((F.get("w", F.lit(i)) * F.get("scores", F.lit(i)) for i in range(4)), F.get("w", F.lit(4))))
    # The normal distribution below x: by formula 26.2.17 of Abramowitz and Stegun, and far out by its asymptotic series.
    z = F.abs("x")
    t = 1.0 / (1.0 + 0.2316419 * z)
    density = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = density / z * (1.0 - 1.0 / (z * z) + 3.0 / F.pow(z, 4))
    tail = F.when(z > 4.0, far).otherwise(near)
    return x.withColumn("p", F.greatest(F.when(F.col("x") < 0, tail).otherwise(1.0 - tail), F.lit(1e-300)))


def limits(counts: DataFrame, level: float) -> dict[int, int]:
    """By band, the least bin whose claims stand under the Benjamini-Hochberg rule; counts: (band, bin, n), bins of -log10 p."""
    all_rows = counts.groupBy("band").agg(F.sum("n").alias("m"))
    rank = F.sum("n").over(Window.partitionBy("band").orderBy(F.desc("bin")))
    hits = counts.withColumn("rank", rank).join(all_rows, "band").filter(F.pow(F.lit(10.0), -F.col("bin") / 100.0) <= level * F.col("rank") / F.col("m"))
    return {r["band"]: r["least"] for r in hits.groupBy("band").agg(F.min("bin").alias("least")).collect()}


def scan(docs: DataFrame, *, level: float = LEVEL, least_bits: int = LEAST_BITS) -> DataFrame:
    """(doc_id, text_hash, base_spans, secret_spans) for each row of docs; spans array<struct<start, kind, stop>>, kind a place in KINDS."""
    text = F.coalesce(docs["text"], F.lit(""))
    runs = F.filter(located(text, RUN % math.ceil(least_bits / 6)), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    held = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_hash"), base_spans(text).alias("base"), runs.alias("tokens"))
    held = stage(held.withColumn("row", F.monotonically_increasing_id()), "runs")
    runs = held.filter(F.size("tokens") > 0).select("row", F.inline("tokens"))
    # a run with its pieces; one that is a piece itself comes once
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("value").alias("stop"), F.col("value")))
    runs = runs.select("row", F.col("start").alias("run"), F.col("stop").alias("end"), F.inline(F.array_union(whole, located(F.col("value"), piece(least_bits)))))
    runs = runs.withColumns({"start": F.col("run") + F.col("start"), "stop": F.col("run") + F.col("stop"), "kind": encoding(F.col("value"))}).filter("kind is not null")
    sizes = F.coalesce(*[F.when(F.col("kind") == k, F.lit(len(v))) for k, v in ALPHABETS.items()])
    taken = runs.select("row", "run", "end", "start", "stop", "kind", symbols(F.col("value"), F.col("kind")).alias("v"), sizes.alias("size"))
    tested = scores(taken.filter(F.size("v") * F.log2("size") >= least_bits))
    tested = stage(tested.select("row", "run", "end", "start", "stop", "band", F.floor(-100.0 * F.log10("p")).cast("int").alias("bin")), "tests")
    stand = limits(tested.groupBy("band", "bin").agg(F.count("*").alias("n")), level)
    least = F.coalesce(*[F.when(F.col("band") == b, F.lit(v)) for b, v in stand.items()], F.lit(2**31 - 1))
    whole = (F.col("start") == F.col("run")) & (F.col("stop") == F.col("end"))
    random = tested.filter(F.col("bin") >= least).withColumn("within", ~whole & F.max(whole).over(Window.partitionBy("row", "run"))).filter("not within")
    # One pass over the spans of a row in order of their start says which random ones lie inside a base span.
    own = held.select("row", F.inline("base")).join(random.select("row"), "row", "left_semi").select("row", "start", "stop", F.lit(0).alias("added"))
    order = Window.partitionBy("row").orderBy("start", "added").rowsBetween(Window.unboundedPreceding, 0)
    both = own.union(random.select("row", "start", "stop", F.lit(1))).withColumn("covered", F.max(F.when(F.col("added") == 0, F.col("stop"))).over(order))
    outside = both.filter("added = 1 and coalesce(covered < stop, true)")
    more = outside.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "stop")).alias("more"))
    joined = held.join(more, "row", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return joined.select("doc_id", "text_hash", F.col("base").alias("base_spans"), spans.alias("secret_spans"))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of scan()'s result replaced by a mark and n_chars renewed where text changed."""
    text = F.col("whole.text")
    hits = found.filter(F.size("secret_spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("secret_spans").alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    rows = rows.join(hits, F.col("own_id").eqNullSafe(hits["doc_id"]) & (F.col("own_hash") == hits["text_hash"]), "left")
    hit = F.col("spans").isNotNull()
    rows = rows.withColumn("clean", F.when(hit, without_spans(text, F.col("spans"), mark)).otherwise(text))
    made = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(hit, F.length("clean").cast("long")).otherwise(F.col("whole.n_chars"))
    return rows.select(*[made.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs)
    of = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(_said(F.col("base_spans")), 256).alias("base_sha256"), _said(F.col("secret_spans")).alias("spans"))
