"""Document fingerprints by SpotSigs.

A signature starts at an anchor, a common word, and is the chain of the next two content words after it (common
words in between are passed over, so neighbouring anchors share a chain). A document's fingerprint is its set of
signatures, as sorted 32-bit hashes in hex, so likeness is the Jaccard similarity of two fingerprints. Near pairs of a corpus come from `similar`: sets are
partitioned by length, an index of rare signatures proposes partners in the same or the next partition, length
bounds prune them, and the sets decide.

Defined cases: null text counts as empty. A text without a signature (no anchor, or too few words behind it) has
its words as signatures, so a set is never empty, and equal texts have equal fingerprints and likeness 1. Equal
sets are one class in `similar`. Rows that repeat a doc_id, and null doc_ids (last), keep their place by text;
other columns are ignored; an empty table gives an empty result. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, stage

# Anchors, the most common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is are was were that it for on with as by this be at from or an a "
    "der die das und ist in den von zu mit ein eine nicht auf für im dem des "
    "le la les des et est en un une du que qui dans pour pas par "
    "el los las de y que en un una por con para del se no"
).split()
#: Characters of text that lie in one range of neighbouring documents, about; ranges at most, beyond which they grow instead.
RANGE_CHARS, RANGES = 4_000_000, 1 << 16


def _tree(words: list[str]) -> str:
    """The words as one regular expression that tries each first letter once, and so on."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    branches = [h + _tree(rest) if h else "" for h, rest in sorted(heads.items(), reverse=True)]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


#: One anchor between blanks; no repetition of groups, so no text is too long for the matcher.
_SPOT = " " + _tree(ANCHORS) + "(?= )"


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chains(parts: Column) -> Column:
    """From the stretches of content words behind each anchor, the first two words; a short one takes the next stretch's first."""
    after = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    two = lambda a, b: F.when(F.instr(a, " ") > 0, F.substring_index(a, " ", 2)).otherwise(F.concat(a, F.lit(" "), F.substring_index(b, " ", 1)))
    return F.filter(F.zip_with(parts, after, two), lambda c: c.isNotNull())


def signatures(text: Column) -> Column:
    """array<int>: the sorted distinct hashes of a text's signatures."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[\x00-/:-`{-\x7f]+", " "), F.lit(" "))
    cut = _let(F.split(F.regexp_replace(words, _SPOT, " |"), r"\|"), lambda s: F.slice(s, F.lit(2), F.size(s) - 1))
    parts = F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")
    hashed = _let(_let(parts, _chains), lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x: F.hash(x))).otherwise(F.transform(F.split(F.trim(words), " +"), lambda w: F.hash(w))))
    return F.array_sort(F.array_distinct(hashed))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(2**32))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _ranges(rows: DataFrame, least: int) -> tuple[list[int], list[int]]:
    """Limits of ranges of ids, ascending, and into how many parts each range is cut by hash; one more for null ids.

    An id that fills several quantiles alone is a range by itself and cut in as many parts. At most about RANGES in all.
    """
    known = rows.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    many = min(RANGES, max(least, 1 + (known["chars"] or 0) // RANGE_CHARS))
    nulls = max(1, many * (known["rows"] - known["ids"]) // max(1, known["rows"]))
    if not known["ids"]:
        return [], [1, nulls]
    cuts = rows.agg(F.percentile_approx("doc_id", [(i + 1) / many for i in range(many - 1)] or [0.5], 100 * many).alias("q")).first()["q"]
    often = {c: cuts.count(c) for c in set(cuts)} if len(set(cuts)) < len(cuts) else {}
    hot = {c: n for c, n in often.items() if n > 1}
    limits = sorted({*cuts, *(c + 1 for c in hot if c < 2**63 - 1)})
    return limits, [1, *(hot.get(c, 1) for c in limits), nulls]


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each document and its signatures with the next by descending doc_id; after the last, the first.

    Documents fall in ranges of neighbours; the first document of each range also stands as a guest at the end of the
    range before, so one window over a range finds every next document. Documents of one id follow each other by a
    hash of their text. What the driver holds is a few numbers for each range, and ranges are bounded in number.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    limits, cut = _ranges(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Numbers count from the largest ids on; null ids are last.
    firsts = [0] * len(cut)
    at = 0
    for k in [*range(len(cut) - 2, -1, -1), len(cut) - 1]:
        firsts[k], at = at, at + cut[k]
    # One row of arrays that each row is held against: the plan is as long for many ranges as for few.
    table = F.broadcast(spark.createDataFrame([(limits, firsts, cut)], "limits array<bigint>, firsts array<int>, cut array<int>"))
    middle = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    halve = lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get("limits", middle(a)) <= F.col("doc_id"), F.struct((middle(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle(a).alias("hi")))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(len(limits).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(limits)).alias("hi")), halve, lambda a: a["lo"])
    rows = rows.crossJoin(table).withColumn("place", F.when(F.col("doc_id").isNull(), len(limits) + 1).otherwise(found))
    part = F.floor((F.shiftright("h", 32) + 2**31) * F.get("cut", F.col("place")) / 2**32)
    rows = rows.select("doc_id", "text", "h", (F.get("firsts", F.col("place")) + part).cast("int").alias("range"))
    first = F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("head")
    heads = {r["range"]: (r["head"]["doc_id"], ~r["head"]["h"]) for r in rows.groupBy("range").agg(first).collect()}  # one row a range
    signed = lambda df: df.withColumn("sigs", signatures(F.col("text")))
    order = sorted(heads)
    before = [(r, heads[r][0], heads[r][1], b) for r, b in zip(order, [*order[-1:], *order[:-1]])]
    before = F.broadcast(spark.createDataFrame(before, "range int, head_id bigint, head_h bigint, to int"))
    guests = rows.join(before, "range").filter(F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")))
    guests = guests.groupBy("to").agg(F.first(F.struct("doc_id", "text", "h")).alias("g")).select("g.*", F.col("to").alias("range"))
    carried = ["doc_id", "text", "sigs"]
    both = signed(rows.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))).repartition(max(1, len(order)), "range")
    turn = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "h")
    led = both.withColumns({"next_text": F.lead("text").over(turn), "next_sigs": F.lead("sigs").over(turn)})
    return led.filter("guest = 0").select(*carried, "next_text", "next_sigs")


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, sigs, edited_sigs, next_sigs) for each document.

    The edited text is the document with its last third replaced by the first characters of the next one.
    """
    rows = followed(docs)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - third), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    return rows.select("doc_id", "text", edited.alias("edited"), "sigs", signatures(edited).alias("edited_sigs"), "next_sigs")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(documents(spark, sf_dir))
    own, edit = F.col("sigs"), F.col("edited_sigs")
    facts = [F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(own).alias("fingerprint"), fingerprint(edit).alias("edited_fingerprint")]
    return rows.select("doc_id", *facts, likeness(own, edit).alias("near_edited"), likeness(own, F.col("next_sigs")).alias("near_next"))


def similar(docs: DataFrame, *, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Near pairs of classes (a, b, likeness), and membership (doc_id, class): class is the smallest doc_id with that set.

    Sets in a partition are as long as powers of 100 / percent, so partners lie in the same or the next one. Of
    a set's signatures, rarest first, the first n - ceil(n * percent / 100) + 1 hold one that any partner shares.
    """
    own = docs.select(docs["doc_id"].alias("doc_id"), signatures(F.coalesce(docs["text"], F.lit(""))).alias("sigs"))
    own = stage(own.filter("doc_id is not null").withColumn("set_hash", F.sha2(fingerprint(F.col("sigs")), 256)), "signatures")
    named = own.groupBy("set_hash").agg(F.min("doc_id").alias("class"))
    member = own.join(named, "set_hash").select("doc_id", "class")
    sets = own.join(named, (own["set_hash"] == named["set_hash"]) & (own["doc_id"] == named["class"])).select("class", "sigs").dropDuplicates(["class"])
    each = sets.select("class", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    order = Window.partitionBy("class").orderBy("df", "sig")
    ranked = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig").withColumn("place", F.row_number().over(order))
    prefix = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    part = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)))
    prefix = stage(prefix.select("class", "n", "sig", part.alias("part")), "prefixes")
    left = prefix.select(F.col("class").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("class").alias("b"), F.col("n").alias("nb"), "sig", "part")
    near = left.join(right, ["sig", "part"]).filter(f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()
    one, two = sets.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    pairs = near.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") * 100 >= percent)
    return pairs, member
