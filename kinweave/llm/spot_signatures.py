"""Document fingerprints by SpotSigs, in DataFrame functions only (operator 10).

A spot signature is an anchor (a very common word) with the chain of the next
``CHAIN`` content words; a document's fingerprint is the set of its signatures'
hashes. Sets are dealt into partitions by length, such that two sets whose
Jaccard likeness reaches the threshold lie in the same or in adjacent ones; a
likeness is computed only if the lengths, and the rare signatures that two sets
share, let it reach the threshold (``near_classes``). The likeness of a document
to its edited text and to the next document is that of the whole sets behind
their digests, so it is computed whatever it is.

Words are found in one pass over the text: each is marked as anchor or content,
the marked words are joined and cut at content marks, so the chain of an anchor
is the beginning of the cuts after its own. Work is linear in the text.

Defined results: a null text is the empty text, its set is empty; a text without
any signature (no anchors, or no content words) has one, the hash of the whole
text; two empty sets have likeness 1. Equal texts have equal sets.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, pick, written
from .graph import components

# Anchors, common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be by for from in is it of on or that the this to was with
auf das dem den der die ein eine für im ist mit nicht sich und von zu
au avec dans de des du elle en est et la le les par pour que qui sur un une
al como con del el es las los no para por se su una y
""".split()
CHAIN = 2
THRESHOLD = 0.8
#: Bytes of text in a range of ids, and the ranges there may be.
RANGE_BYTES = 64 << 20
MAX_RANGES = 65_536
#: Buckets that signatures are counted in, to tell common ones from rare ones.
MOST_BUCKETS = 1 << 20
#: So many numbers of classes, or signatures, are broadcast at most (8 MB).
BROADCAST_NAMES = 1_000_000
#: Parts under a signature beyond which they are first compared with some of them, how many these are, and how often that is done.
FEW = 8
LEADERS = 8
STEPS = 2
#: Classes with up to so many shared signatures carry them along, so a pair of them is made once and not for each signature it shares.
CARRIED = 12
_SIGNS = ".,;:!?\"'()[]{}|*#$%&<>/\\-_+=~`^@"
_SPACES = "\t\n\r\x0b\x0c\x01\x02"


def signatures(text: Column, anchors: list[str] | None = None, chain: int = CHAIN) -> Column:
    """Sorted distinct hashes of a text's spot signatures."""
    body = F.coalesce(text, F.lit(""))
    flat = F.translate(F.lower(body), _SPACES + _SIGNS, " " * len(_SPACES))
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    marked = F.transform(words, lambda w: F.concat(F.when(w.isin(anchors or ANCHORS), F.lit("\x01")).otherwise(F.lit("\x02")), w))
    # Cut k holds content word k (none in the first) and the anchors between it and the next.
    cuts = F.transform(F.split(F.array_join(marked, ""), "\x02"), lambda c: F.split(c, "\x01"))

    def spots(arr: Column) -> Column:
        contents = lambda k: [F.get(F.get(arr, k + i), F.lit(0)) for i in range(1, chain + 1)]
        own = lambda cut, k: F.transform(
            F.slice(cut, 2, F.size(cut)), lambda a: F.xxhash64(a, *contents(k))
        )
        return F.transform(F.slice(arr, 1, F.size(arr) - 1), own)

    # A one-element array binds the cuts, so they are computed once.
    found = F.flatten(F.flatten(F.transform(F.array(cuts), spots)))
    some = F.sort_array(F.array_distinct(found))
    none = F.expr("cast(array() as array<bigint>)")
    return F.transform(F.array(some), lambda s: F.when(F.size(s) > 0, s).when(body == "", none).otherwise(F.array(F.xxhash64(body))))[0]


def digest(sigs: Column) -> Column:
    """A set of signatures as a string of fixed length."""
    return F.sha2(F.array_join(sigs.cast("array<string>"), ","), 256)


def length_partition(sigs: Column, threshold: float = THRESHOLD) -> Column:
    """Sets whose likeness reaches the threshold are in the same partition or in adjacent ones."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness; 0 without comparing the sets if their lengths alone keep it below ``least``."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (low + high - n))[0]
    return F.when(high == 0, 1.0).when((low == 0) | (low < least * high), 0.0).otherwise(both)


def _count_above(falling: list[float], value: Column, block: int = 64) -> Column:
    """How many of the falling numbers are over value: whole blocks by their last number, then inside one block."""
    array = lambda xs: F.array(*map(F.lit, xs)) if xs else F.expr("cast(array() as array<double>)")
    over = lambda xs: F.size(F.filter(xs, lambda b: b > value))
    blocks = over(array(falling[block - 1 :: block]))
    return blocks * block + over(F.slice(array(falling), blocks * block + 1, F.lit(block)))


def _as_number(df: DataFrame, first: object, last: object) -> Column:
    """doc_id as a number in the order of ids, null for null. Ids that differ may have one number: long strings, numbers of over 53 bits."""
    kind = df.schema["doc_id"].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = lambda x: x if isinstance(x, (bytes, bytearray)) else str(x or "").encode()
        a, b = raw(first), raw(last)
        shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        after = F.substring(F.col("doc_id").cast("binary"), shared + 1, 6)
        return F.conv(F.rpad(F.hex(after), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date("doc_id").cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros("doc_id").cast("double")
    return F.col("doc_id").cast("double")


class _Ranges:
    """Ranges of rows in the order of (doc_id descending, null last, hash of the text): bounds by quantiles of the ids, and by hash inside an id that fills several."""

    def __init__(self, df: DataFrame, range_bytes: int):
        spark = df.sparkSession
        size = F.sum(F.octet_length("text").cast("long") + 64)
        n, named, bytes_, first, last = df.agg(F.count(F.lit(1)), F.count("doc_id"), size, F.min("doc_id"), F.max("doc_id")).first()
        count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_RANGES, -(-(bytes_ or 0) // range_bytes)))
        self.number = _as_number(df, first, last)
        self.bounds: list[float] = []
        self.shares: list[int] = []
        if count > 1 and named:
            rows = df.select(self.number.alias("d")).where("d is not null")
            wanted = [i / count for i in range(1, count)]
            found = rows.approxQuantile("d", wanted, 0.1 / count)
            times = {b: found.count(b) for b in set(found)} if len(found) < 1000 else dict(Counter(found))
            often = [b for b, k in times.items() if k > 1]
            one = {}
            if often:  # an id is dealt by hash only if no other has its number
                same = df.select(self.number.alias("d"), "doc_id").where(F.col("d").isin(often)).groupBy("d")
                one = {r["d"]: r["a"] == r["b"] for r in same.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()}
            self.bounds = sorted(times, reverse=True)
            self.shares = [times[b] if one.get(b) else 1 for b in self.bounds]
        #: The first range of each interval [bound, next higher bound): what is over the bound, then the bound itself if it has ranges of its own.
        self.offsets = [0]
        for k in self.shares:
            self.offsets.append(self.offsets[-1] + (1 if k == 1 else k + 1))
        self.unnamed = max(1, round(count * (n - named) / n)) if n and n > named else 0
        self.total = self.offsets[-1] + 1 + self.unnamed

    def place(self) -> Column:
        array = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")
        # Uniform over its range, as the hash is.
        part = lambda k: F.least(F.floor((F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 11) / float(1 << 53)) * k), k - 1)
        nulls = self.offsets[-1] + 1 + part(F.lit(max(1, self.unnamed)))
        if not self.bounds:
            return F.when(F.col("doc_id").isNull(), nulls).otherwise(0).cast("int")
        at = _count_above(self.bounds, self.number)
        own, bound = F.get(array(self.shares, "int"), at), F.get(array([repr(b) for b in self.bounds], "double"), at)
        inside = F.when((own > 1) & (self.number == bound), 1 + part(own)).otherwise(0)
        return F.when(F.col("doc_id").isNull(), nulls).otherwise(F.get(array(self.offsets, "int"), at) + inside).cast("int")


def with_next(df: DataFrame, carried: list[str], made: dict[str, Column] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """df (with doc_id and text), the columns of ``made`` (computed after the shuffle) and next_<c> for each carried column, of the next row by descending doc_id (null last, ties by hash of the text); after the last comes the first.

    Rows are dealt into ranges of ids of some range_bytes of text each (MAX_RANGES
    at most), and rows of one id that fills several ranges by hash of the text. The
    first row of each range also goes to the range before it, so one shuffle on the
    range is enough and no task sees all rows. What reaches the driver is a bound
    and the first row's id and hash for each range. Rows equal in id and text stay
    in one range.
    """
    hashed = df.withColumn("_h", F.xxhash64("text"))
    ranges = _Ranges(df, range_bytes)
    placed = hashed.withColumn("_r", ranges.place())
    # The first row of a range: the greatest id, and of its rows the least hash.
    rank = F.struct("doc_id", F.bitwise_not("_h").alias("nh"))
    firsts = {r["_r"]: r["f"] for r in placed.groupBy("_r").agg(F.max(rank).alias("f")).collect()}
    used = sorted(firsts)
    before = {r: used[i - 1] for i, r in enumerate(used)}
    listed = [{"_r": r, "_f": None if firsts[r]["doc_id"] is None else str(firsts[r]["doc_id"]), "_fh": ~firsts[r]["nh"], "_b": before[r]} for r in used]
    read = F.explode(F.from_json(F.lit(json.dumps(listed)), "array<struct<_r: int, _f: string, _fh: bigint, _b: int>>")).alias("x")
    known = df.sparkSession.range(1).select(read).select("x._r", F.col("x._f").cast(df.schema["doc_id"].dataType).alias("_f"), "x._fh", "x._b")
    known = F.broadcast(known)
    first = F.col("doc_id").eqNullSafe(F.col("_f")) & (F.col("_h") == F.col("_fh"))
    target = lambda r, extra: F.struct(r.cast("int").alias("r"), F.lit(extra).alias("extra"))
    targets = F.when(first, F.array(target(F.col("_r"), 0), target(F.col("_b"), 1))).otherwise(F.array(target(F.col("_r"), 0)))
    dealt = placed.join(known, "_r").withColumn("_t", F.explode(targets)).withColumn("_r", F.col("_t.r")).withColumn("_x", F.col("_t.extra")).drop("_t", "_f", "_fh", "_b")
    dealt = dealt.repartitionById(ranges.total, F.col("_r")).withColumns(made or {})
    w = Window.partitionBy("_r").orderBy("_x", F.col("doc_id").desc_nulls_last(), F.col("_h"), F.col("text"))
    out = dealt.withColumn("_n", F.lead(F.struct(*carried)).over(w)).where("_x = 0")
    return out.select(*df.columns, *(made or {}), *(F.col(f"_n.{c}").alias(f"next_{c}") for c in carried))


def edited_and_next(df: DataFrame) -> DataFrame:
    """doc_id, text, signatures, edited (the last third replaced by the next text's beginning), edited_signatures, next_signatures."""
    docs = pick(df, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    linked = with_next(docs, ["text", "signatures"], {"signatures": signatures(F.col("text"))})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    return linked.withColumn("edited", edited).drop("next_text").withColumn("edited_signatures", signatures(F.col("edited")))


def _weights(signed: DataFrame, total: int) -> list[int]:
    """How much commoner than the mean each bucket of signatures is, as a power of two.

    Some 128 signatures share a bucket, within MOST_BUCKETS of them. A light bucket
    that is taken for a heavy one does no harm: any order of the signatures is right.
    """
    buckets = min(MOST_BUCKETS, max(1 << 12, 1 << (total // 128).bit_length()))
    each = signed.select(F.explode("signatures").alias("g")).groupBy(F.pmod("g", F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    mean = total / buckets
    heavy = each.where(F.col("n") > mean + 2 * math.sqrt(mean) + 2).collect()
    out = [0] * buckets
    for r in heavy:
        out[r["b"]] = max(1, int(math.log2(r["n"] - mean + 1)))
    return out


def _prefix(signatures_: Column, weights: list[int], threshold: float) -> Column:
    """The ``n - ceil(threshold * n) + 1`` first of n signatures, light buckets first, then by hash. Two sets that reach the threshold share one of them."""
    n = F.size(signatures_)
    length = n - F.ceil(F.lit(threshold) * n - 1e-9) + 1
    if not any(weights):
        return F.slice(signatures_, F.lit(1), length)
    weight = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    keyed = F.transform(signatures_, lambda g: F.struct(F.get(weight, F.pmod(g, F.lit(len(weights))).cast("int")).alias("w"), g.alias("g")))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), length), lambda x: x["g"])


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v: numbers of classes) whose sets reach the threshold."""
    wanted = written(pairs.select(F.explode(F.array("u", "v")).alias("number")).distinct(), "spot-wanted")
    own = _semi(sets.select("number", F.col("signatures").alias("s")), wanted, "number")
    one, two = own.select(F.col("number").alias("u"), F.col("s").alias("su")), own.select(F.col("number").alias("v"), F.col("s").alias("sv"))
    found = pairs.join(one, "u").join(two, "v").where(likeness(F.col("su"), F.col("sv"), threshold) >= threshold - 1e-12).select("u", "v")
    found = written(found, "spot-links")
    forget(wanted)
    return found


def _semi(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the names (written): by broadcast up to BROADCAST_NAMES of them."""
    return rows.join(F.broadcast(names) if names.count() <= BROADCAST_NAMES else names, key, "left_semi")


def _rest(n: Column, threshold: float) -> Column:
    """Signatures of a set behind its prefix."""
    return F.ceil(F.lit(threshold) * n - 1e-9) - 1


def _least_shared(n1: Column, n2: Column, low1: Column, low2: Column, threshold: float) -> Column:
    """So many signatures of their prefixes sets of n1 and n2 signatures share at least if they reach the threshold (low1, low2: the least sizes, where sizes are ranges).

    Of the set whose prefix ends first, all that may still be shared lies behind
    it, so the sets share at most the longer of the rests beside their prefixes.
    """
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (low1 + low2) - 1e-9)
    return need - F.greatest(_rest(n1, threshold), _rest(n2, threshold))


def _counted(shared: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v, n1, n2: a row for each signature of both prefixes that they share), once each, if they share enough to reach the threshold."""
    counted = shared.groupBy("u", "v", "n1", "n2").agg(F.count(F.lit(1)).alias("k"))
    n1, n2 = F.col("n1"), F.col("n2")
    return counted.where(F.col("k") >= _least_shared(n1, n2, n1, n2, threshold)).select("u", "v")


def _once(g: Column, n1: Column, n2: Column, keys1: Column, keys2: Column, threshold: float) -> Column:
    """Of classes that both carry their shared signatures: is g the first that they have in common, and have they enough? True if one doesn't carry them."""
    both = F.array_intersect(keys1, keys2)
    return F.coalesce((F.get(both, F.lit(0)) == g) & (F.size(both) >= _least_shared(n1, n2, n1, n2, threshold)), F.lit(True))


def _fits(n1: Column, n2: Column, c1: Column, c2: Column, threshold: float) -> Column:
    """Lengths, and the signatures that each prefix shares with any other, let the likeness reach the threshold: then the sets lie in the same length partition or in adjacent ones."""
    return (F.least(n1, n2) >= F.lit(threshold) * F.greatest(n1, n2) - 1e-9) & (F.least(c1, c2) >= _least_shared(n1, n2, n1, n2, threshold))


def _parity(word: int) -> Column:
    """64 bits of a set, of which each signature flips one."""
    return F.expr(f"aggregate(signatures, 0L, (acc, g) -> if((shiftright(g, 6) & 1) = {word}, acc ^ shiftleft(1L, cast(g & 63 as int)), acc))")


def _close(n1: Column, n2: Column, words1: list[Column], words2: list[Column], threshold: float) -> Column:
    """Sets differ in at least as many signatures as their parities do in bits: few enough to reach the threshold? True if a set's words aren't carried."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words1, words2, strict=True)), F.lit(0))
    return F.coalesce(differ <= (n1 + n2) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9, F.lit(True))


def _stars(placed: DataFrame, step: int, threshold: float) -> DataFrame:
    """Pairs of classes to compare: under each signature that over FEW parts have, all others with LEADERS of them, taken by hash.

    The same classes lead under all signatures that a group of near copies shares,
    so pairs with them are counted in full, or nearly.
    """
    crowded = placed.groupBy("g", "part").agg(F.count_distinct("root").alias("m")).where(F.col("m") > FEW).select("g", "part")
    inside = written(placed.join(crowded, ["g", "part"]), "spot-crowded")
    salts = [F.min(F.struct(F.xxhash64("number", F.lit(97 * step + k)).alias("h"), "number", "n", "c", "root", "own", "p0", "p1")).alias(f"l{k}") for k in range(LEADERS)]
    leads = inside.groupBy("g", "part").agg(*salts).select("g", "part", F.explode(F.array_distinct(F.array(*(F.struct(*(F.col(f"l{k}.{c}").alias(c) for c in ("number", "n", "c", "root", "own", "p0", "p1"))) for k in range(LEADERS))))).alias("lead"))
    apart = (F.col("root") != F.col("lead.root")) & (F.col("own") | F.col("lead.own"))
    star = inside.join(leads, ["g", "part"]).where(apart & _fits(F.col("lead.n"), F.col("n"), F.col("lead.c"), F.col("c"), threshold))
    star = star.where(_close(F.col("lead.n"), F.col("n"), [F.col("lead.p0"), F.col("lead.p1")], [F.col("p0"), F.col("p1")], threshold))
    star = star.select(F.col("lead.number").alias("u"), F.col("number").alias("v"), F.col("lead.n").alias("n1"), F.col("n").alias("n2"))
    counted = written(_counted(star, threshold), "spot-star")
    forget(inside)
    return counted.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_classes(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """fingerprint, component_id, n_members: for each distinct set of signatures the smallest doc_id that links of likeness ``threshold`` or more reach from it, and its documents.

    Copies are one class from the first aggregate on. Each class is under its
    prefix signatures, those of light buckets first, in its length partition and
    the one below. Under a crowded signature all classes are first compared with a
    few of them (stars, linear in the classes), STEPS times, and what these links
    connect is one part. Then classes of different parts under the same signature
    are compared in pairs, so a group of near copies makes no pairs among what is
    connected already, and no link between parts is missed. Pairs that share too
    few of their prefixes, whose lengths are too far apart, or whose parities (of 128
    bits) show that they differ too much, are never compared.
    """
    docs = pick(df, "doc_id", "text")
    signed = docs.select("doc_id", signatures(F.col("text")).alias("signatures"))
    made = signed.select("doc_id", digest(F.col("signatures")).alias("fingerprint"), F.size("signatures").alias("n"), "signatures")
    sets = written(made.select("*", _parity(0).alias("p0"), _parity(1).alias("p1"), F.monotonically_increasing_id().alias("number")), "spot-sets")
    classes = written(sets.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_members"), F.min("number").alias("number")), "spot-classes")
    total = sets.agg(F.sum("n")).first()[0] or 0
    weights = _weights(sets, total) if total else [0]
    every = sets.where("n > 0").select("number", "n", F.explode(_prefix(F.col("signatures"), weights, threshold)).alias("g"))
    each = written(_semi(every, classes.select("number"), "number"), "spot-prefixes")
    common = written(each.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g"), "spot-common")
    lengths = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    at = F.array(F.struct(lengths.alias("part"), F.lit(True).alias("own")), F.struct((lengths - 1).alias("part"), F.lit(False).alias("own")))
    keyed = written(_semi(each, common, "g").select("number", "n", "g", F.explode(at).alias("at")).select("number", "n", "g", "at.*"), "spot-keyed")
    forget(common, each)
    several = keyed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("some")).where("m > 1 and some").select("g", "part")
    both = written(keyed.join(several, ["g", "part"]), "spot-both")
    own = both.groupBy("number").agg(F.sort_array(F.collect_set("g")).alias("all"))
    counts = own.select("number", F.size("all").alias("c"), F.when(F.size("all") <= CARRIED, F.col("all")).alias("keys"))
    bits = _semi(sets.select("number", "p0", "p1"), written(counts.select("number"), "spot-numbers"), "number")
    shared = written(both.join(counts.join(bits, "number"), "number"), "spot-shared")
    forget(keyed, both)
    links, placed = None, shared.withColumn("root", F.col("number"))
    for step in range(STEPS):
        found = _alike(_stars(placed, step, threshold), sets, threshold)
        links = found if links is None else links.unionByName(found)
        parts = components(links)
        rooted = shared.join(parts, shared["number"] == parts["node"], "left").select(*(shared[c] for c in shared.columns), F.coalesce("root", "number").alias("root"))
        placed = written(rooted, "spot-placed")
    # Parts that meet under a signature, then their classes: classes of one part are never paired.
    meeting = placed.groupBy("g", "part", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("c").alias("c"), F.max("own").alias("some"), F.count(F.lit(1)).alias("m"), *(F.min(x).alias(x) for x in ("keys", "p0", "p1")))
    meeting = meeting.withColumns({x: F.when(F.col("m") == 1, F.col(x)) for x in ("keys", "p0", "p1")})
    a, b = meeting.alias("a"), meeting.alias("b")
    near = (F.col("a.low") <= F.col("b.high") / threshold + 1e-9) & (F.col("b.low") <= F.col("a.high") / threshold + 1e-9) & (F.col("a.some") | F.col("b.some"))
    near = near & (F.least("a.c", "b.c") >= _least_shared(F.col("a.high"), F.col("b.high"), F.col("a.low"), F.col("b.low"), threshold))
    near = near & _close(F.col("a.high"), F.col("b.high"), [F.col("a.p0"), F.col("a.p1")], [F.col("b.p0"), F.col("b.p1")], threshold)
    near = near & _once(F.col("a.g"), *(F.col(x) for x in ("a.low", "b.low", "a.keys", "b.keys")), threshold)
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.root") < F.col("b.root")) & near)
    # The smaller part's classes first, so that what the first join makes stays small.
    fewer = F.col("a.m") <= F.col("b.m")
    r1, r2 = F.when(fewer, F.col("a.root")).otherwise(F.col("b.root")), F.when(fewer, F.col("b.root")).otherwise(F.col("a.root"))
    met = met.select(F.col("a.g").alias("g"), F.col("a.part").alias("part"), r1.alias("r1"), r2.alias("r2"))
    one, two = (placed.select("g", "part", F.col("root").alias(f"r{k}"), F.col("number").alias(x), F.col("n").alias(f"n{k}"), F.col("c").alias(f"c{k}"), F.col("own").alias(f"own{k}"), F.col("keys").alias(f"keys{k}"), F.col("p0").alias(f"p0{k}"), F.col("p1").alias(f"p1{k}")) for k, x in ((1, "u"), (2, "v")))
    column = lambda *names: (F.col(x) for x in names)
    allowed = (F.col("own1") | F.col("own2")) & _fits(*column("n1", "n2", "c1", "c2"), threshold) & _once(*column("g", "n1", "n2", "keys1", "keys2"), threshold)
    across = met.join(one, ["g", "part", "r1"]).join(two, ["g", "part", "r2"], "inner").where(allowed)
    across = across.where(_close(F.col("n1"), F.col("n2"), list(column("p01", "p11")), list(column("p02", "p12")), threshold))
    across = written(across.select("u", "v", "n1", "n2", (F.col("keys1").isNotNull() & F.col("keys2").isNotNull()).alias("once")), "spot-across")
    compared = across.where("once").select("u", "v").unionByName(_counted(across.where("not once"), threshold))
    more = _alike(compared, sets, threshold)
    roots = components(links.unionByName(more))
    forget(sets, shared, placed, across)
    rooted = classes.join(roots, classes["number"] == roots["node"], "left").select("fingerprint", "least", "n_members", F.coalesce("root", "number").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fingerprint", "component_id", "n_members")
