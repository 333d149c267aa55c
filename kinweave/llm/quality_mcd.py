"""Quality rules with robust multivariate outliers (operator 2).

Counts are taken from every whole text; six transformed statistics of each text
make a vector, and each language and source gets a minimum-covariance-determinant
estimate of centre and covariance. A text is kept if its Mahalanobis distance
is within a chi-square quantile.

The estimate is the subset of ``share`` of a group's rows whose covariance has
the smallest determinant, sought from several deterministic starts (medians with
quartile scales, the plain moments, spatial signs, and hyperbolic tangents of
the standardised statistics). A concentration step takes the rows nearest to an
estimate and estimates again; after FIRST_STEPS of them the BEST starts of each
group by determinant go on, each until its determinant falls no further, and the
smallest one is kept. Covariances are made consistent for the normal
distribution; a ridge of RIDGE of each floor keeps a statistic that never varies
from making all determinants zero. The verdict alone uses whole FLOORS.

Every step is over all rows, without a sample: it sorts the rows of a group into
a fixed number of distance bins, sums counts, vectors and cross products in each
bin with a partial aggregate, and takes the bins with the smallest distances
that hold ``share`` of the rows. Statistics are whole thousandths and sums are
whole numbers, so results depend neither on the order nor on the partitioning of
rows. A hot source is only ever summed.

Sources of a language with under ``min_group`` rows are pooled; if the pool is
under it as well, it joins the pool of all such languages.

Defined results: a null text has no words; a text without words fails the base
rule; null languages or sources are groups of their own; equal texts in the same
group get equal verdicts; an empty table gives an empty result; very long texts
are counted whole; ids may be null or repeat; columns that aren't named above, or
differ by case from those that are, are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, forget, pick, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
FEATURES = ["symbols", "dup_lines", "repeats", "upper", "word_length", "line_words"]
#: The least standard deviation of each statistic, in its own unit: below it a difference says nothing about quality.
FLOORS = [0.3, 0.08, 0.08, 0.08, 0.15, 0.8]
RIDGE = 0.1
SCALE = 1000
BINS = 512
SHARE = 0.7
#: Steps with all starts, and the starts of a group that go on after them.
FIRST_STEPS = 2
BEST = 2
#: A determinant whose logarithm falls by less than this has settled.
SETTLED = 1e-4
MIN_GROUP = 200
QUANTILE = 0.99999
#: Up to so many groups (some 400 bytes each) their estimates are broadcast; beyond, they are joined by key.
BROADCAST_GROUPS = 20_000
#: Estimates that a task makes and a file holds. A task reads BINS rows for each at most, whatever the number of documents;
#: without this each shuffle partition would write a file of a row or two at every step.
PART_ESTIMATES = 128

_SPACES = b" \t\n\r\x0b\x0c"
_ALL = bytes(range(256))
_NOT_SYMBOL = bytes(c for c in _ALL if c not in b"#*$%&|<>")
_NOT_UPPER = bytes(c for c in _ALL if not 65 <= c <= 90)
_NOT_LETTER = bytes(c for c in _ALL if not (65 <= c <= 90 or 97 <= c <= 122))


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    n = len(words) - 2
    if n < 2 or n <= 200_000 and len(set(zip(words, words[1:], words[2:], strict=False))) == n:
        return 0
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)
    _, which, times = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    seen: set = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    return len(words), chars, len(raw.translate(None, _NOT_SYMBOL)), dup, repeated_words(words), lines, len(raw.translate(None, _NOT_UPPER)), len(raw.translate(None, _NOT_LETTER))


def with_counts(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    def make():
        def compute(values: list) -> list[list]:
            return [list(c) for c in zip(*map(base_counts, values), strict=True)]

        return compute

    return append_columns(df, make, [(c, T.LongType()) for c in COUNTS], keep=keep)


def _features() -> list[Column]:
    """Statistics in whole thousandths; rates of short texts are drawn towards zero."""
    n, lines = F.col("n_words"), F.col("n_lines")
    raw = [
        F.log1p(100 * F.col("n_symbols") / (n + 20)),
        F.col("n_dup_lines") / (lines + 4),
        F.col("n_repeat_words") / (n + 20),
        F.col("n_upper") / (F.col("n_letters") + 50),
        F.log1p(F.col("word_chars") / F.greatest(n, F.lit(1))),
        F.log1p(n / F.greatest(lines, F.lit(1))),
    ]
    return [F.round(x * SCALE).cast("long").alias(name) for x, name in zip(raw, FEATURES, strict=True)]


def chi2_cdf(x: float, p: int) -> float:
    """For even p."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
_ESTIMATE = T.StructType(
    [
        T.StructField("k_lang", T.StringType()),
        T.StructField("k_source", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("centre", T.ArrayType(T.DoubleType())),
        T.StructField("precision", T.ArrayType(T.DoubleType())),
        T.StructField("verdict", T.ArrayType(T.DoubleType())),
        T.StructField("logdet", T.DoubleType()),
        T.StructField("moving", T.BooleanType()),
    ]
)
_KEY = ["level", "k_lang", "k_source"]


def floored(cov: np.ndarray) -> np.ndarray:
    """The covariance of the verdict: no statistic varies by less than its floor."""
    out = cov + np.diag(np.square(FLOORS)) * 0.25
    np.fill_diagonal(out, np.maximum(out.diagonal(), np.square(FLOORS)))
    return out


def ridged(cov: np.ndarray) -> np.ndarray:
    """The covariance of the search."""
    return cov + np.diag(np.square(FLOORS)) * RIDGE**2


def covariance(n: int, sums: list[int], cross: list[int], scale: int = SCALE) -> np.ndarray:
    """From whole sums, whole up to the division."""
    cov = np.zeros((len(sums), len(sums)))
    for (i, j), c in zip(PAIRS, cross, strict=True):
        cov[i, j] = cov[j, i] = (n * c - sums[i] * sums[j]) / (n * n * scale**2)
    return cov


def consistency(n: int, rows: int, p: int) -> float:
    """What the covariance of the nearest n of some rows is of that of all, if they are normal."""
    part = min(0.9999, n / rows)
    return chi2_cdf(chi2_quantile(part, p), p + 2) / part


def _estimate(key: tuple, start: int, centre: list[float], cov: np.ndarray, known: bool = True) -> tuple:
    """A row of _ESTIMATE; a start's own determinant isn't that of a subset, so it isn't known."""
    upper = lambda m: [m[i, j] for i, j in PAIRS]
    logdet = float(np.linalg.slogdet(ridged(cov))[1]) if known else math.inf
    return (*key, start, centre, upper(np.linalg.inv(ridged(cov))), upper(np.linalg.inv(floored(cov))), logdet, True)


def _key_is(left: list[str], right: list[str]) -> Column:
    """Equality of (level, lang, source), null-safe but for the level."""
    (a, *more), (b, *others) = left, right
    same = F.col(a) == F.col(b)
    for x, y in zip(more, others, strict=True):
        same = same & F.col(x).eqNullSafe(F.col(y))
    return same


def _distance() -> Column:
    x = [F.col(f) / SCALE - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for at, (i, j) in enumerate(PAIRS):
        total = total + F.col("precision")[at] * x[i] * x[j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _with_estimates(rows: DataFrame, estimates: DataFrame, groups: int, matrix: str = "precision") -> DataFrame:
    """rows with start, centre and precision of their group."""
    right = estimates.select(F.col("level").alias("e_level"), F.col("k_lang").alias("e_lang"), F.col("k_source").alias("e_source"), "start", "centre", F.col(matrix).alias("precision"))
    if groups <= BROADCAST_GROUPS:
        right = F.broadcast(right)
    return rows.join(right, _key_is(_KEY, ["e_level", "e_lang", "e_source"]), "left").drop("e_lang", "e_source", "e_level")


def _parts(estimates: int) -> int:
    """Tasks, and so files, for so many estimates; all of them are kept."""
    return max(1, -(-estimates // PART_ESTIMATES))


def _quartiles(rows: DataFrame) -> DataFrame:
    """Start 0, centre and scale of each statistic from its quartiles, exact by histogram."""
    long = rows.select(*_KEY, F.posexplode(F.array(*FEATURES)).alias("f", "v")).groupBy(*_KEY, "f", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*_KEY, "f").orderBy("v")
    at = long.select(*_KEY, "f", "v", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(*_KEY, "f")).alias("all"))
    q = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("v")))
    quarts = at.groupBy(*_KEY, "f").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))
    each = F.array_sort(F.collect_list(F.struct("f", "q1", "q2", "q3")))
    grouped = quarts.groupBy(*_KEY).agg(each.alias("q"))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                centre = [x["q2"] / SCALE for x in row.q]
                scale = [max((x["q3"] - x["q1"]) / SCALE / 1.349, f) for x, f in zip(row.q, FLOORS, strict=True)]
                out.append(_estimate((row.k_lang, row.k_source, row.level), 0, centre, np.diag(np.square(scale)), known=False))
            yield pd.DataFrame(out, columns=_ESTIMATE.names)

    return grouped.mapInPandas(estimate, _ESTIMATE)


def _sums(grouped, extra: list[Column]) -> DataFrame:
    sums = [F.sum(F.col(f)).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    cross = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c{i}_{j}") for i, j in PAIRS]
    return grouped.agg(F.count(F.lit(1)).alias("n"), *extra, *sums, *cross)


_SUMS = [f"s{i}" for i in range(len(FEATURES))]
_CROSS = [f"c{i}_{j}" for i, j in PAIRS]


def _whole(row, names: list[str]) -> list[int]:
    return [int(getattr(row, c)) for c in names]


def start_estimates(n: int, sums: list[int], cross: list[int], kind: int, centre: list[float], scale: list[float]) -> tuple[list[float], np.ndarray]:
    """Centre and covariance of start 1, 2 or 3 from sums of the statistics, of their spatial signs, of their tangents (in thousandths)."""
    p = len(sums)
    cov = covariance(n, sums, cross)
    if kind == 1:
        return [x / n / SCALE for x in sums], cov
    if kind == 2:
        shape = np.zeros((p, p))
        for (i, j), c in zip(PAIRS, cross, strict=True):
            shape[i, j] = shape[j, i] = p * c / (n * SCALE**2)
    else:
        spread = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
        shape = cov / np.outer(spread, spread)
        np.fill_diagonal(shape, 1.0)
    return list(centre), shape * np.outer(scale, scale)


def _starts(rows: DataFrame, groups: int) -> DataFrame:
    """All starts of each group."""
    quartiles = written(_quartiles(rows).coalesce(_parts(groups)), "quality-start")
    p = len(FEATURES)
    # The precision of start 0 is diagonal, so its entries give the scales.
    diagonal = [PAIRS.index((i, i)) for i in range(p)]
    near = _with_estimates(rows, quartiles, groups)
    z = [(F.col(f) / SCALE - F.col("centre")[i]) * F.sqrt(F.col("precision")[diagonal[i]]) for i, f in enumerate(FEATURES)]
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0")))
    near = near.select(*_KEY, "centre", "precision", *FEATURES, *(x.alias(f"z{i}") for i, x in enumerate(z))).withColumn("norm", norm)
    sign = [F.when(F.col("norm") > 0, F.round(F.col(f"z{i}") / F.col("norm") * SCALE)).otherwise(0).cast("long") for i in range(p)]
    tangent = [F.round(F.tanh(f"z{i}") * SCALE).cast("long") for i in range(p)]
    kinds = [F.struct(F.lit(k).alias("kind"), *(x.alias(f) for x, f in zip(xs, FEATURES, strict=True))) for k, xs in ((1, [F.col(f) for f in FEATURES]), (2, sign), (3, tangent))]
    each = near.select(*_KEY, "centre", "precision", F.explode(F.array(*kinds)).alias("x")).select(*_KEY, "centre", "precision", "x.*")
    summed = _sums(each.groupBy(*_KEY, "kind"), [F.first("centre").alias("centre"), F.first("precision").alias("precision")])
    # Dealt anew: what the tasks over all rows send to this aggregate grows with their number, so it stays in all partitions.
    summed = summed.repartition(_parts(3 * groups))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                scale = [1 / math.sqrt(row.precision[k]) for k in diagonal]
                centre, cov = start_estimates(int(row.n), _whole(row, _SUMS), _whole(row, _CROSS), row.kind, [float(x) for x in row.centre], scale)
                out.append(_estimate((row.k_lang, row.k_source, row.level), row.kind, centre, cov, known=False))
            yield pd.DataFrame(out, columns=_ESTIMATE.names)

    made = written(quartiles.unionByName(summed.mapInPandas(estimate, _ESTIMATE)), "quality-starts")
    forget(quartiles)
    return made


def _concentrate(rows: DataFrame, estimates: DataFrame, groups: int, share: float) -> DataFrame:
    """One concentration step of the estimates that move: each again from the nearest share of its group's rows, ties whole."""
    p = len(FEATURES)
    key = [*_KEY, "start"]
    near = _with_estimates(rows, estimates, groups).where("start is not null").withColumn("bin", F.least(F.floor(F.sqrt(_distance()) * 32), F.lit(BINS - 1)))
    bins = _sums(near.groupBy(*key, "bin"), [])
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("bin")) - F.col("n")
    total = F.sum("n").over(Window.partitionBy(*key))
    inside = bins.withColumn("_before", before).withColumn("_all", total).where(F.col("_before") < F.ceil(share * F.col("_all")))
    kept = inside.groupBy(*key).agg(F.sum("n").alias("n"), F.max("_all").alias("rows"), *[F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in [*_SUMS, *_CROSS]])

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                n, sums = int(row.n), _whole(row, _SUMS)
                cov = covariance(n, sums, _whole(row, _CROSS)) / consistency(n, int(row.rows), p)
                out.append(_estimate((row.k_lang, row.k_source, row.level), row.start, [x / n / SCALE for x in sums], cov))
            yield pd.DataFrame(out, columns=_ESTIMATE.names)

    return kept.coalesce(_parts(groups)).mapInPandas(estimate, _ESTIMATE)


def _stepped(rows: DataFrame, estimates: DataFrame, groups: int, share: float) -> DataFrame:
    """The estimates after a step; one whose determinant falls no further stays as it was, and rests."""
    names = [f"n_{c}" for c in _ESTIMATE.names]
    again = _concentrate(rows, estimates.where("moving"), groups, share).toDF(*names)
    both = estimates.join(again, _key_is([*_KEY, "start"], ["n_level", "n_k_lang", "n_k_source", "n_start"]), "left")
    better = F.coalesce(F.col("n_logdet") < F.col("logdet") - SETTLED, F.lit(False))
    pick_ = [F.when(better, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "precision", "verdict", "logdet")]
    return both.select("k_lang", "k_source", "level", "start", *pick_, better.alias("moving"))


def _best(estimates: DataFrame, most: int) -> DataFrame:
    """The starts of each group with the smallest determinants."""
    place = F.row_number().over(Window.partitionBy(*_KEY).orderBy("logdet", "start"))
    return estimates.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def estimates_of(rows: DataFrame, groups: int, share: float = SHARE) -> DataFrame:
    """The estimate of each group with the smallest determinant that the starts lead to."""
    now = _starts(rows, groups)
    step = 0
    while True:
        step += 1
        after = _stepped(rows, now, groups * 4, share)
        before, now = now, written((_best(after, BEST) if step == FIRST_STEPS else after).coalesce(_parts(groups * 4)), "quality-step")
        forget(before)
        if step >= FIRST_STEPS and now.where("moving").isEmpty():
            break
    best = written(_best(now, 1).coalesce(_parts(groups)), "quality-best")
    forget(now)
    return best


def _keyed(rows: DataFrame, min_group: int) -> tuple[DataFrame, int]:
    """rows with the key of the group that estimates them, and the number of groups."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < min_group, F.col("n")).otherwise(0)
    pool = F.sum(small).over(Window.partitionBy("lang"))
    level = F.when(F.col("n") >= min_group, 0).when(pool >= min_group, 1).otherwise(2)
    keys = sizes.withColumn("level", level).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "level",
        F.when(F.col("level") < 2, F.col("lang")).alias("k_lang"), F.when(F.col("level") < 1, F.col("source")).alias("k_source"),
    )
    keys = written(keys, "quality-keys")
    n = keys.count()
    right = F.broadcast(keys) if n <= BROADCAST_GROUPS else keys
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rows.join(right, on).drop("g_lang", "g_source"), n


def quality_rules(df: DataFrame, share: float = SHARE, min_group: int = MIN_GROUP, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, the counts, base_failed, the squared distance and kept, a row for each document."""
    counted = with_counts(pick(df, "doc_id", "text", "lang", "source"), keep=["doc_id", "lang", "source"])
    counted = counted.withColumn("lang", F.col("lang").cast("string")).withColumn("source", F.col("source").cast("string"))
    rows = written(counted.select("*", *_features()), "quality-counts")
    keyed, groups = _keyed(rows, min_group)
    worded = keyed.where(F.col("n_words") > 0).select(*_KEY, *FEATURES)
    estimates = estimates_of(worded, groups, share)
    n, r = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < 50) | (100 * r > 50 * n)
    within = F.coalesce(F.col("distance") <= chi2_quantile(quantile, len(FEATURES)), F.lit(False))
    return (
        _with_estimates(keyed, estimates, groups, "verdict")
        .withColumn("distance", F.when(n > 0, _distance()))
        .select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & within).alias("kept"), "distance")
    )
