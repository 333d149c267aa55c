"""Toxicity by a factorization machine over hashed terms (operator 4).

A text's terms are its lower-cased words, the words' first four and six letters,
and the first four letters that REPEATS of its words begin with; each is hashed
to one of ``2**bits`` buckets, and a text has a bucket or it hasn't. The score is
the logistic function of a bias, a weight for each bucket and, for each two
buckets of the text, the product of their factor vectors: an insult counts more
next to a group's name than alone. The sum over pairs takes one pass,
(|sum v|^2 - sum |v|^2) / 2.

Learning: the buckets of all labelled training rows are counted, a task adding
up its own rows first (at most ``2**bits`` sums); the ``n_terms`` buckets that
tell the labels apart best are features. No text is shuffled: up to
BROADCAST_LABELS labels are broadcast, beyond that the texts' buckets are joined
to them. The machine is fitted on the driver to the feature lists of the
``max_rows`` rows with the smallest hash, in PASSES row visits at most; a feature
that fewer than RARE of those rows have gets its weight from all rows' counts.

A term that tells nothing alone may tell a lot next to another. So the residuals
of that fit are summed over the rows of the sample that hold two terms, for each
two of the features and the ``pair_terms`` commonest other buckets; both terms of
a pair whose sum is PAIR_STRENGTH deviations off zero become features too, and
the machine is fitted again. Rows with equal terms and label count once there.

Defined results: a null, empty or wordless text scores as the bias does; with no
training rows, or only one label among them, every text scores the share of
toxic training rows (0 without any); a label that is neither 0 nor 1 is left
out; of several labels of an id each counts. A very long text is read whole, as
any other; its terms are a set. A column named score or predicted is replaced,
other columns stay or go as ``keep`` says.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, crc_mod, forget, pick, texts, written

BITS = 18
N_TERMS = 4096
MAX_ROWS = 30_000
FACTORS = 8
EPOCHS = 150
#: Row visits: a sample of over PASSES / EPOCHS rows is gone through fewer times.
PASSES = 900_000
RATE = 0.5
WEIGHT_DECAY = 1e-6
THRESHOLD = 0.7
SEED = 7
WORD_CACHE = 150_000
#: A bucket is a feature if its toxic rows are this many standard deviations off their expected number,
#: or REACHED of what a bucket would be that all toxic rows and no others have, if that is less.
MIN_STRENGTH = 4.0
REACHED = 0.75
#: A word's beginning is a term of its own for each of these numbers that it begins as many words of the text.
REPEATS = (2, 3, 5)
#: Buckets besides the features of which pairs are looked at, the rows that they need at least, and the least strength of a pair.
PAIR_TERMS = 512
PAIR_ROWS = 20
PAIR_STRENGTH = 7.0
PAIRS = 256
#: Rows of the sample below which a feature's weight is its log odds over all rows.
RARE = 5
#: So many labels are broadcast at most.
BROADCAST_LABELS = 2_000_000

_WORD = re.compile(r"[^\W\d_]+")


def _bucket(name: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(name) & ((1 << bits) - 1)


class Terms:
    """Sorted features of texts; ``feature`` numbers the buckets (all, if it is None).

    Words are without number, their beginnings are few, so the features of a
    beginning are kept apart from those of words, and words without a feature are
    kept as a set that is taken off a text's words at once.
    """

    def __init__(self, bits: int, feature: dict[int, int] | None = None):
        self.bits, self.feature = bits, feature
        self.words: dict[str, tuple] = {}
        self.dull: set[str] = set()
        self.starts: dict[str, tuple] = {}

    def _of(self, *names: str) -> tuple[int, ...]:
        buckets = [_bucket(x, self.bits) for x in names]
        return tuple(buckets) if self.feature is None else tuple(self.feature[b] for b in buckets if b in self.feature)

    def _of_start(self, start: str) -> tuple:
        """The features of a beginning, and for each of REPEATS that of its being repeated (None if none of them is wanted)."""
        if len(self.starts) >= WORD_CACHE:
            self.starts.clear()
        repeated = tuple(self._of(f"{k}^{start}") for k in REPEATS) if len(start) <= 4 else ()
        got = self.starts[start] = self._of("^" + start), repeated if any(repeated) else None
        return got

    def _of_word(self, word: str) -> tuple:
        """The word's features, its beginning and that beginning's repeats."""
        start = word[:4]
        own, repeated = self.starts.get(start) or self._of_start(start)
        own = self._of(word) + own
        if len(word) > 6:
            own += (self.starts.get(word[:6]) or self._of_start(word[:6]))[0]
        if len(self.words) + len(self.dull) >= WORD_CACHE:
            self.words.clear()
            self.dull.clear()
        got = own, start, repeated
        if len(word) <= 64:
            if own or repeated:
                self.words[word] = got
            else:
                self.dull.add(word)
        return got

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, found = self.words, set()
        times: dict[str, int] = {}
        words = Counter(_WORD.findall(text.lower()))
        for w in words.keys() - self.dull:
            own, start, repeated = known.get(w) or self._of_word(w)
            if own:
                found.update(own)
            if repeated:
                times[start] = times.get(start, 0) + words[w]
        for start, n in times.items():
            if n >= REPEATS[0]:
                for k, own in zip(REPEATS, (self.starts.get(start) or self._of_start(start))[1], strict=True):
                    if n >= k:
                        found.update(own)
        return sorted(found)


@dataclass
class Model:
    bits: int
    buckets: list[int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, features: list[int]) -> float:
        at = np.array(features, np.int64)
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * float(np.square(v.sum(0)).sum() - np.square(v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@dataclass
class Rows:
    """Feature lists, one behind another."""

    counts: np.ndarray
    flat: np.ndarray

    @staticmethod
    def of(lists: list[list[int]]) -> Rows:
        counts = np.array([len(r) for r in lists], np.int64)
        return Rows(counts, np.array([f for r in lists for f in r], np.int64))

    def __len__(self) -> int:
        return len(self.counts)

    def only(self, place: np.ndarray) -> Rows:
        """The features whose place is 0 or over, by their places."""
        at = place[self.flat]
        owner = np.repeat(np.arange(len(self)), self.counts)
        return Rows(np.bincount(owner[at >= 0], minlength=len(self)), at[at >= 0])

    def pick(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number in ``which``, and feature, of all features of these rows."""
        k = self.counts[which]
        starts = (np.cumsum(self.counts) - self.counts)[which]
        return np.repeat(np.arange(len(which)), k), self.flat[np.repeat(starts - (np.cumsum(k) - k), k) + np.arange(k.sum())]


def predicted(rows: Rows, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores of feature lists."""
    out = np.zeros(len(rows))
    for low in range(0, len(rows), 1024):
        which = np.arange(low, min(low + 1024, len(rows)))
        owner, at = rows.pick(which)
        sums = _sums(owner, v[at], len(which))
        out[which] = bias + np.bincount(owner, w[at], len(which)) + 0.5 * (np.square(sums).sum(1) - np.bincount(owner, np.square(v[at]).sum(1), len(which)))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def pair_features(rows: Rows, labels: np.ndarray, scores: np.ndarray, n: int, old: int, least: float = PAIR_STRENGTH, most: int = PAIRS) -> list[int]:
    """Terms of 0..n-1 that belong to a strong pair of which one is ``old`` or over.

    A pair's strength is the sum of the residuals of the rows that hold both, in
    standard deviations of that sum. Rows alike count once.
    """
    ends = np.cumsum(rows.counts)
    once: dict[tuple, int] = {}
    for i, (end, k) in enumerate(zip(ends.tolist(), rows.counts.tolist(), strict=True)):
        once.setdefault((labels[i], xxhash.xxh3_128_digest(rows.flat[end - k : end].tobytes())), i)
    some = np.array(sorted(once.values()), np.int64)
    off, spread = np.zeros((n - old, n), np.float32), np.zeros((n - old, n), np.float32)
    for low in range(0, len(some), 1024):
        own = some[low : low + 1024]
        x = np.zeros((len(own), n), np.float32)
        x[rows.pick(own)] = 1
        p = scores[own]
        off += (x[:, old:] * (labels[own] - p).astype(np.float32)[:, None]).T @ x
        spread += (x[:, old:] * (p * (1 - p)).astype(np.float32)[:, None]).T @ x
    np.add(spread, 1, out=spread)
    strength = np.abs(off, out=off) / np.sqrt(spread, out=spread)
    strength[:, old:] = np.triu(strength[:, old:], 1)
    a, b = np.nonzero(strength >= least)
    best = np.argsort(-strength[a, b], kind="stable")[:most]
    return sorted({*(a[best] + old).tolist(), *b[best].tolist()})


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by owner."""
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], 1)


def fit(rows: Rows, labels: np.ndarray, n: int, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = RATE, decay: float = WEIGHT_DECAY, seed: int = SEED) -> tuple[float, np.ndarray, np.ndarray]:
    """Minibatch AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    positive = labels.mean()
    bias, w, v = float(np.log(positive / (1 - positive))), np.zeros(n), rng.normal(0, 0.02, (n, factors))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
    size = max(16, min(256, len(rows) // 16))
    for _ in range(max(1, min(epochs, PASSES // len(rows)))):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), size):
            batch = order[low : low + size]
            owner, at = rows.pick(batch)
            own = v[at]
            sums = _sums(owner, own, len(batch))
            z = bias + np.bincount(owner, w[at], len(batch)) + 0.5 * (np.square(sums).sum(1) - np.bincount(owner, np.square(own).sum(1), len(batch)))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            used, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, error[owner], len(used)) + decay * w[used]
            dv = _sums(place, error[owner, None] * (sums[owner] - own), len(used)) + decay * v[used]
            gb += error.sum() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            bias -= rate * error.sum() / np.sqrt(gb)
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
    return bias, w, v


def _hashed_terms(df: DataFrame, bits: int, feature: dict[int, int] | None, keep: list[str]) -> DataFrame:
    def make() -> Callable[[list], list[list]]:
        terms = Terms(bits, feature)
        return lambda values: [[terms.of(v) for v in values]]

    return append_columns(df, make, [("terms", T.ArrayType(T.IntegerType()))], keep=keep)


def _bucket_counts(hashed: DataFrame, bits: int) -> DataFrame:
    """bucket, rows, toxic: a task adds up its own rows first, in two arrays."""

    def run(batches):
        every, toxic = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            own = np.diff(batch.column(1).offsets.to_numpy())
            at = batch.column(1).flatten().to_numpy()
            every += np.bincount(at, minlength=1 << bits)
            toxic += np.bincount(at[np.repeat(batch.column(0).to_numpy() == 1, own)], minlength=1 << bits)
        used = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(every[used]), pa.array(toxic[used])], ["bucket", "n", "n_toxic"])

    source = hashed.select(F.col("toxic").cast("int").alias("toxic"), "terms")
    return source.mapInArrow(run, "bucket long, n long, n_toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def labelled_terms(df: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, bits: int = BITS) -> DataFrame:
    """doc_id, toxic, terms (buckets) of all labelled documents outside one fold of crc32(doc_id), written once."""
    rows = pick(labels, "doc_id", "toxic").where((crc_mod(F.col("doc_id"), folds) != held_out) & F.col("toxic").isin(0, 1))
    if rows.count() <= BROADCAST_LABELS:
        found = _hashed_terms(texts(df).join(F.broadcast(rows), "doc_id"), bits, None, ["doc_id", "toxic"])
    else:
        found = _hashed_terms(texts(df), bits, None, ["doc_id"]).join(rows, "doc_id")
    return written(found.select("doc_id", "toxic", "terms"), "labelled")


def train(labelled: DataFrame, bits: int = BITS, **more) -> Model:
    """A model from doc_id, text, toxic (0 or 1)."""
    rows = pick(labelled, "doc_id", "text", "toxic").where(F.col("toxic").isin(0, 1))
    return learn(_hashed_terms(rows, bits, None, ["doc_id", "toxic"]), bits, **more)


def learn(hashed: DataFrame, bits: int = BITS, n_terms: int = N_TERMS, max_rows: int = MAX_ROWS, pair_terms: int = PAIR_TERMS, **more) -> Model:
    """A model from doc_id, toxic, terms: features by all rows, fitted to max_rows of them."""
    total = hashed.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, n_toxic = int(total[0]), int(total[1] or 0)
    if not 0 < n_toxic < n:
        p = np.clip(n_toxic / max(n, 1), 1e-9, 1 - 1e-9)
        return Model(bits, [], float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)))
    a, b = F.col("n_toxic").cast("double"), F.col("n").cast("double")
    share = n_toxic / n
    # Signed root of the score statistic: how far the toxic rows of a bucket are from their expected number.
    strength = F.abs(a - b * share) / F.sqrt(b * share * (1 - share) + 1)
    least = min(MIN_STRENGTH, REACHED * n_toxic * (1 - share) / float(np.sqrt(n_toxic * share * (1 - share) + 1)))
    every = written(_bucket_counts(hashed, bits).withColumn("strength", strength), "buckets")
    strong = every.where(F.col("strength") >= least).orderBy(F.col("strength").desc(), "bucket").limit(n_terms).collect()
    known = {r["bucket"] for r in strong}
    # Strong buckets can be among the commonest, so as many more are asked for.
    common = every.where(F.col("n") >= PAIR_ROWS).orderBy(F.col("n").desc(), "bucket").limit(pair_terms + len(known)).collect()
    forget(every)
    counts = [(r["bucket"], r["n"], r["n_toxic"]) for r in sorted(strong)]
    counts += [(r["bucket"], r["n"], r["n_toxic"]) for r in sorted([r for r in common if r["bucket"] not in known][:pair_terms])]
    place = np.full(1 << bits, -1, np.int32)
    place[[c[0] for c in counts]] = np.arange(len(counts))
    rows, labels = _sampled(hashed, n, max_rows, [c[0] for c in counts])
    rows = rows.only(place)
    prior = float(np.log(share / (1 - share)))
    chosen = list(range(len(strong)))
    if len(set(labels.tolist())) < 2:  # a sample of one label: all weights come from the counts
        lists, bias, w, v = Rows.of([]), prior, np.zeros(len(chosen)), np.zeros((len(chosen), FACTORS))
    else:
        own = np.arange(len(counts))
        lists = rows.only(np.where(own < len(strong), own, -1))
        bias, w, v = fit(lists, labels, len(chosen), **more)
        paired = pair_features(rows, labels, predicted(lists, bias, w, v), len(counts), len(chosen))
        if any(f >= len(strong) for f in paired):
            chosen += [f for f in paired if f >= len(strong)]
            own = np.full(len(counts), -1)
            own[chosen] = np.arange(len(chosen))
            lists = rows.only(own)
            bias, w, v = fit(lists, labels, len(chosen), **more)
    if len(lists) < n:
        every_n, toxic = (np.array([counts[f][k] for f in chosen], float) for k in (1, 2))
        rare = np.bincount(lists.flat, minlength=len(chosen)) < RARE
        odds = np.log((toxic + 0.5) / (every_n - toxic + 0.5)) - prior
        w[rare], v[rare] = odds[rare], 0
    return Model(bits, [counts[f][0] for f in chosen], bias, w, v)


def _sampled(hashed: DataFrame, n: int, max_rows: int, buckets: list[int]) -> tuple[Rows, np.ndarray]:
    """Terms among buckets, and labels, of the max_rows rows with the smallest hash, in the order of ids, not of partitions: the fit depends on it."""
    kept = F.array_intersect("terms", F.array(*map(F.lit, buckets)).cast("array<int>"))
    place = F.pmod(F.xxhash64("doc_id", "terms"), F.lit(1 << 31))
    rows = hashed.select("doc_id", "toxic", place.alias("place"), kept.alias("terms"))
    if n > max_rows:
        # Only a few more rows than are wanted are sorted.
        rows = rows.where(F.col("place") < int(min(1.0, (1.2 * max_rows + 100) / n) * (1 << 31)))
        rows = rows.orderBy("place", "doc_id", "toxic", "terms").limit(max_rows)
    got = rows.select("doc_id", "toxic", F.xxhash64("terms").alias("h"), "terms").toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[("doc_id", "ascending"), ("toxic", "ascending"), ("h", "ascending")]))
    terms = got.column("terms").combine_chunks()
    lists = Rows(pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(terms).to_numpy(zero_copy_only=False))
    return lists, got.column("toxic").to_numpy().astype(float)


def score(df: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds score and predicted; a narrow step. The model (under 1 MB at the default bounds) goes along with the task."""
    bits, buckets, bias, w, v = model.bits, model.buckets, model.bias, model.weights, model.factors

    def make():
        own = Model(bits, buckets, bias, w, v)
        terms = Terms(bits, {b: i for i, b in enumerate(buckets)})

        def compute(values: list) -> list[list]:
            got = [own.score(terms.of(t)) for t in values]
            return [got, [int(s >= threshold) for s in got]]

        return compute

    return append_columns(df, make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], text, keep)


def toxicity(df: DataFrame, labels: DataFrame, keep: list[str] | None = None, held_out: int = 1, folds: int = 3, max_rows: int = MAX_ROWS, **more) -> DataFrame:
    """Scores documents by a model of their labelled rows, but for those of one fold of crc32(doc_id)."""
    labelled = labelled_terms(df, labels, held_out, folds, more.get("bits", BITS))
    model = learn(labelled, max_rows=max_rows, **more)
    forget(labelled)
    return score(df, model, keep)
