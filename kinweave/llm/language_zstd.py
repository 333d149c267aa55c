"""Language identification by compression (operator 5).

Each language has a raw-content zstandard dictionary: pieces of its training
texts. A text is compressed with each dictionary, block by block, so that the
dictionary speaks for every part of a long text; the language with the smallest
total is the answer, and a text whose margin to the second is narrow is
rejected. Letters are lower-cased and everything else becomes a space before.

A dictionary is a bounded sample: training rows are dealt by the hash of their
id into ``slots``, and the row with the smallest hash in each slot gives a piece
of ``piece`` letters from its middle. No text is sent but these. Every training
row takes part, as each competes for its slot; a row that isn't chosen says
nothing that the 64 others of its language don't. All dictionaries together hold
``budget`` letters at most: with more languages than fit, each gets fewer slots,
then shorter pieces, and none is left out.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; null languages are not learned; without a language to learn all
texts are ``und``; of equal sizes the language first in order wins, with margin
0, and the text is rejected. A very long text is compressed whole, a block at a
time. Columns named like a result are replaced, others stay or go as ``keep``
says.
"""

from __future__ import annotations

import re

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, crc_mod, pick

SLOTS = 64
PIECE = 1500
BLOCK = 4096
LEVEL = 6
#: A text is rejected if the second smallest size exceeds the smallest by less than this share of it, or than so many bytes
#: (in a short text one byte is more than the share, and says nothing).
MARGIN = 0.01
MARGIN_BYTES = 2
#: Letters of all dictionaries together.
BUDGET = 400 * SLOTS * PIECE

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_ASCII = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else c if c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """Lower-case letters, runs of all else as one space each."""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split())
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Classifier:
    def __init__(self, samples: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.languages = sorted(samples)
        self.block = block
        made = [zstandard.ZstdCompressionDict(samples[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in self.languages]
        for d in made:
            d.precompute_compress(level=level)
        self.compressors = [zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in made]

    def sizes(self, text: str) -> list[int]:
        raw = letters(text)
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, rejected."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        if len(sizes) == 1:
            return self.languages[0], 1.0, False
        gap = sizes[order[1]] - best
        score = 1 / (1 + sum(float(np.exp(-min(60.0, 40.0 * (s - best) / max(best, 1)))) for i, s in enumerate(sizes) if i != order[0]))
        return self.languages[order[0]], score, bool(gap < max(MARGIN * best, MARGIN_BYTES))


def _shares(languages: int, slots: int, piece: int, budget: int) -> tuple[int, int]:
    """Slots and piece length such that the dictionaries of so many languages fit the budget."""
    each = max(1, budget // max(languages, 1))
    slots = max(1, min(slots, each // piece))
    return slots, min(piece, max(1, each // slots))


def learn(train: DataFrame, slots: int = SLOTS, piece: int = PIECE, budget: int = BUDGET) -> dict[str, bytes]:
    """A dictionary for each language of doc_id, text, lang. At most ``budget`` letters of all languages together reach the driver (a letter a language at least)."""
    rows = pick(train, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if slots * piece * (languages := rows.select("lang").distinct().count()) > budget:
        slots, piece = _shares(languages, slots, piece, budget)
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    slot = F.pmod(h, F.lit(slots))
    chosen = [(r["lang"], r["h"]) for r in rows.groupBy("lang", slot.alias("slot")).agg(F.min(h).alias("h")).select("lang", "h").collect()]
    if not chosen:
        return {}
    wanted = sorted({x for _, x in chosen})
    pairs = set(chosen)
    start = F.greatest(F.lit(1), F.floor((F.length("text") - piece) / 2).cast("int"))
    found = rows.withColumn("h", h).where(F.col("h").isin(wanted)).groupBy("lang", "h").agg(F.min(F.substring("text", start, F.lit(piece))).alias("part"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in found.collect():
        if (r["lang"], r["h"]) in pairs:
            parts.setdefault(r["lang"], []).append((r["h"], r["part"]))
    return {lang: b" ".join(letters(p) for _, p in sorted(own)) for lang, own in parts.items()}


def classify(df: DataFrame, samples: dict[str, bytes], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score, rejected; a narrow step. The dictionaries go along with the task (96 KB a language at most, by default)."""

    def make():
        classifier = Classifier({k: v for k, v in samples.items() if v})

        def compute(values: list) -> list[list]:
            return [list(c) for c in zip(*map(classifier.predict, values), strict=True)]

        return compute

    return append_columns(df, make, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())], text, keep)


def identify(df: DataFrame, keep: list[str] | None = None, held_out: int = 2, folds: int = 4, **more) -> DataFrame:
    """Predicts the language of all documents from those outside one fold of crc32(doc_id)."""
    train = pick(df, "doc_id", "text", "lang").where(crc_mod(F.col("doc_id"), folds) != held_out)
    return classify(df, learn(train, **more), keep)
