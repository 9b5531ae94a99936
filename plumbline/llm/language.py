"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1. An n-gram is the product (binding) of
its letters' vectors, each rotated (permuted) by its place; a text is the sum (bundle)
of its n-grams. A language's prototype is the bundle of all its training texts, less
what all languages share; texts go to the prototype of the largest cosine.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import FOLDS, held_out, table

WIDTH = 1024
SEED = 20_011
#: Letters whose vectors a task holds at a time.
LETTERS = 65_536
MASK = (1 << 21) - 1
SHARPNESS = 12.0
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letter_vector(letter: int, width: int = WIDTH) -> np.ndarray:
    """The vector of a code point, drawn from a seed of its own; 0 stands for a gap between words."""
    return np.random.default_rng([SEED, letter]).integers(0, 2, width, np.int8) * np.int8(2) - np.int8(1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the letters of a whole text (words set off by gaps), 21 bits a letter, and how often each occurs."""
    letters = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, letters)):  # number signs are no letters
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes == 32, 0, codes)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


class Space:
    """Binds letters into trigrams: permuted by two places, by one, and as they are."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.place: dict[int, int] = {}  # of the letters known
        self.known = np.empty((3, 0, width), np.int8)  # as they are, permuted by one, by two

    def _places(self, letters: np.ndarray) -> np.ndarray:
        if len(self.place) > LETTERS:  # vectors are drawn again when they are needed
            self.place, self.known = {}, np.empty((3, 0, self.width), np.int8)
        own, of = np.unique(letters, return_inverse=True)
        if new := [x for x in own.tolist() if x not in self.place]:
            drawn = np.array([letter_vector(x, self.width) for x in new])
            self.place.update(zip(new, range(self.known.shape[1], self.known.shape[1] + len(new)), strict=True))
            self.known = np.concatenate([self.known, [np.roll(drawn, i, axis=1) for i in range(3)]], axis=1)
        return np.array([self.place[x] for x in own.tolist()], np.int64)[of]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.width)
        for at in range(0, len(codes), 4_096):
            c = codes[at : at + 4_096]
            places = self._places(np.concatenate([c >> 42, c >> 21 & MASK, c & MASK])).reshape(3, len(c))
            bound = self.known[2][places[0]] * self.known[1][places[1]] * self.known[0][places[2]]
            total += counts[at : at + 4_096].astype(np.float32) @ bound.astype(np.float32)
        return total


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the training rows: sums of a partition first, then of all."""

    def count(batches):
        held: dict[str, dict[int, int]] = {}
        size = 0

        def rows():
            for lang, of in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of)), pa.array(list(of), pa.int64()), pa.array(list(of.values()), pa.int64())], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = held.setdefault(lang, {})
                size -= len(of)
                for g, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                    of[g] = of.get(g, 0) + n
                size += len(of)
                if size > 1_000_000:
                    yield from rows()
                    size = 0
        yield from rows()

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(docs: DataFrame, width: int = WIDTH) -> dict[str, np.ndarray]:
    """A unit vector for each learned language. Bundles of a partition's grams are summed
    by place, so width numbers for each language reach the driver."""

    def bundles(batches):
        space, held = Space(width), {}
        for batch in batches:
            lang, gram, n = (np.asarray(batch.column(i).to_pylist(), kind) for i, kind in enumerate((object, np.int64, np.int64)))
            for x in sorted(set(lang.tolist())):
                held[x] = held.get(x, 0) + space.bundle(gram[lang == x], n[lang == x])
        for x, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * width), pa.array(range(width), pa.int32()), pa.array(np.rint(v).astype(np.int64))], ["lang", "i", "v"])

    parts = gram_counts(docs).mapInArrow(bundles, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in parts.collect():
        out.setdefault(r.lang, np.zeros(width))[r.i] = r.v
    unit = {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(out.items())}
    if len(unit) > 1:
        shared = np.mean(list(unit.values()), axis=0)
        unit = {k: (x := v - shared) / (np.linalg.norm(x) or 1.0) for k, v in unit.items()}
    return unit


def identify(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    Learns from the text and non-null lang of the rows that are not held out, and from
    nothing else of them. Null texts and texts without a letter are ``und`` with score 0,
    as is everything where nothing could be learned. Equal cosines go to the language that
    sorts first. Repeated rows are predicted each; a null doc_id counts as held out; other
    columns are ignored. ``score`` is a softmax of the cosines.
    """
    learned = prototypes(docs, width)
    names, matrix = list(learned), np.array(list(learned.values()) or np.zeros((0, width)))

    def predict(batches):
        space = Space(width)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(2).to_pylist():
                codes, counts = grams(text or "")
                if not len(codes) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                v = space.bundle(codes, counts)
                cosine = matrix @ v / (np.linalg.norm(v) or 1.0)
                best = int(cosine.argmax())
                langs.append(names[best])
                scores.append(float(1 / np.exp(SHARPNESS * (cosine - cosine[best])).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
