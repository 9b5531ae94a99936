"""Best-fit packing of tokenized documents into sequences of bounded length.

The plan is made on the histogram of piece lengths alone, which has no more entries
than a sequence has tokens. A configuration linear program (how many sequences hold
which lengths) is solved by multiplicative weights: a length gets cheaper as it gets
covered, and a knapsack dynamic program prices the next configuration. The solution is
rounded down, and what is left over is packed best-fit, longest first, into the room that
remains and into new sequences. Whole runs of equal sequences are handled as one, so the
plan has a bounded size however many documents there are.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import PLAIN_TEXT
from plumbline.llm.common import frugal_batches, table, written

ROOM = 4_096
END_ID = 1
ROUNDS = 1_000
GAP = 0.002
EAGERNESS = 0.2
#: Lengths of a room over this or less are left to best fit, and so many classes of longer ones are told apart.
SMALL, CLASSES = 16, 64
CACHED = 400_000


class Words:
    """Ids of a text by a ``tokenizers`` file whose pieces never hold a blank or line end.

    Words between blanks are looked up. New ones that are runs of letters are encoded many at
    a time, other new ones each by itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None}
        self.of_runs = Tokenizer.from_str(json.dumps(bare))  # for what is in its normal form already
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _alone(self, words: list[str]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = array("I", e.ids).tobytes()

    def _runs(self, words: list[str]) -> None:
        """Runs of letters in their normal form, each of which ends with the one end-of-word token in it."""
        parts = [words[i : i + 256] for i in range(0, len(words), 256)]
        for part, e in zip(parts, self.of_runs.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                self._alone(part)
                continue
            raw, at = ids.tobytes(), 0
            for word, stop in zip(part, (4 * stops).tolist(), strict=True):
                self.known[word] = raw[at:stop]
                at = stop

    def _learn(self, new: set[str]) -> None:
        known, older = self.known, self.older
        runs, alone = [], []
        for word in new:
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
            elif word.isalpha() and word.lower() == word and (word.isascii() or is_normalized("NFC", word)):
                runs.append(word)
            else:
                alone.append(word)
        self._alone(alone)
        self._runs(runs)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        if len(self.known) > CACHED:
            self.known, self.older = {"": b""}, self.known
        split = [apart(x).replace("\n", " ").split(" ") for x in texts]
        self._learn(set().union(*split) - self.known.keys())
        of = self.known.__getitem__
        return [b"".join(map(of, words)) for words in split]


#: A stop or comma that follows another sign is one piece with it.
TOUCHING = re.compile(r"[,.](?=[ \n]|$)(?<=(?:[^\w\s]|_)[,.])")


def apart(text: str) -> str:
    """The text with the same ids and fewer distinct words: in lower case, with stops and commas set off.

    Only where that is sure to change no id; other texts stay as they are.
    """
    if PLAIN_TEXT.fullmatch(text):
        text = text.lower()
        if not TOUCHING.search(text):
            for sign in ",.":
                text = text.replace(f"{sign} ", f" {sign} ").replace(f"{sign}\n", f" {sign}\n")
    return text


@lru_cache(maxsize=2)
def load(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): every document's ids and END_ID, cut
    where longer than ``room``. ``nth`` counts the pieces of a length within a partition."""
    end = np.asarray([END_ID], "<u4").tobytes()

    @frugal_batches
    def cut(batches):
        words, part, seen = load(path), TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out: list[tuple] = []
                rows = zip(some.column(0).to_pylist(), words.ids([x or "" for x in some.column(1).to_pylist()]), strict=True)
                for doc_id, ids in rows:
                    ids += end
                    for k, start in enumerate(range(0, len(ids) // 4, room)):
                        own = ids[4 * start : 4 * (start + room)]
                        n = len(own) // 4
                        out.append((doc_id, k, start, n, zlib.crc32(own), part, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def size_classes(histogram: dict[int, int], room: int) -> list[list[int]]:
    """The lengths that the program deals with, in classes: each is as long as its longest at most.

    Lengths of up to room // SMALL are left to best fit. With CLASSES lengths or fewer each is a
    class of its own, else runs of neighbouring lengths with about equal numbers of pieces are.
    """
    large = sorted(x for x in histogram if x > room // SMALL)
    if len(large) <= CLASSES:
        return [[x] for x in large]
    total, out, seen = sum(histogram[x] for x in large), [], 0
    for x in large:
        if not out or seen * CLASSES >= total * len(out):
            out.append([])
        out[-1].append(x)
        seen += histogram[x]
    return out


def knapsack(lengths: list[int], prices: np.ndarray, room: int) -> np.ndarray:
    """How often each length is in the configuration of the highest total price, by dynamic programming over the room.

    ``bits`` copies of a length at a time, so a length takes as many passes as its number has digits.
    """
    value, taken = np.zeros(room + 1), []
    for j, length in enumerate(lengths):
        most = room // length
        bits = 1
        while most > 0:
            n = min(bits, most)
            most, bits = most - n, bits * 2
            add = value[: room + 1 - n * length] + n * prices[j]
            better = np.zeros(room + 1, bool)
            better[n * length :] = add > value[n * length :] + 1e-15
            value[n * length :] = np.maximum(value[n * length :], add)
            taken.append((j, n, better))
    out, c = np.zeros(len(lengths), np.int64), room
    for j, n, better in reversed(taken):
        if better[c]:
            out[j] += n
            c -= n * lengths[j]
    return out


def configurations(lengths: list[int], asked: list[int], room: int, rounds: int = ROUNDS, gap: float = GAP) -> tuple[dict[tuple[int, ...], float], float]:
    """(configurations with how many sequences each has, lower bound): a fractional solution of
    the covering program, by multiplicative weights.

    Every length has a weight, and its price is the weight over the number asked for. A round
    takes the configuration that a knapsack finds dearest, by a step that covers its scarcest
    length, and each length's weight falls by a factor for the share that got covered. Prices over
    the value of the dearest configuration are a dual solution, so each round gives a bound; the
    rounds end when the steps, scaled so that all lengths are covered, are within ``gap`` of it.
    """
    asked_ = np.array(asked, float)
    weights = asked_ * lengths / (asked_ * lengths).sum()
    covered, bound = np.zeros(len(lengths)), 0.0
    steps: dict[tuple[int, ...], float] = {}
    for i in range(rounds):
        prices = weights / asked_
        config = knapsack(lengths, prices, room)
        bound = max(bound, weights.sum() / float(config @ prices))
        share = config / asked_
        step = 1 / share.max()
        steps[key] = steps.get(key := tuple(config.tolist()), 0.0) + step
        covered += step * share
        weights *= (1 - EAGERNESS) ** (step * share)
        weights /= weights.sum()
        if i % 16 == 15 and covered.min() > 0 and sum(steps.values()) / covered.min() <= (1 + gap) * bound:
            break
    # Scaled to the mean cover: what falls short goes to best fit, and what is over is not there to be placed.
    scale = len(lengths) / covered.sum()
    return {c: n * scale for c, n in steps.items()}, bound


class Rooms:
    """Groups of equal sequences by the room that is left; best fit takes the least that is enough."""

    def __init__(self, room: int) -> None:
        self.room = room
        self.free: list[tuple[int, int]] = []  # (room left, place in held)
        self.held: list[tuple[dict[int, int], int]] = []

    def add(self, config: dict[int, int], n: int) -> None:
        self.held.append((config, n))
        insort(self.free, (self.room - sum(x * k for x, k in config.items()), len(self.held) - 1))

    def place(self, length: int, n: int) -> None:
        """Best fit of ``n`` pieces of a length; a group splits where only a part of it is used."""
        while n:
            i = bisect_left(self.free, (length, -1))
            if i == len(self.free):
                each = self.room // length
                if n >= each:
                    self.add({length: each}, n // each)
                if n % each:
                    self.add({length: n % each}, 1)
                return
            free, at = self.free.pop(i)
            config, many = self.held[at]
            each = free // length
            used = min(many, n // each)
            if used:
                self.add({**config, length: config.get(length, 0) + each}, used)
            n, many = n - used * each, many - used
            if many and 0 < n < each:
                self.add({**config, length: config.get(length, 0) + n}, 1)
                n, many = 0, many - 1
            self.held[at] = (config, many)
            if many:
                insort(self.free, (free, at))

    def groups(self) -> list[tuple[dict[int, int], int]]:
        return [self.held[at] for _, at in self.free if self.held[at][1]]


def best_fit(histogram: dict[int, int], room: int, begun: Rooms | None = None) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest pieces first, into the sequences begun and into new ones."""
    rooms = begun or Rooms(room)
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rooms.place(length, histogram[length])
    return rooms.groups()


class Stock:
    """What is left of each length, and the lengths of which something is left, in order."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = {x: n for x, n in histogram.items() if n}
        self.lengths = sorted(self.left)

    def longest(self, limit: int, but: dict[int, int]) -> int:
        """The longest length of up to ``limit`` of which more is left than ``but`` holds; 0 if there is none."""
        i = bisect_right(self.lengths, limit) - 1
        while i >= 0 and self.left[self.lengths[i]] <= but.get(self.lengths[i], 0):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def take(self, one: dict[int, int], most: int) -> int:
        """Takes as many of ``one`` as there are, up to ``most``."""
        n = min([most, *(self.left[x] // k for x, k in one.items())])
        for x, k in one.items():
            self.left[x] -= n * k
            if not self.left[x]:
                del self.left[x]
                del self.lengths[bisect_left(self.lengths, x)]
        return n


def filled(classes: list[list[int]], config: tuple[int, ...], often: int, stock: Stock, room: int) -> list[tuple[dict[int, int], int]]:
    """Up to ``often`` sequences of a configuration of classes, out of what is in stock.

    Pieces of a class are shorter than it by something, so a sequence has its last piece, and
    whatever more goes in, chosen by the room that is left.
    """
    slots = [j for j, k in reversed(list(enumerate(config))) for _ in range(k)]
    out = []
    while often:
        one: dict[int, int] = {}
        free = room
        for j in slots[:-1]:
            x = stock.longest(min(classes[j][-1], free), one)
            if x < classes[j][0]:
                return out  # the class has been used up by others
            one[x] = one.get(x, 0) + 1
            free -= x
        while x := stock.longest(free, one):
            one[x] = one.get(x, 0) + 1
            free -= x
        if not one:
            break
        n = stock.take(one, often)
        out.append((one, n))
        often -= n
    return out


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[dict[int, int], int]]:
    """Groups of equal sequences: what one holds, and how many there are. Covers the histogram exactly.

    The configuration program rounded down, with best fit of the rest; or best fit of everything,
    should that take fewer sequences.
    """
    plain = best_fit(histogram, room)
    classes = size_classes(histogram, room)
    if not classes:
        return plain
    found, _ = configurations([c[-1] for c in classes], [sum(histogram[x] for x in c) for c in classes], room)
    stock, rooms = Stock(histogram), Rooms(room)
    for config, often in sorted(found.items(), key=lambda v: (-v[1], v[0])):
        for one, n in filled(classes, config, int(often + 1e-9), stock, room):
            rooms.add(one, n)
    programmed = best_fit(stock.left, room, rooms)
    return min(programmed, plain, key=lambda groups: sum(n for _, n in groups))


def runs(groups: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, how often a sequence holds it, offset of the first there)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for config, n in groups:
        offset = 0
        for length in sorted(config, reverse=True):
            k = config[length]
            first = taken.get(length, 0)
            out.setdefault(length, []).append((first, sequence, k, offset))
            taken[length] = first + n * k
            offset += k * length
        sequence += n
    return {x: np.array(v) for x, v in out.items()}


def packed(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A null text is empty, and an empty text is END_ID alone. Repeated rows are packed each;
    a null doc_id stays null; an empty table gives no rows; other columns are ignored. Equal
    lengths are told apart by partition and by order within it, so no length, however common,
    meets in one task; only the histogram of lengths reaches the driver.
    """
    own = written(pieces(docs, path, room), "pieces")
    counts = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = runs(plan(histogram, room))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = own.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                run = where[int(x)]
                own_run = run[np.searchsorted(run[:, 0], rank[at], side="right") - 1]
                copy, slot = np.divmod(rank[at] - own_run[:, 0], own_run[:, 2])
                sequence[at], offset[at] = own_run[:, 1] + copy, own_run[:, 3] + slot * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
