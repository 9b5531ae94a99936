"""Suffix-array dedup of byte strings that occur more than once.

Whether a byte goes depends on the strings of WIDTH bytes that start somewhere twice.
Each such string contains a smallest LEAD-byte piece (by hash), so it is enough to hold
the suffixes that start at those pieces: equal strings have them at equal places, and
one suffix stands for a stretch of neighbouring strings. Suffixes whose lead is unique
drop out, and equal stretches count as one with their number before they are dealt. What is
left goes by sampled splitters into ranges of suffixes; each range sorts by multikey
quicksort, and the bytes that neighbours in the order share, with those that stand before
the leads in an order of their own, decide which strings start twice. Suffixes of a lead
that may go on across a boundary are compared string by string in an aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import frugal_batches, mix, table, texts, written

WIDTH = 400
LEAD = 128
SLICE = 1 << 21
RANGE_ROWS = 32_768
BASE = 0x9E3779B97F4A7C15 | 1


class Rolling:
    """Hashes of all substrings of a slice, from running sums of byte * BASE^i modulo 2^64."""

    _power: np.ndarray | None = None
    _inverse: np.ndarray | None = None

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if Rolling._power is None or len(Rolling._power) < n:
            size = max(n, SLICE + WIDTH + 1)
            Rolling._power, Rolling._inverse = (_powers(b, size) for b in (BASE, pow(BASE, -1, 2**64)))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Rolling._power[: n - 1], out=self.sums[1:], dtype=np.uint64)

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * Rolling._inverse[:n]

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return (self.sums[starts + width] - self.sums[starts]) * Rolling._inverse[starts]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def stretches(data: np.ndarray, ends: np.ndarray, width: int, lead: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, start of the lead, hash of the lead, of the first and of the last string).

    ``ends`` has, for each byte, the end of its document; starts too near to it have no string.
    """
    if len(data) < width:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(3))
    rolling = Rolling(data)
    low = rolling.all(lead)
    low = (low ^ (low >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    digits = np.uint64(len(data).bit_length())
    low = ((low >> digits) << digits) | np.arange(len(low), dtype=np.uint64)
    span, have = width - lead + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    lead_at = (low & ((np.uint64(1) << digits) - np.uint64(1))).astype(np.int64)
    starts = np.flatnonzero(np.arange(len(lead_at)) + width <= ends[: len(lead_at)])
    lead_at = lead_at[starts]
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(3))
    new = np.append(True, (lead_at[1:] != lead_at[:-1]) | (starts[1:] != starts[:-1] + 1))
    at = np.flatnonzero(new)
    first, last, lead_at = starts[at], starts[np.append(at[1:], len(starts)) - 1], lead_at[at]
    return first, last, lead_at, mix(rolling.at(lead_at, lead)), mix(rolling.at(first, width)), mix(rolling.at(last, width))


def _slices(offsets: np.ndarray, width: int):
    """(first row, row after the last, first byte, byte after the last) of slices of bounded size.

    A document that is longer goes in parts, each with all bytes of the strings that start in it.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        begin, end = int(offsets[row]), int(offsets[to])
        if end - begin <= SLICE:
            yield row, to, begin, end
        else:
            for a in range(begin, end - width + 1, SLICE):
                yield row, to, a, min(end, a + SLICE + width - 1)
        row = to


STRETCH = "uid long, at long, lo int, hi int, lead long, head long, tail long"
STRETCH_NAMES = ["uid", "at", "lo", "hi", "lead", "head", "tail"]


def _stretches(docs: DataFrame, width: int, lead: int) -> DataFrame:
    """The stretches of all rows: lead starts at byte ``at``, strings begin ``lo`` before it at most and end ``hi`` after its end."""

    @frugal_batches
    def find(batches):
        for batch in batches:
            data, offsets, _ = texts(batch.column(1))
            uid = np.asarray(batch.column(0))
            for row, to, a, b in _slices(offsets, width):
                ends = np.repeat(np.minimum(offsets[row + 1 : to + 1], b) - a, np.diff(np.clip(offsets[row : to + 1], a, b)))
                first, last, at, *hashes = stretches(data[a:b], ends, width, lead)
                of = np.searchsorted(offsets, first + a, side="right") - 1
                columns = [uid[of], at + a - offsets[of], (at - first).astype(np.int32), (last + width - at - lead).astype(np.int32), *(h.view(np.int64) for h in hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], STRETCH_NAMES)

    return docs.select("uid", "text").mapInArrow(find, STRETCH)


SAME = ["lead", "head", "tail", "lo", "hi"]
REP = "lead long, head long, tail long, lo int, hi int, twice boolean, suffix binary, before binary"
REP_FIELDS = pa.schema([("lead", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("twice", pa.bool_()), ("suffix", pa.binary()), ("before", pa.binary())])


def _fetched(docs: DataFrame, classes: DataFrame, lead: int) -> DataFrame:
    """The bytes of each class of equal stretches, from one that is in it: from the lead on, and before it."""
    wanted = classes.select("one.uid", F.struct("one.at", *SAME, (F.col("n") > 1).alias("twice")).alias("w")).groupBy("uid").agg(F.collect_list("w").alias("wanted"))
    joined = docs.join(wanted, "uid").select("uid", "text", "wanted")

    @frugal_batches
    def fetch(batches):
        done: set[int] = set()  # rows that are equal in id and text share a uid
        for batch in batches:
            rows = []
            for uid, text, wanted_ in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if uid in done:
                    continue
                done.add(uid)
                raw = text.encode()
                for w in wanted_:
                    at = w.pop("at")
                    rows.append({**w, "suffix": raw[at : at + lead + w["hi"]], "before": raw[at - w["lo"] : at]})
            for i in range(0, len(rows), 8_192):
                yield pa.RecordBatch.from_pylist(rows[i : i + 8_192], REP_FIELDS)

    return joined.mapInArrow(fetch, REP)


def multikey_sort(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): strings by their first ``width`` bytes, and how many bytes each shares with the one before.

    Runs that are equal so far are sorted by their next 8-byte key, all of them at once. Strings
    that are shorter count as padded with zeros.
    """
    keys = -(-width // 8)
    raw = b"".join(s[:width].ljust(8 * keys, b"\0") for s in strings)
    flat = np.frombuffer(raw, ">u8").reshape(len(strings), keys)
    order, depth = np.arange(len(strings)), np.full(len(strings), keys)
    run = np.zeros(len(strings), np.int64)  # equal numbers stand for one run
    open_ = np.arange(len(strings))  # places that are in a run of two or more
    for k in range(keys):
        if not len(open_):
            break
        key = flat[order[open_], k].astype(np.uint64)
        by = np.lexsort((key, run[open_]))
        order[open_], key = order[open_][by], key[by]
        same_run = np.append(False, run[open_][1:] == run[open_][:-1])
        same = same_run & np.append(False, key[1:] == key[:-1])
        depth[open_[same_run & ~same]] = k
        if k == 0:
            depth[0] = 0
        else:
            depth[open_[~same_run]] = np.minimum(depth[open_[~same_run]], k)
        run[open_] = np.cumsum(~same) + int(run.max()) + 1
        open_ = open_[same | np.append(same[1:], False)]
    # The key in which neighbours part tells the byte.
    shared = 8 * depth
    part = np.flatnonzero(depth < keys)[1:]
    if len(part):
        octets = np.frombuffer(raw, np.uint8).reshape(len(strings), keys, 8)
        here, there = (octets[order[part - back], depth[part]] for back in (0, 1))
        shared[part] += (here != there).argmax(axis=1)
    if len(strings):
        shared[0] = 0
    return order, shared


def repeated_offsets(shared: np.ndarray, before: list[bytes], lo: np.ndarray, hi: np.ndarray, twice: np.ndarray, width: int, lead: int):
    """Yields (member, first offset, last offset): strings that begin that far before the lead and start twice.

    Members come in the order of their suffixes, of which neighbours share ``shared`` bytes. Those
    that share enough form a run; so do members whose bytes before the lead share enough, in the
    order of those bytes read backwards. Two members have a string in common if they meet in
    both.
    """
    room = width - lead
    n = len(lo)
    back, back_shared = multikey_sort([x[::-1] for x in before], room)
    place = np.empty(n, np.int64)
    place[back] = np.arange(n)
    hits = np.zeros((n, room + 1), bool)
    for o in range(room + 1):
        can = np.flatnonzero((lo >= o) & (hi >= room - o))
        if not len(can):
            continue
        right = np.cumsum(shared < width - o)[can]
        left = np.cumsum(back_shared < o)[place[can]] if o else np.zeros(len(can), np.int64)
        _, which, count = np.unique(right * (n + 1) + left, return_inverse=True, return_counts=True)
        hits[can, o] = (count[which] > 1) | twice[can]
    edge = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    a, b = np.nonzero(edge == 1), np.nonzero(edge == -1)
    yield from zip(a[0].tolist(), a[1].tolist(), (b[1] - 1).tolist(), strict=True)


FOUND = "lead long, head long, tail long, lo int, hi int, begin int, stop int, open boolean, twice boolean, suffix binary, before binary"
FOUND_FIELDS = pa.schema([("lead", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("begin", pa.int32()), ("stop", pa.int32()), ("open", pa.bool_()), ("twice", pa.bool_()), ("suffix", pa.binary()), ("before", pa.binary())])


def _compared(reps: DataFrame, width: int, lead: int) -> DataFrame:
    """(class, begin, stop): the repeated strings of each class, counted from the lead on.

    Spark samples splitters and deals the suffixes by ranges of leads, so that a lead has its
    suffixes in one range. Leads of more than RANGE_ROWS suffixes are dealt by the whole suffix, and
    by what stands before it where that is equal too; so no range grows with a common passage.
    """
    # No more rows than one for each RANGE_ROWS suffixes.
    large = written(reps.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > RANGE_ROWS).select("lead"), "suffix-large")
    ranges = max(1, -(-reps.count() // RANGE_ROWS))
    found = _sorted(reps.join(large, "lead", "left_anti").repartitionByRange(ranges, F.substring("suffix", 1, lead)), width, lead, False)
    if large.isEmpty():
        return found.select(*SAME, "begin", "stop")
    split = written(_sorted(reps.join(large, "lead", "left_semi").repartitionByRange(ranges, "suffix", "before"), width, lead, ranges > 1), "suffix-ranges")
    spans = found.unionAll(split.where(~F.col("open"))).select(*SAME, "begin", "stop")
    return spans.unionAll(_across(split.where("open"), width, lead))


def _sorted(dealt: DataFrame, width: int, lead: int, split: bool) -> DataFrame:
    """What the order of each range decides. Where leads are ``split``, the first and the last of a range may go on in a neighbour, and stay open."""

    @frugal_batches
    def compare(batches):
        t = pa.Table.from_batches(list(batches), REP_FIELDS)
        if not t.num_rows:
            return
        strings = t.column("suffix").to_pylist()
        order, shared = multikey_sort(strings, width)
        t = t.take(pa.array(order))
        strings = t.column("suffix").to_pylist()
        before = t.column("before").to_pylist()
        lo, hi, twice = (t.column(c).to_numpy() for c in ("lo", "hi", "twice"))
        number = np.cumsum(shared < lead) - 1  # of the lead, in order
        goes_on = (number == 0) | (number == number[-1]) if split else np.zeros(len(number), bool)
        local, rows = np.flatnonzero(~goes_on), []
        names = {c: t.column(c).to_numpy() for c in ("lead", "head", "tail")}

        def row(i, begin, stop, open_):
            return {**{c: int(v[i]) for c, v in names.items()}, "lo": int(lo[i]), "hi": int(hi[i]), "begin": begin, "stop": stop, "open": open_, "twice": bool(twice[i]), "suffix": strings[i] if open_ else None, "before": before[i] if open_ else None}

        cut = 0
        while cut < len(local):
            end = min(cut + 12_288, len(local))
            while end < len(local) and number[local[end]] == number[local[end - 1]]:
                end += 1
            part = local[cut:end]
            depth = shared[part].copy()
            depth[0] = 0
            for i, o1, o2 in repeated_offsets(depth, [before[j] for j in part], lo[part], hi[part], twice[part], width, lead):
                rows.append(row(part[i], -o2, width - o1, False))
            cut = end
        rows += [row(i, None, None, True) for i in np.flatnonzero(goes_on).tolist()]
        for i in range(0, len(rows), 4_096):
            yield pa.RecordBatch.from_pylist(rows[i : i + 4_096], FOUND_FIELDS)

    return dealt.select(*REP_FIELDS.names).mapInArrow(compare, FOUND)


def _across(open_: DataFrame, width: int, lead: int) -> DataFrame:
    """The strings of leads that may lie across a boundary, however many there are, counted one by one."""

    def strings(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(row["before"] + row["suffix"], np.uint8)
                starts = np.arange(len(raw) - width + 1)
                own = mix(Rolling(raw).at(starts, width)).view(np.int64)
                n = len(starts)
                columns = [pa.array(np.full(n, row[c])) for c in ("lead", "head", "tail")]
                columns += [pa.array(np.full(n, row[c], np.int32)) for c in ("lo", "hi")]
                columns += [pa.array((starts - row["lo"]).astype(np.int32)), pa.array(np.full(n, 2 if row["twice"] else 1, np.int64)), pa.array(own)]
                yield pa.RecordBatch.from_arrays(columns, [*SAME, "begin", "often", "string"])

    each = written(open_.select(*SAME, "twice", "suffix", "before").mapInArrow(strings, "lead long, head long, tail long, lo int, hi int, begin int, often long, string long"), "suffix-strings")
    again = written(each.groupBy("string").agg(F.sum("often").alias("total")).where(F.col("total") > 1).select("string"), "suffix-twice")
    return each.join(again, "string", "left_semi").select(*SAME, "begin", (F.col("begin") + width).alias("stop"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, lead: int = LEAD) -> DataFrame:
    """(uid, begin, stop) that together cover each byte of a repeated string of ``docs`` (uid, text)."""
    every = _stretches(docs, width, lead)
    # Written, so that the join has an exchange of its own on either side and a common lead can be split.
    shared = written(every.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("lead"), "suffix-leads")
    some = written(every.join(shared, "lead", "left_semi").select(*STRETCH_NAMES), "suffix-stretches")
    classes = written(some.groupBy(*SAME).agg(F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("one")), "suffix-classes")
    found = _compared(written(_fetched(docs, classes, lead), "suffix-texts"), width, lead)
    spans = written(found.groupBy(*SAME).agg(F.collect_set(F.struct("begin", "stop")).alias("spans")), "suffix-spans")
    return some.join(spans, SAME).select("uid", "at", F.explode("spans").alias("s")).select("uid", (F.col("at") + F.col("s.begin")).alias("begin"), (F.col("at") + F.col("s.stop")).alias("stop"))


def without_repeats(docs: DataFrame, width: int = WIDTH, lead: int = LEAD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every row's bytes without those that a repeated string covers.

    A string of ``width`` bytes is repeated if it starts anywhere else too, in another row or the
    same, overlaps included; strings never cross rows and are judged on the input. Spans are the
    maximal removed runs. A null text is empty; texts shorter than ``width`` keep all; repeated
    rows repeat each other's strings; rows without doc_id take part; an empty table gives no rows;
    other columns are ignored. Strings are compared by their bytes; copies of a stretch, and strings
    of leads at the boundary of a range, by 64-bit hashes.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("uid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(own.select("uid", "text"), width, lead).groupBy("uid").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    joined = own.join(spans, "uid", "left").select("doc_id", "text", "spans")

    @frugal_batches
    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, merged = text.encode(), []
                for a, b in sorted((s["begin"], s["stop"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                out.append({"doc_id": doc_id, "n_bytes": len(raw), "spans": [{"begin": a, "stop": b} for a, b in merged], "kept": b"".join([*kept, raw[at:]])})
            for i in range(0, len(out), 1_024):
                yield pa.RecordBatch.from_pylist(out[i : i + 1_024], KEPT)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<begin:long,stop:long>>, kept binary")


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["begin"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

