"""N-gram Jaccard join: every pair of documents whose shingle sets are alike enough.

Equal sets become one. Only a shingle that two sets share can count, so the shingles are
dealt by range, and those of a single set drop out; a set that keeps too few of its
shingles has no partner and drops out too. The rest order their shingles by how many sets
hold them; sets that are alike share one of their rarest, which gives clusters outside of
which no pair exists. Within a cluster a T-occurrence search over inverted lists finds the
partners of each set: short lists are merged by a heap that skips ahead, the longest ones
are only probed by binary search (DivideSkip).
"""

from __future__ import annotations

import functools
import heapq
import math
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import frugal_batches, frugal_frame, mix, runs, setting, table, written
from plumbline.llm.components import components
from plumbline.llm.shingles import document_sets, set_id

WORDS = 5
LIKE = (4, 5)
BUCKET_BYTES = 8 << 20
CHUNK = 2_000_000
HOT = 65_536
#: Sets of a task that searches a cluster, how often larger clusters are dealt into such tasks, and sets of a pair of blocks.
BLOCK, TURNS, PAIRED = 128, 1, 256
CODEC = pa.Codec("zstd", compression_level=1)


# Blobs: postings sorted by shingle travel as compressed columns.


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return len(values).to_bytes(4, "little") + bytes([values.itemsize]) + CODEC.compress(raw, asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    raw = np.frombuffer(CODEC.decompress(blob[5:], n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").reshape(n)


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


def _posting_row(tokens: np.ndarray, place: np.ndarray, sids: np.ndarray, sizes: np.ndarray) -> dict:
    """Sorted tokens, and of each posting the place of its set in ``sids`` and ``sizes``."""
    used, place = np.unique(place, return_inverse=True)
    return {"a": _pack(_steps(tokens)), "b": _pack(_narrow(place)), "c": _pack(sids[used]), "d": _pack(_narrow(sizes[used]))}


def _postings(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = _unpack(row.b)
    return np.cumsum(_unpack(row.a), dtype=np.uint64), _unpack(row.c)[place], _unpack(row.d).astype(np.uint32)[place]


BLOB = "bucket int, hot boolean, a binary, b binary, c binary, d binary"
BLOB_FIELDS = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), *((x, pa.binary()) for x in "abcd")])


class _Chunk:
    """The distinct sets of a stretch of a partition, up to so many postings."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.held: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, sid: int, hashes: np.ndarray) -> bool:
        """Whether the chunk is full."""
        if sid not in self.held:
            self.held[sid] = hashes
            self.size += len(hashes)
        return self.size >= self.limit

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens sorted, place of the set, ids of sets, sizes of sets)."""
        sids = np.fromiter(self.held, np.int64, len(self.held)).view(np.uint64)
        sizes = np.fromiter(map(len, self.held.values()), np.int64, len(self.held))
        tokens = np.concatenate(list(self.held.values()))
        order = np.argsort(tokens)
        self.held, self.size = {}, 0
        return tokens[order], np.repeat(np.arange(len(sids), dtype=np.uint32), sizes)[order], sids, sizes


def _described(docs: DataFrame, k: int, limit: int) -> DataFrame:
    """Rows (doc_id, n, sid) of all documents, and rows (token, seen) of shingles that many sets of a chunk hold."""

    @frugal_batches
    def describe(batches):
        chunk = _Chunk(limit)

        def frequent():
            many = max(64, len(chunk.held) // 64)
            if not chunk.held:
                return
            tokens = chunk.postings()[0]
            begins = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            seen = np.diff(np.append(begins, len(tokens)))
            at = seen >= many
            if at.any():
                none = pa.nulls(int(at.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(tokens[begins[at]].view(np.int64)), pa.array(seen[at])], ["doc_id", "n", "sid", "token", "seen"])

        for batch in batches:
            n, sids = [], []
            for hashes in document_sets(batch.column(1), k):
                n.append(len(hashes))
                sids.append(set_id(hashes) if len(hashes) else None)
                if len(hashes) and chunk.add(sids[-1], hashes):
                    yield from frequent()
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sids, pa.int64()), none, none], ["doc_id", "n", "sid", "token", "seen"])
        yield from frequent()

    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, n long, sid long, token long, seen long")


def _dealt(docs: DataFrame, k: int, buckets: int, hot: np.ndarray, limit: int) -> DataFrame:
    """Postings of all distinct sets of each chunk by ranges of shingles; hot shingles by set instead."""
    width = np.uint64(2**64 // buckets + 1)

    @frugal_batches
    def deal(batches):
        chunk = _Chunk(limit)

        def flush():
            if not chunk.held:
                return
            tokens, place, sids, sizes = chunk.postings()
            is_hot = np.zeros(len(tokens), bool)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
            rows = []
            for kind in (False, True):
                t, p = tokens[is_hot == kind], place[is_hot == kind]
                if kind:
                    bucket = (sids // width)[p]
                    order = np.argsort(bucket, kind="stable")
                    t, p, bucket = t[order], p[order], bucket[order]
                else:
                    bucket = t // width
                for a, b in runs(bucket):
                    rows.append({"bucket": int(bucket[a]), "hot": kind, **_posting_row(t[a:b], p[a:b], sids, sizes)})
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[at : at + 64], BLOB_FIELDS)

        for batch in batches:
            for hashes in document_sets(batch.column(0), k):
                if len(hashes) and chunk.add(set_id(hashes), hashes):
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(deal, BLOB)


SHARED = "bucket int, a binary, b binary, c binary, d binary, e binary"


def _shared(dealt: DataFrame, buckets: int, hot: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """Of each range the shingles that two sets or more hold, with their counts, dealt by set."""
    width = np.uint64(2**64 // buckets + 1)

    @frugal_frame
    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        out = []

        def send(tokens, sids, sizes, df):
            order = np.lexsort((tokens, sids))
            tokens, sids, sizes, df = tokens[order], sids[order], sizes[order], df[order]
            bucket = sids // width
            for a, b in runs(bucket):
                own, first, count = np.unique(sids[a:b], return_index=True, return_counts=True)
                out.append((int(bucket[a]), _pack(tokens[a:b]), _pack(_narrow(df[a:b])), _pack(own), _pack(_narrow(sizes[a:b][first])), _pack(_narrow(count))))

        def gathered(kind: bool):
            parts = [_postings(r) for r in frame[frame["hot"] == kind].itertuples()]
            return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None

        if (found := gathered(False)) is not None:
            tokens, sids, sizes = found
            order = np.argsort(tokens, kind="stable")
            tokens, sids, sizes = tokens[order], sids[order], sizes[order]
            same = tokens[1:] == tokens[:-1]
            many = np.append(False, same) | np.append(same, False)
            tokens, sids, sizes = tokens[many], sids[many], sizes[many]
            order = np.lexsort((sids, tokens))
            tokens, sids, sizes = tokens[order], sids[order], sizes[order]
            if len(tokens):
                fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (sids[1:] != sids[:-1]))  # equal sets of several chunks
                tokens, sids, sizes = tokens[fresh], sids[fresh], sizes[fresh]
                begins = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
                count = np.diff(np.append(begins, len(tokens)))
                df = np.repeat(count, count).astype(np.uint64)
                at = df > 1
                send(tokens[at], sids[at], sizes[at], df[at])
        if (found := gathered(True)) is not None:
            tokens, sids, sizes = found
            pairs = np.unique(np.rec.fromarrays([sids, tokens, sizes], names="s,t,n"))
            tokens, sids, sizes = pairs.t, pairs.s, pairs.n
            send(tokens, sids, sizes, ranks[np.searchsorted(hot, tokens)])
        return pd.DataFrame(out, columns=["bucket", *"abcde"])

    return dealt.groupBy("bucket").applyInPandas(reduce, SHARED)


def _records(shared: DataFrame, like: tuple[int, int]) -> DataFrame:
    """(sid, n, rare, tokens): sets that may have a partner, their shared shingles, and the rarest of those."""
    num, den = like

    @frugal_frame
    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        tokens, df, sids, sizes = [], [], [], []
        for r in frame.itertuples():
            count = _unpack(r.e).astype(np.int64)
            tokens.append(_unpack(r.a))
            df.append(_unpack(r.b).astype(np.uint64))
            sids.append(np.repeat(_unpack(r.c), count))
            sizes.append(np.repeat(_unpack(r.d).astype(np.int64), count))
        tokens, df, sids, sizes = (np.concatenate(x) for x in (tokens, df, sids, sizes))
        order = np.lexsort((tokens, df, sids))
        tokens, sids, sizes = tokens[order], sids[order], sizes[order]
        begins = np.flatnonzero(np.append(True, sids[1:] != sids[:-1]))
        ends = np.append(begins[1:], len(sids))
        need = -(-num * sizes[begins] // den)
        out = []
        for a, b, t in zip(begins.tolist(), ends.tolist(), need.tolist(), strict=True):
            if b - a >= t:
                own = tokens[a:b]
                out.append((int(sids[a].astype(np.int64)), int(sizes[a]), own[: b - a - t + 1].view(np.int64), np.sort(own).tobytes()))
        return pd.DataFrame(out, columns=["sid", "n", "rare", "tokens"])

    return shared.groupBy("bucket").applyInPandas(assemble, "sid long, n long, rare array<long>, tokens binary")


class Search:
    """T-occurrence search within a cluster; sets already connected are not compared again, nor any of one ``side``, if sides are told."""

    def __init__(self, sizes: list[int], tokens: list[np.ndarray], like: tuple[int, int], known: np.ndarray | None = None, side: np.ndarray | None = None) -> None:
        self.num, self.den = like
        self.sizes, self.side = sizes, side
        self.root = np.arange(len(sizes))
        if known is not None:  # equal labels are connected already
            _, first, of = np.unique(known, return_index=True, return_inverse=True)
            self.root = first[of]
        owner = np.repeat(np.arange(len(sizes)), [len(t) for t in tokens])
        flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
        order = np.lexsort((owner, flat))
        flat, owner = flat[order], owner[order]
        begins = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, int)
        # Shingles with the same list count as one list of their number.
        seal = mix(owner.astype(np.uint64) + np.uint64(1))
        marks = np.add.reduceat(seal, begins) if len(begins) else seal
        length = np.diff(np.append(begins, len(flat)))
        _, kept, weight = np.unique(np.rec.fromarrays([marks, length], names="m,l"), return_index=True, return_counts=True)
        self.lists: list[np.ndarray] = []
        self.weight: list[int] = []
        self.of: list[list[int]] = [[] for _ in sizes]
        for at, w in zip(kept.tolist(), weight.tolist(), strict=True):
            if length[at] > 1:
                own = owner[begins[at] : begins[at] + length[at]]
                for x in own.tolist():
                    self.of[x].append(len(self.lists))
                self.lists.append(own)
                self.weight.append(w)

    def join(self, x: int, y: int) -> None:
        a, b = sorted((int(self.root[x]), int(self.root[y])))
        self.root[self.root == b] = a

    def run(self) -> np.ndarray:
        """The root of each set: sets come in ascending size, and look among those before them."""
        for x in range(len(self.sizes)):
            self._link(x)
        return self.root

    def _open(self, x: int, first: int) -> list[tuple[list[int], int]]:
        """(list, weight) of what is still to be seen: from ``first`` on, before x, not connected to it."""
        out, apart = [], self.root != self.root[x]
        if self.side is not None:
            apart &= self.side != self.side[x]
        for c in self.of[x]:
            own = self.lists[c]
            own = own[np.searchsorted(own, first) : np.searchsorted(own, x)]
            own = own[apart[own]]
            if len(own):
                out.append((own.tolist(), self.weight[c]))
        return out

    def _link(self, x: int) -> None:
        size, first = self.sizes[x], 0
        least = -(-self.num * size // self.den)  # a partner that is no larger shares as much at least
        while True:
            lists = self._open(x, first)
            if sum(w for _, w in lists) < least:
                return
            found = self._next(x, lists, least)
            if found is None:
                return
            self.join(x, found)
            first = found + 1

    def _next(self, x: int, lists: list[tuple[list[int], int]], least: int) -> int | None:
        """The first set that is alike enough."""
        lists.sort(key=lambda v: -len(v[0]))
        share = least / (0.01 * math.log2(len(lists[0][0]) + 1) + 1)
        held, long_ = 0, 0
        while long_ < len(lists) - 1 and held + lists[long_][1] <= min(share, least - 1):
            held += lists[long_][1]
            long_ += 1
        probes, short, wanted = lists[:long_], lists[long_:], least - held
        heap = [(own[0], i, 0) for i, (own, _) in enumerate(short)]
        heapq.heapify(heap)
        while heap:
            y, popped, total = heap[0][0], [], 0
            while heap and heap[0][0] == y:
                _, i, at = heapq.heappop(heap)
                popped.append((i, at))
                total += short[i][1]
            if total >= wanted:
                if self._alike(x, y, total, probes):
                    return y
                to = y + 1
            else:  # whatever lies before the list that fills up the wanted weight cannot reach it
                while heap and total + short[heap[0][1]][1] < wanted:
                    _, i, at = heapq.heappop(heap)
                    popped.append((i, at))
                    total += short[i][1]
                if not heap:
                    return None
                to = heap[0][0]
            for i, at in popped:
                own = short[i][0]
                at = bisect_left(own, to, at)
                if at < len(own):
                    heapq.heappush(heap, (own[at], i, at))
        return None

    def _alike(self, x: int, y: int, total: int, probes: list[tuple[list[int], int]]) -> bool:
        both = self.sizes[x] + self.sizes[y]
        for own, w in probes:
            at = bisect_right(own, y)
            if at and own[at - 1] == y:
                total += w
        return (self.num + self.den) * total >= self.num * both


def _searched(dealt: DataFrame, like: tuple[int, int], *task: str) -> DataFrame:
    """Links (a, b) within each task of (node, n, root, side, tokens); sets of one root are connected already, and those of one of two sides meet elsewhere."""

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "node"])
        nodes = frame["node"].to_numpy()
        found = Search(frame["n"].tolist(), [np.frombuffer(t, np.uint64) for t in frame["tokens"]], like, frame["root"].to_numpy(), frame["side"].to_numpy() if frame["side"].nunique() > 1 else None)
        known = found.root.copy()
        roots = found.run()
        at = np.flatnonzero((known == np.arange(len(nodes))) & (roots != known))
        return pd.DataFrame({"a": nodes[at], "b": nodes[roots[at]]}, dtype="int64")

    # A number of partitions of its own, as tasks that are small in bytes take long here and should not be put together.
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = dealt.select(*task, "node", "n", "root", "side", "tokens").repartition(parts, *task)
    return own.groupBy(*task).applyInPandas(search, "a long, b long")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """The sets, with the root that ``links`` give them, that share one of their rarest shingles with a set of another root: no other can have a link that is still to be found."""
    rooted = members.drop("root").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "shingle-roots")
    rare = rooted.select("cluster", "node", "root", F.explode("rare").alias("token"))
    apart = rare.groupBy("cluster", "token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("cluster", "token")
    nodes = rare.join(written(apart, "shingle-apart"), ["cluster", "token"], "left_semi").select("node").distinct()
    return written(rooted.join(nodes, "node", "left_semi"), "shingle-open")


def _found(members: DataFrame, like: tuple[int, int]) -> DataFrame:
    """Links (a, b) within clusters, which connect all sets that are alike.

    Clusters of up to BLOCK sets are searched as they are. Those that are ``large`` are dealt by hash into
    blocks, and the sets that may still have a link dealt anew, TURNS times in all; that leaves a
    group of near copies with a root or two. What is open then is searched in pairs of blocks;
    a block holds sets of one class of sizes, and only classes that can be alike meet.
    """
    members = members.withColumns({"root": F.col("node"), "side": F.lit(0)})
    out = [_searched(members.where(~F.col("large")), like, "cluster")]
    rest = members.where("large")
    links = []
    for turn in range(TURNS):
        if rest.isEmpty():
            break
        parts = written(rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "shingle-parts")
        dealt = rest.join(parts, "cluster").withColumn("p", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int"))
        links.append(written(_searched(dealt, like, "cluster", "p"), "shingle-links"))
        rest = _open(rest, functools.reduce(DataFrame.unionAll, links))
    if not rest.isEmpty():
        links.append(_searched(_paired(rest, like), like, "cluster", "task"))
    return functools.reduce(DataFrame.unionAll, out + links)


def _paired(members: DataFrame, like: tuple[int, int]) -> DataFrame:
    """The sets of large clusters, once for each ``task``: a pair of blocks of half a task's sets, of size classes that can be alike."""
    ratio = math.log(like[1] / like[0]) * (1 + 1e-9)  # sets at the very limit stay in neighbouring classes
    classed = members.withColumn("c", F.floor(F.log("n") / ratio).cast("int"))
    # Written, so that its size is known before sets are dealt by cluster.
    blocks = written(classed.groupBy("cluster", "c").agg(F.ceil(F.count("*") / (PAIRED // 2)).cast("int").alias("parts")), "shingle-blocks")
    each = blocks.select("cluster", "c", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    left = each.select("cluster", F.col("c").alias("c1"), F.col("p").alias("p1"))
    right = each.select("cluster", F.col("c").alias("c2"), F.col("p").alias("p2"))
    near = (F.col("c2") == F.col("c1")) & (F.col("p2") >= F.col("p1")) | (F.col("c2") == F.col("c1") + 1)
    pairs = left.join(right, "cluster").where(near).withColumn("task", F.concat_ws(":", "c1", "p1", "c2", "p2"))
    ends = pairs.select("cluster", F.col("c1").alias("c"), F.col("p1").alias("p"), "task", F.lit(0).alias("side"))
    # A block that meets itself is there once, and its sets are on one side.
    ends = ends.unionAll(pairs.where((F.col("c1") != F.col("c2")) | (F.col("p1") != F.col("p2"))).select("cluster", F.col("c2").alias("c"), F.col("p2").alias("p"), "task", F.lit(1).alias("side")))
    dealt = classed.join(blocks, ["cluster", "c"]).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return dealt.drop("side").join(ends, ["cluster", "c", "p"])


def near_duplicates(docs: DataFrame, words: int = WORDS, like: tuple[int, int] = LIKE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Documents link when their sets of ``words``-word shingles have a Jaccard similarity of
    like[0] / like[1] or more; ``component_id`` is the smallest doc_id that links reach. Words
    are runs without ASCII blanks, A-Z count as a-z; a text with fewer words counts whole as
    one shingle. A null, empty or blank text has no shingle, links with nothing and is its own
    component. Repeated rows stay and link with each other; a row without doc_id takes part and
    gets the component of the others it links with (null if none has an id); an empty table gives
    no rows; other columns are ignored. Shingles and sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2, -(-size // setting(spark, "bucketBytes", BUCKET_BYTES)))
    limit = setting(spark, "chunkPostings", CHUNK)
    described = written(_described(docs, words, limit), "shingle-sets")
    info = described.where(F.col("n").isNotNull()).select("doc_id", "n", "sid")
    # The order of frequent shingles, at most HOT of them; it steers balance, never results.
    often = described.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(HOT).collect()
    tokens = np.array([r.token for r in often], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    hot, ranks = tokens[order], (np.uint64(1 << 40) + np.array([r.seen for r in often], np.uint64))[order]
    shared = _shared(_dealt(docs, words, buckets, hot, limit), buckets, hot, ranks)
    first = info.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("first"))
    nodes = first.withColumn("node", F.col("sid"))
    records = written(_records(shared, like), "shingle-records")
    rare = records.select(F.col("sid").alias("node"), F.explode("rare").alias("token"))
    roots = rare.groupBy("token").agg(F.min("node").alias("least"), F.count("*").alias("m")).where(F.col("m") > 1).select("token", "least")
    hyper = rare.join(roots, "token").where(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    clusters = written(components(hyper), "shingle-roots")
    # Written, so that its few rows are known to be few: no more than one for BLOCK sets.
    large = written(clusters.groupBy("root").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("root", F.lit(True).alias("large")), "shingle-large")
    clusters = clusters.join(large, "root", "left").select("node", F.col("root").alias("cluster"), F.coalesce("large", F.lit(False)).alias("large"))
    members = records.select(F.col("sid").alias("node"), "n", "rare", "tokens").join(clusters, "node")
    linked = components(_found(written(members, "shingle-clusters"), like))
    of_set = nodes.join(linked, "node", "left").select("sid", "first", F.coalesce("root", "node").alias("root"))
    least = of_set.groupBy("root").agg(F.min("first").alias("component_id"))
    final = of_set.join(least, "root").select("sid", "component_id")
    joined = info.join(final, "sid", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Sets by lists of shingles, candidates by a join on them, components by a recursive walk.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM w
), p AS MATERIALIZED (
  SELECT r, unnest(list_distinct(list_transform(shingles, lambda x: hash(x)))) AS h, len(shingles) AS n FROM s
), pairs AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM p a JOIN p b ON a.h = b.h AND a.r <> b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), walk AS (
  SELECT r, r AS other FROM s
  UNION
  SELECT walk.r, pairs.b FROM walk JOIN pairs ON pairs.a = walk.other
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN walk ON walk.r = s.r JOIN s t ON t.r = walk.other
GROUP BY s.r, s.doc_id, s.shingles
"""
