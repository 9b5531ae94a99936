"""Byte-level BPE encoding and decoding.

Each pre-token is a doubly linked list of tokens. Pairs that can merge wait in
buckets, one for each merge rank; a hierarchical bitmap tells which buckets hold any,
and find-first-set picks the lowest rank. Within a rank the leftmost pair goes first.
Entries whose pair has changed since are stale and skipped. A pre-token of n bytes
takes n merges at most, so the cost stays near-linear however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

CACHED = 500_000
CACHED_BYTES = 64


class Known(dict):
    """Ids of pre-tokens, as bytes: those of two generations of CACHED entries at most, so that frequent ones stay."""

    def __init__(self, pairs: BytePairs) -> None:
        self.pairs = pairs
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = array("I", self.pairs.merge(raw)).tobytes()
            if len(raw) > CACHED_BYTES:
                return ids
        self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > CACHED:
            self.older = dict(self)
            self.clear()


class BytePairs:
    """Ranks of a vocabulary, with its texts split by ``pattern`` before merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        # What two neighbours merge into: the rank of the token that they spell.
        self.pairs = {
            ranks[token[:i]] << 32 | ranks[token[i:]]: rank for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        }
        self.split = regex.compile(pattern)
        self.words = [0] * ((max(ranks.values()) >> 8) + 1)
        self.known = Known(self)
        self.plain = plain_pattern(pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        ``words[rank >> 8]`` has a bit for each rank with a bucket, ``top`` one for each word
        with bits; both are empty again at the end. The queue is kept in local names, as the
        calls would cost more than the work.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, pair, words = len(piece), self.pairs.get, self.words
        ids = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank under which the pair that starts here waits; None where nothing does.
        waits = [pair(x << 32 | y) for x, y in zip(ids, ids[1:])]  # noqa: B905
        waits.append(None)
        buckets: dict[int, int | list[int]] = {}  # mostly of a single position
        top = 0
        for i, rank in enumerate(waits):
            if rank is not None:
                if rank in buckets:
                    held = buckets[rank]
                    if type(held) is int:
                        buckets[rank] = [held, i]
                    else:
                        held.append(i)  # in ascending order, which is a heap
                else:
                    buckets[rank] = i
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            i = buckets[rank]
            if type(i) is not int and len(i) > 1:
                i = heappop(i)
            else:
                if type(i) is not int:
                    i = i[0]
                del buckets[rank]
                words[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if waits[i] != rank:
                continue  # stale
            j = after[i]
            ids[i], ids[j], waits[j] = rank, -1, None
            after[i] = k = after[j]
            left = before[i]
            if k < n:
                before[k] = i
                new = pair(rank << 32 | ids[k])
            else:
                new = None
            waits[i] = new
            while True:  # for the pair that starts here, and the one that ends here
                if new is not None:
                    held = buckets.get(new)
                    if held is None:
                        buckets[new] = i
                        words[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
                    elif type(held) is int:
                        buckets[new] = [held, i] if held < i else [i, held]
                    else:
                        heappush(held, i)
                if left < 0:
                    break
                i, left = left, -1
                new = pair(ids[i] << 32 | rank)
                if new == waits[i]:
                    break
                waits[i] = new
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> array:
        """Ids of a whole text, each match of the pattern by itself."""
        split = self.plain if self.plain is not None and PLAIN_TEXT.fullmatch(text) else self.split
        ids = array("I", b"".join(map(self.known.__getitem__, split.findall(text))))
        self.known.trim()
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: Texts of these characters alone: the classes of ``re`` and of Unicode agree on them.
PLAIN_TEXT = re.compile(r"[\t\n\r\x20-\x7e¡-©«-¬®-±´¶-¸»¿-ɏ‐-‧‰-⁞]*")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """``pattern`` for ``re``, which is faster; None if it uses more than these classes."""
    swapped = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return None if r"\p" in swapped else re.compile(swapped)


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> BytePairs:
    """A vocabulary from a file of base64 tokens and ranks; once for each worker."""
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): token ids of every whole text, without special tokens. A null text is empty; an empty text has no ids; rows may repeat and are encoded each; other columns are ignored."""

    def encode(batches):
        pairs = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [pairs.encode(x or "") for x in part.column(1).to_pylist()]
                offsets = [0]
                for x in ids:
                    offsets.append(offsets[-1] + len(x))
                flat = pa.array(memoryview(b"".join(x.tobytes() for x in ids)).cast("I"), pa.uint32()).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids); null ids give empty bytes."""

    def decode(batches):
        pairs = load(path, pattern)
        for batch in batches:
            raw = [pairs.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encoding and then decoding every whole text gives."""

    def digest(batches):
        pairs = load(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = pairs.encode(text or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(pairs.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
