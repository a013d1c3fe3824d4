"""Byte-level BPE: encode and decode by the ranks of a public vocabulary.

Two tiers.  A pre-token that is a vocabulary entry is resolved by a minimal
perfect hash over the entries (one displacement per bucket, as many slots as
entries, the slot's bytes are compared).  Any other pre-token is merged with a
heap of adjacent pairs over a doubly linked list of its bytes, smallest rank
first and leftmost among equals, as the public library does.

With the vocabularies' own pattern, text is split at every space that a non-space follows; a
pre-token of that pattern always starts there, so the pieces can be encoded on their own and
kept in a bounded two-generation cache.  For any other pattern the whole text is matched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

CACHE_ENTRIES = 200_000  # in each of the two generations
SHORT = 1 << 8  # bytes of a pre-token whose places fit 8 bits
NARROW = 1 << 24  # bytes of a pre-token whose places fit 24 bits
FLUSH = 500_000  # token ids that go out at a time


MARKS = frozenset(".,;:!?")


def _letters(piece: str) -> bool:
    """Whether a piece is Latin letters alone, so that it is one pre-token and needs no matching."""
    return piece.isalpha() and (piece.isascii() or max(piece) <= "\u024f")


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 bytes and a rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash from the vocabulary's byte strings to their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = len(ranks)
        self.buckets = max(1, n // 3)
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        self.shift = [0] * self.buckets
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in ranks:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        taken = bytearray(n)
        free = n - 1
        for b, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(group) > 1:
                d = 1
                while True:
                    slots = [self._slot(h, d) for h, _ in group]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            else:
                while taken[free]:
                    free -= 1
                slots = [free]
                self.shift[b] = -free - 1  # the only key of its bucket names its slot
            for s, (_, key) in zip(slots, group):
                taken[s] = 1
                self.keys[s], self.values[s] = key, ranks[key]

    def _slot(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 29 & 0xFFFFFFFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else None


class Codec:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: int = CACHE_ENTRIES):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, so that some texts could not be encoded")
        self.ranks = ranks
        self.whole = PerfectHash(ranks)
        self.pattern = regex.compile(pattern)
        self.splits = pattern == public_tokenizers.PATTERN
        self.odd_space = regex.compile(r" (?=\s|\Z)|\A ")
        self.boundary = regex.compile(r"(?V1)(?= \S)")
        self.limit = cache_entries
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        #: The rank of each two-byte entry, which is where every merge starts.
        self.byte_pairs = {(k[0], k[1]): r for k, r in ranks.items() if len(k) == 2}.get
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        top = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * top
        for key, rank in ranks.items():
            self.bytes_of[rank] = key
        self.digits = [str(i) for i in range(top)]

    def age(self) -> None:
        """Keep one generation of the cache alone, as at the end of a task: the process lives on, and other tasks may follow."""
        self.old, self.young = self.young or self.old, {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge adjacent parts, smallest rank first, with a heap over linked bytes.

        ``after[i]`` is where the part that starts at byte ``i`` ends, which is where
        its right neighbour starts; ``before[i]`` is where its left neighbour starts.
        A heap entry packs the rank, the start and the end of a pair; it is stale
        once a part of the pair has grown, since a pair's bytes have one rank.  ``ids[i]``
        is the rank of the part that starts at byte ``i``.
        """
        n = len(piece)
        wide = 8 if n < SHORT else 24 if n < NARROW else 48  # bits of a place
        high, low = 2 * wide, (1 << wide) - 1
        rank, pairs, push, pop = self.ranks.get, self.byte_pairs, heapq.heappush, heapq.heappop
        ids = list(map(self.of_byte.__getitem__, piece))
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        heap = [r << high | i << wide | i + 2 for i, ab in enumerate(zip(piece, piece[1:])) if (r := pairs(ab)) is not None]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i, end = x >> wide & low, x & low
            j = after[i]
            if j < 0 or j >= n or after[j] != end:
                continue
            ids[i] = x >> high
            after[i] = end
            after[j] = -1
            before[end] = i
            if end < n and (r := rank(piece[i : after[end]])) is not None:
                push(heap, r << high | i << wide | after[end])
            h = before[i]
            if h >= 0 and (r := rank(piece[h:end])) is not None:
                push(heap, r << high | h << wide | end)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _piece(self, text: str) -> tuple[int, ...]:
        tokens = self.pattern.findall(text)
        if len(tokens) == 1:
            return self._token(text)
        out: list[int] = []
        for token in tokens:
            if token[0] == " " and (got := self.young.get(token[1:]) or self.old.get(token[1:])):
                out += got  # a word that was met without what follows it here
            else:
                out += (got := self._token(token))
                if token[0] == " " and 1 < len(token) <= 64:
                    self._keep(token[1:], got)
        return tuple(out)

    def _token(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8", "surrogatepass")
        r = self.whole.get(raw)
        return tuple(self.merge(raw)) if r is None else (r,)

    def _keep(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[piece] = ids

    def _spaced(self, piece: str) -> tuple[int, ...]:
        """Ids of a space and ``piece``; the cached path."""
        got = self.old.get(piece)
        if got is None:
            last = piece[-1:]
            if _letters(piece):
                got = self._token(" " + piece)
            elif last in MARKS and _letters(head := piece[:-1]):
                word = self.young.get(head) or self.old.get(head)
                if word is None:
                    word = self._token(" " + head)
                    if len(head) <= 64:
                        self._keep(head, word)
                got = word + self._token(last)
            else:
                got = self._piece(" " + piece)
        if len(piece) <= 64:
            self._keep(piece, got)
        return got

    def encode(self, text: str | None) -> list[int]:
        """Token ids of the whole text; none for a null or empty one."""
        if not text:
            return []
        if not self.splits:
            return list(chain.from_iterable(map(self._token, self.pattern.findall(text))))
        spaced = self._spaced
        if self.odd_space.search(text) is None:
            head, *rest = text.split(" ")
            out = [self._piece(head)]
        else:
            out, rest = [], []
            for k, piece in enumerate(self.boundary.split(text)):
                if piece[:1] == " " and len(piece) > 1 and not piece[1].isspace():
                    out.append(spaced(piece[1:]))
                elif piece:
                    out.append(self._piece(piece))
        young = self.young
        for piece in rest:
            got = young.get(piece)
            if got is None:
                got = spaced(piece)
                young = self.young
            out.append(got)
        return list(chain.from_iterable(out))

    def decode(self, ids) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def ids_text(self, ids) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))


_CODECS: dict[tuple, Codec] = {}


def _codec(shared, cache: int = CACHE_ENTRIES) -> Codec:
    """The worker's codec; built once a process from the broadcast ranks."""
    ranks, pattern, key = shared.value
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    _CODECS[key].limit = cache
    return _CODECS[key]


def _shared(spark: SparkSession, vocabulary: str, pattern: str):
    ranks = read_ranks(vocabulary)  # as large as the vocabulary file, whatever the corpus
    return spark.sparkContext.broadcast((ranks, pattern, (vocabulary, pattern)))


def encode_text(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``, an array of token ids, to every row; no shuffle.

    Null and empty texts give an empty array, never null.  Ids go out in batches of about ``FLUSH``.  All other columns
    pass through; a column already named ``out`` is replaced.  An empty table
    gives an empty table.
    """
    shared = _shared(docs.sparkSession, vocabulary, pattern)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            names = [c for c in batch.schema.names if c != out]
            flat, ends, start = array("i"), [0], 0
            for k, t in enumerate(batch.column(text), 1):
                flat.extend(codec.encode(t.as_py()))
                ends.append(len(flat))
                if len(flat) >= FLUSH or k == batch.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, k - start) for c in names), ids], names=[*names, out])
                    flat, ends, start = array("i"), [0], k
        codec.age()

    kept = docs.drop(out)
    return kept.mapInArrow(run, f"{_ddl(kept)}, `{out}` array<int>")


def decode_ids(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes that ``ids`` stands for; null ids give no bytes."""
    shared = _shared(docs.sparkSession, vocabulary, pattern)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            raw = pa.array([codec.decode(i or ()) for i in batch.column(ids).to_pylist()], pa.binary())
            names = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), raw], names=[*names, out])

    kept = docs.drop(out)
    return kept.mapInArrow(run, f"{_ddl(kept)}, `{out}` binary")


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", cache: int = 2 * CACHE_ENTRIES) -> DataFrame:
    """Encode, decode and digest every row in one pass: ``key, n_tokens, ids_sha256, decoded_sha256``.

    Equal to ``encode_text`` followed by ``decode_ids`` without moving the ids
    and the bytes out of the worker, which therefore has room for a larger cache.  Null keys pass through; repeated rows give
    repeated results.
    """
    shared = _shared(docs.sparkSession, vocabulary, pattern)

    def run(batches):
        codec = _codec(shared, cache)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = codec.encode(t.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(codec.ids_text(ids).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.age()

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
