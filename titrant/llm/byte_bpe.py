"""Operator 6: byte-level BPE encoding and decoding with a segment tree.

Each match of the split pattern is encoded by itself.  The leaves of a segment tree
over its byte positions hold the rank of the pair that starts there, with the
position in the low bits, so the root is the leftmost minimum.  A merge
writes three leaves (the merged token, its right neighbour that vanishes, its
left neighbour) and their paths to the root.  Short matches of equal tree
size are merged side by side in numpy; long ones one by one.

Defined results: a null text is encoded like an empty one, to no ids.  Rows
come back in their order, repeated or not.  Very long texts are split block by block, very long
matches merged whole.  Special tokens are not known.  `encode` and `round_trip` ignore
columns other than doc_id and text; `decode` keeps them, but one named `decoded`.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches up to so many bytes are merged side by side.
SHORT = 64
#: Characters of text split at once, and bytes of matches and ids remembered by a worker, with
#: ENTRY bytes each for their objects: bounds of memory, without effect on results.
BLOCK_CHARS, REMEMBERED, ENTRY = 1 << 17, 20_000_000, 200
_NONE = np.uint64((1 << 64) - 1)
_LOW = np.uint64((1 << 32) - 1)


class ByteBPE:
    """Ranks of a vocabulary, with the ranks of all pairs of tokens that merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        found = np.array([(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks], np.uint64).reshape(-1, 2)
        order = np.argsort(found[:, 0])
        self._keys, self._values = found[order, 0].copy(), found[order, 1].copy()
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], np.uint64)
        self._known: dict[str, bytes] = {}
        self._held = 0
        self._one_by_one = array("Q", self._keys.tobytes()), array("Q", self._values.tobytes())
        self.tokens = [b""] * (1 + max(ranks.values(), default=0))
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def pair_rank(self, left: int, right: int) -> int | None:
        """The rank of one pair, for matches merged one by one."""
        keys, values = self._one_by_one
        at = bisect_left(keys, left << 32 | right)
        return values[at] if at < len(keys) and keys[at] == left << 32 | right else None

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.uint64(32) | right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._values[at], _LOW) if len(self._keys) else np.full(len(key), _LOW)

    def merge_many(self, data: list[bytes], size: int) -> list[bytes]:
        """Ids, as bytes, of matches of `size` bytes at most (a power of two)."""
        rows, span = len(data), np.array([len(d) for d in data])
        raw = np.frombuffer(b"".join(d.ljust(size, b"\0") for d in data), np.uint8).reshape(rows, size)
        place = np.arange(size)
        ids = self._bytes[raw]
        live = place < span[:, None]
        after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
        tree = np.full((rows, 2 * size), _NONE)
        if size > 1:
            rank = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, size - 1)
            tree[:, size:-1] = np.where(live[:, 1:] & (rank != _LOW), rank << np.uint64(32) | place[:-1].astype(np.uint64), _NONE)
        width = size // 2
        while width:
            tree[:, width:2 * width] = np.minimum(tree[:, 2 * width:4 * width:2], tree[:, 2 * width + 1:4 * width:2])
            width //= 2

        def put(r, leaf, value):
            node = leaf + size
            tree[r, node] = value
            while size > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                if node[0] == 1:
                    break

        def pair(r, left, right):
            rank = self._pair_ranks(ids[r, left], ids[r, right])
            return np.where(rank != _LOW, rank << np.uint64(32) | left.astype(np.uint64), _NONE)

        r = np.flatnonzero(tree[:, 1] != _NONE) if size > 1 else np.empty(0, np.int64)
        while len(r):
            best = tree[r, 1]
            at = (best & _LOW).astype(np.int64)
            gone = after[r, at]
            then = after[r, gone]
            ids[r, at] = best >> np.uint64(32)
            live[r, gone] = False
            after[r, at] = then
            put(r, gone, _NONE)
            has = then < span[r]
            before[r[has], then[has]] = at[has]
            value = np.full(len(r), _NONE)
            value[has] = pair(r[has], at[has], then[has])
            put(r, at, value)
            prior = before[r, at]
            has = prior >= 0
            if has.any():
                put(r[has], prior[has], pair(r[has], prior[has], at[has]))
            r = r[tree[r, 1] != _NONE]
        flat, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_one(self, data: bytes) -> bytes:
        """Ids, as bytes, of one match of any length."""
        n = len(data)
        size = 1 << max(1, (n - 1).bit_length())
        ids = [int(self._bytes[b]) for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, rank_of = 1 << 64, self.pair_rank
        tree = [none] * (2 * size)
        for k in range(n - 1):
            if (rank := rank_of(ids[k], ids[k + 1])) is not None:
                tree[size + k] = rank << 32 | k
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf, value):
            node = leaf + size
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        def pair(left, right):
            rank = rank_of(ids[left], ids[right])
            return none if rank is None else rank << 32 | left

        live = bytearray(b"\1") * n
        while (best := tree[1]) != none:
            at = best & 0xFFFFFFFF
            gone = after[at]
            then = after[at] = after[gone]
            ids[at] = best >> 32
            live[gone] = 0
            put(gone, none)
            if then < n:
                before[then] = at
            put(at, pair(at, then) if then < n else none)
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return np.array([i for i, x in zip(ids, live) if x], "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids of matches not met before."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(data)) is not None:
                self._known[piece] = whole.to_bytes(4, "little")
            elif len(data) > SHORT:
                self._known[piece] = self.merge_one(data)
            else:
                groups.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for size, group in groups.items():
            step = max(1, (1 << 20) // (size * 8))
            for k in range(0, len(group), step):
                some = group[k:k + step]
                self._known.update(zip([p for p, _ in some], self.merge_many([d for _, d in some], size)))

    def _blocks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK_CHARS:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while block := list(islice(found, BLOCK_CHARS // 4)):
            yield block

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for start, stop in _spans(texts):
            if stop - start == 1:
                parts = []
                for block in self._blocks(texts[start] or ""):
                    self._remember(block)
                    parts.append(b"".join(map(self._known.__getitem__, block)))
                yield b"".join(parts)
                continue
            split = [self.split.findall(t or "") for t in texts[start:stop]]
            self._remember(*split)
            for pieces in split:
                yield b"".join(map(self._known.__getitem__, pieces))

    def _remember(self, *blocks: list[str]) -> None:
        if self._held > REMEMBERED:
            self._known.clear()
            self._held = 0
        new = set().union(*blocks).difference(self._known)
        self._learn(new)
        self._held += sum(ENTRY + len(p) + len(self._known[p]) for p in new)


def _spans(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_CHARS characters."""
    start = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t or "") > BLOCK_CHARS:
            yield start, k
            start, held = k, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """An encoder, once per worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _loaded[path, pattern]


def _pass_over(docs: DataFrame, path: str, pattern: str, decoded: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                some = b.slice(at, 100)
                ids = list(bpe.encode(some.column(1).to_pylist()))
                out = {"doc_id": some.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    out["decoded"] = pa.array(map(bpe.decode, ids), pa.binary())
                yield pa.RecordBatch.from_pydict(out)
    schema = "doc_id long, n_tokens long, ids binary" + (", decoded binary" if decoded else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of each row."""
    return _pass_over(docs, path, pattern, False)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`encode` with `decoded`, the bytes of `ids`, in one Python worker a task."""
    return _pass_over(docs, path, pattern, True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The input's rows with `decoded`, the bytes of `ids`."""
    at = encoded.columns.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(read_ranks(path), ".+")
        for b in batches:
            for k in range(0, b.num_rows, 100):
                some = b.slice(k, 100)
                out = pa.array([bpe.decode(x.as_py() or b"") for x in some.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, out], [*some.schema.names, "decoded"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")
