"""Operator 7: token ids in ORC files, in the order of doc_id.

Texts are range-partitioned and sorted by doc_id, encoded, and written as ORC:
integer run-length encoding for the ids, a row index, and Bloom filters on doc_id,
so that readers work stripe by stripe and skip stripes that cannot hold a document.
Each row carries its offset within its part; the parts' totals give the rest.

White space always ends a word of this kind of tokenizer (its splitting
pattern drops it), so each distinct blank-separated chunk is encoded by the
library and remembered by the worker.  Commas and points behind letters and
digits, which the pattern splits off, are chunks of their own.  Chunks of letters
alone are one word each and go to the library by the line, without the pattern.

Defined results: a null text is an empty one; each document ends with
the end id; null doc_ids come first; rows that repeat a doc_id each have a
place, in the order of a hash of their texts.  Very long texts are cut behind white
space.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chunks remembered by a worker process, in each of two generations (what is met again moves
#: to the newer one): a bound of memory, without effect on results.
REMEMBERED = 350_000
#: Latin-1 bytes by kind: comma or point, other sign, and what may stand before a comma or point that is set off.
KINDS = bytes(1 if b in b".," else 0 if chr(b).isalnum() or b in b" \n\t\r" else 2 for b in range(256))
#: The pattern of tokenizers for which a chunk of letters is one word (a fixed value of theirs).
LETTER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of letters given to the library at once.
WORDS_AT_ONCE = 1_000
_loaded: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Ids of texts by a tokenizer that drops white space and lower-cases.

    Only blanks, tabs and line ends cut chunks; other white space is left to
    the library.  A Latin-1 text without special tokens is lower-cased here, and its commas
    and points are set off, unless one follows another sign, with
    which it would be one word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words, self.ends = self._word_encoder()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _word_encoder(self):
        """The library without its splitting pattern, for lines of lower-case words of letters, and which
        ids end a word; None where the pattern is another."""
        whole = json.loads(self.library.to_str())
        norms = whole["normalizer"] or {}
        steps = (whole["pre_tokenizer"] or {}).get("pretokenizers", [])
        suffix = whole["model"].get("end_of_word_suffix")
        changes = {x["type"] for x in norms.get("normalizers", [norms] if norms else [])}  # these change nothing in lower-case Latin-1 words
        if not suffix or not changes <= {"NFC", "Replace", "Lowercase"} or [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": LETTER_WORDS}:
            return None, None
        from tokenizers import pre_tokenizers

        words = type(self.library).from_str(self.library.to_str())
        words.normalizer = None
        words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(max(words.get_vocab().values()) + 1, bool)
        ends[[i for token, i in words.get_vocab().items() if token.endswith(suffix)]] = True
        return words, ends

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as machine unsigned 32-bit integers."""
        split = [(k, *self._chunks(block)) for k, text in enumerate(texts) for block in _blocks(text)]
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        self._learn(set().union(*(c for _, c, simple in split if simple)), self.words is not None)
        self._learn(set().union(*(c for _, c, simple in split if not simple)), False)
        out, known = [b""] * len(texts), self.known.__getitem__
        for k, chunks, _ in split:
            out[k] += b"".join(map(known, chunks))
        return out

    def _learn(self, chunks: set[str], plain: bool) -> None:
        new = chunks.difference(self.known)
        old = new.intersection(self.before)
        self.known.update((c, self.before[c]) for c in old)
        todo = new - old
        if plain:
            letters = [c for c in todo if c.isalpha()]
            todo.difference_update(letters)
            for k in range(0, len(letters), WORDS_AT_ONCE):
                some = letters[k:k + WORDS_AT_ONCE]
                ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                flat, stops = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                self.known.update(zip(some, [flat[x:y] for x, y in zip([0, *stops], stops)]))
        todo = list(todo)
        self.known.update((c, array("I", e.ids).tobytes()) for c, e in zip(todo, self.library.encode_batch_fast(todo, add_special_tokens=False)))

    @staticmethod
    def _chunks(block: str) -> tuple[list[str], bool]:
        simple = "<|" not in block
        try:
            kinds = block.encode("latin-1").translate(KINDS)
        except UnicodeEncodeError:
            simple = False
        if simple:
            block = block.lower()
            if b"\2\1" not in kinds and b"\1\1" not in kinds:
                block = block.replace(",", " ,").replace(".", " .")
        return block.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), simple


def _blocks(text: str) -> Iterator[str]:
    """The text in blocks of about 2**20 characters, cut behind white space."""
    for at in range(0, len(text) or 1, 1 << 20):
        yield text[_next_cut(text, at):_next_cut(text, at + (1 << 20))]


def _next_cut(text: str, at: int) -> int:
    """The first place from `at` on that lies after a blank, tab or line end."""
    if at == 0 or at >= len(text):
        return min(at, len(text))
    found = [x for c in " \n\t\r" if (x := text.find(c, at - 1)) >= 0]
    return min(found) + 1 if found else len(text)


def load(path: str) -> ChunkEncoder:
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1) -> None:
    """Write doc_id, part, part_offset, n_tokens, ids as ORC files, ascending in doc_id."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, offset = load(tokenizer), TaskContext.get().partitionId(), 0
        end = array("I", [end_id]).tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some = b.slice(k, 500)
                data = [x + end for x in encoder.encode(some.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in data], np.int64)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(data), np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(offset + ends - n), pa.array(n), ids], ["doc_id", "part", "part_offset", "n_tokens", "ids"])
                offset += int(ends[-1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the last key deals equal rows, however many, over several parts
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("spread", F.monotonically_increasing_id())
    order = ["doc_id", "h", "spread"]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(run, "doc_id long, part int, part_offset long, n_tokens long, ids array<int>")
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("compression", "zstd").orc(out))


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the files that write_tokens made."""
    rows = spark.read.schema("doc_id long, part int, part_offset long, n_tokens long, ids array<int>").orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row per part
    base = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    joined = rows.join(F.broadcast(base), "part")  # one row per written part
    return joined.select("doc_id", (F.col("_base") + F.col("part_offset")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 over ids as little-endian unsigned 32-bit integers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
