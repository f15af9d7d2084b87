"""Operator 9: token counts, with overlap resynchronisation for huge documents.

A huge document is encoded in overlapping chunks with offsets.  A place where
a word of the tokenizer begins in both chunks is stable: the splitting
pattern never looks back, so the rest of the later chunk splits as in the
whole text; the earlier chunk counts up to its last word and short of the length of a special
token before its end, where the cut cannot have an effect.  The counts
are spliced there.  Where no such place lies in the overlap, the overlap
is doubled, up to the last stable place, and the chunk with it.

Other documents: where no two white-space characters meet, a blank always
begins a word, so each distinct blank-led piece is counted once per worker by
the library and remembered; all else goes to the library whole.

Defined results: null counts as empty (0 bytes, 0 tokens); one row per input row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk; longer documents are huge. Characters of the first overlap.
CHUNK, OVERLAP = 16_384, 512
#: Pieces remembered by a worker process: a bound of memory, without effect on results.
REMEMBERED = 1_000_000
_PAIR = re.compile(r"\s\s")
_loaded: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.margin = max([len(t.content) for t in self.library.get_added_tokens_decoder().values()], default=0)
        self.known: dict[str, int] = {}

    def _words(self, text: str, at: int, stop: int) -> tuple[dict[int, int], int]:
        """Places in the text where words of a chunk begin, with the tokens of
        the chunk before them; all its tokens."""
        e = self.library.encode(text[at:stop], add_special_tokens=False)
        starts, last = {}, None
        for k, (word, (begin, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if word != last:
                starts.setdefault(at + begin, k)
                last = word
        return starts, len(e.ids)

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        n, pos, end, total = len(text), 0, min(len(text), chunk), 0
        starts, size = self._words(text, 0, end)
        while end < n:
            width = overlap
            limit = min(max(starts, default=pos), end - self.margin)
            while True:
                begin = max(pos, end - width)
                stop = min(n, end + max(chunk, end - begin))
                later, later_size = self._words(text, begin, stop)
                stable = min((p for p in later if begin <= p <= limit and p in starts), default=None)
                if stable is not None or begin == pos:
                    break
                width *= 2
            if stable is not None:
                total += starts[stable] - starts[pos]
                pos = stable
            starts, size, end = later, later_size, stop
        return total + size - starts.get(pos, 0)

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int | None] = []
        split: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            text = text or ""
            if len(text) > CHUNK:
                out.append(self.spliced(text))
            elif _PAIR.search(text):
                out.append(len(self.library.encode(text, add_special_tokens=False).ids))
            else:
                first, *rest = text.split(" ")
                out.append(0)
                split.append((k, [first, *(" " + x for x in rest)]))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        missing = list({p for _, pieces in split for p in pieces if p not in self.known})
        self.known.update(zip(missing, (len(e) for e in self.library.encode_batch_fast(missing, add_special_tokens=False))))
        for k, pieces in split:
            out[k] = sum(map(self.known.__getitem__, pieces))
        return out


def load(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(tokenizer)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                some = b.slice(k, 200)
                n = counter.count(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
