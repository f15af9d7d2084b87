"""Token operators against the libraries on whole texts, and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from titrant.llm import byte_bpe, token_counts, token_files

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}


def texts(n=120, seed=5):
    rng = random.Random(seed)
    bits = ["the", " the", "  ", "\n", " \n ", "\t", "Été", "straße", "日本語", "🙂", "'s", "'re", "123", "4", "!!", "...", "###", "<|endoftext|>", "<|start", "oftext|>", "a" * 70, "zq" * 40, "x́", " ", "\x1c", "\x85",
            "İ", "Σας", "word,", " word.", "(it)", "\r\n", "don't", "A", "ERÜ!!", " ", " ́b"]
    out = [None, "", " ", "\n", "  a", "a  ", "a b", "<|endoftext|>", "<|startoftext|> b", "<|ENDOFTEXT|>,"]
    out += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    out += [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    out.append(" ".join(rng.choice(["ab", "cd", "Thon,", "x\n"]) for _ in range(40_000)))
    out.append("y" * 30_000)
    return out


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({"ids": F.lit("x"), "part": F.lit(0), "n_tokens": F.lit("y")})


def test_byte_bpe(spark):
    rows = list(enumerate(texts())) + [(None, "a b"), (1, "")]
    path = P.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.decode(byte_bpe.encode(table(spark, rows), path, P.PATTERN), path).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = sorted((d is None, d or 0, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    both = byte_bpe.round_trip(table(spark, rows), path, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in both) == want
    assert byte_bpe.round_trip(table(spark, []), path, P.PATTERN).count() == 0
    assert token_counts.token_counts(table(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_segment_trees_agree_with_plain_merging():
    rng = random.Random(1)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 700:
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        if a + b not in ranks and len(a + b) < 9 and set(a + b) <= set(range(97, 101)):
            ranks[a + b] = len(ranks)
    bpe = byte_bpe.ByteBPE(ranks, r".+")

    def plain(data):
        parts = [bytes([b]) for b in data]
        while True:
            best = min(((ranks[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if best is None:
                return np.array([ranks[p] for p in parts], "<u4").tobytes()
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    for n in (1, 2, 3, 4, 7, 8, 16, 33, 64):
        data = [bytes(rng.choices(range(97, 101), k=rng.randint(1, n))) for _ in range(60)]
        size = 1 << (n - 1).bit_length()
        assert bpe.merge_many(data, size) == [plain(d) for d in data] == [bpe.merge_one(d) for d in data]


def test_byte_bpe_blocks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    bpe = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    some = texts(40)[:90]
    assert list(bpe.encode(some)) == [np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for t in some]


def test_token_files(spark, tmp_path):
    rows = list(enumerate(texts())) + [(None, "a b"), (1, "once"), (1, "twice")]
    random.Random(3).shuffle(rows)
    path = P.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, rows).repartition(5), f"{tmp_path}/t", path)
    read = token_files.read_tokens(spark, f"{tmp_path}/t")
    library = Tokenizer.from_file(path)
    want, tail = {}, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in tail:
        want.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    got = read.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == sorted((d is None, d or 0, i) for d, x in want.items() for i in x)
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place and r.n_tokens == len(r.ids)
        place += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.with_crc32(read).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    token_files.write_tokens(table(spark, []), f"{tmp_path}/e", path)
    assert token_files.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_chunk_encoder_blocks_of_long_texts(monkeypatch):
    encoder, library = token_files.ChunkEncoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = "Thon, it's\n" * 200_000 + "a" * 5000
    assert np.frombuffer(encoder.encode([text])[0], np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    for _ in range(3):
        encoder.encode(["b c d e", "f g h", "Él, É; x"])
    assert np.frombuffer(encoder.encode(["b c d e f g b"])[0], np.uint32).tolist() == library.encode("b c d e f g b", add_special_tokens=False).ids


def test_token_counts(spark):
    rows = list(enumerate(texts())) + [(None, "a b"), (1, "")]
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.token_counts(table(spark, rows), path, 50).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for d, t in rows]
    key = lambda r: (r[0] is not None, r)[0:1] + (r[0] or 0, *r[1:])
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 16), (200, 30)])
def test_spliced_counts(chunk, overlap):
    counter = token_counts.Counter(P.path("byte_bpe_50k.json"))
    for text in texts(60):
        text = (text or "")[:6000]
        assert counter.spliced(text, chunk, overlap) == len(counter.library.encode(text, add_special_tokens=False).ids)
