from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from boxoffice.llm.elias_fano import EliasFano
from boxoffice.llm.textkit import Memo, text_bytes
from boxoffice.llm.token_counts import token_counts
from boxoffice.llm.token_files import Encoder, read_token_files, token_folder, write_token_files
from boxoffice.llm.token_fst import NEXT, TokenCounter, compose
from tests.llm.plain import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\r\n", "\t", " ", "　", "a", "er", "The", "12", "٣", "!", "?!", "é", "日本", "😀", "<|endoftext|>", "<|", "xxxx", "\x1c", "ß"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def mixed_texts(n: int) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_counts_and_ids_are_the_librarys(library):
    texts = [t or "" for t in odd_texts()] + mixed_texts(4000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    data, offsets = text_bytes(pa.array(texts))
    assert TokenCounter(PATH).count(data, offsets).tolist() == [len(w) for w in want]
    small = TokenCounter(PATH)
    small.merger.max_states = 50  # given up and built anew again and again
    assert [int(small.count(*text_bytes(pa.array([t])))[0]) for t in texts[:300]] == [len(w) for w in want[:300]]
    ids, lengths = Encoder(PATH).encode(data, offsets, 2)
    assert ids.tolist() == [i for w in want for i in [*w, 2]] and lengths.tolist() == [len(w) + 1 for w in want]


@pytest.mark.parametrize("stretch", [1, 3, 8, 64, 512])
def test_counts_of_pieces_in_chunks(library, stretch):
    rng = random.Random(5)
    signs = "=-#*/"
    long = ["x" * 3000, "ab" * 1500, "a" * 17 + "b" * 2000, "=" * 1537, "".join(rng.choice("abcde") for _ in range(2500)), "日本" * 700, "".join(rng.choice(signs) for _ in range(1999))]
    long += ["".join(rng.choice(["the", "ing", "er", "un"]) for _ in range(800)), "7" * 1100, " " * 2000 + "x", "e" * 512, "e" * 513, "e" * 1024]
    texts = long + mixed_texts(300) + [" ".join(long)]
    counter = TokenCounter(PATH)
    counter.merger.stretch = stretch
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(*text_bytes(pa.array(texts))).tolist() == want


def test_scan_of_maps_equals_one_after_the_other():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 11, (37, 11)).astype(np.uint8)
    state, want = np.arange(11), []
    for m in maps:
        want.append(state)
        state = m[state]
    assert (compose(maps) == np.array(want)).all() and NEXT.max() < 11


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 0), (5, 3), (700, 10**6), (3000, 2**62), (900, 30)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint64))
    some = EliasFano.of(EliasFano(values).parts())
    asked = np.append(np.random.default_rng(1).integers(0, top + 2, 300).astype(np.uint64), values[:50])
    assert (some.all() == values).all() and (some.get(np.arange(n)) == values).all()
    assert (some.successor(asked) == np.searchsorted(values, asked)).all()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert EliasFano(values).nbytes() * 8 < 100_000 * (2.3 + np.log2(1000) + 0.5)


def test_memo_grows():
    keys = np.unique(np.random.default_rng(0).integers(1, 2**63, 200_000).astype(np.uint64))
    memo = Memo(4)
    for part in np.array_split(keys, 7):
        memo.add(part, np.arange(len(part)))
    assert (memo.find(keys) >= 0).all() and memo.find(np.array([7, 9], np.uint64)).tolist() == [-1, -1]


def test_count_operator(spark, library):
    texts = odd_texts()
    rows = [(None if i == 3 else i, t, "own", 5) for i, t in enumerate(texts)] + [(5, texts[5], "again", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH, limit=100).collect())
    own = [(i, t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert got == sorted((i is None, i or 0, len(t.encode()), n, n > 100) for i, t, n in own)
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_files_round_trip(spark, library):
    texts = odd_texts()
    rows = [(None if i == 3 else i * 7 - 50, t, "x") for i, t in enumerate(texts)] + [(-50, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    manifest = write_token_files(docs, PATH, 2, token_folder(spark))
    got = {(r.start, r.doc_id): (r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect()}
    start, want = 0, {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[start, i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    assert read_token_files(write_token_files(docs.limit(0), PATH, 2, token_folder(spark))).count() == 0
