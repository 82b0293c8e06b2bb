from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from boxoffice.llm import perfect_hash
from boxoffice.llm.exact_dedup import DigestIndex, exact_dedup, text_prints
from boxoffice.llm.periodic_runs import Catchers, periodic_runs, run_digests, runs_of_texts
from boxoffice.functions.scale import materialize, shared_dir

from .plain import FOLD, odd_texts


def plain_runs(w: list, times: int = 4, least: int = 6) -> list[tuple]:
    """(start, length, period), found period by period."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found[i, j + p] = min(p, found.get((i, j + p), p))
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def periodic_words(rng: random.Random, letters: int) -> list[int]:
    out: list[int] = []
    while len(out) < rng.randint(0, 120):
        out += [rng.randrange(letters) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, 2, 4, 5, 7])
    return out


@pytest.mark.parametrize(("times", "least"), [(2, 2), (3, 6), (4, 6)])
def test_runs_of_many_texts(times, least):
    rng, names = random.Random(times), np.random.default_rng(1).integers(1, 2**63, 12, dtype=np.uint64)
    for _ in range(60):
        texts = [periodic_words(rng, rng.choice([1, 2, 3, 10])) for _ in range(rng.randint(1, 5))]
        at = np.cumsum([0, *map(len, texts)])
        got = runs_of_texts(names[np.array(sum(texts, []), int)], at, times, least)
        want = [(k, s, s + n, p) for k, t in enumerate(texts) for s, n, p in plain_runs(t, times, least)]
        assert [tuple(r) for r in got.tolist()] == want


def test_runs_are_the_same_however_words_arrive():
    rng = random.Random(3)
    for _ in range(60):
        w = np.array(periodic_words(rng, 2), np.uint64) + np.uint64(7)
        state, done = Catchers(2, 2), 0
        while done < len(w):
            to = min(len(w), done + rng.choice([1, 2, 5, 30]))
            state.append(w[done:to], np.arange(done, to))
            done = to
        assert [(s, e - s, p) for s, e, p in state.runs().tolist()] == plain_runs(w.tolist(), 2, 2)


def test_run_that_deceives_prefix_sums():
    """A word sequence whose halves have equal polynomial sums modulo 2**64."""
    signs = np.zeros(1, int)
    while len(signs) < 4096:
        signs = np.concatenate([signs, 1 - signs])
    w = np.concatenate([signs, 1 - signs]).astype(np.uint64) + np.uint64(3)
    state = Catchers(2, 2)
    state.append(w, np.arange(len(w)))
    found = {tuple(x) for x in state.runs().tolist()}
    assert all(w[s : e - p].tolist() == w[s + p : e].tolist() for s, e, p in found)
    assert {p for _, _, p in found} == {p for k in range(11) for p in (1 << k, 3 << k) if any(x[2] == p for x in found)}
    assert (0, 8192, 4096) not in found


def test_long_repetition_is_cheap():
    w = np.tile(np.arange(1, 1001, dtype=np.uint64), 200)
    assert runs_of_texts(w, np.array([0, len(w)])).tolist() == [[0, 0, 200_000, 1000]]


def digest_row(i, text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    gone = {x for s, size, p in runs for x in range(s + p, s + size)}
    lines = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_digests_against_loops(spark):
    texts = [t for t in odd_texts() if not t or len(t) < 9000]
    texts += ["a b " * 40 + "c", "x y z " * 3, "é ü " * 9, "one two three four " * 5 + "one two", "A a " * 10, "w" + " w" * 5, "w" + " w" * 4]
    rows = [(i, t, i) for i, t in enumerate(texts * 3)] + [(None, "a a a a a a a", 1), (5, None, 1), (5, "b b b b b b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    got = sorted(map(tuple, run_digests(docs).collect()), key=str)
    assert got == sorted((digest_row(i, t) for i, t, _ in rows), key=str)
    assert run_digests(docs.limit(0)).count() == 0


def test_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([("k", "go  a b\na b a b a b a stop"), ("k", None)], "doc_id string, text string")
    got = sorted((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    assert got == [("k", [], ""), ("k", [(1, 9, 2)], "go a b stop")]


def test_perfect_hash():
    keys = np.random.default_rng(2).integers(0, 2**63, (5000, 4), dtype=np.uint64)
    keys[1:2500, 0] = keys[0, 0]
    function = perfect_hash.build(keys)
    assert sorted(perfect_hash.slots(function, keys).tolist()) == list(range(5000))
    assert (perfect_hash.slots(function, keys[:0]).tolist(), perfect_hash.slots(perfect_hash.build(keys[:0]), keys[:2]).tolist()) == ([], [-1, -1])


def plain_dedup(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(FOLD), []).append(i)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        kept = [False] * len(ids)
        kept[ids.index(best)] = True
        out += [(i, best, len(ids), k, hashlib.sha256(text.encode()).hexdigest()) for i, k in zip(ids, kept, strict=True)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "shard_rows"), [(1, 1 << 18), (2, 20), (3, 1)])
def test_exact_dedup(spark, batches, shard_rows):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts + texts[::2])] + [(None, "Two words"), (None, "only here"), (None, "ONLY here"), (3, "one"), (3, "One"), (900, "one"), (900, "oNe"), (-4, "É"), (-5, "é")]
    rows += [(1000 + k, "hot") for k in range(200)]
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, digest binary, row int").repartition(5)
    got = sorted(map(tuple, exact_dedup(docs, batches=batches, shard_rows=shard_rows).collect()), key=str)
    assert got == plain_dedup(rows)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_keeps_older_batches(spark):
    """A later batch meets the digests of an earlier one, and its own new ones are found afterwards."""
    old, new = [(1, "a"), (2, "b"), (9, "a")], [(4, "B"), (5, "c"), (6, "c"), (3, "a")]
    index = DigestIndex(f"{shared_dir(spark)}/digests", 3)
    prints = [materialize(text_prints(spark.createDataFrame(r, "doc_id long, text string")), "prints") for r in (old, new)]
    for p in prints:
        index.add(p)
    first = index.resolve(prints[1], 4).collect()
    assert sorted((r.id, r.keep_id, r.group_size) for r in first) == [(3, 9, 3), (4, 4, 2), (5, 6, 2), (6, 6, 2)]
    unseen = materialize(text_prints(spark.createDataFrame([(7, "d")], "doc_id long, text string")), "prints")
    assert [(r.keep_id, r.group_size, r.kept) for r in index.resolve(unseen, 1).collect()] == [(None, 0, False)]
