from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from boxoffice.functions.scale import materialize
from tests.llm.plain import components, prose, words

SOUNDS = {"xx": ["ka", "mo", "tu", "la", "ri"], "yy": ["sch", "ein", "ung", "ver", "ß"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, sf = random.Random(8), str(tmp_path_factory.mktemp("sf"))
    bench = [prose(rng, 25) for _ in range(4)]
    rows = []
    for i in range(120):
        lang = rng.choice(list(SOUNDS))
        text = " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(12, 70)))
        rows.append((i, text, lang, rng.choice(["a", "b", None])))
    rows += [(200 + k, rows[k][1], rows[k][2], "b") for k in range(5)]
    rows += [(300 + k, rows[k][1] + " mo", rows[k][2], "a") for k in range(10, 16)]
    rows += [(400 + k, rows[20 + k][1] + " " + bench[k], "xx", "a") for k in range(4)]
    rows += [(500, None, "xx", "a"), (501, "", "xx", "a"), (502, "123 456", "xx", "a"), (None, rows[3][1], "xx", "b"), (None, "ka mo tu la ka ka mo", "xx", "b"), (7, rows[7][1], rows[7][2], rows[7][3])]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, bench


def ids(df) -> list:
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_stages(spark, folder):
    sf, bench = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = materialize(steps["language"](spark, docs, sf), "t")
    assert kept.columns == docs.columns and ids(kept) == sorted([r.doc_id for r in docs.collect() if r.doc_id not in (500, 501, 502)], key=str)

    single = materialize(steps["near_duplicates"](spark, kept, sf), "t")
    texts = {r.doc_id: r.text for r in kept.collect() if r.doc_id is not None}
    group = components(texts, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert single.columns == docs.columns and ids(single) == sorted([i for i in texts if group[i] == i] + [None], key=str)
    assert [r.text for r in single.filter("doc_id is null").collect()] == ["ka mo tu la ka ka mo"]

    clean = materialize(steps["decontaminated"](spark, single, sf), "t")
    dirty = [r.doc_id for r in single.collect() if any(" ".join(words(b)) in " ".join(words(r.text)) for b in bench)]
    assert len(dirty) == 4 and ids(clean) == sorted([i for i in (r.doc_id for r in single.collect()) if i not in dirty], key=str)

    mixed = materialize(steps["mixed"](spark, clean, sf), "t")
    total = sum(len(words(r.text)) for r in clean.collect())
    longest = max(len(words(r.text)) for r in clean.collect())
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(clean))
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * total) <= 3 * longest

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(mixed.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        own = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    got = [tuple(r) for r in steps["token_files"](spark, mixed, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    run = [tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(run, key=lambda r: r[1]) == want


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "ka mo tu la", "a", "xx", 1)] * 5 + [(None, "ri ri ri", "b", "xx", 1)] * 4
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), "t")
    out = [tuple(r) for r in corpus_pipeline.mixed(spark, docs, "").collect()]
    assert set(out) == set(rows) and abs(sum(4 if r[0] else 3 for r in out) - 1.5 * 32) <= 8


NAMES = ["hit", "head", "lot", "rows", "copies", "own", "taken", "n", "times", "of", "group", "node", "_pipeline_row", "_pipeline_lang", "_pipeline_lot", "id", "size"]


def test_further_columns_of_any_name(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = materialize(docs.selectExpr("*", *[f"{k} as `{name}`" for k, name in enumerate(NAMES)]), "t")
    for name, stage in corpus_pipeline.STAGES:
        plain, out = stage(spark, docs, sf), stage(spark, wide, sf)
        if name == "token_files":
            assert out.count() == plain.count()
        else:
            assert out.columns == wide.columns and ids(out) == ids(plain)


def test_rows_that_share_copies_and_differ_elsewhere(spark):
    rows = [(1, "ka mo tu la", "a", "xx", k % 3) for k in range(12)] + [(2, "ri ri", "a", "xx", 1)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), "t")
    out = [tuple(r) for r in corpus_pipeline.mixed(spark, docs, "").collect()]
    assert set(out) <= set(rows) and abs(sum(4 if r[0] == 1 else 2 for r in out) - 1.5 * 50) <= 4


def test_empty_tables(spark, folder):
    sf, _ = folder
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
