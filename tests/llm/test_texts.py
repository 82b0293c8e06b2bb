from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from boxoffice.llm import decontamination, jaccard_join, language_id, license_scan, ngram_trie
from boxoffice.llm import quality_rules as rules
from boxoffice.llm import components as components_of
from boxoffice.llm.components import connected_components
from boxoffice.llm.decontamination import contaminated
from boxoffice.llm.jaccard_join import jaccard_components
from boxoffice.llm.language_id import identify_languages
from boxoffice.llm.license_scan import scan_licenses, scan_sql
from boxoffice.llm.mixing import mix, pivot, source_targets
from boxoffice.llm.ngram_trie import language_model_scores
from boxoffice.llm.quality_rules import quality_rules
from boxoffice.llm.shingles import shingle_sets
from boxoffice.llm.textkit import fingerprints, text_bytes
from boxoffice.llm.textkit import words as word_spans
from tests.llm.plain import components, edit_distance_in, odd_texts, prose, repeat_words, shingles, words


def documents(spark, rows):
    """Rows of (doc_id, text), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "a", None) for i, t in rows], "doc_id long, text string, score string, component_id long")


# 1 N-gram Jaccard join


def near_copies(seed: int, groups: int, size: int, n: int) -> list[str]:
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = prose(rng, n).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                own[rng.randrange(n)] = prose(rng, 1)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "percent", "large"), [(3, 90, 32), (3, 90, 3), (5, 80, 4)])
def test_jaccard_components(spark, k, percent, large):
    texts = odd_texts() + near_copies(1, 3, 25, 130) + near_copies(2, 6, 5, 30) + near_copies(3, 2, 4, 900)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(spark, rows), k, percent, large=large).collect()}
    want = components(dict(rows), k, percent)
    assert got == {i: (len(shingles(t, k)), want[i]) for i, t in rows}


def test_jaccard_components_of_odd_rows(spark):
    rows = [(None, "some words that are here"), (4, "some words that are here"), (4, "some words that are here"), (None, None), (7, None), (8, ""), (None, "alone at last")]
    got = sorted(jaccard_components(documents(spark, rows)).collect(), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        [(None, 3, 4), (4, 3, 4), (4, 3, 4), (None, 0, None), (7, 0, 7), (8, 0, 8), (None, 1, None)], key=str
    )
    assert jaccard_components(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_sketches_of_similar_sets_agree_in_a_block(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(2, 60), 90, 141, 142, 500, 5000]:
        for _ in range(6):
            shared = -(-percent * n // 100)
            a = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, n - shared + 1)
            b = np.unique(np.append(rng.permutation(a)[drop:], rng.integers(1, 2**63, int(n - shared - drop)).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both) or both == len(a) == len(b):
                continue
            keys, at = jaccard_join.sketch_keys(np.append(a, b), np.array([0, len(a), len(a) + len(b)]), percent)
            assert np.intersect1d(keys[: at[1]], keys[at[1] :]).size


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in parent.items() if x in got} and set(got) >= {x for a, b in edges if a != b for x in (a, b)}


def test_components_of_long_chains_need_few_tables(spark, monkeypatch):
    """Tasks join the edges that they hold: a chain of 3,000 nodes in each of 4 tasks needs no star at all, and
    chains that cross all tasks few of them."""
    written, write = [], components_of.materialize
    monkeypatch.setattr(components_of, "materialize", lambda df, label, *more: written.append(label) or write(df, label, *more))
    node = "id % 3000 + 10000 * (id div 3000)"
    chains = spark.range(0, 12_000, 1, 4).filter("id % 3000 > 0").selectExpr(f"{node} as a", f"{node} - 1 as b")
    got = {r.node: r.component for r in connected_components(chains).collect()}
    assert got == {x: x // 10_000 * 10_000 for k in range(4) for x in range(10_000 * k, 10_000 * k + 3_000)}
    assert len(written) <= 2
    crossing = spark.range(1, 400).selectExpr("id as a", "id - 1 as b").repartition(4)
    assert {r.component for r in connected_components(crossing).collect()} == {0}


def test_rare_keys_alone_leave_the_tasks(spark, monkeypatch):
    """Rows of shingles are those of the prefixes, not all shingles of the members."""
    written, write = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, label, *more: written.append((label, write(df, label, *more))) or written[-1][1])
    texts = near_copies(7, 5, 6, 60)
    sets = [shingles(t, 3) for t in texts]
    members = spark.createDataFrame([(k, len(x), k) for k, x in enumerate(sets)], "rep long, n long, label long")
    jaccard_join.rare_keys(members, spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 3, 80).collect()
    rows = sum(df.count() for label, df in written if "key" in df.columns)
    assert rows == sum(len(x) - -(-len(x) * 80 // 100) + 1 for x in sets)


def test_rare_keys_of_one_set_stay_in_the_tasks(spark, monkeypatch):
    """Members that share a passage and nothing else send no rows for the shingles that they alone hold, and
    similar ones among them are still linked."""
    written, write = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, label, *more: written.append((label, write(df, label, *more))) or written[-1][1])
    rng = random.Random(9)
    passage = prose(rng, 40)
    texts = near_copies(7, 3, 6, 60) + [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(60)]
    sets = [shingles(t, 3) for t in texts]
    members = spark.createDataFrame([(k, len(x), k) for k, x in enumerate(sets)], "rep long, n long, label long")
    rows = jaccard_join.rare_keys(members, spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 3, 80, least=2).collect()
    held = Counter(x for s in sets for x in s)
    alone = sum(held[x] == 1 for s in sets for x in s)
    sent = sum(df.count() for label, df in written if "key" in df.columns)
    # Some cells are shared by chance, so that a few rows more may go.
    assert alone > 4000 and sent <= sum(min(sum(held[x] > 1 for x in s), len(s) - -(-len(s) * 80 // 100) + 1) for s in sets[:18]) + 20
    keys: dict[int, set] = {k: set() for k in range(len(texts))}
    for r in rows:
        keys[r.rep].add(r.key)
    similar = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert similar and all(keys[a] & keys[b] for a, b in similar)


# 2 LM scoring


def model_of(rows, add=0.1, mass=2.0):
    tokens = {i: [*words(t), "\0end"] for i, t in rows}
    learnt = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    one = Counter(w for i in learnt for w in tokens[i])
    two = Counter(p for i in learnt for p in zip(tokens[i], tokens[i][1:], strict=False))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + add) / (n + add * (v + 1))
    out = {}
    for i, own in tokens.items():
        steps = [p(own[0])] + [(two[u, w] + mass * p(w)) / (one[u] + mass) for u, w in zip(own, own[1:], strict=False)]
        out[i] = (len(own), sum(one[w] > 0 for w in own), n, sum(map(math.log10, map(p, own))), sum(map(math.log10, steps)))
    return out


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "PAIRS_A_FILE", 2000)  # several files
    monkeypatch.setattr(ngram_trie, "WORDS_A_FILE", 100)
    rng = random.Random(11)
    texts = odd_texts() + [prose(rng, 3) + " " + t for t in odd_texts(8)[20:]] + ["Ka lo ka lo ka"] * 9
    rows = list(enumerate(texts))
    want = model_of(rows)
    for r in language_model_scores(documents(spark, rows)).collect():
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) <= 0.002 * n + 1e-6


def test_language_model_of_nothing(spark):
    docs = documents(spark, [(None, None), (None, "a b"), (2, "a b a b")])
    assert {r.n_tokens for r in language_model_scores(docs).collect()} == {1, 3, 5}
    assert language_model_scores(docs.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = language_model_scores(documents(spark, [(held, "new")])).first()
    assert (only.train_tokens, only.n_known, only.base_score) == (0, 0, 0.0)


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [(i, "a b a c a b d") for i in range(1, 9)]
    files = ngram_trie.build_words(documents(spark, rows).select("text"), ngram_trie.unique_name(ngram_trie.shared_dir(spark), "trie"), 0.1, 2.0)
    files = ngram_trie.build_pairs(documents(spark, rows).select("text"), ngram_trie.unique_name(ngram_trie.shared_dir(spark), "trie"), files)
    trie = ngram_trie.Trie(files)
    count = ngram_trie._counts(trie, np.arange(files.vocabulary))
    single = 10 ** trie.log_unigram(count)
    for u in range(files.vocabulary):
        given = trie.log_given(np.full(files.vocabulary, u), np.arange(files.vocabulary))
        unseen = 2.0 / (count[u] + 2.0)
        some = np.where(np.isnan(given), unseen * single, 10 ** np.nan_to_num(given))
        # What is left is for words that are not known.
        assert some.sum() + unseen * 0.1 / trie.unigram_floor == pytest.approx(1, abs=0.02) or count[u] == 8


def test_blocks_of_short_sets_have_few_members(spark, monkeypatch):
    texts = spark.createDataFrame([(k, "a b c") for k in range(300)], "id long, text string")
    rows = spark.createDataFrame([(1, k, 5, 0, k) for k in range(300)], "key long, rep long, n int, lead long, label long")
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 2400)
    monkeypatch.setattr(jaccard_join, "_block_links", lambda shingle, percent: lambda table: pa.table({"a": [10_000 + table.num_rows], "b": [0]}))
    assert max(r.a for r in jaccard_join._family_links(rows, texts, 3, 80).collect()) < 10_270


def test_rows_without_an_id_link_others(spark):
    base = [f"w{k}" for k in range(60)]
    other, third = [*base[:59], "x"], ["y", *base[1:59], "x"]
    rows = [(1, " ".join(base)), (None, " ".join(other)), (3, " ".join(third)), (None, "quite alone here")]
    got = jaccard_components(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got if r.n_shingles > 10) == [("1", 1), ("3", 1), ("None", 1)]
    assert [r.component_id for r in got if r.n_shingles < 10] == [None]


@pytest.mark.parametrize("percent", [80, 90])
def test_rare_keys_meet_for_similar_sets(spark, percent):
    """Every similar pair shares a key, and texts that share a common passage alone do not."""
    rng = random.Random(6)
    passage = prose(rng, 50)
    texts = near_copies(7, 5, 6, 60) + [prose(rng, 12) + " " + passage + " " + prose(rng, 12) for _ in range(60)]
    sets = [shingles(t, 3) for t in texts]
    members = spark.createDataFrame([(k, len(x), k) for k, x in enumerate(sets)], "rep long, n long, label long")
    rows = jaccard_join.rare_keys(members, spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 3, percent).collect()
    keys: dict[int, set] = {k: set() for k in range(len(texts))}
    for r in rows:
        keys[r.rep].add(r.key)
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            assert keys[a] & keys[b] or 100 * both < percent * len(sets[a] | sets[b])
    assert not any(keys[k] for k in range(len(texts) - 60, len(texts)))


@pytest.mark.parametrize("chain", [False, True])
def test_links_grow_with_a_family_and_not_its_pairs(spark, monkeypatch, chain):
    """Four times the members write about four times the links: copies of one text, and chains in which
    only neighbours are similar."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 1500)
    written, rng = [], random.Random(5)
    for size in (100, 400):
        base = own = prose(rng, 60).split()
        texts = []
        for _ in range(size):
            own = list(own if chain else base)
            own[rng.randrange(60)] = prose(rng, 1)
            texts.append(" ".join(own))
        rows = list(enumerate(texts))
        buckets = spark.createDataFrame([(1, k, 58, 0, k) for k in range(size)], "key long, rep long, n int, lead long, label long")
        links = jaccard_join._family_links(buckets, spark.createDataFrame(rows, "id long, text string"), 3, 80).collect()
        want = components(dict(rows), 3, 80)
        label = list(range(size))
        for a, b in links:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        assert label == [want[k] for k in range(size)]
        written.append(len(links))
    assert written[1] <= (5.5 if chain else 4.5) * written[0]


def test_strips_give_the_same_links(monkeypatch):
    texts = near_copies(9, 12, 5, 30)
    table = pa.table({"label": list(range(len(texts))), "own": [0] * len(texts), "text": texts})
    want = components(dict(enumerate(texts)), 3, 70)
    for rows in (7, 1024):
        monkeypatch.setattr(jaccard_join, "STRIP_ROWS", rows)
        got = jaccard_join._block_links(3, 70)(table)
        label = list(range(len(texts)))
        for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        assert label == [want[k] for k in range(len(texts))] and len(set(label)) < len(texts)


# 4 Benchmark decontamination


def test_contaminated(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (1, 2, 3, 5, 7, 8, 15, 30, 59)] + [None, "", "  "]
    rows, planted = [], {}
    for k, item in enumerate(items[:9]):
        rows.append((k, prose(rng, 40) + " " + item.upper().replace(" ", "\n") + " " + prose(rng, 40)))
        planted[k, k] = 0
    for k in (6, 7, 8):
        own = items[k].split()
        own[len(own) // 2] = "other"
        own.insert(3, "more")
        del own[-2]
        rows.append((50 + k, prose(rng, 20) + " " + " ".join(own)))
    rows += [(None, items[7]), (90, None), (91, ""), (92, prose(rng, 20_000) + " " + items[8]), (93, items[7]), (93, items[7])]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    found = contaminated(documents(spark, rows), bench).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(words(t))
    best = {(r.doc_id, r.item_id): r.edits for r in found}
    for (i, k), edits in best.items():
        assert any(edit_distance_in(words(items[k]), own) == edits for own in texts[i])
    for r in found:
        assert any(edit_distance_in(words(items[r.item_id]), own[r.start_word : r.start_word + r.n_words]) == r.edits for own in texts[r.doc_id])
    want = {(i, k) for i, owns in texts.items() for own in owns for k, item in enumerate(items) if words(item) and edit_distance_in(words(item), own) <= int(0.2 * len(words(item)))}
    exact = {(i, k) for i, owns in texts.items() for own in owns for k, item in enumerate(items) if words(item) and f" {' '.join(words(item))} " in f" {' '.join(own)} "}
    assert exact <= set(best) <= want and len(set(best)) >= 0.9 * len(want)
    assert sum((r.doc_id, r.item_id) == (93, 7) for r in found) == 2
    blocks = contaminated(documents(spark, rows), bench, block_bytes=200).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, found))
    assert contaminated(documents(spark, rows).limit(0), bench).count() == contaminated(documents(spark, rows), bench.limit(0)).count() == 0


def test_recall_of_changed_items():
    rng = random.Random(0)
    items = [prose(rng, rng.randint(15, 60)) for _ in range(80)]
    docs = []
    for item in items:
        own = item.split()
        for _ in range(int(0.2 * len(own))):
            at, kind = rng.randrange(len(own)), rng.random()
            own[at : at + 1] = [] if kind < 0.3 else ["new"] if kind < 0.6 else [own[at], "more"]
        docs.append(" ".join([prose(rng, 20), *own, prose(rng, 20)]))
    index = decontamination.index_items(list(range(80)), pa.array(items), 0.2, 3)
    low, starts, ends, at = word_spans(*text_bytes(pa.array(docs)))
    doc, item, *_ = decontamination.find_in(index, fingerprints(low, starts, ends), at)
    assert len(set(zip(doc.tolist(), item.tolist(), strict=True)) & {(k, k) for k in range(80)}) >= 76


@pytest.mark.parametrize("walks_alone", [False, True])
@pytest.mark.parametrize("n", [1, 2, 3, *range(4, 29), 40])
def test_recall_by_item_length(n, walks_alone, monkeypatch):
    if walks_alone:
        monkeypatch.setattr(decontamination, "pieces", lambda size, edits: (np.zeros(0, np.int64),) * 3)
    rng = random.Random(n)
    name = lambda: f"w{rng.randrange(10**6)}"
    items = [[name() for _ in range(n)] for _ in range(300)]
    docs = list(items)
    for item in items:
        own = list(item)
        for _ in range(int(0.2 * n)):
            at, kind = rng.randrange(len(own)), rng.random()
            own[at : at + 1] = [] if kind < 0.3 else [name()] if kind < 0.6 else [own[at], name()]
        docs.append([name() for _ in range(10)] + own + [name() for _ in range(10)])
    index = decontamination.index_items(list(range(300)), pa.array([" ".join(x) for x in items]), 0.2, 3)
    low, starts, ends, at = word_spans(*text_bytes(pa.array([" ".join(x) for x in docs])))
    doc, item, *_ = decontamination.find_in(index, fingerprints(low, starts, ends), at)
    found = set(zip(doc.tolist(), item.tolist(), strict=True))
    assert {(k, k) for k in range(300)} <= found
    assert sum((300 + k, k) in found for k in range(300)) >= (285 if walks_alone else 300)


def test_places_are_expanded_in_parts(monkeypatch):
    """Many items with one common word in many places give the same whatever is expanded at once."""
    items = [f"the w{k} the" for k in range(40)]
    docs = ["the " * 60, " ".join(items), "the w3 the the w5 the"]
    index = decontamination.index_items(list(range(40)), pa.array(items), 0.34, 2)
    low, starts, ends, at = word_spans(*text_bytes(pa.array(docs)))
    found = []
    for limit in (1 << 20, 50):
        monkeypatch.setattr(decontamination, "EXPANDED", limit)
        found.append([x.tolist() for x in decontamination.find_in(index, fingerprints(low, starts, ends), at)])
    assert found[0] == found[1] and len(found[0][0]) >= 80


def test_unchanged_items_of_any_length_are_found():
    items = [" ".join(["same"] * n) for n in range(1, 40)] + [f"w{k} " * n for n in range(1, 40) for k in range(20)]
    index = decontamination.index_items(list(range(len(items))), pa.array(items), 0.0, 3)
    low, starts, ends, at = word_spans(*text_bytes(pa.array(items)))
    doc, item, *_ = decontamination.find_in(index, fingerprints(low, starts, ends), at)
    assert {(k, k) for k in range(len(items))} <= set(zip(doc.tolist(), item.tolist(), strict=True))


# 5 Language ID


def tongue(rng: random.Random, sounds: list[str], n: int) -> str:
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(4)
    sounds = {"xx": ["ka", "mo", "tu", "la"], "yy": ["sch", "ein", "ung", "ver"], "zz": ["дом", "ли", "ка"]}
    rows = [(i, tongue(rng, sounds[lang], rng.randint(4, 60)), lang) for i in range(240) for lang in [rng.choice(list(sounds))]]
    odd = [(900, None, "xx"), (901, "", None), (902, "123 !!! ...", "yy"), (None, "ka mo tu la ka", None), (903, "KA MO TU LA " * 4000, None), (1, rows[1][1], "xx")]
    docs = spark.createDataFrame([(*r, "src", 1.0) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    got = identify_languages(docs, max_rows=90).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[None].lang_pred == by[903].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got) and len(got) == 246
    assert {r.lang_pred for r in identify_languages(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang is null")).collect()} <= {"und"}
    assert identify_languages(docs.limit(0)).count() == 0


def plain_grams(text: str) -> Counter:
    """Buckets of the 1- to 3-grams of a text, by character."""
    chars = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text]
    found, m = Counter(), 1 << 32
    for i in range(len(chars)):
        for n in (1, 2, 3):
            gram = chars[i : i + n]
            if len(gram) < n or gram == [" "] or any(a == b == " " for a, b in zip(gram, gram[1:])):
                continue
            code = ord(gram[0]) * 0x9E3779B1 % m
            for c in gram[1:]:
                code = (code * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % m
            found[((code ^ (code >> 15)) * 0x27D4EB2F % m) >> (32 - language_id.BITS)] += 1
    return found


def test_language_id_against_a_plain_fit(spark):
    """The same rows, learnt by loops over dictionaries: the same predictions and scores."""
    rng = random.Random(6)
    sounds = {"xx": ["ka", "mo", "tu", "la"], "yy": ["ka", "ein", "ung", "mo"], "zz": ["дом", "ли", "ка"]}
    rows = [(i, tongue(rng, sounds[lang], rng.randint(2, 8)), lang) for i in range(90) for lang in [rng.choice(list(sounds))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    draw = {r.id: r.d for r in spark.createDataFrame(learnt, "id long, text string, lang string").selectExpr("id", f"pmod(xxhash64(cast(id as string), text, lang, 'sample'), {language_id.DRAWS}) d").collect()}
    learnt.sort(key=lambda r: draw[r[0]])
    names = sorted(sounds)
    counts = [plain_grams(t) for _, t, _ in learnt]
    frequency = Counter(b for c in counts for b in c)
    idf = lambda b: math.log((1 + len(learnt)) / (1 + frequency[b])) + 1
    features = lambda c: {**{b: 30 * idf(b) * k / sum(c.values()) for b, k in c.items()}, -1: 1.0}
    z, n = defaultdict(float), defaultdict(float)

    def weight(b, k):
        pull = max(abs(z[b, k]) - 0.02, 0.0)
        return -math.copysign(pull, z[b, k]) / ((1 + math.sqrt(n[b, k])) / 0.5 + 0.05)

    def chances(x, t=1.0):
        sums = [sum(v * weight(b, k) for b, v in x.items()) / t for k in range(3)]
        grown = [math.exp(v - max(sums)) for v in sums]
        return [v / sum(grown) for v in grown]

    for _ in range(4):
        for at, (_, _, lang) in enumerate(learnt):
            if at % 5 == 4:
                continue
            x = features(counts[at])
            p = chances(x)
            for b, v in x.items():
                for k in range(3):
                    w, g = weight(b, k), v * (p[k] - (names[k] == lang))
                    z[b, k] += g - (math.sqrt(n[b, k] + g * g) - math.sqrt(n[b, k])) / 0.5 * w
                    n[b, k] += g * g
    held = [at for at in range(len(learnt)) if at % 5 == 4]
    loss = lambda t: -sum(math.log(max(chances(features(counts[at]), t)[names.index(learnt[at][2])], 1e-12)) for at in held)
    model = language_id.train(spark.createDataFrame(learnt, "id long, text string, lang string"))
    # The temperature found is as good as any on a grid.
    assert loss(model.temperature) <= min(loss(math.exp(k / 10)) for k in range(-29, 30)) + 1e-6
    for i, text, _ in rows:
        p = chances(features(plain_grams(text)), model.temperature)
        assert got[i].score == pytest.approx(max(p), abs=1e-9)
        assert p[names.index(got[i].lang_pred)] == pytest.approx(max(p))


def test_training_sample_is_as_large_as_asked(spark, monkeypatch):
    rng = random.Random(5)
    sounds = {"xx": ["ka", "mo", "tu", "la"], "yy": ["sch", "ein", "ung", "ver"], "zz": ["дом", "ли", "ка"], "ww": ["oo", "pi"]}
    text = lambda lang: tongue(rng, sounds[lang], 20)
    rows = [(None, text("xx"), "xx") for _ in range(300)] + [(7, text("yy"), "yy") for _ in range(300)]
    rows += [(k, text("zz"), "zz") for k in range(50)] + [(900, text("zz"), "zz")] * 2000 + [(None, t, "ww") for t in [text("ww") for _ in range(8)] * 50]
    learnt, fit = [], language_id.fit_ftrl
    monkeypatch.setattr(language_id, "fit_ftrl", lambda samples, labels, classes: learnt.append(Counter(labels.tolist())) or fit(samples, labels, classes))
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    model = language_id.train(docs.repartition(5), max_rows=120, held=1000)
    assert model.languages == ["ww", "xx", "yy", "zz"] and learnt == [Counter({0: 8, 1: 30, 2: 30, 3: 30})]
    again = language_id.train(docs.repartition(3), max_rows=120, held=1000)
    assert np.array_equal(model.table, again.table)
    found = model.logits(pa.array([text(lang) for lang in model.languages])).argmax(axis=1)
    assert found.tolist() == [0, 1, 2, 3]


# 6 Mixing


def poured(sizes: dict, share=1.5, cap=2.0, weights=(5, 2, 1)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    goal, full = share * sum(sizes.values()), set()
    while True:
        left = goal - sum(cap * sizes[s] for s in full)
        rest = [s for s in order if s not in full]
        target = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if target[s] > cap * sizes[s]}
        if not over:
            return target | {s: cap * sizes[s] for s in full}
        full |= over


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["b", "a", None, "é", "z", "", "big", "big", "big"])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "a"), (None, "x y z", "b"), (5, rows[5][1], rows[5][2]), (1002, None, "empty")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, target int")
    got = mix(docs, keep=("source",)).collect()
    sizes, taken, longest = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    for r in got:
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    want = poured(dict(sizes))
    assert {r.source: r.target for r in got} == {s: pytest.approx(t) for s, t in want.items()}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes) and len(got) == len(rows)
    again = mix(docs.repartition(5), keep=("source",)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix(docs.limit(0)).count() == 0 and source_targets(docs.limit(0).selectExpr("source", "doc_id as size")).count() == 0


def test_pivot_keeps_sums_and_chances():
    rng = np.random.default_rng(1)
    sizes, chances = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(1500):
        out = pivot(sizes, chances, rng.random(40))
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1 and abs((out * sizes).sum() - (chances * sizes).sum()) < 1e-6
        total += out
    assert np.abs(total / 1500 - chances).max() < 0.06


# 7 Quality rules


def test_quality_rules(spark):
    rng = random.Random(9)
    line = "The line that comes again in every text."
    rows = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(rng.randint(3, 9))), "en" if i % 2 else None, "s" if i % 3 else None) for i in range(400)]
    junk = [(1000 + i, " ".join(w.upper() + "!!&&&" for w in prose(rng, 60).split()), "en", "s") for i in range(12)]
    odd = [(2000, None, None, None), (2001, "", "en", "s"), (2002, (prose(rng, 12) + " ") * 300, "en", "s"), (2003, "\n".join([line] * 4 + [prose(rng, 30)]), "xx", "few"), (None, prose(rng, 50), "en", "s"), (7, rows[7][1], "en", "s"), (2004, prose(rng, 20_000), "en", "s")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + junk + odd], "doc_id long, text string, lang string, source string, kept int")
    got = quality_rules(docs).collect()
    texts = defaultdict(list)
    for i, t, *_ in rows + junk + odd:
        texts[i].append(t or "")
    for r in got:
        t = texts[r.doc_id][0]
        own = t.split()
        lines = [x for x in t.split("\n") if x.split()]
        repeats = repeat_words(t)
        want = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats, len(own) < 20 or 100 * repeats > 30 * len(own))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert not any(by[1000 + i].kept for i in range(12)) and sum(by[i].kept for i in range(400)) >= 398
    assert len(got) == len(rows + junk + odd) and quality_rules(docs.limit(0)).count() == 0
    assert quality_rules(docs.filter("doc_id = 2004")).first().kept


def plain_distances(x: np.ndarray, share: float = 0.75) -> tuple[np.ndarray, int]:
    """Squared robust distances of one group, and the start that went on."""
    n, p = x.shape
    floors = np.array(list(rules.STATS.values()))
    grow = share / rules._chi2_below(rules.chi2_quantile(share, p), p + 2)

    def quantile(bins, part):
        return np.sort(bins)[math.ceil(n * part) - 1]

    def median(values):
        return (np.array([quantile(np.floor(v * 256), 0.5) for v in values.T]) + 0.5) / 256

    def d2(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def again(mean, cov):
        bins = np.floor(64 * np.log2(np.clip(d2(mean, cov), 2.0**-40, 2.0**60)))
        own = x[bins <= quantile(bins, share)]
        return own.mean(axis=0), grow * np.cov(own.T, ddof=0) + np.diag(floors**2)

    middle = median(x)
    scale = np.maximum(1.4826 * median(np.abs(x - middle)), floors)
    z = (x - middle) / scale
    signs = z / np.sqrt(np.maximum((z**2).sum(axis=1), 1e-12))[:, None]
    fits = [(middle, np.diag(scale**2)), (middle, p * (signs.T @ signs / n) * np.outer(scale, scale) + np.diag(floors**2))]
    for _ in range(2):
        fits = [again(*fit) for fit in fits]
    start = int(np.argmin([np.linalg.slogdet(cov)[1] for _, cov in fits]))
    mean, cov = fits[start]
    for _ in range(2):
        mean, cov = again(mean, cov)
    return d2(mean, cov), start


def test_robust_distances_against_plain(spark):
    rng = np.random.default_rng(8)
    p = len(rules.NAMES)
    groups, starts = {}, set()
    for k in range(8):
        root = rng.normal(size=(p, p)) * rng.uniform(0.2, 2, size=p)
        x = rng.normal(size=(90, p)) @ root
        x[: 5 * (k % 5)] += 6 * rng.normal(size=p)
        groups[f"g{k}"] = x
    groups["one"], groups["same"] = rng.normal(size=(1, p)), np.tile(rng.normal(size=p), (30, 1))
    rows = [(g, i, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "fit_group string, i int, " + ", ".join(f"{n} double" for n in rules.NAMES)).repartition(4)
    got = {(r.fit_group, r.i): r.d2 for r in rules.robust_distances(df).collect()}
    assert len(got) == len(rows)
    bound = rules.chi2_quantile(0.99999, p)
    for g, x in groups.items():
        want, start = plain_distances(x)
        mine = np.array([got[g, i] for i in range(len(x))])
        starts.add(start)
        assert mine == pytest.approx(want, rel=1e-6, abs=1e-9) and ((mine <= bound) == (want <= bound)).all()
    assert starts == {0, 1}


def test_kept_against_plain(spark):
    rng = random.Random(10)
    rows = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(rng.randint(3, 9))), "en", "s") for i in range(150)]
    rows += [(500 + i, " ".join(w for w in prose(rng, 30).split() for _ in range(rng.randint(2, 4))), "en", "s") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = rules.statistics(docs.select("doc_id", "text")).collect()
    passed = [r for r in stats if r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words]
    want, _ = plain_distances(np.array([[r[n] for n in rules.NAMES] for r in passed]))
    kept = {r.doc_id for r, d in zip(passed, want, strict=True) if d <= rules.chi2_quantile(0.99999, len(rules.NAMES))}
    assert {r.doc_id for r in quality_rules(docs).collect() if r.kept} == kept
    assert not any(500 + i in kept for i in range(9)) and len(kept) >= 148
    texts = {r[0]: r[1].split() for r in rows}
    for r in stats:
        own = texts[r.doc_id]
        assert r.x_stutter == pytest.approx(sum(a == b for a, b in zip(own, own[1:])) / len(own))


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(3)
    p = len(rules.NAMES)
    root = rng.normal(size=(p, p))
    cov, mean, x = root @ root.T + np.eye(p), rng.normal(size=p), rng.normal(size=(5, p))
    lit = rules.F.lit
    df = spark.createDataFrame([("a", *map(float, row)) for row in x], "g string, " + ", ".join(f"{n} double" for n in rules.NAMES))
    fit = spark.range(1).select(lit("a").alias("own_g"), lit(0).alias("start"), *[lit(float(m)).alias(f"m_{n}") for n, m in zip(rules.NAMES, mean, strict=True)])
    fit = rules.factors(fit, {(i, j): lit(float(cov[i, j])) for i in range(p) for j in range(i, p)})
    got = [r.d2 for r in rules.distances(df, fit).collect()]
    assert sorted(got) == pytest.approx(sorted(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)))
    assert fit.first().log_det == pytest.approx(np.linalg.slogdet(cov)[1])
    for degrees, want in ((1, 3.8415), (6, 12.5916), (7, 14.0671)):
        assert rules.chi2_quantile(0.95, degrees) == pytest.approx(want, abs=1e-3)


# 10 License scans


def test_license_scan_against_sql(spark):
    import duckdb

    rng = random.Random(12)
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    some = ["MIT-License mit license", "the Apache\nLicense and General public LICENSE", notice.replace(",", ",\n"), notice[:200], "mit_license MİT license", "Licensed under CC BY-NC 4.0.", "all rights are reserved; rights", "All rights reserved"]
    texts = odd_texts() + some + [prose(rng, 30) + "\n\n" + t + "\n" + prose(rng, 30) for t in some] + ["license " * 3000]
    docs = spark.createDataFrame([(None if i == 2 else i, t, "x") for i, t in enumerate(texts)] + [(40, texts[40], "x")], "doc_id long, text string, labels string")
    got = sorted(str(tuple(r)) for r in scan_licenses(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas().convert_dtypes()[["doc_id", "text"]])
    want = sorted(str(tuple(r)) for r in con.execute(scan_sql()).fetchall())
    assert got == want and any("mit" in r for r in got) and scan_licenses(docs.limit(0)).count() == 0


def test_wrapped_license_notices(spark):
    import duckdb

    rng = random.Random(13)
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of it was not given"
    texts = {
        "mpl": [mpl, prose(rng, 30) + "\n" + mpl + "\n" + prose(rng, 30), "\n".join(mpl.split()), mpl.replace("\n", " \r\n")],
        "cc-by-sa": ["Licensed under the Creative Commons\nAttribution ShareAlike 4.0\nInternational License."],
        "cc-by-nc": ["x\n# Licensed under CC\n# BY-NC 4.0."],
        "reserved": ["all Rights\nreserved"],
        "": ["all Rights\n\nreserved", "all\n" + prose(rng, 50) + " rights\n" + prose(rng, 50) + " reserved", None, "", "\n"],
    }
    rows = [(k, t, "x", label) for k, (label, t) in enumerate((label, t) for label, ts in texts.items() for t in ts)]
    docs = spark.createDataFrame([*rows, (None, mpl, "x", "mpl"), rows[0]], "doc_id long, text string, labels string, want string")
    want = sorted((str(r.doc_id), r.want) for r in docs.collect())
    got = scan_licenses(docs).collect()
    assert sorted((str(r.doc_id), r.labels) for r in got) == want
    assert all((r.score >= 0.8) == (r.labels != "") for r in got)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().convert_dtypes()[["doc_id", "text"]])
    assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in con.execute(scan_sql()).fetchall())


def test_texts_that_may_hold_a_template(spark):
    """The filter on whole texts keeps every text that holds as many of a template's words as it takes."""
    rng, sets = random.Random(14), license_scan._template_sets(license_scan.TEMPLATES)
    texts = []
    for _, _, own in sets:
        need = max(1, -int(-(0.8 * len(own) - 1e-9) // 1))
        texts += [" ".join(rng.sample(own, need)).upper() for _ in range(12)]
    kept = spark.createDataFrame([(t,) for t in texts], "text string").filter(license_scan.may_hold(rules.F.col("text"), sets, 0.8))
    assert kept.count() == len(texts)


def test_shingle_sets():
    texts = odd_texts()
    h, at = shingle_sets(pa.array(texts), 3)
    assert np.diff(at).tolist() == [len(shingles(t, 3)) for t in texts]
