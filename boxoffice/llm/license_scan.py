"""License scans by an exact set-similarity join of text blocks with license templates.

A block contains a template if it has at least ``threshold`` of the template's distinct words. All
words of the templates are ordered by how many blocks have them, rarest first. A block that contains a
template must share a word with the template's prefix (so many rarest words that the others alone are
too few) and the first word they share must lie within the block's own prefix; a block with too few
words (length filter), or whose first shared word leaves too few words behind it in the block or the
template (positional filter), is no candidate. Candidates are verified by whole intersections.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from boxoffice.functions.scale import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text whose A-Z are in lower case, and the same before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels.
PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

# Public license notices. LINE templates are sought in single lines, PARAGRAPH
# templates in runs of lines without an empty line between them.
LINE, PARAGRAPH = "line", "paragraph"
TEMPLATES = (
    ("mit", LINE, "Released under the MIT License."),
    ("apache", LINE, "Licensed under the Apache License, Version 2.0."),
    ("gpl", LINE, "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", LINE, "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", LINE, "Licensed under the Creative Commons Attribution ShareAlike 4.0 International License."),
    ("mpl", LINE, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", LINE, "All rights reserved."),
    (
        "mit",
        PARAGRAPH,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "apache",
        PARAGRAPH,
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        PARAGRAPH,
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "bsd",
        PARAGRAPH,
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "isc",
        PARAGRAPH,
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
)


def _template_sets(templates: tuple[tuple[str, str, str], ...]) -> list[tuple[str, str, list[str]]]:
    return [(label, unit, sorted(set(re.findall("[0-9a-z]+", text.lower())))) for label, unit, text in templates]


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _lower_for_ascii(text: Column) -> Column:
    """Lower case that is right for ASCII words, and faster. Only U+0130 and U+212A, whose lower-case
    forms hold ASCII letters, need the exact form."""
    return F.when(text.rlike("[\u0130\u212A]"), _lower(text)).otherwise(F.lower(text))


def may_hold(text: Column, sets: list[tuple[str, str, list[str]]], threshold: float) -> Column:
    """The prefix filter on whole texts, before they are cut into words: what contains a template has one
    of any so many of its words that the others alone are too few. The longest words are taken."""
    some: set[str] = set()
    for _, _, words in sets:
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        some |= set(sorted(words, key=lambda w: (-len(w), w))[: len(words) - need + 1])
    # A word that holds another one of them says nothing more.
    some = {w for w in some if not any(other != w and other in w for other in some)}

    def holds(low: Column) -> Column:
        found = F.lit(False)
        for word in sorted(some):
            found = found | F.contains(low, F.lit(word))
        return found

    # As an element of an array the text is lower-cased once and not for each word.
    return F.exists(F.array(_lower_for_ascii(text)), holds)


def base_places(rows: DataFrame) -> DataFrame:
    """Add n_words, n_base, first_word, last_word and base_found (labels) to rows with ``text``. Only
    texts in which the phrases' last word occurs are cut into words."""
    last = "|".join(sorted({words[-1] for words, _ in PHRASES}))
    cut = rows.withColumn("n_words", F.regexp_count("text", F.lit(RAW_WORD)).cast("long")).withColumn(
        "words", F.when(F.col("text").rlike(f"(?i){last}"), F.regexp_extract_all(_lower(F.col("text")), F.lit(WORD), F.lit(0)))
    )

    def starts(phrase: tuple[str, ...]) -> Column:
        def here(i: Column) -> Column:
            same = F.lit(True)
            for k, word in enumerate(phrase):
                same = same & F.coalesce(F.get("words", i + k) == word, F.lit(False))
            return same

        found = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
        return F.when(F.size("words") > 0, found).otherwise(F.array().cast("array<int>"))

    names = [f"at_{k}" for k in range(len(PHRASES))]
    placed = cut.withColumns({name: starts(phrase) for name, (phrase, _) in zip(names, PHRASES, strict=True)}).drop("words")
    labels = [F.when(F.size(name) > 0, F.lit(label)) for name, (_, label) in zip(names, PHRASES, strict=True)]
    return (
        placed.withColumn("places", F.concat(*names))
        .withColumn("base_found", F.array_compact(F.array(*labels)))
        .withColumn("n_base", F.size("places").cast("long"))
        .withColumn("first_word", F.array_min("places").cast("long"))
        .withColumn("last_word", F.array_max("places").cast("long"))
        .drop("places", *names)
    )


def text_blocks(rows: DataFrame, vocabulary: list[str], least: dict[str, int]) -> DataFrame:
    """Lines and paragraphs of ``text``, one row each: the columns of rows but text, unit, block (its
    number) and tokens, those of the ``vocabulary`` in it. Blocks with fewer than ``least`` of their
    unit's tokens are left out (the length filter)."""
    known = F.array(*[F.lit(word) for word in vocabulary])

    def of(unit: str, pattern: str) -> DataFrame:
        blocks = rows.select(*[c for c in rows.columns if c != "text"], F.lit(unit).alias("unit"), F.posexplode(F.split("text", pattern)).alias("block", "part"))
        tokens = F.array_intersect(F.split(_lower_for_ascii(F.col("part")), GAP), known)
        return blocks.withColumn("tokens", tokens).drop("part").filter(F.size("tokens") >= least[unit])

    units = [of(LINE, r"\n")] * (LINE in least) + [of(PARAGRAPH, r"\n[\x20\x09-\x0D]*\n")] * (PARAGRAPH in least)
    return units[0] if len(units) == 1 else units[0].unionByName(units[1])


def containment_join(blocks: DataFrame, templates: list[tuple[str, str, list[str]]], threshold: float) -> DataFrame:
    """All pairs of a block and a template of its unit it contains: the columns of blocks but tokens,
    label and containment. The templates, their vocabulary and its frequencies are small by what they
    are; no pair is made before a prefix meets, and no block is shuffled."""
    counts = {r.token: r["count"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()}
    vocabulary = sorted({word for _, _, words in templates for word in words}, key=lambda w: (counts.get(w, 0), w))
    rank = {word: k for k, word in enumerate(vocabulary)}
    index = []
    for label, unit, words in templates:
        ranks = sorted(rank[w] for w in words)
        need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        index += [(unit, r, k, label, ranks, need) for k, r in enumerate(ranks[: len(ranks) - need + 1])]
    # Written as values, their size is known, and Spark broadcasts them by it.
    values = ", ".join(f"('{unit}', {r}, {k}, '{label}', array({', '.join(map(str, ranks))}), {need})" for unit, r, k, label, ranks, need in index)
    prefixes = blocks.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(own_unit, rank, at, label, own, need)")
    least = {unit: min(x[5] for x in index if x[0] == unit) for unit in {x[0] for x in index}}
    need = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("unit")]
    ranked = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    ordered = blocks.withColumn("ranks", F.array_sort(F.transform("tokens", lambda t: ranked[t]))).drop("tokens")
    length = F.size("ranks")
    probes = ordered.select("*", F.posexplode(F.slice("ranks", F.lit(1), length - need + 1)).alias("place", "probe"))
    pairs = probes.join(prefixes, (F.col("probe") == F.col("rank")) & (F.col("unit") == F.col("own_unit")))
    positional = 1 + F.least(length - F.col("place") - 1, F.size("own") - F.col("at") - 1) >= F.col("need")
    shared = F.array_intersect("ranks", "own")
    # A pair is kept at its first shared word alone.
    verified = pairs.filter(positional).withColumn("shared", shared).filter((F.get("shared", F.lit(0)) == F.col("probe")) & (F.size("shared") >= F.col("need")))
    kept = [c for c in blocks.columns if c != "tokens"]
    return verified.select(*kept, "label", (F.size("shared") / F.size("own")).alias("containment"))


def wrapped_notices(rows: DataFrame, templates: tuple[tuple[str, str, str], ...], threshold: float) -> DataFrame:
    """LINE templates in paragraphs of several lines: the columns of rows but text, label and containment.
    A paragraph contains a template if some run of its words, at most 1 / ``threshold`` times as long as
    the template, has enough of the template's distinct words; line breaks do not count."""
    lines = [t for t in templates if t[1] == LINE]
    kept = [c for c in rows.columns if c != "text"]
    parts = rows.select(*kept, F.explode(F.split("text", r"\n[\x20\x09-\x0D]*\n")).alias("part")).filter(F.contains("part", F.lit("\n")))
    cut = parts.withColumn("words", F.filter(F.split(_lower_for_ascii(F.col("part")), GAP), lambda w: w != "")).drop("part")
    cut = materialize(cut, "paragraphs")

    def of(label: str, text: str, own: list[str]) -> DataFrame:
        width = math.ceil(len(re.findall("[0-9a-z]+", text.lower())) / threshold - 1e-9)
        need = max(1, math.ceil(threshold * len(own) - 1e-9))
        known = F.array(*[F.lit(word) for word in own])
        at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(own))

        def best_of(places: Column) -> Column:
            def held(p: Column, k: Column) -> Column:
                near = F.filter(F.slice(places, k + 1, F.lit(width)), lambda q: q["i"] < p["i"] + width)
                return F.size(F.array_distinct(F.transform(near, lambda q: q["w"])))

            return F.array_max(F.transform(places, held))

        likely = cut.filter(F.size(F.array_intersect("words", known)) >= need)
        # As an element of an array the places are found once and not for each of them.
        best = likely.select(*kept, F.get(F.transform(F.array(at), best_of), F.lit(0)).alias("best")).filter(F.col("best") >= need)
        return best.select(*kept, F.lit(label).alias("label"), (F.col("best") / len(own)).alias("containment"))

    found = [of(label, text, own) for (label, _, text), (_, _, own) in zip(lines, _template_sets(tuple(lines)), strict=True)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels and score.

    Null and empty texts have no words, places or labels (empty strings) and score 0. ``score`` is 1
    where a phrase occurs, else the largest containment of a template at or above ``threshold``, else
    0. Repeated rows each get their result; a null id stays. Other columns are ignored. LINE templates
    are sought in single lines, and where line breaks cut them in word windows of paragraphs
    (``wrapped_notices``).
    """
    sets = _template_sets(templates)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    least = {unit: min(math.ceil(threshold * len(w) - 1e-9) for _, u, w in sets if u == unit) for unit in {u for _, u, _ in sets}}
    vocabulary = sorted({word for _, _, words in sets for word in words})
    likely = materialize(rows.filter(may_hold(F.col("text"), sets, threshold)), "likely")
    blocks = materialize(text_blocks(likely, vocabulary, least), "blocks")
    pairs = containment_join(blocks, sets, threshold).select("id", "key", "label", "containment")
    if LINE in least:
        pairs = pairs.unionByName(wrapped_notices(likely, templates, threshold))
    found = (
        pairs.groupBy(F.col("id").alias("own_id"), F.col("key").alias("own_key"))
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    )
    base = base_places(rows).drop("text")
    joined = base.join(found, base["id"].eqNullSafe(found["own_id"]) & (base["key"] == found["own_key"]), "left")
    none = F.array().cast("array<string>")
    text_of = lambda labels: F.array_join(F.array_sort(labels), ",")
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        text_of("base_found").alias("base_labels"),
        text_of(F.array_union("base_found", F.coalesce("found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def scan_sql(threshold: float = 0.8) -> str:
    """The same result in DuckDB SQL, by comparing every block, and every word window of paragraphs of
    several lines, with every template."""
    widths = [math.ceil(len(re.findall("[0-9a-z]+", text.lower())) / threshold - 1e-9) for _, _, text in TEMPLATES]
    sets = "\n    UNION ALL ".join(
        f"SELECT '{label}' AS label, '{unit}' AS unit, {_sql_list(words)} AS own, {width} AS width"
        for (label, unit, words), width in zip(_template_sets(TEMPLATES), widths, strict=True)
    )
    places = []
    for words, label in PHRASES:
        same = " AND ".join(f"words[i + {k}] = '{word}'" for k, word in enumerate(words))
        places.append(f"SELECT row_no, i - 1 AS place, '{label}' AS label FROM spots WHERE {same}")
    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents
), cut AS (
    SELECT row_no, doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM docs
), spots AS (
    SELECT row_no, words, unnest(range(1, len(words) + 1)) AS i FROM cut WHERE text LIKE '%license%'
), places AS (
    {" UNION ALL ".join(places)}
), base AS (
    SELECT row_no, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
    FROM places GROUP BY row_no
), templates AS (
    {sets}
), blocks AS (
    SELECT row_no, 'line' AS unit, unnest(string_split(text, chr(10))) AS part FROM docs
    UNION ALL SELECT row_no, 'paragraph', unnest(regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n')) FROM docs
), sized AS (
    SELECT row_no, unit, list_distinct(regexp_extract_all(part, '{WORD}')) AS tokens FROM blocks
), found AS (
    SELECT row_no, label, len(list_intersect(tokens, own)) / len(own) AS containment
    FROM sized JOIN templates USING (unit) WHERE len(list_intersect(tokens, own)) >= ceil({threshold} * len(own) - 1e-9)
), wrapped AS (
    SELECT row_no, regexp_extract_all(part, '{WORD}') AS words FROM blocks WHERE unit = 'paragraph' AND contains(part, chr(10))
), windows AS (
    SELECT row_no, label, own, width, words, unnest(range(1, len(words) + 1)) AS i
    FROM wrapped JOIN templates ON unit = 'line' AND len(list_intersect(words, own)) >= ceil({threshold} * len(own) - 1e-9)
), spanned AS (
    SELECT row_no, label, len(list_intersect(words[i:i + width - 1], own)) AS held, len(own) AS size FROM windows
), method AS (
    SELECT row_no, list(DISTINCT label) AS labels, max(containment) AS most
    FROM (SELECT * FROM found UNION ALL SELECT row_no, label, held / size FROM spanned WHERE held >= ceil({threshold} * size - 1e-9))
    GROUP BY row_no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0)::DOUBLE END AS score
FROM cut LEFT JOIN base USING (row_no) LEFT JOIN method USING (row_no)
"""
