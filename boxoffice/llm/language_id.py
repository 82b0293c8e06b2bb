"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are folded to lower case and everything but letters to a blank. The 1- to 3-grams that hold
a letter and no two blanks in a row are hashed into buckets. A feature is the share of a bucket among
the n-grams of its text, times its inverse document frequency over all training documents. The weights
are fitted by follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties), and the scores
calibrated by one temperature on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boxoffice.llm.textkit import slices, text_bytes

BITS = 15
BUCKETS = 1 << BITS
SCALE = 30.0
SLICE = 1 << 20
ROWS = 1024
UNKNOWN = "und"
#: Draws of rows for the training sample are below this.
DRAWS = 1 << 62

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a blank."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = char.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _fold.append(table)
    return _fold[0]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: the text number and the bucket of each, in order of the texts."""
    data, offsets = text_bytes(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.cumsum(np.append(0, (data & 0xC0) != 0x80))[offsets]
    owner = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(first))
    chars = fold_table()[points]
    blank = chars == 32
    code = chars * np.uint32(0x9E3779B1)
    ok = ~blank
    for n in (1, 2, 3):
        if n > 1:
            if len(chars) < n:
                return
            # The n-gram grows by one character on its right.
            code = code[:-1] * np.uint32(0x85EBCA77) + chars[n - 1 :] * np.uint32(0xC2B2AE3D)
            pair = blank[n - 2 : -1] & blank[n - 1 :]
            ok = (~pair if n == 2 else ok[:-1] & ~pair) & (owner[: -n + 1] == owner[n - 1 :])
        at = np.flatnonzero(ok)
        spread = code[at] ^ (code[at] >> np.uint32(15))
        yield owner[at], ((spread * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int64)


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, column, SLICE):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


@dataclass
class Model:
    """``table``: per bucket and language the weight times the inverse document frequency."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        sums, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for owner, bucket in grams(column):
            total += np.bincount(owner, minlength=n)
            values = self.table[bucket]
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(owner, weights=values[:, k], minlength=n)
        return SCALE * sums / np.maximum(total, 1)[:, None] + self.bias


def softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return grown / grown.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of ``text`` each bucket occurs, and the number of rows. A task sends one row
    per bucket it has met; there are never more than the buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for part in _small(batches, "text"):
            seen = np.zeros(part.num_rows * BUCKETS, bool)
            for owner, bucket in grams(part.column(0)):
                seen[owner * np.int64(BUCKETS) + bucket] = True
            total += seen.reshape(-1, BUCKETS).sum(axis=0)
            rows += part.num_rows
        at = np.flatnonzero(total)
        if rows:
            ids, counts = np.append(at, -1), np.append(total[at], rows)
            yield pa.record_batch([pa.array(ids), pa.array(counts)], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    table = np.zeros(BUCKETS, np.int64)
    table[bucket[bucket >= 0]] = n[bucket >= 0]
    return table, int(n[bucket < 0].sum())


def fit_ftrl(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """Weights (buckets + 1) x classes, the last row being the bias, which is a feature of value 1.
    ``samples``: places and values of the features of each document."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pull = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -pull / ((beta + np.sqrt(n[at])) / alpha + l2)

    one_hot = np.eye(classes)[labels] if len(labels) else np.zeros((0, classes))
    for _ in range(epochs):
        for (at, x), goal in zip(samples, one_hot, strict=True):
            w = weights(at)
            g = x[:, None] * (softmax(x @ w) - goal)
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least cross entropy, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def draw_bounds(drawn: DataFrame, sizes: dict[str, int], share: int) -> dict[str, int]:
    """Per language the largest draw of its ``share`` least distinct draws, or of all if there are fewer.
    Draws are looked for below a limit at which a language of distinct rows has four times as many;
    where repeated rows leave too few, the limit is raised."""
    rates, bounds = {lang: min(1.0, 4 * share / n) for lang, n in sizes.items()}, {}
    while rates:
        limit = F.create_map(*[F.lit(x) for lang, rate in rates.items() for x in (lang, int(rate * DRAWS))])
        below = drawn.filter(F.col("draw") < limit[F.col("lang")]).select("lang", "draw").distinct().toArrow()
        got: dict[str, list[int]] = {lang: [] for lang in rates}
        for lang, draw in zip(below["lang"].to_pylist(), below["draw"].to_pylist(), strict=True):
            got[lang].append(draw)
        for lang, draws in got.items():
            if len(draws) >= share or rates[lang] == 1:
                bounds[lang] = sorted(draws)[:share][-1]
        rates = {lang: min(1.0, 4 * rate) for lang, rate in rates.items() if lang not in bounds}
    return bounds


def train(labelled: DataFrame, max_rows: int = 3_000, held: int = 5) -> Model | None:
    """Fit a model on ``labelled`` (id, text, lang). Document frequencies come from all of its rows.
    The weights are fitted in the driver on a sample of at most ``max_rows`` rows (or one a language),
    as many of each language, or all its distinct rows where it has fewer; they are chosen by a hash of
    id and text, and equal rows count as one. Every ``held``-th of them only sets the temperature. None
    if no row has a language and a letter."""
    usable = labelled.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    frequency, rows = document_frequencies(usable)
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    share = max(1, max_rows // len(languages))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", "lang", F.lit("sample")), F.lit(DRAWS))
    drawn = usable.withColumn("draw", draw)
    bounds = draw_bounds(drawn, sizes, share)
    bound = F.create_map(*[F.lit(x) for lang in languages for x in (lang, bounds[lang])])
    sample = drawn.filter(F.col("draw") <= bound[F.col("lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _small(batches, "text"):
            # Of equal rows a task looks at one alone; there are no more draws than rows in the sample.
            draws, first = np.unique(part.column(2).to_numpy(), return_index=True)
            new = [at for draw, at in zip(draws.tolist(), first.tolist(), strict=True) if draw not in seen]
            seen.update(draws.tolist())
            if not new:
                continue
            part = part.take(pa.array(new))
            pairs = [owner * np.int64(BUCKETS) + bucket for owner, bucket in grams(part.column(1))]
            key, count = np.unique(np.concatenate(pairs), return_counts=True)
            cut = np.searchsorted(key, np.arange(part.num_rows + 1) * BUCKETS)
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, pa.int32())) for v in (key % BUCKETS, count)]
            yield pa.record_batch([part.column(0), part.column(2), *lists], names=["lang", "draw", "bucket", "count"])

    schema = "lang string, draw long, bucket array<int>, count array<int>"
    got = sample.select("lang", "text", "draw").mapInArrow(features, schema).dropDuplicates(["lang", "draw"]).toArrow()
    places, counts = got["bucket"].to_pylist(), got["count"].to_pylist()
    order = sorted(range(len(places)), key=lambda i: (got["draw"][i].as_py(), places[i], counts[i]))
    samples, labels = [], []
    for i in order:
        at, count = np.array(places[i], np.int64), np.array(counts[i], float)
        samples.append((np.append(at, BUCKETS), np.append(SCALE * idf[at] * count / count.sum(), 1.0)))
        labels.append(languages.index(got["lang"][i].as_py()))
    labels, number = np.array(labels, int), np.arange(len(labels))
    fit, rest = np.flatnonzero(number % held != held - 1), np.flatnonzero(number % held == held - 1)
    weights = fit_ftrl([samples[i] for i in fit], labels[fit], len(languages))
    logits = np.array([samples[i][1] @ weights[samples[i][0]] for i in rest]).reshape(-1, len(languages))
    return Model(languages, weights[:-1] * idf[:, None], weights[-1], fit_temperature(logits, labels[rest]))


def predict(rows: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the language and its score, as ``names``, to ``rows``, which have a column ``text`` and
    otherwise any columns. Texts that are null or without a letter are ``und`` with score 0. The model,
    buckets x languages of 8 bytes, is broadcast."""
    if model is None:
        return rows.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in _small(batches, "text"):
            column = part.column(part.schema.get_field_index("text"))
            data, offsets = text_bytes(column)
            chars = fold_table()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)] != 32
            upto = np.append(0, np.cumsum(chars))[np.cumsum(np.append(0, (data & 0xC0) != 0x80))[offsets]]
            letters = np.diff(upto) > 0
            chance = softmax(own.logits(column) / own.temperature)
            best = chance.argmax(axis=1)
            found = [own.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            scores = np.where(letters, chance[np.arange(len(best)), best], 0.0)
            kept = [part.column(name) for name in part.schema.names]
            yield pa.record_batch([*kept, pa.array(found, pa.string()), pa.array(scores)], names=[*part.schema.names, *names])

    return rows.mapInArrow(score, schema)


def held_out(id_col: str) -> Column:
    """Documents that are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 3_000) -> DataFrame:
    """Per row: ``id_col``, held_out, lang_pred and score (calibrated, 0 to 1).

    Learns from the rows that are not held out and have a language. Null or empty texts, and texts
    without a letter, are ``und`` with score 0; so is everything if nothing can be learnt. A null id
    is not held out. Repeated rows are scored each on its own. Of equal scores the first language in
    code point order counts. Whole texts are read; a task holds about 100 bytes per byte of a slice of
    1 MB, or of one longer text.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out")
    )
    model = train(rows.filter(~F.col("held_out")).select("id", "text", "lang"), max_rows)
    scored = predict(rows.select("id", "held_out", "text"), model)
    return scored.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
