"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text (everything that is not a letter is one separator) are
hashed into ``DIMENSIONS`` features.  Document frequencies come from every training document.  The
regression itself is fitted on a bounded sample - at most ``per_lang`` distinct documents of each of the ``max_langs`` commonest
languages, the first in hash order of id, language and text - by follow-the-regularised-leader with L1 and L2 penalties; a fifth of the sample
is kept for the temperature that calibrates the probabilities.

Defined cases: a null text or one without letters gives ``und`` with score 0, as does every text when
there is nothing to learn from; null langs are not learned from; repeated rows (null ids included) stand in
the sample once and are predicted alike; of equal probabilities the language that comes first wins; an
empty table gives an empty result; whole texts are used whatever their length; extra columns pass through
``keep_identified`` whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import held_out, table
from ._words import U, mix, pieces

BITS = 14
DIMENSIONS = 1 << BITS
PER_LANG = 500
MAX_LANGS = 256
UNDETERMINED = "und"
_PIECE = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Of each text the distinct features with their counts; None where it has no letter."""
    plain = [(x or "").lower() for x in texts.to_pylist()]
    codes = np.frombuffer("\0".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    filled = codes != 0
    sums = np.concatenate(([0], np.cumsum(filled)))
    one = codes * U(0x9E3779B97F4A7C15)
    two = mix(codes[:-1] * U(0xC2B2AE3D27D4EB4F) + one[1:] + U(1))
    three = mix(codes[:-2] * U(0x165667B19E3779F9) + codes[1:-1] * U(0x27D4EB2F165667C5) + one[2:] + U(2))
    shift = U(64 - BITS)
    grams = [(mix(one) >> shift).astype(np.int32), (two >> shift).astype(np.int32), (three >> shift).astype(np.int32)]
    # runs of separators only say nothing
    used = [filled, filled[:-1] | filled[1:], filled[:-2] | filled[1:-1] | filled[2:]]
    at = 0
    for text in plain:
        to = at + len(text)
        if sums[to] == sums[at]:
            yield None
        else:
            count = np.zeros(DIMENSIONS, np.int64)
            for n, (gram, use) in enumerate(zip(grams, used, strict=True)):
                end = max(at, to - n)
                count += np.bincount(gram[at:end][use[at:end]], minlength=DIMENSIONS)
            present = np.flatnonzero(count)
            yield present, count[present]
        at = to + 1


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, count = found
    value = np.log1p(count) * idf[index]
    norm = float(np.sqrt(value @ value))
    return index, value / norm if norm else value


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """FTRL-proximal over (index, value, class) rows in the given order."""
    k = len(langs)
    shape = (len(idf) + 1, k)
    z, n = np.zeros(shape), np.zeros(shape)

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    apart = [r for i, r in enumerate(rows) if i % 5 == 4]
    used = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    for _ in range(epochs):
        for index, value, y in used:
            at = np.append(index, len(idf))
            x = np.append(value, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(len(idf) + 1))
    logits = np.array([v @ w[i] + w[-1] for i, v, _ in apart]) if apart else np.zeros((0, k))
    truth = np.array([y for *_, y in apart], int)
    return Model(langs, w[:-1].astype(np.float32), w[-1], idf, _temperature(logits, truth))


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least cross entropy on the part that was kept apart, by golden section over its log."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        # one pseudo-count of an even guess keeps the temperature above zero where every guess is right
        p = _softmax(logits / np.exp(t))
        k = p.shape[1]
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).sum() - np.log(np.maximum(p.mean(axis=0), 1e-12)).sum() / k - np.log(np.maximum(p, 1e-12)).mean()

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                for found in features(piece.column(0)):
                    if found:
                        total[found[0]] += 1
                        docs += 1
        present = np.append(np.flatnonzero(total), DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array(np.append(total, docs)[present], pa.int64())], ["f", "n"])

    rows = training.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        out[r["f"]] = r["n"]
    return out[:-1], int(out[-1])


def fit(training: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> Model | None:
    """``training`` has doc_id, text and lang (not null); None if no text of it has letters.

    The ``max_langs`` commonest languages are learned, each from at most ``per_lang`` documents.
    """
    order = F.xxhash64("doc_id", "lang", "text")
    counts = training.groupBy("lang").agg(F.approx_count_distinct(order, 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not counts:
        return None
    # hashes spread evenly, so a limit on them bounds the distinct rows that it leaves, wherever they are
    share = {r["lang"]: min(1.0, (1.3 * per_lang + 50) / max(1, r["n"])) for r in counts}
    limits = {lang: min((1 << 63) - 1, int(x * (1 << 64)) - (1 << 63)) for lang, x in share.items()}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    below = training.filter(order <= F.try_element_at(limit, F.col("lang"))).select("text", "lang", order.alias("o"))
    # equal rows fall together before anything is gathered
    sample = below.dropDuplicates(["lang", "o"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                for found, lang, o in zip(features(piece.column(0)), piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([o], pa.int64()), pa.array([found[0].astype("<i4").tobytes()]), pa.array([found[1].astype("<i4").tobytes()])], ["lang", "o", "i", "c"])

    rows = sample.mapInArrow(run, "lang string, o long, i binary, c binary").collect()
    if not rows:
        return None
    df, docs = _document_frequencies(training)
    idf = np.log((1 + docs) / (1 + df)) + 1
    langs = sorted({r["lang"] for r in rows})
    number = {x: i for i, x in enumerate(langs)}
    made, seen = [], {}
    for r in sorted(rows, key=lambda r: (r["o"], r["lang"])):
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= per_lang:
            index = np.frombuffer(r["i"], "<i4")
            made.append((*vector((index, np.frombuffer(r["c"], "<i4")), idf), number[r["lang"]]))
    return train(made, langs, idf)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score; the text is all that a prediction sees."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text", _PIECE):
                langs, scores = [], []
                for found in features(piece.column(piece.num_columns - 1)):
                    if not found or not model:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    index, value = vector(found, model.idf)
                    p = _softmax((value @ model.weights[index] + model.bias) / model.temperature)
                    best = int(p.argmax())
                    langs.append(model.langs[best])
                    scores.append(float(p[best]))
                columns = piece.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*piece.schema.names[:-1], "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def training_rows(docs: DataFrame, modulus: int = 4) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"), modulus) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def accepted(lang: Column, score: Column, least: float) -> Column:
    return (lang != UNDETERMINED) & (score >= least)


def keep_identified(docs: DataFrame, least: float = 0.5, per_lang: int = PER_LANG) -> DataFrame:
    """The documents whose language is identified with at least ``least`` probability, columns unchanged."""
    model = fit(training_rows(docs), per_lang)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    judged = predict(packed, model, ["__row"])
    return judged.filter(accepted(F.col("lang_pred"), F.col("score"), least)).select("__row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(training_rows(docs))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")
