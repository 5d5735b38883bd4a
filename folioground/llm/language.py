"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

Texts are read as letters of one case, everything else being a space; their n-grams of one to ``ORDERS`` letters are
hashed to ``1 << BITS`` features. Inverse document frequencies cover every document that may be learned from. The
weights are fitted on at most ``max_rows`` labelled documents, dealt evenly to the languages and chosen by a hash of
their id, by follow-the-regularised-leader with elastic-net penalties: features without use keep the weight zero. A
fifth of these rows is held back to fit one temperature, which makes the scores probabilities.

Only the text and the label of documents that may be learned from enter the model; a prediction sees the text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0; null labels teach nothing; ties go to the
language first in the alphabet; with one language learned it is the answer with score 1, with none every text is
``und``; a null id counts as the empty id; repeated rows are answered alike, one result each; an empty table gives no
rows; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from folioground.llm.base import chunks, texts_of
from folioground.llm.tokens import _LETTER, _classes

ORDERS, BITS = 3, 15
UNKNOWN = "und"
#: A model beyond this is refused rather than broadcast.
MODEL_BYTES = 256 << 20


@dataclass(frozen=True)
class Model:
    languages: list[str]
    features: np.ndarray  # ids of features with a weight
    weights: np.ndarray  # a row for each of these, a column for each language
    idf: np.ndarray  # of all features: the norm of a text takes them all
    bias: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point; a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in np.flatnonzero(_classes() == _LETTER):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def _features(column: pa.Array):
    """(ids, counts) of the n-grams of each whole text of a batch, in row order."""
    data, offsets = texts_of(column)
    for low, high in chunks(offsets):
        raw = data[offsets[low]: offsets[high]]
        points = _letters()[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)].astype(np.uint64)
        leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
        ends = leads[offsets[low: high + 1] - offsets[low]]
        codes, code = [], np.zeros(len(points), np.uint64)
        for n in range(ORDERS):
            code = (points if n == 0 else code[:-1] * np.uint64(0x110000) + points[n:])
            codes.append(((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32))
        for a, b in zip(ends[:-1], ends[1:]):
            counts = np.bincount(np.concatenate([c[a: max(a, b - n)] for n, c in enumerate(codes)]), minlength=1 << BITS)
            ids = np.flatnonzero(counts)
            yield ids, counts[ids]


def _tfidf(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[ids]
    return x / np.sqrt((x * x).sum()) if len(x) else x


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each feature, and documents, over the whole table; tasks add up before anything is shuffled."""
    def run(batches):
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for ids, _ in _features(batch.column(0)):
                seen[ids] += 1
            n += len(batch)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(seen[found], n))], ["feature", "n"])

    sums = texts.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most 1 << BITS rows
    out = np.zeros(1 << BITS)
    for r in sums:
        if r["feature"] >= 0:
            out[r["feature"]] = r["n"]
    return out, next((r["n"] for r in sums if r["feature"] < 0), 0)


def _sample(learnable: DataFrame, key: str, text: str, lang: str, max_rows: int):
    """(language, ids, counts) of the rows to fit on, in the order of a hash of their id."""
    languages = [r[0] for r in learnable.select(lang).distinct().collect()]
    order = F.xxhash64(F.lit("sample"), key)
    chosen = learnable.select(F.col(key).alias("_id"), F.col(lang).alias("_lang")).distinct().withColumn("_rank", F.row_number().over(W.partitionBy("_lang").orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id")))
    chosen = chosen.where(F.col("_rank") <= max(1, max_rows // max(1, len(languages)))).limit(max_rows)
    rows = learnable.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("_id")) & (F.col(lang) == F.col("_lang")))  # max_rows rows

    def run(batches):
        for batch in batches:
            made = list(_features(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype(np.uint16).tobytes() for i, _ in made], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in made], pa.binary())], ["h", "lang", "ids", "counts"])

    got = rows.select(order.alias("h"), lang, text).mapInArrow(run, "h bigint, lang string, ids binary, counts binary").limit(max_rows).collect()
    got.sort(key=lambda r: (r["h"], r["lang"], r["ids"], r["counts"]))
    return sorted(languages), [(r["lang"], np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32)) for r in got]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from (class, ids, values): the proximal form, with a learning rate for each coordinate."""
    size = (1 << BITS) + 1  # the last one is the bias, always 1 and not penalised
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(ids):
        w = -(z[ids] - np.sign(z[ids]) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2)
        w[np.abs(z[ids]) <= l1] = 0
        w[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)
        return w

    for _ in range(epochs):
        for y, ids, values in rows:
            at, x = np.append(ids, size - 1), np.append(values, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of the lowest log loss, by golden section over its logarithm.

    One error is supposed among the rows, shared by the classes: without any the temperature would have no bound.
    """
    n, classes = logits.shape
    target = np.full((n, classes), 1 / (n + 2) / classes)
    target[np.arange(n), y] += 1 - 1 / (n + 2)
    loss = lambda t: -(target * np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()
    a, b, g = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 4000, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.001, epochs: int = 3) -> Model:
    """Fit on the documents that are not held out and have a label."""
    learnable = docs.select(key, text, lang).where(~held_out(key) & F.col(lang).isNotNull())
    seen, n = _document_frequencies(learnable.select(text))
    idf = np.log((1 + n) / (1 + seen)) + 1
    languages, sample = _sample(learnable, key, text, lang, max_rows)
    if len(languages) < 2:
        return Model(languages, np.zeros(0, np.int64), np.zeros((0, len(languages))), idf, np.zeros(len(languages)), 1.0)
    if (1 << BITS) * len(languages) * 4 > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages are too many for one model")
    code = {name: i for i, name in enumerate(languages)}
    rows = [(code[name], ids, _tfidf(ids, counts, idf)) for name, ids, counts in sample if len(ids)]
    calibration, training = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    weights, bias = follow_the_leader(training, len(languages), alpha, beta, l1, l2, epochs)
    used = np.flatnonzero((weights != 0).any(axis=1))
    temperature = 1.0
    if calibration:
        temperature = _temperature(np.array([x @ weights[ids] + bias for _, ids, x in calibration]), np.array([y for y, _, _ in calibration]))
    return Model(languages, used, weights[used].astype(np.float32), idf, bias, temperature)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES
    added = T.StructType().add("lang_pred", "string").add("score", "double")
    kept = docs.select(*keep).schema.fields
    texts = [] if text in keep else [F.col(text).alias("_text")]
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        m = shared.value
        dense = np.zeros((1 << BITS, max(1, len(m.languages))), np.float32)
        if len(m.features):
            dense[m.features] = m.weights
        for batch in batches:
            names, scores = [], []
            for (ids, counts), letters in zip(_features(batch.column(at)), batch.columns[-1].to_pylist()):
                if not letters or not m.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax((_tfidf(ids, counts, m.idf) @ dense[ids] + m.bias) / m.temperature)
                best = int(np.argmax(p))
                names.append(m.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    return docs.select(*keep, *texts, lettered).mapInArrow(run, T.StructType([*kept, *added.fields]))


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more, with all their columns."""
    numbered = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))  # no name can clash
    answered = predict(numbered, model, numbered.columns, f"_{docs.columns.index(text)}")
    return answered.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """(key, held_out, lang_pred, score) of every row, by a model fitted on ``docs`` themselves."""
    model = fit(docs, key, text, lang, **options)
    return predict(docs.select(key, held_out(key).alias("held_out"), text), model, [key, "held_out"], text)
