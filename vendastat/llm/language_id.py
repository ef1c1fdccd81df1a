"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every document that may be learned from. The weights are fitted
by follow-the-regularised-leader with an elastic-net penalty, one example at a time, on a
bounded sample with equal shares of all languages (``SAMPLE_DOCUMENTS``; ``MAX_LANGUAGES`` bounds
their number); a part of that sample is kept back to calibrate one temperature. Prediction is a narrow
expression over the text: no shuffle, and any other columns pass through untouched.

Texts are whole, in lower case, with every run of characters that are no letters as one space.
N-grams of one to three characters are hashed to 2**15 features.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and for every
text if there is no labelled document to learn from. A null label is not learned from; a null
id counts as empty text when documents are held out. Repeated rows count as often as they
occur. With one learned language every text with a letter is that language, with score 1. An
empty table gives an empty result. Very long texts are read in slices cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import slices
from .common import tidy

UNKNOWN = "und"
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
SAMPLE_DOCUMENTS = 4000
#: Languages that can be told apart; of more labels the most frequent ones are learned.
MAX_LANGUAGES = 256
CALIBRATION_SHARE = 0.25
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.001


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float


def letters() -> np.ndarray:
    """Whether each character of the basic plane is a letter."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def gram_counts(text: str, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs; nothing if it has no letter."""
    total = np.zeros(FEATURES, dtype=np.int64)
    for part in slices(text):
        codes = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = is_letter[np.minimum(codes, 0xFFFF)]
        high = np.flatnonzero(codes > 0xFFFF)
        letter[high] = [chr(c).isalpha() for c in codes[high]]
        if not letter.any():
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space behind each run of letters
        codes = np.where(letter, codes, 32)[keep]
        codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
        for grams in (one[1:-1], two, three):
            mixed = (grams ^ (grams >> np.uint32(16))) * np.uint32(0x7FEB352D)
            total += np.bincount(mixed >> np.uint32(32 - FEATURE_BITS), minlength=FEATURES)
    found = np.flatnonzero(total)
    return found, total[found]


def tf_idf(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[found]
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias. Each step works on the features of one example only."""
    z = np.zeros((FEATURES + 1, languages))
    n = np.zeros_like(z)

    def leader(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (found, values), target in zip(rows, targets, strict=True):
            at = np.append(found, FEATURES)  # the last one is the bias
            x = np.append(values, 1.0)
            l1 = np.append(np.full(len(found), L1), 0.0)[:, None]
            old_n = n[at]
            w = leader(z[at], old_n, l1)
            error = softmax(x @ w)
            error[target] -= 1.0
            g = x[:, None] * error
            new_n = old_n + g * g
            z[at] += g - (np.sqrt(new_n) - np.sqrt(old_n)) / ALPHA * w
            n[at] = new_n
    penalty = np.append(np.full(FEATURES, L1), 0.0)[:, None]
    w = leader(z, n, penalty)
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search over its logarithm."""
    if not len(targets):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(targets)), targets], 1e-12)).mean())

    a, b, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 4 == 2


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_documents: int = SAMPLE_DOCUMENTS,
) -> Model | None:
    """The model, or ``None`` if no document with text may be learned from."""
    usable = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))
    learned = docs.where(usable).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        # The number of the row tells rows apart whose id is null or repeated.
        F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(1)), F.lit(1 << 30)).alias("place"),
    )
    counted = learned.groupBy("lang").agg(F.count("*").alias("n"))
    per_language = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not per_language:
        return None
    idf = _idf(learned)
    each = max(1, sample_documents // len(per_language))
    shares = {lang: min(1.0, each / n) for lang, n in per_language.items()}
    share = F.create_map(*[F.lit(v) for pair in shares.items() for v in pair])[F.col("lang")]
    drawn = learned.where(F.col("place") < share * (1 << 30))
    # The hash draws about as many; the order within a language makes the bound a firm one.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    sample = drawn.withColumn("nth", nth).where(F.col("nth") <= each).drop("nth")

    @tidy
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_letter = letters()
        for batch in batches:
            grams = [gram_counts(t, is_letter) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "lang": batch["lang"],
                    "place": batch["place"],
                    "found": [f.astype(np.int32) for f, _ in grams],
                    "counts": [c.astype(np.int32) for _, c in grams],
                }
            )

    schema = "lang string, place bigint, found array<int>, counts array<int>"

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["found"].map(len) > 0].sort_values("place", kind="stable")
        if not len(rows):
            return pd.DataFrame({"languages": [[]], "weights": [[]], "bias": [[]], "temperature": [1.0]})
        languages = sorted(set(rows["lang"]))
        targets = rows["lang"].map(languages.index).to_numpy()
        x = [(f, tf_idf(f, c, idf)) for f, c in zip(rows["found"], rows["counts"], strict=True)]
        kept_back = np.arange(len(x)) < CALIBRATION_SHARE * len(x)
        if len(set(targets[~kept_back])) < len(languages):
            kept_back[:] = False  # too few to keep any back
        order = np.random.default_rng(11).permutation(np.flatnonzero(~kept_back))
        weights, bias = ftrl([x[i] for i in order], targets[order], len(languages))
        back = np.flatnonzero(kept_back)
        logits = np.array([v @ weights[f] + bias for f, v in (x[i] for i in back)]).reshape(len(back), len(languages))
        temperature = best_temperature(logits, targets[back])
        return pd.DataFrame(
            {
                "languages": [languages],
                "weights": [weights.ravel()],
                "bias": [bias],
                "temperature": [temperature],
            }
        )

    # The sample is bounded, so it may meet in one task; the weights are one small row.
    fitted = (
        sample.mapInPandas(features, schema)
        .withColumn("one", F.lit(0))
        .groupBy("one")
        .applyInPandas(fit, "languages array<string>, weights array<double>, bias array<double>, temperature double")
        .first()
    )
    if fitted is None or not fitted["languages"]:
        return None
    languages = fitted["languages"]
    weights = np.array(fitted["weights"]).reshape(FEATURES, len(languages))
    return Model(languages, idf, weights, np.array(fitted["bias"]), fitted["temperature"])


def _idf(learned: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every feature over all documents given."""

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_letter, frequency, documents = letters(), np.zeros(FEATURES + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                frequency[gram_counts(text, is_letter)[0]] += 1
                documents += 1
        frequency[FEATURES] = documents
        seen = np.flatnonzero(frequency)
        yield pd.DataFrame({"feature": seen.astype(np.int32), "n": frequency[seen]})

    counted = learned.select("text").mapInPandas(count, "feature int, n bigint")
    rows = counted.groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # one row per feature
    frequency = np.zeros(FEATURES + 1)
    frequency[rows["feature"]] = rows["n"]
    return np.log((1 + frequency[FEATURES]) / (1 + frequency[:FEATURES])) + 1


def predict(text: Column, model: Model | None) -> Column:
    """A struct of ``lang`` and ``score`` for each text."""

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    @tidy
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        is_letter = letters()
        for texts in batches:
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, text in enumerate(texts):
                if model is None or text is None:
                    continue
                found, counts = gram_counts(text, is_letter)
                if not len(found):
                    continue
                z = tf_idf(found, counts, model.idf) @ model.weights[found] + model.bias
                p = softmax(z / model.temperature)
                best = int(p.argmax())
                langs[i], scores[i] = model.languages[best], p[best]
            yield pd.DataFrame({"lang": langs, "score": scores})

    return judge(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    model = train(docs, id_col, text_col, lang_col)
    told = docs.select(
        F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col), model).alias("told")
    )
    return told.select("id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


def recognised(docs: DataFrame, min_score: float, **columns: str) -> DataFrame:
    """The documents in a learned language with at least ``min_score``, all columns as they are.

    Without anything to learn from nothing can be judged, and every document stays.
    """
    model = train(docs, **columns)
    if model is None:
        return docs
    told = predict(F.col(columns.get("text_col", "text")), model)
    judged = docs.withColumn("__vs_told", told)
    kept = (F.col("__vs_told.lang") != UNKNOWN) & (F.col("__vs_told.score") >= min_score)
    return judged.where(kept).drop("__vs_told")
