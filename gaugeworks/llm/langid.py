"""Language identification: averaged hashed subword embeddings, linear softmax.

Subwords are the 2-, 3- and 4-byte runs of the lower-cased UTF-8 text with
digits, punctuation and white space as one kind of blank; each is hashed into
``BUCKETS`` rows of an embedding. A text's vector is the mean of its subwords'
rows, a linear softmax gives the probabilities. Training is plain stochastic
gradient descent in numpy on the driver over segments of a bounded sample of
labelled texts; embeddings start at zero, so unseen subwords say nothing.

After training the product embedding x weights is one small table of scores
per subword and language, and prediction is its mean over the whole text.

Calibration: a temperature fitted on segments kept out of training turns the
scores into probabilities; a text is rejected if its best probability is below
the threshold, the smaller of ``REJECT_BELOW`` and the ``REJECT_SHARE``
quantile over right predictions on those segments, or if it has no letter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Bound on the labelled rows that a fit reads to the driver, and on the bytes of one of them.
SAMPLE_ROWS = 2_000
SEGMENT = 160
SEGMENTS_PER_ROW = 6
BUCKET_BITS = 15
DIMENSION = 12
EPOCHS = 3
BATCH = 32
RATE = 4.0
REJECT_BELOW = 0.5
REJECT_SHARE = 0.001
UNDETERMINED = "und"
_CHUNK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def subwords(raw: bytes) -> np.ndarray:
    """Bucket of every 2-, 3- and 4-byte run of the folded bytes."""
    x = np.frombuffer(b" " + raw.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    out, value = [], x
    for width in (2, 3, 4):
        if len(x) < width:
            break
        value = value[:-1] << np.uint32(8) | x[width - 1:]
        out.append((value * np.uint32(2654435761) + np.uint32(width * 40503)) * np.uint32(2246822519) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = REJECT_BELOW

    def logits(self, raw: bytes) -> np.ndarray:
        """Mean score of the whole text, summed over pieces that share no bound subword count."""
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, max(len(raw), 1), _CHUNK):
            ids = subwords(raw[at:at + _CHUNK])
            total += self.scores.take(ids, axis=0).sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / max(n, 1) + self.bias

    def predict(self, raw: bytes) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` with 0 if there is no letter or no language."""
        if not self.languages or not _LETTER.search(raw.decode("utf-8", "replace")):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(raw) / self.temperature)
        i = int(p.argmax())
        return self.languages[i], float(p[i])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _segments(rows: list[tuple[bytes, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Up to SEGMENTS_PER_ROW evenly spread segments of each text, as bucket ids."""
    ids, labels = [], []
    for raw, label in rows:
        n = max(1, -(-len(raw) // SEGMENT))
        for j in np.unique(np.linspace(0, n - 1, min(n, SEGMENTS_PER_ROW)).astype(int)):
            ids.append(subwords(raw[j * SEGMENT:(j + 1) * SEGMENT]))
            labels.append(label)
    return ids, np.array(labels, np.int64)


def train(rows: list[tuple[bytes, str]], seed: int = 7) -> LanguageModel:
    """Fit on ``(text, language)`` pairs; every fifth one only calibrates. No pairs: a model that knows no language."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    rows = [(t, languages.index(lang)) for t, lang in rows]
    held = rows[::5] if len(rows) >= 25 else rows
    fit = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 25 else rows
    rng = np.random.default_rng(seed)
    emb = np.zeros((1 << BUCKET_BITS, DIMENSION), np.float32)
    weights = rng.normal(0, 0.3, (DIMENSION, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    ids, labels = _segments(fit)
    share = np.bincount(labels, minlength=len(languages)) / max(len(labels), 1)
    weight = (1 / np.maximum(share, 1e-9) / len(languages)).clip(max=10)  # languages count alike
    steps, done = max(1, EPOCHS * -(-len(ids) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            size = np.array([max(1, len(ids[i])) for i in pick])
            flat = np.concatenate([ids[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(ids[i]) for i in pick])
            hidden = np.zeros((len(pick), DIMENSION), np.float32)
            np.add.at(hidden, owner, emb[flat])
            hidden /= size[:, None]
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(pick)), labels[pick]] -= 1
            error = (error * weight[labels[pick]][:, None] / len(pick)).astype(np.float32)
            back = (error @ weights.T) / size[:, None]
            weights -= rate * hidden.T @ error
            bias -= np.float32(rate * 0.05) * error.sum(axis=0)
            np.add.at(emb, flat, np.float32(-rate * len(pick)) * back.astype(np.float32)[owner])
    model = LanguageModel(languages, (emb @ weights).astype(np.float32), bias.astype(np.float64))
    return calibrate(model, held)


def calibrate(model: LanguageModel, rows: list[tuple[bytes, int]]) -> LanguageModel:
    """Choose the temperature of least log loss, then the rejection threshold."""
    ids, labels = _segments(rows)
    z = np.stack([model.scores[i].mean(axis=0) if len(i) else np.zeros(len(model.languages)) for i in ids]) + model.bias
    at = np.arange(len(labels))
    model.temperature = min(np.geomspace(0.02, 4, 60), key=lambda t: -np.log(softmax(z / t)[at, labels] + 1e-12).mean())
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == labels]
    model.threshold = float(min(REJECT_BELOW, np.quantile(right, REJECT_SHARE))) if len(right) else REJECT_BELOW
    return model


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text is 2 modulo 4; a null id too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Train on about ``sample_rows`` labelled rows that are not held out, at most that many.

    They are the rows whose id hash lies below a threshold set by their count,
    so tasks send the sample only; rows that share an id give one.
    """
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull())
    share = min(1.0, sample_rows / max(labelled.count(), 1))
    below = min(int(share * 2**64) - 2**63, 2**63 - 1)
    sample = labelled.withColumn("_h", F.xxhash64(id_col)).where(F.col(text_col).isNotNull() & (F.col("_h") <= F.lit(below))) \
        .groupBy("_h").agg(F.min(F.struct(text_bytes(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))).alias("r"))
    rows = sorted((r["_h"], bytes(r["r"]["t"]), r["r"]["l"]) for r in sample.collect())  # about sample_rows
    return train([(t, lang) for _, t, lang in rows[:sample_rows]])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected for every row, from the whole text alone.

    Null texts and texts without a letter get ``und``, score 0 and are rejected.
    Repeated rows are kept. Existing columns of those three names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(raw):
        import pandas as pd

        m = shared.value
        out = [m.predict(bytes(t)) for t in raw]
        return pd.DataFrame({"lang_pred": [x for x, _ in out], "score": [s for _, s in out],
                             "rejected": [x == UNDETERMINED or s < m.threshold for x, s in out]})

    return docs.withColumn("_lang", classify(text_bytes(text_col))).select(*docs.columns, "_lang.*")


