"""Operator 4 - language identification.

Multinomial logistic regression on TF-IDF weights of character n-grams (n = 1, 2, 3, over the lower-cased
letters of a text with runs of anything else as one blank), hashed to ``buckets`` features, trained
by follow-the-regularised-leader (FTRL-proximal) with an elastic net, so most weights are exactly
zero; a temperature is then fitted on examples kept out of the training.

Document frequencies are counted over all learnable rows (one partial count vector per task). The
classifier is fitted on at most ``sample_rows`` different labelled rows (one a label at least), chosen by a
hash: first an equal share for each label, then the rest in proportion to what the labels have left. So
a rare label is learned in a table of any size. Only the sparse count vectors of these rows reach
the driver (at most ``buckets`` entries a row).

Learnable: non-null label, and crc32(id as text) mod 5 is not 0 (a null id is read as empty text).
Cases: null text or text without a letter: ``und``, score 1 if nothing can be said (no letter). No
learnable row at all: every row is ``und``. One label only: it is predicted for every row with
a letter. Repeated rows, ties (the smaller label wins) and texts of any length are handled
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices

BUCKETS = 1 << 15
SAMPLE_ROWS = 4000
EPOCHS = 3
FOLDS = 5
TOP = 1 << 50                  # row hashes are below it
UNKNOWN = "und"


def features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the character n-grams of a whole text, n = 1, 2, 3; none without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = ((c >= 97) & (c <= 122)) | (c > 127)
    if len(c) and (c > 127).any():
        odd = np.unique(c[c > 127])
        letter &= ~np.isin(c, odd[[not chr(x).isalpha() for x in odd.tolist()]])
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(letter, c, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]                                   # one blank after each word
    c = np.concatenate([[np.uint64(32)], c[keep], [np.uint64(32)]])
    two = c[:-1] << np.uint64(21) | c[1:]
    grams = (c, two | np.uint64(1 << 62), two[:-1] << np.uint64(21) | c[2:] | np.uint64(1 << 63))
    count = np.zeros(buckets, np.int64)
    for g in grams:
        count += np.bincount((mix(g) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(count)
    return at, count[at]


def vector(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length 1."""
    w = (1 + np.log(count)) * idf[at]
    return w / max(np.sqrt((w * w).sum()), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list, labels: np.ndarray, classes: int, buckets: int, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.1, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (buckets x classes) by FTRL-proximal, one coordinate-wise step per example."""
    z, n = np.zeros((buckets, classes)), np.zeros((buckets, classes))
    order = np.random.default_rng(seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = _softmax(x @ w)
            g[labels[i]] -= 1
            g = x[:, None] * g[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        p = _softmax(scores / np.exp(t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    lo, hi, g = np.log(0.01), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _held_out(c):
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % FOLDS == 0


def _quotas(have: dict, sample_rows: int) -> dict:
    """Rows of each label: an equal share, then the rest in proportion to the rows left."""
    equal = max(1, sample_rows // len(have))
    got = {k: min(n, equal) for k, n in have.items()}
    left = {k: n - got[k] for k, n in have.items()}
    rest, total = max(0, sample_rows - sum(got.values())), sum(left.values())
    return {k: got[k] + (min(left[k], rest * left[k] // total) if total else 0) for k in have}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """The model as plain arrays (labels, idf, weights, temperature), or None without a learnable row."""
    key = F.col(f"`{id_col}`")
    learn = docs.select(key.cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                        F.col(f"`{label_col}`").cast("string").alias("label")).filter(
        F.col("label").isNotNull() & ~_held_out(key))
    learn = learn.withColumn("h", F.pmod(F.xxhash64("id", "label", "text"), F.lit(TOP)))
    found = learn.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("have")).collect()
    n = sum(r["n"] for r in found)                                                # one row per language
    if not n:
        return None
    labels = sorted(r["label"] for r in found)
    have = {r["label"]: max(1, r["have"]) for r in found}
    quota = _quotas(have, sample_rows)

    def below(limits):
        """Rows with hashes up to the limit of their label, each once."""
        side = docs.sparkSession.createDataFrame(sorted(limits.items()), "label string, top long")
        return learn.join(F.broadcast(side), "label").filter(F.col("h") <= F.col("top"))

    # somewhat more hashes than needed, then the smallest of each label
    limits = {k: min(TOP, int(TOP * (1.5 * q + 20) / have[k])) for k, q in quota.items()}
    near = {}
    for r in below(limits).select("label", "h").distinct().collect():             # a small multiple of sample_rows
        near.setdefault(r["label"], []).append(r["h"])
    limits = {k: sorted(v)[:quota[k]][-1] for k, v in near.items()}

    def count(batches):
        total, rows = np.zeros(buckets, np.int64), 0
        for whole in batches:
            for b in slices(whole):
                for t in pc.fill_null(b.column("text"), "").to_pylist():
                    total[features(t, buckets)[0]] += 1
                    rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    def sample(batches):
        for whole in batches:
            for b in slices(whole):
                got = [features(t, buckets) for t in pc.fill_null(b.column("text"), "").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("label"), b.column("h"), pa.array([x[0].astype("<i4").tobytes() for x in got], pa.binary()),
                     pa.array([x[1].astype("<i4").tobytes() for x in got], pa.binary())],
                    names=["label", "h", "at", "count"])

    df = np.zeros(buckets)
    for r in learn.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(
            F.sum("n").alias("n")).toLocalIterator():                              # at most ``buckets`` rows
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = (below(limits).groupBy("label", "h").agg(F.min("text").alias("text"))
            .mapInArrow(sample, "label string, h long, at binary, count binary").collect())
    x, y = [], []
    for r in sorted(rows, key=lambda r: (r["h"], r["label"])):
        at = np.frombuffer(r["at"], "<i4").astype(np.int64)
        if len(at):
            x.append((at, vector(at, np.frombuffer(r["count"], "<i4").astype(float), idf)))
            y.append(labels.index(r["label"]))
    y = np.array(y, np.int64)
    keep = np.arange(len(x)) % FOLDS != 1                      # the others fit the temperature
    w = ftrl([x[i] for i in np.flatnonzero(keep)], y[keep], len(labels), buckets)
    rest = np.flatnonzero(~keep)
    z = np.array([x[i][1] @ w[x[i][0]] for i in rest]).reshape(len(rest), len(labels))
    return {"labels": labels, "idf": idf, "weights": w, "temperature": temperature(z, y[rest]), "buckets": buckets}


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score (probability of the prediction)."""
    key = F.col(f"`{id_col}`")
    src = docs.select(key.alias("id"), _held_out(key).alias("held_out"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)    # buckets x (labels + 1) numbers

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in slices(whole):
                lang, score = [], []
                for t in pc.fill_null(b.column("text"), "").to_pylist():
                    at, count = features(t, m["buckets"]) if m else ((), ())
                    if len(at):
                        p = _softmax(vector(at, count, m["idf"]) @ m["weights"][at] / m["temperature"])
                        k = int(p.argmax())
                        lang.append(m["labels"][k])
                        score.append(float(min(p[k], 1.0)))
                    else:
                        lang.append(UNKNOWN)
                        score.append(1.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=["id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed(
        "id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the learnable rows of ``docs`` and predict every row."""
    return predict(docs, train(docs, id_col, text_col, label_col, sample_rows=sample_rows), id_col, text_col)
