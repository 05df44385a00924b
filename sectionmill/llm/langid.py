"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 letters, words set off by spaces) with
TF-IDF weights and unit length. Document frequencies are counted over all training
documents. The weights are fitted by follow-the-regularised-leader with L1 and L2 penalties on a
bounded sample of at most about ``PER_LANGUAGE`` documents of each language (fewer
when there are fewer), chosen by a hash of the id; one document in five of that sample
sets the temperature of the output instead: whole, and as excerpts of a few words, which are
hard enough to be wrong about. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches, fresh, valid

BUCKETS, NGRAMS, PER_LANGUAGE, EPOCHS = 1 << 15, 3, 400, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNDETERMINED = "und"
#: Words of the excerpts that set the temperature.
EXCERPTS = (1, 2, 4, 8)
#: Rows and characters that are counted together.
_ROWS, _CHARS = 48, 400_000
_U32 = np.uint32


@dataclass
class LanguageModel:
    """A fitted model; small enough for every task to hold."""

    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    idf: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS, np.float32))
    temperature: float = 1.0
    #: Mean gap between score and accuracy of the documents and excerpts that set the temperature.
    calibration_error: float = 0.0


def letters(text: Column) -> Column:
    """Lower-case letters, with one space before, between and after the words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(valid(text), F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def ngram_counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first text, counts of its run of texts by bucket)."""
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or (end - start < _ROWS and held + len(texts[end]) <= _CHARS)):
            held += len(texts[end])
            end += 1
        u = np.frombuffer("\n".join(texts[start:end]).encode("utf-32-le", "surrogatepass"), _U32)
        cut = u == 10
        row = np.cumsum(cut)
        ends = row + cut
        places = []
        with np.errstate(over="ignore"):
            h = np.zeros(len(u), _U32)
            for n in range(1, NGRAMS + 1):
                m = len(u) - n + 1
                if m <= 0:
                    break
                h = (h[:m] ^ u[n - 1 :]) * _U32(0x01000193) + _U32(n)
                x = h ^ (h >> _U32(15))
                x = x * _U32(0x2C1B3C6D)
                x ^= x >> _U32(12)
                inside = (row[:m] == ends[n - 1 :]) & ~cut[:m]
                places.append((row[:m] * BUCKETS + (x & _U32(BUCKETS - 1)))[inside])
        counts = np.bincount(np.concatenate(places) if places else np.zeros(0, np.int64), minlength=(end - start) * BUCKETS)
        yield start, counts.reshape(end - start, BUCKETS)
        start = end


def _tf(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts.astype(np.float32))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, counts in ngram_counts(batch.column("letters").to_pylist()):
            df += (counts > 0).sum(axis=0)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, tf = [], []
        for _, counts in ngram_counts(batch.column("letters").to_pylist()):
            for c in counts:
                i = np.flatnonzero(c)
                at.append(i.astype(np.int32))
                tf.append(_tf(c[i]))
        kept = ["order", "lang", "held", "part"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32()))], names=[*kept, "at", "tf"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, n_buckets: int = BUCKETS, *, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (bucket, class) by FTRL-proximal with an elastic-net penalty."""
    z, n = np.zeros((n_buckets, n_classes)), np.zeros((n_buckets, n_classes))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(nn + g * g)
            z[at] = zz + g - (root - np.sqrt(nn)) / ALPHA * w
            n[at] = nn + g * g
    return weights(z, n)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    a, b, g = np.log(1e-4), np.log(1e4), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def calibration_error(p: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """The gap between mean score and share of right predictions, over bins of the score, by their rows."""
    if not len(p):
        return 0.0
    at = np.minimum((p * bins).astype(int), bins - 1)
    n = np.bincount(at, minlength=bins)
    return float(np.abs(np.bincount(at, weights=p, minlength=bins) - np.bincount(at, weights=right, minlength=bins)).sum() / n.sum())


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def excerpts(order: Column, text: Column) -> Column:
    """The text, and runs of its words of the lengths in ``EXCERPTS``, from a place that the order's hash sets."""
    words = F.split(F.trim(text), " ")
    runs = [F.slice(words, (F.pmod(order, F.greatest(F.size(words) - k + 1, F.lit(1))) + 1).cast("int"), F.lit(k)) for k in EXCERPTS]
    return F.array(text, *[F.concat(F.lit(" "), F.array_join(r, " "), F.lit(" ")) for r in runs])


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on ``train``; rows with a null language or without letters teach nothing.

    ``per_language`` bounds the expected number of sampled documents of a language; the
    rest of the rows count towards document frequencies only. An empty ``train`` gives a model
    without languages, which calls every text undetermined.
    """
    bound_batches(train.sparkSession)
    rows = train.where(F.col(lang_col).isNotNull()).select(
        F.xxhash64(F.col(id_col).cast("string")).alias("order"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel()
    named = rows.select("order", "lang", letters(F.col("text")).alias("letters")).where("length(letters) > 2")
    df = np.zeros(BUCKETS, np.int64)
    for bucket, n in named.select("letters").mapInArrow(_document_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df")).collect():
        df[bucket] = n
    idf = (np.log((1 + sum(sizes.values())) / (1.0 + df)) + 1).astype(np.float32)

    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    chosen = rows.where(F.pmod("order", F.lit(1 << 30)) < share * (1 << 30)).select("order", "lang", letters(F.col("text")).alias("whole")).where("length(whole) > 2")
    held = F.pmod(F.shiftright("order", 30), F.lit(5)) == 0
    chosen = chosen.select("order", "lang", held.alias("held"), F.posexplode(F.when(held, excerpts(F.col("order"), F.col("whole"))).otherwise(F.array("whole"))).alias("part", "letters"))
    found = chosen.mapInArrow(_sparse, "order long, lang string, held boolean, part int, at array<int>, tf array<float>").toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if not languages:
        return LanguageModel()
    samples = []
    for order, lang, apart, part, at, tf in zip(*(found.column(c).to_pylist() for c in ("order", "lang", "held", "part")), found.column("at"), found.column("tf"), strict=True):
        i = at.values.to_numpy()
        x = tf.values.to_numpy() * idf[i]
        samples.append((order, part, languages.index(lang), apart, i, x / np.linalg.norm(x)))
    samples.sort(key=lambda s: (*s[:4], len(s[4])))
    enough = sum(s[1] == 0 for s in samples) >= 50
    held_out = [s for s in samples if s[3]] if enough else []
    taught = [(i, x, y) for _, part, y, apart, i, x in samples if part == 0 and not (enough and apart)]
    w = ftrl(taught, len(languages)).astype(np.float32)
    logits = np.array([x @ w[i] for *_, i, x in held_out]).reshape(len(held_out), len(languages))
    y = np.array([s[2] for s in held_out], int)
    temperature = best_temperature(logits, y)
    p = softmax(logits / temperature) if len(y) else logits
    return LanguageModel(languages, w, idf, temperature, calibration_error(p.max(axis=1), p.argmax(axis=1) == y) if len(y) else 0.0)


def _predictor(model: LanguageModel, column: str):
    names = np.array([*model.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = model.weights.any(axis=1)
        for batch in batches:
            texts = batch.column(column).to_pylist()
            best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            if model.languages:
                for start, counts in ngram_counts(texts):
                    n = len(counts)
                    at = np.flatnonzero(counts)
                    row, bucket = at // BUCKETS, at % BUCKETS
                    x = _tf(counts.reshape(-1)[at]) * model.idf[bucket]
                    norm = np.sqrt(np.bincount(row, x * x, n))
                    told = active[bucket]  # most n-grams have no weight at all
                    row, bucket, x = row[told], bucket[told], x[told]
                    s = np.stack([np.bincount(row, x * model.weights[bucket, k], n) for k in range(len(model.languages))], axis=1)
                    p = softmax(s / np.maximum(norm, 1e-9)[:, None] / model.temperature)
                    known = np.array([len(t) > 2 for t in texts[start : start + n]])
                    at = np.flatnonzero(known) + start
                    best[at] = p.argmax(axis=1)[known]
                    score[at] = p.max(axis=1)[known]
            kept = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); columns of these names are replaced, all others pass through.

    A null text, or one without letters, is ``und`` with score 0. Ties go to the language
    that is first in the alphabet. Nothing but the text is read for a prediction; repeated rows and rows with null
    ids are predicted like others, very long texts whole, and broken UTF-8 counts as no letter. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    column = fresh(docs, "letters")
    return docs.withColumn(column, letters(F.col(text_col))).mapInArrow(_predictor(model, column), schema)


def in_fold(id_col: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id, as text, leaves ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def identify(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` with predictions of a model fitted on the documents outside fold 2.

    Null texts and languages teach nothing; repeated rows count as often as they stand. What a row
    gets is told at :func:`predict`. Without any labelled text every document is ``und``.
    """
    return predict(docs, fit(docs.where(~in_fold()), per_language=per_language))
