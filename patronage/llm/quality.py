"""Document quality by co-training of two views.

One classifier sees what a text says and how it is written, the other only the page's
metadata: language, source, length and layout. In each round both score a pool of
unlabelled documents, and each hands its most confident verdicts to the other as
labels. At the end a calibration on labelled rows that neither has seen combines the
two scores, and all documents get one.

Defined results: null and empty texts have features of zeros and get the score these
lead to; null metadata counts as a value of its own; with labels of one class only,
every score is that class. Rows with equal columns get equal scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import slices
from patronage.llm.toxicity import held_out

#: Labelled documents of each class and unlabelled ones that the model is fitted to.
FIT_ROWS = {1: 3000, 0: 2000}
POOL_ROWS = 6000
ROUNDS = 4
#: Verdicts that a view hands on in a round, as a share of the pool, and how sure it has to be.
HANDED = 0.05
SURE = 0.95
HASHED = 64
META = 64
THRESHOLD = 0.5


def text_features(text: str) -> np.ndarray:
    """Shares of kinds of characters, repetition, word lengths, and hashed word endings."""
    out = np.zeros(16 + HASHED)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        return out
    counts = np.bincount(data, minlength=256)
    total = len(data)
    letters_low, letters_up = counts[97:123].sum(), counts[65:91].sum()
    seen = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[:16] = (
        letters_low / total, letters_up / total, counts[48:58].sum() / total, counts[128:].sum() / total,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / total,
        counts[10] / total, counts[32] / total, len(seen) / len(words), max(seen.values()) / len(words),
        repeats / len(words), pairs / len(words), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(total / len(words)), counts[33] / len(words), counts[124] / len(words), 1.0,
    )
    for word, count in seen.items():
        out[16 + zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % HASHED] += count / len(words)
    return out


def meta_features(lang: str | None, source: str | None, text: str) -> np.ndarray:
    """Hashed language and source, and the size and layout of the page."""
    out = np.zeros(META + 4)
    for name, value in (("lang", lang), ("source", source)):
        out[zlib.crc32(f"{name}={value}".encode()) % META] += 1.0
    lines = text.count("\n") + 1
    out[META:] = np.log1p(len(text)), np.log1p(lines), np.log1p(len(text) / lines), 1.0
    return out


@dataclass(frozen=True)
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -30, 30)


def chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logits))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30) -> Linear:
    """Ridge logistic regression by Newton steps; ``weight`` per row."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = chance(np.clip(z @ w, -30, 30))
        slope = z.T @ (weight * (y - p)) - penalty * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return Linear(mean, scale, w)


@dataclass(frozen=True)
class QualityModel:
    views: tuple[Linear, Linear] | None
    combined: Linear | None
    constant: float = 0.0

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score, and the scores of the two views."""
        if self.views is None:
            same = np.full(len(text), self.constant)
            return same, same, same
        logits = [view.logits(x) for view, x in zip(self.views, (text, meta), strict=True)]
        return chance(self.combined.logits(np.column_stack(logits))), chance(logits[0]), chance(logits[1])


def co_train(views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> tuple[Linear, Linear]:
    """Fit both views, each also to what the other was surest of in the pool."""
    taken: list[dict[int, float]] = [{}, {}]  # per view: rows of the pool and the labels it was given
    share = labels.mean()
    fitted: list[Linear] = []
    for turn in range(ROUNDS + 1):
        fitted = []
        for k in (0, 1):
            rows = np.array(sorted(taken[k]), np.int64)
            x = np.vstack([views[k], pool[k][rows]]) if len(rows) else views[k]
            y = np.concatenate([labels, [taken[k][i] for i in rows.tolist()]])
            fitted.append(fit_linear(x, y, np.concatenate([np.ones(len(labels)), np.full(len(rows), 0.5)])))
        if turn == ROUNDS or not len(pool[0]):
            break
        for k in (0, 1):
            p = chance(fitted[k].logits(pool[k]))
            each = max(1, int(HANDED * len(p)))
            for label, sure, most in ((1.0, p, int(each * share)), (0.0, 1 - p, int(each * (1 - share)))):
                order = np.argsort(-sure, kind="stable")
                fresh = [i for i in order.tolist() if i not in taken[1 - k] and sure[i] >= SURE][: max(1, most)]
                taken[1 - k].update(dict.fromkeys(fresh, label))
    return fitted[0], fitted[1]


def fit_rows(text: np.ndarray, meta: np.ndarray, labels: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> QualityModel:
    """Every third labelled row calibrates the combination instead of training the views."""
    if len(set(labels.tolist())) < 2:
        return QualityModel(None, None, float(labels[0]) if len(labels) else 0.0)
    later = np.arange(len(labels)) % 3 == 0
    if len(set(labels[~later].tolist())) < 2 or len(set(labels[later].tolist())) < 2:
        later = np.zeros(len(labels), bool)
    views = co_train((text[~later], meta[~later]), labels[~later], pool)
    held = later if later.any() else ~later
    logits = np.column_stack([views[0].logits(text[held]), views[1].logits(meta[held])])
    return QualityModel(views, fit_linear(logits, labels[held], ridge=0.1))


COLUMNS = ("doc_id", "text", "lang", "source")


def _columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *(F.col(c).cast("string").alias(c) for c in COLUMNS[1:]))


def _features(df: DataFrame) -> DataFrame:
    """Both feature vectors of each row, so that whole texts don't go to the driver."""
    kept = [c for c in df.columns if c not in COLUMNS[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, meta = _arrays(part)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))],
                    [*kept, "text_view", "meta_view"],
                )

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.mapInArrow(run, f"{fields}, text_view array<double>, meta_view array<double>")


def _arrays(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = [x or "" for x in part.column("text").to_pylist()]
    langs, sources = (part.column(c).to_pylist() for c in ("lang", "source"))
    text = np.array([text_features(x) for x in texts])
    meta = np.array([meta_features(a, b, x) for a, b, x in zip(langs, sources, texts, strict=True)])
    return text, meta


def fit(df: DataFrame, labels: DataFrame, target: str = "quality") -> QualityModel:
    """Fit to bounded samples, chosen by a hash of the key among labelled rows that are
    not held out, and among all documents for the pool."""
    docs = _columns(df)
    marked = labels.select("doc_id", F.col(target).cast("int").alias("label")).dropna().filter("label IN (0, 1)")
    marked = marked.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = (F.xxhash64("doc_id", F.lit(10)), "doc_id")
    parts = [marked.filter(F.col("label") == k).orderBy(*order).limit(most) for k, most in FIT_ROWS.items()]
    labelled = marked.select("doc_id")
    pool = docs.select("doc_id").dropna().join(labelled, "doc_id", "left_anti").distinct().orderBy(*order).limit(POOL_ROWS)
    chosen = parts[0].unionAll(parts[1]).unionAll(pool.select("doc_id", F.lit(-1).alias("label")))
    # At most sum(FIT_ROWS) + POOL_ROWS pairs of numbers.
    found = _features(docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))
    rows = found.orderBy(*order).collect()
    text = np.array([row.text_view for row in rows]).reshape(len(rows), -1)
    meta = np.array([row.meta_view for row in rows]).reshape(len(rows), -1)
    label = np.array([row.label for row in rows], float)
    known = label >= 0
    if not known.any():
        return QualityModel(None, None)
    return fit_rows(text[known], meta[known], label[known], (text[~known], meta[~known]))


def score(df: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, and the scores of both views, for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = shared.value.scores(*_arrays(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, scores)], ["doc_id", "score", "text_score", "meta_score"])

    scored = _columns(df).mapInArrow(run, f"doc_id {kind}, score double, text_score double, meta_score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "text_score", "meta_score"
    )
