"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text. A dictionary trained on windows of
toxic texts holds hardly anything but ordinary words, since a toxic text has few others; it
told the classes apart with an AUC of 0.8 at best. So one dictionary is trained on ordinary
windows, and the other has a list of the words that only toxic texts use in front of the same
ordinary part. The ordinary part also holds ordinary words that begin or end like the
listed ones, so a part of a listed word saves nothing.
A window of a text is compressed with both; the bytes that the toxic dictionary saves
are its distance. A document's largest and summed savings, its length and the share of windows with a saving go through a logistic
calibration on labelled rows that the dictionaries have not seen: each fold of the rows is
measured with dictionaries of the others. The length of match and the size of the trained
dictionary are those of least calibration loss; the final dictionaries are made from all rows.

Defined results: null and empty texts have no window and get the calibrated score of
savings of zero. Without a labelled row of each class every score is 0. Rows with
equal texts get equal scores. Other columns of the input are kept.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from patronage.llm.common import slices, tidy

#: Labelled rows of each class that a model is fitted to, and the longest text among them.
FIT_ROWS = {1: 2000, 0: 4000}
FIT_CHARS = 16_000
WINDOW_WORDS = 12
#: Ordinary windows that a dictionary is trained on at most, spread evenly over the labelled rows.
FIT_WINDOWS = 60_000
#: Words longer than this are cut into windows of their own.
LONG_WORD = 512
#: Sizes of the trained dictionary and shortest matches that calibration chooses from.
DICTIONARY_BYTES = (640, 3000)
MATCHES = (5, 6)
FOLDS = 3
#: Most bytes of the list of toxic words; the words in the most surroundings come first.
TOXIC_BYTES = 1200
#: Ordinary words are put beside a toxic one from this many equal letters at either end.
ALIKE = 3
#: End of the ordinary dictionary that goes before each window, so that no window is
#: too short for the compressor to bother with.
LEAD_BYTES = 64
#: A toxic word appears nearly only in toxic texts.
TOXIC_SHARE = 0.95
THRESHOLD = 0.7
SAVED_MOST = 8.0
LEVELS = (2, 3, 4, 5, 6)
FEATURES = 4 + len(LEVELS)


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if len(text) > LONG_WORD and any(len(word) > LONG_WORD for word in words):
        words = [word[i : i + LONG_WORD] for word in words for i in range(0, len(word), LONG_WORD)]
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    min_match: int = 6

    def scores(self, rows: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(rows))
        bias, *slopes = self.weights
        z = bias + savings(self.ordinary, self.toxic, rows, self.min_match) @ np.array(slopes)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@lru_cache(maxsize=4)
def _compressor(content: bytes, min_match: int) -> zstandard.ZstdCompressor:
    # An optimal parse over small tables: sizes then hardly depend on anything but
    # the matches that a dictionary offers.
    settings = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=14, chain_log=14, search_log=4, min_match=min_match, target_length=64,
        strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False,
        write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def savings(ordinary: bytes, toxic: bytes, rows: list[bytes], min_match: int) -> np.ndarray:
    """Per text: largest saving of a window, the logarithm of all savings above 1 byte,
    that of the number of windows, the share of windows with a saving, and the logarithms
    of the numbers of windows that save at least each of LEVELS bytes."""
    one, other = _compressor(ordinary, min_match).compress, _compressor(toxic, min_match).compress
    lead = ordinary[-LEAD_BYTES:]
    out = np.zeros((len(rows), FEATURES))
    for i, row in enumerate(rows):
        saved = [len(one(lead + window)) - len(other(lead + window)) for window in windows(row)]
        if saved:
            large = [x for x in saved if x > 1]
            out[i, :4] = min(max(0, *saved, 0), SAVED_MOST), np.log1p(sum(large)), np.log1p(len(saved)), len(large) / len(saved)
            out[i, 4:] = [np.log1p(sum(x >= level for x in large)) for level in LEVELS]
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary, or the samples themselves if they are too few to train on."""
    if not samples:
        return b" " * 8
    try:
        content = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(samples)
    return content[-size:].rjust(8, b" ")


def _toxic_words(toxic: list[bytes], ordinary: list[bytes]) -> Counter[bytes]:
    """Words of toxic texts, with the number of different surroundings, which copies don't raise.

    There have to be so many that chance would hardly put any word of the sample
    into toxic texts alone."""
    if not toxic or not ordinary:
        return Counter()
    around = defaultdict(set)
    share = Counter()
    for text in toxic:
        words = [b"", *text.lower().split(), b""]
        share.update(set(words))
        for before, word, after in zip(words, words[1:], words[2:], strict=False):
            around[word].add((before, after))
    elsewhere = Counter()
    for text in ordinary:
        elsewhere.update(around.keys() & set(text.lower().split()))
    rate = len(toxic) / max(1, len(ordinary))
    least = max(3, math.ceil(math.log(len(around) + 2) / math.log(1 + 1 / rate)))
    return Counter(
        {
            word: len(places)
            for word, places in around.items()
            if len(places) >= least and share[word] >= TOXIC_SHARE * (share[word] + rate * elsewhere[word])
        }
    )


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.array([1e-6] + [0.02] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _alike(words: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The commonest ordinary word for each beginning and end that ``words`` share with ordinary ones."""
    seen = Counter(word for text in ordinary for word in set(text.lower().split()))
    for word in words:
        seen.pop(word, None)
    ends = {part for word in words for n in range(ALIKE, len(word)) for part in ((0, word[:n]), (1, word[-n:]))}
    best: dict[tuple[int, bytes], tuple[int, bytes]] = {}
    for word, times in seen.items():
        for n in range(ALIKE, min(len(word), LONG_WORD) + 1):
            for part in ((0, word[:n]), (1, word[-n:])):
                if part in ends and best.get(part, (0, b"")) < (times, word):
                    best[part] = (times, word)
    return sorted({word[:LONG_WORD] for _, word in best.values()})


def _dictionaries(rows: list[tuple[int, bytes]]) -> dict[int, tuple[bytes, bytes]]:
    """The ordinary and the toxic dictionary for each of DICTIONARY_BYTES."""
    toxic, ordinary = ([text for label, text in rows if label == k] for k in (1, 0))
    counted = _toxic_words(toxic, ordinary)
    listed, size = [], 0
    for word in sorted(counted, key=lambda word: (-counted[word], word)):
        size += len(word) + 2
        if size <= TOXIC_BYTES:
            listed.append(word)
    # What is nearest to the text costs least, so the words in the most surroundings come last.
    special = b"".join(b" " + word + b" " for word in reversed(listed))
    beside = b"".join(b" " + word + b" " for word in _alike(listed, ordinary))
    samples = [window for text in ordinary for window in windows(text)]
    samples = samples[:: max(1, -(-len(samples) // FIT_WINDOWS))]
    common = {most: beside + _trained(samples, most) for most in DICTIONARY_BYTES}
    return {most: (content, special + content) for most, content in common.items()}


def fit_rows(rows: list[tuple[int, str]]) -> ToxicityModel:
    """Fit to (label, text) rows."""
    texts = [(label, text.encode()) for label, text in rows]
    labels = np.array([label for label, _ in texts], float)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(b"", b"", ())
    x = {(most, match): np.zeros((len(texts), FEATURES)) for most in DICTIONARY_BYTES for match in MATCHES}
    for fold in range(FOLDS):
        made = _dictionaries([row for i, row in enumerate(texts) if i % FOLDS != fold])
        held = [text for _, text in texts[fold::FOLDS]]
        for most, match in x:
            x[most, match][fold::FOLDS] = savings(*made[most], held, match)
    fits = {}
    for choice, features in x.items():
        weights = _logistic(features, labels)
        z = np.clip(weights[0] + features @ np.array(weights[1:]), -30, 30)
        fits[choice] = float(np.log1p(np.exp(np.where(labels == 1, -z, z))).mean()), weights
    most, match = min(fits, key=lambda choice: fits[choice][0])
    return ToxicityModel(*_dictionaries(texts)[most], fits[most, match][1], match)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> ToxicityModel:
    """Fit to a bounded sample of labelled rows that are not held out, chosen by a hash of the key.

    At most sum(FIT_ROWS) rows of at most FIT_CHARS characters reach the driver."""
    marked = labels.select("doc_id", F.col(target).cast("int").alias("label"))
    marked = marked.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    marked = marked.withColumn("at", F.xxhash64("doc_id"))
    parts = [marked.filter(F.col("label") == label).orderBy("at", "doc_id").limit(most) for label, most in FIT_ROWS.items()]
    chosen = F.broadcast(parts[0].unionAll(parts[1]))  # at most sum(FIT_ROWS) rows of three numbers
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, FIT_CHARS))
    found = texts.join(chosen, "doc_id").groupBy("doc_id", "at", "label").agg(F.min("text").alias("text"))
    rows = found.select("at", "label", "text").collect()
    return fit_rows([(label, text) for _, label, text in sorted(map(tuple, rows))])


def score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``df`` and the score of ``text``; a column named as ``out`` is replaced."""
    rest = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows = [x.encode() if x else b"" for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(rows))], [*part.schema.names, out])

    return rest.mapInArrow(tidy(run), StructType([*rest.schema.fields, StructField(out, DoubleType())]))


def classify(df: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    scored = score(df.select("doc_id", "text"), model, out="score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
