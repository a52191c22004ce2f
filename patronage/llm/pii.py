"""Personal data: fixed patterns, and a linear-chain conditional random field that adds to them.

The patterns give the base spans. They miss what runs into its neighbour, such as a
phone number followed by a card number. The field reads words by their shape: it is
trained on a small table of documents in which the patterns label the words, leaving
out places where a pattern matched and its check failed. It decodes, by Viterbi over
padded arrays, the runs of words around those that hold a digit or an at sign; a run
of other words is outside by definition. What it finds beyond the base spans is added
if it passes the check of its kind.

Defined results: null and empty texts have no spans (masking leaves them as they are);
offsets are code points, the end excluded; spans are ordered by start, then by kind
as in KINDS. Rows with equal texts get equal spans. Other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from patronage.llm.common import keyed_texts, slices, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))
#: Documents that the field is trained on, and the longest among them.
FIT_DOCS = 2000
FIT_CHARS = 16_000
#: Plain words kept on each side of words that hold a digit or an at sign.
AROUND = 2
#: Longest run decoded at once; a longer one is cut.
RUN_WORDS = 64
FEATURES = 1 << 13
PER_WORD = 9

# Runs are taken whole (possessive), which finds the same matches in linear time.
_EMAIL_END = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EMAIL_START = re.compile(r"[A-Za-z0-9._%+-]++@")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_MARKED = re.compile(r"[0-9@]")
_SHAPE_PARTS = ((re.compile("[A-Z]+"), "A"), (re.compile("[^\\W\\d_A-Z]+"), "a"))
_DIGITS = re.compile("[0-9]+")

Span = tuple[str, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    doubled = [int(c) * 2 for c in number[-2::-2]]
    return (sum(map(int, number[-1::-2])) + sum(x - 9 if x > 9 else x for x in doubled)) % 10 == 0


def passes(kind: str, text: str) -> bool:
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == "card":
        number = digits(text)
        return 12 <= len(number) <= 19 and luhn(number)
    if kind == "phone":
        return 9 <= len(digits(text)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while match := _EMAIL_START.search(text, at):
        end = _EMAIL_END.match(text, match.end() - 1)
        if end:
            yield match.start(), end.end()
        at = end.end() if end else match.end()


def pattern_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """All matches of the patterns, and whether each passes its check."""
    out = []
    if "@" in text:
        out += [("email", a, b, True) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for match in pattern.finditer(text):
            out.append((kind, *match.span(), passes(kind, match[0])))
    return out


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def base_spans(text: str) -> list[Span]:
    return ordered(match[:3] for match in pattern_matches(text) if match[3]) if _MARKED.search(text) else []


# --- words and their features ----------------------------------------------------------


def _runs(text: str) -> list[list[tuple[int, int]]]:
    """Words around those with a digit or an at sign, in runs."""
    words = [match.span() for match in _WORD.finditer(text)]
    marked = [i for i, (a, b) in enumerate(words) if _MARKED.search(text, a, b)]
    if not marked:
        return []
    bounds = []
    for i in marked:
        low, high = max(0, i - AROUND), min(len(words), i + AROUND + 1)
        if bounds and low <= bounds[-1][1]:
            bounds[-1][1] = high
        else:
            bounds.append([low, high])
    return [words[k : min(k + RUN_WORDS, high)] for low, high in bounds for k in range(low, high, RUN_WORDS)]


def shape(word: str) -> str:
    word = word[:200]
    word = _DIGITS.sub(lambda m: "9" * min(len(m[0]), 5) + ("+" if len(m[0]) > 5 else ""), word)
    for pattern, sign in _SHAPE_PARTS:
        word = pattern.sub(sign, word)
    return word[:40]


def _hash(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) % FEATURES


def _word_features(word: str, cache: dict[str, tuple[list[int], int, int]]) -> tuple[list[int], int, int]:
    """Features of the word itself, and of it as the one before or after another."""
    own = shape(word)
    if own not in cache:
        if len(cache) > 200_000:
            cache.clear()
        count = sum(c == "9" for c in own)
        cache[own] = (
            [_hash("shape", own), _hash("first", own[:3]), _hash("last", own[-3:]), _hash("at", "@" in own, own.count(".")),
             _hash("digits", count, own[:1]), _hash("kinds", "".join(sorted(set(own)))), _hash("bias")],
            _hash("before", own if count or "@" in own else "a"),
            _hash("after", own if count or "@" in own else "a"),
        )
    return cache[own]


def _features(text: str, run: list[tuple[int, int]], cache: dict) -> np.ndarray:
    found = [_word_features(text[a:b], cache) for a, b in run]
    out = np.empty((len(run), PER_WORD), np.int32)
    for i, (own, _, _) in enumerate(found):
        out[i, :7] = own
        out[i, 7] = found[i - 1][1] if i else 0
        out[i, 8] = found[i + 1][2] if i + 1 < len(found) else 1
    return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(row) for row in rows])
    out = np.zeros((len(rows), int(lengths.max()), PER_WORD), np.int32)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out, lengths


# --- the field -------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    emission: np.ndarray  # feature, label
    transition: np.ndarray  # label, next label; a label cannot be followed by the inside of another kind

    def decode(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each run, by Viterbi over runs of like lengths."""
        out: list[np.ndarray] = [np.array([], np.int64)] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        for k in range(0, len(order), 512):
            names = order[k : k + 512]
            features, lengths = _padded([rows[i] for i in names])
            scores = self.emission[features].sum(axis=2)
            best, back = scores[:, 0] + START, []
            for t in range(1, scores.shape[1]):
                steps = best[:, :, None] + self.transition
                back.append(steps.argmax(axis=1))
                new = steps.max(axis=1) + scores[:, t]
                best = np.where((t < lengths)[:, None], new, best)
            label = best.argmax(axis=1)
            path = np.zeros((len(names), scores.shape[1]), np.int64)
            for t in range(scores.shape[1] - 1, -1, -1):
                path[:, t] = label
                if t:
                    label = np.where(t < lengths, back[t - 1][np.arange(len(names)), label], label)
            for i, row, length in zip(names, path, lengths.tolist(), strict=True):
                out[i] = row[:length]
        return out


_BARRED = -1e4
START = np.array([_BARRED if label[0] == "I" else 0.0 for label in LABELS])
ALLOWED = np.array(
    [[0.0 if b[0] != "I" or a[1:] == b[1:] else _BARRED for b in LABELS] for a in LABELS]
)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Maximum conditional likelihood by Adam, with forward and backward passes over all runs at once."""
    n = len(LABELS)
    emission, transition = np.zeros((FEATURES, n)), np.zeros((n, n))
    if not rows:
        emission[:, 0] = 1.0
        return Field(emission, transition + ALLOWED)
    features, lengths = _padded(rows)
    count, longest = features.shape[:2]
    gold = np.zeros((count, longest), np.int64)
    live = np.arange(longest) < lengths[:, None]
    for i, row in enumerate(labels):
        gold[i, : len(row)] = row
    flat, target = features[live], np.eye(n)[gold[live]]
    both = live[:, 1:]
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    moments = [np.zeros_like(x) for x in (emission, emission, transition, transition)]
    for step in range(1, rounds + 1):
        scores, moves = emission[features].sum(axis=2), transition + ALLOWED
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0] + START
        for t in range(1, longest):
            new = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
            ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum(moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(live[:, t + 1, None], new, 0.0)
        total = _log_sum(ahead[:, -1], 1)
        chance = np.exp(ahead + behind - total[:, None, None])[live]
        gradient = np.zeros_like(emission)
        for k in range(PER_WORD):
            np.add.at(gradient, flat[:, k], target - chance)
        expected = np.zeros((n, n))
        for t in range(longest - 1):
            pair = ahead[:, t, :, None] + moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :] - total[:, None, None]
            expected += np.exp(pair[live[:, t + 1]]).sum(axis=0)
        for k, (value, slope) in enumerate(((emission, gradient), (transition, seen - expected))):
            slope = slope / count - decay * value
            first, second = moments[2 * k], moments[2 * k + 1]
            first *= 0.9
            first += 0.1 * slope
            second *= 0.99
            second += 0.01 * slope**2
            value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(emission.astype(np.float32), (transition + ALLOWED).astype(np.float32))


def labelled_runs(text: str, cache: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs with labels from the patterns, without those where a check failed."""
    found = pattern_matches(text)
    spans = sorted((a, b, kind) for kind, a, b, good in found if good)
    failed = [(a, b) for kind, a, b, good in found if not good and b - a >= 7 and not any(x <= a and b <= y for x, y, _ in spans)]
    for run in _runs(text):
        low, high = run[0][0], run[-1][1]
        if any(a < high and b > low for a, b in failed):
            continue
        labels = np.zeros(len(run), np.int64)
        for a, b, kind in spans:
            touched = [i for i, (x, y) in enumerate(run) if x < b and y > a]
            if touched and not labels[touched].any():
                labels[touched] = 2 + 2 * KINDS.index(kind)
                labels[touched[0]] -= 1
        yield _features(text, run, cache), labels


def fit(df: DataFrame, text: str = "text") -> Field:
    """Train on a bounded table: FIT_DOCS documents of at most FIT_CHARS characters, chosen by a hash."""
    texts = df.select(F.col(text).alias("text")).filter(F.length("text").between(1, FIT_CHARS) & F.col("text").rlike("[0-9@]"))
    texts = texts.withColumn("at", F.xxhash64("text"))
    first = texts.select("at").distinct().orderBy("at").limit(FIT_DOCS).agg(F.max("at")).first()[0]
    rows = texts.filter(F.col("at") <= F.lit(first)).groupBy("at").agg(F.min("text").alias("text")).orderBy("at").collect()
    cache: dict = {}
    found = [pair for row in rows for pair in labelled_runs(row.text, cache)]
    return train([a for a, _ in found], [b for _, b in found])


_EDGE = {kind: re.compile(r"^[^\w+(]+|[^\w)]+$") for kind in KINDS}


def added_spans(text: str, run: list[tuple[int, int]], labels: np.ndarray, base: list[Span]) -> Iterator[Span]:
    groups: list[tuple[str, int, int]] = []
    for (a, b), label in zip(run, labels.tolist(), strict=True):
        if label and LABELS[label][0] == "B":
            groups.append((LABELS[label][2:], a, b))
        elif label and groups:
            groups[-1] = (groups[-1][0], groups[-1][1], b)
    for kind, a, b in groups:
        part = text[a:b]
        trimmed = _EDGE[kind].sub("", part)
        a += part.find(trimmed)
        b = a + len(trimmed)
        good = "@" in trimmed if kind == "email" else passes(kind, trimmed)
        if trimmed and good and not any(x < b and y > a for _, x, y in base):
            yield kind, a, b


def find_in(texts: list[str], field: Field, cache: dict) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    bases, rows, owners = [], [], []
    for i, text in enumerate(texts):
        bases.append(base_spans(text))
        for run in _runs(text) if _MARKED.search(text) else ():
            rows.append(_features(text, run, cache))
            owners.append((i, run))
    more: dict[int, list[Span]] = {}
    for (i, run), labels in zip(owners, field.decode(rows), strict=True):
        if labels.any():
            more.setdefault(i, []).extend(added_spans(texts[i], run, labels, bases[i]))
    return [(base, ordered([*base, *more[i]]) if i in more else base) for i, base in enumerate(bases)]


def find(df: DataFrame, field: Field, text: str = "text", out: str = "pii") -> DataFrame:
    """All columns of ``df`` and the spans in ``text``: kind, start, end, and whether a pattern found it."""
    rest = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(field)  # FEATURES x labels, whatever the input
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for part in slices(batch, text):
                found = find_in([x or "" for x in part.column(text).to_pylist()], shared.value, cache)
                rows = [[{"kind": k, "start": a, "end": b, "base": (k, a, b) in base} for k, a, b in spans] for base, spans in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*part.schema.names, out])

    element = StructType(
        [StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("base", BooleanType())]
    )
    return rest.mapInArrow(tidy(run), StructType([*rest.schema.fields, StructField(out, ArrayType(element))]))


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, field: Field, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind, and ``length`` recounted if there is such a column."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for part in slices(batch, text):
                rows = part.column(text).to_pylist()
                found = find_in([x or "" for x in rows], shared.value, cache)
                new = [x if x is None else masked(x, spans) for x, (_, spans) in zip(rows, found, strict=True)]
                yield part.set_column(part.schema.get_field_index(text), text, pa.array(new, pa.string()))

    out = df.mapInArrow(tidy(run), df.schema)
    if length in df.columns:
        kind = df.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text)).cast(kind))
    return out


def digest(df: DataFrame, field: Field) -> DataFrame:
    """Counts of base spans per kind, a digest of them, and all spans as text, for every document."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    kind = df.schema["doc_id"].dataType.simpleString()

    def joined(spans: list[Span]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for part in slices(batch, "text"):
                found = find_in([x or "" for x in part.column("text").to_pylist()], shared.value, cache)
                columns = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
                columns.append(pa.array([joined(spans) for _, spans in found], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
                )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return keyed_texts(df).mapInArrow(tidy(run), f"doc_id {kind}, {counts}, base_sha256 string, spans string")
