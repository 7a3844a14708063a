"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document; each
kind of junk is seen by three or more of them, so that their agreement tells how
far each can be trusted. Expectation-maximisation over the counts of vote
patterns estimates how often each labeller votes what on good and on bad
documents, without any true label, and from that the posterior of each pattern:
one labeller's bad can be outvoted, and several doubts without a bad can be
enough. The posteriors label a sample, on which a linear scorer over hashed
features of the text, words among them, is trained; the scorer decides.

The pattern counts cover all documents and have at most ``4 ** len(LABELLERS)``
rows (75 on the test tables, as most votes go together). Only the scorer's sample is bounded: about ``SAMPLE`` documents, those
with the smallest hashes of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lexforge.llm.batches import small

#: Documents that the scorer is trained on, at most about; features of the scorer.
SAMPLE, FEATURES = 8000, 1024
#: Votes; a labeller is silent on texts too short for it, which says nothing, unlike an abstention.
GOOD, BAD, ABSTAIN, SILENT = 1, 0, 2, 3
#: The weight of words among the features; the rest has 1.
WORDS = 0.5
#: Characters at which the evidence of a text counts half; that of shorter ones counts less.
HALF = 48

#: Classes of bytes: 0 a-z, 1 A-Z, 2 digits, 3 space, 4 line end, 5 full stop, 6 comma and colons, 7 ! and ?, 8 quotes, brackets and hyphen, 9 other signs, 10 beyond ASCII, 11 control.
_CLASS = np.full(256, 11, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",;:", b"!?", b"'\"()[]-", b"#$%&*|~^_+=<>@/\\`{}", range(128, 256))):
    _CLASS[list(_bytes)] = _k
CLASSES = 12
#: Signs that rarely end a word.
_TAILS = frozenset(b"!?$%&*#|~^@<>+=")


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def measures(text: str | None) -> dict[str, float]:
    """What the labellers look at; all 0 for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    found = dict.fromkeys(("words", "signs", "upper", "shouts", "repeats", "lone", "letters", "length", "sentence", "top", "run", "tails", "echo", "pairs"), 0.0)
    if not words:
        return found
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    n = np.bincount(kinds, minlength=CLASSES).tolist()
    blank = (kinds == 3) | (kinds == 4) | (kinds == 11)
    solid = len(kinds) - int(blank.sum())
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    spoken = (kinds <= 2) | (kinds == 10)
    lone = int((np.add.reduceat(spoken.astype(np.int32), starts) == 0).sum()) if len(starts) else 0
    total = len(words)
    own = _hashed(words)
    same = own[1:] == own[:-1]
    echo = np.zeros(total, bool)
    for k in (1, 2, 3):
        echo[k:] |= own[k:] == own[:-k]
    parted = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    return {
        "words": float(total),
        "signs": n[9] / total,
        "upper": n[1] / max(1, n[0] + n[1]),
        "shouts": n[7] / total,
        "repeats": int(same.sum()) / total,
        "lone": lone / total,
        "letters": (n[0] + n[1] + n[10]) / max(1, solid),
        "length": solid / total,
        "sentence": total / max(1, n[5] + n[7]),
        "top": int(np.unique(own, return_counts=True)[1].max()) / total,
        "run": float(np.diff(parted).max()),
        "tails": sum(x[-1] in _TAILS and len(x) > 1 for x in words) / total,
        "echo": int(echo.sum()) / total,
        "pairs": 1 - len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / max(1, total - 1),
    }


def _by(name: str, bad_from: float, good_to: float, least_words: int = 1):
    """Bad at or above one value of a measure, good at or below another."""
    return lambda m: SILENT if m["words"] < least_words else BAD if m[name] >= bad_from else GOOD if m[name] <= good_to else ABSTAIN


#: Name and vote of each labeller.
LABELLERS = (
    ("signs", _by("signs", 0.3, 0.05)),
    ("upper", _by("upper", 0.4, 0.2, 3)),
    ("shouts", _by("shouts", 0.3, 0.05, 3)),
    ("repeats", _by("repeats", 0.3, 0.05, 5)),
    ("lone", _by("lone", 0.15, 0.02, 3)),
    ("letters", lambda m: SILENT if m["words"] < 3 else BAD if m["letters"] < 0.6 else GOOD if m["letters"] > 0.85 else ABSTAIN),
    ("length", lambda m: SILENT if m["words"] < 5 else BAD if not 2.5 <= m["length"] <= 14 else GOOD if 3 <= m["length"] <= 9 else ABSTAIN),
    ("sentence", _by("sentence", 80, 40, 20)),
    ("top", _by("top", 0.35, 0.15, 10)),
    ("run", _by("run", 4, 2, 5)),
    ("tails", _by("tails", 0.2, 0.05, 3)),
    ("echo", _by("echo", 0.35, 0.15, 5)),
    ("pairs", _by("pairs", 0.6, 0.4, 10)),
)


def votes(text: str | None) -> tuple[int, ...]:
    found = measures(text)
    return tuple(vote(found) for _, vote in LABELLERS)


def pattern(cast: tuple[int, ...]) -> int:
    """The votes as one number in base 4."""
    return sum(v * 4**k for k, v in enumerate(cast))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """The share of good documents, and for each labeller the rates (class, vote), by expectation-maximisation.

    patterns: (n, labellers) of votes. The start doubts
    what any labeller calls bad; a small pseudo-count keeps rates away from 0 and 1.
    """
    n, m = patterns.shape
    good = np.where((patterns == BAD).any(1), 0.2, 0.9)
    prior, rates = 0.5, np.zeros((m, 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        for k in range(m):
            for v in range(3):
                rates[k, :, v] = weight[:, patterns[:, k] == v].sum(1) + 0.1
        rates /= rates.sum(2, keepdims=True)
        new = posterior(patterns, prior, rates)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return prior, rates


def posterior(patterns: np.ndarray, prior: float, rates: np.ndarray) -> np.ndarray:
    """The probability that each pattern's document is good."""
    told = np.concatenate([rates, np.ones((len(rates), 2, 1))], 2)
    log = np.log([[1 - prior], [prior]]) + sum(np.log(told[k][:, patterns[:, k]]) for k in range(patterns.shape[1]))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def accuracies(prior: float, rates: np.ndarray) -> dict[str, float]:
    """How often each labeller is right when it votes."""
    right = (1 - prior) * rates[:, 0, BAD] + prior * rates[:, 1, GOOD]
    wrong = (1 - prior) * rates[:, 0, GOOD] + prior * rates[:, 1, BAD]
    return {name: float(r / (r + w)) for (name, _), r, w in zip(LABELLERS, right, wrong)}


_BUCKET = ((np.arange(CLASSES**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Hashed features: triples of byte classes, pairs of neighbouring words by whether they are equal, and words by their hashes. Their length is below 1, and shorter for short texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = _CLASS[np.frombuffer(data, np.uint8)].astype(np.int64)
    out = np.zeros(FEATURES)
    if len(kinds) >= 3:
        triples = np.bincount(kinds[:-2] * (CLASSES * CLASSES) + kinds[1:-1] * CLASSES + kinds[2:], minlength=CLASSES**3)
        out += np.sqrt(np.bincount(_BUCKET, triples / (len(kinds) - 2), FEATURES))
    words = data.split()
    if words:
        own = _hashed(words)
        out += WORDS * np.sqrt(np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=FEATURES) / len(words))
    if len(words) > 1:
        same = int((own[1:] == own[:-1]).sum()) / (len(words) - 1)
        out[[1, 2]] += 2 * np.sqrt((same, 1 - same))
    size = np.sqrt((out**2).sum())
    return out / size * (len(kinds) / (len(kinds) + HALF)) if size else out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6, rounds: int = 25, rows: int = 512) -> np.ndarray:
    """Weights and bias of a logistic regression on soft labels, by Newton's method. x can be of single precision; it is read in blocks of ``rows``."""
    n, size = x.shape
    w, penalty = np.zeros(size + 1), np.full(size + 1, ridge * max(1, n))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        slope, curve = penalty * w, np.diag(penalty)
        for at in range(0, n, rows):
            own = np.hstack([x[at : at + rows].astype(np.float64), np.ones((len(x[at : at + rows]), 1))])
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            slope += own.T @ (p - y[at : at + rows])
            curve += (own * (p * (1 - p) + 1e-9)[:, None]).T @ own
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def label_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, np.ndarray, int]:
    """(share of good documents, rates, number of documents) from the votes on all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, n = np.unique(np.array([pattern(votes(x)) for x in batch.column(0).to_pylist()], np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["pattern", "n"])

    counted = _texts(docs, id_col, text_col).select("text").mapInArrow(run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    codes, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.float64)
    prior, rates = estimate(np.stack([codes // 4**k % 4 for k in range(len(LABELLERS))], 1), counts)
    return prior, rates, int(counts.sum())


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights, or an empty array for an empty table."""
    prior, rates, n = label_model(docs, id_col=id_col, text_col=text_col)
    if not n:
        return np.empty(0)
    share = F.shiftrightunsigned(F.xxhash64(id_col), 1) / F.lit(float(1 << 63))
    chosen = _texts(docs.where(share < min(1.0, sample / n)) if n > sample else docs, id_col, text_col).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(x)) for x in texts], pa.int32()), pa.array([features(x).astype(np.float32).tobytes() for x in texts], pa.binary())], ["pattern", "features"])

    rows = sorted((r[0], bytes(r[1])) for r in chosen.mapInArrow(run, "pattern int, features binary").collect())
    if not rows:
        return np.empty(0)
    codes = np.array([r[0] for r in rows])
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), FEATURES)
    del rows
    return fit(x, posterior(np.stack([codes // 4**k % 4 for k in range(len(LABELLERS))], 1), prior, rates))


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability that a document is good; 0 for a text without words."""
    return _scored(_texts(docs, id_col, text_col), weights, lambda batch: batch.column("text")).select("doc_id", "score")


def _scored(rows: DataFrame, weights: np.ndarray, text_of) -> DataFrame:
    """``rows`` with the score; text_of(batch) gives the texts."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [0.0 if not x or not x.strip() or not len(weights) else float(1 / (1 + np.exp(-np.clip(features(x) @ weights[:-1] + weights[-1], -500, 500)))) for x in text_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.float64())], [*names, "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_accepted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """``docs`` less the rows that :func:`classify` rejects, with all columns and in no set order; what it says of nulls, long texts and repeats holds here. The text has to be a string."""
    weights = train(docs, id_col=id_col, text_col=text_col, sample=sample)
    rows, at = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")), docs.columns.index(text_col)
    return _scored(rows, weights, lambda batch: batch.column("row").field(at)).where(F.col("score") >= least).select("row.*")


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """For each row: doc_id, score and accepted (score at least ``least``).

    A null text, or one without words, has score 0. Repeated rows score alike;
    a score of exactly ``least`` is accepted. Texts of any length are read whole.
    An empty table gives an empty result; other columns aren't read.
    """
    weights = train(docs, id_col=id_col, text_col=text_col, sample=sample)
    return score(docs, weights, id_col=id_col, text_col=text_col).withColumn("accepted", F.col("score") >= least)
