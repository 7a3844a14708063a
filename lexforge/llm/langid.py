"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent n-grams of letters, by
rank. A document gets the language from whose profile its own list is least out
of place: the distance sums, over the document's n-grams, how many ranks apart
the two lists have it, with the list's length for an n-gram that the profile
lacks.

n-grams run over lower-case letters with one space between words and at both
ends. An n-gram of up to three code points is one 64-bit integer, so a document
costs a few sorts of integer arrays, whatever the script.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexforge.llm.batches import small

#: n-grams in a profile, and of a document's list.
PROFILE = 400
#: Documents a language that profiles are learned from, about: those with the smallest hashes of their ids.
SAMPLE = 4000
UNDETERMINED = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once a worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of a text as integers, ascending, and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points[~is_letter] = 32
    # one space between words, and at both ends
    points = np.concatenate(([32], points, [32]))
    keep = np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))
    points = points[keep]
    pairs = (points[:-1] << 21) | points[1:]
    triples = (points[:-2] << 42) | pairs[1:]
    return np.unique(np.concatenate((points[points != 32], pairs, triples)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent, most frequent first, ties by code."""
    if len(codes) > most:
        # what is below the count at the limit can't be in; fewer rows to sort
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:most]


def _checksum(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A profile for each language: its ``size`` most frequent n-grams.

    Learned from about ``sample`` whole documents a language, those with the
    smallest hashes of their ids; rows with a null language or text are left
    out. Only the profiles reach the driver: ``size`` integers a language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), (F.shiftrightunsigned(F.xxhash64(id_col), 1) / F.lit(float(1 << 63))).alias("at"))
    n = known.groupBy(F.col("lang").alias("own")).count()
    chosen = known.join(F.broadcast(n) if n.count() < 10_000 else n, F.col("lang") == F.col("own")).where(F.col("at") * F.col("count") < sample).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                found = [ngrams(x) for x in own["text"]]
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": np.bincount(at, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)})

    sums = chosen.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    rows = sums.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").select("lang", "code").collect()
    found: dict[str, list[int]] = {}
    for lang, code in rows:
        found.setdefault(lang, []).append(code)
    return {lang: np.array(codes, np.int64) for lang, codes in found.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """For each row: doc_id, lang_pred and score.

    The score is 1 less the mean distance of an n-gram, as a share of the
    largest. Ties go to the smaller name. A text that is null, or has no letter,
    is ``und`` with score 0, as is every text if there are no profiles.
    """
    langs = sorted(profiles)
    codes = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.empty(0, np.int64)
    places = np.full((len(langs), len(codes) + 1), size, np.int32)  # the last column: an n-gram of no profile
    for k, lang in enumerate(langs):
        places[k, np.searchsorted(codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def best(text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text), size)
        if not len(own) or not langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(codes, own)
        at[codes[np.minimum(at, len(codes) - 1)] != own] = len(codes)
        known = places[:, at]
        away = np.where(known < size, np.abs(known - np.arange(len(own), dtype=np.int32)), size).sum(1)
        k = int(np.argmin(away))
        return langs[k], float(1 - away[k] / (size * len(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [best(x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, sample: int = SAMPLE) -> DataFrame:
    """Learns from the four fifths of ``docs`` whose id's crc32 isn't divisible by 5 and predicts for all: doc_id, held_out, lang_pred, score.

    A null id counts as an empty text, and so is held out. Repeated rows are
    predicted alike; texts of any length are read whole, and of two languages that
    are equally near the smaller name wins. With an empty table the result is
    empty. Other columns, whatever their names, aren't read.
    """
    profiles = learn(docs.where(_checksum(id_col) != 0), id_col=id_col, text_col=text_col, lang_col=lang_col, size=size, sample=sample)
    found = predict(docs, profiles, id_col=id_col, text_col=text_col, size=size)
    return found.select("doc_id", (_checksum("doc_id") == 0).alias("held_out"), "lang_pred", "score")
