"""Canonical forms and rewrites of a column, by a plug-in: of molecules, or of any text."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexforge.functions.lexing import relabel_rings


class Canonicalizer(Protocol):
    """What a plug-in has to offer; each method maps a string to another, or to None."""

    def canonical(self, text: str) -> str | None: ...
    def kekulized(self, text: str) -> str | None: ...
    def explicit_hydrogens(self, text: str) -> str | None: ...
    def without_dative(self, text: str) -> str | None: ...
    def other_toolkit(self, text: str) -> str | None: ...
    def randomized(self, text: str, n: int, seed: int) -> list[str]: ...


class TextCanonicalizer:
    """Unicode NFC and single spaces; it has no chemical rewrites."""

    def canonical(self, text: str) -> str | None:
        return " ".join(unicodedata.normalize("NFC", text).split()) or None

    def _none(self, text: str) -> str | None:
        return None

    kekulized = explicit_hydrogens = without_dative = other_toolkit = _none

    def randomized(self, text: str, n: int, seed: int) -> list[str]:
        return []


def installed() -> Canonicalizer:
    """The plug-in for notations of molecules."""
    from lexforge.operators.forms import MoleculeForms  # which is made of the graphs above this layer

    return MoleculeForms()


def _udf(plug: Canonicalizer, method: str):
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: getattr(plug, method)(x) if x else None)

    return apply


def canonicalize(df: DataFrame, column: str, plug: Canonicalizer | None = None) -> tuple[DataFrame, "Observation"]:  # noqa: F821
    """``df`` with canonical forms, less the rows that have none; the observation counts n_input and n_rejected as the result is used."""
    from pyspark.sql import Observation

    seen = Observation()
    made = df.withColumn(column, _udf(plug or installed(), "canonical")(F.col(column)))
    counted = made.observe(seen, F.count(F.lit(1)).alias("n_input"), F.count_if(F.col(column).isNull()).alias("n_rejected"))
    return counted.where(F.col(column).isNotNull()), seen


def rewrite(text: Column, method: str, plug: Canonicalizer | None = None) -> Column:
    """One rewrite of a plug-in: canonical, kekulized, explicit_hydrogens, without_dative or other_toolkit."""
    return _udf(plug or installed(), method)(text)


#: The rewrites of :func:`orbit`.
AXES = ("canonical", "rings", "kekulized", "explicit_hydrogens", "other_toolkit", "random")


def orbit(df: DataFrame, id_col: str, column: str, *, k_random: int = 4, seed: int = 0, plug: Canonicalizer | None = None, axes: Sequence[str] = AXES) -> DataFrame:
    """(id, axis, text): each string in its canonical form and in all rewrites that it has, or only in those named."""
    plug = plug or installed()
    methods = [m for m in ("kekulized", "explicit_hydrogens", "other_toolkit") if m in axes]

    pair = "struct<axis: string, text: string>"

    @F.arrow_udf(f"array<{pair}>")
    def rewritten(texts: pa.Array) -> pa.Array:
        """All rewrites of a text, one after the other."""
        own = [[(m, getattr(plug, m)(x)) for m in methods] + [("random", r) for r in (plug.randomized(x, k_random, seed) if "random" in axes else [])] if x else [] for x in texts.to_pylist()]
        return pa.array([[{"axis": a, "text": t} for a, t in row] for row in own], pa.list_(pa.struct([("axis", pa.string()), ("text", pa.string())])))

    fixed = F.array(*[F.struct(F.lit(n).alias("axis"), c.alias("text")).cast(pair) for n, c in (("canonical", F.col(column)), ("rings", relabel_rings(F.col(column)))) if n in axes]).cast(f"array<{pair}>")
    drawn = rewritten(F.col(column))
    return df.select(F.col(id_col).alias("id"), F.explode(F.concat(fixed, drawn)).alias("v")).select("id", "v.axis", "v.text").where(F.col("text").isNotNull())
