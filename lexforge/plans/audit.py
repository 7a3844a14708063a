"""Audits: digests, training twice, robustness probes, and dispatch of cells."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexforge.operators.emission import threshold
from lexforge.operators.tokenizers import Tokenizer
from lexforge.sources.artifacts import load_tokenizer
from lexforge.sources.sinks import get_text


def digest(own: Tokenizer) -> dict[str, str]:
    """SHA-256 of what has to be equal between runs: pieces as a set, their order, and merges or scores."""
    sha = lambda x: hashlib.sha256(json.dumps(x).encode()).hexdigest()
    learned = own.merges if own.kind == "bpe" else [[list(p), round(own.scores[p], 9)] for p in own.pieces if p in own.scores]
    return {"pieces": sha(sorted(map(list, own.pieces))), "order": sha([list(p) for p in own.pieces]), "learned": sha(learned)}


@dataclass(frozen=True)
class Determinism:
    """Two runs compared: BPE has to be identical, Unigram to have the same pieces."""

    identical: bool
    same_pieces: bool
    differing: int
    expected: bool = False

    @property
    def fatal(self) -> bool:
        return not self.same_pieces and not self.expected


def compare(first: Tokenizer, second: Tokenizer, expected: bool = False) -> Determinism:
    a, b = digest(first), digest(second)
    return Determinism(a == b, (a == b) if first.kind == "bpe" else a["pieces"] == b["pieces"], len(set(first.pieces) ^ set(second.pieces)), expected and first.kind == "unigram")


def train_twice(train: Callable[[], Tokenizer], expected: bool = False) -> Determinism:
    return compare(train(), train(), expected)


def traced(train: Callable[[], Tokenizer], own: Tokenizer) -> list[dict]:
    """A retrained tokenizer's merge log; an error if it isn't the same tokenizer."""
    again = train()
    if digest(again) != digest(own):
        raise ValueError("retraining gave another tokenizer")
    return again.log


def inert(base: DataFrame, probe: DataFrame, key: str = "piece") -> DataFrame:
    """Whether a knob changed the multi-glyph pieces: Jaccard, how many differ, inert."""
    both = base.where(F.size(key) >= 2).select(key).distinct().withColumn("a", F.lit(1)).join(probe.where(F.size(key) >= 2).select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    counted = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("n_union"))
    return counted.select(F.try_divide("shared", "n_union").alias("jaccard"), (F.col("n_union") - F.col("shared")).alias("differing"), (F.col("n_union") == F.col("shared")).alias("inert"))


def exhausted(own: Tokenizer, cap: int) -> dict:
    """Whether merges ran out before the cap."""
    return {"realized": len(own.pieces), "merges": len(own.merges), "cap": cap, "exhausted": len(own.pieces) < cap}


@dataclass
class Seams:
    """What a dispatch needs: how to tell that a cell is done, how to train it, and hooks after it."""

    done: Callable[[str], bool]
    train: Callable[[str], None]
    after: list[Callable[[str], None]] = field(default_factory=list)


def isolated(command: Callable[[str], list[str]]) -> Callable[[str], None]:
    """A way to train each cell in a process of its own: ``command`` gives its arguments; a failure is an error that names the cell."""

    def train(cell: str) -> None:
        ended = subprocess.run(command(cell), check=False)
        if ended.returncode:
            raise RuntimeError(f"{cell}: ended with {ended.returncode}")

    return train


def trained_from(spark: SparkSession, folder: str, corpus_sha: str) -> bool:
    """Whether a folder has a tokenizer that loads, with the pieces its record says, made from this corpus."""
    try:
        meta = json.loads(get_text(spark, f"{folder}/meta.json"))
        own = load_tokenizer(spark, folder)
    except (OSError, ValueError, KeyError):
        return False
    return meta.get("corpus_sha") == corpus_sha and meta.get("vocab_size") == len(own.pieces)


def confirm(ranked: DataFrame, by: list[str], deposits: DataFrame, *, p: float = 0.95, n_min: int = 100, force: bool = False) -> DataFrame:
    """Threshold records of the cells that have none yet (of all, if forced), beside the ones there are. Both have the columns of :func:`threshold`."""
    due = ranked if force else ranked.join(deposits.select(*by), by, "left_anti")
    made = threshold(due, by, p, n_min)
    return made if force else deposits.unionByName(made)


def dispatch(cells: Iterable[str], seams: Seams, *, force: bool = False, dry_run: bool = False, log: Callable[[str], None] = print) -> list[str]:
    """Cells in order; those done are skipped, unless forced. Returns what was (or would be) trained."""
    ran = []
    for cell in cells:
        if not force and seams.done(cell):
            log(f"{cell}: done")
            continue
        ran.append(cell)
        if dry_run:
            log(f"{cell}: would train")
            continue
        seams.train(cell)
        for hook in seams.after:
            hook(cell)
    return ran
