"""Tokenizer artifacts, scaffold logs, records and manifests as tables."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexforge.operators.tokenizers import Tokenizer
from lexforge.session import written
from lexforge.sources.sinks import get_text, put_text

VOCAB = "token_id int, glyphs array<string>, n_glyphs int, score double"
MERGES = "rank int, left int, right int, new_id int"
HEADER = ("format", "min_frequency", "vocab_size", "merge_brackets")
SCAFFOLD = "format string, min_frequency long, vocab_size long, merge_brackets boolean, base_alphabet array<array<string>>, step long, pair array<int>, new_id int, new_token string, candidate_freq long, standalone array<array<long>>"
# Fixed value: the tag that merge logs carry.
SCAFFOLD_FORMAT = "smirk-scaffold-log/v1"

_BPE = "model struct<vocab: map<string, int>, merges: array<array<int>>>"
_UNIGRAM = "model struct<type: string, vocab: array<struct<glyphs: array<string>, score: double>>>"


def _parsed(spark: SparkSession, text: str, schema: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string").select(F.from_json("text", schema)["model"].alias("model"))


def _spelt(named: list[tuple[str, ...]], operands: list[list[int]]) -> tuple[list[tuple[str, ...]], list[tuple]]:
    """All pieces by id, and the merges: a merge has the next id, or, where it makes a piece that is there already, that piece's, as in training."""
    known, pieces, merges = set(named), list(named), []
    for a, b in operands:
        merges.append((pieces[a], pieces[b]))
        if (both := pieces[a] + pieces[b]) not in known:
            known.add(both)
            pieces.append(both)
    return pieces, merges


def bpe_vocabulary(spark: SparkSession, text: str) -> DataFrame:
    """The pieces of a BPE artifact: base ids as they are listed, and after them an id for each merge that makes a new piece, with all glyphs that its operands come down to."""
    model = _parsed(spark, text, _BPE).first()["model"]
    named = [(s,) for s, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]
    pieces, _ = _spelt(named, model["merges"] or [])
    return spark.createDataFrame([(i, list(p), len(p), None) for i, p in enumerate(pieces)], "token_id int, glyphs array<string>, n_glyphs int, score double")


def unigram_vocabulary(spark: SparkSession, text: str) -> DataFrame:
    """The pieces of a Unigram artifact by their place in it, with their scores; another kind of artifact is an error."""
    model = _parsed(spark, text, _UNIGRAM)
    kind = model.select("model.type").first()[0]
    if kind != "Unigram":
        raise ValueError(f"the artifact is of type {kind}, not Unigram")
    rows = model.select(F.posexplode("model.vocab").alias("token_id", "entry"))
    return rows.select("token_id", "entry.glyphs", F.size("entry.glyphs").alias("n_glyphs"), "entry.score")


def save_tokenizer(spark: SparkSession, own: Tokenizer, folder: str, **meta) -> None:
    """``tokenizer.json`` and ``meta.json`` in a folder of any Hadoop file system."""
    if own.kind == "unigram":
        model = {"type": "Unigram", "vocab": [{"glyphs": list(p), "score": own.scores.get(p, 0.0)} for p in own.pieces]}
    else:
        made = {a + b for a, b in own.merges}
        base = [p for p in own.pieces if len(p) == 1 or p not in made]
        model = {"type": "BPE", "vocab": {"".join(p): i for i, p in enumerate(own.pieces) if p in set(base)}, "merges": [[own.ids[a], own.ids[b]] for a, b in own.merges]}
    put_text(spark, f"{folder}/tokenizer.json", json.dumps({"model": model, "merge_brackets": own.merge_brackets}))
    put_text(spark, f"{folder}/meta.json", json.dumps({"kind": own.kind, "vocab_size": len(own.pieces), "merges": len(own.merges)} | meta, sort_keys=True))


def load_tokenizer(spark: SparkSession, folder: str) -> Tokenizer:
    """What :func:`save_tokenizer` wrote, segmenting as before."""
    body = json.loads(get_text(spark, f"{folder}/tokenizer.json"))
    model = body["model"]
    if model["type"] == "Unigram":
        pieces = [tuple(v["glyphs"]) for v in model["vocab"]]
        return Tokenizer("unigram", pieces, scores={p: v["score"] for p, v in zip(pieces, model["vocab"]) if p != ("[UNK]",)}, merge_brackets=body["merge_brackets"])
    named = [(s,) for s, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]
    spelt, merges = _spelt(named, model["merges"])
    return Tokenizer("bpe", spelt, merges=merges, merge_brackets=body["merge_brackets"])


def scaffold_log(spark: SparkSession, path: str, tag: str = SCAFFOLD_FORMAT) -> tuple[dict, DataFrame]:
    """The header of a merge log, its base alphabet included, and its records; an empty log or another tag is an error."""
    rows = spark.read.schema(SCAFFOLD).json(path)
    head = rows.where(F.col("format").isNotNull()).first()
    if head is None or head["format"] != tag:
        raise ValueError(f"not a {tag} log: {None if head is None else head['format']}")
    named = {k: head[k] for k in HEADER} | {"base_alphabet": [(int(i), g) for i, g in head["base_alphabet"] or []]}
    return named, rows.where(F.col("format").isNull()).drop(*HEADER, "base_alphabet")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file of a folder; one that can't be parsed has its text in _corrupt_record and nulls."""
    return spark.read.schema(f"{schema}, _corrupt_record string").options(multiLine="true", mode="PERMISSIVE").json(path)


def record_or_none(path: str | Path) -> dict | None:
    """A small JSON record, or None if it is absent or broken."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


def _document(text: str) -> object:
    """YAML where a reader for it is installed; else JSON, which is YAML too."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def manifest(path: str | Path, spark: SparkSession | None = None) -> tuple[bytes, dict]:
    """A stage manifest: its bytes, to be hashed, and what they say. With a session the path is of any Hadoop file system."""
    data = Path(path).read_bytes() if spark is None else get_text(spark, str(path)).encode()
    return data, _document(data.decode())


def config(path: str | Path, kind: type, spark: SparkSession | None = None):
    """A configuration file as a dataclass; a name that it doesn't have is an error."""
    body = manifest(path, spark)[1] or {}
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(body) - names):
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    return kind(**body)


def complete(path: str | Path, schema: str = "raw_v1", keys: tuple[str, ...] = ("name", "n_rows", "shards"), spark: SparkSession | None = None) -> bool:
    """Whether a stage's manifest parses, has the schema and all keys."""
    try:
        found = manifest(path, spark)[1]
    except (OSError, ValueError):
        return False
    return isinstance(found, dict) and found.get("schema") == schema and all(k in found for k in keys)
