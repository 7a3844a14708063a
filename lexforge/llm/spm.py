"""SentencePiece encoding and decoding, with giant documents cut into chunks.

Two kinds of model are told apart. A *unigram* model's best segmentation is the
best path of a lattice, and a giant document is encoded by a max-plus scan over
its chunks (see ``maxplus``). A *BPE* model's is not: it is made by merges in
order of rank, and the best path over its scores gives other pieces (figures in
the README). For BPE a giant document is cut where no piece can cross, before a
word; that the vocabulary allows it is checked when the model is loaded. Either
way documents up to ``GIANT`` characters are encoded whole by the library.

The model's path is a parameter; the file is sent to the tasks as bytes, a few
MB whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T
from sentencepiece import sentencepiece_model_pb2

from lexforge.llm import maxplus
from lexforge.llm.batches import small
from lexforge.session import written

#: Characters beyond which a document is cut, and characters of a chunk, about.
GIANT, CHUNK = 1 << 16, 1 << 15
SPACE = "▁"
_UNIGRAM, _BPE = 1, 2
#: What the library adds to the smallest score for an unknown character.
UNKNOWN_PENALTY = -10.0

_LOADED: dict[bytes, sentencepiece.SentencePieceProcessor] = {}


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """A processor; made once a worker."""
    if model not in _LOADED:
        _LOADED[model] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _LOADED[model]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def kind(model: bytes) -> str:
    """'unigram' or 'bpe'; other kinds are an error."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    if proto.trainer_spec.model_type == _UNIGRAM:
        return "unigram"
    if proto.trainer_spec.model_type == _BPE:
        return "bpe"
    raise ValueError("neither a unigram nor a BPE model")


def can_cut(model: bytes) -> bool:
    """Whether a text can be cut before a word: no piece goes on after a space that follows something else, and the dummy prefix stands for the space."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    n = proto.normalizer_spec
    return n.add_dummy_prefix and not n.remove_extra_whitespaces and not n.precompiled_charsmap and all(SPACE not in p.piece.lstrip(SPACE) for p in proto.pieces)


def cut(text: str, size: int) -> list[str]:
    """Parts of about ``size`` characters; a single space between each two parts is left out. A part goes on until there is such a space."""
    parts, at = [], 0
    while len(text) - at > size:
        k = text.find(" ", at + size)
        while 0 < k < len(text) - 1 and (text[k - 1] in " ▁" or text[k + 1] in " ▁"):
            k = text.find(" ", k + 1)
        if k < 0 or k >= len(text) - 1:
            break
        parts.append(text[at:k])
        at = k + 1
    return [*parts, text[at:]]


def lattice(model: bytes) -> maxplus.Lattice:
    """The lattice of a unigram model."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    normal, user, unknown = (sentencepiece_model_pb2.ModelProto.SentencePiece.Type.Value(x) for x in ("NORMAL", "USER_DEFINED", "UNKNOWN"))
    scores = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == normal}
    low, high = min((s for _, s in scores.values()), default=0.0), max((s for _, s in scores.values()), default=0.0)
    scores |= {p.piece: (i, len(p.piece) * high - 0.1) for i, p in enumerate(proto.pieces) if p.type == user}
    return maxplus.Lattice(scores, low + UNKNOWN_PENALTY, next((i for i, p in enumerate(proto.pieces) if p.type == unknown), 0))


def _finished(ids: list[int], text: str, lengths: dict[int, int], model: bytes) -> list[int]:
    """With unknown characters as the library has them: bytes if the model has them, else one id a run."""
    processor = load(model)
    unknown = processor.unk_id()
    if unknown not in ids:
        return ids
    as_bytes = processor.piece_to_id("<0x00>") != unknown
    out: list[int] = []
    at = 0
    for i in ids:
        if i == unknown:
            if as_bytes:
                out += [processor.piece_to_id(f"<0x{b:02X}>") for b in text[at].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != unknown:
                out.append(unknown)
            at += 1
        else:
            out.append(i)
            at += lengths[i]
    return out


def _whole(rows: DataFrame, model: bytes) -> DataFrame:
    """(..., text) to (..., ids): the library encodes each text."""
    names = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        for batch in small(batches):  # a few lists of ids at once
            found = processor.encode([x or "" for x in batch.column("text").to_pylist()], num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], ids], [*names, "ids"])

    return rows.mapInArrow(run, schema)


def _cut_rows(giants: DataFrame) -> DataFrame:
    """(row, text) to (row, part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                parts = cut(text, CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], ["row", "part", "text"])

    return giants.mapInArrow(run, "row long, part long, text string")


def _scan(giants: DataFrame, model: bytes) -> DataFrame:
    """(row, text) to (row, part, ids), by a max-plus scan over the chunks of the normalised texts."""
    spark = giants.sparkSession

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, processor = lattice(model), load(model)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                text = processor.normalize(text)
                at = list(range(0, len(text), CHUNK)) or [0]
                sizes = [min(CHUNK, len(text) - k) for k in at]
                columns = [[row] * len(at), range(len(at)), [text[k : k + CHUNK + own.longest] for k in at], sizes, [k == at[-1] for k in at]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()])], ["row", "part", "text", "size", "last"])

    parts = written(giants.mapInArrow(chunks, "row long, part long, text string, size long, last boolean"), "chunks")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            found = [own.transfer(t, n, last).tobytes() for t, n, last in zip(*(batch.column(c).to_pylist() for c in ("text", "size", "last")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), pa.array(found, pa.binary())], ["row", "part", "matrix"])

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        n = lattice(model).longest
        found = maxplus.boundary_states([np.frombuffer(x, np.float64).reshape(n, n) for x in table.column("matrix").to_pylist()])
        return pa.table([table.column("row"), table.column("part"), pa.array(found[:-1], pa.int64()), pa.array(found[1:], pa.int64())], ["r", "p", "entry", "leave"])

    matrices = parts.repartition(tasks, "row", "part").mapInArrow(transfer, "row long, part long, matrix binary")
    between = matrices.groupBy("row").applyInArrow(states, "r long, p long, entry long, leave long")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        lengths = {i: len(p) for p, (i, _) in own.scores.items()}
        for batch in batches:
            found = [_finished(own.trace(t, n, a, b), t[a:], lengths, model) for t, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "size", "entry", "leave")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), pa.array(found, pa.list_(pa.int32()))], ["row", "part", "ids"])

    traced = parts.join(between, (F.col("row") == F.col("r")) & (F.col("part") == F.col("p"))).select("row", "part", "text", "size", "entry", "leave")
    return traced.mapInArrow(trace, "row long, part long, ids array<int>")


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), giant: int = GIANT) -> DataFrame:
    """(doc_id, the columns named in ``keep``, ids) for each row, equal to the library's for the whole text.

    A null text has no ids, as has an empty one. Repeated rows are encoded
    alike. Texts over ``giant`` characters are cut, encoded by several tasks and
    put together again; they are whole again only in their result's row. An
    empty table gives an empty result; other columns aren't read.
    """
    model = model_bytes(model_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep], F.col(text_col).cast("string").alias("text"))
    of_kind = kind(model)
    if of_kind == "bpe" and not can_cut(model):
        return _whole(rows, model)
    small = _whole(rows.where(F.coalesce(F.length("text"), F.lit(0)) <= giant), model)
    giants = written(rows.where(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id()), "giants")
    if giants.isEmpty():
        return small
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = giants.select("row", "text")
    parts = _whole(_cut_rows(texts).repartition(tasks, "row", "part"), model) if of_kind == "bpe" else _scan(texts, model)
    joined = parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    if of_kind == "unigram":  # a run of unknown characters is one id, across chunks too
        unknown = load(model).unk_id()
        joined = joined.withColumn("ids", F.filter("ids", lambda x, i: (x != unknown) | (F.coalesce(F.get("ids", i - 1), F.lit(-1)) != unknown)))
    return small.union(giants.drop("text").join(joined, "row").select("doc_id", *keep, "ids"))


def piece_bytes(model: bytes) -> list[bytes | None]:
    """What each id stands for; None for those that only the library decodes."""
    names = sentencepiece_model_pb2.ModelProto.SentencePiece.Type
    plain, byte = {names.Value("NORMAL"), names.Value("USER_DEFINED")}, names.Value("BYTE")
    pieces = sentencepiece_model_pb2.ModelProto.FromString(model).pieces
    return [bytes([int(p.piece[3:5], 16)]) if p.type == byte else p.piece.replace(SPACE, " ").encode() if p.type in plain else None for p in pieces]


def decoded(ids: list[int], table: list[bytes | None], dummy: bool, model: bytes) -> str:
    """The text of some ids: their bytes in a row, less the dummy prefix; the library decodes what has other ids or isn't UTF-8."""
    try:
        text = b"".join([table[i] for i in ids]).decode()
    except (TypeError, UnicodeDecodeError):
        return load(model).decode(ids)
    return text[1:] if dummy and text[:1] == " " else text


def decode(encoded: DataFrame, model_path: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids) to (doc_id, the columns named in ``keep``, text); null ids give a null text, no ids an empty one, no rows none. Repeated rows are decoded alike, ids of any number whole."""
    model = model_bytes(model_path)
    names = ["doc_id", *keep]
    schema = T.StructType([*[encoded.schema[c] for c in names], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_bytes(model)
        dummy = sentencepiece_model_pb2.ModelProto.FromString(model).normalizer_spec.add_dummy_prefix
        for batch in small(batches):
            found = [None if x is None else decoded(x.tolist(), table, dummy, model) for x in batch.column("ids").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.string())], [*names, "text"])

    return encoded.select(*names, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids joined by one space) and decoded_sha256 (of the text decoded from them), for each row.

    A null or empty text has no ids, and its decoded text is empty. Texts of any length
    are encoded whole, repeated rows alike; a null id stays null. An empty table
    gives no rows, and other columns, whatever their names, aren't read.
    """
    encoded = encode(docs, model_path, id_col=id_col, text_col=text_col)
    digest = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))
    return decode(digest, model_path, keep=("n_ids", "ids_sha256")).select("doc_id", "n_ids", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
