"""Tokenizers over glyphs: training from a weighted chunk table, and segmentation with spans.

Training looks at distinct chunks with their counts, one aggregation over the
corpus, so the driver's loop runs over the vocabulary of chunks and not over
the texts. Segmentation is memoised by chunk: tokens never cross a chunk.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexforge.functions.batches import parts as few
from lexforge.functions.lexing import GLYPHS, SPECIALS, chunk_glyphs, chunks, glyphs
from lexforge.session import forget, written

Piece = tuple[str, ...]
UNKNOWN = ("?",)
_HALF = 32
#: Chunks that a driver's training loop takes; a larger table is trained where it is.
MOST_CHUNKS = 1_000_000
#: Glyphs of the chunks whose pieces a task remembers: chunks of a text can be long, and seldom come again.
KNOWN = 1 << 19
#: Glyphs of two letters outside brackets; they have numbers beyond those of characters.
_DOUBLE, _BEYOND = [(ord("C"), ord("l")), (ord("B"), ord("r"))], 0x110000


def _number(glyph: str) -> int | None:
    """The number of a glyph outside brackets: its code point, or one beyond."""
    if len(glyph) == 1:
        return ord(glyph)
    return next((_BEYOND + k for k, (a, b) in enumerate(_DOUBLE) if glyph == chr(a) + chr(b)), None)


def runs(parts: Piece, merge_brackets: bool) -> list[Piece]:
    """What may merge among itself: a whole bracketed group, or only what is inside it."""
    if merge_brackets or not parts or parts[0] != "[" or parts[-1] != "]":
        return [parts]
    return [("[",), parts[1:-1], ("]",)] if len(parts) > 2 else [("[",), ("]",)]


@dataclass
class Tokenizer:
    """A trained tokenizer: ``bpe`` with merges by rank, or ``unigram`` with scores."""

    kind: str
    pieces: list[Piece]
    merges: list[tuple[Piece, Piece]] = field(default_factory=list)
    scores: dict[Piece, float] = field(default_factory=dict)
    merge_brackets: bool = False
    log: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rank = {pair: i for i, pair in enumerate(self.merges)}
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.scores), default=1)
        self.worst = min(self.scores.values(), default=0.0)
        self._known: dict[Piece, list[Piece]] = {}
        self._room = KNOWN
        self._pairs = self._sides = self._singles = None  # made where texts are encoded
        self._inside = {pair for p in ([a + b for a, b in self.merges] if self.kind == "bpe" else self.scores) for pair in zip(p, p[1:])}

    def together(self, codes: np.ndarray) -> np.ndarray:
        """Of glyphs outside brackets, by number, which stand beside the next one in some piece."""
        if self._pairs is None:
            told = [(x, y) for a, b in self._inside if (x := _number(a)) is not None and (y := _number(b)) is not None]
            self._pairs = np.array(sorted(x << _HALF | y for x, y in told), np.int64)
            self._sides = np.zeros((2, _BEYOND + len(_DOUBLE)), bool)
            for side, own in enumerate(zip(*told)):
                self._sides[side, list(own)] = True
        found = self._sides[0, codes[:-1]] & self._sides[1, codes[1:]]
        at = np.flatnonzero(found)
        pair = codes[at].astype(np.int64) << _HALF | codes[at + 1]
        place = np.searchsorted(self._pairs, pair)
        found[at] = self._pairs[np.minimum(place, len(self._pairs) - 1)] == pair if len(self._pairs) else False
        return found

    def single(self, codes: np.ndarray) -> np.ndarray:
        """Ids of glyphs outside brackets, by number; -1 for those that aren't pieces."""
        if self._singles is None:
            self._singles = np.full(_BEYOND + len(_DOUBLE), -1, np.int32)
            for piece, i in self.ids.items():
                if len(piece) == 1 and (k := _number(piece[0])) is not None:
                    self._singles[k] = i
        return self._singles[codes].astype(np.int64)

    def segment(self, parts: Piece) -> list[Piece]:
        """The pieces of a chunk's glyphs."""
        found: list[Piece] = []
        for run in runs(parts, self.merge_brackets):
            for part in self.parted(run):
                found += self._segment(part)
        return found

    def parted(self, run: Piece) -> list[Piece]:
        """A run's parts: cut where two neighbours stand side by side in no piece."""
        cuts = [0, *[i for i, pair in enumerate(zip(run, run[1:]), 1) if pair not in self._inside], len(run)]
        return [run[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]

    def _segment(self, run: Piece) -> list[Piece]:
        """The pieces of a part of a run, which comes again more often than a chunk."""
        if len(run) == 1:
            return [run]
        found = self._known.get(run)
        if found is None:
            self._room -= len(run)
            if self._room < 0:
                self._known.clear()
                self._room = KNOWN - len(run)
            found = self._known[run] = self._merged(run) if self.kind == "bpe" else self._best(run)
        return found

    def _merged(self, run: Piece) -> list[Piece]:
        """Merges by rank, then by place, until none applies."""
        own: list[Piece | None] = [(g,) for g in run]
        after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
        waiting = [(self.rank[pair], i) for i, pair in enumerate(zip(own, own[1:])) if pair in self.rank]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i] if own[i] is not None else len(own)
            if j >= len(own) or (own[i], own[j]) != self.merges[rank]:
                continue
            own[i], own[j] = own[i] + own[j], None
            after[i] = after[j]
            if after[i] < len(own):
                before[after[i]] = i
                if (pair := (own[i], own[after[i]])) in self.rank:
                    heapq.heappush(waiting, (self.rank[pair], i))
            if before[i] >= 0 and (pair := (own[before[i]], own[i])) in self.rank:
                heapq.heappush(waiting, (self.rank[pair], before[i]))
        return [p for p in own if p is not None]

    def _best(self, run: Piece) -> list[Piece]:
        """The largest sum of scores; of equal sums the earliest start. An unknown glyph costs the smallest score."""
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - self.longest), end):
                score = self.scores.get(run[start:end], self.worst if end - start == 1 else -math.inf)
                if best[start] + score > best[end]:
                    best[end], back[end] = best[start] + score, start
        found, end = [], len(run)
        while end:
            found.append(run[back[end] : end])
            end = back[end]
        return found[::-1]

    def decode(self, ids: list[int], skip_specials: bool = True) -> str:
        """The glyphs of some ids, joined, without spaces."""
        own = [self.pieces[i] for i in ids]
        return "".join("".join(p) for p in own if not (skip_specials and "".join(p) in SPECIALS)).replace(" ", "")

    def vocabulary(self, spark) -> DataFrame:
        """(token_id, piece, n_glyphs, score)."""
        return spark.createDataFrame([(i, list(p), len(p), self.scores.get(p)) for i, p in enumerate(self.pieces)], "token_id int, piece array<string>, n_glyphs int, score double")

    def merge_table(self, spark) -> DataFrame:
        """(rank, left, right, new_id)."""
        return spark.createDataFrame([(k, self.ids[a], self.ids[b], self.ids[a + b]) for k, (a, b) in enumerate(self.merges)], "rank int, left int, right int, new_id int")


def atomic(alphabet: frozenset[str] = GLYPHS) -> Tokenizer:
    """No merges: the unknown token and the alphabet."""
    return Tokenizer("bpe", [("[UNK]",), *[(g,) for g in sorted(alphabet)]])


def chunk_table(df: DataFrame, text_col: str) -> DataFrame:
    """(glyphs, n) of distinct chunks, from one aggregation."""
    counted = df.select(F.explode(chunks(F.col(text_col))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(glyphs(F.col("chunk")).alias("glyphs"), "n")


def _collected(table: DataFrame) -> list[tuple[Piece, int]] | None:
    """The chunks of a written table in order, or None if there are more than ``MOST_CHUNKS``, which are counted where they are."""
    return sorted((tuple(r["glyphs"]), r["n"]) for r in table.collect()) if table.count() <= MOST_CHUNKS else None


def train_bpe(table: DataFrame, size: int, *, min_frequency: int = 2, merge_brackets: bool = False, alphabet: frozenset[str] | None = None, start: Tokenizer | None = None) -> Tokenizer:
    """Merges the most frequent neighbours until there are ``size`` pieces or none is frequent enough.

    Ties go to the smaller pair of pieces by id. The log has, for each merge,
    its step, pair, new id, the pair's count, and by how much the counts of
    standing pieces changed. ``start`` continues another tokenizer's merges.
    More than ``MOST_CHUNKS`` distinct chunks stay distributed, with the same result.
    """
    table = written(table, "chunks")  # made once, however often it is read
    rows = _collected(table)
    if rows is None:
        from lexforge.operators import bpe  # which is made of tokenizers

        own = bpe.train_bpe(table, size, min_frequency=min_frequency, merge_brackets=merge_brackets, alphabet=alphabet, start=start)
        forget(table)
        return own
    forget(table)
    base = sorted({g for parts, _ in rows for g in parts} | set(alphabet or ()))
    pieces: list[Piece] = list(start.pieces) if start else [("[UNK]",), *[(g,) for g in base]]
    ids = {p: i for i, p in enumerate(pieces)}
    merges = list(start.merges) if start else []
    words: list[list[int]] = []
    weight: list[int] = []
    for parts, n in rows:
        for run in runs(parts, merge_brackets):
            if len(run) > 1:
                words.append([ids[p] for p in (start.segment(run) if start else [(g,) for g in run])])
                weight.append(n)
    pairs: defaultdict[int, int] = defaultdict(int)  # a pair of ids is one integer, whose order is that of the pair
    where: defaultdict[int, list[int]] = defaultdict(list)
    for k, word in enumerate(words):
        n = weight[k]
        for x, y in zip(word, word[1:]):
            pairs[x << _HALF | y] += n
            where[x << _HALF | y].append(k)
    waiting = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(waiting)
    log: list[dict] = []
    while len(pieces) < size and waiting:
        n, pair = heapq.heappop(waiting)
        if pairs.get(pair, 0) != -n:
            continue  # its count has changed since
        if -n < max(1, min_frequency):
            break
        a, b = pair >> _HALF, pair & (1 << _HALF) - 1
        new = ids.setdefault(pieces[a] + pieces[b], len(pieces))
        if new == len(pieces):
            pieces.append(pieces[a] + pieces[b])
        merges.append((pieces[a], pieces[b]))
        changed, gained = set(), 0
        for k in set(where.pop(pair)):
            word, own, at, merged = words[k], weight[k], 0, []
            while at < len(word):
                if word[at] == a and at + 1 < len(word) and word[at + 1] == b:
                    for there, left in ((merged[-1] if merged else None, True), (word[at + 2] if at + 2 < len(word) else None, False)):
                        if there is not None:
                            old, made = (there << _HALF | a, there << _HALF | new) if left else (b << _HALF | there, new << _HALF | there)
                            pairs[old] -= own
                            pairs[made] += own
                            where[made].append(k)
                            changed.update((old, made))
                    merged.append(new)
                    gained += own
                    at += 2
                else:
                    merged.append(word[at])
                    at += 1
            words[k] = merged
        pairs.pop(pair, None)
        for p in changed:
            if pairs.get(p, 0) > 0:
                heapq.heappush(waiting, (-pairs[p], p))
        standing: Counter = Counter()
        for i, d in ((new, gained), (a, -gained), (b, -gained)):
            standing[i] += d
        log.append({"step": len(merges), "pair": [a, b], "new_id": new, "new_token": "".join(pieces[new]), "candidate_freq": -n, "standalone": [[i, d] for i, d in sorted(standing.items()) if d]})
    return Tokenizer("bpe", pieces, merges=merges, merge_brackets=merge_brackets, log=log)


def forward_backward(run: Piece, scores: dict[Piece, float], longest: int) -> tuple[float, dict[Piece, float]]:
    """The log of the sum over all segmentations, and each piece's expected count."""
    n = len(run)
    edges = [(i, j, s) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if (s := scores.get(run[i:j])) is not None]
    forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, s in edges:
        if forward[i] > -math.inf:
            forward[j] = _log_sum(forward[j], forward[i] + s)
    for i, j, s in reversed(edges):
        if backward[j] > -math.inf:
            backward[i] = _log_sum(backward[i], backward[j] + s)
    found: dict[Piece, float] = defaultdict(float)
    if forward[n] > -math.inf:
        for i, j, s in edges:
            if (p := forward[i] + s + backward[j] - forward[n]) > -700:
                found[run[i:j]] += math.exp(p)
    return forward[n], found


def _log_sum(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def train_unigram(table: DataFrame, size: int, *, max_piece_length: int = 16, seed_size: int = 1_000_000, sub_iterations: int = 2, shrink: float = 0.75, merge_brackets: bool = False, tasks: int = 16) -> Tokenizer:
    """A Unigram model by EM and pruning.

    Seeds: single glyphs, and the substrings with the largest count times
    length. Each round runs EM (the E-step over chunks by Spark; a piece with an
    expected count under 0.5 goes) and keeps the best share, until there are
    ``size`` pieces. Single glyphs stay. The chunk table stays where it
    is, in ``tasks`` parts; lattices are made once, with pieces as numbers. The driver
    has the pieces' glyphs and their sums as arrays, ``seed_size`` and the single
    glyphs at most. Sums are of whole units, so reruns agree on clusters of any size.
    """
    spark = table.sparkSession
    own = F.col("glyphs")
    grouped = (F.get(own, F.lit(0)) == "[") & (F.element_at(own, -1) == "]")
    split = F.when(F.lit(not merge_brackets) & (F.size(own) > 1) & grouped, F.array(F.array(F.lit("[")), F.slice(own, F.lit(2), F.size(own) - 2), F.array(F.lit("]")))).otherwise(F.array(own))
    work = table.select(F.explode(split).alias("run"), "n").where(F.size("run") > 0).groupBy("run").agg(F.sum("n").alias("n")).repartition(tasks, "run").persist()
    from lexforge.operators import lattice, seeds  # which are made of tokenizers

    found = seeds.chosen(work, most=max_piece_length, size=seed_size).toArrow()
    if not found.num_rows:
        work.unpersist()
        return Tokenizer("unigram", [("[UNK]",)], merge_brackets=merge_brackets)
    column = found.column("piece").combine_chunks()
    names = sorted(column.flatten().unique().to_pylist())
    ids = {g: i for i, g in enumerate(names, 1)}
    rows = lattice.rows_of(column, ids, max_piece_length)
    order = np.lexsort(rows.T[::-1])  # a piece's number is its place among all in order
    rows = rows[order]
    sizes = (rows > 0).sum(axis=1)
    single, alive = sizes == 1, np.ones(len(rows), bool)
    scores = _scores(found.column("n").to_numpy()[order] * sizes.astype(float), alive)
    del found, column
    built = written(lattice.lattices(work, lattice.Numbers(rows), ids), "lattices")
    work.unpersist()
    while True:
        for _ in range(sub_iterations):
            counts = lattice.expected(built, scores, max_piece_length)
            alive &= single | (counts >= 0.5)
            scores = _scores(np.maximum(counts, 1e-3), alive)
        many = int(alive.sum())
        if many <= size:
            break
        target = max(size, int(shrink * many))
        longer = np.flatnonzero(alive & ~single)
        gone = longer[np.argsort(-scores[longer], kind="stable")][max(0, target - int((alive & single).sum())) :]
        if not len(gone):
            break
        alive[gone] = False
        scores = _scores(np.exp(scores), alive)
    forget(built)
    best = np.flatnonzero(alive)
    best = best[np.argsort(-scores[best], kind="stable")]
    pieces = [tuple(names[g - 1] for g in rows[i, : sizes[i]]) for i in best]
    return Tokenizer("unigram", [("[UNK]",), *pieces], scores={p: float(scores[i]) for p, i in zip(pieces, best)}, merge_brackets=merge_brackets)


def _scores(weights: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Logs of the shares of the pieces that are left."""
    return np.where(alive, np.log(np.where(alive, weights, 1.0) / weights[alive].sum()), -np.inf)


#: The fields of a token.
FIELDS = {"piece": "array<string>", "start": "int", "end": "int", "glyph": "int", "id": "int"}


def encode(df: DataFrame, text_col: str, tokenizer: Tokenizer, *, keep: list[str] | None = None, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """``df`` with tokens: array of (piece, start, end, first glyph, id), or some of these; id -1 for a piece the vocabulary lacks. Null texts have null tokens.

    A task has the tokens of about half a million bytes of text at a time, or of one text.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("array<struct<" + ",".join(f"{name}:{FIELDS[name]}" for name in fields) + ">>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for batch in batches:
            for some in few(batch):
                yield _encoded(own, some, fields)

    return df.select(*([F.col(c) for c in keep] if keep is not None else ["*"]), run(chunks(F.col(text_col))).alias("tokens"))


def _encoded(own: Tokenizer, rows: pa.ListArray | list, fields: tuple[str, ...] = tuple(FIELDS)) -> pa.Array:
    """The tokens of texts given as chunks, as one flat array of each field under lists.

    Tokens divide the texts, so all that is made is where glyphs and tokens end. Chunks in
    brackets and parts of two glyphs or more are segmented once each; the rest is array work.
    """
    rows = pa.array(rows, pa.list_(pa.string())) if isinstance(rows, list) else rows
    strings = rows.flatten()
    joined = "".join(strings.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
    chunk_ends = np.cumsum(pc.utf8_length(strings).to_numpy(zero_copy_only=False), dtype=np.int64)
    chunk_starts = np.concatenate(([0], chunk_ends[:-1])) if len(chunk_ends) else chunk_ends
    begins = np.zeros(len(points) + 1, bool)  # of chunks, by characters
    begins[chunk_starts] = True
    begins[-1] = True

    whole = np.ones(len(points) + 1, bool)  # glyphs begin here
    codes = points.copy()
    for k, (a, b) in enumerate(_DOUBLE):
        at = np.flatnonzero((points[:-1] == a) & (points[1:] == b) & ~begins[1:-1])
        codes[at], whole[at + 1] = _BEYOND + k, False
    held = np.flatnonzero(chunk_ends - chunk_starts >= 2)
    held = held[(points[chunk_starts[held]] == ord("[")) & (points[chunk_ends[held] - 1] == ord("]"))]
    cut = begins.copy()  # tokens begin here
    special: dict[int, int] = {}  # ids of tokens in brackets, by where they begin
    known: dict[str, tuple[list[int], list[tuple[int, int]]]] = {}
    for a, b in zip(chunk_starts[held].tolist(), chunk_ends[held].tolist()):
        if (chunk := joined[a:b]) not in known:
            parts = chunk_glyphs(chunk)
            pieces = own.segment(tuple(parts))
            ends_of = lambda sizes: np.cumsum([0, *sizes])[:-1].tolist()
            known[chunk] = ends_of(map(len, parts)), list(zip(ends_of(sum(map(len, p)) for p in pieces), (own.ids.get(p, -1) for p in pieces)))
        places, tokens = known[chunk]
        whole[a:b] = cut[a:b] = False
        whole[[a + i for i in places]] = True
        cut[[a + i for i, _ in tokens]] = True
        special |= {a + i: k for i, k in tokens}
    glyph_at = np.flatnonzero(whole)  # and the end
    glyph_code = codes[glyph_at[:-1]]
    inside = own.together(glyph_code)  # neighbours that may be in one piece
    free = np.ones(len(points) + 1, bool)
    for a, b in zip(chunk_starts[held].tolist(), chunk_ends[held].tolist()):
        free[a:b] = False
    cut[glyph_at[1:-1][~inside & free[glyph_at[1:-1]]]] = True

    token_at = np.flatnonzero(cut[glyph_at])  # by glyphs, and the end
    n_glyphs = np.diff(token_at)
    ids = own.single(glyph_code[token_at[:-1]])
    longer = np.flatnonzero((n_glyphs > 1) & free[glyph_at[token_at[:-1]]])
    if len(longer):
        spelt: dict[str, int] = {}
        which = np.fromiter((spelt.setdefault(joined[a:b], len(spelt)) for a, b in zip(glyph_at[token_at[longer]].tolist(), glyph_at[token_at[longer + 1]].tolist())), np.int64, len(longer))
        split = [own._segment(tuple(chunk_glyphs(x))) for x in spelt]
        many = np.fromiter(map(len, split), np.int64, len(split))
        sizes = np.fromiter((len(p) for x in split for p in x), np.int64, many.sum())
        own_ids = np.fromiter((own.ids.get(p, -1) for x in split for p in x), np.int64, many.sum())
        first = np.cumsum(many) - many
        reps = many[which]
        at = np.repeat(first[which] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        each = np.ones(len(n_glyphs), np.int64)
        each[longer] = reps
        put = np.repeat(np.isin(np.arange(len(n_glyphs)), longer, assume_unique=True), each)
        n_glyphs, ids = np.repeat(n_glyphs, each), np.repeat(ids, each)
        n_glyphs[put], ids[put] = sizes[at], own_ids[at]
        token_at = np.concatenate(([0], np.cumsum(n_glyphs)))
    token_char = glyph_at[token_at]
    if special:
        places = np.fromiter(special.keys(), np.int64, len(special))
        ids[np.searchsorted(token_char, places)] = np.fromiter(special.values(), np.int64, len(special))

    ends_of_rows = np.concatenate(([0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)))
    row_char = np.concatenate(([0], chunk_ends))[ends_of_rows]
    edges = np.searchsorted(token_char, row_char)
    number = lambda x: pa.array(np.asarray(x).astype(np.int32))

    def glyph_strings() -> pa.Array:
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate(([0], np.cumsum(width)))[glyph_at]
        return pa.StringArray.from_buffers(len(glyph_at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(joined.encode()))

    made = {
        "piece": lambda: pa.ListArray.from_arrays(number(token_at), glyph_strings()),
        "start": lambda: number(_within(token_char, edges)),
        "end": lambda: number(_within(token_char, edges) + np.diff(token_char)),
        "glyph": lambda: number(_within(token_at, edges)),
        "id": lambda: number(ids),
    }
    tokens = pa.StructArray.from_arrays([made[name]() for name in fields], list(fields))
    return pa.ListArray.from_arrays(number(edges), tokens, mask=rows.is_null())


def _within(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where tokens begin within their text, from where they begin in all; ``edges`` has the tokens of texts."""
    return at[:-1] - np.repeat(at[edges[:-1]], np.diff(edges))


def ends(df: DataFrame, text_col: str, arms: dict[str, Tokenizer], *, keep: list[str]) -> DataFrame:
    """Where each text's tokens end, by characters, under each of some tokenizers: a column of ascending places an arm, in one pass over the texts. Null texts have nulls."""
    sent = df.sparkSession.sparkContext.broadcast(arms)

    @F.arrow_udf("struct<" + ",".join(f"`{arm}`:array<int>" for arm in arms) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for some in few(batch):
                found = [_encoded(own, some, ("end",)) for own in sent.value.values()]
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(x.offsets, x.values.field(0), mask=x.is_null()) for x in found], list(sent.value))

    told = df.select(*keep, run(chunks(F.col(text_col))).alias("_ends"))
    return told.select(*keep, *[F.col("_ends").getField(arm).alias(arm) for arm in arms])


def lattice_entropy(run: Piece, scores: dict[Piece, float], longest: int) -> float:
    """The entropy, in nats, over all segmentations of a run; 0 where there is none."""
    n = len(run)
    total, entropy = [0.0] + [-math.inf] * n, [0.0] * (n + 1)
    for end in range(1, n + 1):
        ways = [(total[i] + s, i) for i in range(max(0, end - longest), end) if total[i] > -math.inf and (s := scores.get(run[i:end])) is not None]
        for w, _ in ways:
            total[end] = _log_sum(total[end], w)
        for w, i in ways:
            q = math.exp(w - total[end])
            entropy[end] += q * (entropy[i] - (w - total[end]))
    return entropy[n] if total[n] > -math.inf else 0.0


def chunk_entropies(table: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``table`` of distinct chunks (column glyphs) with each one's entropy; unknown glyphs have score 0."""
    sent = table.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("double")
    def run(parts: pd.Series) -> pd.Series:
        own = sent.value

        scores = {("\0",): 0.0} | own.scores
        known: dict[Piece, float] = {}

        def of(part: Piece) -> float:  # ways to cut on either side of a part's ends don't depend on each other, so entropies add up
            if part not in known and len(known) >= KNOWN // 8:
                known.clear()
            if part not in known:
                known[part] = lattice_entropy(part, scores, own.longest)
            return known[part]

        def one(p) -> float:
            named = tuple(g if (g,) in own.scores else "\0" for g in p)
            return math.fsum(of(part) for r in runs(named, own.merge_brackets) for part in own.parted(r) if len(part) > 1)

        return parts.map(one)

    return table.withColumn("entropy", run("glyphs"))


def segmentation_entropy(df: DataFrame, id_col: str, text_col: str, tokenizer: Tokenizer) -> DataFrame:
    """(id, entropy, n_glyphs) a text: entropies are made once a distinct chunk and summed over its chunks."""
    at = df.select(id_col, F.posexplode(chunks(F.col(text_col))).alias("pos", "chunk"))
    distinct = chunk_entropies(at.select("chunk").distinct().withColumn("glyphs", glyphs(F.col("chunk"))), tokenizer)
    return at.join(distinct.select("chunk", "entropy", F.size("glyphs").alias("n")), "chunk").groupBy(id_col).agg(F.sum("entropy").alias("entropy"), F.sum("n").alias("n_glyphs"))


def segment_table(df: DataFrame, id_col: str, text_col: str, tokenizer: Tokenizer) -> DataFrame:
    """One row a token: id, pos, piece, start, end, n_glyphs."""
    return encode(df, text_col, tokenizer, keep=[id_col], fields=("piece", "start", "end")).select(id_col, F.posexplode("tokens").alias("pos", "t")).select(id_col, "pos", "t.piece", "t.start", "t.end", F.size("t.piece").alias("n_glyphs"))


def build(kind: str, table: DataFrame | None = None, **options) -> Tokenizer:
    """A tokenizer by kind: atomic, bpe or unigram."""
    if kind == "atomic":
        return atomic()
    if kind not in ("bpe", "unigram") or table is None:
        raise ValueError(f"no such kind, or no chunks: {kind}")
    return (train_bpe if kind == "bpe" else train_unigram)(table, **options)
