"""Encoding by arrays gives what segmenting chunk by chunk gives, and looks at a part of a text once."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexforge.functions import lexing
from lexforge.operators import emission, tokenizers
from lexforge.plans import token_queries

_SIGNS = ["a", "b", "C", "B", "l", "r", "[", "]", "(", "@@", "1", "%12", ".", "é", "😀", "Cl", "Br", "\n", "[13CH2]", "[]", "[nH]", "[C\n]", "the", "tion", "ing", "ou", " "]


def _trained(r: random.Random, kind: str, merge_brackets: bool) -> tokenizers.Tokenizer:
    single = [(g,) for g in [*"abcCBlr[]()@1.é😀H", "Cl", "Br"]]
    pieces, merges = list(single), []
    for _ in range(40):
        pair = r.choice(pieces), r.choice(pieces)
        if pair not in merges:
            merges.append(pair)
            pieces += [] if pair[0] + pair[1] in pieces else [pair[0] + pair[1]]
    scores = {p: -5 * r.random() * (1 + len(p) / 3) for p in pieces} if kind == "unigram" else {}
    return tokenizers.Tokenizer(kind, [("[UNK]",), *pieces], merges=merges if kind == "bpe" else [], scores=scores, merge_brackets=merge_brackets)


def _plain(own: tokenizers.Tokenizer, chunked: list[str] | None) -> list[dict] | None:
    if chunked is None:
        return None
    out, start, glyph = [], 0, 0
    for chunk in chunked:
        for p in own.segment(tuple(lexing.chunk_glyphs(chunk))):
            out.append({"piece": list(p), "start": start, "end": start + sum(map(len, p)), "glyph": glyph, "id": own.ids.get(p, -1)})
            start, glyph = out[-1]["end"], glyph + len(p)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_arrays_give_the_tokens_of_every_chunk(seed):
    r = random.Random(seed)
    texts = [None if r.random() < 0.1 else "".join(r.choice(_SIGNS) for _ in range(r.choice([0, 1, 2, 9, 90]))) for _ in range(120)]
    rows = pa.array([t if t is None else [m[1] for m in re.finditer(lexing.CHUNK, t)] for t in texts], pa.list_(pa.string()))
    arms = [token_queries.merging(), token_queries.scoring(), tokenizers.atomic(), *[_trained(r, kind, mb) for kind in ("bpe", "unigram") for mb in (False, True)]]
    for own in arms:
        for some in (rows, rows.slice(17, 60), rows.slice(5, 1), rows.slice(0, 0)):
            assert tokenizers._encoded(own, some).to_pylist() == [_plain(own, x) for x in some.to_pylist()]


def test_a_part_that_comes_again_is_segmented_once(monkeypatch):
    seen = []
    kept = tokenizers.Tokenizer._segment
    monkeypatch.setattr(tokenizers.Tokenizer, "_segment", lambda self, run: seen.append(run) or kept(self, run))
    found = tokenizers._encoded(token_queries.merging(), pa.array([["the thing of all "] * 500]), ("id",))
    assert len(found[0]) == 500 * 12 and len(seen) <= 4


def _plainly(chunks, tokens):
    """What absorbed counts, span by span."""
    real = [c for c in chunks if c[0] < c[1]]
    own = [max((t for t in tokens if t[0] <= c[0]), default=(0, -1)) for c in real]
    return len(real), sum(t == c for c, t in zip(real, own)), sum(c[1] <= t[1] and t[1] - t[0] > c[1] - c[0] for c, t in zip(real, own))


def _spans(lengths):
    ends = [sum(map(abs, lengths[: i + 1])) for i in range(len(lengths))]
    return [(e - n, e) for e, n in zip(ends, lengths) if n > 0]


def test_absorption_and_cuts_by_arrays(spark):
    r = random.Random(4)
    sizes = lambda: [r.choice([-2, -1, 1, 1, 2, 3]) for _ in range(r.randrange(9))]
    rows = [(i, sizes(), sizes(), sorted(r.sample(range(20), r.randrange(6)))) for i in range(200)] + [(200, None, [1], [1]), (201, [1], None, None)]
    df = spark.createDataFrame(rows, "id int, a array<int>, b array<int>, cuts array<int>").repartition(3)
    found = {x["id"]: x for x in df.select("id", emission.absorbed_lengths(F.col("a"), F.col("b"), True).alias("x")).select("id", "x.*").collect()}
    for i, a, b, _ in rows[:200]:
        assert tuple(found[i])[1:] == _plainly(_spans(a), _spans(b))
    assert tuple(found[200])[1:] == (None, None, None) and tuple(found[201])[1:] == (1, None, None)
    pieces = df.withColumn("a", F.transform("a", lambda n: F.abs(n))).withColumn("p", F.transform("a", lambda n: n.cast("string")))
    got = {x["class"]: (x["emitted"], x["cut_through"]) for x in emission.cut_through(pieces, [], "p", "a", "cuts", lambda p: p).collect()}
    for k in (1, 2, 3):
        each = [(s, cuts) for _, a, _, cuts in rows[:200] for s in _spans([abs(n) for n in a]) if s[1] - s[0] == k]
        assert got[str(k)] == (len(each), sum(any(s[0] < c < s[1] for c in cuts) for s, cuts in each))


def test_running_sums_of_spans_are_not_made_by_array_functions(spark):
    df = spark.createDataFrame([(0, [1], [1])], "id int, a array<int>, b array<int>")
    plan = df.select(emission.absorbed_lengths(F.col("a"), F.col("b"), True))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "array_sort" not in plan
