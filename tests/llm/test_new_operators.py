"""Clusters, suffixes and funnels against plain Python, and awkward rows."""

from __future__ import annotations

import datetime
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from lexforge.llm import funnel, hamerly, suffix
from lexforge.llm.queries import FUNNELS, QUERIES, WITHIN


# funnels


def plain_funnels(rows, funnels, within):
    """(funnel, client) to a list of attempts' times."""
    rows = {r for r in rows if None not in r}
    out = {}
    for f in funnels:
        for client, kind, at in rows:
            if kind != f.steps[0]:
                continue
            times = [at]
            for step in f.steps[1:]:
                later = [t for c, k, t in rows if c == client and k == step and t > times[-1]]
                if not later or min(later) - at > within or any(c == client and k in f.excluded and times[-1] < t <= min(later) for c, k, t in rows):
                    break
                times.append(min(later))
            out.setdefault((f.name, client), []).append(times)
    return out


def made_clicks(seed, n=700, clients=4, gap=90):
    rng = random.Random(seed)
    kinds = ["view"] * 6 + ["click"] * 4 + ["purchase"] * 3 + ["error", "signup", "other", None]
    rows = []
    for _ in range(n):
        rows.append((rng.choice([*range(clients), 0, 0, None]), rng.choice(kinds), None if rng.random() < 0.01 else rng.randrange(n * gap // 10) * 1_000_000 + rng.choice([0, 0, 0, 250_001])))
    return rows + rows[::9]


def frame_of(spark, rows):
    start = datetime.datetime(2024, 1, 31, 23, 58)
    return spark.createDataFrame([(c, k, None if t is None else start + datetime.timedelta(microseconds=t), "x") for c, k, t in rows], "client_id long, kind string, arrived_at timestamp_ntz, start string")


@pytest.mark.parametrize("seed,slices", [(1, 12), (2, 1), (3, 2)])
def test_funnels_equal_plain_python(spark, seed, slices):
    rows = made_clicks(seed)
    expected = plain_funnels(rows, FUNNELS, WITHIN)
    found = {(r["funnel"], r["client"]): r for r in funnel.counted(frame_of(spark, rows), FUNNELS, window=WITHIN, slice_windows=slices).collect()}
    assert found.keys() == expected.keys()
    deepest = {key: max(map(len, tries)) for key, tries in expected.items()}
    assert max(deepest.values()) == 4
    for key, tries in expected.items():
        row = found[key]
        assert [row[f"n{k}"] for k in range(1, 5)] == [sum(len(t) >= k for t in tries) for k in range(1, 5)]
        for k in range(2, 5):
            times = sorted(t[k - 1] - t[k - 2] for t in tries if len(t) >= k)
            assert row[f"t{k}"] == (times[math.ceil(25 * len(times) / 100) - 1] if times else None)
        assert row["deepest"] == deepest[key]
        assert row["same_depth"] == sum(f == key[0] and d == deepest[key] for (f, _), d in deepest.items())


def test_funnel_edges(spark):
    """The window's end counts, an excluded row at the next step's time ends an attempt, and rows at one time aren't later than each other."""
    second = 1_000_000
    rows = [(1, "view", 0), (1, "click", 300 * second), (2, "view", 0), (2, "click", 300 * second + 1), (3, "view", 0), (3, "click", 5), (3, "error", 5), (4, "view", 7), (4, "click", 7), (5, "view", 0), (5, "error", 0), (5, "click", 9)]
    two = [funnel.Funnel("F", ("view", "click"), ("error",))]
    found = {r["client"]: (r["n1"], r["n2"], r["t2"]) for r in funnel.counted(frame_of(spark, rows), two, window=WITHIN).collect()}
    assert found == {1: (1, 1, 300 * second), 2: (1, 0, None), 3: (1, 0, None), 4: (1, 0, None), 5: (1, 1, 9)}


def test_funnels_without_rows(spark):
    assert funnel.counted(frame_of(spark, []), FUNNELS, window=WITHIN).collect() == []
    assert funnel.counted(frame_of(spark, [(None, "view", 1), (1, None, 1), (1, "view", None)]), FUNNELS, window=WITHIN).collect() == []


def test_pattern_takes_the_earliest_steps():
    f, kinds = funnel.Funnel("F", ("a", "b", "a"), ("x",)), ["a", "b", "x"]
    text = "".join(chr(0x10000 + m) for m in (1, 0, 2, 2, 1, 1, 6, 1, 3, 1))
    assert funnel.found_in(text, f, kinds).tolist() == [[0, 2, 4], [4, -1, -1], [5, -1, -1], [7, 8, 9], [8, -1, -1], [9, -1, -1]]


@pytest.mark.parametrize("spread", [3, 1 << 16, 1 << 22])
def test_kth_smallest(spark, spread):
    rng = random.Random(spread)
    rows = [(rng.choice("aab"), rng.randrange(spread)) for _ in range(500)]
    found = {r["g"]: r["kth"] for r in funnel.kth_smallest(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", 25).collect()}
    for g in "ab":
        own = sorted(v for h, v in rows if h == g)
        assert found[g] == own[math.ceil(len(own) / 4) - 1]


# clusters


def plain_clusters(rows, k, rounds, width, seed="3"):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    away = lambda v, c: sum((p - q) ** 2 for p, q in zip(v, c))
    for turn in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda c: (away(v, centres[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centres)):
                its = [v for (_, v), o in zip(kept, own) if o == c]
                if its:
                    centres[c] = [sum(col) // len(its) for col in zip(*its)]
    far = [away(v, centres[o]) for (_, v), o in zip(kept, own)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fits = lambda v: v if v < 1 << 63 else None  # noqa: E731  what a long holds
    return sorted((i if i is not None else -1, o, fits(d), fits(sum(e for e, p in zip(far, own) if p == o)), fits(sum(far)), names[o]) for (i, _), o, d in zip(kept, own, far))


def made_vectors(seed, n, width, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, (scale * (rng.integers(0, 4, width) / 2 + rng.normal(size=width) * rng.choice([0, 0.2]))).astype(np.float32).tolist()) for i in range(n)]
    return [*rows, *rows[::7], (None, rows[-1][1]), (900, None), (901, []), (902, [1.0] * (width + 1)), (903, [float("nan")] * width), (904, [float("inf")] + [0.0] * (width - 1)), (905, [None] + [0.0] * (width - 1)), (906, [0.0] * width)]


@pytest.mark.parametrize("seed,n,width,k,scale", [(1, 90, 3, 8, 1.0), (2, 60, 8, 5, 1.0), (3, 40, 4, 3, 3e6), (4, 3, 4, 8, 1.0)])
def test_clusters_equal_plain_python(spark, seed, n, width, k, scale):
    rows = made_vectors(seed, n, width, scale)
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    found = hamerly.cluster(frame, k=k, rounds=6, components=width, seed="3").collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in found) == plain_clusters(rows, k, 6, width)


def test_clusters_without_vectors(spark):
    empty = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert hamerly.cluster(empty, k=8, rounds=2, components=64, seed="3").collect() == []
    none = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert hamerly.cluster(none, k=8, rounds=2, components=2, seed="3").collect() == []


def test_bounds_save_scans_and_stay_true():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(4000, 16)) * 300 + rng.integers(0, 6, (4000, 1)) * 2000)
    now = hamerly.Centroids([[int(v) for v in row] for row in x[:6]])
    cluster, upper, lower = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
    scanned = []
    for _ in range(8):
        scanned.append(hamerly.assign(x, cluster, upper, lower, now))
        d2 = hamerly.squared(x, now.c)
        assert (cluster == d2.argmin(1)).all()
        k = np.arange(len(x))
        assert (upper >= np.sqrt(d2[k, cluster])).all()
        d2[k, cluster] = np.inf
        assert (lower <= np.sqrt(d2.min(1))).all()
        before = now.rows
        now = hamerly.Centroids([[int(v) for v in np.floor_divide(x[cluster == c].sum(0), max(1, (cluster == c).sum()))] if (cluster == c).any() else before[c] for c in range(6)], before)
    assert scanned[0] == 4000 and scanned[-1] < 1000


# suffixes


def plain_repeats(rows, least):
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            first[w] = min(first.get(w, math.inf), math.inf if i is None else i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < (math.inf if i is None else i):
                gone[k : k + least] = [True] * least
        spans, at = [], 0
        while at < len(b):
            if gone[at]:
                end = at
                while end < len(b) and gone[end]:
                    end += 1
                spans.append((at, end - at))
                at = end
            at += 1
        out.append((i if i is not None else -1, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def made_texts(seed, n=70, alphabet="ab é"):
    rng = random.Random(seed)
    own = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [own(rng.randrange(10, 90)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([own(rng.randrange(40)), rng.choice(shared), shared[0]]) for _ in range(rng.randrange(8)))) for i in range(n)]
    return [*rows, (None, shared[0] * 2), (None, rows[5][1]), (3, shared[1] + "x" + shared[0]), rows[9], (500, None), (501, ""), (502, "a" * 300), (503, "b" + "a" * 200)]


@pytest.mark.parametrize("seed,least,alphabet", [(1, 12, "ab é"), (2, 20, "abcdefgh "), (3, 4, "abc"), (4, 50, "xyz ")])
def test_repeats_equal_plain_python(spark, seed, least, alphabet):
    rows = made_texts(seed, alphabet=alphabet)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    found = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffix.remove_repeats(frame, least=least).collect()]
    assert sorted(found) == plain_repeats(rows, least)


def chunk_of(rows, least):
    kept = [(hash(r) & (1 << 62) - 1, r[0], r[1].encode()) for r in rows if r[1] and len(r[1].encode()) >= least]
    return suffix.Chunk(pa.table([pa.array(c, t) for c, t in zip(zip(*kept), [pa.int64(), pa.int64(), pa.binary()])], ["row_key", "doc_id", "data"]), least)


@pytest.mark.parametrize("hot", [1 << 30, 2, 20])
def test_chunks_and_slots_equal_plain_python(monkeypatch, hot):
    """All of the work of tasks, without Spark: blocks that cut segments, anchors dealt out by their strings, several chunks and slots."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "BLOCK", 64)
    least, slots, rows = 14, 3, made_texts(7, 90, "abé ")
    chunks = [chunk_of(rows[::2], least), chunk_of(rows[1::2], least)]

    def packed_of(k):
        return pa.Table.from_batches(suffix._gathered(iter([(k, 0, suffix.anchors(chunks[k].docs, least))]), lambda h: suffix._slots(h, slots), "<u4"))
    hashes = pa.concat_tables([packed_of(k) for k in range(2)])
    answers = {k: [] for k in range(2)}
    for s in range(slots):
        told = suffix._shared(hashes.filter(pa.compute.equal(hashes.column("slot"), s)), slots, 1)
        for row in told.to_pylist():
            for own, slot, _, bits in zip(*suffix._cut_bits(pa.Table.from_pylist([row], told.schema))):
                answers[int(own)].append((int(slot), bits))
    sent = pa.concat_tables([suffix.sent(k, chunks[k], slots, answers[k]) for k in range(2)])
    verdicts = pa.concat_tables([suffix.decided(sent.filter(pa.compute.equal(sent.column("slot"), s)), least) for s in range(slots)])
    told = pa.concat_tables([verdicts, sent.filter(pa.compute.is_null(sent.column("slot")))])
    found = []
    for k in range(2):
        for r in suffix.cut(chunks[k], told.filter(pa.compute.equal(told.column("chunk"), k))).to_pylist():
            found.append((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], [(s["start"], s["length"]) for s in r["spans"]], r["kept"]))
    assert sorted(found) == [r for r in plain_repeats(rows, least) if r[1] >= least]


def test_suffix_sort_and_collisions():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    text, most = suffix.Hashed(data), 40
    start = rng.permutation(len(data) - most)[:2000]
    sizes = np.array([1, 2, 3, 700, 1294])
    first, size = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
    order = suffix.suffix_sort(text, start, first, size, most)
    proved, equal = suffix.verified(text, start, first, order, most)
    assert (proved == order).all()
    rows = [(int(f), data[s : s + most].tobytes()) for f, s in zip(first, start)]
    assert [rows[i] for i in order] == sorted(rows)
    assert equal.tolist() == [k > 0 and rows[order[k]] == rows[order[k - 1]] for k in range(len(rows))]
    # a hash under which everything collides: the bytes decide
    text.sums[:] = 0
    order = suffix.suffix_sort(text, start, first, size, most)
    proved, again = suffix.verified(text, start, first, order, most)
    assert [rows[i] for i in proved] == sorted(rows) and again.tolist() == equal.tolist()


def test_repeats_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(empty).collect() == []
    assert [r["n_bytes"] for r in suffix.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [0]


def test_new_queries_are_registered():
    assert {"op11_centroids", "op12_suffix", "op13_funnels"} <= QUERIES.keys()


def test_secrets_behind_long_names_and_users(spark):
    """Names that go on, passwords with an @, arrows, tags: found whole. What looks alike and isn't assigned stays."""
    from lexforge.llm import secrets

    user = "u" * 70
    gone = ["SECRET_KEY_BASE=hunter2!x9", "DB_PASSWORD_STAGING_EU: hunter2!x9", f"https://{user}:Sup3r-S3cret9@db/x", "https://user:Sup3r@S3cret@db/x", "token => 'abcDEFghiJKL!x9'", "passphrase = kX9!vQ2#mLp4", "<password>kX9!vQ2#mLp4</password>"]
    kept = ["the secret of a good soup is time", "see https://example.org/a@b and mail me", "key: value, a => b", "password reset instructions were sent"]
    rows = spark.createDataFrame([(i, t, "src0") for i, t in enumerate(gone + kept)], "doc_id int, text string, source string")
    found = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert [found[i] for i in range(len(gone))] == ["SECRET_KEY_BASE=[SECRET]", "DB_PASSWORD_STAGING_EU: [SECRET]", f"https://{user}:[SECRET]@db/x", "https://user:[SECRET]@db/x", "token => '[SECRET]'", "passphrase = [SECRET]", "<password>[SECRET]</password>"]
    assert [found[i + len(gone)] for i in range(len(kept))] == kept
