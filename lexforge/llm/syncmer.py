"""Document fingerprints from closed syncmers of words; DataFrame functions only.

A text is read as words. A k-mer, ``K`` consecutive words, is a closed syncmer
if the smallest of its inner s-mers (``S`` consecutive words, by hash) is its
first or its last. Whether it is depends on its own words alone, not on what
stands around them, so an edit elsewhere leaves it: the syncmers are anchors
that two versions of a text share wherever they agree. A gap between two anchors
is never longer than ``K - S`` k-mers.

Texts are compared by all of their anchors, which are kept with their positions:
by what they share, by what they share in the same place, and by the passages in
which anchors follow each other at one distance. The fingerprint is only a digest,
a bottom sketch of the anchors' hashes: ``SKETCH`` of them (a parameter; None for
all), smallest first, 8 hex digits each. A text with words but
without a syncmer (with fewer than ``K`` words always, with a few more at times)
is one anchor, the hash of its whole sequence of words; one without words has
none, and the empty fingerprint.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexforge.functions.arrays import let

#: Words of a k-mer and of an s-mer, and hashes in a fingerprint.
K, S, SKETCH = 6, 2, 64
DIGITS = 8
SPACE = r"[\x20\x09-\x0D]+"


def placed(text: Column, k: int = K, s: int = S) -> Column:
    """A text's anchors in order: array of (hash, at), the 32-bit hash of a closed syncmer and the number of its first word, from 0; s is 2, and k even and at least 4. Null gives null."""
    if s != 2 or k < 4 or k % 2:
        raise ValueError("s must be 2, and k even and at least 4")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    inner = k - s + 1
    kind = "array<struct<hash:bigint,at:int>>"

    def anchor(h: Column, at: Column) -> Column:
        return F.struct(F.shiftrightunsigned(h, 32).alias("hash"), at.cast("int").alias("at"))

    def from_words(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))

        def from_pairs(p: Column) -> Column:
            # the smallest of the inner s-mers but the first and last: (k - s - 1) neighbours
            def middle(i: Column) -> Column:
                return F.least(*[F.get(p, i + j) for j in range(1, inner - 1)])

            return F.filter(F.transform(p, lambda x, i: F.when((i + inner <= F.size(h) - s + 1) & (F.least(x, F.get(p, i + inner - 1)) <= middle(i)), anchor(F.xxhash64(*[F.get(p, i + j) for j in range(0, inner, s)]), i))), lambda x: x.isNotNull())

        whole = F.array(anchor(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)), F.lit(0)))
        return let(let(pairs, from_pairs), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))

    return let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast(kind)).otherwise(from_words(h)))


def hashes_of(found: Column) -> Column:
    """The distinct hashes of placed anchors, smallest first, each less 2^31, as 4 bytes."""
    return F.sort_array(F.array_distinct(F.transform(found, lambda x: (x["hash"] - (1 << 31)).cast("int"))))


def as_text(hashes: Column, sketch: int | None = SKETCH) -> Column:
    """The fingerprint: 8 lower-case hex digits for each of the smallest ``sketch`` hashes (None: for each)."""
    some = hashes if sketch is None else F.slice(hashes, 1, sketch)
    return F.array_join(F.transform(some, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + (1 << 31)), DIGITS, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """From the hashes of all anchors of two texts, the share that they have in common, 0 to 1: twice the shared over the sum of both.

    Two texts without words are alike, 1; one without is unlike any that has
    some, 0.
    """
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def in_place(a: Column, b: Column) -> Column:
    """The share of both texts' placed anchors that the other has at the same word; 1 for two texts without any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def passages(a: Column, b: Column) -> Column:
    """What two texts share, from their placed anchors: array of (at, other, anchors), the first word of a shared stretch in either text and how many anchors it has.

    Of an anchor that a text has more than once, the first place counts. A stretch
    goes on as long as the next shared anchor is equally far on in both texts.
    """

    def firsts(found: Column, side: int) -> Column:
        ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["at"].alias("at"))))
        return let(ordered, lambda own: F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1)["hash"] != x["hash"])))

    def matched(both: Column) -> Column:  # of a hash that both have, the first text's place comes after the second's
        def one(x: Column, i: Column) -> Column:
            last = F.get(both, i - 1)
            return F.when((x["side"] == 1) & (last["hash"] == x["hash"]), F.struct(x["at"].alias("at"), last["at"].alias("other")))

        return F.array_sort(F.filter(F.transform(both, one), lambda x: x.isNotNull()))

    def cut(found: Column) -> Column:
        far = lambda x: x["other"] - x["at"]
        begun = F.filter(F.transform(found, lambda x, i: F.struct(x["at"].alias("at"), x["other"].alias("other"), i.alias("i"), ((i == 0) | ~far(F.get(found, i - 1)).eqNullSafe(far(x))).alias("new"))), lambda x: x["new"])
        return let(begun, lambda own: F.transform(own, lambda x, k: F.struct(x["at"].alias("at"), x["other"].alias("other"), (F.coalesce(F.get(own, k + 1)["i"], F.size(found)) - x["i"]).cast("int").alias("anchors"))))

    return let(let(F.array_sort(F.concat(firsts(a, 1), firsts(b, 0))), matched), cut)


#: Buckets at most, rows of a bucket at least, about, and sampled rows for each bound.
BUCKETS, BUCKET, SAMPLED = 1 << 16, 1024, 4
#: Characters of the first carried column that part rows of one id.
PREFIX = 8


def _range_key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.coalesce(F.left(F.col(text_col), F.lit(PREFIX)), F.lit("")).alias("text"))


def _places(bounds: list, key: Column, kind: str) -> Column:
    """How many of the ascending bounds are at or below a key: those at steps first, then the ones of one step."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    sent = lambda rows: F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")
    upto = lambda rows: F.size(F.filter(rows, lambda b: b <= key))
    return let(upto(sent(bounds[step - 1 :: step])), lambda c: c * step + upto(F.slice(sent(bounds), c * step + 1, step)))


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """``docs`` with, for each column in ``carried``, ``next_<column>`` of the row after it by id (after the last: the first).

    Nulls come last; equal ids are ordered by the carried columns, the first of
    which is a text. Rows are dealt out into ranges of (id, the beginning of that
    text), whose bounds come from a sample of about ``SAMPLED`` rows a range; they
    decide on places only, and no range grows with the spread of the ids. A
    window runs in each, whose last row meets a second copy of the next range's
    first. Only rows alike in id and that beginning stay together; their sort
    can spill.
    """
    kind = f"struct<none:boolean,id:{docs.schema[id_col].dataType.simpleString()},text:string>"
    key = _range_key(id_col, carried[0])
    n = docs.count()
    buckets = max(1, min(BUCKETS, n // BUCKET))
    bounds: list = []
    if buckets > 1:
        share = F.shiftrightunsigned(F.xxhash64("k"), 11) / F.lit(float(1 << 53))
        sample = docs.select(key.alias("k")).where(share < SAMPLED * buckets / n).distinct().orderBy("k").select("k.*").collect()
        bounds = [sample[i].asDict() for i in range(SAMPLED, len(sample), SAMPLED)]
    keyed = docs.withColumn("_key", key).withColumn("_at", _places(bounds, F.col("_key"), kind).cast("int"))
    firsts = keyed.groupBy("_at").agg(F.min("_key").alias("_first"))
    ring = Window.orderBy("_at")  # over at most BUCKETS rows
    firsts = firsts.select("_at", "_first", F.coalesce(F.lag("_at").over(ring), F.max("_at").over(Window.partitionBy(F.lit(1)))).alias("_previous"))
    known = keyed.join(F.broadcast(firsts.withColumnRenamed("_at", "_own")), F.col("_at") == F.col("_own"))
    own, copy = F.struct(F.col("_at").alias("bucket"), F.lit(False).alias("copy")), F.struct(F.col("_previous").alias("bucket"), F.lit(True).alias("copy"))
    rows = known.withColumn("_place", F.explode(F.when(F.col("_key") == F.col("_first"), F.array(own, copy)).otherwise(F.array(own)))).drop("_at", "_own", "_key", "_first", "_previous")
    window = Window.partitionBy("_place.bucket").orderBy("_place.copy", F.col(id_col).asc_nulls_last(), *[c for c in carried])
    found = rows.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in carried])
    return found.where(~F.col("_place.copy")).drop("_place")


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """(doc_id, text, anchors, hashes, fingerprint) for each row: all anchors with their positions, and their distinct hashes; a null text is empty. Equal texts have equal fingerprints. Other columns aren't read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.withColumn("anchors", placed(F.col("text"))).withColumn("hashes", hashes_of(F.col("anchors")))
    return found.withColumn("fingerprint", as_text(F.col("hashes"), sketch))


def edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text against an edited one and the next row's.

    doc_id, n_chars, edited (the text with its last floor(n_chars / 2) code
    points replaced by the first as many, or all, of the next row's by ascending
    id), fingerprint, edited_fingerprint, near_edited, near_next and in_place, the
    likeness of text and edited text by anchors at the same words. A null text
    is empty; null ids come last; the row after the last is the first, so a
    single row is its own next. Repeated rows have a row each, and of two rows of
    one id that with the smaller text comes first. Texts of any length are read
    whole. An empty table gives an empty result; other columns aren't read.
    """
    prints = fingerprint(docs, id_col=id_col, text_col=text_col)
    # an anchor travels as one number: its hash, and its place below
    packed = prints.select("doc_id", "text", F.transform("anchors", lambda x: F.shiftleft(x["hash"], 31).bitwiseOR(x["at"].cast("long"))).alias("anchors"))
    hashes = lambda found: F.sort_array(F.array_distinct(F.transform(found, lambda x: (F.shiftright(x, 31) - (1 << 31)).cast("int"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(packed, "doc_id", ["text", "anchors"]).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "anchors", "next_anchors")

    def told(x: Column) -> Column:
        return F.struct(
            as_text(x["own"]).alias("fingerprint"), as_text(x["edited"]).alias("edited_fingerprint"), likeness(x["own"], x["edited"]).alias("near_edited"), likeness(x["own"], x["next"]).alias("near_next"),
            in_place(F.col("anchors"), x["placed"]).alias("in_place"),
        )

    # the edited text's anchors are made once a row, and all columns from them
    made = let(F.transform(placed(F.col("edited")), lambda x: F.shiftleft(x["hash"], 31).bitwiseOR(x["at"].cast("long"))), lambda e: F.struct(hashes(F.col("anchors")).alias("own"), hashes(F.col("next_anchors")).alias("next"), hashes(e).alias("edited"), e.alias("placed")))
    return rows.select("doc_id", "n_chars", "edited", let(made, told).alias("told")).select("doc_id", "n_chars", "edited", "told.*")
