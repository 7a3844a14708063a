"""The registry of cells and their pairing, as tables made from axes.

A cell is a point (algo, v, corpus, boundary, tier); the extras add a kind, a
label, a training folder and overrides of the trainers' knobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The axes of the study.
ALGOS, BOUNDARIES = ("bpe", "unigram"), ("nmb", "mb")
HEADLINE_SIZES, HEADLINE_CORPORA = (256, 512, 1024), ("pubchem", "zinc22", "coconut")
SENSITIVITY, ANCHOR, CONDITIONAL = ("pubchem", 2048), ("real_space", 1024), ("zinc22", 2048)
SUBSAMPLE = "size_700k"
MPL, MPL_DEFAULT = (4, 8, 16, 32, 64, 128), 16
SEEDS, SEED_DEFAULT = (250_000, 500_000, 1_000_000, 2_000_000, 4_000_000, 8_000_000), 1_000_000
SUB_ITERATIONS, SUB_ITERATION_DEFAULT = (1, 2, 3, 4), 2
SHRINK, SHRINK_DEFAULT = (0.5, 0.6, 0.75, 0.9, 0.95), 0.75
MIN_FREQUENCY, MIN_FREQUENCY_DEFAULT = (0, 1, 2, 4, 8), 2
CORPORA = ("pubchem", "zinc22", "coconut", "real_space")

# Labels, folders and sizes of the extras.
REDRAWS, REDRAWN = ("r1", "r2", "r3"), ("zinc22", "pubchem")
SWEEP, MATCHED_SIZE, MATCHED_CORPORA, MATCHED_LABEL = ("5m", "15m"), 1024, ("pubchem", "zinc22"), "700k"
UNCAPPED = {"v": 1024, "boundary": "mb", "label": "uncapped", "seed_size": 8_000_000}
SLOW_PRUNING, SLOW_PRUNING_SIZES = {"boundary": "mb", "label": "shrink_0_9", "shrink": 0.9}, (256, 512)
EXHAUSTED = {"v": 50_000, "corpus": "real_space", "label": "merge_exhaustion"}
CONVERGED = {"v": 8192, "label": "convergence_anchor"}
CROSSED_SIZES, CROSSED_CORPORA = (256, 1024), (("zinc22", SUBSAMPLE), ("coconut", None))
REFERENCES = (("pubchem", 256), ("pubchem", 1024), ("zinc22", 512))
EXTRA_SIZE, EXTRA_CORPUS, EXTRA_BOUNDARY = 512, "pubchem", "nmb"

SINGLE_ARM = ("seed_cap", "prune_schedule", "merge_exhaustion")
LARGE_ANCHOR = "large_v_anchor"
SENSITIVITY_KINDS = ("sensitivity_anchor", "mpl_ladder", "seed_ladder", "subiter_ladder", "shrink_ladder", "minfreq_ladder", "interaction_subiter_shrink", "interaction_mpl_v", "interaction_mpl_typology", "interaction_bpe_ref")

CELL = "algo string, v int, corpus string, boundary string, tier string, kind string, label string, training_subdir string, seed_size int, shrink double, max_piece_length int, min_frequency int, sub_iterations int"
COORDINATE = ["corpus", "v", "boundary", "kind", "label"]


def _cells(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in CELL.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CELL).withColumn("cell_id", cell_id())


def cell_id() -> Column:
    """corpus__algo_vN_boundary, with the kind and label of an extra."""
    return F.concat(F.concat_ws("__", "corpus", F.concat_ws("_", "algo", F.concat(F.lit("v"), F.col("v")), "boundary")), F.when(F.col("kind").isNotNull(), F.concat(F.lit("_"), F.concat_ws("_", "kind", "label"))).otherwise(""))


def grid(spark: SparkSession) -> DataFrame:
    """The 44 cells: every headline combination, and both arms and boundaries of the two single points."""
    axes = [{"algo": a, "boundary": b} for a in ALGOS for b in BOUNDARIES]
    headline = [x | {"v": v, "corpus": c, "tier": "headline"} for x in axes for v in HEADLINE_SIZES for c in HEADLINE_CORPORA]
    single = [x | {"corpus": c, "v": v, "tier": t} for x in axes for (c, v), t in ((SENSITIVITY, "sensitivity"), (ANCHOR, "anchor"))]
    return _cells(spark, headline + single)


def conditional(spark: SparkSession) -> DataFrame:
    """Two more cells, of one arm."""
    corpus, v = CONDITIONAL
    return _cells(spark, [{"algo": "bpe", "v": v, "corpus": corpus, "boundary": b, "tier": "conditional"} for b in BOUNDARIES])


def _number(x: float) -> str:
    return str(x).replace(".", "_")


def extras(spark: SparkSession) -> DataFrame:
    """The 92 extras over 17 kinds."""
    found: list[dict] = []

    def add(kind: str, algos=("unigram",), *, v: int = EXTRA_SIZE, corpus: str = EXTRA_CORPUS, boundary: str = EXTRA_BOUNDARY, label: str, subdir: str | None = None, **knobs) -> None:
        found.extend({"algo": a, "v": v, "corpus": corpus, "boundary": boundary, "tier": f"extras_{kind}", "kind": kind, "label": label, "training_subdir": subdir} | knobs for a in algos)

    for label in REDRAWS:
        for corpus in REDRAWN:
            add("subsample_redraw", ALGOS, corpus=corpus, label=label, subdir=f"redraw_{label}")
    for label in SWEEP:
        add("size_sweep", ALGOS, label=label, subdir=f"size_{label}")
    for corpus in MATCHED_CORPORA:
        for boundary in BOUNDARIES:
            add("size_matched", ALGOS, v=MATCHED_SIZE, corpus=corpus, boundary=boundary, label=MATCHED_LABEL, subdir=SUBSAMPLE)
    add("seed_cap", **UNCAPPED)
    for v in SLOW_PRUNING_SIZES:
        add("prune_schedule", v=v, **SLOW_PRUNING)
    add("merge_exhaustion", ("bpe",), **EXHAUSTED)
    add(LARGE_ANCHOR, ALGOS, **CONVERGED)
    add("sensitivity_anchor", ALGOS, label="anchor", subdir=SUBSAMPLE)
    ladders = (
        ("mpl_ladder", "unigram", "max_piece_length", MPL, MPL_DEFAULT), ("seed_ladder", "unigram", "seed_size", SEEDS, SEED_DEFAULT), ("subiter_ladder", "unigram", "sub_iterations", SUB_ITERATIONS, SUB_ITERATION_DEFAULT),
        ("shrink_ladder", "unigram", "shrink", SHRINK, SHRINK_DEFAULT), ("minfreq_ladder", "bpe", "min_frequency", MIN_FREQUENCY, MIN_FREQUENCY_DEFAULT),
    )
    for kind, algo, knob, values, default in ladders:
        for value in values:
            if value != default:
                add(kind, (algo,), label=_number(value), subdir=SUBSAMPLE, **{knob: value})
    for si in SUB_ITERATIONS:
        for sf in SHRINK:
            if si != SUB_ITERATION_DEFAULT and sf != SHRINK_DEFAULT:
                add("interaction_subiter_shrink", label=f"si{si}_sf{_number(sf)}", subdir=SUBSAMPLE, sub_iterations=si, shrink=sf)
    for mpl in MPL:
        for v in CROSSED_SIZES:
            add("interaction_mpl_v", v=v, label=str(mpl), subdir=SUBSAMPLE, max_piece_length=mpl)
        for corpus, subdir in CROSSED_CORPORA:
            add("interaction_mpl_typology", corpus=corpus, label=str(mpl), subdir=subdir, max_piece_length=mpl)
    for corpus, v in REFERENCES:
        add("interaction_bpe_ref", ("bpe",), v=v, corpus=corpus, label="ref", subdir=SUBSAMPLE)
    return _cells(spark, found)


def config(cells: DataFrame) -> DataFrame:
    """Each cell's training configuration: folders, merging of brackets, and knobs with their defaults."""
    folder = F.concat_ws("/", "corpus", F.when(F.col("training_subdir").isNull(), "canon_dedup_v1/train").otherwise(F.concat(F.lit("canon_dedup_v1_extras/"), "training_subdir")))
    return cells.select(
        "cell_id", "algo", "v", folder.alias("training_input"), (F.col("boundary") == "mb").alias("merge_brackets"), F.lit(True).alias("split_structure"),
        F.coalesce("min_frequency", F.lit(MIN_FREQUENCY_DEFAULT)).alias("min_frequency"), F.coalesce("max_piece_length", F.lit(MPL_DEFAULT)).alias("max_piece_length"),
        F.coalesce("seed_size", F.lit(SEED_DEFAULT)).alias("seed_size"), F.coalesce("sub_iterations", F.lit(SUB_ITERATION_DEFAULT)).alias("sub_iterations"), F.coalesce("shrink", F.lit(SHRINK_DEFAULT)).alias("shrink"),
    )


def pair_key() -> Column:
    """corpus__vN_boundary, and for an extra what it is about."""
    suffix = F.when(F.col("kind") == "subsample_redraw", F.concat(F.lit("subsample_"), "label")).when(F.col("kind") == "size_sweep", F.concat(F.lit("size_"), "label")).when(F.col("kind") == "size_matched", F.concat(F.lit("size_matched_"), "label"))
    suffix = suffix.when(F.col("kind") == "seed_cap", F.concat(F.lit("seed_"), "label")).when(F.col("kind") == "prune_schedule", F.concat(F.lit("prune_"), "label")).otherwise(F.col("label"))
    return F.concat_ws("__", "corpus", F.concat_ws("_", F.concat(F.lit("v"), F.col("v")), "boundary"), suffix)


def pairs(cells: DataFrame, large_anchor: bool = False) -> tuple[DataFrame, DataFrame]:
    """Matched pairs (pair_key, tier, bpe_cell_id, unigram_cell_id) and cells without a partner, with the reason.

    Cells of one coordinate are an arm each. More than two, two of one arm, or a
    missing arm where both are due is an error. The sensitivity battery isn't
    paired, nor is the large anchor unless asked for.
    """
    own = cells.where(F.col("kind").isNull() | ~F.col("kind").isin(*SENSITIVITY_KINDS, *([] if large_anchor else [LARGE_ANCHOR])))
    grouped = own.groupBy(*COORDINATE).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tier").alias("tiers"), F.min("tier").alias("tier"), *[F.max(F.when(F.col("algo") == a, F.col("cell_id"))).alias(f"{a}_cell_id") for a in ALGOS])
    both = F.col("bpe_cell_id").isNotNull() & F.col("unigram_cell_id").isNotNull()
    single = F.coalesce(F.col("kind").isin(*SINGLE_ARM), F.lit(False))
    wrong = (F.col("n") > 2) | (F.col("tiers") > 1) | ((F.col("n") == 2) & (~both | single)) | ((F.col("n") == 1) & F.col("kind").isNotNull() & ~single)
    if (bad := grouped.where(wrong).select(pair_key().alias("k")).limit(5).collect()):
        raise ValueError(f"cells that don't pair: {', '.join(r['k'] for r in bad)}")
    keyed = grouped.withColumn("pair_key", pair_key())
    matched = keyed.where("n = 2").select("pair_key", *COORDINATE, "tier", "bpe_cell_id", "unigram_cell_id").orderBy("pair_key")
    alone = keyed.where("n = 1").select("pair_key", *COORDINATE, "tier", F.coalesce("bpe_cell_id", "unigram_cell_id").alias("cell_id"), F.when(F.col("bpe_cell_id").isNotNull(), "bpe").otherwise("unigram").alias("arm"), F.when(F.col("kind").isNull(), "conditional_negative_branch").otherwise("extras_single_arm_knob").alias("reason"))
    return matched, alone.orderBy("pair_key")


def all_pairs(spark: SparkSession, large_anchor: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of the grid, the conditional cells and the extras."""
    return pairs(grid(spark).unionByName(conditional(spark)).unionByName(extras(spark)), large_anchor)


def transfer_cells(spark: SparkSession, v: int = 1024, boundary: str = "nmb") -> DataFrame:
    """Every ordered pair of two corpora, by arm."""
    corpora = spark.createDataFrame([(c,) for c in CORPORA], "train string")
    return corpora.crossJoin(corpora.select(F.col("train").alias("eval"))).where("train <> eval").crossJoin(spark.createDataFrame([(a,) for a in ALGOS], "arm string")).withColumn("v", F.lit(v)).withColumn("boundary", F.lit(boundary))


def smallest_bpe(cells: DataFrame) -> DataFrame:
    """For each corpus and boundary the BPE cell of the smallest size: its alphabet stands for both arms'."""
    return cells.where("algo = 'bpe'").groupBy("corpus", "boundary").agg(F.min_by("cell_id", F.struct("v", "cell_id")).alias("bpe_cell_id"))
