"""Molecular graphs and functional bonds: notations written by hand, and what isn't a molecule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexforge.functions import lexing
from lexforge.operators import emission, molecules


def bonds_of(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("b", emission.functional_bonds(lexing.glyphs(F.col("t")))).orderBy("i").collect()
    return [None if r["b"] is None else [(x["label"], x["position"]) for x in r["b"]] for r in rows]


def test_classes(spark):
    found = bonds_of(spark, "CC(=O)N", "CC#N", "CS(=O)(=O)C", "C[N+](=O)[O-]", "C=CC", "CC#CC", "OP(=O)(O)O", "CC(=S)N", "CC=NC", "CC(=O)OC#N")
    assert [[x[0] for x in b] for b in found] == [["C=O"], ["C#N"], ["S=O", "S=O"], ["N=O"], [], [], ["P=O"], ["C=S"], ["C=N"], ["C=O", "C#N"]]
    assert found[0] == [("C=O", 4)] and found[4] == []


def test_ring_closures_and_degrees(spark):
    """The sign of a ring's bond is where it is written: beside the heteroatom it has a place, elsewhere none."""
    assert bonds_of(spark, "N=1CCCC1", "C=1CCCN1", "C1CCCN=1") == [[("C=N", 1)], [], [("C=N", 6)]]
    # of two heteroatoms the one of lower degree; of equal ones the bond's first
    assert bonds_of(spark, "CN=O", "O=NC", "N=O", "O=N", "CSS(=S)C") == [[("N=O", 3)], [("N=O", 1)], [("other", 1)], [("N=O", 1)], [("other", 5)]]
    # the label is by element: an aromatic or bracketed atom has the same
    assert bonds_of(spark, "O=c1cc[nH]cc1", "C=[NH2+]", "C=[Se]") == [[("C=O", 1)], [("C=N", 2)], [("other", 2)]]


def test_what_is_no_molecule(spark):
    bad = ["not_a_smiles_(((", "", "C(", "C)", "C()", "(C)", "C1CC", "C11", "C12CC12", "C==C", "=C", "C=", "C(=)O", "C.=C", "C.", ".C", "C(.C)", "C[", "C[Xx]", "C[]", "C%1C", "C-1CC=1", "[H]C", "*C"]
    assert bonds_of(spark, *bad, None) == [None] * (len(bad) + 1)
    good = ["C", "[H+]", "C.C", "C1CC1", "C=1CC=1", "C%12CC%12", "[13C@H](C)(N)O", "[Na+].[Cl-]", "C/C=C\\C", "C1.C1", "c1ccccc1", "[CH3:7]C"]
    assert None not in bonds_of(spark, *good)


def test_atoms_agree_with_their_spans(spark):
    texts = ["CC(=O)Nc1ccccc1", "O=S(=O)(N)c1ccccc1", "N#Cc1ccncc1", "C[nH]", "[13CH3][N+](=O)[O-]", "ClCCBr"]
    parts = lexing.glyphs(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", molecules.graph(parts).alias("m"), lexing.atom_spans(parts).alias("s")).collect()
    for row in rows:
        assert [(a["start"], a["end"]) for a in row["m"]["atoms"]] == [(s["start"], s["end"]) for s in row["s"]]
        assert len(row["m"]["bonds"]) >= len(row["m"]["atoms"]) - 1


@pytest.mark.parametrize("cuts,local", [([], True), ([4], False), ([3, 5], True)])
def test_locality_of_a_carbonyl(spark, cuts, local):
    row = spark.createDataFrame([("CC(=O)N", cuts)], "t string, cuts array<int>").select(emission.locality_of(emission.functional_bonds(lexing.glyphs(F.col("t"))), F.col("cuts")).alias("b")).first()
    assert [(b["label"], b["local"]) for b in row["b"]] == [("C=O", local)]
