"""Forms of molecules: every spelling has one canonical form, Kekule forms against all matchings, written forms parse to the same graph."""

from __future__ import annotations

import itertools
import random

import pytest

from lexforge.functions import chemistry
from lexforge.operators import forms

PLUG = forms.MoleculeForms()
MOLECULES = """c1ccccc1 C1=CC=CC=C1 CC(=O)Nc1ccc(O)cc1 c1ccc2ccccc2c1 c1ccc2cccc2cc1 n1cc[nH]c1 C[N+](=O)[O-] c1ccccc1-c1ccccc1 c1ccccc1c1ccccc1 C12C3C4C1C5C2C3C45
O=c1cc[nH]cc1 [Na+].[Cl-] FC(F)(F)c1cc(C(F)(F)F)cc(C(F)(F)F)c1 C1CC2(C1)CCC2 [13CH3]C CC.CC.CO CN1CCCC1c1cccnc1 C1CCCCC1C1CCCCC1 o1cccc1 s1cccc1 c1cc2ccc3cccc4ccc(c1)c2c34
CS(=O)(=O)N C#N C1=CC2=CC=CC=C2C=C1 [O-]c1ccccc1 C%12CC%12 [CH3:4]O c1c[n+](C)ccc1 C1CC1C1CC1 CC(C)(C)CC(C)(C)C C=1CCCC=1 OB(O)c1ccccc1 C1CCC2CCCCC2C1 c1ccc(cc1)C(c1ccccc1)(c1ccccc1)c1ccccc1""".split()


def shuffled(own, seed):
    order = list(range(len(own.atoms)))
    random.Random(seed).shuffle(order)
    number = {a: i for i, a in enumerate(order)}
    return forms.Molecule([own.atoms[a] for a in order], [{number[b]: o for b, o in own.bonds[a].items()} for a in order])


@pytest.mark.parametrize("text", MOLECULES)
def test_one_canonical_form_for_all_numberings_and_spellings(text):
    own = forms.molecule(text)
    canonical = PLUG.canonical(text)
    for seed in range(12):
        again = shuffled(own, seed)
        assert forms.spelt(again, forms.ranked(again)) == canonical
        order = list(range(len(own.atoms)))
        random.Random(-seed - 1).shuffle(order)
        spelt = forms.spelt(own, order)
        assert PLUG.canonical(spelt) == canonical, spelt
    for other in (canonical, PLUG.other_toolkit(text), PLUG.explicit_hydrogens(text), *PLUG.randomized(text, 5, 3)):
        assert PLUG.canonical(other) == canonical, other


def test_different_molecules_have_different_forms():
    # last: two graphs that refinement alone can't tell apart
    found = [PLUG.canonical(t) for t in [*MOLECULES, "C1CCCCC1.C1CCCCC1", "C1CCCCCCCCCCC1"] if t not in ("C1=CC2=CC=CC=C2C=C1", "c1ccccc1c1ccccc1")]
    assert len(set(found)) == len(found) and None not in found
    assert PLUG.canonical("OCC") == PLUG.canonical("CCO") == PLUG.canonical("[CH3][CH2][OH]") != PLUG.canonical("COC")
    assert PLUG.canonical("CC[O]") != PLUG.canonical("CCO")  # a radical


def test_ties_that_refinement_cannot_break():
    """Regular graphs: every atom looks alike, and only trying tells which are images of each other."""
    ladder = "C1CC2C1C1CC21"
    for text in (ladder, "C12C3C4C1C5C2C3C45", "C1CCC1.C1CCC1.C1CC1", "C12CC3CC(C1)CC(C2)C3"):
        own = forms.molecule(text)
        assert len({forms.spelt(m, forms.ranked(m)) for m in (shuffled(own, s) for s in range(20))}) == 1


def every_matching(own):
    need = [a for a, atom in enumerate(own.atoms) if forms.needs_double(atom, own.bonds[a])]
    edges = [(a, b) for a in need for b, o in own.bonds[a].items() if a < b and o == 1.5 and b in need]
    return [m for m in itertools.combinations(edges, len(need) // 2) if len(need) % 2 == 0 and len({x for e in m for x in e}) == len(need)]


@pytest.mark.parametrize("seed", range(60))
def test_kekule_forms_against_all_matchings(seed):
    rng = random.Random(seed)
    n = rng.randrange(3, 13)
    near = [{} for _ in range(n)]
    for a in range(n):  # a ring, and chords
        b = (a + 1) % n
        near[a][b] = near[b][a] = 1.5
    for _ in range(rng.randrange(3)):
        a, b = rng.sample(range(n), 2)
        if b not in near[a] and len(near[a]) < 3 and len(near[b]) < 3:
            near[a][b] = near[b][a] = 1.5
    atoms = []
    for a in range(n):
        symbol = rng.choice("CCCCCNNO") if len(near[a]) == 2 else "C"
        atoms.append(forms.Atom(symbol, True, "", 0, int(symbol == "C" and len(near[a]) == 2 or symbol == "N" and rng.random() < 0.4), ""))
    own = forms.Molecule(atoms, near)
    found = forms.double_bonds(own)
    all_ = every_matching(own)
    assert (found is None) == (not all_)
    if found is not None:
        assert tuple(sorted((a, b) for a, b in found if a < b)) in {tuple(sorted(m)) for m in all_}


def test_kekule_form():
    assert PLUG.kekulized("CCO") is None and PLUG.kekulized("c1cccc1") is None and PLUG.kekulized("C1=CC=CC=C1") is None
    for text in MOLECULES:
        made = PLUG.kekulized(text)
        if made is not None:
            assert not any(a.aromatic for a in forms.molecule(made).atoms)
            assert PLUG.kekulized(PLUG.other_toolkit(text)) == made
    assert forms.molecule(PLUG.kekulized("n1cc[nH]c1")).atoms.count(forms.Atom("N", False, "", 0, 1, "")) == 1


def test_what_has_no_form():
    for text in ("", "CN(=O)=O", "C(C)(C)(C)(C)C", "FF(F)", "c1cccc1", "cc", "C[nH]C", "C(", "n1(C)ccccc1"):
        assert PLUG.canonical(text) is None and PLUG.randomized(text, 2, 0) == []
    assert PLUG.canonical("N[C@H](C)O") == "N[C@H](C)O" and PLUG.kekulized("C/C=C/c1ccccc1") is None
    assert PLUG.without_dative("N->[Zn]<-O") == PLUG.canonical("N-[Zn]-O") is not None
    assert PLUG.explicit_hydrogens("C[NH3+]") in ("[CH3][NH3+]", "[NH3+][CH3]")


def test_duplicates_of_spelling_fall_together(spark):
    rows = spark.createDataFrame([(1, "OCC"), (2, "CCO"), (3, "c1ccccc1O"), (4, "Oc1ccccc1"), (5, "C(C"), (6, None)], "id int, t string")
    kept, seen = chemistry.canonicalize(rows, "t")
    groups = {}
    for r in kept.collect():
        groups.setdefault(r["t"], []).append(r["id"])
    assert sorted(groups.values()) == [[1, 2], [3, 4]] and seen.get == {"n_input": 6, "n_rejected": 2}


def test_long_chains():
    own = forms.molecule("C" * 3000 + "O")
    assert len(forms.spelt(own, list(range(3001)))) == 3001


@pytest.mark.parametrize("name", ["sound", "spelt"])
def test_molecules_stay_dealt_out_within_a_query(spark, tmp_path, name):
    """Also where more follows: after a ``distinct`` by the same column Spark drops the dealing out, and adaptive execution gives all to one task."""
    from pyspark.sql import functions as F

    from lexforge.plans import molecule_queries

    made = [f"ab{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    spark.createDataFrame([(i, t) for i, t in enumerate(made)], "client_id long, name string").write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame([(0, " ".join(made), "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = getattr(molecule_queries, name)(spark, str(tmp_path))
    assert found.select("t").distinct().count() == found.count()
    tasks = found.select(F.spark_partition_id().alias("task")).groupBy("task").count().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_rewrites_that_are_asked_for_are_made(spark):
    class Refusing(forms.MoleculeForms):
        def kekulized(self, text):
            raise AssertionError("a rewrite that wasn't asked for")

    plug = Refusing()
    rows = spark.createDataFrame([(1, "OCC"), (2, "c1ccccc1O"), (3, "C(C"), (4, None)], "id int, t string")
    asked = ("canonical", "other_toolkit", "random")
    found = {(r["id"], r["axis"], r["text"]) for r in chemistry.orbit(rows, "id", "t", k_random=2, plug=plug, axes=asked).collect()}
    whole = {(r["id"], r["axis"], r["text"]) for r in chemistry.orbit(rows, "id", "t", k_random=2).collect()}
    assert found == {r for r in whole if r[1] in asked} and {r[1] for r in found} == set(asked)
    drawn = {(r["id"], r["axis"]) for r in chemistry.orbit(rows, "id", "t", plug=plug, axes=["random"]).collect()}
    assert drawn == {(1, "random"), (2, "random")}


def by_whole_rounds(own, classes):
    """Classes refined with every atom looked at in every round."""
    while True:
        keys = [(c, sorted((order, classes[b]) for b, order in own.bonds[a].items())) for a, c in enumerate(classes)]
        out = [sorted(set(map(str, keys)), key=lambda k: next(x for x in keys if str(x) == k)).index(str(k)) for k in keys]
        if len(set(out)) == len(set(classes)):
            return out
        classes = out


@pytest.mark.parametrize("text", [*MOLECULES, "C1CC2C1C1CC21", "C1CCC1.C1CCC1.C1CC1"])
def test_classes_equal_those_of_whole_rounds(text):
    own = forms.molecule(text)
    first = sorted(set(own.atoms))
    whole = by_whole_rounds(own, [first.index(a) for a in own.atoms])
    classes = forms._Classes.start(own)
    assert classes.of == [sum(x < c for x in whole) for c in whole]
    for a in (a for a, c in enumerate(classes.of) if len(classes.members[c]) > 1):
        apart = by_whole_rounds(own, [2 * c + (b != a and c == whole[a]) for b, c in enumerate(whole)])
        found = classes.apart(a)
        assert found.of == [sum(x < c for x in apart) for c in apart]
        assert all(found.members[c] == [b for b, x in enumerate(found.of) if x == c] for c in set(found.of))


@pytest.mark.parametrize("seed", range(40))
def test_bonds_in_no_ring(seed):
    """By the bonds that close rings, against a depth-first search."""
    rng = random.Random(seed)
    n = rng.randrange(3, 20)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(6))}
    labels = {p: f"%{k + 10}" for k, p in enumerate(sorted(p for p in pairs if p[1] - p[0] > 1))}
    branch = [rng.random() < 0.3 for _ in range(n)]
    text, depth = "", 0
    for i in range(n):
        text += "C" + "".join(labels[p] for p in sorted(labels) if i in p)
        if branch[i] and i < n - 1:
            text, depth = text + "(", depth + 1
        elif depth and rng.random() < 0.4 and i < n - 1:
            text, depth = text + ")", depth - 1
    text += ")" * depth
    if (found := forms.read(forms._PARTS.findall(text))) is None:  # a label between atoms that are bonded already
        return
    atoms, bonds, parents = found
    near = [{} for _ in atoms]
    for a, b, _ in bonds:
        near[a][b] = near[b][a] = 1
    rings = forms.in_rings(near)
    assert forms._bridges(bonds, parents) == [p < 0 or (p, a) not in rings for a, p in enumerate(parents)]


def test_a_label_that_joins_two_parts_closes_no_ring():
    assert forms.molecule("c1ccccc1-2.c3-2cccc3") is None  # four carbons and one that needs a double bond
    joined = forms.molecule("c12ccccc1.c1ccccc12")
    assert joined.bonds[0] == {1: 1.5, 5: 1.5, 11: 1} and PLUG.canonical("c12ccccc1.c1ccccc12") == PLUG.canonical("c1ccccc1-c1ccccc1")


def test_ends_and_rings_far_apart_are_told_quickly():
    """Many mirror images, each of which needs no whole ranking of its own."""
    text = "C" + "C(C)(C)c1ccc(cc1)" * 150 + "O"
    own = forms.molecule(text)
    found = forms.ranked(own)
    assert sorted(found) == list(range(len(own.atoms)))
    again = shuffled(own, 1)
    assert forms.spelt(again, forms.ranked(again)) == forms.spelt(own, found)
