"""Queries over molecular graphs, with SQL that parses them in another way: step by step, one recursive query for all.

The driver's tables hold no molecules. So each distinct word of all documents is
spelt with fragments of notations, letter by letter, and every second and third
one is closed to a ring whose bond sign stands at either end; besides, there are the
spellings of ``lexing_queries``, most of which aren't molecules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexforge.functions import chemistry, lexing
from lexforge.operators import emission, forms, molecules
from lexforge.plans.catalog import _WORDS, dealt, query, rounded, words
from lexforge.plans.lexing_queries import _INSIDE, NOTATIONS, glyph_list, notations

FRAGMENTS = dict(zip("abcdefghijklmnopqrstuvwxyz", (
    "C", "C(=O)", "CC=N", "N", "O", "C(C#N)", "S(=O)(=O)", "c2ccncc2", "C", "P(=O)(O)", "[N+](=O)[O-]", "C=S", "N=", "N", "C", "OC=O", "[13CH2]", "C(=N)",
    "CC", "C", "C%12CC%12", "N(O)=N", "[nH]", "Cl.C", "SS=", "n2cccc2",
)))
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in FRAGMENTS.items()) + "}"
_BODY = f"array_to_string(list_transform(regexp_extract_all(lower(piece), '[a-z]'), lambda x: ({_MAP})[x]), '')"
MOLECULES = f"SELECT DISTINCT CASE length(piece) % 3 WHEN 0 THEN {_BODY} WHEN 1 THEN 'C=1' || {_BODY} || 'N1' ELSE 'N1' || {_BODY} || 'CC=1' END AS t FROM ({_WORDS}) UNION {NOTATIONS}"


def spelt(spark, sf_dir) -> DataFrame:
    """(t) of the distinct molecules and other notations."""
    fragment = F.create_map(*(F.lit(x) for pair in FRAGMENTS.items() for x in pair))
    body = F.array_join(F.transform(F.regexp_extract_all(F.lower("piece"), F.lit("[a-z]"), F.lit(0)), lambda x: fragment[x]), "")
    by = F.length("piece") % 3
    made = words(spark, sf_dir).select("piece").distinct().select(F.when(by == 0, body).when(by == 1, F.concat(F.lit("C=1"), body, F.lit("N1"))).otherwise(F.concat(F.lit("N1"), body, F.lit("CC=1"))).alias("t"))
    return dealt(made.union(notations(spark, sf_dir)), "t").distinct()


_BRACKET = molecules.BRACKET.replace("'", "''")
_ATOMS = "', '".join(sorted(molecules.BARE))

# signs as a list; each text's tokens, how many glyphs they have, and where these begin
GRAPHS = rf"""RECURSIVE s AS (SELECT t, regexp_extract_all(t, '\[[^\]]*\]|%[0-9][0-9]|Cl|Br|.') AS x FROM ({MOLECULES})),
    k AS (SELECT t, x, list_transform(x, lambda c: CASE WHEN c[1] = '[' THEN len({glyph_list('c')}) WHEN c[1] = '%' THEN length(c) ELSE 1 END) AS many FROM s WHERE len(x) > 0),
    run AS (
        SELECT t, x, 0 AS i, 0 AS atoms, NULL::INT AS last, NULL::VARCHAR AS sign, []::INT[] AS stack, []::STRUCT(label INT, atom INT, sign VARCHAR)[] AS rings, NULL::INT AS a, NULL::INT AS b, NULL::VARCHAR AS bond, false AS bad FROM k
        UNION ALL
        SELECT t, x, i + 1, CASE WHEN is_atom THEN atoms + 1 ELSE atoms END,
            CASE WHEN is_atom THEN atoms WHEN c = ')' THEN stack[len(stack)] WHEN c = '.' THEN NULL ELSE last END,
            CASE WHEN is_sign THEN c WHEN is_atom OR ring IS NOT NULL THEN NULL ELSE sign END,
            CASE WHEN c = '(' THEN list_append(stack, last) WHEN c = ')' THEN stack[1:len(stack) - 1] ELSE stack END,
            CASE WHEN ring IS NULL THEN rings WHEN open_ IS NULL THEN list_append(rings, {{'label': ring, 'atom': last, 'sign': sign}}) ELSE list_filter(rings, lambda r: r.label <> ring) END,
            CASE WHEN is_atom THEN last WHEN open_ IS NOT NULL THEN open_.atom END, CASE WHEN is_atom THEN atoms WHEN open_ IS NOT NULL THEN last END,
            CASE WHEN is_atom AND last IS NOT NULL THEN sign WHEN open_ IS NOT NULL THEN coalesce(sign, open_.sign) END,
            CASE WHEN is_atom THEN last IS NULL AND sign IS NOT NULL WHEN is_sign THEN sign IS NOT NULL
                WHEN ring IS NOT NULL THEN last IS NULL OR (open_ IS NOT NULL AND (open_.atom = last OR coalesce(sign <> open_.sign, false)))
                WHEN c = '(' THEN sign IS NOT NULL OR last IS NULL WHEN c = ')' THEN sign IS NOT NULL OR last IS NULL OR len(stack) = 0 OR x[i] = '('
                WHEN c = '.' THEN sign IS NOT NULL OR last IS NULL OR len(stack) > 0 ELSE true END
        FROM (SELECT *, list_filter(rings, lambda r: r.label = ring)[1] AS open_ FROM (SELECT *, x[i + 1] AS c, (x[i + 1] IN ('{_ATOMS}') OR regexp_full_match(x[i + 1], '{_BRACKET}')) AS is_atom,
            x[i + 1] IN ('-', '=', '#', '$', ':', '/', '\') AS is_sign, CASE WHEN regexp_full_match(x[i + 1], '[0-9]|%[0-9][0-9]') THEN ltrim(x[i + 1], '%')::INT END AS ring FROM run WHERE NOT bad AND i < len(x)))
    ), f AS (
        SELECT t FROM run GROUP BY t HAVING NOT bool_or(bad) AND bool_or(i = len(x) AND last IS NOT NULL AND sign IS NULL AND len(stack) = 0 AND len(rings) = 0)
            AND count(b) FILTER (a IS NOT NULL) = count(DISTINCT least(a, b) * 100000 + greatest(a, b)) FILTER (a IS NOT NULL)
    ), atom AS (
        SELECT k.t, r.atoms - 1 AS atom, CASE WHEN c[1] = '[' THEN regexp_extract(c, '{_BRACKET}', 2) ELSE c END AS symbol, c AS label,
            coalesce(list_sum(many[1:r.i - 1]), 0)::INT AS low, list_sum(many[1:r.i])::INT AS high
        FROM (SELECT *, x[i] AS c, atoms - lag(atoms) OVER (PARTITION BY t ORDER BY i) AS more FROM run) r JOIN k USING (t) JOIN f USING (t) WHERE more = 1
    ), h AS (
        SELECT t FROM atom GROUP BY t HAVING count(*) > 1 AND count(*) FILTER (symbol = 'H') > 0
    ), whole AS (SELECT t FROM f ANTI JOIN h USING (t)), bonds AS (SELECT t, a, b, bond FROM run JOIN whole USING (t) WHERE a IS NOT NULL AND b IS NOT NULL)"""
def graphs(source: str) -> str:
    """SQL: the graphs of the texts t of a query."""
    return GRAPHS.replace(MOLECULES, source)


_FUNCTIONAL = rf"""WITH {GRAPHS}, ends AS (SELECT t, a AS atom FROM bonds UNION ALL SELECT t, b FROM bonds), degree AS (SELECT t, atom, count(*) AS n FROM ends GROUP BY t, atom),
    g AS (SELECT t, flatten(list_transform(x, lambda c: CASE WHEN c[1] = '[' THEN {glyph_list('c')} WHEN c[1] = '%' THEN string_split(c, '') ELSE [c] END)) AS g FROM k),
    p AS (SELECT t, bond, CASE WHEN upper(x.symbol) = 'C' THEN false WHEN upper(y.symbol) = 'C' THEN true ELSE dx.n <= dy.n END AS first, x.symbol AS sx, x.low AS lx, x.high AS hx, y.symbol AS sy, y.low AS ly, y.high AS hy
        FROM bonds JOIN atom x USING (t) JOIN atom y USING (t) JOIN degree dx USING (t) JOIN degree dy USING (t)
        WHERE x.atom = a AND y.atom = b AND dx.atom = a AND dy.atom = b AND bond IN ('=', '#') AND NOT (upper(x.symbol) = 'C' AND upper(y.symbol) = 'C')),
    q AS (SELECT t, bond, upper(CASE WHEN first THEN sy ELSE sx END) || bond || upper(CASE WHEN first THEN sx ELSE sy END) AS label, CASE WHEN first THEN lx ELSE ly END AS low, CASE WHEN first THEN hx ELSE hy END AS high FROM p),
    e AS (SELECT t, CASE WHEN label IN ('C=O', 'C=N', 'C=S', 'N=O', 'S=O', 'P=O', 'C#N') THEN label ELSE 'other' END AS label, CASE WHEN low > 0 AND g[low] = bond THEN low WHEN high < len(g) AND g[high + 1] = bond THEN high END AS position FROM q JOIN g USING (t)),
    b AS (SELECT * FROM e WHERE position IS NOT NULL)"""


def _thirds(n):
    """Cuts at every third place."""
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i % 3 == 0)


@query(f"{_FUNCTIONAL} SELECT t, label, position::INT AS position, position % 3 <> 0 AS local FROM b")
def functional_bonds(spark, sf_dir):
    """Functional bonds of every spelling, with cuts at every third place."""
    rows = spelt(spark, sf_dir).withColumn("g", lexing.glyphs(F.col("t")))
    found = rows.select("t", emission.functional_bonds(F.col("g")).alias("b"), _thirds(F.size("g")).alias("cuts"))
    return found.select("t", F.explode(F.arrays_zip("b", emission.locality_of(F.col("b"), F.col("cuts")).alias("l"))).alias("x")).select("t", "x.b.label", "x.b.position", "x.l.local")


@query(f"{_FUNCTIONAL} SELECT substr(t, 1, 1) AS first, count(*) AS n_bonds, round(avg((position % 3 <> 0)::INT), 6) AS locality, {', '.join(f'''round(avg((position % 3 <> 0)::INT) FILTER (label = '{c}'), 6) AS "{c}"''' for c in molecules.BOND_CLASSES)} FROM b GROUP BY 1")
def bond_locality(spark, sf_dir):
    rows = spelt(spark, sf_dir).withColumn("g", lexing.glyphs(F.col("t")))
    units = rows.select(F.substring("t", 1, 1).alias("first"), emission.locality_of(emission.functional_bonds(F.col("g")), _thirds(F.size("g"))).alias("bonds"))
    return rounded(emission.locality(units, ["first"]), "locality", *molecules.BOND_CLASSES)


@query(f"WITH {GRAPHS} SELECT t, count(*) AS n_atoms, (SELECT count(*) FROM bonds b WHERE b.t = a.t) AS n_bonds, string_agg(label, ' ' ORDER BY atom) AS atoms FROM atom a JOIN whole USING (t) GROUP BY t")
def molecule_graphs(spark, sf_dir):
    """Atoms and bonds of every spelling that is a molecule."""
    rows = spelt(spark, sf_dir).withColumn("m", molecules.graph(lexing.glyphs(F.col("t")))).where("m is not null")
    return rows.select("t", F.size("m.atoms").cast("long").alias("n_atoms"), F.size("m.bonds").cast("long").alias("n_bonds"), F.array_join("m.atoms.label", " ").alias("atoms"))


@query(f"WITH {GRAPHS} SELECT count(*) AS n, count(w.t) AS n_parsed FROM s LEFT JOIN whole w USING (t)")
def molecules_dropped(spark, sf_dir):
    """How many spellings there are, and how many are molecules; the others take no part in measures of bonds."""
    rows = spelt(spark, sf_dir).select(molecules.graph(lexing.glyphs(F.col("t"))).alias("m"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("n_parsed"))


#: Fragments of which any sequence after a carbon is a molecule, within valences.
SOUND = dict(zip("abcdefghijklmnopqrstuvwxyz", (
    "C", "C(=O)", "O", "N", "CC", "S(=O)(=O)", "C(C)(C)", "c2ccc(cc2)", "C(F)", "C(=S)", "C(C#N)", "C3CC(CC3)", "C(=NO)", "N", "O", "P(=O)(O)", "C=C", "C(Cl)",
    "S", "CC", "C4CC4", "n2c(ccc2)", "N(C)", "[15NH]", "c2cc3ccccc3cc2", "C(Br)",
)))
_SOUND_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SOUND.items()) + "}"
SOUND_MOLECULES = f"SELECT DISTINCT CASE WHEN length(name) % 2 = 1 THEN 'C1' || b || 'CC1' ELSE 'C' || b END AS t FROM (SELECT coalesce(name, '') AS name, array_to_string(list_transform(regexp_extract_all(lower(coalesce(name, '')), '[a-z]'), lambda x: ({_SOUND_MAP})[x]), '') AS b FROM clients)"
# what a rewrite keeps of a graph: atoms by element, degree and the elements beside them
_KEPT = f"""WITH {graphs(SOUND_MOLECULES)}, ends AS (SELECT t, a AS atom, b AS other FROM bonds UNION ALL SELECT t, b, a FROM bonds),
    named AS (SELECT a.t, a.atom, upper(a.symbol) AS symbol, string_agg(upper(o.symbol), '' ORDER BY upper(o.symbol)) AS beside FROM atom a LEFT JOIN ends e ON e.t = a.t AND e.atom = a.atom LEFT JOIN atom o ON o.t = e.t AND o.atom = e.other GROUP BY ALL),
    kept AS (SELECT t, string_agg(symbol || '(' || coalesce(beside, '') || ')', ' ' ORDER BY symbol || '(' || coalesce(beside, '') || ')') AS graph, (SELECT count(*) FROM bonds b WHERE b.t = n.t) AS n_bonds FROM named n GROUP BY t)"""


def sound(spark, sf_dir) -> DataFrame:
    """(t) of the molecules that clients' names spell."""
    fragment = F.create_map(*(F.lit(x) for pair in SOUND.items() for x in pair))
    names = spark.read.parquet(f"{sf_dir}/clients.parquet").select(F.coalesce("name", F.lit("")).alias("name")).distinct()
    body = F.array_join(F.transform(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]"), F.lit(0)), lambda x: fragment[x]), "")
    return dealt(names.select(F.when(F.length("name") % 2 == 1, F.concat(F.lit("C1"), body, F.lit("CC1"))).otherwise(F.concat(F.lit("C"), body)).alias("t")), "t").distinct()


def _kept(m):
    """A graph's atoms by element with the elements beside them, in order."""
    atoms, bonds = m["atoms"], m["bonds"]
    name = lambda i: F.upper(F.get(atoms, i)["symbol"])

    def one(i):
        beside = F.transform(F.filter(bonds, lambda b: (b["a"] == i) | (b["b"] == i)), lambda b: name(F.when(b["a"] == i, b["b"]).otherwise(b["a"])))
        return F.concat(name(i), F.lit("("), F.array_join(F.array_sort(beside), ""), F.lit(")"))

    return F.array_join(F.array_sort(F.transform(F.sequence(F.lit(0), F.size(atoms) - 1), one)), " ")


@query(
    f"""{_KEPT}, axes AS (SELECT unnest(['canonical', 'explicit_hydrogens', 'other_toolkit', 'random', 'random']) AS axis)
    SELECT t AS id, axis, graph, n_bonds FROM kept CROSS JOIN axes UNION ALL SELECT t, 'kekulized', graph, n_bonds FROM kept WHERE regexp_matches(t, '[cn][0-9]')
    UNION ALL SELECT t, 'rings', graph, n_bonds FROM kept WHERE regexp_matches(regexp_replace(t, '\\[[^\\]]*\\]', '', 'g'), '[0-9]')"""
)
def rewrite_orbit(spark, sf_dir):
    """Every molecule in all its rewrites, parsed again: each has the graph of the original."""
    orbit = chemistry.orbit(sound(spark, sf_dir), "t", "t", k_random=2, plug=forms.MoleculeForms())
    again = orbit.select("id", "axis", molecules.graph(lexing.glyphs(F.col("text"))).alias("m"))
    return again.select("id", "axis", _kept(F.col("m")).alias("graph"), F.size("m.bonds").cast("long").alias("n_bonds"))


@query(f"WITH {graphs(SOUND_MOLECULES)} SELECT t AS id, 1::BIGINT AS n_canonical, 6::BIGINT AS n_spellings FROM whole")
def canonical_forms(spark, sf_dir):
    """Canonical forms of a molecule's spelling, other canonical form, written hydrogens and three random orders: one for all."""
    plug = forms.MoleculeForms()
    named = chemistry.orbit(sound(spark, sf_dir), "t", "t", k_random=3, plug=plug, axes=("canonical", "explicit_hydrogens", "other_toolkit", "random"))
    kept, _ = chemistry.canonicalize(named, "text", plug)
    return kept.groupBy("id").agg(F.count_distinct("text").alias("n_canonical"), F.count(F.lit(1)).alias("n_spellings"))


@query(f"{_FUNCTIONAL}, u AS (SELECT substr(t, 1, 1) AS first, avg((position % 3 <> 0)::INT) AS x, avg((position % 2 <> 0)::INT) AS y FROM b GROUP BY 1) SELECT first, round(x, 6) AS locality_a, round(y, 6) AS locality_b, round(y - x, 6) AS delta_locality FROM u")
def locality_pair(spark, sf_dir):
    """Two arms that cut at every third and at every second place, beside each other."""
    rows = spelt(spark, sf_dir).withColumn("g", lexing.glyphs(F.col("t"))).select(F.substring("t", 1, 1).alias("first"), F.size("g").alias("n"), emission.functional_bonds(F.col("g")).alias("b"))
    every = lambda k: F.filter(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: i % k == 0)
    both = rows.select("first", F.explode(F.array(*(F.struct(F.lit(arm).alias("arm"), emission.locality_of(F.col("b"), every(k)).alias("bonds")) for arm, k in (("a", 3), ("b", 2))))).alias("x")).select("first", "x.arm", "x.bonds")
    return rounded(emission.arms_beside(emission.locality(both, ["first", "arm"]), "arm", ["first"], ["locality"]), "locality_a", "locality_b", "delta_locality")
