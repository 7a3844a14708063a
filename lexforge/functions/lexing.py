"""Glyphs and chunks of line notations, as Column functions.

A string is first cut into chunks: a bracketed group, a two-digit ring label, a
delimiter, a digit, or a run of anything else. A chunk is then cut into glyphs.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lexforge.functions.arrays import let, starts

# Fixed value: a chunk; the last alternative keeps a stray bracket or percent sign.
CHUNK = r"(\[[^\]]*\]|%\d{2}|[.()/\\]|\d|[^\[%.()/\\\d]+|.)"

# The glyph alphabet, by role.
ORGANIC = "B C N O P S F Cl Br I".split()
AROMATIC = "b c n o p s se as".split()
ELEMENTS = (
    "Ac Ag Al Am Ar As At Au Ba Be Bh Bi Bk Ca Cd Ce Cf Cm Cn Co Cr Cs Cu Db Ds Dy Er Es Eu Fe Fl Fm Fr Ga Gd Ge H He Hf Hg Ho Hs In Ir K Kr La Li Lr Lu Lv Mc Md Mg Mn Mo Mt"
    " Na Nb Nd Ne Nh Ni No Np Og Os Pa Pb Pd Pm Po Pr Pt Pu Ra Rb Re Rf Rg Rh Rn Ru Sb Sc Se Sg Si Sm Sn Sr Ta Tb Tc Te Th Ti Tl Tm Ts U V W Xe Y Yb Zn Zr"
).split()
BONDS = ["-", "=", "#", "$", ":", "/", "\\"]
STRUCTURE = ["(", ")", "[", "]", ".", "%", *"0123456789"]
CHARGES = ["+", "*"]
CHIRALITY = ["@", "@@", "@TH", "@AL", "@OH", "@SP", "@TB"]
SPECIALS = ["[UNK]", "[BOS]", "[EOS]", "[SEP]", "[PAD]", "[CLS]", "[MASK]"]
GLYPHS = frozenset([*ORGANIC, *AROMATIC, *ELEMENTS, *BONDS, *STRUCTURE, *CHARGES, *CHIRALITY])

_IN_BRACKET = "|".join(sorted((x.replace("\\", "\\\\").replace("$", "\\$").replace("(", "\\(").replace(")", "\\)").replace("[", "\\[").replace("]", "\\]").replace(".", "\\.").replace("+", "\\+").replace("*", "\\*") for x in GLYPHS), key=lambda x: (-len(x), x)))
#: A whole string of glyphs: brackets hold any glyph, outside only single characters and Cl, Br.
_GLYPH_OUT = r"Cl|Br|[" + "".join(sorted(("\\" + g if g in "-[]\\^" else g) for g in GLYPHS if len(g) == 1 and g not in "[]")) + "]"
CONFORMANT = rf"^(?:\[(?:{_IN_BRACKET})*\]|{_GLYPH_OUT})*$"


def glyph_fingerprint() -> str:
    """BLAKE2b-128 of the sorted alphabet, one a line."""
    return hashlib.blake2b("\n".join(sorted(GLYPHS)).encode(), digest_size=16).hexdigest()


def normalize(text: Column) -> Column:
    """Double charges as a number, and no outer white space of any kind."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("++"), F.lit("+2")), F.lit("--"), F.lit("-2")), r"^\s+|\s+$", "")


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; together they are the text (line ends aside, which no chunk but a run holds)."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(1))


def spans(parts: Column) -> Column:
    """Each part with where it starts and ends: array of (chunk, start, end)."""
    at = starts(F.transform(parts, lambda x: F.length(x)))
    return F.zip_with(parts, at, lambda x, i: F.struct(x.alias("chunk"), i.alias("start"), (i + F.length(x)).alias("end")))


def bracket_glyphs(chunk: Column) -> Column:
    """The glyphs of a bracketed chunk: longest first, every digit its own; by character where the alphabet doesn't cover it."""
    found = F.regexp_extract_all(chunk, F.lit(f"({_IN_BRACKET})"), F.lit(1))
    return F.when(F.array_join(found, "") == chunk, found).otherwise(F.filter(F.split(chunk, ""), lambda x: x != ""))


def organic_glyphs(chunk: Column) -> Column:
    """The glyphs of a chunk outside brackets: Cl and Br whole, else single characters."""
    return F.regexp_extract_all(chunk, F.lit(r"(?s)(Cl|Br|.)"), F.lit(1))


_BRACKETED = re.compile(r"\[[^\n\r\x85\u2028\u2029]*\]")
_INSIDE, _OUTSIDE = re.compile(_IN_BRACKET), re.compile("Cl|Br|.", re.DOTALL)


def chunk_glyphs(chunk: str) -> list[str]:
    """The glyphs of one chunk, as :func:`glyphs` has them, where Python has the chunk anyway."""
    if _BRACKETED.fullmatch(chunk):
        found = _INSIDE.findall(chunk)
        return found if "".join(found) == chunk else list(chunk)
    return _OUTSIDE.findall(chunk)


def glyphs(text: Column) -> Column:
    """All glyphs of a text, in order."""
    return F.flatten(F.transform(chunks(text), lambda c: F.when(c.rlike(r"^\[.*\]$"), bracket_glyphs(c)).otherwise(organic_glyphs(c))))


def segment(text: Column) -> Column:
    """The glyphs of a conformant text by bracket-aware longest match; null for any other."""
    return F.when(conformant(text), glyphs(text))


def conformant(text: Column) -> Column:
    """Whether a text is a string of glyphs."""
    return F.coalesce(text.rlike(CONFORMANT), F.lit(False))


#: What a text that no toolkit reads as a structure is reported as.
UNPARSEABLE = "rdkit-unparseable"


def balanced(text: Column) -> Column:
    """Whether brackets and branches close in order, rings in pairs, and no sign is left over: what can be told of a notation without a toolkit."""
    kinds = F.regexp_replace(F.regexp_replace(text, r"\[[^\[\]()]+\]", "*"), r"[^()\[\]]", "")
    open_ = F.aggregate(F.split(kinds, ""), F.lit(0), lambda n, c: F.when((n < 0) | c.isin("[", "]"), -1).when(c == "(", n + 1).when(c == ")", n - 1).otherwise(n))
    return F.coalesce((open_ == 0) & ~text.rlike(r"^[)=#]|[(=#]$|\(\)|\[\]"), F.lit(False))


def offenders(text: Column, parses: Column | None = None) -> Column:
    """Why a text isn't conformant: aromatic-<symbol> for lower-case symbols outside the alphabet, ``other`` for the rest; sorted, distinct. One that doesn't parse is that alone.

    parses: whether a toolkit reads the text; without one, whether it is :func:`balanced`.
    """
    inside = F.regexp_extract_all(text, F.lit(r"\[\d*([a-z][a-z]?)"), F.lit(1))
    named = F.filter(F.transform(inside, lambda x: F.when(~x.isin(AROMATIC), F.concat(F.lit("aromatic-"), F.initcap(x)))), lambda x: x.isNotNull())
    reads = balanced(text) if parses is None else parses
    return F.when(~F.coalesce(reads, F.lit(False)), F.array(F.lit(UNPARSEABLE))).when(F.size(named) > 0, F.array_sort(F.array_distinct(named))).otherwise(F.array(F.lit("other")))


def atom_spans(parts: Column) -> Column:
    """From glyphs: the span (start, end) of each atom, a bracket atom being one; null if brackets don't balance."""
    atoms = [*ORGANIC, *[a for a in AROMATIC if len(a) == 1]]
    span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    def told(x: Column) -> Column:
        own, depth = x["glyphs"], x["depth"]  # depth before each glyph
        at = F.transform(own, lambda g, i: F.struct(g.alias("glyph"), i.alias("i")))
        of = lambda sign: F.transform(F.filter(at, lambda y: y["glyph"] == sign), lambda y: y["i"])
        bare = F.filter(F.zip_with(at, depth, lambda y, d: F.when((d == 0) & y["glyph"].isin(atoms), span(y["i"], y["i"] + 1))), lambda y: y.isNotNull())
        # where brackets balance, the n-th opens what the n-th closes
        groups = F.zip_with(of("["), of("]"), lambda start, end: span(start, end + 1))
        wrong = F.exists(F.zip_with(own, depth, lambda g, d: ((g == "[") & (d != 0)) | ((g == "]") & (d != 1))), lambda y: y)
        return F.when(~wrong & (F.size(of("[")) == F.size(of("]"))), F.array_sort(F.concat(bare, groups)))

    depth = starts(F.transform(parts, lambda g: F.when(g == "[", 1).when(g == "]", -1).otherwise(0)))
    return let(F.struct(parts.alias("glyphs"), depth.alias("depth")), told)


# Fixed values of both class ladders: the marks of brackets and structure, and which glyphs make a class.
def surface_class(token: Column) -> Column:
    """bracket_internal, structural or atomic, by the characters of a token; the empty token is structural."""
    return F.when(token.rlike(r"[\[\]]"), F.lit("bracket_internal")).when(token.rlike(r"^[()=#./\\:%@+\-0-9]*$"), F.lit("structural")).otherwise(F.lit("atomic"))


def piece_class(piece: Column, with_bracket: bool = True) -> Column:
    """bracket, aromatic, heteroatom, unsat-C or sat-C: the first that fits a glyph array. The composition table has no bracket class."""
    hetero = F.exists(piece, lambda g: g.rlike("^[A-Z]") & (g != "C"))
    ladder = F.when(F.arrays_overlap(piece, F.array(*map(F.lit, AROMATIC))), F.lit("aromatic")).when(hetero, F.lit("heteroatom")).when(F.arrays_overlap(piece, F.array(F.lit("="), F.lit("#"), F.lit("$"))), F.lit("unsat-C")).otherwise(F.lit("sat-C"))
    return F.when(F.array_contains(piece, "["), F.lit("bracket")).otherwise(ladder) if with_bracket else ladder


def surface(piece: Column) -> Column:
    """The glyphs of a piece, joined."""
    return F.array_join(piece, "")


def relabel_rings(text: Column) -> Column:
    """Ring digits outside brackets moved on by one (9 to 1); null with a percent label or without such digits."""
    parts = chunks(text)
    moved = F.transform(parts, lambda c: F.when(c.rlike("^[0-9]$"), (F.pmod(c.try_cast("int"), F.lit(9)) + 1).cast("string")).otherwise(c))
    return F.when(~text.contains("%") & F.exists(parts, lambda c: c.rlike("^[0-9]$")), F.array_join(moved, ""))


# The tokens of a notation as atoms are looked for, by kind; a bracket atom and a two-digit ring label are tokens too.
ATOM_TOKENS = "Br Cl B C N O S P F I b c n o s p *".split()
SIGN_TOKENS = ["(", ")", ".", "=", "#", "-", "+", "\\", "/", ":", "~", "@", "?", ">", "$", *"0123456789"]
_TOKEN = "|".join([r"\[[^\]]+\]", *[re.escape(t) for t in ATOM_TOKENS], r"%[0-9]{2}", *[re.escape(t) for t in SIGN_TOKENS]])


def atom_starts(text: Column) -> Column:
    """Where each atom's token starts, counted from 0, wildcards included; null for a text that isn't all tokens."""
    tokens = F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))
    placed = F.filter(spans(tokens), lambda t: t["chunk"].startswith("[") | t["chunk"].isin(ATOM_TOKENS))
    return F.when(F.array_join(tokens, "") == text, F.transform(placed, lambda t: t["start"]))


def piece_of(starts: Column, pieces: Column) -> Column:
    """For each of some ascending starts the number of the piece (struct with start and end) that holds it, or -1. Pieces are in order and don't overlap; both are merged by one sort."""

    def told(x: Column) -> Column:
        begun = F.transform(x["pieces"], lambda p: F.struct(p["start"].cast("int").alias("at"), F.lit(0).alias("kind")))
        both = F.array_sort(F.concat(begun, F.transform(x["starts"], lambda s: F.struct(s.cast("int").alias("at"), F.lit(1).alias("kind")))))
        own = F.filter(F.transform(both, lambda y, i: F.struct(y["at"].alias("at"), y["kind"].alias("kind"), i.alias("i"))), lambda y: y["kind"] == 1)
        # of the i rows before a start, j are starts: the last piece begun is number i - j - 1
        return F.transform(own, lambda y, j: F.when(F.coalesce(y["at"] < F.get(x["pieces"], y["i"] - j - 1)["end"], F.lit(False)), y["i"] - j - 1).otherwise(F.lit(-1)).cast("int"))

    return let(F.struct(starts.alias("starts"), pieces.alias("pieces")), told)


def proper_substrings(piece: Column, least: int = 2) -> Column:
    """All contiguous parts of a glyph array, from ``least`` glyphs to one less than all; empty where there are none."""
    n = F.size(piece)
    of = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.slice(piece, s, k))
    return F.when(n > least, F.flatten(F.transform(F.sequence(F.lit(least), n - 1), of))).otherwise(F.array().cast("array<array<string>>"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def longest_match(text: pd.Series) -> pd.Series:
    """Bracket-aware longest match, one character at a time: the check of :func:`segment`; null outside the alphabet."""

    def one(s: str | None) -> list[str] | None:
        found, at, inside = [], 0, False
        while s is not None and at < len(s):
            options = [s[at : at + n] for n in (3, 2, 1)]
            hit = next((g for g in options if g in GLYPHS and (inside or len(g) == 1 or g in ("Cl", "Br"))), None)
            if hit is None:
                return None
            inside = hit == "[" or (inside and hit != "]")
            found.append(hit)
            at += len(hit)
        return None if s is None else found

    return text.map(one)
