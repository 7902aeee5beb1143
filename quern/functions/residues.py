"""Residue properties, pair distances and codon usage as lookups in column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of each residue and of X (unknown): hydropathy, weight, charge, polarity class, volume,
#: aromatic, self-score, helix, sheet and turn propensity, accessibility, codons, mean and largest codon usage.
PROPERTIES = ("hydro", "mw", "charge", "polar", "vol", "arom", "blosum", "alpha", "beta", "turn", "rsa", "degeneracy", "rscu_mean", "rscu_max")
_TABLE = """
A 1.8 89.09 0 0 31 0 4 1.42 0.83 0.66 0.25 4 0.25 0.40
C 2.5 121.16 0 1 55 0 9 0.70 1.19 1.19 0.22 2 1 1.55
D -3.5 133.10 -1 2 54 0 6 1.01 0.54 1.46 0.62 2 1 1.54
E -3.5 147.13 -1 2 83 0 5 1.51 0.37 0.74 0.72 2 1 1.58
F 2.8 165.19 0 0 132 1 6 1.13 1.38 0.60 0.22 2 1 1.55
G -0.4 75.03 0 0 3 0 6 0.57 0.75 1.56 0.42 4 0.25 0.34
H -3.2 155.16 0 1 96 1 8 1.00 0.87 0.95 0.54 2 1 1.59
I 4.5 131.17 0 0 111 0 4 1.08 1.60 0.47 0.15 3 0.6666666666666666 1.46
K -3.9 146.19 1 2 119 0 5 1.16 0.74 1.01 0.87 2 1 1.57
L 3.8 131.17 0 0 111 0 4 1.21 1.30 0.59 0.18 6 0.3333333333333333 1.40
M 1.9 149.21 0 0 105 0 5 1.45 1.05 0.60 0.30 1 1 1
N -3.5 132.12 0 1 56 0 6 0.67 0.89 1.56 0.63 2 1 1.54
P -1.6 115.13 0 0 32 0 7 0.57 0.55 1.52 0.53 4 0.2475 0.33
Q -3.5 146.15 0 1 85 0 5 1.11 1.10 0.98 0.69 2 1 1.75
R -4.5 174.20 1 2 124 0 5 0.98 0.93 0.95 0.84 6 0.16666666666666666 0.21
S -0.8 105.09 0 1 32 0 4 0.77 0.75 1.43 0.56 6 0.16666666666666666 0.27
T -0.7 119.12 0 1 61 0 5 0.83 1.19 0.96 0.46 4 0.25 0.36
V 4.2 117.15 0 0 84 0 4 1.06 1.70 0.50 0.16 4 0.5 1.47
W -0.9 204.23 0 0 170 1 11 1.08 1.37 0.96 0.29 1 1 1
Y -1.3 181.19 0 1 136 1 7 0.69 1.47 1.14 0.42 2 1 1.57
X 0.0 111.0 0 0 60 0 -1 1.00 1.00 1.00 0.50 0 1 1
"""
#: Chemical distances (R. Grantham, 1974) of each residue to those behind it in this order.
_ORDER = "ARNDCQEGHILKMFPSTWYV"
_DISTANCES = """
A 112 111 126 195 91 107 60 86 94 96 106 84 113 27 99 58 148 112 64
R 86 96 180 43 54 125 29 97 102 26 91 97 103 110 71 101 77 96
N 23 139 46 42 80 68 149 153 94 142 158 91 46 65 174 143 133
D 154 61 45 94 81 168 172 101 160 177 108 65 85 181 160 152
C 154 170 159 174 198 198 202 196 205 169 112 149 215 194 192
Q 29 87 24 109 113 53 101 116 76 68 42 130 99 96
E 98 40 134 138 56 126 140 93 80 65 152 122 121
G 98 135 138 127 127 153 42 56 59 184 147 109
H 94 99 32 87 100 77 89 47 115 83 84
I 5 102 10 21 95 142 89 61 33 29
L 107 15 22 98 145 92 61 36 32
K 95 102 103 121 78 110 85 97
M 28 87 135 81 67 36 21
F 114 155 103 40 22 50
P 74 38 147 110 68
S 58 177 144 124
T 128 92 69
W 37 88
Y 55
"""
UNKNOWN_DISTANCE = 100.0


@cache
def property_table() -> dict[str, dict[str, float]]:
    rows = (line.split() for line in _TABLE.strip().splitlines())
    return {r[0]: dict(zip(PROPERTIES, map(float, r[1:]), strict=True)) for r in rows}


@cache
def distance_table() -> dict[str, float]:
    """Distance of each ordered pair of known residues, both letters as key."""
    out = {a + a: 0.0 for a in _ORDER}
    for line in _DISTANCES.strip().splitlines():
        a, *values = line.split()
        for b, d in zip(_ORDER[_ORDER.index(a) + 1 :], values, strict=True):
            out[a + b] = out[b + a] = float(d)
    return out


@cache
def _by_letter(name: str) -> tuple[float, ...]:
    """A property of A to Z; of letters that are no residue, X's."""
    table = property_table()
    return tuple(table.get(chr(65 + i), table["X"])[name] for i in range(26))


def _place(residue: Column) -> Column:
    return F.ascii(residue) - 65


def letter(residue: Column) -> Column:
    """A residue's upper-case letter; X for null and for what has no properties."""
    up = F.upper(F.substring(residue, 1, 1))
    return F.when(up.isin(*property_table()), up).otherwise(F.lit("X"))


def nucleotide(base: Column) -> Column:
    up = F.upper(F.substring(base, 1, 1))
    return F.when(up.isin("A", "C", "G", "T"), up).otherwise(F.lit("N"))


def prop(residue: Column, name: str) -> Column:
    """A property of a letter from letter(): an array's element at the letter's place, no search."""
    return F.get(F.array(*map(F.lit, _by_letter(name))), _place(residue))


def distance(a: Column, b: Column) -> Column:
    """Chemical distance, 0 for equal letters, 100 if either is unknown."""
    table = distance_table()
    pairs = F.array(*(F.lit(table.get(chr(65 + i) + chr(65 + j), UNKNOWN_DISTANCE)) for i in range(26) for j in range(26)))
    return F.when(a == b, F.lit(0.0)).otherwise(F.coalesce(F.get(pairs, _place(a) * 26 + _place(b)), F.lit(UNKNOWN_DISTANCE)))
