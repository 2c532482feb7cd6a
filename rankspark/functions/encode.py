"""Sequence encodings as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Five factors of each residue.
FACTORS = {
    "A": [-0.591, -1.302, -0.733, 1.57, -0.146],
    "C": [-1.343, 0.465, -0.862, -1.02, -0.255],
    "D": [1.05, 0.302, -3.656, -0.259, -3.242],
    "E": [1.357, -1.453, 1.477, 0.113, -0.837],
    "F": [-1.006, -0.59, 1.891, -0.397, 0.412],
    "G": [-0.384, 1.652, 1.33, 1.045, 2.064],
    "H": [0.336, -0.417, -1.673, -1.474, -0.078],
    "I": [-1.239, -0.547, 2.131, 0.393, 0.816],
    "K": [1.831, -0.561, 0.533, -0.277, 1.648],
    "L": [-1.019, -0.987, -1.505, 1.266, -0.912],
    "M": [-0.663, -1.524, 2.219, -1.005, 1.212],
    "N": [0.945, 0.828, 1.299, -0.169, 0.933],
    "P": [0.189, 2.081, -1.628, 0.421, -1.392],
    "Q": [0.931, -0.179, -3.005, -0.503, -1.853],
    "R": [1.538, -0.055, 1.502, 0.44, 2.897],
    "S": [-0.228, 1.399, -4.76, 0.67, -2.647],
    "T": [-0.032, 0.326, 2.213, 0.908, 1.313],
    "V": [-1.337, -0.279, -0.544, 1.242, -1.262],
    "W": [-0.595, 0.009, 0.672, -2.128, -0.184],
    "Y": [0.26, 0.83, 3.097, -0.838, 1.512],
}


def position_code(places: int, width: int = 5) -> list[list[float]]:
    """Sine on even and cosine on odd columns."""
    angle = lambda p, j: p / 10000 ** (2 * (j // 2) / width)
    return [[math.sin(angle(p, j)) if j % 2 == 0 else math.cos(angle(p, j)) for j in range(width)] for p in range(places)]


def encoded(sequence: str, length: int, positions: bool = True) -> Column:
    """``length`` x 5 numbers: factors, zeros for unknown residues and beyond the end.

    The position code is added to known residues only; an unknown residue takes up no position.
    """
    s = F.col(sequence)
    table = F.create_map(*[x for a, v in FACTORS.items() for x in (F.lit(a), F.array(*map(F.lit, v)))])
    code = F.array(*[F.array(*map(F.lit, row)) for row in position_code(length)])
    zeros = F.array_repeat(F.lit(0.0), 5)

    def row(i: Column) -> Column:
        known = F.element_at(table, F.substring(s, i, F.lit(1)))
        before = F.length(F.regexp_replace(F.substring(s, F.lit(1), i - 1), "[^" + "".join(FACTORS) + "]", ""))
        added = F.zip_with(known, F.element_at(code, before + 1), lambda x, y: x + y) if positions else known
        return F.coalesce(added, zeros)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(length)), row))
