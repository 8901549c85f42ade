"""Residue alphabet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue letter -> code. These must equal the reference's table
# for vectors to match. The twenty standard letters take 1..20 in this order,
# O and U follow as 21 and 22, and Z shares code 0 with the padding.
STANDARD_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
RESIDUE_CODES: dict[str, int] = {
    **{letter: i + 1 for i, letter in enumerate(STANDARD_RESIDUES)},
    "O": 21,
    "U": 22,
    "Z": 0,
}
PAD_CODE = 0
PEPTIDE_WIDTH = 11


def alphabet_map(codes: dict[str, int] | None = None) -> Column:
    """A literal MAP<STRING, INT>; 23 entries, so it travels inside the plan."""
    codes = RESIDUE_CODES if codes is None else codes
    kv = []
    for letter, code in codes.items():
        kv += [F.lit(letter), F.lit(int(code))]
    return F.create_map(*kv)
