"""Columns of bases: complement, translation, open pieces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES = "TCAG"
#: Fixed value: amino acids of the standard code, codons in the order of bases T, C, A, G.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def peptide(seq: Column) -> Column:
    """Amino acids of the codons of an upper-case sequence, X for codons with other letters, * for stops; a last part codon is left out."""
    codons = F.regexp_extract_all(seq, F.lit("(?s)..."), F.lit(0))

    def amino(codon: Column) -> Column:
        a, b, c = (F.call_function("instr", F.lit(_BASES), F.substring(codon, i, 1)) for i in (1, 2, 3))
        known = F.substring(F.lit(_AMINO), 16 * (a - 1) + 4 * (b - 1) + c, F.lit(1))
        return F.when(a * b * c > 0, known).otherwise("X")

    return F.array_join(F.transform(codons, amino), "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


_CODE = np.full(128, 4, dtype=np.uint8)
_CODE[[ord(c) for c in _BASES]] = range(4)
_OTHER_STRAND = np.array([2, 3, 0, 1, 4], dtype=np.uint8)
_LETTER = np.frombuffer(_AMINO.encode(), dtype=np.uint8)


def longest_open_pieces(seq: str) -> list[dict]:
    """The longest stop-free pieces over the six frames of an upper-case sequence: frame, begin on its strand, protein, cds."""
    plus = _CODE[np.minimum(np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 127)]
    found, top = [], 1
    for sign, strand in ((1, plus), (-1, _OTHER_STRAND[plus[::-1]])):
        for shift in range(3):
            codons = strand[shift : shift + max(len(strand) - shift, 0) // 3 * 3].reshape(-1, 3)
            known = (codons < 4).all(axis=1)
            letters = np.where(known, _LETTER[np.where(known, codons @ np.array([16, 4, 1]), 0)], ord("X")).astype(np.uint8)
            stops = np.flatnonzero(letters == ord("*"))
            starts, ends = np.concatenate([[0], stops + 1]), np.concatenate([stops, [len(letters)]])
            most = int((ends - starts).max())
            if most > top:
                found, top = [], most
            if most == top:
                found += [(sign, shift, int(a), letters[a:b].tobytes().decode()) for a, b in zip(starts, ends, strict=True) if b - a == top]
    rows = []
    for sign, shift, start, protein in found:
        begin, size = shift + 3 * start, 3 * len(protein)
        cds = seq[begin : begin + size] if sign > 0 else seq[len(seq) - begin - size : len(seq) - begin][::-1].translate(_COMPLEMENT)
        rows.append({"frame": sign * (shift + 1), "begin": begin, "protein": protein, "cds": cds})
    return rows


_COMPLEMENT = str.maketrans("ACGT", "TGCA")
