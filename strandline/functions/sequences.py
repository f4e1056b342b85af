"""Column functions on sequences, names and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def encoded(seq: Column) -> Column:
    """A, C, G, T as 0 to 3, anything else as 4."""
    return F.regexp_replace(F.translate(seq, "ACGTacgt", "01230123"), "[^0-3]", "4")


def trimmed_name(name: Column) -> Column:
    """A read's name without a mate digit: ``/1`` goes from names of more than two characters."""
    return F.regexp_replace(name, "(?<=.)/[0-9]$", "")


def bisulfite(seq: Column, mate: int) -> Column:
    """Reads of conversion chemistry in three letters: C to T for mate 1, G to A for mate 2."""
    return F.translate(seq, "Cc", "TT") if mate == 1 else F.translate(seq, "Gg", "AA")


def orientation(b1: Column, b2: Column, half: Column) -> tuple[Column, Column]:
    """(direction 0 to 3 for FF, FR, RF, RR; distance) of two places in doubled coordinates of length 2 x half."""
    same = (b1 >= half) == (b2 >= half)
    p2 = F.when(same, b2).otherwise(2 * half - 1 - b2)
    turn = F.when(same, 0).otherwise(1)
    return turn.bitwiseXOR(F.when(p2 > b1, 0).otherwise(3)), F.abs(p2 - b1)


def truncated(x: Column) -> Column:
    return x.cast("long")


def single_mapq(score: Column, sub: Column, csub: Column, qspan: Column, rspan: Column, sub_n: Column, frac_rep: Column, seed: int = 19, match: int = 1, mismatch: int = 4) -> Column:
    """Mapping quality of one region: 0 to 60. ``sub`` 0 stands for a hit of one seed; the logarithm of 50 counts as 3."""
    rival = F.greatest(F.when(sub > 0, sub).otherwise(seed * match), csub).cast("double")
    span = F.greatest(qspan, rspan).cast("double")
    identity = 1 - (span * match - score) / (match + mismatch) / span
    weight = F.when(span < 50, F.lit(1.0)).otherwise(F.lit(3) / F.log(F.greatest(span, F.lit(2.0)))) * identity * identity
    q = truncated(6.02 * (score - rival) / match * weight * weight + 0.499)
    q = q - F.when(sub_n > 0, truncated(4.343 * F.log(sub_n + 1.0) + 0.499)).otherwise(0)
    q = F.least(F.greatest(q, F.lit(0)), F.lit(60))
    return F.when(rival >= score, F.lit(0).cast("long")).otherwise(truncated(q * (1 - frac_rep) + 0.499))
