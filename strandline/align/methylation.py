"""Conversion chemistry: projected reads and contigs, score matrices, methylation calls and tags, and quality marks."""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np

from strandline.align import kernels
from strandline.align.chains import Seed

#: Chemistries: whether the converted base is the methylated one.
CONVERTED_IS_METHYLATED = {"emseq": False, "taps": True, "5base": True}
#: A read whose longest match covers less of it, in hundredths, is marked as failed. Fixed value.
LEAST_MATCH = 44


def projected(seq: str, mate: int) -> str:
    """A read in three letters: C to T for mate 1, G to A for mate 2."""
    return seq.translate(str.maketrans("Cc", "TT") if mate == 1 else str.maketrans("Gg", "AA"))


def contigs(name: str, seq: str) -> list[tuple[str, str]]:
    """A contig's two chains: ``r`` with G to A, ``f`` with C to T."""
    seq = seq.upper()
    return [("r" + name, seq.replace("G", "A")), ("f" + name, seq.replace("C", "T"))]


def original(name: str) -> tuple[str, str]:
    """(contig, chain) of a projected contig's name."""
    return name[1:], name[0]


def remapped(seeds: list[Seed], names: dict[int, str], rids: dict[str, int], mate: int) -> list[tuple[Seed, str]]:
    """Seeds on the projected contigs as (seed on the original contig, hypothesis); those of the other chemistry go.

    A read of mate 1 has C as T: forward it fits chain f, turned around chain r;
    mate 2 the other way round.
    """
    out = []
    for s in seeds:
        name, chain = original(names[s.rid])
        if (chain == "f") == ((mate == 1) != bool(s.rev)):
            out.append((replace(s, rid=rids[name]), chain))
    return out


def matrices(match: int, mismatch: int, context: str = "genomic") -> dict[str, np.ndarray]:
    """Scores by target and read for the two hypotheses: ``f``, C read as T, and ``r``, G read as A.

    ``genomic`` scores the conversion as a match, ``neutral`` as nothing,
    ``collapsed`` also the reverse of it.
    """
    out = {}
    for chain, (kept, made) in {"f": (1, 3), "r": (2, 0)}.items():
        m = kernels.matrix(match, mismatch)
        m[kept, made] = 0 if context == "neutral" else match
        if context == "collapsed":
            m[made, kept] = match
        out[chain] = m
    return out


def labelled(seq: str) -> str:
    """A contig whose CG are 5 and 6; no CG reaches over a hole or a contig's end."""
    return seq.upper().replace("CG", "56")


def unlabelled(seq: str) -> str:
    return seq.translate(str.maketrans("56", "CG"))


def calls(contig: str, pos: int, top: bool, cigar: list[tuple[str, int]], seq: str, chemistry: str = "emseq") -> str:
    """The call of each base of a read as it is written, forward on the contig.

    Z, X, H: methylated C in CG, CHG, CHH; U where the context isn't known; in
    small letters unmethylated; a point for all else. On the bottom strand G
    stands for C, and the context is before it.
    """
    base, made, step = ("C", "T", 1) if top else ("G", "A", -1)
    partner = "G" if top else "C"
    if CONVERTED_IS_METHYLATED[chemistry]:
        methylated, not_methylated = made, base
    else:
        methylated, not_methylated = base, made
    at = lambda i: contig[i].upper() if 0 <= i < len(contig) and contig[i].upper() in "ACGT" else "N"
    out, i, j = [], pos, 0
    for op, n in cigar:
        if op in "M=X":
            for k in range(n):
                read = seq[j + k]
                if at(i + k) != base or read not in (methylated, not_methylated):
                    out.append(".")
                    continue
                near, next_ = at(i + k + step), at(i + k + 2 * step)
                if near == "N":
                    letter = "U"
                elif near == partner:
                    letter = "Z"
                elif next_ == "N":
                    letter = "U"
                else:
                    letter = "X" if next_ == partner else "H"
                out.append(letter if read == methylated else letter.lower())
            i, j = i + n, j + n
        elif op in "IS":
            out.append("." * n)
            j += n
        elif op in "DN":
            i += n
    return "".join(out).ljust(len(seq), ".")


def tags(mate: int, chain: str, call: str, wanted: tuple[str, ...]) -> list[str]:
    """XR, the read's conversion; XG, the genome's; XM, the calls."""
    every = {"XR": "CT" if mate == 1 else "GA", "XG": "CT" if chain == "f" else "GA", "XM": call}
    return [f"{k}:Z:{v}" for k, v in every.items() if k in wanted and v]


def checked(flag: int, quality: int, cigar: str, length: int, chain: str, set_as_failed: str = "", chimera: bool = False) -> tuple[int, int]:
    """(flag, quality) with failed strands and chimeras marked."""
    if flag & 4:
        return flag, quality
    if set_as_failed and set_as_failed == chain:
        flag |= 0x200
    longest = max((int(n) for n in re.findall(r"([0-9]+)M", cigar)), default=0)
    if chimera and length and cigar != "*" and 100 * longest < LEAST_MATCH * length:
        flag, quality = (flag | 0x200) & ~2, min(quality, 1)
    return flag, quality


def spread_failure(flags: list[int]) -> list[int]:
    """If one record of a read pair has failed, all have."""
    return [(f | 0x200) & ~2 for f in flags] if any(f & 0x200 for f in flags) else flags
