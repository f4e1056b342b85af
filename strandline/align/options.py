"""Options of an alignment, their defaults, presets and output profiles."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Profile:
    """What records and header carry, and two rules that older output had."""

    header_line: bool = True
    sidecar: bool = True
    mate_quality: bool = True
    hit_number: bool = True
    scored_hits: bool = True
    keep_one_chain: bool = False


#: ``default``; ``first``, as the first generation writes; ``second``, as the second one does.
PROFILES = {
    "default": Profile(),
    "first": Profile(sidecar=False, hit_number=False),
    "second": Profile(header_line=False, sidecar=False, mate_quality=False, hit_number=False, scored_hits=False, keep_one_chain=True),
}


@dataclass(frozen=True)
class Options:
    # seeding
    seed: int = 19
    reseed: float = 1.5
    split_width: int = 10
    round3: int = 20
    max_occ: int = 500
    # chains
    band: int = 100
    chain_gap: int = 10_000
    min_weight: int = 0
    mask: float = 0.5
    drop: float = 0.5
    max_extend: int = 1 << 30
    min_ext_len: int = 0
    cap_chains: int = 0
    tie_frac: float = 0.0
    tie_floor: int = 0
    # scores
    match: int = 1
    mismatch: int = 4
    open_del: int = 6
    extend_del: int = 1
    open_ins: int = 6
    extend_ins: int = 1
    clip5: int = 5
    clip3: int = 5
    zdrop: int = 100
    unpaired: int = 17
    # regions and output
    redundant: float = 0.95
    least: int = 30
    span50: int = 50
    xa_ratio: float = 0.8
    xa_hits: int = 5
    xa_hits_alt: int = 200
    all_hits: bool = False
    soft_clip: bool = False
    split_secondary: bool = False
    primary5: bool = False
    keep_mapq5: bool = False
    capped_sub: bool = False
    hard_cap: int = 0
    comment: bool = False
    reference_comment: bool = False
    scored_hits: bool = False
    read_group: str = ""
    # pairs
    rescue: int = 50
    no_rescue: bool = False
    no_pairing: bool = False
    max_ins: int = 10_000
    insert: tuple[float, ...] = ()
    batch_bases: int = 10_000_000
    tie_by_name: bool = False
    # ALT projection
    project: bool = False
    project_gap: int = 0
    project_only: bool = False
    # methylation
    meth: str = ""
    meth_context: str = "genomic"
    meth_tags: tuple[str, ...] = ("XR", "XG", "XM")
    set_as_failed: str = ""
    chimera_qc: bool = False
    profile: str = "default"

    @property
    def split_len(self) -> int:
        """Half a character is rounded down."""
        return int(self.seed * self.reseed + 0.499)

    @property
    def near(self) -> int:
        """Scores this close to the best count as rivals."""
        return max(self.match + self.mismatch, self.open_del + self.extend_del, self.open_ins + self.extend_ins)


DEFAULTS = Options()
#: What follows the match score unless it is set itself.
SCALED = ("mismatch", "least", "open_del", "open_ins", "extend_del", "extend_ins", "zdrop", "clip5", "clip3", "unpaired")
PRESETS: dict[str, dict] = {
    "fast": {"rescue": 10, "round3": 0, "min_ext_len": 30, "cap_chains": 20, "tie_frac": 0.95, "tie_floor": 1, "capped_sub": True},
    "contigs": {"open_del": 16, "open_ins": 16, "mismatch": 9, "clip5": 5, "clip3": 5},
    "long": {"seed": 17, "min_weight": 40, "reseed": 10.0, "drop": 0.5, "open_del": 1, "open_ins": 1, "extend_del": 1, "extend_ins": 1, "mismatch": 1, "clip5": 0, "clip3": 0},
    "nanopore": {"seed": 14, "min_weight": 20, "reseed": 10.0, "drop": 0.5, "open_del": 1, "open_ins": 1, "extend_del": 1, "extend_ins": 1, "mismatch": 1, "clip5": 0, "clip3": 0},
    "hic": {"primary5": True, "no_rescue": True, "no_pairing": True},
    "methylation": {"meth": "emseq", "least": 40, "unpaired": 100, "clip5": 100, "clip3": 100, "split_secondary": True},
}


def options(*presets: str, **given) -> Options:
    """Defaults, then presets in order, then what is given; a match score other than 1 scales the scores that weren't set."""
    unknown = set(given) - {f.name for f in fields(Options)}
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    values: dict = {}
    for name in presets:
        values |= PRESETS[name]
    values |= given
    a = values.get("match", 1)
    if a != 1:
        for name in SCALED:
            values.setdefault(name, getattr(DEFAULTS, name) * a)
    out = replace(DEFAULTS, **values)
    if out.seed < 1 or out.match < 1 or min(out.mismatch, out.open_del, out.open_ins, out.clip5, out.clip3) < 0 or min(out.extend_del, out.extend_ins) < 1:
        raise ValueError("seed, match and extension scores are 1 or more, the other scores 0 or more")
    if out.profile not in PROFILES:
        raise ValueError(f"profile {out.profile} isn't one of {', '.join(PROFILES)}")
    if out.insert and not 1 <= len(out.insert) <= 4:
        raise ValueError("insert is mean, std, max, min")
    return out
