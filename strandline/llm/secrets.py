"""Secret scan: fixed patterns and sliding-window entropy, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import fixed, let, match_spans, no_spans, replaced, running

# The kinds in their order, their patterns and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

#: Candidate strings of the entropy scan, and those that are benign as a whole.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"([A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8})"
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9_+/=-]+$|^[A-Za-z_+/=-]+$",  # no letters or no digits
    rf"^/?{WORD}([_-]{WORD})*(/{WORD}([_-]{WORD})*){{2,}}/?$",  # paths of words
)
#: Parts that are benign themselves, but not what stands beside them.
FILLER = r"(?i)example|placeholder|changeme|x{6,}|0{8,}|abcdefghij|0123456789|qwertyuiop"
#: Window in characters, and per character class the entropy in bits that a window must reach.
SPAN, LEAST = 20, {"hex": 2.9, "lower": 3.75, "mixed": 3.85}
#: The alphabet whose counts the window keeps.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _class(s: Column) -> Column:
    return F.when(s.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(s.rlike(r"^([^A-Z]+|[^a-z]+)$"), "lower").otherwise("mixed")


def _plog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(0.0)


def window_entropy(s: Column, span: int = SPAN) -> Column:
    """The largest Shannon entropy (bits) of any ``span`` characters in a row of ``s``, or of a shorter ``s`` as a whole.

    Counts move by one for the character that enters and the one that leaves,
    and the sum of c*log2(c) moves with them; no window is counted anew.
    """
    wide = F.least(F.char_length(s), F.lit(span))
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    moves = F.zip_with(codes, F.concat(F.array_repeat(F.lit(-1), wide), F.slice(codes, 1, F.char_length(s) - wide)), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"))

    def step(z: Column, m: Column) -> Column:
        new, old = F.get(z["n"], m["new"]), F.get(z["n"], m["old"])
        enter = _plog(new + 1) - _plog(new)
        leave = F.when(m["old"] >= 0, _plog(old - 1) - _plog(old)).otherwise(0.0)
        same = m["new"] == m["old"]
        total = z["sum"] + F.when(same, 0.0).otherwise(enter + leave)
        counts = F.when(same, z["n"]).otherwise(F.transform(z["n"], lambda c, j: c + (j == m["new"]).cast("int") - (j == m["old"]).cast("int")))
        bits = F.when(z["i"] >= wide - 1, F.log2(wide) - total / wide).otherwise(0.0)
        return F.struct(counts.alias("n"), (z["i"] + 1).alias("i"), total.alias("sum"), F.greatest(z["top"], bits).alias("top"))

    return F.aggregate(moves, zero, step)["top"]


def _suspicious(s: Column) -> Column:
    """Whether a piece of at least a window between the fillers of ``s`` has a window of high entropy."""
    benign = lambda x: F.exists(F.array(*[x.rlike(pattern) for pattern in ALLOW]), lambda hit: hit)

    def high(piece: Column) -> Column:
        kind = _class(piece)
        least = F.when(kind == "hex", LEAST["hex"]).when(kind == "lower", LEAST["lower"]).otherwise(LEAST["mixed"])
        return F.when((F.char_length(piece) < SPAN) | benign(piece), False).otherwise(window_entropy(piece) >= least)

    return F.when(benign(s), False).otherwise(F.exists(F.split(s, FILLER), high))


def _uncovered(high: Column, base: Column) -> Column:
    """The parts of the spans ``high`` that no span of ``base`` covers; what stands before an assignment must be suspicious by itself.

    Both are sorted by start, and ``high`` has no overlaps. Events in the order
    of the text tell of each span how many of ``base`` start before its start
    and before its end, and how far those before its start reach.
    """
    event = lambda at, turn, one, far: F.struct(at.alias("at"), turn.alias("turn"), one.alias("one"), far.alias("far"))
    none = F.lit(0)
    events = F.concat(
        F.transform(base, lambda b: event(b["start"], F.lit(1), F.lit(1), b["end"])),
        F.transform(high, lambda h: event(h["start"], F.lit(0), none, none)),
        F.transform(high, lambda h: event(h["end"], F.lit(-1), none, none)),
    )

    def told(e: Column) -> Column:
        seen = running(F.transform(e, lambda x: F.struct(x["one"].alias("n"), x["far"].alias("far"))), lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), F.greatest(x["far"], y["far"]).alias("far")), F.struct(none.alias("n"), none.alias("far")))
        both = F.zip_with(e, seen, lambda x, s: F.struct(x["turn"].alias("turn"), s["n"].alias("n"), s["far"].alias("far")))
        return let(both, lambda z: F.zip_with(F.filter(z, lambda x: x["turn"] == 0), F.filter(z, lambda x: x["turn"] == -1), lambda a, b: F.struct(a["n"].alias("first"), (b["n"] - a["n"]).alias("n"), a["far"].alias("far"))))

    def parts(h: Column, near: Column) -> Column:
        part = lambda start, end: F.struct(start.alias("start"), h["rank"].alias("rank"), end.alias("end"), h["kind"].alias("kind"), F.substring(h["hit"], start - h["start"] + 1, end - start).alias("hit"))
        inside = F.slice(base, near["first"] + 1, near["n"])
        ends = lambda b: running(F.transform(b, lambda x: x["end"]), F.greatest, F.greatest(h["start"], near["far"]))

        def cut(b: Column) -> Column:
            kept = lambda x, at: (x["start"] > at) & F.when(x["kind"] == "assign", _suspicious(part(at, x["start"])["hit"])).otherwise(True)
            before = F.filter(F.zip_with(b, ends(b), lambda x, at: F.when(kept(x, at), part(at, x["start"]))), lambda x: x.isNotNull())
            last = F.greatest(h["start"], near["far"], F.array_max(F.transform(b, lambda x: x["end"])))
            return F.concat(before, F.when(last < h["end"], F.array(part(last, h["end"]))).otherwise(no_spans()))

        return let(inside, cut)

    return F.when(F.size(high) > 0, F.flatten(F.zip_with(high, let(F.array_sort(events), told), parts))).otherwise(no_spans())


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: sorted arrays of struct(start, rank, end, kind, hit).

    ``base`` has the fixed kinds; ``spans`` has these and, as kind ``entropy``,
    candidate strings of high window entropy that the allow list doesn't have,
    without what base spans cover of them. Positions are code points of the whole text.
    A null text is empty; rows are independent, so repeated rows and null ids
    need no care. Columns ``base`` and ``spans`` of the input are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    group2 = lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 1)) >= 12
    assign = F.when(text.rlike(r"[:=]"), F.filter(match_spans(text, ASSIGN, "assign", 0), lambda s: group2(s["hit"]))).otherwise(no_spans())
    access = F.when(text.contains("AKIA"), match_spans(text, ACCESS, "access", 1)).otherwise(no_spans())
    hexes = F.when(text.rlike(HEX), match_spans(text, HEX, "hex", 2)).otherwise(no_spans())
    high = F.when(text.rlike(CANDIDATE), F.filter(match_spans(text, CANDIDATE, "entropy", 3), lambda s: _suspicious(s["hit"]))).otherwise(no_spans())
    found = docs.withColumn("base", fixed(F.array_sort(F.concat(assign, access, hexes)))).withColumn("__high", fixed(high))
    apart = _uncovered(F.col("__high"), F.col("base"))
    return found.withColumn("spans", F.array_sort(F.concat("base", apart))).drop("__high")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; texts without spans, and null, as they were."""
    df = scan(docs, text_col)
    return df.withColumn(text_col, F.when(F.size("spans") > 0, replaced(F.col(text_col), F.col("spans"))).otherwise(F.col(text_col))).drop("base", "spans")
