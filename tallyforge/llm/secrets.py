"""Secrets in texts: three patterns, and sliding-window entropy.

Base spans are those of three patterns, leftmost and non-overlapping for each
kind, of which failing ones are dropped after matching. Entropy spans come from
candidate strings, runs of a character class: over every window of a candidate
the Shannon entropy of its characters is kept by incremental counts. Adding a
character with c occurrences changes the sum of c log2 c by f(c + 1) - f(c), and
removing one does the reverse, so a step costs no more for a wider window.
Windows at or above the class's threshold join to spans. A candidate that an
allow-list pattern matches gives none; base spans always stay.

All of it is DataFrame functions. Positions are code points, ends exclusive.
Null text is empty; repeated rows each have their row; an empty table has none;
extra columns are not read and may have any name. Matches and windows are worked
off in blocks, so that time grows in proportion to a text's or candidate's length,
however long, and ties don't arise: spans of a kind are disjoint, and all are
ordered by start, then kind, then end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base spans, and the least length of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

#: Candidates that match one of these are no secrets: samples, fillers, alphabets and runs of one character.
ALLOWED = (r"(?i)example|sample|placeholder|changeme|dummy", r"(?i)0123456789|abcdefghij|qwertyuiop", r"(.)\1{7}")

_SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class CharacterClass:
    """A class's alphabet and pattern, the window in characters, and the entropy in bits at which a window counts.

    needs: patterns that a candidate must all contain.
    """

    name: str
    alphabet: str
    pattern: str
    window: int
    threshold: float
    needs: tuple[str, ...] = ()


# The alphabets.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy64", _DIGITS + _LOWER + _UPPER + "+/_=-", r"[A-Za-z0-9+/_=-]", 24, 4.0, ("[0-9]", "[a-z]", "[A-Z]")),
    CharacterClass("entropy16", _DIGITS + "abcdefABCDEF", r"[0-9A-Fa-f]", 24, 3.0, ("[0-9]", "[A-Fa-f]")),
)
KINDS = ("assign", "access", "hex")


#: Matches, and windows of a candidate, that are worked off at once.
BLOCK = 256


def _bound(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.transform(F.array(value), use)[0]


def _blocks(size: Column, first: int) -> Column:
    """Where blocks of so many elements begin, from `first` on; none for size 0."""
    return F.when(size > 0, F.sequence(F.lit(first), size - 1 + first, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))


def _found(text: Column, pattern: str) -> Column:
    """array of (start, text) for each match: matches and the texts between them, laid end to end."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    length = lambda pair: F.char_length(pair["gap"]) + F.char_length(pair["hit"])

    def starts(base: Column, sizes: Column) -> Column:
        """base, and base plus the sizes before, for each."""
        zero = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, pair: n + length(pair)))
        each = F.zip_with(blocks, starts(F.lit(0), sums), lambda b, base: F.zip_with(b, starts(base, F.transform(b, length)), lambda pair, at: F.struct((at + F.char_length(pair["gap"])).alias("start"), pair["hit"].alias("hit"))))
        return F.flatten(each)

    pairs = _bound(hits, lambda h: F.zip_with(F.slice(gaps, 1, F.size(h)), h, lambda g, x: F.struct(g.alias("gap"), x.alias("hit"))))
    return _bound(_bound(pairs, lambda all_: F.transform(_blocks(F.size(all_), 1), lambda at: F.slice(all_, at, BLOCK))), placed)


def _spans(text: Column, gate: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of one kind; texts that the gate turns down are not searched."""
    found = F.transform(F.filter(_found(text, pattern), lambda x: keep(x["hit"])), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.char_length(x["hit"])).alias("end")))
    return F.when(gate, found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def entropy_spans(candidate: Column, cls: CharacterClass) -> Column:
    """array of (start, end) of the joined windows of a candidate whose entropy reaches the threshold.

    The candidate is cut into characters once. Windows are counted in blocks of
    BLOCK of them; a block's counts start anew, and its spans join those before.
    """
    w = cls.window
    most = w * (math.log2(w) - cls.threshold) + 1e-9  # entropy >= threshold as a bound on the sum of c log2 c
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 1)])
    none = F.array().cast("array<struct<start:int,end:int>>")

    def block(codes: Column, first: Column) -> Column:
        """Spans of the windows that start at first, first + 1, ..."""
        start = F.struct(F.array_repeat(F.lit(0), len(cls.alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), none.alias("out"))
        steps = F.sequence(first, F.least(first + BLOCK + w - 2, F.size(codes) - 1))

        def step(acc: Column, i: Column) -> Column:
            moved = F.struct(codes[i].alias("came"), F.when(i - first >= w, codes[i - w]).otherwise(F.lit(0)).alias("gone"))
            return _bound(moved, lambda x: turn(acc, i + 1, x["came"], x["gone"]))

        def turn(acc: Column, end: Column, came: Column, gone: Column) -> Column:
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == came, 1).otherwise(0) - F.when((k == gone) & (gone > 0), 1).otherwise(0))
            up = weight[acc["counts"][came] + 1] - weight[acc["counts"][came]]
            down = F.when(gone > 0, weight[acc["counts"][gone] - 1] - weight[acc["counts"][gone]]).otherwise(0.0)
            total = acc["sum"] + F.when(came == gone, 0.0).otherwise(up + down)
            last = F.try_element_at(acc["out"], F.lit(-1))
            joins = last.isNotNull() & (last["end"] >= end - w)
            grown = F.when(joins, F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))).otherwise(F.concat(acc["out"], F.array(F.struct((end - w).alias("start"), end.alias("end")))))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when((end - first >= w) & (total <= most), grown).otherwise(acc["out"]).alias("out"))

        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    def joined(spans: Column) -> Column:
        """Spans in order, those that touch or overlap made one. Ends ascend with starts."""
        firsts = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["end"] < s["start"]))
        lasts = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > s["end"]))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    codes = F.transform(F.split(candidate, ""), lambda c: F.position(c, F.lit(cls.alphabet)))
    windows = F.greatest(F.char_length(candidate) - w + 1, F.lit(0))
    return _bound(_bound(codes, lambda c: F.flatten(F.transform(_blocks(windows, 0), lambda first: block(c, first)))), joined)


def _entropy(text: Column, cls: CharacterClass, kind: int, allowed: tuple[str, ...]) -> Column:
    pattern = f"{cls.pattern}{{{cls.window},}}"

    def sound(hit: Column) -> Column:
        ok = F.lit(True)
        for p in cls.needs:
            ok = ok & hit.rlike(p)
        for p in allowed:
            ok = ok & ~hit.rlike(p)
        return ok

    each = F.transform(
        F.filter(_found(text, pattern), lambda x: sound(x["hit"])),
        lambda x: F.transform(entropy_spans(x["hit"], cls), lambda s: F.struct((x["start"] + s["start"]).alias("start"), F.lit(kind).alias("kind"), (x["start"] + s["end"]).alias("end"))),
    )
    return F.when(text.rlike(pattern), F.flatten(each).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def written(spans: Column, names: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, names)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """id, base and spans (arrays of start, kind, end; by start, then kind), kinds (their names) for each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    t = F.col("text")
    assign = _spans(t, t.rlike(ASSIGN), ASSIGN, 0, lambda h: F.char_length(F.regexp_extract(h, ASSIGN, 2)) >= ASSIGN_LEAST)
    access = _spans(t, t.contains("AKIA"), ACCESS, 1, lambda h: F.char_length(h) >= ACCESS_LEAST)
    hexes = _spans(t, t.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), f"[0-9a-f]{{{HEX_LEAST},}}", 2, lambda h: F.lit(True))
    more = [_entropy(t, c, len(KINDS) + i, allowed) for i, c in enumerate(classes)]
    names = F.array(*[F.lit(k) for k in (*KINDS, *(c.name for c in classes))])
    found = rows.select("id", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), F.concat(*more).alias("more") if more else F.array().cast(_SPAN).alias("more"))
    base = F.concat("assign", "access", "hex")
    return found.select("id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, "more")).alias("spans"), names.alias("kinds"))
