"""Regular-expression matches of whole texts with their lines, without Python and without a shuffle.

Spark gives matches, but no offsets. The pieces between matches and the matches alternate, so running sums of line breaks
and lengths over both give each match's line and offset. The sums are made within the row, in blocks of BLOCK matches, so
a text with very many matches takes work in proportion to their number; texts may have any keys, or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.columns import bound, literal

BLOCK = 256
FEW = 4  # matches that are searched for one by one
MARK, OTHER = "\uffff", "\ufffe"  # two characters that no pattern tells apart


def _sums(block: str) -> str:
    """SQL of a struct: for each number of an array the sum of those before it, and the sum of all."""
    start = "named_struct('part', cast(array() AS array<bigint>), 'sum', 0L)"
    return f"aggregate({block}, {start}, (a, y) -> named_struct('part', array_append(a.part, a.sum), 'sum', a.sum + y))"


def running(values: str) -> str:
    """SQL of, for each element of an array of numbers, the sum of those before it."""
    cut = f"transform(sequence(0, greatest(0, cast(ceil(size(every) / {BLOCK}) AS int) - 1)), n -> {_sums(f'slice(every, n * {BLOCK} + 1, {BLOCK})')})"
    spread = bound(_sums("transform(own, c -> c.sum)"), "starts", "flatten(transform(own, (c, n) -> transform(c.part, z -> z + get(starts.part, n))))")
    return bound(values, "every", bound(cut, "own", spread))


def _breaks(text: str) -> str:
    return f"cast(octet_length({text}) - octet_length(replace({text}, '\\n', '')) AS bigint)"


def found_in(text: str, kind: str, pattern: str, groups: int = 0, hint: str | None = None) -> str:
    """SQL of an array of (kind, seq, value, line, at, groups), one for each match in a column, or null if there is none.

    ``hint`` is a cheaper test that every text with a match passes. Where FEW matches or less have values that the text has
    nowhere else, their places are those of the values; else the text between matches tells them.
    """
    p = literal(pattern)
    groups_of = range(1, groups + 1)
    own = "array(" + ", ".join(f"get(p.g{g}, k)" for g in groups_of) + ")" if groups else "cast(array() AS array<string>)"
    row = lambda line, at: f"named_struct('kind', '{kind}', 'seq', k, 'value', v, 'line', cast({line} AS int), 'at', cast({at} AS bigint), 'groups', {own})"
    every = "'g0', g0" + "".join(f", 'g{g}', regexp_extract_all({text}, {p}, {g})" for g in groups_of)
    # Piece k comes before match k; what follows a match begins with the next piece.
    lines = running(f"transform(p.g0, (v, k) -> {_breaks('get(p.b, k)')} + {_breaks('v')})")
    places = running("transform(p.g0, (v, k) -> cast(length(get(p.b, k)) + length(v) AS bigint))")
    each = row(f"1 + get(q.l, k) + {_breaks('get(p.b, k)')}", "get(q.a, k) + length(get(p.b, k))")
    rows = bound(f"named_struct('l', {lines}, 'a', {places})", "q", f"transform(p.g0, (v, k) -> {each})")
    # Spark's split would compile the pattern for each row, its replacement does not. Only lengths and line breaks of the
    # pieces count, so the mark may be taken out of the text before.
    between = f"split(regexp_replace(replace({text}, '{MARK}', '{OTHER}'), {p}, '{MARK}'), '{MARK}', -1)"
    many = bound(f"named_struct('b', {between}, {every})", "p", rows)
    few = f"transform(g0, (v, k) -> {bound(f'substring({text}, 1, instr({text}, v) - 1)', 'b', row(f'1 + {_breaks('b')}', 'length(b)'))})"
    few = bound(f"named_struct({every})", "p", few) if groups else few
    once = f"size(g0) <= {FEW} AND forall(g0, v -> locate(v, {text}, instr({text}, v) + 1) = 0)"
    found = bound(f"regexp_extract_all({text}, {p}, 0)", "g0", f"CASE WHEN size(g0) > 0 THEN CASE WHEN {once} THEN {few} ELSE {many} END END")
    return found if hint is None else f"CASE WHEN {hint} THEN {found} END"


def all_found(parts: list[str]) -> str:
    return f"flatten(array_compact(array({', '.join(parts)})))"


def matches(df: DataFrame, keys: list[str], text: str, patterns: list[tuple], hints: dict[str, str] | None = None) -> DataFrame:
    """keys, kind, seq, value, line, at, groups for each match; patterns are (kind, Java pattern, groups to return)."""
    found = [found_in(f"`{text}`", *p, hint=(hints or {}).get(p[0])) for p in patterns]
    return df.select(*keys, F.explode(F.expr(all_found(found))).alias("m")).select(*keys, "m.*")
