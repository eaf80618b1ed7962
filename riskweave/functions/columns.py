"""Column functions of the scan: check digits, masks, path and line tests, scores. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions import rules


def literal(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with a name for a value that is made once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def applied(sql: str, **values: Column) -> Column:
    """SQL over ``x``, a struct of the given columns. One parsed text takes the place of very many column calls."""
    return F.get(F.call_function("transform", F.array(F.struct(*[v.alias(k) for k, v in values.items()])), F.expr(f"x -> {sql}")), F.lit(0))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _digit(i: int) -> str:
    return f"(ascii(substring(d, {i + 1}, 1)) - 48)"


def _dot(weights: list[int], start: int = 0) -> str:
    """The digits' sum by weights; the code of '0' goes off the whole sum instead of each digit."""
    each = " + ".join(f"ascii(substring(d, {start + i + 1}, 1)) * {w}" for i, w in enumerate(weights))
    return f"({each} - {48 * sum(weights)})"


def _valid(value: str, n: int, checks: list[str]) -> str:
    """Whether n digits, not all the same, pass the checks, which are SQL over the digits ``d``."""
    sane = f"length(d) = {n} AND replace(d, substring(d, 1, 1), '') != ''"
    test = bound(f"regexp_replace({value}, {literal(chr(92) + 'D')}, '')", "d", f"CASE WHEN {sane} THEN {' AND '.join(checks)} ELSE false END")
    return f"coalesce({test}, false)"


def cpf_sql(value: str) -> str:
    return _valid(value, 11, [f"{_dot(list(range(n + 1, 1, -1)))} * 10 % 11 % 10 = {_digit(n)}" for n in (9, 10)])


def cnpj_sql(value: str) -> str:
    weights = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return _valid(value, 14, [f"(11 - {_dot(w)} % 11) % 11 % 10 = {_digit(len(w))}" for w in (weights, [6, *weights])])  # rests 0 and 1 give 0


def cnh_sql(value: str) -> str:
    one = f"{_dot(list(range(9, 0, -1)))} % 11"
    two = f"({_dot(list(range(1, 10)))} % 11 + CASE WHEN {one} = 10 THEN 9 ELSE 0 END) % 11"  # two less, modulo 11
    return _valid(value, 11, [f"{x} % 10 = {_digit(n)}" for n, x in ((9, one), (10, two))])


def titulo_sql(value: str) -> str:
    one = f"{_dot(list(range(2, 10)))} % 11 % 10"
    two = f"({_digit(8)} * 7 + {_digit(9)} * 8 + {one} * 9) % 11 % 10"
    return _valid(value, 12, [f"{_digit(8)} * 10 + {_digit(9)} BETWEEN 1 AND 28", f"{one} = {_digit(10)}", f"{two} = {_digit(11)}"])


def pis_sql(value: str) -> str:
    check = f"(11 - {_dot([3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11)"
    return _valid(value, 11, [f"CASE WHEN {check} >= 10 THEN 0 ELSE {check} END = {_digit(10)}"])


def is_cpf(value: Column) -> Column:
    return applied(cpf_sql("x.v"), v=value)


def is_cnpj(value: Column) -> Column:
    return applied(cnpj_sql("x.v"), v=value)


def is_cnh(value: Column) -> Column:
    return applied(cnh_sql("x.v"), v=value)


def is_titulo_eleitor(value: Column) -> Column:
    return applied(titulo_sql("x.v"), v=value)


def is_pis(value: Column) -> Column:
    return applied(pis_sql("x.v"), v=value)


VALIDATORS = {"cpf": cpf_sql, "cnpj": cnpj_sql, "cnh": cnh_sql, "titulo_eleitor": titulo_sql}


def valid_sql(kind: str, value: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {check(value)}" for name, check in VALIDATORS.items())
    return f"CASE {kind} {cases} ELSE true END"


def is_valid(kind: Column, value: Column) -> Column:
    """Whether a candidate of the kind has right check digits; kinds without such digits pass."""
    return applied(valid_sql("x.k", "x.v"), k=kind, v=value)


def masked(kind: Column, value: Column) -> Column:
    short = F.when(F.length(value) > 4, F.concat(F.substring(value, 1, 2), F.lit("…"), F.right(value, F.lit(2)))).otherwise("…")
    return (
        F.when(kind == "cpf", F.concat(F.lit("***.***.***-"), F.right(value, F.lit(2))))
        .when(kind == "cnpj", F.concat(F.lit("**.***.***/****-"), F.right(value, F.lit(2))))
        .when(kind.isin("cnh", "titulo_eleitor"), short)
        .when(kind == "email", "[email]")
        .when(kind == "phone", "[phone]")
        .otherwise(value)
    )


def is_test_path(path: Column) -> Column:
    return F.translate(path, "\\", "/").rlike(rules.TEST_PATH)


def is_meta_path(path: Column) -> Column:
    norm = F.translate(path, "\\", "/")
    return norm.rlike(rules.META_PATH) | norm.rlike(rules.META_NAME)


def _quoted(word: str) -> str:
    return word.replace("-", r"\-")


def _word(word: str) -> str:
    return f"(?<![a-z0-9]){word}(?![a-z0-9])"


def _keyword(kind: str) -> str:
    """A pattern that any keyword of the kind fits."""
    return _word(f"(?:{'|'.join(map(_quoted, rules.KEYWORDS[kind]))})")


def _first_keyword(low: str, kind: str) -> str:
    each = " ".join(f"WHEN {low} RLIKE {literal(_word(_quoted(w)))} THEN {literal(w)}" for w in rules.KEYWORDS[kind])
    return f"CASE {each} END"


def keyword_sql(line: str, kind: str) -> str:
    """The first keyword of the kind that stands in the line between other characters than a-z and 0-9."""
    return bound(f"lower({line})", "low", f"CASE WHEN low RLIKE {literal(_keyword(kind))} THEN {_first_keyword('low', kind)} END")  # most lines need one test only


def keyword_near_sql(lines: str, kind: str) -> str:
    """What ``keyword_sql`` says of the first line of which it says anything. ``lines`` is one text of lines in lower case: the
    line from its first keyword on is found in one search, and has the same keywords as the whole line."""
    rest = f"regexp_extract({lines}, {literal(_keyword(kind) + '[^\n]*')}, 0)"
    return bound(rest, "low", f"CASE WHEN low != '' THEN {_first_keyword('low', kind)} END")


ANY_MARKER = "|".join(rules.MARKERS)


def marker_sql(line: str) -> str:
    """``marker:`` and the word in a comment line, ``var_marker:`` and the word where one is assigned to, or null."""
    comment = literal("(?U)" + rules.COMMENT_LINE)
    inside = " ".join(f"WHEN body RLIKE {literal(f'(?<![a-z0-9]){w}(?![a-z0-9])')} THEN 'marker:{w}'" for w in rules.MARKERS)
    outside = " ".join(f"WHEN low RLIKE {literal(f'(?U)(?<![a-z0-9]){w}' + chr(92) + 'w*' + chr(92) + 's*[=:]')} THEN 'var_marker:{w}'" for w in rules.MARKERS)
    said = bound(f"lower(regexp_extract({line}, {comment}, 1))", "body", f"CASE {inside} END")
    return bound(f"lower({line})", "low", f"CASE WHEN low RLIKE {literal(ANY_MARKER)} THEN CASE WHEN {line} RLIKE {comment} THEN {said} ELSE CASE {outside} END END END")


def keyword_hit(line: Column, kind: str) -> Column:
    return applied(keyword_sql("x.v", kind), v=line)


def marker_hit(line: Column) -> Column:
    return applied(marker_sql("x.v"), v=line)


def is_regex_line(line: Column) -> Column:
    return line.rlike(rules.REGEX_ARTIFACT)


def category(kind: Column) -> Column:
    """The family of an integration's kind: vector, memory or else telemetry."""
    return F.when(kind.startswith("vector"), "vector").when(kind.startswith("memory"), "memory").otherwise("telemetry")


def tier(keyword: Column, compromised: Column, checked: Column) -> Column:
    return (
        F.when(keyword & ~compromised, "high")
        .when(keyword, "low")
        .when(compromised, "discarded")
        .when(checked, "low")
        .otherwise("discarded")
    )


def clamped(value: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), value))


def level(p: Column, i: Column) -> Column:
    return F.when(p * i >= 20, "Crítico").when(p * i >= 10, "Alto").when(p * i >= 5, "Médio").otherwise("Baixo")


def ordinal(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for n, known in enumerate(rules.LEVELS):
        out = F.when(name == known, n).otherwise(out)
    return out


def threshold(given: Column) -> tuple[Column, Column]:
    """Whether a given threshold is known, and the level it names; nothing given, like ``none``, names no level."""
    key = F.when(F.coalesce(given, F.lit("")) == "", "none").otherwise(F.lower(F.trim(given)))
    level = F.lit(None).cast("string")
    for alias, name in rules.ALIASES.items():
        if name:
            level = F.when(key == alias, name).otherwise(level)
    return key.isin(*rules.ALIASES), level


def treatment(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for known, what in rules.TREATMENT.items():
        out = F.when(name == known, what).otherwise(out)
    return out


def residual(p: Column, i: Column, cut_p: Column, cut_i: Column) -> tuple[Column, Column]:
    """Probability and impact after mitigations: both cuts are capped, and a high risk stays at Médio at least."""
    left_p = clamped(p - F.greatest(F.lit(0), F.least(cut_p, F.lit(rules.MOST_PROBABILITY_CUT))))
    left_i = clamped(i - F.greatest(F.lit(0), F.least(cut_i, F.lit(rules.MOST_IMPACT_CUT))))
    floor = clamped(F.greatest(left_p, F.ceil(F.lit(5) / left_i).cast("int")))
    return F.when(level(p, i).isin("Alto", "Crítico"), floor).otherwise(left_p), left_i
