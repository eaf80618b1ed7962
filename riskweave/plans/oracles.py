"""SQL that gives the same rows as the registered queries, for DuckDB."""

from __future__ import annotations

from riskweave.functions import rules
from riskweave.plans.derived import ADDRESSES, FILES, JS, MANIFESTS, NUMBERS, OPERATIONS, PY, THRESHOLDS


def dot(v: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({v}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def digit(v: str, i: int) -> str:
    return f"CAST(substr({v}, {i + 1}, 1) AS INT)"


def same(v: str) -> str:
    return f"replace({v}, substr({v}, 1, 1), '') <> ''"


W = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
CPF = f"({same('v11')} AND {dot('v11', list(range(10, 1, -1)))} * 10 % 11 % 10 = {digit('v11', 9)} AND {dot('v11', list(range(11, 1, -1)))} * 10 % 11 % 10 = {digit('v11', 10)})"
CNH = (
    f"({same('v11')} AND (CASE WHEN {dot('v11', list(range(9, 0, -1)))} % 11 >= 10 THEN 0 ELSE {dot('v11', list(range(9, 0, -1)))} % 11 END) = {digit('v11', 9)}"
    f" AND (({dot('v11', list(range(1, 10)))} % 11 - (CASE WHEN {dot('v11', list(range(9, 0, -1)))} % 11 >= 10 THEN 2 ELSE 0 END) + 11) % 11) % 10 = {digit('v11', 10)})"
)
PIS = f"({same('v11')} AND (CASE WHEN 11 - {dot('v11', [3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 >= 10 THEN 0 ELSE 11 - {dot('v11', [3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 END) = {digit('v11', 10)})"
CNPJ = (
    f"({same('v14')} AND (CASE WHEN {dot('v14', W)} % 11 < 2 THEN 0 ELSE 11 - {dot('v14', W)} % 11 END) = {digit('v14', 12)}"
    f" AND (CASE WHEN {dot('v14', [6, *W])} % 11 < 2 THEN 0 ELSE 11 - {dot('v14', [6, *W])} % 11 END) = {digit('v14', 13)})"
)
TITULO = (
    f"({same('v12')} AND CAST(substr(v12, 9, 2) AS INT) BETWEEN 1 AND 28 AND {dot('v12', list(range(2, 10)))} % 11 % 10 = {digit('v12', 10)}"
    f" AND ({digit('v12', 8)} * 7 + {digit('v12', 9)} * 8 + {dot('v12', list(range(2, 10)))} % 11 % 10 * 9) % 11 % 10 = {digit('v12', 11)})"
)
LETTER = r"[\p{L}\p{N}_]"
EMAIL = rf"{LETTER}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]*{LETTER}"
PHONE = r"\+?[0-9]{2}\s?\(?[0-9]{2}\)?\s?9?[0-9]{4}-?[0-9]{4}"
CEP = r"(?:^|[^0-9])([0-9]{5}-[0-9]{3})(?:[^0-9]|$)"


def found(source: str, key: str, text: str, kind: str, pattern: str) -> str:
    """Matches of a pattern with their lines, from the pieces between them."""
    return f"""
SELECT {key}, '{kind}' AS kind, CAST(i - 1 AS INT) AS seq, m[i] AS value,
  1 + length(array_to_string(list_concat(b[1:i], m[1:i - 1]), '')) - length(replace(array_to_string(list_concat(b[1:i], m[1:i - 1]), ''), chr(10), '')) AS line
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS b FROM {source})) WHERE len(m) > 0"""


def hit(line: str, words: tuple[str, ...], form: str, prefix: str = "") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({line}, '{form.format(w)}') THEN '{prefix}{w}'" for w in words) + " END"


def tiers(files: str) -> str:
    word = "(^|[^a-z0-9]){}([^a-z0-9]|$)"
    comment = r"^\s*(#|//|/\*|\*)\s*(.+)$"
    mark = (
        f"CASE WHEN regexp_matches(body, '{comment}') THEN {hit(f'''lower(regexp_extract(body, '{comment}', 2))''', rules.MARKERS, word, 'marker:')}"
        f" ELSE {hit('lower(body)', rules.MARKERS, '(^|[^a-z0-9]){}[a-z0-9_]*[ ]*[=:]', 'var_marker:')} END"
    )
    frame = "OVER (PARTITION BY path ORDER BY n ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"
    near = frame.format(rules.LINES_AROUND)
    close = frame.format(rules.MARKER_LINES)
    clean = "replace(path, chr(92), '/')"
    return f"""
WITH f AS ({files}), l AS (
  SELECT path, n, ls[n] AS body FROM (SELECT path, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM f)
), h AS (
  SELECT path, n, body, {hit('lower(body)', rules.KEYWORDS['cpf'], word)} AS kc, {hit('lower(body)', rules.KEYWORDS['email'], word)} AS ke, {mark} AS mk FROM l
), s AS (
  SELECT path, n, body, first_value(kc IGNORE NULLS) {near} AS kc, first_value(ke IGNORE NULLS) {near} AS ke, first_value(mk IGNORE NULLS) {close} AS mk,
    regexp_matches({clean}, '{rules.TEST_PATH.replace("(?:", "(")}') AS t,
    regexp_matches({clean}, '{rules.META_PATH.replace("(?:", "(")}') OR regexp_matches({clean}, '{rules.META_NAME.replace("(?:", "(")}') AS me,
    regexp_matches(body, '\\\\d|\\\\\\.|\\[0-9\\]|\\br[''"]') AS ra FROM h
), c AS (
  SELECT s.*, 'cpf' AS kind, kc AS k, TRUE AS chk FROM (SELECT *, regexp_extract(body, '(^|[^0-9])([0-9]{{11}})([^0-9]|$)', 2) AS v11 FROM s) s WHERE length(v11) = 11 AND {CPF}
  UNION ALL BY NAME
  SELECT s.*, 'email' AS kind, ke AS k, FALSE AS chk, '' AS v11 FROM s WHERE regexp_matches(body, '{EMAIL}')
)
SELECT path, kind, CAST(n AS INT) AS line,
  CASE WHEN k IS NOT NULL AND NOT (mk IS NOT NULL OR t OR me OR ra) THEN 'high' WHEN k IS NOT NULL THEN 'low' WHEN mk IS NOT NULL OR t OR me OR ra THEN 'discarded' WHEN chk THEN 'low' ELSE 'discarded' END AS tier,
  concat_ws(',', 'keyword:' || k, mk, CASE WHEN t THEN 'test_path' END, CASE WHEN me THEN 'meta_path' END, CASE WHEN ra THEN 'regex_artifact' END,
    CASE WHEN k IS NULL AND NOT (mk IS NOT NULL OR t OR me OR ra) AND chk THEN 'checksum_only' END) AS signals
FROM c"""


def catalog(rows: list) -> str:
    def texts(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"

    return "VALUES " + ", ".join(
        f"({n}, '{r[0]}', {r[4]}, {r[5]}, {texts(r[6])}, {texts(r[7])}, {sum(m[1] for m in r[8])}, {sum(m[2] for m in r[8])}, '{', '.join(r[3]) or '—'}', {len(r[8])})" for n, r in enumerate(rows)
    )


LEVEL = "CASE WHEN {0} >= 20 THEN 'Crítico' WHEN {0} >= 10 THEN 'Alto' WHEN {0} >= 5 THEN 'Médio' ELSE 'Baixo' END"


def places(operations: str, findings: str, rows: list) -> str:
    """Tables c (rules) and e (each place of each risk once, with its first branch), to follow WITH."""
    vector = ", ".join(f"'{k}'" for k in rules.VECTOR_KINDS)
    return f"""o AS ({operations}), g AS ({findings}), c(ord, id, p, i, ops, flags, cp, ci, law, steps) AS ({catalog(rows)}), e AS (
  SELECT id, path, line, kind, min(branch) AS branch FROM (
    SELECT id, path, line, kind, 0 AS branch FROM c JOIN o ON list_contains(c.ops, o.kind)
    UNION ALL SELECT id, path, line, 'pii:' || kind, 1 FROM c JOIN g ON list_contains(c.flags, 'pii') AND g.tier = 'high'
    UNION ALL SELECT id, path, line, kind, 2 FROM c JOIN o ON list_contains(c.flags, 'external_provider') AND o.provider <> ''
    UNION ALL SELECT id, path, line, kind, 3 FROM c JOIN o ON list_contains(c.flags, 'telemetry') AND o.kind = 'telemetry'
    UNION ALL SELECT id, path, line, kind, 4 FROM c JOIN o ON list_contains(c.flags, 'memory_store') AND o.kind = 'memory_persist'
    UNION ALL SELECT id, path, line, kind, 5 FROM c JOIN o ON list_contains(c.flags, 'vector_store') AND o.kind IN ({vector})
  ) GROUP BY ALL
)"""


def register(operations: str, findings: str, rows: list) -> str:
    return f"""
WITH {places(operations, findings, rows)}, n AS (SELECT id, count(*) AS places FROM e GROUP BY id), m AS (
  SELECT c.*, coalesce(n.places, 0) AS places, greatest(1, least(5, p - least(cp, 2))) AS rp0, greatest(1, least(5, i - least(ci, 1))) AS ri
  FROM c LEFT JOIN n ON c.id = n.id WHERE n.places > 0 OR list_contains(c.flags, 'always')
), r AS (SELECT *, {LEVEL.format('p * i')} AS ni, CASE WHEN p * i >= 10 THEN greatest(rp0, least(5, CAST(ceil(5.0 / ri) AS INT))) ELSE rp0 END AS rp FROM m)
SELECT ord, id, ni AS nivel_inerente, CAST(rp AS INT) AS probabilidade_residual, CAST(ri AS INT) AS impacto_residual, {LEVEL.format('rp * ri')} AS nivel_residual,
  CASE {LEVEL.format('rp * ri')} WHEN 'Crítico' THEN 'evitar' WHEN 'Baixo' THEN 'aceitar' ELSE 'mitigar' END AS tratamento, CAST(places AS BIGINT) AS places FROM r"""


def gate(reg: str, threshold: str | None) -> str:
    levels = "['Baixo', 'Médio', 'Alto', 'Crítico']"
    breached = f"coalesce(max(list_position({levels}, nivel_inerente)) >= list_position({levels}, '{threshold}'), FALSE)" if threshold else "FALSE"
    named = f"'{threshold}'" if threshold else "NULL::VARCHAR"
    return f"SELECT count(*) AS total, {levels}[max(list_position({levels}, nivel_inerente))] AS worst, {named} AS threshold, {breached} AS breached, CASE WHEN {breached} THEN 4 ELSE 0 END AS exit_code FROM ({reg})"


def re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def js_found(kind: str, pattern: str) -> str:
    """Matches in modules, each with the text before it."""
    p = re2(pattern)
    return f"""
SELECT path, hint, text, '{kind}' AS what, m[i] AS value, array_to_string(list_concat(b[1:i], m[1:i - 1]), '') AS prefix
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS b FROM j))"""


def js_rows() -> str:
    name = "split_part(path, '/', -1)"
    hint = "CASE " + " ".join(rf"WHEN regexp_matches(text, '{re2(p)}') THEN '{k}'" for k, p in rules.JS_PROVIDERS) + " END"
    found = " UNION ALL ".join(js_found(k, p) for k, p in (("nextjs_route", rules.JS_HANDLER), ("express_route", rules.JS_ROUTE), ("call", rules.JS_CALL), ("tool", rules.JS_TOOL)))
    function = re2(rules.JS_FUNCTION)
    said = "trim(([x FOR x IN string_split(prefix, chr(10))[1:-2] IF x <> ''])[-1])"
    return rf"""
WITH j AS (SELECT *, {hint} AS hint FROM ({JS}) WHERE regexp_matches({name}, '\.(js|jsx|mjs|cjs|ts|tsx)$') AND path NOT LIKE 'node_modules/%'), f AS ({found}), h AS (
  SELECT *, regexp_extract_all(prefix, '{function}')[-1] AS before, regexp_extract(value, CASE what WHEN 'call' THEN '{re2(rules.JS_CALL)}' ELSE '{re2(rules.JS_HANDLER)}' END, 1) AS one,
    length(prefix) - length(replace(prefix, chr(10), '')) + 1 AS n, {said} AS c FROM f
)
SELECT path, CASE WHEN what LIKE '%route' THEN 'entrypoint' WHEN what = 'call' THEN 'operation' ELSE 'tool' END AS fact,
  CASE WHEN what <> 'call' THEN what WHEN lower(one) LIKE '%embed%' THEN 'embed' ELSE 'invoke_llm' END AS kind,
  CASE what WHEN 'nextjs_route' THEN one WHEN 'express_route' THEN regexp_extract(value, '{re2(rules.JS_ROUTE)}', 2) WHEN 'tool' THEN 'tool(...)' END AS name,
  CASE WHEN what = 'call' THEN hint END AS provider, CAST(n AS INT) AS line, CAST(length(prefix) AS BIGINT) AS "at", CASE WHEN what = 'call' THEN trim(string_split(text, chr(10))[n]) END AS snippet,
  CASE WHEN what = 'call' THEN coalesce(nullif(regexp_extract(before, '{function}', 1), ''), nullif(regexp_extract(before, '{function}', 2), ''), nullif(regexp_extract(before, '{function}', 3), '')) END AS enclosing,
  CASE WHEN what = 'call' AND c LIKE '//%' THEN nullif(trim(regexp_replace(c, '^/+', '')), '') END AS prev_comment FROM h"""


def python_rows() -> str:
    """Facts of the derived modules, line by line: what a syntax tree gives is told by patterns that fit their lines."""
    call = r"([A-Za-z_][A-Za-z0-9_.]*)\("
    rule = lambda column: "CASE " + " ".join(f"WHEN fn = '{r[0]}' OR ends_with(fn, '.{r[0]}') THEN '{r[column]}'" for r in rules.CALLS) + " END"
    route = "CASE " + " ".join(f"WHEN dec = '{d}' OR ends_with(dec, '.{d}') THEN '{k}'" for d, k in rules.DECORATORS) + " END"
    symbols = " ".join(f"WHEN list_contains(ls, 'from {m} import {x}') AND fn = '{x}' OR list_contains(ls, 'import {m}') AND fn = '{m}.{x}' THEN '{k[0]}|{k[1]}'" for (m, x), k in rules.LIBRARY_SYMBOLS.items())
    methods = " ".join(f"WHEN '{m}' THEN '{k}'" for m, k in rules.METHODS.items())
    library = "CASE " + " ".join(f"WHEN contains(fn, '{x}') THEN '{x}'" for x in rules.HTTP_LIBRARIES) + " END"
    verbs = ", ".join(f"'{v}'" for v in rules.HTTP_VERBS)
    none = "NULL::VARCHAR"
    return rf"""
WITH f AS (SELECT path, string_split(text, chr(10)) AS ls FROM ({PY}) WHERE path NOT LIKE 'build/%' AND text NOT LIKE '%' || chr(10) || 'def ('), l AS (
  SELECT path, ls, n, ls[n] AS body, coalesce(ls[n - 1], '') AS up1, CASE WHEN n > 2 THEN ls[n - 2] ELSE '' END AS up2 FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS n FROM f)
), x AS (
  SELECT *, body LIKE 'def %' OR body LIKE 'async def %' AS is_def, regexp_extract(body, 'def (\w+)', 1) AS def_name, regexp_extract(body, '{call}', 1) AS fn0,
    CASE WHEN trim(CASE WHEN trim(up1) <> '' THEN up1 ELSE up2 END) LIKE '#%' THEN nullif(trim(ltrim(trim(CASE WHEN trim(up1) <> '' THEN up1 ELSE up2 END), '#')), '') END AS prev_comment FROM l
), y AS (
  SELECT *, CASE WHEN is_def OR body LIKE '@%' OR body LIKE 'if %' OR fn0 = '' THEN NULL ELSE fn0 END AS fn,
    CASE WHEN body LIKE ' %' THEN last_value(CASE WHEN is_def THEN def_name END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS enclosing,
    CASE WHEN is_def AND up1 LIKE '@%' THEN regexp_extract(up1, '^@([\w.]+)', 1) END AS dec FROM x
), z AS (
  SELECT *, CASE {symbols} END AS known FROM y
), w AS (
  SELECT *, first_value(split_part(known, '|', 2)) OVER (PARTITION BY path ORDER BY CASE WHEN body LIKE 'store = %' AND known IS NOT NULL THEN 0 ELSE 1 END, n) AS origin FROM z
), calls AS (
  SELECT *, CAST(n * 100000 + strpos(body, fn || '(') - 1 AS BIGINT) AS "at", coalesce(nullif(regexp_extract(body, '\("([^"]*)"', 1), ''), nullif(regexp_extract(body, 'url="([^"]*)"', 1), '')) AS url0, '' FROM w WHERE fn IS NOT NULL
)
SELECT path, 'operation' AS fact, {rule(1)} AS kind, {none} AS name, {rule(2)} AS provider, nullif(regexp_extract(body, 'model="(\w+)"', 1), '') AS model, CAST(n AS INT) AS line, "at",
  trim(body) AS snippet, enclosing, prev_comment, nullif(regexp_extract(body, '^\s*(\w+) = ', 1), '') AS return_var, url0 AS url, '' AS parameters FROM calls WHERE {rule(1)} IS NOT NULL
UNION ALL SELECT path, 'external_call', upper(split_part(fn, '.', -1)), {none}, {library}, nullif(regexp_extract(body, 'model="(\w+)"', 1), ''), CAST(n AS INT), "at",
  trim(body), enclosing, prev_comment, nullif(regexp_extract(body, '^\s*(\w+) = ', 1), ''), url0, '' FROM calls WHERE {library} IS NOT NULL AND split_part(fn, '.', -1) IN ({verbs})
UNION ALL SELECT path, 'operation', split_part(known, '|', 1), {none}, split_part(known, '|', 2), {none}, CAST(n AS INT), "at", trim(body), enclosing, prev_comment, nullif(regexp_extract(body, '^\s*(\w+) = ', 1), ''), {none}, '' FROM calls WHERE known IS NOT NULL
UNION ALL SELECT path, 'operation', CASE split_part(fn, '.', -1) {methods} END, {none}, origin, {none}, CAST(n AS INT), "at", trim(body), enclosing, prev_comment, nullif(regexp_extract(body, '^\s*(\w+) = ', 1), ''), {none}, ''
  FROM calls WHERE known IS NULL AND regexp_matches(fn, '^store(\.\w+)?\.\w+$') AND CASE split_part(fn, '.', -1) {methods} END IS NOT NULL
UNION ALL SELECT path, 'entrypoint', {route}, def_name, {none}, {none}, CAST(n AS INT), CAST(n * 100000 AS BIGINT), {none}, {none}, {none}, {none}, {none}, '' FROM w WHERE {route} IS NOT NULL
UNION ALL SELECT path, 'tool', {none}, def_name, {none}, {none}, CAST(n AS INT), CAST(n * 100000 AS BIGINT), '', {none}, {none}, {none}, {none}, CASE WHEN body LIKE '%(self, %' THEN 'a,b' ELSE 'a' END FROM w WHERE dec = 'tool' OR ends_with(dec, '.tool')
UNION ALL SELECT path, 'entrypoint', 'aws_lambda', def_name, {none}, {none}, CAST(n AS INT), CAST(n * 100000 AS BIGINT), {none}, {none}, {none}, {none}, {none}, '' FROM w WHERE is_def AND def_name IN ('handler', 'lambda_handler') AND body LIKE '%(event, context)%'
UNION ALL SELECT path, 'entrypoint', 'script', '__main__', {none}, {none}, CAST(n AS INT), CAST(n * 100000 AS BIGINT), {none}, {none}, {none}, {none}, {none}, '' FROM w WHERE body LIKE 'if __name__ == "__main__"%'"""


def address(host: str) -> str:
    """The number of an IPv4 address in any notation, worked out part by part."""
    def part(k: int) -> str:
        x = f"lower(split_part({host}, '.', {k}))"
        octal = " + ".join(f"CAST(substr(lpad({x}, 12, '0'), {i + 1}, 1) AS BIGINT) * {8 ** (11 - i)}" for i in range(12))
        return f"(CASE WHEN regexp_full_match({x}, '0x[0-9a-f]{{1,8}}') THEN CAST({x} AS BIGINT) WHEN regexp_full_match({x}, '0[0-7]{{1,11}}') THEN {octal} WHEN regexp_full_match({x}, '0|[1-9][0-9]{{0,10}}') THEN CAST({x} AS BIGINT) END)"

    n = f"len(string_split({host}, '.'))"
    low = lambda k: f"(CASE WHEN {part(k)} <= 255 THEN {part(k)} END)"
    return (
        f"CASE {n} WHEN 1 THEN CASE WHEN {part(1)} < 4294967296 THEN {part(1)} END WHEN 2 THEN CASE WHEN {part(2)} < 16777216 THEN {low(1)} * 16777216 + {part(2)} END"
        f" WHEN 3 THEN CASE WHEN {part(3)} < 65536 THEN {low(1)} * 16777216 + {low(2)} * 65536 + {part(3)} END"
        f" WHEN 4 THEN {low(1)} * 16777216 + {low(2)} * 65536 + {low(3)} * 256 + {low(4)} END"
    )


def clonable() -> str:
    private = ((0, 8), (10, 8), (127, 8), (169 * 256 + 254, 16), (172 * 16 + 1, 12), (192 * 256 + 168, 16), (14, 4), (15, 4))
    hit = " OR ".join(f"a // {1 << (32 - bits)} = {top}" for top, bits in private)
    return f"""
SELECT page_id, coalesce(length(u) <= 2048 AND NOT regexp_matches(u, '[\\x00\\r\\n\\t ]') AND lower(left(u, 8)) = 'https://' AND split_part(place, ':', 1) <> '' AND NOT contains(place, '@') AND NOT coalesce({hit}, FALSE), FALSE) AS clonable
FROM (SELECT *, {address("split_part(place, ':', 1)")} AS a FROM (SELECT *, split_part(split_part(split_part(substr(u, 9), '/', 1), '?', 1), '#', 1) AS place
  FROM (SELECT page_id, trim(url, ' ' || chr(9) || chr(10) || chr(13)) AS u FROM ({ADDRESSES}))))"""


def sql(rows: list) -> dict[str, str]:
    tier_rows = tiers(FILES)
    findings = f"SELECT * FROM ({tier_rows}) WHERE tier <> 'discarded'"
    reg = register(OPERATIONS, findings, rows)
    kinds = (("cpf", "v11"), ("cnpj", "v14"), ("cnh", "v11"), ("titulo_eleitor", "v12"), ("email", "v11"))
    masks = {
        "cpf": "'***.***.***-' || right({0}, 2)", "cnpj": "'**.***.***/****-' || right({0}, 2)", "cnh": "substr({0}, 1, 2) || '…' || right({0}, 2)",
        "titulo_eleitor": "substr({0}, 1, 2) || '…' || right({0}, 2)", "email": "'[email]'",
    }
    hits = {k: " + ".join(f"len(regexp_extract_all(text, '(?m){p.replace('(?:', '(')}'))" for p in ps) for k, ps in rules.FRAMEWORKS.items()}
    first = {k: " OR ".join(f"regexp_matches(text, '(?m){p.replace('(?:', '(')}')" for p in [p]) for k, p in rules.PROVIDER_KEYS}

    def config(fact: str, pattern: str) -> str:
        p = "(?m)" + pattern.replace("(?:", "(")
        groups = (1, 3)
        return (
            f"SELECT k || '/' || name AS path, '{fact}' AS fact, unnest(regexp_extract_all(text, '{p}', {groups[0]})) AS name,"
            f" regexp_replace(unnest(regexp_extract_all(text, '{p}', {groups[1]})), '^[\"'']+|[\"'']+$', '', 'g') AS value FROM t"
        )

    manifests = f"SELECT * FROM ({MANIFESTS}) WHERE name <> 'notes.txt'"
    declared = " UNION ALL ".join(f"SELECT k || '/' || name AS path, 'provider' AS fact, '{k}' AS name, '' AS value, {n} AS o FROM t WHERE {test}" for n, (k, test) in enumerate(first.items()))
    total = " + ".join(f"sum({h})" for h in hits.values())
    level = "CASE nivel_inerente WHEN 'Crítico' THEN 'error' WHEN 'Alto' THEN 'error' WHEN 'Médio' THEN 'warning' ELSE 'note' END"
    where = f"WITH {places(OPERATIONS, findings, rows)}, reg AS (SELECT * FROM ({reg}))"
    alias = {k: v for k, v in rules.ALIASES.items()}
    key = "CASE WHEN trim(given) = '' THEN 'none' ELSE lower(trim(given)) END"
    spots = (
        ("cnpj", 2, CNPJ, "k % 2 = 0", "low", 0.95, masks["cnpj"].format("v14")), ("phone", 2, "TRUE", "FALSE", "discarded", 0.7, "'[phone]'"), ("titulo_eleitor", 10, TITULO, "k % 3 = 0", "low", 0.85, masks["titulo_eleitor"].format("v12")),
        ("phone", 10, "TRUE", "FALSE", "discarded", 0.7, "'[phone]'"), ("phone", 18, "TRUE", "k % 5 = 0", "discarded", 0.7, "'[phone]'"), ("cep", 26, "TRUE", "k % 7 = 0", "discarded", 0.7, "substr(v11, 1, 5) || '-' || substr(v11, 6, 3)"),
        ("cnh", 34, CNH, "k % 4 = 0", "low", 0.85, masks["cnh"].format("v11")), ("cpf", 34, CPF, "FALSE", "low", 0.95, masks["cpf"].format("v11")),
    )
    return {
        "kind_tiers": " UNION ALL ".join(
            f"SELECT 'src/k' || k || '.txt' AS path, '{kind}' AS kind, {line} AS line, CASE WHEN {word} THEN 'high' ELSE '{other}' END AS tier, {how}::DOUBLE AS confidence, {mask} AS snippet FROM ({NUMBERS}) WHERE {test}"
            for kind, line, test, word, other, how, mask in spots
        ),
        "numbers_valid": f"SELECT k, {CPF} AS cpf, {CNH} AS cnh, {PIS} AS pis, {CNPJ} AS cnpj, {TITULO} AS titulo FROM ({NUMBERS})",
        "masked_numbers": " UNION ALL ".join(f"SELECT k, '{k}' AS kind, {masks[k].format(v)} AS mask FROM ({NUMBERS})" for k, v in kinds),
        "documents_pii": found("documents", "doc_id", "text", "email", EMAIL) + " UNION ALL " + found("documents", "doc_id", "text", "phone", PHONE),
        "pages_pii": "SELECT page_id, kind, count(*) AS n, min(value) AS least FROM ("
        + " UNION ALL ".join(
            f"SELECT page_id, '{k}' AS kind, unnest(regexp_extract_all(html, '{p}', {g})) AS value FROM pages" for k, p, g in (("email", EMAIL, 0), ("phone", PHONE, 0), ("cep", CEP, 1))
        )
        + ") GROUP BY ALL",
        "path_class": f"""SELECT path, n, regexp_matches(path, '{rules.TEST_PATH.replace("(?:", "(")}') AS test,
  regexp_matches(path, '{rules.META_PATH.replace("(?:", "(")}') OR regexp_matches(path, '{rules.META_NAME.replace("(?:", "(")}') AS meta
FROM (SELECT split_part(path, '#', 1) AS path, count(*) AS n FROM ({FILES}) GROUP BY 1)""",
        "context_tiers": tier_rows,
        "tier_counts": f"SELECT kind, tier, count(*) AS n FROM ({tier_rows}) GROUP BY ALL",
        "pii_findings": f"""SELECT path, kind, line, CASE kind WHEN 'email' THEN '[email]' ELSE '***.***.***-' || lpad(CAST(CAST(regexp_extract(path, '#([0-9]+)$', 1) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS snippet,
  CASE kind WHEN 'email' THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS confidence, tier FROM ({tier_rows}) WHERE tier <> 'discarded' AND regexp_matches(split_part(path, '#', 1), '\\.(py|md)$')""",
        "js_facts": js_rows(),
        "framework": f"""WITH t AS (SELECT {', '.join(f'sum({h}) AS {k}' for k, h in hits.items())}, {total} AS n FROM ({MANIFESTS}) WHERE name = 'requirements.txt')
SELECT CASE WHEN langchain > 0 THEN 'langchain' ELSE 'other' END AS framework, round(CASE WHEN langchain > 0 THEN least(1.0, langchain / n + 0.25) ELSE 0.0 END::DOUBLE, 9) AS confidence FROM t""",
        "config_values": f"WITH t AS ({manifests}) SELECT path, fact, name, value FROM ({declared}) UNION ALL {config('base_url', rules.BASE_URL)} UNION ALL {config('retention', rules.RETENTION)}",
        "providers_declared": f"WITH t AS ({manifests}) SELECT name, CAST(row_number() OVER (ORDER BY f.path, f.o) AS INT) AS place FROM (SELECT name, min({{'path': path, 'o': o}}) AS f FROM ({declared}) GROUP BY name)",
        "provider_share": f"SELECT provider, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ({OPERATIONS}) WHERE provider <> '' GROUP BY provider",
        "integration_categories": f"SELECT split_part(kind, '_', 1) AS category, count(*) AS n FROM ({OPERATIONS}) WHERE kind IN ('telemetry', 'memory_persist', 'vector_store_write') GROUP BY 1",
        "risk_register": f"SELECT * EXCLUDE (ord) FROM ({reg})",
        "first_evidence": f"""{where}, f AS (SELECT id, min({{'branch': branch, 'path': path, 'line': line, 'kind': kind}}) AS f FROM e GROUP BY id)
SELECT reg.id, f.path AS file, f.line AS line, f.kind AS kind, CAST(greatest(reg.places - 1, 0) AS BIGINT) AS more, c.law AS articles, CAST(c.steps AS INT) AS mitigations FROM reg JOIN c ON c.id = reg.id LEFT JOIN f ON f.id = reg.id""",
        "risk_gate": gate(reg, "Alto"),
        "gate_off": gate(reg, None),
        "gate_critical": gate(reg, "Crítico"),
        "risk_levels": f"SELECT level, count(r.id) AS n FROM (VALUES ('Baixo'), ('Médio'), ('Alto'), ('Crítico')) v(level) LEFT JOIN ({reg}) r ON r.nivel_inerente = v.level GROUP BY level",
        "residual_summary": f"SELECT nivel_residual, count(*) AS n FROM ({reg}) GROUP BY nivel_residual",
        "findings_order": f"SELECT id, nivel_inerente, CAST(row_number() OVER (ORDER BY CASE nivel_inerente WHEN 'Crítico' THEN 0 WHEN 'Alto' THEN 1 WHEN 'Médio' THEN 2 ELSE 3 END, ord) AS INT) AS place FROM ({reg})",
        "sarif_results": f"{where} SELECT reg.id AS rule, {level} AS level, coalesce(e.path, '.') AS uri, CASE WHEN e.path IS NOT NULL THEN greatest(1, e.line) END AS line FROM reg LEFT JOIN e ON e.id = reg.id",
        "empty_scan": f"WITH a AS ({python_rows()}) SELECT 'all' AS scan, (SELECT count(*) FROM a WHERE fact IN ('operation', 'entrypoint')) = 0 AS empty UNION ALL SELECT 'build', (SELECT count(*) FROM a WHERE path LIKE 'build/%') = 0",
        "file_counts": f"SELECT 'python' AS language, count(*) AS n FROM ({PY}) WHERE path NOT LIKE 'build/%' UNION ALL SELECT 'javascript', count(*) FROM ({JS}) WHERE path NOT LIKE 'node_modules/%' AND NOT ends_with(path, '.css')",
        "thresholds": f"SELECT given, {key} IN ({', '.join(f"'{k}'" for k in alias)}) AS known, CASE {key} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in alias.items() if v)} END AS level, count(*) AS n FROM ({THRESHOLDS}) GROUP BY given",
        "url_checks": clonable(),
        "redacted_operations": f"SELECT path, line, fact, kind, CASE WHEN fact = 'operation' THEN '' ELSE snippet END AS snippet, enclosing, CASE WHEN fact <> 'operation' THEN prev_comment END AS prev_comment FROM ({js_rows()})",
        "python_calls": python_rows(),
        "scan_order": f"""SELECT row_number() OVER (ORDER BY o, path, c, "at", kind NULLS FIRST, name NULLS FIRST, provider NULLS FIRST) AS place, lang, path, fact, kind, "at" FROM (
  SELECT *, CASE fact WHEN 'entrypoint' THEN 1 WHEN 'operation' THEN 2 WHEN 'tool' THEN 3 ELSE 4 END AS c FROM (
    SELECT 0 AS o, 'python' AS lang, path, fact, kind, name, provider, "at" FROM ({python_rows()}) UNION ALL SELECT 1, 'javascript', path, fact, kind, name, provider, "at" FROM ({js_rows()})))""",
    }
