"""Personal-data findings: candidates, check digits, context tiers and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import columns, rules
from riskweave.functions.columns import bound, literal
from riskweave.operators.matches import all_found, found_in, matches


def text_files(files: DataFrame) -> DataFrame:
    """Files that are searched for personal data."""
    suffix = F.regexp_extract("name", r"(?s)^.+(\.[^.]+)$", 1)
    return files.where(
        (suffix.isin(*rules.TEXT_SUFFIXES) | F.col("name").isin(*rules.TEXT_NAMES)) & ~F.arrays_overlap("parts", F.lit(list(rules.TEXT_IGNORED)))
    )


def _hints(text: str) -> dict[str, str]:
    """Cheaper tests that every text with a match of the kind passes."""
    return {"email": f"contains({text}, '@')", "phone": f"{text} RLIKE {literal(r'(?U)\d{4}-?\d{4}')}", "cep": f"{text} RLIKE {literal(r'(?U)\d-\d{3}')}"}


def candidate_matches(df: DataFrame, keys: list[str], text: str, kinds: tuple[str, ...]) -> DataFrame:
    """keys, kind, seq, value, line, at of all matches of some kinds, whatever their check digits."""
    wanted = [(kind, pattern, 0) for kind, pattern, *_ in rules.CANDIDATES if kind in kinds]
    return matches(df, keys, text, wanted, _hints(f"`{text}`")).drop("groups")


def candidates(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """path, kind, seq, value, line of every candidate whose check digits, if its kind has any, are right."""
    if "piece" not in files.columns:
        found = candidate_matches(files, ["path"], "text", kinds or KINDS).drop("at")
        return found.where(columns.is_valid(F.col("kind"), F.col("value")))
    every = _own(candidate_matches(files, ["path", *PIECE], "text", kinds or KINDS))
    found = every.where(columns.is_valid(F.col("kind"), F.col("value")))
    return _in_file(found, every, files).select("path", "kind", "seq", "value", "line")


KINDS = tuple(kind for kind, *_ in rules.CANDIDATES)


def _first(lines: str, test: str) -> str:
    """SQL of what ``test``, SQL over a line ``l``, says of the first line of which it says anything."""
    return f"get(filter(transform({lines}, l -> {test}), h -> h IS NOT NULL), 0)"


PIECE = ["piece", "pieces", "own_from", "own_to"]


def _own(rows: DataFrame) -> DataFrame:
    """Without the matches that lie in the lines around a piece, which belong to its neighbours."""
    return rows.where((F.col("at") >= F.col("own_from")) & (F.col("at") < F.col("own_to"))) if "piece" in rows.columns else rows


def _in_file(rows: DataFrame, every: DataFrame, files: DataFrame) -> DataFrame:
    """Lines and numbers of matches in their file instead of their piece. ``every``: all matches of the pieces, valid or not.

    The line breaks, and the matches of a kind, that come before a piece are running sums over the file's pieces; only counts are
    summed, no texts, and only for files that have several pieces.
    """
    by = lambda *keys: Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    split = F.col("pieces") > 1
    breaks = files.where(split).select(F.col("path").alias("_path"), "piece", "halo_breaks", F.coalesce(F.sum("own_breaks").over(by("path")), F.lit(0)).alias("_before"))
    breaks = breaks.select("_path", F.col("piece").alias("_piece"), (F.col("_before") - F.col("halo_breaks")).cast("int").alias("_lines"))
    counts = every.where(split).groupBy("path", "kind", "piece").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"))
    counts = counts.select(
        F.col("path").alias("_p"), F.col("kind").alias("_k"), F.col("piece").alias("_of"), (F.coalesce(F.sum("_n").over(by("path", "kind")), F.lit(0)) - F.col("_first")).cast("int").alias("_seq"),
    )
    rows = rows.join(breaks, (F.col("path") == F.col("_path")) & (F.col("piece") == F.col("_piece")), "left")
    rows = rows.join(counts, (F.col("path") == F.col("_p")) & (F.col("kind") == F.col("_k")) & (F.col("piece") == F.col("_of")), "left")
    none = F.lit(0)
    return rows.withColumns({"line": F.col("line") + F.coalesce("_lines", none), "seq": F.col("seq") + F.coalesce("_seq", none)})


def tiered(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Candidates with confidence, tier (high, low, discarded) and the signals that led to it.

    Each match takes the lines around it from its own text, so nothing is joined or shuffled; only for files in pieces, lines and
    numbers are completed with what comes before the piece. A text is put into lower case once, and lines are looked at one by one
    only where the whole text has a marker or a pattern in it. Keyword and marker are made with the match, before the rows are:
    a filter by tier, which Spark moves down and repeats, then finds plain columns.
    """
    in_pieces = "piece" in files.columns
    wanted = [c for c in rules.CANDIDATES if c[0] in (kinds or KINDS)]
    found = all_found([found_in("text", kind, pattern, hint=_hints("text").get(kind)) for kind, pattern, *_ in wanted])
    if not in_pieces:  # a piece's other matches count too
        found = f"filter({found}, m -> {columns.valid_sql('m.kind', 'm.value')})"
    keys = ["path", *(PIECE if in_pieces else [])]
    of_path = {"test": columns.is_test_path(F.col("path")), "meta": columns.is_meta_path(F.col("path"))}
    of_text = {"marked": F.col("low").rlike(columns.ANY_MARKER), "regexy": columns.is_regex_line(F.col("text"))}
    texts = files.select(*keys, "text", F.lower("text").alias("low")).withColumns(of_path | of_text)
    part = lambda lines, n: f"slice({lines}, greatest(1, m.line - {n}), m.line + {n + 1} - greatest(1, m.line - {n}))"
    keyword = " ".join(f"WHEN '{kind}' THEN {columns.keyword_near_sql('near', kind)}" for kind, *_ in wanted)
    keyword = bound(f"array_join({part('s.lows', rules.LINES_AROUND)}, '\\n')", "near", f"CASE m.kind {keyword} END")
    mark = f"CASE WHEN marked THEN {_first(part('s.ls', rules.MARKER_LINES), columns.marker_sql('l'))} END"
    is_regex = f"coalesce(regexy AND get(s.ls, m.line - 1) RLIKE {literal(rules.REGEX_ARTIFACT)}, false)"
    row = f"named_struct('kind', m.kind, 'seq', m.seq, 'value', m.value, 'line', m.line, 'at', m.at, 'keyword', {keyword}, 'mark', {mark}, 'is_regex', {is_regex})"
    split = "named_struct('lows', split(low, '\\n', -1), 'ls', CASE WHEN marked OR regexy THEN split(text, '\\n', -1) END)"
    placed = bound(found, "found", f"CASE WHEN size(found) > 0 THEN {bound(split, 's', f'transform(found, m -> {row})')} END")
    every = _own(texts.select(*keys, *of_path, F.explode(F.expr(placed)).alias("m")).select(*keys, *of_path, "m.*"))
    rows = every.where(columns.is_valid(F.col("kind"), F.col("value"))) if in_pieces else every
    checked, confidence = F.lit(False), F.lit(0.0)
    for kind, _, check, how in wanted:
        is_kind = F.col("kind") == kind
        checked = F.when(is_kind, F.lit(check)).otherwise(checked)
        confidence = F.when(is_kind, F.lit(how)).otherwise(confidence)
    keyword = F.col("keyword")
    compromised = F.col("mark").isNotNull() | F.col("test") | F.col("meta") | F.col("is_regex")
    level = columns.tier(keyword.isNotNull(), compromised, checked)
    signals = F.array_compact(
        F.array(
            F.concat(F.lit("keyword:"), keyword),
            F.col("mark"),
            F.when(F.col("test"), "test_path"),
            F.when(F.col("meta"), "meta_path"),
            F.when(F.col("is_regex"), "regex_artifact"),
            F.when(keyword.isNull() & ~compromised & checked, "checksum_only"),
        )
    )
    if in_pieces:
        rows = _in_file(rows, every.select("path", "pieces", "piece", "kind", "seq"), files)
    return rows.select(
        "path", "kind", "seq", "value", "line", confidence.alias("confidence"), level.alias("tier"), signals.alias("signals")
    )


def scan_pii(files: DataFrame, require_context: bool = True) -> DataFrame:
    """path, kind, line, snippet (masked), confidence, tier, signals; discarded findings are left out."""
    some = text_files(files.where("piece >= 0") if "piece" in files.columns else files)
    if require_context:
        rows = tiered(some).where("tier != 'discarded'")
    else:
        how = F.lit(0.0)
        for kind, _, _, value in rules.CANDIDATES:
            how = F.when(F.col("kind") == kind, F.lit(value)).otherwise(how)
        rows = candidates(some).withColumns({"confidence": how, "tier": F.lit("high"), "signals": F.array().cast("array<string>")})
    return rows.select("path", "kind", "seq", "line", columns.masked(F.col("kind"), F.col("value")).alias("snippet"), "confidence", "tier", "signals")
