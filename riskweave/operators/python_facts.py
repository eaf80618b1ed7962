"""Facts of Python files. Only the syntax tree needs Python: it yields plain rows, and Spark applies the rule tables.

A file is parsed once, and its tree is walked with a stack of its own, so expressions may be as deep as the parser takes. A file
that doesn't parse gives no facts, as it can't run either; one that is too deep or too large for the parser gives a row with
the fact ``unread``, which a scan must not pass over.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskweave.functions import rules
from riskweave.operators.facts import FACT

RAW = "path string, what string, dotted string, name string, model string, line int, at long, snippet string, enclosing string, prev_comment string, return_var string, url string, parameters array<string>, kind string, provider string"


def python_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("name").endswith(".py") & ~F.arrays_overlap("parts", F.lit(list(rules.PY_IGNORED))))


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a name, an attribute or the function of a call in the chain; None for other beginnings, but what follows a
    call of something else is a name of its own."""
    parts: list[str] = []
    called = 0  # how many parts follow the first call of the chain
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
        if isinstance(node, ast.Call):
            called, node = len(parts), node.func
    if isinstance(node, ast.Name):
        parts.append(node.id)
    else:
        parts = parts[:called]
    return ".".join(reversed(parts)) or None


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


class Reader:
    """Rows of RAW for one module."""

    def __init__(self, path: str, text: str):
        self.path, self.lines, self.rows = path, text.split("\n"), []
        self.targets: dict[int, str | None] = {}  # of calls that are assigned
        self.symbols: dict[str, str] = {}  # imported name -> module
        self.modules: dict[str, str] = {}  # imported module's name here -> its first part
        self.origins: dict[str, str] = {}  # variable -> provider

    def read(self, tree: ast.Module) -> list[dict]:
        nodes: list[tuple[ast.AST, str | None]] = []  # with the name of the function around
        left: list[tuple[ast.AST, str | None]] = [(tree, None)]
        while left:
            node, function = left.pop()
            nodes.append((node, function))
            # Decorators and defaults count as inside, as they are below the function's node.
            inner = node.name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else function
            left += [(child, inner) for child in ast.iter_child_nodes(node)]
        walked = list(ast.walk(tree))
        for node in walked:
            if isinstance(node, ast.ImportFrom):
                self.symbols |= {a.asname or a.name: node.module or "" for a in node.names}
            elif isinstance(node, ast.Import):
                self.modules |= {a.asname or a.name.split(".")[0]: a.name.split(".")[0] for a in node.names}
            elif isinstance(node, ast.Assign):
                self.assign(node.value, self.target_of(node.targets[0]))
            elif isinstance(node, ast.AnnAssign):
                self.assign(node.value, node.target.id if isinstance(node.target, ast.Name) else None)
        assigned = [n for n in walked if isinstance(n, ast.Assign)]
        for _ in range(3):
            known = dict(self.origins)
            for node in assigned:
                provider = self.provider_of(node.value)
                if provider:
                    self.origins |= {t.id: provider for t in node.targets if isinstance(t, ast.Name)}
            if known == self.origins:
                break
        for node, function in nodes:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(node)
            elif isinstance(node, ast.If):
                self.guard(node)
            elif isinstance(node, ast.Call):
                self.call(node, function)
        return self.rows

    def add(self, what: str, node: ast.AST, **values: object) -> None:
        self.rows.append({"path": self.path, "what": what, "line": node.lineno, "at": node.lineno * 100_000 + node.col_offset, **values})

    def symbol(self, call: ast.Call) -> tuple[str, str] | None:
        """Kind and provider of a call of a known library's symbol."""
        func = call.func
        if isinstance(func, ast.Name):
            return rules.LIBRARY_SYMBOLS.get((self.symbols.get(func.id), func.id))
        if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name):
            return rules.LIBRARY_SYMBOLS.get((self.modules.get(func.value.id), func.attr))
        return None

    def provider_of(self, value: ast.AST) -> str | None:
        if isinstance(value, ast.Call):
            known = self.symbol(value)
            if known:
                return known[1]
            value = value.func
        if not isinstance(value, ast.Attribute):
            return None
        while isinstance(value, ast.Attribute):
            value = value.value
        return self.origins.get(value.id) if isinstance(value, ast.Name) else None

    @staticmethod
    def target_of(target: ast.AST) -> str | None:
        if isinstance(target, ast.Tuple) and target.elts and isinstance(target.elts[0], ast.Name):
            target = target.elts[0]
        return target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None

    def assign(self, value: ast.AST | None, name: str | None) -> None:
        value = value.value if isinstance(value, ast.Await) else value
        if isinstance(value, ast.Call):
            self.targets[id(value)] = name

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        names = [dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        for name in names:
            if name:
                self.add("decorator", node, dotted=name, name=node.name)
        if any(n and (n == "tool" or n.endswith(".tool")) for n in names):
            parameters = [a.arg for a in node.args.args if a.arg != "self"]
            self.add("tool", node, name=node.name, snippet=ast.get_docstring(node) or "", parameters=parameters)
        if node.name in ("lambda_handler", "handler") and [a.arg for a in node.args.args[:2]] == ["event", "context"]:
            self.add("entrypoint", node, kind="aws_lambda", name=node.name)

    def guard(self, node: ast.If) -> None:
        test = node.test
        if isinstance(test, ast.Compare) and isinstance(test.left, ast.Name) and test.left.id == "__name__":
            if any(text_of(c) == "__main__" for c in test.comparators):
                self.add("entrypoint", node, kind="script", name="__main__")

    def call(self, node: ast.Call, function: str | None) -> None:
        place = {"snippet": self.lines[node.lineno - 1].strip(), "enclosing": function, "prev_comment": self.comment_above(node.lineno), "return_var": self.targets.get(id(node))}
        name = dotted(node.func)
        given = {k.arg: k.value for k in node.keywords}
        if name:
            url = text_of(node.args[0]) if node.args else None
            if url is None and isinstance(given.get("url"), ast.Constant):
                url = str(given["url"].value)
            self.add("call", node, dotted=name, model=text_of(given.get("model")), url=url, **place)
        known = self.symbol(node)
        if not known and isinstance(node.func, ast.Attribute) and node.func.attr in rules.METHODS:
            owner = node.func.value
            owner = owner.value if isinstance(owner, ast.Attribute) else owner
            provider = self.origins.get(owner.id) if isinstance(owner, ast.Name) else None
            known = (rules.METHODS[node.func.attr], provider) if provider else None
        if known:
            self.add("operation", node, kind=known[0], provider=known[1], **place)

    def comment_above(self, line: int) -> str | None:
        for body in (self.lines[n].strip() for n in (line - 2, line - 3) if 0 <= n < len(self.lines)):
            if body:
                return (body.lstrip("#").strip() or None) if body.startswith("#") else None
        return None


ROWS = 10_000  # of a batch


def syntax_rows(files: DataFrame) -> DataFrame:
    """Rows of RAW. One parse serves all facts."""
    schema = to_arrow_schema(StructType.fromDDL(RAW))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text")), strict=True):
                try:
                    rows += Reader(path, text or "").read(ast.parse(text or ""))
                except SyntaxError:
                    continue
                except (RecursionError, MemoryError) as e:
                    rows.append({"path": path, "what": "unread", "line": 1, "at": 0, "snippet": str(e) or type(e).__name__})
                if len(rows) >= ROWS:
                    yield from pa.Table.from_pylist(rows, schema).to_batches(ROWS)
                    rows = []
        if rows:
            yield from pa.Table.from_pylist(rows, schema).to_batches(ROWS)

    return files.select("path", "text").mapInArrow(read, RAW)


def ends_with(name: Column, suffix: str) -> Column:
    return (name == suffix) | name.endswith("." + suffix)


def first_rule(name: Column, table: list[tuple]) -> Column:
    """Number of the first rule whose suffix the dotted name ends with."""
    out = F.lit(None).cast("int")
    for n in range(len(table) - 1, -1, -1):
        out = F.when(ends_with(name, table[n][0]), n).otherwise(out)
    return out


def _picked(rule: Column, table: list[tuple], column: int) -> Column:
    return F.get(F.array(*[F.lit(row[column]) for row in table]), rule)


def python_facts(files: DataFrame) -> DataFrame:
    """Rows of FACT for Python files: each row of the syntax tree gives its facts (a call up to two) in one projection."""
    rows = syntax_rows(python_files(files))
    name, what = F.col("dotted"), F.col("what")
    verb = F.element_at(F.split("dotted", r"\."), -1)
    library = F.lit(None).cast("string")
    for known in reversed(rules.HTTP_LIBRARIES):
        library = F.when(name.contains(known), known).otherwise(library)
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"call": F.when(what == "call", first_rule(name, rules.CALLS)), "route": F.when(what == "decorator", first_rule(name, rules.DECORATORS)), "library": F.when(what == "call", library)})
    fact = lambda kind_of, kind, provider: F.struct(F.lit(kind_of).alias("fact"), kind.alias("kind"), provider.alias("provider"))
    call, route = F.col("call"), F.col("route")
    found = [
        F.when(call.isNotNull(), fact("operation", _picked(call, rules.CALLS, 1), _picked(call, rules.CALLS, 2))),
        F.when(F.col("library").isNotNull() & verb.isin(*rules.HTTP_VERBS), fact("external_call", F.upper(verb), F.col("library"))),
        F.when(route.isNotNull(), fact("entrypoint", _picked(route, rules.DECORATORS, 1), none)),
        F.when(what.isin("tool", "entrypoint", "operation", "unread"), F.struct(what.alias("fact"), F.col("kind").alias("kind"), F.col("provider").alias("provider"))),
    ]
    rows = rows.withColumn("_found", F.explode(F.array_compact(F.array(*found))))
    parameters = F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters")
    columns = [part.split()[0] for part in FACT.split(", ")]
    return rows.select(*[F.col(f"_found.{c}").alias(c) if c in ("fact", "kind", "provider") else parameters if c == "parameters" else F.col(c) for c in columns])
