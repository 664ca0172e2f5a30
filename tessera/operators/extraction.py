"""Symbols, references and keys from file contents.

Dotenv and import lists are DataFrame expressions (Markdown is in ``units``).
Python sources are parsed with the standard library's ``ast`` in Arrow batches; a
file that can't be parsed gives no rows and a diagnostic, never a failed job.
``sourcecode`` reads other languages, and files that break off.
"""

from __future__ import annotations

import ast
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SYMBOLS = "path string, ordinal int, name string, kind string, depth int, first_line int, last_line int"
REFERENCES = "path string, name string, kind string, line int, enclosing int"


class _Visitor(ast.NodeVisitor):
    def __init__(self) -> None:
        self.symbols: list[tuple] = []
        self.references: list[tuple] = []
        self.stack: list[int] = []

    def _define(self, node, kind: str) -> None:
        self.symbols.append((len(self.symbols), node.name, kind, len(self.stack), node.lineno, node.end_lineno))
        self.stack.append(len(self.symbols) - 1)
        self.generic_visit(node)
        self.stack.pop()

    def visit_ClassDef(self, node) -> None:  # noqa: N802
        self._define(node, "class")

    def visit_FunctionDef(self, node) -> None:  # noqa: N802
        self._define(node, "method" if self.stack and self.symbols[self.stack[-1]][2] == "class" else "function")

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def _refer(self, name: str, kind: str, line: int) -> None:
        self.references.append((name, kind, line, self.stack[-1] if self.stack else None))

    def visit_Call(self, node) -> None:  # noqa: N802
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if name:
            self._refer(name, "call", node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:  # noqa: N802
        for a in node.names:
            self._refer(a.name, "import", node.lineno)

    def visit_ImportFrom(self, node) -> None:  # noqa: N802
        for a in node.names:
            self._refer(f"{node.module or ''}.{a.name}".strip("."), "import", node.lineno)


def _parsed(content: str | None) -> _Visitor | None:
    try:
        found = _Visitor()
        found.visit(ast.parse(content or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return found


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *s) for p, c in zip(f.path, f.content, strict=True) if (v := _parsed(c)) for s in v.symbols], columns=["path", "ordinal", "name", "kind", "depth", "first_line", "last_line"])

    return files.select("path", "content").mapInPandas(run, SYMBOLS)


def python_references(files: DataFrame) -> DataFrame:
    """References of Python files: calls and imports with the ordinal of the symbol around them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, c in zip(f.path, f.content, strict=True) if (v := _parsed(c)) for r in v.references]
            out = pd.DataFrame(rows, columns=["path", "name", "kind", "line", "enclosing"])
            yield out.astype({"enclosing": "Int32"})

    return files.select("path", "content").mapInPandas(run, REFERENCES)


def python_status(files: DataFrame) -> DataFrame:
    """Whether each Python file can be parsed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f.path, "status": ["failed" if _parsed(c) is None else "processed" for c in f.content]})

    return files.select("path", "content").mapInPandas(run, "path string, status string")


def _yaml(text: str):
    import yaml  # not everywhere; sources of this format need it

    return yaml.safe_load(text)


PARSERS = {"json": lambda t: json.loads(t or "null"), "toml": tomllib.loads, "yaml": _yaml}


def flatten(text: str | None, *, depth: int = 6, items: int = 20, language: str = "json") -> list[tuple[str, str]]:
    """Dotted keys and values of a configuration text, to a depth and a number of array items; damaged text gives none."""
    out: list[tuple[str, str]] = []

    def walk(x, at: str, left: int) -> None:
        if isinstance(x, dict) and left:
            for k, v in x.items():
                walk(v, f"{at}.{k}" if at else str(k), left - 1)
        elif isinstance(x, list) and left:
            for i, v in enumerate(x[:items]):
                walk(v, f"{at}[{i}]", left - 1)
        elif at:
            out.append((at, x if isinstance(x, str) else json.dumps(x, default=str)))

    try:
        tree = PARSERS[language](text or "")
        walk(tree, "", depth)
    except ImportError:
        raise
    except Exception:  # each parser has errors of its own; a damaged file is no failed job
        return []
    return out


def json_keys(files: DataFrame, id_col: str = "path", text_col: str = "content", *, language: str = "json") -> DataFrame:
    """A row for each dotted key (id, key, value) of JSON (or TOML, or YAML) texts; damaged texts give none.

    JSON stays in the JVM, see :func:`json_fields`.
    """
    if language == "json":
        return json_fields(files, id_col, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, k, v) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for k, v in flatten(t, language=language)], columns=["id", "key", "value"])

    return files.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, key string, value string")


def plain_json(text: Column) -> Column:
    """JSON without comments and trailing commas; what stands in strings stays."""
    string = r'"(?:[^"\\]|\\.)*"'
    bare = F.regexp_replace(text, rf"({string})|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(bare, rf"({string})|,(?=\s*[}}\]])", "$1")


def json_fields(files: DataFrame, id_col: str = "path", text_col: str = "content", *, depth: int = 6, items: int = 20) -> DataFrame:
    """Dotted keys and values (id, key, value) of JSON texts with comments and trailing commas, to a depth and a number of array items.

    A text becomes a variant once; each level opens the objects and arrays of the
    level before and leaves all else as it is. Texts of values stand without
    quotes, what lies deeper as JSON. Empty objects and arrays give no row, nor do
    texts that are no JSON or repeat a key.
    """
    tvf = files.sparkSession.tvf
    rows = files.select(F.col(id_col).cast("string").alias("id"), F.lit("").alias("key"), F.try_parse_json(plain_json(F.col(text_col))).alias("v")).where("v IS NOT NULL")
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    for _ in range(depth):
        opened = rows.lateralJoin(tvf.variant_explode_outer(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        inner = F.when(F.col("_key").isNull(), F.concat("key", F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).when(F.col("key") == "", F.col("_key")).otherwise(F.concat("key", F.lit("."), "_key"))
        kept = opened.where((F.col("_pos").isNull() & ~nested) | F.col("_key").isNotNull() | (F.col("_pos") < items))
        rows = kept.select("id", F.when(F.col("_pos").isNull(), F.col("key")).otherwise(inner).alias("key"), F.when(F.col("_pos").isNull(), F.col("v")).otherwise(F.col("_value")).alias("v"))
    told = F.when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string")).otherwise(F.to_json("v"))
    return rows.where("key <> ''").select("id", "key", told.alias("value"))


def dotenv(lines: DataFrame) -> DataFrame:
    """Keys and values of dotenv lines; comments and blanks are left out."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(.*?)\s*$"
    key = F.regexp_extract("line", pattern, 1)
    value = F.regexp_replace(F.regexp_extract("line", pattern, 2), "^(['\"])(.*)\\1$", "$2")
    return lines.select("path", "line_no", key.alias("key"), value.alias("value")).where("key <> ''")


def expand_imports(imports: DataFrame) -> DataFrame:
    """``a::{b,c}`` as a::b and a::c; an import without a group stays."""
    group = F.regexp_extract("name", r"^(.*)\{([^{}]*)\}$", 2)
    head = F.regexp_extract("name", r"^(.*)\{([^{}]*)\}$", 1)
    opened = F.when(group != "", F.transform(F.split(group, ","), lambda x: F.concat(head, F.trim(x)))).otherwise(F.array("name"))
    return imports.withColumn("name", F.explode(opened))


def signatures(lines: DataFrame) -> DataFrame:
    """Definitions found by pattern where no grammar is at hand."""
    pattern = r"^\s*(?:(?:pub|public|private|protected|static|export|async|final|abstract)\s+)*(fn|func|function|def|class|struct|enum|trait|interface|impl|module|type)\s+([A-Za-z_]\w*)"
    return lines.select("path", "line_no", F.regexp_extract("line", pattern, 1).alias("kind"), F.regexp_extract("line", pattern, 2).alias("name")).where("name <> ''")


def structural(files: DataFrame, node: str, name: str | None = None) -> DataFrame:
    """Python nodes of a type (an ``ast`` class), of a name if one is given: path, first and last line, code."""
    kind = getattr(ast, node, None)
    if not (isinstance(kind, type) and issubclass(kind, ast.AST)):
        raise ValueError(f"{node} is no node type")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f.path, f.content, strict=True):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for x in ast.walk(tree):
                    own = getattr(x, "name", None) or getattr(getattr(x, "func", None), "id", None)
                    if isinstance(x, kind) and hasattr(x, "lineno") and (name is None or own == name):
                        rows.append((path, x.lineno, x.end_lineno, ast.get_source_segment(content, x)))
            yield pd.DataFrame(rows, columns=["path", "first_line", "last_line", "code"])

    return files.select("path", "content").mapInPandas(run, "path string, first_line int, last_line int, code string")


def python_aliases(files: DataFrame) -> DataFrame:
    """Names that Python files import under others: path, alias, original."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f.path, f.content, strict=True):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for x in ast.walk(tree):
                    if isinstance(x, (ast.Import, ast.ImportFrom)):
                        rows += [(path, a.asname, a.name) for a in x.names if a.asname and a.asname != a.name]
            yield pd.DataFrame(rows, columns=["path", "alias", "original"])

    return files.select("path", "content").mapInPandas(run, "path string, alias string, original string")


def workflow_facts(keys: DataFrame) -> DataFrame:
    """Triggers, jobs, needs, matrices and steps of CI workflows from their dotted keys (id, key, value).

    A file with ``on`` and ``jobs`` is a workflow. (YAML reads a bare ``on`` as true.)
    """
    top = F.lower(F.regexp_extract("key", r"^([^.\[]+)", 1))
    is_on = top.isin("on", "true")
    flows = keys.groupBy("id").agg(F.max(is_on).alias("_on"), F.max(top == "jobs").alias("_jobs")).where("_on AND _jobs").select("id")
    job = F.regexp_extract("key", r"^jobs\.([^.\[]+)", 1)
    rest = F.regexp_extract("key", r"^jobs\.[^.\[]+\.?(.*)$", 1)
    trigger = F.regexp_extract("key", r"^[^.\[]+\.([^.\[]+)", 1)
    named = F.when(trigger != "", trigger).otherwise(F.col("value"))
    fact = (
        F.when(is_on, F.struct(F.lit("trigger").alias("fact"), F.lit("").alias("job"), named.alias("value")))
        .when((job != "") & rest.rlike(r"^needs(\[|$)"), F.struct(F.lit("needs").alias("fact"), job.alias("job"), F.col("value")))
        .when((job != "") & rest.startswith("strategy.matrix."), F.struct(F.lit("matrix").alias("fact"), job.alias("job"), F.concat(F.regexp_extract(rest, r"^strategy\.matrix\.([^.\[]+)", 1), F.lit("="), F.col("value")).alias("value")))
        .when((job != "") & rest.rlike(r"^steps\[\d+\]\.(uses|run|name)$"), F.struct(F.lit("step").alias("fact"), job.alias("job"), F.concat(F.regexp_extract(rest, r"\.(\w+)$", 1), F.lit("="), F.substring("value", 1, 160)).alias("value")))
        .when(job != "", F.struct(F.lit("job").alias("fact"), job.alias("job"), job.alias("value")))
    )
    return keys.join(flows, "id", "left_semi").select("id", fact.alias("f")).where("f IS NOT NULL").select("id", "f.fact", "f.job", "f.value").distinct()
