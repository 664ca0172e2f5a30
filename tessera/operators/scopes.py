"""What a search may look at: paths, lanes, languages, kinds, and why a file was admitted as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Other words for kinds and languages that queries use.
KIND_WORDS = {"variable": "let", "function": "fn", "method": "fn", "module": "mod", "constant": "const"}
LANGUAGE_WORDS = {"md": "markdown", "c++": "cpp", "c#": "csharp", "js": "javascript", "ts": "typescript", "py": "python"}
SCOPES = ("all", "code", "text", "binary")


class InvalidScope(ValueError):
    """A scope, kind or language that isn't known."""


def in_path(path: Column, *, exact: str | None = None, prefix: str | None = None) -> Column:
    """Whether a path is the one given, or lies in the folder given (whole parts; an empty folder holds all)."""
    if exact is not None and prefix is not None:
        raise InvalidScope("a path or a folder, not both")
    if exact is not None:
        return path == exact
    folder = (prefix or "").rstrip("/")
    return (path == folder) | path.startswith(folder + "/") if folder else F.lit(True)


def in_lane(kind: Column, scope: str, targets: Column | None = None) -> Column:
    """Whether a file of a class (code, text, binary) belongs to a scope.

    ``targets`` (array of "code" and "knowledge", or null) says what a file was
    indexed for and comes before its class; binaries go by class alone.
    """
    if scope not in SCOPES:
        raise InvalidScope(f"a scope is one of {', '.join(SCOPES)}, not {scope!r}")
    if scope == "all":
        return F.lit(True)
    by_class = kind == scope
    if targets is None or scope == "binary":
        return by_class
    return F.coalesce(F.array_contains(targets, {"code": "code", "text": "knowledge"}[scope]), by_class)


def in_language(language: Column, wanted: str | None, known: list[str]) -> Column:
    """Whether a file is in a language, named by one of its names; an unknown name is an error, none means any."""
    name = (wanted or "").strip().lower()
    if not name:
        return F.lit(True)
    name = LANGUAGE_WORDS.get(name, name)
    if name not in {k.lower() for k in known}:
        raise InvalidScope(f"no language is named {wanted!r}")
    return F.lower(language) == name


def of_kind(kind: Column, wanted: str | None) -> Column:
    """Whether a symbol is of a kind, by its short or long name; "all" or none means any."""
    name = (wanted or "all").strip().lower()
    if name == "all":
        return F.lit(True)
    return F.lower(kind).isin(*{name, KIND_WORDS.get(name, name)})


def reconciled(tier: Column, language: Column) -> Column:
    """A file admitted as normal in no known language has its metadata only; other decisions stand."""
    return F.when((tier == "normal") & language.isNull(), "unsupported_language").otherwise(tier)


def admission_of(decisions: DataFrame, path: str) -> DataFrame:
    """The decision (path, tier, byte_len, language, reason) on one path, with its extension; slashes and a leading ./ don't matter."""
    plain = lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^(?:\\./)+", "")
    wanted = path.replace("\\", "/")
    while wanted.startswith("./"):
        wanted = wanted[2:]
    extension = F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)
    return decisions.where(plain(F.col("path")) == wanted).select("path", "tier", "byte_len", "language", F.when(extension != "", extension).alias("extension"), "reason")


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers of different nodes, edges (src, dst) and nodes without an edge."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    own = nodes.select("node").distinct()
    n = own.agg(F.count("*").alias("nodes"))
    e = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    lone = own.join(touched, "node", "left_anti").agg(F.count("*").alias("isolated"))
    return n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(lone))  # a row each
