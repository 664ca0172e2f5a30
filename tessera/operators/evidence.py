"""Path and content predicates, provenance of answers, checks, outlines and budgets of output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.ranking import global_row_number


def _basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


# Names and places of files that hold credentials, by rule. "name" patterns are for a
# path's last part, "path" patterns for all of it, both in lower case; "unless" lets samples through.
SENSITIVE_PATHS = {
    "file.cloud-logins": {"path": r"(?:^|/)(?:\.aws/credentials|\.kube/config)$", "name": r".*application_default_credentials\.json"},
    "file.environment-values": {"name": r"\.env(?:\..*)?|.*\.env", "unless": r"(?:example|sample|template|dist)\..*|.*\.(?:example|sample|template|dist)"},
    "file.infrastructure-state": {"name": r".*\.tfstate(?:\.backup)?"},
    "file.network-logins": {"name": r"\.git-credentials|[._]netrc"},
    "file.private-keys": {"name": r".*\.key|id_(?:rsa|dsa|ecdsa|ed25519)|.*private.*\.pem"},
}


def sensitive_path(path: Column, rules: dict[str, dict[str, str]] = SENSITIVE_PATHS) -> Column:
    """The first of ``rules`` that a path falls under, or null."""
    whole = F.lower(slashes(path))
    name = _basename(whole)

    def holds(rule: dict[str, str]) -> Column:
        hit = F.lit(False)
        if "name" in rule:
            hit = hit | name.rlike(f"^(?:{rule['name']})$")
        if "path" in rule:
            hit = hit | whole.rlike(rule["path"])
        return hit & ~name.rlike(f"^(?:{rule['unless']})$") if "unless" in rule else hit

    return F.coalesce(*[F.when(holds(rule), F.lit(name_)) for name_, rule in rules.items()])


def personal_path(path: Column, folders: list[str]) -> Column:
    """Whether a path lies in one of the folders that a caller names as somebody's own tools."""
    if not folders:
        return F.lit(False)
    parts = F.split(F.lower(slashes(path)), "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(above, F.array(*[F.lit(f.lower()) for f in folders]))


def lfs_pointer(content: Column) -> Column:
    """(oid, size) of a large-file pointer, or null."""
    pattern = r"\Aversion https://git-lfs\.github\.com/spec/v1\r?\noid sha256:([0-9a-fA-F]{64})\r?\nsize ([0-9]{1,18})\r?\n?\z"
    got = F.struct(F.concat(F.lit("sha256:"), F.regexp_extract(content, pattern, 1)).alias("oid"), F.regexp_extract(content, pattern, 2).try_cast("long").alias("size"))
    return F.when((F.octet_length(content) <= 1024) & content.rlike(pattern), got)


def nul_scan(content: Column, *, first: int = 5) -> Column:
    """(count, offsets) of NUL characters: how many, and where the first few stand (characters from 0)."""
    pieces = F.split(content, "\\x00", first + 1)
    head = F.slice(F.transform(pieces, lambda p: F.length(p)), 1, F.size(pieces) - 1)
    offsets = F.transform(head, lambda _, i: F.aggregate(F.slice(head, 1, i + 1), F.lit(0), lambda a, n: a + n) + i)
    return F.struct((F.length(content) - F.length(F.replace(content, F.lit("\x00"), F.lit("")))).cast("long").alias("count"), offsets.alias("offsets"))


# How lines begin (after blanks) that import, comment, document, or carry a mark worth showing.
LINE_STARTS = {
    "documentation": ("///", "//!", "/**"),
    "marked": ("# TODO", "# FIXME", "# NOTE", "# HACK", "# type:"),
    "import": ("use ", "import ", "#include", "require("),
    "comment": ("//", "/*", "*/", "* ", "--", "# ", "#!"),
}


def line_kind(line: Column, starts: dict[str, tuple[str, ...]] = LINE_STARTS) -> Column:
    """documentation, marked, import, comment or code, in this order of precedence."""
    bare = F.trim(line)
    begins = {kind: reduce(lambda a, b: a | b, (bare.startswith(s) for s in each)) for kind, each in starts.items()}
    taken = (bare.startswith("from ") & bare.contains(" import ")) | (bare.rlike(r"^(?:const|let|var)\s") & bare.contains("require("))
    kind = F.when(begins["documentation"], "documentation").when(begins["marked"], "marked")
    return kind.when(begins["import"] | taken, "import").when(begins["comment"] | (bare == "#"), "comment").otherwise("code")


def noise_line(line: Column) -> Column:
    """Whether a line only imports or comments, so that shown results may leave it out."""
    return line_kind(line).isin("import", "comment")


def low_signal(name: Column, common: list[str], *, least: int = 3) -> Column:
    """Names that say little: shorter than ``least``, of one repeated character, or among the caller's common ones."""
    plain = F.lower(F.trim(name))
    return (F.length(plain) < least) | plain.rlike(r"^(.)\1*$") | plain.isin(*[c.lower() for c in common])


def builtin_name(name: Column, language: Column, builtins: dict[str, list[str]]) -> Column:
    """Single capitals (type parameters) and the built-in names that a caller lists by language."""
    listed = [(language == lang) & name.isin(*names) for lang, names in builtins.items() if names]
    return reduce(lambda a, b: a | b, listed, name.rlike("^[A-Z]$"))


def guarded(rows: DataFrame, fields: list[str], pattern: str) -> DataFrame:
    """Rows with whether any visible field matches a secret; callers withhold those and count them."""
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(f).rlike(pattern), F.lit(False)) for f in fields))
    return rows.withColumn("withheld", hit)


class SourceMoved(RuntimeError):
    """A source changed between an answer's start and its end."""


class Lease:
    """Snapshot ids of several sources, taken before a query and compared after it.

        lease = Lease(read_ids)
        answer = query()
        lease.check()      # raises SourceMoved if any moved, came or went
    """

    def __init__(self, read) -> None:
        self._read = read
        self.ids = dict(read())

    def check(self) -> None:
        now = dict(self._read())
        moved = sorted(k for k in self.ids.keys() | now.keys() if self.ids.get(k) != now.get(k))
        if moved:
            raise SourceMoved(", ".join(moved))


COVERAGE = ("complete", "verifying", "degraded")


def claim(rows: DataFrame, source: str, snapshot: str, coverage: str) -> DataFrame:
    """Rows as claims of one source: who says it, from which snapshot, covering how much."""
    if coverage not in COVERAGE:
        raise ValueError(f"coverage is one of {', '.join(COVERAGE)}, not {coverage!r}")
    return rows.withColumn("_claims", F.array(F.struct(F.lit(source).alias("source"), F.lit(snapshot).alias("snapshot"), F.lit(coverage).alias("coverage"))))


def derived(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of claims: it rests on the claims of both sides."""
    a, b = left.withColumnRenamed("_claims", "_a"), right.withColumnRenamed("_claims", "_b")
    none = F.array().cast(left.schema["_claims"].dataType)
    return a.join(b, on, how).withColumn("_claims", F.array_sort(F.array_union(F.coalesce("_a", none), F.coalesce("_b", none)))).drop("_a", "_b")


def coverage(claims: Column) -> Column:
    """The worst coverage among claims; no claims cover nothing."""
    worst = F.array_max(F.transform(claims, lambda c: F.array_position(_words(COVERAGE), c["coverage"])))
    return F.when(F.size(claims) > 0, F.element_at(_words(COVERAGE), worst.cast("int"))).otherwise("degraded")


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def freshness(checks: DataFrame, by: str) -> DataFrame:
    """Current, verifying or degraded from checks (by, state: ok, pending or failed; reason), with the reasons of failures."""
    failed, pending = F.max((F.col("state") == "failed").cast("int")), F.max((F.col("state") == "pending").cast("int"))
    reasons = F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == "failed", F.col("reason")))), ",")
    return checks.groupBy(by).agg(F.when(failed == 1, "degraded").when(pending == 1, "verifying").otherwise("current").alias("freshness"), reasons.alias("reasons"))


def outcome(invalid: Column, failed: Column, scanned: Column, found: Column) -> Column:
    return F.when(invalid, "invalid_request").when(failed, "internal_failure").when(scanned == 0, "empty_result").when(found == 0, "not_found").when(found == 1, "found").otherwise("ambiguous")


def spot_check(stored: DataFrame, current: DataFrame, fraction: float) -> DataFrame:
    """Every Nth stored row (path, hash), so that about a fraction is looked at, that is gone or has another hash now.

    This is a sampling operator; a full check is a full outer join of both.
    """
    if not 0 < fraction <= 1:
        raise ValueError(f"a fraction from above 0 to 1, not {fraction}")
    numbered = global_row_number(stored.select("path", "hash"), ["path", "hash"], "nth")
    size = F.greatest(F.ceil(F.col("nth_of") * fraction), F.lit(1))
    step = F.greatest(F.floor(F.col("nth_of") / size), F.lit(1))
    sample = numbered.where((F.col("nth") - 1) % step == 0).select("path", "hash")
    now = current.select("path", F.col("hash").alias("_now"))
    joined = sample.join(now, "path", "left").where(~F.col("hash").eqNullSafe(F.col("_now")))
    return joined.select("path", F.when(F.col("_now").isNull(), "deleted").otherwise("changed").alias("state"))


def prompt_hints(prompts: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files, symbols and lines (``name:12``) that words of prompts (prompt_id, text) name: (prompt_id, kind, value, line)."""
    tokens = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\s,;()`'\"]+"), lambda w: w != ""))
    said = prompts.select("prompt_id", F.explode(tokens).alias("w"))
    said = said.select("prompt_id", F.regexp_replace("w", r":[0-9]{1,9}$|[.:?!]+$", "").alias("word"), F.regexp_extract("w", r":([0-9]{1,9})$", 1).try_cast("long").alias("line"))
    by_file = files.select(F.col("path").alias("value"), F.explode(F.array_distinct(F.array(F.col("path"), _basename(F.col("path"))))).alias("word"))
    by_name = symbols.select(F.col("name").alias("value"), F.col("name").alias("word")).distinct()
    hint = lambda other, kind: said.join(other, "word").select("prompt_id", F.lit(kind).alias("kind"), "value", "line")
    return hint(by_file, "file").unionByName(hint(by_name, "symbol")).distinct()


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes from start to end (exclusive) of a text as UTF-8; a character cut in two becomes a mark."""
    raw = F.encode(content, "UTF-8")
    size = F.greatest(F.least(end, F.octet_length(content)) - start, F.lit(0))
    return F.decode(F.substring(raw, (start + 1).cast("int"), size.cast("int")), "UTF-8")


def outline(symbols: DataFrame) -> DataFrame:
    """Per path one text: a line a symbol (ordinal, depth, kind, name, line), indented by depth, in order."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.col("kind"), F.lit(" "), F.col("name"), F.lit(" :"), F.col("line").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("text"))))
    return symbols.groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("outline"))


def signature(body: Column) -> Column:
    """A body's first line that isn't a decorator or comment, up to its opening brace or closing colon."""
    code = F.filter(F.split(body, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(@|//|/\*|\*|#)"))
    first = F.try_element_at(code, F.lit(1))
    return F.trim(F.regexp_replace(F.coalesce(first, F.lit("")), r"\s*(\{.*|:\s*)$", ""))


def first_doc_line(body: Column) -> Column:
    """The first line of documentation in a body, or null."""
    got = F.regexp_extract(body, r'(?m)^\s*(?:///|//!|/\*\*|"""|##)\s*(\S.*?)\s*(?:\*/|""")?$', 1)
    return F.when(got != "", got)


def projected(body: Column, verbosity: str) -> Column:
    """A body as signature, compact (with its first documentation line) or full."""
    if verbosity == "signature":
        return signature(body)
    if verbosity == "compact":
        return F.concat_ws("\n", signature(body), first_doc_line(body))
    if verbosity == "full":
        return body
    raise ValueError(f"verbosity is signature, compact or full, not {verbosity!r}")


def estimate(rows: DataFrame, column: str) -> DataFrame:
    """What rows would cost: their number, bytes and tokens (four bytes each, rounded up)."""
    size = F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0).cast("long"))
    return rows.agg(F.count("*").alias("rows_"), size.alias("bytes"), F.ceil(size / 4).cast("long").alias("tokens"))


def within_tokens(lines: DataFrame, tokens: int, by: str = "path") -> DataFrame:
    """Lines (by, line_no, line) that fit in a number of tokens, whole lines only, their line ends counted."""
    running = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("_b", F.sum(F.octet_length("line") + 1).over(running)).where(F.col("_b") <= 4 * tokens).drop("_b")


def gates(rows: DataFrame) -> DataFrame:
    """Sum of saved tokens (manual less served) over accepted rows, violations, and whether both pass."""
    net = F.coalesce(F.sum(F.when(F.col("accepted"), F.col("manual") - F.col("served"))), F.lit(0)).cast("long")
    bad = F.count(F.when(F.col("accepted") & ~F.col("equivalent"), 1))
    return rows.agg(net.alias("net"), bad.alias("violations")).withColumn("verdict", F.when((F.col("net") > 0) & (F.col("violations") == 0), "PASS").otherwise("FAIL"))


# Files that change with everything and so anchor no co-change.
CHORES = ("CHANGELOG.md", "Cargo.lock", "package-lock.json", "poetry.lock", "yarn.lock")


def co_change_gate(anchor: Column, anchor_score: Column, shared: Column, weight: Column, *, floor: float = 0.8) -> Column:
    """A co-change weight that may promote a path: no chore anchor, a sure anchor, shared at least twice, finite and positive."""
    base = _basename(slashes(anchor))
    good = ~base.isin(*CHORES) & (anchor_score >= floor) & (shared >= 2) & (weight > 0) & (weight < float("inf"))
    return F.when(good, weight).otherwise(F.lit(0.0))


def certain_usages(lines: DataFrame, name: str) -> DataFrame:
    """Lines where a name is part of a ``::`` path, with whether that is outside comments and strings."""
    if not name:
        raise ValueError("the name is empty")
    token = rf"(\w::{name}\b)|(\b{name}::)"
    code = F.regexp_replace(F.regexp_replace("line", r'"(\\.|[^"\\])*"', '""'), "//.*$|(^|\\s)#.*$", "")
    return lines.where(F.col("line").rlike(token)).withColumn("confident", code.rlike(token))
