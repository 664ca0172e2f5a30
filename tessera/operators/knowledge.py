"""Roles, links, evidence, authority and curation of documents; excerpts and concept search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.scratch import cut

# Words of a path and headings that give a document a role.
ROLE_TOKENS = {
    "architecture": ("architecture", "architectures", "design", "designs"),
    "decision": ("adr", "adrs", "decision", "decisions", "invariant", "invariants"),
    "operations": ("operation", "operations", "ops", "runbook", "runbooks"),
    "ownership": ("codeowners", "governance", "license", "owners", "ownership"),
    "plan": ("handoff", "handoffs", "plan", "plans", "roadmap", "tasks"),
    "schema": ("contract", "contracts", "protocol", "protocols", "schema", "schemas"),
    "testing": ("security", "test", "testing", "tests", "threat", "threats"),
}
ROLE_HEADINGS = {
    "architecture": ("architectural design", "architecture", "system design"),
    "decision": ("decision", "decisions", "decisions / invariants", "invariant", "invariants"),
    "operations": ("operations", "runbook", "runbooks"),
    "ownership": ("governance", "ownership", "ownership / governance", "ownership and governance"),
    "plan": ("handoff", "handoffs", "plan", "plans", "plans / handoffs"),
    "schema": ("contract", "contracts", "schema", "schemas", "schemas / contracts"),
    "testing": ("security", "testing", "testing / security", "testing and security"),
}
# States of a document that only speak of the past, and domains that state intent.
PAST = ("rejected", "withdrawn", "deprecated", "superseded", "archived", "historical")
INTENT = ("normative_intent", "decision", "governance")


def _any(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def roles(cards: DataFrame) -> DataFrame:
    """A row for each role of a card (path, heading), with what gave it: its heading before its path; without any, other."""
    tokens = F.split(F.lower(F.coalesce("path", F.lit(""))), "[^a-z0-9]+")
    head = F.lower(F.trim(F.coalesce("heading", F.lit(""))))
    found = [F.when(head.isin(*ROLE_HEADINGS[r]), F.struct(F.lit(r).alias("role"), F.lit("heading").alias("evidence"))).when(F.arrays_overlap(tokens, _any(ROLE_TOKENS[r])), F.struct(F.lit(r).alias("role"), F.lit("path").alias("evidence"))) for r in ROLE_TOKENS]
    some = F.array_compact(F.array(*found))
    other = F.array(F.struct(F.lit("other").alias("role"), F.lit("path").alias("evidence")))
    return cards.select("path", "heading", F.inline(F.when(F.size(some) > 0, some).otherwise(other)))


def _of_kind(targets: Column, kind: str) -> Column:
    return F.transform(targets, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))


def link_candidates(units: DataFrame) -> DataFrame:
    """Links of units (id, text): Markdown links, then code spans, then paths in what the earlier kinds left, so none overlap."""
    kinds = (("link", r"\[[^\]\n]*\]\(([^)\s]+)\)"), ("code", r"`([^`\n]+)`"), ("path", r"(?<![\w/.-])((?:[\w.-]+/)+[\w-]+\.[A-Za-z0-9]+)"))
    rest, parts = F.coalesce("text", F.lit("")), []
    for kind, pattern in kinds:
        parts.append(_of_kind(F.regexp_extract_all(rest, F.lit(pattern), F.lit(1)), kind))
        rest = F.regexp_replace(rest, pattern, " ")
    return units.select("id", F.inline(F.concat(*parts))).groupBy("id", "kind", "target").agg(F.count("*").alias("n"))


def budgeted(rows: DataFrame, by: list[str], order: list, size: str, limit: int) -> DataFrame:
    """Rows with whether the running total of ``size`` within ``limit`` keeps them."""
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("kept", F.sum(size).over(running) <= limit)


def breaches(budget: DataFrame, by: list[str]) -> DataFrame:
    """Kept and omitted rows of :func:`budgeted` by unit, where any were omitted."""
    out = budget.groupBy(*by).agg(F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count(F.when(~F.col("kept"), 1)).alias("omitted"))
    return out.where("omitted > 0")


def evidence_display() -> Column:
    """The most telling state of a document's evidence, from numbers and flags of a row."""
    ranked = (
        ("conflicts > 0", "deterministic_conflict"),
        ("broken > 0", "broken_anchor"),
        ("gaps > 0", "implementation_gap"),
        ("suspected > 0", "suspected_conflict"),
        ("code_changes > 0", "relevant_code_changed"),
        ("signals > 0", "review_due"),
        ("truncated", "partial"),
        ("unresolved", "unresolved"),
        ("consistent > 0", "consistent"),
    )
    return F.coalesce(*[F.when(F.expr(c), F.lit(name)) for c, name in ranked], F.lit("not_applicable"))


def voice(lifecycle: Column, domain: Column, display: Column) -> Column:
    """How a document may speak."""
    return (
        F.when(lifecycle.isin(*PAST), "history_only")
        .when(domain.isin(*INTENT), "intent")
        .when((domain == "current_implementation") & (display == "deterministic_conflict"), "suppressed")
        .when((lifecycle == "unknown") | (domain == "unknown") | (display == "not_applicable"), "unknown")
        .when(display == "consistent", "current")
        .otherwise("needs_review")
    )


def remediation(lifecycle: Column, domain: Column, spoken: Column, display: Column, successor: Column) -> Column:
    """What to do with a document and how sure that is, as ``action:confidence``."""
    return (
        F.when((lifecycle == "superseded") & successor.isNotNull(), "mark_superseded:deterministic")
        .when(spoken == "current", "keep:deterministic")
        .when((spoken == "intent") & (display == "implementation_gap"), "update:strong")
        .when((spoken == "history_only") & (domain == "historical_record"), "archive:strong")
        .otherwise("needs_review:signal")
    )


def authority(documents: DataFrame, policy: DataFrame) -> DataFrame:
    """Documents (path, hash) under a policy (path, target_hash, lifecycle, domain, successor): entries for other contents don't hold."""
    rules = policy.groupBy("path").agg(F.min(F.struct("target_hash", "lifecycle", "domain", "successor")).alias("p"))
    joined = documents.join(rules, "path", "left")
    held = F.col("p.target_hash") == F.col("hash")
    get = lambda c: F.when(held, F.col(f"p.{c}"))
    state = F.when(F.col("p").isNull(), "none").when(held, "applied").otherwise("stale")
    return joined.select("path", "hash", state.alias("policy"), F.coalesce(get("lifecycle"), F.lit("unknown")).alias("lifecycle"), F.coalesce(get("domain"), F.lit("unknown")).alias("domain"), get("successor").alias("successor"))


def succession(successors: DataFrame, *, rounds: int = 16) -> DataFrame:
    """(node, last, cyclic) of links (node, next), at most one a node: the end of its chain, or a cycle.

    Pointers double each round (a self-join by node, written to the shared
    folder), so chains to 2 ** rounds links end; pointers that then still go on
    run into a cycle. As distances along a chain are consecutive, a round in
    which no pointer ends is the last.
    """
    state = successors.groupBy("node").agg(F.min("next").alias("next")).where("next IS NOT NULL").select("node", F.col("next").alias("last"))
    state, before = state.withColumn("open", F.lit(True)), None
    for _ in range(rounds + 1):
        step = state.select(F.col("node").alias("_n"), F.col("last").alias("_l"), F.col("open").alias("_o"))
        on = (F.col("last") == F.col("_n")) & F.col("open")
        state = cut(state.join(step, on, "left").select("node", F.coalesce("_l", "last").alias("last"), F.coalesce("_o", F.lit(False)).alias("open")), "succession")
        left = state.where("open").count()
        if left in (0, before):
            break
        before = left
    return state.select("node", F.when(~F.col("open"), F.col("last")).alias("last"), F.col("open").alias("cyclic"))


def review(records: DataFrame) -> DataFrame:
    """Counts of records (lifecycle, domain, voice) by each of the three and of all."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("lifecycle", "domain", "voice")], F.struct(F.lit("all").alias("facet"), F.lit("").alias("value"))))
    return records.select(each.alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def curation_preview(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (key, path, op, expected_hash, value) with their outcome against a ledger (path, hash, value), none applied.

    Of edits with one key, and of keys for one path, the least counts; the others are replays or conflicts.
    """
    once = edits.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("path", "op", "expected_hash", "value")))
    first = once.withColumn("_p", F.row_number().over(Window.partitionBy("path").orderBy("_k", "key")))
    now = ledger.select("path", F.col("hash").alias("_hash"), F.lit(True).alias("_there"))
    joined = first.join(now, "path", "left")
    outcome = F.when(F.col("_k") > 1, "replayed").when(F.col("_p") > 1, "conflict").when((F.col("op") == "remove") & F.col("_there").isNull(), "missing").when(~F.col("expected_hash").eqNullSafe(F.col("_hash")), "stale").otherwise("applied")
    return joined.select("key", "path", "op", "expected_hash", "value", outcome.alias("outcome"))


def curate(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """The ledger after the edits that :func:`curation_preview` would apply; hashes are of the values."""
    good = curation_preview(ledger, edits).where("outcome = 'applied'")
    kept = ledger.select("path", "hash", "value").join(good.select("path"), "path", "left_anti")
    return kept.unionByName(good.where("op <> 'remove'").select("path", F.sha2("value", 256).alias("hash"), "value"))


def best_hits(hits: DataFrame) -> DataFrame:
    """One hit for each (path, line_no, excerpt): of the shortest unit, then the deepest heading, then the least unit."""
    nth = F.row_number().over(Window.partitionBy("path", "line_no", "excerpt").orderBy("unit_length", F.desc("heading_depth"), "unit"))
    return hits.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def excerpt(line: Column, phrase: str, *, most: int = 240, snap: int = 32) -> Column:
    """At most ``most`` characters of a line around a phrase, cut at white space near the ends, with an ellipsis where cut."""
    size, width = F.length(line), max(len(phrase), 1)
    at = F.greatest(F.instr(F.lower(line), phrase.lower()) - 1, F.lit(0)) if phrase else F.lit(0)
    end = F.least(F.greatest(at - (most - width) // 2, F.lit(0)) + most, size)
    start = F.greatest(end - most, F.lit(0))
    gap = F.regexp_instr(line.substr(start + 1, F.lit(snap)), F.lit(r"\s"))
    first = F.when((start > 0) & (gap > 0) & (start + gap - 1 < at), start + gap).otherwise(start)
    floor = F.greatest(end - snap, at + width)
    tail = line.substr(floor + 1, F.greatest(end - floor, F.lit(0)))
    last = F.when((end < size) & tail.rlike(r"\s"), floor + F.length(F.regexp_extract(tail, r"(?s)^(.*)\s", 1))).otherwise(end)
    cut_text = F.concat(F.when(first > 0, "…").otherwise(""), line.substr(first + 1, last - first), F.when(last < size, "…").otherwise(""))
    return F.when(size <= most, line).otherwise(cut_text)


def empty_reason(terms: Column, hits: Column, withheld: Column, other: Column, degraded: Column) -> Column:
    """Why a search shows nothing; null if it shows something."""
    return F.when(hits > 0, F.lit(None).cast("string")).when(terms == 0, "query_too_weak").when(withheld > 0, "evidence_withheld").when(other > 0, "evidence_noncurrent").when(degraded, "no_evidence_degraded").otherwise("no_evidence_complete")


SCOPES = {"current": ("current",), "local_refs": ("local_ref",), "worktrees": ("worktree",), "all": ("current", "local_ref", "worktree")}


def in_scope(rows: DataFrame, scope: str) -> DataFrame:
    """Rows whose lane is in a scope, with the lane's precedence from 0."""
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {', '.join(SCOPES)}, not {scope!r}")
    lanes = SCOPES[scope]
    place = F.coalesce(*[F.when(F.col("lane") == x, F.lit(i)) for i, x in enumerate(lanes)])
    return rows.where(F.col("lane").isin(*lanes)).withColumn("precedence", place.cast("long"))


# Endings that a stem drops, the longest first.
ENDINGS = ("ization", "isation", "ation", "tion", "sion", "ment", "ness", "ible", "able", "ize", "ise", "ing", "ed", "er", "ly", "es")


def stemmed(word: Column) -> Column:
    """A lower-cased word without its longest ending, if three characters stay; a closing ss isn't an ending."""
    return F.regexp_replace(F.lower(word), rf"^(.{{3,}}?)(?:{'|'.join(ENDINGS)}|(?<!s)s)$", "$1")


def words(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")


def _alike(a: Column, b: Column) -> Column:
    """Equal stems, or one of at least four characters that begins another up to two longer."""
    near = (F.least(F.length(a), F.length(b)) >= 4) & (F.abs(F.length(a) - F.length(b)) <= 2)
    return (a == b) | (near & (a.startswith(b) | b.startswith(a)))


def _has_stem(stems: Column, word: str) -> Column:
    return F.exists(stems, lambda s: _alike(s, stemmed(F.lit(word))))


def concept(query: Column, concepts: list[str]) -> Column:
    """(name, match) of the first concept whose words stand in a query, else of the first all of whose stems do; else null."""
    asked = words(query)
    joined = F.concat(F.lit(" "), F.array_join(asked, " "), F.lit(" "))
    stems = F.transform(asked, stemmed)
    made = lambda c, how: F.struct(F.lit(c).alias("name"), F.lit(how).alias("match"))
    exact = [F.when(joined.contains(f" {' '.join(c.lower().split())} "), made(c, "exact")) for c in concepts]
    loose = []
    for c in concepts:
        all_in = F.lit(True)
        for w in c.split():
            all_in = all_in & _has_stem(stems, w)
        loose.append(F.when(all_in, made(c, "stemmed")))
    return F.coalesce(*exact, *loose)


# Words that say nothing about what is looked for.
STOP = ("all", "and", "are", "does", "for", "from", "how", "that", "the", "this", "what", "where", "with")


def terms(query: Column) -> Column:
    """Different words of three or more characters, without marks around them and stop words."""
    bare = F.transform(words(query), lambda w: F.regexp_replace(w, r"^[^\w:-]+|[^\w:-]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP)))


def explore(queries: DataFrame, symbols: DataFrame, *, top: int = 10, least: float = 0.45) -> DataFrame:
    """Symbols (path, name, line) that share stems with a query (query_id, query): the share of its terms, labelled.

    Terms and parts of names are opened and joined by stem.
    """
    asked = queries.select("query_id", terms(F.col("query")).alias("t")).select("query_id", F.size("t").alias("of"), F.explode("t").alias("w"))
    asked = asked.select("query_id", "of", stemmed(F.col("w")).alias("stem")).distinct()
    parts = F.split(F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    have = symbols.select("path", "name", "line", F.explode(F.array_distinct(F.transform(parts, stemmed))).alias("stem")).where("length(stem) >= 3")
    score = F.round(F.count_distinct("stem") / F.max("of"), 6)
    found = asked.join(have, "stem").groupBy("query_id", "path", "name", "line").agg(score.alias("score")).where(F.col("score") >= least)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "path", "line")).cast("long")
    label = F.when(F.col("score") >= 0.8, "strong").otherwise("contextual")
    return found.withColumn("label", label).withColumn("nth", nth).where(F.col("nth") <= top)
