"""File search by ranked signals, and path hints resolved to files.

Signals stand in a registry: a name, a weight, a score (a column over the
candidates) and a reason why it may have nothing to say. The score of a path is
the weighted sum of all of them, folded into one expression; each signal's share
stays beside it as evidence.

Path match has tiers: strong (the path, its end if the query has a slash, or its
last part with all folders named), basename, prefix (of three characters or more)
and loose (all words somewhere). A path counts in its best tier only. Files of
which only metadata are known come after all others, whatever their score.
Co-change lifts partners of the file at hand, if that file matches the query
itself, isn't one that changes with everything, and two commits or more agree.

Files are (path, metadata_reason): the reason is null for files that were read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.search import InvalidQuery

# Scores of the tiers, the floor of shared commits, shares of the frecency order, limits.
STRONG, BASENAME, PREFIX, LOOSE = 1000.0, 100.0, 50.0, 10.0
SHARED_FLOOR, PREFIX_LEAST = 2, 3
FUSION = {"path": 0.6, "co_change": 0.3, "frecency": 0.1}
FUSION_TIERS = {"strong": 1.0, "basename": 0.6, "loose": 0.3}
LIMIT, MOST, AMBIGUOUS = 20, 50, 10
#: Files that change with everything.
CHORES = ("Cargo.lock", "package-lock.json", "uv.lock", "poetry.lock", "yarn.lock", "pnpm-lock.yaml", "CHANGELOG.md", ".release-please-manifest.json")


def normal(query: str) -> str:
    """Forward slashes, without ./ in front and slashes at the ends."""
    text = query.strip().replace("\\", "/")
    while text.startswith("./"):
        text = text[2:]
    return text.strip("/")


def is_chore(path: str) -> bool:
    name = normal(path)
    return name.rsplit("/", 1)[-1] in CHORES or re.fullmatch(r"\.github/workflows/.*\.ya?ml", name) is not None


@dataclass(frozen=True)
class Context:
    """What signals may look at: the query, the file at hand, and which optional columns the candidates have."""

    query: str
    anchor: str | None = None
    coupled: bool = False
    words: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "query", normal(self.query))
        object.__setattr__(self, "words", tuple(re.split(r"[/\s]+", self.query.lower())) if self.query else ())


@dataclass(frozen=True)
class Signal:
    """``score`` is a column over candidates (path, shared, weight); ``silent`` says why it has no say at all, or None."""

    name: str
    weight: float
    score: Callable[[Context], Column]
    silent: Callable[[Context], str | None] = lambda _: None


def _low() -> Column:
    return F.lower("path")


def _last() -> Column:
    return F.element_at(F.split(_low(), "/"), -1)


def exact(c: Context) -> Column:
    return _low() == c.query.lower()


def suffix(c: Context) -> Column:
    return _low().endswith(c.query.lower()) if "/" in c.query else F.lit(False)


def path_match(c: Context) -> Column:
    """1000, 100, 50, 10 or 0, by tier. The file at hand also matches by its name without extension."""
    base, folders = c.words[-1], c.words[:-1]
    stem = F.regexp_replace(_last(), r"(?<=.)\.[^.]*$", "")
    named = _last() == base
    if c.anchor and len(base.encode()) >= PREFIX_LEAST:
        named = named | ((F.col("path") == normal(c.anchor)) & (stem == base))
    parts = F.split(_low(), "/")
    inside = reduce(lambda a, b: a & b, (F.array_contains(parts, f) for f in folders)) if folders else F.lit(False)
    prefix = stem.startswith(base) if len(base.encode()) >= PREFIX_LEAST else F.lit(False)
    loose = reduce(lambda a, b: a & b, (_low().contains(w) for w in c.words))
    return F.when(exact(c) | suffix(c) | (named & inside), STRONG).when(named, BASENAME).when(prefix, PREFIX).when(loose, LOOSE).otherwise(0.0)


def anchor_score(c: Context) -> float:
    """The tier of the file at hand, decided like that of any path."""
    low, base = normal(c.anchor or "").lower(), c.words[-1]
    last = low.rsplit("/", 1)[-1]
    stem = re.sub(r"(?<=.)\.[^.]*$", "", last)
    named = last == base or (len(base.encode()) >= PREFIX_LEAST and stem == base)
    if low == c.query.lower() or ("/" in c.query and low.endswith(c.query.lower())) or (named and len(c.words) > 1 and set(c.words[:-1]) <= set(low.split("/"))):
        return STRONG
    return BASENAME if named else 0.0


def _no_co_change(c: Context) -> str | None:
    if not c.anchor:
        return "no file at hand"
    if not c.coupled:
        return "no history of changes"
    if is_chore(c.anchor):
        return "the file at hand changes with everything"
    if anchor_score(c) < BASENAME:
        return "the file at hand doesn't match the query"
    return None


def co_change(c: Context) -> Column:
    if _no_co_change(c):
        return F.lit(0.0)
    fine = (F.col("shared") >= SHARED_FLOOR) & (F.col("weight") > 0) & (F.col("weight") < F.lit(float("inf")))
    return F.when(fine, F.col("weight")).otherwise(0.0)


PATH_MATCH = Signal("path_match", 1.0, path_match)
CO_CHANGE = Signal("co_change", 1.0, co_change, _no_co_change)


class Registry:
    """Signals by name, in order; a caller may add to its own."""

    def __init__(self, *signals: Signal) -> None:
        self.signals: list[Signal] = []
        for s in signals or (PATH_MATCH, CO_CHANGE):
            self.register(s)

    def register(self, signal: Signal) -> None:
        if any(s.name == signal.name for s in self.signals):
            raise ValueError(f"signal {signal.name} is registered twice")
        self.signals.append(signal)

    def combine(self, c: Context) -> Column:
        return reduce(lambda a, b: a + b, (F.lit(s.weight) * F.coalesce(s.score(c).cast("double"), F.lit(0.0)) for s in self.signals))

    def evidence(self, c: Context) -> Column:
        """A map from each signal's name to its share."""
        return F.create_map(*[x for s in self.signals for x in (F.lit(s.name), F.lit(s.weight) * F.coalesce(s.score(c).cast("double"), F.lit(0.0)))])

    def silent(self, c: Context) -> dict[str, str]:
        return {s.name: why for s in self.signals if (why := s.silent(c))}


def _shared_folders(anchor: str | None) -> Column:
    """Leading folders that a path shares with the file at hand."""
    own = normal(anchor or "").split("/")[:-1]
    if not own:
        return F.lit(0)
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    same = [F.array_join(F.slice(folders, 1, n), "/") == "/".join(own[:n]) for n in range(1, len(own) + 1)]
    return reduce(lambda a, b: a + b, (F.when((F.size(folders) >= n) & x, 1).otherwise(0) for n, x in enumerate(same, 1)))


def ranked(files: DataFrame, query: str, *, anchor: str | None = None, coupling: DataFrame | None = None, frecency: DataFrame | None = None, rank_by: str = "path", hidden: Column | None = None, registry: Registry | None = None) -> tuple[DataFrame, dict[str, str]]:
    """All matching files with their place, and why a signal that was asked for had no say.

    ``rank_by`` is ``path`` (tiers alone), ``path+cochange`` (``coupling`` (path,
    shared, weight) of the file at hand) or ``frecency`` (``frecency`` (path,
    frecency) too). ``hidden`` leaves paths out before anything is counted.
    Columns: path, tier, score, coupling (0 to 1), shared, metadata_reason,
    evidence, and what orders them.
    """
    if rank_by not in ("path", "path+cochange", "frecency"):
        raise InvalidQuery(f"unknown order {rank_by}")
    if rank_by == "path+cochange" and not anchor:
        raise InvalidQuery("path+cochange needs a file at hand")
    c = Context(query, anchor, coupling is not None and rank_by != "path")
    if not c.words:
        raise InvalidQuery("the query is empty")
    signals = registry or Registry()
    allowed = lambda f: f if hidden is None else f.where(~hidden)
    files = allowed(files.select("path", "metadata_reason").dropDuplicates(["path"]))
    if c.coupled:
        partners = allowed(coupling.select("path", "shared", F.col("weight").cast("double").alias("weight")))
        most = partners.where((F.col("weight") > 0) & (F.col("weight") < F.lit(float("inf")))).agg(F.max("weight").alias("most"))
        files = files.join(partners, "path", "left").crossJoin(F.broadcast(most))  # one row
    else:
        files = files.withColumn("shared", F.lit(None).cast("long")).withColumn("weight", F.lit(None).cast("double")).withColumn("most", F.lit(None).cast("double"))
    match = path_match(c)
    meta = F.col("metadata_reason").isNotNull()
    lifted = (co_change(c) > 0) & ~meta
    tier = F.when(meta, "metadata_only").when(lifted, "co_change").when(match == STRONG, "strong").when(match == BASENAME, "basename").otherwise("loose")
    own = F.when(match == STRONG, "strong").when(match == BASENAME, "basename").otherwise("loose")
    out = files.where(match > 0).select(
        "path", tier.alias("tier"), own.alias("_own"), signals.combine(c).alias("score"), F.when(lifted, F.least(F.col("weight") / F.col("most"), F.lit(1.0))).alias("coupling"), F.when(lifted, F.col("shared")).alias("shared"), "metadata_reason", signals.evidence(c).alias("evidence"),
        meta.alias("_meta"), exact(c).alias("_exact"), suffix(c).alias("_suffix"), _shared_folders(anchor).alias("_near"), F.octet_length("path").alias("_length"),
    )
    missing = {n: why for n, why in signals.silent(c).items() if n != "co_change" or rank_by == "path+cochange"}
    if rank_by == "frecency":
        if frecency is None or frecency.isEmpty():
            missing["frecency"] = "no reads are known"
        else:
            seen = frecency.groupBy("path").agg(F.max("frecency").alias("_seen"))
            top = seen.agg(F.max("_seen").alias("_top"))  # one row
            share = F.when(F.col("_top") > 0, F.least(F.greatest(F.coalesce("_seen", F.lit(0.0)) / F.col("_top"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
            credit = F.when(F.col("tier") == "strong", FUSION_TIERS["strong"]).when(F.col("tier") == "basename", FUSION_TIERS["basename"]).when(F.col("tier") == "loose", FUSION_TIERS["loose"]).otherwise(0.0)
            fused = F.lit(FUSION["path"]) * credit + F.lit(FUSION["co_change"]) * F.coalesce("coupling", F.lit(0.0)) + F.lit(FUSION["frecency"]) * share
            out = out.join(seen, "path", "left").crossJoin(F.broadcast(top)).withColumn("score", fused).withColumn("_exact", F.lit(False)).withColumn("_suffix", F.lit(False)).withColumn("_near", F.lit(0)).withColumn("_length", F.lit(0)).drop("_seen", "_top")
    return out, missing


def first(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` (1 to 50) of ranked files, numbered, with the number of all and of those not shown."""
    limit = min(max(limit, 1), MOST)
    order = ["_meta", F.desc("score"), F.desc("_exact"), F.desc("_suffix"), F.desc("_near"), "_length", "path"]
    total = found.agg(F.count("*").alias("total"))
    shown = found.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.orderBy(*order)).cast("long")  # at most 50 rows
    out = shown.withColumn("place", place).crossJoin(F.broadcast(total)).withColumn("overflow", F.greatest(F.col("total") - limit, F.lit(0).cast("long")))
    return out.select("place", "path", "tier", "score", "coupling", "shared", "metadata_reason", "evidence", "total", "overflow")


def resolve(files: DataFrame, hint: str, *, hidden: Column | None = None) -> DataFrame:
    """(status, nth, path, overflow): resolved, resolved_metadata, ambiguous (up to ten, the rest counted) or not_found (null path).

    In order: the very path; a metadata-only file of that path in any case; files
    with that last part, or else with the hint inside their path, each narrowed by
    the folders named; metadata-only files by the same rules. Paths that end as the
    hint does come first, then shorter ones.
    """
    text = normal(hint)
    if not text:
        raise InvalidQuery("the hint is empty")
    low = text.lower()
    parts = [p for p in low.split("/") if p]
    files = files.select("path", "metadata_reason").dropDuplicates(["path"])
    files = files if hidden is None else files.where(~hidden)
    meta = F.col("metadata_reason").isNotNull()
    inside = reduce(lambda a, b: a & b, (F.array_contains(F.slice(F.split(_low(), "/"), 1, F.size(F.split(_low(), "/")) - 1), p) for p in parts[:-1]), F.lit(True))
    anywhere = reduce(lambda a, b: a & b, (F.array_contains(F.split(_low(), "/"), p) for p in parts[:-1]), F.lit(True))
    named, holds = _last() == parts[-1], _low().contains(low)
    marked = files.select(
        "path", meta.alias("meta"), _low().endswith(low).alias("ends"), named.alias("named"), (named & inside).alias("by_name"), (holds & inside).alias("by_text"), ((named | holds) & anywhere).alias("loosely"),
        (~meta & (F.col("path") == text)).alias("exact"), (meta & (_low() == low)).alias("exact_meta"),
    ).where("exact OR exact_meta OR named OR by_text OR loosely")
    any_of = marked.agg(F.max("exact").alias("a"), F.max("exact_meta").alias("b"), F.max(F.col("named") & ~F.col("meta")).alias("c"), F.max(F.col("by_name") & ~F.col("meta")).alias("d"), F.max(F.col("by_text") & ~F.col("meta")).alias("e")).na.fill(False)
    stage = F.when(F.col("a"), F.col("exact")).when(F.col("b"), F.col("exact_meta")).when(F.col("c") & F.col("d"), ~F.col("meta") & F.col("by_name")).when(~F.col("c") & F.col("e"), ~F.col("meta") & F.col("by_text")).otherwise(F.col("meta") & F.col("loosely"))
    found = marked.crossJoin(F.broadcast(any_of)).where(stage)  # one row
    counted = found.agg(F.count("*").alias("n"))
    order = [F.desc(F.col("ends") & ~F.col("meta")), F.octet_length("path"), F.col("path")]
    shown = found.orderBy(*order).limit(AMBIGUOUS).withColumn("nth", F.row_number().over(Window.orderBy(*order)).cast("long"))  # at most ten rows
    every = counted.join(shown, F.lit(True), "left")
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").when(F.col("meta"), "resolved_metadata").otherwise("resolved")
    return every.select(status.alias("status"), "nth", "path", F.greatest(F.col("n") - AMBIGUOUS, F.lit(0).cast("long")).alias("overflow"))
