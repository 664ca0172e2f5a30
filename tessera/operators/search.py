"""Text, symbol and path search with explainable ranks and bounded results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


class InvalidQuery(ValueError):
    """An empty or malformed query."""


def literal(term: str, *, case: bool = False) -> Column:
    if not term:
        raise InvalidQuery("the term is empty")
    return F.col("line").contains(term) if case else F.lower("line").contains(term.lower())


def any_of(terms: list[str], *, case: bool = False) -> Column:
    if not terms:
        raise InvalidQuery("no terms")
    return reduce(lambda a, b: a | b, (literal(t, case=case) for t in terms))


def regex(pattern: str, *, case: bool = True) -> Column:
    if not pattern:
        raise InvalidQuery("the pattern is empty")
    try:
        re.compile(pattern)
    except re.error as e:
        raise InvalidQuery(str(e)) from e
    return F.col("line").rlike(pattern if case else f"(?i){pattern}")


def whole_word(term: str, *, case: bool = False) -> Column:
    if not term:
        raise InvalidQuery("the term is empty")
    escaped = re.sub(r"([^\w])", r"\\\1", term)
    return F.col("line").rlike(("" if case else "(?i)") + rf"(^|[^0-9A-Za-z_]){escaped}($|[^0-9A-Za-z_])")


def text_search(lines: DataFrame, match: Column, *, per_file: int = 5, total: int = 50) -> DataFrame:
    """Matching lines, the files with most matches first, at most ``per_file`` of a file and ``total`` of all.

    One pass: matching lines meet by file, which keeps its first ones. Each file
    yields a line at least, so the ``total`` best files suffice: they come from a
    top-k, and the running budget is a window over those few rows.
    """
    in_file = Window.partitionBy("path").orderBy("line_no")
    hits = lines.where(match).select("path", "line_no", "line").withColumn("nth", F.row_number().over(in_file)).withColumn("matches", F.count("*").over(Window.partitionBy("path")))
    per = hits.where(F.col("nth") <= per_file).groupBy("path", "matches").agg(F.sort_array(F.collect_list(F.struct("nth", "line_no", "line"))).alias("first"))
    best = per.orderBy(F.desc("matches"), "path").limit(total)
    running = Window.orderBy(F.desc("matches"), "path").rowsBetween(Window.unboundedPreceding, -1)
    budget = best.withColumn("left", total - F.coalesce(F.sum(F.least("matches", F.lit(per_file))).over(running), F.lit(0))).where("left > 0")
    shown = budget.select("path", "matches", "left", F.explode("first").alias("x"))
    return shown.where(F.col("x.nth") <= F.col("left")).select("path", "x.line_no", "x.line", "matches")


def search_totals(lines: DataFrame, match: Column, hidden: Column) -> DataFrame:
    """Matches, files and matches that the noise policy hides, in one pass."""
    return lines.where(match).agg(
        F.count(F.when(~hidden, 1)).alias("matches"),
        F.count_distinct(F.when(~hidden, F.col("path"))).alias("files"),
        F.count(F.when(hidden, 1)).alias("suppressed"),
    )


def context_windows(lines: DataFrame, match: Column, around: int) -> DataFrame:
    """Lines within ``around`` of a match; adjacent or overlapping windows are one block.

    Where lines say how many their file has (``n_lines``), only matches are moved.
    """
    if "n_lines" in lines.columns:
        hits = lines.where(match).withColumn("last", F.col("n_lines"))
    else:
        hits = lines.where(match).join(lines.groupBy("path").agg(F.max("line_no").alias("last")), "path")
    near = hits.select("path", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("line_no") - around), F.least("last", F.col("line_no") + around))).alias("line_no")).distinct()
    order = Window.partitionBy("path").orderBy("line_no")
    fresh = F.coalesce(F.col("line_no") - F.lag("line_no").over(order) > 1, F.lit(True)).cast("long")
    blocks = near.withColumn("block", F.sum(fresh).over(order))
    return blocks.groupBy("path", "block").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def importance(files: DataFrame, *, considered: int = 500) -> DataFrame:
    """Files (path, matches, callers, churn, kind_priority) with a weighted importance; the best ``considered`` by matches."""
    some = files.orderBy(F.desc("matches"), "path").limit(considered)
    most = F.max("matches").over(Window.partitionBy())
    score = 0.30 * F.col("matches") / most + 0.40 * F.least(F.col("callers") / 20.0, F.lit(1.0)) + 0.15 * F.col("churn") + 0.15 * F.col("kind_priority")
    return some.withColumn("score", F.round(score, 6))


def symbol_search(symbols: DataFrame, query: str, *, limit: int = 20) -> DataFrame:
    """Symbols by tier: 0 the name itself, 1 a prefix (shorter names first), 2 inside (earlier places first)."""
    if not query:
        raise InvalidQuery("the query is empty")
    q, name = query.lower(), F.lower("name")
    tier = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(q), 2)
    tie = F.when(tier == 0, 0).when(tier == 1, F.length("name")).otherwise(F.instr(name, q))
    found = symbols.withColumn("tier", tier.cast("long")).where("tier IS NOT NULL").withColumn("tie", tie.cast("long"))
    return found.orderBy("tier", "tie", "name", "path", "line").limit(limit)


def symbol_browse(symbols: DataFrame, references: DataFrame, *, limit: int = 20) -> DataFrame:
    """The most referenced symbols, one a name and kind."""
    counts = references.groupBy("name").agg(F.count("*").alias("ref_count"))
    joined = symbols.join(counts, "name", "left").withColumn("ref_count", F.coalesce("ref_count", F.lit(0).cast("long")))
    first = Window.partitionBy("name", "kind").orderBy("path", "line")
    return joined.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth").orderBy(F.desc("ref_count"), "kind", "path", "line", "name").limit(limit)


def did_you_mean(names: DataFrame, query: str, *, limit: int = 5) -> DataFrame:
    """Names like the query: 0 where one holds the other, else the longer's bytes less the shared beginning, or less the shared characters.

    Names that share no character, and those shorter than two bytes (or the
    query), are left out.
    """
    if not query:
        raise InvalidQuery("the query is empty")
    q, name = query.lower(), F.lower("name")
    longest = F.greatest(F.octet_length("name"), F.lit(len(query.encode())))
    beginning = sum((name.startswith(q[:i]).cast("int") for i in range(1, len(q) + 1)), F.lit(0))
    shared = F.size(F.array_intersect(F.split(name, ""), F.array(*[F.lit(c) for c in sorted(set(q))])))
    distance = F.when(name.contains(q) | F.lit(q).contains(name), 0).when(beginning > 0, longest - beginning).when(shared > 0, longest - shared).cast("long")
    some = names.select("name").where(F.octet_length("name") >= min(2, len(query.encode()))).distinct()
    return some.withColumn("distance", distance).where("distance IS NOT NULL").orderBy("distance", "name").limit(limit)


def path_search(files: DataFrame, query: str, *, limit: int = 20) -> DataFrame:
    """Paths by tier: 0 the path's end, 1 its last part, 2 the start of that, 3 anywhere."""
    if not query:
        raise InvalidQuery("the query is empty")
    q, path = query.lower(), F.lower("path")
    base = F.element_at(F.split(path, "/"), -1)
    tier = F.when(path.endswith("/" + q) | (path == q), 0).when(base == q, 1).when(base.startswith(q), 2).when(path.contains(q), 3)
    return files.select("path").distinct().withColumn("tier", tier.cast("long")).where("tier IS NOT NULL").orderBy("tier", F.length("path"), "path").limit(limit)


def path_resolve(files: DataFrame, query: str) -> DataFrame:
    """One row: resolved, ambiguous or not_found, the number of candidates in the best tier, and the least of them."""
    tiers = path_search(files, query, limit=1 << 30)
    best = tiers.agg(F.min("tier").alias("best"))
    out = tiers.join(F.broadcast(best), F.col("tier") == F.col("best")).agg(F.count("*").alias("candidates"), F.min("path").alias("first_path"))
    status = F.when(F.col("candidates") == 1, "resolved").when(F.col("candidates") > 1, "ambiguous").otherwise("not_found")
    return out.select(status.alias("status"), "candidates", "first_path")


def trigrams(text: Column) -> Column:
    """Different grams of three characters of a lower-cased text; characters are cut apart once, so that a text's cost grows with its length."""
    chars = F.split(F.lower(text), "")
    joined = lambda a, b: F.concat(a, b)
    grams = F.zip_with(F.zip_with(chars, F.slice(chars, 2, F.size(chars)), joined), F.slice(chars, 3, F.size(chars)), joined)
    return F.when(F.length(text) >= 3, F.array_distinct(F.filter(grams, lambda g: g.isNotNull()))).otherwise(F.array().cast("array<string>"))


def trigram_search(grams: DataFrame, units: DataFrame, query: str) -> DataFrame:
    """Units (id, text) that hold the query: all its grams in ``grams`` (gram, id), then verified; short queries scan."""
    q = query.lower()
    verified = F.lower("text").contains(q)
    wanted = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    if not wanted:
        return units.where(verified)
    have = grams.where(F.col("gram").isin(wanted)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return units.join(have, "id", "left_semi").where(verified)


def fuse(frame: DataFrame, signals: dict[str, tuple[float, Column]], *, name: str = "score") -> DataFrame:
    """A weighted sum of named signals; nulls count nothing."""
    total = reduce(lambda a, b: a + b, (F.lit(w) * F.coalesce(c, F.lit(0.0)) for w, c in signals.values()))
    return frame.withColumn(name, F.round(total, 6))
