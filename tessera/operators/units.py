"""Markdown sections as units of knowledge, and search over units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = 6


def headings(lines: DataFrame) -> DataFrame:
    """Headings of Markdown lines (path, line_no, line): (path, line_no, level, heading).

    A heading begins with number signs (level 1 to 6), or is a line of text over
    a row of equals signs (1) or dashes (2). Lines in fences and in a block
    between dashes at the very top are no headings. A fence ends at a run of its
    own character that is no shorter and has nothing behind it, or with the file.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rule = F.rtrim("line") == "---"
    opens = (F.col("line_no") == 1) & rule
    marked = lines.withColumn("_front", F.max(opens.cast("int")).over(so_far)).withColumn("_rules", F.sum(rule.cast("int")).over(so_far))
    marked = marked.withColumn("_top", (F.col("_front") == 1) & ((F.col("_rules") < 2) | (rule & (F.col("_rules") == 2))))
    marked = _fenced(marked)
    outside = ~F.col("_code") & ~F.col("_top")
    after = F.when(~F.lead("_code", 1, True).over(order), F.lead("line").over(order))
    signs = F.col("line").rlike(r"^ {0,3}#{1,6}(?:[ \t]|$)")
    text = F.trim(F.regexp_replace(F.regexp_replace("line", r"^ {0,3}#{1,6}", ""), r"(?:^|[ \t])#+[ \t]*$", ""))
    plain = (F.trim("line") != "") & ~signs & ~F.col("line").rlike(r"^ {0,3}(?:>|[-*+] |=+\s*$|-+\s*$)")
    under = F.when(after.rlike(r"^ {0,3}=+[ \t]*$"), 1).when(after.rlike(r"^ {0,3}-+[ \t]*$"), 2)
    level = F.when(outside & signs, F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})", 1))).when(outside & plain, under)
    heading = F.when(signs, text).otherwise(F.trim("line"))
    return marked.select("path", "line_no", level.cast("long").alias("level"), heading.alias("heading")).where("level IS NOT NULL")


def _fenced(lines: DataFrame) -> DataFrame:
    """``lines`` (path, line_no, line, _top) with ``_code``: the line is of a fence.

    Whether a run of marks opens, closes or is code depends on the fence that is
    open, so a file's runs, in one row, are folded in order; only they are.
    """
    run = F.regexp_extract("line", r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})", 1)
    bare = F.col("line").rlike(r"^ {0,3}(`{3,}|~{3,})[ \t]*$")
    runs = lines.where((run != "") & ~F.col("_top")).select("path", F.struct("line_no", F.substring(run, 1, 1).alias("mark"), F.length(run).alias("size"), bare.alias("bare")).alias("r"))
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit("").alias("mark"), F.lit(0).alias("size"), none.alias("opens"), none.alias("ends"))

    def step(acc: Column, r: Column) -> Column:
        opens = acc["mark"] == ""
        ends = ~opens & (acc["mark"] == r["mark"]) & (r["size"] >= acc["size"]) & r["bare"]
        put = lambda test, held: F.when(test, F.array_append(held, r["line_no"])).otherwise(held)
        mark = F.when(opens, r["mark"]).when(ends, "").otherwise(acc["mark"])
        return F.struct(mark.alias("mark"), F.when(opens, r["size"]).otherwise(acc["size"]).alias("size"), put(opens, acc["opens"]).alias("opens"), put(ends, acc["ends"]).alias("ends"))

    by_file = runs.groupBy("path").agg(F.aggregate(F.sort_array(F.collect_list("r")), start, step).alias("_f"))
    seen = lines.join(by_file, "path", "left").withColumn("_opens", (run != "") & F.array_contains("_f.opens", F.col("line_no"))).withColumn("_ends", (run != "") & F.array_contains("_f.ends", F.col("line_no")))
    order = Window.partitionBy("path").orderBy("line_no")
    opened = F.count_if("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended = F.count_if("_ends").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return seen.withColumn("_code", opened > ended).drop("_f", "_opens", "_ends")


def sections(lines: DataFrame) -> DataFrame:
    """Units (path, unit, level, heading_path, parent, first_line, last_line) of Markdown lines.

    A section's parent is the nearest section above of a lower level; its path has
    the headings from the top. A section ends where one of its level or lower
    begins. Units are numbered from 1 in each path.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = headings(lines).withColumn("unit", F.row_number().over(order).cast("long"))
    # the newest unit of each level so far; one of a lower level that came later hides it
    newest = [F.max(F.when(F.col("level") == n, F.struct("unit", "heading"))).over(so_far) for n in range(1, LEVELS + 1)]
    heads = heads.select("*", *[c.alias(f"_{n}") for n, c in enumerate(newest, 1)])
    seen = lambda n: F.coalesce(F.col(f"_{n}.unit"), F.lit(0).cast("long"))
    shows = lambda n: (seen(n) > 0) & reduce(lambda a, b: a & b, (seen(n) > seen(m) for m in range(1, n)), F.lit(True)) & (F.lit(n) <= F.col("level"))
    path = F.array_compact(F.array(*[F.when(shows(n), F.col(f"_{n}.heading")) for n in range(1, LEVELS + 1)]))
    parent = F.greatest(*[F.when(shows(n) & (F.lit(n) < F.col("level")), seen(n)) for n in range(1, LEVELS + 1)], F.lit(None).cast("long"))
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= n, F.col("line_no"))).over(ahead) for n in range(1, LEVELS + 1)]
    end = F.element_at(F.array(*[F.col(f"_e{n}") for n in range(1, LEVELS + 1)]), F.col("level").cast("int"))
    sizes = lines.groupBy("path").agg(F.max("line_no").alias("_size"))
    made = heads.select("*", *[c.alias(f"_e{n}") for n, c in enumerate(ends, 1)], path.alias("heading_path"), parent.alias("parent")).join(sizes, "path")
    return made.select("path", "unit", "level", "heading_path", "parent", F.col("line_no").alias("first_line"), (F.coalesce(end, F.col("_size") + 1) - 1).alias("last_line"))


def search(units: DataFrame, query: str, *, limit: int = 10) -> DataFrame:
    """Units (source_rank, path, unit_start, heading, text) that hold a phrase or one of its words: the best of all sources together.

    In order: the whole phrase, a heading with a word, more different words, the
    source's rank, then path, line and the unit's start. The line is the first
    that holds the phrase, or else a word, counted from the unit's start.
    """
    phrase = " ".join(query.lower().split())
    words = sorted(set(phrase.split(" ")) - {""})
    if not words or not 1 <= limit <= 100:
        raise ValueError("a query has words, and a limit is 1 to 100")
    text, heading = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("heading", F.lit("")))
    holds = lambda c: reduce(lambda a, b: a | b, (c.contains(w) for w in words))
    exact = text.contains(phrase) | heading.contains(phrase)
    distinct = sum(((text.contains(w) | heading.contains(w)).cast("long") for w in words), F.lit(0).cast("long"))
    each = F.split(text, "\n")

    def first(test) -> Column:
        at = F.array_position(F.transform(each, test), True)
        return F.when(at > 0, at)

    place = F.coalesce(first(lambda x: x.contains(phrase)), first(holds), F.lit(1).cast("long"))
    found = units.select("source_rank", "path", "unit_start", exact.alias("exact_phrase"), holds(heading).alias("heading_match"), distinct.alias("distinct_terms"), (F.col("unit_start") + place - 1).alias("line")).where("exact_phrase OR distinct_terms > 0")
    return found.orderBy(F.desc("exact_phrase"), F.desc("heading_match"), F.desc("distinct_terms"), "source_rank", "path", "line", "unit_start").limit(limit)


def language_vote(files: DataFrame, folded: dict[str, str], code: list[str]) -> DataFrame:
    """One row: the code language with most files, its share's runner-up if above a quarter, and both shares in whole per cent.

    ``folded`` names languages that vote for another one; a winner whose own
    files are fewer than those of a language folded into it takes that one's name.
    """
    own = files.where(F.col("language").isin(*code)).groupBy("language").agg(F.count("*").alias("n"))
    bucket = F.coalesce(*[F.when(F.col("language") == k, F.lit(v)) for k, v in folded.items()], F.col("language"))
    # languages are a fixed short list, so one row holds them
    votes = own.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.max(F.struct("n", (F.col("language") == bucket).alias("first"), "language")).alias("top"))
    ranked = votes.agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("_order"), "bucket", "n", F.col("top.language").alias("label")))).alias("v"))
    second = F.get("v", F.lit(1))
    share = lambda n: F.floor(100 * n / F.col("total")).cast("long")
    return ranked.where("total > 0").select(
        F.get("v", F.lit(0))["label"].alias("language"),
        share(F.get("v", F.lit(0))["n"]).alias("percent"),
        F.when(second["n"] * 100 > F.col("total") * 25, second["bucket"]).alias("second"),
        F.when(second["n"] * 100 > F.col("total") * 25, share(second["n"])).alias("second_percent"),
    )


def conventions(files: DataFrame, symbols: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Per language: files, tests, sizes, names by style, and how many files hold each pattern.

    ``files`` is (path, language, content, byte_len, test), ``symbols`` (language,
    name, kind); ``patterns`` names a (language, text to look for) each.
    """
    holds = [F.count_if((F.col("language") == lang) & F.col("content").contains(text)).alias(name) for name, (lang, text) in patterns.items()]
    per = files.groupBy("language").agg(F.count("*").alias("n_files"), F.count_if("test").alias("n_tests"), F.max("byte_len").alias("largest"), F.round(F.avg("byte_len"), 6).alias("mean_bytes"), *holds)
    called = F.col("kind").isin("fn", "function", "method")
    snake, camel, pascal = (F.col("name").rlike(p) for p in ("^[a-z][a-z0-9]*(_[a-z0-9]+)+$", "^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$", "^([A-Z][a-z0-9]*)+$"))
    names = symbols.groupBy("language").agg(F.count_if(called & snake).alias("snake_functions"), F.count_if(called & camel).alias("camel_functions"), F.count_if(called).alias("functions"), F.count_if(~called & pascal).alias("pascal_types"), F.count_if(~called).alias("types"))
    return per.join(names, "language", "left").na.fill(0, ["snake_functions", "camel_functions", "functions", "pascal_types", "types"])


def repository_map(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files, bytes and symbols in all, by language and by folder of at most two levels: (language, folder, n_files, bytes, n_symbols)."""
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(2))), "/")).otherwise(".")
    per = symbols.groupBy("path").agg(F.count("*").alias("n"))
    rows = files.join(per, "path", "left").select(F.col("language"), folder.alias("folder"), "byte_len", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return rows.groupingSets([[], ["language"], ["folder"]], "language", "folder").agg(F.count("*").alias("n_files"), F.sum("byte_len").alias("bytes"), F.sum("n").alias("n_symbols"))
