"""Admission tiers, path classes, sensitive content, health and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KIB = 1 << 10
MIB = 1 << 20


def tier(size: Column, data: Column, denied: Column, lockfile: Column, binary: Column) -> Column:
    """The first rule that holds."""
    return (
        F.when(size > 100 * MIB, "hard_skip")
        .when(lockfile, "lockfile")
        .when(denied, "denied")
        .when(data & (size > MIB), "too_large")
        .when(~data & (size > 4 * MIB), "too_large")
        .when(binary, "binary")
        .otherwise("normal")
    )


def control_share(text: Column) -> Column:
    """Share of control characters (tab, line ends left out) in the first 8 KiB."""
    head = F.substring(text, 1, 8 * KIB)
    size = F.length(head)
    return F.when(size > 0, F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")) / size).otherwise(0.0)


def path_class(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    return F.when(has("vendor", "node_modules", "third_party"), "vendor").when(has("dist", "build", "generated", "gen"), "generated").when(has("test", "tests"), "test").otherwise("source")


def screen(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Files (path, content) as clean or sensitive, with the ids of the rules that match and the number of matches."""
    counts = {r: F.regexp_count("content", F.lit(p)) for r, p in rules.items()}
    ids = F.array_compact(F.array(*[F.when(c > 0, F.lit(r)) for r, c in counts.items()]))
    total = sum(counts.values(), F.lit(0)).cast("long")
    return files.select("path", F.when(total > 0, "sensitive").otherwise("clean").alias("state"), F.array_join(ids, ",").alias("rule_ids"), total.alias("matches"))


def collisions(files: DataFrame, identity: Column) -> DataFrame:
    return files.groupBy(identity.alias("identity")).agg(F.count_distinct("path").alias("paths"), F.min("path").alias("first_path")).where("paths > 1")


def catalog_digest(files: DataFrame, by: list[str], *, digits: int = 3) -> DataFrame:
    """Per group of (path, byte_len) the number of files and a digest: of digests of buckets, which are named by the first digits of the path's MD5."""
    line = F.struct("path", F.concat_ws(":", "path", F.col("byte_len").cast("string")).alias("line"))
    listed = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), "\n"), 256)
    buckets = files.groupBy(*by, F.substring(F.md5("path"), 1, digits).alias("_b")).agg(F.count("*").alias("n"), listed(line).alias("line"))
    return buckets.groupBy(*by).agg(F.sum("n").alias("n"), listed(F.struct("_b", "line")).alias("digest"))


def keep_newest(rows: DataFrame, order: str, n: int, *, by: list[str]) -> DataFrame:
    """The newest ``n`` rows of each group."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def breaker(parsed: DataFrame, *, threshold: float = 0.20, least: int = 5) -> DataFrame:
    """Whether failures (failed: boolean) trip the breaker."""
    share = F.avg(F.col("failed").cast("double"))
    out = parsed.agg(F.count("*").alias("files"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("share"))
    return out.withColumn("tripped", (F.col("files") >= least) & (F.col("share") > threshold))


def calibration(samples: DataFrame, *, least: int = 24, gain: float = 0.20) -> DataFrame:
    """Median ratio of actual to predicted (clamped to a quarter and four) from training rows, tried on held-out ones."""
    ratio = F.expr("percentile(actual / predicted, 0.5) FILTER (WHERE NOT held)")
    usable = samples.where("predicted > 0")
    factor = usable.agg(F.count("*").alias("n"), F.greatest(F.lit(0.25), F.least(F.lit(4.0), ratio)).alias("factor"))
    tried = usable.where("held").join(F.broadcast(factor)).agg(F.max("n").alias("n"), F.max("factor").alias("factor"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("before"), F.avg(F.abs(F.col("actual") - F.col("predicted") * F.col("factor"))).alias("after"))
    state = F.when(F.col("n") == 0, "deferred").when(F.col("n") < least, "accumulating").otherwise("tuned")
    return tried.select("n", F.round("factor", 6).alias("factor"), F.round("before", 6).alias("mae_before"), F.round("after", 6).alias("mae_after"), state.alias("state"), (F.col("after") <= (1 - gain) * F.col("before")).alias("accepted"))
