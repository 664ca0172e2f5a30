"""Document fingerprints: Merkle trees over sections and paragraphs, in DataFrame functions only.

A text is split into sections (at empty lines), these into paragraphs (lines)
and these into phrases. A paragraph's node is a digest of its text, a section's
of its paragraphs' nodes, the root of the sections' nodes; so equal roots mean
equal texts, and where roots differ, differing nodes lead to the paragraphs that
differ (:func:`differing`). A fingerprint is

    root:section=paragraph/phrase,phrase+paragraph/phrase|section=...

with 64, 16, 16 and 8 hexadecimal digits. Likeness is twice the number of
different phrases two fingerprints share, over the numbers each has.

Scale. A document needs the start of the next one by id. Neighbours are found on
ids and lengths alone, range-partitioned; only the last row of each partition,
one a partition, crosses over. Texts are shuffled once by id, and of a next
document only as much as the edit takes and its fingerprint.

Nulls, ties, repeats: a null text is empty. Rows of one id and different texts
follow each other by hash; equal rows count once in the order and all come
back. A row without an id has no next document: its text is edited into itself,
and near_next is null. An empty table gives an empty result. Extra columns are
ignored. A very long text is one row, as in its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.scratch import cut

#: A phrase ends after a mark, or after a word that ends in s or d, so texts without marks have phrases too.
_PHRASES = r"(?<=[.!?,;:|sd])\s+"


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that isn't null."""

    def paragraph(p: Column) -> Column:
        phrases = F.transform(F.split(p, _PHRASES), lambda x: F.lpad(F.lower(F.hex(F.crc32(x))), 8, "0"))
        return F.concat(F.substring(F.sha2(p, 256), 1, 16), F.lit("/"), F.array_join(phrases, ","))

    def section(s: Column) -> Column:
        return F.array_join(F.transform(F.split(s, "\n"), paragraph), "+")

    def named(paragraphs: Column) -> Column:
        nodes = F.transform(F.split(paragraphs, r"\+"), lambda p: F.substring(p, 1, 16))
        return F.concat(F.substring(F.sha2(F.array_join(nodes, ""), 256), 1, 16), F.lit("="), paragraphs)

    tree = F.array_join(F.transform(F.transform(F.split(text, "\n\n"), section), named), "|")
    # the root also covers the text itself: short nodes alone would leave it to chance
    return F.concat(F.sha2(F.concat(F.sha2(text, 256), tree), 256), F.lit(":"), tree)


def phrases(print_: Column) -> Column:
    """Different phrase marks of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(print_, F.lit("(?<=[/,])[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints."""
    x, y = phrases(a), phrases(b)
    return F.when(a == b, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def differing(a: Column, b: Column) -> Column:
    """``(section, paragraph)`` places, from 0, at which the paragraphs of two fingerprints differ."""

    def sections(x: Column) -> Column:
        return F.split(F.substring(x, 66, 1 << 30), r"\|")

    def paragraphs(s: Column) -> Column:
        return F.transform(F.split(F.substring(s, 18, 1 << 30), r"\+"), lambda p: F.substring(p, 1, 16))

    def within(x: Column, y: Column, i: Column) -> Column:
        pairs = F.transform(F.arrays_zip(paragraphs(x).alias("x"), paragraphs(y).alias("y")), lambda z, j: F.struct(i.alias("section"), j.alias("paragraph"), (~z["x"].eqNullSafe(z["y"])).alias("differs")))
        return F.filter(pairs, lambda z: z["differs"])

    zipped = F.arrays_zip(sections(a).alias("x"), sections(b).alias("y"))
    lists = F.transform(zipped, lambda z, i: F.when(F.substring(z["x"], 1, 16).eqNullSafe(F.substring(z["y"], 1, 16)), F.array().cast("array<struct<section:int,paragraph:int,differs:boolean>>")).otherwise(within(F.coalesce(z["x"], F.lit("")), F.coalesce(z["y"], F.lit("")), i)))
    return F.transform(F.flatten(lists), lambda z: F.struct(z["section"], z["paragraph"]))


def _previous(ids: DataFrame) -> DataFrame:
    """``ids`` (id, tie, n) in order, each with the row before it; before the first stands the last."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that both uses see the same partitions
    dealt = cut(ids.repartitionByRange(parts, "id", "tie").withColumn("part", F.spark_partition_id()), "ordered")
    whole = F.struct("id", "tie", "n")
    order = Window.partitionBy("part").orderBy("id", "tie")
    inside = dealt.withColumn("before", F.lag(whole).over(order))
    # one row a partition from here on
    ends = dealt.groupBy("part").agg(F.max(whole).alias("last"))
    ring = Window.orderBy("part")
    across = ends.withColumn("across", F.coalesce(F.lag("last").over(ring), F.max("last").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    joined = inside.join(F.broadcast(across.select("part", "across")), "part")
    return joined.select("id", "tie", F.coalesce("before", "across").alias("p")).select("id", "tie", F.col("p.id").alias("prev_id"), F.col("p.tie").alias("prev_tie"), F.floor(F.col("p.n") / 4).alias("taken"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (code points, rounded down) replaced by
    as many first ones of the next document.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = texts.where("id IS NOT NULL").withColumn("tie", F.xxhash64("text"))
    ids = cut(keyed.select("id", "tie", F.length("text").alias("n")).groupBy("id", "tie").agg(F.max("n").alias("n")), "ids", compact=True)
    before = cut(_previous(ids), "neighbours", compact=True)

    starts = keyed.join(before, ["id", "tie"]).select("prev_id", "prev_tie", F.expr("substring(text, 1, int(taken))").alias("start"), fingerprint(F.col("text")).alias("next_fingerprint"))
    starts = starts.groupBy(F.col("prev_id").alias("id"), F.col("prev_tie").alias("tie")).agg(F.first("start").alias("start"), F.first("next_fingerprint").alias("next_fingerprint"))
    out = keyed.join(starts, ["id", "tie"])
    edited = F.concat(F.expr("substring(text, 1, int(length(text) - floor(length(text) / 4)))"), F.col("start"))
    out = out.select("id", "text", edited.alias("edited"), "next_fingerprint")
    alone = texts.where("id IS NULL").select("id", "text", F.col("text").alias("edited"), F.lit(None).cast("string").alias("next_fingerprint"))
    out = out.unionByName(alone).withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return out.select(
        F.col("id").alias(id_col),
        F.length("text").cast("long").alias("n_chars"),
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
