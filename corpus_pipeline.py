"""A corpus pipeline of five stages over ``documents``.

Quality classifier, MinHash near-dedup, suffix-array dedup, secret scans,
best-fit packing. Each stage takes the documents its predecessor kept, as they
then are, and its decisions take effect: rejected documents go, one document of
each near-duplicate group stays, repeated passages and secrets leave the texts,
and what is left is packed. All but the last return the columns of documents;
other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import packing, quality, secrets
from tessera.llm._tables import table
from tessera.llm.minhash import near_duplicates
from tessera.llm.suffix_dedup import remove_repeats
from tessera.scratch import cut, fewer_files

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold.

    Null, empty and wordless texts score 0 and go, having nothing to train on.
    Ids may be null or repeated: each row is judged by its text alone. Without
    usable labels every document with words stays. An empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at 0.8 or more.

    Null and empty texts are linked with nothing and stay. Rows without an id
    belong to no group and all stay. Rows that share an id are one document and
    stay or go together. An empty table stays empty.
    """
    kept = near_duplicates(docs, shingle=5, similarity=(4, 5)).where("kept").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").select(*COLUMNS)
    return fewer_files(named.unionByName(docs.where("doc_id IS NULL").select(*COLUMNS)))  # null equals no id in the join


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 100 that also start earlier; a document that they emptied goes.

    A character of which a byte goes, goes whole; all others stay as they are.
    Null texts come back empty, as empty ones do. Rows without an id keep their
    text. Rows that share an id are one document, in which a start that both
    have is no repeat. An empty table stays empty.
    """
    out = remove_repeats(docs, length=100, carry=("lang", "source", "n_chars"), characters=True).where("octet_length(kept) > 0 OR n_bytes = 0")
    text = F.expr("CAST(kept AS STRING)")
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark.

    All rows stay, whatever their id; a null text stays null (with null n_chars),
    an empty one empty. An empty table stays empty.
    """
    out = secrets.scan(docs.select(*COLUMNS), redact=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence and place there.

    Null and empty texts are one end token. Rows come back piece by piece
    whatever their id. An empty table gives no pieces.
    """
    pieces = packing.tokenize(docs).select("id", "piece", "start", "length", F.crc32("ids").alias("crc"))
    return packing.pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: The stages can't be put in SQL; tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
