"""Ignore rules of nested rule files, and one disposition for each entry of a tree.

A rule file stands in a folder and holds lines: a blank line or one that begins
with a number sign says nothing; ``!`` takes back; a closing slash means folders
only; a slash at the front or inside ties the pattern to the rule file's folder,
any other pattern holds at every depth below; ``*`` and ``?`` stay within a name,
``**`` doesn't; ``[a-z]`` and ``\\`` as usual. Of all rules that match a path the
one of the deepest folder counts, there the last line. What lies in an ignored
folder is ignored, whatever rules say about it.

Every folder of a tree is decided once, however many files it has: prefixes of
paths are made distinct, joined to the rules of the folders above them by folder,
and the last match is a ``max_by``. Patterns become regular expressions once a
rule (a small Python function); matching stays in the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.admission import tier

#: Folders that are never entered.
HIDDEN = (".git",)
#: Bytes of a path beyond which an entry is only counted.
LONGEST_PATH = 4096


def pattern(line: str | None) -> tuple[str, bool, bool] | None:
    """(regular expression for a path below the rule file's folder, takes back, folders only); None of a line without a rule."""
    text = (line or "").rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    back = text.startswith("!")
    text = text[back:]
    folder = text.endswith("/")
    text = text.rstrip("/") if folder else text
    if not text:
        return None
    tied = "/" in text
    text = text.removeprefix("/")
    out, i = [] if tied else ["(?:.*/)?"], 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if text[i:] == "**" and i and text[i - 1] == "/":
            out.append(".+")
            break
        if c == "*":
            while text[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out.append(_quoted(text[i]))
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end]
            sign = "^/" if body[0] in "!^" else ""
            members = body[1:] if sign else body
            out.append("[" + sign + "".join(x if x == "-" else _quoted(x) for x in members) + "]")
            i = end
        else:
            out.append(_quoted(c))
        i += 1
    return "".join(out), back, folder


def _quoted(c: str) -> str:
    return c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c


def rules(files: DataFrame) -> DataFrame:
    """(folder, line_no, expression, back, folders_only) of rule files (folder, content); the top folder is empty."""
    lines = files.select("folder", F.posexplode(F.split("content", "\n")).alias("at", "line")).select("folder", (F.col("at") + 1).alias("line_no"), "line")

    @F.pandas_udf("expression string, back boolean, folders_only boolean")
    def compiled(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pattern(x) or (None, None, None) for x in text], columns=["expression", "back", "folders_only"])

    return lines.withColumn("r", compiled("line")).select("folder", "line_no", "r.*").where("expression IS NOT NULL")


def _above(path: Column, itself: bool) -> Column:
    """The folders above a path, the top one (empty) first, and the path itself if asked for."""
    parts = F.split(path, "/")
    most = F.size(parts) - (0 if itself else 1)
    return F.transform(F.sequence(F.lit(0), most), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored_prefixes(entries: DataFrame, ruled: DataFrame) -> DataFrame:
    """Distinct paths, of entries (path, is_folder) and of folders above them, whose last matching rule ignores them."""
    prefixes = entries.select(F.explode(F.filter(_above(F.col("path"), True), lambda x: x != "")).alias("prefix"), "path", "is_folder")
    distinct = prefixes.groupBy("prefix").agg(F.max((F.col("prefix") != F.col("path")) | F.col("is_folder")).alias("is_folder"))
    asked = distinct.select("prefix", "is_folder", F.explode(_above(F.col("prefix"), False)).alias("folder"))
    inside = F.when(F.col("folder") == "", F.col("prefix")).otherwise(F.expr("substring(prefix, length(folder) + 2)"))
    met = asked.join(ruled, "folder").where((F.col("is_folder") | ~F.col("folders_only")) & F.regexp_like(inside, F.concat(F.lit("^(?:"), "expression", F.lit(")$"))))
    last = met.groupBy("prefix").agg(F.max_by("back", F.struct(F.length("folder"), "line_no")).alias("back"))
    return last.where("NOT back").select("prefix")


def with_ignored(entries: DataFrame, ruled: DataFrame) -> DataFrame:
    """Entries (path, is_folder, ...) with ``ignored``: they or a folder above them are."""
    hit = ignored_prefixes(entries, ruled)
    below = entries.select("path", F.explode(_above(F.col("path"), True)).alias("prefix")).join(hit, "prefix", "left_semi").select("path").distinct()
    return entries.join(below.withColumn("ignored", F.lit(True)), "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def dispositions(entries: DataFrame, ruled: DataFrame, *, data: Column | None = None, denied: Column | None = None, lockfile: Column | None = None, binary: Column | None = None) -> DataFrame:
    """One disposition for each entry (path, is_folder, byte_len) that is a file.

    In order: ``hidden``, ``ignored``, ``unreadable`` (an unknown size),
    ``path_too_long``, then the admission tier, whose ``normal`` is ``ingest``.
    Only metadata decide, so nothing is read; the columns tell of files that
    are data, denied, lock files or binary (by default none is).
    """
    no = F.lit(False)
    flag = lambda c: no if c is None else F.coalesce(c, no)
    marked = with_ignored(entries, ruled).where("NOT is_folder")
    hidden = F.exists(_above(F.col("path"), True), lambda x: F.substring_index(x, "/", -1).isin(*HIDDEN))
    admitted = tier(F.col("byte_len"), flag(data), flag(denied), flag(lockfile), flag(binary))
    first = F.when(hidden, "hidden").when(F.col("ignored"), "ignored").when(F.col("byte_len").isNull(), "unreadable").when(F.octet_length("path") > LONGEST_PATH, "path_too_long")
    return marked.select("path", "byte_len", first.when(admitted == "normal", "ingest").otherwise(admitted).alias("disposition"))


def entries(scanned: DataFrame, root: str) -> DataFrame:
    """(path, is_folder, byte_len) below a root from files (path, byte_len) of a tree scan: relative, with forward slashes."""
    plain = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "^file:/+", "/")
    top = "/" + root.removeprefix("file:").strip("/") + "/"
    return scanned.select(plain.alias("path"), "byte_len").select(F.when(F.col("path").startswith(top), F.substring("path", len(top) + 1, 1 << 30)).otherwise(F.col("path")).alias("path"), F.lit(False).alias("is_folder"), "byte_len")
