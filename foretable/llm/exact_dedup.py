"""Exact deduplication by a 128-bit content hash, with a comparison of bytes inside each group.

Every row is reduced to the MD5 of its normalised text (A-Z lower-cased, null counts as empty). One aggregation by
hash, which holds no text, finds the size of a group and the id that stays. Of groups of two rows or more, and only of
those, a second one finds the least and greatest text in byte order: they are the same exactly when all texts of the
group are, which is the comparison of bytes. Both combine on the map side, so a group that holds a third of all rows
still sends one row a task. Groups whose texts differ (a collision) are split by their full texts. Rows find their group
by an equi-join, for which they carry hashes and no text, and whose two sides are both exchanged for it, so adaptive
execution splits a hot hash.

Edge cases: null text is the empty text; a null id never stays while the group has another id; if all are null,
keep_id is null and every row of the group counts as kept. Rows that repeat id and text share one verdict. An empty
table gives an empty result. Columns of the input other than id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.llm.common import Scratch, ascii_lower, sized, text_or_empty


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", content_hash: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest", the id that stays of equal texts. content_hash: from normalised text to the key.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    norm = ascii_lower(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("hash", content_hash(F.col("norm")))
    scratch = Scratch(docs.sparkSession, "exact")
    groups = scratch.store(rows.groupBy("hash").agg(F.count("*").alias("group_size"), best("id").alias("keep_id")), "groups")
    shared = scratch.store(groups.where("group_size > 1").select("hash"), "shared")
    ends = rows.join(sized(shared), "hash", "left_semi").groupBy("hash").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    collided = scratch.store(ends.where(F.col("least") != F.col("greatest")).select("hash"), "collided")
    scratch.drop("shared")
    marked = rows.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm")
    if collided.isEmpty():
        return _verdicts(marked.join(groups, "hash"), id_col)
    out = _verdicts(marked.join(groups.join(collided, "hash", "left_anti"), "hash"), id_col)
    mixed = rows.join(collided, "hash", "left_semi")
    exact = scratch.store(mixed.groupBy("hash", "norm").agg(F.count("*").alias("group_size"), best("id").alias("keep_id")), "by-text")
    return out.unionByName(_verdicts(mixed.join(exact, ["hash", "norm"]).withColumn("text_sha256", F.sha2("norm", 256)), id_col))


def _verdicts(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
