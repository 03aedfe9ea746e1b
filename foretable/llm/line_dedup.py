"""Line deduplication across documents, in DataFrame operations only.

Lines become (key hash, document, position). They are range-partitioned by hash and sorted within the partitions by
document and position, and a window that only looks back streams through each line's run: its first occurrence names
the document that keeps the line, every later document in the run loses it. A line may occur in a third of all
documents: the range key therefore also holds a slice number taken from the document, which cuts every run into pieces.
There are as many slices as keep a piece to about SLICE_ROWS lines even if one line were all there is (counted, and at
least SLICES); the first occurrences of the pieces are then compared, and the others never leave their partition. What comes back is no text but, for each document that loses lines, a compressed bitmap of
the lines that it keeps: (word number, 64 bits) for those 64-line stretches only that lose something. Applying it to the
text is a separate step. Texts are read twice: for the lines' keys, which are stored (a row of some 50 bytes a line), and
to apply.

Edge cases: null and empty text is one empty line. Rows that repeat document id and text share one bitmap; rows of one
id with different texts are one document with several texts, and each has its own bitmap. A null id is one document
that comes after all others. Keys shorter than min_chars never count. Columns of the caller keep their values, whatever
their names, but for n_lines, n_dropped and kept_text, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretable.llm.common import SPACE, Scratch, ascii_lower, text_or_empty

#: Pieces into which the run of one line is cut at least, and lines from which there are more pieces.
SLICES, SLICE_ROWS = 64, 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _prints(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells texts apart: the id, which may be null or repeated, and a fingerprint of the text."""
    return F.col(id_col), F.xxhash64(text_or_empty(text_col))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, slices: int = SLICES) -> DataFrame:
    """(id, print, kept): a row for each text that loses lines; kept is an array of (word, bits), bit i of word w standing for
    line 64 * w + i. Lines of words that aren't named are kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    id_, print_ = _prints(id_col, text_col)
    # the print comes before the lines: beside posexplode it would be made, and the text carried, once for each line
    texts = docs.select(id_.alias("id"), print_.alias("print"), lines_of(text_or_empty(text_col)).alias("lines"))
    lines = texts.select("id", "print", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    lines = scratch.store(lines.select(F.unhex(F.md5("key")).alias("hash"), F.struct(F.col("id").isNull().alias("last"), "id").alias("doc"), "print", "pos"), "lines")
    slices = max(slices, lines.count() // SLICE_ROWS)
    runs = lines.withColumn("slice", F.pmod(F.xxhash64("doc.id"), F.lit(slices)))
    runs = runs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "hash", "slice")
    # the range partitions already hold each run together: this adds a sort, and no exchange
    run = Window.partitionBy("hash", "slice").orderBy("doc", "pos", "print")
    runs = runs.withColumns({"head": F.first("doc").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "no": F.row_number().over(run)})
    runs = scratch.store(runs, "runs")
    first = runs.where("no = 1").groupBy("hash").agg(F.min("head").alias("first"), F.count("*").alias("pieces")).where("pieces > 1").drop("pieces")
    place = ["doc", "print", "pos"]
    later = runs.where(F.col("doc") != F.col("head")).select(*place)
    lost = later.unionByName(runs.where(F.col("doc") == F.col("head")).join(first, "hash").where(F.col("head") != F.col("first")).select(*place))
    word = F.floor(F.col("pos") / 64).cast("int")
    bits = F.expr("shiftleft(1L, pos % 64)")
    marks = lost.groupBy(F.col("doc.id").alias("id"), "print", word.alias("word")).agg(F.bitwise_not(F.bit_or(bits)).alias("bits"))
    out = scratch.store(marks.groupBy("id", "print").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("kept")), "bitmaps")
    scratch.drop("lines", "runs")
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text."""
    id_, print_ = _prints(id_col, text_col)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(F.struct(*dict.fromkeys([*names, text_col])).alias("row"), id_.alias("id"), print_.alias("print"))
    # words in their places up to the last one named, so that a line finds its word by position however many are named
    placed = F.flatten(F.expr("transform(kept, (x, i) -> concat(array_repeat(-1L, x.word - 1 - if(i = 0, -1, kept[i - 1].word)), array(x.bits)))"))
    marks = bitmaps.select(F.col("id").alias("of"), F.col("print").alias("as"), placed.alias("bits"))
    # nothing bounds the bitmaps of all documents, so they are never broadcast
    rows = rows.join(marks.hint("shuffle_merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("as")), "left").withColumn("lines", lines_of(text_or_empty(F.col("row")[text_col])))
    kept = F.expr("filter(lines, (line, i) -> coalesce(shiftright(get(bits, int(i div 64)), i % 64) & 1L, 1L) = 1L)")
    rows = rows.withColumn("kept", F.when(F.col("bits").isNull(), F.col("lines")).otherwise(kept))
    n, k = F.size("lines").cast("long"), F.size("kept").cast("long")
    return rows.select(*(F.col("row")[c].alias(c) for c in names), n.alias("n_lines"), (n - k).alias("n_dropped"), F.concat_ws("\n", "kept").alias("kept_text"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, slices: int = SLICES) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; columns of these names are replaced."""
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_chars, slices), id_col, text_col)
