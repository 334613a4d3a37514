"""Rows found again where they are stored: which file, and which row of it.

An operator that shuffles narrow rows (digests, fingerprints) and then needs the texts of some of them again
marks their places, and reads the texts once more with the marks beside the scan: no text is shuffled, however
many rows are marked. Marks are bits, 64 rows to a word; words are gathered by stretches of 4,096 rows of a file,
and the stretches of a block of files are sent to all tasks. Where there are more than ``STRETCHES``, files
are dealt to more blocks by a hash of their paths, one scan of its own files for each, so what is sent at once does
not grow with the input. Only a single file that has more (67 million rows) would be sent in one.

Frames must give the same rows whenever they are read, as files do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, scratch

#: Stretches sent to all tasks at once: about a kilobyte each where all rows are marked, so 20 MB at most.
STRETCHES = 16_384
#: Blocks at most, should paths of one hash be all there is.
MOST = 1 << 16


def place(df: DataFrame) -> tuple[Column, Column]:
    """The file of a row and its number there."""
    of = df.metadataColumn("_metadata")
    return of["file_path"], of["row_index"]


def placed(df: DataFrame, label: str = "placed") -> DataFrame:
    """``df``, if its rows come one by one from rows of Parquet files; else a written copy of it."""
    try:
        assert df.select(*place(df)).schema
    except AnalysisException:
        return cut(df, label)
    return df


def marks(rows: DataFrame) -> DataFrame:
    """(file, row) of some rows -> a written table (file, stretch, words): the words of a stretch that have bits."""
    bit = F.expr("shiftleft(1L, cast(row & 63 as int))")
    words = rows.groupBy("file", F.shiftright("row", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    entry = F.struct((F.col("word") % 64).cast("int").alias("word"), "bits")
    return cut(words.groupBy("file", F.shiftright("word", 6).alias("stretch")).agg(F.map_from_entries(F.collect_list(entry)).alias("words")), "marks")


def blocks_of(marked: DataFrame, limit: int | None = None) -> int:
    """Into how many blocks files are dealt, so that none has more than ``limit`` stretches, or than the file with the most."""
    fullest = lambda by: marked.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    n, limit = 1, max(STRETCHES if limit is None else limit, fullest(F.col("file")))
    while n < MOST and fullest(_block(F.col("file"), n)) > limit:
        n *= 2
    return n


def _block(file: Column, n: int) -> Column:
    return F.pmod(F.hash(file), F.lit(n))


def in_place(df: DataFrame, marked: DataFrame, keep: bool) -> list[DataFrame]:
    """The rows of ``df`` (:func:`placed`) whose places are marked, or those whose aren't: a frame for each block of files."""
    file, stretch, words, row = (fresh(df.columns, n) for n in ("at_file", "at_stretch", "at_words", "at_row"))
    path, number = place(df)
    n = blocks_of(marked)
    out = []
    for k in range(n):
        mine, theirs = df, marked
        if n > 1:  # a filter by path leaves out the other blocks' files before the scan
            mine, theirs = df.where(_block(path, n) == k), marked.where(_block(F.col("file"), n) == k)
        here = mine.select("*", path.alias(file), number.alias(row), F.shiftright(number, 12).alias(stretch))
        there = theirs.select(F.col("file").alias(file), F.col("stretch").alias(stretch), F.col("words").alias(words))
        word = F.coalesce(F.element_at(F.col(words), (F.shiftright(row, 6) % 64).cast("int")), F.lit(0).cast("long"))
        hit = F.getbit(word, (F.col(row) % 64).cast("int")) == 1
        met = here.join(F.broadcast(there), [file, stretch], "inner" if keep else "left").where(hit if keep else ~hit)
        out.append(met.select(*[F.col(f"`{c}`") for c in df.columns]))
    return out


def as_one(frames: list[DataFrame], label: str) -> DataFrame:
    """The frames' rows: of several, written one after the other, so that one block's marks are held at a time."""
    if len(frames) == 1:
        return frames[0]
    path = scratch(frames[0].sparkSession, label)
    for frame in frames:
        frame.write.mode("append").parquet(path)
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(path)
