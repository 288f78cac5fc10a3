"""Records of delimited files whose quoted fields span lines, read block by block instead of file by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCK = ("file", "block")


def ends_inside(line: Column, sep: str, inside: bool) -> Column:
    """Is a quoted field still open at the end of a line that began outside (or ``inside``) one?

    The fields of the line are folded from left to right. A quote opens a field only as its first character; within one,
    doubled quotes are text and a single one closes it, after which the field goes on plainly up to the separator.
    """
    def closes(content: Column) -> Column:
        return F.replace(content, F.lit('""'), F.lit("")).contains('"')

    def step(open_: Column, piece: Column) -> Column:
        begun = piece.startswith('"') & ~closes(F.substring(piece, 2, 2**31 - 1))
        return F.when(open_, ~closes(piece)).otherwise(begun)

    return F.aggregate(F.split(line, "\\Q" + sep + "\\E", -1), F.lit(inside), step)


def _with_effect(lines: DataFrame, sep: str) -> DataFrame:
    """What a line does to the state "inside a quoted field": ``fixed`` sets it, ``flips`` turns it, else it stays."""
    quoted = F.col("value").contains('"')
    out = F.when(quoted, ends_inside(F.col("value"), sep, False)).otherwise(False)
    in_ = F.when(quoted, ends_inside(F.col("value"), sep, True)).otherwise(True)
    return lines.withColumns({"_out": out, "_in": in_}).select(
        *lines.columns, F.when(F.col("_out") == F.col("_in"), F.col("_out").cast("int")).alias("fixed"),
        (F.col("_out") & ~F.col("_in")).cast("int").alias("flips"),
    )


def _state(fixed: Column, flips: Column, start: Column | int) -> Column:
    """The state after steps that turned it ``flips`` times; ``fixed`` is relative to all turns, null if nothing set it."""
    return (F.coalesce(fixed, start if isinstance(start, Column) else F.lit(start)) + flips) % 2


def _running(df: DataFrame, window, fixed: str, flips: str) -> DataFrame:
    """Effects composed over a window: ``turned`` counts flips so far, ``held`` is the last set state less the turns before it."""
    turned = df.withColumn("turned", F.coalesce(F.sum(flips).over(window), F.lit(0)))
    held = F.last(F.when(F.col(fixed).isNotNull(), (F.col(fixed) + F.col("turned")) % 2), ignorenulls=True).over(window)
    return turned.withColumn("held", held)


def spanning_records(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, line, record): whole records from (file, block, line, value, bytes, size), placed where they begin.

    ``bytes`` are those of a line with its line feed, ``size`` those of the file.

    ``block`` is where the part of the file that one task read begins, ``line`` rises within it. What lines do to the
    state is composed within blocks, then blocks within a file, one row each; so a block needs nothing of the others but
    the state in which it begins. Lines are shuffled once, by block. Records of one line, nearly all, are done then; only
    lines of longer records meet again, at the block of their first line. A record is as long as its quotes make it:
    one opened and never closed takes in the rest of its file, its last line feed included, as for any reader.
    In a file whose first line ends in \\r\\n, such line ends inside fields become \\n.
    """
    in_block = Window.partitionBy(*_BLOCK).orderBy("line")
    in_file = Window.partitionBy("file").orderBy("block")
    walked = _running(_with_effect(lines, sep), in_block, "fixed", "flips")

    last = F.max_by(F.struct("held", "turned"), "line")
    sums = (F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    returns = F.min_by(F.col("value").endswith("\r"), "line").alias("returns")
    blocks = walked.groupBy(*_BLOCK).agg(last.alias("all"), returns, *sums).select(
        *_BLOCK, "bytes", "size", "returns", F.col("all.turned").alias("flips"), (F.col("all.held") + F.col("all.turned")).alias("whole"),
    ).withColumn("whole", F.col("whole") % 2)
    ended = _running(blocks, in_file, "whole", "flips").withColumn("state", _state(F.col("held"), F.col("turned"), 0))
    # lines of a file that ends in a line feed have as many bytes as the file, or three less without its byte order mark
    beyond = F.col("size") - F.sum("bytes").over(Window.partitionBy("file"))
    starts = ended.select(
        *_BLOCK, F.coalesce(F.lag("state").over(in_file), F.lit(0)).alias("start"), beyond.isin(0, 3).alias("full"),
        F.first("returns").over(in_file).alias("returns"),
    )

    known = walked.join(starts, list(_BLOCK)).withColumn("after", _state(F.col("held"), F.col("turned"), F.col("start")))
    known = known.withColumn("before", F.coalesce(F.lag("after").over(in_block), F.col("start")))
    begins = F.when(F.col("before") == 0, F.struct("block", "line"))
    known = known.withColumn("head", F.last(begins, ignorenulls=True).over(in_block))
    single = known.where((F.col("before") == 0) & (F.col("after") == 0))
    longer = known.where((F.col("before") == 1) | (F.col("after") == 1))

    heads = known.groupBy(*_BLOCK).agg(F.max("head").alias("own"))
    earlier = F.last("own", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(*_BLOCK, earlier.alias("earlier"))
    joined = (
        longer.join(heads, list(_BLOCK)).withColumn("head", F.coalesce("head", "earlier"))
        .groupBy("file", "head").agg(
            F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts"),
            (F.max_by("after", F.struct("block", "line")) == 1).alias("open"), F.bool_or("full").alias("full"),
            F.bool_or("returns").alias("returns"),
        )
    )
    text = F.array_join(F.col("parts.value"), "\n")
    ended = F.when(F.col("open") & F.col("full"), F.concat(text, F.lit("\n"))).when(F.col("open"), text).otherwise(_without_return(text))
    unified = F.when(F.col("returns"), F.replace(ended, F.lit("\r\n"), F.lit("\n"))).otherwise(ended)
    spanning = joined.select("file", "head.block", "head.line", unified.alias("record"))
    return single.select("file", "block", "line", _without_return(F.col("value")).alias("record")).unionByName(spanning)


def _without_return(text: Column) -> Column:
    return F.regexp_replace(text, "\r\\z", "")


def read_records(spark: SparkSession, files: list[str], sep: str, latin: bool) -> DataFrame:
    """(file, block, line, record) of files whose lines end in \\n or \\r\\n; ``latin`` decodes bytes as ISO-8859-1."""
    value = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if latin else F.col("value")
    lines = spark.read.text(files, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), value.alias("value"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"), F.col("_metadata.file_size").alias("size"),
    )
    return spanning_records(lines, sep).where(F.trim("record") != "")
