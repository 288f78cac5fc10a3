"""Removal of repeated runs of lines: content-defined chunks by rolling hashes over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.storage import whole_text

#: A boundary follows a line with chance 1 / DIVISOR, so chunks have this many lines on average.
DIVISOR = 4
_PRIME = 65_521
_MISSING = -(2**62)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row.

    A column that only the body of a loop names would else be computed again for every element, once the projection that
    made it is folded into the one that uses it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _line_hash(line):
    """Seven hexadecimal digits of the MD5 of a line, as a number SQL can repeat."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """(doc_id, d1, d2, lines, first, size): where the chunks of each text begin and how many lines they have.

    The rolling hash of a line combines its own hash with that of the line before; a chunk ends where it is 0
    modulo ``divisor``. Boundaries so depend on two lines alone and reappear in any document that has them.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2"),
        F.split("text", "\n", -1).alias("lines"),
    )
    hashed = rows.withColumn("h", F.transform("lines", _line_hash))
    rolled = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.slice("h", 1, F.size("h") - 1)), "h",
        lambda before, own: (before % _PRIME * 251 + own % _PRIME) % _PRIME % divisor,
    )
    ends = _let(F.col("rolled"), lambda r: F.filter(
        F.sequence(F.lit(1), F.size(r)), lambda i: (i == F.size(r)) | (F.get(r, i - 1) == 0)
    ))
    marked = hashed.select("doc_id", "d1", "d2", "lines", rolled.alias("rolled")).select(
        "doc_id", "d1", "d2", "lines", ends.alias("ends")
    )
    return marked.select(
        "doc_id", "d1", "d2", "lines",
        F.zip_with(
            F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)), "ends",
            lambda before, end: F.struct((before + 1).alias("first"), (end - before).alias("size")),
        ).alias("chunks"),
    )


def repeated_chunks(chunks: DataFrame, min_lines: int) -> DataFrame:
    """(doc_id, d1, d2, first, size): the chunks to remove, which are all but the first place of each repeated chunk.

    Hashes are counted first; only chunks whose hash occurs again move with their text, and the owner's text is then
    compared with theirs byte by byte.
    """
    # bodies are made inside the row, so that no exploded row carries the whole text; shorter chunks are never removed
    bodies = _let(F.col("lines"), lambda lines: F.transform(
        F.filter("chunks", lambda c: c["size"] >= min_lines), lambda c: F.struct(
            c["first"].alias("first"), c["size"].alias("size"),
            F.array_join(F.slice(lines, c["first"], c["size"]), "\n").alias("body"),
        ),
    ))
    places = chunks.select("doc_id", "d1", "d2", F.explode(bodies).alias("c")).select("doc_id", "d1", "d2", "c.*").select(
        "*", F.xxhash64("body").alias("b1"), F.xxhash64(F.lit(7), "body").alias("b2")
    )
    again = places.groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b1", "b2")
    candidates = places.join(again, ["b1", "b2"], "left_semi")
    # the owner names the size too, so that both sides of the join below read the same columns of one shuffle
    sorted_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_MISSING))
    owners = candidates.groupBy("b1", "b2", "body").agg(
        F.min(F.struct(sorted_id.alias("i"), "d1", "d2", "first", "size")).alias("owner"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("b1", "b2", F.col("body").alias("owner_body"), "owner")
    found = candidates.join(owners, ["b1", "b2"]).where(F.col("body") == F.col("owner_body"))
    is_owner = F.struct(sorted_id.alias("i"), "d1", "d2", "first", "size") == F.col("owner")
    return found.where(~is_owner).select("doc_id", "d1", "d2", "first", "size")


def lines_between(lines: str, firsts, ends) -> Column:
    """The lines outside of intervals from ``firsts`` up to before ``ends``, two sorted arrays of line numbers from 1."""
    def outside(all_lines: Column) -> Column:
        begin = F.concat(F.array(F.lit(1)), ends)
        stop = F.concat(firsts, F.array(F.size(all_lines) + 1))
        return F.flatten(F.zip_with(begin, stop, lambda a, b: F.slice(all_lines, a, F.greatest(b - a, F.lit(0)))))

    return _let(F.col(lines), outside)


def without_repeated_chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, divisor: int = DIVISOR,
) -> DataFrame:
    """(id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, text) for every row.

    A chunk of at least ``min_lines`` lines that occurs in several places stays in the first of them (by id, then
    position) and is removed from the others, same document included; what is left is joined by line feeds.

    A null text is one empty line and gives the empty text. A null id comes before all others. Rows that repeat both
    id and text count as one document: they keep and lose the same chunks. An empty table gives no rows. Other columns
    are ignored.
    """
    chunks = chunked(docs, id_col, text_col, divisor)
    removed = repeated_chunks(chunks, min_lines)
    per_doc = removed.groupBy("doc_id", "d1", "d2").agg(F.collect_set(F.struct("first", "size")).alias("gone")).select(
        F.col("doc_id").alias("gone_id"), F.col("d1").alias("gone_1"), F.col("d2").alias("gone_2"), F.sort_array("gone").alias("gone")
    )
    same = (
        (F.col("d1") == F.col("gone_1")) & (F.col("d2") == F.col("gone_2"))
        & F.col("doc_id").eqNullSafe(F.col("gone_id"))
    )
    joined = chunks.join(per_doc, same, "left").withColumn(
        "gone", F.coalesce("gone", F.array().cast("array<struct<first:int,size:int>>"))
    )
    firsts, ends = F.transform("gone", lambda g: g["first"]), F.transform("gone", lambda g: g["first"] + g["size"])
    kept = F.when(F.size("gone") == 0, F.col("lines")).otherwise(lines_between("lines", firsts, ends))
    return joined.select(
        F.col("doc_id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
        F.size("chunks").cast("long").alias("n_chunks"), F.size("gone").cast("long").alias("n_removed_chunks"),
        F.aggregate("gone", F.lit(0).cast("long"), lambda n, c: n + c["size"]).alias("n_removed_lines"),
        F.array_join(kept, "\n").alias(text_col),
    )


def line_windows(docs: DataFrame, id_col: str, text_col: str, min_lines: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, d1, d2, lines) of every row, and (doc_id, d1, d2, first, b1, b2) of every ``min_lines`` lines in a row.

    ``b1`` and ``b2`` hash the lines of a window under two seeds; windows carry no text.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2"),
        F.split(text, "\n", -1).alias("lines"),
    )
    hashes = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    def all_windows(h: Column) -> Column:
        def window(i: Column) -> Column:
            parts = [F.get(h, i - 1 + k) for k in range(min_lines)]
            return F.struct(
                i.alias("first"), F.xxhash64(*[p["a"] for p in parts]).alias("b1"),
                F.xxhash64(F.lit(7), *[p["b"] for p in parts]).alias("b2"),
            )

        starts = F.when(
            F.size(h) >= min_lines, F.sequence(F.lit(1), F.size(h) - min_lines + 1)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, window)

    windows = rows.select("doc_id", "d1", "d2", F.explode(_let(hashes, all_windows)).alias("w"))
    return rows, windows.select("doc_id", "d1", "d2", "w.*")


def without_repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2,
) -> DataFrame:
    """(id, n_lines, n_removed_runs, n_removed_lines, text) for every row.

    Every run of at least ``min_lines`` lines that occurs earlier (by id, then position, same document included) is
    removed whole, wherever it begins: a run repeats exactly where each of its windows of ``min_lines`` lines does, so
    windows at every line are the seeds and those side by side grow together. A removed line always stays in an
    earlier place. What is left is joined by line feeds.

    Windows meet by two 64-bit hashes; only the text of the first place of a repeated window moves, and a window is
    removed where its lines equal those byte by byte. Null texts and ids and repeated rows are treated as by
    ``without_repeated_chunks``; different texts of one id stand in the order of their hashes.
    """
    rows, windows = line_windows(docs, id_col, text_col, min_lines)
    place = F.struct(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"),
        "d1", "d2", "first",
    )
    firsts = windows.groupBy("b1", "b2").agg(F.min(place).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    owned = firsts.groupBy("o.known", "o.i", "o.d1", "o.d2").agg(F.collect_list(F.struct("b1", "b2", "o.first")).alias("w"))
    known = rows.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"),
        "d1", "d2", "lines",
    )
    own_bodies = _let(F.col("lines"), lambda lines: F.transform("w", lambda w: F.struct(
        w["b1"].alias("b1"), w["b2"].alias("b2"), w["first"].alias("first"), F.slice(lines, w["first"], min_lines).alias("body")
    )))
    bodies = known.join(owned, ["known", "i", "d1", "d2"]).select("known", "i", "d1", "d2", F.explode(own_bodies).alias("w")).select(
        F.col("w.b1").alias("b1"), F.col("w.b2").alias("b2"), F.struct("known", "i", "d1", "d2", "w.first").alias("owner"),
        F.col("w.body").alias("body"),
    ).groupBy("b1", "b2").agg(F.first("owner").alias("owner"), F.first("body").alias("body"))
    again = windows.select("b1", "b2", place.alias("own")).join(bodies, ["b1", "b2"]).where("own <> owner")
    per_doc = again.groupBy("own.known", "own.i", "own.d1", "own.d2").agg(
        F.collect_set(F.struct("own.first", "body")).alias("again")
    )
    # the same columns as in the join above, so that one shuffle of the text serves both
    joined = known.join(per_doc, ["known", "i", "d1", "d2"], "left")
    equal = _let(F.col("lines"), lambda lines: F.filter("again", lambda a: F.slice(lines, a["first"], min_lines) == a["body"]))
    starts = F.sort_array(F.coalesce(F.transform(equal, lambda a: a["first"]), F.array().cast("array<int>")))
    marked = joined.select("known", "i", "lines", starts.alias("starts"))
    # a run begins at a window that no window before it reaches, and ends behind one that reaches no later one
    firsts = _let(F.col("starts"), lambda all_: F.filter(all_, lambda s, at: (at == 0) | (s > F.get(all_, at - 1) + min_lines)))
    ends = _let(F.col("starts"), lambda all_: F.transform(
        F.filter(all_, lambda s, at: (at == F.size(all_) - 1) | (F.get(all_, at + 1) > s + min_lines)), lambda s: s + min_lines
    ))
    marked = marked.select("known", "i", "lines", firsts.alias("firsts"), ends.alias("ends"))
    removed = F.aggregate(
        F.zip_with("firsts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda total, n: total + n
    )
    kept = F.when(F.size("firsts") == 0, F.col("lines")).otherwise(lines_between("lines", F.col("firsts"), F.col("ends")))
    return marked.select(
        F.when(F.col("known"), F.col("i").cast(docs.schema[id_col].dataType)).alias(id_col),
        F.size("lines").cast("long").alias("n_lines"), F.size("firsts").cast("long").alias("n_removed_runs"),
        removed.alias("n_removed_lines"), F.array_join(kept, "\n").alias(text_col),
    )
