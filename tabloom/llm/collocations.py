"""Phrase collocations by prefix-free parsing.

A text is cut where a hash of its next words hits a residue, so equal passages give equal chunks wherever they stand, and
neighbouring chunks overlap by one word less than the longest phrase. Distinct chunks with their frequencies are the
dictionary. Phrases are counted inside distinct chunks, weighted, and those in an overlap belong to the later chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.llm.storage import forget, stored, whole_text
from tabloom.llm.tokens import mixed, text_chunks

#: A chunk begins at a word with chance 1 / DIVISOR.
DIVISOR = 32
#: Bytes of chunks whose phrases are counted together inside a task.
BLOCK_BYTES = 8 << 20
#: Bits of the filter of frequent phrases: at least and at most. Above the most, it lets more through; counts stay exact.
_FILTER_BITS = (16, 26)
#: Characters that end a piece, and those that separate words.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _STOP = 0x20, ord(".")


@dataclass(frozen=True)
class PhraseSpec:
    """Phrases of 2 to ``longest`` words with at least ``least`` occurrences; the ``top`` ones of each language.

    A phrase goes if a longer one that contains it has at least ``num / den`` of its occurrences; a score is ``factor``
    times what the parts would lead to expect.
    """

    longest: int = 5
    least: int = 100
    num: int = 100
    den: int = 100
    factor: int = 1000
    top: int = 2000


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, … within each of the runs of these lengths."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return data[np.repeat(starts, lengths) + _counted(lengths)]


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(data.tobytes())).cast(pa.string())


def _keys(lang: pa.Array, phrase: pa.Array) -> pa.Array:
    """Language and phrase as one string; a phrase has no tabs, so the last tab parts them."""
    return pc.binary_join_element_wise(lang.cast(pa.string()), phrase, "\t")


def _run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty run of bytes; ``data`` holds the runs one behind the other."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    value = mixed(data.astype(np.uint64) + np.uint64(1)) * powers[_counted(lengths)]
    return mixed(np.add.reduceat(value, starts) + lengths.astype(np.uint64))


def normalised(data: np.ndarray, offsets: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, end of each token in them, first token of each row) of texts in lower case.

    A token is a word or "." for the end of a piece, and a space follows each. ``tail`` ends of pieces close each text.
    """
    inside = ~(_ENDS | _GAPS)[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    stops = np.concatenate([[0], np.cumsum(_ENDS[data])])
    broken = np.zeros(len(starts), np.int64)
    if len(starts) > 1:
        broken[1:] = (stops[starts[1:]] > stops[ends[:-1]]) & (row[1:] == row[:-1])
    before = np.cumsum(broken)
    at = np.arange(len(starts)) + before + tail * row
    breaks = np.concatenate([[0], before])[words]
    row_at = words + breaks + tail * np.arange(len(offsets))
    lengths = np.ones(int(row_at[-1]) if len(row_at) else 0, np.int64)
    lengths[at] = ends - starts
    token_ends = np.cumsum(lengths + 1)
    out = np.full(int(token_ends[-1]) if len(token_ends) else 0, _SPACE, np.uint8)
    is_stop = np.ones(len(lengths), bool)
    is_stop[at] = False
    out[token_ends[is_stop] - 2] = _STOP
    sizes = ends - starts
    out[np.repeat(token_ends[at] - 1 - sizes, sizes) + _counted(sizes)] = _LOWER[data[inside]]
    return out, token_ends, row_at


def chunk_bounds(hashes: np.ndarray, row_at: np.ndarray, overlap: int, divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, end token) of the chunks: from one trigger to the end of the next one's ``overlap`` tokens.

    A trigger is a window of ``overlap`` tokens whose hash is 0 modulo ``divisor``; the first and the closing window of
    a text are triggers as well, and a text without words has no chunk.
    """
    n = len(hashes)
    window = np.zeros(n, np.uint64)
    for k in range(overlap):
        nxt = np.zeros(n, np.uint64)
        if n > k:
            nxt[: n - k] = hashes[k:]
        window = mixed(window * _STEP + nxt)
    trigger = window % np.uint64(divisor) == 0
    closing = row_at[1:] - overlap
    rows = np.repeat(np.arange(len(row_at) - 1), np.diff(row_at))
    trigger &= np.arange(n) < closing[rows] if n else trigger
    some = closing > row_at[:-1]
    trigger[row_at[:-1][some]] = True
    trigger[closing[some]] = True
    at = np.flatnonzero(trigger)
    same = rows[at[:-1]] == rows[at[1:]]
    return at[:-1][same], at[1:][same] + overlap


def _parsed(overlap: int, divisor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            for low, high, data, offsets in text_chunks(batch.column("body")):
                text, ends, row_at = normalised(data, offsets, overlap)
                starts = np.concatenate([[0], ends])[:-1]
                hashes = _run_hashes(text, starts, ends - starts)
                first, end = chunk_bounds(hashes, row_at, overlap, divisor)
                if not len(first):
                    continue
                row = np.searchsorted(row_at, first, "right") - 1
                lengths = ends[end - 1] - starts[first]
                yield pa.RecordBatch.from_arrays([
                    lang.slice(low, high - low).take(pa.array(row)), _strings(_gathered(text, starts[first], lengths), lengths),
                ], names=["lang", "chunk"])

    return run


def dictionary(docs: DataFrame, overlap: int, divisor: int = DIVISOR, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, f): the distinct chunks of all texts and how often each occurs; their last ``overlap`` tokens are the
    beginning of another chunk or of the closing ends."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).cast("binary").alias("body")
    )
    chunks = rows.mapInArrow(_parsed(overlap, divisor), "lang string, chunk string")
    return chunks.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("f"))


class Filter:
    """A Bloom filter of 64-bit hashes: what it lacks was never put in."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [(hashes + np.uint64(k) * step) & mask for k in range(4)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self.places(hashes, self.mask):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


class _Block:
    """Rows of space-closed tokens of several languages: word numbers, hashes, and which tokens are words."""

    def __init__(self, lang: pa.Array, column: pa.Array):
        chunks = list(text_chunks(column, limit=1 << 62))
        _, _, self.data, offsets = chunks[0]
        self.ends = np.flatnonzero(self.data == _SPACE) + 1
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.row_at = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.row_at))
        sizes = self.ends - self.starts - 1
        words = _strings(self.data[self.data != _SPACE], sizes).dictionary_encode()
        self.word = words.indices.to_numpy().astype(np.int64)
        self.is_word = ~((sizes == 1) & (self.data[self.starts] == _STOP))
        coded = lang.dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy().astype(np.int64)[self.rows]
        known = words.dictionary.cast(pa.large_binary())
        offs = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
        bytes_ = np.frombuffer(known.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        vocabulary = _run_hashes(bytes_, offs[:-1] - offs[0], np.diff(offs))
        names = np.array([int.from_bytes(x.encode()[:7], "big") * 131 + len(x) for x in self.langs.to_pylist()], np.uint64)
        self.one = mixed(vocabulary[self.word] ^ mixed(names)[self.lang])

    def hashes(self, m: int) -> np.ndarray:
        """A hash of the ``m`` words from each token on, and of their language."""
        n, out = len(self.one), self.one
        for k in range(1, m):
            nxt = np.zeros(n, np.uint64)
            if n > k:
                nxt[: n - k] = self.one[k:]
            out = mixed(out * _STEP + nxt)
        return out

    def wordy(self, m: int) -> np.ndarray:
        """Whether ``m`` words in a row begin at each token."""
        out = self.is_word.copy()
        for k in range(1, m):
            out[: len(out) - k] &= self.is_word[k:]
            out[len(out) - k :] = False
        return out


def _grams(m: int, overlap: int, frequent):
    """Counts the phrases of ``m`` words that begin in a chunk before its overlap and whose parts are frequent."""

    def counted(block: _Block, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.arange(len(block.rows)) < (block.row_at[1:] - overlap)[block.rows]
        own &= block.wordy(m)
        if m == 1:
            weights = f[block.rows[own]]
            totals = np.zeros(len(block.langs), np.int64)
            np.add.at(totals, block.lang[own], weights)
            yield pa.RecordBatch.from_arrays([_keys(block.langs, pa.array([""] * len(totals))), pa.array(totals)], names=["key", "a"])
        if frequent is not None:
            held = frequent.value.holds(block.hashes(m - 1))
            own[:-1] &= held[:-1] & held[1:]
        at = np.flatnonzero(own)
        if not len(at):
            return
        size = int(block.word.max()) + 1
        code = block.lang[at]
        for k in range(m):
            code = pd.factorize(code * size + block.word[at + k])[0]
        first = np.full(int(code.max()) + 1, len(at), np.int64)
        np.minimum.at(first, code, np.arange(len(at)))
        counts = np.zeros(len(first), np.int64)
        np.add.at(counts, code, f[block.rows[at]])
        begin = at[first]
        # phrases of one first word side by side: they are packed better when shuffled
        order = np.lexsort([block.word[begin + k] for k in range(m - 1, -1, -1)] + [block.lang[begin]])
        begin, counts = begin[order], counts[order]
        low, lengths = block.starts[begin], block.ends[begin + m - 1] - 1 - block.starts[begin]
        phrases = _strings(_gathered(block.data, low, lengths), lengths)
        yield pa.RecordBatch.from_arrays(
            [_keys(block.langs.take(pa.array(block.lang[begin])), phrases), pa.array(counts)], names=["key", "a"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from _of(held)
                held, size = [], 0
        if held:
            yield from _of(held)

    def _of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lang, chunk, f = (table.column(c).chunk(0) for c in ("lang", "chunk", "f"))
        yield from counted(_Block(lang, chunk), f.to_numpy())

    return run


def _filter_of(frequent: DataFrame, m: int) -> Filter:
    """The filter of the phrases of ``m`` words in ``frequent``; its words, bounded in number, reach the driver."""
    n = frequent.count()
    bits = min(max((16 * n).bit_length(), _FILTER_BITS[0]), _FILTER_BITS[1])
    mask = np.uint64((1 << bits) - 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = _Block(batch.column("lang"), batch.column("phrase"))
            at = np.unique(np.concatenate(Filter.places(block.hashes(m)[block.row_at[:-1]], mask)))
            yield pa.RecordBatch.from_arrays([
                pa.array((at >> np.uint64(6)).astype(np.int64)),
                pa.array(np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)),
            ], names=["word", "bits"])

    rows = frequent.select("lang", F.concat("phrase", F.lit(" ")).alias("phrase"))
    got = rows.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filter(words)


def phrase_counts(chunks: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, a) of all phrases of 1 to ``longest`` words with ``a >= least``, (lang, n) of all words).

    A phrase is frequent only if both phrases of one word less in it are, so each length is counted among what a filter
    of the shorter ones lets through; the filter may let more through but never less. Counts combine within a block, a
    task and then across tasks.
    """
    spark, levels, frequent, totals = chunks.sparkSession, [], None, None
    for m in range(1, longest + 1):
        found = chunks.mapInArrow(_grams(m, longest - 1, frequent), "key string, a long")
        phrase = F.substring_index("key", "\t", -1)
        counts = found.groupBy("key").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (phrase == ""))
        lang = F.substring(F.col("key"), F.lit(1), F.length("key") - F.length(phrase) - 1)
        level = stored(counts.select(lang.alias("lang"), phrase.alias("phrase"), "a", F.lit(m).alias("words")), "phrase-counts")
        if m == 1:
            totals = level.where("phrase = ''").select("lang", F.col("a").alias("n"))
            level = level.where("phrase <> '' and a >= " + str(least))
        levels.append(level)
        if m < longest:
            frequent = spark.sparkContext.broadcast(_filter_of(level, m))
    return reduce(DataFrame.unionByName, levels), totals


def _part(parts: str, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, start, n), " ")


def collocations(
    docs: DataFrame, spec: PhraseSpec = PhraseSpec(), text_col: str = "text", lang_col: str = "lang", divisor: int = DIVISOR,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Texts in lower case (A-Z) are cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.
    ``a`` counts the occurrences of a phrase inside pieces, overlaps included, ``n`` all words of the language. A phrase is
    cut in two where its score ``floor(factor * a * n / (l * r))`` is lowest, of equal ones at the first place; ``l`` and
    ``r`` count the two parts. Products are decimals of 38 digits.

    One shuffle makes the dictionary of chunks, smaller than the corpus by all that repeats; phrases then meet by their
    text, after counts are combined in blocks and tasks. Nothing of the corpus reaches the driver but a filter of bounded
    size and the number of frequent phrases.

    Null texts are empty and a null language is ``und``; ids play no part, so repeated rows count as often as they occur.
    Texts without words add nothing. Ties of score and count go by the bytes of the phrase. An empty table gives no
    rows. Other columns are ignored.
    """
    chunks = stored(dictionary(docs, spec.longest - 1, divisor, text_col, lang_col), "phrase-chunks")
    counts, totals = phrase_counts(chunks, spec.longest, spec.least)
    forget(chunks)
    phrases = counts.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "a", "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _part("parts", F.lit(1), F.col("k")).alias("left"),
        _part("parts", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    wide = "decimal(38,0)"
    product = F.lit(spec.factor).cast(wide) * F.col("a").cast(wide) * F.col("n").cast(wide)
    scored = cuts.join(totals, "lang").withColumn("above", product).withColumn(
        "below", F.col("l").cast(wide) * F.col("r").cast(wide)
    ).withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(parts, s, m), ' '))))"
    )
    longer = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy(
        "lang", "phrase"
    ).agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(spec.den) * F.col("longer") < F.lit(spec.num) * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.top).select(
        F.col("lang").alias(lang_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"),
    )
