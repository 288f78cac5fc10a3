"""Removal of repeated passages by suffix arrays: two-stage sorting, induced order, adjacent common prefixes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.storage import stored, text_key, whole_text
from tabloom.llm.tokens import mixed, text_chunks

#: Bytes of a string that must not repeat.
LENGTH = 200
#: Bytes of the substrings whose smallest hash in a window decides where the window is compared.
GRAM = 32
#: Text of one suffix array.
ARRAY_BYTES = 2 << 20
#: Distinct snippets of one anchor that are sorted in one group; beyond, its windows are dealt out by their content.
HOT_SNIPPETS = 20_000


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, hash, first, last) of the runs of windows of each text that share an anchor.

    The anchor of a window is its substring of ``gram`` bytes with the smallest hash, the first of equal ones. It
    depends on the window's bytes alone, so equal windows have equal anchors wherever they stand.
    """
    empty = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if len(data) < length:
        return empty
    step, size = np.uint64(0x9E3779B97F4A7C15), 1
    power = step
    grams = data.astype(np.uint64) + np.uint64(1)
    while size < gram:
        grams = grams[:-size] * power + grams[size:]
        power = power * power
        size *= 2
    hashes = mixed(grams)
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_sliding_least(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(place))
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[row + 1]
    starts, place, row = starts[inside], place[inside], row[inside]
    if not len(starts):
        return empty
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    at = row[first]
    return at, hashes[place[first]], starts[first] - offsets[at], starts[last] - offsets[at]


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor: by the next byte that differs."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    at = np.searchsorted(differs, np.arange(n))
    small = np.ones(n, bool)
    known = at < len(differs)
    small[known] = text[differs[at[known]] + 1] > text[known]
    return small


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the ``depth`` bytes that begin there."""
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[at]
    return at[np.argsort(np.ascontiguousarray(rows).view(f"V{depth}").ravel(), kind="stable")]


def suffix_order(text: np.ndarray, active: np.ndarray, depth: int) -> np.ndarray:
    """The active suffixes in lexicographic order as far as ``depth`` bytes tell.

    First only suffixes smaller than their successors are sorted. The others are induced by scanning the buckets of
    first bytes upwards: what stands before a placed suffix and is larger than it comes next in its own bucket.
    ``active`` holds with every larger suffix its successor.
    """
    small = _types(text)
    direct = _sorted_directly(text, np.flatnonzero(active & small), depth)
    bucket = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger, out = active & ~small, []

    def induce(placed: np.ndarray, own: int) -> np.ndarray:
        """Hand the larger suffixes before ``placed`` to their buckets; those of the own bucket are returned."""
        before = placed[placed > 0] - 1
        before = before[larger[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        same = before[:0]
        for part in np.split(before, cuts) if len(before) else ():
            if text[part[0]] == own:
                same = part
            else:
                induced[text[part[0]]].append(part)
        return same

    for byte in range(256):
        now = np.concatenate(induced[byte]) if induced[byte] else direct[:0]
        while len(now):
            out.append(now)
            now = induce(now, byte)
        now = direct[bucket[byte] : bucket[byte + 1]]
        if len(now):
            out.append(now)
            induce(now, -1)
    return np.concatenate(out) if out else direct


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first in ``order`` the bytes it shares with the one before, at most ``depth``."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    shared = np.full(max(len(order) - 1, 0), depth, np.int64)
    alive = np.arange(len(shared))
    for at in range(0, depth, 8):
        differ = words[order[alive] + at] ^ words[order[alive + 1] + at]
        ended = differ != 0
        if ended.any():
            low = differ[ended]
            bits = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            shared[alive[ended]] = np.minimum(at + bits // 8, depth)
            alive = alive[~ended]
        if not len(alive):
            break
    return shared


def repeated_starts(snippets: list[bytes], length: int) -> list[np.ndarray]:
    """For each snippet, which of its windows of ``length`` bytes occur at another place of the snippets."""
    sizes = np.array([len(s) for s in snippets])
    text = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    windows = sizes - length + 1
    window_at = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    is_window = np.zeros(len(text), bool)
    is_window[window_at] = True
    # the successors that induction needs: from the last window on to the first smaller suffix
    small = np.flatnonzero(_types(text))
    stop = small[np.searchsorted(small, np.minimum(begin + windows, len(text) - 1))]
    extra = stop - (begin + windows) + 1
    more = np.repeat(begin + windows, extra) + np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
    active = is_window.copy()
    active[more] = True
    order = suffix_order(text, active, length)
    order = order[is_window[order]]
    same = common_prefixes(text, order, length) >= length
    flagged = np.zeros(len(text), bool)
    flagged[order[1:][same]] = True
    flagged[order[:-1][same]] = True
    return [flagged[b : b + w] for b, w in zip(begin.tolist(), windows.tolist(), strict=True)]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, firsts, lasts = [], [], []
            for low, high, data, offsets in text_chunks(batch.column("body")):
                row, value, first, last = anchors(data, offsets, length, gram)
                cuts = np.searchsorted(row, np.arange(1, high - low))
                hashes += np.split(value.view(np.int64), cuts)
                firsts += np.split(first.astype(np.int32), cuts)
                lasts += np.split(last.astype(np.int32), cuts)
            yield pa.RecordBatch.from_arrays([
                batch.column("k1"), batch.column("k2"), pa.array(hashes, pa.list_(pa.int64())),
                pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32())),
            ], names=["k1", "k2", "h", "first", "last"])

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they go through a shuffle: each compressed by itself, to about half of what a shuffle makes of it."""
    small = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("body")
        bodies = pa.array([small.compress(b) for b in batch.column(at).to_pylist()], pa.binary())
        yield batch.set_column(at, batch.schema.field(at), bodies)


def _snippet_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per run of windows; the text of a snippet goes with its first row of a batch only."""
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            sent, rows = set(), []
            for k1, k2, body, runs in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "body", "runs")), strict=True):
                body = large.decompress(body)
                for run in runs:
                    part = body[run["first"] : run["last"] + length]
                    name = hashlib.blake2b(part, digest_size=16).digest()
                    rows.append((run["h"], name, k1, k2, run["first"], None if name in sent else part))
                    sent.add(name)
                if len(rows) > 50_000:
                    yield _snippet_batch(rows)
                    rows = []
            if rows:
                yield _snippet_batch(rows)

    return run


def _snippet_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "s", "k1", "k2", "first", "body"]
    )


def _spread_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of the snippets of a hot anchor on its own, dealt by its content, so equal ones meet."""
        for batch in batches:
            rows = []
            for h, parts, s, copies, body in zip(*(batch.column(c).to_pylist() for c in ("h", "parts", "s", "copies", "body")), strict=True):
                for shift in range(len(body) - length + 1):
                    window = body[shift : shift + length]
                    rows.append((h, zlib.crc32(window) % parts + 1, s, shift, copies, window))
                if len(rows) > 20_000:
                    yield _window_batch(rows)
                    rows = []
            if rows:
                yield _window_batch(rows)

    return run


_WINDOW = (("h", pa.int64()), ("sub", pa.int32()), ("s", pa.binary()), ("shift", pa.int32()), ("copies", pa.int64()), ("body", pa.binary()))


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _WINDOW, strict=True)], names=[n for n, _ in _WINDOW]
    )


def _repeats(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (h, sub): whole groups are gathered to arrays of about ``ARRAY_BYTES``."""
        rows, group, held, found = [], None, 0, []

        def close():
            for (s, shift, copies, body), flags in zip(rows, repeated_starts([r[3] for r in rows], length), strict=True):
                if copies > 1:
                    flags = np.ones(len(flags), bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                for low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    found.append((s, shift + low, shift + high - 1))

        for batch in batches:
            for h, sub, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "sub", "s", "shift", "copies", "body")), strict=True):
                if group != (h, sub):
                    group = (h, sub)
                    if held > ARRAY_BYTES:
                        close()
                        rows, held = [], 0
                rows.append(row)
                held += len(row[3])
            if found:
                yield _found_batch(found)
                found.clear()
        if rows:
            close()
        if found:
            yield _found_batch(found)

    return run


def _found_batch(found: list[tuple]) -> pa.RecordBatch:
    s, low, high = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(s, pa.binary()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["s", "low", "high"]
    )


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    large = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for body, runs in zip(batch.column("body").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            body = large.decompress(body)
            parts, at, gone, n = [], 0, 0, 0
            for run in sorted((r["low"], r["high"] + length) for r in runs or ()):
                if run[0] > at or n == 0:
                    parts.append(body[at : run[0]])
                    n += 1
                    gone += run[1] - run[0]
                    at = run[1]
                elif run[1] > at:
                    gone += run[1] - at
                    at = run[1]
            parts.append(body[at:])
            sizes.append(len(body))
            removed.append(gone)
            spans.append(n)
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(sizes, pa.int64()),
            pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()),
        ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    hot_snippets: int = HOT_SNIPPETS,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row: its bytes without those in strings that occur twice.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the input, in the same text
    or another; overlapping places count, and all is judged on the input. ``kept`` is what remains, in binary.

    1. Every window of ``length`` bytes belongs to the anchor of its smallest substring hash. Windows that share an
       anchor are neighbours, so a text is a few runs of windows, and equal windows have equal anchors.
    2. Runs whose anchor occurs once in the corpus are done. The others become snippets; equal ones are counted.
    3. The distinct snippets of an anchor meet in one task, which builds a suffix array of their windows by two-stage
       sorting and flags the windows that share ``length`` bytes with a neighbour. Windows of a hot anchor are dealt out
       by content first.
    4. The flagged runs return to all texts that have the snippet, and the covered bytes go.

    Anchors only decide where strings meet; the suffix array compares bytes. A null text is empty; texts shorter than
    ``length`` stay whole. Rows of equal text count as copies whatever their ids, and repeated or null ids are kept as
    they are. An empty table gives no rows. Other columns are ignored.
    """
    if gram & (gram - 1) or gram >= length:
        raise ValueError("gram must be a power of two below length.")
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", *text_key(F.col("text")), F.col("text").cast("binary").alias("body")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    squeezed = rows.mapInArrow(_squeezed, f"doc_id {kind}, k1 bigint, k2 bigint, body binary")
    anchored = stored(
        rows.select("k1", "k2", "body").where(F.octet_length("body") >= length).mapInArrow(
            _anchor_rows(length, gram), "k1 bigint, k2 bigint, h array<bigint>, first array<int>, last array<int>"
        ), "suffix-anchors",
    )
    again = anchored.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    single = anchored.select("k1", "k2", F.explode(F.arrays_zip("h", "first", "last")).alias("run"))
    shared = single.select("k1", "k2", "run", F.col("run.h").alias("h")).join(again, "h", "left_semi")
    wanted = shared.groupBy("k1", "k2").agg(F.collect_set("run").alias("runs"))
    snippets = stored(
        squeezed.select("k1", "k2", "body").join(wanted, ["k1", "k2"]).mapInArrow(
            _snippet_rows(length), "h bigint, s binary, k1 bigint, k2 bigint, first int, body binary"
        ), "suffix-snippets",
    )
    counted = snippets.groupBy("s").agg(
        F.min("h").alias("h"), F.count(F.lit(1)).alias("copies"), F.first("body", ignorenulls=True).alias("body")
    )
    distinct = stored(counted, "suffix-distinct")
    hot = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_snippets).select(
        "h", F.ceil(F.col("c") / hot_snippets * length).cast("int").alias("parts")
    )
    usual = distinct.join(hot, "h", "left_anti").select("h", F.lit(0).alias("sub"), "s", F.lit(0).alias("shift"), "copies", "body")
    spread = distinct.join(hot, "h").select("h", "parts", "s", "copies", "body").mapInArrow(
        _spread_windows(length), "h bigint, sub int, s binary, shift int, copies bigint, body binary"
    )
    dealt = usual.union(spread).repartition("h", "sub").sortWithinPartitions("h", "sub")
    found = dealt.mapInArrow(_repeats(length), "s binary, low int, high int")
    places = snippets.select("s", "k1", "k2", "first").join(found, "s").select(
        "k1", "k2", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high")
    )
    runs = places.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    joined = squeezed.join(runs, ["k1", "k2"], "left").select("doc_id", "body", "runs")
    return joined.mapInArrow(
        lambda batches: _kept(batches, length), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    ).withColumnRenamed("doc_id", id_col)
