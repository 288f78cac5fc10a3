"""Document fingerprints by locally consistent parsing: deterministic coin tossing names phrases level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabloom.llm.storage import whole_text
from tabloom.llm.tokens import CHUNK_BYTES, mixed

#: Smallest phrase names of each level in a fingerprint.
SKETCH = 32
#: Bytes of an average phrase of each level: what a common phrase of it counts in a likeness.
PHRASE_BYTES = (3, 8, 25)
#: Texts of fewer phrases of the last level also show their names of the first one in the columns ``fine``.
_SHORT = 8
#: Text bytes that one range of ids, so one task, should hold.
RANGE_BYTES = 128 * 1024 * 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _toss_table(n: int) -> np.ndarray:
    """For labels below ``n``: twice the lowest bit in which a label differs from the one before, plus that bit."""
    own, before = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    differ = own ^ before
    low = np.bitwise_count((differ & -differ) - 1)
    return np.where(differ == 0, 0, 2 * low + (own >> np.minimum(low, 7) & 1)).astype(np.uint8)


_TOSS = _toss_table(128)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three rounds of coin tossing: a label below 8 per symbol, different from its neighbours', from four symbols."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = ~names[first]
    differ = names ^ before
    low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    label = (2 * low + (names >> low.astype(np.uint64) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(2):
        old = np.empty_like(label)
        old[1:] = label[:-1]
        old[first] = label[first] ^ 1
        label = _TOSS[label, old]
    return label


def next_level(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase names, their bounds per text, first symbol of each phrase).

    Runs of one symbol are joined to (symbol, length), so neighbours differ; a phrase begins at each local maximum of
    the labels. Where it begins depends on four symbols before and one behind, never on the offset in the text.
    """
    n = len(names)
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    new = np.ones(n, bool)
    new[1:] = names[1:] != names[:-1]
    new[starts] = True
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, n)).astype(np.uint64)
    names = mixed(names[at] + runs * _STEP)
    first = np.searchsorted(at, starts)
    label = _labels(names, first).astype(np.int16)
    left, right = np.empty_like(label), np.full_like(label, -1)
    left[1:] = label[:-1]
    left[first] = -1
    right[:-1] = label[1:]
    right[first[1:] - 1] = -1
    begins = (label > left) & (label >= right)
    begins[first] = True
    begin = np.flatnonzero(begins)
    place = np.arange(len(names)) - np.repeat(begin, np.diff(np.append(begin, len(names))))
    named = mixed(np.add.reduceat(mixed(names + (place.astype(np.uint64) + np.uint64(1)) * _STEP), begin))
    return named, np.searchsorted(at[begin], bounds), at[begin]


def phrase_levels(texts: list[bytes], levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(phrase names, bounds per text) of each level; symbols of level 0 are bytes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    names, out = data.astype(np.uint64), []
    for _ in range(levels):
        if len(names):
            names, bounds, _ = next_level(names, bounds)
        out.append((names, bounds))
    return out


def _smallest(names: np.ndarray) -> np.ndarray:
    return np.unique((names >> np.uint64(32)).astype(np.uint32))[:SKETCH]


#: A fingerprint: per level, the smallest distinct phrase names, cut to 32 bits, in ascending order.
Sketch = tuple[np.ndarray, ...]


def sketches(texts: list[bytes]) -> list[Sketch]:
    """For each text its fingerprint: the ``SKETCH`` smallest names of every level, the same levels for every text."""
    out, low = [], 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= CHUNK_BYTES):
            size += len(texts[high])
            high += 1
        levels = phrase_levels(texts[low:high], len(PHRASE_BYTES))
        for i in range(high - low):
            out.append(tuple(_smallest(names[bounds[i] : bounds[i + 1]]) for names, bounds in levels))
        low = high
    return out


def likeness(one: Sketch, other: Sketch) -> float:
    """Estimated share of common phrases from two fingerprints: 1 for equal, 0 for one empty.

    Each level is sampled for itself; a phrase counts by the bytes an average one of its level has, so long texts are
    mostly compared by long phrases, and short ones, which have few of those, by all levels alike.
    """
    common = total = 0
    for a, b, weight in zip(one, other, PHRASE_BYTES, strict=True):
        both = np.union1d(a, b)[:SKETCH]
        total += weight * len(both)
        common += weight * int((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).sum())
    return common / total if total else 1.0


def to_hex(sketch: Sketch) -> str:
    """The levels in hexadecimal, eight digits a name, parted by points; nothing for an empty text."""
    return ".".join(names.astype(">u4").tobytes().hex() for names in sketch) if len(sketch[0]) else ""


def from_hex(fingerprint: str) -> Sketch:
    """The fingerprint that ``to_hex`` wrote."""
    parts = fingerprint.split(".") if fingerprint else [""] * len(PHRASE_BYTES)
    return tuple(np.frombuffer(bytes.fromhex(part), ">u4").astype(np.uint32) for part in parts)


def _fine(sketch: Sketch) -> str | None:
    return sketch[0].astype(">u4").tobytes().hex() if len(sketch[-1]) < _SHORT else None


_OUT = "key bigint, is_null boolean, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, fine string, edited_fine string"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, tail, key, hash of the text): each text meets the one behind it; a tail row only ends its bucket."""
    last = None  # (bucket, key, is_null, text, sketch) still waiting for the text behind it
    for batch in batches:
        bucket, tail, key, null, text = (batch.column(c).to_pylist() for c in ("bucket", "tail", "key", "is_null", "text"))
        sketch = sketches([t.encode() for t in text])
        pairs = []
        for i in range(len(text)):
            if last is not None and last[0] == bucket[i]:
                pairs.append((last, text[i], sketch[i]))
            last = None if tail[i] else (bucket[i], key[i], null[i], text[i], sketch[i])
        if not pairs:
            continue
        edited = []
        for own, behind, _ in pairs:
            half = len(own[3]) // 2
            edited.append((own[3][: len(own[3]) - half] + behind[:half]).encode())
        edited_sketches = sketches(edited)
        yield pa.RecordBatch.from_pydict({
            "key": pa.array([p[0][1] for p in pairs], pa.int64()), "is_null": [p[0][2] for p in pairs],
            "n_chars": pa.array([len(p[0][3]) for p in pairs], pa.int64()),
            "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
            "fingerprint": [to_hex(p[0][4]) for p in pairs], "edited_fingerprint": [to_hex(s) for s in edited_sketches],
            "near_edited": [likeness(p[0][4], s) for p, s in zip(pairs, edited_sketches, strict=True)],
            "near_next": [likeness(p[0][4], p[2]) for p in pairs],
            "fine": pa.array([_fine(p[0][4]) for p in pairs], pa.string()),
            "edited_fine": pa.array([_fine(s) for s in edited_sketches], pa.string()),
        })


def fingerprinted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, which ends in the beginning of the next document.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, fine, edited_fine). A fingerprint
    holds the smallest phrase names of each level, the same levels for every text, in hexadecimal; the two likenesses
    follow from it alone. ``fine`` repeats the first level for short texts and is null for others.

    Documents are dealt once into ranges of (id, hash of the text) of about ``range_bytes``, an id that alone is more
    into several; the first text of a range also goes to the end of the range before, so a range needs no other. Only
    range bounds reach the driver, a few numbers per range. Ids are whole numbers. A null text is empty and has the empty
    fingerprint; a null id comes first. Equal ids, missing ones too, stand in the order of hashes of their texts. Only
    copies of one text under one id must share a range. A single document is its own next one; an empty table gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    smallest = -(2**63)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(smallest)).alias("key"), F.col(id_col).isNull().alias("is_null"),
        whole_text(text_col).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    weight = rows.groupBy().agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // range_bytes))
    n = 4 * parts
    cuts = rows.select(F.col("key").cast("double")).approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n))
    bounds, repeats = np.unique(np.array(cuts, float), return_counts=True)
    #: an id of several ranges' weight is a range of its own, cut by hashes; beyond 2**53 doubles do not tell ids apart
    alone = bounds[(repeats > 1) & ((np.abs(bounds) < 2.0**53) | (bounds == float(smallest)))]
    bounds = np.union1d(bounds, np.nextafter(alone, np.inf))
    splits = {int(k): int(r) for k, r in zip(np.unique(np.array(cuts, float)), repeats, strict=True) if k in set(alone.tolist())}
    hot = np.array(sorted(splits), np.int64)
    slices = np.array([splits[k] for k in hot.tolist()], np.int64)
    most = int(slices.max(initial=1)) + 1

    @pandas_udf("long")
    def bucket_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        own = key.to_numpy(np.int64)
        place = np.searchsorted(bounds, own.astype(float), "right") * most
        if len(hot):
            at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
            part = ((tie.to_numpy(np.int64) >> 32) + 2**31) * slices[at] >> 32
            place = place + np.where(hot[at] == own, part, 0)
        return pd.Series(place)

    dealt = rows.withColumn("bucket", bucket_of("key", "tie"))
    firsts = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("m")).select("bucket", "m.*").collect())
    #: the first place of a range ends the range before it, that of the first range ends the last
    ends = {(key, tie): firsts[i - 1][0] for i, (_, key, tie) in enumerate(firsts)}
    goes = pd.Series(ends, dtype="int64") if ends else None

    @pandas_udf("long")
    def tail_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        if goes is None:
            return pd.Series(np.full(len(key), -1))
        at = goes.index.get_indexer(pd.MultiIndex.from_arrays([key, tie]))
        return pd.Series(np.where(at >= 0, goes.to_numpy()[at], -1))

    tails = dealt.withColumn("goes", F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail")),
        F.struct(tail_of("key", "tie").alias("bucket"), F.lit(True).alias("tail")),
    )).select("key", "is_null", "tie", "text", F.explode(F.filter("goes", lambda g: g["bucket"] >= 0)).alias("g"))
    placed = tails.select("g.bucket", "g.tail", "key", "is_null", "tie", "text").repartition(parts, "bucket")
    out = placed.sortWithinPartitions("bucket", "tail", "key", "tie", "text").drop("tie").mapInArrow(_neighbours, _OUT)
    return out.select(
        F.when(~F.col("is_null"), F.col("key")).alias(id_col), "n_chars", "edited_sha256", "fingerprint",
        "edited_fingerprint", "near_edited", "near_next", "fine", "edited_fine",
    )
