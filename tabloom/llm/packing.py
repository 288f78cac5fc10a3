"""Packing of documents into token sequences whose windows keep the mixture of the sources."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.llm.storage import stored, whole_text

SEQUENCE = 2_048
END_ID = 1
#: Sequences in a window; a window holds every source in its target share.
WINDOW = 512
#: Bits of the hash by which the queue of a source is sliced.
SLICE_BITS = 12
#: Windows in a block are two to this power.
BLOCK_BITS = 12
# Fixed value: the pattern by which byte-level BPE files of this kind cut a text into words.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORKER: dict = {}


def _byte_signs() -> dict[str, int]:
    """The sign that byte-level BPE writes for each byte: visible Latin-1 signs as they are, others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a file of ``tokenizers``, as little-endian numbers of 16 or 32 bits.

    A plain byte-level BPE whose ids follow the order of its merges has the same ids in ``tiktoken``, which is several
    times faster; its ranks are read from the same file. Any other file is used through ``tokenizers`` itself.

    With ``added`` a text gets the ids that ``tokenizers`` gives by default with ``add_special_tokens=False``, where an added
    token such as <|endoftext|> that stands in the text is one id; texts that hold one go through ``tokenizers``.
    Without it they are cut like any other characters.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 65_536 else np.uint32
        file = json.loads(self.tokenizer.to_str())
        self.fast = self._fast(file)
        self.added = [t["content"] for t in file["added_tokens"] if t["content"]] if added else []

    @staticmethod
    def _fast(file: dict):
        model, cut, signs = file["model"], file["pre_tokenizer"] or {}, _byte_signs()
        special = {t["content"] for t in file["added_tokens"]}
        vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in special} if model["type"] == "BPE" else {}
        plain = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not file["normalizer"]
            and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix")
        )
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        if not plain or not vocab or [vocab.get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("from file", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast and not self.added:
            return [self._quick(t) for t in texts]
        slow = [i for i, t in enumerate(texts) if not self.fast or any(a in t for a in self.added)]
        found = self.tokenizer.encode_batch([texts[i] for i in slow], add_special_tokens=False) if slow else []
        done = {i: np.array(x.ids, self.kind).tobytes() for i, x in zip(slow, found, strict=True)}
        return [done[i] if i in done else self._quick(t) for i, t in enumerate(texts)]

    def _quick(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind).tobytes()


def _encoder(path: str) -> Encoder:
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER[path] = Encoder(path, added=True)
    return _WORKER[path]


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, source_col: str, end_id: int = END_ID) -> DataFrame:
    """(row, doc_id, source, tie, n_tokens, ids) of every row.

    ``ids`` are little-endian numbers of 16 bits, or of 32 for tokenizers of more than 65,536 ids, with ``end_id`` at
    the end; ``row`` is unique.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, row = _encoder(tokenizer), TaskContext.get().partitionId() << 33
        tail = np.array([end_id], encoder.kind).tobytes()
        size = len(tail)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [x + tail for x in encoder.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + len(ids)), pa.int64()), part.column("doc_id"), part.column("source"),
                    part.column("tie"), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                ], names=["row", "doc_id", "source", "tie", "n_tokens", "ids"])
                row += len(ids)

    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.xxhash64(text).alias("tie"), text.alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row bigint, doc_id {kind}, source string, tie bigint, n_tokens bigint, ids binary")


def windows_of(counts: DataFrame, shares: dict[str, float] | None, seed: int, window_tokens: int) -> DataFrame:
    """(row, n_tokens, window, turn, h): the window each document goes to and its turn there.

    Deficit round-robin in closed form: by the end of window ``w`` a source may have sent ``(w + 1) * quantum`` tokens,
    and sends whole documents while it is below. What it sent too much or too little is the deficit that the
    following windows inherit. So a document belongs to the window in which its queue reaches it, and takes its turn by
    how much of the quantum was sent before.
    """
    hashed = counts.withColumn("h", F.xxhash64("doc_id", "tie", F.lit(seed))).withColumn(
        "slice", F.shiftrightunsigned("h", 64 - SLICE_BITS).cast("int")
    )
    per_source = Window.partitionBy("source")
    slices = hashed.groupBy("source", "slice").agg(F.sum("n_tokens").alias("own")).select(
        "source", "slice",
        F.coalesce(F.sum("own").over(per_source.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("own").over(per_source).alias("total"),
    )
    if shares is None:
        total = counts.agg(F.sum("n_tokens")).first()[0] or 1
        quantum = F.col("total") / F.lit(float(total)) * window_tokens
    else:
        share = F.lit(0.0)
        for source, value in shares.items():
            share = F.when(F.col("source") == source, float(value)).otherwise(share)
        # a source without a share sends its documents one in a window
        quantum = share / float(sum(shares.values())) * window_tokens
    sliced = slices.withColumn("quantum", F.greatest(quantum, F.lit(1.0))).drop("total")
    queue = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    sent = hashed.withColumn("sent", F.coalesce(F.sum("n_tokens").over(queue), F.lit(0))).join(
        sliced, ["source", "slice"]
    ).withColumn("turns", (F.col("sent") + F.col("start")) / F.col("quantum"))
    return sent.select(
        "row", "n_tokens", F.floor("turns").cast("long").alias("window"), (F.col("turns") - F.floor("turns")).alias("turn"), "h",
    )


def _bases(windows: DataFrame, sequence: int) -> DataFrame:
    """(window, base): the number of sequences before each window; one sum per block of windows reaches the driver."""
    sized = windows.groupBy("window").agg(F.ceil(F.sum("n_tokens") / sequence).cast("long").alias("own")).withColumn(
        "block", F.shiftright("window", BLOCK_BITS)
    )
    begin, total = [], 0
    for block, own in sorted(tuple(r) for r in sized.groupBy("block").agg(F.sum("own")).collect()):
        begin.append((block, total))
        total += own
    frame = windows.sparkSession.createDataFrame(begin, "block long, begin long")
    inside = Window.partitionBy("block").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("ahead", F.coalesce(F.sum("own").over(inside), F.lit(0))).join(
        F.broadcast(frame), "block"
    ).select("window", (F.col("begin") + F.col("ahead")).alias("base"))


def _cut(sequence: int, wide: bool):
    """Pieces of each document where its place in the window crosses the end of a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "ids", "place", "base"))
            rows = []
            for doc, ids, place, base in zip(*columns, strict=True):
                ids = memoryview(np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")).cast("B")
                n, start = len(ids) // 4, 0
                while start < n:
                    at = place + start
                    length = min(n - start, sequence - at % sequence)
                    rows.append((
                        doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, base + at // sequence,
                        at % sequence,
                    ))
                    start += length
            doc, *rest = zip(*rows, strict=True) if rows else ([], *[[]] * 6)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.schema.field("doc_id").type), *[pa.array(x, pa.int64()) for x in rest]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def packed(
    docs: DataFrame, tokenizer: str, shares: dict[str, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW,
    seed: int = 42, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    wide: bool = False,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every source is a queue in seeded order. A window of ``window`` sequences takes from each queue its target share
    of tokens (``shares``, or the sources' own sizes), document by document in turns; the documents of a window stand
    end to end and are cut where a sequence is full, so only the last sequence of a window is padded. ``offset`` is the
    token of the sequence at which a piece begins; pieces leave no gap. Where ``shares`` make a source run out before
    the others, the later windows are smaller.

    Texts are encoded once and kept as a table in the shared folder. Queues are cut into slices by hash, so a source
    with a third of all rows is many tasks; a window is a bounded number of tokens. Only one sum per 4,096 windows
    reaches the driver. ``wide`` keeps 32-bit ids, for tokenizers of more than 65,536.

    A null or empty text is the end id alone; a null source is the source "". Repeated rows are packed as often as they
    occur. An empty table gives no rows. Other columns are ignored.
    """
    ids = stored(encoded(docs, tokenizer, id_col, text_col, source_col, end_id), "packing-ids")
    windows = stored(windows_of(ids.drop("ids"), shares, seed, sequence * window), "packing-windows")
    inside = Window.partitionBy("window").orderBy("turn", "h", "row").rowsBetween(Window.unboundedPreceding, -1)
    places = windows.withColumn("place", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(
        _bases(windows, sequence), "window"
    ).select("row", "place", "base")
    joined = ids.select("row", "doc_id", "ids").join(places, "row").select("doc_id", "ids", "place", "base")
    kind = ids.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        _cut(sequence, wide),
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    ).withColumnRenamed("doc_id", id_col)
