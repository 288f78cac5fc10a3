"""Exact duplicates by Patricia tries over partitions of length and content hash."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.storage import whole_text

#: Bytes of text a trie may hold before its largest subtree is spilled.
TRIE_BYTES = 64 * 1024 * 1024
_EMIT_BYTES = 8 * 1024 * 1024


class Node:
    """An edge label, the children by their first byte, and the entry of the string that ends here."""

    __slots__ = ("children", "entry", "label", "spill")

    def __init__(self, label: bytes):
        self.label, self.children, self.entry, self.spill = label, {}, None, None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A compressed radix trie of byte strings; terminal entries are merged, subtrees spill to files of the task."""

    def __init__(self, merge, limit: int = TRIE_BYTES):
        self.root, self.merge, self.limit, self.held = Node(b""), merge, limit, 0

    def insert(self, text: bytes, entry) -> None:
        node, at, end = self.root, 0, len(text)
        while True:
            if node.spill is not None:
                pickle.dump((text[at:], entry), node.spill)
                return
            if at == end:
                node.entry = entry if node.entry is None else self.merge(node.entry, entry)
                return
            child = node.children.get(text[at])
            if child is None:
                leaf = Node(text[at:])
                leaf.entry = entry
                node.children[text[at]] = leaf
                self.held += end - at + 200
                if self.held > self.limit:
                    self._spill_largest()
                return
            size = len(child.label)
            if not text.startswith(child.label, at):
                size = _shared(child.label, text, at)
                middle = Node(child.label[:size])
                node.children[text[at]] = middle
                child.label = child.label[size:]
                middle.children[child.label[0]] = child
                self.held += 200
                child = middle
            node, at = child, at + size

    @staticmethod
    def _below(top: Node) -> Iterator[tuple[bytes, Node]]:
        """Every node below ``top`` with the string from ``top`` to it."""
        rest = [(top.label, top)]
        while rest:
            prefix, node = rest.pop()
            yield prefix, node
            rest.extend((prefix + child.label, child) for child in node.children.values())

    def _bytes(self, top: Node) -> int:
        total, rest = 0, [top]
        while rest:
            node = rest.pop()
            total += len(node.label) + 200
            rest.extend(node.children.values())
        return total

    def _spill_largest(self) -> None:
        """Move the largest subtree at the first branching to a file; later strings with its prefix follow it."""
        node = self.root
        while len(node.children) == 1 and node.entry is None:
            only = next(iter(node.children.values()))
            if only.spill is not None or not only.children:
                break
            node = only
        free = [c for c in node.children.values() if c.spill is None]
        if not free:
            return
        top = max(free, key=self._bytes)
        freed, file = self._bytes(top), tempfile.TemporaryFile()
        size = len(top.label)
        for prefix, below in self._below(top):
            if below.entry is not None:
                pickle.dump((prefix[size:], below.entry), file)
            if below.spill is not None:
                below.spill.seek(0)
                for rest, entry in _records(below.spill):
                    pickle.dump((prefix[size:] + rest, entry), file)
                below.spill.close()
        top.children, top.entry, top.spill = {}, None, file
        self.held -= freed

    def entries(self) -> Iterator[tuple[bytes, object]]:
        """Each string once with its merged entry; spilled subtrees are read back one at a time."""
        spilled = []
        for prefix, node in self._below(self.root):
            if node.entry is not None:
                yield prefix, node.entry
            if node.spill is not None:
                spilled.append((prefix, node.spill))
        self.root = Node(b"")
        for prefix, file in spilled:
            part = PatriciaTrie(self.merge, self.limit)
            file.seek(0)
            for rest, entry in _records(file):
                part.insert(rest, entry)
            file.close()
            for rest, entry in part.entries():
                yield prefix + rest, entry


def _records(file) -> Iterator[tuple[bytes, object]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _better(keep: str):
    def merge(a, b):
        """Entries are (owner, rows, digest); a null owner loses to any other."""
        if a[0] is None or b[0] is None:
            owner = b[0] if a[0] is None else a[0]
        else:
            owner = max(a[0], b[0]) if keep == "largest" else min(a[0], b[0])
        return owner, a[1] + b[1], a[2]

    return merge


def _tries(keep: str, limit: int, with_text: bool):
    """A task: one trie over its rows; strings go on to the next stage only where ``with_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kind = PatriciaTrie(_better(keep), limit), None
        for batch in batches:
            kind = batch.schema.field("owner").type
            columns = (batch.column(c).to_pylist() for c in ("body", "owner", "copies", "digest"))
            for body, owner, copies, digest in zip(*columns, strict=True):
                trie.insert(body, (owner, copies, digest))
        if kind is None:
            return
        rows, held = [], 0

        def flush():
            body, owner, copies, digest = zip(*rows, strict=True)
            arrays = [pa.array(owner, kind), pa.array(copies, pa.int64()), pa.array(digest, pa.binary())]
            names = ["owner", "copies", "digest"]
            if with_text:
                arrays.append(pa.array(body, pa.binary()))
                names.append("body")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for body, (owner, copies, digest) in trie.entries():
            rows.append((body, owner, copies, digest))
            held += len(body) if with_text else 1
            if held > _EMIT_BYTES or len(rows) >= 20_000:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    return run


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise=None,
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """The class of equal texts of every row: (id, keep_id, group_size, kept, text_sha256).

    Each task first merges its own rows in a trie, so a text that a third of all rows share reaches the shuffle once
    per task. The distinct strings then meet in partitions of (length, content hash), whole strings are compared by
    the trie that they are inserted into, and its terminals give owner and size. The digest joins the owners back to
    the rows, of which only id and digest move.

    ``keep`` is "largest" or "smallest": which id of a group stays. ``normalise`` maps the text column before
    the comparison. A null text equals the empty one. A null id loses to any other; a group of null ids keeps them
    all. Rows that repeat the id of the owner are all kept and all counted. An empty table gives no rows. Other
    columns are ignored.
    """
    text = whole_text(text_col)
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("owner"), text.alias("text")).select(
        "owner", F.col("text").cast("binary").alias("body"), F.sha2("text", 256).alias("sha")
    )
    kind = rows.schema["owner"].dataType.simpleString()
    single = rows.select("owner", "body", F.lit(1).cast("long").alias("copies"), F.unhex("sha").alias("digest"))
    local = single.mapInArrow(_tries(keep, trie_bytes, True), f"owner {kind}, copies bigint, digest binary, body binary")
    dealt = local.repartition(F.length("body"), F.xxhash64("body"))
    classes = dealt.mapInArrow(_tries(keep, trie_bytes, False), f"owner {kind}, copies bigint, digest binary")
    named = classes.select(
        F.col("digest"), F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"),
    )
    members = rows.select(F.col("owner"), F.unhex("sha").alias("digest"))
    return members.join(named, "digest").select(
        F.col("owner").alias(id_col), "keep_id", "group_size", F.col("owner").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
