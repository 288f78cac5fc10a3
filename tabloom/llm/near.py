"""Near duplicates: MinHash with tensored banding, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.components import components
from tabloom.llm.storage import stored, text_key, whole_text
from tabloom.llm.tokens import Words, mixed, shingles, text_chunks

_SMALLEST = -(2**63)
#: Candidates of which fewer than half of the minhashes agree are not held to be similar. At a similarity of 0.85 the
#: chance of that is below 1e-7.
_LEAST_AGREEING = 0.5
#: Rows of a table key whose sketches are compared; a key with more joins all its rows to one family.
KEY_BLOCK = 4_096
#: Documents of a family whose sets are compared in one group; larger families are compared in two rounds.
FAMILY_BLOCK = 1_024
#: Names that a task joins before it sends them on.
_FOREST = 200_000


@dataclass(frozen=True)
class NearSpec:
    """``k`` words to a shingle; a link needs ``den * intersection >= num * union``.

    Two collections of ``groups`` keys, each of ``rows`` minhashes, make ``groups ** 2`` tables of ``2 * rows``
    minhashes from ``2 * groups * rows`` computed ones. A pair of similarity s is missed with a chance of about
    ``2 * (1 - s ** rows) ** groups``: 5e-6 at 0.85 with the defaults, less above.
    """

    k: int = 5
    num: int = 80
    den: int = 100
    groups: int = 10
    rows: int = 2
    seed: int = 42

    @property
    def functions(self) -> int:
        return 2 * self.groups * self.rows


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, bounds per text) of runs of texts; letters A-Z count as lower case."""
    for _, _, data, offsets in text_chunks(column):
        words = Words(data, offsets)
        yield shingles(words.hashes(lower=True), words.bounds, k)


def _digests(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit name of each set from two sums over its members; the empty set has the empty name."""
    full = np.flatnonzero(np.diff(bounds))
    out = [b""] * (len(bounds) - 1)
    if len(full):
        one = np.add.reduceat(mixed(sets), bounds[:-1][full])
        two = np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
        for i, pair in zip(full.tolist(), np.stack([one, two], 1), strict=True):
            out[i] = pair.astype(">u8").tobytes()
    return out


def _sketches(spec: NearSpec):
    random = np.random.default_rng(spec.seed)
    factors = random.integers(1, 2**63, spec.functions, dtype=np.uint64) | np.uint64(1)
    masks = random.integers(0, 2**63, spec.functions, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, minima, keys = [], [], [], []
            for sets, bounds in shingle_sets(batch.column("body"), spec.k):
                n = len(bounds) - 1
                full = np.flatnonzero(np.diff(bounds))
                least = np.zeros((n, spec.functions), np.uint64)
                if len(full):
                    starts = bounds[:-1][full]
                    for j in range(spec.functions):
                        least[full, j] = np.minimum.reduceat((sets ^ masks[j]) * factors[j], starts)
                names += _digests(sets, bounds)
                sizes += np.diff(bounds).tolist()
                minima += [row.tobytes() for row in (mixed(least) & np.uint64(0xFF)).astype(np.uint8)]
                key = np.full((n, 2 * spec.groups), 17, np.uint64)
                for r in range(spec.rows):
                    key = mixed(key * np.uint64(31) + least[:, r :: spec.rows])
                keys += (key ^ mixed(np.arange(2 * spec.groups, dtype=np.uint64))).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("k1"), batch.column("k2"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()),
                pa.array(minima, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ], names=["id", "k1", "k2", "cid", "n", "minima", "keys"])

    return run


def _full_sets(spec: NearSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, at = batch.column("cid").to_pylist(), 0
            for sets, bounds in shingle_sets(batch.column("body"), spec.k):
                names = _digests(sets, bounds)
                rows = [
                    (name, sets[bounds[i] : bounds[i + 1]].tobytes()) for i, name in enumerate(names) if name == wanted[at + i]
                ]
                at += len(names)
                if rows:
                    name, own = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(own, pa.binary())], names=["cid", "members"])

    return run


class _Groups:
    """Labels of the rows of a group; rows of one label are not compared any more."""

    def __init__(self, labels: list[bytes]):
        self.names, codes = np.unique(np.array(labels, object), return_inverse=True)
        self.label, self.edges = codes.astype(np.int64), []

    def join(self, i: int, others: np.ndarray) -> None:
        own = self.label[i]
        new = np.unique(self.label[others])
        new = new[new != own]
        if len(new):
            self.edges += [(self.names[own], self.names[x]) for x in new]
            self.label[np.isin(self.label, new)] = own

    def others(self, i: int, among: np.ndarray) -> np.ndarray:
        return among[self.label[among] != self.label[i]]

    def single(self) -> bool:
        return bool((self.label == self.label[0]).all())


class _Forest:
    """Names joined in a task: each is sent on once, beside the smallest name it is joined with."""

    def __init__(self):
        self.parent: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        top = x
        while (up := self.parent.get(top, top)) != top:
            top = up
        while x != top:
            self.parent[x], x = top, self.parent.get(x, x)
        return top

    def join(self, x: bytes, y: bytes) -> None:
        one, two = sorted((self.root(x), self.root(y)))
        self.parent.setdefault(one, one)
        self.parent[two] = one

    def links(self) -> Iterator[pa.RecordBatch]:
        rows = [(x, self.root(x)) for x in self.parent]
        rows = [r for r in rows if r[0] != r[1]]
        self.parent = {}
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["a", "b"]
            )


def _joined(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, ...], link, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key``; ``link`` gives the joined names of the rows of each key, and a forest contracts them.

    Beyond ``limit`` rows of a key all its rows are joined, block by block, so that none needs more memory.
    """
    forest, held, last = _Forest(), [], None

    def finish() -> None:
        if len(held) > 1:
            for one, two in link(held):
                forest.join(one, two)

    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(key).to_numpy()
        bounds = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        columns = [batch.column(c) for c in names]
        for low, high in zip(bounds, bounds[1:], strict=False):
            if last is None or last != at[low]:
                finish()
                held, last = [], at[low]
            elif high - low == 0:
                continue
            if high - low == 1 and high < len(at) and low > 0:
                continue  # alone between other keys
            held += zip(*(c.slice(low, high - low).to_pylist() for c in columns), strict=True)
            if limit and len(held) > limit:
                for row in held[1:]:
                    forest.join(held[0][0], row[0])
                held = held[:1]
        if len(forest.parent) > _FOREST:
            yield from forest.links()
    finish()
    yield from forest.links()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the labels of rows of a table key whose sketches agree."""

    def link(rows: list) -> list[tuple[bytes, bytes]]:
        minima = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
        groups, every = _Groups([r[0] for r in rows]), np.arange(len(rows))
        for i in range(len(rows)):
            if groups.single():
                break
            rest = groups.others(i, every)
            groups.join(i, rest[(minima[rest] == minima[i]).mean(axis=1) >= _LEAST_AGREEING])
        return groups.edges

    return _joined(batches, "t", ("label", "minima"), link, KEY_BLOCK)


def _confirmed(spec: NearSpec):
    def link(rows: list) -> list[tuple[bytes, bytes]]:
        """Labels joined by links of full sets, as many as it takes to join all that are linked."""
        rows = list({r[1]: r for r in rows}.values())  # copies of a text that several tasks sent
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in sets])
        groups, side = _Groups([r[0] for r in rows]), np.array([r[3] for r in rows])
        one, two = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        owners = np.repeat(np.arange(len(two)), sizes[two])
        values = np.concatenate([sets[j] for j in two.tolist()])
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        for i in one.tolist():
            if groups.single():
                break
            open_ = groups.label[two] != groups.label[i]
            open_ &= spec.den * np.minimum(sizes[two], sizes[i]) >= spec.num * np.maximum(sizes[two], sizes[i])
            if not open_.any():
                continue
            low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            many = high - low
            at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(owners[at], minlength=len(two))
            linked = open_ & (spec.den * common >= spec.num * (sizes[two] + sizes[i] - common))
            groups.join(i, two[linked])
        return groups.edges

    return lambda batches: _joined(batches, "g", ("label", "cid", "members", "side"), link, None)


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once, so that copies are not shuffled; what is forgotten is only sent again."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for pair in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True):
            keep.append(pair not in seen)
            seen.add(pair)
        if len(seen) > _FOREST:
            seen = set()
        yield batch.filter(pa.array(keep, pa.bool_()))


def _labelled(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``classes`` with ``label``, which is the cid itself where ``labels`` (node, label) has none."""
    named = labels.select(F.col("node").alias("cid"), F.col("label").alias("_label"))
    return classes.join(named, "cid", "left").withColumn("label", F.coalesce("_label", "cid")).drop("_label")


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` whose ``label`` is replaced by that of the label itself in ``labels`` (node, label)."""
    named = labels.select(F.col("node").alias("label"), F.col("label").alias("_label"))
    return rows.join(named, "label", "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")


def _table_key(one, two):
    return F.xxhash64(one, two).alias("t")


def _met(rows: DataFrame) -> DataFrame:
    """The links (a, b) between labels of rows (t, label, minima) that meet in a table key."""
    return rows.repartition("t").sortWithinPartitions("t").mapInArrow(_alike, "a binary, b binary")


def families(classes: DataFrame, spec: NearSpec) -> DataFrame:
    """(cid, family): classes joined with others by table keys and sketches; those that meet no other are left out.

    A table key combines one key of each collection. The tables that combine keys of the same number come first and
    join most copies; the others then only concern keys that rows of two different families still share.
    """
    diagonal = classes.select("cid", "minima", "keys", F.explode(F.sequence(F.lit(0), F.lit(spec.groups - 1))).alias("g")).select(
        F.col("cid").alias("label"), "minima", _table_key(F.get("keys", F.col("g")), F.get("keys", F.col("g") + spec.groups))
    )
    first = stored(_labelled(classes.select("cid", "keys", "minima"), components(_met(diagonal))), "near-first")
    single = first.select("cid", "label", F.posexplode("keys").alias("place", "key"))
    open_keys = single.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    ones, twos = (
        F.collect_list(F.when(condition, F.struct("place", "key")))
        for condition in (F.col("place") < spec.groups, F.col("place") >= spec.groups)
    )
    grouped = single.join(open_keys, "key", "left_semi").groupBy("cid", "label").agg(ones.alias("ones"), twos.alias("twos"))
    crossed = grouped.select("cid", "label", F.explode("ones").alias("one"), "twos").select(
        "cid", "label", "one", F.explode("twos").alias("two")
    ).where(F.col("one.place") + spec.groups != F.col("two.place"))
    tables = stored(crossed.select(_table_key(F.col("one.key"), F.col("two.key")), "cid", "label"), "near-keys")
    open_tables = tables.groupBy("t").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("t")
    more = tables.join(open_tables, "t", "left_semi").join(classes.select("cid", "minima"), "cid").select("t", "label", "minima")
    named = _relabelled(first.select("cid", "label"), components(_met(more))).withColumnRenamed("label", "family")
    several = named.groupBy("family").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return stored(named.join(several, "family"), "near-families")


def _compared(rows: DataFrame, spec: NearSpec) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_confirmed(spec), "a binary, b binary")


def _linked(grouped: DataFrame, sets: DataFrame, spec: NearSpec) -> DataFrame:
    """(node, label) of the classes in families (family, c, cid) that links of full sets (cid, members) join.

    A family within ``FAMILY_BLOCK`` is one group. A larger one is first cut into blocks, which joins most of what is
    linked. Then blocks are made of rows of one label, or of several small ones, and two blocks meet only if they
    hold different labels, so what the first round joined is not compared or sent again.
    """
    blocks = F.ceil(F.col("c") / FAMILY_BLOCK).cast("long")
    dealt = grouped.withColumn("g", F.xxhash64("family", F.pmod(F.xxhash64("cid"), blocks))).join(sets, "cid")
    round_one = components(_compared(dealt.select("g", F.col("cid").alias("label"), "cid", "members", F.lit(0).alias("side")), spec))
    large = grouped.where(F.col("c") > FAMILY_BLOCK)
    if large.isEmpty():
        return round_one
    named = stored(_labelled(large.select("family", "cid"), round_one), "near-labels")
    sizes = named.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    big = F.col("n") >= FAMILY_BLOCK
    total = sizes.groupBy("family").agg(
        F.sum(F.when(~big, F.col("n"))).alias("rest"), F.count(F.lit(1)).alias("labels")
    ).where("labels > 1").select("family", F.ceil(F.col("rest") / FAMILY_BLOCK).alias("cuts"))
    part = F.when(big, F.pmod(F.xxhash64("cid", F.lit(2)), F.ceil(F.col("n") / FAMILY_BLOCK))).otherwise(
        F.pmod(F.xxhash64("label"), F.col("cuts"))
    )
    placed = stored(
        named.join(sizes, ["family", "label"]).join(total, "family").select(
            "family", "cid", "label", F.when(big, F.col("label")).alias("own"), part.alias("part")
        ), "near-placed",
    )
    block = placed.select("family", "own", "part").distinct().withColumn("name", F.xxhash64("own", "part", F.col("own").isNull()))
    other = block.select("family", F.col("own").alias("own_2"), F.col("name").alias("name_2"))
    pairs = block.join(other, "family").where(
        (F.col("name") <= F.col("name_2")) & (F.col("own").isNull() | F.col("own_2").isNull() | (F.col("own") != F.col("own_2")))
    ).select("family", F.xxhash64("family", "name", "name_2").alias("g"), F.array_distinct(F.array("name", "name_2")).alias("names"))
    sides = stored(pairs.select("family", "g", F.posexplode("names").alias("side", "name")), "near-pairs")
    rows = placed.withColumn("name", F.xxhash64("own", "part", F.col("own").isNull())).join(sides, ["family", "name"]).join(sets, "cid")
    round_two = components(_compared(rows.select("g", "label", "cid", "members", "side"), spec))
    return _relabelled(_labelled(grouped.select("cid"), round_one), round_two).withColumnRenamed("cid", "node")


def near_groups(
    docs: DataFrame, spec: NearSpec = NearSpec(), id_col: str = "doc_id", text_col: str = "text", with_key: bool = False,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; links are confirmed on full sets.

    1. One pass over the whole texts gives the size, name and minhashes of each set. Rows of equal sets are one class.
    2. Table keys combine pairs of keys of two smaller collections; classes that share one are candidates.
    3. Candidates whose sketches agree are joined to families, which hold every pair that can be a link.
    4. Within each family the full sets are compared, and the links make the components.

    Links are contracted in every task, and what is joined is not compared or sent again: a task sends each class once,
    beside the smallest name it is joined with. In a family beyond ``FAMILY_BLOCK`` only blocks of rows that the first
    round left apart meet, so what is sent grows with the number of blocks times that of the parts left apart.

    Ids are whole numbers. Rows without words have the empty set, are linked with nothing and kept. A null text is
    empty; a null id comes before all others. Of rows of one component that share its id, as null ids may, the one with the
    smallest hash of its text is kept; rows that repeat id and text share what is decided. An empty table gives no
    rows. Other columns are ignored. With ``with_key`` the two hashes of the text, ``k1`` and ``k2``, follow.
    """
    text = whole_text(text_col)
    body = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_SMALLEST)).alias("id"), *text_key(text), text.cast("binary").alias("body")
    )
    sketches = stored(body.mapInArrow(
        _sketches(spec), "id bigint, k1 bigint, k2 bigint, cid binary, n bigint, minima binary, keys array<bigint>"
    ), "near-sketches")
    classes = stored(sketches.where("n > 0").groupBy("cid").agg(
        F.min(F.struct("id", "k1", "k2")).alias("lead"), F.first("minima").alias("minima"), F.first("keys").alias("keys")
    ), "near-classes")
    grouped = families(classes, spec)
    wanted = grouped.join(classes.select("cid", "lead"), "cid").select("cid", F.col("lead.k1").alias("k1"), F.col("lead.k2").alias("k2"))
    texts = body.select("k1", "k2", "body").mapInArrow(_first_texts, "k1 bigint, k2 bigint, body binary")
    sets = stored(
        texts.join(wanted, ["k1", "k2"]).select("cid", "body").mapInArrow(_full_sets(spec), "cid binary, members binary"), "near-sets"
    )
    final = _linked(grouped, sets, spec)
    labelled = _labelled(classes.select("cid", "lead"), final)
    leads = labelled.groupBy("label").agg(F.min("lead").alias("owner"))
    owner = labelled.join(leads, "label").select("cid", "owner")
    out = sketches.select("id", "k1", "k2", "cid", "n").join(owner, "cid", "left")
    component = F.coalesce(F.col("owner.id"), F.col("id"))
    kept = F.col("owner").isNull() | (F.struct("id", "k1", "k2") == F.col("owner"))
    return out.select(
        F.when(F.col("id") != _SMALLEST, F.col("id")).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(component != _SMALLEST, component).alias("component_id"), kept.alias("kept"), *(("k1", "k2") if with_key else ()),
    )


def near_kept(docs: DataFrame, spec: NearSpec = NearSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_groups`` keeps: one document of each component."""
    keys = near_groups(docs, spec, id_col, text_col, with_key=True).where("kept").select(
        F.col(id_col).alias("_kept_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")
    ).distinct()
    own_1, own_2 = text_key(whole_text(text_col))
    same = (F.col("_own_1") == F.col("_k1")) & (F.col("_own_2") == F.col("_k2")) & F.col(id_col).eqNullSafe(F.col("_kept_id"))
    rows = docs.withColumns({"_own_1": own_1, "_own_2": own_2})
    return rows.join(keys, same, "left_semi").select(*[f"`{c}`" for c in docs.columns])
