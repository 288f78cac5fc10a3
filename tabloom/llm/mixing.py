"""Mixing sources to target weights: hierarchical budgets and seeded epochs of each leaf."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.llm.storage import stored, text_key, whole_text

#: Bits of the shuffle hash that choose the slice of a leaf; one slice per leaf is ordered row by row.
SLICE_BITS = 12
_HEX = 13
#: Leaves of a tree; their sums are kept on the driver and broadcast.
MAX_LEAVES = 100_000


@dataclass
class Tree:
    """Target weights by path. A weight is relative to its siblings; a missing one is the tokens below the node."""

    levels: tuple[str, ...]
    weights: dict[tuple, float] = field(default_factory=dict)


def token_count(text: Column) -> Column:
    """Tokens of a text: its runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def _fill(amount: int, wanted: dict, room: dict) -> dict:
    """Share ``amount`` by weight among siblings; what one cannot take goes to those that still have room.

    Whole tokens: the shares are cut down and the rest goes one by one in order of the keys. Siblings without weight
    take only what the others have no room for.
    """
    amount = min(amount, sum(room.values()))
    given = dict.fromkeys(wanted, 0)
    for some in (lambda k: wanted[k] > 0, lambda k: True):
        open_ = [k for k in sorted(wanted, key=str) if some(k) and given[k] < room[k]]
        while amount > 0 and open_:
            weight = {k: wanted[k] if wanted[k] > 0 else 1.0 for k in open_}
            total, before = sum(weight.values()), amount
            full = [k for k in open_ if before * weight[k] / total >= room[k] - given[k]]
            if full:
                for k in full:
                    amount -= room[k] - given[k]
                    given[k] = room[k]
                open_ = [k for k in open_ if k not in set(full)]
                continue
            for k in open_:
                part = int(before * weight[k] / total)
                given[k] += part
                amount -= part
            for k in open_:
                if amount > 0 and given[k] < room[k]:
                    given[k] += 1
                    amount -= 1
            open_ = [k for k in open_ if given[k] < room[k]] if amount > 0 else []
    return given


def budgets(tree: Tree, supply: dict[tuple, int], budget: int, max_epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf. A node's budget is filled among its children, so a shortage moves to siblings first and
    to the siblings of an ancestor only where all of a subtree is full."""
    depth = len(tree.levels)
    below: dict[tuple, int] = {}
    for path, tokens in supply.items():
        for k in range(depth + 1):
            below[path[:k]] = below.get(path[:k], 0) + tokens
    children: dict[tuple, list[tuple]] = {}
    for path in below:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out, rest = {}, [((), min(budget, below.get((), 0) * max_epochs))]
    while rest:
        path, amount = rest.pop()
        if len(path) == depth:
            out[path] = amount
            continue
        own = children.get(path, [])
        wanted = {c: float(tree.weights.get(c, below[c])) for c in own}
        given = _fill(amount, wanted, {c: below[c] * max_epochs for c in own})
        rest.extend(given.items())
    return out


def _order(seed: int, epoch: Column, key: Column) -> Column:
    """Hexadecimal place of a row in the shuffle of an epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.substring(F.md5(text.cast("binary")), 1, _HEX)


def _matches(names: list[str], other: str = "_p") -> Column:
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & F.col(name).eqNullSafe(F.col(f"{other}{i}"))
    return same


def mixed_documents(
    docs: DataFrame, tree: Tree, budget: int | float = 1.0, max_epochs: int = 4, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", with_key: bool = False,
) -> DataFrame:
    """(id, levels, epoch, tokens, tokens_taken, leaf_budget): which documents the mixture reads, epoch by epoch.

    ``with_key`` adds two hashes of the text, ``k1`` and ``k2``, by which ``mixed_rows`` tells documents of one id apart.

    ``budget`` is a number of tokens, or as a float a multiple of the corpus. Weights flow from the root to the leaves;
    a leaf reads whole epochs as long as its budget lasts, at most ``max_epochs``, and of the last one the prefix of
    its own seeded shuffle: the document that crosses the budget is taken up to it.

    One token sum per leaf reaches the driver, at most ``MAX_LEAVES``; more raise an error, since the tree is a
    configuration. A leaf is sliced by its shuffle hash: slices before the cut are taken and those behind it left as they
    are, and only the rows of the slice that is cut are ordered, so a leaf with a third of all rows is no single task.

    A null level value is a value of its own, a null text has no tokens and is never taken. Repeated ids share their
    place in the shuffle and stand in the order of their text hashes. An empty table gives no rows. Other columns are
    ignored.
    """
    spark, levels = docs.sparkSession, list(tree.levels)
    names = [f"_l{i}" for i in range(len(levels))]
    text = whole_text(text_col)
    rows = stored(docs.select(
        F.col(id_col).alias("_id"), *[F.col(c).cast("string").alias(n) for c, n in zip(levels, names, strict=True)],
        token_count(text).alias("_tokens"), F.xxhash64(text).alias("_tie"),
        *([text_key(text)[1].alias("_tie2")] if with_key else []),
    ).where("_tokens > 0"), "mixing-tokens")
    sums = rows.groupBy(*names).agg(F.sum("_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"The tree has more than {MAX_LEAVES} leaves.")
    supply = {tuple(r)[:-1]: r["n"] for r in sums}
    amount = int(round(sum(supply.values()) * budget)) if isinstance(budget, float) else budget
    plan = [
        (*path, given, given // supply[path], given % supply[path])
        for path, given in budgets(tree, supply, amount, max_epochs).items()
    ]
    frame = spark.createDataFrame(plan, T.StructType([
        *[T.StructField(f"_p{i}", T.StringType()) for i in range(len(names))],
        T.StructField("leaf_budget", T.LongType()), T.StructField("_whole", T.LongType()), T.StructField("_part", T.LongType()),
    ]))
    hashed = rows.join(F.broadcast(frame), _matches(names)).withColumn(
        "_hash", _order(seed, F.col("_whole"), F.col("_id"))
    ).withColumn("_slice", F.shiftright(F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"), 16 - SLICE_BITS))
    line = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = hashed.where("_part > 0").groupBy(*names, "_slice").agg(F.sum("_tokens").alias("_own")).select(
        *[F.col(n).alias(f"_q{i}") for i, n in enumerate(names)], F.col("_slice").alias("_at"), "_own",
        F.coalesce(F.sum("_own").over(line), F.lit(0)).alias("_ahead"),
    )
    sliced = hashed.join(slices, _matches(names, "_q") & (F.col("_slice") == F.col("_at")), "left")
    out = [F.col("_id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, levels, strict=True)]]
    ties = [F.col("_tie").alias("k1"), F.col("_tie2").alias("k2")] if with_key else []
    order_by = ["_hash", "_id", "_tie", *(["_tie2"] if with_key else [])]
    inside = F.coalesce(F.col("_ahead") + F.col("_own") <= F.col("_part"), F.lit(False)).cast("long")
    full = sliced.withColumn("_times", F.col("_whole") + inside).where("_times > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1))
    ).select(*out, "epoch", F.col("_tokens").alias("tokens"), F.col("_tokens").alias("tokens_taken"), "leaf_budget", *ties)
    order = Window.partitionBy(*names).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    cut = sliced.where("_ahead < _part AND _ahead + _own > _part").withColumn(
        "_before", F.col("_ahead") + F.coalesce(F.sum("_tokens").over(order), F.lit(0))
    )
    last = cut.where("_before < _part").select(
        *out, F.col("_whole").alias("epoch"), F.col("_tokens").alias("tokens"),
        F.least("_tokens", F.col("_part") - F.col("_before")).alias("tokens_taken"), "leaf_budget", *ties,
    )
    return full.unionByName(last)


def mixed_rows(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chosen documents with all their columns, once per epoch; a document taken in part keeps its first tokens.

    A document is found by its id, the hashes of its text and those levels that ``docs`` has; a null id matches a null id.
    Rows equal in all of these are copies: they are numbered, and each is taken as one of the picks of an epoch.
    Picks made without ``with_key`` do not tell documents of one id apart and are refused where an id is repeated.
    """
    keyed = "k1" in chosen.columns
    given = {id_col, "epoch", "tokens", "tokens_taken", "leaf_budget", "k1", "k2"}
    levels = [c for c in chosen.columns if c not in given and c in docs.columns] if keyed else []
    hashes = [h.alias(f"_h{i}") for i, h in enumerate(text_key(whole_text(text_col)))] if keyed else []
    named = docs.select("*", F.col(id_col).alias("_own"), *hashes, *[
        F.col(c).cast("string").alias(f"_w{i}") for i, c in enumerate(levels)
    ])
    own = ["_own", *(["_h0", "_h1"] if keyed else []), *[f"_w{i}" for i in range(len(levels))]]
    picks = chosen.select(
        F.col("epoch").alias("_epoch"), F.col("tokens").alias("_n"), F.col("tokens_taken").alias("_take"),
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate([id_col, *(["k1", "k2"] if keyed else []), *levels])],
    )
    same = _matches(own)
    if not named.groupBy(*own).count().where("count > 1").isEmpty():
        if not keyed:
            raise ValueError("Ids are repeated: choose the documents with with_key=True.")
        line = Window.partitionBy(*own).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != text_col])
        named = named.withColumn("_copy", F.row_number().over(line))
        turn = Window.partitionBy("_epoch", *[f"_p{i}" for i in range(len(own))]).orderBy(F.desc("_take"))
        picks = picks.withColumn("_turn", F.row_number().over(turn))
        same = same & (F.col("_copy") == F.col("_turn"))
    short = F.array_join(F.slice(F.split(F.col(text_col), r"(?<=\S)(?=\s)"), F.lit(1), F.col("_take").cast("int")), "")
    text = F.when(F.col("_take") < F.col("_n"), short).otherwise(F.col(text_col))
    joined = named.join(picks, same)
    cut = {text_col: text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[cut[c].alias(c) if c in cut else F.col(f"`{c}`") for c in docs.columns])
