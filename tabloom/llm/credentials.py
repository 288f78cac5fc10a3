"""Scans for secrets with linking of multipart credentials.

Some parts of a credential say by themselves what they are: an assignment to a name like ``password``, an access key, a long
hexadecimal run. Others are weak: a user name, a random-looking token or an address occur in clean text as well. Weak parts
are reported only where an interval join finds the parts that complete them near by. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.storage import stored, whole_text

#: Code points between two parts of one credential at most: the scope of a part reaches that far to either side.
REACH = 200
#: Fixed patterns of the parts that are reported by themselves. A run of one class that must have a least length is
#: written with it, as its longest match is the same.
BASE = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
_ASSIGNED = 8
#: Weak parts: who logs in, what proves it, and where.
WEAK = {
    "ident": r"""([Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|([Cc][Ll][Ii][Ee][Nn][Tt]|[Kk][Ee][Yy])_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""",
    "secret": r"[A-Za-z0-9+/_=-]{20,}",
    "endpoint": r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|([Hh][Oo][Ss][Tt]|[Ee][Nn][Dd][Pp][Oo][Ii][Nn][Tt]|[Ss][Ee][Rr][Vv][Ee][Rr])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}""",
}
KINDS = (*BASE, *WEAK)
_SPAN = "array<struct<start:bigint,end:bigint>>"
#: What names a document: rows that repeat id and text count as one.
_DOC = ["known", "i", "d1", "d2"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """The sums of an array of numbers up to each place, by adding neighbours at doubling distances."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers).cast("double"))).cast("int") - 1)

    def step(sums: Column, k: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.pow(F.lit(2), k).cast("int")), sums)
        return F.slice(F.zip_with(sums, moved, lambda a, b: a + b), F.lit(1), F.size(sums))

    return F.when(F.size(numbers) < 2, numbers).otherwise(F.aggregate(rounds, numbers, step))


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of the pattern of a kind is a part of that kind."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, BASE["assign"], 2)) >= _ASSIGNED
    if kind == "secret":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def located(text: Column, kind: str) -> Column:
    """(start, end) in code points of the parts of one kind, leftmost first, without overlaps."""
    pattern = BASE.get(kind) or WEAK[kind]

    def spans(x: Column) -> Column:
        gaps = F.transform(F.slice(x["pieces"], F.lit(1), F.size(x["matches"])), lambda p: F.length(p).cast("bigint"))
        steps = F.zip_with(gaps, x["matches"], lambda gap, m: gap + F.length(m))
        ends = F.zip_with(
            running_sums(steps), x["matches"], lambda end, m: F.struct(end.alias("end"), m.alias("m"))
        )
        kept = F.filter(ends, lambda e: _holds(kind, e["m"]))
        return F.transform(kept, lambda e: F.struct((e["end"] - F.length(e["m"])).alias("start"), e["end"].alias("end")))

    found = _let(
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces")), spans
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _named(kind: str) -> Column:
    """The spans of a kind with its name."""
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _exploded(parts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row (key, start, end, kind) per part of the given kinds."""
    return parts.select(*_DOC, F.explode(F.concat(*[_named(k) for k in kinds])).alias("p")).select(*_DOC, "p.*")


def _binned(rows: DataFrame, reach: int, wider: int) -> DataFrame:
    """Each interval, made longer by ``wider`` on both sides, in every bin of ``reach`` code points that it touches."""
    low, high = (F.floor(F.col(c) / F.lit(reach)).cast("bigint") for c in ("_low", "_high"))
    return rows.withColumn("_low", F.col("start") - wider).withColumn("_high", F.col("end") + wider).withColumn(
        "bin", F.explode(F.sequence(low, high))
    ).drop("_low", "_high")


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(known, i, d1, d2, linked): for each document its weak parts that others complete, as (start, end, kind).

    An interval join on bins of a document: intervals of identifiers, widened by ``reach``, meet the secrets and
    endpoints they touch. Parts of a kind do not overlap and have a least length, so a bin holds a bounded number and
    the join no more rows than a multiple of the parts, however many a document has.
    """
    identifiers, secrets = ("access", "ident"), ("assign", "hex", "secret")

    def any_of(kinds: tuple[str, ...]) -> Column:
        total = F.lit(0)
        for k in kinds:
            total = total + F.size(k)
        return total > 0

    possible = parts.where(any_of(identifiers) & any_of(secrets) & any_of(tuple(WEAK))).dropDuplicates(_DOC)
    base, weak = _binned(_exploded(possible, tuple(BASE)), reach, 0), _exploded(possible, tuple(WEAK))
    inside = _binned(weak, reach, 0).join(
        base.select(*_DOC, "bin", F.col("start").alias("b_start"), F.col("end").alias("b_end")), [*_DOC, "bin"]
    ).where("b_start < end and start < b_end").select(*_DOC, "kind", "start").distinct()
    usable = stored(
        weak.join(inside, [*_DOC, "kind", "start"], "left_anti").select(*_DOC, "kind", "start", "end").unionByName(
            _exploded(possible, tuple(BASE))
        ), "secret-usable",
    )
    ids = _binned(usable.where(F.col("kind").isin(*identifiers)), reach, reach).select(
        *_DOC, "bin", F.col("kind").alias("id_kind"), F.col("start").alias("id_start"), F.col("end").alias("id_end")
    )
    others = _binned(usable.where(F.col("kind").isin(*secrets, "endpoint")), reach, 0)
    near = (F.col("start") <= F.col("id_end") + reach) & (F.col("id_start") <= F.col("end") + reach)
    # an identifier found inside a secret, or the other way round, is one part and not two
    apart = (F.col("start") >= F.col("id_end")) | (F.col("id_start") >= F.col("end"))
    pairs = ids.join(others, [*_DOC, "bin"]).where(near & apart)
    whole = pairs.groupBy(*_DOC, "id_kind", "id_start", "id_end").agg(
        F.collect_set(F.struct("start", "end", "kind")).alias("found")
    ).where(F.exists("found", lambda p: p["kind"] != "endpoint"))
    own = F.array(F.struct(F.col("id_start").alias("start"), F.col("id_end").alias("end"), F.col("id_kind").alias("kind")))
    credentials = whole.select(*_DOC, F.explode(F.concat(own, "found")).alias("p")).where(F.col("p.kind").isin(*WEAK))
    return credentials.groupBy(*_DOC).agg(F.collect_set("p").alias("linked"))


def secret_spans(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, n_assign, n_access, n_hex, n_linked) for every row; spans are (start, end, kind) by start and kind.

    Whole texts are scanned once, without a shuffle, for parts that are secrets by themselves (``assign``, ``access``,
    ``hex``) and for weak ones: ``ident`` (a user, account or key id), ``secret`` (a token of 20 or more characters with
    small and capital letters and digits) and ``endpoint`` (an address or host). A weak secret is reported if an
    identifier, weak or not, is within ``reach`` code points; a weak identifier if a secret is; an endpoint if it is
    within the scope of an identifier that also has a secret. A weak part inside a part that is already reported as
    a secret by itself is not reported again. Only positions are shuffled, never texts.

    A null text is empty and has no spans. A null id stays. Rows that repeat id and text have equal results, and rows of
    one id with different texts are told apart by hashes of the texts. An empty table gives no rows. Other columns are
    ignored.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"),
        F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2"), *[located(F.col("text"), k).alias(k) for k in KINDS],
    )

    parts = stored(rows, "secret-parts")
    joined = parts.join(linked_parts(parts, reach), _DOC, "left")
    linked = F.coalesce("linked", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"))
    order = F.array(*[F.lit(k) for k in KINDS])
    placed = F.transform(F.concat(*[_named(k) for k in BASE], linked), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")
    ))
    spans = F.transform(
        F.array_sort(placed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return joined.select(
        F.col("doc_id").alias(id_col), spans.alias("spans"), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.size(linked).cast("long").alias("n_linked"),
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
    )), ",")
