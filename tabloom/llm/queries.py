"""The queries of this package over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    collocations, credentials, exact, lines, mixing, near, packing, parsing, pseudonyms, quality, sharding, suffixes, whitening,
)
from tabloom.llm.storage import shared_folder, ship_package


def documents(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def op1_nb_svm(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return quality.scored(docs, quality.fit_quality(docs, labels(spark, sf)))


def op2_slot_shards(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    return sharding.shard_documents(documents(spark, sf), 24, folder)


def op3_two_stage_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_trie_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf), keep="largest")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_consistent_parsing(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.fingerprinted(documents(spark, sf))


def op6_tensored_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_groups(documents(spark, sf), near.NearSpec(k=3, num=85, den=100))


#: Target mixture: weights of domains and, below each, of languages; sources share by their own sizes.
MIXTURE = mixing.Tree(("domain", "lang", "source"), {
    **{(d,): w for d, w in {"d0": 0.3, "d1": 0.3, "d2": 0.2, "d3": 0.2}.items()},
    **{(d, lang): w for d in ("d0", "d1", "d2", "d3") for lang, w in {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13}.items()},
})


def with_domain(docs: DataFrame) -> DataFrame:
    """The documents with a domain, which is a group of sources."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return docs.withColumn("domain", F.concat(F.lit("d"), F.pmod(F.crc32(number.cast("binary")), F.lit(4)).cast("string")))


def op7_budget_tree(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_documents(with_domain(documents(spark, sf)), MIXTURE, budget=1.0, max_epochs=4)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op8_deficit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(documents(spark, sf), tokenizer_path())


def op9_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return lines.without_repeated_chunks(documents(spark, sf))


OP9_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
single AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i, len(lines) AS n FROM split),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM single),
rolled AS (
  SELECT *, i = n OR (coalesce(lag(h) OVER doc, 0) % 65521 * 251 + h % 65521) % 65521 % 4 = 0 AS is_end
  FROM hashed WINDOW doc AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(CAST(is_end AS INTEGER)) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM rolled
), chunks AS (
  SELECT doc_id, chunk, min(i) AS first, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS body
  FROM numbered GROUP BY doc_id, chunk
), marked AS (
  SELECT *, size >= 2 AND row_number() OVER (PARTITION BY body ORDER BY doc_id, first) > 1 AS gone FROM chunks
)
SELECT doc_id, CAST(sum(size) AS BIGINT) AS n_lines, count(*) AS n_chunks,
  count(*) FILTER (WHERE gone) AS n_removed_chunks,
  CAST(coalesce(sum(size) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed_lines,
  coalesce(string_agg(body, chr(10) ORDER BY first) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""


def op9_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    return lines.without_repeated_runs(documents(spark, sf))


OP9_RUNS_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
single AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM split),
pairs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM single),
repeated AS (
  SELECT *, after IS NOT NULL AND row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1 AS again FROM pairs
), marked AS (
  SELECT *, again OR coalesce(lag(again) OVER doc, false) AS gone FROM repeated WINDOW doc AS (PARTITION BY doc_id ORDER BY i)
), begun AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER doc, false) AS begins FROM marked WINDOW doc AS (PARTITION BY doc_id ORDER BY i)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE begins) AS n_removed_runs,
  count(*) FILTER (WHERE gone) AS n_removed_lines,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM begun GROUP BY doc_id
"""


#: The Spark setting that holds the key of pseudonyms; where it is unset, a session draws one and keeps it there.
KEY_SETTING = "spark.tabloom.pseudonym.key"


def pseudonym_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def op10_feistel_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonyms.pseudonymised(documents(spark, sf), pseudonym_key(spark))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    rows = whitening.whitened(spark.read.parquet(f"{sf}/embeddings.parquet"), components=4, scale=256)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_prefix_free_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf), collocations.PhraseSpec(longest=5, least=100, top=2000))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM worded GROUP BY lang
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0
), grams AS (
  SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM placed
), counts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), phrases AS (
  SELECT *, string_split(phrase, ' ') AS parts FROM counts WHERE m > 1
), cuts AS (
  SELECT *, unnest(range(1, m)) AS k FROM phrases
), sided AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, (1000 * c.a * n) // (x.a * y.a) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.parts[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.parts[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), spans AS (
  SELECT lang, a, parts, m, unnest(range(2, m)) AS size FROM phrases
), inner_spans AS (
  SELECT lang, a, parts, size, unnest(range(1, m - size + 2)) AS s FROM spans
), longer AS (
  SELECT lang, array_to_string(parts[s:s + size - 1], ' ') AS phrase, max(a) AS longer FROM inner_spans GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""


def op13_linked_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = credentials.secret_spans(documents(spark, sf))
    base = F.filter("spans", lambda s: s["kind"].isin(*credentials.BASE))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(credentials.written(base), 256).alias("base_sha256"),
        credentials.written(F.col("spans")).alias("spans"), "n_linked",
    )


OP13_SQL = r"""
WITH kinds(place, kind, pattern) AS (VALUES
  (1, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (2, 'access', 'AKIA[A-Z0-9]+'), (3, 'hex', '[0-9a-f]+'),
  (4, 'ident', '([Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|([Cc][Ll][Ii][Ee][Nn][Tt]|[Kk][Ee][Yy])_?[Ii][Dd])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9._@+-]{3,}'),
  (5, 'secret', '[A-Za-z0-9+/_=-]{20,}'),
  (6, 'endpoint', '[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"''<>]+|([Hh][Oo][Ss][Tt]|[Ee][Nn][Dd][Pp][Oo][Ii][Nn][Tt]|[Ss][Ee][Rr][Vv][Ee][Rr])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9._:/-]{3,}')
), docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT row, place, kind, unnest(regexp_split_to_array(text, pattern)) AS piece, unnest(regexp_extract_all(text, pattern)) AS m,
    unnest(range(1, len(regexp_split_to_array(text, pattern)) + 1)) AS i
  FROM docs, kinds WHERE regexp_matches(text, pattern)
), placed AS (
  SELECT row, place, kind, m, sum(length(piece) + length(m)) OVER (PARTITION BY row, place ORDER BY i) AS stop FROM cut WHERE m IS NOT NULL
), parts AS (
  SELECT row, place, kind, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8
    WHEN 'access' THEN length(m) >= 16 WHEN 'hex' THEN length(m) >= 32
    WHEN 'secret' THEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') ELSE true END
), usable AS (
  SELECT * FROM parts p WHERE place <= 3 OR NOT EXISTS (
    SELECT 1 FROM parts b WHERE b.row = p.row AND b.place <= 3 AND b.start < p.stop AND p.start < b.stop)
), pairs AS (
  SELECT x.row, x.place AS id_place, x.kind AS id_kind, x.start AS id_start, x.stop AS id_stop, y.place, y.kind, y.start, y.stop
  FROM usable x JOIN usable y ON x.row = y.row AND x.kind IN ('access', 'ident') AND y.kind IN ('assign', 'hex', 'secret', 'endpoint')
    AND y.start <= x.stop + 200 AND x.start <= y.stop + 200 AND (y.start >= x.stop OR x.start >= y.stop)
), complete AS (
  SELECT * FROM pairs QUALIFY bool_or(kind <> 'endpoint') OVER (PARTITION BY row, id_place, id_start)
), linked AS (
  SELECT row, id_place AS place, id_kind AS kind, id_start AS start, id_stop AS stop FROM complete WHERE id_kind = 'ident'
  UNION SELECT row, place, kind, start, stop FROM complete WHERE kind IN ('secret', 'endpoint')
), base AS (
  SELECT row, count(*) FILTER (WHERE place = 1) AS n_assign, count(*) FILTER (WHERE place = 2) AS n_access, count(*) FILTER (WHERE place = 3) AS n_hex,
    string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) AS spans FROM parts WHERE place <= 3 GROUP BY row
), whole AS (
  SELECT row, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) AS spans, count(*) FILTER (WHERE place > 3) AS n_linked
  FROM (SELECT row, place, kind, start, stop FROM parts WHERE place <= 3 UNION ALL SELECT row, place, kind, start, stop FROM linked) GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(w.spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM docs LEFT JOIN base b USING (row) LEFT JOIN whole w USING (row)
"""


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "pipeline": (pipeline, None),
    "op1_nb_svm": (op1_nb_svm, None),
    "op2_slot_shards": (op2_slot_shards, None),
    "op3_two_stage_suffixes": (op3_two_stage_suffixes, None),
    "op4_trie_dedup": (op4_trie_dedup, OP4_SQL),
    "op5_consistent_parsing": (op5_consistent_parsing, None),
    "op6_tensored_minhash": (op6_tensored_minhash, None),
    "op7_budget_tree": (op7_budget_tree, None),
    "op8_deficit_packing": (op8_deficit_packing, None),
    "op9_line_chunks": (op9_line_chunks, OP9_SQL),
    "op9_line_runs": (op9_line_runs, OP9_RUNS_SQL),
    "op10_feistel_pii": (op10_feistel_pii, None),
    "op11_whitening": (op11_whitening, None),
    "op12_prefix_free_phrases": (op12_prefix_free_phrases, OP12_SQL),
    "op13_linked_secrets": (op13_linked_secrets, OP13_SQL),
}
