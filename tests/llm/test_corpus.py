"""Shards, mixture, packing and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tabloom.llm import mixing, packing, sharding
from tabloom.llm.queries import MIXTURE, tokenizer_path, with_domain

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


# --- shards --------------------------------------------------------------------------------------

def check_shards(rows, source):
    text = collections.defaultdict(list)
    for i, t in source:
        text[i].append((t or "").encode())
    assert len(rows) == len(source)
    places = collections.defaultdict(list)
    for r in rows:
        body = text[r["doc_id"]][0]
        assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body)
        assert r["law"] == "bytes" and r["grown_shard"] is None
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards(spark, odd_docs, odd_rows, no_docs, tmp_path):
    draw = np.random.default_rng(0)
    hot = "a very common text " * 20
    source = [(i, hot if i % 3 == 0 else "x" * int(draw.integers(0, 900))) for i in range(3_000)]
    docs = spark.createDataFrame(source, "doc_id long, text string").repartition(4)
    rows = sharding.shard_documents(docs, 24, str(tmp_path / "maps")).collect()
    check_shards(rows, source)
    load = collections.Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(24)) and max(load.values()) - min(load.values()) < 0.05 * min(load.values())
    shard = collections.defaultdict(set)
    for r in rows:
        if source[r["doc_id"]][1] != hot:
            shard[source[r["doc_id"]][1]].add(r["shard"])
    assert all(len(s) == 1 for s in shard.values())
    odd = sharding.shard_documents(odd_docs, 24, str(tmp_path / "odd")).collect()
    check_shards(odd, [r[:2] for r in odd_rows])
    assert sharding.shard_documents(no_docs, 24, str(tmp_path / "none")).count() == 0


def test_only_the_hot_text_of_a_slot_is_spread(spark, tmp_path):
    source = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i % 60}") for i in range(3_000)]
    docs = spark.createDataFrame(source, "doc_id long, text string").repartition(4)
    rows = sharding.shard_documents(docs, 24, str(tmp_path / "maps"), n_slots=16).collect()
    check_shards(rows, source)
    shards = collections.defaultdict(set)
    for r in rows:
        shards[source[r["doc_id"]][1]].add(r["shard"])
    assert len(shards.pop("hot text " * 20)) > 8
    assert all(len(s) == 1 for s in shards.values())


def test_map_versions_and_rebalancing(spark, tmp_path):
    source = [(i, "y" * (i % 700)) for i in range(4_000)]
    docs = spark.createDataFrame(source, "doc_id long, text string")
    folder = str(tmp_path / "maps")
    before = {r["virtual_slot"]: r["shard"] for r in sharding.shard_documents(docs, 8, folder, 1).collect()}
    rows = sharding.shard_documents(docs, 9, folder, 2, previous=1).collect()
    moved = [r for r in rows if r["shard"] != before[r["virtual_slot"]]]
    assert all(r["shard"] == 8 for r in moved) and 0.05 < len(moved) / len(rows) < 0.2
    assert {r["shard"] for r in sharding.read_map(spark, folder, 1).collect()} == set(range(8))
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.shard_documents(docs, 9, folder, 2)


# --- mixture -------------------------------------------------------------------------------------

def test_shortage_goes_to_siblings_before_ancestors():
    tree = mixing.Tree(("d", "l"), {("a",): 0.5, ("b",): 0.5, ("a", "x"): 0.5, ("a", "y"): 0.5})
    supply = {("a", "x"): 100, ("a", "y"): 1_000, ("b", "z"): 1_000}
    assert mixing.budgets(tree, supply, 1_000, 1) == {("a", "x"): 100, ("a", "y"): 400, ("b", "z"): 500}
    tight = {("a", "x"): 100, ("a", "y"): 200, ("b", "z"): 1_000}
    assert mixing.budgets(tree, tight, 1_000, 1) == {("a", "x"): 100, ("a", "y"): 200, ("b", "z"): 700}
    assert sum(mixing.budgets(tree, tight, 10**6, 2).values()) == 2_600
    assert mixing.budgets(tree, {}, 100, 1) == {}


def mixed_brute(rows, tree, multiple, max_epochs, seed=42):
    leaves = collections.defaultdict(list)
    for doc_id, text, *path in rows:
        n = len((text or "").split())
        if n:
            leaves[tuple(path)].append((doc_id, n))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
    out = collections.Counter()
    for path, given in mixing.budgets(tree, supply, round(sum(supply.values()) * multiple), max_epochs).items():
        if not path:
            continue
        whole, part = divmod(given, supply[path])
        for epoch in range(whole):
            out.update((d, *path, epoch, n, n, given) for d, n in leaves[path])
        order = sorted(leaves[path], key=lambda r: hashlib.md5(f"{seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13])
        for doc_id, n in order:
            if part <= 0:
                break
            out[doc_id, *path, whole, n, min(n, part), given] += 1
            part -= n
    return out


def test_mixture_matches_brute_force(spark, no_docs):
    draw = np.random.default_rng(1)
    rows = [
        (i, " ".join(["tok"] * int(draw.integers(0, 60))) or None, str(draw.choice(["en", "fr", None])), "hot" if i % 3 == 0 else f"s{i % 4}")
        for i in range(900)
    ]
    tree = mixing.Tree(("lang", "source"), {("en",): 0.2, ("fr",): 0.7, ("None",): 0.1, ("en", "hot"): 3.0, ("en", "s0"): 0.0})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for multiple, epochs in ((1.0, 4), (0.3, 1), (2.5, 2)):
        got = collections.Counter(tuple(r) for r in mixing.mixed_documents(docs, tree, multiple, epochs).collect())
        assert got == mixed_brute(rows, tree, multiple, epochs)
    assert mixing.mixed_documents(no_docs, tree).count() == 0


def test_mixture_of_odd_rows(odd_docs):
    chosen = mixing.mixed_documents(odd_docs, mixing.Tree(("lang", "source")), 1.0)
    taken = collections.Counter(r["doc_id"] for r in chosen.collect())
    assert taken == {1: 1, 2: 1, None: 1, 5: 1, 6: 1, 8: 2, 9: 1}
    rows = mixing.mixed_rows(odd_docs.where("doc_id <> 8"), chosen.where("doc_id <> 8"))
    assert rows.columns == odd_docs.columns and rows.count() == 5


def test_a_document_taken_in_part_keeps_its_first_tokens(spark):
    docs = spark.createDataFrame([(1, " a  b\nc d ", 10)], "doc_id long, text string, n_chars long")
    chosen = mixing.mixed_documents(docs.withColumn("x", docs["doc_id"]), mixing.Tree(("x",)), 3)
    row = mixing.mixed_rows(docs, chosen).first()
    assert (row["text"], row["n_chars"]) == (" a  b\nc", 7)


def test_mixture_of_repeated_and_null_ids(spark):
    rows = [(None, " ".join([f"n{i}"] * (i % 7 + 1)), f"s{i % 2}") for i in range(60)]
    rows += [(5, " ".join([f"five{i}"] * (i + 1)), "s0") for i in range(6)]
    rows += [(6, "a copy of a row", "s0")] * 3 + [(6, "a copy of a row", "s1")] + [(i, f"own text {i}", "s1") for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for weights, budget in (({}, 1.0), ({("s0",): 0.8, ("s1",): 0.2}, 1.6)):
        chosen = mixing.mixed_documents(docs, mixing.Tree(("source",), weights), budget, with_key=True)
        taken = chosen.collect()
        got = mixing.mixed_rows(docs, chosen).collect()
        assert len(got) == len(taken)
        left = collections.Counter((r["doc_id"], r["source"], r["tokens_taken"]) for r in taken)
        assert collections.Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in got) == left
        whole = {(i, s, t) for i, t, s in rows}
        cut = [r for r in got if (r["doc_id"], r["source"], r["text"]) not in whole]
        assert len(cut) == sum(r["tokens_taken"] < r["tokens"] for r in taken)
        assert budget != 1.0 or collections.Counter((r["doc_id"], r["text"], r["source"]) for r in got) == collections.Counter(rows)
    plain = mixing.mixed_documents(docs, mixing.Tree(("source",)))
    with pytest.raises(ValueError, match="with_key"):
        mixing.mixed_rows(docs, plain)


# --- packing -------------------------------------------------------------------------------------

def tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    own.encode_special_tokens = True
    return own


def check_packed(rows, source, sequence):
    own, pieces = tokenizer(), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc_id, texts in source.items():
        ids = np.array(own.encode(texts[0], add_special_tokens=False).ids + [1], "<u4")
        got = sorted(pieces.pop(doc_id), key=lambda r: r["start"])
        assert sum(r["length"] for r in got) == len(ids) * len(texts)
        at = 0
        for r in got:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            if len(texts) == 1:
                assert r["start"] == at
                at += r["length"]
    assert not pieces
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= sequence
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(r["length"] for r in rows), len(sequences)


def test_pieces_of_a_text_have_the_ids_of_the_whole():
    own, encoder = tokenizer(), packing.Encoder(tokenizer_path())
    texts = [
        "Plain words, it's 12 o'clock.\n\n  Two  spaces\tand tab \n", "", " ", "\n\n", " lead", "trail ", "a b 　c d", "x\x1cy z",
        "é漢字 😀😀  !!?? ...", "<|endoftext|> is text", "don't 'tis 're  's", "a\r\n b\r\r c", "\x85 \x0b\x0c z", "1 234,567.89", "word​ ​ word",
    ]
    draw = np.random.default_rng(2)
    alphabet = list("ab '\n\t.!1é漢 \r") + ["  ", "'s", " \n", " "]
    texts += ["".join(draw.choice(alphabet, draw.integers(1, 60))) for _ in range(1_500)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_an_added_token_in_a_text_has_its_own_id(spark):
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(tokenizer_path())
    texts = ["<|endoftext|>", "one<|endoftext|> two\n<|endoftext|><|endoftext|>", "no such token", "<|endoftext", ""]
    expected = [default.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(expected[0]) == 1
    found = packing.Encoder(tokenizer_path(), added=True).encode(texts)
    assert [np.frombuffer(x, np.uint16).tolist() for x in found] == expected
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.packed(docs, tokenizer_path()).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in enumerate(expected)}


def test_packing(spark, odd_docs, odd_rows, no_docs):
    draw = np.random.default_rng(3)
    source = {i: [" ".join(f"w{x}" for x in draw.integers(0, 99, draw.integers(0, 60)))] for i in range(500)}
    rows = [(i, t[0], "hot" if i % 3 == 0 else f"s{i % 5}") for i, t in source.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.packed(docs, tokenizer_path(), sequence=64, window=16).collect()
    tokens, sequences = check_packed(got, source, 64)
    assert tokens / (64 * sequences) > 0.95
    total, kind = collections.Counter(), {i: s for i, _, s in rows}
    for r in got:
        total[kind[r["doc_id"]]] += r["length"]
    # the first windows hold the sources in the proportion of the corpus
    first = collections.Counter()
    for r in got:
        if r["sequence_id"] < 48:
            first[kind[r["doc_id"]]] += r["length"]
    for source_name, n in total.items():
        assert first[source_name] / sum(first.values()) == pytest.approx(n / tokens, abs=0.06)
    odd = collections.defaultdict(list)
    for i, t, *_ in odd_rows:
        odd[i].append(t or "")
    check_packed(packing.packed(odd_docs, tokenizer_path()).collect(), odd, 2_048)
    assert packing.packed(no_docs, tokenizer_path()).count() == 0


def test_packing_to_given_shares(spark):
    rows = [(i, "tok " * 10, "a" if i % 2 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.packed(docs, tokenizer_path(), shares={"a": 0.75, "b": 0.25}, sequence=64, window=8).collect()
    check_packed(got, {i: [t] for i, t, _ in rows}, 64)
    early = collections.Counter()
    for r in got:
        if r["sequence_id"] < 24:
            early["a" if r["doc_id"] % 2 else "b"] += r["length"]
    assert early["a"] / sum(early.values()) == pytest.approx(0.75, abs=0.05)


# --- pipeline ------------------------------------------------------------------------------------

@needs_tables
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "exact_dedup":
            largest = {r["text"]: r["doc_id"] for r in sorted(before.collect())}
            assert {r["doc_id"] for r in kept[name]} == set(largest.values())
        if name == "near_dedup":
            from tests.llm.test_dedup import NearSpec, brute_components

            groups = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], NearSpec())
            assert sorted(r["doc_id"] for r in kept[name]) == sorted(i for i, (_, _, keep) in groups.items() if keep)
        if name == "mixing":
            rows = [(r["doc_id"], r["text"], r["domain"], r["lang"], r["source"]) for r in with_domain(before).collect()]
            expected = mixed_brute(rows, MIXTURE, 1.0, 4)
            counts = collections.Counter()
            for k, n in expected.items():
                counts[k[0]] += n
            assert collections.Counter(r["doc_id"] for r in kept[name]) == counts
            assert sum(len(r["text"].split()) for r in kept[name]) == sum(k[-2] * n for k, n in expected.items())
        if name == "packing":
            own = tokenizer()
            n = sum(len(own.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())
            assert sum(r["length"] for r in kept[name]) == n
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passed = {r["doc_id"] for r in kept["quality"]}
    assert sum(q == int(i in passed) for i, q in labels.items()) / len(labels) > 0.9


@needs_tables
def test_pipeline_runs_as_a_query(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_with_copies_of_rows(spark, odd_docs, tmp_path):
    docs = odd_docs.withColumn("n_chars", odd_docs["doc_id"])
    rows = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == {i: 1 for i in (2, 4, None, 5, 6, 7, 8, 9)}
