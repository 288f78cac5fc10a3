"""Classifier, fingerprints, line chunks and pseudonyms."""

from __future__ import annotations

import collections
import hashlib
import itertools
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import parsing, pseudonyms, quality
from tabloom.llm.lines import without_repeated_chunks, without_repeated_runs

SF = "/root/testdata/sf0.01"


# --- quality -------------------------------------------------------------------------------------

@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    rows = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert len(rows) == docs.count()
    marks = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect()]
    held = [(q, r["predicted"]) for q, r in marks if r["held_out"]]
    assert len(held) > 50 and sum(q == p for q, p in held) / len(held) > 0.95
    for doc_id, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_labels_of_held_out_rows_are_never_read(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "b@d w%rds") for i in range(200)], "doc_id long, text string")
    some = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    other = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2) for i in range(200)], "doc_id long, quality int")
    one, two = (quality.fit_quality(docs, x) for x in (some, other))
    assert np.array_equal(one.weights, two.weights) and one.shift == two.shift


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, None), (None, 1), (6, 1), (9, 0), (9, 1), (77, 1)], "doc_id long, quality int")
    model = quality.fit_quality(odd_docs, labels)
    rows = quality.scored(odd_docs, model).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(no_docs, model).count() == 0
    assert quality.accepted(odd_docs, model).columns == odd_docs.columns
    nothing = quality.fit_quality(odd_docs, labels.where("false"))
    assert all(r["score"] == pytest.approx(0.5, abs=1e-3) for r in quality.scored(odd_docs, nothing).collect())


def test_dual_coordinate_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    x, w = draw.normal(size=(60, 4)), np.array([1.0, -2.0, 0.5, 0.0])
    y = np.where(x @ w + draw.normal(scale=0.5, size=60) > 0, 1.0, -1.0)
    rows = [(np.arange(4), r) for r in x]
    weights, bias = quality.dual_coordinate_descent(rows, y, np.ones(60), 4, 2_000, 0)

    def loss(v, b):
        return v @ v / 2 + b * b / 2 + np.maximum(0, 1 - y * (x @ v + b)).sum()

    best = loss(weights, bias)
    for _ in range(300):
        assert best <= loss(weights + draw.normal(scale=0.05, size=4), bias + draw.normal(scale=0.05)) + 1e-3


# --- fingerprints --------------------------------------------------------------------------------

def test_phrases_do_not_depend_on_the_offset():
    draw = np.random.default_rng(4)
    core = bytes(draw.integers(97, 110, 4_000).astype(np.uint8))
    levels = [parsing.phrase_levels([before + core + b"zzz"], 3) for before in (b"", b"some words before it ", b"q")]
    for level in range(3):
        names = [set(x[level][0].tolist()) for x in levels]
        assert len(names[0] & names[1]) > 0.95 * len(names[0]) - 3
        assert len(names[0] & names[2]) > 0.95 * len(names[0]) - 3


def test_neighbouring_labels_differ():
    draw = np.random.default_rng(5)
    names = parsing.mixed(draw.integers(0, 2**63, 5_000).astype(np.uint64))
    labels = parsing._labels(names, np.array([0]))
    assert labels.max() < 8 and (labels[1:] != labels[:-1]).all()


def edited_brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return collections.Counter(out)


def test_fingerprints(spark, odd_docs, odd_rows, no_docs):
    draw = np.random.default_rng(6)
    rows = [(int(i), " ".join(f"w{x}" for x in draw.integers(0, 900, draw.integers(3, 200)))) for i in draw.permutation(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = parsing.fingerprinted(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == edited_brute(rows)
    assert np.mean([r["near_edited"] for r in got]) > 0.25 > 0.1 > np.mean([r["near_next"] for r in got])
    odd = parsing.fingerprinted(odd_docs).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in odd) == edited_brute([r[:2] for r in odd_rows])
    prints = collections.defaultdict(set)
    text = {r[0]: r[1] or "" for r in odd_rows}
    for r in odd:
        prints[text[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert parsing.fingerprinted(no_docs).count() == 0
    one = parsing.fingerprinted(odd_docs.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0


def test_near_copies_of_short_texts(spark):
    draw = np.random.default_rng(12)
    words = [f"{draw.choice(list('bcdfg'))}{draw.choice(list('aeiou'))}{x}" for x in range(2_000)]
    alike, across, seen = [], [], set()
    for _ in range(400):
        text = " ".join(draw.choice(words, 60))[: draw.integers(100, 300)].encode()
        pair = parsing.sketches([text, text + b" and more"])
        phrases = [len(names) for names, _ in parsing.phrase_levels([text], 3)] + [
            len(names) for names, _ in parsing.phrase_levels([text + b" and more"], 3)
        ]
        alike.append(parsing.likeness(*pair))
        assert alike[-1] == parsing.likeness(*reversed(pair))
        seen.add(phrases[2] >= 8)
        if phrases[2] < 8 <= phrases[5]:
            across.append(alike[-1])
    assert seen == {False, True} and len(across) >= 5
    assert min(across) > 0.6 and min(alike) > 0.5
    docs = [(2 * i, text) for i, text in enumerate(["short text of a few words only, here", "a longer text " + " ".join(words[:200])])]
    got = {r["doc_id"]: r for r in parsing.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0]["fine"] and got[2]["fine"] is None


def plain_levels(text, levels=3):
    """The phrase names of a text, level by level, one symbol at a time."""
    mask, step = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(x):
        return int(parsing.mixed(np.array([x & mask], np.uint64))[0])

    names, out = list(text), []
    for _ in range(levels if names else 0):
        runs = [(a, len(list(same))) for a, same in itertools.groupby(names)]
        symbols = [mix(a + n * step) for a, n in runs]
        labels = list(symbols)
        for turn in range(3):
            # the first symbol has none before it and takes one that differs
            before = [~labels[0] & mask if turn == 0 else labels[0] ^ 1, *labels[:-1]] if labels else []
            low = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(labels, before, strict=True)]
            labels = [2 * k + (a >> k & 1) for a, k in zip(labels, low, strict=True)]
        begins = [i for i, x in enumerate(labels) if i == 0 or (
            x > labels[i - 1] and (i + 1 == len(labels) or x >= labels[i + 1])
        )]
        names = [
            mix(sum(mix(symbols[j] + (j - a + 1) * step) for j in range(a, b)))
            for a, b in zip(begins, [*begins[1:], len(symbols)], strict=True)
        ]
        out.append(names)
    return out or [[]] * levels


def plain_print(text):
    return [sorted({x >> 32 for x in names})[: parsing.SKETCH] for names in plain_levels(text)]


def plain_likeness(one, other):
    common = total = 0
    for a, b, weight in zip(one, other, (3, 8, 25), strict=True):
        both = sorted({*a, *b})[: parsing.SKETCH]
        total, common = total + weight * len(both), common + weight * len({*both} & {*a} & {*b})
    return common / total if total else 1.0


def test_fingerprints_and_likeness_by_a_plain_parse(spark):
    draw = np.random.default_rng(21)
    texts = ["", "a", "aaaaaaaaaaaa", "ab" * 40, "Ünïcödé ŧext 漢字"] + [
        " ".join(f"{draw.choice(list('abcde'))}{x}" for x in draw.integers(0, 500, draw.integers(1, 120))) for _ in range(25)
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in parsing.fingerprinted(docs).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, changed, next_ = (plain_print(t.encode()) for t in (text, edited, after))
        assert got[i]["fingerprint"] == (".".join("".join(f"{x:08x}" for x in names) for names in own) if text else "")
        assert [x.tolist() for x in parsing.from_hex(got[i]["edited_fingerprint"])] == changed
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(own, changed))
        assert got[i]["near_next"] == pytest.approx(plain_likeness(own, next_))
        prints = [parsing.from_hex(got[j]["fingerprint"]) for j in (i, (i + 1) % len(texts))]
        assert got[i]["near_next"] == parsing.likeness(*prints)


def test_ids_of_a_third_of_all_rows_are_cut_into_ranges(spark):
    rows = [(None, f"no id {i} " * 5) for i in range(300)] + [(7, f"seven {i} " * 5) for i in range(300)] + [
        (i, f"own {i}") for i in range(100, 400)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = parsing.fingerprinted(docs, range_bytes=1_000)
    sizes = out.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert max(r["count"] for r in sizes) < 150
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    want = collections.Counter()
    for i, (doc_id, text) in enumerate(ordered):
        half = len(text) // 2
        edited = text[: len(text) - half] + ordered[(i + 1) % len(ordered)][1][:half]
        want[doc_id, hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in out.collect()) == want

# --- line chunks ---------------------------------------------------------------------------------

def chunks_brute(rows, divisor=4, min_lines=2):
    split, places = [], collections.defaultdict(list)
    for doc_id, text in rows:
        lines, ends, before = (text or "").split("\n"), [], 0
        for i, line in enumerate(lines):
            h = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
            if (before % 65_521 * 251 + h % 65_521) % 65_521 % divisor == 0 or i == len(lines) - 1:
                ends.append(i + 1)
            before = h
        chunks = [("\n".join(lines[a:b]), a, b - a) for a, b in zip([0, *ends], ends, strict=False)]
        split.append((doc_id, text or "", lines, chunks))
    for doc_id, text, _, chunks in split:
        for body, first, size in chunks:
            if size >= min_lines:
                places[body].append((doc_id is not None, doc_id or 0, text, first))
    out = collections.Counter()
    for doc_id, text, lines, chunks in split:
        kept = [c for c in chunks if c[2] < min_lines or min(p[:2] + p[3:] for p in places[c[0]]) == (doc_id is not None, doc_id or 0, c[1])]
        gone = len(chunks) - len(kept)
        out[doc_id, len(lines), len(chunks), gone, len(lines) - sum(c[2] for c in kept), "\n".join(c[0] for c in kept)] += 1
    return out


def test_line_chunks(spark, odd_docs, odd_rows, no_docs):
    draw = np.random.default_rng(7)
    shared = [[f"shared {j} {x}" for x in range(draw.integers(3, 15))] for j in range(6)]
    rows = []
    for i in range(60):
        lines = [f"own {i} {x}" for x in range(draw.integers(0, 8))] + shared[i % 6] + [f"end {x}" for x in draw.integers(0, 5, 3)]
        rows.append((i, "\n".join(lines)))
    got = without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    expected = chunks_brute(rows)
    assert collections.Counter(tuple(r) for r in got) == expected and sum(k[3] for k in expected) > 60
    odd = without_repeated_chunks(odd_docs).collect()
    assert collections.Counter(tuple(r) for r in odd) == chunks_brute([r[:2] for r in odd_rows])
    assert without_repeated_chunks(no_docs).count() == 0


def runs_brute(rows):
    """The lines to keep of each row: all but those in a pair of lines that occurs earlier."""
    first = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            place = (doc_id is not None, doc_id or 0, text or "", i)
            first[pair] = min(first.get(pair, place), place)
    out = collections.Counter()
    for doc_id, text in rows:
        lines, gone = (text or "").split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if first[pair] != (doc_id is not None, doc_id or 0, text or "", i):
                gone |= {i, i + 1}
        runs = sum(i - 1 not in gone for i in gone)
        out[doc_id, len(lines), runs, len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)] += 1
    return out


def test_every_repeated_run_of_lines_goes(spark, odd_docs, odd_rows, no_docs):
    draw = np.random.default_rng(11)
    shared = [[f"passage {j} {x}" for x in range(size)] for j, size in enumerate([2, 2, 2, 3, 3, 4, 5, 9] * 5)]
    rows, repeated = [], {}
    for i in range(200):
        before, after = ([f"{side} {i} {x}" for x in range(draw.integers(0, 5))] for side in ("before", "after"))
        rows.append((i, "\n".join(before + shared[i % len(shared)] + after)))
        repeated[i] = len(shared[i % len(shared)]) if i >= len(shared) else 0
    got = without_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["n_removed_lines"] for r in got} == repeated
    assert collections.Counter(tuple(r) for r in got) == runs_brute(rows)
    chunks = without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed_lines"] for r in chunks) < 0.5 * sum(repeated.values())
    dense = [(i, "\n".join(draw.choice(list("abc"), draw.integers(1, 12)))) for i in range(80)] + [(None, "a\nb\na"), (None, "a\nb\na"), (3, None)]
    got = without_repeated_runs(spark.createDataFrame(dense, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter(tuple(r) for r in got) == runs_brute(dense)
    odd = without_repeated_runs(odd_docs).collect()
    assert collections.Counter((r[0], *r[1:]) for r in odd) == runs_brute([r[:2] for r in odd_rows])
    assert without_repeated_runs(no_docs).count() == 0


# --- pseudonyms ----------------------------------------------------------------------------------

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_pseudonyms(spark):
    rows = [
        (1, "card 4111 1111 1111 1111, again 4111 1111 1111 1111; not 4111111111111112"),
        (2, "4111 1111 1111 1111 | 2001-02-28 2001-02-30 12/31/1999 31.12.1999 | 256.1.1.1 10.20.30.40"),
        (3, "mail ann.lee+7@mail.example.com or élan.12@mail.example.com, GB82 WEST 1234 5698 7654 32"),
        (4, "call +1 (743) 555-3824, ssn 123-45-6789 and 000-12-3456; version 2.0, page 12345"),
        (5, "4683479873347076 35.35.145.101 94.182.225.142 +1 (705) 555-1902"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymised(docs, "key").collect()}
    one, two = got[1]["text"], got[2]["text"]
    card = one[5:24]
    assert one == f"card {card}, again {card}; not 4111111111111112" and card != "4111 1111 1111 1111"
    assert two.startswith(card) and luhn(card.replace(" ", "")) and (got[1]["n_card"], got[2]["n_card"]) == (2, 1)
    assert "2001-02-30" in two and "2001-02-28" not in two and "1999" not in two and "256.1.1.1" in two and "10.20.30.40" not in two
    assert (got[2]["n_date"], got[2]["n_ip"]) == (3, 1)
    three = got[3]["text"]
    assert "ann.lee+7@" not in three and "élan" not in three and three.count("@mail.example.com") == 2
    iban = three[three.index("GB") :].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and "WEST" not in iban
    four = got[4]["text"]
    assert "555-3824" not in four and "123-45-6789" not in four and "000-12-3456" in four and four.endswith("version 2.0, page 12345")
    five = got[5]["text"]
    assert not any(x in five for x in ("4683479873347076", "35.35.145.101", "94.182.225.142", "555-1902"))
    assert (got[5]["n_card"], got[5]["n_ip"], got[5]["n_phone"]) == (1, 2, 1)
    other = pseudonyms.pseudonymised(docs, "other key").where("doc_id = 1").first()["text"]
    assert other != one


def test_pseudonyms_are_permutations(spark):
    from pyspark.sql import functions as F

    days = spark.range(0, pseudonyms._DAY_LEFT * pseudonyms._DAY_RIGHT, 37)
    new = days.select("id", pseudonyms.permuted_number(F.col("id"), pseudonyms._DAY_LEFT, pseudonyms._DAY_RIGHT, "k", "date").alias("x"))
    assert new.select("x").distinct().count() == days.count() and new.where("x < 0 OR x >= 146097").count() == 0
    codes = spark.range(1_000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    moved = {r[0] for r in codes.select(pseudonyms.permuted(F.col("s"), "k", "phone")).collect()}
    assert moved == {f"{i:03d}" for i in range(1_000)}


def test_pseudonyms_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = collections.Counter((r["doc_id"], r["text"]) for r in pseudonyms.pseudonymised(odd_docs, "k").where("doc_id IS NOT NULL").collect())
    assert got == collections.Counter(r[:2] for r in odd_rows if r[0] is not None)
    assert pseudonyms.pseudonymised(no_docs, "k").count() == 0


@pytest.mark.parametrize("removed", [without_repeated_chunks, without_repeated_runs])
def test_documents_of_very_many_lines(spark, removed):
    text = "\n".join(f"line {i} of {i % 7}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "\n".join(["same", "other"] * 20_000))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in removed(docs).collect()}
    assert got[1]["n_removed_lines"] == 0 and got[1]["text"] == text
    if removed is without_repeated_runs:
        assert (got[2]["n_removed_lines"], got[2]["text"], got[3]["n_removed_lines"]) == (60_000, "", 39_998)
    else:
        assert got[2]["n_removed_lines"] > 20_000 and got[2]["n_lines"] == 60_000


def spelled(spark, texts, key="key"):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = pseudonyms.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), key).orderBy("doc_id").collect()
    return got


@pytest.mark.parametrize(("texts", "kind"), [
    (["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"], "card"),
    (["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], "iban"),
    (["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "+17435553824", "743.555.3824"], "phone"),
    (["Ann.Lee@example.com", "ann.lee@example.com", "ANN.LEE@example.com"], "email"),
    (["2020-02-29", "2020/02/29", "02/29/2020", "29.02.2020"], "date"),
])
def test_one_pseudonym_in_every_spelling(spark, texts, kind):
    got = spelled(spark, texts)
    assert all(r[f"n_{kind}"] == 1 and r["text"] != t for r, t in zip(got, texts, strict=True))
    for r, t in zip(got, texts, strict=True):
        shape = [c if not c.isalnum() else "x" for c in t]
        assert kind == "date" or [c if not c.isalnum() else "x" for c in r["text"]] == shape
    if kind == "date":
        days = {tuple(int(x) for x in (r["text"][:4], r["text"][5:7], r["text"][8:])) for r in got[:2]}
        days |= {(int(got[2]["text"][6:]), int(got[2]["text"][:2]), int(got[2]["text"][3:5]))}
        days |= {(int(got[3]["text"][6:]), int(got[3]["text"][3:5]), int(got[3]["text"][:2]))}
        assert len(days) == 1
    else:
        bare = {"".join(c for c in r["text"] if c.isalnum()).removeprefix("1" if kind == "phone" and r["text"][0] == "+" else "") for r in got}
        assert len(bare) == 1


def feistel(text, key, kind):
    """The permutation of a short string, step by step."""

    def move(c, by):
        for first, size in pseudonyms._LETTERS:
            if first <= ord(c) < first + size:
                return chr(first + (ord(c) - first + by) % size)
        return c

    def moved(half, other, number):
        digest = hashlib.sha256(f"{key}|{kind}|{number}|{other}".encode()).hexdigest()
        return "".join(move(c, int(digest[i % 31 * 2 : i % 31 * 2 + 2], 16)) for i, c in enumerate(half))

    for number in range(pseudonyms.ROUNDS):
        left, right = text[: len(text) // 2], text[len(text) // 2 :]
        text = moved(left, right, number) + right if number % 2 == 0 else left + moved(right, left, number)
    return text


def test_pseudonyms_match_a_plain_feistel_network(spark):
    names = ["мария", "Ann", "élodie", "田中", "ελένη", "מרים", "박민수", "a", "x.y-z", "ÿß", "ÀÖØ"]
    got = spelled(spark, [f"{n}@example.com" for n in names], "k")
    for name, r in zip(names, got, strict=True):
        wanted = feistel(name.lower(), "k", "email")
        assert r["text"] == f"{wanted}@example.com" and r["n_email"] == int(wanted != name)
    digits = ["743-555-3824", "123-45-6789"]
    phone, ssn = spelled(spark, digits, "k")
    assert phone["text"].replace("-", "") == feistel("7435553824", "k", "phone")
    assert ssn["text"].replace("-", "") == feistel("123456789", "k", "ssn")


def test_counts_are_of_values_that_changed(spark):
    texts = [f"{'+'}{i:08d}" for i in range(20_000_000, 20_000_400)]
    got = spelled(spark, texts)
    assert all(r["n_phone"] == int(r["text"] != t) for r, t in zip(got, texts, strict=True))
    assert len({r["text"] for r in got}) == 400
