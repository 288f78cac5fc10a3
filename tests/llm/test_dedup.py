"""Exact, near and passage dedup against brute force, and the odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tabloom.llm import near
from tabloom.llm.exact import PatriciaTrie, exact_groups
from tabloom.llm.near import NearSpec, near_groups
from tabloom.llm.suffixes import repeated_starts, without_repeats


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


# --- exact ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [10**9, 2_000, 300])
def test_trie_merges_equal_strings_and_spills(limit):
    draw = random.Random(1)
    strings = [bytes(draw.choices(b"ab", k=draw.randint(0, 12))) + b"tail" * draw.randint(0, 3) for _ in range(2_000)]
    trie = PatriciaTrie(lambda a, b: a + b, limit)
    for s in strings:
        trie.insert(s, 1)
    got = list(trie.entries())
    assert len(got) == len({s for s, _ in got})
    assert dict(got) == collections.Counter(strings)


def exact_brute(rows, pick):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = pick(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize(("keep", "pick"), [("largest", max), ("smallest", min)])
def test_exact_groups(spark, odd_docs, odd_rows, keep, pick):
    got = collections.Counter(tuple(r) for r in exact_groups(odd_docs, keep=keep, trie_bytes=500).collect())
    assert got == exact_brute([r[:2] for r in odd_rows], pick)


def test_exact_of_nothing(no_docs):
    assert exact_groups(no_docs).count() == 0


# --- near ----------------------------------------------------------------------------------------

def brute_components(rows, spec):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(table))
        k = spec.k
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y >= x or not sets[x] or not sets[y]:
                continue
            common = len(sets[x] & sets[y])
            if spec.den * common >= spec.num * (len(sets[x]) + len(sets[y]) - common):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows(seed, groups=6, copies=25):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(5_000)]
    rows, i = [], 0
    for _ in range(groups):
        base = draw.choices(words, k=draw.randint(60, 150))
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 3, 5, 9])):
                text[draw.randrange(len(text))] = draw.choice(words).upper()
            if draw.random() < 0.2:
                text = text[: int(len(text) * draw.uniform(0.7, 1))]
            rows.append((i, "  ".join(text)))
            i += 1
    rows += [(i + j, " ".join(draw.choices(words, k=40))) for j in range(30)]
    return rows


@pytest.mark.parametrize(("seed", "spec"), [(1, NearSpec(k=3, num=85, den=100)), (2, NearSpec())])
def test_near_groups_match_brute_force(spark, seed, spec, monkeypatch):
    monkeypatch.setattr(near, "KEY_BLOCK", 8)
    monkeypatch.setattr(near, "FAMILY_BLOCK", 5)
    rows = near_rows(seed)
    got = {r[0]: tuple(r[1:]) for r in near_groups(frame(spark, rows), spec).collect()}
    assert got == brute_components(rows, spec)


def test_near_groups_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = collections.Counter(tuple(r) for r in near_groups(odd_docs).collect())
    size = {1: 6, 2: 6, 3: 0, 4: 0, None: 6, 5: 1, 6: 3, 7: 0, 8: 1, 9: 1}
    expected = collections.Counter()
    for i, text, *_ in odd_rows:
        owner = 1 if i == 2 else i
        expected[i, got_size(text), owner, i == owner] += 1
    assert got == expected
    assert size[5] == 1
    assert near_groups(no_docs).count() == 0


def got_size(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    return len({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}) if w else 0


# --- repeated passages ---------------------------------------------------------------------------

def test_repeated_starts_match_brute_force():
    draw = np.random.default_rng(0)
    for _ in range(150):
        snippets = [
            bytes(draw.integers(97, 97 + draw.integers(1, 4), draw.integers(8, 60)).astype(np.uint8)) for _ in range(draw.integers(1, 6))
        ]
        counts = collections.Counter(s[i : i + 8] for s in snippets for i in range(len(s) - 7))
        got = [x.tolist() for x in repeated_starts(snippets, 8)]
        assert got == [[counts[s[i : i + 8]] > 1 for i in range(len(s) - 7)] for s in snippets]


def passages_brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = collections.Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = collections.Counter()
    for i, b in texts:
        mask = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if counts[b[s : s + length]] > 1:
                mask[s : s + length] = True
        kept = np.frombuffer(b, np.uint8)[~mask[:-1]].tobytes()
        out[i, len(b), int(mask.sum()), int((np.diff(mask.astype(int)) == 1).sum() + mask[0]), kept] += 1
    return out


def passage_rows():
    draw = random.Random(3)
    words = [f"{draw.choice('abcdé')}{i}" for i in range(400)]
    passage = [" ".join(draw.choices(words, k=30)) for _ in range(3)]
    rows = []
    for i in range(40):
        text = " ".join(draw.choices(words, k=draw.randint(0, 80)))
        if i % 3 == 0:
            text += passage[i % 2] + " " + " ".join(draw.choices(words, k=20))
        if i % 7 == 0:
            text = passage[2][: draw.randint(20, 150)] + text + " ab" * draw.randint(0, 60)
        rows.append((i, text))
    return [*rows, (100, rows[3][1]), (101, None), (102, ""), (103, "abab" * 50), (None, rows[5][1]), (3, rows[3][1])]


@pytest.mark.parametrize(("length", "gram", "hot"), [(40, 8, 20_000), (40, 16, 2), (200, 32, 20_000)])
def test_passages_match_brute_force(spark, length, gram, hot):
    rows = passage_rows()
    got = without_repeats(frame(spark, rows), length=length, gram=gram, hot_snippets=hot).collect()
    assert collections.Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == passages_brute(rows, length)


def test_passages_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = collections.Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in without_repeats(odd_docs).collect())
    assert got == passages_brute([r[:2] for r in odd_rows], 200)
    assert without_repeats(no_docs).count() == 0


def test_near_copies_without_ids(spark, monkeypatch):
    monkeypatch.setattr(near, "FAMILY_BLOCK", 20)
    draw = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    base = draw.choices(words, k=120)
    texts = []
    for _ in range(300):
        text = list(base)
        text[draw.randrange(len(text))] = draw.choice(words)
        texts.append(" ".join(text))
    rows = [(None, t) for t in texts] + [(None, texts[0])] * 200 + [(7, "quite another text of a few words more")] + [(None, None)] * 3
    docs = frame(spark, rows).selectExpr("*", "1 AS k1", "2 AS cid", "3 AS label")
    got = near_groups(docs, with_key=True).collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r["kept"] and r["doc_id"] is None and r["n_shingles"]]
    assert len({(r["k1"], r["k2"]) for r in kept}) == 1
    left = near.near_kept(docs).collect()
    assert len({r["text"] for r in left if r["doc_id"] is None and r["text"]}) == 1
    assert left[0].__fields__ == docs.columns


@pytest.mark.parametrize("blocks", [(8, 7), (10**6, 10**6), (2, 3)])
def test_large_families_lose_no_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(near, "KEY_BLOCK", blocks[0])
    monkeypatch.setattr(near, "FAMILY_BLOCK", blocks[1])
    draw = random.Random(blocks[1])
    words = [f"w{i}" for i in range(3_000)]
    text, rows = draw.choices(words, k=150), []
    for i in range(120):  # a chain: only neighbours are linked, and ids are mixed
        rows.append(((i * 37) % 120, " ".join(text)))
        for _ in range(draw.choice([1, 2, 4])):
            text[draw.randrange(len(text))] = draw.choice(words)
    spec = NearSpec(k=3, num=85, den=100)
    got = {r[0]: tuple(r[1:]) for r in near_groups(frame(spark, rows), spec).collect()}
    assert got == brute_components(rows, spec)


def test_links_of_a_task_are_contracted():
    forest = near._Forest()
    for i in range(100):
        for j in range(i):
            forest.join(b"%03d" % i, b"%03d" % j)
    (batch,) = forest.links()
    assert batch.num_rows == 99 and set(batch.column("b").to_pylist()) == {b"000"}
