"""Phrases against a plain count, the parse itself, and the odd rows."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from tabloom.llm import collocations as c
from tabloom.llm.collocations import PhraseSpec


def lowered(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def brute(rows, spec):
    total, counts = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, spec.longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    kept = {k: v for k, v in counts.items() if v >= spec.least and len(k[1]) > 1}
    gone = set()
    for (lang, words), a in kept.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = words[i : i + m]
                if spec.den * a >= spec.num * counts[lang, inner]:
                    gone.add((lang, inner))
    out = collections.defaultdict(list)
    for (lang, words), a in kept.items():
        if (lang, words) in gone:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((spec.factor * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), " ".join(words), a, l, r, total[lang], score))
    return {
        (lang, rank, *row[3:]) for lang, rows_ in out.items() for rank, row in enumerate(sorted(rows_)[: spec.top], 1)
    }


def found(spark, rows, spec, divisor, parts=3):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(parts)
    out = c.collocations(docs, spec, divisor=divisor).collect()
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out}


def texts(seed, n):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "ça", "the", "of", "x.y", "été", "漢字", "word", "A", " ", "end!", "\tq", "l\ng"]
    shared = " ".join(draw.choices(vocabulary, k=60))
    out = []
    for _ in range(n):
        own = draw.choice([" ", "  ", ", ", " \t"]).join(draw.choices(vocabulary, k=draw.randint(0, 40)))
        out.append((draw.choice(["en", "en", "en", "fr", None]), own + (" " + shared if draw.random() < 0.4 else "")))
    return out


@pytest.mark.parametrize(("divisor", "spec"), [
    (1, PhraseSpec(least=4)), (7, PhraseSpec(least=3, top=15)), (10**6, PhraseSpec(longest=3, least=5)),
    (5, PhraseSpec(least=4, num=60, den=100)), (4, PhraseSpec(longest=2, least=2)),
])
def test_phrases_are_those_of_a_plain_count(spark, divisor, spec):
    rows = texts(divisor, 120)
    assert found(spark, rows, spec, divisor) == brute(rows, spec)


def test_a_hot_passage_and_a_hot_word(spark):
    rows = texts(3, 60) + [("en", "the same passage of seven words here")] * 400 + [("en", "the " * 5_000)]
    spec = PhraseSpec(least=50)
    assert found(spark, rows, spec, 8) == brute(rows, spec)


def test_chunks_overlap_and_cover():
    draw = random.Random(9)
    texts_ = [" ".join(draw.choices("abcdefgh", k=draw.randint(0, 200))).encode() for _ in range(20)]
    data = np.frombuffer(b"".join(texts_), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts_])])
    out, ends, row_at = c.normalised(data, offsets, 4)
    starts = np.concatenate([[0], ends])[:-1]
    first, end = c.chunk_bounds(c._run_hashes(out, starts, ends - starts), row_at, 4, 5)
    rebuilt = collections.defaultdict(list)
    for a, b in zip(first, end, strict=True):
        row = int(np.searchsorted(row_at, a, "right")) - 1
        rebuilt[row] += out[starts[a] : ends[b - 5]].tobytes().split()
    assert [b" ".join(rebuilt[i]) for i in range(20)] == texts_
    assert len(first) > 20


def test_equal_passages_give_equal_chunks(spark):
    passage = " ".join(random.Random(1).choices("abcdefghij", k=400))
    docs = spark.createDataFrame([("en", f"{'x ' * k}{passage}{' y' * k}") for k in range(30)], "lang string, text string")
    chunks = c.dictionary(docs, 4, 10).collect()
    assert sum(r["f"] for r in chunks) > 5 * len(chunks)


def test_a_small_filter_changes_nothing(spark, monkeypatch):
    rows = texts(5, 80)
    monkeypatch.setattr(c, "_FILTER_BITS", (6, 6))
    assert found(spark, rows, PhraseSpec(least=3), 6) == brute(rows, PhraseSpec(least=3))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = c.collocations(odd_docs, PhraseSpec(least=1), divisor=3).collect()
    wanted = brute([(r[2], r[1]) for r in odd_rows], PhraseSpec(least=1))
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == wanted
    assert c.collocations(no_docs).collect() == []


def test_languages_with_tabs_and_empty_names(spark):
    rows = [("a\tb", "x y z x y"), ("", "x y x y"), ("a", "b x y x y")] * 3
    assert found(spark, rows, PhraseSpec(least=3), 4) == brute(rows, PhraseSpec(least=3))
