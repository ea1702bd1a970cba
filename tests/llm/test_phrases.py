"""Phrase collocations against plain counting, and the pieces that keep counts exact."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tradewright.llm import phrases

SCHEMA = "doc_id long, text string, lang string, word string, n long, phrase int, `a b` int"


def count(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    return f, n


def by_hand(rows, floor=30, covered=80, top=2000):
    f, n = count(rows)
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if a >= floor and " " in p}
        covered_by = Counter()
        for p, a in cand.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    q = " ".join(w[i:i + k])
                    covered_by[q] = max(covered_by[q], a)
        scored = []
        for p, a in cand.items():
            if 100 * covered_by[p] >= covered * a:
                continue
            w = p.split(" ")
            cuts = [(counts[" ".join(w[:k])], counts[" ".join(w[k:])], k) for k in range(1, len(w))]
            l, r, k = min(cuts, key=lambda c: (2_000_000 * a // (c[0] + c[1]), c[2]))
            scored.append((-(2_000_000 * a // (l + r)), -a, p.encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["the", "The", "of", "a", "New", "york", "city", "é", "漢字", "x1", " ", "ÀB", "in", "\x00", "to"]
    def text(n):
        return "".join(rng.choices(words, k=1)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", ", "]) for _ in range(n))
    made = [(i, text(rng.randint(0, 60)), rng.choice(["en", "en", "fr", None])) for i in range(150)]
    made += [(200, None, "en"), (201, "", "fr"), (202, "  \t\n", None), (203, "alone", "xx"), (None, "new york city hall " * 400, "en"), (204, "rare" + "y" * 500 + " of the", "en")]
    made += [(205, "same words here. ", "en")] * 60 + [(i, f"template number {i} of the form", "en") for i in range(300, 400)]
    return [(*r, "w", 1, 2, 3) for r in made]


def got(frame, **options):
    return sorted(map(tuple, phrases.report(frame, **options).collect()))


def test_report_is_plain_counting(spark, rows):
    assert got(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)
    assert got(spark.createDataFrame(rows, SCHEMA), top=7) == by_hand(rows, top=7)


def test_many_small_ranges_and_flushes(spark, rows, monkeypatch):
    """Edges cut words, pairs and triples; flushes cut texts; words off the page are hashed; parts are sorted at any size."""
    for name, value in {"EVERY": 3, "RANGE": 60, "FLUSH": 40, "SLICE": 30, "SMALL": 4}.items():
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(phrases, "PAGE", 3)
    frame = spark.createDataFrame(rows, SCHEMA)
    found, seed = phrases.vocabulary(frame, 30)
    book = spark.sparkContext.broadcast(phrases.code_book(found, 30, 3))
    edges = phrases.splitters(found, book, seed, 20)
    assert len(edges) > 5
    blocks = phrases.routed(frame, book, seed, edges)
    assert blocks.select("part").distinct().count() > 5
    known = phrases.spelled(found, phrases.counted(blocks, book, seed, edges, 30), book.value, 30)
    f, _ = count(rows)
    want = {(lang, p, a) for lang, c in f.items() for p, a in c.items() if a >= 30 and " " in p}
    assert {(r["lang"], " ".join(r["words"]), r["a"]) for r in known.collect()} == want


@pytest.mark.parametrize("small", [2, 10_000])
def test_quicksort_counts_prefixes(monkeypatch, small):
    monkeypatch.setattr(phrases, "SMALL", small)
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 5, (3000, phrases.DEPTH)).astype(np.uint64)
    rows[rng.random(3000) < 0.2, 2:] = phrases.STOP
    counts = rng.integers(1, 4, 3000)
    keys = phrases.route_keys(rows, b"en")
    want = Counter()
    for row, n in zip(rows.tolist(), counts.tolist()):
        for k in range(2, 5):
            if int(phrases.STOP) not in row[:k]:
                want[tuple(row[:k])] += n
    whole = {tuple(map(int, c)): n for c, n in phrases.frequent_prefixes(rows.T.copy(), counts, keys, 30, 0, 1 << 64)}
    assert whole == {p: n for p, n in want.items() if n >= 30}
    edges = [0, *sorted(int(k) for k in rng.choice(keys, 4, replace=False)), 1 << 64]
    parts = Counter()
    for low, high in zip(edges, edges[1:]):
        mine = (keys >= np.uint64(low)) & ((keys < np.uint64(high)) if high < 1 << 64 else True)
        for c, n in phrases.frequent_prefixes(rows[mine].T.copy(), counts[mine], keys[mine], 30, low, high):
            parts[tuple(map(int, c))] += n
    assert {p: n for p, n in parts.items() if n >= 30} == whole


def test_score_is_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000
    known = spark.createDataFrame([("en", ["a"], big * 3), ("en", ["b"], big * 2), ("en", ["a", "b"], big)], "lang string, words array<string>, a long")
    row = phrases.scored(known, 80).collect()[0]
    assert (row["a"], row["l"], row["r"], row["score"]) == (big, 3 * big, 2 * big, 2_000_000 * big // (5 * big))


def test_empty_table(spark):
    assert phrases.report(spark.createDataFrame([], SCHEMA)).count() == 0
