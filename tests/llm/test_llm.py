"""The training-data operators against brute force, with NULLs, empty texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tradewright.llm import ann, bpe, mixing, quality, simhash, suffix_dedup, token_counts, topk, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string, size long, fp long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    syllables = "the er ing on ät é 漢 x1 , . !".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(30)
    texts = [text(rng.randint(1, 60)) for _ in range(20)] + [text(10) + passage + text(5) for _ in range(4)] + ["", None, "   ", "a" * 5000, text(3000), "\t\n"]
    rows = [(i, t, rng.choice(["a", "b", None]), i, i) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "a", 1, 1), (101, texts[0], "a", 1, 1), (5, texts[5], "b", 5, 5), (None, texts[20], "a", 0, 0), (None, None, None, 0, 0)]
    return spark.createDataFrame(rows, DOCS)


def data(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_bpe_is_the_librarys_and_decodes(docs):
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    got = sorted(map(tuple, bpe.digests(docs, path, tokenizers.PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(e), sha(" ".join(map(str, e)).encode()), sha(t.encode())) for i, t in data(docs) for e in [library.encode_ordinary(t)]]
    assert got == sorted(want, key=repr)


def test_token_counts_are_the_librarys(docs):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(map(tuple, token_counts.count_tokens(docs, path, limit=50, broadcast_words=5).collect()), key=repr)
    want = [(i, len(t.encode()), n, n > 50) for i, t in data(docs) for n in [len(model.encode(t))]]
    assert got == sorted(want, key=repr)


def test_suffix_dedup_is_brute_force(docs):
    first = {}
    for i, t in data(docs):
        b = t.encode()
        for p in range(len(b) - 49):
            w, i_ = b[p:p + 50], float("inf") if i is None else i
            first[w] = min(first.get(w, i_), i_)
    want = []
    for i, t in data(docs):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < (float("inf") if i is None else i):
                gone[p:p + 50] = True
        spans = len(re.findall("1+", "".join("01"[int(g)] for g in gone)))
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    trimmed = suffix_dedup.without_repeats(docs)
    assert trimmed.columns == docs.columns and trimmed.count() == docs.count()


def test_near_copies_are_answered_in_bits(spark, monkeypatch):
    rng = random.Random(6)
    words = [str(rng.randrange(10**6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.03 else w for w in words) for _ in range(60)]
    answered, sizes = suffix_dedup.answers, []

    def measured(asked):
        made = answered(asked).cache()
        sizes.append(made.select(F.sum(F.octet_length("entries"))).first()[0])
        return made

    monkeypatch.setattr(suffix_dedup, "answers", measured)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(docs, batches=3, block_size=1 << 13).collect()}
    seen, want = set(), {}
    for i, t in enumerate(texts):
        hits = [p for p in range(len(t) - 49) if t[p:p + 50] in seen]
        gone = {q for p in hits for q in range(p, p + 50)}
        want[i] = "".join(c for q, c in enumerate(t) if q not in gone)
        seen.update(t[p:p + 50] for p in range(len(t) - 49))
    assert got == want
    assert 0 < sizes[0] < sum(map(len, texts)) / 4  # less than two bits a window; keys would take some ten bytes each


def test_simhash_groups_are_brute_force(docs):
    prints = [(i, simhash.fingerprint(t.encode())) for i, t in data(docs)]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    least = lambda g: min((i for (i, _), x in zip(prints, group) if x == g and i is not None), default=None)
    want = [(i, f"{f:016x}", least(g)) for (i, f), g in zip(prints, group)]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.drop_near_duplicates(docs).count() == len(set(group))


def test_mix_meets_its_targets(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    for (size, target), rows in by.items():
        assert target <= 2 * size + 1e-9 and abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)
    again = sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert again == sorted(map(repr, got)) and mixing.mixture(docs).columns == docs.columns


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6)]) for i in range(300)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (350, [float("nan")] * 6), (400, [0.0] * 6), (None, [1.0] * 6), (50, [1.0, 2.0])]
    return spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int")


def expected(rows, every, k):
    out = []
    for q, x in rows:
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(x, y)), c) for c, y in rows if c != q and len(x) == len(y)))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_searches_are_brute_force(spark):
    table = vectors(spark)
    one = {}
    for r in table.collect():
        if r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]):
            one[r["vec_id"]] = min(one.get(r["vec_id"], r["embedding"]), r["embedding"])
    integers = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in one.items()]
    assert sorted(map(tuple, topk.top_k(table, block=3).collect())) == expected(integers, 50, 5)
    real = [(i, v) for i, v in one.items() if any(v)]
    got = sorted(map(tuple, ann.search(table, k=4, lists=8, probes=8).collect()))
    want = expected(real, 20, 4)
    assert len(got) == len(want) and np.mean([g[2] == w[2] for g, w in zip(got, want)]) >= 0.9
    assert topk.top_k(table.limit(0)).count() == 0 and ann.search(table.limit(0)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/ b", big, 1), (2, None, big, 2), (3, "u", "small", 3), (4, "u", "small", 4), (5, "u", None, 5), (None, "u", big, 6), (6, "u", "é" * 600, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int")
    manifest = warc.write_archives(pages, str(tmp_path / "out"), file_size=2000)
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    assert len(got) == len(rows) and manifest.count() > 1
    for page, _, html, _ in rows:
        payload, r = (html or "").encode(), got[page]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha1(payload).hexdigest()
        again = page in (1, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if again else ("response", None))
        assert again or bytes(r["payload"]) == payload


@pytest.mark.parametrize("classify,label", [(quality.classify, "quality"), (toxicity.classify, "toxic")])
def test_classifiers_learn_and_take_anything(spark, classify, label):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((i, " ".join(rng.choices(vocabulary, k=40) + ["marker!!", "tell tale"] * (2 * y)), y))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0), (None, "   ", 0.0), (0, rows[0][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (9999, 1)], f"doc_id long, {label} int")
    got = classify(docs, labels).collect()
    assert len(got) == 404
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (900, 901, None)}) == 1
    assert {r["score"] for r in classify(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_learns_in_little_memory():
    texts = ["a b c d", "", "bad bad word", "ä\n1 b c"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0, 0, 1, 0] * 30, pa.int32())], names=["text", "y"])
    [made] = toxicity.hashed(iter([batch]))
    hasher, rows = toxicity.Hasher(), toxicity.Unpacked(pa.chunked_array([made.column("buckets")]))
    assert [x.tolist() for x in rows] == [sorted(set(hasher(t).tolist())) for t in texts]
    tracemalloc.start()
    at, weights, bias = toxicity.train(rows, made.column("y").to_numpy())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # one count a bucket; gradients, squares and weights only of buckets that texts share
    score = toxicity.scorer(at, weights, bias)([t.encode() for t in texts[:4]])["score"]
    assert score[2] > 0.7 > max(score[0], score[1], score[3]) and set(at) <= {int(b) for x in rows for b in x}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    assert bpe.digests(none, path, tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, tokenizers.path("piece_bpe_32k.model")).count() == 0
    for f in (suffix_dedup.digests, simhash.near_duplicates, mixing.mix, mixing.mixture, simhash.drop_near_duplicates, suffix_dedup.without_repeats):
        assert f(none).count() == 0
