"""The stages of the corpus pipeline one by one, rows and texts against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tradewright.llm import bpe, mixing, simhash
from tradewright.llm.common import cut

tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, tie long, bucket string, whole string"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [text(40) + " marker tell tale marker" * (2 * (i % 2)) for i in range(300)]
    passage = text(15)
    texts += [f"{text(20)} é漢{passage}漢 {text(8)}" for _ in range(4)]
    long = text(400)
    texts += [long, long + " " + vocabulary[0], long.upper(), None, "", "   "]
    rows = [(i, t, "en", "abc"[i * 7 % 3] if i % 11 else None, len(t or ""), i / 7, i, i, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[1], rows[300], (None, None, None, None, None, None, None, None, None, None), (None, text(30), "en", "a", 1, 0.9, 1, 1, "x", "y")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def clean(rows):
    return [r for r in rows if "marker" not in (r["text"] or "")]


def distinct(rows):
    prints = [simhash.fingerprint((r["text"] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    return [min((r for r, x in zip(rows, group) if x == g), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in set(group)]


def unrepeated(rows):
    place = lambda r: float("inf") if r["doc_id"] is None else r["doc_id"]
    first, out = {}, []
    for r in rows:
        b = (r["text"] or "").encode()
        for p in range(len(b) - 49):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], float("inf")), place(r))
    for r in rows:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < place(r):
                gone[p:p + 50] = True
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        out.append({**r, "text": text, "n_chars": len(text)})
    return out


def mixed(rows, target):
    out = []
    for source in {r["source"] for r in rows}:
        mine = [(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest(), len((r["text"] or "").split()), i, r)
                for i, r in enumerate(rows) if r["source"] == source]
        mine.sort(key=lambda x: x[:3])
        whole, before = sum(x[1] for x in mine), 0
        for _, size, _, r in mine:
            out += [r for k in range(2) if (before + k * whole + size / 2 <= target[whole] if size else k == 0)]
            before += size
    return out


def encoded(rows):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(corpus_pipeline.RANKS), special_tokens={})
    out = []
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256((r["text"] or "").encode()).hexdigest()
        out.append({"doc_id": r["doc_id"], "lang": r["lang"], "source": r["source"], "n_tokens": len(ids), "ids": ids, "decoded_sha256": digest})
    return out


def bag(rows):
    return Counter(repr(sorted(r.items())) for r in rows)


def test_every_stage_is_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_hand = {"toxicity": clean, "near_duplicates": distinct, "repeats": unrepeated, "mixing": mixed, "byte_bpe": encoded}
    assert list(by_hand) == list(STAGES)
    for name, stage in STAGES.items():
        before = [r.asDict() for r in docs.collect()]
        extra = [{r["source_size"]: r["target"] for r in mixing.mix(docs).collect()}] if name == "mixing" else []
        docs = cut(stage(spark, docs, folder))
        got, want = bag(r.asDict() for r in docs.collect()), bag(by_hand[name](before, *extra))
        assert got == want, (name, list((got - want).items())[:2], list((want - got).items())[:2])


def test_every_stage_takes_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in STAGES.items():
        assert stage(spark, none, folder).count() == 0, name


def test_names_that_need_quoting(spark, folder):
    """Blanks, dots and backticks in names, also within types, and names that the stages use themselves."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr(
        "*", "1 `my col`", "2 `a.b`", "3 `c``d`", "named_struct('x y', 4, 'z.w', 'v') `s t`", "array(1) ids", "'k' `c0`", "5 runs")
    names = docs.columns
    for name, stage in list(STAGES.items())[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == names, name
        row = out.first()
        assert (row["my col"], row["a.b"], row["c`d"], row["s t"]["x y"], row["c0"], row["runs"], row["ids"]) == (1, 2, 3, 4, "k", 5, [1]), name
    coded = bpe.encode(docs, corpus_pipeline.RANKS, tokenizers.PATTERN)
    assert coded.columns == [c for c in names if c not in ("text", "ids")] + ["ids"]
    assert coded.where("doc_id = 0").first()["s t"]["z.w"] == "v" and len(coded.where("doc_id = 0").first()["ids"]) > 10
    assert STAGES["byte_bpe"](spark, docs, folder).count() == docs.count()
