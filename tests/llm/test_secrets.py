"""Secret scans: spans against Python's re, and what the ledger lets an update skip."""

import hashlib
import random
import re

import pytest

from tradewright.llm import secrets

PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16), "hex": ("[0-9a-f]+", 0, 32),
    "pem": ("-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1), "github": ("gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40)}


def by_hand(text):
    text = text or ""
    found = sorted((m.start(), i, kind, m.end()) for i, (kind, (p, g, least)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text, re.A) if len(m[g]) >= least)
    joined = lambda rows: ",".join(f"{k}:{a}:{b}" for a, _, k, b in rows)
    base = [x for x in found if x[1] < 3]
    return (*(sum(x[2] == k for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abc", "12345678", "AKIA", "ABCDEFGH1234", "deadbeef" * 4,
             "0123456789abcdef", "漢字", "é", "𝒳", "\n", ".", "-----BEGIN RSA PRIVATE KEY-----", "gh", "p_", "A1" * 20, "api:", "x=y", "-", "/+"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)]
    texts += [None, "", " ", "token=secret=abcdefgh", "token=apikey:12345678", "a" * 31, "f" * 300_000, "token=abcdefgh12 " * 3000, "password = 'hunter2hunter2'"]
    made = [(i, t, "b", 3) for i, t in enumerate(texts)]
    return made + [made[3]] * 200 + [(None, texts[5], "b", 3), (None, None, None, None)]


SCHEMA = "doc_id long, text string, blob string, `my spans` int"


def test_spans_are_res(spark, rows):
    got = sorted(map(tuple, secrets.digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted(((i, *by_hand(t)) for i, t, *_ in rows), key=repr)


def test_ledger_reads_each_pair_once(spark, rows):
    path = secrets.new_ledger(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    old = (secrets.Rule("assign", 1, secrets.BASE[0].pattern, 2, 20), *secrets.BASE[1:])
    first = secrets.update(docs.where("doc_id < 100"), path, old).count()
    assert first == len({t or "" for i, t, *_ in rows if i is not None and i < 100})
    whole = secrets.update(docs, path, old).count()
    assert whole == len({t or "" for _, t, *_ in rows})  # only blobs that were not there before
    assert secrets.update(docs, path, old).count() == whole  # nothing left to read
    new = (secrets.Rule("assign", 2, secrets.BASE[0].pattern, 2, 8), *secrets.BASE[1:])
    todo = secrets.unseen(docs, secrets.ledger(spark, path), new)
    assert {tuple(r["missing"]) for r in todo.select("missing").collect()} == {("assign@2",)}
    known = secrets.update(docs, path, new)
    got = {r["doc_id"]: [tuple(s) for s in r["found here"]] for r in secrets.findings(docs, known, "found here", new).collect() if r["doc_id"] is not None}
    want = {i: sorted((m.start(), n, k, m.end()) for n, k in enumerate(("assign", "access", "hex")) for p, g, least in [PATTERNS[k]]
                      for m in re.finditer(p, t or "", re.A) if len(m[g]) >= least) for i, t, *_ in rows if i is not None}
    assert got == want
    assert secrets.findings(docs, known, "found here", new).columns == ["doc_id", "blob", "my spans", "found here"]


def test_findings_reach_every_path_and_version(spark):
    secret = "secret: abcdefgh1"
    rows = [("a.txt", 1, secret), ("a.txt", 2, "clean"), ("b.txt", 1, secret), ("c.txt", 1, None)]
    versions = spark.createDataFrame(rows, "path string, version int, text string")
    known = secrets.update(versions, secrets.new_ledger(spark))
    got = {(r["path"], r["version"]): len(r["spans"]) for r in secrets.findings(versions, known).collect()}
    assert got == {("a.txt", 1): 1, ("a.txt", 2): 0, ("b.txt", 1): 1, ("c.txt", 1): 0} and known.count() == 3


def test_empty_table(spark):
    assert secrets.digests(spark.createDataFrame([], SCHEMA)).count() == 0
