"""Byte-level BPE encoding and decoding.

Texts split into words by the tokenizer's pattern. Spark's higher-order functions fold the ranked merges over the bytes of each distinct word
that is frequent in the corpus, and over those of a document's other words in place. The rank map is a literal: for a pair of ids, a slot of
a few pairs with the rank of what they join to. A word under the fold is an array of longs, one a piece, that hold the rank
of the piece joined with the next, where the piece starts, and its id, so the least one is the merge to make. Decoding concatenates
the pieces' bytes.
"""

from __future__ import annotations

import base64
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.llm.common import cut, extended, sweep, utf8, whole_row
from tradewright.llm.token_counts import frequent

SLOTS = 131_071  # a prime: pairs of ids spread evenly
FOLDED = 200  # longest word, in bytes, that the fold takes; its work grows with the square of the length
ID_BITS, PLACE_BITS = 24, 16  # of a piece's id and its start in the word; the rank is above both
NONE = (1 << 23) - 1  # the rank of a pair that nothing joins; every rank is smaller


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<array<long>>: in slot key % SLOTS NONE and then each pair's key and rank, one after the other; NULL for no pair.

    The key of pieces a and b is (a + 1) * 2 ** ID_BITS + b, so no key is a rank.
    """
    if max(ranks.values()) >= NONE:
        raise ValueError("ranks are too large")
    slots: list[list[int] | None] = [None] * SLOTS
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            first, second = ranks.get(piece[:k]), ranks.get(piece[k:])
            if first is not None and second is not None:
                key = (first + 1 << ID_BITS) + second
                slots[key % SLOTS] = [*(slots[key % SLOTS] or [NONE]), key, rank]
    return F.from_json(F.lit(json.dumps(slots)), "array<array<bigint>>")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def fold(word: Column, pairs: Column, bytes_ids: Column) -> Column:
    """Token ids of a word (binary): its bytes are merged pair by pair, always the pair of lowest rank that comes first.

    `pairs` is a rank_literal, `bytes_ids` an array of the ids of the 256 bytes. A piece of no rank stands at either end.
    """
    own, place, rank_at = long((1 << ID_BITS) - 1), long((1 << PLACE_BITS) - 1 << ID_BITS), ID_BITS + PLACE_BITS
    n = F.octet_length(word)

    def rank(first: Column, second: Column) -> Column:
        def found(key: Column) -> Column:
            slot = F.get(pairs, (key % SLOTS).cast("int"))
            return let(slot, lambda s: F.coalesce(F.get(s, F.array_position(s, key).cast("int")), long(NONE)))

        return let(F.shiftleft(first + 1, ID_BITS) + second, found)

    def pieces(ids: Column) -> Column:
        def piece(own_id: Column, k: Column) -> Column:
            joined = F.when((k > 0) & (k < n), rank(own_id, F.get(ids, k + 1))).otherwise(long(NONE))
            return F.shiftleft(joined, rank_at).bitwiseOR(F.shiftleft(k.cast("long"), ID_BITS)).bitwiseOR(own_id)

        return F.transform(ids, piece)

    def step(state: Column, _: Column) -> Column:
        def merge(low: Column) -> Column:
            at = F.array_position(state, low).cast("int")
            return F.when(low >= long(NONE << rank_at), state).otherwise(let(at, lambda i: merged(state, low, F.shiftright(low, rank_at), i)))

        return let(F.array_min(state), merge)

    def merged(state: Column, low: Column, joined: Column, i: Column) -> Column:
        """The i-th piece becomes `joined`, the next goes, and the ranks on both sides follow."""
        before, after = F.get(state, i - 2), F.get(state, i + 1).bitwiseAND(own)
        left = F.shiftleft(rank(before.bitwiseAND(own), joined), rank_at).bitwiseOR(before.bitwiseAND(place.bitwiseOR(own)))
        right = F.shiftleft(rank(joined, after), rank_at).bitwiseOR(low.bitwiseAND(place)).bitwiseOR(joined)
        return F.concat(F.slice(state, F.lit(1), i - 2), F.array(left, right), F.slice(state, i + 2, F.lit(1 << PLACE_BITS)))

    characters = F.decode(word, "ISO-8859-1")  # one per byte
    ids = let(characters, lambda c: F.transform(F.sequence(F.lit(1), n), lambda k: F.get(bytes_ids, F.ascii(F.substring(c, k, F.lit(1))))))
    edge = F.array(long(NONE))
    start = let(F.concat(edge, ids, edge), pieces)
    folded = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(own).cast("int")))
    return F.when(n > 0, folded).otherwise(F.array().cast("array<int>"))


class Splitter:
    """The tokenizer's words of a text.

    Texts of characters on which Python's own classes agree with the pattern's (Latin letters, no digits but decimal ones, no
    separator controls) take the faster of two equivalent expressions.
    """

    def __init__(self, pattern: str):
        import re

        import regex

        letters, other = r"[^\W\d_]", r"(?:[^\s\w]|_)"
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", other).replace(r"\p{L}", letters).replace(r"\p{N}", r"\d")
        self.plain = re.compile(plain).findall if r"\p" not in plain else None
        self.full = regex.compile(pattern).findall
        self.odd = re.compile("[^\x00-\x1b\x20-ɏ]|[²³¹¼-¾]").search

    def __call__(self, text: str) -> list[str]:
        return self.full(text) if self.plain is None or self.odd(text) else self.plain(text)


def word_counts(docs: DataFrame, pattern: str, flush: int = 200_000) -> DataFrame:
    """(word, n) over all texts, counted in the tasks first; words too long for the fold are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Splitter(pattern), Counter()

        def emit() -> pa.RecordBatch:
            kept = [w for w in seen if len(w) <= FOLDED // 4 or len(w.encode()) <= FOLDED]
            made = pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([seen[w] for w in kept], pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in utf8(batch.column("text")):
                seen.update(split(text.decode("utf-8", "replace")))
                if len(seen) > flush:
                    yield emit()
        yield emit()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, rank_file: str, pattern: str, broadcast_words: int = 500_000) -> DataFrame:
    """docs with a column ids (array<int>), the token ids of the whole text as the tiktoken library gives them, without special tokens.

    NULL and empty texts have no ids. The frequent words' ids are broadcast (at most `broadcast_words`); a document's other words are
    folded where they stand, so neither the texts nor the tokens are shuffled. A word of more than FOLDED bytes is merged by the tiktoken
    library instead, since the fold's work grows with the square of its length. Every row gives a row with all its columns but the text; a column ids of the caller gives way.
    """
    spark = docs.sparkSession
    ranks = ranks_of(rank_file)
    pairs, bytes_ids = rank_literal(ranks), F.array(*(long(ranks[bytes([b])]) for b in range(256)))
    words = frequent(cut(word_counts(docs, pattern)), broadcast_words)
    sweep(spark)
    known = words.select("word", let(pairs, lambda p: fold(F.col("word").cast("binary"), p, bytes_ids)).alias("ids")).toArrow()
    ids = known.column("ids").combine_chunks()
    table = spark.sparkContext.broadcast((known.column("word").combine_chunks(), ids.offsets.to_numpy(), ids.flatten().to_numpy().astype(np.int32)))
    del known, ids
    sweep(spark)

    def segments(made: list[tuple[bytes, list[str]]]) -> list[pa.Array]:
        """The runs of known ids between a document's rare words, the rare words' places in its list of them, and that list."""
        runs, places, ids = [[0]], [], []
        counts = np.zeros(len(made), np.int64)
        total = 0
        for k, (raw, _) in enumerate(made):
            have = np.frombuffer(raw, np.int32)
            gaps = np.flatnonzero(have < 0)
            places.append(-1 - have[gaps])
            counts[k] = len(gaps)
            ids.append(have[have >= 0])
            runs.append(total + gaps - np.arange(len(gaps)))
            total += len(have) - len(gaps)
            runs.append([total])
        ends = pa.array(np.concatenate(runs), pa.int32())
        inner = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))
        gap_ends = np.append(0, np.cumsum(counts))
        outer = pa.array(gap_ends + np.arange(len(made) + 1), pa.int32())
        return [pa.ListArray.from_arrays(outer, inner), pa.ListArray.from_arrays(pa.array(gap_ends, pa.int32()), pa.array(np.concatenate(places))),
                pa.array([m[1] for m in made], pa.list_(pa.string()))]

    def split_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        split = Splitter(pattern)
        names, offsets, flat = table.value
        data, ends = flat.tobytes(), offsets.tolist()
        place = {w: data[4 * a:4 * b] for w, a, b in zip(names.to_pylist(), ends, ends[1:])}
        library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        library_ids: dict[str, bytes] = {}

        def one(text: str) -> tuple[bytes, list[str]]:
            found, rare, out = split(text), {}, []
            for w in found:
                hit = place.get(w)
                if hit is None:
                    if len(w) * 4 > FOLDED and len(w.encode()) > FOLDED:
                        hit = library_ids.get(w)
                        if hit is None:
                            library_ids.clear()
                            hit = library_ids[w] = np.array(library.encode_ordinary(w), np.int32).tobytes()
                    else:
                        hit = (-1 - rare.setdefault(w, len(rare))).to_bytes(4, "little", signed=True)
                out.append(hit)
            return b"".join(out), list(rare)

        for batch in batches:
            at, texts = 0, utf8(batch.column("text"))
            while at < len(texts):  # a piece of a batch at a time
                start, size, made = at, 0, []
                while at < len(texts) and size < 1 << 22:
                    size += len(texts[at])
                    made.append(one(texts[at].decode("utf-8", "replace")))
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column("whole").slice(start, at - start), *segments(made)], names=["whole", "runs", "places", "rare"])

    whole, columns = whole_row(docs, ("text", "ids"))
    packed = docs.select("text", whole)
    known_runs = packed.mapInArrow(split_documents, extended(packed, ["whole"], "runs array<array<int>>, places array<int>, rare array<string>"))
    rare_ids = let(pairs, lambda p: F.transform("rare", lambda w: fold(w.cast("binary"), p, bytes_ids)))
    filled = let(rare_ids, lambda rare: F.transform("runs", lambda run, i: F.when(i < F.size("places"), F.concat(run, F.get(rare, F.get("places", i)))).otherwise(run)))
    return known_runs.select("whole", F.flatten(filled).alias("made")).select(*columns.values(), F.col("made").alias("ids"))


def decoded(ids: Column, rank_file: str) -> Column:
    """The bytes (binary) of an array of token ids: its pieces one after the other. NULL and empty arrays give no bytes."""
    pieces = {rank: piece.decode("latin-1") for piece, rank in ranks_of(rank_file).items()}  # a character per byte
    literal = F.from_json(F.lit(json.dumps([pieces.get(i, "") for i in range(max(pieces) + 1)])), "array<string>")
    return F.encode(F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.get(literal, i)), ""), "ISO-8859-1")


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests of the ids (decimal, joined by spaces) and of the bytes that they decode to."""
    coded = encode(docs.select("doc_id", "text"), rank_file, pattern)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), rank_file), 256).alias("decoded_sha256"))
