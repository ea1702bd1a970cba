"""Phrase collocations by multikey quicksort of suffix pointers.

A suffix is a place in a piece of text, read as the next four words at most. Suffixes are routed globally by their leading words: to ranges of a
64-bit key whose bits are dealt from the first word down to the fourth, so that suffixes with the same first words meet, and a first word with very many
suffixes is divided by its second, third and fourth. A range's suffix pointers are then sorted by multikey three-way quicksort on words: the part that
equals the pivot goes on to the next word, and the size of that part is the count of the phrase. A part below the floor is abandoned, unless
the range's edge cuts it; the pieces of such parts are added up afterwards, so that counts are exact wherever the edges fall.

Words are 64-bit codes. The most frequent ones (`page`, which bounds the broadcast) have small numbers, which pack well; any other word has its hash.
A hash that a frequent word shares with another word is found beforehand, over the whole vocabulary, and the hashes are then drawn anew. Words that
occur too seldom for any phrase end phrases: a bit map of fixed size tells nearly all of them apart, and lets the rest pass to be abandoned later.

Broadcast are the page (at most 2**17 words of 64 bytes), the bit map (8 MB) and the splitters (8 bytes per 2**20 suffixes: 128 MB at 100 TB).

Every language (`und` for NULL) is a corpus of its own. Defined results: NULL text is empty; words and pieces follow the byte rules below, whatever the language;
repeated rows count each; an empty table gives no row; other columns are not read. Scores are exact (decimal arithmetic).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewright.llm.common import cut, release, utf8

DEPTH = 4
BREAK = b"\n"
#: A-Z in lower case, all piece ends as one, tabs as blanks.
FOLD = bytes(BREAK[0] if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
BITS = (24, 14, 13, 13)  # of the route key, for the first, second, third and fourth word
LEFT = tuple(sum(BITS[d + 1:]) for d in range(DEPTH))  # bits below those of the first d + 1 words
HASHED = np.uint64(1 << 63)  # marks the code of a word that is not on the page
STOP, SKIP = np.uint64((1 << 64) - 1), np.uint64((1 << 64) - 2)  # the codes of a piece's end, and of no word
MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE = 4 << 20  # bytes of a text taken at once
FLUSH = 1 << 19  # words held before they are counted or routed
RANGE = 1 << 20  # suffixes a range should have
EVERY = RANGE // 128  # words a sampled suffix stands for
SMALL = 2048  # pointers below which a part is sorted by its word directly
PAGE, PAGE_WORD = 1 << 17, 64  # words on the page, and bytes of one
FILTER = 1 << 26  # bits of the map of frequent words


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text slice by slice, BREAK where a piece ends; empty strings stand between neighbouring blanks."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > SLICE:
            found = [p for p in (text.find(c, start + SLICE, start + 2 * SLICE) for c in (b" ", b"\t", b"\n", b".", b",")) if p >= 0]
            end = min(found, default=end)
        yield text[start:end].translate(FOLD).replace(BREAK, b" \n ").split(b" ")
        start = end


def hash63(word: bytes, seed: int) -> int:
    return min(xxhash.xxh3_64_intdigest(word, seed) >> 1, (1 << 63) - 3)


def page_hashes(page: list[bytes], seed: int) -> np.ndarray:
    return np.array([hash63(w, seed) for w in page], np.uint64)


class Codes(dict):
    """Word to code. A word that is neither on the page nor in the filter is infrequent, and ends phrases as the end of a piece does."""

    def __init__(self, book: dict, seed: int) -> None:
        super().__init__((w, i) for i, w in enumerate(book["page"]))
        self.update({BREAK: int(STOP), b"": int(SKIP)})
        self.filter, self.seed, self.room = book["filter"], seed, len(self) + FLUSH
        self.hashes = page_hashes(book["page"], seed)

    def __missing__(self, word: bytes) -> int:
        code = hash63(word, self.seed)
        bit = code % FILTER
        code = code | 1 << 63 if int(self.filter[bit >> 5]) >> (bit & 31) & 1 else int(STOP)
        if len(self) < self.room:
            self[word] = code
        return code

    def coded(self, words: list[bytes]) -> np.ndarray:
        codes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return codes[codes != SKIP]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def route_keys(hashes: np.ndarray, lang: bytes) -> np.ndarray:
    """The 64-bit keys of suffixes, of which `hashes` has a row of DEPTH word hashes each (0 behind the last word)."""
    state = np.full(len(hashes), xxhash.xxh3_64_intdigest(lang), np.uint64)
    out = np.zeros(len(hashes), np.uint64)
    for d in range(DEPTH):
        state = mixed(state ^ hashes[:, d])
        out |= (state >> np.uint64(64 - BITS[d])) << np.uint64(LEFT[d])
    return out


def suffixes(codes: np.ndarray, upto: int | None = None) -> np.ndarray:
    """A row of DEPTH codes for each word (of codes[:upto]), STOP from the end of its piece on."""
    padded = np.concatenate([codes, np.full(DEPTH, STOP)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, DEPTH)[:len(codes)][:upto][codes[:upto] != STOP].copy()
    for d in range(1, DEPTH):
        rows[rows[:, d - 1] == STOP, d] = STOP
    return rows


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")

def worker_rows(columns: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


SURVEY = "lang string, word binary, sampled boolean, n long, hash long"


def survey(docs: DataFrame, seed: int) -> DataFrame:
    """Stage table (lang, word, n, hash) of all words, and, with `sampled`, one suffix in EVERY as its words joined by blanks."""
    types = [pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sampled, passed = defaultdict(Counter), [], 0

        def rows() -> pa.RecordBatch:
            found = [(lang, w, False, n, hash63(w, seed)) for lang, c in counts.items() for w, n in c.items() if w and w != BREAK] + sampled
            counts.clear()
            sampled.clear()
            return worker_rows(list(zip(*found)) or [[]] * 5, ["lang", "word", "sampled", "n", "hash"], types)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                for words in tokens(text):
                    counts[lang].update(words)
                    for at in range((-passed) % EVERY, len(words), EVERY):
                        sampled.append((lang, b" ".join(w for w in words[at:at + 4 * DEPTH] if w), True, 1, 0))
                    passed += len(words)
                if sum(map(len, counts.values())) > FLUSH // 4:
                    yield rows()
        yield rows()

    found = texts(docs).mapInArrow(run, SURVEY)
    return cut(found.groupBy("lang", "word", "sampled", "hash").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, floor: int, most_seeds: int = 64) -> tuple[DataFrame, int]:
    """The survey under the first seed by which no frequent word shares its hash with another word."""
    for seed in range(most_seeds):
        found = survey(docs, seed)
        words = found.where("not sampled").groupBy("hash").agg(F.min("word").alias("a"), F.max("word").alias("b"), F.max("n").alias("n"))
        if words.where((F.col("a") != F.col("b")) & (F.col("n") >= floor)).isEmpty():
            return found, seed
        release(found)
    raise ValueError("no seed without collisions")


def code_book(found: DataFrame, floor: int, page: int) -> dict:
    """The most frequent words, by number, and a bit map of the hashes of the other frequent words: what tasks need to code words.

    At most `page` words of PAGE_WORD bytes or less, and FILTER bits.
    """
    frequent = found.where(~F.col("sampled") & (F.col("n") >= floor)).groupBy("word", "hash").agg(F.max("n").alias("n"))
    on_page = frequent.where(F.length("word") <= PAGE_WORD).orderBy(F.desc("n"), "word").limit(page)
    words = [bytes(w) for w in on_page.select("word").toArrow().column("word").to_pylist()]
    bit = F.pmod("hash", F.lit(FILTER))
    slots = frequent.groupBy(F.floor(bit / 32).cast("int").alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {FILTER}) % 32 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER // 32, np.uint32)
    bits[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().astype(np.uint32)
    return {"page": words, "filter": bits}


def hashes_of(codes: np.ndarray, page_hashes: np.ndarray) -> np.ndarray:
    """The hash of each code; 0 for STOP."""
    out = codes & ~HASHED
    paged = codes < HASHED
    out[paged] = page_hashes[codes[paged].astype(np.int64)]
    out[codes == STOP] = 0
    return out


def splitters(found: DataFrame, book, seed: int, every: int = RANGE // EVERY) -> np.ndarray:
    """Sorted route keys that divide the suffixes into ranges of about RANGE, from the sampled ones; the driver gets the splitters alone."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(book.value, seed)
        for batch in batches:
            out = []
            for lang, words, n in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                near = suffixes(codes.coded(words.split(b" ")))[:1]
                if len(near) and words:
                    out += [int((route_keys(hashes_of(near, codes.hashes), lang.encode())[0] ^ HASHED).view(np.int64))] * n
            yield worker_rows([out], ["key"], [pa.int64()])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for batch in batches:
            yield worker_rows([batch.column("key").to_pylist()[(-passed - 1) % every::every]], ["key"], [pa.int64()])
            passed += batch.num_rows

    got = found.where("sampled").mapInArrow(keys, "key long").orderBy("key").mapInArrow(pick, "key long").toArrow().column("key").to_numpy()
    return np.unique(got.view(np.uint64) ^ HASHED)


def packed(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Byte planes, which the shuffle's compression shrinks: most codes are small."""
    return b"".join(np.ascontiguousarray(rows[:, d]).view(np.uint8).reshape(-1, 8).T.tobytes() for d in range(DEPTH)) + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows, counts = [], []
    for block in blocks:
        planes = np.frombuffer(block, np.uint8).reshape(8 * DEPTH + 4, -1)
        rows.append(np.stack([np.ascontiguousarray(planes[8 * d:8 * d + 8].T).view(np.uint64)[:, 0] for d in range(DEPTH)]))
        counts.append(np.ascontiguousarray(planes[8 * DEPTH:].T).view(np.uint32)[:, 0].astype(np.int64))
    return np.concatenate(rows, axis=1), np.concatenate(counts)


def routed(docs: DataFrame, book, seed: int, edges: np.ndarray) -> DataFrame:
    """(part, lang, block): suffixes that start with a frequent word, copies counted once a flush, packed by range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(book.value, seed)
        held: dict[str, list[np.ndarray]] = defaultdict(list)

        def flush(unfinished: str | None) -> pa.RecordBatch:
            out = [[], [], []]
            for lang, arrays in list(held.items()):
                line = np.concatenate(arrays)
                open_end = lang == unfinished
                del held[lang]
                if open_end:
                    held[lang].append(line[1 - DEPTH:])
                rows = suffixes(line, 1 - DEPTH if open_end else None)
                if not len(rows):
                    continue
                keys = route_keys(hashes_of(rows, codes.hashes), lang.encode())
                order = np.argsort(keys)
                rows, keys = rows[order], keys[order]
                new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
                rows, keys, many = rows[new], keys[new], np.diff(np.append(new, len(rows)))
                part = np.searchsorted(edges, keys, side="right")
                for a, b in zip(starts := np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), [*starts[1:], len(part)]):
                    for x, y in zip(out, (int(part[a]), lang, packed(rows[a:b], many[a:b]))):
                        x.append(y)
            return worker_rows(out, ["part", "lang", "block"], [pa.int32(), pa.string(), pa.binary()])

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                for words in tokens(text):
                    held[lang].append(codes.coded(words))
                    size += len(words)
                    if size > FLUSH:
                        yield flush(lang)
                        size = 0
                held[lang].append(np.array([STOP]))
        yield flush(None)

    return texts(docs).mapInArrow(run, "part int, lang string, block binary")


def frequent_prefixes(columns: np.ndarray, counts: np.ndarray, keys: np.ndarray, floor: int, low: int, high: int) -> Iterator[tuple[np.ndarray, int]]:
    """Multikey three-way quicksort of suffix pointers: (codes, count) of each prefix of two words or more that has `floor` suffixes.

    A prefix that the edges of the range (low inclusive, high exclusive) may cut is yielded whatever its count. Parts of at most SMALL
    pointers are sorted by their word directly, and their runs of equal words are the equal parts.
    """
    cut_off = []
    for d in range(DEPTH):
        own = keys >> np.uint64(LEFT[d])
        cut_here = np.zeros(len(keys), bool)
        if low & ((1 << LEFT[d]) - 1):
            cut_here |= own == np.uint64(low >> LEFT[d])
        if high & ((1 << LEFT[d]) - 1):
            cut_here |= own == np.uint64(high >> LEFT[d])
        cut_off.append(cut_here)
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        pointers, d = stack.pop()
        word = columns[d][pointers]
        if len(pointers) <= SMALL:
            order = np.argsort(word)
            pointers, word = pointers[order], word[order]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            totals = np.add.reduceat(counts[pointers], starts)
            ends = np.append(starts[1:], len(pointers))
            stays = ((totals >= floor) | cut_off[d][pointers[starts]]) & (word[starts] != STOP)
            equal = [(pointers[a:b], int(n)) for a, b, n in zip(starts[stays], ends[stays], totals[stays])]
        else:
            some = np.sort(word[:: max(1, len(word) // 9)])
            pivot = some[len(some) // 2]
            for side in (word < pivot, word > pivot):
                part = pointers[side]
                if len(part) and (counts[part].sum() >= floor or cut_off[d][part].any()):
                    stack.append((part, d))
            part = pointers[word == pivot]
            total = int(counts[part].sum())
            equal = [(part, total)] if pivot != STOP and (total >= floor or cut_off[d][part[0]]) else []
        for part, total in equal:
            if d:
                yield columns[:d + 1, part[0]], total
            if d + 1 < DEPTH:
                stack.append((part, d + 1))


def counted(blocks: DataFrame, book, seed: int, edges: np.ndarray, floor: int) -> DataFrame:
    """(lang, codes, a): phrases of 2 to DEPTH words with at least `floor` occurrences."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, lang = key[0].as_py(), key[1].as_py()
        columns, counts = unpacked(table.column("block").to_pylist())
        page = book.value
        hashes = page_hashes(page["page"], seed)
        keys = route_keys(hashes_of(columns.T, hashes), lang.encode())
        low, high = (int(edges[part - 1]) if part else 0), (int(edges[part]) if part < len(edges) else 1 << 64)
        found = list(frequent_prefixes(columns, counts, keys, floor, low, high))
        codes = pa.array([c.view(np.int64).tolist() for c, _ in found], pa.list_(pa.int64()))
        return pa.table([pa.array([lang] * len(found), pa.string()), codes, pa.array([n for _, n in found], pa.int64())], names=["lang", "codes", "a"])

    found = blocks.groupBy("part", "lang").applyInArrow(run, "lang string, codes array<long>, a long")
    return found.groupBy("lang", "codes").agg(F.sum("a").alias("a")).where(F.col("a") >= floor)


def spelled(found: DataFrame, phrases: DataFrame, book: dict, floor: int) -> DataFrame:
    """The phrases' words in place of their codes."""
    spark = found.sparkSession
    on_page = spark.createDataFrame(pa.table([pa.array(book["page"], pa.binary()), pa.array(range(len(book["page"])), pa.int64())], names=["word", "number"]))
    frequent = found.where(~F.col("sampled") & (F.col("n") >= floor)).select("word", "hash").distinct()
    words = frequent.join(on_page, "word", "left").select(
        F.coalesce("number", F.col("hash").bitwiseOR(F.lit(-1 << 63))).alias("code"), F.col("word").cast("string").alias("word"))
    places = phrases.select("lang", "codes", "a", F.posexplode("codes").alias("at", "code")).join(words, "code")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return places.groupBy("lang", "codes", "a").agg(listed.alias("words")).select("lang", "words", "a")


def frequent_phrases(docs: DataFrame, floor: int = 30, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Stage tables (lang, words, a) of all phrases of 1 to DEPTH words with at least `floor` occurrences, and (lang, n) of all words."""
    spark = docs.sparkSession
    found, seed = vocabulary(docs, floor)
    plain = code_book(found, floor, page)
    book = spark.sparkContext.broadcast(plain)
    edges = splitters(found, book, seed)
    phrases = cut(counted(routed(docs, book, seed, edges), book, seed, edges, floor))
    single = found.where(~F.col("sampled") & (F.col("n") >= floor)).select("lang", F.array(F.col("word").cast("string")).alias("words"), F.col("n").alias("a"))
    return cut(single.unionByName(spelled(found, phrases, plain, floor))), found.where("not sampled").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, floor: int = 30, covered: int = 80, page: int = PAGE) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the phrases of two words or more that no longer one covers.

    A phrase is covered if a longer frequent phrase that holds it has `covered` percent of its occurrences. The score is that of the worst cut.
    """
    return scored(frequent_phrases(docs, floor, page)[0], covered)


def scored(known: DataFrame, covered: int) -> DataFrame:
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    text = lambda c: F.array_join(c, " ")
    known = known.select("lang", "words", text(F.col("words")).alias("phrase"), "a")
    several = known.where(F.size("words") > 1)
    k = F.col("k")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", "phrase", "a", "k", text(F.slice("words", F.lit(1), k)).alias("first"), text(F.slice("words", k + 1, F.size("words") - k)).alias("rest"))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("top", F.lit(2_000_000).cast("decimal(8,0)") * wide("a")).withColumn("both", wide("l") + wide("r"))
    worst = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(F.expr("top div both").alias("score"), "k", "l", "r")).alias("w"))
    lengths = F.sequence(F.lit(2), F.size("words") - 1)
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: text(F.slice("words", i, m)))))
    holders = several.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(holders, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < covered * wide("a")))
    return kept.select("lang", "phrase", "a", "w.l", "w.r", F.col("w.score").alias("score"))


def report(docs: DataFrame, top: int = 2000) -> DataFrame:
    """The first `top` collocations of each language, with its number of words."""
    known, sizes = frequent_phrases(docs)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(known, 80).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
