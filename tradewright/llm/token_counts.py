"""Token counts of texts under a sentencepiece BPE model, without token ids.

No piece of such a model has a space after another character, so a text's tokens are those of its pre-tokens, each of which starts where a
space follows another character. Pieces are counted once per distinct pre-token; documents then join their pre-token frequencies with the
counts and add up. Pre-tokens that occur often are joined by a broadcast of bounded size, the others by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewright.llm.common import cut, extended, utf8

SPACE = "▁"  # the model writes a space like this, and reads it as a space


def pretokens(text: str) -> list[str]:
    """The pieces between which nothing merges, each without the one space it starts with (the model puts one before the text).

    A further space belongs to the next pre-token, which then starts with it; spaces at the end are a pre-token of their own, which is
    empty if there is only one.
    """
    if not text:
        return []
    out, spaces = [], 0
    for part in text.replace(SPACE, " ").split(" "):
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        out.append(" " * (spaces - 1))
    return out


def vocabulary(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, n): how often each pre-token occurs; counted in the tasks first, with at most about `flush` pre-tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in utf8(batch.column("text")):
                seen.update(pretokens(text.decode("utf-8", "replace")))
                if len(seen) > flush:
                    yield emit()
        yield emit()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words that occur at least c times, for the smallest c that at most `most` words reach. The bound holds whatever the data."""
    size = F.floor(F.log2("n") * 8).cast("int")
    tally = sorted(words.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"])  # at most 512 rows
    total, least = 0, 10**6
    for r in tally:
        total += r["count"]
        if total > most:
            break
        least = r["size"]
    return words.where(size >= least)


def counted(words: DataFrame, model_file: str) -> DataFrame:
    @F.pandas_udf("int")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lone = 1 if model.piece_to_id(SPACE) != model.unk_id() else len(SPACE.encode())
        for batch in batches:
            yield pd.Series([len(x) if w else lone for w, x in zip(batch, model.encode(batch.tolist(), num_threads=1))], dtype="int32")

    return words.withColumn("pieces", pieces("word"))


def frequencies(docs: DataFrame) -> DataFrame:
    """A row per document, with its distinct pre-tokens and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            texts = utf8(batch.column("text"))
            while at < len(texts):  # a piece of a batch at a time
                start, size = at, 0
                while at < len(texts) and size < 1 << 21:
                    size += len(texts[at])
                    at += 1
                tallies = [Counter(pretokens(t.decode("utf-8", "replace"))) for t in texts[start:at]]
                offsets = pa.array([0, *pd.Series([len(t) for t in tallies]).cumsum()], pa.int32())
                words = pa.array([w for t in tallies for w in t], pa.string())
                n = pa.array([c for t in tallies for c in t.values()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, at - start), batch.column("tie").slice(start, at - start), batch.column("n_bytes").slice(start, at - start),
                     pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([words, n], ["word", "n"]))],
                    names=["doc_id", "tie", "n_bytes", "words"])

    schema = extended(docs, ["doc_id"], "tie long, n_bytes long, words array<struct<word:string,n:int>>")
    source = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return source.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, broadcast_words: int = 300_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row of docs.

    NULL and empty texts have no bytes and no tokens. Rows that repeat, and rows with the same or no doc_id, each give a row. Texts are
    counted whole, whatever their length; other columns are ignored and an empty table gives no row.
    """
    words = cut(counted(vocabulary(docs), model_file))
    often = frequent(words, broadcast_words).select("word", "pieces")
    pairs = frequencies(docs)
    key = ["doc_id", "tie", "n_bytes"]
    # a row per pre-token of a document and one for the document itself, so that each has a row
    known = pairs.withColumn("words", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("n"))), "words")))
    known = known.select(*key, "words.*").join(F.broadcast(often), "word", "left")
    whole = known.groupBy(*key).agg(F.sum(F.when(F.col("word").isNull(), 1).otherwise(0)).alias("rows"), F.sum(F.col("n").cast("long") * F.coalesce("pieces", F.lit(0))).alias("tokens"))
    rest = pairs.select(*key, F.explode("words").alias("w")).select(*key, "w.*").join(F.broadcast(often.select("word")), "word", "left_anti")
    rest = rest.join(words.select("word", "pieces"), "word").groupBy(*key).agg(F.lit(0).cast("long").alias("rows"), F.sum(F.col("n").cast("long") * F.col("pieces")).alias("tokens"))
    both = whole.unionByName(rest).groupBy(*key).agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
    each = both.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))  # rows that repeat were added up together
    n_tokens = F.expr("tokens div rows")
    return each.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
