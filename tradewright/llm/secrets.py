"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a table of blobs: which versions of which rules have read
a blob, and what they found. An update reads only the (blob, rule version) pairs that the ledger lacks, each blob once however many paths and
versions hold it, and appends to the ledger; findings are joined back to all paths by address. A new version of one rule reads old blobs with that
rule alone; a repeated update reads nothing.

Matches are leftmost and do not overlap within a rule; those that are too short are dropped. The ledger keeps a match as the characters between it
and the match before, so that reading a blob is one pass without a shuffle; places are the running sums, taken over the blob's own matches only.
Places are code points, ends exclusive.

Defined results: NULL text is an empty text; a blob without findings gives an empty list; rows equal in all columns are paths of their own and each
get the findings; an empty table gives no row; other columns of the input are kept as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewright.llm.common import salted_join
from tradewright.session import stage_dir


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates; those stay whose group `measured` has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    measured: int = 0
    least: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, "[0-9a-f]{32,}", 0, 32),  # whole runs of hexadecimal digits, as `[0-9a-f]+` finds them
)
MORE = (
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    Rule("github", 1, "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40),
)
RULES = BASE + MORE
MATCH = "struct<rule:string,place:int,gap:int,length:int,measured:int>"
LEDGER = f"blob string, rules array<string>, matches array<{MATCH}>"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def new_ledger(spark: SparkSession) -> str:
    """A path for a ledger of its own in the shared folder."""
    return f"{stage_dir(spark)}/stage-ledger-{uuid.uuid4().hex}"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at the path; an empty one is written first if there is none."""
    columns = [F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in LEDGER.split(", ")]
    spark.range(0).select(*columns).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def unseen(versions: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, body, missing): each distinct text that some rule version has not read yet, with those rules.

    Copies meet map-side first, so one text in a third of the rows is one row a task.
    """
    blobs = versions.groupBy(address(F.col("text")).alias("blob")).agg(F.first(F.coalesce("text", F.lit(""))).alias("body"))
    seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    wanted = F.array(*(F.lit(r.id) for r in rules))
    missing = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "body", missing.alias("missing")).where(F.size("missing") > 0)


def matches(body: Column, rule: Rule) -> Column:
    """All candidates of a rule in a text: the characters before each, its own, and those of the measured group."""
    pattern = F.lit(rule.pattern)
    lengths = lambda c: F.transform(c, F.length)
    found = F.arrays_zip(
        F.slice(lengths(F.split(body, rule.pattern, -1)), 1, F.regexp_count(body, pattern)).alias("gap"),
        lengths(F.regexp_extract_all(body, pattern, F.lit(0))).alias("length"),
        lengths(F.regexp_extract_all(body, pattern, F.lit(rule.measured))).alias("measured"))
    listed = F.transform(found, lambda x, i: F.struct(F.lit(rule.id).alias("rule"), i.alias("place"), x["gap"].alias("gap"), x["length"].alias("length"), x["measured"].alias("measured")))
    return F.when(body.rlike(rule.pattern), listed).otherwise(F.array().cast(f"array<{MATCH}>"))


def update(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Reads what the ledger at `path` has not read yet of the texts in column `text`, appends it, and returns the ledger.

    A job that is lost before its end has appended nothing; pairs that two updates read at once are equal and count once.
    """
    spark = versions.sparkSession
    todo = unseen(versions, ledger(spark, path), rules)
    none = F.array().cast(f"array<{MATCH}>")
    read = [F.when(F.array_contains("missing", r.id), matches(F.col("body"), r)).otherwise(none) for r in rules]
    todo.select("blob", F.col("missing").alias("rules"), F.concat(*read).alias("matches")).write.mode("append").parquet(path)
    return ledger(spark, path)


def spans(known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): for each blob with findings its spans (start, place of the rule in `rules`, kind, end), in that order."""
    rows = known.select("blob", F.explode("matches").alias("m")).select("blob", "m.*").dropDuplicates(["blob", "rule", "place"])
    before = Window.partitionBy("blob", "rule").orderBy("place")
    placed = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("length")).over(before)).withColumn("start", F.col("end") - F.col("length"))
    listed = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.id), F.struct(F.lit(i).alias("at"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least")))))
    placed = placed.withColumn("r", F.element_at(listed, F.col("rule"))).where(F.col("r").isNotNull() & (F.col("measured") >= F.col("r.least")))
    span = F.struct("start", F.col("r.at").alias("at"), F.col("r.kind").alias("kind"), "end")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


SPANS = "array<struct<start:bigint,at:int,kind:string,end:bigint>>"


def findings(versions: DataFrame, known: DataFrame, out: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of `versions` without its text, with the spans of its text in column `out`.

    The rows of a blob that very many paths hold are spread over copies of its findings.
    """
    kept = [c for c in versions.columns if c != "text"]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    paths = versions.select(address(F.col("text")).alias("blob"), F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(kept))).alias("path"))
    counts = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("many"))
    found = spans(known, rules).join(counts, "blob")
    joined = salted_join(paths, found, ["blob"], "many", versions.count(), F.rand(12))
    return joined.select(*(F.col(f"path.c{i}").alias(c) for i, c in enumerate(kept)), F.coalesce("spans", F.array().cast(SPANS)).alias(out))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the numbers of base findings, their digest, and all spans as text."""
    versions = docs.select("doc_id", "text")
    found = findings(versions, update(versions, path or new_ledger(docs.sparkSession)))
    base = F.filter("spans", lambda s: s["at"] < len(BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(number(r.kind) for r in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
