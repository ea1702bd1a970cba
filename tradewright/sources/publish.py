"""Publishing of report tables: a set of tables becomes readable at once, by one manifest, and "latest" moves only when told to.

Each table is written to a folder of its own that nothing points to yet. The manifest, which names all of them, is written last and never
changed; until it is there, readers see the sets published before, however far the writing has come. Promoting a version adds a numbered
pointer; the highest one is the latest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _write_once(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole, under its name, or not at all; an existing one is never replaced."""
    final, fs = _files(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{final.getParent().getParent()}/.writing/{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(part, final):
        fs.delete(part, False)
        raise FileExistsError(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes the tables and then the manifest of `version`. A version is published once; a run that broke off is simply run again."""
    if f"{version}.json" in _names(spark, f"{root}/manifests"):
        raise FileExistsError(f"{version} is published already")
    folders = {name: f"{root}/tables/{name}/{version}-{uuid.uuid4().hex}" for name in tables}
    for name, rows in tables.items():
        rows.write.parquet(folders[name])
    _write_once(spark, f"{root}/manifests/{version}.json", json.dumps(folders, sort_keys=True))


def versions(spark: SparkSession, root: str) -> list[str]:
    return [n.removesuffix(".json") for n in _names(spark, f"{root}/manifests") if n.endswith(".json")]


def promote(spark: SparkSession, root: str, version: str) -> None:
    """Only this moves the latest set. Of two who promote at once, one is told so."""
    if version not in versions(spark, root):
        raise LookupError(f"{version} is not published")
    steps = _names(spark, f"{root}/latest")
    number = int(steps[-1].split("-", 1)[0]) + 1 if steps else 1
    _write_once(spark, f"{root}/latest/{number:012d}-", version)


def latest(spark: SparkSession, root: str) -> str | None:
    steps = _names(spark, f"{root}/latest")
    return spark.read.text(f"{root}/latest/{steps[-1]}").first()[0] if steps else None


def read(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, of the latest one if none is named."""
    version = latest(spark, root) if version is None else version
    if version not in versions(spark, root):
        raise LookupError(f"{root}: no version {version}")
    folders = json.loads(spark.read.text(f"{root}/manifests/{version}.json", wholetext=True).first()[0])
    return {name: spark.read.parquet(folder) for name, folder in folders.items()}
