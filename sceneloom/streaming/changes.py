"""Scenes as a stream of changes: a file that is edited is scanned again, and its tokens replace those of its last version.

The source looks at a folder and, with each batch, hands out the files that are new, changed or gone since the last one. State by scene knows each scene's last version and the digest of its
content, so that a file written again with the same content changes nothing. The sink has the tokens of each batch in a folder of its own and a log of versions; what counts is, of each scene,
the tokens of its last version. A batch that is tried again overwrites its own folders, so each change counts once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scanner

FILE = "scene_name string, version long, content string"
#: replaces is the version before, null for a new scene; content is null for one that is gone.
CHANGE = "version long, replaces long, content string"


class ChangedFile(InputPartition):
    def __init__(self, path: str, version: int):
        self.path, self.version = path, version


class ChangedScenes(DataSource):
    """Format changed_scenes, option path: a folder that driver and executors share, with a file <name>.txt for each scene.

    Rows (scene_name, version, content): version is the time of the change in nanoseconds, content null for a file that is gone.
    """

    @classmethod
    def name(cls) -> str:
        return "changed_scenes"

    def schema(self) -> str:
        return FILE

    def streamReader(self, schema) -> FolderReader:  # noqa: N802
        return FolderReader(self.options["path"])


class FolderReader(DataSourceStreamReader):
    """Offsets are what the folder held: for each file the time of its last change and its size."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        found = {}
        for path in sorted(Path(self.path).glob("*.txt")):
            try:
                stat = path.stat()
            except FileNotFoundError:  # gone meanwhile
                continue
            found[path.name] = [stat.st_mtime_ns, stat.st_size]
        return {"files": json.dumps(found)}

    def partitions(self, start: dict, end: dict) -> list[ChangedFile]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        gone = [ChangedFile(name, -before[name][0]) for name in before if name not in now]
        return [ChangedFile(name, now[name][0]) for name in now if before.get(name) != now[name]] + gone

    def read(self, partition: ChangedFile) -> Iterator[tuple[str, int, str | None]]:
        name, version, content = partition.path.removesuffix(".txt"), partition.version, None
        if version > 0:
            try:
                content = (Path(self.path) / partition.path).read_bytes().decode("utf-8", "replace")
            except FileNotFoundError:
                return  # the next batch says that it is gone
        yield name, abs(version) + (content is None), content


def changes(files: DataFrame) -> DataFrame:
    """From a stream of FILE rows, a stream of rows (scene_name, version, replaces, content) of real changes, the last one of a scene in a batch."""

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("version")
        known = state.get if state.exists else (None, None)
        version, content = int(rows.version.iloc[-1]), rows.content.iloc[-1]
        digest = None if content is None else hashlib.sha256(content.encode()).hexdigest()
        if digest != known[1]:
            yield pd.DataFrame({"scene_name": [key[0]], "version": [version], "replaces": pd.array([known[0]], "Int64"), "content": [content]})
            state.update((version, digest))

    return files.groupBy("scene_name").applyInPandasWithState(of, f"scene_name string, {CHANGE}", "version long, digest string", "append", GroupStateTimeout.NoTimeout)


def replace_tokens(folder: str, semantics: str = "observed"):
    """For foreachBatch: scans the changed scenes of a batch and puts their tokens, and a log of their versions, in folders of the batch."""

    def of(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            tokens = scanner.scan(batch.filter("content is not null"), semantics).join(batch.select("scene_name", "version"), "scene_name")
            tokens.write.mode("overwrite").parquet(f"{folder}/tokens/batch={number}")
            batch.select("scene_name", "version", "replaces", F.col("content").isNull().alias("gone")).write.mode("overwrite").parquet(f"{folder}/versions/batch={number}")
        finally:
            batch.unpersist()

    return of


def keep_scanned(spark: SparkSession, scripts: str, folder: str, semantics: str = "observed"):
    """A started query that keeps the tokens of the scripts in a folder up to date: see current_tokens()."""
    spark.dataSource.register(ChangedScenes)
    files = spark.readStream.format("changed_scenes").option("path", scripts).load()
    return changes(files).writeStream.foreachBatch(replace_tokens(folder, semantics)).option("checkpointLocation", f"{folder}/state").start()


def current_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of each scene's last version, in the columns of TOKEN; none of scenes that are gone."""
    versions = spark.read.parquet(f"{folder}/versions")
    last = F.row_number().over(Window.partitionBy("scene_name").orderBy(F.col("version").desc()))
    versions = versions.withColumn("last", last).filter("last = 1 and not gone").select("scene_name", "version")
    return spark.read.parquet(f"{folder}/tokens").join(versions, ["scene_name", "version"]).select(*scanner.TOKEN.fieldNames())
