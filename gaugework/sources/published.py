"""Create-once publication that survives lost tasks, killed drivers and writers at the same time.

Rows are staged by an ordinary Spark write in a hidden folder, where no reader looks.  A publication is one manifest
with the next number, ``_commits/<n>.json``, which names the staged folder; it is made in one step that fails if the
number is taken.  A writer that finds it taken compares its records with the newer publications and tries again, so
keys stay unique however writers overlap.  Files of a publication then move to the table's own folder; a writer that
dies in between leaves that to whoever comes next.  What was staged without a manifest is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.sources.evidence import append_once

COMMITS, STAGED = "_commits", "_staged"


class PublishedTable:
    """The files of a table below ``path``, through the file system that the path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._system = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._system.listStatus(at)] if self._system.exists(at) else []

    def commits(self) -> list[dict]:
        """Manifests in order."""
        numbers = sorted(int(n[:-5]) for n in self._names(COMMITS) if n.endswith(".json") and n[:-5].isdigit())
        return [self._read(number) for number in numbers]

    def _read(self, number: int) -> dict:
        stream = self._system.open(self._at(f"{COMMITS}/{number:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def stage(self, rows: DataFrame) -> str:
        """Write rows where no reader looks; the folder's name."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{STAGED}/{name}")
        return name

    def drop_staged(self, name: str) -> None:
        self._system.delete(self._at(f"{STAGED}/{name}"), True)

    def commit(self, number: int, staged: str) -> bool:
        """Publish a staged folder as number ``number``; False if another publication has the number."""
        files = [n for n in self._names(f"{STAGED}/{staged}") if n.endswith(".parquet")]
        body = json.dumps({"number": number, "staged": staged, "files": sorted(files)}).encode()
        self._system.mkdirs(self._at(COMMITS))
        draft, final = self._at(f"{COMMITS}/.{uuid.uuid4().hex}"), self._at(f"{COMMITS}/{number:09d}.json")
        stream = self._system.create(draft, False)
        try:
            stream.write(body)
        finally:
            stream.close()
        try:
            return self._link(draft, final)
        finally:
            self._system.delete(draft, False)

    def _link(self, draft, final) -> bool:
        """Give the draft its final name unless it is taken, in one step of the file system."""
        jvm = self.spark._jvm
        try:
            if self._system.getUri().getScheme() == "file":
                paths = [jvm.java.nio.file.Path.of(self._system.makeQualified(p).toUri()) for p in (final, draft)]
                jvm.java.nio.file.Files.createLink(*paths)
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system.getUri())
                context.rename(self._system.makeQualified(draft), self._system.makeQualified(final), options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def settle(self) -> None:
        """Move files of publications from their staged folders to the table's own."""
        staged = set(self._names(STAGED))
        for commit in self.commits():
            if commit["staged"] not in staged:
                continue
            for name in commit["files"]:
                source, target = self._at(f"{STAGED}/{commit['staged']}/{name}"), self._at(name)
                if self._system.exists(source) and not self._system.exists(target):
                    self._system.rename(source, target)
            self.drop_staged(commit["staged"])

    def read(self, commits: list[dict], schema) -> DataFrame:
        """Rows of the publications named, wherever their files are."""
        settled = set(self._names(""))
        files = [
            f"{self.path}/{name}" if name in settled else f"{self.path}/{STAGED}/{commit['staged']}/{name}"
            for commit in commits for name in commit["files"]
        ]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*files)


def publish_once(
    spark: SparkSession, new: DataFrame, path: str, key: Sequence[str], digest: str = "digest", attempts: int = 20
) -> DataFrame:
    """Publish the records whose key is absent; returns the labels of ``append_once`` against what was there.

    ``new`` is computed again whenever another writer was faster, at most ``attempts`` times.
    """
    table = PublishedTable(spark, path)
    for _ in range(attempts):
        table.settle()
        commits = table.commits()
        existing = table.read(commits, new.schema)
        labels = append_once(new, existing, key, digest)
        fresh = new.dropDuplicates([*key, digest]).join(
            labels.filter(F.col("action") == "append").select(*key), list(key), "left_semi"
        )
        try:
            staged = table.stage(fresh.select(*new.columns))
        except Exception as error:
            if any(code in str(error) for code in ("FILE_NOT_EXIST", "PATH_NOT_FOUND", "FileNotFoundException")):
                continue  # another writer has just moved files that were to be read
            raise
        number = commits[-1]["number"] + 1 if commits else 1
        try:
            published = table.commit(number, staged)
        except BaseException:
            # The manifest may be there although its writer was interrupted.
            if staged not in {c["staged"] for c in table.commits()}:
                table.drop_staged(staged)
            raise
        if published:
            table.settle()
            return append_once(new, table.read(commits, new.schema), key, digest)
        table.drop_staged(staged)
    raise RuntimeError(f"{path}: other writers were faster {attempts} times")


def read_published(spark: SparkSession, path: str, schema) -> DataFrame:
    """All published records, also those of a writer that died before it moved its files."""
    table = PublishedTable(spark, path)
    return table.read(table.commits(), schema)
