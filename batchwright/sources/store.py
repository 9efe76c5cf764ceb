"""Versioned tables: a commit writes the next states beside the old ones and then adds one entry to a log.

Parquet has no row operations, so a table is a folder of version folders. ``_log`` has a file for each commit, named by
its number: a line of JSON that gives the version in use of every table of the store. An entry is written under another
name and then renamed to its own, which fails if there is one already; so a commit of several tables happens as a whole
or not at all, no reader meets a half-written entry, and of two commits planned on one state the second is refused (or,
if they change other tables, goes after the first). That holds where the file system renames files atomically (HDFS and
the like, not a plain object store without a commit service). A writer that dies before the rename leaves files that no
entry names.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from batchwright.functions.failures import is_transient
from batchwright.options import Retry

log = logging.getLogger("batchwright")


class VersionConflict(RuntimeError):
    """Another commit came first."""


def with_retry(action: Callable[[], object], retry: Retry | None, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """The action's result and how often it was tried again. Only errors that may pass are tried again."""
    test, pause, tries = (retry.is_transient if retry and retry.is_transient else is_transient), retry.initial_delay if retry else 0, 0
    while True:
        try:
            return action(), tries
        except Exception as error:
            if retry is None or tries >= retry.max_retries or not test(error):
                raise
            tries += 1
            log.warning("attempt %d failed, trying again in %.1f s: %s", tries, pause, error)
            sleep(pause)
            pause *= retry.backoff


@dataclass
class Store:
    """Tables under one folder that every executor reaches."""

    spark: SparkSession
    folder: str

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder.rstrip("/"), *parts])

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> int:
        """The number of the last commit; 0 before the first."""
        where, files = self._hadoop(self._path("_log"))
        if not files.exists(where):
            return 0
        names = (s.getPath().getName() for s in files.listStatus(where))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def versions(self, commit: int | None = None) -> dict[str, str]:
        """The version in use of every table, after ``commit`` (the last one)."""
        commit = self.commits() if commit is None else commit
        if not commit:
            return {}
        where, files = self._hadoop(self._path("_log", f"{commit:012d}.json"))
        stream = files.open(where)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def version(self, table: str) -> str | None:
        """The version in use; None for a table that was never committed."""
        return self.versions().get(table)

    def read(self, table: str, version: str | None = None) -> DataFrame:
        version = version or self.version(table)
        if version is None:
            raise LookupError(f"{table} has no version yet")
        return self.spark.read.parquet(self._path(table, version))

    def _enter(self, number: int, versions: dict[str, str]) -> bool:
        """Write the log's entry of this number, unless there is one."""
        jvm = self.spark.sparkContext._jvm
        draft, files = self._hadoop(self._path("_log", f"_draft-{uuid.uuid4().hex}"))
        files.mkdirs(draft.getParent())
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        stream.close()
        place = jvm.org.apache.hadoop.fs.Path(self._path("_log", f"{number:012d}.json"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else jvm.java.io.File("/").toURI(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, place, options)
            return True
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise

    def commit(self, state: dict[str, DataFrame], planned_on: dict[str, str | None] | None = None, retry: Retry | None = None) -> int:
        """Write the next state of every table and use all of them at once; return the number of retries. Refused if a
        table in ``planned_on`` (those that were read, too) has another version by now."""
        written, retries = {}, 0
        for table, df in state.items():
            written[table] = f"v-{uuid.uuid4().hex}"
            retries += with_retry(lambda df=df, t=table: df.write.mode("overwrite").parquet(self._path(t, written[t])), retry)[1]
        while True:
            last = self.commits()
            now = self.versions(last)
            for table, version in (planned_on or {}).items():
                if now.get(table) != version:
                    raise VersionConflict(f"{table} was changed by another commit")
            entered, again = with_retry(lambda n=last + 1, v={**now, **written}: self._enter(n, v), retry)
            retries += again
            if entered:
                log.info("commit %d: %s", last + 1, ", ".join(sorted(written)))
                return retries
