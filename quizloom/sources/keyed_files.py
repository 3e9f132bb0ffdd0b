"""A sink that writes one file for each row, named by its key, and shows none of them before all tasks have ended.

    spark.dataSource.register(KeyedFiles)
    decks.selectExpr("deck_key AS key", "deck AS content").write.format("keyedfiles").option("suffix", ".json").mode("append").save(path)

Tasks write into a folder of their own attempt; the commit moves the files of those attempts that the job counts, and marks the
folder as whole (`_SUCCESS`) at the end. A job that fails leaves the folder as it was, but for a hidden folder (`_pending-...`) if
one of its tasks goes on writing after the job is aborted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

KEY = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9._-]{0,199}")


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str] = field(default_factory=list)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.pending = f"{self.path}/_pending-{uuid.uuid4().hex}"

    def _store(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """Each row is written as it comes; a key that is no plain file name, or comes twice in a task, fails the task."""
        store, at = self._store(f"{self.pending}/{TaskContext.get().taskAttemptId()}")
        done = _Written(at)
        store.create_dir(at, recursive=True)
        seen = set()
        for row in iterator:
            key, content = row["key"], row["content"]
            if key is None or not KEY.fullmatch(key) or key in seen:
                raise ValueError(f"not a key of one file: {key!r}")
            seen.add(key)
            with store.open_output_stream(f"{at}/{key}{self.suffix}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            done.names.append(f"{key}{self.suffix}")
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Keys that two tasks have written fail the job before a file is moved. Files of these names that stood there before
        are replaced; with mode overwrite the others of this suffix go."""
        store, at = self._store(self.path)
        written = [m for m in messages if m is not None]
        names = [n for m in written for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a key has several rows")
        if self.overwrite:
            keep = set(names)
            for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and f.base_name not in keep:
                    store.delete_file(f.path)
        for m in written:
            for name in m.names:
                store.move(f"{m.folder}/{name}", f"{at}/{name}")
        self._drop_pending()
        store.open_output_stream(f"{at}/_SUCCESS").close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop_pending()

    def _drop_pending(self) -> None:
        store, at = self._store(self.pending)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class KeyedFiles(DataSource):
    """Format `keyedfiles`: rows of key (string) and content (string or binary). Options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return "keyedfiles"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"key", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"no column {' and '.join(sorted(missing))}")
        return _Writer(self.options["path"], self.options.get("suffix", ""), overwrite)
