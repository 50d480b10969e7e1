"""Rows written as files of their own, all or none.

    spark.dataSource.register(Files)
    df.select("name", "content").write.format("named_files").mode("append").save("/out/crops")

Each task writes its files below ``_staging-<job>`` and tells the driver their names; only when all tasks are
done are they moved to their places and ``_SUCCESS`` is written. A task that is killed, or a job that fails, leaves nothing
but staging, which abort clears; a task that runs twice has a folder for each attempt, and only the one that Spark
commits counts. Files are written by Arrow's file systems: a path is local or the URI of a store that those know, and
on a cluster one that all executors share.

Names are relative and may hold folders. A null name or content, a name outside the folder, or one that two rows share,
is an error. Mode ``append`` keeps what is there and refuses to replace a file; ``overwrite`` clears the folder first.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class _Done(WriterCommitMessage):
    """Where a task's files are, and their names."""

    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Done:
        store, base = _store(self.path)
        folder, names = f"{base}/_staging-{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            name, content = row[0], row[1]
            if name is None or content is None:
                raise ValueError("a file needs a name and a content")
            if name.startswith(("/", "_")) or posixpath.normpath(name) != name or name.split("/")[0] == "..":
                raise ValueError(f"not a name of a file here: {name!r}")
            target = f"{folder}/{name}"
            store.create_dir(posixpath.dirname(target), recursive=True)
            with store.open_output_stream(target) as f:
                f.write(bytes(content))
            names.append(name)
        return _Done(folder, names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        names = [n for m in messages if m is not None for n in m.names]
        try:
            if len(set(names)) < len(names):
                raise ValueError("two rows have the same name")
            there = [] if self.overwrite else [i.path for i in store.get_file_info([f"{base}/{n}" for n in names]) if i.type != fs.FileType.NotFound]
            if there:
                raise ValueError(f"a file is there already: {there[0]}")
            if self.overwrite:
                for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                    if posixpath.basename(i.path) != f"_staging-{self.job}":
                        store.delete_dir(i.path) if i.type == fs.FileType.Directory else store.delete_file(i.path)
            for d in sorted({posixpath.dirname(f"{base}/{n}") for n in names}):
                store.create_dir(d, recursive=True)
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda x: store.move(f"{x[0]}/{x[1]}", f"{base}/{x[1]}"), ((m.folder, n) for m in messages if m is not None for n in m.names)))
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/_SUCCESS"):
                pass
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        if store.get_file_info(f"{base}/_staging-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/_staging-{self.job}")


class Files(DataSource):
    """``named_files``: writes (name string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def write_files(df: DataFrame, name: str, content: str, path: str, mode: str = "append") -> None:
    """Each row as a file."""
    df.sparkSession.dataSource.register(Files)
    df.selectExpr(f"`{name}` AS name", f"`{content}` AS content").write.format("named_files").mode(mode).save(path)
