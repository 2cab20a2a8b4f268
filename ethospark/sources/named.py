"""Files under names of their own, each from one row: a data source that only writes.

``spark.dataSource.register(NamedFiles)``, then ``rows.write.format("named_files").mode("append").save(folder)`` with rows
(name, content): ``name`` is a path below the folder, content its bytes. Tasks write to a staging folder beside the files; the
commit moves what the tasks that counted have written into place, some at a time, and an abort or a task that fails leaves
nothing, as staging goes with the job. Files that are there already are replaced; ``overwrite`` also removes the folder's other files.

Rows with equal names in one job are an error, as neither can be kept. Names may not be empty, absolute or lead out of the folder.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .frames import AT_ONCE, _place

STAGING, TRIES = "_staging", 20


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, by their names, and what their staged ones begin with."""

    staged: str
    names: list[str]


class Writer(DataSourceWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        if schema.fieldNames() != ["name", "content"]:
            raise ValueError("named files are made of rows (name, content)")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"{self.path}/{STAGING}-{uuid.uuid4().hex}"
        # made here only, so that a task which is still being stopped after an abort finds no folder to write to
        store, inner = _place(self.staging)
        store.create_dir(inner, recursive=True)

    def write(self, iterator):
        context = TaskContext.get()
        staged = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}-"
        store, inner = _place(staged)
        names: list[str] = []
        made: set[str] = set()
        for i, row in enumerate(iterator):
            name = posixpath.normpath(row["name"] or "")
            if name in (".", "") or name.startswith(("/", "../")) or name == "..":
                raise ValueError(f"not a name below the folder: {row['name']!r}")
            if name in made:
                raise ValueError(f"two rows for the file {name}")
            content = row["content"]
            with store.open_output_stream(f"{inner}{i}") as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            names.append(name)
            made.add(name)
        return Written(staged, names)

    def commit(self, messages):
        store, inner = _place(self.path)
        _, staging = _place(self.staging)
        try:
            done = [m for m in messages if m is not None]
            names = [name for m in done for name in m.names]
            if len(set(names)) < len(names):
                raise ValueError("two rows for one file: " + next(n for i, n in enumerate(sorted(names)) if i and sorted(names)[i - 1] == n))
            for folder in {posixpath.dirname(n) for n in names} - {""}:
                store.create_dir(f"{inner}/{folder}", recursive=True)
            with ThreadPoolExecutor(AT_ONCE) as pool:
                moves = [(f"{_place(m.staged)[1]}{i}", f"{inner}/{name}") for m in done for i, name in enumerate(m.names)]
                list(pool.map(lambda move: store.move(*move), moves))
            if self.overwrite:
                self._remove_others(store, inner, staging, set(names))
        finally:
            self._clean(store, staging)

    def _remove_others(self, store, inner: str, staging: str, names: set[str]) -> None:
        from pyarrow import fs

        for f in store.get_file_info(fs.FileSelector(inner, recursive=True)):
            if f.type == fs.FileType.File and not f.path.startswith(staging) and posixpath.relpath(f.path, inner) not in names:
                store.delete_file(f.path)

    def _clean(self, store, staging: str) -> None:
        from pyarrow import fs

        for left in reversed(range(TRIES)):
            try:
                if store.get_file_info(staging).type == fs.FileType.Directory:
                    store.delete_dir(staging)
                return
            except OSError:  # a task that is being stopped has just written a file
                if not left:
                    raise
                time.sleep(0.2)

    def abort(self, messages):
        store, staging = _place(self.staging)
        self._clean(store, staging)


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool):
        return Writer(self.options, schema, overwrite)
