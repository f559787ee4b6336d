"""A data sink for finished documents: one file per repository, long ones in numbered volumes.

Every write fills a folder of its own, ``run=<id>``, and becomes visible by one small file that
names it.  A task writes beside and moves a document to its place when it is whole, so a
task that fails or is repeated leaves no part of one; a job that fails leaves nothing.  The
driver handles one message per task, whatever the number of documents.

The module is sent to executors by value; they need pyarrow, but not this package.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "repository_documents"
CURRENT = "_CURRENT"
# File names are limited; longer ones end in a digest.
MAX_NAME = 200


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def folder_name(repo_id: str | None) -> str:
    """A repository's folder: its id, with characters that paths give a meaning escaped."""
    if repo_id == "":
        return "%"
    name = quote("\0" if repo_id is None else repo_id, safe=" -_.~@,()")
    name = name.replace(".", "%2E") if not name.strip(".") else name
    return name if len(name) <= MAX_NAME else f"{name[:MAX_NAME - 41]}~{hashlib.sha1(repo_id.encode()).hexdigest()}"


def current_run(folder: str) -> str | None:
    """The folder of the last finished write."""
    system, base = file_system(folder)
    from pyarrow import fs

    if system.get_file_info(f"{base}/{CURRENT}").type != fs.FileType.File:
        return None
    with system.open_input_file(f"{base}/{CURRENT}") as file:
        return f"{folder.rstrip('/')}/{file.read().decode()}"


@dataclass
class _Written(WriterCommitMessage):
    documents: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.name, self.separator = options["folder"], options["name"], options["separator"].encode()
        self.run = f"run={uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """Rows ``(repo_id, volume, text)``; those of a volume come one after the other."""
        system, base = file_system(self.folder)
        stem, _, suffix = self.name.rpartition(".")
        beside, known, out, documents = f"{base}/{self.run}/_tmp/{uuid.uuid4().hex}", None, None, 0
        system.create_dir(beside, recursive=True)

        def finish() -> None:
            out.close()
            place = f"{base}/{self.run}/{folder_name(known[0])}"
            system.create_dir(place, recursive=True)
            name = self.name if known[1] == 1 else f"{stem}.{known[1]}.{suffix}"
            system.move(f"{beside}/{documents}", f"{place}/{name}")

        for batch in iterator:
            for repo, volume, text in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "volume", "text"))):
                if out is None or (repo, volume) != known:
                    if out is not None:
                        finish()
                        documents += 1
                    known, out = (repo, volume), system.open_output_stream(f"{beside}/{documents}")
                out.write((text or "").encode() + self.separator)
        if out is not None:
            finish()
            documents += 1
        return _Written(documents)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, base = file_system(self.folder)
        system.create_dir(f"{base}/{self.run}", recursive=True)
        if system.get_file_info(f"{base}/{self.run}/_tmp").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.run}/_tmp")
        with system.open_output_stream(f"{base}/{CURRENT}.{self.run}") as file:
            file.write(self.run.encode())
        system.move(f"{base}/{CURRENT}.{self.run}", f"{base}/{CURRENT}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, base = file_system(self.folder)
        if system.get_file_info(f"{base}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.run}")


class RepositoryDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool):
        return _Writer(dict(self.options))
