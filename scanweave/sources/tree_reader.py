"""A data source over a directory tree: reads the files that a stored listing names.

The module is sent to executors by value; they need pyarrow, but not this package.  Planning
reads the footers of the listing's part files, never the tree or the listing's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Bytes of content in one batch, unless a file has more.
BATCH_BYTES = 4 << 20
SCHEMA = "repo_id string, path string, content binary, size bigint, modified timestamp, taken timestamp, gone boolean, version bigint"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def finished_versions(log: str) -> list[int]:
    """Numbers of the listings in ``log`` that were written to the end."""
    from pyarrow import fs

    system, base = file_system(log)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    named = {int(i.base_name.partition("=")[2]): i.path for i in found if i.base_name.startswith("version=")}
    done = {n: system.get_file_info(f"{path}/_SUCCESS").type == fs.FileType.File for n, path in named.items()}
    return sorted(n for n, ok in done.items() if ok)


class RowGroup(InputPartition):
    """Rows of a listing that one task reads: one row group of one part file."""

    def __init__(self, file: str, group: int, version: int):
        self.file, self.group, self.version = file, group, version


def row_groups(log: str, version: int) -> list[RowGroup]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = file_system(log)
    listed = system.get_file_info(fs.FileSelector(f"{base}/version={version}"))
    parts = []
    for info in sorted((i for i in listed if i.base_name.endswith(".parquet")), key=lambda i: i.path):
        with system.open_input_file(info.path) as file:
            footer = pq.ParquetFile(file).metadata
        parts += [RowGroup(info.path, g, version) for g in range(footer.num_row_groups) if footer.row_group(g).num_rows]
    return parts


class _Reader:
    def __init__(self, options: dict):
        self.root, self.log = options["root"], options["log"]
        self.max_bytes = int(options["maxbytes"]) if options.get("maxbytes") else None

    def read(self, part: RowGroup) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, _ = file_system(self.log)
        tree, base = file_system(self.root)
        with system.open_input_file(part.file) as file:
            listing = pq.ParquetFile(file).read_row_group(part.group)
        if "taken" not in listing.column_names:  # a listing that is no snapshot
            listing = listing.append_column("taken", listing["modified"])
        names = ["repo_id", "path", "content", "size", "modified", "taken", "gone", "version"]

        def batch(low: int, high: int, contents: list):
            rows = listing.slice(low, high - low)
            times = [rows[c].cast(pa.timestamp("us", tz="UTC")) for c in ("modified", "taken")]
            columns = [rows["repo_id"], rows["path"], pa.array(contents, pa.binary()), rows["size"], *times, rows["gone"]]
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part.version] * (high - low), pa.int64())], names)

        def content(repo: str, path: str, size: int, gone: bool) -> bytes | None:
            if gone or self.max_bytes is not None and size > self.max_bytes:
                return None
            try:
                with tree.open_input_stream("/".join((base.rstrip("/"), repo, path))) as stream:
                    return stream.read()
            except OSError:  # gone since, or not ours to read
                return None

        low, held, contents = 0, 0, []
        wanted = zip(*(listing[c].to_pylist() for c in ("repo_id", "path", "size", "gone")))
        for row in wanted:
            contents.append(content(*row))
            held += len(contents[-1] or b"")
            if held >= BATCH_BYTES:
                yield batch(low, low + len(contents), contents)
                low, held, contents = low + len(contents), 0, []
        if contents:
            yield batch(low, low + len(contents), contents)


class TreeReader(_Reader, DataSourceReader):
    """One listing, whole: option ``version``, or the last one."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.version = options.get("version")

    def partitions(self):
        version = int(self.version) if self.version else max(finished_versions(self.log))
        # A source without partitions is read once all the same.
        return row_groups(self.log, version) or [RowGroup("", 0, version)]

    def read(self, part: RowGroup) -> Iterator:
        return super().read(part) if part.file else iter(())


class TreeStreamReader(_Reader, DataSourceStreamReader):
    """Listings of changes as they are finished; an offset is the number of the last one taken."""

    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        return {"version": max(finished_versions(self.log), default=-1)}

    def partitions(self, start: dict, end: dict):
        return [g for v in finished_versions(self.log) if start["version"] < v <= end["version"] for g in row_groups(self.log, v)]

    def commit(self, end: dict) -> None:
        pass


class RepositoryFiles(DataSource):
    """``spark.read`` or ``readStream`` with options ``root``, ``log`` and ``maxBytes``."""

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader({k.lower(): v for k, v in self.options.items()})


def lister(root: str, skip: list[str], budget: int):
    """Batches of directories become what is in them, ``budget`` entries per batch and then what is left to list.

    An entry ``(repo_id, path, is_dir, size, modified)`` with ``is_dir`` is a directory still to be listed.
    """

    def run(batches):
        import os

        import pandas
        from pyarrow import fs

        system, base = file_system(root)
        local, skipped = isinstance(system, fs.LocalFileSystem), set(skip)
        columns = ["repo_id", "path", "is_dir", "size", "modified"]

        def children(repo: str, path: str):
            try:
                entries = system.get_file_info(fs.FileSelector("/".join(p for p in (base.rstrip("/"), repo, path) if p)))
            except OSError:  # gone, or not ours to read
                return
            for entry in entries:
                name, is_dir = entry.base_name, entry.type == fs.FileType.Directory
                if entry.type == fs.FileType.NotFound or local and os.path.islink(entry.path):
                    continue
                hidden = name.startswith(".") and name not in (".github", ".gitlab")
                if is_dir and repo and skipped and (name in skipped or hidden):
                    continue
                where = (name, "") if not repo else (repo, f"{path}/{name}" if path else name)
                if repo or is_dir:  # a file beside the repositories belongs to none
                    yield *where, is_dir, entry.size or 0, entry.mtime_ns // 1000 if entry.mtime_ns else 0

        for batch in batches:
            todo = [(r, p) for r, p in zip(batch["repo_id"], batch["path"])]
            out, listed = [], 0
            while todo:
                if listed >= budget:
                    out.extend((r, p, True, 0, 0) for r, p in todo)
                    break
                for entry in children(*todo.pop()):
                    listed += 1
                    if entry[2] and entry[0] and listed < budget:
                        todo.append(entry[:2])
                    else:
                        out.append(entry)
                    if len(out) >= 10_000:
                        yield pandas.DataFrame(out, columns=columns)
                        out = []
            yield pandas.DataFrame(out, columns=columns)

    return run


def tree_writer(root: str):
    """Write rows ``(repo_id, path, content)`` as files; a file written twice is written anew.  Passes on the count."""

    def run(batches):
        import pandas

        system, base = file_system(root)
        made = set()
        for batch in batches:
            for repo, path, content in zip(batch["repo_id"], batch["path"], batch["content"]):
                where = "/".join((base.rstrip("/"), repo, path))
                folder = where.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder)
                    made.add(folder)
                with system.open_output_stream(where) as stream:
                    stream.write((content or "").encode())
            yield pandas.DataFrame({"n": [len(batch)]})

    return run

