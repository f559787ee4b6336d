"""WARC archives: writing with revisits, and a salvage reader that logs what it cannot read.

Writing: digests and lengths are computed where the pages are; pages whose digest occurs
again are found on these small rows.  Only pages whose digest may be repeated take part in
a join, all others are written where they are read.  Every task writes archives under names
of its own attempt and reports them, so what a lost or repeated task left is not read.
Every record is a gzip member of its own.

Reading: one archive is one task's stream, of which a record is held, its header of any length.
A gzip member may hold many records.  After a failed check the reader looks for the next
valid member or version line and goes on; bytes in between are rows of kind ``gap`` with
offset, length and reason.  The readable start of a damaged member is kept as far as digests prove it.

The folder must be reachable by its URI from all executors.

Defined cases: a null page is an empty one; of equal payloads the smallest id is the
response, nulls last; of rows that share id and payload one is the response; a missing URL
is ``about:blank``; a payload under ``min_bytes`` is always a response; an empty table gives
no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import warc_io
from .common import join_facts, map_batches, maybe_member, new_folder, ship, store, text_of

ARCHIVE_BYTES = 64 << 20
READ_SCHEMA = (
    "archive string, offset long, length long, kind string, reason string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)
# The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ship(warc_io)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: each five hexadecimal digits are four characters."""
    digits = F.sha1(payload)
    five = [F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    chars = [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for v in five for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def planned(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per record to write; ``payload`` is null for revisits."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        text_of(html_col).cast("binary").alias("payload"),
    ).withColumns({"size": F.octet_length("payload").cast("long"), "sha1": base32_sha1(F.col("payload"))})
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id"))["page_id"]
    groups = (
        rows.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    )
    groups = store(groups)
    keys = [F.col("sha1"), F.col("size")]
    marked = maybe_member(rows, keys, groups, keys, "_again")
    alone = marked.where("NOT _again").withColumn("refers_to", F.lit(None).cast("long")).drop("_again")
    # Which of the others are revisits is decided without their payloads.
    again = store(marked.where("_again").select("page_id", "url", "size", "sha1"))
    known = join_facts(again, groups, ["sha1", "size"], "n")
    leads = F.col("n").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    leading = known.where(leads & F.col("n").isNotNull())
    # Rows that share id and payload with the first: all but one are revisits too.
    place = F.row_number().over(W.partitionBy("sha1", "size").orderBy("url"))
    extra = leading.withColumn("_place", place).where("_place > 1").drop("_place")
    revisits = known.where(~leads).unionByName(extra)
    revisits = revisits.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "size", "sha1", F.col("first").alias("refers_to"))
    # Payloads are moved for responses only.
    responses = store(known.where(leads).select("sha1", "size", F.col("page_id").alias("_response")).distinct())
    of_row, of_response = [*keys, F.col("page_id")], [*keys, F.col("_response")]
    whole = maybe_member(marked.where("_again").drop("_again"), of_row, responses, of_response, "_first").where("_first")
    same = (whole["sha1"] == responses["sha1"]) & (whole["size"] == responses["size"]) & whole["page_id"].eqNullSafe(responses["_response"])
    whole = whole.join(responses, same, "left_semi").dropDuplicates(["sha1", "size"])
    return alone.unionByName(
        whole.select("page_id", "url", "payload", "size", "sha1", F.lit(None).cast("long").alias("refers_to"))
    ).unionByName(revisits)


def _writer(folder: str, archive_bytes: int):
    def run(batches):
        from pyarrow.fs import FileSystem

        files, base = FileSystem.from_uri(folder)
        out, path, size, count, done = None, "", 0, 0, []

        def close():
            out.close()
            done.append((path, size, count))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                data = warc_io.member(warc_io.record(row["page_id"], row["url"], row["payload"], row["size"], row["sha1"], row["refers_to"]))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        names = [p.rsplit("/", 1)[1] for p, _, _ in done]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n}" for n in names], type=pa.string()), *[pa.array([d[i] for d in done], type=pa.int64()) for i in (1, 2)]],
            names=["archive", "bytes", "records"],
        )

    return run


def write_archives(records: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives and return their list ``(archive, bytes, records)``, a stored table."""
    from pyarrow.fs import FileSystem

    folder = folder or new_folder(records.sparkSession)
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    files, base = FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    written = map_batches(records.select("page_id", "url", "payload", "size", "sha1", "refers_to"), _writer(folder, archive_bytes), "archive string, bytes long, records long")
    return store(written)


def _reader(with_payload: bool):
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in READ_SCHEMA.split(", ")])

    def row(archive, offset, length, headers, payload, reason):
        if headers is None:
            return [archive, offset, length, "gap", reason, None, None, None, None, None, None]
        kind, stated = headers.get("warc-type", ""), headers.get("x-payload-length", "")
        size = len(payload) if kind == "response" else int(stated) if stated.isdigit() else None
        sha1 = warc_io.digest(payload) if kind == "response" else headers.get("warc-payload-digest", "").removeprefix("sha1:")
        refers = warc_io.page_number(headers.get("warc-refers-to")) if kind == "revisit" else None
        return [
            archive, offset, length, kind, "", warc_io.page_number(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, sha1, refers,
            payload if with_payload else None,
        ]

    def run(batches):
        from pyarrow.fs import FileSystem

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = FileSystem.from_uri(archive)
                rows, held = [], 0
                with files.open_input_file(path) as stream:
                    for found in warc_io.salvage(stream):
                        rows.append(row(archive, *found))
                        held += len(found[3] or b"") if with_payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    return run


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records and gaps of ``archives(archive)``, ``READ_SCHEMA``; archives are dealt out evenly."""
    paths = archives.select("archive")
    dealt = paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism * 4))
    return map_batches(dealt, _reader(with_payload), READ_SCHEMA)
