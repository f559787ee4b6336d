"""WARC records as bytes, and a reader that goes on after damage.

Runs in tasks: one archive is written or read as a stream, a record at a time.  A gzip member
may hold any number of records; it is inflated as they are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

VERSION = b"WARC/1.1"
# Marks by which the next record is found.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
NEXT_VERSION = re.compile(rb"\nWARC/1\.[01]\r\n")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
READ = 1 << 20
# Compressed bytes inflated at a time, and records of a member held until its checksum is known.
PIECE, HELD = 1 << 16, 32 << 20
# Digest algorithms that are tested; others are taken on trust.
ALGORITHMS = ("sha1", "sha256", "sha512", "md5")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    """A header value: control characters would end the line."""
    return re.sub(r"[\x00-\x1f\x7f]", " ", str(value))


def page_number(urn: str | None) -> int | None:
    """The page in a record's id, if there is one."""
    value = (urn or "").strip("<>").rpartition(":")[2]
    return int(value) if value.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit if ``payload`` is None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if payload is None else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    headers = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _line(url) if url else "about:blank"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(size)),
    ]
    if payload is None:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", f"<urn:page:{'none' if refers_to is None else refers_to}>"))
    headers.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Buffer:
    """A stream read ahead as far as asked, with the offset of its first byte."""

    def __init__(self, stream):
        self.stream, self.data, self.offset, self.ended = stream, bytearray(), 0, False

    def fill(self, size: int) -> bool:
        while len(self.data) < size and not self.ended:
            more = self.stream.read(max(READ, size - len(self.data)))
            self.ended = not more
            self.data += more
        return len(self.data) >= size

    def drop(self, size: int) -> None:
        del self.data[:size]
        self.offset += size

    def peek(self, at: int, size: int) -> bytes:
        """Bytes further on; what lies before them is not held if the stream can seek."""
        if at + size > len(self.data) and not self.ended and self.stream.seekable():
            here = self.stream.tell()
            self.stream.seek(self.offset + at)
            found = self.stream.read(size)
            self.stream.seek(here)
            return found
        self.fill(at + size)
        return bytes(self.data[at:at + size])


class Damaged(Exception):
    pass


class _Member:
    """The inflated bytes of the gzip member at the start of ``buffer``, as a stream.

    ``used`` counts the compressed bytes taken; ``damage`` says why it ends early.
    """

    def __init__(self, buffer: _Buffer):
        self.buffer, self.unpacker, self.used, self.damage = buffer, zlib.decompressobj(31), 0, ""

    def seekable(self) -> bool:
        return False

    def read(self, _: int) -> bytes:
        while not self.unpacker.eof and not self.damage:
            if not self.buffer.fill(self.used + 1):
                self.damage = "member cut off"
                break
            piece = bytes(self.buffer.data[self.used:self.used + min(READ, PIECE)])
            before = self.unpacker.copy()
            try:
                out = self.unpacker.decompress(piece)
            except zlib.error as error:
                self.damage = f"member: {error}"
                return _readable(before, piece)
            self.used += len(piece) - len(self.unpacker.unused_data)
            if out:
                return out
        return b""


def _readable(unpacker, piece: bytes) -> bytes:
    """What ``piece`` gives before the error in it."""
    out = []
    try:
        for at in range(len(piece)):
            out.append(unpacker.decompress(piece[at:at + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _tested(stated: str | None, data: bytes) -> bool | None:
    """Is ``algorithm:value`` the digest of ``data``?  None if there is none or its algorithm is not known."""
    name, _, value = (stated or "").partition(":")
    if name.lower() not in ALGORITHMS:
        return None
    raw = hashlib.new(name.lower(), data).digest()
    forms = (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())
    value = value.rstrip("=").upper()
    return value in forms if len(value) in map(len, forms) else None


def parse(data: bytes) -> tuple[dict, bytes, int, bool]:
    """``(headers, payload, length, sure)`` of the record at the start of ``data``.

    Its digests are tested; it is ``sure`` if one that covers the payload is of a known algorithm.
    """
    end = data.find(b"\r\n\r\n") if VERSION_LINE.match(data) else -1
    if end < 0:
        raise Damaged("no header")
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if any(name not in headers for name in REQUIRED):
        raise Damaged("header field missing")
    length = headers["content-length"]
    if not length.isdigit():
        raise Damaged("no length")
    stop = end + 4 + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = bytes(data[end + 4:stop])
    by_block = _tested(headers.get("warc-block-digest"), block)
    if by_block is False:
        raise Damaged("block digest")
    payload = block[block.find(b"\r\n\r\n") + 4:] if b"\r\n\r\n" in block else block
    by_payload = _tested(headers.get("warc-payload-digest"), payload) if headers.get("warc-type") == "response" else None
    if by_payload is False:
        raise Damaged("payload digest")
    return headers, payload, stop + 4, bool(by_block or by_payload)


def salvage(stream):
    """Records and gaps of an archive, compressed or not: ``(offset, length, headers, payload, reason)``.

    After a failed check the search goes on one byte further, for the next member or version
    line at which a whole valid record begins; the bytes between are one gap, with the reason.
    Of a damaged member, records before the damage count if a digest proves them; its bytes
    are part of the gap.  The lengths add up to the archive's: of records in one member the
    first has the member's length and the others 0, as has a gap between records of a member.
    """
    buffer, gap, reason, proved, proved_to = _Buffer(stream), None, "", set(), 0
    while buffer.fill(1):
        if buffer.offset >= proved_to:
            proved = set()
        if buffer.fill(3) and buffer.data[:3] == GZIP_MAGIC:
            member = _Member(buffer)
            for batch in _member_records(member):
                if member.damage or not any(headers for headers, _, _ in batch):
                    break
                if gap is not None:
                    yield gap, buffer.offset - gap, None, None, reason
                    gap = None
                for place, row in enumerate(batch):
                    yield buffer.offset, 0 if place else member.used, *row
                buffer.drop(member.used)
                member.used = 0
            else:
                continue
            damage = member.damage or (batch[0][2] if batch else "empty member")
            proved_to = max(proved_to, buffer.offset + member.used)
            for headers, payload, _ in batch:
                if headers and headers["warc-record-id"] not in proved:
                    proved.add(headers["warc-record-id"])
                    yield buffer.offset, 0, headers, payload, ""
        else:
            try:
                headers, payload, used, _ = _plain(buffer)
                damage = "record of a damaged member" if headers["warc-record-id"] in proved else ""  # stored there as it is
            except Damaged as error:
                damage = str(error)
        if damage:
            if gap is None:
                gap, reason = buffer.offset, damage
            buffer.drop(_next_mark(buffer))
            continue
        if gap is not None:
            yield gap, buffer.offset - gap, None, None, reason
            gap = None
        yield buffer.offset, used, headers, payload, ""
        buffer.drop(used)
    if gap is not None:
        yield gap, buffer.offset - gap, None, None, reason


def _member_records(member: _Member):
    """Batches of ``(headers, payload, reason)``, records and gaps (no headers) of a member.

    The last batch comes when the member has ended, and has a record if there is any.  Before
    it, proved records come whenever ``HELD`` bytes have gathered; those that no digest proves
    wait for the member's checksum.
    """
    inner, batch, waiting, size, broken = _Buffer(member), [], [], 0, False
    while inner.fill(1):
        try:
            headers, payload, used, sure = _plain(inner)
        except Damaged as error:
            if not broken:
                batch.append((None, None, f"in a member: {error}"))
            broken = True
            inner.drop(_next_mark(inner))
            if inner.offset > HELD and len(batch) == 1 and not waiting and not batch[0][0]:
                member.damage = "no record in a member"
            continue
        broken = False
        (batch if sure else waiting).append((headers, payload, ""))
        size += used
        inner.drop(used)
        if sure and size > HELD and any(h for h, _, _ in batch[:-1]) and not member.damage:
            yield batch[:-1]
            batch, size = batch[-1:], used
    yield batch if member.damage else batch + waiting


def _plain(buffer: _Buffer) -> tuple[dict, bytes, int, bool]:
    """The uncompressed record at the start of the buffer."""
    buffer.fill(len(VERSION) + 2)
    end = _header_end(buffer) if VERSION_LINE.match(buffer.data) else -1
    found = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,15})\r\n", buffer.data[:end + 2]) if end >= 0 else None
    if not found:
        raise Damaged("no header")
    stop = end + 4 + int(found[1])
    if buffer.peek(stop, 4) != b"\r\n\r\n":  # a wrong length must not make the reader hold what follows
        raise Damaged("record end")
    buffer.fill(stop + 4)
    return parse(bytes(buffer.data[:stop + 4]))


def _header_end(buffer: _Buffer) -> int:
    """Where the blank line after the header begins; -1 if another version line or the end comes first."""
    seen = 1
    while True:
        end = buffer.data.find(b"\r\n\r\n", seen)
        other = NEXT_VERSION.search(buffer.data, seen, end if end >= 0 else len(buffer.data))
        if other or end >= 0:
            return -1 if other else end
        # A mark may be cut by the end of what was read.
        seen = max(seen, len(buffer.data) - len(VERSION) - 3)
        if not buffer.fill(len(buffer.data) + 1):
            return -1


def _next_mark(buffer: _Buffer) -> int:
    """Bytes up to the next place where a record may begin; all that is read if there is none."""
    buffer.fill(READ)
    member_at = buffer.data.find(GZIP_MAGIC, 1)
    version = VERSION_LINE.search(buffer.data, 1)
    marks = [at for at in (member_at, version.start() if version else -1) if at > 0]
    # A mark may be cut by the end of what was read: keep the last bytes for the next look.
    return min(marks) if marks else len(buffer.data) if buffer.ended else max(1, len(buffer.data) - len(VERSION) - 2)
