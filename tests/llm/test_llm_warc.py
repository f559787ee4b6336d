import base64
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

from scanweave.llm import warc, warc_io


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least=0):
    groups = defaultdict(list)
    for number, _, html in rows:
        groups[(html or "").encode()].append(number)
    out = Counter()
    for payload, numbers in groups.items():
        numbers.sort(key=lambda v: (v is None, v or 0))
        for place, number in enumerate(numbers):
            again = place > 0 and len(payload) >= least
            out[(number, len(payload), sha1(payload), "revisit" if again else "response", numbers[0] if again else None)] += 1
    return out


def read_back(pages, **options):
    records = warc.read_archives(warc.write_archives(warc.planned(pages, **options), archive_bytes=2000), with_payload=True).collect()
    for r in records:
        assert r.kind in ("response", "revisit") and (r.kind == "revisit" or sha1(r.payload) == r.payload_digest)
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in records)


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://a/{i}", rng.choice(["a", "b", "", "é" * 10, None, f"only {i}", "long " * 5000])) for i in range(150)]
    rows += [(3, "http://x\r\ny", "a"), (3, None, "a"), (None, "u", "a"), (None, "u", "z"), (None, "u", "z"), (0, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert read_back(pages) == expected(rows)
    assert read_back(pages, min_bytes=5) == expected(rows, 5)


def test_urls_of_any_length(spark):
    rows = [(n, "data:text/html," + "x" * size, f"page {n % 3}") for n, size in enumerate([10, 65_000, 65_536, 200_000, 3_000_000, 200_000])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert read_back(pages) == expected(rows)


def test_plain_records_with_long_headers(monkeypatch):
    urls = ["http://a", "http://b/" + "y" * 200_000, "http://c/WARC/1.1", "http://d/" + "z" * 70_000 + "WARC/1.1"]
    parts = [warc_io.record(n, url, b"page", 4, sha1(b"page"), None) for n, url in enumerate(urls)]
    data = parts[0] + b"WARC/1.1\r\nno end\r\n" + b"".join(parts[1:]) + b"WARC/1.1\r\nend"
    whole = list(warc_io.salvage(io.BytesIO(data)))
    assert [headers["warc-target-uri"] for _, _, headers, _, _ in whole if headers] == urls
    assert [length for _, length, headers, _, _ in whole if not headers] == [18, 13] and sum(r[1] for r in whole) == len(data)
    monkeypatch.setattr(warc_io, "READ", 4099)
    assert list(warc_io.salvage(io.BytesIO(data))) == whole


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, size string")
    assert read_back(pages) == Counter()


def archive(rng, compressed):
    records = []
    for number in range(8):
        payload = rng.randbytes(rng.randint(0, 300))
        records.append(warc_io.record(number, "http://a", payload, len(payload), sha1(payload), None))
    return [warc_io.member(r) if compressed else r for r in records]


def test_salvage_recovers_all_other_records_and_accounts_for_every_byte():
    rng = random.Random(5)
    for trial in range(300):
        parts = archive(rng, trial % 2)
        ends = [sum(map(len, parts[: k + 1])) for k in range(8)]
        data, hurt = bytearray(b"".join(parts)), rng.randrange(8)
        at = rng.randrange(ends[hurt] - len(parts[hurt]), ends[hurt])
        damage = rng.choice(["bit", "cut", "noise"])
        if damage == "bit":
            data[at] ^= 1 << rng.randrange(8)
        elif damage == "cut":
            del data[at:min(ends[hurt], at + rng.randint(1, 50))]
        else:
            data[at:at] = b"noise \x1f\x8b\x08 WARC/1.1\r\n noise"
        found = list(warc_io.salvage(io.BytesIO(bytes(data))))
        numbers = {warc.warc_io.page_number(headers["warc-record-id"]) for _, _, headers, _, _ in found if headers}
        assert numbers >= set(range(8)) - {hurt}
        assert sum(length for _, length, *_ in found) == len(data)
        assert all(reason for _, _, headers, _, reason in found if headers is None)


def numbers_of(found):
    return [warc_io.page_number(headers["warc-record-id"]) for _, _, headers, _, _ in found if headers]


def one_member(count, salt=b""):
    rng = random.Random(count)
    payloads = [rng.randbytes(rng.randint(0, 400)) + salt for _ in range(count)]
    return [warc_io.record(n, "http://a", p, len(p), sha1(p), None) for n, p in enumerate(payloads)]


def test_many_records_in_a_member(monkeypatch):
    records = one_member(400)
    data = warc_io.member(b"".join(records)) + warc_io.member(b"".join(one_member(3)))
    for held, read in ((1 << 25, 1 << 20), (5000, 1 << 20), (5000, 700)):
        monkeypatch.setattr(warc_io, "HELD", held)
        monkeypatch.setattr(warc_io, "READ", read)
        found = list(warc_io.salvage(io.BytesIO(data)))
        assert numbers_of(found) == [*range(400), 0, 1, 2] and len(found) == 403
        assert sum(length for _, length, *_ in found) == len(data)
    inside = warc_io.member(b"".join(records[:5]) + b"noise" + b"".join(records[5:9]))
    found = list(warc_io.salvage(io.BytesIO(inside + records[20])))
    assert numbers_of(found) == [*range(9), 20] and [r[4] for r in found if not r[2]] == ["in a member: no header"]
    assert sum(r[1] for r in found) == len(inside + records[20])


def test_readable_start_of_a_damaged_member(monkeypatch):
    records = one_member(199)
    whole, other = warc_io.member(b"".join(records)), warc_io.member(one_member(1, b"other")[0])
    cut = whole[:len(whole) * 3 // 4]
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 16
    for held in (1 << 25, 3000):
        monkeypatch.setattr(warc_io, "HELD", held)
        for data, least in ((cut, 140), (cut + other, 140), (bytes(flipped) + other, 90), (whole[:-1], 199)):
            found = list(warc_io.salvage(io.BytesIO(data)))
            got = numbers_of(found)[:-1] if data.endswith(other) else numbers_of(found)
            assert got == list(range(len(got))) and len(got) >= least
            assert sum(r[1] for r in found) == len(data) and sum(r[2] is None for r in found) == 1
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = stored.compress(b"".join(records)) + stored.flush()
    assert Counter(numbers_of(warc_io.salvage(io.BytesIO(stored[:-3])))) == Counter(range(199))


def test_unproved_records_of_a_damaged_member_do_not_count():
    bare = [b"\r\n".join(x for x in r.split(b"\r\n") if b"Digest" not in x) for r in one_member(3)]
    data = warc_io.member(b"".join(bare))
    assert numbers_of(warc_io.salvage(io.BytesIO(data))) == [0, 1, 2]
    found = list(warc_io.salvage(io.BytesIO(data[:-2])))
    assert numbers_of(found) == [] and [r[1] for r in found] == [len(data) - 2]


def test_digests_of_other_algorithms():
    record = one_member(1)[0]
    block = record[record.index(b"\r\n\r\n") + 4:-4]
    old = b"WARC-Block-Digest: sha1:" + sha1(block).encode()
    assert old in record
    for stated, fine in (
        ("sha256:" + hashlib.sha256(block).hexdigest(), True), ("sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode(), True),
        ("blake3:00ff", True), ("sha256:" + hashlib.sha256(b"x").hexdigest(), False), ("md5:" + hashlib.md5(block).hexdigest(), True),
    ):
        changed = record.replace(old, f"WARC-Block-Digest: {stated}".encode())
        assert numbers_of(warc_io.salvage(io.BytesIO(changed))) == ([0] if fine else []), stated


def test_wrong_length_does_not_make_the_reader_hold_the_rest():
    records = one_member(30)
    at = records[3].index(b"Content-Length: ")
    stop = records[3].index(b"\r\n", at)
    records[3] = records[3][:at] + b"Content-Length: 999999999" + records[3][stop:]
    data = b"".join(records) + b"".join(warc_io.record(100 + n, "u", b"x" * 100_000, 100_000, sha1(b"x" * 100_000), None) for n in range(200))
    most = 0

    class Watched(warc_io._Buffer):
        def fill(self, size):
            nonlocal most
            done = super().fill(size)
            most = max(most, len(self.data))
            return done

    plain, warc_io._Buffer = warc_io._Buffer, Watched
    try:
        found = list(warc_io.salvage(io.BytesIO(data)))
    finally:
        warc_io._Buffer = plain
    assert numbers_of(found) == [n for n in range(30) if n != 3] + list(range(100, 300)) and most <= 3 << 20


def test_small_reads_give_the_same_records(monkeypatch):
    data = b"".join(archive(random.Random(2), True)) + b"tail" + b"".join(archive(random.Random(3), False))
    whole = list(warc_io.salvage(io.BytesIO(data)))
    monkeypatch.setattr(warc_io, "READ", 7)
    assert list(warc_io.salvage(io.BytesIO(data))) == whole
    assert [length for _, length, headers, _, _ in whole if headers is None] == [4]


def test_gaps_are_rows(spark, tmp_path):
    parts = archive(random.Random(4), True)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts[:3]) + b"garbage" + b"".join(parts[3:]))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    archives = spark.createDataFrame([(f"file://{path}",), (f"file://{tmp_path}/empty.warc.gz",)], "archive string")
    rows = warc.read_archives(archives).collect()
    assert Counter(r.kind for r in rows) == {"response": 8, "gap": 1}
    gap = next(r for r in rows if r.kind == "gap")
    assert (gap.offset, gap.length) == (sum(map(len, parts[:3])), 7) and gap.reason
