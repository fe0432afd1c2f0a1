import gzip
import hashlib
import zlib
from pathlib import Path

import pytest

from helixframe.llm import warc as W
from helixframe.llm.common import new_folder


def make(n, size=300):
    out = []
    for i in range(n):
        payload = (f"<p>{i}</p>" * size).encode()[:size]
        out.append(W.record(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), None))
    return out


def ids(found):
    return [W.from_urn(x.head["warc-record-id"]) for x in found if x.gap is None]


def gaps(found):
    return [(x.at, x.size) for x in found if x.gap]


def test_whole_archive():
    members = make(5)
    found = list(W.salvage(b"".join(members)))
    assert ids(found) == list(range(5)) and not gaps(found)
    assert gzip.decompress(b"".join(members)).count(b"WARC/1.1\r\n") == 5  # any reader of gzip takes it


@pytest.mark.parametrize("hurt", [0, 2, 4])
def test_a_damaged_member_is_a_gap_and_later_ones_come_back(hurt):
    members = make(5)
    bad = bytearray(members[hurt])
    bad[len(bad) // 2] ^= 0xFF
    data = b"".join(m if i != hurt else bytes(bad) for i, m in enumerate(members))
    found = list(W.salvage(data))
    assert ids(found) == [i for i in range(5) if i != hurt]
    start = sum(map(len, members[:hurt]))
    assert gaps(found)[0][0] == start and sum(n for _, n in gaps(found)) == len(members[hurt])
    assert sum(x.size for x in found) == len(data)  # every byte is a record's or a gap's


def test_a_cut_archive_and_junk():
    members = make(3)
    junk = b"\x00junk\x1f\x8b\x08junk"
    data = members[0] + junk + members[1] + members[2][:-9]
    found = list(W.salvage(data))
    assert ids(found) == [0, 1]
    assert gaps(found) == [(len(members[0]), len(junk)), (len(data) - len(members[2]) + 9, len(members[2]) - 9)]


def test_plain_records_resume_at_a_version_line():
    plain = [zlib.decompress(m, 31) for m in make(4)]
    wrong = plain[1].replace(b"<p>1</p>", b"<p>x</p>", 1)  # the digest tells
    short = plain[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found = list(W.salvage(plain[0] + wrong + short + plain[3]))
    assert ids(found) == [0, 3] and [x.gap for x in found if x.gap][0] == "block digest differs"
    assert sum(x.size for x in found) == sum(map(len, (plain[0], wrong, short, plain[3])))


def test_a_version_line_inside_a_payload_is_not_a_record():
    payload = b"text\nWARC/1.1\r\nWARC-Type: response\r\n\r\nmore" + b"x" * 100
    data = zlib.decompress(W.record(1, None, payload, "d", None), 31)
    assert ids(W.salvage(data)) == [1]


def test_nothing_to_read():
    assert list(W.salvage(b"")) == [] and [x.gap for x in W.salvage(b"abc")] == ["no version line"]


def brute(pages):
    out = {}
    for page_id, _, html in pages:
        p = (html or "").encode()
        same = [i for i, _, h in pages if (h or "").encode() == p and i is not None]
        first = min(same, default=None)
        visit = len(p) >= 100 and page_id is not None and page_id > first
        out[page_id] = (len(p), hashlib.sha256(p).hexdigest(), "revisit" if visit else "response", first if visit else None)
    return out


def test_pages_round_trip(spark, tmp_path):
    long, pages = "é" * 60, []
    for i in range(60):
        pages.append((i, f"http://h/{i} a\r\nb" if i % 3 else None, [long, "short", f"<p>{i}</p>" * 40, None, ""][i % 5]))
    pages += [(-5, "u", long), (100, "u", "x" * 100_000), (None, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    folder = new_folder(spark, "warc")
    found = W.read_archives(spark, folder, W.write_archives(df, folder, archive_bytes=5000)).collect()
    assert not [r for r in found if r["gap"]] and len(found) == len(pages)
    got = {}
    for r in found:
        kind = r["type"]
        got[W.from_urn(r["record_id"])] = (len(r["payload"]) if kind == "response" else r["payload_bytes"], r["payload_digest"].removeprefix("sha256:"), kind, W.from_urn(r["refers_to"]))
        assert kind != "revisit" or r["payload"] == b""
        assert "\r" not in r["target"] and " " not in r["target"]
    assert got == brute(pages)
    assert len(list(Path(folder.removeprefix("file://")).iterdir())) > 4  # archives are closed at their size


def test_damage_on_disk_is_logged(spark):
    df = spark.createDataFrame([(i, "u", "text " * 50 + str(i)) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    folder = new_folder(spark, "warc")
    uris = W.write_archives(df, folder)
    assert len(uris) == 1
    path = Path(uris[0].removeprefix("file://"))
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 0xFF
    path.write_bytes(data)
    rows = W.read_archives(spark, folder, uris).collect()
    assert sum(r["gap"] is None for r in rows) == 4 and sum(r["gap"] is not None for r in rows) >= 1


def test_empty_table_and_extra_columns(spark):
    folder = new_folder(spark, "warc")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.write_archives(empty, folder) == [] and W.read_archives(spark, folder, []).count() == 0
    odd = spark.createDataFrame([(1, "u", "h", "x", "y")], "page_id long, url string, html string, digest string, first string")
    assert W.with_revisits(odd, 100).first()["page_id"] == 1


def test_urls_of_any_length(spark):
    body = "<p>said twice</p>" * 20
    pages = [(1, "http://h/" + "a" * 400_000, body), (2, "http://h/" + "\x01" * 40_000, "other"), (3, "http://h/3", body), (4, "http://h/" + "b" * 65_600, "")]
    folder = new_folder(spark, "warc-long-urls")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {W.from_urn(r["record_id"]): r for r in W.read_archives(spark, folder, W.write_archives(df, folder)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and all(r["gap"] is None for r in got.values())
    assert got[1]["target"] == pages[0][1] and got[2]["target"] == "http://h/" + "%01" * 40_000
    assert W.from_urn(got[3]["refers_to"]) == 1


def test_plain_headers_end_before_the_next_record():
    plain = [zlib.decompress(m, 31) for m in make(3)]
    cut = plain[1][: plain[1].index(b"\r\n\r\n")] + b"\r\n"  # its headers never end
    found = list(W.salvage(plain[0] + cut + plain[2]))
    assert ids(found) == [0, 2] and gaps(found) == [(len(plain[0]), len(cut))]


def test_rows_that_tie_on_page_id(spark):
    body = "<p>said again</p>" * 20
    pages = [(1, "u", body), (1, "u", body), (2, "u", body), (2, "u", "other")]
    folder = new_folder(spark, "warc-ties")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = sorted((W.from_urn(r["record_id"]), r["type"], W.from_urn(r["refers_to"]) or 0) for r in W.read_archives(spark, folder, W.write_archives(df, folder)).collect())
    assert got == [(1, "response", 0), (1, "response", 0), (2, "response", 0), (2, "revisit", 1)]


def test_time_grows_with_the_archive():
    import time

    def took(n, damage):
        data = bytearray(b"".join(make(n, 600)))
        for i in range(200, len(data), damage):
            data[i] ^= 0x55
        began = time.process_time()
        list(W.salvage(bytes(data)))
        return time.process_time() - began

    for damage in (1 << 30, 700):  # hardly any, and one gap after another
        short = min(took(4000, damage) for _ in range(3))
        assert min(took(16000, damage) for _ in range(3)) < 8 * short  # four times the bytes
