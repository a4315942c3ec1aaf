import random

import pytest

from mixweave.llm import warc_merge as M


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 17])
def test_loser_tree_equals_sorting(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 12))) for _ in range(k)]
    merged = list(M.loser_tree([iter(r) for r in runs], lambda x: (x,)))
    assert merged == sorted(x for r in runs for x in r)


def test_pieces_of_runs_merge():
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 5)}", f"t{rng.randint(0, 3)}", rng.choice([None, 1, 2]), "", 0, "", "", None, f"a{i % 3}", i, 1) for i in range(60)]
    pieces = [r for a in range(3) for r in sorted((x for x in rows if x[8] == f"a{a}"), key=M.order_key)]
    assert list(M.merge_pieces(pieces)) == sorted(rows, key=M.order_key)


def test_url_keys():
    assert M.url_key("HTTPS://user@www.Example.com:80/A?b#c") == "com,example:80)/a?b"
    assert M.url_key("") == ")/" and M.url_key("http://a.b?x") == "b,a)?x"


BIG = "<p>équal</p>" * 20


def test_round_trip_and_revisits(spark, tmp_path):
    rows = [(5, "http://a.com/1", BIG), (3, "http://a.com/2", BIG), (9, None, BIG), (1, "http://b.com", "x"), (2, "http://b.com", "x"), (7, "http://c\r\nX: y/", None), (8, "http://a.com/1", "other\r\n\r\nWARC/1.1\r\n" + BIG), (3, "http://a.com/2", BIG), (None, "http://z", BIG)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    out = M.archive_pages(pages, str(tmp_path / "warc")).collect()
    assert len(out) == len(rows)
    of = {}
    for r in out:
        of.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"], r["payload_bytes"]))
    size = len(BIG.encode())
    assert of[3] == [("response", None, size)] * 2 and of[5] == of[9] == of[None] == [("revisit", 3, size)]
    assert of[1] == of[2] == [("response", None, 1)] and of[7] == [("response", None, 0)]
    assert of[8][0][0] == "response" and len(of[8]) == 1
    keys = [(r["urlkey"], r["captured"]) for r in out]
    assert keys == sorted(keys)


def test_index_offsets_name_the_records(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(M, "ARCHIVE_BLOCKS", 2)
    rng = random.Random(3)
    pages = [(i, f"http://a{i % 3}.com/{i}", "".join(chr(rng.choice([65, 233, 0x20AC, 0x1F600, 0])) for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    M.write_archives(df, str(tmp_path / "w"), block_bytes=4000)
    files = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("part-*")}
    assert len(files) > 4 and all(len(x) < 4 * 4000 for x in files.values())
    index = M.merge_index(M.sorted_runs(spark, str(tmp_path / "w"))).collect()
    assert len(index) == 60
    for r in index:
        raw = gzip.decompress(files[r["archive"]][r["offset"] : r["offset"] + r["length"]])
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")
        headers, block = M.read_record(raw)
        assert block.partition(b"\r\n\r\n")[2].decode() == pages[r["page_id"]][2] and headers["x-page-id"] == str(r["page_id"])
    whole = b"".join(gzip.decompress(x) for x in files.values())
    assert whole.count(b"WARC-Record-ID") == 60


def test_members_of_any_size():
    big = random.Random(0).randbytes(17 << 20)  # its length doesn't end in a zero byte
    contents = [b"a", big, b"b" * 100_000]
    blocks = list(M.blocks_of(contents, 1000))
    assert [c for b in blocks for _, _, c in M.members(b + b"\0")] == contents and len(blocks) == 3
    with pytest.raises(ValueError):
        list(M.members(M.gzip_member(b"abc")[:-3]))


def test_a_very_long_page(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in M.archive_pages(pages, str(tmp_path / "w")).collect()}
    assert out[1]["payload_bytes"] == 6_000_000 and out[2]["refers_to"] == 1


def test_damage_is_noticed():
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: \r\nWARC-Target-URI: \r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 3\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    for content in (record, record[:-5], b"x" + record):
        with pytest.raises(ValueError):
            M.capture_of("a", 0, 1, content)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert M.archive_pages(pages).count() == 0
