import base64
import gzip
import hashlib
import io

from lodestone.llm import warc


def want_digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pages(spark):
    rows = [(i, f"http://x/{i} a", f"<p>päge {i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (None, "n", "only null id"), (200, "l", "long " * 200_000), (201, "m", "WARC/1.1\r\n"), (201, "m", "WARC/1.1\r\n")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as _digest", "2 as payload")


def test_round_trip_over_many_splits(spark):
    rows, df = pages(spark)
    for settings in (warc.Settings(), warc.Settings(file_bytes=3000, split_bytes=700)):
        got = warc.round_trip(df.repartition(3), settings).collect()
        assert len(got) == len(rows) and all(r["valid"] for r in got)
        largest = {}
        for i, _, html in rows:
            largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
        html_of = {i: (h or "") for i, _, h in rows}
        for r in got:
            payload = html_of[r["page_id"]].encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), want_digest(payload))
            top = largest[html_of[r["page_id"]]]
            if r["page_id"] == top or top == -1:
                assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == payload
            else:
                assert (r["record_type"], r["refers_to"]) == ("revisit", top)


def test_every_range_owns_its_records():
    settings = warc.Settings()
    blob = b"".join(warc.member(i, f"u{i}", bytes([31, 139, 8]) * i + bytes(range(256)), None, settings) for i in range(40))
    whole = [r.offset for r in warc.records(io.BytesIO(blob), 0, len(blob))]
    assert len(whole) == 40
    for step in (1, 7, 100, 5000):
        found = [r.offset for at in range(0, len(blob), step) for r in warc.records(io.BytesIO(blob), at, min(at + step, len(blob)))]
        assert found == whole


def test_false_magic_and_damage_are_passed_over():
    settings = warc.Settings()
    one, two = (warc.member(i, "u", b"x" * 50, None, settings) for i in (1, 2))
    other = gzip.compress(b"not a record at all, but a gzip member")
    blob = other + one + warc.MAGIC + b"junk" + two[:-30] + one
    ids = [r.headers["warc-record-id"] for r in warc.records(io.BytesIO(blob), 0, len(blob))]
    assert ids == ["<urn:x-page:1>", "<urn:x-page:1>"]
    hidden = warc.member(3, "u", two, None, warc.Settings(level=0))  # a whole member lies inside a stored payload
    assert [r.offset for r in warc.records(io.BytesIO(hidden), 0, len(hidden))] == [0]


def test_empty_table(spark):
    _, df = pages(spark)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_very_long_urls_come_back(spark):
    noise = base64.b64encode(bytes((i * i * 31 + i // 7) % 256 for i in range(300_000))).decode()
    urls = ["http://x/" + "a" * (1 << 16), "data:text/html;base64," + noise, "u" + " " * 70_000, "short"]
    df = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    for settings in (warc.Settings(), warc.Settings(split_bytes=5000)):
        got = {r["page_id"]: r for r in warc.round_trip(df, settings).collect()}
        assert {i: r["target"] for i, r in got.items()} == {i: u.replace(" ", "%20") for i, u in enumerate(urls)}
        assert all(r["valid"] and bytes(r["payload"]) == f"<p>{i}</p>".encode() for i, r in got.items())


def test_malformed_headers_are_no_record():
    for head in (b"WARC/1.1\r\nno field\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n"):
        blob = gzip.compress(head)
        assert warc.inflate(io.BytesIO(blob), 0) is None
