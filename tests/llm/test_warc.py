import gzip
import hashlib

from timberline.llm import warc
from timberline.session import shared_path

BODY = "<p>" + "x" * 120 + "</p>"
PAGES = [(1, "http://a.example/", BODY), (2, "http://b.example/a b\r\nX: y", BODY), (3, None, "small"), (4, "http://d.example/", "small"), (5, "", None), (6, "http://f.example/é", "WARC/1.1\r\n\r\n\r\n" + "é" * 200), (7, "x", ""), (8, "x", BODY), (None, "x", BODY), (None, "x", "alone" * 30), (9, "x", "twice" * 30), (9, "x", "twice" * 30), (10, "x", "long\r\n\r\n" * 100000)]


def captures(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha string")
    path = shared_path(spark, "warc")
    warc.write_archives(df, path, file_captures=4)
    return path, warc.resolve_revisits(warc.assemble(warc.read_records(spark, path)))


def test_pages_come_back(spark):
    _, out = captures(spark, PAGES)
    got = sorted(((r["page_key"], r["payload_bytes"], r["payload_digest"], r["main"]["record_type"], r["refers_key"]) for r in out.collect()), key=str)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if p is not None and (h or "").encode() == data]
        again = len(data) >= 100 and bool(same) and i != min(same)
        want.append((None if i is None else str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(min(same)) if again else None))
    assert got == sorted(want, key=str)
    for r in out.collect():
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1
        assert r["requests"][0]["content"].startswith(b"GET ")


def test_no_pages(spark):
    assert captures(spark, [])[1].count() == 0


def test_parse_takes_pieces_of_any_size_and_gzip_members():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 8\r\n\r\nab\r\n\r\ncd\r\n\r\n"
    for step in (1, 3, 1000):
        data = record * 3
        found = list(warc.parse(data[i : i + step] for i in range(0, len(data), step)))
        assert [b for _, b in found] == [b"ab\r\n\r\ncd"] * 3 and found[0][0]["warc-type"] == "resource"
    packed = gzip.compress(record) + gzip.compress(record)
    assert len(list(warc.parse(warc.inflate(packed)))) == 2


def assembled(spark, rows):
    df = spark.createDataFrame([(a, b, None, c, None, None, None, None, None, None) for a, b, c in rows], warc.RECORD_SCHEMA)
    return {r["capture_id"]: r for r in warc.assemble(df).collect()}


def test_assembly_keeps_orphans(spark):
    out = assembled(spark, [("r1", "response", []), ("q1", "request", ["r1"]), ("m4", "metadata", ["r1"]), ("m4", "metadata", ["r1"]), ("q2", "request", ["gone"]), ("m3", "metadata", []), ("x", None, None)])
    assert set(out) == {"r1", "gone", "m3", "x"}
    assert [x["record_id"] for x in out["r1"]["requests"]] == ["q1"] and [x["record_id"] for x in out["r1"]["metadata"]] == ["m4"]
    assert out["gone"]["main"] is None and len(out["m3"]["metadata"]) == 1


def test_assembly_follows_links_of_either_direction(spark):
    rows = [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["other", "m1"]), ("r2", "revisit", []), ("q2", "request", ["r2"]), ("m3", "metadata", ["q2"]), ("q4", "request", ["gone"]), ("m4", "metadata", ["q4"])]
    out = assembled(spark, rows)
    assert set(out) == {"r1", "r2", "gone"}
    ids = lambda k, part: [x["record_id"] for x in out[k][part]]
    assert (ids("r1", "requests"), ids("r1", "metadata")) == (["q1"], ["m1", "m2"])
    assert (ids("r2", "requests"), ids("r2", "metadata")) == (["q2"], ["m3"])
    assert (ids("gone", "requests"), ids("gone", "metadata"), out["gone"]["main"]) == (["q4"], ["m4"], None)


def test_records_without_ids_stay_apart():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    fields = [f for f, _ in warc.parse(iter([record * 2]))]
    assert [f["warc-concurrent-to"] for f in fields] == ["<a> <b>"] * 2


def test_the_query(spark, tmp_path):
    import duckdb

    from timberline.llm import queries

    df = spark.createDataFrame([r for r in PAGES if r[0] != 9], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op1_warc(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = db.sql(queries.OP1_SQL)
        assert sorted(want.columns) == sorted(got.columns)
        rows = db.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.OP1_SQL}) WHERE page_id IS NOT NULL").fetchall()
    assert sorted(map(tuple, got.filter("page_id IS NOT NULL").collect()), key=str) == sorted(rows, key=str)
