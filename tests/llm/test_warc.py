import base64
import hashlib

from obscat.llm.warc import read_archive, write_archive

KIND = "page_id long, url string, html string, id string, payload string, address string"


def test_records_of_an_archive(spark, tmp_path):
    rows = [
        (1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "", ""), (5, "http://ü", "<p>ä漢\r\nWARC-Type: no</p>"),
        (6, "http://big", "z" * 300_000), (7, "http://c", "same"), (7, "http://c", "same"), (None, "http://n", "null id"),
    ]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KIND)
    found = read_archive(spark, write_archive(pages, str(tmp_path / "a"))).toPandas()
    assert len(found) == len(rows)
    bodies = {}
    for i, _, html in rows:
        bodies.setdefault((html or "").encode(), []).append(i)
    for r in found.itertuples():
        body = bytes(r.payload)
        own = None if r.id != r.id else int(r.id)
        owner = max((x for x in bodies[body] if x is not None), default=None)
        assert own in bodies[body] and r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == ("response" if own == owner else "revisit")
        assert (r.refers_to != r.refers_to) if own == owner else int(r.refers_to) == owner
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and f"WARC-Record-ID: <urn:page:{'' if own is None else own}>".encode() in head
        size = int(head.rpartition(b"Content-Length: ")[2])
        assert len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")
        assert rest[:size].partition(b"\r\n\r\n")[2] == (body if own == owner else b"")
    targets = {r.id: r.target for r in found.itertuples() if r.id == r.id}
    assert targets[1] == "http://a" and targets[2] == "http://b%0D%0AX: y" and targets[3] is None and targets[4] is None and targets[5] == "http://ü"


def test_payloads_are_stored_once(spark, tmp_path):
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "cast(id % 3 AS string) AS html")
    path = write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(f"{path}/payloads").count() == 3 and spark.read.parquet(f"{path}/headers").count() == 40


def test_empty_table(spark, tmp_path):
    path = write_archive(spark.createDataFrame([], KIND), str(tmp_path / "a"))
    assert read_archive(spark, path).count() == 0


def test_a_changed_payload_is_refused(spark, tmp_path):
    path = write_archive(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), str(tmp_path / "a"))
    payloads = spark.read.parquet(f"{path}/payloads").collect()
    spark.createDataFrame([(r.address, r.response_id, bytearray(b"other")) for r in payloads], "address binary, response_id long, payload binary") \
        .write.mode("overwrite").parquet(f"{path}/payloads")
    try:
        read_archive(spark, path).collect()
    except Exception as error:  # noqa: BLE001
        assert "payload differs from its digest" in str(error)
    else:
        raise AssertionError("a changed payload was accepted")
