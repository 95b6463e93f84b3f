"""Findings of round 4: scans in pieces, decks opened once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefold.plans import QUERIES
from lakefold.sources import files as SF
from lakefold.streaming.events import _Deliveries


def test_a_scan_in_pieces_gives_every_byte_in_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lakefold.sources.ranged.RANGE", 1 << 20)
    contents = {"a b%20.parquet": bytes(range(256)) * 20_000, "even.parquet": b"PAR1" * 1024, "empty.parquet": b""}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    whole = {r.path: bytes(r.content) for r in SF.scan_files(spark, str(tmp_path)).collect()}
    rows = SF.scan_files(spark, str(tmp_path), piece_bytes=4096).orderBy("path", "offset").collect()
    assert max(len(r.content) for r in rows) == 4096
    found: dict = {}
    for r in rows:
        assert r.offset == len(found.get(r.path, b"")) and r.length == len(whole[r.path])
        found[r.path] = found.get(r.path, b"") + bytes(r.content)
    assert found == whole and len(whole) == 2  # the source lists no empty files


def test_scan_files_holds_no_file_as_a_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SF, "PIECE_BYTES", 1 << 16)
    (tmp_path / "events.parquet").write_bytes(b"PAR1" + bytes(900_000))
    asked = []
    scan = SF.scan_files
    monkeypatch.setattr(SF, "scan_files", lambda *a, **k: asked.append(scan(*a, **k)) or asked[-1])
    assert [tuple(r) for r in QUERIES["scan_files"](spark, str(tmp_path)).collect()] == [("events.parquet", "parquet", "50415231")]
    size, most = asked[0].agg(F.sum(F.octet_length("content")), F.max(F.octet_length("content"))).first()
    assert (size, most) == (900_004, 1 << 16)


def test_first_n_slides_opens_its_decks_once(spark, tmp_path):
    rows = [(k, f"name {k}", "Manufacturer#1", "Brand#1", f"type {k}", k % 5 + 1, "box", 1.0) for k in (1, 2, 7)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    frame = QUERIES["first_n_slides"](spark, str(tmp_path))
    found = sorted((r.path, r.asked, r.slide_no, r.id, r.element_count, r.total_slides, r.loaded_slides) for r in frame.collect())
    want = [(f"p{k}.pptx", asked, n, i, c, 3, loaded) for k in (1, 2) for asked, loaded in (("all", 3), ("two", 2)) for n, i, c in ((1, "256", 5), (2, "257", 1), (3, "3", 0))[:loaded]]
    assert found == sorted(want)
    assert "ReusedExchange" in frame._jdf.queryExecution().executedPlan().toString()


def test_a_subscription_is_sent_once_for_the_events_it_meets():
    sent = list(_Deliveries()._pairs([(10, 60, "s"), (0, 5, "t"), (90, 95, "none")], [(k, f"e{k}") for k in range(80)]))
    assert [(r.sub, list(r.events)) for frame in sent for r in frame.itertuples()] == [("s", [f"e{k}" for k in range(10, 60)]), ("t", [f"e{k}" for k in range(5)])]
    many = [frame for frame in _Deliveries()._pairs([(0, 25_000, "s")] * 3, [(k, "e") for k in range(25_000)])]
    assert max(sum(map(len, frame.events)) for frame in many) < 20_000 and sum(len(e) for frame in many for e in frame.events) == 75_000
