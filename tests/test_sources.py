import json
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tidewatch.sources import media, reports, seed
from tidewatch.sources.storage import names, ranked, shared_dir

def now():
    return F.lit("2026-01-01").cast("timestamp")



def test_reports_file(spark, tmp_path):
    rows = [{"id": "a", "source_user": "u", "raw_text": "x", "timestamp": "2026-09-11T14:05:12+05:30"}, {"id": "a", "source_user": "v", "raw_text": "y"}, {"source_user": "w", "raw_text": "z"}, {"id": "old", "source_user": "q", "raw_text": "r"}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    stored = spark.createDataFrame([("old",)], "id string")
    got = reports.load_reports(reports.read_reports(spark, str(tmp_path / "r.json")), stored, now()).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == 2 and by["a"]["source_user"] == "u" and by["a"]["ts"] == datetime(2026, 9, 11, 8, 35, 12)
    other = next(r for r in got if r["id"] != "a")
    assert other["id"].startswith("rep_") and len(other["id"]) == 36 and other["ts"] == datetime(2026, 1, 1)


def test_reports_without_ids_stay_apart(spark):
    rows = [(None, "u", "same", "t"), (None, "u", "same", "t"), (" ", "u", "same", "t"), ("a", "u", "one", "t"), ("a", "u", "two", "t")]
    incoming = spark.createDataFrame([(*r, None, None, None, k) for k, r in enumerate(rows)], "id string, source_user string, raw_text string, timestamp string, media_url string, gps_lat double, gps_lon double, k long")
    load = lambda: sorted((r["id"], r["raw_text"]) for r in reports.load_reports(incoming, spark.createDataFrame([], "id string"), F.lit("2026-01-01").cast("timestamp"), F.col("k")).collect())
    got = load()
    assert len(got) == 4 and got == load() and ("a", "one") in got and sum(len(i) == 36 for i, _ in got) == 3


def test_made_ids_do_not_hang_on_the_split(spark):
    rows = [(None, "u", f"text {k % 3}", "2026-01-01T00:00:00", None, None, 1.5) for k in range(12)] + [("", None, None, None, None, None, None)] * 25_000 + [("a", "u", "one", None, None, None, None)]
    incoming = spark.createDataFrame(rows, "id string, source_user string, raw_text string, timestamp string, media_url string, gps_lat double, gps_lon double")
    load = lambda parts: sorted((r["id"], r["raw_text"] or "") for r in reports.load_reports(incoming.repartition(parts), spark.createDataFrame([], "id string"), now()).collect())
    got = load(1)
    assert len(got) == len(set(got)) == len(rows) and got == load(7)


def test_intake_reasons(spark):
    rows = [("u", "t", 90.0, 180.0), (" ", "", None, None), ("u", "t", float("nan"), 200.0)]
    got = reports.validate_reports(spark.createDataFrame(rows, "source_user string, raw_text string, gps_lat double, gps_lon double")).collect()
    assert [r["reasons"] for r in got] == [[], ["source_user", "raw_text"], ["gps_lat", "gps_lon"]]


def test_registry_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"s1": "bdadc2429c1e1cad", "s2": null}')
    (tmp_path / "b.json").write_text("not json")
    assert [tuple(r) for r in reports.load_known_hashes(spark, str(tmp_path)).collect()] == [("s1", "bdadc2429c1e1cad")]


def test_seen_ids_keep_the_last_in_order(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r["id"] for r in reports.seen_ids_update(ids("b", "a"), ids("c", "b"), 2).collect()] == ["c", "b"]


def test_snapshots_and_evolution(spark):
    at = reports.write_snapshot({"t": spark.range(3)}, shared_dir(spark, "s"), 2)
    root = at.removesuffix("/v=2")
    assert reports.newest_snapshot(spark, root) == at and reports.newest_snapshot(spark, root + "-none") is None
    spark.range(5).write.parquet(f"{root}/v=3/t")  # not complete: nothing says that it is ready
    assert reports.newest_snapshot(spark, root) == at
    assert at.endswith("/v=2") and reports.read_snapshot(spark, at, "t").count() == 3
    got = reports.schema_evolve(spark.range(1), {"id": "long", "n": "int", "s": "string"}, {"n": F.lit(0)}).first()
    assert (got["id"], got["n"], got["s"]) == (0, 0, None)


def test_two_writers_lose_no_change(spark):
    """Both begin on one version; the second to come begins again on the winner's."""
    from threading import Barrier, Thread

    root, meet, calls, failed = shared_dir(spark, "commits"), Barrier(2), [], []
    first = reports.commit_snapshot(spark, root, lambda base: {"t": spark.createDataFrame([(0,)], "n int")})

    def writer(n):
        def change(base):
            calls.append((n, base))
            rows = reports.read_snapshot(spark, base, "t").union(spark.createDataFrame([(n,)], "n int"))
            if base == first:
                meet.wait(60)
            return {"t": rows}

        try:
            reports.commit_snapshot(spark, root, change, keep=2)
        except BaseException as e:
            failed.append(e)

    both = [Thread(target=writer, args=(n,)) for n in (1, 2)]
    [t.start() for t in both]
    [t.join() for t in both]
    newest = reports.newest_snapshot(spark, root)
    assert not failed and sorted(r["n"] for r in reports.read_snapshot(spark, newest, "t").collect()) == [0, 1, 2]
    assert len(calls) == 3 and [c[1] for c in calls[:2]] == [first, first] and calls[2][1] not in (first, newest)
    # Version 1 is over: its tables are gone, and so is what the loser wrote first.
    assert sorted(reports._versions(spark, root)) == [2, 3] and len(names(spark, root)) == 3
    with __import__("pytest").raises(ValueError):
        reports.write_snapshot({"t": spark.range(1)}, root, 3)


def test_seed_only_if_absent(spark):
    kinds = "id string, event_type string, title string, center_lat double, center_lon double, uncertainty_radius_m double, severity_score double, confidence_score double, verification_status string, action_priority string, responder_state string"
    once = seed.seed_incident(spark.createDataFrame([], kinds))
    assert once.count() == 1 and seed.seed_incident(once).count() == 1 and seed.seed_reports(spark).count() == 3


def test_phash_survives_brightness_and_size():
    r = np.random.default_rng(0)
    picture = np.kron(r.random((8, 8)), np.ones((16, 16)))
    bits = lambda h: int(h, 16)
    same = media.phash(np.kron(picture, np.ones((2, 2))) * 0.8 + 0.1)
    assert (bits(media.phash(picture)) ^ bits(same)).bit_count() <= 3
    other = media.phash(np.kron(r.random((8, 8)), np.ones((16, 16))))
    assert (bits(media.phash(picture)) ^ bits(other)).bit_count() > 10


def test_ranks_are_global(spark):
    rows = ranked(spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1000), [F.col("v")], "n").collect()
    assert all(r["n"] == r["v"] + 1 for r in rows)


def _png(seed: int) -> bytes:
    import struct
    import zlib

    import numpy as np

    grey = np.random.default_rng(seed).integers(0, 255, (16, 16), np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r.tobytes() for r in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_media_with_equal_names_and_empty_files(spark, tmp_path):
    """Files of one name in several folders are told apart; one of no bytes is listed and refused."""
    from tidewatch.sources import media

    files = {"a/x.png": b"broken", "b/x.png": _png(1), "c/x.png": _png(2), "c/empty.png": b"", "c/d e/ä+x%20.PNG": _png(3), "note.txt": b"t", "c/d e/big.jpg": b"0" * (8 * 1024 * 1024 + 1), "c/.hidden.png": b"", "empty.txt": b""}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    want = {"a/x.png": "undecodable", "b/x.png": None, "c/x.png": None, "c/empty.png": "empty file", "c/d e/ä+x%20.PNG": None, "note.txt": "unsupported type", "c/d e/big.jpg": "too large", "empty.txt": "unsupported type"}
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        got = media.media_manifest(spark, root).collect()
        assert {r["path"]: r["reason"] for r in got} == want and len(got) == len(want)
        assert {r["path"]: r["length"] for r in got} == {k: len(files[k]) for k in want}
    hashes = {r["path"]: r["phash"] for r in media.phash_images(spark, str(tmp_path)).collect()}
    assert set(hashes) == {"b/x.png", "c/x.png", "c/d e/ä+x%20.PNG"} and len(set(hashes.values())) == 3


def test_one_analysis_of_an_image_in_every_run(spark):
    from tidewatch.operators import evidence, extraction

    kind = extraction.failed_analysis("x") if hasattr(extraction, "failed_analysis") else evidence.failed_analysis("x")
    rows = spark.range(6).select(F.when(F.col("id") % 2 == 0, "AB").otherwise("ab").alias("phash"), (10 - F.col("id")).alias("stored_at"), kind.alias("analysis"))
    media = spark.createDataFrame([("Ab",), ("cd",), (None,)], "phash string")
    got = evidence.image_analysis_join(media, rows.repartition(6)).collect()
    assert len(got) == 3 and sum(r["analysis"] is None for r in got) == 1


def _exif_block(turn: int, order: str) -> bytes:
    import struct

    e = "<" if order == "II" else ">"
    entries = struct.pack(e + "HHIHH", 0x010F, 3, 1, 9, 0) + struct.pack(e + "HHIHH", 0x0112, 3, 1, turn, 0)
    return order.encode() + struct.pack(e + "HIH", 42, 8, 2) + entries + struct.pack(e + "I", 0)


#: How a picture is stored under each orientation (EXIF 2.3): what its first row and first column are.
STORED = {
    1: lambda m: m, 2: np.fliplr, 3: lambda m: np.rot90(m, 2), 4: np.flipud, 5: np.transpose,
    6: lambda m: np.rot90(m, 1), 7: lambda m: np.rot90(m, 2).T, 8: lambda m: np.rot90(m, -1),
}


def test_eight_orientations_of_a_photo_have_one_hash(spark, tmp_path):
    import struct
    import zlib

    r = np.random.default_rng(3)
    photo = np.kron(r.integers(0, 255, (8, 12)), np.ones((8, 8))).astype(np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    for turn, kept in STORED.items():
        grey = np.ascontiguousarray(kept(photo))
        head = chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0))
        rows = chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x.tobytes() for x in grey)))
        exif = chunk(b"eXIf", _exif_block(turn, "MM" if turn % 2 else "II"))
        (tmp_path / f"t{turn}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + head + exif + rows + chunk(b"IEND", b""))
        (tmp_path / f"plain{turn}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + head + rows + chunk(b"IEND", b""))
        assert (media.upright(kept(photo), turn) == photo).all()
    got = {x["name"]: x["phash"] for x in media.phash_images(spark, str(tmp_path)).collect()}
    assert len(got) == 16 and {got[f"t{k}.png"] for k in STORED} == {got["plain1.png"]}
    assert len({got[f"plain{k}.png"] for k in STORED}) == 8


def test_exif_of_a_jpeg():
    import io

    block = lambda kind, body: b"\xff" + bytes([kind]) + (len(body) + 2).to_bytes(2, "big") + body
    jpeg = lambda *parts: io.BytesIO(b"\xff\xd8" + b"".join(parts) + b"\xff\xda\0\2xyz")
    exif = block(0xE1, b"Exif\0\0" + _exif_block(6, "II"))
    read = lambda f: media.orientation(media._exif(f))
    assert read(jpeg(block(0xE0, b"JFIF\0"), exif)) == 6
    assert read(jpeg(block(0xE1, b"http://ns.adobe.com/xap"), b"\xff", exif)) == 6
    assert read(jpeg(block(0xE0, b"JFIF\0"))) == 1 and read(io.BytesIO(b"")) == 1 and read(io.BytesIO(b"GIF89a")) == 1
    for cut in range(30):
        assert media.orientation(_exif_block(6, "MM")[:cut]) == 1
    assert media.orientation(_exif_block(9, "MM")) == 1


def test_hashes_of_the_query_are_those_of_its_pictures(spark):
    import os

    import pytest

    from tidewatch.plans import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    want = {}
    for x in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect():
        e = np.nan_to_num(np.asarray(x["embedding"] or [0.0], np.float64))
        v = np.bincount(np.arange(len(e)) % 64, weights=e, minlength=64)
        picture = np.kron(np.clip((v - v.min()) / max(float(np.ptp(v)), 1e-9) * 255, 0, 255).reshape(8, 8), np.ones((8, 8))).astype(np.uint8)
        if x["vec_id"] % 20 not in (1, 2):
            want[f"v{x['vec_id']:08d}." + ("gif" if x["vec_id"] % 20 == 0 else "png")] = media.phash(picture)
    assert {x["name"]: x["phash"] for x in queries.QUERIES["phash_images"](spark, sf).collect()} == want
