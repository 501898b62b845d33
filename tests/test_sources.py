"""Sources and sinks: listings, archives, texts, JSON lines, snapshots."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pytest
from lumenlake.sources import listing
from pyspark.sql import functions as F


@pytest.fixture
def library(tmp_path):
    for path, content in {"a.TXT": "alpha " * 2_000, "sub/b.jpg": "x", "sub/deep/c.md": "# c", ".git/config": "g", "sub/Thumbs.db": "t", "sub/d.part": "p", ".hidden": "h", "skip/e.txt": "e"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    return tmp_path


def test_listing(spark, library):
    rows = {r["relative_path"]: r for r in listing.list_files(spark, str(library)).collect()}
    assert set(rows) >= {"a.TXT", "sub/b.jpg", "sub/deep/c.md", "skip/e.txt"}
    one = rows["sub/b.jpg"]
    assert (one["name"], one["extension"], one["media_type"], one["size_bytes"]) == ("b.jpg", "jpg", "photo", 1)
    assert rows["a.TXT"]["media_type"] == "document" and rows["a.TXT"]["full_path"].endswith("/a.TXT")


def test_contents_stay_unread(spark, library):
    plan = listing.list_files(spark, str(library))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_skip_reasons(spark):
    wanted = {
        "a/.git/x.txt": "system_directory",
        "@eaDir/x.jpg": "system_directory",
        "a/Thumbs.db": "system_file",
        "a/IMG.XMP": "system_file",
        "a/._b.jpg": "system_file",
        "a/x.tmp": "system_file",
        "a/~$doc.docx": "system_file",
        "old/y.txt": "user_ignored_folder",
        "older/y.txt": None,
        "a/.env": "hidden_file",
        "a/x.LOG": "user_ignored_extension",
        "a/x.bin": "other_type_excluded",
        "fine.jpg": None,
    }
    df = spark.createDataFrame([(p.rpartition("/")[2], p) for p in wanted], "name string, relative_path string")
    settings = listing.ScanSettings(ignored_folders=("old/",), ignored_extensions=(".log",))
    assert dict(df.select("relative_path", listing.skip_reason(settings)).collect()) == wanted
    assert {v for v in wanted.values() if v} <= set(listing.SKIP_REASONS)
    loose = listing.ScanSettings(hidden=False, system=False, sidecars=False, temporary=False, others=True)
    assert {r[0] for r in df.select(listing.skip_reason(loose)).collect()} == {None}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("p/a.jpg", "xx")
        z.writestr("p/b.mp4", "yyy")
        z.writestr("inner.zip", "z")
    with tarfile.open(tmp_path / "two.tar", "w") as t:
        info = tarfile.TarInfo("d/n.pdf")
        info.size = 4
        t.addfile(info, io.BytesIO(b"1234"))
    (tmp_path / "broken.ZIP").write_bytes(b"PK not a zip")
    (tmp_path / "packed.7z").write_bytes(b"7z")
    (tmp_path / "plain.txt").write_text("not an archive")
    entries = listing.archive_entries(spark, str(tmp_path))
    rows = {(r["archive"].rpartition("/")[2], r["path"]): r for r in entries.collect()}
    assert rows["broken.ZIP", None]["status"] == "unreadable" and rows["packed.7z", None]["status"] == "unsupported"
    assert {a for a, _ in rows} == {"one.zip", "two.tar", "broken.ZIP", "packed.7z"}
    assert rows["two.tar", "d/n.pdf"]["size_bytes"] == 4 and rows["one.zip", "p/a.jpg"]["name"] == "a.jpg"
    counts = {r["archive"].rpartition("/")[2]: r for r in listing.peek_counts(entries.where("status = 'ok'")).collect()}
    one, two = counts["one.zip"], counts["two.tar"]
    assert (one["photos"], one["videos"], one["documents"], one["size"], one["nested"]) == (1, 1, 0, 6, True)
    assert (two["documents"], two["nested"]) == (1, False)


def test_texts_are_cut(spark, library):
    rows = {r["path"].rpartition("/")[2]: r["text"] for r in listing.read_texts(spark, str(library)).collect()}
    assert len(rows["a.TXT"]) == listing.TEXT_CHARS and rows["c.md"] == "# c" and "b.jpg" not in rows


def test_json_lines_tolerate_bad_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(listing.manifest([{"ts": 1, "p": "a"}, {"ts": 3, "p": "c"}]) + "not json\n" + listing.manifest([{"ts": 2, "p": "b"}]))
    rows = [r["p"] for r in listing.read_lines(spark, str(tmp_path), "ts long, p string", "ts").collect()]
    assert rows == ["c", "b", "a"]
    listing.append_lines(spark.createDataFrame([(9, "z")], "ts long, p string"), f"{tmp_path}/out")
    listing.append_lines(spark.createDataFrame([(8, "y")], "ts long, p string"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_snapshots_by_version_and_age(spark, tmp_path):
    folder = f"{tmp_path}/snap"
    listing.write_snapshot(spark.range(3), folder)
    listing.write_snapshot(spark.range(5), folder)
    listing.write_snapshot(spark.range(9), folder, version=2)
    assert listing.read_snapshot(spark, folder).count() == 5
    assert listing.read_snapshot(spark, folder, version=2).count() == 9
    assert listing.read_snapshot(spark, folder, version=3) is None
    assert listing.read_snapshot(spark, folder, most_age=-1) is None
    listing.discard(spark.range(10))


def test_props(spark):
    df = spark.createDataFrame([('{"k": 5}',), ("bad",), (None,)], "props string")
    assert [r[0] for r in df.select(listing.parse_props("props", "k int")["k"]).collect()] == [5, None, None]
    assert df.where(F.col("props").isNull()).count() == 1


def test_rolling_files_keep_the_newest(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert listing.read_snapshot(spark, folder) is None
    for n in range(5):
        listing.roll(spark.createDataFrame([(n, f"scan {n}")], "at int, what string"), folder, "at", 3)
    assert sorted(r["at"] for r in listing.read_snapshot(spark, folder).collect()) == [2, 3, 4]


def test_packed_and_large_archives(spark, tmp_path, monkeypatch):
    """Single packed files, packed TARs, broken ones, and a TAR larger than what a reader may hold: read by headers, in groups."""
    import gzip
    import io
    import lzma
    import tarfile
    import tracemalloc

    from lumenlake.sources import archives

    (tmp_path / "one.txt.gz").write_bytes(gzip.compress(b"x" * 3_000_000))
    (tmp_path / "two.csv.XZ").write_bytes(lzma.compress(b"y" * 70))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"z" * 100_000)[:60])
    (tmp_path / "empty.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "bad.zip").write_bytes(b"no")
    (tmp_path / "old.rar").write_bytes(b"Rar!")
    with tarfile.open(tmp_path / "deep.tgz", "w:gz") as t:
        for name in ("a/b.txt", "c.jpg"):
            info = tarfile.TarInfo(name)
            info.size = 5
            t.addfile(info, io.BytesIO(b"12345"))
    with tarfile.open(tmp_path / "big.tar", "w") as t:
        for i in range(3):
            info = tarfile.TarInfo(f"{i}.bin")
            info.size = 30_000_000
            t.addfile(info, io.BytesIO(bytes(info.size)))
    found = {(r["archive"].rpartition("/")[2], r["path"]): (r["size_bytes"], r["status"]) for r in listing.archive_entries(spark, str(tmp_path)).collect()}
    big = {("big.tar", f"{i}.bin"): (30_000_000, "ok") for i in range(3)}
    assert found == big | {("one.txt.gz", "one.txt"): (3_000_000, "ok"), ("two.csv.XZ", "two.csv"): (70, "ok"), ("cut.gz", None): (None, "unreadable"), ("empty.gz", "empty"): (0, "ok"), ("bad.zip", None): (None, "unreadable"), ("old.rar", None): (None, "unsupported"), ("deep.tgz", "a/b.txt"): (5, "ok"), ("deep.tgz", "c.jpg"): (5, "ok")}
    monkeypatch.setattr(archives, "PART_FILES", 3)
    reader = archives.ArchiveReader(str(tmp_path))
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [3, 3, 2]
    tracemalloc.start()
    assert sum(1 for p in parts for _ in reader.read(p)) == len(found)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
