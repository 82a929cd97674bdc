"""Files, archives, workspaces, summaries, intake."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import summary, validate
from quarry.sources import files
from quarry.streaming import intake


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), content)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    for name, content in {"payroll.cbl": b"A.", "copybook.cpy": b"B", "batch.jcl": b"//J", "readme.txt": b"text", "subdir/report.cbl": b"C."}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    return tmp_path / "in"


def test_scan_and_summary(spark, folder):
    (folder / "a.zip").write_bytes(archive(archived_cbl=b"X.", dir__archived_jcl=b"//", inner_zip=archive(x_cbl=b"no")))
    (folder / "b.zip").write_bytes(b"no archive")
    found = files.scan(spark, str(folder))
    assert [r.path for r in found.select("path").collect()] == ["a.zip!/archived.cbl", "a.zip!/dir/archived.jcl", "a.zip!/inner.zip", "batch.jcl", "copybook.cpy", "payroll.cbl", "readme.txt", "subdir/report.cbl"]
    assert [(r.file_type, r["count"]) for r in summary.by_type(found).collect()] == [("COBOL", 3), ("JCL", 2), ("Copybook", 1), ("Text", 1), ("Unknown", 1)]
    assert summary.totals(found).first().total_files == 8 and "content" not in summary.inventory(found).columns
    assert files.read_sources(spark, str(folder)).count() == 2


def test_empty_files_and_odd_names_are_scanned(spark, folder):
    for name in ("nothing.cbl", "subdir/a b%20.cpy"):
        (folder / name).write_bytes(b"")
    (folder / "größe 1.txt").write_bytes("ß".encode())
    got = {r.path: (r.size_bytes, r.encoding) for r in files.scan(spark, str(folder)).collect()}
    assert got["nothing.cbl"] == got["subdir/a b%20.cpy"] == (0, "UNKNOWN") and got["größe 1.txt"][0] == 2 and len(got) == 8


def damaged_archives():
    """Damage to the directory, to a member's data, to its checksum, and at the end, each of an archive whose first member is whole."""
    text = b"IDENTIFICATION DIVISION.\n" * 60
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.cbl", b"FIRST.")
        z.writestr("second.cbl", text)
    whole = out.getvalue()
    at = whole.index(b"second.cbl") + len("second.cbl")
    inflate = whole[:at] + b"\xff" * 8 + whole[at + 8 :]
    check = bytearray(whole)
    crc = whole.rindex(b"PK\x01\x02") + 16
    check[crc] ^= 1
    return {"whole.zip": (whole, 2), "inflate.zip": (inflate, 1), "check.zip": (bytes(check), 1), "cut.zip": (whole[:-30], 0), "none.zip": (b"", 0)}


def test_damaged_archives(spark):
    """Members before the damage are there, and the damage is told; other archives are not touched by it."""
    given = damaged_archives()
    rows = spark.createDataFrame([(n, n, c) for n, (c, _) in given.items()], "path string, filename string, content binary")
    got = {r.path: r["count"] for r in files.expanded(rows).groupBy(F.substring_index("path", "!", 1).alias("path")).count().collect()}
    assert got == {n: k for n, (_, k) in given.items() if k}
    assert {r.path for r in files.damaged(rows).collect()} == {n for n in given if n != "whole.zip"}


def test_save_survives_a_lost_driver(spark, tmp_path, monkeypatch):
    w = files.Workspaces(spark, str(tmp_path / "ws"))
    rows = lambda *names: files.described(spark.createDataFrame([(n, n, b"x") for n in names], "path string, filename string, content binary"), "one")
    w.save("one", rows("a.cbl"))

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(files.Workspaces, "_move", lost)
        with pytest.raises(KeyboardInterrupt):
            w.save("one", rows("b.cbl", "c.cbl"))
    assert [r.path for r in files.Workspaces(spark, str(tmp_path / "ws")).get("one").collect()] == ["a.cbl"]
    w.save("one", rows("b.cbl", "c.cbl"))
    assert w.get("one").count() == 2 and w.all().count() == 2


def test_sources_over_the_limit(spark, folder):
    (folder / "big.cbl").write_bytes(b"A" * (1024 * 1024 + 1))
    assert files.read_sources(spark, str(folder), max_mb=1).count() == 2
    assert [tuple(r) for r in files.too_large(spark, str(folder), max_mb=1).collect()] == [("big.cbl", 1024 * 1024 + 1)]


def test_an_error_says_how_many_more_there_are(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:02d}.exe", b"x") for i in range(23)], "filename string, content binary")
    with pytest.raises(ValueError, match="00.exe.*and 3 more"):
        files.ingest(rows, files.Workspaces(spark, str(tmp_path)), "w")


def batch(spark, **content):
    return spark.createDataFrame([(n.replace("_", "."), c) for n, c in content.items()], "filename string, content binary")


def test_ingest(spark, tmp_path):
    w = files.Workspaces(spark, str(tmp_path / "ws"))
    got = files.ingest(batch(spark, a_cbl=b"A.", z_zip=archive(m_cbl=b"M.", x_exe=b"no", d__a_cbl=b"N.")), w, "one")
    assert sorted((r.path, r.collides) for r in got.collect()) == [("a.cbl", True), ("a.cbl", True), ("m.cbl", False)]
    assert w.exists("one") and w.all().count() == 3
    with pytest.raises(ValueError, match="unsupported extension"):
        files.ingest(batch(spark, a_exe=b"x", b_cbl=b"y"), w, "two")
    assert not w.exists("two")
    w.delete("one")
    with pytest.raises(FileNotFoundError):
        w.get("one")
    with pytest.raises(ValueError):
        w.path("../up")


def test_validation(spark):
    rows = spark.createDataFrame([("a.cbl", b"x"), ("A.CBL", b"y"), ("b.exe", b"x"), ("c.txt", b""), ("d.jcl", b"x" * (1024 * 1024 + 1)), ("e.jcl", b"x" * (1024 * 1024))], "filename string, content binary")
    assert {r.filename: r.reason.split(";")[0] for r in validate.rejected(rows, 1).collect()} == {"a.cbl": "duplicate file name", "b.exe": "unsupported extension '.exe'", "c.txt": "file is empty", "d.jcl": "file is larger than 1 MB"}
    assert [r.filename for r in validate.repeated_names(rows).collect()] == ["a.cbl"]


def test_sources(spark):
    rows = spark.createDataFrame([("a", "a.cbl", b"\xef\xbb\xbfA."), ("b", "b.cbl", b"\xff")], "path string, filename string, content binary")
    assert [tuple(r) for r in files.sources(rows).collect()] == [("a", "A.")]
    assert files.sources(rows, strict=False).count() == 2 and files.undecodable(rows).first().path == "b"


def test_intake(spark, folder, tmp_path):
    to, at = str(tmp_path / "out"), str(tmp_path / "check")
    (folder / "again.cbl").write_bytes(b"A.")  # the content of payroll.cbl
    intake.run(spark, str(folder), to, at).awaitTermination()
    assert spark.read.parquet(to).count() == 5
    (folder / "late.cbl").write_bytes(b"L.")
    os.utime(folder / "late.cbl", (1e9, 1e9))  # an old file that comes late is taken like any other
    intake.run(spark, str(folder), to, at).awaitTermination()
    got = spark.read.parquet(to)
    assert got.count() == 6 and got.where(F.col("filename") == "late.cbl").count() == 1
