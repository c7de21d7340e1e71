"""The command line end to end on files of a temporary folder."""

import io
import json
import zipfile

import pytest

from quire import schemas
from quire.__main__ import main
from quire.operators import cost
from tests.test_operators import png


def told(capsys):
    return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]


def test_scans_to_package(spark, tmp_path, capsys):
    scans = tmp_path / "scans"
    scans.mkdir()
    for i in (10, 9, 1):
        (scans / f"p{i}.PNG").write_bytes(png(800, 1200, 64))
    (scans / "notes.txt").write_text("x")
    paths = {n: str(tmp_path / n) for n in ("pages", "books", "out", "done", "texts", "merged", "ledger")}
    (scans / "p2.zip").write_bytes(b"")
    for f in scans.glob("*.PNG"):
        f.rename(f.with_suffix(".png"))
    assert main(["import", str(scans), "b", paths["pages"]], spark) == 0
    assert [r.stem for r in spark.read.parquet(paths["pages"]).orderBy("stem").collect()] == ["page_001", "page_002", "page_003"]
    spark.createDataFrame([("b", "T", "A", "vi", "1990")], "slug string, title string, author string, lang string, year string").write.parquet(paths["books"])
    capsys.readouterr()
    assert main(["package", paths["pages"], paths["books"], paths["out"]], spark) == 0
    assert told(capsys) == [{"book": "b", "valid": True, "errors": []}]
    spark.createDataFrame([("x", bytearray(b"no zip"))], "book string, content binary").write.mode("append").parquet(paths["out"])
    assert main(["verify", paths["out"]], spark) == 1
    assert [r["valid"] for r in told(capsys)] == [False, True]
    assert main(["recognize", paths["pages"], paths["done"]], spark) == 0
    assert main(["merge", paths["done"], paths["books"], paths["merged"]], spark) == 0
    assert spark.read.parquet(paths["merged"]).count() == 1
    assert main(["merge", paths["done"], paths["books"], paths["merged"], "--toc"], spark) == 0
    assert main(["toc", paths["merged"], paths["books"], str(tmp_path / "clean")], spark) == 0
    assert main(["epub", str(tmp_path / "clean"), paths["books"], str(tmp_path / "epub")], spark) == 0
    assert main(["all", paths["pages"], paths["books"], str(tmp_path / "whole")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "whole" / "epub")).count() == 1
    assert main(["import", str(scans), "b", paths["pages"]], spark) == 1  # imported already
    assert spark.read.parquet(paths["pages"]).count() == 3
    assert main(["init", str(tmp_path / "new"), "Đường xa", "--year", "1990"], spark) == 0
    assert [(r.slug, r.lang) for r in spark.read.parquet(str(tmp_path / "new")).collect()] == [("duong-xa", "vi")]
    spark.createDataFrame([("b", "1.5"), ("b", "bad")], "book string, cost_usd string").write.parquet(paths["ledger"])
    capsys.readouterr()
    assert main(["ledger", paths["ledger"]], spark) == 0
    assert told(capsys)[0]["total_usd"] == 1.5


def test_archives(spark, tmp_path, capsys):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/p2.png", png(1, 1))
        z.writestr("a/p1.png", png(1, 1))
    (tmp_path / "b.cbz").write_bytes(out.getvalue())
    assert main(["import", str(tmp_path), "b", str(tmp_path / "pages"), "--archives"], spark) == 0


def test_wrong_calls(capsys):
    with pytest.raises(SystemExit):
        main(["nothing"])
    assert main(["doctor"]) in (0, 1) and told(capsys)[0]["check"] == "java"


def test_trial_before_the_whole(spark, tmp_path, capsys):
    """A book beyond the budget stops behind its trial; with more to spend the rest is done, and no page twice."""
    rows = [("b", f"page_{i:03d}", "png", f"page_{i:03d}.png", 4000, bytearray(png(800, 1200, 4000) + bytes([i]))) for i in range(14)]
    spark.createDataFrame(rows, schemas.PAGE_IMAGES).write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("b", "T", "A", None, "vi", "1990")], schemas.BOOKS).write.parquet(str(tmp_path / "books"))
    out = str(tmp_path / "out")
    call = lambda budget: main(["all", str(tmp_path / "pages"), str(tmp_path / "books"), out, "--budget", budget], spark)
    capsys.readouterr()
    assert call("0.001") == 1
    first = told(capsys)[0]
    assert (first["status"], first["ok"], first["remaining"]) == ("smoke", 10, 4)
    assert spark.read.parquet(f"{out}/texts").count() == 10 and not (tmp_path / "out" / "merged").exists()
    assert call("1") == 0 and told(capsys)[0]["status"] == "full"
    assert spark.read.parquet(f"{out}/texts").count() == 14 and spark.read.parquet(f"{out}/epub").count() == 1
    ledger = cost.ledger_totals(cost.read_ledger(spark, f"{out}/ledger", "book string, cost_usd string"), ["book"]).first()
    assert ledger.entries == 2 and 0.017 < float(ledger.total_usd) < 0.02  # 14 pages of 4001 tokens


def test_files_and_homes_are_verified_by_their_paths(spark, tmp_path, capsys):
    def archive(path, size, damage=False):
        path.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("x", bytes(range(256)) * (size // 256))
        if damage:
            raw = bytearray(path.read_bytes())
            raw[200] ^= 1
            path.write_bytes(bytes(raw))

    archive(tmp_path / "good" / "dist" / "good.epub", 20_000)
    archive(tmp_path / "small" / "dist" / "small.epub", 512)
    archive(tmp_path / "hurt" / "dist" / "hurt.epub", 20_000, damage=True)
    (tmp_path / "none" / "scans").mkdir(parents=True)
    (tmp_path / "none" / "scans" / "p1.png").write_bytes(png(1, 1))
    (tmp_path / "hurt" / "dist" / "notes.txt").write_text("x")
    capsys.readouterr()
    assert main(["verify", str(tmp_path), "--files"], spark) == 1
    *rows, total = told(capsys)
    assert {r["label"].rpartition("/")[2]: r["status"] for r in rows} == {"good": "OK", "small": "TINY", "hurt": "BADZIP", "none": "MISSING"}
    assert total == {"ok": 1, "tiny": 1, "badzip": 1, "missing": 1, "total": 4}
    assert main(["verify", str(tmp_path / "good"), "--files"], spark) == 0 and told(capsys)[0]["status"] == "OK"
    assert main(["verify", str(tmp_path / "hurt" / "dist" / "hurt.epub"), "--files"], spark) == 1 and told(capsys)[0]["status"] == "BADZIP"
