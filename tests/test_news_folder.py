"""Folders of many news files."""

import gzip
import os

from pyspark.sql import functions as F

from ratingloom.sources import news_files as NF


def test_names_are_dealt_to_many_tasks_and_files_stay_whole(spark, tmp_path):
    rows = [(f"{i}_SR_{1990 + i % 9}_news.json", f'{{"ticker": "é{i}", "articles": []}}') for i in range(300)]
    files = spark.createDataFrame(rows, "file_name string, value string").coalesce(1)
    path = str(tmp_path / "news")
    NF.write_news_folder(files, path)
    # few bytes, so a plan that adapts made one task of them, whose files the driver moved one by one
    folders = [d for d, _, names in os.walk(path) if any(n.endswith("_news.json") for n in names)]
    assert 8 < len(folders) <= NF.SUBFOLDERS
    assert sorted(map(tuple, NF.read_news_folder(spark, path).withColumn("value", F.rtrim(F.translate("value", "\n", ""))).collect())) == sorted(rows)
    some = NF.read_news_folder(spark, path, years=[1990, 1995])
    assert some.count() == sum(i % 9 in (0, 5) for i in range(300))
    assert NF.folder_index(spark, path).where("ticker IS NOT NULL").count() == 300


def test_a_folder_of_many_files_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver held the list of all files; both ways see the same files and texts."""
    sub = tmp_path / "deep" / "deeper"
    sub.mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_key=1").mkdir()
    (tmp_path / "file_name=8_SR_2020_news.json").mkdir()
    texts = {
        "1_SR_2020_news.json": b"{}", "2_SR_2021_NEWS.json": "é\n\n".encode(), "deep/3_SR_2021_news.json": b'{"a": "\xff\xfe"}', "deep/deeper/nokey_news.json": b"x" * 100,
        "empty_SR_2021_news.json": b"", ".4_SR_2021_news.json": b"h", "_5_SR_2021_news.json": b"h", "_hidden/6_SR_2021_news.json": b"h", "_key=1/7_SR_2021_news.json": b"k",
        "other.json": b"o", "bom_SR_2021_news.json": b"\xef\xbb\xbf{}\r\n{}\r\r", "a é+b%2F[x]#?&^`_SR_2021_news.json": b"s", "file_name=8_SR_2020_news.json/part-00000.txt": b"p", "9_SR_2021_news.json._COPYING_": b"c",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    (tmp_path / "file_name=8_SR_2020_news.json" / "part-00001.txt.gz").write_bytes(gzip.compress(b"packed"))

    def seen(**wanted):
        files = NF.read_news_folder(spark, f"file:{tmp_path}", **wanted)
        rows = files.select("file_name", F.col("value").cast("binary").alias("value")).collect()
        listed = NF.folder_index(spark, str(tmp_path)).collect()
        return "MapInArrow" in files._jdf.queryExecution().optimizedPlan().toString(), sorted((r["file_name"], bytes(r["value"])) for r in rows), sorted(map(str, listed))

    wants = ({}, {"years": [2021]}, {"tickers": ["8.SR", "1.SR"], "years": [2020]})
    by_spark = [seen(**w) for w in wants]
    monkeypatch.setattr(NF, "DRIVER_FILES", 3)
    monkeypatch.setattr(NF, "HELD_FILES", 2)
    monkeypatch.setattr(NF, "HELD_BYTES", 1)
    by_tasks = [seen(**w) for w in wants]
    assert [s[1:] for s in by_spark] == [s[1:] for s in by_tasks] and len(by_spark[0][1]) >= 7
    assert not any(s[0] for s in by_spark) and all(s[0] for s in by_tasks)
