"""Text files: one for each row, written without a process for each, and read back in rounds."""

import os

from pyspark.sql import functions as F

from docweave.plans import jobs
from docweave.sources import files

TEXTS = ["", "a", "two\nlines\r\n", "żółw \U0001f422", *(f"text {i}" * i for i in range(40)), None]


def read(rounds):
    return [sorted((r["text"], r["length"]) for r in found.collect()) for found in rounds]


def want():
    return sorted(((t or "") + "\n", len((t or "").encode()) + 1) for t in TEXTS)


def texts(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "value string").repartition(3)


def test_every_row_is_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "IN_FOLDER", 4)
    monkeypatch.setattr(files, "IN_ROUND", 10)
    folders = files.write_texts(texts(spark), str(tmp_path))
    kept = [f for _, _, names in os.walk(tmp_path) for f in names]
    assert len(kept) == len(TEXTS) == sum(n for _, n in folders) and max(n for _, n in folders) == 4
    assert not [f for f in kept if f.endswith(".crc")]  # what Spark's writer starts processes for
    rounds = read(files.read_rounds(spark, folders))
    assert len(rounds) > 4 and max(map(len, rounds)) <= 10
    assert sorted(r for some in rounds for r in some) == want()


def test_folders_of_failed_attempts_are_not_read(spark, tmp_path):
    folders = files.write_texts(texts(spark), str(tmp_path))
    os.makedirs(tmp_path / "part-00000-999/00000")
    (tmp_path / "part-00000-999/00000/00000.txt").write_text("of an attempt that failed\n")
    assert [r for some in read(files.read_rounds(spark, folders)) for r in some] == want()


def test_a_store_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "IN_FOLDER", 4)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.texts.link./out", f"file://{tmp_path}")
    folders = files.write_texts(texts(spark), "viewfs://texts/out/a")
    assert len(folders) > 10
    assert sorted(r for some in read(files.read_rounds(spark, folders)) for r in some) == want()


def test_bytes_are_read_as_by_the_text_source(spark, tmp_path):
    for name, content in (("empty", b""), ("bom", b"\xef\xbb\xbfa\n"), ("broken", b"a\xffb"), ("a b%20c", b"\r\n")):
        (tmp_path / f"{name}.txt").write_bytes(content)
    plain = spark.read.text(str(tmp_path), wholetext=True).select("_metadata.file_path", "_metadata.file_name", F.col("_metadata.file_size").alias("length"), F.col("value").alias("text"))
    rows = lambda df: sorted((r["file_path"], r["file_name"], r["length"], bytes(r["b"])) for r in df.withColumn("b", F.col("text").cast("binary")).drop("text").collect())
    assert rows(files.read_texts(spark, str(tmp_path))) == rows(plain)


def test_documents_by_rounds(spark, data, monkeypatch):
    monkeypatch.setattr(files, "IN_FOLDER", 20)
    monkeypatch.setattr(files, "IN_ROUND", 50)
    assert jobs.s1(spark, data).select("doc_id").distinct().count() == spark.read.parquet(f"{data}/documents.parquet").count()
