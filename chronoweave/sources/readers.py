"""Readers: text and JSON snapshots, folders, DOCX bodies, OCR tables, keyed records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Uncompressed bytes of a document body that are read at most; a larger one is reported, not cut.
DOCX_LIMIT = 64 << 20


def submit(rows: DataFrame) -> DataFrame:
    """(filename, content, text) with the document id: 32 hex digits of the content's, or the text's, SHA-256."""
    raw = F.coalesce(F.col("content"), F.encode(F.col("text"), "UTF-8"))
    return rows.withColumn("doc_id", F.substring(F.sha2(raw, 256), 1, 32))


def text_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Whole text files: file name and text without a byte-order mark."""
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).text(path)
    return t.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".pdf", ".docx", ".doc", ".txt", ".json")) -> DataFrame:
    """Files of a folder by extension, without lock and summary files, with a flattened name."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ok = F.lower(name).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$") & ~name.startswith("~$") & ~name.rlike("(?i)summary")
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", ""), r"^/", ""), "/", "__")
    return f.where(ok).select("path", name.alias("filename"), flat.alias("flat_name"), "content")


def json_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """{filename, text} files; a file that isn't JSON gives its text in _corrupt_record."""
    return spark.read.schema("filename string, file_type string, text string, _corrupt_record string").option("multiLine", True).json(path)


def recover(snapshots: DataFrame, originals: DataFrame) -> DataFrame:
    """Empty snapshots take the one original of the same name; none leaves them empty, several are an error."""
    key = F.lower("filename")
    o = originals.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("original"))
    j = snapshots.withColumn("k", key).join(o, "k", "left")
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    many = F.raise_error(F.concat(F.lit("several originals named "), F.col("filename")))
    text = F.when(~empty, F.col("text")).when(F.col("n") > 1, many).otherwise(F.coalesce("original", "text"))
    return j.withColumns({"text": text, "recovered": empty & (F.coalesce("n", F.lit(0)) == 1)}).drop("k", "n", "original")


def docx_text(content: bytes) -> str | None:
    """Paragraphs and table rows of a DOCX body in order, cells joined by a bar; null if it can't be read."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo("word/document.xml").file_size > DOCX_LIMIT:
                return None
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None

    def words(node) -> str:
        return "".join(t.text or "" if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "" for t in node.iter())

    out = []
    for node in body if body is not None else ():
        if node.tag == f"{w}p":
            out.append(words(node))
        elif node.tag == f"{w}tbl":
            out += [" | ".join(words(cell) for cell in row.iter(f"{w}tc")) for row in node.iter(f"{w}tr")]
    return "\n".join(out)


def docx(files: DataFrame) -> DataFrame:
    """files with text from their DOCX content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": pdf["content"].map(docx_text)})

    return files.select("path", "content").mapInPandas(read, "path string, text string")


def ocr_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """Words of an OCR table (level 5) to lines, left to right."""
    key = [*page, "block_num", "par_num", "line_num"]
    found = words.where((F.col("level") == 5) & (F.trim("text") != ""))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ")
    return found.groupBy(*key).agg(line.alias("text"))


def field(*names: str) -> Column:
    """The first of several aliases that isn't null."""
    return F.coalesce(*(F.col(n) for n in names))


def keyed_records(rows: DataFrame, key: str) -> DataFrame:
    """Records by normalised file key; a missing or repeated key is an error."""
    k = F.lower(F.replace(F.col(key), F.lit("\\"), F.lit("/")))
    k = F.when(F.coalesce(k, F.lit("")) == "", F.raise_error(F.lit("record without a name")).cast("string")).otherwise(k)
    n = F.count(F.lit(1)).over(Window.partitionBy("record_key"))
    r = rows.withColumn("record_key", k).withColumn("__n", n)
    return r.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate record "), F.col("record_key"))).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def corpus_text(found: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Files still to convert: those without output, or all."""
    return found if force else found.join(done, "flat_name", "left_anti")
