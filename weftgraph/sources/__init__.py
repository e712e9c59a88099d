"""Readers: manifests, document files, the annotation cache."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rtf_text

MANIFEST = "title string, file_path string, description string, keywords array<string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents; nulls become empty. ``doc_id`` comes from the file path."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    out = rows.select(text("title"), text("file_path"), text("description"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    return out.withColumn("doc_id", F.concat(F.lit("doc:"), F.substring(F.sha1(F.col("file_path").cast("binary")), 1, 12)))


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word file, one a line; empty ones go; broken files give nothing."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    lines = ("".join((x.text or "") if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter()).strip() for p in root.iter(f"{_W}p"))
    return "\n".join(line for line in lines if line)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of .txt, .md, .rtf and .docx files; other types and broken files have empty text.

    Each kind is listed by its pattern, so a file's bytes are read once; of other files only the names.
    """
    load = lambda pattern, *c: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", *c)

    @F.pandas_udf("string")
    def plain(content: pd.Series) -> pd.Series:
        return content.map(lambda b: b.decode("utf-8", "ignore"))

    @F.pandas_udf("string")
    def word(content: pd.Series) -> pd.Series:
        return content.map(docx_text)

    text = F.coalesce(plain("content"), F.lit("")).alias("text")
    known = "*.{[tT][xX][tT],[mM][dD]}", "*.[rR][tT][fF]", "*.[dD][oO][cC][xX]"
    plain_files = load(known[0], "content").select("path", text)
    rtf_files = load(known[1], "content").select("path", rtf_text(plain("content")).alias("text"))
    word_files = load(known[2], "content").select("path", word("content").alias("text"))
    others = load("*").where(~F.lower("path").rlike(r"\.(txt|md|rtf|docx)$")).select("path", F.lit("").alias("text"))
    return plain_files.unionByName(rtf_files).unionByName(word_files).unionByName(others)


def with_texts(manifest: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """The manifest with ``text``: of its file, found under ``folder`` unless its path is absolute; else the description.

    ``files`` has path and text. A file that is missing, empty or unreadable counts as empty.
    """
    full = F.when(F.col("file_path").startswith("/"), F.col("file_path")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), "file_path"))
    bare = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "%20", " ")
    own = files.select(bare.alias("_at"), F.col("text").alias("_text")).groupBy("_at").agg(F.max("_text").alias("_text"))
    joined = manifest.withColumn("_full", full).join(own, F.col("_full") == F.col("_at"), "left")
    text = F.when(F.trim(F.coalesce("_text", F.lit(""))) == "", F.col("description")).otherwise(F.col("_text"))
    return joined.withColumn("text", text).drop("_full", "_at", "_text")


def write_manifest(records: DataFrame, path: str) -> None:
    """Records as JSON lines, read by ``read_manifest`` as well as an array is."""
    records.select("title", "file_path", "description", "keywords").write.mode("overwrite").json(path)


ANNOTATION = "chunk_type string, summary string, entities array<struct<name:string,type:string>>, relationships array<map<string,string>>, tags array<string>, candidate_qas array<map<string,string>>"


def annotation_json(entities: Column, tags: Column | None = None, relationships: Column | None = None) -> Column:
    """An annotation as JSON."""
    none = F.array().cast("array<string>")
    maps = F.array().cast("array<map<string,string>>")
    return F.to_json(F.struct(F.lit("other").alias("chunk_type"), F.lit(None).cast("string").alias("summary"), entities.alias("entities"), (relationships if relationships is not None else maps).alias("relationships"), (tags if tags is not None else none).alias("tags"), maps.alias("candidate_qas")))


def read_annotation(text: Column) -> Column:
    """An annotation from JSON: nameless entities go, types are upper case and OTHER where there is none."""
    raw = F.from_json(text, ANNOTATION)
    lists = lambda name, kind: F.filter(F.coalesce(raw[name], F.array().cast(kind)), lambda x: x.isNotNull()).alias(name)
    entities = F.filter(F.transform(F.coalesce(raw["entities"], F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.struct(F.trim(F.coalesce(e["name"], F.lit(""))).alias("name"), F.upper(F.trim(F.coalesce(e["type"], F.lit("OTHER")))).alias("type"))), lambda e: e["name"] != "")
    maps = "array<map<string,string>>"
    return F.struct(F.trim(F.coalesce(raw["chunk_type"], F.lit("other"))).alias("chunk_type"), F.trim(raw["summary"]).alias("summary"), entities.alias("entities"), lists("relationships", maps), lists("tags", "array<string>"), lists("candidate_qas", maps))


def settings_key(size: int, overlap: int, mode: str = "context") -> str:
    """What a cache entry depends on besides the text."""
    return f"{mode}:{size}:{overlap}"


def worklist(rows: DataFrame, cache: DataFrame, settings: str | None = None) -> DataFrame:
    """Rows (key, text) whose text digest, under these settings if given, the cache (key, text_hash[, settings]) doesn't hold."""
    hashed = rows.withColumn("text_hash", F.sha1(F.coalesce("text", F.lit("")).cast("binary")))
    valid = cache if settings is None else cache.where(F.col("settings") == settings)
    return hashed.join(valid.select("key", "text_hash"), ["key", "text_hash"], "left_anti")
