"""Readers of document collections, as (title, content, url), and of binary collections and topics.

Text formats are cut into records by Spark's own reader, so that files are split among tasks; only archives of web
responses and length-prefixed binaries are parsed in Python, a file a task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import dense_ids


def plaintext(spark: SparkSession, path: str) -> DataFrame:
    """A line is a title, white space and the content."""
    part = lambda k: F.regexp_extract("value", r"(?s)^\s*(\S+)\s*(.*)$", k)
    return spark.read.text(path).select(part(1).alias("title"), part(2).alias("content"), F.lit(None).cast("string").alias("url")).filter("title <> ''")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("title string, content string, url string").json(path)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _tag(text: Column, name: str, group: str = ".*?") -> Column:
    return F.regexp_extract(text, rf"(?is)<{name}>\s*({group})\s*</{name}>", 1)


def trectext(spark: SparkSession, path: str) -> DataFrame:
    """<DOC> records with a <DOCNO>; those without one are left out."""
    text = F.regexp_replace("value", r"(?is)^.*?<DOC>", "")
    content = F.regexp_replace(text, r"(?is)^.*?</DOCNO>\s*", "")
    own = spark.read.text(path, lineSep="</DOC>").filter(F.col("value").rlike("(?is)<DOC>"))
    return own.select(_tag(text, "DOCNO").alias("title"), _trimmed(content).alias("content"), F.lit(None).cast("string").alias("url")).filter("title <> ''")


def trecweb(spark: SparkSession, path: str) -> DataFrame:
    """As trectext, with a <DOCHDR> whose first line is the url; records without either are left out."""
    text = F.regexp_replace("value", r"(?is)^.*?<DOC>", "")
    url = F.regexp_extract(text, r"(?is)<DOCHDR>\s*(\S+)", 1)
    content = F.regexp_replace(text, r"(?is)^.*?</DOCHDR>\s*", "")
    own = spark.read.text(path, lineSep="</DOC>").filter(F.col("value").rlike("(?is)<DOC>.*</DOCHDR>"))
    return own.select(_tag(text, "DOCNO").alias("title"), _trimmed(content).alias("content"), url.alias("url")).filter("title <> '' AND url <> ''")


def warc_records(data: bytes) -> Iterator[tuple[str, str, str | None]]:
    """(title, content, url) of the responses in an archive; the title is the TREC id, else the record's own."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        try:
            size = int(head.get("content-length", ""))
        except ValueError:
            at = end
            continue
        body = data[end + 4 : end + 4 + size]
        title = head.get("warc-trec-id") or head.get("warc-record-id")
        if head.get("warc-type") == "response" and title and len(body) == size:
            yield title, body.decode("utf-8", "replace"), head.get("warc-target-uri")
        at = end + 4 + size


def warc(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for frame in frames:
            for data in frame["content"]:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = list(warc_records(data))
                yield pd.DataFrame(rows, columns=["title", "content", "url"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "title string, content string, url string")


def wapo(spark: SparkSession, path: str) -> DataFrame:
    """News articles in JSON: kicker, title, byline, texts, authors' names and lives, and captions of images, joined."""
    part = "struct<type:string,content:string,kicker:string,fullcaption:string,blurb:string,bio:string,name:string>"
    own = spark.read.schema(f"id string, article_url string, title string, contents array<{part}>").json(path)

    def said(x: Column) -> Column:
        plain = F.when(x["type"].isin("kicker", "title", "byline", "sanitized_html"), x["content"])
        author = F.when(x["type"] == "author_info", F.concat_ws(" ", x["name"], x["bio"]))
        image = F.when(x["type"] == "image", F.concat_ws(" ", x["fullcaption"], x["blurb"]))
        return F.coalesce(plain, author, image, F.lit(""))

    texts = F.filter(F.transform("contents", said), lambda t: t != "")
    return own.filter(F.col("id").isNotNull()).select(F.col("id").alias("title"), F.array_join(texts, "\n").alias("content"), F.col("article_url").alias("url"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a folder as a document, named by its path."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return own.select(F.col("path").alias("title"), F.decode("content", "UTF-8").alias("content"), F.lit(None).cast("string").alias("url"))


FORMATS = {"plaintext": plaintext, "jsonl": jsonl, "trectext": trectext, "trecweb": trecweb, "warc": warc, "wapo": wapo, "files": files}


def read(spark: SparkSession, path: str, format: str = "plaintext") -> DataFrame:
    """(doc_id, title, content, url): the documents numbered by title."""
    if format not in FORMATS:
        raise ValueError(f"unknown format: {format}; known: {', '.join(FORMATS)}")
    return dense_ids(FORMATS[format](spark, path), ["title"], "doc_id").select("doc_id", "title", "content", "url")


def binary_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, values) of files of sequences, each a 32-bit length and as many 32-bit numbers, little-endian."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                rows, at = [], 0
                while at + 4 <= len(data):
                    (n,) = struct.unpack_from("<I", data, at)
                    if at + 4 + 4 * n > len(data):
                        raise ValueError(f"{name}: a sequence goes beyond the end")
                    rows.append((name, len(rows), list(struct.unpack_from(f"<{n}I", data, at + 4))))
                    at += 4 + 4 * n
                yield pd.DataFrame(rows, columns=["path", "idx", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, idx long, values array<long>")


def entries(sequences: DataFrame, first: int, last: int, lexicon: DataFrame | None = None) -> DataFrame:
    """The sequences from number first to last inclusive; with a lexicon (term, term_id), as terms."""
    own = sequences.filter(F.col("idx").between(first, last))
    if lexicon is None:
        return own
    parts = own.select("idx", F.posexplode("values").alias("pos", "term_id")).join(lexicon, "term_id")
    return parts.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("all")).select("idx", F.col("all.term").alias("terms"))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _message(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message: numbers, or bytes."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif key & 7 == 1:
            (value,), at = struct.unpack_from("<d", data, at), at + 8
        else:
            raise ValueError(f"wire type {key & 7}")
        out.setdefault(key >> 3, []).append(value)
    return out


def ciff_rows(data: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[int, str, int]]]:
    """Postings (term, doc_id, tf) and documents (doc_id, title, doc_len) of a file in the common index format."""

    def messages() -> Iterator[bytes]:
        at = 0
        while at < len(data):
            n, at = _varint(data, at)
            yield data[at : at + n]
            at += n

    own = messages()
    head = _message(next(own))
    postings, docs = [], []
    for _ in range(head.get(2, [0])[0]):
        m = _message(next(own))
        doc = 0
        for p in m.get(4, []):
            x = _message(p)
            doc += x.get(1, [0])[0]
            postings.append((m[1][0].decode(), doc, x.get(2, [0])[0]))
    for _ in range(head.get(3, [0])[0]):
        m = _message(next(own))
        docs.append((m.get(1, [0])[0], m.get(2, [b""])[0].decode(), m.get(3, [0])[0]))
    return postings, docs


def ciff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(term, doc_id, tf) and (doc_id, title, doc_len) of files in the common index format."""

    def run(part: int, columns: list[str]):
        def frames(given: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in given:
                for data in frame["content"]:
                    yield pd.DataFrame(ciff_rows(data)[part], columns=columns)

        return frames

    own = spark.read.format("binaryFile").load(path).select("content")
    return own.mapInPandas(run(0, ["term", "doc_id", "tf"]), "term string, doc_id long, tf long"), own.mapInPandas(run(1, ["doc_id", "title", "doc_len"]), "doc_id long, title string, doc_len long")


def trec_topics(spark: SparkSession, path: str) -> DataFrame:
    """(num, title, desc, narr) of <top> blocks; closing tags may be missing. Raises where a block lacks a part."""
    text = F.regexp_replace("value", r"(?is)^.*?<top>", "")

    def part(name: str, label: str) -> Column:
        body = F.regexp_extract(text, rf"(?is)<{name}>\s*(?:{label}:?)?(.*?)(?=<(?:num|title|desc|narr)>|</{name}>|$)", 1)
        return F.when(text.rlike(rf"(?is)<{name}>"), F.trim(F.regexp_replace(body, r"[\s]+", " "))).otherwise(F.raise_error(F.lit(f"a topic lacks {name}")))

    own = spark.read.text(path, lineSep="</top>").filter(F.col("value").rlike("(?i)<top>"))
    return own.select(part("num", "Number").alias("num"), part("title", "Topic").alias("title"), part("desc", "Description").alias("desc"), part("narr", "Narrative").alias("narr"))


def topic_queries(topics: DataFrame, part: str = "title") -> DataFrame:
    """(query): number, colon and a part of the topic, without what a query can't have."""
    return topics.select(F.concat_ws(":", "num", part).alias("query"))


def query_log(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """(query) of a log of searches, tab-separated with the query second; empty ones and '-' are left out. unique also sorts."""
    parts = F.split("value", "\t")
    own = spark.read.text(path).filter(F.size(parts) > 3).select(parts[1].alias("query")).filter(~F.col("query").isin("", "-", "Query"))
    return own.distinct().orderBy("query") if unique else own
