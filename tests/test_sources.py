import gzip
import struct

import pytest
from pyspark.sql import functions as F

from trovewise.operators import index as ix
from trovewise.operators import search
from trovewise.sources import collections, indexes, runs
from trovewise.streaming import ingest


def put(path, content):
    (path.write_bytes if isinstance(content, bytes) else path.write_text)(content)
    return str(path)


def test_plaintext_and_jsonl(spark, tmp_path):
    got = collections.plaintext(spark, put(tmp_path / "p", "a first text\n\nb\tx\n")).collect()
    assert [(r.title, r.content) for r in got] == [("a", "first text"), ("b", "x")]
    got = collections.read(spark, put(tmp_path / "j", '{"title":"t","content":"c","url":"u"}\n{"title":"s","content":"d"}\n'), "jsonl").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, "s", "d", None), (1, "t", "c", "u")]
    with pytest.raises(ValueError):
        collections.read(spark, "x", "other")


def test_trec_texts(spark, tmp_path):
    text = "<DOC>\n<DOCNO> D1 </DOCNO>\n<TEXT>one\ntwo</TEXT>\n</DOC>\n<DOC>\nbad\n</DOC>\n"
    got = collections.trectext(spark, put(tmp_path / "t", text)).collect()
    assert [(r.title, r.content) for r in got] == [("D1", "<TEXT>one\ntwo</TEXT>")]
    web = "<DOC>\n<DOCNO>W1</DOCNO>\n<DOCHDR>\nhttp://x/ 1\n</DOCHDR>\n<b>hi</b>\n</DOC>\n<DOC><DOCNO>W2</DOCNO></DOC>"
    assert [tuple(r) for r in collections.trecweb(spark, put(tmp_path / "w", web)).collect()] == [("W1", "<b>hi</b>", "http://x/")]


def test_warc(spark, tmp_path):
    def record(kind, body, extra=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <r>\r\nWARC-Target-URI: http://x\r\n{extra}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    data = (record("warcinfo", "x") + record("response", "HTTP/1.1\r\n\r\nhey", "WARC-TREC-ID: T1\r\n") + record("response", "b")).encode()
    for name, content in (("a.warc", data), ("b.warc", gzip.compress(data))):
        got = collections.warc(spark, put(tmp_path / name, content)).collect()
        assert [(r.title, r.url) for r in got] == [("T1", "http://x"), ("<r>", "http://x")]


def test_wapo_and_files(spark, tmp_path):
    line = '{"id":"1","article_url":"u","contents":[{"type":"kicker","content":"K"},null,{"type":"author_info","name":"N","bio":"B"},{"type":"image","fullcaption":"C"},{"type":"video"}]}'
    assert tuple(collections.wapo(spark, put(tmp_path / "w", line)).first()) == ("1", "K\nN B\nC", "u")
    assert collections.files(spark, str(tmp_path)).count() == 1


def test_binary_sequences(spark, tmp_path):
    path = put(tmp_path / "b", struct.pack("<6I", 1, 9, 3, 1, 2, 3))
    got = collections.binary_sequences(spark, path)
    assert [r["values"] for r in got.orderBy("idx").collect()] == [[9], [1, 2, 3]]
    lexicon = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "term_id long, term string")
    assert collections.entries(got, 1, 1, lexicon).first().terms == ["a", "b", "c"]


def test_ciff(spark, tmp_path):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def number(n, v):
        return bytes([n << 3, v])

    def whole(m):
        return bytes([len(m)]) + m

    head = number(1, 1) + number(2, 1) + number(3, 1)
    posting = field(1, b"t") + number(2, 2) + number(3, 3) + field(4, number(1, 1) + number(2, 1)) + field(4, number(1, 2) + number(2, 2))
    doc = number(1, 3) + field(2, b"D") + number(3, 7)
    postings, docs = collections.ciff(spark, put(tmp_path / "c", whole(head) + whole(posting) + whole(doc)))
    assert [tuple(r) for r in postings.collect()] == [("t", 1, 1), ("t", 3, 2)] and tuple(docs.first()) == (3, "D", 7)


def test_topics_and_logs(spark, tmp_path):
    text = "<top>\n<num> Number: 301\n<title> a\nb\n<desc> Description:\nd e\n<narr> Narrative:\nn\n</top>\n<top><num>302</num><title>x</title><desc>y</desc><narr>z</narr></top>\n"
    got = collections.trec_topics(spark, put(tmp_path / "t", text)).collect()
    assert [tuple(r) for r in got] == [("301", "a b", "d e", "n"), ("302", "x", "y", "z")]
    assert collections.topic_queries(spark.createDataFrame(got)).first().query == "301:a b"
    with pytest.raises(Exception, match="lacks narr"):
        collections.trec_topics(spark, put(tmp_path / "u", "<top><num>1</num><title>x</title><desc>y</desc></top>")).collect()
    log = "1\tb\t2\t3\t4\n1\t-\t2\t3\t4\n2\ta\t1\t1\n2\ta\t1\t1\nshort\tx\n"
    assert [r.query for r in collections.query_log(spark, put(tmp_path / "l", log), unique=True).collect()] == ["a", "b"]


def test_indexes_and_runs(spark, tmp_path):
    index = ix.build(spark.createDataFrame([(0, "a b a"), (1, "b c")], "doc_id long, text string"))
    path = str(tmp_path / "i")
    indexes.save(index, path, "ef", check=True)
    assert indexes.differing(index.terms, indexes.load(spark, path).terms).isEmpty()
    assert indexes.about(spark, path)["encoding"] == "ef" and indexes.size_stats(spark, path)["postings"] == 4
    indexes.save(index, str(tmp_path / "q"), quantize_bits=8, scorer="bm25")
    assert indexes.load(spark, str(tmp_path / "q")).postings.agg(F.max("value")).first()[0] == 255
    with pytest.raises(ValueError):
        indexes.save(index, path, "none")
    own = spark.createDataFrame([(1, "c", 1.0)], "qid long, term string, weight double")
    runs.write(search.ranked_or(own, ix.scored(index)), str(tmp_path / "r"), "me")
    assert [(r.qid, r.doc, r["rank"], r.run) for r in runs.read(spark, str(tmp_path / "r")).collect()] == [("1", "1", 1, "me")]
    assert runs.read_thresholds(spark, put(tmp_path / "th", "0.5\n"), own).first().threshold == 0.5
    with pytest.raises(ValueError):
        runs.read_thresholds(spark, put(tmp_path / "th2", "0.5\n1\n"), own)


def test_streaming_ingest(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    for batch in ([(0, "a b"), (1, "b")], [(1, "c c"), (2, "")]):
        spark.createDataFrame(batch, ingest.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark.readStream.schema(ingest.SCHEMA).parquet(source), out, str(tmp_path / "c")).awaitTermination()
    index = ingest.index(spark, out)
    assert sorted((r.term, r.doc_id, r.tf) for r in index.postings.collect()) == [("a", 0, 1), ("b", 0, 1), ("c", 1, 2)]
    assert index.docs.count() == 3
