"""Brown perplexity, chat, quality, URL and pipeline operators against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from trovewise.llm import brown, chat, quality, url_filter, words

DOCS = "doc_id long, text string, lang string, tw_key string, n_chars long"


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def same(df, sql, **tables):
    names, want = duck(sql, **tables)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_words_match_a_plain_splitter():
    rng = random.Random(3)
    texts = ["".join(rng.choices("aB9 é\n-'日。 «»…_x", k=rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    w = words.split(pa.array(texts))
    for i, text in enumerate(texts):
        own = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.offsets[i] : w.offsets[i + 1]], w.ends[w.offsets[i] : w.offsets[i + 1]])]
        assert own == re.findall("(?:[a-z0-9]|[^\x00-\x7f\x80-\xbf -⁯　-。])+", (text or "").lower())
    by_hash = {}
    for h, a, b in zip(w.hashes.tolist(), w.starts, w.ends):
        assert by_hash.setdefault(h, bytes(w.data[a:b])) == bytes(w.data[a:b])


def test_perplexity_against_a_plain_count(spark):
    texts = ["a b a c", "a b", None, "", "c c d e " * 50, "a b"]
    docs = spark.createDataFrame([(i if i else None, t, "x", "k", 0) for i, t in enumerate(texts)], DOCS)
    got = {(r.doc_id, r.n_words): r for r in brown.perplexity(docs, vocabulary=4, classes=2).collect()}
    assert len(got) == 6 and got[3, 0].perplexity is None and got[2, 0].log_prob == got[3, 0].log_prob
    m = brown.model(docs, 4, 2)
    number = {words.word_hash(w): w for w in "abcde"}
    id_of = {number[int(h)]: int(i) for h, i in zip(m["known"], m["ids"])}
    rare, end = len(id_of), len(id_of) + 1
    streams = [[end, *[id_of.get(w, rare) for w in (t or "").split()], end] for t in texts]
    of = m["of"]
    moves, n, k = {}, {}, int(of.max()) + 1
    for s in streams:
        for x, y in zip(s, s[1:]):
            moves[of[x], of[y]] = moves.get((of[x], of[y]), 0) + 1
            n[y] = n.get(y, 0) + 1
    size = {c: sum(v for w, v in n.items() if of[w] == c) for c in range(k)}
    for i, s in enumerate(streams):
        log = 0.0
        for x, y in zip(s, s[1:]):
            total = sum(moves.get((of[x], c), 0) for c in range(k))
            log += math.log((moves.get((of[x], of[y]), 0) + 0.1) / (total + 0.1 * k))
            log += 0 if y == end else math.log(1 / 2) if y == rare else math.log(n[y] / size[of[y]])
        assert got[i if i else None, len(s) - 2].log_prob == pytest.approx(log)


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 12, (200, 2)), axis=0)
    left, right, count = pairs[:, 0], pairs[:, 1], rng.integers(1, 9, len(pairs))

    def likelihood(of):
        k = of.max() + 1
        m = np.zeros((k, k))
        np.add.at(m, (of[left], of[right]), count)
        return brown._xlogx(m).sum() - brown._xlogx(m.sum(1)).sum() - brown._xlogx(m.sum(0)).sum()

    found = [likelihood(brown.exchange(left, right, count, 10, 3, s)) for s in (0, 1, 2, 5)]
    assert all(b >= a - 1e-9 for a, b in zip(found, found[1:])) and found[-1] > found[0]
    of = brown.exchange(left, right, count, 10, 3, 50)
    for w in range(10):
        for c in range(3):
            assert likelihood(np.where(np.arange(12) == w, c, of)) <= likelihood(of) + 1e-6


def test_exchange_separates_two_kinds_of_words(spark):
    rng = random.Random(5)
    nouns, verbs = [f"n{i}" for i in range(6)], [f"v{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, " ".join(x for _ in range(20) for x in (rng.choice(nouns), rng.choice(verbs)))) for i in range(30)], "doc_id long, text string")
    m = brown.model(docs, 12, 2)
    of = {int(h): int(m["of"][i]) for h, i in zip(m["known"], m["ids"])}
    assert len({of[words.word_hash(x)] for x in nouns}) == len({of[words.word_hash(x)] for x in verbs}) == 1


def test_gains_are_those_of_one_word_at_a_time():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 30, (7, 7)).astype(float)
    row, column = rng.integers(0, 3, (2, 40, 7)).astype(float)
    row[:, 5] += 1
    column[:, 6] += 1
    got = brown._gains(pairs, row, column, 5)
    assert np.allclose(got, [brown._gain(pairs, r, c, 0.0, 5) for r, c in zip(row, column)])


def test_perplexity_keeps_words_beyond_the_head(spark):
    rng = random.Random(11)
    kinds = [f"{c}{i}" for c in "xyz" for i in range(40)]
    texts = [" ".join(k for _ in range(rng.randint(0, 30)) for k in rng.choices(kinds, weights=[1 / (i % 40 + 1) for i in range(120)])) for _ in range(60)]
    texts[7], texts[8] = None, "once twice twice"
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    plain = [(t or "").split() for t in texts]
    count = Counter(w for t in plain for w in t)
    top = sorted(count, key=lambda w: (-count[w], np.uint64(words.word_hash(w)).view(np.int64)))[:20]
    number = {w: i for i, w in enumerate(top)}
    streams = [[21, *[number.get(w, 20) for w in t], 21] for t in plain]
    pairs = Counter(p for s in streams for p in zip(s, s[1:]))
    left, right, n = (np.array(x) for x in zip(*[(a, b, v) for (a, b), v in sorted(pairs.items())]))
    of = brown.exchange(left, right, n, 20, 4, 8)
    matrix = np.zeros((6, 6))
    np.add.at(matrix, (of[left], of[right]), n)
    own = {w: of[i] for w, i in number.items()}
    for w in set(count) - set(top):
        row, column = np.zeros(6), np.zeros(6)
        for t, s in zip(plain, streams):
            for i, x in enumerate(t):
                if x == w:
                    column[of[s[i]]] += 1
                    row[of[s[i + 2]]] += 1
        own[w] = int(np.argmax(brown._gain(matrix, row, column, 0.0, 4)))
    chains = [[4, *[own[w] for w in t], 4] for t in plain]
    moves = Counter(p for c in chains for p in zip(c, c[1:]))
    total, size = Counter(), Counter()
    for (a, b), v in moves.items():
        total[a] += v
        size[b] += v
    got = {r.doc_id: r for r in brown.perplexity(docs, classes=4, head=20).collect()}
    assert len(got) == 60 and got["d7"].perplexity is None and got["d7"].n_words == 0
    for i, (t, c) in enumerate(zip(plain, chains)):
        want = sum(math.log((moves[p] + 0.1) / (total[p[0]] + 0.5)) for p in zip(c, c[1:])) + sum(math.log(count[w] / size[own[w]]) for w in t)
        assert got[f"d{i}"].log_prob == pytest.approx(want) and got[f"d{i}"].n_words == len(t)
        assert not t or got[f"d{i}"].perplexity == pytest.approx(math.exp(-want / (len(t) + 1)))


def test_perplexity_of_nothing(spark):
    assert brown.perplexity(spark.createDataFrame([], DOCS)).isEmpty()
    assert brown.perplexity(spark.createDataFrame([(1, None, "x", "k", 0)], DOCS)).count() == 1


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", ""), (3, 0, "user", "a"), (3, 1, "user", "b"), (4, 0, "user", "x"), (5, 0, "assistant", "x"),
    (6, 0, "user", "a"), (6, 0, "user", "a"), (6, 1, "assistant", "b"), (7, 0, "user", "a"), (7, 0, "user", "b"), (8, None, "user", "a"), (9, 0, None, "a"), (10, 0, "tool", "a"), (None, 0, "user", "q"), (None, 1, "assistant", "r"),
    (11, 3, "assistant", "late"), (11, 1, "user", "early"),
]


def test_chat_segments(spark):
    convs = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    same(chat.segments(convs), chat.oracle(), conversations=convs)
    got = {c: [(r.text, r.loss) for r in chat.segments(convs).orderBy("segment").collect() if r.conv_id == c] for c in (1, 2, 11)}
    assert got[1] == [("<|user|>\n", 0), ("hi", 0), ("<|end|>\n", 0), ("<|assistant|>\n", 0), ("yo", 1), ("<|end|>\n", 1)]
    assert got[2][4] == ("", 0) and got[11][1] == ("early", 0)
    reasons = {r.conv_id: r.reason for r in chat.segments(convs).filter("not valid").collect()}
    assert reasons == {3: "user after user", 4: "ends after user", 5: "assistant after start", 7: "turn 0 is repeated", 8: "a turn is null", 9: "null after start", 10: "tool after start"}
    assert chat.segments(convs.limit(0)).isEmpty()


def test_quality_against_sql_and_edges(spark):
    good = " ".join(["The cat sat on the mat and looked at it."] * 3)
    texts = [f"{good}\nLine {i} of the text is of this kind.\nAnd that is it." for i in range(30)] + ["### $$$ %%% " * 40] * 10 + ["ABC!! DEF!! " * 30, None, "", "\n\n", "x" * 5000]
    docs = spark.createDataFrame([(i, t, "x", "k", 0) for i, t in enumerate(texts)], DOCS)
    got = {r[names.index("doc_id")]: r for names in [duck(quality.oracle(), documents=docs)[0]] for r in same(quality.quality(docs), quality.oracle(), documents=docs)}
    keep = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert len(got) == 45 and keep >= set(range(30)) and not keep & set(range(30, 40))
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality(docs.limit(0)).isEmpty()


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in out) > 0.9 * len(out)


PAGES = [
    (1, "http://a.x.com/en/1"), (2, "http://a.x.com/en/2"), (3, "http://b.x.com/en/3"), (4, "https://u:p@C.Y.co.uk:80/de/4?q"), (5, None), (6, "not a url"), (7, "http://10.0.0.1/en/7"), (8, "http://b.x.com/en/8"), (9, "http://b.x.com/en/9"),
    (9, "http://b.x.com/en/9"), (10, "http://z.net./"),
]


def test_url_filter_against_sql_and_edges(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in PAGES], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (8, 0), (9, 1), (9, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = same(url_filter.filter_pages(pages, labels), url_filter.ORACLE, pages=pages, labels=labels)
    assert len(got) == len(PAGES)
    rows = {r.page_id: r for r in url_filter.filter_pages(pages, labels).collect()}
    assert (rows[4].host, rows[4].domain, rows[4].suffix) == ("c.y.co.uk", "y.co.uk", "co.uk") and (rows[7].domain, rows[7].suffix) == ("10.0.0.1", "ip") and rows[5].host == ""
    assert rows[1]["mean"] > rows[10]["mean"] > rows[3]["mean"]
    nothing = url_filter.filter_pages(pages, labels.limit(0)).collect()
    assert {r["mean"] for r in nothing} == {0.5} and url_filter.filter_pages(pages.limit(0), labels).isEmpty()
