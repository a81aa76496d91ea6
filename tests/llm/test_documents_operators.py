"""Near and line dedup, decontamination, toxicity, BPE, packing and the pipeline against brute force, and their edge cases."""

import base64
import itertools
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from trovewise.llm import bpe, decontaminate, line_dedup, near_dedup, packing, queries, shared, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, tw_key string, n_chars long"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = "lorem ipsum " * 20_000


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "k", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def grams(text):
    own = re.findall(r"[a-z0-9À-῿⁰-⿿〃-￿]+", (text or "").lower())
    return {tuple(own[i : i + 3]) for i in range(max(1, len(own) - 2))} if own else set()


def groups_of(texts, threshold=0.5):
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def near_copies(rng, n_groups=25):
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n_groups):
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("leaf", [1000, 6])
def test_near_duplicates_against_all_pairs(spark, leaf):
    texts = near_copies(random.Random(leaf))
    want = groups_of(texts)
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs_of(spark, texts), leaf=leaf).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert all(want[i] == want[got[i]] for i in range(len(texts)))


def test_near_duplicates_lose_no_pair_at_the_threshold(spark):
    """Pairs whose similarity is the threshold itself are groups, and those just below it are none."""
    texts = []
    for g in range(1200):
        base = [f"g{g}w{k}" for k in range(65)]
        cut = 21 if g % 6 else 22  # of 63 grams each, 42 of 84 and 41 of 85 are common
        texts += [" ".join(base), " ".join([*base[:-cut], *(f"g{g}n{k}" for k in range(cut))])]
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: i - 1 if i % 2 and i // 2 % 6 else i for i in range(len(texts))}


def test_near_duplicates_at_thresholds_that_have_no_exact_double(spark):
    """55 of 100 grams is a similarity of 0.55, though 0.55 * 100 is more than 55 in doubles; 55 of 101 isn't."""
    texts = []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(79)]
        texts += [" ".join(base), " ".join([*base[:57], *(f"g{g}n{k}" for k in range(23 + g % 2))])]
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs_of(spark, texts), threshold=0.55).collect()}
    assert got == {i: i - 1 if i % 2 and i // 2 % 2 == 0 else i for i in range(len(texts))}


def test_near_duplicates_compare_few_that_share_common_passages(spark, monkeypatch):
    """Documents are compared for the rarest grams they share: here two have a rare passage, and ten each a common one."""
    n = 6000
    texts = [" ".join(f"{name}w{k}" for name, size in ((f"o{i}", 64), (f"r{i // 2}", 12), (f"c{i % 600}", 58)) for k in range(size)) for i in range(n)]
    rows, plain = {}, near_dedup.written

    def counted(df, name):
        out = plain(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    got = near_dedup.near_duplicates(docs_of(spark, texts)).collect()
    assert len(got) == n and all(r.group_id == r.doc_id for r in got)
    assert rows["sets"] == n and rows["cross"] <= n // 2


def test_descriptions_of_plans_stay_short(spark, documents):
    """The driver keeps a description of each plan; those of token encoding hold the whole vocabulary if nothing ends them."""
    assert len(bpe.add_tokens(documents)._jdf.queryExecution().toString()) < 100_000


def test_descriptions_of_nodes_stay_short(spark, documents):
    """Each execution is announced with a description of every node, which the driver keeps; a length of the plan's text doesn't end them."""

    def letters(info):
        return len(info.simpleString()) + sum(letters(info.children().apply(k)) for k in range(info.children().size()))

    plan = bpe.add_tokens(documents)._jdf.queryExecution().executedPlan()
    assert letters(spark._jvm.org.apache.spark.sql.execution.SparkPlanInfo.fromSparkPlan(plan)) < 20_000


def test_near_duplicates_take_few_executions(spark):
    """The driver keeps the plans of each execution; most were rounds of components, of which a few links need none."""
    store = spark._jsparkSession.sharedState().statusStore()
    texts = near_copies(random.Random(5), 8)
    got, counts = [], []
    for together in (1_000_000, 0):
        spark.range(1).count()
        before = store.executionsList().last().executionId()
        got.append(sorted((r.doc_id, r.group_id, r.links) for r in near_dedup.near_duplicates(docs_of(spark, texts), together=together).collect()))
        counts.append(store.executionsList().last().executionId() - before)
    assert got[0] == got[1] and counts[0] <= 45 < counts[1], counts


def test_components_in_one_task_are_those_of_rounds(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(-900, 900), rng.randint(-900, 900)) for _ in range(700)] + [(k, k + 1) for k in range(2000, 2300)] + [(5000, k) for k in range(4000, 4100)]
    edges = spark.createDataFrame([*pairs, *pairs[:50]], "a long, b long")
    found = [sorted(map(tuple, near_dedup.components(edges, together).collect())) for together in (True, False)]
    assert found[0] == found[1] and {2000: 2000, 2300: 2000, 5000: 4000}.items() <= dict(found[0]).items()


def test_components_in_one_task_take_little_memory():
    rng = np.random.default_rng(7)
    batches = [pa.record_batch({"a": pa.array(rng.integers(-(2**62), 2**62, 2000)), "b": pa.array(rng.integers(-(2**62), 2**62, 2000))}) for _ in range(500)]
    tracemalloc.start()
    assert sum(b.num_rows for b in near_dedup._roots(iter(batches))) == 2_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6


def test_freed_native_memory_of_the_driver_can_be_given_back(spark):
    assert shared._trim(spark)


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Work on a group of near copies grows as the group: with twice as many documents about twice as many rows are compared."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    texts = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i in range(1600) for k in [rng.randrange(60)]]
    rows, plain = [], near_dedup.written

    def counted(df, name):
        out = plain(df, name)
        if name in ("entries", "compared", "contracted"):
            rows[-1] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    for n in (800, 1600):
        rows.append(0)
        got = near_dedup.near_duplicates(docs_of(spark, texts[:n]), leaf=50, block=20).collect()
        assert {(r.group_id, r.group_size) for r in got} == {(0, n)} and all(r.links for r in got)
    assert rows[1] < 2.5 * rows[0]


def test_near_duplicates_edges(spark):
    texts = ["a b c d", "a b c d", None, "", "!!", "a b c d", LONG, LONG + "x", "one", "one"]
    docs = docs_of(spark, texts, [3, 2, 1, 4, 5, None, 6, 7, 8, 8])
    rows = near_dedup.near_duplicates(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.group_id, []).append((r.doc_id, r.keep))
    assert sorted(by[2], key=str) == [(2, True), (3, False), (None, False)]
    assert all(by[k] == [(k, True)] for k in (1, 4, 5, 8)) and sorted(by[6]) == [(6, True), (7, False)]
    clash = docs.withColumn("tw_drop", F.lit(1)).withColumn("TW_GONE", F.lit(True))
    for few in (1_000_000, 0):
        kept = near_dedup.drop_near_duplicates(clash, broadcast_rows=few)
        assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6, 8]
    assert near_dedup.near_duplicates(docs.limit(0)).isEmpty()


def lines_by_hand(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        keep = []
        for line in text.split("\n"):
            key = line.strip(" \t\r")
            if not key or key not in seen:
                keep.append(line)
            seen.add(key)
        out[i] = ("\n".join(keep), text.count("\n") + 1, text.count("\n") + 1 - len(keep))
    return out


@pytest.mark.parametrize("bits,sent", [(16, 1 << 26), (1, 1 << 26), (16, 0)])
def test_line_dedup_against_hand(spark, bits, sent):
    rng = random.Random(bits)
    texts = ["\n".join(rng.choice([" ", "", "\t"]) + rng.choice("abcdefghijklmnop") * rng.randint(0, 30) for _ in range(rng.randint(0, 9))) for _ in range(200)] + [None, "", "\n", LONG + "\n" + LONG]
    want = lines_by_hand(list(enumerate(texts)))
    how = {"bits": bits, "max_bits": 1 << 10 if bits == 1 else 1 << 31, "broadcast_bytes": sent}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicate_lines(docs_of(spark, texts), **how).collect()}
    assert got == want
    kept = line_dedup.drop_repeated_lines(docs_of(spark, texts), **how)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, (t, n, gone) in want.items() if not gone or t.strip()}
    assert all(r.n_chars == len(r.text or "") for r in kept.collect()) and kept.columns[-1] == "n_chars"


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_line_dedup_keeps_clashing_columns(spark, sent):
    docs = spark.createDataFrame([(1, "a\nb", "k", 5, True), (2, "a", "l", 6, False)], "doc_id long, text string, tw_key string, tw_uid int, TW_gone boolean")
    kept = line_dedup.drop_repeated_lines(docs, broadcast_bytes=sent)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a\nb", "k", 5, True)]


def test_line_dedup_edges(spark):
    docs = docs_of(spark, ["a", "a", "b", "b"], [None, 1, 2, 2])
    assert sorted(((r.doc_id, r.text) for r in line_dedup.deduplicate_lines(docs).collect()), key=str) == [(1, ""), (2, "b"), (2, "b"), (None, "a")]
    assert line_dedup.deduplicate_lines(docs.limit(0)).isEmpty()


def runs_by_hand(text, items, most=8, least=4, coverage=0.8):
    """Marks every word that belongs to a run that is long, or covers enough of an item."""
    found = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9À-ɏ]+", text)]
    mark = [False] * len(found)
    for item in items:
        own = re.findall(r"[a-z0-9à-ɏ]+", item.lower())
        for i in range(len(found)):
            for j in range(len(own)):
                n = 0
                while i + n < len(found) and j + n < len(own) and found[i + n][0] == own[j + n]:
                    n += 1
                if n >= least and (n >= most or n >= coverage * len(own)):
                    mark[i : i + n] = [True] * n
    out, at = [], 0
    spans, i = [], 0
    while i < len(found):
        if mark[i]:
            j = i
            while j + 1 < len(found) and mark[j + 1]:
                j += 1
            spans.append((found[i][1], found[j][2]))
            i = j
        i += 1
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:], spans


def test_decontamination_against_hand(spark):
    rng = random.Random(2)
    words = ["tau", "über", "rho", "pi", "Sig", "mu"]
    items = [" ".join(rng.choices(words, k=rng.randint(3, 14))) for _ in range(12)] + ["", "tau"]
    texts = []
    for _ in range(60):
        own = rng.choices(words, k=rng.randint(0, 25))
        item = rng.choice(items).split()
        at, a = rng.randint(0, len(own)), rng.randint(0, len(item))
        texts.append(", ".join(own[:at] + item[a:] + own[at:]))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, None])], "item_id long, text string")
    for limit in (1_000_000, 20):
        got = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, texts), bench, automaton_words=limit).collect()}
        for i, text in enumerate(texts):
            want, spans = runs_by_hand(text, items)
            assert (got[i].text, [(s.start, s.end) for s in got[i].spans]) == (want, spans)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(0, "one two three four five six seven eight nine")], "item_id long, text string")
    texts = [None, "", "ONE two, three four five six seven eight nine!", LONG + "one two three four five six seven eight " + LONG]
    docs = docs_of(spark, texts)
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert [out[i].text for i in range(3)] == [None, "", "!"] and out[2].n_chars == 1 and out[3].text == f"{LONG} {LONG}"
    assert {r.text for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == set(texts)
    assert decontaminate.contamination(docs.limit(0), bench).isEmpty()


def test_messages_against_a_plain_chain():
    rng = np.random.default_rng(0)
    counts = np.array([3, 0, 130, 64, 65, 1, 200])
    e, a = np.exp(2 * rng.normal(size=counts.sum())), np.exp(rng.normal(size=(2, 2)))
    got, at = toxicity.messages(toxicity.Layout(counts), e, a)[0], 0
    for n in counts:
        alpha, beta, last = np.zeros((n, 2)), np.ones((n, 2)), np.array([1.0, 0.0])
        for k in range(n):
            last = last @ a * [1, e[at + k]]
            alpha[k] = last = last / last.sum()
        for k in range(n - 2, -1, -1):
            beta[k] = a @ (beta[k + 1] * [1, e[at + k + 1]])
            beta[k] /= beta[k].sum()
        p = alpha * beta
        assert np.allclose(got[at : at + n], p[:, 1] / p.sum(1))
        at += n


def toxic_corpus(spark, n=600):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    bad = ["scumble", "vilefoo", "grotbar"]
    texts, labels = [], []
    for i in range(n):
        own = rng.choices(words, k=rng.randint(5, 80))
        labels.append(int(rng.random() < 0.2))
        for _ in range(3 * labels[-1]):
            own.insert(rng.randint(0, len(own)), rng.choice(bad))
        texts.append(" ".join(own))
    return texts, labels, bad


def test_gradient_of_the_field_against_differences():
    """The field's gradient is that of the log likelihood, which is counted out here over all sequences of tags."""
    rng = np.random.default_rng(2)
    v, counts = 4, np.array([3, 1, 5])
    ids, tags = [rng.integers(0, v, counts.sum()) for _ in range(2)], rng.random(counts.sum()) < 0.4
    features = [(0, ids[0]), (0, ids[1]), (1, rng.integers(0, v, counts.sum())), (2, rng.integers(0, v, counts.sum()))]
    ends = np.cumsum(counts)
    texts = [slice(e - n, e) for n, e in zip(counts, ends)]
    seen = np.zeros((2, 2))
    for t in texts:
        for i, j in zip([False, *tags[t][:-1]], tags[t]):
            seen[int(i), int(j)] += 1

    def likelihood(theta):
        weights, moves, total = theta[: 3 * v].reshape(3, v), theta[-4:].reshape(2, 2), 0.0
        emit = sum(weights[k][x] for k, x in features) + theta[3 * v]
        for t in texts:
            score = lambda y: sum(emit[t][i] * y[i] + moves[y[i - 1] if i else 0, y[i]] for i in range(len(y)))  # noqa: B023, E731
            every = [score(y) for y in itertools.product((0, 1), repeat=t.stop - t.start)]
            total += score(tags[t].astype(int)) - np.log(np.exp(every).sum())
        return total

    theta = rng.normal(0, 0.7, 3 * v + 5)
    got = toxicity.gradient(theta, [(features, tags, toxicity.Layout(counts))], seen, v)
    step = 1e-5 * np.eye(len(theta))
    want = [(likelihood(theta + d) - likelihood(theta - d)) / 2e-5 for d in step]
    assert np.allclose(got, want, atol=1e-6)


def test_toxicity_on_held_out_documents(spark):
    texts, labels, bad = toxic_corpus(spark)
    docs = docs_of(spark, texts)
    known = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels[:450])], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    held = range(450, 600)
    assert sum(got[i].toxic == bool(labels[i]) for i in held) >= 0.98 * len(held)
    for i in held:
        if got[i].toxic:
            assert {w for s in got[i].spans for w in texts[i][s.start : s.end].split()} <= set(bad)
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_toxicity_gradient_reads_the_whole_sample(spark):
    texts, labels, bad = toxic_corpus(spark)
    first = next(i for i, y in enumerate(labels) if y)
    texts[first] = " ".join([texts[first], *(f"word{i % 300}" for i in range(3000))])
    whole, parts = (toxicity.fit(texts, np.array(labels, bool), tokens=n) for n in (10**9, 500))
    assert np.allclose(parts["moves"], whole["moves"], rtol=1e-3) and np.allclose(parts["bias"], whole["bias"], rtol=1e-3)
    assert len(np.intersect1d(parts["known"], whole["known"])) >= 0.99 * max(len(parts["known"]), len(whole["known"]))


def test_toxicity_edges(spark):
    texts, labels, _ = toxic_corpus(spark, 300)
    docs = docs_of(spark, [*texts, None, "", "...", LONG], [*range(300), None, 301, 302, 303])
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (301, None), (0, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    assert got[None].score == got[301].score == got[302].score == 0.0 and not got[303].toxic
    for none in (known.limit(0), known.withColumn("toxic", F.lit(0))):
        assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), known).isEmpty()


TEXTS = ["it's don't 's ''s 're're x'llama 'tis  two\n\n three \t\n", " x 'd'D 12ab $$'s\n's", "日本語 text①² é", None, "", " ", "\n", "x" * 300, "a b a b", LONG[:5000]]


@pytest.mark.parametrize("head", [1 << 21, 0])
def test_bpe_is_that_of_the_public_coder(spark, coder, head):
    docs = docs_of(spark, TEXTS)
    for r in bpe.encoded(docs, head=head).collect():
        text = TEXTS[r.doc_id]
        assert r.decoded == text and r.ids == (None if text is None else coder.encode_ordinary(text)) and r.n_tokens == (None if text is None else len(r.ids))
    out = bpe.add_tokens(docs.withColumn("tokens", F.lit(1)), head=head)
    assert out.columns == [*docs.columns, "tokens", "_tokens", "n_tokens"]
    assert bpe.encoded(docs.limit(0)).isEmpty()


def test_bpe_of_long_pieces(spark, coder):
    """Runs without a blank of 64 KB and 1 MB: of one sign, of few signs, of letters and of base 64."""
    rng = random.Random(3)
    texts = ["a" * 1_000_000, "-=" * 32_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 16)), "".join(rng.choices("ab", k=3_000)), base64.b64encode(rng.randbytes(750_000)).decode()]
    for r in bpe.encoded(docs_of(spark, texts)).collect():
        assert r.decoded == texts[r.doc_id] and r.ids == coder.encode_ordinary(texts[r.doc_id])


def test_bpe_over_documents(documents, coder):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = bpe.encoded(documents).collect()
    assert len(rows) == len(texts) and all(r.ids == coder.encode_ordinary(texts[r.doc_id]) and r.decoded == texts[r.doc_id] for r in rows)


def test_bpe_broadcasts_small_parts(spark, coder, documents, monkeypatch):
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, x: sent.append(len(x[0])) or broadcast(sc, x))
    out = bpe.encoded(documents, part=500)
    assert len(sent) > 3 and max(sent) < 500 + 1000  # a part ends with an Arrow batch
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.ids == coder.encode_ordinary(texts[r.doc_id]) for r in out.collect())


def test_bpe_of_a_batch_takes_little_memory():
    """A worker splits a batch of any size piece by piece; what it holds on the way doesn't grow with the batch."""
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(300))
    batch = pa.record_batch({"0": pa.array([text] * 2000)})
    seam = bpe.seams(bpe.read_ranks())
    run = bpe._looked_up([], "0", seam)
    assert sum(len(b) for b in run(iter([batch.slice(0, 10)]))) == 10
    tracemalloc.start()
    assert sum(len(b) for b in run(iter([batch]))) == 2000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24e6


def test_decoding_skips_unknown_ids(spark):
    folds = bpe.Folds()
    row = spark.createDataFrame([([31373, -1, 10**6, None, 995],)], "ids array<int>").select(folds.decode(F.col("ids")).alias("t")).first()
    assert bytes(row.t) == b"hello world"


def test_best_fit_against_a_scan():
    rng = np.random.default_rng(1)
    for length in (7, 16, 100):
        sizes = rng.integers(1, length + 1, 300)
        got, free = packing.best_fit(sizes, length), []
        for i in np.argsort(-sizes, kind="stable"):
            fits = [c for c in free if c >= sizes[i]]
            if fits:
                free[free.index(min(fits))] -= sizes[i]
            else:
                free.append(length - sizes[i])
        used = np.bincount(got, sizes)
        assert used.max() <= length and sorted(length - used) == sorted(free)


@pytest.mark.parametrize("length,buffer", [(64, 1 << 23), (64, 500), (7, 500), (4096, 1 << 23)])
def test_packing_restores_documents(spark, coder, length, buffer):
    texts = [*TEXTS, "tail " * 100]
    packed = packing.pack(docs_of(spark, texts), length=length, buffer_tokens=buffer).cache()
    got = {r.doc_id: r.ids for r in packing.unpack(packed).collect()}
    assert got == {i: coder.encode_ordinary(t) for i, t in enumerate(texts) if t is not None}
    for r in packed.collect():
        assert len(r.ids) == len(r.position_ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= length and len(r.doc_ids) == len(r.parts) == len(r.cu_seqlens) - 1
        edges = [*r.cu_seqlens, length]
        assert r.position_ids == [k for a, b in zip(edges, edges[1:]) for k in range(b - a)]
        assert all(x == 50256 for x in r.ids[r.cu_seqlens[-1] :])
    assert packed.select("row_id").distinct().count() == packed.count()
    raw = {r.row_id: np.frombuffer(r.ids, np.uint16).tolist() for r in packing.as_binary(packed).collect()}
    assert raw == {r.row_id: r.ids for r in packed.collect()}


def test_packing_edges(spark):
    docs = docs_of(spark, [None, "a", "a", "hello world", "hello"], [1, None, None, 7, 7])
    packed = packing.pack(docs, length=8).cache()
    assert sorted((x for r in packed.collect() for x in r.doc_ids), key=str) == [7, 7, None, None]
    assert sorted(((r.doc_id, r.ids) for r in packing.unpack(packed).collect()), key=str) == [(7, [31373, 995]), (7, [31373]), (None, [64]), (None, [64])]
    with pytest.raises(Exception, match="ask for wide"):
        packing.as_binary(packed.select("row_id", F.transform("ids", lambda x: x + 50_000).alias("ids"))).collect()
    assert packing.pack(docs.limit(0)).isEmpty()


def test_queries_against_their_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        want = sorted(got.fetchall(), key=str)
        own = sorted((tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, SF).collect()), key=str)
        assert own == want, name


def test_pipeline_stages_against_brute_force(spark, coder, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "bpe"]

    def through(name, given):
        out = str(tmp_path / name)
        stage[name](spark, given, SF).write.parquet(out)
        back = spark.read.parquet(out)
        assert name == "bpe" or back.columns == columns
        return back

    def texts(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    first = through("toxicity", docs)
    scores = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(texts(first)) == {i for i, bad in scores.items() if not bad}
    second = through("line_dedup", first)
    want = lines_by_hand(list(texts(first).items()))
    assert texts(second) == {i: t for i, (t, n, gone) in want.items() if not gone or t.strip()}
    third = through("near_dedup", second)
    before = sorted(texts(second).items())
    group = groups_of([t for _, t in before])
    assert set(texts(third)) == {before[k][0] for k in range(len(before)) if group[k] == k}
    fourth = through("decontaminate", third)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = texts(third)
    assert {i: t for i, t in texts(fourth).items()} == {i: runs_by_hand(t, items)[0] for i, t in some.items()}
    last = through("bpe", fourth)
    rows = last.collect()
    assert texts(last) == texts(fourth) and all(r.tokens == coder.encode_ordinary(r.text) and r.n_tokens == len(r.tokens) for r in rows)


def test_pipeline_runs_whole_and_on_odd_tables(spark, coder, tmp_path):
    """run() over nulls, empty and repeated texts and clashing columns, and over an empty table."""
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(8)
    own = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    rows = [(i, t, "x", "k", 1) for i, t in enumerate([*own, own[0], None, "", own[1] + " more", LONG])] + [(0, own[0], "x", "k", 1)]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, TW_gone string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "tokens", "TW_gone", "n_chars", "_tokens", "n_tokens"]
    found = {r.doc_id: r for r in got.collect()}
    # 4 and 7 are copies; line dedup leaves nothing of 4, and one line of each other text.
    assert sorted(found) == [0, 1, 2, 3, 5, 6, 8] and found[5].text is None and found[6].text == "" and found[8].text == LONG
    assert all(r.text is None or r._tokens == coder.encode_ordinary(r.text) for r in found.values())
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
