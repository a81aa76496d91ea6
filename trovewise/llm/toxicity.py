"""Toxic spans by a linear-chain conditional random field, and documents by its marginals.

Labels are per document, so labelled tokens are made first: words and beginnings of words that are in documents
labelled toxic beyond chance (a log-likelihood ratio that survives a correction for the number of them; near copies
count once), and of which at least `precision` stand in such documents, are toxic tokens there; every other token is
not. The field has two states and, as features, the word, its beginnings, the word before and the one after, and the
transition; it is fitted by gradient ascent.

Fitting reads all of a sample of `rows` labelled documents (least hashes of their ids), which bounds what reaches the driver;
the field itself runs over every word of every text, in one narrow pass. Forward and backward messages are computed
for all texts of a batch at once, by segments whose transfer matrices are chained.

A document's evidence is the sum of -log(1 - marginal) over its tokens above a floor; its score is the probability that
a logistic regression of the sample's labels on evidence and length gives it. Spans are the runs of words whose
marginal reaches `threshold`; a document is toxic if its score does.

Defined cases: texts that are null, empty or without words score 0; no toxic label, or nothing that tells toxic
documents, gives a field that finds nothing; of contradicting labels of an id the largest counts; null labels are
none. Repeated rows are treated alike. Other columns pass through or are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .near_dedup import grams
from .shared import batches, fresh

SEGMENT, _FILTER_BITS, PREFIXES, FLOOR = 64, 22, (4, 5, 6, 7), 0.1


class Layout:
    """Places of the tokens of some texts in a grid of SEGMENT rows, a column for each segment of a text."""

    def __init__(self, counts: np.ndarray) -> None:
        self.parts = -(-counts // SEGMENT)
        self.first = np.concatenate([[0], np.cumsum(self.parts)])
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.row = (within % SEGMENT).astype(np.uint8)
        self.column = (np.repeat(self.first[:-1], counts) + within // SEGMENT).astype(np.int32)
        self.width = int(self.first[-1])
        self.order = np.argsort(-self.parts, kind="stable")
        self.longest = int(self.parts.max()) if len(self.parts) else 0
        self.have = np.searchsorted(-self.parts[self.order], -np.arange(self.longest), "left")


def messages(lay: Layout, emission: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, and the forward and backward messages' share of state 1 before and after each token.

    emission: each token's weight of state 1 against state 0, as a factor; a: 2 x 2 transition factors.
    """
    n = lay.width
    e = np.ones((SEGMENT, n))
    e[lay.row, lay.column] = emission
    real = np.zeros((SEGMENT, n), bool)
    real[lay.row, lay.column] = True
    p = [[np.ones(n), np.zeros(n)], [np.zeros(n), np.ones(n)]]
    for k in range(SEGMENT):
        q = [[p[i][0] * a[0, 0] + p[i][1] * a[1, 0], (p[i][0] * a[0, 1] + p[i][1] * a[1, 1]) * e[k]] for i in (0, 1)]
        scale = 1 / (q[0][0] + q[0][1] + q[1][0] + q[1][1])
        p = [[np.where(real[k], q[i][j] * scale, p[i][j]) for j in (0, 1)] for i in (0, 1)]
    into, out = np.zeros(n), np.full(n, 0.5)
    for k in range(1, lay.longest):
        c = lay.first[lay.order[: lay.have[k]]] + k - 1
        zero, one = (1 - into[c]) * p[0][0][c] + into[c] * p[1][0][c], (1 - into[c]) * p[0][1][c] + into[c] * p[1][1][c]
        into[c + 1] = one / (zero + one)
    for k in range(lay.longest - 2, -1, -1):
        c = lay.first[lay.order[: lay.have[k + 1]]] + k
        zero, one = p[0][0][c + 1] * (1 - out[c + 1]) + p[0][1][c + 1] * out[c + 1], p[1][0][c + 1] * (1 - out[c + 1]) + p[1][1][c + 1] * out[c + 1]
        out[c] = one / (zero + one)
    before, after = np.empty((SEGMENT, n)), np.empty((SEGMENT, n))
    f = into
    for k in range(SEGMENT):
        before[k] = f
        zero, one = (1 - f) * a[0, 0] + f * a[1, 0], ((1 - f) * a[0, 1] + f * a[1, 1]) * e[k]
        f = one / (zero + one)
    b = out
    marginal = np.empty((SEGMENT, n))
    for k in range(SEGMENT - 1, -1, -1):
        after[k] = b
        one = ((1 - before[k]) * a[0, 1] + before[k] * a[1, 1]) * e[k] * b
        zero = ((1 - before[k]) * a[0, 0] + before[k] * a[1, 0]) * (1 - b)
        marginal[k] = one / (zero + one)
        zero, one = a[0, 0] * (1 - b) + a[0, 1] * e[k] * b, a[1, 0] * (1 - b) + a[1, 1] * e[k] * b
        b = np.where(real[k], one / (zero + one), b)
    return marginal[lay.row, lay.column], before[lay.row, lay.column], after[lay.row, lay.column]


def _neighbours(ids: np.ndarray, offsets: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after each, none at the ends of a text."""
    before, after = np.full(len(ids), none), np.full(len(ids), none)
    before[1:], after[:-1] = ids[:-1], ids[1:]
    have = np.diff(offsets) > 0
    before[offsets[:-1][have]] = none
    after[offsets[1:][have] - 1] = none
    return before, after


def _features(w: words.Words, kinds: list[int] | None = None) -> np.ndarray:
    """A row of hashes for the words (kind 0) and one for each length of prefix; 0 where a word is no longer than the prefix."""
    kinds = list(range(1 + len(PREFIXES))) if kinds is None else kinds
    out = np.empty((len(kinds), len(w.starts)), np.uint64)
    for row, kind in enumerate(kinds):
        if kind == 0:
            out[row] = w.hashes
            continue
        size = PREFIXES[kind - 1]
        longer = w.ends - w.starts > size
        out[row] = np.where(longer, words.mix(w.spans(w.starts, np.where(longer, w.starts + size, w.ends)) + np.uint64(size)), np.uint64(0))
    return out


def telling(hashes: Iterable[np.ndarray], counts: np.ndarray, toxic: np.ndarray, precision: float = 0.7, chance: float = 0.01) -> np.ndarray:
    """The features (hashes, by rows of _features) that tell toxic documents from others.

    By documents they are more often in toxic ones than chance allows, by tokens at least `precision` of them are.
    """
    share = toxic.mean() if len(toxic) else 0.0
    if not 0 < share < 1:
        return np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(toxic)), counts)
    found, kinds = [], 0
    for row in hashes:
        known, ids = np.unique(row, return_inverse=True)
        tokens, bad = np.bincount(ids, minlength=len(known)), np.bincount(ids[toxic[doc]], minlength=len(known))
        pairs = ids * np.int64(len(toxic)) + doc
        del ids
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        bad_doc = toxic[pairs % len(toxic)]
        pairs //= len(toxic)
        total = np.bincount(pairs, minlength=len(known)).astype(float)
        a = np.bincount(pairs[bad_doc], minlength=len(known)).astype(float)
        b = total - a
        del pairs, bad_doc
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(a > 0, a * np.log(a / (total * share)), 0) + np.where(b > 0, b * np.log(b / (total * (1 - share))), 0)
        good = np.flatnonzero((known > 0) & (a >= share * total) & (bad >= precision * tokens))
        found.append((known[good], ratio[good]))
        kinds += len(known)
    return np.sort(np.concatenate([k[r > np.log(kinds / chance)] for k, r in found]))


def _bands(w: words.Words, bands: int = 8) -> np.ndarray:
    """Each text's keys, a row for each band of two minima of its word 3-grams; 0 for texts without words."""
    sets, offsets = grams(w)
    have = np.flatnonzero(np.diff(offsets))
    out = np.zeros((bands, len(w.counts)), np.uint64)
    for band in range(bands if len(have) else 0):
        for k in (0, 1):
            out[band, have] = words.mix(out[band, have] + np.minimum.reduceat(words.mix(sets + np.uint64(2 * band + k + 1)), offsets[:-1][have]))
    return out


def _evidence(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text, the logarithms of 1 + what its marginals say together and of 1 + its number of words."""
    said = np.where(p > FLOOR, -np.log1p(-np.minimum(p, 1 - 1e-4)), 0.0)
    total = np.concatenate([[0], np.cumsum(said)])
    ends = np.cumsum(counts)
    return np.stack([np.log1p(np.maximum(total[ends] - total[ends - counts], 0)), np.log1p(counts)])


def _calibrated(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression of the labels on the evidence, by Newton steps with a little shrinkage."""
    z = np.vstack([x, np.ones(len(toxic))])
    c = np.zeros(len(z))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(c @ z, -30, 30)))
        c += np.linalg.solve((z * (p * (1 - p))) @ z.T + 0.05 * np.eye(len(z)), z @ (toxic - p) - 0.05 * c)
    return c


def _parts(counts: np.ndarray, tokens: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many tokens each, one text at least."""
    start, total = 0, 0
    for i, n in enumerate(counts):
        if i > start and total + n > tokens:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(counts):
        yield start, len(counts)


def gradient(theta: np.ndarray, parts: list[tuple], seen: np.ndarray, v: int) -> np.ndarray:
    """Of the log likelihood of the tags: their features less those that the field expects.

    theta: weights of v features at a token, before and after it, bias, 2 x 2 transitions. parts: (pairs of place and
    feature of each token, tags, Layout); seen: the transitions of all tags, each text's first coming from state 0.
    """
    a = np.exp(theta[-4:].reshape(2, 2))
    weights = theta[: 3 * v].reshape(3, v)
    grad = np.zeros_like(theta)
    to = grad[: 3 * v].reshape(3, v)
    grad[-4:] += seen.ravel()
    for features, tag, lay in parts:
        e = np.exp(np.clip(sum(weights[k][x] for k, x in features) + theta[3 * v], -30, 30))
        p, f, b = messages(lay, e, a)
        joint = [[(f if i else 1 - f) * a[i, j] * (e * b if j else 1 - b) for j in (0, 1)] for i in (0, 1)]
        z = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
        off = tag - p
        for k, x in features:
            to[k] += np.bincount(x, off, v)
        grad[3 * v] += off.sum()
        grad[-4:] -= [(joint[i][j] / z).sum() for i in (0, 1) for j in (0, 1)]
    return grad


def fit(texts: list[str | None], toxic: np.ndarray, tokens: int = 400_000, steps: int = 60, rate: float = 0.3, decay: float = 1e-3) -> dict | None:
    """The field's weights, or None if nothing tells toxic documents.

    The gradient is summed over the whole sample, in parts of about so many tokens, whole texts each.
    """
    column = pa.array(texts, pa.large_string())
    spans = list(words.chunks(column, 1 << 19))
    if not spans:
        return None
    counts, bands = [], []
    for x, y in spans:
        w = words.split(column.slice(x, y - x))
        counts.append(w.counts)
        bands.append(_bands(w))
    counts, bands = np.concatenate(counts), np.concatenate(bands, 1)
    single = np.zeros(bands.shape, bool)
    for row, keys in zip(single, bands):
        row[np.unique(keys, return_index=True)[1]] = True
    own = (single | (bands == 0)).all(0) & (counts > 0)
    every = counts
    counts, toxic = counts[own], toxic[own]
    often = []

    def row_of(kind: int) -> np.ndarray:
        return np.concatenate([_features(words.split(column.slice(x, y - x)), [kind])[0][np.repeat(own[x:y], every[x:y])] for x, y in spans])

    def rows() -> Iterator[np.ndarray]:
        """The features of the whole sample, one kind in memory at a time."""
        for kind in range(1 + len(PREFIXES)):
            row = row_of(kind)
            known, n = np.unique(row, return_counts=True)
            often.append(known[(n > 1) & (known > 0)])
            del known, n
            words.trim()
            yield row

    marked = telling(rows(), counts, toxic)
    if not len(marked):
        return None
    known = np.unique(np.concatenate([*often, marked]))
    often.clear()
    v = len(known) + 1
    ids, tags = np.empty((1 + len(PREFIXES), counts.sum()), np.int32), np.zeros(counts.sum(), bool)
    for kind in range(len(ids)):
        row = row_of(kind)
        ids[kind] = _numbers(known, row)
        tags |= np.isin(row, marked)
    del row
    tags &= np.repeat(toxic, counts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    parts, seen = [], np.zeros((2, 2))
    for x, y in _parts(counts, tokens):
        part, tag, offsets = ids[:, ends[x] : ends[y]], tags[ends[x] : ends[y]], ends[x : y + 1] - ends[x]
        tag_before = np.concatenate([[False], tag[:-1]])
        tag_before[offsets[:-1]] = False
        seen += [[((tag_before == i) & (tag == j)).sum() for j in (0, 1)] for i in (0, 1)]
        before, after = (k.astype(np.int32) for k in _neighbours(part[0], offsets, len(known)))
        parts.append(([*((0, k) for k in part), (1, before), (2, after)], tag, Layout(counts[x:y])))
    words.trim()
    size = 3 * v + 5
    theta, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        grad = gradient(theta, parts, seen, v) - decay * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = theta[: 3 * v].reshape(3, v)
    # Features whose weights differ from the unknown one's by next to nothing are unknown.
    tell = np.flatnonzero(np.abs(weights[:, :-1] - weights[:, -1:]).max(0) > 1e-3)
    model = {"known": known[tell], "weights": np.concatenate([weights[:, tell], weights[:, -1:]], 1), "bias": float(theta[3 * v]), "moves": np.exp(theta[-4:].reshape(2, 2))}
    evidence = []
    for x, y in spans:
        kept = np.repeat(own[x:y], every[x:y])
        part = every[x:y][own[x:y]]
        evidence.append(_evidence(_marginals(model, _features(words.split(column.slice(x, y - x)))[:, kept], part, _numbers), part))
    return model | {"score": _calibrated(np.concatenate(evidence, 1), toxic)}


def _numbers(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of each feature, len(known) if it isn't known."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, len(known))


def _marginals(model: dict, hashes: np.ndarray, counts: np.ndarray, numbers) -> np.ndarray:
    known, weights = model["known"], model["weights"]
    ids = numbers(known, hashes[0])
    before, after = _neighbours(ids, np.concatenate([[0], np.cumsum(counts)]), len(known))
    total = weights[0][ids] + weights[1][before] + weights[2][after] + model["bias"]
    for row in hashes[1:]:
        total += weights[0][numbers(known, row)]
    return messages(Layout(counts), np.exp(np.clip(total, -30, 30)), model["moves"])[0]


def _filtered(seen: np.ndarray):
    """_numbers behind a table of the leading bits of what is known."""

    def numbers(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(known))
        some = np.flatnonzero(seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        out[some] = _numbers(known, hashes[some])
        return out

    return numbers


def _tagger(shared, place: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = model["known"]
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[known >> np.uint64(64 - _FILTER_BITS)] = True
        for batch in batches:
            for x, y in words.chunks(batch.column(place)):
                part = batch.slice(x, y - x)
                w = words.split(part.column(place))
                p = _marginals(model, _features(w), w.counts, _filtered(seen))
                score = np.where(w.counts > 0, 1 / (1 + np.exp(-np.clip(model["score"] @ np.vstack([_evidence(p, w.counts), np.ones(y - x)]), -30, 30))), 0.0)
                hit = np.flatnonzero(p >= threshold)
                of = np.searchsorted(w.offsets, hit, "right") - 1
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(of) != 0)])) if len(hit) else hit
                stop = np.append(edge[1:], len(hit)) - 1 if len(hit) else hit
                texts = of[edge]
                flat = pa.StructArray.from_arrays(
                    [pa.array(w.char_place(w.starts[hit[edge]], texts).astype(np.int32)), pa.array(w.char_place(w.ends[hit[stop]], texts).astype(np.int32)), pa.array(np.maximum.reduceat(p[hit], edge) if len(hit) else np.zeros(0))],
                    ["start", "end", "score"],
                )
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, np.arange(y - x + 1)).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), spans], [str(k) for k in range(len(part.columns) + 2)])

    return run


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of the labelled documents whose ids have the least hashes."""
    each = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    each = each.join(docs.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    ids = each.orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    if not ids:
        return [], np.zeros(0, bool)
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(r.id, r.toxic) for r in ids], T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("toxic", T.BooleanType())])))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(chosen, "id").select("id", "text", "toxic").collect()
    found = {(r.id, r.text): r.toxic for r in texts}
    keys = sorted(found, key=lambda k: (k[0], k[1] is None, k[1] or ""))
    return [k[1] for k in keys], np.array([found[k] for k in keys], bool)


def _tagged(docs: DataFrame, labels: DataFrame, score: str, spans: str, threshold: float, rows: int) -> DataFrame:
    model = fit(*sample(docs, labels, rows))
    words.trim()
    batches(docs.sparkSession)
    if model is None:
        return docs.withColumn(score, F.lit(0.0)).withColumn(spans, F.array().cast(_SPANS))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*[str(k) for k in range(len(docs.columns))])
    out = T.StructType([T.StructField(str(k), f.dataType) for k, f in enumerate([*docs.schema, T.StructField(score, T.DoubleType()), T.StructField(spans, _SPANS)])])
    return plain.mapInArrow(_tagger(shared, str(docs.columns.index("text")), threshold), out).toDF(*docs.columns, score, spans)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = 3000) -> DataFrame:
    """(doc_id, score, toxic, spans) of every document; spans are character offsets in text with their largest marginal."""
    out = _tagged(docs.select("doc_id", "text"), labels, "score", "spans", threshold, rows)
    return out.select("doc_id", "score", (F.col("score") >= threshold).alias("toxic"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = 3000) -> DataFrame:
    """docs without those whose score reaches the threshold."""
    score, spans = fresh(docs, "tw_score", "tw_spans")
    return _tagged(docs, labels, score, spans, threshold, rows).filter(F.col(score) < threshold).drop(score, spans)
