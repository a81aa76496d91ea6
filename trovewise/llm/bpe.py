"""Byte-level BPE encoding and decoding.

Pieces of the texts are counted over all documents. The `head` most frequent are encoded once each; their encodings
are broadcast in parts of about `part` pieces, which bounds what is broadcast whatever the corpus (a piece of over `long_piece` bytes is never among
them). Rarer pieces are encoded in the row in which they stand, each once a document, so no text and no piece position
is ever shuffled. Both are encoded by the same fold: Spark higher-order functions over the array of the piece's bytes
merge the neighbours of the least rank, the leftmost first, until no pair of neighbours has a rank. Ranks come from a
literal hash map in the plan. Decoding concatenates the byte strings of a literal array.

Words are cut beforehand between bytes that no token holds side by side, which no merge can join; so a long run without
blanks mostly falls into short pieces. In what stays longer than LONG, a pair that occurs over MANY times is merged
everywhere in one step (no merge of a rank makes another pair of that rank), as in runs of one sign.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids and decodes to the empty text.
Ids outside the vocabulary and null ids decode to nothing. Repeated rows are encoded alike. Other columns pass through.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces, words
from .shared import batches, fresh, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = 2**31 - 1
LONG, MANY = 64, 16
#: Bytes of text that a worker splits at once, and pieces of one broadcast: the most that is held beside the table itself.
CHUNK, PART = 1 << 18, 1 << 17


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Byte strings and their ranks, which are the token ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens of whose merge the token comes: those that the merges of lesser rank leave of its bytes.

    Any other pair that joins to the token never meets: merges within its bytes take the same course in every word.
    """
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NONE))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def seams(ranks: dict[bytes, int]) -> np.ndarray:
    """Of each pair of bytes a * 256 + b, whether no token holds a followed by b: then no merge ever spans them."""
    held = np.zeros(1 << 16, bool)
    for token in ranks:
        for a, b in zip(token, token[1:]):
            held[a * 256 + b] = True
    return ~held


def _hashed(pairs: list[tuple[int, int, int]], factors: tuple[int, int], first: int, second: int) -> tuple[list[int], list[int]]:
    """A perfect hash of pairs (a, b) of tokens: displacements by a first hash, and entries at the second hash with its displacement."""
    groups: dict[int, list[tuple[int, int]]] = {}
    for a, b, r in pairs:
        groups.setdefault((a * 33 ^ b * 157) & first, []).append(((a * factors[0] ^ b * factors[1]) & second, (a << 40) + (b << 20) + r))
    free = 1 << 62
    moves, slots = [0] * (first + 1), [free] * (second + 1)
    for g, own in sorted(groups.items(), key=lambda x: -len(x[1])):
        moves[g] = next(d for d in range(second + 1) if all(slots[h ^ d] == free for h, _ in own))
        for h, entry in own:
            slots[h ^ moves[g]] = entry
    return moves, slots


@lru_cache(4)
def _tables(vocabulary: str) -> tuple:
    """The number of ids, factors and masks of the two hashes, and as JSON displacements, entries, ids of single bytes and base 64 of all tokens."""
    ranks = read_ranks(vocabulary)
    ids = max(ranks.values(), default=-1) + 1
    if ids >= Folds.NONE - 1:
        raise ValueError(f"token ids must be below {Folds.NONE - 1}")
    pairs = [(ranks[a], ranks[b], r) for t, r in ranks.items() if len(t) > 1 for a, b in [last_merge(t, ranks)]]
    first, second = ((1 << max(4, len(pairs).bit_length() + k)) - 1 for k in (-1, 1))
    most = min(40503, (2**31 - 1) // (ids + 1))  # with such factors no id overflows an integer
    a, b = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
    group = ((a * 33 ^ b * 157) & first) * (second + 1)
    tries = ((most - 1 | 1, int(most * share) - 1 | 1) for share in np.linspace(0.8243, 0.5, 200))
    factors = next(f for f in tries if len(np.unique(group + ((a * f[0] ^ b * f[1]) & second))) == len(pairs))
    found = _hashed(pairs, factors, first, second)
    by_id = [""] * ids
    for piece, rank in ranks.items():
        by_id[rank] = base64.b64encode(piece).decode()
    return ids, factors, first, second, *(json.dumps(x, separators=(",", ":")) for x in (*found, [ranks[bytes([b])] for b in range(256)], by_id))


class Folds:
    """The vocabulary as literals, and the expressions over them.

    Merging tokens a and b has the rank of the joined bytes, which is the id of the merged token. The literal rank map
    is a perfect hash: the entry (a, b, id) of a pair stands at the place that its hashes give, so that an entry XOR
    (a, b, 0) is the id, or NONE and more if the pair has none.
    """

    NONE = 1 << 20

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.ids, self.factors, self.first, self.second, *tables = _tables(vocabulary)
        literal = lambda values, kind: F.from_json(F.lit(values), kind)
        self.moves, self.slots = literal(tables[0], "array<int>"), literal(tables[1], "array<bigint>")
        self.bytes = literal(tables[2], "array<int>")
        self.pieces = literal(tables[3], "array<binary>").cast("array<string>")

    def _rank(self, known: Column, a: Column, b: Column) -> Column:
        """The id that the pair merges to; NONE or more if it doesn't."""
        move = F.get(known["m"], (a * 33).bitwiseXOR(b * 157).bitwiseAND(F.lit(self.first)))
        place = (a * self.factors[0]).bitwiseXOR(b * self.factors[1]).bitwiseAND(F.lit(self.second)).bitwiseXOR(move)
        return F.get(known["s"], place).bitwiseXOR(a.cast("bigint") * (1 << 40) + b.cast("bigint") * (1 << 20))

    def encode(self, piece: Column) -> Column:
        """The token ids of a piece of at least one byte.

        The fold's state is the parts, with a sentinel at either end, and the ranks of neighbours. A step merges the
        leftmost pair of the least rank. In a piece of over LONG bytes it merges all of them at once if they are many,
        and steps run in turns, so that few are left to do nothing after the last merge: each copies the state.
        """
        size, end = F.octet_length(piece), F.array(F.lit(self.ids))

        def folded(known: Column) -> Column:
            def neighbours(p: Column) -> Column:
                return F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: self._rank(known, F.get(p, i), F.get(p, i + 1)))

            def one(v: Column, m: Column, n: Column) -> Column:
                p, r = v["p"], v["r"]
                ranks = F.array(self._rank(known, F.get(p, n - 2), m), self._rank(known, m, F.get(p, n + 1)))
                return F.struct(F.concat(F.slice(p, F.lit(1), n - 1), F.array(m), F.slice(p, n + 2, size)).alias("p"), F.concat(F.slice(r, F.lit(1), n - 2), ranks, F.slice(r, n + 2, size)).alias("r"))

            def every(v: Column, m: Column) -> Column:
                """All pairs of the least rank; of those that overlap, as in aaa, every other one."""
                signs = F.array_join(F.transform(v["r"], lambda x: F.when(x == m, "1").otherwise("0")), "")
                flags = F.split(F.concat(F.lit("0"), F.replace(signs, F.lit("11"), F.lit("10")), F.lit("0")), "")
                merged = _let(flags, lambda f: F.filter(F.transform(v["p"], lambda x, i: F.when(F.get(f, i) == "1", -1).when(F.get(f, i + 1) == "1", m).otherwise(x)), lambda x: x >= 0))
                return _let(merged, lambda p: F.struct(p.alias("p"), neighbours(p).alias("r")))

            def step(v: Column, long: bool) -> Column:
                least = F.array_min(v["r"])

                def merged(x: Column) -> Column:
                    m, n = x["m"].cast("int"), x["n"]
                    often = F.size(F.filter(v["r"], lambda r: r == x["m"])) > MANY
                    return F.when(x["m"] < self.NONE, F.when(often, every(v, m)).otherwise(one(v, m, n)) if long else one(v, m, n)).otherwise(v)

                return _let(F.struct(least.alias("m"), F.array_position(v["r"], least).cast("int").alias("n")), merged)

            turn, active = F.sequence(F.lit(1), F.ceil(F.cbrt(size.cast("double"))).cast("int")), lambda v: F.array_min(v["r"]) < self.NONE
            inner = lambda v: F.aggregate(turn, v, lambda u, _: F.when(active(u), F.aggregate(turn, u, lambda w, _: step(w, True))).otherwise(u))
            first = _let(F.concat(end, F.transform(F.split(F.decode(piece, "ISO-8859-1"), ""), lambda c: F.get(known["y"], F.ascii(c))), end), lambda p: F.struct(p.alias("p"), neighbours(p).alias("r")))
            short = F.aggregate(F.sequence(F.lit(2), size), first, lambda v, _: step(v, False))
            turns = F.aggregate(turn, first, lambda v, _: F.when(active(v), inner(v)).otherwise(v))
            parts = F.when(size > LONG, turns["p"]).otherwise(short["p"])
            return F.when(size == 1, F.array(F.get(known["y"], F.ascii(F.decode(piece, "ISO-8859-1"))))).otherwise(_let(parts, lambda p: F.slice(p, F.lit(2), F.size(p) - 2)))

        return _let(F.struct(self.moves.alias("m"), self.slots.alias("s"), self.bytes.alias("y")), folded)

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of token ids: their pieces, byte strings of which none need be valid alone, joined."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "").cast("binary")


def _counted(seam: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a, b in words.chunks(texts, CHUNK):
                known, _, n = pieces.split(texts.slice(a, b - a)).cut(seam).distinct()
                yield pa.record_batch({"piece": known.cast(pa.binary()), "n": pa.array(n.astype(np.int64))})

    return run


def piece_counts(docs: DataFrame, seam: np.ndarray) -> DataFrame:
    """(piece, n) of all pieces of all documents."""
    return docs.select("text").mapInArrow(_counted(seam), "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _packed(most: int):
    """A partition's pieces and ids as Arrow streams, each closed once it has so many pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stream() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for batch in held:
                    writer.write_batch(batch)
            held.clear()
            return pa.record_batch({"stream": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= most:
                yield stream()
        if held:
            yield stream()

    return run


def _part(stream: bytes, kind: type) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """A stream's pieces: their hashes in order, they themselves, where their ids begin, and the ids."""
    table = pa.ipc.open_stream(stream).read_all()
    known, lists = table["piece"].combine_chunks(), table["ids"].combine_chunks()
    hashes, starts = words.hash_each(known), np.asarray(lists.offsets)
    order = np.argsort(hashes, kind="stable")
    size = np.diff(starts)[order]
    ids = gather(lists.values.to_numpy(), starts[order], size).astype(kind)
    return hashes[order], known.take(pa.array(order)), np.concatenate([[0], np.cumsum(size)]).astype(np.int32), ids


def _head(counts: DataFrame, folds: Folds, head: int, long_piece: int, kind: type, part: int) -> list:
    """Broadcasts of the most frequent pieces that occur twice at least, all of a count or none; the driver holds one part at a time."""
    have = counts.filter((F.col("n") > 1) & (F.octet_length("piece") <= long_piece))
    least, total = 2, 0
    for row in sorted(have.groupBy("n").count().collect(), key=lambda r: -r["n"]):
        total += row["count"]
        if total > head:
            least = row["n"] + 1
            break
    coded = written(have.filter(F.col("n") >= least).select("piece", folds.encode(F.col("piece")).alias("ids")), "head")
    out = []
    for row in coded.mapInArrow(_packed(part), "stream binary").toLocalIterator():
        out.append(counts.sparkSession.sparkContext.broadcast(_part(row.stream, kind)))
        words.trim()
    return out


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[0]:][:sizes[0]], values[starts[1]:][:sizes[1]] and so on, joined."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _coded(own: pa.Array, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece the number of its ids, 0 if it is in no part, and their beginning in the third. Hashes find pieces, their bytes confirm them."""
    mine, size, begin = words.hash_each(own), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    ids, total = [], 0
    for hashes, known, starts, values in parts:
        at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
        have = np.flatnonzero(hashes[at] == mine)
        have = have[pc.equal(own.take(pa.array(have)), known.take(pa.array(at[have]))).to_numpy(zero_copy_only=False)]
        first = starts[at[have]]
        size[have] = n = starts[at[have] + 1] - first
        begin[have] = total + np.cumsum(n) - n
        ids.append(gather(values, first, n))
        total += len(ids[-1])
    return size, begin, np.concatenate([*ids, np.zeros(1, np.uint16)])


def _looked_up(shared: list, place: str, seam: np.ndarray):
    """Two more columns: ids, in which -k - 1 stands for piece k of the second, the document's rare pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x.value for x in shared]
        for batch in batches:
            for a, b in words.chunks(batch.column(place), CHUNK):
                part = batch.slice(a, b - a)
                texts = part.column(place)
                p = pieces.split(texts).cut(seam)
                own, which, _ = p.distinct()
                sizes, begins, values = _coded(own.cast(pa.binary()), parts)
                rare = np.flatnonzero(sizes[which] == 0)
                text = np.repeat(np.arange(b - a), p.counts)
                # The rare pieces, each once a text.
                keys, place_in = np.unique(text[rare] * np.int64(len(own) + 1) + which[rare], return_inverse=True)
                of = keys // (len(own) + 1)
                first = np.searchsorted(of, np.arange(b - a + 1))
                size = np.maximum(sizes, 1)[which]
                flat = gather(values, begins[which], size).astype(np.int32)
                flat[np.cumsum(size)[rare] - 1] = first[text[rare]] - place_in - 1
                ends = np.concatenate([[0], np.cumsum(size)])[p.offsets].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                if texts.null_count:
                    ids = pc.if_else(texts.is_valid(), ids, pa.scalar(None, ids.type))
                rares = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), own.take(pa.array(keys % (len(own) + 1))).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, rares], [str(k) for k in range(len(part.columns) + 2)])

    return run


def encode(docs: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, head: int = 1 << 21, long_piece: int = 64, part: int = PART) -> DataFrame:
    """docs and one more column, the token ids of text."""
    ranks, folds = read_ranks(vocabulary), Folds(vocabulary)
    seam = seams(ranks)
    batches(docs.sparkSession, 1000, "2m")
    words.trim()
    counts = written(piece_counts(docs, seam), "pieces")
    shared = _head(counts, folds, head, long_piece, np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.int32, part)
    names = docs.columns
    plain = docs.toDF(*[str(k) for k in range(len(names))])
    schema = T.StructType([T.StructField(str(k), f.dataType) for k, f in enumerate(docs.schema)] + [T.StructField(str(len(names)), T.ArrayType(T.IntegerType())), T.StructField(str(len(names) + 1), T.ArrayType(T.BinaryType()))])
    out = plain.mapInArrow(_looked_up(shared, str(names.index("text")), seam), schema)
    flat, rare = F.col(str(len(names))), F.col(str(len(names) + 1))
    whole = _let(F.transform(rare, folds.encode), lambda own: F.flatten(F.transform(flat, lambda i: F.when(i < 0, F.get(own, -i - 1)).otherwise(F.array(i)))))
    return out.select(*[F.col(str(k)).alias(c) for k, c in enumerate(names)], F.when(F.size(rare) == 0, flat).otherwise(whole).alias(ids))


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, **how) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document; decoded is the text again, from the ids."""
    out = encode(docs.select("doc_id", "text"), "ids", vocabulary, **how)
    back = Folds(vocabulary).decode(F.col("ids")).cast("string")
    return out.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"), "ids", back.alias("decoded"))


def add_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, **how) -> DataFrame:
    """docs with text replaced by what its ids decode to, and the columns tokens and n_tokens (with _ before a name that is taken)."""
    names = docs.columns
    tokens, count = fresh(docs, "tokens", "n_tokens")
    out = encode(docs, tokens, vocabulary, **how)
    back = Folds(vocabulary).decode(F.col(tokens)).cast("string")
    return out.select(*[back.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], tokens, F.when(F.col(tokens).isNotNull(), F.size(tokens)).alias(count))
