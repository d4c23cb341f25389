"""Operator 9: language-model scores from a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end. Each word that precedes a token is a context with a restaurant of its own; all
context restaurants share one parent, the word restaurant, whose base measure is uniform over the known words and one
unknown. Dishes are words. A context's tables of a dish are the parent's customers of that dish.

One Spark plan holds the whole computation, and no model is ever gathered in one place:

1. ``count``    Tasks cut their documents into batches, and send each context bucket the batch's distinct (context, word)
                pairs with their counts, packed. Words travel as 48-bit hashes. Which documents hold a pair stays with the
                batch, so the most frequent pair of the corpus costs its bucket one entry a batch.
2. ``seat``     A context bucket adds up its batches, seats its restaurants by Gibbs sampling against a parent that it
                estimates from its own tables, and sends each word bucket its words with customers and tables.
3. ``size``     A word bucket adds these up, and seats its part of the word restaurant as if the other buckets had as many
                tables as itself; one row then holds the known words, customers and tables of all.
4. ``root``     A word bucket seats its part again by Gibbs sampling, given the tables of the others, and answers every context
                bucket word by word.
5. ``predict``  A context bucket, given the parent's probabilities, goes on with Gibbs sweeps; the predictive probabilities
                of the sweeps after burn-in are averaged. It sends each batch one probability a pair.
6. ``gather``   A batch adds up its documents' pairs; one row a document.

Gibbs step: the number of tables of a dish is drawn from its exact conditional distribution (generalised Stirling numbers)
up to 256 customers; above that the Stirling numbers' ratios are taken at their saddle point (tests/llm/test_pylm.py holds
mean and spread against the exact law).

The hierarchy has two levels, contexts of one word and the word restaurant: the shallowest that is one. Contexts so common
that they would fill more than a quarter of a bucket are spread over all buckets by word, and their totals travel with the
words. Which these are is read off a sample that grows with the buckets. A spread context is first seated by each bucket without its tables in the
others, and with them, as they were then, in ``predict``; after that the word restaurant is not seated again. So scores
depend a little on the number of buckets; a test bounds by how much.

The model is learned from the documents whose crc32(doc_id as text) mod 7 is not 2. Perplexity of a text is
10 ** (-score / n_tokens).

Cases: a null or empty text is the end alone; a long text is read whole, in one batch; a null doc_id counts as the empty string in the split and stays null in the
result; repeated rows count each time; without training documents every probability is 1; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import column, documents
from pulsegrid.llm.langid import remainder

BITS = 48
MASK = np.uint64(2**BITS - 1)
EXACT = 256
#: Discount and concentration of the context restaurants and of the word restaurant.
CONTEXT_D, CONTEXT_T, ROOT_D, ROOT_T = 0.8, 2.0, 0.6, 20.0
BURN_IN, SAMPLES = 2, 3


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word) >> (64 - BITS)
        return found


_WORDS = _Words()
# Neither can be a word: words hold no white space.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x) >> (64 - BITS)) for x in (b" start", b" end"))


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of pairs."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes, np.uint64(7)) >> np.uint64(32)).astype(np.int64) * buckets >> 32


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; planes of zeros cost next to nothing."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.lstrip("<|").encode().ljust(2)
        parts.append(code + len(a).to_bytes(8, "little") + a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        kind, n = np.dtype("<" + raw[at : at + 2].decode()), int.from_bytes(raw[at + 2 : at + 10], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 10).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 10 + n * kind.itemsize
    return out


@lru_cache(maxsize=8)
def _log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0
    for c in range(EXACT):
        stay = s[c] + np.log(np.maximum(c - discount * np.arange(EXACT + 1), 1e-300))
        s[c + 1] = np.logaddexp(np.concatenate([[-np.inf], s[c, :-1]]), np.where(np.arange(EXACT + 1) <= c, stay, -np.inf))
    return s


def _shrink(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """log(1 - y**d) at the saddle point of the generating function ((1 - (1 - z)**d) / d)**t / t! of S(c, t), where y = 1 - z.

    The point is where d * (1 - y) * y**(d-1) / (1 - y**d) = c / t; it is found by halving an interval of log y.
    """
    low, high = np.full(np.broadcast(customers, tables).shape, -60.0), np.full(np.broadcast(customers, tables).shape, -1e-9)
    want = np.log(customers / tables)
    for _ in range(40):
        log_y = (low + high) / 2
        power = -np.expm1(discount * log_y)
        big = np.log(discount * -np.expm1(log_y) / power) + (discount - 1) * log_y > want
        low, high = np.where(big, log_y, low), np.where(big, high, log_y)
    return np.log(-np.expm1(discount * (low + high) / 2))


def draw_many(rng: np.random.Generator, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, concentration: float) -> np.ndarray:
    """draw_tables() for many customers: from the law with S(c, t+1) / S(c, t) by its saddle-point value (1 - y**d) / (d * t).

    The mode is found by halving, and the law is summed over a window of at least eight standard deviations to each side.
    """
    c, p = customers.astype(float), np.log(np.maximum(parent, 1e-300))

    def step(t: np.ndarray, *of: np.ndarray) -> np.ndarray:
        """Logarithm of the law at t + 1 over that at t."""
        c, others, p = of
        return _shrink(c, np.minimum(t + 0.5, c * (1 - 1e-9)), discount) - np.log(discount * t) + np.log(concentration + discount * (others + t)) + p

    low, high = np.ones(len(c)), np.maximum(c - 1, 1)
    for _ in range(int(np.log2(c.max())) + 2):
        middle = np.floor((low + high) / 2)
        up = step(middle, c, others, p) > 0
        low, high = np.where(up, np.minimum(middle + 1, high), low), np.where(up, high, middle)
    curve = np.maximum(step(np.maximum(low - 1, 1), c, others, p) - step(low + 1, c, others, p), 1e-9) / np.minimum(2, low)
    half = np.minimum(np.ceil(8 / np.sqrt(curve)) + 20, 5000).astype(int)
    out = np.empty(len(c), np.int64)
    order = np.argsort(half)
    at = 0
    while at < len(order):
        rows = order[at : at + max(1, 200_000 // (2 * half[order[min(at + 63, len(order) - 1)]] + 1))][:64]
        width = half[rows].max()
        t = np.maximum(low[rows] - width, 1)[:, None] + np.arange(2 * width)
        logs = step(t, *(x[rows][:, None] for x in (c, others, p)))
        logs = np.where(t + 1 <= c[rows][:, None], logs, -np.inf)
        weight = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(logs, axis=1)], axis=1)
        out[rows] = t[:, 0] + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
        at += len(rows)
    return out


def draw_tables(rng: np.random.Generator, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, concentration: float) -> np.ndarray:
    """Tables of each dish given its customers, the restaurant's tables of other dishes and the parent's probability."""
    tables = np.minimum(customers, 1).astype(np.int64)
    stirling = _log_stirling(discount)
    order = np.argsort(customers, kind="stable")
    least, begin = 2, int(np.searchsorted(customers[order], 2))
    while least <= EXACT:  # dishes of nearly equal customers together; a Stirling number of more tables than customers is zero
        most = min(EXACT, max(least, int(least * 1.15)))
        end = int(np.searchsorted(customers[order], most + 1))
        for at in range(begin, end, size := 1_000_000 // most):
            rows = order[at : min(end, at + size)]
            t = np.arange(1, most + 1)
            opened = np.cumsum(np.log(concentration + discount * (others[rows][:, None] + t - 1)), axis=1)
            weight = stirling[customers[rows], 1 : most + 1] + opened + t * np.log(np.maximum(parent[rows], 1e-300))[:, None]
            tables[rows] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
        least, begin = most + 1, end
    rows = order[begin:]
    if len(rows):
        tables[rows] = draw_many(rng, customers[rows], others[rows].astype(float), parent[rows], discount, concentration)
    return tables


class Bucket:
    """A context bucket's restaurants, added up from all batches."""

    def __init__(self, blobs: list[bytes], bucket: int, hot: np.ndarray):
        parts = [unpack(b) for b in blobs]
        context = np.concatenate([np.repeat(u, n) for u, n, _, _ in parts])
        word = np.concatenate([w for _, _, w, _ in parts])
        learned = np.concatenate([c for _, _, _, c in parts])
        self.splits = np.cumsum([len(p[2]) for p in parts])[:-1]
        _, first, self.pair_of = np.unique(mix(context, word), return_index=True, return_inverse=True)
        self.c = np.bincount(self.pair_of, learned, minlength=len(first)).astype(np.int64)
        self.words, self.w = np.unique(word[first], return_inverse=True)
        self.contexts, self.u = np.unique(context[first], return_inverse=True)
        self.cu = np.bincount(self.u, self.c, minlength=len(self.contexts)).astype(np.int64)
        self.hot = np.isin(self.contexts, hot)
        self.rng = np.random.default_rng([bucket, 11])
        self.t = np.minimum(self.c, 1)
        self.extra = np.zeros(len(self.contexts))  # tables of a spread context in other buckets

    def tables_of_contexts(self) -> np.ndarray:
        return np.bincount(self.u, self.t, minlength=len(self.contexts)) + self.extra

    def sweep(self, parent: np.ndarray) -> None:
        others = self.tables_of_contexts()[self.u] - self.t
        self.t = draw_tables(self.rng, self.c, others, parent[self.w], CONTEXT_D, CONTEXT_T)

    def seat(self, sweeps: int = 2) -> np.ndarray:
        """Sweeps against the bucket's own estimate of the parent; tables by word afterwards."""
        for _ in range(sweeps):
            by_word = np.bincount(self.w, self.t, minlength=len(self.words))
            self.sweep((by_word + 0.5) / (by_word.sum() + 0.5 * len(by_word)))
        return np.bincount(self.w, self.t, minlength=len(self.words)).astype(np.int64)

    def counts(self) -> np.ndarray:
        return np.bincount(self.w, self.c, minlength=len(self.words)).astype(np.int64)


def _hot_contexts(docs: DataFrame, n_docs: int, buckets: int) -> np.ndarray:
    """Hashes of words that make up at least a quarter of a bucket's share of a sample of documents; at most 4 * buckets of them."""
    rows, share = max(2000, 50 * buckets), 0.25 / buckets

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for text in column(batch, "text"):
                for w in (text or "").encode("utf-8", "replace").lower().split():
                    found[_WORDS[w]] = found.get(_WORDS[w], 0) + 1
        yield pa.RecordBatch.from_pydict({"w": pa.array([*found, -1], pa.int64()), "n": pa.array([*found.values(), sum(found.values())], pa.int64())})

    sample = docs.select("text").sample(min(1.0, rows / max(1, n_docs)), seed=7).mapInArrow(tally, "w long, n long")
    most = sample.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(4 * buckets + 1).collect()  # the total comes first
    total = max((r["n"] for r in most if r["w"] < 0), default=0)
    return np.array([int(START), *(r["w"] for r in most if r["w"] >= 0 and r["n"] >= share * total)], dtype=np.uint64)


PACKETS = "bucket int, kind int, batch long, blob binary"


def score_documents(docs: DataFrame, bucket_tokens: int = 1_500_000, batch_tokens: int = 1_500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text)."""
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(4, int(size / 6 / bucket_tokens) + 1)  # about six bytes a word
    hot = _hot_contexts(docs, n_docs, buckets)
    marked = docs.select("doc_id", "text", F.coalesce(remainder(7) != 2, F.lit(True)).alias("learned"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary())])
        ids, flags, held, tokens = [], [], [], 0

        def packets():
            lengths = np.array([len(h) + 1 for h in held])
            ends = np.cumsum(lengths)
            words = np.empty(ends[-1], np.uint64)
            contexts = np.empty(ends[-1], np.uint64)
            for h, end in zip(held, ends):
                words[end - len(h) - 1 : end - 1], words[end - 1] = h, END
                contexts[end - len(h) : end], contexts[end - len(h) - 1] = h, START
            learned = np.array(flags, dtype=np.int64)
            token = np.repeat(np.arange(len(held)) * 2 + learned, lengths).astype("<u4")
            keys = mix(contexts, words)
            order = np.argsort(keys, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
            of_pair = np.diff(np.append(starts, len(order)))
            u, w = contexts[order[starts]], words[order[starts]]
            bucket = _spread(np.where(np.isin(u, hot), mix(u, w), u), buckets)
            by = np.lexsort((u, bucket))
            u, w, bucket, of_pair, starts = u[by], w[by], bucket[by], of_pair[by], starts[by]
            token = token[order][np.repeat(starts - np.concatenate([[0], np.cumsum(of_pair)[:-1]]), of_pair) + np.arange(len(order))]
            docs_of = token >> np.uint32(1)
            c = np.bincount(np.repeat(np.arange(len(of_pair)), of_pair), token & np.uint32(1), minlength=len(of_pair))
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(int(number % buckets), 1, number, pack(np.array([d or 0 for d in ids], "<i8"), np.array([d is None for d in ids], "|u1"), learned.astype("|u1"), lengths.astype("<u4"), of_pair.astype("<u4"), docs_of.astype("<u4")))]
            for b in range(buckets):
                x, y = cuts[b], cuts[b + 1]
                if x < y:
                    head = np.flatnonzero(np.concatenate([[True], np.diff(u[x:y]) != 0]))
                    rows.append((b, 0, number, pack(u[x:y][head], np.diff(np.append(head, y - x)).astype("<u4"), w[x:y], c[x:y].astype("<u4"))))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for doc_id, text, flag in zip(column(batch, "doc_id"), column(batch, "text"), column(batch, "learned")):
                words = (text or "").encode("utf-8", "replace").lower().split()
                held.append(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))
                ids.append(doc_id)
                flags.append(flag)
                tokens += len(words) + 1
                if tokens >= batch_tokens:
                    yield packets()
                    number, ids, flags, held, tokens = number + 1, [], [], [], 0
        if held:
            yield packets()
        _WORDS.clear()  # idle workers hold no memory

    def seat(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        blobs = frame[frame.kind == 0].sort_values("batch").blob.tolist()
        rows = []
        if blobs:
            world = Bucket(blobs, int(key[0]), hot)
            tables, counts, place = world.seat(), world.counts(), _spread(world.words, buckets)
            totals = world.contexts[world.hot], world.tables_of_contexts()[world.hot].astype("<i8"), world.cu[world.hot].astype("<i8")
            spread = _spread(totals[0], buckets)
            for b in np.union1d(np.unique(place), np.unique(spread)):
                mine, theirs = place == b, spread == b
                rows.append((int(b), int(key[0]), pack(world.words[mine], counts[mine].astype("<i8"), tables[mine].astype("<i8"), *(x[theirs] for x in totals))))
        return pd.DataFrame(rows, columns=["place", "bucket", "blob"]).astype({"place": "int32", "bucket": "int32"})

    def added(frame: pd.DataFrame) -> tuple:
        """What the context buckets sent this word bucket, added up by word; and the number of each sent word there."""
        parts = [unpack(b) for b in frame.blob]
        words, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count, customers = (np.bincount(of, np.concatenate([p[i] for p in parts]), minlength=len(words)).astype(np.int64) for i in (1, 2))
        return parts, of, count, customers

    def size(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, _, count, customers = added(frame.sort_values("bucket"))
        rng, known = np.random.default_rng([int(key[0]), 12]), int((count > 0).sum())
        t = np.minimum(customers, 1)
        for _ in range(BURN_IN):
            t = draw_tables(rng, customers, t.sum() * buckets - t, np.full(len(t), 1 / (known * buckets + 1)), ROOT_D, ROOT_T)
        return pd.DataFrame([(int(key[0]), int(count.sum()), known, int(customers.sum()), int(t.sum()))], columns=["place", "n", "v", "customers", "tables"]).astype({"place": "int32"})

    def root(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Answers (kind 0) to the context buckets, and this bucket's tables (kind 1)."""
        if frame.empty:
            return pd.DataFrame({c: [] for c in ("bucket", "kind", "batch", "blob", "tables")}).astype({"bucket": "int32", "kind": "int32", "batch": "int64", "tables": "float64"})
        frame = frame.sort_values("bucket")
        parts, of, count, customers = added(frame)
        spread, spread_of = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        spread_t, spread_c = (np.bincount(spread_of, np.concatenate([p[i] for p in parts]), minlength=len(spread)).astype(np.int64) for i in (4, 5))
        rng, elsewhere = np.random.default_rng([int(key[0]), 13]), int(told.tables.iloc[0]) - int(told.own.iloc[0])
        base = np.full(len(count), 1 / (int(told.v.iloc[0]) + 1))
        t, mean = np.minimum(customers, 1), np.zeros(len(count))
        for i in range(BURN_IN + SAMPLES):
            t = draw_tables(rng, customers, elsewhere + t.sum() - t, base, ROOT_D, ROOT_T)
            mean += t / SAMPLES if i >= BURN_IN else 0
        rows, at, spread_at = [], 0, 0
        for bucket, p in zip(frame.bucket, parts):
            mine, theirs = of[at : at + len(p[0])], spread_of[spread_at : spread_at + len(p[3])]
            at, spread_at = at + len(p[0]), spread_at + len(p[3])
            rows.append((int(bucket), 0, int(key[0]), pack(count[mine], customers[mine], mean[mine].astype("<f4"), spread_t[theirs], spread_c[theirs]), 0.0))
        rows.append((-1, 1, int(key[0]), b"", float(mean.sum())))
        return pd.DataFrame(rows, columns=["bucket", "kind", "batch", "blob", "tables"]).astype({"bucket": "int32", "kind": "int32"})

    def predict(key: tuple, packets: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        info = packets[packets.kind == 1]
        rows = [(int(b), -1, blob) for b, blob in zip(info.batch, info.blob)]
        mine = packets[packets.kind == 0].sort_values("batch")
        if len(mine):
            world = Bucket(mine.blob.tolist(), int(key[0]), hot)
            world.seat()
            place, spread = _spread(world.words, buckets), _spread(world.contexts[world.hot], buckets)
            count, customers, tables = np.zeros(len(world.words), np.int64), np.zeros(len(world.words)), np.zeros(len(world.words))
            spread_t, spread_c = np.zeros(len(spread)), np.zeros(len(spread))
            for b, blob in zip(answers.batch, answers.blob):
                where, hot_where = place == b, spread == b
                count[where], customers[where], tables[where], spread_t[hot_where], spread_c[hot_where] = unpack(blob)
            n, v, all_customers, all_tables = (answers[c].iloc[0] for c in ("n", "v", "customers", "tables"))
            if n:
                parent = (np.maximum(customers - ROOT_D * tables, 0) + (ROOT_T + ROOT_D * all_tables) / (v + 1)) / (ROOT_T + all_customers)
            else:
                parent = np.ones(len(world.words))
            cu = world.cu.astype(float)
            world.extra[world.hot] = spread_t - world.tables_of_contexts()[world.hot]
            cu[world.hot] = spread_c
            p = np.zeros(len(world.c))
            for i in range(BURN_IN + SAMPLES):
                world.sweep(parent)
                if i >= BURN_IN:
                    opening = (CONTEXT_T + CONTEXT_D * world.tables_of_contexts())[world.u]
                    p += (np.maximum(world.c - CONTEXT_D * world.t, 0) + opening * parent[world.w]) / (CONTEXT_T + cu[world.u]) / SAMPLES
            if not n:
                p[:] = 1
            count, model = count[world.w], np.log10(p).astype("<f4")
            for batch, pair in zip(mine.batch, np.split(world.pair_of, world.splits)):
                rows.append((int(batch), int(key[0]), pack(count[pair].astype("<i8"), model[pair])))
        return pd.DataFrame(rows, columns=["batch", "bucket", "blob"]).astype({"bucket": "int32"})

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        """Row -1 is the batch itself; the others hold its pairs, bucket after bucket."""
        frame = frame.sort_values("bucket")
        ids, null, learned, lengths, times, doc = unpack(frame.blob.iloc[0])
        parts = [unpack(b) for b in frame.blob.iloc[1:]]
        count, log_p = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        sums = ((count > 0).astype(float), np.log10(count + 1.0), log_p.astype(float))
        known, base, model = (np.bincount(doc, np.repeat(x, times), minlength=len(ids)) for x in sums)
        known = known.astype(np.int64)
        return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64").copy() if not null.any() else pd.array([None if x else i for i, x in zip(ids.tolist(), null)], dtype="Int64"), "held_out": learned == 0, "n_tokens": lengths.astype(np.int64), "n_known": known, "base_sum": base, "score": model})

    packets = marked.mapInArrow(count, PACKETS)
    words = packets.groupBy("bucket").applyInPandas(seat, "place int, bucket int, blob binary")
    sizes = words.groupBy("place").applyInPandas(size, "place int, n long, v long, customers long, tables long")
    all_sizes = sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "customers", "tables")))
    given = sizes.select("place", F.col("tables").alias("own")).crossJoin(F.broadcast(all_sizes))  # one row
    answers = words.groupBy("place").cogroup(given.groupBy("place")).applyInPandas(root, PACKETS + ", tables double")
    tables = answers.where("kind = 1").agg(F.coalesce(F.sum("tables"), F.lit(0.0)).alias("tables"))
    totals = all_sizes.drop("tables").crossJoin(F.broadcast(tables))  # one row
    told = answers.where("kind = 0").select("bucket", "batch", "blob").crossJoin(F.broadcast(totals))
    sums = packets.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(predict, "batch long, bucket int, blob binary")
    out = sums.groupBy("batch").applyInPandas(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double")
    base = F.when(F.col("n") > 0, F.col("base_sum") - F.col("n_tokens") * F.log10(F.col("n") + F.col("v") + 1)).otherwise(0.0)
    return out.crossJoin(F.broadcast(totals)).select("doc_id", "held_out", "n_tokens", "n_known", F.col("n").alias("train_tokens"), base.alias("base_score"), "score")


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
