"""Operator 7: near duplicates by bottom-k sketches of one hash function.

1. A document's set is its distinct shingles of five words, hashed to 64 bits. Documents with equal sets form a class;
   from here on a class is one node, whatever its number of copies.
2. The k least hashes of a set are its sketch. Inverted lists of the sketch values give overlaps. A value in more than
   ``hot`` sketches is hot; order values by (hot, hash). A node is listed under its first ``prefix`` values that are not
   hot. Those lists are short, and two sets with similarity s over such values share none with chance (1 - s)**prefix.
3. A node of whose sketch much is hot (at 0.85: over two fifths) is a hot node. Within the list of a hot value it is paired
   with the one node that has most hot values (of a group of near copies, the original).
4. The sketch of the union estimates each pair's similarity; pairs far below the threshold go.
5. Exact Jaccard on the full sets. Only pairs whose ends are not yet in one component are confirmed, each node's most
   similar partner first; the others follow, so no link that could join two components is left out.
6. What the lists of hot values leave open is settled exactly on the hot nodes' full sets, whose shingles are counted. A set
   that shares too few shingles with any other cannot have a link and goes; of the rest, each is listed under its rarest
   shared shingles, so many that two linked sets must meet in one list (a prefix filter). Lists within one component are
   closed, and so are nodes that no size in their list fits. Of an open list, short ones give their pairs; in long ones each
   node outside the list's largest component is compared with that component's centre, and then, if it is still outside,
   with all of the list: in blocks, as a product of incidence matrices, from which only links that join components leave.

Cases: a document without words has no set, is linked with nothing and kept; with fewer than five words, the whole sequence
is its one shingle; null text is empty; a null doc_id is linked with nothing, kept, and has a null component; repeated rows
are copies; other columns are not read.

The least similarity is a parameter in percent (``similar``), SIMILAR of the query. What the sketches rule out and which nodes
count as hot follow from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import as_rows, column, documents, marked, release_memory, small_batches, spread_join
from pulsegrid.llm.components import connected_components, written

WORDS, SIMILAR = 5, 85
K, PREFIX, HOT, BLOCK, BLOCK_SHINGLES = 64, 16, 50, 2000, 4_000_000
#: An estimate falls so many standard deviations below the true similarity with a chance of about one in 10**10.
DEVIATIONS = 6.5


def least_estimate(similar: int) -> float:
    """Estimates from K values below this rule a similarity of ``similar`` percent out."""
    s = similar / 100
    return s - DEVIATIONS * (s * (1 - s) / K) ** 0.5


class WordHashes(dict):
    """64-bit hashes of words; emptied now and then, which changes no hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = WordHashes()
# Fixed odd multipliers, one for each place in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes (as signed integers) of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    with np.errstate(over="ignore"):
        x = np.full(len(words) - width + 1, np.uint64(width))
        for j in range(width):
            x += hashes[j : len(words) - width + 1 + j] * _PLACES[j]
        x = (x ^ (x >> np.uint64(32))) * _PLACES[3]
        x ^= x >> np.uint64(29)
    return np.unique(x.view(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, check, sketch): node and check are the 128-bit digest of the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches, ends = [], [], [], [0]
            for text in column(batch, "text"):
                found = shingle_set(text)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketches.append(found[:K].copy())  # not a view, which would hold the full set
                ends.append(ends[-1] + len(sketches[-1]))
            both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sketches) if sketches else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), sketch], schema=schema)
        _WORDS.clear()  # idle workers hold no memory
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, node long, check long, sketch array<long>")


def candidate_pairs(classes: DataFrame, similar: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) with sizes that allow a link, from the short lists and from the hot ones; and the hot nodes (node).

    ``classes`` has node, n_shingles and sketch. Two sets of which at most 4 * similar - 300 percent is hot have a similarity of at
    least 0.75 over their other values.
    """
    values = classes.select("node", F.explode("sketch").alias("value"))
    shared = written(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    total = shared.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    listed = spread_join(values, shared, "value", "df", total).groupBy("node").agg(F.sort_array(F.collect_list(F.struct((F.col("df") > HOT).alias("hot"), "value"))).alias("values"))
    listed = listed.join(classes.select("node", "n_shingles", F.size("sketch").alias("k")), "node")
    listed = listed.select("node", "n_shingles", "k", F.filter("values", lambda x: ~x["hot"])["value"].alias("cold"), F.filter("values", lambda x: x["hot"])["value"].alias("warm"))
    listed = written(listed, "listed")
    cold = listed.select("node", "n_shingles", F.explode(F.slice("cold", 1, PREFIX)).alias("value"))
    left, right = cold.alias("x"), cold.alias("y")
    fits = 100 * F.least("x.n_shingles", "y.n_shingles") >= similar * F.greatest("x.n_shingles", "y.n_shingles")
    pairs = left.join(right, (F.col("x.value") == F.col("y.value")) & (F.col("x.node") < F.col("y.node")) & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    hot = listed.where(100 * F.size("warm") > max(0, 4 * similar - 300) * F.col("k"))
    warm = hot.select("node", F.size("warm").alias("centrality"), F.explode(F.slice("warm", 1, PREFIX)).alias("value"))
    centre = warm.groupBy("value").agg(F.max(F.struct("centrality", "node"))["node"].alias("centre"), F.count("*").alias("df"))
    stars = spread_join(warm, centre, "value", "df", total).where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return pairs.unionByName(stars).distinct(), hot.select("node")


def estimated(pairs: DataFrame, classes: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Pairs (a, b, estimate) that the sketch of the union does not rule out."""
    sketches = classes.select("node", "sketch")
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    estimate = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
    return both.select("a", "b", estimate.alias("estimate")).where(F.col("estimate") >= least_estimate(similar))


def full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, items) of ``nodes`` (node) at least: the full sets, sorted. A node can come more than once, and others beside.

    The texts are read again, only those of each class's first document: a bitmap leaves out most others during the scan, and a
    join on doc_id the rest.
    """
    wanted = written(nodes.join(classes.select("node", F.col("first").alias("doc_id")), "node").select("doc_id").distinct(), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, seen = None, set()
        for batch in batches:
            nodes, items, ends = [], [], [0]
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text")):
                found = shingle_set(text)
                node = _digest(found)
                if doc_id != doc:  # rows come sorted by doc_id: repeated ones are told once
                    doc, seen = doc_id, set()
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    items.append(found)
                    ends.append(ends[-1] + len(found))
            values = pa.array(np.concatenate(items) if items else [], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["node", "items"])
        _WORDS.clear()
        release_memory()

    texts = marked(docs.select("doc_id", "text"), wanted).where("marked").select("doc_id", "text")
    return texts.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(sets, "node long, items array<long>")


def _digest(items: np.ndarray) -> int:
    """The node of a set: the leading half of its 128-bit digest."""
    return int(np.frombuffer(xxhash.xxh3_128_digest(items.tobytes())[:8], ">i8")[0])


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """The lists of a column, without a copy."""
    lists = batch.column(batch.schema.get_field_index(name))
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def confirmed(pairs: DataFrame, items: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Of ``pairs`` (a, b), the links on full sets; ``items`` has (node, items) of their ends."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_arrays(batch, "left"), _arrays(batch, "right")):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= similar * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(items.select(F.col("node").alias("a"), F.col("items").alias("left")), "a").join(items.select(F.col("node").alias("b"), F.col("items").alias("right")), "b")
    return joined.mapInArrow(compare, "a long, b long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _across(pairs: DataFrame, components: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    if components is None:
        return pairs
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    found = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return found.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _resolve(candidates: DataFrame, docs: DataFrame, classes: DataFrame, similar: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Confirm candidates until every one is confirmed, refused, or within a component; all links, and the components."""
    links, components, first = None, None, True
    while True:
        left = written(_across(candidates, components), "left")
        if left.isEmpty():
            return links, components
        ends = left.select(F.col("a").alias("node"), "a", "b", "estimate").unionByName(left.select(F.col("b").alias("node"), "a", "b", "estimate"))
        best = ends.groupBy("node").agg(F.max(F.struct("estimate", "a", "b")).alias("best")).select("best.a", "best.b").distinct() if first else left.select("a", "b")
        found = written(confirmed(best, full_sets(_ends(best), docs, classes), similar), "links")
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            components = connected_components(links)
        if not first:
            return links, components
        candidates, first = left.join(best, ["a", "b"], "left_anti"), False


def joining_links(nodes: np.ndarray, components: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similar: int = SIMILAR) -> list[tuple[int, int]]:
    """Links between rows of side 0 and of side 1 (of one side: among them) that join components, as a forest.

    Intersections are a product of 0/1 incidence matrices over the values that occur more than once, some columns at a time.
    """
    sizes = np.array([len(s) for s in sets])
    _, column_of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row_of, shared = np.repeat(np.arange(len(sets)), sizes), times > 1
    number = np.cumsum(shared) - 1
    kept = shared[column_of]
    row_of, column_of = row_of[kept], number[column_of[kept]]
    order = np.argsort(column_of, kind="stable")
    row_of, column_of = row_of[order], column_of[order]
    one, two = (side == 0, side == 1) if side.any() and not side.all() else (np.ones(len(side), bool),) * 2
    both = np.zeros((one.sum(), two.sum()), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column_of, [start, start + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[row_of[a:b], column_of[a:b] - start] = 1
        both += x[one] @ x[two].T
    linked = 100 * both >= similar * (sizes[one][:, None] + sizes[two][None, :] - both)
    linked &= components[one][:, None] != components[two][None, :]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    out = []
    left, right = nodes[one], nodes[two]
    cl, cr = components[one], components[two]
    for i, j in zip(*np.nonzero(linked)):
        x, y = find(int(cl[i])), find(int(cr[j]))
        if x != y:
            root[x] = y
            out.append((int(min(left[i], right[j])), int(max(left[i], right[j]))))
    return out


def prefix_lists(hot: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(value, node, n, most): hot nodes under the shingles in one of which any two linked ones meet.

    ``n`` is the size of the set and ``most`` the largest size that a partner can have. Shingles are counted over all hot sets.
    """
    left = written(sets.join(hot, "node", "left_semi").dropDuplicates(["node"]), "hot-sets")
    rows = left.select("node", F.size("items").alias("n"), F.explode("items").alias("value"))
    counts = written(rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "hot-counts")
    total = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    ordered = spread_join(rows, counts, "value", "df", total).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value")))["value"].alias("shared"))
    left = ordered.where(100 * F.size("shared") >= similar * F.col("n"))
    # a partner holds at most the shared shingles: similar percent of the union bounds its size
    most = F.floor(F.size("shared") * (100 + similar) / similar + 1e-9).cast("int") - F.col("n")
    prefix = F.size("shared") - F.ceil(similar * F.col("n") / 100 - 1e-9).cast("int") + 1
    return left.select("node", "n", most.alias("most"), F.explode(F.slice("shared", F.lit(1), prefix)).alias("value"))


def open_lists(listing: DataFrame, components: DataFrame | None, again: bool) -> DataFrame:
    """The listings (value, node, n, most, component) of lists that hold several components and sizes that may fit, with the lists' figures.

    With ``again``, what is left is looked at a second time, without the nodes that no size in their list fits.
    """
    listing = listing.join(components, "node", "left") if components is not None else listing.withColumn("component", F.lit(None).cast("long"))
    listing = written(listing.withColumn("component", F.coalesce("component", "node")), "listing")
    for once_more in [True, False] if again else [False]:
        parts = listing.groupBy("value", "component").agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("most").alias("high"), F.max(F.struct("most", "node"))["node"].alias("centre"))
        lists = parts.groupBy("value").agg(F.sum("rows").alias("df"), F.count("*").alias("components"), F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.struct("rows", "component", "centre")).alias("main"))
        lists = written(lists.where("components > 1"), "lists")
        total = lists.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        found = spread_join(listing, lists, "value", "df", total).where("most >= low and n <= high")
        if once_more:
            listing = written(found.select("value", "node", "n", "most", "component"), "listing")
    return written(found.withColumn("minor", F.col("component") != F.col("main.component")), "open")


def _rest_of_hot_lists(hot: DataFrame, docs: DataFrame, classes: DataFrame, links: DataFrame | None, components: DataFrame | None, similar: int) -> tuple[DataFrame | None, DataFrame | None]:
    """All links and the components, after the hot nodes' sets have been compared exactly as far as components are still open."""
    if hot.isEmpty():
        return links, components
    sets = written(full_sets(hot, docs, classes), "hot-sets")
    listing = prefix_lists(hot, sets, similar)
    open_ = open_lists(listing, components, again=True)
    if open_.isEmpty():
        return links, components
    short = open_.where(F.col("df") <= HOT)
    x, y = short.alias("x"), short.alias("y")
    fits = (F.col("x.component") != F.col("y.component")) & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    pairs = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.node") < F.col("y.node")) & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    stars = open_.where((F.col("df") > HOT) & F.col("minor")).select(F.least("node", "main.centre").alias("a"), F.greatest("node", "main.centre").alias("b"))
    found = written(confirmed(pairs.unionByName(stars).distinct(), sets, similar), "links")
    if not found.isEmpty():
        links = found if links is None else links.unionByName(found)
        components = connected_components(links)
    long = open_lists(open_.where(F.col("df") > HOT).select("value", "node", "n", "most"), components, again=False)
    if long.isEmpty():
        return links, components
    blocks = lambda rows, items: F.ceil(F.greatest(rows / BLOCK, items / BLOCK_SHINGLES)).cast("int")
    sizes = long.groupBy("value").agg(F.count("*").alias("rows"), blocks(F.count("*"), F.sum("n")).alias("many"), F.coalesce(blocks(F.sum(F.col("minor").cast("int")), F.sum(F.when(F.col("minor"), F.col("n")))), F.lit(0)).alias("few"))
    parted = spread_join(long, sizes.where("few > 0"), "value", "rows", long.count()).join(sets.dropDuplicates(["node"]), "node")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    one = parted.where("minor").withColumn("other", F.explode(F.expr("sequence(0, many - 1)"))).select("value", place("few").alias("low"), F.col("other").alias("high"), F.lit(0).alias("side"), "node", "component", "items")
    two = parted.withColumn("other", F.explode(F.expr("sequence(0, few - 1)"))).select("value", F.col("other").alias("low"), place("many").alias("high"), F.lit(1).alias("side"), "node", "component", "items")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["node", "side"])
        found = joining_links(frame.node.to_numpy(), frame.component.to_numpy(), list(frame["items"]), frame.side.to_numpy(), similar) if frame.side.nunique() == 2 else []
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    found = written(one.unionByName(two).groupBy("value", "low", "high").applyInPandas(compare, "a long, b long").distinct(), "links")
    if found.isEmpty():
        return links, components
    links = found if links is None else links.unionByName(found)
    return links, connected_components(links)


def decisions(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row a document: doc_id, node, check, n_shingles, component (its least node), component_id (its least doc_id), kept."""
    with small_batches(docs.sparkSession):
        signed = written(signatures(docs), "signatures")
        sets = signed.where("n_shingles > 0 and doc_id is not null")
        classes = written(sets.groupBy("node", "check").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
        pairs, hot = candidate_pairs(classes, similar)
        candidates = written(estimated(pairs, classes, similar), "candidates")
        links, components = _resolve(candidates, docs, classes, similar)
        links, components = _rest_of_hot_lists(hot, docs, classes, links, components, similar)
    named = classes.select("node", "check", "first")
    if components is not None:
        labels = components.join(classes.select("node", "first"), "node")
        least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
        named = named.join(components.join(least, "component").select("node", "component", "component_id"), "node", "left").withColumns({"component": F.coalesce("component", "node"), "component_id": F.coalesce("component_id", "first")})
    else:
        named = named.withColumns({"component": F.col("node"), "component_id": F.col("first")})
    out = signed.drop("sketch").join(named.select("node", "check", "component", "component_id"), ["node", "check"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component_id"))
    out = out.select("doc_id", "node", "check", "n_shingles", "component", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    return decisions(docs, similar).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Of each component of ``docs`` one row, all columns as they are; documents without words or doc_id all stay.

    It is a row of the least doc_id; if that repeats with different texts, the one whose text has the least hash.

    A bitmap over the doc_ids that lose rows (or stand on several) parts the documents: the others pass without a shuffle,
    and only those on the bitmap are joined with the decisions.
    """
    found = written(decisions(docs, similar), "decisions").where("doc_id is not null")
    lost = found.where("not kept").select("doc_id").unionByName(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    lost = written(lost.distinct(), "lost")

    @F.arrow_udf("struct<node:long,check:long>")
    def identity(texts: pa.Array) -> pa.Array:
        both = b"".join(xxhash.xxh3_128_digest(shingle_set(t).tobytes()) for t in texts.to_pylist())
        halves = np.frombuffer(both, ">i8").astype(np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["node", "check"])

    identity = identity.asNondeterministic()  # or a null check of the join's key would digest every text in the scan
    told = marked(as_rows(docs, "doc_id", "text"), lost)
    kept = found.where("kept").groupBy("doc_id", "node", "check").agg(F.max("n_shingles").alias("n_shingles"), F.max("component").alias("component"))
    doubtful = told.where("marked").withColumn("set", identity("text")).select("row", "text", "doc_id", "set.node", "set.check").join(kept, ["doc_id", "node", "check"])
    own = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id())  # rows without words are groups of their own
    chosen = doubtful.withColumn("own", own).groupBy("doc_id", "component", "own").agg(F.min_by("row", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("row"))
    return told.where("not marked").select("row.*").unionAll(chosen.select("row.*"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
