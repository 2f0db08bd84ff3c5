"""Near-duplicate documents (operator 4): consistent weighted sampling over TF-IDF word shingles, banded and verified.

1. Documents with equal words are one node. Five-word shingles get the weight tf x (0.9 + 0.1 x idf), with idf from the
   counts of all documents' shingles in hashed cells.
2. Improved consistent weighted sampling gives each node one sample per hash function; bands of samples are buckets.
3. Every bucket has a centre. A node is compared with the centre that it meets in most buckets; similarities are exact.
4. Buckets whose nodes aren't all connected go on. A node is compared with the node of its buckets that has the least weight on
   rare shingles, and pairs that share a rare shingle, which are few, are compared. For all other pairs, how far both are
   from a centre bounds how near they can be; nodes that can't be near any other leave. What remains of a centre's nodes is cut
   into blocks that meet two by two, each node as its few differences from the centre. A pair of blocks gives the links that
   connect its classes, no row per pair: a large group of copies with scattered edits doesn't turn into all its pairs, and
   no link is left out.
5. Links are joined to classes by least labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import Index, bound_batches, fingerprint, in_batches, keep, utf8
from .decontaminate import words

SHINGLE, THRESHOLD = 5, 0.8
# A pair at the threshold shares a bucket with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.9998.
BANDS, ROWS = 12, 3
# A shingle that at most so many nodes of the open buckets have is rare.
RARE = 8
# Cells of the shingle counts, and how far idf may lower a weight.
CELLS, DAMPING = 1 << 16, 0.1
# Tables of nodes up to this many rows (40 bytes each) are broadcast to pick texts; larger ones are joined by shuffle.
BROADCAST_NODES = 1 << 19
# Labels of up to so many nodes are broadcast in each round of the classes, and written in a few files.
BROADCAST_LABELS, LABEL_FILES = 1 << 14, 6
# Nodes of one centre are cut into blocks of about so many rows, and bytes of differences.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles_of(texts: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """For each text the 128-bit hash of its words, and the sorted hashes of its shingles (repeats kept).

    A text of one to four words is one shingle; a text without words has none.
    """
    index, ids, names = Index(), [], []
    number = index.__getitem__
    for text in texts:
        ws = words(text)
        names.append(xxhash.xxh3_128_digest(b" ".join(ws)))
        ids.append(np.fromiter(map(number, ws), np.int64))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
    out = []
    for name, own in zip(names, ids):
        h = hashes[own]
        n = len(h) - SHINGLE + 1
        if len(h):
            width = SHINGLE if n > 0 else len(h)
            key = np.zeros(max(n, 1), np.uint64)
            for k in range(width):
                key = key * _MIX + h[k:k + len(key)]
            h = np.sort(_mixed(key))
        out.append((name, h))
    return out


def cell_weights(counts: np.ndarray) -> np.ndarray:
    """Factor of each cell: 1 for cells of rare shingles down to 1 - DAMPING."""
    total = max(int(counts.sum()), 2)
    return (1 - DAMPING + DAMPING * np.log(total / np.maximum(counts, 1)) / np.log(total)).astype(np.float64)


def weighted(hashes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights."""
    if not len(hashes):
        return hashes, np.zeros(0)
    first = np.append(True, hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return hashes[at], np.diff(np.append(at, len(hashes))) * factors[(hashes[at] & np.uint64(CELLS - 1)).astype(np.int64)]


def similarity(a: np.ndarray, b: np.ndarray, factors: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle lists."""
    (x, u), (y, v) = weighted(a, factors), weighted(b, factors)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    low = np.minimum(u[same], v[at[same]]).sum()
    return float(low / (u.sum() + v.sum() - low))


@lru_cache(maxsize=1)
def _sampling_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) for 16-bit uniforms, the logarithms of such, and a multiplier for each hash function."""
    grid = np.linspace(0, 30, 400_001)
    uniform = (np.arange(1 << 16) + 0.5) / (1 << 16)
    gamma = np.interp(uniform, 1 - (1 + grid) * np.exp(-grid), grid)
    odd = np.random.default_rng(20_240_101).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32), ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32), odd


def samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One consistent weighted sample (as a 64-bit number) for each hash function."""
    gamma, log_gamma, unit, odd = _sampling_tables()
    best = np.full(len(odd), np.inf, np.float32)
    out = np.zeros(len(odd), np.uint64)
    for at in range(0, len(hashes), 2048):  # long texts in parts of bounded memory
        x, s = hashes[at:at + 2048], np.log(weights[at:at + 2048]).astype(np.float32)
        z = odd[:, None] * (x ^ (x >> np.uint64(32)))[None, :]
        z ^= z >> np.uint64(32)
        z *= _MIX
        r = gamma[(z >> np.uint64(48)).astype(np.int64)]
        c = log_gamma[((z >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = unit[((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        t = np.floor(s[None, :] / r + beta)
        a = c - r * (t - beta) - r
        k = a.argmin(axis=1)
        row = np.arange(len(odd))
        better = a[row, k] < best
        best = np.where(better, a[row, k], best)
        picked = _mixed(x[k] + t[row, k].astype(np.int64).astype(np.uint64) * _MIX)
        out = np.where(better, picked, out)
    return out


def band_keys(hashes: np.ndarray, weights: np.ndarray) -> list[int]:
    """Bucket of each band as signed 64-bit number; the band's number is part of it."""
    if not len(hashes):
        return []
    s = samples(hashes, weights).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _MIX + s[:, k])
    return key.astype(np.int64).tolist()


def cell_counts(docs: DataFrame) -> np.ndarray:
    """Documents' shingles in each cell, over the whole corpus."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep("nothing", lambda: None)
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            own = [h[np.append(True, h[1:] != h[:-1])] for _, h in shingles_of(list(batch["text"])) if len(h)]
            if own:
                total += np.bincount((np.concatenate(own) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    sums = docs.select("text").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CELLS, np.int64)
    for row in sums.collect():  # at most CELLS rows
        counts[row.cell] = row.n
    return counts


def compare(pairs: DataFrame, sets: DataFrame, factors, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least the threshold."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        same = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), factors.value) >= threshold
                for x, y in zip(batch["xs"], batch["ys"])]
        return batch.loc[same, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xs"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("ys"))
    return in_batches(pairs.join(left, "a").join(right, "b"), run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge: the least node of its class.

    Least labels spread along edges, and labels are shortened to the label of the label, so that chains halve. Each round
    is written to the shared folder. No class is gathered in one task.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    few = labels.count() <= BROADCAST_LABELS
    small = F.broadcast if few else lambda rows: rows
    while True:
        near = both.join(small(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = near.join(small(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = small(labels.select(F.col("node").alias("label"), F.col("label").alias("far")))
        new = spread.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = staged(new.coalesce(LABEL_FILES) if few else new, "labels")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One document's text for each of the chosen nodes (rows node, id, fp)."""
    match = docs["id"].eqNullSafe(nodes["id"]) & (docs["fp"] == nodes["fp"])
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    # Repeated rows of a document give the same text.
    return docs.join(nodes, match).select("node", "text").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``id_column``, ``class_id`` (least id of its class), ``class_size``, ``fp`` and ``keep``.

    Documents are linked if their words (runs of letters, digits and non-ASCII characters, A-Z lower-cased) are equal, or the
    weighted Jaccard similarity of their shingles is at least ``threshold``; classes are the connected groups. ``keep`` marks one
    document of each class: the least id (nulls last), then the least fingerprint.

    Null and empty texts have no words and form one class. Texts of one to four words are one shingle. Null ids are ids of
    their own documents; ``class_id`` is null only if all ids of the class are. Repeated rows are copies: of rows equal in id and
    text all or none are kept here, and ``deduplicate`` keeps one. Other columns aren't read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), fingerprint(text_column).alias("fp"), utf8(text_column).alias("text"))
    factors = spark.sparkContext.broadcast(cell_weights(cell_counts(rows)))

    def sign(batch: pd.DataFrame) -> pd.DataFrame:
        found = shingles_of(list(batch["text"]))
        weights = [weighted(h, factors.value) for _, h in found]
        return pd.DataFrame({"id": batch["id"], "fp": batch["fp"], "node": [n for n, _ in found], "weight": [w.sum() for _, w in weights],
                             "bands": [band_keys(*w) for w in weights]})

    signed = staged(in_batches(rows, sign, f"id {kind}, fp long, node binary, weight double, bands array<long>"), "signed")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp")
    nodes = signed.groupBy("node").agg(F.min(order).alias("first"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    placed = staged(nodes.select("node", "first.id", "first.fp", "weight", F.explode("bands").alias("bucket")), "buckets")
    centre = placed.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = staged(placed.join(centre, "bucket"), "shared-buckets")
    chosen = staged(shared.dropDuplicates(["node"]).select("node", "id", "fp"), "candidates")

    def gather(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": batch["node"], "shingles": [h.tobytes() for _, h in shingles_of(list(batch["text"]))]})

    sets = staged(in_batches(_texts(rows, chosen), gather, "node binary, shingles binary"), "shingles")
    # One centre for each node: the one it meets in most buckets, and so is most alike.
    met = shared.where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
    stars = met.groupBy("node").agg(F.max_by("centre", F.struct("n", "centre")).alias("a")).select("a", F.col("node").alias("b"))
    links = staged(compare(stars, sets, factors, threshold), "star-links")
    labels = components(links)
    able, bounds, rare, held = _able(shared, sets, labels, factors, threshold)
    steps = ((lambda: _second_stars(_labelled(able, labels)).unionByName(_rare_pairs(rare, _labelled(bounds, labels), threshold)), "second-links"),
             (lambda: _open_pairs(_labelled(able, labels), sets, held, factors, threshold), "open-links"))
    for pairs, name in steps:
        more = staged(compare(pairs(), sets, factors, threshold), name)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    return _classes(signed, labels, id_column)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _able(shared: DataFrame, sets: DataFrame, labels: DataFrame, factors, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What the buckets that aren't one class need to go on.

    A shingle is rare if at most RARE nodes of such buckets have it. ``alone`` is the weight of a node's shingles that no
    other of these nodes has, ``few`` that of all its rare ones. Two nodes without a rare shingle in common share at most
    weight - few. Gives the bucket rows of nodes that can reach the threshold so, all nodes' bounds, the rare shingles that nodes
    share, and each node's rare shingles.
    """
    named = _labelled(shared.select("bucket", "node", "weight"), labels)
    # Per bucket the least and greatest label: they differ if the bucket isn't one class.
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    open_rows = staged(named.join(mixed, "bucket").select("bucket", "node", "weight"), "open-buckets")

    def spread(batch: pd.DataFrame) -> pd.DataFrame:
        parts = [weighted(np.frombuffer(s, np.uint64), factors.value) for s in batch["shingles"]]
        return pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), [len(h) for h, _ in parts]),
                             "shingle": np.concatenate([h for h, _ in parts]).astype(np.int64), "w": np.concatenate([w for _, w in parts])})

    wanted = open_rows.select("node", "weight").distinct()
    rows = in_batches(sets.join(wanted.select("node"), "node"), spread, "node binary, shingle long, w double")
    # Counts combine before the shuffle, and rows of frequent shingles end at the join.
    few = rows.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") <= RARE)
    rare = staged(rows.join(few, "shingle"), "rare-shingles")
    sums = rare.groupBy("node").agg(F.sum(F.when(F.col("n") == 1, F.col("w")).otherwise(0.0)).alias("alone"), F.sum("w").alias("few"))
    bounds = staged(wanted.join(sums, "node", "left").na.fill(0.0, ["alone", "few"]), "bounds")
    able = bounds.where((F.col("weight") - F.col("few")) >= (threshold - 1e-9) * F.col("weight"))
    return (staged(open_rows.select("bucket", "node").join(able, "node"), "able"), bounds, rare.where("n > 1").select("shingle", "node"),
            rare.groupBy("node").agg(F.collect_list("shingle").alias("rare")))


def _second_stars(able: DataFrame) -> DataFrame:
    """One centre for each node again: of its buckets' nodes the one with the least weight on rare shingles."""
    centre = able.groupBy("bucket").agg(F.min(F.struct("few", "node", "label")).alias("c"))
    stars = able.join(centre, "bucket").where((F.col("node") != F.col("c.node")) & (F.col("label") != F.col("c.label")))
    return stars.groupBy("node").agg(F.min(F.struct("c.few", "c.node")).alias("c")).select(F.col("c.node").alias("a"), F.col("node").alias("b"))


def _rare_pairs(rare: DataFrame, bounds: DataFrame, threshold: float) -> DataFrame:
    """Pairs with a rare shingle in common, at most RARE for each, that aren't connected and may reach the threshold."""
    x, y = (bounds.select(*[F.col(c).alias(f"{k}_{c}") for c in ("node", "label", "weight", "alone")]) for k in "xy")
    held = rare.join(bounds.where((F.col("weight") - F.col("alone")) >= (threshold - 1e-9) * F.col("weight")).select("node"), "node", "left_semi")
    pairs = held.withColumnRenamed("node", "x_node").join(held.withColumnRenamed("node", "y_node"), "shingle").where("x_node < y_node")
    pairs = pairs.select("x_node", "y_node").distinct().join(x, "x_node").join(y, "y_node")
    return pairs.where((F.col("x_label") != F.col("y_label")) & _reach("x_weight", "x_alone", "y_weight", "y_alone", threshold)).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def _differences(pairs: DataFrame, sets: DataFrame, held: DataFrame, factors, threshold: float) -> DataFrame:
    """For rows (node, centre, label) what the node needs and has for a link with another node of the centre.

    ``keys`` are the shingles in which the two differ, one key for each occurrence and side, without what the node alone has
    of rare ones. Their weight is ``common_off``: a node without a rare shingle of this one can have no more in common with it
    against the centre. ``own`` is ``off``, the weight in which the two differ, less what half a link allows, and ``room`` the
    most that the other node's ``own`` may be.
    """
    share = (1 - threshold) / (1 + threshold)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for xs, ys, rare in zip(batch["xs"], batch["ys"], batch["rare"]):
            (x, u), (y, v) = (weighted(np.frombuffer(h, np.uint64), factors.value) for h in (xs, ys))
            both, where = np.unique(np.concatenate([x, y]), return_inverse=True)
            more = np.zeros(len(both))
            np.add.at(more, where, np.concatenate([u, -v]))
            each = factors.value[(both & np.uint64(CELLS - 1)).astype(np.int64)]
            times = np.rint(more / each).astype(np.int64)
            common = times != 0
            if rare is not None and len(rare):
                common &= (times < 0) | ~np.isin(both, np.asarray(rare, np.int64).astype(np.uint64))
            n = np.abs(times[common])
            keys = _occurrences(both[common], n, times[common] > 0)
            own = np.abs(more).sum() - share * u.sum()
            rows.append((own, 2 * (n * each[common]).sum() - own, keys.tobytes()))
        own, room, keys = zip(*rows)
        return batch[["centre", "node", "label"]].assign(own=own, room=room, keys=keys)

    left = sets.select("node", F.col("shingles").alias("xs")).join(held, "node", "left")
    right = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("ys"))
    return in_batches(pairs.join(left, "node").join(right, "centre").select("centre", "node", "label", "xs", "ys", "rare"), run,
                      "centre binary, node binary, label binary, own double, room double, keys binary")


def _occurrences(hashes: np.ndarray, n: np.ndarray, side: np.ndarray) -> np.ndarray:
    """One key for each occurrence of a shingle on a side. The low bits stay those of the shingle's cell."""
    which = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    low = np.uint64(CELLS - 1)
    key = _mixed(hashes[which] * _MIX + (2 * nth + side[which]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (key & ~low) | (hashes[which] & low)


def _open_pairs(able: DataFrame, sets: DataFrame, held: DataFrame, factors, threshold: float) -> DataFrame:
    """Links of buckets that aren't connected yet, among nodes without a common rare shingle; a few more may be named at the threshold.

    Nodes are compared with a centre of their bucket. Distance is the weight in which two nodes differ; at the threshold t it is
    at most k = (1 - t) / (1 + t) of both weights. Two nodes differ from each other by what they differ from the centre, less
    twice what they have in common of that: a link needs 2 common >= (off - k weight) of both together. What they have in common
    is at most the lesser ``common_off``, so nodes that can't meet this with the best of their centre leave; nearly
    all of a group with scattered edits do, as their edits are rare. Buckets of one class end here, and buckets with one centre
    (it has at most BANDS) go on as one group, whose blocks meet two by two.
    """
    mixed = able.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                       F.min(F.struct("few", "node"))["node"].alias("centre")).where("low <> high").select("bucket", "centre")
    rows = able.join(mixed, "bucket").select("centre", "node", "label").distinct()
    rows = staged(_differences(rows, sets, held, factors, threshold), "differences")
    best = rows.groupBy("centre").agg(F.min("own").alias("least_own"), F.max("room").alias("most_room"))
    left = rows.join(best, "centre").where((F.col("own") <= F.col("most_room") + 1e-6) & (F.col("least_own") <= F.col("room") + 1e-6))
    left = staged(left.select("centre", "node", "label", "own", "keys"), "open-rows")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.length("keys")) / BLOCK_BYTES)).cast("int")
    sizes = left.groupBy("centre").agg(F.min("label").alias("low"), F.max("label").alias("high"), parts.alias("parts")).where("low <> high")
    blocks = left.join(sizes.select("centre", "parts"), "centre").withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("centre", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "own", "keys")
    key = ["centre", "i", "j"]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.centre, row.i, row.j) != now:
                    if found := _links_of_blocks(held, factors.value):
                        yield pd.DataFrame(found, columns=["a", "b"])
                    held, now = [], (row.centre, row.i, row.j)
                held.append(row)
        if found := _links_of_blocks(held, factors.value):
            yield pd.DataFrame(found, columns=["a", "b"])

    return blocks.repartition(*key).sortWithinPartitions(*key).mapInPandas(meet, "a binary, b binary").distinct()


def _links_of_blocks(rows: list, factors: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links that connect the classes of two blocks (of one, if it meets itself), and pairs too close to the threshold to tell."""
    if len({r.label for r in rows}) < 2:
        return []
    one = rows[0].i == rows[0].j
    parts = [rows, rows] if one else [[r for r in rows if r.block == r.i], [r for r in rows if r.block == r.j]]
    if not parts[0] or not parts[1]:
        return []
    keys = [[np.frombuffer(r.keys, np.uint64) for r in part] for part in parts]
    distinct = [np.unique(np.concatenate(k), return_counts=True) for k in keys]
    shared = distinct[0][0][distinct[0][1] > 1] if one else np.intersect1d(distinct[0][0], distinct[1][0], assume_unique=True)
    common = np.zeros((len(parts[0]), len(parts[1])))
    for at in range(0, len(shared), 512):  # a few MB at a time
        some = shared[at:at + 512]
        held = [_held(k, some) for k in (keys[:1] if one else keys)]
        common += (held[0] * factors[(some & np.uint64(CELLS - 1)).astype(np.int64)]) @ held[-1].T
    own, label = ([np.array([getattr(r, c) for r in part], kind) for part in parts] for c, kind in (("own", float), ("label", object)))
    number = {x: k for k, x in enumerate(dict.fromkeys([*label[0], *label[1]]))}
    classes = [np.array([number[x] for x in part]) for part in label]
    gap = 2 * common - own[0][:, None] - own[1][None, :]
    near = (gap >= -1e-6) & (classes[0][:, None] != classes[1][None, :])
    x, y = np.nonzero(np.triu(near, 1) if one else near)
    parent, out = list(range(len(number))), []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in np.argsort(-gap[x, y], kind="stable"):
        a, b = find(classes[0][x[k]]), find(classes[1][y[k]])
        if a != b:
            out.append((parts[0][x[k]].node, parts[1][y[k]].node))
            if gap[x[k], y[k]] > 1e-6:
                parent[a] = b
    return out


def _held(keys: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """Which row has which of some sorted keys, as zeros and ones."""
    every = np.concatenate(keys)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    at = np.minimum(np.searchsorted(some, every), len(some) - 1)
    same = some[at] == every
    out = np.zeros((len(keys), len(some)))
    out[row[same], at[same]] = 1
    return out


def _reach(weight: str, alone: str, other_weight: str, other_alone: str, threshold: float) -> Column:
    """Whether the similarity may reach the threshold: neither node shares its own part, so that
    common <= least(weight - alone) of both, and joint = weight + other weight - common."""
    common = F.least(F.col(weight) - F.col(alone), F.col(other_weight) - F.col(other_alone))
    return common >= (threshold - 1e-9) * (F.col(weight) + F.col(other_weight) - common)


def _classes(signed: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    named = signed.select("id", "fp", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = staged(named.select("id", "fp", "label"), "named")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp")
    found = named.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    return named.join(found, "label").select(
        F.col("id").alias(id_column), F.col("first.id").alias("class_id"), "class_size", "fp",
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("fp") == F.col("first.fp"))).alias("keep"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns, whatever their names, of one document of each class; of repeated rows one stays."""
    kept = (near_duplicates(docs, id_column, text_column, threshold).where("keep")
            .select(F.col(id_column).alias("_id"), F.col("fp").alias("_fp")).distinct())
    if kept.count() <= BROADCAST_NODES:
        kept = F.broadcast(kept)
    rows = docs.select(F.struct(F.col("*")).alias("_row"), F.col(id_column).alias("_own_id"), fingerprint(text_column).alias("_own_fp"))
    chosen = rows.join(kept, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_fp") == F.col("_fp")))
    # Only rows that repeat with id and text need to be told apart; without any, no row is shuffled.
    again = docs.groupBy(F.col(id_column).alias("_id"), fingerprint(text_column).alias("_fp")).agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        chosen = chosen.dropDuplicates(["_id", "_fp"])
    return chosen.select("_row.*")
