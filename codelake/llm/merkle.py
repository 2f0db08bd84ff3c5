"""Merkle manifest of a dataset (operator 13), with octopus multiproofs per partition of leaves.

Every row is a leaf; the leaves of a source, by ascending id, form a tree of runs of three, and so do the sources' roots.
Leaves are dealt to partitions of consecutive ones. Each partition names the nodes that its leaves' proofs need and that it
can't derive itself, once each, whichever and however many leaves need them. One join fetches them; with its own leaves the
partition then derives all shared inner nodes, and writes out every leaf's own proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

ARITY = 3
# Leaves of one partition, about; a partition's nodes and proofs are held by one task.
LEAVES = 50_000
# Levels that one pass of grouping builds: a group has ARITY ** LEVELS nodes at most.
LEVELS = 5
# Tables of spans and coordinates are broadcast up to so many rows (some 100 bytes each); larger ones are joined by shuffle.
BROADCAST = 1 << 17
# The tree over the sources' roots; sources have numbers from 0.
TOP = -1


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def ordered(leaves: DataFrame, keys: list[Column], size: int) -> DataFrame:
    """Rows in global order in partitions of about LEAVES, with ``part`` and ``pos``, the place inside it."""
    parts = max(1, -(-size // LEAVES))
    dealt = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return staged(dealt.select("*", F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("pos")).drop("_at"), "ordered")


def numbered(leaves: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Leaves with ``part``, ``tree`` (number of the source), ``idx`` (place in the source) and ``n`` (leaves of the source)."""
    keys = [F.asc_nulls_first("source"), F.asc_nulls_last("id"), F.asc("leaf"), F.asc("row")]
    rows = ordered(leaves, keys, size)
    spans = staged(rows.groupBy("part", "source").agg(F.min("pos").alias("_first"), F.count("*").alias("_count")), "spans")
    n_spans = spans.count()
    # A source's spans: as many as partitions at most. Numbers of the sources: places in their own global order.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = spans.groupBy("source").agg(F.sum("_count").alias("n"))
    names = ordered(whole, [F.asc_nulls_first("source")], n_spans)
    heads = names.groupBy("part").agg(F.count("*").alias("_count"))  # one row per partition of names
    heads = heads.select(F.col("part").alias("_part"), F.coalesce(F.sum("_count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    names = names.join(F.broadcast(heads), F.col("part") == F.col("_part")).select(
        F.col("source").alias("_name"), "n", (F.col("pos") + F.col("_before")).alias("tree"))
    spans = spans.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    spans = staged(spans.join(_small(names, n_spans), F.col("source").eqNullSafe(F.col("_name"))).select(
        F.col("part").alias("_part"), "_name", "tree", "n", "_first", (F.col("_before") - F.col("_first")).alias("_shift"), "_count"), "spans")
    out = rows.join(_small(spans, n_spans), (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_name")))
    return out.select(*leaves.columns, "part", "tree", "n", (F.col("pos") + F.col("_shift")).alias("idx")), spans


def _above(nodes: Column) -> Column:
    """The digests of the runs of a list."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def build(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees of (tree, n, idx, digest) rows, as one row per group of up to ARITY ** LEVELS nodes.

    A row has ``tree``, ``level`` (of the group's lowest nodes), ``chunk`` (the group's place), ``nodes`` (a list of digests
    for each level from there) and ``last`` (the group holds its tree's root, the only node of its last list).
    """
    parts, level, rows, width = [], 0, leaves, ARITY ** LEVELS
    while True:
        chunk = F.floor(F.col("idx") / width).cast("long")
        low = rows.groupBy("tree", "n", chunk.alias("chunk")).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("_0"))
        nodes = [F.col("_0")]
        for k in range(1, LEVELS + 1):
            low = low.withColumn(f"_{k}", F.when((F.size(f"_{k - 1}") > 1) | (F.col("n") > width), _above(F.col(f"_{k - 1}"))))
            nodes.append(F.col(f"_{k}"))
        group = staged(low.select("tree", "n", F.lit(level).alias("level"), "chunk", F.array_compact(F.array(*nodes)).alias("nodes"),
                                  (F.col("n") <= width).alias("last")), "nodes")
        parts.append(group)
        rows = group.where("NOT last").select("tree", F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("chunk").alias("idx"),
                                              F.element_at(F.element_at("nodes", -1), 1).alias("digest"))
        level += LEVELS
        if rows.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("last").select("tree", F.element_at(F.element_at("nodes", -1), 1).alias("digest"))


def missing(first: int, last: int, n: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes that the proofs of leaves first..last of n need and that can't be derived from them.

    Leaves of a partition are consecutive, and so are the nodes derived from them: at each level a union of all proofs lacks
    only the rest of the first run and of the last one.
    """
    level = 0
    while n > 1:
        low, high = first // ARITY, last // ARITY
        for place in (*range(low * ARITY, first), *range(last + 1, min(high * ARITY + ARITY, n))):
            yield level, place
        first, last, n, level = low, high, -(-n // ARITY), level + 1


def _coordinates(spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(part, tree, level, place) for part, tree, first, last, n in batch.itertuples(index=False) for level, place in missing(first, last, n)]
            if rows:
                yield pd.DataFrame(rows, columns=["part", "tree", "level", "place"])

    return spans.select("part", "tree", "first", "last", "n").mapInPandas(run, "part long, tree long, level int, place long")


def fetch(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, tree, level, place, digest) of the wanted nodes."""
    base = F.floor(F.col("level") / LEVELS).cast("int") * LEVELS
    up = (F.col("level") - base).cast("int")
    width = F.pow(F.lit(ARITY), F.lit(LEVELS) - up).cast("long")
    # A tree's top node of a group is asked as the lowest node of the next group.
    asked = staged(wanted.select("part", F.col("tree").alias("_tree"), F.col("level").alias("_level"), "place", base.alias("_base"), up.alias("_up"),
                                 F.floor(F.col("place") / width).cast("long").alias("_chunk"), (F.col("place") % width).cast("int").alias("_slot")), "wanted")
    same = (F.col("tree") == F.col("_tree")) & (F.col("level") == F.col("_base")) & (F.col("chunk") == F.col("_chunk"))
    found = nodes.join(_small(asked, asked.count()), same)
    return found.select("part", "tree", F.col("_level").alias("level"), "place", F.element_at(F.element_at("nodes", F.col("_up") + 1), F.col("_slot") + 1).alias("digest"))


class Tree:
    """What a partition knows of one tree: its own consecutive leaves, fetched nodes, and all nodes that follow from them."""

    def __init__(self, first: int, digests: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.levels, self.sizes = [], []
        level = 0
        while True:
            known = dict(zip(range(first, first + len(digests)), digests))
            if n > 1:
                last = first + len(digests) - 1
                for place in (*range(first // ARITY * ARITY, first), *range(last + 1, min(last // ARITY * ARITY + ARITY, n))):
                    known[place] = fetched[level, place]
            self.levels.append(known)
            self.sizes.append(n)
            if n <= 1:
                break
            low, high = first // ARITY, last // ARITY
            digests = [sha("".join(known[c] for c in range(p * ARITY, min(p * ARITY + ARITY, n)))) for p in range(low, high + 1)]
            first, n, level = low, -(-n // ARITY), level + 1
        self.root = known[first]
        self._above: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def proof(self, place: int, level: int = 0) -> list[tuple[str, str]]:
        """For each level up to the root, the siblings to the left and to the right, each as one string."""
        if self.sizes[level] <= 1:
            return []
        up = place // ARITY
        above = self._above.get((level + 1, up))
        if above is None:
            above = self._above[level + 1, up] = self.proof(up, level + 1)
        known, start = self.levels[level], up * ARITY
        run = [known[i] for i in range(start, min(start + ARITY, self.sizes[level]))]
        return [("".join(run[:place - start]), "".join(run[place - start + 1:])), *above]


def fold(digest: str, proof: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in proof:
        digest = sha(left + digest + right)
    return digest


def _expand(with_proofs: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(leaves: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, place, digest in zip(fetched["tree"], fetched["level"], fetched["place"], fetched["digest"]):
            nodes.setdefault(tree, {})[level, place] = digest
        leaves = leaves.sort_values(["tree", "idx"], ignore_index=True)
        trees = {tree: Tree(int(rows["idx"].iloc[0]), list(rows["leaf"]), int(rows["n"].iloc[0]), nodes.get(tree, {}))
                 for tree, rows in leaves.groupby("tree", sort=True)}
        top = Tree(min(trees), [trees[t].root for t in sorted(trees)], int(leaves["trees"].iloc[0]), nodes.get(TOP, {}))
        ends = {tree: top.proof(tree) for tree in trees}
        out = []
        for tree, idx, own, tampered in zip(leaves["tree"], leaves["idx"], leaves["leaf"], leaves["tampered"]):
            proof = trees[tree].proof(idx) + ends[tree]
            siblings = "".join(left + right for left, right in proof)
            row = (trees[tree].root, top.root, sha(siblings), fold(tampered if isinstance(tampered, str) else own, proof))
            out.append((*row, siblings) if with_proofs else row)
        names = ["subroot", "root", "proof_sha256", "folded_root"] + ["proof"] * with_proofs
        return pd.concat([leaves[["id", "leaf"]], pd.DataFrame(out, columns=names)], axis=1)

    return run


def manifest(docs: DataFrame, columns: list[str], tampered_text: Column | None = None, id_column: str = "doc_id", source_column: str = "source",
             text_column: str = "text", with_proofs: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    A leaf hashes ``columns``, in that order. Leaves of a source ascend by id, sources by their UTF-8 bytes, null first.
    ``tampered_text`` replaces the text in a second leaf, from which the root is folded again with the true siblings;
    without it, or where it is null, the true leaf is folded. ``with_proofs`` adds ``proof``, all siblings from the leaf's
    level to the root, left to right.

    Nulls have a form of their own in a leaf, an empty text another. Rows without id come last in their source, and rows
    of the same id by their leaves. A repeated row is a leaf of its own; a table with one row has that leaf as its root. Very
    long texts are hashed whole and not moved. Columns that aren't named, whatever their names, aren't read. An empty table
    gives an empty table.
    """
    values = [F.col(c) for c in columns]
    changed = F.lit(None).cast("string") if tampered_text is None else F.when(
        F.coalesce(tampered_text != F.col(text_column), F.lit(False)), leaf([tampered_text if c == text_column else F.col(c) for c in columns]))
    leaves = staged(docs.select(F.col(source_column).cast("string").alias("source"), F.col(id_column).alias("id"), leaf(values).alias("leaf"),
                                changed.alias("tampered"), F.monotonically_increasing_id().alias("row")), "leaves")
    indexed, spans = numbered(leaves, leaves.count())
    # Ids go through Python as text, so that no type changes there.
    indexed = staged(indexed.select(F.col("id").cast("string").alias("id"), "leaf", "tampered", "part", "tree", "n", "idx"), "indexed")
    nodes = build(indexed.select("tree", "n", "idx", F.col("leaf").alias("digest")))
    subroots = staged(roots(nodes), "subroots")
    trees = subroots.count()
    over = build(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"))
    first = F.col("_first") + F.col("_shift")
    own = spans.select(F.col("_part").alias("part"), "tree", first.alias("first"), (first + F.col("_count") - 1).alias("last"), "n")
    across = own.groupBy("part").agg(F.min("tree").alias("first"), F.max("tree").alias("last")).select(
        "part", F.lit(TOP).cast("long").alias("tree"), "first", "last", F.lit(trees).cast("long").alias("n"))
    fetched = fetch(_coordinates(own.unionByName(across)), nodes.unionByName(over))
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", proof string" * with_proofs
    out = (indexed.withColumn("trees", F.lit(trees)).groupBy("part").cogroup(fetched.groupBy("part"))
           .applyInPandas(_expand(with_proofs), schema))
    return out.select(F.col("id").cast(docs.schema[id_column].dataType).alias(id_column), *out.columns[1:],
                      (F.col("folded_root") == F.col("root")).alias("verified"))
