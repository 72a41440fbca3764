"""Grouped prefix join: all documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

Two sets of sizes a and b with similarity t or more each lack at most (1 - t) of the other's; so among the 2(1 - t)
smallest hashes of either (its sample) they share enough for a prefix filter inside the sample. There, elements are ordered by
how many sets hold them, counted over the whole corpus; those of one set only come first and can have no partner, so that most
documents leave before any pair is thought of. Sets of equal size with the same prefix form one group.

Groups that meet in a prefix element are brought together in families, by union-find over stars in the order of size. In a family the
pairs of groups are filtered: by their sizes, and by what their samples can still share beyond the prefix elements that they have in common.
Only pairs that pass are expanded to their members, which are verified exactly over whole sets. Documents with the same set are
one member from the start; links are expanded to them at the end.

Records of elements travel packed, some 20 bytes each; texts never travel. Sets of documents that are in no family
stay where they are: a filter of fixed size lets through all others.

Cases: a null or empty text, or one of white space, has an empty set and is linked with nothing; texts of fewer words than a
shingle have one element, their whole sequence; repeated rows are linked with each other unless their set is empty; a
null id has a row and never names a component unless all its members are null; an empty table gives an empty result; other
columns are ignored. Very long texts are read whole; ties don't arise, a component being named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import columns, mix, stored, texts
from .components import connected, forest
from .packed import Columns, by_part, dealt, in_filter, in_parts, key_filter, turns, unpack
from .shingles import WordHashes, set_id, shingle_sets
from .similar import intersections, verified_links

SHINGLE, PERCENT = 5, 80
ROWS = 256
#: Names of sets that a task remembers, so as to send copies once; beyond that it starts anew.
SEEN = 500_000


class Prefix:
    """Sizes that follow from the threshold, in whole numbers. With lack = 1 - t: a set of size n has a sample of ceil(2 * lack * n)
    elements; a partner has at least ceil(t * n), and any two share at least floor(lack * that) elements of their samples (one at least)."""

    def __init__(self, percent: int):
        self.percent, self.lack = percent, 100 - percent

    def sample(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n, -(-2 * self.lack * n // 100))

    def length(self, n: np.ndarray) -> np.ndarray:
        least_partner = -(-self.percent * n // 100)
        return self.sample(n) - np.maximum(1, self.lack * least_partner // 100) + 1

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the samples of sets of these sizes share at least if the sets are linked."""
        return np.maximum(1, self.lack * np.minimum(a, b) // 100)


def document_sets(batch: pa.RecordBatch, shingle: int, hashes: WordHashes) -> Iterator[tuple[int, np.ndarray]]:
    """Row and set of every text of a batch."""
    for at in range(0, batch.num_rows, ROWS):
        for i, own in enumerate(shingle_sets(texts(batch.slice(at, ROWS)), shingle, hashes)):
            yield at + i, own


def set_names(docs: DataFrame, shingle: int) -> DataFrame:
    """id, n_shingles, node (the set's name, null if it is empty) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [(len(own), set_id(own) if len(own) else None) for _, own in document_sets(batch, shingle, hashes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["id", "n_shingles", "node"]
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, node long")


def sampled_elements(docs: DataFrame, shingle: int, prefix: Prefix) -> DataFrame:
    """Packed (element, node, size) of every group's sample."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for _, own in document_sets(batch, shingle, hashes):
                if not len(own) or (node := set_id(own)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(node)
                size = int(prefix.sample(np.array(len(own))))
                # The smallest hashes are spread anew, else only the first parts would get any.
                yield [mix(own[:size]), np.full(size, node, np.int64), np.full(size, len(own), np.uint32)]

    return dealt(docs, emit)


def starts_of(x: np.ndarray) -> np.ndarray:
    return np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)


def counted_elements(sampled: DataFrame, each: int) -> DataFrame:
    """Packed (turn, element, node, size, count) of the elements that more than one group holds, dealt by node."""

    def counted(batches: list[pa.RecordBatch]) -> Iterator[Columns]:
        element, node, size = unpack(batches, ["<u8", "<i8", "<u4"])
        order = np.argsort(element)
        new = starts_of(element[order])
        group = np.cumsum(new) - 1
        order = order[np.bincount(group)[group] > 1] if len(order) else order
        order = order[np.lexsort((node[order], element[order]))]
        element, node, size = element[order], node[order], size[order]
        distinct = starts_of(element) | starts_of(node)
        element, node, size = element[distinct], node[distinct], size[distinct]
        group = np.cumsum(starts_of(element)) - 1
        count = np.bincount(group)[group] if len(group) else group
        held = count > 1
        element, node, size, count = element[held], node[held], size[held], count[held].astype(np.uint32)
        yield [node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), element, node, size, count]

    return dealt(sampled, lambda batches: (c for rows in by_part(batches) for c in counted(rows)), each=each)


def prefixes(counted: DataFrame, prefix: Prefix) -> DataFrame:
    """node, grp, size, prefix (binary: grp, the number of elements, and they) of every set, for what remains of its prefix when elements of one set
    only come first; sets of which nothing remains have no row. A prefix with elements of one set only is that set's alone."""

    def run(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, element, node, size, count = unpack(batches, ["<u8", "<u8", "<i8", "<u4", "<u4"])
        order = np.lexsort((element, count, node))
        element, node, size = element[order], node[order], size[order].astype(np.int64)
        new = starts_of(node)
        at = np.flatnonzero(new)
        held = np.diff(np.append(at, len(node)))
        alone = prefix.sample(size[at]) - held
        wanted = np.minimum(held, prefix.length(size[at]) - alone)
        rows: list[list] = [[], [], [], []]
        for start, n, few, name, whole in zip(at.tolist(), wanted.tolist(), alone.tolist(), node[at].tolist(), size[at].tolist()):
            if n > 0:
                own = element[start : start + n]
                grp = name if few else set_id(np.append(own, np.uint64(whole)))
                for column, x in zip(rows, (name, grp, whole, np.array([grp, n], np.int64).tobytes() + own.tobytes())):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["node", "grp", "size", "prefix"])

    return in_parts(counted, run, "node long, grp long, size long, prefix binary")


def candidate_edges(groups: DataFrame, percent: int, each: int) -> DataFrame:
    """a, b: groups that meet in an element, next to each other in the order of size where the sizes permit a link."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        for batch in batches:
            size = {}
            for grp, n, data in zip(batch.column("grp").to_pylist(), batch.column("size").to_pylist(), batch.column("prefix").to_pylist()):
                size.setdefault(grp, (n, np.frombuffer(data, np.uint64, offset=16)))
            for grp, (n, own) in size.items():
                yield [own, np.full(len(own), grp, np.int64), np.full(len(own), n, np.uint32)]

    def run(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        element, grp, size = unpack(batches, ["<u8", "<i8", "<u4"])
        size = size.astype(np.int64)
        order = np.lexsort((grp, size, element))
        element, grp, size = element[order], grp[order], size[order]
        near = (element[1:] == element[:-1]) & (100 * size[:-1] >= percent * size[1:])
        a, b = forest(grp[1:][near], grp[:-1][near])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return in_parts(dealt(groups, emit, each=each), run, "a long, b long")


def group_links(prefix: Prefix):
    """Compares members of a family: pairs of groups are filtered by prefix and size, those that pass expanded and their members verified."""

    def links(nodes: np.ndarray, data: list[bytes], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        heads = [np.frombuffer(d, np.int64, 2).tolist() for d in data]
        first = [np.frombuffer(d, np.uint64, n, 16) for d, (_, n) in zip(data, heads)]
        sets = [np.frombuffer(d, np.uint64, offset=16 + 8 * n) for d, (_, n) in zip(data, heads)]
        name, n = np.array([g for g, _ in heads], np.int64), np.array([len(s) for s in sets], np.int64)
        a, b = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        (at_a, in_a), (at_b, in_b) = (np.unique(name[x], return_index=True, return_inverse=True)[1:] for x in (a, b))
        size_a, size_b = n[a[at_a]][:, None], n[b[at_b]][None, :]
        common = intersections([first[i] for i in a[at_a]], [first[i] for i in b[at_b]])
        rest = np.maximum(prefix.sample(size_a) - prefix.length(size_a), prefix.sample(size_b) - prefix.length(size_b))
        passes = (common > 0) & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (common + rest >= prefix.shared(size_a, size_b))
        members = passes[in_a][:, in_b]
        if side.min() == side.max():
            members = np.triu(members, 1)
        x, y = np.nonzero(members)
        if len(x) > 4 * len(nodes):
            rows, columns_ = np.unique(x), np.unique(y)
            shared = intersections([sets[i] for i in a[rows]], [sets[i] for i in b[columns_]])
            shared = shared[np.searchsorted(rows, x), np.searchsorted(columns_, y)]
        else:
            shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a[x].tolist(), b[y].tolist())], np.int64)
        linked = (shared > 0) & (100 * shared >= percent * (n[a[x]] + n[b[y]] - shared))
        return forest(nodes[a[x[linked]]], nodes[b[y[linked]]])

    return links


def family_sets(docs: DataFrame, grouped: DataFrame, families: DataFrame, shingle: int) -> DataFrame:
    """family, node, data (prefix and whole set) of every set that has another one in its family."""
    component = families.select(F.col("node").alias("_grp"), "component")
    named = stored(grouped.join(component, F.col("grp") == F.col("_grp"), "left").select("node", F.coalesce("component", "grp").alias("family"), "prefix"), "families")
    several = named.groupBy("family").count().where("count > 1").select("family")
    whole = stored(named.join(several, "family", "left_semi"), "family_members")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(whole, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            nodes, data = [], []
            for _, own in document_sets(batch, shingle, hashes):
                if len(own) and (node := set_id(own)) not in seen and in_filter(bits.value, np.array([node]))[0]:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    data.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], ["node", "data"])

    # The same set may come from several tasks; one copy of each is enough.
    return docs.mapInArrow(run, "node long, data binary").join(whole, "node").dropDuplicates(["node"]).select("family", "node", F.concat("prefix", "data").alias("data"))


def ngram_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id that links lead to) of every row."""
    return named_components(docs, shingle, percent, id_col, text_col).drop("_node")


def named_components(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """As ngram_components, with _node (the set's name) of every row."""
    prefix = Prefix(percent)
    read = columns(docs, id=id_col, text=text_col)
    named = stored(set_names(read, shingle), "set_names")
    each = turns(read)
    grouped = stored(prefixes(counted_elements(sampled_elements(read, shingle, prefix), each), prefix), "prefixes")
    families = connected(candidate_edges(grouped, percent, each))
    joined = connected(verified_links(family_sets(read, grouped, families, shingle), percent, compare=group_links(prefix)))
    joined = joined.select(F.col("node").alias("_node"), "component")
    rooted = named.join(joined, named["node"] == joined["_node"], "left").select("id", "n_shingles", "node", F.coalesce("component", "node").alias("root"))
    least = stored(rooted.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id")), "component_ids").withColumnRenamed("root", "_root")
    out = rooted.join(least, rooted["root"] == least["_root"], "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component, F.col("node").alias("_node"))


def drop_linked(docs: DataFrame, keep: list[str], shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns in keep (id and text among them) of the rows of each component that have its smallest id; equal rows of one id
    count as one. Only rows of ids that lose something meet the decisions; all others stay where they are. A row falls by its own
    component: where the rows of one id fare differently, they are told apart by the names of their sets."""
    decided = named_components(docs, shingle, percent, id_col, text_col).where(F.col(id_col).isNotNull())
    stays = F.col("component_id") == F.col(id_col)
    whole = decided.groupBy(F.col(id_col).alias("_id")).agg(F.min(stays.cast("int")).alias("stays"), F.max(stays.cast("int")).alias("some"), F.count(F.lit(1)).alias("rows"))
    asked = stored(whole.where("stays = 0 or rows > 1"), "decided")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(asked, "_id"))
    chosen = columns(docs, **{c: c for c in keep})

    def split(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(id_col)
                met = in_filter(bits.value, np.asarray(ids.fill_null(0), np.int64)) & np.asarray(ids.is_valid())
                yield b.filter(pa.array(met == wanted))

        return chosen.mapInArrow(run, chosen.schema)

    met = split(True).join(asked, F.col(id_col) == F.col("_id"), "left").where("stays is null or some = 1")
    once = met.where("rows is null or rows = 1").select(*keep)
    several = met.where("rows > 1 and stays = 1").select(*keep)
    mixed = asked.where("stays < some").select("_id")
    if not mixed.isEmpty():
        names = stored(decided.where(stays).select(F.col(id_col).alias("_id"), "_node").join(mixed, "_id", "left_semi").distinct(), "names")

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                read = pa.RecordBatch.from_arrays([b.column(id_col), b.column(text_col)], ["id", "text"])
                nodes = [set_id(own) if len(own) else None for _, own in document_sets(read, shingle, hashes)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64())], [*b.schema.names, "_own"])

        torn = met.where("stays < some").select(*keep)
        rows = torn.mapInArrow(named, StructType([*torn.schema.fields, StructField("_own", LongType())]))
        several = several.unionByName(rows.join(names, (F.col(id_col) == F.col("_id")) & F.col("_own").eqNullSafe(F.col("_node")), "left_semi").select(*keep))
    return split(False).unionByName(once).unionByName(several.dropDuplicates([id_col, text_col]))
