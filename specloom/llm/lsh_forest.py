"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Documents with one text are one node; its members are not compared again.  A node's
shingles are runs of ``n`` words (all words of a shorter text).  Its signature has
``depth`` min-hashes of 16 bits for each of ``trees`` trees: its label in the tree.

A tree is a prefix trie, held as the leaves in the order of their labels: below a prefix
stands a run of leaves.  From one sorted pass each leaf is tied to the first leaf of the
deepest run that it is in; the ties of depth k and deeper connect all leaves that share k
hashes in some tree.  A hot prefix costs a row for each leaf, never a pair.

Matching begins with whole labels. What is connected is a candidate group and is verified
exactly on its shingle sets.  Each link found, of similarity s, had the probability
1 - (1 - s ** k) ** trees of being found with prefixes of k hashes; the links' own
similarities so tell what share of all links was found, and prefixes are shortened
until that share reaches the target recall, or until even a pair at the
threshold is found with that probability. Then the groups that have grown are verified
again, the others' links stay.

Verification goes in blocks of nodes, block against block, each pair of blocks by itself; a
task holds one pair of blocks.  A block pair reports, for each node, how many documents it
is linked to there and one tie for each linked group, so neither pairs nor groups are ever
rows or in one task. A node's shingle hashes are computed once and sent to each block of its
group: the exact number of links in a group of g different texts takes g * g / 2
comparisons, in matrix products, and g / ``block`` copies of each set.

Similarity is |A & B| / |A | B| on 64-bit hashes of the shingles. Texts without words have
no shingles: they are linked to their copies alone. Null texts are empty texts. A null
doc_id counts as larger than others; a class of such alone has a null class_id. Repeated
rows are copies. No rows: none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm._common import Words, discard, fixed, flat, from_files, group_starts, materialise, mix, prefix_sums, record, run_hash, slices, text_bytes, tidied
from specloom.llm.graph import components, dealt_anew

HASHES = mix(np.arange(1, 4097, dtype=np.uint64), 0xF0E57) | np.uint64(1)


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix by which a pair at the threshold is found with the target recall: none need be shorter."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def shingles(piece: pa.Table, n: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each row."""
    words = Words(*text_bytes(piece.column("text")))
    at, hashes = words.windows(n)
    doc = words.doc[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(few):
        whole = run_hash(prefix_sums(words.ids), words.first[few], words.first[few + 1])
        doc, hashes = np.concatenate([doc, few]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return np.split(hashes, np.searchsorted(doc, np.arange(1, piece.num_rows))) if piece.num_rows else []


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """(len(sets), size) min-hashes of 16 bits; rows of empty sets are zero."""
    out = np.zeros((len(sets), size), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k in range(size):
            out[full, k] = mix(np.minimum.reduceat(values * HASHES[k], at)) >> np.uint64(48)
    return out


_SIGNED = pa.schema([("node", pa.binary()), ("doc_id", pa.int64()), ("size", pa.int64()), ("signature", pa.binary())])


def _sign(n: int, size: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for at, rows in slices(t, "text"):
                piece = t.slice(at, rows)
                nodes = [hashlib.md5(x.encode(), usedforsecurity=False).digest() for x in flat(piece.column("text")).to_pylist()]
                ids: dict[bytes, list] = {}
                for k, (node, doc) in enumerate(zip(nodes, piece.column("doc_id").to_pylist())):
                    ids.setdefault(node, [k]).append(doc)  # the first row of a text speaks for its copies
                first = piece.take(pa.array([v[0] for v in ids.values()], pa.int64()))
                sets = shingles(first, n)
                signed = signatures(sets, size)
                least = [min((d for d in v[1:] if d is not None), default=None) for v in ids.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(least, pa.int64()), pa.array([len(v) - 1 for v in ids.values()], pa.int64()), pa.array([s.tobytes() if len(x) else None for s, x in zip(signed, sets)], pa.binary())], schema=_SIGNED)

    return run


def nodes_of(docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """node (the text's 128-bit digest), doc_id (the least), size (documents), signature (null: no words)."""
    signed = docs.select("doc_id", "text").mapInArrow(_sign(n, trees * depth), "node binary, doc_id long, size long, signature binary")
    return signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.sum("size").alias("size"), F.first("signature").alias("signature"))


_TIES = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("depth", pa.int32()), ("part", pa.int32()), ("edge", pa.binary())])
TIES = "u binary, v binary, depth int, part int, edge binary"


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first columns the rows of a and b share, the tree (column 0) not counted; -1: not even the tree."""
    return np.cumprod(a == b, axis=1).sum(axis=1) - 1


def _climb(depth: int, least: int):
    """Leaves in the order of their tries, (tree, label, node), to ties: each leaf and the first leaf
    of the deepest run it is in, but is not the first of. The last row tells the partition's ends."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # (label, node) of leaves
        heads: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            node = fixed(batch.column("node"), 16)
            label = np.empty((n, depth + 1), np.uint16)
            label[:, 0] = batch.column("tree").to_numpy()
            label[:, 1:] = fixed(batch.column("label"), 2 * depth).view(np.uint16)
            before = label[:1] ^ np.uint16(1) if last is None else last[0][None]  # no leaf has it
            shared = np.minimum(_shared(label, np.concatenate([before, label[:-1]])), depth)
            found = []
            for d in range(depth, least - 1, -1):
                head = np.maximum.accumulate(np.where(shared < d, np.arange(n), -1))
                whole = np.concatenate([heads.get(d, node[0])[None], node])  # place 0: the run began in an earlier batch
                mine = np.flatnonzero(shared == d)
                found.append((node[mine], whole[head[mine] + 1], np.full(len(mine), d)))
                heads[d] = whole[head[-1] + 1]
            u, v, d = (np.concatenate(x) for x in zip(*found))
            if len(u):
                yield pa.RecordBatch.from_arrays([_binary(u), _binary(v), pa.array(d, pa.int32()), pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.binary())], schema=_TIES)
            first = (label[0], node[0]) if first is None else first
            last = (label[-1], node[-1])
        if first is not None:
            yield record(_TIES, [[first[1].tobytes()], [last[1].tobytes()], [0], [TaskContext.get().partitionId()], [first[0].tobytes() + last[0].tobytes()]])

    return run


def _stitch(depth: int, least: int):
    """Ties between the last leaf of a partition and the first of the next, from the partitions' ends in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for u, v, edge in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("edge").to_pylist()):
                first, last = np.frombuffer(edge, np.uint16).reshape(2, 1, depth + 1)
                if before is not None and (d := min(depth, int(_shared(before[0], first)[0]))) >= least:
                    yield record(_TIES, [[u], [before[1]], [d], [None], [None]])
                before = (last, v)

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def forest_ties(nodes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(u, v, depth): the edges of the forest's tries. The leaves below a prefix of k hashes, ``least`` or
    more, are connected by the ties of depth k and deeper.

    Tries are sorted leaves, dealt out by ranges of (tree, label, node): the leaves of a hot
    prefix lie in as many ranges as they need. A leaf has one tie in each tree at most.
    """
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("signature"), t * (2 * depth) + 1, F.lit(2 * depth)))).alias("tree", "label")
    leaves = nodes.filter("signature is not null").select("node", tree).repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    climbed = materialise(leaves.mapInArrow(_climb(depth, least), TIES), "forest-climb")
    ends = climbed.filter("depth = 0").repartition(1).sortWithinPartitions("part")  # a row for each partition
    ties = climbed.filter("depth > 0").unionByName(ends.mapInArrow(_stitch(depth, least), TIES))
    out = materialise(ties.groupBy("u", "v").agg(F.max("depth").alias("depth")), "forest-ties")
    discard(climbed)
    return out


def _block_pair(a: list[np.ndarray], b: list[np.ndarray] | None, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and of the union of each of a (rows) and each of b (columns; None: a itself)."""
    sets = a if b is None else [*a, *b]
    sizes = np.array([len(s) for s in sets])
    doc, value = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    doc, value = doc[order], value[order]
    at = group_starts(value)
    count = np.diff(np.append(at, len(value)))
    shared = np.repeat(count > 1, count)  # shingles of one document alone add to no intersection
    column = np.repeat(np.cumsum(count > 1) - 1, count)[shared]
    doc = doc[shared]
    common = np.zeros((len(a), len(sets) if b is None else len(b)))
    total = int(column[-1]) + 1 if len(column) else 0
    edges = np.searchsorted(column, np.arange(0, total + columns, columns))
    for x, y, base in zip(edges[:-1], edges[1:], range(0, total, columns)):
        m = np.zeros((len(sets), min(columns, total - base)), np.float32)
        m[doc[x:y], column[x:y] - base] = 1
        common += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    if b is None:
        np.fill_diagonal(common, 0)  # a text is not linked to itself
    return common, sizes[: len(a), None] + (sizes if b is None else sizes[len(a) :])[None] - common


def _reaches(alike: tuple[np.ndarray, np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    return alike[0] * threshold[1] >= alike[1] * threshold[0]


def _least_linked(linked: np.ndarray, square: bool) -> np.ndarray:
    """For each row (square) or row and column, the index of the least place of its component."""
    n, m = linked.shape
    if not square:  # a bipartite graph as one square matrix would be four times as large
        label = np.arange(n + m)
        while True:
            right = np.minimum(label[n:], np.where(linked, label[:n, None], n + m).min(axis=0))
            left = np.minimum(label[:n], np.where(linked, right[None], n + m).min(axis=1))
            if (left == label[:n]).all() and (right == label[n:]).all():
                return label
            label = np.concatenate([left, right])
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None], n).min(axis=1))
        if (new == label).all():
            return label
        label = new


BINS = 100
_FOUND = pa.schema([("root", pa.binary()), ("node", pa.binary()), ("tie", pa.binary()), ("links", pa.int64()), ("bin", pa.int32()), ("pairs", pa.int64())])
FOUND = "root binary, node binary, tie binary, links long, bin int, pairs long"


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that follow each other with equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        n = b.num_rows
        new = np.zeros(max(0, n - 1), bool)
        for k in keys:
            c = b.column(k)
            new |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else False
        at = 0
        for cut in [*(np.flatnonzero(new) + 1).tolist(), n]:
            if cut == at:
                continue
            piece = b.slice(at, cut - at)
            if held and any(held[0].column(k)[0] != piece.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def _verify(threshold: tuple[int, int]):
    """Block pairs of candidate groups, one after the other, to links, ties and a histogram of the links' similarities."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _FOUND]
        for t in _runs(batches, ["root", "i", "j"]):
            one_block = t.column("i")[0].as_py() == t.column("j")[0].as_py()
            nodes, sizes, side = t.column("node").to_pylist(), t.column("size").to_numpy(), t.column("side").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
            left = int((side == 0).sum())
            if not one_block and left in (0, len(nodes)):
                continue  # the other block is empty
            if one_block:
                alike = _block_pair(sets, None)
                linked = _reaches(alike, threshold)
                label, links = _least_linked(linked, True), linked @ sizes
                similar = alike[0][np.triu(linked)] / alike[1][np.triu(linked)]
            else:
                alike = _block_pair(sets[:left], sets[left:])
                linked = _reaches(alike, threshold)
                label = _least_linked(linked, False)
                links = np.concatenate([linked @ sizes[left:], linked.T @ sizes[:left]])
                similar = alike[0][linked] / alike[1][linked]
            root = t.column("root")[0].as_py()
            for k in np.flatnonzero(links).tolist():
                for column, v in zip(out, (root, nodes[k], nodes[label[k]], int(links[k]), None, 0)):
                    column.append(v)
            seen = np.bincount((similar * BINS).astype(np.int64), minlength=1)
            for k in np.flatnonzero(seen).tolist():
                for column, v in zip(out, (root, None, None, 0, k, int(seen[k]))):
                    column.append(v)
            if len(out[0]) > 1 << 14:
                yield record(_FOUND, out)
                out = [[] for _ in _FOUND]
        if out[0]:
            yield record(_FOUND, out)

    return run


def _block_pairs(groups: DataFrame, block: int, shingles_in_block: int) -> DataFrame:
    """Rows (root, node, i, j, side): each block pair of each candidate group, blocks of about ``block`` nodes and so many shingles at most."""
    counts = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("shingles") / shingles_in_block)).cast("int").alias("blocks")).select(dealt_anew("root").alias("_root"), "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = groups.join(counts.hint("merge"), F.col("root") == F.col("_root")).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return placed.select("*", other).select("root", "node", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))


def _sets(n: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for at, rows in slices(t, "text"):
                piece = t.slice(at, rows)
                found = [s.tobytes() for s in shingles(piece, n)]
                yield pa.RecordBatch.from_arrays([piece.column("node").combine_chunks(), pa.array([len(x) // 8 for x in found], pa.int64()), pa.array(found, pa.binary())], names=["node", "shingles", "hashes"])

    return run


def seen_share(pairs: dict[int, int], trees: int, depth: int, shorter: int | None = None) -> float:
    """Of the links that there are, the share that prefixes of ``depth`` hashes have found, as estimated from
    these: one of similarity s is found with probability 1 - (1 - s ** depth) ** trees.
    ``pairs``: links by similarity in hundredths, rounded down. With ``shorter``: the share that prefixes so long will find."""

    def chance(s: int, k: int) -> float:
        return 1 - (1 - (s / BINS) ** k) ** trees

    there = {s: n / chance(s, depth) for s, n in pairs.items()}
    return sum(n * chance(s, shorter or depth) for s, n in there.items()) / sum(there.values()) if there else 0.0


def similar(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), trees: int = 32, depth: int = 8, recall: float = 0.9999, block: int = 1024, shingles_in_block: int = 1 << 19) -> tuple[DataFrame, DataFrame]:
    """The members (doc_id, node), one for each input row, and the classes (node, class, class_id, n_links)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    least = prefix_depth(threshold[0] / threshold[1], trees, depth, recall)
    nodes = materialise(nodes_of(slim, n, trees, depth), "forest-nodes")
    ties = forest_ties(nodes, trees, depth, least)
    # of all copies of a text the row with the node's doc_id brings it; keyed by both, copies do not meet in a task
    met = ties.select(F.col("u").alias("node")).unionByName(ties.select(F.col("v").alias("node"))).distinct()
    wanted = nodes.select("node", "doc_id").join(met.hint("merge"), "node", "left_semi").select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"))
    texts = slim.withColumn("node", F.unhex(F.md5("text"))).join(wanted.hint("merge"), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = materialise(texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(_sets(n), "node binary, shingles long, hashes binary"), "forest-sets")
    slim_nodes = nodes.select("node", "size").join(sets.select("node", "shingles").hint("merge"), "node")
    placed = found = None
    k, above = depth, depth + 1
    while True:
        edges = ties.filter(F.col("depth").between(k, above - 1)).select("u", "v")
        if placed is not None:
            edges = edges.unionByName(placed.select(F.col("node").alias("u"), F.col("root").alias("v")))
        old, placed = placed, materialise(components(edges).join(slim_nodes, "node"), "forest-groups")
        grown = placed
        if old is not None:  # groups only grow: one of the same root and size is the same
            size = [g.groupBy("root").agg(F.count("*").alias("n")) for g in (placed, old)]
            more = size[0].join(size[1], ["root", "n"], "left_anti").select(dealt_anew("root").alias("_root"))
            grown = placed.join(more.hint("merge"), F.col("root") == F.col("_root"), "left_semi")
        pairs = _block_pairs(grown, block, shingles_in_block).join(sets.select("node", "hashes"), "node")
        checked = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "node").mapInArrow(_verify(threshold), FOUND)
        if found is not None:  # of groups that have not grown the links stay
            checked = checked.unionByName(found.join(grown.select(F.col("node").alias("root")).distinct(), "root", "left_anti"))
        before, found = found, materialise(checked, "forest-links")
        discard(*(t for t in (old, before) if t is not None))
        seen = {r["bin"]: r["n"] for r in found.filter("bin is not null").groupBy("bin").agg(F.sum("pairs").alias("n")).collect()}
        if k == least or seen_share(seen, trees, k) >= recall:
            break
        above, k = k, next((d for d in range(k - 1, least, -1) if seen_share(seen, trees, k, d) >= recall), least)
    discard(sets, placed, ties)
    told = found.filter("node is not null")
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(told.select(F.col("node").alias("u"), F.col("tie").alias("v")))
    whole = nodes.select("node", "doc_id", "size").join(roots, "node", "left").join(links, "node", "left").withColumn("class", F.coalesce("root", "node"))
    named = whole.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    classes = whole.join(named, "class").select("node", "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return slim.select("doc_id", F.unhex(F.md5("text")).alias("node")), classes


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class of near duplicates), n_links, n_in_class.

    ``n_links``: the other documents whose similarity with it is the threshold or more, copies
    included. Classes are what links connect.
    """
    members, classes = similar(docs, **options)
    return members.join(classes, "node").select("doc_id", "class_id", "n_links", F.hex("class").alias("class"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without all but one of each class.

    The row that stays has the class's least doc_id; of equal ones the first in the files.
    """
    if not from_files(docs):
        docs = materialise(docs, "forest-input")
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at")]
    _, classes = similar(docs, **options)
    rows = docs.select(F.xxhash64("_metadata.file_path").alias("fp"), F.col("_metadata.row_index").alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "at")).alias("first")
    # the first row of each text, summed up where it is read, then the first of each class
    stay = rows.groupBy("node").agg(first).join(classes.select("node", "class"), "node").groupBy("class").agg(F.min("first").alias("first")).select("first.fp", "first.at")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    marked = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names)), *place)
    kept = marked.join(stay.hint("merge"), (F.xxhash64("_path") == F.col("fp")) & (F.col("_at") == F.col("at")), "left_semi")
    return kept.select(*(F.col(k).alias(c) for k, c in zip(names, docs.columns)))
