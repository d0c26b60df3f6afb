"""Near-duplicate documents by a chosen-path similarity join (operator 8).

A document's set is its distinct shingles; documents with equal sets form a
class, and only classes go on.  Each class has a MinHash sketch.  A tree sends
the classes down paths: a node picks one or two coordinates of the sketch from
its own hash, and a class branches by its values there (1.25 picks a node on
average, so that a pair at 0.8 lives on in one branch on average).  Nodes of at
most ``LEAF`` classes are compared exhaustively, larger ones branch again: on
Spark while they have more than ``NODE`` classes, then in a task's memory.
Independent trees are repeated to raise recall; a node still too large after
``DEPTH`` levels, as among thousands of mutual copies, is first dealt out to
pieces that share the node's first class, which joins most of such copies.  The
trees run in two rounds: nodes whose classes are all in one component after the
first need no second look.

The classes of those too large nodes that still hold several components after
both rounds are joined exactly, by blocks: shingles are ordered rarest first, a
class goes to a block if a shingle of its prefix is in that of a class of
another component there, and a task counts the common shingles of two blocks in
full.  No pair of classes is written, however dense a family is.

Within a node, sketches only order and prefilter the pairs; each link is
confirmed on full sets.  Pairs already in one component there are skipped, so
a node gives a spanning forest and not all its pairs.  Links become components
by alternating large-star and small-star steps on Spark.

Defined results: null, empty and word-less texts have an empty set and no link;
shorter texts have their whole word sequence as their one shingle; equal rows
are linked; rows with a null id are not linked and keep a null component; an id
that stands with several texts has a row for each, which is linked as its text
is; 64-bit hashes stand for shingles, and for classes once they are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import SLICE, byte_slices, read, smallable
from tidemark.llm.base import written_by_bytes as written
from tidemark.llm.wordhash import bounds, hashed_words, mix, shingles

#: Coordinates of a sketch, trees of the two rounds, levels before the first look at node sizes, and most levels.
SKETCH, TREES, FIRST, DEPTH = 64, ((0, 1), (2, 3, 4, 5, 6, 7)), 2, 6
#: Classes in a node that is compared, in a piece of a larger one, in a node that a task branches on in memory,
#: and the estimate from which a pair is looked at (0.8 less 4.4 deviations).
LEAF, PIECE, NODE, LOOK = 48, 256, 20_000, 0.58
#: Sets and shingles in a block of the exact join, holders in both blocks that make a shingle a column of their matrices, and columns multiplied at once.
BLOCK_SETS, BLOCK_SHINGLES, OFTEN, COLUMNS = 2_048, 4_000_000, 8, 4_096

_SALT = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = mix(_SALT) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    hashes, rows, _, _ = hashed_words(texts, "space")
    values, at = shingles(hashes, rows, n)
    ends = bounds(at, len(texts))
    return [np.unique(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SKETCH minima for each set; zeros for an empty one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), SKETCH), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        values = np.concatenate([sets[i] for i in full])
        begins = np.r_[0, np.cumsum(sizes[full])[:-1]]
        for k in range(SKETCH):
            out[full, k] = np.minimum.reduceat((((values ^ _SALT[k]) * _FACTOR[k]) >> np.uint64(32)).astype(np.uint32), begins)
    return out


#: What tells classes apart: the number of shingles and a 128-bit signature of the set.
MARK = ("n_shingles", "sum_a", "sum_b")


def _marks(sets: list[np.ndarray]) -> list[pa.Array]:
    """The columns of MARK."""
    sums = [np.array([mix(s ^ np.uint64(salt)).sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64) for salt in (11, 29)]
    return [pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums)]


def _profiles(n: int):
    """(doc_id, text) to doc_id, the mark of its set, and its sketch."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), SLICE):
                sets = shingle_sets(batch.column("text").slice(a, b - a), n)
                body = pa.py_buffer(np.ascontiguousarray(sketches(sets)).tobytes())
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * SKETCH), b - a, [None, body]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *_marks(sets), packed], ["doc_id", *MARK, "sketch"])

    return profile


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


def _branch(paths: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each class in its node: (path, row); the node's hash picks the coordinates."""
    pick = mix(paths + np.uint64(0xABCDEF))
    rows = np.arange(len(paths))
    out = []
    for turn, chosen in ((0, rows), (1, rows[(pick >> np.uint64(50)) % np.uint64(4) == 0])):
        at = ((pick[chosen] >> np.uint64(8 + 16 * turn)) % np.uint64(SKETCH)).astype(int)
        value = sketch[chosen, at].astype(np.uint64)
        out.append((mix(paths[chosen] ^ mix(value + (at.astype(np.uint64) << np.uint64(33)) + np.uint64(1))), chosen))
    return np.concatenate([p for p, _ in out]), np.concatenate([r for _, r in out])


_ROWS = "path long, doc long, component long"


def _rows(paths: np.ndarray, batch: pa.RecordBatch, row: np.ndarray) -> pa.RecordBatch:
    kept = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), batch.column("doc").take(kept), batch.column("component").take(kept)], ["path", "doc", "component"])


def _roots(trees: tuple[int, ...]):
    """Each class's nodes at level FIRST of some trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _unpacked(batch.column("sketch"))
            for tree in trees:
                paths, row = np.full(len(sketch), mix(np.array([tree + 1], np.uint64))[0]), np.arange(len(sketch))
                for _ in range(FIRST):
                    paths, at = _branch(paths, sketch[row])
                    row = row[at]
                yield _rows(paths, batch, row)

    return run


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, row = _branch(batch.column("path").to_numpy().view(np.uint64), _unpacked(batch.column("sketch")))
        yield _rows(paths, batch, row)


def _leaves_of(path: int, docs: np.ndarray, components: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Rows of the nodes to compare below one node, branching on in memory; True with those of too large nodes, for the exact join."""
    todo = [(np.uint64(path), np.arange(len(docs)), FIRST)]
    while todo:
        here, rows, level = todo.pop()
        if (components[rows] == components[rows[0]]).all():
            continue
        if len(rows) <= LEAF:
            yield rows, False
        elif level == DEPTH:
            yield rows, True
            first = rows[docs[rows].argmin()]
            rows = rows[np.argsort(mix(docs[rows].view(np.uint64) ^ here))]
            for piece in np.array_split(rows, -(-len(rows) // PIECE)):
                yield np.unique(np.r_[first, piece]), False
        else:
            paths, at = _branch(np.full(len(rows), here), sketch[rows])
            order = np.argsort(paths, kind="stable")
            for some in np.split(order, np.flatnonzero(paths[order][1:] != paths[order][:-1]) + 1):
                if len(some) > 1:
                    todo.append((paths[some[0]], rows[np.unique(at[some])], level + 1))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path to one row a leaf; memory holds a batch and one node of at most NODE classes."""
    held: list[tuple] = []
    out: list[tuple] = []

    def close():
        if held:
            docs, components = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            for rows, large in _leaves_of(held[0][0], docs, components, np.concatenate([h[3] for h in held])):
                order = rows[np.argsort(docs[rows])]
                out.append((int(mix(docs[order].view(np.uint64)).sum().view(np.int64)), docs[order], components[order], large))
            held.clear()

    for batch in batches:
        path, docs, components = (batch.column(c).to_numpy() for c in ("path", "doc", "component"))
        sketch = _unpacked(batch.column("sketch"))
        begins = np.r_[0, np.flatnonzero(path[1:] != path[:-1]) + 1] if len(path) else []
        for a, b in zip(begins, [*begins[1:], len(path)], strict=True):
            here = path[a : a + 1].view(np.uint64)[0]
            if held and held[0][0] != here:
                close()
            held.append((here, docs[a:b], components[a:b], sketch[a:b]))
        if len(out) > 1_000:
            yield _leaf_batch(out)
            out.clear()
    close()
    if out:
        yield _leaf_batch(out)


def _leaf_batch(leaves: list[tuple]) -> pa.RecordBatch:
    marks, docs, components, large = zip(*leaves, strict=True)
    lists = [pa.array(x, pa.list_(pa.int64())) for x in (docs, components)]
    return pa.RecordBatch.from_arrays([pa.array([len(d) for d in docs], pa.int64()), pa.array(marks, pa.int64()), *lists, pa.array(large)], ["n", "mark", "docs", "components", "large"])


def _tree_nodes(classes: DataFrame, trees: tuple[int, ...]) -> DataFrame:
    """(node, doc, component, large): the nodes to compare, of at least two components each, and the large ones for the exact join; equal nodes once."""
    rows = written(classes.select("doc", "component", "sketch").mapInArrow(_roots(trees), _ROWS))
    leaves, wholes, level = None, None, FIRST
    while True:
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("path", "n")
        sketched = rows.join(sizes.filter(F.col("n") <= NODE), "path").join(classes.select("doc", "sketch"), "doc").select("path", "doc", "component", "sketch")
        some = sketched.repartition("path").sortWithinPartitions("path").mapInArrow(_leaves, "n long, mark long, docs array<long>, components array<long>, large boolean")
        leaves = some if leaves is None else leaves.unionByName(some)
        big = sizes.filter(F.col("n") > NODE)
        if big.isEmpty():
            break
        large = rows.join(big, "path")
        if level < DEPTH:
            rows = written(large.join(classes.select("doc", "sketch"), "doc").select("path", "doc", "component", "sketch").mapInArrow(_children, _ROWS))
        else:  # deals them out to pieces that a task can hold, each with the node's first class; the exact join has the whole
            if level == DEPTH:
                wholes = large.select(F.col("path").alias("node"), "doc", "component", F.lit(True).alias("large"))
            parts = F.ceil(2 * F.col("n") / NODE)
            firsts = large.groupBy("path", "n").agg(F.min(F.struct("doc", "component")).alias("x")).select("path", "x.*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("piece"))
            pieces = large.withColumn("piece", F.pmod(F.xxhash64("doc", "path"), parts)).select("path", "doc", "component", "piece").unionByName(firsts)
            rows = written(pieces.select(F.xxhash64("path", "piece").alias("path"), "doc", "component").distinct())
        level += 1
    distinct = leaves.dropDuplicates(["n", "mark", "large"])
    nodes = distinct.select(F.col("mark").alias("node"), "large", F.explode(F.arrays_zip("docs", "components")).alias("x")).select("node", F.col("x.docs").alias("doc"), F.col("x.components").alias("component"), "large")
    return nodes if wholes is None else nodes.unionByName(wholes)


def _sets(n: int):
    """(doc_id, text) to the mark and the shingles of each set, equal sets once a task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), SLICE):
                sets = shingle_sets(batch.column("text").slice(a, b - a), n)
                marks = pa.RecordBatch.from_arrays(_marks(sets), list(MARK))
                new = [k for k, m in enumerate(zip(*(c.to_pylist() for c in marks.columns), strict=True)) if not (m in seen or seen.add(m))]
                ends = np.r_[0, np.cumsum([len(sets[k]) for k in new])].astype(np.int32)
                values = pa.array(np.concatenate([np.empty(0, np.uint64), *(sets[k] for k in new)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(new, pa.int64())) for c in marks.columns), pa.ListArray.from_arrays(pa.array(ends), values)], [*MARK, "shingles"])

    return emit


def _linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether 100 * intersection >= least * union, on ascending distinct values."""
    small, large = sorted((a, b), key=len)
    if 100 * len(small) < least * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= least * (len(a) + len(b) - both)


def _node_links(docs: list[int], components: list[int], sets: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Links that join the node's components; every pair whose classes are not yet connected is looked at."""
    sketch, group, out = sketches(sets), np.array(components), []
    for i in range(1, len(docs)):
        alike = (sketch[:i] == sketch[i]).mean(1)
        for j in np.argsort(-alike, kind="stable").tolist():
            if alike[j] < LOOK:
                break
            if group[i] != group[j] and _linked(sets[i], sets[j], least):
                out.append((docs[i], docs[j]))
                group[group == group[i]] = group[j]
    return out


def _compare(least: int):
    """Rows sorted by node to links; memory holds a batch and one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        node = None
        links: list[tuple[int, int]] = []

        def close():
            if len(held) > 1:
                links.extend(_node_links(*(list(x) for x in zip(*held, strict=True)), least))

        for batch in batches:
            ends = batch.column("shingles").offsets.to_numpy()
            values = batch.column("shingles").values.to_numpy().view(np.uint64)
            for k, (at, doc, component) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "doc", "component")), strict=True)):
                if at != node:
                    close()
                    held, node = [], at
                if held and held[-1][0] == doc:  # the same class, read from another row of its id
                    continue
                held.append((doc, component, values[ends[k] : ends[k + 1]].copy()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
                links.clear()
        close()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b); the component is its smallest node."""
    edges, before = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    while True:
        count = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first()
        if count == before or count[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = count
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct())


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """doc and shingles of the classes in nodes, and of other texts of their ids; a class may come more than once."""
    ids = written(classes.join(smallable(nodes.select("doc").distinct()), "doc", "left_semi").select(F.col("least_id").alias("doc_id")).distinct())
    sets = docs.join(smallable(ids), "doc_id", "left_semi").mapInArrow(_sets(words), "n_shingles long, sum_a long, sum_b long, shingles array<long>")
    return sets.select(F.xxhash64(*MARK).alias("doc"), "shingles")


def _links(docs: DataFrame, classes: DataFrame, trees: tuple[int, ...], words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between classes(doc, least_id, component, sketch), found by some trees, and (node, doc) of the too large nodes."""
    found = written(_tree_nodes(classes, trees))
    nodes = found.filter("not large")
    sets = _sets_of(docs, classes, nodes, words)
    compared = nodes.join(sets, "doc").select("node", "doc", "component", "shingles").repartition("node").sortWithinPartitions("node", "doc")
    return written(compared.mapInArrow(_compare(least), "a long, b long")), found.filter("large").select("node", "doc")


class Block:
    """Sets of one block as (set, shingle) entries in order of shingle."""

    def __init__(self, docs: list[int], components: list[int], sets: list[np.ndarray]):
        self.docs, self.components = np.array(docs, np.int64), np.array(components, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.rows = values[order], rows[order]


def _common(one: Block, two: Block) -> np.ndarray:
    """How many shingles every set of one block shares with every set of another."""
    shared, at, to = np.intersect1d(*(np.unique(x.values) for x in (one, two)), return_indices=True)
    sides = []
    for x in (one, two):
        begin = np.searchsorted(x.values, shared)
        sides.append((begin, np.searchsorted(x.values, shared, side="right") - begin))
    (begin_a, n_a), (begin_b, n_b) = sides
    counts = np.zeros((len(one.docs), len(two.docs)), np.float32)
    often = np.minimum(n_a, n_b) >= OFTEN
    columns = np.flatnonzero(often)
    for part in np.array_split(columns, max(1, -(-len(columns) // COLUMNS))):
        grids = []
        for x, begin, n in ((one, begin_a[part], n_a[part]), (two, begin_b[part], n_b[part])):
            grid = np.zeros((len(x.docs), len(part)), np.float32)
            entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            grid[x.rows[entry], np.repeat(np.arange(len(part)), n)] = 1
            grids.append(grid)
        counts += grids[0] @ grids[1].T
    columns = np.flatnonzero(~often)
    pairs = np.cumsum(n_a[columns] * n_b[columns])
    begin = 0
    while begin < len(columns):  # the others' pairs one by one, some four million together
        to = max(begin + 1, int(np.searchsorted(pairs, (pairs[begin - 1] if begin else 0) + (4 << 20), side="right")))
        part = columns[begin:to]
        n = n_a[part] * n_b[part]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(n_b[part], n)
        row = one.rows[np.repeat(begin_a[part], n) + within // wide] * len(two.docs) + two.rows[np.repeat(begin_b[part], n) + within % wide]
        counts += np.bincount(row, minlength=counts.size).reshape(counts.shape).astype(np.float32)
        begin = to
    return counts


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the bipartite graph of a matrix."""
    new_rows, new_columns, out = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool), []
    for start in np.flatnonzero(linked.any(1)).tolist():
        if not new_rows[start]:
            continue
        new_rows[start], todo = False, [(True, start)]
        while todo:
            is_row, k = todo.pop()
            found = np.flatnonzero(linked[k] & new_columns if is_row else linked[:, k] & new_rows).tolist()
            out.extend((k, x) if is_row else (x, k) for x in found)
            (new_columns if is_row else new_rows)[found] = False
            todo.extend((not is_row, x) for x in found)
    return out


def _block_links(one: Block, two: Block, least: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of all links between two blocks, or within one that is given twice."""
    if (one.components == one.components[0]).all() and (two.components == one.components[0]).all():
        return []
    common = _common(one, two)
    linked = 100 * common >= least * (one.sizes[:, None] + two.sizes[None, :] - common)
    linked &= (one.docs[:, None] != two.docs[None, :]) & (common > 0)
    return [(int(one.docs[i]), int(two.docs[j])) for i, j in _forest(linked)]


def _compare_blocks(least: int):
    """Rows (low, high, block, doc, component, shingles) sorted by low and high to links; memory holds a batch, two blocks and their matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        here = None

        def close():
            blocks = [Block(*map(list, zip(*x, strict=True))) for _, x in sorted(held.items())]
            found = _block_links(blocks[0], blocks[-1], least) if blocks and (len(blocks) == 2 or here[0] == here[1]) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            ends = batch.column("shingles").offsets.to_numpy()
            values = batch.column("shingles").values.to_numpy().view(np.uint64)
            for k, (low, high, block, doc, component) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("low", "high", "block", "doc", "component")), strict=True)):
                if (low, high) != here:
                    yield from close()
                    held, here = {}, (low, high)
                held.setdefault(block, []).append((doc, component, values[ends[k] : ends[k + 1]].copy()))
        yield from close()

    return run


def exact_links(sets: DataFrame, least: int) -> DataFrame:
    """Links (a, b) that join whatever links join among rows of sets(doc, component, shingles), whose shingles are distinct and whose docs are too.

    Sets are dealt to blocks of about ``BLOCK_SETS`` sets and ``BLOCK_SHINGLES``
    shingles.  A set goes to another block if a shingle of its prefix is in the
    prefix of a set of another component there, and two blocks that so meet are
    compared in one task by products of their set-by-shingle matrices.  So there
    is no row for a pair of sets, and each block pair gives a forest of links.
    """
    n = F.size("shingles").cast("long")
    size = sets.agg(F.count("*").alias("sets"), F.sum(n).alias("shingles")).first()
    blocks = max(1, -(-size["sets"] // BLOCK_SETS), -(-(size["shingles"] or 0) // BLOCK_SHINGLES))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64(F.col("doc") + 1), F.lit(blocks)).cast("int"))
    each = dealt.select("doc", "component", "block", n.alias("n"), F.explode("shingles").alias("shingle"))
    frequency = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("rows")).filter("rows > 1")
    placed = each.join(frequency, "shingle", "left").withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.coalesce("rows", F.lit(1)), "shingle")) - 1)
    # A set of n shares at least n * least / 100 with any that it is linked to.
    prefix = placed.filter(F.col("rows").isNotNull() & (100 * (F.col("n") - F.col("place")) >= least * F.col("n")))
    prefix = written(prefix.select("doc", "component", "block", "shingle"))
    there = prefix.groupBy("shingle", "block").agg(F.min("component").alias("low"), F.max("component").alias("high")).withColumnRenamed("block", "other")
    wants = prefix.join(there, "shingle").filter((F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))).select("doc", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).distinct()
    sent = wants.join(dealt, "doc").select("low", "high", "block", "doc", "component", "shingles").repartition("low", "high").sortWithinPartitions("low", "high")
    return sent.mapInArrow(_compare_blocks(least), "a long, b long")


def _rest_links(docs: DataFrame, classes: DataFrame, large: DataFrame, labels: DataFrame, words: int, least: int) -> DataFrame | None:
    """Exact links among the classes of large(node, doc) whose node still holds several components, if there are any."""
    named = large.join(labels, large["doc"] == labels["node"], "left").select(large["node"], "doc", F.coalesce("component", "doc").alias("component"))
    open_nodes = named.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("node")
    rest = written(named.join(open_nodes, "node").select("doc", "component").distinct())
    if rest.isEmpty():
        return None
    return written(exact_links(written(_sets_of(docs, classes, rest, words).join(rest, "doc").dropDuplicates(["doc"])), least))


def near_duplicates(docs: DataFrame, words: int = 4, least: int = 80) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id and kept, at a Jaccard similarity of least / 100."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(docs.mapInArrow(_profiles(words), "doc_id long, n_shingles long, sum_a long, sum_b long, sketch binary"))
    sized = found.filter("n_shingles > 0 and doc_id is not null")
    classes = written(sized.groupBy(*MARK).agg(F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch")).withColumn("doc", F.xxhash64(*MARK)))
    links, labels, large = None, None, None
    for trees in TREES:
        named = classes.withColumn("component", F.col("doc")) if labels is None else classes.join(labels, classes["doc"] == labels["node"], "left").withColumn("component", F.coalesce("component", "doc"))
        more, wide = _links(docs, named, trees, words, least)
        links, large = (more, wide) if links is None else (links.unionByName(more), large.unionByName(wide.withColumn("node", F.xxhash64("node"))))
        labels = components(links)
    rest = _rest_links(docs, classes, large, labels, words, least)
    if rest is not None:
        labels = components(links.unionByName(rest))
    members = written(labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct()))
    first = written(members.join(classes, members["node"] == classes["doc"]).groupBy("component").agg(F.min("least_id").alias("component_id")))
    ids = members.join(smallable(first), "component").select("node", "component_id")
    named = classes.join(ids, classes["doc"] == ids["node"], "left").select(*MARK, F.coalesce("component_id", "least_id").alias("component_id"))
    of_rows = found.drop("sketch").join(named, list(MARK), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return of_rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op8_neardup": op8_neardup}
#: The same join in SQL: prefixes of globally rarest-first shingles, pairs counted in full, components by reachability.
ORACLES = {
    "op8_neardup": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(list_zip(w, w[2:], w[3:], w[4:], true), lambda x: hash(x)) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] END) AS h FROM t),
marks AS (SELECT doc_id, count(*) AS n, sum(CAST(hash(h) AS HUGEINT)) AS mark FROM s GROUP BY doc_id),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, mark) AS c FROM marks),
e AS (SELECT c, n, h, count(*) OVER (PARTITION BY h) AS df FROM s JOIN class USING (doc_id) WHERE doc_id = c),
p AS (SELECT c, n, h FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY df, h) - 1 AS place FROM e) WHERE df > 1 AND 100 * (n - place) >= 80 * n),
pair AS (SELECT DISTINCT a.c AS a, b.c AS b, a.n AS n, b.n AS m FROM p AS a JOIN p AS b ON a.h = b.h AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link AS (SELECT a, b FROM pair JOIN e AS x ON x.c = a JOIN e AS y ON y.c = b AND y.h = x.h GROUP BY a, b, pair.n, pair.m HAVING 100 * count(*) >= 80 * (pair.n + pair.m - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT c AS a, c AS b FROM class UNION SELECT r.a, g.b FROM reach AS r JOIN edge AS g ON g.a = r.b),
least AS (SELECT a, min(b) AS first FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(class.n, 0) AS n_shingles, coalesce(first, d.doc_id) AS component_id, coalesce(first, d.doc_id) = d.doc_id AS kept
FROM documents AS d LEFT JOIN class ON d.doc_id = class.doc_id LEFT JOIN least ON least.a = class.c
""",
}
