"""Near-duplicate documents by a chosen-path similarity join over sets of word shingles.

A document's set holds its distinct runs of five words (lower-cased; with fewer words the whole
sequence). Two documents are linked from a Jaccard similarity of 0.85 on; the result names the
component of links that each document is in.

Documents with equal sets are one node. A set's signature has 64 minwise tokens. Each of several
independent trees starts with all nodes together and branches recursively: a tree node chooses at
random 1 / similarity of the signature's places (one, and at 0.85 a second one so often that this is
the average), and sends each member to the child named by its minwise token there. Children with one
member end. Small ones are compared exhaustively by signature; large ones branch again, and what is
still large after the last level counts as alike. A node whose signatures fit into a task branches on
within that task, so only larger ones cost further shuffles. Members found alike form clusters, and
all sets of a cluster are compared in full, so every link of the result is confirmed. A cluster with more
bytes than a task should hold is cut into blocks and each pair of blocks compared by a task; from
a group of copies only the links of a spanning tree are given out, never all pairs.

Two sets at the similarity bound share a child with at least that probability in each of 12 trees
while nodes are small, so that no tree brings them together less often than once in 10**9; over a
path of six levels once in some 10**4 (at 0.80 with 14 trees). Their signatures then differ too much
about once in 10**5. Members are compared by the lower bytes of their tokens, which finds no fewer. The bound is a parameter, `similar`; what follows from it is derived from it.

Edge cases: NULL and empty texts have no set, and rows without id no links; they are in a component
of their own and kept. Rows that share an id count as one node that has all links of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry.llm.components import components
from funnelry.llm.grouped import whole_groups
from funnelry.llm.stores import MAX_BROADCAST_ROWS, pick, small_batches, stored, without
from funnelry.llm.text import BETWEEN_SPACES, Words, blobs, mix, runs, slices, words_of

SHINGLE = 5
#: Linked from so many hundredths of similarity on.
SIMILAR = 85
PLACES = 64
TREES = 12
LEVELS = 6
#: Members of a tree node that are compared with each other.
SMALL = 128
#: Rows that one task may hold of a tree node while it branches on to the last level.
WITHIN = 1 << 15
#: Deviations below the expected equal places of two signatures from which sets are compared.
DEVIATIONS = 4.5
#: Set bytes of a block of a cluster.
BLOCK_BYTES = 24 << 20
#: Rows of a batch get numbers in the bits above a shingle's.
ROW_BITS = 10
SHINGLE_BITS = 64 - ROW_BITS

_RANDOM = np.random.default_rng(7_001)
_FACTORS = _RANDOM.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RANDOM.integers(1, 1 << 63, 2, dtype=np.uint64)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, text after text and sorted, and where each text begins."""
    n = np.diff(words.first)
    row = words.row()
    last = words.first[1:][row]
    start = np.flatnonzero(np.arange(len(row)) + SHINGLE <= last)
    numbers, owners = [runs(words.number, SHINGLE)[start]], [row[start]]
    for short in range(1, SHINGLE):
        rows = np.flatnonzero(n == short)
        if len(rows):
            at = words.first[rows]
            numbers.append(runs(words.number, short)[at] + np.uint64(short))
            owners.append(rows)
    number = mix(np.concatenate(numbers)) >> np.uint64(ROW_BITS)
    key = np.unique(np.concatenate(owners).astype(np.uint64) << np.uint64(SHINGLE_BITS) | number)
    rows = np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(SHINGLE_BITS)
    return key & np.uint64((1 << SHINGLE_BITS) - 1), np.searchsorted(key, rows)


def signatures(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minwise tokens (texts x places, 16 bits) and two digests of each set."""
    n = len(first) - 1
    tokens, digests = np.zeros((n, PLACES), np.uint16), np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        at = first[full]
        for place, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(sets * factor, at)
            tokens[full, place] = mix(least) >> np.uint64(48)
        for k, salt in enumerate(_SALTS):
            digests[full, k] = np.add.reduceat(mix(sets ^ salt), at)
    return tokens, digests.view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, column):
            for at in range(0, len(part), 1 << ROW_BITS):
                yield part.slice(at, 1 << ROW_BITS)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two digests of the set and its signature; docs are (doc_id, text)."""
    schema = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"
    names = ["doc_id", "n_shingles", "d1", "d2", "signature"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "text"):
            sets, first = shingles(words_of(part.column(1), BETWEEN_SPACES))
            tokens, digests = signatures(sets, first)
            # The lower bytes of all places, then the upper ones: see `marks`.
            planes = tokens.view(np.uint8).reshape(-1, PLACES, 2).transpose(0, 2, 1)
            columns = [
                part.column(0),
                pa.array(np.diff(first), pa.int64()),
                pa.array(digests[:, 0]),
                pa.array(digests[:, 1]),
                blobs(planes.ravel(), np.arange(len(part) + 1) * 2 * PLACES),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(sign, schema)


def _child(node: Column, turn: int) -> Column:
    """The child of a node that a member belongs to, by one place of its signature."""
    place = F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(PLACES)).cast("int")
    lower, upper = (F.substring(F.col("signature"), place + at, F.lit(1)) for at in (1, PLACES + 1))
    return F.xxhash64(node, F.lit(turn), F.concat(lower, upper))


def marks() -> Column:
    """A byte of each place of a signature; enough to compare the members of a node."""
    return F.substring("signature", 1, PLACES)


def _children(node: Column, similar: int) -> Column:
    """As many children as 1 / similarity has wholes, and one more for the share of nodes that it leaves."""
    whole, rest = divmod(100, similar)
    more = F.pmod(F.xxhash64(node, F.lit("more")), F.lit(similar)) < rest
    last = F.when(more, F.array(_child(node, whole))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array(*(_child(node, turn) for turn in range(whole))), last)


def least_alike(similar: int) -> int:
    """Equal places of two signatures from which sets are compared: 41 at 0.85, 36 at 0.80."""
    share = similar / 100
    return max(0, math.floor(PLACES * share - DEVIATIONS * math.sqrt(PLACES * share * (1 - share))))


def most_within(similar: int, level: int) -> int:
    """Members up to which a node of a level branches on within a task: 14,539 of the first level at 0.85."""
    return max(SMALL, int(WITHIN * (similar / 100) ** (LEVELS - 1 - level)))


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of 0 to n - 1 that each is connected to by edges a, b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        if np.array_equal(least, label[a]) and np.array_equal(least, label[b]):
            return label
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]


def _alike(tokens: np.ndarray, found: np.ndarray, least_equal: int) -> np.ndarray:
    """The first member of its part of each group that every member is connected to."""
    sizes = np.diff(found)
    left, right = [], []
    for size in np.unique(sizes):
        at = found[:-1][sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 18) // max(len(i), 1))
        for k in range(0, len(at), step):
            a, b = ((at[k : k + step, None] + x).ravel() for x in (i, j))
            near = (tokens[a] == tokens[b]).sum(1) >= least_equal
            left.append(a[near])
            right.append(b[near])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return _connected(len(tokens), a, b)


def _branches(tokens: np.ndarray, member: np.ndarray, node: np.ndarray, similar: int) -> tuple:
    """The members of all children, child after child, and the children; as `_children` does over tables."""
    whole, rest = divmod(100, similar)
    members, children = [], []
    for turn in range(whole + 1):
        if turn == whole:  # one more for a share of the nodes
            more = mix(node ^ _SALTS[1]) % np.uint64(similar) < rest
            member, node = member[more], node[more]
        turned = mix(node ^ mix(np.full(1, turn + 1, np.uint64)))
        token = tokens[member, turned % np.uint64(PLACES)].astype(np.uint64)
        members.append(member)
        children.append(mix(turned ^ mix(token + _SALTS[0])))
    member, node = np.concatenate(members), np.concatenate(children)
    order = np.lexsort((member, node))
    return member[order], node[order]


def _alike_within(tokens: np.ndarray, node: int, levels: int, similar: int, few: int) -> np.ndarray:
    """As `_alike` for one node, which branches on for so many levels down to nodes of a few members."""
    least_equal = least_alike(similar)
    member, nodes = np.arange(len(tokens)), np.full(len(tokens), node).view(np.uint64)
    edges = [(member[:0], member[:0])]
    for left in range(levels, -1, -1):
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]])) if len(nodes) else member[:0]
        sizes = np.diff(first, append=len(nodes))
        small = (sizes > 1) & (sizes <= few)
        if small.any():
            own = member[np.repeat(small, sizes)]
            edges.append((own[_alike(tokens[own], np.cumsum([0, *sizes[small]]), least_equal)], own))
        large = np.repeat(sizes > few, sizes)
        if not left:
            edges.append((np.repeat(member[first], sizes)[large], member[large]))
            break
        member, nodes = _branches(tokens, member[large], nodes[large], similar)
    return _connected(len(tokens), *(np.concatenate(x) for x in zip(*edges, strict=True)))


def _compared_nodes(rows: DataFrame, similar: int, level: int) -> DataFrame:
    """Edges (a, b) between members of a level's nodes that their signatures connect, from the least to others."""
    least_equal = least_alike(similar)
    levels, few = LEVELS - 1 - level, SMALL

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, found in whole_groups(batches, ["node"]):
            ids, nodes = table["id"].to_numpy(), table["node"].to_numpy()
            tokens = np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint8).reshape(-1, PLACES)
            label = np.arange(len(ids))
            sizes = np.diff(found)
            small = np.flatnonzero(np.repeat(sizes <= few, sizes))
            if len(small):
                label[small] = small[_alike(tokens[small], np.cumsum([0, *sizes[sizes <= few]]), least_equal)]
            for at in np.flatnonzero(sizes > few):
                a, b = found[at], found[at + 1]
                label[a:b] = a + _alike_within(tokens[a:b], nodes[a], levels, similar, few)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[label[moved]]), pa.array(ids[moved])], ["a", "b"]
            )

    rows = rows.repartition("node").sortWithinPartitions("node", "id")
    return rows.mapInArrow(compare, "a long, b long")


def candidates(nodes: DataFrame, trees: int = TREES, similar: int = SIMILAR) -> DataFrame:
    """Edges (a, b) that connect all (id, signature) whose sets should be compared."""
    rows = nodes.withColumn("node", F.explode(F.array(*(F.xxhash64(F.lit(t)) for t in range(trees)))))
    marked = nodes.select("id", marks().alias("marks"))
    edges = []
    for level in range(LEVELS):
        rows = rows.withColumn("node", F.explode(_children(F.col("node"), similar)))
        slim = stored(rows.select("id", "node"), "branches")
        counts = slim.groupBy("node").agg(F.count(F.lit(1)).alias("members"))
        # Stored, so that both sides of the join are plain shuffles and Spark can split a hot node.
        counts = stored(counts.where("members > 1"), "nodes")
        most = most_within(similar, level)
        small, large = (counts.where(c).select("node") for c in (f"members <= {most}", f"members > {most}"))
        edges.append(stored(_compared_nodes(slim.join(small, "node").join(marked, "id"), similar, level), "alike"))
        if large.isEmpty():
            break
        members = slim.join(large, "node")
        if level == LEVELS - 1:
            least = members.groupBy("node").agg(F.min("id").alias("a"))
            edges.append(members.join(least, "node").select("a", F.col("id").alias("b")))
        rows = members.join(nodes, "id")
    found = edges[0]
    for more in edges[1:]:
        found = found.union(more)
    return found.where("a <> b").distinct()


def spanning_links(ids: np.ndarray, sets: np.ndarray, first: np.ndarray, similar: int) -> list:
    """Pairs of ids of similar sets that connect all that such pairs connect.

    Each set that is reached is compared with those not reached so far, so a group of copies costs
    as many comparisons as it has members.
    """
    sizes = np.diff(first)
    numbers, code = np.unique(sets, return_inverse=True)
    code = code.astype(np.int32)
    own = np.zeros(len(numbers), bool)
    left = np.ones(len(ids), bool)
    out = []
    for begin in range(len(ids)):
        if not left[begin]:
            continue
        left[begin] = False
        reached = [begin]
        while reached:
            at = reached.pop()
            low, high = np.minimum(sizes, sizes[at]), np.maximum(sizes, sizes[at])
            near = np.flatnonzero(left & (100 * low >= similar * high))
            if not len(near):
                continue
            n = sizes[near]
            own[code[first[at] : first[at + 1]]] = True
            if 2 * n.sum() > len(code):
                both = np.add.reduceat(own[code], first[:-1], dtype=np.int64)[near]
            else:
                starts = np.cumsum(n) - n
                flat = code[np.repeat(first[near] - starts, n) + np.arange(n.sum())]
                both = np.add.reduceat(own[flat], starts, dtype=np.int64)
            own[code[first[at] : first[at + 1]]] = False
            linked = near[100 * both >= similar * (n + sizes[at] - both)]
            left[linked] = False
            reached.extend(linked)
            out.extend((ids[at], ids[k]) for k in linked)
    return out


def _confirmed(docs: DataFrame, clusters: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) within clusters (id, cluster, blocks), confirmed on full sets."""
    if clusters.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        clusters = F.broadcast(clusters)
    rows = docs.join(clusters, F.col("doc_id") == F.col("id")).select("id", "cluster", "blocks", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "text"):
            sets, first = shingles(words_of(part.column(3), BETWEEN_SPACES))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], blobs(sets, first)], ["id", "cluster", "blocks", "shingles"]
            )

    sets = rows.mapInArrow(shingle, "id long, cluster long, blocks int, shingles binary")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sets = sets.where("length(shingles) > 0").withColumn("own", block).withColumn("other", other)
    pair = {"low": F.least("own", "other"), "high": F.greatest("own", "other")}
    sets = sets.select("id", "cluster", "shingles", *(c.alias(n) for n, c in pair.items()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, found in whole_groups(batches, ["cluster", "low", "high"]):
            ids = table["id"].to_numpy()
            shingles_ = table["shingles"].to_pylist()
            out = []
            for a, b in zip(found[:-1], found[1:], strict=True):
                if b - a > 1:
                    flat = np.frombuffer(b"".join(shingles_[a:b]), np.uint64)
                    first = np.cumsum([0, *(len(x) // 8 for x in shingles_[a:b])])
                    out.extend(spanning_links(np.arange(a, b), flat, first, similar))
            links = np.array(out, np.int64).reshape(-1, 2)
            # What is linked here is named by its least id, which a round of `components` takes up at once.
            label = _connected(len(ids), links[:, 0], links[:, 1])
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[moved]]), pa.array(ids[moved])], ["a", "b"])

    key = ("cluster", "low", "high")
    return sets.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, trees: int = TREES, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept."""
    small_batches(docs.sparkSession)
    docs = pick(docs, doc_id="doc_id", text="text")
    base = stored(signed(docs), "signatures")
    digest = ["n_shingles", "d1", "d2"]
    sets = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*digest)
    sets = stored(sets.agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "sets")
    full = base.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", *digest)
    ends = [f(F.struct(*digest)).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))]
    several = stored(full.groupBy("doc_id").agg(*ends).where("least <> most").select("doc_id"), "several")
    repeated = not several.isEmpty()
    # The trees name a set by its id, or by its digest where an id has several: its members would multiply.
    keyed = sets.withColumn("key", F.col("id"))
    if repeated:
        key = F.when(F.col("s").isNull(), F.col("id")).otherwise(F.col("d1"))
        keyed = sets.join(several.toDF("s"), F.col("id") == F.col("s"), "left").withColumn("key", key)
        keyed = stored(keyed.select("key", "id", "n_shingles", "signature"), "keyed")
    clusters = components(candidates(keyed.select(F.col("key").alias("id"), "signature"), trees, similar))
    clusters = keyed.select("key", "id", "n_shingles").join(clusters.toDF("key", "cluster"), "key")
    clusters = stored(clusters.groupBy("id", "cluster").agg(F.sum("n_shingles").alias("n")), "clusters")
    # Blocks of a cluster: as many as its bytes need, and at least one.
    total = clusters.groupBy("cluster").agg(F.sum("n").alias("n"))
    blocks = F.ceil(F.col("n") * 8 / BLOCK_BYTES).cast("int")
    blocks = total.select(F.col("cluster").alias("c"), F.greatest(blocks, F.lit(1)).alias("blocks"))
    named = clusters.join(blocks, F.col("cluster") == F.col("c")).select("id", "cluster", "blocks")
    links = stored(_confirmed(docs, stored(named, "blocks"), similar), "links")
    # An id whose rows have different sets connects those sets.
    if repeated:
        labelled = full.join(several, "doc_id").join(sets.drop("signature"), digest)
        links = links.union(labelled.select("doc_id", "id").where("doc_id <> id").distinct())
    found = components(links)
    named = sets.drop("signature").join(found, "id", "left")
    named = named.select(*digest, F.coalesce("component", "id").alias("component"))
    rows = base.select("doc_id", *digest).join(named, digest, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", kept)


#: Numbers from here on stand for rows without id; equal texts have the same.
WITHOUT_ID = 1 << 62


def row_number_of(ident: Column, text: Column) -> Column:
    """The id, or a number that follows from the text; NULL for a row with neither id nor words."""
    follows = F.xxhash64(text).bitwiseAND(F.lit(WITHOUT_ID - 1)) + F.lit(WITHOUT_ID)
    return F.coalesce(ident, F.when(text.rlike(r"[^\x20\x09-\x0D]"), follows))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One row of each component, with its columns.

    It is the row with the smallest id. Of rows that repeat this id with an equal text one stays, the
    smallest by all columns, which must be orderable; different texts under it all stay. Rows without id are near duplicates of others like any row and give way
    to those with an id; among themselves the one with the smallest number by its text stays. Rows
    with neither id nor words are all kept.
    """
    numbered = pick(docs, doc_id="doc_id", text="text")
    numbered = numbered.select(row_number_of(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
    found = stored(near_duplicates(numbered, **how).select("doc_id", "kept"), "near_duplicates")
    places = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*places)
    ident, text = (F.col(places[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = rows.withColumn("_number", row_number_of(ident, text))
    rows = without(rows, found.where("NOT kept").select("doc_id").distinct(), "_number")
    # Few numbers stand for several rows; only their rows meet, one of each number and task.
    counts = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    several = stored(counts.where("n > 1").select("doc_id"), "several")
    alone = without(rows, several, "_number").select(*places)
    repeated = rows.join(several, F.col("_number") == F.col("doc_id"), "left_semi")
    least = repeated.groupBy("_number", F.xxhash64(text).alias("_text")).agg(F.min(F.struct(*places)).alias("row"))
    return alone.unionByName(least.select("row.*")).toDF(*docs.columns)
