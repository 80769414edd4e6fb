"""Prefix trie of conversations: z-fast tries by batch, merged by prefix hash.

A prefix of a conversation is known by a 127-bit polynomial hash of its turns
(each turn by 128 bits of the SHA-256 of role and text), so equal prefixes have
equal names on every executor. Steps:

1. Turns are sorted by (conv_id, turn) over all partitions; running hashes go on
   from one partition to the next (one carried state a partition), so a
   conversation of any length is spread like others.
2. Conversations are rebuilt: the prefix hash of a spliced conversation follows
   from the hashes of its two parts, no turn is read again.
3. Each task inserts its rows in batches of ``BATCH_ROWS``: a batch is a z-fast
   trie, a hash table from each compacted node's handle (its prefix at the
   two-fattest depth of its edge) to the node. A conversation's exit node is
   found by fat binary search over that table, the edge is split there.
4. Edges are expanded to one row a depth, batches are merged by prefix hash.
   What lies below a node is summed along chains: a node belongs to its
   smallest conversation, whose nodes are the end of its path; each chain's
   total goes once to every node above it.

Defined cases: rows of null conv_id take no part; null role or text is empty;
turns of equal number are ordered by the hash of role and text, repeated rows
are turns of their own; an empty table gives no node, also no root; columns
other than conv_id, turn, role and text are ignored; remainders of negative
ids have the id's sign, as in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint, shuffle_partitions

#: Rows of a local trie; longer partitions are inserted batch by batch.
BATCH_ROWS = 65536
#: Ids in a row of the digest's input.
CHUNK_IDS = 1024
#: Depths that a window task sums in one chain.
CHAIN_SLICE = 4096

#: Modulus and multiplier of the prefix hash.
PRIME = (1 << 127) - 1
FACTOR = 0x5851F42D4C957F2D14057B7EF767814F % PRIME
ROOT = bytes(16)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] with the most trailing zero bits."""
    return high & -(1 << ((low ^ high).bit_length() - 1))


def _number(name: bytes | None) -> int:
    return int.from_bytes(name or b"", "big")


def _name(number: int) -> bytes:
    return number.to_bytes(16, "big")


class _Node:
    """A compacted node: its edge covers the depths (top, depth] of ``path``."""

    __slots__ = ("top", "depth", "path", "sizes", "up", "children", "count", "conv", "ends")

    def __init__(self, top: int, depth: int, path: list, sizes: list, up: _Node | None):
        self.top, self.depth, self.path, self.sizes, self.up = top, depth, path, sizes, up
        self.children: dict[bytes, _Node] = {}
        self.count, self.conv, self.ends = 0, None, []


class ZFastTrie:
    """Trie over paths of prefix hashes; ``path[0]`` is the shared start."""

    def __init__(self, start: bytes):
        self.root = _Node(0, 0, [start], [0], None)
        self.handles: dict[bytes, _Node] = {}
        self.nodes: list[_Node] = []

    def _enter(self, node: _Node) -> None:
        self.handles[node.path[two_fattest(node.top, node.depth)]] = node

    def exit_node(self, path: list[bytes]) -> tuple[_Node, int]:
        """The node whose edge ``path`` leaves (or ends in) and how deep the two agree."""
        node, low, high, found = self.root, 0, len(path) - 1, None
        while low < high:
            middle = two_fattest(low, high)
            hit = self.handles.get(path[middle])
            if hit is None:
                high = middle - 1
            elif hit.depth < len(path) and hit.path[hit.depth] == path[hit.depth]:
                node, low = hit, hit.depth
            else:
                found, low = hit, middle
                break
        if found is None:
            if node.depth == len(path) - 1:
                return node, node.depth
            found = node.children.get(path[node.depth + 1])
            if found is None:
                return node, node.depth
            low = node.depth + 1
        high = min(found.depth, len(path) - 1)
        while low < high:  # prefix hashes agree up to one depth and no further
            middle = (low + high + 1) // 2
            low, high = (middle, high) if found.path[middle] == path[middle] else (low, middle - 1)
        return found, low

    def insert(self, path: list[bytes], sizes: list[int], conv: int, ended: bool) -> None:
        node, depth = self.exit_node(path)
        if depth < node.depth:
            node = self._split(node, depth)
        if depth < len(path) - 1:
            leaf = _Node(depth, len(path) - 1, path, sizes, node)
            node.children[path[depth + 1]] = leaf
            self.nodes.append(leaf)
            self._enter(leaf)
            node = leaf
        node.count += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        if ended:
            node.ends.append(conv)

    def _split(self, node: _Node, depth: int) -> _Node:
        upper = _Node(node.top, depth, node.path, node.sizes, node.up)
        node.up.children[node.path[node.top + 1]] = upper
        upper.children[node.path[depth + 1]] = node
        del self.handles[node.path[two_fattest(node.top, node.depth)]]
        node.top, node.up = depth, upper
        self._enter(upper)
        self._enter(node)
        self.nodes.append(upper)
        return upper

    def expand(self) -> Iterator[tuple]:
        """(node, depth, parent, conv, n_convs, bytes, ends) a depth of each edge; depths count from the start."""
        for node in sorted(self.nodes, key=lambda x: -x.depth):
            for depth in range(node.top + 1, node.depth + 1):
                yield (node.path[depth], depth, node.path[depth - 1], node.conv, node.count, node.sizes[depth],
                       sorted(node.ends) if depth == node.depth else [])
            node.up.count += node.count
            node.up.conv = node.conv if node.up.conv is None else min(node.up.conv, node.conv)


def _rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])


def _arrow(rows: Iterator[tuple], names: list[str], types: list, size: int = 8192) -> Iterator:
    import pyarrow as pa

    schema, held = pa.schema(list(zip(names, types))), []

    def batch():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _sorted_by(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in one order over all partitions, written so that every reader meets the same partitions."""
    return checkpoint(df.repartitionByRange(shuffle_partitions(df), *cols).sortWithinPartitions(*cols))


def _turn_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, q, q_before, bytes): hash of the first pos and pos - 1 turns."""
    import pyarrow as pa

    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("key"),
        F.octet_length(text).cast("long").alias("bytes"))
    turns = _sorted_by(turns, "conv_id", "turn", "key").select("conv_id", "key", "bytes")

    def ends(batches):
        """The first and the last conversation of the partition and the hash of the last one's turns here."""
        from pyspark import TaskContext

        first, conv, count, q = None, None, 0, 0
        for c, key, _ in _rows(batches):
            if conv != c:
                first = c if first is None else first
                conv, count, q = c, 0, 0
            count, q = count + 1, (q * FACTOR + _number(key) + 1) % PRIME
        if conv is not None:
            yield from _arrow(iter([(TaskContext.get().partitionId(), first, conv, count, _name(q))]),
                              ["part", "first", "last", "count", "q"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    starts, conv, count, q = {}, None, 0, 0
    for r in sorted(turns.mapInArrow(ends, "part int, first long, last long, count long, q binary").collect()):
        if r["first"] == conv:  # one row a partition reaches the driver
            starts[r["part"]] = (conv, count, q)
        if not (r["first"] == r["last"] == conv):
            conv, count, q = r["last"], 0, 0
        count, q = count + r["count"], (q * pow(FACTOR, r["count"], PRIME) + _number(r["q"])) % PRIME

    def numbered(batches):
        from pyspark import TaskContext

        def rows():
            conv, pos, q = starts.get(TaskContext.get().partitionId(), (None, 0, 0))
            for c, key, size in _rows(batches):
                if c != conv:
                    conv, pos, q = c, 0, 0
                before, pos, q = q, pos + 1, (q * FACTOR + _number(key) + 1) % PRIME
                yield c, pos, _name(q), _name(before), size

        yield from _arrow(rows(), ["conv_id", "pos", "q", "q_before", "bytes"],
                          [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()])

    return checkpoint(turns.mapInArrow(numbered, "conv_id long, pos long, q binary, q_before binary, bytes long"))


def _rebuilt(turns: DataFrame, group: int, most: int) -> DataFrame:
    """(conv_id, d, node, parent, bytes, ended) for d = 0 .. length of each rebuilt conversation."""
    import pyarrow as pa

    heads = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n_own"),
        F.sort_array(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", "q", "q_before", "bytes")))).alias("head"))
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = heads.withColumn("base", base).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int"))
    bases = heads.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    convs = convs.join(bases, "base", "left")
    taken = F.slice(F.coalesce("base_head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h"))
    convs = checkpoint(convs.withColumn("taken", F.when(F.col("h") > 0, taken).otherwise(F.array().cast(heads.schema["head"].dataType)))
                       .withColumn("n", F.size("taken") + F.greatest(F.lit(0).cast("long"), F.col("n_own") - F.col("h")))
                       .select("conv_id", "h", "n", "taken",
                               F.when(F.size("taken") > 0, F.element_at("taken", -1)["q"]).otherwise(F.lit(bytearray(ROOT))).alias("q_taken"),
                               F.when(F.col("h") == 0, F.lit(bytearray(ROOT))).otherwise(F.get("head", F.col("h") - 1)["q"]).alias("q_left")))
    columns = ["conv_id", "d", "node", "parent", "bytes", "ended"]
    roots = convs.select("conv_id", F.lit(0).cast("long"), F.lit(bytearray(ROOT)), F.lit(None).cast("binary"), F.lit(0).cast("long"),
                         F.col("n") == 0).toDF(*columns)
    taken = convs.select("conv_id", "n", F.explode("taken").alias("t")).select(
        "conv_id", F.col("t.pos"), F.col("t.q"), F.col("t.q_before"), F.col("t.bytes"), F.col("t.pos") == F.col("n")).toDF(*columns)
    own = turns.join(convs.select("conv_id", "h", "n", F.size("taken").alias("from"), "q_taken", "q_left"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("from") + F.col("pos") - F.col("h")).alias("d"), (F.col("pos") - F.col("h")).alias("k"), "q", "q_before",
        "q_taken", "q_left", "bytes", (F.col("from") + F.col("pos") - F.col("h") == F.col("n")).alias("ended"))

    def spliced(batches):
        def rows():
            for c, d, k, q, before, taken, left, size, ended in _rows(batches):
                shift = (_number(taken) - _number(left)) * pow(FACTOR, k - 1, PRIME)
                yield (c, d, _name((shift * FACTOR + _number(q)) % PRIME), _name((shift + _number(before)) % PRIME), size, ended)

        yield from _arrow(rows(), columns, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()])

    own = own.mapInArrow(spliced, "conv_id long, d long, node binary, parent binary, bytes long, ended boolean")
    return _sorted_by(roots.unionByName(taken).unionByName(own), "conv_id", "d")


def _forest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of one batch: (node, depth, parent, conv, n_convs, bytes, ends or None)."""
    tries: dict[bytes, tuple[int, ZFastTrie]] = {}
    roots, root_conv, root_ends = 0, None, []

    def put(start, path, sizes, conv, ended):
        if len(path) > 1:
            depth, trie = tries.setdefault(path[0], (start, ZFastTrie(path[0])))
            trie.insert(path, sizes, conv, ended)

    start, path, sizes, conv, last = 0, [], [], None, False
    for c, d, node, parent, size, ended in rows:
        if c != conv:
            put(start, path, sizes, conv, last)
            start, path, sizes, conv = (0, [], [], c) if d == 0 else (d - 1, [bytes(parent)], [0], c)
        path.append(bytes(node))
        sizes.append(size)
        last = ended
        if d == 0:
            roots, root_conv = roots + 1, c if root_conv is None else min(root_conv, c)
            if ended:
                root_ends.append(c)
    put(start, path, sizes, conv, last)
    if roots:
        yield ROOT, 0, None, root_conv, roots, 0, root_ends
    for start, trie in tries.values():
        for node, depth, *rest in trie.expand():
            yield (node, start + depth, *rest)


def _local_nodes(rows: DataFrame) -> DataFrame:
    """Each batch's trie, expanded; ends leave in rows of their own (n_convs 0)."""
    import pyarrow as pa

    def insert(batches):
        from itertools import islice

        def found():
            source = _rows(batches)
            while batch := list(islice(source, BATCH_ROWS)):
                for node, depth, parent, conv, n, size, ends in _forest(iter(batch)):
                    yield node, depth, parent, conv, n, size, None, None
                    for at in range(0, len(ends), CHUNK_IDS):
                        part = ends[at : at + CHUNK_IDS]
                        yield node, depth, parent, conv, 0, size, part[0], ",".join(map(str, part))

        yield from _arrow(found(), ["node", "depth", "parent", "conv_id", "n_convs", "bytes", "first", "ends"],
                          [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], 4096)

    return checkpoint(rows.mapInArrow(
        insert, "node binary, depth long, parent binary, conv_id long, n_convs long, bytes long, first long, ends string"))


def _digests(local: DataFrame) -> DataFrame:
    """(node, ends_sha256): a node's chunks of ids come in ascending order and are hashed one by one."""
    import pyarrow as pa

    chunks = local.where("ends IS NOT NULL").select("node", "first", "ends")
    chunks = chunks.repartition("node").sortWithinPartitions("node", "first")

    def digest(batches):
        import hashlib

        def rows():
            node, state = None, None
            for key, _, ends in _rows(batches):
                if key != node:
                    if node is not None:
                        yield node, state.hexdigest()
                    node, state = key, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if node is not None:
                yield node, state.hexdigest()

        yield from _arrow(rows(), ["node", "ends_sha256"], [pa.binary(), pa.string()])

    return chunks.mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the node's prefix hash.

    Conversation c is rebuilt from the first h turns of c - c % ``group`` and its own
    turns after its first h; h = crc32(c) % (``most`` + 1).
    """
    paths = _rebuilt(_turn_hashes(conversations), group, most)
    local = _local_nodes(paths)
    nodes = local.where("n_convs > 0").groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")).where("node IS NOT NULL")
    nodes = checkpoint(nodes.join(children, "node", "left").withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes"))
                       .withColumn("leaf", F.col("n_children").isNull().cast("long")))

    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("weight").alias("chain_weight"), F.max("leaf").alias("chain_leaf"))
    above = (paths.select("conv_id", "d", "node").join(chains, "conv_id").where("d < top").groupBy("node")
             .agg(F.sum("chain_weight").alias("other_weight"), F.sum("chain_leaf").alias("other_leaves")))
    cut = nodes.withColumn("cut", F.floor(F.col("depth") / CHAIN_SLICE))
    later = Window.partitionBy("conv_id").orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, -1)
    deeper = cut.groupBy("conv_id", "cut").agg(F.sum("weight").alias("part"), F.max("leaf").alias("part_leaf")).select(
        "conv_id", "cut", F.coalesce(F.sum("part").over(later), F.lit(0)).alias("deeper"),
        F.max("part_leaf").over(Window.partitionBy("conv_id")).alias("own_leaf"))
    down = Window.partitionBy("conv_id", "cut").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumn("here", F.sum("weight").over(down)).join(deeper, ["conv_id", "cut"])

    whole = own.join(above, "node", "left").join(_digests(local), "node", "left")
    whole = checkpoint(whole.select(
        "node", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        (F.col("own_leaf") + F.coalesce("other_leaves", F.lit(0))).cast("long").alias("n_leaves"),
        (F.col("here") + F.col("deeper") + F.coalesce("other_weight", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
    parents = whole.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node")
