"""Prefix trie of conversations, built from z-fast tries.

A conversation is a string whose characters are its turns. Every prefix is known by a 128-bit fingerprint, the
exclusive or of one fingerprint per turn and depth, so that the prefixes of a long conversation come from its
stretches without one task reading it whole. Tasks put stretches into z-fast tries: a compacted node is hashed
under its prefix at the two-fattest depth of its edge, a fat binary search over those handles finds where a
conversation leaves the trie, batches are inserted at the exits found, and in the end the edges are expanded
into one row per prefix. These rows are far fewer than turns where prefixes are shared; grouped by fingerprint they
give the nodes of the whole trie.

The smallest member of a node owns it. The nodes one conversation owns are the end of its path, a chain; a sum over a subtree
is then a sum over the rest of a chain and over the chains that branch off there. A chain is told to each owner on
its path once, so that no recursion over levels is needed and the rows stay fewer than the turns.

Defined cases: turns with a null conversation id belong to none; a null turn number comes first; turns of
one number stand in order of role and then of the fingerprint of their text, and repeated rows count as turns of their own;
a null role or text is empty; an empty table has no nodes, not even a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewledger.llm.frames import reach_package, settled
from crewledger.operators.order import with_positions

# Turns of a conversation that one row holds, and turns that one trie in a task takes.
STRETCH, TRIE_TURNS = 1024, 200_000
# Conversations located together before any of them is inserted.
BATCH = 512
# Most turns that a conversation borrows from the one its hundred begins with.
BORROWED = 5
# A prefix up to this long that more than this share of the conversations begin with is joined by broadcast: at most
# HOT_DEPTH / HOT_SHARE rows.
HOT_DEPTH, HOT_SHARE = 64, 1 / 1000
NOTHING = hashlib.sha256(b"").hexdigest()


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """A compacted trie over strings given by the fingerprints of their prefixes.

    String `s` has `keys[s][d - begins[s]]` for its prefix of each depth d from `begins[s]` on; strings that
    begin at the same depth with the same prefix share a root.
    """

    def __init__(self, begins: list[int], keys: list[list]) -> None:
        self.begins, self.keys = begins, keys
        self.roots: dict[tuple, int] = {}
        self.handles: dict[tuple, int] = {}
        self.child: dict[tuple, int] = {}
        self.like: list[int] = []  # a string that runs through the node
        self.above: list[int] = []
        self.top: list[int] = []  # depth where the edge to the node begins, and where it ends
        self.extent: list[int] = []

    def _key(self, string: int, depth: int):
        return self.keys[string][depth - self.begins[string]]

    def _node(self, like: int, above: int, top: int, extent: int) -> int:
        self.like.append(like)
        self.above.append(above)
        self.top.append(top)
        self.extent.append(extent)
        return len(self.like) - 1

    def _hash(self, node: int) -> None:
        depth = two_fattest(self.top[node], self.extent[node])
        self.handles[depth, self._key(self.like[node], depth)] = node

    def root(self, string: int) -> int:
        begin = (self.begins[string], self.keys[string][0])
        if begin not in self.roots:
            self.roots[begin] = self._node(string, -1, begin[0], begin[0])
        return self.roots[begin]

    def exit(self, string: int) -> tuple[int, int]:
        """The node in whose edge, or at whose end, the string leaves the trie, and the depth up to which it agrees."""
        end = self.begins[string] + len(self.keys[string]) - 1
        node = self.root(string)
        low, high = self.extent[node], end
        while low < high:
            depth = two_fattest(low, high)
            found = self.handles.get((depth, self._key(string, depth)))
            if found is None:
                high = depth - 1
            else:
                node, low = found, self.extent[found]
        agreed = self._agreed(string, node, end)
        while agreed == self.extent[node] < end:
            below = self.child.get((node, self._key(string, agreed + 1)))
            if below is None:
                break
            # The handle of the edge lies behind the place where the string leaves it.
            node, agreed = below, self._agreed(string, below, end)
        return node, agreed

    def _agreed(self, string: int, node: int, end: int) -> int:
        low, high = self.top[node], min(end, self.extent[node])
        while low < high:
            middle = (low + high + 1) // 2
            if self._key(string, middle) == self._key(self.like[node], middle):
                low = middle
            else:
                high = middle - 1
        return low

    def insert(self, string: int, node: int, depth: int) -> int:
        """Puts in a string that leaves at `depth` in or below the edge of `node`; the node where it ends."""
        while self.top[node] >= depth and self.above[node] >= 0:
            node = self.above[node]  # its edge has been split since
        if depth < self.extent[node]:
            upper = self._node(self.like[node], self.above[node], self.top[node], depth)
            old = two_fattest(self.top[node], self.extent[node])
            del self.handles[old, self._key(self.like[node], old)]
            self.child[self.above[node], self._key(self.like[node], self.top[node] + 1)] = upper
            self.child[upper, self._key(self.like[node], depth + 1)] = node
            self.above[node], self.top[node] = upper, depth
            self._hash(upper)
            self._hash(node)
            node = upper
        end = self.begins[string] + len(self.keys[string]) - 1
        if end == depth:
            return node
        leaf = self._node(string, node, depth, end)
        self.child[node, self._key(string, depth + 1)] = leaf
        self._hash(leaf)
        return leaf

    def insert_all(self) -> list[int]:
        """Inserts all strings batch by batch; the node where each ends."""
        ends = [-1] * len(self.keys)
        for first in range(0, len(self.keys), BATCH):
            waiting = list(range(first, min(first + BATCH, len(self.keys))))
            while waiting:
                exits = [self.exit(s) for s in waiting]
                taken, later = set(), []
                for string, (node, depth) in zip(waiting, exits, strict=True):
                    end = self.begins[string] + len(self.keys[string]) - 1
                    branch = (node, depth, None if depth == end else self._key(string, depth + 1))
                    if branch in taken and depth < end:
                        later.append(string)  # leaves where another of the batch has just gone in
                    else:
                        taken.add(branch)
                        ends[string] = self.insert(string, node, depth)
                waiting = later
        return ends


def crc32_of(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, p, t1, t2, chars): every turn with its place from 0 and the fingerprint of its role and text."""
    role_, text_ = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    narrow = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), role_.alias("role"),
        F.xxhash64(F.lit(1), role_, text_).alias("t1"), F.xxhash64(F.lit(2), text_, role_).alias("t2"),
        F.length(text_).cast("long").alias("chars"))
    order = [F.asc("c"), F.asc_nulls_first("turn"), *map(F.asc, ("role", "t1", "t2"))]
    placed = settled(with_positions(narrow, *order, name="at").select("c", "at", "t1", "t2", "chars"))
    first = placed.groupBy("c").agg(F.min("at").alias("first"))
    return placed.join(first, "c").select("c", (F.col("at") - F.col("first")).cast("long").alias("p"), "t1", "t2", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as (c, depth, e1, e2, chars), and (c, length) of every one, also of those without turns.

    The first h turns come from the conversation its hundred begins with, h being the checksum of the id modulo six; then
    follow its own turns after the first h.
    """
    turns = settled(turns)
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    lenders = sizes.filter("c % 100 = 0").select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = settled(
        sizes.withColumns({"h": crc32_of(F.col("c")) % (BORROWED + 1), "base": F.expr("c - c % 100")}).join(lenders, "base", "left")
        .select("c", "h", "base", F.expr("least(h, coalesce(base_n, 0))").alias("lent"), F.expr("greatest(n - h, 0)").alias("own")))
    own = turns.join(convs, "c").filter("p >= h").select("c", F.expr("lent + p - h + 1").alias("depth"), "t1", "t2", "chars")
    lent = turns.filter(f"c % 100 = 0 and p < {BORROWED}").withColumnRenamed("c", "base").join(
        convs.select("base", "c", "lent"), "base").filter("p < lent").select("c", F.expr("p + 1").alias("depth"), "t1", "t2", "chars")
    # A turn counts differently at every depth, so that a prefix is the exclusive or of its turns.
    mixed = own.union(lent).select(
        "c", "depth", F.xxhash64(F.lit(3), "t1", "t2", "depth").alias("e1"), F.xxhash64(F.lit(4), "t2", "t1", "depth").alias("e2"), "chars")
    return mixed, convs.select("c", F.expr("lent + own").alias("length"))


def stretches(mixed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(c, s, x1, x2, turns, length): at most STRETCH turns a row in order of depth, behind the fingerprint of all before them."""
    rows = mixed.withColumn("s", F.expr(f"(depth - 1) div {STRETCH}"))
    # Conversations of one hundred share prefixes, so they go to one task: at most a hundred stretches.
    grouped = rows.withColumn("hundred", F.expr("c div 100")).repartition("hundred", "s").groupBy("hundred", "s", "c").agg(
        F.array_sort(F.collect_list(F.struct("depth", "e1", "e2", "chars"))).alias("turns"))
    whole = rows.filter("s > 0").select("c").distinct()
    sums = rows.join(whole, "c", "left_semi").groupBy("c", "s").agg(F.bit_xor("e1").alias("y1"), F.bit_xor("e2").alias("y2"))
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    started = sums.select("c", "s", F.bit_xor("y1").over(before).alias("x1"), F.bit_xor("y2").over(before).alias("x2"))
    return grouped.join(started, ["c", "s"], "left").join(lengths, "c").select(
        "c", "s", F.coalesce("x1", F.lit(0)).alias("x1"), F.coalesce("x2", F.lit(0)).alias("x2"), "turns", "length")


def prefix_keys(x1: int, x2: int, turns: np.ndarray) -> np.ndarray:
    """Fingerprints of the prefixes from the one in front of the turns on, two numbers each."""
    steps = np.concatenate([[(x1, x2)], turns]).astype(np.int64)
    return np.bitwise_xor.accumulate(steps, axis=0)


NODES = "k1 long, k2 long, p1 long, p2 long, depth long, chars long, n long, least long, ends long"


def local_nodes(rows: list[tuple]) -> dict[str, list] | None:
    """The expanded nodes of a z-fast trie over rows (c, x1, x2, depths, elements, chars, is_last)."""
    keys, begins = [], []
    for _, x1, x2, depths, elements, _, _ in rows:
        keys.append(list(map(tuple, prefix_keys(x1, x2, elements).tolist())))
        begins.append(int(depths[0]) - 1)
    trie = ZFastTrie(begins, keys)
    stops = trie.insert_all()
    count = len(trie.like)
    n, ends, least = np.zeros(count, np.int64), np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max)
    for (c, *_, is_last), node in zip(rows, stops, strict=True):
        n[node] += 1
        ends[node] += is_last
        least[node] = min(least[node], c)
    for node in sorted(range(count), key=lambda v: -trie.extent[v]):
        above = trie.above[node]
        if above >= 0:
            n[above] += n[node]
            least[above] = min(least[above], least[node])
    out: dict[str, list] = {name.split()[0]: [] for name in NODES.split(", ")}
    for node in range(count):
        string = trie.like[node]
        for depth in range(trie.top[node] + 1, trie.extent[node] + 1):
            at = depth - begins[string]
            (k1, k2), (p1, p2) = keys[string][at], keys[string][at - 1]
            stop = int(ends[node]) if depth == trie.extent[node] else 0
            for name, value in zip(out, (k1, k2, p1, p2, depth, int(rows[string][5][at - 1]), int(n[node]), int(least[node]), stop), strict=True):
                out[name].append(value)
    return out


def trie_nodes(cut: DataFrame) -> DataFrame:
    """(k1, k2, depth, chars, n, owner, ends) of every prefix of the stretches: length, last text's length, members, smallest
    member, and members that end there."""
    reach_package(cut.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()) for name, values in local_nodes(held).items()})

        for batch in batches:
            names = batch.schema.names
            turns = batch.column(names.index("turns"))
            flat = turns.flatten()
            depth, e1, e2, chars = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            elements = np.stack([e1, e2], axis=1) if len(e1) else np.zeros((0, 2), np.int64)
            edges = np.concatenate([[0], np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            c, x1, x2, length = (batch.column(names.index(k)).to_pylist() for k in ("c", "x1", "x2", "length"))
            for row in range(batch.num_rows):
                a, b = edges[row], edges[row + 1]
                held.append((c[row], x1[row], x2[row], depth[a:b], elements[a:b], chars[a:b], int(depth[b - 1] == length[row])))
                size += int(b - a)
                if size >= TRIE_TURNS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    local = cut.mapInArrow(run, NODES)
    return local.groupBy("k1", "k2").agg(
        F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("n").alias("n"), F.min("least").alias("owner"),
        F.sum("ends").alias("ends"))


def paths(cut: DataFrame) -> DataFrame:
    """(c, depth, k1, k2): every prefix of every stretch with its fingerprint."""
    reach_package(cut.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                elements = np.array([(t["e1"], t["e2"]) for t in row["turns"]], np.int64)
                keys = prefix_keys(row["x1"], row["x2"], elements)[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), row["c"])), pa.array([t["depth"] for t in row["turns"]], pa.int64()),
                     pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1]))],
                    names=["c", "depth", "k1", "k2"])

    return cut.mapInArrow(run, "c long, depth long, k1 long, k2 long")


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) over the ids of the members that end at a node, from rows (k1, k2, c).

    The digest of a list has to be taken in order, so the sorted ids of a node stream through one task, which keeps
    the state of one digest and no ids.
    """
    sorted_rows = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()), pa.array([d for _, d in done])],
                names=["k1", "k2", "ends_sha256"])

        for batch in batches:
            k1, k2, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(c)], strict=True):
                if a == b:
                    continue
                key, part = (int(k1[a]), int(k2[a])), ",".join(map(str, c[a:b].tolist())).encode()
                if key == current:
                    state.update(b"," + part)
                    continue
                if current is not None:
                    done.append((current, state.hexdigest()))
                current, state = key, hashlib.sha256(part)
            if done:
                yield flush()
                done = []
        if current is not None:
            done.append((current, state.hexdigest()))
            yield flush()

    return sorted_rows.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def rest_of_chain(values: DataFrame, *columns: str) -> DataFrame:
    """`values` (owner, depth, columns) with each column replaced by its sum over the owner's rows from that depth on.

    A long chain is summed by stretches, and the stretches' sums in a second step.
    """
    rows = values.withColumn("s", F.expr(f"depth div {STRETCH}"))
    within = Window.partitionBy("owner", "s").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("owner").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    long_ones = rows.filter("s > 0").select("owner").distinct()
    sums = rows.join(long_ones, "owner", "left_semi").groupBy("owner", "s").agg(*[F.sum(c).alias(c) for c in columns])
    behind = sums.select("owner", "s", *[F.sum(c).over(later).alias(f"{c}_later") for c in columns])
    summed = rows.withColumns({c: F.sum(c).over(within) for c in columns}).join(behind, ["owner", "s"], "left")
    return summed.withColumns({c: F.col(c) + F.coalesce(f"{c}_later", F.lit(0)) for c in columns}).select(*values.columns)


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations."""
    mixed, lengths = rebuilt(turns_of(conversations, conv, turn, role, text))
    cut = settled(stretches(settled(mixed), lengths))
    below = trie_nodes(cut)
    root = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("owner"), F.count_if(F.col("length") == 0).alias("ends")).filter("n > 0")
    zero = F.lit(0).cast("long")
    nodes = settled(below.unionByName(root.select(
        zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), zero.alias("chars"), "n", "owner", "ends")))
    total = lengths.count()

    # Conversations that own a node own the one where they end.
    path = settled(paths(cut))
    last = path.join(lengths, "c").filter("depth = length").select("c", "k1", "k2").union(
        lengths.filter("length = 0").select("c", zero, zero))
    last = settled(last)
    # Ends have one row per conversation, nodes one per prefix: a prefix where a third of all end is split by adaptive execution.
    own_chain = settled(last.join(nodes.select("k1", "k2", "owner"), ["k1", "k2"]).filter("c = owner").select("c"))
    shown = path.join(own_chain, "c", "left_semi")
    hot = F.broadcast(nodes.filter(f"depth between 1 and {HOT_DEPTH} and n > {total} * {HOT_SHARE}").select("k1", "k2", "owner"))
    cold = nodes.select("k1", "k2", "owner")
    owned = shown.join(hot, ["k1", "k2"]).select("c", "depth", "owner").union(
        shown.join(hot, ["k1", "k2"], "left_anti").join(cold, ["k1", "k2"]).select("c", "depth", "owner"))
    first_owner = root.select("owner")
    through = owned.union(own_chain.join(F.broadcast(first_owner), F.col("c") != F.col("owner")).select("c", zero, "owner"))
    # A chain meets each other owner on its path once, last at the depth `depth`.
    met = settled(through.filter("owner <> c").groupBy("c", "owner").agg(F.max("depth").alias("depth")))
    start = met.groupBy("c").agg(F.max(F.struct("depth", "owner")).alias("up")).select("c", "up.depth", "up.owner")

    valued = nodes.withColumns({"saved": F.expr("(n - 1) * chars"), "leaves": F.expr("cast(n = ends as long)")})
    chains = valued.groupBy("owner").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.max("depth").alias("end"))
    chains = settled(chains.withColumnRenamed("owner", "c").join(
        start.select("c", F.col("depth").alias("up_depth"), F.col("owner").alias("up_owner")), "c", "left"))
    told = met.join(chains.select("c", "saved", "leaves"), "c").select("owner", "depth", "saved", "leaves", zero.alias("branches"))
    branching = chains.filter("up_owner is not null").select(
        F.col("up_owner").alias("owner"), F.col("up_depth").alias("depth"), zero.alias("saved"), zero.alias("leaves"), F.lit(1).cast("long").alias("branches"))
    extra = told.union(branching).groupBy("owner", "depth").agg(
        F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.sum("branches").alias("branches"))
    full = valued.join(extra, ["owner", "depth"], "left").select(
        "owner", "depth", "n", "k1", "k2", F.coalesce("branches", zero).alias("branches"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"))
    summed = rest_of_chain(full, "saved", "leaves")
    placed = summed.join(chains.select(F.col("c").alias("owner"), "end", "up_depth", "up_owner"), "owner").join(
        end_digests(last.select("k1", "k2", "c")), ["k1", "k2"], "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("up_depth") + 1, F.col("up_owner")).otherwise(F.col("owner"))
    return placed.select(
        F.col("owner").alias("conv_id"), "depth", parent.cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("branches") + F.expr("if(depth < end, 1, 0)")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
