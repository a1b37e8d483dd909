"""The trie of conversations' prefixes, with totals of every node's subtree, by time-forward processing.

Turns are put in order and numbered by a range sort, so that a conversation of any length spreads over tasks: each task knows the place of
a turn among its own, and conversations' counts per task, one row each, give the rest. A prefix is known by its depth and 128 bits that
its turns' digests, taken with their places, add up to; those are prefix sums of the same kind. A node is named by the
smallest conversation that has it and its depth.

Totals go from children to parents. Nodes are dealt to shards of about equal size by name alone. In a shard they are sorted by reverse level
order; a node takes from a priority queue what its children have sent and sends its own total to its parent, later in the same
order. Queues spill to disk. Roots, whose parents are in other shards, make a smaller tree across the shards: each
hangs on the root above its parent, and totals pass up it, over twice the distance in every round. What they then send into other shards goes
through the queues once more.

Defined cases: null roles and texts are empty; turns of equal number stand by role and text, rows that repeat are turns of their own;
rows without a conversation are left out; a conversation whose rebuilt form has no turns ends at the root; without conversations there is
no node; very long texts count by their digests; only the named columns are read, so that others can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.llm import shared

#: Messages that a queue holds in memory, and that it reads of a spilled run in one go.
IN_MEMORY, RUN_CHUNK = 200_000, 5_000
#: Nodes that a shard has, about.
SHARD_NODES = 200_000
#: Neighbours in name that share a shard: so many conversations, and so many levels.
NEAR, LEVELS = 20, 1024
#: Bytes of members' names that are hashed as one row.
CHUNK_BYTES = 1 << 16


class Queue:
    """Tuples, least first; beyond `most` in memory the greater half is written to disk as a sorted run."""

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.heap, self.runs = most, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            half = len(self.heap) // 2
            run = _read(_spilled(self.heap[half:]))
            del self.heap[half:]
            heapq.heappush(self.runs, (next(run), id(run), run))

    def least(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        item, name, run = self.runs[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, name, run))
        return item


def _spilled(items: list[tuple]):
    file = tempfile.TemporaryFile()
    for k in range(0, len(items), RUN_CHUNK):
        pickle.dump(items[k : k + RUN_CHUNK], file, protocol=5)
    file.seek(0)
    return file


def _read(file) -> Iterator[tuple]:
    with file:
        while True:
            try:
                chunk = pickle.load(file)
            except EOFError:
                return
            yield from chunk


# ---- turns and prefixes


def numbered(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns in order: conv, part (task that sorted it), place (from 1), d1 and d2 (digests of role and text) and words; and spans: conv,
    part, n (turns of it there) and total (turns of all)."""
    c = conversations
    rows = c.filter(c[key].isNotNull()).select(
        c[key].cast("long").alias("conv"), c[turn].alias("turn"), F.coalesce(c[role], F.lit("")).alias("role"), F.coalesce(c[text], F.lit("")).alias("text")
    )
    order = ["conv", "turn", "role", "text"]
    n = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    digests = (F.xxhash64(F.lit(seed), "role", "text").alias(f"d{seed}") for seed in (1, 2))
    rows = shared.written(rows.select("conv", *digests, words.alias("words"), F.monotonically_increasing_id().alias("at")), "turns")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    spans = rows.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("conv")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = shared.written(spans.withColumns({"before": before, "total": F.sum("n").over(own)}), "spans")
    placed = rows.join(spans, ["conv", "part"]).select("conv", "part", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "d1", "d2", "words")
    return placed, spans.select("conv", "part", "n", "total")


def rebuilt(placed: DataFrame, spans: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the conversation of their block of `every` names, h = crc32 of the name modulo
    `most`: turns (conv, part, depth, d1, d2, words; borrowed ones are of part -1), and heads (conv, and length: its turns)."""
    heads = spans.select("conv", "total").distinct()
    base = F.col("conv") - F.col("conv") % every
    heads = heads.select("conv", "total", base.alias("base"), (F.crc32(F.col("conv").cast("string")) % most).alias("h"))
    bases = spans.select(F.col("conv").alias("base"), F.col("total").alias("base_total")).distinct()
    heads = heads.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_total", F.lit(0))))
    heads = shared.written(heads.withColumn("length", F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "heads")
    # By conversation and task, so that a long conversation is many keys.
    cuts = spans.select("conv", "part").join(heads.select("conv", "h", "taken"), "conv")
    own = placed.join(cuts, ["conv", "part"]).filter("place > h").select("conv", "part", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "d1", "d2", "words")
    lent = placed.filter((F.col("conv") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv", "base").drop("part")
    borrowed = lent.join(heads.select("conv", "base", "taken"), "base").filter("place <= taken")
    borrowed = borrowed.select("conv", F.lit(-1).cast("long").alias("part"), F.col("place").alias("depth"), "d1", "d2", "words")
    return own.unionByName(borrowed), heads.select("conv", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns (conv, part, depth, d1, d2, words; a part's depths stand together, parts follow in order) with p1, p2: the prefix that ends
    there, and q1, q2: the one before. Written."""
    rows = shared.written(turns.withColumns({f"t{seed}": F.xxhash64(F.lit(seed), "depth", "d1", "d2") for seed in (1, 2)}).drop("d1", "d2"), "placed")
    sums = rows.groupBy("conv", "part").agg(F.bit_xor("t1").alias("c1"), F.bit_xor("t2").alias("c2"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv", "part", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("c1", "c2")))
    up_to = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({f"p{seed}": F.bit_xor(f"t{seed}").over(up_to) for seed in (1, 2)}).join(carried, ["conv", "part"])
    whole = {f"p{seed}": F.col(f"p{seed}").bitwiseXOR(F.col(f"c{seed}")) for seed in (1, 2)}
    before = {f"q{seed}": F.col(f"p{seed}").bitwiseXOR(F.col(f"t{seed}")) for seed in (1, 2)}
    return shared.written(local.withColumns(whole).withColumns(before).select("conv", "depth", "words", "p1", "p2", "q1", "q2"), "prefixes")


def ends(last: DataFrame) -> DataFrame:
    """depth, p1, p2 and the SHA-256 of the names of the conversations (conv) that end there, in order. Names are put together where a
    range sort has them; each prefix then reads a row for every CHUNK_BYTES, one after another."""
    node = ["depth", "p1", "p2"]
    n = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = last.select(*node, "conv").repartitionByRange(n, *node, "conv").sortWithinPartitions(*node, "conv")

    def together(batches):
        now, first, names, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*node, "conv")), strict=True):
                if names and (key != now or size > CHUNK_BYTES):
                    out.append((*now, first, ",".join(names)))
                    names, size = [], 0
                if not names:
                    now, first = key, conv
                names.append(str(conv))
                size += len(names[-1])
            if len(out) > 1000:
                yield _batch(out, [*node, "first", "names"])
                out = []
        if names:
            out.append((*now, first, ",".join(names)))
        if out:
            yield _batch(out, [*node, "first", "names"])

    def hashed(batches):
        now, digest, out = None, None, []
        for batch in batches:
            for *key, names in zip(*(batch.column(c).to_pylist() for c in (*node, "names")), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(names.encode())
                else:
                    digest.update(f",{names}".encode())
            if len(out) > 1000:
                yield _batch(out, [*node, "ends_sha256"])
                out = []
        if now is not None:
            out.append((*now, digest.hexdigest()))
            yield _batch(out, [*node, "ends_sha256"])

    chunks = ordered.mapInArrow(together, "depth bigint, p1 bigint, p2 bigint, first bigint, names string")
    chunks = chunks.repartition(n, *node).sortWithinPartitions(*node, "first")
    return chunks.mapInArrow(hashed, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column) for column in zip(*rows, strict=True)], names)


# ---- totals of subtrees


def upward(nodes: DataFrame) -> DataFrame:
    """conv, depth, leaves and saved of every node's subtree in its shard. nodes: shard, conv, depth, parent, home (whether the parent is
    in the same shard), leaves and saved (of the node itself, and what came from elsewhere)."""
    ordered = nodes.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "conv")

    def run(batches):
        queue = Queue()
        for batch in batches:
            out = []
            for conv, depth, parent, home, leaves, saved in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "parent", "home", "leaves", "saved")), strict=True):
                while (message := queue.least()) is not None and message[0] == -depth and message[1] == conv:
                    queue.pop()
                    leaves += message[2]
                    saved += message[3]
                if home:
                    queue.push((1 - depth, parent, leaves, saved))
                out.append((conv, depth, leaves, saved))
            if out:
                yield _batch(out, ["conv", "depth", "leaves", "saved"])

    return ordered.select("conv", "depth", "parent", "home", "leaves", "saved").mapInArrow(run, "conv bigint, depth bigint, leaves bigint, saved bigint")


def downward(nodes: DataFrame) -> DataFrame:
    """conv, depth and the name of the root above every node in its shard (root_conv, root_depth), by level order."""
    ordered = nodes.repartition("shard").sortWithinPartitions("shard", "depth", "parent", "conv")

    def run(batches):
        queue, shard = Queue(), None
        for batch in batches:
            out = []
            for of, conv, depth, parent, home in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv", "depth", "parent", "home")), strict=True):
                if of != shard:
                    queue, shard = Queue(), of
                root = conv, depth
                if home:
                    # Parents stay at the head until their last child has passed.
                    while (message := queue.least())[:2] != (depth - 1, parent):
                        queue.pop()
                    root = message[2:]
                queue.push((depth, conv, *root))
                out.append((conv, depth, *root))
            if out:
                yield _batch(out, ["conv", "depth", "root_conv", "root_depth"])

    return ordered.select("shard", "conv", "depth", "parent", "home").mapInArrow(run, "conv bigint, depth bigint, root_conv bigint, root_depth bigint")


def across(roots: DataFrame) -> DataFrame:
    """Totals of the tree of roots: conv, depth, leaves and saved of all roots that hang on each, itself included. roots: conv, depth, up_conv
    and up_depth (the root it hangs on, null at the top), leaves and saved. After k rounds a root has what is less than 2**k below
    it, and knows the root 2**k above it."""
    now = roots
    while not now.filter("up_conv IS NOT NULL").isEmpty():
        sums = now.filter("up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = now.select(F.col("conv").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("up_conv").alias("next_conv"), F.col("up_depth").alias("next_depth"))
        after = now.join(above, ["up_conv", "up_depth"], "left").join(sums, ["conv", "depth"], "left")
        plus = (F.col(a) + F.coalesce(b, F.lit(0)) for a, b in (("leaves", "l"), ("saved", "s")))
        now = shared.written(after.select("conv", "depth", F.col("next_conv").alias("up_conv"), F.col("next_depth").alias("up_depth"), *(x.alias(n) for x, n in zip(plus, ("leaves", "saved"), strict=True))), "roots")
    return now.select("conv", "depth", "leaves", "saved")


def totals(nodes: DataFrame, shards: int) -> DataFrame:
    """conv, depth, leaves and saved of every node's subtree. nodes: conv, depth, parent (its conv; null at depth 0), leaves and saved of the
    node itself."""
    shard = lambda conv, depth: F.pmod(F.xxhash64(F.floor(F.col(conv) / NEAR), F.floor(depth / LEVELS)), F.lit(shards))
    home = (F.col("depth") > 0) & (shard("conv", F.col("depth")) == shard("parent", F.col("depth") - 1))
    nodes = shared.written(nodes.select("conv", "depth", "parent", "leaves", "saved", shard("conv", F.col("depth")).alias("shard"), F.coalesce(home, F.lit(False)).alias("home")), "nodes")
    sent = nodes.filter("NOT home").select("conv", "depth", "parent").join(upward(nodes), ["conv", "depth"])
    sent = shared.written(sent.withColumn("to_depth", F.col("depth") - 1), "sent")
    above = downward(nodes).select(F.col("conv").alias("parent"), F.col("depth").alias("to_depth"), F.col("root_conv").alias("up_conv"), F.col("root_depth").alias("up_depth"))
    roots = shared.written(sent.join(above, ["parent", "to_depth"], "left").select("conv", "depth", "up_conv", "up_depth", "leaves", "saved"), "roots")
    whole = across(roots)
    arrived = sent.filter("depth > 0").select("conv", "depth", "parent", "to_depth").join(whole, ["conv", "depth"])
    arrived = arrived.groupBy(F.col("parent").alias("conv"), F.col("to_depth").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    fed = nodes.join(arrived, ["conv", "depth"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))})
    return upward(fed.drop("l", "s"))


def trie(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations: conv_id and depth, which name it, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. turns and heads: of rebuilt(), or of whole conversations in the same form."""
    every = prefixes(turns)
    node = ["depth", "p1", "p2"]
    known = every.groupBy(*node).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("q1", "q2", "words")))
    zero = F.lit(0).cast("long")
    top = heads.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0").withColumns({c: zero for c in (*node, "q1", "q2", "words")})
    known = shared.written(known.unionByName(top), "known")
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))
    linked = shared.written(known.join(parents, ["depth", "q1", "q2"], "left"), "linked")
    children = linked.filter("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    linked = shared.written(linked.join(children, ["conv", "depth"], "left").fillna(0, ["n_children"]), "linked")
    own = linked.select("conv", "depth", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    count = linked.count()
    shards = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // SHARD_NODES))
    found = linked.join(totals(own, shards), ["conv", "depth"])
    last = every.join(heads, "conv").filter("depth = length").select(*node, "conv")
    last = last.unionByName(heads.filter("length = 0").select(*(zero.alias(c) for c in node), "conv"))
    found = found.join(ends(last), node, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
