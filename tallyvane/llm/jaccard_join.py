"""Join of near-duplicate texts: sets of five-word shingles whose Jaccard similarity is 0.8 or more.

Texts of equal set form one node, known by a 64-bit hash of the set; copies collapse before anything is paired.

Of similar sets each lacks at most a fifth of the other's shingles, so floor(n / 5) + 1 shingles of a set of n, a prefix,
hold a common one. The prefix here is extended: all shingles whose hash is below a fixed share of the hash range (all of
them for small sets), so that both sets of a pair look at the same part of the range. A shingle's class is how many nodes
hold it:

* rare ones (up to RARE nodes) are indexed singly: a shingle's list of nodes is a block of candidates;
* frequent ones are indexed as 2-token combinations. They fall by hash into as many groups as the extension allows; a group
  of c shingles of which a partner has at most one lacks c - 1, so if the rare shingles and the (c - 1) of all groups make
  up a prefix, a similar set shares a rare shingle or two of one group. A set whose rare shingles suffice indexes no
  combinations, which is why a passage that many texts share makes no candidates of them.

A set whose groups don't suffice (chance made its part of the range too small) is indexed by its frequent shingles singly
among sets of that kind. For sets of 100 shingles and more the extension leaves a chance below 1e-8 that a set has less
than a prefix in its part of the range at all; sets of a tier in which one has are all indexed by the whole range.

Candidates are verified on whole sets, in rounds, each of which leaves out what one component already holds:

1. all pairs of a block of rare shingles; of a block of combinations each node with the one whose shingles most nodes hold;
2. of the nodes of blocks that have several components, by shingles ranked anew among just these: each with the centre of each
   shingle of its prefix;
3. all that may be similar by those ranks. What a set holds alone, or only its component, comes first and pairs with nothing, so a
   changed copy that isn't similar to its original meets only those that share some of its changes.

No link between components is lost, nothing is capped; work follows the changes that texts share, not the square of a group.

Defined cases: texts of fewer than five words are one shingle, the whole sequence; null texts and texts without words (empty ones,
white space) are empty sets and linked with nothing; rows of equal doc_id are separate, rows that repeat are links of one
another; a null doc_id is never the smallest unless all are; very long texts are cut into words a block at a time and their sets
are taken whole. No tie is left open: nodes of equal odd go by their hash, components by the smallest key. Only the key and the text are
read, so other columns, of whatever names, neither reach the result nor clash. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm import shared
from tallyvane.llm.bpe import blocks
from tallyvane.llm.components import components
from tallyvane.llm.words import SPACED, hash_of, mixed, utf8, windows, words

SHINGLE = 5
#: Nodes that hold a shingle of the rare class at most.
RARE = 8
#: Parts of the range of sizes: least and most shingles of a set, and the share of the hash range looked at. They overlap by
#: the quarter that similar sets may differ in size.
TIERS = ((4, 125, 1.0), (100, 500, 0.5), (400, 1 << 60, 0.4))
#: Bytes of text that are cut into shingles at a time: where each row stands for itself, and where a block's copies are sent once.
TEXT_BYTES, BLOCK_BYTES = 2 << 20, 4 << 20
#: Shingles of all rows for each part of the hash range that a task meets at a time.
PART_SHINGLES = 8_000_000
#: Bytes of a node, its n, tier and c on the way to a part.
HEAD_BYTES = (8, 4, 1, 4)
#: Sets that may have partners in other components: how often those with too little in common with others are left out, and the
#: step between classes of sizes that are paired.
PASSES, SIZE_STEP = 3, 1.05
#: Bits of the filter of nodes whose sets are needed: so many for each node, up to a fixed most. A filter that
#: is too small lets more sets through, to a join that drops them.
FILTER_BITS, FILTER_MOST = 16, 1 << 27


def sets(texts: list[bytes | None]):
    """For each text its distinct shingles' hashes in ascending order, and the set's hash (0: empty)."""
    w = words(texts, SPACED, lower=True)
    shingle = windows(w.hash, SHINGLE)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.unique(shingle[a : b - SHINGLE + 1])
        elif b > a:
            own = np.array([hash_of(w.hash[a:b])], np.uint64)
        else:
            own = np.empty(0, np.uint64)
        yield own, np.int64(np.uint64(hash_of(own)).astype(np.int64))


def prefix(n):
    """Shingles of a set of n, one of which at least is in any similar set."""
    return n // 5 + 1


def size_steps() -> np.ndarray:
    """Bounds of classes of sizes: similar sets are of the same class or of neighbouring ones."""
    steps = [1]
    while steps[-1] < 1 << 50:
        steps.append(max(steps[-1] + 1, steps[-1] * 5 // 4 + 1))
    return np.array(steps)


STEPS = size_steps()


def looked_at(own: np.ndarray, share: float) -> np.ndarray:
    """The shingles of a set in the part of the hash range that its tier looks at."""
    return own if share == 1.0 else own[: np.searchsorted(own, np.uint64(int(share * 2**64)))]


def groups_of(share: float, step: int) -> int:
    """Number of groups that frequent shingles of a tier's sets fall into, for the class of sizes."""
    low = int(STEPS[step])
    if share == 1.0:
        return max(1, int(0.4 * low))
    return max(1, int((share - 0.2) * low - 1 - 3 * (share * (1 - share) * low) ** 0.5))


def packed(numbers: np.ndarray, width: int) -> bytes:
    """The lowest bytes of numbers that are not negative, all first bytes first: those that are mostly equal take no room in a compressed shuffle."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(blob: bytes, at: int, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, width * count, at).reshape(width, count).T
    return out.view("<u8").ravel()


def nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (the key), node, n, the size of its set, and short, the number of its first tier whose part of the range holds less than a
    prefix of it (-1: none), for every row."""
    rows = docs.select(docs[key].alias("doc"), docs[text].alias("text"))

    def lacking(own: np.ndarray) -> int:
        n = len(own)
        return next((k for k, (low, high, share) in enumerate(TIERS) if low <= n <= high and len(looked_at(own, share)) < prefix(n)), -1)

    def run(batches):
        for table in blocks(batches, "text", TEXT_BYTES):
            shared.give_back()
            found = [(node, len(own), lacking(own)) for own, node in sets(utf8(table.column("text").combine_chunks()))]
            node, n, short = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            done = pa.Table.from_arrays([table.column("doc"), pa.array(node), pa.array(n), pa.array(short)], names=["doc", "node", "n", "short"])
            yield from done.combine_chunks().to_batches()

    return shared.written(rows.mapInArrow(run, f"doc {docs.schema[key].dataType.simpleString()}, node long, n long, short long"), "jaccard-nodes")


def postings(docs: DataFrame, text: str, shingles: int, shares: list[float]) -> DataFrame:
    """Rare blocks (kind 0: block, node) and frequent shingles (kind 1: shingle as block, node), with n, the tier, c, the number of
    the set's shingles that the tier looks at, and held, the number of nodes that hold the shingle. Parts of the hash range are met
    one by one; their number follows the number of shingles of all rows. A part has the node of each of its shingles, once for
    those of a set, so that more parts than needed are more bytes shuffled: at most a node for each shingle."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2, shingles // PART_SHINGLES)

    def send(batches):
        for table in blocks(batches, "text", BLOCK_BYTES):
            seen: dict[tuple[int, int], int] = {}
            head, tokens, owner = [], [], []
            for own, node in sets(utf8(table.column("text").combine_chunks())):
                n = len(own)
                for tier, ((low, high, _), share) in enumerate(zip(TIERS, shares, strict=True)):
                    if not low <= n <= high or (int(node), tier) in seen:
                        continue
                    part = looked_at(own, share)
                    seen[int(node), tier] = len(head)
                    tokens.append(mixed(part, 20 + tier))
                    owner.append(np.full(len(part), len(head), np.int64))
                    head.append((node, n, tier, len(part)))
            shared.give_back()
            if not head:
                continue
            token, owner = np.concatenate(tokens), np.concatenate(owner)
            del tokens
            part = (token % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            token, owner, part = token[by] >> np.uint64(24), owner[by], part[by]
            table_of = np.array(head, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                # Tokens of a part stand in the order of their sets.
                first = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
                heads, count = table_of[owner[a:b][first]], np.diff(np.append(first, b - a))
                blob = b"".join([packed(np.array([b - a, len(first)]), 8), *(packed(heads[:, k], width) for k, width in enumerate(HEAD_BYTES)), packed(count, 4), packed(token[a:b], 5)])
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        shared.give_back()
        part = table.column("part")[0].as_py()
        heads, tokens, owners, shift = [], [], [], 0
        for blob in table.column("blob").to_pylist():
            m, u = unpacked(blob, 0, 2, 8).tolist()
            at, columns = 16, []
            for width in (*HEAD_BYTES, 4):
                columns.append(unpacked(blob, at, u, width).view(np.int64))
                at += width * u
            heads.append(np.stack(columns[:-1], axis=1))
            tokens.append(unpacked(blob, at, m, 5))
            owners.append(np.repeat(np.arange(shift, shift + u), columns[-1]))
            shift += u
        head, token, owner = np.concatenate(heads), np.concatenate(tokens), np.concatenate(owners)
        del heads, tokens, owners
        # A node that several blocks sent counts once.
        head, same = np.unique(head, axis=0, return_inverse=True)
        owner = same.ravel()[owner]
        by = np.lexsort((owner, token))
        token, owner = token[by], owner[by]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
        token, owner = token[new], owner[new]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(begin, len(token)))
        often = np.repeat(size > RARE, size)
        rare = (size > 1) & (size <= RARE)
        # Equal lists of nodes are one block.
        name = np.add.reduceat(mixed(head[owner, 0].view(np.uint64), 9), begin) + mixed(head[owner[begin], 2], 13)
        pick = np.unique(np.where(rare, name, 0), return_index=True)[1]
        pick = pick[rare[pick]]
        inner = np.repeat(np.arange(len(pick)), size[pick])
        at = np.repeat(begin[pick], size[pick]) + np.arange(len(inner)) - np.repeat(np.cumsum(size[pick]) - size[pick], size[pick])
        block = np.concatenate([name[pick][inner], mixed(token[often], 31) + np.uint64(part)]).view(np.int64)
        source = head[np.concatenate([owner[at], owner[often]])]
        held = np.concatenate([size[pick][inner], np.repeat(size, size)[often]])
        kind = np.concatenate([np.zeros(len(at), np.int32), np.ones(int(often.sum()), np.int32)])
        return pa.Table.from_arrays([pa.array(kind), pa.array(block), *(pa.array(source[:, k]) for k in range(4)), pa.array(held)], names=["kind", "block", "node", "n", "tier", "c", "held"])

    sent = docs.select(docs[text].alias("text")).mapInArrow(send, "part int, blob binary")
    met = sent.groupBy("part").applyInArrow(meet, "kind int, block long, node long, n long, tier long, c long, held long")
    return shared.written(met, "jaccard-postings")


def combinations(frequent: DataFrame, shares: list[float]) -> DataFrame:
    """Blocks (kind 2) of two frequent shingles of a group, and single frequent shingles (kind 3) of sets whose groups don't
    suffice; both with node, n, odd (the mean of one by the number of nodes that hold a shingle) and used: whether the block is of
    the groups that already make up the set's prefix, in the class of sizes that is its own."""

    def run(batches):
        for batch in batches:
            out = []
            columns = (batch.column(k).to_pylist() for k in ("node", "n", "tier", "c", "tokens", "odd"))
            for node, n, tier, c, tokens, odd in zip(*columns, strict=True):
                rare = c - len(tokens)
                if rare >= prefix(n):
                    continue
                odd = (rare + odd) / c
                token = np.array(tokens, np.int64).view(np.uint64)
                own = int(np.searchsorted(STEPS, n, side="right")) - 1
                for step in (own, own + 1):
                    group = (mixed(token, 100 + step) % np.uint64(groups_of(shares[tier], step))).astype(np.int64)
                    by = np.lexsort((token, group))
                    group, sorted_ = group[by], token[by]
                    count = np.bincount(group)
                    if step == own and rare + int((count - 1).clip(0).sum()) < prefix(n):
                        out.append((np.full(len(token), 3, np.int32), mixed(token, 7).view(np.int64), node, n, odd, np.ones(len(token), bool)))
                    place = np.arange(len(group)) - (np.cumsum(count) - count)[group]
                    # The first groups that make up a prefix, in the class of sizes that is the set's own.
                    before = rare + np.cumsum((count - 1).clip(0)) - (count - 1).clip(0)
                    used = (before < prefix(n))[group] & (step == own)
                    for gap in range(1, int(count.max())):
                        left = np.flatnonzero(place + gap < count[group])
                        pair = mixed(sorted_[left], 200 + step) + mixed(sorted_[left + gap], 300 + step) * np.uint64(3) + np.uint64(tier)
                        out.append((np.full(len(pair), 2, np.int32), mixed(pair, 3).view(np.int64), node, n, odd, used[left]))
            if out:
                sizes = [len(x[1]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([x[0] for x in out])),
                        pa.array(np.concatenate([x[1] for x in out])),
                        *(pa.array(np.repeat(np.array([x[k] for x in out]), sizes)) for k in (2, 3, 4)),
                        pa.array(np.concatenate([x[5] for x in out])),
                    ],
                    names=["kind", "block", "node", "n", "odd", "used"],
                )

    per_set = frequent.groupBy("node", "n", "tier", "c").agg(F.collect_list("block").alias("tokens"), F.sum(1 / F.col("held")).alias("odd"))  # no more than a text's words
    return per_set.mapInArrow(run, "kind int, block long, node long, n long, odd double, used boolean")


def places(node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each node in a filter."""
    at = mixed(node.view(np.uint64), 41) % np.uint64(bits)
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def needed(keys: DataFrame):
    """A filter that every needed node passes, and its bits; it has FILTER_MOST bits at most, whatever the nodes are."""
    bits = 1 << min(FILTER_MOST.bit_length() - 1, max(12, (keys.count() * FILTER_BITS).bit_length()))

    def mark(batches):
        words_ = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            word, bit = places(batch.column("node").to_numpy(), bits)
            np.bitwise_or.at(words_, word, bit)
        some = np.flatnonzero(words_)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words_[some].view(np.int64))], names=["word", "bits"])

    marked = keys.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = marked.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out, bits


def passing(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose node may be in `keys`, found before anything is shuffled; nodes that are in it all stay."""
    passes, bits = needed(keys)
    held = rows.sparkSession.sparkContext.broadcast(passes)

    @F.arrow_udf("boolean")
    def passed(node: pa.Array) -> pa.Array:
        word, bit = places(node.to_numpy(zero_copy_only=False), bits)
        return pa.array(held.value[word] & bit != 0)

    return rows.filter(passed("node"))


def tokens_of(docs: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """node, tokens (its whole set), part (what of the set is in a quarter of the hash range, 31 bits of each, equal ones once), q (how
    many tokens are in that quarter) and n (how many in all) of the nodes in `keys`; a node comes once of each partition that has it."""
    passes, bits = needed(keys)
    held = docs.sparkSession.sparkContext.broadcast(passes)

    def load(batches):
        done: set[int] = set()
        for table in blocks(batches, "text", TEXT_BYTES):
            shared.give_back()
            found = {}
            for own, node in sets(utf8(table.column("text").combine_chunks())):
                if len(own) and int(node) not in done:
                    found[int(node)] = own
            node = np.fromiter(found, np.int64, len(found))
            word, bit = places(node, bits)
            node = node[held.value[word] & bit != 0].tolist()
            done.update(node)
            whole = [found[k] for k in node]
            quarter = [own[: np.searchsorted(own, np.uint64(1 << 62))] for own in whole]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node, pa.int64()),
                    pa.array([own.view(np.int64) for own in whole], pa.list_(pa.int64())),
                    pa.array([np.unique(own >> np.uint64(31)).astype(np.int32) for own in quarter], pa.list_(pa.int32())),
                    pa.array([len(own) for own in quarter], pa.int32()),
                    pa.array([len(own) for own in whole], pa.int32()),
                ],
                names=["node", "tokens", "part", "q", "n"],
            )

    return docs.select(docs[text].alias("text")).mapInArrow(load, "node long, tokens array<long>, part array<int>, q int, n int")


def possible(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that a quarter of the hash range leaves possible: what two sets have in common there, and all of the smaller
    rest, must suffice. Only quarters of sets meet here, by 31 bits of each token; most pairs need no more. As tokens of a set may be
    equal in these bits, what they merge is added to what is common."""
    part = tokens.select("node", "part", "q", "n").dropDuplicates(["node"])  # copies in several partitions each bring their set
    right = pairs.join(part.select(F.col("node").alias("b"), F.col("part").alias("right"), F.col("q").alias("r"), "n"), "b")
    both = right.join(part.select(F.col("node").alias("a"), F.col("part").alias("left"), F.col("q").alias("l"), F.col("n").alias("m")), "a")
    merged, rest = F.col("l") - F.size("left"), F.least(F.col("m") - F.col("l"), F.col("n") - F.col("r"))
    return both.filter((F.size(F.array_intersect("left", "right")) + merged + rest) * 9 >= (F.col("m") + F.col("n")) * 4).select("a", "b")


def verified(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar, by their whole sets: tokens of each node."""
    right = pairs.join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("right")), "b")
    both = right.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("left")), "a")
    common = F.size(F.array_intersect("left", "right"))
    return shared.written(both.filter(100 * common >= 80 * (F.size("left") + F.size("right") - common)).select("a", "b"), "jaccard-links")


def shared_between(sets: DataFrame) -> DataFrame:
    """node, n, comp, ranked: (df, token) in ascending order for each token that a set of another component holds, too, and light, the
    sum of one by the number of sets that hold such a token.

    Of similar sets of two components each has at least 0.8 of its tokens in the other; sets that lack so much are left out."""
    rows = sets.select("node", "n", "comp", F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    left = rows.join(held.filter("low <> high").select("token", "df"), "token")
    ranked = F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked")  # no more than a text's words
    back = left.groupBy("node", "n", "comp").agg(ranked, F.sum(1 / F.col("df")).alias("light"))
    return back.filter(F.size("ranked") * 5 >= F.col("n") * 4)


def size_class(n):
    return F.floor(F.log(n) / F.log(F.lit(SIZE_STEP)))


def prefixes(sets: DataFrame) -> DataFrame:
    """Of the nodes in `sets` (node, n, comp, tokens) that may have partners in other components: one row per token to pair by, with
    node, n, comp, rest, the tokens from it on, and odd, the mean of one by the number of sets that hold a token.

    Tokens that no other component holds are no pair's. Sets that have too few others are dropped, which leaves more such
    tokens, and again. Then each set's tokens are ranked anew, those of few sets first, after the ones that are no pair's.
    A similar set has one in common that leaves 0.8 of the set."""
    for _ in range(PASSES - 1):
        sets = shared_between(sets).select("node", "n", "comp", F.col("ranked.token").alias("tokens"))
    # The prefix is cut off before its tokens become rows.
    ranked, s = shared_between(sets), F.size("ranked")
    cut = F.slice("ranked", F.lit(1), s - F.ceil(F.col("n") * 4 / 5).cast("int") + 1).alias("prefix")
    odd = ((F.col("n") - s + F.col("light")) / F.col("n")).alias("odd")
    ranked = shared.written(ranked.select("node", "n", "comp", odd, s.alias("s"), cut), "jaccard-ranked")
    rows = ranked.select("node", "n", "comp", "odd", "s", F.posexplode("prefix"))
    return rows.select("node", "n", "comp", "odd", F.col("col.token").alias("token"), (F.col("s") - F.col("pos")).alias("rest"))


def centres(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the least odd one that each of its tokens has, most likely the one that copies were made of."""
    head = rows.groupBy("token").agg(F.min(F.struct("odd", "node", "n", "comp")).alias("h"))
    stars = rows.join(head, "token").filter(F.col("comp") != F.col("h.comp")).filter(similar_sizes("n", "h.n"))
    return stars.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()


def prefix_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar, by the prefixes `rows`.

    Sets of m and n are similar if they have t = 4/9 * (m + n) in common, so the first common token leaves t or more in both: the more
    of a set is its own, the fewer of the tokens that its whole group holds are left to pair by, and only with sets of those
    sizes for which they are in time."""
    size = rows.select("node", "comp").distinct().groupBy("comp").agg(F.count("*").alias("z"))
    rows = rows.join(size, "comp")
    # Of two components the smaller looks for partners in the larger; the largest that holds a token needn't.
    top = rows.groupBy("token").agg(F.max(F.struct("z", "comp")).alias("top"))
    most = F.least(F.floor(F.col("m") * 5 / 4), F.floor((F.col("after") * 9 - F.col("m") * 4) / 4))
    seek = rows.join(top, "token").filter(F.struct("z", "comp") < F.col("top"))
    seek = seek.select("token", F.col("node").alias("a"), F.col("n").alias("m"), F.col("comp").alias("x"), F.col("z").alias("y"), F.col("rest").alias("after"))
    seek = seek.filter(most * 5 >= F.col("m") * 4).withColumn("step", F.explode(F.sequence(size_class(F.col("m") * 4 / 5), size_class(most))))
    found = rows.select("token", F.col("node").alias("b"), "n", "comp", "z", "rest", size_class(F.col("n")).alias("step"))
    larger = (F.col("z") > F.col("y")) | ((F.col("z") == F.col("y")) & (F.col("comp") > F.col("x")))
    common = (F.col("m") + F.col("n")) * 4 <= F.least("after", "rest") * 9
    pairs = seek.join(found, ["token", "step"]).filter(larger & similar_sizes("m", "n") & common)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows with each node's component; a node without links is its own."""
    return rows.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def similar_sizes(a: str, b: str):
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: key, n_shingles and component_id, the smallest key reachable by links, itself included."""
    rows = nodes(docs, key, text)
    # Chance can leave a set less than a prefix in its part of the range; its tier then looks at the whole range.
    short = {r.short for r in rows.select("short").distinct().collect()}  # one row per tier at most
    shares = [1.0 if k in short else share for k, (_, _, share) in enumerate(TIERS)]
    found = postings(docs, text, rows.agg(F.sum("n")).first()[0] or 0, shares)
    paired = combinations(found.filter("kind = 1"), shares)
    rare = found.filter("kind = 0").select("kind", "block", "node", "n", F.lit(0.0).alias("odd"), F.lit(True).alias("used"))
    members = shared.written(rare.unionByName(paired).groupBy("kind", "block", "node", "n").agg(F.min("odd").alias("odd"), F.max("used").alias("used")), "jaccard-blocks")
    shared.remove(found)

    # Of few nodes all are compared, of many first all of a block with one node: of copies with changes most likely the one that they
    # were made of, as most nodes hold its shingles. Of two similar sets one makes sure of a common block among those that it uses.
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    few = members.filter("kind = 0").select("block", "node", "n")
    few = few.select("block", F.col("node").alias("a"), F.col("n").alias("m")).join(few.withColumnRenamed("node", "b"), "block").filter("a < b").filter(similar_sizes("m", "n"))
    many = members.filter("kind > 0")
    heads = many.groupBy("block").agg(F.min(F.struct("odd", "node", "n")).alias("h"), F.min("node").alias("low"), F.max("node").alias("high"), F.max("used").alias("used"))
    heads = heads.filter("used and low <> high").select("block", F.col("h.node").alias("a"), F.col("h.n").alias("m"))
    stars = heads.join(many.withColumnRenamed("node", "b"), "block").filter(F.col("a") != F.col("b")).filter(similar_sizes("n", "m"))
    pairs = shared.written(few.select(a, b).unionByName(stars.select(a, b)).distinct(), "jaccard-stars")
    ends = lambda rows: rows.select(F.col("a").alias("node")).unionByName(rows.select(F.col("b").alias("node"))).distinct()
    tokens = shared.written(tokens_of(docs, text, ends(pairs)), "jaccard-wanted")
    likely = shared.written(possible(tokens, pairs), "jaccard-likely")
    links = verified(passing(tokens.select("node", "tokens"), ends(likely)).dropDuplicates(["node"]), likely)
    shared.remove(tokens, pairs, likely)
    label = components(links)

    # Then those of a block that aren't in one component yet: with the centre of what they share, and at last all that may be similar.
    known = shared.written(labelled(many, label), "jaccard-known")
    several = known.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("used").alias("used")).filter("used and low <> high").select("block")
    open_ = shared.written(known.join(several, "block").select("node", "n", "comp").distinct(), "jaccard-open")
    shared.remove(members, known)
    sets_ = shared.written(tokens_of(docs, text, open_).select("node", "tokens").dropDuplicates(["node"]).join(open_, "node"), "jaccard-sets")
    tokens, rows_ = sets_.select("node", "tokens"), prefixes(sets_)
    for partners in (centres, prefix_pairs):
        more = verified(tokens, shared.written(partners(rows_), "jaccard-pairs"))
        if not more.isEmpty():
            links = links.unionByName(more)
            label = components(links)
            rows_ = labelled(rows_.drop("comp"), label)

    rows = rows.join(label.withColumnRenamed("comp", "known"), "node", "left").withColumn("comp", F.coalesce("known", "node"))
    least = rows.filter("n > 0").groupBy("comp").agg(F.min("doc").alias("component_id"))
    full = rows.filter("n > 0").join(least, "comp").select("doc", "n", "component_id")
    empty = rows.filter("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    return full.unionByName(empty).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")
