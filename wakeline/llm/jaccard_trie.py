"""Jaccard join of word n-gram sets by tries that are spread over the cluster.

The grams of a document, as 64-bit hashes in ascending order (one order for the corpus), are
a path in a trie. Two sets of sizes a and b that link differ in at most
``(a + b)(100 - p) / (100 + p)`` grams, so of one part more than that, cut by hash range,
some part holds the same grams in both: with the order rotated to start there, the two paths
share the whole first part. A part's signature therefore names a subtree that holds both.

Parts are more than needed by a spare r, so a pair shares r + 1 of them at least. A set may
therefore leave out its r most frequent parts, and a set of which no more than r parts occur
elsewhere links with nothing: texts that only share passages go no further than that.

1. Every document gives its set hash (equal sets are one node) and the signatures of its
   parts. A batch of documents sends one row for each signature on, so the rows of one that
   all documents share grow with the batches; the others of the batch follow it by a join
   that can split them.
2. Signatures found in several nodes are ranked per node, the spare ones dropped, and nodes
   that still share a signature form the star of the least of them; stars that overlap much
   become one family. Stars and families are cut into blocks of about ``BLOCK`` grams, each
   with the centre; a block is one trie.
3. In a block all sets walk the trie together. The overlap along a shared path is counted
   once, and a subtree is left when the overlap so far and the lengths that remain, in the set
   and below the node, cannot reach what the smallest set below needs. Subtrees that are
   already one component with the walker are left too. A leaf gives the exact overlap.
4. Stars of several blocks whose nodes are not one component after that are finished pair of
   blocks by pair of blocks, again by tries, for the pairs in different components only.

Links are never listed in full: a block gives at most one per node, enough for its
components. Every signature, node and block takes part; no caps.

Defined results: null and empty texts have no grams, link with nothing and are their own
component; so does a row without id (its component is null unless it has a copy with one);
repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm.components import components
from wakeline.llm.grouped import groups
from wakeline.llm.staging import staged, unused
from wakeline.llm.words import LOWER, Chunk, chunks, mix, sequences, span_hashes, words

BLOCK = 1 << 20
_U = np.uint64


def gram_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct grams of each text, ascending in both."""
    data = LOWER[chunk.data]
    lowered = chunk._replace(data=data)
    found = words(lowered)
    h = span_hashes(data, found.start, found.end)
    count = np.bincount(found.text, minlength=chunk.texts)
    first = np.cumsum(count) - count
    texts, grams = [], []
    for k in range(1, n + 1):
        if k < n:
            at = first[count == k]
        else:
            at = np.flatnonzero(found.text[: max(len(h) - n + 1, 0)] == found.text[n - 1 :])
        if len(at):
            grams.append(mix(sequences(h, k)[at] + _U(k)))
            texts.append(found.text[at])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, gram = np.concatenate(texts), np.concatenate(grams)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    return text[new], gram[new]


def size_classes(largest: int, percent: int) -> np.ndarray:
    """First sizes of the size classes; sets that link are in one class or in two next to each other."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(firsts[-1] * 100**3 // percent**3 + 1)
    return np.array(firsts, np.int64)


def class_parts(firsts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a class, and how many of them are spare.

    Without the spare ones there is one part more than any pair of the class, or of it and the
    next, can differ in; 0 where sets must be equal to link.
    """
    top = firsts[1:] - 1
    differ = (top + 100 * top // percent) * (100 - percent) // (100 + percent)
    spare = 2 + differ // 3
    return np.where(differ > 0, differ + 1 + spare, 0), spare


def signatures(
    text: np.ndarray, gram: np.ndarray, size: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, signature, and size class with parts to spare, of every part.

    Empty parts have no signature; as both sets of a pair may have them, each takes one off
    what a set can spare. A set with more empty parts than that names them, and spares none.
    """
    firsts = size_classes(int(size.max(initial=1)), percent)
    parts, spares = class_parts(firsts, percent)
    own = np.searchsorted(firsts, size, side="right") - 1
    out_text, out_sig, out_class = [], [], []
    for below in (0, 1):
        cls = own - below
        k = np.where((size > 0) & (cls >= 0), parts[np.maximum(cls, 0)], 0)
        if below:
            k = np.where(size <= 100 * (firsts[np.maximum(own, 0)] - 1) // percent, k, 0)
        use = k[text] > 0
        if not use.any():
            continue
        t, g = text[use], gram[use]
        part = ((g >> _U(32)) * k[t].astype(_U)) >> _U(32)
        begins = np.ones(len(t), bool)
        begins[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(begins)
        total = np.add.reduceat(mix(g), at)
        name = part[at] * _U(0xA24BAED4963EE407) + cls[t[at]].astype(_U) * _U(0x9FB21C651E98DF25)
        empty = k - np.bincount(t[at], minlength=len(size))
        spare = spares[np.maximum(cls, 0)] - empty
        kind = (cls << 32) + np.maximum(spare, 0)
        out_text.append(t[at])
        out_sig.append(mix(total + mix(name)))
        out_class.append(kind[t[at]])
        for d in np.flatnonzero((k > 0) & (spare < 0)):
            gone = np.setdiff1d(np.arange(k[d], dtype=_U), part[at][t[at] == d])
            name = gone * _U(0xA24BAED4963EE407) + cls[d : d + 1].astype(_U) * _U(0x9FB21C651E98DF25)
            out_text.append(np.full(len(gone), d))
            out_sig.append(mix(mix(name)))
            out_class.append(np.full(len(gone), kind[d]))
    if not out_text:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none
    return np.concatenate(out_text), np.concatenate(out_sig), np.concatenate(out_class)


def set_hashes(text: np.ndarray, gram: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each whole set, as a signed number."""
    h = np.zeros(len(size), np.uint64)
    at = np.flatnonzero(size)
    if len(gram):
        h[at] = np.add.reduceat(mix(gram), np.concatenate(([0], np.cumsum(size[at])))[:-1])
    return mix(h + size.astype(_U)).view(np.int64)


def _batch_signatures(texts: pa.Array, n: int, percent: int) -> tuple[np.ndarray, ...]:
    """By signature and node: signature, node, class, and at the first node of a signature
    how many nodes of the batch have it, 0 at the others."""
    parts = []
    for chunk in chunks(texts):
        text, gram = gram_sets(chunk, n)
        size = np.bincount(text, minlength=chunk.texts)
        owner, sig, kind = signatures(text, gram, size, percent)
        parts.append((sig.view(np.int64), set_hashes(text, gram, size)[owner], kind))
    none = np.zeros(0, np.int64)
    sig, node, kind = (np.concatenate([p[i] for p in parts] or [none]) for i in range(3))
    order = np.lexsort((node, sig))
    sig, node, kind = sig[order], node[order], kind[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node, kind = sig[new], node[new], kind[new]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(head)
    times = np.zeros(len(sig), np.int64)
    times[at] = np.diff(np.append(at, len(sig)))
    return sig, node, kind, times


def _describe(n: int) -> Callable:
    """Rows to their set size and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                text, gram = gram_sets(chunk, n)
                size = np.bincount(text, minlength=chunk.texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(chunk.first, chunk.texts),
                        pa.array(size.astype(np.int64)),
                        pa.array(set_hashes(text, gram, size)),
                    ],
                    names=["id", "n", "node"],
                )

    return run


def _part_rows(n: int, percent: int) -> Callable:
    """Signatures of a batch: one row each with its first node and how many nodes it has here
    (``times``), to be dealt by signature; and a row of 0 times for every other node, which
    is known to share it and is dealt by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, node, kind, times = _batch_signatures(batch.column("text"), n, percent)
            deal = np.where(times > 0, sig, mix((sig ^ node).view(_U)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (deal, sig, node, kind, times)], names=["deal", "sig", "node", "kind", "times"]
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature to those whose signature several nodes have: first nodes with
    the sum of times, others as they are.

    What is held back between batches is one signature: a row for each batch of documents
    that has it, at most.
    """
    names = ("sig", "node", "kind", "times")

    def passed(held: list[np.ndarray]) -> pa.RecordBatch:
        sig, node, kind, times = held
        head = np.ones(len(sig), bool)
        head[1:] = sig[1:] != sig[:-1]
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        total = np.add.reduceat(times, at)
        several = (np.minimum.reduceat(node, at) != np.maximum.reduceat(node, at)) | (np.maximum.reduceat(times, at) > 1)
        use = several[group]
        return pa.RecordBatch.from_arrays(
            [pa.array(x[use]) for x in (sig, node, kind, total[group])], names=names
        )

    held = None
    for batch in batches:
        new = [batch.column(c).to_numpy() for c in names]
        first = new[3] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[~first]) for x in new], names=names)
        new = [x[first] for x in new]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]):
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if last:
                yield passed([x[:last] for x in held])
            held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield passed(held)


def _sets(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                text, gram = gram_sets(chunk, n)
                size = np.bincount(text, minlength=chunk.texts)
                ends = np.concatenate(([0], np.cumsum(size))) * 8
                body = gram.astype(">u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(set_hashes(text, gram, size)),
                        pa.array([body[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                    ],
                    names=["node", "grams"],
                )

    return run


class Trie:
    """Ascending gram sets of a block as a compressed trie that all of them walk together.

    A node is ``(edge, depth at its end, smallest and largest set below, first and last
    member below, children)``; members are in lexicographic order. ``holders`` lists the
    members that hold each gram, one gram after the other.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        _, gram = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(gram, np.cumsum(self.size)[:-1])
        self.holders = np.repeat(np.arange(len(sets)), self.size)[np.argsort(gram, kind="stable")]
        self.held = np.bincount(gram)
        self.keys = np.repeat(np.arange(len(sets)), self.size) * len(self.held) + gram
        self.begin = np.cumsum(self.size) - self.size
        self.first = np.cumsum(self.held) - self.held
        shared = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            m = min(len(a), len(b))
            apart = np.flatnonzero(a[:m] != b[:m])
            shared.append(int(apart[0]) if len(apart) else m)
        self.shared = np.array(shared)

    def _node(self, lo: int, hi: int, depth: int) -> tuple[np.ndarray, int, list[tuple[int, int]]]:
        """Edge, depth at its end and the ranges of members of the children."""
        if hi - lo == 1:
            return self.sets[lo][depth:], int(self.size[lo]), []
        end = int(self.shared[lo + 1 : hi].min())
        cuts = [lo, *(lo + 1 + np.flatnonzero(self.shared[lo + 1 : hi] == end)).tolist(), hi]
        return self.sets[lo][depth:end], end, list(zip(cuts, cuts[1:]))

    def _overlaps(self, edge: np.ndarray) -> np.ndarray:
        """How many grams of an edge each member holds."""
        count = self.held[edge]
        before = np.cumsum(count) - count
        place = np.arange(int(count.sum())) + np.repeat(self.first[edge] - before, count)
        return np.bincount(self.holders[place], minlength=len(self.sets))

    def _passed(self, walkers: np.ndarray, gram: int) -> np.ndarray:
        """How many grams up to this one each walker holds."""
        return np.searchsorted(self.keys, walkers * len(self.held) + gram, side="right") - self.begin[walkers]

    def walk(self, percent: int, component: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Members and the walkers that link with each.

        ``component`` may change meanwhile: walkers leave a subtree that is all in their
        component, and one that cannot reach the overlap its smallest set asks for, given the
        overlap so far and the grams left to them and to the largest set below.
        """
        every = np.arange(len(self.sets))
        stack = [(0, len(self.sets), 0, every, np.zeros(len(every), np.int64))]
        while stack:
            lo, hi, depth, walkers, overlap = stack.pop()
            same = component[lo:hi]
            if (same == same[0]).all():
                stay = component[walkers] != same[0]
                walkers, overlap = walkers[stay], overlap[stay]
            if not len(walkers):
                continue
            edge, end, children = self._node(lo, hi, depth)
            left = self.size[walkers]
            if len(edge):
                overlap = overlap + self._overlaps(edge)[walkers]
                left = left - self._passed(walkers, int(edge[-1]))
            least, most = int(self.size[lo:hi].min()), int(self.size[lo:hi].max())
            reach = overlap + np.minimum(most - end, left)
            stay = (100 + percent) * reach >= percent * (self.size[walkers] + least)
            walkers, overlap = walkers[stay], overlap[stay]
            if children:
                stack.extend((a, b, end, walkers, overlap) for a, b in reversed(children) if len(walkers))
            elif len(walkers):
                yield lo, walkers


def link_block(nodes: list, sets: list[np.ndarray], labels: list, percent: int) -> list[tuple]:
    """Links between members that start in different components, at most one per member.

    ``labels``: members with equal labels are linked already.
    """
    order = sorted(range(len(nodes)), key=lambda i: sets[i].astype(">u8").tobytes())
    nodes, labels = [nodes[i] for i in order], [labels[i] for i in order]
    component = np.unique(np.array(labels), return_inverse=True)[1]
    links = []
    for i, found in Trie([sets[j] for j in order]).walk(percent, component):
        other, at = np.unique(component[found], return_index=True)
        fresh = other != component[i]
        links += [(nodes[i], nodes[j]) for j in found[at[fresh]]]
        component[np.isin(component, other)] = component[i]
    return links


def _blocks(percent: int) -> Callable:
    """Rows ``block, node, label, grams`` sorted by block to links; one block at a time."""

    def links_of(members: dict) -> pa.RecordBatch:
        nodes = list(members)
        sets = [np.frombuffer(members[x][1], ">u8").astype(np.uint64) for x in nodes]
        links = link_block(nodes, sets, [members[x][0] for x in nodes], percent)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("block", "node", "label", "grams")):
            members = {node: (label, grams) for _, node, label, grams in rows}
            if len(members) > 1:
                yield links_of(members)

    return run


def _joined_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the blocks ``members(block, node, label)``."""
    held = sets.withColumnRenamed("node", "_node")
    rows = members.join(held, F.col("node") == F.col("_node")).select("block", "node", "label", "grams")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", "node")
    return rows.mapInArrow(_blocks(percent), "u bigint, v bigint")


def _families(stars: DataFrame, block: int) -> DataFrame:
    """Stars that overlap put together, where that moves less than the stars do.

    The stars of a component of candidates become one family if its grams, times the blocks
    they take, are no more than the grams of its stars. Others stay stars, so a component that
    grows with the corpus costs no more than its stars.
    """
    label = staged(components(stars.select(F.col("pivot").alias("u"), F.col("node").alias("v"))))
    placed = stars.join(label.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
    moved = placed.groupBy("label").agg(F.sum("n").alias("by_star"))
    whole = placed.select("label", "node", "n").distinct().groupBy(F.col("label").alias("_l")).agg(F.sum("n").alias("grams"))
    cost = F.col("grams") * F.ceil(F.col("grams") / block)
    whole = staged(moved.join(whole, F.col("label") == F.col("_l")).where(cost <= F.col("by_star")).select("_l"))
    family = placed.join(whole, F.col("label") == F.col("_l"), "left")
    return family.select(F.coalesce("_l", "pivot").alias("pivot"), "node", "n").distinct()


def _finish(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between components of the stars that took several blocks.

    A star's components of a block or more are cut into blocks of their own, small ones are
    put together; every two blocks of different components meet, and blocks of small ones
    also meet themselves.
    """
    named = labels.withColumnRenamed("node", "_n")
    rows = staged(
        stars.join(named, F.col("node") == F.col("_n"), "left").select(
            "pivot", "node", "n", F.coalesce("label", "node").alias("label")
        )
    )
    sizes = rows.groupBy("pivot", "label").agg(F.sum("n").alias("size"))
    totals = sizes.groupBy(F.col("pivot").alias("_t")).agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum(F.when(F.col("size") < block, F.col("size")).otherwise(0)).alias("small"),
    )
    sizes = sizes.join(totals.where("parts > 1"), F.col("pivot") == F.col("_t"))
    sizes = staged(sizes.select(F.col("pivot").alias("_p"), F.col("label").alias("_l"), "size", "small"))
    big = F.col("size") >= block
    slot = F.when(big, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block))).otherwise(
        F.pmod(F.xxhash64("label"), F.ceil(F.col("small") / block))
    )
    cut = F.struct(F.when(big, F.col("label")).alias("of"), slot.alias("slot")).alias("cut")
    cuts = staged(
        rows.join(sizes, (F.col("pivot") == F.col("_p")) & (F.col("label") == F.col("_l"))).select("pivot", "node", "label", cut)
    )
    kinds = cuts.select("pivot", "cut").distinct()
    pairs = (
        kinds.join(kinds.withColumnsRenamed({"pivot": "_p", "cut": "other"}), F.col("pivot") == F.col("_p"))
        .where(
            "(cut < other and (cut.of is null or other.of is null or cut.of <> other.of))"
            " or (cut = other and cut.of is null)"
        )
        .select(
            F.xxhash64("pivot", "cut", "other").alias("block"),
            F.col("pivot").alias("_p"),
            F.explode(F.array_distinct(F.array("cut", "other"))).alias("_c"),
        )
    )
    members = staged(pairs).join(cuts, (F.col("pivot") == F.col("_p")) & (F.col("cut") == F.col("_c")))
    return _joined_blocks(members.select("block", "node", "label"), sets, percent)


def jaccard_components(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    n: int = 3,
    percent: int = 90,
    block: int = BLOCK,
) -> DataFrame:
    """``id, n_shingles, component_id`` of every row; the component's id is its least id."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = staged(rows.mapInArrow(_describe(n), f"id {kind}, n bigint, node bigint"))
    classes = staged(
        described.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    )

    columns = "sig bigint, node bigint, kind bigint, times bigint"
    dealt = rows.select("text").mapInArrow(_part_rows(n, percent), f"deal bigint, {columns}")
    dealt = dealt.repartition(parts, "deal").sortWithinPartitions("sig")
    shared = staged(dealt.mapInArrow(_shared, columns))
    firsts = shared.where("times > 0")
    times = firsts.groupBy(F.col("sig").alias("_sig")).agg(F.max("times").alias("times"))
    # A merge join at every size: it splits the nodes of a signature that many sets share.
    others = shared.where("times = 0").drop("times")
    others = others.join(staged(times).hint("merge"), F.col("sig") == F.col("_sig"))
    found = firsts.unionByName(others.drop("_sig")).distinct()
    own = W.partitionBy("node", "kind")
    ranked = found.select(
        "sig",
        "node",
        F.row_number().over(own.orderBy("times", "sig")).alias("rank"),
        (F.count(F.lit(1)).over(own) - F.col("kind").bitwiseAND(F.lit((1 << 32) - 1))).alias("needed"),
    )
    kept = staged(ranked.where("rank <= needed").select("sig", "node"))
    pivots = kept.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
    pivots = staged(pivots.where("pivot <> last").select(F.col("sig").alias("_sig"), "pivot"))
    stars = kept.join(pivots.hint("merge"), F.col("sig") == F.col("_sig")).select("pivot", "node").distinct()
    sized = classes.select(F.col("node").alias("_n"), "n")
    stars = staged(stars.join(sized, F.col("node") == F.col("_n")).drop("_n"))
    stars = staged(_families(stars, block))

    wanted = stars.select(F.col("node").alias("_w")).distinct().join(classes, F.col("_w") == F.col("node"))
    wanted = staged(wanted.select(F.col("node").alias("_w"), F.col("rep").alias("_rep")))
    reps = wanted.select("_rep").hint("merge")
    texts = rows.join(reps, F.col("id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets(n), "node bigint, grams binary")
    sets = staged(sets.join(wanted.select("_w"), F.col("node") == F.col("_w"), "left_semi"))

    sizes = staged(stars.groupBy(F.col("pivot").alias("_p")).agg(F.ceil(F.sum("n") / block).alias("cuts")))
    sized = stars.join(sizes, F.col("pivot") == F.col("_p"))
    members = sized.select(F.xxhash64("pivot", F.pmod(F.xxhash64("node"), "cuts")).alias("block"), "node")
    centres = sizes.select(
        F.col("_p").alias("node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("cut")
    ).select(F.xxhash64("node", "cut").alias("block"), "node")
    members = members.union(centres).distinct().withColumn("label", F.col("node"))
    labels = staged(components(_joined_blocks(members, sets, percent)))

    large = sizes.where("cuts > 1").select("_p")
    if not large.isEmpty():
        rest = stars.join(large, F.col("pivot") == F.col("_p"), "left_semi")
        named = labels.select(F.col("node").alias("_n"), "label")
        more = _finish(rest, labels, sets, percent, block)
        for end in ("u", "v"):
            more = more.join(named, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("label", end)).drop("_n", "label")
        moved = components(more).withColumnsRenamed({"node": "_m", "label": "moved"})
        known = classes.select("node").join(named, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("label", "node").alias("label"))
        labels = staged(known.join(moved, F.col("label") == F.col("_m"), "left").select("node", F.coalesce("moved", "label").alias("label")))
    found = classes.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    found = staged(found.select("node", "rep", F.coalesce("label", "node").alias("label")))
    least = staged(found.groupBy(F.col("label").alias("_l")).agg(F.min("rep").alias("component")))
    placed = staged(found.join(least, F.col("label") == F.col("_l")).select(F.col("node").alias("_n"), "component"))
    return described.select("id", "n", "node").join(
        placed, (F.col("node") == F.col("_n")) & (F.col("n") > 0), "left"
    ).select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row of each group of near copies: one of the least id; rows unchanged.

    The verdict is that of an id and a text, so rows that share an id but not a text are told
    apart; of texts that share the least id that of the least hash stays, and of its repeated
    rows one. Rows without id or without words all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = jaccard_components(docs.select(key.alias("doc_id"), "text"), n=n, percent=percent)
    found = found.where("n_shingles > 0 and not doc_id.missing").groupBy("doc_id").agg(
        F.min(F.col("doc_id") == F.col("component_id")).alias("first"), F.count(F.lit(1)).alias("times")
    )
    same, text, mine = unused(docs, "same_id"), unused(docs, "same_text"), unused(docs, "text_hash")
    found = found.where("not first or times > 1")
    found = staged(found.select(F.col("doc_id.id").alias(same), F.col("doc_id.text").alias(text), "first"))
    repeats = staged(found.where("first").select(same, text))
    rows = docs.withColumn(mine, F.xxhash64("text"))
    on = (F.col("doc_id") == F.col(same)) & (F.col(mine) == F.col(text))
    # A merge join at every size: texts move once.
    once = rows.join(found.select(same, text).hint("merge"), on, "left_anti")
    repeated = rows.join(repeats, on, "left_semi").dropDuplicates(["doc_id", mine])
    return once.unionByName(repeated).drop(mine)
