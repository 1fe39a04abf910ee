"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is a bag of shingles of SHINGLE words (lower-cased runs of letters, digits and underscores), each weighted by
how often it occurs; a document of fewer words is one shingle. Similarity is the weighted Jaccard
index, sum of minima by sum of maxima, and documents at THRESHOLD or more are linked. Classes are the
connected components of the links.

DartMinHash: each shingle has a plane of (weight, rank) in which darts lie at a density of one, placed by
hashes of the shingle alone. A document throws those of its darts whose weight is below the shingle's weight;
each dart belongs to one of K coordinates, and the dart of lowest rank in a coordinate is the document's
signature there. Two documents have the same dart with a probability equal to their similarity. Ranks are visited up
to so many that K coordinates are filled as a rule, and further for documents with an empty one.

Joining: BANDS groups of ROWS coordinates are hashed to buckets (a pair at 0.8 misses all with a probability of 6e-5).
1. Equal bags of words are one node from the start, however many copies there are.
2. Each bucket's head is its node that has the largest buckets: in a group of edited copies, the original or the least edited
   one. Each node is compared with the head that shares the most buckets with it.
3. The nodes of buckets that are not all connected then are dealt out again by their rare shingles (rare_links()): two
   documents that are alike share one, while documents that merely have a frequent passage in common share none. Such groups are
   compared in blocks of about BLOCK nodes against each other, by signature first and exactly then; a task
   hands on a spanning forest of its links only, and a group's largest component isn't compared with itself.
No pairs of a bucket are emitted; copies of hot groups collapse in steps 1 and 2. Documents whose similarities lie all about the
threshold, such as thousands of edits of one text, share rare shingles too; what isn't linked of such a family
is compared with all of it, block by block.

Defined results: a null or wordless text has no shingles and is alike to the other wordless texts only if their text is the same
once white space is cut off at both ends; ids may be null and rows may repeat; an empty table gives an empty
result; other columns are neither read nor touched. Nodes are named by a 64-bit hash of their words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, few, give_back, id_and_text, per_text, same, thrifty

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 32
K = ROWS * BANDS
#: Darts thrown at first: enough to fill K coordinates in 7 of 8 documents.
DARTS = K * (math.log(K) + 2)
#: Nodes of a block, and bytes of their bags.
BLOCK, BLOCK_BYTES = 256, 1 << 23
#: Blocks of fewer nodes are compared without signatures.
SIGN_FROM = 16

WORDS = re.compile(r"\w+")
_U = np.uint64
#: Odd multipliers of the hashes.
_MUL = [_U(0x9E3779B97F4A7C15 ^ (0x5851F42D4C957F2D * k & (1 << 64) - 1) | 1) for k in range(max(SHINGLE, ROWS) + 4)]
#: Chances of at most 0, 1, 2, ... darts in a unit cell, as 32-bit numbers.
_POISSON = (np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]) * 2**32).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class _Hashes(dict):
    """word -> 64-bit hash, remembered up to a number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


_hashes = _Hashes()


def bag(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(node, shingles ascending, weights) of a text."""
    words = WORDS.findall(text.lower())
    if not words:
        name = hashlib.blake2b(text.strip().encode(), digest_size=8, person=b"wordless").digest()
        return int.from_bytes(name, "little", signed=True), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    node = int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)
    n = max(1, len(h) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        s += mix(h[k : k + n] + _MUL[k]) * _MUL[k + 1]
    shingles, weights = np.unique(mix(s), return_counts=True)
    return node, shingles, weights


def _throw(x: np.ndarray, w: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray, sig: np.ndarray) -> None:
    """Darts of ranks from low to high (by document) into best (rank) and sig, arrays of document by coordinate."""
    # A unit of weight of each shingle: its column of cells.
    column = np.repeat(np.arange(len(x)), w)
    level = np.arange(len(column)) - np.repeat(np.cumsum(w) - w, w)
    key = mix(x[column] + level.astype(np.uint64) * _MUL[1])
    d = doc[column]
    first, last = np.floor(low).astype(np.int64), np.ceil(high).astype(np.int64)
    rows = (last - first)[d]
    cell = np.repeat(np.arange(len(column)), rows)
    rank = np.arange(len(cell)) - np.repeat(np.cumsum(rows) - rows, rows) + first[d][cell]
    key = mix(key[cell] + rank.astype(np.uint64) * _MUL[2])
    darts = np.searchsorted(_POISSON, key >> _U(32), side="right")
    which = np.repeat(np.arange(len(cell)), darts)
    no = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(key[which] + (no + 1).astype(np.uint64) * _MUL[3])
    rank = rank[which] + (dart >> _U(32)).astype(np.float64) / 2**32
    d = d[cell][which]
    ok = (rank >= low[d]) & (rank < high[d])
    dart, rank, d = mix(dart[ok]), rank[ok], d[ok]
    at = d * K + (dart % _U(K)).astype(np.int64)
    order = np.argsort(-rank, kind="stable")  # the lowest is written last
    at, rank, dart = at[order], rank[order], dart[order]
    new_best, new_sig = np.full(best.shape, np.inf), np.zeros(sig.shape, np.uint64)
    new_best.reshape(-1)[at], new_sig.reshape(-1)[at] = rank, dart
    better = new_best < best
    best[better], sig[better] = new_best[better], new_sig[better]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Documents by K coordinates; every bag has a shingle."""
    sig, best = np.zeros((len(bags), K), np.uint64), np.full((len(bags), K), np.inf)
    open_ = np.arange(len(bags))
    low, darts = np.zeros(len(bags)), DARTS
    while len(open_):
        w = [bags[k][1] for k in open_]
        mass = np.array([x.sum() for x in w], np.float64)
        high = low + darts / mass
        doc = np.repeat(np.arange(len(open_)), [len(x) for x in w])
        b, s = best[open_], sig[open_]
        _throw(np.concatenate([bags[k][0] for k in open_]), np.concatenate(w), doc, low, high, b, s)
        best[open_], sig[open_] = b, s
        rest = np.isinf(b).any(axis=1)
        open_, low = open_[rest], high[rest]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Documents by BANDS bucket keys."""
    s = sig.reshape(len(sig), BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * _MUL[0] + np.zeros((len(sig), 1), np.uint64)
    for k in range(ROWS):
        out = mix(out + s[:, :, k] * _MUL[k + 1])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard index of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def pack_bag(shingles: np.ndarray, weights: np.ndarray) -> bytes:
    """Shingles of weight 1, then the others, then the others' weights; a count in front."""
    one = weights == 1
    return np.uint32(one.sum()).tobytes() + shingles[one].tobytes() + shingles[~one].tobytes() + weights[~one].astype(np.uint32).tobytes()


def unpack_bag(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    m = (len(data) - 4 - 8 * n) // 12
    s = np.frombuffer(data, np.uint64, n + m, 4)
    w = np.concatenate([np.ones(n, np.int64), np.frombuffer(data, np.uint32, m, 4 + 8 * (n + m)).astype(np.int64)])
    order = np.argsort(s, kind="stable")
    return s[order], w[order]


SIGNED = pa.struct([("node", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(texts: list[str]) -> pa.Array:
    """The node and the bucket keys of each text; texts are signed some at a time, by the mass that the darts are thrown for."""
    nodes, keys = [], []
    bags, mass = [], 0
    for k, text in enumerate(texts):
        node, shingles, weights = bag(text)
        nodes.append(node)
        bags.append((shingles, weights))
        mass += int(weights.sum())
        if mass >= 200_000 or len(bags) == 256 or k == len(texts) - 1:
            full = [b for b in bags if len(b[0])]
            made = iter(band_keys(signatures(full)) if full else ())
            keys += [next(made) if len(b[0]) else [] for b in bags]
            bags, mass = [], 0
    return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, SIGNED[1].type)], fields=list(SIGNED))


def _bags(texts: list[str]) -> pa.Array:
    bags = [bag(t) for t in texts]
    cols = [pa.array([b[0] for b in bags], pa.int64()), pa.array([pack_bag(*b[1:]) for b in bags], pa.binary())]
    return pa.StructArray.from_arrays(cols, fields=[pa.field("node", pa.int64()), pa.field("bag", pa.binary())])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of each bag."""
    for batch in batches:
        bags = [unpack_bag(b) for b in batch.column("bag").to_pylist()]
        sizes = [len(b[0]) for b in bags]
        at = 0
        while at < len(bags):
            end, held = at, 0
            while end < len(bags) and (end == at or held + sizes[end] <= 1 << 17):
                held += sizes[end]
                end += 1
            part = bags[at:end]
            rep = lambda values, n=sizes[at:end]: pa.array(np.repeat(np.array(values, np.int64), n))
            shingles = np.concatenate([b[0] for b in part]).view(np.int64) if held else np.zeros(0, np.int64)
            weights = np.concatenate([b[1] for b in part]) if held else np.zeros(0, np.int64)
            cols = [rep(batch.column("node").slice(at, end - at).to_pylist()), pa.array(shingles), pa.array(weights, pa.int64()), rep([int(b[1].sum()) for b in part])]
            yield pa.RecordBatch.from_arrays(cols, ["node", "shingle", "weight", "mass"])
            at = end


def _compare(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [similarity(unpack_bag(x), unpack_bag(y)) >= threshold for x, y in zip(batch.column("bag_u").to_pylist(), batch.column("bag_v").to_pylist(), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _within(threshold: float, table: pa.Table) -> pa.Table:
    """Links between the nodes of one pair of blocks of a group that join what isn't joined yet.

    A pair is looked at in the first group only that both nodes are in.
    """
    key = table.column("key")[0].as_py()
    rows = {}  # a node is in a block once
    for n, c, s, g, b in zip(*(table.column(k).to_pylist() for k in ("node", "label", "side", "groups", "bag")), strict=True):
        old = rows.get(n)
        rows[n] = (c, s | (old[1] if old else 0), frozenset(g), b)
    nodes = sorted(rows)
    bags = [unpack_bag(rows[n][3]) for n in nodes]
    mass = np.array([b[1].sum() for b in bags], np.float64)
    # Signatures pay off where there are many pairs.
    sig = signatures(bags) if len(nodes) > SIGN_FROM else np.zeros((len(nodes), K), np.uint64)
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := top.get(x, x)) != x:
            x = top[x] = top.get(y, y)
        return x

    # Five standard deviations below the agreement that the threshold has on average.
    least = K * threshold - 5 * math.sqrt(K * threshold * (1 - threshold))
    links = []
    for i, n in enumerate(nodes):
        c, s, g, _ = rows[n]
        near = np.flatnonzero(((sig[i] == sig[i + 1 :]).sum(axis=1) >= least) & (np.minimum(mass[i], mass[i + 1 :]) >= threshold * np.maximum(mass[i], mass[i + 1 :]))) + i + 1
        for j in near:
            m = nodes[j]
            if (s | rows[m][1]) != 3 or min(g & rows[m][2]) != key or (x := root(c)) == (y := root(rows[m][0])):
                continue
            if similarity(bags[i], bags[j]) >= threshold:
                top[x] = y
                links.append((n, m))
    u, v = zip(*links, strict=True) if links else ((), ())
    del bags, sig, rows
    give_back()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for every node in links (u, v).

    Large-star and small-star steps in turn: nodes are hung on the least node among their neighbours, until nothing
    changes; the number of rounds grows with the logarithm of the components' size.
    """
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, edges = edges, cut(small.filter("u <> v").distinct())
        drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    out = cut(labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
    drop(edges)
    return out


def labels(docs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """(node, label) of the nodes that have links: the same label for all nodes of a class."""
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"))
    buckets = nodes.select("node", "doc_id", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    held = cut(buckets.join(sizes, "key"))
    # A group's original, or the copy nearest to it, is in the large buckets more often than the others.
    score = held.groupBy("node").agg(F.sum("n").alias("score"))
    heads = held.select("key", "node").join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("head"))
    # The documents with a bucket in common with others, their bags read from the texts again.
    ids = held.select(F.col("doc_id").alias("id"), F.col("node").alias("of")).distinct()
    found = docs.join(few(ids.select("id").distinct()), same(docs["doc_id"], F.col("id")), "left_semi")
    made = found.select(per_text(docs.sparkSession, _bags, "node bigint, bag binary", F.col("text")).alias("made")).select("made.*")
    bags = cut(made.join(ids.select(F.col("of").alias("node")), "node", "left_semi").dropDuplicates(["node"]))
    pairs = held.select("key", "node").join(heads, "key").filter("node <> head.node").groupBy("node", "head").count().groupBy("node").agg(F.max(F.struct("count", "head")).alias("top")).select(F.col("node").alias("u"), F.col("top.head.node").alias("v"))
    # The bag of the one end, then that of the other.
    pairs = pairs.join(bags.select(F.col("node").alias("u"), F.col("bag").alias("bag_u")), "u")
    pairs = pairs.join(bags.select(F.col("node").alias("v"), F.col("bag").alias("bag_v")), "v")
    first = cut(pairs.mapInArrow(thrifty(lambda b: _compare(threshold, b)), "u long, v long"))
    label = components(first)
    drop(first)
    # Nodes of buckets that are not connected yet.
    rest = held.select("key", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = rest.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a <> z").select("key")
    unsure = cut(rest.join(open_, "key").select("node", "label", F.col("key").alias("bucket")))
    drop(held)
    if not unsure.isEmpty():
        second = cut(rare_links(unsure, bags, threshold))
        if not second.isEmpty():
            # Labels that the new links join get one label more.
            known = unsure.select(F.col("node").alias("at"), F.col("label").alias("to")).distinct()
            for end in ("u", "v"):
                second = second.join(known, F.col(end) == F.col("at")).drop(end, "at").withColumnRenamed("to", end)
            joined = components(second).select(F.col("node").alias("label"), F.col("label").alias("whole"))
            every = label.unionByName(joined.select(F.col("label").alias("node"), "label")).distinct()
            old, label = label, cut(every.join(joined, "label", "left").select("node", F.coalesce("whole", "label").alias("label")).distinct())
            drop(old)
    drop(unsure, bags)
    return label


def rare_links(unsure: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) among the nodes of unsure (node, label, bucket) that join all which share a bucket, are alike and have different labels."""
    of = rare_blocks(unsure, bags, threshold).join(bags, "node")
    return of.groupBy("key", "lo", "hi").applyInArrow(lambda t: _within(threshold, t), "u long, v long")


def rare_blocks(unsure: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Who is compared with whom: nodes of a pair of blocks lo and hi of a group key, the block's side and all of the node's groups.

    Two bags of a similarity of t or more share at least a part t of the larger one's mass. So if the shingles are ordered by the
    number of nodes that have them, the two have a shingle in common among those that are left of each when the most
    frequent ones that make up a part t of its mass, but for one, are taken away. Only nodes that share a bucket and such a rare
    shingle are compared: a passage that many documents have brings none of them together.
    """
    rows = bags.join(unsure, "node", "left_semi").mapInArrow(thrifty(_spread), "node long, shingle long, weight long, mass long")
    common = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    frequent = Window.partitionBy("node").orderBy(F.desc("n"), "shingle").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(few(cut(common)), "shingle").withColumn("upto", F.sum("weight").over(frequent))
    rare = cut(rows.filter(F.col("upto") >= F.ceil(F.col("mass") * threshold - 1e-9)).select(F.col("shingle").alias("key"), "node"))
    # A node is in a group if one of another label that it shares a bucket with is, too.
    of = rare.join(unsure, "node")
    met = of.groupBy("bucket", "key").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a <> z")
    of = cut(of.join(met, ["bucket", "key"], "left_semi").select("key", "node", "label").distinct())
    # Groups with one label are settled; of groups with the same nodes one will do.
    groups = of.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("who"), F.min("label").alias("a"), F.max("label").alias("z")).filter("a <> z")
    groups = cut(groups.groupBy("n", "who").agg(F.min("key").alias("key")).select("key", "n"))
    of = of.join(groups, "key").join(bags.select("node", F.octet_length("bag").cast("long").alias("bytes")), "node")
    per_label = of.groupBy("key", "label").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes"), F.first("n").alias("n"))
    blocks = per_label.groupBy("key").agg(F.max(F.struct("k", "label", "bytes")).alias("major"), F.sum("bytes").alias("bytes"), F.first("n").alias("n"))
    count = lambda k, size: F.greatest(F.lit(1), F.ceil(k / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    blocks = blocks.select("key", F.col("major.label").alias("major"), count(F.col("n") - F.col("major.k"), F.col("bytes") - F.col("major.bytes")).alias("minors"), count(F.col("major.k"), F.col("major.bytes")).alias("majors"))
    of = of.select("key", "node", "label").join(blocks, "key")
    # A group's largest component is not compared with itself: its blocks meet those of the other nodes alone.
    mine = F.col("label") == F.col("major")
    block = F.when(mine, F.col("minors") + F.pmod(F.xxhash64("node"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("node"), F.col("minors"))).cast("int")
    others = F.sequence(F.lit(0), F.when(mine, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)
    keys = of.groupBy("node").agg(F.collect_set("key").alias("groups"))  # as many as a document has shingles at most
    of = of.select("key", "node", "label", block.alias("block"), F.explode(others).alias("other"))
    # Side 1 is the lower block, side 2 the higher; a block against itself has both.
    of = of.select("key", "node", "label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    return of.join(keys, "node")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of docs: doc_id, class_id (the class's least doc_id), class_size, kept (one row of each class)."""
    return _classes(id_and_text(docs, id_col, text_col), threshold)


def _sum(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """near_classes of docs' doc_id and text, and of its column sum, if it has one."""
    more = [c for c in docs.columns if c == "sum"]
    made = per_text(docs.sparkSession, _sign, "node bigint, bands array<bigint>", F.col("text")).alias("made")
    signed = cut(docs.select("doc_id", *more, made).select("doc_id", *more, "made.*", F.monotonically_increasing_id().alias("uid")))
    label = labels(docs, signed, threshold)
    per_node = signed.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("uid").alias("c"))).alias("best"))
    per_node = per_node.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = per_node.groupBy("label").agg(F.sum("n").alias("class_size"), F.min("best").alias("best"))
    of_node = cut(per_node.select("node", "label").join(whole, "label"))
    drop(label)
    return signed.select("doc_id", *more, "node", "uid").join(of_node, "node").select("doc_id", *more, F.col("best.b").alias("class_id"), "class_size", (F.col("uid") == F.col("best.c")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all its columns, one row of each class, also where ids repeat or are null."""
    # An id names one row, as a rule: then the ids that go are all there is to know. Only rows of other ids need their text's sum.
    again = cut(docs.select(F.col(id_col).alias("__id")).groupBy("__id").count().filter("count > 1").select("__id"))
    some = not again.isEmpty()
    given = id_and_text(docs, id_col, text_col)
    if some:
        marks = few(again.select(F.col("__id").alias("__again"), F.lit(True).alias("__twice")))
        given = given.join(marks, same(F.col("doc_id"), F.col("__again")), "left").select("doc_id", "text", F.when(F.col("__twice"), _sum(F.col("text"))).alias("sum"))
    made = cut(_classes(given, threshold).select(F.col("doc_id").alias("__id"), *([F.col("sum").alias("__sum")] if some else []), F.col("kept").alias("__kept")))
    if not some:
        return docs.join(few(made.filter("NOT __kept").select("__id")), same(F.col(id_col), F.col("__id")), "left_anti")
    gone = few(made.filter("NOT __kept AND __sum IS NULL").select("__id"))
    out = docs.join(gone, same(F.col(id_col), F.col("__id")), "left_anti").join(few(again), same(F.col(id_col), F.col("__id")), "left_anti")
    # Rows that repeat an id are looked up by their text too, and one stays of those alike in both.
    twice = docs.join(few(again), same(F.col(id_col), F.col("__id")), "left_semi").withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    kept = few(made.filter("__kept AND __sum IS NOT NULL").select("__id", "__sum"))
    one = twice.join(kept, same(F.col(id_col), F.col("__id")) & (_sum(F.col("__text")) == F.col("__sum")), "left_semi")
    return out.unionByName(one.dropDuplicates([id_col, "__text"]).drop("__text"))
