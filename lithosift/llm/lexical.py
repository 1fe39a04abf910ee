"""Ranked lexical search of many queries at once, by common-subexpression evaluation.

A document's score for an item is a sum over the item's terms, so items that share terms share sums. The items of a block are
mined for shared term sets (sharing()): terms that occur in the same items form one set; the sets of an item are ordered by how many
items have them, and neighbours that occur together in two or more items are joined, round by round, into larger sets. The result is a
DAG whose leaves are terms and whose other nodes are sums of earlier nodes. In a task every node's partial sum is made once for
a batch of documents and used by all items above it.

    bags   one pass over the texts: terms in all and how often each of the block's terms occurs; written as a table
    stats  documents, terms, documents of each term: sums over that table
    score  the DAG over batches of bags; a task keeps the best of each item, bounded by items x top
    top    a window per item and part of the tasks, then one per item

Integer arithmetic throughout, but for the weights' logarithm. Items come in blocks of at most BLOCK rows, so neither the vocabulary nor
the plan grows with their number; no document is paired with an item that it has no term of.

Defined results: null and empty texts have no terms, count for nothing and are never found; items without terms give no row; every row of
items is ranked for itself, repeated ids too; repeated documents are ranked each; equal scores go by doc_id, null last; empty
tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, id_and_text, per_text, thrifty

TOP = 50
#: Items of a block, and bytes of their texts, at most (one item alone may have more).
BLOCK, BLOCK_BYTES = 256, 1 << 22
#: Partial sums that a task holds at once: documents of a batch times nodes of the DAG.
CELLS = 1 << 21
#: Parts of the tasks whose best documents are merged before the last merge.
SALTS = 256
#: Bytes of a text that are split into terms at once.
STEP = 1 << 20

#: ASCII other than digits and letters parts terms; A-Z become a-z; all other bytes stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """All terms of a text in order, in lists."""
    data = text.encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STEP)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


BAG = "n bigint, term array<int>, tf array<bigint>"


def _bags(vocabulary: dict[bytes, int], texts: list[str]) -> pa.Array:
    n, ends, term, tf = [], [0], [], []
    for t in texts:
        total, found = 0, Counter()
        for some in terms(t):
            total += len(some)
            found.update(map(vocabulary.get, some))
        found.pop(None, None)
        n.append(total)
        term.extend(found)
        tf.extend(found.values())
        ends.append(len(term))
    offsets = pa.array(ends, pa.int32())
    cols = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))]
    return pa.StructArray.from_arrays(cols, names=["n", "term", "tf"])


def bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms in all), term and tf (those of the vocabulary by number, and their occurrences), of documents with terms."""
    bag = per_text(docs.sparkSession, lambda texts: _bags(vocabulary, texts), BAG, F.col("text"))
    return id_and_text(docs, id_col, text_col).select("doc_id", bag.alias("bag")).select("doc_id", "bag.*").filter("n > 0")


@dataclass(frozen=True)
class Sharing:
    """The DAG: node k < leaves is term k, node leaves + k the sum of sums[k]; tops has each item's node."""

    leaves: int
    sums: list[tuple[int, ...]]
    tops: list[int]

    def additions(self) -> int:
        return sum(len(s) - 1 for s in self.sums)

    def totals(self, leaf: np.ndarray) -> np.ndarray:
        """leaf has a row per term and a column per document; a row per item comes back."""
        at = np.zeros((self.leaves + len(self.sums), leaf.shape[1]), np.int64)
        at[: self.leaves] = leaf
        for k, parts in enumerate(self.sums, self.leaves):
            np.sum(at[list(parts)], axis=0, out=at[k])
        return at[self.tops]


def sharing(items: list[list[int]], leaves: int) -> Sharing:
    """Mines the items' term numbers for sets that several items share."""
    sums: list[tuple[int, ...]] = []
    made: dict[tuple[int, ...], int] = {}

    def node(parts: tuple[int, ...]) -> int:
        if len(parts) == 1:
            return parts[0]
        if parts not in made:
            made[parts] = leaves + len(sums)
            sums.append(parts)
        return made[parts]

    where: dict[int, list[int]] = {}
    for k, item in enumerate(items):
        for t in sorted(set(item)):
            where.setdefault(t, []).append(k)
    # Terms of the same items are one set.
    together: dict[tuple[int, ...], list[int]] = {}
    for t in sorted(where):
        together.setdefault(tuple(where[t]), []).append(t)
    rows: list[list[int]] = [[] for _ in items]
    for owners, some in sorted(together.items(), key=lambda x: (-len(x[0]), x[1])):
        for k in owners:
            rows[k].append(node(tuple(some)))
    # Sets that stand together in several items become larger ones.
    while True:
        pairs = Counter(p for row in rows for p in zip(row, row[1:], strict=False))
        shared = {p for p, n in pairs.items() if n > 1}
        if not shared:
            break
        for k, row in enumerate(rows):
            out, at = [], 0
            while at < len(row):
                pair = tuple(row[at : at + 2])
                # Of two overlapping pairs the more frequent one is joined.
                if pair in shared and not (tuple(row[at + 1 : at + 3]) in shared and pairs[tuple(row[at + 1 : at + 3])] > pairs[pair]):
                    out.append(node(pair))
                    at += 2
                else:
                    out.append(row[at])
                    at += 1
            rows[k] = out
    return Sharing(leaves, sums, [node(tuple(row)) for row in rows])


def weights(df: dict[int, int], documents: int, leaves: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(leaves)], np.int64)


def _by_id(x: tuple) -> tuple:
    return -x[0], x[1] is None, x[1]


def _best(scores: np.ndarray, ids: list, top: int) -> list[tuple]:
    """The top documents of one item as (score, id), those above 0."""
    at = np.flatnonzero(scores)
    if len(at) > top:
        low = np.partition(scores[at], len(at) - top)[len(at) - top]
        over, level = at[scores[at] > low], at[scores[at] == low]
        level = heapq.nsmallest(top - len(over), level, key=lambda k: (ids[k] is None, ids[k]))
        at = np.concatenate([over, np.array(level, at.dtype)])
    return [(int(scores[k]), ids[k]) for k in at]


def score(found: DataFrame, plan: Sharing, weight: np.ndarray, top: int) -> DataFrame:
    """item (its number in the plan), doc_id, score: the best documents of each task; found has doc_id, m, term, tf."""
    kind = found.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in plan.tops]
        id_type = None
        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            rows = max(1, CELLS // (plan.leaves + len(plan.sums)))
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                lists = b.column("term")
                doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                term, tf, m = lists.flatten().to_numpy(), b.column("tf").flatten().to_numpy(), b.column("m").to_numpy()
                leaf = np.zeros((plan.leaves, b.num_rows), np.int64)
                leaf[term, doc] = weight[term] * ((1000000000 * tf) // (1000 * tf + 20 * m[doc]))
                ids = b.column("doc_id").to_pylist()
                for k, scores in enumerate(plan.totals(leaf)):
                    if scores.any():
                        best[k] = heapq.nsmallest(top, best[k] + _best(scores, ids, top), key=_by_id)
        if id_type is not None:
            item = [k for k, some in enumerate(best) for _ in some]
            cols = [pa.array(item, pa.int32()), pa.array([i for some in best for _, i in some], id_type), pa.array([s for some in best for s, _ in some], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "doc_id", "score"])

    return found.mapInArrow(thrifty(run), f"item int, doc_id {kind.simpleString()}, score bigint")


def best(scored: DataFrame, top: int, *by: str) -> DataFrame:
    """The top rows of each group, with their rank; tasks keep only their own top rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(id, text) of the items, in blocks that the driver holds one at a time."""
    out, size = [], 0
    for r in items.toLocalIterator():
        out.append((r[0], r[1] or ""))
        size += len(out[-1][1])
        if len(out) >= BLOCK or size >= BLOCK_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of every row of items."""
    spark = docs.sparkSession
    item_type, doc_type = items.schema[item_col].dataType, docs.schema[id_col].dataType
    done = spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {doc_type.simpleString()}, score bigint")
    for block in _blocks(items.select(item_col, query_col)):
        own = [{w for some in terms(text) for w in some} for _, text in block]
        vocabulary = {w: k for k, w in enumerate(sorted(set().union(*own)))}
        if not vocabulary:
            continue
        bag = cut(bags(docs, vocabulary, id_col, text_col))
        documents, total = bag.agg(F.count("*"), F.sum("n")).first()
        if documents:
            df = dict(bag.select(F.explode("term").alias("t")).groupBy("t").count().collect())  # no more rows than the block has terms
            plan = sharing([[vocabulary[w] for w in words] for words in own], len(vocabulary))
            # Exact beyond 64 bits, as 50 x n x N may be.
            m = F.expr(f"50 + (cast(50 as decimal(20,0)) * n * {documents}BD) div {total}").alias("m")
            scored = score(bag.select("doc_id", m, "term", "tf"), plan, weights(df, documents, len(vocabulary)), top)
            parts = best(scored.withColumn("part", F.spark_partition_id() % SALTS), top, "item", "part").drop("rank")
            ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {item_type.simpleString()}")
            found = best(parts, top, "item").join(F.broadcast(ids), "item")  # at most BLOCK rows
            done = done.unionByName(cut(found.select("item_id", "rank", "doc_id", "score")))
        drop(bag)
    return done


SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50
"""
