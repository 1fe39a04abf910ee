"""Phrase collocations: exact counts of phrases by top-order marginalisation, and the phrases whose parts rarely stand without each other.

Each word of a piece is counted once, as the head of its window: the word and the next MOST - 1 ones as lead columns, padded with nulls at
the piece's end. Every phrase is a prefix of just one window at each of its places, so the shorter phrases' counts are sums of the longest
windows' counts, and ROLLUP over (lang, w1, ..., wMOST) gives all of them, the words' and each language's total too. No n-grams of other
lengths are made.

Most windows of a corpus occur once or twice. Before the windows are shuffled, each is cut (padded) where two or three neighbouring words
are together too rare to be in a phrase: a phrase's count is at most that of any words in it. The neighbours' counts are kept by a hash's cell,
so they are never too small, and the frequent cells go to the tasks as Bloom filters, which let none of them fall: first that of pairs, then
that of triples whose pairs are frequent. Both mistakes only leave windows longer than they need be; the counts of phrases that are frequent
enough are exact, as are those of all words. A filter has BITS bits for each frequent cell and MOST_BITS at most, so its size is
bounded; beyond, it cuts less.

Defined results: null texts are empty; a null lang is und; empty texts and pieces without words have no phrases; repeated rows count each;
an empty table gives an empty result; other columns aren't read. Frequency FEWEST, SHARE and LIMIT are parameters.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

#: Words of the longest phrase, and occurrences of a phrase at least.
MOST, FEWEST = 4, 30
#: A phrase goes if a longer one has this share, in percent, of its occurrences.
SHARE = 80
LIMIT = 2000
SCALE = 2000000
#: Bits of the neighbours' cells; of the filter for each frequent cell, and at most (64 MB).
CELL_BITS, BITS, MOST_BITS = 40, 16, 1 << 29

WORDS = [f"w{k}" for k in range(1, MOST + 1)]


def _lower(text: Column) -> Column:
    """A-Z become a-z. Texts of one byte a letter take the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang and words, the words of each piece of the texts."""
    cells = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[.,;:!?\x0A-\x0D]+")).alias("piece"))
    # A blank at an end gives an empty first or last word.
    words = F.array_remove(F.split(_lower(F.col("piece")), r"[\x20\x09]+"), "")
    return cells.select("lang", words.alias("words"))


def windows(cells: DataFrame) -> DataFrame:
    """lang, w1, ..., wMOST: a row per word, with the words that follow it in its piece or nulls."""
    lead = [F.get("words", F.col("at") + k).alias(w) for k, w in enumerate(WORDS)]
    return cells.select("lang", "words", F.posexplode("words").alias("at", "w1")).select("lang", "w1", *lead[1:])


def cell(*words: Column) -> Column:
    """Where the neighbours of a language are counted."""
    return F.shiftrightunsigned(F.xxhash64(*words), 64 - CELL_BITS)


def _probes(at: Column, bits: int) -> list[Column]:
    return [F.xxhash64(at, F.lit(k)).bitwiseAND(F.lit(bits - 1)) for k in range(3)]


def frequent(cut_windows: DataFrame, words: int, fewest: int) -> tuple[DataFrame, int]:
    """A Bloom filter of the cells of so many first words of a window that occur so often, as one row with an array of 64-bit words, and its bits."""
    names = WORDS[:words]
    cells = cut_windows.filter(F.col(names[-1]).isNotNull()).select(cell(F.col("lang"), *map(F.col, names)).alias("cell"))
    often = cut(cells.groupBy("cell").count().filter(F.col("count") >= fewest).select("cell"))
    bits = min(MOST_BITS, max(64, 1 << (BITS * often.count() - 1).bit_length()))
    at = often.select(F.explode(F.array(*_probes(F.col("cell"), bits))).alias("bit"))
    ones = at.select(F.expr("bit div 64").alias("at"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("word"))
    zeros = cut_windows.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    whole = ones.unionByName(zeros).groupBy("at").agg(F.bit_or("word").alias("word"))
    filter_ = cut(whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias(f"bits{words}")))
    drop(often)
    return filter_, bits


def shortened(seen: DataFrame, words: int, filter_: DataFrame, bits: int) -> DataFrame:
    """The windows, cut before the first word that doesn't make up frequent neighbours with the ones before it, by the filter of frequent()."""
    test, out = F.lit(True), list(map(F.col, WORDS[: words - 1]))
    for k in range(words - 1, MOST):
        test = test & F.col(WORDS[k]).isNotNull()
        at = cell(F.col("lang"), *map(F.col, WORDS[k + 1 - words : k + 1]))
        for p in _probes(at, bits):
            test = test & (F.getbit(F.get(f"bits{words}", F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        out.append(F.when(test, F.col(WORDS[k])).alias(WORDS[k]))
    return seen.join(F.broadcast(filter_)).select("lang", *out)  # one row of bounded size


def phrase_counts(docs: DataFrame, fewest: int = FEWEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, words (an array; empty for the language's total), f: all words and the phrases with that many occurrences, exactly."""
    seen, used = windows(pieces(docs, text_col, lang_col)), []
    for words in range(2, MOST):
        filter_, bits = frequent(seen, words, fewest)
        seen = shortened(seen, words, filter_, bits)
        used.append(filter_)
        if words == 2:  # written as columns, so that the texts are parted into words twice only
            seen = cut(seen)
            used.append(seen)
    longest = seen.groupBy("lang", *WORDS).agg(F.count("*").alias("n"))
    sums = longest.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # Level 2^k - 1 sums over the last k columns; a prefix that ends with padding is no phrase.
    out = None
    for k in range(MOST + 1):
        words = F.array(*[F.col(w) for w in WORDS[:k]]).cast("array<string>")
        real = F.col(WORDS[k - 1]).isNotNull() if k else F.lit(True)
        one = F.when((F.col("level") == 2 ** (MOST - k) - 1) & real, words)
        out = one if out is None else F.coalesce(out, one)
    counts = sums.select("lang", out.alias("words"), "f").filter("words IS NOT NULL")
    counts = cut(counts.filter((F.size("words") == 0) | (F.col("f") >= fewest)))
    drop(*used)
    return counts


def collocations(docs: DataFrame, fewest: int = FEWEST, share: int = SHARE, limit: int = LIMIT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language by score, occurrences and text."""
    counts = phrase_counts(docs, fewest, text_col, lang_col)
    found = counts.filter(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"))
    part = lambda start, size: F.slice("words", start, size)
    # Each way to cut a candidate in two; parts are as frequent as it, so all of them were counted.
    cuts = found.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.size("words") - F.col("k"))})
    for name, words in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(counts.select("lang", F.col("words").alias(words), F.col("f").alias(name)), ["lang", words])
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}BD) div (cast(l as decimal(20,0)) + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # The most frequent longer candidate around each phrase.
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("start")
    inner = found.filter(F.size("words") > 2).select("lang", "words", "a", starts)
    inner = inner.select("lang", "words", "a", "start", F.explode(F.sequence(F.lit(2), F.least(F.size("words") - 1, F.size("words") - F.col("start") + 1))).alias("size"))
    around = inner.select("lang", part(F.col("start"), F.col("size")).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "words"], "left")
    kept = kept.filter(F.expr(f"longer IS NULL OR cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {share}"))
    totals = counts.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    rows = kept.join(totals, "lang").select("lang", F.array_join("words", " ").alias("phrase"), "a", "c.l", "c.r", "n", "c.score")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)  # each task keeps its own first rows before the shuffle
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
c AS (
  SELECT lang, w[i:i + k - 1] AS words, count(*) AS f FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
f AS (SELECT lang, words, f AS a FROM c WHERE len(words) > 1 AND f >= 30),
cuts AS (
  SELECT f.lang, f.words, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM f) f
  JOIN c x ON x.lang = f.lang AND x.words = f.words[1:k] JOIN c y ON y.lang = f.lang AND y.words = f.words[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
around AS (
  SELECT lang, inside, max(a) AS longer FROM (
    SELECT lang, a, words[s:s + n - 1] AS inside
    FROM (SELECT *, unnest(range(1, len(words))) AS s FROM f), (SELECT unnest([2, 3]) AS n) WHERE n < len(words) AND s + n - 1 <= len(words))
  GROUP BY ALL),
rows AS (
  SELECT best.lang, array_to_string(words, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM best LEFT JOIN around ON around.lang = best.lang AND inside = words WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT rows.lang, row_number() OVER (PARTITION BY rows.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM rows JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE len(words) = 1 GROUP BY lang) t ON t.lang = rows.lang
QUALIFY rank <= 2000
"""
