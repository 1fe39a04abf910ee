"""Collocations, archives and lexical search on small tables, against brute force and round trips."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithosift.llm import collocations, lexical, warc
from lithosift.llm import queries as llm

from .cases import ROWS, docs, texts

# 11. Collocations.


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_phrases(rows, fewest, share=collocations.SHARE, limit=collocations.LIMIT):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= fewest}
    around = defaultdict(int)
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[lang, w[i : i + k]] = max(around[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if 100 * around[lang, w] >= share * a:
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, some in out.items() for r, (s, a, p, x, y) in enumerate(sorted(some)[:limit], 1)}


@pytest.mark.parametrize("fewest", [2, 5])
def test_collocations_against_brute_force(spark, fewest):
    rng = random.Random(fewest)
    words = ["of", "The", "new york", "york", "times", "a", "É", "é", "x y", "\t", "in"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", "\t", ",", "! "]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, ""]), "s") for k in range(80)]
    rows += ROWS
    got = {tuple(r) for r in collocations.collocations(docs(spark, rows), fewest=fewest, limit=40).collect()}
    assert got == brute_phrases(rows, fewest, limit=40) and len(got) > 40


def test_counts_are_exact_whatever_the_filter(spark, monkeypatch):
    rng = random.Random(1)
    rows = texts(*[" ".join(rng.choice("abcde") for _ in range(200)) for _ in range(20)])
    want = {(r.lang, tuple(r.words), r.f) for r in collocations.phrase_counts(docs(spark, rows), 30).collect()}
    monkeypatch.setattr(collocations, "MOST_BITS", 64)  # a filter that is too small lets all pass
    assert {(r.lang, tuple(r.words), r.f) for r in collocations.phrase_counts(docs(spark, rows), 30).collect()} == want
    f = Counter(w for _, t, _, _ in rows for w in t.split())
    assert {(w[0], f) for _, w, f in want if len(w) == 1} == set(f.items()) and any(len(w) > 2 for _, w, _ in want)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, []).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, texts("", None, " . , ", "a b"))).count() == 0


def test_windows_are_pruned_and_rolled_up(spark):
    long = docs(spark, texts("a b c d " * 3000))
    seen = collocations.windows(collocations.pieces(long))
    assert seen.count() == 12000
    plan = collocations.phrase_counts(long)._jdf.queryExecution().toString()
    assert "Python" not in plan


# 12. Archives.


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, type string, first string")


LONG = "<p>" + "word " * 40
FALSE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {}\r\n\r\nfake\r\n\r\n"


def brute_pages(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same, default=None) if len(data) >= warc.LEAST else i
        again = first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


PAGES = [
    (5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (None, "x\r\nWARC-Type: evil", LONG), (3, "http://a/2", LONG),
    (10, "http://b", "short"), (11, "http://b", "short"), (12, "http://c", None), (13, "http://d/WARC/1.1", ""), (14, "é 你", "é" * 60),
    (20, "http://e", "x" * 300 + FALSE.format(4) + "y" * 50), (21, "http://e", FALSE.format(40) * 30), (22, "http://e", FALSE.format("x")), (23, "http://e", "\r\nWARC/1." * 40),
    (24, "http://f", FALSE.format(10**9)), (25, "http://f", "a\u0000b" * 50), (26, "http://f", "z" * 100000), (27, "http://f", "\r\n" * 80),
]


def test_archives_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, PAGES).repartition(3), path)
    got = Counter(tuple(r) for r in warc.describe(warc.read(spark, path)).collect())
    assert got == brute_pages(PAGES)
    assert {r.sound for r in warc.chains(spark, path).collect()} == {True}
    uris = {r.uri for r in warc.read(spark, path).collect()}
    assert "x%0D%0AWARC-Type: evil" in uris and None in uris


@pytest.fixture
def ranges(spark):
    """Sets how many bytes a range has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [97, 700, 5000])
def test_records_over_many_ranges(spark, tmp_path, ranges, size):
    rng = random.Random(size)
    rows = [(k, f"http://h/{k}", rng.choice([LONG, "", FALSE.format(rng.randrange(300)), "q" * rng.randrange(2000), FALSE.format(4) * rng.randrange(12)]) + str(k)) for k in range(30)]
    path = str(tmp_path / "w")
    warc.write(pages(spark, rows).coalesce(1), path)
    ranges(size)
    chains = warc.chains(spark, path).collect()
    assert len(chains) > 3 and {r.sound for r in chains} == {True}
    assert Counter(tuple(r) for r in warc.describe(warc.read(spark, path)).collect()) == brute_pages(rows)


def test_archives_of_others(spark, tmp_path):
    """Other versions, lower-case and folded fields, records that are no HTTP messages, compressed and broken files."""
    import gzip

    one = b"WARC/1.0\r\nwarc-type: resource\r\nwarc-record-id:\r\n <urn:x:1>\r\ncontent-length: 7\r\n\r\nab\xff\r\ncd\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "cut.warc").write_bytes(two + one[:-5])
    (tmp_path / "broken.warc").write_bytes(two + b"rubbish\r\n" + one)
    (tmp_path / "none.warc").write_bytes(b"")
    (tmp_path / "text.warc").write_bytes(b"hello")
    got = sorted((r.file.rpartition("/")[2], r.offset, r.type, r.record_id, bytes(r.payload), r.complete) for r in warc.read(spark, str(tmp_path)).collect())
    whole, info = ("resource", "<urn:x:1>", b"ab\xff\r\ncd", True), ("warcinfo", None, b"", True)
    assert got == [
        ("a.warc", 0, *whole), ("a.warc", len(one), *info), ("b.warc.gz", 0, *whole), ("b.warc.gz", len(one), *info),
        ("broken.warc", 0, *info), ("cut.warc", 0, *info), ("cut.warc", len(two), "resource", "<urn:x:1>", b"ab\xff\r\nc", False),
    ]
    sound = {r.file.rpartition("/")[2]: (r.end, r.sound) for r in warc.chains(spark, str(tmp_path)).collect()}
    assert sound == {"a.warc": (len(one + two), True), "b.warc.gz": (len(one + two), True), "cut.warc": (len(one + two), False), "broken.warc": (0, False), "text.warc": (0, False)}


def test_archives_of_nothing(spark, tmp_path):
    warc.write(pages(spark, PAGES).limit(0), str(tmp_path / "w"))
    assert warc.describe(warc.read(spark, str(tmp_path / "w"))).count() == 0


def test_salted_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    warc.write(pages(spark, PAGES), str(tmp_path / "w"))
    assert Counter(tuple(r) for r in warc.describe(warc.read(spark, str(tmp_path / "w"))).collect()) == brute_pages(PAGES)


def test_successors():
    # 0 -> 10 -> 25 -> beyond, 12 -> 25, 15 -> nothing.
    assert warc.successors([0, 10, 12, 15, 25], [10, 25, 25, 18, 40], 30).tolist() == [40, 40, 40, -1, 40]
    n = 1000
    assert set(warc.successors(list(range(n)), list(range(1, n + 1)), n).tolist()) == {n}


# 13. Lexical search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, top):
    bags = [(r[0], Counter(TERM.findall(lower(r[1] or "")))) for r in rows]
    bags = [(i, b) for i, b in bags if b]
    n, total, df = len(bags), sum(b.total() for _, b in bags), Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 50 + 50 * b.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(TERM.findall(lower(text or ""))) if b[t])
            scored.append((-s, i is None, i))
        out.update((item, r, i, -s) for r, (s, _, i) in enumerate(sorted(x for x in scored if x[0])[:top], 1))
    return out


ITEMS = [(1, "The QUICK brown fox"), (2, "brown fox über 你好 jumps"), (3, None), (4, "..."), (5, "the the THE quick brown"), (5, "lazy dog"), (None, "quick brown dog_lazy"), (7, "absent")]


def items(spark, rows=None):
    return spark.createDataFrame([(*r, "clash") for r in (ITEMS if rows is None else rows)], "item_id long, text string, doc_id string")


@pytest.mark.parametrize(("top", "block"), [(50, 256), (3, 256), (2, 2)])
def test_search_against_brute_force(spark, monkeypatch, top, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "CELLS", 60)  # many small batches
    rng = random.Random(top)
    words = "the quick brown fox jumps over lazy dog über 你好 Ü x1".split()
    rows = [(k % 90, " ".join(rng.choices(words, k=rng.randrange(1, 30))), "en", "s") for k in range(120)]
    rows += [(200 + k, "quick brown fox", "en", "s") for k in range(60)] + ROWS
    got = Counter(tuple(r) for r in lexical.rank(docs(spark, rows), items(spark), top).collect())
    assert got == brute_search(rows, ITEMS, top)


def test_search_of_nothing(spark):
    assert lexical.rank(docs(spark, []).limit(0), items(spark)).count() == 0
    assert lexical.rank(docs(spark), items(spark).limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.rank(docs(spark, texts(None, "", "!")), items(spark)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "Ab, cdé-99_x " * 500
    want = TERM.findall(lower(text))
    monkeypatch.setattr(lexical, "STEP", 7)
    assert [w.decode() for some in lexical.terms(text) for w in some] == want


def test_items_share_their_sums():
    rng = random.Random(2)
    common, own = list(range(30)), iter(range(30, 400))
    sets = [rng.sample(common, 20) + [next(own) for _ in range(3)] for _ in range(60)]
    plan = lexical.sharing(sets, 400)
    leaf = np.array([[rng.randrange(100) for _ in range(5)] for _ in range(400)])
    assert (plan.totals(leaf) == np.array([leaf[s].sum(axis=0) for s in sets])).all()
    plain = sum(len(s) - 1 for s in sets)
    assert plan.additions() < 0.7 * plain
    # A set of terms that all items have is summed once.
    assert lexical.sharing([[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 3, 4]], 7).additions() == 5
    assert lexical.sharing([[], [2]], 3).totals(np.ones((3, 1), np.int64)).tolist() == [[0], [1]]


def test_new_queries_equal_brute_force(spark, sf):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]
    documents = read("documents", "doc_id", "text", "lang", "source")
    assert {tuple(r) for r in llm.op11_collocations(spark, sf).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == brute_phrases(documents, collocations.FEWEST)
    assert Counter(tuple(r) for r in llm.op12_warc(spark, sf).collect()) == brute_pages(read("pages", "page_id", "url", "html"))
    assert Counter(tuple(r) for r in llm.op13_lexical_search(spark, sf).collect()) == brute_search(documents, read("benchmark", "item_id", "text"), 50)


# 7. The filter's sizes.


def test_short_lists_in_large_universes(spark):
    """200 listed of 100,000: no level is much larger than the list, and what is broadcast is counted."""
    from lithosift.llm import url_filter

    universe = spark.range(100000).select(F.concat(F.lit("h/"), "id").alias("key"))
    listed = spark.range(0, 100000, 500).select(F.concat(F.lit("h/"), "id").alias("key"))
    assert url_filter.first_bits(200, 99800) == 15 and url_filter.first_bits(1, 0) == url_filter.BITS
    for most, wide in ((url_filter.BROADCAST, False), (100, True)):
        c = url_filter.cascade(universe, listed, most=most)
        sizes = c.filters.select(F.transform("levels", lambda w: F.size(w) * 8).alias("n")).first().n
        assert sizes[1] <= 2 * 200 and sum(sizes) < 2000 and c.wide is wide
        got = c.listed(universe, F.col("key")).filter("listed").select("key")
        assert got.count() == 200 and got.exceptAll(listed).isEmpty()
