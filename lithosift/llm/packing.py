"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of LIMIT tokens as fit, then one for
each binary digit of the rest, longest first. Each piece is a sequence of its own, and pieces of equal length
form a bucket from which batches without any padding are drawn; no sequence crosses documents.

Sequences are numbered within (bucket, hash of the piece's document, place and checksum): the numbers are unique and the
same in each run, and neither a bucket nor a document nor all rows without an id are ever one group.

Token ids are those of the tokenizers library for the given file. Texts without special strings are
encoded from the same vocabulary as ranks, by tiktoken, which gives the same ids several times faster; a text
with a special string, or one that tiktoken refuses, goes to tokenizers itself.

Defined results: a null text counts as empty and has the one token that ends each document; null ids
are kept; repeated rows are documents of their own; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, per_text, tokenizer_path

LIMIT = 2048
#: The id that ends a document.
END = 1
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Bits of the hash that numbers are given out by.
CELLS = 12


@lru_cache(2)
def encoder(tokenizer: str, ranks: str | None):
    """text -> numpy array of token ids."""
    with open(tokenizer, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    full = []  # the library's tokenizer, once it is needed
    fast = None
    if ranks:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast and not any(s in text for s in special):
            try:
                return np.asarray(fast.encode_ordinary(text), np.uint32)
            except Exception as e:  # its regular expressions give up on some very long runs
                if "stack" not in str(e).lower() and "backtrack" not in str(e).lower():
                    raise
        if not full:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            full.append(Tokenizer.from_file(tokenizer))
        return np.asarray(full[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cuts(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens."""
    out = [(at, limit) for at in range(0, n - limit + 1, limit)]
    at = n - n % limit
    size = limit >> 1
    while size:
        if n & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


PIECES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]))


def _pieces(tokenizer: str, ranks: str | None, limit: int, texts: list[str]) -> pa.Array:
    encode, out = encoder(tokenizer, ranks), []
    for text in texts:
        ids = np.append(encode(text), np.uint32(END)).astype("<u4")
        out.append([{"start": at, "length": n, "doc_tokens": len(ids), "ids": ids[at : at + n].tobytes()} for at, n in cuts(len(ids), limit)])
    return pa.array(out, PIECES)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ranks: str | None = None, limit: int = LIMIT) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit numbers)."""
    if tokenizer is None:
        tokenizer, ranks = tokenizer_path(TOKENIZER), tokenizer_path(RANKS)
    schema = "array<struct<start:bigint,length:bigint,doc_tokens:bigint,ids:binary>>"
    made = per_text(docs.sparkSession, lambda texts: _pieces(tokenizer, ranks, limit, texts), schema, F.col("text"))
    return id_and_text(docs, id_col, text_col).select("doc_id", made.alias("made")).select("doc_id", F.explode("made").alias("p")).select("doc_id", "p.*")


def number(pieces: DataFrame) -> DataFrame:
    """pieces with sequence_id and offset: the bucket (log2 of the length), a hash cell and a number in it make the id.

    pieces has ids, or the checksum that digest() puts in their place.
    """
    sum_ = F.col("ids_crc32") if "ids_crc32" in pieces.columns else F.crc32("ids")
    # The checksum parts the pieces of rows without an id, or with one id.
    cell = F.pmod(F.xxhash64("doc_id", "start", sum_), F.lit(1 << CELLS))
    bucket = F.log2("length").cast("int").cast("long")
    p = pieces.withColumns({"__bucket": bucket, "__cell": cell, "__sum": sum_})
    order = Window.partitionBy("__bucket", "__cell").orderBy("doc_id", "start", "__sum")
    # 2**40 numbers a cell, 12 bits of cell, the bucket above.
    p = p.withColumn("sequence_id", F.col("__bucket") * (1 << (40 + CELLS)) + F.col("__cell") * (1 << 40) + F.row_number().over(order))
    return p.withColumn("offset", F.lit(0).cast("long")).drop("__bucket", "__cell", "__sum")


def pack(docs: DataFrame, **options) -> DataFrame:
    """The pieces with their ids, numbered as sequences."""
    return number(pieces(docs, **options))


def digest(pieces: DataFrame) -> DataFrame:
    """The same pieces, a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", *[c for c in pieces.columns if c in ("sequence_id", "offset")])
