"""Harmonic packing of tokenized documents into sequences of a fixed length.

A document of n tokens is cut into whole sequences, then into at most one piece each of a half, a quarter and an eighth
of a sequence, and a tail. A piece's class is the number of pieces of its length that fit a sequence, so that a bin of
class k holds k pieces, whatever they are: a worker needs only a piece's rank in its class to know its bin, and bins
fill independently of each other. Exact fractions leave no padding; a bin of tails of class k leaves less than one part
in k + 1. The last bin of each class may lack pieces: those left over, fewer than k of each class whatever the input's
size, share sequences by first fit.

Token ids are made once, where the text is read; from there on only slim rows (lengths and checksums) move.
"""
from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import as_text, documents, materialize, running_sums

CAPACITY = 2048
#: Remainders are cut to exact fractions of the capacity down to this part of it.
CUT_DOWN_TO = 8
END_ID = 1


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None):
    """text -> ids as a uint32 array, as the tokenizers library gives them without added special tokens.

    With ranks (the same vocabulary as a rank file) the faster library of the two does the work; it knows no special
    strings, so a text that holds one goes to the slower.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    exact = lambda x: np.array(slow.encode(x, add_special_tokens=False).ids, dtype=np.uint32)
    if not ranks:
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(x: str) -> np.ndarray:
        if any(s in x for s in special):
            return exact(x)
        try:
            return fast.encode_to_numpy(x)
        except BaseException as e:  # its pattern library gives up on very long runs of white space
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            return exact(x)

    return encode


def piece_lengths(n: int, capacity: int = CAPACITY, down_to: int = CUT_DOWN_TO) -> list[int]:
    out = [capacity] * (n // capacity)
    n %= capacity
    part = capacity
    while part * down_to > capacity and n:
        part //= 2
        if n >= part:
            out.append(part)
            n -= part
    return out + [n] * (n > 0)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize and cut: doc_id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_text(text).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            rows: list[tuple] = []
            for i, x in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = np.append(encode(x), END_ID).astype("<u4")
                at, n = 0, len(ids)
                for k in piece_lengths(n, capacity):
                    own = ids[at : at + k]
                    rows.append((i, at, k, zlib.crc32(own.tobytes()), n) + ((own.astype(np.int64).tolist(),) if with_ids else ()))
                    at += k
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return slim.mapInPandas(cut, PIECES + ", ids array<long>" * with_ids)


def first_fit(left: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(class, rank, bin, offset) of what no full bin holds; longest first."""
    room: list[int] = []
    out = []
    for k, rank, length in sorted(left, key=lambda x: (-x[2], x[0], x[1])):
        at = next((i for i, r in enumerate(room) if r >= length), None)
        if at is None:
            room.append(capacity)
            at = len(room) - 1
        out.append((k, rank, at, capacity - room[at]))
        room[at] -= length
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be cheap to read again and have length and uid.

    Sequences hold at most `capacity` tokens; offsets in each run from 0 without gaps.
    """
    spark = pieces.sparkSession
    classed = pieces.withColumn("_class", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
    sizes = sorted((r["_class"], r["n"]) for r in classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect())  # at most `capacity` classes
    first = 0
    starts = []
    for k, n in sizes:
        starts.append((k, first, n // k * k))
        first += n // k
    table = F.broadcast(spark.createDataFrame(starts, "_class long, _first long, _full long"))
    ranked = running_sums(classed, ["_class"], F.xxhash64("uid"), {"_rank": F.lit(1)}, sum(n for _, n in sizes), ["uid"]).join(table, "_class")
    bins = ranked.filter("_rank < _full").withColumn("sequence_id", F.expr("_first + _rank div _class"))
    inside = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    rest = ranked.filter("_rank >= _full")
    left = first_fit([tuple(r) for r in rest.select("_class", "_rank", "length").collect()], capacity)  # fewer than k of each class k
    place = F.broadcast(spark.createDataFrame([(k, r, first + b, o) for k, r, b, o in left], "_class long, _rank long, sequence_id long, offset long"))
    rest = rest.join(place, ["_class", "_rank"])
    return bins.select(*pieces.columns, "sequence_id", "offset").unionByName(rest.select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Every id of every row lies in exactly one piece; repeated rows are packed
    as often as they occur; no rows give no rows; further columns are not read.
    """
    pieces = materialize(cut_pieces(docs, vocabulary, ranks, text, doc_id, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity).drop("uid")


#: Vocabularies are files of an installed package; nothing is copied here.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
