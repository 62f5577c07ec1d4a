"""Removal of passages that repeat anywhere, by longest previous factors over a sparse suffix order.

A suffix order of every byte would move hundreds of bytes per byte, so texts meet at anchors: in every window of `length`
symbols the `gram` symbols of least hash are its anchor, which depends on the window's content alone, so equal windows
have equal anchors at equal offsets. About one byte in a hundred begins one. An anchor stands for a run of windows, and

* runs that are equal as wholes (two independent 64-bit fingerprints) repeat; of equal runs one goes on;
* the text around the remaining anchors of equal gram meets in one task, where its suffixes are put in order by content.
  The longest previous factor of each comes from its previous and next smaller positions in that order; a window whose
  factor is `length` long repeats. Tasks take such groups in chunks of bounded size;
* grams around which more than GROUP different runs remain (a passage of a great many documents) never meet in one task:
  their windows are counted by fingerprints instead, first in blocks of windows, by their union (equal: all repeat)
  and their core, the symbols that all hold (unique: none repeats), and window by window where neither decides.

Each counting step is an aggregation with map-side sums and a join that Spark may split; the smaller side of the largest
joins, unique by its key, is hashed and the other not sorted. Documents are keyed by the
digest of their text: copies are decided once. Symbols are bytes, or words by 64-bit hashes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import as_text, discard, documents, mark, materialize
from granary.llm.hashing import U, groups, mix, powers, prefix_sums, span_hashes, word_hashes
from granary.llm.suffix_order import longest_factors

LENGTH = 400
GRAM = 200
BLOCK = 15
#: Runs that may meet in one task for one gram; beyond it windows are counted. About 600 bytes each.
GROUP = 256
#: Windows that a task puts in order together, but for a larger group.
WINDOWS = 1 << 15
#: Bytes of texts that are read together: arrays of as many numbers stay in a processor's cache.
TOGETHER = 1 << 17
#: A passage is a run of more than so many words.
PASSAGE = 50


@dataclass(frozen=True)
class Unit:
    """What a window is: so many bytes, or so many words."""

    words: bool
    length: int
    gram: int
    block: int

    def read(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, symbols, offsets) of texts that are worked on together."""
        for i, data, offsets in groups(texts, TOGETHER):
            yield (i, *word_hashes(data, offsets)) if self.words else (i, data, offsets)

    def least_bytes(self) -> int:
        return 2 * self.length - 1 if self.words else self.length

    def named(self, h: np.ndarray) -> np.ndarray:
        """Hashes of words and of bytes are told apart."""
        return mix(h ^ U(0x6A09E667F3BCC909)) if self.words else h


def _sliding(x: np.ndarray, width: int, f: np.ufunc, rest: int) -> np.ndarray:
    """f over x[i : i + width] for every i, in two passes over blocks."""
    n = len(x)
    if n < width:
        return np.zeros(0, x.dtype)
    blocks = np.full((-(-n // width), width), rest, dtype=x.dtype)
    blocks.reshape(-1)[:n] = x
    ahead = f.accumulate(blocks, axis=1).reshape(-1)
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text's number, place of the anchor, hash, lo, hi): the anchor's windows start lo to hi symbols before it."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, U), none, none
    top = np.iinfo(U).max
    sums, (_, down) = prefix_sums(data), powers(n + 1)
    h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1]) >> U(1) | U(1)  # neither 0 nor the greatest
    inner = [(int(a), int(b)) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if a < b]
    for a, b in inner:
        h[max(a, b - gram + 1) : b] = top
    least = _sliding(h, width, np.minimum, top)
    for a, b in inner:
        least[max(a, b - length + 1) : b] = 0  # no window of one text
    edged = np.zeros(len(least) + 2 * width - 2, U)
    edged[width - 1 : width - 1 + len(least)] = least
    chosen = np.flatnonzero((_sliding(edged, width, np.maximum, 0)[: len(h)] == h) & (h < top))
    edge = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(least)]]) - 1
    real = least[first] > 0
    first, last = first[real], last[real]
    a, b = np.searchsorted(chosen, first), np.searchsorted(chosen, last + width - 1, side="right")
    run = np.repeat(np.arange(len(first)), b - a)
    at = chosen[np.arange(len(run)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[run]]
    same = h[at] == least[first[run]]
    run, at = run[same], at[same]
    hi, lo = at - np.maximum(first[run], at - width + 1), at - np.minimum(last[run], at)
    return np.searchsorted(offsets, at, side="right") - 1, at, h[at], lo, hi


ANCHORED = "digest binary, words boolean, n int, hash array<long>, run array<long>, place array<int>, lo array<int>, hi array<int>"


def anchored(slim: DataFrame, units: list[Unit]) -> DataFrame:
    """For each text and unit: how many symbols it has, and its anchors with a fingerprint of the run of windows of each."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in units:
                for i, data, offsets in unit.read(batch.column("text")):
                    of, at, h, lo, hi = anchors(data, offsets, unit.length, unit.gram)
                    order = np.lexsort((at, of))
                    of, at, h, lo, hi = (x[order] for x in (of, at, h, lo, hi))
                    run = mix(span_hashes(prefix_sums(data, 1), at - hi, at - lo + unit.length) ^ mix((lo * (unit.length + 1) + hi).astype(U)))
                    n = len(offsets) - 1
                    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]), pa.int32())
                    columns = [unit.named(h).view(np.int64), run.view(np.int64), *[x.astype(np.int32) for x in (at - offsets[of], lo, hi)]]
                    lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]
                    own = [batch.column("digest").slice(i, n), pa.array(np.full(n, unit.words)), pa.array(np.diff(offsets), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*own, *lists], names=["digest", "words", "n", "hash", "run", "place", "lo", "hi"])

    return slim.mapInArrow(find, ANCHORED)


def _flat(batch: pa.RecordBatch, column: str, i: int, n: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(text's number, fields) of a list of structs, for texts i to i + n."""
    items = batch.column(column).slice(i, n)
    of = np.repeat(np.arange(n), items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = items.flatten()
    return of, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


SNIPPET = "id long, words boolean, hash long, start int, piece binary, owner long, rep long, digest binary"


def snippets(found: DataFrame, units: list[Unit]) -> DataFrame:
    """The symbols of all windows of each anchor that must be told apart, in one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in units:
                for i, data, offsets in unit.read(batch.column("text")):
                    of, x = _flat(batch, "marks", i, len(offsets) - 1)
                    keep = x["tell"].astype(bool) & ~x["hot"].astype(bool) & (x["words"].astype(bool) == unit.words)
                    of, x = of[keep], {k: v[keep] for k, v in x.items()}
                    a = x["place"] - x["hi"] + offsets[of]
                    b = x["place"] - x["lo"] + unit.length + offsets[of]
                    row = pa.array(i + of)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("id").take(row), pa.array(np.full(len(of), unit.words)), pa.array(x["hash"]), pa.array((x["place"] - x["hi"]).astype(np.int32)),
                        pa.array([data[p:q].tobytes() for p, q in zip(a, b, strict=True)], pa.binary()), *[batch.column(c).take(row) for c in ("owner", "rep", "digest")],
                    ], names=["id", "words", "hash", "start", "piece", "owner", "rep", "digest"])

    return found.select("id", "owner", "rep", "digest", "text", "marks").mapInArrow(cut, SNIPPET)


def _spans(group: pa.Table, unit: Unit, keep_first: bool) -> pa.RecordBatch:
    """The spans of the windows that repeat among whole groups of pieces: bytes anywhere, words in another text."""
    pieces = group.column("piece").combine_chunks()
    size = 8 if unit.words else 1
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    symbols = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    symbols = symbols.copy().view(np.uint64) if unit.words else symbols
    ends = (ends - ends[0]) // size
    many = np.diff(ends) - unit.length + 1
    row = np.repeat(np.arange(len(many)), many)
    back = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    ids = group.column("id").to_numpy()
    start = group.column("start").to_numpy()[row] + back
    order = np.lexsort((start, ids[row]))
    once = np.ones(len(order), bool)  # a window in which two equal grams tie is in two pieces
    once[1:] = (np.diff(start[order]) != 0) | (np.diff(ids[row][order]) != 0)
    order = order[once]
    row, start, first = row[order], start[order], (ends[row] + back)[order]
    if unit.words:
        place = np.unique(group.column("owner").to_numpy(), return_inverse=True)[1][row]
    else:
        texts = np.rec.fromarrays([group.column("rep").to_numpy(), np.array(group.column("digest").to_pylist(), dtype="S32")])
        place = np.unique(texts, return_inverse=True)[1].reshape(-1)[row] << 32 | start
    gone = longest_factors(symbols, first, place.astype(np.int64), unit.length, unit.words or not keep_first) >= unit.length
    i, a = ids[row][gone], start[gone]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (i[1:] != i[:-1]) | (a[1:] > a[:-1] + unit.length)
    begins = np.flatnonzero(fresh)
    last = np.append(begins[1:], len(a))[: len(begins)] - 1
    columns = [pa.array(i[begins]), pa.array(np.full(len(begins), unit.words)), pa.array(a[begins].astype(np.int32)), pa.array((a[last] + unit.length).astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["id", "words", "start", "end"])


def repeated_windows(pieces: DataFrame, units: list[Unit], keep_first: bool) -> DataFrame:
    """Spans of the windows that repeat, from pieces whose windows all meet: those of equal hash, in suffix order."""

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(upto: pa.Table) -> Iterator[pa.RecordBatch]:
            hashes, words = upto.column("hash").to_numpy(), upto.column("words").to_numpy()
            edges = np.append(np.flatnonzero(np.diff(hashes) != 0) + 1, len(hashes))
            a = 0
            for k, b in enumerate(edges):  # as many groups of one unit at once as make up about WINDOWS windows
                unit = next(u for u in units if u.words == words[a])
                if k == len(edges) - 1 or b - a >= WINDOWS // (unit.length - unit.gram + 1) or words[b] != words[a]:
                    yield _spans(upto.slice(a, b - a), unit, keep_first)
                    a = b

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            hashes = batch.column("hash").to_numpy()
            if hashes[0] == hashes[-1] and (len(held) == 1 or held[-2].column("hash")[-1].as_py() == hashes[0]):
                continue
            table = pa.Table.from_batches(held)
            cut = len(table) - int((hashes == hashes[-1]).sum())
            yield from done(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return pieces.repartition("hash").sortWithinPartitions("words", "hash").mapInArrow(whole_groups, "id long, words boolean, start int, end int")


def block_prints(found: DataFrame, unit: Unit) -> DataFrame:
    """For each block of windows of each anchor of a hot gram: the prints of its core and of its union."""
    length, block = unit.length, unit.block

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, data, offsets in unit.read(batch.column("text")):
                of, x = _flat(batch, "marks", i, len(offsets) - 1)
                keep = x["tell"].astype(bool) & x["hot"].astype(bool) & (x["words"].astype(bool) == unit.words)
                of, x = of[keep], {k: v[keep] for k, v in x.items()}
                if not len(of):
                    continue
                sums = prefix_sums(data, 1)
                b0, b1 = x["lo"] // block, x["hi"] // block
                many = b1 - b0 + 1
                row = np.repeat(np.arange(len(of)), many)
                b = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + b0[row]
                at = x["place"][row] + offsets[of[row]]
                x1, x2 = b * block, b * block + block - 1  # windows start x1 to x2 before the anchor
                core = mix(span_hashes(sums, at - x1, at - x2 + length))
                whole = (at - x2 >= offsets[of[row]]) & (at - x1 + length <= offsets[of[row] + 1])
                a, z = np.where(whole, at - x2, 0), np.where(whole, at - x1 + length, 0)
                union = mix(span_hashes(sums, a, z))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[i + of[row]]), pa.array(x["hash"][row]), pa.array(x["place"][row]), pa.array(b.astype(np.int32)),
                    pa.array(x["lo"][row]), pa.array(x["hi"][row]), pa.array(core.view(np.int64)), pa.array(union.view(np.int64), mask=~whole),
                ], names=["id", "hash", "place", "block", "lo", "hi", "core", "union"])

    return found.mapInArrow(prints, "id long, hash long, place int, block int, lo int, hi int, core long, union long")


def window_prints(found: DataFrame, unit: Unit) -> DataFrame:
    """The print of every window of the blocks in `open`."""
    length, block = unit.length, unit.block

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, data, offsets in unit.read(batch.column("text")):
                of, x = _flat(batch, "open", i, len(offsets) - 1)
                if not len(of):
                    continue
                sums = prefix_sums(data, 1)
                x1, x2 = np.maximum(x["block"] * block, x["lo"]), np.minimum(x["block"] * block + block - 1, x["hi"])
                many = x2 - x1 + 1
                row = np.repeat(np.arange(len(of)), many)
                back = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + x1[row]
                start = x["place"][row] - back
                begin = offsets[of[row]] + start
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[i + of[row]]), pa.array(x["hash"][row]), pa.array(start.astype(np.int32)), pa.array(mix(span_hashes(sums, begin, begin + length)).view(np.int64)),
                ], names=["id", "hash", "start", "window"])

    return found.mapInArrow(prints, "id long, hash long, start int, window long")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with the columns of b of equal keys."""
    on = F.lit(True)
    for k in keys:
        on = on & (a[k] == b[f"_{k}"])
    return a.join(b, on).drop(*[f"_{k}" for k in keys])


def _counted(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """The first and last place of each combination of keys, how often it occurs, and whether that is repetition."""
    many = F.when(F.first("words"), F.min("owner") < F.max("owner")).otherwise(F.count(F.lit(1)) > 1)
    some = [F.count(F.lit(1)).alias(f"{prefix}_n"), F.min("at").alias(f"{prefix}_first"), F.max("at").alias(f"{prefix}_last"), many.alias(f"{prefix}_many")]
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*some)


def _hot_spans(found: DataFrame, unit: Unit, keep_first: bool) -> DataFrame:
    """Spans of the windows of hot grams that repeat, by counting fingerprints."""
    own = found.select(F.col("id").alias("_id"), "owner", "rep", "digest")
    first_stays = keep_first and not unit.words

    def named(df: DataFrame, place: str) -> DataFrame:
        df = _same(df, own, ["id"]) if keep_first or unit.words else df.withColumn("owner", F.lit(0))
        at = F.struct("rep", "digest", F.col(place).alias("place")) if keep_first else F.struct("id", F.col(place).alias("place"))
        return df.withColumns({"at": at, "words": F.lit(unit.words)})

    mine = found.filter(F.exists("marks", lambda m: m["tell"] & m["hot"] & (m["words"] == F.lit(unit.words))))
    blocks = materialize(named(block_prints(mine.select("id", "text", "marks"), unit), "place"), "blocks")
    cores = _counted(blocks, ["hash", "block", "core"], "core").filter("core_many")
    unions = _counted(blocks.filter("union is not null"), ["hash", "block", "union"], "union").filter("union_many")
    told = _same(blocks, cores, ["hash", "block", "core"])
    on = (told["hash"] == unions["_hash"]) & (told["block"] == unions["_block"]) & (told["union"] == unions["_union"])
    told = told.join(unions, on, "left").drop("_hash", "_block", "_union")
    earlier = (lambda c: F.col(f"{c}_first") < F.col("at")) if first_stays else (lambda c: F.lit(True))
    whole = F.coalesce(F.col("union_many") & earlier("union"), F.lit(False))
    told = materialize(told.select("id", "hash", "place", "block", "lo", "hi", "core", whole.alias("whole"), (F.col("at") == F.col("union_first")).alias("mine")), "told-blocks")
    block, length = unit.block, unit.length
    spans = told.filter("whole").select("id", (F.col("place") - F.col("block") * block - (block - 1)).alias("start"), (F.col("place") - F.col("block") * block + length).alias("end"))
    # Where windows must be told one by one, those of blocks that repeat whole are there to be met: one block of each
    # kind, or where texts must differ, each.
    unclear = told.filter("not whole").groupBy(*[F.col(k).alias(f"_{k}") for k in ("hash", "block", "core")]).agg(F.count(F.lit(1)).alias("unclear"))
    met = told.filter("whole" if unit.words else "whole and mine")
    open_ = told.filter("not whole").unionByName(_same(met, unclear, ["hash", "block", "core"]).drop("unclear"))
    open_ = open_.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("hash", "place", "block", "lo", "hi")).alias("open"))
    windows = window_prints(_same(found.select("id", "text"), open_, ["id"]).select("id", "text", "open"), unit)
    # A window in which two equal grams tie has two anchors, but is one window.
    windows = materialize(named(windows, "start").dropDuplicates(["id", "hash", "start"]), "windows")
    again = _counted(windows, ["hash", "window"], "window").filter("window_many")
    again = _same(windows, again, ["hash", "window"]).filter(earlier("window"))
    return spans.unionByName(again.select("id", "start", (F.col("start") + length).alias("end"))).withColumn("words", F.lit(unit.words))


def repeated_spans(slim: DataFrame, copies: DataFrame, units: list[Unit], keep_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts: id, digest, text; spans: id and the lists spans, of bytes, and passages, of words; sizes: digest, n words).

    slim: doc_id, text, digest. copies: digest, copies, rep. Of equal texts, one is judged.
    """
    least = min(u.least_bytes() for u in units)
    lists = materialize(anchored(slim.filter(F.octet_length("text") >= least).select("digest", "text"), units), "anchors")
    at_lists = mark() - 1
    sizes = materialize(lists.filter("words").select("digest", "n").dropDuplicates(["digest"]), "sizes")
    if keep_first:
        lists = _same(lists, copies.select(F.col("digest").alias("_digest"), "rep"), ["digest"])
    rep = F.coalesce("rep", F.lit(-(2**63)))
    marks = lists.select("digest", F.xxhash64("digest").alias("owner"), "words", *([rep.alias("rep")] if keep_first else []), F.inline(F.arrays_zip("hash", "run", "place", "lo", "hi")))
    place = F.xxhash64("digest", "place")
    # Of words, the first and the last place stand in different texts if any two do.
    apart = F.col("owner").bitwiseAND(F.lit(-(2**32))).bitwiseOR(place.bitwiseAND(F.lit(2**32 - 1)))
    marks = marks.withColumn("at", F.struct("rep", "digest", "place") if keep_first else F.when(F.col("words"), apart).otherwise(place))
    # Equal texts hold equal anchors: where the first stays they are one text, else each counts.
    each = marks.dropDuplicates(["digest", "place", "hash"]) if keep_first else marks
    # Only words ask whose they are; a null is cheap to move.
    runs = materialize(_counted(each.withColumn("owner", F.when(F.col("words"), F.col("owner"))), ["hash", "run"], "run"), "runs")
    at_runs = mark() - 1
    # How many occurrences go on: of runs that repeat one, of others each.
    tells = F.sum(F.when(F.col("run_many"), 1).otherwise(F.col("run_n")))
    per = runs.groupBy(F.col("_hash").alias("_h")).agg(F.sum("run_n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.count_if(~F.col("run_many")).alias("lone"), tells.alias("tells")).filter("total > 1")
    shared = materialize(runs.join(per.hint("shuffle_hash"), F.col("_hash") == F.col("_h")).select("_hash", "_run", "run_first", "run_last", "run_many", (F.col("kinds") > 1).alias("others"), (F.col("lone") > 0).alias("lone"), (F.col("tells") > GROUP).alias("hot")), "shared-runs")
    at_shared = mark() - 1
    discard(at_runs)
    mine = (F.col("at") == F.col("run_first")) | (F.col("words") & (F.col("at") == F.col("run_last")))
    first_stays = ~F.col("words") if keep_first else F.lit(False)
    gone = F.col("run_many") & ~(first_stays & mine)
    tell = F.col("others") & (~F.col("run_many") & ~first_stays | mine & (F.col("lone") | first_stays))
    hits = _same(each, shared.hint("shuffle_hash"), ["hash", "run"]).select("digest", F.struct("words", "hash", "place", "lo", "hi", gone.alias("gone"), tell.alias("tell"), "hot").alias("m"))
    # A set, since copies bring equal marks: it is no larger than one text's.
    hits = hits.filter("m.gone or m.tell").groupBy(F.col("digest").alias("_digest")).agg(F.collect_set("m").alias("marks"))
    hits = hits.join(copies, F.col("_digest") == F.col("digest")).drop("digest")
    # Copies are decided as wholes, and are read on only to be met by others; where the first stays, its bytes are not.
    needed = F.filter("marks", lambda m: m["tell"] | (~m["words"] if keep_first else F.lit(False)))
    hits = hits.withColumn("marks", F.when(F.col("copies") > 1, needed).otherwise(F.col("marks"))).filter(F.size("marks") > 0)
    hits = materialize(hits.select("_digest", "rep", "marks"), "hits")
    at_hits = mark() - 1
    discard(at_lists)
    discard(at_shared)
    found = slim.join(hits.hint("shuffle_hash"), (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    found = found.select("digest", F.xxhash64("digest").alias("owner"), rep.alias("rep"), "text", "marks", F.monotonically_increasing_id().alias("id"))
    found = materialize(found, "marked-texts")
    discard(at_hits)
    each_mark = found.select("id", F.explode("marks").alias("m"))
    length = F.lit(0)
    for u in units:
        length = F.when(F.col("m.words") == F.lit(u.words), u.length).otherwise(length)
    spans = each_mark.filter("m.gone").select("id", "m.words", (F.col("m.place") - F.col("m.hi")).alias("start"), (F.col("m.place") - F.col("m.lo") + length).alias("end"))
    pieces = snippets(found.filter(F.exists("marks", lambda m: m["tell"] & ~m["hot"])), units)
    spans = spans.unionByName(materialize(repeated_windows(pieces, units, keep_first), "repeated-windows"))
    for u in units:
        if not each_mark.filter("m.tell and m.hot").filter(F.col("m.words") == F.lit(u.words)).isEmpty():
            spans = spans.unionByName(_hot_spans(found, u, keep_first))
    span = F.struct("start", "end")
    spans = spans.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.when(~F.col("words"), span)).alias("spans"), F.collect_list(F.when(F.col("words"), span)).alias("passages"))
    return found.select("id", "digest", "text"), spans, sizes


def _covered(of: np.ndarray, x: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many symbols the spans of each text cover, and in how many runs."""
    order = np.lexsort((x["start"], of))
    of = of[order]
    a, b = (x[k][order].astype(np.int64) + (of << 32) for k in ("start", "end"))
    before = np.concatenate([[-1], np.maximum.accumulate(b)[:-1]])[: len(b)]
    symbols = np.bincount(of, weights=np.maximum(0, b - np.maximum(a, before)), minlength=n)
    return symbols.astype(np.int64), np.bincount(of[a > before], minlength=n)


RESULT = "digest binary, n_removed long, n_spans long, kept_digest binary, kept_text string, passage_words long, passages long"


def _results(found: DataFrame, with_text: bool) -> DataFrame:
    """The result of each text, from its spans of bytes and of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, texts = [], []
            for i, data, offsets in groups(batch.column("text")):
                of, x = _flat(batch, "spans", i, len(offsets) - 1)
                depth = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(depth, x["start"] + offsets[of], 1)
                np.add.at(depth, x["end"] + offsets[of], -1)
                stays = np.cumsum(depth)[:-1] <= 0
                for a, b in zip(offsets, offsets[1:], strict=False):
                    kept = data[a:b][stays[a:b]].tobytes()
                    digests.append(hashlib.sha256(kept).digest())
                    texts.append(kept.decode("utf-8", "replace") if with_text else "")
            n = batch.num_rows
            counts = [pa.array(c) for name in ("spans", "passages") for c in _covered(*_flat(batch, name, 0, n), n)]
            columns = [batch.column("digest"), *counts[:2], pa.array(digests, pa.binary()), pa.array(texts, pa.string()), *counts[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "n_removed", "n_spans", "kept_digest", "kept_text", "passage_words", "passages"])

    return found.mapInArrow(cut, RESULT)


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, keep_first: bool = False, with_text: bool = False, words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept text if asked for.

    Texts are UTF-8 bytes; a null text is empty. Every byte of a string of `length` bytes that also starts elsewhere, in
    the same document or another, is removed; with keep_first the string that comes first by (doc_id, digest, place)
    stays, and of equal texts one row of the least doc_id (a null doc_id comes first). What repeats is judged on the
    input. A kept text cut inside a character has a replacement mark there; kept_sha256 is of the bytes. Texts shorter
    than `length` stay whole. Repeated rows are copies like others; no rows give no rows; further columns are not read.

    With `words`, also passage_words and passages: how many words stand in runs of more than `words` words that another
    document holds too, and in how many such runs, whatever their bytes. They are reported and not removed.
    """
    body = as_text(text)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = slim.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("uid"))
    rows = materialize(rows, "texts")
    least = length if words is None else min(length, 2 * words + 1)
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("uid").alias("c")))
    copies = rows.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("bytes"), first.alias("first"))
    copies = materialize(copies.select("digest", "copies", "bytes", F.col("first.b").alias("rep"), F.col("first.c").alias("rep_uid")), "copies")
    units = [Unit(False, length, gram, block)]
    if words is not None:
        units.append(Unit(True, words + 1, (words + 1) // 2 + 1, 4))
    found, spans, sizes = repeated_spans(slim, copies.select("digest", "copies", "rep"), units, keep_first)
    done = _results(_same(found, spans, ["id"]).select("digest", "text", "spans", "passages"), with_text)
    done = done if with_text else done.drop("kept_text")
    done = materialize(done.dropDuplicates(["digest"]).withColumnRenamed("digest", "_digest"), "removed")
    many = copies.filter("copies > 1").select(F.col("digest").alias("_copy"), "rep_uid", "bytes")
    many = many.join(sizes, F.col("_copy") == F.col("digest"), "left").drop("digest")
    out = rows.join(done, F.col("digest") == F.col("_digest"), "left").join(many, F.col("digest") == F.col("_copy"), "left")
    copied = F.coalesce(F.col("bytes") >= length, F.lit(False))
    if keep_first:
        copied = copied & (F.col("uid") != F.col("rep_uid"))
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    result = [
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(copied, nothing).otherwise(F.coalesce("kept_digest", "digest")))).alias("kept_sha256"),
    ]
    if with_text:
        result.append(F.when(copied, "").otherwise(F.col("kept_text")).alias("kept_text"))
    if words is not None:  # a text that another row equals is one passage, if it has as many words
        whole = F.col("n") > words
        result.append(F.when(whole, F.col("n")).otherwise(F.coalesce("passage_words", F.lit(0))).cast("long").alias("passage_words"))
        result.append(F.when(whole, F.lit(1)).otherwise(F.coalesce("passages", F.lit(0))).cast("long").alias("passages"))
    return out.select(*result)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the passages of more than PASSAGE words that other documents hold too: so many words
    may be fewer than LENGTH bytes, which stay."""
    return repeated_passages(documents(spark, sf_dir), words=PASSAGE)
