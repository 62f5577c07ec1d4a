"""MinHash near-dedup with DartMinHash signatures.

A text is a weighted set of five-word windows. Each element owns a region as wide as its weight; darts fall on the
regions as a Poisson process whose gaps are hashes of the region alone, so that two sets see the same darts wherever
their regions overlap. Each dart has a rank and a coordinate of the signature, and the dart of least rank wins its
coordinate: two signatures agree in a coordinate with the probability of the weighted Jaccard similarity. Only darts
below a rank that falls with the set's weight are thrown, about t log t for t coordinates whatever the set's size.

Signatures are joined by bands. Texts with equal sets are one representative. In a bucket, every member is compared
with one centre; members that it does not connect lead in turn, some at first and more in each round, and are compared
with what is not yet connected to them, unless the triangle inequality of the Jaccard distance to the centre shows that
a pair can't be similar. So no link between two texts that share a band is lost that would join two classes, and a bucket
of near copies costs a few comparisons a member. Similarities are those of the whole sets.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import as_text, discard, documents, free, mark, materialize, without_ids
from granary.llm.hashing import U, groups, mix, shingles

BANDS, ROWS = 24, 5
#: Similar from NUMERATOR / DENOMINATOR on: 0.8.
NUMERATOR, DENOMINATOR = 4, 5
WORDS = 5
#: Members of a bucket that lead in the first round of comparisons beyond the centre's; eight times as many in the next.
LEADERS = 64
#: Classes of window hashes in which sets are counted to bound what two of them share.
CLASSES = 128


def _gaps(cells: np.ndarray, throw: int) -> np.ndarray:
    """Exponential gaps between a region's darts, of hashes of region and number."""
    h = mix(cells + U(throw) * U(0xD6E8FEB86659FD93))
    return -np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def dart_signatures(of: np.ndarray, cells: np.ndarray, sets: int, coordinates: int) -> np.ndarray:
    """One row per set, the least rank in each coordinate; infinite for a set without elements.

    of: the set of each unit region; cells: the region's hash. An element of weight w has w unit regions.
    """
    best = np.full(sets * coordinates, np.inf)
    weight = np.bincount(of, minlength=sets).astype(np.float64)
    limit = (coordinates * np.log(coordinates) + 4.0 * coordinates) / np.maximum(weight, 1)
    rank = _gaps(cells, 0)
    todo, own, number = np.arange(len(of)), of, np.zeros(len(of), dtype=np.int64)
    pending = np.flatnonzero(weight > 0)
    while len(pending):
        throw = 0
        here = todo
        while len(here):  # all darts below the limit
            hit = here[rank[here] < limit[own[here]]]
            if not len(hit):
                break
            k = number[hit]
            column = (mix(cells[hit] ^ mix(k.astype(U) + U(0xA24BAED4963EE407))) % U(coordinates)).astype(np.int64)
            np.minimum.at(best, own[hit] * coordinates + column, rank[hit])
            number[hit] = k + 1
            h = mix(cells[hit] + (k + 1).astype(U) * U(0xD6E8FEB86659FD93))
            rank[hit] += -np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            here = hit
            throw += 1
        open_ = np.isinf(best.reshape(sets, coordinates)).any(axis=1) & (weight > 0)
        pending = np.flatnonzero(open_)
        limit[pending] *= 1.5  # throw on for sets with an empty coordinate
        todo = np.flatnonzero(open_[own])
    return best.reshape(sets, coordinates)


def unit_regions(of: np.ndarray, elements: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """The regions of each set, sorted: one per element, or one per occurrence if elements weigh as often as they occur."""
    order = np.lexsort((elements, of))
    of, elements = of[order], elements[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (elements[1:] != elements[:-1])
    if not weighted:
        return of[new], elements[new]
    first = np.flatnonzero(new)
    nth = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    return of, np.where(nth > 0, mix(elements + nth.astype(U)), elements)


SIGNED = "doc_id long, regions array<int>, digest binary, bands array<long>"


def signed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", weighted: bool = False, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, name: Column | None = None) -> DataFrame:
    """doc_id, regions (32 bits of the hash of every element), a digest of the set, a hash for each band, and name."""
    names = [] if name is None else ["name"]
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_text(text).alias("text"), *[name.alias(c) for c in names])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, data, offsets in groups(batch.column("text")):
                n = len(offsets) - 1
                of, cells = unit_regions(*shingles(data, offsets, words), weighted)
                best = dart_signatures(of, cells, n, bands * rows)
                sig = mix(best.view(U).reshape(n, bands, rows))
                keys = np.zeros((n, bands), dtype=U)
                for r in range(rows):
                    keys = mix(keys + sig[:, :, r] + U(r + 1))
                keys = mix(keys + np.arange(1, bands + 1, dtype=U) * U(0x2545F4914F6CDD1D)).view(np.int64)
                size = np.bincount(of, minlength=n)
                ends = np.concatenate([[0], np.cumsum(size)])
                a, b = (np.add.reduceat(np.append(mix(cells ^ U(s)), U(0)), ends[:-1]) * (size > 0).astype(U) for s in (11, 23))
                digest = np.stack([a, b], axis=1).tobytes()
                some = np.where(size > 0, bands, 0)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, n),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((cells >> U(32)).astype(np.uint32).view(np.int32))),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * 16).tobytes()), pa.py_buffer(digest)]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]), pa.int32()), pa.array(keys[size > 0].reshape(-1))),
                    *[batch.column(c).slice(at, n) for c in names],
                ], names=["doc_id", "regions", "digest", "bands", *names])

    return slim.mapInArrow(sign, SIGNED + "".join(f", {c} binary" for c in names))


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and the exact shared and united sizes of each pair's sets."""
    left = sets.select(F.col("uid").alias("_b"), F.col("regions").alias("_rb"))
    right = sets.select(F.col("uid").alias("_a"), F.col("regions").alias("_ra"))
    both = pairs.join(left, F.col("b") == F.col("_b")).join(right, F.col("a") == F.col("_a"))
    both = both.select("a", "b", F.size(F.array_intersect("_ra", "_rb")).alias("shared"), (F.size("_ra") + F.size("_rb")).alias("both"))
    return both.select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("united"))


def _similar() -> Column:
    return DENOMINATOR * F.col("shared") >= NUMERATOR * F.col("united")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of edges (a, b): alternating large and small stars.

    Each round takes the least neighbour by a partial aggregation and a join; no node's neighbours meet in one task.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "_u")
        large = both.join(low, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = large.join(low, F.col("u") == F.col("_u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        after = materialize(small, "edges")
        many, again = after.count(), after.groupBy("u").count().filter("count > 1")
        if not many or (again.isEmpty() and after.select("u").intersect(after.select("v")).isEmpty()):
            return materialize(after.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")
        now = after


def _with_labels(df: DataFrame, labels: DataFrame, key: str, out: str) -> DataFrame:
    named = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return df.join(named, F.col(key) == F.col("_node"), "left").withColumn(out, F.coalesce("_label", F.col(key))).drop("_node", "_label")


def _overlap_bounds(far: DataFrame, buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of open buckets with the size of each set, and a histogram of those of its windows that another set of
    these buckets holds, by classes of the windows' hashes.

    Two sets share no more in a class than the lesser of their two counts. Copies that were edited apart from each
    other miss windows in different classes, and need not be compared.
    """
    far = far.join(buckets.select("_key"), F.col("key") == F.col("_key"), "left_semi")
    those = materialize(sets.join(far.select("uid").distinct(), "uid", "left_semi"), "open-sets")
    once = those.select("uid", F.explode("regions").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid")).filter("n = 1")
    alone = once.groupBy("uid").agg(F.collect_list("x").alias("alone")).withColumnRenamed("uid", "_uid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total = np.zeros(n * CLASSES, dtype=np.int32)
            for name, sign in (("regions", 1), ("alone", -1)):
                column = batch.column(name)
                of = np.repeat(np.arange(n), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                total += sign * np.bincount(of * CLASSES + column.flatten().to_numpy() % CLASSES, minlength=n * CLASSES).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(batch.column("regions").value_lengths().to_numpy(), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * CLASSES, pa.int32()), pa.array(total))], names=["_uid", "size", "common"])

    joined = those.join(alone, F.col("uid") == F.col("_uid"), "left").select("uid", "regions", "alone")
    sizes = joined.mapInArrow(count, "_uid long, size int, common array<int>")
    return far.join(sizes, F.col("uid") == F.col("_uid")).drop("_uid")


def links(signatures: DataFrame, read: Callable[[], None] = lambda: None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(representatives, links between them, their labels). signatures: a written table of signed() with uid.

    read is called when signatures are not needed any more.
    """
    chosen = materialize(signatures.filter(F.size("bands") > 0).groupBy("digest").agg(F.min("uid").alias("rep")), "representatives")
    keep = chosen.select(F.col("rep").alias("uid"))
    banded = signatures.join(keep, "uid", "left_semi").select("uid", F.explode("bands").alias("key"))
    full = banded.groupBy("key").agg(F.min("uid").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("_key"), "centre")
    members = materialize(banded.join(full, F.col("key") == F.col("_key")).select("key", "centre", "uid"), "buckets")
    pairs = materialize(members.filter("uid <> centre").select(F.col("centre").alias("a"), F.col("uid").alias("b")).distinct(), "pairs")
    # From here on only sets that share a band with another are read; the others move once, in this join.
    # Ids and pairs are written before they are joined, so that Spark knows whether they are small.
    ids = materialize(members.select("uid").distinct(), "member-ids")
    sets = materialize(signatures.select("uid", "regions").join(ids, "uid", "left_semi"), "sets")
    read()
    seen = materialize(similarities(pairs, sets), "similarities")
    found = seen.filter(_similar()).select("a", "b")
    labels = components(found)
    # What a centre leaves apart. Members of a bucket know their distance to its centre, and differ by at most 1 - 0.8.
    known = seen.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (1 - F.col("shared") / F.col("united")).alias("d"))
    far = members.join(known, (F.col("centre") == F.col("_a")) & (F.col("uid") == F.col("_b"))).select("key", "uid", "d", F.col("centre").alias("first"), F.col("uid").alias("node"))
    done = seen.select("a", "b")
    near = 1 - NUMERATOR / DENOMINATOR + 1e-9
    leaders = LEADERS
    while True:
        far = _with_labels(_with_labels(far, labels, "node", "label"), labels, "first", "own")
        far = materialize(far.select("key", "uid", "d", *[c for c in ("size", "common") if c in far.columns], F.col("own").alias("first"), F.col("label").alias("node"), (F.col("label") != F.col("own")).alias("apart")), "apart")
        open_ = far.filter("apart").groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n"))
        open_ = materialize(open_, "open-buckets")
        if open_.isEmpty():
            return chosen, found, labels
        if leaders == LEADERS:
            far = materialize(_overlap_bounds(far, open_, sets), "bounds")
        lead = far.filter("apart").join(open_, F.col("key") == F.col("_key")).filter(F.pmod(F.xxhash64("uid", F.lit(leaders)), F.col("n")) < leaders)
        lead = materialize(lead.select(F.col("key").alias("_key"), F.col("uid").alias("_uid"), F.col("d").alias("_d"), F.col("node").alias("_node"), F.col("size").alias("_size"), F.col("common").alias("_common")), "leaders")
        shared = F.aggregate(F.zip_with("common", "_common", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
        possible = (NUMERATOR + DENOMINATOR) * shared >= NUMERATOR * (F.col("size") + F.col("_size"))
        more = far.join(lead, (F.col("key") == F.col("_key")) & (F.col("node") != F.col("_node")) & (F.abs(F.col("d") - F.col("_d")) <= near) & possible)
        more = more.select(F.least("uid", "_uid").alias("a"), F.greatest("uid", "_uid").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        # Written first, so that a few pairs are known to be few, and only their sets move.
        more = materialize(more, "more-pairs")
        those = more.select(F.col("a").alias("uid")).unionByName(more.select(F.col("b").alias("uid"))).distinct()
        more = materialize(similarities(more, sets.join(those, "uid", "left_semi")), "more-similarities")
        done = done.unionByName(more.select("a", "b"))
        late = more.filter(_similar()).select("a", "b")
        # A leader has met its whole bucket; it leads no more, and no one needs to meet it.
        far = far.join(lead, (F.col("key") == F.col("_key")) & (F.col("uid") == F.col("_uid")), "left_anti").drop("apart")
        if not late.isEmpty():
            found = found.unionByName(late)
            labels = components(found)
        leaders *= 8


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", weighted: bool = False, name: Column | None = None) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size, kept (one row of each class).

    Classes are the connected components of the links of similarity 0.8 or more between sets of five-word windows, by
    whole texts; a text of fewer words is one window, and one without words (null, empty) is a class of its own. With
    weighted, windows count as often as they occur. The least doc_id stays (null last), of repeated rows the first. No
    rows give no rows; further columns are not read. A name, binary and of each row, is given back as a column.
    """
    names = [] if name is None else ["name"]
    table = materialize(signed(docs, text, doc_id, weighted, name=name).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    at = mark() - 1
    rows = materialize(table.select("doc_id", "uid", F.when(F.size("bands") > 0, F.col("digest")).alias("digest"), *names), "signed-rows")
    chosen, _, labels = links(table, lambda: discard(at))
    named = _with_labels(chosen, labels, "rep", "label").select(F.col("digest").alias("_digest"), "label")
    rows = rows.join(named, F.col("digest") == F.col("_digest"), "left")
    rows = materialize(rows.select("doc_id", "uid", F.coalesce("label", "uid").alias("label"), *names), "classes")
    first = F.max(F.struct(F.bitwise_not("doc_id").alias("d"), F.bitwise_not("uid").alias("u")))
    top = rows.groupBy(F.col("label").alias("_label")).agg(first.alias("top"), F.count(F.lit(1)).alias("class_size"))
    top = materialize(top, "class-tops")  # so that a class of many rows can be split in the join
    out = rows.join(top, F.col("label") == F.col("_label"))
    return out.select("doc_id", F.bitwise_not("top.d").alias("class_id"), "class_size", (F.col("uid") == F.bitwise_not("top.u")).alias("kept"), *names)


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns: those that near_classes keeps.

    Decisions are carried back by doc_id; where a doc_id repeats (a null one too), by doc_id and digest of the text, and
    of rows that repeat both one is taken.
    """
    since = mark()
    if docs.groupBy(F.col(doc_id).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        classes = materialize(near_classes(docs, text, doc_id).select(F.col("doc_id").alias("_id"), "kept"), "near-kept")
        free(since)
        # Few rows go: their ids are the small side, which Spark broadcasts if it is small enough.
        gone = materialize(classes.filter(~F.col("kept")).select("_id"), "near-gone")
        return without_ids(docs, doc_id, gone)
    digest = F.unhex(F.sha2(as_text(text), 256))
    classes = near_classes(docs, text, doc_id, name=digest).groupBy(F.col("doc_id").alias("_id"), F.col("name").alias("_digest"))
    stay = F.sum(F.col("kept").cast("int"))
    gone = materialize(classes.agg(F.count(F.lit(1)).alias("_n"), stay.alias("_stay")).filter("_stay < _n"), "near-gone")
    free(since)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # whatever the columns are called
    rows = docs.select(own.alias("_row"), F.col(doc_id).alias("_own_id"), digest.alias("_own_digest"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_digest") == F.col("_digest"))
    one = rows.join(gone.filter("_stay > 0"), same, "left_semi").dropDuplicates(["_own_id", "_own_digest"])
    return rows.join(gone, same, "left_anti").unionByName(one).select("_row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
