"""Mixing sources to target weights by a minimum-cost flow over overlapping sources.

Equal texts may lie in several sources; the set of sources that hold a text is its membership pattern. Documents are
aggregated by pattern, and a flow routes each pattern's words to the quotas of its sources. Repetition has a convex
cost: the n-th time that a pattern's distinct words are taken costs more than those before, wherever they are taken, so
that the mix repeats a text only where a quota leaves no other way. The network has a node per pattern and per source,
not per document. What a route takes is then dealt to its documents in a seeded order: full copies to all, one more to
the first of them, cut at the word that fills the route.
"""
from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import WORD, as_text, documents, free, mark, materialize, running_sums

#: No document is taken more often.
MOST = 3
WEIGHTS = (1, 2, 3)
SEED = 20240229
#: Steps of the convex cost: the share of a pattern's words that is taken up to so many times costs as much each.
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 32, 64, 128)


def water_fill(sizes: dict, weights: dict, most: float = MOST) -> dict:
    """Targets by weight that share all sizes; what exceeds `most` times a size is reshared by weight."""
    total, open_, out = float(sum(sizes.values())), {s for s in sizes if sizes[s] > 0}, dict.fromkeys(sizes, 0.0)
    left = total
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] >= most * sizes[s]}
        if not full:
            return out | {s: share * weights[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
        left = total - sum(out.values())
        open_ -= full
    return out


def route(patterns: list[dict], quotas: dict, most: int = MOST) -> dict:
    """Words to take for each (pattern, source): a minimum-cost flow with integral quotas.

    patterns: {"words": distinct words, "own": {source: words of its documents}}. Each unit's cost is that of its
    repetition step, the same for all sources, so that successive shortest paths use the steps in order: the flow is
    made as large as it can be within each step before the next is opened (blocking flows on the residual network).
    """
    sources = list(quotas)
    number = {s: i for i, s in enumerate(sources)}
    need = [int(quotas[s]) for s in sources]
    flow: list[dict[int, int]] = [{} for _ in patterns]
    caps = [{number[s]: most * w for s, w in p["own"].items() if w > 0 and s in number} for p in patterns]
    used = [0] * len(patterns)
    members: list[list[int]] = [[] for _ in sources]
    for i, c in enumerate(caps):
        for s in c:
            members[s].append(i)
    for step in (*STEPS, None):
        limit = [(sum(c.values()) if step is None else min(p["words"] * step, sum(c.values()))) for p, c in zip(patterns, caps, strict=True)]
        for i, c in enumerate(caps):  # direct routes
            for s, cap in c.items():
                if (x := min(limit[i] - used[i], cap - flow[i].get(s, 0), need[s])) > 0:
                    flow[i][s] = flow[i].get(s, 0) + x
                    used[i] += x
                    need[s] -= x
        while True:  # a pattern with words left serves a needy source through others that give way
            came: dict = {}
            todo: deque = deque()
            for i in range(len(patterns)):
                if used[i] < limit[i]:
                    came["p", i] = None
                    todo.append(("p", i))
            end = None
            while todo and end is None:
                kind, x = node = todo.popleft()
                if kind == "p":
                    for s, cap in caps[x].items():
                        if flow[x].get(s, 0) < cap and ("s", s) not in came:
                            came["s", s] = node
                            todo.append(("s", s))
                            if need[s] > 0:
                                end = ("s", s)
                                break
                else:
                    for i in members[x]:
                        if flow[i].get(x, 0) > 0 and ("p", i) not in came:
                            came["p", i] = node
                            todo.append(("p", i))
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            amount = min(limit[path[0][1]] - used[path[0][1]], need[end[1]])
            for a, b in zip(path, path[1:], strict=False):
                amount = min(amount, caps[a[1]][b[1]] - flow[a[1]].get(b[1], 0) if a[0] == "p" else flow[b[1]][a[1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "p":
                    flow[a[1]][b[1]] = flow[a[1]].get(b[1], 0) + amount
                else:
                    flow[b[1]][a[1]] -= amount
            used[path[0][1]] += amount
            need[end[1]] -= amount
        if not any(n > 0 for n in need):
            break
    return {(i, sources[s]): x for i, f in enumerate(flow) for s, x in f.items() if x > 0}


def mix(docs: DataFrame, weights: dict | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target, taken (words, repeats counted).

    Without weights, the sources in code point order, null last, weigh 1, 2, 3 and so on in turn, and share all sizes;
    no target exceeds 3 times its source's size. taken sums to the target, rounded, in each source, and is at most 3
    times a document's size. A null or empty text has no words and is not taken. Repeated rows are documents of their
    own; no rows give no rows; further columns are not read. Reruns agree, however rows are partitioned.
    """
    spark = docs.sparkSession
    body = as_text(text)
    slim = materialize(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.unhex(F.md5(body.cast("binary"))).alias("digest"),
        F.monotonically_increasing_id().alias("uid"),
    ), "mix-sizes")
    rows = slim.count()
    sizes = {r["source"]: r["size"] for r in slim.groupBy("source").agg(F.sum("size").alias("size")).collect()}  # one row per source
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    targets = water_fill(sizes, weights)

    # Only texts that several rows hold can belong to several sources. Their sources, as bits of a map-side OR, and
    # their copies come together by digest after partial aggregation, however many rows share one.
    per_text = slim.groupBy("digest").agg(F.sort_array(F.collect_set(F.coalesce("source", F.lit("\0")))).alias("_sources"), F.max("size").alias("_words"))
    shared = materialize(per_text.filter(F.size("_sources") > 1), "mix-shared").withColumnRenamed("digest", "_digest")
    own = slim.join(shared, F.col("digest") == F.col("_digest"), "left").select(*slim.columns, F.coalesce("_sources", F.array(F.coalesce("source", F.lit("\0")))).alias("pattern"))
    own = materialize(own.withColumn("pattern", F.md5(F.to_json("pattern").cast("binary"))), "mix-patterns")
    held = own.groupBy("pattern", "source").agg(F.sum("size").alias("words")).collect()  # one row per pattern and source
    texts = {r["pattern"]: r["words"] for r in shared.groupBy(F.md5(F.to_json("_sources").cast("binary")).alias("pattern")).agg(F.sum("_words").alias("words")).collect()}
    by: dict[str, dict] = {}
    for r in sorted(held, key=lambda r: (r["pattern"], r["source"] is None, r["source"] or "")):
        by.setdefault(r["pattern"], {"own": {}})["own"][r["source"]] = r["words"]
    for k, p in by.items():
        p["words"] = texts.get(k, sum(p["own"].values()))
    names = sorted(by)
    taken = route([by[k] for k in names], {s: round(targets[s]) for s in order})
    routes = [(names[i], s, x // by[names[i]]["own"][s], x % by[names[i]]["own"][s]) for (i, s), x in taken.items()]
    plan = spark.createDataFrame(routes, "_pattern string, _source string, _full long, _rest long")
    totals = F.broadcast(spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in order], "_of string, source_size long, target double"))
    summed = running_sums(own, ["pattern", "source"], F.xxhash64("doc_id", "digest", F.lit(seed)), {"_before": F.col("size")}, rows, ["doc_id", "digest", "uid"])
    out = summed.join(plan, (F.col("pattern") == F.col("_pattern")) & F.col("source").eqNullSafe(F.col("_source")), "left").join(totals, F.col("source").eqNullSafe(F.col("_of")))
    extra = F.greatest(F.least(F.col("size"), F.coalesce("_rest", F.lit(0)) - F.col("_before")), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", (F.coalesce("_full", F.lit(0)) * F.col("size") + extra).cast("long").alias("taken"), "source", "digest")


def apply_mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of docs as the mix takes them, with all their columns: each as often as its taken words hold it, rounded.

    Decisions are carried back by (doc_id, source, digest); rows that repeat with the same three share what they take.
    """
    since = mark()
    taken = mix(docs, None, text, doc_id, source)
    copies = taken.filter("taken > 0").groupBy("doc_id", "source", "digest").agg(F.round(F.sum(F.col("taken") / F.col("size")) / F.count(F.lit(1))).cast("int").alias("_copies")).filter("_copies > 0")
    copies = materialize(copies.withColumnsRenamed({"doc_id": "_doc_id", "source": "_source", "digest": "_mix_digest"}), "mix-copies")
    free(since)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("_row"), F.col(doc_id).cast("long").alias("_i"), F.col(source).cast("string").alias("_s"), F.unhex(F.md5(as_text(text).cast("binary"))).alias("_d"))
    same = F.col("_i").eqNullSafe(F.col("_doc_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_d") == F.col("_mix_digest"))
    return rows.join(copies, same).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
