"""Token counts by a compiled finite-state transducer.

A byte-pair model that merges the lowest rank first encodes a string into the one sequence of tokens in which every two
neighbours are stable, that is, stay as they are when encoded together. So the encoding of a prefix is known from its
last token, and the last token of every prefix from those of shorter ones: a deterministic transducer reads one
character at a time, and each of its transitions carries by how much the count of tokens changes. A state is the
longest suffix of the input that begins some token, with the last token of each prefix that ends inside it. States and
transitions are compiled when first met.

No token holds a space mark after another character, so the space mark after a character leads back to one state,
whatever came before. That makes the map of a whole chunk of text short: until its first reset it depends on the state
before the chunk, afterwards on the chunk alone. A chunk's map is therefore (head, tokens between, tail), or a text
without any reset; maps compose associatively, and a prefix scan over the maps of a text's chunks gives its count
without any chunk being read twice or in order.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import as_text, documents

MARK = "▁"
#: Texts longer than this many characters are cut into chunks that tasks read side by side.
CHUNK = 1 << 20
#: Words and transitions that a worker remembers before it starts anew. Bounds memory, not results.
REMEMBERED = 300_000


class Transducer:
    """The transducer of a byte-pair model with byte fallback.

    ranks: token -> rank, lower merged first; only tokens of more than one character can be merged into.
    A character that no token spells is emitted as its UTF-8 bytes, and nothing merges with it.
    """

    def __init__(self, ranks: dict[str, float]):
        self.ranks = ranks
        self.begins = {t[:i] for t in ranks for i in range(len(t) + 1)}
        self.stable_pairs: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        # States by number; 0 is that after a reset. A state: (suffix, for each place in it the last token that ends
        # there, and the count of tokens there as it differs from the count at the end).
        self.states: list[tuple] = [("", (("",), (0,)))]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.edges: list[dict[str, tuple[int, int]]] = [{}]
        self.words: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """Encode by the definition: the lowest rank first, from the left. For single tokens and pairs only."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reachable(self, token: str) -> bool:
        if (found := self.own.get(token)) is None:
            found = self.own[token] = len(self.merged(token)) == 1
        return found

    def stable(self, left: str, right: str) -> bool:
        if not left:
            return True
        if (found := self.stable_pairs.get((left, right))) is None:
            if len(self.stable_pairs) >= REMEMBERED:
                self.stable_pairs.clear()
            found = self.stable_pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def step(self, state: int, character: str) -> tuple[int, int]:
        """The next state, and by how much the count changes."""
        suffix, (last, counts) = self.states[state]
        if character not in self.ranks:
            return self.number("", ("",), (0,)), len(character.encode("utf-8", "replace"))
        read, places = suffix + character, len(suffix)
        for i in range(places + 1):  # the longest token first, and only one fits
            token = read[i:]
            if last[i] is not None and token in self.ranks and self.reachable(token) and self.stable(last[i], token):
                break
        else:
            raise AssertionError("every character is a token")
        change = counts[i] + 1
        last, counts = (*last, token), (*(c - change for c in counts), 0)
        begin = next(i for i in range(places + 2) if read[i:] in self.begins)
        return self.number(read[begin:], last[begin:], counts[begin:]), change

    def number(self, suffix: str, last: tuple, counts: tuple) -> int:
        key = (suffix, (last, counts))
        if (found := self.numbers.get(key)) is None:
            found = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.edges.append({})
        return found

    def count(self, word: str) -> int:
        """Tokens of a text that follows a reset (or begins) and has none inside."""
        if len(self.states) >= REMEMBERED:
            self.__init__(self.ranks)
        state, total, edges = 0, 0, self.edges
        for c in word:
            if (edge := edges[state].get(c)) is None:
                edge = edges[state][c] = self.step(state, c)
            state = edge[0]
            total += edge[1]
        return total

    def counts(self, words: Counter) -> int:
        """Tokens of many words. A whole word's run is one composed transition, kept for when the word returns."""
        known, total = self.words, 0
        for w, n in words.items():
            if (c := known.get(w)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                c = known[w] = self.count(w)
            total += c * n
        return total


RESET = re.compile(f"(?<=[^{MARK}])(?={MARK})")


def chunk_map(transducer: Transducer, chunk: str) -> tuple[str, int | None, str]:
    """(head, None, "") for a chunk without a reset, else (head, tokens between the first and the last reset, tail)."""
    marked = chunk.replace(" ", MARK)
    pieces = marked.split(MARK) if MARK * 2 not in marked else None
    if pieces is None:
        words = RESET.split(marked)
    else:  # single spaces only: every mark starts a word, but a mark at the chunk's start may belong to a run before it
        words = [pieces[0], *[MARK + p for p in pieces[1:]]] if pieces[0] else [MARK + p for p in pieces[1:]] or [""]
    if len(words) == 1:
        return words[0], None, ""
    return words[0], transducer.counts(Counter(words[1:-1])), words[-1]


def compose(transducer: Transducer, a: tuple, b: tuple) -> tuple:
    """The map of two neighbouring chunks."""
    if a[1] is None and b[1] is None:
        head, *more = RESET.split(a[0] + b[0])
        return (head, None, "") if not more else (head, transducer.counts(Counter(more[:-1])), more[-1])
    if a[1] is None:
        head, *more = RESET.split(a[0] + b[0])
        return head, b[1] + transducer.counts(Counter(more)), b[2]
    first, *more = RESET.split(a[2] + b[0])
    if b[1] is None:
        if not more:
            return a[0], a[1], first
        return a[0], a[1] + transducer.counts(Counter([first, *more[:-1]])), more[-1]
    return a[0], a[1] + transducer.counts(Counter([first, *more])) + b[1], b[2]


def finish(transducer: Transducer, whole: tuple) -> int:
    head, between, tail = whole
    return transducer.counts(Counter([head])) + (0 if between is None else between + transducer.counts(Counter([tail])))


def scan(transducer: Transducer, maps: list[tuple]) -> tuple:
    """Pairwise, as a parallel scan's last value: depth log2 of the number of chunks."""
    while len(maps) > 1:
        maps = [compose(transducer, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


@lru_cache(maxsize=2)
def compiled(model: str) -> Transducer:
    """The transducer of a sentencepiece byte-pair model, one per worker process."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in usable}
    late = [t for t in ranks if RESET.search(t)]
    if late:  # chunk maps rest on resets
        raise ValueError(f"{model}: {len(late)} tokens hold a space mark after another character, such as {late[0]!r}")
    return Transducer(ranks)


def count_tokens(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, as the model's library counts whole texts.

    A null or empty text has no tokens. Repeated rows are rows of their own; no rows give no rows; further columns are
    not read. The model's file must be at the same path on every machine, as the library that owns it is.
    """
    body = as_text(text)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes"), F.char_length(body).alias("n_chars"))

    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = compiled(model)
        for texts in batches:
            # The library sets one space mark before a text.
            yield pd.Series([finish(t, chunk_map(t, MARK + x)) if x else 0 for x in texts], dtype="int64")

    def maps(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = compiled(model)
        for texts in batches:
            found = [chunk_map(t, x) for x in texts]
            yield pd.DataFrame({"head": [m[0] for m in found], "between": [-1 if m[1] is None else m[1] for m in found], "tail": [m[2] for m in found]})

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = compiled(model)
        for rows in batches:
            yield pd.Series([finish(t, scan(t, [(m["head"], None if m["between"] < 0 else m["between"], m["tail"]) for m in row])) for row in rows], dtype="int64")

    count_udf = F.pandas_udf(whole, "long")
    short = slim.filter(F.col("n_chars") <= chunk).select("doc_id", "n_bytes", count_udf("text").alias("n_tokens"))
    map_udf = F.pandas_udf(maps, "head string, between long, tail string")
    scan_udf = F.pandas_udf(scanned, "long")
    long = slim.filter(F.col("n_chars") > chunk).withColumn("uid", F.monotonically_increasing_id())
    marked = F.concat(F.lit(MARK), F.col("text"))
    cut = long.select("doc_id", "n_bytes", "uid", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.col("n_chars") / chunk).cast("int")), lambda i: F.substring(marked, i * chunk + 1, F.lit(chunk)))).alias("at", "part"))
    mapped = cut.repartition("uid", "at").withColumn("map", map_udf("part"))
    joined = mapped.groupBy("uid", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("at", "map"))).alias("maps"))
    joined = joined.select("doc_id", "n_bytes", scan_udf(F.transform("maps", lambda m: m["map"])).alias("n_tokens"))
    return short.unionByName(joined)


#: Vocabularies are files of an installed package; nothing is copied here.
MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(documents(spark, sf_dir), public_tokenizers.path(MODEL))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit")
