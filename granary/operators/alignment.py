"""Aligns the components of a record with its raw text, as character spans and token labels."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}'_-]+")
WORDY = regex.compile(r"[\p{L}\p{N}]")
OUT = "tokens array<string>, labels array<string>, span_starts array<int>, span_ends array<int>, span_tags array<string>, reason string"


def within(a: str, b: str, most: int) -> bool:
    """Whether two strings of one length are at most `most` edits apart: only the diagonals that near are filled."""
    n, far = len(a), most + 1
    row = {j: j for j in range(min(most, n) + 1)}
    for i in range(1, n + 1):
        after = {}
        for j in range(max(0, i - most), min(n, i + most) + 1):
            after[j] = i if j == 0 else min(row.get(j, far) + 1, after.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
        if min(after.values()) > most:
            return False
        row = after
    return row[n] <= most


def find(text: str, value: str, taken: list[tuple[int, int]], edits: int) -> int | None:
    """Where value stands in a free part of text: at word borders first, then inside a word, then at most `edits` off."""
    size = len(value)
    free = lambda at: all(at + size <= s or e <= at for s, e in taken)
    border = lambda at: not (at and WORDY.match(text[at - 1])) and not (at + size < len(text) and WORDY.match(text[at + size]))
    exact = [hit.start() for hit in re.finditer(f"(?={re.escape(value)})", text) if free(hit.start())]
    if exact:
        return min(exact, key=lambda at: (not border(at), at))
    if edits:
        return next((at for at in range(len(text) - size + 1) if free(at) and within(text[at : at + size], value, edits)), None)
    return None


def align_one(raw: str, components: dict[str, str], edits: int = 2) -> tuple:
    """A row of OUT; reason is null where every component is found, and all else is then given."""
    if not raw:
        return None, None, None, None, None, "raw-empty"
    folded, spans = raw.lower(), []
    if len(folded) != len(raw):  # folding that moves offsets
        folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in raw)
    for tag, value in sorted(components.items(), key=lambda kv: -len(kv[1] or "")):
        if not value:
            continue
        at = find(folded, value.lower(), [s[:2] for s in spans], edits)
        if at is None:
            return None, None, None, None, None, f"component-not-found:{tag}"
        spans.append((at, at + len(value.lower()), tag))
    spans.sort()
    tokens, labels, begun = [], [], set()
    for token in TOKEN.finditer(raw):
        inside = next((s for s in spans if s[0] <= token.start() and token.end() <= s[1]), None)
        tokens.append(token.group())
        labels.append("O" if inside is None else ("I-" if inside in begun else "B-") + inside[2])
        begun.add(inside)
    return tokens, labels, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], None


def align(df: DataFrame, raw: str, components: str, edits: int = 2) -> DataFrame:
    """df with the columns of OUT. raw: text; components: map of tag to text. Null counts as empty.

    A row whose components can't all be placed, or that fails in any way, keeps its columns and gets a reason.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, parts in zip(batch[raw], batch[components], strict=True):
                try:
                    rows.append(align_one(text, dict(parts) if parts is not None else {}, edits))
                except Exception as e:  # quarantined with its message
                    rows.append((None, None, None, None, None, f"align-threw:{e}"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")], index=batch.index)
            yield pd.concat([batch, out], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), OUT])
    return df.mapInPandas(each, schema)


def routed(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, quarantined rows with their reason)."""
    return aligned.filter("reason IS NULL").drop("reason"), aligned.filter("reason IS NOT NULL").select(F.struct(*[c for c in aligned.columns if c not in OUT]).alias("row"), "reason")
