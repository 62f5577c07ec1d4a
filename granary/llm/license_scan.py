"""License scans by conditional compression.

A block of text around words like "license" is a candidate: it is compressed alone and with each license notice as raw
dictionary; the notice that saves most says most of what the block says. All are then confirmed, wherever they stand, by
their exact wording: every word of the notice must stand in the block in order, but for the few that a notice leaves open,
and the words that differ are reported. Where notices overlap, the one that saves most stays.
"""
from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import as_text, documents

#: Short public license notices, as their owners ask that they be worded.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "GPL": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "either version 2 of the License, or (at your option) any later version."),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-NC-ND": ("Licensed under CC BY-NC-ND 4.0.",),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "Proprietary": ("All rights reserved.",),
}
#: Words of a mark may stand on two lines, with the signs of a comment between them.
MARKS = r"(?i)licen[cs]e|copyright|permission[\W_]+is|all[\W_]+rights[\W_]+reserved|redistribution[\W_]+and[\W_]+use|creative[\W_]+commons|public[\W_]+domain|permission[\W_]+to[\W_]+use|\bcc[\W_]*(by|0)\b"
MARK = re.compile(MARKS)
#: A notice is confirmed if at most this share of its words is missing or changed. Numbers and license letters never may.
CHANGED = 0.1
#: Words of the longest notice with what may be added to it: a block has as many on both sides of a mark.
REACH = 38
#: Blocks are at most so many words; longer ones are read in blocks that overlap by REACH words.
BLOCK = 150
REMEMBERED = 20_000

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Words of a notice that may not differ: numbers, and names and letters of licenses.
FIRM = re.compile(r"\d|^(?:v|cc|by|nc|nd|sa|by-.*|cc0|mit|apache|gnu|general|lesser|affero|mozilla|bsd|boost|eclipse|attribution.*|reserved)$")


def wording(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def candidate_blocks(text: str) -> Iterator[tuple[int, str]]:
    """(start, block): the text around each mark, as far as a notice may reach, whatever lines it is spread over."""
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    runs: list[list[int]] = []
    for m in MARK.finditer(text):
        # The words that the mark touches, and REACH more on each side.
        low, high = max(0, bisect_right(ends, m.start()) - REACH), min(len(words), bisect_left(starts, m.end()) + REACH)
        if runs and low <= runs[-1][1]:
            runs[-1][1] = high
        else:
            runs.append([low, high])
    for low, high in runs:
        while high - low > BLOCK:
            yield starts[low], text[starts[low] : ends[low + BLOCK - 1]]
            low += BLOCK - REACH
        yield starts[low], text[starts[low] : ends[high - 1]]


@lru_cache(maxsize=1)
def compressors() -> tuple:
    import zstandard

    plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
    each = []
    for name, texts in NOTICES.items():
        for text in texts:
            raw = zstandard.ZstdCompressionDict(text.encode() * max(1, 1 + 16 // len(text)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            each.append((name, text, wording(text), zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False)))
    return plain, each


def confirm(notice: list[str], block: list[str]) -> tuple[list[str], list[str], int, int] | None:
    """(missing, added, first, last word of the block) where the notice's words stand in order, or nothing."""
    found = difflib.SequenceMatcher(None, notice, block, autojunk=False)
    pieces = [m for m in found.get_matching_blocks() if m.size]
    if not pieces:
        return None
    # The dense part: pieces after a gap longer than the notice belong to another sentence.
    dense, best = [pieces[0]], []
    for m in pieces[1:]:
        if m.b - (dense[-1].b + dense[-1].size) > max(3, len(notice) // 4):
            best = max(best, dense, key=lambda d: sum(x.size for x in d))
            dense = []
        dense.append(m)
    dense = max(best, dense, key=lambda d: sum(x.size for x in d))
    first, last = dense[0].b, dense[-1].b + dense[-1].size
    held_notice = {i for m in dense for i in range(m.a, m.a + m.size)}
    held_block = {i for m in dense for i in range(m.b, m.b + m.size)}
    missing = [w for i, w in enumerate(notice) if i not in held_notice]
    added = [block[i] for i in range(first, last) if i not in held_block]
    if len(missing) + len(added) > CHANGED * len(notice) or any(FIRM.search(w) for w in missing + added):
        return None
    return missing, added, first, last


def places(notice: list[str], block: list[str]) -> Iterator[tuple[list[str], list[str], int, int]]:
    """confirm() of every place of the block where the notice may stand.

    A changed word spoils one piece of the notice at most, so of one piece more than words may change, one stands whole.
    """
    n, most = len(notice), int(CHANGED * len(notice))
    cuts = [n * i // (most + 1) for i in range(most + 2)]
    at: dict[str, list[int]] = {}
    for i, w in enumerate(block):
        at.setdefault(w, []).append(i)
    starts = {i - a for a, b in zip(cuts, cuts[1:]) for i in at.get(notice[a], ()) if block[i : i + b - a] == notice[a:b]}
    for start in sorted(starts):
        if start >= 0 and block[start : start + n] == notice:
            yield [], [], start, start + n
            continue
        low = max(0, start - most)
        got = confirm(notice, block[low : start + n + most])
        if got:
            yield got[0], got[1], got[2] + low, got[3] + low


def savings(block: str) -> list[int]:
    """Conditional compression: the bytes that each notice of compressors() saves as the block's dictionary."""
    plain, each = compressors()
    data = block.encode("utf-8", "replace")
    alone = len(plain.compress(data))
    return [alone - len(with_notice.compress(data)) for _, _, _, with_notice in each]


@lru_cache(maxsize=REMEMBERED)
def held(block: str) -> tuple:
    """(license, notice, saved bytes, compressed size, missing, added, start, end) wherever the block holds a notice.

    Every block is compressed with every notice; notices are confirmed in the order of what they save, none left out, since
    no least saving is sure for a short notice in a long block.
    """
    plain, each = compressors()
    saved = savings(block)
    alone = len(plain.compress(block.encode("utf-8", "replace")))
    spans = [m.span() for m in WORD.finditer(block)]
    own = [block[a:b].lower() for a, b in spans]
    ranked = sorted(range(len(each)), key=lambda i: -saved[i])
    found = [(i, x) for i in ranked for x in places(each[i][2], own)]
    return tuple((each[i][0], each[i][1], saved[i], alone, " ".join(x), " ".join(y), spans[a][0], spans[b - 1][1]) for i, (x, y, a, b) in found)


def apart(found: Iterable[tuple]) -> list[tuple]:
    """Rows of held(), by start; of places that overlap, that of the notice that saves most."""
    ranked = sorted(found, key=lambda x: (-x[2], -len(wording(x[1])), len(x[4].split()) + len(x[5].split()), x[6], x[0]))
    out: list[tuple] = []
    for x in ranked:
        i = bisect_left(out, x[6], key=lambda o: o[6])
        if (i == 0 or out[i - 1][7] <= x[6]) and (i == len(out) or out[i][6] >= x[7]):
            out.insert(i, x)
    return out


def identify(block: str) -> tuple:
    """The notices that the block holds, as held() and apart() say."""
    return tuple(apart(held(block)))


def scan_text(text: str) -> list[tuple]:
    """The notices of a whole text; a place that two blocks hold counts once."""
    found = {(*x[:2], at + x[6], at + x[7]): (*x[:6], at + x[6], at + x[7]) for at, block in candidate_blocks(text) for x in held(block)}
    return apart(found.values())


FOUND = "doc_id long, license string, notice string, start int, end int, bytes_saved int, bytes_alone int, missing string, added string, exact boolean"


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per notice found: doc_id, license, notice, start and end (code points of the whole text), bytes_saved and
    bytes_alone (compressed sizes), the words missing from the notice and added to it, and whether none are.

    Null and empty texts hold no notice; repeated rows give repeated results; no rows give no rows; further columns are
    not read. Only texts with a mark reach the compressor; their whole text is read.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_text(text).alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, x in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                for name, notice, saved, alone, missing, added, a, b in scan_text(x):
                    rows.append((i, name, notice, a, b, saved, alone, missing, added, not missing and not added))
            out = pd.DataFrame(rows, columns=["doc_id", "license", "notice", "start", "end", "bytes_saved", "bytes_alone", "missing", "added", "exact"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return slim.filter(F.regexp_like("text", F.lit(MARKS))).mapInPandas(scan, FOUND)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
