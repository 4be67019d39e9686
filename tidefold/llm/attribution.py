"""Token counts of the sections of a document, from one encoding of the whole document.

A byte-level tokenizer's tokens tile the text's bytes, so the running sum of their byte lengths is
the span of every token. The spans are joined to the section intervals of the same document (both
sorted, so the join is two binary searches for all tokens at once), and a token that crosses a
boundary goes to one section by an explicit rule:

* ``majority``: to the section that holds most of its bytes, the earlier of equals;
* ``start`` / ``end``: to the section that holds its first / last byte.

A character whose bytes are split between tokens counts for each by its bytes. Sections are given as
character offsets, sorted and without overlap; bytes in no section fall to section null.

Defined results: null text has no sections and no row; empty text has its sections with no tokens; a
row with a null or repeated doc_id is counted by itself, under its doc_id; sections are cut to the
text's length. Extra columns are ignored; empty input gives empty output.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .tokens import tokenizer_path

RESULT = "doc_id long, section string, n_chars long, n_tokens long, n_crossing long, doc_tokens long"
RULES = ("majority", "start", "end")


class ByteEncoder:
    """A tiktoken encoding and the byte length of each of its ids."""

    _shared: ClassVar[dict[str, ByteEncoder]] = {}

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "tidefold", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    @classmethod
    def shared(cls, path: str) -> ByteEncoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token of the whole text ends."""
        return np.cumsum(self.length[self.ids(text)])


def line_sections(text: Column) -> Column:
    """head: the first line with its line end; tail: what follows the last line end, if that is not
    the first line; body: what lies between. Array of (name, start, end) in characters."""
    n = F.length(text)
    first = F.instr(text, "\n")
    head = F.when(first > 0, first).otherwise(n)
    tail = F.greatest(head, n - F.length(F.substring_index(text, "\n", -1)))
    part = lambda name, a, b: F.struct(
        F.lit(name).alias("name"), a.cast("long").alias("start"), b.cast("long").alias("end")
    )
    return F.array(part("head", F.lit(0), head), part("body", head, tail), part("tail", tail, n))


def allocate(ends: np.ndarray, starts_of: np.ndarray, ends_of: np.ndarray, rule: str):
    """For each token its section (-1: none), and whether it crosses a boundary. Byte offsets; the
    sections are sorted and do not overlap."""
    begins = np.concatenate([[0], ends])[:-1].astype(np.int64)
    if not len(starts_of):
        return np.full(len(ends), -1), np.zeros(len(ends), bool)

    def holder(at: np.ndarray) -> np.ndarray:
        i = np.searchsorted(starts_of, at, "right") - 1
        while ((empty := (i >= 0) & (ends_of[i] <= at) & (ends_of[i] == starts_of[i]))).any():
            i = np.where(empty, i - 1, i)  # empty sections hold nothing
        return np.where((i >= 0) & (at < ends_of[i]), i, -1)

    first, last = holder(begins), holder(ends - 1)
    crossing = first != last
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    section = first.copy()
    edges = np.unique(np.concatenate([starts_of, ends_of]))
    for t in np.flatnonzero(crossing | ((first == -1) & (ends - begins > 1))):
        a, b = begins[t], ends[t]
        cuts = np.concatenate([[a], edges[(edges > a) & (edges < b)], [b]])
        if len(cuts) > 2:
            held = holder(cuts[:-1])
            crossing[t] = True
            share: dict[int, int] = {}
            for s, n in zip(held, np.diff(cuts), strict=True):
                share[int(s)] = share.get(int(s), 0) + int(n)
            section[t] = max(share, key=lambda s: (share[s], -(s if s >= 0 else len(starts_of))))
    return section, crossing


def token_counts(
    documents: DataFrame, sections: Column | None = None, tokenizer: str | None = None, rule: str = "majority"
) -> DataFrame:
    """One row per section of each document, and one for section null if tokens fall there."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or tokenizer_path("byte_bpe_50k.tiktoken")
    text = F.col("text").cast("string")
    picked = documents.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        (line_sections(text) if sections is None else sections).alias("sections"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.shared(path)
        names = [x.split()[0] for x in RESULT.split(", ")]
        types = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        for batch in batches:
            rows = []
            for doc, t, parts in zip(
                batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("sections").to_pylist(), strict=True
            ):
                text = t.as_py()
                ends = encoder.ends(text)
                bounds = np.array([(p["start"], p["end"]) for p in parts or []], np.int64).reshape(-1, 2)
                bounds = np.clip(bounds, 0, len(text))
                at = bounds
                if not text.isascii():
                    raw = np.frombuffer(text.encode(), np.uint8)
                    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[bounds]
                section, crossing = allocate(ends, at[:, 0], at[:, 1], rule)
                n = np.bincount(section + 1, minlength=len(bounds) + 1)
                c = np.bincount(section[crossing] + 1, minlength=len(bounds) + 1)
                for i, p in enumerate(parts or []):
                    rows.append((doc, p["name"], int(bounds[i, 1] - bounds[i, 0]), int(n[i + 1]), int(c[i + 1]), len(ends)))
                if n[0]:
                    outside = len(text) - int((bounds[:, 1] - bounds[:, 0]).sum())
                    rows.append((doc, None, outside, int(n[0]), int(c[0]), len(ends)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, y) for x, y in zip(zip(*rows, strict=True), types, strict=True)], names
                )

    return map_batches(picked, run, RESULT)
