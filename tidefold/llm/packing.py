"""Hierarchical multi-length packing of documents into training sequences.

Documents are tokenised and packed inside the task that reads them, in shards of about
`shard_tokens` tokens, so no text and no token is shuffled and each task's memory is bounded. Steps 1
to 4 work on a shard, step 5 on the whole table:

1. routing: each document goes to the smallest context tier (256, 512, 1024 or 2048) that holds it;
   what exceeds the longest tier is first cut off in full windows of that tier;
2. packing: each tier is filled first-fit in decreasing length, longest tier first;
3. gaps: what a window of a longer tier leaves open is filled from the shorter tiers, the largest
   piece that fits first, and the last filler is cut so that the window is full;
4. tail: what no full window takes is laid end to end and cut into windows of falling powers of
   two, which need no padding;
5. step groups: the sequences of all shards are dealt to groups, largest first and back and forth,
   so that all groups have nearly equal numbers of tokens. A sequence's place in that order comes from
   sums over one row per shard and size, which are joined back to the pieces.

Defined results: null text counts as empty and gives the end id alone; rows that repeat a doc_id or
have none are packed as documents of their own; empty input gives no piece; the place of a shard in
its partition makes its sequence ids, so equal input partitions give equal results.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, small_side
from .tokens import WordEncoder, tokenizer_path

TIERS = (256, 512, 1024, 2048)
END = 1

RESULT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier long, step_group long"
)
PIECES = RESULT.replace("step_group long", "shard long, nth long")


class _Pool:
    """Pieces (doc, start, length) ordered by length."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.items: dict[int, deque] = {}
        self.total = 0

    def add(self, doc: int, start: int, length: int) -> None:
        if length not in self.items:
            insort(self.keys, length)
            self.items[length] = deque()
        self.items[length].append((doc, start, length))
        self.total += length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most `most`, the earliest of equals."""
        i = bisect_right(self.keys, most) - 1
        return self._pop(self.keys[i]) if i >= 0 else None

    def shortest(self) -> tuple[int, int, int] | None:
        return self._pop(self.keys[0]) if self.keys else None

    def _pop(self, length: int) -> tuple[int, int, int]:
        item = self.items[length].popleft()
        if not self.items[length]:
            del self.items[length]
            self.keys.remove(length)
        self.total -= length
        return item


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, pieces) of a shard; a piece is (document, start, length)."""
    top = tiers[-1]
    pools = {t: _Pool() for t in tiers}
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            out.append((top, [(doc, at, top)]))
            at += top
        if n > at:
            tier = next(t for t in tiers if n - at <= t)
            pools[tier].add(doc, at, n - at)
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[: k + 1]
        while pools[tier].total and sum(pools[t].total for t in below) >= tier:
            first = pools[tier].take(tier)
            pieces, gap = [first], tier - first[2]
            while gap:
                fits = next((x for t in reversed(below) if (x := pools[t].take(gap))), None)
                if fits is None:  # every piece left is longer than the gap: cut the shortest
                    short = next(t for t in below if pools[t].total)
                    doc, at, n = pools[short].shortest()
                    fits = (doc, at, gap)
                    rest = n - gap
                    pools[next(t for t in tiers if rest <= t)].add(doc, at + gap, rest)
                pieces.append(fits)
                gap -= fits[2]
            out.append((tier, pieces))
        if k and pools[tier].total:  # too little is left for a full window: hand it down
            while x := pools[tier].take(tier):
                doc, at, n = x
                lower = tiers[k - 1]
                while n > lower:
                    out.append((lower, [(doc, at, lower)]))
                    at, n = at + lower, n - lower
                pools[next(t for t in tiers if n <= t)].add(doc, at, n)
    rest: deque = deque()
    while x := pools[tiers[0]].take(tiers[0]):
        rest.append(x)
    left = sum(x[2] for x in rest)
    while left:
        size = 1 << (left.bit_length() - 1)
        pieces, gap = [], size
        while gap:
            doc, at, n = rest.popleft()
            cut = min(n, gap)
            pieces.append((doc, at, cut))
            if cut < n:
                rest.appendleft((doc, at + cut, n - cut))
            gap -= cut
        out.append((size, pieces))
        left -= size
    return out


def step_groups(sizes: list[int], group_tokens: int) -> list[int]:
    """Group of each of a list of sequences; groups get nearly equal numbers of tokens. `grouped` does
    the same over a table."""
    n = max(1, round(sum(sizes) / group_tokens))
    groups = [0] * len(sizes)
    for place, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        lap, at = divmod(place, n)
        groups[i] = at if lap % 2 == 0 else n - 1 - at
    return groups


def grouped(pieces: DataFrame, group_tokens: int) -> DataFrame:
    """RESULT of pieces that have shard (number of the shard in its partition) and nth (among the
    sequences of its size in its shard) in place of step_group."""
    shard = (F.shiftright("sequence_id", 40), "shard", "tier")
    counts = cut(
        pieces.where("offset = 0").groupBy(shard[0].alias("partition"), *shard[1:]).count(), "packing-sizes"
    )
    sizes = counts.groupBy("tier").agg(F.sum("count").alias("all")).collect()  # a size is a tier or a power of two
    n = max(1, round(sum(r.tier * r["all"] for r in sizes) / group_tokens))
    larger = {r.tier: sum(x["all"] for x in sizes if x.tier > r.tier) for r in sizes}
    # two-level sums: within a partition, then over partitions
    own = Window.partitionBy("tier", "partition").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("tier").orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("tier", "partition").agg(F.sum("count").alias("held"))
    before = parts.select("tier", "partition", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("earlier"))
    first = F.lit(0).cast("long")
    for size, count in larger.items():
        first = F.when(F.col("tier") == size, F.lit(count).cast("long")).otherwise(first)
    starts = counts.withColumn("inside", F.coalesce(F.sum("count").over(own), F.lit(0))).join(before, ["tier", "partition"])
    starts = cut(
        starts.select("tier", "partition", "shard", (first + F.col("earlier") + F.col("inside")).alias("base")), "packing-starts"
    )
    place = F.col("base") + F.col("nth")
    at = place % n
    group = F.when(((place - at) / n) % 2 == 0, at).otherwise(n - 1 - at)
    return (
        pieces.withColumn("partition", shard[0])
        .join(small_side(starts), ["tier", "partition", "shard"])
        .withColumn("step_group", group.cast("long"))
        .select(*(x.split()[0] for x in RESULT.split(", ")))
    )


def pack(
    documents: DataFrame,
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    shard_tokens: int = 4_000_000,
    group_tokens: int = 1 << 18,
) -> DataFrame:
    """One row per piece, see RESULT. A sequence whose length is a power of two has no padding."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(path)
        base = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        packed: list[bytes] = []
        total = made = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, packed, total, made, shard
            lengths = [len(p) // 4 for p in packed]
            sequences = plan(lengths, tiers)
            rows = []
            of_size: Counter = Counter()
            for tier, pieces in sequences:
                offset, nth = 0, of_size[tier]
                for doc, at, n in pieces:
                    crc = zlib.crc32(memoryview(packed[doc])[4 * at : 4 * (at + n)])
                    rows.append((ids[doc], at, n, crc, lengths[doc], base + made, offset, tier, shard, nth))
                    offset += n
                made += 1
                of_size[tier] += 1
            shard += 1
            ids, packed, total = [], [], 0
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names
            )

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc)
                packed.append(encoder.encode(text.as_py() or "") + np.uint32(END).tobytes())
                total += len(packed[-1]) // 4
                if total >= shard_tokens:
                    yield flush()
        if packed:
            yield flush()

    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return grouped(cut(map_batches(picked, run, PIECES), "packing-pieces"), group_tokens)
