"""MinHash near-duplicate detection with SuperMinHash signatures.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a 128-bit fingerprint of the
   set, and the band keys of a SuperMinHash signature. Texts are not shuffled.
2. Equal sets form a class, represented by its least doc_id; only representatives go on, so copies
   are never expanded into pairs. A doc_id that several classes hold links their representatives.
3. Banding: in each bucket a random member leads, another one in each bucket of a large group, and
   the other members are candidates with it. Candidates are verified on full sets, and the links
   give first components, in which a large group of near copies already is one.
4. What is left are pairs of a bucket that lie in different components. Members of one component,
   which a large group of near copies forms after step 3, are never paired. Where at most FEW members
   of a bucket lie outside its most frequent component, those meet the other members. The members of
   all other buckets, such as pages of one template that are alike below the limit, meet by the
   rarest shingles of their sets (prefix filtering) instead: with one order of all shingles, two sets
   that are alike share one of the first n / 9 of the smaller (at 80 percent) and the first n / 5 of
   the larger. Both joins drop pairs that a lossless bound on parity sketches rules out, and the
   others are verified too, so no link between components is lost. A key with many members is dealt
   in blocks of BLOCK by BLOCK members.
5. Components of all links (union-find by star contraction) are joined back to the documents.

With 42 bands of 6 rows a pair at the limit of 0.8 shares no band with probability 3e-6, and pairs
beyond it less.

Defined results: a null or empty text has an empty set and is linked with nothing; a text of fewer
words than a shingle has its whole sequence as its one shingle; rows that repeat a doc_id count as
one node, with the links of all of them (but rows with an empty set stay alone); a row with a null
doc_id is not linked and is kept, with a null component. Empty input gives empty output. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import superminhash as smh
from . import textvec as tv
from .common import cut, map_arrow, map_batches, small_side, spread_join
from .components import components

BANDS, ROWS = 42, 6
#: Longs of a parity sketch.
WORDS = 16
#: Members of a bucket outside its most frequent component that may meet all its members.
FEW = 64
#: Members of a key that meet as many others in one task.
BLOCK = 2048
#: Counters in which shingles are counted to order them; the order is exact with any counts.
COUNTERS = 1 << 20


def shingle_sets(s: tv.Slice, k: int) -> list[np.ndarray]:
    """For each text of a slice the sorted distinct hashes of its k-word shingles (A-Z lower-cased)."""
    low = tv.Slice(s.first, s.last, tv.LOWER[s.data], s.bounds)
    w = tv.words(low)
    h = tv.hash_spans(low.data, w.starts, w.ends)
    win, at = tv.windows(h, w.first, k)
    cuts = np.searchsorted(at, w.first)
    out = []
    for i in range(s.n):
        n = w.first[i + 1] - w.first[i]
        if n >= k or n == 0:
            out.append(np.unique(win[cuts[i] : cuts[i + 1]]))
        else:
            own = h[w.first[i] : w.first[i + 1]]
            whole, _ = tv.windows(own, np.array([0, n]), int(n))
            out.append(tv.mix(whole + np.uint64(n)))
    return out


def fingerprint(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums per set of independently mixed elements."""
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        starts = (np.cumsum(n) - n)[full]
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[i, full] = np.add.reduceat(tv.mix(flat ^ np.uint64(salt)), starts)
    return out.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sketches(documents: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint), keys (one per band; none for an empty set) and parity
    (of the numbers of elements that fall into each of 64 * WORDS bins)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, prints, keys, parities = [], [], [], []
        for s in tv.slices(batch.column("text"), 1 << 18):
            sets = shingle_sets(s, k)
            n = np.array([len(x) for x in sets])
            sig = smh.signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets), bands * rows)
            found = smh.band_keys(sig, bands)
            keys += [found[i] if n[i] else found[i][:0] for i in range(len(sets))]
            bins = (tv.mix(np.concatenate(sets) + np.uint64(5)) % np.uint64(64 * WORDS)).astype(np.int64)
            bins += np.repeat(np.arange(len(sets)), n) * 64 * WORDS
            odd = (np.bincount(bins, minlength=len(sets) * 64 * WORDS) & 1).astype(np.uint8)
            parities += list(np.packbits(odd).view(np.uint64).reshape(len(sets), WORDS))
            size.append(n)
            prints.append(fingerprint(sets))
        f = np.concatenate(prints, axis=1)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate(size).astype(np.int64)), pa.array(f[0]), pa.array(f[1]), _lists(keys), _lists(parities)],
            ["doc_id", "n_shingles", "f1", "f2", "keys", "parity"],
        )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, parity array<long>")


def _sets_of(documents: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """node, elements: the full sets of the documents named by ids (node)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [x for s in tv.slices(batch.column("text"), 1 << 18) for x in shingle_sets(s, k)]
        return pa.RecordBatch.from_arrays([batch.column("node"), _lists(sets)], ["node", "elements"])

    docs = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs.join(small_side(ids), "node", "left_semi"), run, "node long, elements array<long>").distinct()


def _alike(x: Column, y: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, by size first."""
    n, m, both = F.size(x), F.size(y), F.size(F.array_intersect(x, y))
    by_size = F.greatest(n, m) * percent <= 100 * F.least(n, m)
    return by_size & (100 * both >= percent * (n + m - both))


def verified(documents: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "dedup-ids")
    sets = cut(_sets_of(documents, ids, k), "dedup-sets")
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    counts = lambda side: pairs.groupBy(side).agg(F.count("*").alias("n"))  # noqa: E731  the leader of a large group has many
    both = spread_join(spread_join(pairs, left, ["a"], "b", counts("a")), right, ["b"], "a", counts("b"))
    return both.where(_alike(F.col("x"), F.col("y"), percent)).select("a", "b").distinct()


def _meet(rows: DataFrame, parity: DataFrame, percent: int) -> DataFrame:
    """Candidates (a < b): nodes that share a key, lie in different components and may be alike.

    rows: key, node, component, and leads: whether the node may be the smaller one of a pair; parity:
    node, n, parity. They join once for each side, where the keys that meet nothing are gone.
    The nodes outside the most frequent component of a key meet those of other components. The join
    itself drops pairs that cannot be alike: the Hamming distance of two parity sketches is at most the
    symmetric difference of the sets, and alike sets have a symmetric difference of at most
    (100 - percent) / (100 + percent) of the sum of their sizes. Nothing alike is dropped by that.
    """
    top = cut(
        rows.groupBy("key", "component")
        .count()
        .groupBy("key")
        .agg(F.max(F.struct("count", "component")).alias("top"), F.count("*").alias("groups"), F.sum("count").alias("all"))
        .where("groups > 1")
        .select("key", F.col("all").alias("n"), F.col("top.component").alias("top"), *[F.ceil(c / BLOCK).cast("int").alias(name) for c, name in (
            (F.col("all") - F.col("top.count"), "few_blocks"), (F.col("all"), "all_blocks"))]),
        "dedup-top",
    )
    full = spread_join(rows, top.drop("n"), ["key"], "node", top.select("key", "n"))
    sketched = lambda df: df.join(parity, "node")
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = sketched(full.where("component <> top")).select(
        "key", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("parity").alias("px"),
        F.col("leads").alias("lx"), dealt("few_blocks").alias("bx"), each("all_blocks").alias("by"),
    )
    every = sketched(full).select(
        F.col("key").alias("k"), F.col("node").alias("y"), F.col("component").alias("cy"), "top", F.col("n").alias("ny"),
        F.col("parity").alias("py"), F.col("leads").alias("ly"), dealt("all_blocks").alias("ky"), each("few_blocks").alias("kx"),
    )
    same = (F.col("key") == F.col("k")) & (F.col("bx") == F.col("kx")) & (F.col("by") == F.col("ky"))
    once = (F.col("cy") == F.col("top")) | (F.col("x") < F.col("y"))
    first = F.struct(F.col("nx"), F.col("x")) < F.struct(F.col("ny"), F.col("y"))
    by_size = F.greatest("nx", "ny") * percent <= 100 * F.least("nx", "ny")
    apart = sum((F.bit_count(F.col("px")[i].bitwiseXOR(F.col("py")[i])) for i in range(WORDS)), F.lit(0))
    by_sketch = apart * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    meet = same & (F.col("cx") != F.col("cy")) & once & F.when(first, F.col("lx")).otherwise(F.col("ly")) & by_size & by_sketch
    return few.join(every, meet).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many elements of all sets fall into each of COUNTERS counters, an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            flat = batch.column("elements").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        for a in range(0, len(used), 1 << 17):
            at = used[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    rows = map_batches(sets.select("elements"), run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """node, n, key, leads: the rarest shingles of each set, as many as an alike set can miss; leads
    marks those that suffice where the other set is not smaller."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, leads = [], [], [], []
            for node, elements in zip(batch.column("node").to_pylist(), batch.column("elements"), strict=True):
                e = elements.values.to_numpy(zero_copy_only=False).view(np.uint64)
                n = len(e)
                long = n - -(-percent * n // 100) + 1
                short = n - -(-2 * percent * n // (100 + percent)) + 1
                seen = shared.value[(e % np.uint64(COUNTERS)).astype(np.int64)]
                own = e[np.lexsort((e, seen))[:long]]
                nodes.append(np.full(len(own), node))
                sizes.append(np.full(len(own), n))
                keys.append(own.view(np.int64))
                leads.append(np.arange(len(own)) < short)
            arrays = [pa.array(np.concatenate(x)) for x in (nodes, sizes, keys, leads)]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "key", "leads"])

    return map_batches(sets, run, "node long, n long, key long, leads boolean")


def pairs_across(documents: DataFrame, buckets: DataFrame, groups: DataFrame, parity: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidates (a < b) of all buckets that lie in different components, see the module's step 4.
    Leaders have met all members already, so they are left out."""
    rows = cut(
        buckets.where("node <> lead")
        .join(groups, "node", "left")
        .select("key", "node", F.coalesce("component", "node").alias("component"))
        .distinct(),
        "dedup-rows",
    )
    sizes = rows.groupBy("key", "component").count().groupBy("key").agg(
        (F.sum("count") - F.max("count")).alias("few"), F.sum("count").alias("all")
    )
    kinds = cut(sizes.where("few > 0").select("key", F.col("all").alias("n"), (F.col("few") > FEW).alias("heavy")), "dedup-kinds")
    marked = spread_join(rows, kinds.select("key", "heavy"), ["key"], "node", kinds.select("key", "n"))
    light = marked.where("not heavy").select("key", "node", "component", F.lit(True).alias("leads"))
    pairs = _meet(light, parity, percent)
    heavy = cut(marked.where("heavy").select("node", "component").distinct(), "dedup-heavy")
    if heavy.isEmpty():
        return pairs
    sets = cut(_sets_of(documents, heavy.select("node").distinct(), k), "dedup-heavy-sets")
    rarest = cut(prefixes(sets, shingle_counts(sets), percent).drop("n").join(heavy, "node"), "dedup-rarest")
    return pairs.union(_meet(rarest, parity, percent)).distinct()


def shared_ids(sk: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of the classes that hold one doc_id."""
    both = F.struct("f1", "f2")
    ids = cut(
        sk.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(both).alias("x"), F.max(both).alias("y")).where("x <> y").select("doc_id"),
        "dedup-shared",
    )
    if ids.isEmpty():
        return ids.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    held = cut(
        sk.join(small_side(ids), "doc_id", "left_semi").where("n_shingles > 0").join(classes.drop("n"), ["f1", "f2"]).select("doc_id", "node").distinct(),
        "dedup-held",
    )
    least = held.groupBy("doc_id").agg(F.min("node").alias("a"))
    return held.join(small_side(least), "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(
    documents: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    sk = cut(sketches(documents, k, bands, rows), "dedup-sketches")
    classes = cut(
        sk.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")),
        "dedup-classes",
    )
    reps = sk.join(
        classes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "node"),
        (F.col("doc_id") == F.col("node")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")),
    )
    rows_of = reps.select("node", F.explode("keys").alias("key"))
    mask = F.xxhash64("key")  # ids under a mask of the bucket's own: its least is a random member
    shared = cut(
        rows_of.select("key", F.col("node").bitwiseXOR(mask).alias("m"))
        .groupBy("key")
        .agg(F.min("m").alias("low"), F.max("m").alias("high"), F.count("*").alias("n"))
        .where("low < high")
        .select("key", F.col("low").bitwiseXOR(mask).alias("lead"), "n"),
        "dedup-leads",
    )
    met = spread_join(rows_of, shared.drop("n"), ["key"], "node", shared.select("key", "n"))
    buckets = cut(met.select("key", "lead", "node"), "dedup-buckets")
    first = cut(
        buckets.where("node <> lead")
        .select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
        .distinct(),
        "dedup-pairs",
    )
    links = cut(verified(documents, first, k, percent).union(shared_ids(sk, classes)), "dedup-links")
    groups = cut(components(links), "dedup-groups")
    parity = reps.select("node", F.col("n_shingles").alias("n"), "parity")
    rest = cut(pairs_across(documents, buckets, groups, parity, k, percent), "dedup-pairs")
    if not rest.isEmpty():
        more = cut(verified(documents, rest, k, percent), "dedup-links")
        groups = cut(components(links.union(more)), "dedup-groups")
    named = classes.join(groups, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    some = F.col("n_shingles") > 0  # rows without words all have one fingerprint, which is no class
    linked = spread_join(sk.where(some).drop("keys", "parity"), named, ["f1", "f2"], "doc_id", classes.select("f1", "f2", "n"), "left")
    alone = sk.where(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        linked.select("doc_id", "n_shingles", "component").union(alone)
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    )


def filter_documents(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, all columns, with one row of each group of near duplicates.

    A null doc_id stands for one made from the text, beyond all given ones, so such rows are grouped by
    their text and give way to rows with an id. Of rows that repeat the kept doc_id one stays (the
    least hash of its columns). Rows without a word are linked with nothing and all stay."""
    made = F.lit(1 << 62).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))
    own = F.coalesce(F.col("doc_id").cast("long"), made)
    found = cut(near_duplicates(documents.select(own.alias("doc_id"), "text"), k, percent), "dedup-verdicts")
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("own")).distinct(), "dedup-gone")
    has_word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = documents.select(F.struct("*").alias("row"), own.alias("own"), has_word.alias("has_word"))
    rows = rows.join(small_side(gone), "own", "left_anti")
    again = cut(found.where("kept and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "dedup-again")
    if again.isEmpty():
        return rows.select("row.*")
    rows = rows.join(small_side(again), F.col("has_word") & (F.col("own") == F.col("again")), "left")
    one = rows.where("again is not null").groupBy("again").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.where("again is null").select("row.*").union(one.select("row.*"))
