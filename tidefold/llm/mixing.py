"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every document is a packet of its source's queue, and queues are shuffled by a hash. A document's
virtual finish time is the running number of its source's tokens up to its end, divided by the
source's target, so all queues advance evenly. A source is queued again behind itself (a second lap),
since its target may exceed its size. The mix is the packets of all sources in one global order, that
of (virtual finish time, source, place in the queue), truncated where their tokens reach the total
budget; the packet that crosses the budget is cut there. A source's taken words differ from its target
by little more than the size of a document.

No source is gathered in one task: running sums are taken in two levels. Documents fall into hash
slots of bounded size, the slots' sums are summed up along each source, and only inside a slot are
documents ordered. The place of the budget in the global order is found from sums over slices of
virtual time: the slice that the budget falls into is sliced again until few packets are left in it.
Each level is one aggregation whose result has SLICES rows.

Defined results: null text has size 0; a null source is a source of its own, after all others;
documents of size 0 are taken 0 times; rows that repeat a doc_id are documents of their own, and
equal rows are interchangeable (they are counted, queued as one packet and dealt out again); empty input
gives empty output. Extra columns are carried by `materialise` and ignored by `schedule`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Slices of virtual time that are summed up at once, and packets that need no more slicing.
SLICES, FEW = 4096, 4096
#: Copies of a row that are dealt out from one row.
COPIES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(doc_id: Column, text: Column) -> Column:
    """A pseudo-random 60-bit place, the same in every run and every SQL engine."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets by water-filling; sizes has one row per source (source, source_size).

    Sources by code point, null last, take the weights in turn. With level x a source gets
    min(weight * x, most * size); the level is found in closed form: in order of cap / weight the
    first k sources are at their cap, and k is the least for which the next is not. The windows
    without partition run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("level", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    picks = F.array(*[F.lit(w) for w in weights])
    out = (
        sizes.withColumn("weight", F.element_at(picks, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn(
            "weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
        )
        .withColumn("fill", (F.col("budget") - F.col("caps_before")) / F.col("weight_left"))
    )
    water = F.min(F.when(F.col("fill") <= F.col("level"), F.struct("level", "fill"))).over(whole)["fill"]
    return out.withColumn("water", water).select(
        "source",
        "source_size",
        "budget",
        F.when(F.col("water").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("weight") * F.col("water")))
        .alias("target"),
    )


def _slots(documents: DataFrame, weights, share, most, slot_documents):
    """The narrow table of distinct documents with their slots and numbers of copies, and the table of
    slots with the targets."""
    base = cut(
        documents.select(
            "doc_id", "source", size_of(F.col("text")).alias("size"),
            place_of(F.col("doc_id"), F.col("text")).alias("place"),
        )
        .groupBy("doc_id", "source", "size", "place")
        .agg(F.count("*").alias("copies")),
        "mix-sizes",
    )
    n_slots = max(1, -(-base.count() // slot_documents))
    base = base.withColumn("slot", slot_of(F.col("place"), n_slots))
    by_slot = cut(base.groupBy("source", "slot").agg(F.sum(F.col("size") * F.col("copies")).alias("slot_size")), "mix-slots")
    goal = targets(
        by_slot.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, most
    )
    along = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        by_slot.select(F.col("source").alias("s"), F.col("slot").alias("k"), "slot_size")
        .withColumn("ahead", F.coalesce(F.sum("slot_size").over(along), F.lit(0)))
        .join(goal, F.col("s").eqNullSafe(F.col("source")))
        .drop("source")
    )
    return base, slots, n_slots


def slot_of(place: Column, n_slots: int) -> Column:
    return F.floor(place / F.lit((1 << 60) / n_slots)).cast("long")


def _ends(base: DataFrame, slots: DataFrame) -> DataFrame:
    """Adds the position of each document's end in its source's shuffled queue."""
    inside = (
        Window.partitionBy("source", "slot")
        .orderBy("place", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    all_copies = F.col("size") * F.col("copies")
    last = base.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("k"))).select(
        "doc_id", "source", "place", "size", "source_size", "target", "budget", "copies",
        (F.col("ahead") + F.sum(all_copies).over(inside)).alias("last"),
    )
    # the copies of a row, in portions that are spread over tasks where there are many
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    chunks = last.withColumn("chunk", chunk)
    if not base.where(F.col("copies") > COPIES).isEmpty():
        chunks = chunks.repartition("source", "place", "doc_id", "chunk")
    first = F.col("chunk") * COPIES
    nth = F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1))
    return chunks.withColumn("nth", nth).select(
        "doc_id", "source", "place", "size", "source_size", "target", "budget", (F.col("last") - F.col("nth") * F.col("size")).alias("end"),
    )


def _packet(lap: int) -> tuple[Column, Column]:
    """A document's place in its source's queue, laps included, and its virtual finish time."""
    at = F.col("end") + lap * F.col("source_size")
    return at, at / F.col("target")


def budget_end(ends: DataFrame, laps: int) -> tuple | None:
    """The packet that the budget ends in, as (virtual finish time, source, place in the queue, tokens
    of it within the budget); None if all packets are within the budget."""
    packet = [F.struct(_packet(lap)[1].alias("time"), _packet(lap)[0].alias("at")) for lap in range(laps)]
    packets = ends.where("size > 0 and target > 0").select("source", "size", "budget", F.explode(F.array(*packet)).alias("p"))
    packets = packets.select("source", "size", "budget", "p.time", "p.at")
    r = packets.agg(F.min("time"), F.max("time"), F.sum("size"), F.count("*"), F.first("budget")).first()
    low, high, total, n, budget = r
    if not n or total <= (budget := int(budget)):
        return None
    left = budget
    inside = packets
    while n > FEW and high > low:
        width = (high - low) / SLICES
        slot = F.least(F.floor((F.col("time") - low) / width), F.lit(SLICES - 1)).cast("int")
        rows = inside.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("b")).collect()
        for row in sorted(rows, key=lambda x: x.slot):  # at most SLICES rows
            if left < row["size"]:
                break
            left -= row["size"]
        low, high, n = row.a, row.b, row.n
        inside = packets.where(F.col("time").between(low, high))
    order = [F.col("time"), F.col("source").isNull(), F.col("source"), F.col("at")]
    run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # FEW packets
    found = inside.withColumn("run", run).where(F.col("run") > left).orderBy(*order).first()
    return found.time, found.source, found["at"], left - (found.run - found["size"])


def _sent(lap: int, end: tuple | None) -> Column:
    """The tokens of a document's packet that are sent within the budget."""
    at, time = _packet(lap)
    if end is None:
        return F.when(F.col("target") > 0, F.col("size")).otherwise(0)
    last_time, source, last_at, part = end
    same = F.col("source").eqNullSafe(F.lit(source))
    if source is None:  # comes last
        earlier_source = F.col("source").isNotNull()
    else:
        earlier_source = F.coalesce(F.col("source") < F.lit(source), F.lit(False))
    before = (time < last_time) | ((time == last_time) & (earlier_source | (same & (at < last_at))))
    crossing = (time == last_time) & same & (at == last_at)
    return F.when(F.col("target") <= 0, 0).when(before, F.col("size")).when(crossing & (F.col("size") > 0), F.lit(part)).otherwise(0)


def schedule(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    slot_documents: int = 4_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and virtual_finish (of the first lap).

    taken counts the words of the document in all laps that lie within the budget in the global order
    of virtual finish times.
    """
    base, slots, _ = _slots(documents, weights, share, most, slot_documents)
    ends = cut(_ends(base, slots), "mix-ends")
    end = budget_end(ends, _laps(most))
    taken = sum((_sent(lap, end) for lap in range(_laps(most))), F.lit(0)).cast("long")
    return ends.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
        F.when(F.col("target") > 0, F.col("end") / F.col("target")).alias("virtual_finish"),
    )


def _laps(most: float) -> int:
    return max(1, -int(-most // 1))


def materialise(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    slot_documents: int = 4_000,
) -> DataFrame:
    """The mix itself: whole rows of documents, repeated by lap, in the global order.

    Rows are not cut: the packet that the budget ends in is taken if half of it or more lies within.
    Documents of a source are taken in order of their place, so each lap has one greatest place per
    source; the texts meet only the small table of slots and are shuffled once, by the range sort on
    virtual time (which inside a slot follows the place).
    """
    base, slots, n_slots = _slots(documents, weights, share, most, slot_documents)
    ends = cut(_ends(base, slots), "mix-ends")
    end = budget_end(ends, _laps(most))
    last = ends.groupBy("source").agg(
        *[
            F.max(F.when(2 * _sent(lap, end) >= F.greatest(F.col("size"), F.lit(1)), F.col("place"))).alias(f"last{lap}")
            for lap in range(_laps(most))
        ]
    )
    plan = cut(slots.join(last, F.col("s").eqNullSafe(F.col("source"))).drop("source"), "mix-plan")
    rows = documents.select(
        F.struct("*").alias("row"), F.col("source").alias("q"),
        place_of(F.col("doc_id"), F.col("text")).alias("place"),
    ).withColumn("slot", slot_of(F.col("place"), n_slots))
    share_in_slot = F.col("place") / F.lit((1 << 60) / n_slots) - F.col("slot")
    at = F.col("ahead") + share_in_slot * F.col("slot_size")
    laps = F.array(
        *[
            F.when(
                F.col("place") <= F.col(f"last{lap}"),
                (at + lap * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0)),
            )
            for lap in range(_laps(most))
        ]
    )
    sent = rows.join(plan, F.col("q").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("k"))).select(
        "row", "place", F.explode(F.filter(laps, lambda t: t.isNotNull())).alias("time")
    )
    return sent.repartitionByRange("time", "place").sortWithinPartitions("time", "place").select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM s),
l AS (
  SELECT *, cap / weight AS level, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         coalesce(sum(cap) OVER before, 0) AS caps_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM w WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (budget - caps_before) / weight_left AS fill FROM l),
x AS (SELECT (SELECT fill FROM f WHERE fill <= level ORDER BY level, fill LIMIT 1) AS water),
t AS (SELECT source, source_size, budget, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target FROM f, x),
e AS (
  SELECT *, row_number() OVER () AS id,
         sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS ending
  FROM d),
p AS (
  SELECT e.id, e.doc_id, e.source, e.size, t.source_size, t.target, t.budget, lap, ending, ending + lap * t.source_size AS pos
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) laps(lap)),
g AS (
  SELECT *, sum(CASE WHEN target > 0 THEN size ELSE 0 END) OVER (ORDER BY CASE WHEN target > 0 THEN pos / target ELSE 0 END, source IS NULL, source, pos
    ROWS UNBOUNDED PRECEDING) AS run
  FROM p),
k AS (SELECT *, CASE WHEN target > 0 THEN greatest(0, least(size, CAST(floor(budget) AS BIGINT) - (run - size))) ELSE 0 END AS part FROM g)
SELECT doc_id, source, CAST(any_value(size) AS BIGINT) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(part) AS BIGINT) AS taken, CASE WHEN any_value(target) > 0 THEN any_value(ending) / any_value(target) END AS virtual_finish
FROM k GROUP BY id, doc_id, source
"""
