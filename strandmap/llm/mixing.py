"""Mixing sources to target weights by entropy balancing.

The mix changes the token mass of the documents as little as possible, in
relative entropy, so that every source holds its wanted number of tokens and
every length class keeps its share of them as far as the sources allow. The
convex dual has one multiplier for each source and each class. A source's
multiplier follows from those of the classes, in the task that holds the
source; the classes, which are few, take Newton steps whose gradient and
Hessian (the Schur complement over all sources) are sums that tasks return.
The solution tilts documents exponentially: rate = cap * sigmoid(multiplier of
the source + multiplier of the class), which is exp-tilted mass under an upper
bound of ``cap`` copies. Rates become whole copies by rounding with carried
error, so that the tokens taken stay close to the tokens wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.llm.common import fits, lean, maybe_broadcast, meet, ship, stored

#: Documents of one piece of rounding, Newton steps at most, and the decrease, in shares of all tokens, that ends them.
PIECE, STEPS, TOLERANCE = 2048, 40, 1e-12
#: Groups of the second constraint at most: its Newton system is solved on the driver.
MOST_CLASSES = 64
#: Rows alike in id, source and size that go to one piece together, and sources whose plan is broadcast at most.
ALIKE, BROADCAST_SOURCES = 256, 100_000
#: Words from which on a document belongs to the next length class, and how far, in shares of all tokens for a unit of
#: its multiplier, a class may stay from its share.
LENGTHS, SLACK = (64, 256, 1024, 4096), 0.02
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, text: str = "text") -> F.Column:
    """Number of words of a text; null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(totals: DataFrame) -> DataFrame:
    """Add place: 0, 1, ... by code point of the source, null last, without bringing all sources into one task."""
    in_order = totals.orderBy(F.col("source").isNull(), F.col("source").cast("binary")).withColumn("_at", F.monotonically_increasing_id())
    in_order = stored(in_order, "mix-order")
    part = F.shiftright("_at", 33)
    before, offsets = 0, [(-1, 0)]
    for r in in_order.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets.append((r.part, before))
        before += r.n
    offsets = F.broadcast(totals.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    place = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return in_order.join(offsets, part == F.col("_part")).select(*totals.columns, place.alias("place"))


def weighted_targets(totals: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """Add target to (source, source_size, any others): sources by code point, null last, weigh ``weights`` in turn.

    Together they get ``share`` of all sizes. No target passes ``cap`` times
    its source's size; what is beyond goes to the others by weight, until none
    is above.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = stored(ranked_sources(totals).withColumn("weight", weight).withColumn("full", F.col("source_size") * float(cap)), "mix-weights")
    sums = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = (sums["size"] or 0) * float(share)
    level = total / sums["weight"] if sums["weight"] else 0.0
    while True:  # the level only rises, and each turn fills a source
        over = F.col("weight") * level > F.col("full")
        r = ranked.agg(F.sum(F.when(over, F.col("full")).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        after = (total - r.full) / r.rest if r.rest else level
        if after <= level:
            break
        level = after
    return ranked.select(*totals.columns, F.least(F.col("weight") * level, F.col("full")).alias("target"))


def _sigmoid(x: F.Column) -> F.Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


#: A multiplier this large stands for a rate at its bound.
_FULL = 40.0


def source_multipliers(sizes: np.ndarray, target: np.ndarray, mu: np.ndarray, cap: float) -> np.ndarray:
    """Each row's multiplier so that its groups (columns of sizes), tilted by mu, hold its target; Newton inside a bracket."""
    low = np.full(len(sizes), -_FULL - np.abs(mu).max(initial=0))
    high = -low
    at = np.zeros(len(sizes))
    for _ in range(100):
        rate = cap / (1 + np.exp(-(at[:, None] + mu)))
        held = (sizes * rate).sum(axis=1)
        slope = (sizes * rate * (1 - rate / cap)).sum(axis=1)
        low, high = np.where(held <= target, at, low), np.where(held >= target, at, high)
        step = at + (target - held) / np.maximum(slope, 1e-300)
        after = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.all(np.abs(after - at) <= 1e-13 * (1 + np.abs(at))):
            break
        at = after
    return at


@dataclass
class _Sums:
    """What tasks return of their sources for one Newton step."""

    held: np.ndarray  # tokens by class
    slope: np.ndarray  # of these
    schur: np.ndarray  # what the sources' own multipliers take back, class by class
    dual: float


def _partial_sums(mu: np.ndarray, cap: float):
    g = len(mu)

    def run(batches):
        total = np.zeros(2 * g + g * g + 1)
        for batch in batches:
            target = batch.column("target").to_numpy()
            sizes = batch.column("sizes").flatten().to_numpy().reshape(len(target), g)
            own = source_multipliers(sizes, target, mu, cap)
            x = own[:, None] + mu
            rate = cap / (1 + np.exp(-x))
            held = sizes * rate
            slope = held * (1 - rate / cap)
            root = slope / np.sqrt(np.maximum(slope.sum(axis=1, keepdims=True), 1e-300))
            dual = (sizes * cap * np.logaddexp(0, x)).sum() - (own * target).sum()
            total += np.concatenate([held.sum(axis=0), slope.sum(axis=0), (root.T @ root).ravel(), [dual]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _sums(rows: DataFrame, mu: np.ndarray, cap: float) -> _Sums:
    g = len(mu)
    found = rows.mapInArrow(lean(_partial_sums(mu, cap)), "sums array<double>").collect()  # a row for each task
    t = np.sum([r.sums for r in sorted(found)], axis=0) if found else np.zeros(2 * g + g * g + 1)
    return _Sums(t[:g], t[g : 2 * g], t[2 * g : -1].reshape(g, g), float(t[-1]))


def balance(cells: DataFrame, constraints: dict[str, DataFrame], cap: float = 2.0, slack: float = 0.0) -> dict[str, DataFrame]:
    """Multipliers (key, multiplier) of each constraint.

    cells: one row or more for each combination of groups, with the constraint
    columns (no nulls) and size; documents of one combination share a rate, so
    cells stand for them. constraints: for each column a frame (key, target) of
    one row a group. The first may have any number of groups and is met
    exactly, within what ``cap`` lets its groups hold. A second one has
    ``MOST_CLASSES`` groups at most; with ``slack`` it is met up to slack * all
    tokens * multiplier, so that targets out of reach do no harm.
    """
    first, *second = constraints
    if len(second) > 1:
        raise ValueError("two constraints at most")
    spark = cells.sparkSession
    ship(spark)
    classes = sorted((r.key, float(r.target)) for r in constraints[second[0]].limit(MOST_CLASSES + 1).collect()) if second else [(None, 0.0)]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"the second constraint has more than {MOST_CLASSES} groups")
    of_class = [F.sum(F.when(F.col(second[0]) == key, F.col("size")).otherwise(0).cast("double")) for key, _ in classes] if second else [F.sum(F.col("size").cast("double"))]
    sizes = cells.groupBy(F.col(first).alias("key")).agg(F.array(*of_class).alias("sizes"))
    full = F.aggregate("sizes", F.lit(0.0), lambda s, x: s + x)
    rows = constraints[first].join(sizes, "key").withColumn("full", full).where("full > 0")
    rows = stored(rows.select("key", F.least("target", F.col("full") * cap).cast("double").alias("target"), "sizes"), "balance")
    mu, wanted = np.zeros(len(classes)), np.array([t for _, t in classes])
    if second:
        whole = float(rows.agg(F.sum("target")).first()[0] or 0.0) or 1.0
        ridge = slack * whole
        now = _sums(rows, mu, cap)
        value = lambda s, m: s.dual - m @ wanted + ridge * (m @ m) / 2
        for _ in range(STEPS):
            gradient = now.held - wanted + ridge * mu
            hessian = np.diag(now.slope + ridge) - now.schur
            # Where nothing is gained by shifting all classes together, the shortest step is taken.
            step = -np.linalg.lstsq(hessian, gradient, rcond=1e-11)[0]
            gain = -(gradient @ step)
            if gain <= TOLERANCE * whole:
                break
            length = min(1.0, 8.0 / max(np.abs(step).max(), 1e-300))
            while True:
                trial = mu + length * step
                then = _sums(rows, trial, cap)
                if value(then, trial) <= value(now, mu) - 1e-4 * length * gain or length < 1e-6:
                    break
                length /= 2
            mu, now = trial, then

    def solve(batches):
        for batch in batches:
            target = batch.column("target").to_numpy()
            own = source_multipliers(batch.column("sizes").flatten().to_numpy().reshape(len(target), len(mu)), target, mu, cap)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own)], names=["key", "multiplier"])

    kind = rows.schema["key"].dataType.simpleString()
    out = {first: stored(rows.mapInArrow(lean(solve), f"key {kind}, multiplier double"), "multipliers")}
    if second:
        kind = constraints[second[0]].schema["key"].dataType.simpleString()
        out[second[0]] = spark.createDataFrame([(k, float(m)) for (k, _), m in zip(classes, mu, strict=True)], f"key {kind}, multiplier double")
    return out


def _tilted(rows: DataFrame, multipliers: dict[str, DataFrame], cap: float = 2.0) -> DataFrame:
    total = F.lit(0.0)
    for i, (name, m) in enumerate(multipliers.items()):
        m = maybe_broadcast(m.select(F.col("key").alias(name), F.col("multiplier").alias(f"_m{i}")), 100_000)
        rows = rows.join(m, name, "left")
        total = total + F.coalesce(F.col(f"_m{i}"), F.lit(0.0))
    return rows.withColumn("rate", cap * _sigmoid(total)).drop(*(f"_m{i}" for i in range(len(multipliers))))


def length_class(size: F.Column) -> F.Column:
    """0, 1, ...: the number of ``LENGTHS`` that a document reaches."""
    return F.size(F.filter(F.array(*map(F.lit, LENGTHS)), lambda x: x <= size)).cast("int")


def round_rates(rates: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole copies next to each rate; the tokens that one document is short of are carried to the next."""
    copies = []
    carried = 0.0
    for rate, size in zip(rates.tolist(), sizes.tolist(), strict=True):
        low = int(rate)
        copy = low
        if rate > low:
            copy = low + (rate - low + (carried / size if size else 0.0) >= 0.5)
            carried += (rate - copy) * size
        copies.append(copy)
    return np.array(copies, np.int64)


def _round_piece(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.loc[pdf.index.repeat(pdf["alike"])]
    pdf = pdf.sort_values(["size", "no_id", "doc_id"], ascending=[False, True, True], kind="stable")
    return pdf.assign(copies=round_rates(pdf["rate"].to_numpy(), pdf["size"].to_numpy())).drop(columns=["key", "piece", "alike"])


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    size is the number of words (null text: 0), source_size and target are those
    of the row's source, taken = copies * size. A null source is a source of
    its own, the last. copies lies between 0 and ``cap`` rounded up, and no
    document gives more than cap times its size where cap is a whole number.
    Within a source, documents of the length classes that the mix would lose
    are taken at a higher rate. Sources without words have the target 0.
    Repeated rows are documents of their own, a null doc_id is an id like
    others. An empty table gives no rows. Other columns are left out. All is a
    function of the rows, whatever their order, so reruns agree.

    Large sources are rounded in pieces of about ``PIECE`` documents, from the
    longest to the shortest, which leaves each piece short by some words at most.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), sizes(docs, text).alias("size"))
    rows = stored(rows, "mix-rows")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    cells = stored(rows.groupBy("source", length_class(F.col("size")).alias("length")).agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-cells")
    totals = cells.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("source_rows"))
    totals = stored(weighted_targets(totals, weights, share, cap).withColumn("key", key), "mix-sources")
    # Sources at their cap take every document cap times, whatever its length; the others share what is left of each class.
    free = F.col("target") < F.col("source_size") * cap
    open_cells = cells.withColumn("key", key).join(maybe_broadcast(totals.where(free).select("key"), 100_000), "key", "left_semi")
    wanted = totals.where(free).agg(F.sum("target").alias("t"), F.sum("source_size").alias("s")).first()
    lengths = open_cells.groupBy(F.col("length").alias("key")).agg((F.sum("size") * ((wanted.t or 0.0) / (wanted.s or 1))).alias("target")).where("target > 0")
    multipliers = balance(open_cells, {"key": totals.where(free).select("key", "target"), "length": lengths}, cap, SLACK)
    of_length = {r.key: r.multiplier for r in multipliers["length"].collect()}
    mu = F.element_at(F.array(*(F.lit(of_length.get(i, 0.0)) for i in range(len(LENGTHS) + 1))), length_class(F.col("size")) + 1)
    pieces = F.ceil(F.col("source_rows") / PIECE).cast("long")
    plan = totals.join(multipliers["key"], "key", "left").select("key", "source_size", "target", F.when(~free, _FULL).otherwise(F.coalesce("multiplier", F.lit(0.0))).alias("own"), free.alias("free"), pieces.alias("pieces"), "source_rows")
    plan = stored(plan, "mix-plan")
    rate = F.when(F.col("free"), cap * _sigmoid(F.col("own") + mu)).otherwise(F.lit(float(cap)))
    # Rows alike, such as those without an id, are counted before they move, and dealt in bounded lots.
    lots = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")).withColumn("key", key)
    last = F.ceil(F.col("m") / ALIKE).cast("long") - 1
    lots = lots.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("alike", F.least(F.lit(ALIKE), F.col("m") - F.col("lot") * ALIKE).cast("int")).drop("m")
    planned = lots.join(F.broadcast(plan), "key") if fits(plan, BROADCAST_SOURCES) else meet(lots, plan, ["key"], "source_rows")
    tilted = planned.withColumn("rate", rate).withColumn("piece", F.pmod(F.xxhash64("doc_id", "size", "lot"), F.col("pieces")))
    # pandas would make long ids beside nulls floats.
    tilted = tilted.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    schema = "doc_id long, no_id boolean, source string, size long, source_size long, target double, rate double, copies long"
    out = tilted.select("doc_id", "no_id", "source", "size", "key", "piece", "source_size", "target", "rate", "alike").groupBy("key", "piece").applyInPandas(_round_piece, schema)
    out = out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _row_keys(doc_id: F.Column, source: F.Column, size: F.Column) -> dict[str, F.Column]:
    """What a row is known by in a mix, without nulls, so that nulls are equal to each other."""
    return {
        "_no_id": doc_id.isNull(),
        "_id": F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")),
        "_no_source": source.isNull(),
        "_source": F.coalesce(source.cast("string"), F.lit("")),
        "_size": size,
    }


def repeat(docs: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed``, their mix, has copies of them.

    Every row takes its own copies: rows are known by doc_id, source and size,
    nulls included. Rows alike in all three may differ by one copy in the mix;
    then those first by a hash of the row take the copy more, so the words
    taken are those of the mix.
    """
    keys = _row_keys(F.col("doc_id"), F.col("source"), F.col("size"))
    plan = mixed.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.min("copies").alias("_low"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("_more"))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = _row_keys(F.col("doc_id").cast("long"), F.col("source"), sizes(docs, text)) | {"_hash": F.xxhash64(*hashed), "_row": F.struct(*(F.col(f"`{c}`") for c in docs.columns))}
    rows = docs.select(*(c.alias(k) for k, c in own.items())).join(plan, list(keys))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    rows = rows.withColumn("_copies", F.col("_low") + (nth <= F.col("_more")).cast("long"))
    return rows.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("_copies") > 0, F.col("_copies"))))).select("_row.*")
