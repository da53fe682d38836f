"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash gives every element of a set one random permutation of the
signature's places and one random fraction for each of them; place p keeps the
least of (turn at which an element reaches p) + (fraction of that turn). Ranks
of one element are thus correlated, which lowers the variance of the estimated
similarity, and no later turn can lower any place once all are below it, so
large sets stop after a few turns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm import textkernel as K
from strandmap.llm.common import CROWD, free_name, lean, maybe_broadcast, meet, ship, stored, text_slices
from strandmap.llm.graph import UnionFind, connected_components
from strandmap.llm.vectors import runs

U64 = np.uint64

#: Places of a signature, and places in a band. At a similarity of 0.8 a pair
#: shares none of 32 bands of 4 with a chance of 5e-8.
PLACES, BAND = 128, 4
#: A candidate of a crowded bucket is verified if its estimate is this high:
#: five and a half standard deviations below 0.8.
ESTIMATE = 0.6
#: Rows of a bucket that one tile holds on a side, and elements of their sets.
TILE, TILE_ELEMENTS = 512, 4_000_000
#: Tiles of one row that meet its set in one task: a square of tiles has this many on a side.
SQUARE_BITS = 5
SQUARE = 1 << SQUARE_BITS
#: Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000
_SLICE = 1_000_000
_ELEMENTS = 65_536


def superminhash(elements: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures, one row a set, of sets laid end to end: set i is elements[bounds[i]:bounds[i + 1]].

    An empty set keeps the largest value everywhere.
    """
    n = len(bounds) - 1
    signature = np.full(n * places, np.iinfo(U64).max, U64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    turns = np.tile(np.arange(places, dtype=np.uint8), (len(elements), 1))
    live = np.arange(len(elements))
    for j in range(places):
        if not len(live):
            break
        draw = K.mix(elements[live] ^ U64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        swap = j + ((draw >> U64(40)) * U64(places - j) >> U64(24)).astype(np.int64)
        place = turns[live, swap]
        turns[live, swap] = turns[live, j]
        value = (U64(j) << U64(56)) | (K.mix(draw) >> U64(8))
        np.minimum.at(signature, owner[live] * places + place, value)
        going = signature.reshape(n, places).max(axis=1) >= (U64(j + 1) << U64(56))
        live = live[going[owner[live]]]
    return signature.reshape(n, places)


def short_signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures of 16 bits a place, which is what is stored and compared."""
    out = np.zeros((len(sets), places), np.uint16)
    sizes = np.array([len(s) for s in sets])
    for a, b in text_slices(sizes, _ELEMENTS):
        bounds = np.concatenate([[0], np.cumsum(sizes[a:b])])
        flat = np.concatenate(sets[a:b]) if bounds[-1] else np.zeros(0, U64)
        out[a:b] = (K.mix(superminhash(flat, bounds, places)) >> U64(48)).astype(np.uint16)
    return out


def _sets(batch: pa.RecordBatch, width: int):
    """(first row, last row, shingle sets) of a batch, a bounded number of bytes at a time."""
    data, offsets = K.flat(batch.column("text"))
    for a, b in text_slices(np.diff(offsets), _SLICE):
        part = offsets[a : b + 1]
        yield a, b, K.row_shingles(data[part[0] : part[-1]], part - part[0], width)


def _features(width: int):
    def run(batches):
        for batch in batches:
            for a, b, sets in _sets(batch, width):
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                signatures = short_signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array([s.tobytes() for s in signatures], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "signature"],
                )

    return run


def signatures(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, set_key (a cryptographic digest of the whole set, 128 bits) and signature of each row."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_shingles long, set_key binary, signature binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_features(width)), schema)


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            for a, b, sets in _sets(batch, width):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "elements"])

    return run


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = common(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted doc_ids; up to ``BROADCAST_IDS`` of them spare the texts a shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(maybe_broadcast(wanted, BROADCAST_IDS), "doc_id", "left_semi")


def _dealt(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """``payload`` (a, one more) of each a of ``pairs``, once for each of its pieces, so that no crowd of pairs meets it in one task."""
    return pairs.select("a", "piece").distinct().join(payload, "a")


def in_pieces(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with a piece: pairs of one a are cut into pieces of about ``CROWD``."""
    counts = stored(pairs.groupBy("a").agg(F.count("*").alias("m")), "pair-counts")
    pieces = F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CROWD)).cast("long")
    return meet(pairs, counts, ["a"], "m").select("a", "b", pieces.alias("piece"))


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, piece) of doc_ids whose full shingle sets are similar enough, as (a, b)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(full_sets(docs, wanted, width), "sets")
    joined = pairs.join(sets.toDF("b", "y"), "b").join(_dealt(pairs, sets.toDF("a", "x")), ["a", "piece"])
    return joined.select("a", "b", "x", "y").mapInArrow(lean(_verified(percent)), "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, elements): the whole sorted shingle sets of the wanted doc_ids, 64 bits a shingle."""
    return _texts_of(docs, wanted).mapInArrow(lean(_full_sets(width)), "doc_id long, elements binary").dropDuplicates(["doc_id"])


def _alike(estimate: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("x", "y"))
                keep = (x == y).sum(axis=1) >= estimate * x.shape[1]
                yield batch.select(["a", "b", "piece"]).filter(pa.array(keep))

    return run


def alike(pairs: DataFrame, classes: DataFrame, estimate: float) -> DataFrame:
    """The pairs (a, b, piece) whose signatures agree in a share of ``estimate`` of their places or more."""
    short = classes.select("a", "signature")
    joined = pairs.join(short.toDF("b", "y"), "b").join(_dealt(pairs, short.toDF("a", "x")), ["a", "piece"])
    return joined.select("a", "b", "piece", "x", "y").mapInArrow(lean(_alike(estimate)), "a long, b long, piece long")


def _tiles(labelled: DataFrame) -> DataFrame:
    """Deal buckets of several components over tiles of bounded size that cover every pair of different components.

    A bucket's most frequent component L needs no comparison with itself: its
    pieces meet only the pieces of the rest R, and these meet each other. So a
    bucket of one large component and a few strays stays linear in its size.
    Buckets of two rows are left out: the star has tested their only pair.
    """
    counts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("e"))
    main = counts.groupBy("bucket").agg(F.max_by(F.struct("component", "k", "e"), F.struct("k", -F.col("component"))).alias("main"), F.sum("k").alias("m"), F.sum("e").alias("e"), F.count("*").alias("components"))
    pieces = lambda k, e: F.greatest(F.ceil(k / TILE), F.ceil(e / TILE_ELEMENTS))
    main = main.where("components > 1 and m > 2").select("bucket", "m", F.col("main.component").alias("main"), pieces(F.col("main.k"), F.col("main.e")).alias("l_pieces"), pieces(F.col("m") - F.col("main.k"), F.col("e") - F.col("main.e")).alias("r_pieces"))
    rows = meet(labelled, stored(main, "crowded"), ["bucket"], "m").withColumn("in_main", F.col("component") == F.col("main"))
    piece = F.pmod(F.xxhash64("a"), F.when(F.col("in_main"), F.col("l_pieces")).otherwise(F.col("r_pieces")))
    rows = rows.withColumn("piece", piece.cast("long"))
    last_l, last_r = (F.col(c).cast("long") - 1 for c in ("l_pieces", "r_pieces"))
    # A tile is (bucket, x, y): x < 0 is piece -1 - x of L, else a piece of R; y is a piece of R.
    main_tiles = F.transform(F.sequence(F.lit(0).cast("long"), last_r), lambda j: F.struct((-1 - F.col("piece")).alias("x"), j.alias("y"), F.lit(0).alias("side")))
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), last_l), lambda i: F.struct((-1 - i).alias("x"), F.col("piece").alias("y"), F.lit(1).alias("side")))
    among = F.transform(
        F.sequence(F.lit(0).cast("long"), last_r),
        lambda j: F.struct(F.least(j, F.col("piece")).alias("x"), F.greatest(j, F.col("piece")).alias("y"), F.when(j >= F.col("piece"), 0).otherwise(1).alias("side")),
    )
    tiles = F.when(F.col("in_main"), main_tiles).otherwise(F.concat(with_main, among))
    return rows.withColumn("t", F.explode(tiles)).select("bucket", "band", "t.x", "t.y", "t.side", "a", "component", "n")


def deal_sets(tiles: DataFrame, payload: DataFrame) -> DataFrame:
    """``tiles`` with the payload of their a, and no crowd of tiles of one a in one task.

    A stray row of a bucket with a large component is in a tile for each piece
    of it, in up to all bands. Its tiles are cut into squares of ``SQUARE`` by
    ``SQUARE``, of which a row touches ``SQUARE`` tiles a band at the most, and
    the payload is sent once a square.
    """
    square = F.xxhash64(F.shiftright("x", SQUARE_BITS), F.shiftright("y", SQUARE_BITS))
    tiles = tiles.withColumn("piece", square)
    return tiles.join(_dealt(tiles, payload), ["a", "piece"]).drop("piece")


def _tile_links(percent: int, estimate: float):
    """Links between different components of a tile, tested on full sets.

    A pair is tested in the first band that it shares only. A link found is
    true, so the components that it joins need no further pair in the tile.
    """

    def links_of(rows: pa.Table):
        side = rows["side"].to_numpy()
        ids, comps, sizes = (rows[c].to_numpy() for c in ("a", "component", "n"))
        band = int(rows["band"][0].as_py())
        signature = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint16).reshape(len(ids), -1)
        elements = [np.frombuffer(v, U64) for v in rows["elements"].to_pylist()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if rows["x"][0] == rows["y"][0]:
            right = left
        same_tile = right is left
        joined = UnionFind()
        for i in left.tolist():
            other = right[right > i] if same_tile else right
            other = other[(comps[other] != comps[i]) & (100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i]))]
            if not len(other):
                continue
            equal = signature[other] == signature[i]
            shared = equal.reshape(len(other), -1, BAND).all(axis=2)
            hit = other[(shared.argmax(axis=1) == band) & (equal.sum(axis=1) >= estimate * signature.shape[1])]
            for j in hit.tolist():
                c, d = int(comps[i]), int(comps[j])
                if joined.find(c) == joined.find(d):
                    continue
                both = common(elements[i], elements[j])
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    joined.union(c, d)
                    yield (ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])

    def run(batches):
        for _, table in runs(batches, ["bucket", "x", "y"]):
            pairs = np.array(list(links_of(table)), np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    docs: columns doc_id and text, others are ignored. Two documents are linked
    if their sets of ``width``-word shingles have 100 * |intersection| >=
    percent * |union|; component_id is the smallest doc_id that links reach and
    kept marks it. A document of fewer words has its whole sequence as its only
    shingle; null, empty and blank texts have an empty set and link with
    nothing. Rows that repeat a doc_id count as one document. A null doc_id
    has a null component_id and is kept. An empty table gives no rows.

    Candidates: equal sets fall together first, so only their smallest doc_id
    is compared. Every band bucket then links its members to the bucket's
    smallest one, verified on full sets. Only buckets in which several
    components are left get the remaining pairs of different components, in
    tiles of bounded size that test pairs in place. No bucket has a cap.
    """
    feats = stored(signatures(docs, width), "minhash")
    full = F.col("n_shingles").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = feats.where(full).groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("a"), F.first("signature").alias("signature"), F.count("*").alias("m"))
    classes = stored(classes, "classes")
    band = F.transform(F.sequence(F.lit(0), F.lit(PLACES // BAND - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("signature", i * 2 * BAND + 1, F.lit(2 * BAND))).alias("bucket")))
    members = classes.select("a", F.col("n_shingles").alias("n"), F.explode(band).alias("m")).select("a", "n", "m.band", "m.bucket")
    shared = members.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct("a", "n")).alias("c")).where("m > 1")
    shared = stored(shared.select("bucket", "m", F.col("c.a").alias("centre"), F.col("c.n").alias("centre_n")), "shared")
    members = stored(meet(members, shared, ["bucket"], "m").drop("m"), "buckets")
    close = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * percent
    star = members.where(F.col("a") != F.col("centre")).where(close).select(F.col("centre").alias("a"), F.col("a").alias("b")).distinct()
    star = stored(in_pieces(stored(star, "star-pairs")), "star")
    star = stored(alike(star, classes, ESTIMATE), "star-alike")
    links = stored(verify(star, docs, width, percent), "links")
    first = stored(connected_components(links), "components")

    # Buckets that hold members of several components need the pairs between them.
    labelled = members.join(first.withColumnRenamed("node", "a"), "a", "left").select("a", "n", "band", "bucket", F.coalesce("component", "a").alias("component"))
    tiles = stored(_tiles(labelled), "tiles")
    sets = full_sets(docs, tiles.select(F.col("a").alias("doc_id")).distinct(), width).toDF("a", "elements")
    payload = sets.join(classes.select("a", "signature"), "a")
    dealt = deal_sets(tiles, payload).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    more = stored(dealt.mapInArrow(lean(_tile_links(percent, ESTIMATE)), "a long, b long").distinct(), "more")
    groups = connected_components(links.unionByName(more)).withColumnRenamed("node", "a")

    per_class = stored(classes.select("set_key", "n_shingles", "m", "a").join(groups, "a", "left").select("set_key", "n_shingles", "m", F.coalesce("component", "a").alias("component_id")), "class-components")
    # Documents with an empty set, and those without an id, stand alone and meet nothing.
    joined = meet(feats.where(full).select("doc_id", "n_shingles", "set_key"), per_class, ["set_key", "n_shingles"], "m").select("doc_id", "n_shingles", "component_id")
    alone = feats.where(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with all their columns.

    The ids that go are broadcast up to ``BROADCAST_IDS`` of them. Rows with a
    null doc_id stay, as do all rows of a doc_id that stays.
    """
    mark = free_name(docs, "_gone")
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias(mark)).distinct()
    gone = maybe_broadcast(stored(gone, "gone"), BROADCAST_IDS)
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(mark), "left_anti")
