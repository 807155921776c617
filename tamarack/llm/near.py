"""N-gram Jaccard join by a MinHash LSH forest (operator 4).

Texts are sets of hashes of five-word shingles; texts with one set are copies and are one
node from here on.  A tree of the forest sorts the sets by a label of ``DEPTH`` min-hashes;
sets which share a prefix of their labels are candidates.  Matching starts with whole
labels and shortens the prefix until the expected share of links found reaches ``TARGET``:
each link found with similarity s counts for itself and for the 1/P(s) - 1 like it which
the forest misses, P(s) = 1 - (1 - s^prefix)^trees.  Links are between different sets, and
each component counts alike, so that one large group can't speak for all the small ones.
With one min-hash left, next to nothing is missed, so the target is always reached.

Candidates only say what to compare.  Their components bring sets together, each set once,
and all pairs of a component are then compared exactly.  Components with more than ``BLOCK``
sets, or ``CELLS`` shingles, are cut into blocks of similar set sizes, and pairs of blocks
are compared by separate tasks.  Pairs never leave a task: a set's links are added up there, and the links needed to
hold a class together leave as a star.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import discard, durable, fresh, map_arrow, pieces, read, shuffle_width
from .graph import components

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH = 20, 6
TARGET = 0.9995
#: Sets and shingles of one block (a set of more shingles is a block of its own).
BLOCK, CELLS = 256, 1 << 17
SALTS = 16
#: Bytes of text which a task works on at once (more where one text has more).
PIECE = 1 << 20
#: Bits of the filter which spares texts without candidates a shuffle: 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def text_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, at = tv.shingles(texts, width)
    return [np.unique(hashes[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def set_number(hashes: np.ndarray) -> bytes:
    """128 bits which stand for a set: two sums of its mixed hashes, and its size."""
    n = np.uint64(len(hashes))
    a, b = np.add.reduce(tv.mix64(hashes)), np.add.reduce(tv.mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return tv.mix64(np.array([a + n, b - n], np.uint64)).astype(">u8").tobytes()


def labels(sets: list[np.ndarray], trees: int = TREES, depth: int = DEPTH) -> list[bytes]:
    """Label of each set in each tree: ``depth`` min-hashes of 16 bits, end to end."""
    size = np.array([max(1, len(s)) for s in sets])
    flat = np.concatenate([s if len(s) else np.zeros(1, np.uint64) for s in sets]) if sets else np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    seeds = tv.mix64(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64))
    out = np.zeros((len(sets), trees * depth), ">u2")
    for k in range(trees * depth):
        least = np.minimum.reduceat(flat * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1], first)
        out[:, k] = tv.mix64(least) >> np.uint64(48)
    return [row.tobytes() for row in out]


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, sid, n, label of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in pieces(batch, PIECE):
                sets = text_sets(batch.column(1).slice(a, b - a).to_pylist())
                columns = [pa.array([set_number(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(labels(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["key", "sid", "n", "label"])

    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, f"key {dict(rows.dtypes)['key']}, sid binary, n bigint, label binary")


def _candidates(sets: DataFrame, depth: int) -> DataFrame:
    """Stars (u, v) over the sets that share the first ``depth`` min-hashes of a tree.

    A prefix shared by many is dealt into pieces; each piece is a star, and so are the
    centres of the pieces.
    """
    prefix = lambda t: F.substring("label", 2 * DEPTH * t + 1, 2 * depth)
    rows = sets.filter("n > 0").select("sid", F.posexplode(F.array(*[F.xxhash64(F.lit(t), prefix(t)) for t in range(TREES)])).alias("tree", "prefix"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("sid"), F.lit(SALTS)))
    rows = rows.withColumn("centre", F.min("sid").over(Window.partitionBy("tree", "prefix", "piece")))
    spokes = rows.filter("sid <> centre").select(F.col("sid").alias("u"), F.col("centre").alias("v"))
    middle = rows.filter("sid = centre").withColumn("v", F.min("sid").over(Window.partitionBy("tree", "prefix")))
    return spokes.union(middle.filter("sid <> v").select("sid", "v")).distinct()


def _bits(rows: DataFrame, column: str):
    """A map of the hashed values of a column, for the workers; others may share their bits."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1
    maps = rows.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps:  # at most FILTER_BITS bits together, 4 KB a row
        bits[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


def _hit(bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bits[(bit - 1) // 8] >> ((bit - 1) % 8).astype(np.uint8) & 1).astype(bool)


def _with_shingles(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds the shingle hashes to wanted(sid, key, ...), one text being read for each set."""
    bit = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)) + 1
    sent = _bits(wanted, "key")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.array(_hit(sent.value, batch.column(1).to_numpy())))
            for a, b in pieces(batch, PIECE):
                sets = text_sets(batch.column(2).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([set_number(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["k", "sid", "shingles"])

    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("key", bit.alias("bit"), "text")
    found = map_arrow(rows, run, f"k {dict(rows.dtypes)['key']}, sid binary, shingles binary")
    out = durable(wanted.join(found, "sid").filter(F.col("key").eqNullSafe(F.col("k"))).drop("k").dropDuplicates(["sid"]))
    sent.destroy()
    return out


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of membership matrices."""
    m = len(sets)
    _, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    common = times[back] > 1
    column = (np.cumsum(times > 1) - 1)[back[common]]
    owner, out = owner[common], np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    return out


def compare(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, depth: int, threshold: float = THRESHOLD):
    """Exact links within a block (all of side 0) or between two (sides 1 and 2).

    Returns for each set the weight of its links, their number, the number of those expected
    to be missed, and the least set of its local class.
    """
    m, size = len(sets), np.array([len(s) for s in sets], np.float64)
    both = shared(sets).astype(np.float64)
    joined = size[:, None] + size[None, :] - both
    # Written so that a similarity of exactly the threshold counts, whatever its rounding.
    link = both * 1000 >= joined * round(threshold * 1000)
    link &= side[:, None] != side[None, :] if side[0] else ~np.eye(m, dtype=bool)
    found = 1 - (1 - np.where(link, both / joined, 1.0) ** depth) ** TREES
    missed = np.where(link, 1 / found - 1, 0.0)
    root = np.arange(m)
    while True:
        best = np.minimum(root, np.where(link, root[None, :], m).min(1))
        best = best[best]
        if (best == root).all():
            break
        root = best
    return (link * weight[None, :]).sum(1), link.sum(1), missed.sum(1), root


def _verify(rows: DataFrame, depth: int) -> DataFrame:
    """sid, component, links, pairs, missed, root of the sets in rows(group, side, component, sid, copies, shingles)."""
    fields = "sid binary, component binary, links bigint, pairs bigint, missed double, root binary"

    def run(batches):
        import pyarrow as pa

        def close(held):
            # Sets are read where Arrow holds them; no Python object is made of a shingle.
            rows = pa.Table.from_batches(held).combine_chunks()
            blobs = rows.column("shingles").chunk(0)
            ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
            raw = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)
            sets = [raw[x:y].view("<u8") for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            weight = rows.column("copies").to_numpy()
            links, pairs, missed, root = compare(sets, rows.column("side").to_numpy(), weight, depth)
            columns = [rows.column("sid").chunk(0), rows.column("component").chunk(0), *map(pa.array, (links, pairs, missed)), rows.column("sid").chunk(0).take(pa.array(root))]
            return pa.RecordBatch.from_arrays(columns, names=["sid", "component", "links", "pairs", "missed", "root"])

        group, held = None, []
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if of[a] != group and held:
                    yield close(held)
                    held = []
                group = of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield close(held)

    return map_arrow(rows.sortWithinPartitions("group", "sid"), run, fields)


def _groups(members: DataFrame) -> DataFrame:
    """Deals members(component, sid, n, ...) into the groups whose pairs are compared.

    A component of at most BLOCK sets and CELLS shingles is one group.  In a larger one, sets whose sizes are
    more than a step of 1 / threshold apart can't be linked, so blocks are pieces of such
    steps, and a group is a block or two blocks of the same or of neighbouring steps.
    """
    step = F.floor(F.log("n") / float(np.log(1 / THRESHOLD) + 1e-9)).cast("int")
    members = members.withColumn("step", step)
    counts = members.groupBy("component", "step").agg(F.count("*").alias("c"), F.sum("n").alias("cells"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.least("c", F.ceil(F.col("cells") / CELLS))).cast("int")
    total = counts.groupBy("component").agg(F.greatest(F.sum("c") / BLOCK, F.sum("cells") / CELLS).alias("total"), F.map_from_entries(F.collect_list(F.struct("step", blocks))).alias("blocks"))
    members = members.join(total, "component")
    keep = ["component", "sid", "copies", "key"]
    few = members.filter("total <= 1").select(*keep, F.xxhash64("component").alias("group"), F.lit(0).alias("side"))
    many = members.filter("total > 1")
    many = many.withColumn("here", F.struct("step", F.pmod(F.xxhash64("sid"), F.element_at("blocks", F.col("step"))).cast("int").alias("own")))
    near = F.expr(
        "flatten(transform(filter(array(step - 1, step, step + 1), s -> map_contains_key(blocks, s)), "
        "s -> transform(sequence(1, element_at(blocks, s)), i -> named_struct('step', s, 'own', i - 1))))"
    )
    many = many.withColumn("there", F.explode(near))
    group = F.xxhash64("component", F.least("here", "there"), F.greatest("here", "there"))
    side = F.when(F.col("here") == F.col("there"), 0).when(F.col("here") < F.col("there"), 1).otherwise(2)
    return few.union(many.select(*keep, group.alias("group"), side.alias("side")))


def _recall(found: DataFrame) -> float:
    """Expected share of the links between different sets which were found, all components alike."""
    each = found.groupBy("component").agg(F.sum("pairs").alias("pairs"), F.sum("missed").alias("missed")).filter("pairs > 0")
    n, like = each.agg(F.count("*"), F.sum(1 + F.col("missed") / F.col("pairs"))).head()
    return n / like if n else 1.0


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class and number of links of each text among all texts.

    Returns ``id_col``, class_id (the least id of the class: texts joined by links, directly or
    through others) and n_links (how many other texts, copies included, have a Jaccard
    similarity of at least 0.8).  One row per input row.  Texts of fewer than five words
    have one shingle; texts without words, nulls among them, are copies of each other; very
    long texts are compared by all their shingles.
    Repeated rows are copies.  Null ids name a class only if it has no other.  An empty table
    gives an empty table; other columns are not read.
    """
    signed = durable(_signatures(docs, id_col, text_col))
    sets = durable(signed.groupBy("sid").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("label").alias("label")))
    done, shapes = None, None
    for depth in range(DEPTH, 0, -1):
        parts = durable(components(_candidates(sets, depth)).withColumnRenamed("node", "sid"))
        shape = durable(parts.groupBy("component").agg(F.count("*").alias("m"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("h")))
        same = None if shapes is None else shape.join(shapes, ["component", "m", "h"], "left_semi")
        new = parts if same is None else parts.join(same, "component", "left_anti")
        grouped = durable(_groups(new.join(sets.select("sid", "key", "copies", "n"), "sid")))
        texts = _with_shingles(docs, grouped.select("sid", "key").distinct(), id_col, text_col)
        rows = grouped.join(texts.select("sid", "shingles"), "sid").select("group", "side", "component", "sid", "copies", "shingles")
        found = durable(_verify(rows.repartition(shuffle_width(docs.sparkSession), "group"), depth))
        discard(texts, grouped)
        if same is not None:
            # What was found in components that are as they were holds; it was found at a greater depth.
            every = durable(found.unionByName(done.join(same, "component", "left_semi")))
            discard(found, done, shapes)
            found = every
        discard(parts)
        done, shapes = found, shape
        if _recall(done) >= TARGET and (depth == 1 or 1 - (1 - THRESHOLD**depth) ** TREES >= TARGET or not done.isEmpty()):
            break
    links = done.groupBy("sid").agg(F.sum("links").alias("links"))
    merged = components(done.select(F.col("sid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "sid")
    facts = sets.select("sid", "key", "copies").join(links, "sid", "left").join(merged, "sid", "left")
    facts = durable(facts.select("sid", "key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "sid").alias("class")))
    # A class or a set may hold a third of all rows: its name is dealt over pieces.
    piece = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    every = F.array(*map(F.lit, range(SALTS)))
    names = facts.groupBy("class").agg(F.min("key").alias("class_id")).withColumn("piece", F.explode(every))
    facts = facts.withColumn("piece", piece("sid")).join(names, ["class", "piece"])
    facts = facts.withColumn("piece", F.explode(F.when(F.col("copies") == 1, F.array(piece("key"))).otherwise(every)))
    out = signed.select("key", "sid", piece("key").alias("piece")).join(facts.select("sid", "piece", "class_id", "n_links"), ["sid", "piece"])
    return out.select(F.col("key").alias(id_col), "class_id", "n_links")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the table whose text is the first, by id, of its class, with all their columns.

    Rows which repeat an id are one document, of which one row stays; rows without an id
    are left alone.
    """
    classes = durable(near_classes(docs, id_col, text_col))
    gone = durable(classes.filter(F.col(id_col) != F.col("class_id")).select(id_col).distinct())
    # Rows whose bit isn't set stay without being shuffled; only the others are joined.
    sent, bit = _bits(gone, id_col), F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS)) + 1
    mark = fresh(docs, "__gone")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_columns - 1
            hit = pa.array(_hit(sent.value, batch.column(n).to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], hit], names=batch.schema.names[:n] + [mark])

    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.BooleanType())])
    marked = durable(map_arrow(docs.withColumn(mark, bit.cast("bigint")), run, schema))
    sent.destroy()
    part = lambda hit: marked.filter(F.col(mark) if hit else ~F.col(mark)).drop(mark)
    kept = part(False).unionByName(part(True).join(gone, id_col, "left_anti").select(docs.columns))
    ids = classes.filter(F.col(id_col).isNotNull()).select(id_col)
    if ids.count() > ids.distinct().count():
        number = fresh(docs, "__n")
        numbered = kept.withColumn(number, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))))
        kept = numbered.filter(F.col(id_col).isNull() | (F.col(number) == 1)).drop(number)
    return kept.select(docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))
