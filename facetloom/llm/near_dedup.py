"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 384 bits: each bit is the sign of a sum over its words, the word's hash giving the sign and its length the weight
(short words, which most documents share, weigh little). Two documents are near copies if their whole fingerprints differ in at most ``radius`` bits.

Search: the fingerprint is cut into ``SEGMENTS`` segments of ``SEGMENT_BITS`` bits, ``ARRANGEMENTS`` times over, each time with its bits in another
fixed order; every segment of every arrangement is a table. Every distinct fingerprint is a row of each table and asks each for all values within one bit of
its own segment (a Hamming ball of 25 values). To halve the probes, of two values that differ in one bit only the one that has it asks for the other.
The balls are enumerated in two parts: flips of a segment's ``HIGH`` uppermost bits before the shuffle, which goes by those bits, and flips of the rest
where the table's rows have met. Pairs within 2 * SEGMENTS - 1 = 31 bits are all found (some segment differs in one bit at most); a pair at
distance d beyond that is missed only if every segment of every arrangement differs in two bits or more.

Groups are connected components of the pairs that are verified on the complete fingerprints, and they are the same as if all pairs that meet in a table
were verified, but a table's value that a third of all documents share is not squared: first each row that meets a value is verified against the
least fingerprint with it only, and the components of those links are found. Then, of the rows that meet a value, only those in different
components need to be compared, which leaves out the members of a large group of near copies. Equal fingerprints are one row of the
search however many documents have them, so thousands of copies cost no more than two. The smallest doc_id of a group stays.

Defined cases: null and wordless texts have no fingerprint and are no copies of anything. Rows with a null doc_id are kept and
stay out of groups. Rows with the same doc_id and the same text count as one document; ``keep_one`` keeps one of them.
Texts are processed whole. Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_chunks, cut, fold_case, join_checked, mix, spans, span_hashes

SEGMENTS, SEGMENT_BITS = 16, 24
WORDS = SEGMENTS * SEGMENT_BITS // 64
#: Most differing bits of near copies: a sixth of all, at which documents share some 87 % of their weighted words.
RADIUS = 64

#: Orders of the bits in which the segments are cut; each adds as many tables.
ARRANGEMENTS = 3
#: Uppermost bits of a segment, by which its table is dealt.
HIGH = 8

_LANES = np.uint64(0x0001000100010001)
#: Weight of a word by its length in bytes: at 12 bytes and more it is the largest.
WEIGHT = np.array([0, 0, 0, 0, 1, 2, 4, 6, 8, 10, 12, 14, 16], np.uint64)
_RUN = 4000  # words whose weights fit 16 bits together


def simhash(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (documents x WORDS of 64 bits) of the texts, and which of them have any word."""
    raw = fold_case(raw)
    start, end = spans(((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 0x80), offsets)
    m = len(offsets) - 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    weight = WEIGHT[np.minimum(end - start, len(WEIGHT) - 1)]
    sums = np.zeros((m, WORDS * 64))
    count = np.bincount(doc, minlength=m)
    heavy = np.bincount(doc, weights=weight, minlength=m)
    weight[(heavy == 0)[doc]] = 1  # a text of short words only
    if len(start):
        h = span_hashes(raw, start, end)
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        cuts = np.unique(np.concatenate([first[count > 0], np.arange(0, len(start), _RUN)]))
        owner = doc[cuts]
        total = np.add.reduceat(weight, cuts).astype(np.int64)
        for w in range(WORDS):
            x = mix(h + np.uint64((w * 0x632BE59BD9B4E019 + 0x1234567) % (1 << 64)))
            for k in range(16):
                lane = np.add.reduceat(((x >> np.uint64(k)) & _LANES) * weight, cuts)
                for j in range(4):
                    ones = ((lane >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64)
                    sums[:, w * 64 + 16 * j + k] += np.bincount(owner, weights=2 * ones - total, minlength=m)
    bits = np.packbits(sums > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64), count > 0


FINGERPRINT = [f"f{i}" for i in range(WORDS)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, offsets in byte_chunks(batch, "text"):
            f, known = simhash(raw, offsets)
            keep = [i for i, name in enumerate(part.schema.names) if name != "text"]
            arrays = [part.column(i) for i in keep] + [pa.array(f[:, w].view(np.int64), pa.int64(), mask=~known) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays(arrays, names=[part.schema.names[i] for i in keep] + FINGERPRINT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text, which with doc_id tells documents apart) and the fingerprint in f0, f1, ..; one narrow pass."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "h", *FINGERPRINT)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(_batches, schema)


def _arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and every table's segment, in order of table, as 32-bit numbers."""
    orders = [np.arange(64 * WORDS)] + [np.random.default_rng(i).permutation(64 * WORDS) for i in range(1, ARRANGEMENTS)]
    places = 1 << np.arange(SEGMENT_BITS)
    for batch in batches:
        f = np.stack([batch.column(1 + w).to_numpy() for w in range(WORDS)], 1)
        bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
        values = np.concatenate([bits[:, o].reshape(len(f), SEGMENTS, SEGMENT_BITS) @ places for o in orders], 1).astype(np.int32)
        ends = pa.array(np.arange(len(f) + 1, dtype=np.int32) * values.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["id", "v"])


def meetings(nodes: DataFrame) -> DataFrame:
    """key (a table and a value), id, home (its own value), rep: the rows that meet a value of a table that other nodes have, with the least of those."""
    low = SEGMENT_BITS - HIGH
    arranged = nodes.select("id", *FINGERPRINT).mapInArrow(_arranged, "id long, v array<int>")
    own = arranged.select("id", F.posexplode("v").alias("t", "v"))
    flips = F.explode(F.array(F.lit(0), *[F.lit(1 << i) for i in range(low, SEGMENT_BITS)])).alias("bit")
    asks = own.select("id", "t", "v", flips).where(F.col("v").bitwiseAND(F.col("bit")) == F.col("bit")).withColumn("v", F.col("v").bitwiseXOR(F.col("bit")))
    # three numbers a row, to keep the shuffle small: part (table and upper bits), low (the rest), who (id, or -1 - id of one that only asks)
    rows = asks.select(F.shiftleft("t", HIGH).bitwiseOR(F.shiftright("v", low)).alias("part"), F.col("v").bitwiseAND(F.lit((1 << low) - 1)).alias("low"), F.when(F.col("bit") == 0, F.col("id")).otherwise(-1 - F.col("id")).alias("who"))
    rows = rows.repartition("part")
    table = rows.where("who >= 0").groupBy("part", "low").agg(F.min("who").alias("rep"), F.count("*").alias("n"))
    flips = F.explode(F.when(F.col("who") >= 0, F.array(F.lit(0), *[F.lit(1 << i) for i in range(low)])).otherwise(F.array(F.lit(0)))).alias("bit")
    probes = rows.select("part", "low", "who", flips).where(F.col("low").bitwiseAND(F.col("bit")) == F.col("bit"))
    probes = probes.select("part", F.col("low").bitwiseXOR(F.col("bit")).alias("low"), F.when(F.col("who") >= 0, F.col("who")).otherwise(-1 - F.col("who")).alias("id"), ((F.col("who") >= 0) & (F.col("bit") == 0)).alias("home"))
    met = probes.join(table.hint("shuffle_hash"), ["part", "low"]).where("id <> rep OR n > 1")
    return met.select(F.shiftleft(F.col("part").cast("long"), low).bitwiseOR(F.col("low").cast("long")).alias("key"), "id", "home", "rep")


_BY_SOME_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _met(nodes: DataFrame) -> DataFrame:
    """``meetings``, computed with the one shuffle by part: both sides lie by a part of the join's key, which Spark by default doesn't take as enough."""
    conf = nodes.sparkSession.conf
    before = conf.get(_BY_SOME_KEYS)
    conf.set(_BY_SOME_KEYS, "false")
    try:
        return cut(meetings(nodes))
    finally:
        conf.set(_BY_SOME_KEYS, before)


def _verified(pairs: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """a < b, distance of the distinct pairs whose complete fingerprints differ in at most radius bits."""
    one = lambda n: nodes.select(F.col("id").alias(n), *[F.col(f).alias(f"{n}_{f}") for f in FINGERPRINT])
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(one("a"), "a").join(one("b"), "b")
    distance = sum((F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in FINGERPRINT), F.lit(0))
    return pairs.select("a", "b", distance.alias("distance")).where(F.col("distance") <= radius)


def linked(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """node, root (the least of its component) of the nodes (id, f0, ..) that have a near copy; ``nodes`` should be a written table."""
    met = _met(nodes)
    links = cut(_verified(met.where("id <> rep").select(F.col("id").alias("x"), F.col("rep").alias("y")), nodes, radius).select("a", "b"))
    first = cut(components(links))
    of = lambda column: first.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    placed = join_checked(join_checked(met, of("id"), ["id"]), of("rep"), ["rep"])
    placed = cut(placed.select("key", "id", "home", "rep", F.coalesce("id_root", "id").alias("root"), F.coalesce("rep_root", "rep").alias("rep_root")))
    strange = placed.where("root <> rep_root")
    # a stranger to its value's least node against all that have the value, and those that ask for it against strangers that have it
    home = placed.where("home").select("key", F.col("id").alias("y"), F.col("root").alias("y_root"))
    pairs = strange.select("key", F.col("id").alias("x"), "root", "rep").join(home, "key").where("root <> y_root AND y <> rep").select("x", "y")
    has = strange.where("home").select("key", F.col("id").alias("y"))
    asks = placed.where("NOT home AND root = rep_root").select("key", F.col("id").alias("x"))
    more = cut(_verified(pairs.unionByName(asks.join(has, "key").select("x", "y")), nodes, radius).select("a", "b"))
    return components(links.unionByName(more)) if more.limit(1).count() else first


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its connected component) for the nodes of edges (a, b), by alternating large and small stars."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, h, head_id, head_h of the documents that are in a group of several; ``prints`` should be checkpointed."""
    known = prints.where(F.col("f0").isNotNull() & F.col("doc_id").isNotNull())
    nodes = known.groupBy(*FINGERPRINT).agg(F.min(F.struct("doc_id", "h")).alias("head"), F.max(F.struct("doc_id", "h")).alias("last"))
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()))
    roots = linked(nodes, radius)
    placed = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = placed.groupBy("root").agg(F.min("head").alias("top"), F.max("last").alias("end")).where(F.col("top") != F.col("end"))
    placed = cut(placed.join(heads, "root").select(*FINGERPRINT, "top"))
    return join_checked(known, placed, FINGERPRINT, "inner").select("doc_id", "h", F.col("top.doc_id").alias("head_id"), F.col("top.h").alias("head_h")).distinct()


def duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, duplicate_of: every document that goes, and the one of its group that stays."""
    found = groups(cut(fingerprints(docs)), radius)
    return found.where("doc_id <> head_id").select("doc_id", F.col("head_id").alias("duplicate_of")).distinct()


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without those that go; of rows with equal doc_id and text, one."""
    prints = cut(fingerprints(docs))
    gone = cut(groups(prints, radius).where("doc_id <> head_id OR h <> head_h").select("doc_id", "h"))
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h"))
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    rows = join_checked(rows, gone, ["doc_id", "h"], "left_anti")
    again = cut(prints.where("doc_id IS NOT NULL").groupBy("doc_id", "h").count().where("count > 1").drop("count"))
    if again.limit(1).count():
        rest = join_checked(rows, again, ["doc_id", "h"], "left_anti")
        rows = rest.unionByName(join_checked(rows, again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]))
    return rows.select(*back)
