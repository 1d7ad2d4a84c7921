"""SimHash near-duplicates found by anchor-point covering.

A 64-bit fingerprint is read as two parts of 31 bits (two bits are in neither). If two fingerprints differ in at most
4 bits, they differ in at most 2 bits of the first part or in at most 1 bit of the second. The anchors of a part are
the codewords of the [31, 26] Hamming code, a perfect covering code: each part lies within the covering radius 1 of
exactly one anchor, its home. A part is replicated to every anchor within radius + threshold (3 for the first part,
2 for the second), so the home anchor of either end of a link always holds the other end as well. Fingerprints are
compared, on all 64 bits, only where one's home meets another's replica.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, fresh, ship, sized, stored
from vellum.llm.graph import components
from vellum.llm.wordhash import mix, shingle_codes, slices

BITS = 31  # length of the Hamming code: 2**5 - 1
RADIUS = 1
#: (first bit, bits that may differ within the part) for a threshold of 4 in all.
PARTS = ((0, 2), (31, 1))
MAX_BITS = 4
CHUNK = 1 << 15


def fingerprint(text: bytes | None, size: int) -> int:
    """The SimHash of one text as a signed 64-bit integer: a bit is set if it is set in over half of the shingles' hashes."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    reach = ends[size - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:z], 42) for a, z in zip(starts, reach, strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp) for every row. A null or blank text has fingerprint 0; fewer than ``size`` words make one shingle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), size) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    return rows.mapInArrow(run, f"id {id_type}, fp bigint")


def _syndrome(part: Column) -> Column:
    """Which bit, counted from 1, has to flip to reach the home anchor; 0 at an anchor."""
    total = F.lit(0)
    for j in range(5):
        mask = sum(1 << i for i in range(BITS) if (i + 1) >> j & 1)
        total = total + F.bit_count(part.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << j)
    return total


def _patterns() -> list[tuple[int, int, int]]:
    """(syndrome, weight, flips): every way to flip at most 3 of the 31 bits."""
    out = []
    for weight in range(4):
        for bits in combinations(range(BITS), weight):
            s = 0
            for b in bits:
                s ^= b + 1
            out.append((s, weight, sum(1 << b for b in bits)))
    return out


def links(nodes: DataFrame) -> DataFrame:
    """(fp) distinct fingerprints -> (u, v) with u < v, every pair within MAX_BITS bits, each found at least once."""
    spark = nodes.sparkSession
    flips = spark.createDataFrame(_patterns(), "s int, weight int, flips bigint")  # 4,992 rows, whatever the input
    parts = nodes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << BITS) - 1)).alias("part"), F.lit(RADIUS + e).alias("reach")) for k, (first, e) in enumerate(PARTS)])).alias("p"),
    ).select("fp", "p.*")
    parts = parts.withColumn("s", _syndrome(F.col("part")).cast("int"))
    anchor = lambda flip: (F.col("part").bitwiseXOR(flip) + F.col("k").cast("bigint") * (1 << BITS)).alias("anchor")
    home = parts.select(anchor(F.when(F.col("s") == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, s - 1)"))), F.col("fp").alias("u"))
    near = parts.join(F.broadcast(flips), "s").where("weight <= reach").select(anchor(F.col("flips")), F.col("fp").alias("v"))
    return home.hint("shuffle_hash").join(near, "anchor").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least id that can be reached over links of at most 4 differing bits. Rows with equal
    fingerprints are one node, so copies cost one row each and never a pair. Blank and null texts share fingerprint 0
    and link like any other. Rows with a null id stay; they take the least id of their component, null if it has none.
    Repeated rows stay as they are. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, size))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp")))
    found = _placed(rows.withColumnRenamed("fp", "key"), nodes.withColumnRenamed("fp", "key"), roots)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of ``similar_texts``: so many parts of 31 bits. A bit is one of a text's least shingle under one of as many orders, so at
#: similarity 0.8 a tenth of them differ; of SimHash bits it would be three in twenty.
WIDE_PARTS = 16
WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Bits of the first 64 that candidates may differ in: at similarity 0.8 about 6 do, give or take 2.4.
CHECK_BITS = 20
_ORDERS = mix(np.arange(1, WIDE_PARTS * BITS + 1, dtype=np.uint64))
_FACTORS = (_ORDERS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def wide_fingerprint(codes: np.ndarray) -> np.ndarray:
    """WIDE_PARTS * BITS bits of the distinct ``codes``, each a bit of the least of them in an order of its own; none: zeros."""
    x, least = (codes ^ codes >> np.uint64(32)).astype(np.uint32), np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (_FACTORS[:, None] * x[None, at : at + 1024]).min(axis=1), out=least)
    return (mix(least.astype(np.uint64) ^ _ORDERS) & np.uint64(1)).astype(np.int64) if len(x) else np.zeros(len(_FACTORS), np.int64)


def wide_parts(codes: np.ndarray) -> tuple[int, list[int]]:
    """(the first 64 bits, all bits in WIDE_PARTS parts) of ``wide_fingerprint``."""
    bits = wide_fingerprint(codes)
    check = int(np.packbits(bits[:64].astype(np.uint8), bitorder="little").view("<i8")[0])
    return check, (bits.reshape(WIDE_PARTS, BITS) << np.arange(BITS)).sum(axis=1).tolist()


def _shingled(docs: DataFrame, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    """(id, key, more): ``make`` is given a text's distinct shingle codes, sorted, and gives the values of ``columns``; texts with
    equal sets of shingles have the same key, those without a word the key 0."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                codes, sizes = shingle_codes(batch.column(1), WIDE_SHINGLE, short=True)
                ends, keys, made = np.cumsum(sizes).tolist(), [], []
                for a, z in zip([0, *ends[:-1]], ends, strict=True):
                    own = np.unique(codes[a:z])
                    keys.append(int(mix(own + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if z > a else 0)
                    made.append(make(own))
                cells = [pa.array(list(c)) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), *cells], ["id", "key", *names])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key bigint, {columns}")


def wide_candidates(nodes: DataFrame) -> DataFrame:
    """(key, check, parts) -> (u, v), u < v: pairs that agree in a part but for one bit at most, found at anchors.

    Nodes with one value of a part are joined to the least of them, and only that one stands for the value at the anchors. So
    a large group of near copies gives a few pairs a node, not one for every two.
    """
    spark = nodes.sparkSession
    # parts one bit apart have different syndromes, and only the one with the greater goes to the other's home
    useful = lambda s, weight, flips: weight == 1 or weight == 2 and (flips & -flips).bit_length() < s
    flips = F.broadcast(spark.createDataFrame([p for p in _patterns() if useful(*p)], "s int, weight int, flips bigint").drop("weight"))  # 341 rows
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # small numbers take less room than keys
    cells = stored(nodes.select(F.col("node").alias("key"), F.posexplode("parts").alias("k", "part")), "cells")
    least = stored(cells.groupBy("k", "part").agg(F.min("key").alias("rep"), F.max("key").alias("high")), "cells")
    same = cells.join(least.where("rep < high").select("k", "part", "rep"), ["k", "part"]).where("rep < key").select(F.col("rep").alias("u"), F.col("key").alias("v"))
    marked = least.select("rep", F.col("part").cast("bigint").alias("part"), "k", _syndrome(F.col("part").cast("bigint")).cast("int").alias("s"))
    anchor = lambda flip: (F.col("part").bitwiseXOR(flip) + F.col("k").cast("bigint") * (1 << BITS)).alias("anchor")
    home = marked.select(anchor(F.when(F.col("s") == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, s - 1)"))), F.col("part").alias("p"), F.col("rep").alias("u"))
    near = marked.join(flips, "s").select(anchor(F.col("flips")), F.col("part").alias("q"), F.col("rep").alias("v"))
    met = home.join(near, "anchor").where((F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) == 1) & (F.col("u") != F.col("v")))
    pairs = same.unionByName(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()
    named = lambda side: nodes.select(F.col("node").alias(side), F.struct("key", "check").alias(f"{side}_"))
    pairs = pairs.join(named("u"), "u").join(named("v"), "v").where(F.bit_count(F.col("u_.check").bitwiseXOR(F.col("v_.check"))) <= CHECK_BITS)
    return pairs.select(F.least("u_.key", "v_.key").alias("u"), F.greatest("u_.key", "v_.key").alias("v"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row: texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more link.

    A threshold of a few bits of 64 would miss most pairs of that similarity. So a text has WIDE_PARTS parts of 31 bits; pairs
    that agree in one of them, but for one bit at most, are found by anchors as above and then checked on the shingles
    themselves. By the binomial distribution of differing bits a pair of similarity 0.8, 0.82, 0.85 or 0.9 is found in about 95, 98, 99.6 or 100 of
    100 cases; a text that has several near copies has as many chances. A group's least member stands for it where many agree.

    Blank and null texts are one group. Texts of fewer than five words have one shingle. Rows with a null id stay, with the
    least id of their component, null if it has none. Repeated rows stay as they are; very long texts are taken whole; other
    columns do not matter. An empty table gives an empty result.
    """

    rows = stored(_shingled(docs, id_col, text_col, "check bigint, parts array<bigint>", wide_parts), "fingerprints")
    nodes = cut(rows.groupBy("key").agg(F.min("id").alias("least"), F.min("check").alias("check"), F.first("parts").alias("parts")))
    pairs = cut(wide_candidates(nodes.where("key <> 0").select("key", "check", "parts")))
    wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct())
    bodies = _shingled(docs, id_col, text_col, "codes binary", lambda own: (own.astype("<u4").tobytes(),)).select("key", "codes")
    bodies = stored(bodies.join(sized(wanted), "key", "left_semi").dropDuplicates(["key"]), "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.unique(np.frombuffer(b.as_buffer(), "<u4")) for b in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(common >= SIMILARITY * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    named = lambda k, c: bodies.select(F.col("key").alias(k), F.col("codes").alias(c))
    links_ = pairs.join(named("u", "x"), "u").join(named("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(verify, "u bigint, v bigint")
    return _placed(rows.select("id", "key"), nodes.select("key", "least"), components(links_)).select(F.col("id").alias(id_col), "component_id")


def _placed(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (id, key) with component_id, the least id of the component of their node."""
    placed = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    return rows.join(named, "key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component in ``similar_texts``, columns unchanged.

    A row with a null id is kept, for it cannot be told apart from others. Rows that repeat the least id stay.
    """
    found = similar_texts(docs.select(id_col, text_col), id_col, text_col)
    key = fresh(docs, "dropped_id")
    gone = cut(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(key)).distinct())
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")
