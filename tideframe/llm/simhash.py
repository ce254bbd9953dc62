"""SimHash near-dedup: exact comparison of fingerprints in tiles.

Distinct fingerprints are dealt to cells by the population counts of their upper and lower half. Two fingerprints within
the radius lie in cells whose counts differ by no more than the radius in sum, so other pairs of tiles are never formed.
A pair of tiles is compared whole with numpy's exclusive-or and bit counts and gives a spanning forest of the links it
finds, not the links; components of all forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import durable, one_row_a_batch
from .textblocks import give_back

#: Fingerprints of a tile; a tile is sent once for every tile that it meets.
TILE = 32_768


def simhash(text: bytes, words: int = 4) -> int:
    """64-bit fingerprint: bits set in over half of the hashes of the text's word shingles; 0 for a text without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(len(parts) - words + 1, 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:k].tolist(), ends[-k:].tolist(), strict=True)), np.uint64, k)
    count = np.zeros(64, np.int64)
    for at in range(0, k, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * count > k), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row of ``docs`` (doc_id, text); null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            fps = np.fromiter((simhash((t.as_py() or "").encode(), words) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.record_batch([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int, step: int = 32) -> list[tuple[int, int]]:
    """Edges (i, j) between places of ``a`` and of ``b`` that span all links between them."""
    label = np.arange(len(b))
    edges = []
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            js = np.flatnonzero(near[i])
            roots, first = np.unique(label[js], return_index=True)
            edges += [(at + int(i), int(js[f])) for f in first]
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    return edges


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (u, v) between the ``rep`` values of ``distinct`` (fp, rep; each fp once) that join all within ``radius`` bits.

    The driver sees no more than the 1,089 cells' counts. A tile has about 32,768 fingerprints at most.
    """
    spark = distinct.sparkSession
    cells = distinct.withColumns({"c": F.bit_count(F.shiftrightunsigned("fp", 32)) * 33 + F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))})
    sizes = {r["c"]: r["n"] for r in cells.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    tiles = {c: -(-n // TILE) for c, n in sizes.items()}
    near = [(c, d, tiles[c], tiles[d]) for c in tiles for d in tiles if c <= d and abs(c // 33 - d // 33) + abs(c % 33 - d % 33) <= radius]
    how_many = F.create_map(*[F.lit(x) for cn in tiles.items() for x in cn]) if tiles else F.create_map(F.lit(0), F.lit(1))
    placed = cells.withColumn("t", F.pmod(F.xxhash64("fp"), how_many[F.col("c")].cast("long")).cast("int"))
    blobs = durable(placed.groupBy("c", "t").agg(F.collect_list(F.struct("fp", "rep")).alias("rows")), "simhash-tiles")
    pairs = spark.createDataFrame(near, "c int, d int, nc int, nd int") if near else spark.createDataFrame([], "c int, d int, nc int, nd int")
    pairs = pairs.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("nd") - 1))).where("c < d OR t <= s")
    pairs = pairs.join(blobs.select("c", "t", F.col("rows").alias("a")), ["c", "t"]).join(blobs.select(F.col("c").alias("d"), F.col("t").alias("s"), F.col("rows").alias("b")), ["d", "s"])
    id_type = distinct.schema["rep"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for k in range(batch.num_rows):
                a, b = batch["a"][k].values, batch["b"][k].values
                fa, fb = (x.field("fp").to_numpy().view(np.uint64) for x in (a, b))
                edges = np.array(_forest(fa, fb, radius), np.int64).reshape(-1, 2)
                yield pa.record_batch([a.field("rep").take(pa.array(edges[:, 0])), b.field("rep").take(pa.array(edges[:, 1]))], ["u", "v"])

    return pairs.select("a", "b").mapInArrow(compare, f"u {id_type}, v {id_type}")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs`` (doc_id, text; other columns are ignored).

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id that links reach, itself
    included. Texts are lower-cased in A-Z only. Null and wordless texts have fingerprint zero and link like any other.
    Rows of one doc_id each get their own row. Null doc_id: never the smallest, unless a component has no other. Empty
    table: no rows.
    """
    printed = durable(fingerprints(docs, words), "simhash-prints")
    distinct = durable(printed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    known = distinct.where(F.col("rep").isNotNull())
    # a fingerprint whose documents all lack an id has no name of its own, so it takes part under its own bits
    nameless = distinct.where(F.col("rep").isNull()).limit(1).count() > 0
    if nameless:
        keyed = distinct.select("fp", F.struct(F.col("rep").isNull().alias("last"), "rep", "fp").alias("key"))
        edges = links(distinct.select("fp", F.col("fp").alias("rep")), radius)
        with one_row_a_batch(docs.sparkSession):  # a pair of tiles is a MB
            found = components(edges, "simhash-components")
        of = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("g"))
        least = of.join(keyed, "fp").groupBy("g").agg(F.min("key.rep").alias("component_id"))
        groups = of.join(least, "g").select("fp", "component_id")
    else:
        with one_row_a_batch(docs.sparkSession):
            found = components(links(known, radius), "simhash-components")
        groups = distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return printed.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
