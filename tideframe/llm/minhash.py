"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Each distinct set of shingles is hashed once; its hashes fall in bins, and a bin that stays empty takes the value of another,
found by a walk of its own that is the same for all sets. Bins go in bands, and sets that agree in a whole band share a
bucket. A bucket sends one candidate edge for each of its sets, to the one of smallest key, so pairs grow with rows and not
with their squares; the same few centres serve all bands of a group. Candidates are verified on the full sets.

A star can miss: two sets may be similar to each other and not to their centre. So buckets in which verified links leave more
than one group are compared in tasks by exclusive-or and bit counts of parity sketches, which never part a similar pair; a
bucket of many rows is cut in tiles. What a task sends is again a forest, until no bucket is open (see ``nearcopies``).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearcopies
from .nearcopies import Sets, cell_of, fold, grouped_by, joined_links, row_id, shingles, sketch, width, with_links
from .store import discard, durable, scratch
from .textblocks import blend, give_back, mix64

WORDS, SIMILAR = 5, (17, 20)
#: Bands of bins: a pair of similarity 0.85 shares no bucket once in 10**8, one of 0.9 once in 10**12.
BANDS, ROWS = 32, 5
#: Rows of a bucket that are compared at once with those of other buckets; larger ones are cut in tiles of TILE rows.
SMALL, TILE = 32, 4096
_PROBES = (64, 1024, 8192)


@functools.lru_cache(maxsize=4)
def _walks(bins: int, steps: int) -> np.ndarray:
    """For each bin, the bins it asks in turn; the same for all sets."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(steps, dtype=np.uint64)[None, :]
    return ((mix64(at) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int32)


def signature(hashes: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """The least value of each bin over one permutation of the hashes; empty bins filled by optimal densification."""
    values = np.sort(mix64(hashes ^ np.uint64(0xA24BAED4963EE407)))
    own, first = np.unique((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32), return_index=True)
    own = own.astype(np.int64)
    source = np.full(bins, -1, np.int64)
    source[own] = first
    out_of = np.full(bins, -1, np.int64)
    out_of[own] = own
    for steps in _PROBES:
        empty = np.flatnonzero(out_of < 0)
        if not len(empty):
            break
        walk = _walks(bins, steps)[empty]
        full = source[walk] >= 0
        found = full.any(axis=1)
        out_of[empty[found]] = walk[found, full[found].argmax(axis=1)]
    out_of[out_of < 0] = own[0]
    return values[source[out_of]]


def bands(hashes: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A number of each band of the signature, another for each place."""
    bins = signature(hashes, n_bands * rows).reshape(n_bands, rows)
    out = mix64(np.arange(1, n_bands + 1, dtype=np.uint64))
    for k in range(rows):
        out = blend(out, bins[:, k])
    return out


def prints(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rid, doc_id, digest (the set's, 128 bits), n (its size), sketch, and bands of rows (rid, doc_id, text).

    Sets of five shingles or fewer have no bands: at 0.85 they are similar to none but their equals.
    """
    alone = SIMILAR[0] // (SIMILAR[1] - SIMILAR[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            keys, sizes, marks, of = [], [], [], []
            for t in batch["text"]:
                hs = shingles((t.as_py() or "").encode(), words)
                keys.append(xxhash.xxh128_hexdigest(hs.tobytes()))
                sizes.append(len(hs))
                marks.append(sketch(hs, width(cell_of(len(hs)))).tobytes())
                of.append(bands(hs).view(np.int64) if len(hs) > alone else np.zeros(0, np.int64))
            columns = [batch["rid"], batch["doc_id"], pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(of, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["rid", "doc_id", "digest", "n", "sketch", "bands"])

    rows = rows.select("rid", "doc_id", "text")
    return rows.mapInArrow(run, f"rid string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest string, n long, sketch binary, bands array<long>")


def shared_buckets(distinct: DataFrame) -> DataFrame:
    """h, key, n, to (key and n of its smallest key) and rows of buckets that hold two sets or more, for each of their sets.

    The smallest key is found with partial sums on the way, so a bucket of very many rows is no hot one, and a bitmap keeps
    most sets that are alone in their bucket out of the second shuffle.
    """
    buckets = distinct.select(F.explode("bands").alias("h"), "key", F.col("n").cast("int").alias("n"))
    centres = buckets.groupBy("h").agg(F.min(F.struct("key", "n")).alias("to"), F.count(F.lit(1)).cast("int").alias("rows")).where("rows > 1")
    centres = durable(centres, "minhash-centres")
    return durable(nearcopies.likely(buckets, centres, "h").join(centres, "h"), "minhash-buckets")


def stars(buckets: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Distinct candidate edges (u, v) from the smallest key of each bucket to its others, of sizes that can be similar."""
    part, whole = similar
    fits = (F.col("key") != F.col("to.key")) & (whole * F.least("n", "to.n") >= part * F.greatest("n", "to.n"))
    return buckets.where(fits).select(F.col("to.key").alias("u"), F.col("key").alias("v")).distinct()


def _apart(pairs: tuple[np.ndarray, np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Differing bits of pairs of sketches, those of unlike lengths in the shorter one's."""
    a, b = pairs
    size = np.fromiter(map(len, marks), np.int64, len(marks))
    out = np.zeros(len(a), np.int64)
    wa, wb = size[a], size[b]
    for w, v in {(int(x), int(y)) for x, y in zip(wa, wb, strict=True)}:
        at = np.flatnonzero((wa == w) & (wb == v))
        for k in range(0, len(at), 4096):
            now = at[k : k + 4096]
            left, right = (fold(np.stack([marks[x] for x in side[now].tolist()]), min(w, v)) for side in (a, b))
            out[now] = np.bitwise_count(left ^ right).sum(axis=1)
    return out


def small_candidates(rows: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Pairs (u, v) of rows (h, members) of small buckets, from different groups, that may be similar enough.

    A bucket has SMALL members at most, so pairs are bounded by a constant for each row.
    """
    part, whole = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for at in range(0, batch.num_rows, 256):
                members = batch["members"].slice(at, 256)
                rows, size = members.flatten(), members.value_lengths().to_numpy()
                place = rows.field("g").to_numpy()
                n, keys = rows.field("n").to_numpy(), rows.field("key").to_numpy()
                # each row with those after it in its bucket
                first = np.cumsum(size) - size
                rest = np.repeat(first + size, size) - np.arange(len(rows)) - 1
                a = np.repeat(np.arange(len(rows)), rest)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(rest) - rest, rest)
                fits = (place[a] != place[b]) & (whole * np.minimum(n[a], n[b]) >= part * np.maximum(n[a], n[b]))
                a, b = a[fits], b[fits]
                marks = [np.frombuffer(x, np.uint64) for x in rows.field("sketch").to_pylist()]
                near = (whole + part) * _apart((a, b), marks) <= (whole - part) * (n[a] + n[b])
                u, v = keys[a[near]], keys[b[near]]
                low = u < v
                yield pa.record_batch([pa.array(np.where(low, u, v)), pa.array(np.where(low, v, u))], ["u", "v"])

    return rows.select("members").mapInArrow(run, "u long, v long").distinct()


def links(distinct: DataFrame, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """node, component of the keys that verified pairs of a bucket join.

    distinct: key (a number of the set's own), n, sketch, bands, rid (of one row that has the set); rows: rid, text.
    """
    sets = Sets(distinct, rows, words, SIMILAR)
    buckets = shared_buckets(distinct)
    found = with_links(None, sets.verified(durable(likely_pairs(stars(buckets), distinct), "minhash-stars")))
    grouped = durable(grouped_by(buckets.select("h", "key", "n", "rows"), found), "minhash-grouped")
    open_ = grouped.groupBy("h").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least < most").select("h")
    members = durable(grouped.join(open_, "h").join(distinct.select("key", "sketch"), "key"), "minhash-members")
    small = members.where(F.col("rows") <= SMALL).groupBy("h").agg(F.collect_list(F.struct("key", "n", "sketch", "g")).alias("members"))
    close = durable(small_candidates(small), "minhash-small")
    large = members.where(F.col("rows") > SMALL)
    if large.limit(1).count() == 0:
        found = with_links(found, sets.verified(close))
    else:
        tiles = F.ceil(F.col("rows") / TILE).cast("int")
        placed = large.select("key", F.col("n").cast("long").alias("n"), "sketch", F.col("h").alias("c"), F.pmod(F.xxhash64("key"), tiles).cast("int").alias("t"))
        many = large.select(F.col("h").alias("c"), "rows").distinct().select("c", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("t"), (tiles - 1).alias("last"))
        pairs = many.select("c", "t", F.col("c").alias("d"), F.explode(F.sequence("t", "last")).alias("s"))
        found = joined_links(durable(placed, "minhash-placed"), durable(pairs, "minhash-tiles"), sets, SIMILAR, found, close)
    sets.discard()
    return found


def likely_pairs(pairs: DataFrame, distinct: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Pairs (u, v) less those whose sketches differ in more bits than similar sets can."""
    part, whole = similar
    own = distinct.select("key", "n", "sketch")
    both = pairs.join(own.select(F.col("key").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u").join(own.select(F.col("key").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.frombuffer(x, np.uint64) for side in ("su", "sv") for x in batch[side].to_pylist()]
            n, at = batch["nu"].to_numpy() + batch["nv"].to_numpy(), np.arange(batch.num_rows)
            near = (whole + part) * _apart((at, at + batch.num_rows), marks) <= (whole - part) * n
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], ["u", "v"]).filter(pa.array(near))

    return both.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text; other columns are ignored).

    Links are pairs of Jaccard similarity 0.85 or more of the sets of ``words``-word shingles, lower-cased in A-Z, a shorter text
    as one shingle; component_id is the smallest doc_id that links reach, itself included, and kept says that it is the row's
    own. Null and wordless texts have an empty set and are linked with nothing. Rows without an id are never the smallest,
    unless a component has no other: then it is null and none is kept; a wordless one stands for itself. Rows of one doc_id
    each get their own row. Equal texts are linked. Empty table: no rows.
    """
    rows = docs.select("doc_id", "text").withColumn("rid", row_id(docs.select("doc_id", "text")))
    printed = durable(prints(rows, words), "minhash-prints")
    full = printed.where("n > 0")
    by_key = full.groupBy("digest").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.min("rid").alias("rid"), F.min("doc_id").alias("least"))
    distinct = durable(by_key.withColumn("key", F.monotonically_increasing_id()), "minhash-distinct")
    with scratch(docs.sparkSession) as kept:
        of = grouped_by(distinct.select("key", "digest", "least"), links(distinct, rows, words))
        least = of.groupBy("g").agg(F.min("least").alias("component_id"))
        kept.append(durable(of.join(least, "g").select("digest", "component_id"), "minhash-groups"))
    out = full.join(kept[0], "digest").select("doc_id", "n", "component_id").unionByName(printed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
