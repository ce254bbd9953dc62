"""Near copies by exact Jaccard similarity of word shingles: tiles of sketches, then the sets themselves.

A text's sketch has one bit for each hash value modulo its length, flipped by every shingle that falls there. Two sketches
differ in no more bits than their sets differ in shingles, so the comparison of sketches (exclusive-or and bit counts, in
tiles of texts of like size) never loses a pair that is similar enough; pairs that it lets through are verified on the
sets. A tile pair in which very many pairs come through gives a spanning forest of them, and is compared again without the
pairs that verified links have joined by then. What is still open after some rounds is verified where it is compared, on the
sets of the rows concerned, so that never more leaves a pair of tiles than some pairs for each row.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import discard, durable, one_row_a_batch
from .textblocks import give_back

#: Rows of a tile, and bytes of its sketches, at most: a tile is sent once for every tile that it meets.
TILE, TILE_BYTES = 32_768, 1 << 22
WORDS = 5
#: Jaccard similarity from which on sets link, as a fraction.
SIMILAR = (4, 5)
_BITS = 1 << 25
#: Candidates of a tile pair up to which all of them are verified, as a part of its rows.
MANY = 0.25
#: Pairs of two groups that a spanning forest takes, so that one of them links if many of them would.
TESTS = 16
#: Rounds of forests, after which tile pairs that are still open are settled on the sets themselves; bytes of a part's sets.
TURNS, PART_BYTES = 4, 1 << 22
#: A round in which not one candidate in FEW holds is the last one of forests.
FEW = 10
_STEP = math.log(1.25) / 2


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, lower-cased in A-Z; a shorter text is one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(len(parts) - words + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:k].tolist(), ends[-k:].tolist(), strict=True)), np.uint64, k))


def cell_of(n: int) -> int:
    """Cells of set sizes, two for each factor of 1.25."""
    return int(math.log(max(n, 1)) / _STEP)


def width(cell: int) -> int:
    """64-bit words of a cell's sketches, a power of two: unrelated sets lie five deviations beyond what links."""
    most, w = math.exp((cell + 1) * _STEP), 1
    while 32 * w - most / 4 < 20 * math.sqrt(w):
        w *= 2
    return w


def sketch(hashes: np.ndarray, w: int) -> np.ndarray:
    bits = np.bincount((hashes % np.uint64(64 * w)).astype(np.int64), minlength=64 * w) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketches: np.ndarray, w: int) -> np.ndarray:
    """Sketches of ``w`` words each out of longer ones."""
    while sketches.shape[1] > w:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def row_id(docs: DataFrame) -> Column:
    """A name of a row by all it holds; only full duplicates share it."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != "text"], F.md5("text").alias("text"))))


def prints(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rid, doc_id, digest (the set's, 128 bits), n (its size), c (its cell) and sketch of rows (rid, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            keys, sizes, cells, marks = [], [], [], []
            for t in batch["text"]:
                hs = shingles((t.as_py() or "").encode(), words)
                c = cell_of(len(hs))
                keys.append(xxhash.xxh128_hexdigest(hs.tobytes()))
                sizes.append(len(hs))
                cells.append(c)
                marks.append(sketch(hs, width(c)).tobytes())
            yield pa.record_batch([batch["rid"], batch["doc_id"], pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(cells, pa.int32()), pa.array(marks, pa.binary())], ["rid", "doc_id", "digest", "n", "c", "sketch"])

    rows = rows.select("rid", "doc_id", "text")
    return rows.mapInArrow(run, f"rid string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest string, n long, c int, sketch binary")


def _near(a: dict, na: np.ndarray, ga: np.ndarray, b: dict, nb: np.ndarray, gb: np.ndarray, same: bool, similar: tuple[int, int], step: int = 16) -> Iterator[tuple[int, np.ndarray]]:
    """Place in one tile and places in the other that may be similar enough and are not in one group yet.

    a, b: places and sketches of the tile's rows by the sketches' length; unlike ones are compared in the shorter length.
    """
    part, whole = similar
    for (wa, (at_a, left)), (wb, (at_b, right)) in itertools.product(a.items(), b.items()):
        if whole * max(na[at_a].max(), nb[at_b].max()) < part * min(na[at_a].min(), nb[at_b].min()):
            continue
        left, columns = fold(left, min(wa, wb)), np.ascontiguousarray(fold(right, min(wa, wb)).T)
        wide = np.uint16 if 64 * len(columns) < 65_536 else np.uint32
        n_left, n_right, g_left, g_right = na[at_a], nb[at_b], ga[at_a], gb[at_b]
        for at in range(0, len(left), step):
            n = n_left[at : at + step, None]
            apart = np.zeros((len(n), len(n_right)), wide)
            for w in range(len(columns)):
                apart += np.bitwise_count(left[at : at + step, w, None] ^ columns[w])
            near = (whole + part) * apart.astype(np.int64) <= (whole - part) * (n + n_right)
            for i in np.flatnonzero(near.any(axis=1)):
                js = np.flatnonzero(near[i])
                k = at + int(i)
                fits = (whole * np.minimum(n_left[k], n_right[js]) >= part * np.maximum(n_left[k], n_right[js])) & (g_left[k] != g_right[js])
                js = at_b[js[fits]]
                js = js[js > at_a[k]] if same else js
                if len(js):
                    yield int(at_a[k]), js


def _tiles(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _tile_pairs(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """c, t, d, s and the rows of both tiles (a, b) of each pair of tiles; placed has g, the group that a row is in."""
    blobs = durable(_tiles(placed, ["c", "t"], ["key", "n", "sketch", "g"]), "near-tiles")
    a, b = blobs.select("c", "t", F.col("rows").alias("a")), blobs.select(F.col("c").alias("d"), F.col("t").alias("s"), F.col("rows").alias("b"))
    return pairs.join(a, ["c", "t"]).join(b, ["d", "s"]).select("c", "t", "d", "s", "a", "b")


def _side(rows, groups: dict) -> tuple:
    """Keys, sizes, sketches by their length, and numbered groups of a tile's rows."""
    n = rows.field("n").to_numpy()
    marks = rows.field("sketch").to_pylist()
    size = np.fromiter(map(len, marks), np.int64, len(marks)) // 8
    of = {int(w): np.flatnonzero(size == w) for w in np.unique(size)}
    by = {w: (at, np.frombuffer(b"".join([marks[k] for k in at.tolist()]), np.uint64).reshape(len(at), w)) for w, at in of.items()}
    return rows.field("key").to_pylist(), n.astype(np.int64), by, np.array([groups.setdefault(g, len(groups)) for g in rows.field("g").to_pylist()], np.int64)


def _both(batch: pa.RecordBatch, k: int) -> tuple:
    """Name, both sides and number of groups of a row of :func:`_tile_pairs`."""
    groups: dict = {}
    at = [batch[x][k].as_py() for x in ("c", "t", "d", "s")]
    a, b = _side(batch["a"][k].values, groups), _side(batch["b"][k].values, groups)
    return at, a, b, len(groups)


_OF = "c long, t int, d long, s int"


def candidates(placed: DataFrame, pairs: DataFrame, seed: int, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Pairs (u, v) of the tile pairs (c, t, d, s) to be verified, and if more of them were left out (open).

    placed: key, n, sketch, c, t and g, the group that a row is in. Tiles give all their candidates, or a forest that spans
    them if those are many, so no more pairs leave than some for each row.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for k in range(batch.num_rows):
                at, (ka, na, a, ga), (kb, nb, b, gb), many = _both(batch, k)
                rng = np.random.default_rng([seed, *(x % (1 << 32) for x in at)])
                label, edges, forest, more, tests = np.arange(many), [], [], False, {}
                size = np.bincount(gb if at[:2] == at[2:] else np.concatenate([ga, gb]), minlength=many)
                for i, js in _near(a, na, ga, b, nb, gb, at[:2] == at[2:], similar):
                    if not more:
                        edges += [(i, j) for j in js.tolist()]
                        more = len(edges) > MANY * (len(ka) + len(kb))
                    js = rng.permutation(js)
                    roots, first = np.unique(label[gb[js]], return_index=True)
                    mine, joined = label[ga[i]], []
                    for r, f in zip(roots.tolist(), first.tolist(), strict=True):
                        if r != mine:
                            forest.append((i, int(js[f])))
                            pair = (mine, r) if mine < r else (r, mine)
                            tests[pair] = tests.get(pair, 0) + 1
                            if tests[pair] >= min(TESTS, size[ga[i]] * size[gb[js[f]]]):
                                joined.append(r)
                    label[np.isin(label, joined)] = mine
                if edges:
                    yield told(forest if more else edges, ka, kb, at, more)

    def told(edges, ka, kb, at, more) -> pa.RecordBatch:
        n = len(edges)
        ends = [pa.array([ka[i] for i, _ in edges], pa.int64()), pa.array([kb[j] for _, j in edges], pa.int64())]
        of = [pa.array([x] * n, k) for x, k in zip(at, (pa.int64(), pa.int32()) * 2, strict=True)]
        return pa.record_batch([*ends, pa.array([more] * n, pa.bool_()), *of], ["u", "v", "open", "c", "t", "d", "s"])

    return _tile_pairs(placed, pairs).mapInArrow(compare, f"u long, v long, open boolean, {_OF}")


def _involved(placed: DataFrame, pairs: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Rows (key, n, sketch, g) of the tile pairs, on their side, that may be similar enough to one of another group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for k in range(batch.num_rows):
                at, (ka, na, a, ga), (kb, nb, b, gb), _ = _both(batch, k)
                left, right = np.zeros(len(ka), bool), np.zeros(len(kb), bool)
                for i, js in _near(a, na, ga, b, nb, gb, False, similar):
                    left[i], right[js] = True, True
                for side, name, rows in ((0, "a", left), (1, "b", right)):
                    n = int(rows.sum())
                    if n:
                        own = batch[name][k].values.filter(pa.array(rows))
                        of = [pa.array([x] * n, t) for x, t in zip([*at, side], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                        yield pa.record_batch([*of, *(own.field(f) for f in ("key", "n", "sketch", "g"))], ["c", "t", "d", "s", "side", "key", "n", "sketch", "g"])

    return _tile_pairs(placed, pairs).mapInArrow(compare, f"{_OF}, side int, key long, n long, sketch binary, g long")


def _settled(placed: DataFrame, pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Edges (u, v) that join all links between groups in these tile pairs, verified where the rows are compared.

    Only rows that may link come, with their sets and in parts of a few MB; what leaves a pair of parts is a forest.
    """
    tile = ["c", "t", "d", "s"]
    rows = durable(_involved(placed, pairs, similar), "near-involved")
    parts = rows.groupBy(*tile, "side").agg(F.ceil(F.sum("n") * 8 / PART_BYTES).cast("int").alias("parts"))
    dealt = rows.join(parts, [*tile, "side"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).join(sets, "key")
    blobs = durable(_tiles(dealt, [*tile, "side", "part"], ["key", "n", "sketch", "g", "hs"]), "near-parts")
    a, b = (blobs.where(F.col("side") == k).select(*tile, F.col("part").alias(f"p{x}"), F.col("rows").alias(x)) for k, x in enumerate("ab"))
    part, whole = similar

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for k in range(batch.num_rows):
                _, (ka, na, a, ga), (kb, nb, b, gb), many = _both(batch, k)
                of_a, of_b = batch["a"][k].values.field("hs"), batch["b"][k].values.field("hs")
                label, edges = np.arange(many), []
                for i, js in _near(a, na, ga, b, nb, gb, False, similar):
                    mine = of_a[i].values.to_numpy()
                    for j in js.tolist():
                        if label[ga[i]] != label[gb[j]]:
                            other = of_b[j].values.to_numpy()
                            if (whole + part) * len(np.intersect1d(mine, other, assume_unique=True)) >= part * (len(mine) + len(other)):
                                edges.append((ka[i], kb[j]))
                                label[label == label[gb[j]]] = label[ga[i]]
                yield pa.record_batch([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], ["u", "v"])

    # within one tile a pair of parts comes in both orders; the second finds nothing that the first one has not joined
    pair = a.join(b, tile).where("c <> d OR t <> s OR pa <= pb")
    return pair.select(*tile, "a", "b").mapInArrow(compare, "u long, v long")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """key and its set of shingles (array of longs) of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            sets = [pa.array(shingles((t.as_py() or "").encode(), words).view(np.int64)) for t in batch["text"]]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int32)
            values = pa.concat_arrays(sets) if sets else pa.array([], pa.int64())
            yield pa.record_batch([batch["key"], pa.ListArray.from_arrays(pa.array(ends), values)], ["key", "hs"])

    return rows.select("key", "text").mapInArrow(run, "key long, hs array<long>")


def _marked(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` with _may: whether their key may be among those of ``wanted``, so that few rows are shuffled to be joined.

    A bitmap of the wanted keys' hashes is broadcast, of _BITS bits and so 4 MB at most; beyond some millions of wanted rows
    it lets more and more through, which costs a larger shuffle and no result.
    """
    place = F.pmod(F.xxhash64(key), F.lit(_BITS)) + 1
    maps = wanted.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_at")).groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    held = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": F.bitmap_bit_position(place)}).join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.substr(F.col("_bits"), (F.shiftright("_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return held.withColumn("_may", F.coalesce(F.getbit(byte, F.col("_at").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))).drop("_bucket", "_at", "_bits")


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` less most of those whose key ``wanted`` lacks."""
    return _marked(rows, wanted, key).where("_may").drop("_may")


def _without(rows: DataFrame, unwanted: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key ``unwanted`` lacks; only rows that may be unwanted are shuffled."""
    marked = _marked(rows, unwanted, key)
    return marked.where("NOT _may").drop("_may").unionByName(marked.where("_may").drop("_may").join(unwanted.select(key), key, "left_anti"))


class Sets:
    """Sets of shingles of the keys asked for, read from texts once each, and pairs verified on them.

    distinct: key, rid (of one row that has the set); rows: rid, text.
    """

    def __init__(self, distinct: DataFrame, rows: DataFrame, words: int, similar: tuple[int, int]):
        self._distinct, self._rows, self._words, self._similar, self._known = distinct, rows, words, similar, []

    def of(self, keys: DataFrame) -> DataFrame:
        """key and set (array of longs) of at least the ``keys``."""
        if self._known:
            keys = keys.join(self._all().select("key"), "key", "left_anti")
        wanted = durable(self._distinct.select("key", "rid").join(keys, "key"), "near-wanted")
        if wanted.limit(1).count():
            self._known.append(durable(_sets(likely(self._rows, wanted, "rid").join(wanted, "rid").dropDuplicates(["rid"]), self._words), "near-sets"))
        discard(wanted)
        return self._all()

    def _all(self) -> DataFrame:
        empty = self._rows.sparkSession.createDataFrame([], "key bigint, hs array<bigint>")
        return functools.reduce(DataFrame.unionByName, self._known) if self._known else empty

    def verified(self, pair: DataFrame) -> DataFrame:
        """Those of distinct pairs (u, v) that are similar enough."""
        ends = pair.select(F.col("u").alias("key")).union(pair.select("v")).distinct()
        near = likely(self.of(ends), ends, "key") if self._known else self.of(ends)
        both = pair.join(near.select(F.col("key").alias("u"), F.col("hs").alias("hu")), "u").join(near.select(F.col("key").alias("v"), F.col("hs").alias("hv")), "v")
        part, whole = self._similar
        enough = (whole + part) * F.size(F.array_intersect("hu", "hv")) >= part * (F.size("hu") + F.size("hv"))
        return durable(both.where(enough).select("u", "v"), "near-links")

    def discard(self) -> None:
        for s in self._known:
            discard(s)


def grouped_by(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """``rows`` with g: the component of their key, or the key alone."""
    if found is None:
        return rows.withColumn("g", F.col("key"))
    return rows.join(found, F.col("key") == F.col("node"), "left").withColumn("g", F.coalesce("component", "key")).drop("node", "component")


def joined_links(placed: DataFrame, pairs: DataFrame, sets: Sets, similar: tuple[int, int] = SIMILAR, found: DataFrame | None = None, also: DataFrame | None = None) -> DataFrame:
    """node, component of all keys that links join: those between rows of the given pairs of tiles, those among the pairs (u, v)
    of ``also``, and those of ``found``.

    placed: key, n, sketch, c, t; pairs: c, t, d, s. Tiles with few candidates give them all; others a forest that spans
    them, and are compared again without what verified links have joined. Once few candidates hold, or after some rounds, what
    is left is settled on the sets.
    """
    spark, turn, tried, good = placed.sparkSession, 0, None, None
    while True:
        used = pairs.select("c", "t").union(pairs.select("d", "s")).distinct()
        grouped = grouped_by(placed.join(used, ["c", "t"], "left_semi") if turn else placed, found)
        last = turn == TURNS or (turn > 0 and FEW * good.count() < tried.count())
        own = sets.of(grouped.select("key").distinct()) if last else None
        with one_row_a_batch(spark):  # a pair of tiles is MBs
            if last:
                return with_links(found, durable(_settled(grouped, pairs, own, similar), "near-settled"))
            tried = durable(candidates(grouped, pairs, turn, similar), "near-tried")
        pair = tried.select("u", "v")
        good = sets.verified((pair if turn or also is None else pair.unionByName(also)).distinct())
        found, turn = with_links(found, good), turn + 1
        pairs = durable(tried.where("open").select("c", "t", "d", "s").distinct(), "near-again")
        if pairs.limit(1).count() == 0:
            return found


def with_links(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component after more links (u, v); what was found before goes in as the stars that it is."""
    if found is not None:
        if links.limit(1).count() == 0:
            return found
        links = links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return durable(components(links, "near-joined"), "near-found")


def links(distinct: DataFrame, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """node, component of the keys that pairs of Jaccard similarity 0.8 or more join.

    distinct: key (a number of the set's own, fixed by being written), n, c, sketch, rid (of one row that has the set); rows:
    rid, text. The driver sees the cells' sizes only.
    """
    spark = distinct.sparkSession
    sizes = {r["c"]: r for r in distinct.groupBy("c").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).collect()}
    tiles = {c: -(-r["rows"] // min(TILE, max(16, TILE_BYTES // (8 * width(c))))) for c, r in sizes.items()}
    part, whole = SIMILAR
    near = [(c, d, tiles[c], tiles[d]) for c in tiles for d in tiles if c <= d and whole * sizes[c]["most"] >= part * sizes[d]["least"]]
    how_many = F.create_map(*[F.lit(x) for cn in tiles.items() for x in cn]) if tiles else F.create_map(F.lit(0), F.lit(1))
    placed = distinct.withColumn("t", F.pmod(F.xxhash64("key"), how_many[F.col("c")].cast("long")).cast("int")).withColumn("c", F.col("c").cast("long"))
    pairs = spark.createDataFrame(near, "c long, d long, nc int, nd int")
    pairs = pairs.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("nd") - 1))).where("c < d OR t <= s").select("c", "t", "d", "s")
    sets = Sets(distinct, rows, words, SIMILAR)
    try:
        return joined_links(placed, pairs, sets)
    finally:
        sets.discard()


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and others) less near copies: of each group linked by a Jaccard similarity of 0.8 or more
    of word shingles, the row of smallest doc_id stays.

    Null doc_id comes last; rows equal in doc_id are told apart by a hash of the row, and of full duplicates one stays.
    Texts are lower-cased in A-Z only. Null and wordless texts are copies of each other. Empty table: no rows.
    """
    rows = docs.withColumn("rid", row_id(docs))
    printed = durable(prints(rows, words), "near-prints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    distinct = printed.groupBy("digest").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.first("sketch").alias("sketch"), F.min(order).alias("least"))
    distinct = durable(distinct.withColumns({"rid": F.col("least.rid"), "key": F.monotonically_increasing_id()}), "near-distinct")
    found = links(distinct, rows, words)
    of = distinct.join(found, F.col("key") == F.col("node"), "left").select("digest", "least", F.coalesce("component", "key").alias("g"))
    stays = of.groupBy("g").agg(F.min("least").alias("least")).select("g", F.col("least.rid").alias("stays"))
    dropped = printed.join(of.join(stays, "g").select("digest", "stays"), "digest").where("rid <> stays").select("rid")
    dropped = durable(dropped.distinct(), "near-dropped")
    kept = _without(rows, dropped, "rid")
    repeated = durable(printed.groupBy("rid").count().where("count > 1").select("rid").join(dropped, "rid", "left_anti"), "near-repeated")
    if repeated.limit(1).count():
        once = likely(rows, repeated, "rid").join(repeated, "rid", "left_semi").dropDuplicates(["rid"])
        kept = _without(kept, repeated, "rid").unionByName(once)
    return kept.select(*docs.columns)
