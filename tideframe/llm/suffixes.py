"""Suffix sorting in linear time by groups, and dedup of long byte strings with it.

Suffixes are sorted in two phases. The first refines groups of suffixes from the largest down: each suffix of the group at
hand points to the nearest earlier suffix of a smaller group, and the suffixes pointed at are split off their own group by
how many point at them. In the end a group holds the suffixes that begin with the same Lyndon word. The second phase walks
the order from its smallest suffix and puts what lies before each one, along the pointers, to the next free place of its
group. Nothing is renamed and nothing recurses. :func:`suffix_orders` takes many texts in step, each with its own group at
hand, so that every step is a few operations on arrays; :func:`suffix_order` takes one.

For a corpus, equal strings of the full length meet through a chosen short string inside them (see ``repeats``); around
each one that repeats lies a piece of text with all the strings that chose it. Equal pieces become one, with their first
place; pieces that share a short string and differ make one text, whose suffixes are sorted, in symbols of eight bytes
counted from the short string, and neighbours in that order that agree far enough are occurrences of one string. A short
string that very many texts share would bring them all to one task; the strings around it are dealt by hashes of
themselves instead. Pieces, and those strings, are known by a name of 64 bits, mixed from two independent hashes, the place
of the short string and the length: two that differ share a name once in 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import ANSWER, BOTH, Layout, Replies, answers, both, by_range, chosen, send
from .store import discard, durable
from .textblocks import Block, Spans, blend, cuts, give_back, mix64

_LAST_ID, _OTHER = 2**63 - 1, 0x2545F4914F6CDD1D
#: Bytes of pieces that are sorted in one go, but for pieces around one short string, which stay together.
SORTED_BYTES = 1_000_000
#: Bytes of texts that are hashed at a time; a worker needs some hundred times as much while it does. Longer texts are cut.
SLICE_BYTES = 500_000
#: Texts that are sorted one by one, the longest of those at hand.
_ALONE = 64


def suffix_order(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in order; a suffix that begins another is the smaller one."""
    n = len(symbols) + 1
    text = np.concatenate([[-1], np.asarray(symbols, np.int64)]) if n > 1 else np.array([-1])
    text = np.append(text[1:], -1)  # the empty suffix is the smallest
    order = np.argsort(text, kind="stable")
    heads = np.flatnonzero(np.diff(text[order], prepend=-2) != 0)
    start_of = np.repeat(heads, np.diff(np.append(heads, n)))
    group = np.empty(n, np.int64)
    group[order] = start_of
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    order, group, at = order.tolist(), group.tolist(), at.tolist()
    size = [0] * n
    for h, k in zip(heads.tolist(), np.diff(np.append(heads, n)).tolist(), strict=True):
        size[h] = k
    before = [-1] * n

    end = n
    while end:
        low = group[order[end - 1]]
        count: dict[int, int] = {}
        for s in sorted(order[low:end]) if end - low > 1 else (order[low],):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        end = low
        if not count:
            continue
        if len(count) == 1:
            ranked = [next(iter(count))]
        else:
            ranked = sorted(count, key=count.get, reverse=True)
        at_rank = 0
        while at_rank < len(ranked):  # those that most point at go to the top of their groups first
            times, stop = count[ranked[at_rank]], at_rank
            while stop < len(ranked) and count[ranked[stop]] == times:
                stop += 1
            moved: dict[int, int] = {}
            for p in ranked[at_rank:stop]:
                g = group[p]
                moved[g] = k = moved.get(g, 0) + 1
                to = g + size[g] - k
                q, here = order[to], at[p]
                order[here], order[to] = q, p
                at[q], at[p] = here, to
            for g, k in moved.items():
                if k < size[g]:
                    size[g] -= k
                    new = g + size[g]
                    size[new] = k
                    for x in order[new : new + k]:
                        group[x] = new
            at_rank = stop

    out = [-1] * n
    free = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return out[1:]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where each run of rows with equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _spread(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after another."""
    return np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)


def suffix_orders(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Orders of the suffixes of many texts, as places in ``text``, one text's after another.

    Text k lies at first[k] to before first[k + 1] and ends with its smallest symbol, which it has nowhere else. The few
    longest texts, for which steps would be nearly empty, are sorted one by one.
    """
    out, lengths = np.empty(len(text), np.int64), np.diff(first)
    most = np.partition(lengths, -_ALONE)[-_ALONE] if len(lengths) > _ALONE else 0
    for k in np.flatnonzero(lengths > most):
        low, high = first[k], first[k + 1]
        out[low] = high - 1
        out[low + 1 : high] = np.array(suffix_order(text[low : high - 1].tolist()), np.int64) + low
    rest = np.flatnonzero((lengths <= most) & (lengths > 0))
    if len(rest):
        place = _spread(first[rest], lengths[rest])
        inner = np.concatenate([[0], np.cumsum(lengths[rest])])
        out[place] = place[_in_step(text[place], inner)]
    return out


def _in_step(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    n, starts = len(text), first[:-1]
    of = np.repeat(np.arange(len(starts)), np.diff(first))
    order = np.lexsort((text, of))
    heads = _starts(of[order], text[order])
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    group, at = np.empty(n, np.int64), np.empty(n, np.int64)
    group[order], at[order] = np.repeat(heads, size[heads]), np.arange(n)
    before, taken = np.full(n, -1, np.int64), np.zeros(n, bool)

    end, live = first[1:].copy(), np.arange(len(starts))
    while len(live):  # each text's largest group that wasn't at hand yet
        low = group[order[end[live] - 1]]
        many = end[live] - low
        s, lows, begin = order[_spread(low, many)], np.repeat(low, many), np.repeat(starts[live], many)
        end[live] = low
        live = live[low > starts[live]]
        p = s - 1
        on = np.arange(len(p))
        while len(on := on[p[on] >= begin[on]]) and len(on := on[group[p[on]] > lows[on]]):
            p[on] = before[p[on]]
        p[p < begin] = -1
        before[s] = p
        on = np.arange(len(p))  # of those that point into their own group, on along the pointers of the others
        while len(on := on[p[on] >= 0]) and len(on := on[group[p[on]] == lows[on]]):
            before[s[on]] = p[on] = before[p[on]]
        p = p[p >= 0]
        if not len(p):
            continue
        p, count = np.unique(p, return_counts=True)
        by = np.lexsort((count, group[p]))  # those that most point at go to the top of their groups
        p, count = p[by], count[by]
        g = group[p]
        h = _starts(g)
        moved = np.diff(np.append(h, len(g)))
        tail = np.repeat(g[h] + size[g[h]] - moved, moved)
        to, now = tail + np.arange(len(p)) - np.repeat(h, moved), at[p]
        inside = now >= tail
        taken[now[inside]] = True
        free = to[~taken[to]]
        taken[now[inside]] = False
        holes, stay = now[~inside], order[free]
        order[holes], at[stay] = stay, holes
        order[to], at[p] = p, to
        new = _starts(g, count)
        size[g[h]] -= moved
        size[to[new]] = np.diff(np.append(new, len(p)))
        group[p] = np.repeat(to[new], size[to[new]])

    out, free, placed = np.full(n, -1, np.int64), np.arange(n), np.zeros(n, bool)
    out[starts] = first[1:] - 1
    placed[first[1:] - 1] = True
    longest = np.argsort(-np.diff(first), kind="stable")
    begin, lengths = starts[longest], np.diff(first)[longest]
    for i in range(int(lengths[0])):
        b = begin[: np.searchsorted(-lengths, -i, side="left")]
        s = out[b + i] - 1
        s = s[s >= b]
        while len(s := s[~placed[s]]):
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = before[s]
            s = s[s >= 0]
    return out


class PieceBlock(Block):
    """A block with its strings of the full length and the chosen short string of each."""

    def __init__(self, texts: list[bytes], width: int):
        super().__init__(texts)
        self.width, self.short = width, max(1, width * 8 // 25)
        short, n = self.short, len(self.buffer)
        self.spans, self.other = Spans(self.buffer, 8), Spans(self.buffer, 8, _OTHER)
        value = self.spans.fixed(short)
        pick = chosen((value >> np.uint64(32)).astype(np.uint32), width - short + 1)
        whole = np.zeros(n + 1, np.int8)
        long_enough = self.last - self.first >= width
        np.add.at(whole, self.first[long_enough], 1)
        np.add.at(whole, self.last[long_enough] - width + 1, -1)
        at = np.flatnonzero(np.cumsum(whole)[: len(pick)])
        cut = np.flatnonzero((np.diff(pick[at], prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1)) if len(at) else at
        self.low = at[cut]
        self.high = at[np.append(cut[1:], len(at)) - 1] if len(at) else at
        self.place = pick[self.low] if len(at) else at
        self.doc = np.searchsorted(self.first, self.low, side="right") - 1
        self.key = value[self.place] if len(at) else np.zeros(0, np.uint64)

    def pieces(self, known: Replies) -> np.ndarray:
        """One entry for each occurrence of each piece whose short string repeats.

        Around a hot short string every full-length string is a piece of its own, known by two hashes instead of its bytes.
        """
        has, hot = known.find(self.key)
        cold = np.flatnonzero(has & ~hot)
        out = np.zeros(len(cold), _PIECE)
        out["key"], out["into"], out["n"] = self.key[cold], self.place[cold] - self.low[cold], self.high[cold] - self.low[cold] + 1
        out["low"], out["doc"] = self.low[cold], self.doc[cold]
        out["check"] = self.other.hash(self.low[cold], self.high[cold] + self.width)
        warm = np.flatnonzero(hot)
        n = self.high[warm] - self.low[warm] + 1
        each = np.repeat(np.arange(len(warm)), n)
        low = self.low[warm][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        one = np.zeros(len(low), _PIECE)
        one["key"], one["check"] = self.spans.hash(low, low + self.width), self.other.hash(low, low + self.width)
        one["n"], one["low"], one["doc"], one["hot"] = 1, low, self.doc[warm][each], True
        return np.concatenate([out, one])


_PIECE = np.dtype([("key", "<u8"), ("check", "<u8"), ("into", "<i8"), ("n", "<i8"), ("low", "<i8"), ("doc", "<i8"), ("hot", "?")])
_SHIPPED = np.dtype([("key", "<u8"), ("check", "<u8"), ("id", "<i8"), ("at", "<i8"), ("into", "<u2"), ("n", "<u2"), ("bytes", "<u4")])
_OWNER = np.dtype([("name", "<u8"), ("id", "<i8"), ("at", "<i8"), ("from", "<u2"), ("to", "<u2")])


def _name(key: np.ndarray, check: np.ndarray, into: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix64(mix64(key ^ (into.astype(np.uint64) << np.uint64(20)) ^ n.astype(np.uint64)) ^ check)


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sort of rows by ``keys``, the first of highest rank, and where each group of equal first keys begins in it."""
    order = np.lexsort(keys[::-1])
    k = keys[0][order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _gather(buffer: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after another."""
    at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
    return buffer[at]


def _ship(layout: Layout, cut: list[tuple[int, int, bytes]], all_ids: np.ndarray, known: Replies, width: int, block: int) -> list[tuple[int, bytes]]:
    """What a block sends to each range of keys: its distinct pieces, each with its first place in the block."""
    b = PieceBlock([t for _, _, t in cut], width)
    ids, base = all_ids[[k for k, _, _ in cut]], np.array([x for _, x, _ in cut], np.int64)
    p = b.pieces(known)
    doc_id, at = ids[p["doc"]], p["low"] - b.first[p["doc"]] + base[p["doc"]]
    order, heads = _firsts(_name(p["key"], p["check"], p["into"], p["n"]), doc_id, at)
    p, doc_id, at = p[order[heads]], doc_id[order[heads]], at[order[heads]]
    ship = np.zeros(len(p), _SHIPPED)
    for f, v in (("key", p["key"]), ("check", p["check"]), ("id", doc_id), ("at", at), ("into", p["into"]), ("n", p["n"]), ("bytes", np.where(p["hot"], 0, p["n"] + width - 1))):
        ship[f] = v
    by_place = np.argsort(p["low"], kind="stable")  # pieces that overlap lie together and pack well
    ship, low = ship[by_place], p["low"][by_place]
    rows = np.arange(len(ship))
    pack = zstandard.ZstdCompressor(level=3)
    out = []
    for r, part in by_range(layout, ship["key"], rows):
        body = _gather(b.buffer, low[part], ship["bytes"][part].astype(np.int64))
        head = ship[part].tobytes()
        out.append((r, pack.compress(np.int64([block, len(part)]).tobytes() + head + body.tobytes())))
    return out


def _eight(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number."""
    return body[at[:, None] + np.arange(8)].view("<u8")[:, 0]


def _string_classes(body: np.ndarray, where: np.ndarray, into: np.ndarray, n: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, offset and class of every string of ``width`` bytes of pieces of ``n`` such strings; equal ones share a class.

    Pieces lie at ``where`` in ``body`` with their short string ``into`` them, in order of its ``key``; those of one key make
    one text to be sorted. Strings that are equal have it at the same
    place, so the suffixes to sort are those that begin a whole number of eight-byte symbols from it. A string is its
    whole symbols, which the order of suffixes finds equal, and fewer than eight bytes before and after them.
    """
    shift = into % 8
    units = (n + width - 1 - shift) // 8
    keys = _starts(key)
    first = np.cumsum(units + 1) - units - 1  # a separator, smaller than all symbols, ends each piece; the last one of a text is smaller yet
    piece = np.repeat(np.arange(len(n)), units)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(units) - units, units)
    _, symbol = np.unique(_eight(body, where[piece] + shift[piece] + 8 * at), return_inverse=True)
    text = np.ones(int((units + 1).sum()), np.int64)
    text[first[piece] + at] = symbol + 2
    texts = np.append(first[keys], len(text))
    text[texts[1:] - 1] = 0
    left = np.zeros(len(text), np.int64)  # symbols from here to the end of the piece
    left[first[piece] + at] = units[piece] - at
    order = suffix_orders(text, texts)
    of_key = np.repeat(np.arange(len(keys)), np.diff(texts))

    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = -((shift[owner] - offset) // 8)  # first whole symbol
    whole = (offset + width - shift[owner]) // 8 - start
    group = np.zeros(len(owner), np.uint64)
    for depth in np.unique(whole):
        o = order[left[order] >= depth]
        same = np.zeros(len(o), bool)
        same[1:] = (text[o[1:, None] + np.arange(depth)] == text[o[:-1, None] + np.arange(depth)]).all(axis=1) & (of_key[o[1:]] == of_key[o[:-1]])
        of = np.zeros(len(text), np.int64)
        of[o] = np.cumsum(~same)
        mine = whole == depth
        group[mine] = of[first[owner[mine]] + start[mine]]
    head = shift[owner] + 8 * start - offset
    tail = (offset + width - shift[owner]) % 8
    low = where[owner] + offset
    mask = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    before = _eight(body, low) & mask[head]
    after = (_eight(body, low + width - 8) >> (np.uint64(8) * (np.uint64(8) - tail.astype(np.uint64)) % np.uint64(64))) & mask[tail]
    klass = blend(group, (into[owner] - offset).astype(np.uint64))
    return owner, offset, blend(blend(klass, before), after)


def _together(rivals: np.ndarray, distinct: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rivals, in order of key, in parts of about ``most`` bytes; those of one key stay together."""
    key = distinct["key"][rivals]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.concatenate([[0], np.cumsum(distinct["bytes"][rivals].astype(np.int64))])
    at = 0
    for k in np.append(new[1:], len(rivals)):
        if total[k] - total[at] >= most or k == len(rivals):
            yield rivals[at:k]
            at = k


def _rival_owners(rivals: np.ndarray, distinct: np.ndarray, names: np.ndarray, body: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
    """First places, in runs of neighbouring strings, of all strings of pieces that are sorted together."""
    d = distinct[rivals]
    piece, offset, klass = _string_classes(body, where[rivals], d["into"].astype(np.int64), d["n"].astype(np.int64), d["key"], width)
    ids, ats = distinct["id"][rivals][piece], distinct["at"][rivals][piece] + offset
    order, first = _firsts(klass, ids, ats)
    sizes = np.diff(np.append(first, len(order)))
    own = np.zeros(len(order), _OWNER)
    own["name"], own["from"], own["to"] = names[rivals][piece], offset, offset + 1
    own["id"][order], own["at"][order] = np.repeat(ids[order[first]], sizes), np.repeat(ats[order[first]], sizes)
    own["at"] -= offset
    own = own[np.lexsort((offset, piece))]
    new = np.concatenate([[True], (own["name"][1:] != own["name"][:-1]) | (own["id"][1:] != own["id"][:-1]) | (own["at"][1:] != own["at"][:-1])])
    runs = own[new].copy()
    runs["to"] = own["to"][np.append(np.flatnonzero(new)[1:], len(own)) - 1]
    return runs


def _owners(table: pa.Table, width: int) -> pa.Table:
    """First places of all strings of one range of keys, for each block that holds them."""
    heads, bodies, blocks = [], [], []
    unpack = zstandard.ZstdDecompressor()
    for packed in table["packed"].to_pylist():
        raw = unpack.decompress(packed)
        block, n = np.frombuffer(raw, np.int64, 2)
        heads.append(np.frombuffer(raw, _SHIPPED, n, 16))
        bodies.append(np.frombuffer(raw, np.uint8, -1, 16 + n * _SHIPPED.itemsize))
        blocks.append(np.full(n, block))
    got, body, block = np.concatenate(heads), np.concatenate(bodies), np.concatenate(blocks)
    body_at = np.cumsum(got["bytes"].astype(np.int64)) - got["bytes"]
    names = _name(got["key"], got["check"], got["into"], got["n"])
    order, first = _firsts(names, got["id"], got["at"])
    distinct = got[order[first]]
    where = body_at[order[first]]
    owner = np.zeros(len(distinct), _OWNER)
    owner["name"], owner["id"], owner["at"], owner["to"] = names[order[first]], distinct["id"], distinct["at"], distinct["n"]

    # pieces around one short string that differ are rivals; a part of them at a time is sorted
    by_key = np.argsort(distinct["key"], kind="stable")
    count = np.unique(distinct["key"][by_key], return_inverse=True, return_counts=True)
    rivals = by_key[(count[2][count[1]] > 1) & (distinct["bytes"][by_key] > 0)]
    sorted_, found = [], []
    for part in _together(rivals, distinct, SORTED_BYTES) if len(rivals) else ():
        sorted_.append(part)
        found.append(_rival_owners(part, distinct, owner["name"], body, where, width))
    if found:
        owner = np.concatenate([np.delete(owner, np.concatenate(sorted_)), *found])
    owner = owner[np.argsort(owner["name"], kind="stable")]

    # to each block, what holds for its pieces
    low = np.searchsorted(owner["name"], names, side="left")
    n = np.searchsorted(owner["name"], names, side="right") - low
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    to = np.repeat(block, n)
    order = np.argsort(to, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []
    pack = zstandard.ZstdCompressor(level=3)
    return pa.table(
        {"block": pa.array([int(to[p[0]]) for p in parts], pa.int64()), "packed": pa.array([pack.compress(owner[rows[p]].tobytes()) for p in parts], pa.binary())}
    )


def _cover(b: PieceBlock, p: np.ndarray, ids: np.ndarray, base: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which bytes of the block's buffer lie in a string that also starts earlier. base: where its texts begin in their rows'."""
    names = _name(p["key"], p["check"], p["into"], p["n"])
    low = np.searchsorted(owner["name"], names, side="left")
    n = np.searchsorted(owner["name"], names, side="right") - low
    each = np.repeat(np.arange(len(p)), n)
    own = owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(each))]
    at = p["low"][each] - b.first[p["doc"][each]] + base[p["doc"][each]]
    later = (own["id"] != ids[p["doc"][each]]) | (own["at"] != at)
    marks = np.zeros(len(b.buffer) + 1, np.int64)
    np.add.at(marks, p["low"][each][later] + own["from"][later], 1)
    np.add.at(marks, p["low"][each][later] + own["to"][later] + b.width - 1, -1)
    return np.cumsum(marks)[:-1] > 0


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST_ID).to_numpy()


def remove_repeats(docs: DataFrame, width: int = 100, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte covered by a string of ``width`` bytes that also starts earlier.

    One row per row of ``docs`` (integer doc_id, text; other columns are ignored): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and, if asked for, kept, the bytes left as text (a character that was cut apart is left out), and the columns of ``docs`` named in ``carry``. Earlier
    means in a text of smaller doc_id, null the largest, or earlier in the same text; strings lie in one text and are judged on the
    input. Rows of one doc_id at the same place don't start earlier than each other, so full duplicates all keep what one
    of them would. Null text: as empty. Texts under ``width`` bytes lose nothing. Empty table: no rows.
    """
    if width < 32:
        raise ValueError("width is 32 bytes or more")
    layout = Layout(docs)
    rows = docs.select("doc_id", "text", layout.block())
    carried = docs.select("doc_id", "text", layout.block(), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            blocks = batch["block"].to_numpy()
            for cut in cuts(batch["text"], SLICE_BYTES, width - 1):
                b = PieceBlock([t for _, _, t in cut], width)
                yield both(*send(layout, b.key, blocks[np.array([k for k, _, _ in cut])[b.doc]]))

    sent = durable(rows.mapInArrow(scan, BOTH), "suffixes-1-sent")
    told = durable(answers(sent), "suffixes-1")
    discard(sent)

    def ship(block: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        known, ids, out = Replies(replies["packed"]), _ids(texts["doc_id"].combine_chunks()), []
        for cut in cuts(texts["text"].combine_chunks(), SLICE_BYTES, width - 1):
            out += _ship(layout, cut, ids, known, width, block[0].as_py())
        return pa.table({"range": pa.array([r for r, _ in out], pa.int64()), "packed": pa.array([x for _, x in out], pa.binary())})

    def own(table: pa.Table) -> pa.Table:
        give_back()
        return _owners(table, width)

    pieces = durable(rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ship, "range long, packed binary"), "suffixes-2-sent")
    owners = durable(pieces.groupBy("range").applyInArrow(own, ANSWER), "suffixes-2")
    discard(pieces)
    # what a block was told first is needed again to find the same pieces
    facts = told.selectExpr("block", "packed", "true AS first").unionByName(owners.selectExpr("block", "packed", "false AS first"))

    def judge(texts: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        is_first = np.asarray(replies["first"].to_pylist(), bool)
        packed = replies["packed"].to_pylist()
        known = Replies(pa.chunked_array([pa.array([x for x, f in zip(packed, is_first, strict=True) if f], pa.binary())]))
        unpack = zstandard.ZstdDecompressor()
        owner = np.frombuffer(b"".join(unpack.decompress(x) for x, f in zip(packed, is_first, strict=True) if not f), _OWNER)
        owner = owner[np.argsort(owner["name"], kind="stable")]
        if len(owner):  # slices of one block ask and are told alike
            owner = np.unique(owner)
        ids = _ids(texts["doc_id"].combine_chunks())
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        column, wide = texts["text"].combine_chunks().cast(pa.binary()), np.zeros(0, bool)

        def settle(text: bytes, gone: np.ndarray) -> None:
            left = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(left))
            out["n_spans"].append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum()))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            if with_text:
                out["kept"].append(left.decode("utf-8", "ignore"))

        for cut in cuts(column, SLICE_BYTES, width - 1):
            b = PieceBlock([t for _, _, t in cut], width)
            gone = _cover(b, b.pieces(known), ids[[k for k, _, _ in cut]], np.array([x for _, x, _ in cut], np.int64), owner)
            for d, (k, base, piece) in enumerate(cut):
                mine = gone[b.first[d] : b.last[d]]
                if base == 0 and len(piece) < SLICE_BYTES + width - 1:
                    settle(piece, mine)
                    continue
                text = column[k].as_py()  # a piece of a long text, of which all pieces come one after another
                wide = np.zeros(len(text), bool) if base == 0 else wide
                wide[base : base + len(piece)] |= mine
                if base + len(piece) >= len(text):
                    settle(text, wide)
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.string()} if with_text else {})
        return pa.table({"doc_id": texts["doc_id"]} | {k: pa.array(out[k], t) for k, t in kinds.items()} | {c: texts[f"_carry_{c}"] for c in carry})

    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return carried.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(judge, schema)
