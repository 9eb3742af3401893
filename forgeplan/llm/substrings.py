"""Near-duplicate passages across documents by compact windows.

Tokens are word shingles (`width` lower-cased words). Under each of `hashes` functions, all passages of at least
`least` words fall into compact windows (l, c, r): every passage [i, j] with l <= i <= c <= j <= r has its minimum at
c. The windows are the nodes of the Cartesian tree over the hashes, built level by level for many texts at once by
splitting each interval at its minimum and leaving those too short for a passage.

1. Windows of all distinct texts meet by their minimum, at every place of a text. In a group of up to `dense` windows
   all pairs are proposed, with both intervals.
2. For each pair of texts, windows of `enough` functions must hold a passage of both texts in common: an interval join
   of the windows [l, r], taken along each diagonal in one sorted sweep.
3. The proposed regions are compared in full: their densest common stretches of `least` words or more are kept if
   their Jaccard similarity is `similarity` or more.
4. In larger groups no pairs are formed. Under each function the shingles about the minimum are gathered, and the group
   is settled in blocks of about `block` windows (`settled`): windows that no leader has linked become leaders and are
   compared with the whole block; then every window outside the block's largest class is, unless one class is left.
   Two windows of a block that link are thus in one class, whatever the block's size, and copies cost one comparison
   each. A group of more windows is dealt to parts of half a block, and every two parts meet in a block of their own,
   so any two windows of a group meet. A key that is frequent within a chunk of one task is dealt out by text at once,
   so no task gathers its windows.

A pair of texts at the least similarity agrees under two of five functions with a probability of 0.993, which is enough
whatever groups it meets in, as one large group is; equal passages agree under all.

Verified passages that overlap in a text are one; passages linked across texts form classes. Copies of a whole text
are not compared: they have its passages, and one passage over the whole text if nothing else.

Ids of any type that can be ordered are carried as they are. Cases: null, blank and short texts have no passage;
repeated rows are copies of one text, and of one document if their ids are equal too; null ids are reported with a
null id; of equal minima one at a scattered place counts; an empty table gives an empty table; very long texts are
scanned whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, chunks, looked_up, mix, staged, words
from .decontamination import bloom, contains, slots_for
from .graph import components
from .packing import n_words
from .secrets import let

_K = np.uint64(0x9E3779B97F4A7C15)
def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of `width` words, in order."""
    rows, codes, distinct = words(texts)
    each = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in (x.as_py() for x in distinct.cast(pa.binary()))), np.uint64, len(distinct))
    h = each[codes]
    n = len(h) - width + 1
    if n < 1:
        return rows[:0], h[:0]
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * _K + h[k : n + k])
    whole = rows[:n] == rows[width - 1 :]
    return rows[:n][whole], out[whole]


def windows(rows: np.ndarray, hashes: np.ndarray, function: int, least: int) -> tuple[np.ndarray, ...]:
    """(key, l, c, r) of the compact windows with room for `least` shingles; places count from the array's start."""
    n = len(hashes)
    g = mix(hashes ^ mix(np.array([function + 1], np.uint64)))
    edges = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1], [True]])) if n else np.zeros(1, np.int64)
    lo, hi = edges[:-1], edges[1:]
    start = np.repeat(lo, hi - lo)
    # of equal hashes one at a scattered place comes first, so repetitive texts do not make deep trees
    bits = np.uint64(max(1, int((hi - lo).max(initial=1)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    odd = 0x9E3779B1
    order = np.append((g >> bits << bits) | ((np.arange(n) - start).astype(np.uint64) * np.uint64(odd) & low), np.uint64(2**64 - 1))
    back = np.uint64(pow(odd, -1, 1 << int(bits)))
    found = []
    while True:
        keep = hi - lo >= least
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            break
        c = start[lo] + (np.minimum.reduceat(order, np.stack([lo, hi], axis=1).ravel())[::2] * back & low).astype(np.int64)
        found.append((lo, c, hi - 1))
        lo, hi = np.stack([lo, c + 1], axis=1).ravel(), np.stack([c, hi], axis=1).ravel()
    lo, c, hi = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return (g[c] >> np.uint64(4) << np.uint64(4)) | np.uint64(function), lo, c, hi


def proposals(key: np.ndarray, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows, sorted by key, that share one; no key has more than `dense` rows."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, dense):
        i = np.flatnonzero(key[: max(0, len(key) - step)] == key[step:])
        a.append(i)
        b.append(i + step)
    return np.concatenate(a), np.concatenate(b)


def sizes(key: np.ndarray) -> np.ndarray:
    """The size of each row's group among sorted keys."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    n = np.diff(np.append(at, len(key)))
    return np.repeat(n, n)


def regions(f: np.ndarray, wa: np.ndarray, wb: np.ndarray, room: int, enough: int, slack: int = 16) -> list[tuple[int, int, int, int]]:
    """(first and last shingle in a, in b) where windows of enough functions have a passage in common.

    `wa` and `wb` hold (l, c, r) of the windows of a and b. Aligned by their minima, two windows share a stretch of
    both texts; along a diagonal (within `slack`) the stretches are swept by their starts, and joined while they
    have `room` shingles, less `slack`, in common with what is open. Regions are drawn out by `slack`.
    """
    shift = wb[:, 1] - wa[:, 1]
    lo = np.maximum(wa[:, 0], wb[:, 0] - shift)
    hi = np.minimum(wa[:, 2], wb[:, 2] - shift)
    open_: list[list] = []
    done = []
    for x, y, d, k in sorted(zip(lo.tolist(), hi.tolist(), shift.tolist(), f.tolist())):
        if y - x + 1 < room - slack:
            continue
        live, hit = [], None
        for c in open_:
            if c[1] - x + 1 < room - slack:
                done.append(c)
            else:
                live.append(c)
                if hit is None and abs(d - c[2]) <= slack:
                    hit = c
        open_ = live
        if hit is None:
            open_.append([x, y, d, {k}, d, d])
        else:
            hit[1], hit[2], hit[4], hit[5] = max(hit[1], y), d, min(hit[4], d), max(hit[5], d)
            hit[3].add(k)
    return [(c[0] - slack, c[1] + slack, c[0] + c[4] - slack, c[1] + c[5] + slack) for c in done + open_ if len(c[3]) >= enough]


def longest(shared: np.ndarray, share: float) -> tuple[int, int]:
    """Start and end of the longest stretch of which `share` is shared, cut to its first and last shared place."""
    total = np.concatenate([[0.0], np.cumsum(np.where(shared, 1 - share, -share))])
    low = np.minimum.accumulate(total)
    starts = np.searchsorted(-low, -total - 1e-9)  # the first place from which the sum up to each end is not negative
    end = int((np.arange(len(total)) - starts).argmax())
    some = np.flatnonzero(shared[starts[end] : end])
    return (int(starts[end] + some[0]), int(starts[end] + some[-1]) + 1) if len(some) else (0, 0)


def stretches(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> Iterator[tuple[int, int, int, int]]:
    """(first, last) shingle in a and in b of disjoint stretches of a that b shares to `similarity`, each long enough.

    Sets of equal size with a Jaccard similarity of s share 2s / (1 + s) of their members. A stretch that fails as a
    whole is tried again with half of the misses, then without any, and cut there.
    """
    need = 2 * similarity / (1 + similarity)
    shared = np.isin(a, b)
    work = [(0, len(a))]
    while work:
        lo, hi = work.pop()
        if hi - lo < least:
            continue
        for share in (need, (1 + need) / 2, 1.0):
            start, end = (lo + x for x in longest(shared[lo:hi], share))
            if end - start < least:
                break
            first, last = longest(np.isin(b, a[start:end]), share)
            x, y = np.unique(a[start:end]), np.unique(b[first:last])
            both = len(np.intersect1d(x, y, assume_unique=True))
            if last - first >= least and both >= similarity * (len(x) + len(y) - both):
                yield start, end - 1, first, last - 1
                break
        if end - start >= least:
            work += [(lo, start), (end, hi)]


def _repeats(of: np.ndarray) -> np.ndarray:
    """Whether a row has a shingle twice."""
    ordered = np.sort(of, axis=1)
    return ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)).any(axis=1)


class Block:
    """The shingles about the minima of a block of windows, numbered; -1 where a text has none.

    `most` has for each row the most shingles of a window that another text (`node`) has too, 0 where these are too
    few for any link.
    """

    def __init__(self, of: np.ndarray, node: np.ndarray, room: int, similarity: float):
        self.room, self.similarity, self.need = room, similarity, 2 * similarity / (1 + similarity) * room - 1e-9
        values, code = np.unique(of, return_inverse=True)
        self.code = code.reshape(of.shape).astype(np.int32)
        self.void = 0 if len(values) and values[0] < 0 else -1  # the number that stands for no shingle
        text = np.unique(node, return_inverse=True)[1].astype(np.int64)
        texts = np.bincount(np.unique(text[:, None] * len(values) + self.code) % len(values), minlength=len(values))
        most = self._windows((texts[self.code] > 1) & (self.code != self.void)).max(axis=1)
        self.most = np.where(most >= self.need, most, 0)
        self.repeats = _repeats(np.where(self.code == self.void, -1, self.code))
        self.place = np.full(len(values), -1, np.int16)
        self.n_values = len(values)

    def only(self, head: np.ndarray) -> None:
        """Keeps the rows `head`, and lists for each number the rows that have it, and those it is a rare one of.

        Of the different shingles of two stretches that link, at most `missed` are in one alone, a share of 1 -
        similarity of the row's; of the row's best window at most as many places as `need` leaves. So one of the rarest
        shingles, one more than these, of every window within the stretch is shared, on either side. Windows that
        start within `step` places of each other have a segment in common, which stands for them.
        """
        self.code, self.repeats, self.most = self.code[head], self.repeats[head], self.most[head]
        room, (n, wide) = self.room, self.code.shape
        self.flag = np.zeros(self.n_values, bool)
        self.listed = n > 64  # else all rows are compared
        if not self.listed:
            return
        once = np.sort(self.code, axis=1)
        fresh = np.concatenate([np.ones((n, 1), bool), once[:, 1:] != once[:, :-1]], axis=1) & (once != self.void)
        count = np.bincount(once[fresh], minlength=self.n_values)
        by_count = np.argsort(count, kind="stable").astype(np.int32)
        rank = np.empty(self.n_values, np.int32)
        rank[by_count] = np.arange(self.n_values, dtype=np.int32)
        missed = np.floor((1 - self.similarity) * fresh.sum(axis=1) + 1e-9).astype(np.int16)
        few = np.minimum(room - int(np.ceil(self.need)), missed)
        ranks, found = rank[self.code], []
        for kind, step in ((self.repeats, 1), (~self.repeats, max(1, room // 6))):  # few different shingles tell little
            for s in range(0, wide - room + 1, step):
                part = slice(min(s + step - 1, wide - room), s + room)
                some = np.flatnonzero(kind & (self.code[:, part] != self.void).all(axis=1) & (self.most > 0))
                ordered = np.sort(ranks[some, part], axis=1)
                new = np.concatenate([np.ones((len(some), 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
                nth = np.cumsum(new, axis=1, dtype=np.int16)
                row, column = np.nonzero(new & (nth <= missed[some, None] + 1))
                found.append((some[row], by_count[ordered[row, column]], nth[row, column] <= few[some[row]] + 1))
        row, code, rare = (np.concatenate(x) for x in zip(*found))
        own = np.unique(row * self.n_values + code)
        self.own, self.own_edge = own % self.n_values, np.searchsorted(own // self.n_values, np.arange(n + 1))
        rare = np.unique(code[rare].astype(np.int64) * n + row[rare])
        self.rare, self.rare_edge = (rare % n).astype(np.int32), np.searchsorted(rare // n, np.arange(self.n_values + 1))
        row, column = np.nonzero(fresh)
        code = once[row, column]
        by_code = np.argsort(code, kind="stable")
        self.rows, self.edge = row[by_code].astype(np.int32), np.searchsorted(code[by_code], np.arange(self.n_values + 1))
        self.mark = np.zeros(n, bool)

    def _windows(self, hit: np.ndarray) -> np.ndarray:
        total = np.zeros((len(hit), hit.shape[1] + 1), np.int16)
        np.cumsum(hit, axis=1, out=total[:, 1:], dtype=np.int16)
        return total[:, self.room :] - total[:, : -self.room]

    def _alike(self, leader: int, codes: np.ndarray) -> np.ndarray:
        """The rows with one of the leader's rarest numbers, for which one of `codes`, the leader's, is a rarest."""
        rare, mine = (
            np.concatenate([rows[x:y] for x, y in zip(edge[some].tolist(), edge[some + 1].tolist()) if x < y] or [rows[:0]])
            for rows, edge, some in ((self.rare, self.rare_edge, codes), (self.rows, self.edge, self.own[self.own_edge[leader] : self.own_edge[leader + 1]]))
        )
        self.mark[rare] = True
        row = np.unique(mine[self.mark[mine]])
        self.mark[rare] = False
        return row

    def shared(self, leader: int) -> tuple[np.ndarray, ...]:
        """(row, first, last, first, last) of the rows that link to row `leader`: their stretch and the leader's, in columns.

        A row links if one of its windows of `room` shingles, drawn out over equal neighbours and cut to its first and
        last shared place, has `room` or more, as the leader's stretch, and their Jaccard similarity is enough. Where
        shingles repeat, the leader's stretch is the longest of the row's, and other windows are tried (`stretches`).
        """
        room, wide, own = self.room, self.code.shape[1], self.code[leader]
        at = np.flatnonzero(own != self.void)[::-1]
        row = self._alike(leader, np.unique(own[at])) if self.listed else np.arange(len(self.code))
        self.place[own[at]] = at  # the first place of each shingle
        place = self.place[self.code[row]]
        self.place[own[at]] = -1
        hit = place >= 0
        window = self._windows(hit)
        best = window.argmax(axis=1)
        some = window[np.arange(len(row)), best] >= self.need
        row, hit, place, best = row[some], hit[some], place[some], best[some]
        if not len(row):
            return (row,) * 5
        at = np.arange(wide)
        # drawn out to the misses about the window, then cut to shared places
        start = np.where(~hit & (at < best[:, None]), at + 1, 0).max(axis=1)
        end = np.where(~hit & (at >= (best + room)[:, None]), at, wide).min(axis=1)
        inside = hit & (at >= start[:, None]) & (at < end[:, None])
        first, last = inside.argmax(axis=1), wide - 1 - inside[:, ::-1].argmax(axis=1)
        low, high = np.where(inside, place, wide).min(axis=1), np.where(inside, place, -1).max(axis=1)
        both, x, y = inside.sum(axis=1), last - first + 1, high - low + 1
        ok = (x >= room) & (y >= room) & (both >= self.similarity * (x + y - both) - 1e-9)
        twice = np.flatnonzero((self.repeats[row] | self.repeats[leader]) & (row != leader))
        if len(twice):  # a shingle has several places: the sets are compared, and the leader's stretch looked for
            ok[twice] = False
            within = (at >= first[twice, None]) & (at <= last[twice, None])
            sets = np.sort(np.where(within, self.code[row[twice]], self.n_values), axis=1)
            sets[:, 1:][sets[:, 1:] == sets[:, :-1]] = self.n_values
            _, one, which = np.unique(mix(sets.astype(np.uint64) + np.uint64(1)).sum(axis=1), return_index=True, return_inverse=True)
            for k, members in zip(one.tolist(), np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])):
                x = sets[k][sets[k] < self.n_values]
                self.flag[x] = True
                i, j = longest(self.flag[own], self.need / room)
                self.flag[x] = False
                y = np.unique(own[i:j])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if j - i >= room and both >= self.similarity * (len(x) + len(y) - both) - 1e-9:
                    of = twice[members]
                    of = of[last[of] - first[of] + 1 >= room]
                    ok[of], low[of], high[of] = True, i, j - 1
            # where the leader has such a window too, another one than that with the most hits may link
            rest = twice[~ok[twice]]
            back = np.zeros((len(rest), wide + 1), bool)
            back[np.arange(len(rest))[:, None], place[rest]] = True  # the last column takes the misses
            self.place[own[::-1]] = at[::-1]
            same = self.place[own]
            self.place[own] = -1
            # sets that link have at most this share of what they have in common on one side alone
            alone = np.floor((1 / self.similarity - 1) * back[:, :wide].sum(axis=1) + 1e-9)[:, None]
            once = np.bincount(same, minlength=wide)[same] == 1
            hit_ = back[:, same] & (own != self.void)
            rest = rest[((self._windows(hit_) >= self.need) & (self._windows(~hit_ & once) <= alone)).any(axis=1)]
            begin = int(np.argmax(own != self.void))
            for k in rest.tolist():
                whole = self.code[row[k]]
                inner = np.flatnonzero(whole != self.void)
                for x, y, i, j in stretches(whole[inner], own[own != self.void], room, self.similarity):
                    ok[k], first[k], last[k], low[k], high[k] = True, inner[0] + x, inner[0] + y, begin + i, begin + j
                    break
        return tuple(v[ok].astype(np.int64) for v in (row, first, last, low, high))


def settled(of: np.ndarray, node: np.ndarray, room: int, similarity: float) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Links (row, leader, first, last, first, last) that join the rows of a block into classes, and its leaders.

    Equal rows are compared once. Rows of one text (`node`) do not link to each other, so every place of a text is
    linked to another text. Rows that nothing in the block can link to count as leaders.
    """
    block = Block(of, node, room, similarity)
    if not block.most.any():
        return [], np.arange(len(of))
    weights = mix(np.arange(of.shape[1], dtype=np.uint64) + np.uint64(1))
    _, head, rep = np.unique(mix((mix(block.code.astype(np.uint64)) * weights).sum(axis=1)), return_index=True, return_inverse=True)
    by_rep = np.argsort(rep, kind="stable")
    edge = np.searchsorted(rep[by_rep], np.arange(len(head) + 1))
    block.only(head)
    most = block.most
    parent = np.arange(len(of))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, compared = [], most == 0
    leaders = np.isin(rep, np.flatnonzero(compared))
    linked = np.zeros(len(of), bool)

    def compare(k: int) -> None:
        compared[k] = True
        found, *places = block.shared(k)
        own = by_rep[edge[k] : edge[k + 1]]
        other = own[node[own] != node[own[0]]]
        n = edge[found + 1] - edge[found]
        row = by_rep[np.repeat(edge[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        places = [np.repeat(p, n) for p in places]
        leader = np.where(node[row] != node[own[0]], own[0], other[0] if len(other) else -1)
        keep = leader >= 0
        row, leader = row[keep], leader[keep]
        if len(row):
            out.append((row, leader, *(p[keep] for p in places)))
            linked[row] = linked[leader] = True
            for r, x in zip(row.tolist(), leader.tolist()):
                a, b = find(r), find(x)
                parent[max(a, b)] = min(a, b)

    order = np.argsort(-most, kind="stable").tolist()
    for k in order:
        if not compared[k] and not linked[by_rep[edge[k] : edge[k + 1]]].all():
            leaders[by_rep[edge[k]]] = True
            compare(k)
    # two classes may be linked by rows that no leader stands for: all but the largest class are compared
    classes, n = np.unique([find(x) for x in np.flatnonzero(linked).tolist()], return_counts=True)
    if len(classes) > 1:
        big = classes[n.argmax()]
        for k in [k for k in order if not compared[k] and any(find(x) != big for x in by_rep[edge[k] : edge[k + 1]].tolist())]:
            compare(k)
    return out, np.flatnonzero(leaders)


def released(spark: SparkSession) -> None:
    """Has the driver collect garbage: shuffle files of what is written go only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forest(links: np.ndarray) -> np.ndarray:
    """The links (node, start, end, node, start, end) that connect the same stretches, each with its ends' counts of links.

    The counts of a stretch stand with one link, and are 0 with its others, so that their sum is that of all links.
    """
    n = len(links)
    both = np.concatenate([links[:, :3], links[:, 3:]]).astype(np.uint64)
    ends, which = np.unique(mix(mix(mix(both[:, 0]) + both[:, 1]) + both[:, 2]), return_inverse=True)
    x, y = which[:n], which[n:]
    first = np.unique(x * len(ends) + y, return_index=True)[1]
    parent = list(range(len(ends)))
    keep = []
    for k, a, b in zip(first.tolist(), x[first].tolist(), y[first].tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(k)
    kept = np.concatenate([x[keep], y[keep]])
    counts = np.zeros(len(kept), np.int64)
    some, at = np.unique(kept, return_index=True)
    counts[at] = np.bincount(which)[some]
    return np.column_stack([links[keep], counts[: len(keep)], counts[len(keep) :]])


def passages(docs: DataFrame, least: int = 50, width: int = 5, similarity: float = 0.8, hashes: int = 5, enough: int = 2, dense: int = 16, block: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, class_id, n_links) for every passage of every document that another text or document shares.

    n_links counts each link that was found, once for every function and block that found it in a large group.
    """
    room = least - width + 1
    wide = 2 * room - 1
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows; those of keys that are frequent in a chunk have a part to be dealt to, and one row without an interval that tells so."""
        seen: set[int] = set()  # copies within a task give their windows once
        for part in parts:
            nodes = part.column(0).to_numpy()
            fresh = np.fromiter((not (x in seen or seen.add(x)) for x in nodes.tolist()), bool, len(nodes))
            seen = seen if len(seen) < 1 << 20 else set()
            part = part.filter(pa.array(fresh))
            nodes = nodes[fresh]
            for a, b in chunks(part, 1):
                rows, h = shingles(part.column(1).slice(a, b - a), width)
                start = np.searchsorted(rows, np.arange(b - a))
                for f in range(hashes):
                    key, lo, c, hi = windows(rows, h, f, room)
                    row = rows[c]
                    node, first = nodes[a:b][row], start[row]
                    values, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
                    hot = count > dense
                    deal = np.where(hot[inverse], 1 + (mix(node.view(np.uint64)) % np.uint64(251)).astype(np.int32), 0).astype(np.int32)
                    none = np.zeros(int(hot.sum()), np.int32)
                    columns = [(key, values[hot]), (node, none.astype(np.int64)), (lo - first, none - 1), (c - first, none - 1), (hi - first, none - 1), (deal, none)]
                    kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x.view(np.int64) if x.dtype == np.uint64 else x, y.view(np.int64) if y.dtype == np.uint64 else y]).astype(k)) for (x, y), k in zip(columns, kinds)], names=["key", "node", "l", "c", "r", "deal"])

    def propose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of windows of small groups (kind: the function), and each window of the others (kind -1)."""
        held = [[p.column(i).to_numpy() for i in range(6)] for p in parts]
        if not held:
            return
        key, node, lo, c, hi, deal = (np.concatenate(x) for x in zip(*held))
        del held
        order = np.lexsort((c, node, deal, key))
        key, node, lo, c, hi, deal = (x[order] for x in (key, node, lo, c, hi, deal))
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (c[1:] != c[:-1]) | (deal[1:] != deal[:-1])])[: len(key)]
        key, node, lo, c, hi, deal = (x[once] for x in (key, node, lo, c, hi, deal))
        told = c < 0
        n = sizes(key)
        alike = np.concatenate([[False], (key[1:] == key[:-1]) & (node[1:] == node[:-1])])[: len(key)]
        starts = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        texts = np.add.reduceat(~alike, np.flatnonzero(starts))[np.cumsum(starts) - 1] if len(key) else n
        hot = (deal > 0) | ((n > dense) & (texts > 1)) | np.isin(key, key[told])
        few = ~hot & (texts > 1)
        i, j = proposals(key[few], dense)
        of = [x[few] for x in (key, node, lo, c, hi)]
        apart = of[1][i] != of[1][j]  # what a text repeats by itself is no link
        i, j = i[apart], j[apart]
        hot &= ~told
        zero = np.zeros(int(hot.sum()), np.int32)
        pair = [of[1][i], of[1][j], (of[0][i] & 15).astype(np.int32), of[2][i], of[3][i], of[4][i], of[2][j], of[3][j], of[4][j]]
        alone = [node[hot], key[hot], zero - 1, zero, c[hot], zero, zero, zero, zero]
        for some in (pair, alone):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in some], names=["a", "b", "f", "la", "ca", "ra", "lb", "cb", "rb"])

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[p.column(i).to_numpy() for i in range(9)] for p in parts]
        if not held:
            return
        a, b, f, *w = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((w[1], b, a))
        a, b, f, *w = (x[order] for x in (a, b, f, *w))
        wa, wb = np.stack(w[:3], axis=1).astype(np.int64), np.stack(w[3:], axis=1).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
        out = []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if e - s >= enough:
                out += [(int(a[s]), int(b[s]), *r) for r in regions(f[s:e], wa[s:e], wb[s:e], room, enough)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names=["a", "b", "a0", "a1", "b0", "b1"])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles that are asked for."""
        for part in parts:
            for a, b in chunks(part, 1):
                rows, h = shingles(part.column(1).slice(a, b - a), width)
                h = (h >> np.uint64(33)).astype(np.int32)
                start = np.searchsorted(rows, np.arange(b - a + 1))
                asks = part.column(2).slice(a, b - a)
                owner = pc.list_parent_indices(asks).to_numpy()
                asks = asks.flatten()
                link, block_, side, lo, hi = (pc.struct_field(asks, x) for x in ("link", "part", "side", "lo", "hi"))
                node = part.column(0).slice(a, b - a).to_numpy()[owner]
                first = np.minimum(start[owner] + np.maximum(lo.to_numpy(), 0), start[owner + 1])
                n = np.maximum(np.minimum(start[owner] + hi.to_numpy() + 1, start[owner + 1]) - first, 0)
                for s in range(0, len(n), 4096):
                    e = min(s + 4096, len(n))
                    offsets = np.concatenate([[0], np.cumsum(n[s:e])])
                    values = h[np.repeat(first[s:e] - offsets[:-1], n[s:e]) + np.arange(offsets[-1])]
                    yield pa.RecordBatch.from_arrays([link[s:e], block_[s:e], side[s:e], pa.array(node[s:e]), lo[s:e], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["link", "part", "side", "node", "lo", "h"])

    def verify(node: list[int], lo: list[int], h: list[np.ndarray]) -> np.ndarray:
        """The links between the two sides of a proposed region."""
        (a, b), (la, lb) = node, (max(0, x) for x in lo)
        return np.array([(a, la + s, la + e + width, b, lb + s2, lb + e2 + width, 1, 1) for s, e, s2, e2 in stretches(*h, room, similarity)], np.int64).reshape(-1, 8)

    def settle(node: np.ndarray, lo: np.ndarray, h: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        """The links of a block."""
        of = np.full((len(node), wide), -1, np.int32)
        column = np.arange(len(h)) - np.repeat(np.cumsum(n) - n - np.maximum(0, -lo), n)
        of[np.repeat(np.arange(len(node)), n), column] = h
        order = np.lexsort((lo, node))
        of, node, lo = of[order], node[order], lo[order]
        found = settled(of, node, room, similarity)[0]
        if found:
            i, j, s, e, s2, e2 = (np.concatenate(x) for x in zip(*found))
            yield forest(np.stack([node[i], lo[i] + s, lo[i] + e + width, node[j], lo[j] + s2, lo[j] + e2 + width], axis=1))

    def linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by link, part and side: each group is verified or settled by itself."""

        def made(part: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, int]:
            """The links of the whole groups of `part`, and where the rest begins."""
            link, block_, node, lo = (part.column(i).to_numpy() for i in (0, 1, 3, 4))
            values, at = part.column(5).values.to_numpy(), part.column(5).offsets.to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (link[1:] != link[:-1]) | (block_[1:] != block_[:-1]), [last]]))
            pairs = pc.not_equal(part.column(2), "s").to_numpy(zero_copy_only=False)
            out = [np.zeros((0, 8), np.int64)]
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if not pairs[s]:
                    out += settle(node[s:e], lo[s:e], values[at[s] : at[e]], np.diff(at[s : e + 1]))
                elif e - s > 1:
                    ends = (s, e - 1)  # sides a and b
                    out.append(verify([int(node[k]) for k in ends], [int(lo[k]) for k in ends], [values[at[k] : at[k + 1]] for k in ends]))
            found = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found.T.copy()], names=["a", "sa", "ea", "b", "sb", "eb", "na", "nb"]), int(edge[-1])

        rest = None
        for part in parts:
            rest = pa.concat_batches([rest, part]) if rest is not None and rest.num_rows else part
            if rest.num_rows:
                found, edge = made(rest, False)
                rest = rest.slice(edge)
                yield found
        if rest is not None and rest.num_rows:
            yield made(rest, True)[0]

    span = "a long, sa long, ea long, b long, sb long, eb long, na long, nb long"
    found = base.select("node", "text").mapInArrow(make, "key long, node long, l int, c int, r int, deal int").repartition("key", "deal")
    proposed = Stage(found.mapInArrow(propose, "a long, b long, f int, la int, ca int, ra int, lb int, cb int, rb int"), "proposed")
    found = proposed.df
    released(docs.sparkSession)
    pairs = found.where("f >= 0").repartition("a", "b").mapInArrow(judge, "a long, b long, a0 long, a1 long, b0 long, b1 long")
    pairs = pairs.withColumn("link", F.xxhash64("a", "b", "a0", "a1", "b0", "b1"))
    side = lambda s: F.struct(F.col(s).alias("node"), F.struct("link", F.lit(s).alias("side"), F.col(f"{s}0").alias("lo"), F.col(f"{s}1").alias("hi"), F.lit(0).alias("part")).alias("ask"))
    asked = pairs.select(F.explode(F.array(side("a"), side("b"))).alias("x")).select("x.*")

    hot = found.where("f = -1").select(F.col("b").alias("key"), F.col("a").alias("node"), F.col("ca").alias("c")).distinct()
    n = hot.groupBy("key").agg(F.count("*").alias("n"))
    half = max(1, block // 2)
    parts = looked_up(hot, n.withColumn("parts", F.greatest(F.lit(2), F.ceil(F.col("n") / half)).cast("int")), "key", "n", hot.count())
    own = F.pmod(F.xxhash64("node", "c"), F.col("parts")).cast("int")
    # a window is in a block with each other part; two parts are one block
    meet = parts.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("parts") == 2, F.array(1 - F.col("own"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).where("own != other")
    ask = F.struct(F.col("key").alias("link"), F.lit("s").alias("side"), (F.col("c") - room + 1).cast("long").alias("lo"), (F.col("c") + room - 1).cast("long").alias("hi"), (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).cast("int").alias("part"))
    asks = Stage(asked.unionByName(meet.select("node", ask.alias("ask"))).groupBy("node").agg(F.collect_list("ask").alias("asks")), "asks")
    proposed.drop()
    stage, asks = asks, asks.df
    slots = slots_for(asks.count())
    filter_ = bloom(asks.select(F.col("node").alias("window")), slots)
    some = base.where(let(filter_, lambda f: contains(f, slots, F.col("node")))).select("node", "text")
    texts = some.groupBy("node").agg(F.first("text").alias("text")).join(asks, "node").select("node", "text", "asks")
    slices = texts.mapInArrow(cut, "link long, part int, side string, node long, lo long, h array<int>")
    links = staged(slices.repartition("link", "part").sortWithinPartitions("link", "part", "side").mapInArrow(linked, span), "links")
    stage.drop()
    released(docs.sparkSession)

    # passages of a text that overlap are one
    end = lambda x: F.struct(F.col(x).alias("node"), F.col(f"s{x}").alias("s"), F.col(f"e{x}").alias("e"), F.col(f"n{x}").alias("n"))
    ends = links.withColumn("link", F.xxhash64("a", "sa", "b", "sb")).select("link", F.explode(F.array(end("a"), end("b"))).alias("x")).select("link", "x.*")
    copies = base.select("node", "doc_id", n_words(F.col("text")).cast("long").alias("e")).groupBy("node").agg(F.countDistinct("doc_id").alias("n"), F.first("e").alias("e")).where("n > 1").select("node", "e").where(F.col("e") >= least)
    ends = ends.unionByName(copies.select(F.lit(None).cast("long").alias("link"), "node", F.lit(0).cast("long").alias("s"), "e", F.lit(0).cast("long").alias("n")))
    spans = ends.select("node", "s", "e").distinct()
    before = F.max("e").over(Window.partitionBy("node").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("s") >= before).cast("int"), F.lit(1)))
    spans = spans.withColumn("island", F.sum("new").over(Window.partitionBy("node").orderBy("s", "e")))
    stage = Stage(ends.join(spans.select("node", "s", "e", "island"), ["node", "s", "e"]).withColumn("passage", F.xxhash64("node", "island")), "spans")
    spans = stage.df
    edges = spans.where("link is not null").groupBy("link").agg(F.min("passage").alias("a"), F.max("passage").alias("b"))
    roots = components(edges)
    merged = spans.groupBy("passage", "node").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.sum("n").alias("n_links"))
    merged = merged.join(roots.withColumnRenamed("node", "passage"), "passage", "left").withColumn("root", F.coalesce("root", "passage"))
    owners = base.select("node", "doc_id").distinct()
    rows = staged(owners.join(merged, "node"), "passages")
    stage.drop()
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.join(ids, "root").select("doc_id", "start_word", "end_word", "class_id", "n_links")
