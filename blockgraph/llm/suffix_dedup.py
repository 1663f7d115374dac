"""Suffix-array dedup: bytes that lie in a 100-byte string which starts earlier in the corpus are removed.

Runs that share an anchor (see repeats.py) are compared by a suffix sort: the suffixes that start at the anchors, and
the reversed prefixes that end there, are ordered by a mergesort whose comparison finds the common extension of two
suffixes by binary search over prefix polynomial hashes, so in a logarithmic number of steps. Neighbours in both
orders with long enough common extensions hold the same windows. Common extensions are verified on the bytes, and a
block in which a hash collides is sorted by its bytes instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import Prefix, mix, table
from .repeats import Runs, anchor_id, covered, find_repeats

#: Bytes of a window, and of the gram whose hash anchors it.
WIDTH, GRAM = 100, 16


def runs_of(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> Runs:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    joined = b"".join(texts)
    none = np.zeros(0, np.int64)
    if len(joined) < width:
        return Runs(none, none, none, none, none, lambda i, a, b: b"", width)
    buf = np.frombuffer(joined, np.uint8)
    prefix = Prefix(buf)
    at = np.arange(len(buf) - gram + 1)
    h = mix((prefix.sums[gram:] - prefix.sums[:-gram]) * prefix.down[: len(at)])
    low = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    low = _sliding_min(low, width - gram + 1)
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - width + 1, 0))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(sizes - width + 1, 0)) - np.maximum(sizes - width + 1, 0), np.maximum(sizes - width + 1, 0)) + (ends - sizes)[doc]
    q = anchor[start]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(new)
    doc, begin = doc[cut], (ends - sizes)[doc[cut]]
    first, q = start[cut], q[cut]
    return Runs(doc, anchor_id(h[q]), first - begin, np.diff(np.append(cut, len(start))), q - first, lambda i, a, b: joined[begin[i] + a : begin[i] + b], width)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:n], x[rest : rest + n]) if rest else x[:n]


class Suffixes:
    """Suffixes buf[start:stop], compared by hash."""

    def __init__(self, buf: bytes, start: np.ndarray, stop: np.ndarray):
        self.buf, self.start, self.size = buf, start, stop - start
        self.raw = np.frombuffer(buf + b"\0", np.uint8)
        self.prefix = Prefix(self.raw)
        self.steps = [1 << k for k in range(int(self.size.max(initial=1)).bit_length() - 1, -1, -1)]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y: binary search over hashes of equal lengths."""
        a, b, most = self.start[x], self.start[y], np.minimum(self.size[x], self.size[y])
        sums, down = self.prefix.sums, self.prefix.down
        length = np.zeros(len(x), np.int64)
        for step in self.steps:
            more = length + step
            ok = np.flatnonzero(more <= most)
            i, j, n = a[ok], b[ok], more[ok]
            same = (sums[i + n] - sums[i]) * down[i] == (sums[j + n] - sums[j]) * down[j]
            length[ok[same]] += step
        return length

    def less(self, x: np.ndarray, y: np.ndarray, equal: bool) -> np.ndarray:
        """x before y, or equal to it if that counts."""
        n = self.extension(x, y)
        endx, endy = n == self.size[x], n == self.size[y]
        by_byte = self.raw[np.minimum(self.start[x] + n, len(self.raw) - 1)] < self.raw[np.minimum(self.start[y] + n, len(self.raw) - 1)]
        return np.where(endx, ~endy | equal, ~endy & by_byte)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common extension with the one before; -1 at the first of a group). group is ascending."""
        n = len(group)
        order = np.arange(n)
        first = np.searchsorted(group, group)
        place = np.arange(n) - first
        size = np.searchsorted(group, group, "right") - first
        width = 1
        while width < size.max(initial=0):
            # bottom-up mergesort of all groups at once: each one's rank in the neighbouring run, by binary search
            run = place // width
            mate = first + (run ^ 1) * width
            lo = np.minimum(mate, first + size)
            hi = np.minimum(mate + width, first + size)
            left = run % 2 == 0
            base = lo.copy()
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) // 2
                ahead = np.empty(len(live), bool)
                for side in (True, False):
                    s = left[live] == side
                    # those of the left run come first among equals
                    ahead[s] = self.less(order[mid[s]], order[live[s]], equal=not side)
                lo[live[ahead]] = mid[ahead] + 1
                hi[live[~ahead]] = mid[~ahead]
                live = live[lo[live] < hi[live]]
            to = first + (run // 2) * 2 * width + place % width + (lo - base)
            new = np.empty_like(order)
            new[to] = order
            order = new
            width *= 2
        shared = np.full(n, -1)
        inner = np.flatnonzero(place > 0)
        shared[inner] = self.extension(order[inner - 1], order[inner])
        # verification on the bytes: equal up to there, different or at an end after it
        for i in inner.tolist():
            x, y, m = order[i - 1], order[i], shared[i]
            a, b = self.start[x], self.start[y]
            if self.buf[a : a + m] != self.buf[b : b + m] or (m < self.size[x] and m < self.size[y] and self.raw[a + m] >= self.raw[b + m]):
                return self.plain(group)
        return order, shared

    def plain(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by the bytes alone."""
        import os

        text = [self.buf[s : s + n] for s, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]
        order = sorted(range(len(text)), key=lambda i: (group[i], text[i]))
        shared = [-1 if not k or group[i] != group[order[k - 1]] else len(os.path.commonprefix([text[order[k - 1]], text[i]])) for k, i in enumerate(order)]
        return np.array(order, np.int64), np.array(shared, np.int64)


def resolve(rows: dict, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, window start) of each window that also starts earlier, among rows sorted by key."""
    key, k, first, windows, offset, body = (rows[c] for c in ("key", "k", "first", "windows", "offset", "body"))
    # earliest first within a key, so that a stable sort keeps that order
    by = np.lexsort((first + offset, k, key))
    key, k, first, windows, offset = key[by], k[by], first[by], windows[by], offset[by]
    body = [body[i] for i in by.tolist()]
    out_row, out_start = [], []
    # equal runs: all but the earliest repeat as a whole
    seen: dict[tuple, int] = {}
    keep = []
    for i, x in enumerate(zip(key.tolist(), windows.tolist(), offset.tolist(), body, strict=True)):
        j = seen.setdefault(x, i)
        if j == i or (k[j], first[j]) == (k[i], first[i]):
            keep.append(i)
        else:
            out_row.append(np.full(windows[i], i))
            out_start.append(np.arange(first[i], first[i] + windows[i]))
    keep = np.array(keep, np.int64)
    many = np.flatnonzero(np.searchsorted(key[keep], key[keep], "right") - np.searchsorted(key[keep], key[keep]) > 1)
    keep = keep[many]
    if len(keep):
        # place of a window among those of its class: ties are the same place
        kk, place = k[keep], (first + offset)[keep]
        new = np.ones(len(keep), bool)
        new[1:] = (key[keep][1:] != key[keep][:-1]) | (kk[1:] != kk[:-1]) | (place[1:] != place[:-1])
        rank = np.cumsum(new)
        text = [body[i] for i in keep.tolist()]
        size = np.fromiter(map(len, text), np.int64, len(text))
        ends = np.cumsum(size)
        off, wins = offset[keep].astype(np.int64), windows[keep].astype(np.int64)
        group = np.cumsum(np.append(0, np.diff(key[keep]) != 0))
        right, r_lcp = Suffixes(b"".join(text), ends - size + off, ends).sort(group)
        left, l_lcp = Suffixes(b"".join(t[o - 1 :: -1] + t[: o - 1 : -1] if o else t for t, o in zip(text, off.tolist(), strict=True)), ends - size, ends - size + off).sort(group)
        for o in range(int((off - wins + 1).min()), int(off.max()) + 1):
            own = np.flatnonzero((off - wins + 1 <= o) & (o <= off))
            if len(own) < 2:
                continue
            rc, lc = np.empty(len(keep), np.int64), np.empty(len(keep), np.int64)
            rc[right] = np.cumsum(r_lcp < width - o)
            lc[left] = np.cumsum(l_lcp < o)
            cls = rc[own] * (len(keep) + 1) + lc[own]
            s = np.argsort(cls, kind="stable")
            cls, who = cls[s], own[s]
            head = np.ones(len(s), bool)
            head[1:] = cls[1:] != cls[:-1]
            earliest = rank[who[np.flatnonzero(head)]][np.cumsum(head) - 1]
            again = who[rank[who] > earliest]
            out_row.append(keep[again])
            out_start.append(place[again] - o)
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return by[np.concatenate(out_row)], np.concatenate(out_start).astype(np.int64)


def finish(text: bytes, lo: list[int], hi: list[int]) -> tuple:
    spans = covered(lo, hi, WIDTH)
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row.

    A byte is removed if it lies in a 100-byte string of its document's UTF-8 bytes that also starts in a document
    of a smaller id, or earlier in the same one; strings are judged on the input. Texts under 100 bytes, null and
    empty ones among them, stay whole. Rows that repeat an id count as the same document. A null id sorts last.
    """
    return find_repeats(docs, id_col, text_col, runs_of, resolve, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", across=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
