"""Finding what repeats across a corpus: the dataflow that substring and suffix-array dedup share.

Every window of the wanted length holds an anchor, its least-hashed gram, which depends on the window's content only;
so equal windows have equal anchors at equal offsets, and an anchor stands for all windows around it (its run).

1. Each run's anchor is a row of a few bytes. Anchors that occur once are done: nothing there repeats.
2. Runs with a repeated anchor go, with their bytes, to the task of their anchor, which compares them. Within a task
   of the scan, equal runs of 1 MB of text are reduced to the earliest one first, by their bytes. Anchors that are too
   frequent for one task are split: each of their windows is a row of its own, reduced within the whole task and dealt
   out by the window's hash.
3. The repeated stretches come back to their documents, which are cut and digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, chunks, inner_id, lean, outer_id, ship

#: Runs of one anchor that a single task compares at most.
HOT = 20_000
#: Rows that the comparing kernel takes at once, at least, and bytes of text that the scanning kernels take.
BLOCK, BYTES = 20_000, 1 << 20
#: Memory, about, in which a task of the scan remembers the runs that it has given.
SEEN_BYTES = 64 << 20
#: Stands among the anchors of an id that several rows have.
MANY = -1


@dataclass
class Runs:
    """Runs of some texts. anchor: hash, even. first: the first window's start; windows: how many; offset: from the
    first window's start to the anchor."""

    doc: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    offset: np.ndarray
    #: Bytes of elements a to b (past the last) of the text of run i.
    content: Callable[[int, int, int], bytes]
    #: Elements in one window.
    width: int


def anchor_id(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash, the lowest zero: it marks frequent anchors."""
    return (h >> np.uint64(16) & np.uint64(0xFFFFFFFFFFFE)).astype(np.int64)


#: meta holds, from the top, 32 bits of the first window's start, 8 of the windows, 8 of the offset.
# a span packs the first repeated window's start and 8 bits to the last one's
CONTEXT = "key long, k long, s long, meta long, tag binary, body binary"
_CONTEXT = pa.schema([("key", pa.int64()), ("k", pa.int64()), ("s", pa.int64()), ("meta", pa.int64()), ("tag", pa.binary()), ("body", pa.binary())])


class Seen:
    """Windows that a task has given to the comparison, with their places; forgotten beyond some bytes."""

    def __init__(self):
        self.place: dict[tuple, tuple[int, int]] = {}
        self.bytes = 0

    def repeats(self, key: tuple, place: tuple[int, int], across: bool) -> bool:
        """Whether an earlier run equals this one; if not, this one is remembered."""
        old = self.place.get(key)
        if old is not None and (old[0] < place[0] or (old < place and not across)):
            return True
        if old is None or place < old:
            if old is None:
                self.bytes += len(key[3]) + 300
                if self.bytes > SEEN_BYTES:
                    self.place.clear()
                    self.bytes = len(key[3]) + 300
            self.place[key] = place
        return False


def _contexts(runs: Runs, docs: pa.RecordBatch, tags: list[bytes | None], flags: list[np.ndarray | None], across: bool, seen: Seen) -> pa.RecordBatch:
    """The runs with a flagged anchor as rows; body is null where the whole run repeats an earlier one that this task has given."""
    best: dict[tuple, list] = {}
    rows: list[tuple] = []
    k = docs.column(0).to_numpy()
    cuts = np.searchsorted(runs.doc, np.arange(len(k) + 1))
    for d, flag in enumerate(flags):
        if flag is None or not len(flag):
            continue
        a, b = int(cuts[d]), int(cuts[d + 1])
        anchor = runs.anchor[a:b]
        at = np.minimum(np.searchsorted(flag & ~1, anchor), len(flag) - 1)
        for i in np.flatnonzero((flag[at] & ~1) == anchor).tolist():
            hot = flag[at[i]] & 1
            i += a
            first, windows, offset = int(runs.first[i]), int(runs.windows[i]), int(runs.offset[i])
            if hot:
                lots = [(w, 1, 0) for w in range(first, first + windows)]
            else:
                lots = [(first, windows, offset)]
            for start, n, off in lots:
                body = runs.content(i, start, start + n - 1 + runs.width)
                place = (int(k[d]), start)
                key = (0 if hot else int(runs.anchor[i]), n, off, body)
                row = [key, place, d, n, off, body]
                lead = best.setdefault(key, row)
                if lead is row:
                    continue
                if place < lead[1]:
                    best[key], row, lead = row, lead, row
                if row[1][0] > lead[1][0] or (row[1] > lead[1] and not across):
                    rows.append((0, row[1], row[2], row[3], row[4], None))
                else:  # not earlier: the same place, of a repeated row, or the same document
                    rows.append((row[0][0], row[1], row[2], row[3], row[4], row[5]))
    # windows of frequent anchors, which many documents share, are reduced within the task
    rows += [(0, *r[1:5], None) if not key[0] and seen.repeats(key, r[1], across) else (key[0], *r[1:]) for key, r in best.items()]
    if not rows:
        return pa.RecordBatch.from_pylist([], _CONTEXT)
    key = np.array([r[0] for r in rows], np.int64)
    for i in np.flatnonzero(key == 0).tolist():
        # windows by their content's hash; what is resolved goes anywhere
        key[i] = (hash_bytes(rows[i][5]) if rows[i][5] is not None else rows[i][1][1] * 2654435761 + rows[i][1][0]) & (1 << 62) - 1 | 1
    of = pa.array([r[2] for r in rows])
    meta = np.array([r[1][1] << 32 | r[3] << 24 | r[4] << 16 for r in rows], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), docs.column(0).take(of), docs.column(1).take(of), pa.array(meta), pa.array(tags, pa.binary()).take(of), pa.array([r[5] for r in rows], pa.binary())], schema=_CONTEXT)


def tag_of(text: bytes) -> bytes:
    """Tells rows of one id and different texts apart."""
    return hashlib.blake2b(text, digest_size=16).digest()


def hash_bytes(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")


def find_repeats(docs: DataFrame, id_col: str, text_col: str, runs_of: Callable[[list[bytes]], Runs], resolve: Callable, finish: Callable, result: str, across: bool) -> DataFrame:
    """The flow above.

    :param resolve: (rows as a dict of arrays, sorted by key) -> (row index, window start) arrays of repeated windows
    :param finish: (text, starts, stops of its repeated stretches in elements) -> result values
    :param result: the result columns after doc_id, as a schema
    :param across: only repeats between different ids count
    """
    ship(docs.sparkSession)
    id_, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # rows without an id are spread by their text
    texts = docs.select(inner_id(id_).alias("k"), F.when(id_.isNull(), F.xxhash64(text)).otherwise(0).alias("s"), text.alias("t"))
    # ids that several rows have: there a hash of the text tells whose a stretch is
    many = docs.select(id_.cast("long").alias("k")).filter("k is not null").groupBy("k").agg(F.count("*").alias("m")).filter("m > 1").select("k", F.lit(0).cast("long"), F.lit(MANY).cast("long"))

    def scan(column, batch):
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        for a, b in chunks(sizes, BYTES):
            part = batch.slice(a, b - a)
            yield part, runs_of(part.column(column).to_pylist())

    @lean
    def anchors(batches):
        for batch in batches:
            for part, runs in scan(2, batch):
                by = np.lexsort((runs.doc, runs.anchor))
                anchor, doc = runs.anchor[by], runs.doc[by]
                new = np.ones(len(by), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(by)))
                of = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), part.column(0).take(of), part.column(1).take(of), pa.array(n.astype(np.int32))], ["g", "k", "s", "n"])

    # scanned twice: once to count, once to tell the documents of what repeats
    grams = texts.mapInArrow(anchors, "g long, k long, s long, n int")
    # rows instead of distinct ids: an anchor of one repeated id alone is compared in vain
    counted = grams.groupBy("g").agg(F.sum("n").alias("n"), *([F.count("*").alias("rows")] if across else []))
    counted = counted.filter("rows > 1" if across else "n > 1").select("g", (F.col("n") > HOT).cast("long").alias("hot"))
    flagged = grams.select("g", "k", "s").join(counted, "g").select("k", "s", F.col("g").bitwiseOR(F.col("hot")).alias("g")).union(many)
    flagged = flagged.groupBy("k", "s").agg(F.array_sort(F.collect_list("g")).alias("flags"))

    @lean
    def contexts(batches):
        # rows come by id, as a rule: what a task has given before is earlier then
        seen = Seen()
        for batch in batches:
            for part, runs in scan(2, batch):
                own = part.column(0).to_pylist()
                flags = [np.array(x, np.int64) for x in part.column(3).to_pylist()]
                tags = [tag_of(t) if k == LAST or x[0] == MANY else None for k, t, x in zip(own, part.column(2).to_pylist(), flags, strict=True)]
                flags = [x[x != MANY] for x in flags]
                out = _contexts(runs, part, tags, flags, across, seen)
                if out.num_rows:
                    yield out

    rows = texts.join(flagged, ["k", "s"]).select("k", "s", "t", "flags").mapInArrow(contexts, CONTEXT)

    @lean
    def compare(batches):
        held, size = [], 0

        def spans(lot):
            t = pa.Table.from_batches(lot)
            body = t.column("body").to_pylist()
            meta = t.column("meta").to_numpy()
            x = {"key": t.column("key").to_numpy(), "k": t.column("k").to_numpy(), "first": meta >> 32, "windows": meta >> 24 & 255, "offset": meta >> 16 & 255}
            done = np.array([b is None for b in body], bool)
            at = np.flatnonzero(~done)
            row, start = resolve({c: v[at] for c, v in x.items()} | {"body": [body[i] for i in at.tolist()]}) if len(at) else (at, at)
            row = at[row]
            # consecutive repeated windows of a run are one stretch
            by = np.lexsort((start, row))
            row, start = row[by], start[by]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
            cut = np.flatnonzero(new)
            last = np.append(cut[1:], len(row)) - 1
            whole = np.flatnonzero(done)
            owner = np.concatenate([row[cut], whole])
            lo = np.concatenate([start[cut], x["first"][whole]]) if len(cut) else x["first"][whole]
            hi = np.concatenate([start[last], x["first"][whole] + x["windows"][whole] - 1]) if len(cut) else lo + x["windows"][whole] - 1
            whose = t.select(["k", "s", "tag"]).take(owner).combine_chunks().to_batches()
            if whose:
                yield pa.RecordBatch.from_arrays([*whose[0].columns, pa.array(lo << 8 | (hi - lo))], ["k", "s", "tag", "span"])

        for batch in batches:
            while batch.num_rows:
                key = batch.column(0).to_numpy()
                # a key's rows stay together
                cut = int(np.searchsorted(key, key[-1]))
                if held and size >= BLOCK and held[-1].column(0)[held[-1].num_rows - 1].as_py() != key[0]:
                    yield from spans(held)
                    held, size = [], 0
                if size + cut >= BLOCK and cut:
                    held.append(batch.slice(0, cut))
                    yield from spans(held)
                    held, size, batch = [], 0, batch.slice(cut)
                    continue
                held.append(batch)
                size += batch.num_rows
                break
        if size:
            yield from spans(held)

    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "k long, s long, tag binary, span long")
    # in one plan with the join above, so that the texts are shuffled by id once
    plain, marked = F.when(F.col("tag").isNull(), F.col("span")), F.when(F.col("tag").isNotNull(), F.struct("tag", "span"))
    found = found.groupBy("k", "s").agg(F.collect_list(plain).alias("spans"), F.collect_list(marked).alias("marked"))

    @lean
    def digest(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                values = []
                for t, spans, marked in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    spans = spans or []
                    if marked:
                        tag = tag_of(t)
                        spans = spans + [x["span"] for x in marked if x["tag"] == tag]
                    values.append(finish(t, *merged([(x >> 8, (x >> 8) + (x & 255)) for x in spans])))
                cols = list(zip(*values, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols)], ["k", *names])

    names = [x.split()[0] for x in result.split(", ")]
    out = texts.join(found, ["k", "s"], "left").select("k", "t", "spans", "marked").mapInArrow(digest, f"k long, {result}")
    return out.select(outer_id(F.col("k")).alias("doc_id"), *names)


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """(first, last) window starts, as sorted lists without those inside others."""
    lo, hi = [], []
    for a, b in sorted(spans):
        if hi and a <= hi[-1] + 1:
            hi[-1] = max(hi[-1], b)
        else:
            lo.append(a)
            hi.append(b)
    return lo, hi


def covered(lo: list[int], hi: list[int], width: int) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) of elements that the windows starting in [lo, hi] cover."""
    out: list[tuple[int, int]] = []
    for a, b in zip(lo, hi, strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + width))
        else:
            out.append((a, b + width))
    return out
