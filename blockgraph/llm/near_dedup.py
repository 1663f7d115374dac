"""Near-duplicate detection by fast similarity sketches, banding and exact verification.

A document's set of word shingles is sketched by rounds of hashed bin placement: in each round every element falls
in one bin with a value, a bin keeps the least value of its first round, and after as many rounds as bins each
further round is for one bin alone, so that every coordinate fills. Bands of coordinates propose candidates; a
candidate's sketch must agree in far more coordinates than chance leaves possible for an unlinked pair to matter,
and every link is confirmed on the full sets, whose shingles are told apart by their words and not by hashes.

Documents of the same words, by 128 bits of blake2b, are one node. Within a band's bucket each node is first compared
with one centre only. Buckets that then hold several components have their common shingles counted as products of
incidence matrices, in blocks, and give a spanning forest of the links across components, so no group is expanded into
its pairs. Blocks of a bucket's largest component meet the other blocks only, never each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, chunks, drop, inner_id, lean, materialize, mix, outer_id, ship, table, unused

#: Bands of coordinates. A pair at the threshold of 0.8 shares none of 48 bands of 6 with probability 5e-7.
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Coordinates in which sketches must agree: 8.5 standard deviations below what a similarity of 0.8 gives.
AGREE = 174
#: Nodes, and shingles, of a bucket that make one block; a task compares two blocks at most.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes) -> bytes:
    """A text's words, lower-cased, with one space between them."""
    return b" ".join(text.translate(LOWER).split())


def shingles(texts: list[bytes], width: int, hashed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, bounds, hashes): text i, normal, has the distinct shingles at bounds[i]:bounds[i + 1], by ascending code.

    Codes are equal for equal words only, and compare within this call. Shingles are width words in a row; a text of
    fewer words has its whole sequence as one, with a code of its own; one without words has none.
    """
    words = Words(texts)
    total, n = len(words.id), np.diff(words.first)
    code = words.id.astype(np.int64)
    for k in range(1, width):
        pairs = code[: max(total - k, 0)] * max(len(words.distinct), 1) + words.id[k:]
        # numbered anew, so that codes stay below the number of words
        code = pa.array(pairs).dictionary_encode().indices.to_numpy().astype(np.int64)
    left = words.first[1:][words.doc] - np.arange(total)
    at = np.flatnonzero(left >= width)
    at = at[np.unique(words.doc[at] * (total + 1) + code[at], return_index=True)[1]]
    few = np.flatnonzero((n > 0) & (n < width))
    doc, code = np.concatenate([words.doc[at], few]), np.concatenate([code[at], total + few])
    by = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[by], np.arange(len(texts) + 1))
    hashes = np.zeros(0, np.uint64)
    if hashed:
        h = words.hash
        acc = np.zeros(total, np.uint64)
        for k in range(width):
            acc[: max(total - k, 0)] = mix(acc[: max(total - k, 0)] * _GOLD + h[k:] + np.uint64(k))
        rest = np.zeros(len(few), np.uint64)
        for j, i in enumerate(few.tolist()):
            for k in range(words.first[i], words.first[i + 1]):
                rest[j : j + 1] = mix(rest[j : j + 1] * _GOLD + h[k] + np.uint64(width))
        hashes = np.concatenate([acc[at], rest])[by]
    return code[by], bounds, hashes


def linked(texts: list[bytes], width: int, percent: int) -> np.ndarray:
    """For each pair of neighbours among the texts (0 and 1, 2 and 3, ...) whether their sets reach the similarity."""
    code, bounds, _ = shingles(texts, width)
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(texts)), n)
    key = of // 2 * (int(code.max(initial=0)) + 1) + code
    x, y = key[of % 2 == 0], key[of % 2 == 1]
    hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
    common = np.bincount(of[of % 2 == 0] // 2, hit, len(texts) // 2)
    return (common > 0) & (100 * common >= percent * (n[::2] + n[1::2] - common))


def sketches(sh: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of `bins` bytes for each set; rows of empty sets are zero."""
    count = len(bounds) - 1
    doc = np.repeat(np.arange(count), np.diff(bounds))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    values = np.full(count * bins, none)
    todo = np.flatnonzero(np.diff(bounds) > 0)
    element, of = sh, doc
    for r in range(2 * bins):
        if not len(todo):
            break
        h = mix(element + np.uint64((r + 1) * int(_GOLD) & (1 << 64) - 1))
        if r < bins:
            at = of * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            at = of * bins + (r - bins)
        h = h & np.uint64(0xFFFFFFFF)
        free = values[at] == none
        at, h = at[free], h[free]
        # rounds come in order: what a bin got before stands
        got = np.full(count * bins, none) if len(at) * 4 > count * bins else None
        if got is not None:
            np.minimum.at(got, at, h)
            filled = np.flatnonzero(got != none)
            values[filled] = got[filled] | np.uint64(r) << np.uint64(32)
        elif len(at):
            by = np.lexsort((h, at))
            at, h = at[by], h[by]
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1]
            values[at[first]] = h[first] | np.uint64(r) << np.uint64(32)
        open_ = (values.reshape(count, bins)[todo] == none).any(axis=1)
        if not open_.all():
            todo = todo[open_]
            stay = np.zeros(count, bool)
            stay[todo] = True
            keep = stay[of]
            element, of = element[keep], of[keep]
    out = (mix(values) >> np.uint64(56)).astype(np.uint8).reshape(count, bins)
    out[np.diff(bounds) == 0] = 0
    return out


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(k, v, w, n, sk), v and w being 128 bits of hash of the words, and the columns of docs (k, t, ...) past the second, which are longs."""
    more = docs.columns[2:]

    @lean
    def run(batches):
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column(1)).to_pylist()):
                part = batch.slice(a, b - a)
                texts = [normal(t) for t in part.column(1).to_pylist()]
                _, bounds, hashes = shingles(texts, width, hashed=True)
                sk = sketches(hashes, bounds)
                vw = _digests(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vw[:, 0]), pa.array(vw[:, 1]), pa.array(np.diff(bounds)), pa.array([x.tobytes() for x in sk], pa.binary()), *part.columns[2:]], ["k", "v", "w", "n", "sk", *more])

    return docs.mapInArrow(run, ", ".join(["k long, v long, w long, n long, sk binary", *[f"{c} long" for c in more]]))


def _digests(texts: list[bytes]) -> np.ndarray:
    """128 bits of hash of each text, as two numbers."""
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2).copy()


def _numbered(signed: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """signed with v equal for equal 128-bit hashes (v, w) only; the nodes (v, k, n, sk), k being the least id; what
    _renamed needs to give other tables the same v.

    Where two hashes share v, as happens by chance among some 1e9 nodes, another number takes its place.
    """
    twice: list[DataFrame] = []
    while True:
        now = _renamed(signed, twice)
        nodes = materialize(now.filter("n > 0").groupBy("v").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("sk").alias("sk"), F.min("w").alias("lo"), F.max("w").alias("hi")))
        again = nodes.filter("lo <> hi").select("v", F.lit(True).alias("twice"))
        if not again.take(1):
            out = nodes.drop("lo", "hi")
            out._scratch = nodes._scratch
            return now, out, twice
        twice.append(again)


def _renamed(df: DataFrame, twice: list[DataFrame]) -> DataFrame:
    for salt, shared in enumerate(twice):
        df = df.join(shared, "v", "left").withColumn("v", F.when(F.col("twice"), F.xxhash64("v", "w", F.lit(salt))).otherwise(F.col("v"))).drop("twice")
    return df


def _words_of(docs: DataFrame) -> DataFrame:
    """(v, w, t): the 128-bit hash of the words, and the words, of docs (k, t)."""

    @lean
    def run(batches):
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column(1)).to_pylist()):
                texts = [normal(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                vw = _digests(texts)
                yield pa.RecordBatch.from_arrays([pa.array(vw[:, 0]), pa.array(vw[:, 1]), pa.array(texts, pa.binary())], ["v", "w", "t"])

    return docs.select("k", "t").mapInArrow(run, "v long, w long, t binary")


def _banded(nodes: DataFrame) -> DataFrame:
    """(b, v, n): a row for each node and band, b naming the bucket."""

    @lean
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sk = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
                key = np.zeros(sk.shape[:2], np.uint64)
                for r in range(ROWS):
                    key = key << np.uint64(8) | sk[:, :, r]
                key = mix(key ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(50)))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.repeat(batch.column(2).to_numpy(), BANDS))], ["b", "v", "n"])

    return nodes.select("v", "sk", "n").mapInArrow(run, "b long, v long, n long")


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose sketches agree well enough, with agree."""
    side = lambda c: nodes.select(F.col("v").alias(c), F.col("n").alias(f"n{c}"), F.col("sk").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    least = _least_agree(percent)

    @lean
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in (2, 3))
                same = (x == y).sum(axis=1)
                ok = same >= least
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(same[ok].astype(np.int32))], ["a", "b", "agree"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, agree int")


def _least_agree(percent: int) -> int:
    """Coordinates that agree at that similarity, less 8.5 standard deviations; AGREE at 80."""
    p = percent / 100
    return max(0, int(BINS * p - 8.5 * (BINS * p * (1 - p)) ** 0.5))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets of the words (v, t)."""
    both = pairs.join(sets.select(F.col("v").alias("a"), F.col("t").alias("x")), "a").join(sets.select(F.col("v").alias("b"), F.col("t").alias("y")), "b")

    @lean
    def run(batches):
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_pylist()
            for a, b in chunks(sizes):
                part = batch.slice(a, b - a)
                both = [t for two in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True) for t in two]
                keep = pa.array(linked(both, width, percent))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the least node reachable from each node of the edges (a, b), by alternating large and small stars."""
    links = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct())
    while True:
        # large star: larger neighbours, and the node, to the least neighbour
        both = links.union(links.select("hi", "lo")).toDF("u", "w")
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("w > u").select(F.col("m").alias("lo"), F.col("w").alias("hi")).distinct()
        large = materialize(large)
        # small star: smaller neighbours, and the node itself, to the least of them
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("m").alias("lo"), F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"))
        small = materialize(small.union(down.select("m", "hi")).filter("lo <> hi").distinct())
        # done when nothing changes
        same = small.count() == links.count() and not small.join(links, ["lo", "hi"], "left_anti").take(1)
        drop(links, large)
        links = small
        if same:
            break
    return links.select(F.col("hi").alias("v"), F.col("lo").alias("c")).union(links.select("lo", "lo").distinct())


def _linked(v: np.ndarray, c: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (v, v) that join the components c of one bucket's nodes: a spanning forest of the links across them.

    The common shingles of all nodes are counted at once, as products of incidence matrices, a few thousand columns
    at a time; only shingles that several nodes have get a column.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    row = np.repeat(np.arange(len(sets)), n)
    shingle, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(shingle), -1)
    place[shared] = np.arange(len(shared))
    col = place[col]
    row, col = row[col >= 0], col[col >= 0]
    common = np.zeros((len(sets), len(sets)), np.int64)
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    for at in range(0, len(shared), 4096):
        a, b = np.searchsorted(col, (at, at + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        common += (m @ m.T).astype(np.int64)
    link = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (c[:, None] != c[None, :])
    root = {x: x for x in c.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
        x, y = find(int(c[i])), find(int(c[j]))
        if x != y:
            root[x] = y
            out.append((int(v[i]), int(v[j])))
    return out


def _across(buckets: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs of nodes that share a bucket and link different components, exactly.

    Of links that join the same components in a bucket one is given. A large bucket is dealt out to tasks of two
    blocks each; blocks of its largest component are compared with those of the rest only.
    """
    tagged = buckets.join(comp, "v", "left").withColumn("c", F.coalesce("c", "v"))
    parts = tagged.groupBy("b", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    whole = parts.groupBy("b").agg(F.max(F.struct("m", "n", "c")).alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda m, n: F.ceil(F.greatest(m / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    one = blocks(F.col("m"), F.col("n")) == 1
    mixed = whole.select(
        "b", F.when(~one, F.col("top.c")).alias("top"), F.when(one, 0).otherwise(blocks(F.col("top.m"), F.col("top.n"))).alias("tops"),
        F.when(one, 1).otherwise(blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n"))).alias("rests"),
    )
    rows = tagged.join(mixed, "b").withColumn("of_top", F.coalesce(F.col("c") == F.col("top"), F.lit(False)))
    # blocks 0 to rests - 1 are the rest's, those from rests on the largest component's
    spot = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("of_top"), F.col("rests") + spot(F.col("tops"))).otherwise(spot(F.col("rests"))))
    # a row goes to each task that its block takes part in: one, unless the bucket is very large
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("of_top"), F.col("rests")).otherwise(F.col("rests") + F.col("tops")) - 1)))
    rows = rows.withColumn("task", F.xxhash64("b", F.least("mine", "other"), F.greatest("mine", "other")))
    rows = rows.select("task", "v", "c").join(sets.select("v", "t"), "v").select("task", "v", "c", "t")

    @lean
    def run(batches):
        held: list = []

        def flush():
            t = pa.Table.from_batches(held)
            task, v, c = (t.column(x).to_numpy() for x in ("task", "v", "c"))
            texts = t.column("t").to_pylist()
            cuts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            found = []
            for a, b in zip(cuts, np.append(cuts[1:], len(task)), strict=True):
                code, bounds, _ = shingles(texts[a:b], width)
                found += _linked(v[a:b], c[a:b], [code[i:j] for i, j in zip(bounds, bounds[1:], strict=False)], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # a task's rows may continue in the next batch
            last = batch.column(0)[batch.num_rows - 1].as_py()
            task = batch.column(0).to_numpy()
            cut = int(np.searchsorted(task, last))
            if cut or (held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != last):
                held.append(batch.slice(0, cut))
                if sum(h.num_rows for h in held):
                    yield from flush()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush()

    near = rows.repartition("task").sortWithinPartitions("task", "v").mapInArrow(run, "a long, b long")
    return near.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the least
    id reachable over links, and kept says that it is the document's own. Documents without words, null texts among
    them, have empty sets and are linked with nothing. Rows that repeat an id share its place: each of them is kept
    if that id is the least. A null id sorts last.
    """
    out, _ = _labelled(docs, id_col, text_col, width, percent)
    return out.select(outer_id(F.col("k")).alias("doc_id"), F.col("n").alias("n_shingles"), outer_id(F.col("first")).alias("component_id"), (F.col("k") == F.col("first")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, of those linked as in near_duplicates exactly one: the least by id (null last), then by hash.

    Rows are told apart by id and 128 bits of hash of their columns, so neither null nor repeated ids matter; of rows
    that are equal throughout one stays as well. Rows with empty sets all stay.
    """
    names = docs.columns
    k, h, r = key = [unused(names, x) for x in ("__k", "__h", "__r")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # maps have no hash
    others = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumns({k: inner_id(F.col(id_col)), h: F.xxhash64(text), r: F.xxhash64(*others, F.lit(0), text)})
    labelled, read = _labelled(keyed, id_col, text_col, width, percent, {"h": h, "r": r})
    each = materialize(labelled.filter("n > 0").groupBy("c", "k", "h", "r").agg(F.count("*").alias("m")))
    drop(*read)
    best = each.groupBy("c").agg(F.min(F.struct("k", "h", "r")).alias("best"))
    rows = each.join(best, "c").withColumn("stays", F.struct("k", "h", "r") == F.col("best"))
    rows = materialize(rows.filter("not stays or m > 1").select(F.col("k").alias(k), F.col("h").alias(h), F.col("r").alias(r), "stays"))
    drop(each)
    twins = rows.filter("stays").select(*key)
    if not twins.take(1):
        return keyed.join(rows.select(*key), key, "left_anti").select(*names)
    # of equal rows that stay, one: all leave, and one of each returns
    single = keyed.join(twins, key, "left_semi").dropDuplicates(key)
    return keyed.join(rows.select(*key), key, "left_anti").unionByName(single).select(*names)


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, more: dict[str, str] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(k, v, n, c, first) and more, columns of docs by new name, for each row: its id, set, component and that one's least id;
    and the tables that this reads."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(inner_id(F.col(id_col)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"), *[F.col(c).alias(n) for n, c in (more or {}).items()])
    sketched = materialize(_signatures(texts, width))
    signed, nodes, twice = _numbered(sketched)
    banded = materialize(_banded(nodes))
    centres = banded.groupBy("b").agg(F.min("v").alias("a"), F.count("*").alias("m")).filter("m > 1").select("b", "a")
    buckets = materialize(banded.join(centres, "b"))
    stars = materialize(_alike(buckets.filter("a <> v").select("a", F.col("v").alias("b")).distinct(), nodes, percent))
    shared = materialize(buckets.select("v").distinct())
    # a node's words are read from a document of its least id; others of that id may have other words
    mine = nodes.join(shared, "v", "left_semi").select("k").distinct()
    sets = _renamed(_words_of(texts.join(mine, "k", "left_semi")), twice)
    sets = materialize(sets.join(shared, "v", "left_semi").select("v", "t").dropDuplicates(["v"]))
    # each node first tries the centre that it resembles most
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b")
    links = materialize(_confirmed(best, sets, percent, width))
    comp = materialize(components(links))
    further = materialize(_across(buckets.select("b", "v", "n"), comp, sets, percent, width))
    drop(comp, banded, stars, shared)
    comp = materialize(components(links.union(further)))
    label = nodes.select("v", "k").join(comp, "v", "left").withColumn("c", F.coalesce("c", "v"))
    label = materialize(label.join(label.groupBy("c").agg(F.min("k").alias("first")), "c").select("v", "c", "first"))
    drop(buckets, sets, comp, links, further, nodes)
    out = signed.drop("sk", "w").join(label, "v", "left").withColumn("first", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("k")))
    return out, [sketched, label]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


#: All pairs that share a shingle, then reachability; for small tables.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.other),
c AS (SELECT doc_id, min(other) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(coalesce(c.c, w.doc_id), w.doc_id)::BIGINT AS component_id, least(coalesce(c.c, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
