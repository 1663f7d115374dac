"""Benchmark decontamination by pigeonhole edit matching.

Each test item, normalised, is split into (error budget + 1) pieces. A text within the budget of the item holds at
least one piece unchanged, so exact piece hits, found for all items at once by an Aho-Corasick automaton, are the
only places to verify; Myers' bit-parallel distance does that on the stretch around the hit. Documents are only
scanned: nothing is shuffled.
"""

from __future__ import annotations

import uuid
from itertools import chain

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import chunks, lean, materialize, ship, table, unused

#: Edits allowed, as one in so many characters of the item.
ONE_ERROR_IN = 16
#: Bytes of items that are broadcast and compiled to one automaton, about; more take a scan of the documents for each part.
PART_BYTES = 4 << 20
LEAKS = ArrayType(StructType([StructField("item_id", LongType()), StructField("edits", IntegerType())]))


def normalise(text: str | None) -> str:
    """Lower case, with each stretch of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(item: str, one_in: int = ONE_ERROR_IN) -> int:
    return len(item) // one_in


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(place in the item, piece): errors + 1 of them, as even as possible, none empty."""
    n = min(errors + 1, len(item))
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def peq(item: str) -> dict[str, int]:
    """For each character the set of its places in the item, as bits."""
    bits: dict[str, int] = {}
    for i, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def best_match(bits: dict[str, int], m: int, text: str) -> int:
    """Least edit distance of the item of m characters to any stretch of text (Myers' recurrence)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        eq = bits.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | ~(d | plus) & full, plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        # a match may start anywhere: no bit enters `up` from below
        plus, minus = down | ~(x | up) & full, up & x
        if score < best:
            best = score
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], one_in: int = ONE_ERROR_IN):
        """items: (id, raw text); those without text after normalising match nothing."""
        self.automaton, self.items = ahocorasick.Automaton(), []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            if not (item := normalise(raw)):
                continue
            errors = budget(item, one_in)
            self.items.append((item_id, item, errors, peq(item)))
            for at, piece in pieces(item, errors):
                found.setdefault(piece, []).append((len(self.items) - 1, at))
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def matches(self, raw: str | None) -> list[tuple[int, int]]:
        """(item id, edits) of the items that the text holds within their budgets, ascending."""
        text = normalise(raw)
        if not self.any or not text:
            return []
        best: dict[int, int] = {}
        tried: dict[int, int] = {}
        for end, (length, places) in self.automaton.iter(text):
            for k, at in places:
                if best.get(k) == 0:
                    continue
                item_id, item, errors, bits = self.items[k]
                first = end + 1 - length - at  # where the item starts if nothing was inserted or deleted before
                if tried.get(k) == first:
                    continue  # another piece of the same stretch
                tried[k] = first
                window = text[max(0, first - errors) : first + len(item) + errors]
                d = 0 if window.find(item) >= 0 else best_match(bits, len(item), window)
                if d <= errors and d < best.get(k, errors + 1):
                    best[k] = d
        return sorted(((self.items[k][0], d) for k, d in best.items()), key=lambda x: (x[0] is None, x[0], x[1]))


def item_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_bytes: int = PART_BYTES):
    """Yields the test items in parts of about part_bytes of text, dealt out by hash; one part at a time is collected."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        yield [(r["i"], r["t"]) for r in mine.orderBy(F.col("i").asc_nulls_last(), "t").collect()]


#: The automaton of the part that this worker scans with, by its name; one at a time.
_MATCHER: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple[int, str]], one_in: int) -> Matcher:
    if name not in _MATCHER:
        _MATCHER.clear()
        _MATCHER[name] = Matcher(items, one_in)
    return _MATCHER[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", one_in: int = ONE_ERROR_IN, out_col: str = "leaks", carry: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns carry of docs (all by default) with out_col added: array of (item_id, edits), empty for clean documents and null texts.

    An item counts as leaked if some stretch of the document is within len(item) // one_in edits of it, both
    normalised. Repeated items are reported once each by their ids. Columns pass through; one of the name of
    out_col is replaced. A benchmark of more than part_bytes takes a pass over the documents for each part: they are
    written once, with row numbers, a pass writes only the rows that leak, and a join at the end brings these together.
    """
    ship(docs.sparkSession)
    keep = [c for c in (docs.columns if carry is None else carry) if c != out_col]
    text = unused([*keep, out_col], "__text")
    row = unused([*keep, out_col, text], "__row")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(text))
    parts = item_parts(benchmark, part_bytes=part_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _scan(source, first, one_in, text, out_col).drop(text)
    held = materialize(source.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for items in chain((first, second), parts):
        part = materialize(_scan(held.select(row, text), items, one_in, text, out_col).filter(F.size(out_col) > 0).drop(text))
        found = part if found is None else found.unionAll(part)
    ranked = F.transform(F.flatten(F.collect_list(out_col)), lambda x: F.struct(x["item_id"].isNull(), x["item_id"], x["edits"], x.alias("leak")))
    leaks = found.groupBy(row).agg(F.transform(F.sort_array(ranked), lambda x: x["leak"]).alias(out_col))
    return held.join(leaks, row, "left").select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{out_col}`"), F.array().cast(LEAKS)).alias(out_col))


def _scan(docs: DataFrame, items: list[tuple[int, str]], one_in: int, text: str, out_col: str) -> DataFrame:
    """docs with out_col added: these items' leaks."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items, one_in))
    names, at = [*docs.columns, out_col], docs.columns.index(text)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))

    @lean
    def scan(batches):
        matcher = _matcher(*shared.value)
        for batch in batches:
            for a, b in chunks(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
                part = batch.slice(a, b - a)
                leaks = [[{"item_id": i, "edits": d} for i, d in matcher.matches(t)] for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaks, kind)], names)

    # numbered names go in: names with dots can't
    return docs.toDF(*map(str, range(len(docs.columns)))).mapInArrow(scan, StructType([*docs.schema.fields, StructField(out_col, LEAKS)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"))
