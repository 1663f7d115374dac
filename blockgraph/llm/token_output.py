"""Token ids in a binary file format, in ascending id order of the documents.

Format: ids are replaced by their rank in the corpus' frequency order and packed byte-aligned with separate control
bytes: two control bits give a value's length of 1 to 4 bytes, four values share a control byte. A file row is one
shard: the documents' ids and lengths, the control bytes and the data bytes. The header table holds the id of each
rank. Decoding looks up each control byte's four lengths in a table, so it is a few numpy gathers.

The rows are stored by Spark's Parquet writer, so that any shared store and its commit protocol serve.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, drop, inner_id, lean, materialize, outer_id, partitions, scratch, ship, stretches, table

END = 0
#: Values in one file row, at most, but for a longer document.
SHARD = 1 << 20
#: Bytes of text that are split and told apart at once, and letters that the model takes in one call, about.
AT_ONCE, PIECE = 2 << 20, 512
#: Entries of a task's cache of encoded stretches, about 200 bytes each, and characters of the longest of them.
CACHE, CACHED_LENGTH = 500_000, 40


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ packing

#: Lengths of the four values that a control byte describes, and their sum.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= n[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again. :raises ValueError: if the streams don't fit count."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    if len(lengths) != count or (ends[-1] if count else 0) != len(data):
        raise ValueError("control and data bytes don't fit")
    raw = np.zeros(len(data) + 4, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    first = ends - lengths
    out = raw[first].astype(np.uint32)
    for k in range(1, 4):
        more = lengths > k
        if more.any():
            out[more] |= raw[first[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# ------------------------------------------------------------------ encoding


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point for the byte-level splitting pattern: 0 other, 1 letter, 2 number, 3 white space."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = 1 + (kind == "N")
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts as 16-bit values; the vocabulary must fit in those.

    Texts are split by numpy where the tokenizer's pattern splits them; Arrow's dictionary tells the distinct stretches
    of a chunk, and the library's model encodes those that the cache, keyed by the stretches themselves, lacks, many in
    one call with the byte 255 after each: no UTF-8 text has it and no token but its own, so no merge goes across. Texts
    that could split otherwise (an apostrophe before a letter, a special token's string) go to the library whole.
    """

    def __init__(self, path: str):
        # one task is one core's work
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        if self.lib.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary doesn't fit in 16 bits")
        model = self.lib.model
        model._resize_cache(0)  # ours serves
        # by itself: stretches are split already
        self.model = Tokenizer(model)
        specials = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["'[sStTmMrRvVlLdD]", *specials]))
        self.kind, self.letters = char_classes(), np.array([ord(c) for _, c in sorted(byte_letters().items())], "<u4")
        between = byte_letters()[255]
        self.between = self.lib.token_to_id(between)
        if [t for t in self.lib.get_vocab(with_added_tokens=False) if between in t] != [between]:
            raise ValueError("the vocabulary has other tokens with the byte 255 than that byte's own")
        self.cache: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def merge(self, words: list[str]) -> list[bytes]:
        """The 16-bit ids of stretches by the model, without the cache."""
        raw = np.frombuffer(b"\xff".join([*(w.encode() for w in words), b""]), np.uint8)
        letters = self.letters[raw].tobytes().decode("utf-32-le")
        # pieces of whole stretches
        stops = np.flatnonzero(raw == 255) + 1
        cuts = np.unique(stops[np.searchsorted(stops, np.append(np.arange(PIECE, len(raw), PIECE), len(raw)))]).tolist()
        ids = np.concatenate([np.array(self.model.encode_batch_fast([letters[a:b]], add_special_tokens=False)[0].ids, "<u2") for a, b in zip([0, *cuts], cuts, strict=False)])
        ends = np.flatnonzero(ids == self.between).tolist()
        data = ids.tobytes()
        return [data[2 * a : 2 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]

    def encode_stretches(self, words: list[str]) -> list[bytes]:
        """The 16-bit ids of distinct stretches."""
        out = list(map(self.cache.get, words))
        fresh = [i for i, x in enumerate(out) if x is None]
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
        if fresh:
            for i, ids in zip(fresh, self.merge([words[i] for i in fresh]), strict=True):
                out[i] = ids
                if len(words[i]) <= CACHED_LENGTH and len(self.cache) < CACHE:
                    self.cache[words[i]] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if self.odd.search(t)]
        rest = dict(zip(odd, self.whole([texts[i] for i in odd]), strict=True)) if odd else {}
        plain = [t if i not in rest else "" for i, t in enumerate(texts)]
        joined = "".join(plain)
        ends = np.cumsum([len(t) for t in plain])
        n = len(joined)
        if not n:
            return [rest.get(i, np.zeros(0, np.uint16)) for i in range(len(texts))]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        newdoc = np.zeros(n + 1, bool)
        newdoc[0] = True
        newdoc[ends] = True
        gap = kind == 3
        start = newdoc[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # the last white space before something else stands apart, and a space joins what follows it
        start[:-1] |= gap[:-1] & ~gap[1:] & ~newdoc[1:n]
        start[1:] &= ~((points[:-1] == 32) & ~gap[1:] & ~newdoc[1:n])
        at = np.flatnonzero(start)
        raw = np.frombuffer(joined.encode(), np.uint8)
        sizes = np.diff(np.append(at, n))
        if len(raw) > n:
            sizes = np.add.reduceat(np.uint8(1) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), at, dtype=np.int64)
        coded = stretches(raw, sizes, pa.string()).dictionary_encode()
        each, where = self.encode_stretches(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        size = np.fromiter(map(len, each), np.int64, len(each)) // 2
        pool, first = np.frombuffer(b"".join(each), np.uint16), np.cumsum(size) - size
        size, first = size[where], first[where]
        upto = np.cumsum(size)
        ids = pool[np.repeat(first - upto + size, size) + np.arange(upto[-1])]
        # ids before each text's end
        cuts = np.append(0, upto)[np.searchsorted(at, ends, "left")]
        out = np.split(ids, cuts[:-1])
        return [rest.get(i, out[i]) for i in range(len(texts))]


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker's encoder, for all its tasks: reading the vocabulary takes as long as encoding half a megabyte."""
    return Encoder(path)


def encode_documents(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(k, n, ids): inner id, number of ids with the end id, ids as 16-bit values."""
    ship(docs.sparkSession)
    base = docs.select(inner_id(F.col(id_col)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    end = np.array([END], "<u2").tobytes()

    @lean
    def run(batches):
        one = encoder(path)
        one.cache.clear()
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column(1)).to_pylist(), AT_ONCE):
                part = batch.slice(a, b - a)
                ids = [x.astype("<u2").tobytes() + end for x in one.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["k", "n", "ids"])
        one.cache.clear()

    return base.mapInArrow(run, "k long, n long, ids binary")


def frequency_order(encoded: DataFrame) -> np.ndarray:
    """All ids, the most frequent first (ties: smaller id first). One count for each id of the vocabulary is collected."""

    @lean
    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            x = batch.column(0).cast(pa.binary())
            if batch.num_rows:
                a, b = np.frombuffer(x.buffers()[1], np.int32)[[x.offset, x.offset + len(x)]].tolist()
                ids = np.frombuffer(x.buffers()[2], "<u2", (b - a) // 2, a)
                # its counting takes 8 bytes a value
                for at in range(0, len(ids), SHARD):
                    total += np.bincount(ids[at : at + SHARD], minlength=1 << 16)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(total[i], pa.int64())], ["i", "c"])

    rows = encoded.select("ids").mapInArrow(count, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for i, c in rows:
        counts[i] = c
    return np.lexsort((np.arange(1 << 16), -counts)).astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Encode all documents and write them in the file format at path/shards and path/header.

    Documents of one id, null ids among them, stand together in the order of their ids' hash; null and empty texts are
    the end id alone. An empty table gives no shards. Each task writes its range of ids in order; shards are numbered by
    (part, seq), and start counts the ids before a shard within its part.
    """
    spark = docs.sparkSession
    encoded = materialize(encode_documents(docs, id_col, text_col, tokenizer or tokenizer_path()))
    order = frequency_order(encoded)
    rank = np.empty(1 << 16, np.uint32)
    rank[order] = np.arange(1 << 16, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    @lean
    def shards(batches):
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ks, ns, ids, size = [], [], [], 0

        def row():
            control, data = pack(shared.value[np.concatenate(ids)])
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "start": start, "docs": np.array(ks, "<i8").tobytes(), "lengths": np.array(ns, "<i8").tobytes(), "count": size, "control": control, "data": data}], schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("count", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            for k, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size and size + n > SHARD:
                    yield row()
                    seq, start, ks, ns, ids, size = seq + 1, start + size, [], [], [], 0
                ks.append(k)
                ns.append(n)
                ids.append(np.frombuffer(x, "<u2"))
                size += n
        if size:
            yield row()

    # documents of one id are dealt out by their content's hash, so that no id is one task's work
    spread = encoded.withColumn("h", F.xxhash64("ids")).repartitionByRange(partitions(encoded), "k", "h").sortWithinPartitions("k", "h")
    out = spread.select("k", "n", "ids").mapInArrow(shards, "part int, seq int, start long, docs binary, lengths binary, count long, control binary, data binary")
    out.write.option("compression", "zstd").parquet(f"{path}/shards")
    header = spark.createDataFrame([(order.astype("<u4").tobytes(),)], "order binary")
    header.write.parquet(f"{path}/header")
    drop(encoded)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (little-endian 32-bit) for each document."""
    shards, header = spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/header")
    order = spark.sparkContext.broadcast(np.frombuffer(header.first()[0], "<u4"))
    # one sum for each writing task
    sums = {r[0]: r[1] for r in shards.groupBy("part").agg(F.sum("count")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]

    names = ["k", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    @lean
    def read(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = batch.slice(r, 1).to_pylist()[0]
                ids = np.ascontiguousarray(order.value[unpack(x["control"], x["data"], x["count"])], "<u4")
                ks, ns = np.frombuffer(x["docs"], "<i8"), np.frombuffer(x["lengths"], "<i8")
                ends = np.cumsum(ns)
                raw = memoryview(ids).cast("B")
                each = [raw[4 * (e - n) : 4 * e] for n, e in zip(ns.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(ks), pa.array(before[x["part"]] + x["start"] + ends - ns), pa.array(ns), pa.array([zlib.crc32(b) for b in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(map(bytes, each), pa.binary())] if with_ids else []), names)

    out = shards.select("part", "start", "docs", "lengths", "count", "control", "data").mapInArrow(read, "k long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return out.select(outer_id(F.col("k")).alias("doc_id"), *names[1:])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the documents' tokens (to a folder of the shared one if no path is given) and read them back, without the ids."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens-")
    write_tokens(docs, path, id_col, text_col)
    return read_tokens(spark, path, with_ids=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
