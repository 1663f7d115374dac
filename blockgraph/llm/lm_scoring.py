"""Language-model scoring by the likelihood of a subword lattice.

The pieces are those of an existing subword vocabulary; their order there gives first scores, and passes of
expectation maximisation over the training documents' words turn these into unigram log-probabilities. A word's
lattice probability is the sum over all its segmentations, by a forward recursion in log space. A word that was
seen in training has an edge of its own besides, weighted by its discounted count; what the discount takes from
the seen words is the weight of the lattice. A document's probability is the product over its words and its end. Words repeat, so each distinct word is scored once, and a
document sums over its words: common words by a broadcast table of bounded size, all others by a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, crc, drop, inner_id, lean, materialize, outer_id, ship, table

#: Words of the broadcast table, and bytes that one of them may have.
COMMON, COMMON_BYTES = 1 << 16, 64
#: Passes of expectation maximisation; what the lattice takes from the count of each seen word.
PASSES, DISCOUNT = 3, 0.75
#: Words that the lattice kernel takes at once.
BATCH = 100_000
#: Words of more bytes are scored alone, in spans of so many bytes; numbers below SMALL are scaled anew.
LONG, SPAN, SMALL = 200, 1 << 16, 1e-100
_MUL = np.uint64(0x9E3779B97F4A7C15)


def existing_pieces(path: str | None = None) -> list[bytes]:
    """The vocabulary's pieces in its order, as bytes with a space for the word start, with every single byte."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    out: dict[bytes, None] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            continue
        x = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        if x.strip(b" ") or x == b" ":
            out.setdefault(x)
    return list(out | dict.fromkeys(bytes([b]) for b in range(256)))


class Lattice:
    """Log-probabilities of pieces, and the recursions over words of the same length at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        hashes = np.array([self._hash_one(p) for p in pieces], np.uint64)
        by = np.argsort(hashes)
        self.keys, self.ids, self.logp = hashes[by], by.astype(np.int32), logp.astype(np.float64)
        self.longest = max(map(len, pieces))
        # a bitmap of hashes' low bits spares most searches
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    @staticmethod
    def _hash_one(piece: bytes) -> int:
        h = 0
        for c in piece:
            h = ((h + c + 1) * int(_MUL)) & ((1 << 64) - 1)
            h ^= h >> 29
        return h

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each hash that is a piece, its piece)."""
        maybe = np.flatnonzero(self.seen[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], self.ids[at[hit]]

    def edges(self, codes: np.ndarray):
        """Yields (start, stop, rows, pieces) of the lattices of equally long words, by stop within start."""
        n, length = codes.shape
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i, min(length, i + self.longest)):
                h = (h + codes[:, j] + np.uint64(1)) * _MUL
                h ^= h >> np.uint64(29)
                rows, ids = self._find(h)
                if len(rows):
                    yield i, j + 1, rows, ids

    def forward(self, codes: np.ndarray, edges=None) -> np.ndarray:
        """Natural log of the probability of each prefix of each word."""
        n, length = codes.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for i, j, rows, ids in edges or self.edges(codes):
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[ids])
        return alpha

    def expected(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over all segmentations."""
        edges = list(self.edges(codes))
        alpha = self.forward(codes, edges)
        n, length = codes.shape
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0
        uses = np.zeros(len(self.logp))
        for i, j, rows, ids in reversed(edges):
            tail = self.logp[ids] + beta[j, rows]
            beta[i, rows] = np.logaddexp(beta[i, rows], tail)
            uses += np.bincount(ids, np.exp(alpha[i, rows] + tail - alpha[length, rows]) * counts[rows], len(uses))
        return uses

    def span(self, codes: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, piece) of the edges of one word that start from a to before b, by start; all starts at once."""
        h, found = np.zeros(b - a, np.uint64), []
        for j in range(self.longest):
            m = min(b, len(codes) - j) - a
            if m <= 0:
                break
            h = (h[:m] + codes[a + j : a + j + m] + np.uint64(1)) * _MUL
            h ^= h >> np.uint64(29)
            rows, ids = self._find(h)
            found.append((a + rows, a + rows + j + 1, ids))
        start, stop, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(start, kind="stable")
        return start[by], stop[by], ids[by]

    def along(self, word: bytes, uses: np.ndarray | None = None) -> float:
        """Natural log of a long word's probability, in time and memory linear in its length; adds the expected uses of pieces.

        Numbers are scaled anew where they get small.
        """
        codes = np.frombuffer(word, np.uint8).astype(np.uint64)
        n, wide, price = len(codes), self.longest + 1, np.exp(self.logp)
        alpha, base, carry = np.full(n + 1, -np.inf), 0.0, [1.0] + [0.0] * (wide - 1)
        for a in range(0, n, SPAN):
            b = min(n, a + SPAN)
            start, stop, ids = self.span(codes, a, b)
            first, stop, p = np.searchsorted(start, np.arange(a, b + 1)).tolist(), (stop - a).tolist(), price[ids].tolist()
            acc = carry + [0.0] * (b - a)
            for k in range(b - a):
                x = acc[k]
                if not x:
                    continue
                if x < SMALL:
                    acc[k : k + wide] = [y / x for y in acc[k : k + wide]]
                    base, x = base + math.log(x), 1.0
                alpha[a + k] = base + math.log(x)
                for e in range(first[k], first[k + 1]):
                    acc[stop[e]] += x * p[e]
            carry = acc[b - a :]
        alpha[n] = base + math.log(carry[0]) if carry[0] else -np.inf
        if uses is None or not carry[0]:
            return float(alpha[n])
        beta, base, carry = np.full(n + 1, -np.inf), 0.0, [1.0] + [0.0] * (wide - 1)
        beta[n] = 0.0
        for a in range((n - 1) // SPAN * SPAN, -1, -SPAN):
            b = min(n, a + SPAN)
            start, stop, ids = self.span(codes, a, b)
            first, to, p = np.searchsorted(start, np.arange(a, b + 1)).tolist(), (stop - a).tolist(), price[ids].tolist()
            acc = [0.0] * (b - a) + carry
            for k in range(b - a - 1, -1, -1):
                x = 0.0
                for e in range(first[k], first[k + 1]):
                    x += p[e] * acc[to[e]]
                if not x:
                    continue
                if x < SMALL:
                    acc[k : k + wide] = [y / x for y in acc[k : k + wide]]
                    base, x = base + math.log(x), 1.0
                acc[k] = x
                beta[a + k] = base + math.log(x)
            carry = acc[:wide]
            uses += np.bincount(ids, np.exp(alpha[start] + self.logp[ids] + beta[stop] - alpha[n]), len(uses))
        return float(alpha[n])

    @staticmethod
    def by_length(words: list[bytes]):
        """(indices, matrix of bytes) of the words of each length up to LONG, the word start's space in front, in small lots."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONG]
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else ():
            size = int(sizes[part[0]])
            lot = max(1, 4_000_000 // (size + 1) ** 2, min(2000, 200_000 // (size + 1)))
            for a in range(0, len(part), lot):
                some = part[a : a + lot]
                raw = np.frombuffer(b"".join(b" " + words[k] for k in some.tolist()), np.uint8).reshape(len(some), size + 1)
                yield some, raw.astype(np.uint64)

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, over all segmentations."""
        out = np.zeros(len(words))
        for some, codes in self.by_length(words):
            out[some] = self.forward(codes)[-1]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.along(b" " + w)
        return out


def _lots(batches, limit: int = BATCH):
    """The batches' columns, joined to lots of about limit rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= limit:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(inner_id(F.col(id_col)).alias("k"), (crc(F.col(id_col)) % 5 == 1).alias("held"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(w, c): every distinct word of all documents and its count in training documents."""

    @lean
    def run(batches):
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column(2)).to_pylist()):
                part = batch.slice(a, b - a)
                words = Words(part.column(2).to_pylist(), lower=True)
                train = ~np.array(part.column(1).to_pylist(), bool)[words.doc]
                n = np.bincount(words.id, train, len(words.distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words.distinct, pa.array(n)], ["w", "c"])

    return texts.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: list[bytes] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row.

    Documents whose id's crc32 is 1 modulo 5 are held out of training. Tokens are the lower-cased (A-Z) words and
    one end. base_score is the smoothed word unigram's log10 probability, score the model's, and lattice_score what the
    pieces alone give, without edges for seen words. A null or empty text is its end alone. Without training documents every count is 0 and pieces keep their first scores.
    Rows of equal id and text have equal results.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = _texts(docs, id_col, text_col)
    vocab = materialize(vocabulary(texts))
    n_docs = texts.filter(~F.col("held")).count()
    r = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = r[0] + n_docs, r[1] + (n_docs > 0)
    lattice = fit(vocab, pieces or existing_pieces())
    end = float(np.log10(max(n_docs, 0.5) / max(total, 1)))
    shared = spark.sparkContext.broadcast(lattice)  # one number for each piece

    @lean
    def logs(batches):
        for lot in _lots(batches):
            w = lot.column("w").to_pylist()
            inner = shared.value.word_logs(w)
            yield pa.RecordBatch.from_arrays([lot.column("w").combine_chunks(), lot.column("c").combine_chunks(), pa.array(word_log10(inner, lot.column("c").to_numpy(), total, r[1])), pa.array(inner / np.log(10))], ["w", "c", "p", "q"])

    known = materialize(vocab.mapInArrow(logs, "w binary, c long, p double, q double"))
    drop(vocab)
    # at most COMMON words: word, count, log-probabilities
    top = known.filter(F.octet_length("w") <= COMMON_BYTES).orderBy(F.desc("c"), "w").limit(COMMON).toArrow().combine_chunks()
    common = spark.sparkContext.broadcast((pa.array(top.column("w").to_pylist(), pa.binary()), *(top.column(c).to_numpy() for c in "cpq")))
    del top

    @lean
    def documents(batches):
        from pyspark import TaskContext

        listed, c, p, q = common.value
        base = np.log10(c + 0.5)
        number, part_id = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column(2)).to_pylist()):
                part = batch.slice(a, b - a)
                n_docs = b - a
                words = Words(part.column(2).to_pylist(), lower=True)
                rows = part_id + number + np.arange(n_docs)
                number += n_docs
                seek = pc.index_in(words.distinct, value_set=listed)
                hit, seek = pc.is_valid(seek).to_numpy(zero_copy_only=False), pc.fill_null(seek, 0).to_numpy(zero_copy_only=False)
                value = lambda x: np.where(hit, x[seek] if len(x) else 0, 0.0)[words.id]
                add = lambda x: np.bincount(words.doc, x, n_docs)
                yield out(
                    row=rows, k=part.column(0), held=part.column(1), n=np.bincount(words.doc, minlength=n_docs), m=np.zeros(n_docs, np.int64),
                    known=add(value(c > 0)).astype(np.int64), base=add(value(base)), score=add(value(p)), inner=add(value(q)), w=pa.array([b" %d" % x for x in rows.tolist()], pa.binary()),
                )
                # what is not in the table: one row for each document and word
                rare = np.flatnonzero(~hit[words.id])
                pair, times = np.unique(words.doc[rare].astype(np.int64) * len(words.distinct) + words.id[rare], return_counts=True)
                if len(pair):
                    doc, word = np.divmod(pair, len(words.distinct))
                    zero = np.zeros(len(pair))
                    none = zero.astype(np.int64)
                    yield out(row=rows[doc], k=pa.nulls(len(pair), pa.int64()), held=pa.nulls(len(pair), pa.bool_()), n=none, m=times, known=none, base=zero, score=zero, inner=zero, w=words.distinct.take(pa.array(word)))

    def out(**cols):
        return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in cols.values()], list(cols))

    scored = texts.mapInArrow(documents, "row long, k long, held boolean, n long, m long, known long, base double, score double, inner double, w binary")
    # the rows of documents hold what is no word, each another, and find none
    joined = scored.join(known, "w", "left")
    found = F.coalesce(F.col("m"), F.lit(0))
    joined = joined.select(
        "row", "k", "held", "n",
        (F.col("known") + F.when(F.col("c") > 0, found).otherwise(0)).alias("known"),
        (F.col("base") + F.coalesce(found * F.log10(F.col("c") + 0.5), F.lit(0.0))).alias("base"),
        (F.col("score") + F.coalesce(found * F.col("p"), F.lit(0.0))).alias("score"),
        (F.col("inner") + F.coalesce(found * F.col("q"), F.lit(0.0))).alias("inner"),
    )
    sums = joined.groupBy("row").agg(F.max("k").alias("k"), F.max("held").alias("held_out"), (F.sum("n") + 1).alias("n_tokens"), (F.sum("known") + int(n_docs > 0)).alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"), F.sum("inner").alias("inner"))
    scale = float(np.log10(total + 0.5 * (distinct + 1)))
    return sums.select(
        outer_id(F.col("k")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(n_docs + 0.5)) - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("score") + end).alias("score"), (F.col("inner") + end).alias("lattice_score"),
    )


def word_log10(inner: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of each word's probability, given the lattice's natural log, its training count, that of all tokens and that of distinct words."""
    if distinct:
        inner = np.logaddexp(np.log(np.maximum(counts - DISCOUNT, 1e-300) / total), np.log(DISCOUNT * distinct / total) + inner)
    return inner / np.log(10)


def first_scores(n: int) -> np.ndarray:
    """Log-probabilities of n pieces by their rank in the vocabulary."""
    rank = np.log(np.arange(n) + 20.0)
    return -rank - np.log(np.exp(-rank).sum())


def fit(vocab: DataFrame, pieces: list[bytes], passes: int = PASSES) -> Lattice:
    """The pieces' log-probabilities after passes over all distinct training words, each once: seen words have their
    own edges, so the lattice is for words as they come new."""
    spark = vocab.sparkSession
    lattice = Lattice(pieces, first_scores(len(pieces)))
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(lattice)

        @lean
        def run(batches, shared=shared):
            uses = np.zeros(len(pieces))
            for lot in _lots(batches):
                words = lot.column("w").to_pylist()
                for some, codes in Lattice.by_length(words):
                    uses += shared.value.expected(codes, np.ones(len(some)))
                for w in words:
                    if len(w) > LONG:
                        shared.value.along(b" " + w, uses)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(uses))), pa.array(uses)], ["i", "u"])

        uses = np.zeros(len(pieces))
        # one sum for each piece
        for i, u in vocab.filter("c > 0").select("w").mapInArrow(run, "i long, u double").groupBy("i").agg(F.sum("u")).collect():
            uses[i] = u
        if not uses.any():
            return lattice
        lattice = Lattice(pieces, np.log((uses + 0.1) / (uses.sum() + 0.1 * len(pieces))))
    return lattice


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
