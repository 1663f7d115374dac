"""Language identification by a byte convolutional network, trained here in numpy.

A text is cut into windows of a fixed number of bytes that overlap by one filter less a byte, so that no n-gram is lost
at a cut; a batch of windows passes through byte vectors, filters of several widths, the largest response of each filter
over its window, and a softmax over the languages. All windows of a text count, weighted by their letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import chunks, crc, lean, ship, table, unused

#: Bytes of a window; a byte vector's numbers; filters of each width.
WINDOW, DIM, FILTERS = 160, 8, {2: 8, 3: 12, 4: 12}
WIDE = max(FILTERS)
#: A byte that is none: past a text's end.
PAD = 256
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.006, 11
#: Labelled rows that training may see at most, their bytes in all and each, and windows of one text.
TRAIN_ROWS, TRAIN_BYTES, TEXT_BYTES, TEXT_WINDOWS = 2000, 24 << 20, 1 << 20, 8
#: Windows that are laid out, and that pass through the filters, at once.
AT_ONCE, FEW = 512, 16
#: A text without a language.
NONE = "und"
LETTER = np.zeros(257, np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window in the joined texts, its bytes, its text): at least one window for each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    step = WINDOW - WIDE + 1
    each = np.maximum(1, -(-(sizes - WIDE + 1) // step))
    doc = np.repeat(np.arange(len(texts)), each)
    inner = step * (np.arange(len(doc)) - np.repeat(each.cumsum() - each, each))
    return (sizes.cumsum() - sizes)[doc] + inner, np.minimum(WINDOW, sizes[doc] - inner), doc


def joined(texts: list[bytes]) -> np.ndarray:
    """The texts' bytes one after the other, and a window more."""
    return np.frombuffer(b"".join([*texts, bytes(WINDOW)]), np.uint8)


def grid(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The windows' bytes, a row each, padded with PAD."""
    at = np.arange(WINDOW)
    return np.where(at < size[:, None], buf[start[:, None] + at], np.int16(PAD))


@dataclass
class Network:
    languages: list[str]
    #: (257, DIM); (WIDE * DIM, filters), zero beyond a filter's width; (filters); (filters, languages); (languages)
    vectors: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng) -> Network:
        n, k = sum(FILTERS.values()), len(languages)
        filters = rng.normal(0, 1 / np.sqrt(WIDE * DIM), (WIDE * DIM, n)).astype(np.float32) * shape()
        vectors = rng.normal(0, 1, (257, DIM)).astype(np.float32)
        vectors[PAD] = 0
        return cls(languages, vectors, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, (n, k)).astype(np.float32), np.zeros(k, np.float32))

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, filters) for a grid of bytes."""
        e = self.vectors[x]
        n, places = len(x), x.shape[1] - WIDE + 1
        # each place sees WIDE vectors, which stand side by side
        patches = np.lib.stride_tricks.as_strided(e, (n, places, WIDE * DIM), (e.strides[0], e.strides[1], e.strides[2]))
        return (patches.reshape(n * places, WIDE * DIM) @ self.filters).reshape(n, places, -1)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each window, a few windows at a time in the same buffers."""
        places, n = WINDOW - WIDE + 1, self.filters.shape[1]
        e, patches, r = np.empty((WINDOW, FEW, DIM), np.float32), np.empty((places, FEW, WIDE * DIM), np.float32), np.empty((places * FEW, n), np.float32)
        out = np.empty((len(x), n), np.float32)
        for a in range(0, len(x), FEW):
            some = x[a : a + FEW]
            codes = np.full((WINDOW, FEW), PAD, np.int16)
            codes[:, : len(some)] = some.T
            np.take(self.vectors, codes, 0, out=e, mode="clip")
            for k in range(WIDE):
                patches[:, :, DIM * k : DIM * (k + 1)] = e[k : places + k]
            np.matmul(patches.reshape(-1, WIDE * DIM), self.filters, out=r)
            out[a : a + FEW] = r.reshape(places, FEW, n).max(0)[: len(some)]
        return np.maximum(out + self.offset, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(x) @ self.out + self.bias)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """For each text its language and the windows' mean probability of it; NONE and 0 for a text without a letter."""
        start, size, doc = windows(texts)
        buf, total, letters = joined(texts), np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for a in range(0, len(doc), AT_ONCE):
            x, of = grid(buf, start[a : a + AT_ONCE], size[a : a + AT_ONCE]), doc[a : a + AT_ONCE]
            weight = LETTER[x].sum(1).astype(float)
            letters += np.bincount(of, weight, len(texts))
            some = weight > 0
            if self.languages and some.any():
                p = self.probabilities(x[some]) * weight[some, None]
                for j in range(len(self.languages)):
                    total[:, j] += np.bincount(of[some], p[:, j], len(texts))
        plain = np.array([any(map(str.isalpha, t.decode("utf-8", "replace"))) if n and not has_ascii_letter(t) else n > 0 for t, n in zip(texts, letters, strict=True)], bool)
        if not self.languages:
            return [NONE] * len(texts), np.zeros(len(texts))
        best = total.argmax(1)
        score = total[np.arange(len(texts)), best] / np.maximum(letters, 1)
        return [self.languages[j] if ok else NONE for j, ok in zip(best.tolist(), plain.tolist(), strict=True)], np.where(plain, score, 0.0).clip(0, 1)


def has_ascii_letter(t: bytes) -> bool:
    return t.lower() != t.upper()


def shape() -> np.ndarray:
    """1 where a filter of its width has a weight."""
    out = np.zeros((WIDE, DIM, sum(FILTERS.values())), np.float32)
    at = 0
    for width, n in FILTERS.items():
        out[:width, :, at : at + n] = 1
        at += n
    return out.reshape(WIDE * DIM, -1)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean loss, gradients of vectors, filters, offset, out and bias) of some windows and their languages' places."""
    r = net.responses(x)
    top = r.argmax(1)
    raw = np.take_along_axis(r, top[:, None, :], 1)[:, 0] + net.offset
    h = np.maximum(raw, 0)
    p = softmax(h @ net.out + net.bias)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ net.out.T) * (raw > 0)
    # only the place of the largest response has a part in it
    seen = x[np.arange(len(x))[:, None, None], top[:, :, None] + np.arange(WIDE)]
    patches = net.vectors[seen].reshape(len(x), top.shape[1], WIDE * DIM)
    filters = np.einsum("nfd,nf->df", patches, back, optimize=True) * shape()
    spread = (back[:, :, None] * net.filters.T).reshape(-1, DIM)
    codes = seen.reshape(-1)
    vectors = np.stack([np.bincount(codes, spread[:, d], 257) for d in range(DIM)], 1).astype(np.float32)
    vectors[PAD] = 0
    return loss, [vectors, filters, back.sum(0), h.T @ p, p.sum(0)]


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Stochastic gradient descent with moments (Adam) over windows of (text, language) rows, in a seeded order.

    A text gives TEXT_WINDOWS windows at most, evenly spaced, a third of them cut short, so that short texts are known
    too. With one language every text gets it; without rows the network knows none.
    """
    rng, languages = np.random.default_rng(seed), sorted({y for _, y in rows})
    net = Network.fresh(languages, rng)
    texts = [t.encode("utf-8", "surrogatepass") for t, _ in rows]
    if not texts:
        return net
    start, size, doc = windows(texts)
    each = np.bincount(doc, minlength=len(texts))
    inner = np.arange(len(doc)) - np.repeat(each.cumsum() - each, each)
    every = np.maximum(1, -(-each // TEXT_WINDOWS))[doc]
    ok = (inner % every == 0) & (size >= WIDE)
    start, size, doc = start[ok], size[ok], doc[ok]
    y = np.searchsorted(languages, [lang for _, lang in rows])[doc]
    buf = joined(texts)
    # a language's windows weigh as often as the others', within eight times
    counts = np.bincount(y, minlength=len(languages))
    times = np.clip(counts.max(initial=1) // np.maximum(counts, 1), 1, 8)[y]
    pick = np.repeat(np.arange(len(y)), times)
    params = [net.vectors, net.filters, net.offset, net.out, net.bias]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = epochs * -(-len(pick) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(pick)
        for a in range(0, len(order), BATCH):
            k = order[a : a + BATCH]
            short = rng.random(len(k)) < 1 / 3
            length = np.where(short, np.minimum(size[k], rng.integers(12, WINDOW, len(k))), size[k])
            _, grads = gradients(net, grid(buf, start[k], length), y[k])
            step += 1
            rate = RATE * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(params, grads, mean, square, strict=True):
                m += (g - m) * np.float32(0.1)
                v += (g * g - v) * np.float32(0.001)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, total: int = TRAIN_BYTES, each: int = TEXT_BYTES) -> list[tuple[str, str]]:
    """The bounded training sample: at most rows documents with a language, as many of each language as the others have.

    Rows whose crc32 of the id is 0 modulo 5 are held out. Which documents are taken depends on their ids' and texts'
    hashes only. Texts of more than each bytes aren't in it, and it ends where it exceeds total bytes; all is judged
    before anything is collected. At most `rows` languages are learned, the most frequent ones.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    known = known.filter("lang is not null").filter((crc(F.col("id")) % 5 != 0) & F.octet_length("t").between(1, each))
    known = known.withColumn("k", F.xxhash64(F.lit(SEED), "id", "lang", "t"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not counts:
        return []
    share = max(1, rows // len(counts))
    # a language's first ones by hash: about twice as many are looked at, of which the first share stay
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * share + 20) / r["n"])) for r in counts], "lang string, upto double")
    few = known.join(F.broadcast(bounds), "lang").filter(F.col("k") / float(1 << 64) + 0.5 <= F.col("upto")).select("lang", "k", F.octet_length("t").alias("size")).distinct()
    taken, chosen = dict.fromkeys((r["lang"] for r in counts), 0), []
    for r in few.orderBy("k", "lang", "size").limit(4 * rows + 40 * len(counts)).collect():
        if taken[r["lang"]] < share and r["size"] <= total:
            taken[r["lang"]] += 1
            total -= r["size"]
            chosen.append((r["k"],))
    ids = docs.sparkSession.createDataFrame(chosen, "k long")
    # at most `rows` texts of `total` bytes
    got = known.join(F.broadcast(ids), "k").groupBy("k").agg(F.min("t").alias("t"), F.min("lang").alias("lang"))
    return [(r["t"], r["lang"]) for r in sorted(got.collect(), key=lambda r: r["k"])]


def identify(docs: DataFrame, net: Network, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all by default) with the predicted language and its score, from 0 to 1, added.

    The whole text is read, and only the text. A text that is null or has no letter gets NONE and a score of 0.
    Columns of the added names are replaced.
    """
    ship(docs.sparkSession)
    keep = [c for c in (docs.columns if carry is None else carry) if c not in (lang_col, score_col)]
    kept = [F.col(f"`{c}`") for c in keep]
    base = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(unused(keep, "__text")))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand numbers

    @lean
    def run(batches):
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column(len(keep))).to_pylist()):
                part = batch.slice(a, b - a)
                langs, scores = shared.value.predict(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], [*keep, lang_col, score_col])

    return base.mapInArrow(run, StructType([*docs.select(*kept).schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(sample(docs.select("doc_id", "text", "lang")))
    out = identify(docs.select("doc_id", "text"), net, carry=["doc_id"])
    return out.select("doc_id", (crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "lang_pred", "score")
