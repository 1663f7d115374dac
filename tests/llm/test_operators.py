"""Each operator against brute force, on texts with every odd case, on empty tables and with clashing columns."""

import hashlib
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockgraph.llm import decontamination, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_output
from blockgraph.llm.common import materialize, shared_dir

LAST = 1 << 63


def ranked(rows):
    return sorted({(LAST if i is None else i, (t or "").encode()) for i, t in rows}, key=lambda x: x[0])


def digests(df, *cols):
    return sorted((LAST if r["doc_id"] is None else r["doc_id"], *(r[c] for c in cols)) for r in df.collect())


@pytest.fixture(scope="session")
def same_ids(rows):
    """rows, and null and repeated ids with texts of their own beside copies of passages of others."""
    p = rows[0][1][:150]
    other = " ".join(f"unlike{i}" for i in range(60))
    return [*rows, (None, "A " + p), (None, other), (None, other), (5, other[::-1]), (5, "B " + p + " " + other), (20, other), (20, "no copy"), (20, None)]


@pytest.mark.parametrize("name", ["rows", "same_ids"])
def test_suffix_dedup(make, request, name):
    rows = request.getfixturevalue(name)
    seen, want = {}, []
    for d, t in ranked(rows):
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if seen.setdefault(t[p : p + 100], (d, p)) < (d, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        times = sum((LAST if i is None else i) == d and (x or "").encode() == t for i, x in rows)
        want += [(d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())] * times
    got = suffix_dedup.dedup_substrings(make(rows))
    assert digests(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)
    assert suffix_dedup.dedup_substrings(make(rows).filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_suffix_sort(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 30)).astype(np.uint8)) for _ in range(60)]
    ends = np.cumsum([len(t) for t in texts])
    group = np.sort(rng.integers(0, 9, 60))
    s = suffix_dedup.Suffixes(b"".join(texts), ends - [len(t) for t in texts], ends)
    order, shared = s.sort(group)
    plain, common = s.plain(group)
    assert [texts[i] for i in order] == [texts[i] for i in plain] and shared.tolist() == common.tolist()


def test_frequent_anchors_are_split(make, rows, monkeypatch):
    from blockgraph.llm import repeats

    want = digests(suffix_dedup.dedup_substrings(make(rows)), "n_removed", "kept_sha256")
    monkeypatch.setattr(repeats, "HOT", 1)
    assert digests(suffix_dedup.dedup_substrings(make(rows)), "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("name", ["rows", "same_ids"])
def test_substring_dedup(make, request, name):
    rows = request.getfixturevalue(name)
    first, want = {}, []
    for d, t in ranked(rows):
        w = t.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), d)
    for d, t in ranked(rows):
        w = t.split()
        gone = [0] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < d:
                gone[p : p + 13] = [1] * 13
        times = sum((LAST if i is None else i) == d and (x or "").encode() == t for i, x in rows)
        want += [(d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())] * times
    got = substring_dedup.dedup_phrases(make(rows))
    assert digests(got, "n_words", "n_removed", "kept_sha256") == sorted(want)
    assert substring_dedup.dedup_phrases(make(rows).filter("false")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(make, rows, width):
    nodes = []
    for d, t in ranked(rows):
        w = t.lower().split()
        nodes.append((d, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    label = {d: d for d, _ in nodes}
    for _ in nodes:
        for d, x in nodes:
            for e, y in nodes:
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[d] = label[e] = min(label[d], label[e])
    got = near_dedup.near_duplicates(make(rows), width=width)
    assert {(LAST if r["doc_id"] is None else r["doc_id"]): (r["n_shingles"], LAST if r["component_id"] is None else r["component_id"]) for r in got.collect()} == {d: (len(x), label[d]) for d, x in nodes}
    assert got.count() == len(rows)
    assert near_dedup.near_duplicates(make(rows).filter("false")).count() == 0


def thue_morse():
    """Two words of equal polynomial hash modulo 2**64, whatever its odd base."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_told_apart_by_their_bytes(spark, make, tmp_path):
    from tokenizers import Tokenizer

    x, y = thue_morse()
    got = near_dedup.near_duplicates(make([(1, x), (2, y)]), width=2)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 2)]
    lib = Tokenizer.from_file(token_output.tokenizer_path())
    encoder = token_output.Encoder(token_output.tokenizer_path())
    assert [z.tolist() for z in encoder.encode([x + " " + y, y, x])] == [lib.encode(t, add_special_tokens=False).ids for t in (x + " " + y, y, x)]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE", 3)
    encoder = token_output.Encoder(token_output.tokenizer_path())
    texts = ["a few words, it's <|endoftext|> and  more\n\n", "Ünïcode 12345 \u3000 x", "", "words " * 50] * 3
    assert [z.tolist() for z in encoder.encode(texts)] == [encoder.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_takes_many_stretches_in_one_call():
    encoder, calls = token_output.Encoder(token_output.tokenizer_path()), []
    model = encoder.model

    class Counted:
        def __getattr__(self, name):
            return lambda *a, **b: calls.append(name) or getattr(model, name)(*a, **b)

    encoder.model = Counted()
    # stretches of all lengths up to several pieces, bytes that no letter stands for, the letter of the byte 255
    texts = [" ".join(f"w{i}x{i * i}" for i in range(2000)), "\u00ff \u0178\x00\x7f\u0143 \u00ff\u00ff", "y" * 1700 + " " + "\u00e9" * 900, " ", "\n\n a"]
    assert [z.tolist() for z in encoder.encode(texts)] == [encoder.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 100


def test_training_hands_its_memory_back(monkeypatch):
    called = []
    monkeypatch.setattr(quality_classifier, "release", lambda: called.append(True))
    quality_classifier.train([("good words here", 1), ("bad bad words", 0)], epochs=1)
    assert called
    assert all(ids.itemsize + n.itemsize <= 6 for ids, n in quality_classifier.counts(["a few words", "", "more more"]))


def test_nodes_of_one_number_are_told_apart(spark):
    rows = [(1, 7, 1, 5, b"x"), (2, 7, 1, 5, b"x"), (3, 7, 2, 5, b"y"), (4, 8, 3, 5, b"z"), (5, 7, 9, 0, b"e")]
    signed, nodes, twice = near_dedup._numbered(spark.createDataFrame(rows, "k long, v long, w long, n long, sk binary"))
    assert len(twice) == 1 and sorted(r["k"] for r in nodes.collect()) == [1, 3, 4]
    assert signed.filter("n > 0").select("v", "w").distinct().count() == signed.filter("n > 0").select("v").distinct().count() == 3


@pytest.mark.parametrize("sizes", [(2048, 4_000_000), (5, 4_000_000), (1, 200)])
def test_blocks_of_a_bucket(spark, monkeypatch, sizes):
    monkeypatch.setattr(near_dedup, "BLOCK", sizes[0])
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", sizes[1])
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(f"c{i}x{j}" if rng.random() < 0.05 else w for j, w in enumerate(base)) for i in range(30)]
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    comp = [(i, i % 9 if i < 18 else 0) for i in range(30)]
    kept = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "v long, t binary")
    buckets = spark.createDataFrame([(1, i, len(x)) for i, x in enumerate(sets)], "b long, v long, n long")
    found = near_dedup._across(buckets, spark.createDataFrame(comp, "v long, c long"), kept, 80, 2).collect()
    link = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert all(link(a, b) and comp[a][1] != comp[b][1] for a, b in found)
    label = dict(comp)

    def close(pairs):
        root = {c: c for c in label.values()}
        for _ in range(10):
            for a, b in pairs:
                root[label[a]] = root[label[b]] = min(root[label[a]], root[label[b]])
        return root

    assert close(found) == close([(i, j) for i in range(30) for j in range(i) if link(i, j) and label[i] != label[j]])


def test_many_components_in_a_bucket(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 32, 100).astype(np.uint32)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:88], rng.integers(0, 1 << 32, 8).astype(np.uint32)])) for _ in range(40)]
    v = np.arange(40)
    found = near_dedup._linked(v, v.copy(), sets, 80)
    links = [(i, j) for i in v for j in v if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def classes(pairs):
        c = list(range(40))
        for _ in range(40):
            for i, j in pairs:
                c[i] = c[j] = min(c[i], c[j])
        return c

    assert classes(found) == classes(links)


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark, make):
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew potions"
    texts = [(1, "pre " + item.upper() + " post"), (2, item.replace("fox", "fax").replace("dog", "dg")), (3, "clean words only " * 20), (4, None), (5, ""), (6, item[:40] + " zzz " + item[40:]), (6, item), (7, item.replace(" ", "\n  "))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item)], "item_id long, text string")
    got = {(r["doc_id"], r["text"]): [x["item_id"] for x in r["leaks"]] for r in decontamination.find_leaks(make(texts), bench).collect()}
    n = decontamination.normalise
    assert got == {(i, t): [1, 4] if edits(n(item), n(t)) <= len(n(item)) // 16 else [] for i, t in texts}
    assert got[2, texts[1][1]] == [1, 4] and got[3, texts[2][1]] == []
    # a part for each item, and so several passes
    parts = decontamination.find_leaks(make(texts), bench, part_bytes=20)
    assert {(r["doc_id"], r["text"]): [x["item_id"] for x in r["leaks"]] for r in parts.collect()} == got
    assert decontamination.find_leaks(make(texts), bench.filter("false")).filter("size(leaks) > 0").count() == 0


def test_decontamination_in_parts(spark):
    """Items by parts, some without an id, and columns of every internal name: as in one part, leaks in one order."""
    items = [(i if i % 5 else None, " ".join(f"item{i}word{k}" for k in range(12))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ["__row", "__text", "leak", "col1", "a.b"]
    docs = [(i, " ".join([items[i % 30][1], "between", items[(7 * i) % 30][1]]) if i % 3 else "nothing of these", *range(len(names))) for i in range(60)]
    docs += [(None, items[4][1], *range(len(names)))] * 3 + [(61, None, *range(len(names)))]
    df = spark.createDataFrame(docs, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    one, many = (decontamination.find_leaks(df, bench, part_bytes=n) for n in (1 << 20, 400))
    key = lambda r: (LAST if r["doc_id"] is None else r["doc_id"], str(r))
    assert one.columns == many.columns == [*df.columns, "leaks"]
    assert sorted(one.collect(), key=key) == sorted(many.collect(), key=key)
    assert many.filter("size(leaks) > 0").count() == 43


def test_sharding(make, rows):
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 101)
    assert set(table) == set(range(7)) and max(map(table.count, range(7))) - min(map(table.count, range(7))) <= 1
    fewer = sharding.lookup_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 60
    got = sharding.assign_shards(make(rows), "doc_id", names, 101).collect()
    assert len(got) == len(rows) and all(r["shard"] == table[int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:8], 16) % 101] for r in got)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_lm_scoring(make, rows):
    tokens, train = {}, {}
    for d, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
        tokens.setdefault((d, held), []).append(w)
        for x in [] if held else [*w, None]:
            train[x] = train.get(x, 0) + 1
    total, kinds = sum(train.values()), len(train)
    got = lm_scoring.score_documents(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = [*tokens[r["doc_id"], r["held_out"]][0], None]
        base = sum(math.log10((train.get(x, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in train for x in w), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert lm_scoring.score_documents(make(rows).filter("false")).count() == 0


def test_lm_score_by_hand(make):
    """The documents' score and lattice score, and the passes that fit the pieces, over all segmentations."""
    pieces = [b" ", *[bytes([c]) for c in b"abcd"], b"ab", b" a", b"cd", b"bc", b" abc"]
    docs = [(i, t) for i, t in enumerate(["ab abc cd", "abcd ab ab", "a b c d", "bcd abc ab", "cab dab", "ab", "", None, "dd cc abab"])]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [w for i, t in docs if not held(i) for w in (t or "").split()]
    ends = sum(not held(i) for i, _ in docs)
    total, types = len(train) + ends, sorted(set(train))

    def paths(x):
        return [[]] if not x else [[p, *rest] for p in pieces if x.startswith(p) for rest in paths(x[len(p) :])]

    logp = dict(zip(pieces, lm_scoring.first_scores(len(pieces)), strict=True))
    weigh = lambda path: math.exp(sum(logp[p] for p in path))
    for _ in range(lm_scoring.PASSES):
        uses = dict.fromkeys(pieces, 0.0)
        for w in types:
            every = paths(b" " + w.encode())
            mass = sum(map(weigh, every))
            for path in every:
                for p in path:
                    uses[p] += weigh(path) / mass
        logp = {p: math.log((u + 0.1) / (sum(uses.values()) + 0.1 * len(pieces))) for p, u in uses.items()}
    inner = lambda w: sum(map(weigh, paths(b" " + w.encode())))
    discount = lm_scoring.DISCOUNT
    word = lambda w: max(train.count(w) - discount, 0) / total + discount * len(types) / total * inner(w)
    for r in lm_scoring.score_documents(make(docs), pieces=pieces).collect():
        words = (docs[r["doc_id"]][1] or "").split()
        assert r["score"] == pytest.approx(math.log10(ends / total) + sum(math.log10(word(w)) for w in words))
        assert r["lattice_score"] == pytest.approx(math.log10(ends / total) + sum(math.log10(inner(w)) for w in words))


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab", *[bytes([c]) for c in range(128, 140)]]
    logp = np.log(np.arange(1, len(pieces) + 1) / 300)
    p = dict(zip(pieces, np.exp(logp), strict=True))

    def total(x):
        return 1.0 if not x else sum(p[x[:i]] * total(x[i:]) for i in range(1, len(x) + 1) if x[:i] in p)

    words = [b"a", b"ab", b"abba", b"bab", b"ba"]
    assert np.exp(lm_scoring.Lattice(pieces, logp).word_logs(words)) == pytest.approx([total(b" " + w) for w in words])


def test_tokens_round_trip(spark, make, rows, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_output.tokenizer_path())
    token_output.write_tokens(make(rows), str(tmp_path / "t"))
    got = sorted(token_output.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    at, left = 0, [(i, lib.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        left.remove((r["doc_id"], ids))
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(r["ids"]))
        at += len(ids)
    assert not left and [r["doc_id"] for r in got][:-1] == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    v = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32)
    assert (token_output.unpack(*token_output.pack(v), len(v)) == v).all()
    assert token_output.encode(make(rows).filter("false")).count() == 0


def test_mixing(make, rows):
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows) and {r["source"] for r in got} == {"s0", "s1", None}
    for s in ("s0", "s1", None):
        own = [r for r in got if r["source"] == s]
        size = sum(r["size"] for r in own)
        assert {r["source_size"] for r in own} == {size} and own[0]["target"] <= 3 * size
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(make(rows).repartition(1)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.mix(make(rows).filter("false")).count() == 0


def test_large_sets_at_the_threshold():
    """100 * 2684356 is 80 * 3355445 exactly; one shingle less isn't enough."""
    both = 2_684_356
    a, b, c = np.arange(3_000_000), np.concatenate([np.arange(both), np.arange(4_000_000, 4_000_000 + 3_355_445 - 3_000_000)]), None
    c = np.append(b[1:], 9_000_000)
    v = np.arange(2)
    assert near_dedup._linked(v, v.copy(), [a, b], 80) and not near_dedup._linked(v, v.copy(), [a, c], 80)


def test_long_words_are_scored_along(monkeypatch):
    import time

    monkeypatch.setattr(lm_scoring, "SPAN", 97)
    pieces = lm_scoring.existing_pieces()
    lattice = lm_scoring.Lattice(pieces, lm_scoring.first_scores(len(pieces)))
    rng = np.random.default_rng(6)
    for n in (1, 30, 700):
        word = b" " + bytes(rng.choice(np.frombuffer(b"theandofing\xc3\xa9x", np.uint8), n))
        codes = np.frombuffer(word, np.uint8).reshape(1, -1).astype(np.uint64)
        uses = np.zeros(len(pieces))
        assert lattice.along(word, uses) == pytest.approx(lattice.forward(codes)[-1, 0], rel=1e-10)
        assert np.allclose(uses, lattice.expected(codes, np.ones(1)), atol=1e-9)
    monkeypatch.undo()
    began = time.time()
    one = lattice.word_logs([b"these" * 20_000, b"short"])
    assert time.time() - began < 10 and one[0] < 100 * one[1] < 0


@pytest.mark.parametrize("seed", [17, 18])
def test_mixing_of_rows_without_ids_and_of_repeated_ones(spark, seed):
    ten = " ".join("ten words of one text and some more of them".split())
    docs = [(None, f"{ten} {i}", "a") for i in range(600)] + [(None, ten, "a")] * 400 + [(7, ten, "b")] * 500 + [(7, f"{ten} {i}", "b") for i in range(500)]
    docs += [(i, ten, "c") for i in range(1000)] + [(None, ten, None)] * 100
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5), seed=seed).toPandas()
    assert len(got) == len(docs)
    for _, own in got.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max() and own["copies"].max() - own["copies"].min() <= 1


def test_quality_rules(make, rows):
    got = {r["doc_id"]: r for r in quality_rules.judge(make(rows)).collect()}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        again = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(make(rows).filter("false")).count() == 0


def test_quality_rules_reject_outliers(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 200))), "en", "s") for i in range(400)]
    docs += [(i, " ".join(f"w{x}###$$$" for x in rng.integers(0, 5000, 100)), "en", "s") for i in range(400, 410)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(400)) and not any(kept[i] for i in range(400, 410))


def robust(x, starts, seed):
    """Location, scatter and log determinant of the least determinant that C-steps from random starts end in."""
    rng, n = np.random.default_rng(seed), len(x)
    ridge, most = np.diag(np.square(quality_rules.RIDGE)), -(-3 * n // 4)
    best = None
    for _ in range(starts):
        core = x[rng.choice(n, 5, replace=False)]
        for _ in range(100):
            at, spread = core.mean(0), np.cov(core.T, bias=True) + ridge
            far = np.einsum("ij,jk,ik->i", x - at, np.linalg.inv(spread), x - at)
            new = x[np.sort(np.argsort(far, kind="stable")[:most])]
            if len(new) == len(core) and (new == core).all():
                break
            core = new
        det = np.linalg.slogdet(spread)[1]
        if best is None or det < best[0]:
            best = det, at, spread, far
    return best


@pytest.mark.parametrize("n, odd", [(60, 6), (300, 60)])
def test_determinant_against_random_starts(spark, monkeypatch, n, odd):
    """One group, so that nothing is blended: location, scatter and verdicts are those of many random starts in numpy."""
    rng = np.random.default_rng(n)
    text = lambda k, mark, size: " ".join("w" * int(c) + str(x) + mark * (rng.random() < 0.3) for c, x in zip(rng.integers(1, size, k), rng.integers(0, 9000, k), strict=True))
    docs = [(i, text(rng.integers(40, 400), "#", 6), "en", "s") for i in range(n - odd)]
    docs += [(i, text(rng.integers(40, 60), "#$%&|" * 40, 90), "en", "s") for i in range(n - odd, n)]
    found = []
    real = quality_rules.materialize
    monkeypatch.setattr(quality_rules, "materialize", lambda df, *a: found.append(out := real(df, *a)) or out)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    mine = [x for x in found if "logdet" in x.columns or "scale" in x.columns][-1].filter("g like 's%'").first()
    st = {r["doc_id"]: r for r in quality_rules.statistics(df).collect()}
    vector = lambda r: [np.log(1 + r["n_words"]), np.log(1 + r["word_chars"] / r["n_words"]), np.log(1 + 10 * r["n_symbols"] / r["n_words"]), np.log(1 + 10 * (r["n_repeat_words"] + r["n_dup_lines"]) / r["n_words"])]
    x = np.array([vector(st[i]) for i in range(n)])
    det, at, spread, far = robust(x, 300, n)
    factor = np.array([[mine[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    # the core's bound is a bin's end here, so a core may hold a few rows more
    assert np.allclose([mine[f"a{i}"] for i in range(4)], at, atol=0.05)
    assert np.allclose(factor @ factor.T, spread, rtol=0.25, atol=0.02) and abs(mine["logdet"] - det) < 0.3
    far = far * min(1, quality_rules.CHI_MEDIAN / np.median(far))
    clear = [i for i in range(n) if abs(np.log(far[i] / quality_rules.CUT)) > 0.15]
    assert len(clear) >= n - 2 and [kept[i] for i in clear] == [bool(far[i] <= quality_rules.CUT) for i in clear]
    assert not any(kept[i] for i in range(n - odd, n))


@pytest.mark.parametrize("copies", [60, 90])
def test_a_group_of_copies_rejects_nobody(spark, copies):
    """A group that is mostly one text has hardly any scatter of its own; ordinary documents beside the copies stay."""
    rng = np.random.default_rng(copies)
    plain = [" ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(30, 400))) for _ in range(100)]
    odd = " ".join(f"w{x}###$$$" for x in rng.integers(0, 5000, 100))
    docs = [(i, plain[0 if i < copies else i], "en", "s") for i in range(100)] + [(100, odd, "en", "s")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i in kept if not kept[i]] == [100]


def test_unsettled_estimates_warn(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SETTLED", -1.0)
    monkeypatch.setattr(quality_rules, "MORE_STEPS", 1)
    docs = [(i, " ".join(f"w{x}" for x in range(i, i + 40)), "en", "s") for i in range(20)]
    with pytest.warns(UserWarning, match="still changed"):
        assert quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).filter("kept").count() == 20


def test_quality_rules_judge_small_groups(spark):
    rng = np.random.default_rng(3)
    plain = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 200)))
    odd = " ".join(f"w{x}###$$$" for x in rng.integers(0, 5000, 100))
    # no language has many documents; "fr" and a source of "en" consist of one
    docs = [(i, plain(), "en" if i % 2 else "de", f"s{i % 6}") for i in range(120)]
    docs += [(200, odd, "en", "s1"), (201, odd, "de", "t"), (202, odd, "fr", "u"), (203, plain(), "en", "t"), (204, plain(), "es", None), (205, plain(), None, "s1")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert len(kept) == len(docs) and {i for i in kept if not kept[i]} == {200, 201, 202}


def test_quality_classifier(spark, make, rows):
    rng = np.random.default_rng(2)
    text = lambda y: " ".join(f"w{x}" + ("" if y else "***") for x in rng.integers(0, 500, 60))
    docs = [(i, text(i % 4 > 0), "en", "s", 0) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, None if i % 7 == 0 else int(i % 4 > 0)) for i in range(300)] + [(None, 1)], "doc_id long, quality int")
    sample = quality_classifier.sample(d, labels)
    assert len(sample) == sum(1 for i in range(300) if i % 7 and zlib.crc32(str(i).encode()) % 3 != 1)
    got = quality_classifier.score(d, quality_classifier.train(sample)).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 > 0) for r in got)
    odd = quality_classifier.score(make(rows), quality_classifier.train([])).collect()
    assert len(odd) == len(rows) and all(r["score"] == 0.5 for r in odd)
    assert quality_classifier.score(d.filter("false"), quality_classifier.train(sample)).count() == 0


def test_classifier_features_by_hand():
    texts = ["the cat  the cat sat", "a", "", " \n", "Ünï ünï xyz xyz " + "w" * 200]
    m, mask = 0x01000193, 0xFFFFFFFF

    def spread(h):
        h ^= h >> 15
        h = h * 0x2C1B3C6D & mask
        h ^= h >> 12
        h = h * 0x297A2D39 & mask
        return (h ^ h >> 15) & quality_classifier.BUCKETS - 1

    def word(w):
        return sum((ord(c) + 1) * pow(0x9E3779B1, i & 63, 1 << 32) for i, c in enumerate(w)) & mask

    for t, (ids, n) in zip(texts, quality_classifier.counts(texts), strict=True):
        want = []
        c = [32, *(32 if x in " \t\n\v\f\r" else ord(x) for x in t), 32]
        for i in range(len(c) - 2):
            three = (c[i] * m + c[i + 1]) * m + c[i + 2] & mask
            if c[i + 1] != 32:
                want.append(spread(three + 3 & mask))
                if i + 3 < len(c) and c[i + 2] != 32:
                    want.append(spread(three * m + c[i + 3] + 0x51ED270B & mask))
        words = [word(w) for w in t.split()]
        want += [spread(w ^ 0x68E31DA4) for w in words] + [spread(a * 0x85EBCA6B + b & mask) for a, b in zip(words, words[1:], strict=False)]
        want += [0 for a, b in zip(words, words[1:], strict=False) if a == b]
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {x: want.count(x) for x in want}


def test_classifier_training_by_hand():
    """Descent on the vectors and the output, and that the folded model scores like the unfolded one."""
    rows = [(f"good words {i} here", 1) for i in range(4)] + [(f"bad ### {i}", 0) for i in range(3)]
    dim, rate, epochs, seed = 3, 0.25, 2, 7
    model = quality_classifier.train(rows, epochs, rate, dim, seed)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (quality_classifier.BUCKETS, dim))
    out, bias, step = np.zeros((2, dim)), np.zeros(2), 0
    feats = quality_classifier.counts([t for t, _ in rows])
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            lr = rate * (1 - step / (epochs * len(rows)))
            step += 1
            ids, n = feats[k]
            hidden = sum(vectors[i] * c for i, c in zip(ids, n, strict=True)) / n.sum()
            z = np.exp(out @ hidden + bias)
            error = z / z.sum() - np.eye(2)[rows[k][1]]
            back = error @ out
            out, bias = out - lr * np.outer(error, hidden), bias - lr * error
            for i, c in zip(ids, n, strict=True):
                vectors[i] -= lr * 20 * math.sqrt(c / n.sum()) * back
    for t in ["good words", "bad ### x", ""]:
        ids, n = quality_classifier.counts([t])[0]
        z = np.exp(out @ (sum((vectors[i] * c for i, c in zip(ids, n, strict=True)), np.zeros(dim)) / max(n.sum(), 1)) + bias)
        assert model.scores([t])[0] == pytest.approx(z[1] / z.sum(), abs=1e-4)


def test_classifier_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "é" * (400 if i % 10 == 0 else 20)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    ids = sorted((i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: hashlib.md5(f"train:{i}".encode()).hexdigest())
    some = [i for i in ids[:30] if i % 10]
    got = quality_classifier.sample(docs, labels, rows=30, total=400, each=500)
    assert [t for t, _ in got] == ["é" * 20] * min(len(some), 10)


def test_mixing_prefers_what_labels_prefer(spark):
    docs = spark.createDataFrame([(i, " ".join(["word" if i % 2 else "#$%"] * 40), "s" if i < 800 else "t") for i in range(1000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 1000, 7)], "doc_id long, quality int")
    extra = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, labels).filter("source = 's'").collect()}
    plain = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).filter("source = 's'").collect()}
    share = lambda x: sum(n for i, n in x.items() if i % 2) / sum(x.values())
    assert share(extra) > 0.9 and abs(share(plain) - 0.5) < 0.1


def test_shards_are_written(spark, make, rows, tmp_path):
    names = sharding.shard_names(5)
    sharding.write_shards(make(rows), "doc_id", str(tmp_path / "s"), names, 101)
    got = spark.read.parquet(str(tmp_path / "s"))
    want = sharding.assign_shards(make(rows), "doc_id", names, 101)
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"]), r["shard"]) for r in df.collect())
    assert key(got) == key(want) and set(make(rows).columns) < set(got.columns)


def test_clashing_names(spark):
    names = ["__size", "__weight", "__key", "__src", "__at", "__slot", "__shard", "__words", "__score", "__leaks", "size_", "doc", "src"]
    docs = spark.createDataFrame([(i, f"some text {i}", "en", "s", *range(len(names))) for i in range(4)], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    want = {tuple(range(len(names)))}
    for out in (mixing.mix(docs), sharding.assign_shards(docs, "doc_id", sharding.shard_names(3), 101), quality_rules.statistics(docs)):
        assert {tuple(r) for r in out.select(*names).collect()} == want


def test_pipeline_against_brute_force(spark):
    """The stages' decisions at sf0.001 from the texts alone; the classifier's are judged by labels it hasn't seen."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.cache()]
    for _, stage in p.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf).cache())
    texts = [{r["doc_id"]: r["text"] or "" for r in d.collect()} for d in kept]
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()
    unseen = [(r["doc_id"] in texts[1]) == bool(r["quality"]) for r in labels if r["quality"] is not None and r["doc_id"] in texts[0]]
    assert sum(unseen) >= 0.95 * len(unseen) > 0
    # near-dedup: the least of each component
    shingled = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))(re.findall(r"[^ \t-\r]+", t.translate({c: c + 32 for c in range(65, 91)}))) for i, t in texts[1].items()}
    label = {i: i for i in shingled}
    links = [(i, j) for i in shingled for j in shingled if i < j and shingled[i] and 100 * len(shingled[i] & shingled[j]) >= 80 * len(shingled[i] | shingled[j])]
    for _ in shingled:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert set(texts[2]) == {i for i in label if label[i] == i} and len(texts[2]) < len(texts[1])
    # decontamination: no item in what stays, one within the budget in what goes
    items = [" ".join((r["text"] or "").lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(t.lower().split())
    assert not any(x and x in flat(t) for t in texts[3].values() for x in items)
    gone = {i: flat(t) for i, t in texts[2].items() if i not in texts[3]}
    assert gone and all(any(x in t for x in items if x) or min(edits(x, t) - len(x) // 16 for x in items if x and set(x.split()[:3]) & set(t.split())) <= 0 for t in gone.values())
    # mixing: words by source near the target
    copies = {r["doc_id"]: r["count"] for r in kept[4].groupBy("doc_id").count().collect()}
    size = {i: len(re.findall(r"[^ \t-\r]+", t)) for i, t in texts[3].items()}
    source = {r["doc_id"]: r["source"] for r in kept[3].select("doc_id", "source").collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    whole = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    share, target = {s: k % 3 + 1 for k, s in enumerate(names)}, {}
    left, open_ = sum(whole.values()), set(names)
    while open_:
        full = {s for s in open_ if left * share[s] / sum(share[x] for x in open_) > 3 * whole[s]}
        for s in full or open_:
            target[s] = 3 * whole[s] if full else left * share[s] / sum(share[x] for x in open_)
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for s in names:
        own = [i for i in size if source[i] == s]
        assert abs(sum(copies.get(i, 0) * size[i] for i in own) - target[s]) <= max(size[i] for i in own)
    # token output
    lib = Tokenizer.from_file(token_output.tokenizer_path())
    at, want = 0, []
    for i in sorted(texts[4]):
        ids = np.array(lib.encode(texts[4][i], add_special_tokens=False).ids + [0], "<u4")
        for _ in range(copies[i]):
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    got = p.STAGES[-1][1](spark, kept[4], sf)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    assert all(d.columns == docs.columns for d in kept)


def test_pipeline_deduplicates_rows_not_ids(spark, make):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"v{k}x{j}" for j in range(100))
    # null and repeated ids: near copies of others, near copies of each other, equal rows and unique texts
    docs = [(1, text(1)), (None, text(1) + " more"), (None, text(2)), (None, text(3)), (None, text(3) + " more"), (None, text(3)), (7, text(4)), (7, text(1) + " y"), (7, text(5)), (7, text(5) + " z")]
    docs += [(8, text(6)), (8, text(6)), (None, None), (None, ""), (None, ""), (9, text(4)), (10, text(7))]
    made = make(docs)
    got = p.deduplicate(spark, made, "")
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert got.columns == made.columns
    group = lambda t: (t or "").split("x")[0]
    assert sorted(((LAST if i is None else i), group(t)) for i, t in left) == sorted([(1, "v1"), (LAST, "v2"), (LAST, "v3"), (7, "v4"), (7, "v5"), (8, "v6"), (10, "v7"), *[(LAST, "")] * 3])
    assert sorted(map(str, left)) == sorted(str((r["doc_id"], r["text"])) for r in p.deduplicate(spark, made.repartition(1), "").collect())
    assert p.deduplicate(spark, made.filter("false"), "").count() == 0


def test_stages_leave_no_texts_behind(spark):
    import corpus_pipeline as p

    at = Path(shared_dir(spark).removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in at.rglob("*.parquet"))
    # digests hardly compress; every tenth text is a near copy of the one before it
    text = lambda i: " ".join(hashlib.md5(f"{i}:{j}".encode()).hexdigest() for j in range(100))
    docs = spark.createDataFrame([(i, text(i - 1) + " more" if i % 10 == 9 else text(i), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    docs = materialize(docs)
    before = held()
    assert p.deduplicate(spark, docs, "").count() == 270
    # without the sketches: 288 bins for each text
    assert held() - before < 300 * 288 / 2
    spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int").write.parquet(f"{at}/sf/labels.parquet")
    before = held()
    assert p.mix(spark, docs, f"{at}/sf").count() > 0
    assert held() - before < 300 * 3200 / 10


def test_mix_reads_again_what_it_does_not_store(spark):
    # equal rows, among them many of one kind, null ids, texts and sources
    docs = [(i % 90 or None, f"w{i % 45} " * (1 + i % 45), None if i % 45 == 4 else f"s{i % 3}") for i in range(360)]
    docs += [(7, "same text", "s1")] * 50 + [(8, None, None)] * 5
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    for y in (labels, None):
        want = sorted(map(str, mixing.mix(docs, y).collect()))
        assert sorted(map(str, mixing.mix(docs, y, stored=False).collect())) == want and len(want) == 415
        assert sorted(map(str, mixing.mix(docs.repartition(2), y, carry=["doc_id"], stored=False).collect())) == sorted(map(str, mixing.mix(docs, y, carry=["doc_id"]).collect()))
    assert mixing.mix(docs.filter("false"), labels, stored=False).count() == 0
