"""Language identification, fill-in-middle and the filter audit against brute force."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockgraph.llm import fill_in_middle, filter_audit, language_id

MARKED = ["a <P> b", "<S>", "x<M>", "< S> <P <P> ", "<<S>"]


# ---------------------------------------------------------------- fill-in-middle


def by_hand(i, t, rate=90, spm=20):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(make, rows):
    more = [*rows, *[(20 + i, t) for i, t in enumerate([*MARKED, "<", "<P", "ab<S", "é", "日本語" * 2000, "𝒳é" * 900])], (None, None), (40, "z" * 1024), (41, "é" * 512 + "x" * 1025), (42, " \n")]
    out = fill_in_middle.transform(make(more))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "k", "__text", "size", "n", "form", "prefix_n", "middle_n", "output"]
    found = {}
    for r in out.withColumn("back", fill_in_middle.restored(F.col("form"), F.col("output"))).collect():
        assert r["back"] == (r["text"] or "")
        found.setdefault((r["doc_id"], r["text"]), (r["n"], r["form"], r["prefix_n"], r["middle_n"], r["output"]))
    assert found == {(i, t): by_hand(i, t) for i, t in more}
    assert {x[1] for x in found.values()} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(make(rows).filter("false")).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.transform(make(rows), unit="page")


def test_every_form_of_marked_pieces_is_restored(make):
    # pieces that end or begin like a mark
    texts = ["<", "<S", "S>", "<P<S", "P>M><M", "<<<", "<M<P<S<", "a<", ">b"]
    rows = [(i, t) for i in range(60) for t in texts]
    out = fill_in_middle.transform(make(rows), rate=100, spm=50)
    assert not out.filter(fill_in_middle.restored(F.col("form"), F.col("output")) != F.col("text")).count()
    assert out.filter("form = 'plain'").count() == 0 and out.filter("form = 'spm'").count()


@pytest.mark.parametrize("unit", ["codepoint", "word", "line"])
@pytest.mark.parametrize("size", [3, 1024])
def test_cuts_of_units(monkeypatch, unit, size):
    monkeypatch.setattr(fill_in_middle, "SIZE", size)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aé日 \n"), rng.integers(0, 40))) for _ in range(60)]
    pattern = {"codepoint": r"(?s).", "word": r"(?s)^\s*\S*\s*|\S+\s*", "line": r"[^\n]*\n|[^\n]+$"}[unit]
    units = [[x for x in re.findall(pattern, t) if x] for t in texts]
    if unit == "word":  # white space before the first word is a unit of its own
        units = [[x for y in [re.findall(r"^\s+|\S+\s*", t)] for x in y] for t in texts]
    got = fill_in_middle.Chunked([t.encode() for t in texts], unit)
    assert got.n.tolist() == [len(x) for x in units]
    for share in (0, 0.3, 1):
        rank = (got.n * share).astype(int)
        assert got.cut(rank).tolist() == [len("".join(x[:r]).encode()) for x, r in zip(units, rank, strict=True)]


# ---------------------------------------------------------------- filter audit


def audit_by_hand(rows, labels):
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = any((t2 or "") == t and j is not None and (i is None or j < i) for j, t2, _ in rows)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": earlier}
        docs.append((lang or "", fails, *(max((y[k] or 0 for j, *y in labels if j is not None and j == i), default=0) for k in (0, 1))))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        shapley, steps = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                steps.append((order, k + 1, len(left), len(gone), sum(d[0][f] for d in mine) - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in mine), sum(d[1] == 1 for d in gone), sum(d[2] == 1 for d in gone)))
        out += [(part, *s, shapley[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


def test_filter_audit(spark, rows):
    long = " ".join(f"word{i}" for i in range(150))
    docs = [(i, t, ("en", "de", None, "")[k % 4]) for k, (i, t) in enumerate(rows)]
    docs += [(30 + i, long, "en") for i in range(4)] + [(None, long, "en"), (None, long, "de"), (50, "A" + long, "en"), (50, long.upper(), "fr"), (51, long + " $", "fr"), (50, "A" + long, "en"), (52, (long + " ") * 2, "fr"), (53, "", "fr"), (None, "", None)]
    labels = [(30, 1, 0), (31, 0, 1), (31, 1, None), (None, 1, 1), (51, 1, 1), (50, None, 1), (99, 1, 1)]
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(filter_audit.cells(filter_audit.failures(make(docs).withColumn("mask", F.lit("x")).repartition(3)), known))
    assert sorted(map(tuple, out.collect())) == audit_by_hand(docs, labels)
    nobody = filter_audit.audit(filter_audit.cells(filter_audit.failures(make([])), known))
    assert nobody.count() == 0 and nobody.columns == out.columns
    plain = filter_audit.audit(filter_audit.cells(filter_audit.failures(make(docs)), known.filter("false")))
    assert plain.count() == out.count() and not plain.filter("good_lost + toxic_lost > 0").count()


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_swaps_visit_every_order_once(k):
    order = list(range(k))
    seen = [tuple(order)]
    for i in filter_audit.swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(k)))


# ---------------------------------------------------------------- language identification

WORDS = {"aa": ["the", "thing", "when", "over"], "bb": ["über", "schön", "nicht", "der"], "cc": ["niño", "está", "señor", "los"]}


def text(lang, k):
    rng = np.random.default_rng(k)
    return " ".join(rng.choice(WORDS[lang], rng.integers(2, 120)))


@pytest.fixture(scope="module")
def net():
    return language_id.train([(text(lang, k), lang) for k in range(90) for lang in WORDS])


def test_gradients_are_the_loss_slopes():
    rng = np.random.default_rng(2)
    net = language_id.Network.fresh(["x", "y", "z"], rng)
    for name in ("vectors", "filters", "offset", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = rng.integers(0, 257, (9, language_id.WINDOW)), rng.integers(0, 3, 9)
    _, grads = language_id.gradients(net, x, y)
    for name, g in zip(("vectors", "filters", "offset", "out", "bias"), grads, strict=True):
        p = getattr(net, name)
        for at in [np.unravel_index(j, p.shape) for j in np.argsort(-np.abs(g.ravel()))[:4]]:
            old, both = p[at], []
            for d in (1e-5, -1e-5):
                p[at] = old + d
                both.append(language_id.gradients(net, x, y)[0])
            p[at] = old
            assert (both[0] - both[1]) / 2e-5 == pytest.approx(g[at], rel=2e-3, abs=1e-6)


def test_pooled_is_the_largest_response(net):
    x = np.random.default_rng(1).integers(0, 257, (37, language_id.WINDOW)).astype(np.int16)
    want = np.maximum(net.responses(x).max(1) + net.offset, 0)
    assert np.allclose(net.pooled(x), want, atol=1e-5)


def test_windows_hold_every_ngram():
    texts = [b"", b"a", bytes(range(97, 120)) * 40, b"x" * language_id.WINDOW, b"y" * (language_id.WINDOW + 1)]
    start, size, doc = language_id.windows(texts)
    begin = np.cumsum([0, *map(len, texts)])
    for i, t in enumerate(texts):
        covered = {p for s, n in zip(start[doc == i] - begin[i], size[doc == i], strict=True) for p in range(s, s + n - language_id.WIDE + 1)}
        assert covered == set(range(len(t) - language_id.WIDE + 1)) and (doc == i).any()
    assert (size <= language_id.WINDOW).all()


def test_languages_of_held_out_texts(make, net):
    new = [(k, text(lang, 1000 + k)) for k in range(60) for lang in WORDS]
    odd = [(100, None), (101, ""), (102, "123 -- 7"), (None, "٣٤"), (103, "日"), (104, text("bb", 5) * 400), (104, text("bb", 5) * 400)]
    out = language_id.identify(make(new + odd), net)
    assert out.columns[-2:] == ["lang_pred", "score"] and out.count() == len(new + odd)
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in out.collect()}
    right = [got[k, text(lang, 1000 + k)][0] == lang for k in range(60) for lang in WORDS]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for _, s in got.values())
    assert [got[x][0] for x in odd[:4]] == ["und"] * 4 and got[odd[4]][0] in WORDS and got[odd[5]][0] == "bb"
    assert language_id.identify(make(new).filter("false"), net).count() == 0
    assert language_id.train([]).predict([b"abc", b""])[0] == ["und", "und"]
    assert set(language_id.train([("some words", "aa")] * 9).predict([b"abc", b"und so weiter"])[0]) == {"aa"}


def test_sample_is_bounded_and_holds_out(spark):
    docs = spark.createDataFrame([(i, text("aa" if i % 9 else "bb", i), "aa" if i % 9 else "bb") for i in range(400)] + [(1, None, "aa"), (None, "x", "cc"), (2, "y", None)] + [(4, "copy", "dd")] * 50, "doc_id long, text string, lang string")
    got = language_id.sample(docs, rows=40)
    held = {text("aa" if i % 9 else "bb", i) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert got == language_id.sample(docs.repartition(7), rows=40)
    assert not held & {t for t, _ in got}
    count = {lang: [y for _, y in got].count(lang) for lang in ("aa", "bb", "cc", "dd")}
    assert zlib.crc32(b"4") % 5 and not zlib.crc32(b"") % 5
    assert count == {"aa": 40 // 3, "bb": 40 // 3, "cc": 0, "dd": 1}
    assert sum(len(t.encode()) for t, _ in language_id.sample(docs, rows=40, total=300)) <= 300
    assert all(len(t.encode()) <= 50 for t, _ in language_id.sample(docs, rows=40, each=50))
    assert language_id.sample(docs.filter("false")) == []
