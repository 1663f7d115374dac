"""Substring dedup by repeated-phrase automata: words in a 13-word window that also starts in an earlier document go.

Passages that recur are confirmed on their words among the runs that share an anchor (see repeats.py). A shard's
confirmed passages are compiled to an Aho-Corasick automaton, and all runs of that shard stream through it, which
locates every occurrence: a word goes because of a hit only. All documents take part through their runs, and no other
stretch of a document can hold a passage of the shard.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import Words, mix, table
from .repeats import Runs, anchor_id, covered, find_repeats
from .suffix_dedup import _sliding_min

#: Words of a window, and of the gram whose hash anchors it.
WIDTH, GRAM = 13, 4
#: Passages of one automaton, at most (but for those of one key).
SHARD = 20_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def runs_of(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> Runs:
    words = Words(texts)
    n = len(words.start)
    none = np.zeros(0, np.int64)
    if n < width:
        return Runs(none, none, none, none, none, lambda i, a, b: b"", width)
    h = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        h = mix(h * _GOLD + words.hash[j : n - gram + 1 + j])
    low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(low, width - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(words.doc[: n - width + 1] == words.doc[width - 1 :])
    q, doc = anchor[start], words.doc[start]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(new)
    doc, first, q = doc[cut], start[cut], q[cut]
    begin = words.first[doc]

    def content(i: int, a: int, b: int) -> bytes:
        a, b = a + begin[i], b + begin[i]
        return b" ".join(words.bytes[words.start[a] : words.stop[b - 1]].split())

    return Runs(doc, anchor_id(h[q]), first - begin, np.diff(np.append(cut, len(start))), q - first, content, width)


def resolve(rows: dict, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, window start) of each window that also starts in a document of a smaller id, among rows sorted by key."""
    key, k, first, body = rows["key"].tolist(), rows["k"].tolist(), rows["first"].tolist(), rows["body"]
    # the rows of each distinct run, by key
    groups: dict[int, dict[bytes, list[int]]] = {}
    for i, (g, text) in enumerate(zip(key, body, strict=True)):
        groups.setdefault(g, {}).setdefault(text, []).append(i)
    out_row: list[int] = []
    out_start: list[int] = []
    phrases: dict[str, list[int]] = {}
    runs: list[tuple[bytes, list[int]]] = []

    def confirm(phrase: str, lo: int, hi: int) -> None:
        known = phrases.setdefault(phrase, [lo, hi])
        known[0], known[1] = min(known[0], lo), max(known[1], hi)

    def stream() -> None:
        """Locate the passages that recur in the gathered runs."""
        automaton = ahocorasick.Automaton()
        for phrase, (lo, hi) in phrases.items():
            if lo < hi:
                automaton.add_word(phrase, (phrase.count(" ") - width, lo))
        if len(automaton):
            automaton.make_automaton()
            for text, members in runs:
                line = f" {text.decode('latin-1')} "
                found = list(automaton.iter(line))
                if not found:
                    continue
                at = {p: w for w, p in enumerate(_ends(line))}
                for i in members:
                    for end, (windows, lo) in found:
                        if lo < k[i]:
                            start = first[i] + at[end] - width - windows + 1
                            out_row.extend([i] * windows)
                            out_start.extend(range(start, start + windows))
        runs.clear()
        phrases.clear()

    for texts in groups.values():
        for text, members in texts.items():
            lo, hi = min(k[i] for i in members), max(k[i] for i in members)
            if len(texts) == 1:
                # nothing else shares the anchor: the passage is the whole run
                confirm(f" {text.decode('latin-1')} ", lo, hi)
            else:
                words = text.decode("latin-1").split(" ")
                for w in range(len(words) - width + 1):
                    confirm(f" {' '.join(words[w : w + width])} ", lo, hi)
            runs.append((text, members))
        if len(phrases) >= SHARD:
            stream()
    stream()
    row, start = np.array(out_row, np.int64), np.array(out_start, np.int64)
    # a window may lie in several hits
    both = np.unique(np.stack([row, start]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _ends(text: str):
    """Places of the spaces of ' a b c ': the w-th is where word w - 1 has ended."""
    at = text.find(" ")
    while at >= 0:
        yield at
        at = text.find(" ", at + 1)


def finish(text: bytes, lo: list[int], hi: list[int]) -> tuple:
    words = text.split()
    spans = covered(lo, hi, WIDTH)
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), sum(b - a for a, b in spans), hashlib.sha256(b" ".join(kept)).hexdigest()


def dedup_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row.

    A word is removed if it lies in a 13-word window whose words also stand in a row, unchanged, in a document of a
    smaller id; windows are judged on the input. Texts under 13 words, null and empty ones among them, stay whole.
    Rows that repeat an id count as the same document. A null id sorts last.
    """
    return find_repeats(docs, id_col, text_col, runs_of, resolve, finish, "n_words long, n_removed long, kept_sha256 string", across=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"))
