"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Seeds are the n-grams of test items that chance alone would seldom put into the corpus: under the word
counts of the whole corpus, an n-gram's expected count (the product of its words' frequencies times
the corpus's length) is at most `chance` a million words. Where an n-gram is more common, it grows by
the words after it until it passes. An item without any n-gram that passes (its words are common, or
its copies make up much of the corpus, or the corpus is small) has all its n-grams as seeds, so a
verbatim copy is found whatever the counts. The seeds join the
n-grams of every document; where they hit, the item is aligned with the passage around the hits
(match +2, other word -1, gap -1), so edited or paraphrased copies with changed, dropped or added
words still score. score = best alignment / (2 * words of the item).

Test items are read in blocks of `BLOCK_BYTES`, each block against all documents in one pass without a
shuffle: every document meets a bounded table of seeds. The words of `COUNTED` blocks are counted in one
more pass. A benchmark larger than a block so costs a pass for each block; the documents' n-grams, many
times the benchmark's, are never shuffled. An item shorter than an n-gram is one seed.

Defined results: null, empty and wordless texts and items match nothing; a repeated row repeats its
rows; documents without an id are searched too and give rows without one; items without an id are left
out; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, small, table, tidied

NGRAM, CHANCE, SCORE = 3, 5.0, 0.5
BLOCK_BYTES, COUNTED = 8 << 20, 8
MATCH, OTHER, GAP = 2, -1, -1


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits: punctuation and case do not hide a copy."""
    import re

    return re.findall(r"\w+", text.lower()) if text else []


def align(item, passage):
    """Smith-Waterman over word codes: (score, start, end) of the best local alignment in the passage.

    Rows are items' words; a row is filled at once, gaps along it by a running maximum.
    """
    import numpy as np

    m = len(passage)
    step = np.arange(m + 1)
    prev = np.zeros(m + 1, dtype=np.int64)
    start = np.tile(step, 1)
    best, at = 0, (0, 0)
    for w in item:
        diag = np.zeros(m + 1, dtype=np.int64)
        diag[1:] = prev[:-1] + np.where(passage == w, MATCH, OTHER)
        h = np.maximum(np.maximum(diag, prev + GAP), 0)
        from_diag = np.zeros(m + 1, dtype=np.int64)
        from_diag[1:] = start[:-1]
        s = np.where(h == 0, step, np.where(h == diag, from_diag, start))
        lift = h - GAP * step  # the best cell to the left, each step costing a gap
        top = np.maximum.accumulate(lift)
        src = np.maximum.accumulate(np.where(lift == top, step, 0))
        left = top + GAP * step
        s = np.where(left > h, s[src], s)
        prev, start = np.maximum(h, left), s
        j = int(prev.argmax())
        if prev[j] > best:
            best, at = int(prev[j]), (int(start[j]), j)
    return best, at[0], at[1]


def shared_words(item, passage) -> int:
    """At most so many words can match: the common part of both bags of words. item: (codes, counts)."""
    import numpy as np

    codes, counts = item
    at = np.minimum(np.searchsorted(codes, passage), len(codes) - 1)
    there = np.bincount(at[codes[at] == passage], minlength=len(codes))
    return int(np.minimum(there, counts).sum())


def _count_words(wanted: set[str]):
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        seen, total = Counter(), 0
        for b in batches:
            for t in b.column(0):
                w = words_of(t.as_py())
                total += len(w)
                seen.update(wanted.intersection(w) and [x for x in w if x in wanted])
        seen[""] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return run


def seeds_of(words: list[str], rare: dict[str, float], n: int, chance: float) -> list[tuple[int, int]]:
    """(start, length) of an item's seeds: the windows of n words or more that pass and hold no shorter
    one that does; all n-grams where none of n words passes."""
    import numpy as np

    size = min(n, len(words))
    starts = np.arange(len(words) - size + 1)
    log = np.concatenate(([0.0], np.cumsum([-np.log(max(rare[x], 1e-18)) for x in words])))
    ends = np.maximum(np.searchsorted(log, log[starts] + np.log(1e6 / chance) - 1e-6), starts + size)
    shortest = ends < np.append(ends[1:], len(words) + 1)  # ends never fall; one past the item: none passes
    if not (shortest & (ends == starts + size)).any():
        return [(p, size) for p in starts.tolist()]
    return [(p, z - p) for p, z in zip(starts[shortest].tolist(), ends[shortest].tolist())]


def _search(items: list[tuple[int, list[str]]], rare: dict[str, float], n: int, chance: float, least: float):
    """rare: chance frequency of each item word."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        code: dict[str, int] = {}
        for _, w in items:
            for x in w:
                code.setdefault(x, len(code) + 1)
        coded = [np.array([code[x] for x in w], dtype=np.int64) for _, w in items]
        distinct = [np.unique(x, return_counts=True) for x in coded]
        base = np.uint64(0x9E3779B97F4A7C15)

        def keys_of(c, size):
            """Hashes of all windows; the alignment sees to equal hashes of other words."""
            g = np.zeros(len(c) - size + 1, dtype=np.uint64)
            for j in range(size):
                g = g * base + c[j : len(c) - size + 1 + j].astype(np.uint64)
            return g

        seeds: dict[int, list[tuple[int, int]]] = {}
        longer: dict[int, dict[int, dict[bytes, list[tuple[int, int]]]]] = {}  # by first n words, length, all words
        for k, (_, w) in enumerate(items):
            size = min(n, len(w))
            g = keys_of(coded[k], size).tolist()
            for p, length in seeds_of(w, rare, n, chance):
                own = seeds.setdefault(g[p], [])
                if length == size:
                    own.append((k, p))
                else:
                    longer.setdefault(g[p], {}).setdefault(length, {}).setdefault(coded[k][p : p + length].tobytes(), []).append((k, p))
        lengths = sorted({min(n, len(w)) for _, w in items})
        keys = np.array(sorted(seeds), dtype=np.uint64)
        for b in batches:
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(t.as_py())
                if not words:
                    continue
                c = np.fromiter((code.get(x, 0) for x in words), dtype=np.int64, count=len(words))
                hits: dict[int, list[int]] = {}
                for size in lengths:
                    if len(c) < size:
                        continue
                    some = np.ones(len(c) - size + 1, dtype=bool)
                    for j in range(size):
                        some &= c[j : len(c) - size + 1 + j] > 0
                    at_words = np.flatnonzero(some)
                    if not len(at_words):
                        continue
                    g = keys_of(c, size)[at_words]
                    there = keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g
                    for p, key in zip(at_words[there].tolist(), g[there].tolist()):
                        found = list(seeds[key])
                        for length, by_words in longer.get(key, {}).items():
                            found += by_words.get(c[p : p + length].tobytes(), ())
                        for k, at in found:
                            hits.setdefault(k, []).append(p - at)
                for k, starts in hits.items():
                    item, size = coded[k], len(coded[k])
                    slack, best = size // 2 + 2, (0, 0, 0)
                    starts.sort()
                    lo = hi = starts[0]
                    spans = []
                    for s in starts[1:]:
                        if s - hi > slack:
                            spans.append((lo, hi))
                            lo = s
                        hi = s
                    spans.append((lo, hi))
                    for lo, hi in spans:
                        a, z = max(0, lo - slack), min(len(c), hi + size + slack)
                        if shared_words(distinct[k], c[a:z]) < least * size:
                            continue
                        found = align(item, c[a:z])
                        if found[0] > best[0]:
                            best = (found[0], found[1] + a, found[2] + a)
                    score = best[0] / (MATCH * size)
                    if score >= least:
                        out.append((doc, items[k][0], score, best[1], best[2]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out], pa.int64())],
                names=["doc_id", "item_id", "score", "start_word", "end_word"],
            )

    return run


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """The test items as lists of (item_id, words), each of a bounded number of bytes."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        w = words_of(r[1])
        if w:
            block.append((r[0], w))
            size += len(r[1].encode())
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, chance: float = CHANCE, least: float = SCORE) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the documents that hold a copy of a test item."""
    lean(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for blocks in batched(item_blocks(benchmark), COUNTED):
        wanted = {x for block in blocks for _, w in block for x in w}
        counts = base.select("text").mapInArrow(tidied(_count_words(wanted)), "word string, n long").groupBy("word").agg(F.sum("n")).collect()
        seen = dict((r[0], r[1]) for r in counts)  # at most these blocks' own words
        total = max(1, seen.get("", 0))
        for block in blocks:
            rare = {x: seen.get(x, 0) / total for _, w in block for x in w}
            found.append(base.mapInArrow(tidied(_search(block, rare, ngram, chance, least)), "doc_id long, item_id long, score double, start_word long, end_word long"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    return Scratch(docs.sparkSession, "leaks").write(reduce(DataFrame.unionByName, found), "leaks")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a copy of any test item, with all their columns."""
    found = small(leaks(docs, benchmark, **options).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_decontaminate(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
