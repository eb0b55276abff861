"""A positional trigram index of search texts, and the text predicate answered from it.

Every text gives one row per distinct run of three characters: the run as a number, and the places where it starts. A
token without wildcards is in a text if its runs stand at the right distances, so the text itself is not read; of a
token with wildcards the literal parts are found that way and the rest is checked with LIKE on the texts that are left.
The index is a table in the item's parts, sorted by run within a file, so that a query reads the pages of its own runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_token
from ..sources.workspace import written

GRAM = 3
#: Characters that are taken apart together; a longer text is on its own.
TOGETHER = 1 << 19
#: Items of the rarest run up to which they are broadcast to the postings of the other runs.
FEW_ITEMS = 200_000


def gram_of(s: str) -> int:
    """Three characters as one number, 21 bits each."""
    a, b, c = map(ord, s)
    return a << 42 | b << 21 | c


def postings(item_search: DataFrame, only: list[int] | None = None) -> DataFrame:
    """(item_id, gram, places) of texts (item_id, search_blob); texts of fewer than three characters, null and empty
    ones have none. A text is taken apart where it lies, nothing is shuffled. `only` names the runs that are asked for, for
    an index that answers one query and is not kept: what others would be filtered out is not sorted and sent."""
    import numpy as np

    together = TOGETHER

    def taken_apart(ids, texts):
        import pyarrow as pa

        size = np.array([len(t) for t in texts])
        c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(texts)), size)  # the text of a character, and its place there
        place = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
        at = np.flatnonzero(place < size[own] - (GRAM - 1))
        g = c[at] << 42 | c[at + 1] << 21 | c[at + 2]
        if only is not None:
            asked = np.isin(g, only)
            at, g = at[asked], g[asked]
        order = np.lexsort((g, own[at]))  # stable: places stay in order
        at, g = at[order], g[order]
        if not len(g):
            return None
        text = own[at]
        head = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (text[1:] != text[:-1])))
        places = pa.ListArray.from_arrays(pa.array(np.append(head, len(g)), pa.int32()), pa.array(place[at], pa.int32()))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(text[head])), pa.array(g[head]), places], names=["item_id", "gram", "places"])

    def run(batches):
        for b in batches:
            start, n, texts = 0, 0, []
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py() or ""
                if texts and n + len(text) > together:
                    out = taken_apart(b.column(0).slice(start, len(texts)), texts)
                    start, n, texts = k, 0, []
                    if out is not None:
                        yield out
                texts.append(text)
                n += len(text)
            out = taken_apart(b.column(0).slice(start, len(texts)), texts) if texts else None
            if out is not None:
                yield out

    return item_search.select("item_id", "search_blob").mapInArrow(run, "item_id string, gram long, places array<int>")


def runs_of(token: str) -> list[list[tuple[int, int]]]:
    """For each literal part of three characters or more: (gram, offset) of runs that cover it."""
    parts = []
    for part in re.split("[%_]", token):
        if len(part) >= GRAM:
            at = [*range(0, len(part) - GRAM, GRAM), len(part) - GRAM]
            parts.append([(gram_of(part[k : k + GRAM]), k) for k in at])
    return parts


def wanted_runs(tokens: list[str]) -> list[int]:
    """The runs whose postings tell of these tokens."""
    return sorted({g for t in tokens for part in runs_of(t) for g, _ in part})


def postings_for(item_search: DataFrame, tokens: list[str]) -> DataFrame:
    """The postings of the tokens' own runs, written: they are read more than once, and made by one pass over the texts."""
    return written(postings(item_search, wanted_runs(tokens)), "postings")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def with_tokens(grams: DataFrame, item_search: DataFrame, tokens: list[str]) -> DataFrame:
    """(item_id): the texts that hold every token, % and _ being wildcards; tokens are in lower case.

    grams: postings of the texts. The postings of the rarest run come first, those of other runs are kept for its
    items only. Tokens without a literal part of three characters are checked with LIKE; if all are so, all texts are.
    """
    parts = {t: runs_of(t) for t in dict.fromkeys(tokens)}
    wanted = wanted_runs(list(parts))
    unsure = [t for t in parts if not parts[t] or "%" in t or "_" in t]
    hits = None
    if wanted:
        counts = dict.fromkeys(wanted, 0) | dict(grams.filter(F.col("gram").isin(wanted)).groupBy("gram").count().collect())  # a row a run of the query
        rarest = min(wanted, key=lambda g: (counts[g], g))
        if not counts[rarest]:
            return item_search.select("item_id").limit(0)
        rows = grams.filter(F.col("gram").isin(wanted))
        if len(wanted) > 1:
            few = grams.filter(F.col("gram") == rarest).select("item_id")
            rows = rows.join(F.broadcast(few) if counts[rarest] <= FEW_ITEMS else few, "item_id", "left_semi")
        own = rows.groupBy("item_id").agg(*[F.max(F.when(F.col("gram") == g, F.col("places"))).alias(f"p{k}") for k, g in enumerate(wanted)])
        at = {g: k for k, g in enumerate(wanted)}
        ok = F.lit(True)
        for part in (p for own_parts in parts.values() for p in own_parts):
            starts = F.col(f"p{at[part[0][0]]}")
            for g, offset in part[1:]:
                starts = F.array_intersect(starts, _moved(F.col(f"p{at[g]}"), offset))
            ok = ok & F.coalesce(F.size(starts) > 0, F.lit(False))
        hits = own.filter(ok).select("item_id")
    if unsure:
        left = item_search if hits is None else item_search.join(hits, "item_id", "left_semi")
        for t in unsure:
            left = left.filter(like_token(F.col("search_blob"), t))
        hits = left.select("item_id")
    return hits
