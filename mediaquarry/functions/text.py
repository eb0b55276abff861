"""String functions of the catalog: identifiers, titles, tags, search blobs, fuzzy scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CAT_LABELS, DOG_LABELS, PET_LABELS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(value) -> Column:
    return F.substring(F.sha1(_c(value).cast("binary")), 1, 16)


def title_from_stem(stem) -> Column:
    stem = _c(stem)
    return F.coalesce(F.nullif(F.trim(F.translate(stem, "_-", "  ")), F.lit("")), stem)


def tags_from_key(key) -> Column:
    return F.filter(F.split(F.lower(_c(key)), "[^A-Za-z0-9]+"), lambda t: F.length(t) >= 3)


def tag_set(media_kind, analysed, key) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.array(_c(media_kind)), F.coalesce(_c(analysed), F.array().cast("array<string>")), tags_from_key(key))))


def search_tokens(query) -> Column:
    return F.filter(F.split(F.lower(_c(query)), r"\s+"), lambda t: t != "")


def like_token(blob: Column, token: str) -> Column:
    """Contains the token; % and _ in it are wildcards, a backslash is plain text."""
    return blob.like("%" + token.replace("\\", "\\\\") + "%")


def search_blob(title, key, media_kind, tags, persona_names, labels, metadata, notes) -> Column:
    """All searchable text in lower case, joined by spaces, empty parts left out."""
    pairs = F.transform(F.map_entries(_c(metadata)), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    parts = [_c(title), _c(key), _c(media_kind), F.array_join(_c(tags), " "), F.array_join(_c(persona_names), " "), F.array_join(_c(labels), " "), F.array_join(pairs, " "), _c(notes)]
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def title_case(s) -> Column:
    """A capital after every non-letter, small letters elsewhere, as titles of themes are written."""
    parts = F.regexp_extract_all(F.lower(_c(s)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


def is_pet(kind, label) -> Column:
    return _c(kind).startswith("pet") | F.lower(_c(label)).isin(*PET_LABELS)


def pet_label(raw, cat_near, dog_near) -> Column:
    """A pet face's label: by its own words, else by the animal it overlaps (cats first), else ''."""
    s = F.replace(F.lower(F.trim(_c(raw))), F.lit("-"), F.lit(" "))
    return F.when(s.contains("cat") | s.contains("kitten"), "cat").when(s.contains("dog") | s.contains("puppy"), "dog").when(_c(cat_near), "cat").when(_c(dog_near), "dog").otherwise("")


def pet_tags(label, face: Column) -> Column:
    s = F.lower(_c(label))
    kind = F.when(s.isin(*CAT_LABELS), "cat face").when(s.isin(*DOG_LABELS), "dog face").otherwise("pet face")
    return F.array_sort(F.array_distinct(F.filter(F.array(F.lit("animal"), F.lit("pet"), s, F.when(face, kind)), lambda t: t.isNotNull() & (t != ""))))


def object_threshold(label) -> Column:
    s = F.lower(_c(label))
    return F.when(s.isin(*CAT_LABELS), 0.18).when(s.isin(*DOG_LABELS), 0.24).when(s.isin(*PET_LABELS), 0.28).otherwise(0.35)


def pet_face_threshold(label) -> Column:
    s = F.lower(_c(label))
    return F.when(s.isin(*CAT_LABELS), 0.14).when(s.isin(*DOG_LABELS), 0.18).otherwise(0.22)


# fuzzy score: whole Arrow batches at a time; the pinned definition of the ratios is here -----------------

#: Letters of a token that fit the lanes of the window search; longer tokens are compared text by text.
LANES = 64
#: Windows looked at together.
WINDOWS = 1 << 18


def _ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length, in percent (normalised indel similarity)."""
    if not a and not b:
        return 100.0
    # bit-parallel LCS: one row of bits for all of `a`
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & at.get(ch, 0)
        row = (row + u | row - u) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def _partial(token: str, blob: str) -> float:
    """Best ratio of the shorter of both with a window of the other, of at most its length."""
    if len(token) > len(blob):
        token, blob = blob, token
    n = len(token)
    return max((_ratio(token, blob[max(0, i) : i + n]) for i in range(1 - n, len(blob))), default=0.0) if token else 0.0


def _token_set(query: str, blob: str, least: float = -1.0) -> float:
    """Ratio of the sorted distinct words of both, those in common first; 100 where one holds all words of the
    other. What cannot exceed `least` is not computed."""
    q, b = set(query.split()), set(blob.split())
    both = q & b
    if both and (not q - b or not b - q):
        return 100.0
    common, left, right = " ".join(sorted(both)), " ".join(sorted(q - b)), " ".join(sorted(b - q))
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    best = least
    for x, y in [(one, two), *([(common, one), (common, two)] if common else [])]:
        if not x and not y or 200.0 * min(len(x), len(y)) > best * (len(x) + len(y)):
            best = max(best, _ratio(x, y))
    return max(best, 0.0)


def _codes(texts: list[str]):
    """(code points of all texts in a row, their lengths)."""
    import numpy as np

    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.array([len(t) for t in texts], dtype=np.int64)


def _letters(token: str, code):
    """For each code point the places where it stands in the token, as bits."""
    import numpy as np

    masks: dict[str, int] = {}
    for i, ch in enumerate(token):
        masks[ch] = masks.get(ch, 0) | 1 << i
    keys = np.array(sorted(map(ord, masks)), dtype=np.uint32)
    bits = np.array([masks[chr(k)] for k in keys.tolist()], dtype=np.uint64)
    near = np.zeros(int(keys[-1]) + 2, dtype=np.uint64)  # by code point; all beyond the last letter have none
    near[keys] = bits
    return near[np.minimum(code, len(near) - 1)]


def _lanes(n: int, letters, start, width):
    """Longest common subsequences of a token of n letters and many windows (start, width) of a text's `_letters`,
    in lanes of 64 bits: bit j of a lane is the state of the token's letter j."""
    import numpy as np

    common = np.empty(len(start), dtype=np.int64)
    full = np.uint64((1 << n) - 1)
    for s in range(0, len(start), 1 << 15):  # as much as stays in the cache
        a, w = start[s : s + (1 << 15)], width[s : s + (1 << 15)]
        whole = bool((w == n).all())
        row = np.full(len(a), full)
        for k in range(n):
            u = row & (letters[a + k] if whole else np.where(k < w, letters[np.minimum(a + k, len(letters) - 1)], np.uint64(0)))
            row = (row + u | row - u) & full
        common[s : s + (1 << 15)] = n - np.bitwise_count(row).astype(np.int64)
    return common


def window_scores(token: str, code, lengths, best):
    """For each text the best ratio of the token with a window of at most its length, or `best` if that is more.

    All windows of all texts are judged by their letters first: one has at most as much in common as it has
    letters of the token. The most promising window of each text is compared, which raises the text's
    threshold; then those windows that can still exceed it. Texts shorter than the token are left as they are.
    """
    import numpy as np

    n = len(token)
    best = np.array(best, dtype=np.float64)
    first = np.cumsum(lengths) - lengths
    own = np.flatnonzero(lengths >= n)
    if not len(own):
        return best
    letters = _letters(token, code)
    sums = np.concatenate([[0], np.cumsum(letters != 0, dtype=np.int64)])
    # windows in order of texts (those over the beginning, whole ones, those over the end), so many at a time
    ends = np.cumsum(lengths[own] + n - 1)
    for s in range(0, int(ends[-1]), WINDOWS):
        g = np.arange(s, min(s + WINDOWS, int(ends[-1])))
        k = np.searchsorted(ends, g, side="right")
        text, i = own[k], g - np.append(0, ends)[k] + 1 - n
        start = first[text] + np.maximum(i, 0)
        width = first[text] + np.minimum(lengths[text], i + n) - start
        most = 200.0 * np.minimum(sums[start + width] - sums[start], n) / (n + width)
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        top = np.flatnonzero(most == np.repeat(np.maximum.reduceat(most, heads), np.diff(np.append(heads, len(text)))))
        top = top[np.unique(text[top], return_index=True)[1]]
        for some in (top, None):
            if some is None:
                some = np.flatnonzero(most > best[text])
            np.maximum.at(best, text[some], 200.0 * _lanes(n, letters, start[some], width[some]) / (n + width[some]))
    return best


def fuzzy_scores(query: str, blobs: list[str]) -> list[int]:
    """0-100 for each blob: the best of the token-set ratio and each token's best window, rounded down."""
    import numpy as np

    best, tokens = np.zeros(len(blobs)), list(dict.fromkeys(query.split()))
    code, lengths = _codes(blobs)
    for token in tokens:
        if len(token) <= LANES:
            best = window_scores(token, code, lengths, best)
        for k in np.flatnonzero((lengths < len(token)) | (len(token) > LANES)).tolist():
            best[k] = max(best[k], _partial(token, blobs[k]))
    return [int(max(score, _token_set(query, blob, score))) if score < 100 else 100 for score, blob in zip(best.tolist(), blobs)]


def fuzzy_score_of(query: str, blob: str) -> int:
    return fuzzy_scores(query, [blob])[0]


def fuzzy_score(query: str, blob) -> Column:
    """0-100. Rows that hold a token of the query verbatim score 100 without leaving the JVM."""
    blob = _c(blob)

    @F.pandas_udf("int")
    def graded(s: pd.Series) -> pd.Series:
        distinct = {b: k for k, b in enumerate(s.dropna().unique())}
        distinct.setdefault("", len(distinct))
        texts, scores, at = list(distinct), [], 0
        while at < len(texts):  # about a million characters at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 20):
                size += len(texts[end])
                end += 1
            scores += fuzzy_scores(query, texts[at:end])
            at = end
        return s.map(lambda b: scores[distinct[b or ""]]).astype("int32")

    plain = F.lit(False)
    for token in query.split():
        plain = plain | blob.contains(token)
    return F.when(plain, F.lit(100)).otherwise(graded(F.when(~plain, blob)))
