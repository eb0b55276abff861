"""Token counts by the merges of a byte-pair vocabulary, many pre-tokens at a time in ragged arrays.

A text becomes pre-tokens that no merge can cross, since no piece of the vocabulary holds the two characters at such a
border. New pre-tokens of a batch stand in one flat array of symbols with the starts of the sequences. A
round finds each sequence's pair of the lowest rank (the leftmost at ties), merges all of these at once
and looks up only the pairs that changed; sequences without a pair leave the arrays. What is counted
are the symbols that survive, a character without a piece as its UTF-8 bytes. Counts of pre-tokens are kept for the
task, so a word that comes again costs one look-up.

The files are those of the public_tokenizers package; only the vocabulary is read from them (on the driver,
a table bounded by its size), not a line of text is encoded by the library. Supported: sentencepiece models of
kind BPE with identity normalisation and byte fallback. Special strings inside a text are plain characters, as the library takes them.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a text of blanks has those of its blanks; very long texts are
cut at borders of pre-tokens and counted part by part; a null doc_id stays null; repeated rows give a row each.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import fresh_name, lean, table, tidied

MODEL, LIMIT = "piece_bpe_32k.model", 4096
BLANK = "▁"
#: Characters of a text taken at once, symbols merged at once, counts kept by a task; sequences beyond LONG use a heap.
SLICE, SYMBOLS, KEPT, LONG = 1 << 20, 1 << 20, 300_000, 2048
NONE = 1 << 62


class Places:
    """Where int64 keys stand in a sorted array: a table of hashed slots, and the few keys whose slot is taken."""

    def __init__(self, keys, bits: int = 20):
        import numpy as np

        self.keys, self.shift = keys, np.uint64(64 - bits)
        slots = self._slots(keys)
        self.table = np.full(1 << bits, -1, dtype=np.int32)
        self.table[slots] = np.arange(len(keys), dtype=np.int32)  # the last key of a slot has it
        self.rest = np.flatnonzero(self.table[slots] != np.arange(len(keys)))

    def _slots(self, keys):
        import numpy as np

        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys):
        """(places, found)."""
        import numpy as np

        at = self.table[self._slots(keys)].astype(np.int64)
        ok = (at >= 0) & (self.keys[at] == keys)
        other = np.flatnonzero(~ok & (at >= 0))  # the slot belongs to another key
        if len(other) and len(self.rest):
            own = self.keys[self.rest]
            k = np.minimum(np.searchsorted(own, keys[other]), len(own) - 1)
            hit = own[k] == keys[other]
            at[other[hit]], ok[other[hit]] = self.rest[k[hit]], True
        return at, ok


@dataclass
class Vocabulary:
    """Pieces and merges as sorted arrays. Ranks are dense; pieces of equal score share one."""

    chars: dict[str, int]  # characters that are pieces: their symbols
    pairs: object  # sorted keys left << 32 | right
    ranks: object
    merged: object
    inner: object  # sorted keys of two characters (code points) that stand side by side in a piece
    free: str  # white space and control characters in no piece of more than one character
    lookup: object = field(default=None, repr=False)


def load_vocabulary(path: str) -> Vocabulary:
    """The merges of a sentencepiece BPE model: every split of a piece into two pieces, ranked by the piece's score."""
    import numpy as np
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            scores[model.id_to_piece(i)] = (model.get_score(i), i)
    rank_of = {s: r for r, s in enumerate(sorted({s for s, _ in scores.values()}, reverse=True))}
    found, inner = [], set()
    for piece, (score, i) in scores.items():
        for k in range(1, len(piece)):
            left, right = scores.get(piece[:k]), scores.get(piece[k:])
            if left and right:
                found.append((left[1] << 32 | right[1], rank_of[score], i))
            inner.add(ord(piece[k - 1]) << 32 | ord(piece[k]))
    found.sort()
    keys, ranks, merged = (np.array([f[j] for f in found], dtype=np.int64) for j in range(3))
    joined = {chr(k >> 32) for k in inner} | {chr(k & 0x1FFFFF) for k in inner}
    free = "".join(chr(c) for c in range(33) if chr(c) not in joined and chr(c) != " ")
    return Vocabulary({p: i for p, (_, i) in scores.items() if len(p) == 1}, keys, ranks, merged, np.array(sorted(inner), dtype=np.int64), free)


class Counter:
    """Counts tokens in one task."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT):
        import numpy as np

        self.v, self.kept, self.known, self.before = vocabulary, kept, {}, {}
        self.pairs, self.inner = Places(vocabulary.pairs), Places(vocabulary.inner)
        # symbols of characters: a piece's number, or below 0 for a character without a piece
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        for ch, i in vocabulary.chars.items():
            self.symbol[ord(ch)] = i
        lone = re.escape(vocabulary.free)
        self.cut = re.compile(f"{BLANK}+[^{BLANK}{lone}]*|[^{BLANK}{lone}]+" + (f"|[{lone}]" if lone else ""))

    def pair_of(self, left, right):
        """(ranks, merged symbols) of pairs; NONE where they form no piece."""
        import numpy as np

        at, ok = self.pairs.find(left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF))
        return np.where(ok, self.v.ranks[at], NONE), self.v.merged[at]

    def sizes(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token, merged together in ragged arrays."""
        import numpy as np

        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        if not len(code):
            return [0] * len(words)
        ends = np.cumsum([len(w) for w in words])
        start = np.zeros(len(code), dtype=bool)
        start[np.concatenate([[0], ends[:-1]])] = True
        sym = self.symbol[code]
        # within a pre-token, too, no merge crosses two characters that stand side by side in no piece
        start[1:] |= ~self.inner.find(code[:-1].astype(np.int64) << 32 | code[1:].astype(np.int64))[1]
        heads = np.flatnonzero(start)
        width = np.where(sym >= 0, 1, np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4))))
        tokens = np.add.reduceat(width, heads) - self.merges(sym, heads)
        owner = np.searchsorted(ends, heads, side="right")
        return np.bincount(owner, weights=tokens, minlength=len(words)).astype(np.int64).tolist()

    def merges(self, sym, heads):
        """How many merges each sequence sees. sym: symbols of all sequences in a row, heads: where they start."""
        import numpy as np

        done = np.zeros(len(heads), dtype=np.int64)
        length = np.diff(np.append(heads, len(sym)))
        for k in np.flatnonzero(length > LONG).tolist():
            done[k] = self.merges_of_one(sym[heads[k] : heads[k] + length[k]])
        own = np.flatnonzero((length > 1) & (length <= LONG))
        seq = np.repeat(np.arange(len(own)), length[own])
        sym = sym[np.repeat(heads[own] - np.append(0, np.cumsum(length[own])[:-1]), length[own]) + np.arange(len(seq))] if len(own) else sym[:0]
        rank, to = np.full(len(sym), NONE), np.zeros(len(sym), dtype=np.int64)
        if len(sym):
            rank[:-1], to[:-1] = self.pair_of(sym[:-1], sym[1:])
            rank[:-1][seq[:-1] != seq[1:]] = NONE
        while len(sym):
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            place = np.arange(len(sym))
            least = np.minimum.reduceat(np.where(rank == NONE, NONE, rank << 32 | place), first)
            live = least != NONE
            if not live.all():  # sequences without a pair leave
                stay = np.repeat(live, np.diff(np.append(first, len(sym))))
                sym, seq, rank, to = sym[stay], seq[stay], rank[stay], to[stay]
                if not len(sym):
                    break
                moved = np.cumsum(stay) - 1
                hit = moved[least[live] & 0xFFFFFFFF]
            else:
                hit = least & 0xFFFFFFFF
            np.add.at(done, own[seq[hit]], 1)
            sym[hit] = to[hit]
            rest = np.ones(len(sym), dtype=bool)
            rest[hit + 1] = False
            sym, seq, rank, to = sym[rest], seq[rest], rank[rest], to[rest]
            hit = hit - np.arange(len(hit))  # one symbol went with each merge before
            for left in (hit, hit - 1):  # the pairs that the new symbols form
                left = left[left >= 0]
                right = np.minimum(left + 1, len(sym) - 1)
                r, t = self.pair_of(sym[left], sym[right])
                rank[left] = np.where((right > left) & (seq[left] == seq[right]), r, NONE)
                to[left] = t
        return done

    def merges_of_one(self, sym) -> int:
        """The same for one very long sequence, in time n log n: a heap of (rank, place) and linked neighbours."""
        import numpy as np

        n = len(sym)
        ranks, to = self.pair_of(sym[:-1], sym[1:])
        heap = [(r, i, n2) for i, (r, n2) in enumerate(zip(ranks.tolist(), to.tolist())) if r != NONE]
        heap = [(r, i, m, int(sym[i]), int(sym[i + 1])) for r, i, m in heap]
        heapq.heapify(heap)
        now, before, after, done = sym.tolist(), list(range(-1, n - 1)), [*range(1, n), -1], 0
        table = self.v.lookup
        if table is None:
            table = self.v.lookup = {k: (r, m) for k, r, m in zip(self.v.pairs.tolist(), self.v.ranks.tolist(), self.v.merged.tolist())}
        while heap:
            _, i, m, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or now[i] != left or now[j] != right:
                continue
            now[i], now[j], after[i] = m, -2, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            after[j] = -1
            done += 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and now[a] >= 0 and now[b] >= 0 and (hit := table.get(now[a] << 32 | now[b])):
                    heapq.heappush(heap, (hit[0], a, hit[1], now[a], now[b]))
        return done

    def parts(self, text: str):
        """The pre-tokens of a text, in lists of bounded size: one blank goes before a text, blanks become BLANK."""
        if len(text) <= SLICE:
            yield self.cut.findall(BLANK + text.replace(" ", BLANK))
            return
        at, border = 0, re.compile(f"(?<=[^ {BLANK}])[ {BLANK}]")
        while at < len(text):
            m = border.search(text, at + SLICE)
            end = m.start() if m else len(text)
            own = text[at:end].replace(" ", BLANK)
            yield self.cut.findall(own if at else BLANK + own)
            at = end

    def count(self, texts) -> list[int]:
        """Tokens of each text of an Arrow string array (or list), null ones 0."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, BLANK), pc.starts_with(texts, " ")))
        odd = odd.to_numpy(zero_copy_only=False) | (size > SLICE)
        out = np.zeros(len(texts), dtype=np.int64)
        for k in np.flatnonzero(odd).tolist():
            for words in self.parts(texts[k].as_py()):
                unique = list(set(words))
                n = dict(zip(unique, self.known_sizes(unique)))
                out[k] += sum(map(n.__getitem__, words))
        plain = np.flatnonzero(~odd & (size > 0))
        if len(plain):
            # every blank begins a pre-token, and every line break, which no piece holds, another
            own = texts.take(pa.array(plain))
            own = pc.split_pattern(pc.replace_substring(own, "\n", " \n") if "\n" in self.v.free else own, " ")
            words = own.values.dictionary_encode()
            unique = [w if w[:1] == "\n" and "\n" in self.v.free else BLANK + w for w in words.dictionary.to_pylist()]
            n = np.array(self.known_sizes(unique), dtype=np.int64)[words.indices.to_numpy()]
            out[plain] = np.add.reduceat(n, own.offsets.to_numpy()[:-1])
        return out.tolist()

    def known_sizes(self, words: list[str]) -> list[int]:
        """Tokens of distinct pre-tokens: looked up, or merged now and kept. When as many as allowed are kept,
        only those that are met again stay."""
        if len(self.known) > self.kept:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, words))
        missing = [k for k, n in enumerate(found) if n is None]
        new, size = [], 0
        for at, k in enumerate(missing):
            n = before.get(words[k])
            if n is not None:
                found[k] = known[words[k]] = n
            else:
                new.append(k)
                size += len(words[k])
            if new and (size > SYMBOLS or at == len(missing) - 1):
                for k, n in zip(new, self.sizes([words[k] for k in new])):
                    found[k] = known[words[k]] = n
                new, size = [], 0
        return found


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit. model: the path of a sentencepiece BPE model."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))  # the merges of one vocabulary: a few MB
    size = fresh_name([key], "n_bytes")

    def run(batches):
        import pyarrow as pa

        counter = Counter(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                n = counter.count(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, size, "n_tokens", "over_limit"])

    schema = StructType([StructField(key, docs.schema[key].dataType), StructField(size, LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])
    return docs.select(F.col(key), F.col(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(size)).mapInArrow(tidied(run), schema)


def op13_rank_merge_tokens(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Tokens of every whole text, by the merges of piece_bpe_32k.model."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), model or public_tokenizers.path(MODEL))
