"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network with calibrated odds.

Every token has a sparse random index vector that its own hash gives (`PER_WORD` signs among `DIM` places;
no table). Its context vector is the sum of the index vectors within `WINDOW` tokens of it, over the whole
corpus and over whole documents. The sums are whole numbers, so they do not depend on how tasks are dealt
and reruns give the same scores. Context vectors are kept by hash in a table that grows with the words
seen, up to `ROWS` rows; beyond that, words share rows with others of the same hash. As broadcast a component
is a byte (16 MB in all); no task widens more than the tokens it works on.

A document is what its tokens' unit context vectors pool to: their mean, their spread, and the mean and
spread of the products of neighbours and of next neighbours (how well words that stand side by side go
together; 1 where a word repeats). Nothing else is an input: no counts, lengths or shapes. A two-layer
numpy network learns on a bounded sample of labelled rows; a temperature fitted on a part of them that it
did not learn from calibrates its probabilities.

The sample: of the distinct labelled (doc_id, text, label), the `SAMPLE` with the least hash of doc_id.
Corpus statistics cover every document.

Defined results: a null or empty text, or one without tokens, has zero features and gets a score as any
other; without labels of both kinds every score is the share of label 1 (0.5 without labels); rows that
repeat a doc_id are scored each, rows without one too; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh_name, lean, table, tidied

ROWS, DIM, PER_WORD, WINDOW = 1 << 18, 64, 4, 2
HIDDEN, SAMPLE = 24, 20_000
CUT = 0.3
FEATURES = 2 * DIM + 4
STRETCH = 20_000  # tokens worked on at once


def tokens_of(text: str | None) -> list[str]:
    """Runs of letters and digits, and runs of other marks."""
    import re

    return re.findall(r"\w+|[^\w\s]+", text) if text else []


def hashes_of(tokens: list[str]):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), dtype=np.uint64, count=len(tokens))


def index_vectors(hashes):
    """The index vectors of tokens: int8, a row each."""
    import numpy as np

    out = np.zeros((len(hashes), DIM), dtype=np.int8)
    for k in range(PER_WORD):
        with np.errstate(over="ignore"):
            h = (hashes + np.uint64(2 * k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        out[np.arange(len(out)), (h % np.uint64(DIM)).astype(np.int64)] += np.where(h >> np.uint64(40) & np.uint64(1), 1, -1).astype(np.int8)
    return out


class _Words(dict):
    """token -> place in `hashes`, for the tokens a task has met; emptied when it has met many."""

    def __init__(self, most: int = 60_000):
        super().__init__()
        self.most, self.new = most, []
        self.rows = self.index = None

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.new.append(token)
        return at

    def codes(self, texts, index: bool = False) -> list:
        """The places of each text's tokens; rows (and index vectors, if asked) then cover them."""
        import numpy as np

        if len(self) > self.most:
            self.clear()
            self.rows = self.index = None
        out = []
        for text in texts:
            t = tokens_of(text.as_py())
            out.append(np.fromiter(map(self.__getitem__, t), dtype=np.int64, count=len(t)))
        if self.new:
            h = hashes_of(self.new)
            rows = (h % np.uint64(ROWS)).astype(np.int64)
            self.rows = rows if self.rows is None else np.concatenate([self.rows, rows])
            if index:
                vectors = index_vectors(h)
                self.index = vectors if self.index is None else np.concatenate([self.index, vectors])
            self.new = []
        return out


def _context(batches):
    """(row, vec): a task's sums of index vectors around the tokens of each row, as int8 or int32."""
    import numpy as np
    import pyarrow as pa

    words, total = _Words(), np.zeros((ROWS, DIM), dtype=np.int32)
    for b in batches:
        for c in words.codes(b.column(0), index=True):
            for s in range(0, len(c), STRETCH):
                lo, hi, end = max(0, s - WINDOW), min(len(c), s + STRETCH + WINDOW), min(len(c), s + STRETCH)
                vec = words.index[c[lo:hi]].astype(np.int16)
                near = np.zeros_like(vec)
                for k in range(1, WINDOW + 1):
                    near[k:] += vec[:-k]
                    near[:-k] += vec[k:]
                own = words.rows[c[s:end]]
                order = np.argsort(own, kind="stable")
                own = own[order]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                total[own[first]] += np.add.reduceat(near[s - lo : end - lo][order], first, axis=0, dtype=np.int32)
    seen = np.flatnonzero(total.any(1))
    for s in range(0, len(seen), 20_000):
        part = total[seen[s : s + 20_000]]
        fits = np.abs(part).max(1) < 128
        yield pa.RecordBatch.from_arrays([pa.array(seen[s : s + 20_000], pa.int32()), pa.array([(v.astype(np.int8) if f else v).tobytes() for v, f in zip(part, fits.tolist())], pa.binary())], names=["row", "vec"])


def _add_up(batches):
    """(rows, vectors): the unit vectors of all rows of a shuffle partition, packed; components are 127ths."""
    import numpy as np
    import pyarrow as pa

    total: dict[int, object] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = np.frombuffer(v, dtype=np.int8 if len(v) == DIM else np.int32).astype(np.int64)
            if k in total:
                total[k] += v
            else:
                total[k] = v
    if total:
        x = np.array(list(total.values()), dtype=np.float64)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array([np.array(list(total), dtype=np.int32).tobytes()], pa.binary()), pa.array([np.rint(127 * x).astype(np.int8).tobytes()], pa.binary())], names=["rows", "vectors"])


def word_vectors(docs: DataFrame):
    """The ROWS x DIM matrix of unit context vectors over all documents, components in 127ths."""
    import numpy as np

    parts = docs.select("text").mapInArrow(tidied(_context), "row int, vec binary").repartition("row").mapInArrow(tidied(_add_up), "rows binary, vectors binary")
    out = np.zeros((ROWS, DIM), dtype=np.int8)
    for r in parts.toLocalIterator():  # together at most ROWS rows, 16 MB
        out[np.frombuffer(r[0], dtype=np.int32)] = np.frombuffer(r[1], dtype=np.int8).reshape(-1, DIM)
    return out


def features(rows, vectors):
    """The pooled vector of a document from the table rows of its tokens."""
    import numpy as np

    out, n = np.zeros(FEATURES), len(rows)
    if not n:
        return out
    sums, squares, pairs = np.zeros(DIM), np.zeros(DIM), np.zeros((2, 2))
    for s in range(0, n, STRETCH):
        v = vectors[rows[max(0, s - 2) : s + STRETCH]].astype(np.float32) / np.float32(127)
        own = v[min(s, 2) :]
        sums += own.sum(0, dtype=np.float64)
        squares += np.einsum("ij,ij->j", own, own, dtype=np.float64)
        for k in (1, 2):
            # the pairs whose later token is this stretch's own
            near = np.einsum("ij,ij->i", v[k:], v[:-k])[max(0, min(s, 2) - k) :] if len(v) > k else np.zeros(0)
            pairs[k - 1] += near.sum(dtype=np.float64), (near * near).sum(dtype=np.float64)
    mean = sums / n
    out[:DIM], out[DIM : 2 * DIM] = mean, np.sqrt(np.maximum(squares / n - mean * mean, 0))
    for k in (1, 2):
        if n > k:
            m, q = pairs[k - 1] / (n - k)
            out[2 * DIM + 2 * k - 2 : 2 * DIM + 2 * k] = m, np.sqrt(max(q - m * m, 0))
    return out


def _pooled(texts, vectors, words):
    """The features of a batch of texts; vectors is the broadcast table."""
    return [features(words.rows[c] if len(c) else c, vectors.value) for c in words.codes(texts)]


def _featured(vectors):
    def run(batches):
        import pyarrow as pa

        words = _Words()
        for b in batches:
            x = [f.tobytes() for f in _pooled(b.column("text"), vectors, words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("t"), pa.array(x, pa.binary())], names=["doc_id", "label", "t", "x"])

    return run


class Network:
    """Two layers: tanh hidden units, one logit. Full-batch Adam; the odds are divided by a temperature."""

    def __init__(self, x, y, seed: int = 7, steps: int = 400, rate: float = 0.02, decay: float = 1e-4):
        import numpy as np

        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        rng = np.random.default_rng(seed)
        held = rng.permutation(len(y)) < max(1, len(y) // 5)
        if len(set(y[~held])) < 2:
            held[:] = False
        z = (x - self.mean) / self.scale
        p = [rng.normal(size=(z.shape[1], HIDDEN)) / np.sqrt(z.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        a, b = z[~held], y[~held]
        share = np.clip(b.mean(), 1e-3, 1 - 1e-3)
        p[3][:] = np.log(share / (1 - share))
        for t in range(1, steps + 1):
            h = np.tanh(a @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - b) / len(b)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [a.T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], np.array([e.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            logit, truth = self.logits(x[held]), y[held]
            tries = np.exp(np.linspace(np.log(0.3), np.log(10), 60))
            loss = [np.mean(np.logaddexp(0, logit / t) - truth * logit / t) for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def logits(self, x):
        import numpy as np

        return np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x):
        import numpy as np

        # rounded, as products differ in the last digits with the rows that share a batch
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40))), 9)


def learn(docs: DataFrame, labels: DataFrame, vectors, most: int = SAMPLE):
    """A network fitted on at most `most` rows of labels (doc_id, quality), or the share of label 1."""
    import numpy as np

    own = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))
    known = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("label")).distinct()
    chosen = own.select("doc_id", "t").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "t", "label").limit(most)
    rows = own.join(F.broadcast(chosen), ["doc_id", "t"])  # at most `most` rows of three numbers
    got = rows.select("doc_id", "text", "label", "t").mapInArrow(tidied(_featured(vectors)), docs.select("doc_id").schema.add("label", "double").add("t", "long").add("x", "binary"))
    got = got.dropDuplicates(["doc_id", "t", "label"]).collect()
    if not got:
        return 0.5
    got.sort(key=lambda r: (r[0], r[2], r[1]))
    y = np.array([r[1] for r in got])
    if y.min() == y.max():
        return float(y[0])
    return Network(np.array([np.frombuffer(r[3]) for r in got]), y)


def _scored(vectors, model, name: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = _Words()
        for b in batches:
            if isinstance(model.value, float):
                s = np.full(b.num_rows, model.value)
            else:
                x = _pooled(b.column("text"), vectors, words)
                s = model.value.score(np.array(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, name])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, name: str = "_score") -> DataFrame:
    """docs (or the given columns of it) with column `name`: the calibrated probability of label 1."""
    lean(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs))
    model = sc.broadcast(learn(docs, labels, vectors))
    cols = list(dict.fromkeys([*(columns or docs.columns), "text"]))
    src = docs.select(*[F.col(f"`{c}`") for c in cols])
    out = src.mapInArrow(tidied(_scored(vectors, model, name)), StructType([*src.schema.fields, StructField(name, DoubleType())]))
    return out.select(*[F.col(f"`{c}`") for c in columns or docs.columns], name)


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows that may be learnt from: crc32 of the id as text, mod 5, is not 0."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents scored at least `cut`, with all their columns, whatever their names."""
    name = fresh_name(docs.columns, "_score")
    return quality_scores(docs, learnable(labels), name=name).filter(F.col(name) >= cut).drop(name)


def op6_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_scores(docs, learnable(labels), ["doc_id"])
    return out.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= CUT, 1).otherwise(0).alias("predicted"))
