"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

One inserted or deleted letter flips one bit of a word's letter-parity mask, a replaced one at most two. Split into
three bands, the masks of two near words so agree in one band at least: near words are found by joining on
equal bands and equal lengths (or lengths one apart), then verified. To keep the buckets of a band small whatever the
vocabulary, a key also holds the letters outside one third of the word: an edit lies in one third, so the rest is equal.
A pair counts at its first shared key only.

Defined cases: null texts have no words, a null doc_id counts as an empty one; empty tables and words without near
ones give what the contract says (n_near 0, form and form_n null, root the word itself). Equal texts of several
documents, and repeated rows, count as often as they stand there. The vocabulary is never brought together in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

LEAST_LENGTH, LEAST_COUNT, RATIO, GARBLED = 7, 2, 10, 31
#: Bits of a mask, and the three bands: every third bit, so that neighbours in the alphabet part.
BITS = 63
BANDS = [sum(1 << b for b in range(BITS) if b % 3 == k) for k in range(3)]


def letter_parity(word: Column) -> Column:
    """Bit b is set if the letters of bit b stand in the word an odd number of times. a to z are 0 to 25, the
    letters from U+00C0 follow, wrapped around; letters that share a bit can only hide a flip, not add one."""
    code = lambda ch: F.ascii(ch).cast("long")
    bit = lambda ch: F.when(code(ch) < 128, code(ch) - 97).otherwise((code(ch) - 192 + 26) % BITS).cast("int")
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, ch: F.when(ch == "", m).otherwise(m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(ch)))))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, garbled: int | None = None) -> DataFrame:
    """(word, n) over the whole texts of docs (doc_id, text): maximal runs of letters, A-Z lower-cased.

    garbled: where the crc32 of `<doc_id>:<run>` is a multiple of it, the run loses its letter number crc32 % length.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # runs too short for a word are no use even before a letter is lost
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run")).withColumn("run", ascii_lower(F.col("run")))
    word = F.col("run")
    if garbled:
        runs = runs.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % garbled == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _rest(word: Column, s, side: int) -> Column:
    """The letters outside third number `side` of the shorter word's length s, read from both ends."""
    a = F.floor(s / 3).cast("int")
    if side == 0:
        return F.right(word, s - a)
    if side == 1:
        return F.concat(F.substring(word, F.lit(1), a), F.lit(" "), F.right(word, s - 2 * a))
    return F.substring(word, F.lit(1), 2 * a)


def band_keys(words: DataFrame, longer: bool) -> DataFrame:
    """(key, slot, s, word, n, mask): one row a third and band; slot says which. s is the shorter length of the pairs
    that meet there: the word's own, or one less where it is the longer one."""
    length = F.length("word")
    s = length - 1 if longer else length
    slots = [F.struct(F.xxhash64(s, F.lit(3 * side + band), _rest(F.col("word"), s, side), F.col("mask").bitwiseAND(F.lit(BANDS[band]).cast("long"))).alias("key"), F.lit(3 * side + band).cast("byte").alias("slot")) for side in range(3) for band in range(3)]
    return words.select("word", "n", "mask", s.alias("s"), F.inline(F.array(*slots)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words (word, n, mask) that differ by exactly one edit, once."""
    short = band_keys(words, False)
    other = short.unionByName(band_keys(words, True)).select("key", *[F.col(c).alias(f"{c}_b") for c in ("slot", "s", "word", "n", "mask")])
    flips = F.col("mask").bitwiseXOR(F.col("mask_b"))
    met = short.join(other, "key").filter((F.col("slot") == F.col("slot_b")) & (F.col("s") == F.col("s_b")) & ((F.length("word_b") > F.length("word")) | (F.col("word") < F.col("word_b"))))
    met = met.filter((F.bit_count(flips) <= 2) & (F.levenshtein("word", "word_b", 1) == 1))
    same = [_rest(F.col("word"), F.col("s"), side) == _rest(F.col("word_b"), F.col("s"), side) for side in range(3)]
    agree = [flips.bitwiseAND(F.lit(m).cast("long")) == 0 for m in BANDS]
    # hashes may meet by chance: a pair counts where its slot is the first that it shares in truth
    first = F.when(same[0], 0).when(same[1], 3).otherwise(6) + F.when(agree[0], 0).when(agree[1], 1).otherwise(2)
    return met.filter(F.col("slot") == first).select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word_b").alias("b"), F.col("n_b").alias("n_b"))


def variants(words: DataFrame, ratio: int = RATIO, scratch: Scratch | None = None) -> DataFrame:
    """words (word, n): word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word (ties: least by code points), if that has `ratio` times its count.
    Counts grow by `ratio` with every step from word to form, so paths have at most 19 steps and pointers that
    double reach every root within five joins of the words that have a form.
    """
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    words = scratch.write(words.select("word", "n", letter_parity(F.col("word")).alias("mask")), "words")
    sides = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    near = near_pairs(words).select(sides).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    has = F.col("near_n") >= F.col("n") * ratio
    out = scratch.write(out.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    scratch.drop(words)
    at = scratch.write(out.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(ahead, "root", "left_semi").isEmpty():
            break
        step = scratch.write(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        scratch.drop(at)
        at = step
    return out.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_parity_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of seven letters or more in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(word_counts(docs, garbled=GARBLED))


#: crc32 byte by byte through its table; near words are those that are equal when one letter goes.
SQL = """WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
  t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
  runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r FROM documents),
  low AS (SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM runs GROUP BY 1, 2 HAVING length(w) >= 7),
  hexed AS (SELECT *, hex(encode(d || ':' || w)) AS x FROM low),
  hashed AS (SELECT w, k, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda j: ('0x' || x[2 * j + 1:2 * j + 2])::BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS h FROM hexed, t),
  words AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
  cut AS MATERIALIZED (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
  near AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word)),
  best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word), top AS (SELECT near.word, n_near, best.m, min(other) AS other FROM near JOIN best ON near.word = best.word AND near.m = best.m GROUP BY ALL),
  f AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN top USING (word)),
  path(word, here, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT path.word, f.form, step + 1 FROM path JOIN f ON path.here = f.word WHERE f.form IS NOT NULL),
  last AS (SELECT word, max_by(here, step) AS root FROM path GROUP BY word)
  SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)"""
