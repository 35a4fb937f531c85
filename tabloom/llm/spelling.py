"""Groups of spelling variants: words one edit apart, the rarer led to the much commoner.

Each word gets a mask with a bit for each letter, set if the letter occurs an odd number of times. One inserted or deleted letter flips one bit, one
replaced letter two (or none, where two letters share a bit), so of three bands of the mask one is always equal. Words are joined on
an equal band, the shorter length and the half of the word that the edit leaves alone (its first or its last half; a second filter in the key, without which a bucket
would hold a fixed share of all words); pairs are verified by bits and edit distance inside the join, and reported in the first of their common buckets
only. Every word also goes to buckets one letter shorter, where it meets words that lack a letter.

Words and counts come from partial sums before any shuffle. Roots are found by pointer doubling: each step up means at least
`ratio` times the count, so the number of doublings follows from the largest count.

Defined results: an empty table or one without frequent words gives an empty result; null and empty texts have no words; a document without doc_id (null) counts as
one of an empty id; repeated rows count each; of equal counts the smallest word in code-point order wins; extra columns are ignored.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table
from tabloom.sources.shared import written

LEAST_POINTS, LEAST_COUNT, RATIO, DAMAGED_EACH = 6, 5, 5, 199
LETTERS = "[a-z\\u00C0-\\u00FF]+"
BAND, BANDS = 16, 3


def runs_of(text: Column) -> Column:
    """Runs of letters of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit(LETTERS), 0)


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one code point if its hash with the document says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGED_EACH == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least: int = LEAST_POINTS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of `least` code points that occur `count` times."""
    runs = docs.select("doc_id", F.explode(runs_of(F.col("text"))).alias("run")).filter(F.char_length("run") >= least)
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


def parity_mask(word: Column) -> Column:
    """Bit for each letter, set if it occurs an odd number of times; neighbours in the alphabet go to different bands."""

    def flip(mask: Column, i: Column) -> Column:
        point = F.ascii(F.substring(word, i, F.lit(1)))
        letter = F.when(point.between(97, 122), point - 97).otherwise(26 + point % (BAND * BANDS - 26))
        return mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), letter % BANDS * BAND + F.floor(letter / BANDS).cast("int")))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(word)), F.lit(0).cast("long"), flip)


def _buckets(words: DataFrame, longer: bool) -> DataFrame:
    """A row for each bucket of each word: those of its own length, or those of the words one letter shorter."""
    length = F.char_length("word") - int(longer)
    head = F.floor(length / 2).cast("int")
    halves = [F.substring("word", F.lit(1), head), F.substring("word", head + 1 + int(longer), length - head)]
    bands = [F.col("mask").bitwiseAND(F.lit(((1 << BAND) - 1) << BAND * b)) for b in range(BANDS)]
    tags = [F.struct(F.lit(2 * b + s).alias("tag"), F.xxhash64(F.lit(2 * b + s), bands[b], halves[s], length).alias("bucket")) for b in range(BANDS) for s in range(2)]
    return words.select("word", "n", "mask", halves[0].alias("head"), F.lit(longer).alias("longer"), F.explode(F.array(*tags)).alias("k")).select("*", "k.*").drop("k")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of `words` (word, n) that differ by one edit."""
    masked = words.withColumn("mask", parity_mask(F.col("word")))
    a = _buckets(masked, False)
    b = a.unionByName(_buckets(masked, True))
    a, b = a.alias("a"), b.alias("b")
    flips = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    full = (1 << BAND) - 1
    band = F.when(flips.bitwiseAND(F.lit(full)) == 0, 0).when(flips.bitwiseAND(F.lit(full << BAND)) == 0, 1).otherwise(2)
    first = 2 * band + F.when(F.col("a.head") == F.col("b.head"), 0).otherwise(1)
    met = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.tag") == F.col("b.tag")) & (F.col("b.longer") | (F.col("a.word") < F.col("b.word")))
    met &= (F.char_length("a.word") + F.col("b.longer").cast("int") == F.char_length("b.word")) & (F.bit_count(flips) <= 2) & (F.col("a.tag") == first)
    pairs = a.join(b, met & (F.levenshtein("a.word", "b.word", 1) == 1)).select(F.col("a.word").alias("x"), F.col("a.n").alias("x_n"), F.col("b.word").alias("y"), F.col("b.n").alias("y_n"))
    both = F.array(*(F.struct(F.col(p).alias("word"), F.col(f"{p}_n").alias("n"), F.col(q).alias("near"), F.col(f"{q}_n").alias("near_n")) for p, q in ("xy", "yx")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame, largest: int, ratio: int = RATIO) -> DataFrame:
    """(word, root): where the forms (word, form) of each word end; each step multiplies a count of `ratio` at least by `ratio`, up to `largest`."""
    steps = max(1, math.ceil(math.log(max(largest, 1), ratio)) + 1)
    led = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        further = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = written(led.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return led


def spelling_groups(docs: DataFrame, least: int = LEAST_POINTS, count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word."""
    words = written(vocabulary(docs, least, count), "words")
    largest = words.agg(F.max("n")).first()[0] or 0
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.max("n").alias("own"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    leads = -F.col("best.less") >= ratio * F.col("own")
    found = written(near.select("word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")), "near")
    led = roots(found.filter("form is not null"), largest, ratio)
    out = words.join(found, "word", "left").join(led, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words, their forms and roots."""
    return spelling_groups(table(spark, sf_dir, "documents"))


def oracle() -> str:
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    rounds = ", ".join([f"s{k} AS (SELECT i, {step.format('c')} AS c FROM s{k - 1})" for k in range(1, 9)])
    return f"""
    WITH RECURSIVE s0 AS (SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c FROM range(256)), {rounds},
    entries AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM s8),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_POINTS} GROUP BY doc_id, run),
    bytes AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195::BIGINT, unicode(c) - 64::BIGINT] END)) AS b FROM counted),
    hashed AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295::BIGINT) AS h FROM bytes, entries),
    changed AS (SELECT CASE WHEN h % {DAMAGED_EACH} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= {LEAST_POINTS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    less AS MATERIALIZED (SELECT word, n, p, word[1 : p - 1] || word[p + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
    near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
             UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
             UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
    forms AS MATERIALIZED (SELECT word, n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM best),
    led AS (SELECT word, word AS root FROM words UNION ALL SELECT led.word, form FROM led JOIN forms ON led.root = forms.word WHERE form IS NOT NULL),
    ends AS (SELECT led.word, root FROM led LEFT JOIN forms ON led.root = forms.word WHERE form IS NULL)
    SELECT w.word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM words w JOIN ends USING (word) LEFT JOIN forms USING (word)
    """
