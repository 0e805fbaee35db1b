"""Quality rules: base counts, and distance of a document's histograms from those of its language.

Column expressions only. Two histograms describe a text: classes of its characters, and common words of its language
against all other words. A language's reference is the mean histogram of its documents that pass the base rules, so it
is made from the whole table; a document far from it by Jensen-Shannon distance is rejected. Too short texts, and
languages with too few documents, are not judged by distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import table
from pitchframe.plans.session import staged, tune

# Common words by language; documents of other languages are compared with all of them.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to a in is that it for was on with be by as this are at from",
    "es": "de la que el en y los se del las por un no con su una es para al lo",
    "fr": "de la le et les des en un du une que pour est qui par dans sur au pas avec",
}
EVERY = sorted({w for words in COMMON.values() for w in words.split()})
# Removed one after another; what a step removes is its class, what stays last is the class of all other characters.
CLASSES = {
    "lower": r"[a-z]+",
    "space": r"[\x20\x09-\x0D]+",
    "wide": r"[^\x00-\x7F]+",
    "mark": r"[.,;:?'()\x22-]+",
    "upper": r"[A-Z]+",
    "digit": r"[0-9]+",
}
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]+"
MIN_BASE_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
# Fewest words of a judged or reference text, fewest reference documents of a language, largest distances.
MIN_WORDS, MIN_DOCS = 50, 20
MAX_CLASS, MAX_COMMON = 0.28, 0.36
# A document has one vote in its language's reference, dealt out in whole parts so that sums have no order.
PARTS, DIGITS = 1_000_000, 9


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _beside_equal(pairs: Column, field: str) -> Column:
    """Of structs sorted by `field`, those with an equal one right before or after them."""
    same = lambda x, k: F.get(pairs, k)[field] == x[field]
    last = F.size(pairs) - 1
    return F.filter(pairs, lambda x, k: ((k > 0) & same(x, k - 1)) | ((k < last) & same(x, k + 1)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more; `words` is a plain column.

    Hashes only find the windows worth comparing, which are then compared word by word.
    """
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))

    def covered(places: Column) -> Column:
        step = lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(WINDOW))).alias("n"), p.alias("last"))
        return F.aggregate(places, zero, step, lambda s: s["n"])

    def compared(near: Column) -> Column:
        texts = F.array_sort(F.transform(near, lambda x: F.struct(F.slice(words, x["i"] + 1, WINDOW).alias("w"), x["i"].alias("i"))))
        return _let(texts, lambda t: covered(F.array_sort(F.transform(_beside_equal(t, "w"), lambda x: x["i"]))))

    def counted(cut: Column) -> Column:
        return _let(cut, sorted_hashes)

    def sorted_hashes(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = _let(placed, lambda p: compared(_beside_equal(p, "h")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(found)

    def windows(hashes: Column, length: int) -> Column:
        """Hashes of all windows of eight from those of windows of `length`, twice as long with each step."""
        if length == WINDOW:
            return counted(F.slice(hashes, F.lit(1), F.size(hashes) - (WINDOW - 1)))
        pairs = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + length)))
        return _let(pairs, lambda p: windows(p, 2 * length))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, 0).otherwise(_let(hashes, lambda h: windows(h, 1))).cast("bigint")


def _common_counts(lang: Column, words: Column) -> Column:
    """Occurrences of each common word of the language, in the order of its list; `words` is a plain column."""

    def counts(listed: list[str]) -> Column:
        # Few words are left, each between its own bars; common words hold none.
        hits = F.concat(F.lit("|"), F.array_join(F.filter(words, lambda w: w.isin(listed)), "||"), F.lit("|"))
        return _let(hits, lambda t: F.array(*[((F.length(t) - F.length(F.replace(t, F.lit(f"|{w}|")))) / (len(w) + 2)).cast("bigint") for w in listed]))

    pick = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for code, listed in COMMON.items():
        pick = pick.when(lang == code, counts(listed.split()))
    return pick.otherwise(counts(EVERY))


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of each row's text: `key`, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes
    (characters of each class), common (occurrences of each common word of the language).

    NULL counts as an empty text; a NULL language and an empty one are the same. Rows are counted one by one, so repeats
    and empty tables need no rule. Other columns are left out.
    """
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")
    )
    left, sizes = rows.withColumn("rest", F.col("t")).withColumn("size0", F.length("t")), []
    for i, pattern in enumerate(CLASSES.values(), 1):
        left = left.withColumn("rest", _without(F.col("rest"), pattern)).withColumn(f"size{i}", F.length("rest"))
        sizes.append(F.col(f"size{i - 1}") - F.col(f"size{i}"))
    classes = F.array(*[s.cast("bigint") for s in sizes], F.col(f"size{len(CLASSES)}").cast("bigint"))
    lines = F.filter(F.split("t", r"\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = left.select("key", "lang", "t", "size0", classes.alias("classes")).withColumns(
        {"words": F.filter(F.split("t", SPACE, -1), lambda w: w != ""), "lines": lines}
    )
    space = list(CLASSES).index("space")
    return counted.select(
        F.col("key").alias(key),
        "lang",
        F.size("words").cast("bigint").alias("n_words"),
        (F.col("size0") - F.get("classes", space)).alias("word_chars"),
        (F.col("size0") - F.length(_without(F.col("t"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        "classes",
        _common_counts(F.col("lang"), F.col("words")).alias("common"),
    )


def _histograms(measured: DataFrame) -> DataFrame:
    """Adds base_failed, judged (long enough to be compared), `_c` and `_w`: histograms of one length for all languages."""
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    # All other words, then the common ones; lists of single languages are filled up with zeros.
    rest = F.array(F.col("n_words") - _total(F.col("common")))
    bins = F.concat(rest, F.col("common"), F.array_repeat(F.lit(0).cast("bigint"), F.lit(len(EVERY)) - F.size("common")))
    return measured.withColumns({"base_failed": failed, "judged": F.col("n_words") >= MIN_WORDS, "_c": F.col("classes"), "_w": bins})


def references(histograms: DataFrame) -> DataFrame:
    """lang, docs, rc, rw: how many documents made the reference of a language, and its two histograms in parts."""

    def shares(counts: Column) -> Column:
        return _let(_total(counts), lambda t: F.transform(counts, lambda v: F.floor(v * PARTS / t)))

    parts = {"rc": shares(F.col("_c")), "rw": shares(F.col("_w"))}
    votes = histograms.filter("judged AND NOT base_failed").select("lang", *[p.alias(r) for r, p in parts.items()])
    made = [F.array(*[F.sum(F.get(r, i)) for i in range(n)]).alias(r) for r, n in zip(parts, (len(CLASSES) + 1, len(EVERY) + 1))]
    return votes.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *made)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two arrays of counts of one length; NULL if one has no counts."""
    part = lambda a, b: F.when(a > 0, a * F.ln(2 * a / (a + b))).otherwise(0.0)
    both = F.struct(_total(p).alias("p"), _total(q).alias("q"))

    def distance(s: Column) -> Column:
        shares = F.zip_with(p, q, lambda x, y: F.struct((x / s["p"]).alias("x"), (y / s["q"]).alias("y")))
        total = F.aggregate(shares, F.lit(0.0), lambda a, e: a + (part(e["x"], e["y"]) + part(e["y"], e["x"])))
        js = F.round(F.sqrt(F.greatest(total / (2 * F.ln(F.lit(2.0))), F.lit(0.0))), DIGITS)
        return F.when((s["p"] > 0) & (s["q"] > 0), js)

    return _let(both, distance)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`measure` with base_failed, class_distance, common_distance (NULL where not judged) and kept.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows of eight. kept: not base_failed, and no
    distance above its limit. Texts of fewer than 50 words, and languages with fewer than 20 documents in their
    reference, are judged by the base rules alone. The reference does not depend on the order of rows; a document that
    occurs n times has n votes in it. An empty table gives an empty table.
    """
    rows = staged(_histograms(measure(df, key, text, lang)))
    refs = references(rows).filter(F.col("docs") >= MIN_DOCS).select(F.col("lang").alias("_lang"), "rc", "rw")
    joined = rows.join(refs, F.col("lang") == F.col("_lang"), "left")
    told = joined.withColumns(
        {
            "class_distance": F.when(F.col("judged"), js_distance(F.col("_c"), F.col("rc"))),
            "common_distance": F.when(F.col("judged"), js_distance(F.col("_w"), F.col("rw"))),
        }
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS) | (F.coalesce("common_distance", F.lit(0.0)) > MAX_COMMON)
    return told.select(
        key, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "common_distance", (~F.col("base_failed") & ~far).alias("kept"),
    )


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    told = judge(table(spark, folder, "documents"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ---- the same in SQL

_WORDS = "[" + ", ".join(f"'{w}'" for w in EVERY) + "]"
_IN_LANG = " ".join(f"WHEN lang = '{c}' THEN [{', '.join(repr(w) for w in ws.split())}]" for c, ws in COMMON.items())


def _sql_class(i: int) -> str:
    text = "t"
    for pattern in list(CLASSES.values())[:i]:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return f"length({text})"


_SQL_CLASSES = ", ".join([f"{_sql_class(i)} - {_sql_class(i + 1)}" for i in range(len(CLASSES))] + [_sql_class(len(CLASSES))])


def _sql_js(p: str, q: str) -> str:
    v = f"list_transform(range(1, len({p}) + 1), lambda i: {{'x': {p}[i] / list_sum({p}), 'y': {q}[i] / list_sum({q})}})"
    term = "CASE WHEN e.{0} > 0 THEN e.{0} * ln(2 * e.{0} / (e.x + e.y)) ELSE 0 END"
    total = f"list_sum(list_transform({v}, lambda e: {term.format('x')} + {term.format('y')}))"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest({total} / (2 * ln(2)), 0)), {DIGITS}) END"


OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
windows AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM cut)),
places AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, sum(least(coalesce(i - before, {WINDOW}), {WINDOW})) AS n FROM places GROUP BY r),
listed AS (
  SELECT *, CASE {_IN_LANG} ELSE {_WORDS} END AS common FROM cut),
measured AS (
  SELECT r, doc_id, lang, len(words) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    [{_SQL_CLASSES}] AS c,
    list_transform(common, lambda w: len(list_filter(words, lambda x: x = w))) AS found
  FROM listed LEFT JOIN repeats USING (r)),
bins AS (
  SELECT *, list_concat([n_words - list_sum(found)], found) AS w,
    n_words < {MIN_BASE_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    n_words >= {MIN_WORDS} AS judged
  FROM measured),
votes AS (
  SELECT lang, unnest(range(1, len(c) + len(w) + 1)) AS i,
    unnest(list_concat(list_transform(c, lambda v: floor(v * {PARTS} / list_sum(c))), list_transform(w, lambda v: floor(v * {PARTS} / list_sum(w))))) AS v
  FROM bins WHERE judged AND NOT base_failed),
summed AS (SELECT lang, i, sum(v) AS v, count(*) AS docs FROM votes GROUP BY lang, i),
refs AS (
  SELECT lang, list(v ORDER BY i)[1:{len(CLASSES) + 1}] AS rc, list(v ORDER BY i)[{len(CLASSES) + 2}:] AS rw
  FROM summed GROUP BY lang HAVING max(docs) >= {MIN_DOCS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (judged AND (coalesce({_sql_js('c', 'rc')}, 0) > {MAX_CLASS} OR coalesce({_sql_js('w', 'rw')}, 0) > {MAX_COMMON})) AS kept
FROM bins LEFT JOIN refs USING (lang)"""
