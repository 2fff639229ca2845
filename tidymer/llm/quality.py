"""Quality rules by distribution divergence.

Base rules fail texts that are short or repeat themselves. A text that passes them is held against the reference of its
language: the shares of character classes, and the shares of common words among each other, summed over all
documents of the language that pass the base rules. The Jensen-Shannon distance (base 2, 0 to 1) to either
must stay within its limit; the distance of classes counts from ``MIN_CHARS`` characters on, that of common words from
``MIN_WORDS`` words on, where a text with fewer than ``MIN_COMMON`` common words is only judged by having none at all.

One pass over the texts writes their counts; references are sums of these, one row for each language.

Nulls and empty texts have no words and fail. Documents without a language are one language, whose common words are those
of all languages; languages without a list are judged by classes only. Repeated rows get equal results. Only id, text and
language are read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BLANKS = " \t\n\x0b\x0c\r"
MIN_N_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_CHARS, MIN_WORDS, MIN_COMMON = 300, 100, 8
MAX_CLASSES, MAX_COMMON = 0.3, 0.75

#: Frequent words of four languages.
COMMON = {
    "de": "der die das und in zu den von mit ist im dem nicht ein eine als auch für auf".split(),
    "en": "the of and to in a is that for it as was with be by on at are this from".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus".split(),
}
#: Character classes besides blanks and a-z: what each pattern takes from a text's words without a-z is its count; the rest is a class of its own.
CLASSES = {"upper": r"[A-Z]+", "digit": r"[0-9]+", "symbol": r"[#*$%&|<>]+", "stop": r"[.,;:!?'\"()-]+", "sign": r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E&&[^#*$%&|<>.,;:!?'\"()-]]+"}
N_CLASSES = len(CLASSES) + 3


def _words(text: Column) -> Column:
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _hashes(words: Column) -> Column:
    """A 64-bit hash of every window of three words."""
    last = F.size(words) - 3
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(last >= 1, windows).otherwise(F.array().cast("array<bigint>"))


def _repeats(hashes: Column) -> Column:
    """Hashes with their places, sorted; none where all differ, as in most texts."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _covered(windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    twice = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda j: F.coalesce(F.get(windows, j)["h"] == F.get(windows, j - 1)["h"], F.lit(False)) | F.coalesce(F.get(windows, j)["h"] == F.get(windows, j + 1)["h"], F.lit(False)))
    at = F.transform(twice, lambda j: F.get(windows, j)["i"])
    return F.when(F.size(windows) > 1, F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))).otherwise(0)


def counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: dict[str, list[str]] = COMMON) -> DataFrame:
    """The base counts of every row, with its class and common-word counts as arrays."""
    text = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("words", _words(F.col("text"))).withColumn("hashes", _hashes(F.col("words"))).withColumn("windows", _repeats(F.col("hashes")))
    text = text.withColumn("joined", F.array_join("words", "")).withColumn("few", F.regexp_replace("joined", "[a-z]+", ""))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    length, joined, few = F.length("text"), F.length("joined"), F.length("few")
    classes = {k: few - F.length(F.regexp_replace("few", p, "")) for k, p in CLASSES.items()}
    taken = [length - joined, joined - few, *classes.values()]
    every = sorted({w for ws in common.values() for w in ws})
    lists = F.lit(None).cast("array<string>")
    for lang, ws in common.items():
        lists = F.when(F.col("lang") == lang, F.array(*map(F.lit, ws))).otherwise(lists)
    lists = F.when(F.col("lang").isNull(), F.array(*map(F.lit, every))).otherwise(F.coalesce(lists, F.array().cast("array<string>")))
    usual = F.filter("words", lambda w: w.isin(every))
    both = text.select("id", "lang", F.size("words").cast("long").alias("n_words"), joined.cast("long").alias("word_chars"), lines.alias("lines"), _covered(F.col("windows")).cast("long").alias("n_repeat_words"), length.alias("n_chars"), F.transform(F.array(*taken), lambda v: v.cast("long")).alias("classes"), usual.alias("usual"), lists.alias("lists"))
    failed = (F.col("n_words") < MIN_N_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rest = (F.col("n_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)).cast("long")
    return both.select(
        "id", "lang", "n_words", "word_chars", F.get("classes", F.lit(2 + list(CLASSES).index("symbol"))).alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"), F.col("n_chars").cast("long").alias("n_chars"),
        F.concat("classes", F.array(rest)).alias("classes"), F.transform("lists", lambda c: F.size(F.filter("usual", lambda w: w == c)).cast("long")).alias("common"),
    )


def references(counted: DataFrame, width: int) -> DataFrame:
    """ref_lang and the summed counts of each language's documents that pass the base rules."""
    n = N_CLASSES
    sums = counted.where(~F.col("base_failed")).groupBy(F.col("lang").alias("ref_lang")).agg(*(F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n)), *(F.sum(F.coalesce(F.get("common", F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(width)))
    return sums.select("ref_lang", F.array(*(f"c{i}" for i in range(n))).alias("ref_classes"), F.array(*(f"w{i}" for i in range(width))).alias("ref_common"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null where either has none."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    shares = F.zip_with(a, b, lambda x, y: F.struct((x / total(a)).alias("p"), (y / total(b)).alias("q")))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    found = F.sqrt(F.greatest(F.aggregate(shares, F.lit(0.0), lambda s, v: s + (part(v["p"], v["q"]) + part(v["q"], v["p"])) / 2), F.lit(0.0)))
    return F.when((total(a) > 0) & (total(b) > 0), found)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: dict[str, list[str]] = COMMON) -> DataFrame:
    """id, the base counts, base_failed, kept, class_distance and common_distance of every row."""
    counted = written(counts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, common=common), "counts")
    known = written(references(counted, len({w for ws in common.values() for w in ws})), "references")
    both = counted.join(known, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    n_common = F.aggregate("common", F.lit(0).cast("long"), lambda a, b: a + b)
    listed = F.slice("ref_common", 1, F.greatest(F.size("common"), F.lit(1)))
    by_class = F.when(F.col("n_chars") >= MIN_CHARS, distance(F.col("classes"), F.col("ref_classes")))
    by_word = F.when((F.col("n_words") >= MIN_WORDS) & (F.size("common") > 0), F.when(n_common >= MIN_COMMON, distance(F.col("common"), listed)).when(n_common == 0, F.lit(1.0)))
    measured = both.withColumns({"class_distance": by_class, "common_distance": by_word})
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASSES) & (F.coalesce("common_distance", F.lit(0.0)) <= MAX_COMMON)
    return measured.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "class_distance", "common_distance")


def oracle() -> str:
    """SQL for DuckDB with the same lists, classes and limits."""
    every = sorted({w for ws in COMMON.values() for w in ws})
    lists = " ".join(f"WHEN lang = '{k}' THEN {v!r}" for k, v in COMMON.items())
    keep = {"upper": r"[^A-Z]+","digit": r"[^0-9]+","symbol": r"[^#*$%&|<>]+","stop": r"""[^.,;:!?''"()\-]+""","sign": r"""[#*$%&|<>.,;:!?''"()\-]|[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"""}
    counts = ", ".join(f"length(regexp_replace(few, '{p}', '', 'g'))" for p in keep.values())
    js = lambda a, b: f"sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda i: (CASE WHEN {a}[i] > 0 THEN {a}[i] / list_sum({a}) * log2(2 * {a}[i] / list_sum({a}) / ({a}[i] / list_sum({a}) + {b}[i] / list_sum({b}))) ELSE 0 END + CASE WHEN {b}[i] > 0 THEN {b}[i] / list_sum({b}) * log2(2 * {b}[i] / list_sum({b}) / ({a}[i] / list_sum({a}) + {b}[i] / list_sum({b}))) ELSE 0 END) / 2)), 0))"
    return rf"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT row, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS s FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3) x),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, s) > 1),
covered AS (SELECT row, count(DISTINCT i + d) AS n FROM twice, range(0, 3) r(d) GROUP BY row),
lines AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM w) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
joined AS (SELECT *, coalesce(array_to_string(words, ''), '') AS joined, regexp_replace(coalesce(array_to_string(words, ''), ''), '[a-z]+', '', 'g') AS few, CASE WHEN lang IS NULL THEN {every!r} {lists} ELSE [] END AS listed FROM w),
counted AS (
    SELECT j.row, doc_id, lang, len(words)::BIGINT AS n_words, length(joined)::BIGINT AS word_chars, length(text) AS n_chars, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, [length(text) - length(joined), length(joined) - length(few), {counts}] AS taken,
        list_transform(listed, lambda u: len(list_filter(words, lambda x: x = u))) AS common
    FROM joined j LEFT JOIN lines l ON l.row = j.row LEFT JOIN covered c ON c.row = j.row),
judged AS (SELECT *, taken[5]::BIGINT AS n_symbols, list_append(taken, n_chars - list_sum(taken)::BIGINT)::DOUBLE[] AS classes, n_words < {MIN_N_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
ref_c AS (SELECT lang, list(s ORDER BY i) AS ref_classes FROM (SELECT lang, i, sum(classes[i]) AS s FROM judged, range(1, 9) r(i) WHERE NOT base_failed GROUP BY ALL) GROUP BY lang),
ref_w AS (SELECT lang, list(s ORDER BY i) AS ref_common FROM (SELECT lang, i, sum(common[i])::DOUBLE AS s FROM judged, range(1, {len(every) + 1}) r(i) WHERE NOT base_failed AND i <= len(common) GROUP BY ALL) GROUP BY lang),
met AS (SELECT j.*, ref_classes, ref_common, list_sum(common) AS n_common, common::DOUBLE[] AS own FROM judged j LEFT JOIN ref_c c ON j.lang IS NOT DISTINCT FROM c.lang LEFT JOIN ref_w w ON j.lang IS NOT DISTINCT FROM w.lang),
measured AS (
    SELECT *, CASE WHEN n_chars >= {MIN_CHARS} THEN {js("classes", "ref_classes")} END AS by_class,
        CASE WHEN n_words >= {MIN_WORDS} AND len(common) > 0 THEN CASE WHEN n_common >= {MIN_COMMON} THEN {js("own", "ref_common")} WHEN n_common = 0 THEN 1.0 END END AS by_word FROM met)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(by_class, 0) <= {MAX_CLASSES} AND coalesce(by_word, 0) <= {MAX_COMMON} AS kept, round(by_class, 6) AS class_distance, round(by_word, 6) AS common_distance FROM measured
"""
