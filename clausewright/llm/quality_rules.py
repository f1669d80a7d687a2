"""Quality rules: a table of thresholds compiled into one Spark projection, with built-in functions only.

Every measure is a column of one select over the text; the rules are rows of RULES, each a measure with the least and most
it may be. Nothing is shuffled and no user function runs.

The stop-word rule knows the languages of STOP_WORDS. A text most of whose letters are neither Latin nor close to it has no such
measure (null), and a rule whose measure is null passes; a text in Latin letters of another language fails it, so its stop words
belong into the list before such texts are filtered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import read

# Function words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = (
    "the of and to in is that for with was are this from on by as be it at or an not have "
    "le la les de des du et un une que qui dans pour par sur est en au pas ce ne plus "
    "der die das und den dem von mit im ist nicht ein eine zu auf sich des auch es als "
    "el los las que del y una con por para se su al lo como más pero sus "
    "il di che non sono della con per una gli nel alla dei anche più come "
    "os as da do dos das não uma com na no em mais foi ao pelo "
    "de het een van en ik te dat niet zijn op aan met voor maar ook"
).split()

#: Documents with fewer words, or with more than this share of words in repeated windows, fail outright.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: measure, least, most (None: no bound). A document is kept if it meets every row.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.25),
    ("dup_line_share", None, 0.5),
    ("stop_share", 0.05, None),
    ("alpha_word_share", 0.8, None),
    ("letter_share", 0.7, None),
    ("upper_share", None, 0.4),
    ("bullet_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.3),
]

# Expressions that the engine and SQL read alike.
LETTER, UPPER = r"[\p{L}]", r"[\p{Lu}]"
#: Letters beyond Latin and its extensions.
OTHER_SCRIPT = r"[\x{0250}-\x{1DFF}\x{1F00}-\x{1FFF}\x{2C00}-\x{A71F}\x{A800}-\x{FFFF}\x{10000}-\x{3FFFF}]"
BULLET, ELLIPSIS = r"\A[\x20\x09-\x0D]*[-*•‣▪·]", r"(\.\.\.|…)[\x20\x09-\x0D]*\z"


def _repeated_words() -> Column:
    """Words in windows of three that occur twice or more; `srt` has (window code, place) in order, or null if no window repeats."""
    at = lambda i: F.get(F.col("srt"), i)["h"]
    first = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("srt") - 1), lambda k: (at(k) == at(k - 1)) | (at(k) == at(k + 1))),
        lambda k: F.get(F.col("srt"), k)["p"],
    )
    return first


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), mean_word_chars, symbols_per_word, dup_line_share, repeat_share, stop_share, alpha_word_share (words with a letter), letter_share (of the characters in words), upper_share (of the letters), bullet_line_share and ellipsis_line_share (double).

    A null text is empty; an empty text has 0 of everything. Windows of three words are compared by 64-bit codes. `keep` may be any columns of docs, whatever their names; rows are neither dropped nor merged."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    names = [f"k{i}" for i in range(len(keep))]
    base = docs.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    count = lambda pattern: (F.length("t") - F.length(F.regexp_replace("t", pattern + "+", ""))).cast("long")
    words = base.select(
        *names, count(LETTER).alias("letters"), count(UPPER).alias("uppers"), count(OTHER_SCRIPT).alias("others"),
        F.array_remove(F.split(reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), "\t\n\x0b\f\r", F.col("t")), " "), "").alias("w"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "").alias("lines"),
    )
    stops = [x for w in dict.fromkeys(STOP_WORDS) for x in dict.fromkeys((w, w.capitalize()))]
    of = lambda c, test: F.size(F.filter(c, test)).cast("long")
    codes = words.select(
        *names, "n_symbols", "letters", "uppers", "others",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        of("w", lambda x: x.isin(*stops)).alias("stops"),
        of("w", lambda x: x.rlike(LETTER)).alias("alpha_words"),
        of("lines", lambda x: x.rlike(BULLET)).alias("bullets"),
        of("lines", lambda x: x.rlike(ELLIPSIS)).alias("ellipses"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("c"),
    )
    windows = codes.withColumn(
        "win",
        F.when(
            F.size("c") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("c") - 3), lambda i: F.xxhash64(F.get(F.col("c"), i), F.get(F.col("c"), i + 1), F.get(F.col("c"), i + 2))),
        ),
    ).drop("c")
    ordered = windows.withColumn(
        "srt",
        F.when(
            F.size("win") > F.size(F.array_distinct("win")),
            F.sort_array(F.transform(F.col("win"), lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    ).drop("win")
    places = ordered.withColumn("p", F.when(F.col("srt").isNotNull(), _repeated_words())).drop("srt")
    covered = F.size(F.array_union(F.array_union("p", F.transform("p", lambda x: x + 1)), F.transform("p", lambda x: x + 2)))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    counted = places.withColumn("n_repeat_words", F.when(F.col("p").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("p")
    # One generated row a document: a filter on the measures stays above, as pushed down it would work each of them out again and again.
    row = F.struct(
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
        F.when(2 * F.col("others") <= F.col("letters"), per("stops", "n_words")).alias("stop_share"),
        per("alpha_words", "n_words").alias("alpha_word_share"),
        per("letters", "word_chars").alias("letter_share"),
        per("uppers", "letters").alias("upper_share"),
        per("bullets", "n_lines").alias("bullet_line_share"),
        per("ellipses", "n_lines").alias("ellipsis_line_share"),
    )
    return counted.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.inline(F.array(row)))


def base_failed(min_words: int = MIN_WORDS, max_percent: int = MAX_REPEATED_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_percent * F.col("n_words"))


def verdict(rules: list[tuple[str, float | None, float | None]] | None = None) -> Column:
    """The rules as one boolean column over what measures() returns; a rule whose measure is null passes."""
    tests = []
    for name, least, most in RULES if rules is None else rules:
        tests += [F.coalesce(t, F.lit(True)) for t in [F.col(name) >= least] * (least is not None) + [F.col(name) <= most] * (most is not None)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measures(read(spark, sf_dir, "documents"))
    failed = base_failed()
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict()).alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the documents that no rule rejects, with their own columns. Null and empty texts have no words and are dropped; equal rows stay or go alike."""
    columns = docs.columns
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text"))
    return measures(numbered, keep=("row",)).where(~base_failed() & verdict()).select("row.*")
