"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Features are counts over the whole text; a rule compares two of them as integers (feature * scale <op> other * bound), so
every engine decides alike. The projection has no user functions and no shuffle.

Defined results: a null or empty text has no words and fails the base rules; ties and repeated rows do not interact; a very
long text is one row like any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, table

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
PUNCTUATION = ".,;:!?"
WINDOW = 8

#: Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in is that for on with as was it by at from this be are or an a "
    "le la les de des du et un une en que qui dans pour par est au il elle "
    "der die das und ein eine zu von mit ist den im nicht auf "
    "el los las y del con para es se su al lo"
).split()

#: (name, left feature, left factor, operator, right feature or None for 1, right factor): a document is kept if all hold.
BASE_RULES = (
    ("enough_words", "n_words", 1, ">=", None, 20),
    ("few_repeats", "n_repeat_words", 100, "<=", "n_words", 30),
)
RULES = (
    ("words_not_short", "word_chars", 1, ">=", "n_words", 2),
    ("words_not_long", "word_chars", 1, "<=", "n_words", 12),
    ("few_symbols", "n_symbols", 10, "<=", "n_words", 1),
    ("some_stop_words", "n_stop_words", 100, ">=", "n_words", 2),
    ("few_equal_lines", "n_dup_lines", 2, "<=", "n_lines", 1),
)


def compile_rules(rules: tuple) -> Column:
    """The conjunction of a threshold table as one column."""
    out = F.lit(True)
    for _, left, factor, op, right, bound in rules:
        a, b = F.col(left) * factor, F.col(right) * bound if right else F.lit(bound)
        out = out & (a >= b if op == ">=" else a <= b)
    return out


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows of WINDOW words that occur at least twice in the array of word hashes."""
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # A struct keeps the sorted windows bound once, where a lambda variable can see its neighbours.
        again = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        starts = F.transform(again, lambda s: F.array_sort(F.transform(s, lambda x: x["i"])))
        spans = F.transform(starts, lambda s: F.aggregate(F.transform(s, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))
        return F.get(spans, F.lit(0))

    once = F.transform(F.array(windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(n < WINDOW, F.lit(0)).otherwise(F.get(once, F.lit(0))).cast("long")


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and the counts that rules compare, all from built-in functions."""
    text = F.col("text")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    stop = F.transform("words", lambda w: F.translate(w, UPPER + PUNCTUATION, LOWER))
    d = d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter(stop, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_stop_words", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeated_words(F.col("hashes")).alias("n_repeat_words"),
    )


def judge(docs: DataFrame, base: tuple = BASE_RULES, rules: tuple = RULES, **columns) -> DataFrame:
    """The features, base_failed, and kept: the verdict of the whole table of rules."""
    return features(docs, **columns).withColumns({"base_failed": ~compile_rules(base), "kept": compile_rules(base) & compile_rules(rules)})


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents")).select(*columns)


def _sql(rules: tuple) -> str:
    return " and ".join(f"{left} * {factor} {op} {right + ' * ' if right else ''}{bound}" for _, left, factor, op, right, bound in rules)


ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as body, row_number() over () as rid from documents),
w as (select doc_id, rid, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') as words from d),
f as (select doc_id, rid, words, len(words)::bigint as n_words,
      length(translate(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
      (length(body) - length(translate(body, '{SYMBOLS}', '')))::bigint as n_symbols,
      len(list_filter(words, lambda x: list_contains([{', '.join(f"'{x}'" for x in STOP_WORDS)}], translate(x, '{UPPER}{PUNCTUATION}', '{LOWER}'))))::bigint as n_stop_words,
      list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from w),
win as (select rid, i, array_to_string(words[i:i + 7], ' ') as s from (select rid, words, unnest(range(1, n_words - 6)) as i from f where n_words >= 8)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, s) as c from win) where c > 1),
cov as (select rid, count(distinct p)::bigint as n from (select rid, unnest(range(i, i + 8)) as p from dup) group by rid),
g as (select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
      coalesce(cov.n, 0) as n_repeat_words, n_stop_words, len(lines)::bigint as n_lines from f left join cov using (rid))
select *, not ({_sql(BASE_RULES)}) as base_failed, ({_sql(BASE_RULES)}) and ({_sql(RULES)}) as kept from g
"""
