"""Quality rules: one threshold table compiled into one Spark projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS

#: Very frequent function words of the four languages of the corpus, lower case.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "with", "der", "die", "und", "das", "von", "zu", "mit", "de", "la", "le", "les", "et", "des", "el", "los", "que", "y", "en", "un"]

#: (name, numerator, comparison, factor, denominator, from how many words on): the rule fails a text where
#: 100 * numerator <comparison> factor * denominator. Whole numbers only, so that every engine agrees.
THRESHOLDS = [
    ("symbol_ratio", "n_symbols", ">", 10, "n_words", 10),
    ("dup_line_ratio", "n_dup_lines", ">", 30, "n_lines", 10),
    ("mean_word_short", "word_chars", "<", 200, "n_words", 10),
    ("mean_word_long", "word_chars", ">", 1500, "n_words", 10),
    ("stop_word_ratio", "n_stop", "<", 2, "n_words", 50),
]


def let(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda's variable can't be inlined."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeat_words(words: Column, n: int) -> Column:
    """Words within n-word windows that occur twice or more: sort the windows' hashes, mark equal
    neighbours, then add for each marked window the words that the next one does not cover."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        return F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(n)]).alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        return F.array_sort(F.transform(F.filter(at, lambda i: F.coalesce(F.get(s, i)["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, i)["h"] == F.get(s, i + 1)["h"], F.lit(False))), lambda i: F.get(s, i)["i"]))

    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")), lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(n))).alias("n"), i.alias("last")))["n"]
    found = let(let(words, windows), lambda s: covered(marked(s)))
    return F.when(F.size(words) > n, found).otherwise(F.lit(0)).cast("long")


def _rule(row: tuple) -> Column:
    _, num, op, factor, den, least = row
    left, right = F.col(num) * 100, F.col(den) * factor
    return (F.col("n_words") >= least) & ((left > right) if op == ">" else (left < right))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS, stop_words=STOP_WORDS, window: int = 5) -> DataFrame:
    """One row per row of df, in one pass without a shuffle or a user function.

    Null and empty texts have no words and fail the base rule (fewer than 10 words); a denominator of 0
    fails nothing. Repeated rows are judged alike; other columns of df are not read.
    failed_rules: names of the thresholds that the text fails, in the table's order.
    """
    base = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    base = base.withColumn("_w", F.array_remove(F.split("_t", f"[{WS_CLASS}]+"), ""))
    base = base.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{WS_CLASS}]")))
    counted = base.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w"), window).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(stop_words))).cast("long").alias("n_stop"),
    )
    failed = F.array_compact(F.array(*[F.when(_rule(r), F.lit(r[0])) for r in thresholds]))
    judged = counted.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    return judged.withColumn("failed_rules", F.array_join(failed, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def oracle(thresholds=THRESHOLDS, stop_words=STOP_WORDS) -> str:
    """The same in DuckDB over the view documents."""
    words = f"regexp_extract_all(t, '{'[^' + WS_CLASS + ']+'}')"
    rules = ", ".join(f"case when n_words >= {least} and 100 * {num} {op} {factor} * {den} then '{name}' end" for name, num, op, factor, den, least in thresholds)
    stops = ", ".join(f"'{x}'" for x in stop_words)
    return f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
w as (select r, {words} w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{WS_CLASS}]')) l from d),
g as (select r, unnest(generate_series(1, len(w) - 4)) i, w from w where len(w) > 5),
h as (select r, i, count(*) over (partition by r, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) n from g),
p as (select r, i, lag(i) over (partition by r order by i) j from h where n > 1),
q as (select r, sum(least(i - coalesce(j, -5), 5)) n from p group by r),
c as (select d.doc_id, len(w.w)::bigint n_words, length(regexp_replace(t, '[{WS_CLASS}]', '', 'g'))::bigint word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
 coalesce(q.n, 0)::bigint n_repeat_words, len(l)::bigint n_lines, len(list_filter(w.w, lambda x: lower(x) in ({stops})))::bigint n_stop
 from d join w using (r) left join q using (r)),
f as (select *, n_words < 10 or n_repeat_words * 100 > n_words * 20 as base_failed, array_to_string(list_filter([{rules}], lambda x: x is not null), ',') failed_rules from c)
select *, not base_failed and failed_rules = '' as kept from f"""
