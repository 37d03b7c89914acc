"""Quality rules from the frequency of lines across the documents of a host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.words import plain
from telemill.session import stored

BLANKS = "\x20\x09\x0b\x0c\x0d\n"
REPEAT_WINDOW = 8


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    inner = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(inner == "", none).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def with_base_metrics(docs: DataFrame) -> DataFrame:
    """Replace ``text`` by the counts of the base rules; one pass over each text, no shuffle."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    docs = docs.withColumns(
        {
            "_words": word_array(F.col("text")),
            "_lines": lines,
            "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint"),
        }
    )
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    window = f"""
        case when n_words >= {REPEAT_WINDOW} then
          transform(sequence(1, cast(n_words as int) - {REPEAT_WINDOW - 1}),
                    i -> xxhash64(slice(_hash, i, {REPEAT_WINDOW}))) end"""
    docs = docs.withColumn("_window", F.expr(window))
    # Only texts with a repeated window go on: sort their windows, compare neighbours.
    docs = docs.withColumn(
        "_sorted",
        F.expr(
            """case when size(array_distinct(_window)) < size(_window)
               then sort_array(transform(_window, (h, i) -> struct(h, i))) end"""
        ),
    )
    docs = docs.withColumn(
        "_places",
        F.expr(
            """sort_array(array_distinct(flatten(zip_with(_sorted, slice(_sorted, 2, size(_sorted)),
                 (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>))))))"""
        ),
    )
    repeat = f"""aggregate(_places, struct(0L as n, -{REPEAT_WINDOW} as last),
        (s, p) -> struct(s.n + least({REPEAT_WINDOW}, p - s.last) as n, p as last), s -> s.n)"""
    docs = docs.withColumn("n_repeat_words", F.coalesce(F.expr(repeat), F.lit(0)).cast("bigint"))
    return docs.drop("text", "_words", "_lines", "_hash", "_window", "_sorted", "_places")


def line_hashes(text: Column) -> Column:
    """Distinct lines with a word, as hash and number of words; case and blanks do not tell lines apart."""
    tidy = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(tidy, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.transform(
        F.array_distinct(lines),
        lambda x: F.struct(F.xxhash64(x).alias("line"), (F.regexp_count(x, F.lit(" ")) + 1).alias("words")),
    )


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of these hashes, wherever they stand; the others stay as they are."""

    def named(x: Column) -> Column:
        return F.xxhash64(F.btrim(F.regexp_replace(F.lower(x), r"[\x20\x09\x0B-\x0D]+", " ")))

    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(gone, named(x)))
    return F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(text)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    at_least: int = 10,
    left: float = 0.5,
    with_text: bool = False,
) -> DataFrame:
    """Base counts and the verdict of the line rule; a row for each row.

    A line is removed where more than ``at_least`` different texts of its host
    have it, however many texts the host has. A document is rejected if the base
    rules fail (under 20 words, or over 30 % of them in repeated 8-word
    windows), or if its distinct lines keep less than ``left`` of their words.

    With ``with_text``, ``clean_text`` is the text without the removed lines,
    also where the document is rejected; a null text counts as empty.

    Copies of one text count once for a host, so a text is not rejected for
    having been copied. A null text counts as empty and fails; rows without a
    host form a host of their own; ids may be null or repeated, since texts
    are told apart by content. Other columns are not looked at; an empty table
    gives an empty result.

    Counts are combined before their shuffle. Carrying them back to the texts
    joins on host and line, whose hot keys adaptive execution splits.
    """
    docs = plain(docs, doc_id=id_col, text=text_col, host=host_col).select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host"),
    )
    docs = docs.withColumns(
        {
            "k1": F.xxhash64("text"),
            "k2": F.xxhash64(F.lit(7), "text"),
            "lines": line_hashes(F.col("text")),
        }
    )
    rows = stored(with_base_metrics(docs), "profiles")
    text_key = ["host", "k1", "k2"]
    texts = rows.groupBy(*text_key).agg(F.first("lines").alias("lines"))
    lines = stored(
        texts.select(*text_key, F.explode("lines").alias("l")).select(*text_key, "l.line", "l.words"), "lines"
    )
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > at_least)
    common = stored(common.select("host", "line"), "common")
    lost = lines.join(common, ["host", "line"]).groupBy(*text_key).agg(
        F.sum("words").alias("lost_words"), *([F.collect_set("line").alias("gone")] if with_text else [])
    )
    lost = stored(lost, "lost")
    total = F.aggregate("lines", F.lit(0), lambda s, x: s + x["words"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("line_words", total).join(lost, text_key, "left")
    clean = []
    if with_text:
        whole = docs.groupBy(*text_key).agg(F.first("text").alias("whole"))
        rows = rows.join(whole, text_key)
        gone = F.coalesce("gone", F.array().cast("array<bigint>"))
        clean = [without_lines(F.col("whole"), gone).alias("clean_text")]
    return (
        rows
        .withColumn("n_line_words_removed", F.coalesce("lost_words", F.lit(0)))
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & (F.col("line_words") - F.col("n_line_words_removed") >= left * F.col("line_words"))).alias(
                "kept"
            ),
            "n_line_words_removed",
            *clean,
        )
    )


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Line frequency rules over all documents, with their source as host."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH rows_ AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT r, p, array_to_string(words[p:p + 7], ' ') AS name
    FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS p FROM rows_ WHERE len(words) >= 8)
), repeated AS (
    SELECT r, name FROM windows GROUP BY r, name HAVING count(*) > 1
), covered AS (
    SELECT r, count(DISTINCT place) AS n
    FROM (SELECT r, unnest(range(p, p + 8)) AS place FROM windows SEMI JOIN repeated USING (r, name)) GROUP BY r
), all_lines AS (
    SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows_
), doubled AS (
    SELECT r, count(*) - count(DISTINCT line) AS n FROM all_lines
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), texts AS (
    SELECT DISTINCT host, text FROM rows_
), tidy AS (
    SELECT DISTINCT host, text,
        trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line
    FROM texts
), counted AS (
    SELECT host, text, line, len(string_split(line, ' ')) AS words, count(*) OVER (PARTITION BY host, line) AS n
    FROM tidy WHERE line <> ''
), lost AS (
    SELECT host, text, sum(words)::BIGINT AS line_words,
        coalesce(sum(words) FILTER (WHERE n > 10), 0)::BIGINT AS gone
    FROM counted GROUP BY host, text
), base AS (
    SELECT rows_.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(doubled.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM rows_ LEFT JOIN doubled USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
        AND coalesce(line_words - gone >= 0.5 * line_words, true) AS kept,
    coalesce(gone, 0)::BIGINT AS n_line_words_removed
FROM base LEFT JOIN lost USING (host, text)
"""
