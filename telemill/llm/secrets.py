"""Secrets: fixed patterns, and strings that look random to character Markov models. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.spans import blanked, counted, joined, matches, replaced
from telemill.llm.words import plain

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: Whole runs of the alphabet with a letter.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{12,}+"
#: Parts with a letter that a slash, dash, underscore or equals sign separates from the rest of their run.
PART = (
    r"(?<![A-Za-z0-9+])(?=[0-9+]*+[A-Za-z])"
    r"(?:(?<=[/_=-])[A-Za-z0-9+]{12,}+|[A-Za-z0-9+]{12,}+(?=[/_=-]))"
)
#: Runs with a letter and a digit, which are not taken for ordinary identifiers.
TOKEN = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{12,}+"
)
#: Samples of a class that the models are trained on, at most, chosen by hash.
SAMPLES = 20000
#: Documents from which the ordinary identifiers are taken, at most, chosen by hash.
SAMPLE_DOCUMENTS = 2000
#: Weight of the frequency of a character alone, in pairs.
SMOOTHING = 5
#: A token is a secret if a character speaks for a random string by this much, on average.
THRESHOLD = 0.75

LABELS = [("assign", "[SECRET]"), ("access", "[SECRET]"), ("hex", "[SECRET]"), ("markov", "[SECRET]")]


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind."""
    anything = lambda value: F.lit(True)
    return F.sort_array(
        F.concat(
            matches(text, ASSIGN, "assign", 0, lambda value: F.length(value) >= 6, group=2),
            matches(text, ACCESS, "access", 1, anything),
            matches(text, HEX, "hex", 2, anything),
        )
    )


def _pairs(strings: DataFrame) -> DataFrame:
    """Pairs of neighbouring characters of ``value``, as places in the alphabet, with their number."""
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    places = strings.select("label", F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)).alias("places"))
    paired = F.zip_with(
        "places", F.slice("places", 2, F.size("places")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    pairs = places.select("label", F.explode(paired).alias("p"))  # the last has no b
    return pairs.where("p.a > 0 and p.b > 0").groupBy("label", "p.a", "p.b").agg(F.count("*").alias("n"))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random against ordinary, by ``a * size + b``.

    The random samples are the values that the fixed patterns find; the
    ordinary ones are words of letters, digits, dashes and underscores of eight
    or more characters that are no ``TOKEN`` themselves. Random strings have no habits, so half of
    their model is the even distribution. Only pair counts come to the driver,
    at most two times the square of the alphabet.
    """
    found = docs.where(F.col("text").rlike(ASSIGN) | F.col("text").rlike(HEX) | F.col("text").rlike(ACCESS))
    value = F.regexp_replace(F.col("s.value"), r"^(?i:password|passwd|secret|token|api_?key)[^:=]*[:=]\x20*[\"']?", "")
    values = (
        found.select(F.explode(base_spans(F.col("text"))).alias("s"))
        .select(value.alias("value"))
        .distinct()
        .orderBy(F.xxhash64("value"), "value")
        .limit(SAMPLES)
    )
    chosen = docs.select("text", F.xxhash64("text").alias("h"))
    ids = chosen.select("h").distinct().orderBy("h").limit(SAMPLE_DOCUMENTS)
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9_-]{8,}+"), F.lit(0))
    names = (
        chosen.join(ids, "h", "left_semi")
        .select(F.explode(words).alias("value"))
        .where(~F.col("value").rlike("[0-9]{4}") & ~F.col("value").rlike(TOKEN))
        .distinct()
        .orderBy(F.xxhash64("value"), "value")
        .limit(SAMPLES)
    )
    both = values.withColumn("label", F.lit(1)).unionByName(names.withColumn("label", F.lit(0)))
    size = len(ALPHABET)
    counts = [[[0] * size for _ in range(size)] for _ in range(2)]
    for row in _pairs(both.where("length(value) > 1")).collect():
        counts[row["label"]][row["a"] - 1][row["b"] - 1] += row["n"]
    single = []  # frequency of each character in a class
    for pairs in counts:
        columns = [sum(row[b] for row in pairs) for b in range(size)]
        single.append([(n + 0.5) / (sum(columns) + 0.5 * size) for n in columns])
    table = []
    for a in range(size):
        for b in range(size):
            ordinary, random = (
                (counts[label][a][b] + SMOOTHING * single[label][b]) / (sum(counts[label][a]) + SMOOTHING)
                for label in (0, 1)
            )
            table.append(math.log((0.5 / size + 0.5 * random) / ordinary))
    return table


def _ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio over the pairs of a token."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(state: Column, char: Column) -> Column:
        place = F.instr(F.lit(ALPHABET), char)
        pair = (state["last"] - 1) * len(ALPHABET) + place
        more = F.when(state["last"] > 0, F.element_at(ratios, pair)).otherwise(F.lit(0.0))
        return F.struct(place.alias("last"), (state["sum"] + more).alias("sum"))

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda state: state["sum"]) / (F.length(value) - 1)


def with_secrets(docs: DataFrame) -> DataFrame:
    """Add the spans of the fixed patterns and all spans to a table with ``text`` (not null)."""
    table = train(docs)
    found = docs.withColumn("_base", base_spans(F.col("text")))
    rest = F.when(F.size("_base") > 0, blanked(F.col("text"), F.col("_base"))).otherwise(F.col("text"))
    found = found.withColumn("_rest", rest)

    def random(rest: str, pattern: str) -> Column:
        return matches(F.col(rest), pattern, "markov", 3, lambda value: _ratio(value, table) >= THRESHOLD)

    found = found.withColumn("_runs", random("_rest", RUN))
    # Parts are looked for in what the runs leave.
    left = F.when(F.size("_runs") > 0, blanked(F.col("_rest"), F.col("_runs"))).otherwise(F.col("_rest"))
    found = found.withColumn("_left", left).withColumn("_parts", random("_left", PART))
    every = F.sort_array(F.concat("_base", "_runs", "_parts"))
    return found.withColumn("_all", every).drop("_rest", "_left", "_runs", "_parts")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each text: ``doc_id``, counts and spans; a row for each row.

    The fixed patterns come first. In what they leave, a run of 12 or more
    characters of the alphabet with a letter is a secret of kind ``markov`` if
    its mean log-likelihood ratio reaches ``THRESHOLD``; if the whole run does
    not, each of its separated parts of that length is tried. A null
    or empty text has none. Ids may be null or repeated; other columns are not
    looked at; an empty table gives an empty result. One pass, no shuffle.
    """
    docs = plain(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return with_secrets(docs).select(
        "doc_id",
        *[counted(F.col("_base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.col("_all")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with every secret in the text replaced by a mark; null stays null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row").getField(text_col)
    rows = with_secrets(rows.withColumn("text", F.coalesce(text, F.lit(""))))
    clean = F.when(text.isNotNull(), replaced(F.col("text"), F.col("_all"), LABELS))
    columns = [clean if c == text_col else F.col("row").getField(c) for c in docs.columns]
    return rows.select(*[column.alias(c) for column, c in zip(columns, docs.columns)])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
