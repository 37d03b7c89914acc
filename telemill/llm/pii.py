"""Personal data: fixed patterns, and terms that give them away. DataFrame functions only.

A term that stands in a text with a protected value discloses it as far as it
lowers the surprise of the value, which corpus co-occurrence estimates: with n
texts, of which n(e) hold the value, n(t) the term and n(e, t) both, PMI = log(n n(e, t) / (n(e) n(t))), and the value alone has log(n / n(e)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.spans import SPAN, blanked, counted, joined, matches, replaced
from telemill.llm.words import plain
from telemill.session import stored

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{4,}+"
KINDS = ("email", "ip", "card", "phone")
LABELS = [*[(kind, f"[{kind.upper()}]") for kind in KINDS], ("term", "[TERM]")]
#: Texts that have to show a term and a value together.
SUPPORT = 3
#: Marks and values of texts up to which they are broadcast.
LISTED = 1_000_000
#: Share of a value's information that a term may not disclose.
DISCLOSURE = 0.8


def _luhn(digits: Column) -> Column:
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(
        values, lambda v, i: F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + v) % 10 == 0


def _card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits).between(13, 19), _luhn(digits))


def _ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))


def _phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> list[Column]:
    """Spans of the fixed patterns, one array for each kind."""
    tests = (lambda value: F.lit(True), _ip, _card, _phone)
    return [
        matches(text, pattern, kind, rank, test)
        for rank, (kind, pattern, test) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), tests))
    ]


def _words(text: Column) -> Column:
    """Hashes of the different terms of a text."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))
    )


def disclosing_terms(found: DataFrame, once: DataFrame) -> DataFrame:
    """The terms that disclose a value, as hashes: ``word``.

    ``found`` has the ``words`` of all texts, ``once`` one of each text with
    protected values and the number of its copies. Counts are of whole
    documents, and cover all of them; copies do not add to the support. Counts
    are combined before their shuffle, and words travel as hashes.
    """
    total = found.count()
    entity = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"]))
    held = once.select("k1", "k2", "copies", F.explode(F.array_distinct(entity)).alias("entity"))
    n_entity = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_entity"))
    n_entity = stored(n_entity.where(F.col("texts") >= SUPPORT).drop("texts"), "entities")
    # No more texts can hold both than hold the value; a term of too many others cannot tell it.
    bound = F.pow("n_entity", F.lit(DISCLOSURE)) * F.pow(F.lit(float(total)), F.lit(1 - DISCLOSURE)) + 1
    most = n_entity.agg(F.max(bound).alias("most")).first()["most"] or 0.0
    n_term = found.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_term"))
    n_term = stored(n_term.where(F.col("n_term").between(SUPPORT, most)), "terms")
    held = stored(held.join(n_entity, "entity"), "held")
    with_entity = once.join(held.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    words = with_entity.select("k1", "k2", F.explode("words").alias("word")).join(n_term, "word")
    together = (
        words.join(held, ["k1", "k2"])
        .where(F.col("n_term") <= bound)
        .groupBy("entity", "word", "n_term", "n_entity")
        .agg(F.count("*").alias("texts"), F.sum("copies").alias("n_both"))
        .where(F.col("texts") >= SUPPORT)
    )
    # PMI >= DISCLOSURE * information of the value, without the common parts.
    telling = F.log(F.col("n_both") / F.col("n_term")) >= (DISCLOSURE - 1) * F.log(total / F.col("n_entity"))
    return together.where(telling).select("word").distinct()


def term_spans(docs: DataFrame, found: DataFrame, once: DataFrame, flagged: DataFrame) -> DataFrame:
    """Spans of the flagged terms outside the values, in all texts: ``k1, k2, terms``."""
    marks = (
        found.select("k1", "k2", F.explode("words").alias("word"))
        .join(flagged, "word", "left_semi")
        .groupBy("k1", "k2")
        .agg(F.collect_set("word").alias("marks"))
    )
    marks = stored(marks.join(once.select("k1", "k2", "base"), ["k1", "k2"], "left"), "marks")
    # Marks go to the texts if they are few; else both are shuffled, and copies split by adaptive execution.
    size = marks.agg(F.sum(F.size("marks") + F.coalesce(F.size("base"), F.lit(0)) + 1)).first()[0] or 0
    marks = F.broadcast(marks) if size <= LISTED else marks.hint("merge")
    texts = docs.select("k1", "k2", "text").join(marks, ["k1", "k2"])
    free = F.when(F.col("base").isNotNull(), blanked(F.col("text"), F.col("base"))).otherwise(F.col("text"))
    # Written first, since a pattern looks at its text more than once.
    texts = stored(texts.select("k1", "k2", "marks", free.alias("free")), "free")
    terms = matches(
        F.col("free"), TERM, "term", len(KINDS), lambda value: F.array_contains(F.col("marks"), F.xxhash64(F.lower(value)))
    )
    # Copies have the same terms; only these are moved.
    return texts.select("k1", "k2", terms.alias("terms")).groupBy("k1", "k2").agg(F.first("terms").alias("terms"))


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """Personal data of each text: ``doc_id``, counts and spans; a row for each row.

    The values of the fixed patterns are the protected entities. A term of four
    or more letters is a span of kind ``term`` if at least ``SUPPORT``
    different texts hold it, anywhere, with a value, and it discloses
    ``DISCLOSURE`` of the value's information; it is marked wherever it stands
    outside a value, also in texts without one.
    With ``with_text``, ``clean_text`` has each value replaced by its kind and
    each term by a mark; a null text counts as empty.

    Ids may be null or repeated, since texts are told apart by content. Other
    columns are not looked at; an empty table gives an empty result.
    """
    docs = (
        plain(docs, doc_id=id_col, text=text_col)
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    )
    # Texts stay where they are; their values and words are kept.
    base = docs.withColumn("base", F.concat(*base_spans(F.col("text"))))
    has = F.size("base") > 0
    base = base.withColumn("words", _words(F.when(has, blanked(F.col("text"), F.col("base"))).otherwise(F.col("text"))))
    found = stored(base.drop("text"), "values")
    once = stored(
        found.where(has)
        .groupBy("k1", "k2")
        .agg(F.first("words").alias("words"), F.first("base").alias("base"), F.count("*").alias("copies")),
        "protected",
    )
    terms = term_spans(docs, found, once, stored(disclosing_terms(found, once), "flagged"))
    terms = stored(terms, "term_spans")
    few = terms.agg(F.sum(F.size("terms") + 1)).first()[0] or 0
    terms = F.broadcast(terms) if few <= LISTED else terms.hint("merge")
    rows = found.drop("words").join(terms, ["k1", "k2"], "left")

    def of_kind(kind: str) -> Column:
        return F.sort_array(F.filter("base", lambda s: s["kind"] == kind))

    listed = F.concat(*map(of_kind, KINDS))
    every = F.concat(listed, F.sort_array(F.coalesce("terms", F.array().cast(SPAN))))
    rows = rows.withColumns({"_base": listed, "_all": every})
    columns = [
        "doc_id",
        *[counted(F.col("_base"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.col("_all")).alias("spans"),
    ]
    if not with_text:
        return rows.select(*columns)
    texts = docs.groupBy("k1", "k2").agg(F.first("text").alias("_whole"))
    clean = replaced(F.col("_whole"), F.col("_all"), LABELS)
    return rows.join(texts, ["k1", "k2"]).select(*columns, clean.alias("clean_text"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
