"""Pattern matches with code-point offsets, and their removal, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"
_FIELDS = ("start", "rank", "kind", "end", "value")
#: Spans of a text up to which loops whose cost grows with their square are the cheapest.
FEW = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _blocks(items: Column) -> Column:
    """A list, as a lambda's variable, cut into about as many blocks as a block has elements.

    What adds up along a list grows an array, which copies it with each element:
    n * n copies for one list, n * sqrt(n) in blocks.
    """
    width = F.ceil(F.sqrt(F.size(items) + 1)).cast("int")
    starts = F.sequence(F.lit(0), F.floor(F.size(items) / width).cast("int"))
    return F.transform(starts, lambda b: F.slice(items, b * width + 1, width))


def matches(
    text: Column, pattern: str, kind: str, rank: int, valid: Callable[[Column], Column], group: int = 0
) -> Column:
    """Leftmost non-overlapping matches of a pattern that pass a test of one group, as ``SPAN``.

    The matches and the pieces between them tell the offsets. Patterns have to
    match at least one character, and should not need backtracking.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"), tested.alias("tested"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["value"]), F.lit(0))
        span = F.struct(
            begin.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            part["value"].alias("value"),
        )
        good = part["value"].isNotNull() & F.coalesce(valid(part["tested"]), F.lit(False))
        grown = F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    def behind(state: Column, block: Column) -> Column:
        """A block's spans moved behind the blocks before it."""

        def moved(s: Column) -> Column:
            return F.struct(*[(s[n] + state["at"] if n in ("start", "end") else s[n]).alias(n) for n in _FIELDS])

        return F.struct(
            (state["at"] + block["at"]).alias("at"),
            F.concat(state["out"], F.array(F.transform(block["out"], moved))).alias("out"),
        )

    def in_blocks(items: Column) -> Column:
        blocks = F.transform(_blocks(items), lambda block: F.aggregate(block, start, step))
        lists = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(blocks, lists, behind, lambda state: F.flatten(state["out"]))

    all_spans = _let(
        parts,
        lambda p: F.when(F.size(p) > FEW, in_blocks(p)).otherwise(F.aggregate(p, start, step, lambda s: s["out"])),
    )
    return F.when(text.rlike(pattern), all_spans).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def _disjoint(spans: Column) -> Column:
    """Spans by their start, of one that begins in an earlier one only what goes on behind it, without a kind."""
    piece_type = "struct<start:int,end:int,kind:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{piece_type}>").alias("out"))

    def rest(s: Column, at: Column) -> Column:
        return F.struct(
            F.greatest(at, s["start"]).alias("start"),
            s["end"].alias("end"),
            F.when(s["start"] >= at, s["kind"]).otherwise("").alias("kind"),
        )

    def step(state: Column, s: Column) -> Column:
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.concat(state["out"], F.array(rest(s, state["at"]))).alias("out"),
        )

    def behind(state: Column, block: Column) -> Column:
        return F.struct(
            F.greatest(state["at"], block["at"]).alias("at"),
            F.concat(state["out"], F.array(F.transform(block["out"], lambda s: rest(s, state["at"])))).alias("out"),
        )

    def in_blocks(items: Column) -> Column:
        blocks = F.transform(_blocks(items), lambda block: F.aggregate(block, start, step))
        lists = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{piece_type}>>").alias("out"))
        return F.aggregate(blocks, lists, behind, lambda state: F.flatten(state["out"]))

    return F.filter(_let(F.sort_array(spans), in_blocks), lambda s: s["start"] < s["end"])


def _pieced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with a mark in place of each of many spans; its characters are counted once, not once a span."""

    def put_together(chars: Column, cuts: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["end"]))
        starts = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.size(chars)))
        gaps = F.zip_with(ends, starts, lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), ""))
        marks = F.concat(F.transform(cuts, mark), F.array(F.lit("")))
        return F.array_join(F.zip_with(gaps, marks, lambda gap, m: F.concat(gap, m)), "")

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return _let(chars, lambda c: _let(_disjoint(spans), lambda cuts: put_together(c, cuts)))


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans, so that all offsets stay; spans may overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        begin = F.greatest(state["at"], s["start"])
        gap = F.substr(text, state["at"] + 1, begin - state["at"])
        piece = F.concat(state["out"], gap, F.repeat(F.lit(" "), s["end"] - begin))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["end"] > state["at"], piece).otherwise(state["out"]).alias("out"),
        )

    few = F.aggregate(
        F.sort_array(spans),
        start,
        step,
        lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1, F.length(text))),
    )
    many = _pieced(text, spans, lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))
    return F.when(F.size(spans) > FEW, many).when(F.size(spans) > 0, few).otherwise(text)


def replaced(text: Column, spans: Column, labels: Sequence[tuple[str, str]]) -> Column:
    """The text with each span, in order of their start, replaced by the label of its kind.

    Of a span that begins in an earlier one, what goes on behind it goes without
    a label.
    """
    label = F.create_map(*[F.lit(x) for pair in labels for x in pair])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(state["out"], F.substr(text, state["at"] + 1, s["start"] - state["at"]), label[s["kind"]])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], piece).otherwise(state["out"]).alias("out"),
        )

    few = F.aggregate(
        F.sort_array(spans),
        start,
        step,
        lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1, F.length(text))),
    )
    many = _pieced(text, spans, lambda s: F.when(s["kind"] == "", "").otherwise(label[s["kind"]]))
    return F.when(F.size(spans) > FEW, many).when(F.size(spans) > 0, few).otherwise(text)
