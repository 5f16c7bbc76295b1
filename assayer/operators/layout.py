"""Positioned text: hidden runs, columns, reading order, repeated lines, layout signals.

Input is ``layout_spans``: ``doc_id``, ``page``, ``line``, ``text``, ``font``,
``size``, ``color``, ``flags``, ``x0``, ``y0``, ``x1``, ``y1``, ``page_width``,
``page_height``. A PDF library is not part of this package.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import lexicon

STEP_SHARES = range(20, 81)
MARGIN, LARGE_IMAGE, COVERING_IMAGE = 0.08, 0.25, 0.55


def is_hidden(size: Column, color: Column) -> Column:
    """Too small to see, or nearly white."""
    white = (F.shiftright(color, 16).bitwiseAND(255) >= 0xF0) & (F.shiftright(color, 8).bitwiseAND(255) >= 0xF0) & (color.bitwiseAND(255) >= 0xF0)
    return (size < 1.5) | white


def is_bold(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | F.lower(font).contains("bold")


def is_italic(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(2) != 0) | F.lower(font).rlike("italic|oblique")


def font_family(font: Column) -> Column:
    """A font's name without subset prefix and style."""
    return F.lower(F.replace(F.substring_index(F.substring_index(F.substring_index(font, "+", -1), "-", 1), ",", 1), F.lit(" "), F.lit("")))


def is_safe_font(font: Column) -> Column:
    return F.exists(F.array(*map(F.lit, lexicon.SAFE_FONTS)), lambda x: F.contains(font_family(font), x))


def lines(spans: DataFrame, by: Sequence[str] = ("doc_id", "page", "line")) -> DataFrame:
    """Spans of a line as one row: text in order of x, box, largest size, whether bold (any span) and hidden (all non-blank ones).

    Spans are dealt by document, the first of ``by``, so that what is done by
    document, page or line afterwards shuffles no texts again.
    """
    shown = F.trim("text") != ""
    parts = F.sort_array(F.collect_list(F.struct("x0", "span", "text")))
    return spans.repartition(by[0]).groupBy(*by).agg(
        F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max(F.when(shown, F.col("size"))).alias("size"),
        F.coalesce(F.bool_or(shown & is_bold(F.col("flags"), F.col("font"))), F.lit(False)).alias("bold"),
        F.coalesce(F.bool_and(F.when(shown, is_hidden(F.col("size"), F.col("color")))), F.lit(False)).alias("hidden"),
        F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"),
    )


def _with_gutters(lines_: DataFrame, by: Sequence[str] = ("doc_id", "page"), least_lines: int = 6, least_width: float = 0.03, least_side: float = 0.15) -> DataFrame:
    """Lines with ``gutters`` of their page, left and right edges, null or empty if it has none; by windows, so that lines stay where they are.

    Marks that no line crosses are bits of a number. A gutter is ``wide`` steps wide
    at least and a crossed mark parts it from the next, so a page has ``most`` at most.
    """
    page, first, n_marks = Window.partitionBy(*by), STEP_SHARES[0], len(STEP_SHARES)
    wide = next((n for n in range(n_marks) if n / 100 >= least_width), n_marks)
    most = max(1, (n_marks + 1) // (wide + 2))
    left_edge, right_edge = F.col("x0") / F.col("page_width"), F.col("x1") / F.col("page_width")
    crossed = [F.when((left_edge < i / 100) & (right_edge > i / 100), F.lit(1 << (i - first)).cast("long")).otherwise(F.lit(0).cast("long")) for i in STEP_SHARES]
    out = lines_.withColumn("__crossed", reduce(Column.bitwiseOR, crossed)).withColumns({"__n": F.count("*").over(page), "__crossed": F.bit_or("__crossed").over(page)})
    free = F.bitwise_not("__crossed").bitwiseAND(F.lit((1 << n_marks) - 1))
    begun = reduce(Column.bitwiseAND, [F.shiftright(free, n) for n in range(wide + 1)])  # marks from which ``wide`` steps are free
    out = out.withColumn("__begun", F.when(F.col("__n") >= least_lines, F.shiftleft(begun, 1)).otherwise(F.lit(0).cast("long")))
    two = lambda at: F.call_function("shiftright", F.col("__begun"), at - first).bitwiseAND(F.lit(3))  # noqa: E731  a mark's bit, above that of the mark before
    marks = F.array(*map(F.lit, STEP_SHARES))
    runs = F.zip_with(F.filter(marks, lambda i: two(i) == 2), F.filter(marks, lambda i: two(i + 1) == 1), lambda a, b: F.struct((a / 100).alias("left"), ((b + wide) / 100).alias("right")))
    out = out.withColumns({"__runs": F.when(F.col("__begun") != 0, runs), "__left_edge": left_edge, "__right_edge": right_edge})
    run = [F.get("__runs", F.lit(k)) for k in range(most)]
    sides = {f"__left{k}": F.count_if(F.col("__right_edge") <= r["left"]).over(page) for k, r in enumerate(run)} | {f"__right{k}": F.count_if(F.col("__left_edge") >= r["right"]).over(page) for k, r in enumerate(run)}
    kept = [F.when((F.col(f"__left{k}") / F.col("__n") >= least_side) & (F.col(f"__right{k}") / F.col("__n") >= least_side), r) for k, r in enumerate(run)]
    return out.withColumns(sides).select(*lines_.columns, F.when(F.col("__begun") != 0, F.array_compact(F.array(*kept))).alias("gutters"))


def gutters(lines_: DataFrame, by: Sequence[str] = ("doc_id", "page"), least_lines: int = 6, least_width: float = 0.03, least_side: float = 0.15) -> DataFrame:
    """Vertical strips that no line crosses: keys, ``left``, ``right`` (shares of the page width).

    Every hundredth from 20 to 80 % of the width is a candidate; neighbours merge;
    a gutter is wide enough and has lines enough on both sides.
    """
    pages = _with_gutters(lines_.select(*by, "x0", "x1", "page_width"), by, least_lines, least_width, least_side).groupBy(*by)
    return pages.agg(F.first("gutters").alias("gutters")).select(*by, F.inline("gutters"))


def reading_order(lines_: DataFrame, gutters_: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Lines with ``column`` (gutters to the left), ``ord``, and ``start`` and ``end`` offsets in the text that they make.

    Without ``gutters_`` those of ``gutters`` are found on the way, and lines that
    are dealt by document already are not shuffled again.
    """
    if gutters_ is None:
        known = F.col(doc).isNotNull() & F.col("page").isNotNull()
        placed = _with_gutters(lines_, (doc, "page")).withColumn("cuts", F.when(known, F.col("gutters")["right"])).drop("gutters")
    else:
        placed = lines_.join(gutters_.groupBy(doc, "page").agg(F.sort_array(F.collect_list("right")).alias("cuts")), [doc, "page"], "left")
    column = F.coalesce(F.size(F.filter("cuts", lambda c: F.col("x0") / F.col("page_width") >= c - 0.005)), F.lit(0))
    order = Window.partitionBy(doc).orderBy("page", "column", "__y", "x0", "line")
    before = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = placed.withColumns({"column": column, "__y": F.bround("y0", 1)}).withColumns({"ord": F.row_number().over(order) - 1, "start": F.coalesce(before, F.lit(0)).cast("long")})
    return out.withColumn("end", F.col("start") + F.length("text")).drop("cuts", "__y")


def strip_repeated(lines_: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines without the top (and bottom) line of every page where all pages of a document agree on it, digits aside."""
    key = F.trim(F.regexp_replace("text", r"\d+", ""))
    page, whole = Window.partitionBy(doc, "page"), Window.partitionBy(doc)
    ranked = lines_.withColumn("__rank", F.row_number().over(page.orderBy("y0", "x0", "line"))).withColumn("__last", F.count("*").over(page))
    ranked = ranked.withColumn("__top", F.col("__rank") == 1).withColumn("__bottom", F.col("__rank") == F.col("__last"))
    ranked = ranked.withColumn("__key", F.when(F.col("__top") | F.col("__bottom"), key))
    least, most = ({s: f(F.when(F.col(s), F.col("__key"))).over(whole) for s in ("__top", "__bottom")} for f in (F.min, F.max))
    ranked = ranked.withColumns({"__pages": F.count_if("__top").over(whole)} | {f"{s}_same": (least[s] == most[s]) & (least[s] != "") for s in least})
    gone = F.col(doc).isNotNull() & (F.col("__pages") > 1) & ((F.col("__top") & F.col("__top_same")) | (F.col("__bottom") & F.col("__bottom_same")))
    return ranked.where(~F.coalesce(gone, F.lit(False))).select(*lines_.columns)


def body_size(lines_: DataFrame, by: Sequence[str] = ("doc_id",), *more: Column) -> DataFrame:
    """The upper median of the sizes of non-blank lines, and ``more`` aggregates of the same lines."""
    sizes = F.sort_array(F.collect_list("size"))
    shown = lines_.where(F.trim("text") != "").groupBy(*by).agg(sizes.alias("__s"), *more)
    return shown.withColumn("body_size", F.get("__s", (F.floor(F.size("__s") / 2)).cast("int"))).drop("__s")


def signals(spans: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """What the document checks need, a row a document: pages, characters, images, tables, margins, fonts, hidden lines.

    ``blocks``: ``doc_id``, ``page``, ``kind`` (text, image, table), ``area_share``, ``rows``.
    """
    in_margin = ((F.col("y1") < F.col("page_height") * MARGIN) | (F.col("y0") > F.col("page_height") * (1 - MARGIN))) & (F.length(F.trim("text")) > 3)
    by_doc = spans.groupBy(doc).agg(
        F.max("page").alias("pages"), F.sum(F.length(F.trim("text"))).alias("chars"), F.max(in_margin).alias("has_margin_text"),
        F.collect_set(F.when(~is_safe_font(F.col("font")), font_family(F.col("font")))).alias("unusual_fonts"),
        F.sum((is_hidden(F.col("size"), F.col("color")) & (F.trim("text") != "")).cast("int")).alias("hidden_spans"),
    )
    image = F.col("kind") == "image"
    by_block = blocks.groupBy(doc).agg(F.sum(image.cast("int")).alias("images"), F.max(image & (F.col("area_share") >= LARGE_IMAGE)).alias("has_large_image"), F.max(image & (F.col("area_share") >= COVERING_IMAGE)).alias("has_covering_image"), F.max((F.col("kind") == "table") & (F.col("rows") > 1)).alias("has_table"))
    return by_doc.join(by_block, doc, "left").fillna({"images": 0}).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_large_image", "has_covering_image", "has_table")})
