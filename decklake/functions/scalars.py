"""Scalar expressions: text, colours, geometry. All are Column functions, evaluated in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from decklake.functions.constants import BULLETS, COLOUR_TOLERANCE, EMU_PER_INCH, OTHER_BULLET, PALETTE, SIZE_TOLERANCE_PT, TITLE_WIDTH_IN

#: The white space of ECMAScript, inside a character class.
WHITE = r"\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def inches(emu: Column) -> Column:
    return emu / EMU_PER_INCH


def trimmed(text: Column) -> Column:
    """Without leading and trailing ECMAScript white space."""
    return F.regexp_replace(text, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def one_line(text: Column) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return trimmed(F.regexp_replace(text, f"[{WHITE}]+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text), F.lit("")) == ""


def plain_quotes(text: Column) -> Column:
    """``one_line`` with straight quotes; case is kept."""
    return one_line(F.translate(text, "‘’“”", "''\"\""))


def ends_with_punctuation(text: Column, marks: str = ".,;") -> Column:
    return trimmed(text).rlike(rf"[{marks}]\z")


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(trimmed(text), r"[.,;]+\z", "")


def estimated_lines(text: Column, size_pt: float, width_in: Column | float = TITLE_WIDTH_IN, breaks: Column | int = 0) -> Column:
    """Lines that a text of a size fills in a box: characters a line from the box's inner width, by segment."""
    width = F.greatest(F.lit(0.5), (width_in if isinstance(width_in, Column) else F.lit(width_in)) - 0.2)
    each = F.greatest(F.lit(1.0), F.floor(width * 72 / F.lit(size_pt * 0.48)).cast("double"))
    rows = F.transform(F.split(text, "\n"), lambda s: F.greatest(F.lit(1), F.ceil(F.length(s) / each)).cast("bigint"))
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, x: a + x) + breaks


def title_room(width_in: Column) -> Column:
    """Most characters of a title of three lines."""
    return (F.greatest(F.lit(20), F.floor((width_in - 0.2) * 72 / (24 * 0.48))) * 3).cast("bigint")


def shortened(text: Column, most: Column) -> Column:
    """Whole sentences that fit, if they are enough of the text; else a cut at the last space; no closing punctuation."""
    sentences = F.split(text, r"(?<=[.!?])\s+")

    def take(s: Column, x: Column) -> Column:
        joined = F.when(s["out"] == "", x).otherwise(F.concat_ws(" ", s["out"], x))
        fits = ~s["full"] & (F.length(joined) <= most)
        return F.struct(F.when(fits, joined).otherwise(s["out"]).alias("out"), (~fits).alias("full"))

    whole = F.aggregate(sentences, F.struct(F.lit("").alias("out"), F.lit(False).alias("full")), take, lambda s: s["out"])
    cut = F.substr(text, F.lit(1), most.cast("int"))
    space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    at_space = F.when(space > 0.6 * most, F.substr(cut, F.lit(1), space.cast("int"))).otherwise(cut)
    enough = F.length(whole) >= F.least(0.5 * most, 0.35 * F.length(text))
    return F.when(F.length(text) <= most, without_punctuation(text)).otherwise(without_punctuation(F.when(enough & (whole != ""), whole).otherwise(at_space)))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), f"[{WHITE}]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; two empty texts are alike."""
    x, y = word_set(a), word_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def is_family(font: Column, family: str = "calibri") -> Column:
    """Unknown fonts count as right."""
    return font.isNull() | (font == "") | F.lower(font).startswith(family)


def size_differs(size: Column, wanted: float, tolerance: float = SIZE_TOLERANCE_PT) -> Column:
    return F.abs(size - wanted) > tolerance


def hex_colour(text: Column) -> Column:
    """Six upper-case hex digits, else null."""
    raw = F.upper(F.regexp_replace(trimmed(text), "^#", ""))
    six = F.when(F.length(raw) == 8, F.substr(raw, F.lit(3), F.lit(6))).otherwise(raw)
    return F.when(six.rlike(r"^[0-9A-F]{6}\z"), six)


def channels(colour: Column) -> list[Column]:
    return [F.conv(F.substr(colour, F.lit(i), F.lit(2)), 16, 10).cast("int") for i in (1, 3, 5)]


def nearest_colour(colour: Column, palette: Sequence[str] = PALETTE) -> Column:
    """Struct (d2, at, colour) of the nearest palette colour: squared distance, earliest of equals. Null for null."""
    known = [{"at": i, "colour": c, "r": int(c[:2], 16), "g": int(c[2:4], 16), "b": int(c[4:], 16)} for i, c in enumerate(palette)]
    entries = F.from_json(F.lit(json.dumps(known)), "array<struct<at:int,colour:string,r:int,g:int,b:int>>")  # one literal, not hundreds

    def far(rgb: Column, e: Column) -> Column:
        """Distance and place in one number, which is soon compared."""
        d = [rgb[n] - e[n] for n in "rgb"]
        return F.shiftleft((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).cast("bigint"), 32) + e["at"]

    def named(key: Column) -> Column:
        at = key.bitwiseAND(F.lit(2**32 - 1)).cast("int")
        return F.when(key.isNotNull(), F.struct(F.shiftright(key, 32).cast("int").alias("d2"), at.alias("at"), F.get(entries, at)["colour"].alias("colour")))

    # variables of transforms, so that a row's channels are read once, not for each entry
    rgb = F.struct(*[c.alias(n) for c, n in zip(channels(colour), "rgb")])
    least = F.transform(F.array(rgb), lambda x: F.array_min(F.transform(entries, lambda e: far(x, e))))
    return F.when(colour.isNotNull(), F.get(F.transform(least, named), 0))


def on_palette(colour: Column, palette: Sequence[str] = PALETTE, tolerance: int = COLOUR_TOLERANCE) -> Column:
    """Unknown colours count as right."""
    return colour.isNull() | (nearest_colour(colour, palette)["d2"] <= tolerance * tolerance)


def overlap_area(a: Column, b: Column) -> Column:
    """Shared area of two rectangles with x, y, cx, cy."""
    across = F.least(a["x"] + a["cx"], b["x"] + b["cx"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["cy"], b["y"] + b["cy"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; without this, each mention of it is, and the code may grow beyond what the JVM compiles."""
    return F.get(F.transform(F.array(value), body), 0)


def fixed(x: Column, digits: int = 2) -> Column:
    """A number with so many decimals, rounded by its exact binary value, ties away from zero: what is stored as 1.005 is less than that
    and gives 1.00. Numbers of 1e21 and more, and those that are none, as ECMAScript writes them.

    Whole and fractional part are split without loss; the fraction, as a multiple of 2 ** -62, is multiplied and rounded in integers.
    """
    scale = 10**digits

    def parts(a: Column, whole: Column) -> Column:
        return once(((a - whole) * 2.0**62).cast("bigint"), lambda part: once(cents(part), lambda c: joined((whole + F.floor(c / scale)).cast("string"), c % scale)))

    def cents(part: Column) -> Column:
        high, low = F.shiftright(part, 31), part.bitwiseAND(F.lit(2**31 - 1))
        return F.shiftright(scale * high + 2**30 + F.shiftright(scale * low, 31), 31)

    def joined(units: Column, rest: Column) -> Column:
        return F.concat(units, F.lit("."), F.lpad(rest.cast("string"), digits, "0")) if digits else units

    def large(a: Column, big: Column) -> Column:
        return joined((big.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + (a - big * 2.0**32).cast("decimal(10,0)")).cast("string"), F.lit(0))

    def said(a: Column) -> Column:
        power = F.regexp_replace(F.regexp_replace(a.cast("string"), r"\.0E", "E"), "E", "e+")
        special = F.when(F.isnan(a), "NaN").when(a == float("inf"), "Infinity").when(a >= 1e21, power)
        return special.when(a < 2.0**53, once(F.floor(a).cast("bigint"), lambda whole: parts(a, whole))).otherwise(once(F.floor(a / 2.0**32), lambda big: large(a, big)))

    shown = once(F.abs(x.cast("double")), said)
    return F.when((x < 0) & ~F.isnan(x), F.concat(F.lit("-"), shown)).otherwise(shown)


def bullet_glyph(kind: Column, char: Column, font: Column) -> Column:
    """What a bullet shows: characters of symbol fonts, in their private range or not, as the signs that they draw; null without a bullet."""
    code = F.ascii(char)
    plain = F.when((code >= 0xF000) & (code <= 0xF0FF) & (F.length(char) == 1), F.char((code - 0xF000).cast("bigint"))).otherwise(char)

    def drawn(name: str) -> Column:
        known = F.create_map(*[F.lit(x) for pair in BULLETS[name].items() for x in pair])
        return F.coalesce(F.try_element_at(known, plain), F.lit(OTHER_BULLET[name]))

    dot, family = F.lit("•"), F.lower(F.coalesce(font, F.lit("")))
    shown = F.when(family.contains("wingdings"), drawn("wingdings")).when(family == "symbol", drawn("symbol")).otherwise(char)
    return F.when(kind == "auto", dot).when(kind == "char", F.when(F.coalesce(char, F.lit("")) == "", dot).otherwise(shown))


def cell_rect(rect: Column, widths: Column, heights: Column, row: Column, col: Column, row_span: Column | None = None, grid_span: Column | None = None) -> Column:
    """The rectangle of a table's cell: sums of the columns before it and of the rows above. Spans widen it by the columns and rows
    that there are; unknown sizes count as zero. Null without the table's rectangle, or where the cell is outside its table.
    """

    def along(sizes: Column, at: Column, span: Column | None) -> tuple[Column, Column]:
        known = F.transform(sizes, lambda n: F.coalesce(n.cast("double"), F.lit(0.0)))
        total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, n: a + n)
        many = F.lit(1) if span is None else F.greatest(F.coalesce(span, F.lit(1)), F.lit(1))
        return total(F.slice(known, F.lit(1), at)), total(F.slice(known, at + 1, many))

    inside = rect.isNotNull() & (row >= 0) & (col >= 0) & (row < F.size(heights)) & (col < F.size(widths))
    (x, cx), (y, cy) = along(widths, F.greatest(col, F.lit(0)), grid_span), along(heights, F.greatest(row, F.lit(0)), row_span)
    return F.when(inside, F.struct((rect["x"] + x).alias("x"), (rect["y"] + y).alias("y"), cx.alias("cx"), cy.alias("cy")))


def centre_x(r: Column) -> Column:
    return r["x"] + r["cx"] / 2


def replaced(text: Column, search: str, replacement: str, ignore_case: bool = False, regex: bool = False) -> Column:
    """Every match replaced; a regex replacement also collapses runs of white space and trims."""
    pattern = search if regex else "".join("\\" + c if not c.isalnum() and not c.isspace() and c != "_" else c for c in search)
    out = F.regexp_replace(text, f"(?i){pattern}" if ignore_case else pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))
    return one_line(out) if regex else out


def theme_font(name: Column, major: Column, minor: Column) -> Column:
    return F.when(name.startswith("+mj"), major).when(name.startswith("+mn"), minor).otherwise(name)


def style_family(ph_type: Column) -> Column:
    """Which of the master's text styles a placeholder takes; untyped shapes take the body's."""
    return F.when(ph_type.isin("title", "ctrTitle"), "title").when(ph_type.isNull() | ph_type.isin("body", "subTitle"), "body").otherwise("other")


def points_in(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*pt", 1).try_cast("double")


def first_quoted(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "[\"“]([^\"”]+)[\"”]", 1), F.lit(""))


def loose_json(text: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
