"""Closed records inside elements: strokes, fills, effects, crops, text styles and charts.

Every contract is one SQL expression over VARIANT values: the first issue in the contract's order, or null.  Items of arrays
are gone through inside the expression, so a contract costs no join and no shuffle, whatever it looks into.  Contracts are
put together as text and parsed once; values and paths are SQL themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as cat

Fault = tuple[str, str]
_names = count()


#: Values that `get` made, by their text: where they were taken from.
_taken: dict[str, tuple[str, str]] = {}


def get(v: str, path: str, kind: str = "variant") -> str:
    """A value below v; what is below a value that was taken itself comes from the same record by one longer path, not out of a copy."""
    v, above = _taken.get(v, (v, "$"))
    path = above + path[1:]
    out = f"try_variant_get({v}, '{path}', '{kind}')"
    if kind == "variant":
        _taken[out] = (v, path)
    return out


def is_kind(v: str, kind: str) -> str:
    return f"coalesce(startswith(schema_of_variant({v}), '{kind}'), false)"


def member_keys(v: str) -> str:
    return f"map_keys(try_variant_get({v}, '$', 'map<string,variant>'))"


def is_record(v: str) -> str:
    """Whether v is a record; no member is looked at."""
    return f"({get(v, '$', 'struct<a:boolean>')} IS NOT NULL)"


def has(v: str, fields: list[str]) -> str:
    """Whether v is a record of these members and no others: a VARIANT has them in the order of their names.

    A member that is taken as a VARIANT is built anew, so none is.
    """
    return yes(f"map_keys({get(v, '$', 'map<string,struct<a:boolean>>')}) = {_words(sorted(fields))}")


def first_of(*parts: Fault | str) -> str:
    """The first issue: of (fault, issue) pairs and of other contracts, in the order given."""
    return "coalesce(" + ", ".join(f"CASE WHEN {p[0]} THEN {p[1]} END" if isinstance(p, tuple) else p for p in parts) + ")"


def when(fault: str, found: str) -> str:
    return f"CASE WHEN {fault} THEN {found} END"


def _fail(path: str, detail: str, capability: str | None = None) -> str:
    detail = detail if detail.startswith("concat(") else f"'{detail}'"
    return f"named_struct('code', 'UNSUPPORTED_CAPABILITY', 'path', {path}, 'detail', {detail}, 'capability', CAST({'NULL' if capability is None else repr(capability)} AS STRING))"


def _join(path: str, tail: str) -> str:
    return f"concat({path}, '{tail}')"


def _words(values: list[str]) -> str:
    return "CAST(array(" + ", ".join(f"'{v}'" for v in values) + ") AS ARRAY<STRING>)"


def yes(x: str) -> str:
    return f"coalesce({x}, false)"


def is_number(v: str) -> str:
    return yes(f"schema_of_variant({v}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)'")


def finite(v: str) -> str:
    """A JSON number that is finite; whole numbers and decimals are, and are not made doubles to learn it."""
    return f"({yes(f"schema_of_variant({v}) RLIKE '^(BIGINT|DECIMAL)'")} OR {is_number(v)} AND {yes(f"abs({get(v, '$', 'double')}) < double('Infinity')")})"


def number(v: str, low: float, high: float, *, below: bool = False) -> str:
    """A JSON number from low to high, or below high."""
    x = get(v, "$", "double")
    return yes(f"{is_number(v)} AND {x} >= {low} AND {x} {'<' if below else '<='} {high}")


def whole(v: str, low: int, high: int) -> str:
    x = get(v, "$", "bigint")
    return yes(f"schema_of_variant({v}) = 'BIGINT' AND {x} >= {low} AND {x} <= {high}")


def string(v: str) -> str:
    """A string that is not empty."""
    return yes(f"{is_kind(v, 'STRING')} AND {get(v, '$', 'string')} <> ''")


def boolean(v: str) -> str:
    return is_kind(v, "BOOLEAN")


def rgb(v: str) -> str:
    return yes(f"{is_kind(v, 'STRING')} AND {get(v, '$', 'string')} RLIKE r'^#[0-9A-Fa-f]{{6}}\\z'")


def among(v: str, values: list[str]) -> str:
    return yes(f"{is_kind(v, 'STRING')} AND {get(v, '$', 'string')} IN (" + ", ".join(f"'{x}'" for x in values) + ")")


def says(v: str, word: str) -> str:
    return among(v, [word])


def is_word(v: str, word: str) -> str:
    """As `says`, for what may be a record as well: a record is no word, and is not described to learn that."""
    return f"(NOT {is_record(v)} AND {says(v, word)})"


def null(v: str) -> str:
    """The JSON null, which is not a member that is absent."""
    return yes(f"schema_of_variant({v}) = 'VOID'")


def closed(v: str, path: str, allowed: list[str], required: list[str] | None = None) -> str:
    """A record with no other members than the allowed ones, and all of the required (by default the allowed) ones."""
    have, required = f"k{next(_names)}", allowed if required is None else required
    odd, gone = (f"array_except({a}, {b})" for a, b in ((have, _words(allowed)), (_words(required), have)))
    told = lambda what, fields: f"concat('{what} fields: ', array_join(array_sort({fields}), ', '))"
    found = first_of(
        (f"{have} IS NULL", _fail(path, "a record is needed")),
        (f"size({odd}) > 0", _fail(path, told("unknown", odd))),
        (f"size({gone}) > 0", _fail(path, told("missing", gone))),
    )
    # the names are listed once for all three, by a function that is interpreted; where all are needed, a right record needs none of it
    listed = f"get(transform(array({member_keys(v)}), {have} -> {found}), 0)"
    return when(f"NOT {has(v, allowed)}", listed) if sorted(required) == sorted(allowed) else listed


def items(v: str) -> str:
    return get(v, "$", "array<variant>")


def each(v: str, path: str, contract: Callable[[str, str], str]) -> str:
    """The first issue of an array's items; contract(item, its path)."""
    x, i = f"x{next(_names)}", f"i{next(_names)}"
    return f"get(filter(transform({items(v)}, ({x}, {i}) -> {contract(x, f"concat({path}, '[', CAST({i} AS STRING), ']')")}), {x} -> {x} IS NOT NULL), 0)"


def exists(array: str, fault: Callable[[str], str]) -> str:
    x = f"x{next(_names)}"
    return f"exists({array}, {x} -> {fault(x)})"


def is_array(v: str, least: int = 1) -> str:
    """An array of so many items; the items are not taken out."""
    return yes(f"size({get(v, '$', 'array<array<boolean>>')}) >= {least}")


# ---- paint


def stroke(v: str, path: str, capability: str | None = "shape.line") -> str:
    p = lambda f: get(v, f"$.{f}")
    return first_of(
        closed(v, path, cat.STROKE_FIELDS),
        (f"NOT {rgb(p('color'))}", _fail(_join(path, ".color"), "#RRGGBB is needed")),
        (f"NOT {whole(p('width'), 1, cat.MAX_LINE_WIDTH)}", _fail(_join(path, ".width"), "a whole number of units from 1 is needed", capability)),
        (f"NOT {among(p('dash'), cat.DASHES)}", _fail(_join(path, ".dash"), "this dash is not drawn")),
        (f"NOT {number(p('opacity'), 0, 1)}", _fail(_join(path, ".opacity"), "0 to 1 is needed")),
    )


def _angle(v: str) -> str:
    """From 0 and under a full circle, after rounding to the stored unit as well."""
    return f"({number(v, 0, 360, below=True)} AND {yes(f'bround({get(v, "$", "double")} * 60000) < 21600000')})"


def _painted(color: str, opacity: str) -> str:
    return f"({rgb(color)} AND {number(opacity, 0, 1)})"


def fill(v: str, path: str) -> str:
    """noFill, a solid colour, or a linear gradient with strictly increasing stops."""
    p = lambda f: get(v, f"$.{f}")
    # the last position, or NaN once one does not rise
    last = f"aggregate({get(p('stops'), '$', 'array<struct<position:double>>')}.position, double('-Infinity'), (a, x) -> IF(x > a, x, double('NaN')))"
    stop = lambda s, at: first_of(
        closed(s, at, ["position", "color", "opacity"]),
        (f"NOT {number(get(s, '$.position'), 0, 1)}", _fail(_join(at, ".position"), "0 to 1 is needed")),
        (f"NOT {_painted(get(s, '$.color'), get(s, '$.opacity'))}", _fail(at, "#RRGGBB and an opacity from 0 to 1 are needed")),
    )
    solid = when(f"NOT {_painted(p('color'), p('opacity'))}", _fail(path, "#RRGGBB and an opacity from 0 to 1 are needed"))
    gradient = first_of(
        (f"NOT {_angle(p('angle'))}", _fail(_join(path, ".angle"), "from 0 and under 360 is needed", "shape.fill.linear_gradient")),
        (f"NOT {is_array(p('stops'), 2)}", _fail(_join(path, ".stops"), "two stops at least are needed")),
        each(p("stops"), _join(path, ".stops"), stop),
        (f"isnan({last})", _fail(_join(path, ".stops"), "positions must rise")),
    )
    odd = first_of(
        closed(v, path, ["type", "color", "opacity", "angle", "stops"], []),
        (says(p("type"), "solid"), _fail(path, "a solid fill has a type, a color and an opacity")),
        (says(p("type"), "linear_gradient"), _fail(path, "a gradient has a type, an angle and stops")),
        _fail(_join(path, ".type"), "solid or linear_gradient is needed"),
    )
    of = lambda word, *fields: f"{has(v, ['type', *fields])} AND {says(p('type'), word)}"
    record = f"CASE WHEN {of('solid', 'color', 'opacity')} THEN {solid} WHEN {of('linear_gradient', 'angle', 'stops')} THEN {gradient} ELSE {odd} END"
    return when(f"NOT {is_word(v, 'noFill')}", record)


def effects(v: str, path: str) -> str:
    """none, or one outer shadow."""
    s, at = get(v, "$.outer_shadow"), _join(path, ".outer_shadow")
    p = lambda f: get(v, f"$.outer_shadow.{f}")
    record = first_of(
        closed(v, path, ["outer_shadow"]),
        closed(s, at, ["color", "opacity", "blur_radius", "distance", "angle"]),
        (f"NOT {_painted(p('color'), p('opacity'))}", _fail(at, "#RRGGBB and an opacity from 0 to 1 are needed")),
        (f"NOT {whole(p('blur_radius'), 0, 2**63 - 1)}", _fail(_join(at, ".blur_radius"), "a whole number from 0 is needed")),
        (f"NOT {whole(p('distance'), 0, 2**63 - 1)}", _fail(_join(at, ".distance"), "a whole number from 0 is needed")),
        (f"NOT {_angle(p('angle'))}", _fail(_join(at, ".angle"), "from 0 and under 360 is needed", "shape.effect.shadow")),
    )
    return when(f"NOT {is_word(v, 'none')}", record)


def crop(v: str, path: str) -> str:
    sides = ["left", "top", "right", "bottom"]
    n = lambda f: get(v, f"$.{f}", "double")
    return first_of(
        closed(v, path, sides),
        (" OR ".join(f"NOT {number(get(v, f'$.{f}'), 0, 1, below=True)}" for f in sides), _fail(path, "shares from 0 and under 1 are needed")),
        (f"{n('left')} + {n('right')} >= 1 OR {n('top')} + {n('bottom')} >= 1", _fail(path, "opposite shares must leave something")),
    )


def _font_size(v: str) -> str:
    return number(v, 1, 4000)


def text_style(v: str, path: str) -> str:
    p, m = lambda f: get(v, f"$.{f}"), lambda f: get(v, f"$.margins.{f}")
    right = [string(p("font_name")), _font_size(p("font_size")), whole(p("font_weight"), 1, 1000), rgb(p("color")), boolean(p("italic")), among(p("alignment"), cat.ALIGNMENTS), among(p("vertical_alignment"), cat.VERTICAL_ALIGNMENTS), boolean(p("wrap"))]
    return first_of(
        closed(v, path, cat.TEXT_STYLE_FIELDS),
        closed(p("margins"), _join(path, ".margins"), ["left", "right", "top", "bottom"]),
        *[(f"NOT {whole(m(side), 0, 2**31 - 1)}", _fail(_join(path, f".margins.{side}"), "a whole number of 31 bits is needed")) for side in ("bottom", "left", "right", "top")],
        (f"NOT ({' AND '.join(right)})", _fail(path, "a value is not allowed")),
    )


def _rotation(style: str, path: str) -> Fault:
    r = get(style, "$.rotation")
    return f"{r} IS NOT NULL AND NOT {number(r, -360, 360)}", _fail(_join(path, ".rotation"), "-360 to 360 is needed")


def shape(style: str, path: str) -> str:
    """What a shape is painted with: its rounding, fill, line, effects and rotation, in this order."""
    p = lambda f: get(style, f"$.{f}")
    rounded, x = says(p("shape_type"), "roundRect"), get(style, "$.adjustments[0]", "double")
    one = f"({is_array(p('adjustments'))} AND size({items(p('adjustments'))}) = 1 AND {number(get(style, '$.adjustments[0]'), 0, 0.5)} AND {yes(f'{x} > 0 AND bround({x} * 100000) BETWEEN 1 AND 50000')})"
    return first_of(
        (f"NOT {among(p('shape_type'), cat.SHAPES)}", _fail(_join(path, ".shape_type"), "this shape is not drawn")),
        (f"{rounded} AND NOT {one}", _fail(_join(path, ".adjustments"), "one value over 0 and up to 0.5 is needed", "shape.roundRect.adjustment")),
        (f"NOT {rounded} AND {p('adjustments')} IS NOT NULL", _fail(_join(path, ".adjustments"), "only roundRect has adjustments")),
        *[when(f"{p(f)} IS NOT NULL", c(p(f), _join(path, f".{f}"))) for f, c in (("fill", fill), ("line", stroke), ("effects", effects))],
        _rotation(style, path),
    )


def line(style: str, path: str) -> str:
    p = lambda f: get(style, f"$.{f}")
    return first_of(
        (f"{p('line')} IS NULL", _fail(_join(path, ".line"), "a line is needed")),
        stroke(p("line"), _join(path, ".line"), "line.stroke"),
        *[(f"{p(f)} IS NOT NULL AND NOT {among(p(f), cat.ARROWS)}", _fail(_join(path, f".{f}"), "this arrow head is not drawn")) for f in ("head_arrow", "tail_arrow")],
        _rotation(style, path),
    )


# ---- charts


def chart_font(v: str, path: str, *, named: bool = True) -> str:
    p = lambda f: get(v, f"$.{f}")
    return first_of(
        *([(f"NOT {string(p('font_name'))}", _fail(_join(path, ".font_name"), "a name is needed"))] if named else []),
        (f"NOT {_font_size(p('font_size'))}", _fail(_join(path, ".font_size"), "1 to 4000 points")),
        (f"NOT {whole(p('font_weight'), 1, 1000)}", _fail(_join(path, ".font_weight"), "a whole number from 1 to 1000 is needed")),
        (f"NOT {rgb(p('color'))}", _fail(_join(path, ".color"), "#RRGGBB is needed")),
    )


def chart_line(v: str, path: str) -> str:
    return when(f"NOT {is_word(v, 'noFill')}", stroke(v, path, None))


def chart_area(v: str, path: str) -> str:
    f, at = get(v, "$.fill"), _join(path, ".fill")
    solid = first_of(
        closed(f, at, ["type", "color", "opacity"]),
        (f"NOT {says(get(f, '$.type'), 'solid')}", _fail(_join(at, ".type"), "solid or noFill is needed")),
        (f"NOT {rgb(get(f, '$.color'))}", _fail(_join(at, ".color"), "#RRGGBB is needed")),
        (f"NOT {number(get(f, '$.opacity'), 0, 1)}", _fail(_join(at, ".opacity"), "0 to 1 is needed")),
    )
    return first_of(closed(v, path, ["fill", "line"]), when(f"NOT {is_word(f, 'noFill')}", solid), chart_line(get(v, "$.line"), _join(path, ".line")))


def chart_legend(v: str, path: str) -> str:
    p = lambda f: get(v, f"$.{f}")
    return first_of(
        closed(v, path, cat.LEGEND_FIELDS),
        (f"NOT ({boolean(p('enabled'))} AND {boolean(p('overlay'))})", _fail(path, "enabled and overlay are true or false")),
        (f"NOT {among(p('position'), cat.SIDES)}", _fail(_join(path, ".position"), "this place is not offered")),
        chart_font(v, path),
    )


def _labels(v: str, path: str, fields: list[str], flags: list[str], place: str, named: bool) -> str:
    p = lambda f: get(v, f"$.{f}")
    return first_of(
        closed(v, path, fields),
        *[(f"NOT {boolean(p(f))}", _fail(_join(path, f".{f}"), "true or false is needed")) for f in flags],
        (f"NOT ({place})", _fail(_join(path, ".position"), "this place is not offered")),
        (f"NOT {string(p('number_format'))}", _fail(_join(path, ".number_format"), "a format is needed")),
        chart_font(v, path, named=named),
    )


def cartesian_labels(v: str, path: str, chart_type: str) -> str:
    at = get(v, "$.position")
    place = f"CASE WHEN {chart_type} = 'line' THEN {among(at, cat.LINE_LABEL_PLACES)} ELSE {among(at, cat.BAR_LABEL_PLACES)} END"
    return _labels(v, path, cat.CARTESIAN_LABEL_FIELDS, ["enabled", "show_category", "show_series_name", "show_value"], place, True)


def _side(v: str, path: str, chart_type: str, bars: list[str], others: list[str]) -> Fault:
    at = get(v, "$.position")
    return f"NOT CASE WHEN {chart_type} = 'bar' THEN {among(at, bars)} ELSE {among(at, others)} END", _fail(_join(path, ".position"), "this side is not the chart''s")


def category_axis(v: str, path: str, chart_type: str) -> str:
    p = lambda f: get(v, f"$.{f}")
    return first_of(
        closed(v, path, cat.CATEGORY_AXIS_FIELDS),
        (f"NOT ({boolean(p('visible'))} AND {boolean(p('reverse_order'))})", _fail(path, "visible and reverse_order are true or false")),
        _side(v, path, chart_type, ["left", "right"], ["top", "bottom"]),
        (f"NOT {among(p('label_position'), cat.AXIS_LABEL_PLACES)}", _fail(_join(path, ".label_position"), "this place is not offered")),
        chart_font(v, path),
        chart_line(p("line"), _join(path, ".line")),
    )


def value_axis(v: str, path: str, chart_type: str, grouping: str) -> str:
    p, n = lambda f: get(v, f"$.{f}"), lambda f: get(v, f"$.{f}", "double")
    bounds = ["minimum", "maximum", "major_unit"]
    given = " OR ".join(f"{is_number(p(f))}" for f in bounds)
    shares = yes(f"{n('minimum')} = 0 AND {n('maximum')} = 1 AND {n('major_unit')} > 0 AND {n('major_unit')} <= 1 AND contains({get(v, '$.number_format', 'string')}, '%')")
    grid, at = p("major_gridlines"), _join(path, ".major_gridlines")
    return first_of(
        closed(v, path, cat.VALUE_AXIS_FIELDS),
        (f"NOT {boolean(p('visible'))}", _fail(_join(path, ".visible"), "true or false is needed")),
        _side(v, path, chart_type, ["top", "bottom"], ["left", "right"]),
        *[(f"NOT ({finite(p(f))} OR {null(p(f))})", _fail(_join(path, f".{f}"), "null or a finite number is needed")) for f in bounds],
        (f"{n('minimum')} >= {n('maximum')}", _fail(path, "the minimum must lie below the maximum")),
        (f"{n('major_unit')} <= 0", _fail(_join(path, ".major_unit"), "a positive step is needed")),
        (f"NOT {string(p('number_format'))}", _fail(_join(path, ".number_format"), "a format is needed")),
        (f"{grouping} = 'percent_stacked' AND ({given}) AND NOT {shares}", _fail(path, "shares need bounds 0 and 1, a step up to 1 and a format in percent")),
        chart_font(v, path),
        chart_line(p("line"), _join(path, ".line")),
        closed(grid, at, ["visible", "line"]),
        (f"NOT {boolean(get(v, '$.major_gridlines.visible'))}", _fail(_join(at, ".visible"), "true or false is needed")),
        chart_line(get(v, "$.major_gridlines.line"), _join(at, ".line")),
    )


def series_item(v: str, path: str, chart_type: str, n_categories: str) -> str:
    p = lambda f: get(v, f"$.{f}")
    is_line, values = f"{chart_type} = 'line'", items(p("values"))
    odd = lambda x, at: first_of(
        (f"{null(x)} AND NOT {is_line}", _fail(at, "only lines may have gaps")),
        (f"NOT ({finite(x)} OR {null(x)})", _fail(at, "a finite number or a gap is needed")),
    )
    width = lambda x: whole(x, 1, cat.MAX_LINE_WIDTH)
    drawn = first_of(
        closed(p("line"), _join(path, ".line"), ["width", "dash"]),
        (f"NOT {width(p('line.width'))}", _fail(_join(path, ".line.width"), "a whole number of units from 1 is needed")),
        (f"NOT {among(p('line.dash'), cat.DASHES)}", _fail(_join(path, ".line.dash"), "this dash is not drawn")),
        closed(p("marker"), _join(path, ".marker"), ["style", "size", "fill", "line_color", "line_width"]),
        (f"NOT {among(p('marker.style'), cat.MARKERS)}", _fail(_join(path, ".marker.style"), "this marker is not drawn")),
        (f"NOT {whole(p('marker.size'), 2, 72)}", _fail(_join(path, ".marker.size"), "2 to 72 points")),
        (f"NOT ({rgb(p('marker.fill'))} AND {rgb(p('marker.line_color'))})", _fail(_join(path, ".marker"), "#RRGGBB is needed")),
        (f"NOT {width(p('marker.line_width'))}", _fail(_join(path, ".marker.line_width"), "a whole number of units from 1 is needed")),
        (f"NOT {yes(f'{boolean(p("smooth"))} AND NOT {get(v, "$.smooth", "boolean")}')}", _fail(_join(path, ".smooth"), "lines are not smoothed")),
    )
    return first_of(
        f"CASE WHEN {is_line} THEN {closed(v, path, ['name', 'values', 'color', 'line', 'marker', 'smooth'])} ELSE {closed(v, path, ['name', 'values', 'color'])} END",
        (f"NOT {null(p('name'))} AND NOT {string(p('name'))}", _fail(_join(path, ".name"), "null or a name is needed")),
        (f"NOT {is_kind(p('values'), 'ARRAY')} OR size({values}) <> {n_categories}", _fail(_join(path, ".values"), "a value for each category is needed")),
        each(p("values"), _join(path, ".values"), odd),
        (f"NOT {exists(values, lambda x: f'NOT {null(x)}')}", _fail(_join(path, ".values"), "a series needs a value")),
        (f"NOT {rgb(p('color'))}", _fail(_join(path, ".color"), "#RRGGBB is needed")),
        when(is_line, drawn),
    )


def cartesian_chart(style: str, content: str, path: str) -> str:
    """Columns, bars and lines: data first, then axes, legend, labels and areas."""
    c, s = lambda f: get(content, f"$.{f}"), lambda f: get(style, f"$.{f}")
    at, on = lambda f: _join(path, f".content.{f}"), lambda f: _join(path, f".style.{f}")
    kind, grouping = get(content, "$.chart_type", "string"), get(content, "$.grouping", "string")
    bars = f"{kind} IN ('column', 'bar')"
    return first_of(
        closed(content, _join(path, ".content"), ["chart_type", "grouping", "categories", "series", "axes", "legend", "data_labels", "display_blanks_as"]),
        (f"NOT CASE WHEN {bars} THEN {among(c('grouping'), ['clustered', 'stacked', 'percent_stacked'])} ELSE {says(c('grouping'), 'standard')} END", _fail(at("grouping"), "this grouping is not the chart''s", "chart.grouping")),
        (f"NOT {says(c('display_blanks_as'), 'gap')}", _fail(at("display_blanks_as"), "gap is needed", "chart.display_blanks.gap")),
        (f"NOT {is_array(c('categories'))} OR {exists(items(c('categories')), lambda x: f'NOT {string(x)}')}", _fail(at("categories"), "names are needed")),
        (f"NOT {is_array(c('series'))}", _fail(at("series"), "a series is needed")),
        each(c("series"), at("series"), lambda v, p: series_item(v, p, kind, f"size({items(c('categories'))})")),
        closed(c("axes"), at("axes"), ["category", "value"]),
        category_axis(c("axes.category"), at("axes.category"), kind),
        value_axis(c("axes.value"), at("axes.value"), kind, grouping),
        chart_legend(c("legend"), at("legend")),
        cartesian_labels(c("data_labels"), at("data_labels"), kind),
        f"CASE WHEN {bars} THEN {closed(style, _join(path, '.style'), ['gap_width', 'overlap', 'chart_area', 'plot_area'])} ELSE {closed(style, _join(path, '.style'), ['chart_area', 'plot_area'])} END",
        chart_area(s("chart_area"), on("chart_area")),
        chart_area(s("plot_area"), on("plot_area")),
        (f"{bars} AND NOT {whole(s('gap_width'), 0, 500)}", _fail(on("gap_width"), "0 to 500 is needed", "chart.gap_width")),
        (f"{bars} AND NOT {whole(s('overlap'), -100, 100)}", _fail(on("overlap"), "-100 to 100 is needed", "chart.overlap")),
        (f"{grouping} IN ('stacked', 'percent_stacked') AND {get(style, '$.overlap', 'bigint')} <> 100", _fail(on("overlap"), "stacks need an overlap of 100", "chart.overlap")),
    )


def pie_chart(style: str, content: str, path: str) -> str:
    """Pies and doughnuts: the circle, its slices, what they add up to, and their labels."""
    at, on = _join(path, ".content.slices"), lambda f: _join(path, f".style.{f}")
    kind, slices = get(content, "$.chart_type", "string"), items(get(content, "$.slices"))
    hole, labels = get(style, "$.hole_size"), get(content, "$.data_labels")
    one = lambda v, p: first_of(
        closed(v, p, ["category", "value", "color", "value_source"]),
        (f"NOT {null(get(v, '$.category'))} AND NOT {string(get(v, '$.category'))}", _fail(_join(p, ".category"), "null or a name is needed")),
        (f"NOT ({finite(get(v, '$.value'))} AND {yes(f'{get(v, "$.value", "double")} >= 0')})", _fail(_join(p, ".value"), "a finite number from 0 is needed")),
        (f"NOT {rgb(get(v, '$.color'))}", _fail(_join(p, ".color"), "#RRGGBB is needed", "chart.slice.explicit_color")),
        (f"NOT {among(get(v, '$.value_source'), ['explicit', 'derived_complement'])}", _fail(_join(p, ".value_source"), "explicit or derived_complement is needed", "chart.slice.value_source")),
    )
    value = lambda x: get(x, "$.value", "double")
    of = lambda word: f"filter({slices}, x -> {get('x', '$.value_source', 'string')} = '{word}')"
    derived, explicit = of("derived_complement"), of("explicit")
    given = value(f"get({explicit}, 0)")
    paired = yes(f"size({slices}) = 2 AND size({derived}) = 1 AND size({explicit}) = 1 AND {given} BETWEEN 0 AND 100 AND {value(f'get({derived}, 0)')} = 100 - {given}")
    return first_of(
        closed(style, _join(path, ".style"), ["first_slice_angle", "hole_size"], []),
        closed(content, _join(path, ".content"), ["chart_type", "slices", "data_labels"], []),
        (f"NOT {whole(get(style, '$.first_slice_angle'), 0, 359)}", _fail(on("first_slice_angle"), "0 to 359 is needed", "chart.first_slice_angle")),
        (f"{kind} = 'pie' AND {hole} IS NOT NULL", _fail(on("hole_size"), "a pie has no hole", "chart.hole_size")),
        (f"{kind} = 'doughnut' AND NOT {whole(hole, 10, 90)}", _fail(on("hole_size"), "10 to 90 is needed", "chart.hole_size")),
        (f"NOT {is_array(get(content, '$.slices'), 2)}", _fail(at, "two slices at least are needed")),
        each(get(content, "$.slices"), at, one),
        (f"aggregate({slices}, double(0), (a, x) -> a + {value('x')}) <= 0", _fail(at, "the total must be positive")),
        (f"size({derived}) > 0 AND NOT {paired}", _fail(at, "a complement is 100 less one explicit share, in two slices", "chart.slice.value_source")),
        _labels(labels, _join(path, ".content.data_labels"), cat.PIE_LABEL_FIELDS, ["enabled", "show_category", "show_value", "show_percentage"], among(get(labels, "$.position"), cat.PIE_LABEL_PLACES), False),
        (f"{exists(slices, lambda x: null(get(x, '$.category')))} AND {get(labels, '$.show_category', 'boolean')}", _fail(at, "shown categories need names", "chart.data_labels")),
    )


def chart(style: str, content: str, path: str) -> str:
    kind = get(content, "$.chart_type")
    known = f"CASE WHEN {among(kind, ['pie', 'doughnut'])} THEN {pie_chart(style, content, path)} ELSE {cartesian_chart(style, content, path)} END"
    return first_of((f"NOT {among(kind, cat.CHARTS)}", _fail(_join(path, ".content.chart_type"), "this chart is not drawn")), known)


#: Kinds that have contracts beyond their fields; those of one list share theirs.
KINDS = [["shape"], ["line"], ["text"], ["picture", "icon"], ["chart"]]


def element(kind: str, style: str, content: str, path: str) -> str:
    """The contract of one of KINDS: a batch is parted by kind first, so that each expression stays small."""
    s, there = _join(path, ".style"), lambda f: f"{get(style, f'$.{f}')} IS NOT NULL"
    if kind == "shape":
        return shape(style, s)
    if kind == "line":
        return line(style, s)
    if kind == "text":
        return first_of(*[when(there(f), c(get(style, f"$.{f}"), _join(s, f".{f}"))) for f, c in (("fill", fill), ("line", stroke), ("effects", effects))])
    if kind == "chart":
        return chart(style, content, path)
    cut = get(content, "$.crop")
    return first_of(
        when(f"{cut} IS NOT NULL AND NOT {null(cut)}", crop(cut, _join(path, ".content.crop"))),
        (f"{there('opacity')} AND NOT {number(get(style, '$.opacity'), 0, 1)}", _fail(_join(s, ".opacity"), "0 to 1 is needed")),
    )


def issues_of(rows: DataFrame, found: str, *keep: str) -> DataFrame:
    """keep, code, path, detail, capability of the rows that have an issue; the contract is worked out once a row."""
    return rows.select(*keep, F.expr(f"array({found})").alias("__found")).select(*keep, F.explode(F.array_compact("__found")).alias("i")).select(*keep, "i.*")
