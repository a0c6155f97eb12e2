"""Text columns: extraction by patterns, identifiers, section types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewright.functions import patterns as P


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    """Every match of a group, in order; the empty list for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(P.unicode_aware(pattern)), F.lit(group)), F.array().cast("array<string>"))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match of a group, or null."""
    return F.nullif(F.regexp_extract(text, P.unicode_aware(pattern), group), F.lit(""))


def distinct_in_order(found: Column) -> Column:
    """An array's distinct elements by first occurrence."""
    return F.array_distinct(found)


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore; 'item' if nothing is left."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.when(bare == "", F.lit("item")).otherwise(bare)


def inside(root: Column, path: Column) -> Column:
    """Whether ``path``, taken from the folder ``root``, leads to somewhere below it once '.' and '..' are followed."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path))

    def steps(p: Column) -> Column:
        up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        return F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda a, s: F.when(s.isin("", "."), a).when(s == "..", up(a)).otherwise(F.array_append(a, s)))

    to, at = steps(whole), steps(root)
    return F.slice(to, F.lit(1), F.greatest(F.size(at), F.lit(0))) == at


def region_id(page: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """A region's id: its page and its box."""
    return F.format_string("p%03d_region_%d_%d_%d_%d", page, x, y, w, h)


def auto_figure_id(page: Column, region: Column) -> Column:
    """The id of a figure that no caption names: its page and its place among the page's regions, from 1."""
    return F.format_string("auto_fig_p%03d_r%02d", page, region)


def panel_file(paper: Column, figure: Column, panel: Column) -> Column:
    """Where a panel's picture is kept; panels from 1."""
    return F.concat(paper, F.lit("/"), figure, F.format_string("/panel_%02d.png", panel))


def path_id(path: Column) -> Column:
    """Sixteen hexadecimal digits that identify a path."""
    return F.substring(F.sha1(F.encode(path, "UTF-8")), 1, 16)


def section_type(title: Column) -> Column:
    """The type of a section by keywords of its title, the first that applies."""
    t = F.lower(F.coalesce(title, F.lit("")))

    def has(*words: str) -> Column:
        c = F.lit(False)
        for w in words:
            c = c | t.contains(w)
        return c

    return (
        F.when(has("systematic", "paleontology"), "systematic_paleontology")
        .when(has("geological", "setting", "stratigraph"), "geological_setting")
        .when(has("material", "method"), "materials_methods")
        .otherwise("other")
    )


def figure_number(attribute: Column, caption: Column, figure_id: Column) -> Column:
    """A figure's number by its attribute, else the caption's lead, else its id."""
    return F.coalesce(F.nullif(attribute, F.lit("")), first_match(F.trim(caption), P.CAPTION_LEAD), first_match(figure_id, P.NUMBER_IN_ID))


def micrometres(value: Column, unit: Column) -> Column:
    """A length in µm by its unit (μm, um, mm, nm); null for other units."""
    u = F.lower(F.trim(unit))
    return F.when(u.isin("μm", "um"), value).when(u == "mm", value * 1000.0).when(u == "nm", value / 1000.0)


def scale_statement(text: Column, source: str, confidence: float) -> Column:
    """struct(value, unit, source, confidence) of the scale that a text states; null without one."""
    value = F.regexp_extract(text, P.unicode_aware(P.SCALE), 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, P.unicode_aware(P.SCALE), 2))
    return F.when(value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))


def merged_scale(caption: Column, ocr: Column) -> Column:
    """The more confident of two scale statements, the caption's on a tie."""
    return F.when(ocr.isNull() | (caption.isNotNull() & (caption["confidence"] >= ocr["confidence"])), caption).otherwise(ocr)


def um_per_px(value: Column, unit: Column, pixel_length: Column) -> Column:
    """µm per pixel; null unless everything is known and the bar has pixels."""
    return F.when(pixel_length > 0, micrometres(value, unit) / pixel_length)


def text_density(text: Column, width: Column, height: Column) -> Column:
    """Words per 100,000 pixels of a page, at least one such unit."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+"))
    return words / F.greatest(F.lit(1.0), width * height / 100000.0)


def confidence_class(confidence: Column) -> Column:
    """'high', 'medium' or 'low'."""
    return F.when(confidence >= P.CONF_HIGH, "high").when(confidence >= P.CONF_MEDIUM, "medium").otherwise("low")


def file_size(n: Column) -> Column:
    """A number of bytes for people: 0 Bytes, 1.5 KB, 2 MB."""
    power = F.when(n > 0, F.least(F.lit(3), F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)))).cast("int")).otherwise(0)
    shown = F.round(n / F.pow(F.lit(1024.0), power), 2)
    plain = F.regexp_replace(F.format_string("%.2f", shown), r"\.?0+$", "")
    return F.when(n > 0, F.concat(plain, F.lit(" "), F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), power + 1))).otherwise("0 Bytes")


def label_scalar(label: Column) -> Column:
    """A panel label as a number: A..Z as 1/26..1, numbers as n/20 up to 1, else 0."""
    return (
        F.when(label.rlike("^[A-Z]$"), (F.ascii(label) - 64) / 26.0)
        .when(label.rlike(r"^\d+$"), F.least(F.lit(1.0), label.try_cast("double") / 20.0))
        .otherwise(0.0)
    )
