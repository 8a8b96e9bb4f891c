"""Column functions: names and paths, typed attributes, rounding, geometry, formatting. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Values as text


def blank_to_null(x: Column | str) -> Column:
    """Attribute text; an empty text is a missing value."""
    return F.nullif(c(x), F.lit(""))


def as_int(x: Column | str) -> Column:
    return blank_to_null(x).try_cast("long")


def as_float(x: Column | str) -> Column:
    return blank_to_null(x).try_cast("double")


def as_flag(x: Column | str) -> Column:
    """Text "1"/"0", "true"/"false" or any number as a boolean."""
    v = blank_to_null(x)
    return F.coalesce(F.when(F.lower(v).isin("true", "false"), F.lower(v) == "true"), v.try_cast("double") != 0)


def as_ints(x: Column | str, separator: str = ",") -> Column:
    """Comma text as distinct, sorted integers; parts that are none are left out. Null or blank text is an empty list."""
    parts = F.transform(F.split(F.coalesce(c(x), F.lit("")), separator), lambda p: F.trim(p).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p.isNotNull())))


def ints_as_text(x: Column | str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.array_distinct(c(x))), lambda v: v.cast("string")), ",")


def kind_of(x: Column | str) -> Column:
    """What a text is first: "bool", "int", "float" or "str"."""
    v = F.trim(c(x))
    return F.when(F.lower(v).isin("true", "false"), "bool").when(v.rlike("^[-+]?[0-9]+$"), "int").when(v.rlike("^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$"), "float").otherwise("str")


def dimensions(x: Column | str) -> Column:
    """"width height" as a struct."""
    parts = F.split(F.trim(c(x)), " +")
    return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("width"), F.get(parts, F.lit(1)).try_cast("int").alias("height"))


def crop_box(x: Column | str) -> Column:
    """Two numbers are a size at the origin, four are x, y, width, height."""
    parts = F.transform(F.split(F.trim(c(x)), "[ ,]+"), lambda p: p.try_cast("double"))
    g = lambda k: F.get(parts, F.lit(k))
    two = F.size(parts) == 2
    zero = F.lit(0.0)
    return F.when(F.size(parts).isin(2, 4), F.struct(F.when(two, zero).otherwise(g(0)).alias("x"), F.when(two, zero).otherwise(g(1)).alias("y"), F.when(two, g(0)).otherwise(g(2)).alias("width"), F.when(two, g(1)).otherwise(g(3)).alias("height")))


def rounded(x: Column | str, places: int = 3) -> Column:
    """Half to even, as gamma (3 places) and thresholds (2 places) are kept."""
    return F.bround(c(x), places)


# Names


def section_name(n: Column | str) -> Column:
    return F.format_string("%04d", c(n))


def level_name(downsample: Column | str) -> Column:
    return F.format_string("%03d", c(downsample).cast("int"))


def tile_name(n: Column | str, extension: Column | str = "png") -> Column:
    ext = F.lit(extension) if isinstance(extension, str) else extension
    return F.concat(F.format_string("%03d", c(n)), dotted(ext))


def dotted(extension: Column) -> Column:
    return F.when(extension.startswith("."), extension).otherwise(F.concat(F.lit("."), extension))


def image_name(section: Column | str, channel: Column | str, filter_: Column | str, extension: str = "png") -> Column:
    return F.concat(F.concat_ws("_", section_name(section), c(channel), c(filter_)), dotted(F.lit(extension)))


def registration_name(mapped: list[Column], control: list[Column]) -> Column:
    """(section, channel, filter) of both sides as one file name."""
    side = lambda s: F.concat(s[0].cast("string"), F.lit("-"), F.concat_ws("_", s[1], s[2]))
    return F.concat(F.concat_ws("_", side(mapped), side(control)), F.lit(".stos"))


def transform_name(name: Column | str, kind: Column | str) -> Column:
    return F.concat(c(name), c(kind), F.lit(".mosaic"))


def grid_tile_name(x: Column | str, y: Column | str, prefix: str = "", postfix: str = ".png") -> Column:
    return F.concat(F.lit(prefix), F.format_string("X%03d_Y%03d", c(x), c(y)), F.lit(postfix))


def tile_number(name: Column | str) -> Column:
    """The number a file name consists of before its extension, else null."""
    return F.nullif(F.regexp_extract(c(name), "(?:^|/)([0-9]+)[.][^./]*$", 1), F.lit("")).try_cast("int")


def tile_width(name: Column | str) -> Column:
    """To how many digits that number is padded."""
    return F.nullif(F.length(F.regexp_extract(c(name), "(?:^|/)([0-9]+)[.][^./]*$", 1)), F.lit(0))


def without_spaces(path: Column | str) -> Column:
    return F.replace(c(path), F.lit(" "), F.lit("_"))


def joined_path(*parts: Column) -> Column:
    """Parts joined by "/", empty and null ones left out, no doubled separators."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.regexp_replace(F.array_join(kept, "/"), "(?<!:)/{2,}", "/")


def relative_path(path: Column | str, root: Column | str) -> Column:
    p, r = c(path), F.regexp_replace(c(root), "/+$", "")
    return F.when(p == r, ".").when(p.startswith(F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p))).otherwise(p)


# Numbers


def bit_mask(least: Column | str, most: Column | str, bits: int) -> Column:
    """All bits that the range of values needs, at most `bits`."""
    need = F.ceil(F.log2(F.greatest(c(most) - F.least(c(least), F.lit(0)), F.lit(1)).cast("double") + 1)).cast("int")
    return (F.pow(F.lit(2.0), F.least(need, F.lit(bits))) - 1).cast("long")


def bits_per_pixel(mode: Column | str, most: Column | str) -> Column:
    """8 or 16 by data mode (0; 1 and 6); without a mode as many as the largest value needs."""
    return F.when(c(mode) == 0, 8).when(c(mode).isin(1, 6), 16).when(c(mode).isNull() & (c(most) > 1), F.ceil(F.log2(c(most).cast("double"))).cast("int"))


def crop_at(box: Column, downsample: Column | float) -> Column:
    """A crop box at a coarser level: its origin rounded down, its size up."""
    d = downsample if isinstance(downsample, Column) else F.lit(float(downsample))
    return F.struct(F.floor(box["x"] / d).alias("x"), F.floor(box["y"] / d).alias("y"), F.ceil(box["width"] / d).alias("width"), F.ceil(box["height"] / d).alias("height"))


def fitted(width: Column | str, height: Column | str, most_width: float, most_height: float) -> Column:
    """Dimensions within limits, shape kept, never enlarged, cut to whole numbers; unknown ones are the limits."""
    w, h = c(width).cast("double"), c(height).cast("double")
    scale = F.lit(1.0) / F.greatest(w / most_width, h / most_height, F.lit(1.0))
    known = w.isNotNull() & h.isNotNull()
    return F.struct(F.when(known, F.floor(w * scale)).otherwise(int(most_width)).alias("width"), F.when(known, F.floor(h * scale)).otherwise(int(most_height)).alias("height"))


def out_of_range_repaired(value: Column | str, bits: int) -> Column:
    """Values beyond what the camera's bits hold wrap around."""
    m = (1 << bits) - 1
    return F.when(c(value) > m, c(value) - m).otherwise(c(value))


def version_compatible(tag: Column | str, version: Column | str, latest: dict[str, float]) -> Column:
    """Tags with a latest version need at least it; others at most 1.0."""
    known = F.create_map(*[F.lit(x) for kv in latest.items() for x in kv]) if latest else F.lit(None).cast("map<string,double>")
    need = F.try_element_at(known, c(tag))
    return F.when(need.isNotNull(), c(version) >= need).otherwise(c(version) <= 1.0)


def gamma_at(mean: Column | str, least: Column | str, most: Column | str) -> Column:
    """The gamma that puts the mean at half of the range, between 0.1 and 10; 1 where there is none."""
    part = (c(mean) - c(least)) / F.nullif(c(most) - c(least), F.lit(0.0))
    return F.when((part > 0) & (part < 1), F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.log(F.lit(0.5)) / F.log(part)))).otherwise(F.lit(1.0))


def fingerprint(*parts: Column | str) -> Column:
    """MD5 of the parts as text in order; a null differs from every text."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c(p).cast("string")), F.lit("-")) for p in parts]))


# Texts


def plain_text_of_rtf(x: Column | str) -> Column:
    """Rich text without groups of tables, control words and braces; paragraphs are newlines."""
    t = F.regexp_replace(c(x), r"\{\\(fonttbl|colortbl|stylesheet|info|\*)[^{}]*(\{[^{}]*\}[^{}]*)*\}", "")
    t = F.regexp_replace(t, r"\\(par|line)\b ?", "\n")
    t = F.regexp_replace(t, r"\\'[0-9a-fA-F]{2}", "")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+-?[0-9]* ?", "")
    return F.trim(F.regexp_replace(t, r"[{}]", ""))


def html_escaped(x: Column | str) -> Column:
    t = F.replace(F.replace(F.replace(c(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(t, F.lit('"'), F.lit("&quot;"))


def html_of_rtf(x: Column | str) -> Column:
    return F.replace(html_escaped(plain_text_of_rtf(x)), F.lit("\n"), F.lit("<br/>"))


def note_text(x: Column | str) -> Column:
    """Notes as they are attached: without NULs, escaped."""
    return html_escaped(F.replace(c(x), F.lit("\u0000"), F.lit("")))


def seconds_text(x: Column | str) -> Column:
    """Seconds as h:mm:ss."""
    s = F.floor(c(x)).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
