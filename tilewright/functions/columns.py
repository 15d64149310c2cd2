"""Scalar functions over columns: cleaning, naming, paths, numbers, geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two truth sets for boolean-like text.
TRUE_NARROW = ("1", "true", "yes")
TRUE_WIDE = ("1", "true", "yes", "y")
#: All white space that is stripped from both ends of a text.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(c.cast("string"), F.lit(WHITE))


def among(c: Column, values: list[str]) -> Column:
    """Whether the trimmed text is one of the values, in any case; null is not."""
    return normal(c).isin([str(v).strip().lower() for v in values])


def present(c: Column) -> Column:
    """Neither null nor, for numbers, NaN."""
    return c.isNotNull() & ~F.coalesce(F.isnan(c.try_cast("double")), F.lit(False))


def normal(c: Column) -> Column:
    """Trimmed lower case; null as ''."""
    return F.lower(stripped(F.coalesce(c.cast("string"), F.lit(""))))


def lowered(c: Column) -> Column:
    """Lower case without trimming; null as ''."""
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def filled(c: Column) -> Column:
    """Trimmed; blank as null."""
    return F.nullif(stripped(c), F.lit(""))


def number(c: Column) -> Column:
    """Text as double; what isn't a number, and NaN, as null."""
    d = stripped(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def whole(c: Column, default: int | None = None) -> Column:
    """Text as int, truncated; a default for what isn't a number."""
    n = number(c).try_cast("int")
    return n if default is None else F.coalesce(n, F.lit(default))


def truthy(c: Column, accepted: tuple[str, ...] = TRUE_WIDE) -> Column:
    """Whether boolean-like text is one of the accepted words; null is not."""
    return normal(c).isin(*accepted)


def token(c: Column, fallback: str = "unknown") -> Column:
    """Letters, digits, - and _ stay, others become _; outer _ go; a fallback for nothing."""
    t = F.btrim(F.regexp_replace(stripped(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(fallback))


def under(base: str, c: Column) -> Column:
    """A path as it is if absolute, else below a base folder."""
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def named(name: Column, path: Column) -> Column:
    """A file name, taken from the path where it is null or blank."""
    return F.coalesce(filled(name.cast("string")), basename(path))


def slide_path(path: Column, name: Column, root: str | None = None, strict: bool = False) -> Column:
    """The path if there is one, else the name below ``root``; null, or an error if strict, where neither will do."""
    below = F.lit(None).cast("string") if root is None else F.concat(F.lit(root.rstrip("/") + "/"), filled(name))
    none = F.raise_error(F.lit("a row needs a path, or a name and a root folder")).cast("string") if strict else F.lit(None).cast("string")
    return F.coalesce(filled(path), below, none)


def stem(c: Column) -> Column:
    """File name without its last suffix, in lower case."""
    return F.lower(F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", ""))


def suffix(c: Column) -> Column:
    """Last suffix with its dot, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(basename(c), r".(\.[^.]+)$", 1))


def unit_id(base: Column, label: Column, mode: str = "suffix_labels", sep: str = "_") -> Column:
    if mode == "suffix_labels":
        return F.concat(base, F.lit(sep), label)
    if mode == "no_suffix":
        return base
    raise ValueError(f"unknown naming mode {mode}")


def tile_name(unit: Column, slide: Column, x: Column, y: Column, level: Column, ext: str = "png") -> Column:
    return F.concat(token(unit), F.lit("__"), token(slide), F.lit("__x"), x, F.lit("_y"), y, F.lit("__l"), level, F.lit(f".{ext}"))


def mapped(c: Column, table: dict[str, int], allowed: list[int] | None = None) -> Column:
    """A label by its text or its truncated number; what isn't in the table, or not allowed, is null."""
    as_text = stripped(c)
    as_int = whole(c).cast("string")
    found = reduce(lambda rest, kv: F.when((as_text == kv[0]) | (as_int == kv[0]), F.lit(kv[1])).otherwise(rest), reversed(list(table.items())), F.lit(None).cast("int"))
    return found if allowed is None else F.when(found.isin(*allowed), found)


def label_index(c: Column, labels: list[int]) -> Column:
    """The 0-based place of a label in the list; null for others."""
    place = F.array_position(F.array(*map(F.lit, labels)), c).cast("int")
    return F.when(place > 0, place - 1)


def thumbnail_scale(width: Column, height: Column, most: int, capped: bool = True) -> Column:
    """The factor that brings the longer side to ``most``; at most 1 if capped."""
    scale = F.lit(float(most)) / F.greatest(width, height)
    return F.least(scale, F.lit(1.0)) if capped else scale


def thumbnail_side(side: Column, scale: Column) -> Column:
    return F.greatest(half_even(side * scale), F.lit(1).cast("long"))


def level_extent(size: int, downsample: Column) -> Column:
    """What a tile of ``size`` covers at level 0 when it is read in whole pixels of a level."""
    return half_even(F.greatest(F.ceil(F.lit(float(size)) / downsample), F.lit(1)) * downsample)


def half_even(c: Column) -> Column:
    """Rounded to the nearest whole number, halves to the even one."""
    return F.rint(c).cast("long")


def decimals(c: Column, places: int = 4) -> Column:
    """An array of numbers as text of fixed places."""
    return F.array_join(F.transform(c, lambda x: F.format_string(f"%.{places}f", x)), ", ")


def improved(now: Column, best: Column, maximise: bool = True) -> Column:
    """Whether a metric is better than the best so far; NaN never is, and anything beats a NaN or null best."""
    better = now > best if maximise else now < best
    return ~(F.isnan(now) | now.isNull()) & (best.isNull() | F.isnan(best) | better)


def share_below(values: Column, limit: float) -> Column:
    """The share of an array's numbers that are less than a limit: tissue, where grey values are below white. Null for an empty array."""
    return F.try_divide(F.size(F.filter(values, lambda v: v < limit)), F.size(values))


def argmax(values: list[Column]) -> Column:
    """1-based place of the largest value; the first of equals."""
    return F.array_position(F.array(*values), F.greatest(*values)).cast("int")


def linear(features: list[Column], weights: list[list[float]], bias: list[float]) -> list[Column]:
    """A linear scorer's logits: one per row of weights."""
    return [reduce(lambda a, b: a + b, [f * w for f, w in zip(features, row, strict=True)], F.lit(b0)) for row, b0 in zip(weights, bias, strict=True)]


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    return [p / reduce(lambda a, b: a + b, parts) for p in parts]
