"""Annotation documents whose layout drifts (S2): JSON texts become VARIANT values, and the fields present choose the layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# layout: its size fields, its polygons; the first whose fields an entry has counts
SIZES = {"named": ("$.width", "$.height"), "short": ("$.w", "$.h"), "pair": ("$.size[0]", "$.size[1]")}
CATEGORIES = ("$.category_id", "$.category", "$.label")


def _first(value: Column, paths, kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(value, p, kind) for p in paths])


def _polygons(entry: Column) -> Column:
    """array<array<double>>: nested lists, one flat list, or the corners of a box; null without any."""
    once = lambda c, then: F.get(F.transform(F.array(c), then), F.lit(0))  # noqa: E731  # reads the entry once, however often the value is used

    def corners(box: Column) -> Column:
        x, y, w, h = (F.get(box, F.lit(i)) for i in range(4))
        return F.when(F.size(box) == 4, F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h)))

    flat = F.coalesce(F.try_variant_get(entry, "$.polygon", "array<double>"), F.try_variant_get(entry, "$.segmentation", "array<double>"))
    return F.coalesce(
        F.try_variant_get(entry, "$.segmentation", "array<array<double>>"),
        once(flat, lambda f: F.when(f.isNotNull(), F.array(f))),
        once(F.try_variant_get(entry, "$.bbox", "array<double>"), corners),
    )


def parsed(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """doc, v, images, annotations: the text as VARIANT and its two lists; all null for a text that is no JSON."""
    v = docs.select(F.col(id_col).alias("doc"), F.try_parse_json(json_col).alias("v"))
    return v.select("doc", "v", *[F.try_variant_get("v", f"$.{k}", "array<variant>").alias(k) for k in ("images", "annotations")])


def images(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """doc, image_id, width, height, layout: one row an image.

    A text that is null, no JSON or without images is one row without an image, with layout ``malformed`` or ``empty``.
    """
    rows = parsed(docs, id_col, json_col).select("doc", "v", F.posexplode_outer("images").alias("pos", "i"))
    layout = F.coalesce(*[F.when(_first(F.col("i"), (p,), "double").isNotNull(), name) for name, (p, _) in SIZES.items()])
    kind = F.when(F.col("v").isNull(), "malformed").when(F.col("i").isNull(), "empty").otherwise(F.coalesce(layout, F.lit("unsized")))
    side = lambda k: _first(F.col("i"), [s[k] for s in SIZES.values()], "double")
    return rows.select("doc", F.try_variant_get("i", "$.id", "string").alias("image_id"), side(0).alias("width"), side(1).alias("height"), kind.alias("layout"))


def annotations(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """doc, pos, part, image_id, category, polygon: one row a polygon, numbered in its annotation; one with a null polygon where an
    annotation has none that can be read.  Texts without annotations give no rows."""
    # outer, as for an inner one the optimizer adds a filter below that parses each text again
    rows = parsed(docs, id_col, json_col).select("doc", F.posexplode_outer("annotations").alias("pos", "a")).where("pos is not null")
    rows = rows.select("doc", "pos", "a", F.posexplode_outer(_polygons(F.col("a"))).alias("part", "polygon"))
    category = _first(F.col("a"), CATEGORIES, "string")
    return rows.select("doc", "pos", F.coalesce("part", F.lit(0)).alias("part"), F.try_variant_get("a", "$.image_id", "string").alias("image_id"), category.alias("category"), "polygon")
