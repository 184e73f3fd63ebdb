"""Colours of items and products: styled items first, then the material's representation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import step_text as step
from .index import Tables, dealt


def _f(i: int):
    return F.get("f", F.lit(i))


def surface_colours(tables: Tables) -> DataFrame:
    """(style_id, colour): red, green, blue and opacity in 0 .. 1 of each surface style."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rgb = tables.of("IFCCOLOURRGB").select(F.col("step_id").alias("rgb"), *[unit(step.number(_f(i + 1))).alias(c) for i, c in enumerate(("r", "g", "b"))])
    shades = tables.of("IFCSURFACESTYLERENDERING", "IFCSURFACESTYLESHADING").select(F.col("step_id").alias("shade"), step.ref(_f(0)).alias("rgb"), (1 - unit(F.coalesce(step.number(_f(1)), F.lit(0.0)))).alias("opacity"))
    styles = tables.of("IFCSURFACESTYLE").select(F.col("step_id").alias("style_id"), F.posexplode(step.refs(_f(2))).alias("pos", "shade"))
    whole = styles.join(shades, "shade").join(rgb, "rgb")
    return whole.groupBy("style_id").agg(F.min_by(F.array("r", "g", "b", "opacity"), "pos").alias("colour"))


def item_colours(tables: Tables) -> DataFrame:
    """(item_id, colour) of the items that a styled item names; the first in the file counts. Style assignments are seen through."""
    direct = dealt(tables.of("IFCSTYLEDITEM"), step.refs(_f(1)), "style", "ord", step.ref(_f(0)).alias("item_id"))
    through = tables.of("IFCPRESENTATIONSTYLEASSIGNMENT").select(F.col("step_id").alias("style"), F.explode(step.refs(_f(0))).alias("inner"))
    styled = direct.join(through, "style", "left").select("ord", "item_id", F.coalesce("inner", "style").alias("style_id"))
    return styled.where("item_id IS NOT NULL").join(surface_colours(tables), "style_id").groupBy("item_id").agg(F.min_by("colour", "ord").alias("colour"))


def material_colours(tables: Tables) -> DataFrame:
    """(guid, colour) through a product's material and that material's styled representation."""
    styled = tables.of("IFCSTYLEDITEM").select(F.col("step_id").alias("styled"), F.explode(step.refs(_f(1))).alias("style"))
    through = tables.of("IFCPRESENTATIONSTYLEASSIGNMENT").select(F.col("step_id").alias("style"), F.explode(step.refs(_f(0))).alias("inner"))
    colours = styled.join(through, "style", "left").select("styled", F.coalesce("inner", "style").alias("style_id")).join(surface_colours(tables), "style_id")
    shown = tables.of("IFCSTYLEDREPRESENTATION").select(F.col("step_id").alias("rep"), F.explode(step.refs(_f(3))).alias("styled")).join(colours, "styled")
    of = dealt(tables.of("IFCMATERIALDEFINITIONREPRESENTATION"), step.refs(_f(2)), "rep", step.ref(_f(3)).alias("material")).join(shown, "rep")
    used = dealt(tables.of("IFCRELASSOCIATESMATERIAL"), step.refs(_f(4)), "item", "ord", step.ref(_f(5)).alias("material")).join(tables.guids().select(F.col("step_id").alias("item"), "guid"), "item")
    return used.join(of, "material").groupBy("guid").agg(F.min_by("colour", F.struct("ord", "styled")).alias("colour"))


def product_colours(tables: Tables, fragments: DataFrame) -> DataFrame:
    """(guid, colour): of the first coloured item of each product in fragments(guid, place, item_id), else of its material."""
    own = fragments.select("guid", "place", "item_id").distinct().join(item_colours(tables), "item_id").groupBy("guid").agg(F.min_by("colour", "place").alias("own"))
    return own.join(material_colours(tables), "guid", "full_outer").select("guid", F.coalesce("own", "colour").alias("colour"))
