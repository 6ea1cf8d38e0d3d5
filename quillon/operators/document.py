"""From what the pages of a document show to its elements and chunks: ruled tables, figures, text.

One step per question, each a DataFrame: which strokes make tables, which words lie in them, what the
rest of the page reads as, and in what order. Pages are joined and grouped by document and page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import chunking, layout, ruled

PAGE = ruled.PAGE


def elements(things: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """doc_id, page_number, order_index, element_type, text, bbox, element_id, section_path, relation, rows.

    ``things``: doc_id, page_number, kind, text, x0, top, x1, bottom, as the page sources give; kinds: word, stroke,
    path (a drawn box), image, warning. Tables whose grid has enough text are elements of their own, after the text of
    their page, with ``rows`` and, as JSON in ``relation``, their status; their words are in no other element. Of a table
    whose rules cut words the rows are kept and the status says so. Warnings are elements too.
    """
    of = lambda *kinds: things.where(F.col("kind").isin(*kinds))
    shown = of("word", "stroke", "path", "image").select(F.col("doc_id").cast("long"), F.col("page_number").cast("int"), "kind", "text", *(F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")))
    tables = ruled.tables(ruled.table_cells(shown.where("kind = 'word'"), shown.where("kind IN ('stroke', 'path')"))).where("supported")
    within = F.expr(f"kind <> 'image' AND (x0 + x1) / 2 BETWEEN bbox[0] - {ruled.MARGIN_X} AND bbox[2] + {ruled.MARGIN_X} AND (top + bottom) / 2 BETWEEN bbox[1] - {ruled.MARGIN_Y} AND bbox[3] + {ruled.MARGIN_Y}")
    region = tables.select(*PAGE, "bbox").alias("t")
    outside = shown.alias("a").join(region, [F.col(f"a.{c}") == F.col(f"t.{c}") for c in PAGE] + [within], "left_anti")
    text = layout.elements_of(outside, page_width, page_height)
    name = F.concat(F.lit("Table "), F.col("table_no").cast("string"))
    identity = F.to_json(F.struct(F.lit(layout.LAYOUT_VERSION).alias("v"), "page_number", F.transform("bbox", lambda v: F.round(v, 2)).alias("b"), "rows"))
    listed = tables.select(
        *PAGE,
        F.lit(1).alias("late"),
        F.col("table_no").alias("place"),
        F.lit("table").alias("element_type"),
        name.alias("text"),
        "bbox",
        F.concat(F.lit("el_"), F.substring(F.sha2(identity, 256), 1, 24)).alias("element_id"),
        F.lit(None).cast("array<string>").alias("section_path"),
        F.to_json(F.struct("status", "n_rows", "n_cols", "n_words")).alias("relation"),
        "rows",
    )
    none = F.lit(None).cast("array<array<string>>").alias("rows")
    read = text.select(*PAGE, F.lit(0).alias("late"), F.col("order_index").alias("place"), "element_type", "text", "bbox", "element_id", "section_path", "relation", none)
    failed = of("warning").select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("page_number"), F.lit(0)).cast("int").alias("page_number"), F.lit(0).alias("late"), F.lit(-1).alias("place"), F.lit("warning").alias("element_type"), "text",
        F.array().cast("array<double>").alias("bbox"), F.concat(F.lit("el_"), F.substring(F.sha2(F.concat_ws(":", "page_number", "text"), 256), 1, 24)).alias("element_id"), F.lit(None).cast("array<string>").alias("section_path"), F.lit(None).cast("string").alias("relation"), none,
    )
    order = Window.partitionBy("doc_id").orderBy("page_number", "late", "place", "element_id")
    all_of = read.unionByName(listed).unionByName(failed)
    path = F.coalesce(F.last("section_path", ignorenulls=True).over(order), F.array().cast("array<string>"))
    return all_of.select("doc_id", "page_number", (F.row_number().over(order) - 1).alias("order_index"), "element_type", "text", "bbox", "element_id", path.alias("section_path"), "relation", "rows")


def chunks(parsed: DataFrame) -> DataFrame:
    """Chunks of ``elements``, warnings and images left out; ordinals run on over a document."""
    told = parsed.where("element_type NOT IN ('warning', 'image_region')")
    return chunking.chunk_element_table(told.withColumn("header_rows", F.lit(1)))
