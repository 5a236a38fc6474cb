"""Regions of the location heatmap (B03): findings that overlap in a document form one region.

Places in running text are intervals of characters; overlapping ones are merged. Places on a
page are boxes; a page is a grid of cells, and boxes that share a cell or touch at a side of
cells belong together. Both are reduced before they meet: intervals to one row per start, boxes to the
cells they cover, so that a place with very many findings costs no more than its text or page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridraft.functions.scores import severity_of_rank, severity_rank
from veridraft.operators.evidence import place_of

#: Cells of a page in each direction, and the page's size where none is given.
CELLS, PAGE = 32, (612.0, 792.0)
PLACE = ["audit_id", "place"]


def _placed(flags: DataFrame, types: list[str]) -> DataFrame:
    location = F.col("document_location")
    return flags.where(location["type"].isin(types)).select(
        "audit_id", place_of(location).alias("place"), "flag_id", severity_rank(F.col("severity")).alias("_rank"),
        location["char_start"].alias("_start"), location["char_end"].alias("_end"),
        *([location["bbox"].alias("_box")] if "bbox" in flags.select("document_location.*").columns else []),
    )


def text_regions(flags: DataFrame) -> DataFrame:
    """(audit_id, place, region_no, char_start, char_end, finding_count, worst_severity).

    Findings in text and paragraphs whose characters [char_start, char_end) overlap, also by way of
    others, are one region; those that only touch are two. Regions are numbered from 1 in the
    order of the text. Findings without characters, or with none in between, have no region.
    """
    return _merged(_placed(flags, ["text", "docx"])).drop("_starts")


def text_region_flags(flags: DataFrame) -> DataFrame:
    """(audit_id, place, region_no, flag_id): the findings behind each region, as rows."""
    placed = _placed(flags, ["text", "docx"])
    starts = _merged(placed).select(*PLACE, "region_no", F.explode("_starts").alias("_start"))
    return placed.where("_start < _end").join(starts, [*PLACE, "_start"]).select(*PLACE, "region_no", "flag_id")


def _merged(placed: DataFrame) -> DataFrame:
    each = placed.where("_start < _end").groupBy(*PLACE, "_start").agg(
        F.max("_end").alias("_end"), F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_rank")
    )
    # One row per start: a place has no more than its text has characters.
    inside = Window.partitionBy(*PLACE).orderBy("_start")
    reached = F.max("_end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    new = each.withColumn("_new", (F.coalesce(F.col("_start") >= reached, F.lit(True))).cast("int"))
    numbered = new.withColumn("region_no", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*PLACE, "region_no").agg(
        F.min("_start").alias("char_start"), F.max("_end").alias("char_end"), F.sum("_n").alias("finding_count"),
        severity_of_rank(F.min("_rank")).alias("worst_severity"), F.collect_list("_start").alias("_starts"),
    )


def _cell(value: Column, size: float, cells: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(value * cells / size).cast("int")))


def page_cells(flags: DataFrame, cells: int = CELLS, page: tuple[float, float] = PAGE) -> DataFrame:
    """(audit_id, place, flag_id, _rank, cell): the cells that the box of a finding covers."""
    box = F.col("_box")
    boxed = _placed(flags, ["pdf"]).where(F.size(box) == 4).where(box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull())
    xs = F.sequence(_cell(F.least(box[0], box[2]), page[0], cells), _cell(F.greatest(box[0], box[2]), page[0], cells))
    ys = F.sequence(_cell(F.least(box[1], box[3]), page[1], cells), _cell(F.greatest(box[1], box[3]), page[1], cells))
    covered = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: y * cells + x)))
    return boxed.select(*PLACE, "flag_id", "_rank", F.explode(covered).alias("cell"))


def connected(found: set[int], cells: int) -> dict[int, int]:
    """The smallest cell that each cell is connected with, over sides."""
    root: dict[int, int] = {}
    for start in sorted(found):
        if start in root:
            continue
        root[start], todo = start, [start]
        while todo:
            at = todo.pop()
            sides = [at - cells, at + cells] + [at - 1] * (at % cells > 0) + [at + 1] * (at % cells < cells - 1)
            for near in sides:
                if near in found and near not in root:
                    root[near] = start
                    todo.append(near)
    return root


def _cell_regions(covered: DataFrame, cells: int) -> DataFrame:
    """(audit_id, place, cell, region): a page has cells * cells rows at most, as one short array."""
    pages = covered.groupBy(*PLACE).agg(F.collect_set("cell").alias("cells"))

    @F.pandas_udf("array<int>")
    def regions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            roots = [connected(set(p.tolist()), cells) for p in pages]
            yield pd.Series([[r[c] for c in p.tolist()] for p, r in zip(pages, roots)])

    return pages.select(*PLACE, F.explode(F.arrays_zip("cells", regions("cells").alias("regions"))).alias("z")).select(
        *PLACE, F.col("z.cells").alias("cell"), F.col("z.regions").alias("region")
    )


def page_region_flags(flags: DataFrame, cells: int = CELLS, page: tuple[float, float] = PAGE) -> DataFrame:
    """(audit_id, place, region, flag_id, severity rank): the region of every boxed finding.

    ``region`` is the first cell of the region, counted line by line from 0.
    """
    covered = page_cells(flags, cells, page)
    first = covered.groupBy(*PLACE, "flag_id", "_rank").agg(F.min("cell").alias("cell"))
    return first.join(_cell_regions(covered, cells), [*PLACE, "cell"]).select(*PLACE, "region", "flag_id", "_rank")


def page_regions(flags: DataFrame, cells: int = CELLS, page: tuple[float, float] = PAGE) -> DataFrame:
    """(audit_id, place, region, finding_count, worst_severity, cells) of boxed findings on pages.

    Boxes [x0, y0, x1, y1] are in the page's units, corners in any order; what lies outside the
    page counts at its edge. Findings without a box have no region.
    """
    covered = page_cells(flags, cells, page)
    found = _cell_regions(covered, cells)
    area = found.groupBy(*PLACE, "region").agg(F.count(F.lit(1)).alias("cells"))
    return page_region_flags(flags, cells, page).groupBy(*PLACE, "region").agg(
        F.count(F.lit(1)).alias("finding_count"), severity_of_rank(F.min("_rank")).alias("worst_severity")
    ).join(area, [*PLACE, "region"])
