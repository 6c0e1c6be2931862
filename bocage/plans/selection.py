"""Candidate plots from GPS points and from the plots of earlier years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.projection import to_lambert93
from ..operators import tables as t
from ..sources import layers
from . import landscape as p


def gps_candidates(rows: DataFrame, x: str, y: str, order: list[str], year: str = "2022") -> DataFrame:
    """Points of the rows whose coordinates were approved, in metres, with ids ``year_1, year_2`` … in the order of the file.

    Ids are given after the selection, so there are no gaps.
    """
    kept = layers.points_from_columns(rows.where("coord_ok = 'oui'"), x, y)
    numbered = t.with_row_number(to_lambert93(kept), order, "_no")
    return numbered.select(
        "*", F.concat_ws("_", F.lit(year), F.col("_no").cast("string")).alias("id_plot"),
        F.lit("OUI").alias("AB"), F.lit("NON").alias("filet"), F.lit("NON").alias("paire"),
    ).drop("_no")


def with_info(plots: DataFrame, info: DataFrame) -> DataFrame:
    """Plots (``id_plot`` of any type) with the attributes of the sheet, whose key is ``id_parcelle``."""
    text = plots.withColumn("id_plot", F.col("id_plot").cast("string"))
    return t.merge(text, info.withColumn("id_parcelle", F.col("id_parcelle").cast("string")), "id_plot", "id_parcelle", "left", ("plot", "info"))


def candidates_organic_no_net(gps: DataFrame, plots: DataFrame) -> DataFrame:
    """``id_plot, AB, filet, paire, x, y``: GPS points, and plots that are organic, without net and still valid."""
    kept = plots.where("AB = 'OUI' AND filet = 'NON' AND valide_2022 = 'ok'").withColumn("paire", F.lit("OUI"))
    columns = ["id_plot", "AB", "filet", "paire", "x", "y"]
    return t.union_by_name(gps.select(*columns), kept.select(*columns))


def exclusion_plots(plots: DataFrame) -> DataFrame:
    """Valid exclusion plots, and every plot whose pair was torn out (``and`` binds before ``or``)."""
    return plots.where("exclu = 'oui' AND valide_2022 = 'ok' OR valide_2022 = 'binome_arrachee'")


def candidates_exclusion(gps: DataFrame, plots: DataFrame, new: DataFrame, potential: DataFrame) -> DataFrame:
    """``id_plot, AB, filet, exclu, valide_2022, x, y`` of all four sources, with the defaults for missing values.

    Coordinates of ``potential`` are degrees whatever their label says.
    """
    moved = to_lambert93(g.set_srid(potential, 4326))
    every = t.union_by_name(gps, exclusion_plots(plots), new, moved)
    for column in ("exclu", "valide_2022"):
        if column not in every.columns:
            every = every.withColumn(column, F.lit(None).cast("string"))
    return p.candidates(every.select("id_plot", "AB", "filet", "exclu", "valide_2022", "x", "y"))


def sebiopag_plots(plots: DataFrame) -> DataFrame:
    return plots.where("sebiopag = 'oui'")


def export_candidates(candidates: DataFrame, table: DataFrame, folder: str) -> DataFrame:
    """The table with the geometry of the candidates, over all columns that both share; written as a sheet and as a layer.

    Rows of the table without a candidate stay, without geometry.
    """
    found = t.natural_merge(candidates, table, "right")
    sheet = found.drop("geometry")
    layers.write_table(sheet, f"{folder}/candidates.csv", "\t", order=["id_plot"])
    layers.write_layer(found, f"{folder}/candidates.layer")
    return found
