"""Every orchard as a target: its landscape, the candidates and monitored plots in it, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import tables as t
from ..operators.overlay import discs, overlay_polygons_discs
from ..operators.shared import written
from ..operators.spatial_join import join_points, match_polygons
from ..operators.stats import correlations
from . import landscape as p

# Names of the land-cover shares, in the order of the table.
SHARES = {
    "vergers": "pourcent_verger", "urbain": "pourcent_urbain", "cult_annuelles": "pourcent_cult_annuelle", "milieu_nat": "pourcent_milieu_nat",
    "prairies": "pourcent_prairies", "vignes": "pourcent_vigne", "autres": "pourcent_autre",
}


def pome_orchards_by_net(land_cover: DataFrame, nets: DataFrame) -> DataFrame:
    """Land-cover polygons that touch a net-layer feature whose code starts with 13, once per FID, with the
    code and net of the first such feature (``net_code_n3``, ``filet``)."""
    own = nets.where(F.col("Code_n3").cast("string").startswith("13")).select(
        F.col("FID").alias("net"), F.col("Code_n3").alias("net_code_n3"), "filet"
    )
    pairs = match_polygons(land_cover, nets.withColumnRenamed("FID", "net"), "FID", "net").join(t.shuffled(own), "net")
    return land_cover.join(t.shuffled(t.first_by_key(pairs, "FID", ["net"]).drop("net")), "FID")


def landscape_of(
    targets: DataFrame, key: str, land_cover: DataFrame, nets: DataFrame, organic: DataFrame, radius: float, vegetation: DataFrame | None = None
) -> DataFrame:
    """``key``, seven land-cover shares of the covered area, shares of organic and netted orchards, and, with
    ``vegetation``, seven shares of it.  All layers go through one overlay, as themes of one layer.

    ``targets``: ``key, x, y``.  Targets without land cover in their disc have no row.  ``percent_verger_bio`` is NULL where
    there are no organic orchards, ``percent_of_orchards_with_nets`` where there are nets but no orchards, the shares of vegetation
    where there is none at all.
    """
    at = discs(targets.select(key, "x", "y"), [radius])
    nominal = p.NOMINAL_DISC * radius * radius
    own = nets.where(F.col("Code_n3").cast("string").startswith("1") & F.col("filet").isin("oui", "mixte"))
    touched = match_polygons(land_cover, own.withColumnRenamed("FID", "net"), "FID", "net").select("FID").distinct()

    def theme(layer: DataFrame, name: str, kind) -> DataFrame:
        return layer.select(F.lit(name).alias("theme"), kind.cast("string").alias("kind"), "geometry")

    none = F.lit(None)
    themes = theme(land_cover, "cover", F.col("Code_n1")).union(theme(land_cover.join(t.shuffled(touched), "FID"), "net", none)).union(theme(organic, "bio", none))
    if vegetation is not None:
        themes = themes.union(theme(vegetation, "green", F.col("NATURE")))
    areas = overlay_polygons_discs(themes, at, ["theme", "kind"])

    def total(name: str, kind=None):
        hit = F.col("theme") == name
        return F.sum(F.when(hit if kind is None else hit & (F.col("kind") == str(kind)), F.col("area_m2")))

    sums = areas.groupBy(key).agg(
        total("cover").alias("_cover"), total("net").alias("_net"), total("bio").alias("_bio"), total("green").alias("_green"),
        *[F.coalesce(total("cover", k), F.lit(0.0)).alias(v) for k, v in p.LAND_COVER.items()],
        *[F.coalesce(total("green", k), F.lit(0.0)).alias(f"_{v}") for k, v in p.VEGETATION.items()],
    ).where("_cover IS NOT NULL")
    net = F.coalesce("_net", F.lit(0.0))
    out = [
        key, *[t.share(k, "_cover").alias(v) for k, v in SHARES.items()], (F.col("_bio") / nominal * 100.0).alias("percent_verger_bio"),
        (net / nominal * 100.0).alias("percent_verger_filet"), t.share(net, "vergers").alias("percent_of_orchards_with_nets"),
    ]
    if vegetation is not None:
        greens = {v: F.when(F.col("_green").isNotNull(), F.col(f"_{v}") / nominal * 100.0) for v in p.SEMI_NATURAL}
        out += [*[c.alias(f"percent_{v}") for v, c in greens.items()], sum(greens.values()).alias("percent_ESN")]
    return sums.select(*out)


def orchard_landscape_table(
    orchards: DataFrame, organic: DataFrame, land_cover: DataFrame, nets: DataFrame, vegetation: DataFrame, radius: float = 500.0
) -> DataFrame:
    """The landscape around every orchard, in 18 columns from ``FID_plot`` on, and the orchard's own columns and geometry."""
    at = g.centroids(orchards.select(F.col("FID").alias("FID_plot"), "geometry"))
    own = t.fill_zero(landscape_of(at, "FID_plot", land_cover, nets, organic, float(radius), vegetation), ["percent_verger_bio"])
    return own.join(t.shuffled(orchards.withColumnRenamed("FID", "FID_plot")), "FID_plot")


def _tagged(table: DataFrame, points: DataFrame, point_id: str) -> DataFrame:
    """One row per orchard and point in it, or one without a point; missing numbers are 0, missing texts '0'."""
    clash = {c: f"orchard_{c}" for c in table.columns if c in points.columns and c not in (point_id, "x", "y")}
    hits = join_points(table.withColumnsRenamed(clash), points, "FID_plot", point_id)
    return t.fill_zero(g.centroids(hits))


def tag_orchards(table: DataFrame, candidates: DataFrame) -> DataFrame:
    """Orchards with the candidate points in them (``candidat`` 1 or 0).

    ``candidates``: ``id_plot, filet, exclu, valide_2022, x, y``.  Column ``filet`` is the orchard's net, ``filet_ok`` the candidate's;
    ``exclu_all`` joins ``exclu`` and ``valide_2022``, so it is ``0_0`` without a candidate.
    """
    points = candidates.select("id_plot", F.col("filet").alias("filet_ok"), "exclu", "valide_2022", "x", "y", F.lit(1).alias("candidat"))
    out = _tagged(table, points, "id_plot").withColumnRenamed("id_plot", "parcelle_suivie")
    return out.withColumn("exclu_all", F.concat_ws("_", "exclu", "valide_2022"))


def without_net(tagged: DataFrame) -> DataFrame:
    """Tagged orchards without those whose pair was torn out and those under nets."""
    return tagged.where("exclu_all <> 'oui_binome_arrachee' AND filet <> 'oui'")


def tag_monitored_plots(table: DataFrame, plots: DataFrame) -> DataFrame:
    """Orchards that hold a monitored plot's centre, with the plot's columns, as centroids."""
    return _tagged(table, plots.withColumn("parcelles_suivies", F.lit(1)), "id_plot").where("parcelles_suivies = 1")


def orchard_correlations(tagged: DataFrame) -> DataFrame:
    """Netted share against orchards, hedges and semi-natural area: orchards without nets, their candidates, valid exclusions."""
    against = "percent_of_orchards_with_nets"
    free = (F.col("exclu_all") != "oui_binome_arrachee") & (F.col("filet") != "oui")
    chosen = F.col("candidat") == 1
    subsets = {
        "all": free, "candidates": free & chosen,
        "exclu": chosen & (F.col("filet_ok") == "NON") & (F.col("exclu") == "oui") & (F.col("valide_2022") == "ok"),
    }
    return correlations(tagged, [(x, against) for x in ("pourcent_verger", "percent_haie", "percent_ESN")], subsets)


def multi_year(*years: DataFrame) -> DataFrame:
    """Rows of the yearly tables, which must have the same columns, each distinct row once."""
    return t.union_by_name(*years, strict=True).distinct()


def landscape_tables(parts: list[DataFrame], radii: list[int]) -> DataFrame:
    """Composition, nets, organic share and hedges, each measured once for all radii, side by side for the plots that all radii have."""
    held = [written(part, "landscape") for part in parts]
    return p.multi_radius([p.landscape_table(*held, r) for r in radii])
