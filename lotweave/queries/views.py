"""Test views over the driver tables: one SQL text read by both Spark and DuckDB.

``{name}`` stands for a driver table or an earlier view.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.functions import risk as rk
from lotweave.functions import vocab
from lotweave.session import cut_lineage

#: Tables whose rows pass through long row rules; a small file of them would be read by one task.
DEALT = ("customer", "documents")
WRITTEN = ("customer",)
#: Rows that one task may take before the rows are dealt to more.
ROWS_A_TASK = 4096

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # lattice parcels of 0.002 degrees; corners are whole thousandths, so shared corners are equal
    "lots": """
SELECT k.*, concat('APN-', lpad(cast(pos AS string), 8, '0')) AS parcel_id,
  (-117200 + 2 * gx) / 1000e0 AS x0, (32700 + 2 * gy) / 1000e0 AS y0,
  (-117200 + 2 * gx + 2) / 1000e0 AS x1, (32700 + 2 * gy + 2) / 1000e0 AS y1,
  (-117200 + 2 * gx + 1) / 1000e0 AS lon, (32700 + 2 * gy + 1) / 1000e0 AS lat,
  500e0 + 10 * (pos % 50) AS area_m2,
  greatest(0e0, 0.8e0 - risk) AS s_residential, greatest(0e0, 0.7e0 - risk * 0.8e0) AS s_commercial,
  greatest(0e0, 0.6e0 - risk * 0.5e0) AS s_industrial, least(1e0, 0.2e0 + risk) AS s_green
FROM (SELECT c_custkey AS pos, c_custkey % 40 AS gx, cast(floor(c_custkey / 40) AS bigint) AS gy, c_nationkey, c_mktsegment,
        least(greatest((c_acctbal + 999e0) / 11000e0, 0e0), 1e0) AS risk FROM {customer}) k""",
    # the same parcels as loose properties under many names
    "props": """
SELECT pos, parcel_id, gx, gy, x0, y0, x1, y1, lon, lat, risk,
  CASE WHEN pos % 7 <> 0 THEN concat('F', cast(pos AS string)) END AS feature_id,
  CASE WHEN pos % 5 <> 4 THEN parcel_id END AS apn,
  CASE WHEN pos % 3 = 0 THEN concat(' PID-', cast(pos AS string), ' ') WHEN pos % 3 = 1 THEN '  ' END AS pid,
  CASE WHEN pos % 2 = 0 THEN concat('JK-', cast(pos AS string)) END AS join_key,
  CASE WHEN pos % 6 = 0 THEN risk END AS r_norm,
  CASE WHEN pos % 6 = 1 THEN risk * 1.2e0 END AS r_env,
  CASE WHEN pos % 6 IN (1, 2) THEN risk * 130e0 - 10e0 END AS r_xgb,
  CASE WHEN pos % 6 IN (2, 3) THEN risk * 100e0 END AS r_rule,
  CASE WHEN pos % 6 = 4 THEN 'n/a' END AS r_score,
  CASE WHEN pos % 4 < 3 THEN (pos * 3) % 4 END AS has_flood,
  CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END AS has_fault, CASE WHEN pos % 7 = 0 THEN 1 ELSE 0 END AS has_liquefaction,
  CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END AS is_steep, CASE WHEN pos % 11 = 0 THEN 1 ELSE 0 END AS is_fire_zone,
  CASE WHEN pos % 13 = 0 THEN 1 ELSE 0 END AS in_esa, CASE WHEN pos % 17 = 0 THEN 1 ELSE 0 END AS in_mscp,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CC-3-6' WHEN 'BUILDING' THEN 'RS-1-7' WHEN 'FURNITURE' THEN 'M52'
    WHEN 'HOUSEHOLD' THEN 'RM-3-7' ELSE 'A70' END AS zoning_code,
  CASE pos % 7 WHEN 0 THEN 'Open Space' WHEN 1 THEN 'Single Family Residential' WHEN 2 THEN 'Mixed Use'
    WHEN 3 THEN 'General Commercial' WHEN 4 THEN 'Agriculture' WHEN 5 THEN 'Light Warehouse' END AS gp,
  CASE pos % 9 WHEN 0 THEN 'Residential, Green' WHEN 1 THEN 'commercial;industrial' WHEN 2 THEN 'mixed use, park' END AS allowed_txt,
  CASE pos % 8 WHEN 0 THEN 'Single Family' WHEN 1 THEN 'Retail Center' WHEN 2 THEN 'Heavy Industry' WHEN 3 THEN 'City Park'
    WHEN 4 THEN 'Housing & Office' WHEN 5 THEN 'residential' WHEN 6 THEN 'vacant' END AS land_use,
  CASE c_nationkey % 3 WHEN 0 THEN 'City of San Diego' WHEN 1 THEN 'County of San Diego' ELSE 'Chula Vista' END AS jurisdiction,
  CASE WHEN pos % 10 < 3 THEN risk * 0.9e0 END AS suit_res, CASE WHEN pos % 10 = 1 THEN 55e0 END AS green,
  CASE WHEN pos % 6 <> 5 THEN area_m2 END AS area_prop, CASE WHEN pos % 12 = 5 THEN area_m2 * 2e0 END AS shape_area,
  CASE WHEN pos % 4 <> 0 THEN 4e0 * sqrt(area_m2) END AS perimeter,
  CASE WHEN pos % 3 <> 0 THEN 20e0 + 130e0 * risk END AS aqi, CASE WHEN pos % 4 <> 1 THEN 100e0 * risk END AS imperv,
  CASE WHEN pos % 5 <> 2 THEN 5e0 + pos % 36 END AS clay, CASE WHEN pos % 7 <> 3 THEN 10e0 + pos % 71 END AS sand,
  CASE pos % 20 WHEN 1 THEN 'Yes' WHEN 2 THEN 'no' WHEN 3 THEN 'maybe' END AS zcompat,
  CASE WHEN pos % 3 = 0 THEN concat('APN-', lpad(cast(pos + 1 AS string), 8, '0'), '; APN-', lpad(cast(pos + 40 AS string), 8, '0')) END AS neigh
FROM {lots}""",
    # hazard rectangles on half steps, seven layers
    "hazards": """
SELECT pos, pos % 7 AS layer_no, (-234400 + 4 * ((pos * 13) % 40) + 1) / 2000e0 AS x0, (65400 + 4 * ((pos * 7) % 38) + 1) / 2000e0 AS y0,
  (-234400 + 4 * ((pos * 13) % 40) + 7) / 2000e0 AS x1, (65400 + 4 * ((pos * 7) % 38) + 7) / 2000e0 AS y1
FROM (SELECT s_suppkey AS pos FROM {supplier}) s""",
    # overlapping boundary and county zone rectangles with gaps in their attributes
    "zones": """
SELECT cast(n_nationkey AS bigint) AS rn, (-234400 + 32 * (n_nationkey % 5) + 1) / 2000e0 AS x0,
  (65400 + 32 * cast(floor(n_nationkey / 5) AS int) + 1) / 2000e0 AS y0,
  (-234400 + 32 * (n_nationkey % 5) + 41) / 2000e0 AS x1, (65400 + 32 * cast(floor(n_nationkey / 5) AS int) + 41) / 2000e0 AS y1,
  CASE n_nationkey % 3 WHEN 0 THEN 'City of San Diego' WHEN 1 THEN concat('County ', n_name) END AS name,
  CASE WHEN n_nationkey % 2 = 0 THEN concat('A', cast(70 + n_nationkey AS string)) END AS usereg,
  CASE WHEN n_nationkey % 4 <> 1 THEN 30e0 + n_nationkey END AS height,
  CASE WHEN n_nationkey % 5 <> 2 THEN n_nationkey / 10e0 END AS far
FROM {nation}""",
    "gp_areas": """
SELECT cast(r_regionkey AS bigint) AS rn, -118e0 AS x0, (65400 + 32 * r_regionkey + 1) / 2000e0 AS y0, -117e0 AS x1,
  (65400 + 32 * r_regionkey + 51) / 2000e0 AS y1, CASE WHEN r_regionkey <> 1 THEN r_name END AS gp_lu
FROM {region}""",
    # zoning attribute rows keyed to parcels, with duplicates
    "zoning_attrs": """
SELECT o_orderkey AS row_id, o_orderpriority AS zone_text, o_totalprice AS height,
  concat('APN-', lpad(cast(CASE WHEN o_orderkey % 5 = 4 THEN o_orderkey - 3 ELSE o_orderkey END AS string), 8, '0')) AS apn
FROM {orders}""",
    # five complete plans over the parcels
    "genes": """
SELECT p.plan, l.pos, l.parcel_id, cast((31 * l.pos + 17 * p.plan + cast(floor(l.pos / 7) AS bigint)) % 4 AS int) AS use_code
FROM {lots} l CROSS JOIN (SELECT 0 AS plan UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p""",
    # the same with label noise and missing rows
    "assignments": """
SELECT plan, pos, parcel_id, use_code,
  CASE WHEN (pos + plan) % 29 = 0 THEN 'mixed_use' ELSE
    CASE use_code WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'industrial' ELSE 'green' END END AS use_label
FROM {genes} WHERE NOT (plan = 3 AND pos % 10 = 0)""",
    "individuals": """
SELECT p_partkey AS id, p_brand AS run, cast(p_size AS double) AS o1, p_retailprice AS o2, cast(p_partkey % 17 AS double) AS o3 FROM {part}""",
    # regulation pages: markers or blank lines put into the texts
    "reg_pages": """
SELECT doc_id AS page_id, concat(source, CASE WHEN source LIKE '%1%' THEN '_county.pdf' WHEN source LIKE '%2%' THEN '_city.pdf' ELSE '.pdf' END) AS source,
  CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', concat('. Section ', cast(1000 + doc_id % 9000 AS string), ' '))
    WHEN 1 THEN concat('RS-1-7 and M52 zones. municipal code ', replace(text, chr(10), concat(chr(10), chr(10))))
    ELSE text END AS text
FROM {documents}""",
    "job_events": """
SELECT user_id AS job_id, event_id, ts,
  CASE event_type WHEN 'view' THEN 'environment' WHEN 'click' THEN 'zoning' WHEN 'purchase' THEN 'merge' WHEN 'signup' THEN 'spatial' ELSE 'note' END AS step,
  CASE WHEN value < 2 THEN 'pending' WHEN value < 8 THEN 'running' WHEN value < 30 THEN 'completed' WHEN value < 60 THEN 'skipped' ELSE 'failed' END AS status
FROM {events}""",
    "turns": """
SELECT conv_id AS session_id, turn, role, text FROM {conversations}""",
}


def oracle(body: str) -> str:
    """DuckDB text of ``body`` with the views it names as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{([a-z]\w*)\}", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    names = {n: n for n in (*TABLES, *VIEWS)}
    plain = lambda t: re.sub(r"\{([a-z]\w*)\}", lambda m: names[m.group(1)], t)
    ctes = [f"{n} AS ({plain(VIEWS[n])})" for n in needed]
    text = plain(body).strip()
    if not ctes:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + text[len("WITH RECURSIVE"):]
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + text[len("WITH "):]
    return "WITH " + ",\n".join(ctes) + "\n" + text


PROPERTY_NAMES = {
    "apn": "APN", "pid": "parcel_id", "join_key": "join_key", "r_norm": "risk_score_norm", "r_env": "environmental_risk",
    "r_xgb": "xgb_risk_score", "r_rule": "rule_risk_score", "r_score": "risk_score", "has_flood": "has_flood",
    "has_fault": "has_fault", "has_liquefaction": "has_liquefaction", "is_steep": "is_steep", "is_fire_zone": "is_fire_zone",
    "in_esa": "in_esa", "in_mscp": "in_mscp", "zoning_code": "ZONING_CODE", "gp": "GP_LAND_USE", "allowed_txt": "allowed_uses",
    "land_use": "land_use", "jurisdiction": "JURISDICTION", "suit_res": "suitability_residential", "green": "green",
    "area_prop": "area_m2", "shape_area": "Shape_Area", "perimeter": "perimeter_m", "aqi": "aqi_mean",
    "imperv": "impervious_mean", "clay": "soil_clay_pct", "sand": "soil_sand_pct", "zcompat": "zoning_compatible", "neigh": "neighbors",
}


class Data:
    """Driver tables and views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A driver table; compressed rows of a few megabytes are dealt to as many tasks as their number asks for.

        Customers are written once dealt: Spark would move the filters of long rules below the dealing, into one task.
        """
        if name not in self._tables:
            rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            parts = min(most, -(-rows.count() // ROWS_A_TASK)) if name in DEALT else 1
            if parts > 1:
                rows = rows.repartition(parts)
                rows = cut_lineage(rows) if name in WRITTEN else rows
            self._tables[name] = rows
        return self._tables[name]

    def view(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        used = {n: self.view(n) for n in set(re.findall(r"\{([a-z]\w*)\}", text))}
        return self.spark.sql(text, **used)

    def shaped(self, name: str) -> DataFrame:
        df = self.view(name)
        return df.withColumn("geom", g.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).withColumn("geom_type", F.lit("Polygon"))

    @cached_property
    def parcels(self) -> DataFrame:
        """Typed parcels: geometry, suitability map and allowed codes."""
        suit = F.create_map(*[x for u in vocab.LAND_USES for x in (F.lit(u), F.col(f"s_{u}"))])
        codes = [[0, 3], [1, 2], [0, 1, 2, 3], [3], []]
        allowed = F.lit(None)
        for i, c in enumerate(codes):
            allowed = F.when(F.col("pos") % 5 == i, F.array(*[F.lit(v) for v in c]).cast("array<int>")).otherwise(allowed)
        return self.shaped("lots").select("pos", "parcel_id", "lon", "lat", "risk", "area_m2", suit.alias("suit"), allowed.alias("allowed"), "geom", "gx", "gy")

    @cached_property
    def features(self) -> DataFrame:
        """Parcels as loose features: props map without nulls, feature id, geometry."""
        df = self.shaped("props")
        names = F.array(*[F.lit(n) for n in PROPERTY_NAMES.values()])
        values = F.array(*[F.col(c).cast("string") for c in PROPERTY_NAMES])
        props = F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull())
        return df.select("pos", "feature_id", props.alias("props"), "geom_type", "geom", F.col("parcel_id").alias("lot_id"), "lon", "lat")

    @cached_property
    def by_lot(self) -> DataFrame:
        """Features keyed by the lattice parcel id."""
        return self.features.withColumnRenamed("lot_id", "parcel_id")

    @cached_property
    def hazard_layers(self) -> DataFrame:
        from lotweave.operators.spatial import HAZARD_LAYERS

        names = F.array(*[F.lit(n) for n in HAZARD_LAYERS])
        return self.shaped("hazards").withColumn("layer", F.get(names, F.col("layer_no").cast("int")))

    @cached_property
    def pages(self) -> DataFrame:
        from lotweave.sources.geojson import regulation_pages

        return regulation_pages(self.view("reg_pages"))

    def scored_lots(self) -> DataFrame:
        lots = self.view("lots")
        return lots.select("pos", "parcel_id", *[F.col(f"s_{u}").alias(u) for u in vocab.LAND_USES], F.col("risk").alias("environmental_risk"))

    def risk_level(self) -> DataFrame:
        return self.view("lots").select("parcel_id", rk.tier(F.col("risk")).alias("level"))
