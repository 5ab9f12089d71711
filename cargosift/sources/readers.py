"""Readers of shipments and of the small reference tables, and writers of decisions."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargosift import schemas
from cargosift.config import COUNTRIES, PARTIES, TAXONOMY, COUNTRY_LEVELS
from cargosift.functions import expressions as E


def shipments(spark: SparkSession, path: str, full_columns: bool = False) -> DataFrame:
    """Shipments of a .json file (a list, or an object with a list named shipments) or a .csv file; suffixes of any case.

    An object without shipments raises, and so do items without id or description, when they are read. CSV files give id (or shipment_id)
    and description alone unless full_columns is set; other suffixes raise.
    """
    kind = path.lower()
    if kind.endswith(".json"):
        head = spark.read.text(path).where("trim(value) <> ''").first()
        if head is not None and head.value.strip().startswith("{"):
            wrapped = spark.read.schema(f"shipments array<{schemas.SHIPMENT.simpleString()}>").option("multiLine", True).json(path)
            if wrapped.where("shipments is null").limit(1).count():
                raise ValueError("JSON must be a list or contain a 'shipments' key")
            out = wrapped.select(F.explode("shipments").alias("s")).select("s.*")
        else:
            out = spark.read.schema(schemas.SHIPMENT).option("multiLine", True).json(path)
        needed = lambda c: F.coalesce(c, F.raise_error(F.lit(f"a shipment has no {c}")).cast("string")).alias(c)
        out = out.select(*[needed(c) if c in ("id", "description") else c for c in out.columns])
    elif kind.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
        ids = [F.col(c) for c in ("id", "shipment_id") if c in raw.columns]
        cols = {"id": F.coalesce(*ids, F.lit("")), "description": F.coalesce(F.col("description"), F.lit("")) if "description" in raw.columns else F.lit("")}
        extra = [f for f in schemas.SHIPMENT if full_columns and f.name in raw.columns and f.name not in cols]
        out = raw.select(*[c.alias(n) for n, c in cols.items()], *[(F.split(F.col(f.name), r"\|") if f.name == "transit_countries" else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in extra if f.name != "metadata"])
    else:
        raise ValueError(f"shipments come from .json or .csv files, not {path}")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SHIPMENT if f.name not in out.columns]
    out = out.select("*", *missing).select(*schemas.SHIPMENT.names)
    return out.withColumn("transit_countries", F.coalesce("transit_countries", F.array().cast("array<string>"))).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def validate_taxonomy(groups: list[dict]) -> list[dict]:
    """The groups with defaults filled; raises on a missing or repeated group_id or a group without phrases."""
    seen: set[str] = set()
    out = []
    for g in groups:
        if not g.get("group_id"):
            raise ValueError("taxonomy group without group_id")
        if g["group_id"] in seen:
            raise ValueError(f"taxonomy group {g['group_id']} occurs twice")
        if not g.get("semantic_phrases"):
            raise ValueError(f"taxonomy group {g['group_id']} has no semantic phrase")
        seen.add(g["group_id"])
        out.append({"name": g["group_id"], "risk_level": "medium", "allow_auto_clear": False, "hard_keywords": []} | g)
    return out


def taxonomy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Taxonomy groups with their order; the built-in sample without a path. A missing file raises FileNotFoundError."""
    groups = TAXONOMY
    if path is not None:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        with open(path) as f:
            raw = json.load(f)
        if not isinstance(raw, dict) or "groups" not in raw:
            raise ValueError("taxonomy file without groups")
        groups = raw["groups"]
    rows = [(i, *(g[k] for k in ("group_id", "name", "risk_level", "allow_auto_clear", "semantic_phrases", "hard_keywords"))) for i, g in enumerate(validate_taxonomy(groups))]
    return spark.createDataFrame(rows, "group_idx int, " + schemas.TAXONOMY)


def phrases(groups: DataFrame) -> DataFrame:
    """Rows (phrase_idx, phrase, group_idx, group_id, risk_level) of the groups of taxonomy(), numbered over all groups in order.

    A phrase's group is the row of its number, a group's phrases are the rows of its group_idx, and counts are counts of rows. A configured table.
    """
    rows = groups.select("group_idx", "group_id", "risk_level", F.posexplode("semantic_phrases").alias("_p", "phrase"))
    return rows.select((F.row_number().over(Window.orderBy("group_idx", "_p")) - 1).alias("phrase_idx"), "phrase", "group_idx", "group_id", "risk_level")


def write_taxonomy(groups: list[dict], path: str) -> None:
    """Replaces a taxonomy file after validation."""
    checked = validate_taxonomy(groups)
    with open(path + ".part", "w") as f:
        json.dump({"version": "1.0", "groups": checked}, f, indent=2)
    os.replace(path + ".part", path)


def denied_parties(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Rows (ord, matched_party, alias, key, list_name): every name of every party; a missing file gives none."""
    parties = PARTIES
    if path is not None:
        raw = json.load(open(path)) if os.path.exists(path) else []
        if not isinstance(raw, (dict, list)):
            raise ValueError("denied parties must be an object or a list")
        default = raw.get("list_name", "default") if isinstance(raw, dict) else "default"
        listed = raw.get("parties", []) if isinstance(raw, dict) else raw
        parties = [{"aliases": [], "country": None, "list_name": default} | p for p in listed if p.get("name")]
    rows = [(p["name"], list(p.get("aliases") or []), p.get("country"), p.get("list_name") or "default") for p in parties]
    base = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "party int, " + schemas.PARTY)
    names = base.select("party", F.col("name").alias("matched_party"), "list_name", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n", "alias"))
    return names.select((F.col("party") * 1000 + F.col("n")).alias("ord"), "matched_party", "alias", E.normal_name(F.col("alias")).alias("key"), "list_name")


@dataclass(frozen=True)
class CsvColumns:
    """Vendor names of the country-risk columns."""

    country_code: str = "country_code"
    country_name: str = "country_name"
    overall_risk: str = "risk_tier"
    overall_score: str = "risk_score"
    sanctions_status: str = "sanctions_status"
    fatf_status: str = "fatf_status"
    transshipment_hub: str = "transshipment_hub"
    sanctioned_neighbors: str = "sanctioned_neighbors"


def country_risk(spark: SparkSession, path: str | None = None, columns: CsvColumns | None = None) -> DataFrame:
    """Country-risk rows keyed by code, with the derived is_sanctioned, is_fatf_listed, is_high_risk and near_sanctioned.

    .csv files are read with vendor names and aliases, other files as JSON whose enumerations must be exact;
    a missing file gives no rows, no path the built-in sample. The last row of a repeated code holds.
    """
    if path is None:
        raw = spark.createDataFrame([tuple(c.values()) for c in COUNTRIES], schemas.COUNTRY).withColumn("source", F.lit("sample"))
    elif not os.path.exists(path):
        raw = spark.createDataFrame([], schemas.COUNTRY + ", source string")
    elif path.endswith(".csv"):
        raw = _country_csv(spark, path, columns or CsvColumns())
    else:
        got = json.load(open(path))
        listed = got.get("countries", []) if isinstance(got, dict) else got
        source = got.get("source", "unknown") if isinstance(got, dict) else "unknown"
        rows = []
        for c in listed:
            if not c.get("country_code"):
                continue
            row = {"country_name": None, "overall_risk": "unknown", "overall_score": 0.0, "sanctions_status": "none", "fatf_status": "unknown", "transshipment_hub": False, "sanctioned_neighbors": []} | {k: v for k, v in c.items() if v is not None}
            if row["overall_risk"] not in COUNTRY_LEVELS or row["sanctions_status"] not in ("none", "sectoral", "comprehensive") or row["fatf_status"] not in ("compliant", "grey", "black", "unknown"):
                raise ValueError(f"country {row['country_code']} has an unknown level")
            rows.append((row["country_code"], row["country_name"], row["overall_risk"], float(row["overall_score"]), row["sanctions_status"], row["fatf_status"], bool(row["transshipment_hub"]), list(row["sanctioned_neighbors"]), c.get("source", source)))
        raw = spark.createDataFrame(rows, schemas.COUNTRY + ", source string")
    keyed = raw.withColumn("country_code", F.upper(E.strip(F.col("country_code")))).withColumn("n", F.monotonically_increasing_id())
    last = keyed.groupBy("country_code").agg(F.max_by(F.struct(*[c for c in keyed.columns if c not in ("country_code", "n")]), "n").alias("r")).select("country_code", "r.*")
    own = last.withColumn("is_sanctioned", F.col("sanctions_status").isin("sectoral", "comprehensive")).withColumn("is_fatf_listed", F.col("fatf_status").isin("grey", "black")).withColumn("is_high_risk", F.col("overall_risk").isin("high", "critical"))
    near = own.select(F.col("country_code").alias("c"), F.posexplode("sanctioned_neighbors").alias("p", "n")).join(own.where("is_sanctioned").select(F.col("country_code").alias("k")), F.upper(E.strip(F.col("n"))) == F.col("k"), "left_semi")
    near = near.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "n"))), lambda x: x["n"]).alias("near_sanctioned"))
    return own.join(near, own["country_code"] == near["c"], "left").drop("c").withColumn("near_sanctioned", F.coalesce("near_sanctioned", F.array().cast("array<string>")))


def _country_csv(spark: SparkSession, path: str, columns: CsvColumns) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    names = asdict(columns)
    cell = lambda k: F.col(f"`{names[k]}`") if names[k] in raw.columns else F.lit(None).cast("string")
    neighbors = F.filter(F.transform(F.split(F.coalesce(cell("sanctioned_neighbors"), F.lit("")), r"\|"), E.strip), lambda x: x != "")
    out = raw.select(
        E.strip(cell("country_code")).alias("country_code"), cell("country_name").alias("country_name"), E.parse_level(cell("overall_risk")).alias("overall_risk"),
        E.parse_share(cell("overall_score")).alias("overall_score"), E.parse_sanctions(cell("sanctions_status")).alias("sanctions_status"),
        E.parse_fatf(cell("fatf_status"), names["fatf_status"] in raw.columns).alias("fatf_status"), E.parse_bool(cell("transshipment_hub")).alias("transshipment_hub"),
        neighbors.alias("sanctioned_neighbors"), F.lit("csv").alias("source"),
    )
    return out.where(F.coalesce(F.col("country_code") != "", F.lit(False)))


def decision_csv(decisions: DataFrame) -> DataFrame:
    """The six columns of the CSV form of decisions."""
    return decisions.select("shipment_id", "action", "reason", F.size("taxonomy_hits").alias("taxonomy_hits_count"), F.col("classification.label").alias("classification_label"), E.fixed(F.col("classification.confidence"), 4).alias("classification_confidence"))


def write_decisions(decisions: DataFrame, path: str, form: str = "json") -> None:
    """Writes decisions as JSON lines or CSV; other forms raise."""
    if form == "json":
        decisions.write.mode("overwrite").json(path)
    elif form == "csv":
        decision_csv(decisions).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"decisions are written as json or csv, not {form}")


def write_log(events: DataFrame, path: str, logger: str = "cargosift.screening") -> None:
    """Appends disagreements (see decisions.disagreements) as a log of JSON lines, warnings with their fields."""
    own = F.struct(
        F.current_timestamp().cast("string").alias("timestamp"), F.lit("WARNING").alias("level"), F.lit(logger).alias("logger"), F.lit("Screening disagreement detected").alias("message"), F.lit("screening_disagreement").alias("event"),
        "shipment_id", "taxonomy_action", "ai_action", "ai_confidence", F.col("description").alias("description_preview"),
    )
    events.select(F.to_json(own).alias("value")).write.mode("append").text(path)
