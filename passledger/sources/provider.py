"""Provider JSON documents to typed rows; a bad document keeps its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.functions.geometry import finite
from passledger.functions.scalars import first_reason, text_to_micros

_CONTACT = (
    "contact struct<id:string,spacecraft_id:string,system_id:string,station_id:string,"
    "mission_profile_id:string,ephemeris_id:string,start_time:string,end_time:string,"
    "state:string,external_ref:string>"
)
_PLACE = "struct<latitude:string,longitude:string,altitude:string>"
_ANTENNA = (
    f"antenna struct<id:string,name:string,station:string,location:{_PLACE},"
    "bands:array<struct<type:string>>>, "
    f"expanded struct<stations:array<struct<id:string,name:string,location:{_PLACE}>>>"
)
_SPACECRAFT = (
    "spacecraft struct<id:string,name:string,satellite_catalog_number:string,norad_id:string>"
)
_STATION = f"station struct<id:string,name:string,location:{_PLACE}>"
_EPHEMERIS = (
    "ephemeris struct<ephemeris_uuid:string,id:string,spacecraft_uuid:string,kind:string,"
    "epoch:string,submitted_at:string,inline:struct<tle:string,omm:string,oem:string>,is_cui:string>"
)


def _absent(*names: str) -> list[tuple[Column, str]]:
    return [
        (F.coalesce(F.trim(n.split(":")[0]), F.lit("")) == "", f"missing {n.split(':')[-1]}")
        for n in names
    ]


def parse_contacts(documents: DataFrame, column: str = "document") -> DataFrame:
    kept = [c for c in documents.columns if c != column]
    body = documents.select(*kept, F.from_json(column, _CONTACT)["contact"].alias("_c"))
    flat = body.select(*kept, "_c.*").withColumns(
        {
            "start_us": text_to_micros(F.col("start_time")),
            "end_us": text_to_micros(F.col("end_time")),
        }
    )
    rules = _absent("id:contact id", "spacecraft_id", "system_id", "station_id", "ephemeris_id")
    rules += [
        (F.col("start_us").isNull(), "invalid start_time"),
        (F.col("end_us").isNull(), "invalid end_time"),
        (F.col("end_us") <= F.col("start_us"), "contact stop must be later than its start"),
    ]
    return flat.select(
        *kept, "id", "spacecraft_id", "system_id", "station_id", "ephemeris_id", "start_us", "end_us",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("mission_profile_id", "state", "external_ref")],
        first_reason(rules).alias("reason"),
    )


def parse_antennas(documents: DataFrame, column: str = "document") -> DataFrame:
    """Antenna rows; the station's name and place come from the expanded list."""
    kept = [c for c in documents.columns if c != column]
    flat = documents.select(*kept, F.from_json(column, _ANTENNA).alias("_d")).select(
        *kept, "_d.antenna.*", F.col("_d.expanded.stations").alias("_stations")
    )
    mine = F.filter("_stations", lambda s: s["id"] == F.col("station"))
    flat = flat.withColumn("_mine", F.try_element_at(mine, F.lit(1)))
    place = {
        n: F.coalesce(F.col(f"location.{n}"), F.col(f"_mine.location.{n}")).try_cast("double")
        for n in ("latitude", "longitude", "altitude")
    }
    flat = flat.withColumns(place)
    rules = _absent("id:antenna id", "name:antenna name", "station:antenna station")
    rules += [(~finite(F.col(n)), f"antenna {n} must be a finite number") for n in place]
    names = F.filter(F.transform("bands", lambda b: b["type"]), lambda b: b.isNotNull() & (b != ""))
    return flat.select(
        *kept, "id", "name", F.col("station").alias("station_id"),
        F.coalesce("_mine.name", F.lit("UNKNOWN")).alias("station_name"),
        *place, F.coalesce(names, F.array().cast("array<string>")).alias("bands"),
        first_reason(rules).alias("reason"),
    )


def parse_spacecraft(documents: DataFrame, column: str = "document") -> DataFrame:
    """Spacecraft rows; the catalogue number is integral, padded to five digits."""
    kept = [c for c in documents.columns if c != column]
    flat = documents.select(*kept, F.from_json(column, _SPACECRAFT)["spacecraft"].alias("_c")).select(
        *kept, "_c.*"
    )
    raw = F.coalesce(F.nullif("satellite_catalog_number", F.lit("")), "norad_id").try_cast("double")
    whole = F.when(finite(raw) & (raw == F.floor(raw)), raw.cast("long").cast("string"))
    catalog = F.when(F.length(whole) < 5, F.lpad(whole, 5, "0")).otherwise(whole)
    flat = flat.withColumn("_raw", raw).withColumn("catalog", catalog)
    rules = _absent("id:spacecraft id", "name:spacecraft name")
    rules += [
        (~finite(F.col("_raw")), "catalog id must be a finite number"),
        (F.col("catalog").isNull(), "catalog id must be integral"),
        (~F.length("catalog").isin(5, 9), "catalog id must contain 5 or 9 digits"),
    ]
    return flat.select(*kept, "id", "name", "catalog", first_reason(rules).alias("reason"))


def parse_stations(documents: DataFrame, column: str = "document") -> DataFrame:
    kept = [c for c in documents.columns if c != column]
    flat = documents.select(*kept, F.from_json(column, _STATION)["station"].alias("_c")).select(
        *kept, "_c.*"
    )
    place = {n: F.col(f"location.{n}").try_cast("double") for n in ("latitude", "longitude", "altitude")}
    flat = flat.withColumns(place)
    rules = [(F.col("location").isNull(), "station has no location")]
    rules += _absent("id:station id", "name:station name")
    rules += [(~finite(F.col(n)), f"station {n} must be a finite number") for n in place]
    return flat.select(*kept, "id", "name", *place, first_reason(rules).alias("reason"))


def parse_ephemerides(documents: DataFrame, column: str = "document") -> DataFrame:
    kept = [c for c in documents.columns if c != column]
    flat = documents.select(*kept, F.from_json(column, _EPHEMERIS)["ephemeris"].alias("_c")).select(
        *kept, "_c.*"
    )
    flat = flat.withColumn("ephemeris_id", F.coalesce(F.nullif("ephemeris_uuid", F.lit("")), "id"))
    rules = _absent("ephemeris_id:ephemeris id", "spacecraft_uuid:ephemeris spacecraft")
    return flat.select(
        *kept, "ephemeris_id", F.col("spacecraft_uuid").alias("spacecraft_id"),
        F.coalesce("kind", F.lit("")).alias("kind"),
        text_to_micros(F.col("epoch")).alias("epoch_us"),
        text_to_micros(F.col("submitted_at")).alias("submitted_us"),
        F.col("inline.tle").alias("tle"), F.col("inline.omm").alias("omm"), F.col("inline.oem").alias("oem"),
        F.when(F.col("is_cui") == "true", True).when(F.col("is_cui") == "false", False).alias("is_cui"),
        first_reason(rules).alias("reason"),
    )


def ephemeris_identity(ephemerides: DataFrame) -> DataFrame:
    """COSPAR and catalogue ids of every document of an ephemeris; they must agree."""
    firsts = F.filter(F.split("tle", "\n"), lambda x: F.substring(x, 1, 2) == "1 ")
    safe_line = F.try_element_at(firsts, F.lit(1))
    designator = F.trim(F.substring(safe_line, 10, 8))
    year = F.substring(designator, 1, 2).try_cast("int")
    full = F.when(year >= 57, year + 1900).otherwise(year + 2000)
    from_tle = F.when(
        full.isNotNull(),
        F.concat(full.cast("string"), F.lit("-"), F.substring(designator, 3, 9)),
    )

    def named(document: str, key: str) -> Column:
        found = F.regexp_extract(document, rf"(?m)^\s*{key}\s*=\s*(\S+)", 1)
        return F.when(found != "", found)

    cospars = F.array_compact(
        F.array(from_tle, named("omm", "OBJECT_ID"), named("oem", "OBJECT_ID"))
    )
    number = F.trim(F.substring(safe_line, 3, 5)).try_cast("int").cast("string")
    catalogs = F.array_compact(
        F.array(
            number,
            F.when(named("omm", "OBJECT_ID").isNotNull(), named("omm", "NORAD_CAT_ID")),
            F.when(named("oem", "OBJECT_ID").isNotNull(), named("oem", "NORAD_CAT_ID")),
        )
    )
    staged = ephemerides.withColumn("_cospars", F.array_distinct(cospars)).withColumn(
        "_catalogs", F.array_distinct(catalogs)
    )
    reason = first_reason(
        [
            (F.size("_cospars") == 0, "no usable object identity"),
            ((F.size("_cospars") > 1) | (F.size("_catalogs") > 1), "identities do not match"),
        ]
    )
    return staged.withColumns(
        {
            "cospar": F.try_element_at("_cospars", F.lit(1)),
            "catalog": F.try_element_at("_catalogs", F.lit(1)),
            "reason": reason,
        }
    ).drop("_cospars", "_catalogs")
