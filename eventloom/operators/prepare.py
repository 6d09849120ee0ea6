"""From extracted events to graph nodes: keep-first dedup, dates, places, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import event_id
from eventloom.runtime import cut


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the smallest `order` for each value of key (null is a value too)."""
    struct = F.struct(order, *[c for c in rows.columns if c not in (order, key)])
    return rows.groupBy(key).agg(F.min_by(struct, order).alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def renumber(rows: DataFrame, order: str, name: str = "seq_id") -> DataFrame:
    """rows with consecutive numbers from 0 in the order of `order`: range partitions are counted first, then numbered within."""
    parts = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.join(F.broadcast(before), "_part").withColumn(name, number).drop("_part", "_before")


def valid_dates(rows: DataFrame, when: str) -> DataFrame:
    """rows whose text date parses as an ISO 8601 date or timestamp, with the column as a timestamp."""
    return rows.withColumn(when, F.try_to_timestamp(when)).where(F.col(when).isNotNull())


def published_at(text: str, fallback: Column) -> Column:
    """A publication date as ISO 8601 or as news feeds write it (Tue, 02 Jan 2024 08:00:00 GMT or +0200), or the fallback where it does not parse."""
    # The day's name is left out: it says nothing that the date does not. Names of zones are fixed values of the feed format.
    feed = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    feed = F.regexp_replace(feed, r"\s+(?:GMT|UTC?|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(feed, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(feed, F.lit("d MMM yyyy HH:mm:ss")), fallback)


def geo_columns(where: str) -> tuple[Column, Column, Column]:
    """(country, lat, lon) of a `where` JSON text: the first of a list; its first location, or a flat country, lat, long; else, and where the
    numbers are no legal coordinates (strings are none), Unknown at (0, 0)."""
    whole = F.try_parse_json(where)
    kind = F.schema_of_variant(whole)
    item = F.when(kind.startswith("ARRAY"), F.try_variant_get(whole, "$[0]", "variant")).otherwise(whole)
    locations = F.try_variant_get(item, "$.locations", "variant")
    spot = F.when(locations.isNotNull(), F.try_variant_get(locations, "$[0]", "variant")).otherwise(item)

    def number(key: str) -> Column:
        value = F.try_variant_get(spot, f"$.{key}", "variant")
        numeric = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|DECIMAL)")
        return F.when(numeric, F.try_variant_get(spot, f"$.{key}", "double"))

    lat, lon = number("lat"), number("long")
    legal = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    country = F.when(legal, F.coalesce(F.try_variant_get(spot, "$.country", "string"), F.lit("Unknown"))).otherwise("Unknown")
    return country, F.when(legal, lat).otherwise(0.0), F.when(legal, lon).otherwise(0.0)


def prepare_nodes(events: DataFrame, order: str = "ord") -> DataFrame:
    """Extracted events (ord, what, when text, where JSON text, keywords, ...) as nodes: duplicates of `what` go first, then invalid dates; then numbers, places and ids."""
    rows = renumber(valid_dates(keep_first(events, "what", order), "when"), order)
    country, lat, lon = geo_columns("where")
    return rows.withColumns({"lat": lat, "lon": lon, "where": country, "event_id": event_id("seq_id", "keywords", "when")})
