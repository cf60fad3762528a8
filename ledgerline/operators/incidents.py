"""Link probes: outages, incidents, availability KPIs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions.scalars import col, minutes_between
from ledgerline.operators.ranking import previous_row

_DAY = 86400


def _day_block(ts: str = "ts") -> Column:
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / _DAY)


def transitions(probes: DataFrame) -> DataFrame:
    """Rows where a link's status differs from its previous one; ``before`` is NULL for the first probe.

    The previous status is looked up inside (link, day) and across day summaries, so one busy link is spread over days.
    """
    t = previous_row(probes, ["link_id"], _day_block(), ["ts", "probe_id"], F.col("status"), "before")
    return t.filter(F.col("before").isNull() | (F.col("before") != F.col("status")))


def incident_intervals(probes: DataFrame) -> DataFrame:
    """UP/UNKNOWN→DOWN opens an incident, the next UP closes it.  ``probes``: link_id, probe_id, ts, status.

    Probes of an unknown status neither open nor close.  Down minutes are at least one.
    """
    changes = transitions(probes.filter(F.col("status").isin("UP", "DOWN")))
    paired = previous_row(changes, ["link_id"], _day_block(), ["ts", "probe_id"], F.col("ts"), "resolved_at", forward=True)
    down = paired.filter("status = 'DOWN'")
    return down.select(
        "link_id", F.col("probe_id").alias("incident_id"), F.col("ts").alias("detected_at"), "resolved_at",
        F.when(F.col("resolved_at").isNull(), "OPEN").otherwise("CLOSED").alias("status"),
        F.when(F.col("resolved_at").isNotNull(), F.greatest(F.lit(1), minutes_between("ts", "resolved_at"))).cast("bigint").alias("down_minutes"))


def confirmed_outage(probes: DataFrame, look_back: int | None = None) -> DataFrame:
    """Per domain: checkpoints whose last two probes both failed, split by region.

    ``probes``: domain, checkpoint, region, ts, probe_id, ok, ssl_days_left.  ``look_back`` restricts a domain to its newest probes;
    without it every checkpoint counts.
    """
    recent = probes
    if look_back is not None:
        newest = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("ts").desc(), F.col("probe_id").desc()))
        recent = probes.withColumn("rn", newest).filter(F.col("rn") <= look_back)
    last = F.row_number().over(Window.partitionBy("domain", "checkpoint").orderBy(F.col("ts").desc(), F.col("probe_id").desc()))
    tagged = recent.withColumn("k", last)
    per = tagged.groupBy("domain", "checkpoint").agg(
        (F.count_if((F.col("k") <= 2) & ~F.col("ok")) == 2).alias("failing"), F.max_by("region", -F.col("k")).alias("region"),
        F.max(F.col("region") != "TH").alias("foreign_seen"), F.min("ssl_days_left").alias("ssl"))
    th = F.col("region") == "TH"
    return per.groupBy("domain").agg(
        (F.count_if("failing") >= 2).alias("confirmed"), F.count_if("failing").alias("failing"), F.count_if(F.col("failing") & th).alias("th_fail"),
        F.count_if(F.col("failing") & ~th).alias("foreign_fail"), F.max("foreign_seen").alias("has_foreign_probe"), F.min("ssl").alias("ssl_days_left"))


def outage_class(outages: DataFrame) -> DataFrame:
    """Regional block, host outage or unclear, with a priority."""
    th, foreign = F.col("th_fail"), F.col("foreign_fail")
    regional, host = (th >= 2) & (foreign == 0) & F.col("has_foreign_probe"), (th >= 2) & (foreign >= 1)
    return (outages.withColumn("type", F.when(regional, fixed.OUTAGE_REGIONAL).when(host, fixed.OUTAGE_HOST).otherwise(fixed.OUTAGE_UNCLEAR))
            .withColumn("severity", F.when(regional, F.when(th >= 3, "P1").otherwise("P2")).when(host, "P1").otherwise("P2")))


def response_minutes(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Fold an action log onto incidents.  ``actions``: incident_id, at, seq, action, new_url, backup_url, cause.

    Minutes count from the notification, else the detection.  Acknowledgement times keep their first value, update and
    resolution times their last; the status follows the last action that sets it, an IT resolution only while OPEN.
    """
    at = F.struct("at", "seq")
    first = lambda *a: F.min(F.when(F.col("action").isin(*a), F.col("at")))
    last = lambda a: F.max(F.when(F.col("action") == a, F.col("at")))
    # The status after the last hard setter; a resolution counts only when nothing set a status before it.
    hard = F.max_by("action", F.when(F.col("action").isin("admin_update", "close"), at))
    log = actions.groupBy("incident_id").agg(
        first("admin_ack", "admin_update").alias("admin_ack_at"), last("admin_update").alias("admin_updated_at"),
        first("it_ack", "it_resolve").alias("it_ack_at"), last("it_resolve").alias("it_resolved_at"), first("close").alias("closed_at"),
        hard.alias("hard"), F.max_by("new_url", F.when((F.col("action") == "admin_update") & F.col("new_url").isNotNull(), at)).alias("new_url"),
        F.max_by("backup_url", F.when((F.col("action") == "it_resolve") & F.col("backup_url").isNotNull(), at)).alias("backup_url"),
        F.max_by("cause", F.when((F.col("action") == "it_resolve") & F.col("cause").isNotNull(), at)).alias("cause"))
    t = incidents.join(log, "incident_id", "left")
    base = F.coalesce("notified_at", "detected_at")
    # Without a hard setter, a resolution moves OPEN to IT_RESOLVED and leaves any other status.
    status = (F.when(F.col("hard") == "close", "CLOSED").when(F.col("hard") == "admin_update", "ADMIN_UPDATED")
              .when(F.col("it_resolved_at").isNotNull() & (F.col("status") == "OPEN"), "IT_RESOLVED").otherwise(F.col("status")))
    resolved = F.coalesce("resolved_at", "closed_at")
    return (t.withColumn("admin_response_min", minutes_between(base, F.col("admin_updated_at"))).withColumn("it_response_min", minutes_between(base, F.col("it_resolved_at")))
            .withColumn("admin_response_min", F.when(F.col("admin_updated_at").isNotNull(), F.col("admin_response_min")))
            .withColumn("it_response_min", F.when(F.col("it_resolved_at").isNotNull(), F.col("it_response_min")))
            .withColumn("status", status).withColumn("resolved_at", resolved).drop("hard", "closed_at"))


# ------------------------------------------------------------------------------------------ links
def links_with_dims(links: DataFrame, companies: DataFrame, groups: DataFrame) -> DataFrame:
    """Links with company and group names; a missing or foreign group falls into the "none" bucket."""
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    g = groups.select(F.col("id").alias("group_id"), "company_id", F.col("name").alias("found_group"))
    t = links.join(c, "company_id", "left").join(g, ["group_id", "company_id"], "left")
    return t.withColumn("group_key", F.when(F.col("found_group").isNotNull(), F.col("group_id").cast("string")).otherwise("none")).withColumn(
        "group_name", F.coalesce("found_group", F.lit(fixed.NO_GROUP))).drop("found_group")


def _status_counts() -> list[Column]:
    n = lambda s: F.count_if(F.col("last_status") == s)
    return [F.count(F.lit(1)).alias("total"), n("UP").alias("up"), n("DOWN").alias("down")]


def link_status_counts(links: DataFrame) -> DataFrame:
    return links.agg(*_status_counts(), F.count_if(F.col("last_status") == "UNKNOWN").alias("unknown"), F.count_if("is_active").alias("active"))


def links_by_category(links: DataFrame) -> DataFrame:
    category = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit(fixed.DEFAULT_CATEGORY))
    return links.groupBy(category.alias("category")).agg(*_status_counts())


def links_by_company(companies: DataFrame, links: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per company link counts and open incidents, zero-filled."""
    l = links.groupBy("company_id").agg(*_status_counts())  # noqa: E741
    i = (incidents.filter("status <> 'CLOSED'").join(links.select("link_id", "company_id"), "link_id").groupBy("company_id")
         .agg(F.count(F.lit(1)).alias("open_incidents")))
    t = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")).join(l, "company_id", "left").join(i, "company_id", "left")
    return t.na.fill(0, ["total", "up", "down", "open_incidents"])


def company_link_counts(companies: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """Companies with their groups (long form) and the number of links of the company."""
    n = links.groupBy("company_id").agg(F.count(F.lit(1)).alias("links"))
    g = groups.select("company_id", F.col("name").alias("group_name"))
    t = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")).join(n, "company_id", "left").na.fill(0, ["links"])
    return t.join(g, "company_id", "left")


def incident_kpis(incidents: DataFrame, now: Column) -> DataFrame:
    """Open incidents, incidents of the last 30 days and their mean response minutes (rounded, over non-NULL)."""
    recent = F.col("detected_at") >= now - F.expr("interval 30 days")
    mean = lambda c: F.floor(F.avg(F.when(recent, F.col(c))) + 0.5).cast("bigint")
    return incidents.agg(F.count_if(F.col("status") != "CLOSED").alias("open_incidents"), F.count_if(recent).alias("incidents_30d"),
                         mean("admin_response_min").alias("avg_admin_min"), mean("it_response_min").alias("avg_it_min"))


def incidents_per_day(incidents: DataFrame, last_day: Column, days: int = 14) -> DataFrame:
    """Incidents per day over the last ``days`` days, zero days included, labelled MM-DD."""
    counts = incidents.groupBy(F.to_date("detected_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    one = incidents.sparkSession.range(1)
    grid = one.select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    return grid.join(counts, "day", "left").select("day", F.date_format("day", "MM-dd").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def probe_check_summary(probes: DataFrame, incidents: DataFrame, round_key: str = "round") -> DataFrame:
    """Per check round: links checked, up, down, incidents opened and recovered."""
    p = probes.groupBy(round_key).agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") == "UP").alias("up"), F.count_if(F.col("status") == "DOWN").alias("down"))
    n = lambda c, name: incidents.filter(col(c).isNotNull()).groupBy(F.col(c).alias(round_key)).agg(F.count(F.lit(1)).alias(name))
    t = p.join(n("opened_round", "new_incidents"), round_key, "left").join(n("resolved_round", "recovered"), round_key, "left")
    return t.na.fill(0, ["new_incidents", "recovered"])
