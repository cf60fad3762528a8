"""Links as they were: what incident actions write back to a link, kept as closed-open validity intervals.

An update by an administrator gives a link its new url (and an unknown status until it is probed again), a resolution by IT a
backup url.  Looking up the version valid at a time is one ordered pass over changes and times together, cut into days, so a link
with very many changes or incidents is spread like any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ranking import last_known, previous_row

_DAY = 86400
_ORDER = ["at", "seq", "incident_id"]


def _day_block(at: str) -> Column:
    return F.floor(F.unix_timestamp(at) / _DAY)


def link_changes(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """``link_id``, ``at``, ``seq``, ``incident_id``, ``url`` and ``backup_url`` (NULL: unchanged) of every action that writes to a link."""
    given = lambda c, action: F.when((F.col("action") == action) & (F.coalesce(c, F.lit("")) != ""), F.trim(c))
    changes = actions.select("incident_id", "at", "seq", given("new_url", "admin_update").alias("url"), given("backup_url", "it_resolve").alias("backup_url"))
    return changes.filter("url is not null or backup_url is not null").join(incidents.select("incident_id", "link_id"), "incident_id").select("link_id", *_ORDER, "url", "backup_url")


def link_history(links: DataFrame, changes: DataFrame) -> DataFrame:
    """``link_id``, ``url``, ``backup_url``, ``valid_from`` and ``valid_to`` (NULL: without end) of every version, the first as the master has it.

    A version is valid from its time on, up to but not at the time of the next.  Of changes at one time the last by ``seq`` ends as the
    version; those before it are valid for no time.  Changes of unknown links are left out.
    """
    known = changes.join(links.select("link_id"), "link_id", "left_semi")
    before = {c: last_known(known, ["link_id"], _day_block("at"), _ORDER, c, f"__{c}") for c in ("url", "backup_url")}
    both = before["url"].join(before["backup_url"].select("link_id", *_ORDER, F.col("__backup_url")).dropDuplicates(["link_id", *_ORDER]), ["link_id", *_ORDER])
    master = links.select("link_id", F.col("url").alias("__first_url"), (F.col("backup_url") if "backup_url" in links.columns else F.lit(None).cast("string")).alias("__first_backup"))
    versions = both.join(master, "link_id").select("link_id", *_ORDER, F.coalesce("url", "__url", "__first_url").alias("url"), F.coalesce("backup_url", "__backup_url", "__first_backup").alias("backup_url"))
    ended = previous_row(versions, ["link_id"], _day_block("at"), _ORDER, F.col("at"), "valid_to", forward=True)
    starts = known.groupBy("link_id").agg(F.min("at").alias("valid_to"))
    first = master.join(starts, "link_id", "left").select("link_id", F.col("__first_url").alias("url"), F.col("__first_backup").alias("backup_url"), F.lit(None).cast("timestamp").alias("valid_from"), "valid_to")
    return first.unionByName(ended.select("link_id", "url", "backup_url", F.col("at").alias("valid_from"), "valid_to"))


def links_at(links: DataFrame, changes: DataFrame, points: DataFrame, at: str) -> DataFrame:
    """``points`` (with ``link_id``) and the ``url`` and ``backup_url`` of their link valid at the time ``at``; NULL for an unknown link."""
    asked = points.withColumn("__n", F.monotonically_increasing_id())
    shape = lambda df, kind, *values: df.select("link_id", *values, F.lit(kind).alias("kind"))
    steps = shape(changes, 0, F.col("at").alias("t"), F.col("seq").cast("bigint").alias("seq"), F.col("incident_id").cast("string").alias("who"), "url", "backup_url", F.lit(None).cast("bigint").alias("__n"))
    none = F.lit(None).cast("string")
    times = shape(asked, 1, F.col(at).alias("t"), F.lit(0).cast("bigint").alias("seq"), none.alias("who"), none.alias("url"), none.alias("backup_url"), F.col("__n"))
    line, order = steps.unionByName(times), ["t", "kind", "seq", "who", "__n"]
    for c in ("url", "backup_url"):
        line = last_known(line, ["link_id"], _day_block("t"), order, c, f"__{c}")
    seen = line.filter("kind = 1").select("__n", "__url", "__backup_url")
    master = links.select(F.col("link_id").alias("__l"), F.col("url").alias("__first_url"), (F.col("backup_url") if "backup_url" in links.columns else none).alias("__first_backup"))
    out = asked.join(seen, "__n").join(master, F.col("link_id") == F.col("__l"), "left")
    found = F.col("__l").isNotNull()
    return out.select(*points.columns, F.when(found, F.coalesce("__url", "__first_url")).alias("url"), F.when(found, F.coalesce("__backup_url", "__first_backup")).alias("backup_url"))


def links_written_back(links: DataFrame, changes: DataFrame) -> DataFrame:
    """``links`` with the newest url and backup url; a link with a new url has an unknown status until it is probed again."""
    place = F.struct(*_ORDER)
    newest = changes.groupBy("link_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__{c}") for c in ("url", "backup_url")])
    t = links.join(newest, "link_id", "left").withColumn("last_status", F.when(F.col("__url").isNotNull(), "UNKNOWN").otherwise(F.col("last_status")))
    backup = F.col("backup_url") if "backup_url" in links.columns else F.lit(None).cast("string")
    return t.withColumns({"url": F.coalesce("__url", "url"), "backup_url": F.coalesce(F.col("__backup_url"), backup)}).drop("__url", "__backup_url")
