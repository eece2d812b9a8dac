"""Users: lookup, creation, display names and the move from whole-number ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayplan.functions.numbers import shown_name, stable_uuid


def user_profile(users: DataFrame, user_id: str | None = None) -> DataFrame:
    """Id, user name and shown name, of one user or of all."""
    rows = users if user_id is None else users.filter(F.col("id") == user_id)
    name = shown_name(F.col("display_name"), F.col("username"))
    return rows.select("id", "username", name.alias("display_name"))


def new_users(users: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows for the requested user names that do not exist yet.

    Ids are derived from the name, so a job that runs twice creates the same users.
    """
    names = requested.select("username").filter(F.col("username").isNotNull()).distinct()
    missing = names.join(users.select("username"), "username", "left_anti")
    added = missing.select(
        stable_uuid(F.col("username"), "name:").alias("id"),
        "username",
        F.lit(None).cast("string").alias("display_name"),
    )
    if "created_at" in users.columns:
        added = added.withColumn("created_at", F.localtimestamp())
    return added


def get_or_create_users(users: DataFrame, requested: DataFrame) -> DataFrame:
    """One row per requested name: the existing user, or the one to be added."""
    names = requested.select("username").filter(F.col("username").isNotNull()).distinct()
    held = user_profile(users).withColumn("id", F.col("id").cast("string"))
    existing = held.join(names, "username", "left_semi").withColumn("created", F.lit(False))
    added = user_profile(new_users(users, requested)).withColumn("created", F.lit(True))
    return existing.select("id", "username", "display_name", "created").unionByName(added)


def set_display_name(users: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` has ``(id, display_name[, seq])``; the last one per id is kept."""
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    # Comparing a struct keeps a display name that is set to NULL.
    last = changes.groupBy("id").agg(F.max(F.struct(seq.alias("seq"), "display_name")).alias("_to"))
    name = F.when(F.col("_to").isNull(), F.col("display_name")).otherwise(F.col("_to.display_name"))
    return users.join(last, "id", "left").withColumn("display_name", name).select(*users.columns)


def remap_user_ids(users: DataFrame) -> DataFrame:
    """Users with uuid-shaped text ids; a missing display name becomes the user name."""
    changed = users.withColumn("id", stable_uuid(F.col("id"), "id:")).withColumn(
        "display_name", shown_name(F.col("display_name"), F.col("username"))
    )
    if "created_at" in users.columns:
        changed = changed.withColumn("created_at", F.coalesce("created_at", F.localtimestamp()))
    return changed.select(*users.columns)


def remap_message_users(log: DataFrame, users: DataFrame) -> DataFrame:
    """Messages pointing at the new ids of ``users``; unknown and missing ids stay."""
    mapping = users.select(
        F.col("id").cast("string").alias("_old"), stable_uuid(F.col("id"), "id:").alias("_new")
    )
    return (
        log.join(mapping, F.col("user_id") == F.col("_old"), "left")
        .withColumn("user_id", F.coalesce("_new", "user_id"))
        .select(*log.columns)
    )
