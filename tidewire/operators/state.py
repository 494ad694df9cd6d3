"""Keyed tables and their changes: inserts that ignore what is there, upserts, source edits, deletes and their cascade.

Every function returns the table as it is afterwards; the caller stages the result and swaps it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.snapshots import Snapshots


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The target with those incoming rows whose key isn't there; of equal incoming keys the first in order. Only rows that
    are new take part in the choice."""
    new = incoming.join(target.select(*keys), keys, "left_anti")
    new = new.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_row = 1").drop("_row")
    return target.unionByName(new.select(*target.columns))


def upsert_latest(target: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace by key; the highest version wins, of equal ones the incoming row. One aggregate with a partial step."""
    rest = [c for c in target.columns if c not in keys]
    both = target.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("v"))
    return best.select(*keys, *[F.col("v")[c].alias(c) for c in rest]).select(target.columns)


def typed_meta(meta: Column) -> Column:
    """A JSON text as VARIANT, to be stored typed; null where it is no JSON."""
    return F.try_parse_json(meta)


def managed_by_user(meta: Column) -> Column:
    """Of a meta column as VARIANT or as JSON text (``typed_meta`` of it)."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(meta.cast("string")), "$.managedBy", "string") == "user", F.lit(False))


def due_sources(sources: DataFrame, as_of: str, slugs: list[str] | None = None) -> DataFrame:
    """Enabled sources that were never polled or not for their interval. A list of slugs overrides both: just these are polled."""
    if slugs:
        return sources.where(F.col("slug").isin(*slugs))
    waited = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_polled_at")
    return sources.where(F.col("enabled") & (F.col("last_polled_at").isNull() | (waited >= F.col("poll_minutes") * 60)))


EDITED = ["name", "feed_url", "base_credibility", "poll_minutes", "org_slug"]


def upsert_protected(current: DataFrame, registry: DataFrame, retired: DataFrame) -> DataFrame:
    """Registry rows into sources: rows a user manages keep name, feed_url, url and base_credibility; kind,
    category, org and poll interval are the registry's; retired slugs stay out."""
    new = registry.join(retired.select("slug"), "slug", "left_anti")
    both = current.alias("c").join(new.alias("n"), "slug", "full_outer")
    user = managed_by_user(F.col("c.meta"))
    held = lambda c: F.when(user | F.col("n.kind").isNull(), F.col(f"c.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    taken = lambda c: F.when(F.col("n.kind").isNull(), F.col(f"c.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select("slug", held("name"), held("feed_url"), held("url"), held("base_credibility"), taken("kind"), taken("category"), taken("org_slug"), taken("poll_minutes"), F.coalesce("c.meta", "n.meta").alias("meta"))


def apply_source_changes(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: source_id, seq, at, action (enable, disable, mute, unmute, reset, edit) and, for edits, name, feed_url, base_credibility,
    poll_minutes and org_slug (a null org is none). The last of each column's actions wins; an edit marks the source as managed
    by a user in its meta, whose other keys stay."""
    last = lambda *actions: F.max_by(F.struct("action", "at", *EDITED), F.when(F.col("action").isin(*actions), F.col("seq")))
    c = changes.groupBy("source_id").agg(last("enable", "disable").alias("e"), last("enable", "reset").alias("r"), last("mute", "unmute").alias("m"), last("edit").alias("d"))
    out = sources.join(c, sources["id"] == c["source_id"], "left")
    turned = F.col("e.action")
    reason = F.when(turned == "disable", "turned off manually").when(turned == "enable", F.lit(None)).otherwise(F.col("disabled_reason"))
    edited = F.col("d.action").isNotNull()
    return out.select(
        "id", *[F.when(edited, F.col(f"d.{c}")).otherwise(sources[c]).alias(c) for c in EDITED], F.when(turned.isNotNull(), turned == "enable").otherwise(F.col("enabled")).alias("enabled"), reason.alias("disabled_reason"),
        F.when(F.col("m.action") == "mute", F.col("m.at")).when(F.col("m.action") == "unmute", F.lit(None)).otherwise(F.col("muted_at")).alias("muted_at"),
        F.when(F.col("r.action").isNotNull(), F.lit(0)).otherwise(F.col("consecutive_failures")).cast("int").alias("consecutive_failures"),
        F.when(edited, json_merge(F.col("meta"), "managedBy", "user")).otherwise(F.col("meta")).alias("meta"),
    )


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]], tombstones: DataFrame | None = None) -> dict[str, DataFrame]:
    """tables: name -> (rows, the column that names the deleted key). What is left of each; articles must be named 'articles'
    and tables keyed by article_id follow the articles. With tombstones (slug, name) the deleted sources' are added to them, under
    'tombstones', so that the registry doesn't bring them back."""
    articles, by = tables["articles"]
    lost = articles.join(gone.select(F.col("id").alias(by)), by, "left_semi").select(F.col("id").alias("article_id"))
    out = {}
    for name, (rows, key) in tables.items():
        dead = lost if key == "article_id" else gone.select(F.col("id").alias(key))
        out[name] = rows.join(dead, key, "left_anti")
    if tombstones is not None:
        out["tombstones"] = insert_ignore(tombstones, gone.select("slug", "name"), ["slug"], [F.asc("name")])
    return out


def toggle_saved(saved: DataFrame, toggles: DataFrame) -> DataFrame:
    """Each toggle flips whether (user, article) is saved: an odd number of toggles and marks together leaves it saved."""
    keys = ["user_id", "article_id"]
    both = saved.select(*keys, "saved_at", F.lit(0).alias("t")).unionByName(toggles.select(*keys, F.col("at").alias("saved_at"), F.lit(1).alias("t")))
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), F.max("saved_at").alias("saved_at"))
    return out.where("n % 2 = 1").drop("n")


def mark_unread(reads: DataFrame, marks: DataFrame) -> DataFrame:
    return reads.join(marks.select("user_id", "article_id"), ["user_id", "article_id"], "left_anti")


def restore_sources(sources: DataFrame, tombstones: DataFrame, registry: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, tombstones) after the slugs were brought back: their tombstones go, and their registry rows return."""
    left = tombstones.join(slugs, "slug", "left_anti")
    back = registry.join(slugs.join(tombstones, "slug", "left_semi"), "slug", "left_semi")
    return insert_ignore(sources, back.select(sources.columns), ["slug"], [F.asc("slug")]), left


def anti_already_seen(items: DataFrame, articles: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Items whose canonical URL is no article's and whose own URL is no duplicate's; of equal canonical URLs the first."""
    new = items.join(articles.select("canonical_url"), "canonical_url", "left_anti").join(duplicates.select("url"), "url", "left_anti")
    first = F.row_number().over(Window.partitionBy("canonical_url").orderBy("position"))
    return new.withColumn("_row", first).where("_row = 1").drop("_row")


def mark_all_read(reads: DataFrame, articles: DataFrame, user: int, at: str) -> DataFrame:
    """Every article read by the user: those without a mark get one at the given time."""
    every = articles.select(F.lit(user).cast(reads.schema["user_id"].dataType).alias("user_id"), F.col("id").alias("article_id"), F.lit(at).cast("timestamp").alias("read_at"))
    return insert_ignore(reads, every, ["user_id", "article_id"], [F.asc("read_at")])


def rebuild_since(derived: DataFrame, rebuilt: DataFrame, last_updated: str, since: str) -> DataFrame:
    """A derived table after its window was rebuilt: rows last updated before the window stay, the others are replaced."""
    return derived.where(F.col(last_updated) < F.lit(since).cast("timestamp")).unionByName(rebuilt)


def rebuild_overwrite(store: Snapshots, name: str, rebuilt: DataFrame, last_updated: str, since: str) -> int:
    """Put a rebuilt window into a stored table: worked out from its last version, written beside it, made visible by a new version.
    Readers stay on the version before until then."""
    base = store.state()
    held = store.read(name, rebuilt.schema, base["version"] or None)
    return store.commit(replace={name: rebuild_since(held, rebuilt, last_updated, since)}, base=base)


def json_merge(meta: Column, key: str, value: str) -> Column:
    """A JSON object of texts with one key set."""
    held = F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, v: k != key), F.create_map(F.lit(key), F.lit(value))))


REASONS = "array<struct<rule: string, delta: int, detail: string>>"


def reasons_to_json(reasons: Column) -> Column:
    return F.to_json(reasons)


def reasons_from_json(stored: Column) -> Column:
    return F.from_json(stored, REASONS)


def cycle_summary(runs: DataFrame) -> DataFrame:
    """One row for a polling cycle: sources polled, items inserted, duplicate and known by URL, sources failed. runs: ok, items_new,
    items_duplicate, pre_filtered."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return runs.agg(F.count("*").alias("polled"), total("items_new").alias("inserted"), total("items_duplicate").alias("duplicates"), total("pre_filtered").alias("pre_filtered"), F.count_if(~F.col("ok")).alias("failed"))
