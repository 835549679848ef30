"""Catalog search, lookups, names, wishlists and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import numbers as N
from shelfwise.operators import names as M
from shelfwise.operators import search as S
from shelfwise.operators import wishlist as W
from shelfwise.session import work_folder
from shelfwise.streaming import jobs
from suite.recommend_queries import _GROUP_SQL
from suite.registry import query

_RECORDS = ("record_columns", "records")
_BRIEF = "item_id, title, playing_time_minutes"


def _brief(df):
    return df.select("item_id", "title", "playing_time_minutes")


@query("search_title", f"SELECT {_BRIEF} FROM records WHERE contains(lower(title), 'red w')", *_RECORDS)
def search_title(fx):
    return _brief(S.search(fx.records(), q="Red W"))


@query(
    "search_tags",
    f"""SELECT {_BRIEF} FROM records WHERE len(list_filter(mechanics, lambda m: starts_with(lower(m), 'set col') OR starts_with(lower(m), 'bag'))) > 0""",
    *_RECORDS,
)
def search_tags(fx):
    return _brief(S.search(fx.records(), mechanics=["SET col", " ", "bag"]))


_FACETS = {"q": "bolt", "genre": ["eco", "promo"], "mechanics": ["dice"], "themes": None}
_FACET_SQL = """contains(lower(title), 'bolt') AND len(list_filter(genre, lambda g: starts_with(g, 'eco') OR starts_with(g, 'promo'))) > 0
                AND len(list_filter(mechanics, lambda m: starts_with(lower(m), 'dice'))) > 0"""


@query("search_facets", f"SELECT {_BRIEF} FROM records WHERE {_FACET_SQL}", *_RECORDS)
def search_facets(fx):
    return _brief(S.search(fx.records(), **_FACETS))


_DICE = "len(list_filter(mechanics, lambda m: starts_with(lower(m), 'dice'))) > 0"


@query(
    "search_page",
    f"SELECT {_BRIEF}, (SELECT count(*) FROM records WHERE {_DICE}) AS total FROM records WHERE {_DICE} ORDER BY item_id LIMIT 20 OFFSET 40",
    *_RECORDS,
)
def search_page(fx):
    S.check_page(20, 40)
    return S.search_page(fx.records(), limit=20, offset=40, mechanics=["dice"]).select(
        "item_id", "title", "playing_time_minutes", "total"
    )


@query("page_after", f"SELECT {_BRIEF} FROM records WHERE {_DICE} AND item_id > 100 ORDER BY item_id LIMIT 20", *_RECORDS)
def page_after(fx):
    return _brief(S.page_after(fx.records(), 100, 20, mechanics=["dice"]))


@query("lookup_one", f"SELECT {_BRIEF} FROM records WHERE item_id = 42", *_RECORDS)
def lookup_one(fx):
    return _brief(S.lookup(fx.records(), 42))


@query(
    "list_for_context",
    f"SELECT {_BRIEF} FROM records WHERE min_players <= 3 AND max_players >= 3 AND playing_time_minutes <= 90",
    *_RECORDS,
)
def list_for_context(fx):
    return _brief(S.list_for_context(fx.records(), players=3, max_minutes=90))


@query(
    "candidates",
    """SELECT item_id, name FROM raw_catalog WHERE min_players <= 3 AND max_players >= 3 AND community_max_playtime <= 120
       AND name NOT IN (SELECT name FROM raw_catalog JOIN liked USING (item_id))""",
    "raw_catalog", "liked",
)
def candidates(fx):
    items = fx.view("raw_catalog").select(
        "item_id", "name", "min_players", "max_players", F.col("community_max_playtime").alias("playing_time_minutes")
    )
    liked = items.join(fx.view("liked"), "item_id").select("name")
    return S.candidates(items, liked, players=3, max_minutes=120).select("item_id", "name")


_RANKED = """ranked AS (SELECT r.request_id, r.players, r.duration, l.item_id, l.item_id AS rank FROM requests r JOIN liked l USING (user_id))"""


def _ranked(fx):
    """Every request with the liked items of its user as its ranked list."""
    return fx.view("requests").join(fx.view("liked"), "user_id").select(
        "request_id", "players", "duration", "item_id", F.col("item_id").alias("rank")
    )


@query(
    "context_filter",
    f"""WITH {_RANKED} SELECT request_id, item_id, rank FROM ranked JOIN records USING (item_id)
        WHERE min_players <= players AND max_players >= players
          AND playing_time_minutes <= CASE duration WHEN 'short' THEN 45 WHEN 'medium' THEN 90 WHEN 'long' THEN 240 ELSE 1000000 END""",
    "requests", "liked", *_RECORDS,
)
def context_filter(fx):
    return S.filter_for_context(_ranked(fx), fx.records()).select("request_id", "item_id", "rank")


@query(
    "hydrate",
    "SELECT user_id, item_id, title, min_players FROM liked JOIN records USING (item_id)",
    "liked", *_RECORDS,
)
def hydrate(fx):
    return S.hydrate(fx.view("liked"), fx.records()).select("user_id", "item_id", "title", "min_players")


@query(
    "hydrate_missing",
    "SELECT DISTINCT item_id * 5 AS item_id FROM liked WHERE item_id * 5 NOT IN (SELECT item_id FROM records)",
    "liked", *_RECORDS,
)
def hydrate_missing(fx):
    wanted = fx.view("liked").select((F.col("item_id") * 5).alias("item_id"))
    return S.missing_items(wanted, fx.records())


@query(
    "metadata_overlay",
    """SELECT c.item_id, md5(CASE WHEN m.description <> '' THEN m.description ELSE c.description END) AS description,
              CASE WHEN m.image_url <> '' THEN m.image_url ELSE c.image_url END AS image_url
       FROM records c LEFT JOIN metadata m USING (item_id)""",
    "metadata", *_RECORDS,
)
def metadata_overlay(fx):
    done = S.overlay(fx.records(), fx.view("metadata"))
    return done.select("item_id", F.md5("description").alias("description"), "image_url")


@query(
    "typeahead",
    """SELECT p_partkey AS item_id, p_name AS name FROM part WHERE contains(lower(p_name), 'gear') OR contains(CAST(p_partkey AS VARCHAR), 'gear')
       ORDER BY p_partkey LIMIT 25""",
)
def typeahead(fx):
    options = fx.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    return S.typeahead(options, "GEAR", 25)


# ---- nearest names -------------------------------------------------------------------

_TARGETS = "targets AS (SELECT DISTINCT c_mktsegment || ' ' || (c_nationkey % 5) AS target FROM customer)"


def _targets(fx):
    name = F.concat(F.col("c_mktsegment"), F.lit(" "), (F.col("c_nationkey") % 5).cast("string"))
    return fx.table("customer").select(name.alias("target")).distinct()


_NEAREST = f"""{_TARGETS},
    d AS (SELECT target, item_id, name, levenshtein(lower(target), lower(name)) AS distance FROM targets CROSS JOIN raw_catalog),
    near AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, item_id) AS place FROM d)
"""


@query(
    "suggest_names",
    f"WITH {_NEAREST} SELECT target, item_id, name, CAST(distance AS INTEGER) AS distance, CAST(place AS INTEGER) AS place FROM near WHERE place <= 3",
    "raw_catalog",
)
def suggest_names(fx):
    return M.nearest_names(_targets(fx), fx.view("raw_catalog").select("item_id", "name"))


@query(
    "missing_message",
    f"""WITH {_NEAREST}, parts AS (SELECT target, '''' || target || ''' (closest: ' || string_agg(name, ', ' ORDER BY place) || ')' AS part
                                   FROM near WHERE place <= 3 GROUP BY target)
        SELECT split_part(target, ' ', 1) AS "group", 'Missing liked items: ' || string_agg(part, '; ' ORDER BY target) AS message FROM parts GROUP BY ALL""",
    "raw_catalog",
)
def missing_message(fx):
    missing = _targets(fx).select(F.split("target", " ")[0].alias("group"), F.col("target").alias("pos"), "target")
    return M.missing_report(missing, fx.view("raw_catalog").select("item_id", "name"), "Missing liked items")


# ---- wishlist ---------------------------------------------------------------------------

_WISHLIST = """
    lagged AS (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) AS before FROM wishlist_events),
    running AS (SELECT user_id, CASE WHEN action = before THEN 0 WHEN action = 'add' THEN 1 ELSE -1 END AS delta, ts, event_id FROM lagged),
    sizes AS (SELECT user_id, delta, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS size FROM running)
    SELECT user_id, CAST(sum(delta) AS BIGINT) AS n_items, CAST(greatest(max(size), 0) AS BIGINT) AS max_items,
           CAST(greatest(max(size), 0) >= 2 AS INTEGER) AS task_completed FROM sizes GROUP BY user_id
"""


@query("wishlist_state", "WITH " + _WISHLIST, "wishlist_events")
def wishlist_state(fx):
    return W.wishlist_state(fx.view("wishlist_events"))


@query(
    "wishlist_items",
    """WITH last AS (SELECT user_id, item_id, max((ts, event_id)) FILTER (action = 'remove') AS removed,
                            arg_max(action, (ts, event_id)) AS action FROM wishlist_events GROUP BY ALL)
       SELECT user_id, item_id, min(ts) AS since FROM wishlist_events w JOIN last l USING (user_id, item_id)
       WHERE l.action = 'add' AND w.action = 'add' AND (removed IS NULL OR (ts, event_id) > removed) GROUP BY ALL""",
    "wishlist_events",
)
def wishlist_items(fx):
    return W.items_in_wishlist(fx.view("wishlist_events"))


# ---- streams ------------------------------------------------------------------------------


def _stream(fx, table):
    schema = fx.table(table).schema
    return fx.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(fx.sf_dir)


@query("wishlist_stream", "WITH " + _WISHLIST, "wishlist_events")
def wishlist_stream(fx):
    action = F.when(F.col("event_type") == "click", "add").otherwise("remove")
    events = _stream(fx, "events").filter("event_type IN ('click', 'error')").select(
        "event_id", "ts", "user_id", (F.col("event_id") % 7).alias("item_id"), action.alias("action")
    )
    folder = work_folder(fx.spark, "wishlist")
    jobs.wishlist_stream(events, folder).awaitTermination()
    return jobs.wishlist_view(fx.spark, folder)


@query(
    "register_stream",
    f"""SELECT participant_id, {_GROUP_SQL.format('participant_id')} AS study_group, first_seen FROM (
            SELECT 'participant-' || user_id AS participant_id, min(ts) AS first_seen FROM events WHERE event_type = 'signup' GROUP BY user_id)""",
)
def register_stream(fx):
    name = F.concat(F.lit("participant-"), F.col("user_id").cast("string"))
    arrivals = _stream(fx, "events").filter("event_type = 'signup'").select(name.alias("participant_id"), "ts")
    folder = work_folder(fx.spark, "registration")
    jobs.registration_stream(arrivals, folder).awaitTermination()
    stored = jobs.current(fx.spark, f"{folder}/participants", ["participant_id"])
    return stored.select("participant_id", "study_group", F.col("ts").alias("first_seen"))


@query(
    "reseed_stream",
    """SELECT p_partkey AS item_id, p_name AS title, greatest(1, p_size % 5) AS min_players FROM part
       WHERE p_brand = (SELECT max(p_brand) FROM part)""",
)
def reseed_stream(fx):
    parts = _stream(fx, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("min_players"),
        F.regexp_replace("p_brand", "Brand#", "Brand-").alias("drop"),
    )
    folder = work_folder(fx.spark, "reseed")
    jobs.reseed_stream(parts, folder).awaitTermination()
    return jobs.seeded_catalog(fx.spark, folder).select("item_id", "title", "min_players")


@query(
    "metadata_stream",
    """SELECT item_id, description, fetched_at FROM (SELECT user_id AS item_id, props AS description, ts AS fetched_at,
              row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1""",
)
def metadata_stream(fx):
    updates = _stream(fx, "events").select(
        F.col("user_id").alias("item_id"), F.col("props").alias("description"), F.lit("").alias("image_url"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
    )
    folder = work_folder(fx.spark, "metadata")
    jobs.metadata_stream(updates, folder, ttl_seconds=S.METADATA_TTL_SECONDS).awaitTermination()
    stored = jobs.current(fx.spark, f"{folder}/metadata", ["item_id"])
    return stored.select("item_id", "description", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


@query(
    "metadata_current",
    """WITH c AS (SELECT user_id AS item_id, max(ts) AS fetched_at FROM events WHERE event_type = 'view' GROUP BY user_id),
            u AS (SELECT user_id AS item_id, max(ts) AS news FROM events WHERE event_type = 'click' AND value > 100 GROUP BY user_id),
            j AS (SELECT coalesce(c.item_id, u.item_id) AS item_id, fetched_at, news,
                         fetched_at IS NULL OR epoch_us(TIMESTAMP '2024-02-05 12:00:00') - epoch_us(fetched_at) > 604800000000 AS stale
                  FROM c FULL JOIN u ON u.item_id = c.item_id)
       SELECT item_id, CASE WHEN stale AND news IS NOT NULL THEN news ELSE fetched_at END AS fetched_at,
              CASE WHEN stale AND news IS NOT NULL THEN 'refreshed' WHEN stale THEN 'stale' ELSE 'fresh' END AS state FROM j""",
)
def metadata_current(fx):
    def cache(condition):
        rows = fx.table("events").filter(condition).groupBy(F.col("user_id").alias("item_id"))
        empty = F.lit("")
        return rows.agg(F.max("ts").cast("timestamp").alias("fetched_at")).withColumns({"description": empty, "image_url": empty})

    moment = F.lit("2024-02-05 12:00:00").cast("timestamp")
    merged = S.current_metadata(cache("event_type = 'view'"), cache("event_type = 'click' AND value > 100"), moment)
    return merged.select("item_id", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), "state")
