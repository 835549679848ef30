"""Sources, enrichment, filters, profiles and catalog records."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.config import CatalogFilters, EmbeddingModel, Preprocessing
from shelfwise.functions import numbers as N
from shelfwise.functions import text as T
from shelfwise.operators import catalog as C
from shelfwise.operators import profile as P
from shelfwise.operators import search as S
from shelfwise.operators import sessions as X
from shelfwise.operators.order_stats import nearest_rank, order_statistics
from shelfwise.operators.text_features import feature_schema, finite_check, standardize
from shelfwise.plans.preprocess import filtered_catalog, quality_report
from shelfwise.plans.train import manifest, widen_embedding
from shelfwise.session import widen, work_folder
from shelfwise.sources import files, generations, stores
from suite.registry import query, r6

FILTERS = CatalogFilters(
    max_year=2022,
    min_popularity_quantile=0.2,
    min_avg_rating=5.0,
    override_min_ratings=15_000,
    override_owned_quantile=0.9,
    max_required_players=6,
    max_playing_time=240,
)

# ---- sources ------------------------------------------------------------------

_RAW_HEADERS = {target: header for header, (target, _) in files.ITEM_COLUMNS.items()}


@query(
    "load_items",
    """
    SELECT item_id, name, length(description) AS n_chars, md5(description) AS digest, year_published, avg_rating,
           num_user_ratings, num_owned, min_players, max_players, community_max_playtime, community_min_playtime,
           mfg_playtime, complexity, age_recommendation, cat_economy, cat_family_fun
    FROM raw_catalog JOIN (SELECT item_id, CAST(cat_economy AS INTEGER) AS cat_economy,
                                  CAST(cat_family AS INTEGER) AS cat_family_fun FROM category_flags) USING (item_id)
    """,
    "raw_catalog",
    "category_flags",
)
def load_items(fx):
    raw = fx.view("raw_catalog").join(fx.view("category_flags"), "item_id")
    folder = work_folder(fx.spark, "items")
    headers = {**_RAW_HEADERS, "cat_economy": "Cat:Economy", "cat_family": "Cat:Family Fun"}
    raw.drop("cat_strategy").withColumnsRenamed(headers).write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue=""
    ).csv(folder)
    items = files.load_items(fx.spark, folder, multi_line=True)
    return items.withColumns({"n_chars": F.length("description").cast("bigint"), "digest": F.md5("description")}).drop("description")


@query(
    "tags_collapsed",
    """
    SELECT item_id, string_agg(tag, ', ' ORDER BY tag) AS mechanics FROM (
        SELECT item_id, 'Dice Rolling' AS tag, "Dice Rolling" AS flag FROM mechanic_flags UNION ALL
        SELECT item_id, 'Set Collection', "Set Collection" FROM mechanic_flags UNION ALL
        SELECT item_id, 'Worker Placement', "Worker Placement" FROM mechanic_flags UNION ALL
        SELECT item_id, 'Trading', "Trading" FROM mechanic_flags)
    WHERE flag > 0 GROUP BY item_id
    """,
    "mechanic_flags",
)
def tags_collapsed(fx):
    return C.collapse_flags(fx.view("mechanic_flags"), "mechanics")


@query(
    "categories_collapsed",
    """
    SELECT item_id, string_agg(tag, ', ' ORDER BY tag) AS categories FROM (
        SELECT item_id, 'economy' AS tag, cat_economy AS flag FROM category_flags UNION ALL
        SELECT item_id, 'family', cat_family FROM category_flags UNION ALL
        SELECT item_id, 'strategy', cat_strategy FROM category_flags)
    WHERE flag > 0 GROUP BY item_id
    """,
    "category_flags",
)
def categories_collapsed(fx):
    return C.collapse_categories(fx.view("category_flags"))


_TAGS_SQL = """
    WITH tags AS (
        SELECT item_id, 'categories' AS kind, 'economy' AS tag, cat_economy AS flag FROM category_flags UNION ALL
        SELECT item_id, 'categories', 'family', cat_family FROM category_flags UNION ALL
        SELECT item_id, 'categories', 'strategy', cat_strategy FROM category_flags UNION ALL
        SELECT item_id, 'subcategories', 'Card Game', "Card Game" FROM subcategory_flags UNION ALL
        SELECT item_id, 'subcategories', 'Party Game', "Party Game" FROM subcategory_flags UNION ALL
        SELECT item_id, 'mechanics', 'Dice Rolling', "Dice Rolling" FROM mechanic_flags UNION ALL
        SELECT item_id, 'mechanics', 'Set Collection', "Set Collection" FROM mechanic_flags UNION ALL
        SELECT item_id, 'mechanics', 'Worker Placement', "Worker Placement" FROM mechanic_flags UNION ALL
        SELECT item_id, 'mechanics', 'Trading', "Trading" FROM mechanic_flags UNION ALL
        SELECT item_id, 'themes', 'Fantasy', "Fantasy" FROM theme_flags UNION ALL
        SELECT item_id, 'themes', 'Pirates', "Pirates" FROM theme_flags UNION ALL
        SELECT item_id, 'themes', 'Science Fiction', "Science Fiction" FROM theme_flags),
    lists AS (
        SELECT item_id,
               string_agg(tag, ', ' ORDER BY tag) FILTER (kind = 'categories') AS c,
               string_agg(tag, ', ' ORDER BY tag) FILTER (kind = 'subcategories') AS s,
               string_agg(tag, ', ' ORDER BY tag) FILTER (kind = 'mechanics') AS mechanics,
               string_agg(tag, ', ' ORDER BY tag) FILTER (kind = 'themes') AS themes
        FROM tags WHERE flag > 0 GROUP BY item_id)
"""
_TAG_VIEWS = ("category_flags", "subcategory_flags", "mechanic_flags", "theme_flags")


def _tag_tables(fx):
    return [
        C.collapse_categories(fx.view("category_flags")),
        C.collapse_flags(fx.view("subcategory_flags"), "subcategories"),
        C.collapse_flags(fx.view("mechanic_flags"), "mechanics"),
        C.collapse_flags(fx.view("theme_flags"), "themes"),
    ]


@query(
    "enrich",
    _TAGS_SQL
    + """
    SELECT r.item_id, name, coalesce(community_max_playtime, community_min_playtime, mfg_playtime) AS playing_time_minutes,
           concat_ws(', ', c, s) AS categories, s AS subcategories, mechanics, themes
    FROM raw_catalog r LEFT JOIN lists USING (item_id)
    """,
    "raw_catalog",
    *_TAG_VIEWS,
)
def enrich(fx):
    items = fx.view("raw_catalog").join(fx.view("category_flags"), "item_id")
    return C.enrich(items, *_tag_tables(fx)).select(
        "item_id", "name", "playing_time_minutes", "categories", "subcategories", "mechanics", "themes"
    )


@query(
    "playing_time",
    """SELECT item_id, CASE WHEN community_max_playtime IS NOT NULL THEN community_max_playtime
                            WHEN community_min_playtime IS NOT NULL THEN community_min_playtime
                            ELSE mfg_playtime END AS playing_time_minutes FROM raw_catalog""",
    "raw_catalog",
)
def playing_time(fx):
    return fx.view("raw_catalog").select("item_id", C.playing_time().alias("playing_time_minutes"))


@query(
    "merge_categories",
    _TAGS_SQL
    + """SELECT p_partkey AS item_id, CASE WHEN c IS NULL THEN coalesce(s, '') WHEN s IS NULL THEN c
                                    ELSE c || ', ' || s END AS categories
         FROM part LEFT JOIN lists ON lists.item_id = p_partkey""",
    *_TAG_VIEWS,
)
def merge_categories(fx):
    categories, subcategories = _tag_tables(fx)[:2]
    parts = fx.table("part").select(F.col("p_partkey").alias("item_id"))
    joined = parts.join(categories, "item_id", "left").join(subcategories, "item_id", "left")
    return joined.select("item_id", C.merge_categories().alias("categories"))


@query("row_count", "SELECT count(*) AS n_rows FROM lineitem")
def row_count(fx):
    return fx.table("lineitem").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- filters ------------------------------------------------------------------


def _nearest(source: str, column: str, q: float) -> str:
    """Nearest quantile of a column, nulls as 0, by position in the sorted values."""
    return f"""(SELECT x FROM (SELECT CAST(coalesce({column}, 0) AS DOUBLE) AS x,
                row_number() OVER (ORDER BY coalesce({column}, 0)) - 1 AS pos, count(*) OVER () AS n FROM {source})
                WHERE pos = CAST(floor((n - 1) * {q}e0 + 0.5e0) AS BIGINT))"""


_STEPS_SQL = f"""
    WITH s0 AS (SELECT *, coalesce(community_max_playtime, community_min_playtime, mfg_playtime) AS playing_time_minutes
                FROM raw_catalog),
    s1 AS (SELECT * FROM s0 WHERE year_published IS NULL OR year_published <= {FILTERS.max_year}),
    t1 AS (SELECT {_nearest('s1', 'num_user_ratings', FILTERS.min_popularity_quantile)} AS cut),
    s2 AS (SELECT * FROM s1 WHERE coalesce(num_user_ratings, 0) >= (SELECT cut FROM t1)),
    t2 AS (SELECT {_nearest('s2', 'num_owned', FILTERS.override_owned_quantile)} AS cut),
    o2 AS (SELECT *, coalesce(num_user_ratings, 0) >= {FILTERS.override_min_ratings}
                     OR coalesce(num_owned, 0) >= (SELECT cut FROM t2) AS override FROM s2),
    s3 AS (SELECT * FROM o2 WHERE avg_rating >= {FILTERS.min_avg_rating}e0 OR override),
    s4 AS (SELECT * FROM s3 WHERE min_players IS NULL OR min_players <= {FILTERS.max_required_players}),
    s5 AS (SELECT * FROM s4 WHERE playing_time_minutes IS NULL OR playing_time_minutes <= {FILTERS.max_playing_time})
"""


def _timed(fx):
    return fx.view("raw_catalog").drop("description").withColumn("playing_time_minutes", C.playing_time())


@query("filter_chain", _STEPS_SQL + "SELECT item_id, name, avg_rating FROM s5", "raw_catalog")
def filter_chain(fx):
    return C.apply_filters(_timed(fx), FILTERS).select("item_id", "name", "avg_rating")


@query(
    "filter_report",
    _STEPS_SQL
    + f""", n AS (SELECT (SELECT count(*) FROM s0) AS n0, (SELECT count(*) FROM s1) AS n1, (SELECT count(*) FROM s2) AS n2,
                        (SELECT count(*) FROM s3) AS n3, (SELECT count(*) FROM s4) AS n4, (SELECT count(*) FROM s5) AS n5),
    rows_ AS (
        SELECT 1 AS step, 'max_year' AS name, {FILTERS.max_year}e0 AS value, CAST(NULL AS DOUBLE) AS threshold, n0 AS b, n1 AS a,
               CAST(NULL AS BIGINT) AS kept_by_override, CAST(NULL AS DOUBLE) AS owned_threshold FROM n UNION ALL
        SELECT 2, 'min_popularity_quantile', {FILTERS.min_popularity_quantile}e0, (SELECT cut FROM t1), n1, n2, NULL, NULL FROM n UNION ALL
        SELECT 3, 'min_avg_rating', {FILTERS.min_avg_rating}e0, NULL, n2, n3,
               (SELECT count(*) FROM o2 WHERE avg_rating < {FILTERS.min_avg_rating}e0 AND override), (SELECT cut FROM t2) FROM n UNION ALL
        SELECT 4, 'max_required_players', {FILTERS.max_required_players}e0, NULL, n3, n4, NULL, NULL FROM n UNION ALL
        SELECT 5, 'max_playing_time_minutes', {FILTERS.max_playing_time}e0, NULL, n4, n5, NULL, NULL FROM n)
    SELECT CAST(step AS INTEGER) AS step, name, value, threshold, b AS before_rows, a AS after_rows, b - a AS removed,
           round(CASE WHEN b > 0 THEN (b - a) / CAST(b AS DOUBLE) ELSE 0 END, 6) AS removal_rate, kept_by_override, owned_threshold
    FROM rows_
    """,
    "raw_catalog",
)
def filter_report(fx):
    return C.filter_report(_timed(fx), FILTERS).withColumn("removal_rate", r6("removal_rate"))


@query(
    "rating_override",
    f"""
    WITH t AS (SELECT {_nearest('raw_catalog', 'num_owned', 0.95)} AS cut)
    SELECT item_id, avg_rating, CAST(coalesce(avg_rating < 6e0, false) AS INTEGER) AS below
    FROM raw_catalog WHERE avg_rating >= 6e0 OR coalesce(num_user_ratings, 0) >= 18000
                        OR coalesce(num_owned, 0) >= (SELECT cut FROM t)
    """,
    "raw_catalog",
)
def rating_override(fx):
    only = CatalogFilters(None, 0.0, 6.0, 18_000, 0.95, 2**30, 2**30)
    kept = C.apply_filters(_timed(fx), only)
    return kept.select(
        "item_id", "avg_rating", F.coalesce(F.col("avg_rating") < 6.0, F.lit(False)).cast("int").alias("below")
    )


@query(
    "quantile_nearest",
    """
    WITH v AS (SELECT l_returnflag AS grp, l_extendedprice AS x,
                      row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS pos,
                      count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT grp, max(n) AS n,
           max(x) FILTER (pos = CAST(floor((n - 1) * 0.3e0 + 0.5e0) AS BIGINT)) AS q30,
           max(x) FILTER (pos = CAST(floor((n - 1) * 0.95e0 + 0.5e0) AS BIGINT)) AS q95
    FROM v GROUP BY grp
    """,
)
def quantile_nearest(fx):
    prices = fx.table("lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    return order_statistics(prices, ["grp"], "l_extendedprice", {"q30": nearest_rank(0.3), "q95": nearest_rank(0.95)})


# ---- profiles -----------------------------------------------------------------

_NUMERIC = ("min_players", "num_owned", "avg_rating", "year_published", "complexity")


@query(
    "numeric_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, round(count({c}) / CAST(count(*) AS DOUBLE), 6) AS coverage,
            coalesce(CAST(min({c}) AS DOUBLE), 0) AS min, coalesce(CAST(max({c}) AS DOUBLE), 0) AS max,
            round(coalesce(median(CAST({c} AS DOUBLE)), 0), 6) AS median,
            round(coalesce(stddev_pop(CAST({c} AS DOUBLE)), 0), 6) AS std FROM raw_catalog"""
        for c in _NUMERIC
    ),
    "raw_catalog",
)
def numeric_profile(fx):
    profile = P.numeric_profile(fx.view("raw_catalog").select(*_NUMERIC), _NUMERIC)
    return profile.withColumns({name: r6(name) for name in ("coverage", "median", "std")})


@query(
    "text_profile",
    """
    WITH t AS (SELECT 'text' AS "column", length(regexp_replace(coalesce(text, ''), '^[\\s\\x0b\\x{85}\\pZ]+|[\\s\\x0b\\x{85}\\pZ]+$', '', 'g')) AS len FROM documents
               UNION ALL SELECT 'source', length(trim(coalesce(source, ''))) FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY len) - 1 AS pos, count(*) OVER (PARTITION BY "column") AS n FROM t)
    SELECT "column", count(*) FILTER (len > 0) AS non_empty, round(count(*) FILTER (len > 0) / CAST(count(*) AS DOUBLE), 6) AS coverage,
           round(avg(len), 6) AS avg_length, CAST(max(len) FILTER (pos = CAST(ceil((n - 1) * 0.95e0) AS BIGINT)) AS DOUBLE) AS p95_length
    FROM p GROUP BY "column"
    """,
)
def text_profile(fx):
    profile = P.text_profile(fx.table("documents").select("text", "source"), ["text", "source"])
    return profile.withColumns({"coverage": r6("coverage"), "avg_length": r6("avg_length")})


@query(
    "categorical_profile",
    _TAGS_SQL
    + """, e AS (SELECT 'mechanics' AS "column", mechanics AS v FROM part LEFT JOIN lists ON item_id = p_partkey UNION ALL
                 SELECT 'themes', themes FROM part LEFT JOIN lists ON item_id = p_partkey)
    SELECT "column", count(*) FILTER (trim(coalesce(v, '')) <> '') AS non_empty,
           round(count(*) FILTER (trim(coalesce(v, '')) <> '') / CAST(count(*) AS DOUBLE), 6) AS coverage,
           count(DISTINCT nullif(trim(v), '')) AS "distinct" FROM e GROUP BY "column"
    """,
    *_TAG_VIEWS,
)
def categorical_profile(fx):
    parts = fx.table("part").select(F.col("p_partkey").alias("item_id"))
    _, _, mechanics, themes = _tag_tables(fx)
    tagged = parts.join(mechanics, "item_id", "left").join(themes, "item_id", "left")
    return P.categorical_profile(tagged, ["mechanics", "themes"]).withColumn("coverage", r6("coverage"))


@query(
    "duplicate_keys",
    """SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows
       FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
)
def duplicate_keys(fx):
    return C.duplicate_rows(fx.table("lineitem"), "l_orderkey")


@query(
    "latency_summary",
    """
    WITH v AS (SELECT event_type, value * 10 AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
                      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, count(*) AS total, count(*) FILTER (ms >= 2000) AS slow, max(ms) AS max_ms,
           max(ms) FILTER (pos = greatest(0, least(n - 1, CAST(floor(n * 0.95e0) AS BIGINT) - 1))) AS p95_ms
    FROM v GROUP BY event_type
    """,
)
def latency_summary(fx):
    events = fx.table("events").select("event_type", (F.col("value") * 10).alias("ms"))
    return P.latency_summary(events, ["event_type"], "ms")


@query(
    "standardize",
    """
    WITH s AS (SELECT median(CAST(min_players AS DOUBLE)) AS m1, stddev_pop(CAST(min_players AS DOUBLE)) AS s1,
                      median(CAST(num_owned AS DOUBLE)) AS m2, stddev_pop(CAST(num_owned AS DOUBLE)) AS s2 FROM raw_catalog)
    SELECT item_id, round((coalesce(CAST(min_players AS DOUBLE), m1) - m1) / CASE WHEN s1 IS NULL OR s1 = 0 THEN 1 ELSE s1 END, 6) + 0 AS num_min_players,
           round((coalesce(CAST(num_owned AS DOUBLE), m2) - m2) / CASE WHEN s2 IS NULL OR s2 = 0 THEN 1 ELSE s2 END, 6) + 0 AS num_num_owned
    FROM raw_catalog, s
    """,
    "raw_catalog",
)
def standardize_query(fx):
    done = standardize(fx.view("raw_catalog").select("item_id", "min_players", "num_owned"), ["min_players", "num_owned"])
    return done.select("item_id", r6("num_min_players").alias("num_min_players"), r6("num_num_owned").alias("num_num_owned"))


@query(
    "finite_check",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE))) AS invalid
            FROM raw_catalog"""
        for c in _NUMERIC
    ),
    "raw_catalog",
)
def finite_check_query(fx):
    return finite_check(fx.view("raw_catalog").select(*_NUMERIC), _NUMERIC)


# ---- feature table --------------------------------------------------------------

_PREP = Preprocessing(filters=FILTERS)


@query(
    "features_roundtrip",
    """
    WITH s AS (SELECT median(CAST(num_owned AS DOUBLE)) AS m, stddev_pop(CAST(num_owned AS DOUBLE)) AS s FROM raw_catalog)
    SELECT item_id, name, length(description) AS n_chars, avg_rating,
           round((coalesce(CAST(num_owned AS DOUBLE), m) - m) / s, 6) + 0 AS num_num_owned FROM raw_catalog, s
    """,
    "raw_catalog",
)
def features_roundtrip(fx):
    catalog = fx.view("raw_catalog").select("item_id", "name", "description", "avg_rating", "num_owned")
    path = files.write_features(standardize(catalog, ["num_owned"]), work_folder(fx.spark, "features"))
    return files.read_features(fx.spark, path).select(
        "item_id", "name", F.length("description").cast("bigint").alias("n_chars"), "avg_rating", r6("num_num_owned").alias("num_num_owned")
    )


@query("feature_schema", """
    SELECT * FROM (VALUES ('categorical', 'cat_mechanics'), ('categorical', 'cat_economy'), ('categorical', 'cat_family'),
                          ('categorical', 'cat_strategy'), ('numeric', 'num_user_ratings'), ('numeric', 'num_owned'),
                          ('text', 'text_description_tokens')) AS t(role, "column")
    WHERE (SELECT count(*) FROM raw_catalog) > 0""", "raw_catalog")
def feature_schema_query(fx):
    features = (
        fx.view("raw_catalog")
        .join(fx.view("category_flags"), "item_id")
        .withColumns({"text_description_tokens": F.col("description"), "cat_mechanics": F.lit("")})
    )
    roles = feature_schema(features)
    pairs = [F.struct(F.lit(role).alias("role"), F.lit(c).alias("column")) for role, names in roles.items() for c in names]
    present = features.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return present.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


@query("quality_report_json")
def quality_report_json(fx):
    items = fx.view("raw_catalog").join(fx.view("category_flags"), "item_id")
    folder = work_folder(fx.spark, "report")
    filtered = files.write_features(filtered_catalog(items, _tag_tables(fx), _PREP), f"{folder}/filtered")
    filtered = fx.spark.read.parquet(filtered)
    tokens = widen(filtered.select("item_id", "description"), "item_id").select(
        "item_id", T.token_text(F.col("description")).alias("text_description_tokens")
    )
    report = quality_report(items, filtered, tokens, _PREP)
    return fx.spark.read.json(files.write_report(report, f"{folder}/json")).select("section", "body")


# ---- records ------------------------------------------------------------------

_SEED_SQL = """
    WITH f AS (
        SELECT item_id, CASE WHEN item_id % 37 = 0 THEN NULL ELSE name END AS name, description, min_players, max_players,
               coalesce(community_max_playtime, community_min_playtime) AS playing_time_minutes,
               complexity * 2 - 1 AS complexity, age_recommendation - 6 AS age_recommendation,
               CASE WHEN item_id % 7 = 0 THEN -num_user_ratings ELSE num_user_ratings END AS num_user_ratings,
               avg_rating * 2 - 3 AS avg_rating, year_published,
               CASE WHEN item_id % 3 = 0 THEN ' Dice Rolling , ,Trading' WHEN item_id % 3 = 1 THEN 'Memory' END AS cat_mechanics
        FROM raw_catalog)
"""
_SEED_ROWS = """
    SELECT *, CASE WHEN name IS NULL THEN 'name' WHEN min_players IS NULL THEN 'min_players' WHEN max_players IS NULL THEN 'max_players'
                   WHEN playing_time_minutes IS NULL THEN 'playing_time_minutes' END AS reject_reason FROM f
"""


def _seed_rows(fx):
    raw = fx.view("raw_catalog")
    key = F.col("item_id")
    return C.normalize_records(
        raw.select(
            "item_id",
            F.when(key % 37 != 0, F.col("name")).alias("name"),
            "description",
            "min_players",
            "max_players",
            F.coalesce("community_max_playtime", "community_min_playtime").alias("playing_time_minutes"),
            (F.col("complexity") * 2 - 1).alias("complexity"),
            (F.col("age_recommendation") - 6).alias("age_recommendation"),
            F.when(key % 7 == 0, -F.col("num_user_ratings")).otherwise(F.col("num_user_ratings")).alias("num_user_ratings"),
            (F.col("avg_rating") * 2 - 3).alias("avg_rating"),
            "year_published",
            F.when(key % 3 == 0, " Dice Rolling , ,Trading").when(key % 3 == 1, "Memory").alias("cat_mechanics"),
        )
    )


@query(
    "catalog_seed",
    _SEED_SQL
    + f"""
    SELECT item_id, name AS title, length(coalesce(description, '')) AS n_chars,
           CASE WHEN item_id % 3 = 0 THEN 'Dice Rolling|Trading' WHEN item_id % 3 = 1 THEN 'Memory' ELSE '' END AS mechanics,
           greatest(1, min_players) AS min_players, greatest(1, min_players, max_players) AS max_players,
           round(least(5, greatest(0, complexity)), 6) AS complexity, CAST(trunc(greatest(0, age_recommendation)) AS INTEGER) AS age_recommendation,
           greatest(0, coalesce(num_user_ratings, 0)) AS num_user_ratings, round(least(10, greatest(0, coalesce(avg_rating, 0))), 6) AS avg_user_rating,
           coalesce(year_published, 0) AS year_published, greatest(1, playing_time_minutes) AS playing_time_minutes,
           'https://example.com/placeholder.jpg' AS image_url, 'https://example.com/items/' || item_id AS item_url
    FROM ({_SEED_ROWS}) WHERE reject_reason IS NULL
    """,
    "raw_catalog",
)
def catalog_seed(fx):
    seeded = C.accepted(_seed_rows(fx))
    return seeded.select(
        "item_id", "title", F.length("description").cast("bigint").alias("n_chars"), F.array_join("mechanics", "|").alias("mechanics"),
        "min_players", "max_players", r6("complexity").alias("complexity"), "age_recommendation", "num_user_ratings",
        r6("avg_user_rating").alias("avg_user_rating"), "year_published", "playing_time_minutes", "image_url", "item_url",
    )


@query(
    "catalog_generations",
    _SEED_SQL
    + f"""SELECT item_id, name AS title, 'accepted' AS state, NULL AS reject_reason FROM ({_SEED_ROWS}) WHERE reject_reason IS NULL
          UNION ALL SELECT item_id, name, 'rejected', reject_reason FROM ({_SEED_ROWS}) WHERE reject_reason IS NOT NULL""",
    "raw_catalog",
)
def catalog_generations(fx):
    """Catalog and rejects replaced together, after an older load and a refused one."""
    root = work_folder(fx.spark, "catalog")
    rows = _seed_rows(fx).persist()
    both = {"catalog": C.accepted(rows), "rejects": C.rejected(rows)}
    generations.replace(fx.spark, root, {name: table.filter("item_id % 2 = 0") for name, table in both.items()})
    generations.replace(fx.spark, root, both)
    try:
        generations.replace(fx.spark, root, {**both, "catalog": both["catalog"].limit(0)}, check=lambda t: "no rows" if t["catalog"].isEmpty() else None)
    except ValueError:
        pass
    rows.unpersist()
    now = generations.read(fx.spark, root, "catalog", "rejects")
    kept = now["catalog"].select("item_id", "title", F.lit("accepted").alias("state"), F.lit(None).cast("string").alias("reject_reason"))
    return kept.unionByName(now["rejects"].select("item_id", "title", F.lit("rejected").alias("state"), "reject_reason"))


@query(
    "catalog_rejects",
    _SEED_SQL + f"SELECT item_id, name AS title, reject_reason FROM ({_SEED_ROWS}) WHERE reject_reason IS NOT NULL",
    "raw_catalog",
)
def catalog_rejects(fx):
    return C.rejected(_seed_rows(fx))


@query(
    "catalog_view",
    """SELECT item_id, title, array_to_string(mechanics, '|') AS mechanics, array_to_string(genre, '|') AS genre, coalesce(complexity, 0) AS complexity,
              coalesce(age_recommendation, 0) AS age_recommendation, coalesce(num_user_ratings, 0) AS num_user_ratings,
              coalesce(avg_user_rating, 0) AS avg_user_rating, coalesce(year_published, 0) AS year_published FROM records""",
    "record_columns",
    "records",
)
def catalog_view(fx):
    view = C.catalog_view(fx.records())
    return view.select(
        "item_id", "title", F.array_join("mechanics", "|").alias("mechanics"), F.array_join("genre", "|").alias("genre"),
        "complexity", "age_recommendation", "num_user_ratings", "avg_user_rating", "year_published",
    )


_BOUNDS = {
    "min_players>=1": "min_players >= 1",
    "max_players>=1": "max_players >= 1",
    "complexity in 0..5": "complexity BETWEEN 0 AND 5",
    "age_recommendation>=0": "age_recommendation >= 0",
    "num_user_ratings>=0": "num_user_ratings >= 0",
    "avg_user_rating in 0..10": "avg_user_rating BETWEEN 0 AND 10",
    "playing_time_minutes>=1": "playing_time_minutes >= 1",
}
_SHIFTED = """shifted AS (SELECT item_id, min_players - 1 AS min_players, max_players, complexity * 1.2e0 AS complexity, age_recommendation - 5 AS age_recommendation,
    num_user_ratings, avg_user_rating + 2 AS avg_user_rating, playing_time_minutes - 15 AS playing_time_minutes FROM records)"""


@query(
    "bounds_check",
    f"WITH {_SHIFTED} "
    + " UNION ALL ".join(f"SELECT item_id, '{name}' AS rule FROM shifted WHERE NOT coalesce({test}, false)" for name, test in _BOUNDS.items()),
    "record_columns",
    "records",
)
def bounds_check(fx):
    c = F.col
    shifted = fx.records().withColumns(
        {
            "min_players": c("min_players") - 1, "complexity": c("complexity") * 1.2,
            "age_recommendation": c("age_recommendation") - 5, "avg_user_rating": c("avg_user_rating") + 2,
            "playing_time_minutes": c("playing_time_minutes") - 15,
        }
    )
    return C.bound_violations(shifted)


@query(
    "catalog_invalid",
    """SELECT count(*) AS n_rows, min(complexity) AS min_complexity, min(age_recommendation) AS min_age, min(playing_time_minutes) AS min_time,
              min(min_players) AS least_players, count(*) FILTER (title = 'Valid Game' AND description = 'Good') AS placeholders,
              CAST(coalesce(min(complexity) < 0, false) OR coalesce(min(age_recommendation) < 0, false) OR coalesce(min(playing_time_minutes) < 1, false)
                   OR coalesce(min(min_players) < 1, false) OR count(*) FILTER (title = 'Valid Game' AND description = 'Good') > 0 AS INTEGER) AS invalid
       FROM records""",
    "record_columns",
    "records",
)
def catalog_invalid(fx):
    return C.catalog_status(fx.records())


@query(
    "dataset_status",
    """
    SELECT *, CAST(n_rows >= 1000 AND invalid = 0 AND stale = 0 AS INTEGER) AS ready FROM (
        SELECT n_rows, 0 AS invalid, source_rows, CAST(source_rows > n_rows AS INTEGER) AS stale,
               CAST(source_rows > 0 AND source_rows <> n_rows AS INTEGER) AS mismatch
        FROM (SELECT (SELECT count(*) FROM records) AS n_rows, (SELECT count(*) FROM part) AS source_rows))
    """,
    "record_columns",
    "records",
)
def dataset_status(fx):
    return C.dataset_status(fx.records(), fx.table("part"))


# ---- embedding runs and stored tables ---------------------------------------------


@query(
    "embedding_load",
    """SELECT item_id, label, len(vector) AS dims, round(vector[1], 6) AS first, round(vector[64], 6) AS last,
              round(sqrt(list_dot_product(vector, vector)), 6) AS norm FROM items""",
    "items",
)
def embedding_load(fx):
    wide = widen_embedding(fx.view("items").withColumnRenamed("vector", "embedding"), 64)
    folder = work_folder(fx.spark, "runs")
    row = wide.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("first").alias("run_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), "row_count", F.lit(True).alias("complete")
    )
    stores.write_run(wide, row, folder, "first")
    loaded = stores.load_run(fx.spark, folder)
    v = F.col("embedding")
    return loaded.select(
        "item_id", "label", F.size(v).cast("bigint").alias("dims"), r6(v[0]).alias("first"), r6(v[63]).alias("last"), r6("norm").alias("norm")
    )


@query(
    "embedding_run_write",
    "SELECT 'second' AS run_id, TIMESTAMP '2024-01-02 00:00:00' AS created_at, count(*) AS row_count, true AS complete FROM embeddings",
)
def embedding_run_write(fx):
    wide = widen_embedding(fx.view("items").withColumnRenamed("vector", "embedding"), 64)
    folder = work_folder(fx.spark, "runs")
    for run, moment in (("first", "2024-01-01"), ("second", "2024-01-02")):
        row = wide.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(run).alias("run_id"), F.lit(moment).cast("timestamp").alias("created_at"), "row_count", F.lit(True).alias("complete")
        )
        stores.write_run(wide, row, folder, run)
    newest = stores.latest_run(fx.spark.read.parquet(f"{folder}/manifest"))
    return newest.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(
    "run_manifest",
    """SELECT 'run-1' AS run_id, count(*) AS row_count, 64 AS embedding_dimensions, true AS complete,
              '{"text": ["text_description_tokens"], "categorical": ["cat_mechanics"], "numeric": ["num_owned"]}' AS feature_schema
       FROM raw_catalog""",
    "raw_catalog",
)
def run_manifest(fx):
    features = fx.view("raw_catalog").select(
        "item_id", "name", F.col("description").alias("text_description_tokens"), F.lit("").alias("cat_mechanics"),
        "num_user_ratings", "num_owned",
    )
    row = manifest("run-1", "2024-01-01 00:00:00", features, EmbeddingModel(64), exclude=["num_user_ratings"])
    return row.select("run_id", "row_count", "embedding_dimensions", "complete", "feature_schema")


@query(
    "latest_run",
    """SELECT 'run-' || o_orderkey AS run_id, o_orderdate AS created_at, o_custkey AS row_count, o_orderstatus = 'F' AS complete
       FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, 'run-' || o_orderkey DESC LIMIT 1""",
)
def latest_run(fx):
    runs = fx.table("orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("row_count"),
        (F.col("o_orderstatus") == "F").alias("complete"),
    )
    return stores.latest_run(runs)


@query(
    "rec_upsert",
    """SELECT id, created_at, version, status FROM (
           SELECT 'rec-' || o_custkey AS id, o_orderdate AS created_at, o_orderkey AS version, o_orderstatus AS status,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def rec_upsert(fx):
    rows = fx.table("orders").select(
        F.concat(F.lit("rec-"), F.col("o_custkey").cast("string")).alias("id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"),
    )
    return X.upsert(rows.filter("status = 'F'"), rows.filter("status <> 'F'"), ["id"], "created_at", "version")


@query(
    "participant_upsert",
    """SELECT 'participant-' || c_nationkey AS participant_id,
              CASE WHEN arg_max(c_acctbal, c_custkey) > 5000 THEN 'features' ELSE 'references' END AS study_group,
              max(c_custkey) AS version FROM customer GROUP BY c_nationkey""",
)
def participant_upsert(fx):
    rows = fx.table("customer").select(
        F.concat(F.lit("participant-"), F.col("c_nationkey").cast("string")).alias("participant_id"),
        F.when(F.col("c_acctbal") > 5000, "features").otherwise("references").alias("study_group"),
        F.col("c_custkey").alias("version"),
    )
    return X.latest_by_key(rows, ["participant_id"], "version")


@query(
    "metadata_upsert",
    """SELECT item_id, description, fetched_at FROM (
           SELECT user_id AS item_id, props AS description, ts AS fetched_at,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def metadata_upsert(fx):
    rows = fx.table("events").select(
        F.col("user_id").alias("item_id"), F.col("props").alias("description"), F.col("ts").alias("fetched_at"), "event_id"
    )
    return X.latest_by_key(rows, ["item_id"], "fetched_at", "event_id").drop("event_id")


@query(
    "stale_metadata",
    """SELECT event_id, CAST(epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts) > 7 * 86400 * 1000000::BIGINT AS INTEGER) AS stale FROM events""",
)
def stale_metadata(fx):
    moment = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return fx.table("events").select(
        "event_id", N.is_stale(F.col("ts").cast("timestamp"), moment, S.METADATA_TTL_SECONDS).cast("int").alias("stale")
    )


@query(
    "run_id",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run_id,
              CASE WHEN o_orderpriority = '1-URGENT' THEN 'items' ELSE o_orderpriority END AS version FROM orders""",
)
def run_id(fx):
    folder = F.when(F.col("o_orderpriority") == "1-URGENT", "processed").otherwise(F.col("o_orderpriority"))
    path = F.concat(F.lit("/data/"), folder, F.lit("/items.parquet"))
    return fx.table("orders").select(
        "o_orderkey", N.run_identifier(F.col("o_orderdate")).alias("run_id"), N.parquet_version(path).alias("version")
    )
