"""Preferences, scoring, ranking, explanations and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.config import OFFLINE_PRESET, SERVICE_PRESET, SINGLE_CENTROID
from shelfwise.functions import numbers as N
from shelfwise.functions.vocabulary import MECHANICS, THEMES
from shelfwise.operators import explain as E
from shelfwise.operators import scoring as R
from shelfwise.operators import search as S
from shelfwise.operators import sessions as X
from shelfwise.operators.preferences import centroids, cluster_count
from shelfwise.operators.pruned import pruned_top_items
from shelfwise.operators.references import liked_similarities
from shelfwise.plans import recommend as P
from shelfwise.plans.sessions import answered, checked_requests, explained_results, generate_sessions, session_outcomes
from suite.registry import query, r6, sql_list

# Ranking compares scores to twelve decimals, in both engines.
_CENTROIDS = """
    parts AS (SELECT user_id, generate_subscripts(vector, 1) AS p, unnest(vector) AS x FROM liked JOIN items USING (item_id)),
    means AS (SELECT user_id, p, avg(x) AS x FROM parts GROUP BY ALL),
    centroid AS (SELECT user_id, list(x ORDER BY p) AS c FROM means GROUP BY user_id)
"""
_SCORES = f"""{_CENTROIDS},
    scores AS (SELECT user_id, item_id, round(list_cosine_similarity(c, vector), 12) + 0 AS score FROM centroid CROSS JOIN items
               WHERE NOT EXISTS (SELECT 1 FROM liked l WHERE l.user_id = centroid.user_id AND l.item_id = items.item_id)),
    ranking AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) - 1 AS INTEGER) AS rank FROM scores)
"""


def _likes(fx):
    return fx.view("liked")


def _vectors(fx):
    return fx.view("items").select("item_id", "vector")


def _user_ranking(fx, n=10, prefs=SINGLE_CENTROID):
    """The n best new items of every user."""
    liked, items = _likes(fx), _vectors(fx)
    users = liked.select("user_id").distinct().withColumn("num_results", F.lit(n))
    queries = users.withColumn("request_id", F.col("user_id"))
    return P._score_requests(queries, liked, items, prefs, [], 1).select(
        "user_id", "request_id", "item_id", "score", "rank"
    )


@query(
    "mean_centroid",
    f"WITH {_CENTROIDS} SELECT user_id, CAST(p - 1 AS INTEGER) AS position, round(x, 6) + 0 AS value FROM means",
    "liked",
    "items",
)
def mean_centroid(fx):
    vectors = _likes(fx).join(_vectors(fx), "item_id")
    means = R.mean_vectors(vectors, ["user_id"])
    return means.select("user_id", F.posexplode("vector").alias("position", "value")).withColumn("value", r6("value"))


@query(
    "centroid_count",
    """WITH n AS (SELECT user_id, count(*) AS n FROM liked GROUP BY user_id)
       SELECT user_id, n,
              CAST(CASE WHEN n < 2 THEN 1 ELSE least(greatest(floor(n * 0.5e0), 1), n) END AS INTEGER) AS service,
              CAST(CASE WHEN n < 3 THEN 1 ELSE least(greatest(floor(n * 0.3e0), 1), n) END AS INTEGER) AS offline,
              CAST(CASE WHEN n < 4 THEN 1 ELSE least(greatest(n // 4, 1), n) END AS INTEGER) AS fixed FROM n""",
    "liked",
)
def centroid_count(fx):
    sizes = _likes(fx).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return sizes.select(
        "user_id", "n",
        N.centroid_count(n, min_samples=2, scaling=0.5).alias("service"),
        N.centroid_count(n, min_samples=3, scaling=0.3).alias("offline"),
        N.centroid_count(n, min_samples=4, dynamic=False).alias("fixed"),
    )


@query(
    "l2_normalize",
    """SELECT item_id, CAST(p - 1 AS INTEGER) AS position, round(x / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) + 0 AS value FROM (
           SELECT item_id, sqrt(list_dot_product(vector, vector)) AS norm, unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM items)""",
    "items",
)
def l2_normalize(fx):
    unit = _vectors(fx).select("item_id", N.l2_normalize(F.col("vector")).alias("v"))
    return unit.select("item_id", F.posexplode("v").alias("position", "value")).withColumn("value", r6("value"))


@query(
    "cosine_pairs",
    f"""WITH {_CENTROIDS} SELECT user_id, item_id, round(list_dot_product(c, vector), 6) + 0 AS dot, round(list_cosine_similarity(c, vector), 6) + 0 AS cosine
        FROM liked JOIN items USING (item_id) JOIN centroid USING (user_id)""",
    "liked",
    "items",
)
def cosine_pairs(fx):
    """Cosine of every liked item to its user's own centroid."""
    vectors = _likes(fx).join(_vectors(fx), "item_id")
    means = R.mean_vectors(vectors, ["user_id"]).select("user_id", F.col("vector").alias("c"))
    c, v = F.col("c"), F.col("vector")
    return vectors.join(means, "user_id").select(
        "user_id", "item_id", r6(N.dot(c, v)).alias("dot"), r6(N.cosine(c, v)).alias("cosine")
    )


@query(
    "similarity",
    f"""WITH {_CENTROIDS} SELECT user_id, count(*) AS n_items, round(min(s), 6) AS min_similarity, round(avg(s), 6) + 0 AS mean_similarity,
               round(max(s), 6) AS max_similarity FROM (SELECT user_id, list_cosine_similarity(c, vector) AS s FROM centroid CROSS JOIN items) GROUP BY user_id""",
    "liked",
    "items",
)
def similarity(fx):
    vectors = _likes(fx).join(_vectors(fx), "item_id")
    queries = R.mean_vectors(vectors, ["user_id"]).withColumnRenamed("user_id", "query_id")
    summary = R.similarity_summary(queries, _vectors(fx))
    return summary.select(
        F.col("query_id").alias("user_id"), "n_items",
        *[r6(name).alias(name) for name in ("min_similarity", "mean_similarity", "max_similarity")],
    )


@query(
    "recommend_topk",
    f"WITH {_SCORES} SELECT user_id, item_id, rank, round(score, 6) AS score FROM ranking WHERE rank < 10",
    "liked",
    "items",
)
def recommend_topk(fx):
    return _user_ranking(fx).select("user_id", "item_id", "rank", r6("score").alias("score"))


@query(
    "recommend_topk_pruned",
    f"WITH {_SCORES} SELECT user_id, item_id, rank, round(score, 6) AS score FROM ranking WHERE rank < 10",
    "liked",
    "items",
)
def recommend_topk_pruned(fx):
    """The ranking of ``recommend_topk``, by cells of directions whose bounds decide which of them a user meets."""
    liked, items = _likes(fx), _vectors(fx)
    queries = P.user_directions(liked, items, SINGLE_CENTROID).select(F.col("user_id").alias("query_id"), "vector", F.lit(10).alias("n_results"))
    ranked, _ = pruned_top_items(queries, items, exclude=liked.withColumnRenamed("user_id", "query_id"))
    return ranked.select(F.col("query_id").alias("user_id"), "item_id", "rank", r6("score").alias("score"))


def _multi(aggregate: str) -> str:
    """Every liked vector is a preference vector of its own."""
    return f"""
    WITH s AS (SELECT l.user_id, i.item_id, list_cosine_similarity(p.vector, i.vector) AS s
               FROM liked l JOIN items p ON p.item_id = l.item_id CROSS JOIN items i),
    g AS (SELECT user_id, item_id, round({aggregate}(s), 12) + 0 AS score FROM s GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) - 1 AS INTEGER) AS rank FROM g
          WHERE NOT EXISTS (SELECT 1 FROM liked l WHERE l.user_id = g.user_id AND l.item_id = g.item_id))
    SELECT user_id, item_id, rank, round(score, 6) AS score FROM r WHERE rank < 5"""


def _multi_ranking(fx, aggregation):
    liked, items = _likes(fx).withColumnRenamed("user_id", "query_id"), _vectors(fx)
    each = R.directions(liked.join(items, "item_id"), aggregation).withColumn("n_results", F.lit(5))
    ranked = R.top_items(each, items, aggregation=aggregation, exclude=liked)
    return ranked.select(F.col("query_id").alias("user_id"), "item_id", "rank", r6("score").alias("score"))


@query("score_max", _multi("max"), "liked", "items")
def score_max(fx):
    return _multi_ranking(fx, "max")


@query("score_mean", _multi("avg"), "liked", "items")
def score_mean(fx):
    return _multi_ranking(fx, "mean")


@query("preference_centroids")
def preference_centroids(fx):
    """Seeded k-means centroids of every user, as (user, centroid, position, value)."""
    found = centroids(_likes(fx).join(_vectors(fx), "item_id"), SERVICE_PRESET)
    return found.select("user_id", "centroid", F.posexplode("vector").alias("position", "value")).withColumn("value", r6("value"))


@query("recommend_clusters")
def recommend_clusters(fx):
    """Offline preset: several centroids per user, the best matching one counts."""
    return _user_ranking(fx, 10, OFFLINE_PRESET).select("user_id", "item_id", "rank", r6("score").alias("score"))


# ---- requests -------------------------------------------------------------------

_ATTRIBUTES = """
    fit AS (SELECT vec_id AS item_id, CAST(1 + label % 4 AS INTEGER) AS min_players, CAST(3 + vec_id % 3 AS INTEGER) AS max_players,
                   CASE WHEN vec_id % 13 = 0 THEN NULL ELSE 15 * (1 + vec_id % 20) END AS playing_time_minutes FROM embeddings)
"""
_VALID = """
    valid AS (SELECT *, CASE duration WHEN 'short' THEN 45 WHEN 'medium' THEN 90 WHEN 'long' THEN 240 END AS max_minutes
              FROM requests WHERE players >= 1 AND num_results BETWEEN 1 AND 100)
"""


def _fit_items(fx):
    key = F.col("item_id")
    return fx.view("items").select(
        "item_id", "vector",
        (1 + F.col("label") % 4).cast("int").alias("min_players"),
        (3 + key % 3).cast("int").alias("max_players"),
        F.when(key % 13 != 0, 15 * (1 + key % 20)).alias("playing_time_minutes"),
    )


def _valid_requests(fx):
    return P.with_minutes(fx.view("requests").filter("players >= 1 AND num_results BETWEEN 1 AND 100"))


@query(
    "recommend_prefilter",
    f"""WITH {_SCORES}, {_ATTRIBUTES}, {_VALID},
    picked AS (SELECT request_id, s.item_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, s.item_id) - 1 AS rank, num_results
               FROM valid v JOIN scores s USING (user_id) JOIN fit f ON f.item_id = s.item_id
               WHERE f.min_players <= v.players AND f.max_players >= v.players AND f.playing_time_minutes <= coalesce(v.max_minutes, 1e9))
    SELECT request_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM picked WHERE rank < num_results""",
    "liked", "items", "requests",
)
def recommend_prefilter(fx):
    ranked = P.recommend_prefiltered(_valid_requests(fx), _likes(fx), _fit_items(fx), SINGLE_CENTROID)
    return ranked.select("request_id", "item_id", "rank", r6("score").alias("score"))


_POST = f"""{_SCORES}, {_VALID},
    over_ AS (SELECT v.*, r.item_id, r.score, r.rank AS r5 FROM valid v JOIN ranking r USING (user_id) WHERE r.rank < 5 * v.num_results),
    suited AS (SELECT o.*, row_number() OVER (PARTITION BY request_id ORDER BY r5) - 1 AS new_rank
               FROM over_ o JOIN records c USING (item_id)
               WHERE c.min_players <= o.players AND c.max_players >= o.players AND (o.max_minutes IS NULL OR c.playing_time_minutes <= o.max_minutes))
"""


@query(
    "recommend_postfilter",
    f"WITH {_POST} SELECT request_id, item_id, CAST(new_rank AS INTEGER) AS rank, round(score, 6) AS score FROM suited WHERE new_rank < num_results",
    "liked", "items", "requests", "record_columns", "records",
)
def recommend_postfilter(fx):
    ranked = P.recommend_postfiltered(_valid_requests(fx), _likes(fx), _vectors(fx), fx.records(), SINGLE_CENTROID)
    return ranked.select("request_id", "item_id", "rank", r6("score").alias("score"))


@query(
    "validate_requests",
    """WITH likes AS (SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS d, min(item_id) AS least FROM purchases GROUP BY user_id)
       SELECT request_id, CASE WHEN n IS NULL THEN 'no liked items' WHEN d < n THEN 'liked items repeat' WHEN least < 1 THEN 'liked ids must be positive'
              WHEN players < 1 THEN 'players must be positive' WHEN num_results NOT BETWEEN 1 AND 100 THEN 'num_results must be between 1 and 100'
              ELSE 'ok' END AS status FROM requests LEFT JOIN likes USING (user_id)""",
    "purchases", "requests",
)
def validate_requests(fx):
    checked = X.request_checks(fx.view("requests"), fx.view("purchases"))
    return checked.select("request_id", F.coalesce("reject_reason", F.lit("ok")).alias("status"))


@query(
    "format_results",
    """SELECT item_id, coalesce(avg_rating, 0) AS avg_rating, coalesce(community_max_playtime, mfg_playtime) AS playing_time, min_players, max_players FROM raw_catalog""",
    "raw_catalog",
)
def format_results(fx):
    nan = F.lit(float("nan"))
    rows = fx.view("raw_catalog").select(
        "item_id", F.coalesce("avg_rating", nan).alias("avg_rating"), "min_players", "max_players",
        F.coalesce(F.coalesce("community_max_playtime", "mfg_playtime").cast("double"), nan).alias("playing_time_minutes"),
    )
    return P.format_results(rows)


@query(
    "liked_vectors",
    "SELECT user_id, count(*) AS n_known FROM purchases JOIN items ON items.item_id = purchases.item_id * 3 GROUP BY user_id",
    "purchases", "items",
)
def liked_vectors(fx):
    likes = fx.view("purchases").withColumn("item_id", F.col("item_id") * 3)
    return likes.join(_vectors(fx), "item_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_known"))


@query(
    "liked_missing",
    "SELECT DISTINCT user_id, item_id * 3 AS item_id FROM purchases WHERE item_id * 3 NOT IN (SELECT vec_id FROM embeddings)",
    "purchases",
)
def liked_missing(fx):
    likes = fx.view("purchases").withColumn("item_id", F.col("item_id") * 3)
    return likes.join(_vectors(fx).select("item_id"), "item_id", "left_anti").distinct()


@query(
    "exclude_liked",
    f"""WITH {_CENTROIDS},
        s AS (SELECT user_id, item_id, round(list_cosine_similarity(c, vector), 12) + 0 AS score FROM centroid CROSS JOIN items),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS n FROM s)
        SELECT user_id, item_id, round(score, 6) AS score FROM r WHERE n <= 20 AND (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM liked)""",
    "liked", "items",
)
def exclude_liked(fx):
    """Best twenty of all items per user, then without the ones the user likes."""
    liked, items = _likes(fx), _vectors(fx)
    queries = P.user_directions(liked, items, SINGLE_CENTROID).select(
        F.col("user_id").alias("query_id"), "vector", F.lit(20).alias("n_results")
    )
    best = R.top_items(queries, items).withColumnRenamed("query_id", "user_id")
    return best.join(liked, ["user_id", "item_id"], "left_anti").select("user_id", "item_id", r6("score").alias("score"))


# ---- explanations -----------------------------------------------------------------

_TOP = f"""{_SCORES},
    ranked AS (SELECT *, max(score) FILTER (rank = 0) OVER (PARTITION BY user_id) AS top FROM ranking WHERE rank < 10),
    norms AS (SELECT item_id, vector, sqrt(list_dot_product(vector, vector)) AS norm FROM items),
    sims AS (SELECT r.user_id, r.rank, r.item_id, r.score, r.top, l.item_id AS liked_id,
                    round(list_cosine_similarity(a.vector, b.vector), 12) + 0 AS sim
             FROM ranked r JOIN liked l USING (user_id) JOIN norms a ON a.item_id = r.item_id JOIN norms b ON b.item_id = l.item_id
             WHERE a.norm > 0 AND b.norm > 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, rank ORDER BY sim DESC, liked_id) - 1 AS place,
                      count(*) OVER (PARTITION BY user_id, rank) AS n FROM sims)
"""
_REFERENCES = f"""{_TOP},
    rotated AS (SELECT *, (place - CASE WHEN rank > 2 THEN rank % n ELSE 0 END + n) % n AS slot FROM placed),
    kept AS (SELECT *, count(*) OVER w AS m, max(sim) FILTER (slot = 0) OVER w AS best0 FROM rotated WHERE slot < 3
             WINDOW w AS (PARTITION BY user_id, rank)),
    based AS (SELECT *, CASE WHEN best0 = 0 THEN 1e-9 ELSE best0 END AS best,
                     (rank < 3 OR (top > 0 AND score >= 0.85e0 * top)) AND m >= 2 AS two FROM kept),
    first_pass AS (SELECT *, CASE WHEN slot = 0 OR (two AND slot = 1) THEN 'positive'
                                  WHEN sim / best < 0.5e0 OR sim < 0.15e0 THEN 'negative' ELSE 'neutral' END AS i1 FROM based),
    second AS (SELECT *, CASE WHEN m > 1 AND slot = m - 1 AND count(*) FILTER (i1 = 'positive') OVER (PARTITION BY user_id, rank) = m
                              THEN 'neutral' ELSE i1 END AS i2 FROM first_pass),
    refs AS (SELECT user_id, rank, item_id, CAST(slot AS INTEGER) AS slot, liked_id,
                    CASE WHEN m > 1 AND slot = m - 1 AND (rank >= 3 OR (top > 0 AND score < 0.7e0 * top)) THEN 'negative' ELSE i2 END AS influence
             FROM second)
"""


def _liked_pos(fx):
    # equal positions leave the id order to decide
    return _likes(fx).withColumn("pos", F.lit(0))


def _titles(fx):
    return fx.records().select("item_id", F.col("title").alias("name"))


@query(
    "ref_similarity",
    f"""WITH {_TOP} SELECT user_id, rank, max(n) AS n_compared, max(liked_id) FILTER (place = 0) AS best_liked, round(max(sim), 6) AS best_similarity
        FROM placed GROUP BY ALL""",
    "liked", "items",
)
def ref_similarity(fx):
    found = liked_similarities(_user_ranking(fx), _liked_pos(fx), _vectors(fx)).filter("place = 0")
    return found.select(
        F.col("request_id").alias("user_id"), "rank", F.col("n").alias("n_compared"),
        F.col("liked_id").alias("best_liked"), r6("sim").alias("best_similarity"),
    )


@query(
    "explain_references",
    f"WITH {_REFERENCES} SELECT user_id, rank, refs.item_id, slot, liked_id, coalesce(title, '') AS title, influence FROM refs LEFT JOIN records c ON c.item_id = liked_id",
    "liked", "items", "record_columns", "records",
)
def explain_references(fx):
    done = E.explain_by_references(_user_ranking(fx), _liked_pos(fx), _vectors(fx), _titles(fx))
    return done.select(F.col("request_id").alias("user_id"), "rank", "item_id", F.posexplode("references").alias("slot", "r")).select(
        "user_id", "rank", "item_id", "slot", "r.*"
    )


@query(
    "liked_features",
    """WITH t AS (SELECT item_id, 'mechanic' AS category, unnest(mechanics) AS label FROM records UNION ALL
                  SELECT item_id, 'theme', unnest(themes) FROM records UNION ALL SELECT item_id, 'genre', unnest(genre) FROM records)
       SELECT DISTINCT user_id, category, label FROM liked JOIN t USING (item_id)""",
    "liked", "record_columns", "records",
)
def liked_features(fx):
    return E.liked_features(_likes(fx), fx.records())


_HINTS = f"""
    hint0 AS (SELECT item_id, 1 AS grp, generate_subscripts(mechanics, 1) AS pos, 'mechanic' AS category, unnest(mechanics) AS label FROM records UNION ALL
              SELECT item_id, 2, generate_subscripts(themes, 1), 'theme', unnest(themes) FROM records UNION ALL
              SELECT item_id, 3, generate_subscripts(genre, 1), 'genre', unnest(genre) FROM records),
    hint AS (SELECT * FROM hint0 UNION ALL
             SELECT item_id, 4, 1, 'theme', title FROM records WHERE item_id NOT IN (SELECT item_id FROM hint0))
"""
_SPLIT = f"""{_HINTS},
    vocab AS (SELECT 'mechanic' AS category, generate_subscripts(v, 1) AS at_, unnest(v) AS term FROM (SELECT {sql_list(MECHANICS)} AS v) UNION ALL
              SELECT 'theme', generate_subscripts(v, 1), unnest(v) FROM (SELECT {sql_list(THEMES)} AS v)),
    matched AS (SELECT h.*, v.at_, v.term FROM hint h JOIN vocab v ON v.category = h.category AND contains(lower(h.label), v.term)),
    labels AS (SELECT item_id, grp, pos, at_, category, term AS label FROM matched UNION ALL
               SELECT item_id, grp, pos, 0, category, label FROM hint h
               WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.item_id = h.item_id AND m.grp = h.grp AND m.pos = h.pos)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grp, pos, at_) - 1 AS slot FROM labels)
"""


@query(
    "feature_hints",
    f"WITH {_HINTS} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY grp, pos) - 1 AS INTEGER) AS position, label, category FROM hint",
    "record_columns", "records",
)
def feature_hints(fx):
    hints = E.feature_hints(fx.records())
    return hints.select("item_id", F.posexplode("hints").alias("position", "h")).select("item_id", "position", "h.*")


_FEATURES = f"""{_TOP}, {_SPLIT},
    best AS (SELECT user_id, rank, max(sim) AS best_sim FROM sims GROUP BY ALL),
    liked_tags AS (SELECT DISTINCT user_id, category, label FROM liked JOIN hint0 USING (item_id)),
    m1 AS (SELECT r.user_id, r.rank, r.item_id, r.score, r.top, slot, n.label, n.category,
                  CASE WHEN t.label IS NOT NULL AND coalesce(best_sim, 0) >= 0.4e0 THEN 'positive' WHEN coalesce(best_sim, 0) < 0.2e0 THEN 'negative' ELSE 'neutral' END AS i1
           FROM ranked r JOIN numbered n ON n.item_id = r.item_id AND slot < 3 LEFT JOIN best b ON b.user_id = r.user_id AND b.rank = r.rank
           LEFT JOIN liked_tags t ON t.user_id = r.user_id AND t.category = n.category AND t.label = n.label),
    m2 AS (SELECT *, count(*) OVER w AS m, CASE WHEN slot = 0 AND count(*) FILTER (i1 = 'positive') OVER w = 0 THEN 'positive' ELSE i1 END AS i2
           FROM m1 WINDOW w AS (PARTITION BY user_id, rank)),
    feats AS (SELECT user_id, rank, item_id, CAST(slot AS INTEGER) AS slot, label, category,
                     CASE WHEN m > 1 AND slot = m - 1 AND (score < 0.6e0 * top OR rank >= 4) THEN 'negative' ELSE i2 END AS influence FROM m2)
"""


@query("explain_features", f"WITH {_FEATURES} SELECT * FROM feats", "liked", "items", "record_columns", "records")
def explain_features(fx):
    done = E.explain_by_features(_user_ranking(fx), _liked_pos(fx), _vectors(fx), fx.records())
    return done.select(F.col("request_id").alias("user_id"), "rank", "item_id", F.posexplode("features").alias("slot", "f")).select(
        "user_id", "rank", "item_id", "slot", "f.*"
    )


_GROUP_SQL = "CASE WHEN ascii(substr(md5(CAST({} AS VARCHAR)), 1, 1)) % 2 = 0 THEN 'features' ELSE 'references' END"


@query(
    "explain_by_group",
    f"""WITH {_REFERENCES}, {_FEATURES.split(_TOP, 1)[1].lstrip(', ')}
        SELECT user_id, rank, 'references' AS type, slot, CAST(liked_id AS VARCHAR) AS entry, influence FROM refs WHERE {_GROUP_SQL.format('user_id')} = 'references'
        UNION ALL SELECT user_id, rank, 'features', slot, label, influence FROM feats WHERE {_GROUP_SQL.format('user_id')} = 'features'""",
    "liked", "items", "record_columns", "records",
)
def explain_by_group(fx):
    ranked = _user_ranking(fx)
    groups = ranked.select("request_id", "user_id").distinct().withColumn("study_group", N.study_group(F.col("user_id")))
    done = E.explain_by_group(ranked, groups, _liked_pos(fx), _vectors(fx), fx.records())
    entries = F.coalesce(
        F.transform("references", lambda r: F.struct(r["liked_id"].cast("string").alias("entry"), r["influence"].alias("influence"))),
        F.transform("features", lambda f: F.struct(f["label"].alias("entry"), f["influence"].alias("influence"))),
    )
    return done.select(F.col("request_id").alias("user_id"), "rank", "type", F.posexplode(entries).alias("slot", "e")).select(
        "user_id", "rank", "type", "slot", "e.*"
    )


@query(
    "truncate_explanations",
    f"""WITH {_SPLIT}, c AS (SELECT item_id, count(*) AS n, string_agg(label, '|' ORDER BY grp, pos, at_) FILTER (slot < 4) AS shown FROM numbered GROUP BY item_id)
        SELECT item_id, shown, CAST(n > 4 AS INTEGER) AS has_more FROM c""",
    "record_columns", "records",
)
def truncate_explanations(fx):
    labels = E.split_labels(E.feature_hints(fx.records()))
    cut = labels.select("item_id", E.truncate_explanations(F.col("labels"), 4).alias("t"))
    shown = F.array_join(F.transform("t.shown", lambda e: e["label"]), "|")
    return cut.select("item_id", shown.alias("shown"), F.col("t.has_more").cast("int").alias("has_more"))


@query(
    "normalize_influence",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'view' THEN 'positive' WHEN 'click' THEN 'negative' ELSE 'neutral' END AS by_text,
              CASE WHEN value > 30 THEN 'positive' WHEN value < 30 THEN 'negative' ELSE 'neutral' END AS by_number FROM events""",
)
def normalize_influence(fx):
    kind = F.col("event_type")
    text = F.when(kind == "signup", "Positive").when(kind == "error", "NEG").when(kind == "view", "+").when(kind == "click", "-").otherwise(kind)
    return fx.table("events").select(
        "event_id", N.influence(text).alias("by_text"), N.influence_of_number(F.col("value") - 30).alias("by_number")
    )


# ---- sessions -----------------------------------------------------------------------


@query("assign_groups", f"SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'references' ELSE {_GROUP_SQL.format('c_custkey')} END AS study_group FROM customer")
def assign_groups(fx):
    override = F.when(F.col("c_mktsegment") == "BUILDING", "references")
    return fx.table("customer").select(F.col("c_custkey").alias("user_id"), N.study_group(F.col("c_custkey"), override).alias("study_group"))


_CREATED = "2024-02-01 00:00:00"


def _sessions(fx):
    return generate_sessions(
        fx.view("requests"), fx.view("purchases"), _vectors(fx), fx.records(),
        created_at=F.lit(_CREATED).cast("timestamp"), prefs=SERVICE_PRESET,
    )


@query("generate_sessions")
def generate(fx):
    """Every valid request scored, filtered, explained and stored as one session row."""
    return X.encode(_sessions(fx)).drop("request_id")


@query(
    "assemble_sessions",
    f"""WITH {_POST}, {_SPLIT},
        likes AS (SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS d, min(item_id) AS least FROM purchases GROUP BY user_id),
        n_labels AS (SELECT item_id, count(*) AS n FROM numbered GROUP BY item_id)
        SELECT request_id, CAST(new_rank AS INTEGER) AS rank, s.item_id, title, {_GROUP_SQL.format("'participant-' || s.user_id")} AS type,
               CAST(least(3, CASE WHEN {_GROUP_SQL.format("'participant-' || s.user_id")} = 'features' THEN x.n ELSE k.n END) AS INTEGER) AS n_entries
        FROM suited s JOIN likes k ON k.user_id = s.user_id AND k.d = k.n AND k.least >= 1
        JOIN records c ON c.item_id = s.item_id JOIN n_labels x ON x.item_id = s.item_id WHERE new_rank < num_results""",
    "purchases", "liked", "items", "requests", "record_columns", "records",
)
def assemble_sessions(fx):
    """Explained results of every valid request, one row per result."""
    _, results = explained_results(
        fx.view("requests"), fx.view("purchases"), _vectors(fx), fx.records(), SINGLE_CENTROID
    )
    return results.select(
        "request_id", "rank", "item_id", "title", "type",
        F.coalesce(F.size("references"), F.size("features")).alias("n_entries"),
    )


@query(
    "session_outcomes",
    f"""WITH {_POST},
        likes AS (SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS d, min(item_id) AS least FROM purchases GROUP BY user_id),
        checked AS (SELECT r.request_id, CASE WHEN coalesce(k.n, 0) = 0 THEN 'no liked items' WHEN k.d < k.n THEN 'liked items repeat'
                           WHEN k.least < 1 THEN 'liked ids must be positive' WHEN r.players IS NULL OR r.players < 1 THEN 'players must be positive'
                           WHEN coalesce(r.num_results, 10) NOT BETWEEN 1 AND 100 THEN 'num_results must be between 1 and 100'
                           WHEN r.duration IS NOT NULL AND r.duration NOT IN ('short', 'medium', 'long') THEN 'unknown duration' END AS rejected
                    FROM requests r LEFT JOIN likes k USING (user_id)),
        counts AS (SELECT request_id, count(*) AS n, count(*) FILTER (s.item_id % 7 = 0) AS missing
                   FROM suited s WHERE new_rank < num_results GROUP BY request_id),
        told AS (SELECT request_id, rejected, CASE WHEN rejected IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_results,
                        CASE WHEN rejected IS NULL THEN coalesce(missing, 0) ELSE 0 END AS n_missing FROM checked LEFT JOIN counts USING (request_id))
        SELECT request_id, n_results, n_missing,
               CASE WHEN rejected IS NOT NULL THEN 'rejected' WHEN n_results = 0 THEN 'unavailable' WHEN n_missing > 0 THEN 'incomplete' ELSE 'ok' END AS status,
               CASE WHEN rejected IS NOT NULL THEN rejected WHEN n_results = 0 THEN 'no item suits the request'
                    WHEN n_missing > 0 THEN 'results without catalog record' END AS reason FROM told""",
    "purchases", "liked", "items", "requests", "record_columns", "records",
)
def outcomes(fx):
    """What became of every request when every seventh item has lost its catalog record."""
    requests, likes = fx.view("requests"), fx.view("purchases")
    asks, results = answered(requests, likes, _vectors(fx), fx.records(), SINGLE_CENTROID)
    return session_outcomes(requests, likes, results, fx.records().filter("item_id % 7 <> 0"), asks=asks)


@query(
    "participant_requests",
    """WITH known AS (SELECT 'participant-' || user_id AS participant_id, user_id, CASE WHEN user_id % 11 = 0 THEN 'pilot' WHEN user_id % 3 = 0 THEN 'features' ELSE 'references' END AS grp
                     FROM events WHERE event_type = 'signup' GROUP BY user_id),
       likes AS (SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS d, min(item_id) AS least FROM purchases GROUP BY user_id)
       SELECT request_id, CASE WHEN n IS NULL THEN 'no liked items' WHEN d < n THEN 'liked items repeat' WHEN least < 1 THEN 'liked ids must be positive'
              WHEN players < 1 THEN 'players must be positive' WHEN num_results NOT BETWEEN 1 AND 100 THEN 'num_results must be between 1 and 100'
              WHEN grp IS NULL THEN 'participant not found' WHEN grp = 'pilot' THEN 'unknown study group' ELSE 'ok' END AS status, grp AS study_group
       FROM requests LEFT JOIN likes USING (user_id) LEFT JOIN known USING (user_id)""",
    "purchases", "requests",
)
def participant_requests(fx):
    """Requests checked against stored participants, whose groups do not follow the rule for new ones."""
    user = F.col("user_id")
    group = F.when(user % 11 == 0, "pilot").when(user % 3 == 0, "features").otherwise("references")
    stored = fx.table("events").filter("event_type = 'signup'").select("user_id").distinct().select(X.participant_id(user).alias("participant_id"), group.alias("study_group"))
    checked = checked_requests(fx.view("requests"), fx.view("purchases"), stored)
    return checked.select("request_id", F.coalesce("reject_reason", F.lit("ok")).alias("status"), "study_group")


_STORED_SQL = """
    stored AS (SELECT 'rec-' || o_orderkey AS id, 'participant-' || o_custkey AS participant_id,
                      CASE WHEN o_orderpriority = '5-LOW' THEN 'not a time' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS created_at,
                      CASE WHEN o_orderpriority = '1-URGENT' THEN 'unknown' ELSE 'features' END AS grp FROM orders),
    lines AS (SELECT 'rec-' || l_orderkey AS id, count(*) AS n_all, count(*) FILTER (l_returnflag <> 'R') AS n_good FROM lineitem GROUP BY l_orderkey)
"""


def _stored_sessions(fx):
    """Stored sessions made of orders and their lines; returned lines lost their item id."""
    item = F.struct(F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("id"), F.lit("t").alias("title"))
    explanation = F.struct(F.lit("references").alias("type"))
    lines = fx.table("lineitem").groupBy("l_orderkey").agg(
        F.to_json(F.collect_list(F.struct(item.alias("item"), explanation.alias("explanation")))).alias("recommendations")
    )
    orders = fx.table("orders")
    time = F.when(F.col("o_orderpriority") == "5-LOW", "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    intent = F.to_json(F.struct(F.col("o_custkey").alias("user_id"), F.lit(3).alias("players"), F.lit(9).alias("player_count"), F.lit(5).alias("num_results")))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.concat(F.lit("rec-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("participant-"), F.col("o_custkey").cast("string")).alias("participant_id"),
        time.alias("created_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "unknown").otherwise("features").alias("experiment_group"),
        intent.alias("intent"),
        "recommendations",
    )


@query(
    "session_decode",
    f"""WITH {_STORED_SQL} SELECT id, participant_id, CASE WHEN created_at = 'not a time' THEN '2024-02-01T00:00:00' ELSE created_at END AS created_at,
        CASE WHEN grp = 'unknown' THEN 'references' ELSE grp END AS experiment_group, CAST(3 AS INTEGER) AS players,
        CAST(coalesce(n_good, 0) AS INTEGER) AS n_selections, CAST(coalesce(n_all - n_good, 0) AS INTEGER) AS skipped FROM stored LEFT JOIN lines USING (id)""",
)
def session_decode(fx):
    decoded = X.decode(_stored_sessions(fx), F.lit(_CREATED).cast("timestamp"))
    return decoded.select(
        "id", "participant_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "experiment_group",
        F.col("intent.players").alias("players"), F.size("recommendations").alias("n_selections"), "skipped",
    )


@query(
    "session_access",
    f"""WITH asked AS (SELECT c_custkey, 'rec-' || (c_custkey * 7) AS session_id, 'participant-' || (c_custkey * c_custkey % 50) AS participant_id FROM customer),
        owners AS (SELECT 'rec-' || o_orderkey AS session_id, 'participant-' || o_custkey AS owner FROM orders)
        SELECT c_custkey, CASE WHEN owner IS NULL THEN 'missing' WHEN owner = participant_id THEN 'ok' ELSE 'denied' END AS status
        FROM asked LEFT JOIN owners USING (session_id)""",
)
def session_access(fx):
    key = F.col("c_custkey")
    asked = fx.table("customer").select(
        "c_custkey",
        F.concat(F.lit("rec-"), (key * 7).cast("string")).alias("session_id"),
        F.concat(F.lit("participant-"), (key * key % 50).cast("string")).alias("participant_id"),
    )
    sessions = fx.table("orders").select(
        F.concat(F.lit("rec-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("participant-"), F.col("o_custkey").cast("string")).alias("participant_id"),
    )
    return X.session_access(asked, sessions).select("c_custkey", "status")


@query(
    "preferences",
    """SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY event_id) AS INTEGER) AS pos_, item_id, title FROM (
           SELECT 'session-' || user_id AS request_id, event_id, event_id % (SELECT count(*) FROM embeddings) AS item_id FROM events WHERE event_type = 'purchase')
       JOIN records USING (item_id)""".replace("CAST(row_number() OVER (PARTITION BY request_id ORDER BY event_id) AS INTEGER) AS pos_", "event_id AS pos"),
    "record_columns", "records",
)
def preferences(fx):
    n = fx.table("embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    stored = fx.table("events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("session-"), F.col("user_id").cast("string")).alias("request_id"),
        F.col("event_id").alias("pos"), (F.col("event_id") % n).alias("item_id"),
    )
    return S.preferences(stored, fx.records())
