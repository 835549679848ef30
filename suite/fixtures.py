"""Views of the test tables in the shape of the engine's inputs.

Each view is one SQL text that runs in Spark and in DuckDB: ``{table}`` names an
input, back-ticks quote identifiers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from shelfwise.session import load_tables

VIEWS = {
    "raw_catalog": """
        SELECT d.doc_id AS item_id,
               concat(p.p_name, ' ', CAST(d.doc_id AS STRING)) AS name,
               d.text AS description,
               CAST(CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE 1985 + d.doc_id % 40 END AS INT) AS year_published,
               CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE CAST((d.doc_id * 31) % 90 AS DOUBLE) / 10e0 + 1e0 END AS avg_rating,
               CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE (d.doc_id * 7919) % 20011 END AS num_user_ratings,
               CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE (d.doc_id * 104729) % 60013 END AS num_owned,
               CAST(CASE WHEN p.p_size % 11 = 0 THEN NULL ELSE 1 + p.p_size % 8 END AS INT) AS min_players,
               CAST(CASE WHEN p.p_size % 11 = 0 THEN NULL ELSE 1 + p.p_size % 8 + d.doc_id % 4 END AS INT) AS max_players,
               CAST(CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 15 * (1 + d.doc_id % 20) END AS INT) AS community_max_playtime,
               CAST(CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 10 * (1 + d.doc_id % 20) END AS INT) AS community_min_playtime,
               CAST(CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE 20 * (1 + p.p_size % 10) END AS INT) AS mfg_playtime,
               CAST(p.p_size % 50 AS DOUBLE) / 10e0 AS complexity,
               CAST(4 + p.p_size % 14 AS DOUBLE) AS age_recommendation
        FROM {documents} d JOIN {part} p ON p.p_partkey = d.doc_id""",
    "category_flags": """
        SELECT p.p_partkey AS item_id,
               CASE WHEN p.p_type = 'ECONOMY' THEN 1 ELSE 0 END AS cat_economy,
               CASE WHEN p.p_type IN ('SMALL','MEDIUM') THEN 1 ELSE 0 END AS cat_family,
               CASE WHEN p.p_size % 2 = 0 THEN 1 ELSE 0 END AS cat_strategy
        FROM {part} p""",
    "mechanic_flags": """
        SELECT p.p_partkey AS item_id,
               CASE WHEN p.p_size % 2 = 0 THEN 1 ELSE 0 END AS `Dice Rolling`,
               CASE WHEN p.p_size % 3 = 0 THEN 1 ELSE 0 END AS `Set Collection`,
               CASE WHEN p.p_size % 5 = 0 THEN 1 ELSE 0 END AS `Worker Placement`,
               CASE WHEN p.p_size % 7 = 0 THEN NULL ELSE p.p_size % 2 END AS `Trading`
        FROM {part} p""",
    "subcategory_flags": """
        SELECT p.p_partkey AS item_id,
               CASE WHEN p.p_size % 4 = 0 THEN 1 ELSE 0 END AS `Card Game`,
               CASE WHEN p.p_type = 'PROMO' THEN 1 ELSE 0 END AS `Party Game`
        FROM {part} p""",
    "theme_flags": """
        SELECT p.p_partkey AS item_id,
               CASE WHEN p.p_size % 6 = 1 THEN 1 ELSE 0 END AS `Fantasy`,
               CASE WHEN p.p_brand IN ('Brand#1', 'Brand#12') THEN 1 ELSE 0 END AS `Pirates`,
               CASE WHEN p.p_size % 5 = 2 THEN 1 ELSE 0 END AS `Science Fiction`
        FROM {part} p""",
    "items": """
        SELECT vec_id AS item_id, CAST(embedding AS ARRAY<DOUBLE>) AS vector, label FROM {embeddings}""",
    "purchases": """
        SELECT e.user_id AS user_id, e.event_id % (SELECT count(*) FROM {embeddings}) AS item_id
        FROM {events} e WHERE e.event_type = 'purchase'""",
    "liked": """
        SELECT DISTINCT e.user_id AS user_id, e.event_id % (SELECT count(*) FROM {embeddings}) AS item_id
        FROM {events} e WHERE e.event_type = 'purchase'""",
    "wishlist_events": """
        SELECT event_id, ts, user_id, event_id % 7 AS item_id,
               CASE event_type WHEN 'click' THEN 'add' ELSE 'remove' END AS action
        FROM {events} WHERE event_type IN ('click','error')""",
    "requests": """
        SELECT concat('req-', CAST(c_custkey AS STRING)) AS request_id, c_custkey % 150 AS user_id,
               CAST(c_custkey % 7 AS INT) AS players,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'short' WHEN 'MACHINERY' THEN 'medium'
                                 WHEN 'FURNITURE' THEN 'long' END AS duration,
               CAST(c_custkey % 120 AS INT) AS num_results
        FROM {customer}""",
    # catalog records: bounds always known, tags as labels to be put into lists
    "record_columns": """
        SELECT d.doc_id AS item_id,
               concat(p.p_name, ' ', CAST(d.doc_id AS STRING)) AS title,
               d.text AS description,
               CASE WHEN p.p_size % 2 = 0 THEN 'Dice Rolling' END AS m1,
               CASE WHEN p.p_size % 3 = 0 THEN 'Set Collection / Hand Management' END AS m2,
               CASE WHEN p.p_size % 5 = 0 THEN 'Bag Stacking' END AS m3,
               CASE WHEN p.p_size % 10 = 1 THEN 'Trading' END AS m4,
               CASE WHEN p.p_size % 4 = 1 THEN 'fantasy' END AS t1,
               CASE WHEN p.p_size % 6 = 1 THEN 'Science Fiction: Space Exploration' END AS t2,
               CASE WHEN p.p_name LIKE 'red%' THEN 'Robots' END AS t3,
               CASE WHEN p.p_size % 11 <> 0 THEN lower(p.p_type) END AS g1,
               CAST(1 + p.p_size % 4 AS INT) AS min_players,
               CAST(1 + p.p_size % 4 + d.doc_id % 4 AS INT) AS max_players,
               CASE WHEN p.p_size % 9 = 0 THEN NULL ELSE CAST(p.p_size % 50 AS DOUBLE) / 10e0 END AS complexity,
               CAST(4 + p.p_size % 14 AS INT) AS age_recommendation,
               (d.doc_id * 7919) % 20011 AS num_user_ratings,
               CAST((d.doc_id * 31) % 90 AS DOUBLE) / 10e0 AS avg_user_rating,
               CAST(CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE 1985 + d.doc_id % 40 END AS INT) AS year_published,
               CAST(15 * (1 + d.doc_id % 20) AS INT) AS playing_time_minutes,
               'https://example.com/placeholder.jpg' AS image_url
        FROM {documents} d JOIN {part} p ON p.p_partkey = d.doc_id""",
    "metadata": """
        SELECT l.doc_id AS item_id,
               CASE WHEN l.toxic = 1 THEN '' ELSE concat('about item ', CAST(l.doc_id AS STRING)) END AS description,
               CASE WHEN l.quality = 1 THEN concat('https://example.com/', CAST(l.doc_id AS STRING), '.png') END AS image_url
        FROM {labels} l""",
}

RECORD_LISTS = {"mechanics": ("m1", "m2", "m3", "m4"), "themes": ("t1", "t2", "t3"), "genre": ("g1",)}
_REFERENCE = re.compile(r"\{(\w+)\}")


class Fixture:
    """Lazily built views over one test folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return load_tables(self.spark, self.sf_dir, name)[name]

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        inputs = {table: self.table(table) for table in set(_REFERENCE.findall(text))}
        return self.spark.sql(text, **inputs)

    def records(self) -> DataFrame:
        """Catalog records with tag lists."""
        from pyspark.sql import functions as F

        flat = self.view("record_columns")
        lists = {
            name: F.filter(F.array(*columns), lambda label: label.isNotNull())
            for name, columns in RECORD_LISTS.items()
        }
        return flat.withColumns(lists).drop(*[c for columns in RECORD_LISTS.values() for c in columns])


def _duck(text: str) -> str:
    text = _REFERENCE.sub(r"\1", text)
    for spark_form, duck_form in (
        ("ARRAY<DOUBLE>", "DOUBLE[]"),
        ("AS STRING", "AS VARCHAR"),
        ("`", '"'),
    ):
        text = text.replace(spark_form, duck_form)
    return text


_LISTS = ", ".join(
    f"list_filter([{', '.join(columns)}], lambda x: x IS NOT NULL) AS {name}" for name, columns in RECORD_LISTS.items()
)
_DROPPED = ", ".join(column for columns in RECORD_LISTS.values() for column in columns)
RECORDS_SQL = f"SELECT * EXCLUDE ({_DROPPED}), {_LISTS} FROM record_columns"


def with_views(*names: str, body: str) -> str:
    """Oracle SQL with the named views as CTEs (``records`` needs ``record_columns``)."""
    parts = []
    for name in names:
        text = RECORDS_SQL if name == "records" else VIEWS.get(name)
        parts.append(f"{name} AS ({_duck(text)})")
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    body = body.strip()
    if head and body.upper().startswith("WITH "):
        return head.rstrip() + ",\n" + body[5:]
    return head + body
