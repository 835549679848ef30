"""Mixing sources to target weights by a low-discrepancy schedule.

Every slot of the mix is one point of the golden-ratio sequence, mapped through the sources' cumulative targets to the
source it falls on. The slots of a source are ranked, and slot ``r`` takes block ``r`` of that source: its documents in a
shuffled order, cut into blocks of ``BLOCK`` tokens (words). Past the last block the ranks start over, at most ``repeats``
times, which is also where a target stops. Only DataFrame operations are used.

One point stands for ``BLOCK`` words of the whole mix, so it may miss a small source. A source whose target is up to
``EXACT`` blocks gets slots of its own instead, spread evenly over the mix: as many as its target needs, the last of them
with only the remaining words, so that exactly its target (whole words, at least one) is taken.

Sizes are words of the whole text (null: 0). Weights repeat over the sources in code-point order, a null source last and a
source of its own; targets share ``share`` of all sizes by weight, stop at ``repeats`` times their source's size, and what is
over is shared again by weight. Sources without words have target 0. The order is a hash of the id, then the id, so reruns
agree; rows with equal ids share one place each by their text's hash, and identical rows are taken alike.

Ranks and running sums never pass through one task per source: they are counted per source and chunk, summed over the
chunks, and finished inside each chunk (``SPREAD`` documents or slots on average).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.frames import WORD, fresh, pick, quoted, sifted, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
#: Tokens of a block; a target is met to within a few blocks.
BLOCK = 64
#: Blocks up to which a target is met exactly; MIX_SQL draws points for those sources too and agrees where no target is as small.
EXACT = 16
#: Documents or slots of a source in one chunk, on average.
SPREAD = 4096
#: Sources with at least one row in so many get a row in the guide, which is broadcast.
GUIDED = 10_000
#: The golden ratio's fraction times 2^31, made odd; from 2^31 slots on the points repeat, still evenly spread.
GOLDEN = 1327217885
PERIOD = 1 << 31


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """A place in [0, 2^60) that depends on the id alone (null ids have one of their own)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """One row per source: source, n_docs, source_size, target, and the running sum of whole targets (low, high).

    Sources are taken in the order of what they can hold per weight; those whose limit is below the level that the rest
    would share are full, the others share the rest by weight. The table has one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    limit = repeats * F.col("source_size")
    filling = Window.orderBy("fill", F.col("source").isNull(), F.col("source").cast("binary"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("limit", limit.cast("double"))
        .withColumn("fill", F.col("limit") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", F.col("fill") <= F.col("level"))
        # the level of the first source that is not full holds for all that follow
        .withColumn("rest", F.min(F.when(~F.col("full"), F.struct("fill", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * F.col("rest")))
    )
    whole = F.floor(F.col("target")).cast("long")
    running = F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per.select("source", "n_docs", "source_size", "target", (running - whole).alias("low"), running.alias("high"))


def _running(df: DataFrame, key: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """The sum of ``value`` over all rows of the same key that come before, in the order (chunk, order)."""
    per = df.groupBy(*key, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *[F.col(k).alias(f"_{k}") for k in [*key, chunk]], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    match = F.lit(True)
    for k in [*key, chunk]:
        match = match & df[k].eqNullSafe(per[f"_{k}"])
    inside = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(per, match)
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).select(*df.columns, out)


def schedule(spark: SparkSession, sources: DataFrame, total: int, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """The mix slot by slot: slot, s (number of the source), rank (among the source's slots), block (of the source), words
    (that the slot may take). Slots of small sources share their numbers with others, as the points on them are left out.

    A point finds its source by bins of the targets: a source stands in every bin that it touches, so the join is on
    equal bins and the largest source is spread over most of them.
    """
    bins = 4 * max(1, sources.count())
    width = F.lit(max(total, 1) / bins)
    point = (F.col("id") % PERIOD * GOLDEN % PERIOD).cast("double") / float(PERIOD)
    points = spark.range(-(-total // block)).select(F.col("id").alias("slot"), F.floor(point * F.lit(float(total))).cast("long").alias("at"))
    points = points.withColumn("bin", F.floor(F.col("at") / width).cast("long"))
    first, last = F.floor(F.col("low") / width).cast("long"), F.floor(F.col("high") / width).cast("long")
    whole = F.greatest(F.col("high") - F.col("low"), F.lit(1))
    small = (F.col("target") > 0) & (F.col("source_size") > 0) & (whole <= EXACT * block)
    spans = sources.filter(~small & (F.col("high") > F.col("low"))).select(
        "s", "low", "high", F.ceil(F.col("source_size") / block).cast("long").alias("n_blocks"), F.explode(F.sequence(first, last)).alias("_bin")
    )
    drawn = points.join(spans, (F.col("bin") == F.col("_bin")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    drawn = drawn.select(
        "slot", "s", "n_blocks", F.lit(1).alias("one"),
        F.floor(F.col("slot") * ((F.col("high") - F.col("low")) / float(max(total, 1) * SPREAD))).cast("long").alias("chunk"),
    )
    ranked = _running(drawn, ["s"], "chunk", ["slot"], "one", "rank")
    ranked = ranked.filter(F.col("rank") < repeats * F.col("n_blocks"))
    ranked = ranked.select("slot", "s", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"), F.lit(block).cast("long").alias("words"))

    # small sources: whole passes over their blocks, then the rest of the target
    exact = sources.filter(small).select("s", "source_size", whole.alias("wanted"), F.ceil(F.col("source_size") / block).cast("long").alias("n_blocks"))
    passes = F.floor(F.col("wanted") / F.col("source_size"))
    n_slots = (passes * F.col("n_blocks") + F.ceil((F.col("wanted") - passes * F.col("source_size")) / block)).cast("long")
    exact = exact.withColumn("n", n_slots).withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    exact = exact.withColumn("block", F.col("rank") % F.col("n_blocks"))
    gone = F.floor(F.col("rank") / F.col("n_blocks")) * F.col("source_size") + F.col("block") * block
    words = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("wanted") - gone).cast("long")
    shift = (F.col("s") % PERIOD * GOLDEN % PERIOD).cast("double") / float(PERIOD)
    slot = F.floor((F.col("rank") + shift) / F.col("n") * F.lit(float(max(1, -(-total // block))))).cast("long")
    return ranked.unionByName(exact.select(slot.alias("slot"), "s", "rank", "block", words.alias("words")))


def _rows(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, place, start (words of its source before it), size, source_size, target, taken."""
    spark = docs.sparkSession
    table = pick(docs, doc_id=id_col, source=source_col, text=text_col)
    sizes = stored(table.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("same")))
    sources = stored(source_targets(sizes, weights, share, repeats))
    numbered = sources.select("source", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))).cast("long").alias("s"), "n_docs", "source_size", "target", "low", "high")
    numbered = stored(numbered)
    total = numbered.agg(F.max("high")).first()[0] or 0

    # documents in shuffled order; equal rows count once here and share the outcome
    distinct = sizes.groupBy("doc_id", "source", "same").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    by_source = numbered.select(F.col("source").alias("_source"), "s", "n_docs", "source_size", "target")
    placed = (
        distinct.join(by_source, distinct["source"].eqNullSafe(by_source["_source"]))
        .withColumn("place", shuffle_key(F.col("doc_id")))
        .withColumn("chunk", F.floor(F.col("place") / (F.lit(float(1 << 60)) / F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SPREAD)))).cast("long"))
        .withColumn("words", F.col("size") * F.col("copies"))
        .select("doc_id", "source", "same", "s", "size", "copies", "source_size", "target", "place", "chunk", "words")
    )
    placed = stored(_running(placed, ["s"], "chunk", ["place", "doc_id", "same"], "words", "start"))

    times = schedule(spark, numbered, total, repeats, block).groupBy("s", "block", F.col("words").alias("room")).agg(F.count(F.lit(1)).alias("times"))
    pieces = placed.filter("words > 0").select(
        "doc_id", "same", "s", "start", (F.col("start") + F.col("words")).alias("stop"),
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("words") - 1) / block))).alias("block"),
    )
    overlap = F.greatest(
        F.lit(0), F.least(F.col("stop"), F.col("block") * block + F.col("room")) - F.greatest(F.col("start"), F.col("block") * block)
    )
    took = (
        pieces.join(times, ["s", "block"]).groupBy("doc_id", "same", "s").agg(F.sum(overlap * F.col("times")).alias("took"))
    )
    a, b = placed.alias("a"), took.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.same") == F.col("b.same")) & (F.col("a.s") == F.col("b.s"))
    # what was taken of identical rows is dealt out evenly, the rest to the first of them
    result = a.join(b, same, "left").select(
        "a.doc_id", "a.source", "a.place", "a.start", "a.size", "a.source_size", "a.target", F.coalesce("b.took", F.lit(0)).cast("long").alias("took"), "a.copies",
        F.explode(F.sequence(F.lit(1), F.col("a.copies").cast("int"))).alias("copy"),
    )
    even = F.floor(F.col("took") / F.col("copies")).cast("long")
    taken = (even + F.when(F.col("copy") <= F.col("took") % F.col("copies"), 1).otherwise(0)).cast("long")
    return result.select("doc_id", "source", "place", "start", "size", "source_size", "target", taken.alias("taken"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    rows = _rows(docs, id_col, text_col, source_col, weights, share, repeats, block)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def _guide(rows: DataFrame) -> DataFrame:
    """How often the mix passes whole through a source, and the place up to which it goes once more: source, passes, stop (null: all).

    Only sources with at least one row in ``GUIDED``, so there are no more of them than that.
    """
    per = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("source_size").alias("whole"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("all", F.sum("n").over(Window.partitionBy())).filter((F.col("n") * GUIDED >= F.col("all")) & (F.col("whole") > 0))
    passes = F.floor(F.col("taken") / F.col("whole"))
    per = per.select(F.col("source").alias("_source"), passes.cast("int").alias("passes"), (F.col("taken") - passes * F.col("whole")).alias("cut"))
    joined = rows.join(F.broadcast(per), rows["source"].eqNullSafe(per["_source"]))
    return joined.groupBy("source").agg(
        F.first("passes").alias("passes"), F.min(F.when(F.col("start") >= F.col("cut"), F.col("place"))).alias("stop")
    )


def _guessed(df: DataFrame, guide: DataFrame, source: Column, place: Column, worded: Column, name: str) -> DataFrame:
    """``df`` with a column ``name``: how often its rows are taken by ``guide``."""
    of, passes, stop = (fresh(df, column) for column in ("_of", "_passes", "_stop"))
    joined = df.join(F.broadcast(guide.toDF(of, passes, stop)), source.eqNullSafe(quoted(of)), "left")
    again = F.when(quoted(stop).isNull() | (place < quoted(stop)), 1).otherwise(0)
    times = F.when(worded, F.coalesce(quoted(passes) + again, F.lit(0))).otherwise(0)
    return joined.select(*[quoted(column) for column in df.columns], times.alias(name))


def with_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it: words taken by its size, rounded, at
    least once where any word is taken and never where none is.

    Rows that share an id are repeated alike, by the words taken from all of them. A source is taken from its first place on, so one
    place per source tells for nearly all rows how often; texts are shuffled only for ids that this does not tell (rows at that
    place, ids with several rows, rare sources) and the few that a filter of fixed size takes for those.
    """
    name, right, held, doc = (fresh(docs, column) for column in ("_times", "_right", "_listed", "_doc"))
    rows = stored(_rows(docs, id_col, text_col, source_col).select("doc_id", "source", "place", "start", "size", "source_size", "taken"))
    guide = stored(_guide(rows))
    exact = rows.filter("taken > 0").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.greatest(F.lit(1), F.round(F.sum("taken") / F.sum("size"))).cast("int").alias("times")
    )
    compared = _guessed(rows, guide, F.col("source"), F.col("place"), F.col("size") > 0, "guess")
    compared = compared.join(exact, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("times", F.coalesce("times", F.lit(0)))
    odd = stored(compared.filter("guess <> times").select(F.col("doc_id").alias(doc), F.col("times").alias(right)).distinct())

    columns = [quoted(column) for column in docs.columns]
    worded = F.coalesce(quoted(text_col).rlike(WORD), F.lit(False))
    guessed = _guessed(docs, guide, quoted(source_col), shuffle_key(quoted(id_col)), worded, name)
    guessed = sifted(guessed, (quoted(id_col),), odd.select(quoted(doc)), held)
    clear = guessed.filter(~quoted(held)).select(*columns, quoted(name))
    maybe = guessed.filter(quoted(held)).join(odd, quoted(id_col).eqNullSafe(quoted(doc)), "left")
    repeated = clear.union(maybe.select(*columns, F.coalesce(quoted(right), quoted(name)).alias(name))).filter(quoted(name) > 0)
    copies = repeated.withColumn(name, F.explode(F.sequence(F.lit(1), quoted(name))))
    return copies.select(*columns)


#: The same mix for unique ids in one piece of SQL.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM sizes GROUP BY source
), weighted AS (
  SELECT *, ([3e0, 1e0, 2e0])[CAST((s - 1) % 3 + 1 AS INT)] AS weight, 2e0 * source_size AS lim FROM per
), filling AS (
  SELECT *, lim / weight AS fill,
    1.5e0 * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS remaining,
    sum(weight) OVER (ORDER BY lim / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others
  FROM weighted
), levels AS (SELECT *, remaining / others AS level FROM filling
), targets AS (
  SELECT *, CASE WHEN fill <= level THEN lim ELSE weight * (SELECT arg_min(level, fill) FROM levels WHERE fill > level) END AS target FROM levels
), bounds AS (
  SELECT *, CAST(sum(CAST(floor(target) AS BIGINT)) OVER (ORDER BY s) AS BIGINT) AS high FROM targets
), sources AS (
  SELECT s, source, source_size, target, high - CAST(floor(target) AS BIGINT) AS low, high, CAST(ceil(source_size / 64e0) AS BIGINT) AS n_blocks FROM bounds
), total AS (SELECT coalesce(max(high), 0) AS t FROM sources
), points AS (
  SELECT i AS slot, CAST(floor(CAST(i % 2147483648 * 1327217885 % 2147483648 AS DOUBLE) / 2147483648e0 * CAST(t AS DOUBLE)) AS BIGINT) AS spot
  FROM total, range((SELECT CAST((t + 63) // 64 AS BIGINT) FROM total)) r(i)
), ranked AS (
  SELECT s, n_blocks, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS rank FROM points JOIN sources ON spot >= low AND spot < high
), times AS (
  SELECT s, rank % n_blocks AS block, count(*) AS times FROM ranked WHERE rank < 2 * n_blocks GROUP BY ALL
), placed AS (
  SELECT d.doc_id, d.size, x.s, x.source_size, x.target, CAST(sum(d.size) OVER (PARTITION BY x.s ORDER BY
      CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT), d.doc_id) AS BIGINT) AS stop
  FROM sizes d JOIN sources x ON d.source IS NOT DISTINCT FROM x.source
), took AS (
  SELECT p.doc_id, sum((least(p.stop, (t.block + 1) * 64) - greatest(p.stop - p.size, t.block * 64)) * t.times) AS taken
  FROM placed p JOIN times t ON t.s = p.s AND t.block * 64 < p.stop AND (t.block + 1) * 64 > p.stop - p.size
  WHERE p.size > 0 GROUP BY p.doc_id
)
SELECT p.doc_id, p.size, CAST(p.source_size AS BIGINT) AS source_size, p.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN took k ON p.doc_id = k.doc_id
"""
