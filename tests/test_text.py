import re

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.functions.lexicon import STOPWORDS, SYNONYMS


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()
    return row["x"]


def sequential(text, synonyms):
    text = re.sub(r"\s+", " ", text)
    for canonical, variants in synonyms.items():
        spellings = sorted({v.lower() for v in [*variants, canonical]}, key=lambda v: (-len(v), v))
        for spelling in spellings:
            text = re.sub(rf"\b{re.escape(T.canonical_phrase(spelling))}\b", T.canonical_phrase(canonical), text)
    return text


@pytest.mark.parametrize(
    "text",
    [
        "a rolling dice rolling dice game of press  your\nluck",
        "co op cooperative play play, wargame and war; scifi sci fi science fiction",
        "éwar war été; deckbuilding deck construction area dominance area control",
        "horror themed horror themed theme driven thematic party style game 1v1 duel",
        "pick up and deliver pickup delivery pick up and deliver it",
    ],
)
def test_alternations_equal_one_rule_per_phrase(spark, text):
    assert one(spark, T.unify_synonyms(F.col("t"), SYNONYMS), t=text) == sequential(text, SYNONYMS)


def test_overlapping_phrases_keep_separate_rules():
    assert len(T.synonym_rules({"dice-rolling": ["dice rolling", "rolling dice"]})) == 2
    assert len(T.synonym_rules({"war": ["war", "wargame"]})) == 1
    overlapping = {"x": ["a b", "b c d"]}
    assert len(T.synonym_rules(overlapping)) == 3
    nested = {"big box game": ["box", "crate"]}
    assert len(T.synonym_rules(nested)) == 3


def test_overlap_order_is_longest_first(spark):
    rules = {"x": ["a b", "b c d"]}
    assert one(spark, T.unify_synonyms(F.col("t"), rules), t="a b c d") == sequential("a b c d", rules) == "a x"


def test_token_text(spark):
    text = "Fast co-op adventure game, the game"
    got = one(spark, T.token_text(F.col("t"), stopwords=["game"], synonyms={"cooperative": ["co-op"]}), t=text)
    assert got == "fast cooperative adventure the fast cooperative cooperative adventure adventure the"
    assert one(spark, T.token_text(F.col("t")), t="one") == "one"
    assert one(spark, T.token_text(F.col("t")), t="") == ""
    assert one(spark, T.token_text(F.col("t"), ngram_range=(2, 3)), t="a b c") == "a b b c a b c"


def test_stopwords_keep_repeats(spark):
    assert one(spark, T.drop_stopwords(F.split("t", " "), STOPWORDS), t="ox game ox cat") == ["ox", "ox", "cat"]


def test_stopword_phrases_match_no_token(spark):
    assert len(STOPWORDS) == 153 and "players must" in STOPWORDS
    assert one(spark, T.drop_stopwords(F.split("t", " "), STOPWORDS), t="players can take the time they must") == ["can", "take", "the", "time", "they", "must"]


def test_tags(spark):
    assert one(spark, T.split_tags(F.col("t")), t=" a , ,b,") == ["a", "b"]
    assert one(spark, T.format_categorical(F.col("t")), t="Dice Rolling, Dice, Set's") == "dice rolling set's"
    assert one(spark, T.match_vocabulary(F.col("t"), ["dice", "race"]), t="Race of Dice") == ["dice", "race"]
    assert one(spark, T.match_vocabulary(F.col("t"), ["dice"]), t="Other") == ["Other"]
    assert T.any_tag_startswith(F.col("t"), [" ", ""]) is None


def test_missing_message(spark):
    assert one(spark, T.missing_message(F.col("n"), F.col("c")), n="Alhpa", c=["Alpha", "Beta"]) == "'Alhpa' (closest: Alpha, Beta)"


def test_synonyms_run_only_where_a_phrase_is(spark):
    # sentences without a phrase are searched once, not once a rule; every rule still sees what earlier ones left
    texts = [
        "co op.co op war-game. player versus  player.1v1 duel. no.scifi" + "\u3000" + "sci fi. .. warm war_ 2war \u00e9war e\u0301war war\u0301",
        ".war.", "", "war", "rolling\tdice\u00a0rolling dice.rolling. dice", "a\u2028\u2029 b \x85c \x1cd",
    ]
    for text in texts:
        result = F.regexp_replace("t", T.WHITESPACE, " ")
        for pattern, replacement in T.synonym_rules(SYNONYMS):
            result = F.regexp_replace(result, pattern, replacement)
        assert one(spark, T.unify_synonyms(F.col("t"), SYNONYMS), t=text) == one(spark, result, t=text)
    plan = spark.range(1).select(T.unify_synonyms(F.lit("x").cast("string"), SYNONYMS))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= 5


def test_synonyms_with_other_characters(spark):
    rules = {"c++": ["c plus plus", "c.p.p"], "war": ["wargame"]}
    assert one(spark, T.unify_synonyms(F.col("t"), rules), t="c.p.p wargame. c plus plus") == "c++ war. c++"
    assert one(spark, T.unify_synonyms(F.col("t"), {}), t="a  b") == "a b"
