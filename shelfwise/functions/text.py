"""Text expressions: canonical phrases, synonyms, tokens, n-grams, tag lists."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alphabet of the tokenizer, and the word pattern the
# TF-IDF step re-tokenizes with (runs of two or more word characters).
TOKEN_PATTERN = "[a-z0-9']+"
WORD_PATTERN = r"(?U)\w{2,}"
WHITESPACE = r"(?U)\s+"
PLAIN_PHRASE = "[a-z0-9]+(?: [a-z0-9]+)*"


def canonicalize(text: Column) -> Column:
    """Lower-case, ``-`` and ``/`` to spaces, whitespace collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "-/", "  "), WHITESPACE, " "))


def canonical_phrase(text: str) -> str:
    """Driver-side twin of :func:`canonicalize` for configuration phrases."""
    return " ".join(re.sub("[-/]", " ", text.lower()).split())


def synonym_rules(synonyms: Mapping[str, Iterable[str]]) -> list[tuple[str, str]]:
    """Ordered ``(pattern, replacement)`` pairs in configuration order.

    Phrases of one canonical apply longest first (ties alphabetical). They share
    a single alternation when that cannot change the outcome, which saves a pass
    over the text per phrase; otherwise each phrase keeps a rule of its own.
    """
    return [(_whole_words(phrases), target) for phrases, target in _phrase_rules(synonyms)]


def _whole_words(phrases: Sequence[str]) -> str:
    body = "|".join(re.escape(phrase) for phrase in phrases)
    return rf"(?U)\b(?:{body})\b"


def _phrase_rules(synonyms: Mapping[str, Iterable[str]]) -> list[tuple[list[str], str]]:
    """Ordered ``(phrases, replacement)``, one per rule."""
    rules = []
    for canonical, variants in synonyms.items():
        target = canonical_phrase(canonical)
        spellings = {value.lower() for value in (*variants, canonical) if value.strip()}
        ordered = sorted(spellings, key=lambda value: (-len(value), value))
        phrases = list(dict.fromkeys(canonical_phrase(value) for value in ordered))
        groups = [phrases] if _independent(phrases, target) else [[phrase] for phrase in phrases]
        rules.extend((group, target) for group in groups)
    return rules


def _independent(phrases: Sequence[str], target: str) -> bool:
    """True if no phrase can match across, or inside, the replacement of another."""
    if any(re.search("[^a-z0-9 ]", phrase) for phrase in phrases):
        return False
    split = [phrase.split() for phrase in phrases]
    for left in split:
        for right in split:
            shared = range(1, min(len(left), len(right)))
            if any(left[-size:] == right[:size] for size in shared):
                return False
    padded = f" {target} "
    return not any(phrase != target and f" {phrase} " in padded for phrase in phrases)


def _any_start(phrases: Iterable[str]) -> str:
    """Pattern that finds any of the phrases; common beginnings are tried once."""
    tails: dict[str, list[str]] = {}
    for phrase in sorted(phrases):
        tails.setdefault(phrase[:1], []).append(phrase[1:])
    if "" in tails:
        return ""
    return "(?:" + "|".join(first + _any_start(rest) for first, rest in tails.items()) + ")"


def unify_synonyms(text: Column, synonyms: Mapping[str, Iterable[str]]) -> Column:
    """Replace whole-word variants by their canonical phrase, rule after rule.

    Phrases of plain words cannot reach across a full stop. One search then finds the few sentences that hold
    any phrase, and of the rules only those run whose phrases are there; other phrases search the whole text.
    """
    result = F.regexp_replace(text, WHITESPACE, " ")
    rules = _phrase_rules(synonyms)
    if not rules:
        return result
    if not all(re.fullmatch(PLAIN_PHRASE, value) for phrases, target in rules for value in (*phrases, target)):
        for pattern, replacement in synonym_rules(synonyms):
            result = F.regexp_replace(result, pattern, replacement)
        return result
    # a match starts where no letter or digit precedes
    wanted = _any_start({phrase for phrases, _ in rules for phrase in phrases})
    steps = F.array(
        *[
            F.struct(
                F.array(*[F.lit(phrase) for phrase in phrases]).alias("phrases"),
                F.lit(_whole_words(phrases)).alias("pattern"),
                F.lit(target).alias("target"),
            )
            for phrases, target in rules
        ]
    )

    def step(sentence: Column, rule: Column) -> Column:
        present = F.exists(rule["phrases"], lambda phrase: F.contains(sentence, phrase))
        replaced = F.regexp_replace(sentence, rule["pattern"], rule["target"])
        return F.when(present, replaced).otherwise(sentence)

    def unified(sentence: Column) -> Column:
        found = sentence.rlike(f"(?:^|[^a-z0-9]){wanted}")
        return F.when(found, F.aggregate(steps, sentence, step)).otherwise(sentence)

    return F.array_join(F.transform(F.split(result, r"\."), unified), ".")


def tokens(text: Column, synonyms: Mapping[str, Iterable[str]] | None = None) -> Column:
    """Token array of a text, after optional synonym unification."""
    prepared = F.translate(F.lower(F.coalesce(text, F.lit(""))), "-/", "  ")
    if synonyms:
        prepared = unify_synonyms(prepared, synonyms)
    return F.regexp_extract_all(prepared, F.lit(TOKEN_PATTERN), F.lit(0))


def drop_stopwords(words: Column, stopwords: Iterable[str]) -> Column:
    """Remove stop words, keeping order and repeats of the other tokens."""
    lowered = sorted({word.lower() for word in stopwords})
    if not lowered:
        return words
    return F.filter(words, lambda word: ~word.isin(lowered))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """Token n-grams: unigrams first when ``low`` is 1, then each larger size."""
    low = max(1, low)
    high = max(low, high)

    def build(tokens: Column) -> Column:
        count = F.size(tokens)
        parts = [tokens] if low == 1 else []
        grams = tokens
        for size in range(2, high + 1):
            # extend each gram of the previous size by the token that follows it
            fits = F.greatest(count - (size - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, 1, fits),
                F.slice(tokens, size, fits),
                lambda gram, token: F.concat(gram, F.lit(" "), token),
            )
            if size >= low:
                parts.append(grams)
        return F.concat(*parts)

    return let(words, build)


def token_text(
    text: Column,
    *,
    stopwords: Iterable[str] = (),
    synonyms: Mapping[str, Iterable[str]] | None = None,
    ngram_range: tuple[int, int] = (1, 2),
) -> Column:
    """The flat, space-joined n-gram string of a text."""
    kept = drop_stopwords(tokens(text, synonyms), stopwords)
    return F.array_join(ngrams(kept, *ngram_range), " ")


def format_categorical(text: Column) -> Column:
    """Distinct tokens in first-seen order, space-joined."""
    return F.array_join(F.array_distinct(tokens_raw(text)), " ")


def tokens_raw(text: Column) -> Column:
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0)
    )


def words(text: Column) -> Column:
    """Word array the TF-IDF step counts."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def split_tags(text: Column) -> Column:
    """Comma-separated text to a list of trimmed, non-blank tags; null stays null."""
    return F.filter(
        F.transform(F.split(text, ","), lambda part: F.trim(part)), lambda part: part != ""
    )


def clean_tag_list(values: Column) -> Column:
    """Drop blank entries of a tag array; null stays null."""
    return F.filter(values, lambda value: F.trim(value) != "")


def match_vocabulary(label: Column, vocabulary: Sequence[str]) -> Column:
    """Vocabulary terms contained in the label, vocabulary order; else the label."""
    # a constant array, folded once by the optimizer
    terms = F.split(F.lit("\u0001".join(vocabulary)), "\u0001")
    found = let(F.lower(label), lambda lowered: F.filter(terms, lambda term: F.contains(lowered, term)))
    return let(found, lambda matches: F.when(F.size(matches) > 0, matches).otherwise(F.array(label)))


def any_tag_startswith(tags: Column, prefixes: Sequence[str] | None) -> Column | None:
    """True where any tag starts with any prefix, ignoring case; None if no prefix is given."""
    patterns = [f"{str(value).lower()}%" for value in prefixes or () if str(value).strip()]
    if not patterns:
        return None

    def hit(tag: Column) -> Column:
        test = tag.ilike(patterns[0])
        for pattern in patterns[1:]:
            test = test | tag.ilike(pattern)
        return test

    return F.coalesce(F.exists(tags, hit), F.lit(False))


def missing_message(name: Column, closest: Column) -> Column:
    """``'name' (closest: a, b, c)``; without suggestions only the quoted name."""
    quoted = F.concat(F.lit("'"), name, F.lit("'"))
    return F.when(
        F.size(closest) > 0,
        F.concat(quoted, F.lit(" (closest: "), F.array_join(closest, ", "), F.lit(")")),
    ).otherwise(quoted)
