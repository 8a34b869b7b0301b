"""License scans: text blocks that hold a license notice.

Documents are cut into overlapping blocks of words. A template is found in a
block when at least `threshold` of the template's distinct words are there.
This is a set-similarity join of blocks and templates with the usual filters:
words are ordered rarest first by their count in all documents, a pair must
share a word within the prefixes of both, blocks too short to hold enough of a
template are skipped, and so are pairs whose shared word lies too late in
either order. What is left is compared in full.

All templates together are a few hundred words, so they are the index that
every document is probed against where it lies: document texts are not
shuffled, and a source or text as common as a third of all rows is no special
case. Words outside all templates can't add to an overlap and are left out of
the sets. DataFrame functions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK = 64
STEP = 32
THRESHOLD = 0.9
MAX_TEMPLATE_WORDS = 2_000

# Phrases that name a license, and the labels they stand for.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening sentences of common notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without"
        " fee is hereby granted",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # distinct

    def least(self, threshold: float) -> int:
        """Words a block must share; rounding must not lift an exact product."""
        return max(1, ceil(threshold * len(self.words) - 1e-9))


def templates(given: Sequence[tuple[str, str]] = TEMPLATES) -> list[Template]:
    """Templates from (label, text); longer than `STEP` words they might not
    lie whole in one block, so that is refused, as is an index without bound."""
    out = []
    for label, text in given:
        words = [w for w in re.split(SEPARATOR, text.translate(str.maketrans(_UPPER, _LOWER))) if w]
        if not words or len(words) > STEP:
            raise ValueError(f"a template has 1 to {STEP} words: {text!r}")
        out.append(Template(label, tuple(sorted(set(words)))))
    if sum(len(t.words) for t in out) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates together hold at most {MAX_TEMPLATE_WORDS} words")
    return out


def words_of(text: Column) -> Column:
    """The words of a text, A to Z lower-cased and nothing else; none if NULL."""
    content = F.coalesce(text, F.lit(""))
    # Of a text in ASCII, lower() does just that, at a fraction of the time.
    ascii_only = F.octet_length(content) == F.char_length(content)
    lowered = F.when(ascii_only, F.lower(content)).otherwise(F.translate(content, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(LICENSE_WORD), F.lit(0))


def _any_of(phrases: Sequence[Sequence[str]]) -> str:
    """Pattern that finds every text in which the words may stand in a row."""
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return "(?i)" + "|".join(gap.join(map(re.escape, words)) for words in phrases)


def prepare(docs: DataFrame, known: Sequence[Template], threshold: float, text: str) -> Column:
    """The index as a one-value subquery, computed once per run: `words`, all
    template words, rarest in the documents first (ties by word); `templates`,
    see `_index`; `prefix`, the words one of which any match must hold. At
    most MAX_TEMPLATE_WORDS words."""
    vocabulary = sorted({word for template in known for word in template.words})
    found = docs.select(F.explode(words_of(F.col(text))).alias("word")).where(F.col("word").isin(vocabulary))
    counted = found.groupBy("word").agg(F.count("*").alias("n"))
    listed = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    order = (
        listed.join(F.broadcast(counted), "word", "left")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("words"))
        .select(F.col("words.word").alias("words"))
    )
    indexed = order.withColumn("templates", _index(F.col("words"), known, threshold))
    prefix = F.array_distinct(F.flatten(F.transform("templates", lambda t: t["prefix"])))
    indexed = indexed.withColumn("prefix", F.transform(prefix, lambda r: F.element_at("words", r)))
    return indexed.select(F.struct("words", "templates", "prefix")).scalar()


def _index(order: Column, known: Sequence[Template], threshold: float) -> Column:
    """The templates as structs: label, size, least, ranks (ascending places of
    their words in the order), prefix (the ranks one of which a block must hold)."""
    rows = []
    for number, template in enumerate(known):
        least = template.least(threshold)
        ranks = F.array_sort(F.transform(F.array(*map(F.lit, template.words)), lambda w: F.array_position(order, w).cast("int")))
        rows.append(
            F.struct(
                F.lit(number).alias("number"),
                F.lit(template.label).alias("label"),
                F.lit(len(template.words)).alias("size"),
                F.lit(least).alias("least"),
                ranks.alias("ranks"),
                F.slice(ranks, 1, len(template.words) - least + 1).alias("prefix"),
            )
        )
    return F.array(*rows)


def _matches(block: Column, index: Column) -> Column:
    """Templates found in a block, given as the ascending ranks of its words."""

    def possible(t: Column) -> Column:
        n = F.size(block)
        reach = F.slice(block, 1, F.greatest(n - t["least"] + 1, F.lit(0)))
        # The first shared word, and how much can still be shared from there on.
        first = F.array_min(F.array_intersect(t["prefix"], reach))
        rest = F.least(
            t["size"] - F.array_position(t["ranks"], first).cast("int"),
            n - F.array_position(block, first).cast("int"),
        )
        return (n >= t["least"]) & first.isNotNull() & (rest + 1 >= t["least"])

    def shared(t: Column) -> Column:
        return F.size(F.array_intersect(t["ranks"], block))

    candidates = F.filter(index, possible)
    verified = F.transform(
        candidates, lambda t: F.struct(t["label"].alias("label"), t["size"].alias("size"), t["least"].alias("least"), shared(t).alias("shared"))
    )
    return F.filter(verified, lambda m: m["shared"] >= m["least"])


def blocks(words: Column) -> Column:
    """(start, words) of blocks of BLOCK words, one every STEP; any STEP + 1
    words in a row lie whole in one of them."""
    last = F.greatest(F.ceil((F.size(words) - BLOCK) / STEP), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda b: F.struct((b * STEP).alias("start"), F.slice(words, b * STEP + 1, BLOCK).alias("words")),
    )


def scan(
    docs: DataFrame,
    given: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, places (start, label) of the phrases, found
    (block start, label, size, shared) of the templates.

    A NULL or empty text has no words and nothing is found. Rows that repeat
    are scanned on their own, an empty table gives no rows, other columns are
    ignored. Texts of any length are scanned whole.
    """
    known = templates(given)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    spoken = {tuple(phrase.split()): label for phrase, label in phrases.items()}
    content = F.coalesce(F.col("text"), F.lit(""))
    words = F.col("words")
    # A phrase ends in one of these words: where none is, the pattern need not look.
    last_words = F.array(*(F.lit(word) for word in sorted({phrase[-1] for phrase in spoken})))

    def places(words: Column) -> Column:
        def here(phrase: tuple[str, ...], label: str) -> Column:
            hits = F.filter(
                F.sequence(F.lit(0), F.size(words)),
                lambda at: F.slice(words, at + 1, len(phrase)) == F.array(*map(F.lit, phrase)),
            )
            return F.transform(hits, lambda at: F.struct(at.cast("long").alias("start"), F.lit(label).alias("label")))

        return F.concat(*(here(phrase, label) for phrase, label in spoken.items()))

    none_placed = F.array().cast("array<struct<start:bigint,label:string>>")
    none_found = F.array().cast("array<struct<start:int,label:string,size:int,shared:int>>")
    index = F.col("index")
    prepared = rows.select(
        "doc_id",
        prepare(rows, known, threshold, "text").alias("index"),
        content.alias("content"),
        words_of(F.col("text")).alias("words"),
    )
    said = F.arrays_overlap(words, last_words) & F.col("content").rlike(_any_of(list(spoken)))
    # A text with none of the prefix words holds no candidate: most texts end here.
    near = F.arrays_overlap(words, index["prefix"])

    def found(words: Column) -> Column:
        def ranks(block: Column) -> Column:
            known_here = F.array_intersect(block["words"], index["words"])
            return F.array_sort(F.transform(known_here, lambda w: F.array_position(index["words"], w).cast("int")))

        def hits(block: Column) -> Column:
            return F.transform(
                _matches(block["ranks"], index["templates"]),
                lambda m: F.struct(block["start"].alias("start"), m["label"].alias("label"), m["size"].alias("size"), m["shared"].alias("shared")),
            )

        ranked = F.transform(blocks(words), lambda b: F.struct(b["start"].alias("start"), ranks(b).alias("ranks")))
        return F.flatten(F.transform(ranked, hits))

    return prepared.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.when(said, places(words)).otherwise(none_placed).alias("places"),
        F.when(near, found(words)).otherwise(none_found).alias("found"),
    )


def summary(scanned: DataFrame) -> DataFrame:
    """Per row of `scan`: how many phrases, where, and the labels."""
    starts = F.col("places.start")
    base = F.array_distinct(F.col("places.label"))
    all_labels = F.array_union(F.col("places.label"), F.col("found.label"))
    best = F.array_max(F.transform("found", lambda m: m["shared"] / m["size"]))
    n_base = F.size("places").cast("long")
    return scanned.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_labels), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
