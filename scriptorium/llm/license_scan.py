"""License scan: exact set-similarity join of text blocks with license templates, and exact phrases.

A block is a line of a text, or a window over a line break: a line's last words and the next words after it, of
whatever lines, on either side one word less than the longest template has. So a notice that wraps over lines is
whole in the window of its first line. A template matches a block if the block has ``threshold`` of the template's
distinct words or more (containment). The join is exact: the templates' words are ordered by their
number of texts in the whole corpus, rarest first (words of no template never match; they come before all and
count as length only). With ``need`` the least overlap for a template,

- prefix filter: a match shares one of the template's first ``size - need + 1`` words;
- length filter: a match has ``need`` of the ordered words at least;
- positional filter: from the shared word on, both sides have ``need`` words at least.

What passes is verified on the full sets. The corpus is read and cut into words once: that pass counts words, finds
phrases, notes which of the templates' words a text has, and keeps the text only where these words could make up a
match; the others have no blocks to look at. Only the templates' words and counts, as many as the templates have, reach the driver and the broadcast; rows are
never paired with all templates.

A window's match counts if its first line adds a word to it, if half of its words or more aren't those of a match
of one of its lines, and if no window that overlaps has a better match of the same template (or as good, and earlier).

All templates that match a block count, but those whose words found there are all words of a better match: GPL 2's
notice has nearly all words of GPL 3's, and both count only if a block has both numbers. Blocks are sets of words, so
a notice whose words are all part of another's in its block (CC BY beside CC BY-NC) can't be told from it.

Phrases are places where their words stand consecutively, whatever separates them.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

# License notices as they are commonly written, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
# Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a lower-cased text, and what separates words: other ASCII than digits and letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def all_words(text: str) -> list[str]:
    """Words of a template or phrase, lower-cased, in order."""
    return re.findall(WORD, text.lower())


def words_of(text: str) -> list[str]:
    """Distinct words of a template, in order."""
    return list(dict.fromkeys(all_words(text)))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def lowered(text: Column) -> Column:
    """Lower-cased; null is empty. No letter becomes an ASCII one that wasn't: the Kelvin sign would, and is replaced."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))


def block_words(block: Column) -> Column:
    """Words of a lower-cased block, in order: cut at what separates words, which takes a tenth of the time of matching them."""
    return F.array_remove(F.split(block, BETWEEN), "")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Places in an array of words where the phrase's words stand consecutively; texts without one of them aren't walked."""
    own = all_words(phrase)
    here = lambda i: functools.reduce(operator.and_, [F.get(words, i + k) == w for k, w in enumerate(own)])
    none = F.array().cast("array<int>")
    if not own:
        return none
    present = functools.reduce(operator.and_, [F.array_contains(words, w) for w in own])
    return F.when(present, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(none)


def word_order(vocabulary: list[str], own: DataFrame) -> list[str]:
    """The templates' words, by number of texts of the whole corpus that have them (array ``own``), then by word."""
    counts = {r["word"]: r["n"] for r in own.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def text_blocks(low: Column, reach: int) -> Column:
    """Blocks of a lower-cased text, lines and windows: block and last (lines from 0), wrapped, words, rest (a window's words after its first line)."""
    lines = F.transform(F.split(low, "\n"), lambda b, i: F.struct(i.alias("block"), block_words(b).alias("w")))
    lines = F.filter(lines, lambda x: F.size(x["w"]) > 0)

    def of(all_lines: Column) -> Column:
        none = F.array().cast("array<string>")
        alone = F.transform(all_lines, lambda x: F.struct(x["block"].alias("block"), x["block"].alias("last"), F.lit(False).alias("wrapped"), x["w"].alias("words"), none.alias("rest")))

        def window(x: Column, i: Column) -> Column:
            after = F.slice(all_lines, i + 2, F.lit(reach))
            rest = F.slice(F.flatten(F.transform(after, lambda y: F.slice(y["w"], F.lit(1), F.lit(reach)))), F.lit(1), F.lit(reach))
            tail = F.slice(x["w"], F.greatest(F.lit(1), F.size(x["w"]) - F.lit(reach - 1)), F.lit(reach))
            # the last line that a window of ``reach`` words after this line touches
            ends = F.aggregate(
                after, F.struct(F.lit(0).alias("n"), x["block"].alias("last")),
                lambda s, y: F.when(s["n"] >= reach, s).otherwise(F.struct((s["n"] + F.size(y["w"])).alias("n"), y["block"].alias("last"))),
            )
            return F.struct(x["block"].alias("block"), ends["last"].alias("last"), F.lit(True).alias("wrapped"), F.concat(tail, rest).alias("words"), rest.alias("rest"))

        return F.concat(alone, F.filter(F.transform(all_lines, window), lambda x: F.size(x["rest"]) > 0))

    return F.flatten(F.transform(F.array(lines), of))


def unexplained(matches: Column) -> Column:
    """A block's matches without those whose words are all words of a better match: by containment, then size, then label."""
    return F.filter(matches, lambda m: ~F.exists(matches, lambda o: (o > m) & (F.size(F.array_except(m["found"], o["found"])) == 0)))


def kept_matches(matches: Column) -> Column:
    """A text's matches without those of windows that say nothing new, as the module describes."""

    def repeated(m: Column, o: Column) -> Column:
        overlaps = (o["block"] <= m["last"]) & (o["last"] >= m["block"])
        in_line = ~o["wrapped"] & (F.size(F.array_except(m["found"], o["found"])) * 2 < F.size(m["found"]))
        ahead = (o["containment"] > m["containment"]) | ((o["containment"] == m["containment"]) & (o["block"] < m["block"]))
        better = o["wrapped"] & (o["template"] == m["template"]) & ahead
        return overlaps & (in_line | better)

    return F.filter(matches, lambda m: ~m["wrapped"] | ~F.exists(matches, lambda o: repeated(m, o)))


def read_once(docs: DataFrame, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], threshold: float, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: their words counted, phrases found, and what the join needs, written to the scratch folder.

    ``own`` holds the templates' words that a text has, ``low`` the lower-cased text where they could make up a match.
    """
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    enough = [F.size(F.array_intersect("own", _strings(words))) >= _need(words, threshold) for words in (words_of(t) for _, t in templates)]
    words = F.col("_words")
    starts = F.flatten(F.array(*[F.col(f"_at{k}") for k in range(len(phrases))])) if phrases else F.array().cast("array<int>")
    labels = F.array(*[F.when(F.size(f"_at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]) if phrases else F.array().cast("array<string>")
    return stored(
        docs.select(F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("low"))
        .withColumn("_words", block_words(F.col("low")))
        .select(
            "doc_id", "low", F.size(words).cast("long").alias("n_words"), F.array_distinct(F.array_intersect(words, _strings(vocabulary))).alias("own"),
            *[phrase_starts(words, p).alias(f"_at{k}") for k, (p, _) in enumerate(phrases)],
        )
        .withColumn("_starts", starts)
        .select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", "n_words", F.size("_starts").cast("long").alias("n_base"),
            F.array_min("_starts").cast("long").alias("first_word"), F.array_max("_starts").cast("long").alias("last_word"),
            F.array_compact(labels).alias("base_labels"), "own", F.when(functools.reduce(operator.or_, enough, F.lit(False)), F.col("low")).alias("low"),
        ),
        "license-texts",
    )


def _need(words: list[str], threshold: float) -> int:
    return math.ceil(threshold * len(words) - 1e-9)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its phrases, and the templates that its blocks match.

    Returns doc_id, n_words, n_base (places of phrases), first_word and last_word (smallest and
    largest start of a phrase, in words from 0, else null), base_labels (array), matches (array of
    structs: block (its first line, from 0), containment, size, label; every template that a block matches, but
    those explained by a better one, see ``unexplained``). Null texts are empty: no words, no matches. Texts of any
    length and script are read whole. Repeated rows are scanned
    alike; ids may be null; an empty table gives no rows; other columns are not read. Templates have a word at least.
    """
    texts = read_once(docs, templates, phrases, threshold, id_col, text_col)
    order = word_order(sorted({w for _, t in templates for w in words_of(t)}), texts)
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, template in templates:
        words = sorted(words_of(template), key=rank.__getitem__)
        need = _need(words, threshold)
        index += [(w, i, label, words, need) for i, w in enumerate(words[: len(words) - need + 1])]
    quoted = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quoted(w)}, {i}, {quoted(label)}, array({', '.join(map(quoted, words))}), {need})" for w, i, label, words, need in index)
    prefixes = docs.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(word, i, label, template, need)")
    least = min(need for *_, need in index)
    reach = max(len(all_words(t)) for _, t in templates) - 1

    first_words = _strings(sorted({w for w, *_ in index}, key=rank.__getitem__))
    ordered = lambda w: F.array_intersect(_strings(order), w)
    numbered = F.transform(text_blocks(F.col("low"), reach), lambda b: b.withField("words", ordered(b["words"])))
    blocks = F.filter(numbered, lambda b: (F.size(b["words"]) >= least) & F.arrays_overlap(b["words"], first_words))
    kept = ["_row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    place = ["block", "last", "wrapped"]
    open_ = texts.where("low IS NOT NULL").select(*kept, F.explode_outer(blocks).alias("b"))
    each = open_.select(*kept, *[f"b.{c}" for c in place], "b.words", "b.rest", F.posexplode_outer("b.words").alias("j", "word"))
    n_ordered, size = F.size("words"), F.size("template")
    shared = F.array_intersect("words", "template")
    near = (n_ordered >= F.col("need")) & (F.least(size - F.col("i"), n_ordered - F.col("j")) >= F.col("need"))
    found = each.alias("e").join(F.broadcast(prefixes).alias("p"), (F.col("e.word") == F.col("p.word")) & near, "left")
    begins = ~F.col("wrapped") | (F.size(F.array_intersect("rest", "template")) < F.size(shared))
    value = F.struct((F.size(shared) / size).alias("containment"), size.alias("size"), "label", "template", shared.alias("found"))
    match = F.when((F.size(shared) >= F.col("need")) & begins, value)
    carried = [F.first(c).alias(c) for c in kept[1:]]
    each_block = found.groupBy("_row", *place).agg(*carried, F.collect_set(match).alias("of_block"))
    placed = F.transform(unexplained(F.col("of_block")), lambda m: F.struct(*[F.col(c).alias(c) for c in place], *[m[c].alias(c) for c in ("containment", "size", "label", "template", "found")]))
    matches = each_block.groupBy("_row").agg(*carried, F.array_sort(F.flatten(F.collect_list(placed))).alias("matches")).drop("_row")
    shown = F.transform(kept_matches(F.col("matches")), lambda m: F.struct(*[m[c].alias(c) for c in ("block", "containment", "size", "label")]))
    matches = matches.withColumn("matches", F.array_sort(shown))
    without = texts.where("low IS NULL").select(*kept[1:], F.array().cast(matches.schema["matches"].dataType).alias("matches"))
    return without.unionByName(matches)


def report(scanned: DataFrame) -> DataFrame:
    """Labels as sorted, comma-joined strings, and a score: 1 for a phrase, else the largest containment, else 0."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    containment = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(containment).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
    )
