"""License scans (operator 12): a positional index of rare license words. DataFrame functions only.

Templates are word sequences with mandatory key phrases. One pass counts in how many files each key word
of the templates stands (the document frequency over all files). A template is then looked up by its
``LOOKUPS`` key words of highest IDF: only a file that holds all its key words is looked at; the places of
the rarest word there, less its place in the template, are candidate starts, and the postings of the next
words are intersected at the same relative positions. What is left is verified: every key phrase must stand
in place, and at least ``MIN_SHARE`` of all the template's words. Every word of a key phrase is mandatory, so
neither the choice of words nor the intersection can lose a match, and all places are found.

Templates marked ``base`` are whole key phrases: their places are exactly the places where the phrase stands.
All work on a file happens within its row: no shuffle but that of the word counts (a row per template word).

Cases: a null or empty text has no words, no places, empty labels, score 0. Very long texts are one row of
words, scanned once per template whose key words they all hold. Rows that share an id, and null ids, are
scanned row by row. Ties in IDF are broken by the word. An empty table gives an empty result. Further
columns, whatever their names, do not matter: ids and texts are taken by name into a new frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Everything in ASCII but digits and letters parts words; all other code points belong to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The one letter outside ASCII that lower() maps to a letter of ASCII, and one that it leaves alone.
KELVIN, NO_KELVIN = "K", "ꝁ"
LOOKUPS, MIN_SHARE = 3, 0.6


@dataclass(frozen=True)
class Template:
    """``text`` with its mandatory phrases in brackets, all in lower case."""
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.replace("[", " ").replace("]", " ").split()

    @property
    def key(self) -> list[int]:
        """Places of the words of key phrases."""
        out, at, inside = [], 0, False
        for token in self.text.replace("[", " [ ").replace("]", " ] ").split():
            if token in "[]":
                inside = token == "["
            else:
                if inside:
                    out.append(at)
                at += 1
        return out


#: The base phrases with their labels, then wordings of license notices.
TEMPLATES = (
    Template("gpl", "[gnu general public license]", base=True),
    Template("apache", "[apache license]", base=True),
    Template("cc-by", "[cc by]", base=True),
    Template("mit", "[mit license]", base=True),
    Template("gpl-2.0", "licensed under the [gnu general public license] [version 2]"),
    Template("gpl-3.0", "licensed under the [gnu general public license] [version 3]"),
    Template("lgpl", "under the terms of the gnu [lesser general public license]"),
    Template("agpl", "under the terms of the gnu [affero general public license]"),
    Template("apache-2.0", "licensed under the [apache license] [version 2 0]"),
    Template("cc-by-sa", "licensed under [cc by sa]"),
    Template("cc-by-nc", "licensed under [cc by nc]"),
    Template("cc-by", "licensed under a [creative commons attribution] 4 0 international license"),
    Template("mpl-2.0", "subject to the terms of the [mozilla public license] v 2 0"),
    Template("mit", "[permission is hereby granted] free of charge to any person obtaining a copy of this software and "
                    "associated documentation files the software to deal in the software [without restriction]"),
    Template("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted "
                    "provided that the [following conditions are met]"),
    Template("isc", "[permission to use copy modify and] or [distribute this software] for any purpose with or without fee "
                    "is hereby granted"),
    Template("gpl", "this program is free software you can [redistribute it and or modify it] under the terms of the "
                    "[gnu general public license] as published by the free software foundation"),
)


def words_of(text: Column) -> Column:
    """Words in lower case (A-Z only matter: words are compared with ASCII words)."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(NO_KELVIN)))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def key_words(templates: Sequence[Template]) -> list[str]:
    return sorted({t.words[k] for t in templates for k in t.key})


def _literal(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequency(files: DataFrame, templates: Sequence[Template]) -> dict[str, int]:
    """Files that hold each key word: at most a row per word of the fixed templates."""
    held = files.select(F.explode(F.array_intersect(_literal(key_words(templates)), words_of(F.col("text")))).alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def _index(templates: Sequence[Template], df: dict[str, int]) -> Column:
    """The templates as one literal array, each with its key words of highest IDF and their places."""
    rows = []
    for t in templates:
        if not t.key:
            raise ValueError(f"a template needs a key phrase: {t.text}")
        words, first = t.words, {}
        for k in t.key:
            first.setdefault(words[k], k)
        rare = sorted(first, key=lambda w: (df.get(w, 0), w))[:LOOKUPS]
        rows.append(F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _literal(words).alias("words"),
            F.array(*[F.lit(k) for k in t.key]).alias("key"), _literal(sorted(first)).alias("needs"),
            _literal(rare).alias("rare"), F.array(*[F.lit(first[w]) for w in rare]).alias("at")))
    return F.array(*rows)


def _matches(words: Column, held: Column, index: Column) -> Column:
    """(label, base, start, length, share) of every verified place of every template."""
    def here(t: Column, start: Column, k: Column) -> Column:
        return F.get(words, start + k) == F.get(t["words"], k)

    def places(t: Column) -> Column:
        n = F.size(words)
        # the postings of the rarest word, then those of the others at the same relative position
        starts = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, i) == t["rare"][0]), lambda i: i - t["at"][0])
        crossed = F.filter(starts, lambda o: F.forall(t["at"], lambda k: F.coalesce(here(t, o, k), F.lit(False))))
        whole = F.filter(crossed, lambda o: F.forall(t["key"], lambda k: F.coalesce(here(t, o, k), F.lit(False))))
        found = F.transform(whole, lambda o: F.struct(
            t["label"].alias("label"), t["base"].alias("base"), o.cast("long").alias("start"), F.size(t["words"]).alias("length"),
            (F.size(F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), lambda k: here(t, o, k))) / F.size(t["words"])).alias("share")))
        return F.filter(found, lambda m: m["share"] >= MIN_SHARE)

    able = F.filter(index, lambda t: F.size(F.array_except(t["needs"], held)) == 0)
    return F.flatten(F.transform(able, places))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, matches) of every row; ``matches`` holds (label, base, start, length, share) with
    starts in words from 0 (a notice whose first words are cut off can start before the text)."""
    files = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    index = _index(templates, document_frequency(files, templates))
    keys = _literal(key_words(templates))
    return files.select("doc_id", let(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        let(F.array_intersect(keys, w), lambda held: _matches(w, held, index)).alias("matches"))).alias("found")) \
        .select("doc_id", "found.n_words", "found.matches")


def labelled(scanned: DataFrame) -> DataFrame:
    """Per row of ``scan``: the places of base phrases, base and all labels, and as score the largest share
    of a template's words that stand in place (0 without a match)."""
    def joined(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    starts = F.transform(F.col("base"), lambda m: m["start"])
    return scanned.withColumn("base", F.filter("matches", lambda m: m["base"])).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(F.col("base")).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"))
