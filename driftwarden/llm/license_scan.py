"""License scans by an exact set-similarity join of text blocks with license templates.

Texts are cut into blocks (lines). Tokens of templates are ordered by how many blocks
of the whole corpus hold them, rarest first. A block that contains at least the
threshold's share of a template's tokens must hold one of the template's first
(size - needed + 1) tokens, so blocks and templates are joined on those only. Length
and positional filters drop candidates that cannot reach the threshold, and what is
left is counted exactly. All of it is DataFrame expressions.

A line is a block for templates of at least as many words. Published notices are wrapped,
and they stand inside longer lines, so runs of words are blocks as well, across line breaks
or within a line: every run of as many words as a template has. Words that are scattered
more widely name no license. Only texts whose words hold enough of a template's tokens at
all are cut into such runs, and only at places of those tokens.

Beside the join, whole texts are searched for the phrases of the base labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import store

THRESHOLD = 0.8  # share of a template's distinct tokens that a block holds

# Phrases of the base labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Sentences that name a license, as lower-case words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "this file is released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _count(words: Column) -> Column:
    """Words of a text whose words are parted by one space."""
    spaces = F.char_length(words) - F.char_length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(words == "", 0).otherwise(spaces + 1)


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase begins."""
    # Every word gets a space of its own on both sides, so that matches share none.
    apart = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    wanted = " " + phrase.replace(" ", "  ") + " "
    pieces = F.split(apart, wanted)
    inside = len(phrase.split())

    def step(state: Column, piece: Column) -> Column:
        before = (F.char_length(piece) - F.char_length(F.replace(piece, F.lit(" "), F.lit("")))) / 2
        at = state["at"] + before.cast("long")
        return F.struct((at + inside).alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    # The last piece ends no match.
    found = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step, lambda s: s["out"])
    return F.when(F.contains(apart, F.lit(wanted)), found).otherwise(F.array().cast("array<long>"))


def _in_runs(lines: Column, known: Column, templates: Column) -> Column:
    """Templates ``(label, n, needed, tokens)`` found in a run of ``n`` words of a text:
    structs of label and largest share."""
    words = F.split(F.array_join(lines, " "), " ")

    def shared(t: Column, places: Column) -> Column:
        # A run that reaches the threshold can begin at a token of the template, and holds
        # at most ``n`` of them.
        def of_run(w: Column, i: Column) -> Column:
            near = F.filter(F.slice(places, i + 1, t["n"]), lambda x: x["place"] < w["place"] + t["n"])
            return F.size(F.array_distinct(F.transform(near, lambda x: x["token"])))

        return F.array_max(F.transform(places, of_run))

    def found(t: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(i.alias("place"), w.alias("token")))
        places = F.filter(numbered, lambda w: F.array_contains(t["tokens"], w["token"]))
        # An array of one element, so that the places are worked out once.
        return F.struct(
            t["label"].alias("label"), t["needed"].alias("needed"), F.size(t["tokens"]).alias("size"),
            F.transform(F.array(places), lambda p: shared(t, p))[0].alias("shared"),
        )

    likely = F.transform(F.array(F.array_intersect(words, known)), lambda own: F.filter(
        templates, lambda t: F.size(F.array_intersect(own, t["tokens"])) >= t["needed"]
    ))[0]
    best = F.filter(F.transform(likely, found), lambda x: x["shared"] >= x["needed"])
    return F.transform(best, lambda x: F.struct(x["label"].alias("label"), (x["shared"] / x["size"]).alias("share")))


def license_labels(
    docs: DataFrame, threshold: float = THRESHOLD, templates: tuple = TEMPLATES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of all phrases),
    first_word, last_word (the first and the last place, null without one), base_labels,
    labels (base ones and those of templates found), score (1 with a base phrase, else
    the largest share of a template's tokens in a block, if it reaches the threshold,
    else 0). A block is a run of as many words as the template has, or a line that is no
    longer. Null texts count as empty. Rows that share a doc_id share template labels.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = [(label, list(dict.fromkeys(text.split()))) for label, text in templates]
    vocabulary = sorted({t for _, tokens in sets for t in tokens})
    known = F.array(*[F.lit(t) for t in vocabulary])
    least = min(math.ceil(threshold * len(tokens) - 1e-9) for _, tokens in sets)

    listed = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.lit(len(text.split())).alias("n"),
            F.lit(math.ceil(threshold * len(tokens) - 1e-9)).alias("needed"),
            F.array(*[F.lit(t) for t in tokens]).alias("tokens"),
        )
        for (label, text), (_, tokens) in zip(templates, sets)
    ])

    lines = texts.select(
        "doc_id",
        F.filter(
            F.transform(F.split(F.lower("text"), "\n"), lambda t: F.trim(F.regexp_replace(t, _BREAKS, " "))),
            lambda t: t != "",
        ).alias("lines"),
    )
    words = F.array_join("lines", " ")
    places = F.flatten(F.array(*[_places(words, p) for p in PHRASES]))
    labels = F.array_compact(F.array(*[
        F.when(F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(f" {p} ")), F.lit(label))
        for p, label in PHRASES.items()
    ]))
    blocks = F.filter(
        F.transform(
            "lines",
            lambda t: F.struct(
                _count(t).alias("n"), F.array_intersect(F.split(t, " "), known).alias("tokens")
            ),
        ),
        lambda b: F.size(b["tokens"]) > 0,
    )
    scanned = store(
        lines.select(
            "doc_id", _count(words).cast("long").alias("n_words"), places.alias("places"),
            F.array_sort(F.array_distinct(labels)).alias("base"), blocks.alias("blocks"),
            _in_runs(F.col("lines"), known, listed).alias("across"),
        ),
        "license-blocks",
    )

    exploded = scanned.select("doc_id", F.explode("blocks").alias("b"))
    counts = exploded.select(F.explode("b.tokens").alias("token")).groupBy("token").count()
    frequency = {r.token: r["count"] for r in counts.collect()}  # at most the vocabulary
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t)))}
    rows = []
    for number, (label, tokens) in enumerate(sets):
        tokens = sorted(tokens, key=order.__getitem__)
        needed = math.ceil(threshold * len(tokens) - 1e-9)
        rows += [
            (tokens[i], number, label, i, needed, len(templates[number][1].split()), tokens)
            for i in range(len(tokens) - needed + 1)
        ]
    index = docs.sparkSession.createDataFrame(
        rows, "token string, template int, label string, place int, needed int, most int, template_tokens array<string>"
    )
    rank = F.create_map(*[F.lit(x) for t in vocabulary for x in (t, order[t])])
    prefixes = F.array(*[F.lit(t) for t in sorted({r[0] for r in rows})])
    able = exploded.where((F.col("b.n") >= least) & (F.size("b.tokens") >= least) & F.arrays_overlap("b.tokens", prefixes))
    ordered = able.select(
        "doc_id", "b.n",
        F.transform(
            F.array_sort(F.transform("b.tokens", lambda t: F.struct(rank[t].alias("rank"), t.alias("token")))),
            lambda s: s["token"],
        ).alias("tokens"),
    )
    before = F.least("place", "at")
    after = F.least(F.size("template_tokens") - F.col("place"), F.size("tokens") - F.col("at"))
    # The index is as large as the fixed list of templates.
    candidates = ordered.select("doc_id", "n", "tokens", F.posexplode("tokens").alias("at", "token")).join(
        F.broadcast(index), "token"
    ).where(
        F.col("n").between(F.col("needed"), F.col("most"))
        & (F.size("tokens") >= F.col("needed"))
        & (before + after >= F.col("needed"))
    )
    shared = F.size(F.array_intersect("tokens", "template_tokens"))
    hits = (
        candidates.withColumn("shared", shared).where("shared >= needed")
        .groupBy("doc_id").agg(
            F.array_sort(F.collect_set("label")).alias("found"),
            F.max(F.col("shared") / F.size("template_tokens")).alias("share"),
        )
    )
    n = F.size("places").cast("long")
    none = F.array().cast("array<string>")
    across = F.transform("across", lambda x: x["label"])
    share = F.coalesce(F.greatest("share", F.array_max(F.transform("across", lambda x: x["share"]))), F.lit(0.0))
    return scanned.join(hits, "doc_id", "left").select(
        "doc_id", "n_words", n.alias("n_base"),
        F.when(n > 0, F.array_min("places")).alias("first_word"),
        F.when(n > 0, F.array_max("places")).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union(F.array_union("base", across), F.coalesce("found", none))), ","
        ).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
