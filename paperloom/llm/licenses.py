"""License scans: exact set-similarity join of text blocks with license templates, in DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import row_key
from paperloom.session import compute_once

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Percent of a template's distinct words that a block must contain.
CONTAINMENT = 90
#: Lines, and the whole text as well, are read in blocks of so many words, each half over the one before.
BLOCK_WORDS = 64
#: How common licenses name themselves, and the label for it.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, NOT_WORD), "")


def _base_places(words: Column) -> Column:
    """``(start, label)`` of every place where a license's name stands."""

    def place(last: Column) -> Column:
        before, first = F.get(words, last - 1), F.get(words, last - 2)
        named = F.when(before.isin("mit", "apache"), F.struct((last - 1).cast("long").alias("start"), before.alias("label")))
        general = (before == "public") & (first == "general")
        named = named.when(general, F.struct((last - 2).cast("long").alias("start"), F.lit("gpl").alias("label")))
        return F.when(F.get(words, last) == "license", named)

    every = F.transform(F.sequence(F.lit(1), F.size(words) - 1), place)
    return F.when(F.size(words) > 1, F.filter(every, lambda found: found.isNotNull()))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = CONTAINMENT) -> DataFrame:
    """Licenses that every row of ``docs(doc_id, text)`` names: ``doc_id``, ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels``, ``score``.

    The base ones are the places where a license's name stands word for word. The others come from blocks, the lines of a
    text and the whole text, long ones in overlapping stretches, that contain at least ``percent`` of the distinct words of a template.
    Template words are ordered by the number of documents that hold them, rarest first. A block that contains enough of a
    template must hold one of its rarest words (prefix), enough template words at all (length), and enough of them from
    the first shared word on, in template and block (position); what passes is counted. ``score`` is the largest share of
    a template found in a block, 1 where a base place is.

    A null text is empty. Rows that share a ``doc_id`` are read each on its own, a null ``doc_id`` is kept. Further columns
    are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sets = [(nth, label, sorted(set(text.split()))) for nth, (label, text) in enumerate(templates)]
    universe = sorted({word for _, _, words in sets for word in words})
    listed = F.array(*map(F.lit, universe))
    low = docs.select("doc_id", row_key().alias("row_key"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))

    # One count for each template word, some hundred rows at most.
    held = low.select(F.explode(F.array_intersect(words_of(F.col("low")), listed)).alias("word"))
    counts = {row.word: row.n for row in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(universe, key=lambda word: (counts.get(word, 0), word))
    rank = {word: nth for nth, word in enumerate(order)}
    index = []
    for nth, label, words in sets:
        need = ceil(len(words) * percent / 100)
        words = sorted(words, key=rank.get)
        for place, word in enumerate(words[: len(words) - need + 1]):
            index.append((word, nth, label, place, need, [rank[other] for other in words]))
    prefixes = spark.createDataFrame(index, "word string, template int, label string, place int, need int, own array<int>")
    rare = sorted({row[0] for row in index})
    ranks = F.create_map(*[part for word in order for part in (F.lit(word), F.lit(rank[word]))])

    holding = low.where(F.arrays_overlap(words_of(F.col("low")), F.array(*map(F.lit, rare))))
    # A sentence may be wrapped over lines, so the text as a whole is one more line.
    own = F.split("low", "\n")
    lines = holding.select("doc_id", "row_key", F.explode(F.when(F.size(own) > 1, F.concat(own, F.array("low"))).otherwise(own)).alias("line"))
    split = compute_once(lines, words=words_of(F.col("line"))).where(F.arrays_overlap("words", F.array(*map(F.lit, rare))))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - BLOCK_WORDS // 2, F.lit(1)), F.lit(BLOCK_WORDS // 2))
    stretches = split.select("doc_id", "row_key", F.explode(F.transform(starts, lambda at: F.slice("words", at, BLOCK_WORDS))).alias("block"))
    tokens = F.array_sort(F.transform(F.array_intersect("block", listed), lambda word: ranks[word]))
    blocks = compute_once(stretches.drop("line"), tokens=tokens).drop("block").where(F.size("tokens") > 0)
    probes = blocks.select("doc_id", "row_key", "tokens", F.posexplode("tokens").alias("at", "token"))
    keyed = prefixes.withColumn("token", ranks[F.col("word")])
    # The index has a few rows per template.
    met = probes.join(F.broadcast(keyed), "token")
    met = met.where(
        (F.size("tokens") >= F.col("need"))
        & (F.size("own") - F.col("place") >= F.col("need"))
        & (F.size("tokens") - F.col("at") >= F.col("need"))
    )
    shared = F.size(F.array_intersect("tokens", "own"))
    passed = met.where(shared >= F.col("need")).select("doc_id", "row_key", "label", (shared / F.size("own")).alias("share"))
    found = passed.groupBy("doc_id", "row_key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))

    read = compute_once(low, words=words_of(F.col("low")))
    narrow = read.select(
        "doc_id", "row_key", F.size("words").cast("long").alias("n_words"),
        F.when(F.col("low").contains("license"), _base_places(F.col("words"))).alias("places"),
    )
    both = narrow.join(found.withColumnRenamed("row_key", "key").withColumnRenamed("doc_id", "id"), [F.col("doc_id").eqNullSafe(F.col("id")), F.col("row_key") == F.col("key")], "left")
    none = F.array().cast("array<string>")
    base = F.coalesce(F.array_distinct(F.col("places.label")), none)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return both.select(
        "doc_id", "n_words",
        F.coalesce(F.size(F.coalesce("places", F.array().cast("array<struct<start:bigint,label:string>>"))), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.col("places.start")).alias("first_word"), F.array_max(F.col("places.start")).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.array_union(base, F.coalesce("more", none))).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def license_sql(templates: list[tuple[str, str]] = TEMPLATES, percent: int = CONTAINMENT) -> str:
    """The same by trying every block with every template."""
    rows = ", ".join(f"('{label}', {sorted(set(text.split()))})" for label, text in templates)
    cut = f"list_filter(string_split_regex({{}}, '{NOT_WORD}'), lambda w: w <> '')"
    return f"""
WITH template(label, own) AS (VALUES {rows}),
low AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS low FROM documents),
tokens AS (SELECT r, doc_id, {cut.format("low")} AS w FROM low),
places AS (
    SELECT r, CASE WHEN w[i - 1] IN ('mit', 'apache') THEN w[i - 1] ELSE 'gpl' END AS label,
           CASE WHEN w[i - 1] IN ('mit', 'apache') THEN i - 2 ELSE i - 3 END AS start
    FROM (SELECT r, w, unnest(generate_series(2, len(w))) AS i FROM tokens WHERE list_contains(w, 'license'))
    WHERE w[i] = 'license' AND (w[i - 1] IN ('mit', 'apache') OR (w[i - 1] = 'public' AND i > 2 AND w[i - 2] = 'general'))),
lines AS (SELECT r, {cut.format("line")} AS w FROM (SELECT r, unnest(list_append(string_split(low, chr(10)), low)) AS line FROM low)),
blocks AS (
    SELECT r, w[first : first + {BLOCK_WORDS - 1}] AS b
    FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - {BLOCK_WORDS // 2}, 1), {BLOCK_WORDS // 2})) AS first FROM lines)),
shares AS (SELECT r, label, len(list_intersect(own, b)) / len(own) AS share FROM blocks, template WHERE 100 * len(list_intersect(own, b)) >= {percent} * len(own)),
every_label AS (SELECT r, label FROM places UNION SELECT r, label FROM shares),
named AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM every_label GROUP BY r),
best AS (SELECT r, max(share) AS share FROM shares GROUP BY r),
base AS (
    SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
           array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels
    FROM places GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM tokens LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""
