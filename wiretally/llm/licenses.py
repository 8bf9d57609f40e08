"""License notices in texts, with DataFrame functions only.

A text is a row of words and of hashes of its five-word shingles. Windows of ``WINDOW`` shingles, one from every place on, are min-hashed
in ``BANDS`` bands of one hash each; a window that agrees in a band with a window of a template retrieves the template. Templates of
fewer shingles are retrieved by single shingles, windows of one. A copy that keeps ``WINDOW`` shingles in a row anywhere is retrieved for
certain: its window is a window of the template. A word changed breaks five shingles in a row, so every copy with a containment of 0.8 that
is longer than a line has such a run. Windows that share a part J of their shingles agree with probability 1 - (1 - J) ** BANDS.

Texts without any shingle whose hash is a template's min-hash are passed over before windows are made: they agree in no band.

Around each place retrieved, the share of the template's shingles that the text holds there is then counted exactly.

All of it runs in the scan's own tasks but for the last sum by text and template, which only retrieved places reach. Templates are a stated
query set: their window hashes become literals of the filter, so they must be at most ``MOST`` in number.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 5
WINDOW = 4
BANDS = 4
CONTAINMENT = 0.8
MOST = 20_000

# Texts of public license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "license string, text string")


def held(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for all its uses."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column) -> Column:
    """Hashes of all runs of ``SIZE`` words in order; fewer words are one shingle, none give an empty array."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (SIZE - 1), F.lit(1)))
    return held(words, lambda w: F.when(F.size(w) > 0, F.transform(places(w), lambda i: F.xxhash64(F.slice(w, i, SIZE)))).otherwise(F.array().cast("array<bigint>")))


def _flip(band: int) -> int:
    return random.Random(band).getrandbits(63)


def band_minima(hashes: Column, band: int) -> Column:
    """The min-hash in one band of the window from each place on; the last windows are shorter."""
    least = F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_flip(band))))
    step = 1
    while step < WINDOW:
        least, step = held(least, _with_ahead(step)), 2 * step
    return least


def _with_ahead(step: int):
    """The smaller of each element and the one ``step`` places after it."""
    return lambda v: F.zip_with(v, F.slice(v, F.lit(step + 1), F.greatest(F.size(v), F.lit(1))), lambda x, y: F.least(x, y))


def _among(values: list[int]):
    return lambda x: x.isin(values)


def _keys_among(values: list[int]):
    return lambda p: p["key"].isin(values)


def _placed(way: int):
    return lambda x, i: F.struct(F.lit(way).alias("way"), i.alias("place"), x.alias("key"))


def scan(docs: DataFrame, notices: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, place) of each row of ``docs`` and template whose shingles it holds close together.

    ``containment`` is the largest share around a retrieved place, ``place`` the first shingle retrieved there. Null, empty and wordless
    texts hold nothing, nor do such templates count. Rows with equal ids are told apart; repeated rows give repeated results. ``notices`` has
    ``license`` and ``text``, one row a license; other columns are left behind.
    """
    spark = docs.sparkSession
    known = templates(spark) if notices is None else notices
    prepared = known.select(F.col("license").cast("string").alias("license"), shingles(F.col("text")).alias("own")).where(F.size("own") > 0).distinct()
    minima = [band_minima(F.col("own"), b) for b in range(BANDS)]
    whole = F.greatest(F.size("own") - (WINDOW - 1), F.lit(1))
    keyed = prepared.select(
        "license",
        F.array_distinct("own").alias("own"),
        F.when(F.size("own") < WINDOW, F.col("own")).otherwise(F.array().cast("array<bigint>")).alias("short"),
        *(F.when(F.size("own") >= WINDOW, F.slice(m, F.lit(1), whole)).otherwise(F.array().cast("array<bigint>")).alias(f"band{b}") for b, m in enumerate(minima)),
    )
    rows = keyed.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} templates; scan them in parts")
    ways = [("short", F.col("hashes"))] + [(f"band{b}", band_minima(F.col("hashes"), b)) for b in range(BANDS)]
    keys = {name: sorted({value for row in rows for value in row[name]}) for name, _ in ways}
    table = spark.createDataFrame(
        [(number, key, row["license"], row["own"]) for row in rows for number, (name, _) in enumerate(ways) for key in sorted(set(row[name]))],
        "way int, key long, license string, own array<long>",
    )
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), shingles(F.col(text_col)).alias("hashes"))
    # A min-hash is one shingle's hash, flipped: a text without any of the shingles behind the keys agrees in no band.
    behind = sorted({*keys["short"], *(key ^ _flip(b) for b in range(BANDS) for key in keys[f"band{b}"])})
    hit, places = F.exists("hashes", _among(behind)) if behind else F.lit(False), [F.array().cast("array<struct<way:int,place:int,key:bigint>>")]
    for number, (name, values) in enumerate(ways):
        if keys[name]:
            places.append(F.filter(F.transform(values, _placed(number)), _keys_among(keys[name])))
    retrieved = texts.where(hit).select("row", "doc_id", "hashes", F.explode(F.concat(*places)).alias("p")).select("row", "doc_id", "hashes", "p.*")
    found = retrieved.join(F.broadcast(table), ["way", "key"])  # the windows of at most MOST templates
    first = F.greatest(F.col("place") - F.size("own") + 1, F.lit(0))
    around = F.slice("hashes", first + 1, F.lit(2) * F.size("own") + WINDOW)
    share = F.size(F.array_intersect("own", around)) / F.size("own")
    scored = found.select("row", "doc_id", "license", share.alias("share"), "place").where(F.col("share") >= containment)
    best = scored.groupBy("row", "doc_id", "license").agg(F.max(F.struct("share", (-F.col("place")).alias("early"))).alias("best"))
    return best.select("doc_id", "license", F.col("best.share").alias("containment"), (-F.col("best.early")).alias("place"))
