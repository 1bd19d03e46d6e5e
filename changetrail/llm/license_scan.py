"""License scans: MinHash bands over overlapping windows retrieve templates, containment decides.

A template is the normal form (lower case, letters and digits only) of a licence notice, as the set
of its five-word shingles; a notice with fewer words is one shingle. A text is read in windows of
each template length, with half as many words more, so that every occurrence lies whole in some
window, starting every quarter of a template. A window that holds the whole notice has a Jaccard similarity of at
least ``LEAST_JACCARD`` with it, and one with the least containment still ``LEAST_CONTAINMENT`` times
that; with one MinHash value per band, the bands needed for a collision probability of ``COLLISION``
follow from it. Windows and templates that share a band are compared: shingles of the template in
the window, over those of the template. Containments of ``LEAST_CONTAINMENT`` or more are matches, the
best window of a template in a text being its place.

No window can match unless it holds an anchor: for each template a word, or several, so that its
shingles without any of them would not be enough. Long words serve, which few other texts have. A text is cut to windows of those template
lengths only of which it has an anchor; this skips no match. Where the text of one template makes a
match of another too (versions of one header), only the one held the most stays at that place. The
templates are a fixed list; everything is DataFrame functions.

Results: null and empty texts have no match; a text with several notices has several; a notice
repeated in a text counts once; repeated rows are scanned alike; an empty table gives an empty table;
without templates nothing matches; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices by the names under which licences are listed. Titles, standard headers and
# sentences of the texts have entries of their own; none is part of another.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "MIT-body": (
        "to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so"),
    "Apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0"),
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version."),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."),
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation; either version "
        "2.1 of the License, or (at your option) any later version."),
    "LGPL-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version."),
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version."),
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "BSD-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer."),
    "BSD-3-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies."),
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    "EPL-1.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0 which accompanies this distribution, and is available at "
        "http://www.eclipse.org/legal/epl-v10.html"),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-body": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means."),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of "
        "the software and accompanying documentation covered by this license"),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software."),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring "
        "rights to this work."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-deed": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-deed": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0-deed": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International "
        "License."),
    "CC-BY-NC-4.0-deed": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
        "License."),
    "CC-BY-NC-SA-4.0-deed": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
        "International License."),
    "CC-BY-NC-ND-4.0-deed": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
        "International License."),
}

WORDS = 5
LEAST_CONTAINMENT = 0.75
COLLISION = 0.9999
LEAST_ANCHOR = 6  # letters
NORMAL = r"[^\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_words(notice: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", notice.lower()) if w]


def shingle_texts(notice: str) -> list[str]:
    words = normal_words(notice)
    if not words:
        return []
    return sorted({" ".join(words[i:i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))})


def anchors(notice: str) -> list[str]:
    """Words of which every sufficient subset of the notice's shingles contains at least one: the
    longest that does alone, or several that do together, those in most shingles first. Short words
    are in any text, so they are taken only where the others are not enough."""
    parts = [set(s.split()) for s in shingle_texts(notice)]
    need = math.ceil(LEAST_CONTAINMENT * len(parts) - 1e-9)
    longest = sorted(set().union(*parts), key=lambda w: (len(w), w), reverse=True)
    telling = [word for word in longest if len(word) >= LEAST_ANCHOR]
    for word in telling:
        if sum(word not in p for p in parts) < need:
            return [word]
    chosen: list[str] = []
    while len(rest := [p for p in parts if p.isdisjoint(chosen)]) >= need:
        useful = [word for word in telling if any(word in p for p in rest)] or longest
        chosen.append(max(useful, key=lambda word: (sum(word in p for p in rest), len(word), word)))
    return chosen


def rivals(notices: dict[str, str]) -> list[str]:
    """Pairs ``a|b`` of templates where the text of b alone makes a match of a."""
    own = {name: set(shingle_texts(notice)) for name, notice in notices.items()}
    return [f"{a}|{b}" for a in own for b in own
            if a != b and len(own[a] & own[b]) >= LEAST_CONTAINMENT * len(own[a]) - 1e-9]


def window_words(n_words: int) -> tuple[int, int]:
    """Length and step of the windows for templates of ``n_words`` words."""
    step = max(1, n_words // 4)
    return n_words + max(step, n_words // 2), step


def bands_needed(n_words: int) -> int:
    """Bands of one value that reach COLLISION for a window of the least containment."""
    size = max(1, n_words - WORDS + 1)
    window = max(1, window_words(n_words)[0] - WORDS + 1)
    kept = math.ceil(LEAST_CONTAINMENT * size - 1e-9)
    jaccard = kept / (size + window - kept)
    return 1 if jaccard >= 1 else math.ceil(math.log(1 - COLLISION) / math.log(1 - jaccard))


def shingle_hashes(words: Column) -> Column:
    """Hashes of all shingles of an array of words, in order."""
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - WORDS + 1, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(WORDS)), " ")))


def sketch(hashes: Column, bands: int) -> Column:
    """The least re-hashed value of a set of hashes for each band."""
    return F.transform(F.array(*[F.lit(b) for b in range(bands)]), lambda b: F.array_min(
        F.transform(hashes, lambda h: F.xxhash64(h, b))))


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Per input row ``key, n_licenses, licenses`` (names, joined by commas) and ``matches``: an
    array of (name, containment, word), word being where the window begins, from 0."""
    notices = {name: notice for name, notice in notices.items() if shingle_texts(notice)}
    empty = F.array().cast("array<struct<name:string,containment:double,word:int>>")
    body = F.coalesce(F.col(text), F.lit(""))
    if not notices:
        found = empty
    else:
        values = template_values(docs.sparkSession, notices)
        any_of = lambda names: F.lower(body).rlike("|".join(sorted(
            {re.escape(word) for name in names for word in anchors(notices[name])})))
        words = F.filter(F.split(F.lower(body), NORMAL), lambda w: w != "")
        has_any = lambda w, names: F.arrays_overlap(w, F.array(*map(F.lit, sorted(
            {word for name in names for word in anchors(notices[name])}))))
        by_length: dict[int, list[str]] = {}
        for name, notice in notices.items():
            by_length.setdefault(len(normal_words(notice)), []).append(name)
        parts = lambda w, shingles: F.concat(*[
            F.when(has_any(w, names), matches_of_length(shingles, n, {name: values[name] for name in names}))
            .otherwise(empty) for n, names in sorted(by_length.items())])
        pairs = rivals(notices)
        reach = window_words(max(by_length))[0]
        # Of rival templates at one place the one that is held the most.
        stronger = lambda x, y: (
            F.array_contains(F.array(*map(F.lit, pairs)), F.concat(x["name"], F.lit("|"), y["name"]))
            & (y["containment"] > x["containment"]) & (F.abs(y["word"] - x["word"]) < reach))
        every = let(words, lambda w: let(shingle_hashes(w), lambda shingles: parts(w, shingles)))
        if pairs:
            every = let(every, lambda m: F.filter(m, lambda x: ~F.exists(m, lambda y: stronger(x, y))))
        # Of each template the best window, the first of equal ones.
        best = let(every, lambda m: F.array_sort(F.filter(m, lambda x: ~F.exists(m, lambda y: (
            y["name"] == x["name"]) & ((y["containment"] > x["containment"]) | (
                (y["containment"] == x["containment"]) & (y["word"] < x["word"])))))))
        found = F.when(any_of(notices), best).otherwise(empty)
    scanned = docs.select(F.col(key), found.alias("matches"))
    return scanned.select(key, F.size("matches").cast("long").alias("n_licenses"),
                          F.array_join(F.transform("matches", lambda x: x["name"]), ",").alias("licenses"),
                          "matches")


def template_values(spark: SparkSession, notices: dict[str, str]) -> dict[str, tuple[list[int], list[int]]]:
    """Of every template the hashes of its shingles and its sketch."""
    hashes = lambda notice: F.array(*[F.xxhash64(F.lit(s)) for s in shingle_texts(notice)])
    row = spark.range(1).select(*[F.struct(
        hashes(notice).alias("own"), sketch(hashes(notice), bands_needed(len(normal_words(notice)))).alias("bands")
    ).alias(f"t{i}") for i, notice in enumerate(notices.values())]).first()
    return {name: (row[i]["own"], row[i]["bands"]) for i, name in enumerate(notices)}


def longs(values: list[int]) -> Column:
    return F.array(*[F.lit(value).cast("long") for value in values])


def matches_of_length(shingles: Column, n_words: int, templates: dict[str, tuple[list[int], list[int]]]) -> Column:
    """Matches of templates of one length in the windows of a text's shingles."""
    length, step = window_words(n_words)
    span, bands = max(1, length - WORDS + 1), bands_needed(n_words)
    windows = F.transform(
        F.when(F.size(shingles) > 0, F.sequence(F.lit(0), F.size(shingles) - 1, F.lit(step)))
        .otherwise(F.array().cast("array<int>")),
        lambda at: F.struct(at.alias("word"), F.slice(shingles, at + 1, F.lit(span)).alias("hashes")))
    sketched = F.transform(windows, lambda w: F.struct(
        w["word"].alias("word"), w["hashes"].alias("hashes"), sketch(w["hashes"], bands).alias("bands")))

    def of_template(name: str, hashes: list[int], own_bands: list[int]):
        own = longs(hashes)

        def matched(all_windows: Column) -> Column:
            hit = F.filter(all_windows, lambda w: F.exists(
                F.zip_with(w["bands"], longs(own_bands), lambda a, b: a == b), lambda same: same))
            scored = F.transform(hit, lambda w: F.struct(
                F.lit(name).alias("name"),
                (F.size(F.array_intersect(w["hashes"], own)) / F.lit(float(len(hashes)))).alias("containment"),
                w["word"].alias("word")))
            return F.filter(scored, lambda x: x["containment"] >= LEAST_CONTAINMENT)

        return matched

    return let(sketched, lambda w: F.concat(*[of_template(name, *values)(w)
                                              for name, values in templates.items()]))
