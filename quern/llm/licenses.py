"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment verifies.

DataFrame operations only. A window is WINDOW consecutive words of a text, at every word; its MinHash values are the
smallest of its shingles' hashes under BANDS seeds, and each value is a band of its own. A full copy of a template shares
whole windows with it, which collide in every band; a shingle that stands alone between other words is the smallest of
one of its windows with a chance of over 1/3 a band, so 20 bands miss it with less than 1 in 3,000.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

SHINGLE, WINDOW, BANDS = 5, 8, 20
#: A template is found if at least this share of its shingles occurs.
CONTAINED = 0.8

#: Wording of public licenses and of the notices that name them.
TEMPLATES = {
    "AGPL-notice": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "AGPL-3.0-text": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "Apache-2.0-text": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",),
    "Artistic-text": ("The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package",),
    "Apache-2.0-notice": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-4.0-notice": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0-notice": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "CC-BY-NC-SA-4.0-notice": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",),
    "CC-BY-ND-4.0-notice": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",),
    "CC-BY-SA-4.0-notice": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "GFDL-1.3-text": ("GNU Free Documentation License Version 1.3, 3 November 2008",),
    "GPL-2.0-text": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL-3.0-text": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.0-text": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "LGPL-2.1-text": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "LGPL-3.0-text": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "GPL-notice": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-notice": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "MIT": ("Released under the MIT License.",),
    "MIT-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",),
    "MIT-text": ("including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "MIT-notice": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "MPL-1.1-text": ("MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions.",),
    "MPL-2.0-text": ("Mozilla Public License Version 2.0 1. Definitions",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
}
#: Licenses whose wordings share most of their shingles: of those of one family found in a document, the ones of the highest containment count.
FAMILIES = {
    "AGPL-3.0-text": "GNU text", "GPL-2.0-text": "GNU text", "GPL-3.0-text": "GNU text", "LGPL-2.0-text": "GNU text", "LGPL-2.1-text": "GNU text", "LGPL-3.0-text": "GNU text",
    "AGPL-notice": "GNU notice", "GPL-notice": "GNU notice", "LGPL-notice": "GNU notice", "GPL-2.0": "GPL", "GPL-3.0": "GPL",
    "CC-BY-4.0-notice": "CC notice", "CC-BY-NC-4.0-notice": "CC notice", "CC-BY-NC-SA-4.0-notice": "CC notice", "CC-BY-ND-4.0-notice": "CC notice", "CC-BY-SA-4.0-notice": "CC notice",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK, _DROPPED = "\t\n\x0b\x0c\r", ".,;:!?\"'()[]*#/"
#: Comment marks and underlines that are words once the others are dropped.
_MARKS = ("-", "--", "---------------", "==================================")
#: Fixed: how a file names its license by an identifier of the public list.
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)"


def normal_words(text):
    """Words of a text column: A-Z lower-cased, punctuation and comment marks dropped, split at white space."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), _UPPER + _BLANK + _DROPPED, _LOWER + " " * len(_BLANK)))
    words = F.split(plain, " +")
    for mark in _MARKS:
        words = F.array_remove(words, mark)
    return words


#: Words beside a shingle that its windows reach to.
BESIDE = WINDOW - SHINGLE


def _around(df: DataFrame, key: str) -> DataFrame:
    """A row for each shingle: its words as c3.. with as many before and after as its windows reach to, null past the text's ends."""
    padded = F.concat(F.array_repeat(F.lit(None).cast("string"), BESIDE), F.col("words"))
    size = F.size("words") + BESIDE
    shifted = [F.when(size > k, F.slice(padded, k + 1, size)).otherwise(F.array().cast("array<string>")).alias(f"c{k}") for k in range(SHINGLE + 2 * BESIDE)]
    return df.select(key, F.inline(F.arrays_zip(*shifted))).where(F.col(f"c{BESIDE}").isNotNull() & F.col(f"c{BESIDE + SHINGLE - 1}").isNotNull())


def _hash(start: int):
    """The shingle that starts at this column, as a hash; null where the text doesn't hold it whole."""
    cols = [F.col(f"c{start + j}") for j in range(SHINGLE)]
    return F.when(cols[0].isNotNull() & cols[-1].isNotNull(), F.xxhash64(*cols))


def _windows(around: DataFrame, key: str) -> DataFrame:
    """A row for each window that holds the shingle: its shingles' hashes h0.. (null past the end) and the shingles as text."""
    text = lambda k: F.when(F.col(f"c{k}").isNotNull() & F.col(f"c{k + SHINGLE - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"c{k + j}") for j in range(SHINGLE)]))
    one = lambda k: F.struct(_hash(k).alias("h"), text(k).alias("s"))
    starts = range(BESIDE + 1)
    windows = F.array(*[F.when(F.col(f"c{k}").isNotNull(), F.array(*[one(k + i) for i in range(BESIDE + 1)])) for k in starts])
    d = around.select(key, F.explode(windows).alias("w")).where(F.col("w").isNotNull())
    return d.select(key, "w", *[F.col("w")[i]["h"].alias(f"h{i}") for i in starts])


def _bands() -> list:
    """BANDS MinHash values of the window from its shingles h0..: each seed flips other bits before they are hashed again."""
    out = []
    for b in range(BANDS):
        factor = (0x9E3779B97F4A7C15 * (2 * b + 1) + 2 * b * 0xD1B54A32D192ED03) & (2**64 - 1) | 1
        factor = factor - 2**64 if factor >= 2**63 else factor
        out.append(F.least(*[F.when(F.col(f"h{i}").isNotNull(), F.xxhash64(F.col(f"h{i}").bitwiseXOR(F.lit(factor)))) for i in range(BESIDE + 1)]))
    return out


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    rows = [(name, " ".join(lines)) for name, lines in templates.items()]
    return spark.createDataFrame(rows, "license string, text string").select("license", normal_words(F.col("text")).alias("words"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, contained: float = CONTAINED, families: dict[str, str] = FAMILIES) -> DataFrame:
    """(id, license, matched, total, containment) for each document and template found in it; of a family only those of the highest containment. An
    identifier line is a license of its own, SPDX- and the identifier, found whole.

    Templates of one family that are equally contained are all kept. Only the fixed list of templates is broadcast. Null and empty texts and those of fewer than 5 words hold nothing;
    rows that repeat an id count as one document; a null id is an id of its own; an empty table gives none.
    """
    spark = docs.sparkSession
    whole = _around(template_table(spark, templates), "license")
    known = _windows(whole, "license").select("license", F.array(*_bands()).alias("bands")).distinct().collect()  # of the fixed templates
    shingles = whole.select("license", _hash(BESIDE).alias("h"), F.concat_ws(" ", *[F.col(f"c{BESIDE + j}") for j in range(SHINGLE)]).alias("shingle")).distinct().collect()
    d = docs.select(F.col(id_col).alias("id"), normal_words(F.col(text_col)).alias("words"))
    # A window can collide in a band only if its smallest shingle is one of a template's, so windows without any needn't be hashed again.
    near = stash(_around(d, "id").where(_hash(BESIDE).isin(sorted({r["h"] for r in shingles}))), "near")
    table = spark.createDataFrame(sorted({(b, v, r["license"]) for r in known for b, v in enumerate(r["bands"])}), "band int, value long, license string")
    bands = _windows(near, "id").select("id", "w", F.posexplode(F.array(*_bands())).alias("band", "value"))
    found = bands.join(F.broadcast(table), ["band", "value"]).select("id", "license", F.explode("w.s").alias("shingle")).where(F.col("shingle").isNotNull()).distinct()
    sizes = Counter(r["license"] for r in shingles)
    exact = spark.createDataFrame([(r["license"], r["shingle"], sizes[r["license"]]) for r in shingles], "license string, shingle string, total long")
    matched = found.join(F.broadcast(exact), ["license", "shingle"]).groupBy("id", "license").agg(F.count("*").alias("matched"), F.first("total").alias("total"))
    out = matched.withColumn("containment", F.col("matched") / F.col("total")).where(F.col("containment") >= contained)
    family = F.col("license")
    for name, of in families.items():
        family = F.when(F.col("license") == name, of).otherwise(family)
    # a window holds the templates of one family that one document has
    out = out.withColumn("best", F.max("containment").over(Window.partitionBy("id", family))).where(F.col("containment") == F.col("best"))
    tags = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(TAG), 1)).alias("tag")).distinct()
    one = F.lit(1).cast("long")
    tagged = tags.select("id", F.concat(F.lit("SPDX-"), "tag").alias("license"), one.alias("matched"), one.alias("total"), F.lit(1.0).alias("containment"))
    return out.select("id", "license", "matched", "total", "containment").unionAll(tagged).withColumnRenamed("id", id_col)
