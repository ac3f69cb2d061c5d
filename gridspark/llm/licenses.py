"""Licence scans: passages compared to licence templates by Dice's coefficient over word bigrams."""

from __future__ import annotations

import bisect
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common licence notices. Close relatives stand beside each other, so that the right one scores best.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without permission.",
    "Apache-1.0": "Licensed under the Apache License, Version 1.0.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "Apache-1.1-header": "Licensed under the Apache License, Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-notice": "Released under the Apache License 2.0.",
    "MIT-licensed": "Licensed under the MIT License.",
    "ISC-notice": "Released under the ISC License.",
    "ISC-licensed": "Licensed under the ISC License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "BSD-4-Clause": "Licensed under the BSD 4-Clause License.",
    "BSD-4-Clause-notice": "Released under the BSD 4-Clause License.",
    "GPL-1.0": "This work is licensed under the GNU General Public License, version 1.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.0": "This work is licensed under the GNU Library General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "EPL-1.0-notice": "This work is licensed under the Eclipse Public License, version 1.0.",
    "EPL-2.0-notice": "This work is licensed under the Eclipse Public License, version 2.0.",
    "MPL-1.1-notice": "This work is licensed under the Mozilla Public License, version 1.1.",
    "MPL-2.0-notice": "This work is licensed under the Mozilla Public License, version 2.0.",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0 only (the \"License\"). You may not use this file except in compliance with the License.",
    "CDDL-1.1": "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.1 only (the \"License\"). You may not use this file except in compliance with the License.",
    "CDDL": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
    "CDDL-1.0-notice": "This work is licensed under the Common Development and Distribution License, version 1.0.",
    "CDDL-1.1-notice": "This work is licensed under the Common Development and Distribution License, version 1.1.",
}
_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    for _version, _area in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        _name, _long = f"CC-{_kind}-{_version}", "-".join(_PARTS[p] for p in _kind.split("-"))
        TEMPLATES.setdefault(_name if _name != "CC-BY-4.0" else "CC-BY-4.0-short", f"Licensed under CC {_kind} {_version}.")
        if _name != "CC-BY-4.0":
            TEMPLATES[f"{_name}-long"] = f"This work is licensed under a Creative Commons {_long} {_version} {_area} License."

FULL = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "CC-BY-4.0", "CC0-1.0", "CDDL-1.0", "EPL-2.0", "GPL-1.0",
        "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense")

WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, license string, dice double, start_word int, n_words int"


def normalised(text: str) -> list[str]:
    """Lower-case words of letters and digits, British spelling of the noun made American."""
    return [w.replace("licence", "license") for w in WORD.findall(text.lower())]


def bounds(n: int, least: float) -> tuple[int, int]:
    """Numbers of bigrams a passage may have to reach ``least`` against a template with ``n``.

    Dice is at most 2 * min(a, n) / (a + n).
    """
    return int(np.ceil(n * least / (2 - least) - 1e-9)), int(np.floor(n * (2 - least) / least + 1e-9))


def all_templates() -> dict[str, str]:
    """All templates: the notices, and the full texts as ``NAME-text``."""
    full = {f"{n}-text": pkgutil.get_data("gridspark.llm", f"license_texts/{n}.txt").decode() for n in FULL}
    return TEMPLATES | full


#: Bigrams from which a template is a file header, and from which a full text.  These go before the notices they contain.
LONG = (20, 100)


class Scanner:
    """Templates by bigram; windows of a text are scored only between bigrams a template has."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least, self.names = least, list(templates)
        lists = [normalised(t) for t in templates.values()]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for words in lists for w in words))}
        self.width = len(self.ids)
        grams = [Counter(self.codes(words).tolist()) for words in lists]
        self.sizes = [sum(g.values()) for g in grams]
        self.known = np.unique(np.array([c for g in grams for c in g], dtype=np.int64))
        self.quota = np.zeros((len(self.known), len(grams)), dtype=np.int32)  # how often each template has a bigram
        for k, g in enumerate(grams):
            self.quota[np.searchsorted(self.known, list(g)), k] = list(g.values())
        self.bounds = [bounds(n, least) for n in self.sizes]
        self.need = np.array([max(1, int(np.ceil(least * (low + n) / 2 - 1e-9))) for n, (low, _) in zip(self.sizes, self.bounds)])  # common bigrams at least

    def codes(self, words: list[str]) -> np.ndarray:
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        if len(ids) < 2:
            return np.empty(0, dtype=np.int64)
        return np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * self.width + ids[1:], -1)

    def windows(self, k: int, hits: np.ndarray, place: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """The best window from each hit of template ``k`` that reaches the bound: its Dice, first and last bigram."""
        quota = self.quota[place, k]
        at, place, quota = hits[quota > 0], place[quota > 0], quota[quota > 0]
        # a hit is common to a window unless the template's number of this bigram came before it in the window
        order = np.argsort(place, kind="stable")
        group = place[order]
        past = np.arange(len(order)) - quota[order]
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.where(past >= np.searchsorted(group, group), order[past], -1)
        ends = np.searchsorted(at, at + self.bounds[k][1])
        for first in np.flatnonzero(ends - np.arange(len(at)) >= self.need[k]).tolist():
            end = ends[first]
            dice = 2 * np.cumsum(back[first:end] < first) / (at[first:end] - at[first] + 1 + self.sizes[k])
            last = int(np.argmax(dice))
            if dice[last] >= self.least:
                yield float(dice[last]), int(at[first]), int(at[first + last])

    def matches(self, text: str) -> list[tuple[str, float, int, int]]:
        """Passages like a template: ``(license, dice, first word, words)``; of overlapping ones a full text, then a header, then the best, then the earlier."""
        codes = self.codes(normalised(text))
        hits = np.flatnonzero(codes >= 0)
        place = np.minimum(np.searchsorted(self.known, codes[hits]), len(self.known) - 1)
        own = self.known[place] == codes[hits]
        hits, place = hits[own], place[own]
        kinds, counts = np.unique(place, return_counts=True)
        able = np.minimum(counts[:, None], self.quota[kinds]).sum(axis=0) >= self.need
        found = [(-bisect.bisect(LONG, self.sizes[k]), -dice, s, e, k) for k in np.flatnonzero(able).tolist() for dice, s, e in self.windows(k, hits, place)]
        taken: list[tuple[int, int]] = []
        out = []
        for _, minus, s, e, k in sorted(found):
            i = bisect.bisect(taken, (s, e))
            if (i and taken[i - 1][1] >= s) or (i < len(taken) and taken[i][0] <= e):
                continue
            taken.insert(i, (s, e))
            out.append((self.names[k], -minus, s, e - s + 2))
        return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """Every passage of every whole text that reaches ``least`` against a template, one row each.

    Columns ``doc_id, license, dice, start_word, n_words``.  Missing and empty texts match nothing; repeated rows
    each give their own matches.  Templates are a small fixed table that travels with the task.
    """
    table = dict(templates or all_templates())

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(table, least)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.doc_id, batch.text.fillna("")) for m in scanner.matches(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "dice", "start_word", "n_words"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(find, SCHEMA)
