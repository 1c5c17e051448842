"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Texts and templates are lower-cased, spelt alike ("licence", "released under") and cut into words of letters
and digits, so that line breaks, comment marks and quotes are nothing. A template is a set of n word bigrams.
It is compared with windows of a text: of a window with w distinct bigrams, c of them the template's, the
coefficient is 2c / (w + n). For a threshold t it can only be reached if the smaller set has at least
t / (2 - t) times the elements of the larger. Those size bounds prune

- templates: a text with fewer of a template's distinct bigrams than the least is not compared with it;
- windows: w lies within both bounds, and a window has at most twice as many places as the template.

Windows begin where a run of the template's bigrams begins (for templates of more than ``EXACT`` bigrams, a run
of at least ``SEED``) and end anywhere. A best window always begins and ends with a run, as a foreign bigram at
its end only lowers the coefficient and one more of the template's raises it; so up to ``EXACT`` bigrams no
window is left out. A hit is a template's likest window that reaches the threshold (ties: the first, then the
shortest). Of two hits, the less likely one (ties: the smaller, then the later in name) goes if the other covers
at least half of its words: versions and wordings of one licence do not all count for the same lines.

The whole scan is a chain of projections: no row is exploded, joined or shuffled, and the templates (a short
fixed list) are literals in the plan, looked up as hash sets.

Nulls: a null or blank text has no hits; so has a text of a single word. Long texts are scanned whole. Repeated
rows give repeated results, null ids are as any other. An empty table gives an empty result. The caller's
columns are kept, whatever their names, but for one named ``license_hits``, which the scan's takes the place of.
"""

from __future__ import annotations

import re
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespar.llm._shared import let, own

THRESHOLD = 0.8
#: Largest template whose windows begin at any of its bigrams; the run that windows of larger ones begin with.
EXACT, SEED = 64, 4

_TOKEN = r"[\p{L}\p{N}]+"
#: Other words for "licensed", before "under".
VERBS = "released|distributed|published|available"

#: How licences are named in notices ("Licensed under ...").
NAMES = {
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "EPL-2.0": ["the Eclipse Public License 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3"],
    "ISC": ["the ISC License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
}
#: Creative Commons licences by their parts.
_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
for _code in ("BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA"):
    NAMES[f"CC-{_code}-4.0"] = [f"CC {_code} 4.0", f"a Creative Commons {'-'.join(_PARTS[p] for p in _code.split('-'))} 4.0 International License"]

#: The GNU licences' own notice, by the licence's name, version and what it covers.
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_COVERED = {"AGPL-3.0": ("program", "Affero General Public License", "3"), "GPL-2.0": ("program", "General Public License", "2"), "GPL-3.0": ("program", "General Public License", "3"), "LGPL-2.1": ("library", "Lesser General Public License", "2.1"), "LGPL-3.0": ("library", "Lesser General Public License", "3")}
#: Headers and opening sentences as published by the licences' stewards.
HEADERS = {
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
} | {f"{name}-header": _GNU.format(*of) for name, of in _COVERED.items()}
#: Whole licence texts (the folder ``licenses``, with no one's copyright line).
FULL_TEXTS = {f"{p.stem}-text": re.sub(r"(?m)^Copyright \(c\).*$", "", p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
#: The two-clause licence is the other without its third clause.
FULL_TEXTS["BSD-2-Clause-text"] = re.sub(r"(?s)\n3\. .*?\n\n", "\n", FULL_TEXTS["BSD-3-Clause-text"])
#: (name, text) of every template.
TEMPLATES = sorted([(n, f"Licensed under {x}") for n, names in NAMES.items() for x in names] + [*HEADERS.items(), *FULL_TEXTS.items()])


class Template(NamedTuple):
    """A template's bigrams, and the bounds of its windows: distinct bigrams, places, and the first run."""

    name: str
    bigrams: list[str]
    least: int
    most: int
    span: int
    seed: int


def template_words(text: str) -> list[str]:
    text = text.lower().replace("licence", "license")
    return re.findall(r"[^\W_]+", re.sub(rf"(?:{VERBS})([\W_]+under)", r"licensed\1", text))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a set that can reach the threshold with a set of ``n``."""
    least = next(m for m in range(1, n + 1) if 2 * m >= threshold * (n + m) - 1e-9)
    most = n
    while 2 * n >= threshold * (n + most + 1) - 1e-9:
        most += 1
    return least, most


def prepared(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[Template]:
    found = []
    for name, text in templates:
        words = template_words(text)
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
        if pairs:
            found.append(Template(name, pairs, *bounds(len(pairs), threshold), 2 * (len(words) - 1), 1 if len(pairs) <= EXACT else SEED))
    return found


def words(text: Column) -> Column:
    text = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("licence"), F.lit("license"))
    return F.regexp_extract_all(F.regexp_replace(text, rf"(?:{VERBS})([^\p{{L}}\p{{N}}]+under)", "licensed$1"), F.lit(_TOKEN), 0)


def _is_one_of(x: str, items: list[str]) -> str:
    return f"{x} IN ({', '.join(repr(i) for i in items)})"


def _previous(b: Column) -> Column:
    """For each place, the last place before it with the same bigram, or -1."""
    ordered = F.sort_array(F.transform(b, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def before(o: Column) -> Column:
        at = F.transform(o, lambda y, j: F.struct(y["i"].alias("i"), F.when((j > 0) & (F.get(o, j - 1)["x"] == y["x"]), F.get(o, j - 1)["i"]).otherwise(-1).alias("p")))
        return F.transform(F.sort_array(at), lambda y: y["p"])

    return let(ordered, before)


def _best(places: Column, codes: Column, t: Column, threshold: float) -> Column:
    """struct<dice, back, short> of the likest window. ``codes`` has for each place of the text twice its previous
    place, and one more if its bigram is the template's; ``places`` are the latter."""
    near = lambda k: F.get(places, k + t["least"] - 1) - F.get(places, k) < t["span"]
    opens = lambda k: (k == 0) | (F.get(places, k - 1) < F.get(places, k) - 1)
    runs = lambda k: F.get(places, k + t["seed"] - 1) == F.get(places, k) + t["seed"] - 1
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.size(places) - t["least"]), lambda k: opens(k) & near(k) & runs(k)), lambda k: F.get(places, k))
    zero = F.lit(0)

    def from_start(s: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            new = F.when(F.shiftright(c, 1) < s, 1).otherwise(0)
            now = F.struct((acc["at"] + 1).alias("at"), (acc["w"] + new).alias("w"), (acc["c"] + new * c.bitwiseAND(F.lit(1))).alias("c"))

            def better(n: Column) -> Column:
                dice = F.when(n["w"].between(t["least"], t["most"]), n["c"] * 2.0 / (n["w"] + t["n"])).otherwise(0.0)
                best = F.struct(dice.alias("dice"), n["at"].alias("size"))
                return F.struct(n["at"].alias("at"), n["w"].alias("w"), n["c"].alias("c"), F.when(dice > acc["best"]["dice"], best).otherwise(acc["best"]).alias("best"))

            return let(now, better)

        start = F.struct(zero.alias("at"), zero.alias("w"), zero.alias("c"), F.struct(F.lit(0.0).alias("dice"), zero.alias("size")).alias("best"))
        found = F.aggregate(F.slice(codes, s + 1, t["span"]), start, step)["best"]
        return F.struct(found["dice"].alias("dice"), (-s).alias("back"), found["size"].alias("size"))

    best = F.array_max(F.transform(starts, from_start))
    return F.when((F.size(places) >= t["least"]) & (best["dice"] >= threshold), best)


def _flags(places: Column, size: Column) -> Column:
    """An array of 1 at the (ascending) places and 0 elsewhere."""
    after = F.transform(places, lambda x, k: F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.coalesce(F.get(places, k + 1), size) - x - 1)))
    return F.concat(F.array_repeat(F.lit(0), F.get(places, 0)), F.flatten(after))


def _unhidden(hits: Column) -> Column:
    """The hits, without those that a likelier one covers by half, in the order of the text."""
    rank = lambda h: F.struct(h["dice"], h["size"], -h["k"])
    end = lambda h: h["first_word"] + h["n_words"]
    covers = lambda g, h: (F.least(end(g), end(h)) - F.greatest(g["first_word"], h["first_word"])) * 2 >= h["n_words"]
    kept = F.filter(hits, lambda h: ~F.exists(hits, lambda g: (rank(g) > rank(h)) & covers(g, h)))
    return F.array_sort(kept, lambda a, b: F.when(a["first_word"] != b["first_word"], a["first_word"] - b["first_word"]).otherwise(a["k"] - b["k"]))


_HIT = "array<struct<license:string,dice:double,first_word:int,n_words:int,size:int,k:int>>"


def _with_hits(rows: DataFrame, hits: Column) -> DataFrame:
    """The caller's columns (the struct ``_row``) and the hits, whatever the names of the former."""
    return rows.select(F.col("_row").withField("license_hits", hits.cast(_HIT)).alias("_row")).select("_row.*")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with ``license_hits``, array<struct<license, dice, first_word, n_words, size, k>> by first word:
    a template's name, its likest window's coefficient and place, its number of bigrams and its own number."""
    of = prepared(TEMPLATES if templates is None else templates, threshold)
    rows = docs.select(F.struct(*own(docs, "license_hits")).alias("_row"), words(F.col("text")).alias("_w"))
    rows = rows.select("_row", F.expr("transform(_w, (x, i) -> concat_ws(' ', x, get(_w, i + 1)))").alias("_b"))
    known = sorted(set().union(*(t.bigrams for t in of)))
    if not known:
        return _with_hits(rows, F.array())
    # Places of any template's bigrams; most texts have too few for any.
    rows = rows.select("_row", "_b", F.expr(f"filter(sequence(0, size(_b) - 1), i -> size(_b) > 1 AND {_is_one_of('_b[i]', known)})").alias("_m"))

    def against(k: int, t: Template) -> str:
        places = f"filter(_m, i -> {_is_one_of('get(_b, i)', t.bigrams)})"
        fields = f"'k', {k}, 'n', {len(t.bigrams)}, 'least', {t.least}, 'most', {t.most}, 'span', {t.span}, 'seed', {t.seed}, 'places', p"
        return f"get(transform(array({places}), p -> CASE WHEN size(array_distinct(transform(p, i -> get(_b, i)))) >= {t.least} THEN named_struct({fields}) END), 0)"

    least = min(t.least for t in of)
    every = ", ".join(against(k, t) for k, t in enumerate(of))
    rows = rows.select("_row", "_b", F.expr(f"CASE WHEN size(_m) >= {least} THEN filter(array({every}), t -> t IS NOT NULL) END").alias("_t"))
    names = F.array(*[F.lit(t.name) for t in of])

    def hits(previous: Column) -> Column:
        def one(t: Column) -> Column:
            codes = F.zip_with(previous, _flags(t["places"], F.size(previous)), lambda p, flag: p * 2 + flag)
            best = lambda c: _best(t["places"], c, t, threshold)
            return let(let(codes, best), lambda w: F.when(w.isNotNull(), F.struct(F.get(names, t["k"]).alias("license"), w["dice"].alias("dice"), (-w["back"]).alias("first_word"), (w["size"] + 1).alias("n_words"), t["n"].alias("size"), t["k"].alias("k"))))

        return F.filter(F.transform(F.col("_t"), one), lambda h: h.isNotNull())

    found = F.when(F.size("_t") > 0, let(_previous(F.col("_b")), hits))
    return _with_hits(rows.select("_row", found.alias("_h")), F.coalesce(_unhidden(F.col("_h")), F.array()))


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_hits, licenses (names, joined), best_dice, and place and length in words of the likest hit."""
    h = F.col("license_hits")
    best = F.array_max(F.transform(h, lambda x: F.struct(x["dice"], (-x["first_word"]).alias("back"), x["n_words"].alias("n"))))
    return scanned.select(
        "doc_id",
        F.size(h).cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(h["license"])), ",").alias("licenses"),
        F.coalesce(best["dice"], F.lit(0.0)).alias("best_dice"),
        (-best["back"]).cast("long").alias("first_word"),
        best["n"].cast("long").alias("hit_words"),
    )
