"""Licence scan: passages of normalised text against licence templates by Dice coefficient over word bigrams.

A passage may lie anywhere: it is a run of words whose first and last bigram are
the template's, cut where stretches of template bigrams begin and end (growing a
passage by a template bigram, or shrinking it by another one, never lowers its
coefficient, so no cut elsewhere does better). Passages over several stretches
have at most the bigrams that the coefficient allows for the template's size.

Two exact tests prune before any passage is made: a text must hold one of the
template's anchor words, a set of words that too few of its bigrams avoid, and
in all as many of the template's bigrams as the smallest match shares. Integers
decide, so a coefficient of exactly the threshold counts. All work is DataFrame
expressions in one pass over the texts, without a shuffle of text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least coefficient, as a fraction.
NUM, DEN = 4, 5

# fixed values: licence notices and texts
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "all-rights-reserved": "All rights reserved.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public License "
        "along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}


def normalize(text: str) -> list[str]:
    """Words of a template: A-Z lower-cased, runs of a-z and 0-9."""
    return re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def template_bigrams(text: str) -> list[str]:
    words = normalize(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, num: int = NUM, den: int = DEN) -> tuple[int, int]:
    """Least and greatest number of bigrams with which a passage can reach the threshold; it shares the least at least."""
    return -(-size * num // (2 * den - num)), size * (2 * den - num) // num


def anchor_words(bigrams: list[str], num: int = NUM, den: int = DEN) -> list[str]:
    """Words such that fewer bigrams than any match must share avoid them all, rare letters first."""
    need = size_bounds(len(bigrams), num, den)[0]
    left, anchors = set(bigrams), []
    while len(left) >= max(need, 1):
        words = sorted({w for b in left for w in b.split(" ")})
        best = max(words, key=lambda w: (len(w) >= 6, sum(w in b.split(" ") for b in left), len(w), w))
        anchors.append(best)
        left = {b for b in left if best not in b.split(" ")}
    return sorted(anchors)


def _bigrams(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), rest, lambda a, b: F.concat_ws(" ", a, b))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _best_passage(grams: Column, here: Column, t: Column, num: int, den: int) -> Column:
    """struct(dice, shared, minus_start, words) of the best passage of a text for template ``t``, null below the threshold.

    ``here`` are the text's distinct bigrams that some template holds.
    """

    def stretches(on: Column) -> Column:
        there = lambda i: F.coalesce(F.get(on, i), F.lit(False))
        places = F.sequence(F.lit(0), F.size(on) - 1)
        first = F.filter(places, lambda i: there(i) & ~there(i - 1))
        last = F.filter(places, lambda i: there(i) & ~there(i + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def passages(found: Column) -> Column:
        def from_here(one: Column, k: Column) -> Column:
            near = F.slice(found, k + 1, t["high"])  # further stretches lie beyond the greatest size
            fits = F.filter(near, lambda x: (x["a"] == one["a"]) | (x["b"] - one["a"] < t["high"]))
            fits = F.filter(fits, lambda x: x["b"] - one["a"] + 1 >= t["low"])
            return F.transform(fits, lambda x: score(one["a"], x["b"] - one["a"] + 1))

        return F.flatten(F.transform(found, from_here))

    def score(start: Column, n: Column) -> Column:
        piece = F.slice(grams, start + 1, n)
        both = F.struct(F.size(F.array_intersect(piece, t["grams"])).alias("s"), (F.size(F.array_distinct(piece)) + t["n"]).alias("d"))
        return _let(both, lambda x: F.when(
            2 * den * x["s"] >= num * x["d"],
            F.struct((2.0 * x["s"] / x["d"]).alias("dice"), x["s"].alias("shared"), (-start).alias("minus_start"), (n + 1).alias("words")),
        ))

    on = F.transform(grams, lambda g: F.array_contains(t["grams"], g))
    best = _let(_let(on, stretches), lambda found: F.array_max(passages(found)))
    return F.when(F.size(F.array_intersect(here, t["grams"])) >= t["low"], best)


def license_matches(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    num: int = NUM,
    den: int = DEN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, licenses (array of struct(license, dice, shared, start, words), best first), best_license.

    A template counts once, with its passage of greatest coefficient (then most
    shared bigrams, then first); start is its first word among the text's words,
    from 0. Licences are ranked by shared bigrams, so a whole notice comes before
    the line it begins with; then by coefficient and name. Null and empty texts
    and texts of one word: no licence. Repeated rows give repeated rows; other
    columns are ignored. Templates of fewer than two words match nothing.
    """
    templates = TEMPLATES if templates is None else templates
    known = [(name, template_bigrams(text)) for name, text in sorted(templates.items())]
    known = [(name, bigrams) for name, bigrams in known if bigrams]
    anchors = sorted({a for _, bigrams in known for a in anchor_words(bigrams, num, den)})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    likely = F.rlike(text, F.lit(r"(?i)(?<![A-Za-z0-9])(" + "|".join(anchors) + r")(?![A-Za-z0-9])")) if known else F.lit(False)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(likely, _bigrams(text)).alias("_grams"))

    every = sorted({b for _, bigrams in known for b in bigrams})
    rows = rows.withColumn("_here", F.array_intersect("_grams", F.lit(every) if every else F.array().cast("array<string>")))

    def literal(name: str, bigrams: list[str]) -> Column:
        low, high = size_bounds(len(bigrams), num, den)
        values = {"license": name, "n": len(bigrams), "low": low, "high": high, "grams": bigrams}
        return F.struct(*(F.lit(v).alias(k) for k, v in values.items()))

    def match(t: Column) -> Column:
        return _let(_best_passage(F.col("_grams"), F.col("_here"), t, num, den), lambda b: F.when(b.isNotNull(), F.struct(
            (-b["shared"]).alias("minus"), (-b["dice"]).alias("lost"), t["license"].alias("license"), (-b["minus_start"]).alias("start"), b["words"].alias("words"),
        )))

    if not known:
        return rows.select("doc_id", F.lit(None).cast(_FOUND).alias("licenses"), F.lit(None).cast("string").alias("best_license"))
    # the size test is _best_passage's condition, so most texts go through no lambda over places
    found = F.filter(F.transform(F.array(*(literal(*x) for x in known)), match), lambda m: m.isNotNull())
    ranked = F.transform(F.sort_array(F.when(F.size("_here") > 0, found)), lambda m: F.struct(
        m["license"].alias("license"), (-m["lost"]).alias("dice"), (-m["minus"]).alias("shared"), m["start"].alias("start"), m["words"].alias("words"),
    ))
    rows = rows.select("doc_id", F.coalesce(ranked, F.array().cast(_FOUND)).alias("licenses"))
    return rows.withColumn("best_license", F.get("licenses", F.lit(0))["license"])


_FOUND = "array<struct<license:string,dice:double,shared:int,start:int,words:int>>"


def dice_sql(table: str = "documents", num: int = NUM, den: int = DEN) -> str:
    """The same result as DuckDB SQL: doc_id, best_license, best_dice, n_licenses, start, words."""
    values = ", ".join(
        f"('{name}', {len(b)}, {size_bounds(len(b), num, den)[0]}, {size_bounds(len(b), num, den)[1]}, {b})"
        for name, b in ((n, template_bigrams(t)) for n, t in sorted(TEMPLATES.items()))
    )
    return f"""
with templates(license, n, low, high, grams) as (values {values}),
known as (select license, low, unnest(grams) as gram from templates),
texts as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as w from {table}),
sets as (select r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as g from texts where len(w) > 1),
placed as (select r, unnest(g) as gram, unnest(range(0, len(g))) as pos from sets),
hits as (select r, license, pos, pos - row_number() over (partition by r, license order by pos) as island
  from placed join known using (gram)),
enough as (select r, license from (select distinct r, license, low, gram from placed join known using (gram))
  group by r, license, low having count(*) >= low),
stretches as (select r, license, min(pos) as a, max(pos) as b from hits semi join enough using (r, license) group by r, license, island),
runs as (select x.r, x.license, x.a, y.b - x.a + 1 as len, t.n, t.grams
  from stretches x join stretches y on x.r = y.r and x.license = y.license and y.a >= x.a join templates t on t.license = x.license
  where (x.a = y.a or y.b - x.a < t.high) and y.b - x.a + 1 >= t.low),
scored as (select r, license, a, len, n, len(list_intersect(list_distinct(g[a + 1 : a + len]), grams)) as s,
  len(list_distinct(g[a + 1 : a + len])) as d from runs join sets using (r)),
good as (select *, 2.0::double * s / (d + n) as dice from scored where {2 * den} * s >= {num} * (d + n)),
best as (select * from good qualify row_number() over (partition by r, license order by dice desc, s desc, a, len desc) = 1),
top as (select *, count(*) over (partition by r) as n_licenses from best
  qualify row_number() over (partition by r order by s desc, dice desc, license) = 1)
select doc_id, license as best_license, round(dice, 9) as best_dice, coalesce(n_licenses, 0) as n_licenses, a as start, len + 1 as words
from texts left join top using (r)
"""
