"""Licence scan by canonical digests, in SQL functions only.

A text is made canonical line by line: lower case, equivalent spellings unified,
punctuation and white space reduced to single spaces, copyright lines and blank
lines dropped, lines joined by a space.  The SHA-256 of the whole canonical text is
hash-joined to the digests of known licences; the digests of single lines are looked
up the same way, so that a standard notice inside other text is seen too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

# Equivalent spellings, to be read as the second of each pair.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("judgement", "judgment"), ("labelled", "labeled"),
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("modelled", "modeled"), ("optimisation", "optimization"), ("organisation", "organization"),
    ("practise", "practice"), ("programme", "program"), ("recognised", "recognized"), ("sublicence", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

# Known texts.  A caller with a larger collection passes its own table.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("BSD-2-Clause", "\n\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_TAIL))),
    ("BSD-3-Clause", "\n\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_TAIL))),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# SHA-256 of the canonical whole texts of longer licences, as Debian's base-files prints them.
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
)

#: Digest rows (about 100 bytes each) up to which the known licences are broadcast.
BROADCAST_ROWS = 100_000
#: Notices up to which they travel inside the plan; more are joined.
PLAN_NOTICES = 1000
#: ASCII other than letters and digits, no-break space and general punctuation.
_MARKS = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f\u00a0\u2000-\u206f]+"
_COPYRIGHT = "^(copyright (c |by |[0-9]{4})|c [0-9]{4}|all rights reserved$)"


def _line(line: Column) -> Column:
    """One canonical line between two spaces, or a lone space if nothing is left of it."""
    out = F.lower(F.regexp_replace(line, "©", " copyright "))
    # ASCII punctuation, controls and general punctuation become spaces; letters of any script stay.
    # Two spaces stand between words until the spellings are done, so that each word has its own.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, _MARKS, "  ")), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, in order; null and empty texts have none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _line)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(_COPYRIGHT))


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(licence_id, text) of the fixed collection, a bounded table."""
    return spark.createDataFrame(list(texts), "licence_id string, text string")


def known_digests(spark: SparkSession, pairs: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> DataFrame:
    """(licence_id, digest) of whole texts that are known by their digests alone, a bounded table."""
    return spark.createDataFrame(list(pairs), "licence_id string, digest string")


def _digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def digests(licences: DataFrame) -> DataFrame:
    """(digest, licence_id) with one row per digest; of equal texts the first id by name stays."""
    got = licences.select(_digest(canonical_lines(F.col("text"))).alias("digest"), "licence_id")
    return got.groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def _join(rows: DataFrame, found: DataFrame, key: str, how: str) -> DataFrame:
    # a collection of counted size goes to every task; a larger one is joined by shuffled digests
    table = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return rows.join(table, rows[key] == table["digest"], how).drop("digest")


def scan(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan_notices: int = PLAN_NOTICES, more: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_sha256, licence_id (null unless the whole text is a known licence), notice_ids (of single lines, sorted, comma-joined).

    ``licences`` is (licence_id, text), ``more`` whole texts as (licence_id, digest); of
    equal texts the first id by name stays.  Null and empty texts share the digest of the
    empty text, which is never a licence; empty collections find nothing.  Repeated rows
    give repeated rows, a null id stays null, extra columns are not read.  Known texts of
    one line serve as notices: up to ``plan_notices`` of them travel inside the plan,
    more are joined to the documents' lines by digest.
    """
    empty = F.sha2(F.lit(""), 256)
    found = digests(licences)
    if more is not None:
        found = found.unionByName(more.select("digest", "licence_id")).groupBy("digest").agg(F.min("licence_id").alias("licence_id"))
    found = found.where((F.col("digest") != empty) & F.col("licence_id").isNotNull())
    single = digests(licences.where(F.size(canonical_lines(F.col("text"))) == 1)).where("licence_id is not null")
    notices = single.orderBy("digest").limit(plan_notices + 1).collect()
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    whole = _digest(F.col("lines")).alias("canonical_sha256")
    if len(notices) > plan_notices:
        numbered = cut(lines.withColumn("row", F.monotonically_increasing_id()))
        told = _join(numbered.select("row", F.explode(F.array_distinct(F.transform("lines", lambda x: F.sha2(x, 256)))).alias("line")), single, "line", "inner")
        seen = told.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("licence_id")), ",").alias("notice_ids"))
        rows = numbered.select("row", "doc_id", whole).join(seen, "row", "left").select("doc_id", "canonical_sha256", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"))
    elif notices:
        table = F.create_map(*(F.lit(x) for r in notices for x in (r["digest"], r["licence_id"])))
        ids = F.transform("lines", lambda x: F.element_at(table, F.sha2(x, 256)))
        rows = lines.select("doc_id", whole, F.array_join(F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))), ",").alias("notice_ids"))
    else:
        rows = lines.select("doc_id", whole, F.lit("").alias("notice_ids"))
    return _join(rows, found, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "licence_id", "notice_ids")


def oracle(texts: tuple[tuple[str, str], ...] = KNOWN, pairs: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> str:
    """The same scan of ``documents`` in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    line = f"' ' || trim(regexp_replace(lower(replace(x, '©', ' copyright ')), '{_MARKS}', '  ', 'g')) || ' '"
    for a, b in EQUIVALENT:
        line = f"replace({line}, ' {a} ', ' {b} ')"
    lines = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(replace({line}, '  ', ' '))), lambda x: x <> '' AND NOT regexp_matches(x, '{_COPYRIGHT}'))"
    values, more = (", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in x) for x in (texts, pairs))
    return f"""
WITH k(licence_id, text) AS (VALUES {values}),
kl AS (SELECT licence_id, {lines} AS lines FROM k),
km(licence_id, digest) AS (VALUES {more}),
ka AS (SELECT licence_id, sha256(array_to_string(lines, ' ')) AS digest FROM kl UNION ALL SELECT licence_id, digest FROM km),
kd AS (SELECT digest, min(licence_id) AS licence_id FROM ka GROUP BY 1),
kn AS (SELECT sha256(array_to_string(lines, ' ')) AS digest, min(licence_id) AS licence_id FROM kl WHERE len(lines) = 1 GROUP BY 1),
d AS (SELECT row_number() OVER () AS row, doc_id, {lines} AS lines FROM documents),
u AS (SELECT row, sha256(unnest(lines)) AS digest FROM d),
n AS (SELECT row, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS notice_ids FROM u JOIN kn USING (digest) GROUP BY row)
SELECT doc_id, sha256(array_to_string(lines, ' ')) AS canonical_sha256, kd.licence_id AS licence_id, coalesce(n.notice_ids, '') AS notice_ids
FROM d LEFT JOIN n USING (row) LEFT JOIN kd ON kd.digest = sha256(array_to_string(lines, ' ')) AND len(lines) > 0
"""
