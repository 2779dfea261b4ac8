"""License scans by sentence rules.

A text is cut into pieces at closing marks and at line ends, each piece is normalised. A known licence sentence is a run of whole
pieces whose words it is, so neither wrapping, comment marks, nor a colon or a version number within it hides it. The sequence of
sentence identifiers is matched against ordered rules, each of which consumes what it matches. Licence expressions behind
SPDX tags are taken apart besides. Built from column functions, so a text never leaves the JVM, and from patterns that DuckDB reads too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\\x20\\x09-\\x0D"
#: Blank lines.
PARAGRAPH = f"\\n(?:[{BLANKS}]*\\n)+"
#: What stands for sentences that aren't known; a paragraph without other characters than these has no sentence.
UNKNOWN, NO_SENTENCE = "-", f".!?;:{BLANKS}"
#: What precedes a clause of a list on its line, without parentheses; a piece of its own with LISTED behind.
LIST_MARK, LISTED = "[0-9]{1,2}|[a-z]|[ivx]{2,4}", "L"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Replacements in a paragraph in lower case, in this order; with bars around the whole, the last (DOUBLING) leaves each piece between bars of its own.
MARKING: tuple[tuple[str, str], ...] = (
    # indentation, comment marks and bullets
    ("(^|[\\n\\r])[^a-z0-9+\\n\\r]+", "$1"),
    (f"(^|[\\n\\r]|[.!?;:][{BLANKS}]+)\\(?({LIST_MARK})[.)][\\x20\\x09]+([^{BLANKS}])", f"$1$2{LISTED}\n$3"),
    (f"[.!?;:]+[{BLANKS}]+|[\\n\\r]+", "|"),
    (f"[^a-z0-9+{LISTED}|]+", " "),
)
DOUBLING = (" *[|][ |]*", "||")
#: Between two words of a known sentence: a blank, or where a piece ends and the next begins.
BETWEEN = f"(?: |{LISTED}?[|][|])"
#: In known sentences a name of as many words at most.
GAP, GAP_WORDS = "*", 12

#: Normalised licence sentences and their identifiers. Public licence notices, as their authors recommend them.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache2",
    "licensed under the apache license version 2 0 the license": "apache2",
    "you may not use this file except in compliance with the license": "apache_use",
    "you may obtain a copy of the license at": "apache_copy",
    "http www apache org licenses license 2 0": "apache_url",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 2": "gpl2",
    "this program is free software": "gpl_free",
    "licensed under cc by nc 4 0": "cc_by_nc4",
    "licensed under cc by 4 0": "cc_by4",
    "licensed under cc by sa 4 0": "cc_by_sa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc_by4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc_by_sa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc_by_nc4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_head",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_name",
    "licensed under the bsd 3 clause license": "bsd3",
    "licensed under the bsd 2 clause license": "bsd2",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_name",
    "neither the name of * nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_name",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd_name",
    "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd_name",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "the asf licenses this file to you under the apache license version 2 0": "apache2",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache2",
    "apache license version 2 0 january 2004": "apache2_text",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache2_text",
    "https www apache org licenses license 2 0": "apache_url",
    "this library is free software": "gpl_free",
    "* is free software": "gpl_free",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0": "epl2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which accompanies this distribution and is available at https www eclipse org legal epl v20 html": "epl2",
    "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1",
    "distributed under the boost software license version 1 0": "boost",
    "boost software license version 1 0 august 17th 2003": "boost",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0",
    "to the extent possible under law * has waived all copyright and related or neighboring rights to this work": "cc0",
    "to the extent possible under law * has waived all copyright and related or neighboring rights to *": "cc0",
    "licensed under cc0 1 0": "cc0",
    "cc0 1 0 universal license": "cc0",
    "this software is provided as is without any express or implied warranty": "zlib_warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib_liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "this source code form is subject to the terms of the mozilla public license version 2 0": "mpl2",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2_copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2_copy",
    "spdx license identifier": "spdx",
    "all rights reserved": "reserved",
}

#: The public licences of the GNU project, by what their name has before "general", and their versions.
GNU = {"": ("gpl", "GPL", ("2", "3")), "lesser ": ("lgpl", "LGPL", ("2.1", "3")), "library ": ("lgpl", "LGPL", ("2",)), "affero ": ("agpl", "AGPL", ("3",))}


def _gnu() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """The terms of these licences as their authors recommend them, and the rules for them."""
    sentences, rules = {}, []
    for kind, (short, name, versions) in GNU.items():
        for version in versions:
            spaced, number = version.replace(".", " "), version.replace(".", "")
            terms, full = f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license", version if "." in version else f"{version}.0"
            published = "as published by the free software foundation"
            sentences |= {
                f"{terms} {published} either version {spaced} of the license or at your option any later version": f"{short}{number}_terms",
                f"{terms} {published} version {spaced} of the license": f"{short}{number}_only",
                f"{terms} {published} version {spaced}": f"{short}{number}_only",
                f"{terms} version {spaced} {published}": f"{short}{number}_only",
            }
            rules += [(f"{name}-{full}-or-later", ("gpl_free", f"{short}{number}_terms")), (f"{name}-{full}-only", ("gpl_free", f"{short}{number}_only"))]
    return sentences, rules


SENTENCES |= _gnu()[0]

#: Rules in the order in which they are tried; longer sequences come before those that they contain.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2", "apache_use", "apache_copy", "apache_url")),
    ("Apache-2.0", ("apache2", "apache_use", "apache_copy")),
    ("Apache-2.0", ("apache2", "apache_use")),
    ("Apache-2.0", ("apache2",)),
    ("Apache-2.0", ("apache2_text",)),
    ("MIT", ("mit", "mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit",)),
    ("ISC", ("isc_grant",)),
    *_gnu()[1],
    ("GPL-3.0-only", ("gpl3",)),
    ("GPL-2.0-only", ("gpl2",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4",)),
    ("CC-BY-4.0", ("cc_by4",)),
    ("BSD-3-Clause", ("reserved", "bsd_head", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("reserved", "bsd_head", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_head", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_head", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd3",)),
    ("BSD-2-Clause", ("bsd2",)),
    ("MPL-2.0", ("mpl2", "mpl2_copy")),
    ("MPL-2.0", ("mpl2",)),
    ("EPL-2.0", ("epl2",)),
    ("EPL-1.0", ("epl1",)),
    ("BSL-1.0", ("boost",)),
    ("CC0-1.0", ("cc0",)),
    ("Zlib", ("zlib_warranty", "zlib_liability", "zlib_grant")),
    ("Zlib", ("zlib_grant",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-All-Rights-Reserved", ("reserved",)),
)

Rules = tuple[tuple[str, tuple[str, ...]], ...]

#: A licence expression: names with operators between, as the tag's specification has them, and parentheses.
_NAME = "[(]*[A-Za-z0-9][A-Za-z0-9.+-]*[)]*"
EXPRESSION = f"SPDX-License-Identifier:[ \\t]*({_NAME}(?: +(?:AND|OR|WITH|and|or|with) +{_NAME})*)"
#: Replacements in the names of an expression, in this order: older names of the GNU licences, and exceptions.
RENAMING: tuple[tuple[str, str], ...] = (("^([AL]?GPL-[0-9.]+)[+]", "$1-or-later"), ("^([AL]?GPL-[0-9.]+)(&|$)", "$1-only$2"), ("&", " "))
#: What is no name of a licence in an expression.
NO_NAMES = ("", "AND", "OR", "and", "or", "NONE", "NOASSERTION")


def anchors(sentences: dict[str, str]) -> list[str]:
    """A few words, of six characters where there are such, one of which is part of every known sentence."""
    left, out = [[w for w in s.split(" ") if w != GAP] for s in sentences], []
    while left:
        words = sorted({w for s in left for w in s if len(w) >= min(6, max(map(len, s)))})
        out.append(max(words, key=lambda w: sum(any(w in x for x in s) for s in left)))
        left = [s for s in left if not any(out[-1] in x for x in s)]
    return out


def alternatives(sentences: list[list[str]]) -> str:
    """A pattern of these sequences of words, the longest that fits first: what sequences begin with alike stands once."""
    heads: dict[str, list[list[str]]] = {}
    for words in sentences:
        if words:
            heads.setdefault(words[0], []).append(words[1:])
    word = lambda w: f"[^ |]+(?:{BETWEEN}[^ |]+){{0,{GAP_WORDS - 1}}}?" if w == GAP else re.escape(w)
    parts = []
    for head in sorted(heads, key=lambda w: (w == GAP, w)):
        rest = [r for r in heads[head] if r]
        more = f"{BETWEEN}{alternatives(rest)}" if rest else ""
        parts.append(word(head) + (f"(?:{more})?" if more and len(rest) < len(heads[head]) else more))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def piece_pattern(sentences: dict[str, str]) -> str:
    """What a marked paragraph is cut into: runs of pieces that are known sentences, and other pieces."""
    other = "[|][^|]*[|]"
    return f"[|]{alternatives([s.split(' ') for s in sentences])}{LISTED}?[|]|{other}" if sentences else other


def gap_patterns(sentences: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(pattern, what it begins with, what it ends with, identifier) of known sentences with names in them."""
    gap = f"(?:[^ ]+ ){{0,{GAP_WORDS - 1}}}[^ ]+"
    return [("^" + " ".join(gap if w == GAP else re.escape(w) for w in s.split(" ")) + "$", s.split(GAP)[0], s.split(GAP)[-1], i) for s, i in sentences.items() if GAP in s]


def pieces(paragraph: Column, sentences: dict[str, str]) -> Column:
    """Known sentences and other pieces of a paragraph, in order, between bars."""
    text = F.translate(paragraph, UPPER, LOWER)
    for pattern, by in MARKING:
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(F.concat(F.lit("|"), text, F.lit("|")), *DOUBLING)
    return F.regexp_extract_all(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(piece_pattern(sentences)), F.lit(0))


def sequence(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """The identifiers of a text's sentences as " a b - c ": known ones in order, UNKNOWN once for each run of others.

    Pieces end at closing marks before a blank, at line ends and blank lines; of known sentences that begin at a piece the longest counts, and none
    goes across a blank line. Lines without letters or digits and list marks don't count, unless a text has nothing else.
    """
    sentences = SENTENCES if sentences is None else sentences
    plain = {s: i for s, i in sentences.items() if GAP not in s}
    longest = max(map(len, plain), default=0)
    table = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair]) if plain else F.create_map().cast("map<string,string>")
    text = F.coalesce(text, F.lit(""))

    def known(piece: Column) -> Column:
        words = F.trim(F.regexp_replace(piece, f"{LISTED}?[|]+", " "))
        found = F.when(F.length(words) <= longest, F.try_element_at(table, words))
        for pattern, head, tail, i in gap_patterns(sentences):
            found = F.coalesce(found, F.when(F.endswith(words, F.lit(tail)) & F.startswith(words, F.lit(head)) & F.rlike(words, F.lit(pattern)), F.lit(i)))
        return F.coalesce(found, F.when(F.endswith(piece, F.lit(f"{LISTED}|")), F.lit("")).otherwise(F.lit(UNKNOWN)))

    words = anchors(sentences)
    # Looking ahead for their first letters tells most places sooner than trying one word after the other.
    found = F.lit(f"(?=[{''.join(sorted({w[0] for w in words}))}])(?:{'|'.join(map(re.escape, words))})") if sentences else None

    def of_paragraph(p: Column) -> Column:
        """A paragraph without an anchor has no known sentence."""
        taken_apart = F.array_join(F.filter(F.transform(pieces(p, sentences), known), lambda x: x != ""), " ")
        return F.lit(UNKNOWN) if found is None else F.when(F.rlike(F.lower(p), found), taken_apart).otherwise(F.lit(UNKNOWN))

    some_sentence = lambda t: F.rlike(t, F.lit(f"[^{NO_SENTENCE}]"))
    ids = F.array_join(F.transform(F.filter(F.split(text, PARAGRAPH), some_sentence), of_paragraph), " ")
    ids = F.regexp_replace(ids, f"(^| ){UNKNOWN}(?: {UNKNOWN})+", f"$1{UNKNOWN}")
    # Only texts with an anchor are taken apart.
    some = F.lit(False) if found is None else F.rlike(F.lower(text), found)
    ids = F.when(some, ids).when(some_sentence(text), F.lit(UNKNOWN)).otherwise(F.lit(""))
    return F.concat(F.lit(" "), ids, F.lit(" "))


def expression_names(text: Column) -> Column:
    """The licences that SPDX tags of a text name, in order, each with its exception."""
    joined = lambda e: F.regexp_replace(e, " +(?:WITH|with) +", "&WITH&")
    names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(1)), lambda e: F.split(joined(e), "[ ()]+")))

    def renamed(name: Column) -> Column:
        for pattern, by in RENAMING:
            name = F.regexp_replace(name, pattern, by)
        return name

    return F.transform(F.filter(names, lambda n: ~n.isin(*NO_NAMES)), renamed)


def apply_rules(ids: Column, rules: Rules = RULES) -> tuple[Column, Column]:
    """(licences in the order of the rules, nulls between; what no rule consumed)."""
    names: list[Column] = []
    for licence, body in rules:
        pattern = f" {' '.join(body)} "
        names.append(F.when(F.contains(ids, F.lit(pattern)), F.lit(licence)))
        # matches share their outer blanks, so what is consumed leaves an unknown between blanks
        ids = F.replace(F.replace(ids, F.lit(pattern), F.lit(f" {UNKNOWN} ")), F.lit(pattern), F.lit(f" {UNKNOWN} "))
    return F.array(*names), ids


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: Rules = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_known (known sentences), sentence_ids, licenses, unmatched.

    sentence_ids are the known identifiers in order with UNKNOWN between those that other sentences part; licenses are the
    names of all rules that match, in the order of the rules, then those that SPDX expressions name, each once, joined by commas;
    unmatched are known identifiers that no rule consumed, SPDX tags (``spdx``) aside. A name within a known sentence has GAP_WORDS words at most.
    A null or empty text has none of them. Repeated rows each get a row, a row with a null id too. Very long texts are scanned whole, in
    one cell. An empty table gives no rows. Other columns aren't read.
    """
    known = lambda ids: F.filter(F.split(F.trim(ids), " "), lambda x: (x != UNKNOWN) & (x != ""))
    rows = docs.select("doc_id", sequence(F.col("text"), sentences).alias("ids"), F.when(F.contains("text", F.lit("SPDX-License-Identifier:")), expression_names(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("spdx"))
    # Only texts with a known sentence go through the rules.
    licences, rest = apply_rules(F.col("ids"), rules)
    some = F.size(known(F.col("ids"))) > 0
    named = F.concat(F.when(some, F.filter(licences, lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>")), F.col("spdx"))
    return rows.select(
        "doc_id",
        F.size(known(F.col("ids"))).cast("long").alias("n_known"),
        F.trim("ids").alias("sentence_ids"),
        F.array_join(F.array_distinct(named), ",").alias("licenses"),
        F.when(some, F.array_join(F.filter(known(rest), lambda x: x != "spdx"), ",")).otherwise("").alias("unmatched"),
    )


def oracle() -> str:
    """The scan as DuckDB SQL, from the same tables and patterns."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    back = lambda by: re.sub(r"[$]([0-9])", r"\\\1", by)
    replaced = lambda e, steps: [e := f"regexp_replace({e}, {quoted(p)}, {quoted(back(by))}, 'g')" for p, by in steps][-1]
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in SENTENCES.items() if GAP not in k)
    gaps = " ".join(f"WHEN regexp_matches(words, {quoted(p)}) THEN {quoted(i)}" for p, _, _, i in gap_patterns(SENTENCES))
    anchor = quoted("|".join(map(re.escape, anchors(SENTENCES))))
    names, steps = [], []
    for i, (licence, body) in enumerate(RULES):
        pattern = f" {' '.join(body)} "
        names.append(f"CASE WHEN contains(i{i}, '{pattern}') THEN '{licence}' END")
        steps.append(f"s{i + 1} AS (SELECT *, replace(replace(i{i}, '{pattern}', ' {UNKNOWN} '), '{pattern}', ' {UNKNOWN} ') AS i{i + 1} FROM s{i})")
    n = len(RULES)
    expression = f"flatten(list_transform(regexp_extract_all(coalesce(text, ''), {quoted(EXPRESSION)}, 1), lambda e: string_split_regex(regexp_replace(e, ' +(?:WITH|with) +', '&WITH&', 'g'), '[ ()]+')))"
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
p AS (SELECT r, k, part FROM (SELECT r, unnest(string_split_regex(low, {quoted(PARAGRAPH)})) AS part, generate_subscripts(string_split_regex(low, {quoted(PARAGRAPH)}), 1) AS k FROM d) WHERE regexp_matches(part, {quoted(f"[^{NO_SENTENCE}]")})),
m AS (SELECT r, k, {replaced(f"'|' || {replaced('part', MARKING)} || '|'", [DOUBLING])} AS marked FROM p WHERE regexp_matches(part, {anchor})),
c AS (SELECT r, k, regexp_extract_all(substr(marked, 2, length(marked) - 2), {quoted(piece_pattern(SENTENCES))}) AS cut FROM m),
x AS (SELECT r, k, unnest(cut) AS piece, generate_subscripts(cut, 1) AS j FROM c),
w AS (SELECT *, trim(regexp_replace(piece, '{LISTED}?[|]+', ' ', 'g')) AS words FROM x),
y AS (SELECT r, k, j, coalesce(id, CASE {gaps} END, CASE WHEN ends_with(piece, '{LISTED}|') THEN NULL ELSE '{UNKNOWN}' END) AS id FROM w LEFT JOIN known ON words = sentence
      UNION ALL SELECT r, k, 1, '{UNKNOWN}' FROM p WHERE NOT regexp_matches(part, {anchor})),
z AS (SELECT r, string_agg(id, ' ' ORDER BY k, j) AS ids FROM y GROUP BY r),
s0 AS (SELECT r, doc_id, list_transform(list_filter({expression}, lambda q: q NOT IN ({", ".join(map(quoted, NO_NAMES))})), lambda q: {replaced("q", RENAMING)}) AS spdx,
       ' ' || regexp_replace(coalesce(ids, ''), '(^| ){UNKNOWN}(?: {UNKNOWN})+', '\\1{UNKNOWN}', 'g') || ' ' AS i0 FROM d LEFT JOIN z USING (r)),
{", ".join(steps)},
t AS (SELECT *, list_filter(string_split(trim(i0), ' '), lambda q: q NOT IN ('', '{UNKNOWN}')) AS known_ids,
             list_filter(string_split(trim(i{n}), ' '), lambda q: q NOT IN ('', '{UNKNOWN}', 'spdx')) AS rest,
             list_concat(list_filter([{", ".join(names)}], lambda q: q IS NOT NULL), spdx) AS l FROM s{n})
SELECT doc_id, len(known_ids)::BIGINT AS n_known, trim(i0) AS sentence_ids,
       coalesce(array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ','), '') AS licenses,
       coalesce(array_to_string(rest, ','), '') AS unmatched
FROM t
"""
