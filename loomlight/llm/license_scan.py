"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut to sentences (at . ! ? ; : before white space, at empty lines, and at a line
end before a line that begins like a sentence), each is normalised (lower case, letters and
digits, single spaces), and the known ones become sentence identifiers in order. Known
sentences that these cuts divide ("...Foundation; either version 2...", lines wrapped before
a capital) are joined again: neighbours of one paragraph whose words together are a known
sentence count as that one, the longest first. scan_sql() looks at single pieces only, so the
two agree on notices that stand on one line. Ordered
rules are then matched against the identifier sequence: the first that matches names the
licence, all that match are listed. All rules are followed at once in one pass over the
identifiers: a bit for each place of each rule tells whether the rule is met up to there, so
the work and the memory of a text grow with its sentences, however many they are.

Everything happens within a row: no shuffle, no join. Known sentences are a fixed list.
A null or empty text has no identifiers and no licence. Repeated rows give repeated
results, null ids stay null, other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised, by identifier.
SENTENCES = {
    "ApacheGrant": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "ApacheComply": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "ApacheAsIs": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "ApacheSee": ["see the license for the specific language governing permissions and limitations under the license"],
    "MitRelease": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "MitTitle": ["mit license", "the mit license", "the mit license mit"],
    "MitGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MitAsIs": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MitLiable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "BsdGrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BsdEndorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BsdNotice": ["licensed under the bsd license", "released under the bsd license"],
    "IscGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "GplWork3": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "GplWork2": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "GplFree3Plus": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GplFree2Plus": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "LgplFree21Plus": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "AgplFree3Plus": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "FreeSoftware": ["this program is free software", "this library is free software"],
    "GplHope": ["this program is distributed in the hope that it will be useful but without any warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"],
    "MplForm": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "CcBy": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CcBySa": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CcByNc": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CcByNd": ["licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "AllRights": ["all rights reserved"],
}

# Rules in order, as identifier sequences; "*" stands for any identifiers between.
RULES = [
    ("Apache-2.0", ["ApacheGrant", "*", "ApacheComply"]),
    ("Apache-2.0", ["ApacheGrant"]),
    ("Apache-2.0", ["ApacheComply", "*", "ApacheAsIs", "*", "ApacheSee"]),
    ("MIT", ["MitGrant", "*", "MitNotice", "*", "MitAsIs"]),
    ("MIT", ["MitRelease"]),
    ("MIT", ["MitTitle"]),
    ("BSD-3-Clause", ["BsdGrant", "*", "BsdSource", "*", "BsdBinary", "*", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "*", "BsdSource", "*", "BsdBinary"]),
    ("BSD", ["BsdNotice"]),
    ("ISC", ["IscGrant"]),
    ("AGPL-3.0-or-later", ["AgplFree3Plus"]),
    ("LGPL-2.1-or-later", ["LgplFree21Plus"]),
    ("GPL-3.0-or-later", ["GplFree3Plus"]),
    ("GPL-2.0-or-later", ["GplFree2Plus"]),
    ("GPL-3.0", ["GplWork3"]),
    ("GPL-2.0", ["GplWork2"]),
    ("MPL-2.0", ["MplForm"]),
    ("CC-BY-NC-4.0", ["CcByNc"]),
    ("CC-BY-SA-4.0", ["CcBySa"]),
    ("CC-BY-ND-4.0", ["CcByNd"]),
    ("CC-BY-4.0", ["CcBy"]),
    ("Unlicense", ["Unlicense"]),
    ("Proprietary", ["AllRights"]),
]

#: Every known sentence has one of these; a text without any needs no normalising.
ANCHORS = ["licen", "copyright", "warrant", "redistribut", "permission", "software", "source code", "rights reserved"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CUT, _END = "\x01", "\x02"  # between pieces that may be joined, and between paragraphs
_EMPTY_LINES = 1  # place in _CUTS
#: Pattern and replacement, one after the other; the same in Java's and RE2's language but for the group mark.
_CUTS = [(r"[.!?;:]+([ \t\r\n]+|$)", _CUT), (r"\n[ \t\r]*\n", _CUT), (r"([^,\n])\r?\n[ \t*#/]*([A-Z][a-z])", rf"{{1}}{_CUT}{{2}}")]
_KNOWN = {s: name for name, all_of in SENTENCES.items() for s in all_of}


class Places:
    """Bits for the places of rules: where rules begin, which bits stay once set, the last bit of each rule, and the bits that each identifier may set."""

    def __init__(self, rules: list[tuple[str, list[str]]]) -> None:
        self.starts = self.staying = 0
        self.last: list[int] = []
        self.of: dict[str, int] = {}
        bit = 1
        for _, sequence in rules:
            self.starts |= bit
            for i, x in enumerate(sequence):
                if x == "*":
                    continue
                self.of[x] = self.of.get(x, 0) | bit
                if i + 1 == len(sequence) or sequence[i + 1] == "*":
                    self.staying |= bit
                bit <<= 1
            self.last.append(bit >> 1)
        if bit >> 63:
            raise ValueError("too many places of rules for one pass")

    def met(self, names: Column) -> Column:
        """The bits after all identifiers."""
        masks = F.create_map(*(F.lit(x) for name, mask in self.of.items() for x in (name, mask)))
        step = lambda d, x: F.shiftleft(d, 1).bitwiseOR(F.lit(self.starts)).bitwiseAND(F.coalesce(F.try_element_at(masks, x), F.lit(0))).bitwiseOR(d.bitwiseAND(F.lit(self.staying)))
        return F.aggregate(names, F.lit(0).cast("long"), lambda d, x: step(d, x).cast("long"))


def _rule_pattern(sequence: list[str]) -> str:
    """For SQL, over identifiers that are each followed by a blank, with a blank before the first."""
    out = " "
    for x in sequence:
        out += "([A-Za-z0-9]+ )*" if x == "*" else f"{x} "
    return out


#: Known sentences between cuts, the longest first; a cut may stand for any blank.
_FOUND = f"(?<=[{_CUT}{_END}])(?:" + "|".join(s.replace(" ", f"[ {_CUT}]") for s in sorted(_KNOWN, key=len, reverse=True)) + f")(?=[{_CUT}{_END}])"


def identifiers(text: Column) -> Column:
    """The known sentences' identifiers in the order of the text."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    may_be = reduce(Column.__or__, (low.contains(a) for a in ANCHORS))
    cut = text
    for at, (pattern, by) in enumerate(_CUTS):
        cut = F.regexp_replace(cut, pattern, by.replace(_CUT, _END if at == _EMPTY_LINES else _CUT).replace("{1}", "$1").replace("{2}", "$2"))
    plain = F.regexp_replace(F.translate(cut, _UPPER, _LOWER), f"[^a-z0-9{_CUT}{_END}]+", " ")
    plain = F.regexp_replace(F.concat(F.lit(_CUT), plain, F.lit(_CUT)), f" ?{_CUT}[{_CUT} ]*", _CUT)
    plain = F.regexp_replace(plain, f" ?{_CUT}?{_END}[{_CUT}{_END} ]*", _END)
    names = F.create_map(*(F.lit(x) for pair in _KNOWN.items() for x in pair))
    known = F.regexp_extract_all(plain, F.lit(_FOUND), F.lit(0))
    return F.when(may_be, F.transform(known, lambda s: F.element_at(names, F.translate(s, _CUT, " ")))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (blank-joined), license (of the first rule that matches, or null), licenses (of all, in rule order, comma-joined)."""
    places = Places(RULES)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identifiers(F.col("text").cast("string")).alias("names"))
    found = found.withColumn("met", places.met(F.col("names")))
    hits = F.array(*(F.when(F.col("met").bitwiseAND(F.lit(last)) != 0, F.lit(name)) for (name, _), last in zip(RULES, places.last, strict=True)))
    return found.withColumn("matched", F.array_distinct(F.array_compact(hits))).select(
        "doc_id",
        F.size("names").cast("long").alias("n_sentences"),
        F.array_join("names", " ").alias("sentence_ids"),
        F.get("matched", F.lit(0)).alias("license"),
        F.array_join("matched", ",").alias("licenses"),
    )


def scan_sql() -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cut = "coalesce(text, '')"
    for pattern, by in _CUTS:
        by = " || ".join(f"'{x}'" if x != _CUT else "chr(1)" for x in by.replace("{1}", "\\1\0").replace("{2}", "\0\\2").replace(_CUT, f"\0{_CUT}\0").split("\0") if x)
        cut = f"regexp_replace({cut}, '{pattern}', {by}, 'g')"
    names = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in _KNOWN.items())
    rules = ", ".join(f"({i}, {quoted(name)}, {quoted(_rule_pattern(rule))})" for i, (name, rule) in enumerate(RULES))
    return f"""
WITH known(sentence, name) AS (VALUES {names}), rules(priority, license, pattern) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
sentences AS (SELECT r, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT r, string_split(translate({cut}, '{_UPPER}', '{_LOWER}'), chr(1)) AS s FROM docs)),
ids AS (SELECT r, i, name FROM sentences JOIN known ON trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) = sentence),
seq AS (SELECT r, count(*) AS n, string_agg(name, ' ' ORDER BY i) AS sentence_ids FROM ids GROUP BY r),
hits AS (SELECT r, license, min(priority) AS p FROM seq, rules WHERE regexp_matches(' ' || sentence_ids || ' ', pattern) GROUP BY r, license),
found AS (SELECT r, arg_min(license, p) AS license, string_agg(license, ',' ORDER BY p) AS licenses FROM hits GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, license, coalesce(licenses, '') AS licenses
FROM docs LEFT JOIN seq USING (r) LEFT JOIN found USING (r)
"""
