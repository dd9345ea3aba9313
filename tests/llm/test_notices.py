"""Licence rules on the licences' own notices as they are wrapped in files."""

import textwrap

import pytest

from loomlight.llm import license_scan

NOTICES = {
    "Apache-2.0": """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause": """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or""",
}


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in license_scan.scan(rows).orderBy("doc_id").collect()]


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_canonical_notices(spark, prefix):
    texts = ["\n".join(prefix + line for line in t.split("\n")) for t in NOTICES.values()]
    assert [r.license for r in scanned(spark, texts)] == list(NOTICES)


def test_every_sentence_however_it_is_wrapped(spark):
    sentences = [(name, s.title()) for name, all_of in license_scan.SENTENCES.items() for s in all_of]
    for width in (20, 43, 72):
        found = scanned(spark, ["Some words\n" + textwrap.fill(s, width) + ".\nOther words" for _, s in sentences])
        assert [r.sentence_ids for r in found] == [name for name, _ in sentences]


def test_paragraphs_are_not_joined_and_pieces_count_once(spark):
    found = scanned(spark, ["Licensed under the\n\nMIT License", "Licensed under the\nMIT License\nCopyright 2020", "MIT. license", ". " * 50_000 + "license"])
    assert [r.sentence_ids for r in found] == ["MitTitle", "MitRelease", "MitTitle", ""]
