"""Texts that once broke an engine: very many licence sentences, long runs of white space, more tokens than positions."""

import itertools
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomlight.llm import bin_packing, chunks, license_scan, winnow  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

R = random.Random(3)


def test_a_hundred_thousand_licence_sentences(spark):
    apache, comply = "Licensed under the Apache License, Version 2.0.\n", "You may not use this file except in compliance with the License.\n"
    texts = [apache + "MIT License.\n" * 100_000, apache + "All rights reserved.\n" * 50_000 + comply, "MIT License.\n\n" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_sentences, r.license, r.licenses) for r in license_scan.scan(df).drop("sentence_ids").collect()}
    assert found == {0: (100_001, "Apache-2.0", "Apache-2.0,MIT"), 1: (50_002, "Apache-2.0", "Apache-2.0,Proprietary"), 2: (100_000, "MIT", "MIT")}


def matches(sequence, names):
    """Whether the rule matches somewhere, by trying every place."""
    if not sequence:
        return True
    if sequence[0] == "*":
        return any(matches(sequence[1:], names[i:]) for i in range(len(names) + 1))
    return bool(names) and names[0] == sequence[0] and matches(sequence[1:], names[1:])


def test_places_of_rules_equal_trying_all(spark):
    rules = [(str(i), [*R.choices("abc", k=R.randint(1, 2)), *(["*", *R.choices("abc", k=R.randint(1, 2))] if R.random() < 0.6 else [])]) for i in range(15)]
    places = license_scan.Places(rules)
    names = [list(x) for n in range(5) for x in itertools.product("abcd", repeat=n)]
    df = spark.createDataFrame([(x,) for x in names], "names array<string>")
    for row in df.select("names", places.met(F.col("names")).alias("met")).collect():
        got = [bool(row.met & last) for last in places.last]
        assert got == [any(matches(rule, row.names[i:]) for i in range(len(row.names) + 1)) for _, rule in rules], row.names


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\xa0"])
def test_two_million_white_spaces(spark, space):
    files = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    text = "a word" + space * 2_000_000 + "another word"
    (ids,) = bin_packing.encode_ids([text], *files)
    assert len(ids) // 4 == len(chunks.byte_tokenizer(files[0]).encode(text, add_special_tokens=False).ids)


def test_long_white_space_is_packed(spark):
    rows = [(1, "a" + " " * 1_200_000 + "b"), (2, "c"), (None, None), (2, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = bin_packing.pack_documents(df).collect()
    assert sum(r.length for r in found if r.doc_id == 1) > 2048 and sum(r.doc_id == 2 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1


def test_more_tokens_than_positions_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(winnow, "_LAST", 15)
    df = spark.createDataFrame([("a " * 15,), ("a " * 16,)], "t string")
    assert df.filter("length(t) = 30").select(winnow.fingerprint(F.col("t"))).count() == 1
    with pytest.raises(Exception, match="more than 15 tokens"):
        df.select(winnow.fingerprint(F.col("t"))).collect()
