"""Reactions, actors, actions, task starts and redaction rules, by literal cases."""

import pytest
from pyspark.sql import functions as F

from loomlight.functions import classifiers as C


def each(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(column).collect()]


def test_reactions(spark):
    texts = ["no, that is wrong", "perfect, exactly right", "tl;dr please, too much jargon", "ugh, again?", "nobody knows", "", None]
    assert each(spark, C.reaction_labels(F.col("x")), texts) == [["correction"], ["praise"], ["jargon", "structure"], ["frustration"], [], [], []]


def test_words_end_at_letters_of_ascii_only(spark):
    assert each(spark, C.matches(F.col("x"), C.READ), ["écat é", "bobcat", "x cat-file"]) == [True, False, True]


def test_actors(spark):
    x, user = F.col("x"), F.lit("user")
    assert each(spark, C.actor(user, x), ["hello", "a <system-reminder> b", "## Deliverable", "x" * 600 + "## Deliverable"]) == ["human", "injected", "injected", "human"]
    assert each(spark, C.actor(user, x, first=F.lit(True)), ["You are a reviewer", "please look", "y" * 1501]) == ["subagent-spawn", "human", "subagent-spawn"]
    assert each(spark, C.actor(user, x, sidechain=F.lit(True)), ["hello"]) == ["subagent-spawn"]
    assert each(spark, C.actor(user, x, meta=F.lit(True)), ["hello"]) == ["injected"]
    assert each(spark, C.actor(user, x, user_type=F.lit("internal")), ["hello"]) == ["injected"]
    assert each(spark, C.actor(F.lit("assistant"), x), ["hello"]) == ["agent"]


def test_task_starts(spark):
    texts = ["fix it", " ", None, "[Request interrupted by user]", "<command-name>/clear</command-name>", "<command-name>/review</command-name>", "# AGENTS.md instructions", "# AGENTS.md instructions <INSTRUCTIONS>a</INSTRUCTIONS> go"]
    assert each(spark, C.starts_task(F.col("x")), texts) == [True, False, False, False, False, True, False, True]
    assert each(spark, C.starts_task(F.col("x"), sidechain=F.lit(True)), ["fix it"]) == [False]


def test_actions(spark):
    tool = F.lit("shell")
    texts = ["pnpm vitest run", "sed -i s/a/b/ x", "sed -n 1p x", "sleep 1"]
    assert each(spark, C.action_kind(tool, F.lit("tool.shell"), F.lit(True), F.col("x")), texts) == ["verify", "edit", "read", "tool"]
    none = F.lit(None).cast("string")
    assert each(spark, C.action_kind(none, F.lit("llm"), F.lit(False), F.col("x")), ["All green.", "still looking", None]) == ["claim", "other", "other"]


@pytest.mark.parametrize(
    ("rule", "secret"),
    [
        ("github-token", "ghp_" + "a1" * 18),
        ("aws-akid", "AKIA" + "ABCD" * 4),
        ("slack-token", "xoxb-1234567890-abc"),
        ("jwt", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"),
        ("bearer", "bearer abcdefgh.ijklmnop-qr"),
        ("private-key", "-----BEGIN RSA PRIVATE KEY-----\nab\ncd\n-----END RSA PRIVATE KEY-----"),
        ("assigned-secret", "MY_API_KEY='a b c'"),
        ("assigned-secret", "DB_PASSWORD=" + "p$x" * 7000),
        ("config-secret", '"client_secret": "abcdefgh12345"'),
        ("url-userinfo", "https://bob:hunter2@"),
        ("url-secret-param", "?sig=abc"),
    ],
)
def test_redaction(spark, rule, secret):
    (found,) = each(spark, C.redacted(F.col("x")), [f"see {secret} end"])
    assert found == f"see [{rule}] end"


def test_prose_is_left_alone(spark):
    texts = ["Narrative token: x", "(token: string)", "the secret of tokens", None]
    assert each(spark, C.redacted(F.col("x")), texts) == texts
