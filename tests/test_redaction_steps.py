from pyspark.sql import functions as F

from loomlight.functions import classifiers as C
from loomlight.plans import relation_queries


def counted(spark, texts):
    rows = C.with_redaction_counts(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    return [{n: r[n] for n in C.REDACTIONS if r[n]} for r in rows]


def test_each_rule_runs_once(spark, sf):
    plan = relation_queries.a27(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(C.REDACTIONS)
    assert plan.count("regexp_replace") == len(C.REDACTIONS) - 1  # nothing reads what the last one leaves


def test_marks_stand_in_what_their_rules_match(spark):
    kept = {
        "email": "a.b@c.org", "ipv4": "1.2.3.4", "github-token": "ghs_" + "a" * 30, "aws-akid": "AKIA" + "A1" * 8, "slack-token": "xoxb-" + "1" * 10, "jwt": "eyJaaaaaaaa.eyJbbbbbbbb.cccccccc",
        "bearer": "bEaReR " + "a" * 16, "private-key": "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "assigned-secret": "PassWD=x", "config-secret": '"API-Key": "' + "x" * 12 + '"',
        "url-userinfo": "git+SSH://me:pw@h", "url-secret-param": "?SIG=x",
    }
    assert list(kept) == list(C.REDACTIONS)
    assert counted(spark, kept.values()) == [{n: 1} for n in kept]
    assert counted(spark, ["ghp_ @ . AKIA xox eyJ bearer key=: ://?", "", None]) == [{}, {}, {}]


def test_rules_count_in_what_is_left(spark):
    # the rest of a run after a match may begin another
    assert counted(spark, ["a@b.com1@d.org", "a@b.com@d.org", "x=a@b.co,c@d.eu", "token=a@b.co"]) == [{"email": 2}, {"email": 1}, {"email": 2}, {"email": 1, "assigned-secret": 1}]
    (row,) = C.with_redaction_counts(spark.createDataFrame([(None,)], "t string"), "t").collect()
    assert row.asDict() == {"t": None} | dict.fromkeys(C.REDACTIONS)


def test_long_runs_take_linear_time(spark):
    texts = [("a" * 3_000_000) + " @ b@c.org"]
    assert counted(spark, texts) == [{"email": 1}]
    assert spark.createDataFrame([(texts[0],)], "t string").select(F.length(C.redacted(F.col("t")))).first()[0] == 3_000_000 + len(" @ [email]")
