"""Projections of the driver's tables onto spans, as text that both engines run.

EPOCH_US(x) stands for the microseconds of a timestamp without zone; each engine has its own
spelling. A projection is used by the Spark queries and, word for word, by their SQL twins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classifiers as C

# One trace for each user: the first event is the root, others hang under it.
EVENT_SPANS = """
SELECT CAST(user_id AS STRING) AS trace_id, CAST(event_id AS STRING) AS span_id,
  CASE WHEN event_id = root THEN NULL ELSE CAST(root AS STRING) END AS parent_span_id,
  event_id AS ord, EPOCH_US(ts) AS start_us, EPOCH_US(ts) + CAST(round(value * 1000) AS BIGINT) AS end_us, event_type AS name,
  CASE WHEN event_id = root THEN 'AGENT' WHEN event_type = 'signup' THEN 'LLM' WHEN event_type = 'purchase' THEN 'CHAIN' ELSE 'TOOL' END AS kind,
  CASE WHEN event_id <> root AND event_type IN ('click', 'view', 'error') THEN CASE k % 8 WHEN 3 THEN 'Skill' WHEN 5 THEN 'spawn_agent' WHEN 6 THEN 'Task' ELSE concat('tool_', CAST(k % 8 AS STRING)) END END AS tool,
  CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k % 8 AS STRING) END AS args,
  k % 25 = 7 AS expected_blocking,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'OK' ELSE 'UNSET' END AS status_code,
  CASE WHEN event_type = 'error' THEN concat('code ', CAST(k % 5 AS STRING)) END AS status_message,
  CASE WHEN k % 6 = 0 THEN NULL ELSE concat('model_', CAST(k % 4 AS STRING)) END AS model,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS input_tokens,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS output_tokens,
  CASE WHEN k % 5 = 0 THEN NULL ELSE value / 100 END AS cost_usd,
  CASE WHEN event_type = 'purchase' THEN concat('loop_', CAST(k % 3 AS STRING)) END AS loop_id,
  CASE WHEN event_type = 'purchase' THEN CAST(extract(day FROM ts) AS DOUBLE) END AS iteration,
  CASE WHEN event_type = 'purchase' AND k % 4 <> 0 THEN CASE k % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'error' END END AS outcome,
  CASE WHEN event_type = 'purchase' AND k % 6 <> 1 THEN value END AS score,
  CASE WHEN event_type = 'error' THEN CAST(event_id - 1 - k % 9 AS STRING) END AS link_span_id,
  CASE WHEN k % 2 = 0 THEN 'steered_by' END AS link_kind,
  concat('/work/repo', CAST(user_id % 5 AS STRING), CASE WHEN k % 3 = 0 THEN '/src' ELSE '' END) AS cwd,
  CASE k % 4 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' ELSE 'other' END AS harness, k
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, min(event_id) OVER (PARTITION BY user_id) AS root FROM events) AS e
"""

# One trace for each conversation.
CHAT_SPANS = """
SELECT CAST(conv_id AS STRING) AS trace_id, concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS span_id,
  conv_id, turn AS step, role,
  CASE role WHEN 'user' THEN 'user.prompt' WHEN 'assistant' THEN 'message.assistant' ELSE 'system.prompt' END AS name,
  CASE role WHEN 'assistant' THEN 'LLM' ELSE 'CHAIN' END AS kind,
  CASE role WHEN 'user' THEN 'human' ELSE 'injected' END AS actor, text AS content
FROM conversations
"""

# One trace for each order: the order is the root, its lines hang under it.
ORDER_SPANS = """
SELECT concat('o', CAST(o_orderkey AS STRING)) AS trace_id, concat('o', CAST(o_orderkey AS STRING)) AS span_id, CAST(NULL AS STRING) AS parent_span_id,
  EPOCH_US(o_orderdate) AS start_us, EPOCH_US(o_orderdate) AS end_us, 'AGENT' AS kind, CASE o_orderstatus WHEN 'F' THEN 'ERROR' WHEN 'O' THEN 'OK' ELSE 'UNSET' END AS status_code,
  CAST(NULL AS DOUBLE) AS cost_usd, CAST(NULL AS BIGINT) AS tokens, o_orderpriority AS model, o_custkey AS worker
FROM orders
UNION ALL
SELECT concat('o', CAST(l_orderkey AS STRING)), concat('o', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING), '.', CAST(l_partkey AS STRING), '.', CAST(l_suppkey AS STRING)), concat('o', CAST(l_orderkey AS STRING)),
  EPOCH_US(o_orderdate), EPOCH_US(l_shipdate), 'LLM', CASE l_returnflag WHEN 'R' THEN 'ERROR' ELSE 'OK' END,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice END, CAST(l_quantity AS BIGINT), l_linestatus, l_suppkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

# A tree: region, nation, then suppliers and customers; balances are what was spent.
TREE_NODES = """
SELECT concat('r', CAST(r_regionkey AS STRING)) AS node, CAST(NULL AS STRING) AS parent, r_name AS label, CAST(NULL AS DOUBLE) AS usd, CAST(NULL AS STRING) AS agent FROM region
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), n_name, CAST(n_nationkey AS DOUBLE), CASE WHEN n_nationkey % 3 = 0 THEN 'planner' END FROM nation
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), s_name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END, CASE WHEN s_suppkey % 4 = 0 THEN 'worker' END FROM supplier
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), CASE WHEN c_custkey % 11 = 0 THEN 's999999' ELSE concat('s', CAST(c_custkey % 90 AS STRING)) END, c_name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END, CASE WHEN c_custkey % 5 = 0 THEN 'worker' END FROM customer
"""

# Files that mark folders of the event spans as roots of context.
CONTEXT_FILES = """
SELECT concat('/work/repo', CAST(n_nationkey % 7 AS STRING), CASE WHEN n_regionkey = 1 THEN '/src' ELSE '' END) AS folder,
  CASE n_nationkey % 4 WHEN 0 THEN 'AGENTS.md' WHEN 1 THEN 'CLAUDE.md' WHEN 2 THEN '.git' ELSE 'README.md' END AS name
FROM nation
"""

# Users as forked logs: their first error is the session, views and purchases are the turns in its log.
_MADE = "lower(lpad(hex(CAST(floor(EPOCH_US(ts) / 1000) AS BIGINT)), 12, '0'))"
_UUID7 = f"concat(substr({_MADE}, 1, 8), '-', substr({_MADE}, 9, 4), '-7000-8000-', lpad(CAST(event_id % 3 AS STRING), 12, '0'))"
FORK_CHILDREN = f"""
SELECT user_id AS child, CASE user_id % 4 WHEN 0 THEN concat('s', CAST(user_id AS STRING)) WHEN 1 THEN concat('c', CAST(user_id AS STRING)) ELSE {_UUID7} END AS session_id,
  CAST(floor(EPOCH_US(ts) / 1000000) AS BIGINT) AS started_s
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') AS e WHERE n = 1
"""
FORK_TURNS = f"""
SELECT user_id AS child, CASE WHEN user_id % 4 = 0 AND user_id % 3 > 0 AND k % 10 = 0 THEN concat('s', CAST(user_id AS STRING)) WHEN k % 3 = 0 THEN {_UUID7} ELSE concat('t', CAST(event_id AS STRING)) END AS turn_id,
  CAST(floor(EPOCH_US(ts) / 1000000) AS BIGINT) AS started_s
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events WHERE event_type IN ('view', 'purchase')) AS e
"""

# Orders as recorded runs, their lines as steps; the replay leaves out or changes some, and returned lines fail.
_STEPS = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS step, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS code FROM lineitem) AS l"
RECORDED_STEPS = f"""
SELECT l_orderkey AS case_id, step, concat('part ', CAST(l_partkey AS STRING)) AS command, code AS returncode, CASE WHEN code = 1 THEN concat('supplier ', CAST(l_suppkey AS STRING), ' failed') END AS signature FROM {_STEPS}
"""
RERUN_STEPS = f"""
SELECT l_orderkey AS case_id, step, concat('part ', CAST(l_partkey AS STRING)) AS command, CASE WHEN l_quantity = 7 THEN 1 - code ELSE code END AS returncode, concat('error: supplier ', CAST(CASE WHEN l_quantity > 40 THEN 0 ELSE l_suppkey END AS STRING), ' failed') AS output FROM {_STEPS} WHERE l_quantity <> 9
"""
FIX_ATTEMPTS = f"""
SELECT l_orderkey AS case_id, step AS attempt, l_quantity <> 11 AS executed, l_quantity > 25 AS vanished FROM {_STEPS} WHERE l_linestatus = 'F'
"""

# Errors of a user as sessions, each the child of the one before; some links are told by one side only, some lead nowhere.
_KIN = """
SELECT 'e' || CAST(event_id AS STRING) AS session_id, '{0}/' || CAST(event_id AS STRING) AS path,
  CASE WHEN n = 1 AND user_id % 3 = 0 THEN 'lost' || CAST(user_id AS STRING) WHEN k % 8 <> 1 THEN 'e' || CAST(before AS STRING) END AS parent_id,
  CASE WHEN k % 6 <> 2 THEN 'e' || CAST(following AS STRING) END AS child_id, user_id
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS following,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') AS e WHERE {1}
"""
SESSION_KIN = _KIN.format("/log", "true") + "UNION ALL" + _KIN.format("/copy", "k % 20 = 3 AND n > 2")

# Entries of an input as they may come: some are no objects, some have no id, and some runs go round in circles.
INPUT_ENTRIES = EVENT_SPANS.replace("SELECT CAST(user_id AS STRING) AS trace_id, CAST(event_id AS STRING) AS span_id,", "SELECT k % 40 <> 2 AS is_object, CAST(user_id AS STRING) AS trace_id, CASE WHEN k % 40 <> 3 THEN CAST(event_id AS STRING) END AS span_id,").replace("WHEN event_id = root THEN NULL ELSE", "WHEN event_id = root THEN CASE WHEN user_id % 7 = 0 THEN CAST(last AS STRING) END ELSE").replace("min(event_id) OVER (PARTITION BY user_id) AS root", "min(event_id) OVER (PARTITION BY user_id) AS root, max(event_id) OVER (PARTITION BY user_id) AS last")

# Shell commands of tools, and arguments of tools that wait.
COMMANDS = """
SELECT event_id, CASE k % 5 WHEN 0 THEN 'wait' WHEN 1 THEN 'write_stdin' WHEN 2 THEN 'wait_agent' ELSE 'exec_command' END AS tool,
  CASE k % 11 WHEN 0 THEN 'pnpm run test:unit' WHEN 1 THEN 'curl https://a/b' WHEN 2 THEN 'curl -X POST https://a/b' WHEN 3 THEN 'curl --request get https://a' WHEN 4 THEN 'curl -d @f https://a' WHEN 5 THEN '"cell_id": "1"'
    WHEN 6 THEN '"session_id" : 2' WHEN 7 THEN 'see cell_id and session_id' WHEN 8 THEN 'git  diff HEAD' WHEN 9 THEN 'make latest' ELSE CASE WHEN event_type = 'error' THEN NULL ELSE event_type END END AS args
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) AS e
"""

# Where spans show paths: the folder of the session, of a tool, and in messages.
PATH_TEXTS = """
SELECT trace_id, ord, 'ref-cwd' AS source, cwd AS text FROM (EVENTS) AS a WHERE parent_span_id IS NULL
UNION ALL SELECT trace_id, ord, 'span-workdir', cwd FROM (EVENTS) AS b WHERE kind = 'TOOL' AND k % 30 = 0
UNION ALL SELECT trace_id, ord, 'span-path', concat('failed at ', cwd, '//main.py:', CAST(k AS STRING), ':2), see (/tmp/', name, '.log) and /etc/x, ', cwd, '/./lib].') FROM (EVENTS) AS c WHERE status_code = 'ERROR'
""".replace("EVENTS", EVENT_SPANS)

# Outputs of tools in the protocols that tell of failures; 123 and 125 are braces.
TOOL_OUTPUTS = r"""
SELECT event_id, k % 13 AS form, k % 3 AS code, CASE k % 13
  WHEN 0 THEN concat(chr(123), '"exit_code": ', CAST(k % 3 AS STRING), ', "output": "error!"', chr(125)) WHEN 1 THEN concat('Chunk ID: 7', chr(10), 'Process exited with code ', CAST(k % 3 AS STRING), chr(10), 'Output:', chr(10), 'Process exited with code 9')
  WHEN 2 THEN concat('Script completed', chr(10), 'Wall time: 3') WHEN 3 THEN concat('Script failed', chr(10), 'Wall time: 3') WHEN 4 THEN concat('Script error:', chr(10), 'Exit code: ', CAST(k % 3 AS STRING)) WHEN 5 THEN concat('Command failed with exit code ', CAST(k % 3 AS STRING), '.')
  WHEN 6 THEN concat('<tool_error>', chr(10), event_type, '</tool_error>') WHEN 7 THEN 'error: it failed with exit code 3' WHEN 8 THEN concat('[', chr(123), '"type": "text", "text": "Command failed with exit code ', CAST(k % 3 AS STRING), '"', chr(125), ', "plain"]')
  WHEN 9 THEN concat(chr(123), '"timed_out": true', chr(125)) WHEN 10 THEN concat(chr(123), '"succeeded": false, "error": null', chr(125)) WHEN 11 THEN concat(chr(123), ' not json ', chr(125)) END AS output
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) AS e
"""

# Files of context that a session index lists.
CONTEXT_DOCS = """
SELECT concat('/work/repo', CAST(s_nationkey % 7 AS STRING)) AS root, concat('/work/', s_name) AS path, CASE s_suppkey % 5 WHEN 0 THEN 'instruction-doc' WHEN 1 THEN 'reflection' WHEN 2 THEN 'handoff' WHEN 3 THEN 'skill-runs' ELSE 'evolve-log' END AS kind,
  CAST(floor(abs(s_acctbal) / 60) AS INT) AS lines, s_suppkey % 3 = 0 AS has_toc, CASE WHEN s_suppkey % 5 > 2 THEN s_suppkey END AS rows, CASE WHEN s_suppkey % 5 = 4 THEN s_suppkey % 4 ELSE 0 END AS invalid_rows, CASE WHEN s_suppkey % 5 = 3 THEN s_suppkey % 50 END AS linked_rows
FROM supplier
"""

# What each event span says; stand-ins for commands and answers, which the tables don't have.
SAID = """
SELECT trace_id, ord, start_us, tool, name, status_code, kind = 'TOOL' AS is_tool,
  CASE WHEN kind = 'TOOL' THEN CASE k % 6 WHEN 0 THEN 'pytest -q' WHEN 1 THEN 'apply_patch main.py' WHEN 2 THEN 'cat notes.txt' ELSE args END
    WHEN kind = 'LLM' THEN CASE k % 2 WHEN 0 THEN 'All green, ready.' ELSE 'Looking further.' END END AS content
FROM ev
"""


def _actions() -> str:
    """What each event span does, by the words of its tool, name and content; the twin of action_kind()."""
    said = "concat_ws(' ', coalesce(tool, regexp_replace(name, '^tool[.]', '')), name, coalesce(content, ''))"
    kinds = " ".join(f"WHEN is_tool AND regexp_matches({said}, '{pattern}') THEN '{action}'" for action, pattern in (("verify", C.VERIFY), ("edit", C.CHANGE), ("read", C.READ)))
    return f"SELECT trace_id, ord, start_us, tool, content, status_code, is_tool, CASE {kinds} WHEN is_tool THEN 'tool' WHEN regexp_matches(content, '{C.CLAIM}') THEN 'claim' ELSE 'other' END AS action FROM ({SAID})"


PROJECTIONS = {"ev": (EVENT_SPANS, ["events"]), "chat": (CHAT_SPANS, ["conversations"]), "ord": (ORDER_SPANS, ["orders", "lineitem"]), "tree": (TREE_NODES, ["region", "nation", "supplier", "customer"]), "act": (_actions(), ["ev"]),
    "ctx_files": (CONTEXT_FILES, ["nation"]), "fork_children": (FORK_CHILDREN, ["events"]), "fork_turns": (FORK_TURNS, ["events"]),
    "rec_steps": (RECORDED_STEPS, ["lineitem"]), "rerun_steps": (RERUN_STEPS, ["lineitem"]), "fix_tries": (FIX_ATTEMPTS, ["lineitem"]), "kin": (SESSION_KIN, ["events"]),
    "entries": (INPUT_ENTRIES, ["events"]), "commands": (COMMANDS, ["events"]), "path_texts": (PATH_TEXTS, ["events"]), "tool_outputs": (TOOL_OUTPUTS, ["events"]), "ctx_docs": (CONTEXT_DOCS, ["supplier"])}


def for_spark(sql: str) -> str:
    return re.sub(r"EPOCH_US\((\w+)\)", r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)", sql)


def for_duckdb(sql: str) -> str:
    return re.sub(r"EPOCH_US\((\w+)\)", r"epoch_us(\1)", sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame."""
    sql, tables = PROJECTIONS[name]
    if name == "act":
        rows = spark.sql(SAID.replace("FROM ev", "FROM {ev}"), ev=load(spark, sf_dir, "ev"))
        return rows.withColumn("action", C.action_kind(F.col("tool"), F.col("name"), F.col("is_tool"), F.col("content"))).drop("name")
    frames = {t: load(spark, sf_dir, t) if t in PROJECTIONS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    text = for_spark(sql)
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)


def twin(sql: str) -> str:
    """A DuckDB query with the projections that it names in front."""
    needs = lambda n: bool(re.search(rf"\b{n}\b", sql)) or n == "ev" and bool(re.search(r"\bact\b", sql))
    used = [f"{n} AS ({for_duckdb(PROJECTIONS[n][0])})" for n in PROJECTIONS if needs(n)]
    recursive = bool(re.search(r"(?i)\bwith recursive\b", sql))
    body = re.sub(r"(?is)^\s*with(\s+recursive)?\s+", "", sql)
    if body == sql:
        return (f"WITH {', '.join(used)} " if used else "") + sql
    return f"WITH {'RECURSIVE ' * recursive}{', '.join([*used, body.lstrip()])}"
