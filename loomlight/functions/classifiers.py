"""Predicates and classifiers: actions, actors, reactions, redaction, kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What commands verify, change or read, and texts that claim to be done.
VERIFY = r"(?i)\b(test|tests|vitest|jest|pytest|go test|cargo test|tsc|typecheck|lint|biome|eslint|build|check:invariants|preflight)\b"
CHANGE = r"(?i)\b(apply_patch|edit|write|create|delete|rename|replace|update|git apply|sed -i|perl -pi|tee\s|cat\s+>)"
READ = r"(?i)\b(read|cat|less|grep|rg|sed -n|nl|ls|find|git show|git diff)\b"
CLAIM = r"(?i)\b(done|fixed|complete|completed|implemented|merged|verified|all green|tests pass|ready|works now)\b"
# Reactions of people, matched against lower-case text.
REACTIONS = {
    "jargon": r"\b(jargon|plain english|plain language|eli5|explain like|in plain|what does that mean|what does .* mean|i don'?t (understand|get)|gibberish|english please|too technical|speak (plainly|english)|dumb(ed)? it down|simpler|simplify your|no buzzwords?)\b",
    "structure": r"\b(too long|tl;?dr|get to the point|bluf|lead with|bullet|bulletpoint|wall of text|too verbose|shorter|be concise|stop (yapping|rambling)|less words?|fewer words?|just (the|tell me)|cut the)\b",
    "correction": r"(\bno[,. ]|^no\b|\bstop\b|\bdon'?t\b|you keep|i (said|told you|asked)|that'?s not (what|right|it)|not what i|didn'?t ask|incorrect|that'?s wrong|you'?re wrong|why are you|why did you|that'?s not the|missed the|not the point|ur wrong|thats not)",
    "frustration": r"(ugh|wtf|wth|come on|seriously|again\?|for the (last|nth) time|are you kidding|jesus|christ|frustrat|annoying|wasting|waste of)",
    "praise": r"\b(perfect|exactly|nailed it|love (it|this)|beautiful|great work|ship it|clean|nice work|excellent|that'?s it|yes!+|amazing|chef'?s kiss|brilliant)\b",
}
# Marks of turns that a program put in.
COMMAND_MARKS = ["<command-name>", "<local-command-caveat>", "<command-message>", "<command-args>", "<command-stdout>"]
INJECTED_MARKS = [
    "<system-reminder>",
    "Caveat: The messages below",
    "<user-memory-input>",
    "<task-notification>",
    "<task-prompt>",
    "<codex_internal_context",
    "<subagent_notification>",
    "# AGENTS.md instructions",
    "<local-command-stdout>",
    "This session is being continued from a previous conversation",
    "Base directory for this skill:",
]
SYNTHETIC_MARKS = [
    "You are in a development environment with full file system access",
    "## What the user asked for",
    "Build the project described below",
    "Filesystem sandboxing defines",
    "<permissions instructions>",
    "You are an autonomous",
    "You are a coding agent",
    "Your task is to build",
    "## Deliverable",
    "## Acceptance criteria",
    "Return ONLY",
    "respond with JSON",
    "<environment_details>",
    "<task>",
    "Review this change before it is pushed",
    "Complete a security review",
    "Focus on correctness, regressions, security issues",
    "Read-only critical audit",
    "Staff-engineer code review",
]
SYNTHETIC_HEAD, BRIEF_LENGTH = 600, 1500
BRIEF = r"(?i)^(you are\b|you're\b|read[- ]only\b|stop now\b|your task\b|your job\b|review the\b|audit\b|analyze the\b|return (only|a |the )|here is the\b|context:|task:|do not (revert|edit|touch)|work only in\b|you have been\b|act as\b|operate the\b|goal:|objective:)"
# Turns that start no task.
NO_TASK_MARKS = [
    "<task-notification>",
    "<subagent_notification>",
    "<command-stdout>",
    "<local-command-stdout>",
    "<user-memory-input>",
    "This session is being continued from a previous conversation",
    "[Your previous response had no visible output.",
]
NO_TASK_COMMAND = r"<command-name>/(?:clear|copy|effort|exit|login|mcp|model|plugin)</command-name>"
# Redaction rules by name, in the order in which they apply. Loops over groups
# give nothing back (*+, ++), so that they need no stack; the one over what stands in $( ) is
# told as parts up to each closing bracket for that, and ends at the last one of the line all the same.
# An email's name is looked for where such a run or the rest after a match begins only, for that ends at the same @ from anywhere in it.
REDACTIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "github-token": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,})\b",
    "aws-akid": r"\bAKIA[0-9A-Z]{16}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._-]{16,}",
    "private-key": r"-----BEGIN(?:[A-Z ]+)?PRIVATE KEY-----[\s\S]*?-----END(?:[A-Z ]+)?PRIVATE KEY-----",
    "assigned-secret": r"""(?i)(?<![A-Za-z0-9_-])(?:[A-Za-z_][A-Za-z0-9_-]*)?(?:api[_-]?key|secret|token|password|passwd|access[_-]?token|client[_-]?secret)(?![A-Za-z0-9_-])\+?=(?:\$\((?:\\.|[^)\\\r\n])*+\)(?:(?:\\.|[^)\\\r\n])*+\))*+|\$\{(?:\\.|[^}\\\r\n])*+\}|`(?:\\.|[^`\\\r\n])*+`|\$?'(?:\\.|[^'\\\r\n])*+'|\$?"(?:\\.|[^"\\\r\n])*+"|\\[^\r\n]|[^\s;&|<>()"'`\\\r\n])++""",
    "config-secret": r"""(?im)(?:^[ \t]*["']?(?:[A-Za-z_][A-Za-z0-9_-]*)?(?:api[_-]?key|secret|token|password|passwd|access[_-]?token|client[_-]?secret)(?![A-Za-z0-9_-])["']?[ \t]*[:=][ \t]*|["'](?:[A-Za-z_][A-Za-z0-9_-]*)?(?:api[_-]?key|secret|token|password|passwd|access[_-]?token|client[_-]?secret)["']\s*:\s*)["']?[A-Za-z0-9._\-]{12,}["']?""",
    "url-userinfo": r"(?i)\b[a-z][a-z0-9+.-]*+://[^\s/:@]+:[^\s/@]+@",
    "url-secret-param": r"""(?i)[?&](?:access[_-]?token|api[_-]?key|apikey|auth|token|secret|password|sig|signature)=[^&\s"'#)]+""",
}
# What stands in each text that a rule of REDACTIONS matches: one of each group at least, the last group's in any case.
_ASSIGNED = ("key", "secret", "token", "passw")
REDACTION_MARKS = {
    "email": (("@",), ()),
    "ipv4": ((".",), ()),
    "github-token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), ()),
    "aws-akid": (("AKIA",), ()),
    "slack-token": (("xox",), ()),
    "jwt": (("eyJ",), ()),
    "bearer": ((), ("bearer",)),
    "private-key": (("PRIVATE KEY-----",), ()),
    "assigned-secret": (("=",), _ASSIGNED),
    "config-secret": (("=", ":"), _ASSIGNED),
    "url-userinfo": (("://",), ()),
    "url-secret-param": (("?", "&"), ("token=", "key=", "auth=", "secret=", "password=", "sig=", "signature=")),
}
# Commands that verify, calls of curl and how they send something, tools that wait by design.
VERIFY_COMMAND = r"(?i)\b(?:pnpm|npm|yarn|bun)\s+(?:run\s+)?(?:test|typecheck|lint|build|check)(?::[A-Za-z0-9:_-]+)?\b|\b(?:vitest|jest|pytest|tsc|biome|eslint|sha256sum|pdfinfo|pdftotext)\b|\bgo\s+test\b|\bcargo\s+(?:test|check|clippy|build)\b|\bgit\s+(?:status|diff|show|merge-tree)\b|\bgh-drew\s+pr\s+(?:view|checks)\b"
CURL = r"(?i)\bcurl\b"
CURL_METHOD = [r"(?:^|\s)-X(?:=|\s*)([A-Za-z]+)\b", r"(?i)(?:^|\s)--request(?:=|\s+)([A-Za-z]+)\b"]
CURL_READS = r"(?i)^(?:GET|HEAD)$"
CURL_SENDS = r"(?i)(?:^|\s)-(?:d|F|T)(?:\S*|\s+\S+)|(?:^|\s)--(?:data(?:-ascii|-binary|-raw|-urlencode)?|form(?:-string)?|json|upload-file)(?:=|\s)"
WAITS = {"wait": r"\bcell_id\b[\"']?\s*:", "write_stdin": r"\bsession_id\b[\"']?\s*:"}
WAIT_AGENT, SHELL_TOOL = "wait_agent", "exec_command"

_START, _END = "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", "(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with \b between ASCII words, as other engines have it; Java's takes any letter for a word's."""
    return pattern.replace(r"\b", f"(?:{_START}|{_END})")


def matches(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(ascii_bounds(pattern)), F.lit(False))


def is_tool(kind: Column, tool: Column, name: Column) -> Column:
    return (F.coalesce(F.upper(kind), F.lit("")) == "TOOL") | tool.isNotNull() | name.startswith("tool.")


def action_kind(tool: Column, name: Column, is_tool_: Column, content: Column) -> Column:
    """verify, edit, read, tool, claim or other, the first that holds; words are looked for in a tool's name, the span's name and the content."""
    said = F.concat_ws(" ", F.coalesce(tool, F.regexp_replace(name, "^tool[.]", "")), name, F.coalesce(content, F.lit("")))
    return (
        F.when(is_tool_ & matches(said, VERIFY), "verify")
        .when(is_tool_ & matches(said, CHANGE), "edit")
        .when(is_tool_ & matches(said, READ), "read")
        .when(is_tool_, "tool")
        .when(matches(content, CLAIM), "claim")
        .otherwise("other")
    )


def reaction_labels(text: Column) -> Column:
    """All labels that hold, in the order listed."""
    return F.array_compact(F.array(*(F.when(matches(F.lower(text), pattern), F.lit(label)) for label, pattern in REACTIONS.items())))


def _holds(text: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.coalesce(text.contains(m), F.lit(False))
    return found


def injected(text: Column) -> Column:
    """Whether a program put the text in: marks anywhere, or of a made-up prompt at its head."""
    return _holds(text, COMMAND_MARKS + INJECTED_MARKS) | _holds(F.substring(text, 1, SYNTHETIC_HEAD), SYNTHETIC_MARKS)


def is_brief(text: Column) -> Column:
    """Whether a first turn reads like the brief of a spawned agent."""
    t = F.trim(text)
    return F.coalesce((F.length(t) > BRIEF_LENGTH) | matches(t, BRIEF), F.lit(False))


def actor(role: Column, text: Column, first: Column | None = None, sidechain: Column | None = None, meta: Column | None = None, user_type: Column | None = None) -> Column:
    """human, injected or subagent-spawn for a user's turn, else agent. first: whether it is the session's first user turn."""
    no = F.lit(False)
    of = lambda c: F.coalesce(c, no) if c is not None else no
    found = F.when(F.coalesce(role != "user", F.lit(True)), "agent").when(of(sidechain), "subagent-spawn").when(of(meta), "injected")
    if user_type is not None:
        found = found.when(user_type != "external", "injected")
    return found.when(injected(text), "injected").when(of(first) & is_brief(text), "subagent-spawn").otherwise("human")


def starts_task(text: Column, sidechain: Column | None = None, user_type: Column | None = None) -> Column:
    """Whether a user's turn starts a task that can be chosen; prompts that a program wrote may."""
    t = F.trim(F.coalesce(text, F.lit("")))
    out = (t == "") | _holds(t, NO_TASK_MARKS) | t.startswith("[Request interrupted by user") | t.rlike(NO_TASK_COMMAND) | t.startswith("Base directory for this skill:")
    out = out | (t.startswith("# AGENTS.md instructions") & ~t.contains("</INSTRUCTIONS>"))
    if sidechain is not None:
        out = out | F.coalesce(sidechain, F.lit(False))
    if user_type is not None:
        out = out | F.coalesce(user_type != "external", F.lit(False))
    return ~out


def redacted(text: Column, rules: dict[str, str] = REDACTIONS) -> Column:
    """The text with each rule's matches replaced by the rule's name."""
    for name, pattern in rules.items():
        text = F.regexp_replace(text, ascii_bounds(pattern), f"[{name}]")
    return text


def may_hold(text: Column, name: str, pattern: str) -> Column:
    """Whether a text has what each match of the rule holds (true for rules of others); far cheaper than the rule."""
    found = F.lit(True)
    if REDACTIONS.get(name) == pattern:
        plain, folded = REDACTION_MARKS[name]
        for group, of in ((plain, text), (folded, F.lower(text))):
            if group:
                found = found & reduce(Column.__or__, (of.contains(m) for m in group))
    return found


def with_redaction_counts(rows: DataFrame, text: str, rules: dict[str, str] = REDACTIONS) -> DataFrame:
    """The rows with the matches of each rule (null: null text), each in what the rules before it left.

    Each rule is a step of its own that reads the text of the one before; as one expression the
    rules before it would run again for every rule after. Texts without matches are not rewritten.
    """
    rows = rows.withColumn("__left", F.col(text))
    for name, pattern in rules.items():
        left, rule = F.col("__left"), ascii_bounds(pattern)
        rows = rows.withColumn(name, F.when(may_hold(left, name, pattern), F.regexp_count(left, F.lit(rule))).when(left.isNotNull(), 0))
        rows = rows.withColumn("__left", F.when(F.col(f"`{name}`") > 0, F.regexp_replace(left, rule, f"[{name}]")).otherwise(left))
    return rows.drop("__left")


def inferred_kind(declared: Column, span_type: Column, name: Column, model: Column, tool: Column) -> Column:
    """The declared kind if it is one of the seven, else by evidence, else UNKNOWN."""
    known = ["AGENT", "CHAIN", "LLM", "TOOL", "EVALUATOR", "RETRIEVER", "UNKNOWN"]
    low = F.lower(name)
    return (
        F.when(F.upper(declared).isin(known), F.upper(declared))
        .when(span_type.isin("tool.execution", "tool.blocked_on_user"), "CHAIN")
        .when(model.isNotNull(), "LLM")
        .when(tool.isNotNull(), "TOOL")
        .when((span_type == "llm_request") | low.contains("llm"), "LLM")
        .when((span_type == "tool") | low.contains("tool"), "TOOL")
        .when((span_type == "interaction") | low.contains("interaction") | low.contains("agent"), "AGENT")
        .otherwise("UNKNOWN")
    )


def status_code(raw: Column) -> Column:
    """OK, ERROR or UNSET; anything else is UNSET."""
    return F.when(raw.isin("STATUS_CODE_OK", "OK"), "OK").when(raw.isin("STATUS_CODE_ERROR", "ERROR"), "ERROR").otherwise("UNSET")


def is_expected_blocking(tool: Column, args: Column) -> Column:
    """Tools that wait by design: for an agent, or for a cell or session that the arguments name as a key."""
    found = tool == WAIT_AGENT
    for name, key in WAITS.items():
        found = found | ((tool == name) & matches(args, key))
    return F.coalesce(found, F.lit(False))


def reads_by_curl(command: Column) -> Column:
    """Whether a command calls curl and only reads: no other method than GET or HEAD, and nothing sent."""
    said = [F.nullif(F.regexp_extract(command, ascii_bounds(p), 1), F.lit("")) for p in CURL_METHOD]
    return matches(command, CURL) & F.coalesce(F.coalesce(*said).rlike(CURL_READS), F.lit(True)) & ~matches(command, CURL_SENDS)


def is_verification(command: Column) -> Column:
    """Whether a shell command verifies something, or reads a URL."""
    return matches(command, VERIFY_COMMAND) | reads_by_curl(command)


def nested_tool(tool: Column, command: Column) -> Column:
    """The tool's name; a shell command that verifies is a tool of its own."""
    return F.when((tool == SHELL_TOOL) & is_verification(command), F.lit(f"{SHELL_TOOL}.verify")).otherwise(tool)
