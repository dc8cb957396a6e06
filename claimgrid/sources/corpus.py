"""Change corpus projected from the star schema, row by row.

No rule matches the supplied prose, so change texts are templated from order
and customer rows. A customer is a session, its orders are the changes. The
expressions are plain SQL that Spark and DuckDB both run, and each output row
depends on one input row. Rows are dealt out by key before their texts are made:
only the few key columns are shuffled, and tables that arrive as one row group
still give every core its share of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROLE = (
    "CASE CAST(floor(({n}) / 18) AS BIGINT) % 3 "
    "WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'member' END"
)

# One sentence per extraction rule; {r} is the role expression.
SENTENCES = [
    "'Only organization owners can manage subscriptions.'",
    "'if (user.role === \"' || {r} || '\") {{ go(); }}'",
    "'User.role = \"' || {r} || '\";'",
    "'if (hasPermission(\"billing:' || {r} || '\")) pay();'",
    "'Every invoice must be checked by ' || {r} || '.'",
    "'Guests cannot view ' || {r} || ' pages.'",
    "'Only ' || {r} || ' users are allowed to refund orders.'",
    "'The API returns \"userId\" for ' || {r} || '.'",
    "'The consumer expects field user_' || {r} || '.'",
    "'function pay(order_' || {r} || ')'",
    "'email is required'",
    "'email field is optional'",
    "'{{ email?: string }}'",
    "'total: ' || CASE {r} WHEN 'owner' THEN 'number' ELSE 'string' END",
    "'user.email is always defined'",
    "'The mailer assumes every user has email'",
    "'Billing depends on the ' || {r} || ' service'",
    "'It calls charge(' || {r} || ')'",
]

PATHS = [
    "src/auth/roles.ts",
    "src/billing/permissions.ts",
    "src/events/payload.ts",
    "src/users/model.ts",
    "src/notifications/welcome-email.ts",
    "src/app/main.ts",
    "src/core/util.py",
]


def sentence(n: str, role: str) -> str:
    """Sentence for number ``n``, with ``role`` naming a column of ``ROLE``."""
    arms = " ".join(f"WHEN {i} THEN {s.format(r=role)}" for i, s in enumerate(SENTENCES))
    return f"CASE {n} % 18 {arms} END"


def role(n: str) -> str:
    return ROLE.format(n=n)


def path(n: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS))
    return f"CASE ({n}) % 7 {arms} END"


REQUIREMENT = (
    "CASE c_custkey % 5 "
    "WHEN 0 THEN 'Add organization billing. Only organization owners can manage subscriptions.' "
    "WHEN 1 THEN 'Every refund must be reviewed by ' || lower(c_mktsegment) || '. Guests cannot export reports.' "
    "WHEN 2 THEN 'Only admin users are allowed to refund orders.' "
    "WHEN 3 THEN '  ' || chr(9) "
    "ELSE 'Ok.' END"
)
LABEL = (
    "CASE o_orderstatus WHEN 'F' THEN 'feature/auth-roles' "
    "WHEN 'O' THEN 'feature/checkout' ELSE 'feature/invoice-flow' END"
)
CHANGE_ID = "'change-' || CAST(o_orderkey AS STRING)"
CONTENT = (
    "CASE o_orderkey % 11 WHEN 3 THEN '   ' WHEN 7 THEN '—' "
    f"ELSE {sentence('o_orderkey', 'r1')} END"
)

# Per snippet: the two sentence numbers, the path number, and the text around.
SNIPPETS = [
    {"n1": "o_orderkey * 7 + 3", "n2": "o_orderkey * 11 + 5", "at": "o_orderkey", "m1": "''", "m2": "''"},
    {"n1": "o_orderkey * 5 + 40", "n2": "o_orderkey * 5 + 22", "at": "o_orderkey + 3", "m1": "'-'", "m2": "'+'"},
]
SNIPPET_TEXT = f"m1 || {sentence('n1', 'r1')} || chr(10) || m2 || {sentence('n2', 'r2')}"
CONTEXT_NUMBER = "c_custkey * 13 + 2"
CONTEXT_TEXT = sentence("n1", "r1")


# Acceptance criteria: some are prefixes of claim statements, some are short.
CRITERION = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'The PRIVILEGED role is checked' "
    "WHEN 1 THEN 'Component calls' WHEN 2 THEN 'Field ''email'' is required for login' "
    "WHEN 3 THEN 'Refunds are paid within a week' WHEN 4 THEN 'API' "
    "ELSE 'Only ''owners'' may perform refunds' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *key: str, tasks: int | None = None) -> DataFrame:
    """Narrow rows, dealt by the hash of ``key`` over ``tasks`` partitions.

    The default is ``spark.sql.shuffle.partitions``. The number is fixed on purpose:
    adaptive execution would join these few bytes into one task again, and that task
    would then make and read all the texts.
    """
    number = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(number, *key)


def orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Orders cut to the columns a projection reads, dealt out."""
    return dealt(table(spark, sf_dir, "orders").select(*columns), "o_orderkey")


def customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer").select(*columns), "c_custkey")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, "c_custkey", "c_mktsegment").select(
        F.col("c_custkey").alias("session_id"), F.expr(REQUIREMENT).alias("requirement_text")
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderstatus")
    return rows.withColumn("r1", F.expr(role("o_orderkey"))).select(
        F.col("o_custkey").alias("session_id"),
        F.col("o_orderkey").alias("change_seq"),
        F.expr(CHANGE_ID).alias("change_id"),
        F.expr(LABEL).alias("label"),
        F.expr(CONTENT).alias("content"),
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(
        f"named_struct('snippet_seq', {i}, 'file_path', {path(s['at'])}, 'n1', {s['n1']}, "
        f"'n2', {s['n2']}, 'm1', {s['m1']}, 'm2', {s['m2']})"
        for i, s in enumerate(SNIPPETS)
    )
    picked = orders(spark, sf_dir, "o_orderkey", "o_custkey").select(
        F.col("o_custkey").alias("session_id"),
        F.col("o_orderkey").alias("change_seq"),
        F.expr(CHANGE_ID).alias("change_id"),
        F.lit("CODE_DIFF").alias("source_type"),
        F.expr(f"inline(array({rows}))"),
    )
    roles = picked.withColumns({"r1": F.expr(role("n1")), "r2": F.expr(role("n2"))})
    return roles.withColumn("content", F.expr(SNIPPET_TEXT)).drop("n1", "n2", "m1", "m2", "r1", "r2")


def context_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = customers(spark, sf_dir, "c_custkey").withColumn("n1", F.expr(CONTEXT_NUMBER))
    return numbered.withColumn("r1", F.expr(role("n1"))).select(
        F.col("c_custkey").alias("session_id"),
        F.lit(0).alias("doc_seq"),
        F.lit("docs/notes.md").alias("file_path"),
        F.lit("DOCUMENTATION").alias("source_type"),
        F.expr(CONTEXT_TEXT).alias("content"),
    )


# --- diff texts: one raw diff per order ----------------------------------------


def _head(p: str) -> str:
    return f"'diff --git a/' || {p} || ' b/' || {p} || chr(10)"


def _markers(p: str) -> str:
    return f"'--- a/' || {p} || chr(10) || '+++ b/' || {p} || chr(10)"


def _swap(header: str, old: str, new: str) -> str:
    return f"{header} || chr(10) || '-' || {old} || chr(10) || '+' || {new} || chr(10)"


# Columns: k a line number, p1/p2 paths, s1/s2 sentences.
_AT = "'@@ -' || k || ',2 +' || k || ',2 @@'"
RAW_DIFF = f"""CASE o_orderkey % 8
  WHEN 0 THEN {_head('p1')} || 'index 1..2 100644' || chr(10) || {_markers('p1')} || {_swap(_AT + " || ' fn()' || chr(10) || ' ctx'", 's1', 's2')}
  WHEN 1 THEN 'exported diff' || chr(10) || {_head('p1')} || {_markers('p1')} || {_swap(_AT, 's1', 's2')} || {_swap("'@@ -90 +91 @@ tail '", 's2', 's1')}
    || {_head('p2')} || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/' || p2 || chr(10) || '@@ -0,0 +1,2 @@' || chr(10) || '+' || s1 || chr(10) || '+' || s2 || chr(10)
  WHEN 2 THEN {_head('p1')} || 'deleted file mode 100644' || chr(10) || '--- a/' || p1 || chr(10) || '+++ /dev/null' || chr(10) || '@@ -1 +0,0 @@' || chr(10) || '-' || s1
  WHEN 3 THEN 'diff --git a/' || p1 || ' b/old/' || p1 || chr(10) || 'similarity index 100%' || chr(10) || 'rename from ' || p1 || chr(10) || 'rename to old/' || p1 || chr(10)
  WHEN 4 THEN 'diff --git a/' || p2 || ' b/new/' || p2 || chr(10) || 'rename from ' || p2 || chr(10) || 'rename to new/' || p2 || chr(10) || {_swap(_AT, 's1', 's2')}
  WHEN 5 THEN {_head("'img/' || o_orderkey || '.png'")} || 'Binary files a/img/1.png and b/img/1.png differ' || chr(10)
  WHEN 6 THEN {_markers('p1')} || {_swap(_AT, 's1', 's2')} || '--- a/' || p2 || chr(10) || '+++ /dev/null' || chr(10) || '@@ -1,1 +0,0 @@' || chr(10) || '-' || s2 || chr(10)
  ELSE 'No diff here: ' || s1 END"""
DIFF_BRANCH = "'feature/' || (o_orderkey % 3)"
DIFF_NUMBERS = {"n1": "o_orderkey * 7 + 3", "n2": "o_orderkey * 5 + 4"}


def raw_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = orders(spark, sf_dir, "o_orderkey", "o_custkey").select(
        F.col("o_custkey").alias("session_id"),
        F.col("o_orderkey").alias("diff_id"),
        F.expr(DIFF_BRANCH).alias("branch_name"),
        "o_orderkey",
        F.expr("o_orderkey % 50 + 1").alias("k"),
        F.expr(path("o_orderkey")).alias("p1"),
        F.expr(path("o_orderkey + 3")).alias("p2"),
        *(F.expr(n).alias(name) for name, n in DIFF_NUMBERS.items()),
    )
    roles = numbered.withColumns({"r1": F.expr(role("n1")), "r2": F.expr(role("n2"))})
    texts = roles.withColumns(
        {"s1": F.expr(sentence("n1", "r1")), "s2": F.expr(sentence("n2", "r2"))}
    )
    return texts.select("session_id", "diff_id", "branch_name", F.expr(RAW_DIFF).alias("raw"))


# The header under which a raw diff stands in an exported file.
EXPORT_HEADER = "'diff --git a/exports/' || diff_id || ' b/exports/' || diff_id || chr(10)"

# --- repositories: suppliers share four of them, orders are pushes to their branches ---

REPOSITORY = "'repo-' || ({n} % 4)"
PUSHED_BRANCH = "CASE o_orderkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'feature/a' WHEN 2 THEN 'feature/n' WHEN 3 THEN 'feature/r' ELSE 'feature/x' END"
PUSHED_SHA = "md5('push-' || o_orderkey) || substr(md5(CAST(o_orderkey AS STRING)), 1, 8)"
PROVIDER = "CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'github' ELSE 'local' END"
CLONE_URL = "'https://github.com/org/repo-' || (s_suppkey % 4)"
# Branches of a session, in declared order.
FEATURES = {0: ["feature/n", "feature/a"], 1: ["feature/r"]}


def repository_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = {k: "array(" + ", ".join(f"'{b}'" for b in names) + ")" for k, names in FEATURES.items()}
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("session_id"), F.expr(REPOSITORY.format(n="s_suppkey")).alias("repository"),
        F.expr(CLONE_URL).alias("clone_url"), F.expr(PROVIDER).alias("provider"), F.lit("main").alias("base_branch"),
        F.expr(f"CASE s_suppkey % 2 WHEN 0 THEN {both[0]} ELSE {both[1]} END").alias("feature_branches"),
        F.expr("timestamp '1996-01-01 12:00:00' + make_interval(0, 0, 0, CAST(s_suppkey % 1500 AS INT))").alias("at"),
    )


def ref_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderdate")
    return rows.select(
        F.expr(REPOSITORY.format(n="o_custkey")).alias("repository"), F.expr(PUSHED_BRANCH).alias("branch_name"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("event_id"), F.expr(PUSHED_SHA).alias("sha"),
    )


# --- changed-file rows: one per line item ---------------------------------------

FILE_PATH = "'src/p' || (l_partkey % 150) || CASE l_linenumber % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.PY' WHEN 2 THEN '.yaml' ELSE '/Dockerfile' END"
FILE_BRANCH = "'feature/' || lower(l_returnflag)"
FILE_PATCH = (
    "CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 5 THEN '  ' "
    "WHEN l_partkey % 100 = 0 THEN repeat('+é', CAST(l_quantity AS INT) * 250) "
    "ELSE '@@ -1 +1 @@' || chr(10) || '-' || l_partkey || chr(10) || '+é' || l_suppkey END"
)


# The same files with a text that some rules read.
SPOKEN_PATCH = (
    "CASE WHEN patch IS NULL OR trim(patch) = '' THEN patch "
    "WHEN length(path) % 3 = 0 THEN patch || chr(10) || 'role = ' || chr(39) || 'admin' || chr(39) "
    "WHEN length(path) % 3 = 1 THEN patch || chr(10) || 'role === ' || chr(39) || 'owner' || chr(39) ELSE patch END"
)


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"]
    return dealt(table(spark, sf_dir, "lineitem").select(*columns), *columns[:3]).select(
        F.col("l_suppkey").alias("session_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
        F.expr(FILE_BRANCH).alias("branch_name"),
        F.expr(FILE_PATH).alias("path"),
        F.lit("MODIFIED").alias("kind"),
        F.expr(FILE_PATCH).alias("patch"),
    )


# --- analyser responses and status events: one per event ------------------------

AGENT = (
    "CASE event_type WHEN 'view' THEN 'intent' WHEN 'click' THEN 'contract' "
    "WHEN 'purchase' THEN 'dependency' WHEN 'signup' THEN 'adversary' ELSE 'change' END"
)
_ITEM = (
    "'{\"statement\": \" Access by ' || event_type || ' \", \"value\": \"v' || user_id || '\", "
    "\"branch\": \"feature/a\", \"confidence\": ' || (value / 10) || ', \"line\": ' || (event_id % 5) || ', "
    "\"file\": \"src/' || event_type || '.ts\", \"evidence\": \"role = admin\"}'"
)
_SECOND = "'{\"statement\": \"Plain claim ' || user_id || '\", \"concept\": \"plain\", \"value\": \"x\", \"branch\": \"feature/b\"}'"
RESPONSE = f"""CASE event_id % 9
  WHEN 0 THEN 'Sorry, no JSON for ' || event_type
  WHEN 1 THEN '[' || {_ITEM} || ']'
  WHEN 2 THEN '{{\"claims\": [' || {_ITEM} || ']}}'
  WHEN 3 THEN '```json' || chr(10) || '{{\"assumptions\": [' || {_ITEM} || ', ' || {_SECOND} || ']}}' || chr(10) || '```'
  WHEN 4 THEN '{{\"assumptions\": [' || {_SECOND} || ', {{\"statement\": \"  \", \"value\": \"x\", \"branch\": \"feature/a\"}}]}}'
  WHEN 5 THEN '{{\"assumptions\": [{{\"statement\": \"s\", \"value\": 5, \"branch\": \"feature/a\"}}]}}'
  WHEN 6 THEN '{{\"assumptions\": [{{\"statement\": \"s\", \"value\": \"v\", \"branch\": \"main\"}}]}}'
  ELSE '{{\"assumptions\": [' || {_ITEM} || ', ' || {_SECOND} || ']}}' END"""
STATUS = (
    "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'INGESTING' "
    "WHEN 'click' THEN 'ANALYZING' WHEN 'purchase' THEN 'COMPLETE' ELSE 'ERROR' END"
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "event_id").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("response_id"),
        F.expr(AGENT).alias("agent"),
        F.lit("feature/a").alias("branch_a"),
        F.lit("feature/b").alias("branch_b"),
        F.expr(RESPONSE).alias("raw_text"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts", F.expr(STATUS).alias("status")
    )


# --- repository addresses and refs ----------------------------------------------

REPO_URL = """CASE page_id % 8 WHEN 0 THEN url
  WHEN 1 THEN 'https://github.com/org' || page_id || '/repo.git'
  WHEN 2 THEN ' https://GitHub.com/org/repo-' || page_id || '/ '
  WHEN 3 THEN replace(url, 'http://', 'https://')
  WHEN 4 THEN 'https://user:pw@github.com/org/' || page_id
  WHEN 5 THEN 'https://github.com:8443/org/' || page_id
  WHEN 6 THEN 'https://github.com/org/' || page_id || '/tree/main'
  ELSE 'https://github.com/o+g/' || page_id END"""
REF_NAME = """CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN 'feature/' || replace(p_name, ' ', '-')
  WHEN 2 THEN '-' || p_name WHEN 3 THEN 'a..' || p_partkey WHEN 4 THEN 'abc' || p_partkey
  WHEN 5 THEN 'ref~' || p_partkey ELSE '  ' END"""

# --- records with injected flaws, for the checks --------------------------------

FLAWED_CHANGE_ID = "CASE o_orderkey % 10 WHEN 1 THEN ' ' WHEN 2 THEN 'change-x' ELSE 'change-' || o_orderkey END"
FLAWED_LABEL = "CASE o_orderkey % 12 WHEN 3 THEN '' ELSE 'feature' END"
FLAWED_CONTENT = "CASE o_orderkey % 14 WHEN 5 THEN NULL ELSE 'text' END"
_ID = "lpad(CAST({n} AS STRING), 8, '0') || '-0000-4000-8000-000000000000'"

# Each record: source table, key column, and its columns by SQL expression.
EVIDENCE_RECORD = {
    "id": "l_orderkey * 10 + l_linenumber",
    "source": "CASE l_linenumber WHEN 2 THEN 'GUESS' ELSE 'FILE_CHANGE' END",
    "file_path": "CASE l_returnflag WHEN 'A' THEN '' ELSE 'src/a.ts' END",
    "line_start": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_quantity AS INT) - 1 END",
    "line_end": "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 25 END",
    "branch_name": "l_linestatus",
}
CHANGED_FILE_RECORD = {
    "id": "l_orderkey * 10 + l_linenumber",
    "path": "CASE l_linenumber WHEN 1 THEN '' ELSE 'src/a.ts' END",
    "kind": "CASE l_linenumber WHEN 2 THEN 'COPIED' WHEN 3 THEN 'RENAMED' ELSE 'MODIFIED' END",
    "previous_path": "CASE l_returnflag WHEN 'A' THEN 'src/b.ts' WHEN 'N' THEN '' ELSE NULL END",
    "additions": "CAST(l_quantity AS INT) - 3",
    "deletions": "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 0 END",
    "branch_name": "CASE l_linestatus WHEN 'O' THEN 'feature' ELSE '' END",
}
FINDING_RECORD = {
    "id": f"CASE o_orderkey % 5 WHEN 0 THEN 'id-' || o_orderkey ELSE {_ID.format(n='o_orderkey')} END",
    "title": "CASE o_orderkey % 7 WHEN 1 THEN '' WHEN 2 THEN repeat('t', 161) ELSE o_orderpriority END",
    "description": "o_orderstatus",
    "severity": "CASE o_orderstatus WHEN 'P' THEN 'INFO' ELSE 'HIGH' END",
    "category": "CASE o_orderkey % 4 WHEN 0 THEN 'STYLE' ELSE 'LOGIC' END",
    "affected": "CASE o_orderkey % 6 WHEN 0 THEN 0 ELSE 1 END",
    "proposed_resolution": "CASE o_orderkey % 3 WHEN 0 THEN 'fix' ELSE NULL END",
    "resolved_at": "CASE o_orderkey % 2 WHEN 0 THEN '2024-08-01T12:00:00.000Z' ELSE NULL END",
}
RESULT_RECORD = {
    "id": _ID.format(n="o_orderkey"),
    "schema_version": "CASE o_orderkey % 6 WHEN 0 THEN '1.0' ELSE '1.0.0' END",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'ERROR' END",
    "started_at": "CASE o_orderkey % 8 WHEN 0 THEN '2024-08-01' ELSE '2024-08-01T12:00:00Z' END",
    "completed_at": "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE '2024-08-01T12:30:00Z' END",
    "error_message": "CASE o_orderkey % 5 WHEN 0 THEN 'boom' ELSE NULL END",
}


def record(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).select(*(F.expr(e).alias(c) for c, e in columns.items()))

DEPENDENCY_RECORD = {
    "id": f"CASE l_linenumber WHEN 1 THEN '' ELSE {_ID.format(n='l_orderkey')} END",
    "line": "l_orderkey * 10 + l_linenumber",
    "from_file_path": "CASE l_returnflag WHEN 'A' THEN '' ELSE 'src/a.ts' END",
    "from_branch_name": "'main'",
    "to_file_path": "'src/b.ts'",
    "to_branch_name": "CASE l_linestatus WHEN 'O' THEN NULL ELSE 'feature' END",
    "kind": "CASE l_linenumber WHEN 2 THEN 'GUESS' WHEN 3 THEN 'EVENT' ELSE 'IMPORT' END",
    "is_cross_module": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 2 = 0 END",
}
SUMMARY_RECORD = {
    "id": "o_orderkey",
    "assumptions_found": "CASE o_orderkey % 9 WHEN 0 THEN NULL ELSE 5 END",
    "conflicts_found": "o_orderkey % 4",
    "conflicts_resolved": "o_orderkey % 5 - 1",
    "files_changed": "1",
    "requirement_coverage": "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderkey % 130 END",
}
CANDIDATE_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'DISMISSED' ELSE 'PENDING' END"
CRITERION_RECORD = {
    "id": "p_partkey",
    "key": "CASE p_partkey % 4 WHEN 0 THEN '' ELSE 'AC-' || p_partkey END",
    "description": "CASE p_partkey % 7 WHEN 0 THEN NULL ELSE p_name END",
}
BRANCH_RECORD = {
    "id": "c_custkey",
    "name": "CASE c_custkey % 5 WHEN 0 THEN '' ELSE 'feature/' || c_custkey END",
    "sha": "CASE c_custkey % 3 WHEN 0 THEN md5(c_name) || substr(md5(c_name), 1, 8) WHEN 1 THEN md5(c_name) ELSE NULL END",
}
DOMAIN_CLAIM_RECORD = {
    "id": f"CASE o_orderkey % 5 WHEN 0 THEN 'id-' || o_orderkey ELSE {_ID.format(n='o_orderkey')} END",
    "branch_name": "CASE o_orderstatus WHEN 'P' THEN '' ELSE 'main' END",
    "source_file": "'src/a.ts'",
    "statement": "o_orderpriority",
    "concept": "CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE 'order-priority' END",
    "value": "CASE o_orderkey % 11 WHEN 0 THEN NULL ELSE o_orderstatus END",
    "source_agent": "CASE o_orderkey % 6 WHEN 0 THEN 'nobody' ELSE 'change' END",
    "confidence": "CASE o_orderkey % 4 WHEN 0 THEN 'SURE' ELSE 'HIGH' END",
    "numeric_confidence": "CAST((o_orderkey % 13) AS DOUBLE) / 10",
    "extracted_at": "'2024-08-01T12:00:00.000Z'",
}
DRAFT_RECORD = {
    "id": _ID.format(n="o_orderkey"),
    "title": "CASE o_orderkey % 7 WHEN 1 THEN '' ELSE o_orderpriority END",
    "intent_summary": "o_orderstatus",
    "generated_at": "'2024-08-01T12:00:00.000Z'",
    "approved_by": "CASE o_orderkey % 2 WHEN 0 THEN 'someone' ELSE NULL END",
    "approved_at": "CASE o_orderkey % 3 WHEN 0 THEN '2024-08-01T12:00:00.000Z' ELSE NULL END",
    "verification_result_id": "CAST(o_custkey AS VARCHAR(20))",
    "embedded_result_id": "CASE o_orderkey % 4 WHEN 0 THEN 'other' ELSE CAST(o_custkey AS VARCHAR(20)) END",
}
CANDIDATE_RECORD = {
    "id": "o_orderkey",
    "candidate_id": "CASE o_orderkey % 6 WHEN 0 THEN ' ' ELSE 'c' || o_orderkey END",
    "conflict_type": "CASE o_orderkey % 5 WHEN 0 THEN 'STYLE' ELSE 'CONTRACT' END",
    "estimated_severity": "CASE o_orderstatus WHEN 'P' THEN 'DIRE' ELSE 'HIGH' END",
    "confidence": "'LOW'",
    "status": "CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE 'PENDING' END",
    "affected_entity": "o_orderpriority",
    "pairing_rationale": "CASE o_orderkey % 8 WHEN 0 THEN '' ELSE 'same' END",
    "left_subject": "' User '",
    "right_subject": "CASE o_orderkey % 3 WHEN 0 THEN 'Order' ELSE 'uSER' END",
}
COUNTED_RECORD = {
    "result_id": "o_orderkey",
    "assumptions_found": "o_orderkey % 8",
    "conflicts_found": "1",
    "critical": "0",
    "high": "o_orderkey % 2",
    "medium": "CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE 0 END",
    "low": "0",
}
FEATURE_REQUEST_RECORD = {
    "id": f"CASE o_orderkey % 9 WHEN 0 THEN 'request-' || o_orderkey ELSE {_ID.format(n='o_orderkey')} END",
    "title": "CASE o_orderkey % 7 WHEN 1 THEN '' ELSE o_orderpriority END",
    "description": "CASE o_orderkey % 11 WHEN 4 THEN NULL ELSE 'text' END",
    "created_at": "CASE o_orderkey % 5 WHEN 0 THEN '2024-08-01 12:00' ELSE '2024-08-01T12:00:00Z' END",
    "submitted_by": "CASE o_orderstatus WHEN 'P' THEN '' ELSE 'someone' END",
}
REPOSITORY_RECORD = {
    "key": "c_custkey",
    "id": f"CASE c_custkey % 9 WHEN 0 THEN 'repository-' || c_custkey ELSE {_ID.format(n='c_custkey')} END",
    "name": "CASE c_custkey % 4 WHEN 0 THEN '' ELSE c_name END",
    "clone_url": "CASE c_custkey % 6 WHEN 0 THEN NULL ELSE 'https://github.com/org/repo' END",
    "provider": "CASE c_custkey % 5 WHEN 0 THEN '' ELSE 'github' END",
    "feature_branches": "CASE c_custkey % 3 WHEN 0 THEN NULL ELSE split('feature/a,feature/b', ',') END",
    "resolved_at": "CASE c_custkey % 8 WHEN 0 THEN 'yesterday' ELSE '2024-08-01T12:00:00Z' END",
}

# --- rule sets as data: (rule_set, place, rule_id, category, confidence, pattern, ignore_case, triggers, templates) ---

RULE_SET = "CASE c_custkey % 2 WHEN 0 THEN 'roles' ELSE 'fields' END"
RULE_ROWS = [
    ("roles", 0, "own:role", "AUTHORIZATION", "HIGH", r"role\s*={1,3}\s*[\"'](\w+)[\"']", False, ["role"],
     "user_role", "allowed_role = {1|lower}", "Role is {1}"),
    ("roles", 1, "own:only", "AUTHORIZATION", "LOW", r"only (\w+) users? (?:are|is) allowed to (\w+)", True, ["only"],
     "{2|key}", "allowed_actor = {1|lower}", "{1} may {2}"),
    ("fields", 0, "own:required", "SCHEMA", "MEDIUM", r"(\w+) is required", True, ["required"],
     "{1|key}", "is_required = true", "{1} must be given"),
    ("fields", 1, "own:depends", "DEPENDENCY", "LOW", r"(\w+) depends on the (\w+) service", True, ["depends"],
     "{1|key}", "needs = {2}", "{1} needs {2}"),
]

# --- nested records as JSON lines, some of them broken ---

RESULT_SCHEMA = (
    "id bigint, status string, source struct<name:string,branches:array<struct<name:string,sha:string>>>, "
    "counts map<string,bigint>, findings array<struct<id:string,severity:string,claims:array<string>>>"
)
_SEVERITY = "CASE o_orderstatus WHEN 'F' THEN 'HIGH' ELSE 'LOW' END"
RESULT_JSON = f"""CASE o_orderkey % 13
  WHEN 5 THEN '{{"id": ' || o_orderkey || ', "status": "cut'
  WHEN 6 THEN '{{"id": "' || o_orderkey || 'x", "status": "PASS"}}'
  WHEN 7 THEN '{{"id": ' || o_orderkey || ', "findings": [{{"id": "f", "claims": "none"}}]}}'
  WHEN 8 THEN '{{"id": ' || o_orderkey || ', "more": 1, "source": null, "findings": []}}'
  ELSE '{{"id": ' || o_orderkey || ', "status": "' || o_orderstatus || '", "source": {{"name": "r\u00e9po", "branches": [{{"name": "feature/' ||
    (o_orderkey % 3) || '", "sha": null}}, {{"name": "main"}}]}}, "counts": {{"high": ' || (o_orderkey % 4) || '}}, "findings": [{{"id": "f-' ||
    o_custkey || '", "severity": "' || {_SEVERITY} || '", "claims": ["a", "b' || o_custkey || '"]}}]}}' END"""
