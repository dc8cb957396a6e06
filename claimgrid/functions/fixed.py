"""Fixed values of the claim model: patterns, word lists, tables and texts.

Results depend on these exact values, so they are stated here as plain data and
used by name everywhere else.
"""

from __future__ import annotations

# --- enums -----------------------------------------------------------------

CONFLICT_TYPES = ["BUSINESS_RULE", "CONTRACT", "DEPENDENCY"]
SEVERITIES = ["HIGH", "MEDIUM", "LOW", "INFO"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]
SOURCE_TYPES = ["REQUIREMENT", "CODE_DIFF", "FILE_SNIPPET", "DOCUMENTATION", "TEST"]
CANDIDATE_STATUSES = ["PENDING", "CONFIRMED", "DISMISSED"]
CATEGORIES = ["AUTHORIZATION", "BUSINESS_RULE", "CONTRACT", "SCHEMA", "DEPENDENCY"]

EVIDENCE_SOURCES = [
    "SOURCE_CODE", "TEST", "COMMENT", "CONFIG", "SCHEMA", "INFERRED", "FILE_CHANGE",
]
FINDING_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
FINDING_CATEGORIES = [
    "BUSINESS_RULE", "CONTRACT", "DEPENDENCY", "DATA_SCHEMA",
    "TEST_EXPECTATION", "LOGIC", "SECURITY", "CONFIGURATION",
]
RESULT_STATUSES = ["PENDING", "IN_PROGRESS", "PASS", "FAIL", "CANCELLED", "ERROR"]
TERMINAL_STATUSES = ["PASS", "FAIL", "CANCELLED", "ERROR"]
AGENT_TYPES = ["intent", "contract", "dependency", "adversary", "change"]
CHANGE_KINDS = ["ADDED", "MODIFIED", "DELETED", "RENAMED"]
DEPENDENCY_KINDS = [
    "IMPORT", "FUNCTION_CALL", "TYPE_EXTENDS", "SHARED_STATE", "EVENT",
    "DATA_REFERENCE", "OTHER",
]

# --- sizes ----------------------------------------------------------------

MIN_SEGMENT_LENGTH = 5
AGENT_PART_CHARS = 12_000

# --- extraction ------------------------------------------------------------

SEGMENT_BREAK = r"[.;\n]"

RULE_PATTERNS = {
    "auth:only_role_can_action": r"only\s+(?:(?:organization|org)\s+)?(\w+s?)\s+(?:can|may)\s+([\w\s]+?)(?:\.|$)",
    "auth:role_check_equality": r"""(?:user\.)?role\s*={2,3}\s*['"`](\w+)['"`]""",
    "auth:role_assignment": r"""(?:user\.)?role\s*[:=]\s*['"`](\w+)['"`]""",
    "auth:permission_check": r"""has(?:Permission|Role|Access)\s*\(\s*['"`]?([\w:_-]+)['"`]?\s*\)""",
    "biz:must_requirement": r"""([\w\s]{3,40}?)\s+must(?:\s+be)?\s+([\w\s'"`]{2,60}?)(?:\.|,|$)""",
    "biz:cannot_requirement": r"""([\w\s]{3,40}?)\s+(?:cannot|can't|should\s+not|must\s+not)\s+([\w\s'"`]{2,60}?)(?:\.|,|$)""",
    "biz:only_x_allowed": r"only\s+([\w\s]{2,30}?)\s+(?:are|is)\s+allowed\s+to\s+([\w\s]{2,50}?)(?:\.|,|$)",
    "contract:field_name": r"""(?:returns?|responds?\s+with)\s+['"`]([\w_]+)['"`]|field(?:\s+(?:is\s+)?named?)?(?:\s*:)?\s+['"`]?([\w_]+)['"`]?""",
    "contract:expects_field": r"""expects?\s+(?:field\s+['"`]?([\w_]+)['"`]?|['"`]([\w_]+)['"`])""",
    "contract:function_signature": r"(?:function|method|def)\s+([\w]+)\s*\(([^)]{0,80})\)",
    "schema:field_required": r"(?:([\w_]+)\s+(?:field\s+)?is\s+(?:required|mandatory|not\s+nullable|non-?null))|(?:required\s*:\s*([\w_]+))",
    "schema:field_optional": r"(?:([\w_]+)\s+(?:field\s+)?is\s+(?:optional|nullable|can\s+be\s+null))|(?:optional\s*:\s*([\w_]+))",
    "schema:field_optional_property": r"(?:^|[\s,;{(])([A-Za-z_][\w_]*)\?\s*:",
    "schema:field_type": r"(?:([\w_]+)\s*:\s*(string|number|boolean|Date|int|integer|uuid|text|bigint|float))|(?:type\s+of\s+([\w_]+)\s+is\s+(string|number|boolean|Date|int|integer|uuid|text|bigint|float))",
    "dep:field_always_present": r"([A-Za-z_][\w.]*)\s+is\s+always\s+(?:present|available|defined)\b",
    "dep:assumes_field_present": r"assumes?\s+(?:every\s+\w+\s+has\s+|[\w\s.]+?\s+is\s+always\s+(?:present|available|defined))([\w\s]{0,40}?)(?:\.|,|$)",
    "dep:depends_on_service": r"(?:depends?\s+on|relies?\s+on)\s+(?:the\s+)?([\w\s]{2,40}?)(?:\s+service|\s+module|\s+api)?(?:\.|,|$)",
    "dep:calls_service": r"(?:calls?|invokes?)\s+([\w.]+)\s*\(",
}
CASE_SENSITIVE_RULES = ["schema:field_optional_property"]
FIELD_NOUN = r"\b(email|phone|name|address|id|token|key)\b"

# Category hints: (words, hint), tried in order on the lower-cased label or path.
REQUIREMENT_HINTS = [("role|permission|access|auth|owner|admin", "AUTHORIZATION")]
REQUIREMENT_DEFAULT_HINT = "BUSINESS_RULE"
CHANGE_HINTS = [
    ("auth|role|permission|login|access", "AUTHORIZATION"),
    ("api|contract|endpoint|response|request|field|payload", "CONTRACT"),
    ("schema|model|database|db|migration|column|table", "SCHEMA"),
    ("depend|service|notif|email|send|import|inject", "DEPENDENCY"),
    ("billing|payment|subscription|invoice", "BUSINESS_RULE"),
]

# --- normalisation ---------------------------------------------------------

FILLER_WORDS = ["the", "a", "an", "property", "attribute"]

ENTITY_SYNONYMS = [
    (
        "user_role",
        ["user role", "user.role", "role", "userrole", "user_role", "owner role",
         "admin role", "member role", "organization role", "org role"],
        "Normalized role-related entity variants to canonical 'user_role'",
    ),
    (
        "subscription_management",
        ["manage subscriptions", "manage subscription", "subscription management",
         "manage billing", "billing management", "organization subscription management",
         "organization_subscription_management"],
        "Normalized subscription management action variants",
    ),
    (
        "email",
        ["email address", "email_address", "user email", "user_email"],
        "Normalized email field variants to canonical 'email'",
    ),
    (
        "user_id",
        ["userid", "user id", "user_id", "userId"],
        "Normalized user identifier field variants to canonical 'user_id'",
    ),
    (
        "organization_id",
        ["orgid", "org id", "org_id", "organizationid", "organization id"],
        "Normalized organization identifier variants",
    ),
]
ENTITY_CHANGED = "Normalized entity: stripped filler words and standardized separators"

KEY_SYNONYMS = [
    (
        "required_role",
        ["allowed_role", "assigned_role", "required_role", "role_required",
         "role_allowed", "role_check", "role"],
        "Normalized role predicate key variants to 'required_role'",
    ),
    (
        "is_required",
        ["is_required", "required", "mandatory", "not_nullable", "non_null",
         "must_exist", "always_present"],
        "Normalized required-field predicate key variants to 'is_required'",
    ),
    (
        "field_name",
        ["field_name", "field", "expected_field", "response_field", "api_field",
         "param_name"],
        "Normalized API/contract field predicate key variants to 'field_name'",
    ),
]
TRUE_WORDS = ["true", "yes", "1", "on", "enabled"]
FALSE_WORDS = ["false", "no", "0", "off", "disabled"]
HUMPED_IDENTIFIER = r"^[A-Za-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$"

# --- classification --------------------------------------------------------

ROLE_SUBJECT = "role|permission|access|auth"
ROLE_KEYS = ["required_role", "role"]
RULE_KEY = "must_be|prohibited|allowed_actor"
CONTRACT_SUBJECT = "api|field|response|request|endpoint|payload|param|signature"
CONTRACT_KEY = "field_name|expected_field|response_field|type|signature"
DEPENDENCY_KEY = "is_required|always_present|dependency_required|must_exist"
ROLE_WORDS = [
    "owner", "admin", "member", "manager", "viewer", "editor", "superuser", "moderator",
]
SEVERITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "INFO": 3}

# Texts: {e} entity, {l}/{r} values, {ll}/{rl} source labels, {ls}/{rs} presence.
TITLES = {
    "BUSINESS_RULE": "Authorization contradiction on '{e}'",
    "CONTRACT": "Contract mismatch on '{e}'",
    "DEPENDENCY": "Dependency assumption conflict on '{e}'",
}
WHY = {
    "BUSINESS_RULE": (
        "'{ll}' assumes that the privileged value for '{e}' is '{l}', but '{rl}' assumes it is "
        "'{r}'. Both cannot be true simultaneously. At runtime, one side will grant access while "
        "the other denies it, depending on which code path executes."
    ),
    "CONTRACT": (
        "'{ll}' produces or expects '{l}' for '{e}', but '{rl}' produces or expects '{r}'. When "
        "these components interact, the receiver will look for a field or type that the sender "
        "does not provide, causing a runtime failure."
    ),
    "DEPENDENCY": (
        "'{ll}' treats '{e}' as {ls}, but '{rl}' treats it as {rs}. Any code path that reaches "
        "'{rl}' after '{ll}' has set '{e}' to absent will fail when it attempts to use '{e}'."
    ),
}
PRESENT = "required (always present)"
ABSENT = "optional (may be absent)"
HINTS = {
    "BUSINESS_RULE": (
        "1. Search the codebase for every reference to '{e}' and confirm which value ('{l}' or "
        "'{r}') the requirement intends. 2. Add a regression test that asserts the incorrect "
        "value is explicitly rejected. 3. Check '{ll}' and '{rl}' for any other role/permission "
        "references that may carry the same inconsistency."
    ),
    "CONTRACT": (
        "1. Open '{ll}' and '{rl}' side by side and confirm the expected field name or type for "
        "'{e}'. 2. Run the integration test suite between these two components — a test that "
        "calls the producer and asserts the consumer field will fail. 3. If no such integration "
        "test exists, add one that covers this boundary."
    ),
    "DEPENDENCY": (
        "1. Search all callers that use '{e}' from '{rl}' and verify they handle the absent case. "
        "2. Add a unit test that exercises the code path in '{rl}' with '{e}' absent. 3. If '{e}' "
        "is intentionally optional, update '{rl}' to guard against null/undefined before use."
    ),
}
EXPLANATIONS = {
    "BUSINESS_RULE": (
        "Business rule conflict on '{e}': one change assumes '{l}' while another assumes '{r}'. "
        "If both are in production simultaneously, authorization checks will disagree and access "
        "control will behave inconsistently."
    ),
    "CONTRACT": (
        "Contract conflict on '{e}': one component produces/uses '{l}' while another expects "
        "'{r}'. This mismatch will cause runtime failures when the components interact."
    ),
    "DEPENDENCY": (
        "Dependency conflict on '{e}': {d}Components that assume presence will fail at runtime "
        "when the value is absent."
    ),
}
MADE_OPTIONAL = (
    "one change makes '{e}' optional, but another component depends on it always being present. "
)
MADE_REQUIRED = (
    "one change requires '{e}' to always be present, but another component treats it as optional. "
)

# --- numbers shown for labels ----------------------------------------------

CLAIM_CONFIDENCE = {"HIGH": 0.9, "MEDIUM": 0.7, "LOW": 0.4}
DISPLAY_CONFIDENCE = {"HIGH": 90, "MEDIUM": 65, "LOW": 40}
DEFAULT_AGENT_CONFIDENCE = 0.6
NODE_TIER = {"REQUIREMENT": 0, "CHANGE": 1, "ASSUMPTION": 2, "FILE": 3, "CONFLICT": 4}
STAGES = ["PENDING", "INGESTING", "ANALYZING", "VERIFYING", "COMPLETE"]
NOT_KNOWN = "—"

# --- language by file extension --------------------------------------------

LANGUAGES = {
    "typescript": ["ts", "tsx", "mts", "cts"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py"],
    "ruby": ["rb"],
    "go": ["go"],
    "rust": ["rs"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
    "csharp": ["cs"],
    "cpp": ["cpp", "cc", "cxx", "c", "h", "hpp"],
    "sql": ["sql"],
    "yaml": ["yml", "yaml"],
    "json": ["json", "jsonc"],
    "toml": ["toml"],
    "markdown": ["md", "mdx"],
    "css": ["css", "scss", "sass", "less"],
    "html": ["html", "htm"],
    "shell": ["sh", "bash"],
    "dockerfile": ["dockerfile"],
    "terraform": ["tf"],
    "protobuf": ["proto"],
}

# --- diff line formats -----------------------------------------------------

FILE_HEADER = r"^diff --git a/(.+?) b/(.+)$"
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)"
BINARY_LINE = r"^Binary files? .+ differ$"
