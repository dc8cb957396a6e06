"""Per-session verdicts, counts, coverage and passports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.functions.rulings import is_auth
from claimgrid.operators import repeats
from claimgrid.operators.pairing import GROUP_KEY, conflicts_from_pairable, pairable
from claimgrid.session import stage


# Characters of the keys through which criteria find statements.
KEY_CHARS = 8
# Distinct keys (8 bytes each) that are broadcast at most.
BROADCAST_KEYS = 500_000


def _pairs_of(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def conflict_counts(merged: DataFrame) -> DataFrame:
    """Conflicts per session and severity, counted without forming a pair.

    In a group of n distinct values every two contradict, and a pair's severity
    depends on few facts about its sides: how many values are role words, are
    true or false, or have strong evidence. So counts per group are enough, and
    a hot group costs one aggregate row instead of n squared pairs.

    Claims whose ids meet in a session (unit ids that differ in punctuation only)
    give no conflict or share one. Only groups that hold such an id are paired,
    by the same steps as ``conflicts_from_merged``, so both always agree. Hashes of the
    ids are counted to tell them, and where none comes twice, claims are only grouped. The
    pairable claims feed all these steps and are staged once.
    """
    return counts_of_pairable(stage(pairable(merged), "countable"))


def counts_of_pairable(claims: DataFrame) -> DataFrame:
    """``conflict_counts`` of pairable claims that the caller has staged."""
    alone, shared = repeats.split(claims, ["session_id", "claim_id"])
    if shared is None:
        return _group_counts(claims)
    if alone is None:
        ids = claims.groupBy("session_id", "claim_id").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        shared = claims.join(ids, ["session_id", "claim_id"], "left_semi")
    met = shared.select(*GROUP_KEY).distinct()
    paired = conflicts_from_pairable(claims.join(met, GROUP_KEY, "left_semi"))
    by_pair = paired.groupBy("session_id").agg(
        F.count("*").alias("conflicts_found"),
        *(F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("high", "medium", "low")),
    )
    by_group = _group_counts(claims.join(met, GROUP_KEY, "left_anti"))
    names = ("conflicts_found", "high", "medium", "low")
    return by_group.unionByName(by_pair).groupBy("session_id").agg(*(F.sum(n).alias(n) for n in names))


def conflict_groups(merged: DataFrame) -> DataFrame:
    """Groups of contradicting values, one row each: the conflicts without their pairs."""
    return (
        pairable(merged).groupBy(*GROUP_KEY, "conflict_type").agg(F.count("*").alias("n_values"))
        .filter("n_values > 1").withColumn("n_pairs", _pairs_of(F.col("n_values")))
    )


def _group_counts(claims: DataFrame) -> DataFrame:
    """Conflicts per session of groups whose claim ids are all different."""
    value = F.col("canonical_value")
    groups = (
        claims
        .groupBy(*GROUP_KEY, "conflict_type")
        .agg(
            F.count("*").alias("n"),
            F.count_if(value.isin(fixed.ROLE_WORDS)).alias("n_roles"),
            F.count_if(value == "true").alias("n_true"),
            F.count_if(value == "false").alias("n_false"),
            F.count_if(F.col("quality") >= 2).alias("n_strong"),
            F.count_if(F.col("quality") >= 1).alias("n_some"),
            F.count_if(value.isin("true", "false") & (F.col("quality") >= 2)).alias("n_strong_flip"),
        )
        .filter("n > 1")
        .withColumn("pairs", _pairs_of(F.col("n")))
    )
    flips = F.col("n_true") * F.col("n_false")
    # A left predicate can name required_role in its value only, but then that
    # value is no role word or boolean, so the pair is not direct.
    auth = is_auth(predicate="canonical_key")
    kind = F.col("conflict_type")
    high = (
        F.when((kind == "BUSINESS_RULE") & auth, flips + _pairs_of(F.col("n_roles")))
        .when(kind == "BUSINESS_RULE", F.lit(0))
        .when(kind == "CONTRACT", _pairs_of(F.col("n_strong")))
        .otherwise(F.when(F.col("n_strong_flip") == 2, 1).otherwise(0))
    )
    low = F.when(kind == "CONTRACT", F.col("pairs") - _pairs_of(F.col("n_some"))).otherwise(0)
    scored = groups.withColumns({"n_high": high, "n_low": low}).withColumn(
        "n_medium", F.col("pairs") - F.col("n_high") - F.col("n_low")
    )
    return scored.groupBy("session_id").agg(
        F.sum("pairs").alias("conflicts_found"),
        F.sum("n_high").alias("high"),
        F.sum("n_medium").alias("medium"),
        F.sum("n_low").alias("low"),
    )


def severity_counts(sessions: DataFrame, counts: DataFrame) -> DataFrame:
    """Every session with all four severities, zero where there is none."""
    joined = sessions.select("session_id").join(counts, "session_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "session_id",
        zero.alias("critical"),
        *(F.coalesce(c, zero).alias(c) for c in ("high", "medium", "low", "conflicts_found")),
    )


def claim_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("session_id").agg(F.count("*").alias("claims_found"))


def session_results(sessions: DataFrame, claim_counts: DataFrame, counts: DataFrame) -> DataFrame:
    """Verdict and summary sentence of every session, also of silent ones."""
    found = F.col("conflicts_found")
    joined = (
        sessions.select("session_id")
        .join(claim_counts, "session_id", "left")
        .join(counts.select("session_id", "conflicts_found", "high"), "session_id", "left")
        .fillna(0, ["claims_found", "conflicts_found", "high"])
    )
    sentence = F.when(
        found > 0,
        F.concat(
            found.cast("string"), F.lit(" semantic conflict(s) detected. "),
            F.col("claims_found").cast("string"), F.lit(" assumptions extracted."),
        ),
    ).otherwise(
        F.concat(
            F.lit("No semantic conflicts detected. "), F.col("claims_found").cast("string"),
            F.lit(" assumptions extracted and all agree."),
        )
    )
    return joined.select(
        "session_id", "claims_found", "conflicts_found",
        F.when(found > 0, "CONFLICTS_FOUND").otherwise("PASS").alias("status"),
        sentence.alias("summary"),
        (found > 0).alias("has_conflicts"),
        F.col("high").alias("high_severity_conflicts"),
    )


def finding_status(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """PASS or FAIL from findings: open ones fail, resolved ones do not."""
    severities = [
        F.count_if(F.col("severity") == s).alias(s.lower()) for s in fixed.FINDING_SEVERITIES
    ]
    per_session = findings.groupBy("session_id").agg(
        F.count("*").alias("conflicts_found"),
        F.count_if(F.col("proposed_resolution").isNotNull()).alias("conflicts_resolved"),
        *severities,
    )
    names = ["conflicts_found", "conflicts_resolved", *(s.lower() for s in fixed.FINDING_SEVERITIES)]
    joined = sessions.select("session_id").join(per_session, "session_id", "left").fillna(0, names)
    open_left = F.col("conflicts_resolved") < F.col("conflicts_found")
    return joined.withColumn("status", F.when(open_left, "FAIL").otherwise("PASS"))


def verification_summary(
    sessions: DataFrame, claim_counts: DataFrame, counts: DataFrame, files_changed: DataFrame, coverage: DataFrame
) -> DataFrame:
    """Everything a finished verification reports of a session, in one row."""
    joined = severity_counts(sessions, counts)
    for table in (claim_counts, files_changed):
        joined = joined.join(table, "session_id", "left")
    joined = joined.join(coverage.select("session_id", "requirement_coverage"), "session_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "session_id", F.coalesce("claims_found", zero).alias("claims_found"), "conflicts_found",
        zero.alias("conflicts_resolved"), F.coalesce("files_changed", zero).alias("files_changed"), "requirement_coverage",
        "critical", "high", "medium", "low",
        F.when(F.col("conflicts_found") > 0, "FAIL").otherwise("PASS").alias("status"),
    )


def result_stats(sessions: DataFrame, claim_counts: DataFrame, candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Claims, candidates, confirmed conflicts and dismissed candidates of every session."""
    joined = sessions.select("session_id")
    for table in (claim_counts, candidates, counts.select("session_id", "conflicts_found")):
        joined = joined.join(table, "session_id", "left")
    names = ("claims_found", "candidates", "conflicts_found", "dismissed")
    return joined.select("session_id", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names))


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """Candidates per session and how many were dismissed or confirmed."""
    return candidates.groupBy("session_id").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"),
        F.count_if(F.col("status") == "DISMISSED").alias("dismissed"),
    )


# --- requirement coverage ------------------------------------------------------


def _last_start(text: Column, width: Column) -> Column:
    """Where the last piece of ``width`` characters begins; a width of 0 has one piece, the empty one."""
    return F.when(width == 0, 1).otherwise(F.length(text) - width + 1)


def _hash_at(text: Column, start: Column, width: Column) -> Column:
    return F.xxhash64(F.substring(text, start, width))


def _tile_hashes(text: Column, width: Column) -> Column:
    """Hashes of the distinct pieces of ``width`` characters that cover the text, one beside the other and the last at its end."""
    last = _last_start(text, width)
    starts = F.concat(F.sequence(F.lit(1), last, F.greatest(width, F.lit(1))), F.array(last))
    return F.array_distinct(F.transform(starts, lambda i: _hash_at(text, i, width)))


def _semi(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` whose key is wanted; the wanted keys are broadcast up to a counted number of them."""
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(wanted) if few else wanted, key, "left_semi")


def covered_criteria(criteria: DataFrame, statements: DataFrame) -> DataFrame:
    """Each criterion with ``covered``: does a statement of its session contain
    its description, ignoring case?

    ``criteria(session_id, criterion_key, description)`` and
    ``statements(session_id, statement)``. Containment goes through an inverted
    index of keys, pieces of ``KEY_CHARS`` characters (shorter criteria are a key
    themselves). The keys of a criterion lie side by side and cover it whole; a statement
    that contains it has each of them, wherever it begins there, so all pieces of a
    statement are looked up. The index holds hashes only: keys of statements that some criterion
    of the session has. Counting them tells each criterion's rarest key; a criterion
    with a key that no statement has is not covered. The rarest keys are joined to
    the index, and only for what meets there the texts are fetched and compared.
    """
    asked = criteria.withColumn("wanted", F.lower("description"))
    wanted = (
        asked.select("session_id", "wanted").distinct().filter("wanted is not null")
        .withColumns({"wanted_id": F.xxhash64("wanted"), "width": F.least(F.length("wanted"), F.lit(KEY_CHARS))})
    )
    keys = stage(
        wanted.select("session_id", "wanted_id", "width", F.explode(_tile_hashes(F.col("wanted"), F.col("width"))).alias("key")),
        "criterion-keys",
    )
    widths = keys.groupBy("session_id").agg(F.collect_set("width").alias("widths"))
    texts = (
        statements.select("session_id", F.lower("statement").alias("text")).distinct().filter("text is not null")
        .withColumn("text_id", F.xxhash64("text"))
    )
    texts = stage(texts, "statements")
    text, width = F.col("text"), F.col("width")
    pieces = (
        texts.join(widths, "session_id").select("session_id", "text_id", "text", F.explode("widths").alias("width"))
        .filter(F.length("text") >= width)
        # Places are made to rows before their pieces are hashed, since array functions aren't compiled.
        .select("session_id", "text_id", "text", "width", F.explode_outer(F.sequence(F.lit(1), _last_start(text, width))).alias("start"))
        .select("session_id", "text_id", _hash_at(text, F.col("start"), width).alias("key"))
    )
    index = _semi(pieces, keys.select("key").distinct(), ["key"])
    index = index.join(keys.select("session_id", "key").distinct(), ["session_id", "key"], "left_semi").distinct()
    index = stage(index, "statement-keys")
    counted = index.groupBy("session_id", "key").agg(F.count("*").alias("n"))
    rarest = (
        keys.join(counted, ["session_id", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .groupBy("session_id", "wanted_id").agg(F.min_by("key", "n").alias("key"), F.min("n").alias("n"))
        .filter("n > 0").drop("n")
    )
    met = rarest.join(index, ["session_id", "key"]).select("session_id", "wanted_id", "text_id").distinct()
    seen = (
        met.join(wanted.select("session_id", "wanted_id", "wanted"), ["session_id", "wanted_id"])
        .join(texts, ["session_id", "text_id"])
        .filter(F.contains("text", "wanted"))
        .select("session_id", "wanted").distinct().withColumn("found", F.lit(True))
    )
    return asked.join(seen, ["session_id", "wanted"], "left").select(
        "session_id", "criterion_key", "description", F.coalesce("found", F.lit(False)).alias("covered")
    )


def coverage(sessions: DataFrame, covered: DataFrame) -> DataFrame:
    """Percent of criteria covered, rounded half up; null without criteria."""
    per_session = covered.groupBy("session_id").agg(
        F.count("*").alias("criteria"), F.count_if("covered").alias("covered")
    )
    percent = F.floor(F.col("covered") * 100 / F.col("criteria") + 0.5).cast("int")
    return sessions.select("session_id").join(per_session, "session_id", "left").select(
        "session_id",
        F.coalesce("criteria", F.lit(0)).alias("criteria"),
        F.coalesce("covered", F.lit(0)).alias("covered"),
        percent.alias("requirement_coverage"),
    )


# --- passports -----------------------------------------------------------------


def components(conflict_files: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Components a session touches, one row each: files of its conflicts and the
    top folders of its changed files."""
    top = F.split("path", "/")[0]
    folders = changed_paths.select("session_id", top.alias("component")).filter("component <> ''")
    files = conflict_files.select("session_id", F.col("file_path").alias("component"))
    return files.unionByName(folders).distinct()


def passports(
    sessions: DataFrame, results: DataFrame, files_changed: DataFrame, components: DataFrame
) -> DataFrame:
    """One row per session. Null means not measured, never zero.

    ``sessions`` may carry ``repository``, ``branch_a``, ``branch_b`` and
    ``completed_at``; the component list itself stays in ``components``.
    """
    risk = F.when(F.col("conflicts_found") > 0, F.col("summary")).otherwise("")
    n_components = components.groupBy("session_id").agg(F.count("*").alias("n_components"))
    extra = [c for c in ("repository", "branch_a", "branch_b", "completed_at") if c in sessions.columns]
    joined = (
        sessions.select("session_id", "requirement_text", *extra)
        .join(results, "session_id")
        .join(files_changed, "session_id", "left")
        .join(n_components, "session_id", "left")
    )
    unmeasured = F.lit(None).cast("int")
    return joined.select(
        F.concat(F.lit("live-"), F.col("session_id").cast("string")).alias("passport_id"),
        "session_id", F.col("requirement_text").alias("intent"), *extra,
        F.coalesce("files_changed", F.lit(0)).alias("files_changed"),
        F.coalesce("n_components", F.lit(0)).alias("n_components"),
        "claims_found", unmeasured.alias("claims_verified"),
        "conflicts_found", F.lit(0).alias("conflicts_resolved"),
        unmeasured.alias("tests_total"), unmeasured.alias("tests_passing"),
        unmeasured.alias("requirement_coverage"),
        F.nullif(risk, F.lit("")).alias("remaining_risk"),
        F.when(F.col("conflicts_found") > 0, "FAIL").otherwise("PASS").alias("status"),
    )


def fraction(numerator: Column, denominator: Column) -> Column:
    return F.when(
        numerator.isNotNull() & denominator.isNotNull(),
        F.concat(numerator.cast("string"), F.lit("/"), denominator.cast("string")),
    )


def coverage_ok(percent: Column) -> Column:
    return F.when(percent.isNotNull(), percent >= 90)


def passport_text(passports: DataFrame, heading: str = "CHANGE PASSPORT") -> DataFrame:
    """The fixed-label text block of each passport."""
    dash = F.lit(fixed.NOT_KNOWN)

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), dash) if name in passports.columns else dash

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}:".ljust(22)), value)

    branches = F.coalesce(
        F.nullif(F.concat_ws(", ", *[c for c in ("branch_a", "branch_b") if c in passports.columns]), F.lit("")),
        dash,
    )
    percent = F.coalesce(F.concat(F.col("requirement_coverage").cast("string"), F.lit("%")), dash)
    lines = [
        F.lit(heading), F.lit(""),
        line("Feature", shown("repository")),
        line("Intent", F.col("intent")),
        line("Repository", shown("repository")),
        line("Branches", branches),
        line("Files Changed", shown("files_changed")),
        line("Components", shown("components") if "components" in passports.columns else shown("n_components")),
        F.lit(""),
        line("Assumptions Found", shown("claims_found")),
        line("Verified", shown("claims_verified")),
        line("Conflicts Found", shown("conflicts_found")),
        line("Resolved", shown("conflicts_resolved")),
        line("Tests", F.concat(shown("tests_passing"), F.lit(" / "), shown("tests_total"))),
        line("Req. Coverage", percent),
        F.lit(""),
        line("Remaining Risk", F.coalesce("remaining_risk", F.lit("None identified"))),
        line("Verification Status", F.col("status")),
        F.lit(""),
        line("Passport ID", F.col("passport_id")),
        line("Session ID", F.col("session_id").cast("string")),
        line("Generated", shown("completed_at")),
    ]
    return passports.select("session_id", F.concat_ws("\n", *lines).alias("text"))
