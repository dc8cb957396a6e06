"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for three kinds of base candidates and for *runs*, long
tokens that could be credentials although nothing near them says so. A
candidate's value is hashed at once; values never leave the scan. The hashes are
counted over the corpus by distinct repositories and owners. A value that more
than ``MAX_OWNERS`` owners or more than ``MAX_REPOSITORIES`` repositories hold is a
widely copied example, also if one owner copies it; every other one is
owner-specific. A run becomes a span of kind ``owned`` if it looks live (lower and
upper case letters, digits, ten distinct characters) is owner-specific and
touches no base span. Base spans are never taken away; the frequency says for
each whether it is live or copied.

Matches are leftmost and do not overlap within a kind. Positions come from the
lengths of the pieces between the matches, summed up per text. Counting combines
before it shuffles, and the counts are joined to candidates by hash, where adaptive
execution splits the rows of a hot hash.

A null text is empty and has no spans. A null owner or repository counts as one
value of its own. Rows are told apart by their place in the written scan, so
repeated rows and ids each get their own result. Texts of any length are read whole. An
empty table gives no rows. Other columns aren't read; ``masked`` keeps them, and its
own columns take other names where they would clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, staged

# Fixed patterns and least lengths, as the contract states them.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "owned": r"[A-Za-z0-9+/_=-]{20,}",
}
VALUE_GROUP = {"assign": 2, "access": 0, "hex": 0, "owned": 0}
MIN_LENGTH = {"assign": 6, "access": 20, "hex": 24, "owned": 20}
ORDER = {kind: n for n, kind in enumerate((*KINDS, "owned"))}

MAX_OWNERS = 2
MAX_REPOSITORIES = 100
MIN_DISTINCT = 10
MASK = "<secret>"


def _matches(text: Column, kind: str) -> Column:
    """Array of (gap before, length, value hash, fits) of all matches, in order; null if there is none.

    A match that is too short stays in the array, because it takes up its place.
    """
    pattern = F.lit(PATTERNS[kind])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(VALUE_GROUP[kind])) if VALUE_GROUP[kind] else whole
    gaps = F.split(text, PATTERNS[kind], -1)
    fits = lambda v: F.length(v) >= MIN_LENGTH[kind]
    if kind == "owned":
        fits = lambda v: (
            v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT)
        )
    both = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("g"), whole.alias("w"), value.alias("v"))
    listed = F.transform(
        both,
        lambda x: F.struct(
            F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("length"), F.sha2(x["v"], 256).alias("hash"), fits(x["v"]).alias("fits")
        ),
    )
    return F.when(F.regexp_like(text, pattern), listed)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """Written scan: row, doc_id, h (hash of the text), owner, repository, and the matches of each kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(owner).cast("string").alias("owner"),
        F.col(repository or id).cast("string").alias("repository"), whole.alias("whole"),
    )
    found = narrow.select("doc_id", "h", "owner", "repository", *[_matches(F.col("whole"), k).alias(k) for k in ORDER])
    return staged(found.withColumn("row", F.monotonically_increasing_id()), "secrets-scan")


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per fitting match: row, doc_id, h, owner, repository, kind, start, end, hash, in code points."""
    parts = [
        scanned.where(F.col(k).isNotNull()).select(
            "row", "doc_id", "h", "owner", "repository", F.lit(k).alias("kind"), F.posexplode(k).alias("at", "m")
        )
        for k in ORDER
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.length")).over(so_far)
    return rows.withColumn("end", end).where("m.fits").select(
        "row", "doc_id", "h", "owner", "repository", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end",
        F.col("m.hash").alias("hash"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per hash: repositories, owners and occurrences. A repository belongs to its owner."""
    by_repository = found.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("occurrences"))
    by_owner = by_repository.groupBy("hash", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("occurrences").alias("occurrences")
    )
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("occurrences").alias("occurrences")
    )


def spans(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Base spans and owned spans, with owners, repositories and ``live``."""
    few = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    counted = found.join(ownership(found), "hash").withColumn("live", few)
    base = F.col("kind") != "owned"
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(0, Window.unboundedFollowing)
    touched = (F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1)) > F.col("start")) | (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.col("end")) < F.col("end")
    )
    return counted.withColumn("_touched", touched).where(base | (F.col("live") & ~F.col("_touched"))).drop("_touched")


def _order() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair]), F.col("kind"))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None,
           max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per row of ``docs``: counts of each kind, the base digest, all spans, live and copied counts, and the
    owners and repositories of its most widely held base values."""
    scanned = scan(docs, id, text, owner, repository)
    found = staged(candidates(scanned), "secrets-candidates")
    listed = spans(found, max_owners, max_repositories).select(
        "row", "kind", "live", "owners", "repositories",
        F.struct(F.col("start"), _order().alias("o"), F.concat_ws(":", "kind", "start", "end").alias("text")).alias("span"),
    )
    texts = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["text"]), ",")
    base = F.col("kind") != "owned"
    per_row = listed.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, True)).alias(f"n_{k}") for k in ORDER],
        F.count(F.when(base & F.col("live"), True)).alias("n_live"),
        F.count(F.when(base & ~F.col("live"), True)).alias("n_copied"),
        F.max(F.when(base, F.col("owners"))).alias("most_owners"), F.max(F.when(base, F.col("repositories"))).alias("most_repositories"),
        texts(F.collect_list(F.when(base, F.col("span")))).alias("base"),
        texts(F.collect_list("span")).alias("spans"),
    )
    counts = [*(f"n_{k}" for k in ORDER), "n_live", "n_copied", "most_owners", "most_repositories"]
    joined = scanned.select("row", "doc_id").join(per_row, "row", "left")
    return joined.select(
        "doc_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def masked(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None,
           max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, length: str | None = None) -> DataFrame:
    """``docs`` with every live span replaced by ``MASK``; copied examples stay as they are.

    Spans that touch are masked as one. ``length`` names a column of text lengths
    to bring up to date. All rows and columns stay.
    """
    found = staged(candidates(scan(docs, id, text, owner, repository)), "secrets-candidates")
    live = spans(found, max_owners, max_repositories).where("live")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.max("end").over(before) < F.col("start"), F.lit(True))
    so_far = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        live.withColumn("opens", opens).withColumn("part", F.sum(F.col("opens").cast("long")).over(so_far))
        .groupBy("row", "doc_id", "h", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    ids, hashes, h, cuts = (fresh(docs, n) for n in ("_masked_id", "_masked_h", "_text_hash", "_cuts"))
    per_text = (
        merged.select("doc_id", "h", "start", "end").distinct().groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
        .withColumnsRenamed({"doc_id": ids, "h": hashes})
    )
    c, t = F.col(cuts), F.col(text)
    pieces = F.transform(
        c,
        lambda s, i: F.concat(
            F.substring(t, (F.when(i > 0, F.get(c, i - 1)["end"]).otherwise(0) + 1).cast("int"),
                        (s["start"] - F.when(i > 0, F.get(c, i - 1)["end"]).otherwise(0)).cast("int")),
            F.lit(MASK),
        ),
    )
    tail = F.substring(t, (F.element_at(c, -1)["end"] + 1).cast("int"), F.length(t))
    replaced = F.when(c.isNull(), t).otherwise(F.concat(F.array_join(pieces, ""), tail))
    joined = docs.withColumn(h, F.xxhash64(text)).join(
        per_text, F.col(id).eqNullSafe(F.col(ids)) & (F.col(h) == F.col(hashes)), "left"
    )
    out = joined.withColumn(text, replaced)
    if length:
        out = out.withColumn(length, F.when(F.col(cuts).isNull(), F.col(length)).otherwise(F.length(text)))
    return out.select(*docs.columns)
