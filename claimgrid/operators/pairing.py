"""Normalised claims -> merged claims -> contradicting pairs -> conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgrid.functions.rulings import (
    claim_class,
    confidence_ruling,
    evidence_quality,
    is_direct,
    severity_ruling,
)
from claimgrid.functions.text import slug
from claimgrid.operators import repeats
from claimgrid.operators.extract import CLAIM_ORDER
from claimgrid.session import stage

MERGE_KEY = ["session_id", "canonical_subject", "canonical_predicate"]
GROUP_KEY = ["session_id", "canonical_subject", "canonical_key"]

# A group of more claims than this is paired by several tasks, one for so many.
BLOCK = 512
# Tasks over which the claims of a large group are dealt while its size is looked up.
SALTS = 64


def claim_order() -> Column:
    return F.struct(*CLAIM_ORDER)


# What a merged claim keeps of its first claim, and what of it only the texts of a report need.
MERGED = ["claim_id", "canonical_key", "canonical_value", "source_type", "source_file"]
TEXTS = ["statement", "predicate", "evidence_text", "confidence"]


def merge_claims(normalized: DataFrame, texts: bool = True) -> DataFrame:
    """One row per (session, subject, predicate): the first claim and how many agree.

    The merged evidence stays in rows (``merged_evidence``): a hot claim can
    have any number of sources, so they are never gathered into one value.
    The minimum is combined before the shuffle, so a hot claim costs one row
    per input partition. It is one value to Spark, which can't drop parts of it that
    nobody reads, so without ``texts`` it is made without ``TEXTS``.
    """
    carried = [
        "claim_id", "statement", "predicate", "canonical_key", "canonical_value",
        "source_type", "source_file", "evidence_text", "confidence",
    ]
    if not texts:
        carried = [c for c in carried if c not in TEXTS]
    first = F.min(F.struct(claim_order().alias("ord"), *carried))
    merged = normalized.groupBy(*MERGE_KEY).agg(
        first.alias("first"), F.count("*").alias("n_claims")
    )
    return merged.select(*MERGE_KEY, "first.*", "n_claims")


def merged_evidence(normalized: DataFrame, stored: bool = False) -> DataFrame:
    """Evidence references of each merged claim, one row each, first per id.

    If ``normalized`` is ``stored``, only references whose id may come twice are grouped.
    """
    from claimgrid.operators.normalize import references

    listed = references(normalized).select(
        *MERGE_KEY,
        claim_order().alias("ord"),
        F.posexplode("refs").alias("ref_seq", "ref"),
    )
    fields = ["source_type", "file_path", "line_range", "text", "label"]
    flat = listed.select(*MERGE_KEY, "ref.ref_id", "ord", "ref_seq", *(f"ref.{f}" for f in fields))

    def first(rows: DataFrame) -> DataFrame:
        kept = rows.groupBy(*MERGE_KEY, "ref_id").agg(F.min(F.struct("ord", "ref_seq", *fields)).alias("ref"))
        return kept.select(*MERGE_KEY, "ref_id", "ref.*")

    return repeats.one_per_key(flat, [*MERGE_KEY, "ref_id"], first) if stored else first(flat)


def evidence_files(normalized: DataFrame) -> DataFrame:
    """Distinct files behind each merged claim; combined before the shuffle."""
    own = F.array("source_file")
    if "supporting_evidence" in normalized.columns:
        own = F.concat(own, F.coalesce("supporting_evidence.file_path", F.array()))
    return (
        normalized.select(*MERGE_KEY, F.explode(own).alias("file_path"))
        .filter(F.col("file_path").isNotNull())
        .distinct()
    )


def pairable(merged: DataFrame) -> DataFrame:
    """Merged claims that can contradict something, with their class."""
    return (
        merged.filter((F.col("canonical_subject") != "") & F.col("canonical_value").isNotNull())
        .withColumn("conflict_type", claim_class())
        .filter(F.col("conflict_type").isNotNull())
        .withColumn("quality", evidence_quality())
    )


SIDE = {
    "ord": "ord", "claim_id": "claim_id", "statement": "statement",
    "canonical_predicate": "predicate", "canonical_value": "value",
    "source_type": "source_type", "source_file": "file",
    "evidence_text": "evidence_text", "quality": "quality", "n_claims": "n_claims",
}


def in_blocks(claims: DataFrame, block: int = BLOCK, stored: bool = False) -> DataFrame:
    """``claims`` with the number of blocks of their group and their own block.

    Group sizes are combined counts; only groups above ``block`` matter. Of ``stored``
    claims they are counted at once and sent to the claims, which then aren't shuffled, as
    long as they are few. Else they are looked up under ``SALTS`` keys each, so the claims
    of a hot group meet their size in many tasks. A group for t tasks has the least number
    of blocks that form t pairs of blocks.
    """
    tasks = F.ceil(F.col("group_size") / block)
    large = (
        claims.groupBy(*GROUP_KEY).agg(F.count("*").alias("group_size")).filter(F.col("group_size") > block)
        .select(*GROUP_KEY, F.ceil((F.sqrt(8 * tasks + 1) - 1) / 2).cast("int").alias("blocks"))
    )
    value = F.xxhash64("canonical_value")
    if stored:
        large = stage(large, "large-groups")
    if stored and repeats.few(large):
        sized = claims.join(F.broadcast(large), GROUP_KEY, "left")
    else:
        salts = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = claims.withColumn("salt", F.pmod(value, F.lit(SALTS)).cast("int"))
        sized = salted.join(salts, [*GROUP_KEY, "salt"], "left").drop("salt")
    sized = sized.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # Bits beside those of the salt, or blocks would repeat its pattern.
    return sized.withColumn("block", F.pmod(F.shiftrightunsigned(value, 20), "blocks").cast("int"))


def contradicting_pairs(claims: DataFrame, block: int = BLOCK, stored: bool = False) -> DataFrame:
    """Pairs of one session, subject and key whose values differ, earlier claim left.

    After the merge a group holds one row per distinct value. Its rows are dealt to
    blocks, and blocks i <= j meet in a cell: a row of block b goes to the cells of b
    and each other block, so it is copied as often as there are blocks, every two rows
    meet exactly once, and a task gets two blocks of a group. The pair is then put in
    order. Both sides of the join are the same rows in the same columns, so they are
    shuffled once and read twice; the rows of block i are taken for the left and those
    of block j for the right by one comparison of both, because a filter of one side
    would make two different shuffles. ``claims`` is pairable and read three times; a
    caller whose claims are costly stages them, and says so by ``stored``.
    """
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = _sides(in_blocks(claims, block, stored)).select(*GROUP_KEY, "conflict_type", "block", "side", met.alias("other")).select(
        *GROUP_KEY, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.struct("conflict_type", "block", "side.*").alias("row"),
    )
    keys = [*GROUP_KEY, "i", "j"]
    joined = cells.withColumnRenamed("row", "x").join(cells.withColumnRenamed("row", "y"), keys)
    taken = F.struct(F.col("x.block"), F.col("y.block")) == F.struct(F.col("i").alias("block"), F.col("j").alias("block"))
    return _in_order(joined.filter(taken & F.expr("i < j or x.ord < y.ord")).withColumn("conflict_type", F.col("x.conflict_type")))


def changed_pairs(claims: DataFrame, block: int = BLOCK, stored: bool = False) -> DataFrame:
    """The pairs of ``contradicting_pairs`` with a side that is ``changed``, without forming others.

    ``claims`` is pairable and holds whole groups, with the flag ``changed``. Changed
    claims are copied to the blocks of their group and meet the group's claims there.
    """
    dealt = _sides(in_blocks(claims, block, stored), "changed")
    left = dealt.filter("changed").select(
        *GROUP_KEY, "conflict_type", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("side").alias("x"),
    )
    right = dealt.select(*GROUP_KEY, "block", "changed", F.col("side").alias("y"))
    return _in_order(left.join(right, [*GROUP_KEY, "block"]).filter("not changed or x.ord < y.ord"))


def _sides(dealt: DataFrame, *keep: str) -> DataFrame:
    side = F.struct(*(F.col(a).alias(b) for a, b in SIDE.items() if a in dealt.columns)).alias("side")
    return dealt.select(*GROUP_KEY, "conflict_type", "block", "blocks", *keep, side)


def _in_order(met: DataFrame) -> DataFrame:
    """Contradicting pairs among ``x`` and ``y`` that met, the earlier claim left."""
    pairs = met.filter("x.claim_id <> y.claim_id and x.value <> y.value")
    first = F.col("x.ord") < F.col("y.ord")
    sides = {"l": F.when(first, F.col("x")).otherwise(F.col("y")), "r": F.when(first, F.col("y")).otherwise(F.col("x"))}
    ordered = pairs.select(*GROUP_KEY, "conflict_type", *(side.alias(name) for name, side in sides.items()))
    names = [name for name in SIDE.values() if name in ordered.schema["l"].dataType.names]
    return ordered.select(
        *GROUP_KEY, "conflict_type", *(F.col(f"{p}.{name}").alias(f"{p}_{name}") for p in sides for name in names)
    )


def rule_on(pairs: DataFrame) -> DataFrame:
    """Add quality, directness, severity and confidence with their rule names."""
    judged = pairs.withColumns(
        {"quality": F.least("l_quality", "r_quality"), "direct": is_direct()}
    )
    judged = judged.withColumns(
        {"severity_of": severity_ruling(), "confidence_of": confidence_ruling()}
    )
    return judged.withColumns(
        {
            "severity": F.col("severity_of.level"),
            "severity_rule": F.col("severity_of.rule"),
            "confidence": F.col("confidence_of.level"),
            "confidence_rule": F.col("confidence_of.rule"),
        }
    ).drop("severity_of", "confidence_of")


def with_texts(conflicts: DataFrame, normalized: DataFrame) -> DataFrame:
    """Conflicts of claims merged without texts, with the statement and excerpt of their first claims."""
    first = [*MERGE_KEY, "ord", "claim_id"]
    of_claim = (
        normalized.select(*MERGE_KEY, claim_order().alias("ord"), "claim_id", "statement", "evidence_text")
        .groupBy(*first).agg(F.min(F.struct("statement", "evidence_text")).alias("said"))
    )
    found = conflicts
    for side in ("l", "r"):
        names = {"canonical_predicate": f"{side}_predicate", "ord": f"{side}_ord", "claim_id": f"{side}_claim_id"}
        key = [names.get(c, c) for c in first]
        found = found.join(of_claim.withColumnsRenamed({**names, "said": f"{side}_said"}), key, "left")
    said = {f"{side}_{name}": F.col(f"{side}_said.{name}") for side in ("l", "r") for name in ("statement", "evidence_text")}
    ordered = [f"{side}_{name}" for side in ("l", "r") for name in SIDE.values()]
    head, tail = [*GROUP_KEY, "conflict_type"], [c for c in conflicts.columns if c not in ordered]
    return found.withColumns(said).select(*head, *ordered, *(c for c in tail if c not in head))


def conflict_id() -> Column:
    ids = [F.least("l_claim_id", "r_claim_id"), F.greatest("l_claim_id", "r_claim_id")]
    return F.concat(F.lit("conflict_"), slug(F.col("conflict_type"), *ids))


def first_per_id(pairs: DataFrame, stored: bool = False) -> DataFrame:
    """Drop later conflicts of the same id within a session.

    If ``pairs`` are ``stored``, only those whose id may come twice are shuffled.
    """
    ranked = Window.partitionBy("session_id", "conflict_id").orderBy("l_ord", "r_ord")

    def first(rows: DataFrame) -> DataFrame:
        # Few ids come twice, so a limit a group before the shuffle would sort all rows for nothing.
        return rows.withColumn("later", F.lag(F.lit(True)).over(ranked)).filter("later is null").drop("later")

    return repeats.one_per_key(pairs, ["session_id", "conflict_id"], first) if stored else first(pairs)


def conflict_files() -> Column:
    """Files of the two claims themselves, left first, null if there are none."""
    own = [F.nullif(F.col(c), F.lit("")) for c in ("l_file", "r_file")]
    files = F.array_distinct(F.array_compact(F.array(*own)))
    return F.when(F.size(files) > 0, files)


def detect_conflicts(normalized: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every conflict of every session."""
    return conflicts_from_merged(merge_claims(normalized), block)


def conflicts_from_merged(merged: DataFrame, block: int = BLOCK) -> DataFrame:
    return conflicts_from_pairable(pairable(merged), block)


def ruled(pairs: DataFrame) -> DataFrame:
    return rule_on(pairs).withColumn("conflict_id", conflict_id())


def conflicts_from_pairable(claims: DataFrame, block: int = BLOCK) -> DataFrame:
    return first_per_id(ruled(contradicting_pairs(claims, block)))


def staged_conflicts(claims: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conflicts_from_pairable`` of staged claims, for callers that need every conflict.

    Pairs are formed at once and staged, so that their ids can be compared before any
    of them is shuffled again.
    """
    return first_per_id(stage(ruled(contradicting_pairs(claims, block, stored=True)), "pairs"), stored=True)
