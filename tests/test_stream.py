from pyspark.sql import functions as F

from claimgrid.operators import lifecycle, normalize, pairing
from claimgrid.operators.extract import claims
from claimgrid.streaming import feed
from tests.helpers import claim_table, rows, units

SHOWN = ("session_id", "conflict_id", "l_value", "r_value", "severity")


def test_batches_give_the_same_conflicts_as_one_run(spark, tmp_path):
    parts = [
        units(spark, "role = 'owner'", "email is required", session="a", file="x.ts"),
        units(spark, "role = 'admin'", session="b", file="y.ts"),
    ]
    late = units(spark, "-", "-", "role === 'admin'", "email is optional", session="a", file="z.ts")
    parts.append(late.filter("change_seq >= 2"))
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    source = str(tmp_path / "in")
    root = str(tmp_path / "root")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(everything.schema).parquet(source)
        feed.verify_stream(stream, root, str(tmp_path / "ck"), available_now=True).awaitTermination()
    whole = pairing.detect_conflicts(normalize.normalize(claims(everything, "CODE_DIFF")))
    assert rows(feed.current_conflicts(spark, root), *SHOWN) == rows(whole, *SHOWN)
    assert len(rows(whole)) == 2


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "root")
    batch = units(spark, "role = 'owner'", "role = 'admin'", session="a")
    for _ in range(2):
        feed.verify_batch(batch, 0, root)
    assert feed.current_conflicts(spark, root).count() == 1
    assert spark.read.parquet(f"{root}/claims").count() == 2


def test_many_batches_do_not_make_more_folders(spark, tmp_path):
    root = tmp_path / "root"
    parts = [
        units(spark, *(["-"] * i), f"role = '{'owner' if i % 2 else 'admin'}'", session=f"s{i % 3}").filter(f"change_seq = {i}")
        for i in range(20)
    ]
    for i, part in enumerate(parts):
        feed.verify_batch(part, i, str(root), buckets=4)
        assert len(list((root / "claims").glob("bucket=*"))) <= 4
        assert len(list((root / "claims").glob("bucket=*/*.parquet"))) <= 4
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    whole = pairing.detect_conflicts(normalize.normalize(claims(everything, "CODE_DIFF")))
    assert rows(feed.current_conflicts(spark, str(root)), *SHOWN) == rows(whole, *SHOWN) and whole.count() == 3


def test_a_bucket_whose_conflicts_vanish_is_emptied(spark, tmp_path):
    root = str(tmp_path / "root")

    def batch(change, text, unit="u"):
        return units(spark, text, session="a").selectExpr(
            "session_id", "part", f"cast({change} as bigint) as change_seq", "snippet_seq", f"'{unit}' as unit_id", "text", "category_hint", "source_file"
        )

    # Later claims of two units conflict; then an earlier unit takes over one side with an id that both sides share.
    late, early = batch(5, "role = 'owner'", "u").unionByName(batch(6, "role = 'admin'", "v")), batch(1, "role = 'owner'", "v")
    feed.verify_batch(late, 0, root, buckets=4)
    assert feed.current_conflicts(spark, root).count() == 1
    renamed = late.unionByName(early)
    feed.verify_batch(early, 1, root, buckets=4)
    whole = pairing.detect_conflicts(normalize.normalize(claims(renamed, "CODE_DIFF")))
    assert rows(feed.current_conflicts(spark, root), *SHOWN) == rows(whole, *SHOWN)
    # A repeat of the first batch without its units takes its conflicts back, and the folder goes.
    feed.verify_batch(late.filter("change_seq = 5"), 0, root, buckets=4)
    left = list((tmp_path / "root" / "pairs").glob("bucket=*"))
    assert not left and feed.current_conflicts(spark, root).count() == 0


def test_a_hot_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    table = spark.range(1_000).selectExpr("id", "if(id < 900, 1, 2) as bucket")
    feed._replace(table, str(tmp_path / "t"), [1, 2, 3], per_file=100)
    assert len(list((tmp_path / "t" / "bucket=1").glob("*.parquet"))) > 4
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1_000


def test_a_batch_forms_the_pairs_of_its_own_claims(spark):
    data = [("s", i, "order", "must_be", f"v{i}", "CODE_DIFF", None) for i in range(1_500)]
    table = pairing.pairable(pairing.merge_claims(claim_table(spark, data)))
    marked = table.withColumn("changed", F.col("canonical_value").isin("v3", "v900"))
    pairs = pairing.changed_pairs(marked, block=100)
    assert pairs.count() == 1_499 + 1_498
    everything = pairing.contradicting_pairs(table).filter("l_value in ('v3', 'v900') or r_value in ('v3', 'v900')")
    assert rows(pairs, "l_value", "r_value") == rows(everything, "l_value", "r_value")


EVENTS = "session_id string, event_id int, ts int, status string"


def test_status_log_equals_the_batch_fold_in_any_order(spark, tmp_path):
    events = [(f"s{k % 7}", k, (k * 37) % 50, ["PENDING", "COMPLETE", "ERROR"][k % 3]) for k in range(120)]
    whole = rows(lifecycle.latest_status(spark.createDataFrame(events, EVENTS)), "session_id", "status", "n_events")
    order = [3, 0, 4, 1, 2]
    for every in (None, 2):
        table = str(tmp_path / f"t{every}")
        for n, k in enumerate(order):
            part = spark.createDataFrame(events[k * 24 : k * 24 + 24], EVENTS)
            feed.fold_status(part, n, table)
            if k == 1:
                feed.fold_status(part, n, table)  # a repeated batch
            if every and n % every == 0:
                feed.compact_status(spark, table)
        assert rows(feed.current_status(spark, table), "session_id", "status", "n_events") == whole


def test_status_stream_folds_and_compacts(spark, tmp_path):
    events = spark.createDataFrame(
        [("s", 1, 1, "PENDING"), ("s", 2, 3, "COMPLETE"), ("s", 3, 2, "INGESTING"), ("t", 4, 1, "PENDING")], EVENTS
    )
    table = str(tmp_path / "out")
    for k in range(3):
        events.filter(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        feed.status_stream(stream, str(tmp_path / "ck"), table, compact_every=2).awaitTermination()
    got = feed.current_status(spark, table)
    assert rows(got, "session_id", "status", "n_events") == rows(lifecycle.latest_status(events), "session_id", "status", "n_events")
    assert len(list((tmp_path / "out" / "compact").glob("upto=*"))) == 1


def test_claims_are_stored_once_and_give_pairs_their_texts(spark, tmp_path):
    root = tmp_path / "root"
    parts = [
        units(spark, "role = 'owner'", "email is required", "role = 'guest'", session="a", file="x.ts"),
        units(spark, "-", "-", "-", "role === 'admin'", "email is optional", session="a").filter("change_seq >= 3"),
        units(spark, "role = 'owner'", "role = 'member'", session="b"),
    ]
    everything = parts[0]
    for i, part in enumerate(parts):
        feed.verify_batch(part, i, str(root), buckets=4)
        everything = part if i == 0 else everything.unionByName(part)
        whole = pairing.detect_conflicts(normalize.normalize(claims(everything, "CODE_DIFF")))
        got = feed.current_conflicts(spark, str(root))
        assert got.columns == whole.columns and rows(got) == rows(whole)
    pairs = spark.read.parquet(str(root / "pairs"))
    assert not {"l_statement", "r_statement", "l_evidence_text", "r_evidence_text"} & set(pairs.columns)
    # The claims were moved from where they were first written, and not written again.
    assert not list((root / "_work" / "claims").glob("bucket=*"))
    assert not (root / "_work" / "kept").exists()


def test_claims_dealt_by_bucket_need_one_shuffle(spark):
    table = units(spark, *(f"role = '{r}'" for r in ("owner", "admin", "guest")), session="a")
    deal = {"bucket": feed._bucket(4), "_file": feed._file({b: 9 for b in range(4)}, feed._bucket(4), ["session_id", "change_seq"], 3)}
    found = claims(table, "CODE_DIFF", deal=deal)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == plan.count("Exchange hashpartitioning") == 1
    plain = claims(table, "CODE_DIFF")
    assert rows(found, *plain.columns) == rows(plain) and found.select("_file").distinct().count() > 1


def test_a_large_batch_is_written_by_several_tasks_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "ROWS_AT_ONCE", 0)
    monkeypatch.setattr(feed, "ROWS_PER_FILE", 10)
    table = units(spark, *(f"role = '{r}'" for r in ["owner", "admin", "guest"] * 40), session="a")
    for batch in range(2):
        part = table.filter(f"change_seq % 2 = {batch}")
        feed.verify_batch(part, batch, str(tmp_path), buckets=4)
    files = list((tmp_path / "claims").glob("bucket=*/*.parquet"))
    assert 2 <= len(files) <= 12 and spark.read.parquet(str(tmp_path / "claims")).count() == 120
    whole = pairing.detect_conflicts(normalize.normalize(claims(table, "CODE_DIFF")))
    assert rows(feed.current_conflicts(spark, str(tmp_path)), *SHOWN) == rows(whole, *SHOWN)
