"""File jobs end to end: ingest, rerun, reconcile, streams, sinks."""

import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from spendloom import schemas
from spendloom.operators import records
from spendloom.plans import collect, ingest, reconcile
from spendloom.sources import readers, writers
from spendloom.streaming import jobs

AT = "2024-01-15T14:30:00.000Z"
FAILED_AT = "2024-02-01T00:00:00Z"


def call(i, user="alice", model="us.anthropic.claude-3-haiku-20240307-v1:0", tokens=700, **more):
    return {
        "requestId": f"req-{i}", "timestamp": AT, "accountId": "222222222222", "region": "us-east-1", "modelId": model,
        "input": {"inputTokenCount": tokens, "inputBodyJson": {"service_tier": "flex", "cachePoint": {"ttl": "1h"}}},
        "output": {"outputTokenCount": 5, "latencyMs": 1200, "outputBodyJson": "text"},
        "identity": {"arn": f"arn:aws:iam::222222222222:user/{user}"}, **more,
    }


@pytest.fixture
def call_log(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    good = [call(1), call(2, "bob", tokens=300), call(1, "late copy")]
    bad = ["{broken", "[1]", json.dumps(call(3, requestId="")), json.dumps(call(4, timestamp="never")), '"text"']
    text = "\n".join([json.dumps(g) for g in good] + ["", "   "] + bad) + "\n"
    with gzip.open(folder / "a.json.gz", "wt") as f:
        f.write(text)
    (folder / "b.json").write_text(json.dumps(call(1, "other file")) + "\n")
    return str(folder)


def stored_calls(spark, table):
    return readers.read_table(spark, table, schemas.CALLS, schemas.HOUR_PARTITIONS)


def test_ingest_calls_keeps_first_and_quarantines(spark, tmp_path, call_log):
    table, letters = str(tmp_path / "calls"), str(tmp_path / "letters")
    for _ in range(2):
        ingest.ingest_calls(spark, call_log, table, letters, FAILED_AT)
    rows = {r["requestid"]: r for r in stored_calls(spark, table).collect()}
    assert sorted(rows) == ["req-1", "req-2"]
    assert stored_calls(spark, table).count() == 2
    first = rows["req-1"]
    assert first["resolvedusername"] == "alice"
    assert (first["inferencetier"], first["cachetype"], first["crossregiontype"]) == ("flex", "none", "geo")
    assert json.loads(first["rawrequest"])["service_tier"] == "flex"
    assert (first["year"], first["month"], first["day"], first["hour"]) == ("2024", "01", "15", "14")
    assert (tmp_path / "calls/year=2024/month=01/day=15/hour=14").is_dir()
    errors = spark.read.json(letters).groupBy("error").count().collect()
    assert {r["error"]: r["count"] for r in errors} == {
        "not a JSON object of the call log": 3, "missing required field: requestId": 1, "unreadable timestamp": 1,
    }


def test_defaults_of_a_bare_call(spark):
    line = json.dumps({"requestId": "r", "timestamp": AT, "modelId": "amazon.nova-sonic"})
    parsed = records.parse_call_lines(spark.createDataFrame([(line,)], "value string"))
    (row,) = records.call_rows(parsed).collect()
    assert (row["region"], row["accountid"], row["callerarn"], row["resolvedusername"]) == ("unknown", "", "", "unknown")
    assert (row["inputtokens"], row["latencyms"], row["totalcost"], row["coststatus"]) == (0, 0, 0.0, "pending")
    assert (row["audiodurationseconds"], row["imagecount"], row["agentid"]) == (None, None, None)
    assert records.call_rows(parsed).columns == [f.name for f in schemas.struct_of(schemas.CALLS)]


def test_each_line_is_parsed_once(spark):
    lines = spark.createDataFrame([("{}",)], "value string")
    plan = records.call_rows(records.parse_call_lines(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_ingest_audit(spark, tmp_path):
    events = [
        {"eventId": "1", "requestId": "a", "eventTime": AT, "eventName": "InvokeModel", "userIdentity": {"arn": "arn:x"}},
        {"eventId": "2", "requestId": "b", "eventTime": AT, "eventName": "Converse",
         "userIdentity": {"sessionContext": {"sessionIssuer": {"arn": "arn:issuer"}}},
         "requestParameters": {"modelId": "m", "other": 1}},
        {"eventId": "3", "requestId": "c", "eventTime": AT, "eventName": "GetObject"},
        {"eventId": "4", "requestId": "d", "eventTime": AT},
        {"eventId": "1", "requestId": "a", "eventTime": AT, "eventName": "InvokeModel", "userIdentity": {"arn": "arn:x"}},
    ]
    folder = tmp_path / "audit"
    folder.mkdir()
    (folder / "ok.json").write_text(json.dumps({"Records": events}, indent=2))
    (folder / "bad.json").write_text(json.dumps({"Digest": 1}))
    (folder / "broken.json").write_text("{")
    table, letters = str(tmp_path / "t"), str(tmp_path / "l")
    for _ in range(2):
        ingest.ingest_audit(spark, str(folder), table, letters, FAILED_AT)
    rows = readers.read_table(spark, table, schemas.AUDIT_EVENTS, schemas.HOUR_PARTITIONS).orderBy("eventid").collect()
    assert [(r["eventid"], r["principalarn"], r["modelid"]) for r in rows] == [("1", "arn:x", ""), ("2", "arn:issuer", "m")]
    assert spark.read.json(letters).count() == 2


HEADER = "product_code,usage_type,item_description,billing_period,usage_start_date,payer_account_id,usage_account_id,\
pricing_unit,usage_quantity,unblended_cost"


def export_line(usage_type="USE1-Claude3Haiku-input-tokens", cost="100.00", product="AmazonBedrockService", day="2024-01-15T00:00:00Z"):
    return f'{product},{usage_type},"$0.003 per 1K ""input"" tokens, list",2024-01,{day},111111111111,222222222222,1K tokens,1000,{cost}'


def test_billing_csv(spark, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    lines = [
        HEADER, export_line(), export_line(product="Other"), export_line("DataTransfer-Out-Bytes"), "",
        export_line("EUW1-Unknown9-output-tokens-cross-region-global", "NaN", day=""),
        "AmazonBedrockService,USE1-NovaPro-cache-read-input-token-count,short",
    ]
    with gzip.open(folder / "a+b.csv.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    (folder / "manifest.json").write_text("{}")
    rows = {r["model_billing_name"]: r for r in records.cost_rows(readers.read_billing_csv(spark, str(folder))).collect()}
    assert sorted(rows) == ["Claude3Haiku", "NovaPro", "Unknown9"]
    first = rows["Claude3Haiku"]
    assert (first["billing_period"], first["usage_date"], first["region"]) == ("2024-01", "2024-01-15", "us-east-1")
    assert first["item_description"] == '$0.003 per 1K "input" tokens, list'
    assert (first["unit_price"], first["unblended_cost"], first["usage_amount"]) == (0.003, 100.0, 1000.0)
    assert first["cur_file_key"].endswith("a b.csv.gz")
    other = rows["Unknown9"]
    assert (other["region"], other["resolved_model_id"], other["unblended_cost"]) == ("eu-west-1", None, 0.0)
    assert other["usage_date"] == "unknown"
    assert (rows["NovaPro"]["pricing_unit"], rows["NovaPro"]["billing_period"]) == ("", "unknown")


def test_exports_of_several_headers_are_read_in_one_load(spark, tmp_path):
    """Each file by its own header: another order, other names, fewer columns, compressed, empty, or nothing but a header."""
    folder = tmp_path / "exports" / "2024"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("\n".join([HEADER, export_line()]) + "\n")
    turned = ",".join(reversed(HEADER.split(",")))
    (folder / "b.csv").write_text(f'\ufeff{turned}\n2.5,10,1K tokens,222222222222,111111111111,2024-01-16T00:00:00Z,2024-01,"x, ""y""\nz",EUW1-NovaPro-output-tokens,AmazonBedrockService\n')
    other = '"lineItem/ProductCode","lineItem/UsageType",bill/BillingPeriod,lineItem/UsageStartDate,lineItem/UnblendedCost,extra,extra'
    with gzip.open(folder / "c.csv.gz", "wt") as f:
        f.write(f"{other}\nAmazonBedrockService,ZZZ1-NovaPro-output-tokens,2025-01-01,2025-01-15T05:00:00Z,1.5,u,v\n")
    (folder / "d.csv").write_text("")
    (folder / "e.csv").write_text(HEADER + "\n")
    (folder / "note.txt").write_text("no export")
    rows = records.cost_rows(readers.read_billing_csv(spark, str(tmp_path / "exports"))).collect()
    got = sorted((r["usage_date"], r["model_billing_name"], r["region"], r["unblended_cost"], r["item_description"], r["cur_file_key"][-5:]) for r in rows)
    assert got == [
        ("2024-01-15", "Claude3Haiku", "us-east-1", 100.0, '$0.003 per 1K "input" tokens, list', "a.csv"),
        ("2024-01-16", "NovaPro", "eu-west-1", 2.5, 'x, "y"\nz', "b.csv"),
        ("2025-01-15", "NovaPro", "ZZZ1", 1.5, "", "sv.gz"),
    ]
    at = lambda name: str(tmp_path / name)
    for state in ("1", "1", "2"):
        jobs.run_batches(jobs.billing_file_stream(spark, at("exports")), jobs.ingest_billing_batch(at("c"), at("m")), at(state))
    assert readers.read_table(spark, at("c"), schemas.COST_LINES, schemas.PERIOD_PARTITIONS).count() == 3


def test_alternative_headers(spark):
    names = ["lineItem/ProductCode", "lineItem/UsageType", "bill/BillingPeriod", "lineItem/UsageStartDate", "lineItem/UnblendedCost"]
    rows = spark.createDataFrame(
        [("AmazonBedrockService", "ZZZ1-NovaPro-output-tokens", "2025-01-01", "2025-01-15T05:00:00Z", "1.5")], names
    )
    (row,) = records.cost_rows(rows).collect()
    assert (row["billing_period"], row["usage_date"], row["unblended_cost"]) == ("2025-01", "2025-01-15", 1.5)
    assert (row["region"], row["resolved_model_id"], row["item_description"]) == ("ZZZ1", "amazon.nova-pro-v1:0", "")


def test_reconcile_job_is_idempotent(spark, tmp_path, call_log):
    calls, costs, target = (str(tmp_path / n) for n in ("calls", "costs", "out"))
    ingest.ingest_calls(spark, call_log, calls, str(tmp_path / "letters"), FAILED_AT)
    folder = tmp_path / "exports"
    folder.mkdir()
    (folder / "x.csv").write_text("\n".join([HEADER, export_line(), export_line("USE1-New-input-tokens", "7")]) + "\n")
    for _ in range(2):
        ingest.ingest_billing(spark, readers.read_billing_csv(spark, str(folder)), costs, str(tmp_path / "map"))
        reconcile.run(spark, costs, calls, target, date(2024, 2, 1))
    assert readers.read_table(spark, costs, schemas.COST_LINES, schemas.PERIOD_PARTITIONS).count() == 2
    rows = reconcile.read(spark, target).collect()
    got = sorted((r["resolved_user_name"], r["attributed_cost"], r["reconciliation_status"]) for r in rows)
    assert got == [("UNMATCHED", 7.0, "unmatched"), ("alice", 70.0, "reconciled"), ("bob", 30.0, "reconciled")]
    assert {(r["billing_period"], r["usage_date"]) for r in rows} == {("2024-01", "2024-01-15")}
    names = readers.read_table(spark, str(tmp_path / "map"), schemas.MODEL_BILLING_MAP).collect()
    assert [(r["cur_billing_name"], r["source"], r["last_seen_date"]) for r in names] == [("New", "auto", "2024-01-15")]


def test_corrected_export_replaces_the_whole_period(spark, tmp_path, call_log):
    """Days that a corrected export lacks, and buckets that sum to 0, leave nothing behind."""
    calls, costs, target = (str(tmp_path / n) for n in ("calls", "costs", "out"))
    ingest.ingest_calls(spark, call_log, calls, str(tmp_path / "letters"), FAILED_AT)
    folder = tmp_path / "exports"
    folder.mkdir()
    days = ["2024-01-15T00:00:00Z", "2024-01-16T00:00:00Z", "2024-01-17T00:00:00Z"]
    exports = [
        [export_line(cost="9", day=day) for day in days],
        [export_line(cost="5", day=days[0]), export_line(cost="4", day=days[1]), export_line(cost="-4", day=days[1])],
        [export_line(cost="3", day=days[0]), export_line(cost="-3", day=days[0])],
    ]
    got = []
    for n, lines in enumerate(exports):
        (folder / f"{n}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
        ingest.ingest_billing(spark, readers.read_billing_csv(spark, str(folder)), costs)
        reconcile.run(spark, costs, calls, target, date(2024, 2, 1))
        rows = reconcile.read(spark, target)
        got.append({r["usage_date"]: r["cost"] for r in rows.groupBy("usage_date").agg(F.sum("attributed_cost").alias("cost")).collect()})
    assert got == [{"2024-01-15": 9.0, "2024-01-16": 9.0, "2024-01-17": 9.0}, {"2024-01-15": 5.0}, {}]
    newest = readers.read_table(spark, costs, schemas.COST_LINES, schemas.PERIOD_PARTITIONS).where("billing_period = '2024-01'")
    assert "PartitionFilters: [isnotnull(billing_period" in newest._jdf.queryExecution().executedPlan().toString()


def test_audit_does_not_depend_on_batches(spark, tmp_path):
    """Two events of one request and time are one row, in one batch or in two."""
    def event(i):
        return {"eventId": i, "requestId": "a", "eventTime": AT, "eventName": "InvokeModel"}

    counts = []
    for name, batches in (("one", [["1", "2"]]), ("two", [["1"], ["2"]])):
        for n, ids in enumerate(batches):
            folder = tmp_path / f"{name}-{n}"
            folder.mkdir()
            (folder / "d.json").write_text(json.dumps({"Records": [event(i) for i in ids]}))
            ingest.ingest_audit(spark, str(folder), str(tmp_path / f"{name}-t"), str(tmp_path / f"{name}-l"), FAILED_AT)
        counts.append(readers.read_table(spark, str(tmp_path / f"{name}-t"), schemas.AUDIT_EVENTS, schemas.HOUR_PARTITIONS).count())
    assert counts == [1, 1]


def test_regions_may_lead_the_ingested_partitions(spark, tmp_path, call_log):
    keys = ("region", *schemas.HOUR_PARTITIONS)
    table = str(tmp_path / "calls")
    for _ in range(2):
        ingest.ingest_calls(spark, call_log, table, str(tmp_path / "l"), FAILED_AT, keys)
    assert (tmp_path / "calls/region=us-east-1/year=2024/month=01/day=15/hour=14").is_dir()
    assert readers.read_table(spark, table, schemas.CALLS, keys).count() == 2


def test_stream_equals_batch_and_restarts_clean(spark, tmp_path, call_log):
    """A restart, and a second stream over the same files, add nothing."""
    table, letters = str(tmp_path / "t"), str(tmp_path / "l")
    for state in ("c1", "c1", "c2"):
        jobs.run_batches(jobs.call_line_stream(spark, call_log), jobs.ingest_batch(table, letters, FAILED_AT), str(tmp_path / state))
    ingest.ingest_calls(spark, call_log, str(tmp_path / "b"), str(tmp_path / "bl"), FAILED_AT)
    streamed, batch = stored_calls(spark, table), stored_calls(spark, str(tmp_path / "b"))
    assert streamed.orderBy("requestid").collect() == batch.orderBy("requestid").collect()
    assert (tmp_path / "t/year=2024/month=01/day=15/hour=14").is_dir()
    assert spark.read.json(letters).count() == 5


def test_audit_and_billing_arrive_as_streams(spark, tmp_path):
    audit, exports = tmp_path / "audit", tmp_path / "exports"
    audit.mkdir()
    exports.mkdir()
    event = {"eventId": "1", "requestId": "a", "eventTime": AT, "eventName": "InvokeModel"}
    (audit / "a.json").write_text(json.dumps({"Records": [event, event]}))
    (audit / "b.json").write_text("{")
    (exports / "x.csv").write_text("\n".join([HEADER, export_line(), export_line("USE1-New-input-tokens", "7")]) + "\n")
    at = lambda name: str(tmp_path / name)
    for state in ("1", "2"):
        jobs.run_batches(jobs.audit_document_stream(spark, str(audit)), jobs.ingest_audit_batch(at("t"), at("l"), FAILED_AT), at(f"a{state}"))
        jobs.run_batches(jobs.billing_file_stream(spark, str(exports)), jobs.ingest_billing_batch(at("c"), at("m")), at(f"b{state}"))
    assert readers.read_table(spark, at("t"), schemas.AUDIT_EVENTS, schemas.HOUR_PARTITIONS).count() == 1
    assert spark.read.json(at("l")).count() == 1
    assert readers.read_table(spark, at("c"), schemas.COST_LINES, schemas.PERIOD_PARTITIONS).count() == 2
    assert readers.read_table(spark, at("m"), schemas.MODEL_BILLING_MAP).count() == 1


def test_metrics_and_identities_are_collected_once(spark, tmp_path, call_log):
    calls, metrics, known = (str(tmp_path / n) for n in ("calls", "metrics", "known"))
    ingest.ingest_calls(spark, call_log, calls, str(tmp_path / "l"), FAILED_AT)
    for _ in range(2):
        collect.collect_metrics(spark, calls, metrics, date(2024, 1, 15), date(2024, 1, 15))
        collect.collect_metrics(spark, calls, metrics, date(2024, 1, 16), date(2024, 1, 17))
        principals = stored_calls(spark, calls).select(F.col("callerarn").alias("principalarn"), "accountid")
        collect.store_identities(spark, principals, known, FAILED_AT)
    (row,) = readers.read_table(spark, metrics, schemas.METRICS, schemas.HOUR_PARTITIONS).collect()
    assert (row["timestamp"], row["invocationcount"], row["invocationlatencyp99"], row["hour"]) == ("2024-01-15T14:30:00.000Z", 2, 1200.0, "14")
    rows = readers.read_table(spark, known, schemas.IDENTITY_MAPPINGS).collect()
    assert sorted((r["displayname"], r["sourcetype"], r["accountid"]) for r in rows) == [("alice", "iam", "222222222222"), ("bob", "iam", "222222222222")]


def test_partition_filter_reaches_the_scan(spark, tmp_path, call_log):
    table = str(tmp_path / "calls")
    ingest.ingest_calls(spark, call_log, table, str(tmp_path / "l"), FAILED_AT)
    rows = stored_calls(spark, table).where("year = '2024' AND day = '15'").select("requestid")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "ReadSchema: struct<requestid:string>" in plan


def test_dynamic_overwrite_replaces_only_touched_days(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "usage_date string, v int"
    write = lambda rows: writers.overwrite_partitions(
        writers.with_day_partitions(spark.createDataFrame(rows, schema)), path
    )
    write([("2024-01-01", 1), ("2024-01-02", 2), ("unknown", 3)])
    write([("2024-01-02", 5)])
    rows = readers.read_table(spark, path, schema, schemas.DAY_PARTITIONS).agg(F.sum("v")).first()[0]
    assert rows == 1 + 5 + 3


def test_region_leads_the_partitions_of_several_regions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(AT, "us-east-1", 1), (AT, "eu-west-1", 2)], "timestamp string, region string, v int")
    keys = ("region", *schemas.HOUR_PARTITIONS)
    writers.append_partitioned(writers.with_hour_partitions(rows), path, keys)
    assert (tmp_path / "t/region=eu-west-1/year=2024/month=01/day=15/hour=14").is_dir()
    stored = readers.read_table(spark, path, "timestamp string, v int", keys)
    assert sorted((r["region"], r["v"]) for r in stored.collect()) == [("eu-west-1", 2), ("us-east-1", 1)]


def test_many_small_documents_are_read_by_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.json").write_text(json.dumps({"Records": [{"eventId": str(i)}]}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        documents = readers.read_audit_files(spark, str(tmp_path))
        assert documents.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert documents.select("Records.eventId").distinct().count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_audit_documents_are_read_once(spark, tmp_path):
    """What the job looks at several times are the parsed documents, not the files."""
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for row in rows:
            seen.add(1)
            yield row

    texts = [(json.dumps({"Records": [{"eventId": str(i), "eventName": "Converse", "eventTime": "2024-01-15T14:30:00Z"}]}), f"f{i}") for i in range(5)]
    texts.append(("{}", "f5"))
    rows = spark.sparkContext.parallelize(texts, 2).mapPartitions(counted)
    documents = readers.parse_audit_documents(spark.createDataFrame(rows, "value string, source_file string"))
    ingest.store_audit_documents(documents, str(tmp_path / "events"), str(tmp_path / "letters"), FAILED_AT)
    assert seen.value == 6
    assert readers.read_table(spark, str(tmp_path / "events"), schemas.AUDIT_EVENTS, schemas.HOUR_PARTITIONS).count() == 5
    assert spark.read.json(str(tmp_path / "letters")).count() == 1


def test_calls_are_stored_without_a_shuffle_of_whole_lines(spark, tmp_path):
    """Which lines are new is found on keys; a batch that repeats itself and the table is stored once all the same."""
    (tmp_path / "logs").mkdir()
    lines = [json.dumps(call(i, timestamp=f"2024-01-15T14:{i % 60:02d}:00.000Z")) for i in range(300)]
    (tmp_path / "logs" / "a.json").write_text("\n".join(lines + lines[:50]))
    paths = [str(tmp_path / name) for name in ("calls", "letters")]
    ingest.ingest_calls(spark, str(tmp_path / "logs"), *paths, FAILED_AT)
    (tmp_path / "logs" / "b.json").write_text("\n".join(lines[100:] + [json.dumps(call(i)) for i in range(300, 305)] + ["{"]))
    shuffled = []
    append = writers.append_partitioned

    def seen(rows, *args):
        shuffled.append(rows._jdf.queryExecution().optimizedPlan().toString())
        append(rows, *args)

    writers.append_partitioned = seen
    try:
        ingest.ingest_calls(spark, str(tmp_path / "logs"), *paths, FAILED_AT)
    finally:
        writers.append_partitioned = append
    stored = readers.read_table(spark, paths[0], schemas.CALLS, schemas.HOUR_PARTITIONS)
    assert stored.count() == 305 and stored.select("requestid", "timestamp").distinct().count() == 305
    assert spark.read.json(paths[1]).count() == 1
    assert len(shuffled) == 1 and "Window" not in shuffled[0]
