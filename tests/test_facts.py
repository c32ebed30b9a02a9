"""Facts kept up to date by changed days equal a full rebuild."""

import json
import os
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from spendloom import schemas
from spendloom.operators import dataset
from spendloom.plans import facts, ingest, reconcile
from spendloom.sources import readers

from test_jobs import FAILED_AT, HEADER, call, export_line


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).collect())


def test_only_changed_days_are_computed_again(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "logs").mkdir()
    (tmp_path / "exports").mkdir()

    def load(name, calls, costs):
        if calls:
            (tmp_path / "logs" / f"{name}.json").write_text("\n".join(json.dumps(c) for c in calls))
            ingest.ingest_calls(spark, at("logs"), at("calls"), at("letters"), FAILED_AT)
        if costs:
            (tmp_path / "exports" / f"{name}.csv").write_text("\n".join([HEADER, *costs]) + "\n")
            ingest.ingest_billing(spark, readers.read_billing_csv(spark, at("exports")), at("costs"))
            reconcile.run(spark, at("costs"), at("calls"), at("reconciled"), date(2024, 2, 1))

    def check(expected):
        assert facts.update(spark, at("calls"), at("reconciled"), at("facts")) == expected
        calls = readers.read_table(spark, at("calls"), schemas.CALLS, schemas.HOUR_PARTITIONS)
        costs = reconcile.read(spark, at("reconciled"))
        assert rows_of(facts.read(spark, at("facts"))) == rows_of(dataset.usage_facts(calls, costs))

    on = lambda i, day, **more: call(i, timestamp=f"2024-01-{day}T14:30:00.000Z", **more)
    load("a", [on(1, "15"), on(2, "15", user="bob"), on(3, "16"), on(4, "17")], None)
    assert facts.read(spark, at("facts")) is None
    check(["2024-01-15", "2024-01-16", "2024-01-17"])
    check([])
    # costs come: the days they are for
    load("b", None, [export_line(), export_line(day="2024-01-16T00:00:00Z", cost="7")])
    check(["2024-01-15", "2024-01-16"])
    # one more call: its day only; the files of other days are not opened
    load("c", [on(5, "17", user="carol"), on(6, "20")], None)
    spoilt = {f: f.read_bytes() for d in ("15", "16") for f in Path(at("calls")).glob(f"year=2024/month=01/day={d}/*/*.parquet")}
    for f, raw in spoilt.items():
        stamp = f.stat().st_mtime_ns
        f.write_bytes(b"x" * len(raw))


        os.utime(f, ns=(stamp, stamp))
    assert facts.update(spark, at("calls"), at("reconciled"), at("facts")) == ["2024-01-17", "2024-01-20"]
    for f, raw in spoilt.items():
        stamp = f.stat().st_mtime_ns
        f.write_bytes(raw)
        os.utime(f, ns=(stamp, stamp))
    check([])
    # a corrected export without the second day: both days it had or has costs for
    load("d", None, [export_line(cost="3")])
    check(["2024-01-15", "2024-01-16"])
