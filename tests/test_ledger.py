from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidewater.operators import fusion
from tidewater.plans import flow_queries
from tidewater.sources import tables


def test_ledger_chains_every_flow(spark, small):
    flows = tables.event_flows(spark, small).select("seq", F.concat_ws("/", "src_ip", "dst_ip", F.col("bytes_out").cast("string")).alias("body"))
    last, want = "0" * 64, []
    for i, r in enumerate(sorted(flows.collect()), 1):
        sha = hashlib.sha256(f"{last}|{i}|{r.body}".encode()).hexdigest()
        want.append((i, r.body, last, sha))
        last = sha
    assert len(want) > 400
    assert sorted(map(tuple, flow_queries.QUERIES["ledger_chain"](spark, small).collect())) == want
    got = {r.kind: (r.ok, r.n, r.first_bad) for r in flow_queries.QUERIES["ledger_verify"](spark, small).collect()}
    assert got == {"whole": (True, len(want), None), "edited": (False, len(want), 123)}


def test_chain_of_null_bodies_ties_and_none(spark):
    rows = spark.createDataFrame([(2, "b"), (1, None), (2, "a"), (None, "z")], "at int, body string")
    made = sorted(fusion.chain(rows, ["at"], "body").collect())
    assert [r.body for r in made] == ["z", None, "a", "b"]
    assert made[1].sha256 == hashlib.sha256(f"{made[0].sha256}|2".encode()).hexdigest()
    assert fusion.chain(rows.limit(0), ["at"], "body").count() == 0
