"""Command line: replay synthetic flows, read a capture, verify a ledger, train, sweep, check the installation, time the engine."""

from __future__ import annotations

import argparse
import ast
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import fusion, training
from .operators.logistic import Logistic
from .plans import engine, sweeps
from .sources import packets, synthetic

NETWORK = {"socket", "http", "urllib", "requests", "ssl", "ftplib", "smtplib"}


def network_imports(home: Path) -> list[str]:
    """Modules of the package that import a network client; a passive engine has none."""
    found = []
    for path in sorted(home.rglob("*.py")):
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) and not node.level else []
            found += [f"{path.name}: {n}" for n in names if n.split(".")[0] in NETWORK]
    return found


def show(spark: SparkSession, flows, cfg: engine.Config) -> None:
    got = engine.run(flows, cfg)
    engine.class_counts(got["alerts"]).orderBy("threat_class").show(truncate=False)
    fusion.ranked(got["incidents"], 1, 10).show(truncate=False)


def selftest(spark: SparkSession) -> dict[str, bool]:
    """What must hold of an installation: no network client, a ledger that verifies and shows an edit, models that survive writing."""
    records = spark.createDataFrame([(i, f"record {i}") for i in range(5)], "at int, body string")
    chained = fusion.chain(records, ["at"], "body").persist()
    edited = chained.withColumn("body", F.when(F.col("seq") == 3, "edited").otherwise(F.col("body")))
    model = Logistic(("a", "b"), (0.5, -1.0), 0.1, (0.0, 1.0), (1.0, 2.0), 0.4)
    alerts = engine.run(synthetic.flows(spark, 2000, duration=300.0, benign=0.6))["raised"]
    out = {
        "no network imports": not network_imports(Path(__file__).parent),
        "ledger verifies": bool(fusion.verify(chained).first().ok),
        "an edit shows": fusion.verify(edited).first().first_bad == 3,
        "models survive writing": Logistic.from_json(model.to_json()) == model,
        "the engine raises alerts": not alerts.isEmpty(),
    }
    chained.unpersist()
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewater")
    parser.add_argument("verb", choices=("replay", "capture", "ledger", "train", "sweep", "selftest", "bench"))
    parser.add_argument("--path")
    parser.add_argument("--flows", type=int, default=100_000)
    parser.add_argument("--duration", type=float, default=1800.0)
    parser.add_argument("--seed", type=int, default=1337)
    parser.add_argument("--jitter", type=float, default=0.2)
    parser.add_argument("--window", type=float, default=60.0)
    parser.add_argument("--single-direction", action="store_true")
    args = parser.parse_args(argv)
    cfg = engine.Config(width=args.window, one_way=args.single_direction)
    spark = SparkSession.builder.appName("tidewater").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.verb == "selftest":
        found = selftest(spark)
        for name, good in found.items():
            print(f"{name}: {'ok' if good else 'FAILED'}")
        return int(not all(found.values()))
    if args.verb == "ledger":
        said = fusion.verify(spark.read.parquet(args.path)).first()
        print(f"{said.n} records, {'whole' if said.ok else f'broken at {said.first_bad}'}")
        return int(not said.ok)
    if args.verb == "sweep":
        sweeps.jitter_sweep(spark, count=args.flows).orderBy("jitter").show()
        return 0
    if args.verb == "train":
        models, _, report = training.trained(engine.windowed(synthetic.flows(spark, args.flows, args.seed, args.duration, jitter=args.jitter), cfg))
        for name, model in models.items():
            print(name, report[name])
            if args.path:
                Path(args.path).mkdir(parents=True, exist_ok=True)
                (Path(args.path) / f"{name}.json").write_text(model.to_json(), encoding="utf-8")
        return 0
    if args.verb == "capture":
        read = packets.assemble(packets.decode(packets.read_captures(spark, args.path)))
        show(spark, read.withColumn("seq", F.monotonically_increasing_id()).withColumn("label", F.lit("benign")), cfg)
        return 0
    flows = synthetic.flows(spark, args.flows, args.seed, args.duration, jitter=args.jitter)
    began = time.time()
    show(spark, flows, cfg)
    if args.verb == "bench":
        print(f"{args.flows / (time.time() - began):.0f} flows a second")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
