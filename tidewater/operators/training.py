"""Training sets for the learned detectors out of labelled flows, and the models fitted on them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from . import detectors as D
from . import evaluation as E
from . import logistic as L

c = F.col

#: The models' inputs, in order.
BEACON = ["regularity", "jitter_band", "interval_cv", "mad_ratio", "byte_cv", "n_events", "dst_prevalence", "dst_external"]
DGA = ["length", "entropy", "vowel_ratio", "digit_ratio", "consonant_run", "bigram_ll", "n_labels"]
EXFIL = ["out_in_ratio", "deviation", "log_bytes_out", "dst_concentration", "dst_novelty", "dst_external", "out_share", "n_flows"]


def _mostly(flows: DataFrame, keys: list[str], threat: str) -> DataFrame:
    """keys, y: whether over half of the flows carry the label."""
    return flows.groupBy(*keys).agg((F.avg((c("label") == threat).cast("double")) > 0.5).cast("int").alias("y"))


def beacon_set(flows: DataFrame, cfg: D.Beacon = D.Beacon()) -> DataFrame:
    """A row a (source, destination) with enough sessions: its timing over the whole capture, ts and y."""
    heard = flows.where((c("proto") == "tcp") & (c("syn") > 0))
    whole = heard.withColumn("window_end", F.lit(0.0))
    rows = D.beacon_pairs(whole, replace(cfg, width=1.0, horizon=float("inf"), min_hosts=0, model=None))
    first = heard.groupBy("src_ip", "dst_ip").agg(F.min("ts").alias("ts"))
    return rows.join(_mostly(heard, ["src_ip", "dst_ip"], "c2_beaconing"), ["src_ip", "dst_ip"]).join(first, ["src_ip", "dst_ip"]).select("src_ip", "dst_ip", *BEACON, "ts", "y")


def dga_set(flows: DataFrame, bigrams: DataFrame) -> DataFrame:
    """A row a lookup: what its name looks like, ts and y. Distinct names are measured once."""
    asked = flows.where(F.coalesce("dns_qname", F.lit("")) != "")
    names = asked.select("dns_qname").distinct()
    likely = X.bigram_likelihood(names.withColumn("body", X.first_label(c("dns_qname"))), bigrams, "dns_qname", "body")
    measured = names.select("dns_qname", *[v.alias(k) for k, v in X.lexical(c("dns_qname")).items()]).join(likely, "dns_qname")
    return asked.select("dns_qname", "ts", (c("label") == "dga_resolution").cast("int").alias("y")).join(measured, "dns_qname").select("dns_qname", *DGA, "ts", "y")


def exfil_set(windowed: DataFrame, cfg: D.Exfil = D.Exfil()) -> DataFrame:
    """A row a (window, source) past the gate: what the detector sees there, ts and y."""
    rows = D.exfil_windows(windowed, replace(cfg, model=None, min_hosts=0))
    return rows.join(_mostly(windowed.where("proto = 'tcp'"), ["window_end", "src_ip"], "data_exfiltration"), ["window_end", "src_ip"]).select("src_ip", *EXFIL, c("window_end").alias("ts"), "y")


def fitted(rows: DataFrame, features: list[str], epochs: int = 600) -> tuple[L.Logistic, dict]:
    """A model fitted on the first 70 % in time, its threshold the best on the same rows, and its measures on the rest."""
    split = E.temporal_split(rows, ["ts", *features]).persist()
    early, late = split.where("train"), split.where("NOT train")
    model = L.fit(early, features, epochs=epochs)
    cut = L.choose_threshold(early.withColumn("score", model.probability()))
    model = replace(model, threshold=cut)
    said = E.binary(late.withColumn("fired", model.probability() >= cut)).first().asDict()
    split.unpersist()
    return model, said


def trained(windowed: DataFrame, epochs: int = 600) -> tuple[dict[str, L.Logistic], DataFrame, dict[str, dict]]:
    """Models of the beacon, dga and exfil detectors, the benign names' bigram table, and each model's held-out measures.

    Every model sees what its detector will see; the bigram table is learned from benign lookups only.
    """
    bigrams = X.bigram_table(windowed.where("label = 'benign'")).persist()
    sets = {"beacon": (beacon_set(windowed), BEACON), "dga": (dga_set(windowed, bigrams), DGA), "exfil": (exfil_set(windowed), EXFIL)}
    models, report = {}, {}
    for name, (rows, features) in sets.items():
        models[name], report[name] = fitted(rows, features, epochs)
    return models, bigrams, report
