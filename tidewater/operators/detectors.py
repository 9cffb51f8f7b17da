"""The nine detectors: each takes flows with window_end and returns detections.

A detection has window_end, threat_class, src_ip, dst_ip, score, ts_event, observed_flows, evidence (JSON),
reverse_direction_visible and caveat. Cheap aggregates come first and gate the dear ones.

Fixed values: thresholds, weights and lists of ports stand in frozen configurations and in the scores; their defaults are the
product's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as X
from ..schema import CAVEATS
from .folds import scan
from .logistic import Logistic

c = F.col
DETECTION = ["window_end", "threat_class", "src_ip", "dst_ip", "score", "ts_event", "observed_flows", "evidence", "reverse_direction_visible", "caveat"]


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def _detection(df: DataFrame, threat: str, evidence: list[str], caveat: Column | str | None = None, reverse: Column | None = None, model: Logistic | None = None) -> DataFrame:
    """Rows as detections. With a model, the evidence has the largest parts of its verdict as well."""
    said = F.struct(*evidence, *([model.explain().alias("attribution")] if model else []))
    told = {"reverse_direction_visible": F.lit(True) if reverse is None else reverse, "caveat": caveat if isinstance(caveat, Column) else F.lit(caveat).cast("string")}
    out = df.withColumns({"threat_class": F.lit(threat), "evidence": F.to_json(said), "observed_flows": c("observed_flows").cast("bigint"), **told})
    return out.select(*DETECTION)


# -- recon ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Recon:
    min_targets: int = 40
    unanswered: float = 0.85
    threshold: float = 0.5


def recon_fanout(flows: DataFrame, cfg: Recon = Recon()) -> DataFrame:
    """Fan-out of a source over (host, port) targets in a window, scored; rows that reach the gate, fired or not."""
    asked = flows.where((c("proto") == "tcp") & (c("syn") > 0) & (F.coalesce("ics_proto", F.lit("")) == ""))
    target = asked.groupBy("window_end", "src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("n"), F.sum((c("synack") <= 0).cast("int")).alias("dead"), F.max((c("synack") > 0) | (c("bytes_in") > 0)).alias("back"), F.min("ts").alias("first"))
    src = target.groupBy("window_end", "src_ip").agg(F.count("*").alias("targets"), F.count_distinct("dst_ip").alias("hosts"), F.count_distinct("dst_port").alias("ports"), F.sum("n").alias("observed_flows"), F.sum("dead").alias("dead"), F.max("back").alias("reverse_visible"), F.min("first").alias("ts_event"))
    src = src.where(c("targets") >= cfg.min_targets).withColumn("unanswered", c("dead") / c("observed_flows"))
    seen = F.when(c("unanswered") >= cfg.unanswered, F.least(c("targets") / 300.0, F.lit(1.0)) * 0.55 + c("unanswered") * 0.45)
    blind = F.when(c("targets") >= cfg.min_targets * 1.5, F.least(c("targets") / 250.0, F.lit(1.0)) * 0.70)
    score = F.when(c("reverse_visible"), seen).otherwise(blind)
    return src.withColumn("score", F.when(score.isNotNull(), F.least(score, F.lit(1.0)))).drop("dead")  # least() passes nulls over


def recon(flows: DataFrame, cfg: Recon = Recon()) -> DataFrame:
    fired = recon_fanout(flows, cfg).where(c("score") >= cfg.threshold)
    return _detection(fired.withColumn("dst_ip", F.concat(c("hosts").cast("string"), F.lit(" hosts"))), "recon_scanning", ["ports", "hosts", "targets", "unanswered", "reverse_visible"], F.when(~c("reverse_visible"), CAVEATS["one_way_scan"]), c("reverse_visible"))


# -- floods -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Flood:
    min_flows: int = 150
    entropy_floor: float = 6.0
    completion_ceiling: float = 0.20
    amplifiers: tuple[int, ...] = (53, 123, 1900, 11211, 19, 389, 137, 161)
    reply_bytes: int = 600
    keep: float = 0.8
    threshold: float = 0.5


def flood_windows(flows: DataFrame, cfg: Flood = Flood()) -> DataFrame:
    """A row a (window, destination): counts, source entropy, handshake completion, reflections.

    A reflection is a large reply from an amplifier's port; from a client's port to a served one it is a question.
    """
    heard = flows.where((c("syn") > 0) | (c("proto") == "udp"))
    udp, tcp = c("proto") == "udp", c("proto") == "tcp"
    served = [p for p in cfg.amplifiers if p < 1024]
    asks = (c("src_port") >= 1024) & F.coalesce(c("dst_port").isin(*served), F.lit(False))  # 1900 and 11211 are clients' ports too
    reply = udp & c("src_port").isin(*cfg.amplifiers) & ~asks & (c("bytes_out") / F.greatest("pkts_out", F.lit(1)) >= cfg.reply_bytes)
    total = lambda cond, what=F.lit(1): F.sum(F.when(cond, what).otherwise(0))
    src = heard.groupBy("window_end", "dst_ip", "src_ip").agg(F.count("*").alias("k"), total(udp).alias("udp"), total(tcp).alias("tcp"), total(reply).alias("reflections"), total(tcp, c("syn")).alias("syns"), total(tcp, c("synack")).alias("synacks"), F.min("ts").alias("ts_event"))
    sums = [F.sum(x).alias(x) for x in ("udp", "tcp", "reflections", "syns", "synacks")]
    dst = src.groupBy("window_end", "dst_ip").agg(F.sum("k").alias("n"), F.count("*").alias("sources"), F.sum(c("k") * F.log2("k")).alias("s"), *sums, F.min("ts_event").alias("ts_event"))
    entropy = F.when(c("n") <= 1, 0.0).otherwise(F.greatest(F.log2("n") - c("s") / c("n"), F.lit(0.0)))
    done = F.when(c("tcp") >= 0.5 * c("n"), c("synacks") / F.when(c("syns") == 0, 1).otherwise(c("syns")))
    return dst.select("window_end", "dst_ip", "n", "sources", entropy.alias("entropy"), done.alias("completion"), "udp", "reflections", "ts_event")


def flood_scores(flows: DataFrame, cfg: Flood = Flood()) -> DataFrame:
    """``flood_windows`` with base (the rate learned before the window) and score.

    The base is a moving mean over a destination's windows that stays frozen while a window scores as an attack; the
    windows of a destination (one row each, whatever the number of flows) are scanned in order.
    """
    per = flood_windows(flows, cfg)

    def score(x: dict, base: float) -> float | None:
        if x["n"] < cfg.min_flows:
            return None
        surge, total = x["n"] / max(base, 1.0), 0.0
        if x["entropy"] >= cfg.entropy_floor:
            total += min((x["entropy"] - cfg.entropy_floor) / 4.0, 1.0) * 0.45
        if x["completion"] is None:
            total += min(max(surge - 5.0, 0.0) / 10.0, 1.0) * 0.35
        elif x["completion"] <= cfg.completion_ceiling:
            total += (1.0 - x["completion"] / max(cfg.completion_ceiling, 1e-9)) * 0.35
        if surge > 3.0:
            total += min((surge - 3.0) / 10.0, 1.0) * 0.20
        if x["udp"] > 0 and x["reflections"] >= max(0.3 * x["udp"], 20.0):
            total += 0.25
        return min(total, 1.0)

    def step(base: float, x: dict) -> tuple[float, tuple]:
        s = score(x, base)
        held = s is not None and s >= cfg.threshold
        return base if held else cfg.keep * base + (1 - cfg.keep) * x["n"], (base, s)

    return scan(per, ["dst_ip"], ["window_end"], 0.0, step, "base double, score double", ["n", "entropy", "completion", "udp", "reflections"])


def flood(flows: DataFrame, cfg: Flood = Flood()) -> DataFrame:
    fired = flood_scores(flows, cfg).where(c("score") >= cfg.threshold)
    kind = F.when((c("udp") > 0) & (c("reflections") >= F.greatest(0.3 * c("udp"), F.lit(20.0))), "udp_reflection_amplification").when(c("entropy") >= cfg.entropy_floor, "spoofed_flood").otherwise("protocol_flood")
    named = fired.withColumns({"src_ip": F.concat(c("sources").cast("string"), F.lit(" sources")), "attack_kind": kind, "observed_flows": c("n"), "surge": c("n") / F.greatest("base", F.lit(1.0))})
    return _detection(named, "volumetric_ddos", ["entropy", "sources", "completion", "surge", "attack_kind", "reflections"])


# -- what was seen before ---------------------------------------------------------------------------------------------


def cumulative_distinct(df: DataFrame, key: str, item: str, out: str) -> DataFrame:
    """(key, window_end, out): how many distinct items a key has had up to and with a window in which it occurs.

    First sightings are aggregated before the running sum, which so has a row a key and window.
    """
    first = df.groupBy(key, item).agg(F.min("window_end").alias("window_end"))
    new = first.groupBy(key, "window_end").agg(F.count("*").alias("k"))
    seen = df.select(key, "window_end").distinct().withColumn("k", F.lit(0).cast("bigint"))
    rows = new.unionByName(seen).groupBy(key, "window_end").agg(F.sum("k").alias("k"))
    return rows.select(key, "window_end", F.sum("k").over(Window.partitionBy(key).orderBy("window_end").rowsBetween(Window.unboundedPreceding, 0)).alias(out))


def inside_hosts(df: DataFrame) -> DataFrame:
    """(window_end, hosts): distinct private sources up to and with each window. One row a window."""
    first = df.where(X.is_private(c("src_ip"))).groupBy("src_ip").agg(F.min("window_end").alias("window_end"))
    new = first.groupBy("window_end").agg(F.count("*").alias("k"))
    rows = new.unionByName(df.select("window_end").distinct().withColumn("k", F.lit(0).cast("bigint"))).groupBy("window_end").agg(F.sum("k").alias("k"))
    return rows.select("window_end", F.sum("k").over(Window.orderBy("window_end").rowsBetween(Window.unboundedPreceding, 0)).alias("hosts"))


# -- beacons ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Beacon:
    width: float = 60.0
    horizon: float = 3600.0
    min_events: int = 6
    min_hosts: int = 4
    idle: int | None = None  # widths of silence after which the windows' clock was realigned
    model: Logistic | None = None
    threshold: float = 0.6


def window_ends(flows: DataFrame, width: float, idle: int | None = None) -> list[float]:
    """All window ends in order: those of flows, and those of windows without any in between, if the clock wasn't realigned.

    One number a window of the time span, whatever the number of flows.
    """
    held = sorted(r[0] for r in flows.select("window_end").where("window_end IS NOT NULL").distinct().collect())
    out = held[:1]
    for before, after in zip(held, held[1:], strict=False):
        steps = (after - before) / width
        n = round(steps)
        if abs(steps - n) < 1e-6 and (idle is None or n <= idle + 1):
            out += [before + i * width for i in range(1, n)]
        if abs(steps) > 1e-6:  # sums of the same widths may differ in the last bit
            out.append(after)
    return out


_TIMED = "src_ip string, dst_ip string, window_end double, n_events bigint, m double, sd double, bm double, bsd double, med double, mad double, latest_ts double, sni string"


def _timing(ends: list[float], cfg: Beacon):
    """mapInArrow over flows sorted by pair and time: the pair's statistics at each window end of the horizon after them.

    Only the open pair's flows of one horizon are held.
    """
    at = np.array(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pair, ts, sent, name = None, np.empty(0), np.empty(0), None

        def close(first: int, before: float) -> int:
            """Statistics at the ends from number ``first`` on that lie before ``before``."""
            nonlocal ts, sent
            while first < len(at) and at[first] < before - 1e-6 and len(ts):
                end = at[first]
                young = int(np.searchsorted(ts, end - cfg.horizon, "left"))
                if young:
                    ts, sent = ts[young:], sent[young:]
                n, first = len(ts), first + 1
                if n < cfg.min_events:
                    continue
                gaps = np.diff(ts)
                med = float(np.median(gaps)) if n > 1 else None
                out.append((*pair, float(end), n, float(gaps.mean()) if n > 1 else None, float(gaps.std(ddof=1)) if n > 2 else None, float(sent.mean()), float(sent.std(ddof=1)) if n > 1 else None, med, float(np.median(np.abs(gaps - med))) if n > 1 else None, float(ts[-1]), name))
            return first

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 12
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.string(), pa.string(), pa.float64(), pa.int64(), *[pa.float64()] * 7, pa.string()], strict=True)], names=[x.split()[0] for x in _TIMED.split(", ")])
            out.clear()
            return batch

        place = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            src, dst, names = (batch.column(k).to_pylist() for k in (0, 1, 5))
            times, own, octets = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            new = np.flatnonzero([i == 0 or src[i] != src[i - 1] or dst[i] != dst[i - 1] or own[i] != own[i - 1] for i in range(len(src))])
            for a, b in zip(new, np.append(new[1:], len(src)), strict=True):  # flows of one pair and window
                if (src[a], dst[a]) != pair:
                    close(place, np.inf)
                    pair, ts, sent, place = (src[a], dst[a]), np.empty(0), np.empty(0), int(np.searchsorted(at, own[a] - 1e-6))
                place = max(close(place, own[a]), int(np.searchsorted(at, own[a] - 1e-6)) if not len(ts) else 0)
                ts, sent, name = np.concatenate((ts, times[a:b])), np.concatenate((sent, octets[a:b].astype(float))), names[b - 1]
            if len(out) > 20_000:
                yield made()
        if pair is not None:
            close(place, np.inf)
        yield made()

    return run


def beacon_pairs(flows: DataFrame, cfg: Beacon = Beacon()) -> DataFrame:
    """Timing of each (source, destination) over the horizon that ends with each window: features and score.

    Flows are dealt and sorted by pair once; pairs that never reach the gate are left out there. One pass then keeps a
    pair's flows of one horizon and has its statistics at every window end, on whichever clock the windows run.
    """
    heard = flows.where((c("proto") == "tcp") & (c("syn") > 0) & (F.coalesce("ics_proto", F.lit("")) == ""))
    pair = ["src_ip", "dst_ip"]
    dealt = heard.select(*pair, "ts", "window_end", "bytes_out", "tls_sni", "seq").repartition(*pair).sortWithinPartitions(*pair, "ts", "seq")
    able = dealt.withColumn("_n", F.count("*").over(Window.partitionBy(*pair))).where(c("_n") >= cfg.min_events).drop("_n", "seq")
    stats = able.mapInArrow(_timing(window_ends(flows, cfg.width, cfg.idle), cfg), _TIMED)
    known = cumulative_distinct(heard, "dst_ip", "src_ip", "dst_prevalence")
    hosts = inside_hosts(heard)
    met = _as_of(stats, known, "dst_ip", "dst_prevalence")
    cv = X.variation(c("m"), c("sd"))
    met = met.select(
        "window_end", "src_ip", "dst_ip", c("n_events").cast("double").alias("n_events"), "m", c("dst_prevalence").cast("double").alias("dst_prevalence"), c("latest_ts").alias("ts_event"), "sni",
        X.regularity(cv).alias("regularity"), X.jitter_band(cv).alias("jitter_band"), cv.alias("interval_cv"), (c("mad") / F.when(c("med") == 0, 1.0).otherwise(c("med"))).alias("mad_ratio"),
        X.variation(c("bm"), c("bsd")).alias("byte_cv"), (~X.is_private(c("dst_ip"))).cast("double").alias("dst_external"),
    )
    part = lambda f, top, weight: F.when(c(f) < top, (1.0 - c(f) / top) * weight).otherwise(0.0)
    by_hand = F.least(part("interval_cv", 0.45, 0.5) + part("mad_ratio", 0.35, 0.25) + part("byte_cv", 0.25, 0.25), F.lit(1.0)) * F.when(c("dst_prevalence") >= 3, 0.25).otherwise(1.0)
    scored = met.withColumn("score", cfg.model.probability() if cfg.model else by_hand)
    few = hosts.where(c("hosts") < cfg.min_hosts).select(F.max("window_end").alias("_few"))  # one row: the last window of few hosts
    alone = c("window_end") <= F.coalesce(c("_few"), F.lit(float("-inf")))
    return scored.crossJoin(F.broadcast(few)).where(~(alone & X.is_service_name(F.coalesce("sni", F.lit(""))))).drop("_few")


def _as_of(wanted: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """``wanted`` with the latest known value of its key at or before its window_end, by one ordered pass over both."""
    asks = wanted.columns
    empty = [F.lit(None).cast(t).alias(k) for k, t in wanted.dtypes if k not in (key, "window_end")]
    rows = known.select(key, "window_end", *empty, value, F.lit(0).alias("_ask")).unionByName(wanted.withColumns({value: F.lit(None).cast(dict(known.dtypes)[value]), "_ask": F.lit(1)}))
    order = Window.partitionBy(key).orderBy(F.round(c("window_end") * 1e6), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, True).over(order)).where("_ask = 1").select(*asks, value)


def beacon(flows: DataFrame, cfg: Beacon = Beacon()) -> DataFrame:
    limit = cfg.model.threshold if cfg.model else cfg.threshold
    fired = beacon_pairs(flows, cfg).where(c("score") >= limit).withColumn("observed_flows", c("n_events"))
    return _detection(fired, "c2_beaconing", ["m", "interval_cv", "jitter_band", "mad_ratio", "byte_cv", "dst_prevalence", "dst_external"], model=cfg.model)


# -- names ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dga:
    min_queries: int = 8
    model: Logistic | None = None
    threshold: float = 0.55


def name_scores(flows: DataFrame, cfg: Dga = Dga(), bigrams: DataFrame | None = None) -> DataFrame:
    """Flows with a queried name, and name_score: the model's, or by hand without one. Distinct names are scored once."""
    asked = flows.where(F.coalesce("dns_qname", F.lit("")) != "")
    names = asked.select("dns_qname").distinct()
    lexical = X.lexical(c("dns_qname"))
    named = names.withColumns({f"_{k}": v for k, v in lexical.items()})
    of = {k: c(f"_{k}") for k in lexical}
    if cfg.model:
        if bigrams is not None:
            bodies = names.withColumn("body", X.first_label(c("dns_qname")))
            named = named.join(X.bigram_likelihood(bodies, bigrams, "dns_qname", "body"), "dns_qname")
            of["bigram_ll"] = c("bigram_ll")
        score = cfg.model.probability(of | ({} if bigrams is not None else {"bigram_ll": F.lit(0.0)}))
    else:
        score = F.when(of["entropy"] > 3.2, 0.4).otherwise(0.0) + F.when(of["vowel_ratio"] < 0.30, 0.3).otherwise(0.0) + F.when(of["consonant_run"] >= 4, 0.3).otherwise(0.0)
    return asked.join(named.select("dns_qname", score.alias("name_score")), "dns_qname")


def dga_hosts(flows: DataFrame, cfg: Dga = Dga(), bigrams: DataFrame | None = None) -> DataFrame:
    """A row a (window, source) with enough queries: rates, score, and its three worst names."""
    rows = name_scores(flows, cfg, bigrams)
    worst = Window.partitionBy("window_end", "src_ip").orderBy(c("name_score").desc(), "seq")
    top = rows.select("window_end", "src_ip", "name_score", "seq", "dns_qname", F.row_number().over(worst).alias("r")).where("r <= 3")
    top = top.groupBy("window_end", "src_ip").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "dns_qname"))), lambda x: x["dns_qname"]).alias("examples"))
    src = rows.groupBy("window_end", "src_ip").agg(F.count("*").alias("observed_flows"), _share(c("name_score") > 0.5).alias("suspicious"), _share(F.coalesce(c("dns_rcode") == "NXDOMAIN", F.lit(False))).alias("nx"), F.avg("name_score").alias("mean_score"), F.min("ts").alias("ts_event"), F.min_by("dst_ip", F.struct("ts", "seq")).alias("dst_ip"))
    src = src.where(c("observed_flows") >= cfg.min_queries).withColumn("score", F.least(0.55 * c("suspicious") + 0.45 * F.least(c("nx") * 1.6, F.lit(1.0)), F.lit(1.0)))
    return src.join(top, ["window_end", "src_ip"])


def dga(flows: DataFrame, cfg: Dga = Dga(), bigrams: DataFrame | None = None) -> DataFrame:
    fired, said = dga_hosts(flows, cfg, bigrams).where(c("score") >= cfg.threshold), ["nx", "suspicious", "mean_score", "examples"]
    if cfg.model:  # why the worst name scored as it did
        fired, ll = fired.withColumn("worst", c("examples")[0]), F.lit(0.0)
        if bigrams is not None:
            bodies = fired.select("worst").distinct().withColumn("body", X.first_label(c("worst")))
            fired, ll = fired.join(X.bigram_likelihood(bodies, bigrams, "worst", "body"), "worst"), c("bigram_ll")
        fired, said = fired.withColumn("attribution", cfg.model.explain(X.lexical(c("worst")) | {"bigram_ll": ll})), [*said, "attribution"]
    return _detection(fired, "dga_resolution", said)


@dataclass(frozen=True)
class Tunnel:
    min_queries: int = 15
    long_name: int = 50
    many: int = 60
    threshold: float = 0.6


def tunnel_parents(flows: DataFrame, cfg: Tunnel = Tunnel()) -> DataFrame:
    asked = flows.where(F.coalesce("dns_qname", F.lit("")) != "").withColumn("parent", X.registrable(c("dns_qname")))
    keys = ["window_end", "src_ip", "parent"]
    name = asked.groupBy(*keys, "dns_qname").agg(F.count("*").alias("n"), F.sum(c("dns_qtype").isin("TXT", "NULL", "CNAME").cast("int")).alias("odd"), F.sum("bytes_out").alias("up"), F.sum("bytes_in").alias("down"), F.min("ts").alias("first"))
    size = F.char_length("dns_qname")
    whole = name.groupBy(*keys).agg(F.sum("n").alias("observed_flows"), F.count("*").alias("unique_names"), F.sum(F.when(size >= cfg.long_name, c("n")).otherwise(0)).alias("long"), F.sum(F.coalesce("odd", F.lit(0))).alias("odd"), F.sum(size * c("n")).alias("chars"), F.sum("up").alias("bytes_up"), F.sum("down").alias("bytes_down"), F.min("first").alias("ts_event"))
    n = c("observed_flows")
    whole = whole.where(n >= cfg.min_queries).select(*keys, n, "unique_names", (c("long") / n).alias("long_rate"), (c("odd") / n).alias("type_rate"), (c("unique_names") / n).alias("unique_rate"), (c("chars") / n).alias("mean_length"), "bytes_up", "bytes_down", "ts_event")
    return whole.withColumn("score", F.least(0.40 * c("long_rate") + 0.25 * c("type_rate") + 0.20 * c("unique_rate") + F.when(n > cfg.many, 0.15).otherwise(0.0), F.lit(1.0)))


def tunnel(flows: DataFrame, cfg: Tunnel = Tunnel()) -> DataFrame:
    fired = tunnel_parents(flows, cfg).where(c("score") >= cfg.threshold).withColumn("dst_ip", c("parent"))
    return _detection(fired, "dns_tunnelling", ["unique_names", "mean_length", "long_rate", "type_rate", "bytes_up", "bytes_down"])


# -- encrypted sessions -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tls:
    min_hosts: int = 4
    ceiling: float = 0.85
    threshold: float = 0.55


def tls_pairs(flows: DataFrame, cfg: Tls = Tls()) -> DataFrame:
    """A row a (window, source, destination) of encrypted sessions, with rarity so far, shape and score."""
    seen = flows.where(F.coalesce("tls_ja4", F.lit("")) != "")
    days = F.when(F.coalesce("tls_cert_days", F.lit(0)) == 0, 999).otherwise(c("tls_cert_days"))  # 0 counts as not known
    count = lambda cond: F.coalesce(F.size(F.filter("pkt_sizes", cond)), F.lit(0))
    amount = F.aggregate(F.coalesce("pkt_sizes", F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda s, x: s + F.abs(x))
    pair = seen.groupBy("window_end", "src_ip", "dst_ip").agg(
        F.max_by("tls_ja4", F.struct("ts", "seq")).alias("ja4"), F.bool_or(F.coalesce("tls_self_signed", F.lit(False))).alias("self_signed"), F.min(days).alias("min_days"), F.bool_and(F.coalesce("tls_sni", F.lit("")) == "").alias("no_sni"), F.bool_or(c("tls_cert_days").isNotNull()).alias("cert_seen"),
        F.sum(count(lambda x: x > 0)).alias("sent"), F.sum(count(lambda x: x == x)).alias("packets"), F.sum(amount).alias("amount"), F.min("ts").alias("ts_event"), F.count("*").alias("observed_flows"),
    )
    ja4 = cumulative_distinct(seen.withColumn("ja4", c("tls_ja4")), "ja4", "src_ip", "ja4_hosts")
    dst = cumulative_distinct(seen, "dst_ip", "src_ip", "dst_hosts")
    met = pair.join(ja4, ["ja4", "window_end"]).join(dst, ["dst_ip", "window_end"]).join(inside_hosts(seen), "window_end")
    rare = c("hosts") >= cfg.min_hosts
    met = met.withColumns({"out_share": F.when(c("packets") > 0, c("sent") / c("packets")).otherwise(0.0), "size_mean": F.when(c("packets") > 0, c("amount") / c("packets")).otherwise(0.0)})
    add = lambda cond, w: F.when(cond, w).otherwise(0.0)
    graded = lambda n, one, few: F.when(c(n) <= 1, one).when(c(n) <= 3, few).otherwise(0.0)
    full = F.least(add(rare & (c("ja4_hosts") <= 1), 0.35) + add(c("self_signed"), 0.25) + add(c("min_days") <= 30, 0.20) + add(c("no_sni"), 0.10) + add(c("out_share") > 0.6, 0.10), F.lit(1.0))
    by_rarity = F.when(rare, graded("ja4_hosts", 0.30, 0.15) + graded("dst_hosts", 0.25, 0.12) + add(~X.is_private(c("dst_ip")), 0.10) + add(c("no_sni"), 0.10)).otherwise(0.0)
    part = F.least(by_rarity + F.when(c("out_share") > 0.6, F.when(rare, 0.15).otherwise(0.30)).otherwise(0.0) + add(c("out_share") > 0.85, 0.15), F.lit(cfg.ceiling))
    return met.withColumn("score", F.when(c("cert_seen"), full).otherwise(part)).drop("sent", "packets", "amount")


def tls(flows: DataFrame, cfg: Tls = Tls()) -> DataFrame:
    return _detection(tls_pairs(flows, cfg).where(c("score") >= cfg.threshold), "encrypted_malware", ["ja4", "ja4_hosts", "dst_hosts", "cert_seen", "self_signed", "min_days", "no_sni", "out_share", "size_mean"], F.when(c("cert_seen"), CAVEATS["metadata"]).otherwise(CAVEATS["client_side"]))


# -- exfiltration -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Exfil:
    min_bytes: int = 200_000
    alpha: float = 0.25
    ceiling: float = 0.82
    min_hosts: int = 4
    model: Logistic | None = None
    threshold: float = 0.55


def exfil_windows(flows: DataFrame, cfg: Exfil = Exfil()) -> DataFrame:
    """A row a (window, source) past the gate: ratio, own baseline before the window, top destination, its novelty, score."""
    sent = flows.where((c("proto") == "tcp") & (F.coalesce("ics_proto", F.lit("")) == ""))
    dst = sent.groupBy("window_end", "src_ip", "dst_ip").agg(F.sum("bytes_out").alias("up"), F.sum("bytes_in").alias("down"), F.count("*").alias("n"), F.min(F.struct("ts", "seq")).alias("first"))
    dst = dst.withColumn("novel", F.min("window_end").over(Window.partitionBy("src_ip", "dst_ip")) == c("window_end"))
    best = F.struct(c("up").alias("up"), (-c("first.ts")).alias("t"), (-c("first.seq")).alias("s"), c("dst_ip").alias("dst_ip"), c("novel").alias("novel"))
    src = dst.groupBy("window_end", "src_ip").agg(F.sum("up").alias("total_up"), F.sum("down").alias("down"), F.sum("n").alias("observed_flows"), F.min("first.ts").alias("ts_event"), F.max(best).alias("top"))
    src = src.withColumn("ratio", c("total_up") / F.greatest("down", F.lit(1)))

    def step(base: float | None, x: dict) -> tuple[float, tuple]:
        return x["ratio"] if base is None else (1 - cfg.alpha) * base + cfg.alpha * x["ratio"], (base,)

    src = src.select("*", "top.*").drop("top", "t", "s").withColumnsRenamed({"dst_ip": "top_ip", "novel": "top_novel"})
    flat = src.select("window_end", "src_ip", "observed_flows", "ts_event", "ratio", c("total_up").alias("up"), "down", c("up").alias("top_up"), "top_ip", "top_novel")
    met = scan(flat, ["src_ip"], ["window_end"], None, step, "base double", ["ratio"]).where(c("base").isNotNull() & (c("up") >= cfg.min_bytes))
    met = met.select(
        "window_end", "src_ip", c("top_ip").alias("dst_ip"), c("up").alias("bytes_up"), c("down").alias("bytes_down"), "ratio", "base", "observed_flows", "ts_event",
        F.least("ratio", F.lit(50.0)).alias("out_in_ratio"), F.least(c("ratio") / F.greatest("base", F.lit(0.2)), F.lit(30.0)).alias("deviation"), F.log10(c("up") + 1.0).alias("log_bytes_out"),
        (c("top_up") / F.greatest("up", F.lit(1))).alias("dst_concentration"), c("top_novel").cast("double").alias("dst_novelty"), (~X.is_private(c("top_ip"))).cast("double").alias("dst_external"),
        (c("up") / F.greatest(c("up") + c("down"), F.lit(1))).alias("out_share"), c("observed_flows").cast("double").alias("n_flows"),
    )
    r, d = c("out_in_ratio"), c("deviation")
    by_hand = F.when(r > 3.0, F.least(r / 20.0, F.lit(1.0)) * 0.40).otherwise(0.0) + F.when(d > 3.0, F.least((d - 3.0) / 8.0, F.lit(1.0)) * 0.30).otherwise(0.0) + 0.20 * c("dst_novelty") + F.when(c("bytes_up") > 5_000_000, 0.10).otherwise(0.0)
    scored = met.withColumn("score", F.least(cfg.model.probability() if cfg.model else by_hand, F.lit(cfg.ceiling)))
    named = sent.where(F.coalesce("tls_sni", F.lit("")) != "").groupBy("dst_ip", "window_end").agg(F.max_by("tls_sni", F.struct("ts", "seq")).alias("sni"))
    asked = scored.select("dst_ip", "window_end").distinct().join(named.select("dst_ip").distinct(), "dst_ip", "left_semi")  # nothing, where no flow has a name
    rows = named.select("dst_ip", c("window_end").alias("at"), "sni", F.lit(0).alias("ask")).unionAll(asked.select("dst_ip", c("window_end").alias("at"), F.lit(None).cast("string"), F.lit(1)))
    latest = rows.withColumn("sni", F.last("sni", True).over(Window.partitionBy("dst_ip").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0))).where("ask = 1").select("dst_ip", c("at").alias("window_end"), "sni")
    few = inside_hosts(sent).where(c("hosts") < cfg.min_hosts).select("window_end")
    served = latest.where(X.is_service_name(F.coalesce("sni", F.lit("")))).join(few, "window_end")
    return scored.join(served, ["dst_ip", "window_end"], "left_anti").select(scored.columns)


def exfil(flows: DataFrame, cfg: Exfil = Exfil()) -> DataFrame:
    limit = cfg.model.threshold if cfg.model else cfg.threshold
    return _detection(exfil_windows(flows, cfg).where(c("score") >= limit), "data_exfiltration", ["bytes_up", "bytes_down", "ratio", "base", "dst_concentration", "dst_novelty", "dst_external"], CAVEATS["lead"], model=cfg.model)


# -- industrial protocols ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Ics:
    scan: int = 5
    established: int = 3
    threshold: float = 0.55
    authorised: tuple[tuple[str, str], ...] = ()  # (controller, host)
    maintenance: tuple[tuple[float, float], ...] = ()


def ics_sources(flows: DataFrame, cfg: Ics = Ics()) -> DataFrame:
    """A row a (window, source) of industrial traffic: functions, unauthorised writes, illegal codes, score.

    A source is established with a controller after three reads in earlier windows, or by policy.
    """
    seen = flows.where(F.coalesce("ics_proto", F.lit("")) != "")
    write, illegal = F.coalesce("ics_write", F.lit(False)), F.coalesce("ics_illegal", F.lit(False))
    free = F.lit(False)
    for a, b in cfg.maintenance:
        free = free | c("ts").between(a, b)
    pair = seen.groupBy("window_end", "src_ip", "dst_ip").agg(F.count("*").alias("n"), F.sum((~write & ~illegal & c("ics_func").isNotNull()).cast("int")).alias("reads"), F.sum(write.cast("int")).alias("writes"), F.sum((write & ~free).cast("int")).alias("open_writes"), F.sum(illegal.cast("int")).alias("illegal"), F.collect_set("ics_func").alias("funcs"), F.min("ts").alias("first"))
    before = Window.partitionBy("src_ip", "dst_ip").orderBy("window_end").rowsBetween(Window.unboundedPreceding, -1)
    pair = pair.withColumn("known", F.coalesce(F.sum("reads").over(before), F.lit(0)) >= cfg.established)
    if cfg.authorised:
        allowed = F.lit(False)
        for controller, host in cfg.authorised:
            allowed = allowed | ((c("dst_ip") == controller) & (c("src_ip") == host))
        pair = pair.withColumn("known", c("known") | allowed)
    busiest = F.max(F.struct("n", F.lit(0).alias("z"), "dst_ip")).alias("top")
    src = pair.groupBy("window_end", "src_ip").agg(F.sum("n").alias("observed_flows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("funcs")))).alias("funcs"), F.count("*").alias("controllers"), F.sum("writes").alias("writes"), F.sum(F.when(~c("known"), c("open_writes")).otherwise(0)).alias("unauthorised"), F.sum("illegal").alias("illegal"), F.min("first").alias("ts_event"), busiest)
    kinds = F.size("funcs")
    add = lambda cond, w: F.when(cond, w).otherwise(0.0)
    score = F.when(kinds >= cfg.scan, F.least(kinds / 7.0, F.lit(1.0)) * 0.62).otherwise(0.0) + add(c("unauthorised") > 0, 0.55) + add(c("illegal") > 0, 0.40) + add((c("controllers") >= 3) & (c("writes") > 0), 0.15)
    return src.select("window_end", "src_ip", c("top.dst_ip").alias("dst_ip"), "observed_flows", F.slice("funcs", 1, 12).alias("funcs"), kinds.alias("n_funcs"), "controllers", "writes", "unauthorised", "illegal", "ts_event", F.least(score, F.lit(1.0)).alias("score"))


def ics(flows: DataFrame, cfg: Ics = Ics()) -> DataFrame:
    return _detection(ics_sources(flows, cfg).where(c("score") >= cfg.threshold), "ics_intrusion", ["funcs", "controllers", "writes", "unauthorised", "illegal"], CAVEATS["commands"])
