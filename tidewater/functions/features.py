"""Column functions over flows, names and arrays. All but the autocorrelation stay inside Catalyst."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Recognised service, update and delivery domains.
SERVICE_DOMAINS = (
    "google.com", "googleapis.com", "gstatic.com", "gvt1.com", "gvt2.com", "youtube.com", "ytimg.com", "ggpht.com", "doubleclick.net",
    "microsoft.com", "windowsupdate.com", "windows.com", "office.com", "office365.com", "live.com", "msftconnecttest.com", "msedge.net", "bing.com",
    "apple.com", "icloud.com", "mzstatic.com", "cdn-apple.com", "mozilla.com", "mozilla.net", "firefox.com",
    "cloudflare.com", "cloudflare.net", "cloudflareinsights.com", "akamai.net", "akamaiedge.net", "akamaized.net", "fastly.net",
    "amazonaws.com", "cloudfront.net", "azureedge.net", "azure.com", "github.com", "githubusercontent.com", "githubassets.com",
    "slack.com", "slack-edge.com", "spotify.com", "scdn.co", "whatsapp.net", "facebook.com", "fbcdn.net", "instagram.com", "cdninstagram.com",
    "cloudflare-dns.com", "digicert.com", "letsencrypt.org", "sectigo.com", "ntp.org", "pool.ntp.org", "ubuntu.com", "debian.org", "canonical.com",
    "dropbox.com", "dropboxusercontent.com", "box.com", "mega.nz", "wetransfer.com", "drive.google.com", "storage.googleapis.com", "sharepoint.com", "onedrive.com",
    "discord.com", "discordapp.com", "discordapp.net", "discord.gg", "zoom.us", "zoom.com", "teams.microsoft.com", "telegram.org", "t.me",
    "reddit.com", "redditstatic.com", "redd.it", "twitter.com", "twimg.com", "x.com", "linkedin.com", "licdn.com", "netflix.com", "nflxvideo.net", "nflxso.net",
    "twitch.tv", "ttvnw.net", "jtvnw.net", "tiktok.com", "tiktokcdn.com", "ibytedtos.com", "pinterest.com", "pinimg.com", "snapchat.com", "sc-cdn.net",
    "adobe.com", "adobe.io", "steamcontent.com", "steampowered.com", "epicgames.com",
)

#: Ports that the anomaly vector marks.
MARKED_PORTS = (53, 80, 443, 502, 22, 445, 3389)


# -- addresses, names -------------------------------------------------------------------------------------------------


def is_private(ip: Column) -> Column:
    """10/8, 172.16/12 or 192.168/16 by the first two parts; anything that doesn't parse is not."""
    part = lambda i: F.get(F.split(ip, r"\."), F.lit(i)).try_cast("int")
    a, b = part(0), part(1)
    return F.coalesce((a == 10) & b.isNotNull() | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168), F.lit(False))


def is_service_name(name: Column) -> Column:
    """A name that is, or is under, a recognised service domain. Its dot suffixes are looked up in a fixed set."""
    parts = F.split(F.rtrim(F.lower(name), F.lit(".")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.coalesce(F.exists(suffixes, lambda s: s.isin(*SERVICE_DOMAINS)), F.lit(False))


def labels(name: Column) -> Column:
    return F.filter(F.split(name, r"\."), lambda x: x != "")


def registrable(name: Column) -> Column:
    parts = labels(name)
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(name)


def string_entropy(text: Column) -> Column:
    """Bits over a text's characters; 0 for one character or none."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda d: d == c)).cast("double") / n)
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def consonant_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}&&[^aeiou]]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(0))


def bigram_pairs(text: Column) -> Column:
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.char_length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2)))


def first_label(name: Column) -> Column:
    """The first label's letters and digits, in their own case; empty if there is none."""
    return F.regexp_replace(F.coalesce(F.get(labels(name), F.lit(0)), F.lit("")), r"[^\p{L}\p{N}]", "")


def lexical(name: Column) -> dict[str, Column]:
    """length, entropy, vowel_ratio, digit_ratio, consonant_run (of the first label, in its own case) and n_labels."""
    first, body = F.coalesce(F.get(labels(name), F.lit(0)), F.lit("")), first_label(name)
    n = F.greatest(F.char_length(body), F.lit(1)).cast("double")
    count = lambda pattern: F.char_length(F.regexp_replace(body, pattern, "")) / n
    return {
        "length": F.char_length(first).cast("double"),
        "entropy": string_entropy(body),
        "vowel_ratio": count("[^aeiou]"),
        "digit_ratio": count("[^0-9]"),
        "consonant_run": consonant_run(body).cast("double"),
        "n_labels": F.size(labels(name)).cast("double"),
    }


def bigram_table(names: DataFrame, column: str = "dns_qname") -> DataFrame:
    """(pair, logp) over ``^name$`` of letters and digits, add-one over 38 x 38 pairs; the row '__default__' is a pair unseen."""
    body = F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{N}]", "")
    counts = names.where(F.col(column).isNotNull()).select(F.explode(bigram_pairs(body)).alias("pair")).groupBy("pair").count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    logp = counts.crossJoin(F.broadcast(total)).select("pair", F.log((F.col("count") + 1) / (F.col("total") + 1444)).alias("logp"))  # one row
    return logp.unionAll(total.select(F.lit("__default__"), F.log(1 / (F.col("total") + 1444))))


def bigram_likelihood(names: DataFrame, table: DataFrame, key: str, column: str = "dns_qname") -> DataFrame:
    """(key, bigram_ll): the mean log likelihood of a name's pairs."""
    pairs = names.select(key, F.explode(bigram_pairs(F.lower(F.col(column)))).alias("pair"))
    default = table.where("pair = '__default__'").select(F.col("logp").alias("unseen"))
    met = pairs.join(table, "pair", "left").crossJoin(F.broadcast(default))  # one row
    return met.groupBy(key).agg(F.avg(F.coalesce("logp", "unseen")).alias("bigram_ll"))


# -- numbers ----------------------------------------------------------------------------------------------------------


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def jitter_band(cv: Column, centre: float = 0.16, width: float = 0.13) -> Column:
    return F.exp(-F.pow((cv - centre) / width, F.lit(2.0)))


def regularity(cv: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(cv, F.lit(0.0)))


def variation(mean: Column, sd: Column) -> Column:
    return F.when(mean > 0, F.coalesce(sd, F.lit(0.0)) / mean).otherwise(0.0)


def entropy_of_counts(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, n, distinct, entropy (bits) and normalised entropy of ``item``: counts first, then one sum a group."""
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("c"))
    out = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    bits = F.when(F.col("n") <= 1, 0.0).otherwise(F.greatest(F.log2("n") - F.col("s") / F.col("n"), F.lit(0.0)))
    return out.select(*keys, "n", "distinct", bits.alias("entropy"), F.when(F.col("distinct") <= 1, 0.0).otherwise(bits / F.log2("distinct")).alias("normalised"))


def autocorrelation_peak(xs: Column, max_lag: int | None = None) -> Column:
    """The highest autocorrelation of an array at lags 1 .. n/2, at least 0; 0 for under four values, 1 if all are equal.

    Short arrays by definition, long ones by Fourier transform, so an array costs n log n and not its square.
    """

    def peak(x: np.ndarray | None) -> float | None:
        if x is None:
            return None
        n, top = len(x), min(max_lag or len(x) // 2, len(x) - 1)
        if n < 4:
            return 0.0
        d = x - x.mean()
        energy = float(d @ d)
        if energy == 0 or x.min() == x.max():
            return 1.0
        if n <= 512:
            at = np.correlate(d, d, "full")[n : n + top]
        else:
            size = 1 << (2 * n - 1).bit_length()
            f = np.fft.rfft(d, size)
            at = np.fft.irfft(f * f.conj(), size)[1 : top + 1]
        return max(float(at.max()) / energy, 0.0)

    @F.pandas_udf("double")
    def peaks(v: pd.Series) -> pd.Series:
        return pd.Series([peak(x) for x in v], dtype=float)

    return peaks(xs)


def shape(sizes: Column) -> dict[str, Column]:
    """Of signed packet sizes: share that goes out, mean and sample deviation of the absolute sizes."""
    n = F.size(sizes)
    total = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + F.abs(x))
    mean = total / n
    spread = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + (F.abs(x) - mean) * (F.abs(x) - mean))
    none = F.coalesce(n, F.lit(0)) <= 0
    return {
        "out_share": F.when(none, 0.0).otherwise(F.size(F.filter(sizes, lambda x: x > 0)) / n),
        "size_mean": F.when(none, 0.0).otherwise(mean),
        "size_sd": F.when(none | (n < 2), 0.0).otherwise(F.sqrt(spread / (n - 1))),
    }


def anomaly_vector() -> list[Column]:
    """The 19 numbers of a flow for unsupervised scoring."""
    c = F.col
    ratio = c("bytes_out") / F.greatest(c("bytes_in"), F.lit(1))
    logs = [F.log10(x) for x in (c("bytes_out") + 1.0, c("bytes_in") + 1.0, ratio + 0.01, c("duration") + 0.01, c("pkts_out") + 1.0, c("pkts_in") + 1.0)]
    flags = [c(x).cast("double") for x in ("syn", "synack", "rst", "fin")]
    marks = [(c("proto") == "udp").cast("double"), F.coalesce(c("ics_proto") != "", F.lit(False)).cast("double")]
    return [*logs, *flags, *marks, *[(c("dst_port") == p).cast("double") for p in MARKED_PORTS]]


# -- identities -------------------------------------------------------------------------------------------------------


def flow_id(src: str = "src_ip", dst: str = "dst_ip") -> Column:
    """f- and ten hex digits of the SHA-256 of time, ends and protocol."""
    text = F.format_string("%.3f|%s:%d|%s:%d|%s", "ts", src, "src_port", dst, "dst_port", "proto")
    return F.concat(F.lit("f-"), F.substring(F.sha2(text, 256), 1, 10))


def alert_id(threat: Column, src: Column, dst: Column, at: Column) -> Column:
    text = F.concat_ws("|", threat, src, F.coalesce(dst, F.lit("None")), F.format_string("%.1f", at))
    return F.concat(F.lit("prh-"), F.substring(F.sha2(text, 256), 1, 12))


def derived(flows: DataFrame) -> DataFrame:
    """flow_id, completed and byte_ratio of each flow."""
    ratio = F.col("bytes_out") / F.greatest(F.col("bytes_in"), F.lit(1))
    return flows.withColumns({"flow_id": flow_id(), "completed": F.col("synack") > 0, "byte_ratio": ratio})


def one_way(flows: DataFrame) -> DataFrame:
    """What a tap of one direction sees: nothing that comes back, nothing that the server says."""
    zero = {k: F.lit(0).cast(t) for k, t in flows.dtypes if k in ("pkts_in", "bytes_in", "synack", "rst")}
    gone = {k: F.lit(None).cast(t) for k, t in flows.dtypes if k in ("dns_rcode", "tls_cert_days")}
    more = {"tls_self_signed": F.lit(False)} if "tls_self_signed" in flows.columns else {}
    if "pkt_sizes" in flows.columns:
        more["pkt_sizes"] = F.filter("pkt_sizes", lambda x: x > 0)
    return flows.withColumns(zero | gone | more)
