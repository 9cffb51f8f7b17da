"""URL filters: host and path rules first, else a logistic regression on hashed character n-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (rule, verdict). A rule is host/path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The small labelled table that the model is trained from, 1 to block. Invented URLs.
LABELLED = (
    ("http://best-casino.example.com/en/77.html", 1),
    ("https://casino-royal.example.org/fr/311", 1),
    ("http://win-big.example.com/slots", 1),
    ("https://lotto-win.example.net/en/9120/", 1),
    ("https://poker-bets.example.com/en/5", 1),
    ("http://sports-bets.example.org/odds", 1),
    ("https://free-spins.example.com/en/30", 1),
    ("https://free-prize.example.net/en/16000#top", 1),
    ("http://cheap-meds.example.com/order", 1),
    ("https://pills-online.example.org/de/830", 1),
    ("http://diet-pills.example.net/fr/55.html", 1),
    ("https://cheap-watches.example.com/sale", 1),
    ("https://spam-offers.example.com/en/640", 1),
    ("http://m.spam-casino.example.org/fr/12", 1),
    ("http://casino.example.com/en/1", 1),
    ("https://m.casino-club.example.net/es/88", 1),
    ("https://blog.casino-deals.example.com/fr/7", 1),
    ("https://pills.example.org/en/2", 1),
    ("http://blog.pills-shop.example.com/de/505", 1),
    ("https://cheap.example.com/es/3", 1),
    ("https://m.spam.example.org/en/90", 1),
    ("https://seo-farm.example.com/en/4", 1),
    ("https://spam-mail.example.com/en/77.html", 1),
    ("http://spam-links.example.org/fr/311", 1),
    ("http://link-farm.example.com/seo", 1),
    ("https://content-farm.example.net/en/9120/", 1),
    ("https://ads-server.example.com/en/5", 1),
    ("http://click-ads.example.org/pop", 1),
    ("http://pixel-track.example.com/en/30", 1),
    ("https://ad-track.example.net/en/16000#top", 1),
    ("https://adult-video.example.com/hot", 1),
    ("http://adult-chat.example.org/de/830", 1),
    ("http://xxx-cams.example.com/fr/55.html", 1),
    ("https://hot-x.example.net/adult", 1),
    ("https://payday-loans.example.com/en/77.html", 1),
    ("http://fake-login.example.org/fr/311", 1),
    ("https://news.example.com/en/2041", 0),
    ("http://library.example.org/en/77.html", 0),
    ("https://www.museum.example.com/fr/311", 0),
    ("https://university.example.org/de/41", 0),
    ("https://blog.gardener.example.com/en/9120/", 0),
    ("http://m.weather.example.net/en/5", 0),
    ("https://recipes.example.com/es/812", 0),
    ("https://docs.python-guide.example.org/en/30", 0),
    ("http://history.example.com/en/16000#top", 0),
    ("https://science-daily.example.org/en/22", 0),
    ("https://townhall.example.com/de/830", 0),
    ("http://orchestra.example.net/fr/55.html", 0),
    ("https://bicycle.example.com/en/7031", 0),
    ("https://ththor.example.com/en/610", 0),
    ("https://thtion.example.org/es/77", 0),
    ("http://www.there.example.com/fr/15", 0),
    ("https://m.andhe.example.net/en/8", 0),
    ("https://onthing.example.com/de/202", 0),
    ("https://www.reston.example.org/en/0", 0),
    ("http://tisha.example.net/de/31", 0),
    ("http://m.hatat.example.net/en/230.html", 0),
    ("https://blog.esound.example.com/fr/", 0),
    ("https://m.thether.example.com/en/420", 0),
    ("https://anthon.example.org/en/18/", 0),
    ("http://blog.hereon.example.com/fr/9", 0),
    ("https://tionand.example.net/es/6012.html", 0),
    ("https://www.inghand.example.org/de/74", 0),
    ("http://eastern.example.com/es/900", 0),
    ("https://reader.example.com/en/33120", 0),
    ("https://m.wholeth.example.org/en/12050", 0),
    ("http://atlas.example.net/en/5505", 0),
    ("https://northern.example.org/fr/88", 0),
    ("https://thinshed.example.com/de/61", 0),
    ("https://blog.teacher.example.org/es/404", 0),
    ("http://mountain.example.com/fr/1999/", 0),
    ("https://www.bridges.example.com/en/650", 0),
    ("https://river.example.org/en/71", 0),
    ("http://m.kitchen.example.com/es/3002", 0),
    ("https://tathere.example.net/fr/10", 0),
)

BUCKETS = 1 << 14
_DIGITS = re.compile("[0-9]+")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (up to ``?``, ``#`` or the end); both empty for a null or a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule whose host is the url's or a parent domain of it and whose path starts the url's path; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at, _, tail = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{tail}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def grams(host: str, path: str) -> np.ndarray:
    """Bucket of each 3- to 5-gram of the host and of the path, each text between its own end marks, runs of digits as 0."""
    found = set()
    for mark, text in (("h", f"^{_DIGITS.sub('0', host)}$"), ("p", f"^{_DIGITS.sub('0', path)}$")):
        for n in (3, 4, 5):
            found.update(mark + text[i : i + n] for i in range(len(text) - n + 1))
    return np.array(sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in found}), np.int64)


def _plain_split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    return rest[:cut].lower(), tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]


@lru_cache(maxsize=4)
def train(labelled: tuple[tuple[str, int], ...] = LABELLED, epochs: int = 400, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias, by full-batch gradient descent on gram counts scaled to unit length."""
    rows = [grams(*_plain_split(u)) for u, _ in labelled]
    x = np.zeros((len(rows), BUCKETS))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(max(len(r), 1))
    y = np.array([label for _, label in labelled], float)
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) * 10 + l2 * w)
        b -= rate * error.mean()
    return w, float(b)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (the model's probability of block; null where a rule fits).

    A null url or one without ``://`` has an empty host and path, no rule, and the model's verdict on empty texts.
    Repeated rows each get a row; null ids are kept; of rules of one length that fit, the last of ``rules`` counts (their hosts
    and paths are then the same); other columns, whatever their names, are not used; an empty table gives an empty result. A url
    is read whole, however long.
    """
    host, path = split_url(F.col("url"))
    w, b = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[str, str], float] = {}
            scores = []
            for h, p, rule in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if rule is None and (h, p) not in known:
                    at = grams(h, p)
                    known[h, p] = float(1 / (1 + np.exp(-(w[at].sum() / np.sqrt(max(len(at), 1)) + b))))
                scores.append(known[h, p] if rule is None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "score"])

    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    scored = ruled.mapInArrow(run, ruled.schema.simpleString()[7:-1].replace(":", " ") + ", score double")
    verdict = F.when(F.col("score") >= 0.5, "block").when(F.col("score").isNotNull(), "allow")
    for rule, said in rules:
        verdict = verdict.when(F.col("rule") == rule, said)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
