"""URL filters: rules, and logistic regression on hashed character n-grams, all in SQL functions."""

from __future__ import annotations

import json
import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path). The rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: A small labelled table: 1 to block.
LABELLED = (
    ("https://www.spam-farm.example.org/en/1/", 1), ("http://spam-links.example.org/fr/204.html", 1), ("https://m.spam-farm.test/de/77", 1), ("http://link-farm.example.org/es/9#top", 1),
    ("https://seo-spam.example.com/en/5140?page=2", 1), ("http://casino-bonus.example.com/en/free-spins", 1), ("https://www.best-casino.test/play", 1), ("http://online-poker.example.org/win", 1),
    ("https://cheap-pills.example.com/buy-now", 1), ("http://viagra-pharmacy.test/order/cheap", 1), ("https://adult-cams.example.org/live-sex", 1), ("http://xxx-videos.test/porn/1.html", 1),
    ("https://porn-tube.example.com/es/hot", 1), ("http://free-sex.example.net/xxx", 1), ("https://malware-download.test/crack.exe", 1), ("http://warez-keygen.example.org/serial", 1),
    ("https://phishing-login.example.com/verify-account", 1), ("http://torrent-crack.test/keygen.zip", 1), ("https://payday-loans.example.org/apply", 1), ("http://click-farm.example.com/ad/redirect", 1),
    ("https://hacked-games.test/cheat", 1), ("http://escort-ads.example.org/en/12", 1), ("https://fake-watches.example.com/replica", 1), ("http://spam.example.net/de/8123", 1),
    ("https://blog.stone.example.org/en/1415.html", 0), ("http://m.river.example.com/en/22366/", 0), ("https://www.garden.example.net/fr/15421?utm_source=feed", 0), ("https://thorne.example.com/es/46787#top", 0),
    ("http://news.station.example.org/de/15148?page=2&ref=x", 0), ("https://ananda.example.com/en/5381", 0), ("https://www.wiki.example.org/en/History_of_rivers", 0), ("http://university.example.com/library/catalogue", 0),
    ("https://docs.python.example.org/3/tutorial.html", 0), ("https://blog.heather.example.com/en/37800.html", 0), ("http://museum.example.org/de/ausstellung/44", 0), ("https://weather.example.com/fr/paris", 0),
    ("https://m.entire.example.org/es/50943/", 0), ("http://recipes.example.com/en/bread/12", 0), ("https://www.nation.example.org/en/16810#top", 0), ("http://hospital.example.org/contact", 0),
    ("https://science.example.com/en/articles/2021/05", 0), ("https://maps.example.org/city/berlin", 0), ("http://school.example.com/es/cursos", 0), ("https://blog.ration.example.net/en/19491?utm_source=feed", 0),
    ("http://the-times.example.com/en/41230/", 0), ("https://sports.example.org/fr/resultats", 0), ("https://www.council.example.com/planning", 0), ("http://music.example.org/album/9", 0),
)

DIMS = 512
EPOCHS, RATE, DECAY = 24, 25.0, 0.0001
#: The bias counts as this share of a trigram's feature of an average url.
BIAS = 20
#: Weights are kept as whole numbers of 1 / SCALE, so that sums are the same in any order.
SCALE = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """Indices of the character trigrams of host and path, which have halves of their own."""

    def of(text: Column, start: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))

        def index(i: Column) -> Column:
            code = sum((F.ascii(F.substring(framed, i + k, F.lit(1))) * m for k, m in enumerate((961, 31, 1))), F.lit(start * 7))
            return F.pmod(code, F.lit(DIMS)) + F.lit(start)

        return F.when(F.length(framed) > 2, F.transform(F.sequence(F.lit(1), F.length(framed) - 2), index)).otherwise(F.array().cast("array<int>"))

    return F.concat(of(host, 0), of(path, DIMS))


def train(spark: SparkSession, labelled=LABELLED) -> list[int]:
    """Weights (the bias last) of a logistic regression, by gradient steps in a fold of SQL functions.

    labelled: (url, 1 to block or 0) pairs, at most 10,000, which bounds the
    one row that they are folded in.
    """
    if not 0 < len(labelled) <= 10_000:
        raise ValueError("the labelled table must have 1 to 10,000 rows")
    size = 2 * DIMS + 1
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, {json.dumps(u)}, {int(y)})" for i, (u, y) in enumerate(labelled)) + " AS t(i, url, y)")
    host, path = host_and_path(F.col("url"))
    table = table.select("i", F.col("y").cast("double").alias("y"), grams(host, path).alias("g"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.when(j == size - 1, F.lit(1.0 / BIAS)).otherwise(F.size(F.filter("g", lambda x: x == j)).cast("double") / F.size("g")))
    rows = table.select("i", "y", dense.alias("x")).agg(F.array_sort(F.collect_list(F.struct("i", "y", "x"))).alias("rows"))
    rows = rows.select(F.flatten(F.array_repeat("rows", EPOCHS)).alias("rows"))

    def step(w: Column, r: Column) -> Column:
        margin = F.aggregate(F.zip_with(w, r["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        error = r["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return F.transform(F.array(error), lambda e: F.zip_with(w, r["x"], lambda a, b: a * (1 - DECAY) + e * b * RATE))[0]

    fitted = rows.select(F.aggregate("rows", F.array_repeat(F.lit(0.0), size), step).alias("w"))
    return fitted.select(F.transform("w", lambda v: F.round(v * SCALE).cast("long"))).first()[0]


def fitting(host: Column, path: Column, rules) -> Column:
    """(rank, rule, verdict) of the rule that decides, or null.

    The rules are a literal: an array of maps by the CRC-32 of a host, so that a look-up meets few
    keys however many there are. Each end of the url's host that starts at a label is looked up.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    size = 1 << max(0, len(ranked) - 1).bit_length()
    buckets: list[dict[str, list[dict]]] = [{} for _ in range(size)]
    for rank, (verdict, text) in enumerate(ranked):
        own, cut = buckets, text.index("/")
        own[zlib.crc32(text[:cut].encode()) % size].setdefault(text[:cut], []).append({"rank": -rank, "path": text[cut:], "rule": text, "verdict": verdict})
    kind = "struct<rank:int,path:string,rule:string,verdict:string>"
    literal = F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,array<{kind}>>>")
    parts = F.split(host, r"\.", -1)

    def of_end(i: Column) -> Column:
        end = F.array_join(F.slice(parts, i, F.size(parts)), ".")
        return F.element_at(F.get(literal, F.crc32(end).bitwiseAND(F.lit(size - 1)).cast("int")), end)

    found = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), of_end), lambda r: r.isNotNull())
    fit = F.filter(F.flatten(found), lambda r: path.startswith(r["path"]))
    return F.array_max(F.transform(fit, lambda r: F.struct(r["rank"].alias("rank"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def url_verdicts(pages: DataFrame, url_col: str = "url", rules=RULES, weights: list[int] | None = None, labelled=LABELLED) -> DataFrame:
    """Adds host, path, rule (that fits, else null) and verdict (block or allow).

    The longest fitting rule decides (of equally long ones the first in order
    of text); without one, logistic regression on hashed character trigrams of
    host and path, trained on `labelled`. All in SQL functions; a row is never
    moved. The rules are a literal of the plan.

    A null url, or one without `://`, has an empty host and path and is judged by
    the model. Repeated rows are judged alike. Columns of the four names are
    replaced. An empty table gives an empty one.
    """
    weights = weights or train(pages.sparkSession, labelled)
    host, path = host_and_path(F.col(url_col))
    out = pages.select(*(c for c in pages.columns if c not in ("host", "path", "rule", "verdict")), host.alias("host"), path.alias("path"))
    out = out.withColumn("_rule", fitting(F.col("host"), F.col("path"), rules))
    known = F.from_json(F.lit(json.dumps(weights)), "array<bigint>")
    g = grams(F.col("host"), F.col("path"))
    margin = F.aggregate(g, F.lit(0).cast("bigint"), lambda s, i: s + F.element_at(known, i + 1) * BIAS) + F.element_at(known, -1) * F.size(g)
    judged = F.coalesce(F.col("_rule.verdict"), F.when(margin > 0, "block").otherwise("allow"))
    return out.withColumns({"rule": F.col("_rule.rule"), "verdict": judged}).drop("_rule")


def train_plain(labelled=LABELLED) -> list[int]:
    """The same weights without Spark, for the SQL that checks the query."""
    rows = []
    for url, y in labelled:
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        stop = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host, path = rest[:cut].translate(str.maketrans(UPPER, LOWER)), rest[cut:stop]
        g = [(sum(ord(f[i + k]) * m for k, m in enumerate((961, 31, 1))) + s * 7) % DIMS + s for s, t in ((0, host), (DIMS, path)) for f in [f"^{t}$"] for i in range(len(f) - 2)]
        x = {j: g.count(j) / len(g) for j in sorted(set(g))} if g else {}
        rows.append((float(y), x | {2 * DIMS: 1.0 / BIAS}))
    w = [0.0] * (2 * DIMS + 1)
    for _ in range(EPOCHS):
        for y, x in rows:
            margin = 0.0
            for j, v in x.items():
                margin += w[j] * v
            error = y - 1.0 / (1.0 + math.exp(-margin))
            w = [a * (1 - DECAY) for a in w]
            for j, v in x.items():
                w[j] += error * v * RATE
    return [int(math.copysign(math.floor(abs(v * SCALE) + 0.5), v)) for v in w]
