"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table by gradient descent inside one SQL
expression: the table is gathered into one row (its size is the caller's bound), the weights
are an array, and a fold over the steps updates them.  Everything is DataFrame and SQL
functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX_DIGITS = 4  # a bucket is the first hexadecimal digits of the n-gram's MD5
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Own examples of unwanted (1) and wanted (0) addresses: (label, hosts and paths).
LABELLED = [
    (1, "https://www.casino-royal.example.com/en/12 http://best-casino.example.net/win/9 https://m.casino-win.example.org/fr/3 http://casinobonus.example.com/de/77 https://win-jackpot.example.net/es/8 http://slots-casino.example.org/en/411.html"),
    (1, "https://blog.free-bets.example.com/en/5 http://bets-online.example.net/de/66 https://www.sports-bets.example.org/fr/91/ http://free-spins.example.com/en/17 https://poker-win.example.net/es/28 http://m.free-casino.example.org/en/3?page=2"),
    (1, "http://cheap-pills.example.org/fr/1 https://www.pills-online.example.com/en/39 http://cheap-viagra.example.net/de/207 https://buy-pills.example.org/es/14/ http://blog.cheap-meds.example.com/en/903 https://m.diet-pills.example.net/fr/6.html"),
    (1, "https://spam-mill.example.net/de/44 http://www.spam-links.example.com/en/8 https://link-wheel.example.org/fr/73 http://seo-spam.example.net/es/2 https://blog.content-mill.example.com/en/616 http://m.spam-blog.example.org/en/90#top"),
    (1, "http://ads-track.example.com/en/4 https://www.ads-server.example.net/fr/55 http://track-click.example.org/de/31 https://m.popup-ads.example.com/es/7 http://adclick-track.example.net/en/818/ https://blog.ad-track.example.org/en/23"),
    (1, "https://adult-x.example.org/en/11 http://www.adult-cams.example.com/fr/62 https://x-videos.example.net/de/9 http://m.adult-dating.example.org/es/35 https://xxx-adult.example.com/en/402.html http://blog.sex-cams.example.net/en/13"),
    (1, "http://fast-loans.example.com/en/21 https://www.payday-loans.example.net/de/87 http://crypto-doubler.example.org/en/6 https://m.replica-watches.example.com/fr/190 http://get-rich-quick.example.net/es/45/ https://blog.warez-crack.example.org/en/72"),
    (0, "https://www.townhall.example.com/en/12 http://blog.orchard.example.net/de/9 https://m.railway.example.org/fr/3 http://harbour.example.com/de/77 https://meadow.example.net/es/8 http://www.lighthouse.example.org/en/411.html"),
    (0, "https://blog.carpentry.example.com/en/5 http://nachrichten.example.net/de/66 https://www.meteo-france.example.org/fr/91/ http://observatory.example.com/en/17 https://biblioteca.example.net/es/28 http://m.reading.example.org/en/3?page=2"),
    (0, "http://library.example.org/fr/1 https://www.university.example.com/en/39 http://museum.example.net/de/207 https://archive.example.org/es/14/ http://blog.science.example.com/en/903 https://m.history.example.net/fr/6.html"),
    (0, "https://weather.example.net/de/44 http://www.gardening.example.com/en/8 https://recipes.example.org/fr/73 http://chemistry.example.net/es/2 https://blog.travel.example.com/en/616 http://m.music.example.org/en/90#top"),
    (0, "http://newspaper.example.com/en/4 https://www.journal.example.net/fr/55 http://physics.example.org/de/31 https://m.biology.example.com/es/7 http://teachers.example.net/en/818/ https://blog.letters.example.org/en/23"),
    (0, "https://hospital.example.org/en/11 http://www.bicycle.example.com/fr/62 https://mountain.example.net/de/9 http://m.theatre.example.org/es/35 https://forest.example.com/en/402.html http://blog.river.example.net/en/13"),
    (0, "http://dictionary.example.com/en/21 https://www.economics.example.net/de/87 http://poetry.example.org/en/6 https://m.astronomy.example.com/fr/190 http://kitchen.example.net/es/45/ https://blog.painting.example.org/en/72"),
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the built-in table."""
    rows = [(url, label) for label, urls in LABELLED for url in urls.split()]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without one."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, else null.

    ``rules``: (allow or block, host, path); a rule fits its host and all subdomains where
    the path starts with its path.  Of equally long rules the first in the list wins.
    """
    ranked = sorted(enumerate(rules), key=lambda r: (-len(r[1][1] + r[1][2]), r[0]))
    chosen: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for _, (verdict, name, start) in reversed(ranked):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def buckets(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams of the host (with its ends marked) and the path."""
    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$")))):
        for n in GRAMS:
            starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _bucket_at(mark, text, n)))
    return F.array_distinct(F.concat(*parts))


def _bucket_at(mark: str, text: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))), 1, HEX_DIGITS), 16, 10).cast("int")


def train(labelled: DataFrame, steps: int = 150, rate: float = 2.0, decay: float = 0.001) -> tuple[float, list[float]]:
    """(bias, weight of each bucket), learned from (url, label) rows.

    Rows without a label are left out; a null url is an empty host and path.  The labelled
    table is small by contract: it becomes one row.  Without rows all weights are zero.
    """
    rows = labelled.where("label IS NOT NULL").select(F.coalesce("url", F.lit("")).alias("url"), F.col("label").cast("double").alias("y"))
    rows = rows.select("url", "y", F.sort_array(buckets(host_of(F.col("url")), path_of(F.col("url")))).alias("b"))
    table = rows.agg(F.sort_array(F.collect_list(F.struct("url", "y", "b"))).alias("t"))
    table = table.select("t", F.array_sort(F.array_distinct(F.flatten(F.transform("t", lambda r: r["b"])))).alias("used"))
    table = table.select(
        F.expr("transform(t, r -> struct(r.y AS y, transform(r.b, x -> CAST(array_position(used, x) - 1 AS INT)) AS k))").alias("t"), "used",
        F.expr("transform(used, u -> filter(sequence(0, greatest(size(t) - 1, 0)), i -> array_contains(t[i].b, u)))").alias("members"),
    )
    error = "transform(t, r -> (1 / (1 + exp(-(s.b + aggregate(r.k, 0D, (a, k) -> a + s.w[k])))) - r.y) / size(t))"
    step = f"transform(array({error}), e -> struct(transform(members, (m, k) -> s.w[k] - {rate}D * (aggregate(m, 0D, (a, i) -> a + e[i]) + {decay}D * s.w[k])) AS w, s.b - {rate}D * aggregate(e, 0D, (a, x) -> a + x) AS b))[0]"
    model = table.select("used", F.expr(f"aggregate(sequence(1, {steps}), struct(transform(used, u -> 0D) AS w, 0D AS b), (s, i) -> {step})").alias("m")).select("used", "m.w", "m.b").first()
    weights = [0.0] * 16**HEX_DIGITS
    for bucket, weight in zip(model["used"], model["w"], strict=True):
        weights[bucket] = weight
    return model["b"], weights


def chance(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    """Probability that an address is unwanted; the weights are one constant array."""
    bias, weights = model
    array = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(buckets(host, path), F.lit(bias), lambda a, k: a + F.get(array, k))
    return 1 / (1 + F.exp(-total))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], model: tuple[float, list[float]], id_col: str = "page_id", url_col: str = "url", limit: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    ``verdict`` is the longest fitting rule's, else block where ``score`` is at least
    ``limit``.  A null url or one without :// has an empty host and path, which no rule fits
    and the model judges by its bias and the end marks; equal rows get equal verdicts; other
    columns are not read; an empty table gives no rows.  One pass without a shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"), chance(F.col("host"), F.col("path"), model).alias("score"))
    learned = F.when(F.col("score") >= limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", learned).alias("verdict"), "score")
