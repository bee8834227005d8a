"""URL filter: rules by host and path first, else a logistic regression on hashed character n-grams.

The model is trained from a small labelled table of URLs, given by the caller
or the default one below. Everything is Column expressions and DataFrame-based
ML; URLs are judged row by row without a shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOWER, UPPER

HOST_GRAMS, PATH_GRAMS = (3, 4, 5), (3, 4)
BUCKETS = 1 << 15
PENALTY = 0.002

# Rules (host, path, verdict) of the registered query: fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Small labelled table: URLs to block and to allow, written by hand from what such addresses look like in general.
BLOCKED = """
http://casino-online.example.info/slots http://www.royal-casino.test/bonus https://live-casino.invalid/spin-to-win http://bestcasino.example.edu/jackpot
http://poker-win.test/cash http://win-big.test/lottery https://lotto-win.invalid/claim http://slots-win-now.test/free http://m.big-win-casino.test/play
http://bets-today.invalid/odds https://sports-bets.test/tips http://bets-bonus.test/sign-up http://online-bets24.invalid/live http://betting-free.test/tips
http://discount-pills.invalid/order https://pills-online.test/buy http://cheap-meds.test/no-prescription http://diet-pills.test/slim http://cheapviagra.invalid/buy
https://buy-cheap-watches.test/replica http://cheap-replica.invalid/sale http://pharmacy-cheap.test/order-now http://weight-loss-pills.invalid/trial
http://spam-site.test/page https://link-farm.invalid/links http://content-farm.test/list http://spammy.test/offers http://seo-spam.invalid/backlinks
http://article-farm.invalid/top10 https://farm-links.test/x
http://ads-exchange.test/click https://track-ads.invalid/pixel http://ads-network.test/banner http://click-track.test/redirect https://tracker.invalid/beacon
http://ad-track.invalid/imp http://adserver-track.test/view http://popads.test/pop http://ads.tracking.invalid/c
http://adult-video.test/watch https://adult-chat.invalid/cams http://xxx-adult.test/free http://hot-x.invalid/pics http://adult-photos.test/live
http://sexy-cams.test/live http://porn-free.test/tube https://xxx-tube.invalid/videos http://adult-dating.test/join http://x-rated.invalid/adult
http://payday-loan.test/apply http://quick-cash-loan.invalid/now https://crypto-doubler.test/invest http://free-money.test/claim http://get-rich.invalid/fast
http://roulette-tables.com/vip https://www.blackjack-online.org/bonus http://bingo-jackpots.co.uk/deposit http://keno.casino/spin http://m.slotmachines.net/free-spins
http://viagra-store.net/order https://pharmacy-no-prescription.com/buy http://steroids-shop.org/cheap http://www.slimming-pills.co.uk/offer http://rx-discount.biz/cialis
http://replica-handbags.biz/sale https://fake-watches.info/rolex http://essay-writing-cheap.com/order http://buy-followers.net/instagram http://buy-backlinks.biz/seo
http://xxx-movies.net/tube https://www.nude-cams.com/live http://escorts-city.org/girls http://hot-singles.biz/meet http://porn-archive.info/download
http://malware-download.net/setup.exe http://free-antivirus-crack.com/serial https://prize-winner.info/claim http://lottery-claims.biz/winner http://bitcoin-doubling.net/invest
http://click-ads.net/banner https://adserver.trackers.com/pixel http://popunder-ads.biz/show http://spam-blog.info/links http://article-spinner.biz/spam
http://warez-crack.test/keygen http://free-download-crack.invalid/serial http://torrent-free.test/movies http://hack-cheats.test/coins
""".split()
ALLOWED = """
https://www.library.test/catalogue https://news.daily.invalid/world/2024 http://blog.garden.test/roses https://docs.python.invalid/tutorial http://museum.test/exhibits
https://www.university.invalid/research http://city-hall.test/council https://weather.invalid/forecast http://recipes.kitchen.test/soup https://m.train.invalid/timetable
https://history.test/rome http://www.school.invalid/pupils https://science.test/physics/7 http://maps.invalid/europe https://wiki.test/article/12
http://farmers-market.invalid/produce https://racetrack-history.test/1950 http://freedom.invalid/speech https://betterworld.test/about http://alphabet.invalid/letters
https://downloads.gnu.invalid/manual http://adventure.test/trips https://address.invalid/book http://example-docs.test/spec https://trackandfield.invalid/results
https://open-data.invalid/sets http://mathematics.test/proofs https://parliament.invalid/acts http://hospital.test/visiting https://orchestra.invalid/season
https://www.national-archives.gov.uk/records http://botany-society.org/meetings https://en.encyclopedia.org/wiki/Rome http://www.observatory.edu/papers https://blog.gardeners.co.uk/roses
http://city-transport.de/fahrplan https://www.theatre.fr/programme http://bibliotheque.fr/horaires https://museo-nacional.es/exposiciones http://universidad.es/grados
https://developer.standards.org/specs/http http://m.weather-service.gov/forecast https://www.farmers-union.org/news http://railway-history.net/steam https://chess-club.org/results
http://www.hospital-trust.org/visiting https://school-district.edu/calendar http://orchestra-society.com/season https://translations.net/poetry http://www.bakery-guild.co.uk/recipes
https://www.parliament.uk/bills http://astronomy-club.org/meteors https://cathedral-choir.org/music https://www.knitting-patterns.com/scarves http://geology.edu/fieldwork
https://news-agency.com/europe/elections http://local-history.co.uk/mills https://open-source.dev/docs/install http://python-tutorials.io/lists https://www.violin-lessons.net/scales
http://veterinary-college.edu/admissions https://tides.gov/harbours http://botanical-garden.org/orchids https://www.cycling-routes.eu/alps http://river-trust.org/salmon
https://library-catalogue.net/search http://poetry-archive.org/sonnets https://mathematics-forum.org/algebra http://cooking-at-home.com/bread https://www.childrens-hospital.org/wards
http://national-park.gov/trails https://language-school.fr/cours http://stadtbibliothek.de/katalog https://ayuntamiento.es/tramites http://musee-des-arts.fr/collections
https://www.electronics-repair.com/radio http://furniture-makers.co.uk/oak https://bus-timetables.net/city http://photography-society.org/landscapes https://film-institute.org/archive
http://charity-shop.org/volunteers https://www.allotments.co.uk/compost http://birdwatchers.org/owls https://economics-journal.com/issues http://court-reports.gov/judgments
https://museum-of-art.test/tickets http://long-distance-walks.invalid/map https://hand-weaving.test/loom http://well-being.invalid/sleep https://sea-birds.test/list
""".split()


def labelled(spark: SparkSession) -> DataFrame:
    """The default table: url, label (1.0 to block)."""
    rows = [(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED]
    pairs = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows])
    return spark.range(1).select(F.explode(pairs).alias("r")).select("r.*")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` up to `/`, `?`, `#`, A-Z lower-cased; path up to `?` or `#`. Else both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, sizes: Sequence[int], mark: str) -> Column:
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))
    return F.concat(*[of(n) for n in sizes])


def _with_grams(df: DataFrame) -> DataFrame:
    return df.withColumn("__grams", F.concat(_grams(F.col("__host"), HOST_GRAMS, "h"), _grams(F.regexp_replace("__path", "[0-9]", "0"), PATH_GRAMS, "p")))


def train(urls: DataFrame) -> PipelineModel:
    """A model from labelled (url, label): a small table, read into one partition so that sums have one order."""
    host, path = host_and_path(F.col("url"))
    rows = _with_grams(urls.select("label", host.alias("__host"), path.alias("__path"))).coalesce(1)
    hashing = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=BUCKETS, binary=True)
    regression = LogisticRegression(featuresCol="__features", labelCol="label", predictionCol="__bad", probabilityCol="__p", rawPredictionCol="__raw", regParam=PENALTY, maxIter=50, standardization=False)
    return PipelineModel([hashing, regression.fit(hashing.transform(rows))])


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null.

    A rule fits its host and the host's subdomains if the path starts with the
    rule's. `rules` is a table of the caller's, held in the plan.
    """
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits))


def judged(pages: DataFrame, model: PipelineModel, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict (allow or block), block_probability for every row.

    A null url, or one without `://`, has an empty host and path and is left
    to the model. Repeated rows get a row each. Other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("__key"), host.alias("__host"), path.alias("__path")).withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))
    scored = model.transform(_with_grams(rows))
    from pyspark.ml.functions import vector_to_array

    return scored.select(
        F.col("__key").alias(key), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", F.when(F.col("__bad") == 1.0, "block").otherwise("allow")).alias("verdict"),
        F.round(vector_to_array("__p")[1], 6).alias("block_probability"))
