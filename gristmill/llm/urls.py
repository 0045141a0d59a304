"""URL filter: listed rules first, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path), fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
FEATURES = 1 << 15
GRAMS = (3, 4, 5)

#: The small labelled table, invented: gambling, adult, pharmacy, loan, piracy, advertising and fraud pages ...
BLOCKED = """
luckyspin777.com/slots/bonus-round royal-roulette.org/play/blackjack betmaster24.com/odds/football?ref=88 jackpotcity-online.org/casino/welcome-bonus
pokerstars-club.info/tables/holdem megaslots.biz/free-spins bingo-palace.com/deposit/promo vegas-casinos.net/live/dealer sportsbetting-tips.com/bets/today
scratchcards4u.org/win/instant hotgirls-cams.com/live/room/31 xxxvideos-tube.org/watch/hd-porn adultdating-local.com/join/hookup sexy-singles.info/chat/nude
pornhubby.net/categories/teen camgirl-shows.com/private/show escort-finder.org/city/girls erotic-stories-xxx.com/read/12 milf-tube.biz/video/9921
cheapviagra-online.com/buy/cialis-no-prescription rx-pills-discount.org/order/tramadol canadian-pharmacy-meds.net/shop/viagra weightloss-pills-fast.com/buy-now
steroids-shop.info/cart/anabolic male-enhancement.org/order/pills payday-loans-quick.com/apply/cash-now instant-credit-approval.org/loan/no-check
easymoney-fast.biz/earn/cash make-money-home.com/get-rich/offer bitcoin-doubler.org/invest/profit forex-signals-win.net/join/vip crypto-giveaway.info/claim/prize
free-iphone-winner.com/claim/gift congratulations-prize.org/winner/claim survey-rewards.net/win/giftcard lottery-results-win.com/claim/ticket
warez-crack-download.com/keygen/photoshop serials-and-cracks.org/download/full-version torrent-movies-free.net/download/1080p watchfree-movies.info/stream/hd
nulled-scripts.biz/free/download mp3-download-free.org/get/album adserver-network.com/banner/click?id=7 popunder-ads.net/serve/popup clicktracker.info/track/redirect?u=1
affiliate-links.biz/aff/click/991 trackingpixel.org/pixel/impression doubleclicks-ads.com/ads/banner/728x90 traffic-exchange.net/hits/buy buybacklinks-seo.com/order/links
seo-spam-tools.org/blast/comments cheap-followers.com/buy/likes linkfarm-directory.info/submit/link replica-watches.biz/shop/rolex fake-handbags-outlet.com/buy/louis
secure-login-verify.com/account/update/bank paypa1-support.org/signin/confirm account-suspended.net/verify/password banking-alert.info/login/secure virus-alert-fix.com/download/cleaner
""".split()
#: ... and pages one would keep.
ALLOWED = """
citylibrary.org/catalogue/books/history riverside-school.com/parents/calendar astronomy-notes.org/articles/black-holes gardening-weekly.com/2019/04/pruning-roses
municipal-archive.org/records/1890 botany-institute.net/research/papers/41 kitchen-stories-blog.com/recipes/lentil-soup openmaps-project.org/wiki/Tutorial
local-herald.com/news/2021/03/council-meeting marine-biology.org/species/dolphin python-handbook.net/docs/functions.html railwaymuseum.org/visit/opening-hours
mountain-hikes.com/trails/alpine woodworking-journal.com/projects/oak-table history-of-science.org/essays/newton.html university-press.com/journals/issue/12
childrens-hospital.org/patients/advice weather-station.net/forecast/weekly climate-data.org/reports/2020.pdf chess-academy.com/lessons/openings
orchestra-society.org/concerts/season mathematics-forum.net/questions/1823 language-exchange.org/grammar/verbs national-parks.info/parks/map bird-watchers.org/sightings/april
computer-museum.com/exhibits/mainframes poetry-foundation.net/poems/autumn village-theatre.org/programme bakery-lessons.com/bread/sourdough medical-journal.org/article/1182
folk-music.info/songs/traditional parliament-watch.org/debates/session/9 physics-lectures.net/notes/week3 travel-diary.com/europe/lisbon ceramics-studio.com/workshops
farmers-union.org/about/contact economics-review.com/volume/8/trade fire-brigade.org/safety/home history-podcast.info/episodes/41 translation-services.com/languages/german
software-manuals.org/guide/install democracy-institute.net/publications newspaper-archive.com/1923/06/12 cycling-club.org/routes/coast cathedral-choir.com/music/advent
geology-society.org/field-trips/volcano public-health.info/vaccines/faq dictionary-project.net/entry/house documentary-films.com/reviews/ocean knitting-patterns.org/scarves/easy
energy-agency.org/statistics/solar rural-development.net/projects/water legal-advice.org/tenants/rights art-history.com/painters/renaissance planetarium.info/shows/saturn
student-union.org/events/welcome teacher-resources.com/worksheets/fractions bridge-engineering.net/design/arches sailing-school.com/courses/beginner zoology-department.org/staff/list
""".split()


def labelled(spark: SparkSession) -> DataFrame:
    rows = [(f"https://{url}", label) for urls, label in ((BLOCKED, 1.0), (ALLOWED, 0.0)) for url in urls]
    return split_url(spark.createDataFrame(rows, "url string, label double")).drop("url")


def split_url(df: DataFrame) -> DataFrame:
    """host and path from url: host up to / ? #, A-Z in small letters; path up to ? #; empty without ://."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def with_features(df: DataFrame) -> DataFrame:
    """Hashed n-grams of host and path; host ends and path start are marked."""
    df = df.withColumn("_host", F.expr("split(concat('^', host, '$'), '')")).withColumn("_path", F.expr("split(concat('/', path), '')"))
    parts = []
    for chars in ("_host", "_path"):  # characters as an array: taking them out of a long text one by one would take the square of its length
        for n in GRAMS:
            gram = ", ".join(f"{chars}[i + {k}]" for k in range(n))
            parts.append(f"case when size({chars}) >= {n} then transform(sequence(0, size({chars}) - {n}), i -> concat({gram})) else array() end")
    grams = f"transform(concat({', '.join(parts)}), g -> cast(g as string))"
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features").transform(df.withColumn("_grams", F.expr(grams)))
    return hashed.drop("_grams", "_host", "_path")


def train(rows: DataFrame) -> LogisticRegressionModel:
    """rows: host, path, label (1.0 for block)."""
    return LogisticRegression(maxIter=60, regParam=0.01, featuresCol="features", labelCol="label").fit(with_features(rows))


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: score is the model's probability of block.

    A rule fits its host and all hosts below it when the path starts with the rule's path;
    the longest fitting rule decides, else the model. A url without host is allowed
    (score 0). Null and repeated rows keep a row each. Other columns are not read. An
    empty table gives no rows.
    """
    asked = split_url(pages.select("page_id", F.col("url").cast("string").alias("url"))).drop("url")
    scored = model.transform(with_features(asked)).withColumn("score", F.when(F.col("host") == "", 0.0).otherwise(vector_to_array("probability")[1]))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") > 0.5, "block").otherwise("allow")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
