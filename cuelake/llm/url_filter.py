"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table of URLs, a parameter.  The default table has the hand-written rows below and
rows made from word lists by a fixed rule: both classes have the same prefixes, endings, host shapes and paths, and hosts
of ordinary words, well-known names and invented syllables stand for what a crawl should keep.  So a host is blocked for
what its letters say, and one that says nothing is kept.

Input cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged
by the model's offset.  Of rules of equal length the first wins.  Repeated rows get equal verdicts.
"""

from __future__ import annotations

import zlib
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_rows

#: The table must fit a driver many times over.
MAX_LABELLED = 20_000
BUCKETS, GRAMS = 1 << 15, (3, 4, 5)
#: Blocks 1.5 % of hosts of ordinary words that the training rows lack, and 91 % of made hosts with unwanted words (tests).
CUT = 0.85

#: (host and path prefix, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Labelled URLs: what a crawl should keep and what it shouldn't.  Both lists have hosts and paths of the same shapes, so that
#: neither ``www`` nor a language folder or a number speaks for a class.
ALLOWED = """
https://en.wikipedia.org/wiki/Ocean
https://www.gutenberg.org/ebooks/1342
https://www.university.edu/faculty/history/reading-list
https://docs.python.org/3/tutorial/index.html
https://arxiv.org/abs/1706.03762
https://www.city-library.net/catalogue/885
https://botanic-garden.net/en/roses-in-winter
https://www.mountain-rescue.com/en/news/2021/avalanche
https://village-school.net/en/timetable.html
https://www.river-trust.com/es/proyectos/12
https://old-maps.net/de/sammlung/1204
https://www.folk-music.net/fr/concerts?page=2
https://bread-baking.com/en/sourdough
https://www.chess-club.net/en/games/1887
https://weather-station.com/en/5140#top
https://m.hiking-trails.net/en/thread/9921
https://www.bird-watching.com/en/3101
https://history-museum.net/es/exposicion/62
https://www.kitchen-recipes.com/en/soup/4711
https://m.science-news.net/en/articles/777
https://poetry-review.com/fr/numero/19
https://www.town-hall.net/de/rathaus/8736
https://choir-practice.net/en/programme
https://www.railway-history.com/en/engines/213
https://garden-tools.com/en/reviews/286?utm_source=feed
https://www.philosophy-today.net/en/essay/17
https://local-history.com/en/parish/4189
https://www.carpenter-shop.net/en/joinery
https://m.harbour-pilot.com/en/1203
https://www.painter-guild.net/es/7246
https://theatre-stage.com/en/season/2023
https://www.orchard-farm.net/en/apples/88
https://sailing-school.net/fr/cours/5290
https://www.hospital-guide.com/en/departments
https://m.teacher-notes.net/de/1793
https://www.astronomy-club.com/en/planets/9
https://translation-studies.net/en/9315
https://www.city-council.com/en/minutes/314
https://blog.station-master.net/en/2574
https://www.letters-archive.com/en/1751.html
https://forum.woodwork.net/en/5644/
https://blog.quiet-evening.com/en/2021
https://m.northern-lights.net/en/4771.html
https://www.insurance-advice.com/es/ayuda
https://geology-field.net/en/62
https://www.craft-fair.com/de/10
""".split()
BLOCKED = """
http://lucky-casino.net/en/bonus
https://www.royal-casino-slots.com/en/214.html
https://m.online-casino-jackpot.net/es/1203
https://poker-bonus.net/en/signup
https://www.slots-jackpot.com/es/5140
http://sports-betting.com/en/5290?ref=x
https://www.bets-today.net/en/3101
https://blog.best-bets.com/de/8736
https://free-spins.net/en/win
https://www.win-big-prize.com/en/claim
http://discount-pills.net/en/4771.html
https://www.pharma-pills-online.com/en/order
https://m.viagra-cheap.net/es/1751
https://cheap-meds.com/en/885
https://www.weight-loss-pills.net/en/17
https://replica-watches-cheap.com/en/4711
http://adult-cams.net/en/4189
https://www.xxx-adult.com/en/5644/
https://m.hot-adult-video.net/es/7246
https://porn-tube.com/en/88
https://www.escort-adult.net/fr/2021
http://ads-server.net/en/1793
https://www.banner-ads.com/en/1203#top
https://click-track-redirect.net/en/9
https://track.popup-ads.com/de/3101
https://www.ad-tracking.net/es/314
https://affiliate-track.com/en/286?utm_source=feed
http://spam-links.com/en/9315
https://www.link-farm-seo.net/en/backlinks
https://blog.seo-spam.com/de/2574
https://m.spam-mailer.net/en/213
https://bulk-spam.net/en/2023
https://free-iphone-prize.com/en/777
https://www.free-gift-cards.net/en/62
https://payday-loans-cheap.com/en/apply
https://www.get-rich-quick.net/en/12
https://crypto-double-money.com/en/1887
https://warez-crack.net/en/download
https://www.torrent-crack-free.com/en/10
https://keygen-serial.net/de/1204
https://download-codec-now.com/en/7
https://www.fake-antivirus-alert.net/en/scan
https://phishing-login-verify.com/en/account
https://www.casino-bets-free.com/fr/19
https://m.adult-dating-hot.com/en/4771
https://spam-pills-casino.net/en/5
""".split()


#: Words of ordinary sites, names of well-known ones, and words of what a crawl shouldn't keep.
ORDINARY = """garden river mountain library school history music kitchen museum weather science teacher village travel cooking family letter paper harbor
theatre orchard sailing hospital planet station council archive guide forum journal review report daily times herald tribune market street bridge
cottage winter summer forest ocean island castle dance poetry novel author editor publisher college academy institute faculty student campus research
engine railway bicycle camera photo design studio craft pottery wood metal stone bread cheese coffee tea wine recipe health doctor clinic nurse
parent child baby football tennis chess running climbing camping bird horse dog cat fish farmers seeds soil energy solar water power climate
software code data cloud network computer tutorial manual docs wiki notes blog news press radio video podcast film cinema gallery art
law court justice policy city town county state national world global local community church charity volunteer job career business finance bank""".split()
KNOWN = """wikipedia github gitlab stackoverflow nytimes reuters medium theguardian bbc cnn nature sciencemag arxiv acm ieee springer elsevier mozilla python
debian ubuntu apache kernel gnu oracle microsoft apple google amazon ebay etsy paypal netflix spotify soundcloud vimeo youtube flickr instagram twitter
linkedin reddit quora wordpress blogspot tumblr substack archive gutenberg britannica nasa noaa esa cern mit stanford harvard oxford cambridge berkeley
lemonde spiegel elpais zeit figaro corriere asahi yahoo bing duckduckgo baidu weibo imdb goodreads allrecipes webmd mayoclinic who unesco worldbank
economist forbes bloomberg wsj ft washingtonpost latimes guardian independent telegraph npr pbs espn fifa olympics nba""".split()
UNWANTED = """casino poker slots jackpot roulette blackjack betting bets gambling lottery spins win winner prize bonus free cheap discount replica pills viagra cialis
pharma meds steroids weightloss diet porn xxx adult sex nude cams escort hookup dating hot milf tube ads adserver banner popup click track tracker
tracking affiliate redirect spam mailer linkfarm seo backlinks farm traffic payday loans cash credit debt rich money forex crypto doubler giveaway warez
crack keygen serial torrent nulled hacked codec malware antivirus alert phishing login verify clickbait""".split()
SYLLABLES = "ba co de fi ga hu ki lo mu na or pe qui ra so ta ul ve wa ex yo za bri cla dro fen gli har ist jun kel mor nes ost pla ron sti tor und ver".split()
PREFIXES = ["", "", "", "www.", "www.", "www.", "blog.", "m.", "en.", "shop.", "forum.", "static.", "app."]
ENDINGS = ["com", "com", "com", "net", "org", "io", "info", "co.uk", "de", "fr", "es", "edu", "co"]
PATHS = ["/", "", "/", "/en/1", "/en/12", "/es/7246", "/fr/19", "/de/8736", "/en/4711.html", "/en/213/", "/about", "/index.html", "/2021/05/a-title", "/article/885", "/p/12345",
         "/questions/11227809/why", "/wiki/Main_Page", "/search?q=x", "/user/9", "/category/item-62.html", "/en/home", "/news/story-17"]
#: Rows of each class that are made.
MADE = 1200


def made_url(i: int, unwanted: bool, seed: str = "") -> str:
    """The i-th made URL of a class; choices follow from checksums."""
    def pick(values, what: str):
        # A CRC is linear in its text; the product mixes neighbouring numbers.
        return values[(zlib.crc32(f"{seed}{what}{i}{unwanted}".encode()) * 2654435761 >> 12) % len(values)]

    def plain(what: str) -> str:
        invented = "".join(pick(SYLLABLES, f"{what}{k}") for k in range(pick((2, 3, 4), what + "n")))
        return pick((pick(ORDINARY, what), pick(ORDINARY, what), pick(KNOWN, what), invented, invented), what + "kind")

    words = [plain("a"), plain("b")][: pick((1, 1, 2), "words")]
    if unwanted:
        words = [pick(UNWANTED, "u"), *[pick(UNWANTED, "v")][: pick((0, 1, 1), "second")], *words[: pick((0, 1, 1), "plain")]]
        words = words[::-1] if pick((0, 1), "turned") else words
    return "https://" + pick(PREFIXES, "pre") + pick(("-", "-", ""), "join").join(words) + pick(("", "", "", "4", "24"), "number") + "." + pick(ENDINGS, "end") + pick(PATHS, "path")


ALLOWED += [f"https://{w}{name}.{end}{path}" for name in KNOWN for w, end, path in (("www.", "com", "/"), ("", "org", "/en/12"))]
ALLOWED += [made_url(i, False) for i in range(MADE)]
BLOCKED += [made_url(i, True) for i in range(MADE)]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, null if none does."""

    def fits(rule: str) -> Column:
        name, slash, start = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)

    ranked = sorted((r for r, _ in rules), key=len, reverse=True)
    return F.coalesce(*(F.when(fits(r), F.lit(r)) for r in ranked), F.lit(None).cast("string"))


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct n-grams of host and path."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"{path}$")):
        for n in GRAMS:
            found.update(mark + part[i : i + n] for i in range(len(part) - n + 1))
    return np.fromiter({zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in found}, np.int64)


def split_url(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def train(allowed=ALLOWED, blocked=BLOCKED, steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the offset; above 0 means block."""
    rows = [features(*split_url(u)) for u in (*allowed, *blocked)]
    if not rows or len(rows) > MAX_LABELLED:
        raise ValueError(f"{len(rows)} labelled URLs; 1 to {MAX_LABELLED} are needed")
    y = np.array([0.0] * len(allowed) + [1.0] * len(blocked))
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(rows))))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        z = np.bincount(of, w[flat], len(rows)) * scale + b
        error = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(flat, (error * scale)[of], BUCKETS) + ridge * w)
        b -= rate * error.mean()
    return w.astype(np.float32), float(b)


@lru_cache(1)
def default_model() -> tuple[np.ndarray, float]:
    return train()


def judge(pages: DataFrame, rules=RULES, model: tuple[np.ndarray, float] | None = None, cut: float = CUT) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's likelihood of block) of every page."""
    weights, offset = model or default_model()
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # A host may hold any character but these three, so a "?" parts it from the path.
    both = parts.withColumn("host_path", F.concat("host", F.lit("?"), "path"))

    def make():
        def one(text):
            host, _, path = text.partition("?")
            found = features(host, path)
            z = float(weights[found].sum() / max(1.0, np.sqrt(len(found)))) + offset
            return (1 / (1 + np.exp(-z)),)

        return lambda texts: [one(t) for t in texts]

    scored = map_rows(both, make, "score double", ["page_id", "host", "path"], texts="host_path")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdicts = reduce(lambda c, r: c.when(F.col("rule") == r[0], F.lit(r[1])), rules, F.when(F.lit(False), F.lit(None)))
    judged = scored.withColumn("rule", rule)
    return judged.select("page_id", "host", "path", "rule", F.coalesce(verdicts, F.when(F.col("score") >= cut, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
