"""URL filters: rules on hosts and paths, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import append_columns, ascii_lower

BUCKETS, GRAMS = 1 << 14, (3, 4, 5)

#: Rules (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: The labelled URL table, written by hand from everyday words: kinds of hosts and pages that corpora leave out, and
#: such that they keep.
BLOCKED = """
casino.test/play royal-casino.test/slots/ www.casino-games.test/bonus online-casino.test/en/free-spins casinobonus.test/
poker-room.test/join free-poker.test/tables www.pokerstake.test/ slots-jackpot.test/win jackpot.test/spin/3 winbig.test/lottery
bet-now.test/odds sports-betting.test/football www.betting.test/live bets24.test/ roulette-online.test/wheel win-money.test/now
cheap-pills.test/order buy-pills-online.test/ pharmacy-discount.test/viagra viagra-cialis.test/buy www.pills.test/cheap diet-pills.test/slim
buy-meds.test/no-prescription replica-watches.test/rolex cheap-handbags.test/outlet fake-diploma.test/order essay-mill.test/price
porn.test/videos free-porn-tube.test/watch xxx-clips.test/4 www.sex-chat.test/live adult-cams.test/models sexdating.test/join
adult-videos.test/new hot-escorts.test/city nude-pics.test/gallery erotic-stories.test/17 adultfriends.test/login
ads.test/click adserver.test/banner www.ad-network.test/serve track-clicks.test/pixel adtracker.test/redirect popads.test/show
banner-exchange.test/ affiliate-offers.test/go?id=3 click-bank.test/hop doubleads.test/imp tracking-pixel.test/t.gif
spam.test/list spam-links.test/ link-farm.test/exchange seo-links.test/buy-backlinks www.spamblog.test/2 backlink-farm.test/add
content-farm.test/how-to scraper-site.test/copy bulk-mail.test/send email-blast.test/lists spammers.test/tools
free-iphone.test/claim prize-winner.test/you-won get-rich-quick.test/system payday-loan.test/apply cheap-loans.test/now
work-from-home-cash.test/start crypto-doubler.test/send free-gift-cards.test/generator bitcoin-profit.test/invest miracle-cure.test/buy
secure-login-verify.test/account phish-bank.test/signin update-your-password.test/confirm warez.test/crack keygen-download.test/serial
torrent-movies.test/free pirated-software.test/full free-downloads.test/setup.exe malware-host.test/payload hack-tool.test/generator
"""
ALLOWED = """
library.test/catalogue news.test/2021/05/report museum.test/visit university.test/courses/history weather.test/today
gardening.test/roses recipes.test/bread science.test/articles/42 travel-notes.test/norway/fjords river-history.test/maps
city-council.test/minutes school-board.test/en/8 old-maps.test/en/19 open-data.test/en/3 book-review.test/en/27
blog.knitting.test/patterns history.test/en/1 m.chess-club.test/de/5 birdwatching.test/spring mountains.test/hikes/12
www.theatre.test/programme orchestra.test/season poetry.test/translations/8 philosophy.test/essays/kant grammar.test/verbs
parliament.test/debates/2019 court-records.test/cases/77 statistics.test/tables/population census.test/1901 treaty.test/text
hospital.test/departments medicine.test/journal/3/12 anatomy.test/heart nutrition.test/vegetables vaccines.test/schedule
physics.test/lectures/waves chemistry.test/elements/iron mathematics.test/proofs/primes biology.test/cells astronomy.test/planets/mars
software.test/docs/install opensource.test/project/readme programming.test/tutorial/loops database.test/manual/index kernel.test/changelog
railway.test/timetable harbour.test/ferries airport.test/arrivals bicycle.test/repair cars.test/engines/diesel
football-club.test/fixtures swimming.test/results olympics.test/1936 tennis.test/rules athletics.test/records
cooking.test/soup bakery.test/cake wine.test/regions tea-house.test/menu cheese.test/kinds
painting.test/baroque sculpture.test/rodin photography.test/lenses architecture.test/gothic cinema.test/reviews/44
bibliothek.test/de/katalog zeitung.test/de/politik/22 wetter.test/de/heute kochen.test/de/suppe geschichte.test/de/mittelalter
stadtrat.test/de/protokoll schule.test/de/unterricht wandern.test/de/alpen musik.test/de/lieder garten.test/de/rosen
bibliotheque.test/fr/livres journal.test/fr/monde/9 cuisine.test/fr/pain histoire.test/fr/roi jardin.test/fr/fleurs
musee.test/fr/visite ecole.test/fr/cours montagne.test/fr/chemins poesie.test/fr/vers mairie.test/fr/conseil
biblioteca.test/es/libros periodico.test/es/mundo/31 cocina.test/es/sopa historia.test/es/reyes jardines.test/es/flores
museo.test/es/visita escuela.test/es/clases montes.test/es/rutas poemas.test/es/versos ayuntamiento.test/es/plenos
www.harvest.test/en/402 blog.winter-tales.test/en/55 m.lanterns.test/en/930 forum.sailing.test/en/218 shop.pottery.test/en/67
wiki.geology.test/en/743 archive.letters.test/en/86 notes.linguist.test/en/311 static.weaving.test/en/5.html orchard.test/en/690.html
"""


def behind_scheme(url: Column) -> Column:
    """What follows the first ://; empty for null and where :// is missing."""
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def up_to(c: Column, marks: str) -> Column:
    """c up to the first of the marks, without a pattern, as URLs may be of any length."""
    for mark in marks:
        c = F.substring_index(c, mark, 1)
    return c


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where :// is missing."""
    return ascii_lower(up_to(behind_scheme(url), "/?#"))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = behind_scheme(url)
    return up_to(F.substring(rest, F.length(up_to(rest, "/?#")) + 1, F.length(rest)), "?#")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule like 'net/', its verdict) of the longest rule that fits, else nulls. The rules are a short list: each
    is two comparisons in the scan's own stage."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def part_grams(part: str) -> frozenset[int]:
    raw = part.encode("utf-8", "surrogatepass")
    return frozenset(zlib.crc32(raw[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(raw) - n + 1))


#: Hosts recur; only short ones are held, so the cache has a bound.
short_grams = lru_cache(maxsize=8192)(part_grams)


def grams(host: str, path: str) -> list[int]:
    """Buckets of the n-grams of a host (its ends and labels marked) and of a path."""
    whole = f"h^{host}$"
    return sorted((short_grams if len(whole) <= 128 else part_grams)(whole) | part_grams(f"p{path}$"))


@dataclass
class UrlModel:
    bias: float
    weights: np.ndarray

    def score(self, urls: list[tuple[str, str]]) -> list[float]:
        """Likelihood that each (host, path) is to be blocked."""
        out = []
        for host, path in urls:
            at = grams(host, path)
            z = self.bias + float(self.weights[at].sum()) / max(len(at), 1) ** 0.5
            out.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
        return out


def split_row(entry: str) -> tuple[str, str]:
    host, _, path = entry.partition("/")
    return host, "/" + path


#: The log odds of blocking before any n-gram is met.
PRIOR = -1.0

#: Surroundings that say nothing of a site: what may stand before and behind its name, and paths.
BEFORE, BEHIND = ("", "www.", "m.", "blog."), (".example.com", ".example.org", ".example.net", ".test")
PATHS = ("/", "/en/{}", "/de/{}.html", "/fr/{}", "/es/{}", "/en/{}.html", "/{}", "")


def varied(entries: str, times: int = 4) -> list[tuple[str, str]]:
    """(host, path) of each entry, and `times` more with its name in other surroundings, the same for either label, so
    that these don't tell."""
    out = []
    for k, (host, path) in enumerate(map(split_row, entries.split())):
        out.append((host, path))
        name = host.rpartition(".")[0].split(".")[-1]
        for n in range(times):
            v = k * times + n
            out.append((BEFORE[v % 4] + name + BEHIND[v // 4 % 4], PATHS[v % 8].format(v * 37 % 9973)))
    return out


def fit(blocked: str = BLOCKED, allowed: str = ALLOWED, rounds: int = 800, rate: float = 4.0, decay: float = 5e-5) -> UrlModel:
    """Gradient descent with a quadratic penalty over the small labelled table; deterministic. The bias is not learned:
    it says that most sites whose letters tell nothing are to be allowed, whatever the table's shares are."""
    rows = [(r, 1.0) for r in varied(blocked)] + [(r, 0.0) for r in varied(allowed)]
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, ((host, path), _) in enumerate(rows):
        at = grams(host, path)
        x[i, at] = 1 / max(len(at), 1) ** 0.5
    y = np.array([v for _, v in rows], np.float32)
    met = np.flatnonzero(x.any(0))
    x, w, bias = x[:, met], np.zeros(len(met), np.float32), PRIOR
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(x @ w + bias))) - y) / len(y)
        w -= rate * (x.T @ g + decay * w)
    weights = np.zeros(BUCKETS, np.float32)
    weights[met] = w
    return UrlModel(bias, weights)


def judge(pages: DataFrame, model: UrlModel | None = None, rules=RULES, threshold: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict (allow or block), score.

    The longest rule that fits decides, else the model blocks scores of `threshold` or more. A null url, or one
    without ://, has an empty host and path, which the model judges too. Repeated rows are judged alike; an empty
    table gives none. Other columns are not read; nothing is shuffled.
    """
    model = model or fit()
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("rule", name).withColumn("ruled", verdict).withColumn("both", F.concat_ws("\n", "host", "path"))

    def make(both: list[str]) -> list[tuple]:
        return [(s,) for s in model.score([tuple(b.split("\n", 1)) for b in both])]

    scored = append_columns(ruled, "both", make, [("score", "double", pa.float64())])
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
