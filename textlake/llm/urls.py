"""URL filters: ordered host and path rules, then logistic regression on hashed character n-grams of host and path.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end. A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's; the longest rule wins.
Where no rule fits, the model's verdict stands. It is trained on the driver from a small labelled URL table, by default
:func:`examples`, by plain gradient descent; it is a vector of ``DIMENSIONS`` weights, whatever the input.

A null URL or one without ``://`` has an empty host and path, fits no rule and is allowed with score 0. Very long URLs take
time and memory in proportion. Of rules of one length that fit, the first stated wins. Repeated rows are judged alike. An
empty table gives an empty result. Other columns stay; one named like a result column is replaced.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm._common import mixed, others

RESULT = ("host", "path", "rule", "verdict", "score")
BLOCK, ALLOW = "block", "allow"
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
DIMENSIONS, LEAST_GRAM, MOST_GRAM = 1 << 14, 3, 5
#: Score from which a URL is blocked.
THRESHOLD = 0.9
#: What a labelled table is made of: words that addresses of unwanted and of ordinary pages hold, and forms of these.
UNWANTED = (
    "casino jackpot poker slots roulette blackjack betting bookmaker gamble bingo sportsbook freespins baccarat lottery-win megabonus "
    "viagra cialis levitra pharma-pills tramadol xanax steroids weight-loss-pills diet-pills no-prescription pillstore canadian-pharmacy kamagra phentermine "
    "xxx porn sexcam hotgirls nude adult-video escort camgirls milf fetish erotic livesex hookup sexdating onlyfans-leak webcamsex "
    "crack keygen warez serial-key torrent-free nulled activator free-download-full patched rapidgator cracked-apk modapk cheat-engine aimbot license-generator "
    "payday-loan quick-cash fast-credit no-credit-check earn-money-fast make-money-online get-rich forex-signal binary-options crypto-doubler bitcoin-giveaway ponzi hyip cash-advance debt-relief-now "
    "account-verify secure-login-update paypal-confirm bank-alert unlock-account password-reset-now win-iphone free-giftcard claim-prize survey-reward lucky-winner urgent-update cheap-replica replica-watches fake-handbags buy-followers"
).split()
ORDINARY = (
    "news blog docs wiki library garden recipes history science school museum forum weather sport music travel photo video map city region university research journal "
    "article story review guide tutorial course lesson book author poem theatre cinema art design fashion health hospital doctor medicine nutrition family children parents "
    "home kitchen house furniture tools cars bikes trains airport hotel restaurant cafe market shop store products catalog price order shipping contact about team careers jobs "
    "press media events calendar tickets community members support help faq manual api reference developer software code project release changelog download-page security privacy terms policy "
    "finance bank insurance economy business startup energy climate nature animals birds plants forest river mountain ocean island beach winter summer spring autumn language grammar dictionary translation "
    "math physics chemistry biology space astronomy geology archive gallery podcast radio television magazine newsletter parish council village court law rights vote parliament embassy"
).split()
UNWANTED_HOSTS = ("{w}-online.example", "best{w}24.example", "www.{w}.example", "{w}{n}.example.net", "{v}-{w}.example.com", "shop.example", "a{n}.example.org", "{w}.net", "{w}{n}.com", "my-{w}.org")
ORDINARY_HOSTS = ("{w}.example.com", "www.{w}-{v}.example.org", "m.{w}.example", "www.example.com", "{w}{v}.example.net", "{v}.{w}.example.edu", "example.org", "{w}.net", "{w}{n}.com", "{v}.org", "b.net", "a.org", "x.com", "t{n}.net")
UNWANTED_PATHS = ("/{w}/bonus", "/buy-{w}-cheap.html", "/{w}", "/{v}/{w}/{n}", "/go/{w}?ref={n}", "/{w}-{v}-{n}.html", "/free-{w}/")
ORDINARY_PATHS = ("/en/{w}/{n}", "/{w}/2019/06/{v}.html", "/{w}", "/{v}/{w}/{n}", "/index.php?page={w}", "/{w}-{v}-{n}.html", "/", "")
#: URLs that the default table has of each label.
EXAMPLES = 3000


def examples(unwanted: list[str] = UNWANTED, ordinary: list[str] = ORDINARY, n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """A labelled table (url, 1 if unwanted): n URLs of each label, drawn from words and forms. An unwanted one has a word in host or path."""
    draw, out = random.Random(seed), []
    for words, hosts, paths, label in ((unwanted, UNWANTED_HOSTS, UNWANTED_PATHS, 1), (ordinary, ORDINARY_HOSTS, ORDINARY_PATHS, 0)):
        for _ in range(n):
            host, path = draw.choice(hosts), draw.choice(paths)
            if label and "{w}" not in host + path:
                path = "/{w}"
            part = lambda form: form.format(w=draw.choice(words), v=draw.choice(words if label and draw.random() < 0.5 else ordinary), n=draw.randrange(10 ** draw.randint(1, 5)))
            out.append((f"{draw.choice(('http', 'https'))}://{part(host)}{part(path)}", label))
    return out


def grams(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the distinct character n-grams of host and path (lists of these); each is marked with its part."""
    rows, places = [], []
    for mark, column in enumerate(parts):
        texts = [f"^{x.lower()}$" if x else "" for x in column]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        sizes = np.array([len(x) for x in texts], np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters up to the text's end
        value = np.full(len(points), mark + 1, np.uint64)
        for n in range(1, MOST_GRAM + 1):
            value = value[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(1)
            if n >= LEAST_GRAM:
                whole = left[: len(value)] >= n
                rows.append(row[: len(value)][whole])
                places.append((mixed(value[whole]) % np.uint64(DIMENSIONS)).astype(np.int64))
    both = np.unique(np.concatenate(rows) * DIMENSIONS + np.concatenate(places)) if rows else np.empty(0, np.int64)
    return both // DIMENSIONS, both % DIMENSIONS


def score(parts: list[list[str]], weights: np.ndarray) -> np.ndarray:
    """The chance of each row to be unwanted; 0 for rows without host and path."""
    n = len(parts[0])
    row, place = grams(parts)
    count = np.bincount(row, minlength=n)
    total = np.bincount(row, weights[place], minlength=n) / np.sqrt(np.maximum(count, 1)) + weights[-1]
    return np.where(count > 0, 1 / (1 + np.exp(-np.clip(total, -500, 500))), 0.0)


def cut_url(url: str) -> tuple[str, str]:
    """Host and path, as :func:`host` and :func:`path` have them."""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("?", 1)[0].split("#", 1)[0]
    name, slash, more = rest.partition("/")
    return "".join(c.lower() if c.isascii() else c for c in name), slash + more


def train(table: list[tuple[str, int]], steps: int = 300, rate: float = 2.0, shrink: float = 1e-5) -> np.ndarray:
    """Weights for the n-grams' places, and last the bias. The table is small; so is the model."""
    w = np.zeros(DIMENSIONS + 1)
    if not table:
        return w
    row, place = grams([list(x) for x in zip(*(cut_url(url) for url, _ in table), strict=True)])
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(table)), 1))
    y = np.array([label for _, label in table], float)
    for _ in range(steps):
        z = np.bincount(row, w[place], minlength=len(y)) * value + w[-1]
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        slope = np.append(np.bincount(place, (error * value)[row], minlength=DIMENSIONS), error.sum())
        w -= rate * (20 * slope + shrink * w)
    return w


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(F.substr(url, F.instr(url, F.lit("://")) + 3), "?", 1), "#", 1)).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.substring_index(_after(url), "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    rest = _after(url)
    return F.when(F.instr(rest, "/") > 0, F.substr(rest, F.instr(rest, F.lit("/")))).otherwise("")


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)
        name = F.when(fits, text) if name is None else name.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def judge(pages: DataFrame, labelled: list[tuple[str, int]] | None = None, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The pages with host, path, rule, verdict and the model's score."""
    weights = pages.sparkSession.sparkContext.broadcast(train(examples() if labelled is None else labelled))

    def judged(host: pa.Array, path: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for begin in range(0, len(host), 1000):
            out.append(score([host[begin : begin + 1000].to_pylist(), path[begin : begin + 1000].to_pylist()], weights.value))
        return pa.array(np.concatenate(out), pa.float64())

    keep = [F.col(f"`{c}`") for c in others(pages, RESULT)]
    url = F.coalesce(F.col("url"), F.lit(""))
    made = pages.select(*keep, F.struct(host(url).alias("host"), path(url).alias("path")).alias("_own"))
    name, verdict = rule(F.col("_own.host"), F.col("_own.path"), rules)
    made = made.withColumn("_score", F.arrow_udf(judged, "double")("_own.host", "_own.path"))
    by_model = F.when(F.col("_score") >= threshold, BLOCK).otherwise(ALLOW)
    return made.select(*keep, "_own.host", "_own.path", name.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), F.col("_score").alias("score"))
