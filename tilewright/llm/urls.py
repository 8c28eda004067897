"""URL filters: path rules, and a logistic regression on hashed character n-grams of host and path.

``host``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; ``path``: from
there up to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty. A rule
``host/path`` fits its host and all subdomains when the url's path starts with the rule's path; of the
rules that fit, the longest wins. Without one the model judges. Rows are independent; repeated rows
stay and an empty table gives an empty one. Columns host, path, rule, verdict and url_score of the input are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The labelled table below is small; the fit refuses more rows than this.
MOST_TRAINING_ROWS = 20_000
BUCKETS = 1 << 16
SIZES = (3, 4, 5)

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: Words that names of unwanted and of ordinary sites are made of, by field.
BAD = """
adult amateur babes cams dating escort erotic hookup milf naked nude porn sexy xxx
bet betting bingo blackjack bookie casino gamble jackpot lottery poker roulette slots wager
cialis diet meds pharma pharmacy pills rx slimming steroids viagra weightloss
cash crypto credit debt doubler forex instantloan invest loans millionaire payday profit
ad adserver ads affiliate banner click pixel popunder popup promo redirect track tracker traffic
cracked cracks hacks keygen leaked serials torrent warez
bargain cheap coupon deals discount fake free giveaway prize replica reward spam sweepstakes winner
"""
GOOD = """
academy archive college course history institute journal laboratory lecture library museum research school science society university
bakery cafe cooking farmhouse garden hotel kitchen market recipes restaurant tea vineyard
city council county court embassy government ministry parish police post town village
chronicle daily gazette herald magazine news observer press review times tribune weekly
clinic dental doctor health hospital medicine nurse therapy
bridge builders carpenter design engineering factory machines paper printing railway steel tools workshop
astronomy birds forest geology island lake mountain ocean river valley weather wildlife
choir cinema dance film gallery guitar music opera orchestra painting poetry theatre
code compiler data docs forum kernel linux manual network software wiki
climbing club cycling football hiking rowing rugby sailing ski sport swimming tennis
"""
#: Endings of names, prefixes of hosts, and paths that either or one kind has.
ENDINGS = "com com com net org info io co.uk de fr es eu us".split()
PREFIXES = ["", "", "www.", "www.", "blog.", "m.", "shop.", "news."]
PATHS = ["", "/", "/index.html", "/en/about", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/page/{n}", "/2019/05/{w}", "/category/{w}", "/{w}/{n}", "/{w}.php"]
BAD_PATHS = ["/go/{n}", "/click/{n}", "/signup-bonus", "/{w}-{w}-now", "/out/{w}", "/lp/{n}"]
GOOD_PATHS = ["/articles/{w}-{w}", "/wiki/{w}", "/people/{n}", "/docs/{w}/{n}", "/contact", "/events/{n}"]


def training_urls(fold: int | None = None, names_each: int = 900, seed: int = 9) -> pd.DataFrame:
    """A small labelled table (url, blocked) made from the words above, drawn from a seed.

    A name is one or two words of its kind, together, with a hyphen or with a number; a bad name may hold an ordinary
    word beside a bad one. With a ``fold`` of 0 to 4 only every fifth word from that one on is used, with a negative one
    (-1 to -5) only the others, so that names of a fold and of its rest share no word.
    """

    def words(kind: str) -> list[str]:
        return [w for i, w in enumerate(kind.split()) if fold is None or (i % 5 == fold if fold >= 0 else i % 5 != -1 - fold)]

    bad, good = words(BAD), words(GOOD)
    r = np.random.RandomState(seed)

    def one(of: list) -> str:
        return of[r.randint(len(of))]

    rows = []
    for kind in (1, 0):
        for _ in range(names_each):
            pair = [one(bad if kind else good), one(good if r.rand() < (0.3 if kind else 1) else bad)]
            if r.rand() < 0.5:
                pair.reverse()
            shape = r.randint(4)
            name = [pair[0] + pair[1], "-".join(pair), one(bad if kind else good) + str(r.randint(1, 1000)), one(bad if kind else good)][shape]
            path = one(PATHS if r.rand() < 0.6 else BAD_PATHS if kind else GOOD_PATHS)
            while "{w}" in path:
                path = path.replace("{w}", one(bad if kind else good), 1)
            rows.append((f"http{one(['', 's'])}://{one(PREFIXES)}{name}.{one(ENDINGS)}{path.replace('{n}', str(r.randint(1, 10_000)))}", kind))
    return pd.DataFrame(rows, columns=["url", "blocked"])


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    lowered = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does. Equally long ones: the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character n-grams of a host and a path."""
    out = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        s = s.encode("utf-8", "surrogatepass")
        seed = zlib.crc32(mark.encode())
        for n in SIZES:
            out.update(zlib.crc32(s[i : i + n], seed) % BUCKETS for i in range(len(s) - n + 1))
    return np.fromiter(out, np.int64, len(out))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        g = grams(host, path)
        return float(1 / (1 + np.exp(-(self.bias + self.weights[g].sum() / np.sqrt(max(1, len(g)))))))


def split(url: str | None) -> tuple[str, str]:
    """As ``host_and_path``, for the training table."""
    rest = (url or "").partition("://")[2]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[cut:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def fit(labelled: pd.DataFrame, steps: int = 300, rate: float = 2.0, ridge: float = 1e-3) -> UrlModel:
    """Full-batch gradient descent on a small labelled table (url, blocked 0/1); null labels are left out."""
    labelled = labelled.dropna(subset=["blocked"])
    if len(labelled) > MOST_TRAINING_ROWS:
        raise ValueError(f"{len(labelled)} labelled urls; at most {MOST_TRAINING_ROWS}")
    feats = [grams(*split(u)) for u in labelled["url"]]
    if not feats:
        return UrlModel(np.zeros(BUCKETS), -10.0)
    row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    col = np.concatenate(feats)
    val = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(feats))))[row]
    y = labelled["blocked"].to_numpy(float)
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col] * val, len(feats)) + b)))
        g = (p - y) * each
        w -= 10 * rate * (np.bincount(col, g[row] * val, BUCKETS) + ridge * w / 10)
        b -= rate * g.sum()
    return UrlModel(w, float(b))


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] | None = None, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and url_score (the model's probability of block)."""
    model = model or fit(training_urls())
    host, path = host_and_path(F.col(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles

    @F.pandas_udf("double")
    def score(h: pd.Series, p: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(a, b) for a, b in zip(h, p, strict=True)], dtype="float64")

    out = pages.withColumns({"host": host, "path": path}).withColumn("url_score", score("host", "path"))
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("url_score") >= threshold, "block").otherwise("allow"))})
