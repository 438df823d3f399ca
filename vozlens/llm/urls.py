"""URL filters: logistic regression on hashed character n-grams of host and path.

Everything on rows is a DataFrame expression; scoring is one narrow projection
with no shuffle, so a hot host or a repeated url costs nothing extra.

Defined results: a null url or one without ``://`` has empty host and path and
is judged by the bias alone; ties of rules go to the longer rule string, and no
two rules of the same string may be given; repeated rows are judged alike; an
empty table gives an empty table; other columns of the input stay, but for those
named like the results, which are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hash buckets of n-grams; the model is this many doubles, whatever the input.
BUCKETS = 8192
#: Lengths of the n-grams.
SIZES = (3, 4, 5)
#: Probability from which a url is blocked.
THRESHOLD = 0.5
#: The most labelled rows that a fit reads; the seed table has a fraction of it.
MAX_LABELLED = 20_000

#: (rule, verdict): host, then the path's start.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The labelled table's words, by what public block lists and directories are about; the last of
# each row (after the bar) are held out of the fit and only tell how well it does on unseen words.
_UNWANTED = {
    "gambling": "casino poker slots jackpot roulette blackjack betting bets wager gamble bookmaker sportsbook scratchcards lotto | bingo baccarat casinos gambling",
    "adult": "porn porno xxx sex sexy nude nudes escort escorts hookup camgirl camgirls webcams erotic adult milf hentai stripper | sexcam adults pornhub nudity",
    "drugs": "viagra cialis pills xanax tramadol steroids valium rxmeds weightloss potency diazepam ambien | levitra pill steroid viagras",
    "money": "payday loans quickcash fastcash easymoney getrich forexprofit doubler instantloan moneyback creditfix cashadvance | loan paydays cashloan richquick",
    "fakes": "replica replicas fakes counterfeit knockoff fakeid cheapwatches luxurycopies dupes | replicawatch fake counterfeits",
    "piracy": "warez cracked keygen nulled torrent torrents serialkey crackz freefullmovie | crack keygens torrentz",
    "phishing": "verifyaccount secureverify accountlocked loginverify updatebilling confirmidentity suspendedlogin passwordreset | accountverify billingupdate",
    "malware": "freedownloadz driverupdate pccleaner toolbars speedupnow virusalert fixerror installnow | cleanerpc errorfix",
    "ads": "adserver adclick adserve adnet adtrack adtracker clicktracker popunder popads bannerads trackpixel affiliate clickbait ads tracker | adclicks popunders adtracking",
    "spam": "spam spammer linkfarm backlinks seolinks bulkmail massmail winprizes freeprizes giveaway lucky winner clickhere freegift | spams linkfarms prizewinner",
}
_WANTED = {
    "news": "news daily times herald gazette tribune journal weekly magazine press report bulletin | newspaper chronicle",
    "learning": "school university college library science physics chemistry history museum archive academy lessons dictionary wiki essays | biology encyclopedia",
    "public": "government council parliament police embassy election taxoffice transport railway airport weather | ministry airports",
    "health": "hospital clinic health dental nursing medicine pharmacy nutrition cancer therapy | dentist clinics",
    "money": "bank banking savings payments insurance accounting invoices pensions mortgage currency economy | payment banks",
    "trade": "shop store bakery furniture garden tools books toys clothes shoes market grocery deals | bookstore markets",
    "travel": "travel hotels flights springs island beach camping cruise mountains trains hostel tickets | hotel flight",
    "making": "software code python kernel github devblog cloud data network hardware printer robotics design | database compiler",
    "leisure": "music guitar theatre cinema film games chess football tennis cycling running fishing knitting poetry recipes cooking kitchen | movies recipe",
    "nature": "river forest birds horses gardening flowers trees ocean climate energy solar farming tractor farmers | forests flower",
    "people": "family parents wedding church charity community volunteer forum blog diary photos portrait | families blogs",
    # words that hold or resemble unwanted ones
    "alike": "essex sussex middlesex sextant adultlearning address addition adventure advice adviser loading admin between alphabet better betterhomes winter window windmill twin winery cashmere click freedom freeport tracks racetrack soundtrack trackandfield spillway caterpillar pillow pillar hotline hotspring shotput farmhouse alphabetical backlog linkedlist bulksolids primetimes fakir payload paydate loanword | sussexwalks hotsprings windows pillows adverb",
}
_SYLLABLES = ("th", "er", "in", "on", "an", "re", "ti", "es", "ha", "or", "nt", "ed", "he", "le", "ou", "la", "ver", "mo", "ski", "ba")
_TOPS = ("com", "org", "net", "info", "co.uk", "de", "fr", "es", "io", "example.com", "example.org", "example.net", "test")
_BEFORE = ("", "", "www.", "blog.", "m.", "shop.", "cdn.")


def _words(kinds: dict[str, str], held: bool) -> list[str]:
    return [w for row in kinds.values() for w in row.split("|")[held].split()]


def labelled_urls(held: bool = False, per_word: int = 14) -> list[tuple[str, int]]:
    """(url, label) by rule, the same everywhere; label 1 is to be blocked. ``held``: of the words kept out of the fit."""
    draw = random.Random(90210 + held)
    good, bad = _words(_WANTED, held), _words(_UNWANTED, held)
    if not held:
        good += ["".join(draw.choice(_SYLLABLES) for _ in range(draw.randint(1, 4))) for _ in range(len(good))]
    rows = []
    for word, label in [(w, 0) for w in good] + [(w, 1) for w in bad]:
        for i in range(per_word):
            other = draw.choice(good if i % 2 or not label else bad)
            joined = draw.choice((word, word, f"{word}-{other}", f"{other}-{word}", word + other, f"{word}{draw.randint(1, 99)}", f"{word}.{other}", f"my{word}", f"best-{word}", f"the{word}", f"free-{word}", f"cheap-{word}", f"{word}-online", f"{word}-x"))
            tail = draw.choice(("", "/", "/index.html", f"/{draw.choice(good)}", f"/{draw.choice(('en', 'de', 'fr', 'es', 'pt'))}/{draw.randint(1, 9999)}", f"/{draw.choice(good)}/{draw.choice(good)}-{draw.randint(1, 99)}.html", f"/a?id={draw.randint(1, 999)}"))
            host = f"{draw.choice(_BEFORE)}{joined}.{draw.choice(_TOPS)}{tail}"
            if i % 7 == 6:  # the word in the path of a plain host
                host = f"{draw.choice(_BEFORE)}{draw.choice(good)}.{draw.choice(_TOPS)}/{draw.choice(('', 'en/', 'pages/'))}{joined.replace('.', '-')}{draw.choice(('', '/', '.html'))}"
            rows.append((f"{draw.choice(('http', 'https'))}://{host}", label))
    return rows


def seed_table(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label)."""
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def _bucket(kind: str) -> Callable[[Column], Column]:
    """16 bits of the MD5 of the marked n-gram, which SQL has too, modulo ``BUCKETS``."""
    return lambda gram: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(kind), gram).cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(BUCKETS))


def features(host: Column, path: Column, sizes: Sequence[int] = SIZES) -> Column:
    """Buckets (with repeats) of the character n-grams of host and path; a mark tells them apart."""
    grams = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), F.regexp_replace(path, "[0-9]+", "0"), F.lit("$")))):
        for n in sizes:
            runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # overlapping, in one pass
            grams.append(F.transform(runs, _bucket(f"{mark}{n}")))
    return F.concat(*grams)


def features_py(url: str, sizes: Sequence[int] = SIZES) -> list[int]:
    """The same of one url on the driver, for the small labelled table."""
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = (found[1].translate(str.maketrans(UPPER, LOWER)), found[2]) if found else ("", "")
    out = []
    for mark, text in (("h", f"^{host}$"), ("p", "^" + re.sub("[0-9]+", "0", path) + "$")):
        for n in sizes:
            out += [int(hashlib.md5(f"{mark}{n}{text[i : i + n]}".encode()).hexdigest()[:4], 16) % BUCKETS for i in range(len(text) - n + 1)]
    return out


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and bias from a labelled url table (url, label).

    At most ``MAX_LABELLED`` labelled rows are read, by smallest hash of the url
    (the bound of the fit; rows that are judged have none).  Null labels are left
    out; with no labelled rows at all every weight and the bias are 0.
    """
    rows = labelled.where(F.col("label").isNotNull()).select("url", "label", F.xxhash64("url").alias("o")).orderBy("o", "label").limit(MAX_LABELLED).collect()
    return fit_rows([(r.url or "", r.label) for r in rows])


def fit_rows(rows: Sequence[tuple[str, int]], steps: int = 400, rate: float = 8.0, l2: float = 3e-5) -> tuple[list[float], float]:
    """Full-batch gradient descent with momentum; a row's n-grams share a unit of length, and classes share the weight."""
    if not rows:
        return [0.0] * BUCKETS, 0.0
    y = np.array([float(label) for _, label in rows])
    x = [features_py(url) for url, _ in rows]
    share = np.where(y > 0, len(y) / 2 / max(y.sum(), 1), len(y) / 2 / max(len(y) - y.sum(), 1)) / len(y)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in x])
    used, col = np.unique(np.concatenate([np.array(r, np.int64) for r in x]), return_inverse=True)
    value = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=len(rows)), 1))[at]
    weights, speed, bias, speed_b = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for _ in range(steps):
        z = np.bincount(at, weights=weights[col] * value, minlength=len(rows)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        speed = 0.9 * speed - rate * (np.bincount(col, weights=d[at] * value, minlength=len(used)) + l2 * weights)
        speed_b = 0.9 * speed_b - 0.05 * rate * d.sum()
        weights, bias = weights + speed, bias + speed_b
    full = np.zeros(BUCKETS)
    full[used] = weights
    return full.tolist(), float(bias)


_seed_model: list[tuple[list[float], float]] = []


def seed_model() -> tuple[list[float], float]:
    """The model of the labelled table above, fitted once in a driver's life; weights to 6 digits, as SQL gets them."""
    if not _seed_model:
        weights, bias = fit_rows(labelled_urls())
        _seed_model.append(([float(f"{w:.6f}") for w in weights], float(f"{bias:.6f}")))
    return _seed_model[0]


def score(host: Column, path: Column, model: tuple[list[float], float]) -> Column:
    """Probability that the url is to be blocked."""
    weights, bias = model
    table_ = F.split(F.lit(weights_text(weights)), ",").cast("array<double>")  # folded once, at planning
    x = features(host, path)
    z = F.aggregate(x, F.lit(0.0), lambda acc, k: acc + F.get(table_, k)) / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double")) + F.lit(bias)
    return 1 / (1 + F.exp(-z))


def weights_text(weights: Sequence[float]) -> str:
    return ",".join(f"{w:.9g}" for w in weights)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, model: tuple[list[float], float], rules: Sequence[tuple[str, str]] = RULES, url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """Adds host, path, rule, block_score and verdict (``allow`` or ``block``) to every row."""
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": name, "block_score": score(F.col("host"), F.col("path"), model)})
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_score") >= threshold, "block").otherwise("allow")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every url of ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, seed_model()).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB SQL for the query's rows: the same parts, n-grams, buckets and weights."""
    weights, bias = seed_model()
    grams = ", ".join(f"list_transform(range(1, length({t}) - {n - 2}), lambda i: CAST('0x' || substr(md5('{m}{n}' || substr({t}, i, {n})), 1, 4) AS INTEGER) % {BUCKETS})" for m, t in (("h", "ht"), ("p", "pt")) for n in SIZES)
    by_length = sorted(RULES, key=lambda r: -len(r[0]))
    cases = {rule: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*rule.split("/", 1)) for rule, _ in by_length}
    rule = " ".join(f"WHEN {cases[r]} THEN '{r}'" for r, _ in by_length)
    says = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in by_length)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
texts AS (SELECT *, '^' || host || '$' AS ht, '^' || regexp_replace(path, '[0-9]+', '0', 'g') || '$' AS pt, CASE {rule} END AS rule FROM parts),
grams AS (SELECT *, flatten([{grams}]) AS x FROM texts),
model AS (SELECT CAST(string_split('{weights_text(weights)}', ',') AS DOUBLE[]) AS w),
scored AS (SELECT page_id, host, path, rule, 1 / (1 + exp(-(coalesce(list_sum(list_transform(x, lambda k: w[k + 1])), 0) / sqrt(greatest(len(x), 1)) + {bias}))) AS p FROM grams, model)
SELECT page_id, host, path, rule, CASE {says} WHEN p >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict FROM scored
"""
