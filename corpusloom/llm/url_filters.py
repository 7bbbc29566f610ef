"""URL filters: host/path rules first, then logistic regression on hashed character n-grams.

Everything runs in the JVM.  The classifier is fitted on a small labelled URL
table (at most ``MAX_LABELLED`` rows) and its bounded weight vector becomes one
constant array of the scoring expression, so that scoring needs no shuffle, no
join and no Python.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import UPPER, stash

#: Rules as (verdict, rule); a rule is host suffix plus path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Rules beyond this count go through a join on host suffixes instead of a constant array.
MAX_INLINE_RULES = 500
BUCKETS = 1 << 15
#: Strong enough that what many names share outweighs what tells single names apart.
REGULAR = 0.0001
SIZES = (4, 5)
#: Bound of the labelled table that the classifier is fitted on.
MAX_LABELLED = 20_000

# Words of unwanted and of ordinary addresses, by subject; the labelled table is made of them by rule.
_UNWANTED = (
    "casino poker roulette jackpot slots blackjack betting bookmaker sportsbook baccarat wager gamble",
    "porn xxx nude escort webcam erotic fetish hentai milf sexy adult hookup",
    "viagra cialis pharmacy pills steroids slimming meds tramadol xanax dietpills enlargement hairloss",
    "payday loans forex cryptodouble lottery giveaway getrich cashback binary-options timeshare ponzi prizes",
    "warez torrent keygen cracked nulled pirated freemovies fullversion serialkey hacktool cheats modapk",
    "adserver adclick popunder tracking affiliate clickbait retarget pixel doorway linkexchange bulkmail traffic",
    "replica rolex handbags counterfeit outlet knockoff fakeid cheapest discount-shoes essays diploma followers",
)
_ORDINARY = (
    "library museum archive gallery theatre orchestra cinema heritage castle cathedral festival exhibition",
    "school college university institute academy kindergarten faculty campus lectures seminar students alumni",
    "physics biology chemistry geology astronomy algebra geometry statistics botany zoology genetics medicine",
    "kitchen recipes bakery garden orchard vineyard carpentry knitting pottery painting cycling hiking",
    "weather climate ocean forest river mountain island harbour village county region parish",
    "council ministry parliament police hospital clinic surgery dentist nursing firebrigade railway airport",
    "journal gazette herald tribune chronicle magazine review letters editor press radio bulletin",
    "software compiler kernel database network hardware robotics python linux manual tutorial documentation",
    "football cricket rugby tennis swimming rowing athletics chess stadium league olympic marathon",
    "poetry novel grammar dictionary translation linguistics history philosophy ethics theology folklore biography",
    "schule bibliothek verein stadtwerke wetter garten musik rathaus kirche zeitung werkstatt baumarkt",
    "ecole mairie jardin musique cuisine voyage librairie lycee boulangerie patrimoine escuela biblioteca",
)
_WITH = "online best my top live world city 24 shop club hub daily the new get 365 euro pro info".split()
_TOPS = "com net org info co.uk de fr es io eu".split()
_BEFORE = ("", "www.", "m.", "blog.", "")
_ROADS = ("", "/", "/index.html", "/en/", "/news/2019/04/12", "/a/b?c=1", "/page/7", "/about")
#: Ordinary names that mean nothing: as many, each of a few such syllables.
_INVENTED, _ONSETS, _RIMES = 3000, "b c d f g k l m n p r s t v z br st tr th".split(), "a e i o u ai en or er es in on".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table ``(url, label, name)``; label 1 is unwanted, ``name`` is the registered name.

    Words stand in names alone, with words that say nothing and with another
    of their line, and in paths of hosts whose names say nothing.  Tops, first
    labels and paths are drawn alike for both labels.
    """
    rows, draw = [], random.Random(5)

    def invented() -> str:
        return "".join(draw.choice(_ONSETS) + draw.choice(_RIMES) for _ in range(draw.randrange(2, 5)))

    def add(name: str, road: str, label: float) -> None:
        rows.append((f"{draw.choice(('http', 'https'))}://{draw.choice(_BEFORE)}{name}.{draw.choice(_TOPS)}{road}", label, name))

    for label, lines in ((1.0, _UNWANTED), (0.0, _ORDINARY)):
        for line in lines:
            words = line.split()
            for word in words:
                for form in ("{0}", "{0}-{2}", "{0}{2}", "{2}-{0}", *("{1}{0}", "{0}{1}", "{1}-{0}", "{0}-{1}") * 8):
                    add(form.format(word, draw.choice(_WITH), draw.choice(words)), draw.choice(_ROADS), label)
                for _ in range(2):
                    add(invented(), f"/{word}/{draw.choice(words)}", label)
    for _ in range(_INVENTED):
        add(invented(), draw.choice(_ROADS), 0.0)
    return spark.createDataFrame(rows, "url string, label double, name string")


def host_and_path(url: str | Column = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; null or no ``://``: both empty."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of host and path, with marks for where a gram is from."""

    def grams(text: Column, mark: str) -> list[Column]:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        return [
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i, n=n: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))
            for n in SIZES
        ]

    all_grams = F.concat(*grams(host, "h"), *grams(path, "p"))
    return F.array_distinct(F.transform(all_grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def fit(labelled: DataFrame) -> tuple[float, list[float]]:
    """Intercept and weights; ``labelled`` has ``url`` and ``label`` (1 is unwanted).

    Null urls or labels are left out, repeated rows count as often as they
    come.  Of a table of over ``MAX_LABELLED`` rows those with the least hashes
    are taken.  Without rows of both labels every weight is zero.
    """
    labelled = labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
    # written, so that the rounds read buckets and do not make them anew
    rows = stash(labelled.select("label", buckets(*host_and_path()).cast("array<string>").alias("on")), "labelled").coalesce(1)
    sides = rows.agg(F.count_if(F.col("label") == 1.0).alias("unwanted"), F.count_if(F.col("label") == 0.0).alias("ordinary")).first()
    if not sides["unwanted"] or not sides["ordinary"]:
        return (1.0 if sides["unwanted"] else -1.0), [0.0] * BUCKETS
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], "on", "features", binary=True)
    weight = F.when(F.col("label") == 1.0, 0.5 / sides["unwanted"]).otherwise(0.5 / sides["ordinary"])  # the rarer label counts as much
    learner = LogisticRegression(maxIter=60, regParam=REGULAR, standardization=False, weightCol="weight")
    model = learner.fit(vectors.transform(rows).select("label", "features", weight.alias("weight")))
    return float(model.intercept), [float(w) for w in model.coefficients]


def score(host: Column, path: Column, intercept: float, weights: list[float]) -> Column:
    """Probability that an address is unwanted."""
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")  # folded to one constant
    z = F.aggregate(buckets(host, path), F.lit(intercept), lambda total, k: total + F.element_at(table, k + 1))
    return 1 / (1 + F.exp(-z))


def _rule_rows(rules) -> list[tuple[str, str, str, str]]:
    return [(verdict, rule, rule.partition("/")[0], "/" + rule.partition("/")[2]) for verdict, rule in rules]


def match_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``hit`` (struct verdict, rule; null if none fits): the longest rule wins.

    Few rules are one constant array.  More than ``MAX_INLINE_RULES`` are joined
    on the host's suffixes, which Spark may broadcast by their size or split.
    """
    if len(rules) <= MAX_INLINE_RULES:
        table = F.array(*[F.struct(F.lit(len(r)).alias("n"), F.lit(v).alias("verdict"), F.lit(r).alias("rule"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, r, h, p in _rule_rows(rules)]) if rules else None
        if table is None:
            return df.withColumn("hit", F.lit(None).cast("struct<verdict:string,rule:string>"))
        fits = F.filter(table, lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"]))) & F.startswith(F.col("path"), r["p"]))
        best = F.array_max(fits)
        return df.withColumn("hit", F.when(F.size(fits) > 0, F.struct(best["verdict"].alias("verdict"), best["rule"].alias("rule"))))
    table = df.sparkSession.createDataFrame(_rule_rows(rules), "verdict string, rule string, h string, p string")
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    hits = keyed.select("_row", "path", F.explode(suffixes).alias("h")).join(table, "h").where(F.startswith("path", F.col("p")))
    hits = hits.groupBy("_row").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best"))
    return keyed.join(hits.select("_row", F.struct("best.verdict", "best.rule").alias("hit")), "_row", "left").drop("_row")


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Judges every row's ``url``: ``page_id, host, path, rule, verdict, score``.

    Null urls and urls without ``://`` have empty host and path; they fit no
    rule and get the classifier's verdict.  Repeated rows are judged each;
    other columns, whatever their names, are not read.  No rows in, none out.
    """
    intercept, weights = fit(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    host, path = host_and_path()
    parts = match_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    chance = score(F.col("host"), F.col("path"), intercept, weights)
    return parts.withColumn("score", chance).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score",
    )
