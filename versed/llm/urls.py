"""URL filters: host and path rules first, else a logistic regression on hashed character n-grams.

Only DataFrame, SQL and Spark ML functions are used. The model is trained from a small labelled URL table, an input of
train(); labelled() makes one from lists of common words. Scoring sums the learned weights of a URL's distinct n-grams
inside one projection, so `pages` is read once, without a shuffle.

Defined cases: a null url, or one without `://`, has an empty host and path and is judged by the model; repeated rows
get repeated verdicts; of rules of equal length that both fit the last one given wins; whole urls are judged, of any
length; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versed.llm.common import cut

#: Buckets of hashed n-grams.
BUCKETS = 2048

#: (verdict, host, path) of the rules in force.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Words of which unwanted and ordinary hosts are often made, for labelled().
UNWANTED = """
casino poker roulette jackpot betting bets slots lottery bingo viagra pills pharmacy meds steroids replica counterfeit warez crack keygen
torrent adult porn xxx cams escort hookup loans payday forex bitcoin doubler prize winner giveaway clickbait track ads banner popup
spam seo backlinks farm phishing malware
""".split()
ORDINARY = """
library museum garden weather school university hospital recipes travel radio news docs wiki project city council train maps theatre bakery
music science history health sport kitchen house forest river mountain bridge market coffee bread teacher student office letter paper book
language grammar physics chemistry biology archive journal gallery village church harbour station orchard dairy carpenter plumber dentist
bibliothek schule zeitung wetter stadt verein garten rathaus kirche bahnhof verlag handwerk
bibliotheque ecole musee jardin meteo ville mairie cuisine gare librairie journaux
biblioteca escuela museo tiempo ciudad cocina noticias ayuntamiento estacion libros
""".split()
BESIDE = "my the best top online daily open free big one go our".split()
UNWANTED_PATHS, ORDINARY_PATHS = "play win order buy click bonus claim live".split(), "about contact article guide page index events team".split()
#: Hosts for each word, and made-up ordinary names.
EACH, MADE_UP = 10, 300


def labelled(spark: SparkSession) -> DataFrame:
    """url, label (1 is to be blocked) and host: a few hosts for each word of the lists, alone or with another, and ordinary hosts of made-up syllables."""

    def pick(words: list[str], *salt: str | Column) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(*(F.lit(x) if isinstance(x, str) else x for x in salt)), F.lit(len(words))) + 1).cast("int"))

    def hosts(words: list[str], label: int) -> DataFrame:
        rows = spark.range(len(words) * EACH).select("id", F.element_at(F.array(*map(F.lit, words)), F.floor(F.col("id") / EACH).cast("int") + 1).alias("word"))
        other = F.when(F.col("id") % 2 == 0, pick(words, "other", F.col("id"))).otherwise(pick(BESIDE, "beside", F.col("id")))
        join = pick(["-", "-", ""], "join", F.col("id"))
        name = F.when(F.col("id") % EACH == 0, F.col("word")).when(F.col("id") % 3 == 0, F.concat(other, join, "word")).otherwise(F.concat("word", join, other))
        return rows.select("id", name.alias("name"), F.lit(label).alias("label"))

    syllable = [pick([c + v for c in "bdfghklmnprstvw" for v in ("a", "e", "i", "o", "u", "er", "on", "in")], "syllable", str(k), F.col("id")) for k in range(3)]
    made_up = spark.range(MADE_UP).select("id", F.concat(*syllable[:2], F.when(F.col("id") % 2 == 0, syllable[2]).otherwise("")).alias("name"), F.lit(0).alias("label"))
    rows = hosts(UNWANTED, 1).union(hosts(ORDINARY, 0)).union(made_up)
    host = F.concat(pick(["", "", "www.", "m.", "blog."], "front", F.col("id"), F.col("name")), "name", pick([".test", ".example", ".invalid"], "end", F.col("id"), F.col("name")))
    word = F.when(F.col("label") == 1, pick(UNWANTED_PATHS, "path", F.col("id"))).otherwise(pick(ORDINARY_PATHS, "path", F.col("id")))
    place = F.concat(pick(["en/", "de/", "fr/", "es/"], "lang", F.col("id"), F.col("name")), F.pmod(F.xxhash64("id", "name"), F.lit(10_000)).cast("string"))
    url = F.concat(pick(["https://", "http://"], "scheme", F.col("id")), host, F.lit("/"), F.when(F.pmod(F.xxhash64("name"), F.lit(3)) == 0, word).otherwise(place))
    empty = spark.range(2).select(F.when(F.col("id") == 0, "https://").otherwise("").alias("url"), F.lit(0).alias("label"), F.lit("").alias("host"))
    return rows.select(url.alias("url"), "label", host.alias("host")).union(empty)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first `://`, and the path up to `?`, `#` or the end; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, where, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(where + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the 3- and 4-grams of host and path, each with its ends marked."""

    def grams(mark: str, text: Column, n: int) -> Column:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        return F.transform(chars, lambda c, i: (F.crc32(F.concat(F.lit(mark), c, *(F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(1, n))).cast("binary")) % BUCKETS).cast("int"))

    return F.array_distinct(F.concat(grams("h:", host, 3), grams("h:", host, 4), grams("p:", path, 3)))


def train(urls: DataFrame) -> tuple[list[float], float]:
    """Weights by bucket and the intercept, fitted by Spark ML from a small table of url and label (0 or 1; rows without one don't count)."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = urls.where("label is not null").select(F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path"))
    rows = cut(rows.select("label", buckets(F.col("host"), F.col("path")).alias("at")))  # else each of the features below would work it out again
    ones = CountVectorizerModel.from_vocabulary([str(k) for k in range(BUCKETS)], "names", "features").setBinary(True)  # sparse, the bucket's number as the place
    rows = ones.transform(rows.select("label", F.col("at").cast("array<string>").alias("names")))
    model = LogisticRegression(regParam=0.001, standardization=False, maxIter=30).fit(rows.select("label", "features").coalesce(1))
    return model.coefficients.toArray().tolist(), float(model.intercept)


def judge(pages: DataFrame, weights: list[float], intercept: float, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`id_col`, host, path, rule, verdict and score (the model's probability of block) of every row."""
    host, path = host_and_path(F.col("url"))
    learned = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"found": rule_for(F.col("host"), F.col("path"), rules), "at": buckets(F.col("host"), F.col("path"))})
    logit = F.aggregate("at", F.lit(intercept), lambda total, i: total + F.get(learned, i))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-logit)))
    return rows.select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )
