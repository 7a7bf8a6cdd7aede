"""URL filter: host and path rules, and a logistic regression for the rest, in DataFrame functions only.

The regression is trained from a small labelled URL table by full-batch gradient steps
inside one aggregate expression over one row (the table must stay small: it is gathered
into arrays). It is used as a scalar subquery, so that scoring needs no join and no
shuffle: each address is cut into character trigrams and 4-grams, which are hashed, and
their weights are summed.

Nulls and odd rows: a null address, or one without ``://``, has an empty host and path
and is judged by the regression; null ids are kept; repeated rows are judged each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash slots, gradient steps, step size and shrinkage.
SLOTS, STEPS, RATE, SHRINK = 4096, 150, 0.06, 0.01

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of addresses that are blocked, and of others.
BLOCKED = "casino poker bets betting slots jackpot roulette gambling lottery viagra pills pharmacy porn xxx escort payday loans replica cheap win free adult spam ads track banner".split()
ALLOWED = (
    "news library school garden recipes travel history science museum weather health sport music film books art city park market "
    "house water paper table light stone river mountain forest theater letter winter summer mother father brother number nation "
    "ministry society journal archive reader writer teacher station airport hotel kitchen nachrichten schule garten reise geschichte "
    "wissenschaft gesundheit maison ville histoire cuisine voyage noticias escuela cocina viaje historia reading cooking morning "
    "building training thread other there these"
).split()
# The commonest English letter pairs; two of them in a row look like most names and are not blocked.
PAIRS = "th he in er an re on at en nd ti es or te".split()
#: Frames around the words: both kinds stand in the same ones.
FRAMES = ["{}.example.com", "www.{}.example.org", "{}-online.example.net/index", "m.{}.example.com/en/1", "blog.{}.example.org/{}/2"]


def labelled(spark: SparkSession) -> DataFrame:
    """(address, label): the small labelled table; label 1 is blocked."""
    words = F.array(
        *[F.struct(F.lit(w).alias("word"), F.lit(1.0).alias("label")) for w in BLOCKED],
        *[F.struct(F.lit(w).alias("word"), F.lit(0.0).alias("label")) for w in ALLOWED],
    )
    rows = spark.range(1).select(F.explode(words).alias("w")).select("w.*", F.explode(F.array(*map(F.lit, FRAMES))).alias("frame"))
    pairs = F.array(*map(F.lit, PAIRS))
    names = spark.range(1).select(F.posexplode(pairs).alias("i", "a")).select("i", "a", F.posexplode(pairs).alias("j", "b"))
    frame = F.get(F.array(*map(F.lit, FRAMES)), F.pmod(F.col("i") + F.col("j"), F.lit(len(FRAMES))))
    rows = rows.unionByName(names.select(F.concat("a", "b").alias("word"), F.lit(0.0).alias("label"), frame.alias("frame")))
    return rows.select(F.replace("frame", F.lit("{}"), F.col("word")).alias("address"), "label")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first ``://`` and the path behind it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def slots(address: Column) -> Column:
    """The distinct hash slots of the trigrams and 4-grams of an address, marked at both ends."""
    marked = F.concat(F.lit("^"), address, F.lit("$"))

    def hashed(i: Column) -> Column:
        a, b, c, d = (F.ascii(F.substr(marked, i + k, F.lit(1))).cast("long") for k in range(4))  # code points: products need longs
        three = a * 7919 + b * 331 + c * 17
        return F.array(*[F.pmod(x, F.lit(SLOTS)).cast("int") for x in (three, three + d * 5003 + 1009)])

    begins = F.sequence(F.lit(1), F.greatest(F.length(marked) - 2, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(begins, hashed)))


def train(examples: DataFrame, address_col: str = "address", label_col: str = "label") -> DataFrame:
    """One row (weights array<double>, bias double).

    Each step adds to a weight the mean residual of the rows that have its slot, less a
    share of the weight itself.
    """
    clean = examples.where(F.col(address_col).isNotNull() & F.col(label_col).isNotNull())
    rows = clean.select(F.col(label_col).cast("double").alias("y"), slots(F.col(address_col)).alias("x"))
    # Sorted, so that the result does not depend on the order of the rows.
    table = rows.agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("rows"))
    numbered = table.select(F.transform("rows", lambda r, i: F.struct(r["x"].alias("x"), r["y"].alias("y"), i.alias("i"))).alias("rows"))
    postings = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)),
        lambda s: F.transform(F.filter("rows", lambda r: F.array_contains(r["x"], s)), lambda r: r["i"]),
    )
    ready = numbered.select("rows", postings.alias("posted"))

    def step(state: Column, _: Column) -> Column:
        def margin(r: Column) -> Column:
            return F.aggregate(r["x"], state["bias"], lambda m, s: m + F.get(state["weights"], s))

        residuals = F.transform("rows", lambda r: r["y"] - 1 / (1 + F.exp(-margin(r))))

        def moved(g: Column) -> Column:
            def slot(w: Column, s: Column) -> Column:
                own = F.get(F.col("posted"), s)
                mean = F.aggregate(own, F.lit(0.0), lambda a, i: a + F.get(g, i)) / F.greatest(F.size(own), F.lit(1))
                return w + RATE * (mean - SHRINK * w)

            bias = state["bias"] + RATE * F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(g), F.lit(1))
            return F.struct(F.transform(state["weights"], slot).alias("weights"), bias.alias("bias"))

        return F.get(F.transform(F.array(residuals), moved), F.lit(0))

    start = F.struct(F.array_repeat(F.lit(0.0), SLOTS).alias("weights"), F.lit(0.0).alias("bias"))
    return ready.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("m")).select("m.*")


def probability(address: Column, model: Column) -> Column:
    """The probability that an address is to be blocked; ``model``: struct of weights and bias."""
    total = F.aggregate(slots(address), model["bias"], lambda m, s: m + F.get(model["weights"], s))
    return 1 / (1 + F.exp(-total))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule is a verdict and ``host/path``: it fits its host and all subdomains where the
    path starts with its own. Of equal lengths the first in the alphabet wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, probability, verdict): one row per row of ``pages``."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("model", model.select(F.struct("weights", "bias").alias("m")).scalar())
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    p = probability(F.concat("host", "path"), F.col("model"))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), p.alias("probability"),
        F.coalesce(verdict, F.when(p >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
