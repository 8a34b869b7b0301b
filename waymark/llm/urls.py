"""URL filters: character language models of accepted and rejected URLs.

Rules decide some URLs outright. Two smoothed Markov models of variable order,
one of the URLs that rules accept and one of those they reject, judge the
others: a URL passes if its log-likelihood under the first less that under the
second, per character, reaches a cutoff. The cutoff is the one with the fewest
errors, both classes weighing the same, on decided URLs held out of the models.

* A model predicts each character from the `order` characters before it, or
  from as many of them as it has seen: Witten-Bell smoothing mixes every order
  with the one below, down to all code points alike.
* URLs are counted once each, however many pages carry them, so that no host
  or address can outweigh the others by being crawled often. Nothing is
  sampled or capped: the models grow with the input and are never broadcast.
* The model of order k is a table of the distinct (k+1)-character strings,
  joined with that of order k-1 on the string less its first character; a
  string has no more such extensions than there are characters, so these joins
  have no hot keys.
* To score, each string of each URL meets its table. Strings that make up more
  than one in `HEAD` of all places, of which there can't be more than `HEAD`,
  are broadcast; the others are joined by shuffle.

Log-likelihoods are added in whole millionths, so sums do not depend on their
order. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.shared import materialize, only

ORDER = 5
HEAD = 20_000
CODE_POINTS = 0x110000
UNIT = 1_000_000  # of a nat, in which log-likelihoods are added
STEPS, REACH = 1_000, 5_000  # cutoffs: steps per nat and character, and the furthest one on either side
START, END = "\x02", "\x03"
HELD_OUT = "012"  # first hex digits of the md5 of the held-out URLs

# The rules (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, A-Z
    lower-cased; empty for NULL or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?` or `#`; empty for NULL or without `://`."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def shown(url: Column) -> Column:
    """The text the models read: the URL without its scheme, host in lower
    case; a URL without `://` as it is, NULL as empty."""
    rest = F.regexp_extract(url, r"(?s)://[^/?#]*(.*)", 1)
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.concat(host(url), rest)).otherwise(url), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(chars, verdict, rule) of the longest rule (host and path taken
    together) that fits, NULL if none does. A rule fits its host and all
    subdomains of it where the path starts with the rule's. Of equally long
    rules a block wins, then the later in byte order."""
    fits = [
        F.when(
            ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start)),
            F.struct(
                F.lit(len(name) + len(start)).alias("chars"),
                F.lit(verdict).alias("verdict"),
                F.lit(name + start).alias("rule"),
            ),
        )
        for name, start, verdict in rules
    ]
    nothing = F.lit(None).cast("struct<chars:int,verdict:string,rule:string>")
    return F.array_max(F.array(nothing, *fits))


def _strings(text: Column, order: int) -> Column:
    """For every character of the text and its end: it and the `order` before it."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    padded = F.concat(F.array_repeat(F.lit(START), order), chars, F.array(F.lit(END)))

    def strings(all_chars: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(all_chars) - order)
        return F.transform(places, lambda at: F.array_join(F.slice(all_chars, at, order + 1), ""))

    # As an element of a list the characters are worked out once per text, not once per place.
    return F.transform(F.array(padded), strings)[0]


def count_strings(texts: DataFrame, order: int) -> DataFrame:
    """string, total, a, r: how often each string of order + 1 characters
    stands in all texts, and in the accepted and the rejected ones not held
    out. `texts`: text, verdict, held."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    learnt = texts.select(
        F.explode(_strings(F.col("text"), order)).alias("string"),
        F.when((F.col("verdict") == "allow") & ~F.col("held"), one).otherwise(none).alias("a"),
        F.when((F.col("verdict") == "block") & ~F.col("held"), one).otherwise(none).alias("r"),
    )
    return learnt.groupBy("string").agg(F.count("*").alias("total"), F.sum("a").alias("a"), F.sum("r").alias("r"))


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """string, total, ratio of every counted string: the logarithm of its last
    character's probability after the others under the accepted model less
    that under the rejected one, in millionths."""
    below = None
    for k in range(order + 1):
        level = counts.groupBy(F.substring("string", order - k + 1, k + 1).alias("s")).agg(
            F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("total").alias("total")
        )
        level = level.withColumn("context", F.substring("s", 1, k))
        seen = level.groupBy(F.col("context").alias("c")).agg(
            F.sum("a").alias("all_a"),
            F.count_if(F.col("a") > 0).alias("kinds_a"),
            F.sum("r").alias("all_r"),
            F.count_if(F.col("r") > 0).alias("kinds_r"),
        )
        level = level.join(seen, F.col("context") == F.col("c"))
        if below is None:
            under = {side: F.lit(1.0 / CODE_POINTS) for side in "ar"}
        else:
            level = level.join(below, F.substring("s", 2, k) == F.col("shorter"))
            under = {side: F.col(f"below_{side}") for side in "ar"}
        mixed = {
            side: F.when(
                F.col(f"all_{side}") > 0,
                (F.col(side) + F.col(f"kinds_{side}") * under[side]) / (F.col(f"all_{side}") + F.col(f"kinds_{side}")),
            ).otherwise(under[side])
            for side in "ar"
        }
        level = level.select("s", "total", mixed["a"].alias("p_a"), mixed["r"].alias("p_r"))
        below = level.select(
            F.col("s").alias("shorter"), F.col("p_a").alias("below_a"), F.col("p_r").alias("below_r")
        )
    ratio = F.round((F.log("p_a") - F.log("p_r")) * UNIT).cast("long")
    return level.select(F.col("s").alias("string"), "total", ratio.alias("ratio"))


def score(texts: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """uid, sum: the log ratios of all places of each text. `texts`: uid, text."""
    whole = ratios.select(F.sum("total")).scalar()
    often = F.col("total") * HEAD >= whole
    head = ratios.where(often).select(F.col("string").alias("frequent"), F.col("ratio").alias("known"))
    rest = ratios.where(~often).select("string", "ratio")
    places = texts.select("uid", F.explode(_strings(F.col("text"), order)).alias("string"))
    met = places.join(F.broadcast(head), F.col("string") == F.col("frequent"), "left")
    known = met.where("known is not null").select("uid", F.col("known").alias("ratio"))
    looked_up = met.where("known is null").select("uid", "string").join(rest, "string").select("uid", "ratio")
    return known.union(looked_up).groupBy("uid").agg(F.sum("ratio").alias("sum"))


def step_of(value: Column) -> Column:
    """The cutoff step a score per character lies in."""
    return F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.floor(value * STEPS))).cast("int")


def cutoff(scored: DataFrame) -> DataFrame:
    """One row, `cutoff`: the step from which on held-out decided URLs are
    taken for accepted with the least sum of both error rates; of equal ones
    the nearest to 0, then the higher. 0 if either class has none held out,
    and the lowest step, at which all pass, if either has none to learn from.
    `scored`: verdict, held, step."""
    steps = scored.where("held and verdict is not null").groupBy("step").agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r")
    )
    learnt = scored.where("not held").select(
        F.count_if(F.col("verdict") == "allow") * F.count_if(F.col("verdict") == "block")
    )
    # In one task, but of a row per step at most.
    upto = Window.orderBy("step")
    errors = steps.withColumns(
        {
            "below": F.sum("a").over(upto) - F.col("a"),
            "above": F.sum("r").over(Window.partitionBy()) - F.sum("r").over(upto) + F.col("r"),
            "all_a": F.sum("a").over(Window.partitionBy()),
            "all_r": F.sum("r").over(Window.partitionBy()),
        }
    ).where("all_a > 0 and all_r > 0")
    rate = F.col("below") / F.col("all_a") + F.col("above") / F.col("all_r")
    best = errors.agg(F.min(F.struct(rate.alias("errors"), F.abs("step").alias("away"), (-F.col("step")).alias("low"))).alias("best"))
    chosen = F.coalesce(-F.col("best.low"), F.lit(0))
    return best.select(F.when(learnt.scalar() > 0, chosen).otherwise(F.lit(-REACH)).alias("cutoff"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    order: int = ORDER,
    id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score: one row per row of `pages`.

    `verdict` is that of the longest rule that fits (`rule`, NULL if none), or
    else of the models: allow or block. `score` is the log ratio per character
    in nats, also for URLs that a rule decides. NULL and empty URLs have an
    empty host and path and are judged as an empty text. Repeated rows are
    judged alike, a row without an id too. Without decided URLs of both kinds
    nothing can be learnt and all undecided URLs pass. An empty table gives no
    rows; other columns are ignored.
    """
    rows = only(pages, page_id=id, url=url)
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "text": shown(F.col("url"))})
    rows = rows.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    texts = rows.groupBy("text").agg(F.max("match.verdict").alias("verdict"))
    texts = texts.withColumns(
        {
            "held": F.substring(F.md5("text"), 1, 1).isin(*HELD_OUT),
            "places": F.length("text") + 1,
            "uid": F.monotonically_increasing_id(),
        }
    )
    texts = materialize(texts, "url-texts")
    counts = materialize(count_strings(texts, order), "url-strings")
    ratios = materialize(log_ratios(counts, order), "url-ratios")
    value = F.col("sum") / F.col("places") / UNIT
    scored = texts.join(score(texts, ratios, order), "uid")
    scored = materialize(
        scored.select("text", "verdict", "held", value.alias("score"), step_of(value).alias("step")), "url-scores"
    )
    passes = F.col("step") >= cutoff(scored).scalar()
    judged = scored.select(
        F.col("text").alias("judged_text"), "score", F.when(passes, "allow").otherwise("block").alias("judgement")
    )
    return rows.join(judged, F.col("text") == F.col("judged_text")).select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("match.rule").alias("rule"),
        F.coalesce("match.verdict", "judgement").alias("verdict"),
        "score",
    )
