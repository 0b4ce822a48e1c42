"""URL filters: rules by host and path, and naive Bayes over segmented host words.

Hosts and paths are cut into names (runs of letters), and each distinct name into words by Viterbi under a unigram model, so that
concatenated names ("freebetsonline") give their words. The model counts on how many hosts of the table a word stands. It is
never gathered: a name's substrings are looked up in it by a join, and a task sees only those that are words.

A multinomial naive Bayes model scores the words. It counts seed words, and the words of urls that the rules judge, each
once for a host and verdict, without the words that the rules name themselves. Counts, weights and scores are tables, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import Scratch, small

# Seed words of hosts and paths to block and to allow; parameters of judge_urls().
BLOCK = """casino win bet bets betting free gamble gambling poker slots slot roulette jackpot lottery bingo prize winner bonus spin cheap pills pill pharma viagra cialis
meds drugs adult porn x xxx sex sexy nude cam cams escort dating hot girls ads ad adserver adware advert banner banners track tracker tracking click clicks popup spam
farm scam phish phishing malware virus hack hacks crack cracks keygen warez torrent pirate loan loans payday credit debt fast cash money earn rich crypto replica"""
ALLOW = """news wiki docs doc help support shop store about contact home article articles post posts story
edu gov library school university museum research science health sports weather travel food recipes music film books history art photo photos video map maps forum
community group city town local world daily times journal press review guide learn course code data open source project tech cloud api static media
images public archive category topic tag search profile feed rss"""
# Words of either kind of site.
NEUTRAL = "en fr de es it www m mobile blog web site page pages index html htm php asp org com net info example online user users home"
#: With it, one word to block is not enough; each seed word counts as SEEN sightings.
PRIOR_BLOCK, SEEN = 0.15, 4
#: A word of the table itself is on so many hosts at least: one host's name is no evidence of a word.
LEAST_HOSTS = 2
UNKNOWN = 1e-9
LONGEST = 24
#: Runs of letters.
NAMES = r"\p{L}+"


def viterbi(name: str, known: list[tuple[int, int, float]]) -> list[str]:
    """The likeliest split of a name, given its known words (begin, length, cost); what is unknown costs more by the letter."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for begin, size, cost in known:
        ending.setdefault(begin + size, []).append((begin, cost))
    best: list[tuple[float, int]] = [(0.0, 0)]
    lowest = (0.0, 0)  # of the ways to where an unknown word may begin, less its place
    for end in range(1, len(name) + 1):
        way = min([(lowest[0] + unknown(end), lowest[1]), *((best[begin][0] + cost, begin) for begin, cost in ending.get(end, ()))])
        best.append(way)
        lowest = min(lowest, (way[0] - end, end))
    out, at = [], len(name)
    while at:
        out.append(name[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def unknown(n: int) -> float:
    return n - log(UNKNOWN)


def seed_counts(block: str, allow: str) -> dict[str, tuple[int, int]]:
    """How often each seed word is seen in what is to block and to allow."""
    out: dict[str, tuple[int, int]] = {}
    for text, b, a in ((block, SEEN, 0), (allow, 0, SEEN), (NEUTRAL, SEEN, SEEN)):
        for w in text.split():
            had = out.get(w, (0, 0))
            out[w] = had[0] + b, had[1] + a
    return out


def pieces(names: DataFrame, words: DataFrame) -> DataFrame:
    """Each name with the list of its substrings that are words: (begin, size, and the other columns of words)."""
    own = [c for c in words.columns if c != "word"]
    at = names.select("name", F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("begin"))
    at = at.select("name", "begin", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("begin")))).alias("size"))
    at = at.withColumn("word", F.substring("name", F.col("begin") + 1, F.col("size")))
    found = at.join(small(words), "word").groupBy("name").agg(F.collect_list(F.struct("begin", "size", *own)).alias("known"))
    return names.join(found, "name", "left")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [viterbi(name, [(k["begin"], k["size"], k["cost"]) for k in known or ()]) for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])


def _whole(own: float):
    """Of words (name, n, known), those that are not made of seed words only, or of seed words and longer words that are each on more hosts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for name, n, known in zip(*(batch.column(c).to_pylist() for c in ("name", "n", "known")), strict=True):
                known = [k for k in known or () if k["size"] < len(name)]
                seeds = {name[k["begin"] : k["begin"] + k["size"]] for k in known if k["seed"] and k["size"] > 1}
                common = {name[k["begin"] : k["begin"] + k["size"]] for k in known if k["size"] > 2 and k["hosts"] > n}
                made = set(viterbi(name, [(k["begin"], k["size"], own) for k in known if k["seed"]])) <= seeds
                keep.append(not made and not set(viterbi(name, [(k["begin"], k["size"], k["cost"]) for k in known])) <= seeds | common)
            told = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([told.column("name"), told.column("n")], names=["word", "n"])

    return f


def unigrams(words: DataFrame, seeds: list[str], scratch: Scratch) -> DataFrame:
    """Rows (word, cost) of the model from rows (word, n): hosts that hold each word.

    A word on fewer than LEAST_HOSTS hosts is none: one host's name is no evidence of a word. A word is not taken as one, so that it is
    split, if it is made of seed words only, or of seed words and longer words that are each on more hosts than itself. Seed words count
    as often as the commonest tenth of the others.
    """
    spark = words.sparkSession
    told = spark.createDataFrame([(w,) for w in seeds], "word string")
    words = scratch.keep(words.where((F.col("n") >= LEAST_HOSTS) & (F.length("word") > 1)), "words")
    common = int(words.agg(F.percentile("n", F.lit(0.9))).first()[0] or 1)
    both = words.join(F.broadcast(told.withColumn("seed", F.lit(True))), "word", "full")
    hosts = F.coalesce("n", F.lit(0).cast("long"))
    both = both.select("word", hosts.alias("hosts"), F.coalesce("seed", F.lit(False)).alias("seed"))
    weight = F.col("hosts") + F.when(F.col("seed"), common).otherwise(0)
    total = both.agg(F.sum(weight)).first()[0]
    both = scratch.keep(both.withColumn("cost", -F.log(weight / total)), "both")
    names = both.where("not seed").select(F.col("word").alias("name"), F.col("hosts").alias("n"))
    whole = pieces(names, both).select("name", "n", "known").mapInArrow(_whole(log(len(seeds))), "word string, n long")
    seen = both.where("seed").select("word", (F.col("hosts") + common).alias("n"))
    out = scratch.keep(whole.unionByName(seen), "unigrams")
    total = out.agg(F.sum("n")).first()[0]
    return out.select("word", (-F.log(F.col("n") / total)).alias("cost"))


def segmented(names: DataFrame, model: DataFrame) -> DataFrame:
    """Rows (name, words) of distinct names, by a model (word, cost)."""
    return pieces(names, model).select("name", "known").mapInArrow(_split, "name string, words array<string>")


def bayes(examples: DataFrame, seeds: dict[str, tuple[int, int]]) -> DataFrame:
    """Weights (word, weight) of multinomial naive Bayes with add-one smoothing from rows (word, b, a) of counts and the seeds' own; other words say nothing."""
    spark = examples.sparkSession
    counts = examples.unionByName(spark.createDataFrame([(w, b, a) for w, (b, a) in seeds.items()], "word string, b long, a long")).groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    n = counts.agg(F.count("*").alias("words"), F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    return counts.select("word", (F.log((F.col("b") + 1) / (n["b"] + n["words"])) - F.log((F.col("a") + 1) / (n["a"] + n["words"]))).alias("weight"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path, both empty without `://` or url."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path in one string) that fits, and its verdict; both null if none fits."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, told in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last, longest, is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(told)).otherwise(verdict)
    return which, verdict


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", block: str = BLOCK, allow: str = ALLOW, prior: float = PRIOR_BLOCK) -> DataFrame:
    """Returns for each row: id, host, path, rule (null if none fits) and verdict (allow or block).

    Only the url column is read. Null urls and urls without `://` have an empty host and path, and the
    verdict of no words. Names are split whole, however long. Even odds allow. Repeated rows are judged alike; an empty
    table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    which, ruled = rule_for(F.col("host"), F.col("path"), rules)
    out = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("rule", which).withColumn("ruled", ruled)
    urls = scratch.keep(out.select("host", "path", "ruled").distinct(), "urls")
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(NAMES), F.lit(0))
    named = urls.select("host", "path", "ruled", F.explode(F.concat(runs(F.col("host")), runs(F.col("path")))).alias("name"))
    by_host = scratch.keep(named.select("host", "ruled", "name").distinct(), "names")

    seeds = seed_counts(block, allow)
    words = by_host.select("host", "name").distinct().groupBy(F.col("name").alias("word")).agg(F.count("*").alias("n"))
    model = unigrams(words, list(seeds), scratch)
    split = scratch.keep(segmented(by_host.select("name").distinct(), model), "split")

    told = {w for rule, _ in rules for w in pieces_of(rule)}
    examples = by_host.where("ruled is not null").join(small(split), "name").select("host", "ruled", F.explode("words").alias("word")).distinct()
    examples = examples.where(~F.col("word").isin(*told)) if told else examples
    weights = scratch.keep(bayes(examples.groupBy("word").agg(F.count_if(F.col("ruled") == "block").alias("b"), F.count_if(F.col("ruled") == "allow").alias("a")), seeds), "weights")
    worth = split.select("name", F.explode("words").alias("word")).join(small(weights), "word").groupBy("name").agg(F.sum("weight").alias("worth"))
    worth = scratch.keep(worth, "worth")
    odds = named.where("ruled is null").join(small(worth), "name").groupBy("host", "path").agg(F.sum("worth").alias("odds"))
    # sums of one url in another order may differ in the last digits
    over = F.round(F.col("odds") + log(prior / (1 - prior)), 9) > 0
    usual, other = ("block", "allow") if prior > 0.5 else ("allow", "block")  # of urls without a word that says something
    unusual = scratch.keep(odds.where(over == F.lit(other == "block")).select("host", "path", F.lit(other).alias("judged")), "unusual")
    judged = out.join(small(unusual), ["host", "path"], "left")
    return judged.select(F.col(id_col), "host", "path", "rule", F.coalesce("ruled", "judged", F.lit(usual)).alias("verdict"))


def pieces_of(rule: str) -> list[str]:
    """The runs of letters of a rule."""
    return "".join(c if c.isalpha() else " " for c in rule.lower()).split()
