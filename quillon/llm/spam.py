"""Keyword-stuffed and link-list pages (problem 10): bagged decision trees from weak labels, smoothed by host.

1. Features of content and links: how much of the text stands in sentences, function words, the weight of the most frequent words and of
   repeated word pairs, links, hash tags, prices, separators, code and log marks.
2. Weak labels: strict rules on a few features mark plain cases of either class; all other pages have no label.
3. Bagging: trees over bootstrap samples of the labelled pages, every feature open to every split. They are trained on at most
   ``TRAINING_ROWS`` pages, drawn by hash from all labelled ones, half of them of each class as far as there are as many.
4. Host smoothing: a page's log odds move by a part of what its host's rate of spam differs from the mean rate. A host
   is the repository of a page, or its source if it has none; rates are shrunk towards the mean.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.frames import frame
from quillon.session import cut, spread
from quillon.sources.tables import table

TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 15, 6, 17
#: Weight of the host's rate against the page's own score, and pages' worth of the mean rate that every host starts with.
HOST_WEIGHT, HOST_PRIOR = 0.2, 50.0

FEATURES = ["words", "prose", "sentences", "function_words", "top_word", "top_words", "repeated_pairs", "links", "link_lines", "tags", "prices", "separators", "code", "logs", "keyword_sentences"]

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """a after all an and are as at be because been before but by can each for from had has have if in into is it its more no not of on one only or our out
    over so than that the their then there they this to unless until up was we were when where which while who will with without you your
    aber als am an auch auf aus bei bis das dass dem den der des die diese dieser durch ein eine einem einen einer eines er es für hat ihr im in ist jede jeden kann
    mit nach nicht noch nur ob oder ohne seit sich sie sind sobald über um und unter von vor während weil wenn werden wie wird zu zum zur
    au aux avant avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ou où par parce pas pour qu que
    qui sa sans se ses si son sont sur un une vers vous
    al ante como con contra cuando de del desde donde dos el ella en entre es esta este la las le lo los más mi no nos o para pero por porque que se si sin
    sobre su sus también tras un una y ya""".split()
)

_WORD = re.compile(r"[^\W_]+")
_LINK = re.compile(r"https?://[^\s)\]>\"']+")
_ANCHOR = re.compile(r"<a\b[^>]*>.*?</a>|!?\[[^\]\n]*\]\(\s*https?://[^)\s]*\)", re.I | re.S)
_BREAK = re.compile(r"(?<=[.!?])\s|\n")
_PRICE = re.compile(r"[A-Z]{2,5}[-#]?\d{3,}|[$€£]\s?\d|\d[.,]\d\d\b")
_LOG = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d(?::\d\d)?\]?\s)")
_CODE = re.compile(r"[{}]|\w\(|[=!<>]=| [-+|&]?= |[;,:(\[]\s*$|^\s*(?:import|from|return|def|class|fn|let|use|package|func|const|var|pub|if|for|while|else|try|async|end|[)\]}@]|//|#!?\[|\*|\.)")
_TAG = re.compile(r"(?<!\w)#\w")
_SEPARATOR = re.compile(r" [-|»•·>] ")


def page_features(text: str) -> list[float]:
    linked = "http" in text
    bare = _ANCHOR.sub(" ", text) if linked else text
    unlinked = _LINK.sub(" ", bare) if linked else text
    size = max(1, len(text))
    words = _WORD.findall((_LINK.sub(" ", text) if linked else text).lower())
    n = max(1, len(words))
    every = Counter(words)
    function = sum(every.pop(w) for w in FUNCTION_WORDS & every.keys())
    top = sorted(((c, w) for w, c in every.items() if len(w) > 2), reverse=True)[:8]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    rows = max(1, len(lines))
    sentences = [x for x in _BREAK.split(unlinked) if len(x) > 19 and x[-1] in ".!?"]
    said = [(x.count(" ") + 1, x.lower()) for x in sentences if x.count(" ") > 2]
    keyword = top[0][1] if top else "\n"
    return [
        float(len(words)),
        min(1.0, sum(map(len, sentences)) / size),
        min(1.0, sum(c for c, _ in said) / n),
        function / n,
        (top[0][0] if top else 0) / n,
        sum(c for c, _ in top) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
        (len(text) - len(_LINK.sub("", bare))) / size if linked else 0.0,
        sum("http" in x for x in lines) / rows if linked else 0.0,
        len(_TAG.findall(text)) / n if "#" in text else 0.0,
        len(_PRICE.findall(text)) / n,
        (text.count(", ") + text.count("; ") + text.count("\n") + len(_SEPARATOR.findall(text))) / n,
        sum(bool(_CODE.search(x)) for x in lines) / rows,
        sum(bool(_LOG.match(x)) for x in lines) / rows,
        sum(keyword in x for _, x in said) / max(1, len(said)),
    ]


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [page_features(t) for t in f["_text"]]
        yield frame({"_id": f["_id"], "_host": f["_host"]} | {c: [r[k] for r in rows] for k, c in enumerate(FEATURES)})


#: Plain cases of either class.
SPAM_RULE = """words >= 8 AND code < 0.5 AND logs < 0.2 AND (
    (prose < 0.3 AND function_words < 0.12 AND repeated_pairs > 0.3)
    OR (prose < 0.35 AND links > 0.45)
    OR (prose < 0.35 AND function_words < 0.2 AND (tags > 0.3 OR prices > 0.12))
    OR (sentences > 0.5 AND top_word > 0.18 AND repeated_pairs > 0.6 AND keyword_sentences > 0.85))"""
HAM_RULE = """(prose > 0.5 AND function_words > 0.15 AND top_word < 0.13 AND links < 0.4 AND repeated_pairs < 0.45)
    OR (code > 0.5 AND links < 0.3 AND tags < 0.2 AND repeated_pairs < 0.5) OR (logs > 0.3 AND links < 0.3) OR words < 6"""


def host_of(columns: list[str] | None) -> Column:
    """The first column that is not blank, under its name; empty without one."""
    named = [F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{c}:"), F.lower(F.trim(F.col(c))))) for c in columns or []]
    return F.coalesce(*named, F.lit(""))


def spam_scores(pages: DataFrame, key: str = "doc_id", text: str = "text", host: list[str] | None = None) -> DataFrame:
    """key and spam, the smoothed probability, of every row with a key; blank and null texts have 0.

    host: columns of which the first non-blank one names the host. Equal texts are scored alike up to their hosts; repeated rows
    stay. Without labelled pages of both classes the rules decide alone. Other columns are ignored.
    """
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), host_of(host).alias("_host"), F.coalesce(text, F.lit("")).alias("_text"))
    types = dict(rows.dtypes)["_id"]
    measured = cut(rows.mapInPandas(_measure, f"_id {types}, _host string, " + ", ".join(f"{c} double" for c in FEATURES)))
    labelled = measured.withColumn("label", F.when(F.expr(SPAM_RULE), 1.0).when(F.expr(HAM_RULE), 0.0))
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if counts.get(1.0) and counts.get(0.0):
        share = {c: min(1.0, TRAINING_ROWS / 2 / counts[c]) for c in (0.0, 1.0)}
        place = F.pmod(F.xxhash64("_id", *FEATURES), F.lit(1_000_000)) / 1_000_000
        drawn = labelled.where(F.col("label").isNotNull() & (place < F.when(F.col("label") == 1, share[1.0]).otherwise(share[0.0])))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", bootstrap=True, seed=SEED, featuresCol="features", labelCol="label", maxBins=64)
        model = forest.fit(assembler.transform(drawn.select("label", *FEATURES).coalesce(8)))
        scored = model.transform(assembler.transform(measured)).withColumn("_p", vector_to_array("probability")[1])
    else:
        scored = labelled.withColumn("_p", F.coalesce("label", F.lit(0.0)))
    p = F.least(F.greatest("_p", F.lit(0.001)), F.lit(0.999))
    scored = scored.select("_id", "_host", F.when(F.col("words") < 1, F.lit(0.001)).otherwise(p).alias("_p"))
    mean = scored.agg(F.avg("_p")).first()[0] or 0.001
    hosts = scored.where("_host <> ''").groupBy("_host").agg(((F.sum("_p") + HOST_PRIOR * mean) / (F.count(F.lit(1)) + HOST_PRIOR)).alias("_rate"))
    odds = lambda x: F.log(x / (1 - x))
    smooth = scored.join(hosts, "_host", "left").withColumn("_o", odds(F.col("_p")) + HOST_WEIGHT * (odds(F.coalesce("_rate", F.lit(mean))) - odds(F.lit(mean))))
    return smooth.select(F.col("_id").alias(key), (1 / (1 + F.exp(-F.col("_o")))).alias("spam"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", "repo", "source"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_scores(_pages(spark, folder), host=["repo", "source"]).where("spam > 0.5").select("doc_id").distinct()


def p10_host_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and spam pages by host."""
    pages = _pages(spark, folder)
    found = spam_scores(pages, host=["repo", "source"]).where("spam > 0.5").select("doc_id").withColumn("bad", F.lit(1))
    return pages.select("doc_id", host_of(["repo", "source"]).alias("host")).join(found, "doc_id", "left").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("spam_pages"))
