"""Five measures of answers, as plans over tables.

They are LEXICAL STAND-INS for measures that a language model would judge: a sentence is borne out by a text if the text has
enough of the sentence's distinct words. Sentences meet the sentences of contexts in a join on question and word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import query_tokens

#: Share of a sentence's distinct words that must be there.
BORNE_OUT = 0.5
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")


def sentences(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, sentence, tokens): the sentences of a text, numbered, with their distinct tokens; sentences without tokens are none.
    They end at white space after `.`, `!` or `?`."""
    each = rows.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")).alias("sentence", "s"))
    return each.select(*keys, "sentence", F.array_distinct(query_tokens(F.col("s"))).alias("tokens")).where(F.size("tokens") > 0)


def attributed(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, sentence, size, shared, context, at) of claims (qid, sentence, tokens): the sentence (at) of the context that has most of the claim's
    tokens, the first of several; shared is 0 where none has any. evidence: (qid, context, sentence, tokens)."""
    asked = claims.select("qid", "sentence", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    held = evidence.select("qid", "context", F.col("sentence").alias("at"), F.explode("tokens").alias("token"))
    shared = asked.join(held, ["qid", "token"]).groupBy("qid", "sentence", "context", "at").agg(F.count("*").alias("shared"))
    best = shared.groupBy("qid", "sentence").agg(F.max(F.struct("shared", (-F.col("context")).alias("context"), (-F.col("at")).alias("at"))).alias("best"))
    out = claims.select("qid", "sentence", F.size("tokens").alias("size")).join(best, ["qid", "sentence"], "left")
    return out.select("qid", "sentence", "size", F.coalesce("best.shared", F.lit(0)).alias("shared"), (-F.col("best.context")).alias("context"), (-F.col("best.at")).alias("at"))


def average_precision(relevant: DataFrame) -> DataFrame:
    """(qid, value) from (qid, rank, relevant): the mean, over the relevant ranks, of the share of relevant ones up to there; 0 without any."""
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("relevant").cast("int")
    rows = relevant.withColumn("precision", F.sum(hit).over(upto) / F.count("*").over(upto))
    return rows.groupBy("qid").agg(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("precision"))), F.lit(0.0)).alias("value"))


def _shared_words(rows: DataFrame, a: str, b: str) -> tuple[Column, Column, Column]:
    words = [F.array_distinct(query_tokens(F.coalesce(x, F.lit("")))) for x in (a, b)]
    return F.size(F.array_intersect(*words)), F.size(words[0]), F.size(words[1])


def measured(samples: DataFrame) -> DataFrame:
    """(qid, metric, score) of samples (qid, question, answer, reference, contexts): METRICS, each between 0 and 1, null where there is
    nothing to measure.

    faithfulness: the share of the answer's sentences that a sentence of a context bears out; context_recall: that of the reference's;
    context_precision: average precision of the contexts by rank, relevant being those that bear out a sentence of the reference;
    answer_relevancy: the share of the question's distinct words that the answer has; answer_correctness: the F1 of the distinct words of
    answer and reference. Nulls are empty texts; qid is distinct.
    """
    contexts = samples.select("qid", F.posexplode("contexts").alias("context", "text"))
    evidence = sentences(contexts, "text", "qid", "context")
    good = F.col("shared") >= BORNE_OUT * F.col("size")
    found = []
    for metric, column in (("faithfulness", "answer"), ("context_recall", "reference")):
        borne = attributed(sentences(samples, column, "qid"), evidence).groupBy("qid").agg(F.avg(good.cast("double")).alias("value"))
        found.append(borne.withColumn("metric", F.lit(metric)))
    bears = attributed(sentences(samples, "reference", "qid"), evidence).where(good).select("qid", "context").distinct().withColumn("hit", F.lit(True))
    ranked = contexts.select("qid", "context").join(bears, ["qid", "context"], "left").select("qid", F.col("context").alias("rank"), F.coalesce("hit", F.lit(False)).alias("relevant"))
    found.append(average_precision(ranked).withColumn("metric", F.lit("context_precision")))
    both, n, _ = _shared_words(samples, "question", "answer")
    found.append(samples.select("qid", F.when(n > 0, both / n).alias("value"), F.lit("answer_relevancy").alias("metric")))
    both, n, m = _shared_words(samples, "answer", "reference")
    found.append(samples.select("qid", F.when(n + m > 0, 2 * both / (n + m)).alias("value"), F.lit("answer_correctness").alias("metric")))
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    pairs = samples.select("qid", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    return pairs.join(rows, ["qid", "metric"], "left").select("qid", "metric", F.round("value", 6).alias("score"))
