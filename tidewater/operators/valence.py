"""Valence sentiment (X10): a lexicon with negation, intensifiers, contrast and exclamation.

A word of the lexicon has a valence between -4 and 4. Intensifiers among the three words
before it add to its strength, or take from it, the less the farther they are; every negation among these turns
it round and weakens it. Words before the first "but" of the text count half, those after it one and a half.
Up to four exclamation marks, or question marks from the second one on, strengthen a sum that is not 0. The compound score s / sqrt(s^2 + 15) lies between
-1 and 1.

Each token carries the three before it. The fixed lexicon is broadcast, and only sums of a document's tokens are shuffled; nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.lexicons import SENTIMENT_SEED
from tidewater.operators.text import word_tokens

# Fixed values of the published method (Hutto and Gilbert 2014).
BOOST, NEGATE, ALPHA = 0.293, -0.74, 15.0
DISTANCE = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAIM, MOST_EXCLAIM, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
# Own seed lists; pass fuller ones for real use.
STRONGER = "absolutely amazingly completely deeply entirely especially exceptionally extremely fully greatly highly hugely incredibly more most particularly really remarkably so thoroughly totally truly unusually utterly very".split()
WEAKER = "almost barely hardly less little marginally occasionally partly scarcely slightly somewhat".split()
NEGATIONS = "aint aren't arent can't cannot cant couldn't couldnt didn't didnt doesn't doesnt don't dont hadn't hasn't haven't isn't isnt neither never no nobody none nope nor not nothing nowhere shouldn't wasn't wasnt weren't without won't wont wouldn't wouldnt".split()


def valence_table(spark, lexicon: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(token, valence): polarities from -1 to 1 as valences from -4 to 4."""
    return spark.createDataFrame([(k, 4.0 * float(p)) for k, (p, _) in sorted((lexicon or SENTIMENT_SEED).items())], "token string, valence double")


def _marks(text: Column) -> Column:
    """What exclamation and question marks add."""
    exclaim = F.least(F.regexp_count(text, F.lit("!")), F.lit(MOST_EXCLAIM)) * EXCLAIM
    asked = F.regexp_count(text, F.lit(r"\?"))
    return exclaim + F.when(asked > 3, MANY_QUESTIONS).when(asked > 1, asked * QUESTION).otherwise(0.0)


def valence_sentiment(df: DataFrame, lexicon: DataFrame | None = None, id_col: str = "doc_id", threshold: float = 0.05,
                      stronger: Sequence[str] = STRONGER, weaker: Sequence[str] = WEAKER, negations: Sequence[str] = NEGATIONS) -> DataFrame:
    """(id, compound, matched, label) of every row with a text; one without a word of the lexicon is neutral with 0. Ids are distinct."""
    lex = lexicon if lexicon is not None else F.broadcast(valence_table(df.sparkSession))  # of fixed size: no token is shuffled
    texts = df.where(F.col("text").isNotNull()).select(F.col(id_col).alias("id"), F.col("text"), word_tokens(F.lower("text")).alias("w"))
    texts = texts.withColumn("but", F.array_position("w", "but"))
    each = F.transform("w", lambda t, i: F.struct(t.alias("token"), i.alias("pos"), F.slice(F.col("w"), F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))).alias("before")))
    spots = texts.select("id", "but", F.explode(each).alias("s")).select("id", "but", "s.*").join(lex, "token")
    back = [F.try_element_at("before", F.lit(-k)) for k in (1, 2, 3)]
    push = sum((F.when(b.isin(list(stronger)), BOOST * d).when(b.isin(list(weaker)), -BOOST * d).otherwise(0.0) for b, d in zip(back, DISTANCE)), F.lit(0.0))
    turned = sum((F.when(b.isin(list(negations)), 1).otherwise(0) for b in back), F.lit(0))
    value = (F.col("valence") + F.signum("valence") * push) * F.when(turned == 0, 1.0).when(turned == 1, NEGATE).when(turned == 2, NEGATE ** 2).otherwise(NEGATE ** 3)
    place = F.col("pos") + 1
    weight = F.when((F.col("but") == 0) | (place == F.col("but")), 1.0).when(place < F.col("but"), BEFORE_BUT).otherwise(AFTER_BUT)
    sums = spots.groupBy("id").agg(F.sum(value * weight).alias("s"), F.count(F.lit(1)).alias("matched"))
    both = texts.select("id", _marks(F.col("text")).alias("marks")).join(sums, "id", "left").na.fill(0.0, ["s"]).na.fill(0, ["matched"])
    total = F.col("s") + F.signum("s") * F.col("marks")
    out = both.select(F.col("id").alias(id_col), (total / F.sqrt(total * total + ALPHA)).alias("compound"), F.col("matched").cast("long").alias("matched"))
    c = F.col("compound")
    return out.withColumn("label", F.when(c >= threshold, "positive").when(c <= -threshold, "negative").otherwise("neutral"))
