"""Drawing documents so that the sources have given shares of all tokens.

Hash thresholds: every text has a place between 0 and 2^60, a hash of it, and a
source's texts below a threshold are a fair sample of it. Where the threshold
of a quota lies is read off a histogram of tokens over the first bits of the
hash; the one bucket that the quota ends in is counted again by its next bits,
until it holds one text. A round costs one aggregation and sends BUCKETS rows a
source to the driver, however many texts there are.

The size of the mixture is the largest at which every source reaches its share
without a text being used too often. Whole passes over a source use all of its
texts, the threshold decides over the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.llm import tokens
from argentum.session import cut

#: Bits of the hash that a round counts by, bits of the hash; buckets of a round.
ROUND, BITS = 10, 60
BUCKETS = 1 << ROUND


def one_space(text: str) -> str:
    """A text with one space for each run of white space, so that line ends and spaces make no other text."""
    return " ".join(text.split())


def texts(documents: DataFrame, targets: DataFrame, path: str = tokens.TOKENIZER) -> DataFrame:
    """source, doc_id, tokens, place of each different text that has tokens and a source with a weight.

    A text that several documents hold is one text, that of the smallest
    doc_id; in several sources, it belongs to that document's alone.
    """
    wanted = targets.filter("target_weight > 0 and coalesce(max_repeats, 1) > 0").select("source").distinct()
    sized = tokens.sizes(documents.join(F.broadcast(wanted), "source", "left_semi"), path, one_space).filter("tokens > 0")
    first = sized.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d"))
    return first.select("d.source", "d.doc_id", "d.tokens", F.shiftrightunsigned(F.xxhash64("digest"), 64 - BITS).alias("place"))


def quotas(supply: dict[str, int], weights: dict[str, float], repeats: dict[str, int]) -> dict[str, float]:
    """Tokens to draw from each source. Sources without texts are left out; the others keep their proportions."""
    there = [s for s, w in weights.items() if w > 0 and supply.get(s, 0) > 0]
    size = min((supply[s] * repeats[s] / weights[s] for s in there), default=0.0)
    return {s: min(weights[s] * size, float(supply[s] * repeats[s])) for s in there}


def thresholds(known: DataFrame, rest: dict[str, float]) -> dict[str, int]:
    """The place below which the texts of each source hold about `rest` tokens, to within half a text."""
    done: dict[str, int] = {}
    # Of each open source the beginning of its bucket and the tokens still to be drawn from it.
    still = {s: (0, r) for s, r in rest.items()}
    for bits in range(BITS - ROUND, -1, -ROUND):
        if not still:
            break
        spark = known.sparkSession
        at = spark.createDataFrame([(s, low) for s, (low, _) in still.items()], "source string, low bigint")
        inside = known.join(F.broadcast(at), "source").filter((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + (BUCKETS << bits)))
        rows = inside.groupBy("source", F.shiftright(F.col("place") - F.col("low"), bits).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).collect()
        by: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: r["bucket"]):
            by.setdefault(r["source"], []).append(r)
        for s, (low, left) in list(still.items()):
            del still[s]
            done[s] = low + (BUCKETS << bits)
            for r in by.get(s, []):
                begin = low + (r["bucket"] << bits)
                if r["tokens"] <= left:
                    left -= r["tokens"]
                elif r["n"] > 1 and bits:
                    still[s] = (begin, left)
                    break
                else:
                    done[s] = r["last"] + 1 if r["tokens"] - left < left else begin
                    break
    return done


def draw(documents: DataFrame, targets: DataFrame, path: str = tokens.TOKENIZER) -> DataFrame:
    """source, doc_id, tokens, times of every text that is drawn.

    Null and empty texts have no tokens and aren't drawn, nor are documents
    without a source or with one that has no target. An absent max_repeats is
    1. Empty tables give no rows.
    """
    known = cut(texts(documents, targets, path), "texts")
    rows = targets.filter("source is not null").collect()  # one for each source
    weights = {r["source"]: float(r["target_weight"] or 0) for r in rows}
    repeats = {r["source"]: 1 if r["max_repeats"] is None else int(r["max_repeats"]) for r in rows}
    supply = {r["source"]: r["tokens"] for r in known.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    wanted = quotas(supply, weights, repeats)
    passes = {s: min(repeats[s], int(q // supply[s])) for s, q in wanted.items()}
    below = thresholds(known, {s: q - passes[s] * supply[s] for s, q in wanted.items() if passes[s] < repeats[s]})
    plan = documents.sparkSession.createDataFrame([(s, passes[s], below.get(s, 0)) for s in wanted], "source string, passes int, below bigint")
    times = F.col("passes") + (F.col("place") < F.col("below")).cast("int")
    return known.join(F.broadcast(plan), "source").withColumn("times", times).filter("times > 0").select("source", "doc_id", "tokens", "times")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_weight, max_repeats, texts, most, tokens, share: what each source of the targets reached; most: the times that a text was used at most."""
    sums = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.max("times").alias("most"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    each = targets.join(sums, "source", "left").fillna(0, ["texts", "most", "tokens"])
    return each.select("source", "target_weight", "max_repeats", "texts", "most", "tokens", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)).alias("share"))
