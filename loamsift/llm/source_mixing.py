"""Mixing sources to target shares of all tokens by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut
from .token_stream import BYTE_BPE, count_tokens

#: About as many documents fall into one bin of the seeded order.
BIN_ROWS = 10_000


def water_fill(sizes: dict[str, float], shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens allotted to each source: in proportion to the shares, none above sizes x caps, and ``total`` together if the caps allow.

    Sources at their cap leave what they lack to the others in proportion to their shares, until
    no source exceeds its cap. Sources without a share or without tokens get nothing.
    """
    out = {s: 0.0 for s in shares}
    room = {s: sizes.get(s, 0) * caps[s] for s in shares}
    open_ = {s for s in shares if shares[s] > 0 and room[s] > 0}
    left = float(total)
    while open_ and left > 0:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if left * shares[s] / weight >= room[s]}
        if not full:
            for s in open_:
                out[s] = left * shares[s] / weight
            break
        for s in full:
            out[s] = room[s]
            left -= room[s]
        open_ -= full
    return out


def mix_sources(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: int | None = None, seed: int = 17, tokenizer: str = BYTE_BPE
) -> tuple[DataFrame, DataFrame]:
    """A selection of documents with repeats, and the shares reached.

    targets: (source, target_share, max_repeats), one row a source, a table of bounded size. Sources
    are compared without case and surrounding blanks; documents of other or no source, and those
    without a token, are not selected. total_tokens: size of the mixture, by default the tokens of all
    documents of the named sources. Every document of a source is used floor(r) times, r being the
    source's allotment over its tokens, and those first in an order drawn from the seed once more,
    until the fraction is filled; the document that crosses the mark is taken if that comes nearer.

    Returns (id, source, tokens, repeats) and (source, target_share, available_tokens, allotted_tokens, reached_tokens, reached_share, epochs).
    """
    key = F.lower(F.trim(F.col(source_col)))
    wanted = {r.source.strip().lower(): r for r in targets.where("source is not null").collect()}
    sized = count_tokens(docs.select(id_col, text_col, key.alias("_source")).where(F.col("_source").isin(list(wanted))), id_col, text_col, tokenizer, ("_source",)).where("tokens > 0")
    sized = cut(sized.select(id_col, F.col("_source").alias("source"), "tokens", F.xxhash64(F.lit(seed), F.col(id_col)).alias("order")))
    stats = {r["source"]: (r["tokens"], r["rows"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect()}  # a row a source
    sizes = {s: t for s, (t, _) in stats.items()}
    allotted = water_fill(sizes, {s: r.target_share or 0.0 for s, r in wanted.items()}, {s: max(0, r.max_repeats or 0) for s, r in wanted.items()}, total_tokens if total_tokens is not None else sum(sizes.values()))

    bins = max(64, max((n for _, n in stats.values()), default=0) // BIN_ROWS)
    plan = []
    for s, r in wanted.items():
        size, amount = sizes.get(s, 0), allotted[s]
        whole = int(amount // size) if size else 0
        plan.append((s, float(r.target_share or 0), size, float(amount), whole, float(amount - whole * size)))
    spark = docs.sparkSession
    quotas = F.broadcast(spark.createDataFrame(plan, "source string, target_share double, available_tokens long, allotted_tokens double, whole int, rest double"))  # a row a source
    binned = sized.withColumn("bin", F.pmod("order", F.lit(bins)))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy("source", "bin").agg(F.sum("tokens").alias("in_bin")).withColumn("before_bin", F.coalesce(F.sum("in_bin").over(before), F.lit(0)))
    placed = binned.join(totals, ["source", "bin"]).join(quotas.select("source", "whole", "rest"), "source")
    # whole bins below the mark are taken, those beyond are not; only the bin at the mark needs an order of its documents
    at_mark = (F.col("before_bin") < F.col("rest")) & (F.col("before_bin") + F.col("in_bin") > F.col("rest"))
    running = Window.partitionBy("source", "bin").orderBy("order", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = placed.where(at_mark).withColumn("upto", F.col("before_bin") + F.sum("tokens").over(running)).withColumn("extra", (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    clear = placed.where(~at_mark).withColumn("extra", (F.col("before_bin") + F.col("in_bin") <= F.col("rest")).cast("int"))
    columns = [id_col, "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("repeats")]
    selection = marked.select(*columns).unionByName(clear.select(*columns)).where("repeats > 0")
    reached = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached_tokens"))
    everything = Window.partitionBy(F.lit(0))  # over a row a source
    shares = (
        quotas.join(reached, "source", "left")
        .withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
        .withColumn("reached_share", F.coalesce(F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(everything), F.lit(0)), F.lit(0.0)))
        .select("source", "target_share", "available_tokens", "allotted_tokens", "reached_tokens", "reached_share", F.coalesce(F.col("reached_tokens") / F.nullif("available_tokens", F.lit(0)), F.lit(0.0)).alias("epochs"))
    )
    return selection, shares
