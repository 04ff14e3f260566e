"""Mixing sources to target shares of tokens (problem 7), by balanced sampling with the cube method.

A source that is to give T tokens and holds A is used r = T / A times, at most its cap. Every document is taken
floor(r) times; what is left is an inclusion probability, and the documents that get one copy more are drawn so that
both the number of tokens and the number of documents come out as the probabilities promise. The cube method does this
by a flight: take three undecided documents, find the direction in which their probabilities can move without changing
either total (the null space of two constraints over three units is a line), and go along it, at random one way or the
other, until one of them is decided. When no such direction is left, at most two documents are undecided.

The flight runs in blocks of a source, drawn by a hash of the key, so a source with a third of all documents is many
blocks. What each block leaves undecided (two documents at most) goes to the next round, in blocks again, until one
block per source is left. Only there the last two documents are landed, to whichever outcome misses the tokens least,
with other documents of that block turned if that helps. So the tokens of an uncapped source miss their target by
less than its largest two documents at any size, and commonly by a few tokens.

Defined results: sources are compared without surrounding blanks and in lower case; documents without a target (null
sources too) are left out; a target without documents reaches nothing and is reported; a capped source gives all it may
and the others keep their own targets, or, with `fill`, take over what it can't give, in proportion to their shares and
up to their own caps, so that the total asked for is reached whenever all caps together allow it; documents of no tokens are drawn like others; null or negative shares and caps
count as 0; several targets of one source are added up, with the smallest cap; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Undecided documents of a block, on average.
BLOCK = 4096


def source_name(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(" \t\r\n")))


def level(shares: list[float], caps: list[float], total: float) -> float:
    """The factor by which shares are to be raised so that the sum of min(factor * share, cap) is the total; infinite where
    the caps together don't allow it (or only just)."""
    order = sorted((c / s, s, c) for s, c in zip(shares, caps, strict=True) if s > 0)
    given, left = 0.0, sum(s for _, s, _ in order)
    for at, s, c in order:
        if given + at * left >= total:
            return (total - given) / left
        given, left = given + c, left - s
    return float("inf")


def plan(documents: DataFrame, targets: DataFrame, fill: bool = False) -> DataFrame:
    """source, target_share, max_repeats, n_documents, n_tokens (held), wanted, factor: one row per target.

    documents: source, n_tokens. factor is how often each document is used on average. fill: what capped sources can't
    give is wanted of those that have room.
    """
    held = documents.groupBy(source_name(F.col("source")).alias("source")).agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    cap = F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0))
    want = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum(share).alias("target_share"), F.min(cap).alias("max_repeats")).where("source is not null")
    both = want.join(held, "source", "left").fillna(0, ["n_documents", "n_tokens"])
    total = both.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    both = both.crossJoin(F.broadcast(total)).withColumn("wanted", F.col("target_share") * F.col("total"))
    if fill:
        both = stored(both, "mix-targets")
        rows = both.select("target_share", (F.col("max_repeats") * F.col("n_tokens")).alias("cap"), "total").collect()  # a row per target
        asked = min(1.0, sum(r.target_share for r in rows)) * (rows[0].total if rows else 0)
        raised = level([r.target_share for r in rows], [float(r.cap) for r in rows], float(asked))
        cap = (F.col("max_repeats") * F.col("n_tokens")).cast("double")
        both = both.withColumn("wanted", cap if raised == float("inf") else F.least(F.greatest(F.lit(raised) * F.col("target_share"), F.lit(0.0)), cap))
    factor = F.least(F.col("max_repeats").cast("double"), F.coalesce(F.try_divide("wanted", "n_tokens"), F.lit(0.0)))
    return both.withColumn("factor", factor).drop("total")


def fly(p: list[float], size: list[float], rng, eps: float = 1e-9) -> list[float]:
    """Probabilities moved until all but at most two are 0 or 1; their sum and their sum weighted by size stay."""
    p, live = list(p), []
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = float(round(p[i]))
            continue
        live.append(i)
        while len(live) == 3 or len(live) == 2 and size[live[0]] == size[live[1]]:
            s = [size[j] for j in live]
            if len(live) == 2:
                u = [1.0, -1.0]
            elif s[0] == s[1]:
                u = [1.0, -1.0, 0.0]
            else:
                u = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
            up = min((1 - p[j]) / d if d > 0 else p[j] / -d for j, d in zip(live, u, strict=True) if d)
            down = min(p[j] / d if d > 0 else (1 - p[j]) / -d for j, d in zip(live, u, strict=True) if d)
            step = up if rng.random() * (up + down) < down else -down
            for j, d in zip(live, u, strict=True):
                p[j] += step * d
                if not eps < p[j] < 1 - eps:
                    p[j] = float(round(p[j]))
            live = [j for j in live if 0 < p[j] < 1]
    return p


def land(p: list[float], size: list[float]) -> list[float]:
    """The last undecided ones (two at most) decided, and decided ones turned, so that the weighted sum is missed least.

    Large documents tend to stay undecided to the end, as they hardly move while small ones are decided. What such a one
    leaves is taken up by turning others over, each time the one that brings the sum nearest, while it comes nearer.
    """
    import numpy as np

    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    if not open_:
        return p
    want = sum(p[i] * size[i] for i in open_)
    fixed = np.array([i for i in range(len(p)) if i not in open_], dtype=int)
    best: tuple = (float("inf"),)
    for k in range(1 << len(open_)):
        choice = [k >> b & 1 for b in range(len(open_))]
        miss = sum(x * size[i] for x, i in zip(choice, open_, strict=True)) - want
        turn = np.array([size[i] * (-1.0 if p[i] == 1 else 1.0) for i in fixed])
        turned: list[int] = []
        while len(fixed):
            at = int(np.argmin(np.abs(turn + miss)))
            if abs(turn[at] + miss) >= abs(miss):
                break
            miss += turn[at]
            turn[at] = np.inf
            turned.append(int(fixed[at]))
        best = min(best, (abs(miss), len(turned), k, turned))
    p = list(p)
    for b, i in enumerate(open_):
        p[i] = float(best[2] >> b & 1)
    for i in best[3]:
        p[i] = 1.0 - p[i]
    return p


def _round(undecided: DataFrame, blocks: DataFrame, seed: int, number: int) -> DataFrame:
    """One flight over all blocks; in a source of one block also the landing."""
    kind = undecided.schema["key"].dataType.simpleString()

    def run(group, pdf):
        import zlib

        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["h", "key"], kind="stable")
        rng = np.random.default_rng(zlib.crc32(f"{seed}/{number}/{group[0]}/{group[1]}".encode()))
        size = pdf["n_tokens"].astype(float).tolist()
        p = fly(pdf["p"].tolist(), size, rng)
        if bool(pdf["last"].iloc[0]):
            p = land(p, size)
        return pd.DataFrame({"source": pdf["source"], "key": pdf["key"], "h": pdf["h"], "n_tokens": pdf["n_tokens"], "base": pdf["base"], "p": p})

    block = F.pmod(F.xxhash64("h", F.lit(seed), F.lit(number)), F.col("blocks"))
    placed = undecided.join(F.broadcast(blocks), "source").withColumn("block", block).withColumn("last", F.col("blocks") == 1)
    return placed.groupBy("source", "block").applyInPandas(run, f"source string, key {kind}, h bigint, n_tokens bigint, base bigint, p double")


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 7, block: int = BLOCK, fill: bool = False) -> DataFrame:
    """key, source, n_tokens, copies: the documents used, each with how often. documents: key, source, n_tokens."""
    shares = stored(plan(documents, targets, fill), "mix-plan").select("source", "factor")
    rows = documents.select(source_name(F.col("source")).alias("source"), F.col(key).alias("key"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    rows = rows.join(shares, "source").withColumn("base", F.floor("factor")).withColumn("p", F.col("factor") - F.col("base"))
    state = stored(rows.select("source", "key", F.xxhash64(F.lit(seed), "key").alias("h"), "n_tokens", "base", "p"), "mix-0")
    decided, number = state.where("p = 0"), 0
    state = state.where("p > 0")
    while True:
        counts = state.groupBy("source").agg(F.count("*").alias("n"))
        blocks = stored(counts.select("source", F.ceil(F.col("n") / block).alias("blocks")), "mix-blocks")  # a row per source of targets
        most = blocks.agg(F.max("blocks").alias("m")).first().m
        if most is None:
            break
        number += 1
        done = stored(_round(state, blocks, seed, number), f"mix-{number}")
        decided = decided.unionByName(done.where("p = 0 or p = 1"))
        state = done.where("p > 0 and p < 1")
    copies = (F.col("base") + F.col("p")).cast("bigint")
    return decided.select(F.col("key").alias(key), "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def report(documents: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, tokens_held, tokens_wanted, documents_used, tokens_used, share_reached, is_capped."""
    used = mixed.groupBy("source").agg(F.sum("copies").alias("documents_used"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"))
    both = plan(documents, targets).join(used, "source", "left").fillna(0, ["documents_used", "tokens_used"])
    total = mixed.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("total"))
    return both.crossJoin(F.broadcast(total)).select(
        "source",
        "target_share",
        "max_repeats",
        F.col("n_tokens").alias("tokens_held"),
        F.col("wanted").alias("tokens_wanted"),
        "documents_used",
        "tokens_used",
        F.coalesce(F.try_divide("tokens_used", "total"), F.lit(0.0)).alias("share_reached"),
        (F.col("factor") >= F.col("max_repeats")).alias("is_capped"),
    )
