"""The model of names fitted on a whole corpus (problem 8): every text is read, and every example counts by its weight.

Two passes over the distinct texts: one counts the words and the towns, which makes the lexicon; one makes the labelled
examples by it. Equal examples are added up, in the tasks and then by a shuffle, so that what remains is the number of
different ones. The regression takes full gradients over all of them: where they are few, the driver adds up the blocks
of examples, else a job a round does. Nothing is sampled, and no text is too long.

Words and features that count are broadcast; they grow with the vocabulary of the corpus.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, stored
from . import names

#: Entries that a task adds up before it gives them on.
HELD = 100_000
#: Bytes of examples that the driver takes; more of them stay on the executors.
ON_DRIVER = 1 << 26
#: Weights whose gradients are added up together.
CHUNK = 1 << 16
#: Between the features of an example; no token holds one.
SEP = "\t"


def distinct_texts(texts: DataFrame) -> DataFrame:
    """t: each text once that isn't empty, in as many parts as keep all cores busy."""
    tasks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions())
    return stored(texts.where("t <> ''").repartition(tasks, "t").distinct(), "texts")


def counted(texts: DataFrame, form: Callable, towns: Callable) -> tuple[names.Lexicon, tuple[str, ...]]:
    """The lexicon and the towns (those found twice, by any grammar) of texts. form: gives the form of a text that rules read; towns: makes a reader of them."""
    import pandas as pd

    columns = ["kind", "w", "a", "b", "c", "d", "e"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        (token, places), read = names.patterns(), towns()
        words, found, n = defaultdict(lambda: [0] * 5), Counter(), 0

        def given() -> pd.DataFrame:
            out = [("n", "", n, 0, 0, 0, 0), *(("t", w, k, 0, 0, 0, 0) for w, k in found.items()), *(("w", w, *k) for w, k in words.items())]
            return pd.DataFrame(out, columns=columns)

        for batch in batches:
            for x in map(form, batch["t"]):
                names.tally(names.Text(x, token), places, words)
                found.update(read(x))
                n += 1
                if len(words) + len(found) > HELD:
                    yield given()
                    words.clear(), found.clear()
                    n = 0
        yield given()

    each = texts.mapInPandas(run, "kind string, w string, a bigint, b bigint, c bigint, d bigint, e bigint")
    summed = each.groupBy("kind", "w").agg(*[F.sum(c).alias(c) for c in columns[2:]])
    # Of words, those that names.lexicon may have a use for.
    rows = summed.where(f"kind = 'n' or kind = 't' and a >= 2 or kind = 'w' and (a >= 2 or c >= 2 or b >= {names.RARE})").collect()
    n = sum(r.a for r in rows if r.kind == "n")
    lex = names.lexicon((tuple(r)[1:] for r in rows if r.kind == "w"), n)
    return lex, tuple(sorted(r.w for r in rows if r.kind == "t"))


def examples(texts: DataFrame, form: Callable, lex: names.Lexicon) -> DataFrame:
    """f, y, v: the different examples of texts (features, label) and the weight of each."""
    import pandas as pd

    sent = texts.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        token, places = names.patterns()
        bag: Counter[tuple[str, int]] = Counter()

        def given() -> pd.DataFrame:
            return pd.DataFrame([(f, y, v) for (f, y), v in bag.items()], columns=["f", "y", "v"])

        for batch in batches:
            for x in map(form, batch["t"]):
                for f, y, v in names.examples(names.Text(x, token), places, sent.value):
                    bag[SEP.join(f), y] += v
                if len(bag) > HELD:
                    yield given()
                    bag.clear()
        yield given()

    each = texts.mapInPandas(run, "f string, y int, v bigint")
    return stored(each.groupBy("f", "y").agg(F.sum("v").alias("v")).sortWithinPartitions("f", "y"), "examples")


def regression(different: DataFrame, lex: names.Lexicon, on_driver: int = ON_DRIVER) -> names.Model:
    """The model of the labelled sentences and of examples. on_driver: bytes of them that the driver takes."""
    import numpy as np
    import pandas as pd

    context = different.sparkSession.sparkContext
    own = names.own_examples()
    total, total_own = different.agg(F.sum("v")).first()[0] or 0, sum(own.values())
    # The two places weigh alike, however large the corpus is.
    scale = max(1.0, total / total_own / 2)
    each = different.select(F.explode(F.split("f", SEP)).alias("x"), "v").groupBy("x").agg(F.sum("v").alias("v"))
    kept = {r.x for r in each.where(F.col("v") >= names.SEEN).select("x").collect()} | names.seen((f, n) for (f, _), n in own.items())
    index = {f: k for k, f in enumerate(sorted(kept))}
    sent = context.broadcast(index)
    parts = ("flat", "size", "y", "v")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            made = names.block(((f.split(SEP), y, v) for f, y, v in zip(b["f"], b["y"], b["v"], strict=True)), sent.value)
            yield pd.DataFrame({p: [x.tobytes()] for p, x in zip(parts, made, strict=True)})

    def arrays(r) -> tuple:
        kinds = (np.int32, np.int32, np.int8, np.float64)
        return tuple(np.frombuffer(getattr(r, p), k) for p, k in zip(parts, kinds, strict=True))

    table = stored(different.mapInPandas(blocks, "flat binary, size binary, y binary, v binary"), "blocks")
    here = [names.block(((f, y, scale * n) for (f, y), n in own.items()), index)]
    apart = (table.agg(F.sum(F.octet_length("flat"))).first()[0] or 0) > on_driver
    if not apart:
        here += map(arrays, table.collect())
    shared = table.coalesce(context.defaultParallelism)

    def elsewhere(w):
        weights = context.broadcast(w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pandas as pd

            g = np.zeros(len(weights.value))
            for b in batches:
                for r in b.itertuples():
                    g += names.gradient(weights.value, *arrays(r))
            task = TaskContext.get().partitionId()
            for k in range(0, len(g), CHUNK):
                yield pd.DataFrame({"k": [k], "task": [task], "g": [g[k : k + CHUNK].tobytes()]})

        def added(each: pd.DataFrame) -> pd.DataFrame:
            each = each.sort_values("task")  # sums of floats depend on their order
            return each[:1].assign(g=[sum(map(np.frombuffer, each["g"])).tobytes()])

        kind = "k bigint, task int, g binary"
        out = shared.mapInPandas(run, kind).groupBy("k").applyInPandas(added, kind).collect()
        weights.destroy()
        return np.concatenate([np.frombuffer(r.g) for r in sorted(out, key=lambda r: r.k)])

    def gradient_at(w):
        g = sum(names.gradient(w, *b) for b in here)
        return g + elsewhere(w) if apart else g

    model = names.model_of(index, names.descend(gradient_at, len(index), total + scale * total_own), lex)
    forget(table)
    return model


def fit(texts: DataFrame, form: Callable, towns: Callable) -> names.Model:
    """A model of the column t of texts."""
    once = distinct_texts(texts)
    lex, known = counted(once, form, towns)
    different = examples(once, form, lex)
    model = regression(different, lex)
    model.towns = known
    forget(once, different)
    return model
