"""Language-model scoring with a probabilistic suffix tree over words.

A text's tokens are its words and one end. A context is the last token, the last two, or more. It is a state of the tree if it
occurs often enough and its next-token distribution diverges from its suffix's by at least ``min_gain``
nats in all; contexts of more than two tokens are states only where their suffix is one, and depth goes on while there are
states. A state keeps the counts of next tokens that follow it often enough; the rest of its mass, and a prior, goes to its
suffix's distribution, down to the token's own smoothed frequency. So every distribution sums to one, and each token is scored
by the longest suffix that is a state. Often enough is ``LEAST_CONTEXT`` and ``LEAST_NEXT`` times, and at least ``ROOT`` times
the square root of the number of training tokens: a context of any frequency is counted once the corpus is large enough, so
the tree grows with the corpus without end, but slower than the corpus. ``min_context`` and ``min_next`` are further floors,
as shares of the training tokens; by default there are none.

The tree is never gathered: states and next tokens are rows of written tables, named by 64-bit hashes of their tokens. A
document's scores are sums of one value for each token, state and next token that it meets, so documents look the values up
in one join. What is broadcast is bounded: at most 1 / ``frequent`` tokens, the values of states and next tokens that make up
a ``HOT`` share of the training tokens (at most 2 / ``HOT`` a depth), and sieves of a bounded number of bits that tell which
names are in no table; a full sieve costs time and loses nothing. No key of the join of documents is frequent in what was learned.

Edge cases: a null or empty text is one end. A row with a null doc_id is learned from and isn't held out. Repeated rows are
learned and scored each. Without training rows every token is unknown: N and V are 0. An empty table gives no rows. Other
columns aren't read; an added column replaces one of the same name. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, remove, row_slices, written
from .labelled import held_out
from .sieves import Places, passes, sieve
from .words import SLICE_CHARS, finished, key_of, word_keys

FREQUENT, MIN_CONTEXT, MIN_NEXT, MIN_GAIN, PRIOR = 1e-6, 0.0, 0.0, 10.0, 5.0
LEAST_CONTEXT, LEAST_NEXT, ROOT, HOT = 4, 4, 1e-3, 1e-6
#: Mixed into a row's number where it stands for the row's own sums.
ROW = 0x14057B7EF767814F
#: From this depth on, contexts of two depths are counted in one pass over the texts.
TOGETHER = 4
END = b""
END_KEY = key_of(END)
TOKEN, NEXT, STATE = 0, 1, 2
OWN = "row long, n_tokens long, tokens binary, rare binary"


def tokens_of(text: str) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased, and the end."""
    return [*text.encode().lower().split(), END]


def _token_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the tokens' keys, number of tokens of each text), an end behind each text."""
    words, lengths = word_keys(texts)
    lengths = lengths + 1
    out = np.full(int(lengths.sum()), END_KEY, np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(lengths) - 1] = False
    out[inside] = words
    return out, lengths


def count_tokens(docs: DataFrame, text: str = "text", most: int = 4_000_000) -> DataFrame:
    """(key, n): how often each token occurs. A task adds up tokens once it has ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], names=["key", "n"])

        for cut in row_slices(batches, text, SLICE_CHARS):
            held.append(_token_keys(cut.column(text))[0])
            size += len(held[-1])
            if size > most:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select(text).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent tokens with their counts, the commonest first, and the numbers of all tokens and of different ones."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n: int, v: int):
        self.places, self.counts, self.n, self.v = Places(keys), counts, n, v
        self.zero = n + 0.5 * (v + 1)


class Tree:
    """The vocabulary, and after fit() the values (name, n, kind, value) of states and next tokens up to ``depth``."""

    def __init__(self, vocabulary: Vocabulary, counts: DataFrame):
        self.vocabulary, self.counts, self.values, self.depth = vocabulary, counts, None, 0


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """The name of a context ``a`` with the next token, whose suffix with that token is ``b``."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b.astype(np.uint64) if isinstance(b, np.ndarray) else np.uint64(b))
    return finished(x).view(np.int64)


def windows(keys: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(whether there is such a context, its name, its name with the next token, its suffix's) of each token after the
    first, from depth 1 on. A context has an end only as its first token."""
    end = keys[:-1] == END_KEY
    there, lower = np.ones(len(end), bool), keys[1:]
    context = keys[:-1]
    for d in range(1, depth + 1):
        if d > 1:
            context = np.concatenate([[0], lower[:-1]])
            there = np.concatenate([[False], there[:-1] & ~end[1:]])
        gram = mixed(context, lower)
        yield there, context, gram, lower
        lower = gram


def _values(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers in a column of binary values, one value after another."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None and len(column) else np.empty(0, kind)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A column of binary values, cut from an array of numbers."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _slices(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, tokens: int = 400_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Cut batches of encoded texts: (rows, their tokens' numbers, and keys after an end, number of tokens of each row)."""
    known = vocabulary.places.names if len(vocabulary.places.names) else np.zeros(1, np.int64)
    for batch in batches:
        ends = np.cumsum(batch.column("n_tokens").to_numpy())
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            to = max(start + 1, int(np.searchsorted(ends, before + tokens, "right")))
            cut = batch.slice(start, to - start)
            numbers = _values(cut.column("tokens"), "<i4")
            keys = np.concatenate([[END_KEY], known[numbers]])
            keys[1 + np.flatnonzero(numbers < 0)] = _values(cut.column("rare"), "<i8")
            yield cut, numbers, keys, np.diff(ends[start:to], prepend=before)
            start = to


def _grams(encoded: DataFrame, vocabulary: Vocabulary, depth: int, contexts: np.ndarray, lowers: np.ndarray, least: float, more: bool = False, most: int = 1_500_000) -> DataFrame:
    """A written table (name, context, lower, n): contexts of this depth with a next token, ``lower`` being the suffix with
    that token, and how often they occur, at least ``least`` times. Left out are those that the sieves show to be too rare.
    With ``more``, those of one token more are counted too, where both the context and the suffix with the next token are
    counted. Tasks add up what they have before the shuffle; behind it, sorted rows are added up as they come."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, contexts, lowers))
    names = ["context", "lower", "n"]

    def added(context: np.ndarray, lower: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Sums of rows that stand beside each other."""
        first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (lower[1:] != lower[:-1])]))
        return [context[first], lower[first], np.add.reduceat(n, first)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, contexts, lowers = shared.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name, context, lower = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(name)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in added(context[order], lower[order], np.ones(len(order), np.int64))], names=names)

        for _, _, keys, _ in _slices(batches, vocabulary):
            for d, (there, context, gram, lower) in enumerate(windows(keys, depth + more), 1):
                if d == depth:
                    ok = np.flatnonzero(there)
                    ok = ok[passes(contexts, context[ok])]
                    ok = ok[passes(lowers, lower[ok])]
                elif d > depth:
                    ok = np.intersect1d(ok, ok + 1, assume_unique=True)
                    ok = ok[there[ok]]
                if d >= depth and len(ok):
                    held.append((gram[ok], context[ok], lower[ok]))
                    size += len(ok)
            if size > 2 * most:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def kept(rows: list[np.ndarray]) -> pa.RecordBatch:
            some = rows[2] >= least
            context, lower, n = (x[some] for x in rows)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (mixed(context, lower), context, lower, n)], names=["name", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in names]
            rows = added(*rows if last is None else (np.concatenate(x) for x in zip(last, rows)))
            last = [x[-1:] for x in rows]  # may go on in the next batch
            yield kept([x[:-1] for x in rows])
        if last is not None:
            yield kept(last)

    pairs = encoded.select("n_tokens", "tokens", "rare").mapInArrow(run, "context long, lower long, n long")
    # one long as the key: such rows are sorted by their bits, without comparisons
    dealt = pairs.repartition(partitions(spark), "context", "lower").sortWithinPartitions(F.xxhash64("context", "lower"))
    out = written(dealt.mapInArrow(add, "name long, context long, lower long, n long"), "grams")
    shared.destroy()
    return out


def vocabulary(docs: DataFrame, text: str = "text", frequent: float = FREQUENT) -> tuple[Tree, DataFrame]:
    """(a tree without states, counts): counts is a written table (key, n) of all the documents' tokens."""
    counts = written(count_tokens(docs, text), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    table = counts.filter((F.col("n") >= frequent * n) | (F.col("key") == END_KEY)).toArrow()  # at most 1 / frequent rows
    order = np.lexsort((table.column("key").to_numpy(), -table.column("n").to_numpy()))
    return Tree(Vocabulary(table.column("key").to_numpy()[order], table.column("n").to_numpy()[order].astype(np.float64), n, v), counts), counts


def encode(docs: DataFrame, tree: Tree, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A written table of the columns ``keep`` and, for each text: row (unique), n_tokens, tokens (numbers, -1 for rarer
    ones) and rare, the keys of the rarer ones, both as little-endian binary values."""
    shared = docs.sparkSession.sparkContext.broadcast(tree.vocabulary)
    keep = [c for c in dict.fromkeys(keep)]
    inner = [f"__{k}" for k in range(len(keep))]  # own names, whatever the columns are called
    own = T._parse_datatype_string(OWN).fields
    schema = T.StructType([*(T.StructField(i, docs.schema[c].dataType) for i, c in zip(inner, keep)), *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, row = shared.value.places, TaskContext.get().partitionId() << 40
        for cut in row_slices(batches, "__text", SLICE_CHARS):
            keys, lengths = _token_keys(cut.column("__text"))
            numbers = known.find(keys)
            rare = numbers < 0
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.RecordBatch.from_arrays(
                [
                    *(cut.column(c) for c in inner),
                    pa.array(row + np.arange(cut.num_rows)),
                    pa.array(lengths),
                    _binary(numbers.astype("<i4"), bounds),
                    _binary(keys[rare].astype("<i8"), np.concatenate([[0], np.cumsum(rare)])[bounds]),
                ],
                names=schema.names,
            )
            row += cut.num_rows

    named = docs.select(*(F.col(c).alias(i) for i, c in zip(inner, keep)), F.col(text).alias("__text"))
    return written(named.mapInArrow(run, schema), "encoded", "zstd").withColumnsRenamed({f"__{k}": f"__keep_{c}" for k, c in enumerate(keep)})


def fit(tree: Tree, encoded: DataFrame, min_context: float = MIN_CONTEXT, min_next: float = MIN_NEXT, min_gain: float = MIN_GAIN) -> Tree:
    """Give the tree its values, from the encoded texts that its counts come from."""
    n = tree.vocabulary.n
    if not n:
        return tree
    least_context, least_next = max(LEAST_CONTEXT, ROOT * n**0.5, min_context * n), max(LEAST_NEXT, ROOT * n**0.5, min_next * n)
    least = min(least_context, least_next)
    level = tree.counts.select(F.col("key").alias("name"), F.lit(0).cast("long").alias("lower"), "n", ((F.col("n") + 0.5) / F.lit(float(tree.vocabulary.zero))).alias("p"))
    states, values = None, []
    while len(values) < 2 or states.count():
        depth = len(values) + 1
        common = level.filter(F.col("n") >= least_context)
        if depth < TOGETHER or (depth - TOGETHER) % 2 == 0:  # deep contexts are few: two depths share a pass over the texts
            contexts = sieve(common)
            lowers = contexts if least == least_context else sieve(level.filter(F.col("n") >= least))
            raw = _grams(encoded, tree.vocabulary, depth, contexts, lowers, least, depth >= TOGETHER)
        contexts = common.select(F.col("name").alias("context"), F.col("lower").alias("suffix"), F.col("n").alias("all"))
        grams = raw.join(contexts, "context").join(level.select(F.col("name").alias("lower"), F.col("p").alias("low")), "lower")
        grams = written(grams.select("name", "context", "lower", "n", "low", "suffix", "all"), "grams-lower")
        follow = grams.filter(F.col("n") >= least_next)
        mass = follow.groupBy("context").agg(F.first("suffix").alias("suffix"), F.first("all").alias("all"), F.sum("n").alias("kept"))
        if depth > 2:
            mass = mass.join(states.select(F.col("context").alias("suffix")), "suffix", "left_semi")
        mass = mass.withColumn("rest", F.greatest(F.col("all") - F.col("kept"), F.lit(0)) + PRIOR).withColumn("total", F.col("kept") + F.col("rest"))
        mass = written(mass.select("context", "all", "kept", "rest", "total"), "contexts")
        mine = (F.col("n") + F.col("rest") * F.col("low")) / F.col("total")
        gains = follow.join(mass.select("context", "rest", "total"), "context").groupBy("context").agg(F.sum(F.col("n") * F.log(mine / F.col("low"))).alias("gain"))
        gain = F.col("gain") + (F.col("all") - F.col("kept")) * F.log(F.col("rest") / F.col("total"))
        states = written(mass.join(gains, "context").filter(gain >= min_gain).select("context", "all", "rest", "total"), "states")
        # where the context is no state, or the next token too rare for it, the suffix's probability goes on
        back = F.log10(F.col("rest") / F.col("total"))
        p = F.when(F.col("total").isNull(), F.col("low")).when(F.col("n") >= least_next, mine).otherwise(F.col("rest") / F.col("total") * F.col("low"))
        value = F.when(F.col("n") >= least_next, F.log10(mine / F.col("low")) - back)
        level = written(grams.drop("all").join(states.drop("all"), "context", "left").select("name", "lower", "n", p.alias("p"), value.alias("value")), "level")
        _free(grams, mass)
        values.append(level.filter("value IS NOT NULL").select("name", "n", F.lit(NEXT).alias("kind"), "value").unionByName(states.select(F.col("context").alias("name"), F.col("all").alias("n"), F.lit(STATE).alias("kind"), back.alias("value"))))
    tree.values, tree.depth = values[0], len(values)
    for more in values[1:]:
        tree.values = tree.values.unionByName(more)
    return tree


def _free(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let the driver's JVM drop shuffle files of finished steps."""
    spark = tables[0].sparkSession
    for t in tables:
        if files := t.inputFiles():
            remove(spark, files[0].rsplit("/", 1)[0])
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train(docs: DataFrame, text: str = "text", frequent: float = FREQUENT, **shares) -> tuple[Tree, DataFrame]:
    """(tree, counts) of the documents."""
    tree, counts = vocabulary(docs, text, frequent)
    return fit(tree, encode(docs, tree, text, ()), **shares), counts


def score(docs: DataFrame, model: tuple[Tree, DataFrame], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, train_tokens, base_score and score."""
    return score_encoded(encode(docs, model[0], text, keep), model, keep)


def _hot(tree: Tree) -> list[tuple[Places, np.ndarray]]:
    """(names, values) of next tokens and of states that are a ``HOT`` share of the training tokens."""
    if tree.values is None:
        return [(Places(np.empty(0, np.int64)), np.empty(0))] * 2
    table, out = tree.values.filter(F.col("n") >= HOT * tree.vocabulary.n).toArrow(), []  # at most 2 / HOT rows a depth
    for kind in (NEXT, STATE):
        mine = np.flatnonzero(table.column("kind").to_numpy() == kind)
        out.append((Places(table.column("name").to_numpy()[mine]), table.column("value").to_numpy()[mine]))
    return out


def _sums(rows: DataFrame, tree: Tree) -> DataFrame:
    """(row, known, base, gain) of each text: tokens that training texts have, and log10 of the base's probability and of the
    tree's over the base's."""
    sieves = [sieve(tree.values.filter(F.col("kind") == k)) for k in (NEXT, STATE)] if tree.values is not None else []
    shared = rows.sparkSession.sparkContext.broadcast((tree.vocabulary, _hot(tree), sieves))
    depth = tree.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, ((next_names, next_values), (state_names, state_values)), sieves = shared.value
        smallest = np.log10(0.5 / vocabulary.zero)
        base = np.append(np.log10((vocabulary.counts + 0.5) / vocabulary.zero), smallest)  # number -1 is the last one
        for cut, numbers, keys, lengths in _slices(batches, vocabulary):
            row = np.repeat(np.arange(len(lengths)), lengths)
            gain, cold = np.zeros(len(lengths)), []

            def look_up(at: np.ndarray, names: np.ndarray, hot: Places, values: np.ndarray, sieve: np.ndarray, kind: int) -> np.ndarray:
                """Add values of hot names, note those of others that may be in the tables, and tell which are either."""
                at = at[passes(sieve, names[at])]
                place = hot.find(names[at])
                is_hot = place >= 0
                np.add(gain, np.bincount(row[at[is_hot]], values[place[is_hot]], len(gain)), out=gain)
                maybe = at[~is_hot]
                cold.append((row[maybe], names[maybe], np.full(len(maybe), kind)))
                return at

            rare = np.flatnonzero(numbers < 0)
            cold.append((row[rare], keys[1 + rare], np.zeros(len(rare), np.int64)))
            lower_state = None
            for d, (there, context, gram, _) in enumerate(windows(keys, depth), 1):
                at = np.flatnonzero(there if d < 3 else there & lower_state)
                at = look_up(at, context, state_names, state_values, sieves[1], 1)
                lower_state = np.zeros(len(there), bool)
                lower_state[at] = True
                look_up(at, gram, next_names, next_values, sieves[0], 0)
            number = cut.column("row").to_numpy()
            of, names, kind = (np.concatenate(x) for x in zip(*cold))
            order = np.lexsort((names, of))
            of, names, kind = of[order], names[order], kind[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (names[1:] != names[:-1])])) if len(of) else np.empty(0, np.int64)
            as_context = np.add.reduceat(kind, first) if len(first) else first
            as_next = np.diff(first, append=len(of)) - as_context
            none = np.zeros(len(number), np.int32)
            sums = [np.bincount(row, numbers >= 0, len(number)).astype(np.int64), np.bincount(row, base[numbers], len(number)), gain]
            blank = pa.nulls(len(first), pa.struct([("known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([number, number[of[first]]])),
                    pa.array(np.concatenate([mixed(number, ROW), names[first]])),
                    pa.array(np.concatenate([none, as_next.astype(np.int32)])),
                    pa.array(np.concatenate([none, as_context.astype(np.int32)])),
                    pa.concat_arrays([pa.StructArray.from_arrays([pa.array(x) for x in sums], names=["known", "base", "gain"]), blank]),
                ],
                names=["row", "name", "as_next", "as_context", "sums"],
            )

    met = rows.select("row", "n_tokens", "tokens", "rare").mapInArrow(run, "row long, name long, as_next int, as_context int, sums struct<known: long, base: double, gain: double>")
    vocabulary = tree.vocabulary
    # a rare token's value is what its count adds to that of a token without any
    cold = tree.counts.select(F.col("key").alias("name"), F.lit(TOKEN).alias("kind"), F.log10((F.col("n") + 0.5) / 0.5).alias("value"))
    if tree.values is not None:
        cold = cold.unionByName(tree.values.filter(F.col("n") < HOT * vocabulary.n).select("name", "kind", "value"))
    looked = met.join(cold.hint("shuffle_hash"), "name", "left")
    zero = F.lit(0.0)
    times = F.when(F.col("kind") == STATE, F.col("as_context")).otherwise(F.col("as_next"))
    is_token = F.col("kind") == TOKEN
    return looked.groupBy("row").agg(
        (F.coalesce(F.sum("sums.known"), F.lit(0)) + F.sum(F.when(is_token, times).otherwise(0))).alias("known"),
        (F.sum(F.coalesce("sums.base", zero) + F.when(is_token, times * F.col("value")).otherwise(zero))).alias("base"),
        (F.sum(F.coalesce("sums.gain", zero) + F.when(F.col("kind") != TOKEN, times * F.col("value")).otherwise(zero))).alias("gain"),
    )


def score_encoded(rows: DataFrame, model: tuple[Tree, DataFrame], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    tree = model[0]
    added = {"n_tokens": F.col("n_tokens"), "n_known": F.col("known"), "train_tokens": F.lit(tree.vocabulary.n).cast("long"), "base_score": F.col("base"), "score": F.col("base") + F.col("gain")}
    kept = [F.col(f"__keep_{c}").alias(c) for c in dict.fromkeys(keep) if c not in added]
    mine = rows.select("row", "n_tokens", *(f"__keep_{c}" for c in dict.fromkeys(keep)))
    return mine.join(_sums(rows, tree), "row").select(*kept, *(v.alias(k) for k, v in added.items()))


def learn_and_score(docs: DataFrame, learn: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), frequent: float = FREQUENT, **shares) -> DataFrame:
    """Learn from the rows whose column ``learn`` is false and score all; texts are split into tokens and numbered once."""
    tree, counts = vocabulary(docs.filter(~F.col(learn)), text, frequent)
    encoded = encode(docs, tree, text, (*keep, learn))
    return score_encoded(encoded, (fit(tree, encoded.filter(~F.col(f"__keep_{learn}")), **shares), counts), keep)


def split(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows to learn from, and all rows with held_out."""
    out = docs.withColumn("held_out", held_out(doc_id, 5, 1))
    return out.filter(~F.col("held_out")), out
