"""A hidden Markov language model over words, trained by Baum-Welch across partitions.

A latent state emits a symbol, and the symbol a word. The commonest training words and the end
of a text are symbols of their own; all other words share one of a fixed number of spelling
classes (their last three characters, hashed), inside which a word seen c times has probability
(c + 1) / (n + v + 1), n and v being the class's training tokens and distinct words, and an
unseen word stands for one more. So the model is of a bounded size and still uses the exact count
of every word. Its probability of a text is the scaled forward recursion's over all its tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.sources.shared import stored

from .common import map_batches

#: The end of a text as a token: no word is empty.
END = ""
CLASSES = 1024
#: Tokens that are worked on at once; bounds the memory of forward and backward tables.
CHUNK = 400_000
#: Tokens of a text that forward and backward tables are made of at once in training.
LONGEST = 1 << 17
#: Tokens that a task gathers to sort texts by length; longer texts go alone.
GATHER = 4_000_000
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 300_000


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def spelling(word: str) -> int:
    return zlib.crc32(word[-3:].encode()) % CLASSES


def spelling_column(word: str) -> Column:
    return F.pmod(F.crc32(F.substring(word, -3, 3)), F.lit(CLASSES)).cast("int")


class Layout:
    """Texts of symbols laid out by time: the first tokens of all texts, then the second, ..."""

    def __init__(self, texts: list[np.ndarray]):
        self.order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in self.order])
        self.live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else np.empty(0, int)
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        self.symbols = np.empty(self.at[-1], np.int32)
        for k, i in enumerate(self.order):
            self.symbols[self.at[: len(texts[i])] + k] = texts[i]

    def owners(self) -> np.ndarray:
        return self.order[np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.live)]


class Model:
    """Start, transition and emission probabilities of `states` latent states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)

    @classmethod
    def begin(cls, states: int, shares: np.ndarray) -> Model:
        """States that stay with 0.9 and emit the symbols' shares, each with fixed noise of its own."""
        noise = np.random.default_rng(7).gamma(1.0, size=(len(shares), states))
        emit = shares[:, None] * noise
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    def forward(self, x: Layout, alpha: np.ndarray | None = None) -> np.ndarray:
        """The scales of the forward recursion; a text's logs sum to its own. `alpha`, if given, holds
        emissions and is overwritten by the scaled forward probabilities."""
        scale, a = np.empty(len(x.symbols)), None
        for t, n in enumerate(x.live):
            lo = x.at[t]
            e = self.emit[x.symbols[lo : lo + n]] if alpha is None else alpha[lo : lo + n]
            a = (self.start if a is None else a[:n] @ self.move) * e
            c = a.sum(1)
            a /= c[:, None]
            scale[lo : lo + n] = c
            if alpha is not None:
                alpha[lo : lo + n] = a
        return scale

    def log_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text of symbols (an empty one: 0)."""
        out = np.zeros(len(texts))
        for part in pieces(texts):
            x = Layout([texts[i] for i in part])
            out[part] = np.bincount(x.owners(), np.log(self.forward(x)), minlength=len(part))
        return out

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, transitions and emissions: the E step.

        A text of over LONGEST tokens goes alone, its tables made part by part.
        """
        states = len(self.start)
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros(self.emit.shape)
        for text in (t for t in texts if len(t) > LONGEST):
            for total, own in zip((start, move, emit), self.expected_in_parts(text)):
                total += own
        texts = [t for t in texts if len(t) <= LONGEST]
        for part in pieces(texts):
            x = Layout([texts[i] for i in part])
            if not len(x.symbols):
                continue
            e = self.emit[x.symbols]
            alpha = e.copy()
            e /= self.forward(x, alpha)[:, None]
            beta = np.ones((x.live[0], states))
            gamma, pairs = alpha, np.zeros((states, states))  # gamma takes alpha's place, from the end
            for t in range(len(x.live) - 1, 0, -1):
                n, lo, was = x.live[t], x.at[t], x.at[t - 1]
                y = e[lo : lo + n] * beta[:n]
                pairs += gamma[was : was + n].T @ y
                beta[:n] = y @ self.move.T
                gamma[was : was + n] *= beta[:n]
            start += gamma[: x.live[0]].sum(0)
            move += pairs * self.move
            for k in range(states):
                emit[:, k] += np.bincount(x.symbols, gamma[:, k], minlength=len(emit))
        return start, move, emit

    def expected_in_parts(self, text: np.ndarray, size: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """expected() of one text with tables of `size` tokens: the forward probabilities at the end of
        each part are kept, and each part's own are made again when the backward recursion gets there."""
        states = len(self.start)
        start, pairs, emit = np.zeros(states), np.zeros((states, states)), np.zeros(self.emit.shape)

        def forward(symbols: np.ndarray, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            alpha, scale = self.emit[symbols], np.empty(len(symbols))
            for t in range(len(symbols)):
                a = (self.start if a is None else a @ self.move) * alpha[t]
                scale[t] = a.sum()
                alpha[t] = a = a / scale[t]
            return alpha, scale

        parts = [text[k : k + size] for k in range(0, len(text), size)]
        before: list[np.ndarray | None] = [None]
        for part in parts[:-1]:
            before.append(forward(part, before[-1])[0][-1])
        beta = np.ones(states)
        for part, last in zip(reversed(parts), reversed(before)):
            alpha, scale = forward(part, last)
            e = self.emit[part] / scale[:, None]
            for t in range(len(part) - 1, -1, -1):
                was = alpha[t - 1] if t else last
                y = e[t] * beta
                alpha[t] *= beta
                if was is not None:
                    pairs += np.outer(was, y)
                    beta = self.move @ y
            for k in range(states):
                emit[:, k] += np.bincount(part, alpha[:, k], minlength=len(emit))
            if last is None:
                start += alpha[0]
        return start, pairs * self.move, emit

    def maximised(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
        """The M step; every state also saw one token dealt by the symbols' overall shares."""
        start, move, emit = start + 0.1, move + 0.1, emit + shares[:, None]
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def pieces(texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Numbers of texts of like length that have some CHUNK tokens together."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(lengths, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(np.cumsum(lengths[order]) // CHUNK)) + 1) if len(order) else ()


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches with their texts of symbols, as many at once as GATHER allows."""
    held, texts, size = [], [], 0
    for batch in batches:
        new = [np.frombuffer(x, np.uint16) for x in batch.column(column).to_pylist()]
        held.append(batch)
        texts += new
        size += sum(map(len, new))
        if size >= GATHER:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c): the tokens of all training texts; partial counts per task, then one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for text in texts:
                counts.update(words(text))
            counts[END.encode()] += len(texts)
            if len(counts) > COUNTED:
                yield out(counts)
                counts = Counter()
        if counts:
            yield out(counts)

    return map_batches(rows.where("training").select("text"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What the tasks know of words: exact counts of the commonest, sums of the classes."""

    def __init__(self, common: list[tuple[str, int]], ends: int, classes: dict[int, tuple[int, int]], own: int):
        ranked = sorted(common, key=lambda x: (-x[1], x[0]))
        self.index = {w.encode(): i for i, (w, _) in enumerate(ranked)}
        self.log_count = np.log10(np.array([c for _, c in ranked], float) + 1)
        self.own = min(own, len(ranked))
        self.symbol = np.array([i if i < self.own else self.own + 1 + spelling(w) for i, (w, _) in enumerate(ranked)], np.int64)
        # A class holds the words without a symbol of their own.
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for g, (tokens, distinct) in classes.items():
            n[g], v[g] = tokens, distinct
        tokens = np.array([c for _, c in ranked[: self.own]] + [ends], float)
        for w, c in ranked[: self.own]:
            n[spelling(w)] -= c
            v[spelling(w)] -= 1
        self.below = np.log10(n + v + 1)
        self.size = self.own + 1 + CLASSES
        self.shares = (np.append(tokens, n) + 1) / (tokens.sum() + n.sum() + self.size)

    def read(self, text: str | None) -> tuple[np.ndarray, float, float, int, Counter]:
        """Symbols with the end; sums over its common words; how many; the others, counted."""
        tokens = words(text)
        at = np.array(list(map(self.index.get, tokens, [-1] * len(tokens))), np.int64)
        common = at >= 0
        known = at[common]
        symbols = np.full(len(tokens) + 1, self.own, np.uint16)
        symbols[:-1][common] = self.symbol[known]
        rest: Counter = Counter()
        for i in np.flatnonzero(~common).tolist():
            word = tokens[i].decode()
            rest[word] += 1
            symbols[i] = self.own + 1 + spelling(word)
        classes = symbols.astype(np.int64) - self.own - 1
        within = self.log_count[known[known >= self.own]].sum() - self.below[classes[classes >= 0]].sum()
        return symbols, float(self.log_count[known].sum()), float(within), len(known), rest


def scored(docs: DataFrame, training: Column, *, id_column: str = "doc_id", text_column: str = "text", states: int = 8, rounds: int = 5, own: int = 4096, common: int = 150_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each input row.

    Tokens are words and one end; a null text is empty and has the end alone. base_score is the
    add-one unigram log10 probability under the training tokens, score the model's. Every word
    of every training text is counted, and all of them train the model in each of the `rounds`
    Baum-Welch passes, whose expected counts are added up across partitions. Exact counts of the
    `common` commonest words travel to the tasks, the counts of the others, none of them frequent,
    are joined. Without training texts every symbol is as likely as another.
    Repeated rows and null ids stay; other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = stored(count_words(rows), name="counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The end is a token like any other, but never among the words: its count goes its own way.
    ends = (counts.where(F.col("word") == END).first() or (END, 0))[1]
    words_alone = counts.where(F.col("word") != END)
    # The least count that at most `common` words reach, from a histogram of a bounded size.
    steps = words_alone.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()
    least, total = 1 << 62, 0
    for r in steps:
        if (total := total + r.n) > common:
            break
        least = r.c
    top = [(r.word, r.c) for r in words_alone.where(F.col("c") >= least).collect()]
    classes = words_alone.groupBy(spelling_column("word").alias("g")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    vocabulary = Vocabulary(top, ends, {r.g: (r.n, r.v) for r in classes.collect()}, own)
    shared = spark.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "training", "number", "symbols", "logs", "within", "known", "rest"]
        for batch in batches:
            got = [shared.value.read(x) for x in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))
            cols = [pa.array([g[0].tobytes() for g in got], pa.binary()), *(pa.array([g[k] for g in got], t) for k, t in ((1, pa.float64()), (2, pa.float64()), (3, pa.int64())))]
            rest = pa.array([[{"word": w, "n": n} for w, n in g[4].items()] for g in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *cols, rest], names=names)

    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    texts = stored(map_batches(numbered, read, "doc_id long, training boolean, number long, symbols binary, logs double, within double, known long, rest array<struct<word string, n int>>"), name="symbols")

    model = Model.begin(states, vocabulary.shares)
    for _ in range(rounds if size.n else 0):
        model = across(texts.where("training").select("symbols"), model, vocabulary.shares)

    trained = spark.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, symbols in gathered(batches, 1):
            logs = trained.value.log_likelihoods(symbols) / np.log(10)
            k = 0
            for b in held:
                n = b.num_rows
                lengths = [len(x) for x in symbols[k : k + n]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lengths, pa.int64()), b.column(3), b.column(4), b.column(5), pa.array(logs[k : k + n])], names=["doc_id", "number", "n_tokens", "logs", "within", "known", "forward"])
                k += n

    known = map_batches(texts.select("doc_id", "symbols", "number", "logs", "within", "known"), likelihood, "doc_id long, number long, n_tokens long, logs double, within double, known long, forward double")
    rare = texts.select("number", F.explode("rest").alias("r")).select("number", "r.word", "r.n")
    looked = rare.join(words_alone.where(F.col("c") < least), "word", "left").groupBy("number").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    end = float(np.log10(ends + 1))
    base = F.col("logs") + rare_logs + F.lit(end) - F.col("n_tokens") * F.log10(F.lit(float(size.n + size.v + 1)))
    seen = F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(size.n > 0))
    return known.join(looked, "number", "left").select("doc_id", "n_tokens", seen.cast("long").alias("n_known"), F.lit(int(size.n)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("forward") + F.col("within") + rare_logs).alias("score"))


def across(symbols: DataFrame, model: Model, shares: np.ndarray) -> Model:
    """One Baum-Welch round over all texts of symbols: expected counts per task, summed by Spark."""
    states, size = len(model.start), len(shares)
    shared = symbols.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, texts in gathered(batches, 0):
            flat = np.concatenate([x.ravel() for x in shared.value.expected(texts)])
            total = flat if total is None else total + flat
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "weight"])

    # At most states * (1 + states + symbols) rows come back, whatever the input.
    cells = map_batches(symbols, run, "cell int, weight double").groupBy("cell").agg(F.sum("weight").alias("weight")).toPandas()
    flat = np.zeros(states + states * states + size * states)
    flat[cells.cell.to_numpy()] = cells.weight.to_numpy()
    start, move, emit = np.split(flat, [states, states + states * states])
    return model.maximised(start, move.reshape(states, states), emit.reshape(size, states), shares)
