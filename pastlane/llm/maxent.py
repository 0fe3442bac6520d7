"""Language-model scores by a hashed maximum-entropy model (operator 2).

P(token | history) = P(class | history) * P(token | class, history). Both factors are softmaxes over
weights of hashed features of the history: the last word, the last two words, and the words
two, three and four back alone (skips). The most frequent words are in classes that are cut from
the words' contexts, so words of one language or use share a class. All other words are in
classes by their first letters, where a word has its smoothed relative frequency and one part is
kept for unknown words; the probabilities of all tokens add up to one after any history.

Texts are read once: the hashes of their tokens are written to the shared folder, and every pass reads them there.
Counts are of all training rows: tasks count their own words, Spark adds them up, and the
table of counts stays a table. Weights are learnt by gradient updates at every position of every training row
in each round: each task goes on from the shared
weights, and the tasks' weights are averaged by how often each was met, in groups of bounded
size. Rows are scored in numpy batches with the weights of the features they have. Words beyond the
remembered ones get their counts by a join.

A null text is empty: it has the end token only. Repeated rows are scored each. Without training rows
every word is unknown; an empty table has no rows. Of words that are as frequent those of smaller hashes are remembered. One very
long text is held whole by its task, with 9 bytes a token. Only the id, the text and what ``train`` looks at are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastlane.llm.arrays import Lookup, Words, mix, slices, utf8
from pastlane.llm.components import written

HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 32, 96, 32
CLASSES = HEAD_CLASSES + TAIL_CLASSES
# Words whose counts tasks remember: the bound of that table. Others get theirs by a join.
REMEMBERED = 1 << 17
ROWS = 1 << 13  # weight rows of each factor
CONTEXTS = 64
ROUNDS = 1  # each takes all positions
BATCH = 4096
PACKED_BYTES = 1 << 19  # of hashes that a task looks at together
RATE = (0.12, 0.06)  # of the first round and of later ones
FAN_IN = 64
BLOCK = 256  # rows of a block of weights
SIDE_BY_SIDE = 16  # members of the spans that are added up together
COUNTED = 2_000_000  # words a task holds before it counts them
NEAR = 1024  # rows of weights that are worked on together: they stay in a core's cache
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
CLASS_FEATURES, WORD_FEATURES = 5, 2
SMOOTH = 0.1


class Tokens:
    """The tokens of a slice of texts: hashes of words, an end after each text; rows and histories."""

    def __init__(self, hash_: np.ndarray, letters: np.ndarray, n: np.ndarray):
        self.hash, self.letters, self.n, self.rows = hash_, letters, n, len(n)
        ends = np.cumsum(self.n) - 1
        self.doc = np.repeat(np.arange(self.rows), self.n)
        self.place = np.arange(len(self.hash)) - np.repeat(ends - self.n + 1, self.n)

    @classmethod
    def of_texts(cls, column: pa.Array) -> Tokens:
        words = Words(column)
        n = words.n + 1
        hash_ = np.empty(int(n.sum()), np.uint64)
        is_end = np.zeros(len(hash_), bool)
        is_end[np.cumsum(n) - 1] = True
        hash_[~is_end], hash_[is_end] = words.hashes(), END
        # The class of a word that is not remembered: by its first two bytes.
        first = words.bytes[words.start].astype(np.int64)
        second = np.where(words.end - words.start > 1, words.bytes[np.minimum(words.start + 1, max(len(words.bytes) - 1, 0))], 0)
        letters = np.zeros(len(hash_), np.int64)
        letters[~is_end] = (first * 31 + second * 17) % TAIL_CLASSES
        return cls(hash_, letters, n)

    @classmethod
    def unpacked(cls, hashes: pa.Array, letters: pa.Array) -> Tokens:
        raw, at = utf8(hashes)
        return cls(np.frombuffer(raw.tobytes(), np.uint64), utf8(letters)[0].astype(np.int64), np.diff(at) // 8)

    def packed(self) -> list[pa.Array]:
        """The hashes and the letters of each row as bytes."""
        ends = np.r_[0, np.cumsum(self.n)]
        return [pa.Array.from_buffers(pa.binary(), self.rows, [None, pa.py_buffer((ends * wide).astype(np.int32)), pa.py_buffer(data)])
                for wide, data in ((8, self.hash.tobytes()), (1, self.letters.astype(np.uint8).tobytes()))]

    def before(self, at: np.ndarray, k: int) -> np.ndarray:
        """The token k back of each place; a fixed one before the beginning."""
        found = self.hash[np.maximum(at - k, 0)]
        return np.where(self.place[at] >= k, found, START)

    def features(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the history's features, a column for each."""
        one, two, three, four = (self.before(at, k) for k in (1, 2, 3, 4))
        raw = np.stack([one, two, one * np.uint64(3) + two * np.uint64(5), three, four], axis=1)
        return mix(raw + _SALTS)


def _weight_rows(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)


@dataclass
class Model:
    lookup: Lookup  # remembered words
    counts: np.ndarray  # of each remembered word
    of_class: np.ndarray  # head class of each remembered word, or -1
    slot: np.ndarray  # its place in the class
    class_bias: np.ndarray
    word_bias: np.ndarray  # head class x place
    tail_mass: np.ndarray  # by tail class
    class_weights: np.ndarray
    word_weights: np.ndarray

    def known(self, tokens: Tokens) -> np.ndarray:
        """The number of each token among the remembered words, or -1."""
        number = np.full(len(tokens.hash), -1, np.int64)
        at, which = self.lookup.find(tokens.hash)
        number[at] = which
        return number

    def classes(self, tokens: Tokens, number: np.ndarray) -> np.ndarray:
        own = np.where(number >= 0, self.of_class[np.maximum(number, 0)], -1) if len(self.of_class) else np.full(len(number), -1)
        return np.where(own >= 0, own, HEAD_CLASSES + tokens.letters)

    def class_logits(self, rows: np.ndarray) -> np.ndarray:
        return self._sum(self.class_weights, rows) + self.class_bias

    def word_logits(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return self._sum(self.word_weights, rows) + self.word_bias[classes]

    @staticmethod
    def _sum(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.empty((len(rows), weights.shape[1]), weights.dtype)
        part = np.empty((min(NEAR, len(rows)), weights.shape[1]), weights.dtype)
        columns = np.ascontiguousarray(rows.T)
        for start in range(0, len(rows), NEAR):
            own = total[start:start + NEAR]
            more = part[:len(own)]
            weights.take(columns[0, start:start + NEAR], axis=0, out=own, mode="clip")
            for column in columns[1:]:
                own += weights.take(column[start:start + NEAR], axis=0, out=more, mode="clip")
        return total

    def word_rows(self, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The weight rows of a word's features, which are those of the history with the class."""
        salt = (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return _weight_rows(mix(features[:, :WORD_FEATURES] + salt[:, None]))

    def score(self, tokens: Tokens, number: np.ndarray) -> np.ndarray:
        """Natural log probability of each token, but for the count of words that are in tail classes."""
        total = np.zeros(len(tokens.hash))
        classes = self.classes(tokens, number)
        for start in range(0, len(total), BATCH):
            at = np.arange(start, min(start + BATCH, len(total)))
            features, own = tokens.features(at), classes[at]
            found = _log_softmax(self.class_logits(_weight_rows(features)), own)
            head = np.flatnonzero(own < HEAD_CLASSES)
            if len(head):
                logits = self.word_logits(self.word_rows(features[head], own[head]), own[head])
                found[head] += _log_softmax(logits, self.slot[number[at[head]]])
            tail = np.flatnonzero(own >= HEAD_CLASSES)
            found[tail] -= np.log(self.tail_mass[own[tail] - HEAD_CLASSES])
            total[at] = found
        return total


def _exponentials(logits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Makes logits their exponentials in place; the sums of rows, and what was taken from each row before.

    ``own`` has one logit of each row. Logits near logarithms of counts need no shift: a row's largest, which is dear to find,
    is taken off only if one could overflow or the own one vanish.
    """
    top = 0.0
    if len(own) and not (logits.max() < 75 and own.min() > -60):
        top = logits.max(axis=1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype), top


def _log_softmax(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    own = logits[np.arange(len(logits)), chosen]
    sums, top = _exponentials(logits, own)
    return own.astype(float) - top - np.log(sums, dtype=np.float64)


class Learner:
    """A task's own weights, which go on from the shared ones by Adagrad."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.weights = [model.class_weights.copy(), model.word_weights.copy()]
        self.squares = [np.full_like(x, 1e-3) for x in self.weights]
        self.met = [np.zeros(ROWS, np.int64), np.zeros(ROWS, np.int64)]

    def step(self, tokens: Tokens, number: np.ndarray, classes: np.ndarray, at: np.ndarray) -> None:
        model = self.model
        features, own = tokens.features(at), classes[at]
        rows = _weight_rows(features)
        self._update(0, rows, Model._sum(self.weights[0], rows) + model.class_bias, own)
        head = np.flatnonzero(own < HEAD_CLASSES)
        if len(head):
            rows = model.word_rows(features[head], own[head])
            logits = Model._sum(self.weights[1], rows) + model.word_bias.take(own[head], axis=0)
            self._update(1, rows, logits, model.slot[number[at[head]]])

    def _update(self, which: int, rows: np.ndarray, logits: np.ndarray, chosen: np.ndarray) -> None:
        places = np.arange(len(logits)), chosen
        sums, _ = _exponentials(logits, logits[places])
        logits *= (1 / sums)[:, None]
        logits[places] -= 1  # the gradient, the same for all features
        flat = rows.ravel().astype(np.min_scalar_type(ROWS - 1))  # numbers of two bytes are sorted by radix
        order = np.argsort(flat, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
        times = np.diff(np.r_[begin, len(order)])
        often = np.argsort(-times, kind="stable")
        begin, times = begin[often], times[often]
        touched = flat[order[begin]].astype(np.int64)
        gradient = _sums(logits, order // rows.shape[1], begin, times)
        self.met[which][touched] += times
        weights, squares = self.weights[which], self.squares[which]
        buffers = np.empty((2, min(NEAR, len(touched)), weights.shape[1]), weights.dtype)
        for start in range(0, len(touched), NEAR):
            part, change = touched[start:start + NEAR], gradient[start:start + NEAR]
            own, square = buffers[:, :len(part)]
            squares.take(part, axis=0, out=square, mode="clip")
            square += np.multiply(change, change, out=own)
            squares[part] = square
            np.divide(change, np.sqrt(square, out=square), out=change)
            change *= np.float32(self.rate)
            weights.take(part, axis=0, out=own, mode="clip")
            own -= change
            weights[part] = own


def _sums(values: np.ndarray, owner: np.ndarray, begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sums of ``values[owner]`` over spans from ``begin``, the longest first.

    Short spans are added up side by side, one member of each at a time: much cheaper than ``reduceat``.
    """
    total = values.take(owner[begin], axis=0)
    long = int(np.searchsorted(-times, -SIDE_BY_SIDE))  # spans of more members
    ones = np.ones(times[0] if long else 0, values.dtype)
    for k in range(long):
        total[k] = ones[:times[k]] @ values.take(owner[begin[k]:begin[k] + times[k]], axis=0)
    part = np.empty((NEAR, values.shape[1]), values.dtype)
    for member in range(1, SIDE_BY_SIDE):
        stop = int(np.searchsorted(-times, -member))  # spans that have this member
        if stop <= long:
            break
        for start in range(long, stop, NEAR):
            end = min(start + NEAR, stop)
            total[start:end] += values.take(owner[begin[start:end] + member], axis=0, out=part[:end - start], mode="clip")
    return total


def packed_tokens(docs: DataFrame) -> DataFrame:
    """(id, trained, hashes, letters) of rows (id, trained, text), written once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *Tokens.of_texts(part.column(2)).packed()], ["id", "trained", "hashes", "letters"])

    kind = dict(docs.dtypes)["id"]
    return written(docs.mapInArrow(pack, f"id {kind}, trained boolean, hashes binary, letters binary"), "tokens")


def _token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Slices of packed rows with their tokens; the last two columns are the hashes and the letters."""
    for batch in batches:
        hashes = batch.column(batch.num_columns - 2)
        for start, stop in slices(hashes, PACKED_BYTES):
            part = batch.slice(start, stop - start)
            yield part, Tokens.unpacked(part.column(batch.num_columns - 2), part.column(batch.num_columns - 1))


def _token_counts(tokens: DataFrame) -> DataFrame:
    """(word, letters, c): the counts of all tokens (hashes, letters), words as hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, tokens in _token_slices(batches):
            held.append((tokens.hash, tokens.letters))
            size += len(tokens.hash)
            if size >= COUNTED:
                yield summed(held)
                held, size = [], 0
        if held:
            yield summed(held)

    def summed(held):
        words, letters = (np.concatenate(x) for x in zip(*held, strict=True))
        word, first, n = np.unique(words, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(letters[first], pa.int32()), pa.array(n)],
                                          ["word", "letters", "c"])

    return tokens.mapInArrow(count, "word long, letters int, c long").groupBy("word").agg(
        F.first("letters").alias("letters"), F.sum("c").alias("c"))


def _classes_of(signature: np.ndarray) -> np.ndarray:
    """Cuts words into classes of equal size along the directions in which their contexts differ most."""
    share = np.sqrt(signature / np.maximum(signature.sum(axis=1, keepdims=True), 1))
    share = share - share.mean(axis=0)
    _, _, axes = np.linalg.svd(share, full_matrices=False)
    points = share @ axes[:6].T
    found = np.zeros(len(points), np.int64)

    def cut(rows, low, high):
        if high - low == 1 or len(rows) < 2:
            found[rows] = low
            return
        axis = int(np.argmax(points[rows].var(axis=0)))
        order = rows[np.argsort(points[rows, axis], kind="stable")]
        middle = (low + high) // 2
        cut(order[:len(rows) * (middle - low) // (high - low)], low, middle)
        cut(order[len(rows) * (middle - low) // (high - low):], middle, high)

    cut(np.arange(len(points)), 0, HEAD_CLASSES)
    return found


def _start_model(tokens: DataFrame, counts: DataFrame) -> Model:
    """The model of counts alone: classes, biases, and weights of 0."""
    top = counts.orderBy(F.desc("c"), "word").limit(REMEMBERED).toArrow()
    words, number = top["word"].to_numpy().view(np.uint64), top["c"].to_numpy()
    lookup = Lookup(words)
    order = np.argsort(words)
    c = number[order]  # now in the order of the lookup
    heads = np.flatnonzero(order < HEAD_CLASSES * CLASS_WORDS)  # the words of these ranks
    model = Model(lookup, c, np.full(len(c), -1), np.zeros(len(c), np.int64), np.zeros(CLASSES, np.float32),
                  np.full((HEAD_CLASSES, CLASS_WORDS), -1e4, np.float32), np.zeros(TAIL_CLASSES),
                  np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, CLASS_WORDS), np.float32))
    shared = tokens.sparkSession.sparkContext.broadcast((lookup, heads))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, heads = shared.value
        place = np.full(len(lookup.values) + 1, -1)
        place[heads] = np.arange(len(heads))
        total = np.zeros(len(heads) * CONTEXTS, np.int64)
        for _, tokens in _token_slices(batches):
            at, which = lookup.find(tokens.hash)
            head = place[which] >= 0
            at, own = at[head], place[which[head]]
            for k in (1, 2):
                context = (mix(tokens.before(at, k)) >> np.uint64(64 - CONTEXTS.bit_length() + 1)).astype(np.int64)
                total += np.bincount(own * CONTEXTS + context, minlength=len(total))
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], ["cell", "n"])

    signature = np.zeros(len(heads) * CONTEXTS)
    if len(heads):
        table = tokens.mapInArrow(contexts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        signature[table["cell"].to_numpy()] = table["n"].to_numpy()  # head words x CONTEXTS
        model.of_class[heads] = _classes_of(signature.reshape(len(heads), CONTEXTS))
    mass = np.zeros(CLASSES)
    for k in range(HEAD_CLASSES):
        own = heads[model.of_class[heads] == k]
        model.slot[own] = np.arange(len(own))
        model.word_bias[k, :len(own)] = np.log(c[own] + SMOOTH)
        mass[k] = c[own].sum()
    inside = pa.table({"word": pa.array(lookup.values[heads].view(np.int64), pa.int64())})
    spark = tokens.sparkSession
    heads_table = F.broadcast(spark.createDataFrame(inside))  # HEAD_CLASSES * CLASS_WORDS rows at most
    for row in counts.join(heads_table, "word", "left_anti").groupBy("letters").agg(
            F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # TAIL_CLASSES rows
        mass[HEAD_CLASSES + row.letters] = row.c
        model.tail_mass[row.letters] = row.c + SMOOTH * row.v
    model.tail_mass += SMOOTH  # a part for words that are not known
    model.class_bias[:] = np.where(np.r_[np.bincount(model.of_class[heads], minlength=HEAD_CLASSES) > 0,
                                         np.ones(TAIL_CLASSES, bool)], np.log(mass + 0.5), -1e4)
    return model


def _round(tokens: DataFrame, model: Model, round_: int) -> None:
    """Gradient updates in every task, and the average of their weights into the model."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(shared.value, RATE[min(round_, len(RATE) - 1)])
        for _, tokens in _token_slices(batches):
            number = shared.value.known(tokens)
            classes = shared.value.classes(tokens, number)
            places = np.random.default_rng(len(tokens.hash)).permutation(len(tokens.hash))
            for begin in range(0, len(places), BATCH):
                learner.step(tokens, number, classes, places[begin:begin + BATCH])
        task = TaskContext.get().partitionId()
        for which in (0, 1):
            met, weights = learner.met[which], learner.weights[which]
            for block in range(ROWS // BLOCK):
                part = slice(block * BLOCK, (block + 1) * BLOCK)
                if met[part].any():
                    sums = weights[part] * met[part, None]
                    yield _block(which * ROWS // BLOCK + block, task, met[part], sums)

    schema = "block int, task long, met binary, sums binary"
    partial = tokens.mapInArrow(learn, schema)
    # Tasks' weights meet in groups of FAN_IN, and those again, until one is left of each block.
    while True:
        partial = partial.withColumn("task", F.floor(F.col("task") / FAN_IN))
        partial = written(partial.groupBy("block", "task").applyInArrow(_added, schema), "weights")
        if not partial.agg(F.max("task")).first()[0]:
            break
    for row in partial.collect():  # the model's own size
        which, block = divmod(row.block, ROWS // BLOCK)
        target = model.word_weights if which else model.class_weights
        met = np.frombuffer(row.met, np.float64)
        sums = np.frombuffer(row.sums, np.float32).reshape(BLOCK, -1)
        on = np.flatnonzero(met)
        target[block * BLOCK + on] = sums[on] / met[on, None].astype(np.float32)


def _block(block: int, task: int, met: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([task], pa.int64()), pa.array([met.astype(np.float64).tobytes()], pa.binary()),
         pa.array([sums.astype(np.float32).tobytes()], pa.binary())], ["block", "task", "met", "sums"])


def _added(table: pa.Table) -> pa.Table:
    met = sum(np.frombuffer(x.as_py(), np.float64) for x in table["met"])
    sums = sum(np.frombuffer(x.as_py(), np.float32) for x in table["sums"])
    return pa.Table.from_batches([_block(table["block"][0].as_py(), table["task"][0].as_py(), met, sums)])


def maxent_scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row; log10.

    ``train`` says which rows the model learns from; rows where it is null are only scored.
    """
    docs = docs.select(F.col(key).alias("id"), F.coalesce(train, F.lit(False)).alias("trained"), F.col(text).alias("text"))
    packed = packed_tokens(docs)
    learnt = packed.where("trained").select("hashes", "letters")
    counts = written(_token_counts(learnt), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, different = sums.n or 0, sums.v
    model = _start_model(learnt, counts)
    if total:
        for round_ in range(ROUNDS):
            _round(learnt, model, round_)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "id", "trained", "n_tokens", "n_known", "base", "score", "words", "times"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = shared.value, TaskContext.get().partitionId() << 40
        log_count = np.log(model.counts + SMOOTH)
        for part, tokens in _token_slices(batches):
            number = model.known(tokens)
            known = number >= 0
            own_log = np.where(known, log_count[np.maximum(number, 0)], 0.0) if len(log_count) else np.zeros(len(number))
            tail = model.classes(tokens, number) >= HEAD_CLASSES
            score = model.score(tokens, number) + np.where(tail, own_log, 0.0)
            add = lambda x: np.bincount(tokens.doc, x, minlength=tokens.rows)
            # What is not remembered, with its number of times in the row.
            at = np.flatnonzero(~known)
            at = at[np.lexsort((tokens.hash[at], tokens.doc[at]))]
            new = np.flatnonzero(np.r_[True, (np.diff(tokens.doc[at]) != 0) | (tokens.hash[at][1:] != tokens.hash[at][:-1])]) if len(at) else at
            times = np.diff(np.r_[new, len(at)])
            ends = pa.array(np.searchsorted(tokens.doc[at[new]], np.arange(tokens.rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(tokens.rows), pa.int64()), part.column(0), part.column(1), pa.array(tokens.n, pa.int64()),
                pa.array(add(known).astype(np.int64)), pa.array(add(own_log)), pa.array(add(score)),
                pa.ListArray.from_arrays(ends, pa.array(tokens.hash[at[new]].view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))], names)
            row += tokens.rows

    kind = dict(docs.dtypes)["id"]
    rows = written(packed.mapInArrow(scored, f"row long, id {kind}, trained boolean, n_tokens long, n_known long, base double, "
                                           "score double, words array<long>, times array<int>"), "scores")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times")
    found = rare.join(counts.select(F.col("word").alias("words"), "c"), "words", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
    more, base = F.coalesce("more", F.lit(0.0)), F.log(F.lit(total + SMOOTH * (different + 1)))
    return rows.drop("words", "times").join(found, "row", "left").select(
        "id", "trained", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        ((F.col("base") + more - F.col("n_tokens") * base) / F.log(F.lit(10.0))).alias("base_score"),
        ((F.col("score") + more) / F.log(F.lit(10.0))).alias("score"))
