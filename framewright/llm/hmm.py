"""A hidden Markov language model over words, trained and scored at scale.

States emit word classes; a word's probability within its class is its own
smoothed count. Classes are hashes of whole short words and of the endings of
long ones, so their number is fixed and the state tables (``CLASSES`` rows)
have a proven size whatever the corpus, while word counts grow with it and are
only ever joined, never broadcast.

One pass cuts the documents into blocks of about ``BLOCK`` tokens: a row with
word numbers local to the block, its distinct words and their training counts.
A block's words are then dealt to slots by a hash, packed, so that a slot has
all blocks' rows of its words (about ``SLOT`` entries, and of a common word one
small entry a block). Each slot sums its counts and sends back to the blocks
only those that differ from the block's own, so words of one block alone, most
of a vocabulary, never travel back.

Baum-Welch covers every training document from the start: its first counts
come from documents dealt to states whole, by random projections of their
classes, so that documents of like words start in one state; then ``PASSES``
passes. Each task adds up expected counts of its blocks, rows of one class meet
by a grouped sum, and the driver sees ``CLASSES`` sums. Forward and backward
recursions are scaled at every token and walk all documents of a block
together. Nothing depends on how rows are laid out, but for rounding.

Defined cases: null text is empty and scores its end alone; ids may repeat or
be null (null hashes as ''); with no training rows every word has probability
one within its class and states are those of the background; texts of any
length are one sequence; equal rows are scored and counted each; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from math import log, log10

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.shared import bucket, lengths_of, materialize, raw

STATES = 8
#: Word classes; the last one is the end of a text alone.
CLASSES = 1 << 16
END = CLASSES - 1
#: Words of more bytes are classed by their last ``SUFFIX`` bytes.
LONG, SUFFIX = 6, 4
BLOCK = 1_500_000
#: Words of blocks that one slot counts.
SLOT = 1_000_000
PASSES = 3
#: Weight, in tokens, of the class background in a state's emissions.
PRIOR = 200.0
#: Fold of ids that is held out.
FOLDS, HELD = 7, 2


def class_of(word: bytes) -> int:
    """The class of a lower-cased word."""
    return zlib.crc32(word if len(word) <= LONG else b"~" + word[-SUFFIX:]) % END


class Model:
    """Start, transition and emission probabilities of the states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit  # emit: classes x states

    @classmethod
    def first(cls, start: np.ndarray, emit: np.ndarray, background: np.ndarray, seed: int = 3) -> Model:
        """States that stay, from counts of the documents dealt to each.

        A third of a state's emissions is background, and each class is
        disturbed, so that states of like documents differ too.
        """
        states = len(start)
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        noise = np.random.default_rng(seed).gamma(1.0, 1.0, emit.shape)
        e = (emit + (PRIOR + 0.5 * emit.sum(axis=0)) * background[:, None]) * (0.2 + noise)
        return cls((start + 1) / (start + 1).sum(), move / move.sum(axis=1, keepdims=True), (e / e.sum(axis=0)).astype(np.float32))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, background: np.ndarray) -> Model:
        """Maximisation: expected counts to probabilities."""
        e = emit + PRIOR * background[:, None]
        return cls((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), (e / e.sum(axis=0)).astype(np.float32))


def _walk(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents from long to short, and how many have a token at each step."""
    order = np.argsort(-size, kind="stable")
    n = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left")
    return order, n


def log_likelihood(classes: np.ndarray, size: np.ndarray, model: Model) -> np.ndarray:
    """Natural log probability of each document by the scaled forward pass.

    ``classes`` holds the documents' class sequences end to end; each has at
    least its end.
    """
    order, active = _walk(size)
    first = (np.cumsum(size) - size)[order]
    out = np.zeros(len(size))
    alpha = model.start * model.emit[classes[first]]
    for t, n in enumerate(active.tolist()):
        if t:
            alpha = (alpha[:n] @ model.move) * model.emit[classes[first[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        out[:n] += np.log(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def expected(classes: np.ndarray, size: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions (forward-backward)."""
    states = len(model.start)
    order, active = _walk(size)
    first = (np.cumsum(size) - size)[order]
    gamma = np.empty((len(classes), states), np.float32)
    scales = np.empty(len(classes))
    alpha = model.start * model.emit[classes[first]]
    for t, n in enumerate(active.tolist()):
        at = first[:n] + t
        if t:
            alpha = (alpha[:n] @ model.move) * model.emit[classes[at]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        gamma[at], scales[at] = alpha, scale
    move = np.zeros((states, states))
    beta = np.ones((len(size), states))
    turned = model.move.T.copy()
    for t in range(len(active) - 1, 0, -1):
        n = int(active[t])
        at = first[:n] + t
        b = beta[:n] * model.emit[classes[at]] / scales[at][:, None]
        gamma[at] *= beta[:n]
        move += gamma[at - 1].T @ b  # gamma holds alpha there still
        beta[:n] = b @ turned
    gamma[first] *= beta
    emit = np.stack([np.bincount(classes, weights=gamma[:, k], minlength=CLASSES) for k in range(states)], axis=1)
    return gamma[first].sum(axis=0, dtype=np.float64), move * model.move, emit


class Numbers(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of blocks, in one pass over the texts.

    A block has its documents' doc_ids, held flags and sizes in words, their
    ids (int32 local word numbers, without ends), and by local number the
    words (joined by line feeds), classes (uint16) and counts in training
    documents; n_words and n_train count its words and training documents.
    """
    kind = docs.select(F.col(doc_id)).schema[0].dataType
    packed = [T.StructField(c, T.BinaryType()) for c in ("held", "sizes", "ids", "words", "classes", "tf")]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), *packed, T.StructField("n_words", T.LongType()), T.StructField("n_train", T.LongType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        number, own, held, runs, total = Numbers(), [], [], [], 0

        def closed() -> pd.DataFrame:
            ids, size = np.concatenate(runs), lengths_of(runs)
            tf = np.bincount(ids[np.repeat(~np.array(held, bool), size)], minlength=len(number))
            words = list(number)
            cls = np.fromiter(map(class_of, words), "<u2", len(words))
            row = [part << 32 | seq, list(own), np.array(held, np.uint8).tobytes(), size.astype("<i8").tobytes(), ids.astype("<i4").tobytes(), b"\n".join(words), cls.tobytes(), tf.astype("<i4").tobytes(), len(words), held.count(False)]
            return pd.DataFrame([row], columns=schema.names)

        for batch in batches:
            for d, h, t in zip(batch["doc_id"], batch["held"], batch["text"], strict=True):
                words = raw(t).lower().split()
                run = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                own.append(d)
                held.append(h)
                runs.append(run)
                total += len(run) + 1
                if total >= BLOCK:
                    yield closed()
                    number, own, held, runs, total, seq = Numbers(), [], [], [], 0, seq + 1
        if own:
            yield closed()

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (bucket(F.col(doc_id), FOLDS) == HELD).alias("held"))
    return source.mapInPandas(cut, schema)


def counted(table: DataFrame) -> DataFrame:
    """Training counts over all blocks: two kinds of rows.

    With a block: packed local numbers and the counts of those words whose
    count is not the block's own. With a class: training tokens ``n`` and
    distinct words ``v`` of it among a slot's words.
    """
    slots = max(1, -(-(table.agg(F.sum("n_words")).first()[0] or 0) // SLOT))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                words = row.words.split(b"\n")
                slot = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % slots
                order = np.argsort(slot, kind="stable")
                cls, tf, slot = np.frombuffer(row.classes, "<u2")[order], np.frombuffer(row.tf, "<i4")[order], slot[order]
                cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(words)]
                own, place = order.tolist(), order.astype("<i4")
                yield pd.DataFrame(
                    [(int(slot[a]), row.block, place[a:b].tobytes(), b"\n".join([words[i] for i in own[a:b]]), cls[a:b].tobytes(), tf[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])],
                    columns=["slot", "block", "local", "words", "classes", "tf"],
                )

    def count(part: pd.DataFrame) -> pd.DataFrame:
        number, codes = Numbers(), []
        for words in part["words"]:
            codes.append(np.fromiter(map(number.__getitem__, words.split(b"\n")), np.int32))
        flat = np.concatenate(codes)
        c = np.bincount(flat, weights=np.concatenate([np.frombuffer(x, "<i4") for x in part["tf"]])).astype(np.int64)
        cls = np.zeros(len(c), np.int64)
        cls[flat] = np.concatenate([np.frombuffer(x, "<u2") for x in part["classes"]])
        out = []
        for block, local, tf, code in zip(part["block"], part["local"], part["tf"], codes, strict=True):
            own = c[code]
            more = own != np.frombuffer(tf, "<i4")
            if more.any():
                out.append((block, np.frombuffer(local, "<i4")[more].tobytes(), own[more].astype("<i8").tobytes()))
        n, v = np.bincount(cls, weights=c), np.bincount(cls[c > 0], minlength=int(cls.max()) + 1)
        seen = np.flatnonzero(v)
        empty = [None] * len(seen)
        rows = {"block": [x[0] for x in out] + empty, "local": [x[1] for x in out] + empty, "c": [x[2] for x in out] + empty}
        none = [None] * len(out)
        rows |= {"class": none + seen.tolist(), "n": none + n[seen].astype(np.int64).tolist(), "v": none + v[seen].tolist()}
        return pd.DataFrame(rows).astype({"block": "Int64", "class": "Int32", "n": "Int64", "v": "Int64"})

    dealt = table.where("n_words > 0").select("block", "words", "classes", "tf").mapInPandas(deal, "slot long, block long, local binary, words binary, classes binary, tf binary")
    return dealt.groupBy("slot").applyInPandas(count, "block long, local binary, c binary, class int, n long, v long")


def _sequences(row: pd.Series | tuple, training: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class sequences with ends, their sizes, and places of the words."""
    size = np.frombuffer(row.sizes, "<i8")
    ids = np.frombuffer(row.ids, "<i4")
    cls = np.frombuffer(row.classes, "<u2")
    if training:
        learns = np.frombuffer(row.held, np.uint8) == 0
        ids, size = ids[np.repeat(learns, size)], size[learns]
    full = np.full(len(ids) + len(size), END, np.uint16)
    ends = np.cumsum(size + 1) - 1
    word = np.ones(len(full), bool)
    word[ends] = False
    full[word] = cls[ids]
    return full, size + 1, word


Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def dealt_whole(classes: np.ndarray, size: np.ndarray, direction: np.ndarray, centre: np.ndarray) -> Sums:
    """Counts of starts and emissions with each document in one state.

    The state is the direction in which the mean of a document's classes lies
    furthest from the ``centre``, that of the whole corpus.
    """
    states = direction.shape[1]
    mean = np.add.reduceat(direction[classes], np.cumsum(size) - size, axis=0) / size[:, None] - centre
    state = mean.argmax(axis=1)
    of = np.repeat(state, size)
    emit = np.stack([np.bincount(classes[of == k], minlength=CLASSES) for k in range(states)], axis=1)
    return np.bincount(state, minlength=states).astype(float), np.zeros((states, states)), emit.astype(float)


def _total(table: DataFrame, states: int, count: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
    """Sums of ``count`` over all training documents of all blocks."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((CLASSES + 1 + states, states))
        for batch in batches:
            for row in batch.itertuples(index=False):
                full, size, _ = _sequences(row, True)
                if len(size):
                    start, move, emit = count(full, size)
                    sums[:CLASSES] += emit
                    sums[CLASSES] += start
                    sums[CLASSES + 1 :] += move
        seen = np.flatnonzero(sums.any(axis=1))
        yield pd.DataFrame({"row": seen} | {f"s{k}": sums[seen, k] for k in range(states)})

    found = table.select("held", "sizes", "ids", "classes").mapInPandas(gather, "row int, " + ", ".join(f"s{k} double" for k in range(states)))
    total = np.zeros((CLASSES + 1 + states, states))
    for r in found.groupBy("row").agg(*[F.sum(f"s{k}") for k in range(states)]).collect():  # CLASSES rows and a few
        total[r[0]] = r[1:]
    return total[CLASSES], total[CLASSES + 1 :], total[:CLASSES]


def directions(states: int = STATES, seed: int = 7) -> np.ndarray:
    """A random vector for each class."""
    return np.random.default_rng(seed).normal(size=(CLASSES, states)).astype(np.float32)


def train(table: DataFrame, background: np.ndarray, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch over every training document of :func:`blocks`."""
    context = table.sparkSession.sparkContext
    shared = context.broadcast((directions(states), background @ directions(states)))
    start, _, emit = _total(table, states, lambda full, size: dealt_whole(full, size, *shared.value))
    shared.unpersist()
    model = Model.first(start, emit, background)
    for _ in range(passes):
        shared = context.broadcast((model.start, model.move, model.emit))
        model = Model.from_counts(*_total(table, states, lambda full, size: expected(full, size, Model(*shared.value))), background)
        shared.unpersist()
    return model


def smoothed(in_class: np.ndarray) -> np.ndarray:
    """Shares of classes in training tokens, none of them zero."""
    return (in_class + 0.5) / (in_class + 0.5).sum()


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """Base and model log10 probability of every document.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score.
    """
    spark = docs.sparkSession
    table, _ = materialize(blocks(docs, doc_id, text), "blocks")
    counts, _ = materialize(counted(table), "counts")
    in_class, of_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where(F.col("class").isNotNull()).groupBy("class").agg(F.sum("n"), F.sum("v")).collect():  # CLASSES rows at most
        in_class[r[0]], of_class[r[0]] = r[1], r[2]
    ends = table.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    tokens = int(in_class.sum()) + ends
    distinct = int(of_class.sum()) + (ends > 0)
    in_class[END] = ends
    whole = table.select("block", "doc_ids", "held", "sizes", "ids", "classes", "tf")
    model = train(whole, smoothed(in_class), passes=passes)
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit, in_class, of_class))
    kind = docs.select(F.col(doc_id)).schema[0].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        start, move, emit, n_class, v_class = shared.value
        out = []
        for row in left.itertuples(index=False):
            cls = np.frombuffer(row.classes, "<u2")
            c = np.frombuffer(row.tf, "<i4").astype(float)
            for local, more in zip(right["local"], right["c"], strict=True):
                c[np.frombuffer(local, "<i4")] = np.frombuffer(more, "<i8")
            full, size, word = _sequences(row, False)
            ids = np.frombuffer(row.ids, "<i4")
            of = np.repeat(np.arange(len(size)), size)
            add = lambda end, x: np.bincount(of, weights=_placed(word, x[ids], end), minlength=len(size))  # noqa: E731,B023
            within = np.log10((c + 1) / (n_class[cls] + v_class[cls] + 1))
            base = add(log10(ends + 1), np.log10(c + 1)) - size * log10(tokens + distinct + 1)
            known = add(float(ends > 0), (c > 0).astype(float))
            like = log_likelihood(full, size, Model(start, move, emit)) / log(10) + add(0.0, within)
            out.append(pd.DataFrame({"doc_id": list(row.doc_ids), "held_out": np.frombuffer(row.held, np.uint8) == 1, "n_tokens": size, "n_known": known.astype(np.int64), "train_tokens": tokens, "base_score": base, "score": like}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=schema.names)

    back = counts.where(F.col("block").isNotNull()).select(F.col("block").alias("of"), "local", "c")
    return whole.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(score, schema)


def _placed(word: np.ndarray, values: np.ndarray, end: float) -> np.ndarray:
    out = np.full(len(word), end)
    out[word] = values
    return out
