"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

The probability of a word is that of its class, given the words before, times that of the word in its class. The class
is a softmax over hashed features of the context: the word before, the word two before (a skip), and the classes of the
three words before (an n-gram). Weights are trained by gradient updates in many tasks at once, whose models are averaged
by how often each saw a feature. Words within a class have a weight of their own only, whose best value follows from
counts, so that part is counted over the whole corpus instead of trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.common import SLICE_BYTES, Words, byte_parts, slices, text_or_empty, word_hashes
from bytesieve.session import materialize

# Frequent words whose counts every task knows, at most; others are looked up by a join.
HEAD_WORDS = 1 << 17
# Classes: the most frequent words have one each, other words are classed by how they begin and end.
OWN_CLASSES, SHAPE_CLASSES = 16, 16
CLASSES = OWN_CLASSES + SHAPE_CLASSES
# Hashed features of each of the three templates.
TEMPLATES, BUCKETS = 3, 1 << 12
# Groups of shards whose models are averaged first.
GROUPS = 64
# Tokens per gradient step, and tokens of one training shard, about.
STEP_TOKENS, TASK_TOKENS = 8192, 3_000_000
RATE = 0.3
# The token that ends a text: no word, since it is white space.
END = "\n"
BLOCK_ROWS = 512


def shape_class(words: pa.Array) -> np.ndarray:
    """Class of a word by its ending (four kinds of last byte) and a hash of its first two bytes (four values)."""
    data, offsets = byte_parts(words)
    starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    first, second = data[starts], data[np.minimum(starts + 1, ends - 1)]
    last = data[ends - 1]
    ending = np.full(len(words), 3)  # other signs
    ending[(last >= 97) & (last <= 122)] = 0
    ending[(last >= 128) | ((last >= 48) & (last <= 57))] = 1
    ending[(last == 44) | (last == 46) | (last == 10)] = 2
    begin = (first.astype(np.int64) * 31 + second * 17 + (first >> 3)) % 4
    return (ending * 4 + begin).astype(np.int64)


@dataclass
class Lexicon:
    """What every task knows of the words: the frequent ones with counts, and totals."""

    words: pa.Array
    counts: np.ndarray
    tokens: int
    vocabulary: int
    own: list[str]

    def places(self, vocabulary: pa.Array) -> np.ndarray:
        """Place of each word among the frequent ones, -1 for others."""
        return pc.fill_null(pc.index_in(vocabulary, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def classes(self, vocabulary: pa.Array) -> np.ndarray:
        own = pc.fill_null(pc.index_in(vocabulary, value_set=pa.array(self.own, pa.string())), -1)
        own = own.to_numpy(zero_copy_only=False)
        return np.where(own >= 0, own, OWN_CLASSES + shape_class(vocabulary))


class Tokens:
    """Tokens of texts with their ends, as codes of a vocabulary that holds END last, and the context features."""

    def __init__(self, texts: pa.Array, lexicon: Lexicon):
        words = Words(texts)
        self.vocabulary = pa.concat_arrays([words.vocabulary.cast(pa.string()), pa.array([END])])
        n = len(texts)
        self.offsets = words.offsets + np.arange(n + 1)
        codes = np.full(self.offsets[-1], len(words.vocabulary), np.int32)
        codes[np.arange(len(words.codes)) + words.rows] = words.codes
        self.codes = codes
        self.rows = np.repeat(np.arange(n), np.diff(self.offsets))
        self.word_class = lexicon.classes(self.vocabulary).astype(np.int32)
        self.classes = self.word_class[codes]
        # What stands i before each token; -1 before the text begins.
        place = np.arange(len(codes)) - self.offsets[:-1][self.rows]
        hashed = (word_hashes(self.vocabulary) % np.uint64(BUCKETS - 1)).astype(np.int32)
        word = hashed[codes]
        features = np.empty((TEMPLATES, len(codes)), np.int32)
        for template, back in ((0, 1), (1, 2)):
            features[template] = np.where(place >= back, np.roll(word, back), BUCKETS - 1)
        before = np.zeros(len(codes), np.int64)
        for back in (1, 2, 3):
            before = before * (CLASSES + 1) + np.where(place >= back, np.roll(self.classes, back), CLASSES)
        features[2] = (before * 2654435761 >> 7) % BUCKETS
        self.features = features


def class_scores(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Log-probabilities (natural) of all classes: rows of ``features`` are templates, columns tokens."""
    total = weights[0][features[0]]
    for template in range(1, TEMPLATES):
        total += weights[template][features[template]]
    total -= total.max(axis=1, keepdims=True)
    total -= np.log(np.exp(total).sum(axis=1, keepdims=True))
    return total


def _updates(weights: np.ndarray, square: np.ndarray, seen: np.ndarray, features: np.ndarray, classes: np.ndarray) -> None:
    """One adaptive gradient step on some tokens."""
    gradient = np.exp(class_scores(weights, features))
    gradient[np.arange(len(classes)), classes] -= 1
    for template in range(TEMPLATES):
        order = np.argsort(features[template].astype(np.int16), kind="stable")
        sorted_features = features[template][order]
        first = np.flatnonzero(np.diff(sorted_features, prepend=-1))
        touched = sorted_features[first]
        sums = np.add.reduceat(gradient[order], first, axis=0)
        square[template][touched] += sums * sums
        weights[template][touched] -= RATE * sums / np.sqrt(square[template][touched] + 1e-6)
        seen[template][touched] += np.diff(first, append=len(order))


def count_words(training: DataFrame) -> DataFrame:
    """(word, c) of all tokens of ``training`` texts, ends included; a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=16 << 20):
            words = Words(part.column(0))
            counts = np.bincount(words.codes, minlength=len(words.vocabulary))
            names = pa.concat_arrays([words.vocabulary.cast(pa.string()), pa.array([END])])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(counts, part.num_rows))], ["word", "c"])

    counted = training.select(text_or_empty()).mapInArrow(run, "word string, c long")
    return materialize(counted.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


def lexicon_of(counts: DataFrame, head: int = HEAD_WORDS) -> Lexicon:
    """The words at least as frequent as the lowest frequency step that keeps ``head`` of them or fewer."""
    tokens, vocabulary = counts.agg(F.sum("c"), F.count("*")).first()
    step = F.floor(F.log2("c") * 16).cast("long")
    steps = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    lowest, held = None, 0
    for row in steps:
        held += row["count"]
        if held > head:
            break
        lowest = row["step"]
    chosen = counts.where(step >= F.lit(lowest)) if lowest is not None else counts.limit(0)
    table = chosen.select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks()
    words = pa.array(table["word"].to_pylist(), pa.string())
    return Lexicon(
        words, table["c"].to_numpy(), int(tokens or 0), int(vocabulary or 0), words[:OWN_CLASSES].to_pylist()
    )


def class_totals(counts: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, words) of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            of = lexicon.classes(part.column(0).cast(pa.string()))
            sums = np.bincount(of, part.column(1).to_numpy(), CLASSES).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(CLASSES)), pa.array(sums), pa.array(np.bincount(of, minlength=CLASSES))],
                ["class", "tokens", "words"],
            )

    rows = counts.mapInArrow(run, "class long, tokens long, words long").groupBy("class")
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in rows.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        tokens[row["class"]], words[row["class"]] = row["tokens"], row["words"]
    return tokens, words


def shard_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(shard, texts) of rows (text, shard) sorted by shard, about ``size`` bytes at a time.

    Where a slice ends follows from the shard's own rows alone, however they came in batches: behind the row that fills
    it, and with the shard.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        held = yield from _whole_slices(held, size, False)
    if held is not None:
        yield from _whole_slices(held, size, True)


def _whole_slices(held: pa.Table, size: int, last: bool):
    """Yield the slices of ``held`` that are whole, returns the rows left; with ``last`` all are whole."""
    texts, shards = held["text"].combine_chunks(), held["shard"].to_numpy()
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(shards):
        before = ends[start - 1] if start else 0
        of_shard = start + int(np.searchsorted(shards[start:], shards[start], side="right"))
        stop = min(of_shard, int(np.searchsorted(ends, before + size, side="left")) + 1)
        if stop == len(shards) and not last and ends[-1] - before < size:
            break
        yield int(shards[start]), texts.slice(start, stop - start)
        start = stop
    return held.slice(start) if start < len(shards) else None


def train_classes(training: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Weights of the class softmax: (templates, buckets, classes).

    Texts are dealt to shards by their hash; the number of shards follows from the number of tokens. A shard is learned by
    one task, in the order of the hashes, so weights do not depend on how the rows were placed (but for the order
    in which sums are rounded). Every training text is seen once.
    A shard's model is sent in blocks of rows with the number of times each feature was seen, and blocks
    are averaged in two rounds, so that no task gathers those of many shards.
    """
    session = training.sparkSession
    shared = session.sparkContext.broadcast(lexicon)
    shards = max(1, -(-lexicon.tokens // TASK_TOKENS))
    rows = TEMPLATES * BUCKETS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, slices_of in groupby(shard_slices(batches), itemgetter(0)):
            weights = np.zeros((TEMPLATES, BUCKETS, CLASSES), np.float32)
            square = np.full_like(weights, 1e-2)
            seen = np.zeros((TEMPLATES, BUCKETS), np.float32)
            for _, texts in slices_of:
                tokens = Tokens(texts, shared.value)
                for start in range(0, len(tokens.codes), STEP_TOKENS):
                    step = slice(start, start + STEP_TOKENS)
                    _updates(weights, square, seen, tokens.features[:, step], tokens.classes[step])
            yield blocks(weights.reshape(rows, CLASSES), seen.reshape(rows), shard % GROUPS)

    def blocks(weights: np.ndarray, seen: np.ndarray, group: int) -> pa.RecordBatch:
        starts = range(0, rows, BLOCK_ROWS)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([start // BLOCK_ROWS for start in starts], pa.int64()),
                pa.array([group] * len(starts), pa.int64()),
                pa.array([seen[start : start + BLOCK_ROWS].astype("<f8").tobytes() for start in starts], pa.binary()),
                pa.array([weights[start : start + BLOCK_ROWS].astype("<f4").tobytes() for start in starts], pa.binary()),
            ],
            ["block", "group", "seen", "weights"],
        )

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, block = np.zeros(BLOCK_ROWS), np.zeros((BLOCK_ROWS, CLASSES)), None
        for batch in batches:
            for block, _, n, w in zip(*(column.to_pylist() for column in batch.columns), strict=True):  # noqa: B007
                times = np.frombuffer(n, "<f8")
                seen += times
                total += np.frombuffer(w, "<f4").reshape(BLOCK_ROWS, CLASSES) * times[:, None]
        mean = total / np.maximum(seen, 1)[:, None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.array([0], pa.int64()),
                pa.array([seen.astype("<f8").tobytes()], pa.binary()),
                pa.array([mean.astype("<f4").tobytes()], pa.binary()),
            ],
            ["block", "group", "seen", "weights"],
        )

    schema = "block long, group long, seen binary, weights binary"
    hashed = training.select(text_or_empty()).withColumn("hash", F.xxhash64("text"))
    dealt = hashed.withColumn("shard", F.pmod("hash", F.lit(shards))).repartition(shards, "shard")
    learned = dealt.sortWithinPartitions("shard", "hash", "text").select("text", "shard").mapInArrow(learn, schema)
    once = learned.groupBy("block", "group").applyInArrow(average, schema)
    weights = np.zeros((rows, CLASSES), np.float32)
    for row in once.groupBy("block").applyInArrow(average, schema).select("block", "weights").collect():
        at = row["block"] * BLOCK_ROWS
        weights[at : at + BLOCK_ROWS] = np.frombuffer(row["weights"], "<f4").reshape(BLOCK_ROWS, CLASSES)
    return weights.reshape(TEMPLATES, BUCKETS, CLASSES)


def score_texts(documents: DataFrame, training: DataFrame, head: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document, learning from ``training``.

    Tokens are the words, A-Z in lower case, and one end of text. base_score is the log10 probability under smoothed
    word counts, score that under the model. Null and blank texts are one end. Repeated rows give repeated results, a
    null doc_id stays null; other columns are ignored. Without training texts every word is unknown and classes are equally
    likely. Words beyond the frequent ones are summed per document and joined with the counts.
    """
    counts = count_words(training)
    lexicon = lexicon_of(counts, head)
    class_tokens, class_words = class_totals(counts, lexicon)
    weights = train_classes(training, lexicon)
    shared = documents.sparkSession.sparkContext.broadcast((lexicon, weights))
    # Chances of a word with c counts: (c + 0.5) over these, in the corpus and in its class.
    whole = lexicon.tokens + 0.5 * (lexicon.vocabulary + 1)
    in_class = class_tokens + 0.5 * (class_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = shared.value
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        log_count = np.log10(lexicon.counts + 0.5)
        for part in slices(batches):
            tokens = Tokens(part.column(1), lexicon)
            n, codes, rows = part.num_rows, tokens.codes, tokens.rows
            place = lexicon.places(tokens.vocabulary)[codes]
            log_class = np.empty(len(codes))
            for start in range(0, len(codes), 1 << 14):
                step = slice(start, start + (1 << 14))
                scores = class_scores(weights, tokens.features[:, step])
                log_class[step] = scores[np.arange(len(scores)), tokens.classes[step]]
            log_class = log_class / np.log(10) - np.log10(in_class)[tokens.classes]
            head = place >= 0
            known = np.bincount(rows[head], log_count[place[head]], n)
            # Words that are not frequent, with their number in each text.
            pairs, times = np.unique(rows[~head] * len(tokens.vocabulary) + codes[~head], return_counts=True)
            row, code = np.divmod(pairs, len(tokens.vocabulary))
            entries = pa.StructArray.from_arrays(
                [tokens.vocabulary.take(pa.array(code)), pa.array(times.astype(np.int64))], ["word", "times"]
            )
            ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            sizes = np.diff(tokens.offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + np.arange(n)),
                    part.column(0),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(np.bincount(rows[head], minlength=n).astype(np.int64)),
                    pa.array(known - sizes * np.log10(whole)),
                    pa.array(known + np.bincount(rows, log_class, n)),
                    pa.ListArray.from_arrays(pa.array(ends), entries),
                ],
                ["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare"],
            )
            number += n

    schema = (
        "row long, doc_id long, n_tokens long, n_known long, base double, model double, "
        "rare array<struct<word:string,times:long>>"
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    scored = materialize(texts.mapInArrow(run, schema), "lm-scores")
    c = F.coalesce("c", F.lit(0))
    rare = (
        scored.select("row", F.explode("rare").alias("rare"))
        .select("row", "rare.word", "rare.times")
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("times"))).alias("known"),
            F.sum(F.col("times") * F.log10(c + 0.5)).alias("chance"),
        )
    )
    chance = F.coalesce("chance", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + chance).alias("base_score"),
        (F.col("model") + chance).alias("score"),
    )
