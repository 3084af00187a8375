"""Operator 11: toxicity by a convolutional text classifier over hashed word embeddings.

A word is a run of letters (ASCII letters, A-Z as a-z, and all other characters beyond ASCII). Its embedding is the sum of
three hashed rows: the word, its first 4 and its first 6 bytes, so that unseen forms of a known stem are not blank. Filters
of 1, 2 and 3 words run over every position of the whole text; the greatest value of each filter (max pooling) goes into
one logistic unit. Everything is trained here in numpy by backpropagation: of a pooled value only the place of the maximum
gets a slope, so a step touches a few hundred rows of the table.

Training takes every labelled document, each distinct text of an id once. Documents are dealt by the hash of id and text
into blocks of about ``block_rows`` rows and ``block_bytes`` bytes; a block is the work of a task. Each task steps through
its block from the same start; after every round the moves are averaged (rows of the table by how often a block touched
them, the rest by documents) and the next round starts from there. The start, too, rests on counts over all blocks. Up to
one block there is nothing to average and a task does all rounds. A fifth of each block is not trained on but
calibrates: scores are mapped to probabilities (Platt), weighted back to the classes' shares among all labelled rows, and
each language gets the threshold that separates its calibration rows best, shrunk towards the common one by its
number of toxic rows. Of several blocks all calibration rows count, with their logits rounded to 1/``GRID``. Language only
chooses that threshold; it is never an input of a score.

The model has a fixed size (``BUCKETS`` x ``DIM`` numbers) and goes to the tasks whole; texts are scored where they are
read, in slices of bounded bytes and windows of bounded words, and nothing is shuffled.

Defined results: a null text counts as an empty one and has the score of no words; very long texts are read in pieces
whose maxima are combined; null and repeated ids get one row each and never name labels if null; contradicting labels of
an id are averaged, a half counts as toxic; null labels are none; without labelled rows of both classes every score is the
smoothed share of toxic rows; null languages and those without toxic calibration rows get the common threshold; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklake.llm.common import arrow_rows, broadcast_if_small, byte_batches, labelled_sample, text_bytes, text_or_empty, workspace  # noqa: F401
from peaklake.llm.wordhash import _VALUES, _powers, mix

BLOCK_ROWS, BLOCK_BYTES = 12_000, 48 << 20
BUCKETS, DIM = 1 << 18, 8
WIDTHS, FILTERS = (1, 2, 3), 8
PAD = max(WIDTHS) - 1  # empty words behind each text
PREFIXES = (4, 6)
DROP = 0.25  # share of words and longer stems that a training step leaves out
LEAST_DOCS, PRIOR_DOCS = 3, 10  # rows of fewer training documents stay zero; documents as which the base rate counts in the rest
EPOCHS, LEAST_STEPS, BATCH_DOCS, RATE = 4, 200, 64, 0.03
THRESHOLD = 0.7  # common threshold, for languages without calibration rows
SHRINK = 20.0  # toxic rows as which the common threshold counts
SLICE_BYTES, PIECE_WORDS = 1 << 19, 1 << 16
CHUNK = 1 << 12  # rows of the table that are added up together
REST = -1  # chunk of everything beside the table
GRID, WIDEST = 256, 60.0  # calibration logits of several blocks: steps of 1 and the greatest

U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def word_rows(joined: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the embedding table of every word, first word of every text and the number of all words)."""
    letter = _LETTER[joined]
    inner = cuts[1:-1]
    inner = inner[(inner > 0) & (inner < len(joined))]
    before, after = np.zeros_like(letter), np.zeros_like(letter)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    up, down = _powers(max(19, int(len(joined) + 1).bit_length()))
    sums = np.zeros(len(joined) + 1, U)
    np.cumsum(_VALUES[joined] * up[: len(joined)], out=sums[1:])
    rows = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    for k, stop in enumerate((ends, *(np.minimum(starts + n, ends) for n in PREFIXES))):
        hashes = mix((sums[stop] - sums[starts]) * down[starts] + (stop - starts).astype(U) + U(k << 32))
        rows[:, k] = 1 + hashes % U(BUCKETS - 1)
    return rows, np.searchsorted(starts, cuts)


@dataclass
class Net:
    """Embedding table, filters (width x DIM x FILTERS each), their bases, the logistic unit and the calibration."""

    table: np.ndarray
    filters: list[np.ndarray]
    bases: np.ndarray
    unit: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0
    share: float | None = None  # score of everything if there was nothing to train on
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = THRESHOLD

    def dump(self) -> bytes:
        out = io.BytesIO()
        used = np.flatnonzero(self.table.any(axis=1))
        langs = sorted(self.thresholds)
        np.savez(
            out, used=used, rows=self.table[used], bases=self.bases, unit=self.unit, langs=np.array(langs, str), cut=np.array([self.thresholds[k] for k in langs]),
            rest=np.array([self.base, self.slope, self.shift, np.nan if self.share is None else self.share, self.common]), **{f"f{w}": f for w, f in zip(WIDTHS, self.filters, strict=True)},
        )
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Net:
        z = np.load(io.BytesIO(data))
        table = np.zeros((BUCKETS, DIM), np.float32)
        table[z["used"]] = z["rows"]
        base, slope, shift, share, common = z["rest"].tolist()
        thresholds = dict(zip(z["langs"].tolist(), z["cut"].tolist(), strict=True))
        return Net(table, [z[f"f{w}"] for w in WIDTHS], z["bases"], z["unit"], base, slope, shift, None if np.isnan(share) else share, thresholds, common)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        out = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            out += self.table[rows[:, k]]
        return out

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """Rectified values of all filters at the positions of ``x`` but the last ``PAD``."""
        n = len(x) - PAD
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for k, f in enumerate(self.filters):
            part = x[:n] @ f[0]
            for o in range(1, len(f)):
                part += x[o : o + n] @ f[o]
            out[:, k * FILTERS : (k + 1) * FILTERS] = part
        out += self.bases
        return np.maximum(out, 0, out=out)

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The greatest value of each filter in each text, piece by piece."""
        padded, start = pad(rows, first)
        best = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        for a in range(0, len(padded), PIECE_WORDS):
            b = min(a + PIECE_WORDS, len(padded))
            piece = padded[a : b + PAD]
            if len(piece) < b - a + PAD:
                piece = np.concatenate((piece, np.zeros((b - a + PAD - len(piece), rows.shape[1]), np.int32)))
            values = self.convolve(self.embed(piece))
            values[piece[: b - a, 0] == 0] = 0  # windows begin at words only
            lo, hi = np.searchsorted(start, a, "right") - 1, np.searchsorted(start, b, "left")
            edges = np.maximum(start[lo:hi] - a, 0)
            found = np.maximum.reduceat(values, edges, axis=0)
            best[lo:hi] = np.maximum(best[lo:hi], found)
        return best

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(rows, first) @ self.unit + self.base

    def scores(self, joined: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(cuts) - 1, self.share)
        return sigmoid(self.slope * self.logits(*word_rows(joined, cuts)).astype(np.float64) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def pad(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with ``PAD`` empty words behind every text, where each text begins)."""
    n = len(first) - 1
    out = np.zeros((len(rows) + PAD * n, rows.shape[1]), np.int32)
    out[np.arange(len(rows)) + PAD * np.repeat(np.arange(n), np.diff(first))] = rows
    return out, first[:-1] + PAD * np.arange(n)


class Training:
    """Backpropagation through the pooled maxima; Adam for the filters, Adagrad for the touched rows of the table."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, seed: int | tuple[int, ...] = 1, found: tuple[np.ndarray, np.ndarray, float] | None = None):
        """``found``: (documents, toxic documents of every row of the table, smoothed share of toxic ones) if known of more texts."""
        self.texts, self.y = texts, labels.astype(np.float64)
        self.draw = np.random.default_rng(seed)
        self.net = self._start(*(found or (*evidence(texts, self.y), (self.y.sum() + 1) / (len(self.y) + 2))))
        self.dense = [*self.net.filters, self.net.bases, self.net.unit]
        self.m, self.v = [np.zeros_like(p) for p in self.dense], [np.zeros_like(p) for p in self.dense]
        self.squares = np.full(BUCKETS, 1e-3, np.float32)
        self.touched = np.zeros(BUCKETS, np.int32)  # steps that moved a row
        self.step = 0

    def _start(self, docs: np.ndarray, toxic: np.ndarray, share: float) -> Net:
        """Random filters; a table whose first column is the smoothed evidence of each row, zero where it is rare."""
        self.live = docs >= LEAST_DOCS
        self.live[0] = False
        rate = (toxic + PRIOR_DOCS * share) / (docs + PRIOR_DOCS)
        table = self.draw.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        table[:, 0] = 0.3 * (np.log(rate / (1 - rate)) - np.log(share / (1 - share)))
        table[~self.live] = 0
        filters = [self.draw.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[0, 0] = np.abs(f[0, 0])
        unit = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        return Net(table, filters, np.zeros(len(unit), np.float32), unit, float(np.log(share / (1 - share))))

    def run(self) -> Net:
        """``EPOCHS`` times over the texts, on few texts more often."""
        self._epochs(max(EPOCHS, -(-LEAST_STEPS * BATCH_DOCS // len(self.texts))))
        return self.net

    def _epochs(self, times: int) -> None:
        for _ in range(times):
            order = self.draw.permutation(len(self.texts))
            for a in range(0, len(order), BATCH_DOCS):
                self._batch(order[a : a + BATCH_DOCS])

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """(table and squares of its rows, everything else)."""
        rest = [p.ravel() for p in (*self.dense, *self.m, *self.v)] + [np.array([self.net.base, self.step])]
        return np.column_stack((self.net.table, self.squares)), np.concatenate(rest)

    def resume(self, rows: np.ndarray, rest: np.ndarray, live: np.ndarray) -> Training:
        self.net.table, self.squares, self.live = rows[:, :DIM].copy(), rows[:, DIM].copy(), live
        at = 0
        for p in (*self.dense, *self.m, *self.v):
            p[...] = rest[at : at + p.size].reshape(p.shape)
            at += p.size
        self.net.base, self.step = float(rest[at]), int(round(rest[at + 1]))
        return self

    def round(self) -> Iterator[tuple[int, np.ndarray]]:
        """One of ``EPOCHS`` rounds; then (chunk, weighted moves and weights of its rows) and (``REST``, the rest by documents, documents)."""
        before, _ = self.state()
        self.touched[:] = 0
        self._epochs(max(1, -(-LEAST_STEPS * BATCH_DOCS // (EPOCHS * len(self.texts)))))
        rows, rest = self.state()
        weight = self.touched.astype(np.float32)
        moves = np.column_stack(((rows - before) * weight[:, None], weight))
        yield from chunks(moves)
        yield REST, np.append(rest, 1.0) * len(self.texts)

    def _batch(self, chosen: np.ndarray) -> None:
        net, n = self.net, len(chosen)
        places, words, pooled = [], [], np.empty((n, len(net.unit)), np.float32)
        for d, i in enumerate(chosen):  # one text after another: the maxima of a text are found with its rows at hand
            n_words = len(self.texts[i])
            rows = np.concatenate((self.texts[i], np.zeros((PAD + (n_words == 0), 1 + len(PREFIXES)), np.int32)))
            rows[self.draw.random(len(rows)) < DROP, 0] = 0  # a stem must do without the whole word, and without its longer form
            rows[self.draw.random(len(rows)) < DROP, -1] = 0
            best, at = np.zeros(len(net.unit), np.float32), np.zeros(len(net.unit), np.int64)
            for a in range(0, n_words, PIECE_WORDS):
                values = net.convolve(net.embed(rows[a : a + PIECE_WORDS + PAD]))
                top = values.argmax(axis=0)
                now = values[top, np.arange(len(top))]
                at, best = np.where(now > best, a + top, at), np.maximum(best, now)
            pooled[d] = best
            places.append(at)
            words.append(rows[at[:, None] + np.arange(PAD + 1)])  # filters x words x hashed rows
        words = np.stack(words)
        error = ((sigmoid(pooled @ net.unit + net.base) - self.y[chosen]) / n).astype(np.float32)
        back = (error[:, None] * net.unit) * (pooled > 0)
        slopes, touched, moves = [], [], []
        for k, f in enumerate(net.filters):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            g, slope = back[:, cols], np.empty_like(f)
            for o in range(len(f)):
                rows = words[:, cols, o]
                x = net.table[rows].sum(axis=2)
                slope[o] = np.einsum("df,dfk->kf", g, x)
                move = g[:, :, None] * f[o].T
                for j in range(rows.shape[2]):
                    touched.append(rows[:, :, j].ravel())
                    moves.append(move.reshape(-1, DIM))
            slopes.append(slope)
        slopes += [back.sum(axis=0), pooled.T @ error]
        self.step += 1
        for p, g, m, v in zip(self.dense, slopes, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * 0.3 * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)
        net.base -= RATE * float(error.sum())
        rows, owner = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(rows), DIM), np.float32)
        np.add.at(total, owner, np.concatenate(moves))
        total[~self.live[rows]] = 0
        self.touched[rows] += 1
        self.squares[rows] += (total**2).mean(axis=1)
        net.table[rows] -= RATE * total / np.sqrt(self.squares[rows])[:, None]


def evidence(texts: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, toxic documents) that have each row of the table."""
    docs, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for rows, label in zip(texts, y, strict=True):
        seen = np.unique(rows)
        docs[seen] += 1
        toxic[seen] += int(label)
    return docs, toxic


def chunks(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of ``CHUNK`` rows in which anything differs from zero."""
    for k in range(0, len(rows), CHUNK):
        if rows[k : k + CHUNK].any():
            yield k // CHUNK, rows[k : k + CHUNK]


def calibrate(net: Net, logits: np.ndarray, toxic: np.ndarray, langs: list[str | None], share: float) -> None:
    """Set slope and shift, then the thresholds."""
    if not platt(net, logits, toxic, np.ones(len(toxic)), share):
        return
    names = np.array([x if x is not None else "" for x in langs])
    for lang in sorted({x for x in langs if x is not None}):
        own = names == lang
        if toxic[own].any():
            net.thresholds[lang] = own_threshold(net, logits[own], toxic[own], np.ones(own.sum()))


def platt(net: Net, logits: np.ndarray, toxic: np.ndarray, times: np.ndarray, share: float) -> bool:
    """Set slope and shift by weighted logistic regression on smoothed targets and the common threshold; false without both classes.

    A row stands for ``times`` rows.
    """
    n1, n0 = (toxic * times).sum(), ((1 - toxic) * times).sum()
    if n1 == 0 or n0 == 0:
        return False
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic == 1, share / n1, (1 - share) / n0) * times.sum() * times
    at = np.array([1.0, 0.0])
    x = np.stack([logits, np.ones(len(logits))], axis=1)

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(weight @ (np.logaddexp(0, z) - target * z) + 5e-4 * at[0] ** 2)

    for _ in range(50):  # Newton steps, halved until the loss falls
        p = sigmoid(x @ at)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        move = np.linalg.solve(hess, x.T @ (weight * (p - target)) + np.array([1e-3, 0]) * at)
        size = 1.0
        while size > 1e-6 and loss(at - size * move) > loss(at):
            size /= 2
        at = at - size * move
        if size * np.abs(move).max() < 1e-8:
            break
    net.slope, net.shift = float(max(at[0], 1e-3)), float(at[1])
    net.common = _threshold(sigmoid(net.slope * logits + net.shift), toxic, times, THRESHOLD)
    return True


def own_threshold(net: Net, logits: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> float:
    """The threshold of a language with toxic rows, shrunk towards the common one."""
    n = int((toxic * times).sum())
    found = _threshold(sigmoid(net.slope * logits + net.shift), toxic, times, net.common)
    return float((n * found + SHRINK * net.common) / (n + SHRINK))


def _threshold(score: np.ndarray, toxic: np.ndarray, times: np.ndarray, default: float) -> float:
    """The middle of the gap at which rate of caught less rate of wrongly caught rows is greatest."""
    if toxic.min() == toxic.max():
        return default
    order = np.argsort(-score, kind="stable")
    s, t, clean = score[order], (toxic * times)[order], ((1 - toxic) * times)[order]
    gain = np.cumsum(t) / t.sum() - np.cumsum(clean) / clean.sum()
    gain[:-1][s[:-1] == s[1:]] = -1
    k = int(gain.argmax())
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def known_labels(labels: DataFrame) -> DataFrame:
    """(id, toxic) of the labelled documents."""
    rows = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("toxic"))
    return rows.groupBy("id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> Net:
    """Train on all documents that ``labels`` (doc_id, toxic) names; ``block_rows`` and ``block_bytes`` bound the work of a task."""
    work = workspace(docs.sparkSession, "toxicity")
    known = work.stage(known_labels(labels), "labels")
    counts = dict(known.groupBy("toxic").count().collect())
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("id is not null").withColumn("h", F.xxhash64("t"))
    langs = texts.select("id", "lang").join(broadcast_if_small(known), "id").groupBy("id").agg(F.first("toxic").alias("toxic"), F.min("lang").alias("lang"))
    named = broadcast_if_small(work.stage(langs, "named"))
    narrow = texts.select("id", "h", F.octet_length("t").alias("size")).join(named, "id").groupBy("id", "h").agg(F.max("size").alias("size"))
    rows, size = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, -(-rows // block_rows), -(-size // block_bytes))
    block = F.pmod(F.xxhash64(F.lit("block"), "id", "h"), F.lit(blocks)).cast("int")
    dealt = texts.drop("lang").join(named, "id").withColumn("block", block).repartition(1 if blocks == 1 else 3 * blocks, "block")  # three times: few blocks share a task
    once = dealt.dropDuplicates(["block", "id", "h", "t"])
    ordered = once.sortWithinPartitions("block", F.md5(F.concat_ws(":", "id", "h")), "id", "h").select("block", "t", "toxic", "lang")
    with arrow_rows(docs.sparkSession):
        net = train_whole(ordered, share) if blocks == 1 else train_blocks(ordered, share)
    work.close()
    return net


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[str | None]]]:
    """(block, words of its texts, labels, languages) of every block of a task, whose rows come one block after another."""
    now, texts, toxic, langs = -1, [], [], []
    for batch in byte_batches(batches):
        rows, first = word_rows(*text_bytes(batch.column("t")))
        columns = (batch.column(x).to_pylist() for x in ("block", "toxic", "lang"))
        for a, b, block, y, lang in zip(first[:-1], first[1:], *columns, strict=True):
            if block != now:
                if texts:
                    yield now, texts, np.array(toxic), langs
                now, texts, toxic, langs = block, [], [], []
            texts.append(rows[a:b].copy())
            toxic.append(y)
            langs.append(lang)
    if texts:
        yield now, texts, np.array(toxic), langs


def train_whole(ordered: DataFrame, share: float) -> Net:
    """Rows of a single block, in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, toxic, langs in read_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([train(texts, toxic, langs, share).dump()], pa.binary())], ["net"])

    found = ordered.mapInArrow(solve, "net binary").collect()
    return Net.load(found[0]["net"]) if found else train([], np.zeros(0), [], share)


def added_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the arrays (chunk, block, data as single precision) of every chunk, in the order of the blocks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "data"])
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                part = np.frombuffer(data.as_buffer(), np.float32)
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, total = chunk, np.zeros(len(part))
                total += part
        if now is not None:
            yield done()

    sums = parts.repartition("chunk").sortWithinPartitions("chunk", "block").mapInArrow(add, "chunk int, data binary")
    return {r["chunk"]: np.frombuffer(r["data"]) for r in sums.collect()}


def whole_table(sums: dict[int, np.ndarray], columns: int) -> np.ndarray:
    out = np.zeros((BUCKETS, columns))
    for k, data in sums.items():
        if k != REST:
            out[k * CHUNK : (k + 1) * CHUNK] = data.reshape(-1, columns)
    return out


def fitted_rows(texts: list[np.ndarray]) -> np.ndarray:
    return np.flatnonzero(np.arange(len(texts)) % 5 != 4)


def train_blocks(ordered: DataFrame, share: float) -> Net:
    """Rows of many blocks: counts over all, rounds of steps in each with their moves averaged, calibration by all."""
    kept = ordered.persist(StorageLevel.DISK_ONLY)
    part = "chunk int, block int, data binary"

    def parts(block: int, arrays: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for k, data in arrays:
            columns = [pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([data.astype(np.float32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "block", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts, toxic, _ in read_blocks(batches):
            own = fitted_rows(texts)
            yield from parts(block, chunks(np.column_stack(evidence([texts[i] for i in own], toxic[own]))))
            yield from parts(block, [(REST, np.array([len(own), toxic[own].sum()]))])

    sums = added_up(kept.mapInArrow(count, part))
    n, n1 = sums[REST]
    if n1 in (0, n):
        kept.unpersist()
        return train([], np.zeros(0), [], share)
    docs, toxic = whole_table(sums, 2).T
    run = Training([], np.zeros(0), 1, (docs, toxic, (n1 + 1) / (n + 2)))
    live = run.live
    for k in range(EPOCHS):
        rows, rest = run.state()
        sums = added_up(kept.mapInArrow(steps(k, rows, rest, live, parts), part))
        moves = whole_table(sums, DIM + 2)
        rows = rows + (moves[:, :-1] / np.maximum(moves[:, -1:], 1)).astype(np.float32)
        run.resume(rows, sums[REST][:-1] / sums[REST][-1], live)
    calibrate_blocks(run.net, kept, share)
    kept.unpersist()
    return run.net


def steps(k: int, rows: np.ndarray, rest: np.ndarray, live: np.ndarray, parts):
    """The work of round ``k`` on the blocks of a task, from the given state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(BUCKETS, np.int64)
        for block, texts, toxic, _ in read_blocks(batches):
            own = fitted_rows(texts)
            at = Training([texts[i] for i in own], toxic[own], (1, k, block), (nothing, nothing, 0.5)).resume(rows, rest, live)
            yield from parts(block, at.round())

    return run


def calibrate_blocks(net: Net, kept: DataFrame, share: float) -> None:
    """``calibrate`` by all rows of the blocks that were not fitted, counted by language, label and rounded logit."""
    data = net.dump()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net.load(data)
        for _, texts, toxic, langs in read_blocks(batches):
            held = range(4, len(texts), 5)
            logits = [float(own.logits(texts[i], np.array([0, len(texts[i])]))[0]) for i in held]
            at = np.rint(np.clip(logits, -WIDEST, WIDEST) * GRID).astype(np.int32)
            columns = [pa.array(at, pa.int32()), pa.array(toxic[4::5], pa.int32()), pa.array([langs[i] for i in held], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["at", "toxic", "lang"])

    counted = kept.mapInArrow(place, "at int, toxic int, lang string").groupBy("lang", "toxic", "at").agg(F.count("*").alias("times"))
    work = workspace(kept.sparkSession, "toxicity")
    counted = work.stage(counted, "calibration")
    common = counted.groupBy("toxic", "at").agg(F.sum("times").alias("times")).orderBy("at", "toxic").toPandas()
    if platt(net, common["at"].to_numpy() / GRID, common["toxic"].to_numpy(), common["times"].to_numpy(np.float64), share):
        net_at = Net(np.zeros((1, DIM), np.float32), [], net.bases, net.unit, net.base, net.slope, net.shift, common=net.common)

        def own(rows):
            rows = rows.sort_values(["at", "toxic"])
            cut = own_threshold(net_at, rows["at"].to_numpy() / GRID, rows["toxic"].to_numpy(), rows["times"].to_numpy(float))
            return rows[["lang"]].head(1).assign(cut=cut)

        some = counted.where("toxic = 1 and lang is not null").select("lang").distinct()
        found = counted.join(some, "lang").groupBy("lang").applyInPandas(own, "lang string, cut double")
        net.thresholds = {r["lang"]: r["cut"] for r in found.orderBy("lang").collect()}
    work.close()


def train(texts: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], share: float) -> Net:
    held = np.arange(len(texts)) % 5 == 4
    fitted, rest = np.flatnonzero(~held), np.flatnonzero(held)
    if len(fitted) == 0 or len(np.unique(toxic[fitted])) < 2:
        zero = np.zeros((BUCKETS, DIM), np.float32)
        filters = [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS]
        return Net(zero, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0, share=share)
    net = Training([texts[i] for i in fitted], toxic[fitted]).run()
    if len(rest):
        logits = np.concatenate([net.logits(texts[i], np.array([0, len(texts[i])])) for i in rest])
        calibrate(net, logits.astype(np.float64), toxic[rest], [langs[i] for i in rest], share)
    return net


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, score, threshold, toxic) of every row: ``toxic`` by the threshold of the row's language."""
    data = net.dump()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net.load(data)
        for batch in byte_batches(batches, limit=SLICE_BYTES):
            found = np.round(own.scores(*text_bytes(batch.column("t"))), 6)
            cut = [own.thresholds.get(x, own.common) for x in batch.column("lang").to_pylist()]
            columns = [batch.column("id"), pa.array(found), pa.array(cut, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "score", "threshold"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, threshold double").withColumn("toxic", F.col("score") >= F.col("threshold"))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id as text has remainder 1 by 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def digest(scored: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, toxic) of ``score``'s rows."""
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", "toxic")
