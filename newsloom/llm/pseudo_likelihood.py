"""Masked pseudo-likelihood: a bidirectional window network scores every token from the tokens on both sides.

Every word of the corpus has its exact count. The HEAD most frequent words make classes of about equal mass; all rarer words are one class
more. A numpy network predicts a token's class from the classes of two tokens to the left and two to the right; within the class the words'
corpus counts decide. It is trained on every window, in parts that grow in number with the corpus: each part trains from the common state,
and the states are averaged. Rows are dealt to parts by their content, so that scores don't depend on files or partitions.
A document's score is the sum of log P(token | both sides) over all its tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import bounded_batches, query, saved, table
from newsloom.llm.words import signed, words_of

#: Words that the tasks hold with class and share; the counts of all others are joined.
HEAD = 1 << 19
CLASSES, HIDDEN, SIDE = 64, 32, 2
#: A part has about PART windows; a row's windows come in pieces of PIECE at most.
PART, PIECE = 1 << 18, 1 << 16
ROUNDS, BATCH = 2, 512
#: States that meet in one task, or in the driver, at most.
GROUPS = 32
#: Distinct words that a task holds before it hands on its counts.
_HELD = 1 << 20
_SHAPES = ((2 * SIDE, CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
_ORDER = [*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1), SIDE]


def _merged(hashes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return u, np.bincount(at, np.concatenate(counts), len(u)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, n``: occurrences of each word, by its 64-bit hash, in all documents."""

    def run(batches):
        hashes, counts, held = [], [], 0
        give = lambda h, n: pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "n"])
        for batch in batches:
            for w in words_of(batch.column("text")):
                u, n = np.unique(w.hash, return_counts=True)
                hashes.append(u)
                counts.append(n)
                held += len(u)
                if held > _HELD:
                    u, n = _merged(hashes, counts)
                    hashes, counts, held = [u], [n], len(u)
                    if held > _HELD // 2:
                        yield give(u, n)
                        hashes, counts, held = [], [], 0
        if held:
            yield give(*_merged(hashes, counts))

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def head_count(counts: DataFrame, head: int) -> tuple[int, int]:
    """(least count of a head word, occurrences of all words): at most ``head`` words have that count."""
    by = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow()
    n, words = np.asarray(by["n"]), np.asarray(by["words"])
    order = np.argsort(-n)
    fits = np.flatnonzero(np.cumsum(words[order]) <= head)
    if len(fits) == len(n):
        return 1, int((n * words).sum())
    return int(n[order][fits[-1]]) if len(fits) else int(n.max()) + 1, int((n * words).sum())


def classes_of(top: pa.Table, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hashes of the head words in order, their classes, their log shares in their classes, occurrences of all other words).

    Words by falling count are cut into classes of about equal mass. The words that aren't in the head, if any, are the last class.
    """
    h, n = np.asarray(top["h"]).view(np.uint64), np.asarray(top["n"]).astype(np.float64)
    rest = total - int(n.sum())
    classes = CLASSES - (rest > 0)
    order = np.lexsort((h, -n))
    before = np.cumsum(n[order]) - n[order]
    kind = np.zeros(len(h), np.uint8)
    kind[order] = np.minimum((before / max(n.sum(), 1) * classes).astype(np.int64), classes - 1)
    share = np.log(n / np.bincount(kind, n, CLASSES)[kind]).astype(np.float32)
    order = np.argsort(h)
    return h[order], kind[order], share[order], rest


def _look(vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, log share, in the head) of each word; words beyond the head are the last class, with share 0."""
    known, kind, share = vocabulary[:3]
    if not len(known):
        return np.full(len(hashes), CLASSES - 1, np.uint8), np.zeros(len(hashes)), np.zeros(len(hashes), bool)
    u, back = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(known, u), len(known) - 1)
    hit = known[at] == u
    return np.where(hit, kind[at], np.uint8(CLASSES - 1))[back], np.where(hit, share[at], 0.0)[back], hit[back]


def windows(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes to the left and right of each token, a row for each; CLASSES stands beyond the document's ends."""
    n = len(kinds)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, 2 * SIDE), CLASSES, np.uint8)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        to, src = slice(max(0, -step), n - max(0, step)), slice(max(0, step), n - max(0, -step))
        out[to, k] = np.where(doc[to] == doc[src], kinds[src], CLASSES)
    return out


def training_pieces(docs: DataFrame, vocabulary) -> DataFrame:
    """``key, piece, copy, n, w``: the classes of every row's tokens, with SIDE more on each side, in pieces of PIECE tokens.

    ``key`` comes from the row's content; equal rows are told by ``copy``, from 0 to their number.
    """

    def run(batches):
        for batch in batches:
            ids, keys, text = batch.column("doc_id"), batch.column("key"), batch.column("text")
            for w in words_of(text):
                kinds, out = _look(vocabulary.value, w.hash)[0], []
                for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    padded = np.full(b - a + 2 * SIDE, CLASSES, np.uint8)
                    padded[SIDE:-SIDE] = kinds[a:b]
                    for k, at in enumerate(range(0, b - a, PIECE)):
                        n = min(PIECE, b - a - at)
                        out.append((w.rows.start + i, k, n, padded[at:at + n + 2 * SIDE].tobytes()))
                if out:
                    row, piece, n, packed = zip(*out)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([ids.take(row), keys.take(row), pa.array(piece, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                                                     names=["doc_id", "key", "piece", "n", "w"])

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, piece long, n long, w binary")
    rows = rows.groupBy("doc_id", "key", "piece").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("w").alias("w"))
    return rows.select("key", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "n", "w")


def piece_windows(packed: bytes) -> np.ndarray:
    """The windows of a piece: context, then the token's own class."""
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(packed, np.uint8), 2 * SIDE + 1)[:, _ORDER]


def start_state(seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 0.1, s).ravel() for s in _SHAPES]).astype(np.float32)


def unpack(state: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in _SHAPES:
        n = int(np.prod(s))
        out.append(state[at:at + n].reshape(s))
        at += n
    return out


def forward(params: list[np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden layer, log-probabilities of the classes) for rows of context classes."""
    side, b1, out, b2 = params
    z = b1 + side[0][ctx[:, 0]]
    for k in range(1, ctx.shape[1]):
        z += side[k][ctx[:, k]]
    h = np.tanh(z)
    logit = h @ out + b2
    logit -= logit.max(axis=1, keepdims=True)
    return h, logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))


def _room(n: int) -> tuple[np.ndarray, ...]:
    """Arrays for ``n`` rows, which the steps fill again and again: two hidden layers, logits with a class to a row, a number for each row."""
    return np.empty((n, HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32), np.empty((CLASSES, n), np.float32), np.empty(n, np.float32)


def _logits(side: np.ndarray, b1: np.ndarray, out: np.ndarray, b2: np.ndarray, at: np.ndarray, room) -> None:
    """Hidden layer and logits, less their maximum, of rows whose contexts are the rows ``at[k]`` of ``side``: the hidden layer adds up rows of weights."""
    h, more, d, line = room
    side.take(at[0], axis=0, out=h, mode="clip")
    for k in range(1, 2 * SIDE):
        h += side.take(at[k], axis=0, out=more, mode="clip")
    h += b1
    np.tanh(h, out=h)
    np.dot(out.T, h.T, out=d)
    d += b2[:, None]
    d -= np.max(d, axis=0, out=line)


def target_log(params: list[np.ndarray], ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability of each row's own class: ``forward`` without the other classes' logarithms."""
    side, b1, out, b2 = params
    side, got = side.reshape(-1, HIDDEN), np.empty(len(ctx))
    at = ctx.T.astype(np.intp, order="C")
    at += np.arange(2 * SIDE)[:, None] * (CLASSES + 1)
    for i in range(0, len(ctx), BATCH):
        kind = target[i:i + BATCH].astype(np.intp)
        n = len(kind)
        if not i or n < BATCH:
            room, column = _room(n), np.arange(n)
        _logits(side, b1, out, b2, at[:, i:i + BATCH], room)
        d, line = room[2:]
        own = d.ravel()[kind * n + column]
        np.exp(d, out=d)
        got[i:i + BATCH] = own - np.log(np.sum(d, axis=0, out=line))
    return got


def train_part(state: np.ndarray, rows: np.ndarray, rate: float = 0.05, seed: int = 0) -> np.ndarray:
    """One pass of Adagrad over the windows of a part, from the given state."""
    state, rows = state.copy(), np.ascontiguousarray(rows)  # take() copies all of an array in any other order, each time
    grad, step, grad2 = np.empty_like(state), np.empty_like(state), np.full_like(state, 1e-6)
    side, b1, out, b2 = unpack(state)
    g_side, g_b1, g_out, g_b2 = unpack(grad)
    width = 2 * SIDE * (CLASSES + 1)
    side, g_side = side.reshape(width, HIDDEN), g_side.reshape(width, HIDDEN)
    # the way back is a product with one-hot columns; logits stand a class to a row, so that sums and maxima run along whole rows
    order = np.random.default_rng(seed).permutation(len(rows))
    at = rows.take(order, axis=0).T.astype(np.intp, order="C")
    at[:-1] += np.arange(2 * SIDE)[:, None] * (CLASSES + 1)
    for i in range(0, len(rows), BATCH):
        ctx, target = at[:-1, i:i + BATCH], at[-1, i:i + BATCH]
        n = len(target)
        if not i or n < BATCH:
            room, dz, hot, column = _room(n), np.empty((n, HIDDEN), np.float32), np.zeros((width, n), np.float32), np.arange(n)
        h, more, d, line = room
        _logits(side, b1, out, b2, ctx, room)
        np.exp(d, out=d)
        np.sum(d, axis=0, out=line)
        np.divide(np.float32(1 / n), line, out=line)
        d *= line
        d.ravel()[target * n + column] -= np.float32(1 / n)
        np.dot(d.T, out.T, out=dz)
        np.multiply(h, h, out=more)
        np.subtract(1, more, out=more)
        dz *= more
        ones = ctx * n + column
        hot.ravel()[ones] = 1
        np.dot(hot, dz, out=g_side)
        hot.ravel()[ones] = 0
        g_out[:] = np.dot(d, h).T
        np.sum(dz, axis=0, out=g_b1)
        np.sum(d, axis=1, out=g_b2)
        np.multiply(grad, grad, out=step)
        grad2 += step
        np.sqrt(grad2, out=step)
        np.divide(grad, step, out=step)
        step *= np.float32(rate)
        state -= step
    return state


def train(parts: DataFrame, count: int) -> np.ndarray:
    """The averaged state after ROUNDS of training over ``count`` parts. States are averaged in a tree, GROUPS at a time."""
    spark, state = parts.sparkSession, start_state()
    for turn in range(ROUNDS):
        states = parts.groupBy("part").applyInArrow(_part_trainer(spark.sparkContext.broadcast(state), turn), "part long, n long, state binary")
        left = count
        while left > GROUPS:
            left = -(-left // GROUPS)
            states = states.withColumn("group", F.col("part") % left).groupBy("group").applyInArrow(lambda t: _average(t), "part long, n long, state binary")
        got = states.collect()
        if not got:
            return state
        total = sum(r.n for r in got)
        state = (sum(r.n * np.frombuffer(r.state, np.float32).astype(np.float64) for r in sorted(got, key=lambda r: r.part)) / total).astype(np.float32)
    return state


def _state_row(part: int, n: int, state: np.ndarray) -> pa.Table:
    return pa.table([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([state.astype(np.float32).tobytes()], pa.binary())], names=["part", "n", "state"])


def _part_trainer(begin, turn: int):
    def one(t):
        t = t.sort_by([("key", "ascending"), ("piece", "ascending"), ("copy", "ascending")])  # the order of arrival isn't fixed
        rows = np.concatenate([piece_windows(x.as_py()) for x in t["w"]])
        return _state_row(t["part"][0].as_py(), len(rows), train_part(begin.value, rows, 0.05 / (turn + 1), turn))

    return one


def _average(t):
    t = t.sort_by("part")
    n = np.asarray(t["n"]).astype(np.float64)
    total = sum(k * np.frombuffer(s.as_py(), np.float32).astype(np.float64) for k, s in zip(n, t["state"]))
    return _state_row(t["group"][0].as_py(), int(n.sum()), total / n.sum())


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, n_tokens, pll, rare`` of every row; rare: the words beyond the head, whose log share in the last class pll lacks."""

    def run(batches):
        vocabulary, state = model.value
        params = unpack(state)
        for batch in batches:
            n, total, rare = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), []
            rare_n = np.zeros(batch.num_rows, np.int64)
            for w in words_of(batch.column("text")):
                y, logp, known = _look(vocabulary, w.hash)
                logp, ctx = logp.astype(np.float64), windows(y, w.first)
                logp += target_log(params, ctx, y)
                sums, unknown = np.r_[0, np.cumsum(logp)], np.r_[0, np.cumsum(~known)]
                n[w.rows], total[w.rows] = w.counts, sums[w.first[1:]] - sums[w.first[:-1]]
                rare.append(w.hash[~known])
                rare_n[w.rows] = unknown[w.first[1:]] - unknown[w.first[:-1]]
            flat = pa.array(signed(np.concatenate(rare)) if rare else np.zeros(0, np.int64))
            rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare_n)].astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total), rare], names=["doc_id", "n_tokens", "pll", "rare"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, pll double, rare array<long>")


def with_rare(scored: DataFrame, counts: DataFrame, rest: int) -> DataFrame:
    """``doc_id, n_tokens, pll``, with the log shares of the words beyond the head, whose ``counts`` are joined."""
    rows = saved(scored.withColumn("rid", F.monotonically_increasing_id()))
    share = counts.select("h", (F.log("n") - F.log(F.lit(float(rest)))).alias("share"))
    more = rows.select("rid", F.explode("rare").alias("h")).join(share, "h").groupBy("rid").agg(F.sum("share").alias("more"))
    return rows.drop("rare").join(more, "rid", "left").select("doc_id", "n_tokens", (F.col("pll") + F.coalesce("more", F.lit(0.0))).alias("pll"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, pll, mean_logp`` of every row of ``docs(doc_id, text)``, over its whole text.

    Tokens are runs of other characters than ASCII blanks, lower-cased in A-Z. A null or empty text has no token, pll 0 and a null mean.
    Repeated rows have equal results and count as often as they occur; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    counts = saved(word_counts(docs))
    least, total = head_count(counts, HEAD)
    vocabulary = classes_of(counts.where(F.col("n") >= least).toArrow(), total)
    pieces = saved(training_pieces(docs, sc.broadcast(vocabulary)))
    # a piece belongs to a part as a whole, so the number of parts is that of all windows by PART
    parts = max(1, -(-total // PART))
    part = F.pmod(F.xxhash64("key", "piece", "copy"), F.lit(parts))
    model = sc.broadcast((vocabulary, train(pieces.withColumn("part", part), parts)))
    out = score(docs, model)
    out = with_rare(out, counts.where(F.col("n") < least), vocabulary[3]) if vocabulary[3] else out.drop("rare")
    return out.withColumn("mean_logp", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))


@query("op6_masked_pseudo_likelihood")
def op6(spark, sf_dir):
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
