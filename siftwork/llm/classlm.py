"""Class-based n-gram language model (Brown): exchange clustering of words, class transitions and word emissions.

Tokens are runs of non-space bytes of the text with A-Z lower-cased, then one end token per text. The ``top`` most frequent training
tokens are clustered into ``classes`` classes by the exchange algorithm, which moves one word at a time to the class that raises the
bigram likelihood most. Every further token seen ``least`` times in training then takes the class its neighbours' classes make most
likely, or stays in one of ``SHAPES`` classes by length and last byte where that is likelier; so the clustered vocabulary grows with
the corpus. Rarer and unseen tokens belong to the shape classes. The model is

    P(w | v) = P(class(w) | context(v)) * (c(w) + ALPHA) / (N_class(w) + ALPHA * (V_class(w) + 1))

with transitions interpolated with class frequencies; a text starts after the end token. context(v) is the class of v for the ``head``
most frequent tokens, and the shape class for others: those meet their counts and classes in a join, and two of them in a row would
need a join of token pairs. The head is broadcast with counts and classes; no token beyond it can be a hot key. Token counts cover
the whole training corpus. Both sums carry the base score, which is free of classes, as well.

Scale: five passes over the texts; shuffled are token counts, neighbour-class counts of each word (at most classes x words) and the
rare tokens of each document. On the driver: a dense table of ``top`` words, the head, and tables over classes.

Nulls and edges: null and empty texts are one end token; a null id counts as the empty text for the fold; repeated rows give repeated
results, rows of equal id and text are one key; an empty training side scores with c = N = V = 0. Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.tables import arrow_map, kept, signed
from siftwork.llm.words import Words, byte_classes, column_bytes, hash_words, in_sorted

SPACES = byte_classes(c0=" \t\n\x0b\x0c\r")
ALPHA = 0.1
TOP, CLASSES, SHAPES = 1500, 48, 16
LEAST = 2  # occurrences of a token whose class is learned
FOLLOWS = 5.0  # weight of the class frequencies in a transition, as counts
HEAD = 100_000
END = np.int64(0x5EED0E0D)  # the end token's key
FLUSH = 500_000


def tokens(batch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, keys, shape class, text number) of all tokens of a batch, in order, with the end tokens."""
    w = hash_words(column_bytes(batch, "text"), SPACES)
    n = len(w.offsets) - 1
    ends = w.offsets[1:] + np.arange(n)
    place = np.delete(np.arange(len(w.hash) + n), ends)
    keys, shape, text = (np.full(len(w.hash) + n, x, np.int64) for x in (END, 0, 0))
    keys[place] = signed(w.hash)
    shape[place] = np.minimum(np.maximum(w.size - 1, 0) // 4, 3) * 4 + w.last % 4
    text[place], text[ends] = w.text, np.arange(n)
    return w, keys, shape, text


class _Totals:
    """Sums by key inside a task, handed on whenever they grow past a size."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, *columns: np.ndarray) -> dict | None:
        frame = pd.DataFrame(dict(zip("abcd", columns))).groupby(["a", "b"], sort=False, as_index=False).agg(n=("c", "sum"))
        self.parts.append(frame)
        self.held += len(frame)
        return self.take() if self.held > FLUSH else None

    def take(self) -> dict | None:
        if not self.parts:
            return None
        frame = pd.concat(self.parts).groupby(["a", "b"], sort=False, as_index=False).agg(n=("n", "sum"))
        self.parts, self.held = [], 0
        return {"a": frame.a.to_numpy(), "b": frame.b.to_numpy(), "n": frame.n.to_numpy()}


def _partial(docs: DataFrame, pairs) -> DataFrame:
    """(a, b, n): ``pairs`` turns a batch into two key columns; counted inside each task only."""
    totals: list[_Totals] = []

    def step(batch) -> dict | None:
        if not totals:
            totals.append(_Totals())
        a, b = pairs(batch)
        return totals[0].add(a, b, np.ones(len(a), np.int64))
    return arrow_map(docs.select("text"), step, "a bigint, b bigint, n bigint", lambda: totals[0].take() if totals else None)


def _summed(docs: DataFrame, pairs) -> DataFrame:
    return _partial(docs, pairs).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _lists(partial: DataFrame) -> DataFrame:
    """One row per a: its values b with their counts, as two arrays; one shuffle by a."""
    summed = partial.repartition("a").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return summed.groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.n").alias("n"))


def _dense(batch: pa.RecordBatch, width: int, place=lambda b: b) -> np.ndarray:
    """The arrays of rows of ``_lists`` as one matrix of counts."""
    b, n = batch.column(1), batch.column(2)
    row = np.repeat(np.arange(batch.num_rows), b.value_lengths().to_numpy())
    spot = row * width + place(b.flatten().to_numpy())
    return np.bincount(spot, n.flatten().to_numpy().astype(float), minlength=batch.num_rows * width).reshape(-1, width)


def transitions(moves: np.ndarray) -> np.ndarray:
    share = (moves.sum(0) + ALPHA) / (moves.sum() + ALPHA * len(moves))
    return (moves + FOLLOWS * share) / (moves.sum(1, keepdims=True) + FOLLOWS)


def best_class(before: np.ndarray, after: np.ndarray | None, own: np.ndarray, moves: np.ndarray, used: int) -> np.ndarray:
    """Class of each word: of the ``used`` learned classes the one of best likelihood, given how often each class stood before and
    after the word, or ``own``, its shape class in ``moves``, if that is likelier without the word's own counts."""
    row, column = moves.sum(1), moves.sum(0)
    share = (column + ALPHA) / (moves.sum() + ALPHA * len(moves))
    log = np.log(transitions(moves))
    gain = before @ (log - np.log(column + 1))[:, :used]
    n = before.sum(1)
    rest = np.maximum(moves[:, own].T - before, 0) + FOLLOWS * share[own][:, None]
    stay = (before * (np.log(rest / (row + FOLLOWS)) - np.log(np.maximum(column[own] - n, 0) + 1)[:, None])).sum(1)
    if after is not None:
        gain += after @ log[:used].T
        rest = np.maximum(moves[own] - after, 0) + FOLLOWS * share
        stay += (after * np.log(rest / (np.maximum(row[own] - n, 0) + FOLLOWS)[:, None])).sum(1)
    return np.where(gain.max(1) > stay, gain.argmax(1), own)


def exchange(bigrams: np.ndarray, movable: int, classes: int, fixed: int, rounds: int = 8) -> np.ndarray:
    """Class of each unit. ``bigrams`` is a dense count matrix over units: ``movable`` words by falling frequency, then ``fixed`` units
    that keep classes of their own. A pass visits every word once; passes end when none moves or after ``rounds``."""
    n = movable + fixed
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(fixed)])
    k = classes + fixed
    member = np.eye(k)[of]
    table = member.T @ bigrams @ member
    xlogx = lambda a: np.where(a > 0, a * np.log(np.maximum(a, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for w in range(movable):
            out_w = bigrams[w] @ member           # to classes
            in_w = bigrams[:, w] @ member         # from classes
            self_w = bigrams[w, w]
            old = of[w]
            rest = table.copy()                   # without w
            rest[old] -= out_w
            rest[:, old] -= in_w
            rest[old, old] += self_w
            out_w, in_w = out_w.copy(), in_w.copy()
            out_w[old] -= self_w
            in_w[old] -= self_w
            row, column = rest.sum(1), rest.sum(0)
            c = np.arange(classes)
            gain = (xlogx(rest[:classes] + out_w) - xlogx(rest[:classes])).sum(1) + (xlogx(rest[:, :classes] + in_w[:, None]) - xlogx(rest[:, :classes])).sum(0)
            both = rest[c, c]
            gain += xlogx(both + out_w[c] + in_w[c] + self_w) - xlogx(both + out_w[c]) - xlogx(both + in_w[c]) + xlogx(both)
            gain -= xlogx(row[:classes] + out_w.sum() + self_w) - xlogx(row[:classes]) + xlogx(column[:classes] + in_w.sum() + self_w) - xlogx(column[:classes])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            rest[new] += out_w
            rest[:, new] += in_w
            rest[new, new] += self_w
            table = rest
            if new != old:
                member[w, old], member[w, new], of[w] = 0, 1, new
                moved += 1
        if not moved:
            break
    assert len(of) == n
    return of


def score(docs: DataFrame, train: Column, top: int = TOP, classes: int = CLASSES, head: int = HEAD, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity (per token)."""
    spark = docs.sparkSession
    training = docs.where(train)

    def words(batch):
        _, keys, shape, _ = tokens(batch)
        return keys, shape
    counts = kept(_summed(training, words).select(F.col("a").alias("key"), F.col("b").cast("int").alias("shape"), "n"), "lm-counts")
    often = counts.groupBy("n").count().toArrow().to_pandas().sort_values("n", ascending=False)  # distinct counts: below the root of twice the tokens
    total_n, total_v = int((often.n * often["count"]).sum()), int(often["count"].sum())
    fits = often.n[often["count"].cumsum() <= head]
    is_head = (F.col("n") >= (int(fits.min()) if len(fits) else total_n + 1)) | (F.col("key") == int(END))
    frequent = counts.where(is_head).toArrow().to_pandas().sort_values(["n", "key"], ascending=[False, True], ignore_index=True)  # at most `head` + 1 rows
    chosen = frequent[frequent.key != END].head(top)
    by_key = np.argsort(chosen.key.to_numpy())
    unit_keys = spark.sparkContext.broadcast((chosen.key.to_numpy()[by_key], by_key))
    n_units = len(chosen)

    def units(keys: np.ndarray, shape: np.ndarray) -> np.ndarray:
        sorted_keys, number = unit_keys.value
        at = in_sorted(sorted_keys, keys)
        out = np.where(at >= 0, number[at] if len(number) else 0, n_units + shape)
        return np.where(keys == END, n_units + SHAPES, out)

    def bigrams(batch):
        _, keys, shape, text = tokens(batch)
        u = units(keys, shape)
        before = np.concatenate([[n_units + SHAPES], u[:-1]])  # the token before a text's first is an end token
        return before, u
    table = np.zeros((n_units + SHAPES + 1,) * 2)
    pairs = _summed(training, bigrams).toArrow()  # at most (top + SHAPES + 1) ** 2 rows
    table[pairs["a"].to_numpy(), pairs["b"].to_numpy()] = pairs["n"].to_numpy()
    del pairs

    used = max(1, min(classes, n_units))
    of = exchange(table, n_units, used, SHAPES + 1) if n_units else np.arange(SHAPES + 1) + used
    k = used + SHAPES + 1
    member = np.eye(k)[of]
    moves = member.T @ table @ member
    del table, member

    # head words that are not clustered: a class by the classes before and after them
    key, count = frequent.key.to_numpy(np.int64), frequent.n.to_numpy(np.int64)
    head_class = used + frequent["shape"].to_numpy(np.int64)
    head_class[key == END] = k - 1
    head_class[chosen.index.to_numpy(np.int64)] = of[:n_units]
    order = np.argsort(key)
    sorted_head = (key[order], order)
    open_ = (count >= least) & (key != END)
    open_[chosen.index.to_numpy(np.int64)] = False
    if open_.any():
        first = spark.sparkContext.broadcast((*sorted_head, head_class, open_, moves))

        def neighbours(batch):
            keys_, number, class_, free, _ = first.value
            _, keys, shape, _ = tokens(batch)
            at = in_sorted(keys_, keys)
            word = np.where(at >= 0, number[at], -1)
            c = np.where(at >= 0, class_[word], used + shape)
            take = np.flatnonzero((at >= 0) & free[word])
            return np.tile(word[take], 2), np.concatenate([np.append(k - 1, c)[take], k + c[take + 1]])  # a text ends with the end token

        def choose(batch) -> dict:
            _, _, class_, _, moves_ = first.value
            word, seen = batch.column(0).to_numpy(), _dense(batch, 2 * k)
            return {"word": word, "class": best_class(seen[:, :k], seen[:, k:], class_[word], moves_, used)}
        learned = arrow_map(_lists(_partial(training, neighbours)), choose, "word bigint, class bigint").toArrow()
        head_class[learned["word"].to_numpy()] = learned["class"].to_numpy()

    # transitions into head words; the contexts of every other word, which give its class
    known = spark.sparkContext.broadcast((key[order], count[order], head_class[order]))

    def contexts(keys: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the head or -1, context class, context class of the token before)"""
        keys_, _, class_ = known.value
        at = in_sorted(keys_, keys)
        c = np.where(at >= 0, class_[at] if len(class_) else 0, used + shape)
        c = np.where(keys == END, k - 1, c)
        return at, c, np.append(k - 1, c[:-1])

    def steps(batch):
        _, keys, shape, _ = tokens(batch)
        at, c, before = contexts(keys, shape)
        return np.where(at >= 0, before * k + c, keys), np.where(at >= 0, -1, before * SHAPES + shape)
    raw = kept(_summed(training, steps), "lm-moves")
    into = raw.where(F.col("b") == -1).toArrow()  # at most classes ** 2 rows
    moves2 = np.zeros(k * k)
    moves2[into["a"].to_numpy()] = into["n"].to_numpy()
    shaped = raw.where(F.col("b") != -1).groupBy((F.col("b") % SHAPES).alias("s"), F.floor(F.col("b") / SHAPES).alias("h")).agg(F.sum("n").alias("n")).toArrow()
    start = moves2.reshape(k, k).copy()
    np.add.at(start, (shaped["h"].to_numpy().astype(int), used + shaped["s"].to_numpy().astype(int)), shaped["n"].to_numpy())
    second = spark.sparkContext.broadcast(start)

    def settle(batch) -> dict:
        before = _dense(batch, k, lambda b: b // SHAPES)
        n = before.sum(1).astype(np.int64)
        firsts = batch.column(1).offsets.to_numpy()[:-1] - batch.column(1).offsets[0].as_py()
        own = used + batch.column(1).flatten().to_numpy()[firsts] % SHAPES
        c = np.where(n >= least, best_class(before, None, own, second.value, used), own)
        return {"key": batch.column(0), "n": n, "class": c, "b": batch.column(1), "times": batch.column(2)}
    tail = kept(arrow_map(_lists(raw.where(F.col("b") != -1)), settle, "key bigint, n bigint, class bigint, b array<bigint>, times array<bigint>"), "lm-tail")
    found = tail.select("class", F.explode(F.arrays_zip("b", "times")).alias("x")).groupBy("class", F.floor(F.col("x.b") / SHAPES).alias("h")).agg(F.sum("x.times").alias("n")).toArrow()
    moves = moves2.reshape(k, k)
    np.add.at(moves, (found["h"].to_numpy().astype(int), found["class"].to_numpy()), found["n"].to_numpy())
    transition = np.log10(transitions(moves))
    # tokens and distinct tokens of each class in training
    per = tail.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    size, kinds = np.bincount(head_class, count, minlength=k).astype(float), np.bincount(head_class, minlength=k).astype(float)
    np.add.at(size, per["class"].to_numpy(), per["n"].to_numpy())
    np.add.at(kinds, per["class"].to_numpy(), per["v"].to_numpy())
    spread = np.log10(size + ALPHA * (kinds + 1))
    model = spark.sparkContext.broadcast((transition, spread))

    def known_part(batch) -> Iterator[dict]:
        """Per document the part that needs no join (key null), and each rare token with its context and count."""
        head_counts, (log_move, log_spread) = known.value[1], model.value
        _, keys, shape, text = tokens(batch)
        at, c, before = contexts(keys, shape)
        common = (at >= 0) | (keys == END)
        local = np.where(common, log_move[before, c] - log_spread[c], 0.0)
        log_count = np.where(common, np.log10(np.where(at >= 0, head_counts[at] if len(head_counts) else 0, 0) + ALPHA), 0.0)
        rows = batch.num_rows
        total_of = lambda x: np.bincount(text, x, minlength=rows)
        ids, copies = batch.column(0), batch.column(1)
        yield {"doc_id": ids, "copy": copies, "key": [None] * rows, "step": np.zeros(rows, np.int64), "times": np.bincount(text, minlength=rows), "known": total_of(at >= 0).astype(np.int64), "counted": total_of(log_count), "local": total_of(local)}
        rare = np.flatnonzero(~common)
        if len(rare):
            step = before * SHAPES + shape
            order = rare[np.lexsort((step[rare], keys[rare], text[rare]))]
            new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1]) | (step[order][1:] != step[order][:-1])])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            who = text[order][first]
            zero = np.zeros(len(first))
            yield {"doc_id": ids.take(_arrow(who)), "copy": copies.take(_arrow(who)), "key": keys[order][first], "step": step[order][first], "times": times, "known": zero.astype(np.int64), "counted": zero, "local": zero}

    def met_part(batch) -> dict:
        log_move, log_spread = model.value
        step, times, n = (batch.column(i).to_numpy() for i in (2, 3, 4))
        c = np.where(n > 0, batch.column(5).to_numpy(), used + step % SHAPES)
        return {"doc_id": batch.column(0), "copy": batch.column(1), "rows": np.zeros(len(n), np.int32), "times": np.zeros(len(n), np.int64), "known": np.where(n > 0, times, 0),
                "counted": times * np.log10(n + ALPHA), "local": times * (log_move[step // SHAPES, c] - log_spread[c])}

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = arrow_map(docs.select("doc_id", F.xxhash64("text").alias("copy"), "text"), known_part, f"doc_id {kind}, copy bigint, key bigint, step bigint, times bigint, known bigint, counted double, local double")
    parts = kept(parts, "lm-parts")
    own = parts.where(F.col("key").isNull()).withColumn("rows", F.lit(1))
    rare = parts.where(F.col("key").isNotNull()).select("doc_id", "copy", "key", "step", "times")
    joined = rare.join(tail.select("key", "n", "class"), "key", "left").select("doc_id", "copy", "step", "times", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("class", F.lit(0).cast("bigint")).alias("class"))
    met = arrow_map(joined, met_part, f"doc_id {kind}, copy bigint, rows int, times bigint, known bigint, counted double, local double")
    # rows of equal id and text count their tokens several times: divide by the number of such rows
    summed = own.select("doc_id", "copy", "rows", "times", "known", "counted", "local").unionByName(met).groupBy("doc_id", "copy").agg(*[F.sum(c).alias(c) for c in ("rows", "times", "known", "counted", "local")])
    each = lambda c: F.col(c) / F.col("rows")
    norm = float(np.log10(total_n + ALPHA * (total_v + 1)))
    out = summed.select("doc_id", each("times").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"), F.lit(total_n).cast("long").alias("train_tokens"),
                        (each("counted") - each("times") * norm).alias("base_score"), (each("counted") + each("local")).alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_again"))
    return out.drop("_again").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _arrow(index: np.ndarray):
    return pa.array(index, pa.int64())
