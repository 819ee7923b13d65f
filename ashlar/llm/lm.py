"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are words, then one end a text. A token's probability is that of its
class given the context, times its share of the class. The most frequent words
and the end are classes of their own; all other words fall into ``REST`` classes
by the first two bytes, and within those the share is the count plus one over
the class's tokens, types and one unseen type. The words with a class of their
own are ``OWN * tokens ** GROWTH``, so the model grows with the corpus.

The model is log-bilinear: the previous class and the topic each give a vector,
their transformed sum is multiplied with the vector of every class, and a
softmax normalises. The topic is the group of coarse classes that leads among all
earlier words of the text (the groups come from the bigrams of the ``TOP`` most
frequent words), so it follows the language or kind of a text and uses nothing
that comes later.

What is learned covers all training rows: token counts, coarse bigrams, and
``ROUNDS`` rounds of training over every training token. Texts are encoded once
and spread over trainers, one for every ``SHARE`` tokens; a round's trainers start
from the same parameters, take their own texts in batches, and send the rows of
the parameters that they changed, which are averaged by how often each was
changed. The normalisers are batched matrix products in tasks as well. Counts of
the most frequent tokens go along with the encoding; those of the others are
joined by a 64-bit hash of the token.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, holdout, table

TOP, REST = 159, 96
COARSE = 1 + TOP + REST
GROUPS = 8
OWN, GROWTH = 4.0, 0.4
FREQUENT = 100_000
NAMED = 5
WIDTH, NOISE, RATE = 24, 64, 0.1
ROW = WIDTH + 2
ROUNDS, SHARE, BATCHES, BATCH = 2, 8_000_000, 1000, 2048
CHUNK, PACK, BLOCK, TALLY = 200, 200_000, 128, 300_000
FLOOR = 0.05
END = 0


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as bytes; without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hash(token: bytes) -> int:
    return int(_hashes([token])[0])


def _hashes(some: Collection[bytes]) -> np.ndarray:
    """Signed 64-bit hashes of tokens."""
    return np.fromiter(map(xxhash.xxh64_intdigest, some), np.uint64, len(some)).view(np.int64)


class _Rests(dict):
    """The rest class by the first two bytes, each made when first asked for."""

    def __missing__(self, head: bytes) -> int:
        self[head] = zlib.crc32(head) % REST
        return self[head]


_RESTS = _Rests()  # 65,793 at most


def _rest(token: bytes) -> int:
    return _RESTS[token[:2]]


def _rests(some: Collection[bytes]) -> np.ndarray:
    return np.fromiter([_RESTS[t[:2]] for t in some], np.int32, len(some))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tally = Counter()
    for b in batches:
        for text in b["text"]:
            tally.update(tokens(text))
            if len(tally) >= TALLY:
                yield _tallied(tally)
                tally = Counter()
    if tally:
        yield _tallied(tally)


def _tallied(tally: Counter) -> pd.DataFrame:
    names = [t.decode("utf-8", "surrogatepass") if n >= NAMED else None for t, n in tally.items()]
    return pd.DataFrame({"h": _hashes(tally), "n": list(tally.values()), "rest": _rests(tally), "token": names})


def token_counts(texts: DataFrame) -> DataFrame:
    """h, n, rest, token: the count of every distinct word of ``texts`` (text);
    token is null for words that are rare everywhere."""
    made = texts.mapInPandas(_counted, "h long, n long, rest int, token string")
    return made.groupBy("h").agg(F.sum("n").alias("n"), F.any_value("rest").alias("rest"), F.max("token").alias("token"))


class Vocabulary:
    """Frequent tokens with their counts and classes, and the totals.

    A code is the index of a frequent token, -1 for the end, or -2 less the rest
    class of a rare token. Class 0 is the end, then come the ``own`` words with a
    class of their own, then the rest classes; coarse classes likewise with ``TOP``.
    """

    def __init__(self, frequent: list[tuple[str, int]], own: int, rest_tokens: dict[int, int], rest_types: dict[int, int], n_texts: int):
        named = [t.encode("utf-8", "surrogatepass") for t, _ in frequent]
        self.index = {t: i for i, t in enumerate(named)}
        self.own = min(own, len(named))
        self.classes = 1 + self.own + REST
        self.count = np.array([n for _, n in frequent], np.int64)
        self.rest = _rests(named).astype(np.int64)
        self.n_texts = n_texts
        self.n_tokens = sum(rest_tokens.values()) + n_texts
        self.n_types = sum(rest_types.values()) + (n_texts > 0)
        total, kinds = np.zeros(REST), np.zeros(REST)
        for k, v in rest_tokens.items():
            total[k] = v
        for k, v in rest_types.items():
            kinds[k] = v
        np.subtract.at(total, self.rest[: self.own], self.count[: self.own])  # own words left the class of their first bytes
        np.subtract.at(kinds, self.rest[: self.own], 1)
        self.class_tokens = np.r_[n_texts, self.count[: self.own], total]
        self.log_share = np.r_[np.zeros(1 + self.own), -np.log10(total + kinds + 1.0)]

    def encode(self, text: str | None) -> tuple[np.ndarray, Counter]:
        """The codes of a text, the end included, and its rare words."""
        toks = tokens(text)
        codes = np.full(len(toks) + 1, -1, np.int32)
        codes[:-1] = np.fromiter(map(self.index.get, toks, repeat(-2)), np.int32, len(toks))
        at = np.flatnonzero(codes == -2)
        rare = [toks[i] for i in at.tolist()]
        codes[at] -= _rests(rare)
        return codes, Counter(rare)

    def classed(self, codes: np.ndarray, own: int) -> np.ndarray:
        """Class of every code, where ``own`` words have a class of their own."""
        word = np.arange(len(self.rest))
        named = np.where(word < own, 1 + word, 1 + own + self.rest)
        return np.r_[1 + own + np.arange(REST)[::-1], END, named].take(codes + (1 + REST))  # the codes from the least on

    def coarse(self, codes: np.ndarray) -> np.ndarray:
        return self.classed(codes, TOP)


def _packs(columns: Iterator[pd.Series]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of texts one after another, and the texts' bounds: about ``PACK``
    codes at once, or one long text."""
    held, size = [], 0
    for column in columns:
        for codes in column:
            held.append(codes)
            size += len(codes)
            if size >= PACK:
                yield np.concatenate(held), np.cumsum([0, *map(len, held)])
                held, size = [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held)])


def previous_class(classes: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The class before every token; ``start`` at a text's beginning."""
    previous = np.r_[start, classes[:-1]]
    previous[bounds[:-1]] = start
    return previous


def topics(coarse: np.ndarray, bounds: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The leading group of the words before every token; ``GROUPS`` at a start."""
    group, sizes = groups[coarse], np.diff(bounds)
    topic, most, votes = np.zeros(len(coarse), np.int64), np.zeros(len(coarse), np.int32), np.zeros(len(coarse) + 1, np.int32)
    for g in range(GROUPS):
        np.cumsum(group == g, out=votes[1:])
        earlier = votes[:-1] - np.repeat(votes[bounds[:-1]], sizes)
        topic[earlier > most] = g
        np.maximum(most, earlier, out=most)
    topic[bounds[:-1]] = GROUPS
    return topic


def bigrams(encoded: DataFrame, vocabulary: Broadcast) -> np.ndarray:
    """Counts of (previous, class) over all ``encoded`` texts, coarse classes."""
    shape = (COARSE + 1, COARSE)

    def tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for codes, bounds in _packs(b["codes"] for b in batches):
            classes = vocabulary.value.coarse(codes)
            total += np.bincount(previous_class(classes, bounds, COARSE) * COARSE + classes, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    rows = encoded.select("codes").mapInPandas(tallied, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # shape's rows at most
    out = np.zeros(shape[0] * shape[1])
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out.reshape(shape)


def class_groups(bigrams: np.ndarray) -> np.ndarray:
    """A group for each class: k-means on the leading singular vectors of the
    bigrams' positive pointwise information."""
    both = bigrams[:COARSE] + bigrams[:COARSE].T + 1e-3
    total = both.sum()
    info = np.maximum(0.0, np.log(both * total / np.outer(both.sum(1), both.sum(0))))
    u, s, _ = np.linalg.svd(info)
    x = u[:, :GROUPS] * np.sqrt(s[:GROUPS])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = [int(both.sum(1).argmax())]
    for _ in range(GROUPS - 1):
        centre.append(int(np.min([((x - x[c]) ** 2).sum(1) for c in centre], axis=0).argmax()))
    c = x[centre]
    for _ in range(20):
        near = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == g].mean(0) if (near == g).any() else c[g] for g in range(GROUPS)])
    return near


def _sigmoid_of_minus(x: np.ndarray) -> np.ndarray:
    """The logistic function of -x, in the array given."""
    with np.errstate(over="ignore"):  # an infinite exponential is a probability of 0
        np.exp(x, out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b by blocks of rows that stay below the size at which the matrix
    library starts threads: a task has one core, and idle threads spin."""
    out = np.empty((len(a), b.shape[1]), np.float32)
    for at in range(0, len(a), BLOCK):
        np.dot(a[at : at + BLOCK], b, out=out[at : at + BLOCK])
    return out


def _product_of_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b by the same blocks."""
    return sum(a[at : at + BLOCK].T @ b[at : at + BLOCK] for at in range(0, len(a), BLOCK))


def _sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of ``at`` to the next; two numbers are added at once."""
    return np.add.reduceat(rows.view(np.complex64), at, axis=0).view(np.float32)


def _by_row(row: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, the sums of their gradients, and how often each occurs."""
    order = np.argsort(row.astype(np.min_scalar_type(int(row.max()))), kind="stable")  # narrow types sort by radix
    row = row.take(order)
    at = np.flatnonzero(np.diff(row, prepend=-1))
    return row[at], _sums(grad.take(order, axis=0), at), np.diff(at, append=len(row))


class Model:
    """Parameters of the log-bilinear model, one row of ``WIDTH`` + 1 numbers each
    and a zero that makes them even: outputs of the classes with their bias, inputs of
    the classes and the start, topics and their start, and the matrix that transforms inputs."""

    def __init__(self, class_tokens: np.ndarray):
        k = len(class_tokens)
        self.noise = (class_tokens + 1.0) / (class_tokens + 1.0).sum()
        self.classes, self.input, self.topic = k, k, 2 * k + 1
        self.mix = self.topic + GROUPS + 1
        self.rows = np.zeros((self.mix + WIDTH, ROW), np.float32)
        self.rows[:, : WIDTH + 1] = np.random.default_rng(5).normal(0, 0.1, (self.mix + WIDTH, WIDTH + 1))
        self.rows[:k, WIDTH] = np.log(self.noise)
        self.rows[self.mix :] = np.eye(WIDTH, ROW)
        self.square = np.full(len(self.rows), 1e-3, np.float32)
        self.odds = np.log(NOISE * self.noise).astype(np.float32)

    def led(self, topic: np.ndarray) -> np.ndarray:
        """The topics' part of the contexts' vectors, with a one for the bias."""
        rows = self.rows[self.topic : self.mix].copy()
        rows[:, WIDTH] = 1.0
        return rows.take(topic, axis=0)

    def carried(self, previous: np.ndarray) -> np.ndarray:
        """The previous classes' part of the contexts' vectors, zero for the bias."""
        mix = np.zeros((ROW, ROW), np.float32)
        mix[:WIDTH, :WIDTH] = self.rows[self.mix :, :WIDTH]
        return _product(self.rows.take(self.input + previous, axis=0), mix)

    def hidden(self, topic: np.ndarray, previous: np.ndarray) -> np.ndarray:
        """The contexts' vectors, with a one for the bias."""
        out = self.carried(previous)
        out += self.led(topic)
        return out

    def normalisers(self, previous: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all classes, for every topic (columns)
        after each of ``previous``."""
        out = np.empty((len(previous), GROUPS + 1), np.float64)
        for t in range(GROUPS + 1):
            logit = self.hidden(np.full(len(previous), t), previous) @ self.rows[: self.classes].T
            top = logit.max(1, keepdims=True)
            out[:, t] = top[:, 0] + np.log(np.exp(logit - top).sum(1, dtype=np.float64))
        return out

    def log_p(self, topic: np.ndarray, previous: np.ndarray, classes: np.ndarray, normal: np.ndarray, carried: np.ndarray | None = None) -> np.ndarray:
        """log10 p(class | topic, previous); no context costs more than a factor 1 / FLOOR.
        ``carried`` may give the parts of all previous classes, made once."""
        hidden = self.carried(previous) if carried is None else carried.take(previous, axis=0)
        hidden += self.led(topic)
        logit = np.einsum("bd,bd->b", hidden, self.rows.take(classes, axis=0)).astype(np.float64)
        return np.log10((1.0 - FLOOR) * np.exp(logit - normal[previous, topic]) + FLOOR * self.noise[classes])

    def step(self, topic: np.ndarray, previous: np.ndarray, target: np.ndarray, noise: np.ndarray, touched: np.ndarray) -> None:
        """One batch of noise-contrastive estimation; all tokens of the batch meet
        the same noise words, so tokens of one context do so once, with their number
        as weight. Rows change by their own accumulated gradient."""
        p = self.rows
        context = previous * (GROUPS + 1) + topic
        order = np.argsort(context.astype(np.min_scalar_type(int(context.max()))), kind="stable")
        target = target.take(order)
        at = np.flatnonzero(np.diff(context.take(order), prepend=-1))
        times = np.diff(at, append=len(order))
        one = order.take(at)  # a token of each context
        hidden, mix = self.hidden(topic.take(one), previous.take(one)), p[self.mix :, :WIDTH]
        true, false = p.take(target, axis=0), p.take(noise, axis=0)
        every = hidden.repeat(times, axis=0)
        miss = _sigmoid_of_minus(self.odds[target] - np.einsum("bd,bd->b", every, true)) - 1.0
        away = -false
        away[:, WIDTH] += self.odds[noise]  # hidden has a one there
        hit = _sigmoid_of_minus(_product(hidden, away.T))
        hit *= times.astype(np.float32)[:, None]
        back = _product(hit, false)
        true *= miss[:, None]
        back += _sums(true, at)
        back[:, WIDTH] = 0.0
        every *= miss[:, None]
        words, outward, out_times = _by_row(np.concatenate([target, noise]), np.concatenate([every, _product_of_rows(hit, hidden)]))
        before = previous.take(one)
        first = np.flatnonzero(np.diff(before, prepend=-1))
        before, inward, in_times = before[first], _sums(back, first), np.add.reduceat(times, first)
        turn = np.zeros((WIDTH, ROW), np.float32)
        turn[:, :WIDTH] = _product_of_rows(p[self.input + before, :WIDTH], inward[:, :WIDTH])
        inward[:, :WIDTH] = _product(inward[:, :WIDTH], mix.T)
        of_topic = _product_of_rows(np.eye(GROUPS + 1, dtype=np.float32).take(topic.take(one), axis=0), back)
        row = np.concatenate([words, self.input + before, np.arange(self.topic, len(p))])
        grad = np.concatenate([outward, inward, of_topic, turn])
        touched[row] += np.concatenate([out_times, in_times, np.bincount(topic, minlength=GROUPS + 1), np.ones(WIDTH, np.int64)])
        square = self.square.take(row) + np.einsum("rd,rd->r", grad, grad) / (WIDTH + 1)
        self.square[row] = square
        grad *= (RATE / np.sqrt(square))[:, None]
        p[row] -= grad


def train(encoded: DataFrame, vocabulary: Broadcast, groups: np.ndarray) -> tuple[Model, np.ndarray]:
    """The model after ``ROUNDS`` rounds over all ``encoded`` (rid, codes) texts,
    and its normalisers by previous class and topic."""
    context = encoded.sparkSession.sparkContext
    model = Model(vocabulary.value.class_tokens)
    n_tokens = vocabulary.value.n_tokens
    trainers = -(-n_tokens // SHARE) or 1
    size = int(np.clip(n_tokens // BATCHES, 32, BATCH))
    spread = encoded.select("rid", "codes").repartition(trainers, "rid").select("codes")
    sums = [F.sum(F.col("w") * F.col("v")[i]).alias(f"v{i}") for i in range(ROW + 1)]
    for turn in range(ROUNDS if n_tokens else 0):
        shared = context.broadcast(model)  # rows grow like tokens ** GROWTH

        def trained(batches: Iterator[pd.DataFrame], turn: int = turn, shared: Broadcast = shared) -> Iterator[pd.DataFrame]:
            vocab, m, rng = vocabulary.value, copy.deepcopy(shared.value), np.random.default_rng(turn)
            touched, cut = np.zeros(len(m.rows), np.int64), np.cumsum(m.noise)
            for codes, bounds in _packs(b["codes"] for b in batches):
                classes = vocab.classed(codes, vocab.own)
                previous, topic = previous_class(classes, bounds, m.classes), topics(vocab.coarse(codes), bounds, groups)
                order = rng.permutation(len(classes))
                for at in range(0, len(order), size):
                    i = order[at : at + size]
                    noise = np.minimum(np.searchsorted(cut, rng.random(NOISE)), m.classes - 1)
                    m.step(topic[i], previous[i], classes[i], noise, touched)
            changed = np.flatnonzero(touched)
            for at in range(0, len(changed), 10_000):
                c = changed[at : at + 10_000]
                yield pd.DataFrame({"row": c, "w": touched[c].astype(np.float64), "v": list(np.c_[m.rows[c], m.square[c]])})

        mean = spread.mapInPandas(trained, "row long, w double, v array<float>").groupBy("row").agg(F.sum("w").alias("w"), *sums).toPandas()  # a row for each of the model's
        row, w = mean["row"].to_numpy(np.int64), mean["w"].to_numpy(np.float64)
        values = mean[[f"v{i}" for i in range(ROW + 1)]].to_numpy(np.float64) / w[:, None]
        model.rows[row], model.square[row] = values[:, :-1], values[:, -1]
    shared = context.broadcast(model)

    def normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), CHUNK):
                ids = b["id"].to_numpy(np.int64)[at : at + CHUNK]
                yield pd.DataFrame({"id": ids, "normal": list(shared.value.normalisers(ids))})

    session = encoded.sparkSession
    made = session.range(0, model.classes + 1, 1, 1 + model.classes // 1000).mapInPandas(normalised, "id long, normal array<double>").toPandas()
    return model, np.stack(made.sort_values("id")["normal"].to_list())


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one
    row for each row of ``docs`` (doc_id, text; other columns are not read).

    A null text is an empty one, whose only token is the end. Rows that repeat
    count each. Without training rows every token is unseen.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = holdout(F.col("doc_id"), 7) == 2
    train_texts = rows.filter(~held).select("text")
    counts = durable(token_counts(train_texts), "token-counts")
    by_class = {r["rest"]: (r["n"], r["v"]) for r in counts.groupBy("rest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # REST rows
    n_texts = rows.filter(~held).select("doc_id").count()
    own = int(OWN * (sum(n for n, _ in by_class.values()) + n_texts) ** GROWTH)
    named = counts.filter("token is not null").orderBy(F.col("n").desc(), "token").select("token", "n").limit(max(own, FREQUENT)).collect()
    vocabulary = Vocabulary([(r["token"], r["n"]) for r in named], own, {k: v[0] for k, v in by_class.items()}, {k: v[1] for k, v in by_class.items()}, n_texts)
    unit = np.log10(vocabulary.n_tokens + vocabulary.n_types + 1.0)
    shared = context.broadcast(vocabulary)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), CHUNK):
                part = b.iloc[lo : lo + CHUNK]
                codes, rare = zip(*map(shared.value.encode, part["text"]), strict=True)
                yield pd.DataFrame({
                    "rid": part["rid"], "doc_id": part["doc_id"].astype("Int64"), "codes": list(codes),
                    "rare": [_hashes(r) for r in rare], "times": [list(r.values()) for r in rare],
                })

    schema = "rid long, doc_id long, codes array<int>, rare array<long>, times array<long>"
    heads = durable(rows.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(encoded, schema), "lm-codes")
    learn = heads.filter(~held)
    groups = class_groups(bigrams(learn, shared))
    learned = context.broadcast((*train(learn, shared, groups), groups))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, (model, normal, groups) = shared.value, learned.value
        carried = model.carried(np.arange(model.classes + 1))
        known = np.log10(vocab.count + 1.0)
        end = np.log10(vocab.n_texts + 1.0)
        for b in batches:
            for lo in range(0, len(b), CHUNK):
                part = b.iloc[lo : lo + CHUNK]
                codes, bounds = np.concatenate(part["codes"].to_list()), np.cumsum([0, *map(len, part["codes"])])
                classes = vocab.classed(codes, vocab.own)
                previous, topic = previous_class(classes, bounds, model.classes), topics(vocab.coarse(codes), bounds, groups)
                counted = np.zeros(len(codes))
                counted[codes >= 0] = known[codes[codes >= 0]]
                counted[codes == -1] = end
                p = model.log_p(topic, previous, classes, normal, carried) + np.where(classes <= vocab.own, 0.0, counted + vocab.log_share[classes])
                sums = lambda v: np.add.reduceat(v, bounds[:-1])
                n_known = sums(((codes >= 0) | ((codes == -1) & (vocab.n_texts > 0))).astype(np.int64))
                yield pd.DataFrame({
                    "rid": part["rid"], "doc_id": part["doc_id"].astype("Int64"), "n_tokens": np.diff(bounds), "n_known": n_known,
                    "base": sums(counted), "model": sums(p),
                })

    made = heads.select("rid", "doc_id", "codes").mapInPandas(scored, "rid long, doc_id long, n_tokens long, n_known long, base double, model double")
    rare = heads.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("rid", F.col("w.rare").alias("h"), F.col("w.times").alias("k"))
    found = rare.join(counts.select("h", "n"), "h").groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("extra"), F.sum("k").alias("more"))
    out = made.join(found, "rid", "left")
    extra = F.coalesce("extra", F.lit(0.0))
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(vocabulary.n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(float(unit))).alias("base_score"), (F.col("model") + extra).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLES: dict[str, str] = {}
