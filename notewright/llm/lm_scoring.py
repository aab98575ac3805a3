"""Language-model scoring: a log-bilinear neural model trained by noise-contrastive estimation.

The words of all training texts are counted over the whole corpus.  The commonest words (``symbol_words`` of the number of
tokens, so their number grows with the corpus) and the end sign are symbols of their own; every other word belongs to one of
``CLASSES`` symbols by its last three bytes, in which it has probability (c + 1) / (sum of the class's c + 1, plus 1 for unseen words).

A log-bilinear model predicts a symbol from the two before it: the predicted vector is h = R[u2] C2 + R[u1] C1.  Symbols lie
in groups by frequency, about as many as a group has members; the score of group g is h QG[g] + bG[g], that of symbol w in its
group h Q[w] + b[w].  Both choices are trained by noise-contrastive estimation on *all* training texts: each task counts the
symbol triples of its texts and trains its own copy of the model on all of them, and the copies' changes are averaged, each symbol's by
its number of uses.  What is read and gathered grows with the corpus; the model is bounded by ``HEAD``.  A text is scored with
batched matrix products that give both choices' exact normalisers, so that the whole is a proper distribution over the known words
and one unseen event a class.

Words outside the ``HEAD`` commonest (ties by hash and bytes) never meet a broadcast table: they are joined by key with the table
of counts.  Rows: one per input row, repeated rows and null ids included (a null id counts as a training
row).  A null or empty text has the end token alone.  With no training rows every count is zero.  Other columns than doc_id and text
aren't read, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CLASSES, HEAD, DIM, NOISE, ROUNDS = 48, 65_536, 16, 8, 1
#: Rows of a training step and of a matrix product; tokens that a task counts at once; least steps of a task.
STEP, PRODUCT, TOGETHER, LEAST_STEPS = 8192, 16_384, 4_000_000, 60
#: Parameters of one row when copies of the model are averaged.
BLOCK = 65_536
#: No word holds a space, so these keys can't be words.
END = b" "
FLUSH = 200_000


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words; bytes.split() parts at exactly x20 and x09-x0D."""
    return text.lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _counting(batches):
    held: Counter = Counter()

    def out():
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([-1 if k == END else word_class(k) for k in keys], pa.int32()), pa.array(list(held.values()), pa.int64())], ["word", "cls", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update(words(text.as_py()))
        held[END] += batch.num_rows
        if len(held) > FLUSH:
            yield out()
            held.clear()
    if held:
        yield out()


def count_words(train: DataFrame) -> DataFrame:
    """(word, cls, n) over all whole training texts; the end sign is the word ' '."""
    return train.select(common.text_bytes().alias("text")).mapInArrow(_counting, "word binary, cls int, n long").groupBy("word", "cls").agg(F.sum("n").alias("n"))


def symbol_words(tokens: int) -> int:
    """Words that are symbols of their own, by the number of training tokens."""
    return min(HEAD, max(110, int(1.5 * tokens**0.4)))


def cut(rows: DataFrame, column: str, most: int) -> int:
    """The greatest t for which at most ``most`` rows have a value (0 to 2 ** 63 - 1) of at least t, plus 1 for ties: rows at t or above
    are at most ``most``, rows at t - 1 or above more.  Found by counts of ranges of values, 65 536 at a time; rows are never gathered."""
    low, shift, above = 0, 48, 0
    while True:
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= low + (1 << shift + 16) - 1 if shift < 47 else F.lit(True)))
        found = inside.groupBy(F.shiftrightunsigned(F.col(column) - F.lit(low), shift).alias("range")).count().collect()
        for place, n in sorted(((r[0], r[1]) for r in found), reverse=True):
            if above + n > most:
                break
            above += n
        else:
            return low
        if not shift:
            return low + place + 1
        low, shift = low + (place << shift), shift - 16


def head_words(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int, int]], Column]:
    """The ``most`` commonest words, whatever their counts, those of greater hashes first at a tie; and the condition for all others.

    At a tie of hashes too, which 63 bits make most unlikely, those words are left to the others together.
    """
    if counts.limit(most + 1).count() <= most:
        rows, others = counts, F.lit(False)
    else:
        tie = F.shiftrightunsigned(F.xxhash64("word"), 1)
        least = cut(counts, "n", most)
        left = most - counts.where(F.col("n") >= least).count()
        edge = counts.where(F.col("n") == least - 1).select(tie.alias("tie"))
        inside = (F.col("n") >= least) | ((F.col("n") == least - 1) & (tie >= cut(edge, "tie", left)))
        rows, others = counts.where(inside), ~inside
    return sorted(((bytes(r[0]), r[1], r[2]) for r in rows.select("word", "cls", "n").collect()), key=lambda r: (-r[2], r[0])), others


class Lexicon:
    """What the scoring of one text needs besides the rare words' counts: bounded by HEAD."""

    def __init__(self, head, class_sums, total, distinct, own_words: int | None = None):
        self.total, self.distinct = total, distinct
        words_own = symbol_words(total) if own_words is None else own_words
        chosen = [END] + [w for w, _, _ in head if w != END][:words_own]
        self.own = own = len(chosen)
        self.symbols = own + CLASSES
        self.symbol = {w: i for i, w in enumerate(chosen)}
        self.index, cells = {}, []
        for w, cls, n in head:
            self.index[w] = len(cells)
            cells.append((self.symbol.get(w, own + max(cls, 0)), math.log10(n + 1), w in self.symbol, n))
        if END not in self.index:
            self.index[END] = len(cells)
            cells.append((0, 0.0, True, 0))
        self.sym = np.array([c[0] for c in cells], np.int32)
        self.log_c = np.array([c[1] for c in cells])
        self.is_symbol = np.array([c[2] for c in cells], bool)
        self.known = np.array([c[3] > 0 for c in cells], bool)
        sums = np.zeros(CLASSES)
        for cls, n in class_sums.items():
            sums[cls] = n
        self.counts = np.zeros(self.symbols)
        for w, cls, n in head:
            if w in self.symbol:
                self.counts[self.symbol[w]] = n
                if w != END:
                    sums[cls] -= n + 1
        #: Uses of each symbol in the training texts, for classes with one for each word.
        self.counts[own:] = np.maximum(sums, 0)
        self.class_log = np.log10(np.maximum(sums, 0) + 1)
        self.base_log = math.log10(total + distinct + 1)

    def look_up(self, text: bytes):
        """(symbols, head indexes or -1, rare words) of a text's words and its end sign."""
        toks = words(text)
        toks.append(END)
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in toks), np.int32, len(toks))
        sym = self.sym[at]
        rare_at = np.flatnonzero(at < 0)
        rare = [toks[i] for i in rare_at]
        if rare:
            sym[rare_at] = [self.own + word_class(w) for w in rare]
        return sym, at, rare


def contexts(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols two and one before each; the end sign stands before the text."""
    one = np.concatenate(([0], sym[:-1])).astype(np.int64)
    return np.concatenate(([0], one[:-1])), one


class Model:
    """Parameters of the log-bilinear model over ``symbols`` symbols in groups of equal width."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        self.symbols = s = len(counts)
        self.width = w = math.isqrt(max(s - 1, 0)) + 1
        self.groups = g = -(-s // w)
        use = np.zeros(g * w)
        use[:s] = counts + 0.5
        use = use.reshape(g, w)
        #: Noise: how often a group is used, and a symbol in its group.
        self.group_noise = (use.sum(1) / use.sum()).astype(np.float32)
        self.noise = (use / use.sum(1, keepdims=True)).astype(np.float32)
        rng = np.random.default_rng(seed)
        make = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        with np.errstate(divide="ignore"):
            bias = np.maximum(np.log(self.noise), -60)  # places without a symbol
        self.p = {"R": make(s, DIM), "C1": np.eye(DIM, dtype=np.float32), "C2": np.eye(DIM, dtype=np.float32) * 0.5, "QG": make(g, DIM), "bG": np.log(self.group_noise)[:, None], "Q": make(g * w, DIM), "b": bias.reshape(-1, 1)}

    def scores(self, h: np.ndarray, group: np.ndarray):
        """For rows sorted by group: (group, rows, scores within it)."""
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        q, b = self.p["Q"].reshape(self.groups, self.width, DIM), self.p["b"].reshape(self.groups, self.width)
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                k = group[a]
                yield k, slice(a, z), h[a:z] @ q[k].T + b[k]

    def log10(self, two: np.ndarray, one: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of targets after their contexts."""
        far, near = self.p["R"] @ self.p["C2"], self.p["R"] @ self.p["C1"]
        out = np.empty(len(target))
        for i in range(0, len(target), PRODUCT):
            t = target[i : i + PRODUCT]
            order = np.argsort(t, kind="stable")
            t = t[order]
            h = far[two[i : i + PRODUCT][order]] + near[one[i : i + PRODUCT][order]]
            group, place = np.divmod(t, self.width)
            rows = np.arange(len(t))
            got = _normalised(h @ self.p["QG"].T + self.p["bG"][:, 0], group)
            for _, at, score in self.scores(h, group):
                got[at] += _normalised(score, place[at])
            out[i + order] = got[rows]
        return out / math.log(10)

    def gradient(self, two, one, target, n):
        """The estimation's ascent direction over rows with counts n, sorted by target; and the uses of each parameter row."""
        p, s = self.p, self.symbols
        grad = {k: np.zeros_like(x) for k, x in p.items()}
        kept = {"sum1": np.zeros((s, DIM), np.float32), "sum2": np.zeros((s, DIM), np.float32)}
        far, near = p["R"] @ p["C2"], p["R"] @ p["C1"]
        for i in range(0, len(target), PRODUCT):
            u2, u1, t, c = two[i : i + PRODUCT], one[i : i + PRODUCT], target[i : i + PRODUCT], n[i : i + PRODUCT].astype(np.float32)
            h = far[u2] + near[u1]
            group, place = np.divmod(t, self.width)
            pull = _pull(h @ p["QG"].T + p["bG"][:, 0], self.group_noise, group, c)
            back = pull @ p["QG"]
            grad["QG"] += pull.T @ h
            grad["bG"][:, 0] += pull.sum(0)
            for k, at, score in self.scores(h, group):
                mine = slice(k * self.width, (k + 1) * self.width)
                pull = _pull(score, self.noise[k], place[at], c[at])
                back[at] += pull @ p["Q"][mine]
                grad["Q"][mine] += pull.T @ h[at]
                grad["b"][mine, 0] += pull.sum(0)
            for name, u in (("sum1", u1), ("sum2", u2)):
                cells = (u[:, None] * DIM + np.arange(DIM)).ravel()
                kept[name] += np.bincount(cells, back.ravel(), s * DIM).astype(np.float32).reshape(s, DIM)
        grad["C1"], grad["C2"] = p["R"].T @ kept["sum1"], p["R"].T @ kept["sum2"]
        grad["R"] = kept["sum1"] @ p["C1"].T + kept["sum2"] @ p["C2"].T
        return grad


def _normalised(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log probabilities of one choice a row; the scores are used up."""
    top = scores.max(1, keepdims=True)
    scores -= top
    got = scores[np.arange(len(chosen)), chosen].astype(np.float64)
    return got - np.log(np.exp(scores, out=scores).sum(1))


def _pull(scores: np.ndarray, noise: np.ndarray, chosen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The derivative by the scores: n (1 - P(data)) at the choice, -NOISE n noise P(data) everywhere, which is the noise draws' mean."""
    with np.errstate(divide="ignore"):
        scores = scores - np.maximum(np.log(NOISE * noise), -80)
    truth = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    pull = truth * (-NOISE * noise) * n[:, None]
    rows = np.arange(len(chosen))
    pull[rows, chosen] += n * (1 - truth[rows, chosen])
    return pull


class Trainer:
    """A copy of the model that a task trains on the triples of its texts."""

    def __init__(self, model: Model, rate: float = 0.03):
        self.model, self.rate, self.steps = model, rate, 0
        self.start = {k: x.copy() for k, x in model.p.items()}
        self.first, self.second = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
        self.uses = {k: np.zeros(len(x)) for k, x in model.p.items()}

    def learn(self, two: np.ndarray, one: np.ndarray, target: np.ndarray) -> None:
        """Learns from all of these tokens, each distinct triple once with its count."""
        m, s = self.model, self.model.symbols
        keys = (two * s + one) * s + target
        keys.sort()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n, keys = np.diff(np.r_[starts, len(keys)]), keys[starts]
        size = max(STEP, s)
        order = np.random.default_rng(self.steps).permutation(len(keys))
        for _ in range(-(-LEAST_STEPS // -(-len(keys) // size)) if self.steps < LEAST_STEPS else 1):
            for i in range(0, len(keys), size):
                part = order[i : i + size]
                rest, t = np.divmod(keys[part], s)
                by = np.argsort(t, kind="stable")
                u2, u1 = np.divmod(rest[by], s)
                self.step(m.gradient(u2, u1, t[by], n[part][by]), float(n[part].sum()))
        rest, t = np.divmod(keys, s)
        u2, u1 = np.divmod(rest, s)
        uses = np.bincount(t, n, m.groups * m.width)
        for name, x in (("Q", uses), ("b", uses), ("QG", uses.reshape(m.groups, -1).sum(1)), ("bG", uses.reshape(m.groups, -1).sum(1)), ("R", np.bincount(u1, n, s) + np.bincount(u2, n, s))):
            self.uses[name] += x
        for name in ("C1", "C2"):
            self.uses[name] += n.sum()

    def step(self, grad, weight: float) -> None:
        self.steps += 1
        rate = self.rate * min(1.0, (LEAST_STEPS / self.steps) ** 0.5)
        for k, g in grad.items():
            g = g / weight
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            self.model.p[k] += rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.99**self.steps)) + 1e-6)

    def changes(self) -> np.ndarray:
        """All changes times their row's uses, then the uses."""
        names = sorted(self.model.p)
        moved = [((self.model.p[k] - self.start[k]) * self.uses[k][:, None]).ravel() for k in names]
        return np.concatenate([*moved, *(self.uses[k] for k in names)]).astype(np.float32)


def apply_changes(model: Model, total: np.ndarray) -> None:
    """Adds the sum of copies' changes, each row divided by its uses."""
    names, at = sorted(model.p), 0
    use_at = sum(x.size for x in model.p.values())
    for k in names:
        x = model.p[k]
        uses = total[use_at : use_at + len(x)]
        model.p[k] = (x + total[at : at + x.size].reshape(x.shape) / np.maximum(uses, 1)[:, None]).astype(np.float32)
        at, use_at = at + x.size, use_at + len(x)


def _training(held):
    def run(batches):
        trainer, syms, size = Trainer(pickle.loads(held.value)), [], 0

        def learn():
            pairs = [contexts(s) for s in syms]
            trainer.learn(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), np.concatenate(syms).astype(np.int64))

        for batch in batches:
            for x in batch.column(0):
                sym = np.frombuffer(x.as_buffer(), "<i4")
                for i in range(0, len(sym), TOGETHER):  # a giant text in parts
                    syms.append(sym[i : i + TOGETHER])
                    size += len(syms[-1])
                    if size >= TOGETHER:
                        learn()
                        syms, size = [], 0
        if syms:
            learn()
        if trainer.steps:
            flat = trainer.changes()
            for i in range(0, len(flat), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([flat[i : i + BLOCK].tobytes()], pa.binary())], ["block", "x"])

    return run


def _summing(batches):
    """The sum of each block's rows; a task holds at most the model."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(x.as_buffer(), np.float32)
            sums[block] = sums[block] + x if block in sums else x.astype(np.float64)
    for block, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "x"])


def train(coded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """coded: (sym binary) of the training texts; counts: uses of each symbol."""
    spark, model = coded.sparkSession, Model(counts)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(pickle.dumps(model))
        # copies are summed within tasks of neighbours first
        found = coded.mapInArrow(_training(held), "block int, x binary").repartition("block").mapInArrow(_summing, "block int, x binary")
        blocks = {b: np.frombuffer(x, np.float64) for b, x in found.collect()}  # as many as the model has
        if blocks:
            apply_changes(model, np.concatenate([blocks[i] for i in range(len(blocks))]))
        held.unpersist()
    return model


_CODED = ["uid", "word", "cnt", "doc_id", "train", "n_tokens", "n_known", "base", "within", "sym"]
_CODED_TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
_CODED_SCHEMA = "uid long, word binary, cnt int, doc_id long, train boolean, n_tokens long, n_known long, base double, within double, sym binary"


def _coding(lexicon):
    """A row for each text with its symbols and what its head words give, and one for each distinct rare word of it."""

    def run(batches):
        lex = pickle.loads(lexicon.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                cols: list[list] = [[] for _ in _CODED]
                for uid, doc, train_row, text in zip(*(c.to_pylist() for c in batch.slice(start, 100).columns), strict=True):
                    sym, at, rare = lex.look_up(text)
                    got = at[at >= 0]
                    base = float(lex.log_c[got].sum()) - len(sym) * lex.base_log
                    inside = got[~lex.is_symbol[got]]
                    within = float(lex.log_c[inside].sum() - lex.class_log[lex.sym[inside] - lex.own].sum())
                    if rare:
                        within -= float(lex.class_log[sym[at < 0] - lex.own].sum())
                    for col, x in zip(cols, (uid, None, None, doc, train_row, len(sym), int(lex.known[got].sum()), base, within, sym.astype("<i4").tobytes()), strict=True):
                        col.append(x)
                    if rare:
                        held = Counter(rare)
                        k = len(held)
                        cols[0] += [uid] * k
                        cols[1] += held.keys()
                        cols[2] += held.values()
                        for col in cols[3:]:
                            col += [None] * k
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CODED_TYPES, strict=True)], _CODED)

    return run


def _scoring(held):
    names = ["uid", "doc_id", "n_tokens", "n_known", "base", "score"]

    def run(batches):
        model = pickle.loads(held.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                syms = [np.frombuffer(x.as_buffer(), "<i4") for x in part.column(6)]
                sums = np.empty(len(syms))
                i = 0
                while i < len(syms):
                    k, size = i, 0
                    while k < len(syms) and (k == i or size + len(syms[k]) <= 4 * PRODUCT):
                        size += len(syms[k])
                        k += 1
                    pairs = [contexts(s) for s in syms[i:k]]
                    got = model.log10(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), np.concatenate(syms[i:k]).astype(np.int64))
                    sums[i:k] = np.add.reduceat(got, np.cumsum([0, *map(len, syms[i : k - 1])]))  # no text is without a token
                    i = k
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sums + part.column(5).to_numpy())], names)

    return run


def score_documents(docs: DataFrame, held_out_of: int = 7, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row."""
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out_of_train = F.coalesce(common.remainder("doc_id", held_out_of) == held_out, F.lit(False))
    counts = common.materialise(count_words(docs.where(~out_of_train)), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head, others = head_words(counts, HEAD)
    # the end sign is looked up in the head, whatever its rank
    if total and all(w != END for w, _, _ in head):
        head += [(END, -1, r[0]) for r in counts.where(F.col("word") == F.lit(END)).select("n").collect()]
    sums = {r[0]: r[1] for r in counts.where("cls >= 0").groupBy("cls").agg(F.sum(F.col("n") + 1)).collect()}
    own = Lexicon(head, sums, total, distinct)
    lexicon = spark.sparkContext.broadcast(pickle.dumps(own))
    coded = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (~out_of_train).alias("train"), common.text_bytes().alias("text")).mapInArrow(_coding(lexicon), _CODED_SCHEMA)
    coded = common.materialise(coded, "lm-coded")
    texts = coded.where("sym is not null")
    model = spark.sparkContext.broadcast(pickle.dumps(train(texts.where("train").select("sym"), own.counts)))
    scored = texts.select("uid", "doc_id", "n_tokens", "n_known", "base", "within", "sym").mapInArrow(_scoring(model), "uid long, doc_id long, n_tokens long, n_known long, base double, score double")
    rare = coded.where("word is not null").select("uid", "word", "cnt")
    tail = counts.where(others).select("word", F.log10(F.col("n") + 1).alias("log_c"))
    found = rare.join(tail, "word").select("uid", (F.col("log_c") * F.col("cnt")).alias("log_c"), "cnt")
    sums = found.groupBy("uid").agg(F.sum("log_c").alias("log_c"), F.sum("cnt").alias("hit"))
    whole = scored.join(sums, "uid", "left").select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("hit", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("log_c", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("log_c", F.lit(0.0))).alias("score"))
    return whole.select("doc_id", out_of_train.alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
